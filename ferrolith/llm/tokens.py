"""Whole texts to token ids with a public word-level byte-pair tokenizer.

The tokenizer merges within a word only, so a word's ids never depend on its neighbours. A step of texts is cut at
spaces and line feeds into chunks, equal chunks are found by dictionary encoding, each distinct chunk is encoded once,
and the ids of all texts are gathered from those. A worker remembers words that it has met lately, in two generations
of a bounded number, so that frequent ones stay and rare ones go. Forgetting changes no result.

This holds for a tokenizer file of the settings in ``SETTINGS``; with any other file each text takes the library's own
full path.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ferrolith.llm.common import slices

#: Fixed value: the identifier that ends each document.
END_ID = 2
#: Fixed pattern: the tokenizer file's own word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The settings of a tokenizer file whose words can be encoded one by one.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD = regex.compile(PATTERN)

#: Words in each of the two generations that a worker remembers; bytes of text in one step.
WORDS = 150_000
STEP = 6 << 20


def default_tokenizer() -> str:
    """The place of the default vocabulary file on this machine: workers ask for it themselves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable Latin-1 as itself, the rest from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}


class Memo(dict):
    """A mapping that makes missing values by ``make`` and keeps those used in the last ``most`` to twice as many additions."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Texts to ids with the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = all(settings[k] == v for k, v in SETTINGS.items())
        self.letters = _byte_letters()
        self.words = Memo(self._word, WORDS)

    def _word(self, word: str) -> bytes:
        found = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in found]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        # below U+0250 there is nothing to normalise but case; anything else, and marks of special tokens, takes the library's full path
        if not chunk.isascii() and max(chunk) >= "ɐ":
            return self._whole(chunk)
        low = chunk.lower()
        if low.isalpha():
            return self.words[low]
        if low[:-1].isalpha() and low[-1] in ".,;:!?":
            return self.words[low[:-1]] + self.words[low[-1]]
        if low and min(low) > " " and "<|" not in low:
            return b"".join([self.words[w] for w in WORD.findall(low)])
        return self._whole(chunk)

    def _whole(self, text: str | None) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def _step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids = [self._whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), "<u4"), np.asarray([len(x) // 4 for x in ids], np.int64)
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        flat = cut.flatten().dictionary_encode()
        own = list(map(self._chunk, flat.dictionary.to_pylist()))
        size = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        first = np.cumsum(size) - size
        at = flat.indices.to_numpy()
        many = size[at]
        ends = np.cumsum(many)
        places = np.repeat(first[at] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)
        bounds = np.concatenate(([0], ends))[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return np.frombuffer(b"".join(own), "<u4")[places], np.diff(bounds)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For consecutive texts (range lo to hi): the ids of all of them in a row, each text followed by the end id, and each text's number of ids."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for lo, hi in slices(sizes, STEP):
            ids, counts = self._step(texts.slice(lo, hi - lo))
            out = np.full(len(ids) + hi - lo, END_ID, "<u4")
            inside = np.ones(len(out), bool)
            inside[np.cumsum(counts + 1) - 1] = False
            out[inside] = ids
            yield lo, hi, out, counts + 1

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, without the end id, as little-endian unsigned 32-bit bytes; a null text has none."""
        return b"".join(out[:-1].tobytes() for _, _, out, _ in self.encode_column(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for a tokenizer file, the default one if none is named."""
    return WordEncoder(path or default_tokenizer())
