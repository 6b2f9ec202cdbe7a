"""Operators and pipeline stages against plain versions of the same work, row by row."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from ferrolith.llm import language_id, lm_scoring, mixing, packing, quality, simhash, token_output
from ferrolith.llm.tokens import END_ID, default_tokenizer, encoder

from .test_operators import AWKWARD, DOC, prose


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, END_ID]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing_against_the_library(spark, plain):
    texts = ["The QUICK fox's 12 tails, it'll jump!? (señor) İstanbul", "tab\there\r\nand\n\nlines", "é combining", "½ ² x_y", *[r[1] for r in AWKWARD]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pieces = defaultdict(list)
    for p in packing.pack_documents(rows, longest=64).collect():
        pieces[p.doc_id].append(p)
    for i, text in enumerate(texts):
        ids, at = ids_of(plain, text), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert (p.start, p.ids_crc32, p.doc_tokens, p.offset) == (at, crc(ids[at : at + p.length]), len(ids), 0)
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(rows.limit(0)).count() == 0


def test_buckets_hold_one_length(spark, tmp_path, plain):
    rows = spark.createDataFrame([(i, "word " * i) for i in range(40)], "doc_id bigint, text string")
    packing.write_buckets(rows, str(tmp_path / "b"), longest=16)
    back = spark.read.parquet(str(tmp_path / "b")).collect()
    assert all(len(r["ids"]) == 1 << r.bucket for r in back)
    assert sum(r.length for r in back) == sum(len(ids_of(plain, "word " * i)) for i in range(40))


def test_token_files_are_selective(spark, tmp_path, plain):
    rows = spark.createDataFrame([(i, f"some words number {i} " * (i % 7)) for i in range(300)], "doc_id bigint, text string")
    for encoding in ("dictionary", "delta"):
        path = str(tmp_path / encoding)
        token_output.write_tokens(rows, path, encoding=encoding, row_group_bytes=4096, page_bytes=512, page_rows=20)
        found = token_output.read_tokens(spark, path).where("doc_id between 100 and 103").collect()
        assert {r.doc_id: list(r["ids"]) for r in found} == {i: ids_of(plain, f"some words number {i} " * (i % 7)) for i in range(100, 104)}
        footers = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / encoding).glob("*.parquet"))]
        columns = [m.row_group(g).column(c) for m in footers for g in range(m.num_row_groups) for c in range(m.num_columns)]
        ids = [c for c in columns if c.path_in_schema.startswith("ids")]
        assert ids and all(c.has_offset_index and c.has_column_index for c in columns if c.num_values and not c.path_in_schema.startswith("ids"))
        assert any("DICTIONARY" in e for c in ids for e in c.encodings) == (encoding == "dictionary")
    token_output.write_tokens(rows.limit(0), str(tmp_path / "none"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_other_tokenizer_files_take_the_full_path(tmp_path):
    import json

    settings = json.loads(open(default_tokenizer(), encoding="utf-8").read())
    settings["normalizer"] = None
    (tmp_path / "t.json").write_text(json.dumps(settings), encoding="utf-8")
    own = encoder(str(tmp_path / "t.json"))
    assert not own.by_word and encoder().by_word
    text = "Upper CASE words"
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(plain, monkeypatch):
    from ferrolith.llm import tokens

    monkeypatch.setattr(tokens, "WORDS", 3)
    monkeypatch.setattr(tokens, "STEP", 40)
    words = tokens.WordEncoder(default_tokenizer())
    texts = [" ".join(f"w{i * j % 17}x" for i in range(30)) for j in range(10)]
    got = [ids.tolist() for _, _, ids, _ in words.encode_column(pa.array(texts))]
    assert sum(got, []) == sum((ids_of(plain, t) for t in texts), [])


def test_lm_gradient_against_naive_softmax(spark):
    rows = spark.createDataFrame(prose(40), DOC)
    words = lm_scoring.count_words(rows)
    seen = {}
    fit = lm_scoring.fit_weights

    def watch(texts, tasks, vocabulary, counts, rounds=1):
        seen.update(vocabulary=vocabulary.value, counts=counts)
        state = spark.sparkContext.broadcast((np.float32(lm_scoring.START) * lm_scoring._log_share(counts), [np.float32(lm_scoring.TREE_START) * lm_scoring._log_share(c) for c in lm_scoring.tree_counts(vocabulary.value)]))
        seen["state"] = state.value
        seen["surplus"] = lm_scoring._summed(texts.select("text"), tasks, lm_scoring._gradient(vocabulary, spark.sparkContext.broadcast(counts), state), lm_scoring.ALL_ROWS, np.uint16, np.float64)
        return fit(texts, tasks, vocabulary, counts, 1)

    lm_scoring.fit_weights, kept = watch, fit
    try:
        lm_scoring.train(rows, words)
    finally:
        lm_scoring.fit_weights = kept
    counts, (hashed, tree), v = seen["counts"].astype(float), seen["state"], seen["vocabulary"]
    want = np.zeros_like(seen["surplus"], dtype=float)
    n = 0
    for r in prose(40):
        tokens, starts = lm_scoring.token_hashes([r[1].encode()])
        leaf = v.leaves(v.table.find(tokens))
        at, digits = lm_scoring.feature_rows(tokens, starts, leaf), lm_scoring.digits(leaf)
        for i in range(len(tokens)):
            n += 1
            for level in range(lm_scoring.LEVELS):
                mine = [k for k, t in enumerate(lm_scoring.TEMPLATES) if t[0] == level]
                own = digits[level][i]
                total = tree[level][(0, leaf[i] >> 10, leaf[i] >> 5)[level]].astype(float).copy()
                for k in mine:
                    total += hashed[at[k, i]]
                    c = counts[at[k, i], own]
                    total[own] += lm_scoring.START * math.log((c - 1 + lm_scoring.SMOOTH) / (c + lm_scoring.SMOOTH))
                p = np.exp(total) / np.exp(total).sum()
                p[own] -= 1
                for k in mine:
                    want[at[k, i]] += p
                want[lm_scoring.TREE_ROWS[level] + (0, leaf[i] >> 10, leaf[i] >> 5)[level]] += p
    assert n == 40 * 31
    big = np.abs(want) > 1
    assert big.sum() > 20 and np.allclose(seen["surplus"], want, rtol=0.02, atol=0.02)


def test_mixture_proportions_against_naive_em(spark):
    rows = spark.createDataFrame(prose(200), DOC)
    model = language_id.train(rows)
    text = "the and river la maison sous house avec matin"
    _, full = language_id.mixtures([text], model)
    buffer, _ = language_id._buffer([text])
    gram = language_id.ngram_buckets(buffer)
    words, weight = [], []
    position = 0
    for word in text.split(" "):
        grams = gram[position : position + len(word) + 1]
        words.append([float(sum(model.log_share[k][g] for g in grams)) for k in range(len(model.names))])
        weight.append(len(grams))
        position += len(word) + 1
    share = np.full(len(model.names), 1 / len(model.names))
    for _ in range(language_id.ITERATIONS):
        posterior = []
        for logs in words:
            joint = share * np.exp(np.array(logs) - max(logs))
            posterior.append(joint / joint.sum())
        share = np.average(posterior, axis=0, weights=weight)
    assert full[0] == pytest.approx(share, abs=0.02)


def test_letters_are_letters():
    model = language_id.LanguageModel(["a", "b"], np.log(np.full((2, 1 << language_id.BUCKET_BITS), 1e-4, np.float32)))
    names, scores = language_id.predict_batch(["½ ²", "①②", "12 !", "", None, "é", "日本"], model)
    assert names[:5] == ["und"] * 5 and (scores[:5] == 0).all()
    assert names[5] != "und" and names[6] != "und" and ((scores >= 0) & (scores <= 1)).all()


def test_ftrl_against_a_plain_loop(spark):
    texts = [(i, ("good fine clear text " if i % 2 else "BUY!! now $$$ click ") * (1 + i % 3)) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1)], "doc_id bigint, label int").coalesce(1)
    got = quality.train(docs, labels.dropDuplicates(), epochs=2, shards=1)
    order = [r.doc_id for r in docs.sort(F.xxhash64("doc_id", F.lit(4))).collect()]
    z, n = np.zeros(quality.BIAS + 1), np.zeros(quality.BIAS + 1)
    for _ in range(2):
        start_z, start_n = z.copy(), n.copy()
        for i in order:
            bucket, _, counts = quality.features([texts[i][1].encode()])
            x = np.bincount(bucket.ravel(), minlength=quality.BIAS + 1) / counts.sum()
            x = x.astype(np.float32).astype(float)
            x[quality.BIAS] = 1.0
            w = quality._weights(z, n)
            g = (1 / (1 + math.exp(-float(w @ x))) - i % 2) * x
            sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA
            z, n = z + g - sigma * w, n + g * g
        z, n = start_z + (z - start_z).astype(np.float32), start_n + (n - start_n).astype(np.float32)
    assert got == pytest.approx(quality._weights(z, n), abs=1e-4)
    assert len(set(quality.scores(["good fine clear text", "BUY!! now $$$"], got) > 0.5)) == 2


def check_mixture(uses, sources, texts):
    """Each source in whole passes of its documents and one cut pass that ends with the document that crosses the quota."""
    for s in sources:
        of = [u for u in uses if u.source == s.source]
        size = {i for i, (src, _) in texts.items() if src == s.source}
        passes = defaultdict(list)
        for u in of:
            passes[u.pass_no].append(u)
        assert all(len({u.doc_id for u in p}) == len(p) for p in passes.values())
        whole = math.floor(s.passes + 1e-9)
        assert all({u.doc_id for u in passes[k]} == size for k in range(1, whole + 1))
        for p in passes.values():  # a pass is a permutation of its blocks
            by_block = {u.block: u.position for u in p}
            assert len(set(by_block.values())) == len(by_block) and all(by_block[u.block] == u.position for u in p)
        last = passes.get(whole + 1, [])
        quota = s.tokens * s.passes - s.tokens * whole
        used = sum(u.n_tokens for u in last)
        if quota > 1e-6 * s.tokens:
            end = max(last, key=lambda u: (u.position, u.order, u.doc_id))
            assert used >= quota - 1e-6 and used - end.n_tokens < quota
        else:
            assert not last


def test_mixing_against_quotas(spark):
    rng = np.random.default_rng(3)
    texts = {i: (f"s{min(i % 7, 3)}", "word " * int(rng.integers(1, 40))) for i in range(500)}
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in texts.items()], "doc_id bigint, text string, source string")
    for options in ({"max_repeats": 1.7}, {"target_entropy": 0.95}, {"max_repeats": 9.0, "budget": 9000.0}, {"max_repeats": 2.0, "block_tokens": 50}):
        plan, mixture = mixing.plan_mixture(docs, **options)
        check_mixture(plan.collect(), mixture.sources.collect(), texts)
    empty = docs.withColumn("text", F.when(F.col("source") != "s1", F.col("text")))
    plan, mixture = mixing.plan_mixture(empty.unionByName(empty))
    assert plan.where("source = 's1'").count() == 2 * sum(s == "s1" for s, _ in texts.values())


def words_of(text):
    return (text or "").encode().lower().split()


def naive_fingerprint(text):
    words = words_of(text)
    if not words:
        return 0
    size = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_groups(prints):
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    known = sorted(prints)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    return {f: root(f) for f in prints}


def naive_lines(rows, least=10):
    sites, first = defaultdict(set), {}
    for doc_id, text, _, source, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for at, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if line:
                sites[line] |= {source} - {None}
                first.setdefault(line, (doc_id, at))
    out = []
    for doc_id, text, *rest in rows:
        lines = (text or "").split("\n")
        kept = [x for at, x in enumerate(lines) if len(sites.get(x.strip(" \t\r"), ())) < least or first[x.strip(" \t\r")] == (doc_id, at)]
        out.append((doc_id, "\n".join(kept) if text else text, *rest))
    return out


def test_every_pipeline_stage_against_plain_python(spark, plain, tmp_path):
    import corpus_pipeline

    rows = [(i, f"{t}\nsubscribe to our letter\nline {i % 40}", lang, f"s{i % 14}", 0) for i, t, lang, _, _ in prose(160)]
    rows += [(500, rows[3][1], "en", "s1", 0), (501, rows[3][1], "en", "s2", 0), (502, rows[5][1].replace("the ", "the the ", 1), "en", "s3", 0), (600, "12 34", "en", "s1", 0), (601, None, None, None, None), (602, "", "en", "s1", 0)]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash", "mixing", "packing"]
    extra = [F.lit("x").alias(c) for c in ("fp", "root", "score", "lang_pred", "block", "order", "start", "n_tokens", "node")]
    docs = spark.createDataFrame(rows, DOC)
    as_rows = lambda df: sorted((tuple(r)[:4] for r in df.collect()), key=repr)

    kept = stages["language_id"](spark, docs, "")
    letters = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    assert as_rows(kept) == sorted((tuple(r[:4]) for r in letters), key=repr)

    lined = stages["line_dedup"](spark, kept, "")
    want = naive_lines(letters)
    assert as_rows(lined) == sorted((tuple(r[:4]) for r in want), key=repr)
    assert sum("subscribe" in (r[1] or "") for r in want) == 1
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = stages["simhash"](spark, lined, "").collect()
    prints = {r[0]: naive_fingerprint(r[1]) for r in want}
    group = naive_groups(set(prints.values()))
    heads = {}
    for i, f in prints.items():
        heads[group[f]] = min(i, heads.get(group[f], i))
    assert sorted(r.doc_id for r in single) == sorted(heads.values()) and len(single) < len(want)

    one = spark.createDataFrame(single, DOC)
    mixed = stages["mixing"](spark, one, "").collect()
    uses = Counter(r.doc_id for r in mixed)
    assert set(uses) == {r.doc_id for r in single} and max(uses.values()) <= 2

    packed = stages["packing"](spark, spark.createDataFrame(mixed, DOC), "").collect()
    texts = {r.doc_id: r.text for r in single}
    total = Counter()
    for p in packed:
        assert p.ids_crc32 == crc(ids_of(plain, texts[p.doc_id])[p.start : p.start + p.length])
        total[p.doc_id] += p.length
    assert total == {i: n * len(ids_of(plain, texts[i])) for i, n in uses.items()}

    now, none = docs.select("*", *extra), docs.select("*", *extra).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now, none = stage(spark, now, ""), stage(spark, none, "")
        assert now.columns == none.columns and none.count() == 0 and now.count() > 0
        assert name == "packing" or now.columns == [*docs.columns, "fp", "root", "score", "lang_pred", "block", "order", "start", "n_tokens", "node"]

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert whole == Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in packed)


def test_simhash_long_and_tied_texts():
    for text in ("a b c d e f g h " * 40_000, "one two three", "", None, "\t\n", "A a A a A", "x" * 100_000):
        assert simhash.fingerprint(text) == naive_fingerprint(text)
