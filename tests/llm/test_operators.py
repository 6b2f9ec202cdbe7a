"""The operators of the training-data subpackage: awkward rows, brute force, round trips and held-out accuracy."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrolith.llm import ann, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, packing, quality, simhash, token_output
from ferrolith.llm.graph import _step, connected_components
from ferrolith.llm.tokens import END_ID, default_tokenizer, encoder

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n ", "en", "a", 5), (4, "one two three four five", "en", "a", 23), (4, "one two three four five", "en", "a", 23),
    (4, "another text under the same id", "en", "b", 30), (None, "no id at all", "en", "c", 12), (5, "12 34 !!", "en", "a", 8), (6, "été à la plage avec <|endoftext|> 日本語 ﬁ", "fr", "d", 40), (7, "w" * 5000 + " x", "en", None, 5002), (8, "long " * 20000, "en", "e", 100000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOC)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns whose names operators might use."""
    return docs.select("*", *[F.lit("x").alias(c) for c in ("fp", "node", "root", "score", "block", "salt", "first", "lang_pred", "row", "start", "order", "n_tokens", "line", "bucket")])


def prose(n, seed=0):
    rng = np.random.default_rng(seed)
    words = {"en": "the and river house walks under bright winter morning with old stone bridge".split(), "fr": "le la maison rivière sous avec matin hiver pont vieux et chemin blanc".split()}
    return [(i, " ".join(rng.choice(words["en" if i % 2 else "fr"], 30)), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(n)]


def test_token_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(default_tokenizer())
    token_output.write_tokens(docs, str(tmp_path / "t"), encoding="delta")
    rows = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda x: (x is not None, x or 0))
    assert rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    want = sorted(tuple([*plain.encode(r[1] or "", add_special_tokens=False).ids, END_ID]) for r in AWKWARD)
    assert sorted(tuple(r["ids"]) for r in rows) == want
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in token_output.token_digest(token_output.read_tokens(spark, str(tmp_path / "t"))).collect()}
    assert all(digest[r.doc_id, r.start] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) for r in rows)


def test_packing_covers_every_id(clashing):
    pieces = packing.pack_documents(clashing, longest=64, with_ids=True).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 64 and p.offset == 0 and len(p["ids"]) == p.length for p in pieces)
    words = encoder()
    assert sum(p.length for p in pieces) == sum(len(words.encode(r[1])) // 4 + 1 for r in AWKWARD)
    assert [p.length for p in pieces if p.doc_id == 2] == [1]
    with pytest.raises(ValueError):
        packing.pack_documents(clashing, longest=100)
    text, size = packing.binary_lengths(np.array([4096 * 2 + 5, 1, 4096]))
    assert text.tolist() == [0, 0, 0, 0, 1, 2] and size.tolist() == [4096, 4096, 4, 1, 1, 4096]


def test_line_dedup_against_brute_force(spark, clashing):
    rows = [(i, f"own {i}\nshared\n\nshared \r\nfew{i % 2}", "en", f"s{i % 12}", 0) for i in range(40)] + [r for r in AWKWARD]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOC), min_sites=10, removed="gone").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.text and r.text.startswith("own"):
            i = int(r.text.split("\n")[0][4:])
            assert r.text == (f"own {i}\nshared\n\nfew0" if i == 0 else f"own {i}\n\nfew{i % 2}") and r.gone == (1 if i == 0 else 2)
    assert sorted(str(r.text) for r in line_dedup.dedup_lines(clashing).collect()) == sorted(str(r[1]) for r in AWKWARD)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOC)).count() == 0


def test_simhash_against_brute_force(spark, clashing):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["red", "blue", "green", "stone", "river", "cloud", "hill"], 200)) for _ in range(20)]
    texts = [*base, *base[:5], *[t.replace("red", "rot", 1) for t in base], None, "", "one", "one two"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        root = [min(root[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts))]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: (prints[i], root[i]) for i in range(len(texts))}
    assert sorted(r.doc_id for r in simhash.keep_one(rows).collect()) == sorted(set(root))
    assert simhash.near_duplicates(clashing).count() == len(AWKWARD)
    assert simhash.keep_one(clashing).columns == clashing.columns
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_simhash_cells_are_never_broadcast(spark):
    grouped = spark.range(2_000).select(F.xxhash64("id").alias("fp")).withColumn("comp", F.col("fp"))
    pairs = simhash.pairs_across(grouped, simhash.GROUPS)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 0  # and not after the sizes are known
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_are_never_broadcast(spark):
    """What grows with the documents stays off the driver, before and after sizes are known; Spark's own choice would be broadcasts here."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat_ws("-", F.col("id"), F.lit(i)), 256) for i in range(9)]).alias("text"))
    found = simhash.near_duplicates(rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan(found)
    assert found.count() == 300 and "BroadcastExchange" not in plan(found)
    step = _step(spark.createDataFrame([(2, 1), (3, 2)], "a bigint, b bigint"), large=True)
    assert "BroadcastExchange" not in plan(step) and sorted(map(tuple, step.collect())) == [(2, 1), (3, 1)]
    assert re.search(r"SortMergeJoin[^\n]*LeftSemi", plan(simhash.keep_one(rows)))


def test_keep_one_keeps_each_group_of_a_shared_id(spark, docs):
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(t for i, t in kept if i == 4) == ["another text under the same id", "one two three four five"]
    # a group's smallest id also stands for another group, whose text comes first
    rows = spark.createDataFrame([(1, "a b c d e f g"), (1, "z y x w v u t"), (2, "z y x w v u t"), (3, "z y x w v u t"), (None, "k l m n o p q"), (None, "k l m n o p q"), (None, "a b c d e f g")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(rows).collect()), key=str)
    assert got == [(1, "a b c d e f g"), (1, "z y x w v u t"), (None, "k l m n o p q")]


def test_embedding_bounds_distance():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (int(x) for x in rng.integers(0, 1 << 63, 2))
        counts = lambda v: [(v >> 2 * s & 1) + (v >> 2 * s + 1 & 1) for s in range(32)]
        assert sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True)) <= (a ^ b).bit_count()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}


def test_language_id(spark, clashing):
    rows = spark.createDataFrame(prose(200), DOC)
    model = language_id.train(rows.where("doc_id < 150"))
    got = language_id.identify(rows.where("doc_id >= 150"), model).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "fr") and r.score > 0.9 for r in got)
    mixed = language_id.mixtures(["the river house walks under bright winter morning le la maison sous avec matin hiver pont et chemin"], model)[0][0]
    assert 0.2 < mixed[0] < 0.8
    awkward = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(clashing, model).collect()}
    assert awkward[1] == awkward[2] == awkward[5] == ("und", 0.0)
    assert language_id.keep_identified(clashing, model).columns == clashing.columns
    empty = language_id.train(rows.limit(0))
    assert {r.lang_pred for r in language_id.identify(rows, empty).collect()} == {"und"}


def test_documents_of_many_languages_stay(spark):
    words = {"en": "the river house walks under bright morning", "fr": "le chemin maison rivière sous avec pont", "de": "der fluss und das haus geht unter", "fi": "joki talo kulkee kirkkaan aamun yli silta"}
    rng = np.random.default_rng(5)
    say = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    model = language_id.train(spark.createDataFrame([(i, say(x, 40), x, "s", 0) for x in words for i in range(40)], DOC))
    three, four = " ".join(say(x, 30) for x in ("en", "fr", "de")), " ".join(say(x, 30) for x in words)
    rows = spark.createDataFrame([(1, three, None, "s", 0), (2, four, None, "s", 0), (3, "12 34 !!", None, "s", 0), (4, None, None, "s", 0)], DOC)
    assert max(r.score for r in language_id.identify(rows, model).collect()) < 0.5
    assert sorted(r.doc_id for r in language_id.keep_identified(rows, model).collect()) == [1, 2]
    assert (language_id.mixtures([four], model)[0][0] > 0.15).all()


def test_quality(spark, clashing):
    good, bad = "A clear sentence ends here. Another follows it.".split(), "BUY now!!! click click FREE $$$ now!!!".split()
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(good if i % 2 else bad, 40))) for i in range(300)], "doc_id bigint, text string")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    weights = quality.train(rows, labels.where("doc_id < 200"), shards=2)
    got = {r.doc_id: r.score for r in quality.score_documents(rows.where("doc_id >= 200"), weights).collect()}
    assert min(s for i, s in got.items() if i % 2) > max(s for i, s in got.items() if not i % 2)
    assert quality.score_documents(clashing, weights).where("score between 0 and 1").count() == len(AWKWARD)
    none = quality.train(rows, labels.limit(0), shards=2)
    assert {r.score for r in quality.score_documents(rows, none).collect()} == {0.5}


def test_lm_against_base_and_brute_force(spark, clashing):
    rows = spark.createDataFrame(prose(400), DOC)
    training = rows.where("doc_id < 300")
    words = lm_scoring.count_words(training)
    model = lm_scoring.train(training, words)
    got = lm_scoring.score_documents(rows, model, words).collect()
    counts = {}
    for r in prose(400)[:300]:
        for t in [*r[1].split(), None]:
            counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*prose(400)[r.doc_id][1].split(), None]
        assert r.n_tokens == len(tokens) and r.n_known == sum(t in counts for t in tokens) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens))
    assert sum(r.score for r in got if r.doc_id >= 300) > sum(r.base_score for r in got if r.doc_id >= 300)
    # all leaves of a context, and so all words, have probability one
    leaf = np.arange(lm_scoring.LEAVES)
    tokens, starts = np.full(len(leaf), lm_scoring.END), np.arange(len(leaf) + 1)
    assert np.exp(lm_scoring.leaf_log_prob(tokens, starts, leaf, model)).sum() == pytest.approx(1, abs=1e-3)
    awkward = lm_scoring.score_documents(clashing, model, words).collect()
    assert len(awkward) == len(AWKWARD) and all(np.isfinite(r.score) for r in awkward)
    none = lm_scoring.count_words(rows.limit(0))
    empty = lm_scoring.score_documents(rows.limit(3), lm_scoring.train(rows.limit(0), none), none).collect()
    assert all(r.score == pytest.approx(r.base_score) for r in empty)


def test_lm_gradient_runs_over_all_tokens(spark, monkeypatch):
    rows = spark.createDataFrame(prose(7000), DOC)
    training, held = rows.where("doc_id < 6900"), rows.where("doc_id >= 6900")
    words = lm_scoring.count_words(training)
    seen, fit, summed = [], lm_scoring.fit_weights, lm_scoring._summed
    monkeypatch.setattr(lm_scoring, "_summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    model = lm_scoring.train(training, words)
    tokens = 6900 * 31
    assert tokens > 200_000 and len(seen) == 2 + lm_scoring.ROUNDS
    # every token has a row of every template in the counts
    assert (seen[1].reshape(len(lm_scoring.TEMPLATES), -1).sum(axis=1) == tokens).all()
    # what a round expects less what it meets: rows that are met often, and probabilities, add up to nothing
    for table in seen[2:]:
        assert np.abs(table.sum(axis=1)).max() < 0.01 * tokens and np.abs(table).sum() > 0
    monkeypatch.setattr(lm_scoring, "fit_weights", lambda *a: fit(*a, rounds=0))
    start = lm_scoring.train(training, words)
    met = seen[1] > 100
    assert (model.hashed[met] != start.hashed[met]).all()
    total = lambda m: sum(r.score for r in lm_scoring.score_documents(held, m, words).collect())
    assert total(model) > total(start)


def test_lm_rare_words_beyond_the_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"common w{i} w{i // 2}") for i in range(60)], "doc_id bigint, text string")
    words = lm_scoring.count_words(rows)
    whole = {r.doc_id: r for r in lm_scoring.score_documents(rows, lm_scoring.train(rows, words), words).collect()}
    monkeypatch.setattr(lm_scoring, "TOP_WORDS", 20)
    few = {r.doc_id: r for r in lm_scoring.score_documents(rows, lm_scoring.train(rows, words), words).collect()}
    assert all(few[i].n_known == whole[i].n_known and few[i].base_score == pytest.approx(whole[i].base_score) for i in whole)


def test_mixing(spark, clashing):
    counts = lambda d: spark.createDataFrame(list(d.items()), "source string, tokens bigint")
    mixture = mixing.solve(counts({"a": 900, "b": 90, "c": 10, None: 0}), max_repeats=2.0)
    found = mixture.sources.collect()
    assert sum(r.weight for r in found) == pytest.approx(1) and max(r.passes for r in found) == pytest.approx(2.0, rel=1e-6)
    entropy = mixing.solve(counts({"a": 900, "b": 90, "c": 10}), target_entropy=0.8)
    weights = [r.weight for r in entropy.sources.collect()]
    assert -sum(w * np.log(w) for w in weights) / np.log(3) == pytest.approx(0.8, abs=1e-6)
    fixed = mixing.solve(counts({"a": 900, "b": 90, "c": 10}), budget=500.0)
    assert fixed.budget == 500 and max(r.passes for r in fixed.sources.collect()) == pytest.approx(2.0, rel=1e-6)
    rows = spark.createDataFrame([(i, "word " * 10, "en", "big" if i % 4 else "small", 0) for i in range(400)], DOC)
    used = {r.doc_id: r.n for r in mixing.mix_documents(rows).groupBy("doc_id").agg(F.count("text").alias("n")).collect()}
    assert set(used) == set(range(400)) and max(used.values()) == 2
    out = mixing.mix_documents(clashing)
    assert out.columns == clashing.columns and out.count() >= len(AWKWARD)
    assert mixing.mix_documents(rows.limit(0)).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, n=300, dim=8):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.normal(scale=0.1, size=(n - n // 2, dim)).astype(np.float32)
    x[40:60] = x[40]
    odd = [(1000, None, 0), (1001, [0.0] * dim, 0), (1002, [float("nan")] * dim, 0), (1003, [None] * dim, 0), (1004, [1.0] * (dim + 1), 0), (None, [1.0] * dim, 0), (1005, [1.0] * dim, None), (1006, [float("inf")] * dim, 0), (1007, [], 0)]
    return x, spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + odd, VECTORS).withColumn("score", F.lit("x"))


def test_ann_recall(spark):
    x, rows = vectors(spark)
    got = ann.search(ann.build_index(rows, shard_rows=120), rows.where("vec_id % 20 = 0"), k=10).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for q in range(0, 300, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:10]
        hits, total = hits + len(set(want) & set(found[q])), total + 10
    assert hits / total >= 0.9
    assert not {1000, 1001, 1002, 1003, 1006, 1007} & set(found)
    assert ann.search(ann.build_index(rows.limit(0)), rows.limit(0)).count() == 0


@pytest.mark.parametrize(("cell_rows", "block"), [(10_000, 2048), (40, 16)])
def test_embedding_links_against_brute_force(spark, cell_rows, block):
    x, rows = vectors(spark)
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(rows, cell_rows=cell_rows, block=block).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 3 == np.arange(300)[None] % 3)
    np.fill_diagonal(link, False)
    comp = np.arange(300)
    for _ in range(300):
        comp = np.minimum(comp, np.where(link, comp[None], 300).min(axis=1))
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1008))
    assert embedding_dedup.link_vectors(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "clusters", "spread"), [(400, 8, 0.1), (1500, 40, 0.07), (1500, 3, 0.2)])
def test_clustered_embeddings_against_brute_force(spark, n, clusters, spread):
    """Groups of real links, of several sizes, with exact copies and repeated ids; cells of forty vectors."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, 16)) * rng.uniform(0.2, 3, (n, 1))
    x[n - 10 :] = x[:10]
    ids, labels = np.arange(n), rng.integers(0, 3, n)
    ids[n - 5 :] = ids[:5]
    rows = spark.createDataFrame([(int(i), [float(v) for v in e], f"l{c}") for i, e, c in zip(ids, x, labels, strict=True)], "vec_id bigint, embedding array<double>, label string").repartition(5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(link, False)
    assert link.sum() > n
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None], n).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    wanted = sorted((int(i), int(k), int(c), bool(i == c)) for i, k, c in zip(ids, link.sum(axis=1), comp, strict=True))
    found = embedding_dedup.link_vectors(rows, cell_rows=40, block=64).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == wanted


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = spark.createDataFrame(prose(120) + AWKWARD, DOC)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "")
        assert out.columns == docs.columns, name
        now = out
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0
