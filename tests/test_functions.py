"""Small tables of inputs and outcomes for column functions and operators."""

import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrolith.functions import identifiers, names, values, web
from ferrolith.operators import caching, matching, merging, ranking, resolution, validation
from ferrolith.operators.caching import cache_key
from ferrolith.plans import document
from ferrolith.plans.crosswalks import croissant, datacite, dataverse, resource_type
from ferrolith.plans.records import records_of
from ferrolith.sources.resources import coerced_list, json_of, parse_resources, read_resources


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("name", "want"), [("  ACME, Inc. ", "acme"), ("Min. de Salud", "ministerio de salud"), ("U.S. Agency", "us agency"), ("Depto. de Física", "departamento de fisica"), ("a-b_c", "a-b_c"), ("", ""), (None, None)])
def test_normalize_org(spark, name, want):
    assert one(spark, names.normalize_org(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("isni", "want"), [("000000012146438X", True), ("0000000121464381", False), ("0000 0001 2146 438X", False), ("", False), (None, False), ("abc", False)])
def test_check_digit(spark, isni, want):
    assert one(spark, identifiers.check_digit_ok(F.lit(isni).cast("string"))) is want


@pytest.mark.parametrize(("scheme", "value", "want"), [("ORCID", "https://orcid.org/0000-0002-1825-0097", True), ("ORCID", "0000-0002-1825-0098", False), ("ROR", "https://ror.org/02ap3w078", True), ("ROR", "02ap3w078", False), ("DOI", "https://doi.org/10.5880/x", True), ("DOI", "10.5/x", False), ("ISNI", "0000 0001 2146 438X", True), ("LOCAL", "?", True)])
def test_pid_formats(spark, scheme, value, want):
    assert one(spark, identifiers.pid_format_ok(F.lit(scheme), F.lit(value))) is want


@pytest.mark.parametrize(("html", "url", "want"), [
    ('<html lang="es-CL">', "https://x.com", "CL"), ('<html lang="es">', "https://x.gob.cl/a", "CL"), ('<meta name="geo.region" content="AR-B">', None, "AR"), ("", "https://user@host.co.uk:80/", "GB"),
    ('<meta content="pt_BR" property="og:locale"><html lang="es-CL">', "", "BR"), (None, "not a url", None), ("", "https://x.io", None),
])
def test_country(spark, html, url, want):
    assert one(spark, web.country(F.lit(html).cast("string"), F.lit(url).cast("string"))) == want


def test_page_text_keeps_long_forms_and_drops_chrome():
    long = "word " * 60
    assert web.page_text(f"<nav>menu</nav><form>{long}</form><form>search</form>").strip() == long.strip()
    assert "menu" not in web.page_text(f"<main>{long}<nav>menu</nav></main><p>rest</p>")
    assert "rest" not in web.page_text(f"<main>{long}</main><p>rest</p>")
    assert web.page_text("<p>short</p><main>x</main>") == "shortx"
    assert web.page_text(None) is None
    assert "tail" in web.page_text(f"<form>{long} tail")


def test_values(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, values.jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, values.jaccard(arr(), F.lit(None).cast("array<string>"))) == 1.0
    assert one(spark, values.recall_or_absent(arr(), arr("x"))) == 0.0
    assert one(spark, values.date_from_parts(F.array(F.lit(2020), F.lit(3)))) == "2020-03"
    assert one(spark, names.citation(*[F.lit(x) for x in ("T", "13", "2", "66", "73", "", "", "")])) == "T, 13(2), 66-73."
    assert one(spark, names.citation(*[F.lit("")] * 8)) == ""


@pytest.mark.parametrize(("a", "b", "least"), [("university of chile", "university of chile", 100), ("chile university of", "university of chile", 90), ("harvard", "harvard university", 85)])
def test_weighted_ratio(a, b, least):
    assert matching.weighted_ratio(a, b) >= least
    assert matching.weighted_ratio("abc", "xyz") < 50
    assert matching.weighted_ratio("", "x") == 0


def test_best_two_with_gap(spark):
    rows = spark.createDataFrame([(1, 1, 97.0, "CL"), (1, 2, 95.0, "CL"), (2, 1, 99.0, "AR"), (3, 1, 100.0, "CL"), (3, 2, 81.0, None), (4, 1, 60.0, None)], "q int, c int, score double, country string").withColumn("hint", F.lit("CL"))
    got = {r.q: (r.c, r.adjusted, r.status) for r in matching.best_two_with_gap(rows, "q", "c", country="country", hint="hint").collect()}
    assert got == {1: (1, 97.0, "review"), 2: (1, 84.0, "nomatch"), 3: (1, 100.0, "auto")}


def test_resolution_with_overrides(spark):
    registry = spark.createDataFrame([(1, "Universidad de Chile", "CL"), (2, "Universidad de Chillan", "CL"), (3, "Acme Corp", "US")], "entry_id int, name string, country string")
    asked = spark.createDataFrame([("Univ. de Chile", "CL"), ("ACME", None), ("Nowhere", None), ("", None), (None, "CL")], "name string, country string")
    overrides = spark.createDataFrame([("acme", None, 3)], "name_key string, country string, entry_id int")
    got = {r.name: (r.entry_id, r.status, r.via) for r in matching.resolve_organisations(asked, registry, overrides).collect()}
    assert got["ACME"] == (3, "auto", "override")
    assert got["Univ. de Chile"][0] == 1
    assert got["Nowhere"][:2] == (None, "nomatch")
    assert len(got) == 5


def test_few_texts_are_python_s_at_once(monkeypatch):
    texts = pa.array(["é" * 50_000, None, "ﬁn", "", *["Ångström " * 1_000] * 200])
    wanted = ["e" * 50_000, None, "fin", "", *["Angstrom " * 1_000] * 200]
    seen = []
    plain = pa.array
    monkeypatch.setattr(names.pa, "array", lambda values, *a: seen.append(sum(map(len, filter(None, values)))) or plain(values, *a))
    assert names._folded(texts).to_pylist() == wanted
    assert max(seen) <= names.FOLDED_AT_ONCE + 50_000 and names._folded(texts.slice(2, 2)).to_pylist() == ["fin", ""] and names._folded(texts.slice(0, 0)).to_pylist() == []


def test_names_that_equal_an_entry_need_no_candidates(spark, monkeypatch):
    names = ["acme data", "acme dat", "north lab", "nord lab", "observatory of the southern seas", "observatory of the southern sea", "zeta", "zeta", "supplier 000000001", "supplier 000000002", "plain name"]
    registry = spark.createDataFrame([(i, n, "NO" if n == "nord lab" else None if i % 2 else "CL") for i, n in enumerate(names)], "entry_id int, name string, country string")
    asked = spark.createDataFrame([(n.upper(), c) for n in names for c in ("CL", "NO", None)], "name string, country string")
    naive = {}
    entries = registry.collect()
    for name, country in asked.distinct().collect():
        adjusted = sorted((15.0 * (country is not None and e.country not in (None, country)) - matching.weighted_ratio(name.lower(), e.name), e.entry_id) for e in entries)
        if adjusted[0][0] == -100:
            naive[name, country] = (adjusted[0][1], "auto" if adjusted[1][0] - adjusted[0][0] >= 5 else "review")
    assert {v[1] for v in naive.values()} == {"auto", "review"} and len(naive) < asked.distinct().count()
    compared = []
    whole = matching.scored_candidates
    monkeypatch.setattr(matching, "scored_candidates", lambda names, *a: compared.append(names) or whole(names, *a))
    got = {(r.name, r.country): (r.entry_id, r.status) for r in matching.resolve_organisations(asked, registry).where("score = 100").collect()}
    assert got == naive
    assert compared[0].count() == asked.distinct().count() - len(naive)


def test_waves_report_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcx"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c")], "node string, needs string")
    assert {r.node: r.wave for r in ranking.waves(nodes, edges).collect()} == {"a": 0, "b": None, "c": None, "x": 0}


def test_apportion_and_spearman(spark):
    strata = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 0)], "s string, n bigint")
    seats = {r.s: r.seats for r in ranking.apportion(strata, "s", "n", 6).collect()}
    assert sum(seats.values()) == 6 and all(seats[k] <= n for k, n in (("a", 5), ("b", 3), ("c", 1), ("d", 0)))
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 15)], "a int, b int")
    assert ranking.spearman(rows, "a", "b").first().rho == pytest.approx(0.5)
    assert ranking.spearman(rows.withColumn("b", F.lit(1)), "a", "b").first().rho is None
    assert ranking.spearman(rows.limit(0), "a", "b").first().rho is None


def test_merge_kinds(spark):
    item = "array<struct<key:string,value:string>>"
    rows = spark.createDataFrame([
        (1, 1, "l", "list", None, [(None, "x")], None), (1, 2, "l", "list", None, [(None, "y")], None), (1, 1, "d", "dict", None, [("k", ""), ("m", "1")], None), (1, 2, "d", "dict", None, [("k", "v"), ("m", "2")], None),
        (1, 1, "s", "scalar", "old", None, None), (1, 2, "s", "scalar", "new", None, None), (1, 3, "s", "scalar", "bad", None, "failed"), (2, 1, "s", "scalar", None, None, None),
    ], f"resource int, ord int, field string, kind string, value string, items {item}, error string")
    got = {r.field: (r.value, [tuple(x) for x in r["items"]] if r["items"] else None) for r in merging.merge_fields(rows).collect()}
    assert got == {"l": (None, [(None, "x"), (None, "y")]), "d": (None, [("k", "v"), ("m", "1")]), "s": ("new", None)}


def test_cache_and_upsert(spark):
    cache = spark.createDataFrame([("a", "v", "2100-01-01"), ("b", None, "2100-01-01"), ("c", "v", "2000-01-01")], "key string, value string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    hits, misses = caching.cached(spark.createDataFrame([(k,) for k in "abcd"], "key string"), cache, F.current_timestamp())
    assert {(r.key, r.is_negative) for r in hits.collect()} == {("a", False), ("b", True)}
    assert {r.key for r in misses.collect()} == {"c", "d"}


def test_resources_from_files(spark, tmp_path):
    for name, text in (("a.json", '{"url": "u", "publisher": "p"}'), ("b.json", "[1]"), ("c.json", "{bad"), ("d.txt", "{}")):
        (tmp_path / name).write_text(text)
    got = [(r.path.rsplit("/", 1)[1], r.url, r.error) for r in read_resources(spark, str(tmp_path)).sort("path").collect()]
    assert got == [("a.json", "u", None), ("b.json", None, "not an object"), ("c.json", None, "not JSON")]
    assert [r.error for r in read_resources(spark, str(tmp_path / "none")).collect()] == ["not found"]
    assert parse_resources(spark.createDataFrame([("{}", "x")], "value string, path string")).first().error is None
    assert one(spark, F.schema_of_variant(json_of(F.lit('say ```{"a": 1}``` so')))) == "OBJECT<a: BIGINT>"
    assert one(spark, coerced_list(F.lit('["a"]'), "array<string>")) == ["a"]
    assert one(spark, coerced_list(F.lit('{"a": 1}'), "array<string>")) is None


def test_projections_never_fail_on_blanks(spark):
    docs = spark.createDataFrame([(0, None, None, None), (1, "", "", ""), (2, "x", "en", "s")], "doc_id bigint, text string, lang string, source string")
    records = records_of(docs)
    empty = records.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in records.dtypes if c != "doc_id"])
    for make in (datacite, croissant, dataverse):
        assert len(make(records.unionByName(empty)).collect()) == 6
    assert len(document.shape_results(document.envelope(empty, "2026-01-01")).collect()) > 3
    assert one(spark, resource_type(F.lit("strange"))) == "Dataset"
    assert one(spark, resource_type(F.lit("http://x"))) == ""


def test_preflight_and_leaks(spark):
    errors, warnings = validation.preflight(F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.lit(""))
    assert one(spark, F.size(errors)) == 1 and one(spark, F.size(warnings)) == 0
    assert one(spark, validation.keys_outside(F.lit('{"a":1,"b":2}'), ["a"])) == ["b"]
    rows = spark.createDataFrame([("m", 1, "p"), ("m", 2, "q"), ("m", 1, "r")], "model string, workers int, provider string")
    assert [(r.name_a, r.name_b) for r in validation.disagreeing(rows, "model", "workers", "provider").collect()] == [("p", "q")]


def test_candidates_against_brute_force(spark):
    """Typing errors, words in another order, parts of names, and a phrase that half of the registry has."""
    rng = random.Random(5)
    syllables = "ba ke lo mi nu ra se ti vo wa xe yo zu fa go hi".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    keys = [f"university of {word()}" if i % 2 else f"{word()} {rng.choice(['institute', 'agency'])} {word()}" for i in range(150)]

    def altered(name):
        i, kind = rng.randrange(len(name)), rng.randrange(6)
        if kind < 3:
            return name[:i] + ("", rng.choice("qx"), name[i] + "j")[kind] + name[i + 1 :]
        return (" ".join(reversed(name.split())), name.split()[-1], f"{name} {word()[:2]}")[kind - 3]

    asked = sorted({altered(k) for k in keys} | {"", "a", "日本大学", *keys[:5]})
    keys += ["日本大學", "chile chile", ""]
    asked += ["chile peru"]
    names, registry = spark.createDataFrame([(n,) for n in asked], "name_key string"), spark.createDataFrame(list(enumerate(keys)), "entry_id bigint, entry_key string")
    found = [(r.name_key, r.entry_id) for r in matching.candidates(names, registry).collect()]
    assert len(found) == len(set(found)) < len(asked) * len(keys) / 10
    wanted = {(n, i) for n in asked for i, k in enumerate(keys) if len(n) > 1 and matching.weighted_ratio(n, k) >= 90}
    assert len(wanted) > 150 and wanted <= set(found)
    with pytest.raises(ValueError):
        matching.candidates(names, registry, threshold=80)


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "abc"), ("abc", "abc"), ("universidad de chile", "univ chile"), ("aaaa", "aa"), ("日本", "本日")])
def test_ratio_against_the_usual_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert matching._ratio(a, b) == pytest.approx(200 * table[-1][-1] / (len(a) + len(b)))


def test_tiers(spark):
    """A doubted pick stays, or gives way to a sure match only; what is cached, also as nothing, asks no registry; ties of the second registry are for review."""
    text = "string"
    names = spark.createDataFrame([("Acme Labs", "cl"), ("Beta Works", "AR"), ("Gamma", None), ("Delta House", None), ("", "CL"), (None, None), ("Zeta", "")], "name string, country string")
    registry = spark.createDataFrame([("r1", "i1", "Acme Labs", "US"), ("r2", None, "Acme Labs", "CL"), ("r3", "i3", "Beta Works", "US")], "ror_id string, isni_id string, name string, country string")
    second = spark.createDataFrame([("s1", "Acme Labs"), ("s4", "Delta House"), ("s5", "Delta Houses")], "isni_id string, name string")
    overrides = spark.createDataFrame([("gamma", None, "o1", None)], "name_key string, country string, ror_id string, isni_id string")
    key = spark.range(1).select(cache_key(F.lit("org"), F.lit("zeta"), F.lit(""))).first()[0]
    cache = spark.createDataFrame([(key, datetime(2100, 1, 1), None, None, None, None, None)], f"cache_key {text}, expires_at timestamp, ror_id {text}, isni_id {text}, confidence double, status {text}, via {text}")
    picks = spark.createDataFrame([("Acme Labs", "r1"), ("Beta Works", "r3")], "name string, ror_id string")
    done = resolution.resolve_in_tiers(names, registry, second, overrides, cache, picks, F.lit("2020-01-01").cast("timestamp")).persist()
    got = {r.name: (r.ror_id, r.isni_id, r.confidence, r.status, r.via) for r in done.collect()}
    assert got["Acme Labs"] == ("r2", "s1", 1.0, "auto", "query+second")
    assert got["Beta Works"] == ("r3", "i3", 0.5, "review", "affiliation")
    assert got["Gamma"] == ("o1", None, 1.0, "auto", "override")
    assert got["Delta House"][1] == "s4" and got["Delta House"][3:] == ("review", "second")
    assert got["Zeta"][:4] == (None, None, None, "nomatch") and got["Zeta"][4] == "cache"
    assert got[""][3] == got[None][3] == "nomatch"
    stored = resolution.to_cache(done, F.lit("2030-01-01").cast("timestamp"))
    assert sorted(r.status or "" for r in stored.collect()) == ["auto", "review", "review"]
    again = resolution.resolve_in_tiers(names, registry.limit(0), second.limit(0), overrides, stored.select(*cache.columns), picks.limit(0), F.lit("2020-01-01").cast("timestamp"))
    assert {r.name: r.ror_id for r in again.collect()}["Acme Labs"] == "r2"
