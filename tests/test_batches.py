"""Page reading, walks, shapes, curation, configuration and the row pipeline on awkward rows."""

import json
import time

import pytest
from hypothesis import given
from hypothesis import settings as hyp_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrolith.functions import shapes, web
from ferrolith.operators import curation, evaluation, ranking, settings, validation
from ferrolith.plans.row_pipeline import run_batch
from ferrolith.sources.resources import closed_errors, id_pairs, walk
from ferrolith.sources.sinks import markdown_table

LONG = "Real article text of some length. " * 10


@pytest.mark.parametrize(
    ("html", "has", "lacks"),
    [
        (f"<div>menu</div><article>{LONG}</article><div>links</div>", ["Real article"], ["menu", "links"]),
        ("<div><p>one</p><p>two</p></div>", ["one", "two"], []),
        (f"<main>Hi</main><div>{LONG}</div>", ["Hi", "Real article"], []),
        (f"<form><input/><label>Search</label></form><div>{LONG}</div>", ["Real article"], ["Search"]),
        (f"<form>{LONG}</form>", ["Real article"], []),
        (f"<form><nav>menu</nav>{LONG}</form>", ["Real article"], ["menu"]),
        (f"<p>outside</p><main><form>{LONG}</form></main>", ["Real article"], ["outside"]),
        (f"<p>outside</p><form><main>{LONG}</main></form>", ["Real article"], ["outside"]),
        (f"<p>outside</p><form><form><main>{LONG}</main></form>tail</form>", ["Real article", "tail"], ["outside"]),
        (f"<form>short</form><form>{LONG}<form>inner</form> after", ["Real article", "after"], ["inner", "short"]),
        (f"<form>never closed {LONG}", ["never closed"], []),
        (f"<script>var x</script><SVG/><p>{LONG}&amp; more &eacute;</p></nav></form>", ["& more é"], ["var x"]),
        ("", [], []),
        ("<main><p>Unclosed<div>badly</main>", ["Unclosed", "badly"], []),
    ],
)
def test_page_text(html, has, lacks):
    text = web.page_text(html)
    assert all(x in text for x in has) and not any(x in text for x in lacks)


def test_page_text_falls_back_on_parser_errors(monkeypatch):
    assert web.page_text(None) is None
    monkeypatch.setattr(web, "_Events", lambda html: 1 / 0)
    assert web.page_text("<nav>menu</nav>kept<SCRIPT>x</SCRIPT>") == " kept "


def test_walks_reach_any_depth(spark):
    deep = {"value": "top", "scheme": "DOI"}
    for i in range(30):
        deep = {"k": [deep, i]}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "not json"), (3, None), (4, "[]")], "key bigint, json string")
    found = id_pairs(rows, "key", "json").collect()
    assert [(r.key, r.scheme, r.value) for r in found] == [(1, "DOI", "top")] and found[0].path.count("k[0]") == 30
    leaks = validation.leaks(rows, "key", "json", ["k"], ["scheme"]).collect()
    assert [(r.key, r.name) for r in leaks] == [(1, "scheme")]


def test_walks_have_no_limit(spark):
    """Over a million nodes, and a text 900 levels deep."""
    many = spark.range(0, 12_000, 1, 8).select(F.col("id").alias("key"), F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(i.alias("value"), F.lit("x").alias("scheme"))).alias("k"))).alias("json"))
    assert walk(many, "key", "json").count() == 12_000 * (2 + 30 * 3)
    deep = "[" * 900 + '{"value": "v", "scheme": "DOI"}' + "]" * 900
    rows = spark.createDataFrame([(1, deep), (2, "[" * 200_000), (3, '{"a": 1, "a": 2}'), (4, "NaN"), (5, '{"é.x": {"scheme": "ROR", "value": "r"}, "n": [null, true, 1.5]}')], "key bigint, json string")
    assert [(r.key, r.path.count("[0]")) for r in id_pairs(rows, "key", "json").orderBy("key").collect()] == [(1, 900), (5, 0)]
    kinds = {r.path: (r.kind, r.value, r.parent) for r in walk(rows.where("key > 1"), "key", "json").collect()}
    assert kinds["n[0]"] == ("null", None, "n") and kinds["n[1]"] == ("boolean", "true", "n") and kinds["n[2]"] == ("number", "1.5", "n") and kinds["é.x.scheme"] == ("string", "ROR", "é.x")


def test_closed_configuration(spark):
    declared = [("llm", "object", True), ("llm.model", "string", True), ("llm.retries", "number", False), ("agents", "array", False), ("agents[]", "object", False), ("agents[].name", "string", True)]
    texts = {
        1: {"llm": {"model": "m"}, "agents": [{"name": "a"}]}, 2: {"llm": {"model": 3, "modle": "m"}, "agents": [{}, {"name": "b", "extra": {"deep": 1}}]}, 3: {"agents": {}},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [(4, "  "), (5, None), (6, "[1]"), (7, "{")], "key bigint, json string")
    found = sorted((r.key, r.path, r.error) for r in closed_errors(rows, "key", "json", declared).collect())
    assert found == [
        (2, "agents[0].name", "missing"), (2, "agents[1].extra", "unknown"), (2, "llm.model", "not a string"), (2, "llm.modle", "unknown"), (3, "agents", "not a array"), (3, "llm", "missing"),
        (4, "", "empty"), (5, "", "empty"), (6, "", "not a JSON object"), (7, "", "not a JSON object"),
    ]


def naive_page(events):
    """The rule of the page reader, form by form, from the innermost out."""
    leaves, opened, depth, around = [], [], dict.fromkeys(("chrome", "main"), 0), ()
    for what, value in events:
        group = "chrome" if value in web.CHROME else "main" if value in web.MAIN else None
        if what == "text":
            if not depth["chrome"]:
                leaves.append((value, depth["main"] > 0, around))
        elif group:
            depth[group] = max(0, depth[group] + (1 if what == "open" else -1))
        elif what == "open" and value == "form":
            around += (len(opened),)
            opened.append(depth["main"] > 0)
        elif value == "form":
            around = around[:-1]
    kept = set(range(len(leaves)))
    for form in reversed(range(len(opened))):
        own = [i for i in sorted(kept) if form in leaves[i][2]]
        if len("".join(leaves[i][0] for i in own).strip()) < web.LEAST_TEXT:
            kept -= set(own)
    rest = [leaves[i] for i in sorted(kept)]
    of_main = {forms[0] for _, main, forms in rest if forms and (main or any(opened[f] for f in forms))}
    main = "".join(t for t, inside, forms in rest if (forms[0] in of_main if forms else inside))
    return main if len(main.strip()) >= web.LEAST_TEXT else "".join(t for t, _, _ in rest)


@given(st.lists(st.one_of(st.sampled_from([(w, t) for w in ("open", "close") for t in ("form", "form", "main", "nav", "p")]), st.tuples(st.just("text"), st.sampled_from(["x" * 90, " " * 120, "short ", "y " * 70, ""]))), max_size=40))
@hyp_settings(max_examples=300, deadline=None)
def test_page_reader_against_the_naive_rule(events):
    assert web._select(events) == naive_page(events)


def test_pages_of_many_forms_take_linear_time():
    began = time.time()
    assert web.page_text("<form>x" * 100_000).strip("x") == ""
    assert web.page_text("<form>" * 50_000 + LONG + "</form>" * 50_000).strip() == LONG.strip()
    assert time.time() - began < 5


def test_variables_are_bounded(spark):
    variables, rows = spark.createDataFrame([("A", "1"), ("B", None)], "name string, value string"), spark.createDataFrame([("${A}-${B}-${C}-$",)], "t string")
    assert settings.expand_variables(F.col("t"), variables, rows, "out").first().out == "1---$"
    with pytest.raises(ValueError):
        settings.expand_variables(F.col("t"), variables, rows, "out", most=1)


def test_disagreement_and_waves(spark):
    rows = spark.createDataFrame([("m", 1, "p"), ("m", 2, "q"), ("m", 3, "r"), ("m", 1, "s"), ("n", 1, "t"), ("m", None, "u")], "model string, workers int, provider string")
    pairs = validation.disagreeing(rows, "model", "workers", "provider").collect()
    assert sorted((r.name_a, r.name_b) for r in pairs) == [("p", "q"), ("p", "r"), ("q", "r")]
    layers = spark.createDataFrame([(f"n{i}{j}",) for i in range(6) for j in range(4)], "node string")
    edges = spark.createDataFrame([(f"n{i}{j}", f"n{i - 1}{k}") for i in range(1, 6) for j in range(4) for k in range(4)] + [("n00", "missing")], "node string, needs string")
    waves = {r.node: r.wave for r in ranking.waves(layers, edges).collect()}
    assert waves["n01"] == 0 and waves["n00"] is None and waves["n13"] is None
    fine = {r.node: r.wave for r in ranking.waves(layers, edges.where("needs <> 'missing'")).collect()}
    assert all(fine[f"n{i}{j}"] == i for i in range(6) for j in range(4))


def test_ranks_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])], "k int, v double")
    got = {r.k: r.r for r in ranking.average_ranks(rows, "v", "r").collect()}
    assert got == {0: 4.0, 1: 1.0, 2: 4.0, 3: None, 4: 2.0, 5: 4.0}
    assert ranking.average_ranks(rows.limit(0), "v", "r").count() == 0
    drawn = spark.createDataFrame([(k, "s", k, 2) for k in range(1, 5)], "key int, stratum string, place int, seats int")
    assert sorted(r.key for r in ranking.redraw(drawn, drawn.where("key = 1"), "stratum", "key").collect()) == [2, 3]


def test_shapes_of_nothing(spark):
    rows = spark.createDataFrame([(x,) for x in ("null", "5", '""', "[]", "{}", "[null, {}]", "bad")], "j string").withColumn("v", F.try_parse_json("j"))
    columns = [shapes.type_label(F.col("v")), F.size(shapes.list_items(F.col("v"))), shapes.as_string(F.col("v")), F.size(shapes.as_strings(F.col("v"))), F.size(shapes.as_objects(F.col("v"))), shapes.as_object(F.col("v"))]
    got = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    assert all(None not in tuple(r) for r in got)
    assert [r.c4 for r in got] == [0] * 7 and got[1].c2 == "5" and {r.c5 for r in got} == {"{}"}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(shapes.duration(F.lit(75))) == "1m 15s" and one(shapes.duration(F.lit(5.25))) == "5.3s"
    assert one(shapes.display(F.array().cast("array<string>"))) == "(empty)" and one(shapes.display(F.array(F.lit("b"), F.lit("a")))) == "a, b"
    assert one(evaluation.without_ignored(F.lit("{bad"))) == "{bad" and one(evaluation.overlap_score(F.lit("{bad"), F.lit("{}"))) == 0


def test_overrides_as_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    entries = [(1, "Univ. de Chile", "cl", "r1", ""), (2, "Univ. de Chile", "CL ", "r2", None), (3, " ", None, "r3", None), (4, 'Quoted "name": x', None, None, "i4"), (5, "No id", None, "", ""), (6, None, "CL", "r6", "i6")]
    found = curation.load_overrides(spark.createDataFrame(entries, "n int, name string, country string, ror_id string, isni_id string"), "n")
    assert sorted((r.name_key, r.country, r.ror_id, r.isni_id) for r in found.collect()) == [("quoted name x", None, None, "i4"), ("universidad de chile", "CL", "r2", None)]
    curation.write_overrides_yaml(found, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert sorted(e["name"] for e in yaml.safe_load(text)["overrides"]) == ['Quoted "name": x', "Univ. de Chile"]
    curation.write_review_csv(found.select("name", "ror_id"), str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")


def test_settings_with_nothing(spark):
    agents = spark.createDataFrame([("a", "p", "m"), ("b", "q", "m")], "agent string, provider string, model string")
    none = spark.createDataFrame([], "agent string, provider string, model string")
    providers = spark.createDataFrame([("p", "K"), ("q", None)], "provider string, env string")
    assert sorted(map(tuple, settings.apply_overrides(agents, none, providers).collect())) == sorted(map(tuple, agents.collect()))
    assert [tuple(r) for r in settings.missing_keys(agents, providers, spark.createDataFrame([], "name string, value string")).collect()] == [("p", "K", ["a"])]


def test_batch_of_failures(spark):
    resources = spark.createDataFrame([("a", "https://x", "Office", None), ("b", None, None, "not JSON"), ("c", "", "", None)], "resource string, url string, publisher string, error string")
    results = spark.createDataFrame([("a", 0, "c", "name", "scalar", "A name", None, None), ("c", 0, "c", "name", "scalar", None, None, "boom")], "resource string, ord int, call string, field string, kind string, value string, items array<struct<key:string,value:string>>, error string")
    works = spark.createDataFrame([], "doi string, title string, authors array<string>, publisher string, issued string")
    organisations = spark.createDataFrame([("Office", "ROR", "r1", "auto"), ("Office", "ROR", "r2", "review")], "name string, scheme string, value string, status string")
    people = spark.createDataFrame([], "given string, family string, value string, status string")
    got = {r.resource: r for r in run_batch(resources, results, works, organisations, people, "2026-01-01").collect()}
    assert {k: (r.status, r.error) for k, r in got.items()} == {"a": ("ok", None), "b": ("failed", "not read: not JSON"), "c": ("failed", "boom")}
    assert got["a"].publisher.id_value == "r1" and got["a"].creator[0].id_value == "r1" and "identifier" in got["a"].missing
    empty = run_batch(resources.limit(0), results.limit(0), works, organisations, people, "2026-01-01")
    assert empty.count() == 0


def test_long_tables_are_errors(spark):
    assert markdown_table(spark.range(2)).count("\n") == 4
    with pytest.raises(ValueError):
        markdown_table(spark.range(3), most=2)


def test_files_and_exports(spark, tmp_path):
    from ferrolith.sources.resources import listed_objects
    from ferrolith.sources.sinks import append_results, json_schema, write_with_export

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"xy")
    (tmp_path / "in" / "folder_mark").write_bytes(b"")
    assert [(r.length, bytes(r.content)) for r in listed_objects(spark, f"file://{tmp_path}/in").collect()] == [(2, b"xy")]

    docs = spark.createDataFrame([(1, "n")], "doc_id bigint, name string")
    assert write_with_export(docs, docs, f"file://{tmp_path}/o", "doc_id") is None
    (tmp_path / "p" / "export").mkdir(parents=True)
    warning = write_with_export(docs, docs, f"file://{tmp_path}/p", "doc_id")
    assert warning.startswith("export failed") and spark.read.text(f"file://{tmp_path}/p/documents").count() == 1

    results = f"file://{tmp_path}/results"
    for model, score in (("a", 1), ("b", 2), ("a", 3)):
        append_results(spark.createDataFrame([(model, score)], "model string, score int"), results, "model")
    assert sorted(tuple(r) for r in spark.read.parquet(results).select("model", "score").collect()) == [("a", 3), ("b", 2)]

    made = json_schema(spark.sql("select 1L as n, array(named_struct('s', 'x', 'd', 1d)) as xs").schema)
    assert made["properties"]["n"] == {"type": "integer"}
    assert made["properties"]["xs"]["items"]["properties"] == {"s": {"type": "string"}, "d": {"type": "number"}}


def test_ancestors_of_a_cycle(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], "node string, needs string")
    assert sorted(tuple(r) for r in settings.ancestors(needs).collect()) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "a"), ("c", "b")]
    assert settings.ancestors(needs.limit(0)).count() == 0
