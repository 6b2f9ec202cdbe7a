"""The folder source and writer, and streams: files as they come, late events, and a cache that answers once."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ferrolith.operators.caching import stored_data
from ferrolith.sources.files import FolderReader, FolderStream, read_folder, register, write_folder
from ferrolith.sources.resources import listed_objects, read_resources, whole_files
from ferrolith.sources.sinks import write_document_files
from ferrolith.streaming.caching import answered_once
from ferrolith.streaming.pages import event_windows, read_pages


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    for name, data in {"a.json": b'{"id": 1}', "b.json": b'{"id": ', "c.json": b"[1]", "d.json": b"\xff{}", "e.txt": b"{}", "f.json": b""}.items():
        (base / name).write_bytes(data)
    (base / "below.json").mkdir()
    return base


def names(rows):
    return {os.path.basename(r.path): r.error for r in rows}


def test_folder_source(spark, folder):
    found = read_folder(spark, f"file://{folder}").collect()
    assert names(found) == {"a.json": None, "b.json": "not JSON", "c.json": "not an object", "d.json": "not UTF-8", "f.json": "not JSON"}
    assert {r.value for r in found if r.error is None} == {'{"id": 1}'} and {r.scheme for r in found} == {"file"}
    missing = read_folder(spark, str(folder / "none")).collect()
    assert [r.error for r in missing] == ["not found"]


def test_filters_reach_the_listing(spark, folder):
    rows = read_folder(spark, str(folder))
    near = rows.where(F.col("path").startswith(f"{folder}/b") & (F.length("value") > 0))
    assert names(near.collect()) == {"b.json": "not JSON"}
    assert rows.where("scheme = 's3'").count() == 0 and rows.where(F.col("path").isin(f"{folder}/a.json", f"{folder}/c.json")).count() == 2
    reader = FolderReader(str(folder), ".json")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = [*reader.pushFilters([EqualTo(("path",), f"{folder}/a.json"), GreaterThan(("length",), 3)])]
    assert len(left) == 1 and [p.paths for p in reader.partitions()] == [[f"{folder}/a.json"]]


def test_partitions_are_bounded(folder, monkeypatch):
    monkeypatch.setattr("ferrolith.sources.files.PART_BYTES", 10)
    assert [len(p.paths) for p in FolderReader(str(folder), ".json").partitions()] == [1, 2, 2]


def test_one_file_for_each_document(spark, tmp_path):
    docs = spark.range(0, 300, 1, 6).select(F.format_string("n%d.json", "id").alias("name"), F.concat(F.lit('{"id":"é'), "id", F.lit('"}')).alias("value"))
    write_folder(docs, str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 300 and (tmp_path / "out" / "n7.json").read_text() == '{"id":"é7"}'
    assert read_folder(spark, str(tmp_path / "out")).where("error is null").count() == 300
    with pytest.raises(PySparkException):
        write_folder(docs, str(tmp_path / "out"))
    write_folder(docs.limit(3), str(tmp_path / "out"), overwrite=True)
    assert len(os.listdir(tmp_path / "out")) == 3
    write_folder(docs.limit(0), str(tmp_path / "empty"))
    assert os.listdir(tmp_path / "empty") == []


def test_documents_of_one_name_get_files_of_their_own(spark, tmp_path):
    docs = spark.range(0, 760, 1, 3).select("id", F.when(F.col("id") < 730, "same").when(F.col("id") < 740, "twice").otherwise(F.concat(F.lit("n"), "id")).alias("stem"), F.when(F.col("id") < 730, "01").otherwise(F.col("id").cast("string")).alias("month"), F.lit("é").alias("title")).withColumnRenamed("id", "doc_id")
    write_document_files(docs, str(tmp_path / "out"), "doc_id", "stem", "month")
    found = set(os.listdir(tmp_path / "out"))
    assert len(found) == 760 and {"same_01a.json", "same_01z.json", "same_01aa.json", "same_01zz.json", "same_01703.json", "twice_735.json", "n745.json"} <= found
    assert (tmp_path / "out" / "n745.json").read_text() == '{\n  "title" : "é"\n}'


@pytest.mark.parametrize("wrong", ["raise_error('broken')", "''", "'a/b'", "'n1.json'"])
def test_nothing_is_left_of_a_failed_write(spark, tmp_path, wrong):
    docs = spark.range(0, 40, 1, 4).select(F.expr(f"case when id = 33 then {wrong} else concat('n', id, '.json') end").cast("string").alias("name"), F.lit("{}").alias("value"))
    with pytest.raises(PySparkException):
        write_folder(docs, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


def test_a_task_that_runs_again_writes_nothing_twice(tmp_path):
    from pyspark.sql.types import Row

    from ferrolith.sources.files import FolderWriter

    writer = FolderWriter(str(tmp_path / "out"), False)
    rows = [Row(name=f"n{i}", value=str(i)) for i in range(5)]

    def broken():
        yield from rows[:3]
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writer.write(broken())
    done = [writer.write(iter(rows[:3])), writer.write(iter(rows[3:]))]
    writer.commit(done)
    assert sorted(os.listdir(tmp_path / "out")) == [f"n{i}" for i in range(5)] and os.listdir(tmp_path) == ["out"]


def collected(stream, spark, name, tmp_path):
    """Everything there is now, in append mode; a later call goes on from the checkpoint."""
    started = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
    started.awaitTermination(120)
    return spark.table(name).collect()


def test_folder_stream(spark, folder, tmp_path):
    register(spark)
    stream = spark.readStream.format("resource_files").load(str(folder))
    out = str(tmp_path / "seen")

    def run():
        started = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        started.processAllAvailable()
        started.stop()
        return sorted(os.path.basename(r.path) for r in spark.read.parquet(out).collect())

    assert run() == ["a.json", "b.json", "c.json", "d.json", "f.json"]
    (folder / "g.json").write_text("{}")
    assert run() == ["a.json", "b.json", "c.json", "d.json", "f.json", "g.json"]


def test_page_stream(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.cl/x", "<html lang='es-AR'><p>Hola</p></html>"), (2, "https://b.uk/", "<nav>menu</nav><p>Hi</p>")], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    rows = collected(read_pages(spark, str(tmp_path / "pages"), pages.schema), spark, "page_stream", tmp_path)
    assert sorted((r.page_id, r.country, r.text) for r in rows) == [(1, "AR", "Hola"), (2, "GB", "Hi")]


def test_late_events_are_not_waited_for(spark, tmp_path):
    base, schema = datetime(2026, 1, 1), "ts timestamp, event_type string, value double"
    source = tmp_path / "events"
    write = lambda hours: spark.createDataFrame([(base + timedelta(hours=h), "a", 1.0) for h in hours], schema).coalesce(1).write.mode("append").parquet(str(source))
    found = {}
    for hours in ([0.1, 0.2, 1.5], [9.0], [0.3, 9.1], [20.0]):
        write(hours)
        stream = event_windows(spark.readStream.schema(schema).parquet(str(source)))
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        out.awaitTermination(120)
        found = {r.start.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {0: 2, 1: 1, 9: 2}  # the event of 0:18 came after the watermark had passed its window


def test_a_cache_calls_once_and_forgets_in_time(spark, tmp_path):
    base = datetime(2026, 1, 1)
    schema = "key string, kind string, id string, payload string, tokens bigint, ts timestamp"
    source, out = tmp_path / "events", str(tmp_path / "out")

    def run(*events):
        rows = [(k, kind, i, p, t, base + timedelta(minutes=m)) for k, kind, i, p, t, m in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = answered_once(spark.readStream.schema(schema).parquet(str(source)), ttl=timedelta(minutes=60))
        started = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        started.awaitTermination(120)  # each run is a restart from the checkpoint
        return {(r.id, r.outcome): (r.version, r.payload, r.tokens) for r in spark.read.parquet(out).collect()}

    run(("k", "request", "a", None, 0, 0), ("k", "request", "b", None, 0, 1), ("m", "request", "c", None, 0, 1))
    found = run(("k", "request", "d", None, 0, 2), ("k", "answer", "a", "yes", 9, 3), ("k", "request", "e", None, 0, 4))
    assert found["a", "call"] == (1, None, 0) and found["b", "wait"] == (1, None, 0) and found["d", "wait"] == (1, None, 0)
    assert found["a", "answer"] == (1, "yes", 9) and found["e", "hit"] == (1, "yes", 0) and found["c", "call"] == (1, None, 0)
    found = run(("k", "request", "f", None, 0, 62), ("k", "request", "g", None, 0, 64), ("m", "request", "h", None, 0, 30))
    assert found["f", "hit"] == (1, "yes", 0)
    assert found["g", "call"] == (2, None, 0)  # the answer had expired
    assert found["h", "call"] == (2, None, 0)  # the first call was never answered


def test_stored_answers_of_both_shapes(spark):
    rows = [('{"data": {"a": 1}, "usage": {}}', '{"a":1}'), ('{"a": 1}', '{"a": 1}'), ('{"data": 1}', '{"data": 1}'), ("no json", "no json"), (None, None), ("[1]", "[1]")]
    found = spark.createDataFrame(rows, "payload string, want string").select(stored_data(F.col("payload")).alias("got"), "want").collect()
    assert [r.got for r in found] == [r.want for r in found]


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.json").write_text(f'{{"title": "{i}"}}')
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for files in (listed_objects(spark, str(tmp_path)), whole_files(spark, str(tmp_path)), read_resources(spark, str(tmp_path))):
        assert files.count() == 400 and files.rdd.getNumPartitions() <= most


@pytest.mark.parametrize("parts", [0, 7])
def test_tasks_list_what_a_folder_holds(spark, tmp_path, parts):
    docs = spark.range(0, 60, 1, 3).select(F.format_string("n%d.json", "id").alias("name"), F.concat(F.lit('{"title":"'), "id", F.lit('"}')).alias("value"))
    folder = str(tmp_path / "o%20 t")
    write_folder(docs, folder, parts=parts)
    (tmp_path / "o%20 t" / "below").mkdir()
    (tmp_path / "o%20 t" / "below" / "n60.json").write_text("{}")
    for files in (whole_files(spark, folder), listed_objects(spark, f"file://{folder}"), read_resources(spark, folder)):
        assert files.inputFiles() == []  # the driver knows of none
        assert {os.path.basename(r.path) for r in files.select("path").collect()} == {f"n{i}.json" for i in range(60)}
    assert {r.title for r in read_resources(spark, folder).collect()} == {str(i) for i in range(60)}
    rows = read_folder(spark, folder)
    assert {r.name for r in rows.where("error is null").collect()} == {f"n{i}.json" for i in range(60)}
    assert {r.name for r in rows.where("name like 'n1%' and scheme = 'file'").collect()} == {"n1.json", *(f"n1{i}.json" for i in range(10))}
    assert sum(len(p.paths) for p in FolderReader(folder, ".json").partitions()) == (0 if parts else 60)
    assert sum(len(p.paths) for p in FolderStream(folder, ".json").partitions({"time": -1, "path": ""}, FolderStream(folder, ".json").latestOffset())) == 60


@pytest.mark.parametrize("wrong", ["raise_error('broken')", "'n1.json'"])
def test_nothing_is_left_of_a_failed_write_in_parts(spark, tmp_path, wrong):
    docs = spark.range(0, 40, 1, 4).select(F.expr(f"case when id = 33 then {wrong} else concat('n', id, '.json') end").cast("string").alias("name"), F.lit("{}").alias("value"))
    with pytest.raises(PySparkException):
        write_folder(docs, str(tmp_path / "out"), parts=5)
    assert os.listdir(tmp_path) == []


def test_whole_files_are_as_in_spark(spark, tmp_path):
    for name, data in {"a.json": b"{}", "b c%20é+[1]{x}#?;.json": b"\xff", "_h.json": b"{}", "_h=1.json": b"{}", ".h.json": b"{}", "e.json": b"", "g.json.gz": b"x", "k.json._COPYING_": b"{}"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "below.json").mkdir()
    key = lambda files: sorted(map(tuple, files.collect()))
    found = key(whole_files(spark, str(tmp_path)))
    assert len(found) == 4 and found == key(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {r.path for r in read_resources(spark, str(tmp_path)).collect()} == {r.path for r in read_resources(spark, f"{tmp_path}/*.json").collect()}


def test_whole_files_in_parts_are_as_in_spark(spark, tmp_path):
    docs = spark.range(0, 40).select(F.format_string("n%d.json", "id").alias("name"), F.col("id").cast("string").alias("value"))
    write_folder(docs, str(tmp_path / "out"), parts=3)
    own = spark.read.format("binaryFile").load(str(tmp_path / "out")).drop("part")
    assert sorted(map(tuple, whole_files(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, own.collect()))
