"""Line dedup: remove boilerplate lines that spread over many sites.

A line is what stands between line feeds, compared after trimming spaces, tabs and carriage returns. For each
line hash a HyperLogLog sketch of its sites is built in every map task and the sketches are merged by
aggregation. A line whose estimate is clear of the threshold is decided by it; a line within the sketch's error
band of the threshold gets an exact count of distinct sites. Of a line that reaches ``min_sites`` sites the first
occurrence in the corpus (smallest doc_id, then position) stays and all others go, so no text is lost outright.

Only DataFrame functions run here. Line text never meets a shuffle: hashes, ids and positions do, and then each
text once, when the positions to drop are joined to it. A line's two hashes (64 and 32 bits) stand for it.

Defined cases: a null text stays null and an empty one empty, with no lines; blank lines are never boilerplate; a
null site counts for no spread, but its lines are removed like others; equal doc_ids with equal texts are one document (all its rows
change alike), with different texts they are different documents; a null doc_id counts as the smallest; an empty
table stays empty; other columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.llm.common import TMP, materialize

#: Parameters of production: distinct sites that make a line boilerplate, and the sketch's log2 size.
MIN_SITES = 10
SKETCH_LOG2 = 12
#: Half-width of the exact band, in standard errors of the sketch.
BAND_ERRORS = 6.0

H1, H2, SITE, POS, KEY, DOC = (f"{TMP}{x}" for x in ("h1", "h2", "site", "pos", "key", "doc"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_occurrences(docs: DataFrame, text: str, site: str, doc_id: str) -> DataFrame:
    """One row for each line that is not blank: its hashes, site, document and position."""
    hashed = F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(F.trim(x, F.lit(" \t\r"))).alias("a"), F.hash(F.trim(x, F.lit(" \t\r"))).alias("b"), (F.trim(x, F.lit(" \t\r")) != "").alias("full")))
    rows = docs.where(F.col(text) != "").select(F.col(doc_id).alias(DOC), F.xxhash64(text).alias(KEY), F.col(site).alias(SITE), F.posexplode(hashed).alias(POS, "line"))
    return rows.where("line.full").select(F.col("line.a").alias(H1), F.col("line.b").alias(H2), SITE, DOC, KEY, POS)


def boilerplate_lines(occurrences: DataFrame, min_sites: int = MIN_SITES, sketch_log2: int = SKETCH_LOG2) -> DataFrame:
    """Lines on ``min_sites`` or more distinct sites: hashes, first occurrence and number of sites (estimated beyond the band)."""
    error = 1.04 / 2 ** (sketch_log2 / 2)
    low, high = min_sites * (1 - BAND_ERRORS * error) - 0.5, min_sites * (1 + BAND_ERRORS * error) + 0.5
    first = F.min(F.struct(DOC, KEY, POS)).alias("first")
    sketched = occurrences.groupBy(H1, H2).agg(F.hll_sketch_agg(F.col(SITE).cast("string"), F.lit(sketch_log2)).alias("sketch"), first)
    spread = sketched.select(H1, H2, "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low)
    spread = materialize(spread, "line-spread")
    sure, near = spread.where(F.col("sites") > high), spread.where(F.col("sites") <= high)
    # exact: distinct sites of the near lines; duplicates fall out in the map tasks, before any hot line is shuffled
    pairs = occurrences.where(F.col(SITE).isNotNull()).select(H1, H2, F.col(SITE).cast("string").alias(SITE)).distinct()
    counted = pairs.join(near.select(H1, H2), [H1, H2], "left_semi").groupBy(H1, H2).agg(F.count(SITE).alias("exact"))
    exact = near.join(counted.where(F.col("exact") >= min_sites), [H1, H2]).select(H1, H2, "first", F.col("exact").alias("sites"))
    return sure.unionByName(exact)


def _without(lines: Column, positions: Column) -> Column:
    """``lines`` without those at the ascending ``positions``: the runs between them, joined again."""
    before = F.concat(F.array(F.lit(-1)), positions)
    after = F.concat(positions, F.array(F.size(lines)))
    runs = F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.array_join(F.flatten(runs), "\n")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", doc_id: str = "doc_id", sketch_log2: int = SKETCH_LOG2, removed: str | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; ``removed`` names a column for how many went."""
    occurrences = line_occurrences(docs, text, site, doc_id)
    # the lines to remove are dealt over salted keys, so that one that fills a third of the rows meets many tasks
    salts = 16
    lines = materialize(boilerplate_lines(occurrences, min_sites, sketch_log2), "boilerplate").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = occurrences.withColumn("salt", F.pmod(F.hash(KEY, POS), F.lit(salts))).join(lines, [H1, H2, "salt"])
    later = ~F.struct(DOC, KEY, POS).eqNullSafe(F.struct(F.col(f"first.{DOC}").alias(DOC), F.col(f"first.{KEY}").alias(KEY), F.col(f"first.{POS}").alias(POS)))
    drop = found.where(later).groupBy(DOC, KEY).agg(F.array_sort(F.collect_set(POS)).alias(POS))
    keyed = docs.withColumn(KEY, F.when(F.col(text) != "", F.xxhash64(text)))
    joined = keyed.join(drop.withColumnsRenamed({KEY: f"{KEY}2"}), keyed[doc_id].eqNullSafe(F.col(DOC)) & (F.col(KEY) == F.col(f"{KEY}2")), "left")
    cleaned = F.when(F.col(POS).isNull(), F.col(text)).otherwise(_without(_lines(F.col(text)), F.col(POS)))
    out = joined.withColumn(text, cleaned)
    if removed:
        out = out.withColumn(removed, F.coalesce(F.size(POS), F.lit(0)).cast("long"))
    return out.select(*docs.columns, *([removed] if removed and removed not in docs.columns else []))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without boilerplate lines, and how many went: doc_id, text, n_removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs, removed="n_removed").select("doc_id", "text", "n_removed")


OP1_SQL = """
with docs as (select doc_id, text, source from documents),
occ as (
  select doc_id, source, u.pos, trim(u.line, ' ' || chr(9) || chr(13)) as line
  from docs, unnest(string_split(text, chr(10))) with ordinality as u(line, pos)
  where text <> ''
),
bad as (
  select line, min((doc_id, pos)) as first
  from occ where line <> '' group by line having count(distinct source) >= 10
),
del as (select distinct o.doc_id, o.pos from occ o join bad b using (line) where (o.doc_id, o.pos) <> b.first),
kept as (
  select d.doc_id, u.pos, u.line from docs d, unnest(string_split(d.text, chr(10))) with ordinality as u(line, pos)
  where d.text <> ''
),
whole as (
  select k.doc_id, string_agg(k.line, chr(10) order by k.pos) filter (where x.pos is null) as text, count(x.pos) as n_removed
  from kept k left join del x on k.doc_id = x.doc_id and k.pos = x.pos group by k.doc_id
)
select d.doc_id, case when d.text is null or d.text = '' then d.text else coalesce(w.text, '') end as text, cast(coalesce(w.n_removed, 0) as bigint) as n_removed
from docs d left join whole w on d.doc_id = w.doc_id
"""
