"""Entity resolution: blocked candidates, scores, the best two with a gap, overrides and combined matches.

Names are resolved once for the whole batch: the outcome depends on the name and the country only. Candidates are found by
a set-similarity join over letter pairs that loses no pair over the threshold (``candidates``), and only they are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ferrolith.functions.names import normalize_org
from ferrolith.operators.storage import settle

THRESHOLD, GAP, COUNTRY_PENALTY, WINDOW = 90.0, 5.0, 15.0, 10.0


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """Likeness of two strings, 0 to 100, by edit distance; all in generated code."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))))


def _ratio(a: str, b: str) -> float:
    """Normalised similarity by the longest common subsequence, 0 to 100: its row of the usual table is kept as the bits of one number."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every = rest = (1 << len(a)) - 1
    for y in b:
        same = rest & at.get(y, 0)
        rest = (rest + same | rest - same) & every
    return 200.0 * (len(a) - rest.bit_count()) / (len(a) + len(b))


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with an equally long part of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()}
    return max(_ratio(short, long[s : s + len(short)]) for s in starts)


def weighted_ratio(a: str, b: str) -> float:
    """A likeness of names, 0 to 100, that forgives word order and, at a discount, missing words."""
    if not a or not b:
        return 0.0
    whole, lengths = _ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    scale = 1.0 if lengths < 1.5 else 0.9 if lengths < 8 else 0.6
    if " " not in a and " " not in b:  # words have no order, and nothing in common but all
        return whole if lengths < 1.5 else max(whole, scale * _partial(a, b))
    by_order = lambda s: " ".join(sorted(s.split()))
    x, y = set(a.split()), set(b.split())
    common, rest_a, rest_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    joined_a, joined_b = f"{common} {rest_a}".strip(), f"{common} {rest_b}".strip()
    token_set = 100.0 if common and (not rest_a or not rest_b) else max(_ratio(joined_a, joined_b), _ratio(common, joined_a) if common else 0, _ratio(common, joined_b) if common else 0)
    if lengths < 1.5:
        return max(whole, 0.95 * _ratio(by_order(a), by_order(b)), 0.95 * token_set)
    return max(whole, scale * _partial(a, b), 0.95 * scale * max(_partial(by_order(a), by_order(b)), 100.0 if common else 0.0))


@F.pandas_udf(DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """``weighted_ratio`` over Arrow batches; it sees blocked candidates only."""
    return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def best_two_with_gap(scored: DataFrame, query: str, order: str, score: str = "score", country: str | None = None, hint: str | None = None, threshold: float = THRESHOLD, gap: float = GAP, penalty: float = COUNTRY_PENALTY) -> DataFrame:
    """One row for each query: its best candidate and a status.

    Candidates below ``threshold`` less a margin fall out by their raw score; a known other country then costs
    ``penalty``. The best below ``threshold``: nomatch. A second within ``gap`` of it: review. Else: auto.
    Ties go to the smaller ``order``.
    """
    near = scored.where(F.col(score) >= threshold - WINDOW)
    cost = F.when(F.col(hint).isNotNull() & F.col(country).isNotNull() & (F.upper(hint) != F.upper(country)), penalty).otherwise(0.0) if country and hint else F.lit(0.0)
    adjusted = near.withColumn("adjusted", F.col(score) - cost)
    window = Window.partitionBy(query).orderBy(F.desc("adjusted"), order)
    ranked = adjusted.withColumns({"place": F.row_number().over(window), "second": F.lead("adjusted").over(window)}).where(F.col("place") == 1)
    status = F.when(F.col("adjusted") < threshold, "nomatch").when(F.col("second").isNull() | (F.col("adjusted") - F.col("second") >= gap), "auto").otherwise("review")
    return ranked.withColumn("status", status).drop("place", "second")


def letter_pairs(key: Column) -> Column:
    """The distinct pairs of neighbouring characters of a name between two spaces, each as a number: word order hardly matters to them."""
    codes = F.transform(F.filter(F.split(F.concat(F.lit(" "), key, F.lit(" ")), ""), lambda c: c != ""), F.ascii)
    heads = F.slice(codes, F.lit(1), F.size(codes) - 1)
    return F.array_distinct(F.transform(heads, lambda c, i: c.cast("bigint") * (1 << 21) + F.get(codes, i + 1)))


def letters(key: Column) -> Column:
    """The characters of a name, each with how often it stood before, as numbers: what two names share of them bounds their common subsequence."""
    codes = F.array_sort(F.transform(F.filter(F.split(key, ""), lambda c: c != ""), F.ascii))
    return F.transform(codes, lambda c, i: (i - F.array_position(codes, c) + 1).cast("bigint") * (1 << 21) + c)


def alike(a: Column, b: Column, x: Column, y: Column, shared_letters: Column, threshold: float = THRESHOLD) -> Column:
    """Whether ``weighted_ratio`` of names a and b, of letter pairs x and y, can reach ``threshold``: names of like length are few edits apart,
    or the one with fewer pairs shares nearly all of them with the other, in whatever order the words are; of others, the shorter is part of the
    longer, at most eight times as long."""
    few, many = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    lost = F.least(F.size(x), F.size(y)) - F.size(F.array_intersect(x, y))
    edits = F.floor((F.length(a) + F.length(b)) * F.lit(round(1 - threshold / 100, 9)))
    apart = F.length(a) + F.length(b) - 2 * shared_letters
    close = (lost <= F.floor(few * F.lit(lost_share(threshold)))) & (apart <= edits) & (F.levenshtein(a, b) <= edits)
    shared = (lost <= F.floor(few * F.lit(lost_share(100 * threshold / 95))) + 1) | close  # likeness of words in any order counts 95 of 100
    part = F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
    return F.when(many < 1.5 * few, shared).otherwise((many < 8 * few) & part)


def lost_share(threshold: float) -> float:
    """Letter pairs that a name can lose, for each of its characters, while its likeness stays at ``threshold``.

    A likeness of t allows (1 - t) insertions and deletions for each character of both names; of two names of one
    length half are deletions, which cost two pairs each, and half insertions, which cost one.
    """
    return round(3 * (1 - threshold / 100), 9)


def candidates(names: DataFrame, registry: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of (name_key, entry_id, entry_key) that are ``alike``: every pair whose ``weighted_ratio`` reaches ``threshold`` is among them.

    ``names`` has name_key; ``registry`` has entry_id, entry_key; both keys are normalised names; empty ones meet nothing, and names of one
    character are found inside longer ones only as words. Thresholds must be over 85.5, where any shared word would do.

    A set-similarity join with prefix filtering: letter pairs are put in order of rarity over all names; a name that may lose n of its
    pairs shares one of its n + 1 rarest with each of its partners, so only these are looked up, among all pairs
    of names that have as many or more. What meets is checked in generated code. Work follows the rare pairs, not
    a word that half of the registry has.
    """
    if threshold <= 85.5:
        raise ValueError("candidates cover likenesses over 85.5")
    sides = [df.select(F.col(c).alias("key")).where(F.col("key") != "").distinct() for df, c in ((names, "name_key"), (registry, "entry_key"))]
    held = [df.select("key", F.explode(letter_pairs(F.col("key"))).alias("pair")) for df in sides]
    often = held[0].unionByName(held[1]).groupBy("pair").agg(F.count(F.lit(1)).alias("often"))
    by_rarity = F.transform(F.array_sort(F.collect_list(F.struct("often", "pair"))), lambda x: x["pair"])
    ranked = [h.join(often, "pair").groupBy("key").agg(by_rarity.alias("pairs")) for h in held]
    least = (F.greatest(F.floor(F.length("key") * F.lit(lost_share(threshold))), F.floor(F.length("key") * F.lit(lost_share(100 * threshold / 95))) + 1, F.lit(2)) + 1).cast("int")
    # few rows become many below: spread over all tasks by number, which adaptive execution leaves as it is
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = [r.select("key", "pairs", F.slice("pairs", F.lit(1), least).alias("few"), letters(F.col("key")).alias("letters")).repartition(tasks) for r in ranked]
    under = lambda df, c, p: df.select(F.col("key").alias(f"{p}_key"), F.col("pairs").alias(p), F.col("few").alias(f"{p}_few"), F.col("letters").alias(f"{p}_letters"), F.posexplode(c).alias(f"{p}_rank", f"{p}_pair"))
    in_length = F.greatest(F.length("a_key"), F.length("b_key")) < 8 * F.least(F.length("a_key"), F.length("b_key"))
    like = F.greatest(F.length("a_key"), F.length("b_key")) < 1.5 * F.least(F.length("a_key"), F.length("b_key"))
    met = []
    for looked_up, in_all, order in (("a", "b", F.size("a") <= F.size("b")), ("b", "a", F.size("a") > F.size("b"))):
        sets = {looked_up: under(few["ab".index(looked_up)], "few", looked_up), in_all: under(few["ab".index(in_all)], "pairs", in_all)}
        # of names of like length, the longer shares one of its rarest, too
        early = ~like | (F.col(f"{in_all}_rank") <= F.size(in_all) - F.size(looked_up) + F.size(f"{looked_up}_few"))
        # each pair of names once: where they meet in the first of all the letter pairs that they meet in
        first = F.get(F.array_intersect(f"{looked_up}_few", in_all), 0) == F.col(f"{looked_up}_pair")
        met.append(sets["a"].join(sets["b"], (F.col("a_pair") == F.col("b_pair")) & order & in_length & early & first).select("a_key", "b_key", "a", "b", "a_letters", "b_letters"))
    shared_letters = F.size(F.array_intersect("a_letters", "b_letters"))
    pairs = met[0].unionByName(met[1]).where(alike(F.col("a_key"), F.col("b_key"), F.col("a"), F.col("b"), shared_letters, threshold))
    entries = registry.select("entry_id", "entry_key")
    return pairs.join(entries, F.col("b_key") == F.col("entry_key")).select(F.col("a_key").alias("name_key"), "entry_id", "entry_key")


def overridden(names: DataFrame, overrides: DataFrame) -> DataFrame:
    """``names`` (name_key, country, ...) with entry_id: an override for the name in its country, else one for the name anywhere, else null.

    ``overrides`` are (name_key, country, entry_id), at most one of a name and country.
    """
    o = overrides.select(F.col("name_key").alias("o_key"), F.upper("country").alias("o_country"), F.col("entry_id").alias("o_id"))
    exact = o.where(F.col("o_country").isNotNull()).withColumnRenamed("o_id", "exact_id")
    general = o.where(F.col("o_country").isNull()).select(F.col("o_key").alias("g_key"), F.col("o_id").alias("general_id"))
    in_country = names.join(exact, (F.col("name_key") == F.col("o_key")) & (F.upper("country") == F.col("o_country")), "left")
    return in_country.join(general, F.col("name_key") == F.col("g_key"), "left").withColumn("entry_id", F.coalesce("exact_id", "general_id")).select(*names.columns, "entry_id")


def scored_candidates(names: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, score: Callable[[Column, Column], Column] = name_score) -> DataFrame:
    """(name_key, entry_id, score) of the candidates; each pair of different keys is scored once, however many entries share a key."""
    keys = entries.select(F.col("entry_key").alias("entry_id"), "entry_key").distinct()
    pairs = candidates(names.select("name_key").distinct(), keys, threshold).withColumn("score", score(F.col("name_key"), F.col("entry_key"))).where(F.col("score") >= threshold - WINDOW)
    return pairs.select("name_key", "entry_key", "score").join(entries.select("entry_id", "entry_key"), "entry_key").select("name_key", "entry_id", "score")


def settled_by_equality(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, country, entry_id, score, status) of the ``names`` (name, country, name_key) that are entries' own names in a country that does not speak against them.

    Such an entry has the full score, and the smallest of them is the best candidate. What is left to see is whether another one comes within
    the gap: a second such entry, or one of another name likelier than 100 - ``GAP``. ``weighted_ratio`` gives at most 95 for anything but the
    names as they stand, so that the latter differ by fewer than one in twenty of both names' characters: of names of up to 40 characters
    in all one is the other without a character, which is looked up as such; longer names are ``candidates`` at that likeness.
    """
    same_country = lambda a, b: a.isNull() | b.isNull() | (F.upper(a) == F.upper(b))
    known = entries.where((F.col("entry_key") != "") & F.col("entry_id").isNotNull()).groupBy("entry_key", F.upper("entry_country").alias("entry_country")).agg(F.min("entry_id").alias("id"), F.count("entry_id").alias("n"))
    equal = names.join(known, (F.col("name_key") == F.col("entry_key")) & same_country(F.col("country"), F.col("entry_country")))
    found = equal.groupBy("name", "country", "name_key").agg(F.min("id").alias("entry_id"), F.sum("n").alias("n"))
    single = found.where(F.col("n") == 1).select("name_key", "country").distinct()
    keys, others = single.select("name_key").distinct(), known.select("entry_key").distinct()
    without = lambda df, c: df.where(F.length(c) <= 21).select(c, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(F.col(c), F.lit(1), i - 1), F.substring(F.col(c), i + 1, F.length(c)))))).alias("rest"))
    short = keys.join(without(others, "entry_key"), F.col("name_key") == F.col("rest")).select("name_key", "entry_key")
    short = short.unionByName(without(keys, "name_key").join(others, F.col("rest") == F.col("entry_key")).select("name_key", "entry_key"))
    long = [df.where(F.length(c) > 19) for df, c in ((keys, "name_key"), (others, "entry_key"))]
    long = candidates(long[0], long[1].select("entry_key", F.col("entry_key").alias("entry_id")), 100 - GAP).where(F.col("name_key") != F.col("entry_key")).select("name_key", "entry_key")
    near = short.unionByName(long).distinct().where(100.0 - name_score("name_key", "entry_key") < GAP)
    rivals = single.join(near, "name_key").join(known, "entry_key").where(same_country(F.col("country"), F.col("entry_country")))
    rivals = rivals.select(F.col("name_key").alias("r_key"), F.col("country").alias("r_country")).distinct().withColumn("rival", F.lit(True))
    whole = found.join(rivals, (F.col("name_key") == F.col("r_key")) & F.col("country").eqNullSafe(F.col("r_country")), "left")
    return whole.select("name", "country", "entry_id", F.lit(100.0).alias("score"), F.when((F.col("n") > 1) | F.col("rival"), "review").otherwise("auto").alias("status"))


def resolve_organisations(names: DataFrame, registry: DataFrame, overrides: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``names`` (name, country) to (name, country, entry_id, score, status, via).

    Overrides (name_key, country, entry_id; a null country is for all) come first, with and then without the country;
    what is left is scored against ``registry`` (entry_id, name, country). Names that are an entry's own are settled by equality; only
    the others are compared with all that are alike.
    """
    asked = names.select("name", "country").distinct().withColumn("name_key", normalize_org(F.col("name")))
    if overrides is None:
        left, decided = asked, None
    else:
        tiers = overridden(asked, overrides)
        decided = tiers.where(F.col("entry_id").isNotNull()).select("name", "country", "entry_id", F.lit(100.0).alias("score"), F.lit("auto").alias("status"), F.lit("override").alias("via"))
        left = tiers.where(F.col("entry_id").isNull()).drop("entry_id")
    entries = registry.select("entry_id", F.col("country").alias("entry_country"), normalize_org(F.col("name")).alias("entry_key"))
    equal = settle(settled_by_equality(left, entries))
    open_names = left.join(equal.select(F.col("name").alias("e_name"), F.col("country").alias("e_country")), F.col("name").eqNullSafe(F.col("e_name")) & F.col("country").eqNullSafe(F.col("e_country")), "left_anti")
    scored = open_names.join(scored_candidates(open_names, entries, threshold), "name_key").join(entries.select("entry_id", "entry_country"), "entry_id")
    keyed = scored.withColumn("query", F.struct("name", "country"))
    best = best_two_with_gap(keyed, "query", "entry_id", country="entry_country", hint="country", threshold=threshold)
    found = best.select("name", "country", F.when(F.col("status") != "nomatch", F.col("entry_id")).alias("entry_id"), F.col("adjusted").alias("score"), "status")
    found = found.unionByName(equal).withColumn("via", F.lit("registry"))
    whole = left.select("name", "country").join(found.withColumnsRenamed({"name": "f_name", "country": "f_country"}), F.col("name").eqNullSafe(F.col("f_name")) & F.col("country").eqNullSafe(F.col("f_country")), "left")
    whole = whole.select("name", "country", "entry_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("status", F.lit("nomatch")).alias("status"), F.coalesce("via", F.lit("registry")).alias("via"))
    return whole if decided is None else whole.unionByName(decided)


def combine_matches(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Two registries' matches of one name: identifiers filled from either, least confidence, both ways named, review if either is."""
    both = a["confidence"].isNotNull() & b["confidence"].isNotNull()
    return {
        "ror_id": a["ror_id"],
        "isni_id": F.coalesce(a["isni_id"], b["isni_id"]),
        "confidence": F.when(both, F.least(a["confidence"], b["confidence"])).otherwise(F.coalesce(a["confidence"], b["confidence"])),
        "via": F.concat_ws("+", a["via"], b["via"]),
        "status": F.when((a["status"] == "review") | (b["status"] == "review"), "review").otherwise(F.coalesce(a["status"], b["status"])),
    }


def person_hits(people: DataFrame, registry: DataFrame, keys: list[str], hit: str = "orcid") -> DataFrame:
    """One row for each person: the first hit, auto with confidence 1 if it is the only one, else review with 0.5; blank names have none."""
    named = people.where(F.forall(F.array(*[F.coalesce(F.trim(F.col(k)), F.lit("")) for k in keys]), lambda x: x != ""))
    hits = registry.groupBy(*keys).agg(F.count(hit).alias("hits"), F.min(hit).alias(hit))
    found = named.join(hits, keys)
    return found.withColumns({"status": F.when(F.col("hits") == 1, "auto").otherwise("review"), "confidence": F.when(F.col("hits") == 1, 1.0).otherwise(0.5)})


def first_hits(hits: DataFrame, query: str, order: str, most: int = 5) -> DataFrame:
    """The first hits of each search, in the registry's own order."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(order))
    return hits.withColumn("hit", place).where(F.col("hit") <= most)
