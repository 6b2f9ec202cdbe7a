"""Lookups, entity resolution and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions.names import normalize_org
from ferrolith.operators import caching, matching, resolution, settings
from ferrolith.operators.validation import disagreeing
from ferrolith.queries import query, table
from ferrolith.sources import registries


def _alike_sql(a: str, b: str) -> str:
    """Whether two names can be alike at 90, over tables with n (the name), g (its letter pairs) and l (its numbered letters): the rule itself, for every pair."""
    few, many = f"least(length({a}.n), length({b}.n))", f"greatest(length({a}.n), length({b}.n))"
    lost = f"least(len({a}.g), len({b}.g)) - len(list_intersect({a}.g, {b}.g))"
    return f"""case when {many} < 1.5 * {few} then {lost} <= floor(0.157894737 * {few}) + 1 or {lost} <= (3 * {few}) // 10 and levenshtein({a}.n, {b}.n) <= (length({a}.n) + length({b}.n)) // 10
    and length({a}.n) + length({b}.n) - 2 * len(list_intersect({a}.l, {b}.l)) <= (length({a}.n) + length({b}.n)) // 10
  else {many} < 8 * {few} and case when length({a}.n) <= length({b}.n) then contains({b}.n, {a}.n) else contains({a}.n, {b}.n) end end"""


_PAIRS_OF = """list_distinct(list_transform(range(1, length(n) + 2), lambda i: substr(' ' || n || ' ', i, 2))) as g,
  list_transform(range(1, length(n) + 1), lambda i: substr(n, i, 1) || (i - length(replace(substr(n, 1, i), substr(n, i, 1), '')))) as l"""
_RATIO_SQL = "100.0 * (1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)))"


def _part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))


@query("join_04_candidates", f"""with r as (select *, {_PAIRS_OF} from (select p_name as n, min(p_partkey) as id from part group by 1)),
q as (select *, {_PAIRS_OF} from (select distinct unnest([n, substr(n, 1, 2) || substr(n, 4), n || ' works', split_part(n, ' ', 2)]) as n from r))
select a.n as name_key, b.id as entry_id from q a join r b on {_alike_sql("a", "b")}""")
def join_04(spark, sf_dir):
    """Part names as they are, with a letter lost, with a further word and without their first word, against all part names."""
    registry = _part_names(spark, sf_dir).select(F.col("id").alias("entry_id"), F.col("name").alias("entry_key"))
    n = F.col("entry_key")
    forms = F.array(n, F.concat(F.substring(n, 1, 2), F.substring(n, 4, 1000)), F.concat(n, F.lit(" works")), F.get(F.split(n, " "), 1))
    names = registry.select(F.explode(forms).alias("name_key")).distinct()
    return matching.candidates(names, registry).select("name_key", "entry_id")


@query("win_01_top2_gap", f"""with p as (select *, {_PAIRS_OF} from (select p_name as n, min(p_partkey) as id from part group by 1)),
s as (select q, c, score - case when q % 5 <> c % 5 then 15 else 0 end as adj, score from (select a.id as q, b.id as c, {_RATIO_SQL} as score from p a join p b on a.id <> b.id and {_alike_sql("a", "b")})),
r as (select *, row_number() over w as p, lead(adj) over w as second from s where score >= 40 window w as (partition by q order by adj desc, c))
select q, c, round(adj, 6) as adjusted, case when adj < 50 then 'nomatch' when second is null or adj - second >= 5 then 'auto' else 'review' end as status from r where p = 1""")
def win_01(spark, sf_dir):
    """Best two with a gap among all names that are alike, over an edit-distance score that SQL has too."""
    names = _part_names(spark, sf_dir)
    registry = names.select(F.col("id").alias("entry_id"), F.col("name").alias("entry_key"))
    pairs = matching.candidates(names.select(F.col("name").alias("name_key")), registry)
    asked = names.select(F.col("name").alias("a_name"), F.col("id").alias("q"), (F.col("id") % 5).cast("string").alias("hint"))
    near = pairs.join(asked, F.col("name_key") == F.col("a_name")).where(F.col("q") != F.col("entry_id"))
    scored = near.withColumns({"score": matching.levenshtein_ratio(F.col("name_key"), F.col("entry_key")), "c": F.col("entry_id"), "nation": (F.col("entry_id") % 5).cast("string")})
    best = matching.best_two_with_gap(scored, "q", "c", country="nation", hint="hint", threshold=50.0)
    return best.select("q", "c", F.round("adjusted", 6).alias("adjusted"), "status")


_BEST_SQL = f"""select ask, id, adj / 100 as conf, case when second is null or adj - second >= 5 then 'auto' else 'review' end as status from (
  select *, row_number() over w as p, lead(adj) over w as second from (select a.ask, b.id, {_RATIO_SQL} as score, score - case when a.country <> b.country then 15 else 0 end as adj from @Q a join @R b on {_alike_sql("a", "b")})
  where score >= 80 window w as (partition by ask order by adj desc, id)) where p = 1 and adj >= 90"""
_TIERS_SQL = f"""with nat as (select n_nationkey as k, 'Institute of ' || n_name as name, chr(65 + n_nationkey::int) || 'X' as code from nation),
reg as (select *, {_PAIRS_OF} from (select 'r' || k as id, case when k % 3 = 0 then 'i' || k end as isni, lower(name) as n, code as country from nat where k % 5 <> 4)),
sec as (select *, {_PAIRS_OF} from (select 's' || k as id, lower(name) as n, null::varchar as country from nat where k % 2 = 0)),
ask as (select *, row_number() over () as ask, lower(name) as n from (select distinct case m when 1 then replace(nat.name, 'Institute', 'Institte') when 3 then 'Pick ' || k when 4 then 'Pick ' || k when 5 then 'Override ' || k when 6 then 'Cached ' || k when 7 then '  ' else nat.name end as name,
  case when m in (2, 4) then 'ZZ' when m in (5, 7) then null else code end as country, m, k from (select s_suppkey % 8 as m, s_nationkey from supplier) join nat on s_nationkey = k)),
opened as (select *, {_PAIRS_OF} from ask where m < 5),
pick as (select a.ask, r.id as ror, r.isni, case when r.country <> a.country then 0.5 else 1.0 end as conf, case when r.country <> a.country then 'review' else 'auto' end as status from opened a join (
  select 'Pick ' || k as name, 'r' || k as ror from nat union all select name, 'r' || case when k % 7 = 1 then k else (k + 5) % 25 end from nat where k % 7 in (1, 2)) p on a.name = p.name join reg r on r.id = p.ror),
unsure as (select * from opened where ask not in (select ask from pick where status = 'auto')),
alike as ({_BEST_SQL.replace("@Q", "unsure").replace("@R", "reg")}),
one as (select o.*, case when l.ask is not null and (p.ask is null or l.status = 'auto') then l.id else p.ror end as ror, case when l.ask is not null and (p.ask is null or l.status = 'auto') then (select isni from reg where id = l.id) else p.isni end as isni,
  case when l.ask is not null and (p.ask is null or l.status = 'auto') then l.conf else p.conf end as conf, case when l.ask is not null and (p.ask is null or l.status = 'auto') then l.status else p.status end as st,
  case when l.ask is not null and (p.ask is null or l.status = 'auto') then 'query' when p.ask is not null then 'affiliation' end as via from opened o left join pick p using (ask) left join alike l using (ask)),
open2 as (select * from one where not coalesce(st = 'auto' and isni is not null, false)),
other as ({_BEST_SQL.replace("@Q", "open2").replace("@R", "sec")})
select name, country, ror as ror_id, coalesce(o.isni, l.id) as isni_id, cast(round(least(o.conf, l.conf), 6) as double) as confidence, case when o.st = 'review' or l.status = 'review' then 'review' else coalesce(o.st, l.status, 'nomatch') end as status,
  concat_ws('+', via, case when l.ask is not null then 'second' end) as via from one o left join other l using (ask)
union all select name, country, case m when 5 then 'o' || k when 6 then case when k % 2 = 0 then 'c' || k end end, null, case m when 5 then 1.0 when 6 then case when k % 2 = 0 then 0.75 end end, case m when 5 then 'auto' when 6 then case when k % 2 = 0 then 'review' else 'nomatch' end else 'nomatch' end,
  case m when 5 then 'override' when 6 then case when k % 2 = 0 then 'cache:query' else 'cache' end else '' end from (select distinct name, country, m, case when m < 7 then k end as k from ask where m >= 5)"""


@query("join_02_tiers", _TIERS_SQL)
def join_02_tiers(spark, sf_dir):
    """Names that reach every tier: overrides, cache (also of nothing), picks (also of another country), likeness, the second registry, none."""
    k, m = F.col("k"), F.col("m")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("Institute of "), "n_name").alias("base"), F.concat(F.char(65 + F.col("n_nationkey")), F.lit("X")).alias("code"))
    named = lambda p: F.concat(F.lit(p), k.cast("string"))
    nothing = F.lit(None).cast("string")
    registry = nat.where(k % 5 != 4).select(named("r").alias("ror_id"), F.when(k % 3 == 0, named("i")).alias("isni_id"), F.col("base").alias("name"), F.col("code").alias("country"))
    second = nat.where(k % 2 == 0).select(named("s").alias("isni_id"), F.col("base").alias("name"))
    asked = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("m"), F.col("s_nationkey").alias("k")).join(nat, "k")
    name = F.when(m == 1, F.replace(F.col("base"), F.lit("Institute"), F.lit("Institte"))).when(m.isin(3, 4), named("Pick ")).when(m == 5, named("Override ")).when(m == 6, named("Cached ")).when(m == 7, "  ").otherwise(F.col("base"))
    asked = asked.select(name.alias("name"), F.when(m.isin(2, 4), "ZZ").when(~m.isin(5, 7), F.lower("code")).alias("country"))
    overrides = nat.select(named("override ").alias("name_key"), nothing.alias("country"), named("o").alias("ror_id"), nothing.alias("isni_id"))
    known = k % 2 == 0
    cache = nat.select(
        caching.cache_key(F.lit("org"), named("cached "), F.col("code")).alias("cache_key"), F.lit("2100-01-01").cast("timestamp").alias("expires_at"),
        F.when(known, named("c")).alias("ror_id"), nothing.alias("isni_id"), F.when(known, 0.75).alias("confidence"), F.when(known, "review").alias("status"), F.when(known, "query").alias("via"),
    )
    expired = cache.withColumns({"expires_at": F.lit("2000-01-01").cast("timestamp"), "ror_id": F.lit("old")})
    picks = nat.select(named("Pick ").alias("name"), named("r").alias("ror_id")).unionByName(
        nat.where((k % 7).isin(1, 2)).select(F.col("base").alias("name"), F.concat(F.lit("r"), F.when(k % 7 == 1, k).otherwise((k + 5) % 25)).alias("ror_id"))
    )
    found = resolution.resolve_in_tiers(asked, registry, second, overrides, cache.unionByName(expired), picks, F.lit("2020-01-01").cast("timestamp"), score=matching.levenshtein_ratio)
    return found.select("name", "country", "ror_id", "isni_id", F.round("confidence", 6).alias("confidence"), "status", "via")


@query("val_19_disagreeing", """with g as (select s_nationkey as k, s_suppkey % 4 as v, min(s_name) as n, count(*) as c from supplier group by 1, 2)
select a.k as nation, a.v as value_a, a.n as name_a, b.v as value_b, b.n as name_b, a.c + b.c as names from g a join g b on a.k = b.k and a.v < b.v""")
def val_19(spark, sf_dir):
    """Suppliers of a nation that give it different values."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 4).alias("value"), F.col("s_name").alias("name"))
    found = disagreeing(rows, "nation", "value", "name")
    return found.select("nation", "value_a", "name_a", "value_b", "name_b", (F.col("names_a") + F.col("names_b")).alias("names"))


@query("join_02_resolve_organisations")
def join_02(spark, sf_dir):
    """Messy supplier names against the suppliers as a registry, with overrides; weighted name score."""
    s = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.upper(F.substring("n_name", 1, 2)).alias("country"))
    registry = s.join(nation, F.col("s_nationkey") == F.col("k")).select(F.col("s_suppkey").alias("entry_id"), F.col("s_name").alias("name"), "country")
    asked = registry.select(F.when(F.col("entry_id") % 3 == 0, F.upper("name")).when(F.col("entry_id") % 3 == 1, F.concat("name", F.lit(" Ltd."))).otherwise(F.col("name")).alias("name"), "country")
    overrides = registry.where(F.col("entry_id") % 50 == 0).select(normalize_org(F.col("name")).alias("name_key"), F.lit(None).cast("string").alias("country"), "entry_id")
    return matching.resolve_organisations(asked, registry, overrides)


@query("join_01_override", """select c_custkey, coalesce(case when c_custkey % 4 = 0 then 'exact-' || c_nationkey end, case when c_custkey % 2 = 0 then 'general' end) as entry from customer""")
def join_01(spark, sf_dir):
    """Two tiers of overrides: name with country, then name alone."""
    key = F.when(F.col("c_custkey") % 4 == 0, "a").when(F.col("c_custkey") % 2 == 0, "b").otherwise("c")
    asked = table(spark, sf_dir, "customer").select("c_custkey", key.alias("name_key"), F.col("c_nationkey").cast("string").alias("country"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("country"))
    in_country = nations.select(F.lit("a").alias("name_key"), "country", F.concat(F.lit("exact-"), "country").alias("entry_id"))
    anywhere = spark.createDataFrame([("a", None, "general"), ("b", None, "general")], "name_key string, country string, entry_id string")
    return matching.overridden(asked, in_country.unionByName(anywhere)).select("c_custkey", F.col("entry_id").alias("entry"))


@query("join_05_combine", """with a as (select s_suppkey, case when s_suppkey % 3 <> 0 then 'ror' || s_suppkey end as ror, case when s_suppkey % 6 = 1 then 'i1' end as isni, case when s_suppkey % 3 <> 0 then 0.9 end as conf, case when s_suppkey % 3 <> 0 then 'ror' end as via, case when s_suppkey % 3 <> 0 then case when s_suppkey % 5 = 0 then 'review' else 'auto' end end as st,
  case when s_suppkey % 2 = 0 then 'i2' end as isni2, case when s_suppkey % 2 = 0 then 0.95 end as conf2, case when s_suppkey % 2 = 0 then 'isni' end as via2, case when s_suppkey % 2 = 0 then 'auto' end as st2 from supplier)
select s_suppkey, ror as ror_id, coalesce(isni, isni2) as isni_id, cast(least(conf, conf2) as double) as confidence, concat_ws('+', via, via2) as via, case when st = 'review' or st2 = 'review' then 'review' else coalesce(st, st2) end as status from a""")
def join_05(spark, sf_dir):
    k = F.col("s_suppkey")
    on = lambda c, v: F.when(c, v if not isinstance(v, (str, float)) else F.lit(v))
    a, b = k % 3 != 0, k % 2 == 0
    combined = matching.combine_matches(
        {"ror_id": on(a, F.concat(F.lit("ror"), k)), "isni_id": on(k % 6 == 1, "i1"), "confidence": on(a, 0.9), "via": on(a, "ror"), "status": on(a, F.when(k % 5 == 0, "review").otherwise("auto"))},
        {"isni_id": on(b, "i2"), "confidence": on(b, 0.95), "via": on(b, "isni"), "status": on(b, "auto")},
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[c.alias(n) for n, c in combined.items()])


@query("join_06_single_hit", """with h as (select c_nationkey, c_mktsegment, count(*) as hits, min(c_custkey) as orcid from customer group by 1, 2)
select s_suppkey, hits, orcid, case when hits = 1 then 'auto' else 'review' end as status, cast(case when hits = 1 then 1.0 else 0.5 end as double) as confidence from (select s_suppkey, s_nationkey, case when s_suppkey % 2 = 0 then 'BUILDING' else '' end as seg from supplier) join h on s_nationkey = c_nationkey and seg = c_mktsegment where seg <> ''""")
def join_06(spark, sf_dir):
    people = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("family"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("").alias("given"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("family"), F.col("c_mktsegment").alias("given"), F.col("c_custkey").alias("orcid"))
    return matching.person_hits(people, registry, ["family", "given"]).select("s_suppkey", "hits", "orcid", "status", "confidence")


@query("join_10_backfill", """select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority else coalesce(c_name, '') end as name from orders left join customer on o_custkey = c_custkey and o_orderkey % 3 = 0""")
def join_10(spark, sf_dir):
    """Blanks filled by a left join, only where there is an identifier."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("doi"))
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("w_doi"), "c_name")
    return o.join(w, F.col("doi") == F.col("w_doi"), "left").select("o_orderkey", F.when(F.col("name") == "", F.coalesce("c_name", F.lit(""))).otherwise(F.col("name")).alias("name"))


@query("join_11_media_type", """select s_suppkey, case s_suppkey % 4 when 0 then 'text/csv' when 1 then 'text/csv' when 2 then 'xml' else 'strange' end as media_type from supplier""")
def join_11(spark, sf_dir):
    rows = spark.createDataFrame([("csv", "text/csv"), ("xml", "text/xml"), ("xml", "application/xml"), ("json", "application/json")], "name string, template string")
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, ("TEXT/CSV", "CSV", "xml", "strange"))), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("format"))
    return registries.normalized_media_type(files, "format", *registries.media_types(rows)).select("s_suppkey", "media_type")


@query("join_13_cache_miss", """with q as (select conv_id, turn, sha256(concat_ws(':', role, text)) as key from conversations), c as (select distinct key, conv_id % 4 = 0 as neg, conv_id from q where turn = 0 and conv_id % 2 = 0)
select case when exists (select 1 from (select key, min(conv_id) as m from c group by key) x where x.key = q.key) then 'hit' else 'miss' end as outcome, count(*) as n from q group by 1""")
def join_13(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", caching.cache_key(F.col("role"), F.col("text")).alias("key"))
    stored = q.where("turn = 0 and conv_id % 2 = 0").groupBy("key").agg(F.min("conv_id").alias("m"))
    cache = stored.select("key", F.when(F.col("m") % 4 != 0, "answer").alias("value"), F.lit("2100-01-01").cast("timestamp").alias("expires_at"))
    hits, misses = caching.cached(q, cache, F.lit("2020-01-01").cast("timestamp"))
    both = hits.select(F.lit("hit").alias("outcome")).unionByName(misses.select(F.lit("miss").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("llm_07_store", """with q as (select conv_id, turn, sha256(role || ':' || text) as key, role, text from conversations),
old as (select key, min(conv_id) as m from q where turn = 0 group by 1), valid as (select key, m from old where m % 3 <> 0), called as (select key, min(struct_pack(c := conv_id, t := turn)) as payer from q where key not in (select key from valid) group by 1)
select q.conv_id as conv_id, q.turn as turn, case when v.key is not null then '{"a":' || m || '}' else '"new"' end as answer, case when c.payer.c = q.conv_id and c.payer.t = q.turn then 7 else 0 end as tokens,
  (select count(*) from called) as calls, (select count(*) from (select key from valid union select key from called)) as kept from q left join valid v on q.key = v.key left join called c on q.key = c.key""")
def llm_07(spark, sf_dir):
    """Turns as requests: entries in both shapes, expired ones, one call for each key, and the cache after the batch."""
    q = table(spark, sf_dir, "conversations").select(caching.cache_key(F.col("role"), F.col("text")).alias("key"), "conv_id", "turn")
    old = q.where("turn = 0").groupBy("key").agg(F.min("conv_id").alias("m"))
    bare = F.concat(F.lit('{"a":'), "m", F.lit("}"))
    payload = F.when(F.col("m") % 2 == 0, bare).otherwise(F.concat(F.lit('{"data":'), bare, F.lit(',"usage":{"total":9}}')))
    cache = old.select("key", payload.alias("payload"), F.when(F.col("m") % 3 == 0, "2000-01-01").otherwise("2100-01-01").cast("timestamp").alias("expires_at"))
    answers = q.select("key").distinct().join(cache.where("expires_at > '2050-01-01'"), "key", "left_anti").select("key", F.lit('{"data":"new","usage":{}}').alias("payload"), F.lit(7).alias("tokens"))
    done, calls, after = caching.answer_batch(q, cache, answers, F.lit("2020-01-01").cast("timestamp"), F.lit("2030-01-01").cast("timestamp"))
    counts = calls.agg(F.count(F.lit(1)).alias("calls")).crossJoin(after.agg(F.count(F.lit(1)).alias("kept")))  # a row each
    return done.select("conv_id", "turn", "answer", "tokens").crossJoin(F.broadcast(counts))


@query("join_17_field_owner", """select event_type as field, user_id as agent, ts from (select event_type, user_id, ts, row_number() over (partition by event_type order by ts desc, user_id desc) as p from events) where p = 1""")
def join_17(spark, sf_dir):
    """The last that declared a field owns it."""
    declared = table(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.col("user_id").alias("agent"), "ts")
    return settings.field_owners(declared, "field", "agent", "ts")


@query("join_18_settings", """select s_suppkey, coalesce(case when s_suppkey % 5 = 0 then 50 end, case when s_nationkey % 2 = 0 then 20 end, 8) as workers from supplier""")
def join_18(spark, sf_dir):
    """The most specific setting wins: model, provider, global."""
    providers = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.lit(20).alias("value"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    models = s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("key"), F.lit(50).alias("value"))
    return settings.most_specific(s, [("s_suppkey", models), ("s_nationkey", providers)], F.lit(8), "workers").select("s_suppkey", "workers")


@query("set_04_upsert", """select s_suppkey, s_nationkey, 'new' as origin from supplier where s_suppkey % 3 = 0 union all select s_suppkey, s_nationkey, 'old' from supplier where s_suppkey % 2 = 0 and s_suppkey % 3 <> 0""")
def set_04(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return caching.upsert(s.where("s_suppkey % 2 = 0").withColumn("origin", F.lit("old")), s.where("s_suppkey % 3 = 0").withColumn("origin", F.lit("new")), ["s_suppkey"])


@query("set_05_addable", "select p_brand as brand from part group by 1 having min(p_size) > 1 or count(*) < 3")
def set_05(spark, sf_dir):
    """A pool without what is configured already."""
    pool = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_size")
    used = pool.groupBy("brand").agg(F.min("p_size").alias("m"), F.count(F.lit(1)).alias("n")).where("m <= 1 and n >= 3")
    return settings.addable(pool, used, "brand")


@query("src_11_isni_xml", """select s_suppkey, i as isni, 'Name ' || i as name, 'org' as kind, 'https://isni.org/isni/' || i as uri from (select s_suppkey, unnest(['000' || s_suppkey, '111' || s_suppkey]) as i from supplier where s_suppkey % 3 <> 0)""")
def src_11(spark, sf_dir):
    k = F.col("s_suppkey")
    rec = lambda p: F.concat(F.lit("<record><r:data xmlns:r='u'><isniUnformatted>"), F.lit(p), k, F.lit("</isniUnformatted><organisation><organisationType>org</organisationType><mainName>Name "), F.lit(p), k, F.lit("</mainName></organisation></r:data></record>"))
    xml = F.when(k % 3 == 0, "not xml").otherwise(F.concat(F.lit("<s:answer xmlns:s='v'>"), rec("000"), rec("111"), F.lit("</s:answer>")))
    return registries.isni_records(table(spark, sf_dir, "supplier").select("s_suppkey", xml.alias("xml")), "s_suppkey", "xml")
