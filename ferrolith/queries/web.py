"""Pages: country, text, pre-flight, addresses, and the flagship record of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import web
from ferrolith.operators.validation import preflight
from ferrolith.queries import query, table
from ferrolith.sources.resources import needs_page
from ferrolith.streaming.pages import event_windows

#: Some pages get a country's domain or marks, so that every branch has rows.
_HOSTS = """case page_id % 6 when 1 then replace(url, '.com', '.cl') when 2 then replace(replace(url, '.com', '.uk'), '.org', '.gov.br') when 3 then replace(url, '.net', '.su') else url end"""


def _varied(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("url", F.expr(_HOSTS)).withColumn("html", F.expr("""case page_id % 5
        when 1 then concat('<meta property="og:locale" content="es_CL">', html)
        when 2 then concat('<meta content="BR" name="geo.country"/>', html)
        when 3 then concat('<meta name="geo.region" content="MX-OAX"/>', html)
        when 4 then regexp_replace(html, '(?i)lang="([a-z]{2})"', 'lang="$1-at"') else html end"""))


_VARIED_SQL = f"""varied as (select page_id, {_HOSTS} as url, case page_id % 5
  when 1 then concat('<meta property="og:locale" content="es_CL">', html)
  when 2 then concat('<meta content="BR" name="geo.country"/>', html)
  when 3 then concat('<meta name="geo.region" content="MX-OAX"/>', html)
  when 4 then regexp_replace(html, '(?i)lang="([a-z]{{2}})"', 'lang="\\1-at"', 'g') else html end as html from pages)"""

_Q = """[''"]"""
_NQ = """[^''"]"""


def _meta_sql(attribute: str, value: str) -> str:
    named, content = f"{attribute}={_Q}{value}{_Q}", f"content={_Q}({_NQ}+){_Q}"
    return f"coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+{named}[^>]+{content}', 1), ''), nullif(regexp_extract(html, '(?i)<meta[^>]+{content}[^>]+{named}', 1), ''))"


_COUNTRY_SQL = f"""parts as (select page_id, url, html, {_meta_sql('property', 'og:locale')} as loc, {_meta_sql('name', 'geo\\.country')} as geo, {_meta_sql('name', 'geo\\.region')} as reg,
    nullif(regexp_extract(html, '(?i)<html[^>]+lang={_Q}({_NQ}+){_Q}', 1), '') as lang,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host from varied),
codes as (select *, upper(case when contains(loc, '_') then string_split(loc, '_')[-1] when contains(loc, '-') then string_split(loc, '-')[-1] end) as c1, upper(geo) as c2,
    upper(case when contains(reg, '-') then string_split(reg, '-')[1] end) as c3, upper(case when contains(lang, '_') then string_split(lang, '_')[-1] when contains(lang, '-') then string_split(lang, '-')[-1] end) as c4,
    case when contains(host, '.') then string_split(host, '.')[-1] end as tld from parts),
answers as (select page_id, url, html, tld,
    coalesce(case when regexp_full_match(c1, '[A-Z]{{2}}') then c1 end, case when regexp_full_match(c2, '[A-Z]{{2}}') then c2 end, case when regexp_full_match(c3, '[A-Z]{{2}}') then c3 end, case when regexp_full_match(c4, '[A-Z]{{2}}') then c4 end) as by_html,
    case when tld in ('com', 'org', 'net', 'edu', 'gov', 'io') then null when tld = 'uk' then 'GB' when tld = 'su' then 'RU' when tld = 'tp' then 'TL' when tld in ('yu', 'cs') then 'RS' when tld = 'zr' then 'CD' when regexp_full_match(tld, '[a-z]{{2}}') then upper(tld) end as by_url from codes)"""


@query("scl_25_html_country", f"with {_VARIED_SQL}, {_COUNTRY_SQL} select page_id, by_html as country from answers")
def scl_25(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", web.country_from_html(F.col("html")).alias("country"))


@query("scl_27_tld_country", f"with {_VARIED_SQL}, {_COUNTRY_SQL} select page_id, by_url as country from answers")
def scl_27(spark, sf_dir):
    return _varied(spark, sf_dir).select("page_id", web.country_from_url(F.col("url")).alias("country"))


@query("scl_28_country", f"with {_VARIED_SQL}, {_COUNTRY_SQL} select coalesce(by_html, by_url, '-') as country, count(*) as n from answers group by 1")
def scl_28(spark, sf_dir):
    pages = _varied(spark, sf_dir).select(F.coalesce(web.country(F.col("html"), F.col("url")), F.lit("-")).alias("country"))
    return pages.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def _blocks_sql(column: str) -> str:
    for tag in web.BLOCKS:
        column = f"regexp_replace({column}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return column


_CLEAN_SQL = f"""substr(trim(regexp_replace(replace(replace(regexp_replace({_blocks_sql('html')}, '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\p{{Z}}]+', ' ', 'g')), 1, 8000)"""


@query("scl_23_clean_html", f"select page_id, {_CLEAN_SQL} as text from pages")
def scl_23(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.clean_html(F.col("html")).alias("text"))


@query("scl_21_main_text")
def scl_21(spark, sf_dir):
    """Text of each page's main part, by the nesting-aware reader."""
    return table(spark, sf_dir, "pages").select("page_id", web.main_content(F.col("html")).alias("text"))


@query("scl_24_resolve_url", "select page_id, case when page_id % 3 = 0 then 'https://doi.org/10.5555/p.' || page_id else url end as url from pages")
def scl_24(spark, sf_dir):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.5555/p."), "page_id")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", web.resolve_url(given).alias("url"))


@query("src_06_fetched_text", """select page_id, case when page_id % 4 = 0 then html || '!' when page_id % 4 = 1 then html when page_id % 4 = 2 then substr(html, 1, 100) else html end as text from pages""")
def src_06(spark, sf_dir):
    """Static text missing (0), whole (1, 3) or thin and without a longer rendering (2)."""
    p, k, html = table(spark, sf_dir, "pages"), F.col("page_id") % 4, F.col("html")
    static = F.when(k == 2, F.substring(html, 1, 100)).when(k != 0, html)
    rendered = F.when(k == 2, F.substring(html, 1, 50)).otherwise(F.concat(html, F.lit("!")))
    return p.select("page_id", web.fetched_text(static, rendered).alias("text"))


_PREFLIGHT_INPUT = """select page_id, case page_id % 4 when 0 then '' when 1 then '  ' else 'Page ' || page_id end as title,
  case page_id % 6 when 0 then '' when 1 then 'ftp://files.example.org/x' when 2 then 'example.org/path' when 3 then ' ' else url end as url,
  case page_id % 5 when 0 then '10.5555/x' when 1 then 'https://doi.org/10.5555/x' when 2 then 'doi:10.5555/x' else '' end as doi from pages"""


@query("val_01_preflight", f"""with r as ({_PREFLIGHT_INPUT}),
s as (select page_id, trim(title) as title, trim(url) as url, trim(doi) as doi, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)', 1) as place from r)
select page_id, title <> '' or url <> '' as valid, concat_ws('; ', case when url <> '' and scheme not in ('http', 'https') then 'scheme not http: ' || scheme end, case when url <> '' and place = '' then 'no network location' end,
  case when doi <> '' and not regexp_matches(doi, '^(https?://doi\\.org/)?10\\.') then 'not a doi: ' || doi end) as warnings from s""")
def val_01(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("fl_pages")
    rows = spark.sql(_PREFLIGHT_INPUT.replace("from pages", "from fl_pages"))
    errors, warnings = preflight(F.col("title"), F.lit(None).cast("string"), F.col("url"), F.col("doi"))
    return rows.select("page_id", (F.size(errors) == 0).alias("valid"), F.concat_ws("; ", warnings).alias("warnings"))


@query("orc_02_content_gate", "select page_id % 3 = 1 as wanted, count(*) as n from pages group by 1")
def orc_02(spark, sf_dir):
    """Pages are fetched only for resources with an address and without content."""
    content, url = F.when(F.col("page_id") % 3 == 0, F.col("html")), F.when(F.col("page_id") % 3 != 2, F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(needs_page(content, url).alias("wanted")).agg(F.count(F.lit(1)).alias("n"))


@query("page_records", f"""with {_VARIED_SQL}, {_COUNTRY_SQL} select page_id, url, coalesce(by_html, by_url) as country, {_CLEAN_SQL} as description,
  case when starts_with(url, 'http') then url else 'urn:ferrolith:' || sha256(cast(page_id as varchar)) end as id, trim(url) <> '' as valid from answers""")
def page_records(spark, sf_dir):
    """The flagship: pages to the first columns of a record."""
    html, url = F.col("html"), F.col("url")
    errors, _ = preflight(F.lit(""), F.lit(""), url, F.lit(""))
    own = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("urn:ferrolith:"), F.sha2(F.col("page_id").cast("string"), 256)))
    return _varied(spark, sf_dir).select("page_id", "url", web.country(html, url).alias("country"), web.clean_html(html).alias("description"), own.alias("id"), (F.size(errors) == 0).alias("valid"))


@query("stream_event_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def stream_event_windows(spark, sf_dir):
    """The streaming summary run as a batch over the same function."""
    return event_windows(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))
