"""Studies, samples, audits, claims and service states as queries, with SQL that states their rules in its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions import derived, hashing, stats, text
from lumenbib.operators import aggregates, audit, readiness, records, sampling, search, similarity
from lumenbib.plans import sql as Q
from lumenbib.plans.registry import query
from lumenbib.session import scratch, table
from lumenbib.sources import records as sources
from lumenbib.sources import sinks
from lumenbib.streaming import flows

SCOPE_EVENTS = ["Sentinel Symposium", "CIPHER Conf", "ACSYS Security"]
_SCOPE = "('Sentinel Symposium', 'CIPHER Conf', 'ACSYS Security')"


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def _preprints(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preprints")


# --- coverage, filters --------------------------------------------------------------------------------------
@query("agg_04_percentages", "select count(*) as total, 100.0 * count(*) filter (where coalesce(abstract, '') <> '') / count(*) as abstract_pct, 100.0 * count(*) filter (where coalesce(bibtex, '') <> '') / count(*) as bibtex_pct from papers")
def _(s, d):
    return aggregates.percentages(_papers(s, d))


@query("filt_15_scope", "select paper_id from papers where year between 2018 and 2022 and title is not null and authors is not null")
def _(s, d):
    return search.in_scope(_papers(s, d), None, (2018, 2022)).select("paper_id")


@query("filt_17_log_sources", f"select distinct p.paper_id from papers p join abstract_log l on l.paper_id = p.paper_id and {Q.COLLAPSE.format('l.abstract')} = {Q.COLLAPSE.format('p.abstract')} where l.status = 'ok' and {Q.COLLAPSE.format('l.abstract')} <> '' and l.source in (select source from abstract_log group by 1 order by source limit 2)")
def _(s, d):
    log = table(s, d, "abstract_log")
    first = [r.source for r in log.where("source is not null").select("source").distinct().orderBy("source").limit(2).collect()]
    return audit.log_evidence(_papers(s, d), log, first).select("paper_id")


@query("filt_18_is_set", "select * from (values (1, false), (2, true), (3, false), (4, true)) t(id, given)")
def _(s, d):
    given = [search.SearchFilters(), search.SearchFilters(title="x"), search.SearchFilters(title="", year=0), search.SearchFilters(year=2020)]
    return s.createDataFrame([(i, f.is_set()) for i, f in enumerate(given, 1)], "id int, given boolean")


@query("sort_02_oldest", "select row_number() over (order by year asc nulls first, coalesce(title, ''), event nulls first, title nulls first, paper_id) as place, paper_id from papers order by 1 limit 200")
def _(s, d):
    return _places(search.search(_papers(s, d), search.SearchFilters(), 200, "oldest"))


@query("sort_02_newest", "select row_number() over (order by year desc nulls last, coalesce(title, ''), event nulls first, title nulls first, paper_id) as place, paper_id from papers order by 1 limit 200")
def _(s, d):
    return _places(search.search(_papers(s, d), search.SearchFilters(), 200, "newest"))


@query("sort_01_default", "select row_number() over (order by year desc nulls last, event nulls first, title nulls first, paper_id) as place, paper_id from papers order by 1 limit 200")
def _(s, d):
    return _places(search.search(_papers(s, d), search.SearchFilters(), 200))


def _places(page: DataFrame) -> DataFrame:
    """The place of each row of a top-k report; its length is the report's."""
    rows = page.agg(F.collect_list("paper_id").alias("ids"))
    return rows.select(F.posexplode("ids").alias("place", "paper_id")).select((F.col("place") + 1).alias("place"), "paper_id")


# --- author blocks, track records ---------------------------------------------------------------------------
_NAMES_P = "(select paper_id, year, event, unnest(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> '')) as name from papers)"
_NAMES_X = "(select arxiv_id, unnest(authors) as name from preprints)"
_STRICT = f"pk as (select distinct paper_id, year, event, {Q.STRICT_KEY} as k from {_NAMES_P}), xk as (select distinct arxiv_id, {Q.STRICT_KEY} as k from {_NAMES_X})"
_BEST = f"pt as (select distinct {Q.TITLE_TOKENS} as t from papers), xt as (select distinct arxiv_id, {Q.TITLE_TOKENS} as t from preprints), best as (select arxiv_id, max(len(list_intersect(xt.t, pt.t)) / (len(xt.t) + len(pt.t) - len(list_intersect(xt.t, pt.t)))) as best from xt, pt where len(xt.t) > 0 and len(pt.t) > 0 group by 1)"
_RATES = """
select {by}, threshold, n_with, n_without, converted_with, converted_without, cw / nw as precision, co / no as base_rate,
  case when co / no = 0 and cw / nw > 0 then 'infinity'::double when co / no = 0 then 0.0 else (cw / nw) / (co / no) end as lift,
  case when cw + co = 0 then 0.0 else cw / (cw + co) end as recall, case when n_with + n_without = 0 then 0.0 else 1 - n_with / (n_with + n_without) end as volume_reduction,
  case when cw + co = 0 then 0.0 else (cw / nw) / ((cw + co) / (n_with + n_without)) end as conventional_lift
from (select *, converted_with::double as cw, converted_without::double as co, case when n_with = 0 then 1.0 else n_with end as nw, case when n_without = 0 then 1.0 else n_without end as no from counts)
"""


@query("join_03_author_blocks_sizes", f"with p as (select distinct paper_id, {Q.AUTHOR_KEY} as k from {_NAMES_P}), x as (select distinct arxiv_id, {Q.AUTHOR_KEY} as k from {_NAMES_X}) select p.k, p.n as papers, x.n as preprints from (select k, count(*) as n from p where k <> '' group by 1) p join (select k, count(*) as n from x where k <> '' group by 1) x using (k)")
def _(s, d):
    return similarity.author_blocks(_papers(s, d), _preprints(s, d))


@query("join_10_track_record", f"with {_STRICT} select distinct arxiv_id from xk where k <> '' and k in (select k from pk)")
def _(s, d):
    return readiness.has_record(_preprints(s, d), readiness.prior_authors(_papers(s, d))).where("record").select("arxiv_id")


@query("join_11_grid", "select e as event, cast(y as int) as year from (select unnest(['Sentinel Symposium', 'CIPHER Conf', 'ACSYS Security']) as e), range(2020, 2026) t(y)")
def _(s, d):
    return sources.worklist(s, SCOPE_EVENTS, (2020, 2025)).select("event", "year")


@query("src_22_worklist", "select e as event, cast(y as int) as year, case when e = 'ACSYS Security' then 4 end as volume from (select unnest(['Sentinel Symposium', 'CIPHER Conf', 'ACSYS Security']) as e), range(2020, 2026) t(y) where e <> 'ACSYS Security' or y = 2021")
def _(s, d):
    return sources.worklist(s, SCOPE_EVENTS, (2020, 2025), [(SCOPE_EVENTS[2], 2021, 4)])


@query("agg_22_prior_authors", f"with {_STRICT} select distinct k from pk where k <> ''")
def _(s, d):
    return readiness.prior_authors(_papers(s, d)).select("k")


_READY_1 = f"""
with {_STRICT}, {_BEST}, since as (select k, min(year) as s from pk where k <> '' and year is not null group by 1),
x as (select distinct on (arxiv_id) arxiv_id, try_cast(left(submitted_at, 4) as int) as cohort from preprints),
r as (select arxiv_id, cohort, arxiv_id in (select xk.arxiv_id from xk join since using (k) join x x2 on x2.arxiv_id = xk.arxiv_id where since.s < x2.cohort) as rec from x where cohort between 2021 and 2024),
counts as (select cohort, threshold, count(*) filter (where rec) as n_with, count(*) filter (where not rec) as n_without, count(*) filter (where rec and coalesce(best >= threshold, false)) as converted_with, count(*) filter (where not rec and coalesce(best >= threshold, false)) as converted_without
  from r left join best using (arxiv_id), (values (0.55::double), (0.6::double), (0.7::double)) t(threshold) group by 1, 2)
""" + _RATES.format(by="cohort")


@query("ready_01_study", _READY_1)
def _(s, d):
    return readiness.study(_preprints(s, d), _papers(s, d), [2021, 2022, 2023, 2024], [0.55, 0.6, 0.7])


@query("agg_19_counts", _READY_1.split("\nselect")[0] + " select cohort, threshold, n_with, n_without, converted_with, converted_without from counts")
def _(s, d):
    return readiness.study(_preprints(s, d), _papers(s, d), [2021, 2022, 2023, 2024], [0.55, 0.6, 0.7]).select("cohort", "threshold", "n_with", "n_without", "converted_with", "converted_without")


@query("agg_20_rates", "select * from (values (1, 0.15::double, 0.01::double, 0.9375::double, 0.5::double), (2, 0.0, 0.0, 0.0, 0.0), (3, 0.2, 0.0, 1.0, 0.5)) t(id, precision, base_rate, recall, volume_reduction)")
def _(s, d):
    given = s.createDataFrame([(1, 100, 100, 15, 1), (2, 0, 0, 0, 0), (3, 5, 5, 1, 0)], "id int, n_with long, n_without long, converted_with long, converted_without long")
    return readiness.rates(given).select("id", "precision", "base_rate", "recall", "volume_reduction")


_READY_2 = f"""
with {_STRICT}, {_BEST}, ends as (select paper_id, list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> '') as a from papers),
chosen as (select distinct k from pk where k <> '' and event in {_SCOPE}),
prior as (
  select 'any' as variant, k from pk where k <> '' union select 'chosen_venues', k from chosen union select 'prolific', k from (select k, count(distinct paper_id) as n from pk where k <> '' group by 1) where n >= 3
  union select 'random', k from (select distinct k from pk where k <> '' order by sha256('42:' || k) limit (select greatest(1, count(*)) from chosen))
  union select 'first', {Q.STRICT_KEY} from (select a[1] as name from ends where len(a) > 0) union select 'senior', {Q.STRICT_KEY} from (select a[-1] as name from ends where len(a) > 0)),
x as (select distinct arxiv_id from preprints), v as (select unnest(['any', 'chosen_venues', 'prolific', 'random', 'first', 'senior']) as variant),
r as (select v.variant, x.arxiv_id, h.arxiv_id is not null as rec from x cross join v left join (select distinct variant, arxiv_id from xk join prior using (k) where k <> '') h on h.variant = v.variant and h.arxiv_id = x.arxiv_id),
counts as (select variant, 0.6::double as threshold, count(*) filter (where rec) as n_with, count(*) filter (where not rec) as n_without, count(*) filter (where rec and coalesce(best >= 0.6, false)) as converted_with, count(*) filter (where not rec and coalesce(best >= 0.6, false)) as converted_without
  from r left join best using (arxiv_id) group by 1)
""" + _RATES.format(by="variant")


@query("ready_02_baselines", _READY_2)
def _(s, d):
    return readiness.baselines(_preprints(s, d), _papers(s, d), SCOPE_EVENTS)


# --- early signals ------------------------------------------------------------------------------------------
_FOUND = f"""
with p as (select distinct paper_id, {Q.AUTHOR_KEY} as k from {_NAMES_P}), x as (select distinct arxiv_id, {Q.AUTHOR_KEY} as k from {_NAMES_X}),
b as (select distinct paper_id, arxiv_id from p join x using (k) where k <> ''),
pt as (select paper_id, year, event, {Q.TITLE_TOKENS} as t from papers), xt as (select distinct arxiv_id, submitted_at, {Q.TITLE_TOKENS} as t from preprints),
m as (select paper_id, arxiv_id, event, len(list_intersect(pt.t, xt.t)) / (len(pt.t) + len(xt.t) - len(list_intersect(pt.t, xt.t))) as sim,
  cast(floor((epoch_us(make_timestamp(year, 7, 1, 0, 0, 0)) - epoch_us(cast(submitted_at as timestamptz))) / 86400000000) as int) as lag from b join pt using (paper_id) join xt using (arxiv_id) where len(pt.t) > 0 and len(xt.t) > 0),
found as (select * from m where sim >= 0.55), one as (select * from found qualify row_number() over (partition by paper_id order by sim, arxiv_id) = 1),
h as (select list(lag order by lag) as h, count(*) as n, max(lag) as max from one)
"""


def _r6(p: int) -> str:
    j = f"greatest(1, least({p} * (n + 1) // 100, n - 1))"
    return f"case when n >= 2 then (h[{j}] * (100.0 - ({p} * (n + 1) - {j} * 100)) + h[{j} + 1] * ({p} * (n + 1) - {j} * 100)) / 100 end as p{p}"


@query("agg_16_quantiles", _FOUND + f"select n, {', '.join(_r6(p) for p in (25, 50, 75, 90))}, max from h where n >= 1")
def _(s, d):
    return similarity.lag_quantiles(similarity.find_matches(_papers(s, d), _preprints(s, d)))


@query("sort_05_matches", _FOUND + "select row_number() over (order by sim desc, paper_id, arxiv_id) as place, paper_id, arxiv_id from found order by 1 limit 100")
def _(s, d):
    top = similarity.ordered_matches(similarity.find_matches(_papers(s, d), _preprints(s, d))).limit(100)
    rows = top.agg(F.collect_list(F.struct("paper_id", "arxiv_id")).alias("m")).select(F.posexplode("m").alias("place", "m"))
    return rows.select((F.col("place") + 1).alias("place"), "m.paper_id", "m.arxiv_id")


@query("sim_04_early_signal", _FOUND + f"select (select count(*) from papers where year in (2024, 2025) and event in {_SCOPE} and title is not null and authors is not null) as cohort, (select count(distinct paper_id) from found join papers p using (paper_id) where p.year in (2024, 2025) and p.event in {_SCOPE}) as matched, (select median(lag) from one join papers p using (paper_id) where p.year in (2024, 2025) and p.event in {_SCOPE}) as median_lag")
def _(s, d):
    return similarity.early_signal_study(_papers(s, d), _preprints(s, d), SCOPE_EVENTS, [2024, 2025])


# --- duplicates ---------------------------------------------------------------------------------------------
def _identity(x: str) -> str:
    wide = f"translate(coalesce({x}, ''), '{''.join(chr(c) for c in range(0xFF01, 0xFF5F)).replace(chr(39), chr(39) * 2)}', '{''.join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace(chr(39), chr(39) * 2)}')"
    for a, b in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        wide = f"replace({wide}, '{a}', '{b}')"
    return rf"trim(regexp_replace(replace(lower(nfc_normalize({wide})), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{Nd}}\x{{200C}}\x{{200D}}]+', ' ', 'g'))"


_CLUSTERS = f"""
with k as (select paper_id, key, ee, {_identity('title')} as t, {_identity('authors')} as a, coalesce(cast(year as varchar), '') as y, {_identity('pages')} as pg from papers),
g as (select t, a, count(*) as cluster_size, 'ta-' || left(sha256(string_agg(paper_id, chr(10) order by paper_id)), 12) as cluster_id,
  case when count(distinct y) = 1 and count(distinct pg) = 1 then 'exact_bibliographic_duplicate_candidate' else 'possible_version_relation' end as classification from k where t <> '' group by t, a having count(*) > 1)
"""


@query("dedup_03_clusters", _CLUSTERS + "select cluster_id, classification, cluster_size, paper_id from g join k using (t, a)")
def _(s, d):
    return records.identity_clusters(_papers(s, d))


@query("hash_02_cluster_ids", _CLUSTERS + "select distinct cluster_id from g")
def _(s, d):
    return records.identity_clusters(_papers(s, d)).select("cluster_id").distinct()


@query("scal_11_identity", f"select paper_id, {_identity('title')} as t from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", text.identity(F.col("title")).alias("t"))


_SUMMARY = _CLUSTERS + f"select (select count(*) from (select key from papers where coalesce(key, '') <> '' group by 1 having count(*) > 1)) as key_groups, (select count(*) from (select {Q.DOI} as doi from papers where coalesce({Q.DOI}, '') <> '' group by 1 having count(*) > 1)) as doi_groups, (select count(*) from g) as clusters, (select coalesce(sum(cluster_size - 1), 0) from g)::bigint as excess_records"


@query("dedup_04_summary", _SUMMARY)
def _(s, d):
    p = _papers(s, d).withColumn("doi", derived.doi(F.col("ee")))
    return records.duplicate_summary(p, records.identity_clusters(p))


@query("agg_25_duplicates", _SUMMARY.replace("select (select count(*) from (select key", "select (select count(*) from g where classification like 'exact%') as exact_clusters, (select count(*) from (select key"))
def _(s, d):
    p = _papers(s, d).withColumn("doi", derived.doi(F.col("ee")))
    clusters = records.identity_clusters(p)
    exact = clusters.where("classification like 'exact%'").agg(F.count_distinct("cluster_id").alias("exact_clusters"))
    return records.duplicate_summary(p, clusters).join(F.broadcast(exact))


@query("hash_03_manifest", "select sha256(string_agg(role || chr(0) || path || chr(0) || bytes || chr(0) || sha || chr(10), '' order by role, path)) as digest from (select 'event' as role, event as path, count(*) as bytes, sha256(event) as sha from papers where event is not null group by event)")
def _(s, d):
    files = _papers(s, d).where("event is not null").groupBy("event").agg(F.count("*").alias("bytes"))
    return hashing.manifest_digest(files.select(F.lit("event").alias("role"), F.col("event").alias("path"), "bytes", F.sha2("event", 256).alias("sha256")))


@query("scal_12_entities", "select paper_id, title as t from papers where title is not null and not contains(title, '&')")
def _(s, d):
    rows = _papers(s, d).where("title is not null and not contains(title, '&')")
    coded = F.replace(F.replace(F.replace(F.replace("title", F.lit("e"), F.lit("&#101;")), F.lit("'"), F.lit("&#x27;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return rows.select("paper_id", text.unescape_entities(coded).alias("t"))


# --- samples ------------------------------------------------------------------------------------------------
_STRATA = """
with recursive n as (select event, count(*) as population from papers where event is not null group by 1), t as (select sum(population) as all_rows, least(200, sum(population)) as total from n),
q as (select event, population, 200.0 * population / all_rows as quota, total from n, t),
g as (select *, least(population, greatest(1, floor(quota)::bigint)) as base, row_number() over (order by quota - floor(quota) desc, population desc, event) as place from q),
f as (select event, population, base + case when place <= total - (select sum(base) from g) and base < population then 1 else 0 end as sample from g)
"""


@query("samp_01_strata", _STRATA + "select event, population, sample from f")
def _(s, d):
    return sampling.strata(_papers(s, d), "event", 200)


@query("win_05_remainders", _STRATA + "select event, population, sample from f where sample > 1")
def _(s, d):
    return sampling.strata(_papers(s, d), "event", 200).where("sample > 1")


_SAMPLE = _STRATA + "select paper_id, event, population / sample as weight from papers join f using (event) qualify row_number() over (partition by event order by sha256('42:' || paper_id)) <= sample"


@query("samp_02_sample", _SAMPLE)
def _(s, d):
    return sampling.stratified_sample(_papers(s, d), "paper_id", "event", 200).select("paper_id", "event", "weight")


@query("samp_03_verified", "select 0 as differing, cast(least(200, count(event)) as int) as committed from papers")
def _(s, d):
    path = scratch(s, "sample")
    sample = sampling.stratified_sample(_papers(s, d), "paper_id", "event", 200).select("paper_id", F.nullif("event", F.lit("")).alias("event"))
    sinks.write(sample, "csv", path)
    back = s.read.option("header", True).csv(path)
    differing = sampling.sample_difference(sample, back).agg(F.count("*").cast("int").alias("differing"))
    return differing.join(F.broadcast(back.agg(F.count("*").cast("int").alias("committed"))))


_INTERVAL = """
with recursive c as (select event, count(*) filter (where length({text}) >= 100) as valid, count(*) as n from papers group by 1),
b as (
  select event, n, valid, side, case when side = 'low' then valid else valid + 1 end as k, case when side = 'low' then 0.025 else 0.975 end as target, 0.0::double as lo, 1.0::double as hi, 0 as it from c, (values ('low'), ('high')) s(side)
  union all
  select event, n, valid, side, k, target, case when tail < target then (lo + hi) / 2 else lo end, case when tail < target then hi else (lo + hi) / 2 end, it + 1
  from (select *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) as tail from b where it < 50 and k between 1 and n))
select c.event, round(case when valid = 0 then 0.0 else (select (lo + hi) / 2 from b where b.event is not distinct from c.event and side = 'low' and it = 50) end, 6) as low,
  round(case when valid = n then 1.0 else (select (lo + hi) / 2 from b where b.event is not distinct from c.event and side = 'high' and it = 50) end, 6) as high from c
""".format(text=Q.COLLAPSE.format("abstract"))


@query("stat_01_exact_interval", _INTERVAL)
def _(s, d):
    valid = F.count_if(F.length(text.collapse(F.col("abstract"))) >= 100)
    n = _papers(s, d).groupBy("event").agg(valid.alias("valid"), F.count("*").alias("n"))
    return n.withColumn("i", stats.binomial_interval("valid", "n")).select("event", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


# --- audits and claims --------------------------------------------------------------------------------------
_DOI = r"nullif(regexp_replace(lower(regexp_extract(ee, '(10\.\d{4,9}/[^\s\"<>]+)', 1, 'i')), '[.,;:)\]}]+$', ''), '')"
_TEXT = Q.COLLAPSE.format("abstract")
_CACHE_EVIDENCE = f"c as (select p.paper_id, case when right(p.paper_id, 1) in ('2', '3') then 'openalex;crossref' else 'openalex' end as raw, p.d from (select paper_id, {_DOI} as d from papers where {_TEXT} <> '' and right(paper_id, 1) in ('0', '1', '2', '3', '4')) p where d is not null)"


def _cache(s: SparkSession, d: str) -> DataFrame:
    """``(key, value)`` of a cache: the abstracts of half of the papers by the last digit of the id, some twice, some with another text."""
    rows = _papers(s, d).where("ee is not null").select("paper_id", "ee", "abstract", F.right("paper_id", F.lit(1)).alias("last"))
    doi = derived.doi_anywhere(F.col("ee"))
    first = rows.where("last in ('0', '1', '2', '3', '4')").select(F.concat(F.lit("openalex_"), doi).alias("key"), F.concat(F.lit(" "), "abstract").alias("value"))
    second = rows.where("last in ('2', '3')").select(F.concat(F.lit("crossref_"), doi).alias("key"), F.col("abstract").alias("value"))
    other = rows.where("last in ('5', '6')").select(F.concat(F.lit("crossref_"), doi).alias("key"), F.lit("another text").alias("value"))
    return first.unionByName(second).unionByName(other).where("key is not null and value is not null")


_ENTRIES = f"""
rows as (select paper_id, {_DOI} as doi, {_TEXT} as t, right(paper_id, 1) as last from papers where ee is not null),
entries as (select 'openalex' as source, doi, t from rows where last in ('0', '1', '2', '3', '4') and t <> '' union all select 'crossref', doi, t from rows where last in ('2', '3') and t <> '' union all select 'crossref', doi, 'another text' from rows where last in ('5', '6')),
c as (select r.paper_id, string_agg(distinct e.source, ';' order by e.source) as sources, count(*) as entries from rows r join entries e on e.doi = r.doi and e.t = r.t where r.doi is not null and r.t <> '' group by 1),
l as (select p.paper_id, count(*) as n from papers p join abstract_log l on l.paper_id = p.paper_id and {Q.COLLAPSE.format('l.abstract')} = {Q.COLLAPSE.format('p.abstract')} where l.status = 'ok' and {Q.COLLAPSE.format('l.abstract')} <> '' group by 1)
"""
_FIVE = "select p.paper_id, case when " + _TEXT + " = '' then 'missing_abstract' when l.paper_id is not null and c.paper_id is not null then 'exact_log_and_cache' when l.paper_id is not null then 'exact_log' when c.paper_id is not null then 'exact_cache' else 'unresolved' end as evidence_status from papers p left join l using (paper_id) left join c using (paper_id)"


@query("join_06_cache_evidence", f"with {_ENTRIES} select paper_id, sources, entries from c")
def _(s, d):
    got = audit.cache_evidence(_papers(s, d), _cache(s, d))
    return got.select("paper_id", F.array_join("sources", ";").alias("sources"), "entries")


@query("aud_02_cache", f"with {_ENTRIES} select count(*) as papers, count(*) filter (where contains(sources, ';')) as from_both, sum(entries)::bigint as entries from c")
def _(s, d):
    got = audit.cache_evidence(_papers(s, d), _cache(s, d))
    return got.agg(F.count("*").alias("papers"), F.count_if(F.size("sources") > 1).alias("from_both"), F.sum("entries").alias("entries"))


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return audit.guarded_audit(_papers(s, d), table(s, d, "abstract_log"), _cache(s, d))[0]


@query("aud_03_five_statuses", f"with {_ENTRIES} {_FIVE}")
def _(s, d):
    return _manifest(s, d).select("paper_id", "evidence_status")


@query("join_07_provenance", f"with {_ENTRIES} select evidence_status, count(*) as n from ({_FIVE}) group by 1")
def _(s, d):
    return _manifest(s, d).groupBy("evidence_status").agg(F.count("*").alias("n"))


@query("agg_30_from_csv", f"with {_ENTRIES} select count(*) filter (where starts_with(evidence_status, 'exact_')) as supported, count(*) filter (where evidence_status = 'unresolved') as unresolved, count(*) filter (where evidence_status = 'missing_abstract') as missing from ({_FIVE})")
def _(s, d):
    path = scratch(s, "manifest")
    sinks.write_audit(_manifest(s, d).select("paper_id", "evidence_status"), path, ["paper_id"])
    rows = s.read.option("header", True).csv(path)
    return audit.provenance_summary(rows).select(F.col("exact").alias("supported"), "unresolved", "missing")


@query("aud_04_guarded", f"with {_ENTRIES} select count(*) as papers, count(*) filter (where starts_with(evidence_status, 'exact_')) as exact from ({_FIVE})")
def _(s, d):
    papers = _papers(s, d)
    files = papers.agg(F.sha2(F.count("*").cast("string"), 256).alias("sha256")).select(F.lit("papers").alias("role"), F.lit("papers.parquet").alias("path"), F.lit(0).alias("bytes"), "sha256")
    audit.verify_inputs(files, {"papers": files.first().sha256})
    return audit.guarded_audit(papers, table(s, d, "abstract_log"), _cache(s, d), {"papers": papers.count()})[1].select("papers", "exact")


@query("aud_05_changed_digests", "select paper_id from papers where right(paper_id, 1) = '7'")
def _(s, d):
    sample = _papers(s, d).select("paper_id", hashing.text_digest(F.col("abstract")).alias("abstract_sha256"))
    now = _papers(s, d).withColumn("abstract", F.when(F.right("paper_id", F.lit(1)) == "7", F.concat(F.coalesce("abstract", F.lit("")), F.lit(" changed"))).otherwise(F.col("abstract")))
    return audit.digest_mismatches(sample, now).select("paper_id")


_HIT = "(contains(lower(title), '{0}') or contains(lower(coalesce(abstract, '')), '{0}'))"
_CLAIMS = {
    "records": "count(*)", "abstracts": "count(*) filter (where coalesce(abstract, '') <> '')", "entries": "count(*) filter (where coalesce(bibtex, '') <> '')",
    "both": "count(*) filter (where coalesce(abstract, '') <> '' and coalesce(bibtex, '') <> '')", "abstract_only": "count(*) filter (where coalesce(abstract, '') <> '' and coalesce(bibtex, '') = '')",
    "entry_only": "count(*) filter (where coalesce(abstract, '') = '' and coalesce(bibtex, '') <> '')", "abstract_pct": "100.0 * count(*) filter (where coalesce(abstract, '') <> '') / count(*)",
    "entry_pct": "100.0 * count(*) filter (where coalesce(bibtex, '') <> '') / count(*)", "distinct_keys": "count(distinct key)", "repeated_dois": "count(*) filter (where trim(ee) <> '') - count(distinct case when trim(ee) <> '' then ee end)",
    "before_2019": "count(*) filter (where year < 2019)", "in_2024": "count(*) filter (where year = 2024)", "venues_without_abstract": "count(distinct case when coalesce(abstract, '') = '' then event end)",
    "fuzzing": f"count(*) filter (where {_HIT.format('fuzzing')})", "phishing": f"count(*) filter (where {_HIT.format('phishing')})", "intrusion_refined": f"count(*) filter (where {_HIT.format('intrusion')} and year between 2021 and 2026 and event not in ('NetTrust'))",
    "recent_entries": "count(*) filter (where year > 2022 and coalesce(bibtex, '') <> '')", "cohort": f"count(*) filter (where year in (2024, 2025) and event in {_SCOPE})",
}


@query("claim_02_table", " union all ".join(f"select '{k}' as claim, cast(({v}) as double) as observed, 0.0::double as expected, 1000.0::double as tolerance, abs({v}) <= 1000 as ok from papers" for k, v in _CLAIMS.items()))
def _(s, d):
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    a, b, n = filled("abstract"), filled("bibtex"), F.count("*")
    hit = lambda term: search.has("title", term) & F.col("title").isNotNull() | search.has("abstract", term)
    some = F.trim("ee") != ""
    observed = {
        "records": n, "abstracts": F.count_if(a), "entries": F.count_if(b), "both": F.count_if(a & b), "abstract_only": F.count_if(a & ~b), "entry_only": F.count_if(~a & b), "abstract_pct": F.count_if(a) * 100.0 / n,
        "entry_pct": F.count_if(b) * 100.0 / n, "distinct_keys": F.count_distinct("key"), "repeated_dois": F.count_if(some) - F.count_distinct(F.when(some, F.col("ee"))), "before_2019": F.count_if(F.col("year") < 2019),
        "in_2024": F.count_if(F.col("year") == 2024), "venues_without_abstract": F.count_distinct(F.when(~a, F.col("event"))), "fuzzing": F.count_if(hit("fuzzing")), "phishing": F.count_if(hit("phishing")),
        "intrusion_refined": F.count_if(hit("intrusion") & F.col("year").between(2021, 2026) & ~F.col("event").isin("NetTrust")), "recent_entries": F.count_if((F.col("year") > 2022) & b), "cohort": F.count_if(F.col("year").isin(2024, 2025) & F.col("event").isin(*SCOPE_EVENTS)),
    }
    return audit.corpus_claims(_papers(s, d), observed, dict.fromkeys(observed, (0, 1000)))


# --- service states -----------------------------------------------------------------------------------------
_BREAKER = """
with recursive once as (select distinct on (call_id) service, call_id, called_at, status from service_calls),
r as (select *, row_number() over (partition by service order by called_at, call_id) as rn, epoch_us(called_at) as ts from once),
st as (
  select service, 0::bigint as rn, null::bigint as call_id, 'CLOSED' as state, false as refused, 0 as failed, 0 as good, 0::bigint as last from (select distinct service from once)
  union all
  select service, rn, call_id, case when refused then 'OPEN' when ok and s1 = 'HALF_OPEN' and g1 + 1 >= 2 then 'CLOSED' when not ok and failed + 1 >= 5 then 'OPEN' else s1 end, refused,
    case when refused then failed when ok then 0 else failed + 1 end, case when refused then good when ok and s1 = 'HALF_OPEN' then g1 + 1 else g1 end, case when refused or ok then last else ts end
  from (select r.service, r.rn, r.call_id, r.ts, r.status = 'ok' as ok, st.failed, st.good, st.last, st.state = 'OPEN' and r.ts - st.last < 60000000 as refused,
      case when st.state = 'OPEN' and r.ts - st.last >= 60000000 then 'HALF_OPEN' else st.state end as s1, case when st.state = 'OPEN' and r.ts - st.last >= 60000000 then 0 else st.good end as g1
    from st join r on r.service = st.service and r.rn = st.rn + 1))
select service, call_id, state, refused from st where rn > 0
"""


@query("strm_05_breaker", _BREAKER)
def _(s, d):
    return flows.breaker_states(table(s, d, "service_calls"))


@query("strm_06_backoff", "with once as (select call_id, any_value(service) as service, min(called_at) as ts, min(status) as status from service_calls group by 1), good as (select service, max(row(ts, call_id)) filter (where status = 'ok') as g from once group by 1) select service, count(*) filter (where status <> 'ok' and (g is null or row(ts, call_id) > g)) as failures, count(*) filter (where status = 'throttled') as blocks, cast(case when count(*) filter (where status = 'throttled') > 0 then least(3600, 60 * pow(2, least(30, count(*) filter (where status = 'throttled') - 1))) else 0 end as int) as wait_s from once join good using (service) group by 1")
def _(s, d):
    return flows.backoff(table(s, d, "service_calls"))


@query("strm_07_attempts", "select service, sum(greatest(attempts - 1, 0))::bigint as retries, max(attempts) as most, count(*) filter (where attempts > 1 and status = 'ok') as recovered from (select distinct on (call_id) * from service_calls) group by 1")
def _(s, d):
    return aggregates.retries(table(s, d, "service_calls"))


@query("src_25_recorded_calls", "select operation, count(distinct call_id) as calls, count(distinct case when status = 'ok' then call_id end) as answered from service_calls group by 1")
def _(s, d):
    once = table(s, d, "service_calls").dropDuplicates(["call_id"])
    return once.groupBy("operation").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "ok").alias("answered"))
