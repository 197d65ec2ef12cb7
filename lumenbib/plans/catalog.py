"""The reference's operators as named queries over the test tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions import bibtex, derived, hashing, stats, text
from lumenbib.operators import aggregates, audit, dml, readiness, records, sampling, search, similarity
from lumenbib.plans import sql as Q
from lumenbib.plans.registry import QUERIES, SQL, Query
from lumenbib.plans.registry import query as _query
from lumenbib.schema import split_valid_years
from lumenbib.session import table
from lumenbib.sources import records as sources
from lumenbib.streaming import flows

TERMS = ["fuzzing", "intrusion", "phishing", "ransom", "side-channel"]
SCOPE_EVENTS = ["Sentinel Symposium", "CIPHER Conf", "ACSYS Security"]


def _papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def _preprints(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preprints")


def _matches(s: SparkSession, d: str) -> DataFrame:
    return similarity.find_matches(_papers(s, d), _preprints(s, d))


# --- sources and projections --------------------------------------------------------------------------------
@_query("src_01_all_papers", "select paper_id, title, event, year from papers")
def _(s, d):
    return search.ordered(_papers(s, d)).select("paper_id", "title", "event", "year")


@_query("src_02_by_id", "select paper_id, title from papers where paper_id = (select min(paper_id) from papers)")
def _(s, d):
    p = _papers(s, d)
    least = p.agg(F.min("paper_id").alias("paper_id"))
    return p.join(F.broadcast(least), "paper_id", "left_semi").select("paper_id", "title")


@_query("src_20_windows", "select y as year, y || '01010000' as start, y || '12312359' as stop from range(2016, 2027) t(y)")
def _(s, d):
    return sources.year_windows(s, 2016, 2026)


@_query("proj_01_doi", f"select paper_id, {Q.DOI} as doi, {Q.DOI_ANY} as doi_any, {Q.DOI_URL} as doi_url from papers")
def _(s, d):
    ee = F.col("ee")
    return _papers(s, d).select("paper_id", derived.doi(ee).alias("doi"), derived.doi_anywhere(ee).alias("doi_any"), derived.doi_of_url(ee).alias("doi_url"))


@_query("proj_04_first_author", "select paper_id, nullif(trim(split_part(authors, ',', 1)), '') as first_author from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", derived.first_author(F.col("authors")).alias("first_author"))


@_query("proj_05_words", r"select doc_id, case when text is null then 0 else len(list_filter(regexp_split_to_array(text, '[\s\x{85}\p{Z}\x1c-\x1f\x0b]+'), lambda x: x <> '')) end as n from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


@_query("proj_06_cite", r"select paper_id, nullif(regexp_extract(bibtex, '@\w+\{([^,\s]+)\s*,', 1), '') as cite_key, '\cite{' || nullif(regexp_extract(bibtex, '@\w+\{([^,\s]+)\s*,', 1), '') || '}' as cite from papers")
def _(s, d):
    b = F.col("bibtex")
    return _papers(s, d).select("paper_id", derived.cite_key(b).alias("cite_key"), derived.cite_command(b).alias("cite"))


@_query("proj_08_class", f"select paper_id, {Q.CLASS} as paper_class from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", derived.paper_class(F.col("title"), F.col("event")).alias("paper_class"))


@_query("proj_09_preview", r"select paper_id, case when abstract is null or abstract = '' then '—' when length(trim(abstract, e' \t\n\r')) <= 280 then trim(abstract, e' \t\n\r') else regexp_replace(substring(trim(abstract, e' \t\n\r'), 1, 280), ' [^ ]*$', '') || '…' end as preview from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", derived.preview(F.col("abstract")).alias("preview"))


@_query("proj_10_page_rows", "select paper_id, title, case when coalesce(authors, '') = '' then '—' when length(authors) > 90 then substring(authors, 1, 90) || '…' else authors end as authors, coalesce(nullif(event, ''), '—') as event, year, coalesce(nullif(ee, ''), nullif(url, ''), '') as link from papers")
def _(s, d):
    return derived.page_rows(_papers(s, d)).drop("abstract")


@_query("proj_11_export", f"select paper_id, title, authors, event, year, paper_type, {Q.CLASS} as paper_class, {Q.DOI} as doi, ee, pages, abstract, " + r"nullif(regexp_extract(bibtex, '@\w+\{([^,\s]+)\s*,', 1), '') as cite_key from papers")
def _(s, d):
    return derived.export_rows(_papers(s, d)).drop("abstract_words")


@_query("proj_12_brief", "select title, substring(authors, 1, 50) as authors, event, year from papers")
def _(s, d):
    return derived.brief_rows(_papers(s, d))


@_query("proj_14_label", "select paper_id, '[' || year || '] ' || title as label from papers where year is not null and title is not null")
def _(s, d):
    return _papers(s, d).where("year is not null and title is not null").select("paper_id", derived.detail_label(F.col("year"), F.col("title")).alias("label"))


@_query("proj_15_end_authors", "select arxiv_id, authors[1] as first, authors[-1] as senior from preprints where len(authors) > 0")
def _(s, d):
    a = F.col("authors")
    return _preprints(s, d).where(F.size(a) > 0).select("arxiv_id", derived.end_author(a, 1)[0].alias("first"), derived.end_author(a, -1)[0].alias("senior"))


# --- filters, orders, limits --------------------------------------------------------------------------------
@_query("filt_01_search", "select paper_id from papers where (contains(lower(coalesce(title, '')), 'fuzzing') or contains(lower(coalesce(abstract, '')), 'fuzzing')) and event = 'CIPHER Conf' and contains(lower(coalesce(authors, '')), 'an')")
def _(s, d):
    return search.search(_papers(s, d), search.SearchFilters(technology="Fuzzing", event="CIPHER Conf", author="AN")).select("paper_id")


@_query("filt_02_like", "select paper_id from papers where title ilike '%mem_ry%' or abstract ilike '%mem_ry%'")
def _(s, d):
    return search.like_search(_papers(s, d), "mem_ry").select("paper_id")


@_query("filt_04_refined", "select paper_id from papers where (contains(lower(coalesce(title,'')), 'phishing') or contains(lower(coalesce(abstract,'')), 'phishing')) and year between 2019 and 2023 and event not in ('NetTrust', 'HardSec')")
def _(s, d):
    return search.refined(_papers(s, d), "phishing", 2019, 2023, ["NetTrust", "HardSec"]).select("paper_id")


@_query("filt_05_no_entry", "select paper_id from papers where coalesce(bibtex, '') = '' and coalesce(key, '') <> ''")
def _(s, d):
    return search.lacking_entry(_papers(s, d)).select("paper_id")


@_query("filt_06_no_abstract", "select paper_id from papers where coalesce(abstract, '') = '' and event = 'NetTrust'")
def _(s, d):
    return search.lacking_abstract(_papers(s, d), "NetTrust").select("paper_id")


@_query("filt_07_fetchable", f"select paper_id from papers where coalesce(abstract, '') = '' and coalesce(ee, '') <> '' and {Q.DOI} is not null")
def _(s, d):
    return search.fetchable(_papers(s, d)).select("paper_id")


@_query("filt_08_length", r"select paper_id from papers where len(list_filter(regexp_split_to_array(coalesce(abstract, ''), '\s+'), lambda x: x <> '')) between 1 and 150")
def _(s, d):
    return search.length_class(_papers(s, d), "short").select("paper_id")


@_query("filt_09_with_entry", "select paper_id from papers where coalesce(bibtex, '') <> ''")
def _(s, d):
    return search.with_entry(_papers(s, d)).select("paper_id")


@_query("filt_10_classes", f"select paper_id from papers where {Q.CLASS} in ('SoK', 'Poster')")
def _(s, d):
    return search.of_classes(_papers(s, d), ["SoK", "Poster"]).select("paper_id")


@_query("filt_13_cohort", "select arxiv_id from preprints where starts_with(submitted_at, '2023')")
def _(s, d):
    return search.cohort(_preprints(s, d), 2023).select("arxiv_id")


@_query("filt_14_scope", "select paper_id from papers where year between 2019 and 2024 and event in ('Sentinel Symposium', 'CIPHER Conf', 'ACSYS Security') and title is not null and authors is not null")
def _(s, d):
    return search.in_scope(_papers(s, d), SCOPE_EVENTS, (2019, 2024)).select("paper_id")


@_query("filt_16_valid", f"select paper_id from papers where length({Q.COLLAPSE.format('abstract')}) >= 100 and lower({Q.COLLAPSE.format('abstract')}) not in ('true','false','null','undefined','error')")
def _(s, d):
    from lumenbib.functions.abstracts import is_valid_abstract

    return _papers(s, d).where(is_valid_abstract(F.col("abstract"))).select("paper_id")


@_query("filt_20_years", "select count(*) filter (where year between 2018 and 2024) as valid, count(*) filter (where year is null or year not between 2018 and 2024) as rejected from papers")
def _(s, d):
    good, bad = split_valid_years(_papers(s, d), 2018, 2024)
    return good.agg(F.count("*").alias("valid")).join(F.broadcast(bad.agg(F.count("*").alias("rejected"))))


@_query("lim_01_top", "select paper_id, title, year from papers where contains(lower(title), 'towards') order by year desc nulls last, event nulls first, title nulls first, paper_id limit 50")
def _(s, d):
    return search.search(_papers(s, d), search.SearchFilters(title="towards"), 50).select("paper_id", "title", "year")


@_query("lim_03_page", "select paper_id, title from papers order by lower(coalesce(title, '')), year desc nulls last, event nulls first, title nulls first, paper_id limit 100 offset (select 100 * least(2, (greatest(count(*), 1) - 1) // 100) from papers)")
def _(s, d):
    return search.page(_papers(s, d), 3, 100, "title").select("paper_id", "title")


# --- scalar rules -------------------------------------------------------------------------------------------
@_query("scal_02_author_keys", f"select distinct name, {Q.AUTHOR} as normal, {Q.AUTHOR_KEY} as akey, {Q.STRICT_KEY} as skey from (select unnest(authors) as name from preprints)")
def _(s, d):
    rows = _preprints(s, d).select(F.explode("authors").alias("name")).distinct().withColumn("normal", text.normalize_author(F.col("name")))
    return rows.select("name", "normal", text.author_key(F.col("normal")).alias("akey"), text.strict_author_key(F.col("normal")).alias("skey"))


@_query("scal_04_title_tokens", f"select paper_id, array_to_string(list_sort({Q.TITLE_TOKENS}), ' ') as tokens from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", F.array_join(F.array_sort(text.title_tokens(F.col("title"))), " ").alias("tokens"))


@_query("scal_06_token_sets", "select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as n from documents where text is not null and len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", text.token_set(F.col("text")).alias("t"))
    return rows.where("t is not null").select("doc_id", F.size("t").alias("n"))


@_query("scal_08_parse_authors", "select paper_id, array_to_string(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> ''), ';') as names from papers where authors is not null")
def _(s, d):
    return _papers(s, d).where("authors is not null").select("paper_id", F.array_join(text.parse_authors(F.col("authors")), ";").alias("names"))


@_query("scal_09_lag", "select arxiv_id, cast(floor((epoch_us(make_timestamp(2024, 7, 1, 0, 0, 0)) - epoch_us(cast(submitted_at as timestamptz))) / 86400000000) as int) as lag from (select distinct arxiv_id, submitted_at from preprints)")
def _(s, d):
    once = _preprints(s, d).select("arxiv_id", "submitted_at").distinct()
    return once.select("arxiv_id", text.lag_days(F.col("submitted_at"), F.lit(2024)).alias("lag"))


@_query("scal_18_extractor", "select paper_id, case when contains(lower(event),'usenix') or contains(lower(event),'uss') then 'usenix' when contains(lower(event),'ndss') then 'ndss' when contains(lower(event),'ieee') or contains(lower(event),'euro s&p') or contains(lower(event),'communications surveys') or contains(lower(event),'comsur') or contains(lower(event),'s&p') then 'ieee' else 'acm' end as extractor from (select paper_id, coalesce(event, '') as event from papers)")
def _(s, d):
    return _papers(s, d).select("paper_id", text.extractor_name(F.col("event")).alias("extractor"))


@_query("scal_24_entries", Q.ENTRY)
def _(s, d):
    return _papers(s, d).select("paper_id", bibtex.entry_of_paper().alias("entry"))


@_query("scal_29_events", f"select paper_id, {Q.EVENT} as event from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", text.normalize_event(F.col("venue")).alias("event"))


@_query("scal_30_types", "select paper_id, case lower(trim(paper_type)) when 'article' then 'article' when 'inproceedings' then 'article' when 'proceedings' then 'proceedings' when 'editorship' then 'editorship' else 'unknown' end as kind from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", text.normalize_type(F.col("paper_type")).alias("kind"))


@_query("scal_33_key_tail", "select distinct cache_key, coalesce(lower(nullif(substring(cache_key, nullif(strpos(cache_key, '_'), 0) + 1), '')), '') as tail from service_calls where cache_key is not null")
def _(s, d):
    return table(s, d, "service_calls").where("cache_key is not null").select("cache_key").distinct().select("cache_key", text.key_tail(F.col("cache_key")).alias("tail"))


@_query("hash_01_digests", f"select paper_id, sha256({Q.COLLAPSE.format('abstract')}) as digest from papers")
def _(s, d):
    return _papers(s, d).select("paper_id", hashing.text_digest(F.col("abstract")).alias("digest"))


# --- joins --------------------------------------------------------------------------------------------------
@_query("join_01_staged", "with st as (select paper_id, arg_max(abstract, log_id) as a from abstract_log where length(abstract) >= 50 group by 1) select count(*) as scanned, count(p.paper_id) as matched, count(*) filter (where p.paper_id is not null and coalesce(p.abstract, '') = '') as updated, count(*) filter (where coalesce(p.abstract, '') <> '') as skipped_existing, count(*) filter (where p.paper_id is null) as missing_in_db from st left join papers p using (paper_id)")
def _(s, d):
    return dml.fill_abstracts(_papers(s, d), table(s, d, "abstract_log").select("paper_id", "abstract", "log_id"), "log_id")[1]


@_query("join_02_filled", "with st as (select paper_id, arg_max(abstract, log_id) as a from abstract_log where length(abstract) >= 50 group by 1) select p.paper_id, case when coalesce(p.abstract, '') = '' then coalesce(st.a, p.abstract) else p.abstract end as abstract from papers p left join st using (paper_id)")
def _(s, d):
    return dml.fill_abstracts(_papers(s, d), table(s, d, "abstract_log").select("paper_id", "abstract", "log_id"), "log_id")[0].select("paper_id", "abstract")


@_query("join_03_author_blocks", f"with p as (select distinct paper_id, {Q.AUTHOR_KEY} as k from (select paper_id, unnest(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> '')) as name from papers)), x as (select distinct arxiv_id, {Q.AUTHOR_KEY} as k from (select arxiv_id, unnest(authors) as name from preprints)) select paper_id, arxiv_id, string_agg(k, ';' order by k) as shared from p join x using (k) where k <> '' group by 1, 2")
def _(s, d):
    pairs = similarity.author_blocked_pairs(_papers(s, d), _preprints(s, d))
    return pairs.select("paper_id", "arxiv_id", F.array_join("shared_authors", ";").alias("shared"))


@_query("join_04_published", f"with p as (select distinct {Q.TITLE_TOKENS} as t from papers), x as (select distinct arxiv_id, {Q.TITLE_TOKENS} as t from preprints) select distinct arxiv_id from x, p where len(list_intersect(x.t, p.t)) >= 0.6 * (len(x.t) + len(p.t) - len(list_intersect(x.t, p.t))) - 1e-12 and len(x.t) > 0 and len(p.t) > 0")
def _(s, d):
    return readiness.outcomes(_preprints(s, d).dropDuplicates(["arxiv_id"]), _papers(s, d), 0.6).where("best is not null").select("arxiv_id")


@_query("join_05_log_evidence", f"select p.paper_id, string_agg(distinct l.source, ';' order by l.source) as sources, count(*) as rows from papers p join abstract_log l on l.paper_id = p.paper_id and {Q.COLLAPSE.format('l.abstract')} = {Q.COLLAPSE.format('p.abstract')} where l.status = 'ok' and {Q.COLLAPSE.format('l.abstract')} <> '' group by 1")
def _(s, d):
    return audit.log_evidence(_papers(s, d), table(s, d, "abstract_log")).select("paper_id", F.array_join("sources", ";").alias("sources"), "rows")


# --- aggregations -------------------------------------------------------------------------------------------
@_query("agg_01_totals", "select count(*) as total, count(*) filter (where coalesce(abstract, '') <> '') as with_abstract, count(*) filter (where coalesce(abstract, '') = '') as without_abstract, count(*) filter (where coalesce(bibtex, '') <> '') as with_bibtex from papers")
def _(s, d):
    return aggregates.totals(_papers(s, d))


@_query("agg_02_by_event", "select event, count(*) as n from papers group by 1")
def _(s, d):
    return aggregates.counts_by(_papers(s, d), "event").orderBy(F.desc("n"))


@_query("agg_03_by_year", "select year, count(*) as n from papers group by 1")
def _(s, d):
    return aggregates.counts_by(_papers(s, d), "year").orderBy(F.desc("year"))


@_query("agg_05_coverage", "select event, count(*) as total, count(*) filter (where coalesce(abstract, '') <> '') as with_abstract, count(*) filter (where coalesce(bibtex, '') <> '') as with_bibtex, 100.0 * count(*) filter (where coalesce(abstract, '') <> '') / count(*) as abstract_pct, 100.0 * count(*) filter (where coalesce(bibtex, '') <> '') / count(*) as bibtex_pct from papers group by 1")
def _(s, d):
    return aggregates.coverage_by(_papers(s, d), "event")


@_query("agg_06_by_class", f"select {Q.CLASS} as paper_class, count(*) as n from papers group by 1")
def _(s, d):
    return aggregates.counts_by_class(_papers(s, d))


@_query("agg_08_cross", "select count(*) filter (where coalesce(abstract, '') <> '' and coalesce(bibtex, '') <> '') as both, count(*) filter (where coalesce(abstract, '') <> '' and coalesce(bibtex, '') = '') as only_abstract, count(*) filter (where coalesce(abstract, '') = '' and coalesce(bibtex, '') <> '') as only_bibtex from papers")
def _(s, d):
    return aggregates.cross_coverage(_papers(s, d))


@_query("agg_09_keys", "select count(distinct key) as distinct_keys, count(*) - count(distinct ee) as ee_excess from papers")
def _(s, d):
    return aggregates.key_counts(_papers(s, d))


@_query("agg_10_identity", "select count(*) as duplicate_groups from (select 1 from papers group by lower(trim(title)), lower(trim(authors)), year, pages having count(*) > 1)")
def _(s, d):
    return aggregates.identity_groups(_papers(s, d))


@_query("agg_12_missing", "select event, count(*) as n from papers where coalesce(abstract, '') = '' group by 1")
def _(s, d):
    return aggregates.missing_by_event(_papers(s, d))


@_query("agg_13_keywords", "select term, year, count(*) as n from papers, (values ('fuzzing'), ('intrusion'), ('phishing'), ('ransom'), ('side-channel')) t(term) where contains(lower(coalesce(title, '')), term) or contains(lower(coalesce(abstract, '')), term) group by 1, 2")
def _(s, d):
    return aggregates.keyword_hits(_papers(s, d), TERMS, "year")


_ONCE = "(select distinct on (call_id) * from service_calls)"


@_query("agg_14_services", f"select service, operation, count(*) as requests, cast(sum(attempts) as bigint) as attempts, cast(sum(items) as bigint) as items, count(*) filter (where status = 'ok') as ok, quantile_cont(latency_ms, 0.5) filter (where status = 'ok') as median_ms, quantile_disc(latency_ms, 0.95) filter (where status = 'ok') as p95_ms, round(sum(server_reported_api_budget_metering_usd), 6) as metered_usd, count(server_reported_api_budget_metering_usd) as metered_requests, count(server_reported_api_budget_metering_usd) = count(*) as metering_complete from {_ONCE} group by 1, 2")
def _(s, d):
    return aggregates.service_summary(table(s, d, "service_calls"))


@_query("agg_14_status", f"select service, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'error') as error from {_ONCE} group by 1")
def _(s, d):
    return aggregates.service_status(table(s, d, "service_calls"), ["ok", "error"])


@_query("agg_21_prolific", f"with k as (select distinct paper_id, {Q.STRICT_KEY} as k from (select paper_id, unnest(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> '')) as name from papers)) select k, count(*) as papers from k where k <> '' group by 1 having count(*) >= 3")
def _(s, d):
    return readiness.prior_authors(_papers(s, d), 3)


@_query("agg_23_dates", "select min(created_at) as min_created_at, max(created_at) as max_created_at, min(updated_at) as min_updated_at, max(updated_at) as max_updated_at from papers")
def _(s, d):
    return aggregates.date_range(_papers(s, d))


@_query("agg_24_log_status", "select source, status, count(*) as n from abstract_log group by 1, 2")
def _(s, d):
    return audit.status_counts(table(s, d, "abstract_log"))


@_query("agg_28_hit_rate", "select service, count(*) filter (where attempts = 0) / count(*) as hit_rate from service_calls group by 1")
def _(s, d):
    return aggregates.hit_rate(table(s, d, "service_calls"))


# --- windows, sets, duplicates ------------------------------------------------------------------------------
@_query("win_01_first_seen", "select paper_id, min(log_id) as log_id from abstract_log group by 1")
def _(s, d):
    return records.first_seen(table(s, d, "abstract_log"), "paper_id", "log_id").select("paper_id", "log_id")


@_query("win_04_last_written", "select paper_id, max(log_id) as log_id from abstract_log group by 1")
def _(s, d):
    return records.last_written(table(s, d, "abstract_log"), "paper_id", "log_id").select("paper_id", "log_id")


@_query("win_06_newest", "select source, log_id from abstract_log qualify row_number() over (partition by source order by log_id desc) <= 5")
def _(s, d):
    return records.newest(table(s, d, "abstract_log"), "source", "log_id", 5).select("source", "log_id")


@_query("set_03_evidence", "with l as (select distinct paper_id from abstract_log where status = 'ok'), c as (select distinct paper_id from service_calls where paper_id is not null) select count(*) as either, count(*) filter (where l.paper_id is not null and c.paper_id is not null) as both, count(*) filter (where c.paper_id is null) as log_only, count(*) filter (where l.paper_id is null) as cache_only from l full join c using (paper_id)")
def _(s, d):
    return records.evidence_sets(table(s, d, "abstract_log").where("status = 'ok'"), table(s, d, "service_calls").where("paper_id is not null"))


@_query("dedup_01_consolidated", "select paper_id from papers where paper_type <> 'editorship' group by 1")
def _(s, d):
    return records.consolidated(_papers(s, d), "paper_id", "created_at").select("paper_id")


@_query("dedup_02_repeated", "select ee, count(*) as n from papers where coalesce(ee, '') <> '' group by 1 having count(*) > 1")
def _(s, d):
    return records.repeated_values(_papers(s, d), "ee")


@_query("strm_08_interleaved", "select source, log_id, row_number() over (partition by source order by sha256(cast(log_id as varchar))) as turn from abstract_log")
def _(s, d):
    return records.interleaved(table(s, d, "abstract_log").select("source", "log_id"), "source", "log_id").select("source", "log_id", "turn")


# --- changes ------------------------------------------------------------------------------------------------
_BATCH = "(select paper_id, max_by(upper(title), log_id) as title, min_by(l.abstract, log_id) filter (where l.abstract is not null) as abstract from abstract_log l join papers p using (paper_id) group by 1)"


@_query("dml_01_upsert", f"select coalesce(p.paper_id, b.paper_id) as paper_id, case when b.paper_id is null then p.title else b.title end as title, coalesce(p.abstract, b.abstract) as abstract, p.bibtex from papers p full join {_BATCH} b on b.paper_id = p.paper_id")
def _(s, d):
    log = table(s, d, "abstract_log").select("paper_id", "log_id", F.col("abstract").alias("a"))
    batch = _papers(s, d).join(log, "paper_id").withColumns({"title": F.upper("title"), "abstract": F.col("a")})
    return dml.upsert(_papers(s, d), dml.fold_batch(batch, "log_id"), "2026-01-01 00:00:00").select("paper_id", "title", "abstract", "bibtex")


@_query("dml_04_update", "select p.paper_id, coalesce(u.a, p.abstract) as abstract from papers p left join (select paper_id, arg_max(abstract, log_id) as a from abstract_log where status = 'ok' group by 1) u using (paper_id)")
def _(s, d):
    new = table(s, d, "abstract_log").where("status = 'ok'").groupBy("paper_id").agg(F.max_by("abstract", "log_id").alias("abstract"))
    return dml.update_column(_papers(s, d), new, "abstract").select("paper_id", "abstract")


@_query("dml_06_entries", "select paper_id, case when coalesce(p.bibtex, '') = '' then coalesce(e.entry, p.bibtex) else p.bibtex end as bibtex from papers p join (" + Q.ENTRY + ") e using (paper_id)")
def _(s, d):
    return dml.fill_entries(_papers(s, d)).select("paper_id", "bibtex")


# --- similarity and studies ---------------------------------------------------------------------------------
_MATCH = f"""
with p as (select distinct paper_id, {Q.AUTHOR_KEY} as k from (select paper_id, unnest(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> '')) as name from papers)),
x as (select distinct arxiv_id, {Q.AUTHOR_KEY} as k from (select arxiv_id, unnest(authors) as name from preprints)),
b as (select paper_id, arxiv_id from p join x using (k) where k <> '' group by 1, 2),
pt as (select paper_id, event, {Q.TITLE_TOKENS} as t from papers), xt as (select distinct arxiv_id, {Q.TITLE_TOKENS} as t from preprints),
m as (select paper_id, arxiv_id, event, len(list_intersect(pt.t, xt.t)) / (len(pt.t) + len(xt.t) - len(list_intersect(pt.t, xt.t))) as sim from b join pt using (paper_id) join xt using (arxiv_id) where len(pt.t) > 0 and len(xt.t) > 0),
found as (select * from m where sim >= 0.55)
"""


@_query("sim_01_matches", _MATCH + "select paper_id, arxiv_id, sim as title_similarity from found")
def _(s, d):
    return similarity.ordered_matches(_matches(s, d)).select("paper_id", "arxiv_id", "title_similarity")


@_query("agg_17_match_rate", _MATCH + "select (select count(*) from papers) as cohort, count(distinct paper_id) as matched, count(distinct paper_id) / (select count(*) from papers) as rate from found")
def _(s, d):
    return similarity.match_rate(_matches(s, d), _papers(s, d))


@_query("agg_18_venues", _MATCH + "select p.event, count(distinct f.paper_id) as matched, count(distinct p.paper_id) as total, count(distinct f.paper_id) / count(distinct p.paper_id) as rate from papers p left join found f on f.paper_id = p.paper_id where p.event is not null group by 1")
def _(s, d):
    return similarity.venue_rates(_matches(s, d), _papers(s, d))


@_query("win_02_least_similar", _MATCH + "select paper_id, arxiv_id from found qualify row_number() over (partition by paper_id order by sim, arxiv_id) = 1")
def _(s, d):
    return similarity.one_per_paper(_matches(s, d)).select("paper_id", "arxiv_id")


@_query("win_03_top5", _MATCH + "select paper_id, sim as title_similarity from (select * from found qualify row_number() over (partition by paper_id order by sim desc, arxiv_id) = 1) order by sim desc, paper_id limit 5")
def _(s, d):
    return similarity.top_matches(_matches(s, d)).select("paper_id", "title_similarity")


@_query("sim_05_agreement", "with a as (select paper_id, source, list_distinct(regexp_extract_all(lower(any_value(abstract)), '[a-z0-9]+')) as t from abstract_log where status = 'ok' group by paper_id, source, abstract), p as (select paper_id, list_distinct(regexp_extract_all(lower(abstract), '[a-z0-9]+')) as t from papers) select source, count(*) filter (where len(p.t) > 0 and len(a.t) > 0 and len(list_intersect(a.t, p.t)) >= 0.95 * (len(a.t) + len(p.t) - len(list_intersect(a.t, p.t))) - 1e-12) as agree, count(*) as n from a join p using (paper_id) group by 1")
def _(s, d):
    log = table(s, d, "abstract_log").where("status = 'ok'").select("paper_id", "source", "abstract").distinct()
    own = _papers(s, d).select("paper_id", text.token_set(F.col("abstract")).alias("pt"))
    pairs = log.withColumn("lt", text.token_set(F.col("abstract"))).join(own, "paper_id")
    return similarity.agreement(pairs.select("source", text.jaccard(F.col("lt"), F.col("pt")).alias("similarity")))


# --- samples, audits, claims --------------------------------------------------------------------------------
@_query("stat_01_interval")
def _(s, d):
    valid = F.count_if(F.length(text.collapse(F.col("abstract"))) >= 100)
    n = _papers(s, d).groupBy("event").agg(valid.alias("valid"), F.count("*").alias("n"))
    return n.withColumn("i", stats.binomial_interval("valid", "n")).select("event", "i.low", "i.high")


_STATUS = f"""
with l as (select p.paper_id, count(*) as c from papers p join abstract_log l on l.paper_id = p.paper_id and {Q.COLLAPSE.format('l.abstract')} = {Q.COLLAPSE.format('p.abstract')} where l.status = 'ok' and {Q.COLLAPSE.format('l.abstract')} <> '' group by 1)
select p.paper_id, case when {Q.COLLAPSE.format('p.abstract')} = '' then 'missing_abstract' when l.paper_id is not null then 'exact_log' else 'unresolved' end as evidence_status from papers p left join l on l.paper_id = p.paper_id
"""


def _no_cache(s: SparkSession) -> DataFrame:
    return s.createDataFrame([], "paper_id string, sources array<string>")


@_query("aud_03_provenance", _STATUS)
def _(s, d):
    log = audit.log_evidence(_papers(s, d), table(s, d, "abstract_log"))
    return audit.provenance(_papers(s, d), log, _no_cache(s)).select("paper_id", "evidence_status")


@_query("agg_26_provenance", f"select count(*) as papers, count(*) filter (where evidence_status = 'exact_log') as exact, count(*) filter (where evidence_status = 'unresolved') as unresolved, count(*) filter (where evidence_status = 'missing_abstract') as missing from ({_STATUS})")
def _(s, d):
    log = audit.log_evidence(_papers(s, d), table(s, d, "abstract_log"))
    return audit.provenance_summary(audit.provenance(_papers(s, d), log, _no_cache(s)))


@_query("claim_01_totals", "select 'total' as claim, cast(count(*) as double) as observed, 1000.0::double as expected, 0.0::double as tolerance, count(*) = 1000 as ok from papers union all select 'with_abstract', cast(count(*) filter (where coalesce(abstract, '') <> '') as double), 950.0, 50.0, abs(count(*) filter (where coalesce(abstract, '') <> '') - 950) <= 50 from papers union all select 'with_bibtex', cast(count(*) filter (where coalesce(bibtex, '') <> '') as double), 900.0, 100.0, abs(count(*) filter (where coalesce(bibtex, '') <> '') - 900) <= 100 from papers")
def _(s, d):
    return audit.claims(aggregates.totals(_papers(s, d)), {"total": (1000, 0), "with_abstract": (950, 50), "with_bibtex": (900, 100)})


# --- further single operators -------------------------------------------------------------------------------
@_query("filt_03_keyword", "select count(*) as n from papers where contains(lower(title), 'fuzzing') or contains(lower(coalesce(abstract, '')), 'fuzzing')")
def _(s, d):
    return _papers(s, d).where(search.has("title", "fuzzing") | search.has("abstract", "fuzzing")).agg(F.count("*").alias("n"))


@_query("filt_11_no_editorship", "select paper_id from papers where paper_type <> 'editorship'")
def _(s, d):
    return _papers(s, d).where("paper_type <> 'editorship'").select("paper_id")


@_query("filt_12_required", "select paper_id from papers where paper_id <> '' and title <> '' and year is not null and year <> 0")
def _(s, d):
    return _papers(s, d).where("paper_id <> '' and title <> '' and year <> 0").select("paper_id")


@_query("filt_19_population", "select event, count(*) as n from papers where trim(coalesce(abstract, '')) <> '' group by 1")
def _(s, d):
    return aggregates.counts_by(_papers(s, d).where(F.trim(F.coalesce("abstract", F.lit(""))) != ""), "event")


@_query("join_12_labels", "with l as (select event, count(*) filter (where status = 'ok') as valid, count(*) as labelled from abstract_log group by 1), p as (select event, count(*) as n from papers group by 1) select event, valid, labelled, n, valid / labelled as rate from l join p using (event)")
def _(s, d):
    labels = table(s, d, "abstract_log").select("event", F.when(F.col("status") == "ok", "valid").otherwise("invalid").alias("label"))
    return aggregates.label_summary(labels, aggregates.counts_by(_papers(s, d), "event"))


@_query("agg_27_weighted", "with l as (select event, count(*) filter (where status = 'ok') as valid, count(*) as labelled from abstract_log group by 1), p as (select event, count(*) as n from papers group by 1) select sum(n * (valid / labelled)) / sum(n) as weighted_rate from l join p using (event)")
def _(s, d):
    labels = table(s, d, "abstract_log").select("event", F.when(F.col("status") == "ok", "valid").otherwise("invalid").alias("label"))
    return aggregates.weighted_rate(aggregates.label_summary(labels, aggregates.counts_by(_papers(s, d), "event")))


@_query("join_13_title_year", "select x.arxiv_id as id, min(p.paper_id) as match from (select distinct arxiv_id, title, cast(left(submitted_at, 4) as int) as y from preprints) x join papers p on regexp_replace(lower(x.title), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(p.title), '[^a-z0-9]+', '', 'g') and abs(x.y - p.year) <= 1 where regexp_replace(lower(x.title), '[^a-z0-9]+', '', 'g') <> '' group by 1")
def _(s, d):
    left = _preprints(s, d).select(F.col("arxiv_id").alias("id"), "title", F.expr("try_cast(left(submitted_at, 4) as int)").alias("year")).distinct()
    return similarity.title_year_match(left, _papers(s, d).select(F.col("paper_id").alias("id"), "title", "year"))


@_query("agg_07_conditional", "select event, avg(case when coalesce(abstract, '') <> '' then 100.0 else 0 end) as pct from papers where year >= 2020 group by 1")
def _(s, d):
    p = _papers(s, d).where("year >= 2020")
    return p.groupBy("event").agg(F.avg(F.when(F.coalesce("abstract", F.lit("")) != "", 100.0).otherwise(0.0)).alias("pct"))


@_query("agg_11_band", "select year, event, count(*) as n from papers where year between 2018 and 2022 group by 1, 2 having count(*) between 3 and 500")
def _(s, d):
    return _papers(s, d).where(F.col("year").between(2018, 2022)).groupBy("year", "event").agg(F.count("*").alias("n")).where(F.col("n").between(3, 500))


@_query("agg_29_overlap", r"with w as (select l.log_id, list_distinct(list_filter(regexp_split_to_array(lower(p.abstract), '[^0-9A-Za-z_]+'), lambda x: x <> '')) as a, list_distinct(list_filter(regexp_split_to_array(lower(l.abstract), '[^0-9A-Za-z_]+'), lambda x: x <> '')) as b from abstract_log l join papers p using (paper_id) where l.status = 'ok' and p.abstract is not null) select log_id, len(list_intersect(a, b)) / greatest(len(b), 1) as overlap from w")
def _(s, d):
    from lumenbib.functions.abstracts import word_overlap

    log = table(s, d, "abstract_log").where("status = 'ok'").select("log_id", "paper_id", F.col("abstract").alias("logged"))
    both = log.join(_papers(s, d).where("abstract is not null").select("paper_id", "abstract"), "paper_id")
    return both.select("log_id", word_overlap(F.col("abstract"), F.col("logged")).alias("overlap"))


@_query("set_04_events", "select distinct event from papers where event is not null")
def _(s, d):
    return _papers(s, d).where("event is not null").select("event").distinct()


@_query("set_05_keys", "select distinct key from papers where coalesce(bibtex, '') = '' and coalesce(key, '') <> ''")
def _(s, d):
    return search.lacking_entry(_papers(s, d)).select("key").distinct()


@_query("set_02_shared_sources", "select l.paper_id, len(list_intersect(l.s, c.s)) as shared from (select paper_id, list_distinct(list(status)) as s from abstract_log group by 1) l join (select paper_id, list_distinct(list(status)) as s from service_calls where paper_id is not null group by 1) c using (paper_id)")
def _(s, d):
    per = lambda t: t.where("paper_id is not null").groupBy("paper_id").agg(F.collect_set("status").alias("s"))
    l, c = per(table(s, d, "abstract_log")), per(table(s, d, "service_calls")).withColumnRenamed("s", "t")  # noqa: E741
    return l.join(c, "paper_id").select("paper_id", F.size(F.array_intersect("s", "t")).alias("shared"))


@_query("scal_31_stable_join", "select paper_id, string_agg(distinct source, ';' order by source) as sources from abstract_log where source <> '' group by 1")
def _(s, d):
    rows = table(s, d, "abstract_log").where("source <> ''").groupBy("paper_id").agg(F.collect_set("source").alias("a"))
    return rows.select("paper_id", text.stable_join(F.col("a")).alias("sources"))


@_query("scal_34_time_shape", "select count(*) filter (where regexp_matches(strftime(logged_at, '%Y-%m-%d %H:%M:%S'), '^20\\d\\d-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d$')) as well_formed, count(*) as n from abstract_log")
def _(s, d):
    return audit.well_formed_times(table(s, d, "abstract_log").select(F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("t")), "t")


@_query("scal_35_iso_time", "select distinct arxiv_id, epoch_us(cast(submitted_at as timestamptz)) as at from preprints")
def _(s, d):
    return _preprints(s, d).select("arxiv_id", F.unix_micros(F.to_timestamp("submitted_at")).alias("at")).distinct()


@_query("scal_36_last_part", "select paper_id, string_split(ee, '/')[-1] as last from papers where ee is not null")
def _(s, d):
    return _papers(s, d).where("ee is not null").select("paper_id", text.last_path_part(F.col("ee")).alias("last"))


@_query("sort_02_orders", "select paper_id, coalesce(event, '') as event, year from papers order by coalesce(event, ''), year desc nulls last")
def _(s, d):
    return search.ordered(_papers(s, d), "event").select("paper_id", F.coalesce("event", F.lit("")).alias("event"), "year")


@_query("hash_04_cache_path", "select distinct cache_key, md5(cache_key) || '.json' as path from service_calls where cache_key is not null")
def _(s, d):
    return table(s, d, "service_calls").where("cache_key is not null").select("cache_key", hashing.cache_path(F.col("cache_key")).alias("path")).distinct()


def queries() -> dict[str, Query]:
    from lumenbib.plans import roundtrips, studies  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
