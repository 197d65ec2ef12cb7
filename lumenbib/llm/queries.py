"""Queries pN_... of the ten problems, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.llm import bpe, chunking, confusables, leakage, linkage, minhash, names, residue, survivor, truncation
from lumenbib.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(s: SparkSession, d: str) -> DataFrame:
    return names.found(table(s, d, "papers"), table(s, d, "preprints"))


def _p1_entities(s: SparkSession, d: str) -> DataFrame:
    known = cut(names.spellings(table(s, d, "papers"), table(s, d, "preprints")))
    return names.entities(known).select("name", F.sha2("entity", 256).alias("entity"))


def _clean(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    papers = table(s, d, "papers")
    bad = cut(residue.found(papers))
    return papers, bad, cut(truncation.found(papers, bad))


def _p2_found(s: SparkSession, d: str) -> DataFrame:
    return minhash.found(*_clean(s, d))


def _p2_groups(s: SparkSession, d: str) -> DataFrame:
    return minhash.duplicate_groups(minhash.clean_abstracts(*_clean(s, d)), "paper_id", "abstract")


def _p3_found(s: SparkSession, d: str) -> DataFrame:
    return survivor.found(table(s, d, "dedup_candidates"), table(s, d, "papers"))


def _p3_records(s: SparkSession, d: str) -> DataFrame:
    return survivor.golden_records(table(s, d, "dedup_candidates"), table(s, d, "papers"))


def _p4_found(s: SparkSession, d: str) -> DataFrame:
    return residue.found(table(s, d, "papers"))


def _p4_reasons(s: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(s, d, "papers")).select("paper_id", F.array_join("evidence", ";").alias("evidence"))


def _p5_found(s: SparkSession, d: str) -> DataFrame:
    papers = table(s, d, "papers")
    return truncation.found(papers, cut(residue.found(papers)))


def _p5_reasons(s: SparkSession, d: str) -> DataFrame:
    papers = table(s, d, "papers")
    rows = truncation.reasons(papers, cut(residue.found(papers)))
    return rows.select("paper_id", F.array_join("evidence", ";").alias("evidence"))


def _p5_sources(s: SparkSession, d: str) -> DataFrame:
    return truncation.source_shares(table(s, d, "abstract_log"))


def _p6_found(s: SparkSession, d: str) -> DataFrame:
    return confusables.affected_fields(table(s, d, "papers"), table(s, d, "preprints"))


def _p6_forms(s: SparkSession, d: str) -> DataFrame:
    values = confusables.field_values(table(s, d, "papers"), table(s, d, "preprints"))
    return confusables.consistent_forms(values).select("table_name", "record_id", "field", "form", "skeleton", "affected")


def _p6_groups(s: SparkSession, d: str) -> DataFrame:
    return confusables.lookalike_groups(confusables.field_values(table(s, d, "papers"), table(s, d, "preprints")))


def _p7_found(s: SparkSession, d: str) -> DataFrame:
    return linkage.found(table(s, d, "papers"), table(s, d, "preprints"))


def _p7_matches(s: SparkSession, d: str) -> DataFrame:
    return linkage.cascade(table(s, d, "papers"), table(s, d, "preprints"))


def _p8_ids(s: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(s, d, "documents"))


def _p9_found(s: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(s, d, "documents"), table(s, d, "eval_items"))


def _p9_templates(s: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(s, d, "documents"), table(s, d, "eval_items"))


def _p10_found(s: SparkSession, d: str) -> DataFrame:
    return chunking.found(table(s, d, "documents"))


def _p10_pieces(s: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(table(s, d, "documents"))


def queries() -> dict[str, Query]:
    return {k[1:]: f for k, f in globals().items() if k.startswith("_p") and k[2].isdigit()}


# The rules of the survivors in SQL's own words.
_CANDIDATES = r"""
with c as (
  select distinct cluster_id, paper_id, title, authors, year, pages, doi, event, lower(coalesce(retention_reason, '')) as r,
         lower(trim(authors)) as la, lower(trim(pages)) as lp, lower(trim(doi)) as ld, lower(trim(event)) as le
  from dedup_candidates where cluster_id is not null and paper_id is not null),
stand_ins as (select ['', 'none', 'null', 'nil', 'nan', 'na', 'n/a', 'n.n.', 'nn', 'n. n.', 'unknown', 'anonymous', 'anon', 'anon.', 'tba', 'tbd', 'pending',
  'missing', 'undefined', 'not available', 'to appear', 'et al.', 'et al', 'and others', '-', '--', '?', '0', '0-0', '0000'] as words),
s as (
  select c.*, p.updated_at,
    coalesce(not list_contains(words, la) and regexp_matches(la, '[\p{L}\p{N}]') and not regexp_matches(la, '(\bet al\.?|\band others|\bu\.\s?a\.|…|\.\.\.)\s*$|^et al'), false) as ok_authors,
    coalesce(year between 1900 and 2100, false) as ok_year,
    coalesce(not list_contains(words, lp) and regexp_matches(lp, '[1-9]') and not contains(lp, '?'), false) as ok_pages,
    coalesce(not list_contains(words, ld) and regexp_matches(ld, '\b10\.[0-9]{4,9}/\S') and not regexp_matches(ld, '/(unknown|none|null|pending|tba)$') and not regexp_matches(ld, '^10\.0+/'), false) as ok_doi,
    coalesce(not list_contains(words, le) and regexp_matches(le, '[\p{L}\p{N}]'), false) as ok_event,
    case when regexp_matches(r, '\bnot (yet )?(been )?(checked|verified|confirmed|reviewed)|\b(unverified|unchecked|unreviewed|automatic|auto-|crawl|scrap|harvest|superseded|obsolete|retracted|upload|imported|search index|guess|copy\b)') then -1
         when regexp_matches(r, '\b(verified|checked|confirmed|curat|publisher|version of record|printed|authoritative|official|manually reviewed)') then 1 else 0 end as trust
  from c cross join stand_ins left join (select paper_id, max(updated_at) as updated_at from papers group by 1) p on p.paper_id = c.paper_id),
ranked as (select *, ok_authors::int + ok_year::int + ok_pages::int + ok_doi::int + ok_event::int as filled from s)
"""
_ORDER = "filled desc, trust desc, coalesce(updated_at, timestamp '1970-01-01') desc, paper_id"


def oracle_sql() -> dict[str, str]:
    """SQL for survivors and affected values; the other problems have brute-force tests instead."""
    p3 = _CANDIDATES + f"select cluster_id, first(paper_id order by {_ORDER}) as paper_id from ranked group by 1"
    best = ", ".join(f"first({f} order by {_ORDER}, cast({f} as varchar)) filter (where ok_{f}) as {f}" for f in survivor.FIELDS)
    records = _CANDIDATES + (
        f"select cluster_id, first(paper_id order by {_ORDER}) as paper_id, first(title order by {_ORDER}, title) as title, {best}, count(distinct paper_id) as records from ranked group by 1"
    )
    p6 = r"""
with v as (
  select 'papers' as table_name, paper_id as record_id, unnest(['title', 'authors']) as field, unnest([title, authors]) as val from papers
  union all select 'preprints', arxiv_id, 'title', title from preprints),
w as (select *, regexp_extract_all(regexp_replace(val, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '[\p{L}\p{M}]+') as words from v where val is not null),
alike as (select '[АВЕКМНОРСТУХІЈЅҺԌԚԜӀаеорсухіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαονρικυϲϳ]' as one, 'авекмнорстухіјѕһԍԛԝӏԁαβεζηικμνορτυχϲϳ' as f, 'abekmhopctyxijshgqwidabezhikmvoptyxcj' as t),
latin as (select distinct unnest(regexp_split_to_array(lower(val), '[^\p{Latin}]+')) as word from v),
marked as (select w.*, list_filter(words, lambda x: regexp_matches(x, '^' || one || '+$') and (length(x) > 1 or regexp_matches(x, '\p{Cyrillic}'))) as whole,
  len(list_filter(words, lambda x: not regexp_matches(x, '\p{Latin}') and regexp_matches(regexp_replace(x, one, '', 'g'), '\p{Cyrillic}'))) > 0 as truly,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{Latin}'))) > 0 as some_latin,
  regexp_matches(val, '[\x{FF01}-\x{FFEF}\x{1D400}-\x{1D7FF}\x{FB00}-\x{FB06}\x{AD}\x{34F}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\t\n\r\v\f\x{85}]') as signs,
  regexp_matches(val, '\p{M}') and nfc_normalize(val) <> val as loose,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{Latin}') and regexp_matches(x, one))) > 0 as mixed
  from w cross join alike),
twins as (select distinct m.table_name, m.record_id, m.field from (select *, unnest(whole) as x from marked where some_latin and not truly) m cross join alike join latin on latin.word = translate(lower(m.x), f, t))
select distinct table_name, record_id, field from marked left join twins using (table_name, record_id, field) where signs or loose or mixed or twins.field is not null
"""
    return {"p3_found": p3, "p3_records": records, "p6_found": p6}
