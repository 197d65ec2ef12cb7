"""SQL texts that several oracles share. Rules are stated here in SQL's own words, not taken from the functions they check."""

from __future__ import annotations

_q = lambda v: "'" + v.replace("'", "''") + "'"

DOI = "(case when contains(ee, 'doi.org/') then substring(ee, strpos(ee, 'doi.org/') + 8) when starts_with(ee, '10.') then ee end)"
DOI_ANY = r"nullif(regexp_replace(lower(regexp_extract(ee, '(10\.\d{4,9}/[^\s\"<>]+)', 1, 'i')), '[.,;:)\]}]+$', ''), '')"
DOI_URL = r"rtrim(regexp_extract(coalesce(ee, ''), 'doi\.org/(10\..+)$', 1, 'i'), '/')"
_T = "lower(coalesce(title, ''))"
_E = "lower(coalesce(event, ''))"
CLASS = (
    f"(case when contains({_T}, 'sok:') or contains({_T}, 'systematization of knowledge') then 'SoK' when contains({_T}, 'survey') or contains({_T}, 'systematic review') or contains({_T}, 'literature review') then 'Survey' "
    f"when contains({_T}, 'poster:') or starts_with({_T}, 'poster ') then 'Poster' when contains({_T}, 'workshop') then 'Workshop' when contains({_T}, 'short paper') then 'Short' "
    f"when starts_with({_E}, 'acm computing') or starts_with({_E}, 'ieee communications') or starts_with({_E}, 'foundations and trends') then 'Journal' else 'Article' end)"
)
#: White space of any kind to single spaces, trimmed; null becomes ''.
COLLAPSE = r"trim(regexp_replace(coalesce({}, ''), '[\s\x{{85}}\p{{Z}}\x0b]+', ' ', 'g'))"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def nfkd(x: str) -> str:
    """Compatibility decomposition without marks, for the characters that names and titles hold."""
    out = f"translate({x}, {_q(_WIDE)}, {_q(_NARROW)})"
    for a, b in (("ﬃ", "ffi"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents({out})"


AUTHOR = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({nfkd('name')}), '[\s\p{{Z}}]+\d{{4}}$', ''), '[^a-z\s\-'']', ' ', 'g'), '\s+', ' ', 'g'))"
AUTHOR_KEY = f"(case when not contains({AUTHOR}, ' ') then {AUTHOR} else string_split({AUTHOR}, ' ')[-1] || ' ' || left({AUTHOR}, 1) end)"
STRICT_KEY = f"(case when contains({AUTHOR}, ' ') and length(string_split({AUTHOR}, ' ')[1]) > 1 then {AUTHOR} else '' end)"
TITLE_TOKENS = (
    f"list_distinct(list_filter(string_split(regexp_replace({nfkd('lower(title)')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and w not in "
    "('a', 'an', 'the', 'of', 'for', 'on', 'in', 'and', 'or', 'but', 'is', 'to', 'with', 'by', 'from', 'via', 'using', 'based', 'towards', 'approach', 'study', 'evaluation', 'analysis', 'system', 'systems')))"
)
_V = "replace(trim(lower(venue)), '&amp;', '&')"
EVENT = rf"""(case when coalesce(venue, '') = '' then venue when {_V} in ('ccs', 'acm ccs') then 'ACM CCS' when regexp_matches({_V}, 'asia[ -]?ccs') then 'ACM ASIA CCS'
 when regexp_matches({_V}, 'euro.?s.?p') then 'IEEE EURO S&P' when contains({_V}, 'ndss') then 'NDSS' when contains({_V}, 'usenix') then 'USENIX Security'
 when regexp_matches({_V}, '\bsp\b') or contains({_V}, 'symposium on security and privacy') then 'IEEE S&P' when contains({_V}, 'hotnets') then 'HotNets' when contains({_V}, 'sacmat') then 'ACM SACMAT'
 when contains({_V}, 'csur') or contains({_V}, 'computing surveys') or contains({_V}, 'comput. surv') then 'ACM Computing Surveys'
 when contains({_V}, 'comst') or contains({_V}, 'communications surveys') or contains({_V}, 'commun. surv') then 'IEEE Communications Surveys & Tutorials'
 when contains({_V}, 'fntsec') or contains({_V}, 'foundations and trends') or contains({_V}, 'found. trends priv') then 'Foundations and Trends in Privacy and Security' else venue end)"""

_J = "'ACM Computing Surveys', 'IEEE Communications Surveys & Tutorials', 'Foundations and Trends in Privacy and Security'"
_TAG = f"(case when paper_type = 'proceedings' then 'proceedings' when event in ({_J}) then 'article' else 'inproceedings' end)"
_LINE = "'  ' || rpad('{0}', 13, ' ') || '= {{' || {1} || '}}'"
_FIELDS = {
    "author": "nullif(array_to_string(list_filter(list_transform(string_split(authors, ','), lambda x: trim(x)), lambda x: x <> ''), ' and' || chr(10) || '                  '), '')",
    "title": "rtrim(nullif(title, ''), '.')",
    "booktitle": f"case when {_TAG} <> 'article' then nullif(event, '') end",
    "journal": f"case when {_TAG} = 'article' then nullif(event, '') end",
    "pages": r"regexp_replace(nullif(pages, ''), '(\d)-(\d)', '\1--\2', 'g')",
    "year": "cast(year as varchar)",
    "url": "nullif(ee, '')",
    "doi": f"nullif({DOI}, '')",
    "biburl": "'https://dblp.org/rec/' || key || '.bib'",
    "bibsource": "'dblp computer science bibliography, https://dblp.org'",
}
ENTRY = (
    "select paper_id, case when length(key) > 0 then '@' || " + _TAG + " || '{DBLP:' || key || ',' || chr(10) || array_to_string(list_filter(["
    + ", ".join(_LINE.format(k, v) for k, v in _FIELDS.items())
    + "], lambda x: x is not null), ',' || chr(10)) || chr(10) || '}' end as entry from papers"
)
