"""Expected results as SQL for the checking database, one statement per registered query.

The statements use their own formulations (zero-width borders written as consumed characters, sections known by
construction of the pages, running section numbers by window), so that they are a second opinion and not a copy of
the Spark plan.
"""

from __future__ import annotations

from checks import derived as D
from checks.queries import (
    AS_OF,
    DOCUMENT_STOP_WORDS,
    GENERIC_DICTIONARY,
    NORMALIZED_AT,
    OWN_DICTIONARY,
    OWN_KEYWORDS,
    OWN_LEVELS,
)
from vakanta import settings as S

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"

RAW = f"({D.for_duckdb(D.RAW_SQL)})"
ANALYSIS = f"""(select k, nullif(search_term, '') as search_term, nullif(job_title, '') as job_title, posted_date,
  nullif(city, '') as city, nullif(state, '') as state, nullif(hard_skills, '') as hard_skills,
  nullif(soft_skills, '') as soft_skills, experience_level, LABEL as label
  from ({D.for_duckdb(D.ANALYSIS_SQL)}) a)"""
PHRASED = f"(select *, lower(text) as lc from ({D.for_duckdb(D.PHRASED_SQL)}) p)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def title_case(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def label(x: str) -> str:
    return f"lower({strip(f'coalesce({x}, ' + chr(39) + 'unknown' + chr(39) + ')')})"


ANALYSIS = ANALYSIS.replace("LABEL", label("experience_level"))


def has(x: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def borders(pattern: str) -> str:
    """Pattern with its alternating opening and closing word borders as consumed characters."""
    out = ""
    for i, piece in enumerate(pattern.split(r"\b")):
        if i:
            out += f"(?:^|[^{WORD}])" if i % 2 else f"(?:$|[^{WORD}])"
        out += piece
    return out


def found(lc: str, pattern: str) -> str:
    return f"regexp_matches({lc}, '{borders(pattern)}')"


def tags(lc: str, dictionary, sep: str = ", ") -> str:
    by_label: dict[str, list[str]] = {}
    for pattern, name in dictionary:
        by_label.setdefault(name, []).append(found(lc, pattern))
    cases = [f"case when {' or '.join(tests)} then '{name}' end" for name, tests in by_label.items()]
    listed = f"list_sort(list_filter([{', '.join(cases)}], lambda x: x is not null))"
    return f"coalesce(array_to_string({listed}, '{sep}'), '')"


def level_chain(lc: str, patterns) -> str:
    return "case " + " ".join(f"when {found(lc, p)} then '{name}'" for p, name in patterns) + " end"


def title_level(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    return (
        f"case when {has(t, S.TITLE_ENTRY_KEYWORDS)} then 'Junior' when not {has(t, S.TITLE_ADVANCED_KEYWORDS)} then null "
        f"when {has(t, S.TITLE_LEAD_KEYWORDS)} then 'Lead' else 'Senior' end"
    )


def level_name(x: str) -> str:
    branches = " ".join(
        f"when {strip(f'lower({x})')} in ({', '.join(repr(a) for a in aliases)}) then '{level}'"
        for level, aliases in S.LEVEL_ALIASES.items()
    )
    return f"case {branches} else '' end"


def level_class(x: str) -> str:
    return f"case when {x} in ('Junior', 'Mid') then 'entry' else 'advanced' end"


def scored(source: str, lc: str) -> str:
    """``source`` with the four scores and the semantic level of ``lc``."""

    def points(level: str) -> str:
        return " + ".join(
            [f"if(contains({lc}, '{kw}'), {w}, 0)" for kw, w in S.LEVEL_SIGNALS[level].items()]
            + [f"if({has(lc, phrases)}, {extra[level]}, 0)" for phrases, extra in S.LEVEL_BOOSTS if level in extra]
        )

    best = "greatest(score_lead, score_senior, score_mid, score_junior)"
    return f"""(select *, case when {strip(f"coalesce({lc}, '')")} = '' then 'mid'
        else coalesce(lower({level_chain(lc, S.LEVEL_PATTERNS)}), case when {best} = 0 then 'mid'
          when score_lead = {best} then 'lead' when score_senior = {best} then 'senior'
          when score_mid = {best} then 'mid' else 'junior' end) end as semantic_level
      from (select * replace (score_junior + if(contains({lc}, 'ausbildung') and score_lead = 0 and score_senior = 0, 2, 0)
                as score_junior)
            from (select *, {points("lead")} as score_lead, {points("senior")} as score_senior,
                    {points("mid")} as score_mid, {points("junior")} as score_junior from {source} s0) s1) s2)"""


def posting_date(x: str) -> str:
    time = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?\s*$"
    first = rf"^\s*(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){time}"
    last = rf"^\s*(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){time}"
    compact = rf"^\s*(\d{{4}})(\d{{2}})(\d{{2}}){time}"

    def day(pattern: str, y: int, m: int, d: int) -> str:
        part = {g: f"regexp_extract({x}, '{pattern}', {g})" for g in (y, m, d)}
        swapped = f"try_cast({part[y]} || '-' || {part[d]} || '-' || {part[m]} as date)"
        plain = f"try_cast({part[y]} || '-' || {part[m]} || '-' || {part[d]} as date)"
        return f"case when cast({part[m]} as int) > 12 then {swapped} else {plain} end"

    return (
        f"case when regexp_matches({x}, '{first}') then {day(first, 1, 2, 3)} "
        f"when regexp_matches({x}, '{last}') then {day(last, 3, 1, 2)} "
        f"when regexp_matches({x}, '{compact}') then try_cast(regexp_extract({x}, '{compact}', 1) || '-' || "
        f"regexp_extract({x}, '{compact}', 2) || '-' || regexp_extract({x}, '{compact}', 3) as date) end"
    )


def location_text(x: str) -> str:
    """Text of a location given as JSON text."""

    def of_object(j: str) -> str:
        parts = [
            f"case when json_type({j}, '$.{p}') = 'VARCHAR' then {strip(f'json_extract_string({j}, {chr(39)}$.{p}{chr(39)})')} end"
            for p in S.LOCATION_PARTS
        ]
        return f"concat_ws(', ', {', '.join(parts)})"

    def scalar(j: str) -> str:
        value = f"coalesce(json_extract_string({j}, '$'), '')"
        boolean = f"if({value} = 'true', 'True', 'False')"
        return strip(f"case when json_type({j}) = 'BOOLEAN' then {boolean} else {value} end")

    j = f"cast({x} as json)"
    head = f"json_extract({j}, '$[0]')"
    return (
        f"case json_type({j}) when 'OBJECT' then {of_object(j)} when 'ARRAY' then "
        f"case when {head} is null then '' when json_type({head}) = 'OBJECT' then {of_object(head)} else {scalar(head)} end "
        f"else {scalar(j)} end"
    )


def located(source: str, column: str = "location") -> str:
    """``source`` with index, city, state, country and address."""
    states = ", ".join(f"'{s}'" for s in S.GERMAN_STATES)
    suffixes = "|".join(s.replace(".", r"\.") for s in S.STREET_SUFFIXES)

    def first(test: str) -> str:
        return f"list_filter(parts, lambda p: {test})[1]"

    address = (
        f"(regexp_matches(p, '[0-9]') and regexp_matches(p, '[A-Za-zÄÖÜäöüß]')) or regexp_matches(lower(p), '({suffixes})$')"
    )
    return f"""(select * exclude (parts, all_parts, i, s, c, a, city0), coalesce(i, 'Unknown') as "index",
        case when lower(s) in ('berlin', 'hamburg', 'bremen') then s else coalesce(city0, 'Unknown') end as city,
        coalesce(s, 'Unknown') as state, coalesce(c, 'Unknown') as country,
        case when lower(all_parts[-1]) = 'null' then 'Unknown' else coalesce(a, 'Unknown') end as address
      from (select *, list_filter(parts, lambda p: not list_contains(
                list_filter([i, s, c, a], lambda v: v is not null), p))[1] as city0
            from (select *, {first("regexp_matches(p, '^[0-9]{5}$')")} as i, {first(f"lower(p) in ({states})")} as s,
                    {first("lower(p) = 'deutschland'")} as c, {first(address)} as a
                  from (select *, list_filter(all_parts, lambda p: lower(p) <> 'null') as parts
                        from (select *, list_filter(list_transform(string_split({column}, ','), lambda p: {strip("p")}),
                                lambda p: p <> '') as all_parts from {source} l0) l1) l2) l3) l4)"""


def clean_title(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern in S.TITLE_NOISE:
        inner = pattern.replace(r"\b", "").replace(r"\s", f"[{SPACE}]")
        for _ in range(2):  # neighbours share the border character
            out = f"regexp_replace({out}, '(^|[^{WORD}]){inner}($|[^{WORD}])', '\\1 \\3', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '\\([^)]*\\)', ' ', 'g'), '[^{WORD}{SPACE}]', ' ', 'g')"
    return strip(f"regexp_replace({out}, '[{SPACE}]+', ' ', 'g')")


def normal_city(x: str, stripped: bool = False) -> str:
    name = f"regexp_replace(lower({strip(x)}), '\\(.*?\\)', '', 'g')"
    name = f"regexp_replace(replace({name}, ',', ' '), '[{SPACE}]+', ' ', 'g')"
    return title_case(f"coalesce({strip(name) if stripped else name}, '')")


def skills_of(x: str, least: int = 1) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda s: {strip('s')}), lambda s: length(s) >= {least})"


def top_skills(column: str) -> str:
    return f"""select label as experience_level, skill, n as vacancies, rank from (
        select label, skill, n, row_number() over (partition by label order by n desc, skill) as rank
        from (select label, skill, count(*) as n
              from (select label, unnest({skills_of(column)}) as skill from {ANALYSIS} v) group by all))
      where rank <= 20"""


def repeated_words(column: str) -> str:
    return f"""with w as (select label, unnest(regexp_extract_all(lower({column}), '[{WORD}]{{3,}}')) as word
        from {ANALYSIS} v where label in ('entry', 'advanced')),
      c as (select word, count(*) filter (label = 'entry') as e, count(*) filter (label = 'advanced') as a from w group by word),
      r as (select *, case when e > 0 then row_number() over (order by e desc, word) end as er,
              case when a > 0 then row_number() over (order by a desc, word) end as ar from c),
      t as (select word, e, a, if(er <= 30, er, null) as er, if(ar <= 30, ar, null) as ar from r where er <= 30 or ar <= 30),
      p as (select *, row_number() over (order by er nulls last, ar) as position from t)
      select position, word, 'entry' as level, e as count, e + a as total, round(e * 100 / (e + a), 6) as share_pct from p
      union all
      select position, word, 'advanced', a, e + a, round(a * 100 / (e + a), 6) from p"""


GEOCACHE = f"""(select {title_case(strip('"City"'))} as "City", "Latitude", "Longitude", cache_row
  from ({D.for_duckdb(D.GEO_SQL)}) g where "Latitude" is not null and "Longitude" is not null)"""
KNOWN = f"""(select "City", arg_min("Latitude", cache_row) as "Latitude", arg_min("Longitude", cache_row) as "Longitude"
  from (select {normal_city('"City"')} as "City", "Latitude", "Longitude", cache_row from {GEOCACHE} g0) g1 group by "City")"""
CITY_STATS = f"""(select {normal_city("city")} as "City", n as "Vacancies"
  from (select city, count(*) as n from {ANALYSIS} v where city is not null group by city) c0)"""

GERMAN_STOPS = ", ".join(f"'{w}'" for w in S.GERMAN_STOP_WORDS)
# of the class that the clustering takes its English list from; words of one letter never reach it
ENGLISH_STOPS = ", ".join("'" + w + "'" for w in (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too very s t can will just don should now "
    "could would might must shall cannot ought let"
).split())
DOCUMENT_STOPS = ", ".join(f"'{w}'" for w in DOCUMENT_STOP_WORDS)


def terms(x: str, stops: str) -> str:
    tokens = f"list_filter(regexp_extract_all(lower({x}), '[{WORD}]{{2,}}'), lambda w: w not in ({stops}))"
    return f"(select list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) from (select {tokens} as t))"


TITLES = f"""(select label as experience_level, search_term, {clean_title("job_title")} as clean_title
  from {ANALYSIS} v where label in ('entry', 'advanced') and search_term is not null)"""
BIG_GROUPS = f"""(select experience_level, search_term, count(*) as n_docs from {TITLES} t0 where clean_title <> ''
  group by all having count(*) >= 5)"""
DOCUMENT_TERMS = f"""counts as (select lang, doc_id, term, count(*) as tf
    from (select lang, doc_id, unnest({terms("text", DOCUMENT_STOPS)}) as term from documents) group by all),
  sizes as (select lang, count(*) as n_docs from documents group by lang),
  vocabulary as (select *, ln((1 + n_docs) / (1 + df)) + 1 as idf
    from (select lang, term, count(*) as df from counts group by all having count(*) >= 2) join sizes using (lang))"""

TITLE_VECTORS = f"""docs as (select experience_level, search_term, clean_title, count(*) as weight, any_value(n_docs) as n_docs
        from {TITLES} t join {BIG_GROUPS} b using (experience_level, search_term) where clean_title <> '' group by all),
      counts as (select experience_level, search_term, clean_title, weight, n_docs, term, count(*) as tf
        from (select *, unnest({terms("clean_title", GERMAN_STOPS)}) as term from docs) group by all),
      vocabulary as (select experience_level, search_term, term, sum(weight) as df from counts group by all
        having sum(weight) >= 2),
      raw as (select *, ln((1 + n_docs) / (1 + df)) + 1 as idf from counts join vocabulary using (experience_level, search_term, term)),
      unit as (select *, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) over (partition by experience_level, search_term, clean_title))
          as u from raw)"""


def skill_certificate(column: str) -> str:
    return f"""select '{column}' as skill_type, count(distinct skill) as documents, count(distinct skill) as in_one_cluster,
      0 as not_nearest, 0 as off_mean, true as converged from (select unnest({skills_of(column, 2)}) as skill from {ANALYSIS} v)"""


NL = "chr(10)"


def _json(pairs: list[tuple[str, str]]) -> str:
    def quoted(x: str) -> str:
        return f"""'"' || replace({x}, {NL}, '\\n') || '"'"""

    return "'{' || " + " || ', ' || ".join(f"{quoted(t)} || ': ' || {quoted(x)}" for t, x in pairs) + " || '}'"


def _full(pairs: list[tuple[str, str]]) -> str:
    return f" || {NL} || {NL} || ".join(f"{t} || ':' || {NL} || {x}" for t, x in pairs)


# Sections of the derived pages, known from how they are put together.
_KIND0 = [
    ("'Ihre Aufgaben:'", f"phrase1 || {NL} || phrase2 || {NL} || 'SQL'"),
    ("'IhrProfil'", "phrase3"),
]
_KIND1 = [
    ("'Ihr Profil'", f"phrase1 || {NL} || 'Wir bieten' || {NL} || phrase2 || {NL} || phrase3"),
    ("'Wir bieten'", f"phrase2 || {NL} || phrase3"),
]
_KIND2 = [("'Aufgaben'", f"phrase1 || {NL} || phrase2"), ("'Wir bieten '", "phrase3")]
_KIND4 = [("'Profil'", "phrase1")]
_KIND7 = [("'Profil'", "phrase1"), ("'Profil'", f"phrase2 || {NL} || phrase3")]
_KIND7_MAP = _KIND7[1:]

_EXT = f"partner_phrase || {NL} || 'Agile'"
PAGE_ROWS = f"""(select *,
    '10000-' || k || '_S__.html' as page_key, page_kind = 4 and partner % 5 <> 0 as external,
    {D.for_duckdb(D.pick("partner", D.PHRASES))} as partner_phrase from {RAW} r0)"""
SECTIONS = f"""(select *, html_full as sections_text from (select k, page_key, page_kind,
    case when external then null else case page_kind when 0 then {_full(_KIND0)} when 1 then {_full(_KIND1)}
      when 2 then {_full(_KIND2)} when 4 then {_full(_KIND4)} when 7 then {_full(_KIND7)} end end as html_full,
    case when external then '' else case page_kind when 0 then {_json(_KIND0)} when 1 then {_json(_KIND1)}
      when 2 then {_json(_KIND2)} when 4 then {_json(_KIND4)} when 7 then {_json(_KIND7_MAP)} else '' end end as sections,
    case when external then 'Profil' || {NL} || {_EXT} else case page_kind
      when 0 then concat_ws({NL}, 't', 'Stelle', 'Ihre Aufgaben:', phrase1, phrase2, 'SQL', 'x', 'lost', 'Ihr ', 'Profil',
        phrase3, 'Sonstiges', 'egal')
      when 1 then concat_ws({NL}, 'Ihr Profil', phrase1, 'Wir bieten', phrase2, phrase3)
      when 2 then concat_ws({NL}, 'Intro', 'Aufgaben:', phrase1, phrase2, 'Profil:', 'Wir bieten ::', phrase3)
      when 3 then phrase1 || ' & ' || {NL} || phrase2
      when 4 then concat_ws({NL}, 'Zur Stelle', 'Profil', phrase1)
      when 7 then concat_ws({NL}, 'Profil', phrase1, 'Profil', phrase2, phrase3) end end as raw_text,
    case when external then 'external' when page_kind = 3 then 'unstructured' when page_kind in (5, 6) then 'empty'
      else 'structured' end as html_quality,
    case when external then 'https___partner_example_jobs_' || partner || '_x_1.html' else page_key end as html_filename
  from {PAGE_ROWS} r1 where page_kind >= 0))"""

GOOD = f"(select * from {RAW} g0 where fault is null)"
FIELDS = f"""(select k, search_term, term_rank, page, pos, {strip("coalesce(titel, '')")} as job_title,
    {strip("coalesce(nullif(beruf, ''), nullif(berufsbezeichnung, ''), '')")} as beruf,
    {strip("coalesce(arbeitgeber, '')")} as company, nullif(refnr, '') as refnr,
    {posting_date("coalesce(nullif(tag1, ''), nullif(tag2, ''), nullif(tag3, ''))")} as posted_date,
    {location_text("arbeitsort")} as location, coalesce(nullif(entgelt, ''), nullif(salary, '')) as salary,
    coalesce(nullif(befristung, ''), nullif(angebotsart, '')) as contract_type
  from {GOOD} g1)"""
KEPT = f"""(select * from {FIELDS} f0 where posted_date >= date '{AS_OF}' - interval 365 day
  qualify row_number() over (partition by lower(job_title), lower(company), lower(location)
    order by term_rank, page, pos) = 1)"""
JOINED = f"""(select f.*, html_full, sections, sections_text, raw_text, coalesce(s.html_quality, 'empty') as html_quality,
    case when f.refnr is null then '' else coalesce(s.html_filename, '10000-' || f.k || '_S__.html') end as html_filename,
    coalesce(html_full, nullif(raw_text, ''), '') as description,
    lower(coalesce(html_full, nullif(raw_text, ''))) as level_text, lower(coalesce(html_full, raw_text, '')) as lc,
    {title_level("job_title")} as work_experience
  from {located(KEPT)} f left join {SECTIONS} s on f.k = s.k and f.refnr is not null)"""
NORMALISED = f"""(select search_term, job_title, beruf,
    case when refnr is null then '' else '{S.JOB_URL_PREFIX}' || refnr end as job_url, company,
    cast(posted_date as varchar) as posted_date, location, "index", city, state, country, address, description,
    coalesce(sections, '') as description_sections_json, coalesce(sections_text, '') as description_sections_text,
    case when beruf <> '' and description <> '' then 'API+Website' when beruf <> '' then 'API'
      when description <> '' then 'Website' else 'None' end as description_source,
    html_quality, html_filename, salary, contract_type, {tags("lc", S.HARD_SKILLS)} as hard_skills,
    {tags("lc", S.SOFT_SKILLS)} as soft_skills, work_experience,
    {level_class(f"coalesce(work_experience, case when level_text is null then 'Mid' else {level_name('semantic_level')} end)")}
      as experience_level,
    '{S.SOURCE_NAME}' as source, '{NORMALIZED_AT}' as normalized_at
  from {scored(JOINED, "level_text")} n0)"""

SECTION_LINES = f"""with lines as (select doc_id, i, {strip("line")} as line from (
      select doc_id, unnest(string_split(text, {NL})) as line, unnest(range(len(string_split(text, {NL})))) as i
      from ({D.for_duckdb(D.SECTIONED_SQL)}) d)),
    marked as (select *, line like '%:' and {has("lower(line)", S.SECTION_TITLES)} as is_title from lines where line <> ''),
    numbered as (select *, sum(if(is_title, 1, 0)) over (partition by doc_id order by i) as section from marked),
    found as (select doc_id, section, max(if(is_title, regexp_replace(line, ':+$', ''), null)) as title,
        string_agg(line, {NL} order by i) filter (not is_title) as body
      from numbered where section > 0 group by all having count(*) filter (not is_title) > 0),
    merged as (select doc_id, title, min(section) as place, arg_max(body, section) as body from found group by all)"""

PAGE_STRINGS = r"""list_filter(string_split_regex(regexp_replace(html,
    '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>', '<x>', 'g'), '<[^>]*>'), lambda s: s <> '')"""
PAGE_TEXT = rf"""array_to_string(list_transform({PAGE_STRINGS}, lambda s:
    case when regexp_matches(s, '^[ \n\t\f\r]+$') then if(contains(s, {NL}), {NL}, ' ')
    else regexp_replace(replace(replace(replace(s, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')
    end), {NL})"""

ORACLE: dict[str, str] = {
    "vacancy_levels": f"""select experience_level, count(*) as vacancies,
        round(count(*) * 100 / sum(count(*)) over (), 6) as share_pct from {NORMALISED} n group by experience_level""",
    "normalised_vacancies": f"select * from {NORMALISED} n",
    "normalised_from_laid_out_pages": f"select * from {NORMALISED} n",
    "landing_items": f"""select {D.for_duckdb(D.pick("term_rank - 1", D.TERMS))} as search_term, term_rank, page,
        row_number() over (partition by term_rank, page order by slot) - 1 as pos, k
      from ({D.for_duckdb(D.LANDED_SQL)}) l""",
    "landing_files": f"""with landed as (select {D.for_duckdb(D.pick("term_rank - 1", D.TERMS))} as search_term, term_rank, page,
          row_number() over (partition by term_rank, page order by slot) - 1 as pos, k from ({D.for_duckdb(D.LANDED_SQL)}) l)
      select search_term, term_rank, page, pos, null as error, k from landed where page % 20 <> 7
      union all select distinct search_term, term_rank, page, 0, 'file is not readable JSON', null::bigint from landed where page % 20 = 7""",
    "stored_page_table": "select cast(page_id as varchar) as page_key, md5(html) as digest from pages",
    "given_page_sections": f"""select cast(page_id as varchar) as page_key,
        if({strip(PAGE_TEXT)} = '', 'empty', 'unstructured') as html_quality, md5({strip(PAGE_TEXT)}) as digest from pages""",
    "rejects_sink": f"""select fault as error, case fault when 'item is not an object' then ''
          when 'titel is not a string' then '5' else coalesce(titel, '') end as titel,
        case fault when 'item is not an object' then '' when 'refnr is not a string' then '7' else coalesce(refnr, '') end as refnr
      from {RAW} r where fault is not null""",
    "vacancy_sink": f"""select nullif(job_title, '') as job_title, nullif(company, '') as company, nullif(location, '') as location,
        nullif(job_url, '') as job_url, posted_date, substr(posted_date, 1, 7) as posted_month, nullif(salary, '') as salary,
        nullif(hard_skills, '') as hard_skills from {NORMALISED} n""",
    "geocache_sink": f"""select "City", arg_min("Latitude", cache_row) as "Latitude", arg_min("Longitude", cache_row) as "Longitude"
      from {GEOCACHE} g group by "City" """,
    "report_sink": f"""select label as experience_level, count(*) as vacancies,
        round(count(*) * 100 / sum(count(*)) over (), 6) as share_pct from {ANALYSIS} v group by label""",
    "compact_repeated_words": repeated_words("hard_skills"),
    "item_fields": f"select * exclude (k) replace (cast(posted_date as varchar) as posted_date) from {FIELDS} f",
    "rejected_items": f"""select fault as error, case fault when 'item is not an object' then ''
          when 'titel is not a string' then '5' else coalesce(titel, '') end as titel,
        if(fault = 'item is not an object', '', coalesce(arbeitgeber, '')) as arbeitgeber,
        case fault when 'item is not an object' then '' when 'refnr is not a string' then '7' else coalesce(refnr, '') end as refnr
      from {RAW} r where fault is not null""",
    "page_text": f"select page_id, length({PAGE_TEXT}) as n_chars, md5({PAGE_TEXT}) as digest from pages",
    "page_sections": f"""select page_key, html_full, sections, sections_text,
        case when html_quality <> 'empty' then raw_text end as raw_text, html_quality, html_filename
      from {SECTIONS} s""",
    "colon_sections": f"""{SECTION_LINES}
      select d.doc_id, count(title) as n_sections,
        coalesce(string_agg(title || ':' || {NL} || body, {NL} || {NL} order by place), '') as sections_text
      from documents d left join merged using (doc_id) group by d.doc_id""",
    "extract_location": f"select k, {location_text('arbeitsort')} as location from {RAW} r",
    "parse_location": f"""select * from {located(f"(select k, {location_text('arbeitsort')} as location from {RAW} r)")} x""",
    "normalize_city": f"""select k, {normal_city("city")} as city, {normal_city("city", True)} as city_stripped
      from ({D.for_duckdb(D.ANALYSIS_SQL)}) a""",
    "page_key": "select page_id, regexp_replace(url, '[^A-Za-z0-9-]', '_', 'g') || '.html' as page_key from pages",
    "job_url": f"""select k, case when coalesce(refnr, '') = '' then '' else '{S.JOB_URL_PREFIX}' || refnr end as job_url
      from {RAW} r""",
    "first_non_empty": f"""select k, coalesce(nullif(beruf, ''), nullif(berufsbezeichnung, '')) as beruf,
        coalesce(nullif(tag1, ''), nullif(tag2, ''), nullif(tag3, '')) as raw_date,
        coalesce(nullif(entgelt, ''), nullif(salary, '')) as pay,
        coalesce(nullif(befristung, ''), nullif(angebotsart, '')) as contract from {RAW} r""",
    "posting_dates": f"""select k, cast({posting_date("tag1")} as varchar) as tag1, cast({posting_date("tag2")} as varchar)
        as tag2, cast({posting_date("tag3")} as varchar) as tag3 from {RAW} r""",
    "month_keys": f"select k, cast(cast(date_trunc('month', posted_date) as date) as varchar) as month from {ANALYSIS} v",
    "clean_title": f"select k, {clean_title('job_title')} as clean_title from ({D.for_duckdb(D.ANALYSIS_SQL)}) a",
    "title_level": f"select k, {title_level('titel')} as level from {RAW} r",
    "level_names": f"""select k, {level_name("coalesce(experience_level, '')")} as name_of_level,
        {level_name(f"coalesce({title_level('job_title')}, '')")} as name, label from {ANALYSIS} v""",
    "text_levels": f"""select doc_id, lower({level_chain("lc", S.LEVEL_PATTERNS)}) as first_level,
        lower({level_chain("lc", S.LEVEL_PATTERNS[::-1])}) as last_level,
        {level_chain("lc", S.LEVEL_PATTERNS[::-1])} as highest_level from {PHRASED} p""",
    "semantic_level": f"""select * exclude (text, lc, lang),
        {level_class(level_name("semantic_level"))} as level_class from {scored(PHRASED, "lc")} x""",
    "skill_tags": f"""select doc_id, {tags("lc", S.HARD_SKILLS)} as hard_skills, {tags("lc", S.SOFT_SKILLS)} as soft_skills
      from {PHRASED} p""",
    "generic_tags": f"select doc_id, {tags('lower(text)', GENERIC_DICTIONARY, '|')} as tags from documents",
    "own_dictionary_tags": f"select doc_id, {tags('lower(text)', OWN_DICTIONARY)} as tags from documents",
    # names of buyers and articles are cut out and looked up; the pieces in between are the texts' other words
    "dictionary_table_tags": f"""with texts as (select doc_id, lower(text) as lc from ({D.for_duckdb(D.NAMED_SQL)}) t),
      hits as (
        select doc_id, 'buyer ' || cast(c_custkey % 5000 as varchar) as label
        from (select doc_id, unnest(regexp_extract_all(lc, '(?:^|[^{WORD}])(customer#[0-9]+)', 1)) as name from texts) n join customer on lower(c_name) = name
        union
        select doc_id, 'article ' || p_name from (select doc_id, '|' || regexp_replace(lc, '[^{WORD} ]', '|', 'g') || '|' as marked from texts) t
          join (select p_name, list(l || name || s || r) as forms from (
              select distinct p_name, unnest([p_name, replace(p_name, ' ', '')]) as name from part) n
            cross join (select unnest([' ', '|']) as l) cross join (select unnest([' ', '|']) as r) cross join (select unnest(['', 's']) as s) group by p_name) p
          on len(list_filter(forms, lambda f: contains(marked, f))) > 0
        union select doc_id, 'common' from texts where regexp_matches(lc, '(?:^|[^{WORD}])the(?:$|[^{WORD}])')
        union select doc_id, 'part of word' from texts where contains(lc, 'widget') or regexp_matches(lc, 'gear(box)?(?:$|[^{WORD}])')
        union select doc_id, 'year' from texts where regexp_matches(lc, '(?:^|[^{WORD}])[0-9]{{4}}(?:$|[^{WORD}])')
      ), listed as (select doc_id, string_agg(label, ', ' order by label) as tags from hits group by doc_id)
      select doc_id, coalesce(tags, '') as tags from texts left join listed using (doc_id)""",
    "own_level_patterns": f"""select doc_id, lower({level_chain("lower(text)", OWN_LEVELS)}) as first_level,
        lower({level_chain("lower(text)", OWN_LEVELS[::-1])}) as last_level,
        {level_chain("lower(text)", [OWN_LEVELS[3], OWN_LEVELS[0], OWN_LEVELS[2], OWN_LEVELS[1]])} as highest_level from documents""",
    "own_title_keywords": f"""select k, case when {has("lower(coalesce(titel, ''))", OWN_KEYWORDS[0])} then 'Junior'
        when not {has("lower(coalesce(titel, ''))", OWN_KEYWORDS[1])} then null
        when {has("lower(coalesce(titel, ''))", OWN_KEYWORDS[2])} then 'Lead' else 'Senior' end as level from {RAW} r""",
    "skill_list_split": f"""select k, unnest(range(len(l))) as pos, unnest(l) as skill
      from (select k, {skills_of("hard_skills")} as l from ({D.for_duckdb(D.ANALYSIS_SQL)}) a)""",
    "word_tokens": f"""select lang, word, count(*) as n
      from (select lang, unnest(regexp_extract_all(lower(text), '[{WORD}]{{3,}}')) as word from documents) group by all""",
    "distinct_skills": f"select distinct unnest({skills_of('hard_skills', 2)}) as skill from {ANALYSIS} v",
    "recent_window": f"""select k, cast(posted_date as varchar) as posted_date from {ANALYSIS} v
      where posted_date >= date '{AS_OF}' - interval 365 day""",
    "dedup_first_wins": f"""select k, search_term, titel, arbeitgeber, arbeitsort from {RAW} r
      qualify row_number() over (partition by lower(coalesce(titel, '')), lower(coalesce(arbeitgeber, '')), lower(arbeitsort)
        order by term_rank, page, pos) = 1""",
    "experience_distribution": f"""select label as experience_level, count(*) as vacancies,
        round(count(*) * 100 / sum(count(*)) over (), 6) as share_pct from {ANALYSIS} v group by label""",
    "search_term_distribution": f"""select search_term, count(*) as vacancies from {ANALYSIS} v
      where search_term is not null group by search_term""",
    "search_term_by_level": f"""select label as experience_level, search_term, count(*) as vacancies from {ANALYSIS} v
      where search_term is not null group by all""",
    "monthly_dynamics": f"""select cast(cast(date_trunc('month', posted_date) as date) as varchar) as month,
        if(grouping(label) = 1, 'all', 'level: ' || label) as line, count(*) as vacancies from {ANALYSIS} v
      where posted_date is not null
      group by grouping sets ((cast(date_trunc('month', posted_date) as date)),
                              (cast(date_trunc('month', posted_date) as date), label))""",
    "top_skills_hard": top_skills("hard_skills"),
    "top_skills_soft": top_skills("soft_skills"),
    "city_top25": f"""select city, count(*) as vacancies from {ANALYSIS} v where city is not null group by city
      order by vacancies desc, city limit 25""",
    "state_top16": f"""select state, count(*) as vacancies from {ANALYSIS} v where state is not null group by state
      order by vacancies desc, state limit 16""",
    "geo_by_level": f"""select * from (
        select label as level, 'city' as kind, city as name, count(*) as vacancies,
          row_number() over (partition by label order by count(*) desc, city) as rank
        from {ANALYSIS} v where city is not null and label in ('entry', 'advanced') group by label, city
        union all
        select label, 'state', state, count(*), row_number() over (partition by label order by count(*) desc, state)
        from {ANALYSIS} v where state is not null and label in ('entry', 'advanced') group by label, state)
      where rank <= if(kind = 'city', 25, 16)""",
    "repeated_words_hard": repeated_words("hard_skills"),
    "repeated_words_soft": repeated_words("soft_skills"),
    "geocache_source": f"select * from {GEOCACHE} g",
    "city_coordinates": f'select "City", "Vacancies", "Latitude", "Longitude" from {CITY_STATS} c join {KNOWN} k using ("City")',
    "city_coordinates_merged": f"""select "City", sum("Vacancies")::bigint as "Vacancies", any_value("Latitude") as "Latitude",
        any_value("Longitude") as "Longitude" from {CITY_STATS} c join {KNOWN} k using ("City") group by "City" """,
    "city_coordinates_by_scope": f"""select scope, "City", "Vacancies", "Latitude", "Longitude" from (
        select scope, {normal_city("city")} as "City", n as "Vacancies" from (
          select 'all' as scope, city, count(*) as n from {ANALYSIS} v where city is not null group by city
          union all select label, city, count(*) from {ANALYSIS} v where city is not null and label in ('entry', 'advanced')
          group by label, city)) join {KNOWN} k using ("City")""",
    "cities_without_coordinates": f"""select distinct "City" from {CITY_STATS} c
      where "City" not in (select "City" from {KNOWN} k)""",
    "geo_coverage": f"""select (select count(distinct "City") from {CITY_STATS} c) as all_cities,
        (select count(*) from {KNOWN} k) as cached_cities,
        (select count(distinct "City") from {CITY_STATS} c where "City" not in (select "City" from {KNOWN} k)) as new_cities""",
    "geocache_updated": f"""select "City", "Latitude", "Longitude" from {KNOWN} k union all
      select "City", "Latitude", "Longitude" from ({D.for_duckdb(D.FOUND_SQL)}) f
      where "Latitude" <> 0 and "Longitude" <> 0 and "City" not in (select "City" from {KNOWN} k)""",
    "tfidf_titles": f"""with {TITLE_VECTORS}
      select experience_level, search_term, clean_title, term, tf, df::bigint as df, n_docs, round(idf, 6) as idf,
        round(u, 6) as tfidf from unit""",
    "title_group_status": f"""select experience_level, search_term, count(*) filter (clean_title <> '') as n_titles,
        if(count(*) filter (clean_title <> '') < 5, 'insufficient data', 'clustered') as status from {TITLES} t group by all""",
    "doc_frequency_documents": f"with {DOCUMENT_TERMS} select lang, term, df, n_docs, round(idf, 6) as idf from vocabulary",
    "tfidf_documents": f"""with {DOCUMENT_TERMS},
      raw as (select lang, doc_id, term, df, n_docs, tf * idf as w from counts join vocabulary using (lang, term)),
      unit as (select *, w / sqrt(sum(w * w) over (partition by lang, doc_id)) as u from raw),
      means as (select lang, term, round(sum(u) / any_value(n_docs), 9) as m, any_value(df) as df from unit group by all)
      select lang, term, df, round(m, 6) as mean_weight from means""",
    "english_stop_word_terms": f"""select term, sum(tf)::bigint as n, count(*) as df from (select doc_id, term, count(*) as tf
        from (select doc_id, unnest({terms("text", ENGLISH_STOPS)}) as term from documents where lang = 'en') group by all)
      group by term""",
    "title_cluster_certificate": f"""select experience_level, search_term, n_docs as documents, n_docs as in_one_cluster,
        0 as not_nearest, 0 as off_mean, true as converged from {BIG_GROUPS} b""",
    "skill_cluster_certificate_hard": skill_certificate("hard_skills"),
    "skill_cluster_certificate_soft": skill_certificate("soft_skills"),
    "given_cluster_sizes": f"""select experience_level, search_term, length(clean_title) % 5 as cluster, count(*) as n_titles
      from {TITLES} t join {BIG_GROUPS} b using (experience_level, search_term) where clean_title <> '' group by all""",
    "given_cluster_terms": f"""with {TITLE_VECTORS},
      n as (select experience_level, search_term, length(clean_title) % 5 as cluster, sum(weight) as n from docs group by all),
      means as (select experience_level, search_term, length(clean_title) % 5 as cluster, term, sum(u * weight) as s from unit
        group by all),
      ranked as (select *, round(s / n, 9) as w, row_number() over (partition by experience_level, search_term, cluster
          order by round(s / n, 9) desc, term) as rank
        from means join n using (experience_level, search_term, cluster) where round(s / n, 9) > 0)
      select experience_level, search_term, cluster, term, round(w, 6) as centroid_weight, rank from ranked where rank <= 8""",
    "given_cluster_examples": f"""select experience_level, search_term, length(clean_title) % 5 as cluster, rank, job_title
      from (select *, row_number() over (partition by experience_level, search_term, length(clean_title) % 5
          order by job_title desc) as rank
        from (select label as experience_level, search_term, job_title, {clean_title("job_title")} as clean_title
          from {ANALYSIS} v where label in ('entry', 'advanced') and search_term is not null) t
        join {BIG_GROUPS} b using (experience_level, search_term) where clean_title <> '') where rank <= 5""",
    "title_cluster_totals": f"select experience_level, search_term, n_docs as n_titles from {BIG_GROUPS} b",
}
ORACLE["compact_monthly_dynamics"] = ORACLE["monthly_dynamics"]
