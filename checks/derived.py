"""Vacancies, pages and coordinates derived from the given tables.

The given tables hold no vacancy vocabulary, so queries on the domain operators read rows derived from
``orders`` (one vacancy per order), ``supplier`` and ``documents``. The SQL below is plain enough to
mean the same in Spark and in the checking database: values are picked by key with CASE. A third of the vacancies
share one title, company and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vakanta import settings as S


def literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):  # braces are doubled because the statements are formatted once
        return "'" + value.replace("{", "{{").replace("}", "}}") + "'"
    return str(value)


def pick(key: str, values: list) -> str:
    """CASE that picks by ``key`` modulo the number of values."""
    branches = " ".join(f"when {i} then {literal(v)}" for i, v in enumerate(values))
    return f"case ({key}) % {len(values)} {branches} end"


TITLES = [
    "Senior Data Engineer (m/w/d) – Remote", "Junior Process Analyst", "Data Analyst", "Teamleiter Vertrieb",
    "Projektleiter IT", "International Sales Manager", "Prompt Engineer (Vollzeit)", "  Prozessmanager RPA  ",
    "Senior Associate", "Sales Israel", "Business Analyst für Prozesse", "Data Engineer", "KI-Entwickler/in", None,
    "   ", "AI Specialist mid hybrid", "Process Analyst (RPA) jr. Team", "Werkstudent Data Engineer",
    "Head of Automation",
]
TERMS = [*S.SEARCH_TERMS]
PLACES = [
    '"80331, München, Bayern, Deutschland, Marienplatz 1"',
    '{"ort":"Köln","plz":"50667","region":" Nordrhein-Westfalen ","land":"Deutschland"}',
    '{"plz":"10115","ort":"Berlin","ortsteil":"Mitte","region":"Berlin","land":"Deutschland"}',
    "null",
    '[{"ort":"Leipzig","region":"Sachsen"},{"ort":"B"}]',
    "[]",
    '"27568, Bremerhaven, Bremen, Deutschland"',
    '"Zeil 5, Frankfurt, null"',
    '" Musterweg, Köln "',
    '"80331, 80333, Bayern"',
    '"Deutschland"',
    '{"plz":"50667","ort":null,"region":"","land":7}',
    "12345",
    '"null"',
    '["Hamburg, Hamburg, Deutschland"]',
    '{"strasse":"Hauptstraße 5","ort":"Bonn","region":"Nordrhein-Westfalen"}',
    '"Sachsen, Thüringen, Jena, Goetheallee"',
    "true",
    '"Stuttgart, Baden-Württemberg, Deutschland, Königstr."',
]
PHRASES = [
    "Python, Spark und No SQL; Teamarbeit", "Durchführung von Projekten", "Verantwortung für Budget",
    "Mehrjährige Erfahrung im Vertrieb", "Ausbildung im Büro", "Erste Erfahrungen mit Prozessen",
    "Teamfähigkeit und Ausbildung", "Senior Manager, junior team", "hello", "Kommunikation mit Stakeholder, SAP",
    "Power BI, Low-Code und n8n", "sqlä pysql lean-agile Change Management", "Grundkenntnisse in Excel und Jira",
    "Experte für PyTorch, make.com", "Einsteiger mit selbstständig geführter Arbeit",
    "Professional in Process Mining, Problemlösung", "Große Größe: scikit learn, scikitlearn, scikit-learn",
]
CITIES = [
    "Berlin", "berlin", "Berlin (DE)", "München", " frankfurt-höchst ", "Halle, Saale", None, "Unknown", "Köln",
    "KÖLN", "Hamburg", "Bremen", "Leipzig", "Dresden", "Bonn", "Essen", "Dortmund", "Ulm", "Jena", "Mainz", "Trier",
    "Kiel", "Lübeck", "Rostock", "Erfurt", "Kassel", "Fulda", "Siegen", "Hagen", "Hamm", "Gera",
]
STATES = [
    "Berlin", "Bayern", "Hessen", "Sachsen", None, "Unknown", "Bremen", "Hamburg", "Saarland", "Thüringen",
    "Brandenburg", "Niedersachsen", "Sachsen-Anhalt", "Rheinland-Pfalz", "Baden-Württemberg", "Nordrhein-Westfalen",
    "Schleswig-Holstein", "Mecklenburg-Vorpommern", "bayern",
]
LEVELS = ["entry", "advanced", " Entry", "ADVANCED", None, "entry", "advanced "]
HARD = [
    "Python, SQL", "SQL", "Power BI, SQL, Low-Code, n8n", None, "", " Scrum ,, Kanban", "Process Mining, Celonis",
    "SAP", "Change Management, Agile", "Azure, AWS, Docker, Kubernetes", "Größe, größe, Sql",
    "PyTorch, TensorFlow, Keras, scikit-learn", "x, Jira, Confluence",
]
SOFT = [
    "Communication, Teamwork", "Leadership", None, "Problem Solving, Ownership", "", "Stakeholder Management",
    "Analytical Thinking, Communication", "Collaboration", "Self-Organization, Teamwork, Teamwork",
    "Führung, führung", "Ownership",
]
GEO_CITIES = [
    "berlin", "Berlin", " münchen ", "KÖLN", "hamburg", "Bremen", "leipzig", "Bonn (Nord)", "ulm", "kiel",
    "frankfurt-höchst", "mainz", "Halle Saale",
]
DAY = "cast(o_orderdate as date)"
HOT = "k % 3 = 0"

# One row per order: the raw fields of a vacancy, and text phrases for its page.
RAW_SQL = f"""
select k, term_rank, {pick("term_rank - 1", TERMS)} as search_term, 1 as page, pos,
  case when {HOT} then case when k % 2 = 0 then 'Prozessmanager RPA' else 'PROZESSMANAGER rpa' end
       else {pick("k", TITLES)} end as titel,
  {pick("k", ["Kaufmann", "", None, "  ", " Analyst "])} as beruf,
  {pick("k", ["Fachkraft", "Analyst", None, "Manager", "", "Planer", "Techniker"])} as berufsbezeichnung,
  case when {HOT} then 'Großfirma' when k % 31 = 4 then null else 'Firma ' || cast(cust % 40 as varchar(10)) end
    as arbeitgeber,
  case when {HOT} then {pick("k", ['"Berlin, Deutschland"', '"berlin, Deutschland"'])}
       else {pick("k", PLACES)} end as arbeitsort,
  case k % 7 when 0 then null when 1 then '' when 2 then day || 'T23:30:00+02:00' when 3 then day || ' 08:15'
    when 4 then substr(day, 9, 2) || '.' || substr(day, 6, 2) || '.' || substr(day, 1, 4)
    else day end as tag1,
  case k % 5 when 0 then null when 1 then '' when 2 then replace(day, '-', '') when 3 then 'bald' else day end as tag2,
  case k % 3 when 0 then day when 1 then '2001-02-30' else null end as tag3,
  case when k % 11 = 0 then null when k % 17 = 1 then ''
       else '10000-' || cast(k as varchar(20)) || '_S/ä' end as refnr,
  {pick("k", ["50000", "", None, "nach Tarif"])} as entgelt,
  {pick("k", ["", "VB", None])} as salary,
  {pick("k", ["unbefristet", None, ""])} as befristung,
  {pick("k", ["ARBEIT", "", None, "AUSBILDUNG"])} as angebotsart,
  {pick("k", PHRASES)} as phrase1,
  {pick("k + 5", PHRASES)} as phrase2,
  {pick("k * 3 + 1", PHRASES)} as phrase3,
  case when k % 10 = 3 then -1 else k % 8 end as page_kind,
  case when {HOT} then 1 else k % 50 end as partner,
  case when k % 97 = 5 then 'titel is not a string' when k % 101 = 7 then 'refnr is not a string'
       when k % 103 = 9 then 'item is not an object' end as fault
from (select o_orderkey as k, o_custkey as cust, cast(o_orderkey % 13 as int) + 1 as term_rank,
        cast(o_orderkey as int) as pos, cast({DAY} as varchar(10)) as day
      from {{orders}}) base
"""

# One row per order: the analysis table.
ANALYSIS_SQL = f"""
select k, {pick("k", [*TERMS, None, *TERMS[:3]])} as search_term, case when k % 19 = 11 then 'Data Engineer Abteilung ' || cast(cast(floor(k / 190) as bigint) as varchar(20))
       else {pick("k", TITLES)} end as job_title, posted_date,
  case when k % 3 = 0 then 'Berlin' else {pick("k", CITIES)} end as city,
  {pick("k", STATES)} as state,
  {pick("k", HARD)} as hard_skills,
  {pick("k", SOFT)} as soft_skills,
  {pick("k", LEVELS)} as experience_level
from (select o_orderkey as k, case when o_orderkey % 37 = 0 then null else {DAY} end as posted_date
      from {{orders}}) base
"""

# City coordinates, one row per supplier; the first row of a city counts.
GEO_SQL = f"""
select {pick("s_suppkey", GEO_CITIES)} as "City",
  case when s_suppkey % 7 = 3 then null else cast(47 + s_suppkey % 8 as double) end as "Latitude",
  case when s_suppkey % 19 = 5 then null else cast(6 + s_suppkey % 9 as double) end as "Longitude",
  s_suppkey as cache_row
from {{supplier}}
"""

# Newly found coordinates, one row per customer.
FOUND_SQL = """
select 'Stadt ' || cast(c_custkey % 97 as varchar(10)) as "City",
  cast(case when c_custkey % 97 % 5 = 0 then 0 when c_custkey % 97 % 11 = 0 then null else 48 + c_custkey % 97 % 6 end
    as double) as "Latitude",
  cast(7 + c_custkey % 97 % 4 as double) as "Longitude"
from {customer}
group by c_custkey % 97
"""

LINK = S.EXTERNAL_LINK_ID


def html_sql() -> str:
    """HTML of a vacancy's page by ``page_kind``; -1 is no page."""
    anchor = f"""'<a id="{LINK}" href=" https://partner.example/jobs/' || cast(partner as varchar(10)) || '?x=1 ">Zur Stelle</a>'"""
    return f"""case page_kind
  when 0 then '<html><head><title>t</title><style>p{{{{}}}}</style></head><body><h1>Stelle</h1><h2>Ihre Aufgaben:</h2><p>'
    || phrase1 || '</p><ul><li>' || phrase2
    || '</li><li>SQL</li></ul><span>x</span><p>lost</p><h3>Ihr <b>Profil</b></h3><div>' || phrase3
    || '</div><h2>Sonstiges</h2><p>egal</p></body></html>'
  when 1 then '<body><p><strong>Ihr Profil</strong></p><p>' || phrase1
    || '</p><p><strong>Wir bieten</strong></p><div>' || phrase2 || '</div><div>' || phrase3 || '</div></body>'
  when 2 then '<div>Intro</div><div>Aufgaben:</div><div>' || phrase1 || '</div><div>' || phrase2
    || '</div><div>Profil:</div><div>Wir bieten ::</div><div>' || phrase3 || '</div>'
  when 3 then '<p>' || phrase1 || ' &amp; <b>' || phrase2 || '</b><script>var t="</p>";</script></p>'
  when 4 then '<body>' || {anchor} || '<h2>Profil</h2><p>' || phrase1 || '</p></body>'
  when 5 then ''
  when 6 then '<script>var a = 1;</script><!-- nichts -->'
  when 7 then '<h2>Profil</h2><p>' || phrase1 || '</p><h2>Profil</h2><p>' || phrase2 || '<p>' || phrase3
end"""


PAGES_SQL = f"""
select '10000-' || cast(k as varchar(20)) || '_S__.html' as page_key, {html_sql()} as html
from ({RAW_SQL}) raw where page_kind >= 0
"""

EXT_PAGES_SQL = f"""
select 'https___partner_example_jobs_' || cast(partner as varchar(10)) || '_x_1.html' as page_key,
  '<html><body><h2>Profil</h2><p>' || {pick("partner", PHRASES)} || '</p><p>Agile</p></body></html>' as html
from (select distinct partner from ({RAW_SQL}) raw) links where partner % 5 <> 0
"""

# Whole documents with section titles around the text; one in five has none.
SECTIONED_SQL = f"""
select doc_id, case when doc_id % 5 = 0 then text else
  'Kopf' || chr(10) || ' Aufgaben: ' || chr(10) || text || chr(10) || 'Profil::' || chr(10) || {pick("doc_id", PHRASES)}
  || chr(10) || case doc_id % 3 when 0 then 'Aufgaben:' when 1 then 'Ihre AUFGABEN :' else 'Sonstiges:' end
  || chr(10) || 'Wir bieten:' || chr(10) || 'Über uns:' || chr(10) || {pick("doc_id + 3", PHRASES)} end as text
from {{documents}}
"""

# Whole documents with a phrase of the domain in front.
PHRASED_SQL = f"""
select doc_id, lang, {pick("doc_id", PHRASES)} || ' ' || text as text from {{documents}}
"""

# Whole documents that name a buyer and an article behind their text; some are none of the given ones.
NAMED = [
    "small rings", "RED widget", "bluebolt", "hot gearbox", "xsmall ring", "green gizmo and hot gear", "Widgets", "a rewidgeted part", "old  bolt", None,
]
NAMED_SQL = f"""
select doc_id, coalesce(text, '') || ' Customer#' || lpad(cast(doc_id * 37 % 20011 as varchar(10)), 9, '0') || '; ' || coalesce({pick("doc_id", NAMED)}, '')
  as text
from {{documents}}
"""

# A dictionary that grows with the tables: buyers by number, articles with variants, parts of words, a very common word, any year.
DICTIONARY_SQL = r"""
select '\\b' || lower(c_name) || '\\b' as pattern, 'buyer ' || cast(c_custkey % 5000 as varchar(10)) as label from {customer}
union all
select distinct '\\b' || replace(p_name, ' ', ' ?') || 's?\\b', 'article ' || p_name from {part}
union all
select * from (values ('\\bthe\\b', 'common'), ('widget', 'part of word'), ('gear(box)?\\b', 'part of word'), ('\\b[0-9]{{4}}\\b', 'year'), (null, 'none'))
  as v(pattern, label)
"""

# Landed result pages: up to 100 items each, in either of the two lists.
LANDED_SQL = """
select o_orderkey as k, cast(o_orderkey % 13 as int) + 1 as term_rank,
  cast(floor(o_orderkey / 1300) as int) + 1 as page, cast(floor(o_orderkey / 13) % 100 as int) as slot
from {orders}
"""

ITEM_JSON_SQL = """
case fault when 'item is not an object' then '"text"' else
  '{{"titel":' || case when fault = 'titel is not a string' then '5' else coalesce('"' || titel || '"', 'null') end
  || ',"beruf":' || coalesce('"' || beruf || '"', 'null')
  || ',"berufsbezeichnung":' || coalesce('"' || berufsbezeichnung || '"', 'null')
  || ',"arbeitgeber":' || coalesce('"' || arbeitgeber || '"', 'null')
  || ',"arbeitsort":' || arbeitsort
  || ',"aktuelleVeroeffentlichungsdatum":' || coalesce('"' || tag1 || '"', 'null')
  || ',"veroeffentlichtAm":' || coalesce('"' || tag2 || '"', 'null')
  || ',"modifikationsTimestamp":' || coalesce('"' || tag3 || '"', 'null')
  || ',"refnr":' || case when fault = 'refnr is not a string' then '7' else coalesce('"' || refnr || '"', 'null') end
  || ',"entgelt":' || coalesce('"' || entgelt || '"', 'null')
  || ',"salary":' || coalesce('"' || salary || '"', 'null')
  || ',"befristung":' || coalesce('"' || befristung || '"', 'null')
  || ',"angebotsart":' || coalesce('"' || angebotsart || '"', 'null') || '}}' end
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The given tables, their rows dealt out to all tasks: derived rows are many times as large as the given ones."""
    names = ["orders", "customer", "supplier", "documents", "pages", "part"]
    found = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found | {name: found[name].repartition(parts) for name in ("orders", "documents")}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents, one file, dealt out to all tasks."""
    return tables(spark, sf_dir)["documents"]


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the statements above on the given tables."""
    text = sql.replace('"City"', "City").replace('"Latitude"', "Latitude").replace('"Longitude"', "Longitude")
    used = {name: df for name, df in tables(spark, sf_dir).items() if "{" + name + "}" in text}
    return spark.sql(text, **used)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RAW_SQL)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ANALYSIS_SQL)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_term, term_rank, page, pos, item`` with the item as a variant."""
    json = derive(spark, sf_dir, f"select search_term, term_rank, page, pos, {ITEM_JSON_SQL} as json from ({RAW_SQL}) raw")
    return json.selectExpr("search_term", "term_rank", "page", "pos", "explode(array(parse_json(json))) as item")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_term, page`` and the two item lists of each landed page."""
    landed = derive(spark, sf_dir, f"select *, {pick('term_rank - 1', TERMS)} as search_term from ({LANDED_SQL}) l")
    return (
        landed.groupBy("search_term", "page")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "k"))).alias("found"))  # 100 at most, by construction
        .selectExpr("search_term", "page", "array_join(transform(found, x -> concat('{\"k\":', x.k, '}')), ',') as json")
        .selectExpr(
            "search_term",
            "page",
            """case page % 3 when 0 then concat('{"stellenangebote":[', json, '],"jobs":[{"k":-1}]}')
               when 1 then concat('{"stellenangebote":[],"jobs":[', json, ']}')
               else concat('{"jobs":[', json, ']}') end as json""",
        )
        .select("search_term", "page", F.from_json("json", S.ENVELOPE_SCHEMA).alias("envelope"))
        .select("search_term", "page", "envelope.*")
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, PAGES_SQL)


def ext_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, EXT_PAGES_SQL)


def geocache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, GEO_SQL)


def found_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FOUND_SQL)


def for_duckdb(sql: str) -> str:
    """The same statement over the checking database's views."""
    return sql.format(orders="orders", customer="customer", supplier="supplier", documents="documents", pages="pages", part="part")
