"""Fixed values of the vacancy domain and the table schemas.

Everything that a caller may want to replace (dictionaries, keyword lists, weights, stop words,
top-N sizes) is passed to the operators as a parameter; the values below are the defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# These must stay exactly as they are for results to be right.
# ---------------------------------------------------------------------------------------------

SEARCH_TERMS = [
    "Business Transformation Analyst",
    "Digital Process Analyst",
    "AI Governance Analyst",
    "AI Automation Specialist",
    "Prompt Engineer",
    "Junior Automation Specialist",
    "AI Project Manager",
    "AI Product Manager",
    "Prozessmanager/in",
    "KI-Manager/in",
    "Prozessmanager/in – RPA",
    "KI-Prompter",
    "Prozessmanager/in – RPA (Junior)",
]

DAYS_WINDOW = 365

JOB_URL_PREFIX = "https://www.arbeitsagentur.de/jobsuche/jobdetail/"
SOURCE_NAME = "Arbeitsagentur"
EXTERNAL_LINK_ID = "detail-beschreibung-externe-url-btn"
LOCATION_PARTS = ["plz", "ort", "ortsteil", "region", "land", "strasse"]

# (regular expression, label)
HARD_SKILLS = [
    (r"\bpython\b", "Python"),
    (r"\btensorflow\b", "TensorFlow"),
    (r"\b(pytorch|torch)\b", "PyTorch"),
    (r"\bscikit-?learn\b", "scikit-learn"),
    (r"\bkeras\b", "Keras"),
    (r"\bmlops\b", "MLOps"),
    (r"\bazure\b", "Azure"),
    (r"\baws\b", "AWS"),
    (r"\bgcp\b", "GCP"),
    (r"\b(kubernetes|k8s)\b", "Kubernetes"),
    (r"\bdocker\b", "Docker"),
    (r"\bsql\b", "SQL"),
    (r"\b(no ?sql|nosql)\b", "NoSQL"),
    (r"\bspark\b", "Spark"),
    (r"\bnlp\b", "NLP"),
    (r"\b(llm|large language model)\b", "LLM"),
    (r"\buipath\b", "UiPath"),
    (r"\bautomation anywhere\b", "Automation Anywhere"),
    (r"\bblue prism\b", "Blue Prism"),
    (r"\brpa\b", "RPA"),
    (r"\bprocess mining\b", "Process Mining"),
    (r"\bcelonis\b", "Celonis"),
    (r"\bbpmn\b", "BPMN"),
    (r"\bsix sigma\b", "Six Sigma"),
    (r"\blean\b", "Lean"),
    (r"\bjira\b", "Jira"),
    (r"\bconfluence\b", "Confluence"),
    (r"\bscrum\b", "Scrum"),
    (r"\bkanban\b", "Kanban"),
    (r"\bexcel\b", "Excel"),
    (r"\bpower ?bi\b", "Power BI"),
    (r"\bsap\b", "SAP"),
    (r"\bagile\b", "Agile"),
    (r"\bchange management\b", "Change Management"),
    (r"\bdigitalisierung\b", "Digitalisierung"),
    (r"\bstrategie\b", "Strategie"),
    (r"\bconsulting\b", "Consulting"),
    (r"\blow-?code\b", "Low-Code"),
    (r"\bno-?code\b", "No-Code"),
    (r"\bmake\.com\b", "Make.com"),
    (r"\bn8n\b", "n8n"),
]

SOFT_SKILLS = [
    (r"\bcommunication\b|\bkommunikation\b", "Communication"),
    (r"\bteamwork\b|\bteamarbeit\b", "Teamwork"),
    (r"\bleadership\b|\bführung\b|\bfuehrung\b", "Leadership"),
    (r"\bproblem-?solving\b|\bproblemlösung\b", "Problem Solving"),
    (r"\bownership\b|\bverantwortung\b", "Ownership"),
    (r"\bstakeholder\b", "Stakeholder Management"),
    (r"\bcollaboration\b|\bzusammenarbeit\b", "Collaboration"),
    (r"\banalytical\b|\banalytisch\b", "Analytical Thinking"),
    (r"\bself-?organized\b|\bselbstständig\b", "Self-Organization"),
]

LEVEL_PATTERNS = [
    (r"\bjunior\b|\beinsteiger\b", "Junior"),
    (r"\bmid(dle)?\b|\bprofessional\b", "Mid"),
    (r"\bsenior\b|\bexperte\b|\bexpert\b", "Senior"),
    (r"\blead\b|\bprincipal\b|\bmanager\b", "Lead"),
]

LEVEL_ORDER = ["Junior", "Mid", "Senior", "Lead"]

LEVEL_ALIASES = {
    "Junior": ["entry", "junior"],
    "Mid": ["mid", "middle", "professional"],
    "Senior": ["senior", "expert", "experte"],
    "Lead": ["lead", "principal", "manager"],
}

LEVEL_CLASSES = {"Junior": "entry", "Mid": "entry", "Senior": "advanced", "Lead": "advanced"}

TITLE_ENTRY_KEYWORDS = [
    "junior", "jr", "einsteiger", "ausbildung", "azubi", "trainee",
    "praktikant", "praktikum", "intern", "internship",
    "werkstudent", "werkstudierende", "student", "working student",
    "assistant", "associate", "entry", "graduate",
    "volontariat", "volontär", "schülerpraktikum", "berufseinstieg",
]

TITLE_ADVANCED_KEYWORDS = [
    "senior", "sr", "lead", "teamleiter", "team lead", "leiter",
    "head of", "principal", "manager", "managing", "director",
    "expert", "experte", "consultant senior", "architect",
    "chef", "vorstand", "bereichsleiter", "projektleiter",
    "projektleitung", "supervisor",
]

TITLE_LEAD_KEYWORDS = ["lead", "teamleiter", "head of", "principal", "manager", "managing", "director"]

# level -> keyword -> weight, levels in tie order
LEVEL_SIGNALS = {
    "lead": {
        "qualifizierung": 2,
        "schulung": 2,
        "mitarbeiter": 3,
        "teamfähigkeit": 1,
        "einsatzplanung": 3,
        "kpi": 3,
        "qualitätssicherung": 2,
        "qualitätsmanagement": 3,
        "sonderentscheidungen": 3,
        "verantwortung": 3,
        "koordination": 2,
        "führung": 3,
        "leitung": 3,
        "teamleitung": 4,
        "steuerung": 2,
    },
    "senior": {
        "vertiefte kenntnisse": 3,
        "sehr gute kenntnisse": 3,
        "prozesse": 1,
        "anwendungen": 1,
        "fachanweisungen": 2,
        "mehrjährige erfahrung": 3,
        "expertise": 3,
        "selbstständig": 2,
    },
    "mid": {
        "kenntnisse": 1,
        "erfahrung": 1,
        "prozesse": 1,
        "aufgaben": 1,
        "verantwortlich": 1,
    },
    "junior": {
        "grundkenntnisse": 2,
        "erste erfahrungen": 2,
        "einsteiger": 3,
        "ausbildung": 1,
        "unterstützung": 1,
    },
}

# (phrases any of which must occur, level -> extra points)
LEVEL_BOOSTS = [
    (["team führen", "führung", "leitung", "mitarbeiter führen"], {"lead": 5}),
    (["verantwortung für"], {"lead": 3, "senior": 2}),
    (["mehrjährige erfahrung"], {"senior": 4}),
]
# added to junior only when lead and senior have no points at all
TRAINING_WORD = "ausbildung"
TRAINING_BOOST = 2

GERMAN_STATES = [
    "baden-württemberg", "bayern", "berlin", "brandenburg", "bremen", "hamburg", "hessen",
    "mecklenburg-vorpommern", "niedersachsen", "nordrhein-westfalen", "rheinland-pfalz",
    "saarland", "sachsen", "sachsen-anhalt", "schleswig-holstein", "thüringen",
]
CITY_STATES = ["berlin", "hamburg", "bremen"]
COUNTRY = "deutschland"
STREET_SUFFIXES = ["straße", "str.", "weg", "allee", "platz", "ring", "gasse"]
UNKNOWN = "Unknown"
ADDRESS_LETTERS = "A-Za-zÄÖÜäöüß"
# month names of posting dates, by number
MONTHS = {
    1: ["january", "jan", "januar", "jänner"], 2: ["february", "feb", "februar"], 3: ["march", "mar", "märz", "mrz"],
    4: ["april", "apr"], 5: ["may", "mai"], 6: ["june", "jun", "juni"], 7: ["july", "jul", "juli"], 8: ["august", "aug"],
    9: ["september", "sep", "sept"], 10: ["october", "oct", "oktober", "okt"], 11: ["november", "nov"],
    12: ["december", "dec", "dezember", "dez"],
}

SECTION_TITLES = [
    "stellenbeschreibung", "ihre aufgaben", "ihr profil", "wir bieten", "über uns",
    "das bringen sie mit", "das erwartet sie", "aufgaben", "profil",
]
SECTION_BODY_TAGS = ["p", "ul", "ol", "div"]

GERMAN_STOP_WORDS = [
    "und", "oder", "aber", "nicht", "mit", "für", "von", "im", "in", "am",
    "an", "auf", "aus", "dem", "der", "die", "das", "ein", "eine", "einer",
    "ist", "sind", "war", "werden", "wird", "zu", "zum", "zur",
]

TITLE_NOISE = [
    r"\b(m/w/d|mwd|m/f/d)\b",
    r"\b(remote|hybrid|onsite|home\s*office)\b",
    r"\b(vollzeit|teilzeit|werkstudent|praktikum)\b",
    r"\b(junior|jr\.?|mid|senior|sr\.?|lead|principal|expert)\b",
]

TOP_SKILLS = 20
TOP_CITIES = 25
TOP_STATES = 16
TOP_WORDS = 30
TOP_CLUSTER_TERMS = 8
CLUSTER_EXAMPLES = 5
TITLE_CLUSTERS = 5
SKILL_CLUSTERS = 6
SKILL_CLUSTER_SHOWN = 20
MIN_EXTERNAL_CHARS = 500
CLUSTER_SEED = 42
COMPARED_LEVELS = ["entry", "advanced"]

# ---------------------------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------------------------

# One landed result page of the vacancy search. Items stay variants: their fields may hold any JSON type.
ENVELOPE_SCHEMA = "stellenangebote array<variant>, jobs array<variant>"

PAGE_SCHEMA = "page_key string, html string"

GEO_SCHEMA = "City string, Latitude double, Longitude double"

VACANCY_SCHEMA = T.StructType(
    [
        T.StructField("search_term", T.StringType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("beruf", T.StringType()),
        T.StructField("job_url", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("posted_date", T.DateType()),
        T.StructField("location", T.StringType()),
        T.StructField("index", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("description_full", T.StringType()),
        T.StructField("description_sections_json", T.StringType()),
        T.StructField("description_sections_text", T.StringType()),
        T.StructField("description_source", T.StringType()),
        T.StructField("html_quality", T.StringType()),
        T.StructField("html_filename", T.StringType()),
        T.StructField("salary", T.StringType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("hard_skills", T.StringType()),
        T.StructField("soft_skills", T.StringType()),
        T.StructField("work_experience", T.StringType()),
        T.StructField("experience_level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("normalized_at", T.TimestampType()),
    ]
)
VACANCY_COLUMNS = VACANCY_SCHEMA.fieldNames()
