"""Word lists, patterns, formats and limits that results depend on. Nothing here is logic."""

from __future__ import annotations

# ---- fixed values: limits ----------------------------------------------------------------------------------------
MAX_BYTES = 10_000_000
MAX_PAGES = 5_000
SNIFF_BYTES = 8_000
NUL_RATIO, DOMINANT_RATIO, MINORITY_RATIO = 0.15, 0.6, 0.15
NEIGHBOURS, MIN_SIMILARITY = 10, 0.05
DAMPING, MAX_ROUNDS, TOLERANCE = 0.85, 50, 1e-6
LEAST_DENSITY = 0.005
SHORT_UNIT = 10
CSV_ROWS = 10

# ---- fixed values: ingest and sentences ----------------------------------------------------------------------------
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
ABBREVIATED = r"e\.g|i\.e|etc|vs|dr|mr|mrs|ms|prof|inc|ltd|approx|z\.b|d\.h|u\.a|bzw|usw|ca|str|p\.ex|c\.-à-d|mme|mlle|p\.ej|aprox|sr|sra|dra|art"
OTHER_STOPS = "。！？؟۔।॥"
WORD = r"\b\w{3,}\b"
TOKEN = r"\b[\w\.:/-]+\b|[一-鿿぀-ヿ가-힯]"

# ---- fixed values: atom classes, in order of detection ---------------------------------------------------------------
# kind, pattern, ignore case, required, counts as an entity
_WEST = (
    r"no|not|never|without|neither|nor|cannot|zero|não|nunca|jamais|sem|nenhum|nenhuma|jamás|sin|ningún|ninguno|ninguna|tampoco|"
    r"pas|aucun|aucune|sans|rien|nicht|kein|keine|keinen|keinem|nie|niemals|ohne"
)
_HEBREW = r"לא|ללא|אין|אל|בלי|אינו|אינה|אינם|אינן"
_OTHER = r"не|нет|никогда|без|никакой|नहीं|मत|बिना|না|নয়|বিনা|لم|لن|ليس|بدون"
NEGATIONS = f"{_WEST}|{_HEBREW}|{_OTHER}"
_BOUND = r"[^\s\.,;!?:\"'\(\)\[\]\{\}]+"
UNITS = r"MB|GB|TB|kB|KB|ms|µs|ns|s|sec|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|wk|week|weeks|mo|month|months|yr|year|years|\$|USD|EUR|billion|million|thousand|ppb|M"
ATOMS = (
    ("cve", r"\bCVE-\d{4}-\d{4,7}\b", True, True, True),
    ("instance_id", r"\bi-[0-9a-f]{8,17}\b", False, True, True),
    ("ipv4", r"\b(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?::\d{2,5})?\b", False, True, True),
    ("ipv6", r"\b[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*)?\b|\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|::1\b", False, True, True),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", False, True, True),
    ("git_sha", r"\b[0-9a-fA-F]{64}\b|\b[0-9a-fA-F]{40}\b", False, True, True),
    ("git_sha_short", r"\b(?=[0-9a-f]{7,12}\b)(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,12}\b", True, True, True),
    ("path_or_url", r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>\"'()]+|arn:aws:[a-zA-Z0-9_\.\-]+:[a-zA-Z0-9_\.\-]*:(?:\d{12})?:[a-zA-Z0-9_\.\-/:*]+|/[a-zA-Z0-9_\.\-]+(?:/[a-zA-Z0-9_\.\-]+)+|[a-zA-Z0-9_\.\-]+(?:\.[a-zA-Z0-9_\.\-]+)+/[^\s]*)", False, False, True),
    ("file_location", r"\b[a-zA-Z0-9_\.\-]+(?:\s*/\s*[a-zA-Z0-9_\.\-]+)+(?::\d+(?::\d+)?)?\b", False, False, True),
    ("quantity", rf"\b(\d+(?:[\.,]\d+)*)\s*({UNITS})\b|\b(\d+(?:[\.,]\d+)*)%", True, False, True),
    ("currency", r"(?:[\$€£]\s*|(?:USD|EUR)\s*)(\d+(?:[\.,]\d+)*(?:\s*(?:billion|million|thousand|[MmkK]))?)\b", False, False, True),
    ("code_identifier", r"\b(?:[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+|[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+|[a-zA-Z0-9_]+::[a-zA-Z0-9_:]+|[a-z0-9]+(?:_[a-z0-9]+)+|[a-zA-Z0-9]+-[a-zA-Z0-9-]*(?:\d[a-zA-Z0-9-]*))\b", False, False, True),
    ("timestamp", r"\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?\b|\b\d{2}:\d{2}(?::\d{2})?(?:\s*UTC)\b", False, False, True),
    ("bound_negation", rf"\b(?:{NEGATIONS})\s+({_BOUND}(?:\s+{_BOUND}){{0,2}})(?:\b|(?<=[׳״]))", True, False, True),
    ("cjk_negation", r"(?:不|没|没有|未|无|非)(?:[一-鿿]{1,4})", False, False, True),
    ("negation", rf"\b(?:{NEGATIONS})\b", True, False, False),
    ("modality", r"\b(must|should|may|might|could|shall)\b", True, False, False),
    ("condition", r"\b(if|unless|except|provided that|excluding)\b", True, False, False),
    ("causality", r"\b(because|therefore|caused by|results in|leads to)\b", True, False, False),
    ("compliance_acronym", r"\b(?:PII|GDPR|HIPAA|SOC2|mTLS|CIDR|STS|IAM|ACL|RBAC)\b", True, False, True),
    ("email", r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b", False, False, True),
)
#: Classes that are shown under another kind.
SHOWN = {"git_sha_short": "git_sha", "currency": "quantity", "cjk_negation": "bound_negation"}
#: What may not stand before an address, within so many characters, and what must stand beside a short hash.
VERSION_BEFORE, VERSION_CHARS = r"(?:upgrad(?:e|ed|ing)\s+from|downgrad(?:e|ed|ing)\s+from|version|release|section|upgrade|downgrade|v)[\s:#]{0,3}$", 24
HASH_BESIDE, HASH_CHARS = r"\b(?:commit|sha1?|sha256|rev|revision|rollback|hash|merge|cherry-pick|cherry-picked|fixes|fixed|tag|tagged|verified|build|ref|branch|head|rebase|parent|tree|blob)\b", 20
NOT_HASH = r"^\d+e\d+$"
CANONICAL_UNITS = dict(
    minute="min", minutes="min", mins="min", second="s", seconds="s", sec="s", hour="h", hours="h", hr="h", hrs="h",
    week="wk", weeks="wk", month="mo", months="mo", year="yr", years="yr",
)

# ---- fixed values: routes and parsers --------------------------------------------------------------------------------
HTML_TAGS = r"<!DOCTYPE\s+html\b|<html\b|<head\b|<body\b|<div\b|<table\b|<article\b|<section\b|<h[1-6]\b|<p\b|<ul\b|<ol\b|<li\b|<main\b|<header\b|<footer\b"
XML_START = r"^\s*<\?xml\b|^\s*<[a-zA-Z_][a-zA-Z0-9_\-\.:]*(?:\s+[^>]*)?>"
CODE_LINE = (
    r"^\s*(?:#\[test\]|#\[tokio::test\]|def\s+[a-zA-Z_]\w*\s*\(|async\s+def\s+[a-zA-Z_]\w*\s*\(|class\s+[a-zA-Z_]\w*[:\(]|@\w+|"
    r"fn\s+[a-zA-Z_]\w*(?:<[^>]+>)?\s*\(|pub\s+(?:struct|fn|enum)\s+[a-zA-Z_]\w*|struct\s+[a-zA-Z_]\w*\s*\{|impl\s+[a-zA-Z_]\w*|"
    r"enum\s+[a-zA-Z_]\w*\s*\{|export\s+(?:interface|type|function)\s+[a-zA-Z_]\w*|package\s+[a-zA-Z_]\w*\b|"
    r"func\s+(?:\([^\)]+\)\s*)?[a-zA-Z_]\w*\s*\(|import\s+[a-zA-Z_]\w*|from\s+[a-zA-Z_]\w*\s+import|"
    r"type\s+[a-zA-Z_]\w*(?:<[^>]+>)?\s*(?:struct|=)|(?:it|test)\s*\(\s*['\"])"
)
TEST_CODE = r"(?:#\[test\]|#\[tokio::test\]|def test_[a-zA-Z0-9_]+\(|it\(['\"]|test\(['\"])"
SIGNATURE = r"(?:fn\s+([a-zA-Z0-9_]+)(?:<[^>]+>)?\s*\(|def\s+([a-zA-Z0-9_]+)\s*\(|(?:it|test)\(\s*['\"]([^'\"]+)['\"])"
ASSERTION = r"(?:assert_eq!\s*\(([^,]+),\s*([^)]+)\)|assert\s+([^;\n]+))"
PARAGRAPH = r"\n\s*\n"
FROM_LINE, SUBJECT_LINE = r"^From:\s*(.+)$", r"^Subject:\s*(.+)$"
QUOTED = r"^(?:>|On\s+.+wrote:)"
ENVELOPE = r"^From \S+\s+\w{3}\s+\w{3}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2}\s+\d{4}\s*$"
MAIL_BREAK = r"(?:\r?\n\s*[-=_]{3,}\s*\r?\n+|\r?\n\s*\r?\n(?=From:\s*))"
HEADER_FIELD = r"^([A-Za-z0-9\-]+):\s*"
HEADERS = ("From", "To", "Cc", "Subject", "Date")
FOOTER = r"^(?:-{2,}\s*Yahoo!\s*Groups\s*Sponsor\s*-{2,}.*|to unsubscribe from this group\b.*|this sf\.net email is sponsored by\b.*|_{10,})$"
REQUEST = r"\b(?:please|could you|action required|need you to|kindly)\b"
DECISION = r"\b(?:decided to|agreed to|approved|confirmed|concluded)\b"
QUESTION_STARTS = ("Do ", "What ", "How ", "Could ")
COURTESIES = ("best regards", "thanks")
CARGO_HEAD = r"running \d+ tests?"
CARGO_RESULT = r"test result:\s*(FAILED|ok)\.\s*(\d+)\s*passed;\s*(\d+)\s*failed;\s*(\d+)\s*ignored.*finished in\s*([\d\.]+\w*)"
CARGO_FAILED = r"test\s+([^\s]+)\s+\.\.\.\s+FAILED"
CARGO_SECTION = r"----\s+([^\s]+)\s+stdout\s+----(.*?)(?=----\s+[^\s]+\s+stdout\s+----|\nfailures:|\Z)"
CARGO_ASSERT = r"assertion `left == right` failed\s*\n\s*left:\s*(.+)\s*\n\s*right:\s*(.+)"
CARGO_PLACE = r"panicked at ([^:]+:\d+:\d+):"
PYTEST_HEAD = r"==+ test session starts =+"
PYTEST_RESULT = r"=+\s*(?:(\d+)\s*failed,?\s*)?(?:(\d+)\s*passed,?\s*)?.*in\s*([\d\.]+s)\s*=+"
PYTEST_SECTION = r"_{3,}\s*(\S+?)\s*_{3,}\n(.*?)(?=\n\s*_{3,}|\n\s*=+|\Z)"
PYTEST_PLACE = r"([a-zA-Z0-9_\.\-/]+:\d+):\s*(?:AssertionError|in\s+)"
PYTEST_ASSERT = r"E\s+assert\s+(.+)\s*==\s*(.+)"
VITEST_FAIL, VITEST_PLACE = r"FAIL\s+([^\n]+)", r"❯\s+([^\s:]+:\d+:\d+)"
VITEST_EXPECT = r"- Expected:\s*\n\s*([^\n]+)\s*\n\+\s*Received:\s*\n\s*([^\n]+)"
VITEST_RESULT = r"Tests\s+(?:(\d+)\s*failed)?\s*\|\s*(\d+)\s*passed.*Duration\s+([\d\.]+\w*)"
LOG_MARKS = ("FAIL ", "FAIL\n", "FAIL\t", "FAILED", "=== RUN")

# ---- fixed values: boilerplate and preambles --------------------------------------------------------------------------
BOILERPLATE = (
    (r"^\d{1,4}$", False),
    (r"^(?:Table of Contents|Inhaltsverzeichnis|Table des matières|Índice|Tabla de contenidos|目录|目次)$", True),
    (r"^[I|V|X]+\.\s+.*?\s+\d+$", False),
    (r"^[A-Z]\.\s+.*?\s+\d+$", False),
    (r"^\s*[-=_*~]{3,}\s*$", False),
)
PREAMBLES = (
    r"^It\s+is\s+(?:important|worth|critical|notable)\s+to\s+note\s+that,?\s*",
    r"^It\s+should\s+be\s+noted\s+that,?\s*",
    r"^As\s+(?:previously|earlier|already)\s+(?:explained|described|noted|mentioned)(?:\s+in\s+Section\s+[A-Z0-9]+)?,?\s*",
    r"^In\s+(?:the\s+course|furtherance)\s+of\s+(?:carrying\s+out\s+)?(?:the\s+[^,]+),?\s*",
    r"^For\s+these\s+reviews,?\s*",
    r"^With\s+the\s+benefit\s+of\s+hindsight,?\s*",
    r"^The\s+goal\s+of\s+the\s+evaluation\s+is\s+to\s*",
    r"^During\s+these\s+evaluations,?\s*(?:however,?)?\s*",
    r"^In\s+particular,?\s*",
    r"^Additionally,?\s*",
    r"^Furthermore,?\s*",
    r"^Moreover,?\s*",
    r"^Specifically,?\s*",
    r"^In\s+order\s+to\s+(?:ensure|verify|investigate)\s+that,?\s*",
    r"^As\s+a\s+result\s+of\s+(?:this|these)\s+(?:actions|findings),?\s*",
    r"^(?:Wie\s+(?:bereits|oben)\s+(?:erwähnt|beschrieben|ausgeführt),?\s*)",
    r"^(?:Im\s+Rahmen\s+der\s+(?:Durchführung|Untersuchung)\s+von\s+[^,]+,?\s*)",
    r"^(?:Darüber\s+hinaus|Zusätzlich|Ferner|Des\s+Weiteren),?\s*",
    r"^(?:Il\s+convient\s+de\s+(?:noter|souligner)\s+que,?\s*)",
    r"^(?:Il\s+est\s+à\s+noter\s+que,?\s*)",
    r"^(?:Comme\s+(?:mentionné|indiqué)\s+précédemment,?\s*)",
    r"^(?:Dans\s+le\s+cadre\s+de\s+[^,]+,?\s*)",
    r"^(?:Il\s+faut\s+garder\s+à\s+l'esprit\s+que,?\s*)",
    r"^(?:Cabe\s+(?:señalar|destacar|resaltar)\s+que,?\s*)",
    r"^(?:Es\s+importante\s+(?:tener\s+en\s+cuenta|notar)\s+que,?\s*)",
    r"^(?:Como\s+se\s+(?:mencionó|indicó)\s+anteriormente,?\s*)",
    r"^(?:En\s+el\s+marco\s+de\s+[^,]+,?\s*)",
    r"^(?:Es\s+preciso\s+mencionar\s+que,?\s*)",
)

# ---- fixed values: rewriting tables -----------------------------------------------------------------------------------
# phrase, short form, rule
PHRASES = (
    ("as a result of", "due to", "wg_as_result_of"),
    ("due to the fact that", "because", "wg_due_to_fact"),
    ("in order to", "to", "wg_in_order_to"),
    ("for the purpose of", "to", "wg_for_purpose_of"),
    ("for the reason that", "because", "wg_for_reason_that"),
    ("in the event that", "if", "wg_in_event_that"),
    ("in view of the fact that", "since", "wg_in_view_of_fact"),
    ("owing to the fact that", "because", "wg_owing_to_fact"),
    ("in accordance with", "per", "wg_in_accordance_with"),
    ("in connection with", "about", "wg_in_connection_with"),
    ("with respect to", "re:", "wg_with_respect_to"),
    ("with regard to", "re:", "wg_with_regard_to"),
    ("in reference to", "re:", "wg_in_reference_to"),
    ("prior to", "before", "wg_prior_to"),
    ("subsequent to", "after", "wg_subsequent_to"),
    ("in the course of", "during", "wg_in_course_of"),
    ("during the course of", "during", "wg_during_course_of"),
    ("by means of", "by", "wg_by_means_of"),
    ("by virtue of", "by", "wg_by_virtue_of"),
    ("in excess of", "over", "wg_in_excess_of"),
    ("in addition to", "besides", "wg_in_addition_to"),
    ("with the exception of", "except", "wg_with_exception_of"),
    ("at this point in time", "now", "wg_at_this_point"),
    ("at the present time", "now", "wg_at_present_time"),
    ("at the moment", "now", "wg_at_the_moment"),
    ("in the near future", "soon", "wg_in_near_future"),
    ("at an early date", "soon", "wg_at_early_date"),
    ("until such time as", "until", "wg_until_such_time"),
    ("at the same time that", "while", "wg_at_same_time_that"),
    ("on a regular basis", "regularly", "wg_on_regular_basis"),
    ("on a daily basis", "daily", "wg_on_daily_basis"),
    ("on a weekly basis", "weekly", "wg_on_weekly_basis"),
    ("on a monthly basis", "monthly", "wg_on_monthly_basis"),
    ("period of time", "period", "pl_period_of_time"),
    ("point in time", "time", "pl_point_in_time"),
    ("a large number of", "many", "wg_large_num_of"),
    ("a majority of", "most", "wg_majority_of"),
    ("a small number of", "few", "wg_small_num_of"),
    ("a number of", "several", "wg_num_of"),
    ("the vast majority of", "most", "wg_vast_majority_of"),
    ("in close proximity to", "near", "wg_in_close_proximity"),
    ("close proximity", "proximity", "pl_close_proximity"),
    ("take into consideration", "consider", "pl_take_into_consideration"),
    ("give consideration to", "consider", "pl_give_consideration_to"),
    ("make an assumption", "assume", "pl_make_assumption"),
    ("make a decision", "decide", "pl_make_decision"),
    ("make a determination", "determine", "pl_make_determination"),
    ("conduct an investigation", "investigate", "pl_conduct_investigation"),
    ("come to an agreement", "agree", "pl_come_to_agreement"),
    ("reach a conclusion", "conclude", "pl_reach_conclusion"),
    ("has the ability to", "can", "pl_has_ability_to"),
    ("have the ability to", "can", "pl_have_ability_to"),
    ("is able to", "can", "pl_is_able_to"),
    ("are able to", "can", "pl_are_able_to"),
    ("is capable of", "can", "pl_is_capable_of"),
    ("are capable of", "can", "pl_are_capable_of"),
    ("has the potential to", "can", "pl_has_potential_to"),
    ("have the potential to", "can", "pl_have_potential_to"),
    ("it is necessary that", "must", "pl_it_is_necessary"),
    ("it is crucial that", "must", "pl_it_is_crucial"),
    ("it is mandatory that", "must", "pl_it_is_mandatory"),
    ("each and every", "every", "pl_each_and_every"),
    ("first and foremost", "first", "pl_first_and_foremost"),
    ("one and only", "only", "pl_one_and_only"),
    ("basic fundamentals", "fundamentals", "pl_basic_fundamentals"),
    ("past history", "history", "pl_past_history"),
    ("future plans", "plans", "pl_future_plans"),
    ("end result", "result", "pl_end_result"),
    ("final outcome", "outcome", "pl_final_outcome"),
    ("unexpected surprise", "surprise", "pl_unexpected_surprise"),
    ("completely eliminate", "eliminate", "pl_completely_eliminate"),
    ("currently existing", "existing", "pl_currently_existing"),
    ("true facts", "facts", "pl_true_facts"),
    ("exact same", "same", "pl_exact_same"),
    ("gather together", "gather", "pl_gather_together"),
    ("consensus of opinion", "consensus", "pl_consensus_of_opinion"),
    ("advance notice", "notice", "pl_advance_notice"),
    ("advance reservations", "reservations", "pl_advance_reservations"),
    ("revert back", "revert", "pl_revert_back"),
    ("reply back", "reply", "pl_reply_back"),
    ("return back", "return", "pl_return_back"),
    ("refer back", "refer", "pl_refer_back"),
    ("collaborate together", "collaborate", "pl_collaborate_together"),
    ("join together", "join", "pl_join_together"),
    ("merge together", "merge", "pl_merge_together"),
    ("mix together", "mix", "pl_mix_together"),
    ("plan ahead", "plan", "pl_plan_ahead"),
    ("postpone until later", "postpone", "pl_postpone_until_later"),
    ("cancel out", "cancel", "pl_cancel_out"),
    ("parts per billion", "ppb", "rule_ppb"),
    ("less than or equal to", "≤", "rule_lte"),
    ("greater than or equal to", "≥", "rule_gte"),
    ("not equal to", "≠", "rule_neq"),
    ("does not equal", "≠", "rule_dneq"),
    ("zum beispiel", "z. B.", "de_zum_beispiel"),
    ("das heißt", "d. h.", "de_das_heisst"),
    ("unter umständen", "u. U.", "de_unter_umstaenden"),
    ("im vergleich zu", "ggü.", "de_im_vergleich_zu"),
    ("par exemple", "p. ex.", "fr_par_exemple"),
    ("c'est-à-dire", "c.-à-d.", "fr_cest_a_dire"),
    ("en ce qui concerne", "concernant", "fr_en_ce_qui_concerne"),
    ("por ejemplo", "p. ej.", "es_por_ejemplo"),
    ("con respecto a", "respecto a", "es_con_respecto_a"),
    ("en relación con", "sobre", "es_en_relacion_con"),
)
ABBREVIATIONS = {
    "database": "db",
    "databases": "dbs",
    "configuration": "cfg",
    "configurations": "cfgs",
    "infrastructure": "infra",
    "environment": "env",
    "environments": "envs",
    "repository": "repo",
    "repositories": "repos",
    "parameter": "param",
    "parameters": "params",
    "argument": "arg",
    "arguments": "args",
    "function": "fn",
    "functions": "fns",
    "directory": "dir",
    "directories": "dirs",
    "maximum": "max",
    "minimum": "min",
    "initialize": "init",
    "initialized": "init",
    "initialization": "init",
    "assertion": "assert",
    "assertions": "asserts",
    "request": "req",
    "requests": "reqs",
    "performance": "perf",
    "authentication": "auth",
    "authorization": "authz",
    "transaction": "tx",
    "transactions": "txs",
    "kubernetes": "k8s",
    "application": "app",
    "applications": "apps",
    "asynchronous": "async",
    "synchronous": "sync",
    "vulnerability": "vuln",
    "vulnerabilities": "vulns",
    "administrator": "admin",
    "administrators": "admins",
    "credential": "cred",
    "credentials": "creds",
    "specification": "spec",
    "specifications": "specs",
    "certificate": "cert",
    "certificates": "certs",
    "management": "mgmt",
    "destination": "dest",
    "destinations": "dests",
    "identifier": "id",
    "identifiers": "ids",
    "dependency": "dep",
    "dependencies": "deps",
    "software": "sw",
    "hardware": "hw",
    "network": "net",
    "packet": "pkt",
    "packets": "pkts",
    "message": "msg",
    "messages": "msgs",
    "library": "lib",
    "libraries": "libs",
    "binary": "bin",
    "binaries": "bins",
    "executable": "exe",
    "executables": "exes",
    "variable": "var",
    "variables": "vars",
    "document": "doc",
    "documents": "docs",
    "documentation": "docs",
    "implementation": "impl",
    "implementations": "impls",
    "beziehungsweise": "bzw.",
    "circa": "ca.",
    "und so weiter": "usw.",
    "aproximadamente": "aprox.",
    "madame": "Mme",
    "monsieur": "M.",
}
UNIT_ABBREVIATIONS = {
    "millisecond": "ms",
    "milliseconds": "ms",
    "microsecond": "µs",
    "microseconds": "µs",
    "nanosecond": "ns",
    "nanoseconds": "ns",
    "second": "s",
    "seconds": "s",
    "minute": "min",
    "minutes": "min",
    "hour": "h",
    "hours": "h",
    "week": "wk",
    "weeks": "wk",
    "month": "mo",
    "months": "mo",
    "year": "yr",
    "years": "yr",
    "kilobyte": "kB",
    "kilobytes": "kB",
    "megabyte": "MB",
    "megabytes": "MB",
    "gigabyte": "GB",
    "gigabytes": "GB",
    "terabyte": "TB",
    "terabytes": "TB",
}
HEADER_LIKE = r"^[ \t]*[A-Za-z][A-Za-z-]*:\s"
TOKENIZER_NAMES = ("cl100k_base", "o200k_base", "p50k_base", "r50k_base", "gpt-4", "gpt-4o", "gpt-3.5-turbo")
