"""Queries over texts and paths. Source files are derived from documents: each whole text with lines of code behind it, dealt by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import findings as FF
from ..functions import paths as P
from ..functions import text as T
from ..operators import calls as C
from ..operators import documents as D
from ..operators import relations as R
from ..operators import scan as S
from .graphs import frame

QUERIES, ORACLES = {}, {}

#: Lines of code that the derived sources end with; which one a document gets follows from its id.
JS_LINES = ("eval(code); // eval(x)", "fetch(req.url);", "const a = require(name);", "el.innerHTML = data;", "const u = 'http://example.com/x';", "path.join(base, req.query.f);", "res.redirect(req.query.to);", "x.open(''POST'', u); x.withCredentials = true;".replace("''", "'"), "Math.random();", "crypto.createHash('md5');")
PY_LINES = ("eval(code)", "s = 'eval(1)'  # eval(2)", "os.system(cmd)", "requests.get(url)", "DEBUG = True", "yaml.load(f)", "hashlib.md5(x)", "random.choice(xs)", "pickle.loads(b)", "subprocess.run('ls', shell=True)")


def _sources(spark, d, lines, ext):
    docs = frame(spark, d, "SELECT doc_id, text, source FROM documents")
    line = F.get(F.array(*map(F.lit, lines)), F.pmod("doc_id", F.lit(len(lines))).cast("int"))
    return docs.select(F.col("source").alias("repo"), F.concat(F.lit("src/f"), "doc_id", F.lit(ext)).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("content"))


def query(oracle=None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_SEEN = r"SELECT event_id, user_id, event_type, CAST(floor(value) AS INTEGER) AS loc, CASE event_id % 3 WHEN 0 THEN 'c:/u//' || CAST(user_id AS STRING) WHEN 1 THEN 'C:/u/' || CAST(user_id AS STRING) ELSE ' C:/u/' || CAST(user_id AS STRING) || ' ' END AS raw FROM events"


@query(f"SELECT event_id, 'C:/u/' || CAST(user_id AS STRING) AS path FROM ({_SEEN})")
def canonical_path(spark, d):
    return frame(spark, d, _SEEN).select("event_id", P.canonical_path(F.col("raw")).alias("path"))


@query("SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+([.][^.]*)$', 1) AS ext FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    return frame(spark, d, "SELECT page_id, url FROM pages").select("page_id", P.dirname(u).alias("dir"), P.basename(u).alias("base"), P.ext(u).alias("ext"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(replace(replace(x, chr(9), ''), chr(13), '')) <> '')) AS INTEGER) AS loc, sha256(text) AS sha FROM documents")
def loc_and_sha(spark, d):
    t = F.col("text")
    return frame(spark, d, "SELECT doc_id, text FROM documents").select("doc_id", T.loc(t).alias("loc"), T.content_sha256(t).alias("sha"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'used' WHEN 'click' THEN 'side_effect_only' ELSE 'unused' END"


@query(f"""SELECT 'r' || CAST(user_id % 4 AS VARCHAR) AS repo, 'C:/u/' || CAST(user_id AS VARCHAR) AS id, CASE WHEN bool_or(event_type = 'purchase') THEN 'used' WHEN bool_or(event_type = 'click') THEN 'side_effect_only' ELSE arg_min({_STATE}, event_id) END AS state,
    max(CAST(floor(value) AS INTEGER)) AS sizeLOC, arg_min(event_type, event_id) AS type FROM events GROUP BY user_id""")
def merge_nodes(spark, d):
    """Nodes of many fragments by canonical id: used beats side_effect_only beats the first state; the largest size; the first type."""
    e = frame(spark, d, f"SELECT 'r' || CAST(user_id % 4 AS STRING) AS repo, raw, event_id AS seq, {_STATE} AS state, loc AS sizeLOC, event_type AS type FROM ({_SEEN})")
    return D.merge_nodes(e.withColumn("id", P.canonical_path(F.col("raw"))).drop("raw"))


_LINE = "CAST(len(string_split(coalesce(text, ''), chr(10))) + 1 AS INTEGER)"


def _expected(ext: str, found, columns: str = "", n: int = 10) -> str:
    """SQL of the findings of derived sources: found has (number of the line, id, severity, normalized severity, code)."""
    rows = ", ".join("({}, '{}', '{}', '{}', '{}')".format(k, *(x.replace("'", "''") for x in rest)) for k, *rest in found)
    return f"""SELECT source AS repo, 'src/f' || CAST(doc_id AS STRING) || '{ext}' AS path, v.id, v.severity, {_LINE} AS line, {columns}v.code, v.norm AS "severityNormalized"
        FROM documents JOIN (VALUES {rows}) v(k, id, severity, norm, code) ON doc_id % {n} = v.k"""


_PATTERNS = (
    (0, "eval.call", "high", "high", "eval(code);"), (2, "dynamic.require", "high", "high", JS_LINES[2]), (3, "dom.innerHTML", "high", "high", JS_LINES[3]),
    (4, "http.cleartext", "med", "med", JS_LINES[4]), (8, "math.random", "low", "low", JS_LINES[8]), (9, "crypto.weakHash", "med", "med", JS_LINES[9]),
)
_BY_LINE = ((1, "ssrf.dynamicFetch", "high", "high", JS_LINES[1]), (5, "path.join.userInput", "high", "high", JS_LINES[5]), (6, "open_redirect.serverRedirect", "high", "high", JS_LINES[6]))
_PYTHON = (
    (0, "py.eval.call", "high", "high", PY_LINES[0]), (2, "py.os.system", "high", "high", PY_LINES[2]), (3, "py.ssrf.dynamic_url", "high", "high", PY_LINES[3]), (4, "py.django.debug_true", "low", "low", PY_LINES[4]),
    (5, "py.yaml.unsafe_load", "high", "high", PY_LINES[5]), (6, "py.crypto.weak_hash", "med", "med", PY_LINES[6]), (7, "py.random.for_tokens", "med", "med", PY_LINES[7]), (8, "py.pickle.load", "high", "high", PY_LINES[8]),
    (9, "py.subprocess.cmd_str", "med", "med", PY_LINES[9]), (9, "py.subprocess.shell", "high", "high", PY_LINES[9]),
)
CALL_LINES = (
    "jwt.verify(t, k);", "jwt.verify(t, k, { algorithms: ['none'], audience: 'a', issuer: 'i', maxAge: 1, nbf: 1 });", "res.cookie('sid', v, { sameSite: 'none' });", "res.set({ 'Strict-Transport-Security': a });",
    "fetch(u, { method: 'POST', credentials: 'include' });", "yaml.load(s);", "new Parser({ resolveEntities: true });", "crypto.createCipheriv('aes', k, 'iv');", "axios.put(u, d, { withCredentials: true });", "f(g(x), [1, 2]);",
)
_CALLS = (
    (0, "jwt.verify.missingOptions", "high", "high", CALL_LINES[0]), (1, "jwt.verify.algorithms.none", "high", "high", CALL_LINES[1]), (2, "cookie.sameSiteNoneInsecure", "high", "high", CALL_LINES[2]),
    (2, "cookie.session.noHttpOnly", "med", "med", CALL_LINES[2]), (3, "headers.securityBaseline", "med", "med", CALL_LINES[3][:-1]), (4, "csrf.credentialsMissingToken", "high", "high", CALL_LINES[4]),
    (5, "yaml.load.unsafe", "high", "high", CALL_LINES[5]), (6, "xml.externalEntities", "high", "high", CALL_LINES[6]), (7, "crypto.staticIv", "high", "high", CALL_LINES[7]), (8, "csrf.credentialsMissingToken", "high", "high", CALL_LINES[8]),
)


@query(_expected(".js", _PATTERNS))
def scan_js_patterns(spark, d):
    return S.scan_js_patterns(_sources(spark, d, JS_LINES, ".js"))


@query(_expected(".js", _BY_LINE))
def scan_js_lines(spark, d):
    return S.scan_js_lines(_sources(spark, d, JS_LINES, ".js"))


@query(_expected(".js", ((7, "csrf.credentialsMissingToken", "high", "high", JS_LINES[7]),)))
def scan_js_xhr(spark, d):
    return S.xhr_without_csrf(S.js_lines(_sources(spark, d, JS_LINES, ".js")))


@query(_expected(".js", _CALLS))
def scan_js_calls(spark, d):
    return C.scan_js_calls(_sources(spark, d, CALL_LINES, ".js"))


@query(_expected(".py", _PYTHON))
def scan_python(spark, d):
    return S.scan_python(_sources(spark, d, PY_LINES, ".py"))


@query(_expected(".js", ((4, "dart.http.http-url", "medium", "med", "http://example.com/x"),), "CAST(12 AS INTEGER) AS col, "))
def scan_secret_rules(spark, d):
    return S.scan_secrets(_sources(spark, d, JS_LINES, ".js"))


@query(f"""WITH f AS ({_expected(".js", _PATTERNS)}), n AS (SELECT repo, "severityNormalized" AS s, count(*) AS n FROM f GROUP BY ALL)
    SELECT f.repo, count(*) AS total_findings, count(DISTINCT path) AS affected_nodes, any_value(by_severity) AS by_severity FROM f
    JOIN (SELECT repo, string_agg(s || '=' || CAST(n AS VARCHAR), ',' ORDER BY s) AS by_severity FROM n GROUP BY repo) b ON b.repo = f.repo GROUP BY f.repo""")
def security_summary(spark, d):
    found = R.security_summary(S.scan_js_patterns(_sources(spark, d, JS_LINES, ".js")))
    return found.withColumn("by_severity", F.array_join(F.transform(F.map_entries("by_severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(f"""SELECT repo, path, id, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM ({_expected(".js", _BY_LINE)}) GROUP BY ALL""")
def findings_by_rule(spark, d):
    return R.findings_by_rule(S.scan_js_lines(_sources(spark, d, JS_LINES, ".js"))).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'click' THEN 'high' ELSE lower(event_type) END AS severity FROM events")
def normalize_severity(spark, d):
    e = frame(spark, d, "SELECT event_id, CASE event_type WHEN 'purchase' THEN ' Crit' WHEN 'click' THEN 'SEVERE' ELSE event_type END AS s FROM events")
    return e.select("event_id", FF.normalize_severity(F.col("s")).alias("severity"))
