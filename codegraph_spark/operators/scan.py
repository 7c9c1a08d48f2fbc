"""Code-risk scans: rules as data, findings as rows. Texts are reduced to findings before anything is shuffled."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.findings import normalize_severity
from ..functions.text import BEGIN, END, bind, dart_blank_strings_comments, js_strip_comments, lines_of_matches, marked, py_blank_comments, py_blank_strings_comments, snippet
from ..functions.patterns import literals, stays_on_line
from .relations import dedupe_first


class Rule(NamedTuple):
    """over: what is passed over where the pattern fails at its own beginning; nothing within can begin a match, so a loop over
    anything is not entered again at each beginning in the same stretch. until: characters that every match ends with, in this
    order; the text behind their last occurrence can't hold a match and is left out."""

    id: str
    severity: str
    pattern: str
    over: str = ""
    until: str = ""


def _upto(stop: str) -> str:
    """Rest of a regex literal on its line before one of the characters, pairs of a backslash and another passed over."""
    one = rf"[^/\\\n{stop}]*+"
    return rf"{one}(?:\\[^\n]{one})*+"


_Q = r"""["\']"""
#: Ids, severities and what they look for. JS rules see texts without comments. Where an expression isn't written
#: as it is known elsewhere, a comment gives the engine's reason; groups never capture, since the scan adds groups of its own.
JS_RULES = (
    Rule("eval.call", "high", r"\beval\s*\("),
    Rule("function.constructor", "high", r"new\s+Function\s*\("),
    Rule("timeout.string", "high", rf"set(?:Timeout|Interval)\s*\(\s*{_Q}"),
    Rule("vm.module", "high", r"\bvm\.[A-Za-z_][\w]*\s*\("),
    Rule("child_process.exec", "high", rf"(?:\brequire\s*\(\s*{_Q}child_process{_Q}\s*\)|\bchild_process)\s*\.\s*(?:exec|execSync|spawn|spawnSync)\s*\("),
    Rule("child_process.shell", "high", r"shell\s*:\s*true"),
    Rule("child_process.spawnShell", "high", r"(?:\bchild_process\s*\.\s*)?(?:spawn|execFile)(?:Sync)?\s*\([^;{}]*\{[^}]*shell\s*:\s*true", over=r"(?:spawn|execFile)(?:Sync)?\s*\([^;{}]*+(?:\{[^}]*+)?"),
    Rule("dynamic.require", "high", r"require\s*\(\s*[^\'\"\s][^\)]*\)", until=")"),
    Rule("dynamic.import", "high", r"import\s*\(\s*[^\'\"\s][^\)]*\)", until=")"),
    Rule("import.template", "high", r"from\s*`"),
    Rule("node.builtin", "med", rf"\b(?:require|import)\s*\(\s*{_Q}(?:fs|net|tls|http|https|dgram|cluster|os)\b"),
    Rule("process.env", "med", r"process\.env"),
    Rule("fs.access", "med", rf"(?:\brequire\s*\(\s*{_Q}fs{_Q}\s*\)|\bfs)\s*\.\s*(?:readFile|readFileSync|writeFile|writeFileSync|readdir|readdirSync|createWriteStream|createReadStream)\s*\("),
    Rule("http.cleartext", "med", r"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\[?::1\]?)"),
    Rule("dom.innerHTML", "high", r"\.\s*innerHTML\s*="),
    Rule("dom.outerHTML", "high", r"\.\s*outerHTML\s*="),
    Rule("document.write", "high", r"document\.write\s*\("),
    Rule("dom.insertAdjacentHTML", "high", r"insertAdjacentHTML\s*\("),
    Rule("dom.javascriptHref", "high", rf"(?i)\.href\s*=\s*{_Q}javascript:"),
    Rule("dom.javascriptLocation", "high", rf"(?i)\blocation(?:\.href)?\s*=\s*{_Q}javascript:"),
    Rule("dom.range", "high", r"createContextualFragment\s*\("),
    Rule("react.dangerousHTML", "high", r"dangerouslySetInnerHTML\s*:"),
    Rule("iframe.srcdoc", "high", r"\bsrcdoc\s*="),
    Rule("template.interpolation", "low", r"`[^`]*\$\{[^}]+\}[^`]*`", until="}`"),
    Rule("postmessage.wildcard", "med", rf"postMessage\s*\([^,]+,\s*{_Q}\*{_Q}\)", over=r"postMessage\s*\([^,]*+"),
    Rule("secret.literal", "high", rf"(?:API[_-]?KEY|SECRET|TOKEN|PASSWORD|PRIVATE[_-]?KEY)\s*[:=]\s*{_Q}[A-Za-z0-9_\-\.=+/]{{12,}}{_Q}"),
    Rule("math.random", "low", r"Math\.random\s*\("),
    Rule("storage.token", "med", r"(?i)(?:localStorage|sessionStorage|indexedDB)[^\n;]{0,200}(?:setItem|put|add|=)[^\n;]{0,200}(?:token|auth|jwt|session)"),
    Rule("crypto.weakHash", "med", rf"crypto\.createHash\(\s*{_Q}(?:md5|sha1){_Q}"),
    Rule("crypto.createCipher", "med", r"crypto\.create(?:Cipher|Decipher)\s*\("),
    # no loop over white space before one that takes it too: its ways to share it out would all be tried
    Rule("jwt.verify", "med", rf"(?:\brequire\s*\(\s*{_Q}jsonwebtoken{_Q}\s*\)|\bjwt|\bjsonwebtoken)\s*\.\s*verify\s*\([^,]+,[^,]+?\)", over=r"(?:\bjwt|\bjsonwebtoken)\s*\.\s*verify\s*\([^,]*+"),
    Rule("cors.wildcard", "med", rf"Access-Control-Allow-Origin{_Q}?\s*[:=]\s*{_Q}\*{_Q}"),
    Rule("cors.middleware", "med", r"app\.use\s*\(\s*cors\s*\(\s*\)"),
    Rule("cookie.literal", "low", rf"(?:document\.cookie\s*=\s*{_Q}[^\"']*{_Q}|cookie\s*:\s*{_Q}[^\"']*{_Q})"),
    Rule("console.secret", "low", r"(?i)console\.(?:log|dir)\s*\([^)]*(?:password|secret|token|api[_-]?key|auth|credential|ssn|social|credit|card|email)[^)]*\)", over=r"(?i)console\.(?:log|dir)\s*\([^)]*+", until=")"),
    Rule("import.meta.env", "low", r"import\.meta\.env\.[A-Za-z_][\w]*"),
    Rule("ssrf.metadataHost", "high", r"(?:https?:\/\/)?(?:169\.254\.169\.254|10\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[0-1])\.(?:[0-9]{1,3})\.(?:[0-9]{1,3})|192\.168\.(?:[0-9]{1,3})\.(?:[0-9]{1,3}))"),
    Rule("injection.mongoOperator", "high", r"\$(?:where|regex)\s*:"),
    Rule("regex.dynamic", "med", rf"(?:new\s+)?RegExp\s*\(\s*+(?![\"'`/])"),
    # a literal ends with its line, so nothing here crosses one; possessive throughout, groups without + first: one way to match
    Rule("regex.catastrophic", "high", r"/" + _upto("(") + r"(?:\([^)+/\n]*+\)" + _upto("(") + r")*+\([^)+/\n]*+\+[^)/\n]*+\)" + _upto("+") + r"\+" + _upto("") + "/"),
    Rule("cors.credentialsWildcard", "high", r"(?is)Access-Control-Allow-Origin[^\n;]*\*.{0,200}?Access-Control-Allow-Credentials[^\n;]*true", over=r"(?i)Access-Control-Allow-Origin[^\n;]*+"),
    Rule("tls.disabledEnv", "high", r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*0"),
    Rule("tls.agentInsecure", "high", r"https?\.Agent\s*\(\s*\{[^}]*rejectUnauthorized\s*:\s*false", over=r"https?\.Agent\s*\(\s*\{[^}]*+"),
    Rule("template.tripleStache", "med", r"\{\{\{[^}]+\}\}\}", over=r"\{\{\{[^}]*+"),
    Rule("template.escapeDisabled", "med", r"(?i)escape\s*:\s*false"),
    Rule("prototype.proto", "high", r"(?:__proto__|constructor\.prototype)\s*="),
    Rule("crypto.aesEcb", "high", r"(?i)AES[_-]?ECB|aes-(?:128|192|256)-ecb"),
)
_S = r"(?![rRuUbBfF]?[\"'])"
#: Texts with strings and comments blanked, but for PY_QUOTED, which see their quotes.
PY_RULES = (
    Rule("py.eval.call", "high", r"\beval\s*\("),
    Rule("py.exec.call", "high", r"\bexec\s*\("),
    Rule("py.os.system", "high", r"\bos\.system\s*\("),
    Rule("py.subprocess.shell", "high", r"(?i)\bsubprocess\.(?:Popen|run|call|check_output)\s*\([^)]*shell\s*=\s*True", over=r"(?i)\bsubprocess\.(?:Popen|run|call|check_output)\s*\([^)]*+"),
    Rule("py.pickle.load", "high", r"\bpickle\.(?:load|loads)\s*\("),
    Rule("py.yaml.unsafe_load", "high", r"\byaml\.load\s*\("),
    Rule("py.jsonpickle.decode", "high", r"\bjsonpickle\.(?:decode|Unpickler)\s*\("),
    Rule("py.marshal.loads", "high", r"\bmarshal\.(?:load|loads)\s*\("),
    Rule("py.requests.verify_false", "med", r"(?i)\brequests\.\w+\s*\([^)]*verify\s*=\s*False", over=r"(?i)\brequests\.\w+\s*\([^)]*+"),
    Rule("py.ssl.unverified_context", "med", r"\bssl\._create_unverified_context\s*\("),
    Rule("py.regex.dynamic", "med", r"\bre\.compile\s*\(\s*[A-Za-z_]\w*"),
    Rule("py.crypto.weak_hash", "med", r"\bhashlib\.(?:md5|sha1)\s*\("),
    Rule("py.random.for_tokens", "med", r"\brandom\.(?:random|randrange|randint|choice)\s*\("),
    Rule("py.jwt.decode.unsafe", "med", r"\bjwt\.decode\s*\("),
    Rule("py.zip.extraction", "high", r"\b(?:zipfile|tarfile)\.[A-Za-z_]\w*extractall\s*\("),
    Rule("py.tempfile.insecure", "med", r"\btempfile\.mktemp\s*\("),
    Rule("py.fs.world_perms", "med", r"\bos\.(?:chmod\s*\([^,]+,\s*0o?777\b|umask\s*\(\s*0\s*\))", over=r"\bos\.chmod\s*\([^,]*+"),
    # no loop over white space before one that takes it too
    Rule("py.sql.concat", "high", r"(?i)\b(?:execute|executemany)\s*\([^)]*(?:[+{])", over=r"(?i)\b(?:execute|executemany)\s*\([^)]*+"),
    Rule("py.cookie.insecure", "med", r"\.set_cookie\s*\("),
    Rule("py.importlib.dynamic", "med", r"\bimportlib\.import_module\s*[(]"),
)
PY_QUOTED = (
    Rule("py.subprocess.cmd_str", "med", r"\bsubprocess\.(?:Popen|run|call|check_output)\s*\(\s*(?:[rRuUbBfF]*[\"\'])"),
    Rule("py.ssrf.dynamic_url", "high", rf"\brequests\.(?:get|post|put|delete|patch|head|options)\s*\(\s*+{_S}"),
    Rule("py.open_redirect", "high", rf"\bredirect\s*\(\s*+{_S}"),
)
PY_RAW = (
    Rule("py.django.debug_true", "low", r"(?m)^\s*DEBUG\s*=\s*True\b", over=r"(?m)^\s++"),
    Rule("py.django.allowed_hosts_any", "med", rf"(?m)^\s*ALLOWED_HOSTS\s*=\s*\[\s*{_Q}\*{_Q}\s*\]", over=r"(?m)^\s++"),
    Rule("py.cors.wildcard", "med", rf"Access-Control-Allow-Origin{_Q}?\s*[:=]\s*{_Q}\*{_Q}"),
    Rule("py.cors.credentialsWildcard", "high", rf"(?i)Access-Control-Allow-Credentials{_Q}?\s*[:=]\s*{_Q}true{_Q}"),
    Rule("py.urllib3.disable_warnings", "low", r"\burllib3\.disable_warnings\s*\("),
    Rule("py.secret.literal", "high", rf"(?:API[_-]?KEY|SECRET[_-]?KEY|SECRET|TOKEN|PASSWORD|PRIVATE[_-]?KEY)\s*[:=]\s*{_Q}[A-Za-z0-9_\-\.=+/]{{12,}}{_Q}"),
    Rule("py.env.access", "low", rf"\bos\.environ\[\s*{_Q}[A-Za-z_]\w*{_Q}\s*\]"),
    Rule("py.logging.secrets", "low", r"(?i)\b(?:print|logging\.\w+)\s*\([^)]*(?:password|secret|token|api[_-]?key|auth|credential)[^)]*\)", over=r"(?i)\b(?:print|logging\.\w+)\s*\([^)]*+", until=")"),
    Rule("py.fs.dotdot", "high", r"(?:\.\./|\.\.\\)"),
    Rule("py.jwt.none_alg", "high", r"(?i)algorithms\s*=\s*\[[^\]]*\bnone\b[^\]]*\]", over=r"(?i)algorithms\s*=\s*\[[^\]]*+", until="]"),
    Rule("py.http.cleartext", "med", r"http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)"),
)
SECRET_RULES = (
    Rule("dart.secret.aws-access-key", "high", r"AKIA[0-9A-Z]{16}"),
    Rule("dart.secret.slack-token", "high", r"xox[baprs]-[0-9A-Za-z-]{10,48}"),
    Rule("dart.secret.jwt", "high", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", over=r"eyJ[A-Za-z0-9_-]*+"),
    Rule("dart.secret.private-key", "high", r"-----BEGIN (?:RSA|DSA|EC|OPENSSH|PGP) PRIVATE KEY-----"),
    Rule("dart.http.http-url", "medium", r"http://[^\s'\"]+"),
)
DART_RULES = (
    Rule("dart.process.run.shell", "high", r"\bProcess\.(?:run|start)(?:Sync)?\s*\([^;]*runInShell\s*:\s*true", over=r"\bProcess\.(?:run|start)(?:Sync)?\s*\([^;]*+"),
    Rule("dart.process.run", "medium", r"\bProcess\.(?:run|start)(?:Sync)?\s*\((?![^;]*runInShell\s*:\s*true)"),
    Rule("dart.random.insecure", "medium", r"\bRandom\s*\("),
    Rule("dart.http.badcert", "high", r"\bbadCertificateCallback\s*="),
    Rule("dart.platform.env", "info", r"\bPlatform\.environment\b"),
    Rule("dart.mirrors.use", "low", r"\bdart:mirrors\b"),
)
_INPUT = r"(?i)\b(?:req|request|ctx|context|event|body|params|query|user|input|data|form|payload|options|config|argv|env|headers|url|href|path|file|filename|dir|search|hash)\b"
_PATH_INPUT = r"(?i)\b(?:req|request|body|params|query|user|input|data|file|filename|filepath|dir|directory|path|paths|entry|archive)\b"


def _findings(src: DataFrame, found: Column) -> DataFrame:
    """Explode an array of finding structs; text stays behind."""
    rows = src.select("repo", "path", F.explode(found).alias("f")).select("repo", "path", "f.*")
    return rows.withColumn("severityNormalized", normalize_severity(F.col("severity")))


def rule_findings(text: Column, lines: Column, rules) -> Column:
    """array of (id, severity, line, code): the lines on which matches of the rules begin; lines is the array of the original's.

    A rule runs only on texts that hold one of the literals it can't match without; a rule whose matches stay on their line only
    on lines that do. All look at one lower-case copy of the text.
    """

    def finding(r: Rule, line: Column) -> Column:
        return F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), line.alias("line"), snippet(lines, line).alias("code"))

    none = F.array().cast("array<struct<id:string,severity:string,line:int,code:string>>")

    def holds(low: Column, words: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [low.contains(w) for w in words]) if words else F.lit(True)

    def each(r: Rule, low: Column, own: Column) -> Column:
        words = literals(r.pattern)
        if stays_on_line(r.pattern):
            numbered = F.filter(F.transform(own, lambda x, i: F.when(holds(F.lower(x), words) & x.rlike(r.pattern), i + 1)), lambda i: i.isNotNull())
            found = F.transform(numbered, lambda i: finding(r, i))
        else:
            found = F.transform(lines_of_matches(text, r.pattern, r.over, r.until), lambda m: finding(r, m["line"]))
        return F.when(holds(low, words), found).otherwise(none)

    return bind(F.lower(text), lambda low: bind(F.split(text, "\n"), lambda own: F.flatten(F.array(*[each(r, low, own) for r in rules]))))


def _unique(findings: DataFrame) -> DataFrame:
    return dedupe_first(findings, ["repo", "path", "id", "line", "code"], ["severity"])


def scan_js_patterns(src: DataFrame, rules=JS_RULES) -> DataFrame:
    plain = src.select("repo", "path", js_strip_comments(F.col("content")).alias("content"))
    plain = plain.withColumn("lines", F.split("content", "\n"))
    return _unique(_findings(plain, rule_findings(F.col("content"), F.col("lines"), rules)))


def js_line_checks(raw: Column) -> list[tuple[str, str, Column]]:
    """(id, severity, condition) on one line."""
    t = F.trim(raw)
    has = lambda p: t.rlike(p)
    user, path = has(_INPUT), has(_PATH_INPUT)
    lower = F.lower(raw)
    return [
        ("ssrf.dynamicFetch", "high", has(r"\bfetch\s*\(") & user),
        ("ssrf.dynamicAxios", "high", has(r"\baxios(?:\.[A-Za-z_]\w*)?\s*\(") & user),
        ("ssrf.dynamicRequest", "high", has(r"\bhttps?\.request\s*\(") & user),
        ("injection.sqlTemplate", "high", has(r"\.query\s*\(\s*`[^`]*\$\{")),
        ("injection.sqlConcat", "high", has(r"""\.query\s*\([^)]*["'`][^)]*\+\s*[A-Za-z_]""") & user),
        ("prototype.mergeUserInput", "high", has(r"\b_\.merge\s*\(") & user),
        ("prototype.assignUserInput", "high", has(r"\bObject\.assign\s*\(") & t.contains("{") & user),
        ("path.join.userInput", "high", has(r"\bpath\.join\s*\(") & (t.contains("..") | path)),
        ("zipSlip.entryPath", "high", (has(r"\.extract\s*\(") | has(r"entry\.path")) & t.contains("..")),
        ("child_process.userArgs", "high", has(r"(?:child_process\s*\.\s*)?(?:spawn|execFile)(?:Sync)?\s*\(") & user & (t.contains("+") | t.contains("${"))),
        ("storage.token.assignment", "med", has(r"(?i)\b(?:localStorage|sessionStorage|indexedDB)\b") & has("(?i)token|auth|jwt|session") & t.contains("=")),
        ("fs.dotdot", "med", raw.contains("fs.") & raw.contains("..")),
        ("cookie.sameSiteNoneInsecure", "high", raw.rlike(r"(?i)samesite\s*=\s*none") & ~raw.rlike(r"(?i)\bsecure\b")),
        ("cookie.session.noHttpOnly", "med", (raw.contains("document.cookie") | raw.contains("Set-Cookie") | raw.contains("cookie:")) & lower.rlike(r"\b(?:sid|session|connect\.sid)\s*=") & ~lower.contains("httponly")),
        ("open_redirect.clientLocation", "high", has(r"(?i)(?:window\.)?location(?:\.href)?\s*=") & user),
        ("open_redirect.serverRedirect", "high", t.contains("res.redirect") & user),
        ("upload.trustsClientMime", "med", has(r"(?i)req\.file\.(?:mimetype|originalname)")),
        ("upload.publicWrite", "high", (t.contains("fs.writeFile") | t.contains("fs.createWriteStream")) & path & has(r"(?i)[/\\](?:public|uploads)")),
    ]


def js_lines(src: DataFrame) -> DataFrame:
    """(repo, path, line, raw): lines of comment-stripped texts."""
    plain = src.select("repo", "path", F.posexplode(F.split(js_strip_comments(F.col("content")), "\n")).alias("i", "raw"))
    return plain.select("repo", "path", (F.col("i") + 1).alias("line"), "raw")


#: Every check asks for one of these words, so other lines are dropped by one look.
_TRIGGER = r"(?i)fetch|axios|request|query|merge|assign|path\.join|extract|entry|spawn|execfile|storage|indexeddb|fs\.|samesite|cookie|location|redirect|req\.file"


def scan_js_lines(src: DataFrame) -> DataFrame:
    rows = js_lines(src).where(F.col("raw").rlike(_TRIGGER))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.col("line").alias("line"), F.trim("raw").alias("code"))) for i, s, c in js_line_checks(F.col("raw"))]))
    return _unique(_findings(rows, found))


def xhr_without_csrf(lines: DataFrame) -> DataFrame:
    """Stateful XMLHttpRequest calls of variables that send credentials and never a CSRF marker, as findings."""
    t, name = F.trim("raw"), r"([A-Za-z_]\w*)"
    get = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    marker = lambda c: c.rlike("(?i)csrf|xsrf")
    rows = lines.select("repo", "path", "line", t.alias("code"), get(name + r"\.withCredentials\s*=\s*true").alias("cred"), F.when(marker(t), get(name + r"\.setRequestHeader\s*\(")).alias("head"), F.when(marker(F.regexp_extract(t, r"\.send\s*\(([^)]*)\)", 1)), get(name + r"\.send\s*\(")).alias("sent"), get("(?i)" + name + r"""\.open\s*\(\s*["'](?:POST|PUT|PATCH|DELETE)["']""").alias("var"))
    opened = rows.where("var is not null").select("repo", "path", "var", "line", "code")
    cred = rows.where("cred is not null").select("repo", "path", F.col("cred").alias("var")).distinct()
    safe = rows.select("repo", "path", F.explode(F.array("head", "sent")).alias("var")).where("var is not null").distinct()
    out = opened.join(cred, ["repo", "path", "var"], "left_semi").join(safe, ["repo", "path", "var"], "left_anti")
    return out.select("repo", "path", F.lit("csrf.credentialsMissingToken").alias("id"), F.lit("high").alias("severity"), "line", "code", F.lit("high").alias("severityNormalized"))


def scan_python(src: DataFrame) -> DataFrame:
    text = src.select("repo", "path", "content", py_blank_strings_comments("content").alias("blanked"), py_blank_comments("content").alias("quoted"), F.split("content", "\n").alias("lines"))
    lines = F.col("lines")
    found = F.concat(rule_findings(F.col("blanked"), lines, PY_RULES), rule_findings(F.col("quoted"), lines, PY_QUOTED), rule_findings(F.col("content"), lines, PY_RAW))
    return _unique(_findings(text, found))


def scan_secrets(src: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """With column (from one) and the match cut at 200 characters; each match once. The rules' matches end with their line.

    A matched line is cut before each match; a running sum of the parts' lengths gives the columns, so a line takes as long as
    it is, however many matches it holds.
    """
    lines = src.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("i", "raw"))
    parts = []
    for r in rules:
        held = lines.where(reduce(Column.__or__, [F.lower("raw").contains(w) for w in literals(r.pattern)])) if literals(r.pattern) else lines
        cut = held.withColumn("m", marked(F.col("raw"), r.pattern, r.over)).where(F.col("m").contains(BEGIN))
        each = cut.select("repo", "path", (F.col("i") + 1).alias("line"), F.posexplode(F.split("m", BEGIN)).alias("n", "part"))
        match = F.substring_index("part", END, 1)
        code = F.when(F.length(match) > 200, F.concat(F.substring(match, 1, 200), F.lit("..."))).otherwise(match)
        width = F.length("part") - F.when(F.col("n") > 0, 1).otherwise(0)  # without the mark behind the match
        parts.append(each.select("repo", "path", F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"), "line", "n", width.alias("width"), F.when(F.col("n") > 0, code).alias("code")))
    before = Window.partitionBy("repo", "path", "id", "line").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    found = reduce(DataFrame.union, parts).withColumn("col", (F.sum("width").over(before) + 1).cast("int")).where("n > 0")
    return found.select("repo", "path", "id", "severity", "line", "col", "code", normalize_severity(F.col("severity")).alias("severityNormalized"))


def scan_dart_api(src: DataFrame) -> DataFrame:
    text = src.select("repo", "path", "content", dart_blank_strings_comments("content").alias("blanked"), F.split("content", "\n").alias("lines"))
    inside = [r for r in DART_RULES if r.id != "dart.mirrors.use"]
    mirrors = [r for r in DART_RULES if r.id == "dart.mirrors.use"]  # named in a directive's string
    return _unique(_findings(text, F.concat(rule_findings(F.col("blanked"), F.col("lines"), inside), rule_findings(F.col("content"), F.col("lines"), mirrors))))


def merge_findings(direct: DataFrame, referenced: DataFrame) -> DataFrame:
    """Direct findings first, then referenced ones, each key once."""
    both = direct.withColumn("__cg_o", F.lit(0)).unionByName(referenced.withColumn("__cg_o", F.lit(1)), allowMissingColumns=True)
    return dedupe_first(both, ["repo", "path", "severityNormalized", "id", "line", "code"], ["__cg_o"]).drop("__cg_o")
