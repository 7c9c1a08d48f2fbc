"""Checks of JS calls by their arguments: tokens, cookies, headers, requests with credentials, YAML, XML and initial vectors.

Balanced brackets are beyond regular expressions, so one small Arrow helper cuts calls out of a text; what a call's arguments
mean is said in column expressions. An option counts as given where its first key that occurs has a value that is not falsy.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import js_strip_comments
from .scan import Rule, _findings, _unique, rule_findings

#: The calls that are looked at, and how they begin.
CALLS = (
    ("jwt", r"(?i)(?:jwt|jsonwebtoken)\s*\.\s*verify\s*\("),
    ("cookie", r"(?i)\bres\.cookie\s*\("),
    ("header", r"(?i)res\.(?:set|header|append)\s*\("),
    ("head", r"res\.writeHead\s*\("),
    ("fetch", r"\bfetch\s*\("),
    ("axios.post", r"axios\.(?i:post|put|patch|delete)\s*\("),
    ("axios", r"\baxios\s*\("),
    ("yaml", r"(?:yaml|jsyaml)\.load\s*\("),
    ("cipher", r"crypto\.(?:createCipheriv|createDecipheriv)\s*\("),
    ("subtle", r"crypto\.subtle\.(?:encrypt|decrypt)\s*\("),
)
#: A header set that has one of these should have the baseline too.
SECURITY_HEADERS = (
    "strict-transport-security", "x-content-type-options", "permissions-policy", "cross-origin-opener-policy",
    "cross-origin-embedder-policy", "cross-origin-resource-policy", "access-control-allow-origin", "x-dns-prefetch-control",
)
XML_RULES = (Rule("xml.externalEntities", "high", r"(?i)(?:externalEntities|resolveEntities|expandEntities|processEntities)\s*:\s*true"),)

_STARTS = [(kind, re.compile(p)) for kind, p in CALLS]
_TOKEN = re.compile(r"""\\.|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`|["'`()\[\]{},]""", re.S)


def call_arguments(text: str, opened: int) -> tuple[list[str], int] | None:
    """Trimmed top-level arguments of the call whose bracket opens at `opened`, and its end; None where it never closes."""
    depth, start, args = {"(": 0, "[": 0, "{": 0}, opened + 1, []
    for m in _TOKEN.finditer(text, opened):
        t = m[0]
        if t in depth:
            depth[t] += 1
        elif t in (")", "]", "}"):
            kind = {")": "(", "]": "[", "}": "{"}[t]
            depth[kind] = max(0, depth[kind] - 1)
            if kind == "(" and not depth["("]:
                args.append(text[start : m.start()].strip())
                return [a for a in args if a], m.end()
        elif t == "," and depth == {"(": 1, "[": 0, "{": 0}:
            args.append(text[start : m.start()].strip())
            start = m.end()
        elif t in ('"', "'", "`"):
            return None
    return None


def _calls(text: str | None) -> list[dict]:
    out = []
    for kind, start in _STARTS if text else ():
        at, line = 0, 1
        for m in start.finditer(text):
            if found := call_arguments(text, m.end() - 1):
                line, at = line + text.count("\n", at, m.start()), m.start()
                out.append({"kind": kind, "line": line, "head": text[m.start() : found[1]].split("\n", 1)[0].strip(), "args": found[0]})
    return out


@F.pandas_udf(ArrayType(StructType().add("kind", "string").add("line", "integer").add("head", "string").add("args", ArrayType(StringType()))))
def js_calls(texts: pd.Series) -> pd.Series:
    return texts.map(_calls)


def _option(options: Column, key: str) -> tuple[Column, Column]:
    """Does the key occur, and its value."""
    pattern = rf"(?i){key}\s*:\s*([^,}}\]]+)"
    return options.rlike(pattern), F.trim(F.regexp_extract(options, pattern, 1))


def option_truthy(options: Column, *keys: str) -> Column:
    out = F.lit(False)
    for key in reversed(keys):
        there, value = _option(options, key)
        out = F.when(there, ~value.isin("", "false", "0", "null", "undefined", "NaN", "''", '""')).otherwise(out)
    return out


def _explicitly_true(options: Column, key: str) -> Column:
    there, value = _option(options, key)
    return there & F.lower(value).isin("true", "1")


def _options_argument(args: Column) -> Column:
    """The first argument from the third on that looks like options and is no function."""
    like = lambda a: ~(a.startswith("function") | a.contains("=>")) & (a.startswith("{") | a.contains("algorithms") | a.contains("sameSite") | a.contains("httpOnly"))
    return F.get(F.filter(F.slice(args, 3, F.greatest(F.size(args), F.lit(1))), like), F.lit(0))


def _literal(arg: Column) -> Column:
    return F.nullif(F.regexp_extract(arg, r"(?s)^(?:\"(.*)\"|'(.*)'|`(.*)`)$", 0), F.lit("")).substr(F.lit(2), F.length(arg) - 2)


def _csrf(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("x-csrf|x-xsrf|csrf-token|xsrf-token|csrftoken"), F.lit(False))


def _static_iv(arg: Column) -> Column:
    fixed = arg.rlike(r"^(?:0x)?0+$") | arg.rlike(r"(?i)Buffer\.(?:from|alloc)\s*\(\s*['\"]") | arg.rlike(r"(?i)new\s+Uint8Array\s*\([^)]*\)")
    return arg.rlike("^['\"`]") | fixed | (arg.rlike(r"\[[^\]]+\]") & ~arg.contains("Math.random"))


def _jwt(args: Column) -> list[tuple[str, str, Column]]:
    o = F.coalesce(_options_argument(args), F.lit(""))
    given = ~o.isin("", "{}") & ~F.lower(o).isin("null", "undefined")
    listed = o.rlike(r"(?i)algorithms\s*:")
    expires = (o.rlike(r"(?i)ignoreExpiration\s*:\s*false") | option_truthy(o, "maxAge", "expiresIn")) & ~_explicitly_true(o, "ignoreExpiration")
    begins = (o.rlike(r"(?i)ignoreNotBefore\s*:\s*false") | option_truthy(o, "nbf", "notBefore")) & ~_explicitly_true(o, "ignoreNotBefore")
    return [
        ("jwt.verify.missingOptions", "high", ~given),
        ("jwt.verify.algorithms.missing", "high", given & ~listed),
        ("jwt.verify.algorithms.none", "high", given & o.rlike(r"(?i)algorithms\s*:\s*\[[^\]]*none")),
        ("jwt.verify.missingAud", "med", given & ~option_truthy(o, "audience", "aud")),
        ("jwt.verify.missingIss", "med", given & ~option_truthy(o, "issuer", "iss")),
        ("jwt.verify.missingExp", "med", given & ~expires),
        ("jwt.verify.missingNbf", "med", given & ~begins),
    ]


def _cookie(args: Column) -> list[tuple[str, str, Column]]:
    o = _options_argument(args)
    session = F.coalesce(_literal(F.get(args, F.lit(0))).rlike(r"(?i)^(?:sid|session|connect\.sid)$"), F.lit(False))
    insecure = o.rlike(r"(?i)sameSite\s*:\s*['\"]?none") & (~option_truthy(o, "secure") | o.rlike(r"(?i)secure\s*:\s*false"))
    hidden = F.coalesce(option_truthy(o, "httpOnly") & ~o.rlike(r"(?i)httpOnly\s*:\s*false"), F.lit(False))
    return [("cookie.sameSiteNoneInsecure", "high", o.isNotNull() & insecure), ("cookie.session.noHttpOnly", "med", session & ~hidden)]


def header_names(args: Column, kind: Column) -> Column:
    """Lower-case names of the headers that a call sets; null where it sets none that can be read."""
    first = F.get(args, F.lit(0))
    block = F.when(kind == "head", F.get(F.filter(F.slice(args, 2, F.greatest(F.size(args), F.lit(1))), lambda a: a.startswith("{")), F.lit(0))).when(first.startswith("{"), first)
    names = lambda p: F.regexp_extract_all(F.lower(block), F.lit(p), F.lit(1))
    listed = F.array_union(names(r"['\"]([^'\"]+)['\"]\s*:"), names(r"([a-z0-9_-]+)\s*:"))
    single = F.when((kind == "header") & (F.size(args) >= 2), F.array(F.lower(F.coalesce(_literal(first), first))))
    return F.when(block.isNotNull(), listed).otherwise(single)


def header_baseline(calls: DataFrame) -> DataFrame:
    """Rows of calls (kind, args, helmet, ...) whose header set has a security header but lacks one of the baseline, in a file
    without `helmet(`; plus `missing`, the baseline's headers that are not there."""
    names = header_names(F.col("args"), F.col("kind"))
    rows = calls.where(F.col("kind").isin("header", "head")).withColumn("__cg_names", names)
    has = lambda *n: F.arrays_overlap("__cg_names", F.array(*map(F.lit, n)))
    lacks = F.array_compact(F.array(*[F.when(~has(*n), F.lit(label)) for label, n in (
        ("Content-Security-Policy", ("content-security-policy",)), ("X-Frame-Options/frame-ancestors", ("x-frame-options", "frame-ancestors")), ("Referrer-Policy", ("referrer-policy",)),
    )]))
    return rows.where((F.size("__cg_names") > 0) & has(*SECURITY_HEADERS) & ~F.col("helmet")).withColumn("missing", lacks).where("size(missing) > 0").drop("__cg_names")


def _requests(kind: Column, args: Column) -> Column:
    """A state-changing request that sends credentials and no CSRF marker."""
    second, third = F.get(args, F.lit(1)), F.get(args, F.lit(2))
    changes = lambda o: o.rlike(r"(?i)method\s*:\s*['\"](?:POST|PUT|PATCH|DELETE)['\"]")
    fetch = second.rlike(r"(?i)credentials\s*:\s*['\"]include['\"]") & changes(second) & ~_csrf(second)
    config = F.coalesce(third, F.when(second.startswith("{"), second))
    post = config.rlike(r"(?i)withCredentials\s*:\s*true") & ~_csrf(config) & ~_csrf(second)
    first = F.get(args, F.lit(0))
    plain = first.rlike(r"(?i)(?:withCredentials|credentials)\s*:\s*(?:true|['\"]include['\"])") & changes(first) & ~_csrf(first)
    return F.when(kind == "fetch", fetch).when(kind == "axios.post", post).when(kind == "axios", plain)


def scan_js_calls(src: DataFrame) -> DataFrame:
    """Findings of calls in JS sources (repo, path, content), in the shape of the other scans. Null content has none."""
    text = src.select("repo", "path", js_strip_comments(F.col("content")).alias("content"))
    text = text.withColumns({"lines": F.split("content", "\n"), "helmet": F.lower("content").rlike(r"\bhelmet\s*\(")})
    calls = text.select("repo", "path", "lines", "helmet", F.explode(js_calls("content")).alias("c")).select("repo", "path", "helmet", "c.*", F.trim(F.get("lines", F.col("c.line") - 1)).alias("code"))
    kind, args = F.col("kind"), F.col("args")
    iv = F.when((kind == "cipher") & (F.size(args) >= 3), F.get(args, F.lit(2))).when(kind == "subtle", F.trim(F.nullif(F.regexp_extract(F.get(args, F.lit(0)), r"(?i)iv\s*:\s*([^,}]+)", 1), F.lit(""))))
    safe = F.coalesce(F.get(args, F.lit(1)).rlike(r"(?i)schema\s*:\s*(?:yaml\.)?(?:FAILSAFE_SCHEMA|DEFAULT_SAFE_SCHEMA)"), F.lit(False))
    checks = [
        *[(i, s, (kind == "jwt") & c) for i, s, c in _jwt(args)],
        *[(i, s, (kind == "cookie") & c) for i, s, c in _cookie(args)],
        ("csrf.credentialsMissingToken", "high", _requests(kind, args)),
        ("yaml.load.unsafe", "high", (kind == "yaml") & ~safe),
        ("crypto.staticIv", "high", _static_iv(iv)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.col("line"), F.col("code"))) for i, s, c in checks]))
    headers = header_baseline(calls).select("repo", "path", F.array(F.struct(F.lit("headers.securityBaseline").alias("id"), F.lit("med").alias("severity"), F.col("line"), F.col("head").alias("code"))).alias("found"))
    xml = text.select("repo", "path", rule_findings(F.col("content"), F.col("lines"), XML_RULES).alias("found"))
    rows = calls.select("repo", "path", found.alias("found")).unionByName(headers).unionByName(xml)
    return _unique(_findings(rows, F.col("found")))
