"""Severity names, finding keys, edge flags and rules about nodes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of severities.
SEVERITY_ALIASES = {
    "crit": "critical", "critical": "critical",
    "severe": "high", "high": "high",
    "warn": "med", "warning": "med", "medium": "med", "med": "med", "moderate": "med", "medium-high": "med", "medium_low": "med",
    "low": "low",
    "info": "info", "informational": "info", "note": "info",
    "unknown": "unknown",
}
_PREFIXES = (("crit", "critical"), ("hi", "high"), ("med", "med"), ("mod", "med"), ("low", "low"), ("info", "info"))
EDGE_MASKS = {"all": 1, "no_deferred": 2, "no_dynamic": 4, "runtime": 8, "no_build": 16, "no_test": 32}


def normalize_severity(severity: Column) -> Column:
    s = F.lower(F.trim(severity))
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_ALIASES.items() for x in kv]), s)
    for prefix, name in _PREFIXES:
        out = F.coalesce(out, F.when(s.startswith(prefix), F.lit(name)))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(out, s))


def finding_key(severity: Column, id: Column, line: Column, message: Column, code: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("|", text(severity), text(id), text(line), text(message), text(code))


def normalize_finding(id: Column, message: Column, severity: Column, line: Column, code: Column) -> Column:
    """A finding struct; null where it has neither message nor id. The line has to be a finite number."""
    n = F.expr("try_cast(null as double)") if line is None else line.cast("string").try_cast("double")
    ok = F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(2**31)), n.cast("int"))
    body = F.struct(id.cast("string").alias("id"), message.cast("string").alias("message"), severity.cast("string").alias("severity"), normalize_severity(severity).alias("severityNormalized"), ok.alias("line"), code.cast("string").alias("code"))
    return F.when(F.coalesce(id.cast("string"), message.cast("string"), F.lit("")) != "", body)


def edge_flags(kind: Column, phase: Column, deferred: Column, dynamic: Column) -> dict[str, Column]:
    """is_deferred, is_dynamic and edge_phase (test, build or runtime) of an edge."""
    k, p = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(phase, kind, F.lit("")))
    named = F.when(p.contains("test") | p.contains("spec"), F.lit("test")).when(p.contains("build") | p.contains("codegen") | p.contains("tool"), F.lit("build")).otherwise(F.lit("runtime"))
    return {
        "is_deferred": F.coalesce(deferred, F.lit(False)) | k.contains("defer") | k.contains("lazy"),
        "is_dynamic": F.coalesce(dynamic, F.lit(False)) | k.contains("dynamic") | k.contains("require.ensure") | k.contains("eval"),
        "edge_phase": named,
    }


def edge_mask(is_deferred: Column, is_dynamic: Column, phase: Column) -> Column:
    """Six bits: the closures in which an edge may be walked."""
    bit = lambda c, name: F.when(c, F.lit(EDGE_MASKS[name])).otherwise(F.lit(0))
    return bit(F.lit(True), "all") + bit(~is_deferred, "no_deferred") + bit(~is_dynamic, "no_dynamic") + bit(phase == "runtime", "runtime") + bit(phase != "build", "no_build") + bit(phase != "test", "no_test")


def edge_active(profiles: Column, profile: Column, when: Column, flags: Column, name: Column, gates: Column) -> Column:
    """Is an edge active in a profile: the first that is given of profiles, profile, when and flags decides; else active.

    flags and gates are map<string, string>: each flag asks for the gate of its name, true and false by truth.
    """
    truth = lambda x: F.coalesce(x, F.lit("")).isin("", "false", "0", "null")
    gate = lambda k: F.try_element_at(gates, k)
    one = lambda kv: F.when(F.lower(kv["value"]) == "true", ~truth(gate(kv["key"]))).when(F.lower(kv["value"]) == "false", truth(gate(kv["key"]))).otherwise(gate(kv["key"]) == kv["value"])
    return (
        F.when(profiles.isNotNull(), (F.size(profiles) == 0) | F.array_contains(profiles, name))
        .when(profile.isNotNull(), profile == name)
        .when(when.isNotNull(), F.array_contains(F.transform(F.split(when, ","), F.trim), name))
        .when(flags.isNotNull(), F.forall(F.map_entries(flags), lambda kv: F.coalesce(one(kv), F.lit(False))))
        .otherwise(F.lit(True))
    )


def has_dynamic_evidence(dynamic: Column, coverage_hits: Column, runtime_hits: Column, coverage: Column, events: Column, tags: Column) -> Column:
    """Any sign that a node is loaded at run time; coverage array<double>, events and tags array<string>."""
    some = lambda c: F.coalesce(c, F.lit(False))
    return (
        some(dynamic) | some(coverage_hits > 0) | some(runtime_hits > 0) | some(F.exists(coverage, lambda x: x > 0))
        | some(F.exists(events, lambda x: F.lower(x).contains("load"))) | some(F.exists(tags, lambda x: F.lower(x).contains("dynamic")))
    )


def keep_rule_regexes(rules) -> list[str]:
    """Keep rules (text, {regex, flags} or {pattern, glob}) as expressions; rules that don't compile are dropped."""
    out = []
    for rule in rules or ():
        if isinstance(rule, str):
            p = rule
        elif isinstance(rule, dict) and rule.get("regex"):
            p = ("(?i)" if "i" in str(rule.get("flags", "")) else "") + str(rule["regex"])
        elif isinstance(rule, dict) and rule.get("pattern"):
            p = "^" + ".*".join(map(re.escape, str(rule["pattern"]).split("*"))) + "$" if rule.get("glob") else str(rule["pattern"])
        else:
            continue
        try:
            re.compile(p)
            out.append(p)
        except re.error:
            pass
    return out


def kept(id: Column, rules) -> Column:
    out = F.lit(False)
    for p in keep_rule_regexes(rules):
        out = out | id.rlike(p)
    return out
