"""Every rule: found where it was found before texts were gated, and linear on hostile texts."""

import random
import re
import time

from pyspark.sql import functions as F

from codegraph_spark.functions import patterns, text
from codegraph_spark.operators import scan

ALL = (*scan.JS_RULES, *scan.PY_RULES, *scan.PY_QUOTED, *scan.PY_RAW, *scan.SECRET_RULES, *scan.DART_RULES)


def pieces_of(pattern):
    """Texts that an expression is about: its literals and the signs between them."""
    words = re.findall(r"[A-Za-z_$]{2,}", re.sub(r"\\[a-zA-Z]|\(\?[a-z]+\)", " ", pattern))
    return [*words, *"(){}[]`'\",;:=.*+ \n$/-", "${", "{{{", "}}}", " : ", "\n\n", "123", "md5", "127.0.0.1"]


def test_passing_over_loses_no_match():
    rng = random.Random(1)
    for rule in ALL:
        assert re.compile(rule.pattern).groups == 0, rule.id
        if not rule.over and not rule.until:
            continue
        flags = (re.match(r"\(\?[a-z]+\)", rule.pattern) or [""])[0]  # stand at the front of each alternative in Java
        plain = re.compile(rule.pattern, re.A)
        both = re.compile(f"{flags}({rule.pattern.removeprefix(flags)})" + (f"|({re.sub(r"^\(\?[a-z]+\)", "", rule.over)})" if rule.over else ""), re.A)
        bits, hits = pieces_of(rule.pattern + rule.over), 0
        heads = [w for w in patterns.literals(rule.pattern)] + re.findall(r"[A-Za-z_$.]{3,}", rule.pattern.replace("\\", ""))
        for _ in range(1500):
            t = "".join(rng.choice(heads if rng.random() < 0.3 else bits) for _ in range(rng.randint(1, 25)))
            kept = t
            for c in reversed(rule.until):
                kept = kept[: kept.rfind(c) + 1]
            kept += rule.until[1:]
            want = [t.count("\n", 0, m.start()) for m in plain.finditer(t)]
            assert [kept.count("\n", 0, m.start()) for m in both.finditer(kept) if m[1] is not None] == want, (rule.id, t)
            hits += len(want)
            if want:
                assert any(w in t.lower() for w in patterns.literals(rule.pattern)), (rule.id, t)


def test_literals_and_lines():
    assert patterns.literals(r"\bab(?:cde|fgh)+x") == ("cde", "fgh") and patterns.literals(r"[ab]*c?") == () and patterns.literals("(?i)ABC|D") == ("abc", "d")
    assert patterns.stays_on_line(r"a[^\n;]*b(?!c)") and not any(map(patterns.stays_on_line, (r"a\s*b", "[^)]", "(?s).", "a\nb", r"\D", "(?m)^a")))
    assert patterns.stays_on_line("a.b")
    for rule in ALL:
        assert patterns.literals(rule.pattern), rule.id


def test_upto_last(spark):
    rows = spark.createDataFrame([("a)b)c",), ("none",), ("",), (")",)], "t string")
    assert [r[0] for r in rows.select(text.upto_last(F.col("t"), ")")).collect()] == ["a)b)", "", "", ")"]
    rows = spark.createDataFrame([("`${a}` x",), ("`${a} `b` }",), ("} no",)], "t string")
    assert [r[0] for r in rows.select(text.upto_last(F.col("t"), "}`")).collect()] == ["`${a}`", "`${a}`", "`"]


def test_catastrophic_expressions(spark):
    yes = ["/^(a+)+$/", "x = /(ab+c)\\d+/;", "/(a)(b+)+/", "/\\((a+)+/", "/(?:x|(y+))z+/"]
    no = ["x = a / 2; y = (a + b) + c;", "/(a+)/", "/a+b+/", "a /(b\n+ c)+/", "/(ab)+/"]
    src = spark.createDataFrame([("r", f"{n}", t) for n, t in enumerate(yes + no)], "repo string, path string, content string")
    got = {int(r["path"]) for r in scan.scan_js_patterns(src, [r for r in scan.JS_RULES if r.id == "regex.catastrophic"]).collect()}
    assert got == set(range(len(yes)))


def hostile(rules, size):
    """Long texts that make loops run: ordinary signs over and over, and every rule's own beginning without its end."""
    fill = lambda x: (x * (size // len(x) + 1))[:size]
    out = [fill(x) for x in ("y = (a + b) + c;\n", "x = a / 2; (a + b) + c;", "\"'`", "/", "/*", "(", "(((+)))+/", "[{", "{{{", "${", "`${", "\n", " \t", "a,", "eyJ", ")};")]
    for r in rules:
        words = list(patterns.literals(r.pattern)) + re.findall(r"[A-Za-z_.]{4,}", re.sub(r"\\[bsdw]", " ", r.pattern.replace(r"\.", ".")))
        for w in dict.fromkeys(words):
            out += [fill(w + end) for end in ("(", "(a", "({ ", ": ['", "='a")]
    return out


def check_linear(spark, run, rules):
    """A text four times as long may take some eight times as long, never the sixteen of a square."""
    took = []
    for size in (10_000, 40_000, 160_000):
        texts = hostile(rules, size)
        src = spark.createDataFrame([("r", f"{n}", t) for n, t in enumerate(texts)], "repo string, path string, content string").repartition(8).cache()
        src.count()
        began = time.time()
        run(src).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
        src.unpersist()
    assert took[2] < 20 + 8 * took[1], took


def test_js_rules_are_linear(spark):
    check_linear(spark, scan.scan_js_patterns, scan.JS_RULES)


def test_python_rules_are_linear(spark):
    check_linear(spark, scan.scan_python, (*scan.PY_RULES, *scan.PY_QUOTED, *scan.PY_RAW))


def test_secret_rules_are_linear(spark):
    check_linear(spark, scan.scan_secrets, scan.SECRET_RULES)
