"""What an expression's own parse tree tells: literals it can't match without, and whether a match stays on its line."""

from __future__ import annotations

import re
from functools import cache

try:
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_parse as _parser

#: Most alternatives of a literal that are worth a look at the text.
MOST = 16


def _tree(pattern: str):
    return _parser.parse(pattern, re.ASCII)


def _better(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    """The alternatives whose shortest one is longer; of equal ones, the fewer."""
    known = [x for x in (a, b) if x and min(map(len, x)) and len(x) <= MOST]
    return max(known, key=lambda x: (min(map(len, x)), -len(x)), default=None)


def _needed(items) -> tuple[str, ...] | None:
    best, run = None, ""
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        inner = None
        if name == "SUBPATTERN":
            inner = _needed(arg[-1])
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            inner = tuple(sorted({w for x in each for w in x})) if all(each) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _needed(arg[2])
        elif name == "ATOMIC_GROUP":
            inner = _needed(arg)
        best, run = _better(_better(best, (run,)), inner), ""
    return _better(best, (run,))


@cache
def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case literals one of which is in the lower-case text of every match; none if the expression doesn't tell."""
    return _needed(_tree(pattern)) or ()


def _crosses(items, dot: bool) -> bool:
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            crosses = arg == 10
        elif name == "NOT_LITERAL":
            crosses = arg != 10
        elif name == "ANY":
            crosses = dot
        elif name == "IN":
            (first, *_), negated = arg, str(arg[0][0]) == "NEGATE"
            has = any(
                (str(k) == "LITERAL" and v == 10) or (str(k) == "RANGE" and v[0] <= 10 <= v[1]) or (str(k) == "CATEGORY" and str(v) in ("CATEGORY_SPACE", "CATEGORY_NOT_DIGIT", "CATEGORY_NOT_WORD")) for k, v in arg if str(k) != "NEGATE"
            )
            crosses = has != negated
        elif name == "SUBPATTERN":
            crosses = _crosses(arg[-1], dot or bool(arg[1] & re.S))
        elif name == "BRANCH":
            crosses = any(_crosses(x, dot) for x in arg[1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            crosses = _crosses(arg[2], dot)
        elif name == "ATOMIC_GROUP":
            crosses = _crosses(arg, dot)
        elif name in ("ASSERT", "ASSERT_NOT"):
            crosses = _crosses(arg[1], dot)
        else:
            crosses = name != "AT" or str(arg) not in ("AT_BOUNDARY", "AT_NON_BOUNDARY")
        if crosses:
            return True
    return False


@cache
def stays_on_line(pattern: str) -> bool:
    """No match, and nothing it looks at, holds a line feed."""
    tree = _tree(pattern)
    return not _crosses(tree, bool(tree.state.flags & re.S))
