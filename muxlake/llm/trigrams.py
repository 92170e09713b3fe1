"""Boolean trigram queries of regular expressions.

A query is a list of clauses that must all hold; a clause is a list of alternatives of which one must hold;
an alternative is a set of trigrams that a matching text must all contain, in lower case.
"""

from __future__ import annotations

import re
from re import _constants as code
from re import _parser as parser

#: More strings than this, and a run of literals ends there.
MAX_STRINGS = 12


def _exact(items) -> set[str] | None:
    """All strings that a part of an expression can match, or None where they are too many."""
    out = {""}
    for op, arg in items:
        if op is code.LITERAL:
            part = {chr(arg).lower()}
        elif op is code.SUBPATTERN:
            part = _exact(arg[3])
        elif op is code.BRANCH:
            each = [_exact(x) for x in arg[1]]
            part = None if None in each else set().union(*each)
        elif op is code.MAX_REPEAT and arg[1] is not code.MAXREPEAT and arg[1] <= 1:
            inner = _exact(arg[2])
            part = None if inner is None else inner | ({""} if arg[0] == 0 else set())
        elif op is code.IN and all(o is code.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        else:
            part = None
        if part is None or len(out) * len(part) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The clauses of an expression; none where it has no mandatory trigram, so that all texts must be read."""
    clauses: list[list[frozenset[str]]] = []
    run: list = []

    def close() -> None:
        strings = _exact(run) if run else None
        run.clear()
        if strings and min(map(len, strings)) >= 3:
            grams = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
            clauses.append(sorted((g for g in grams if not any(x < g for x in grams)), key=sorted))

    for item in parser.parse(pattern, re.ASCII):
        if _exact([*run, item]) is None:
            close()
        if _exact([item]) is not None:
            run.append(item)
    close()
    return clauses
