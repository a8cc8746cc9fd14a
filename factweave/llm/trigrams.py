"""Boolean trigram queries derived from regular expressions.

For every part of a parsed pattern three things are kept: the set of strings it can match, if that set is small (`exact`);
else sets of which one member begins (`first`) and one ends (`last`) every match; and a query that every text with a match fulfils.
Concatenation multiplies the sets and asks for the trigrams that cross the seam, alternation unites them, and whatever may be
absent or is too wide asks for nothing. All letters are in lower case, as the index holds lower-cased texts.

A query is an OR of clauses, each an AND of trigrams: a frozenset of frozensets. The query with one empty clause is true of every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

Query = frozenset
ANYTHING: Query = frozenset([frozenset()])
#: Strings in a set, clauses of a query, and characters kept of a beginning or an end, at most; wider classes match anything.
STRINGS, CLAUSES, KEPT, CLASS = 64, 64, 8, 16


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    first: frozenset[str] = frozenset([""])
    last: frozenset[str] = frozenset([""])
    query: Query = ANYTHING

    def begins(self) -> frozenset[str]:
        return self.first if self.exact is None else self.exact

    def ends(self) -> frozenset[str]:
        return self.last if self.exact is None else self.exact

    def asked(self) -> Query:
        return self.query if self.exact is None else trigrams_of(self.exact)


UNKNOWN, EMPTY = Part(None), Part(frozenset([""]))


def least(clauses) -> Query:
    """Without clauses that another one implies."""
    found = set(clauses)
    return frozenset(c for c in found if not any(d < c for d in found))


def both(a: Query, b: Query) -> Query:
    """AND; where that has too many clauses, the query of fewer (still one that every match fulfils)."""
    out = least(x | y for x, y in product(a, b))
    return out if len(out) <= CLAUSES else min(a, b, key=len)


def either(a: Query, b: Query) -> Query:
    out = least(a | b)
    return out if len(out) <= CLAUSES else ANYTHING


def trigrams_of(strings: frozenset[str]) -> Query:
    """One of the strings occurs."""
    out = least(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)
    return out if len(out) <= CLAUSES else ANYTHING


def _bounded(strings, end: bool) -> frozenset[str]:
    """The set with strings cut to what is kept, shorter and shorter until it is small."""
    for kept in range(KEPT, -1, -1):
        out = frozenset((s[max(0, len(s) - kept) :] if end else s[:kept]) for s in strings)
        if len(out) <= STRINGS:
            return out
    raise AssertionError("the empty string alone is a small set")


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Part(frozenset(x + y for x, y in product(a.exact, b.exact)))
    seam = frozenset(x[-2:] + y[:2] for x, y in product(a.ends(), b.begins()))
    query = both(both(a.asked(), b.asked()), trigrams_of(seam))
    first = a.first if a.exact is None else _bounded({x + y for x, y in product(a.exact, b.begins())}, False)
    last = b.last if b.exact is None else _bounded({x + y for x, y in product(a.ends(), b.exact)}, True)
    return Part(None, first, last, query)


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Part(a.exact | b.exact)
    return Part(None, _bounded(a.begins() | b.begins(), False), _bounded(a.ends() | b.ends(), True), either(a.asked(), b.asked()))


def _characters(items) -> frozenset[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 256:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:  # negations, categories, wide ranges
            return None
    return frozenset(found) if len(found) <= CLASS else None


def _repeated(body: Part, low: int, high: int) -> Part:
    if low == 0:
        return _or(EMPTY, body) if high == 1 else UNKNOWN
    out = body
    for _ in range(min(low, 3) - 1):
        out = _then(out, body)
    if low == high and low <= 3:
        return out
    return Part(None, _bounded(out.begins(), False), _bounded(out.ends(), True), out.asked())


def _part(tree) -> Part:
    out = EMPTY
    for op, value in tree:
        if op is sre.LITERAL:
            one = Part(frozenset([chr(value).lower()]))
        elif op is sre.IN:
            letters = _characters(value)
            one = UNKNOWN if letters is None else Part(letters)
        elif op is sre.SUBPATTERN:
            one = _part(value[-1])
        elif op is sre.BRANCH:
            arms = [_part(arm) for arm in value[1]]
            one = arms[0]
            for arm in arms[1:]:
                one = _or(one, arm)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            one = _repeated(_part(value[2]), value[0], value[1])
        elif op is sre.ATOMIC_GROUP:
            one = _part(value)
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            one = EMPTY
        else:  # any character, categories, references
            one = UNKNOWN
        out = _then(out, one)
    return out


def query_of(pattern: str) -> Query:
    """The trigram query of a regular expression (what is common to Java's and Python's syntax).

    Every text with a match, lower-cased, holds all trigrams of some clause. A pattern without mandatory trigrams gives ANYTHING.
    """
    return _part(parser.parse(pattern)).asked()
