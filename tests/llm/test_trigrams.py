"""Trigram queries: no text with a match of a rule may lie outside the rule's candidates."""

import random
import re

import pytest

from factweave.llm import secrets
from factweave.llm.trigrams import ANYTHING, query_of


def fulfils(query, text):
    return any(all(t in text.lower() for t in clause) for clause in query)


def test_known_queries():
    query = lambda p: sorted(map(sorted, query_of(p)))
    assert query("abc?d") == [["abc", "bcd"], ["abd"]]
    assert query("(ab|cd)ef") == [["abe", "bef"], ["cde", "def"]]
    assert query("AKIA[A-Z0-9]+") == [["aki", "kia"]]
    assert query("foo.*bar") == [["bar", "foo"]]
    for p in ("[0-9a-f]+", "a.c", "(abc)?", "ab|abc", "[^x]yz", "", "(abc|)"):
        assert query_of(p) == ANYTHING


def random_pattern(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 3)
    if kind < 2:
        return "".join(rng.choice("abAB_") for _ in range(rng.randrange(1, 4)))
    if kind == 2:
        return rng.choice(["[ab]", "[a-c]", ".", "[^a]", r"\w", "a", "b"])
    inner = random_pattern(rng, depth + 1)
    if kind < 5:
        return inner + random_pattern(rng, depth + 1)
    if kind == 5:
        return f"(?:{inner}|{random_pattern(rng, depth + 1)})"
    if kind == 6:
        return f"({inner}){rng.choice(['?', '*', '+', '{2}', '{1,2}', '{3,}'])}"
    return f"(?i:{inner})"


@pytest.mark.parametrize("seed", range(6))
def test_no_match_lies_outside_its_candidates(seed):
    rng = random.Random(seed)
    met = asked = 0
    for _ in range(300):
        pattern = random_pattern(rng)
        query, rule = query_of(pattern), re.compile(pattern)
        for _ in range(60):
            text = "".join(rng.choice("abAB_c") for _ in range(rng.randrange(30)))
            if rule.search(text):
                met += 1
                asked += query != ANYTHING
                assert fulfils(query, text), (pattern, text, query)
    assert met > 1000 and asked > 100


def test_every_clause_has_an_anchor():
    clauses = [c for r in secrets.RULES for c in r.clauses()]
    first = secrets.anchors(clauses)
    for clause in clauses:
        assert any(t in first and set(clause) <= first[t] | {t} for t in clause)
    assert len(first) < len(clauses)


def test_long_texts_with_many_matches(spark):
    """More matches than are walked at once: positions and masks still agree with a plain scan."""
    words = [f"token={k:08d} é" if k % 3 else f"AKIA{k:020d}" for k in range(1500)]
    text = "x ".join(words) + " tail"
    docs = spark.createDataFrame([(1, text, len(text)), (2, "nothing", 7), (3, "", 0), (4, None, None)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    plain = sorted([("assign", *m.span()) for m in re.finditer(r"token=[A-Za-z0-9+/_.=-]+", text)] + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]{24,}", text)], key=lambda s: s[1])
    assert [(s.kind, s.start, s.finish) for s in found[1]] == plain and len(plain) == 1500
    want, at = "", 0
    for _, a, b in plain:
        want, at = want + text[at:a] + "[secret]", b
    masked = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    assert masked == {1: (want + text[at:], len(want + text[at:])), 2: ("nothing", 7), 3: ("", 0), 4: (None, None)}
