"""Phrase mining against counting by hand, with ties, nulls, hot rows and every cut of blocks and subranges."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import phrases

DOCS = "doc_id long, text string, lang string"


def by_hand(rows, least=30, top=2000, share=80):
    words, counts = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[k : k + n])) for n in range(1, 5) for k in range(len(w) - n + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    longer = Counter()
    for (lang, p), n in frequent.items():
        for m in range(2, len(p)):
            for k in range(len(p) - m + 1):
                longer[lang, p[k : k + m]] = max(longer[lang, p[k : k + m]], n)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and 100 * longer[lang, p] < share * a:
            score, _, l, r = min((2000000 * a // (frequent[lang, p[:k]] + frequent[lang, p[k:]]), k, frequent[lang, p[:k]], frequent[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, words[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def as_set(found):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()}


def some_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("a a a b b é ß of Of THE the ab ab\x01".split(" "))
    rows = [(k, "".join(word() + rng.choice((" ", " ", " ", "\t", ", ", "  ", ".", "\n", "\r\n", "\x0b")) for _ in range(rng.randrange(60))), rng.choice(("en", "fr", None, "und"))) for k in range(250)]
    rows += [(None, "one two three four five, one two", "en")] * 40  # rows without id, all alike
    rows += [(7, None, "en"), (7, "", None), (8, "   \t ", "de"), (9, ",.;", "de"), (10, "of the " * 3000, "en"), (11, "long" * 50_000, "en")]
    return rows


@pytest.mark.parametrize("seed, tokens, piece, keys", [(1, 1 << 20, 1 << 20, 1 << 15), (2, 50, 40, 64), (3, 7, 5, 8)])
def test_against_counting(spark, monkeypatch, seed, tokens, piece, keys):
    """As it is, then in small blocks cut inside texts and many subranges, so that every run straddles some end."""
    for name, value in (("BLOCK_TOKENS", tokens), ("SLICE", piece), ("SUBRANGE_KEYS", keys)):
        monkeypatch.setattr(phrases, name, value)
    rows = some_rows(seed)
    rows = rows if tokens > 1000 else [r for r in rows if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    docs = docs.select("*", *[F.lit("clash").alias(c) for c in ("block", "n", "words", "tokens", "rank", "f", "a")])
    want = by_hand(rows)
    assert len(want) > 9 and as_set(phrases.collocations(docs)) == want
    assert as_set(phrases.collocations(docs.orderBy(F.desc("text")), top=3)) == by_hand(rows, top=3)


def test_nothing_frequent_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], DOCS)
    assert phrases.collocations(docs).collect() == [] and phrases.collocations(docs.limit(0)).collect() == []
    assert as_set(phrases.collocations(docs, least=1)) == by_hand([(1, "a b c", "en")], least=1)


def test_slices_keep_words_whole(monkeypatch):
    text = "Abc\tde, f.g\r\nhi " * 9 + "x" * 50 + " end"
    whole = [w for part in phrases.slices(text) for w in part]
    for size in (1, 2, 7, 30):
        monkeypatch.setattr(phrases, "SLICE", size)
        assert [w for part in phrases.slices(text) for w in part] == whole
    assert whole[:9] == [b"abc", b"de", b",", b"f", b",", b"g", b",", b",", b"hi"]


def test_radix_sort_and_counts():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 4, (500, 4)).astype(np.uint32) * np.array([1, 70_000, 2**30, 1], np.uint32)
    got, counts = phrases.sorted_counts(ids)
    want = Counter(map(tuple, ids.tolist()))
    assert [tuple(r) for r in got.tolist()] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]
    again, sums = phrases.sorted_counts(got[::-1], counts[::-1])
    assert (again == got).all() and (sums == counts).all()
    keys = phrases.as_bytes(got)
    assert (np.argsort(keys, kind="stable") == np.arange(len(keys))).all()


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^14 give products past 64 bits; the phrase table is put in place of counting."""
    words = spark.createDataFrame([("en", "a", 3 * 10**14, 1), ("en", "b", 10**14 + 7, 2)], "lang string, word string, f long, id long")
    found = spark.createDataFrame([(1 << 32 | 2, 0, 10**14 + 1)], "high long, low long, a long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda docs, least: (found, words, spark.createDataFrame([("en", 5 * 10**14)], "lang string, n long")))
    (r,) = phrases.collocations(None).collect()
    assert (r.phrase, r.score) == ("a b", 2000000 * (10**14 + 1) // (3 * 10**14 + 10**14 + 7))


def test_bounds_are_chosen_on_the_executors(spark):
    """Of 20,000 sampled keys only the bounds come to the driver, and they are those of the sorted sample."""
    keys = sorted(b"%016d" % (k * 7919 % 10_000) for k in range(20_000))
    sample = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").repartition(5)
    want = sorted({keys[k * len(keys) // 300] for k in range(1, 300)})
    assert phrases.range_bounds(sample, 300).tolist() == want
    assert phrases.range_bounds(sample.limit(0), 300).tolist() == []
    assert phrases.range_bounds(sample, 1).tolist() == []
