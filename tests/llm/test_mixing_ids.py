"""Mixed documents where doc_ids are null or repeat, within a source and across sources."""

from collections import Counter

from factweave.llm import mixing

DOCS = "doc_id long, source string, text string, n_chars long"


def mixed(spark, given, **how):
    rows = [(i, s, t, None if t is None else len(t)) for i, s, t in given]
    return Counter((r.doc_id, r.source, r.text) for r in mixing.mixed_documents(spark.createDataFrame(rows, DOCS), **how).collect())


def test_whole_documents_once(spark):
    """Targets equal to the sizes take each document whole and once, whatever its id; sizes and texts order differently."""
    given = [(None, "a", "z"), (None, "a", "b b b"), (None, "b", "a a a a a"), (None, "b", "y y"), (1, "a", "x"), (1, "b", "c c c c"), (1, "b", "c c c c"), (2, None, "w w"), (None, "a", "")]
    for order in (given, given[::-1]):
        assert mixed(spark, order, share=1.0, passes=1) == Counter(g for g in given if g[2])


def test_words_of_each_source(spark):
    """What comes out of a source has as many words as the plan takes of it, with null ids only."""
    sizes = {"a": (("z", 1), ("m", 4), ("k", 9), ("a", 16)), "b": (("c", 30), ("y", 5), ("d", 7))}
    given = [(None, s, " ".join([c] * n)) for s in sizes for c, n in sizes[s]]
    docs = spark.createDataFrame([(i, s, t, len(t)) for i, s, t in given], DOCS)
    want, got = Counter(), Counter()
    for r in mixing.mix(docs, share=0.5, passes=1).collect():
        want[r.source] += r.taken
    for (_, source, text), n in mixed(spark, given, share=0.5, passes=1).items():
        got[source] += n * len(text.split())
    assert got == want


def test_repeated_id_across_sources(spark):
    """One id in two sources: each source's cut is made in its own text."""
    given = [(1, "a", "z " * 20 + "z"), (1, "b", "a " * 9 + "a")]
    got = Counter()
    for (_, source, text), n in mixed(spark, given, share=0.5, passes=1).items():
        got[source] += n * len(text.split())
    want = {r.source: r.taken for r in mixing.mix(spark.createDataFrame([(*g, 0) for g in given], DOCS), share=0.5, passes=1).collect()}
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_many_equal_rows(spark):
    given = [(None, "a", "x y")] * 500 + [(None, "a", "y x")] * 3
    assert mixed(spark, given, share=1.0, passes=1) == Counter(given)
