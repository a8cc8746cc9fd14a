"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from factweave.llm import bpe, embeddings, fingerprint, minhash, mixing, preferences, quality, secrets, separators, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = " ".join(f"word{k}" for k in range(30))
ROWS = [
    (1, "one two three four five six", "en", "a", 27),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, WORDS, "en", "b", len(WORDS)),
    (5, WORDS, "en", "b", len(WORDS)),
    (5, WORDS, "en", "b", len(WORDS)),
    (None, "lost its id token=abcdef1", "en", "a", 25),
    (6, "x" * 200_000, "en", "a", 200_000),
    (7, "  \n ", "en", "c", 4),
    (8, "é ñ ß " * 3000, "fr", None, 18_000),
]
CLASHES = ["score", "size", "kinds", "spans", "row", "bucket", "n", "bands", "range", "head", "target", "position", "_id", "class_id", "component"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, DOCS)
    return out.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def runs(spark):
    path = bpe.default_path()
    lexicon = toxicity.fit_lexicon(["you scum scum here", "bad scum there", "scum again now", "what scum is"] * 1, ["fine text here", "good words"])
    model = quality.fit_quality([], [])
    return {
        "quality": lambda d: quality.score_quality(d, model),
        "mixing": lambda d: mixing.curriculum(d).withColumn("pass_words", F.col("pass_words").cast("string")).withColumn("positions", F.col("positions").cast("string")),
        "secrets": lambda d: secrets.digest(secrets.find_secrets(d)),
        "fingerprint": fingerprint.fingerprints,
        "edits": lambda d: fingerprint.with_next(d, fingerprint.compare_edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"),
        "bpe": lambda d: bpe.digest_documents(d, path),
        "minhash": minhash.near_duplicates,
        "toxicity": lambda d: toxicity.score_toxicity(d, lexicon),
    }


@pytest.mark.parametrize("name", ["quality", "mixing", "secrets", "fingerprint", "edits", "bpe", "minhash", "toxicity"])
def test_rows_stay_and_order_does_not_matter(spark, docs, empty, name):
    run = runs(spark)[name]
    one = sorted(map(repr, run(docs).collect()))
    assert len(one) == len(ROWS)
    assert sorted(map(repr, run(docs.orderBy(F.col("doc_id").desc(), "text")).collect())) == one
    assert run(empty).collect() == []


def test_minhash_values(docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got[(1, 2)] == (1, True) and got[(2, 0)] == (2, True) and got[(7, 0)] == (7, True)
    assert got[(4, 26)] == (4, True) and got[(5, 26)] == (4, False)
    assert got[(None, 1)] == (None, True) and got[(6, 1)] == (6, True)


def test_secrets_of_a_row_without_id(docs):
    got = [r for r in secrets.digest(secrets.find_secrets(docs)).collect() if r.doc_id is None]
    assert [(r.n_assign, r.spans) for r in got] == [(1, "assign:12:25")]


def test_mix_targets_and_null_source(docs):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for target, size, taken in by.values():
        assert abs(taken - target) <= 0.5 and target <= 2 * size
    assert set(by) == {"a", "b", "c", None}


def test_toxicity_folds_and_excuses():
    model = toxicity.fit_lexicon([f"aa{k} scum bb{k}" for k in "abcdefghijkl"], [f"pond scum grows {k}" for k in "abcdef"] + [f"nice day {k}" for k in range(600)])
    assert model.excused and model.score("pond scum grows") < 0.3 < model.score("such sсum") and model.score("$cum you") > 0.3
    assert model.score("") < 0.3 and model.score(None) == model.score("")
    assert toxicity.fit_lexicon([], ["a"]).score("a") == 0.0
    assert toxicity.fold("1D10T!  Тhe ＷＯＲＤ") == " idiot the word "


def test_preferences(spark, empty):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", 2, "user", None),
            (2, "chosen", None, None, None), (2, "rejected", None, None, None), (3, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x")]
    turns = spark.createDataFrame(rows, "pair long, side string, turn long, role string, text string").withColumn("place", F.lit(9)).withColumn("shared", F.lit(9))
    got = {r.pair: r for r in preferences.format_pairs(turns).collect()}
    assert set(got) == {1, 2, 3} and [got[k].n_shared for k in (1, 2, 3)] == [1, 1, 0]
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    (span,) = got[1].chosen_mask
    assert got[1].chosen[span.start : span.finish] == "yes<|im_end|>\n"
    assert got[2].chosen == "" and got[3].rejected == "" and got[3].prompt == ""
    assert preferences.format_pairs(turns.limit(0)).collect() == []


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, []), (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.9, 0.435889])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", F.lit(1)).withColumn("good", F.lit(False))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(vectors).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11][1] == 1
    assert got[4] == (0, 4, True) and got[None] == (0, None, True)
    assert all(got[k] == (0, k, True) for k in (5, 6, 7, 8, 9, 10))
    assert embeddings.near_vectors(vectors.limit(0)).collect() == []


def test_token_files_of_no_rows_and_empty_texts(spark, docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = separators.scan(spark, separators.token_files(docs, path, public_tokenizers.PATTERN), block=1000)
    assert found.count() == len(ROWS) and found.where("n_tokens = 0").count() == 2
    assert separators.scan(spark, separators.token_files(empty, path, public_tokenizers.PATTERN)).count() == 0


def test_pairs_share_their_turns(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "one"), (0, 2, "user", "and"), (0, 3, "assistant", "two"), (1, 0, "user", "ho"), (1, 1, "assistant", "three"),
            (2, 0, "user", "alone"), (2, 1, "assistant", "four"), (4, 0, "user", "mute"), (5, 0, "assistant", None), (None, 0, "user", "x"), (7, 0, "assistant", "same"), (6, 0, "assistant", "same")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("couple", F.lit("clash"))
    got = {r.pair: r for r in preferences.format_pairs(preferences.paired(conversations), ("couple",)).collect()}
    assert {k: r.n_shared for k, r in got.items()} == {0: 3, 1: 1, 2: 1, 4: 1, 5: 0, 6: 1, 7: 1}
    assert got[0].chosen.startswith("<|im_start|>assistant\ntwo") and got[0].rejected.startswith("<|im_start|>assistant\nthree")
    assert got[2].chosen == "<|im_start|>assistant\nfour<|im_end|>\n" and got[2].rejected == ""
    assert got[5].chosen == "<|im_start|>assistant\n<|im_end|>\n" and got[5].rejected == ""
    assert got[6].chosen == got[6].rejected == ""
    assert preferences.paired(conversations.limit(0)).collect() == []
    whole = preferences.op4_preferences(spark, "/root/testdata/sf0.001")
    assert whole.where("n_shared > 0").count() > 0.5 * whole.count() and whole.where("rejected <> chosen").count() > 0.5 * whole.count()


def test_ranges_of_ids(spark):
    edges = sorted({k * k for k in range(1, 60)}, reverse=True)
    ids = spark.range(0, 3482).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("hash")).unionAll(spark.sql("select cast(null as long), 0L"))
    got = ids.select("doc_id", fingerprint._range_of([(e, None) for e in edges]).alias("r")).collect()
    assert all(r.r == (len(edges) - 1 if r.doc_id is None else sum(e >= r.doc_id for e in edges) - 1) for r in got)


@pytest.mark.parametrize("kind", ["ids", "repeats", "no ids", "one id", "equal rows"])
def test_next_document_of_ties(spark, kind):
    """Every row meets its next one, whoever shares its id, and no range holds most of the rows of a frequent id."""
    import hashlib
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randrange(30)))
    rows = {
        "ids": [(i, word()) for i in range(300)],
        "repeats": [(rng.choice((None, 7, 7, 7, i)), word()) for i in range(400)],
        "no ids": [(None, word()) for _ in range(100)],
        "one id": [(5, word()) for _ in range(100)] + [(9, "x")],
        "equal rows": [(5, "same")] * 100 + [(None, "same")] * 80 + [(1, "b")],
    }[kind]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    got = sorted(repr((r.doc_id, r.edited_sha256)) for r in fingerprint.with_next(docs, fingerprint.compare_edits, schema).collect())
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted((1 << 62 if i is None else -i, hashes[t], t, i) for i, t in rows)
    texts = [t for _, _, t, _ in order]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, texts[1:] + texts[:1])]
    assert got == sorted(repr((x[3], hashlib.sha256(e.encode()).hexdigest())) for x, e in zip(order, edited))


def test_many_rows_of_one_id_are_dealt_out(spark):
    rows = spark.createDataFrame([(None if k % 3 else 4, f"text {k}") for k in range(900)], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    edges = fingerprint._edges(rows, [4, None], {4: 3, None: 6})
    sizes = [r["count"] for r in rows.groupBy(fingerprint._range_of(edges).alias("r")).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 160


def test_files_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    import numpy as np

    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for k, n in enumerate((0, 1, 300, 301)):
        np.random.default_rng(k).integers(0, 9, n).astype("<u2").tofile(folder / f"part-{k}.bin")
    near = sorted(map(str, separators.scan(spark, str(folder), end=5, block=7).collect()))
    monkeypatch.setattr(separators, "readable", lambda path: False)
    assert near and sorted(map(str, separators.scan(spark, str(folder), end=5, block=7).collect())) == near


def test_hidden_letters_are_folded():
    assert toxicity.fold("𝐬𝐜𝐮𝐦 s\u200bc\u0301um \ufb01ne ⓢcum sc\xadum") == " scum scum fine scum scum "
    assert toxicity.fold("ÀÉ İ ﬃ") == " ae i ffi " and toxicity.fold(None) == "  " == toxicity.fold("\u200b")
