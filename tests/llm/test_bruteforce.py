"""Operators that SQL cannot express, against brute force; and those with SQL, against it."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import bpe, common, embeddings, fingerprint, minhash, mixing, quality, queries, secrets, separators, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations labels".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    theirs = con.sql(queries.ORACLES[name]).df()
    assert sorted(theirs.columns) == cols
    key = lambda rows: sorted(repr(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)) for r in rows)
    assert key(tuple(r) for r in ours.select(cols).collect()) == key(theirs[cols].astype(object).itertuples(index=False, name=None))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = dict(tuple(r) for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}


def shingles(text):
    words = bytes((text or "").encode()).lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


@pytest.mark.parametrize("small, block", [(8, 512), (1, 4)])
def test_near_copies_against_all_pairs(spark, monkeypatch, small, block):
    """Small buckets pair by pair and large ones in blocks, then nearly all in small blocks.

    Groups of copies with more and more edits, passages that many share, and exact copies."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for group in range(6):
        base = [word() for _ in range(rng.choice((6, 8, 40, 120)))] + (passage if group % 2 else [])
        for copy in range(25):
            new = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 6))):
                new[rng.randrange(len(new))] = word()
            rows.append((len(rows), " ".join(new)))
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("intervals, square", [(8, 1), (40, 3), (40, 8)])
def test_vectors_against_all_pairs(spark, monkeypatch, intervals, square):
    """Few intervals joined pair by pair, then many in squares of strips."""
    monkeypatch.setattr(embeddings, "SQUARE", square)
    monkeypatch.setattr(embeddings, "SQUARES", 1)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(n, 16)) for c, s, n in zip(centres, np.linspace(0.05, 0.5, 40), rng.integers(1, 60, 40))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    monkeypatch.setattr(embeddings, "INTERVAL_BYTES", 1200 // intervals * 8 * 16)
    monkeypatch.setattr(embeddings, "RUN", 256 // intervals)
    got = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(linked[i].sum()), int(label[i])) for i in range(len(x))}


def scrambled(v):
    """splitmix64's finaliser, on Python's integers."""
    v = (v + 0x9E3779B97F4A7C15) % 2**64
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    v = (v ^ v >> 27) * 0x94D049BB133111EB % 2**64
    return v ^ v >> 31


def plain_parse(text, top=3):
    """Levels of phrase names of one text, symbol by symbol, up to a level or to one phrase."""
    places = [scrambled((1 << 20) + k) | 1 for k in range(64)]
    sym, levels = [scrambled(ord(c)) for c in text], []
    while len(levels) < top or (top == 0 and len(sym) > 1) or not levels:
        runs = []
        for s in sym:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        sym = [s if n == 1 else scrambled(s ^ scrambled(n)) for s, n in runs]
        labels = sym
        for step in range(4):
            new = []
            for k, v in enumerate(labels):
                d = (labels[k - 1] ^ v) if k else 1
                low = (d & -d).bit_length() - 1
                new.append(2 * low + (v >> low & 1) if k else v & 1)
            labels = new
        starts = [k for k in range(len(sym)) if k == 0 or (labels[k] < labels[k - 1] and (k + 1 == len(sym) or labels[k] < labels[k + 1]))]
        sym = [scrambled(sum(sym[k] * places[k - a & 63] for k in range(a, b)) % 2**64 ^ scrambled(b - a)) for a, b in zip(starts, [*starts[1:], len(sym)])]
        levels.append(sym)
    return levels


def test_parse_against_plain_version(texts):
    some = [t for t in list(texts.values())[:12]] + ["a", "ab", "aaaa", "abab" * 20, "\U0001f600é" * 9]
    for text, kept in zip(some, fingerprint.phrases(some)):
        assert kept.pop(fingerprint.ROOT).tolist() == plain_parse(text, 0)[-1] and len(plain_parse(text, 0)[-1]) == 1
        for level, names in kept.items():
            assert names.tolist() == sorted({n >> 32 for n in plain_parse(text[:100_000])[level - 1]})[: fingerprint.KEEP]


def test_equal_substrings_share_phrases(texts):
    body = max(texts.values(), key=len)[:6000]
    a, b = (set(plain_parse(x)[1]) for x in (body, "Some other beginning. " + body))
    assert len(a & b) >= 0.97 * len(a)


def test_edits(spark, texts):
    got = {r.doc_id: r for r in fingerprint.op5_fingerprints(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for i, n in zip(ids, ids[1:] + ids[:1]):
        t, k = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - k] + texts[n][:k]
        mine, new, nxt = fingerprint.phrases([t, edited, texts[n]])
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].near_edited, got[i].near_next) == (fingerprint.fingerprint(mine), fingerprint.likeness(mine, new), fingerprint.likeness(mine, nxt))
    assert all(r.near_edited > r.near_next for r in got.values())


def test_likeness_against_whole_phrase_sets(texts):
    """What 64 hashes of a level cost: the likeness of a text and its edit against the Jaccard similarity of all their phrases."""
    ids = sorted(texts, reverse=True)
    pairs = [(texts[i], texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[n][: len(texts[i]) // 3]) for i, n in zip(ids, ids[1:])]
    pairs = [p for p in pairs if 300 < len(p[0]) < 12_000][:60]
    errors = []
    for a, b in pairs:
        x, y = fingerprint.phrases([a, b])
        both = [v for v in fingerprint.LEVELS if v in x and v in y]
        level = next((v for v in both if min(len(x[v]), len(y[v])) >= fingerprint.ENOUGH), both[-1])
        p, q = set(plain_parse(a)[level - 1]), set(plain_parse(b)[level - 1])
        errors.append(abs(fingerprint.likeness(x, y) - len(p & q) / len(p | q)))
    print("mean error", sum(errors) / len(errors), "largest", max(errors))
    assert len(errors) > 30 and sum(errors) / len(errors) < 0.05 and max(errors) < 0.2


def test_token_counts(spark, texts):
    import public_tokenizers

    encoding = separators._ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = separators.op6_token_counts(spark, SF).collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(encoding.encode_ordinary(t)) for t in texts.values())


@pytest.mark.parametrize("block", [1, 7, 37, 5000])
def test_scan_stitches_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = []
    for k, n in enumerate((0, 1, 300, 301)):
        ids = rng.integers(0, 9, n).astype("<u2")
        ids[n // 3 : n // 2] = 1
        ids.tofile(tmp_path / f"part-{k}.bin")
        at = np.flatnonzero(ids == 5)
        for i, (a, b) in enumerate(zip([0, *(at + 1)], [*at, n])):
            if i < len(at) or b > a:
                want.append((f"part-{k}.bin", i, int(a), int(b - a), i < len(at)))
    got = separators.scan(spark, str(tmp_path), end=5, block=block).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.doc_no, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_against_library(spark, texts):
    rng = random.Random(3)
    signs = "aAbZ sS'tTrRéÉßΣσςİıẞ́̈ \x1c\x1d\x85\xa0 ​漢字かな가😀1²Ⅷ٣_-.!?\n\tſK'sll<|startoftext|>"
    some = list(texts.values())[:60] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", "<|endoftext|>A<|endoftext|>", "x" * 3000]
    tok, mine = library(), bpe.tokenizer(bpe.default_path())
    for text, ref in zip(some, tok.encode_batch(some, add_special_tokens=False)):
        decoded = tok.decode(ref.ids, skip_special_tokens=False)
        assert mine.digest(text) == (len(ref.ids), hashlib.sha256(" ".join(map(str, ref.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    word = bpe.WordBpe(bpe.default_path())
    assert any((a, b) not in word.joined for a, b in zip("éàöß", "ßéàö")), "some pairs must force a cut"


@pytest.mark.parametrize("query, label, folds, held, least", [("op9_toxicity", "toxic", 4, 2, 0.95), ("op1_quality", "quality", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, held, least):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(F.col(label).isNotNull()).collect()
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = [r for r in scored if r.held_out]
    assert sum(r.predicted == r[label] for r in kept) >= least * len(kept)


def test_models_are_repeatable(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert toxicity.learn(docs, labels) == toxicity.learn(docs.orderBy("text"), labels)
    assert quality.learn(docs, labels) == quality.learn(docs.orderBy("text"), labels)


def test_pipeline(spark, docs, texts):
    """Stage by stage against plain Python on whole texts."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    model = toxicity.learn(docs, labels)
    left = {i: t for i, t in texts.items() if model.score(t) < toxicity.THRESHOLD}
    sets = {i: shingles(t) for i, t in left.items()}
    parent = {i: i for i in left}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in left:
        for b in left:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(docs.where(F.col("doc_id").isin(list(left)))).collect()}
    for i, found in spans.items():
        out, at = "", 0
        for s in found:
            if s.start >= at:
                out += left[i][at : s.start] + "[secret]"
            at = max(at, s.finish)
        left[i] = out + left[i][at:]
    count = {i: len(left[i].encode().split()) for i in left}
    plan = mixing.mix(spark.createDataFrame([(i, left[i], source[i]) for i in left], "doc_id long, text string, source string")).collect()
    want, tok = Counter(), library()
    for r in plan:
        for n in r.pass_words:
            if n:
                text = left[r.doc_id] if n >= count[r.doc_id] else " ".join(w.decode() for w in left[r.doc_id].encode().split()[:n])
                want[r.doc_id, hashlib.sha256(" ".join(map(str, tok.encode(text, add_special_tokens=False).ids)).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_quality_against_plain_zstandard(spark, docs, texts):
    """Every score from sizes that zstandard gives block by block, whole texts through."""
    import math

    import zstandard

    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    packs = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r.doc_id: r.score for r in quality.op1_quality(spark, SF).collect()}
    assert set(got) == set(texts) and model.good and model.bad
    for i, t in texts.items():
        data = t.encode()
        good, bad = (sum(len(p.compress(data[k : k + 256])) for k in range(0, len(data), 256)) for p in packs)
        x = (bad - good) / (good + bad) if data else 0.0
        assert math.isclose(got[i], 1 / (1 + math.exp(-(model.slope * x + model.bias))), abs_tol=1e-12)


def test_toxicity_against_substring_search(spark):
    """Every score from a search for each pattern and phrase on its own, of overlapping places too."""
    import math

    sf = SF.replace("sf0.001", "sf0.01")  # enough labels for a lexicon
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.op9_toxicity(spark, sf).collect()}
    assert set(got) == set(texts) and model.weights
    places = lambda text, p: [k for k in range(len(text)) if text.startswith(p, k)]
    for i, t in texts.items():
        folded = toxicity.fold(t)
        free = [(k, k + len(p)) for p in model.excused if p in folded for k in places(folded, p)]
        total = sum(w for p, w in model.weights.items() if p in folded for k in places(folded, p) if not any(a <= k and k + len(p) <= b for a, b in free))
        strength = total / (1 + math.log(1 + max(1, len(folded.split()))))
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, model.slope * strength + model.bias)))), abs_tol=1e-9)


def test_sample_is_bounded_by_bytes_and_repeated_ids(spark):
    docs = spark.createDataFrame([(k, "x" * 10 * (k + 1)) for k in range(30)] + [(3, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 4, 2, 100, 500)
    for mark in (0, 1):
        sizes = [len(t) for m, t in rows if m == mark]
        assert 1 < len(sizes) and sum(sizes) <= 500
