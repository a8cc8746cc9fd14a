"""Near-duplicate operators where ids repeat with different texts or vectors, in either order of the rows."""

import random

import numpy as np
import pytest

from factweave.llm import embeddings, minhash

WORDS = [f"word{k}" for k in range(60)]
A, B = " ".join(WORDS[:30]), " ".join(WORDS[30:])


@pytest.mark.parametrize("turn", [1, -1])
def test_texts_of_one_id_are_one_vertex(spark, turn):
    rows = [(5, A), (5, B), (9, B + " more"), (11, A + " more"), (12, "quite another text of its own here"), (5, "")][::turn]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(5, 0, 5), (5, 26, 5), (5, 26, 5), (9, 27, 5), (11, 27, 5), (12, 3, 12)]


def sets_of(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def closure(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(rng.choice((3, 12, 40)))] for _ in range(12)]
    rows = []
    for _ in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(5)}"
        rows.append((rng.randrange(60), " ".join(words)))
    rows += rows[:7] + [(3, ""), (70, "")]
    linked = [(a, b) for a, s in rows for b, t in rows if a < b and sets_of(s) and 100 * len(sets_of(s) & sets_of(t)) >= 75 * len(sets_of(s) | sets_of(t))]
    want = closure({i for i, _ in rows}, linked)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(sets_of(t)), want[i]) for i, t in rows)


def test_large_ids_stay_whole_beside_null_ids(spark):
    big = 2**62 + 1
    rows = [(big, A), (big + 1, A), (None, A), (big + 2, B)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (big, big, True), (big + 1, big, False), (big + 2, big + 2, True)]


def test_long_text_is_hashed_in_pieces_like_a_short_one(monkeypatch):
    text = " ".join(f"w{k}" for k in range(5000)) + "  "
    (whole,) = next(minhash.shingle_sets([text]))
    monkeypatch.setattr(minhash, "CHUNK", 64)
    (pieces,) = next(minhash.shingle_sets([text]))
    assert (whole == pieces).all() and len(whole) == 4996


@pytest.mark.parametrize("turn", [1, -1])
def test_vectors_of_one_id_are_one_vertex(spark, turn):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [-1.0, 0.01]), (5, [0.01, 1.0])][::turn]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (1, 3), 5: (1, 3)}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, *want[i]) for i, _ in rows)


@pytest.mark.parametrize("repeats", [False, True])
def test_vectors_against_all_pairs_with_repeats(spark, monkeypatch, repeats):
    monkeypatch.setattr(embeddings, "INTERVAL_BYTES", 16 * 8 * 40)
    monkeypatch.setattr(embeddings, "RUN", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(n, 16)) for c, s, n in zip(centres, np.linspace(0.0, 0.5, 30), rng.integers(1, 40, 30))])
    ids = rng.integers(0, len(x) // 2, len(x)) if repeats else np.arange(len(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    linked = {(int(ids[a]), int(ids[b])) for a, b in np.argwhere(near) if ids[a] != ids[b]}
    want = closure({int(i) for i in ids}, linked)
    got = embeddings.near_vectors(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((int(i), sum(a == i for a, _ in linked), want[int(i)]) for i in ids)
