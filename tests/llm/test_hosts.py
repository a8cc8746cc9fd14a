"""Host rules: measures against plain regular expressions, the prior against its definition, verdicts and joins."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.llm import hosts

DOCS = "doc_id long, text string, source string"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(lines)


@pytest.mark.parametrize("seed", range(4))
def test_measures(seed):
    rng = random.Random(seed)
    signs = ["a", "b", "é", "\U0001f600", "#", "|", " ", " ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", "\x1c", "a b c "]
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert hosts.measures(text) == by_hand(text)
    assert hosts.measures(None) == hosts.measures("") == (0,) * 6


def test_prior():
    """Rates drawn from a known prior give it back; hosts that agree, one host and no rows give a prior that decides alone."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = rng.integers(20, 400, 4000)
    k = rng.binomial(n, rng.beta(3.0, 9.0, 4000))
    alpha, beta = hosts.beta_prior(int(n.sum()), int(k.sum()), len(n), float((n * n).sum()), float((k * k / n).sum()))
    assert abs(alpha - 3) < 0.4 and abs(beta - 9) < 1.2
    for args in ((100, 10, 10, 1000.0, 1.0), (50, 5, 1, 2500.0, 0.5), (0, 0, 0, 0.0, 0.0), (100, 0, 10, 1000.0, 0.0), (100, 100, 10, 1000.0, 100.0)):
        alpha, beta = hosts.beta_prior(*args)
        assert alpha >= 0 and beta >= 0 and alpha + beta > 1e6


def test_hosts_are_judged_and_joined_back(spark, monkeypatch):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(k, good if k % 10 else "short", f"fine{k % 19}") for k in range(2000)]
    rows += [(5000 + k, good if k % 10 == 0 else "buy now " * 40, "spam") for k in range(300)]  # large and bad
    rows += [(6000, "short", "tiny"), (6001, good, "tiny")]  # half of its rows fail, but it has only two
    rows += [(None, good, None)] * 800 + [(7000, None, None), (7001, good, ""), (7001, good, "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5).select("*", *[F.lit("clash").alias(c) for c in ("host", "n_docs", "kept", "n_words", "host_rate")])
    results = []
    for share in (hosts.HOT_SHARE, 1):  # most hosts by broadcast, then none
        monkeypatch.setattr(hosts, "HOT_SHARE", share)
        results.append(sorted(map(repr, hosts.host_rules(docs).collect())))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    got = {}
    for r in hosts.host_rules(docs).collect():
        got.setdefault(r.host, []).append(r)
        assert r.kept == (r.host_kept and not r.base_failed)
    assert not any(r.host_kept for r in got["spam"]) and not any(r.kept for r in got["spam"])
    assert all(r.host_kept for h, rs in got.items() if h != "spam" for r in rs)
    assert got["tiny"][0].host_rate < 0.5 and got["spam"][0].host_rate > 0.8 and got["spam"][0].host_docs == 300
    assert all(r.host_docs == 0 and r.host_rate == 0 for r in got[None]) and Counter(r.kept for r in got[None]) == {True: 800, False: 1}
    assert len(got[""]) == 2
    assert hosts.host_rules(docs.limit(0)).collect() == []
