"""The life of a run: staged, verified, activated all or none, failed; and two writers at once."""

import pytest

from factweave.sources.store import RunStore, StoreError


def test_life(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    assert store.active("t") is None
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    runs = store.begin(["p", "q"])
    for r in runs.values():
        store.stage(r, "t", rows)
        store.verify(r, "t", rows)
    with pytest.raises(StoreError, match="PD3003"):
        store.verify(runs["p"], "t", rows.distinct())
    with pytest.raises(StoreError, match="PD3004"):
        store.activate([runs["p"]])
    assert store.active("t") is None
    store.activate(list(runs.values()))
    assert store.active("t").count() == 6 and store.active("t", "p").count() == 3
    with pytest.raises(StoreError, match="PD3002"):
        store.stage(runs["p"], "u", rows)
    with pytest.raises(StoreError, match="SD2004"):
        store.finish([runs["p"]], "Failed")
    again = store.begin(["p"])
    assert again["p"] != runs["p"]
    store.stage(again["p"], "t", rows.limit(1))
    assert store.active("t", "p").count() == 3
    store.finish([again["p"]], "Failed")
    assert store.active("t", "p").count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read(again["p"], "t")


def test_two_writers(spark, tmp_path):
    one, two = RunStore(spark, str(tmp_path)), RunStore(spark, str(tmp_path))
    old = two.manifest()
    one.begin(["p"])
    with pytest.raises(StoreError, match="PD3001"):
        two._replace(old, invocation=1)
