"""A log of changes gives the versions that whole snapshots would."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import sync
from auditlake.operators.versions import Versions, changes

SCHEMA = "rule_id string, platform string, description string, enabled boolean"


def snapshot(rng, now):
    out = {k: v for k, v in now.items() if rng.random() < 0.85}
    for _ in range(4):
        k = f"r{rng.randrange(12)}"
        out[k] = (k, rng.choice(["p", "q", None]), rng.choice(["x", "y", None]), rng.choice([True, False, None]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_equal_snapshots(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = Versions(spark, str(tmp_path), SCHEMA)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert log.latest == 0 and log.at().count() == 0
    kept = {0: {}}
    for step in range(7):
        if step == 4:
            back = rng.randrange(1, 4)
            n, now = log.rollback(back), kept[back]
        else:
            now = snapshot(rng, kept[log.latest])
            n = log.commit(spark.createDataFrame(list(now.values()), SCHEMA))
        kept[n] = now
    for n, now in kept.items():
        assert rows(log.at(n)) == sorted(now.values(), key=repr)
    sizes = {r.version: r.added + r.changed + r.removed + r.disabled for r in log.history().collect()}
    assert sizes == {n: sum(kept[n].get(k) != kept[n - 1].get(k) for k in {*kept[n], *kept[n - 1]}) for n in range(1, 8)}
    assert log.log().groupBy("version").count().agg(F.sum("count")).first()[0] == sum(sizes.values())  # nothing but changes is written
    log.compact(3)
    again = Versions(spark, str(tmp_path), SCHEMA)
    assert again.base == 5 and again.latest == 7
    for n in (5, 6, 7):
        assert rows(again.at(n)) == sorted(kept[n].values(), key=repr)
    with pytest.raises(ValueError):
        again.at(4)
    assert again.rollback(5) == 8 and rows(again.at()) == sorted(kept[5].values(), key=repr)
    again.compact(3)
    assert again.base == 6 and rows(again.at(6)) == sorted(kept[6].values(), key=repr)


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path):
    log = Versions(spark, str(tmp_path), SCHEMA)
    log.commit(spark.createDataFrame([("a", "p", "x", True)], SCHEMA))
    (tmp_path / "version=2").mkdir()
    (tmp_path / "version=2" / "part-0.parquet").write_bytes(b"half")
    assert log.latest == 1 and log.at().count() == 1
    assert log.commit(spark.createDataFrame([("a", "p", "x", False), ("b", None, None, None)], SCHEMA)) == 2
    assert [(r.added, r.changed, r.removed, r.disabled) for r in log.history().orderBy("version").collect()] == [(1, 0, 0, 0), (1, 0, 0, 1)]


def test_a_sync_is_one_commit(spark, tmp_path):
    log = Versions(spark, str(tmp_path), SCHEMA)
    log.commit(spark.createDataFrame([("a", "p", "old", True), ("b", "p", "x", True), ("c", "q", "x", True)], SCHEMA))
    remote = spark.createDataFrame([("a", "new"), ("d", "x")], "rule_id string, description string")
    log.commit(sync.synced(log.at(), remote, "p")[0])
    assert tuple(log.history().where("version = 2").first()) == (2, 1, 1, 0, 1)


def test_changes_of_repeated_and_null_keys(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), (None, 1), ("same", None)], "key string, v int")
    b = spark.createDataFrame([("k", 2), (None, 5), ("same", None), ("n", None)], "key string, v int")
    assert [tuple(r) for r in changes(a, b, "key").collect()] == [("added", "n", None)]
    assert changes(a.limit(0), b.limit(0), "key").count() == 0
