"""Surrogate keys over loads: kept by later loads, equal to the one-load keys at first, no job to plan."""

import os
import random
import tempfile

import pytest

from spineworks.operators import keys as K
from spineworks.operators.quality import surrogate_key
from spineworks.plans.tables import USAGE_ORDER, Tables
from spineworks.plans.warehouse import WarehouseTables, materialize

SCHEMA = "usage_id long, sub long, name string, n long"
ORDER = ("sub", "name", "n")


def _new(spark):
    return K.KeyDictionary(spark, tempfile.mkdtemp(prefix="spineworks-keys-") + "/d", "usage_id", ORDER)


def _rows(rnd, n):
    return [(i, rnd.choice([None, 1, 2, 3]), rnd.choice([None, "", "a", "b"]), rnd.randint(0, 4)) for i in range(n)]


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_first_load_gets_the_consecutive_keys(spark):
    df = spark.createDataFrame(_rows(random.Random(1), 300), SCHEMA)
    d = _new(spark)
    assert d.update(df) == 300
    assert _bag(d.apply(df)) == _bag(surrogate_key(df, "usage_id", ORDER, tempfile.mkdtemp() + "/r"))
    assert d.high_water() == 300


@pytest.mark.parametrize("block", [K.BLOCK, 7])
def test_later_loads_keep_ids_and_only_append(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    rnd, d, rows, given = random.Random(block), _new(spark), _rows(random.Random(2), 200), {}
    for _ in range(4):
        df = spark.createDataFrame(rows, SCHEMA)
        before = d.high_water()
        added = d.update(df)
        assert d.high_water() == before + added
        ids = _bag(d.apply(df))
        assert len({r[0] for r in ids}) == len(rows)
        assert sorted(map(str, (r[1:] for r in ids))) == sorted(map(str, (r[1:] for r in rows)))
        for r in ids:  # an id names one content for good
            assert given.setdefault(r[0], r[1:]) == r[1:]
        assert d.update(df) == 0 and _bag(d.apply(df)) == ids
        # some rows go, some contents come again or anew
        rows = rnd.sample(rows, 150) + _rows(rnd, 60) + [(0, 9, "hot", 1)] * 40


def test_a_big_group_of_copies(spark):
    df = spark.range(30_000).selectExpr("id AS usage_id", "IF(id % 3 = 0, 7L, id) AS sub", "'x' AS name", "0L AS n")
    d = _new(spark)
    assert d.update(df) == 30_000
    assert d.blocks().count() == 20_000  # 10,001 copies (7 itself is one) are one block
    got = d.apply(df)
    assert (got.count(), got.select("usage_id").distinct().count(), got.agg({"usage_id": "max"}).first()[0]) == (30_000,) * 3


def test_planning_runs_no_job(spark):
    df = spark.createDataFrame(_rows(random.Random(3), 50), SCHEMA)
    d = _new(spark)
    d.update(df)
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "plan")
    try:
        plan = d.apply(df)
        assert len(sc.statusTracker().getJobIdsForGroup("plan-only")) == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert plan.count() == 50


def test_failed_load_takes_no_ids(spark, monkeypatch):
    df = spark.createDataFrame(_rows(random.Random(4), 30), SCHEMA)
    d = _new(spark)
    d.update(df.limit(10))
    kept, mark = _bag(d.blocks()), d.high_water()
    real = K.versions.write_text

    def lost(spark, name, text):
        if name.endswith("_current"):
            raise OSError("store is gone")
        real(spark, name, text)
    monkeypatch.setattr(K.versions, "write_text", lost)
    with pytest.raises(OSError):
        d.update(df)
    monkeypatch.undo()
    assert (_bag(d.blocks()), d.high_water()) == (kept, mark)
    assert d.update(df) > 0 and d.apply(df).count() == 30


def test_other_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        _new(spark).update(spark.createDataFrame([(1, 2)], "usage_id long, other long"))


def test_warehouse_keeps_usage_ids_between_runs(spark):
    sf, folder = "/root/testdata/sf0.001", tempfile.mkdtemp(prefix="spineworks-keys-wh-")

    class Part(Tables):
        def _load(self, name):
            df = super()._load(name)
            return df.where("subscription_id % 2 = 0") if name == "feature_usage" else df
    materialize(Part(spark, sf), folder)
    first = WarehouseTables(spark, folder).rekeyed_usage()
    early = {r["usage_id"]: tuple(r[c] for c in USAGE_ORDER) for r in first.collect()}
    materialize(Tables(spark, sf), folder)
    late = {r["usage_id"]: tuple(r[c] for c in USAGE_ORDER) for r in WarehouseTables(spark, folder).rekeyed_usage().collect()}
    assert len(late) == Tables(spark, sf).raw_usage.count() > len(early)
    assert all(late[i] == c for i, c in early.items())
    assert os.listdir(f"{folder}/_keys/usage")
