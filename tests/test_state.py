"""The rules of a mutation log, against a replay in Python."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake.operators import compaction, merge, scan, state
from kvlake.schema import EmptyKey

SCHEMA = "key string, version long, seq long, op string, value string, expires_at long"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def replay(rows, as_of=None, now=None):
    best = {}
    for r in rows:
        if as_of is not None and r[1] > as_of:
            continue
        if r[0] not in best or r[1:3] > best[r[0]][1:3]:
            best[r[0]] = r
    return {k: r[4] for k, r in best.items() if r[3] == "PUT" and (now is None or r[5] is None or r[5] > now)}


def shown(df):
    return {r["key"]: r["value"] for r in df.collect()}


MICRO = [
    ("a", 1, 1, "PUT", "old", None), ("a", 2, 2, "PUT", "new", None),
    ("b", 1, 1, "PUT", "x", None), ("b", 1, 2, "PUT", "later", None),
    ("c", 1, 1, "PUT", "x", None), ("c", 2, 2, "DEL", None, None),
    ("d", 1, 1, "PUT", "x", None), ("d", 2, 2, "DEL", None, None), ("d", 3, 3, "PUT", "back", None),
    ("e", 1, 1, "PUT", "", None),
    ("f", 1, 1, "PUT", "under", None), ("f", 2, 2, "PUT", "gone", 100),
    ("g", 1, 1, "PUT", "edge", 100), ("h", 1, 1, "PUT", "kept", 101),
]


def test_micro_rules(spark):
    rows = log(spark, MICRO)
    assert shown(state.live(rows)) == replay(MICRO)
    at_100 = shown(state.live(rows, now=100))
    assert at_100 == replay(MICRO, now=100)
    assert "f" not in at_100 and "g" not in at_100 and at_100["h"] == "kept" and at_100["e"] == ""
    assert shown(state.live(rows, as_of=1)) == replay(MICRO, as_of=1)
    assert shown(state.live(rows, as_of=0)) == {}
    assert {r["key"] for r in state.tombstones(rows).collect()} == {"c"}
    assert {r["key"] for r in state.expired(rows, 100).collect()} == {"f", "g"}


@pytest.mark.parametrize("seed", range(4))
def test_random_log_equals_replay(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(20)}é"[: r.randrange(2, 5)], r.randrange(10), i, r.choice(["PUT", "PUT", "DEL"]), str(i), r.choice([None, 5, 50])) for i in range(300)]
    df = log(spark, rows)
    for as_of, now in ((None, None), (4, None), (None, 5), (7, 20)):
        assert shown(state.live(df, as_of, now)) == replay(rows, as_of, now)
    bottom = compaction.compact(df)
    assert shown(state.live(bottom)) == shown(state.live(df))
    upper = compaction.compact(df, bottom=False)
    assert upper.count() == len({x[0] for x in rows})
    best = {x["key"]: x["value"] for x in state.winners_by_aggregate(df, ("value",)).collect()}
    assert best == {x["key"]: x["value"] for x in state.winners(df).collect()}


def test_scans(spark):
    rows = [(f"k{i:03d}", 1, i, "PUT", str(i), None) for i in range(50)] + [("k007", 2, 99, "DEL", None, None)]
    df = log(spark, rows)
    keys = lambda x: [r["key"] for r in x.collect()]
    assert keys(scan.scan(df, prefix="k00")) == [f"k{i:03d}" for i in range(10) if i != 7]
    assert keys(scan.scan(df, start="k045")) == [f"k{i:03d}" for i in range(45, 50)]
    assert keys(scan.scan(df, start="k010", end="k013")) == ["k010", "k011", "k012"]
    assert keys(scan.scan(df, start="k010", desc=True, limit=3)) == ["k010", "k009", "k008"]
    assert keys(scan.scan(df, desc=True, limit=1)) == ["k049"]
    assert [r["key"] for r in scan.iterate(df, prefix="k04")] == [f"k{i:03d}" for i in range(40, 50)]
    assert scan.get(df, "k007").count() == 0 and scan.get(df, "k008").first()["value"] == "8"
    with pytest.raises(EmptyKey):
        scan.get(df, "")
    asked = spark.createDataFrame([("k001",), ("k007",), ("zz",)], "key string")
    assert {r["key"]: r["found"] for r in scan.multi_get(df, asked).collect()} == {"k001": True, "k007": False, "zz": False}


def test_key_condition_reaches_the_scan(spark, tmp_path):
    log(spark, MICRO).write.parquet(str(tmp_path / "log"))
    plan = scan.get(spark.read.parquet(str(tmp_path / "log")), "a")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan and "WindowGroupLimit" in plan


def test_merge_prefers_newer_tiers(spark):
    old = log(spark, [("a", 9, 9, "PUT", "old", None), ("b", 1, 1, "PUT", "b", None)])
    new = log(spark, [("a", 1, 1, "PUT", "new", None), ("c", 1, 1, "DEL", None, None)])
    assert shown(merge.merge([new, old])) == {"a": "new", "b": "b", "c": None}
    assert shown(merge.overlay(old, new)) == {"a": "new", "b": "b"}
    assert shown(merge.drop_prefixes(old, ["a"])) == {"b": "b"}
    assert shown(merge.delete_keys(old, new)) == {"b": "b"}


def test_binary_keys_sort_by_unsigned_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"\x80"),), (bytearray(b"\x7f"),), (bytearray("é".encode()),)], "key binary")
    assert [bytes(r["key"]) for r in df.orderBy(F.asc("key")).collect()] == [b"\x7f", b"\x80", "é".encode()]
