"""Value log, manifest, compaction policy, sketches and the engine."""

import pytest
from pyspark.sql import functions as F

from kvlake import schema as S
from kvlake.functions import keys as fk
from kvlake.functions import sketches
from kvlake.operators import cache, compaction, manifest, ranges, valuelog
from kvlake.sources.engine import Engine
from kvlake.sources import log as mutations


def test_values_around_the_threshold(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in (0, 1023, 1024, 1025)] + [(-1, None)], "key int, value string")
    inline, log = valuelog.separate(rows, fid=F.lit(0))
    assert {r["key"] for r in inline.where("vptr IS NOT NULL").collect()} == {1024, 1025}
    assert sorted((r["offset"], r["len"]) for r in log.collect()) == [(0, 1024), (1024, 1025)]
    back = {r["key"]: r["value"] for r in valuelog.resolve(inline, log).collect()}
    assert back == {r["key"]: r["value"] for r in rows.collect()}
    assert valuelog.bad_checksums(log).isEmpty()
    assert valuelog.bad_checksums(log.withColumn("value", F.lit("other"))).count() == 2


@pytest.mark.parametrize("ratio", [0, 1, -1])
def test_bad_gc_ratio(spark, ratio):
    with pytest.raises(S.InvalidRequest):
        valuelog.gc_candidate(spark.createDataFrame([], "fid long, total long, discard long"), ratio)


def test_gc_picks_the_most_wasteful_file(spark):
    stats = spark.createDataFrame([(1, 100, 60), (2, 100, 70), (3, 1000, 80), (4, 10, 0)], "fid long, total long, discard long")
    assert valuelog.gc_candidate(stats, 0.5).first()["fid"] == 2
    assert valuelog.gc_candidate(stats, 0.05).first()["fid"] == 3
    assert valuelog.gc_candidate(stats, 0.9).isEmpty()
    text = valuelog.discard_json(stats.where("discard > 0")).first()["stats"]
    assert {r["fid"]: r["discard"] for r in valuelog.read_discard_json(text, spark).collect()} == {1: 60, 2: 70, 3: 80}


def changes(spark, rows):
    return spark.createDataFrame([(i, 0, t, op, 0) for i, (t, op) in enumerate(rows)], S.MANIFEST_LOG)


def test_manifest(spark):
    good = changes(spark, [(1, "CREATE"), (2, "CREATE"), (1, "DELETE")])
    assert [r["table_id"] for r in manifest.checked_fold(good).collect()] == [2]
    for bad in ([(1, "CREATE"), (1, "CREATE")], [(1, "DELETE")]):
        with pytest.raises(S.BadManifest):
            manifest.checked_fold(changes(spark, bad))
    files = spark.createDataFrame([(2,), (9,)], "table_id long")
    assert {(r["table_id"], r["state"]) for r in manifest.reconcile(spark.createDataFrame([(2,), (3,)], "table_id long"), files).collect()} == {(3, "missing"), (9, "orphan")}
    assert manifest.rewrite_due(20_000, 19_000) and not manifest.rewrite_due(20_000, 9_000) and not manifest.rewrite_due(100_000, 20_000)
    assert manifest.fold(manifest.snapshot(good)).count() == 1
    for args in (("other", 1, 0, 0), (manifest.MAGIC, 2, 0, 0), (manifest.MAGIC, 1, 3, 4)):
        with pytest.raises(S.BadManifest):
            manifest.check_header(*args)


def test_level_policy(spark):
    mb = 1 << 20
    sizes = {6: 5000 * mb, 5: 200 * mb}
    want, (first, base) = compaction.target_bytes(sizes[6]), compaction.flow_level(sizes)
    assert want[6] == 5000 * mb and want[5] == 500 * mb and want[4] == 50 * mb and want[3] == 10 * mb
    assert compaction.table_bytes(first)[1] == 5 * mb and base >= 3
    tables = [(i, 0, 0, "a", "b") for i in range(45)] + [(100 + i, 5, 100 * mb, "a", "b") for i in range(10)] + [(200, 6, 5000 * mb, "a", "b")]
    t = spark.createDataFrame(tables, "table_id long, level int, size_bytes long, min_key string, max_key string").withColumn("stale_bytes", F.lit(0))
    scores = compaction.level_scores(t, compaction.level_policy(t))
    assert {r["level"] for r in compaction.due(scores, 6).collect()} == {0, 5}
    busy = spark.createDataFrame([(5, 600 * mb)], "level int, bytes long")
    assert {r["level"] for r in compaction.due(compaction.level_scores(t, compaction.level_policy(t), inflight=busy), 6).collect()} == {0}
    none = t.limit(0)
    assert compaction.due(compaction.level_scores(none, compaction.level_policy(none)), 6).isEmpty()
    assert compaction.flow_level({})[1] == 6 and compaction.flow_level({6: 10**12}) == (1, 5)


def test_level_scores_with_level0_as_base(spark, tmp_path):
    """A last level of more than 10 MiB * 10**5: level 0 is the base and is damped by itself, as in the SQL."""
    import duckdb

    from kvlake.plans import catalog

    rows = "SELECT id AS p_partkey, CAST(46000 + id AS INT) AS p_size FROM range(200)"
    spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert {r["level"]: r["damped_by"] for r in compaction.level_policy(catalog._part_tables(spark, str(tmp_path))).collect()}[0] == 0
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for name in ("lsm_level_targets", "lsm_level_scores", "lsm_due_levels"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(db.execute(catalog.SQL[name]).fetchall()), name
    near = [4369.3621736575, 8706.2457341125, 11656.979666642499, 22343390.324752506]
    near_half = spark.createDataFrame([(x,) for x in near], "score double")
    assert [tuple(r) for r in near_half.select(catalog._nine_places("score")).collect()] == [db.execute("SELECT round(?::DOUBLE, 9)", [x]).fetchone() for x in near]


def test_flow_level_walks_up_and_slides_down():
    from itertools import product

    mb = 1 << 20
    for sizes in product((0, mb, 300 * mb), (0, 20 * mb), (0, 5 * mb), (0, 50 * mb, 10**11)):
        held = dict(zip((3, 4, 5, 6), sizes, strict=True))
        size, base = held[6], 0  # the rule as a walk
        for level in range(6, 0, -1):
            if not base and size <= 10 * mb:
                base = level
            size //= 10
        assert compaction.flow_level(held)[0] == base
        for level in range(base + 1, 6):
            if held.get(level, 0):
                break
            base = level
        if base < 6 and not held.get(base, 0) and held.get(base + 1, 0) < compaction.target_bytes(held[6])[base + 1]:
            base += 1
        assert compaction.flow_level(held)[1] == base, held


def test_fills(spark):
    rows = [(1, 0, "a", "d", 5, 0, 0), (2, 0, "c", "g", 5, 0, 0), (3, 0, "x", "z", 5, 0, 0), (4, 0, "f", "h", 5, 0, 0), (5, 3, "g", "k", 5, 0, 0), (6, 3, "l", "m", 5, 0, 0)]
    rows += [(10 + i, 6, f"k{i}", f"k{i}z", 40, 100 - i * (i % 2), i) for i in range(7)]
    t = spark.createDataFrame(rows, "table_id long, level int, min_key string, max_key string, size_bytes long, stale_bytes long, created_at long")
    ids = lambda df: sorted(r["table_id"] for r in df.collect())
    assert ids(compaction.fill_level0(t, 3)) == [1, 2, 5]
    assert ids(compaction.fill_level0(t.where("level <> 0"), 3)) == []
    assert ids(compaction.fill_last(t, 6, 130, min_stale=50)) == [10, 11, 12]
    assert ids(compaction.fill_last(t, 6, 40, min_stale=50)) == [10] and ids(compaction.fill_last(t, 6, 130, min_stale=500)) == []
    parts = [tuple(r) for r in compaction.split_at_tables(t.where("level = 6")).orderBy("part").collect()]
    assert parts == [(0, None, "k2z"), (1, "k2z", "k5z"), (2, "k5z", None)]
    assert ids(ranges.overlapped_below(t, 0)) == [2, 4]


def test_split_counts_distinct_keys(spark):
    for n, parts in ((0, 3), (2, 5), (7, 3), (1000, 7)):
        keys = spark.range(n).select(F.format_string("%05d", "id").alias("key"))
        got = [tuple(r) for r in ranges.split(keys.union(keys).repartition(5), parts).orderBy("part").collect()]
        sizes = [n // parts + (i < n % parts) for i in range(parts)]
        assert [r[3] for r in got] == [x for x in sizes if x] and all(a[2] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_range_algebra(spark):
    df = spark.createDataFrame([(1, 3, 1, 3), (1, 3, 1, 4), (3, 1, 9, 2), (None, None, 5, 1), (1, 2, None, None)], "a int, b int, c int, d int")
    r = df.select(ranges.is_empty(F.col("a"), F.col("b")).alias("e"), ranges.equals(*map(F.col, "abcd")).alias("q")).collect()
    assert [tuple(x) for x in r] == [(False, True), (False, False), (True, True), (True, True), (False, False)]


def test_ranges(spark):
    t = spark.createDataFrame([(1, "a", "c"), (2, "c", "d"), (3, "e", "f")], "table_id int, min_key string, max_key string")
    assert [(r["a"], r["b"]) for r in ranges.overlap_pairs(t).collect()] == [(1, 2)]
    assert {r["table_id"] for r in ranges.overlapping(t, "d", "e").collect()} == {2, 3}
    keys = spark.createDataFrame([("c",), ("dd",), ("f",)], "key string")
    assert {(r["key"], r["table_id"]) for r in ranges.table_for_key(keys, t).collect()} == {("c", 1), ("c", 2), ("f", 3)}


def test_bloom_and_count_min_err_on_one_side(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    bits, k = sketches.bloom_bits(2000, 0.01), sketches.bloom_hashes(sketches.bloom_bits_per_key(0.01))
    built = sketches.bloom_filter(keys, "key", bits=bits, hashes=k)
    probe = spark.range(4000).select("id", F.col("id").cast("string").alias("key"))
    got = sketches.might_contain(probe, "key", built, bits=bits, hashes=k)
    assert got.where("id < 2000 AND NOT might_contain").count() == 0
    assert got.where("id >= 2000 AND might_contain").count() < 100
    rows = spark.range(5000).select((F.col("id") % 70).alias("v"))
    several = sketches.bloom_bits(2000, 1e-9)
    small = sketches.PART_BITS
    try:
        sketches.PART_BITS = 4096  # a filter of several parts
        built = sketches.bloom_filter(keys, "key", bits=several, hashes=k)
        assert built.count() == -(-several // 4096)
        got = sketches.might_contain(probe, "key", built, bits=several, hashes=k)
        assert got.where("id < 2000 AND NOT might_contain").count() == 0 and got.where("id >= 2000 AND might_contain").count() < 20
    finally:
        sketches.PART_BITS = small
    est = sketches.count_min_estimates(rows, "v", width=64)
    assert est.join(rows.groupBy("v").count(), "v").where("estimate < count").count() == 0
    assert sketches.count_min(rows, "v").first()["sketch"]


def test_functions(spark):
    import pandas as pd

    assert sketches.crc32c_bytes(b"123456789") == 0xE3069283
    values = pd.Series([b"", None, b"a", b"abc", b"abcd", b"abcde", b"123456789"])
    assert sketches.crc32c_rows(values).tolist()[:1] == [0] and pd.isna(sketches.crc32c_rows(values)[1])

    def plain(b):
        h = 0xBC9F1D34 ^ len(b) * 0xC6A4A793 & 0xFFFFFFFF
        for i in range(0, len(b) // 4 * 4, 4):
            h = (h + int.from_bytes(b[i : i + 4], "little")) * 0xC6A4A793 & 0xFFFFFFFF
            h ^= h >> 16
        if rest := b[len(b) // 4 * 4 :]:
            h = (h + int.from_bytes(rest, "little")) * 0xC6A4A793 & 0xFFFFFFFF
            h ^= h >> 24
        return h

    assert [x for x in sketches.hash32_rows(values).tolist() if not pd.isna(x)] == [plain(b) for b in values if b is not None]
    codes = spark.createDataFrame([(0,), (127,), (128,), (300,), (2**62,)], "x long").select("x", fk.uvarint(F.col("x")).alias("b")).select("x", "b", fk.from_uvarint(F.col("b")).alias("y"), fk.byte_slice(F.col("b")).alias("s")).select("*", fk.from_byte_slice(F.col("s")).alias("t")).collect()
    assert [bytes(r["b"]).hex() for r in codes][:4] == ["00", "7f", "8001", "ac02"] and all(r["x"] == r["y"] and r["b"] == r["t"] for r in codes)
    top = spark.range(1).select(fk.from_big_endian_unsigned(F.lit(bytearray(b"\xff" * 8)))).first()[0]
    assert int(top) == 2**64 - 1
    df = spark.createDataFrame([(bytearray(b"ab"), 7), (bytearray(b"\xff"), 0), (bytearray(b"a"), 2**62)], "k binary, v long")
    r = df.select("k", "v", fk.internal_key(F.col("k"), F.col("v")).alias("i")).select("*", fk.user_key(F.col("i")).alias("u"), fk.key_version(F.col("i")).alias("w"), sketches.crc32c(F.col("k")).alias("c")).collect()
    assert all(x["k"] == x["u"] and x["v"] == x["w"] and x["c"] == sketches.crc32c_bytes(bytes(x["k"])) for x in r)
    assert spark.range(1).select(fk.file_id(F.lit("/x/00012.vlog")).alias("a"), fk.file_id(F.lit("x.txt")).alias("b")).first()[:] == (12, None)


def test_cache():
    c = cache.TinyLfu(5)
    for i in range(10):
        c.set(f"key{i}", f"val{i}")
    for _ in range(1000):
        for i in range(10):
            v = c.get(f"key{i}")
            assert v in (None, f"val{i}")
    assert c.hits and c.misses and len(list(c.keys())) <= 5
    c.set("key1", "again")
    assert c.get("key1") == "again" and c.delete("key1") == "again" and c.get("key1") is None


def test_counters_stick_and_fade():
    c, d = cache.CountMin4(64), cache.Doorkeeper(100)
    for _ in range(40):
        c.add("x")
    assert c.estimate("x") == 15 and c.estimate("never") == 0
    c.halve()
    assert c.estimate("x") == 7
    c.clear()
    assert c.estimate("x") == 0
    assert not d.knows("x") and d.knows("x")
    d.clear()
    assert not d.knows("x")
    held = cache.TinyLfu(2)
    held.set("a", 1), held.set("b", 2)
    for _ in range(5):
        held.get("a"), held.get("b")
    held.set("once", 3), held.set("c", 4)
    assert {"a", "b"} & set(held.keys()) and "once" not in held.keys()


def test_as_of_join(spark):
    from kvlake.operators import state

    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 3, 1, "y"), ("a", 3, 2, "z"), ("b", 5, 1, "w")], "key string, version long, seq long, value string")
    asked = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 4, 5), ("b", 9, 6), ("c", 9, 7), ("a", 2, 8)], "key string, at long, no int")
    got = {r["no"]: r["value"] for r in state.as_of_join(asked, log).collect()}
    assert got == {1: None, 2: "x", 3: "x", 4: "z", 5: None, 6: "w", 7: None, 8: "x"}


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=100, grace_seconds=0))
    rows = spark.createDataFrame([(f"key{i:02d}".encode(), (b"v" * (i * 10))) for i in range(20)], "key binary, value binary")
    e.write(mutations.puts(rows))
    e.set("key03", "new")
    e.delete("key04")
    e.set("short", "lived", ttl_seconds=10, now=1000)
    assert bytes(e.get("key03", now=5)["value"]) == b"new" and bytes(e.get("key15", now=5)["value"]) == b"v" * 150
    assert bytes(e.get("short", now=1009)["value"]) == b"lived"
    for key, now in (("key04", 5), ("short", 1010), ("none", 5)):
        with pytest.raises(S.KeyNotFound):
            e.get(key, now=now)
    with pytest.raises(S.EmptyKey):
        e.set("", "x")
    with pytest.raises(S.EmptyKey):
        e.get("")
    assert bytes(e.get("key00", now=5)["value"]) == b""
    before = {bytes(r["key"]): bytes(r["value"]) for r in e.iterate(now=5)}
    assert [bytes(r["key"]) for r in e.scan(prefix="key1", desc=True, limit=2, now=5).collect()] == [b"key19", b"key18"]
    overwritten = spark.createDataFrame([(f"key{i:02d}".encode(), b"s") for i in range(10, 18)], "key binary, value binary")
    e.write(mutations.puts(overwritten))
    before |= {f"key{i:02d}".encode(): b"s" for i in range(10, 18)}
    with pytest.raises(S.InvalidRequest):
        e.run_value_log_gc(1)
    held = lambda: sorted((tmp_path / "db" / "vlog").glob("fid=*/*.parquet"))
    files, size = held(), sum(f.stat().st_size for f in held())
    dropped = e.run_value_log_gc(0.5)
    assert not (tmp_path / "db" / "vlog" / f"fid={dropped}").exists() and set(files) - set(held())
    assert sum(f.stat().st_size for f in held()) < size and not list((tmp_path / "db" / "staging").glob("*"))
    assert {bytes(r["key"]): bytes(r["value"]) for r in e.iterate(now=5)} == before
    assert e.value_log().where(F.col("fid") == dropped).isEmpty()
    with pytest.raises(S.NoRewrite):
        e.run_value_log_gc(0.9)
    e.compact(now=5)
    assert {bytes(r["key"]): bytes(r["value"]) for r in e.iterate(now=5)} == before
    again = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=100, max_batch_count=2, verify_checksum=True, grace_seconds=0))
    assert {bytes(r["key"]): bytes(r["value"]) for r in again.iterate(now=5)} == before
    info = again.info(now=5)
    assert info["entries"] == len(before) and bytes(info["min_key"]) == b"key00"
    with pytest.raises(S.BatchTooBig):
        again.write(mutations.puts(overwritten))
    (tmp_path / "db" / "tables" / "999").mkdir()
    assert again.remove_orphans() >= 1 and again.reconcile().isEmpty()
    e.close()
    with pytest.raises(S.Closed):
        e.get("key00")
    (tmp_path / "db" / "HEADER.json").write_text('{"magic": "bad", "version": 1}')
    (tmp_path / "db" / ".HEADER.json.crc").unlink()
    with pytest.raises(S.BadManifest):
        Engine(spark, str(tmp_path / "db"))


def contents(e):
    return {bytes(r["key"]): bytes(r["value"]) for r in e.iterate(now=5)}


def test_batches_that_differ_at_each_evaluation(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=10, verify_checksum=True))
    rows = spark.range(50).select(F.col("id").cast("string").cast("binary").alias("key"), F.repeat(F.uuid(), (F.rand() * 3).cast("int") + 1).cast("binary").alias("value"))
    e.write(mutations.puts(rows))
    held = contents(e)
    assert len(held) == 50 and contents(e) == held
    assert all(bytes(e.get(k, now=5)["value"]) == held[k] for k in (b"0", b"7", b"49"))
    e.write_all([mutations.puts(rows.where("id < 5").withColumn("value", F.lit(b"first"))), mutations.puts(rows.where("id < 3").withColumn("value", F.lit(b"second"))), mutations.deletes(rows.where("id = 0"))])
    assert contents(e) == {k: v for k, v in (held | {b"1": b"second", b"2": b"second", b"3": b"first", b"4": b"first"}).items() if k != b"0"}


def test_point_reads_prune(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=10))
    e.set("a1", "v" * 20), e.set("m1", "v" * 20), e.set("m2", "w")
    scan_ = e._log_of(b"m1")
    plan = scan_._jdf.queryExecution().toString()
    assert "EqualTo(key" in plan and len(scan_.inputFiles()) == 1  # of three tables one can hold the key
    assert bytes(e.get("m1", now=5)["value"]) == b"v" * 20 == bytes(e.get("m1", now=5)["value"]) and e._values.hits == 1


def test_bad_values_are_found(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=10, verify_checksum=True))
    e.set("sound", "x" * 20), e.set("bad", "y" * 20)
    fid = next(r["fid"] for r in e.value_log().collect() if bytes(r["key"]) == b"bad")
    folder = tmp_path / "db" / "vlog" / f"fid={fid}"
    spark.read.parquet(str(folder)).withColumn("value", F.lit(b"z" * 20)).write.parquet(str(tmp_path / "other"))
    for f in folder.iterdir():
        f.unlink()
    for f in (tmp_path / "other").iterdir():
        f.rename(folder / f.name)
    assert bytes(e.get("sound", now=5)["value"]) == b"x" * 20
    with pytest.raises(S.ChecksumMismatch):
        e.get("bad", now=5)
    with pytest.raises(S.ChecksumMismatch):
        contents(e)
    assert bytes(Engine(spark, str(tmp_path / "db")).get("bad", now=5)["value"]) == b"z" * 20


def test_levels_fill_and_flow(spark, tmp_path):
    options = S.EngineOptions(level0_tables=2, base_level_size=2000, base_table_size=1000, memtable_size=1000, max_levels=4, value_threshold=1 << 20, grace_seconds=0)
    e = Engine(spark, str(tmp_path / "db"), options)
    want = {}
    for n in range(4):
        rows = {f"k{(i * 7 + n) % 60:03d}": f"v{n}-{i}" * 5 for i in range(40)}
        e.write(mutations.puts(spark.createDataFrame([(k.encode(), v.encode()) for k, v in rows.items()], "key binary, value binary")))
        want |= {k.encode(): v.encode() for k, v in rows.items()}
    e.delete("k010")
    want.pop(b"k010", None)
    assert e.tables().count() == 5
    done = e.maintain(now=5)
    assert done["compactions"] >= 1 and contents(e) == want
    tables = e.tables().collect()
    lower = [t for t in tables if t["level"] > 0]
    assert len(lower) > 2 and sum(t["level"] == 0 for t in tables) < 2
    for level in {t["level"] for t in lower}:  # tables of a level do not overlap
        spans = sorted((bytes(t["min_key"]), bytes(t["max_key"])) for t in lower if t["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(t["size_bytes"] <= 4000 for t in lower) and e.compact_level(now=5) is None
    assert len(list((tmp_path / "db" / "tables").glob("*/table_id=*"))) == len(tables) and e.reconcile().isEmpty()
    with pytest.raises(S.KeyNotFound):
        e.get("k010", now=5)
    assert bytes(e.get("k011", now=5)["value"]) == want[b"k011"]


def test_maintenance_of_one_range_excludes_another(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=10))
    for i in range(3):
        e.set(f"key{i}", "v" * 30)
    number = e._claim()
    e._begin(number, {"levels": [0, 6], "lo": b"key1".hex(), "hi": b"key9".hex(), "bytes": 1})
    with pytest.raises(S.Rejected):
        e.compact(now=5)
    assert [tuple(r) for r in e.inflight().collect()] == [(0, 1)]
    other = e._claim()
    e._begin(other, {"levels": [1, 2], "lo": b"key1".hex(), "hi": b"key9".hex(), "bytes": 1})
    e._begin(e._claim(), {"levels": [0, 6], "lo": b"z".hex(), "hi": b"zz".hex(), "bytes": 1})
    e.unlock()
    e.compact(now=5)
    assert contents(e) == {f"key{i}".encode(): b"v" * 30 for i in range(3)} and e.tables().count() == 1
    with pytest.raises(S.Rejected):
        e._commit(e._claim(), [], [12345])
    old = Engine(spark, str(tmp_path / "db"))._claim()
    assert e._claim() == old + 1


def test_the_manifest_is_rewritten(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), S.EngineOptions(value_threshold=10, grace_seconds=0))
    for i in range(3):
        e.set(f"key{i}", "v" * 30)
    e.compact(now=5)
    before, live = e.changes().count(), e._live()
    assert not e.rewrite_manifest() and e.rewrite_manifest(force=True)
    assert e.changes().count() == len(live) < before and e._live() == live
    e.set("key9", "new")
    e.remove_orphans()
    assert [p.name for p in (tmp_path / "db").glob("manifest-*")] == [e._manifest()] != ["manifest-0"]
    assert contents(Engine(spark, str(tmp_path / "db"))) == {**{f"key{i}".encode(): b"v" * 30 for i in range(3)}, b"key9": b"new"}


def test_range_joins_bear_many_tables(spark):
    from pyspark.sql import functions as F

    n = 3000
    size = lambda i: 1 + i * 7919 % 50 if i % 1000 else 4000
    rows = [(i, i * 10, i * 10 + size(i)) for i in range(n)] + [(n, 500, 400), (n + 1, None, 5)]
    t = spark.createDataFrame(rows, "table_id long, min_key long, max_key long")
    pairs = ranges.overlap_pairs(t)
    sound = [r for r in rows if r[1] is not None]
    want = sorted((a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and a[1] <= b[2] and a[2] >= b[1])
    assert sorted(map(tuple, pairs.collect())) == want
    keys = spark.range(0, 10 * n, 3).select(F.col("id").alias("key")).union(spark.sql("SELECT CAST(NULL AS LONG)"))
    found = ranges.table_for_key(keys, t.where("table_id % 7 = 3"))
    held = [r for r in sound if r[0] % 7 == 3]
    assert sorted(map(tuple, found.collect())) == sorted((k, r[0]) for k in range(0, 10 * n, 3) for r in held if r[1] <= k <= r[2])
    for join in (pairs, found):  # one broadcast row of bounds apart, joins are by bucket
        plan = join._jdf.queryExecution().optimizedPlan().toString()
        assert any("bucket" in line and "Join Inner" in line for line in plan.splitlines()), plan
    assert ranges.overlap_pairs(t.limit(0)).count() == 0 and ranges.table_for_key(keys, t.limit(0)).count() == 0


def test_buckets_of_range_joins_hold_as_much_at_any_size(spark):
    from pyspark.sql import functions as F

    def load(n, every):
        near, at = ranges.bucketed(spark.range(n).selectExpr("id AS table_id", "id * 10 AS min_key", "id * 10 + id % 50 AS max_key"), (spark.range(0, 10 * n, every).toDF("key"), "key"))
        held, asked = near.groupBy("bucket").agg(F.count("*").alias("n")), at.groupBy("bucket").agg(F.count("*").alias("k"))
        return [r or 0 for r in held.join(asked, "bucket", "full").agg(F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.col("k"))).first()]

    for n in (50_000, 400_000):  # comparisons of pairs and of a key a table grow with the tables, not with their square
        pairs, looks = load(n, 10)
        assert pairs < 200 * n and looks < 200 * n, n
    near, _ = ranges.bucketed(spark.range(20_000).selectExpr("id AS table_id", "id AS min_key", "id + 20000 AS max_key"), (spark.range(5).toDF("key"), "key"))
    assert near.count() <= 6 * 20_000  # few keys: wide tables are not laid out over more buckets than there are keys


def test_place_among_sorted_bounds(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F

    rows = [([*range(0, 2 * n, 2)], k) for n in (0, 1, 2, 3, 7, 8, 9, 31) for k in range(-1, 2 * n + 2)]
    got = spark.createDataFrame(rows, "b array<long>, k long").select("b", "k", ranges._upto(F.col("b"), F.col("k"), 31).alias("n")).collect()
    assert all(r["n"] == bisect_right(r["b"], r["k"]) for r in got)


def test_range_joins_look_up_each_bucket_once(spark):
    import re

    t = spark.range(500).selectExpr("id AS table_id", "id * 10 AS min_key", "id * 10 + 25 AS max_key")
    for join in (ranges.overlap_pairs(t), ranges.table_for_key(spark.range(50).toDF("key"), t)):
        plan = join._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" in plan and not re.search(r"isnotnull\([^)]*aggregate\(", plan), plan
