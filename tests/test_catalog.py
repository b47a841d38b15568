"""Every query of the catalogue against its SQL in DuckDB, and streams against the batch."""

from pathlib import Path

import duckdb
import pytest

from kvlake.operators.state import winners
from kvlake.plans import catalog
from kvlake.streaming import upsert

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in catalog.SQL:
        assert rows
        return
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_streams_equal_the_batch(spark, tmp_path):
    rows = [(f"k{i % 7}", i % 13, i, "DEL" if i % 5 == 0 else "PUT", str(i)) for i in range(200)]
    schema = "key string, version long, seq long, op string, value string"
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    want = {tuple(r) for r in winners(spark.createDataFrame(rows, schema)).select("key", "version", "seq", "op", "value").collect()}
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    folded = run(upsert.fold(read(), ("op", "value")), "folded", "complete")
    assert {tuple(r) for r in folded.select("key", "version", "seq", "op", "value").collect()} == want
    out = run(upsert.stateful_fold(read()), "stateful", "update")
    assert {tuple(r) for r in winners(out).select("key", "version", "seq", "op", "value").collect()} == want


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    import datetime

    from kvlake.streaming.runner import Generations, folded_events

    def put(n, rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "sf" / "events.parquet" / f"part{n}"))
        for f in (tmp_path / "sf" / "events.parquet" / f"part{n}").glob("*.parquet"):
            f.rename(tmp_path / "sf" / "events.parquet" / f"{n}.parquet")

    at = lambda day: datetime.datetime(2024, 1, day)
    folder = str(tmp_path / "state")
    (tmp_path / "sf" / "events.parquet").mkdir(parents=True)
    put(1, [(1, at(1), 7, "view", 1.0), (2, at(2), 8, "view", 2.0), (3, at(5), 9, "view", 3.0)])
    first = folded_events(spark, str(tmp_path / "sf"), folder=folder)
    assert {r["key"]: r["event_id"] for r in first.collect()} == {"00000007": 1, "00000008": 2, "00000009": 3}
    put(2, [(4, at(3), 7, "error", 1.0), (5, at(4), 9, "view", 2.0)])
    again = folded_events(spark, str(tmp_path / "sf"), folder=folder)  # a new run: it knows only the folder
    want = {("00000007", 4, "DEL"), ("00000008", 2, "PUT"), ("00000009", 3, "PUT")}
    assert {tuple(r)[:3] for r in again.collect()} == want
    table = Generations(spark, f"{folder}/table")
    last = table._finished()[-1]
    log = spark.createDataFrame([("00000007", at(3), 4, "DEL", 1.0)], "key string, version timestamp_ntz, seq long, op string, value double")
    upsert.upsert_batches(table.read, table.write)(log, last)  # the last batch runs again
    assert {(r["key"], r["seq"]) for r in table.read().collect()} == {("00000007", 4), ("00000008", 2), ("00000009", 3)}
