"""Queries over the driver's tables, each with the same query in SQL.

Tables become mutation logs as follows. events: key is the padded user_id, order
is (ts, event_id), an `error` deletes. lineitem: key is (order, line). documents:
key is doc_id, texts of 1,024 bytes or more go to the value log. orders: a manifest, `F`
deletes a table, others create it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as fk
from ..functions import sketches
from ..operators import cache, compaction, manifest, merge, ranges, scan, state, valuelog
from ..schema import CREATE, DEL, DELETE, PUT

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = "2024-01-30 12:00:00"
AS_OF = "2024-01-15 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, version (ts), seq (event_id), op, value, event_type, expires_at (6 hours; sign-ups never)."""
    e = _t(spark, sf_dir, "events")
    return e.select(
        F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.col("ts").alias("version"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", DEL).otherwise(PUT).alias("op"), "value", "event_type",
        F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("expires_at"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.col("seq").alias("event_id"), "event_type", "value")


_LOG = """
WITH log AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, ts AS version, event_id AS seq, event_type, value,
         CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op,
         CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 6 HOUR END AS expires_at
  FROM events
), win AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM log) WHERE rn = 1
), live AS (SELECT * FROM win WHERE op = 'PUT')
"""
_SHOW = "SELECT key, seq AS event_id, event_type, value FROM "


# --- reads of the state


@query(_LOG + _SHOW + "live")
def kv_get_latest(spark, sf_dir):
    return _shown(state.live(events_log(spark, sf_dir)))


@query(_LOG.replace("FROM log)", f"FROM log WHERE version <= TIMESTAMP '{AS_OF}')") + _SHOW + "live")
def kv_as_of(spark, sf_dir):
    log = events_log(spark, sf_dir).where(F.col("version") <= _ntz(AS_OF))
    return _shown(state.live(log))


@query(_LOG + """, asked AS (SELECT o_orderkey, lpad(CAST(o_custkey % 200 AS VARCHAR), 8, '0') AS key, o_orderdate + INTERVAL 20 YEAR AS at FROM orders),
found AS (SELECT a.o_orderkey, a.key, l.seq, l.value, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY l.version DESC, l.seq DESC) AS r FROM asked a LEFT JOIN log l ON a.key = l.key AND l.version <= a.at)
SELECT o_orderkey, key, seq AS event_id, value FROM found WHERE r = 1""")
def kv_as_of_join(spark, sf_dir):
    """For each order the newest event of its user up to a time of its own."""
    at = F.col("o_orderdate") + F.expr("INTERVAL '20' YEAR")
    asked = _t(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_custkey") % 200).cast("string"), 8, "0").alias("key"), at.alias("at"))
    log = events_log(spark, sf_dir).select("key", "version", "seq", "value")
    return state.as_of_join(asked, log).select("o_orderkey", "key", F.col("seq").alias("event_id"), "value")


@query(_LOG + _SHOW + f"live WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'")
def kv_ttl_live(spark, sf_dir):
    rows = state.winners(events_log(spark, sf_dir))
    return _shown(rows.where((F.col("op") == PUT) & (F.col("expires_at").isNull() | (F.col("expires_at") > _ntz(NOW)))))


@query(_LOG + _SHOW + "live WHERE key = '00000042'")
def kv_point_get(spark, sf_dir):
    return _shown(scan.get(events_log(spark, sf_dir), "00000042"))


@query(_LOG + ", asked AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer) SELECT a.key, l.seq AS event_id, l.value, l.key IS NOT NULL AS found FROM asked a LEFT JOIN live l ON a.key = l.key")
def kv_multi_get(spark, sf_dir):
    asked = _t(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"))
    return scan.multi_get(events_log(spark, sf_dir), asked).select("key", F.col("seq").alias("event_id"), "value", "found")


@query(_LOG + _SHOW + "live WHERE key LIKE '0000001%'")
def kv_prefix_scan(spark, sf_dir):
    return _shown(scan.scan(events_log(spark, sf_dir), prefix="0000001", ordered=False))


@query(_LOG + _SHOW + "live WHERE key >= '00000020' AND key < '00000060'")
def kv_range_scan(spark, sf_dir):
    return _shown(scan.scan(events_log(spark, sf_dir), start="00000020", end="00000060", ordered=False))


@query(_LOG + _SHOW + "live WHERE key >= '00000050' ORDER BY key LIMIT 10")
def kv_seek(spark, sf_dir):
    return _shown(scan.scan(events_log(spark, sf_dir), start="00000050", limit=10))


@query(_LOG + _SHOW + "live WHERE key <= '00000099' ORDER BY key DESC LIMIT 25")
def kv_reverse_scan(spark, sf_dir):
    return _shown(scan.scan(events_log(spark, sf_dir), start="00000099", desc=True, limit=25))


@query(_LOG + _SHOW + "live ORDER BY key")
def kv_full_scan(spark, sf_dir):
    return _shown(scan.scan(events_log(spark, sf_dir)))


@query(_LOG + "SELECT key, min(seq) AS first_event, max(seq) AS last_event FROM live GROUP BY key HAVING key = (SELECT min(key) FROM live) OR key = (SELECT max(key) FROM live)")
def kv_first_last(spark, sf_dir):
    """Seek to the first and the last key."""
    live = state.live(events_log(spark, sf_dir))
    ends = live.orderBy("key").limit(1).unionByName(live.orderBy(F.desc("key")).limit(1)).distinct()
    return ends.select("key", F.col("seq").alias("first_event"), F.col("seq").alias("last_event"))


@query(_LOG + "SELECT key, seq AS event_id, op, age FROM (SELECT key, seq, op, CAST(row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS INTEGER) AS age FROM log)")
def kv_version_history(spark, sf_dir):
    return state.history(events_log(spark, sf_dir)).select("key", F.col("seq").alias("event_id"), "op", "age")


@query(_LOG + "SELECT key, seq AS event_id FROM win WHERE op = 'DEL'")
def kv_tombstones(spark, sf_dir):
    return state.tombstones(events_log(spark, sf_dir)).select("key", F.col("seq").alias("event_id"))


@query(_LOG + f"SELECT key, seq AS event_id FROM win WHERE op = 'PUT' AND expires_at <= TIMESTAMP '{NOW}'")
def kv_expired(spark, sf_dir):
    rows = state.winners(events_log(spark, sf_dir))
    return rows.where((F.col("op") == PUT) & (F.col("expires_at") <= _ntz(NOW))).select("key", F.col("seq").alias("event_id"))


@query(_LOG + "SELECT key, seq AS event_id, value FROM win")
def kv_max_by(spark, sf_dir):
    return state.winners_by_aggregate(events_log(spark, sf_dir), ("seq", "value")).select("key", F.col("seq").alias("event_id"), "value")


@query(_LOG + "SELECT (SELECT count(*) FROM live) AS entries, (SELECT count(*) FROM log) AS mutations, (SELECT count(*) FROM win WHERE op = 'DEL') AS tombstones, (SELECT min(key) FROM live) AS min_key, (SELECT max(key) FROM live) AS max_key, (SELECT CAST(sum(length(key)) AS BIGINT) FROM live) AS key_bytes")
def kv_stats(spark, sf_dir):
    log = events_log(spark, sf_dir)
    live = F.col("op") == PUT
    of_keys = state.winners(log).agg(
        F.count(F.when(live, 1)).alias("entries"), F.count(F.when(~live, 1)).alias("tombstones"),
        F.min(F.when(live, F.col("key"))).alias("min_key"), F.max(F.when(live, F.col("key"))).alias("max_key"),
        F.sum(F.when(live, F.octet_length("key")).cast("long")).alias("key_bytes"),
    )
    return of_keys.crossJoin(log.agg(F.count("*").alias("mutations")))  # one row each


# --- writes


@query(_LOG + """, base AS (SELECT *, 1 AS tier FROM log WHERE version < TIMESTAMP '2024-01-15'),
delta AS (SELECT *, 0 AS tier FROM log WHERE version >= TIMESTAMP '2024-01-15')
SELECT key, seq AS event_id, tier FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, version DESC, seq DESC) AS r FROM (SELECT * FROM base UNION ALL SELECT * FROM delta)
) WHERE r = 1 AND op <> 'DEL'""")  # fmt: skip
def kv_upsert_overlay(spark, sf_dir):
    log, half = events_log(spark, sf_dir), _ntz("2024-01-15 00:00:00")
    base, delta = log.where(F.col("version") < half), log.where(F.col("version") >= half)
    return merge.overlay(base, delta).select("key", F.col("seq").alias("event_id"), "tier")


@query(_LOG + _SHOW + "live WHERE key NOT IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer WHERE c_nationkey < 10)")
def kv_delete_overlay(spark, sf_dir):
    gone = _t(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"))
    return _shown(merge.delete_keys(state.live(events_log(spark, sf_dir)), gone))


@query(_LOG + _SHOW + "live WHERE key NOT LIKE '0000000%' AND key NOT LIKE '0000002%'")
def kv_drop_prefixes(spark, sf_dir):
    return _shown(state.live(merge.drop_prefixes(events_log(spark, sf_dir), ["0000000", "0000002"])))


@query("SELECT CAST(event_id // 1000 AS BIGINT) AS batch, count(*) AS rows, CAST(sum(strlen(props)) AS BIGINT) AS bytes, count(*) >= 1000 OR sum(strlen(props)) >= 65536 AS too_big FROM events GROUP BY 1")
def kv_batch_limits(spark, sf_dir):
    """Rows and bytes of write batches, and whether they reach the limits."""
    e = _t(spark, sf_dir, "events").withColumn("batch", F.floor(F.col("event_id") / 1000))
    r = e.groupBy("batch").agg(F.count("*").alias("rows"), F.sum(F.octet_length("props").cast("long")).alias("bytes"))
    return r.withColumn("too_big", (F.col("rows") >= 1000) | (F.col("bytes") >= 65536))


# --- merging and levels


@query(_LOG + "SELECT key, seq AS event_id, CAST(seq % 3 AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq % 3, version DESC, seq DESC) AS r FROM log) WHERE r = 1")
def lsm_merge_tiers(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return merge.merge([log.where(F.col("seq") % 3 == i) for i in range(3)]).select("key", F.col("seq").alias("event_id"), "tier")


@query(_LOG + _SHOW + "live WHERE key < '00000050' UNION ALL " + _SHOW + "live WHERE key >= '00000050'")
def lsm_concat_levels(spark, sf_dir):
    live = state.live(events_log(spark, sf_dir))
    return _shown(merge.concat([live.where(F.col("key") < "00000050"), live.where(F.col("key") >= "00000050")]))


def _event_tables(spark, sf_dir) -> DataFrame:
    """Events as rows of seven tables."""
    e = events_log(spark, sf_dir)
    return e.withColumn("table_id", F.col("seq") % 7).withColumn("value", F.col("event_type"))


_TABLES = "WITH rows AS (SELECT event_id % 7 AS table_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_type AS value, ts AS version, event_id AS seq FROM events)"


@query(_TABLES + " SELECT table_id, min(key) AS min_key, max(key) AS max_key, count(*) AS key_count, max(seq) AS max_version, CAST(sum(strlen(key) + strlen(value) + 8) AS BIGINT) AS size_bytes FROM rows GROUP BY table_id")
def lsm_table_stats(spark, sf_dir):
    return compaction.table_stats(_event_tables(spark, sf_dir).withColumn("version", F.col("seq")))


@query(_TABLES + " SELECT table_id, CAST(sum(CASE WHEN age > 1 THEN strlen(key) + strlen(value) + 8 ELSE 0 END) AS BIGINT) AS stale_bytes FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS age FROM rows) GROUP BY table_id")
def lsm_stale_bytes(spark, sf_dir):
    return compaction.stale_bytes(_event_tables(spark, sf_dir))


def _part_tables(spark, sf_dir) -> DataFrame:
    """Parts as table metadata: level, bytes, stale bytes, a key range that overlaps some neighbours."""
    return _t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("table_id"), (F.col("p_partkey") % 7).cast("int").alias("level"), (F.col("p_size").cast("long") * 1_000_000).alias("size_bytes"),
        (F.col("p_size").cast("long") * F.col("p_size") * 1000).alias("stale_bytes"), (F.col("p_partkey") * 10).alias("min_key"), (F.col("p_partkey") * 10 + F.col("p_size")).alias("max_key"),
        (F.col("p_partkey") * 7 % 101).alias("max_version"), (F.col("p_partkey") * 13 % 97).alias("created_at"),
    )


_PARTS = """WITH tables AS (
  SELECT p_partkey AS table_id, CAST(p_partkey % 7 AS INTEGER) AS level, CAST(p_size AS BIGINT) * 1000000 AS size_bytes, CAST(p_size AS BIGINT) * p_size * 1000 AS stale_bytes,
         p_partkey * 10 AS min_key, p_partkey * 10 + p_size AS max_key, p_partkey * 7 % 101 AS max_version, p_partkey * 13 % 97 AS created_at
  FROM part
)"""


@query(_PARTS + " SELECT level, count(*) AS tables, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(stale_bytes) AS BIGINT) AS stale_bytes FROM tables GROUP BY level")
def lsm_level_totals(spark, sf_dir):
    return compaction.level_totals(_part_tables(spark, sf_dir))


# The policy from its formulas: shares of the last level's bytes by powers of 10, base and table bytes from them.
_POLICY = _PARTS + """, size AS (SELECT l AS level, coalesce(CAST(sum(size_bytes) AS BIGINT), 0) AS s, count(table_id) AS n FROM (SELECT CAST(range AS INTEGER) AS l FROM range(0, 7)) LEFT JOIN tables ON level = l GROUP BY l),
shares AS (SELECT level, s, n, (SELECT s FROM size WHERE level = 6) // CAST(pow(10, 6 - level) AS BIGINT) AS share FROM size),
first AS (SELECT coalesce(max(level) FILTER (WHERE level > 0 AND share <= 10485760), 0) AS f FROM shares),
slid AS (SELECT f, greatest(f, coalesce((SELECT min(level) FROM size, first WHERE level > f AND level < 6 AND s > 0), 6) - 1) AS b0 FROM first),
based AS (SELECT f, CASE WHEN b0 < 6 AND (SELECT s FROM size WHERE level = b0) = 0 AND (SELECT s FROM size WHERE level = b0 + 1) < (SELECT greatest(share, 10485760) FROM shares WHERE level = b0 + 1) THEN b0 + 1 ELSE b0 END AS base FROM slid),
policy AS (SELECT level, s, n, CASE WHEN level > 0 THEN CAST(greatest(share, 10485760) AS BIGINT) END AS target, base, f FROM shares, based)
"""


@query(_POLICY + "SELECT level, target, CAST(CASE WHEN level = 0 THEN 67108864 ELSE 5242880 * pow(2, greatest(0, level - f)) END AS BIGINT) AS table_bytes, level = base AS is_base FROM policy")
def lsm_level_targets(spark, sf_dir):
    """Targets, table sizes and base level from the sizes of the levels."""
    return compaction.level_policy(_part_tables(spark, sf_dir)).select("level", "target", "table_bytes", "is_base")


_SCORES = _POLICY.rstrip() + """, scored AS (SELECT level, base, CASE WHEN level = 0 THEN n / 15.0::DOUBLE ELSE s::DOUBLE / target END AS score FROM policy),
damped AS (SELECT a.level, a.score, CASE WHEN a.score >= 1 AND b.score IS NOT NULL THEN a.score / greatest(b.score, 0.01::DOUBLE) ELSE a.score END AS adjusted
  FROM scored a LEFT JOIN scored b ON b.level = CASE WHEN a.level = 0 THEN a.base WHEN a.level >= a.base THEN a.level + 1 END)
"""


def _scores(spark, sf_dir) -> DataFrame:
    t = _part_tables(spark, sf_dir)
    return compaction.level_scores(t, compaction.level_policy(t))


def _nine_places(x: str):
    """As the SQL rounds: the scaled double. Spark's round(x, 9) rounds the decimal digits, which now and then differs."""
    return (F.round(F.col(x) * 1e9) / 1e9).alias(x)


@query(_SCORES + "SELECT level, round(score, 9) AS score, round(adjusted, 9) AS adjusted FROM damped")
def lsm_level_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("level", _nine_places("score"), _nine_places("adjusted"))


@query(_SCORES + "SELECT level, CAST(row_number() OVER (ORDER BY adjusted DESC, level) AS INTEGER) AS urgency FROM damped WHERE score >= 1 AND level < 6")
def lsm_due_levels(spark, sf_dir):
    """Levels to compact, most urgent first."""
    due = compaction.due(_scores(spark, sf_dir), 6)  # a row a level
    return due.select("level", F.row_number().over(Window.orderBy(F.desc("adjusted"), "level")).alias("urgency"))


@query(_PARTS + " SELECT a.table_id AS a, b.table_id AS b FROM tables a JOIN tables b ON a.table_id < b.table_id AND a.min_key <= b.max_key AND a.max_key >= b.min_key")
def lsm_overlap_pairs(spark, sf_dir):
    return ranges.overlap_pairs(_part_tables(spark, sf_dir))


@query(_PARTS + " SELECT level, CAST(min(min_key) AS BIGINT) AS min_key, CAST(max(max_key) AS BIGINT) AS max_key FROM tables GROUP BY level")
def lsm_key_ranges(spark, sf_dir):
    return ranges.key_range(_part_tables(spark, sf_dir), "level")


@query("SELECT event_id AS id, least(event_id % 17, event_id % 11) AS lo, greatest(event_id % 17 + 5, event_id % 11 + 3) AS hi, event_id % 17 <= event_id % 11 + 3 AND event_id % 17 + 5 >= event_id % 11 AS overlap FROM events")
def lsm_range_algebra(spark, sf_dir):
    """Union and overlap of pairs of ranges."""
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 17).alias("a"), (F.col("event_id") % 11).alias("b"))
    lo, hi = ranges.extend(F.col("a"), F.col("a") + 5, F.col("b"), F.col("b") + 3)
    return e.select("id", lo.alias("lo"), hi.alias("hi"), ranges.overlaps(F.col("a"), F.col("a") + 5, F.col("b"), F.col("b") + 3).alias("overlap"))


@query(_PARTS + " SELECT o_orderkey AS key, table_id FROM orders JOIN tables ON level = 3 AND o_orderkey BETWEEN min_key AND max_key")
def lsm_table_for_key(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return ranges.table_for_key(keys, _part_tables(spark, sf_dir).where("level = 3"))


@query(_PARTS + """, first AS (SELECT * FROM tables WHERE level = 1 ORDER BY max_version, table_id LIMIT 1)
SELECT table_id, level FROM first UNION ALL SELECT t.table_id, t.level FROM tables t, first f WHERE t.level = 2 AND t.min_key <= f.max_key AND t.max_key >= f.min_key""")
def lsm_pick_tables(spark, sf_dir):
    """The oldest table of level 1 and what it overlaps in level 2."""
    return compaction.pick(_part_tables(spark, sf_dir), 1, 2).select("table_id", "level")


@query(_PARTS + """, wide AS (SELECT * REPLACE (max_key + 60 AS max_key) FROM tables), z AS (SELECT *, max(max_key) OVER w AS hi, min(min_key) OVER w AS lo FROM wide WHERE level = 0 WINDOW w AS (ORDER BY table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
top AS (SELECT * FROM z WHERE table_id < coalesce((SELECT min(table_id) FROM z WHERE min_key > hi OR max_key < lo), 1e18::BIGINT))
SELECT table_id, level FROM top UNION ALL SELECT t.table_id, t.level FROM wide t WHERE level = 3 AND min_key <= (SELECT max(max_key) FROM top) AND max_key >= (SELECT min(min_key) FROM top)""")
def lsm_fill_level0(spark, sf_dir):
    """Overlapping tables of level 0 from the oldest on, and what they overlap in level 3; ranges are widened so that some overlap."""
    wide = _part_tables(spark, sf_dir).withColumn("max_key", F.col("max_key") + 60)
    return compaction.fill_level0(wide, 3).select("table_id", "level")


@query(_PARTS + """, first AS (SELECT * FROM tables WHERE level = 6 AND stale_bytes >= 1000000 AND created_at <= 80 ORDER BY stale_bytes DESC, table_id LIMIT 1),
after AS (SELECT t.*, f.size_bytes + sum(t.size_bytes) OVER (ORDER BY t.min_key, t.table_id) AS total FROM tables t, first f WHERE t.level = 6 AND t.min_key > f.min_key)
SELECT table_id FROM first UNION ALL SELECT table_id FROM after WHERE total < 200000000""")
def lsm_fill_last(spark, sf_dir):
    """The most stale table of the last level and those after it, up to 200 MB together."""
    return compaction.fill_last(_part_tables(spark, sf_dir), 6, 200_000_000, min_stale=1_000_000, created_before=80).select("table_id")


@query(_PARTS + """, n AS (SELECT *, row_number() OVER (ORDER BY min_key, table_id) - 1 AS spot, greatest(3, CAST(ceil(count(*) OVER () / 5.0) AS BIGINT)) AS width FROM tables WHERE level = 5),
p AS (SELECT CAST(spot // width AS INTEGER) AS part, max(max_key) AS upto FROM n GROUP BY 1)
SELECT part, lag(upto) OVER (ORDER BY part) AS after, CASE WHEN lead(part) OVER (ORDER BY part) IS NOT NULL THEN upto END AS upto FROM p""")
def lsm_split_at_tables(spark, sf_dir):
    return compaction.split_at_tables(_part_tables(spark, sf_dir).where("level = 5"))


@query(_PARTS + " SELECT DISTINCT t.table_id FROM tables t JOIN tables u ON t.level = 4 AND u.level > 4 AND t.min_key <= u.max_key AND t.max_key >= u.min_key")
def lsm_overlapped_below(spark, sf_dir):
    """Tables of level 4 that lower levels overlap."""
    return ranges.overlapped_below(_part_tables(spark, sf_dir), 4).select("table_id")


@query(_PARTS + ", small AS (SELECT * FROM tables WHERE level = 0 AND size_bytes < 20000000 AND created_at < 60) SELECT table_id FROM small WHERE (SELECT count(*) FROM small) >= 4")
def lsm_pick_level0(spark, sf_dir):
    return compaction.pick_level0(_part_tables(spark, sf_dir), max_bytes=20_000_000, created_before=60).select("table_id")


@query(_PARTS + " SELECT table_id, stale_bytes FROM tables WHERE level = 6 AND stale_bytes >= 1000000 AND created_at <= 80 ORDER BY stale_bytes DESC, table_id")
def lsm_pick_stale(spark, sf_dir):
    return compaction.pick_stale(_part_tables(spark, sf_dir), level=6, min_stale=1_000_000, created_before=80).select("table_id", "stale_bytes")


@query(_PARTS + " SELECT table_id, level, size_bytes FROM tables WHERE level <> 2 OR table_id % 2 = 0 UNION ALL SELECT table_id + 100000, 2, size_bytes FROM tables WHERE level = 1")
def lsm_replace_tables(spark, sf_dir):
    t = _part_tables(spark, sf_dir).select("table_id", "level", "size_bytes")
    gone = t.where("level = 2 AND table_id % 2 = 1")
    new = t.where("level = 1").select((F.col("table_id") + 100_000).alias("table_id"), F.lit(2).alias("level"), "size_bytes")
    return merge.replace_tables(t, gone, new)


_LINES = """WITH win AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1
)"""


def _lines_log(spark, sf_dir) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return line.select(
        F.struct("l_orderkey", "l_linenumber").alias("key"), F.col("l_shipdate").alias("version"), F.struct(*rest).alias("seq"),
        F.when(F.col("l_returnflag") == "R", DEL).otherwise(PUT).alias("op"), F.col("l_quantity").alias("value"), F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )


@query(_LINES + " SELECT l_orderkey, l_linenumber, l_quantity FROM win")
def lsm_compact_upper(spark, sf_dir):
    """Compaction above the bottom: tombstones stay."""
    r = compaction.compact(_lines_log(spark, sf_dir), bottom=False)
    return r.select("key.l_orderkey", "key.l_linenumber", F.col("value").alias("l_quantity"))


@query(_LINES + " SELECT l_orderkey, l_linenumber, l_quantity FROM win WHERE l_returnflag <> 'R'")
def lsm_compact_result(spark, sf_dir):
    r = compaction.compact(_lines_log(spark, sf_dir))
    return r.select("key.l_orderkey", "key.l_linenumber", F.col("value").alias("l_quantity"))


@query("SELECT CAST(part AS INTEGER) AS part, min(key) AS lo, max(key) AS hi, count(*) AS n FROM (SELECT key, ntile(5) OVER (ORDER BY key) AS part FROM (SELECT DISTINCT l_orderkey AS key FROM lineitem)) GROUP BY part")
def lsm_split_ranges(spark, sf_dir):
    return ranges.split(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), 5)


# --- manifest


def _changes(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderdate").alias("set_id"), F.col("o_orderkey").alias("change_no"), F.col("o_custkey").alias("table_id"), F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(CREATE).alias("op"), (F.col("o_orderkey") % 7).cast("int").alias("level"))


_CHANGES = "WITH changes AS (SELECT o_orderdate AS set_id, o_orderkey AS change_no, o_custkey AS table_id, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'CREATE' END AS op, CAST(o_orderkey % 7 AS INTEGER) AS level FROM orders), folded AS (SELECT table_id, level FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY set_id DESC, change_no DESC) AS rn FROM changes) WHERE rn = 1 AND op = 'CREATE')"


@query(_CHANGES + " SELECT table_id, level FROM folded")
def manifest_live(spark, sf_dir):
    return manifest.fold(_changes(spark, sf_dir))


@query(_CHANGES + " SELECT table_id, 'missing' AS state FROM folded WHERE table_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) UNION ALL SELECT c_custkey, 'orphan' FROM customer WHERE c_nationkey <> 3 AND c_custkey NOT IN (SELECT table_id FROM folded)")
def manifest_reconcile(spark, sf_dir):
    files = _t(spark, sf_dir, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("table_id"))
    return manifest.reconcile(manifest.fold(_changes(spark, sf_dir)), files)


@query(_CHANGES + ", lagged AS (SELECT *, lag(op) OVER (PARTITION BY table_id ORDER BY set_id, change_no) AS before FROM changes) SELECT table_id, change_no, CASE WHEN op = 'CREATE' THEN 'exists' ELSE 'unknown' END AS fault FROM lagged WHERE op = coalesce(before, 'DELETE')")
def manifest_faults(spark, sf_dir):
    return manifest.faults(_changes(spark, sf_dir)).select("table_id", "change_no", "fault")


@query(_PARTS + " SELECT table_id + 100000 AS table_id, 'CREATE' AS op, 2 AS level FROM tables WHERE level = 1 UNION ALL SELECT table_id, 'DELETE', NULL FROM tables WHERE level IN (1, 2)")
def manifest_change_set(spark, sf_dir):
    t = _part_tables(spark, sf_dir)
    new = t.where("level = 1").select((F.col("table_id") + 100_000).alias("table_id"), F.lit(2).alias("level"))
    return manifest.change_set(new, t.where("level IN (1, 2)"))


# --- value log

_DOCS = """WITH vlog AS (
  SELECT doc_id, md5(text) AS digest, doc_id % 8 AS fid, CAST(octet_length(encode(text)) AS BIGINT) AS len,
         CAST(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - octet_length(encode(text)) AS BIGINT) AS "offset"
  FROM documents WHERE octet_length(encode(text)) >= 1024
)"""


def _separated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    return valuelog.separate(d, fid=F.col("key") % 8)


@query("SELECT doc_id AS key, octet_length(encode(text)) >= 1024 AS is_ptr, CASE WHEN octet_length(encode(text)) < 1024 THEN md5(text) END AS inline FROM documents")
def vlog_separate(spark, sf_dir):
    rows, _ = _separated(spark, sf_dir)
    return rows.select("key", F.col("vptr").isNotNull().alias("is_ptr"), F.md5("value").alias("inline"))


@query(_DOCS + ' SELECT doc_id AS key, fid, "offset", len FROM vlog')
def vlog_pointers(spark, sf_dir):
    rows, _ = _separated(spark, sf_dir)
    return rows.where("vptr IS NOT NULL").select("key", "vptr.fid", "vptr.offset", "vptr.len")


@query("SELECT doc_id AS key, md5(text) AS digest FROM documents")
def vlog_resolve(spark, sf_dir):
    rows, log = _separated(spark, sf_dir)
    return valuelog.resolve(rows, log).select("key", F.md5("value").alias("digest"))


def _value_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as value-log records; rows of documents of three languages still point at them."""
    _, log = _separated(spark, sf_dir)
    d = _t(spark, sf_dir, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("key"))
    current = log.join(d, "key", "left_semi").select("key", F.struct("fid", "offset", "len").alias("vptr"))
    return log, current


_GC = _DOCS + ", marked AS (SELECT v.*, d.lang <> 'en' AS live FROM vlog v JOIN documents d USING (doc_id)), stats AS (SELECT fid, CAST(sum(len) AS BIGINT) AS total, CAST(sum(CASE WHEN live THEN 0 ELSE len END) AS BIGINT) AS discard FROM marked GROUP BY fid)"


@query(_GC + " SELECT fid, total, discard FROM stats")
def vlog_discard_stats(spark, sf_dir):
    return valuelog.discard_stats(*_value_log(spark, sf_dir))


@query(_GC + " SELECT fid, discard FROM stats WHERE discard > 0 AND discard >= total * 0.5 ORDER BY discard DESC, fid LIMIT 1")
def vlog_gc_candidate(spark, sf_dir):
    return valuelog.gc_candidate(valuelog.discard_stats(*_value_log(spark, sf_dir)), 0.5).select("fid", "discard")


@query(_GC + ' SELECT doc_id AS key, fid, "offset" FROM marked WHERE live')
def vlog_gc_live(spark, sf_dir):
    return valuelog.live_records(*_value_log(spark, sf_dir)).select("key", "fid", "offset")


@query(_GC + " SELECT '{' || string_agg('\"' || fid || '\":' || discard, ',' ORDER BY CAST(fid AS VARCHAR)) || '}' AS stats FROM stats")
def vlog_discard_json(spark, sf_dir):
    return valuelog.discard_json(valuelog.discard_stats(*_value_log(spark, sf_dir)))


@query("SELECT doc_id AS key FROM documents WHERE doc_id % 5 = 0 OR octet_length(encode(text)) < 1024")
def vlog_discardable(spark, sf_dir):
    """Log entries that hold no live pointer: deleted (each fifth), or inline by now."""
    rows, _ = _separated(spark, sf_dir)
    return rows.where((F.col("key") % 5 == 0) | F.col("vptr").isNull()).select("key")


# --- caches and sketches


@query("SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, count(*) AS hits FROM events GROUP BY 1")
def cache_key_freq(spark, sf_dir):
    return cache.key_frequency(events_log(spark, sf_dir))


@query("SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, count(*) AS hits FROM events GROUP BY 1 ORDER BY hits DESC, key LIMIT 10")
def cache_hot_keys(spark, sf_dir):
    return cache.hot_keys(events_log(spark, sf_dir), 10)


@query("WITH f AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, count(*) AS hits FROM events GROUP BY 1) SELECT key, hits FROM f WHERE key >= '00000020' AND hits > 1 AND hits > (SELECT coalesce(min(hits), 0) FROM f WHERE key < '00000020')")
def cache_admission(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return cache.admitted(log, log.where(F.col("key") < "00000020").select("key").distinct())


@query("WITH g AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT key, count(gap) AS again, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap FROM g GROUP BY key")
def cache_reaccess(spark, sf_dir):
    return cache.reaccess(events_log(spark, sf_dir), "seq")


# Three numbers of 32 bits from a key's MD5.
_HALVES = "CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(md5(key), 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(md5(key), 17, 8) AS BIGINT) AS h3"
_COUNTERS = f"""WITH f AS (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, count(*) AS n FROM events GROUP BY 1), h AS (SELECT *, {_HALVES} FROM f),
placed AS (SELECT key, n, CAST(i AS INTEGER) AS i, (h1 + i * h2) % 512 AS slot FROM h, range(0, 4) t(i)), total AS (SELECT i, slot, CAST(sum(n) AS BIGINT) AS t FROM placed GROUP BY i, slot)
"""


@query(_COUNTERS + "SELECT key, min(t) AS estimate FROM placed JOIN total USING (i, slot) GROUP BY key")
def cache_count_min(spark, sf_dir):
    """Estimates are never below the true counts."""
    return sketches.count_min_estimates(events_log(spark, sf_dir), "key", width=512)


@query(_COUNTERS + "SELECT key, min(least(t, 15)) AS estimate FROM placed JOIN total USING (i, slot) GROUP BY key")
def cache_count_min4(spark, sf_dir):
    """The same with counters of four bits, which stick at 15."""
    return sketches.count_min_estimates(events_log(spark, sf_dir), "key", width=512, most=15)


@query(f"""WITH keys AS (SELECT DISTINCT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events), sizes AS (SELECT greatest(64, count(*) * 10) AS bits FROM keys),
shape AS (SELECT CAST(ceil(bits / 1048576.0) AS BIGINT) AS parts, CAST(ceil(bits / ceil(bits / 1048576.0)) AS BIGINT) AS own FROM sizes),
h AS (SELECT key, {_HALVES} FROM keys), held AS (SELECT DISTINCT h3 % parts AS part, (h1 + i * h2) % own AS place FROM h, shape, range(0, 6) t(i)),
p AS (SELECT key, {_HALVES} FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)),
probe AS (SELECT key, h3 % parts AS part, (h1 + i * h2) % own AS place FROM p, shape, range(0, 6) t(i))
SELECT key FROM probe LEFT JOIN held USING (part, place) GROUP BY key HAVING count(*) = count(held.place)""")
def bloom_prune(spark, sf_dir):
    """Keys of customers that the Bloom filter of event keys lets pass; it is sized for the keys there are."""
    keys = events_log(spark, sf_dir).select("key").distinct()
    bits, k = sketches.bloom_bits(keys.count(), 0.01), sketches.bloom_hashes(sketches.bloom_bits_per_key(0.01))
    built = sketches.bloom_filter(keys, "key", bits=bits, hashes=k)
    probe = _t(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("key"))
    return sketches.might_contain(probe, "key", built, bits=bits, hashes=k).where("might_contain").select("key")


# --- functions


@query("SELECT event_id, hex(encode(lpad(CAST(user_id AS VARCHAR), 8, '0'))) || upper(lpad(format('{:x}', 18446744073709551615::HUGEINT - event_id), 16, '0')) AS internal, lpad(CAST(user_id AS VARCHAR), 8, '0') AS user_key, event_id AS version FROM events")
def fn_internal_keys(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", fk.internal_key(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.col("event_id")).alias("k"))
    return e.select("event_id", F.hex("k").alias("internal"), fk.user_key(F.col("k")).cast("string").alias("user_key"), fk.key_version(F.col("k")).alias("version"))


@query("SELECT doc_id, CAST(strlen(CAST(doc_id AS VARCHAR)) + CASE WHEN octet_length(encode(text)) < 1024 THEN octet_length(encode(text)) ELSE 12 END + 2 AS BIGINT) AS size FROM documents")
def fn_entry_size(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", fk.entry_size(F.col("doc_id").cast("string"), F.col("text"), 1024).alias("size"))


@query("SELECT event_id, CASE WHEN event_id < 100000 THEN lpad(CAST(event_id AS VARCHAR), 5, '0') ELSE CAST(event_id AS VARCHAR) END || '.vlog' AS name, event_id AS fid FROM events")
def fn_file_names(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", fk.file_name(F.col("event_id"), "vlog").alias("name"))
    return e.withColumn("fid", fk.file_id(F.concat(F.lit("/data/"), "name")))


@query("SELECT event_id, CAST(greatest(1, (length(bin(event_id)) + 6) // 7) AS INTEGER) AS size, CASE WHEN event_id <= 1 THEN 1 ELSE CAST(pow(2, length(bin(event_id - 1))) AS BIGINT) END AS pow2 FROM events")
def fn_sizes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", fk.uvarint_size(F.col("event_id")).alias("size"), fk.next_power_of_two(F.col("event_id")).alias("pow2"))


@query("SELECT p_partkey, upper(lpad(format('{:x}', p_partkey), 16, '0')) AS be, p_partkey AS back FROM part")
def fn_big_endian(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", fk.big_endian(F.col("p_partkey")).alias("b"))
    return p.select("p_partkey", F.hex("b").alias("be"), fk.from_big_endian(F.col("b")).alias("back"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, floor(epoch(ts)) <= 1705276800 AS expired FROM events")
def fn_epoch(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("seconds", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
    return e.select("event_id", "seconds", (F.col("seconds") <= 1705276800).alias("expired"))


@query("SELECT p_partkey, CAST(len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: p_name[1:i] = p_type[1:i])) AS INTEGER) AS shared FROM part")
def fn_common_prefix(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", fk.common_prefix(F.col("p_name"), F.col("p_type")).alias("shared"))


_CODES = "list_transform(string_split(p_name, ''), lambda c: CAST(ord(c) AS UBIGINT))"


@query(f"""WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 2197175160))) AS crc)
SELECT p_partkey, CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {_CODES}), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS crc FROM part, t""")
def fn_crc32c(spark, sf_dir):
    d = _t(spark, sf_dir, "part")
    return d.select("p_partkey", sketches.crc32c(F.col("p_name")).alias("crc"))


@query(f"""WITH b AS (SELECT p_partkey, {_CODES} AS b, CAST(length(p_name) AS UBIGINT) AS n FROM part),
w AS (SELECT p_partkey, b, n, list_transform(range(0, CAST(n // 4 AS BIGINT)), lambda i: b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216) AS words,
  list_reduce(list_concat([CAST(0 AS UBIGINT)], list_transform(range(0, CAST(n % 4 AS BIGINT)), lambda i: b[CAST(n - n % 4 AS BIGINT) + i + 1] * CAST(pow(256, i) AS UBIGINT))), lambda x, y: x + y) AS rest FROM b),
h AS (SELECT p_partkey, n, rest, list_reduce(list_concat([CAST(xor(3164544308, n * 3332679571 % 4294967296) AS UBIGINT)], words), lambda h, x: xor((h + x) % 4294967296 * 3332679571 % 4294967296, ((h + x) % 4294967296 * 3332679571 % 4294967296) >> 16)) AS h FROM w),
l AS (SELECT p_partkey, n, h, (h + rest) % 4294967296 * 3332679571 % 4294967296 AS x FROM h)
SELECT p_partkey, CAST(CASE WHEN n % 4 = 0 THEN h ELSE xor(x, x >> 24) END AS BIGINT) AS hash FROM l""")
def fn_hash32(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", sketches.hash32(F.col("p_name")).alias("hash"))


@query("SELECT event_id, array_to_string(list_transform(range(0, greatest(1, (length(bin(event_id * 1000)) + 6) // 7)), lambda i: upper(lpad(format('{:x}', ((event_id * 1000) >> CAST(7 * i AS INTEGER)) & 127 | CASE WHEN i < greatest(1, (length(bin(event_id * 1000)) + 6) // 7) - 1 THEN 128 ELSE 0 END), 2, '0'))), '') AS code, event_id * 1000 AS back FROM events")
def fn_uvarint(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", fk.uvarint(F.col("event_id") * 1000).alias("b"))
    return e.select("event_id", F.hex("b").alias("code"), fk.from_uvarint(F.col("b")).alias("back"))


@query("SELECT p_partkey, upper(lpad(format('{:x}', strlen(p_name)), 8, '0')) || hex(encode(p_name)) AS slice, p_name AS back FROM part")
def fn_byte_slices(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", fk.byte_slice(F.col("p_name")).alias("b"))
    return p.select("p_partkey", F.hex("b").alias("slice"), fk.from_byte_slice(F.col("b")).cast("string").alias("back"))


@query("SELECT event_id, CAST(strlen(props) + greatest(1, (length(bin(event_id * 100)) + 6) // 7) + 1 AS BIGINT) AS stored, CAST(strlen(event_type) + strlen(props) + 33 AS BIGINT) AS logged, CAST(strlen(event_type) + strlen(props) + 25 AS BIGINT) AS asked FROM events")
def fn_record_sizes(spark, sf_dir):
    key, value = F.col("event_type"), F.col("props")
    return _t(spark, sf_dir, "events").select("event_id", fk.encoded_size(value, F.col("event_id") * 100).alias("stored"), fk.log_record_size(key, value).alias("logged"), fk.request_size(key, value).alias("asked"))


# --- streaming


@query(_LOG + "SELECT key, seq AS event_id, op, value FROM win")
def stream_upsert(spark, sf_dir):
    """The events read as a stream and folded; the final state as a batch."""
    from ..streaming.runner import folded_events

    return folded_events(spark, sf_dir)
