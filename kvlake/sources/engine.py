"""A store in a folder: tables of mutations, a value log, a manifest.

Layout: `tables/<claim>/table_id=<id>` (Parquet, sorted by key), `vlog/fid=<fid>` (Parquet, by offset, about value_log_file_size each),
`manifest-<n>` (Parquet, one file a change set; `CURRENT` names the one in use), `claims/<n>` (numbers taken), `running/<n>` (maintenance under way).

A write takes a number that is its own (the file is created exclusively), keeps its batch once in `staging`, so that all it
writes comes from the same rows, makes new files, and appends one change set, which is the commit. Readers see what the
manifest's fold names. Files are never changed, and what nothing names is deleted after a grace, so a reader that has begun keeps a
consistent state. Writers do not disturb each other; maintenance that touches the key range or file of another is rejected.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from functools import wraps

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import cache, compaction, manifest, scan, state, valuelog
from ..schema import CREATE, DELETE, MUTATION_LOG, TABLE_LOG, TABLE_META, VALUE_LOG, ChecksumMismatch, Closed, EngineOptions, KeyNotFound, NoRewrite, Rejected
from . import log as mutations

#: Tables and value-log files of a claim at most, and where the ids of the latter begin.
_PIECES = 1 << 20
_VLOG_ID = 1 << 61
_KEY_BLOOM = {"parquet.bloom.filter.enabled#key": "true"}


def _bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _maintenance(f: Callable) -> Callable:
    """Afterwards: files that nothing names and that are old enough go, and the manifest is rewritten if it is due."""

    @wraps(f)
    def run(self: Engine, *args: object, **options: object) -> object:
        out = f(self, *args, **options)
        self.rewrite_manifest()
        self.remove_orphans()
        return out

    return run


class Engine:
    """open, set, delete, get, scan, info, compact, compact_level, run_value_log_gc, maintain, close."""

    def __init__(self, spark: SparkSession, path: str, options: EngineOptions = EngineOptions()) -> None:
        self.spark, self.path, self.options, self.closed = spark, path.rstrip("/"), options, False
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)
        self._values = cache.TinyLfu(options.cached_values)
        for folder in ("tables", "vlog", "claims", "running"):
            self._fs.mkdirs(self._path(folder))
        if not self._fs.exists(self._path("HEADER.json")):
            self._put("HEADER.json", {"magic": manifest.MAGIC, "version": manifest.VERSION})
        got = self._json("HEADER.json")
        manifest.check_header(got.get("magic"), got.get("version"), 0, 0)

    # files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _put(self, name: str, value: object) -> None:
        """A new small file; an error if it exists."""
        out = self._fs.create(self._path(name), False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _json(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since it was written) of what is in a folder."""
        path = self._path(folder)
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _claim(self) -> int:
        """A number that no other writer has or will get."""
        taken = [int(n) for n, _ in self._names("claims") if n.isdigit()]
        try:
            self._put(f"claims/{max(taken, default=0) + 1}", {})
        except Py4JJavaError as e:
            raise Rejected("another writer took the number just now; try again") from e
        return max(taken, default=0) + 1

    # the manifest

    def _manifest(self) -> str:
        return self._json("CURRENT")["manifest"] if self._fs.exists(self._path("CURRENT")) else "manifest-0"

    def changes(self) -> DataFrame:
        name = self._manifest()
        if not self._fs.exists(self._path(name)):
            return self.spark.createDataFrame([], TABLE_LOG)
        return self.spark.read.schema(TABLE_LOG).parquet(f"{self.path}/{name}")

    def _live(self) -> list[Row]:
        """The live tables and value-log files: metadata, one row each."""
        if self.closed:
            raise Closed("the engine is closed")
        return manifest.checked_fold(self.changes()).orderBy("table_id").collect()

    def tables(self) -> DataFrame:
        """table_id, level, min_key, max_key, key_count, size_bytes, stale_bytes, max_version, created_at of the live tables."""
        return manifest.fold(self.changes()).where(F.col("table_id") < _VLOG_ID)

    def _commit(self, set_id: int, new: list[tuple], gone: Sequence[int]) -> None:
        """new: (table_id, level, metadata) of tables and value-log files."""
        if gone and not set(gone) <= {r["table_id"] for r in self._live()}:
            raise Rejected("what was to be replaced is no longer live")
        none = (None,) * len(TABLE_META)
        rows = [(set_id, i, t, CREATE, level, *(meta or none)) for i, (t, level, meta) in enumerate(new)]
        rows += [(set_id, len(new) + i, t, DELETE, None, *none) for i, t in enumerate(gone)]
        self.spark.createDataFrame(rows, TABLE_LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/{self._manifest()}")

    def rewrite_manifest(self, force: bool = False) -> bool:
        """A manifest that is mostly deletions is replaced by one set that creates what is live."""
        n = self.changes().agg(F.count_if(F.col("op") == CREATE).alias("c"), F.count_if(F.col("op") == DELETE).alias("d")).first()
        if not force and not manifest.rewrite_due(n["c"], n["d"]):
            return False
        before, number = self._manifest(), self._claim()
        manifest.snapshot(self.changes()).coalesce(1).write.parquet(f"{self.path}/manifest-{number}")
        if self._manifest() != before:
            raise Rejected("another writer has rewritten the manifest")
        self._put(f"CURRENT-{number}", {"manifest": f"manifest-{number}"})
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("CURRENT").toUri(), self._conf)
        context.rename(self._path(f"CURRENT-{number}"), self._path("CURRENT"), how)
        return True

    def _folders(self) -> list[tuple[int, str, float]]:
        """(id, folder, seconds since it was written) of all tables and value-log files there are; a claim without tables counts as its first."""
        out = []
        for claim, age in self._names("tables"):
            if claim.isdigit():
                held = [(n, a) for n, a in self._names(f"tables/{claim}") if n.startswith("table_id=")]
                out += [(int(n.partition("=")[2]), f"tables/{claim}/{n}", a) for n, a in held] or [(int(claim) * _PIECES, f"tables/{claim}", age)]
        out += [(int(n.partition("=")[2]), f"vlog/{n}", a) for n, a in self._names("vlog") if n.startswith("fid=")]
        return out

    def reconcile(self) -> DataFrame:
        """Tables and value-log files that are missing, and folders that no change knows."""
        files = self.spark.createDataFrame([(i,) for i, _, _ in self._folders()], "table_id long")
        return manifest.reconcile(manifest.fold(self.changes()), files)

    def remove_orphans(self, grace_seconds: int | None = None) -> int:
        """Deletes what nothing names and is older than the grace: left by a crash, or dropped by maintenance. How many folders."""
        grace = self.options.grace_seconds if grace_seconds is None else grace_seconds
        live = {r["table_id"] for r in self._live()}
        gone = [f for i, f, age in self._folders() if i not in live and age >= grace]
        current = self._manifest()
        gone += [n for n, age in self._names("") if n.startswith(("manifest-", "CURRENT-")) and n != current and age >= grace]
        gone += [f"staging/{n}" for n, age in self._names("staging") if age >= grace]
        for f in gone:
            self._fs.delete(self._path(f), True)
        return len(gone)

    # reading

    def _rows(self, ids: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/tables/{i // _PIECES}/table_id={i}" for i in ids]
        return self.spark.read.schema(MUTATION_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], MUTATION_LOG)

    def log(self) -> DataFrame:
        """All mutations of the live tables."""
        return self._rows(r["table_id"] for r in self._live() if r["table_id"] < _VLOG_ID)

    def _log_of(self, key: bytes) -> DataFrame:
        """The mutations of the tables whose range holds a key."""
        return self._rows(r["table_id"] for r in self._live() if r["table_id"] < _VLOG_ID and (r["min_key"] is None or bytes(r["min_key"]) <= key <= bytes(r["max_key"]))).where(F.col("key") == F.lit(bytearray(key)))

    def value_log(self) -> DataFrame:
        paths = [f"{self.path}/vlog/fid={r['table_id']}" for r in self._live() if r["table_id"] >= _VLOG_ID]
        return self.spark.read.schema(VALUE_LOG).option("basePath", f"{self.path}/vlog").parquet(*paths) if paths else self.spark.createDataFrame([], VALUE_LOG)

    def state(self, as_of: int | None = None, now: int | None = None) -> DataFrame:
        """key, version, value, expires_at of visible keys; now: epoch seconds. Values are checked as they are resolved if the options say so."""
        live = _visible(state.winners(self.log(), as_of), now)
        return valuelog.resolve(live, self.value_log(), verify=self.options.verify_checksum).select("key", "version", "value", "expires_at")

    def get(self, key: bytes | str, as_of: int | None = None, now: int | None = None) -> Row:
        """The visible row of a key; KeyNotFound else. Of the value log the row group with the record is read, unless the value is cached."""
        scan._checked(key)
        row = _visible(state.winners(self._log_of(_bytes(key)), as_of), now).first()
        if row is None:
            raise KeyNotFound(repr(key))
        value = row["value"]
        if row["vptr"] is not None:
            value = self._value(row["vptr"]["fid"], row["vptr"]["offset"])
        return Row(key=row["key"], version=row["version"], value=value, expires_at=row["expires_at"])

    def _value(self, fid: int, offset: int) -> bytearray:
        held = self._values.get((fid, offset))
        if held is None:
            one = self.spark.read.schema(VALUE_LOG).option("basePath", f"{self.path}/vlog").parquet(f"{self.path}/vlog/fid={fid}").where(F.col("offset") == offset)
            r = one.select("value", (F.crc32("value") == F.col("checksum")).alias("sound")).first()
            if r is None or (self.options.verify_checksum and not r["sound"]):
                raise ChecksumMismatch(f"value-log record {fid}/{offset}")
            held = r["value"]
            self._values.set((fid, offset), held)
        return held

    def multi_get(self, keys: DataFrame, now: int | None = None) -> DataFrame:
        """A row for each of `keys` (column key, binary), with found."""
        live = self.state(now=now).withColumn("found", F.lit(True))
        return keys.join(live, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def scan(self, *, prefix: bytes | str | None = None, start: bytes | str | None = None, end: bytes | str | None = None, desc: bool = False, limit: int | None = None, now: int | None = None) -> DataFrame:
        """Visible rows in key order."""
        rows = self.state(now=now)
        lit = lambda x: F.lit(bytearray(_bytes(x)))
        if prefix is not None:
            rows = rows.where(F.col("key").startswith(lit(prefix)))
        if start is not None:
            rows = rows.where(F.col("key") <= lit(start) if desc else F.col("key") >= lit(start))
        if end is not None:
            rows = rows.where(F.col("key") > lit(end) if desc else F.col("key") < lit(end))
        rows = rows.orderBy(F.desc("key") if desc else F.asc("key"))
        return rows if limit is None else rows.limit(limit)

    def iterate(self, **options: object) -> Iterable[Row]:
        try:
            yield from self.scan(**options).toLocalIterator()
        except (PySparkException, Py4JJavaError) as e:
            if valuelog.BAD in str(e):
                raise ChecksumMismatch(str(e).splitlines()[0]) from e
            raise

    def info(self, now: int | None = None) -> Row:
        """Visible keys, mutations, tombstones, bytes, key range."""
        log = self.log()
        total = log.agg(F.count("*").alias("mutations"), F.coalesce(F.sum((F.col("op") == "DEL").cast("long")), F.lit(0)).alias("tombstones"))
        live = self.state(now=now).agg(F.count("*").alias("entries"), F.coalesce(F.sum((F.octet_length("key") + F.octet_length("value")).cast("long")), F.lit(0)).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
        return live.crossJoin(total).first()  # one row each

    # writing

    def write(self, batch: DataFrame) -> None:
        """Appends rows of key, op, value, expires_at as one commit."""
        self.write_all([batch])

    def write_all(self, batches: Sequence[DataFrame]) -> None:
        """Appends several batches as one commit; of two rows of a key that of the later batch wins."""
        self._live()
        number = self._claim()
        rows = mutations.grouped(batches) if len(batches) > 1 else batches[0]
        staged = self._staged(mutations.stamped(rows, number), number)
        try:
            _, size = mutations.check(staged, self.options)
            self._append(staged, number, size, [])
        finally:
            self._fs.delete(self._path(f"staging/{number}"), True)

    def _staged(self, rows: DataFrame, number: int) -> DataFrame:
        """`rows` evaluated once."""
        rows.write.parquet(f"{self.path}/staging/{number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/staging/{number}")

    def _append(self, rows: DataFrame, number: int, size: int, gone: Sequence[int]) -> None:
        # Values are dealt to as many files as they fill, so offsets run within bounded groups.
        files = max(1, min(_PIECES, -(-size // self.options.value_log_file_size)))
        base = _VLOG_ID + number * _PIECES
        fid = F.lit(base) + F.pmod(F.xxhash64("key", "seq"), F.lit(files).cast("long"))
        small, large = valuelog.separate(rows.withColumn("vptr", F.lit(None).cast(MUTATION_LOG["vptr"].dataType)), fid=fid, order=("key", "seq"), threshold=self.options.value_threshold)
        large.sortWithinPartitions("fid", "offset").write.mode("append").partitionBy("fid").parquet(f"{self.path}/vlog")
        made = [int(n.partition("=")[2]) for n, _ in self._names("vlog") if n.startswith("fid=")]
        new = [(f, 0, None) for f in made if base <= f < base + _PIECES]
        dealt = small.repartitionByRange("key").withColumn("table_id", F.lit(number * _PIECES))
        self._commit(number, [*self._store(dealt, number, 0), *new], gone)

    def _store(self, rows: DataFrame, number: int, level: int) -> list[tuple]:
        """Writes rows with a table_id, sorted by key, and gives (table_id, level, metadata) of each table."""
        folder = f"{self.path}/tables/{number}"
        ordered = rows.select("table_id", *[f.name for f in MUTATION_LOG.fields]).sortWithinPartitions("table_id", "key", F.desc("version"), F.desc("seq"))
        ordered.write.options(**_KEY_BLOOM).partitionBy("table_id").parquet(folder)
        stored = self.spark.read.schema("table_id long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MUTATION_LOG.fields)).parquet(folder)
        size = (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(12)) + 8).cast("long")
        dead = F.when(F.col("op") != "PUT", size).otherwise(0)
        stats = stored.groupBy("table_id").agg(F.min("key"), F.max("key"), F.count("*"), F.sum(size), F.sum(dead), F.max("version"))
        return [(r[0], level, (*r[1:], int(time.time()))) for r in stats.collect()]  # a row a table

    def set(self, key: bytes | str, value: bytes | str, ttl_seconds: int | None = None, now: int | None = None) -> None:
        rows = self.spark.createDataFrame([(bytearray(_bytes(key)), bytearray(_bytes(value)))], "key binary, value binary")
        self.write(mutations.puts(rows, ttl_seconds=ttl_seconds, now=now))

    def delete(self, key: bytes | str) -> None:
        self.write(mutations.deletes(self.spark.createDataFrame([(bytearray(_bytes(key)),)], "key binary")))

    # maintenance

    def _begin(self, number: int, what: dict) -> None:
        """Names the levels and range (or file) that maintenance works on; Rejected if another's overlap."""
        name = f"running/{number}"
        self._put(name, what)
        for other, _ in self._names("running"):
            if other.isdigit() and int(other) != number and _clash(what, self._json(f"running/{other}")):
                self._fs.delete(self._path(name), False)
                raise Rejected(f"maintenance {other} works on the same")

    def _end(self, number: int) -> None:
        self._fs.delete(self._path(f"running/{number}"), False)

    def unlock(self) -> None:
        """Forgets maintenance that a crash has left unended."""
        for n, _ in self._names("running"):
            self._fs.delete(self._path(f"running/{n}"), False)

    def inflight(self) -> DataFrame:
        """level, bytes that maintenance under way works on."""
        rows = [(w["levels"][0], w["bytes"]) for w in (self._json(f"running/{n}") for n, _ in self._names("running") if n.isdigit()) if w.get("levels")]
        return self.spark.createDataFrame(rows, "level int, bytes long")

    def _merge(self, tables: list[Row], level: int, table_bytes: int, now: int | None) -> None:
        """Tables into new ones of a level, cut at keys; what no reader needs goes if nothing below can hold it."""
        lo, hi = min(bytes(t["min_key"]) for t in tables), max(bytes(t["max_key"]) for t in tables)
        number, ids = self._claim(), [t["table_id"] for t in tables]
        levels = sorted({*(t["level"] for t in tables), level})
        self._begin(number, {"levels": levels, "lo": lo.hex(), "hi": hi.hex(), "bytes": sum(t["size_bytes"] for t in tables)})
        try:
            others = [t for t in self.tables().collect() if t["table_id"] not in set(ids)]
            bottom = not any(t["level"] >= level and bytes(t["min_key"]) <= hi and bytes(t["max_key"]) >= lo for t in others)
            pieces = max(1, min(_PIECES, -(-sum(t["size_bytes"] for t in tables) // table_bytes)))
            rows = self._rows(ids)
            kept = compaction.compact(rows, now=now, bottom=bottom, parts=pieces)
            new = self._store(kept.withColumn("table_id", F.lit(number * _PIECES) + F.spark_partition_id()), number, level)
            discards = compaction.dropped_bytes(rows, self._rows(i for i, _, _ in new)).withColumn("set_id", F.lit(number))
            discards.coalesce(1).write.mode("append").parquet(f"{self.path}/discards")
            self._commit(number, new, ids)
        finally:
            self._end(number)

    @_maintenance
    def compact(self, now: int | None = None, parts: int | None = None) -> None:
        """All tables into those of the last level, one row a key; readers see no difference."""
        tables = self.tables().collect()
        if tables:
            size = sum(t["size_bytes"] for t in tables)
            self._merge(tables, self.options.max_levels - 1, -(-size // parts) if parts else self.options.base_table_size, now)

    @_maintenance
    def compact_level(self, now: int | None = None) -> int | None:
        """Compacts the level that is most urgent, or the stalest table of the last; the level, or None if nothing is due."""
        return self._compact_level(now)

    def _compact_level(self, now: int | None) -> int | None:
        tables, last, at = self.tables(), self.options.max_levels - 1, int(time.time())
        policy = compaction.level_policy(tables, self.options)
        plan = {r["level"]: r for r in policy.collect()}  # a row a level
        base = next(i for i, r in plan.items() if r["is_base"])
        due = compaction.due(compaction.level_scores(tables, policy, level0_tables=self.options.level0_tables, inflight=self.inflight()), last)
        for level in [r["level"] for r in due.collect()]:
            to = base if level == 0 else level + 1
            picked = (compaction.fill_level0(tables, base) if level == 0 else compaction.pick(tables, level, to)).collect()
            if level == 0 and len(picked) < 2:  # nothing to merge with: small tables of level 0 among themselves
                small = compaction.pick_level0(tables, max_bytes=2 * plan[0]["table_bytes"], created_before=at - 10).collect()
                picked, to = (small, 0) if small else (picked, to)
            if picked:
                self._merge(picked, to, plan[to]["table_bytes"], now)
                return level
        stale = compaction.fill_last(tables, last, plan[last]["table_bytes"], created_before=at - 3600).collect()
        if stale:
            self._merge(stale, last, plan[last]["table_bytes"], now)
            return last
        return None

    def discard_stats(self) -> DataFrame:
        return valuelog.discard_stats(self.value_log(), state.winners(self.log()).where("op = 'PUT'"))

    def dropped_bytes(self) -> DataFrame:
        """fid, bytes: what compactions have found dropped, as they stored it; a lower bound that needs no reading of values."""
        if not self._fs.exists(self._path("discards")):
            return self.spark.createDataFrame([], "fid long, bytes long")
        return self.spark.read.parquet(f"{self.path}/discards").groupBy("fid").agg(F.sum("bytes").alias("bytes"))

    @_maintenance
    def run_value_log_gc(self, ratio: float) -> int:
        """Rewrites the live records of the file with most waste, drops it; its id. NoRewrite if none has enough."""
        worst = valuelog.gc_candidate(self.discard_stats(), ratio).first()
        if worst is None:
            raise NoRewrite("no value-log file has enough to discard")
        fid, number = worst["fid"], self._claim()
        self._begin(number, {"fid": fid})
        try:
            moved = state.winners(self.log()).where((F.col("op") == "PUT") & (F.col("vptr.fid") == fid))
            rows = valuelog.resolve(moved, self.value_log().where(F.col("fid") == fid), verify=self.options.verify_checksum).drop("vptr")
            # The same version and a later seq: the copy wins over the row whose pointer dies, not over newer writes.
            staged = self._staged(rows.withColumn("seq", F.col("seq") + 1), number)
            self._append(staged, number, worst["total"] - worst["discard"], [fid])
        finally:
            self._end(number)
            self._fs.delete(self._path(f"staging/{number}"), True)
        return fid

    def maintain(self, ratio: float = 0.5, now: int | None = None) -> dict[str, int]:
        """What a scheduled job does: compacts as long as a level is due, collects value-log files as long as one has `ratio` of waste."""
        done = {"compactions": 0, "files": 0}
        while self.compact_level(now) is not None:
            done["compactions"] += 1
        while True:
            try:
                self.run_value_log_gc(ratio)
            except NoRewrite:
                return done
            done["files"] += 1

    def close(self) -> None:
        """Later calls fail; everything written is durable already."""
        self.closed = True


def _visible(rows: DataFrame, now: int | None) -> DataFrame:
    return rows.where(state.alive(now)) if now is not None else rows.where((F.col("op") == "PUT") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.unix_timestamp())))


def _clash(a: dict, b: dict) -> bool:
    """Two pieces of maintenance that must not run at once: of one value-log file, or of ranges that share keys and a level."""
    if "fid" in a or "fid" in b:
        return True  # collection moves rows of any key
    return bool(set(a["levels"]) & set(b["levels"])) and a["lo"] <= b["hi"] and a["hi"] >= b["lo"]
