"""Helpers that the operators share: the shared folder, lineage cuts, words."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in the contracts: space and 0x09-0x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Only a local master may go without the setting; it then gets a folder of
    its own. On a cluster a missing setting is an error, as a machine-local
    folder would lose data with the machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kvlake-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this subpackage to the Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="kvlake-"), "kvlake_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("kvlake/__init__.py", "")
        for f in sorted(here.glob("*.py")):
            z.write(f, f"kvlake/llm/{f.name}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


#: Bytes of an Arrow batch that a Python worker gets; by Spark's own limit of 10,000 rows long texts would fill its memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with this subpackage at hand in the workers, in batches of BATCH_BYTES unless the session says otherwise."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that this Python worker has freed back to the system; workers live on beside the JVM and those of later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """`run` for arrow_map with a release at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """`df` written to `path` as Parquet and read back; the shuffle files behind it go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)
    return df.sparkSession.read.parquet(path)


def drop(stored: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = stored.sparkSession
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/kvlake-{what}-{uuid.uuid4().hex}"


def fresh_names(columns: Iterable[str], *names: str) -> list[str]:
    """`names`, with marks before them as long as they clash with one of `columns` (whatever its case)."""
    held, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        out.append(n)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have none, by their JSON."""
    holds_map = lambda t: "map<" in t.simpleString() or "variant" in t.simpleString()
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    return F.xxhash64(*[F.to_json(F.struct(quoted(f.name))) if holds_map(f.dataType) else quoted(f.name) for f in df.schema.fields])


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    held = F.btrim(F.coalesce(text, F.lit("")), F.lit(BREAK_CHARS))
    none = F.array().cast("array<string>")
    return F.when(held == "", none).otherwise(F.split(held, WORD_BREAK))


def n_words(text: Column) -> Column:
    """The number of words of a text, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or a path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_store(uri: str):
    """(pyarrow filesystem, path in it) of any URI that pyarrow can reach."""
    from pyarrow import fs

    if (path := local_path(uri)) is not None:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(uri)
