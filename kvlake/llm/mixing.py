"""Mixing sources to target weights by systematic sampling (operator 10).

Each source gets a target number of words. All documents of a source expect
the same number of copies, target / size of the source, at most `cap`. The
documents of a source stand in a fixed order; with one offset u of the source
in [0, 1), the document at position i is emitted once for each integer boundary
that i * expected + u crosses, so it gets the expected number rounded up or down and
the whole source stays within one copy of its expectation. The order runs from
size class to size class, so that the words taken are close to the target too.

The running sum needs no sort of a whole source: documents are dealt to small
groups (source, size class, salt), ranked within them, and the sums of the
groups before are added. A source that holds a third of all rows is thus dealt
to as many groups as it needs.

Defined results: a null text has size 0; a null source is a source of its own, ordered
last; a source without words has target 0 and takes nothing; an empty table
gives an empty result; repeated rows are separate documents, ranked by their
content, so that only rows equal in all respects are interchangeable; columns of
the input with the names of the results are replaced; a text of any length is one document, never cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_names, n_words, row_hash, table

#: Documents of a source for each salt; a salt holds about eight size classes.
SALT_ROWS = 1000
#: Neighbouring salts that are summed first.
RUN = 1024
#: Sources whose plan is broadcast.
MAX_BROADCAST = 10_000
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Words to take from each source; `sizes` has the words it holds.

    Sources in the order of their code points, null last, get the weights in
    turn and share the words of all of them. What a source would get beyond `cap` times
    its size is shared among the others by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * share > cap * sizes[s]]
        for s in above or open_:
            out[s] = cap * sizes[s] if above else weight[s] * share
        if not above:
            break
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def _draw(column: Column) -> Column:
    """A number of 32 bits from a column's MD5, which any SQL engine can form."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: float = CAP, keep_columns: bool = True) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (copies * size).

    With `keep_columns` all columns of `docs` stay, else the id and source.
    The per-source totals (one row a source) are the only rows the driver reads.
    """
    spark = docs.sparkSession
    new = ["size", "source_size", "target", "copies", "taken"]
    kept = [c for c in docs.columns if c not in new] if keep_columns else [id_col]
    names = ("src", "of", "key", "tie", "rate", "salts", "class", "salt", "rank", "before", "at")
    src, of, key, tie, rate, salts, class_, salt, rank, before, at = fresh_names([*kept, *new], *names)
    base = docs.select(*[F.col(c) for c in kept], F.col(source_col).alias(src), n_words(F.col(text_col)).alias("size"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key), row_hash(docs).alias(tie))
    totals = base.groupBy(src).agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    sizes = {r[src]: int(r["words"]) for r in totals}
    aims = targets(sizes, weights, cap)
    plan = spark.createDataFrame(
        [(s, sizes[s], aims[s], min(cap, aims[s] / sizes[s]) if sizes[s] else 0.0, max(1, -(-int(r["rows"]) // SALT_ROWS))) for r in totals for s in [r[src]]],
        f"`{of}` string, source_size long, target double, `{rate}` double, `{salts}` int",
    )
    # One row a source, counted just now: few are broadcast, many are joined as they come.
    base = base.join(F.broadcast(plan) if len(totals) <= MAX_BROADCAST else plan, F.col(src).eqNullSafe(F.col(of)), "left")
    base = base.withColumn(class_, F.length(F.bin("size"))).withColumn(salt, F.pmod(_draw(F.col(key)), F.col(salts).cast("long")).cast("int"))
    starts = _starts(base.select(F.col(src).alias("src"), F.col(class_).alias("class"), F.col(salt).alias("salt")))
    starts = starts.select(F.col("src").alias(f"{before}_src"), F.col("class").alias(f"{before}_class"), F.col("salt").alias(f"{before}_salt"), F.col("before").alias(before))
    ranked = base.withColumn(rank, F.row_number().over(Window.partitionBy(src, class_, salt).orderBy("size", id_col, tie)))
    same = F.lit(True)
    for c, name in ((src, "src"), (class_, "class"), (salt, "salt")):
        same = same & F.col(c).eqNullSafe(F.col(f"{before}_{name}"))
    placed = ranked.join(starts, same).withColumn(at, F.col(before) + F.col(rank))
    offset = _draw(F.concat(F.lit("offset:"), F.coalesce(F.col(src), F.lit("")))) / F.lit(2.0**32)
    step = lambda x: F.floor(x * F.col(rate) + offset)
    copies = F.least(step(F.col(at)) - step(F.col(at) - 1), F.lit(int(cap))).cast("long")
    out = placed.withColumn("copies", copies)
    return out.select(*kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _starts(rows: DataFrame) -> DataFrame:
    """src, class, salt, before: the documents of a source before each of its groups, in the order of (class, salt).

    Sums in two levels: RUN neighbouring salts make a run, whose total stands for them in the sum over runs,
    so that no task sees more than a RUN-th of a source's groups.
    """
    counts = rows.groupBy("src", "class", "salt").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("salt") / RUN))
    inner = F.sum("n").over(Window.partitionBy("src", "class", "run").orderBy("salt")) - F.col("n")
    runs = counts.groupBy("src", "class", "run").agg(F.sum("n").alias("total"))
    outer = F.sum("total").over(Window.partitionBy("src").orderBy("class", "run")) - F.col("total")
    runs = runs.select(F.col("src").alias("r_src"), F.col("class").alias("r_class"), F.col("run").alias("r_run"), outer.alias("base"))
    same = F.col("src").eqNullSafe(F.col("r_src")) & (F.col("class") == F.col("r_class")) & (F.col("run") == F.col("r_run"))
    return counts.withColumn("inner", inner).join(runs, same).select("src", "class", "salt", (F.col("base") + F.col("inner")).alias("before"))


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each document of `mix` as often as its copies say."""
    (copy,) = fresh_names(columns, "copy_no")
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias(copy)).drop(copy)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep_columns=False)


SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sums
), rounds AS (
  SELECT 0 AS step, source, source_size, n, place, weight, CAST(NULL AS DOUBLE) AS target FROM weighed
  UNION ALL
  SELECT step + 1, source, source_size, n, place, weight,
         CASE WHEN target IS NOT NULL THEN target
              WHEN any_above AND weight * share > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size
              WHEN NOT any_above THEN weight * share END
  FROM (
    SELECT *, bool_or(target IS NULL AND weight * share > 3.0::DOUBLE * source_size) OVER () AS any_above
    FROM (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))
                / nullif(sum(CASE WHEN target IS NULL THEN weight END) OVER (), 0) AS share,
             bool_or(target IS NULL) OVER () AS still_open
      FROM rounds
    )
  ) WHERE still_open
), aims AS (
  SELECT source, source_size, n, target,
         CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate,
         greatest(1, (n + 999) // 1000) AS salts
  FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.rate,
         row_number() OVER (
           PARTITION BY s.source
           ORDER BY length(bin(s.size)),
                    CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % a.salts,
                    s.size, s.doc_id) AS spot,
         CAST('0x' || substr(md5('offset:' || coalesce(s.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken
FROM (SELECT *, CAST(least(floor(spot * rate + u) - floor((spot - 1) * rate + u), 3) AS BIGINT) AS copies FROM placed)
"""
