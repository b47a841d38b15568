"""Quality rules over whole texts, DataFrame functions only (operator 4).

Base figures of each text, then a verdict by hashed n-grams: words,
pairs of neighbouring words and the last three characters of words are hashed into `buckets`. The trusted target is a multinomial over the buckets, smoothed, fitted
on labelled documents of good quality; the raw corpus is another one, over
all documents. A document's score is the mean of
log(p_target / p_raw) over its n-grams, so long and short texts compare. Each
document is kept if it passes the base rules and its score reaches
`threshold`; nothing is drawn at random.

The labelled ids are at most `max_trusted` (those with the smallest hashes),
a bounded set that is broadcast; the table of log ratios has `buckets` entries
and is read as one scalar subquery.

Defined results: a null or blank text has no words and fails the base rule; without
labelled documents all scores are 0 and the base rules decide; repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, table, words

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
THRESHOLD = -0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SMOOTHING = 1.0
#: Repeated windows up to which positions are looked up one by one.
FEW = 8


def base_figures(docs: DataFrame, ids: list[str], text_col: str = "text") -> DataFrame:
    """`ids`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and `__w` (the words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(*ids, text.alias("__text")).withColumn("__w", words(F.col("__text")))
    n = F.size("__w")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.slice(F.col("__w"), 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2)))
    symbols = F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long")
    d = d.select(*ids, "__w", hashes.alias("__h"), lines.alias("__lines"), n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), symbols.alias("n_symbols"))
    d = d.withColumns({"__s": F.sort_array("__h"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    d = d.withColumn("__again", F.array_distinct(F.filter(F.col("__s"), lambda x, i: x == F.get("__s", i - 1))))
    # Many repeated windows: sort (hash, place) and keep the places whose neighbour has the same hash.
    pairs = F.when(F.size("__again") > FEW, F.sort_array(F.transform(F.col("__h"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("__pairs", pairs)
    held = lambda k: F.get("__pairs", k)["x"]
    many = F.filter(F.transform(F.col("__pairs"), lambda p, k: F.when((held(k - 1) == p["x"]) | (held(k + 1) == p["x"]), p["i"])), lambda i: i.isNotNull())
    few = F.filter(F.sequence(F.lit(0), F.size("__h") - 1), lambda i: F.array_contains("__again", F.get("__h", i)))
    none = F.array().cast("array<int>")
    d = d.withColumn("__at", F.when(F.size("__again") == 0, none).when(F.size("__again") <= FEW, few).otherwise(F.array_sort(many)))
    # Places in order: a window adds three words, or as many as it starts after the window before.
    covered = F.aggregate(F.transform(F.col("__at"), lambda p, k: F.coalesce(F.least(F.lit(3), p - F.get("__at", k - 1)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", covered.cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return d.select(*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "__w")


#: N-grams at each place: the word, it and the next one, its last three characters.
ORDERS = 3


def _grams(w: str, buckets: int) -> list[Column]:
    """The buckets of the n-grams at each place of an exploded (0: word, 1: next word)."""
    word, after = F.col(f"{w}.0"), F.coalesce(F.col(f"{w}.1"), F.lit("\n"))
    hashes = (F.xxhash64(word), F.xxhash64(word, after), F.xxhash64(F.lit(""), F.substring(word, -3, 3)))
    return [F.pmod(h, F.lit(buckets).cast("long")).cast("int") for h in hashes]


def _places(w: Column) -> Column:
    """Each word with the one after it (null after the last)."""
    return F.arrays_zip(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))).cast("array<struct<`0`:string,`1`:string>>")


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """At most `limit` ids labelled as good and not toxic, by smallest hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row, weights: log(p_target / p_raw) of each of the `buckets`, over all documents."""
    d = docs.select(F.col(id_col).alias("__id"), words(F.col(text_col)).alias("__w"))
    d = d.join(F.broadcast(trusted.select(F.col("doc_id").alias("__of"))), F.col("__id") == F.col("__of"), "left")  # at most MAX_TRUSTED ids
    d = d.select(F.col("__of").isNotNull().cast("int").alias("__good"), F.explode(_places(F.col("__w"))).alias("g"))
    counts = d.select("__good", F.explode(F.array(*_grams("g", buckets))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    sums = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"), F.sum("raw").alias("raws"), F.sum("good").alias("goods"))
    a = F.lit(float(smoothing))
    log_p = lambda k, total: F.log((k + a) / (F.col(total) + a * buckets))
    weights = F.transform(F.col("all"), lambda x: log_p(x["good"], "goods") - log_p(x["raw"], "raws"))
    return sums.select(F.when(F.col("goods") > 0, weights).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("weights"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Base figures, llr (the score) and kept of every document."""
    weights = log_ratios(docs, trusted_ids(labels), id_col=id_col, text_col=text_col, buckets=buckets).scalar()
    return _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], weights, buckets, threshold)


def _judged(docs: DataFrame, ids: list[str], weights: Column, buckets: int, threshold: float) -> DataFrame:
    figures = [*ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # A document's places are summed in the task that holds it, so one row a document is shuffled.
    # The row's number comes before the explosion, which would else number every place.
    d = base_figures(docs, ids).withColumn("__row", F.monotonically_increasing_id()).select(*figures, "__row", F.explode_outer(_places(F.col("__w"))).alias("g"))
    one, two, three = _grams("g", buckets)
    weight = F.when(F.col("g").isNotNull(), F.get(weights, one) + F.get(weights, two) + F.get(weights, three))
    d = d.select(*figures, "__row", weight.alias("weight")).groupBy("__row").agg(F.sum("weight").alias("total"), *[F.first(c).alias(c) for c in figures])
    d = d.withColumn("llr", F.when(F.col("n_words") > 0, F.col("total") / (ORDERS * F.col("n_words"))).otherwise(0.0))
    return d.select(*figures, (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def filter_kept(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns; a row's id and text name its verdict, so repeated ids are no matter."""
    weights = log_ratios(docs, trusted_ids(labels), id_col=id_col, text_col=text_col).scalar()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key, th = fresh_names(docs.columns, "kept_id", "kept_text")
    keys = docs.select(F.col(id_col).alias(key), F.xxhash64(text).alias(th), text.alias("text"))
    kept = _judged(keys, [key, th], weights, BUCKETS, THRESHOLD).where("kept").select(key, th)
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(th)), "left_semi")
