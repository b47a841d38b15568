"""Language identification with spans (operator 7).

Model: for each language, smoothed log-probabilities of hashed character trigrams
of words, and for each script the languages seen in it. Both come
from all training documents; the model has LANGS x BUCKETS numbers, so its
size does not grow with the corpus.

Prediction: a word's script narrows the candidates to the languages seen
in that script (all of them, if none was), its trigrams score them, and Viterbi over
the words with a penalty for each switch labels the text with spans of
one language. The document's language has most letters in its spans; score is its
share of all letters.

Defined results: a null text, or one without a letter, is `und` with score 0 and no spans; so
is any text if nothing was learned; ties go to the first language by code point; a document
with null doc_id is held out from training (its remainder is unknown) and its held_out is null;
repeated rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

BUCKETS = 1 << 14
SMOOTHING = 0.5
SWITCH = 12.0
#: Score of a language that the word's script rules out.
OUT = -50.0
#: Words that a worker remembers, and that a training task counts at once.
CACHE = 400_000
#: Words of the documents that are labelled together.
PLANE = 2_000_000
UND = "und"

#: The first code points of Unicode blocks, up to the next entry, by script.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_STARTS})
_starts = np.array([c for c, _ in SCRIPT_STARTS])
_codes = np.array([SCRIPTS.index(s) for _, s in SCRIPT_STARTS])
_letters = re.compile(r"[^\W\d_]+")


def script(word: str) -> int:
    """The script of most of a word's letters, as a place in SCRIPTS."""
    if word.isascii():
        return SCRIPTS.index("latin")
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(np.bincount(_codes[np.searchsorted(_starts, points, "right") - 1]).argmax())


def letters(token: str) -> str:
    """The letters of a token in lower case; other marks part them by a space."""
    found = _letters.findall(token)
    if not all(map(str.isalpha, found)):  # numerals such as fractions are word characters too
        found = [x for w in found if (x := "".join(filter(str.isalpha, w)))]
    return " ".join(found).lower()


def grams(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of ' word ', place of its word)."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))  # a word of n letters has n trigrams
    ends = np.cumsum(lengths + 2)
    place = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(place)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(ends - lengths - 2, lengths)
    h = (points[at] * np.uint64(0x9E3779B97F4A7C15) ^ points[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[at + 2]
    h *= np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(40)).astype(np.int64) % buckets, place


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> Model:
    """A model of all `docs` with a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def flush(counts: dict[str, Counter], held: dict[str, np.ndarray]) -> None:
        for lang, c in counts.items():
            plain: Counter = Counter()
            for token, n in c.items():
                if w := letters(token):
                    plain[w] += n
            words = list(plain)
            times = np.fromiter(plain.values(), np.int64, len(plain))
            total = held.setdefault(lang, np.zeros(buckets + len(SCRIPTS), np.int64))
            b, place = grams(words, buckets)
            total[:buckets] += np.bincount(b, times[place], buckets).astype(np.int64)
            for w, n in zip(words, times.tolist(), strict=True):
                total[buckets + script(w)] += n
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(text.split())
                if len(counts[lang]) > CACHE:
                    flush(counts, held)
        flush(counts, held)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "slot", "n"])

    # At most buckets + scripts rows a language reach the driver.
    sums = arrow_map(rows, run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in packed)
    counts = np.zeros((len(langs), buckets + len(SCRIPTS)))
    for r in packed:
        counts[langs.index(r["lang"]), r["slots"]] = r["n"]
    return Model(langs, counts, buckets)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, buckets: int) -> None:
        self.langs, self.buckets = langs, buckets
        c = counts[:, :buckets] + SMOOTHING
        self.log_p = np.log(c / c.sum(axis=1, keepdims=True)) if langs else c
        seen = counts[:, buckets:]
        share = seen / np.maximum(1, seen.sum(axis=1, keepdims=True))
        self.allowed = share >= 0.001  # [languages, scripts]
        self.allowed[:, ~self.allowed.any(axis=0)] = True
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "scores": self.scores[:0], "sizes": self.sizes[:0]}

    def learn(self, tokens: set[str]) -> None:
        """Scores and letter counts of tokens not met before."""
        if len(self.cache) > CACHE:
            self.cache, self.scores, self.sizes = {}, self.scores[:0], self.sizes[:0]
        new = [t for t in tokens if t not in self.cache]
        if not new:
            return
        words = [letters(t) for t in new]
        b, place = grams(words, self.buckets)
        score = np.stack([np.bincount(place, p[b], len(words)) for p in self.log_p], axis=1)
        codes = np.fromiter((script(w) for w in words), np.int64, len(words))
        score[~self.allowed.T[codes]] += OUT
        sizes = np.fromiter((len(w) - w.count(" ") for w in words), np.int64, len(words))
        score[sizes == 0] = 0
        base = len(self.sizes)
        self.cache.update(zip(new, range(base, base + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, score.astype(np.float32)])
        self.sizes = np.concatenate([self.sizes, sizes])

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language of each token of each text, by Viterbi; all texts advance together."""
        n, langs = len(texts), len(self.langs)
        index = [np.fromiter(map(self.cache.__getitem__, t), np.int64, len(t)) for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        alive = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # texts longer than t come first
        offsets = np.concatenate([[0], np.cumsum(alive)])
        flat = np.zeros(int(offsets[-1]), np.int64)
        for row, i in enumerate(order.tolist()):
            if lengths[i]:
                flat[offsets[: lengths[i]] + row] = index[i]
        emit = self.scores[flat]
        back = np.zeros((len(flat), langs), bool)  # True: came from the best language so far
        best_of = np.zeros(len(flat), np.int8 if langs < 127 else np.int32)
        v = np.zeros((int(alive[0]) if longest else 0, langs), np.float32)
        last = np.zeros(n, np.int64)
        for t in range(longest):
            k, a = int(alive[t]), int(offsets[t])
            ended = v[k:]
            if len(ended):
                last[k : k + len(ended)] = ended.argmax(axis=1)
            v = v[:k]
            if t:
                top = v.argmax(axis=1)
                switch = v[np.arange(k), top][:, None] - np.float32(SWITCH)
                moved = switch > v
                back[a : a + k] = moved
                best_of[a : a + k] = top
                v = np.where(moved, switch, v)
            v = v + emit[a : a + k]
        if longest:
            last[: len(v)] = v.argmax(axis=1)
        state = last
        path = np.zeros(len(flat), best_of.dtype)
        for t in range(longest - 1, -1, -1):
            k, a = int(alive[t]), int(offsets[t])
            s = state[:k]
            path[a : a + k] = s
            state[:k] = np.where(back[a + np.arange(k), s], best_of[a : a + k], s)
        out: list[np.ndarray] = [np.zeros(0, path.dtype)] * n
        for row, i in enumerate(order.tolist()):
            out[i] = path[offsets[: lengths[i]] + row]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; a span is (first word, words, language)."""
        if not self.langs:
            return [(UND, 0.0, [])] * len(texts)
        cut_ = [(t or "").split() for t in texts]
        self.learn(set(chain.from_iterable(cut_)))
        out = []
        for tokens, path in zip(cut_, self.label(cut_), strict=True):
            size = self.sizes[np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))]
            total = int(size.sum())
            if not total:
                out.append((UND, 0.0, []))
                continue
            weight = np.bincount(path, size, len(self.langs))
            at = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1, [len(path)]])
            spans = [(a, b - a, self.langs[path[a]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            best = int(weight.argmax())
            out.append((self.langs[best], float(weight[best]) / total, spans))
        return out


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """id, the columns `keep`, lang_pred, score and spans (first_word, n_words, lang) of each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x buckets numbers
    head = docs.select(F.col(id_col), *[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    fields = head.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(len(fields)).to_pylist()
            lo = held = 0
            for hi, t in enumerate([*texts, None], 1):
                held += len(t or "") // 3
                if held < PLANE and hi <= len(texts):
                    continue
                got, n = m.predict(texts[lo:hi]), min(hi, len(texts)) - lo
                columns = [batch.column(i).slice(lo, n) for i in range(len(fields))]
                columns += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                if spans:
                    columns.append(pa.array([[{"first_word": a, "n_words": b, "lang": c} for a, b, c in g[2]] for g in got], kind))
                if n:
                    yield pa.RecordBatch.from_arrays(columns, names)
                lo, held = hi, 0

    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
    names = [f.name for f in fields] + ["lang_pred", "score"] + ["spans"] * spans
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return arrow_map(head, run, schema + ", spans array<struct<first_word:long,n_words:long,lang:string>>" * spans)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, keep=("held_out",), spans=False)
