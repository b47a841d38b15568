"""The pipeline against its stages by brute force."""

import collections
import hashlib
import importlib
import math
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from xxhash import xxh64_intdigest

from kvlake.llm import bpe, minhash, mixing, pii, quality, simhash, simjoin

pipeline = importlib.import_module("corpus_pipeline")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_kept(texts, good):
    """Positions of texts that pass the quality rules, by counting."""

    def chained(*x):  # xxhash64 of several strings, as Spark chains the seeds
        seed = 42
        for s in x:
            seed = xxh64_intdigest(s.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % quality.BUCKETS

    def grams(t):
        w = words_of(t)
        return [h for i, x in enumerate(w) for h in (chained(x), chained(x, w[i + 1] if i + 1 < len(w) else "\n"), chained("", x[-3:]))]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n, m, b, kept = sum(raw.values()), sum(target.values()), quality.BUCKETS, []
    for i, t in enumerate(texts):
        w = words_of(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        g = grams(t)
        llr = sum(math.log((target[x] + 1) / (m + b)) - math.log((raw[x] + 1) / (n + b)) for x in g) / len(g) if g else 0.0
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and llr >= quality.THRESHOLD:
            kept.append(i)
    return kept


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_take_effect(spark, tmp_path):
    """Every stage against plain code of its own: counting, all pairs, a search for what was planted, SQL, tiktoken."""
    good = [" ".join(f"{w}{(i * j) % 89}" for j, w in enumerate(("alpha", "beta", "gamma", "delta") * 20)) for i in range(1, 30)]
    junk = " ".join(f"j{i}***" for i in range(200))
    mails = [good[5] + " one@mail.example.com", "two@mail.example.com " + " ".join(f"{w}{40 * j % 89}" for j, w in enumerate(("alpha", "beta", "gamma", "delta") * 20))]
    texts = [*good, good[0], good[1], good[2] + " one@mail.example.com", junk, "short", None, *mails, ""]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    trusted = {*range(32), 35, 36}
    spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    kept = brute_kept(texts, trusted)
    assert {29, 30} <= set(kept) and not set(kept) & {32, 33, 34, 37}
    up = {i: i for i in kept}
    for i in kept:
        for j in kept:
            x, y = shingles(texts[i]), shingles(texts[j])
            if i < j and up[i] != up[j] and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((up[i], up[j]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    reps = sorted(set(up.values()))
    assert not set(reps) & {29, 30, 31, 35} and 36 in reps
    clean = {i: texts[i] for i in reps}
    clean[36] = re.sub(r"^\w+", pii.permute_text(pii.key_of(spark), "email", "two"), texts[36])
    assert "two@" not in clean[36]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": reps, "text": [clean[i] for i in reps], "source": [rows[i][3] for i in reps]}))
    taken = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall()}
    ranks = bpe.read_ranks(bpe.default_ranks())
    enc = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, n in taken.items():
        ids = enc.encode_ordinary(clean[i])
        want += [(i, rows[i][3], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(clean[i].encode()).hexdigest())] * n
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, long texts and columns with clashing names."""
    text = " ".join(f"word{i} and" for i in range(70))
    extra = "__id int, __th int, kept_id int, gone_id int, src int, copy_no int, m map<string,int>"
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " x", "en", None, 9), (None, None, None, None, None), (2, "", "en", "b", 0), (3, " ".join(f"v{i * i}" for i in range(60_000)), "de", "b", 9), (4, "x" * 100_000 + " " + text, "en", "b", 9)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, {"a": 1}) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {1, None, 3, 4} and got
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() >= 1, name


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text", "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_dedup_drops_copies_alike_in_four_fifths(spark):
    rng, schema = random.Random(5), "doc_id long, text string, lang string, source string, n_chars long"

    def alike(a, b):
        x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    texts, gone = {}, set()
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 400))]
        texts[i] = " ".join(words)
        for e in range(1, 9):  # copies with e words changed
            other = list(words)
            for at in rng.sample(range(len(words)), e):
                other[at] = f"x{rng.randrange(10**6)}"
            texts[1000 * e + i] = " ".join(other)
            if alike(texts[i], texts[1000 * e + i]) >= 0.8:
                gone.add(1000 * e + i)
    groups = {i: {k for k in texts if k % 1000 == i} for i in range(60)}
    kept = set()
    for group in groups.values():  # one group has few texts: all pairs
        up = {k: k for k in group}
        for a in sorted(group):
            for b in sorted(group):
                if a < b and up[a] != up[b] and alike(texts[a], texts[b]) >= 0.8:
                    lo, hi = sorted((up[a], up[b]))
                    up = {k: lo if v == hi else v for k, v in up.items()}
        kept |= set(up.values())
    assert len(gone) > 200 and len(kept) > 60
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, "a b", "en", "s", 3)], schema)
    got = [r["doc_id"] for r in pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert got.count(None) == 1 and not gone & set(got)
    assert sorted(x for x in got if x is not None) == sorted(kept)
    for tile in (3, 256):
        found = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(docs, tile=tile).collect()}
        assert {v for v in found.values() if v is not None} == kept


def test_near_dedup_goes_by_simhash(spark, monkeypatch):
    """The stage's candidates are signatures within the radius: with none allowed only equal sets of shingles go."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(words).upper(), 4: "something else altogether, of more than five words"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.simhash_near_dedup(spark, docs, "").collect()) == [1, 4]
    hashes = np.array([xxh64_intdigest(b" ".join(s), 42) for s in {tuple(x.encode() for x in g) for g in shingles(texts[1])}], np.uint64)
    assert [int(w) for w in simjoin.signature(hashes)[:1]] == [simhash.fingerprint(texts[1].encode(), 5)]
    monkeypatch.setattr(simjoin, "near", lambda sigs, left: iter(()))
    found = {r["doc_id"]: r["component_id"] for r in simjoin.near_copies(docs.coalesce(1)).collect()}
    assert found[1] == found[3] == 1 and found[4] == 4


@pytest.mark.parametrize("block,tile", [(8, 4096), (64, 20), (2048, 30)])
def test_simhash_join_links_what_is_alike(spark, block, tile):
    """Against all pairs: in many tables, and in blocks that are cut into tiles."""
    rng = random.Random(block)
    texts = {}
    for i in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        for e in range(8):
            texts[100 * e + i] = " ".join(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    texts |= {1000: "", 1001: " \n", 1002: None, 1003: "one two", 1004: "One  two", 1005: "one two three"}
    up, sets = {k: k for k in texts}, {k: shingles(t or "") or {tuple((t or "").lower().split())} for k, t in texts.items()}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and up[a] != up[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((up[a], up[b]))
                up = {k: lo if v == hi else v for k, v in up.items()}
    assert len(set(up.values())) < len(texts) - 100
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (5, texts[5])], "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"]) for r in simjoin.near_copies(docs, block=block, tile=tile).collect()]
    assert sorted(found, key=str) == sorted([*up.items(), (None, None), (5, up[5])], key=str)


@pytest.mark.parametrize("left", [0, 20, 40, 150])
def test_wide_bit_sliced_comparison(left):
    rng = np.random.default_rng(left)
    sigs = rng.integers(0, 2**64 - 1, (300, 4), dtype=np.uint64)
    for i in range(0, 300, 3):
        flip = np.zeros(256, np.uint8)
        flip[rng.choice(256, rng.integers(0, 90), replace=False)] = 1
        sigs[i] = sigs[i // 2] ^ np.packbits(flip, bitorder="little").view(np.uint64)
    apart = np.bitwise_count(sigs[:, None] ^ sigs[None]).astype(int)
    alike = (apart[:, :, :2].sum(axis=2) <= simjoin.NARROW) & (apart.sum(axis=2) <= simjoin.WIDE)
    want = {(i, j) for i, j in np.argwhere(alike).tolist() if (j < left <= i if left else j < i)}
    got = [x for i, j in simjoin.near(sigs, left) for x in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    up = np.arange(300)
    for i, j in got:
        simjoin.join(up, np.array([i]), np.array([j]))
    at_once = np.arange(300)
    simjoin.join(at_once, *np.array(got).T)
    assert (up == at_once).all()
