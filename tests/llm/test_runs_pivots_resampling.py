"""Periodic runs, exact top-k search and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forelake.llm import pivots, queries, resampling, runs

DOCS = "doc_id long, text string, start long, words string, row string"


# ---------------------------------------------------------------- periodic runs


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if not any(s[e:] == s[: length - e] for e in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    kinds, words = rng.choice([1, 2, 3, 50]), []
    for _ in range(rng.randint(0, 12)):
        unit = [f"w{rng.randint(0, kinds)}" for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 300)]
    return words


def test_transforms_are_exact_and_invert():
    for p in runs.PRIMES:
        for n in (2, 64, 128, 256, 4096):
            x = np.random.default_rng(n).integers(-(p // 2), p // 2, (3, n)).astype(float)
            back = runs.transform(runs.transform(x, p), p, inverse=True) * runs.centred(np.float64(pow(n, -1, p)), p)
            assert (runs.centred(back, p) == runs.centred(x, p)).all()
        a, b = (np.random.default_rng(s).integers(0, 9000, (1, 512 * s)) for s in (1, 2))
        direct = [int(((a[0] - b[0, j : j + 512]) ** 2).sum()) % p for j in range(513)]
        assert [int(v) % p for v in runs.mismatches(a.astype(float), b.astype(float), p)[0]] == direct


def test_runs_equal_brute_force_in_mixed_batches():
    rng = random.Random(4)
    for _ in range(60):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        words, x, sizes = runs.number_words([" ".join(d).encode() for d in docs])
        ends = np.cumsum(sizes)
        want = [(s + int(e - n), length, q) for d, e, n in zip(docs, ends, sizes, strict=True) for s, length, q in brute_runs(d)]
        assert runs.find_runs(x, sizes) == want


def test_blocks_longer_than_the_largest_transform(monkeypatch):
    monkeypatch.setattr(runs, "MAX_ORDER", 5)
    runs.root.cache_clear()
    runs.powers.cache_clear()
    rng = random.Random(9)
    for period in (31, 64, 100, 257):
        w = [f"w{rng.randint(0, 9)}" for _ in range(50)] + [f"u{i % period}" for i in range(4 * period + 17)] + ["x"]
        _, x, sizes = runs.number_words([" ".join(w).encode()])
        assert runs.find_runs(x, sizes) == brute_runs(w) == [(50, 4 * period + 17, period)]
    runs.root.cache_clear()
    runs.powers.cache_clear()


def test_long_repetitive_texts_end_soon():
    x = np.concatenate((np.zeros(60_000, np.int64), [1]))
    assert runs.find_runs(x, np.array([len(x)])) == [(0, 60_000, 1)]
    x = np.concatenate((np.tile(np.arange(5000), 6), [5000]))
    assert runs.find_runs(x, np.array([len(x)])) == [(0, 30_000, 5000)]


def test_periodic_runs_on_nulls_repeats_and_other_columns(spark):
    rng = random.Random(2)
    texts = [" ".join(repetitive(rng)) for _ in range(12)] + [None, "", " \n", "a a a a a a", "a a a a a", "É\x0bÉ  É É É É É É", "x" * 5000]
    rows = [(i, t, 7, "w", "r") for i, t in enumerate(texts)] + [(None, "b b b b b b b", 1, "w", "r"), (3, texts[3], 1, "w", "r")]
    got = runs.periodic_runs(spark.createDataFrame(rows, DOCS)).collect()
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want.append((i, len(w), brute_runs(w), collapsed(w, brute_runs(w))))
    key = lambda r: (r[0] is None, r[0], r[3])
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=key) == sorted(want, key=key)
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame(rows, DOCS), min_periods=3)


def test_op12_equals_brute_force_on_whole_tables(spark, tmp_path):
    rng = random.Random(8)
    texts = ["\n ".join(repetitive(rng)) for _ in range(60)] + [None, "", "one", " a  b\t"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    edited = 0
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
            edited += 1
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": found and 1000 * best[1] // best[2] or None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(collapsed(w, found).encode()).hexdigest(),
        }
    assert edited > 3


# ---------------------------------------------------------------- exact top-k


def brute_top(rows, k):
    whole = {}
    for i, v in rows:
        if i is None or not v or len(v) != 3 or any(x is None or not math.isfinite(x) or abs(math.floor(64 * x)) > pivots.MOST for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        whole[i] = min(w, whole.get(i, w))
    out = {}
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return {q: v for q, v in out.items() if v}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


VECS = "vec_id long, embedding array<float>, id long, vec string, class int, r double"


@pytest.mark.parametrize("sizes", [{}, {"annulus_rows": 8, "part_rows": 5, "query_rows": 2, "rounds": (16, 64), "pivots": 4}])
def test_top_products_equal_brute_force(spark, sizes):
    rng = random.Random(3)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(i % 5, 0.3)) for _ in range(3)]) for i in range(300)]
    rows += [(i, [0.5, 0.25, -0.5]) for i in range(300, 460)] + [(i, [f32(-0.01), 0.0, 0.0]) for i in range(460, 480)] + [(i, [0.0, 0.0, 0.0]) for i in range(480, 500)]
    rows += [(500, None), (520, [float("nan"), 1.0, 1.0]), (540, [float("inf"), 1.0, 1.0]), (560, [None, 1.0, 1.0]), (580, []), (600, [1.0, 2.0]), (None, [9.0, 9.0, 9.0]), (620, [1e30, 0.0, 0.0])]
    rows += [(40, rows[40][1]), (60, [5.0, 5.0, 5.0]), (61, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, "v", 2, 0.5) for i, v in rows], VECS)
    assert found(pivots.top_products(df, F.col("id") % 20 == 0, k=7, **sizes)) == brute_top(rows, 7)


def test_top_products_beyond_doubles_and_on_small_tables(spark):
    rows = [(i, [1e6 - i * 0.25, 1e6, -1e6 + i]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 1, "v", 2, 0.5) for i, v in rows], VECS)
    assert found(pivots.top_products(df, F.col("id") % 20 == 0, k=7)) == brute_top([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 7)
    assert pivots.top_products(df.limit(0), F.lit(True)).count() == 0
    assert pivots.top_products(df.where("vec_id = 20"), F.col("id") % 20 == 0).count() == 0
    pair = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i in (19, 20)]
    assert found(pivots.top_products(df.where("vec_id in (19, 20)"), F.col("id") % 20 == 0)) == brute_top(pair, 20)


def test_clusters_leave_most_annuli_unopened():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 100
    points = np.round(centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 16)))
    longest = float(np.sqrt((points**2).sum(axis=1).max()))
    fitted = pivots.fit_pivots(pivots.lifted(points, longest), 32)
    reach = pivots.distances(pivots.lifted(points, longest), fitted)
    own, r = reach.argmin(axis=1), reach.min(axis=1)
    low, high = (np.array([f(r[own == p], initial=b) for p in range(len(fitted))]) for f, b in ((np.min, 1e9), (np.max, 0.0)))
    index = pivots.Index(fitted, longest, np.zeros((1, 1)), np.arange(len(fitted)), low, high, np.bincount(own, minlength=len(fitted)), np.ones(len(fitted)))
    opened = 0
    for q in points[:50]:
        square = q @ q + longest**2 - 2 * np.sort(points @ q)[-21]
        bounds = index.bounds(pivots.distances(np.append(q, 0.0)[None, :], fitted))[0]
        near = points @ q >= np.sort(points @ q)[-21]
        assert (bounds[own[near]] <= np.sqrt(max(0.0, square)) + index.slack).all()
        opened += index.rows[bounds <= np.sqrt(max(0.0, square)) + index.slack].sum()
    assert opened < 0.5 * 50 * len(points)


# ---------------------------------------------------------------- resampling


def brute_features(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_features_in_pieces_equal_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abC dE.9é中_-") for _ in range(rng.randint(0, 900))) for _ in range(40)] + ["", "A", "é" * 400 + " b", "x y" + "z" * 300, " " * 200 + "a"]
    for piece in (1 << 20, 37):
        monkeypatch.setattr(resampling, "PIECE", piece)
        for t in texts:
            n, counts = resampling.features(t.encode())
            words, want = brute_features(t)
            assert n == words and {int(b): int(counts[b]) for b in np.flatnonzero(counts)} == want


def test_planes_give_exact_dot_products():
    rng = np.random.default_rng(3)
    for low, high in ((-9000, 9000), (-1, 1), (0, 1), (5, 4097), (-4096, -3)):
        values, counts = rng.integers(low, high, 1000), rng.integers(0, 3, (40, 1000)) * rng.integers(0, 5000, (40, 1000))
        assert (resampling.dot_by_planes(counts, *resampling.sliced(values)) == counts @ values).all()


def brute_resample(docs, target):
    own = [(i, *brute_features(t)) for i, t in docs]
    s, t = sum((c for *_, c in own), Counter()), sum((brute_features(x)[1] for x in target), Counter())
    all_s, all_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, c in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, rows), key=str)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(6)
    kinds = [f"k{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(kinds[: 60 - i % 3 * 20]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "É!É " * 30), (303, "a " * 20_000), (None, "k1 " * 25), (5, docs[5][1])]
    target = [" ".join(rng.choice(kinds[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "w", "r") for i, t in docs], "doc_id long, text string, n_words long, weight string, score string")
    goal = spark.createDataFrame([(t, 3) for t in target], "text string, bucket int")
    columns = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
    got = sorted((tuple(r[c] for c in columns) for r in resampling.resample(df, goal).collect()), key=str)
    assert got == brute_resample(docs, target) and sum(r[5] is not None for r in got) > 5
    none = sorted((tuple(r[c] for c in columns) for r in resampling.resample(df, goal.limit(0)).collect()), key=str)
    assert none == brute_resample(docs, [])
    assert resampling.resample(df.limit(0), goal).count() == 0
