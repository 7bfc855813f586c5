"""Periodic runs of words: block convolutions at dyadic scales find repeats at short distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_PERIODS = 6, 4
#: Words that a task holds as numbers at a time; a longer document is one such batch.
BATCH_WORDS = 100_000
#: Primes p with 2**18 dividing p - 1, and a root of unity of that order; taken until their product exceeds every possible sum.
PRIMES = (786_433, 5_767_169, 7_340_033)
MAX_ORDER = 18
#: Transforms up to this length are one matrix product: sums of so many products of centred residues are exact in doubles.
DENSE = 128
#: Numbers that a step of the convolution holds.
STEP = 1 << 18


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo ``p`` nearest to zero, of whole numbers held exactly in doubles."""
    return x - p * np.rint(x * (1.0 / p))


@lru_cache(maxsize=None)
def root(p: int, n: int) -> int:
    """An element of multiplicative order ``n`` (a power of two) modulo ``p``; roots of all orders are powers of one."""
    most = 1 << MAX_ORDER
    first = next(w for base in range(2, p) if pow(w := pow(base, (p - 1) // most, p), most // 2, p) == p - 1)
    return pow(first, most // n, p)


@lru_cache(maxsize=None)
def powers(p: int, n: int, rows: int, columns: int, inverse: bool) -> np.ndarray:
    """w ** (i * j) modulo ``p`` for i below ``rows``, j below ``columns``; w has order ``n``."""
    w = root(p, n)
    table = np.empty(n, np.int64)
    table[0] = 1
    for i in range(1, n):
        table[i] = table[i - 1] * w % p
    at = np.arange(rows)[:, None] * np.arange(columns)[None, :] % n
    return centred(table[-at % n if inverse else at].astype(np.float64), p)


def transform(x: np.ndarray, p: int, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row modulo ``p`` (the inverse without its factor 1 / n); rows hold centred residues."""
    n = x.shape[-1]
    if n <= DENSE:
        return centred(x @ powers(p, n, n, n, inverse), p)
    few = n // DENSE
    inner = centred(np.matmul(powers(p, DENSE, DENSE, DENSE, inverse), x.reshape(-1, DENSE, few)), p)
    inner = centred(inner * powers(p, n, DENSE, few, inverse), p)
    return transform(inner.reshape(-1, few), p, inverse).reshape(-1, DENSE, few).transpose(0, 2, 1).reshape(-1, n)


def mismatches(blocks: np.ndarray, windows: np.ndarray, p: int) -> np.ndarray:
    """Sums of squared differences modulo ``p``: row r, column j compares block r with its window from place j on.

    A block has half its window's length n; columns 0 to n / 2 are free of wrap-around.
    """
    n, size = windows.shape[1], blocks.shape[1]
    own, around = centred(blocks, p), centred(windows, p)
    spectrum = transform(np.pad(own, ((0, 0), (0, n - size))), p)
    # The block's spectrum read backwards turns the product into a correlation.
    product = centred(spectrum[:, -np.arange(n) % n] * transform(around, p), p)
    crossed = centred(transform(product, p, inverse=True)[:, : size + 1] * centred(np.float64(pow(n, -1, p)), p), p)
    squares = np.cumsum(np.pad(centred(around * around, p), ((0, 0), (1, 0))), axis=1)
    fixed = centred(own * own, p).sum(axis=1)[:, None] + squares[:, size:] - squares[:, : n - size + 1]
    return centred(centred(fixed, p) - 2 * crossed, p)


def occurrences(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every block of ``size`` at a multiple of 2 * ``size`` that occurs again ``size`` to 2 * ``size`` later.

    ``x`` holds numbers from 0. A sum of squares below the product of the primes used is zero
    exactly if it is zero modulo each; later primes only see blocks that have a zero under the earlier ones.
    """
    block = min(size, 1 << MAX_ORDER - 1)  # a longer block is found by its beginning
    count = -(-len(x) // (2 * size))
    high = int(x.max(initial=0)) + 1
    padded = np.concatenate((x, high + np.arange(2 * size * count + 3 * size - len(x)))).astype(np.float64)
    bound, primes = block * int(padded[-1]) ** 2, []
    for p in PRIMES:
        primes.append(p)
        bound //= p
        if not bound:
            break
    starts, found_at, found_by = 2 * size * np.arange(count), [], []
    step = max(1, STEP // (2 * block))
    for first in range(0, count, step):
        at = starts[first : first + step]
        blocks = padded[at[:, None] + np.arange(block)]
        for offset in range(size, 2 * size, block):
            windows = padded[at[:, None] + offset + np.arange(2 * block)]
            live = np.arange(len(at))
            zero = np.ones((len(at), block + 1), bool)
            for p in primes:
                zero[live] &= mismatches(blocks[live], windows[live], p) == 0
                live = live[zero[live].any(axis=1)]
                if not len(live):
                    break
            else:
                row, place = np.nonzero(zero[live])
                found_at.append(at[live[row]])
                found_by.append(place + offset)
    return (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (found_at, found_by))


def stretch(x: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The longest [low, high) around ``start`` in which every place equals the one ``distance`` later."""
    low, high, step = start, start, 16
    while high + distance < len(x):
        stop = min(len(x) - distance, high + step)
        same = x[high:stop] == x[high + distance : stop + distance]
        high += len(same) if same.all() else int(same.argmin())
        if not same.all():
            break
        step *= 2
    step = 16
    while low:
        begin = max(0, low - step)
        same = (x[begin:low] == x[begin + distance : low + distance])[::-1]
        low -= len(same) if same.all() else int(same.argmin())
        if not same.all():
            break
        step *= 2
    return low, high


def short_stretch(x: np.ndarray, start: np.ndarray, distance: np.ndarray, steps: int) -> np.ndarray:
    """How far, up to ``steps`` on either side, places around each start equal those ``distance`` later."""
    total = np.zeros(len(start), np.int64)
    for way, at in ((1, start), (-1, start - 1)):
        live, at = np.arange(len(start)), at.copy()
        for _ in range(steps):
            inside = (at >= 0) & (at + distance[live] < len(x))
            live, at = live[inside], at[inside]
            same = x[at] == x[at + distance[live]]
            live, at = live[same], at[same] + way
            if not len(live):
                break
            total[live] += 1
    return total


def find_runs(x: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a concatenation of documents, by start and period.

    ``sizes`` are the documents' lengths in ``x``, each with a last number of its own that occurs nowhere else.
    A run of period q holds a block of each size from q / 2 to q at a multiple of twice the size,
    with its copy q later. Sizes ascend, so a repeat at a multiple of q lies inside the run found for q.
    """
    runs: list[tuple[int, int, int]] = []
    size = 1
    while True:
        # Shorter documents have no run of such periods.
        able = sizes - 1 >= max(min_words, min_periods * size)
        if not able.any():
            return sorted(runs, key=lambda r: (r[0], r[2]))
        at = np.flatnonzero(np.repeat(able, sizes))
        start, distance = occurrences(x[at], size)
        start = at[start]
        order = np.lexsort((distance, start))
        start, distance = start[order], distance[order]

        def beyond(start: np.ndarray, distance: np.ndarray, known: list[tuple[int, int, int]], size: int = size) -> np.ndarray:
            """Repeats that lie in no known run whose period divides their distance; starts ascend."""
            free = np.ones(len(start), bool)
            for low, length, period in known:
                a, b = np.searchsorted(start, (low, low + length))
                free[a:b] &= (start[a:b] + distance[a:b] + size > low + length) | (distance[a:b] % period > 0)
            return free

        free = beyond(start, distance, runs)
        start, distance = start[free], distance[free]
        need = np.maximum(min_words, min_periods * distance) - distance
        steps = min(int(need.max(initial=0)), 24)
        reach = short_stretch(x, start, distance, steps) if len(start) else need
        keep = reach >= np.minimum(need, steps)
        start, distance = start[keep], distance[keep]
        for d in np.unique(distance):
            todo, new = start[distance == d], []
            while len(todo):
                low, high = stretch(x, int(todo[0]), int(d))
                if high > low and high - low + d >= max(min_words, min_periods * d):
                    new.append((low, high - low + int(d), int(d)))
                    todo = todo[1:]
                    todo = todo[beyond(todo, np.full(len(todo), d), new[-1:])]
                else:
                    todo = todo[max(1, int(np.searchsorted(todo, high))) :]
            if new:
                runs += new
                left = beyond(start, distance, new)
                start, distance = start[left], distance[left]
        size *= 2


def number_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts; equal words as equal numbers, every text closed by a number of its own; lengths with it."""
    words = [t.split() for t in texts]
    known: dict[bytes, int] = {}
    numbers = [[known.setdefault(w, len(known)) for w in ws] for ws in words]
    sizes = np.array([len(n) + 1 for n in numbers])
    out = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for i, n in enumerate(numbers):
        out[at : at + len(n)] = n
        at += len(n) + 1
        out[at - 1] = len(known) + i
    return words, out, sizes


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed (text) of every document.

    Words are separated by ASCII white space. A run is a stretch of words with smallest
    period ``period``, of at least ``min_words`` words and ``min_periods`` (4 or more) periods, that
    neither neighbouring word continues. ``collapsed`` keeps the first period of
    every run: a word goes if any run holds it after that run's first period.

    Every document stands alone, so nothing is shuffled. Null and empty texts have no
    words, no runs and an empty collapsed text. Repeated rows and null ids are kept
    as they are. Other columns are not read. Empty tables give no rows.
    """
    if min_periods < 4:
        raise ValueError("blocks of every second place need runs of four periods")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        words, x, sizes = number_words(texts)
        ends = np.cumsum(sizes)
        own: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for start, length, period in find_runs(x, sizes, min_words, min_periods):
            doc = int(np.searchsorted(ends, start, side="right"))
            own[doc].append((start - int(ends[doc] - sizes[doc]), length, period))
        kept = []
        for ws, runs in zip(words, own, strict=True):
            keep = np.ones(len(ws), bool)
            for start, length, period in runs:
                keep[start + period : start + length] = False
            kept.append(b" ".join(ws if keep.all() else [ws[i] for i in np.flatnonzero(keep)]))
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in own]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes - 1), pa.array(rows, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.binary())
            start, texts, held = 0, [], 0
            for i, value in enumerate(column):
                texts.append(value.as_py() or b"")
                held += len(texts[-1]) // 6 + 1
                if held >= BATCH_WORDS:
                    yield solve(ids[start : i + 1], texts)
                    start, texts, held = i + 1, [], 0
            if texts:
                yield solve(ids[start:], texts)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, schema)
