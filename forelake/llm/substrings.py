"""Removal of long byte strings that occur more than once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forelake.llm.common import LAST_ID, doc_key, stage

LENGTH = 400
#: Bytes that a task looks at together; a longer document goes through in overlapping stretches.
STRETCH = 1 << 20
#: Contexts of an anchor from which on they are merged by refinement, and beyond which windows are counted by Spark.
PAIRWISE, TOGETHER = 32, 50_000
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's base and of its inverse, modulo 2**64."""
    if _POWERS.get(0, (np.empty(0),))[0].size < n:
        size = 1 << max(16, n.bit_length())
        factors = np.ones((2, size), np.uint64)
        factors[0, 1:], factors[1, 1:] = _BASE, pow(_BASE, -1, 2**64)
        _POWERS[0] = tuple(np.cumprod(factors, axis=1))
    up, down = _POWERS[0]
    return up[:n], down[:n]


def anchors(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Positions of anchors: strings of length // 2 bytes, at least one in every ``length`` bytes.

    Of the anchor strings inside a window, the one with the least rolling hash, the
    first of equals, is chosen, so equal windows choose at equal places.
    """
    k, w = length // 2, length - length // 2 + 1
    found, step = [], STRETCH - length + 1
    for base in range(0, max(1, len(data) - length + 1), step):
        b = np.frombuffer(data, np.uint8)[base : base + STRETCH]
        if len(b) < length:
            continue
        up, down = _powers(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * up, out=sums[1:])
        rolled = (sums[k:] - sums[:-k]) * down[: len(b) - k + 1]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        ranked = (rolled & np.uint64(~0xFFFFFF & (2**64 - 1))) | np.arange(len(rolled), dtype=np.uint64)
        # Least of each run of w: running minima from both ends of blocks of w.
        blocks = -(-len(ranked) // w)
        padded = np.full(blocks * w, 2**64 - 1, np.uint64)
        padded[: len(ranked)] = ranked
        padded = padded.reshape(blocks, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(ranked) - w + 1
        least = np.minimum(back[:count], ahead[w - 1 : w - 1 + count])
        found.append(np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))] & np.uint64(0xFFFFFF)).astype(np.int64) + base)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """(doc, sig, pos, key, context): anchors with checksums of their string and of all windows around it."""
    reach = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            docs, sigs, places, keys, contexts = [], [], [], [], []
            for doc, sig, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                at = anchors(data, length).tolist()
                docs += [doc] * len(at)
                sigs += [sig] * len(at)
                places += at
                keys += [digest(data[p : p + length - reach], 1) for p in at]
                contexts += [digest(data[max(0, p - reach) : p + length], 2 + min(p, reach)) for p in at]
            numbers = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (keys, contexts)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sigs, pa.int64()), pa.array(places, pa.int64()), *numbers], names=["doc", "sig", "pos", "key", "context"])

    return texts.mapInArrow(run, "doc long, sig long, pos long, key long, context long")


def refined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows and each row's common prefix with the one before it.

    The order starts as one block and is refined symbol by symbol (8 bytes each):
    rows move inside their block only, a block splits where symbols differ, and the
    round of a split gives the common prefix. Rows that stand alone are not touched again.
    """
    count, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, block, prefix = np.arange(count), np.zeros(count, np.int64), np.full(count, width)
    prefix[:1] = 0
    for w in range(words.shape[1]):
        same = np.concatenate(([False], block[1:] == block[:-1]))
        active = np.flatnonzero(same | np.concatenate((same[1:], [False])))
        if not len(active):
            break
        symbols = words[order[active], w]
        moved = np.lexsort((symbols, block[active]))
        order[active], symbols = order[active][moved], symbols[moved]
        split = np.concatenate(([False], (symbols[1:] != symbols[:-1]) & (block[active][1:] == block[active][:-1])))
        at = np.flatnonzero(split)
        differ = np.stack([(symbols[at] ^ symbols[at - 1]) >> np.uint64(56 - 8 * i) & np.uint64(255) for i in range(8)], axis=1) != 0
        prefix[active[at]] = 8 * w + differ.argmax(axis=1)
        edge = np.concatenate(([True], block[1:] != block[:-1]))
        edge[active[at]] = True
        block = np.cumsum(edge)
    return order, prefix


def _classes(order: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its group of rows with ``depth`` equal leading bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(prefix < depth)
    return out


def shared_reach(left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far to each side of the anchor the repeated windows of each context reach (-1: none repeats).

    left: bytes before the anchor, nearest first; right: bytes from its start on;
    before, after: how many of them exist. All rows belong to one anchor string.
    """
    most, far = np.full(len(left), -1), np.full(len(left), -1)
    one, two = refined(left), refined(right)
    for a in range(left.shape[1] + 1):
        fits = (before >= a) & (after >= length - a)
        pair = _classes(*one, a) * (len(left) + 1) + _classes(*two, length - a)
        _, place, times = np.unique(pair[fits], return_inverse=True, return_counts=True)
        again = np.flatnonzero(fits)[times[place] > 1]
        most[again] = a
        far[again] = np.maximum(far[again], length - a)
    return most, far


def _reach_by_pairs(key: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small groups of rows with equal keys, side by side."""
    most, far = np.full(len(key), -1), np.full(len(key), -1)
    for lag in range(1, PAIRWISE):
        i = np.flatnonzero(key[lag:] == key[:-lag])
        for at in range(0, len(i), 20_000):
            part = i[at : at + 20_000]
            j = part + lag
            same = []
            for rows, size in ((left, before), (right, after)):
                differ = rows[part] != rows[j]
                first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
                same.append(np.minimum(first, np.minimum(size[part], size[j])))
            good = same[0] + same[1] >= length
            for rows in (part[good], j[good]):
                np.maximum.at(most, rows, same[0][good])
                np.maximum.at(far, rows, same[1][good])
    return most, far


def _context_rows(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(key, doc, sig, pos, once, left, right): the bytes around chosen anchors."""
    reach = length - length // 2
    listed = places.groupBy("doc", "sig").agg(F.collect_list(F.struct("pos", "key", "once")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, sig, text, marks in zip(*[batch.column(i) for i in range(4)], strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for m in marks.as_py():
                    p = m["pos"]
                    rows.append((m["key"], doc.as_py(), sig.as_py(), p, m["once"], data[max(0, p - reach) : p][::-1], data[p : p + length]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "doc", "sig", "pos", "once", "left", "right"])

    return texts.join(listed, ["doc", "sig"]).select("doc", "sig", "text", "places").mapInArrow(run, "key long, doc long, sig long, pos long, once boolean, left binary, right binary")


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, sig, start, stop) for the anchors of groups that fit a task; contexts arrive sorted by key."""
    reach = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys = held.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole >= 2000:
                yield from settle(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from settle(held)

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        values = column.to_pylist()
        wide = -(-width // 8) * 8
        flat = np.frombuffer(b"".join(v.ljust(wide, b"\0") for v in values), np.uint8).reshape(-1, wide)
        return flat, np.fromiter(map(len, values), np.int64, len(values))

    def settle(part: pa.Table) -> Iterator[pa.RecordBatch]:
        key = part.column("key").to_numpy()
        left, before = matrix(part.column("left"), reach)
        right, after = matrix(part.column("right"), length)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        most, far = np.full(len(key), -1), np.full(len(key), -1)
        small = np.repeat(sizes <= PAIRWISE, sizes)
        most[small], far[small] = _reach_by_pairs(key[small], left[small], right[small], before[small], after[small], length)
        for s, n in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist(), strict=True):
            rows = slice(s, s + n)
            most[rows], far[rows] = shared_reach(left[rows, :reach], right[rows, :length], before[rows], after[rows], length)
        pos = part.column("pos").to_numpy()
        hit = np.flatnonzero((most >= 0) & part.column("once").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.column("doc").to_numpy()[hit]), pa.array(part.column("sig").to_numpy()[hit]), pa.array(pos[hit] - most[hit]), pa.array(pos[hit] + far[hit])],
            names=["doc", "sig", "start", "stop"],
        )

    return contexts.mapInArrow(run, "doc long, sig long, start long, stop long")


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many contexts for one task: Spark counts each window's bytes."""
    reach = length - length // 2
    windows = contexts.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(reach)))).where((F.octet_length("left") >= F.col("a")) & (F.octet_length("right") >= length - F.col("a")))
    windows = windows.withColumn("window", F.sha2(F.concat(F.substring("left", F.lit(1), F.col("a")), F.lit(b"|"), F.substring("right", F.lit(1), length - F.col("a"))), 256))
    again = windows.groupBy("key", "a", "window").count().where("count > 1").drop("count")
    hits = windows.where("once").select("key", "a", "window", "doc", "sig", "pos").join(again, ["key", "a", "window"])
    return hits.groupBy("doc", "sig", "pos").agg((F.col("pos") - F.max("a")).alias("start"), (F.col("pos") + length - F.min("a")).alias("stop")).drop("pos")


def repeated_stretches(texts: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """(doc, sig, start, stop): byte stretches that hold every repeated ``length``-byte string around some anchor.

    texts: doc, sig, text. Every window of ``length`` bytes holds an anchor, and equal
    windows hold it at equal places, so repeats only need looking for among the
    contexts (all windows around it) of one anchor string. Equal contexts are
    counted before anything is compared; different ones are compared bytewise.
    """
    reach = length - length // 2
    found = anchor_rows(texts, length)
    # Both are parts of the anchors, far smaller than the texts; with them written, anchors are computed twice in all.
    keys = stage(found.groupBy("key").agg(F.count("*").alias("n"), (F.min("context") == F.max("context")).alias("alike")).where("n > 1").drop("n"))
    again = stage(found.join(keys, "key"))
    place = F.struct("doc", "sig", "pos")
    # Grouped by a struct, so that rows are dealt anew and the join before may split a hot key.
    pair = F.struct("key", "context").alias("pair")
    groups = again.groupBy(pair).agg(F.count("*").alias("n"), F.min(place).alias("one"), F.first("alike").alias("alike")).select("pair.*", "n", "one", "alike")
    repeated = groups.where("n > 1").select("key", "context")
    equal = again.join(repeated, ["key", "context"]).select("doc", "sig", F.greatest(F.col("pos") - reach, F.lit(0)).alias("start"), (F.col("pos") + length).alias("stop"))
    mixed = groups.where("NOT alike").select("key", "one.*", (F.col("n") == 1).alias("once"))
    contexts = _context_rows(texts, mixed, length)
    many = stage(mixed.groupBy("key").count().where(F.col("count") > together).select("key"))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _compare(contexts.join(many, "key", "left_anti").repartition(tasks, "key").sortWithinPartitions("key"), length)
    if many.isEmpty():
        return equal.unionByName(near)
    return equal.unionByName(near).unionByName(_count_windows(contexts.join(many, "key", "left_semi"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): texts without repeated strings.

    Every byte covered by a ``length``-byte string of UTF-8 that also starts anywhere
    else, in the same document or another, is removed; all occurrences go, and all
    are judged on the input. ``n_spans`` counts the maximal runs removed.

    Null text counts as empty. Repeated rows are documents of their own, so each
    makes the other's strings repeated. Null ids stay null. Empty tables give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"))
    spans = repeated_stretches(texts, length, together).groupBy("doc", "sig").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, marks in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = value.as_py().encode("utf-8", "surrogatepass")
                kept, at, runs = [], 0, 0
                end = -1
                for start, stop in sorted((m["start"], min(m["stop"], len(data))) for m in marks.as_py() or ()):
                    if start > end:
                        kept.append(data[at:start])
                        runs += 1
                    end = max(end, stop)
                    at = max(at, end)
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((doc.as_py() if doc.as_py() != LAST_ID else None, len(data), len(data) - len(rest), runs, rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(spans, ["doc", "sig"], "left").select("doc", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

