"""Importance resampling towards a target table: bit-sliced sums of n-gram bucket gains."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forelake.llm.common import doc_key, stage

BUCKETS, ORDER = 10_000, 3
#: Documents below this many words are weighed, never drawn; share of the others that is drawn, in per cent.
MIN_WORDS, PER_CENT = 20, 5
SEED = 42
#: Bytes of a text, and documents, that a task holds in unpacked form at a time.
PIECE, BLOCK = 1 << 20, 128

_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to lower case, every byte outside words to a space. Words are whole code points, as all bytes above 0x7F belong to them.
_FOLD = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about ``PIECE`` bytes each."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        part = text[at:stop].translate(_FOLD)
        if stop < len(text) and (space := part.rfind(b" ")) >= 0:
            stop, part = at + space + 1, part[:space]
        elif stop < len(text):  # one word over the whole piece: take it to its end
            rest = text[stop:].translate(_FOLD)
            space = rest.find(b" ")
            stop = len(text) if space < 0 else stop + space
            part += rest[: stop - at - len(part)]
        yield part.split()
        at = stop


def features(text: bytes | None, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words; a count per bucket over all runs of 1 to ``order`` words.

    A run's checksum continues that of the run without its last word, so no run is
    ever put together.
    """
    counts, n, last = np.zeros(buckets, np.int64), 0, []
    for words in pieces(text or b""):
        n, old = n + len(words), len(last)
        words = last + words
        tails = [b" " + w for w in words]
        sums = list(map(zlib.crc32, words))
        for size in range(1, order + 1):
            if size > 1:
                sums = list(map(zlib.crc32, tails[size - 1 :], sums))
            # Runs that end in an earlier piece are counted already.
            counts += np.bincount(np.array(sums[max(0, old - size + 1) :], np.int64) % buckets, minlength=buckets)
        last = words[len(words) - order + 1 :] if len(words) >= order else words
    return n, counts


def bucket_counts(texts: DataFrame, column: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; every task adds up its own rows before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                total += features(text.as_py(), order, buckets)[1]
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])

    return texts.select(F.col(column).cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor(1000 * ln of the smoothed share in the target over that in the corpus)."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    spark = corpus.sparkSession
    # One row per bucket, whatever the tables' size.
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = stage(both.unionByName(every).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    all_s, all_t = sums.agg(F.sum("s"), F.sum("t")).first()
    share = (F.col("t") + 1) * (F.lit(all_s) + buckets) / ((F.col("s") + 1) * (F.lit(all_t) + buckets))
    return sums.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).cast("long").alias("gain"))


def sliced(values: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Bit planes of signed integers in two's complement, each packed to words, and what a bit of each plane counts; the last plane counts below zero."""
    depth = max(int(abs(int(x)) + 1).bit_length() for x in (values.min(), values.max()))
    worth = [1 << i for i in range(depth)] + [-(1 << depth)]
    return packed([(values >> i & 1).astype(bool) for i in range(depth + 1)]), worth


def packed(planes: list[np.ndarray]) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    bits = np.packbits(np.stack(planes), axis=-1)
    return np.ascontiguousarray(np.pad(bits, [*[(0, 0)] * (bits.ndim - 1), (0, -bits.shape[-1] % 8)])).view(np.uint64)


def dot_by_planes(counts: np.ndarray, planes: np.ndarray, worth: list[int]) -> np.ndarray:
    """Rows of ``counts`` times the sliced values, exactly: popcounts of ANDed planes, times powers of two."""
    out, (row, bucket) = np.zeros(len(counts), np.int64), np.nonzero(counts)
    left, digit = counts[row, bucket], 0
    while len(left):
        odd = (left & 1).astype(bool)
        live, place = np.unique(row[odd], return_inverse=True)
        bits = np.zeros((len(live), counts.shape[1]), bool)
        bits[place, bucket[odd]] = True
        if len(live):
            own = packed([bits])[0]
            for plane, each in zip(planes, worth, strict=True):
                out[live] += np.bitwise_count(own & plane).sum(axis=-1, dtype=np.int64) * (each << digit)
        left, digit = left >> 1, digit + 1
        row, bucket, left = row[left > 0], bucket[left > 0], left[left > 0]
    return out


def weigh(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of the gains of a document's features) of every document."""
    planes, worth = sliced(gain)
    buckets = len(gain)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for start, stop in pairwise([*range(0, len(ids), BLOCK), len(ids)]):
                words, counts = zip(*[features(texts[i].as_py(), order, buckets) for i in range(start, stop)], strict=True)
                table = np.stack(counts)
                columns = [ids[start:stop], pa.array(np.array(words, np.int64)), pa.array(table.sum(axis=1)), pa.array(dot_by_planes(table, planes, worth))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, fixed by seed and id."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rows with their place in one order over all of them, counted from 1.

    Rows are range-partitioned and written; a row's place is its place within the
    partition plus the rows of the partitions before, of which there is one number each.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = stage(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    starts, before = [], 0
    for row in sorted_rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition
        starts.append((row["part"], before))
        before += row["count"]
    if not starts:
        return rows.withColumn(out, F.lit(None).cast("long")).limit(0)
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __start long"))
    placed = sorted_rows.withColumn("__part", part).join(start, "__part")
    return placed.select(*rows.columns, (F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(out))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document of ``docs``; ``rank`` is null for those not drawn.

    Both tables have a column ``text``. Features are runs of 1 to ``order`` words of
    ASCII letters (A-Z in lower case), digits and characters beyond ASCII, hashed
    to ``buckets``. A bucket's gain compares smoothed shares of target and corpus. Per document, counts become
    bit planes that are ANDed with the gains' planes, so weights are exact integers.
    ``score`` adds fixed Gumbel noise; of the documents with ``min_words`` words the
    ``per_cent`` of highest score are drawn, ties to smaller ids.

    Null texts have no words and weight 0. Null ids share one noise and come last in
    ties. Repeated rows are separate documents with equal scores. Empty ``docs`` give
    no rows; an empty ``target`` has zero counts. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, order=order, buckets=buckets), bucket_counts(target, order=order, buckets=buckets), buckets)
    # ``buckets`` rows.
    values = np.array([r["gain"] for r in gain.orderBy("bucket").collect()], np.int64)
    rows = weigh(docs, values, order=order).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stage(rows)
    able = F.col("n_words") >= min_words
    draws = per_cent * rows.where(able).count() // 100
    placed = ranked(rows.where(able), [F.desc("score"), F.asc(doc_key()), F.asc("n_features"), F.asc("n_words")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    return placed.unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
