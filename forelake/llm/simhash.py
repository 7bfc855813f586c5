"""Near-duplicate documents by SimHash, joined through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forelake.functions.joins import join_small
from forelake.llm.common import LAST_ID, doc_key, hanging, stage, stage_rows

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Bands of minima, and minima of a band, that make texts candidates of an exact comparison.
BANDS, BAND_ROWS = 16, 5
#: Texts of a band key that are all paired; rounds of a larger key's first text before its rest is paired by shared shingles.
PAIRED, ROUNDS = 16, 2
#: Fingerprints of one index leaf group, and the fan-out of the nodes above.
CHUNK, FAN = 2048, 16


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words than a shingle has: of the whole sequence; no words: none."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII alone
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)] if tokens else [], dtype=np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[words - 1 :].tolist()
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends, strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half the hashes; none: 0."""
    votes = np.zeros(64, np.int64)
    for part in np.array_split(hashes, -(-len(hashes) // 65536) or 1):
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * v > len(hashes) else "0" for v in votes.tolist()), 2)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc, fp): the document key and its fingerprint as a signed long, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc", "fp"])

    return docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc long, fp long")


def rotations(count: int, max_bits: int) -> list[tuple[int, ...]]:
    """Bit orders, one per table; in each, a choice of blocks comes first.

    Of b blocks, ``max_bits`` differing bits leave b - max_bits equal, so two near
    fingerprints agree in the leading blocks of some table. b grows with the number
    of fingerprints: it decides how many rows share the leading bits, not what is found.
    """
    for b in range(max_bits + 1, 17):
        lead = 64 * (b - max_bits) // b
        if 2**lead * 8 >= count or b == 16:
            break
    edges = [64 * i // b for i in range(b + 1)]
    cut = [tuple(range(edges[i], edges[i + 1])) for i in range(b)]
    return [sum((cut[i] for i in chosen), ()) + sum((cut[i] for i in range(b) if i not in chosen), ()) for chosen in combinations(range(b), b - max_bits)]


def lead_bits(count: int, max_bits: int) -> int:
    b = next(b for b in range(max_bits + 1, 17) if 2 ** (64 * (b - max_bits) // b) * 8 >= count or b == 16)
    edges = [64 * i // b for i in range(b + 1)]
    return min(sum(edges[i + 1] - edges[i] for i in chosen) for chosen in combinations(range(b), b - max_bits))


def reorder(prints: np.ndarray, order: tuple[int, ...]) -> np.ndarray:
    """Fingerprints with their bits in another order (position 0 is the highest bit)."""
    out, at = np.zeros_like(prints), 0
    while at < 64:  # runs of bits that stay together move at once
        run = 1
        while at + run < 64 and order[at + run] == order[at] + run:
            run += 1
        bits = (prints >> np.uint64(64 - order[at] - run)) & np.uint64((1 << run) - 1)
        out |= bits << np.uint64(64 - at - run)
        at += run
    return out


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node keeps the bits that all below it share."""

    def __init__(self, prints: np.ndarray):
        full = np.uint64(2**64 - 1)
        self.levels = [(np.full(len(prints), full), prints)]
        while len(self.levels[-1][1]) > 1:
            mask, pattern = self.levels[-1]
            starts = np.arange(0, len(pattern), FAN)
            both = np.bitwise_and.reduceat(pattern & mask, starts)
            none = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((both | none, both))

    def near(self, other: GrayIndex, max_bits: int, lead: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of fingerprints that agree in the bits of ``lead`` and differ in at most ``max_bits``.

        Differences in the shared bits of two nodes count for every pair below
        them, so a pair of nodes with too many is left with all its fingerprints.
        """
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        deep, deeper = len(self.levels) - 1, len(other.levels) - 1
        while True:
            (mask, pattern), (mask2, pattern2) = self.levels[deep], other.levels[deeper]
            differ = (pattern[i] ^ pattern2[j]) & mask[i] & mask2[j]
            keep = (np.bitwise_count(differ) <= max_bits) & (differ & lead == 0)
            if self is other and deep == deeper:
                keep &= i <= j
            i, j = i[keep], j[keep]
            if not deep and not deeper:
                return i, j
            if deep >= deeper:
                i, j = _open(i, j, len(self.levels[deep - 1][1]))
                deep -= 1
            else:
                j, i = _open(j, i, len(other.levels[deeper - 1][1]))
                deeper -= 1


def _open(i: np.ndarray, j: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Replaces each node i by its children."""
    child = (i[:, None] * FAN + np.arange(FAN)).ravel()
    partner = np.repeat(j, FAN)
    return child[child < below], partner[child < below]


def spanning(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the index pairs connect: each fingerprint with its component's first."""
    root = np.arange(len(prints))
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if np.array_equal(low, high):
            linked = np.flatnonzero(root != np.arange(len(prints)))
            return prints[linked], prints[root[linked]]
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int]]]:
    """(table, leading bits, fingerprints, leading bits shared with other chunks) of a sorted stream.

    A chunk ends with its table, and before the leading bits that would overfill it;
    leading bits held by more than a chunk's rows are split. Those, and the first
    and last of the task, may go on in other chunks.
    """
    held, at_start, cut_through, last = np.empty((0, 3), np.int64), None, None, False
    while True:
        while len(held) <= CHUNK and not last:
            batch = next(batches, None)
            if batch is None:
                last = True
            else:
                held = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)))
        if not len(held):
            return
        at_start = at_start or tuple(held[0, :2])
        changes = np.flatnonzero((held[1 : CHUNK + 1, :2] != held[:CHUNK, :2][: len(held) - 1]).any(axis=1)) + 1
        tables = changes[held[changes, 0] != held[0, 0]]
        if len(tables):
            cut = int(tables[0])
        elif len(held) <= CHUNK:
            cut = len(held)
        else:
            cut = int(changes[-1]) if len(changes) else CHUNK
        chunk, held = held[:cut], held[cut:]
        groups = {tuple(g) for g in chunk[:, :2].tolist()}
        through = tuple(chunk[-1, :2]) if not len(held) or tuple(held[0, :2]) == tuple(chunk[-1, :2]) else None
        yield int(chunk[0, 0]), chunk[:, 1], np.ascontiguousarray(chunk[:, 2]).view(np.uint64), [g[1] for g in groups & {at_start, cut_through, through}]
        cut_through = through


_LINKS = "a long, b long, t int, lead long, chunk long, ones long, zeros long, prints array<long>"
_NAMES = [c.split()[0] for c in _LINKS.split(", ")]


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all within ``max_bits`` bits.

    Each table puts other bits first; its rows are sorted across tasks by leading
    bits and Gray rank. Tasks cut the stream into chunks, index each, and link
    inside it. Leading bits that several chunks share (a hot group, or one on a task's
    edge) leave their fingerprints as blocks: block pairs whose shared bits already
    differ too much are pruned, the others are compared through their indexes. Only
    links that span a component leave a task.
    """
    count = prints.count()
    orders, lead = rotations(count, max_bits), lead_bits(count, max_bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, order in enumerate(orders):
                turned = reorder(raw, order)
                top = (turned >> np.uint64(64 - lead)).astype(np.int64)
                gray = (gray_rank(turned) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array(top), pa.array(gray), batch.column(0)], names=["t", "lead", "gray", "fp"])

    dealt = prints.select("fp").mapInArrow(spread, "t int, lead long, gray long, fp long")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(tasks, "t", "lead", "gray").sortWithinPartitions("t", "lead", "gray").select("t", "lead", "fp")
    lead_masks = [np.uint64(sum(1 << (63 - bit) for bit in order[:lead])) for order in orders]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for t, lead_of, fp, shared in chunks(batches):
            index = GrayIndex(fp)
            yield link_rows(*spanning(fp, *index.near(index, max_bits, lead_masks[t])))
            for value in shared:
                own = fp[lead_of == value]
                yield block_row(t, value, (part << 32) + number, own)
            number += 1

    made = stage(dealt.mapInArrow(link, _LINKS))
    inner = made.where("a is not null").select("a", "b")
    blocks = made.where("chunk is not null").drop("a", "b")
    shared = F.count("*").over(Window.partitionBy("t", "lead"))
    heads = blocks.select("t", "lead", "chunk", "ones", "zeros").withColumn("n", shared).where("n > 1")
    left, right = heads.select("t", "lead", *[F.col(c).alias(f"{c}1") for c in ("chunk", "ones", "zeros")]), heads.select("t", "lead", *[F.col(c).alias(f"{c}2") for c in ("chunk", "ones", "zeros")])
    pairs = left.join(right, ["t", "lead"]).where("chunk1 < chunk2").where(F.bit_count(F.expr("(ones1 & zeros2) | (zeros1 & ones2)")) <= max_bits).select("t", "lead", "chunk1", "chunk2")
    one, two = blocks.select("t", "lead", F.col("chunk").alias("chunk1"), F.col("prints").alias("prints1")), blocks.select("t", "lead", F.col("chunk").alias("chunk2"), F.col("prints").alias("prints2"))
    facing = pairs.join(one, ["t", "lead", "chunk1"]).join(two, ["t", "lead", "chunk2"]).select("t", "prints1", "prints2")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, p, q in zip(*batch.columns, strict=True):
                p, q = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (p, q))
                i, j = GrayIndex(p).near(GrayIndex(q), max_bits, lead_masks[t.as_py()])
                yield link_rows(*spanning(np.concatenate((p, q)), i, j + len(p))).select(["a", "b"])

    return inner.unionByName(facing.mapInArrow(across, "a long, b long"))


def link_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *[pa.nulls(len(a), k) for k in kinds]], names=_NAMES)


def block_row(t: int, lead: int, chunk: int, prints: np.ndarray) -> pa.RecordBatch:
    ones, zeros = (int(np.bitwise_and.reduce(x).view(np.int64)) for x in (prints, ~prints))
    numbers = [pa.array([v], pa.int64()) for v in (lead, chunk, ones, zeros)]
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([t], pa.int32()), *numbers, pa.array([prints.view(np.int64)], pa.list_(pa.int64()))], names=_NAMES)


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    The fingerprint covers the whole text: A-Z in lower case, words between ASCII
    white space, shingles of ``words`` words with repeats (fewer words: the whole
    sequence). Fingerprints at most ``max_bits`` apart are linked, and
    ``component_id`` is the smallest doc_id of everything linked, itself included.

    Null, empty and blank texts have fingerprint 0 and are linked like others.
    Copies meet in one aggregate over fingerprints before any comparison. A null id
    counts as larger than any other; a component of null ids alone has a null
    component_id. Repeated rows repeat. An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, words))
    classes = stage(prints.groupBy("fp").agg(F.min("doc").alias("first")))
    reached = hanging(stage_rows(near_links(classes, max_bits)), "a", "b")
    rooted = classes.join(reached, classes["fp"] == reached["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    known = lambda c: F.when(F.col(c) < LAST_ID, F.col(c))
    return prints.join(named, "fp").select(known("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("component").alias("component_id"))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band from the minima of ``BAND_ROWS`` multiplicative orders each; texts of resemblance J agree in one with chance J ** BAND_ROWS."""
    odd = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(hashes, -(-len(hashes) // 4096) or 1):
        if len(part):
            least = np.minimum(least, np.multiply.outer(odd, part).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + row
    return keys


def sketches(texts: DataFrame, words: int) -> DataFrame:
    """(sig, fp, bands) of every text (sig, text): SimHash and band keys from one pass over its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands = [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), words)
                prints.append(majority(hashes))
                bands.append(band_keys(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["sig", "fp", "bands"])

    return texts.mapInArrow(run, "sig long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sig, shingles): the distinct shingle hashes of every text (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # whole batches of hashes would weigh as much as the texts once more
                some = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sig", "shingles"])

    return texts.mapInArrow(run, "sig long, shingles array<long>")


def resembling(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The distinct ``pairs`` (a, b, further columns) of texts whose sets of shingles have a Jaccard similarity of ``least`` or more."""
    left = pairs.distinct().join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("one")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("other")), "b")
    shared = both.withColumn("shared", F.size(F.array_intersect("one", "other")))
    return shared.where(F.col("shared") >= least * (F.size("one") + F.size("other") - F.col("shared")) - 1e-9).select(*pairs.columns)


def sharing(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, low, high): every pair of texts (sig, component) of different components that can reach ``least``, and the components.

    A text's shingles are put in one order for all texts, rare ones first. Two sets of that
    similarity share one of the first n - ceil(least * n) + 1 of both, so only texts that do are
    paired; and from the first shared one on, both hold as many shingles as two sets of these sizes must share. Members of one component are never paired, however many share a shingle.
    """
    texts = rows.select("sig", "component").distinct()
    held = stage(texts.join(sets, "sig").select("sig", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    often = held.groupBy("shingle").agg(F.count("*").alias("often"), (F.min("component") != F.max("component")).alias("several"))
    place = F.row_number().over(Window.partitionBy("sig").orderBy("often", "shingle"))
    first = held.join(often, "shingle").withColumn("place", place)
    first = stage(first.where(F.col("several") & (F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-6) + 1)).select("shingle", "component", "sig", "n", (F.col("n") - F.col("place") + 1).alias("left")))
    lanes = first.select("shingle", "component").distinct()
    facing = lanes.select("shingle", F.col("component").alias("c1")).join(lanes.select("shingle", F.col("component").alias("c2")), "shingle").where("c1 < c2")
    one, two = (first.select("shingle", F.col("component").alias(f"c{i}"), F.col("sig").alias(f"s{i}"), F.col("n").alias(f"n{i}"), F.col("left").alias(f"l{i}")) for i in (1, 2))
    enough = F.least("l1", "l2") >= least / (1 + least) * (F.col("n1") + F.col("n2")) - 1e-6
    met = facing.join(one, ["shingle", "c1"]).join(two, ["shingle", "c2"]).where((F.least("n1", "n2") >= least * F.greatest("n1", "n2") - 1e-6) & enough)
    return _pairs(met, "s1", "s2", "c1", "c2").distinct()


def _pairs(rows: DataFrame, one: str, other: str, component: str, other_component: str) -> DataFrame:
    """(a, b, low, high): texts and their components, each pair in ascending order."""
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), F.least(component, other_component).alias("low"), F.greatest(component, other_component).alias("high"))


def resemblance_links(classes: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b) of components whose texts resemble each other by ``least`` or more.

    classes: sig, bands, component; texts: sig, text, copies as they come. Texts of different components that share a band key are
    candidates, every text of a component by itself. Keys of up to ``PAIRED`` texts pair all of them. In a larger one the first text
    meets all others of other components, then the first of what is not connected with it, for ``ROUNDS`` rounds; that
    connects large groups of near copies at the cost of as many pairs as texts. What is still of
    different components then meets through ``sharing``, which loses no pair. All pairs are compared exactly.
    """
    rows = classes.select("sig", "component", F.explode("bands").alias("key"))
    span = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key", "n")
    rows = stage(join_small(rows, span, ["key"]))
    # Few texts are candidates, so only theirs are shuffled while the list is small enough to broadcast; copies are combined before.
    own = join_small(texts, rows.select("sig").distinct(), ["sig"], "left_semi").groupBy("sig").agg(F.first("text").alias("text"))
    sets = stage(shingle_sets(own, words))
    few = rows.where(F.col("n") <= PAIRED)
    one, two = (few.select("key", F.col("sig").alias(f"s{i}"), F.col("component").alias(f"c{i}")) for i in (1, 2))
    pairs = _pairs(one.join(two, "key").where("s1 < s2 and c1 != c2"), "s1", "s2", "c1", "c2")
    many = stage(rows.where(F.col("n") > PAIRED).select("key", "sig", F.col("component").alias("origin"), "component", F.lit(False).alias("met")))
    links = None

    def linked(pairs: DataFrame) -> DataFrame:
        found = resembling(pairs, sets, least).select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
        return stage_rows(found if links is None else links.unionByName(found))

    for number in range(ROUNDS + 1):
        if number:
            # Components as all links so far leave them; keys within one component are settled.
            roots = hanging(links, "a", "b")
            links = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
            many = many.join(roots.withColumnRenamed("node", "origin"), "origin", "left").withColumn("component", F.coalesce("root", "origin")).drop("root")
            held = many.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.when(F.col("sig") == F.col("head"), F.col("component"))).alias("top"))
            many = many.join(held.where("low != high").select("key", "top"), "key")
            many = stage(many.select("key", "sig", "origin", "component", (F.col("met") | F.coalesce(F.col("component") == F.col("top"), F.lit(False))).alias("met")))
        if many.isEmpty():
            break
        unmet = many.where("not met")
        if number == ROUNDS or unmet.isEmpty():
            pairs = sharing(many, sets, least)
            break
        heads = unmet.groupBy("key").agg(F.min(F.struct("sig", "component")).alias("h")).select("key", F.col("h.sig").alias("head"), F.col("h.component").alias("top"))
        many = many.join(heads, "key", "left")
        star = _pairs(many.where("component != top"), "sig", "head", "component", "top")
        # The pairs of small keys are compared together with those of the first round.
        links, pairs = linked(star if pairs is None else pairs.unionByName(star)), None
        many = many.drop("component", "top")
    return links if pairs is None else linked(pairs)


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the smallest doc_id of each component stays.

    Texts are linked if their fingerprints differ in at most ``max_bits`` bits and, with
    ``least``, also if their shingle sets have that Jaccard similarity (found with chance
    1 - (1 - J ** BAND_ROWS) ** BANDS, verified exactly). All columns stay. Rows equal in id and text
    become one, the least by its other columns, so reruns agree; of different texts that share the kept
    id all stay. Null ids count as larger than any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"))
    # Copies meet here, by checksum, in small rows.
    made = sketches(rows.select("sig", "text"), words).groupBy("sig").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    firsts = rows.groupBy("sig").agg(F.min("doc").alias("first"))
    prints = stage(made.join(firsts, "sig"))
    classes = stage(prints.groupBy("fp").agg(F.min("first").alias("first")))
    reached = hanging(stage_rows(near_links(classes, max_bits)), "a", "b")
    rooted = stage(prints.join(reached, prints["fp"] == reached["node"], "left").select("sig", "first", "bands", F.coalesce("root", "fp").alias("component")))
    if least:
        links = resemblance_links(rooted, rows.select("sig", "text"), words, least)
        if not links.isEmpty():
            wider = hanging(links, "a", "b").withColumnRenamed("node", "component")
            rooted = rooted.join(wider, "component", "left").select("sig", "first", F.coalesce("root", "component").alias("component"))
    # The component's rows of the smallest id stay; null ids stay only where no other is.
    least_id = rooted.groupBy("component").agg(F.min("first").alias("keep"))
    keep = rooted.join(least_id, "component").where("first = keep").select(F.col("keep").alias("__doc"), F.col("sig").alias("__sig"))
    marked = docs.withColumns({"__doc": doc_key(), "__sig": F.xxhash64(text)}).join(keep, ["__doc", "__sig"], "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Grouped where the join has put them: the texts are shuffled once.
    same = ("__doc", "__sig", "doc_id", "text")
    kept = marked.groupBy(*same).agg(F.min(F.struct(*rest)).alias("__rest")) if rest else marked.select(*same).distinct()
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c).alias(c) for c in docs.columns])
