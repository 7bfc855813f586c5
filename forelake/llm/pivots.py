"""Exact search for the largest inner products with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.llm.common import stage

K, SCALE = 20, 64
#: Components beyond this after scaling: their products may not fit a long.
MOST = 1 << 26
#: Pivots, the sample they are fitted on, and rings of equal width a pivot's rows are counted in.
PIVOTS, SAMPLE, RINGS = 32, 4096, 1024
#: Neighbouring rings are one annulus up to so many rows; rows and queries that a task meets at once.
ANNULUS_ROWS, PART_ROWS, QUERY_ROWS, SLICE = 4096, 32_768, 20_000, 4096
#: Rows within a query's annuli in the first and the second round; the last takes all that its bound leaves.
ROUNDS = (4096, 32_768)
#: Buckets of a common vector's ids.
BUCKETS = 64


@dataclass
class Index:
    """Pivots, and per annulus its pivot, least and greatest distance, rows and parts; ``annulus`` is looked up by pivot and ring."""

    centres: np.ndarray
    longest: float
    annulus: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * (self.longest + 1)

    def bounds(self, reach: np.ndarray) -> np.ndarray:
        """No row of an annulus is nearer to a query than this: queries by annuli."""
        own = reach[:, self.pivot]
        return np.maximum(0.0, np.maximum(self.low - own, own - self.high))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all stored vectors equally long, so that near means a large inner product."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", centres, centres) - 2 * points @ centres.T
    return np.sqrt(np.maximum(0.0, squares))


def fit_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of a sample, moved to the means of what is nearest to them."""
    chosen = [0]
    gap = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    centres = points[chosen]
    for _ in range(5):
        own = distances(points, centres).argmin(axis=1)
        full = np.bincount(own, minlength=len(centres)) > 0
        sums = np.stack([np.bincount(own, weights=c, minlength=len(centres)) for c in points.T], axis=1)
        centres = np.where(full[:, None], sums / np.maximum(1, np.bincount(own, minlength=len(centres)))[:, None], centres)
    return centres


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, vec): floor(scale * x) of every component; one vector per id, of the most frequent size."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    fits = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(F.floor(F.least(F.lit(2.0 * MOST), F.greatest(F.lit(-2.0 * MOST), x * scale)))) <= MOST))
    rows = rows.where(F.coalesce(fits, F.lit(False)))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = rows.where(F.size("vec") == (size["n"] if size else 0)).select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    return whole.groupBy("id").agg(F.min("vec").alias("vec"))


def vector_classes(rows: DataFrame, most: int) -> DataFrame:
    """(class, vec, ids): every vector with its ``most`` smallest ids; ``class`` is the first. Ids of a common vector meet in buckets first."""
    inside = Window.partitionBy("vec", "bucket").orderBy("id")
    least = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).withColumn("n", F.row_number().over(inside)).where(F.col("n") <= most)
    return least.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids")).withColumn("class", F.col("ids")[0])


def build(spark, index: DataFrame, centres: np.ndarray, longest: float, annulus_rows: int, part_rows: int) -> Index:
    """Annuli from the counts per pivot and ring: at most ``PIVOTS`` * ``RINGS`` rows, whatever the table's size."""
    found = index.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).orderBy("pivot", "ring").collect()
    table, annuli = np.full((len(centres), RINGS), -1, np.int32), []
    for row in found:
        if not annuli or annuli[-1][0] != row["pivot"] or annuli[-1][3] + row["n"] > annulus_rows:
            annuli.append([row["pivot"], row["low"], row["high"], 0])
        annuli[-1][2] = row["high"]
        annuli[-1][3] += row["n"]
        table[row["pivot"], row["ring"]] = len(annuli) - 1
    pivot, low, high, rows = (np.array(c) for c in zip(*annuli, strict=True))
    return Index(centres, longest, table, pivot, low, high, rows, -(-rows // part_rows))


def top_products(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, annulus_rows: int = ANNULUS_ROWS, part_rows: int = PART_ROWS, query_rows: int = QUERY_ROWS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query row with all other rows, exactly.

    Components become floor(``scale`` * x). ``queries`` is a condition on ``id``. Stored vectors are made
    equally long by one more coordinate, so the largest product is the least distance.
    Each is keyed by its nearest pivot and the distance to it; a pivot's rows are cut
    into annuli by distance. A query opens annuli in the order of the least
    distance that the triangle inequality allows in them: a first prefix, which gives a bound
    on its k-th score, a longer one, and last every annulus that the bound leaves.
    Inside an annulus rows stream by distance, and slices beyond a query's bound are skipped. Nothing is
    given up, so results do not depend on pivots, sizes or rounds.

    Ties go to smaller ids. Vectors that are null or hold null or non-finite components, or
    components of over ``MOST`` after scaling, take no part, nor do null ids and vectors of another size than
    most. Zero vectors do. Of rows that share an id, the least vector counts, once. Equal
    vectors are searched once, as one class. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = stage(whole_vectors(vectors, id_column, vector_column, scale))
    classes = stage(vector_classes(rows, k + 1))
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x * x)
    count, longest = classes.agg(F.count("*"), F.max(square)).first()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact, longest = longest < 2**52, float(np.sqrt(float(longest)) * (1 + 1e-12))
    chosen = rows.where(queries)
    asked = stage(chosen.groupBy("vec").agg(F.min("id").alias("query")))
    members = chosen.join(asked, "vec").select(F.col("id").alias("query_id"), "query")
    # Bounded by ``sample`` vectors.
    drawn = classes.orderBy(F.xxhash64("vec"), "class").limit(sample).select("vec").toArrow()
    centres = fit_pivots(lifted(np.concatenate([matrix(c) for c in drawn.column(0).chunks]).astype(np.float64), longest), pivots)
    width = (2 * longest + 1) / RINGS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = distances(lifted(matrix(batch.column(1)).astype(np.float64), longest), centres)
            pivot = reach.argmin(axis=1)
            r = reach[np.arange(len(reach)), pivot]
            ring = np.minimum(RINGS - 1, (r / width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(ring), pa.array(r)], names=["class", "vec", "pivot", "ring", "r"])

    stored = stage(classes.select("class", "vec").mapInArrow(place, "class long, vec array<long>, pivot int, ring int, r double"))
    index = build(spark, stored, centres, longest, annulus_rows, part_rows)
    best = None
    for low, high in pairwise((0, *rounds, float("inf"))):
        best = _round(asked, stored, index, best, low, high, k, query_rows, exact)
    return _results(best, classes, members, k)


def _round(asked: DataFrame, stored: DataFrame, index: Index, best: DataFrame | None, low: float, high: float, k: int, query_rows: int, exact: bool) -> DataFrame:
    """(query, class, score): the k + 1 best classes after opening the annuli that hold each query's rows ``low`` to ``high``."""
    bound = asked.withColumn("least", F.lit(None).cast("long"))
    if best is not None:
        reached = best.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
        bound = asked.join(reached, "query", "left")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                points = matrix(part.column(1)).astype(np.float64)
                least = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                reach = distances(np.pad(points, ((0, 0), (0, 1))), index.centres)
                square = np.einsum("ij,ij->i", points, points) + index.longest**2 - 2 * least
                limit = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(0.0, square)) + index.slack)
                bounds = index.bounds(reach)
                order = np.argsort(bounds, axis=1, kind="stable")
                before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
                opened = (before >= low) & (before < high) & (np.take_along_axis(bounds, order, axis=1) <= limit[:, None])
                row, place = np.nonzero(opened)
                at = order[row, place]
                taken = pa.array(row)
                columns = [pa.array(at.astype(np.int32)), pa.array(reach[row, index.pivot[at]]), *[c.take(taken) for c in part.columns]]
                yield pa.RecordBatch.from_arrays(columns, names=["annulus", "r", "id", "vec", "least"])

    visits = stage(bound.select("query", "vec", "least").mapInArrow(visit, "annulus int, r double, id long, vec array<long>, least long"))
    slots = np.zeros(len(index.rows), np.int64)
    # One row per annulus.
    for row in visits.groupBy("annulus").count().collect():
        slots[row["annulus"]] = -(-row["count"] // query_rows)
    if not slots.any():
        return best
    met = "annulus int, part int, slot int, kind int, r double, id long, vec array<long>, least long"

    def dealt(at: np.ndarray, ids: np.ndarray, own: np.ndarray, copies: np.ndarray, kind: int, r: pa.Array, rest: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        """Each row goes to one of ``own`` places by its id, and to all ``copies`` of the other side."""
        mine = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, own[at])
        for other in range(int(copies[at].max(initial=0))):
            there = np.flatnonzero(copies[at] > other)
            part, slot = (np.full(len(there), other), mine[there]) if kind == 0 else (mine[there], np.full(len(there), other))
            taken = pa.array(there)
            fixed = [pa.array(c.astype(np.int32)) for c in (at[there], part, slot, np.full(len(there), kind))]
            yield pa.RecordBatch.from_arrays([*fixed, r.take(taken), *[c.take(taken) for c in rest]], names=["annulus", "part", "slot", "kind", "r", "id", "vec", "least"])

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from dealt(batch.column(0).to_numpy(), batch.column(2).to_numpy(), slots, index.parts, 0, batch.column(1), batch.columns[2:])

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = index.annulus[batch.column(2).to_numpy(), batch.column(3).to_numpy()]
            yield from dealt(at, batch.column(0).to_numpy(), index.parts, slots, 1, batch.column(4), [batch.column(0), batch.column(1), pa.nulls(len(batch), pa.int64())])

    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = visits.mapInArrow(deal_queries, met).unionByName(stored.mapInArrow(deal_rows, met))
    both = both.repartition(tasks, "annulus", "part", "slot").sortWithinPartitions("annulus", "part", "slot", "kind", "r", "id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for start, stop in pairwise([0, *edges.tolist(), len(keys)]):
                rows = batch.slice(start, stop - start)
                if key != (now := tuple(keys[start, :3])):
                    if group:
                        yield from group.results()
                    key, group = now, _Group(index, k, exact)
                if keys[start, 3] == 0:
                    group.ask(rows)
                else:
                    for at in range(0, len(rows), SLICE):
                        group.meet(rows.slice(at, SLICE))
        if group:
            yield from group.results()

    hits = both.mapInArrow(score, "query long, class long, score long")
    hits = hits if best is None else hits.unionByName(best)
    first = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return stage(hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))


class _Group:
    """The queries that visit one part of an annulus, and the best classes each has met there."""

    def __init__(self, index: Index, k: int, exact: bool):
        self.index, self.most, self.exact = index, k + 1, exact
        self.asked: list[pa.RecordBatch] = []
        self.ids = None

    def ask(self, rows: pa.RecordBatch) -> None:
        self.asked.append(rows)

    def _open(self) -> None:
        table = pa.Table.from_batches(self.asked).combine_chunks()
        self.ids, self.vectors = table["id"].to_numpy(), matrix(table["vec"].combine_chunks())
        self.reach = table["r"].to_numpy()
        self.least = table["least"].to_numpy().astype(np.float64)
        self.least[np.isnan(self.least)] = -np.inf
        points = self.vectors.astype(np.float64)
        self.square = np.einsum("ij,ij->i", points, points) + self.index.longest**2
        if self.exact:
            self.vectors = points
        self.best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(self.ids)

    def meet(self, rows: pa.RecordBatch) -> None:
        """Rows in the order of distance from their pivot."""
        if not self.asked:
            return
        if self.ids is None:
            self._open()
        r, own, vectors = rows.column(4).to_numpy(), rows.column(5).to_numpy(), matrix(rows.column(6))
        limit = np.sqrt(np.maximum(0.0, self.square - 2 * np.maximum(self.least, -self.index.longest**2 - self.square))) + self.index.slack
        within = (np.maximum(r[0] - self.reach, self.reach - r[-1]) <= limit) | np.isneginf(self.least)
        vectors = (vectors.astype(np.float64) if self.exact else vectors).T
        for live in np.array_split(np.flatnonzero(within), max(1, -(-int(within.sum()) // 1024))):
            near = self.vectors[live] @ vectors
            least = self.least[live]
            if near.shape[1] > self.most:
                least = np.maximum(least, np.partition(near, near.shape[1] - self.most, axis=1)[:, near.shape[1] - self.most])
            row, column = np.nonzero(near >= least[:, None])
            ends = np.searchsorted(row, np.arange(len(live) + 1))
            scores, names = near[row, column].astype(np.int64), own[column]
            for at in np.flatnonzero(np.diff(ends)).tolist():
                s, c, q = scores[ends[at] : ends[at + 1]], names[ends[at] : ends[at + 1]], int(live[at])
                if self.best[q] is not None:
                    s, c = np.concatenate((self.best[q][0], s)), np.concatenate((self.best[q][1], c))
                order = np.lexsort((c, -s))[: self.most]
                self.best[q] = (s[order], c[order])
                if len(order) == self.most:
                    self.least[q] = max(self.least[q], float(s[order[-1]]))

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.ids is not None and (full := [q for q, b in enumerate(self.best) if b is not None]):
            sizes = [len(self.best[q][0]) for q in full]
            columns = [np.repeat(self.ids[full], sizes), np.concatenate([self.best[q][1] for q in full]), np.concatenate([self.best[q][0] for q in full])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "class", "score"])


def _results(best: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Ranked rows per query id: classes become ids, a query's own id goes."""
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = members.join(ids, "query").where("vec_id != query_id").withColumn("rank", F.row_number().over(own))
    return rows.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
