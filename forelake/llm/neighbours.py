"""Approximate nearest neighbours with a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.llm.common import stage

K = 20
TREES, LEAF = 16, 50
#: Vectors from which the forest's planes are drawn; all vectors are indexed.
SAMPLE = 20_000
#: Share of the true neighbours that the search is set to find.
RECALL = 0.95
#: Queries whose true neighbours are found by reading all rows, to set the search.
PILOT = 64
#: Numbers of trees that the pilot tries, up to all.
FORESTS = (2, 4, 8, 16)
#: Rows of neighbouring leaves that a task holds at once; larger leaves are split.
BUNDLE_ROWS = 20_000
#: Parts in which the ids of one vector are first cut to the smallest.
ID_PARTS = 32
#: Share of the opened rows that a query meets in one tree beforehand, to learn a score that its neighbours must reach.
FIRST_SHARE = 0.125
#: Hits that a task gathers before it cuts them to the best of each query, and queries whose best it holds.
GATHERED, HELD_QUERIES = 400_000, 50_000


@dataclass
class Tree:
    """Split planes; children at or above 0 are nodes, -1 - leaf is a leaf."""

    normals: np.ndarray
    offsets: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: int

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        at = np.full(len(vectors), 0 if len(self.offsets) else -1)
        while len(live := np.flatnonzero(at >= 0)):
            node = at[live]
            side = np.einsum("ij,ij->i", vectors[live], self.normals[node]) > self.offsets[node]
            at[live] = np.where(side, self.high[node], self.low[node])
        return -1 - at


def grow(sample: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    """A tree whose planes lie half-way, by rank, between two random vectors of each node."""
    planes: list = []
    leaves = 0
    todo = [(np.arange(len(sample)), None)]
    while todo:
        rows, parent = todo.pop()
        plane = None
        if len(rows) > leaf:
            a, b = sample[random.choice(rows, 2, replace=False)]
            length = np.linalg.norm(a - b)
            if length > 0:
                place = sample[rows] @ ((a - b) / length)
                middle = float(np.median(place))
                if 0 < (up := place > middle).sum() < len(rows):
                    plane = ((a - b) / length, middle)
        if plane is None:
            me = -1 - leaves
            leaves += 1
        else:
            me = len(planes)
            planes.append([*plane, None, None])
            todo += [(rows[~up], (me, 2)), (rows[up], (me, 3))]
        if parent:
            planes[parent[0]][parent[1]] = me
    normals, offsets, low, high = (list(c) for c in zip(*planes, strict=True)) if planes else ([], [], [], [])
    return Tree(np.array(normals).reshape(len(planes), sample.shape[1]), np.array(offsets), np.array(low, np.int64), np.array(high, np.int64), leaves)


def open_leaves(forest: list[Tree], sizes: list[np.ndarray], query: np.ndarray, rows: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of one queue over all trees, until the leaves hold ``rows`` rows.

    A branch's priority is its least margin to the planes above it, so a branch just
    beyond a plane is opened before a far one, whichever tree it belongs to.
    """
    margins = [(t.normals @ query - t.offsets).tolist() for t in forest]
    low, high = [t.low.tolist() for t in forest], [t.high.tolist() for t in forest]
    queue = [(-np.inf, number, 0 if len(t.offsets) else -1) for number, t in enumerate(forest)]
    heapq.heapify(queue)
    opened = []
    while queue and rows > 0:
        worst, number, node = heapq.heappop(queue)
        # The near side of every plane keeps the priority and is walked down at once.
        while node >= 0:
            margin = margins[number][node]
            near, far = (high, low) if margin > 0 else (low, high)
            heapq.heappush(queue, (max(worst, abs(margin)), number, far[number][node]))
            node = near[number][node]
        opened.append((number, -1 - node))
        rows -= sizes[number][-1 - node]
    return opened


def least_search(forest: list[Tree], sizes: list[np.ndarray], queries: np.ndarray, of: np.ndarray, neighbours: np.ndarray, recall: float) -> tuple[int, int]:
    """(trees, rows): the least number of rows to open that reaches ``recall``, and with how many trees.

    ``neighbours`` are true neighbours of ``queries[of]``. One is found as soon as any
    of its leaves is opened, so the rows opened before that, over all pairs, give the
    rows that any recall takes.
    """
    where = [tree.route(neighbours) for tree in forest]
    best = (len(forest), int(sum(s.sum() for s in sizes)))
    for trees in sorted({min(n, len(forest)) for n in FORESTS}):
        before = np.full(len(of), np.inf)
        for number, query in enumerate(queries):
            opened = open_leaves(forest[:trees], sizes, query, np.inf)
            held = np.array([sizes[t][x] for t, x in opened])
            start = [np.zeros(len(s), np.int64) for s in sizes[:trees]]
            for (t, x), rows in zip(opened, np.cumsum(held) - held, strict=True):
                start[t][x] = rows
            own = np.flatnonzero(of == number)
            for t in range(trees):
                before[own] = np.minimum(before[own], start[t][where[t][own]])
        rows = int(np.sort(before)[int(np.ceil(recall * len(of))) - 1]) + 1
        if rows < best[1]:
            best = (trees, rows)
    return best


def bundles(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First bundle and number of bundles of each leaf: runs of leaves of at most ``most`` rows, larger leaves alone in several parts."""
    first, parts, number, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            number, held = number + 1, 0
        first[leaf], parts[leaf] = number, max(1, -(-size // most))
        number, held = (number + parts[leaf], 0) if parts[leaf] > 1 else (number, held + size)
    return first, parts


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec): vectors of finite numbers, not all zero, of the most frequent size."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vec", lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all vectors equally long, so that near means a large inner product."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - np.einsum("ij,ij->i", vectors, vectors)))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def slack(lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """How far two roundings of the same product can lie apart, per row of ``lefts``, with room for both products of a comparison."""
    longest = np.sqrt(np.einsum("ij,ij->i", rights, rights).max())
    return 8 * (rights.shape[1] + 2) * np.finfo(np.float64).eps * longest * np.sqrt(np.einsum("ij,ij->i", lefts, lefts))


def reaching(near: np.ndarray, most: int, margin: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every product that may be among the ``most`` largest of its row, all ties with the last included.

    ``known``: a score that ``most`` others of the row's query reach already, or minus infinity.
    """
    last, new = known.copy(), np.isneginf(known)
    if new.any():
        most = min(most, near.shape[1])
        last[new] = -np.partition(-near[new], most - 1, axis=1)[:, most - 1]
    return np.nonzero(near >= (last - margin)[:, None])


class Best:
    """The ``most`` best classes of each query, from hits that are gathered and cut together."""

    def __init__(self, most: int):
        self.most, self.size, self.hits = most, 0, []
        self.queries, self.last = np.empty(0, np.int64), np.empty(0)

    def add(self, queries: np.ndarray, classes: np.ndarray, scores: np.ndarray) -> bool:
        """True once enough hits are gathered for a cut."""
        if len(queries):
            self.hits.append((queries, classes, scores))
        self.size += len(queries)
        return self.size > GATHERED

    def cut(self) -> None:
        """Leave each query's best, each class once; ties to smaller ids."""
        if not self.hits:
            return
        q, v, s = (np.concatenate(c) for c in zip(*self.hits, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
        q, v, s = q[new], v[new], s[new]
        self.queries, start, count = np.unique(q, return_index=True, return_counts=True)
        keep = np.arange(len(q)) - np.repeat(start, count) < self.most
        full = count >= self.most
        self.last = np.where(full, s[np.where(full, start + self.most - 1, start)], -np.inf)
        self.hits, self.size = [(q[keep], v[keep], s[keep])], 0

    def known(self, queries: np.ndarray) -> np.ndarray:
        """The score of each query's last kept class, as of the last cut."""
        if not len(self.queries):
            return np.full(len(queries), -np.inf)
        at = np.minimum(np.searchsorted(self.queries, queries), len(self.queries) - 1)
        return np.where(self.queries[at] == queries, self.last[at], -np.inf)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        for q, v, s in self.hits:
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "class", "score"])
        self.__init__(self.most)


def score_pairs(best: Best, ids: np.ndarray, lefts: np.ndarray, floors: np.ndarray, own: np.ndarray, rights: np.ndarray) -> bool:
    """Gather each query's best among ``rights``; True once enough hits are gathered.

    ``floors``: a score that ``best.most`` classes of the query are known to reach, or minus infinity.
    """
    full = False
    for at in range(0, len(ids), 1024):
        block, names = lefts[at : at + 1024], ids[at : at + 1024]
        row, column = reaching(block @ rights.T, best.most, slack(block, rights), np.maximum(best.known(names), floors[at : at + 1024]))
        # The same sum for a pair, whichever leaf it met in.
        exact = [np.einsum("nd,nd->n", block[row[i : i + 8192]], rights[column[i : i + 8192]]) for i in range(0, len(row), 8192)]
        full = best.add(names[row], own[column], np.concatenate(exact or [np.empty(0)]))
    return full


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(class, ids, vec): each distinct vector once, with its k + 1 smallest ids, each at most k times.

    Rows equal in vector and id are counted before the shuffle. The ids of a vector are cut in
    ``ID_PARTS`` parts first, so one task meets only a bounded number for a common vector.
    """
    counted = rows.groupBy(F.xxhash64("vec").alias("mark"), "vec", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    some = Window.partitionBy("mark", "vec", F.pmod(F.xxhash64("id"), F.lit(ID_PARTS))).orderBy("id")
    every = Window.partitionBy("mark", "vec").orderBy("id")
    least = counted.withColumn("n", F.row_number().over(some)).where(F.col("n") <= k + 1)
    least = least.withColumn("n", F.row_number().over(every)).where(F.col("n") <= k + 1)
    ids = F.array_sort(F.flatten(F.collect_list(F.array_repeat("id", F.col("copies")))))
    return least.groupBy("mark", "vec").agg(ids.alias("ids")).select(F.col("ids")[0].alias("class"), "ids", "vec")


def true_neighbours(classes: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query, vec): the ``k`` nearest of all classes for each of a few queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best of this task, as (query, score, class, vec), cut after each batch.
        best = None
        for batch in batches:
            points, names, alone = _matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
            near = queries @ points.T
            near[(ids[:, None] == names[None, :]) & alone[None, :]] = -np.inf
            most = min(k, near.shape[1])
            row, at = np.repeat(np.arange(len(ids)), most), np.argpartition(-near, most - 1, axis=1)[:, :most].ravel()
            found = (row, near[row, at], names[at], points[at])
            best = found if best is None else tuple(np.concatenate(c) for c in zip(best, found, strict=True))
            order = np.lexsort((best[2], -best[1], best[0]))
            best = tuple(c[order] for c in best)
            start = np.searchsorted(best[0], best[0])
            best = tuple(c[np.arange(len(order)) - start < k] for c in best)
        if best is not None:
            there = np.isfinite(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(best[0][there].astype(np.int32)), pa.array(best[1][there]), pa.array(best[2][there]), pa.array(list(best[3][there]), pa.list_(pa.float64()))], names=["query", "score", "class", "vec"])

    hits = classes.select("class", F.size("ids"), "vec").mapInArrow(run, "query int, score double, class long, vec array<double>")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query", "vec")


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES, leaf: int = LEAF, share: float | None = None, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest inner product found for each query row.

    ``queries`` is a condition on ``id``. Equal vectors form one class, kept with its
    k + 1 smallest ids, each at most k times (no more can rank). The planes of the forest come from a
    bounded sample; every class goes to its leaf in every tree. A query opens leaves by
    one priority queue over all trees until they hold enough rows: a ``share`` of all,
    or, if none is given, what brings ``recall`` to the true neighbours of ``PILOT``
    queries, with as many trees as need the fewest rows. Neighbouring leaves
    lie in bundles of bounded size; a bundle's rows are held while the queries that
    open leaves of it pass, each once. Before that a query meets a few leaves of the first tree; the
    score of its last of k + 1 classes there is a floor, and hits below it never leave a task. Candidates are scored in double precision;
    each task keeps the best k + 1 classes of a query. Ties go to smaller ids.

    Vectors that are null, zero or hold null or non-finite components take no part,
    nor do null ids and vectors of another size than most. Rows that share an id are
    separate candidates; a query skips all rows of its id. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    classes = stage(distinct_vectors(rows, k))
    asked = stage(rows.where(queries).select("id", "vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    count, longest = classes.agg(F.count("*"), F.max(length)).first()
    # Bounded by ``PILOT`` and ``sample`` vectors.
    pilot = asked.orderBy(F.xxhash64("id"), "id").limit(PILOT).toArrow()
    if not count or not pilot.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = classes.orderBy(F.xxhash64("class")).limit(sample).select("vec").toArrow()
    points = _lifted(_gathered(drawn.column(0)), longest)
    forest = [grow(points, leaf, np.random.default_rng(number)) for number in range(trees)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _lifted(_matrix(batch.column(1)), longest)
            for number, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), number, np.int32)), pa.array(tree.route(points).astype(np.int32)), batch.column(0)], names=["tree", "leaf", "class"])

    index = stage(classes.select("class", "vec").mapInArrow(place, "tree int, leaf int, class long"))
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    # One row per leaf of the forest.
    for row in index.groupBy("tree", "leaf").count().collect():
        sizes[row["tree"]][row["leaf"]] = row["count"]
    if share is None:
        some = _gathered(pilot.column(1))
        # k rows per pilot query.
        true = true_neighbours(classes, pilot.column(0).to_numpy(), some, k).toArrow()
        if true.num_rows:
            flat = np.concatenate((some, np.zeros((len(some), 1))), axis=1)
            used, budget = least_search(forest, sizes, flat, true.column(0).to_numpy(), _lifted(_gathered(true.column(1)), longest), recall)
            forest, sizes = forest[:used], sizes[:used]
        else:
            budget = count
    else:
        budget = share * count
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ranked(hits: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
        return hits.dropDuplicates(["query_id", "class"]).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)

    placed = index.join(classes.select("class", "vec"), "class").select("tree", "leaf", "class", "vec")
    # A few leaves of the first tree give every query k + 1 classes; no class below the last of them can rank.
    few = max(2.0 * (k + 1), FIRST_SHARE * budget)
    first = stage(ranked(_hits(asked.withColumn("floor", F.lit(float("-inf"))), placed.where("tree = 0"), forest[:1], sizes[:1], few, tasks, leaf, k)))
    floors = first.where(F.col("n") == k + 1).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    bounded = asked.join(floors, "id", "left").select("id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    hits = _hits(bounded, placed.where(F.col("tree") < len(forest)), forest, sizes, budget, tasks, leaf, k)
    hits = ranked(hits.unionByName(first.drop("n"))).drop("n")
    members = hits.join(classes.select("class", "ids"), "class").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _hits(asked: DataFrame, placed: DataFrame, forest: list[Tree], sizes: list[np.ndarray], budget: float, tasks: int, leaf: int, k: int) -> DataFrame:
    """(query_id, class, score): of each query (id, vec, floor) the best k + 1 classes per task among the leaves it opens, none below ``floor``.

    placed: tree, leaf, class, vec.
    """
    count = int(sizes[0].sum())
    most = min(BUNDLE_ROWS, max(leaf, -(-count * len(forest) // tasks)))
    first, parts, total = [], [], 0
    for held in sizes:
        own, number = bundles(held, most)
        first.append(own + total)
        parts.append(number)
        total += int((own + number).max())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1))
            points = np.concatenate((points, np.zeros((len(points), 1))), axis=1)
            for at in range(0, len(points), 64):
                found = []
                for row in range(at, min(at + 64, len(points))):
                    opened: dict[int, list[int]] = {}
                    for t, x in open_leaves(forest, sizes, points[row], budget):
                        for part in range(parts[t][x]):
                            opened.setdefault(int(first[t][x]) + part, []).append(x)
                    found += [(row, bundle, leaves) for bundle, leaves in opened.items()]
                row, bundle, leaves = zip(*found, strict=True)
                own = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(bundle, pa.int32()), pa.array(np.ones(len(row), np.int32)), pa.array(np.full(len(row), -1, np.int32)), batch.column(0).take(own), batch.column(1).take(own), pa.array(leaves, pa.list_(pa.int32())), batch.column(2).take(own)], names=_MET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, where, own = (batch.column(i).to_numpy() for i in range(3))
            start, many = (np.array([c[t][x] for t, x in zip(tree, where, strict=True)], np.int64) for c in (first, parts))
            part = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % many.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((start + part.astype(np.int64)).astype(np.int32)), pa.array(np.zeros(len(own), np.int32)), batch.column(1), batch.column(2), batch.column(3), pa.nulls(len(own), pa.list_(pa.int32())), pa.nulls(len(own), pa.float64())], names=_MET)

    columns = "bundle int, kind int, leaf int, id long, vec array<double>, leaves array<int>, floor double"
    stored = placed.mapInArrow(deal, columns)
    met = asked.select("id", "vec", "floor").mapInArrow(visit, columns).unionByName(stored)
    met = met.repartition(min(tasks, total), "bundle").sortWithinPartitions("bundle", "kind", "leaf")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, held = Best(k + 1), None, []
        for batch in batches:
            bundle, kind, leaf, ids = (batch.column(i).to_numpy() for i in range(4))
            points, floors = _matrix(batch.column(4)), batch.column(6).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(bundle) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, len(ids)], strict=True):
                if bundle[start] != now:
                    now, held = bundle[start], []
                if kind[start] == 0:
                    held.append((leaf[start:stop], ids[start:stop], points[start:stop]))
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(c) for c in zip(*held, strict=True))]
                wanted = batch.column(5).slice(start, stop - start)
                asking = np.repeat(np.arange(start, stop), wanted.value_lengths().to_numpy())
                flat = wanted.flatten().to_numpy()
                order = np.argsort(flat, kind="stable")
                for one, row in zip(*_runs(flat[order], asking[order]), strict=True):
                    low, high = np.searchsorted(held[0][0], [one, one + 1])
                    if low < high and score_pairs(best, ids[row], points[row], floors[row], held[0][1][low:high], held[0][2][low:high]):
                        best.cut()
                if len(best.queries) > HELD_QUERIES:
                    yield from best.flush()
        yield from best.flush()

    return met.mapInArrow(score, "query_id long, class long, score double")


_MET = ["bundle", "kind", "leaf", "id", "vec", "leaves", "floor"]


def _gathered(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_matrix(c) for c in column.chunks])


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each key of a sorted array with the values that stand at it."""
    own, start = np.unique(keys, return_index=True)
    return own, np.split(values, start[1:])
