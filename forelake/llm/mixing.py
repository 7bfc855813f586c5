"""Mixing sources to target weights on a low-discrepancy schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forelake.llm.common import WORD, running_total, stage

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
MAX_BLOCK = 1024
#: Blocks per source on average, at least, while blocks are shorter than MAX_BLOCK.
BLOCKS_PER_SOURCE = 256
#: Cells of the unit interval through which slots find their source.
CELLS = 4096
#: The golden ratio's fraction, and that of 2**20 times it.
_PHI, _PHI_HIGH = 0.6180339887498949, 0.607787409740351


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) for rows of (source, size).

    The weights repeat over the sources by code point, null last. ``share`` of all
    sizes is dealt out by weight; a target stops at ``limit`` times its source's
    size and the excess is shared anew by weight until none is above. In the order
    of size per weight the stopped sources come first, so running sums find the
    level at which sharing ends. One row per source passes the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * limit)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = weighed.select(
        "source", "source_size", "weight", "most", F.row_number().over(by_ratio).alias("turn"),
        ((F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # The first source that its level leaves below its limit sets the level of all after it.
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("turn", "level"))).over(everything)["level"]
    return level.select("source", "source_size", F.least(F.col("most").cast("double"), F.coalesce(open_level * F.col("weight"), F.col("most").cast("double"))).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank): the order in which the mix takes each source's blocks.

    Slot i gets the golden-ratio point frac(i phi), which falls into the stretch of
    the unit interval that the source's share of all targets covers. The n-th slot
    of a source takes its n-th block. Every source gets exactly the blocks of its
    target: surplus slots are left out, missing ones follow at the end.
    """
    quotas = targets.where("floor(target) > 0").select("source", F.ceil(F.floor("target") / block).cast("long").alias("quota"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    lanes = stage(quotas.select(
        "source", "quota", F.sum("quota").over(Window.partitionBy()).alias("slots"),
        F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), F.row_number().over(order).alias("lane"),
    ).select("source", "lane", "quota", "slots", ((F.col("upto") - F.col("quota")) / F.col("slots")).alias("low"), (F.col("upto") / F.col("slots")).alias("high")))
    slots = lanes.agg(F.max("slots")).first()[0] or 0
    i = F.col("id")
    # Two factors keep the fraction exact far beyond 2**53 / phi.
    turned = F.floor(i / 2**20) * F.lit(_PHI_HIGH) + (i % 2**20) * F.lit(_PHI)
    points = targets.sparkSession.range(slots).select(i.alias("slot"), (turned - F.floor(turned)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = lanes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    hits = points.join(cells, "cell").where("u >= low AND u < high").select("slot", "lane", "quota", F.floor(F.col("slot") / 2**14).alias("chunk"), F.lit(1).alias("one"))
    ranked = running_total(hits, ["lane"], ["slot"], "chunk", "one", "rank").where("rank < quota").select("slot", "lane", "rank")
    reached = ranked.groupBy("lane").count()
    short = lanes.join(reached, "lane", "left").withColumn("count", F.coalesce("count", F.lit(0))).where("count < quota")
    tail = short.select(F.lit(slots).cast("long").alias("slot"), "lane", F.explode(F.sequence("count", F.col("quota") - 1)).alias("rank"))
    names = lanes.select("lane", "source")
    return ranked.unionByName(tail).join(names, "lane").select("slot", "source", "rank")


def stretches(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Columns of ``sizes``, pass, from, to: the words of its source's row that each document stands at, up to the target.

    A source's documents, shuffled by a checksum, stand in one row of words, twice
    over in different orders; words beyond the target are left out.
    """
    wanted = targets.where("floor(target) > 0").select(F.struct("source").alias("key"), "source_size", F.floor("target").cast("long").alias("words"))
    own = [c for c in sizes.columns if c != "source"]
    rows = sizes.where("size > 0").select(F.struct("source").alias("key"), *own).join(wanted, "key")
    passes = rows.withColumn("pass", F.explode(F.when(F.col("words") > F.col("source_size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("pass").cast("string")))
    shuffled = passes.select("key", *own, "pass", "source_size", "words", mark.alias("mark")).withColumn("chunk", F.substring("mark", 1, 3))
    laid = running_total(shuffled, ["key", "pass"], ["mark", "row"], "chunk", "size", "at")
    laid = laid.withColumn("from", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "words")).where("to > from")
    return laid.select(F.col("key.source").alias("source"), *own, "pass", "from", "to")


def blocks(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """(source, rank, row, pass, start, length): the words that each block of a source takes.

    Blocks of equal length cut the rows of words of ``stretches``. ``row`` names a
    document's row, ``start`` is counted inside the document.
    """
    laid = stretches(sizes.select("row", "doc_id", "source", "size"), targets)
    cut = laid.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    low, high = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    return cut.select("source", "rank", "row", "pass", (low - F.col("from")).alias("start"), (high - low).alias("length"))


def sized_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, sig) of every row of ``docs``, written once."""
    return stage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("sig"),
    ))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, max_block: int = MAX_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces) of a mix that takes ``share`` of all words at the sources' weights.

    rows: row, doc_id, source, size, sig (checksum of the text), source_size, target.
    pieces: slot, source, rank, row, pass, start, length, each a stretch of words of
    one document. A size is the number of words between ASCII white space. A source's
    pieces add up to its target, rounded down; no document is taken more than
    ``limit`` times (at most 2).

    Null text has size 0. Null sources are one source, the last. Repeated rows are
    separate documents. Documents are shuffled by a checksum of their id, so reruns
    agree. Empty tables give empty results. All targets are 0 if all sizes are.
    """
    sized = sized_rows(docs)
    targets = stage(source_targets(sized, weights, share, limit))
    total, lanes = targets.agg(F.sum("target"), F.count("*")).first()
    block = int(max(1, min(max_block, (total or 0) // (max(1, lanes) * BLOCKS_PER_SOURCE))))
    cut = blocks(sized, targets, block)
    slots = schedule(targets, block)
    same = slots["source"].eqNullSafe(cut["source"]) & (slots["rank"] == cut["rank"])
    pieces = cut.join(slots, same).select(slots["slot"], cut["source"], cut["rank"], "row", "pass", "start", "length")
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    rows = sized.join(named, sized["source"].eqNullSafe(named["of"])).drop("of")
    return rows, pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """``rows`` with ``taken`` (the words that the mix takes of each document, repeats counted) and ``slot`` (the first that serves it, null if none does)."""
    words = pieces.groupBy("row").agg(F.sum("length").alias("taken"), F.min("slot").alias("slot"))
    return rows.join(words, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, with all their columns.

    A document taken twice has two rows, one not taken has none. The document that
    a source's target cuts keeps its first words, joined by single spaces; every
    other text stays as it is. ``n_chars``, if present, follows the text. Rows that
    share id and text are taken equally often. The words taken do not depend on the
    slots that serve them, so no schedule is made.
    """
    sized = sized_rows(docs)
    taken_words = stretches(sized, stage(source_targets(sized, weights, share, limit)))
    takes = taken_words.groupBy(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), F.col("source").alias("__source"), F.col("pass").alias("__pass")).agg(F.max(F.col("to") - F.col("from")).alias("__words"), F.max("size").alias("__size"))
    text, full = F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (full == F.col("__sig")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("__words").cast("int")), " ")
    mixed = docs.join(takes, same).withColumn("text", F.when(F.col("__words") >= F.col("__size"), text).otherwise(cut))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)
