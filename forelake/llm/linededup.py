"""Exact line deduplication with keep bitmaps; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.llm.common import doc_key, stage

MIN_CHARS = 10
#: A key is split over several tasks from this share of the lines on, as seen in the plan sample.
HOT_SHARE = 1 / 1000
#: Documents of the plan sample, and tasks that share a hot key's rows.
SAMPLE_DOCS = 8_000
SPREAD = 64
#: Leading bits of a hash that name its range.
RANGE_BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    line = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is exact and far faster where every character is ASCII.
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def signed(docs: DataFrame, *extra: Column) -> DataFrame:
    """Rows with their identity: id and text checksum, so rows that share an id do not mix."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"), *extra)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, sig, pos, h1, h2): two 64-bit hashes of every line key of at least ``min_chars`` characters."""
    lines = docs.select("doc", "sig", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "sig", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc", "sig", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, sig, pos) of each line whose key an earlier document holds.

    Hashes are even over 64 bits, so equal ranges of them need no sampled bounds:
    lines are dealt out by the leading bits and sorted by hash, document and position,
    so that the first document of a key streams past before its other lines. A key
    that the plan sample shows to be hot is spread over ``SPREAD`` tasks by
    document. Lines after their task's first document of the key are settled
    there; only the lines of each task's first document go to a second, small
    comparison. Every line is hashed and sent once. The sample decides where rows go, never what is dropped.
    """
    lines = line_hashes(docs, min_chars)
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(1, docs.count())), seed=7)
    counts = stage(line_hashes(sample, min_chars).groupBy("h1", "h2").count().where("count > 1"))
    least = max(20.0, HOT_SHARE * (counts.agg(F.sum("count")).first()[0] or 0))
    # At most 1 / HOT_SHARE rows, whatever the table's size.
    hot = counts.where(F.col("count") >= least).select("h1", "h2", F.lit(True).alias("hot"))
    lines = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0)))
    lines = lines.withColumn("range", F.shiftright("h1", 64 - RANGE_BITS).cast("int"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Clustered by range and part, so the window below needs no further exchange.
    dealt = lines.repartition(tasks, "range", "part")
    stream = Window.partitionBy("range", "part", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("first", F.first("doc").over(stream)).where("hot or doc > first")
    found = stage(found.select("doc", "sig", "pos", "h1", "h2", (F.col("doc") > F.col("first")).alias("settled")))
    again = Window.partitionBy("h1", "h2")
    undecided = found.where("not settled").withColumn("first", F.min("doc").over(again)).where("doc > first")
    return found.where("settled").select("doc", "sig", "pos").unionByName(undecided.select("doc", "sig", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, sig, dropped): for each document that loses lines, the run-length form of its keep bitmap.

    ``dropped`` is an ascending array of (start, length) runs of zeros; every other
    line is kept. Documents that keep all lines have no row.
    """
    rows = dropped_lines(docs, min_chars).groupBy("doc", "sig").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.element_at("at", F.greatest(i, F.lit(1)).cast("int")) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.element_at("at", F.least(i + 2, F.size("at")).cast("int")) != p + 1))
    return rows.select("doc", "sig", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length"))).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines outside the runs of ``dropped`` (null: all), joined by newlines."""
    lines = F.split(text, "\n", -1)
    ends = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["length"]))
    starts = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(ends, starts, lambda s, e: F.slice(lines, s + 1, e - s)))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents with their line bitmap applied.

    Returns doc_id, n_lines, n_dropped, dropped (runs, null if none), text (kept
    lines; a null text counts as empty) and ``row``, the
    whole input row as a struct. A line's key is the line without ASCII white space
    at its ends, A-Z in lower case; keys of at least ``min_chars`` code points that
    several documents hold keep their lines in the smallest doc_id alone.

    Null or empty text is one empty line. Null ids count as one document after all
    others; rows that share an id count as one document, too, so they never cost
    each other a line. Repeated rows get equal results. Empty tables give no rows.
    """
    rows = signed(docs, F.struct("*").alias("row"))
    marks = keep_bitmaps(signed(docs), min_chars).withColumnsRenamed({"doc": "mark_doc", "sig": "mark_sig"})
    joined = rows.join(marks, (F.col("doc") == F.col("mark_doc")) & (F.col("sig") == F.col("mark_sig")), "left")
    gone = F.coalesce(F.aggregate("dropped", F.lit(0), lambda n, r: n + r["length"]), F.lit(0))
    return joined.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        gone.cast("long").alias("n_dropped"), "dropped", kept_text(F.col("text"), F.col("dropped")).alias("text"), "row",
    )
