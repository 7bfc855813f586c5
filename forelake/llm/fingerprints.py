"""One-permutation MinHash fingerprints of documents; DataFrame functions only."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forelake.llm.common import BLANKS, LAST_ID, doc_key, stage

SHINGLE_WORDS = 5
BINS, BITS = 128, 8
#: Bins of an empty bin's random order that are tried from a table.
PROBES = 8


def with_shingles(rows: DataFrame, text: str, out: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` with an array of structs in place of ``text``: one per shingle, its fields the hashes of its words.

    Words stand between ASCII white space, in lower case. Fewer words than a shingle
    has: one shingle of them all, its other fields null; no word: an empty array.
    Each step is a column of its own, so that no step is computed twice.
    """
    kept = [c for c in rows.columns if c != text]
    rows = rows.select(*kept, F.split(F.lower(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))), f"[{BLANKS}]+").alias("__tokens"))
    rows = rows.select(*kept, F.transform(F.filter("__tokens", lambda w: w != ""), lambda w: F.xxhash64(w)).alias("__tokens"))
    count = F.least(F.size("__tokens"), F.greatest(F.size("__tokens") - (words - 1), F.lit(1)))
    return rows.select(*kept, F.arrays_zip(*[F.slice("__tokens", i + 1, count).alias(f"w{i}") for i in range(words)]).alias(out))


def minima(texts: DataFrame, keys: list[str], text: str, words: int = SHINGLE_WORDS, bins: int = BINS) -> DataFrame:
    """``keys`` and ``minima``: the least value of every bin, null where no shingle falls into it; null for a text without shingles.

    Each shingle is hashed once: the low bits choose its bin, the rest compete there.
    Rows stay as they are: a text's hashes, its bin leading, are sorted in one array
    together with a mark above all values of each bin, and the first of each bin stays.
    """
    width = bins.bit_length() - 1
    top, mask = 64 - width, (1 << (64 - width)) - 1
    # The bin stands in the leading bits, the highest of them turned so that signed numbers sort by bin.
    marks = F.expr("array(" + ", ".join(f"{(j << top | mask) - 2**63}L" for j in range(bins)) + ")")
    rows = with_shingles(texts.select(*keys, text), text, "all", words)
    hashed = rows.select(*keys, F.transform("all", lambda s: F.xxhash64(s)).alias("h"))
    turned = hashed.select(*keys, F.transform("h", lambda h: F.shiftleft(h, top).bitwiseOR(F.shiftrightunsigned(h, width)).bitwiseXOR(F.lit(-(2**63)))).alias("h"))
    ordered = turned.select(*keys, (F.size("h") > 0).alias("some"), F.sort_array(F.concat("h", marks)).alias("h"))
    first = lambda x, i: (i == 0) | (F.shiftright(x, top) != F.shiftright(F.get("h", i - 1), top))
    least = ordered.select(*keys, "some", F.filter("h", first).alias("h"))
    value = lambda x: F.when(x.bitwiseAND(F.lit(mask)) != mask, x.bitwiseAND(F.lit(mask)))
    return least.select(*keys, F.when(F.col("some"), F.transform("h", value)).alias("minima"))


def turns(bins: int, probes: int) -> list[list[int]]:
    """The first ``probes`` bins in every empty bin's random order: bins by a hash of both."""
    import xxhash

    def turn(j: int, m: int) -> tuple[int, int]:
        seed = xxhash.xxh64_intdigest(struct.pack("<i", j), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", m), seed)
        return h - 2**64 if h >= 2**63 else h, m

    return [sorted(range(bins), key=lambda m: turn(j, m))[:probes] for j in range(bins)]


def densified(found: Column, bins: int = BINS) -> Column:
    """Array of one value per bin, or empty if ``found`` is null; ``found`` should be a column, not computed here.

    An empty bin takes the value of the full bin that comes first in a random order
    of its own (a hash of both bins), so bins are filled independently of each other
    and alike in every document. The first bins of each order are tried from a table;
    where all are empty, the hashes of the full bins are compared.
    """
    order = turns(bins, PROBES)
    tables = [F.expr("array(" + ", ".join(str(o[k]) for o in order) + ")") for k in range(min(PROBES, bins))]

    def fill(v: Column, j: Column) -> Column:
        every = F.transform(found, lambda x, m: F.when(x.isNotNull(), F.struct(F.xxhash64(j, m).alias("turn"), m.alias("bin"), x.alias("value"))))
        return F.coalesce(v, *[F.get(found, F.get(t, j)) for t in tables], F.array_min(every)["value"])

    return F.when(found.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(found, fill))


def low_bits(values: Column, bits: int = BITS) -> Column:
    return F.transform(values, lambda v: F.pmod(v, F.lit(1 << bits)).cast("int"))


def packed(low: Column, bits: int = BITS) -> Column:
    """The low bits of all bins as hexadecimal digits; empty without shingles."""
    digits = F.expr("array(" + ", ".join(f"'{v:0{bits // 4}x}'" for v in range(1 << bits)) + ")")
    return F.array_join(F.transform(low, lambda v: F.get(digits, v)), "")


def likeness(one: Column, other: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated resemblance of two packed fingerprints, 0 to 1.

    Unlike values agree in their low bits once in 2**bits; that share is taken off.
    Two documents without shingles are alike, one is unlike any other.
    """
    wide = bits // 4
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substring(one, i * wide + 1, F.lit(wide)) == F.substring(other, i * wide + 1, F.lit(wide))))
    chance = 2.0**-bits
    unbiased = (agree / F.lit(float(bins)) - chance) / (1 - chance)
    return F.when(one == other, F.lit(1.0)).when((one == "") | (other == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unbiased)))


def following(keys: DataFrame, order: list[str], tasks: int) -> DataFrame:
    """``keys`` with ``before`` and ``after``: structs of the neighbouring rows in ``order``, the ends joined.

    Rows are range-partitioned and numbered inside their range; only the first and
    last row of each range meet in one small table.
    """
    row = F.struct(*keys.columns)
    ranged = stage(keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*order)
    ends = ranged.groupBy("__part").agg(F.min(F.struct(*order, row.alias("it"))).alias("lo"), F.max(F.struct(*order, row.alias("it"))).alias("hi"))
    parts = Window.orderBy("__part")
    every = Window.partitionBy()
    # One row per range.
    borders = ends.select(
        "__part", F.coalesce(F.lag(F.col("hi.it")).over(parts), F.max_by(F.col("hi.it"), "__part").over(every)).alias("__previous"),
        F.coalesce(F.lead(F.col("lo.it")).over(parts), F.min_by(F.col("lo.it"), "__part").over(every)).alias("__next"),
    )
    both = ranged.withColumn("__before", F.lag(row).over(inside)).withColumn("__after", F.lead(row).over(inside)).join(borders, "__part")
    return both.select(*keys.columns, F.coalesce("__before", "__previous").alias("before"), F.coalesce("__after", "__next").alias("after"))


def fingerprint_edits(docs: DataFrame, words: int = SHINGLE_WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every document and of its edited text, with estimated likenesses.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text is the text whose last quarter (rounded down, in code
    points) is replaced by as many first characters of the next document (or all);
    next by ascending id, after the last the first.

    Null text counts as empty and has an empty fingerprint. Null ids sort last, rows
    that share an id by a checksum of their text; a single document follows itself.
    Rows equal in id and text
    count as one document and repeat in the result. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("sig"), text.alias("text"))
    distinct = texts.groupBy("doc", "sig", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("copies"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = stage(following(distinct, ["doc", "sig"], tasks).select("doc", "sig", "n", "copies", "before", "after"))
    placed = texts.join(places, ["doc", "sig"])
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = placed.select(F.col("before.doc").alias("doc"), F.col("before.sig").alias("sig"), F.substring("text", F.lit(1), quarter(F.col("before.n"))).alias("head"))
    heads = heads.groupBy("doc", "sig").agg(F.first("head").alias("head"))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n") - quarter(F.col("n"))).cast("int"))
    edited = placed.join(heads, ["doc", "sig"]).select("doc", "sig", "n", "copies", F.col("after.doc").alias("next_doc"), F.col("after.sig").alias("next_sig"), "text", F.concat(kept, "head").alias("edited"))
    both = edited.select("doc", "sig", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v"))
    found = minima(both.select("doc", "sig", "v.which", "v.text"), ["doc", "sig", "which"], "text", words, bins)
    prints = found.select("doc", "sig", "which", packed(low_bits(densified(F.col("minima"), bins), bits), bits).alias("print"))
    prints = prints.groupBy("doc", "sig").agg(F.max(F.when(F.col("which") == 0, F.col("print"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("print"))).alias("edited_fingerprint"))
    digests = edited.groupBy("doc", "sig", "n", "copies", "next_doc", "next_sig").agg(F.first(F.sha2("edited", 256)).alias("edited_sha256"))
    done = stage(digests.join(prints, ["doc", "sig"]))
    after = done.select(F.col("doc").alias("next_doc"), F.col("sig").alias("next_sig"), F.col("fingerprint").alias("next_fingerprint"))
    rows = done.join(after, ["next_doc", "next_sig"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        F.when(F.col("doc") < LAST_ID, F.col("doc")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), bins, bits).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), bins, bits).alias("near_next"),
    )
