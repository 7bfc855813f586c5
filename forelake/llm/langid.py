"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN, SPAN = 8, 128
#: The training sample: documents per language, and stretches of SPAN bytes from each.
DOCS_PER_LANGUAGE, STRETCHES = 400, 6
STEPS, BATCH, RATE = 300, 128, 0.02
#: Spans that run side by side at prediction.
WIDE = 2048
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes that belong to letters: A-Z, a-z and every byte of a character beyond ASCII.
_LETTER_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)], dtype=np.float32)


@dataclass
class Direction:
    """One direction's gates: input table by byte, recurrent weights; rows are reset, update, candidate."""

    table: np.ndarray  # 3H x 256
    turn: np.ndarray  # 3H x H


@dataclass
class Network:
    ahead: Direction
    back: Direction
    out: np.ndarray  # classes x (2H + 1)
    languages: list[str]


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): a candidate activation several times cheaper than tanh; ``x`` is overwritten."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=x)


def _run(d: Direction, spans: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states after each byte (positions x batch x H); spans: positions x batch."""
    length, batch = spans.shape
    n = d.turn.shape[1]
    table, turn = np.ascontiguousarray(d.table.T), np.ascontiguousarray(d.turn.T)
    states = np.empty((length, batch, n), np.float32)
    h = np.zeros((batch, n), np.float32)
    where = spans.astype(np.intp)
    for t in range(length):
        x = np.take(table, where[t], axis=0)
        u = h @ turn
        gates = _squash(x[:, : 2 * n] + u[:, : 2 * n])
        gates *= 0.5
        gates += 0.5
        reset, update = gates[:, :n], gates[:, n:]
        candidate = _squash(x[:, 2 * n :] + reset * u[:, 2 * n :])
        new = h - candidate
        new *= update
        new += candidate
        if keep is not None:
            keep.append((h, reset, update, candidate, u[:, 2 * n :]))
        states[t] = h = new
    return states


def _unroll(d: Direction, spans: np.ndarray, kept: list, grads: np.ndarray) -> Direction:
    """Backpropagation through time: gradients of the direction's weights."""
    n, batch = d.turn.shape[1], spans.shape[1]
    table, turn, back = np.zeros_like(d.table), np.zeros_like(d.turn), np.zeros((batch, n), np.float32)
    seen = []
    slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
    for t in reversed(range(len(kept))):
        h, reset, update, candidate, u = kept[t]
        g = grads[t] + back
        a_candidate = g * (1 - update) * (1 - np.abs(candidate)) ** 2
        a_reset = a_candidate * u * slope(reset)
        a_update = g * (h - candidate) * slope(update)
        inputs = np.concatenate((a_reset, a_update, a_candidate), axis=1)
        recurrent = np.concatenate((a_reset, a_update, a_candidate * reset), axis=1)
        seen.append(inputs)
        turn += recurrent.T @ h
        back = g * update + recurrent @ d.turn
    read = spans[::-1].ravel()
    order = np.argsort(read, kind="stable")
    values, starts = np.unique(read[order], return_index=True)
    table[:, values] = np.add.reduceat(np.concatenate(seen)[order], starts, axis=0).T
    return Direction(table, turn)


def _probabilities(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """classes x positions x batch."""
    length, batch, n = ahead.shape
    logits = ahead.reshape(-1, n) @ net.out[:, :n].T
    logits += back.reshape(-1, n) @ net.out[:, n : 2 * n].T
    chance = np.ascontiguousarray(logits.T)
    chance += net.out[:, -1:]
    np.clip(chance, -40, 40, out=chance)
    np.exp(chance, out=chance)
    chance /= chance.sum(axis=0)
    return chance.reshape(-1, length, batch)


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, span: int = SPAN, seed: int = 0) -> Network:
    """Fits the network: every position of a stretch carries its document's language."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    spans, lengths = to_spans(texts, span)
    target = np.array([languages.index(x) for x, k in zip(labels, lengths, strict=True) for _ in range(k)], dtype=np.int64)
    used = _LETTER_BYTE[spans]
    draw = lambda *shape: random.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
    net = Network(Direction(draw(3 * hidden, 256), draw(3 * hidden, hidden)), Direction(draw(3 * hidden, 256), draw(3 * hidden, hidden)), draw(len(languages), 2 * hidden + 1), languages)
    weights = [net.ahead.table, net.ahead.turn, net.back.table, net.back.turn, net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    shares = 1 / np.maximum(1, np.bincount(target, minlength=len(languages)))
    chance = shares[target] / shares[target].sum() if len(target) else target
    for step in range(1, steps + 1 if len(spans) and len(languages) > 1 else 1):
        pick = random.choice(len(spans), batch, p=chance)
        x, y, mask = spans[pick].T, target[pick], used[pick].T
        kept_ahead, kept_back = [], []
        ahead, back = _run(net.ahead, x, kept_ahead), _run(net.back, x[::-1], kept_back)[::-1]
        wrong = _probabilities(net, ahead, back)
        wrong[y, :, np.arange(batch)] -= 1
        wrong *= mask / max(1, mask.sum())
        wrong = np.ascontiguousarray(np.moveaxis(wrong, 0, 2))
        states = np.concatenate((ahead, back, np.ones((*x.shape, 1), np.float32)), axis=2)
        g_out = np.tensordot(wrong, states, axes=((0, 1), (0, 1)))
        g_states = wrong @ net.out
        g_ahead = _unroll(net.ahead, x, kept_ahead, g_states[:, :, :hidden])
        g_back = _unroll(net.back, x[::-1], kept_back, g_states[::-1, :, hidden : 2 * hidden])
        grads = [g_ahead.table, g_ahead.turn, g_back.table, g_back.turn, g_out]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def to_spans(texts: list[bytes], span: int) -> tuple[np.ndarray, list[int]]:
    """All bytes of all texts in rows of ``span``, the last row of a text padded with 0; rows per text."""
    rows = [-(-len(t) // span) for t in texts]
    flat = b"".join(t.ljust(k * span, b"\0") for t, k in zip(texts, rows, strict=True))
    return np.frombuffer(flat, np.uint8).reshape(-1, span), rows


def pooled(net: Network, texts: list[bytes], span: int = SPAN) -> np.ndarray:
    """Mean class probabilities over the letter bytes of each text; texts x classes."""
    spans, rows = to_spans(texts, span)
    sums = np.zeros((len(spans), len(net.languages)), np.float64)
    weight = np.zeros(len(spans), np.float64)
    for at in range(0, len(spans), WIDE):
        part = spans[at : at + WIDE].T
        mask = _LETTER_BYTE[part]
        p = _probabilities(net, _run(net.ahead, part), _run(net.back, part[::-1])[::-1])
        sums[at : at + WIDE] = (p * mask).sum(axis=1).T
        weight[at : at + WIDE] = mask.sum(axis=0)
    owner = np.repeat(np.arange(len(texts)), rows)
    total = np.zeros((len(texts), len(net.languages)))
    np.add.at(total, owner, sums)
    counted = np.bincount(owner, weight, len(texts))
    return total / np.maximum(counted, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, stretches: int = STRETCHES, span: int = SPAN) -> tuple[list[bytes], list[str]]:
    """Stretches of labelled documents: at most docs_per_language * stretches * span characters per language."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.md5(F.col("doc_id").cast("string"))
    # Counts per language and leading digits tell which digits hold the sample, so only these rows are ranked, however large a language is.
    head = F.substring(order, 1, 3).alias("head")
    counts = labelled.select("lang", head).groupBy("lang", "head").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = counts.withColumn("before", before).where(F.col("before") < docs_per_language).groupBy("lang").agg(F.max("head").alias("edge"))
    place = Window.partitionBy("lang").orderBy("order", "doc_id")
    # One row per language.
    near = labelled.select("doc_id", "lang", order.alias("order"), head).join(F.broadcast(edges), "lang").where(F.col("head") <= F.col("edge"))
    chosen = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= docs_per_language).select("doc_id", "lang").distinct()
    step = F.greatest(F.lit(0), F.length("text") - span) / max(1, stretches - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(stretches - 1)), lambda i: F.substring(F.col("text"), (F.floor(step * i) + 1).cast("int"), F.lit(span)))
    # Bounded by docs_per_language rows for each language.
    found = labelled.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", F.explode(F.array_distinct(pieces)).alias("piece")).collect()
    found = sorted({(r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["piece"]) for r in found if _LETTER.search(r["piece"])})
    return [r[2].encode("utf-8", "surrogatepass")[:span] for r in found], [r[0] for r in found]


def label(net: Network, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    spoken = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if net.languages else []
    names, scores, at = [UNKNOWN] * len(texts), np.zeros(len(texts)), 0
    while at < len(spoken):
        # A few megabytes of text at a time; a longer document goes alone.
        end, size = at, 0
        while end < len(spoken) and (end == at or size + len(texts[spoken[end]]) < 4_000_000):
            size += len(texts[spoken[end]])
            end += 1
        chances = pooled(net, [texts[i].encode("utf-8", "surrogatepass") for i in spoken[at:end]])
        for i, row in zip(spoken[at:end], chances, strict=True):
            names[i], scores[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
        at = end
    return names, scores


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = label(net, [t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``.

    The network learns on the driver from a bounded sample (``docs_per_language``
    documents of each language, ``STRETCHES`` stretches of each), then reads every
    byte of every text, labels every position, and a document's score is the mean
    probability of its language over the bytes of letters. Documents whose id's
    checksum leaves 2 on division by 4 are never learnt from.

    Text that is null or has no letter gives ``und`` with score 0; so does a table
    without labelled documents. Null ids are not held out. Repeated rows repeat; an
    empty table gives no rows.
    """
    net = train(*training_sample(docs, docs_per_language))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.0, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``; all columns stay.

    Rows with ``und`` (null text or no letter) go; see ``identify``.
    """
    net = train(*training_sample(docs, docs_per_language))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = label(net, [t.as_py() for t in batch.column(place)])
            yield batch.filter(pa.array([n != UNKNOWN and s >= min_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
