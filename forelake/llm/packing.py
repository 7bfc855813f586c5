"""Packing documents into fixed windows of tokens, best fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
#: Most pieces that one packing task gets on average; it keeps six numbers for each.
PIECES_PER_TASK = 200_000
#: Distinct words whose ids a worker remembers.
CACHED_WORDS = 600_000
TOKENIZER = "word_bpe_49k.json"

#: Normaliser and splitting rule of the tokenizer's file.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: That rule for texts in which every character is Latin-1.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9\xb2\xb3\xb9\xbc-\xbea-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xff]|<\|")

#: A worker's encoders by path; its later tasks find the ids of frequent pieces there.
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def splits_by_rule(path: str) -> bool:
    """Whether the tokenizer's file cuts texts by the rule above, so that the ids of its pieces can be remembered."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    cut_as_expected = made.get("normalizer") == _NORMALIZER and made.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
    plain = not any(made.get(k) for k in ("post_processor", "truncation", "padding"))
    return cut_as_expected and plain and all(t["content"].startswith("<|") for t in made.get("added_tokens") or [])


def word_encoder(path: str) -> Callable[[str], bytes]:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    A tokenizer with the rule above treats the pieces between white space and class
    changes independently, so ids are remembered by piece. Texts with characters
    outside Latin-1, control characters or special tokens, and all texts of other
    tokenizers, go through the tokenizer whole.
    """
    import os

    import numpy as np

    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    by_rule = splits_by_rule(path)
    ids: dict[str, bytes] = {}

    def pack(encoding) -> bytes:
        return np.asarray(encoding.ids, dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if not by_rule or _OTHER.search(text):
            return pack(tokenizer.encode(text, add_special_tokens=False))
        pieces = _PIECES.findall(text.lower())
        try:
            return b"".join(map(ids.__getitem__, pieces))
        except KeyError:
            new = list({p for p in pieces if p not in ids})
        if len(ids) + len(new) > CACHED_WORDS:
            ids.clear()
            new = list(set(pieces))
        ids.update(zip(new, map(pack, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return b"".join(map(ids.__getitem__, pieces))

    _ENCODERS[path] = encode
    return encode


class CapacityTree:
    """Counts of open windows by remaining capacity, in a segment tree; finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open window has."""
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; ``lengths`` must not increase and lie in 1..window."""
    tree, open_bins, placed, bins = CapacityTree(window), {}, [], 0
    for length in lengths:
        capacity = tree.tightest(length)
        if capacity is None:
            number, capacity, bins = bins, window, bins + 1
        else:
            number = open_bins[capacity].pop()
            tree.change(capacity, -1)
        placed.append((number, window - capacity))
        if capacity > length:
            open_bins.setdefault(capacity - length, []).append(number)
            tree.change(capacity - length, 1)
    return placed


def cut(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """One row per piece: all full windows of a document, then its rest."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches:
            columns = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(columns, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Sequences of at most ``window`` tokens that hold every token of ``docs`` once.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Overlong documents are first cut into full windows. The pieces, without
    their text, are dealt out by document and start to as many tasks as their number needs (bounded by
    documents and bytes, so long documents count as many pieces); each task places its pieces,
    longest first, into the tightest open window, found in a segment tree over
    remaining capacities. Tasks do not share windows, so each leaves at most a few
    partly filled ones. Equal lengths go by id, start and checksum, so a repeated
    task gives the same sequences.

    Null or empty text: the end id alone. Null ids stay null. Repeated rows are
    packed as often as they occur. An empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    pieces = cut(docs, tokenizer or public_tokenizers.path(TOKENIZER), window, end_id)
    # A token takes a byte at least, so this bounds the pieces: one for each document and one for each full window.
    most, = docs.agg(F.count(F.lit(1)) + F.floor(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)) / window)).first()
    tasks = max(1, -(-most // pieces_per_task))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches), schema=_PIECE)
        if part.num_rows:
            part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
            first = TaskContext.get().partitionId() << 40
            placed = best_fit_decreasing(part.column("length").to_pylist(), window)
            part = part.append_column("sequence_id", pa.array([first + b for b, _ in placed], pa.int64()))
            part = part.append_column("offset", pa.array([o for _, o in placed], pa.int64()))
            yield from part.to_batches(max_chunksize=50_000)

    return pieces.repartition(tasks, "doc_id", "start").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
