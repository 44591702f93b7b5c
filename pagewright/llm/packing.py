"""Best-fit packing of tokenised documents into sequences of bounded length.

Sequences are planned over the histogram of piece lengths, whose size is bounded by the sequence length, and not over
documents. The plan gives each length ranges of slots; a piece takes the slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pagewright.llm import words
from pagewright.llm.store import widened, written

CAPACITY = 2048
END = 0

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SURE = "A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\u024f"  # letters and digits under anyone's rules
#: The byte-level tokenizer never joins letters across these parts, so each part has its own ids: a word with the space before
#: it, a full stop or comma after it, and runs of white space.
_PARTS = re.compile(rf" ?[{_SURE}]+(?![^{_SPACE}.,])|(?<=[{_SURE}])[.,](?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class Encoder:
    """Ids of texts by a byte-level tokenizer file, each part of a text looked up or encoded once while it is remembered."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # names of special tokens in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.remember = remember
        self.line = self._encode("\n")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each worker process."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str]) -> None:
        """Encode parts that aren't known, on one line each; a line feed before a word is a token of its own."""
        words = [p for p in new if not p.isspace()]
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        for lines, made in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(made.ids, "<u4")
            cuts = np.flatnonzero(ids == self.line[0])
            if len(self.line) == 1 and len(cuts) == len(lines) - 1:
                raw, a = ids.tobytes(), 0
                for p, b in zip(lines, [*(4 * cuts).tolist(), 4 * len(ids)]):
                    self.known[p] = raw[a:b]
                    a = b + 4
        for p in new:
            if p not in self.known:
                self.known[p] = np.array(self._encode(p), "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.remember:
            self.known.clear()
        known, find = self.known, _PARTS.findall
        parts = [find(t) for t in texts]
        out = [list(map(known.get, own)) for own in parts]
        lacking = [k for k, got in enumerate(out) if None in got]
        new = list(dict.fromkeys(p for k in lacking for p, raw in zip(parts[k], out[k]) if raw is None))
        if new:
            self._learn(new)
            for k in lacking:
                out[k] = list(map(known.__getitem__, parts[k]))
            for p in new:
                if len(p) > 64:
                    del known[p]
        return [b"".join(got) for got in out]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids) of every document: its ids and one ``end``, cut only if longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers. All pieces but the first have ``capacity`` ids. Null and empty texts
    are one piece with the end alone; repeated rows stay; no rows give no rows. Other columns are ignored.
    """
    schema = widened(docs.select(F.col(id_col).alias("id")), "piece int, start long, length long, ids binary")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder.of(tokenizer)
        for batch in words.slices(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for lo, hi in words.groups(texts, 1 << 20):
                rows: list[tuple] = []
                for at, raw in enumerate(encoder.ids(texts[lo:hi]), lo):
                    ids = raw + last
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    bounds = [0, *range(first, n + 1, capacity)]
                    rows += [(at, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                own, piece, start, length, cut = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(cut, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots by best fit, longest first, over counts of lengths.

    Rows (length, rank, sequence, each, offset), sorted: from ``rank`` on, the pieces of a length fill the sequences from
    ``sequence`` on with ``each`` pieces a sequence, side by side from ``offset``.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    spaces: list[int] = []  # free space of open sequences, sorted
    ranges: dict[int, list[tuple[int, int]]] = {}  # free space: ranges of sequences (first, how many)
    made = 0

    def leave(space: int, first: int, many: int) -> None:
        if space and many:
            if space not in ranges:
                insort(spaces, space)
            ranges.setdefault(space, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit sequences of {capacity}")
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = ranges[space].pop()
                if not ranges[space]:
                    del ranges[space], spaces[at]
            else:
                space, first = capacity, made
                many = -(-left // (capacity // length))
                made += many
            each = space // length
            full = min(many, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - space))
                rank, left = rank + full * each, left - full * each
                leave(space - each * length, first, full)
            if full < many and left:  # fewer pieces than one sequence has room for
                rows.append((length, rank, first + full, left, capacity - space))
                leave(space - left * length, first + full, 1)
                full, left = full + 1, 0
            leave(space, first + full, many - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length``, each with its ``sequence_id`` and its ``offset`` there, gapless from 0.

    A hot length is ranked in parts: a piece's rank is its rank within a part, chosen by hash, after the pieces of the
    parts before. Other columns are carried along.
    """
    rows = written(cut)
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, capacity)
    parts = 64 + sum(histogram.values()) // 1_000_000
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in cut.columns])
    dealt = rows.withColumn("_mark", mark).withColumn("_part", F.pmod("_mark", F.lit(parts)))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_part").agg(F.count("*").alias("n")).select("length", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_mark")) - 1
    ranked = dealt.withColumn("_own", own).join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_own"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(), rank.to_numpy()
        row = slots[np.searchsorted((slots[:, 0] << 44) + slots[:, 1], (length << 44) + rank, side="right") - 1]
        k = rank - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + k // row[:, 3], "offset": row[:, 4] + k % row[:, 3] * length})

    return ranked.withColumn("_slot", slot("length", "_rank")).select(*[f"`{c}`" for c in cut.columns], "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents with their ids and places; see :func:`pieces` and :func:`place`."""
    return place(pieces(docs, tokenizer, id_col, text_col, capacity, end), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the ids of each sequence joined in order, and where its pieces start."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.offset").alias("starts")
    )
