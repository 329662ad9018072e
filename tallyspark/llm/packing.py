"""Bounded-space online packing of documents into sequences of a fixed number of ids.

Each partition of the input keeps `open_windows` unfinished sequences.  A document's full windows become sequences of
their own; its rest goes to the open window that it fits best.  If it fits none and all windows are in use, the fullest
is emitted: completed with the head of the rest if its gap has `min_cut` ids or more, as it is otherwise.  At the end of
a partition the open windows fill each other's gaps, so that one of them at most is left; these leftovers, one for each
partition, are merged in the same way `fan_in` at a time until one is left, which becomes the last sequence.  Nothing
but leftovers leaves its partition, and a task holds `open_windows` (or `fan_in`) windows at most.

Cases.  A null or empty text is its end id alone; null and repeated doc_ids are packed like any other; an empty table
gives no rows; very long texts are cut into full windows.  Columns beside doc_id and text are not read, so their names do not
matter.  `sequence_id` numbers are unique but not dense: the high bits
tell the task, so that a repeated task gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.encoding import encoded, encoder
from tallyspark.llm.work import staged, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
ARROW = pa.schema([*((k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")), ("ids", pa.binary())])
PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Packer:
    """Open windows of one task.  A piece is (doc_id, start, ids, doc_tokens); finished pieces gather in `rows`."""

    def __init__(self, part: int, length: int, open_windows: int, min_cut: int):
        self.part, self.length, self.most, self.min_cut = part, length, open_windows, min_cut
        self.windows: dict[int, list] = {}  # by number, its pieces
        self.gaps: list[tuple[int, int]] = []  # (gap, number), ascending
        self.opened = self.sequences = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list, numbered: bool = True) -> None:
        at, number = 0, None
        if numbered:
            number = (self.part << 32) + self.sequences
            self.sequences += 1
        for doc_id, start, ids, doc_tokens in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), doc_tokens, number, at, self.part, None if numbered else ids.astype("<u4").tobytes()))
            at += len(ids)

    def document(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.length
        for i in range(0, whole, self.length):
            self.emit([(doc_id, i, ids[i : i + self.length], len(ids))])
        if whole < len(ids):
            self.place((doc_id, whole, ids[whole:], len(ids)))

    def into(self, k: int, piece) -> None:
        """Put `piece` into the window at place `k` of the gaps; it fits."""
        gap, number = self.gaps.pop(k)
        self.windows[number].append(piece)
        if gap == len(piece[2]):
            self.emit(self.windows.pop(number))
        else:
            insort(self.gaps, (gap - len(piece[2]), number))

    def place(self, piece) -> None:
        while True:
            doc_id, start, ids, doc_tokens = piece
            k = bisect_left(self.gaps, (len(ids), -1))
            if k < len(self.gaps):
                return self.into(k, piece)
            if len(self.gaps) < self.most:
                self.windows[self.opened] = []
                insort(self.gaps, (self.length, self.opened))
                self.opened += 1
                continue
            gap = self.gaps[0][0]
            if gap < self.min_cut:
                self.emit(self.windows.pop(self.gaps.pop(0)[1]))
            else:
                self.into(0, (doc_id, start, ids[:gap], doc_tokens))
                piece = (doc_id, start + gap, ids[gap:], doc_tokens)

    def close(self, last: bool) -> None:
        """The emptiest windows fill the gaps of the fullest; what is left is emitted without a number unless `last`."""
        while len(self.gaps) > 1:
            for doc_id, start, ids, doc_tokens in self.windows.pop(self.gaps.pop()[1]):
                while len(ids) and self.gaps:
                    take = min(self.gaps[0][0], len(ids))
                    self.into(0, (doc_id, start, ids[:take], doc_tokens))
                    start, ids = start + take, ids[take:]
                if len(ids):  # every other window is full
                    self.windows.setdefault(self.opened, []).append((doc_id, start, ids, doc_tokens))
            if self.opened in self.windows:
                self.gaps.append((self.length - sum(len(x[2]) for x in self.windows[self.opened]), self.opened))
                self.opened += 1
        for _, number in self.gaps:
            self.emit(self.windows.pop(number), numbered=last)
        self.gaps = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _pack(batches, tokenizer: str, end_id: int, split: str | None, length: int, open_windows: int, min_cut: int):
    packer = Packer(TaskContext.get().partitionId(), length, open_windows, min_cut)
    end = np.array([end_id], encoder(tokenizer, split).dtype)
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), encoded(batch.column(1), tokenizer, split)):
            packer.document(doc_id, np.concatenate([np.frombuffer(raw, end.dtype), end]))
        yield _batch(packer.taken())
    packer.close(last=False)
    yield _batch(packer.taken())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW.field(i).type) for i in range(len(ARROW))], schema=ARROW)


def _merging(first: int, length: int, open_windows: int, min_cut: int, last: bool):
    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        packer = Packer(first + key[0].as_py(), length, open_windows, min_cut)
        for r in rows.sort_by([("part", "ascending"), ("offset", "ascending")]).to_pylist():
            packer.place((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]))
        packer.close(last)
        return pa.Table.from_batches([_batch(packer.taken())])

    return merge


def pack(df: DataFrame, tokenizer: str, end_id: int, split: str | None = None, length: int = 2048, open_windows: int = 64, min_cut: int = 16, fan_in: int = 64) -> DataFrame:
    """Pieces of all rows of `df` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A gap of fewer than `min_cut` ids is left as padding rather than filled by cutting a document.
    """
    schema = SCHEMA
    done = staged(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _pack(b, tokenizer, end_id, split, length, open_windows, min_cut), schema), "packed")
    out = [done.where("sequence_id is not null").select(PIECES)]
    left = done.where("sequence_id is null")
    tasks = left.agg(F.max("part")).first()[0]
    first, n = 0, 0 if tasks is None else tasks + 1
    base = n
    while n:
        groups = -(-n // fan_in)
        grouped = left.withColumn("group", F.floor((F.col("part") - F.lit(first)) / fan_in)).groupBy("group")
        merged = grouped.applyInArrow(_merging(base, length, open_windows, min_cut, groups == 1), schema)
        merged = staged(merged, "merged")
        out.append(merged.where("sequence_id is not null").select(PIECES))
        left, first, base, n = merged.where("sequence_id is null"), base, base + groups, 0 if groups == 1 else groups
    for more in out[1:]:
        out[0] = out[0].unionAll(more)
    return out[0]


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 2048 ids at most, a row for each piece."""
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, split="spaces")
