"""Token files: flat unsigned ids, 64-bit document offsets, memory-mapped readers.

`write_tokens` lays a table out as `part-N.ids` (ids of all documents, end to end, in 16 bits where the vocabulary
fits, else 32), `part-N.off` (64-bit offsets, one more than documents) and `part-N.doc` (64-bit document numbers).
Parts are ranges of ascending doc_id; the base of a part among all ids is the prefix sum of the parts before it, and is
kept in the index table beside the files, so a reader finds any document with two array look-ups.

Cases.  A null text is empty and still gets its end id; a null doc_id sorts first and is stored as the smallest 64-bit
number; repeated doc_ids lie next to each other in the order of their texts' hashes; an empty table makes no parts.
Columns beside doc_id and text are not read, so their names do not matter.  Parts hold `PART_BYTES` of text or less on
average, however large the table is.
A task writes under a name of its own and renames when it is done, so that a repeated or speculative task replaces a
part with the same bytes.
"""

from __future__ import annotations

import itertools
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.encoding import encoded, encoder
from tallyspark.llm.work import fresh_path, table

NULL_ID = -(1 << 63)
PART_BYTES = 256 << 20
INDEX_SCHEMA = "part int, docs long, tokens long, width int"


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, split: str | None = None, partitions: int | None = None) -> None:
    """Encode `text` of every row of `df` (doc_id, text) and write token files under the URI `path`, in doc_id order.

    `end_id` closes each document; `split` is the kind of tokenizer (see `encoding.SPLITS`).
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    ordered = ["doc_id", "tie"]
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    parts = rows.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered).select("doc_id", "text")
    index = parts.mapInArrow(lambda batches: _write_part(batches, path, tokenizer, end_id, split), INDEX_SCHEMA).collect()
    total, rows = 0, []
    for r in sorted(index, key=lambda r: r.part):  # a row for each file, not for each document
        rows.append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "width": r.width, "base": total})
        total += r.tokens
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/index.json") as out:
        out.write(json.dumps(rows).encode())


def _write_part(batches, path: str, tokenizer: str, end_id: int, split: str | None):
    part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
    batches = (b for b in batches if b.num_rows)
    first = next(batches, None)
    if first is None:
        return
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    dtype = encoder(tokenizer, split).dtype
    end, tokens, docs = np.array([end_id], dtype).tobytes(), 0, 0
    names = {k: f"{root}/_{own}.{k}" for k in ("ids", "off", "doc")}
    with fs.open_output_stream(names["ids"]) as ids, fs.open_output_stream(names["off"]) as off, fs.open_output_stream(names["doc"]) as doc:
        off.write(np.zeros(1, "<i8").tobytes())
        for batch in itertools.chain([first], batches):
            doc.write(batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs += batch.num_rows
            ends = []
            for raw in encoded(batch.column(1), tokenizer, split):
                ids.write(raw)
                ids.write(end)
                tokens += len(raw) // dtype.itemsize + 1
                ends.append(tokens)
            off.write(np.array(ends, "<i8").tobytes())
    for kind, name in names.items():
        fs.move(name, f"{root}/part-{part:06d}.{kind}")
    yield pa.RecordBatch.from_pylist([{"part": part, "docs": docs, "tokens": tokens, "width": dtype.itemsize}], pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]))


def mapped(fs, name: str, dtype: str):
    """A reader of entries `a` to `b` of the file: from a map where the file system is mounted, by ranges otherwise."""
    if isinstance(fs, pafs.LocalFileSystem):
        array = np.memmap(name, dtype, "r")
        return lambda a, b: array[a:b]
    file, size = fs.open_input_file(name), np.dtype(dtype).itemsize
    return lambda a, b: np.frombuffer(file.read_at((b - a) * size, a * size), dtype)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over 32-bit little-endian ids), from the files."""
    fs, root = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(f"{root}/index.json") as f:
        index = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = [(r["part"], r["base"], r["width"], r["docs"]) for r in index]
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(rows, "part int, base long, width int, docs long").repartition(len(rows))
    return files.mapInArrow(lambda batches: _read_parts(batches, path), schema)


def _read_parts(batches, path: str, docs_at_once: int = 5_000):
    fs, root = pafs.FileSystem.from_uri(path)
    for row in (r for b in batches for r in b.to_pylist()):
        name = f"{root}/part-{row['part']:06d}"
        ids, off, doc = mapped(fs, f"{name}.ids", f"<u{row['width']}"), mapped(fs, f"{name}.off", "<i8"), mapped(fs, f"{name}.doc", "<i8")
        for i in range(0, row["docs"], docs_at_once):
            end = min(i + docs_at_once, row["docs"])
            some, bounds = np.array(doc(i, end)), np.array(off(i, end + 1))
            crc = [zlib.crc32(ids(a, b).astype("<u4")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, split="words")
    return read_tokens(spark, path)
