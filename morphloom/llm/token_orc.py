"""Token ids in ORC: stripes with integer run-length encoding, row indexes, Bloom filters.

``write_tokens`` range-partitions whole texts by ``doc_id``, encodes each in its sorted task and
writes rows (part, doc_id, local_start, n_tokens, ids) in ascending ``doc_id`` order. ORC keeps
the ids run-length encoded by stripe, with min/max row indexes and a Bloom filter on ``doc_id``.
``read_tokens`` reads all stripes in parallel, or prunes by files, stripes and row groups when
``doc_ids`` are given. ``doc_digests`` reads a file set back and places every document in the
whole stream.

Edge cases: a null or empty text has only its end id; rows with equal ``doc_id`` stand together,
shorter text first; null ``doc_id`` comes first; other columns are not looked at; an empty table gives
an empty file set. A text's ids are one list of one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.llm import bpe
from morphloom.storage import shuffle_partitions

ROWS = "part int, doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
IDS_PER_BATCH = 2_000_000
FILE_BYTES, LEAST_BYTES = 64 << 20, 2 << 20


def _encode(vocabulary: str, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def batch_of(part: int, keys: list, starts: list, sizes: list, raw: list) -> pa.RecordBatch:
        values = pa.Array.from_buffers(pa.int32(), sum(sizes), [None, pa.py_buffer(b"".join(raw))])
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)
        cols = [pa.array([part] * len(keys), pa.int32()), *(pa.array(c, pa.int64()) for c in (keys, starts, sizes)), ids]
        return pa.RecordBatch.from_arrays(cols, schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = bpe.load(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, starts, sizes, raw, held = [], [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for col, v in zip((keys, starts, sizes, raw), (key, at, n, ids)):
                    col.append(v)
                at, held = at + n, held + n
                if held >= IDS_PER_BATCH:
                    yield batch_of(part, keys, starts, sizes, raw)
                    keys, starts, sizes, raw, held = [], [], [], [], 0
            if keys:
                yield batch_of(part, keys, starts, sizes, raw)

    return run


def file_count(docs: DataFrame) -> int:
    """A file for every ``FILE_BYTES`` of text; as many as tasks run beside each other, if none gets too small by that."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // FILE_BYTES), min(shuffle_partitions(docs.sparkSession), size // LEAST_BYTES))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, files: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Write the ids of whole texts to ``path``, one ORC file for each range of ``doc_id``."""
    ranged = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(files or file_count(docs), "doc_id")
    rows = ranged.sortWithinPartitions("doc_id", F.octet_length("text"), F.xxhash64("text")).mapInArrow(_encode(vocabulary, end_id), ROWS)
    (
        rows.write.option("orc.compress", "NONE")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .option("orc.row.index.stride", 1000)
        .option("orc.stripe.size", stripe_bytes)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of a file set; ``doc_ids`` reaches the ORC reader as a pushed filter."""
    rows = spark.read.schema(ROWS).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def part_offsets(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(part, ids in all parts before it): one row for each file is all the driver sees."""
    sizes = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, at = [], 0
    for part, n in sorted((r.part, r.n) for r in sizes):
        out.append((part, at))
        at += n
    return out


def doc_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    offsets = dict(part_offsets(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            cuts = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            n = np.diff(cuts)
            first = np.array([offsets[p] for p in b.column("part").to_pylist()], np.int64)
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            start = pa.array(first + b.column("local_start").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), start, pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
