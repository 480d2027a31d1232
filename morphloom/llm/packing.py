"""Best-fit packing of documents into training sequences (vector bin packing).

A bin (sequence) has three residual capacities: tokens, documents and attention cost (the sum
of squared segment lengths). Items are taken by decreasing length; each goes to the open bin
that can hold it under every constraint and is left with the smallest weighted residual norm
(``rule="norm"``) or the smallest weighted dot-product of residual and demand (``rule="dot"``).

Edge cases: a null or empty text has only its end id and is packed like any other; repeated
rows are packed separately; a null ``doc_id`` is kept; an empty table gives no row. Only
documents of more than ``max_tokens`` ids are cut: all pieces but the first are full, the first
holds the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.llm import bpe
from morphloom.storage import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
ITEMS_PER_TASK = 16_384


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones after a first that may be shorter."""
    first = n % most or most
    return [(0, first), *((s, most) for s in range(first, n, most))]


def token_pieces(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, cache_entries: int = bpe.CACHE_ENTRIES) -> DataFrame:
    """One row for each piece of each document, whole texts encoded; ``cache_entries`` bounds what the encoder remembers."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.load(vocabulary, cache_entries)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, max_tokens)):
                    for col, v in zip(rows, (key, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def best_fit(
    lengths: np.ndarray,
    capacity: tuple[float, float, float],
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` in the order in which items are to be placed.

    Residuals and demands are fractions of their capacities, so that the weights compare them.
    A bin too full for the shortest item to come is closed and no longer looked at.
    """
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)[:, None]
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    rest, ids = np.empty((3, max(16, n))), np.empty(max(16, n), np.int64)
    used = np.zeros(n, np.int64)
    shortest = np.minimum.accumulate(lengths[::-1])[::-1] if n else lengths
    open_, made, slack = 0, 0, 1e-9
    for i, length in enumerate(lengths.tolist()):
        need = np.array([[length], [1.0], [float(length) ** 2]]) / cap[:, None]
        if (need > 1 + slack).any():
            raise ValueError(f"an item of {length} tokens exceeds an empty sequence")
        now = rest[:, :open_]
        fits = (now >= need - slack).all(axis=0)
        at = np.flatnonzero(fits)
        if len(at):
            left = now[:, at]
            score = (w * (left - need) ** 2).sum(0) if rule == "norm" else (w * left * need).sum(0)
            k = int(at[score.argmin()])
        else:
            k, made = open_, made + 1
            rest[:, k], ids[k] = 1.0, made - 1
            open_ += 1
        b = ids[k]
        bins[i], offsets[i] = b, used[b]
        used[b] += length
        rest[:, k] -= need[:, 0]
        smallest = shortest[i + 1] if i + 1 < n else 0
        if rest[0, k] * cap[0] < smallest - 1e-6 or rest[1, k] * cap[1] < 1 - 1e-6 or rest[2, k] * cap[2] < smallest**2 - 1e-3:
            open_ -= 1
            rest[:, k], ids[k] = rest[:, open_], ids[open_]
    return bins, offsets


def pack(
    pieces: DataFrame,
    max_tokens: int = 2048,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    Pieces are dealt evenly to tasks by a hash of (doc_id, piece); each task packs its own by
    decreasing length, so that all a task leaves open is its last bins. The number of tasks
    follows the number of pieces. ``None`` leaves documents or attention cost unconstrained.
    """
    cap = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    # 16k items of one task leave a bin or two open; more tasks would leave more bins open
    tasks = max(1, -(-pieces.count() // items_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(t.column("length").to_numpy(), cap, weights, rule)
        first = TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from t.combine_chunks().to_batches(max_chunksize=50_000)

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece"))
    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, cache_entries: int = bpe.CACHE_ENTRIES, **limits) -> DataFrame:
    """Encode whole texts, cut the long ones and pack all pieces; texts are encoded once."""
    pieces = materialize(token_pieces(docs, vocabulary, max_tokens, end_id, cache_entries), "pieces")
    return pack(pieces, max_tokens, **limits)
