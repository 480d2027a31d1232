"""Exact top-k by inner product: M-trees of stored pages, searched best-first.

Every component x becomes floor(256 * x). Rows are dealt to shards; each shard's distinct
vectors form an M-tree over the Euclidean distance of y = (x, sqrt(M^2 - |x|^2)), M the longest
vector's length, in which the nearest to (q, 0) has the largest inner product with q. The tree
is built once, and its nodes are written as pages of a table: a routing entry stores a pivot, its
covering radius and its distance to the parent pivot, a leaf entry its vector and its distance
to the leaf's pivot. A search gets a shard's pages and decodes only those it opens. It opens
pages by their smallest possible distance, skips the entries whose stored distance to the parent
pivot already rules them out for a query (no distance to them is computed), and stops when no
page can hold a better or equal score. Scores are integers; bounds leave slack for rounding.

Blocks of the stated query set are dealt to every shard by its number, without a join, and a
shard's blocks to several tasks. Each query of a block has its own bounds. Equal vectors of a
shard are one entry with its first 2k ids: more cannot be among the first k, whichever id is
the query's own.

Edge cases: vectors that are null, that hold a null or a non-finite component, and rows without
an id take no part; an empty vector has score 0 with other empty ones; vectors of different
lengths are not compared; rows with the query's own id are no candidates, repeated ids included;
a candidate row given several times is several candidates, a query row given several times is
asked and answered several times; ties go to the smaller id; other columns are not looked at; an
empty table gives no row. Components too large for doubles to multiply exactly are multiplied as
whole numbers; a score beyond a long raises OverflowError.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphloom.storage import materialize

SHARD_ROWS = 8192
BLOCK_ROWS = 256
#: Blocks of queries that one task asks of one shard.
BLOCKS_PER_TASK = 64
PAGE, FANOUT = 64, 24
#: A leaf's products are made as one matrix unless the bounds leave fewer of its pairs than this.
DENSE = 0.25
FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component as whole doubles; null if the vector takes no part."""
    times = lambda x: F.lit(256.0) * x.cast("double")
    # doubles from 2**52 on are whole already, and may be too large for floor's long
    whole = F.transform(vector, lambda x: F.when(F.abs(times(x)) < F.lit(2.0**52), F.floor(times(x)).cast("double")).otherwise(times(x)))
    infinite = F.lit(float("inf"))
    return F.when(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite)), whole)


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16) if x.size and np.abs(x).max() < 1 << 15 else x


def build(x: np.ndarray, ids: list[np.ndarray], seed: int = 0) -> list[bytes]:
    """The pages of an M-tree over the rows of ``x``, all distinct; ``ids`` lists each row's ids.

    Page 0 is the root; its pivot is row 0. Every page carries what a search needs of it.
    """
    norms = (x**2).sum(1)
    top = float(norms.max())
    y = np.concatenate([x, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)
    rng, pages = np.random.default_rng(seed), []

    def distances(rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((y[rows] - y[pivot]) ** 2).sum(1))

    def load(rows: np.ndarray, pivot: int) -> int:
        at = len(pages)
        pages.append(None)
        if len(rows) <= PAGE:
            pages[at] = {"x": _narrow(x[rows]), "parent": distances(rows, pivot), "ids": [ids[r] for r in rows]}
        else:
            pivots = np.sort(rng.choice(rows, FANOUT, replace=False))
            d = np.stack([distances(rows, p) for p in pivots])
            owner = d.argmin(0)
            # rows all as near to one pivot cannot be split by distance: deal them out
            if np.bincount(owner, minlength=FANOUT).max() == len(rows):
                owner = np.arange(len(rows)) % FANOUT
            parts = [(p, rows[owner == k], d[k, owner == k]) for k, p in enumerate(pivots.tolist()) if (owner == k).any()]
            own = np.array([p for p, _, _ in parts])
            pages[at] = {"x": _narrow(x[own]), "parent": distances(own, pivot), "radius": np.array([r.max() for *_, r in parts]), "children": [load(part, p) for p, part, _ in parts]}
        return at

    load(np.arange(len(x)), 0)
    pages[0] |= {"top": top, "pivot": x[0], "largest": float(np.abs(x).max(initial=0))}
    return [pickle.dumps(p) for p in pages]


class MTree:
    """Stored pages, decoded when opened. ``work`` counts the distances and scores computed."""

    def __init__(self, pages: list[bytes]):
        self._stored, self._open = pages, {}
        root = self.page(0)
        self.top, self.pivot, self.largest = root["top"], root["pivot"], root["largest"]
        self.work: Counter = Counter()

    def page(self, at: int) -> dict:
        if at not in self._open:
            page = pickle.loads(self._stored[at])
            page["x"] = page["x"].astype(np.float64)
            self._open[at] = page
        return self._open[at]

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[list[tuple[int, int]]]:
        """The k best (score, id) of each query, its own id left out.

        A block of queries descends together, each with its own bounds: the page with the
        smallest bound any query has is opened next, for the queries it can still serve.
        """
        n = len(queries)
        qq = (queries**2).sum(1)
        slack = 1e-7 * (1.0 + np.sqrt(qq + self.top))
        limit, worst = np.full(n, np.inf), np.full(n, -np.inf)
        best: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (-score, id), in order
        # products of doubles are exact below 2**53; beyond, scores are computed as whole numbers
        exact = self.largest * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2**53

        def distances(who: np.ndarray, x: np.ndarray) -> np.ndarray:
            self.work["distances"] += len(who) * len(x)
            return np.sqrt(np.maximum(qq[who, None] + self.top - 2.0 * (queries[who] @ x.T), 0.0))

        def scores_of(who: np.ndarray, x: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(place in who, row, score) of the pairs that are needed."""
            if not exact:
                i, r = np.nonzero(need)
                self.work["scores"] += len(i)
                return i, r, np.array([sum(int(a) * int(b) for a, b in zip(queries[who[a_]], x[b_])) for a_, b_ in zip(i, r)], object)
            if need.mean() < DENSE:
                i, r = np.nonzero(need)
                self.work["scores"] += len(i)
                return i, r, np.einsum("ij,ij->i", queries[who[i]], x[r])
            rows = np.flatnonzero(need.any(0))
            self.work["scores"] += len(who) * len(rows)
            products = queries[who] @ x[rows].T
            i, r = np.nonzero((products >= worst[who, None]) & need[:, rows])
            return i, rows[r], products[i, r]

        heap = [(0.0, 0, np.arange(n), np.zeros(n), distances(np.arange(n), self.pivot[None])[:, 0])] if n else []
        while heap:
            bound, at, who, bounds, to_pivot = heapq.heappop(heap)
            if bound > limit.max():
                break
            on = bounds <= limit[who]
            who, to_pivot = who[on], to_pivot[on]
            if not len(who):
                continue
            page = self.page(at)
            reach = limit[who, None]
            apart = np.abs(page["parent"][None] - to_pivot[:, None])
            if "ids" in page:
                i, r, s = scores_of(who, page["x"], apart <= reach)
                good = s >= worst[who[i]]
                for a, b, v in zip(who[i[good]].tolist(), r[good].tolist(), s[good].tolist()):
                    best[a] += [(-int(v), w) for w in page["ids"][b].tolist() if w != own[a]]
                for q in np.unique(who[i[good]]).tolist():
                    found = best[q]
                    found.sort()
                    del found[k:]
                    if len(found) == k:
                        worst[q] = -found[-1][0] if exact else -np.inf
                        limit[q] = np.sqrt(max(qq[q] + self.top + 2.0 * found[-1][0], 0.0)) + slack[q]
                continue
            lower = np.maximum(apart - page["radius"][None], 0.0)
            near = np.flatnonzero((lower <= reach).any(0))
            d = distances(who, page["x"][near])
            lower = np.maximum(np.maximum(d - page["radius"][near][None], 0.0), lower[:, near])
            for j, c in enumerate(near.tolist()):
                if len(to := np.flatnonzero(lower[:, j] <= limit[who])):
                    heapq.heappush(heap, (float(lower[to, j].min()), page["children"][c], who[to], lower[to, j], d[to, j]))
        return [[(-s, v) for s, v in found] for found in best]


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, size, page, payload): the pages of one M-tree a shard and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, by_size = TaskContext.get().partitionId(), {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == size))
                counts = np.minimum(part.column(2).to_numpy(), k)
                by_size.setdefault(size, []).append((part.column(0).to_numpy(), _numbers(part.column(1), size), counts))
        for size, parts in sorted(by_size.items()):
            ids, x, times = (np.concatenate(c) for c in zip(*parts))
            x, row = np.unique(x, axis=0, return_inverse=True) if size else (x[:1], np.zeros(len(ids), int))
            row, ids = np.repeat(row.ravel(), times), np.repeat(ids, times)
            order = np.lexsort((ids, row))
            cuts = np.flatnonzero(np.diff(row[order])) + 1
            pages = build(x, [part[: 2 * k] for part in np.split(ids[order], cuts)])
            cols = [pa.array([shard] * len(pages), pa.int32()), pa.array([size] * len(pages), pa.int32()), pa.array(range(len(pages)), pa.int32()), pa.array(pages, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "size", "page", "payload"])

    counted = materialize(vectors.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "vectors")
    shards = max(1, -(-counted.count() // shard_rows))
    dealt = counted.repartition(shards, F.xxhash64("vec_id", "v"))
    return materialize(dealt.mapInArrow(run, "shard int, size int, page int, payload binary"), "pages")


def _blocks(queries: DataFrame, block_rows: int) -> DataFrame:
    """(size, block, payload): up to ``block_rows`` queries of one vector length, each with a row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, block = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId() << 20
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == size))
                ids, x = part.column(0).to_numpy(), _numbers(part.column(1), size)
                for i in range(0, len(ids), block_rows):
                    some = ids[i : i + block_rows]
                    payload = pickle.dumps((np.arange(at, at + len(some)), some, _narrow(x[i : i + block_rows])))
                    at, block = at + len(some), block + 1
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["size", "block", "payload"])

    return materialize(queries.mapInArrow(run, "size int, block bigint, payload binary"), "blocks")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each row of ``queries``.

    Both have vec_id and embedding.
    """
    taking = lambda df: df.select(F.col("vec_id").cast("bigint"), scaled(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    pages = build_index(taking(vectors), k, shard_rows)
    blocks = _blocks(taking(queries), block_rows)
    shards = (pages.agg(F.max("shard")).first()[0] or 0) + 1
    slices = max(1, -(-blocks.count() // BLOCKS_PER_TASK))
    part = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice")
    # a shard's pages first, then each block of its slice: the pages of one shard are in memory
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part, "size", F.lit(1).alias("kind"), F.lit(0).alias("page"), "payload")
    held = pages.select("shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "size", F.lit(0).alias("kind"), "page", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stored, tree = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("shard", "slice", "size", "kind"))))
            for (*group, kind), payload in zip(keys, b.column("payload")):
                if group != at:
                    at, stored, tree = group, [], None
                if kind == 0:
                    stored.append(payload.as_py())
                    continue
                if not stored:  # no vector of this length in the shard
                    continue
                tree = tree or MTree(stored)
                number, own, x = pickle.loads(payload.as_py())
                found = tree.search(x.astype(np.float64), k, own)
                rows = [(n, i, v, s) for n, i, best in zip(number.tolist(), own.tolist(), found) for s, v in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), (), ()))], names=["query_row", "query_id", "vec_id", "score"])

    work = held.unionByName(asked)
    found = work.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "size", "kind", "page").mapInArrow(run, FOUND)
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, len(embedding) AS size, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.row, q.vec_id AS query_id, v.vec_id, CASE WHEN q.size = 0 THEN 0 ELSE CAST(list_inner_product(q.x, v.x) AS BIGINT) END AS score
        FROM v q JOIN v ON v.vec_id <> q.vec_id AND v.size = q.size WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
