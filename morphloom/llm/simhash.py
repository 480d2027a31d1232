"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees.

Fingerprints are cut into ``radius + 1`` blocks of bits. Two within the radius agree on one block
at least, so each fingerprint goes to one shard for each block, named by as many bits of the block
as leave some ``PAGE`` fingerprints in a shard. A shard's distinct fingerprints form a BK-tree,
children keyed by their integer Hamming distance to the parent; all members ask it together,
following only edges within the radius of their own distance to the node. A shard of many pages
is cut again by the whole block and by blocks of the other bits; what is still larger than a page
is split into pages, each pair of pages one unit of work: the tree of one page, asked by the other.
No task holds an unbounded group. Trees are not broadcast, since all together they have no bound;
fingerprints travel to their shards instead. A unit returns only a spanning forest of its links.
Components come from large-star/small-star rounds over those links.

Edge cases: null or empty texts and texts of blanks have fingerprint zero and are linked like
any other; repeated rows and ties share a fingerprint and so a component; an empty table gives
no row; rows with a null ``doc_id`` are kept and are named only if no other row is reachable; other
columns are not looked at. A long text's words and hashes are lists of one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.llm import bpe
from morphloom.llm.keys import fresh_key, join_counted
from morphloom.operators.components import connected_components
from morphloom.storage import Held, materialize

SEED = 42
PAGE = 4096
#: Pages of a shard beyond which it is cut by more bits first.
MANY_PAGES = 4


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority of the bits of the XXH64 hashes of a text's word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), SEED)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % s, SEED) for s in zip(words, words[1:], words[2:])]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], ">u8").view(np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.unload()
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


class BkTree:
    """A BK-tree over distinct 64-bit fingerprints, built and searched for many at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []  # node -> (distances, children)
        n = len(self.values)
        self.edges = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        todo = [(0, np.arange(1, n))] if n else []
        while todo:
            node, below = todo.pop()
            if not len(below):
                continue
            d = np.bitwise_count(self.values[below] ^ self.values[node]).astype(np.int64)
            order = np.argsort(d, kind="stable")
            below, d = below[order], d[order]
            keys, first = np.unique(d, return_index=True)
            self.edges[node] = (keys, below[first])
            for child, rest in zip(below[first].tolist(), np.split(below, first[1:])):
                todo.append((child, rest[1:]))

    def pairs(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each node reached: which queries lie within the radius of it, and the node."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, who = todo.pop()
            d = np.bitwise_count(queries[who] ^ self.values[node]).astype(np.int64)
            if len(near := who[d <= radius]):
                yield near, node
            for key, child in zip(*map(np.ndarray.tolist, self.edges[node])):
                if len(on := who[np.abs(d - key) <= radius]):
                    todo.append((child, on))


def _forest(tree: np.ndarray, asked: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the radius connects between a tree's values and those asked, as few as that takes."""
    tree, asked = np.unique(tree), np.unique(asked)
    root = {v: v for v in np.union1d(tree, asked).view(np.int64).tolist()}
    nodes, askers = tree.view(np.int64).tolist(), asked.view(np.int64).tolist()

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for near, node in BkTree(tree).pairs(asked, radius):
        b = find(nodes[node])
        for k in near.tolist():
            if (a := find(askers[k])) != b:
                links.append((askers[k], nodes[node]))
                root[a] = b
    return links


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    edge = [round(len(bits) * i / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edge, edge[1:])]


def _masked(choices: list[list[int]]) -> Column:
    """An array of (choice, the fingerprint's bits of it)."""
    return F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << x for x in c)))).alias("bits")) for i, c in enumerate(choices)))


def near_links(distinct: DataFrame, radius: int = 2, page: int = PAGE) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` that join all pairs within the radius."""
    blocks = _cut(list(range(64)), radius + 1)
    wide = min(len(blocks[0]), (distinct.count() // page).bit_length())
    first = [b[:wide] for b in blocks] if wide else [[]]
    routed = distinct.select("fp", F.explode(_masked(first)).alias("c")).select("fp", F.xxhash64("c.choice", "c.bits").alias("shard"), "c.choice")
    counted = lambda rows: rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(fresh_key("shard"), "n")
    sized = routed.join(counted(routed), "shard")
    # fingerprints that agree on a whole block differ by the radius in the other bits: they agree on a block of those
    finer = F.lit(None)
    for i, b in enumerate(blocks):
        others = _cut([x for x in range(64) if x not in b], radius + 1)
        finer = F.when(F.col("choice") == i, _masked([b + o for o in others])).otherwise(finer)
    large, sized = sized.where(F.col("n") > MANY_PAGES * page), sized.where(F.col("n") <= MANY_PAGES * page)
    again = large.select("fp", "choice", F.explode(finer).alias("c")).select("fp", F.xxhash64("choice", "c.choice", "c.bits").alias("shard"))
    placed = sized.select("fp", "shard", "n").unionByName(again.join(counted(again), "shard").select("fp", "shard", "n"))
    # a row goes to the units of its page with every page: one unit where all fit a page
    placed = placed.withColumn("pages", F.ceil(F.col("n") / F.lit(page)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pages").cast("bigint")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("pages") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    work = placed.withColumn("own", own).select("fp", "shard", "own", F.explode(units).alias("u"))
    work = work.select("fp", F.xxhash64("shard", "u.i", "u.j").alias("unit"), (F.col("own") == F.col("u.i")).alias("tree"), (F.col("own") == F.col("u.j")).alias("asks"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        values = t.column("fp").to_numpy().view(np.uint64)
        links = _forest(values[t.column("tree").to_numpy()], values[t.column("asks").to_numpy()], radius)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return work.groupBy("unit").applyInArrow(run, "a bigint, b bigint")


def near_components(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest ``doc_id`` reachable over links within the radius."""
    hold = Held()
    try:
        marked = hold(fingerprints(docs, width))
        distinct = hold(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
        linked = connected_components(materialize(near_links(distinct.select("fp"), radius), "links"))
        linked = materialize(linked.select(F.col("node").alias("fp"), F.col("component").alias("root")), "linked")
        named = linked.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
        of = join_counted(linked, materialize(named, "roots"), "root", linked.count()).select("fp", "component_id")
        of = distinct.join(of, "fp", "left").select(fresh_key("fp"), F.coalesce("component_id", "first").alias("component_id"), "n")
        total = distinct.agg(F.sum("n")).first()[0] or 0
        found = join_counted(marked, materialize(of, "named"), "fp", total)
        return materialize(found.select("doc_id", "fp", "component_id"), "components")
    finally:
        hold.release()
