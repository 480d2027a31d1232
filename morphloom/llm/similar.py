"""Near copies by shingle similarity: SimHash BK-trees propose, exact Jaccard decides.

Two bits of a 64-bit fingerprint tell apart texts that share most of their shingles, so a stage
that must find similarity 0.8 needs a wider radius than key blocks can serve. Here documents
meet in shards keyed by minimum hashes of their shingle sets (a pair of similarity 0.8 misses
all six with probability 0.2 ** 6). In a shard, a BK-tree over fingerprints follows edges within
``RADIUS``; what it finds is weighed by a 128-byte sketch. A shard beyond a page is cut by length
class (similar sets have similar sizes: each visits its own class and the next), and what is still
larger is split into pages, each pair of pages one unit of work. The rows of a unit that have a likely pair come again with their whole shingle sets, and
the unit's spanning forest grows by true links only: no estimate takes a pair's place.

Edge cases: null or empty texts and texts of blanks share the empty set and are equal; a text of
fewer words than a shingle is one shingle; repeated rows are equal; rows without ``doc_id`` take
no part; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphloom.llm import bpe
from morphloom.llm.keys import fresh_key, join_counted, split_by
from morphloom.llm.simhash import SEED, BkTree, fingerprint
from morphloom.operators.components import connected_components
from morphloom.storage import Held, materialize

WIDTH, THRESHOLD = 5, 0.8
KEYS, SKETCH, PAGE = 6, 128, 2048
#: Fingerprints of similarity 0.8 differ by about 10 bits, deviation 3; the sketch's estimate has a
#: deviation of 0.035. Both bounds lie four to five deviations off; what they leave is checked exactly.
RADIUS, LIKELY = 24, 0.62
_ODD = np.random.default_rng(11).integers(1, 1 << 62, KEYS + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words] if words else []
    return np.unique(np.array([digest(b" ".join(r), SEED) for r in runs], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each of the multiplications."""
    if not len(hashes):
        return np.zeros(KEYS + SKETCH, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(31))
    out = np.full(KEYS + SKETCH, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(mixed), 4096):
        out = np.minimum(out, (mixed[i : i + 4096, None] * _ODD[None] >> np.uint64(8)).min(0))
    return out


def set_name(hashes: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(hashes.tobytes()), np.uint64).view(np.int64))


def _sketches(docs: DataFrame, marked: bool = False) -> DataFrame:
    """(doc_id, same, n, fp, keys, sketch, mark): ``same`` names the shingle set, ``mark`` is the
    fingerprint of ``simhash`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.unload()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for text in b.column(1).to_pylist():
                h = shingles(text)
                least = minima(h)
                bits = np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
                fp = int(np.packbits(2 * bits > len(h)).view(">i8")[0])
                sketch = (least[KEYS:] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()
                keys = (least[:KEYS] >> np.uint64(24)).astype(np.uint32).view(np.int32).tolist()
                mark = int(np.array(fingerprint(text), np.uint64).view(np.int64)) if marked else None
                for col, v in zip(cols, (set_name(h), len(h), fp, keys, sketch, mark)):
                    col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "same", "n", "fp", "keys", "sketch", "mark"])
        bpe.give_back()

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(run, "doc_id bigint, same bigint, n int, fp bigint, keys array<int>, sketch binary, mark bigint")


def _likely(rows: dict[str, np.ndarray], threshold: float) -> list[np.ndarray]:
    """For each row of a unit, the later rows to check with it: pairs of different groups that the
    sketch holds for likely, each in one unit only: that of its first common key and, where a shard
    was cut by class, of its upper class."""
    fp, n, m, top, own, group, keys, sketch = (rows[c] for c in ("fp", "n", "m", "top", "own", "group", "keys", "sketch"))
    across = bool((own != own[0]).any())
    values, at = np.unique(fp, return_inverse=True)
    members = np.split(np.argsort(at, kind="stable"), np.cumsum(np.bincount(at))[:-1])
    found = [[np.empty(0, np.int32)] for _ in fp]
    for near, node in BkTree(values).pairs(values, RADIUS):
        b = np.concatenate([members[k] for k in near.tolist()])
        for i in members[node].tolist():
            j = b[b > i]
            fits = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (group[i] != group[j]) & (top[i] | top[j])
            if across:
                fits &= own[i] != own[j]
            j = j[fits]
            j = j[np.argmax(keys[i] == keys[j], 1) == m[i]]
            j = j[(sketch[i] == sketch[j]).mean(1) >= LIKELY]
            found[i].append(j.astype(np.int32))
    return [np.concatenate(f) for f in found]


def _units(nodes: DataFrame, threshold: float, page: int) -> DataFrame:
    """(unit, own, m, top, same, group, n, fp, keys, sketch): rows that meet, in two pages at most.

    Names and sizes are dealt first; only rows that share a shard with another take their sketch
    along, once a unit. A shard too large for a page is cut by class, then split into pages, and
    each pair of pages is one unit, so that every pair of a shard meets. Rows are never paired with
    each other here.
    """
    size_class = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1.0 / threshold))).cast("int")
    placed = nodes.select("same", size_class.alias("size"), F.posexplode("keys").alias("m", "key"))
    routed = placed.select("same", "size", "m", F.xxhash64("m", "key").alias("shard"), F.lit(True).alias("top"))
    total = nodes.count() * KEYS

    def sized_of(rows: DataFrame) -> DataFrame:
        """Rows that share a shard, with its size ``c``; a shard that many rows share is told by a bounded broadcast."""
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(fresh_key("shard"), "c", F.col("c").alias("n"))
        return join_counted(rows, materialize(sizes, "sizes"), "shard", total)

    sized = materialize(sized_of(routed), "shards")
    large = sized.where(F.col("c") > page).select("same", "size", "m", "shard", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("class"))
    classed = large.select("same", "m", F.xxhash64("shard", "class").alias("shard"), (F.col("class") == F.col("size")).alias("top"))
    every = sized.where(F.col("c") <= page).select("same", "m", "shard", "top", "c").unionByName(sized_of(classed).select("same", "m", "shard", "top", "c"))
    every = every.withColumn("pages", F.ceil(F.col("c") / F.lit(page)).cast("int"))
    own = F.pmod(F.xxhash64("same"), F.col("pages").cast("bigint")).cast("int")
    visited = F.transform(F.sequence(F.lit(0), F.col("pages") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    work = every.withColumn("own", own).select("same", "m", "top", "shard", "own", F.explode(visited).alias("u"))
    work = work.select(fresh_key("same"), "m", "top", "own", F.xxhash64("shard", "u.i", "u.j").alias("unit"))
    return work.join(nodes.select("same", "group", "n", "fp", "keys", "sketch"), "same").select("unit", "own", "m", "top", "same", "group", "n", "fp", "keys", "sketch")


def _proposed(nodes: DataFrame, threshold: float, page: int) -> DataFrame:
    """(unit, pos, same, group, later): rows of a unit with a likely pair, and where its later rows are."""
    names = ["unit", "pos", "same", "group", "later"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        size = t.num_rows
        rows = {c: t.column(c).to_numpy() for c in ("m", "top", "own", "same", "group", "n")}
        rows["fp"] = t.column("fp").to_numpy().view(np.uint64)
        rows["keys"] = np.stack(t.column("keys").to_numpy()).reshape(size, KEYS)
        rows["sketch"] = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(size, SKETCH)
        later = _likely(rows, threshold)
        seen = np.zeros(size, bool)
        for i, j in enumerate(later):
            seen[j] = True
            seen[i] |= len(j) > 0
        at = np.flatnonzero(seen)
        cols = [pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(rows["same"][at]), pa.array(rows["group"][at])]
        return pa.table([*cols, pa.array([later[i].tobytes() for i in at], pa.binary())], names=names)

    schema = "unit bigint, pos int, same bigint, group bigint, later binary"
    return _units(nodes, threshold, page).groupBy("unit").applyInArrow(run, schema)


def _forest(pos: np.ndarray, group: np.ndarray, later: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect the groups of a unit as all its pairs of the similarity do: each likely
    pair not yet connected by links that were found true is checked with the whole sets."""
    at = {p: i for i, p in enumerate(pos.tolist())}
    root, out = {g: g for g in group.tolist()}, []
    own = group.tolist()

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, ends in enumerate(later):
        x = sets[i]
        for j in ends.tolist():
            j = at[j]
            a, b = find(own[i]), find(own[j])
            if a == b:
                continue
            y = sets[j]
            shared = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
            if shared >= threshold * (len(x) + len(y) - shared):
                root[a] = b
                out.append((own[i], own[j]))
    return out


def _verified(likely: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, hold: Held) -> DataFrame:
    """(a, b): groups linked by the whole shingle sets; only likely documents are read into sets."""
    wanted = likely.select(fresh_key("same")).distinct()
    ends = materialize(nodes.join(wanted, "same", "left_semi").select(F.xxhash64("doc_id").alias("k")).distinct(), "ends")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text", F.xxhash64(F.col("doc_id").cast("bigint")).alias("k"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t.as_py()) for t in b.column(1)]
            same = pa.array([set_name(h) for h in made], pa.int64())
            yield pa.RecordBatch.from_arrays([same, pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in made], pa.binary())], names=["same", "hashes"])
        bpe.give_back()

    # rows are told without Python, so that a task has one Python process
    known = split_by(texts, ends, "k")[0].mapInArrow(whole, "same bigint, hashes binary").join(wanted, "same", "left_semi").dropDuplicates(["same"])
    both = likely.select("unit", "pos", fresh_key("same"), "group", "later").join(hold(known), "same")

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        later = [np.frombuffer(v.as_py(), np.int32) for v in t.column("later")]
        sets = [np.frombuffer(v.as_py(), np.uint32) for v in t.column("hashes")]
        links = _forest(t.column("pos").to_numpy(), t.column("group").to_numpy(), later, sets, threshold)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return both.select("unit", "pos", "group", "later", "hashes").groupBy("unit").applyInArrow(judge, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, threshold: float = THRESHOLD, known: DataFrame | None = None, page: int = PAGE) -> DataFrame:
    """(doc_id, group_id) of documents that have near copies: the smallest id reachable.

    ``known`` (doc_id, fp, component_id), as of ``simhash.near_components``, are links that hold
    already: then components take the place of documents in the result.
    """
    hold = Held()
    try:
        made = _sketches(docs, known is not None)
        if known is None:
            part = hold(made.withColumn("group", F.col("doc_id")))
        else:
            of = known.where("doc_id IS NOT NULL").select(fresh_key("doc_id"), F.col("fp").alias("mark"), F.col("component_id").alias("group")).distinct()
            part = hold(made.join(of, ["doc_id", "mark"]))
        firsts = hold(part.groupBy("same").agg(F.min("group").alias("first")))
        one = part.dropDuplicates(["same"]).drop("group").join(firsts.select(fresh_key("same"), F.col("first").alias("group")), "same")
        nodes = materialize(one, "nodes")
        links = _verified(hold(_proposed(nodes, threshold, page)), nodes, docs, threshold, hold)
        copies = part.select(fresh_key("same"), "group").distinct().join(firsts, "same").where("group <> first").select(F.col("group").alias("a"), F.col("first").alias("b"))
        links = materialize(links.unionByName(copies.distinct()), "links")
    finally:
        hold.release()
    return connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
