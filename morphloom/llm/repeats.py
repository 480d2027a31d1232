"""Exact removal of repeated substrings by prefix-free parsing.

All texts are byte strings; a window is any run of ``length`` bytes inside one text. A rolling
hash of 12-byte grams triggers the parse: the trigger of a window is its gram of least hash (the
last of equals), so equal windows have their trigger at the same place, in whatever text they
stand. Neighbouring windows with one trigger form a block (cut at multiples of 96, 12 or 1 bytes
of the trigger's distance), whose bytes are two phrases of the parse: one ends with the trigger
and the next one starts with it.

What does not repeat, or repeats as a whole, is told by counting. Of each block two keys are
counted: that of the bytes common to all windows a block of its kind can have, and that of all
bytes its windows cover. A block whose common bytes occur once has no repeated window; one whose
covered bytes occur twice has only repeated ones. The rest, blocks at the rims of repeats, meet
by their common bytes, one of each different kind, and are put in corpus order: the suffix array
of the dictionary (the distinct phrases that end with a trigger) gives equal suffixes one class,
the suffix array of the parse orders what follows them, and windows next to each other in that
order, class by class, repeat if their longest common prefix reaches ``length``.

A shard of the order holds whole groups of equal common bytes. A group of more than ``SORTED``
kinds is no shard: its blocks are cut finer, down to one window, whose bytes decide by the count
alone. So nothing unbounded meets in a task. Counted keys are two 64-bit hashes together, texts
are named by two.

Edge cases: null text is empty; texts shorter than ``length`` keep all bytes; repeated rows are
two texts, and so lose all they share; ties cannot arise; an empty table gives no row. A text
longer than 4 MB is parsed in overlapping segments. Columns of the table's own never clash: the
operator's have names that begin with two underscores, or stand in tables of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphloom.llm import bpe
from morphloom.llm.keys import fresh_key
from morphloom.storage import Held, materialize

LENGTH = 200
GRAM = 12
BLOCKS = (96, 12, 1)
SEGMENT = 4 << 20
#: Kinds of one group, and about as many of one shard, whose suffixes are sorted together.
SORTED = 4096
#: The bitmap of keys has 16 bits a key, within these bounds (16 MB at most is broadcast).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: ``shape`` is the number of windows (96 at most) and, above 8 bits, where the trigger stands.
BLOCK_ROWS = "common bigint, covered bigint, k bigint, k2 bigint, at int, shape int"
_NAMES = ["common", "covered", "k", "k2", "at", "shape"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
NAMED = ["k", "k2"]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each 12-byte gram."""
    n = len(data) - GRAM + 1
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    x = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[GRAM - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def triggers(data: np.ndarray, length: int) -> np.ndarray:
    """The trigger's position for each window of a segment."""
    h, span, windows = gram_hashes(data), length - GRAM + 1, len(data) - length + 1
    low = np.uint64(0xFFFFFF)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    rows = np.concatenate([key, np.full(-len(key) % span, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, span)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(after[:windows], before[span - 1 : span - 1 + windows])
    return (low - (least & low)).astype(np.int64)


def blocks(data: bytes, length: int, block: int, wanted: list[tuple[int, int]] | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(common, covered, at, shape) of the blocks of a text, or of the windows ``wanted`` (at, n)."""
    key, signed = xxhash.xxh3_64_intdigest, lambda v: v - (1 << 64) if v >> 63 else v
    if wanted is None:
        last = len(data) - length + 1
        wanted = [(a, min(SEGMENT, last - a)) for a in range(0, last, SEGMENT)]
    for base, count in wanted:
        part = data[base : base + count + length - 1]
        pos = triggers(np.frombuffer(part, np.uint8), length)
        kind = (pos - np.arange(count)) // block
        cuts = np.flatnonzero((np.diff(pos) != 0) | (np.diff(kind) != 0)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.append(starts, count))
        for p, b, s, n in zip(pos[starts].tolist(), kind[starts].tolist(), starts.tolist(), sizes.tolist()):
            c = p - block * b
            common = key(part[c : c + length - block + 1], b)
            yield signed(common), signed(key(part[s : s + n + length - 1], 1000 + p - s)), base + s, n | (p - s) << 8


def _emit(rows: Iterator[tuple], names: list[str] = _NAMES, kinds: list[pa.DataType] = _KINDS, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows a few at a time, so that few texts are Python objects at once."""
    bpe.unload()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    bpe.give_back()


def _first_blocks(texts: DataFrame, length: int, block: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in small(batches):
            for k, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                data = text.as_py() or b""
                if len(data) >= length:
                    for common, covered, at, shape in blocks(data, length, block):
                        yield common, covered, k, k2, at, shape

    return texts.mapInArrow(lambda batches: _emit(rows(batches)), BLOCK_ROWS)


def _asked(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(k, k2, data, spans) of the texts that are asked about; repeated rows each count."""
    return pick(texts, asked).join(asked, NAMED).select(*NAMED, "data", "spans")


def _asked_blocks(texts: DataFrame, asked: DataFrame, length: int, block: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in small(batches):
            for k, k2, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                for common, covered, at, shape in blocks(text.as_py(), length, block, [(x["at"], x["shape"] & 255) for x in spans]):
                    yield common, covered, k, k2, at, shape

    return _asked(texts, asked).mapInArrow(lambda batches: _emit(rows(batches)), BLOCK_ROWS)


def suffix_classes(phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary by prefix doubling, as ranks: (rank of the suffix at each
    place of the phrases laid end to end with a terminator each, where each phrase starts).

    Equal suffixes, in whatever phrase, have one rank.
    """
    sizes = np.array([len(p) + 1 for p in phrases])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = np.repeat(starts + sizes - 1, sizes)
    letters = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1
    letters[ends] = 0
    place, key, step = np.arange(len(letters)), np.zeros(len(letters), np.int64), 7
    for i in range(step):
        key = key << 9 | letters[np.minimum(place + i, ends)]
    found, rank = np.unique(key, return_inverse=True)
    known = 0
    while step < sizes.max() and len(found) > known:
        known = len(found)
        found, rank = np.unique(rank * len(letters) + rank[np.minimum(place + step, ends)], return_inverse=True)
        step *= 2
    return rank, starts


def _common_prefixes(phrases: list[bytes]) -> np.ndarray:
    """How many bytes each of the sorted phrases has in common with the one before it."""
    sizes = np.array([len(p) for p in phrases])
    table = np.zeros((len(phrases), int(sizes.max()) + 1), np.uint8)
    table[np.arange(table.shape[1])[None] < sizes[:, None]] = np.frombuffer(b"".join(phrases), np.uint8)
    differ = table[1:] != table[:-1]
    differ[:, -1] = True
    return np.concatenate([[0], np.minimum(differ.argmax(1), np.minimum(sizes[1:], sizes[:-1]))])


def repeated_starts(pieces: list[bytes], trigger: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which windows of the pieces, piece by piece, have bytes that another window has too.

    Each piece holds ``counts`` windows, all with the trigger at its place ``trigger``; they are
    put in corpus order by the suffix arrays of the dictionary and of the parse.
    """
    left: dict[bytes, int] = {}
    first = np.array([left.setdefault(p[: t + GRAM], len(left)) for p, t in zip(pieces, trigger.tolist())])
    rank, starts = suffix_classes(list(left))
    follows = [p[t:] for p, t in zip(pieces, trigger.tolist())]
    parse = sorted(set(follows))
    order_of = {p: i for i, p in enumerate(parse)}
    after = np.array([order_of[p] for p in follows])
    least = [_common_prefixes(parse)]  # a table of range minima over the parse's order
    while 2 << (len(least) - 1) <= len(parse):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))

    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    suffix = rank[starts[first[piece]] + at]
    order = np.lexsort((after[piece], suffix))
    one, two = order[:-1], order[1:]
    same = suffix[one] == suffix[two]
    one, two = one[same], two[same]
    low, high = after[piece[one]], after[piece[two]]
    shared = np.full(len(one), length, np.int64)
    apart = np.flatnonzero(low < high)
    level = np.frexp(high[apart] - low[apart])[1] - 1
    for v in np.unique(level).tolist():
        on = apart[level == v]
        shared[on] = np.minimum(least[v][low[on] + 1], least[v][high[on] + 1 - (1 << v)])
    repeats = shared >= length - (trigger[piece[one]] - at[one])
    out = np.zeros(len(piece), bool)
    out[one[repeats]] = out[two[repeats]] = True
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def _sorted_spans(texts: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """(k, k2, at, n): repeated windows of the blocks asked about, by corpus order in shards."""
    names, kinds = ["common", *NAMED, "at", "shape", "data"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in small(batches):
            for k, k2, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                data = text.as_py()
                for x in spans:
                    yield x["common"], k, k2, x["at"], x["shape"], data[x["at"] : x["at"] + (x["shape"] & 255) + length - 1]

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        _, k, k2, at, shape, data = zip(*rows)
        shape = np.array(shape)
        counts = shape & 255
        marks = repeated_starts(list(data), shape >> 8, counts, length)
        for i, part in enumerate(np.split(marks, np.cumsum(counts)[:-1])):
            for start, n in _runs(part):
                yield k[i], k2[i], at[i] + start, n

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= SORTED and row[0] != held[-1][0]:  # a group is never torn apart
                    yield from shard(held)
                    held = []
                held.append(row)
        if held:
            yield from shard(held)
        bpe.give_back()

    cut = _asked(texts, asked).mapInArrow(lambda batches: _emit(pieces(batches), names, kinds, 10_000), "common bigint, k bigint, k2 bigint, at int, shape int, data binary")
    met = cut.repartition("common").sortWithinPartitions("common")
    return met.mapInArrow(lambda batches: _emit(order(batches), [*NAMED, "at", "n"], kinds[1:3] + [pa.int32()] * 2), "k bigint, k2 bigint, at int, n int")


def _key_filter(keys: DataFrame) -> bytes:
    """A bitmap, of bounded size, in which every key's bit is set."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    word = F.shiftright(F.pmod("k", F.lit(bits)), 6).alias("word")
    rows = keys.select(word, F.expr("shiftleft(1L, int(pmod(k, 64)))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(bits // 64, np.int64)
    for b in rows.toArrow().to_batches():
        words[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return words.tobytes()


def _may_hold(words: bytes, keys: pa.Array) -> np.ndarray:
    bit = np.mod(keys.to_numpy(), 8 * len(words))
    return (np.frombuffer(words, np.int64)[bit >> 6] >> (bit & 63) & 1).astype(bool)


def _picked(rows: DataFrame, words, key: str = "k") -> DataFrame:
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_may_hold(words.value, b.column(at))))

    return rows.mapInArrow(run, rows.schema)


def pick(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose ``k`` may be among ``keys``; no key is missed.

    Without it, texts that no key names would be shuffled to a join only to be dropped there.
    """
    return _picked(rows, rows.sparkSession.sparkContext.broadcast(_key_filter(keys)))


def _resolve(rows: DataFrame, finest: bool) -> tuple[DataFrame, DataFrame | None]:
    """(k, k2, at, n) of windows known to be repeated; and the blocks to be asked again, if any.

    Both are written, so that the next round starts from tables; what leads to them is held on
    disk only as long. ``deep`` tells the blocks of groups too large to be sorted.
    """
    hold = Held()
    rows = hold(rows)
    often = rows.groupBy("common").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(fresh_key("common"))
    members = hold(rows.join(often, "common"))
    kinds = hold(members.groupBy("common", "covered").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*NAMED, "at", "shape")).alias("one")))
    try:
        twice = kinds.where("c > 1").select(fresh_key("common"), "covered")
        spans = materialize(members.join(twice, ["common", "covered"]).select(*NAMED, "at", F.col("shape").bitwiseAND(255).alias("n")), "spans")
        if finest:
            return spans, None
        mixed = kinds.groupBy("common").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 AND kinds > 1")
        mixed = mixed.select(fresh_key("common"), (F.col("kinds") > SORTED).alias("deep"))
        return spans, materialize(kinds.join(mixed, "common").select("common", "deep", "one.*"), "asked")
    finally:
        hold.release()


def _by_text(asked: DataFrame) -> DataFrame:
    return materialize(asked.groupBy(*NAMED).agg(F.collect_list(F.struct("common", "at", "shape")).alias("spans")), "asked")


def repeated_windows(texts: DataFrame, length: int = LENGTH, sizes: tuple[int, ...] = BLOCKS) -> DataFrame:
    """(k, k2, at, n): windows of ``texts`` (k, k2, data) whose bytes occur elsewhere too, as ranges of starts."""
    blocks_of, out = _first_blocks(texts, length, sizes[0]), None
    for size, finer in zip(sizes, (*sizes[1:], 0)):
        spans, asked = _resolve(blocks_of, size == 1)
        out = spans if out is None else out.unionByName(spans)
        if asked is None:
            break
        shallow = materialize(_sorted_spans(texts, _by_text(asked.where("NOT deep")), length), "sorted")
        out = out.unionByName(shallow)
        if asked.where("deep").isEmpty():
            break
        blocks_of = _asked_blocks(texts, _by_text(asked.where("deep")), length, finer)
    return out


#: Columns that the operator adds for itself, named so that a table's own do not clash.
KEY, KEY2, SPANS = "__key", "__key2", "__spans"


def _marked(keyed: DataFrame, length: int) -> DataFrame:
    """(k, k2, spans): the sorted ranges of repeated windows of each text that has any."""
    texts = keyed.select(F.col(KEY).alias("k"), F.col(KEY2).alias("k2"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    merged = repeated_windows(texts, length).groupBy(*NAMED).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    return materialize(merged, "merged")


def removed_runs(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows given as sorted ranges of starts."""
    runs: list[tuple[int, int]] = []
    for x in spans or ():
        s, e = x["at"], x["at"] + x["n"] - 1 + length
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], e))
        else:
            runs.append((s, e))
    return runs


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _apply(docs: DataFrame, length: int, schema: T.StructType, row: Callable) -> DataFrame:
    """``row(columns of a batch by name, texts, runs)`` over all documents; only those with repeats are shuffled."""
    keyed = docs.withColumn(KEY2, F.xxhash64(F.lit("another seed"), "text", "doc_id")).withColumn(KEY, F.xxhash64("doc_id", "text"))
    spans = _marked(keyed, length)
    words = keyed.sparkSession.sparkContext.broadcast(_key_filter(spans))

    def made(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = dict(zip(b.schema.names, b.columns))
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in cols["text"]]
        found = cols[SPANS].to_pylist() if SPANS in cols else [None] * len(texts)
        return row(cols, texts, [removed_runs(s, length) for s in found])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rest = b.filter(pa.array(~_may_hold(words.value, b.column(b.num_columns - 1))))
            if rest.num_rows:
                yield made(rest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(made, small(batches))

    names = docs.columns
    whole = keyed.select(*names, KEY).mapInArrow(untouched, schema)
    spans = spans.select(F.col("k").alias(KEY), F.col("k2").alias(KEY2), F.col("spans").alias(SPANS))
    return whole.unionByName(_picked(keyed, words, KEY).join(spans, [KEY, KEY2], "left").select(*names, SPANS).mapInArrow(cut, schema))


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def row(cols: dict, texts: list[bytes], runs: list) -> pa.RecordBatch:
        kept = [kept_bytes(t, r) for t, r in zip(texts, runs)]
        made = [
            cols["doc_id"],
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([len(t) - len(x) for t, x in zip(texts, kept)], pa.int64()),
            pa.array([len(r) for r in runs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        ]
        return pa.RecordBatch.from_arrays(made, names=names)

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names[1:4]), T.StructField(names[4], T.StringType())])
    return _apply(docs.select("doc_id", "text"), length, schema, row)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut from ``text``; a character cut in part goes whole."""
    names, at = docs.columns, docs.columns.index("text")

    def row(cols: dict, texts: list[bytes], runs: list) -> pa.RecordBatch:
        made = [cols[c] for c in names]
        cut = [kept_bytes(t, r).decode("utf-8", "ignore") if r else old.as_py() for t, r, old in zip(texts, runs, cols["text"])]
        made[at] = pa.array(cut, pa.string())
        return pa.RecordBatch.from_arrays(made, names=names)

    return _apply(docs, length, docs.schema, row)
