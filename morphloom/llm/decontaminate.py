"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ``width`` consecutive words (an item with fewer, but not none,
is one window). A document holds a window only if it holds each of its words, so one necessary
prefix word is enough: the words of the benchmark are ordered by how often all documents have
them, and a window joins only through its rarest word. Length and position then bound where the
window would lie, and the words there are compared one by one.

Documents are split into words once to count the benchmark's words and once to join. Up to
``BROADCAST_WINDOWS`` windows are broadcast; each document then also emits one row that joins a
row of its own, so that documents without a hit, and repeated rows, come out of the same
aggregation. Beyond, places of words are shuffled, each with its document's name and length
only; the documents with a candidate are asked once for the few words at each candidate, and
those meet the windows. Both ways give the same rows.

Edge cases: null text has no words; repeated documents are all returned; a null ``item_id``
marks words as hit but is no item; items with equal ids are one item; an empty benchmark hits
nothing; an empty table gives no row; other columns are not looked at. A text's words are one
array of one row, so a row has to fit a task's memory several times; beside it the shuffled way
makes rows of constant size only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.storage import materialize

WIDTH = 10
BROADCAST_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No word has this character, so it can stand for the document itself.
DOCUMENT = "\x00"


def words(text: Column) -> Column:
    """Words of a whole text, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() changes only A-Z where all characters are ASCII, and is far faster there
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, SEPARATORS), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, items): the distinct windows and the ids of the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - F.lit(width), F.lit(0))
    each = items.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return each.groupBy(F.slice("w", F.col("at") + 1, width).alias("window")).agg(F.collect_set("item").alias("items"))


def prefixes(found: DataFrame, docs: DataFrame) -> tuple[DataFrame, int]:
    """(word, off, window, items): each window under its rarest word in ``docs``; and their number."""
    vocabulary = materialize(found.select(F.explode("window").alias("word")).distinct(), "vocabulary")
    said, n = docs.select(F.explode(words(F.col("text"))).alias("word")), vocabulary.count()
    if n <= BROADCAST_WINDOWS:
        counted = said.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:  # counting combines before the shuffle, so that no common word is hot in a join
        counted = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word", "left_semi")
    ranked = materialize(vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "rarity")
    key = F.sha2(F.concat_ws(" ", "window"), 256)
    spread = found.select(key.alias("key"), "window", "items", F.posexplode("window").alias("off", "word"))
    rarest = (
        spread.select("key", "off", "word")
        .join(ranked, "word")
        .groupBy("key")
        .agg(F.min(F.struct("n", "word", "off")).alias("least"))
        .select("key", "least.word", "least.off")
    )
    out = materialize(found.select(key.alias("key"), "window", "items").join(rarest, "key"), "prefixes")
    return out, out.count()


def _covered(spans: str) -> Column:
    """How many words the sorted spans cover together."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(x["s"].cast("bigint"), a["end"]))).alias("n"),
            F.greatest(a["end"], x["e"].cast("bigint")).alias("end"),
        ),
        lambda a: a["n"],
    )


def _gathered() -> list[Column]:
    return [F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]


def _broadcast_way(rows: DataFrame, by_word: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, copies, spans, items: windows go to the documents."""
    own = rows.sparkSession.range(1).select(F.lit(DOCUMENT).alias("word"), F.lit(0).alias("off"), F.array().cast("array<string>").alias("window"), F.array().cast("array<string>").alias("items"))
    said = rows.select("doc_id", "digest", "w", F.posexplode(F.concat("w", F.array(F.lit(DOCUMENT)))).alias("pos", "word"))
    start, size = F.col("pos") - F.col("off"), F.size("window")
    fits = (start >= 0) & (start + size <= F.size("w"))
    same = F.slice("w", F.when(fits, start + 1).otherwise(1), size) == F.col("window")
    is_document = F.col("word") == DOCUMENT
    hits = (
        said.join(F.broadcast(by_word.drop("key").unionByName(own)), "word")
        .where(is_document | (fits & same))
        .select("doc_id", "digest", F.when(is_document, F.size("w")).alias("n_words"), F.when(~is_document, F.struct(start.alias("s"), (start + size).alias("e"))).alias("span"), "items")
    )
    return hits.groupBy("doc_id", "digest").agg(F.max("n_words").cast("bigint").alias("n_words"), F.count("n_words").alias("copies"), *_gathered())


def _shuffled_way(rows: DataFrame, by_word: DataFrame) -> DataFrame:
    """The same by joins of narrow rows: no document's words are carried from place to place."""
    name = ["digest", "digest2"]
    named = rows.withColumn("digest2", F.xxhash64(F.lit("another seed"), "doc_id", "w"))
    whole = named.groupBy(*name).agg(F.first("doc_id").alias("doc_id"), F.max(F.size("w")).cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    said = named.select(*name, F.size("w").alias("n"), "w").select(*name, "n", F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    likely = said.join(by_word.select("word", "off", "key", F.size("window").alias("size")), "word").where((start >= 0) & (start + F.col("size") <= F.col("n")))
    asked = likely.select(*name, start.alias("s"), "size", "key").distinct().groupBy(*name).agg(F.collect_list(F.struct("s", "size", "key")).alias("asked"))
    there = named.dropDuplicates(name).join(asked, name).select(*name, "w", F.explode("asked").alias("x"))
    there = there.select(*name, "x.s", "x.size", "x.key", F.slice("w", F.col("x.s") + 1, F.col("x.size")).alias("run"))
    hits = there.join(by_word.select("key", "window", "items"), "key").where(F.col("run") == F.col("window"))
    hits = hits.select(*name, F.struct("s", (F.col("s") + F.col("size")).alias("e")).alias("span"), "items").groupBy(*name).agg(*_gathered())
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return whole.join(hits, name, "left").select("doc_id", "digest", "n_words", "copies", none("spans", "array<struct<s:int,e:int>>"), none("items", "array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, items, ``digest`` of the row's text, for every document."""
    found = materialize(windows(benchmark, width), "windows")
    by_word, n = prefixes(found, docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("w"))
    whole = (_broadcast_way if n <= BROADCAST_WINDOWS else _shuffled_way)(rows, by_word)
    out = whole.select("doc_id", "digest", "n_words", _covered("spans").alias("n_hit"), "items", "copies")
    return out.select("doc_id", "digest", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copy")


def oracle() -> str:
    """The same hits by brute force: every run of words of every document against every window."""
    ws = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ws} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ws} AS w FROM benchmark),
    wins AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS size, list_slice(w, i, i + least(len(w), {WIDTH}) - 1) AS win
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) AS i FROM b WHERE len(w) > 0) x),
    runs AS (SELECT rid, i, size, list_slice(w, i, i + size - 1) AS win
        FROM (SELECT d.rid, d.w, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i FROM d JOIN (SELECT DISTINCT size FROM wins) s ON len(d.w) >= s.size) x),
    hits AS (SELECT r.rid, r.i, r.size, wins.item FROM runs r JOIN wins ON r.size = wins.size AND r.win = wins.win),
    said AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits) z) y GROUP BY rid),
    named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) z GROUP BY rid)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(said.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(named.items, '')) AS items_sha256, coalesce(said.n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN said USING (rid) LEFT JOIN named USING (rid)"""
