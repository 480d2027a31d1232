"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's documents. All but the last keep the columns
of ``documents``. The stages bound the rows of a batch on the way to Python for the whole session
(``storage.small_batches``), as what they return is planned later, by whoever writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.llm import decontaminate, langid, packing, repeats, similar, simhash
from morphloom.llm.keys import join_counted, split_by
from morphloom.llm.queries import vocabulary
from morphloom.storage import materialize, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, which no language can claim, go; ``lang`` becomes the language predicted.

    A null or empty text has no letter; null labels are learnt from by nothing and are filled;
    where nothing is labelled, no language can claim any text; repeated rows are judged each.
    """
    small_batches(spark)
    said = langid.identify(docs, added=("__language", "__score")).where(F.col("__language") != langid.UNDETERMINED)
    return said.withColumn("lang", F.col("__language")).select(*docs.columns)


def _one_id_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with an id of its own in ``doc_id`` for each row; and the rows that got a new one, if any.

    Rows of equal id and text are one row. Rows without an id, or with one that other texts have too,
    get a number beyond all ids; they keep theirs in ``__id``.
    """
    repeated = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1"), "repeated")
    if repeated.isEmpty():
        return docs, None
    total, most = docs.agg(F.count(F.lit(1)), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    named = repeated.where("doc_id IS NOT NULL")
    again = join_counted(docs, named, "doc_id", total).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
    once = materialize(again.dropDuplicates(["doc_id", "text"]), "once")
    several = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    unnamed = once.join(several, "doc_id", "left_semi").select(*docs.columns).unionByName(once.where("doc_id IS NULL"))
    numbered = materialize(unnamed.withColumn("__id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id() + F.lit(max(most, 0) + 1)), "numbered")
    single = docs.where("doc_id IS NOT NULL").join(named.select("doc_id"), "doc_id", "left_anti")
    whole = once.where("doc_id IS NOT NULL").join(several, "doc_id", "left_anti")
    rows = single.select(*docs.columns).unionByName(whole.select(*docs.columns))
    return rows.unionByName(numbered.select(*docs.columns)), numbered


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that of the smallest id.

    Groups are the components of the fingerprint links and the links of documents whose five-word
    shingle sets are similar by 0.8 or more, both over all rows. Each row is a document of its own
    here, but equal ones; where an id is null or names several texts, any of these rows may stand for
    its group, but a row with an id of its own goes before them. Null and empty texts are one group.
    """
    small_batches(spark)
    rows, numbered = _one_id_each(docs)
    groups = simhash.near_components(rows)
    copies = similar.similar_groups(rows, known=groups).where("doc_id <> group_id").select("doc_id")
    later = groups.where("doc_id <> component_id").select("doc_id")
    gone = materialize(later.unionByName(copies).distinct(), "gone")
    stay = _without(rows.withColumn("__k", F.xxhash64("doc_id")), gone.withColumn("__k", F.xxhash64("doc_id")), ["doc_id"])
    stay = stay.select(*docs.columns)
    if numbered is None:
        return stay
    # rows that had no id of their own get back the one they came with
    back = numbered.join(gone, "doc_id", "left_anti").withColumn("doc_id", F.col("__id"))
    return stay.join(numbered.select("doc_id"), "doc_id", "left_anti").select(*docs.columns).unionByName(back.select(*docs.columns))


def _without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` that ``gone`` does not name, null ids included; both have a hash ``__k`` of what names them.

    Only rows whose hash may be among those of ``gone`` are dealt to the join.
    """
    maybe, surely = split_by(rows, gone, "__k")
    named = gone.select("__k", *(F.col(c).alias(f"__{c}") for c in on))
    same = maybe["__k"] == named["__k"]
    for c in on:
        same = same & maybe[c].eqNullSafe(named[f"__{c}"])
    return surely.unionByName(maybe.join(named, same, "left_anti"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that also stand elsewhere go; ``n_chars`` follows, emptied documents go.

    As in the operator, every copy of a passage of 200 bytes or more goes, the first included; repeated rows
    are copies of each other. A null text counts as emptied.
    """
    small_batches(spark)
    cut = repeats.remove_repeats(docs).where(F.length("text") > 0)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Rows are told apart by id, null or not, and text; a null text holds no window; an empty benchmark
    takes nothing.
    """
    small_batches(spark)
    key = lambda df: df.withColumn("__k", F.xxhash64("doc_id", "__digest"))
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    found = materialize(found.select("doc_id", F.col("digest").alias("__digest")).distinct(), "contaminated")
    return _without(key(docs.withColumn("__digest", F.xxhash64("text"))), key(found), ["doc_id", "__digest"]).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences of at most 2048; a null text has only its end id, repeated rows are packed each."""
    small_batches(spark)
    # four stages have left the executors' heaps full: the encoder remembers less
    return packing.pack_documents(docs, vocabulary(), cache_entries=120_000)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Hashing, hyperdimensional vectors and tokenization are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
