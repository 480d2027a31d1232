"""Join keys that make the planner deal both sides anew, and joins whose hot keys are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphloom.storage import materialize

#: At most this many keys can each hold more than this part of all rows: a proven bound to broadcast.
HOT_KEYS = 1000


def fresh_key(key: str) -> Column:
    """The same long key as a computed column: its rows count as dealt by nothing, so that a join
    deals both of its sides anew and adaptive execution can split hot keys."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("bigint")).alias(key)


def join_counted(rows: DataFrame, side: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` joined with a table of unique keys whose column ``n`` counts the rows of each key.

    A key of more than a thousandth of all ``total`` rows meets them where they are, by a
    broadcast of such keys alone (there cannot be more than ``HOT_KEYS``); all others are dealt.
    """
    hot = F.broadcast(side.where(F.col("n") > total / HOT_KEYS).drop("n"))
    rest = rows.join(hot.select(on), on, "left_anti").join(side.where(F.col("n") <= total / HOT_KEYS).drop("n"), on)
    return rows.join(hot, on).unionByName(rest)


#: Bits of the bitmap that tells which rows a join may concern: 16 a key, within these bounds
#: (2 million words, some 32 MB, are broadcast at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def split_by(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long column ``key`` may be among ``keys``, and those for which it surely is not.

    A row goes to one side only, by a bitmap of the keys. A join that few rows concern then deals
    only the first side: the others' texts stay where they are. ``key`` must spread well (a hash).
    """
    keys = materialize(keys.select(F.col(key).alias("__key")), "keys")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = lambda c: F.pmod(F.col(c), F.lit(bits))
    flag = F.expr("shiftleft(1L, CAST(pmod(__at, 64) AS INT))")
    words = keys.select(place("__key").alias("__at")).select(F.shiftright("__at", 6).alias("__word"), flag.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    words = F.broadcast(materialize(words, "bitmap"))
    told = rows.withColumn("__at", place(key)).withColumn("__word", F.shiftright("__at", 6)).join(words, "__word", "left")
    holds = F.coalesce(F.col("__bits").bitwiseAND(flag) != 0, F.lit(False))
    return told.where(holds).select(*rows.columns), told.where(~holds).select(*rows.columns)
