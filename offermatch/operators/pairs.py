"""Pairing texts with names: equi-joins in parts, and a similarity join that loses no pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermatch.functions.text import let

SALTS = 8  # parts that a common key is split into
# Letters that most texts hold, the most common last: a prefix of rare letters meets few texts.
_COMMON = "ldhcrsntioae "


def every_part(df: DataFrame) -> DataFrame:
    """The side that is repeated for each part; it has one row per target or per title."""
    return df.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))


def part_of(*of: Column) -> Column:
    return F.pmod(F.hash(*of), F.lit(SALTS))


def letter_tokens(text: Column) -> Column:
    """The letters of a text as a set of numbers, the n-th of a kind apart from the first; rare ones first.

    White space counts as one kind of letter.  Texts share as many letters as these sets share numbers.
    """
    def numbered(plain: Column) -> Column:
        kinds = F.array_distinct(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)))

        def of_kind(c: Column) -> Column:
            times = F.length(plain) - F.length(F.replace(plain, c, F.lit("")))
            return F.transform(F.sequence(F.lit(1), times), lambda n: F.struct(
                (-n).alias("late"), F.instr(F.lit(_COMMON), c).alias("common"),
                (F.ascii(c).cast("bigint") * (1 << 32) + n).alias("token")))

        found = F.flatten(F.transform(kinds, of_kind))
        return F.transform(F.array_sort(found), lambda t: t["token"])

    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(
        let(F.regexp_replace(text, r"(?U)\s", " "), numbered))


def _needed(size: Column, share: float) -> Column:
    """Letters that a pair must share whose smaller text has this size, one at least."""
    return F.greatest(F.ceil(size * share - 1e-9), F.lit(1)).cast("int")


def letter_pairs(texts: DataFrame, names: DataFrame, share: float) -> DataFrame:
    """Pairs of rows whose texts share at least ``share`` of the smaller one's size in letters.

    Each side has ``letters`` (:func:`letter_tokens`) and ``size``, no larger than their number, and no other
    column in common with the other side but these.  The smaller text of a pair must have one of its first
    ``letters - needed + 1`` letters in common with the other, so only those are indexed; a pair is kept where its
    first common letter is met, which makes it unique without a shuffle.
    """
    left = texts.withColumnsRenamed({"letters": "_left", "size": "_left_size"})
    right = names.withColumnsRenamed({"letters": "_right", "size": "_right_size"})

    def indexed(df: DataFrame, letters: str, size: str) -> DataFrame:
        """A row for each letter of the prefix, with what stands before it."""
        width = F.greatest(F.size(letters) - _needed(F.col(size), share) + 1, F.lit(0))
        return df.select("*", F.posexplode(F.slice(letters, 1, width)).alias("_at", "_token")).withColumn(
            "_earlier", F.slice(letters, 1, "_at")).drop("_at")

    def met(first: str, second: str, size: str) -> Column:
        return ~F.arrays_overlap("_earlier", F.col(second)) & (
            F.size(F.array_intersect(first, second)) >= _needed(F.col(size), share))

    part = part_of(F.col("_left"), F.col("_left_size"))
    small_right = left.withColumns({"_token": F.explode("_left"), "_part": part}).join(
        every_part(indexed(right, "_right", "_right_size")), ["_token", "_part"]
    ).filter((F.col("_left_size") >= F.col("_right_size")) & met("_right", "_left", "_right_size"))
    small_left = indexed(left, "_left", "_left_size").withColumn("_part", part).join(
        every_part(right.withColumn("_token", F.explode("_right"))), ["_token", "_part"]
    ).filter((F.col("_left_size") < F.col("_right_size")) & met("_left", "_right", "_left_size"))
    return small_right.unionByName(small_left).drop("_token", "_earlier", "_part", "_left", "_right", "_left_size", "_right_size")


_SLOTS = 1 << 26  # bits of a bitmap, 8 MB, for any number of keys
_SLICE = 1 << 15  # bits of one row of it


def likely_among(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is among those of ``wanted``, and few others, told apart before a shuffle moves them.

    A bitmap of the wanted keys' hashes meets the rows where they are.  Its size is fixed, so with very many keys
    more others stay; the join that follows drops them.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS))
    at = {"_slice": F.floor(slot / _SLICE).cast("int"), "_bit": (slot % _SLICE).cast("int")}
    bits = wanted.select(*[value.alias(name) for name, value in at.items()]).repartition("_slice").groupBy("_slice").agg(
        F.bitmap_construct_agg(F.col("_bit").cast("bigint")).alias("_bits"))
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumns(at).join(F.broadcast(bits), "_slice").filter(
        F.getbit(byte, F.col("_bit") % 8) == 1).select(*df.columns)


def over_all_tasks(df: DataFrame, *key: str) -> DataFrame:
    """Few rows that cost much: dealt over as many tasks as a shuffle has, which adaptive merging of small
    partitions leaves alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
