"""Skew-safe building blocks the operators of this subpackage share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
#: Groups with more members than this are spread over SALTS tasks when their pairs are emitted.
HOT_GROUP = 2000


def map_words(df: DataFrame, key: str, words: str, dictionary: DataFrame, word: str, value: str, out: str) -> DataFrame:
    """(key, *out*): the array column *words* with every element replaced through *dictionary* (word -> value).

    One row per (key, distinct word) meets the dictionary on (word, salt), so a word found in every
    text is spread; one aggregation by key restores the order. Words that the dictionary lacks give null.
    Rows whose *words* is empty or null give an empty list.
    """
    pairs = df.select(F.col(key).alias("_key"), F.posexplode(words).alias("_at", "_word")).groupBy("_key", "_word").agg(F.collect_list("_at").alias("_places"))
    pairs = pairs.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    known = dictionary.select(F.col(word).alias("_word"), F.col(value).alias("_value")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = pairs.join(known, ["_word", "_salt"], "left").select("_key", F.transform("_places", lambda p: F.struct(p.alias("at"), F.col("_value").alias("v"))).alias("_some"))
    whole = met.groupBy("_key").agg(F.transform(F.array_sort(F.flatten(F.collect_list("_some"))), lambda s: s["v"]).alias(out))
    none = df.filter(F.coalesce(F.size(words), F.lit(0)) < 1).select(F.col(key).alias("_key"), F.array().cast(whole.schema[out].dataType).alias(out))
    return whole.unionByName(none).withColumnRenamed("_key", key)


def pairs_within(df: DataFrame, group: list[str], key: str, unless_equal: str | None = None) -> DataFrame:
    """(group..., key_a, key_b), key_a < key_b: all pairs of different keys of a group, each once.

    With *unless_equal* only pairs that differ in that column. Only for results that are pairs by
    definition; the output is their number. A large group is salted on one side and repeated on the other.
    """
    sized = df.select(*group, F.col(key).alias("_k"), *([F.col(unless_equal).alias("_u")] if unless_equal else [F.lit(0).alias("_u")])).distinct()
    stats = sized.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_u").alias("_lo"), F.max("_u").alias("_hi"))
    stats = stats.filter((F.col("_n") > 1) & ((F.col("_lo") != F.col("_hi")) if unless_equal else F.lit(True))).withColumn("_s", F.when(F.col("_n") > HOT_GROUP, F.lit(SALTS)).otherwise(F.lit(1))).select(*group, "_s")
    some = sized.join(stats, group)
    left = some.withColumn("_salt", F.pmod(F.xxhash64("_k"), F.col("_s")).cast("int")).select(*group, "_salt", F.col("_k").alias(f"{key}_a"), F.col("_u").alias("_ua"))
    right = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).select(*group, "_salt", F.col("_k").alias(f"{key}_b"), F.col("_u").alias("_ub"))
    met = left.join(right, [*group, "_salt"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return (met.filter(F.col("_ua") != F.col("_ub")) if unless_equal else met).select(*group, f"{key}_a", f"{key}_b")


def let(value: Column, body) -> Column:
    """body(value) with *value* computed once a row; the optimizer would repeat it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of any kind.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text, F.lit(SPACES))
