"""Skewed keys: salted aggregates and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_keys(df: DataFrame, key: str, least: int) -> DataFrame:
    """Keys of more than `least` rows, with their count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)


def salted_sum(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], salts: int = 16) -> DataFrame:
    """Sums in two phases, by (key, salt) and by key (A25). The salt is a column of its own, so no key is parsed back.

    Spark combines sums before the shuffle by itself, and a plain sum has one shuffle less: the salt is for aggregates that
    can't be combined, and is here because its result must be the plain one's.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    part = df.groupBy(*keys, salt.alias("_salt")).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.count(F.lit(1)).alias("_n"))
    return part.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in sums), F.sum("_n").alias("n"))


#: Frequent keys that are broadcast at most.
MOST_KEYS = 50_000


def salted_join(fact: DataFrame, other: DataFrame, key: str, least: int = 100_000, salts: int = 16, how: str = "inner", most: int = MOST_KEYS) -> DataFrame:
    """An equality join whose frequent keys are spread over salts.

    Frequent keys are found by a count, which combines before its shuffle, and come as a list of at most `most`, so the fact
    is flagged where it lies; only their rows of `other` are copied. Of more frequent keys than that none stands out much:
    then adaptive execution splits what is skewed.
    """
    if how not in ("inner", "left"):
        raise ValueError("the copies of other's rows make sense for inner and left joins only")
    found = frequent_keys(fact.filter(F.col(key).isNotNull()), key, least).select(key).limit(most + 1).collect()
    if not found or len(found) > most:
        return fact.join(other, key, how)
    hot = F.broadcast(fact.sparkSession.createDataFrame(found, fact.select(key).schema).withColumn("_salts", F.lit(salts)))
    spread = fact.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copied = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    copied = copied.withColumn("_salt", F.col("_salt").cast("long"))
    return spread.join(copied, [key, "_salt"], how).drop("_salt")


def random_salt(df: DataFrame, salts: int, seed: int, name: str = "salt") -> DataFrame:
    """df with a seeded random salt (X14). Another run draws alike only if rows lie alike: results must not hang on it."""
    return df.withColumn(name, F.floor(F.rand(seed) * salts).cast("int"))
