"""Which documents a model may learn from."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds`` (null: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def hash_rank(*columns: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1 << 40)).cast("double") / float(1 << 40)


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of ``key``: a sample that does not depend on the order of the rows.

    All but a little more than that share of the rows is filtered out where it is read, so the final choice is among few.
    """
    share = 1.2 * most / max(1, rows.count())
    return rows.filter(hash_rank(key) <= share).orderBy(hash_rank(key), key).limit(most)


def send(spark: SparkSession, value):
    """Hand ``value`` to the tasks; returns what opens it there.

    The value travels as bytes that hold its classes too, so that executors need not have this package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def opened():
        return pickle.loads(sent.value)

    return opened
