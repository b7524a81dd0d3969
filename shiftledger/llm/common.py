"""Expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.session import work_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def let(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is computed once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running(values: Column, op) -> Column:
    """The integers combined up to each place by ``op``, which is associative: sums, greatest, least.

    Arrays can't be added to in place, so n places at once would cost n * n steps. Blocks of about the root of n
    are combined each, then their totals: n times the root of n.
    """
    none = F.array().cast("array<int>")

    def plain(block: Column) -> Column:
        def add(done, x):
            return F.concat(done, F.array(F.when(F.size(done) > 0, op(F.try_element_at(done, F.lit(-1)), x)).otherwise(x)))

        return F.aggregate(block, none, add)

    def of_blocks(blocks: Column) -> Column:
        totals = plain(F.transform(blocks, lambda b: F.try_element_at(b, F.lit(-1))))
        return let(
            totals,
            lambda t: F.flatten(
                F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(t, i - 1), x))))
            ),
        )

    def of_values(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), size)
        return F.when(F.size(v) < 3, plain(v)).otherwise(
            let(F.transform(starts, lambda at: plain(F.slice(v, at, size))), of_blocks)
        )

    return let(values, of_values)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and the size is known to the planner."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
