"""Surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def surrogate_keys(
    members: DataFrame, natural: Sequence[str], key: str, after: Column | int = 0, digits: int = 3
) -> DataFrame:
    """Number the members ``after + 1, after + 2, ...`` in the order of the digest of their natural key.

    The members must be distinct. They are spread over ``16 ** digits`` buckets by the first digits of
    the digest; each bucket is numbered on its own and shifted by the size of the buckets before it.
    The numbers are dense and depend on the data alone, and no task ever sees all members: the only
    global step runs over the bucket sizes, at most ``16 ** digits`` rows.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural]))
    marked = members.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))

    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        marked.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", *natural)
    start = F.lit(after) if isinstance(after, int) else after
    return (
        marked.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(shifts), "_bucket")
        .withColumn(key, (start + F.col("_shift") + F.col("_rank")).cast("bigint"))
        .select(key, *members.columns)
    )
