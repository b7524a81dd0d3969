"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a hash of 36 bits. Words are summed by source and by the first 12 bits; the sums show in
which bucket a source's budget ends. Only that bucket is summed again by the next 12 bits, and then by the
last. A document below its source's threshold is taken. Targets are filled up like water: sources in the order
of their cap per weight, capped as long as the level lies above their cap.

Defined cases: a null text has size 0, a null source is a source of its own and ranks last. Rows that agree in
id and text share a hash, so they are taken or left together. Input columns with the name of a result column
are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, saved, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS = 12
LEVELS = 3


def document_hash(doc_id: str, text: str) -> Column:
    """36 bits, as nine hexadecimal digits of an MD5."""
    value = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), filled(text)))
    return F.conv(F.substring(value, 1, 9), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``target`` words for a row per source with its ``source_size``.

    The windows run over one row per source, after the sums; no document goes through them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    rank = F.row_number().over(order) - 1
    ranked = sources.withColumn("weight", F.get(cycle, rank % len(weights)))
    ranked = ranked.withColumn("cap", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumns(
        {
            "left": total - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "rest": F.sum("weight").over(after),
        }
    )
    # The source's share if all before it are capped and none after it.
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("rest").cast("double")
    ranked = ranked.withColumn("capped", F.col("cap") <= share)
    everywhere = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(~F.col("capped"), F.struct("left", "rest")), ignorenulls=True).over(everywhere)
    ranked = ranked.withColumn("level", level)
    filled_up = (F.col("weight") * F.col("level.left")).cast("double") / F.col("level.rest").cast("double")
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(filled_up).alias("target"),
    )


def with_thresholds(slim: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with whole ``rounds`` and the hash ``threshold`` below which a document is taken once more."""
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = sources.withColumn("rounds", rounds.cast("long"))
    state = state.withColumns(
        {"prefix": F.lit(0).cast("long"), "budget": F.col("target") - F.col("rounds") * F.col("source_size")}
    )
    kept = ["source", "source_size", "target", "rounds"]
    for level in range(LEVELS):
        state = saved(state, f"mix-level{level}")
        shift = BITS * (LEVELS - 1 - level)
        own = state.select(F.col("source").alias("source2"), F.col("prefix").alias("prefix2"), "budget")
        inside = F.col("source").eqNullSafe(F.col("source2")) & (
            F.shiftright("h", shift + BITS) == F.col("prefix2")
        )
        sums = (
            slim.join(own, inside)
            .groupBy("source", F.shiftright("h", shift).bitwiseAND((1 << BITS) - 1).alias("bucket"), "budget")
            .agg(F.sum("size").alias("size"))
        )
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        over = F.col("upto") > F.col("budget")
        ends = (
            sums.withColumn("upto", upto)
            .groupBy(F.col("source").alias("source3"))
            .agg(
                F.min(F.when(over, F.col("bucket"))).alias("bucket"),
                F.max(F.when(~over, F.col("upto"))).alias("used"),
                F.min(F.when(over, F.col("upto"))).alias("next"),
            )
        )
        state = state.join(ends, F.col("source").eqNullSafe(F.col("source3")), "left")
        left = F.col("budget") - F.coalesce("used", F.lit(0))
        prefix = F.col("prefix") * (1 << BITS) + F.coalesce("bucket", F.lit(0))
        if level == LEVELS - 1:  # the last bucket is taken if that comes nearer to the target
            nearer = F.coalesce(F.col("next") - F.col("budget") < left, F.lit(False))
            return saved(state.select(*kept, (prefix + nearer.cast("long")).alias("threshold")), "mix-sources")
        state = state.select(*kept, prefix.alias("prefix"), left.alias("budget"))
    raise AssertionError


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """``docs`` with size, source_size, target (the source's), repeats and taken words."""
    size = F.size(words(filled(text))).cast("long")
    slim = docs.select(F.col(source).alias("source"), size.alias("size"), document_hash(doc_id, text).alias("h"))
    slim = saved(slim, "mix-sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = with_thresholds(slim, targets(sources, weights, max_repeats))
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "repeats", "taken")]
    repeats = F.col("__rounds") + (F.col("__h") < F.col("__threshold")).cast("long")
    return (
        docs.withColumns({"__size": size, "__h": document_hash(doc_id, text)})
        .join(plan, F.col(source).eqNullSafe(F.col("__source")), "left")
        .select(
            *own,
            F.col("__size").alias("size"),
            F.col("__source_size").alias("source_size"),
            F.col("__target").alias("target"),
            repeats.alias("repeats"),
            (F.col("__size") * repeats).alias("taken"),
        )
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the documents of the mix, each with how often it is repeated."""
    return mix(docs).filter("taken > 0")
