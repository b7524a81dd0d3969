"""Hard negatives by exact integer scores, with tables in place of multiplications (the Four Russians' way).

Components become integers, ``floor(256 * x)``. A candidate is kept as packed bit planes: for each of its bits in two's
complement, and each group of eight dimensions, one byte. An anchor gives one table per group of eight dimensions: the
sum of its components over each of the 256 subsets. An inner product is then read out of the tables: for each plane
from the sign's downwards the running score is doubled and the sums that the plane's bytes point at are added (the sign's
plane counts negative). All sums are integers, so scores are exact and need no second scoring.

Work is done in blocks: up to ``MAX_COMPONENTS`` anchor components go to the executors at a time, a size that does not
grow with the data, and every task runs all its candidates past them. Two passes are made over a block: the first
finds each anchor's positives, the second its negatives, in the bands that the positives' scores set. A task keeps
only the first few of each list; the lists of all tasks meet in a ranking window, which cuts them once more before
they are shuffled. Each (anchor, candidate) pair of equal label is scored in the first pass only, each other one in the
second only.

Defined cases: rows with a null id, label or vector, or with a component that is null, not finite, or not below
``LIMIT / 256`` in size (beyond that scores would not fit 64 bits) take no part. Of vectors of different lengths the
shorter counts as filled up with zeros; an empty one scores 0. Each row counts for itself, repeated rows too; rows with
the anchor's own id are not among its others. Ties go to the smaller id. An anchor without another row of its label
has no result, nor has a positive whose band holds no row, as with negative scores. An empty table gives an
empty result. There are no texts; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import saved

SCALE = 256
LIMIT = 1 << 25  # size of a component as an integer; products of 4 096 dimensions then fit 64 bits
MAX_COMPONENTS = 1 << 21  # of the anchors sent at a time: 16 MB
CHUNK_ROWS = 1 << 15  # candidates that a task gathers before it makes the anchors' tables
SLICE_ROWS = 2048
ANCHORS_A_TABLE = 256

PACKED = "id long, label long, planes int, bits binary"
HITS = "a int, p int, score long, id long"


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """The rows that take part: id, label and the integer components ``q``."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) * SCALE < LIMIT - 1, F.lit(False)) & ~F.isnan(v))
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & sound)
    return rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("q"),
    )


def matrix(rows) -> np.ndarray:
    """Integer vectors as a matrix, the shorter ones filled up with zeros, eight columns a group."""
    sizes = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), -(-int(sizes.max(initial=0)) // 8) * 8), np.int64)
    for size in np.unique(sizes):
        at = np.nonzero(sizes == size)[0]
        out[at, :size] = np.array([rows[k] for k in at], np.int64).reshape(len(at), size)
    return out


def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bit planes of each row, the lowest first, each a byte per group of eight dimensions."""
    for rows in batches:
        q = matrix(rows["q"].to_list())
        planes = int(np.abs(q).max(initial=0)).bit_length() + 1
        bits = [np.packbits(((q >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)]
        stacked = np.stack(bits, axis=1)
        yield pd.DataFrame(
            {"id": rows["id"], "label": rows["label"], "planes": planes, "bits": [row.tobytes() for row in stacked]}
        )


def unpack(rows: pd.DataFrame) -> np.ndarray:
    """The planes of all rows as (rows, planes, groups); fewer planes are carried on by the sign's."""
    planes = rows["planes"].to_numpy()
    groups = rows["bits"].str.len().to_numpy() // planes
    out = np.zeros((len(rows), int(planes.max()), int(groups.max())), np.uint8)
    values = rows["bits"].to_numpy()
    for p, g in set(zip(planes.tolist(), groups.tolist())):
        at = np.nonzero((planes == p) & (groups == g))[0]
        if g:
            out[at, :p, :g] = np.frombuffer(b"".join(values[at]), np.uint8).reshape(len(at), p, g)
            out[at, p:, :g] = out[at, p - 1 : p, :g]
    return out


def subset_sums(q: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums over its subsets."""
    groups = q.shape[1] // 8
    out = np.zeros((groups, 256, len(q)), dtype)
    for g in range(groups):
        for j in range(8):
            out[g, 1 << j : 2 << j] = out[g, : 1 << j] + q[:, 8 * g + j].astype(dtype)
    return out


def scores(bits: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all anchors by lookup, addition and shift."""
    n, planes, groups = bits.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for p in reversed(range(planes)):
        total <<= 1
        for g in range(min(groups, len(tables))):
            np.take(tables[g], bits[:, p, g], axis=0, out=found, mode="clip")
            if p == planes - 1:
                total -= found
            else:
                total += found
    return total


class Best:
    """The first ``k`` of each list by score and id."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.of, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(lists, np.iinfo(np.int64).min)  # score and id of the last of a full list
        self.least_id = np.full(lists, np.iinfo(np.int64).max)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = score.astype(np.int64)
        new = (score > self.least[of]) | ((score == self.least[of]) & (ids < self.least_id[of]))
        if not new.any():
            return
        of, score, ids = (np.concatenate([a, b[new]]) for a, b in ((self.of, of), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, of))
        of, score, ids = of[order], score[order], ids[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        keep = place < self.k
        last = place == self.k - 1
        self.least[of[last]], self.least_id[of[last]] = score[last], ids[last]
        self.of, self.score, self.id = of[keep], score[keep], ids[keep]


def searcher(sent, bands: int, k: int, within: bool):
    """A function over packed candidates that gives each task's first ``k`` of every list.

    With ``within``, an anchor has one list: rows of its own label. Otherwise it has ``bands`` lists: rows of other
    labels whose score lies in the band.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = sent.value
        ids, labels, q = anchors["id"], anchors["label"], anchors["q"]
        best = {}

        def run(rows: pd.DataFrame) -> None:
            bits, cand, kind = unpack(rows), rows["id"].to_numpy(), rows["label"].to_numpy()
            # Scores, and sums on the way, are below half of what the type holds.
            most = int(np.abs(q).sum(axis=1).max(initial=0)) << bits.shape[1]
            dtype = np.int32 if most < 1 << 30 else np.int64
            for start in range(0, len(ids), ANCHORS_A_TABLE):
                own = slice(start, min(start + ANCHORS_A_TABLE, len(ids)))  # anchors are in order of their labels
                at = np.arange(len(cand))
                if within:
                    at = np.nonzero((kind >= labels[own][0]) & (kind <= labels[own][-1]))[0]
                if not len(at):
                    continue
                tables = subset_sums(q[own], dtype)
                lists = best.setdefault(start, Best((own.stop - start) * bands, k))
                for first in range(0, len(at), SLICE_ROWS):
                    part = at[first : first + SLICE_ROWS]
                    found = scores(bits[part], tables)
                    same = kind[part][:, None] == labels[own][None, :]
                    if within:
                        fits = same & (cand[part][:, None] != ids[own][None, :])
                        add(lists, found, fits & (found >= lists.least), 0, cand[part])
                    else:
                        for p in range(bands):
                            low = np.maximum(anchors["low"][own, p], lists.least[p::bands])
                            fits = (found >= low) & (found <= anchors["high"][own, p]) & ~same
                            add(lists, found, fits & (cand[part][:, None] != ids[own][None, :]), p, cand[part])

        def add(lists: Best, found: np.ndarray, fits: np.ndarray, p: int, cand: np.ndarray) -> None:
            row, col = np.nonzero(fits)
            if len(row):
                lists.add(col * bands + p, found[row, col], cand[row])

        waiting, n = [], 0
        for rows in batches:
            waiting.append(rows)
            n += len(rows)
            if n >= CHUNK_ROWS:
                run(pd.concat(waiting))
                waiting, n = [], 0
        if n:
            run(pd.concat(waiting))
        for start, lists in best.items():
            yield pd.DataFrame(
                {"a": start + lists.of // bands, "p": lists.of % bands + 1, "score": lists.score, "id": lists.id}
            )

    return search


def first_of_each(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "p").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def anchor_blocks(rows: DataFrame, wanted: Column) -> tuple[DataFrame, int]:
    """The anchors with the number of their block, dealt out evenly, and the number of blocks."""
    anchors = saved(rows.filter(wanted), "anchors")
    n, width = anchors.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, -(-n * max(width or 0, 8) // MAX_COMPONENTS))
    return saved(anchors.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchor-blocks"), blocks


def mine(
    vectors: DataFrame,
    wanted: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """For each anchor (``wanted`` over id) and each of its first ``positives`` rows of equal label, the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, vector, label)
    packed = saved(rows.mapInPandas(pack, PACKED), "packed")
    anchors, blocks = anchor_blocks(rows, wanted)
    found = []
    for block in range(blocks):
        own = anchors.filter(F.col("block") == block).toPandas().sort_values(["label", "id"], ignore_index=True)
        if not len(own):
            continue
        state = {"id": own["id"].to_numpy(), "label": own["label"].to_numpy(), "q": matrix(own["q"].to_list())}
        sent = spark.sparkContext.broadcast(state)
        hits = packed.mapInPandas(searcher(sent, 1, positives, True), HITS)
        near = saved(first_of_each(hits, positives), "positives")
        # As many rows as the block has anchors, times the positives: bounded as the block is.
        best = near.select("a", "rank", "score").toPandas()
        at = best["a"].to_numpy(), best["rank"].to_numpy() - 1
        lows = np.full((len(own), positives), np.iinfo(np.int64).max)
        highs = np.full((len(own), positives), np.iinfo(np.int64).min)
        score = best["score"].to_numpy()
        lows[at], highs[at] = -(-low * score // 100), high * score // 100
        sent.unpersist()
        sent = spark.sparkContext.broadcast({**state, "low": lows, "high": highs})
        hits = packed.mapInPandas(searcher(sent, positives, negatives, False), HITS)
        far = first_of_each(hits, negatives).select(
            "a", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        )
        pairs = near.select("a", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = spark.createDataFrame(pd.DataFrame({"a": np.arange(len(own)), "anchor_id": state["id"]}), "a int, anchor_id long")
        found.append(saved(far.join(pairs, ["a", "p"]).join(named, "a").drop("a"), "negatives"))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, found).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
