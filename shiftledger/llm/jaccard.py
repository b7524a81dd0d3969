"""N-gram Jaccard self join with set-relation skipping, and its connected components.

A document's set holds its distinct word shingles. Two documents link where 100 x intersection is at least
``percent`` x union. Equal sets are one class from the start, so copies cost one row each.

Order. Shingles are ordered by how often they occur, rare ones first, then by hash. The counts come from all
texts; only the order depends on them, so the ``MAX_OFTEN`` most frequent ones suffice. A set is listed under the
shingles of its prefix, which two sets that link must share.

Skipping lists. An index list is cut into blocks by set size; a set is sent only to the blocks of sizes that can
link with its own. Within a block a pair is left out where the places of the shared shingle in the two sets leave
too few shingles behind it for a link.

Deriving answers. Each block has a leader, the set in which the shingle stands first. All others of the block are
compared with the leader. Sets found to link with the same leader are in one component, which is their answer to
one another: only pairs of different components are compared after that. What is compared grows with the lists,
not with the square of a group of copies. Of each pair, bit sketches bound what it can share, and only pairs that
the bound leaves possible are compared in full.

Defined cases: a text without words, empty or null, has an empty set and links with nothing, not even another
empty one. A text with fewer words than a shingle has one shingle, all its words. A null id doesn't count as
smallest; a component without any id has a null id. Repeated rows are copies. Other columns of the input are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, saved

N_WORDS = 4
PERCENT = 85
MAX_OFTEN = 1 << 17
FLUSH_SHINGLES = 2_000_000
SIZE_STEP = 1.06
# Odd multipliers for the words of a shingle.
MULTIPLIERS = tuple(
    np.uint64(x)
    for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. bytes.lower and split know ASCII only."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.int64)
    if len(words) < n_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - n_words + 1
    total = np.zeros(n, dtype=np.uint64)
    for k in range(n_words):
        total = (total ^ h[k : k + n]) * MULTIPLIERS[k % len(MULTIPLIERS)]
        total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


SLIM = "doc_id long, text_key long, sid long, n_shingles long, shingle long, n long, sketch binary"


def set_id(found: np.ndarray) -> int | None:
    """64 bits that equal sets share; none for the empty set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(found.tobytes())))) if len(found) else None


def sketch_of(found: np.ndarray) -> bytes:
    """A bit for each value that the low bits of the shingles take; four or more times as many bits as shingles."""
    bits = 1 << max(6, (4 * len(found) - 1).bit_length())
    taken = np.zeros(bits, dtype=bool)
    taken[found & (bits - 1)] = True
    return np.packbits(taken).tobytes()


def most_shared(x: bytes, y: bytes, n_x: int, n_y: int) -> int:
    """At most so many shingles are shared: each bit that only one set has stands for a shingle that only it has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):  # fewer low bits fold the longer sketch
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n_x - int(np.unpackbits(a & ~b).sum()), n_y - int(np.unpackbits(b & ~a).sum()))


def slim_rows(n_words: int):
    """Per document its set's id, size and sketch; per task the shingles that several of its sets hold, with how many do."""

    def often(held: list[np.ndarray]) -> pd.DataFrame:
        shingle, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"shingle": shingle[n > 1], "n": n[n > 1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0
        for frame in frames:
            rows = []
            for doc_id, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"]):
                found = shingles(text, n_words)
                sid = set_id(found)
                sketch = None if sid is None else sketch_of(found)
                rows.append((None if pd.isna(doc_id) else int(doc_id), key, sid, len(found), sketch))
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    held.append(found)
                    size += len(found)
                if size > FLUSH_SHINGLES:
                    yield complete(often(held))
                    held, size = [], 0
                    seen.clear()
            yield complete(pd.DataFrame(rows, columns=["doc_id", "text_key", "sid", "n_shingles", "sketch"], dtype=object))
        if held:
            yield complete(often(held))

    def complete(frame: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in SLIM.split(", ")]
        frame = frame.reindex(columns=names)
        return frame.astype({c: "Int64" for c in names[:-1]} | {"sketch": object}).replace({"sketch": {np.nan: None}})

    return run


def prefixes(n_words: int, percent: int, sent: Broadcast):
    """Per document its set's id, size and prefix, in the order of the shingles' frequency."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, weights = sent.value
        for frame in frames:
            rows, seen = [], set()
            for text in frame["text"]:
                found = shingles(text, n_words)
                sid = set_id(found)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                weight = np.zeros(len(found), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    weight = np.where(known[at] == found, weights[at], 0)
                n = len(found) - -(-percent * len(found) // 100) + 1
                rows.append((sid, len(found), found[np.argsort(weight, kind="stable")[:n]]))
            yield pd.DataFrame(rows, columns=["sid", "size", "prefix"])

    return run


def whole_sets(n_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(set_id(found), found) for found in (shingles(t, n_words) for t in frame["text"])]
            yield pd.DataFrame(rows, columns=["sid", "shingles"])

    return run


def needed(x: Column, y: Column, percent: int) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(percent * (x + y) / (100 + percent)).cast("int")


def block_of(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(SIZE_STEP))).cast("int")


def listed(index: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Targets (a set in the block of its size) and probes (a set sent to all blocks of sizes not above its own).

    A row goes to a block only if enough shingles stand behind its place to link with some size of the block.
    """
    size, place = F.col("size"), F.col("place")
    targets = index.filter(size - place >= needed(size, size, percent)).withColumn("block", block_of(size))
    least = F.ceil(percent * size / 100).cast("int")
    probes = index.withColumn("least", least).withColumn(
        "block", F.explode(F.sequence(block_of(F.col("least")), block_of(size)))
    )
    lowest = F.greatest(F.ceil(F.pow(F.lit(SIZE_STEP), F.col("block")) - 1e-6).cast("int"), F.col("least"))
    return targets, probes.filter(size - place >= needed(size, lowest, percent)).drop("least")


def possible(percent: int) -> Column:
    """Whether (size, place) and (size2, place2) of a shared shingle leave a link of two sets possible."""
    size, place, size2, place2 = (F.col(c) for c in ("size", "place", "size2", "place2"))
    return (100 * F.least(size, size2) >= percent * F.greatest(size, size2)) & (
        F.least(size - place, size2 - place2) >= needed(size, size2, percent)
    )


def pairs_of(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs (a, b, size, size2) of sets listed in the same block that meet the condition."""
    named = right.select([F.col(c).alias(f"{c}2") for c in right.columns])
    same = (F.col("shingle") == F.col("shingle2")) & (F.col("block") == F.col("block2"))
    found = left.join(named, same & condition).select("sid", "sid2", "size", "size2")
    up = F.col("sid") < F.col("sid2")
    return found.select(
        F.least("sid", "sid2").alias("a"),
        F.greatest("sid", "sid2").alias("b"),
        F.when(up, F.col("size")).otherwise(F.col("size2")).alias("size"),
        F.when(up, F.col("size2")).otherwise(F.col("size")).alias("size2"),
    ).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, size, size2) that link, with their intersection ``both``."""
    of_a = sets.select(F.col("sid").alias("a2"), F.col("shingles").alias("of_a"))
    of_b = sets.select(F.col("sid").alias("b2"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = pairs.join(of_a, F.col("a") == F.col("a2")).join(of_b, F.col("b") == F.col("b2"))
    found = found.select("a", "b", "size", "size2", both.alias("both"))
    return found.filter(F.col("both") >= needed(F.col("size"), F.col("size2"), percent))


def components(edges: DataFrame) -> DataFrame:
    """Node and label (least node) of every node that has an edge (a, b), by large and small stars.

    Each round writes its edges, so nothing is computed twice and no lineage grows.
    """
    own = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = print_of(own)
    while True:
        both = own.union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("u2")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u2"))
        large = both.join(low, F.col("u") == F.col("u2")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy(F.col("u").alias("u2")).agg(F.min("v").alias("m"))
        joined = large.join(low, F.col("u") == F.col("u2"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u2", "m"))
        own = saved(small.filter("u <> v").distinct(), "edges")
        now = print_of(own)
        if now == seen:
            labels = own.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("label"))
            return labels.union(own.select("v", "v").distinct())
        seen = now


def linked_sets(docs: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Slim rows (doc_id, text_key, sid, n_shingles) of ``docs`` (doc_id, text) and edges that connect what links."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    slim = saved(rows.mapInPandas(slim_rows(n_words), SLIM), "jaccard-slim")
    often = slim.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "shingle").limit(MAX_OFTEN).orderBy("shingle").toArrow()
    sent = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("shingle", "n")))
    slim = slim.filter("shingle IS NULL").drop("shingle", "n")

    found = rows.select("text").mapInPandas(prefixes(n_words, percent, sent), "sid long, size int, prefix array<long>")
    found = found.groupBy("sid").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    index = found.select("sid", "size", F.posexplode("prefix").alias("place", "shingle"))
    sets_of = F.count(F.lit(1)).over(Window.partitionBy("shingle"))
    index = saved(index.withColumn("sets", sets_of).filter("sets > 1").drop("sets"), "jaccard-index")

    targets, probes = listed(index, percent)
    first = F.min(F.struct("place", (-F.col("size")).alias("less"), "sid"))
    leaders = targets.groupBy("shingle", "block").agg(first.alias("x"))
    leaders = leaders.select(
        "shingle", "block", F.col("x.sid").alias("sid"), (-F.col("x.less")).alias("size"), F.col("x.place").alias("place")
    )
    leaders = saved(leaders, "jaccard-leaders")
    near = saved(near_leaders(probes, leaders, percent), "jaccard-near")
    links = saved(linked_pairs(near, rows, slim, n_words, percent), "jaccard-links")
    labels = saved(components(links), "jaccard-labels")

    # Who links with a leader has an answer; left are pairs of different components. In a block, those of the
    # leader's component are not compared with one another.
    of_sid = labels.select(F.col("sid").alias("sid3"), "label")

    def labelled(df: DataFrame) -> DataFrame:
        found = df.join(of_sid, F.col("sid") == F.col("sid3"), "left")
        return found.select(*df.columns, F.coalesce("label", "sid").alias("label"))

    lead = labelled(leaders).select(
        F.col("shingle").alias("shingle4"), F.col("block").alias("block4"), F.col("label").alias("lead")
    )
    same = (F.col("shingle") == F.col("shingle4")) & (F.col("block") == F.col("block4"))

    def led(df: DataFrame) -> DataFrame:
        return df.join(lead, same).select(*df.columns, (F.col("label") != F.col("lead")).alias("apart"))

    targets, probes = listed(saved(labelled(index), "jaccard-labelled"), percent)
    probes, targets = led(probes), saved(led(targets), "jaccard-targets")
    larger = (F.col("size") > F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("sid") < F.col("sid2")))
    open_pair = (F.col("label") != F.col("label2")) & larger & possible(percent)
    rest = pairs_of(probes.filter("apart"), targets, open_pair).union(
        pairs_of(probes.filter("NOT apart"), targets.filter("apart"), open_pair)
    )
    done = near.select(F.col("a").alias("a9"), F.col("b").alias("b9"))
    rest = rest.distinct().join(done, (F.col("a") == F.col("a9")) & (F.col("b") == F.col("b9")), "left_anti")
    rest = saved(rest, "jaccard-rest")
    more = saved(linked_pairs(rest, rows, slim, n_words, percent), "jaccard-more")
    return slim, labels.select("sid", "label").union(more.select("a", "b")).toDF("a", "b")


def near_leaders(probes: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, size, size2) of sets and the leaders of their blocks that may link."""
    return pairs_of(probes, leaders, (F.col("sid") != F.col("sid2")) & possible(percent))


def linked_pairs(pairs: DataFrame, rows: DataFrame, slim: DataFrame, n_words: int, percent: int) -> DataFrame:
    """The pairs that link. Sketches rule out most others first, so whole sets are made for few."""
    sids = pairs.select(F.explode(F.array("a", "b")).alias("sid4")).distinct()
    known = slim.join(sids, F.col("sid") == F.col("sid4"), "left_semi")
    sketches = saved(known.select("sid", "sketch").dropDuplicates(["sid"]), "jaccard-sketches")

    def bound(x: pd.Series, y: pd.Series, n_x: pd.Series, n_y: pd.Series) -> pd.Series:
        return pd.Series([most_shared(*v) for v in zip(x, y, n_x, n_y)], dtype="int32")

    of_a = sketches.select(F.col("sid").alias("a2"), F.col("sketch").alias("of_a"))
    of_b = sketches.select(F.col("sid").alias("b2"), F.col("sketch").alias("of_b"))
    both = pairs.join(of_a, F.col("a") == F.col("a2")).join(of_b, F.col("b") == F.col("b2"))
    both = both.withColumn("most", F.pandas_udf(bound, "int")("of_a", "of_b", "size", "size2"))
    likely = both.filter(F.col("most") >= needed(F.col("size"), F.col("size2"), percent))
    likely = saved(likely.select("a", "b", "size", "size2"), "jaccard-likely")
    sets = saved(sets_of_pairs(likely, rows, slim, n_words), "jaccard-sets")
    return verified(likely, sets, percent)


def sets_of_pairs(pairs: DataFrame, rows: DataFrame, slim: DataFrame, n_words: int) -> DataFrame:
    """(sid, shingles) of the sets in the pairs; one document is read for each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid4")).distinct()
    one = F.min(F.struct("text_key", "doc_id"))
    reps = slim.join(wanted, F.col("sid") == F.col("sid4"), "left_semi").groupBy("sid").agg(one.alias("x"))
    reps = saved(reps.select(F.col("x.text_key").alias("key2"), F.col("x.doc_id").alias("id2")), "jaccard-reps")
    chosen = (F.col("text_key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("id2"))
    texts = rows.join(reps, chosen).dropDuplicates(["text_key", "doc_id"]).select("text")
    return texts.mapInPandas(whole_sets(n_words), "sid long, shingles array<long>")


def join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = N_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, sid and label (the set's and the component's), n_shingles, component_id."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slim, links = linked_sets(docs, n_words, percent)
    labels = saved(components(links), "jaccard-components")
    of_sid = labels.select(F.col("sid").alias("sid2"), "label")
    slim = slim.drop("sketch")
    rows = slim.join(of_sid, F.col("sid") == F.col("sid2"), "left")
    rows = rows.select(*slim.columns, F.coalesce("label", "sid").alias("label"))
    rows = saved(rows, "jaccard-rows")
    smallest = rows.filter("label IS NOT NULL").groupBy(F.col("label").alias("label2")).agg(F.min("doc_id").alias("low"))
    rows = rows.join(smallest, F.col("label") == F.col("label2"), "left")
    own = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return rows.select("doc_id", "text_key", "sid", "label", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """``docs`` with one document of each component: of the smallest id, then text hash, then the other columns.

    Documents without words have no component and all stay.
    """
    rows = join(docs, n_words=n_words, percent=percent).filter("label IS NOT NULL")
    rows = rows.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n"))
    kept = rows.groupBy("label").agg(first.alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("__id"), F.col("x.text_key").alias("__key"), F.col("x.n").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    chosen = docs.join(saved(kept, "jaccard-kept"), same)
    once = chosen.filter(F.col("__n") == 1).select(docs.columns)
    row = F.min(F.struct(*docs.columns)).alias("row")  # one of the rows that repeat
    repeated = chosen.filter(F.col("__n") > 1).groupBy("__id", "__key").agg(row).select("row.*")
    without = docs.filter(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return once.union(repeated).union(without)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of near duplicates by five words and a similarity of 0.8 one stays."""
    return one_of_each(docs, n_words=5, percent=80)
