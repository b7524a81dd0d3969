"""Language-model scoring by context-tree weighting over bytes, beside a smoothed word model.

A byte is eight binary decisions, each in the context of the decisions before it and of the last 0 to ``DEPTH``
bytes. Every node of a context tree holds a Krichevsky-Trofimov estimate of its own decisions; its weighted
probability is half that estimate and half the product of its children's. Training counts byte n-grams and sums
them up the tree level by level, as groupings. A prediction mixes the estimates along the path from the empty
context down by the weights that training gave each depth. A text starts after ``DEPTH`` zero bytes and ends with
one.

Nodes and n-grams go to the executors with at most ``MAX_NODES`` per depth, the most frequent ones. Where a node
beyond may be on the path of an n-gram, the document's n-gram is joined with the nodes of all depths, so scores do
not depend on what is broadcast. Of the words, the ``HOT_WORDS`` most frequent are broadcast with
their counts; the others of each document are joined with the counts of all words.

Defined cases: a null text is empty. A null id is of the training part, as its text is empty. Without training
texts every decision has probability one half. Repeated rows are counted and scored each. Input columns other than
id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, saved

DEPTH = 3
MAX_NODES = 1 << 21
HOT_WORDS = 1 << 17
CHUNK_BYTES = 4_000_000
FLUSH_WORDS = 250_000
FLUSH_GRAMS = 500_000
TABLE_BITS = 21
WORD, GRAM = 0, 1


def in_training(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def words_of(data: bytes) -> list[bytes]:
    """Words as UTF-8, A-Z in lower case; both methods of bytes know ASCII only."""
    return data.lower().split()


def key_of(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word)
    return x - (1 << 64) if x >= 1 << 63 else x


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code (context and byte) of every byte and end of the texts, and where each text's codes start."""
    data = np.frombuffer(b"".join(bytes(depth) + t + b"\0" for t in texts), dtype=np.uint8).astype(np.int64)
    code = np.zeros(len(data) - depth, dtype=np.int64)
    for k in range(depth + 1):
        code = (code << 8) | data[k : len(data) - depth + k]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths + depth) - lengths - depth
    own = np.ones(len(code), dtype=bool)
    for k in range(depth):  # codes that end in the padding of the next text
        own[(starts[1:] - 1 - k)] = False
    return code[own], np.cumsum(lengths) - lengths


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in frames of about ``CHUNK_BYTES`` of text."""
    for frame in frames:
        size = frame["text"].str.len().cumsum() // CHUNK_BYTES
        for _, part in frame.groupby(size, sort=True):
            yield part


def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts (kind, key, n) of a task's words, ends of text included, and byte n-grams."""

    def rows(kind: int, keys, n) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(kind), "key": np.asarray(keys, np.int64), "n": np.asarray(n, np.int64)})

    def of_words() -> pd.DataFrame:
        return rows(WORD, [key_of(w) for w in words], list(words.values()))

    words: Counter = Counter()
    grams, held = [], 0
    for part in chunks(frames):
        texts = [t.encode("utf-8", "replace") for t in part["text"]]
        for t in texts:
            words.update(words_of(t))
        words[b""] += len(texts)
        if len(words) > FLUSH_WORDS:
            yield of_words()
            words.clear()
        code, n = np.unique(grams_of(texts, DEPTH)[0], return_counts=True)
        grams.append((code, n))
        held += len(code)
        if held > FLUSH_GRAMS:
            merged = merge(grams)
            if len(merged[0]) > FLUSH_GRAMS / 2:
                yield rows(GRAM, *merged)
                grams, held = [], 0
            else:
                grams, held = [merged], len(merged[0])
    if words:
        yield of_words()
    if grams:
        yield rows(GRAM, *merge(grams))


def merge(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    n = np.bincount(where, weights=np.concatenate([n for _, n in counted]))
    return keys, n.astype(np.int64)


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, brought back by the recurrence."""
    z = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def kt(n0: Column, n1: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = n0.cast("double"), n1.cast("double")
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)


def tree(grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """By depth, the nodes (key, n, p1, stop): ``stop`` is the weight of a node's own estimate.

    A node's key is its context's bytes and the decisions made of the byte, after a leading one.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step")
    bits = grams.select(F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).alias("byte"), "n", step)
    made = F.expr("shiftleft(1L, step) | shiftright(byte, 8 - step)")
    bit = F.expr("shiftright(byte, 7 - step) & 1")
    level = bits.groupBy("context", made.alias("made")).agg(
        F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("n1"),
        F.lit(None).cast("double").alias("below"),
    )
    found = []
    for d in range(depth, -1, -1):
        level = level.withColumn("own", kt(F.col("n0"), F.col("n1")))
        high = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2)
        level = level.withColumn("weighted", F.coalesce(high, F.col("own")))
        level = saved(level, f"lm-depth{d}")
        stop = F.coalesce(0.5 * F.exp(F.when(F.col("below").isNotNull(), F.col("own") - F.col("weighted"))), F.lit(1.0))
        n = F.col("n0") + F.col("n1")
        found.append(
            level.select(
                (F.col("context") * 256 + F.col("made")).alias("key"),
                n.alias("n"),
                ((F.col("n1") + 0.5) / (n + 1)).alias("p1"),
                stop.alias("stop"),
            )
        )
        shorter = F.col("context").bitwiseAND((1 << 8 * max(d - 1, 0)) - 1)
        level = level.groupBy(shorter.alias("context"), "made").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
        )
    return found[::-1]


def most_frequent(rows: DataFrame, most: int) -> tuple[dict[str, np.ndarray], bool]:
    """The rows as arrays ordered by key: all, or the ``most`` frequent where there are more; and whether it is all."""
    whole = rows.count() <= most
    if not whole:
        rows = rows.orderBy(F.desc("n"), "key").limit(most)
    table = rows.toArrow()
    found = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.argsort(found["key"])
    return {c: values[order] for c, values in found.items()}, whole


def evaluated(codes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(code, value): as ``Model.evaluate`` for each distinct code, from the nodes of all depths.

    Depths 0 and 1 have at most 257 x 255 nodes and are broadcast; a deeper node is met by at most 2^16 steps of codes.
    """
    steps = codes.select("code", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"))
    made = F.expr("shiftleft(1L, step) | shiftright(code & 255, 8 - step)")
    context = F.shiftright("code", 8)
    met = []
    for depth, level in enumerate(levels):
        key = (context.bitwiseAND((1 << 8 * depth) - 1) * 256 + made).alias("key")
        nodes = level.select(F.col("key").alias("key2"), "p1", "stop")
        wanted = steps.select("code", "step", key)
        nodes = F.broadcast(nodes) if depth < 2 else nodes
        joined = wanted.join(nodes, F.col("key") == F.col("key2"), "left" if depth == 0 else "inner")
        met.append(joined.select("code", "step", F.struct(F.lit(-depth).alias("depth"), "p1", "stop").alias("node")))
    nodes = met[0]
    for more in met[1:]:
        nodes = nodes.unionByName(more)
    path = nodes.groupBy("code", "step").agg(F.sort_array(F.collect_list("node")).alias("path"))
    mixed = F.aggregate("path", F.lit(0.5), lambda p, x: F.coalesce(x["stop"] * x["p1"] + (1 - x["stop"]) * p, p))
    one = F.expr("shiftright(code & 255, 7 - step) & 1") == 1
    return path.groupBy("code").agg(F.sum(F.log10(F.when(one, mixed).otherwise(1 - mixed))).alias("value"))


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands among the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """Nodes by depth, and the n-grams of the training texts with their log10 probability in a hash table.

    ``whole`` says of each depth whether its nodes are all; what they leave open is not a number.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, ...]], whole: list[bool], codes: np.ndarray, counts: np.ndarray, logs=None):
        self.nodes, self.whole, self.codes, self.counts = nodes, whole, codes, counts
        self.logs = self.evaluate(codes) if logs is None else logs
        often = np.argsort(counts, kind="stable")  # of codes that share a slot, the most frequent is put last
        slots = self.slots(codes[often])
        self.table_codes = np.full(1 << TABLE_BITS, -1, dtype=np.int64)
        self.table_logs = np.zeros(1 << TABLE_BITS)
        self.table_codes[slots] = codes[often]
        self.table_logs[slots] = self.logs[often]

    def state(self) -> tuple:
        """What makes the same model elsewhere."""
        return self.nodes, self.whole, self.codes, self.counts, self.logs

    @staticmethod
    def slots(codes: np.ndarray) -> np.ndarray:
        spread = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def evaluate(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each code's byte in its context, not a number where a node may be missing."""
        total = np.zeros(len(codes))
        byte, context = codes & 255, codes >> 8
        for step in range(8):
            made = (1 << step) | (byte >> (8 - step))
            one = ((byte >> (7 - step)) & 1).astype(bool)
            p = np.full(len(codes), 0.5)
            deeper = np.zeros(len(codes), dtype=bool)  # not found one depth below, where nodes may be missing
            for depth in range(len(self.nodes) - 1, -1, -1):
                keys, p1, stop = self.nodes[depth]
                at, found = look_up(keys, (context & ((1 << 8 * depth) - 1)) * 256 + made)
                if found.any():
                    w = stop[at]
                    p = np.where(found, np.where(deeper, np.nan, w * p1[at] + (1 - w) * p), 0.5)
                elif len(p):
                    p = np.full(len(codes), 0.5)
                deeper = ~found & (not self.whole[depth])
            p = np.where(deeper, np.nan, p)
            total += np.log10(np.where(one, p, 1 - p))
        return total

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """log10 probability of each text without the codes that are left open, and these codes with their counts."""
        codes, starts = grams_of(texts, len(self.nodes) - 1)
        slots = self.slots(codes)
        logs = self.table_logs[slots]
        missed = np.flatnonzero(self.table_codes[slots] != codes)
        if len(missed):
            own, where = np.unique(codes[missed], return_inverse=True)
            at, found = look_up(self.codes, own)
            values = self.logs[at] if len(self.logs) else np.zeros(len(own))
            values[~found] = self.evaluate(own[~found])
            logs[missed] = values[where]
        open_ = np.isnan(logs)
        rest = [np.unique(c[o], return_counts=True) for c, o in zip(np.split(codes, starts[1:]), np.split(open_, starts[1:]))]
        return np.add.reduceat(np.where(open_, 0.0, logs), starts), rest


class HotWords(dict):
    """Counts of the most frequent words by word, -1 for the others; looked up by hash once per word."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.by_key = dict(zip(keys.tolist(), counts.tolist()))

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH_WORDS:
            self.clear()
        self[word] = n = self.by_key.get(key_of(word), -1)
        return n


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long"


def learn(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], Model, tuple[int, int], dict[str, np.ndarray]]:
    """Counts of words (key, n), the nodes by depth, the model, (tokens, distinct tokens) and the most frequent words."""
    counted = docs.filter("NOT held_out").select("text").mapInPandas(count, "kind int, key long, n long")
    counts = saved(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    grams = counts.filter(F.col("kind") == GRAM).select("key", "n")
    nodes = tree(grams)
    levels = [most_frequent(x, MAX_NODES) for x in nodes]
    often, _ = most_frequent(grams, MAX_NODES)
    model = Model([(x["key"], x["p1"], x["stop"]) for x, _ in levels], [all_ for _, all_ in levels], often["key"], often["n"])
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return words, nodes, model, (n, v), most_frequent(words.orderBy(F.desc("n"), "key").limit(HOT_WORDS), HOT_WORDS)[0]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, counts of tokens, base_score, score (both log10) and bits_per_byte."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (~in_training(doc_id)).alias("held_out"), filled(text).alias("text")
    )
    words, nodes, model, (n, v), hot = learn(rows)
    end = words.filter(F.col("key") == key_of(b"")).first()
    end_count = end["n"] if end else 0
    sent = rows.sparkSession.sparkContext.broadcast((model.state(), hot["key"], hot["n"]))
    below = math.log10(n + v + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, keys, counts = sent.value
        model = Model(*state)
        hot_words = HotWords(keys, counts)
        row = TaskContext.get().partitionId() << 33
        for part in chunks(frames):
            texts = [t.encode("utf-8", "replace") for t in part["text"]]
            scored, rest, grams = [], [], []
            for doc, held, t, value, (codes, times) in zip(part["doc_id"], part["held_out"], texts, *model.score(texts)):
                words = words_of(t)
                found = np.array([hot_words[w] for w in words], dtype=np.int64)
                known = found[found >= 0]
                base = float(np.log10(known + 1.0).sum()) + math.log10(end_count + 1) - (len(known) + 1) * below
                n_known = len(known) + (end_count > 0)
                doc = None if pd.isna(doc) else int(doc)
                scored.append((row, doc, bool(held), len(words) + 1, n_known, base, float(value), len(t)))
                if len(known) < len(words):
                    others = Counter(w for w, c in zip(words, found) if c < 0)
                    rest.extend((row, key_of(w), k) for w, k in others.items())
                if len(codes):
                    grams.append(pd.DataFrame({"row": row, "code": codes, "k": times}))
                row += 1
            names = [x.split()[0] for x in SCORED.split(", ")]
            left = pd.DataFrame(rest, columns=["row", "key", "k"]).astype("Int64")  # hashes would not survive as floats
            out = pd.concat([pd.DataFrame(scored, columns=names), left, *(g.astype("Int64") for g in grams)])
            out = out.reindex(columns=[*names, "key", "k", "code"])
            ints = ("row", "doc_id", "n_tokens", "n_known", "bytes", "key", "k", "code")
            yield out.astype({c: "Int64" for c in ints} | {"held_out": "boolean"})

    both = saved(rows.mapInPandas(run, f"{SCORED}, key long, k long, code long"), "lm-scored")
    scored = both.filter("key IS NULL AND code IS NULL").drop("key", "k", "code")
    if not all(model.whole):
        grams = both.filter("code IS NOT NULL").select(F.col("row").alias("row3"), F.col("code").alias("code3"), "k")
        values = evaluated(grams.select(F.col("code3").alias("code")).distinct(), nodes)
        grams = grams.join(values, F.col("code3") == F.col("code")).groupBy("row3").agg(F.sum(F.col("k") * F.col("value")).alias("score3"))
        scored = scored.join(grams, F.col("row") == F.col("row3"), "left")
        scored = scored.withColumn("score", F.col("score") + F.coalesce("score3", F.lit(0.0))).drop("row3", "score3")
    rest = both.filter("key IS NOT NULL").select(F.col("row").alias("row2"), F.col("key").alias("key2"), "k")
    rest = rest.join(words, F.col("key") == F.col("key2"), "left")
    each = F.log10(F.coalesce("n", F.lit(0)) + 1.0) - F.lit(below)
    rest = rest.groupBy("row2").agg(
        F.sum(F.col("k") * each).alias("base2"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known2"),
    )
    return scored.join(rest, F.col("row") == F.col("row2"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
