"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

Documents are cut into passages of ``2 x span`` words that overlap by half, so that an item of at most ``span``
words that occurs in a document lies whole in a passage. The index holds, for each word, the items it occurs in
with its share of the item's own BM25 score, and the greatest share in each block of ``BLOCK`` items. A passage
retrieves all items of which it reaches ``THRESHOLD`` of the score:

- a first look adds up shares of an item's essential words only: its rarest, leaving out words that together have
  less than half of the threshold; passages that reach no item's threshold less that rest can't retrieve any;
- block-max WAND for the others: items are visited in order, the pivot is found by the words' greatest shares, and
  blocks whose own greatest shares don't reach the threshold are skipped.

An item retrieved is confirmed by the share of its word trigrams found in the passage, for the question (all but
the last sentence) and the answer (the last one) each. The number of items, their mean length and the number of
items each word is in are counted over all items. The index is built from blocks of at most ``MAX_WORDS`` words of
items, each block a broadcast of bounded size and a column of its own; a score is the same in whatever block.

Defined cases: very long texts are searched whole, in chunks of words; items of equal score (a tie) are all found; null and empty texts and items have no passages and match nothing; an item of one sentence is all
question. Repeated rows get equal results each. Without items nothing is contaminated. Input columns with the name
of a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import saved

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK = 16
CHUNK_WORDS = 200_000
MAX_WORDS = 1_000_000
SPANS = (64, 256, 1024, 4096, 16384)
N = 3
MIN_PART = 0.6
MIN_WHOLE = 0.8
# Words are what stands between ASCII characters that are no letters or digits, as UTF-8 in lower case.
APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SENTENCE = re.compile(r"[.!?]+(?=\s)|\n+")
HITS = "array<struct<item_id: long, score: double, question: double, answer: double, passage: int>>"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(APART).split()


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    n = min(N, len(words))
    return set(zip(*[words[k:] for k in range(n)])) if n else set()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for w in (words_of(s) for s in SENTENCE.split(text)) if w]
    return [w for p in (parts[:-1] or parts) for w in p], parts[-1] if len(parts) > 1 else []


# The number of items, their mean length and, by word, the number of items it is in.
Statistics = tuple[int, float, dict[bytes, int]]


class Index:
    """Items (id, text) of at most ``span`` words each; ``statistics`` of all items, of these alone if not given."""

    def __init__(
        self, items: list[tuple[int, str]], span: int, threshold: float = THRESHOLD, statistics: Statistics | None = None
    ):
        self.ids = [i for i, _ in items]
        self.span, self.threshold = span, threshold
        self.parts = [question_and_answer(text) for _, text in items]
        counts = [Counter(words_of(text)) for _, text in items]
        lengths = [sum(c.values()) for c in counts]
        n, mean, df = statistics or (len(items), sum(lengths) / max(1, len(items)), Counter(w for c in counts for w in c))
        self.postings: dict[bytes, tuple[list[int], list[float], dict[int, float], float]] = {}
        essential: dict[bytes, list[tuple[int, float]]] = {}
        self.rest = np.zeros(len(items))
        for item, (count, length) in enumerate(zip(counts, lengths)):
            shares = {
                w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                for w, tf in count.items()
            }
            total = sum(shares.values())
            rest = 0.0
            for w, x in sorted(shares.items(), key=lambda kv: (-df[kv[0]], kv[0])):
                share = x / total
                at, values, blocks, _ = self.postings.setdefault(w, ([], [], {}, 0.0))
                at.append(item)
                values.append(share)
                blocks[item // BLOCK] = max(blocks.get(item // BLOCK, 0.0), share)
                if rest + share < threshold / 2:
                    rest += share
                else:
                    essential.setdefault(w, []).append((item, share))
            self.rest[item] = rest
        self.postings = {w: (at, v, blocks, max(v)) for w, (at, v, blocks, _) in self.postings.items()}
        self.essential = {w: k for k, w in enumerate(essential)}
        self.starts = np.cumsum([0, *map(len, essential.values())])
        flat = [x for rows in essential.values() for x in rows]
        self.items = np.array([i for i, _ in flat], dtype=np.int64)
        self.shares = np.array([s for _, s in flat])

    def passages(self, texts: list[list[bytes]]) -> list[tuple[int, int]]:
        """(text, passage) of the passages that may reach some item's threshold, by their essential words."""
        get = self.essential.get
        terms = np.array([get(w, -1) for words in texts for w in words], dtype=np.int64)
        lengths = np.array([len(words) for words in texts], dtype=np.int64)
        halves = -(-lengths // self.span)
        first_half = np.cumsum(halves) - halves
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return []
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, at, side="right")
        half = first_half[owner] + (at - (ends - lengths)[owner]) // self.span
        n = len(self.essential)
        # A word stands in the passage that starts in its half and, but for a text's first half, in the one before.
        before = np.maximum(half - 1, first_half[owner])
        keys = np.unique(np.concatenate((half, before)) * n + np.tile(terms[at], 2))
        passage, term = keys // n, keys % n
        size = self.starts[term + 1] - self.starts[term]
        flat = np.repeat(self.starts[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found = np.repeat(passage, size) * len(self.ids) + self.items[flat]
        order = np.argsort(found, kind="stable")
        found = found[order]
        starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        sums = np.add.reduceat(self.shares[flat][order], starts)
        found = found[starts]
        found = np.unique(found[sums + self.rest[found % len(self.ids)] >= self.threshold - 1e-9] // len(self.ids))
        owner = np.searchsorted(first_half + halves, found, side="right")
        return list(zip(owner.tolist(), (found - first_half[owner]).tolist()))

    def search(self, words: set[bytes]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose shares among ``words`` add up to the threshold."""
        end = len(self.ids)
        lists = [[self.postings[w], 0] for w in sorted(words) if w in self.postings]
        least = self.threshold - 1e-9
        found = []

        def item_of(entry) -> int:
            (at, *_), k = entry
            return at[k] if k < len(at) else end

        def advance(entry, item: int) -> None:
            at, k = entry[0][0], entry[1]
            while k < len(at) and at[k] < item:
                k += 1
            entry[1] = k

        while True:
            lists.sort(key=item_of)
            bound, pivot = 0.0, None
            for k, entry in enumerate(lists):
                if item_of(entry) == end:
                    break
                bound += entry[0][3]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = item_of(lists[pivot])
            while pivot + 1 < len(lists) and item_of(lists[pivot + 1]) == item:
                pivot += 1
            block = item // BLOCK
            if sum(entry[0][2].get(block, 0.0) for entry in lists[: pivot + 1]) < least:
                # No item of this block up to the next list's item can reach the threshold.
                behind = item_of(lists[pivot + 1]) if pivot + 1 < len(lists) else end
                target = max(item + 1, min((block + 1) * BLOCK, behind))
            else:
                if item_of(lists[0]) == item:
                    score = sum(entry[0][1][entry[1]] for entry in lists[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    target = item + 1
                else:
                    target = item
            for entry in lists[: pivot + 1]:
                advance(entry, target)

    def hits(self, texts: list[str | None]) -> list[list[dict]]:
        """The items found in each text, each with its best passage."""
        found: list[dict[int, dict]] = [{} for _ in texts]
        start = 0
        while start < len(texts):
            words, held, end = [], 0, start
            while end < len(texts) and held < CHUNK_WORDS:
                words.append(words_of(texts[end] or ""))
                held += len(words[-1])
                end += 1
            for k, p in self.passages(words):
                self.confirm(words[k][p * self.span : (p + 2) * self.span], p, found[start + k])
            start = end
        return [[best[k] for k in sorted(best)] for best in found]

    def confirm(self, own: list[bytes], p: int, best: dict[int, dict]) -> None:
        there = [set(zip(*[own[k:] for k in range(n)])) for n in range(1, N + 1)]
        for item, score in self.search(set(own)):
            question, answer = (overlap(part, there) for part in self.parts[item])
            whole = overlap([*self.parts[item][0], *self.parts[item][1]], there)
            if (question >= MIN_PART and answer >= MIN_PART) or whole >= MIN_WHOLE:
                if item not in best or score > best[item]["score"]:
                    row = {"item_id": self.ids[item], "score": score, "question": question, "answer": answer}
                    best[item] = row | {"passage": p}


def overlap(part: list[bytes], there: list[set[tuple[bytes, ...]]]) -> float:
    """The share of the part's word n-grams (trigrams, or the whole of a shorter part) that are there; 1 for none."""
    own = grams(part)
    return sum(g in there[len(g) - 1] for g in own) / len(own) if own else 1.0


def count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By word the items it is in; without a word the number of items that have words, and of their words."""
    for frame in frames:
        df: Counter = Counter()
        items = words = 0
        for text in frame["t"]:
            own = words_of(text)
            df.update(set(own))
            items, words = items + bool(own), words + len(own)
        rows = [(None, items, words), *((w, n, 0) for w, n in df.items())]
        yield pd.DataFrame(rows, columns=["word", "items", "words"])


def indexes(items: DataFrame, item_id: str, text: str, threshold: float) -> Iterator[Index]:
    """Indexes over all items, each of one span and of at most ``MAX_WORDS`` words or one item."""
    rows = items.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    counted = rows.select("t").mapInPandas(count_words, "word binary, items long, words long")
    counted = saved(counted.groupBy("word").agg(F.sum("items").alias("items"), F.sum("words").alias("words")), "item-words")
    whole = counted.filter("word IS NULL").first()

    def build(block: list[tuple[int, str]], span: int) -> Index:
        own = pd.DataFrame({"own": sorted({w for _, t in block for w in words_of(t)})})
        own = items.sparkSession.createDataFrame(own, "own binary")
        df = {bytes(r["word"]): r["items"] for r in counted.join(own, F.col("word") == F.col("own")).collect()}
        return Index(block, span, threshold, (whole["items"], whole["words"] / whole["items"], df))

    held: dict[int, list] = {}
    words: Counter = Counter()
    for row in rows.orderBy("i", "t").toLocalIterator():
        n = len(words_of(row["t"]))
        if not n:
            continue
        span = next((s for s in SPANS if n <= s), n)
        if words[span] + n > MAX_WORDS and words[span]:
            yield build(held.pop(span), span)
            words[span] = 0
        held.setdefault(span, []).append((row["i"], row["t"]))
        words[span] += n
    for span in sorted(held):
        yield build(held[span], span)


def searcher(sent: Broadcast):
    """A UDF over texts; what is sent is the index's state, as the executors have no copy of the class."""

    def look(texts: pd.Series) -> pd.Series:
        index = Index.__new__(Index)
        index.__dict__.update(sent.value)
        return pd.Series(index.hits(list(texts)), dtype=object)

    return F.pandas_udf(look, HITS)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with the ``hits`` of each text: item, score, overlaps of question and answer, best passage."""
    found = []
    for index in indexes(items, item_id, item_text, threshold):
        found.append(searcher(docs.sparkSession.sparkContext.broadcast(vars(index)))(F.col(text)))
    none = F.array().cast(HITS)
    hits = F.concat(*found) if len(found) > 1 else found[0] if found else none
    return docs.withColumn("hits", hits)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items).filter(F.size("hits") == 0).select(docs.columns)
