"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of all labelled texts by language; a task adds up its own texts and
hands on one count per language and bucket. The matrix of log probabilities (languages x ``BUCKETS``) is
broadcast; its size is bounded by ``MAX_LANGUAGES``. Texts are scored in batches, each as the sparse counts of
its own buckets times the matrix.

Defined cases: a null text and one without a letter is ``und`` with score 0. A null language isn't learned from.
Without any labelled text every prediction is ``und``. A tie goes to the language that sorts first. A null id is
of the training part, as its text is empty. Input columns with the name of a result column are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 2000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# Odd multipliers that spread n-grams over the buckets.
MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def buckets(text: str) -> np.ndarray:
    """The bucket of every character n-gram, in lower case with a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    found = []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, dtype=np.uint32)
        for k in range(order):
            h = (h ^ codes[k : k + n]) * MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def count_ngrams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a task: at most languages x buckets rows."""
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            total = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            total += np.bincount(buckets(text), minlength=BUCKETS)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the float32 matrix (buckets x languages) of log probabilities."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInPandas(count_ngrams, "lang string, bucket int, n long")
    totals = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))
    langs, columns = [], []
    for row in by_lang.orderBy("lang").toLocalIterator():  # a row per language, at most BUCKETS counts each
        if len(langs) == MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        counts = np.zeros(BUCKETS)
        for bucket, n in row["counts"]:
            counts[bucket] = n
        langs.append(row["lang"])
        columns.append(np.log((counts + SMOOTHING) / (counts.sum() + SMOOTHING * BUCKETS)).astype(np.float32))
    return langs, np.stack(columns, axis=1) if columns else np.zeros((BUCKETS, 0), dtype=np.float32)


def score(text: str | None, langs: list[str], matrix: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not LETTER.search(text):
        return UNKNOWN, 0.0
    used, n = np.unique(buckets(text), return_counts=True)
    logs = n.astype(np.float64) @ matrix[used].astype(np.float64)
    best = int(np.argmax(logs))
    return langs[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the posterior probability of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        langs, matrix = sent.value
        return pd.DataFrame([score(t, langs, matrix) for t in texts], columns=["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("__p", predicted(F.col(text))).select(*own, "__p.lang_pred", "__p.score")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out, predict all."""
    model = train(docs.filter(~held_out(doc_id)), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).drop("text")
