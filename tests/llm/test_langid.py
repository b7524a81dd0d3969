import math
from collections import Counter
from pathlib import Path
from zlib import crc32

import pytest
from cases import LONG, doc, documents, none

from shiftledger.llm import langid
from shiftledger.llm.common import table

SF = "/root/testdata/sf0.01"


def test_scores_equal_plain_naive_bayes(spark):
    docs = documents(spark)
    texts = {"fr": "le chat est sur la table et", "de": "der hund ist unter dem tisch und", "en": "the cat is on the table and"}
    rows = [doc(100 + k, f"{t} {k} " * 3, lang) for k, (lang, t) in enumerate(list(texts.items()) * 9)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))
    counts, rows = {}, docs.collect()
    for r in rows:
        held = crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2
        if not held and r["text"] is not None and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(langid.buckets(r["text"]).tolist())
    expected = []
    for r in rows:
        text = r["text"]
        held = crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2
        if not text or not any(c.isalpha() for c in text):
            expected.append((str(r["doc_id"]), held, "und", 0.0))
            continue
        own = Counter(langid.buckets(text).tolist())
        logs = {
            lang: sum(n * math.log((c[b] + langid.SMOOTHING) / (c.total() + langid.SMOOTHING * langid.BUCKETS)) for b, n in own.items())
            for lang, c in sorted(counts.items())
        }
        best = max(logs, key=logs.get)
        expected.append((str(r["doc_id"]), held, best, round(1 / sum(math.exp(x - logs[best]) for x in logs.values()), 3)))
    found = [(str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 3)) for r in langid.identify(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert {"fr", "de", "en"} <= {x[2] for x in found} and len(langid.buckets(LONG)) > 3 * len(LONG)


def test_without_labels_or_rows(spark):
    assert langid.identify(none(spark)).count() == 0
    unlabelled = spark.createDataFrame([doc(1, "some text", None)], documents(spark).schema)
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held)
