import math
import random
from collections import Counter

import pytest
from cases import LONG, doc, documents, none, plain

from shiftledger.llm import decontam

ITEMS = [(k, f"{plain(k, 20, 7)}. what is it that {plain(k, 12, 8)}? {plain(k, 3, 9)}.") for k in range(40)]


def bm25(items, passage, threshold):
    """All items whose BM25 score for the passage is at least the threshold's share of their own."""
    bags = [Counter(decontam.words_of(t)) for _, t in items]
    mean = sum(map(Counter.total, bags)) / len(bags)
    df = Counter(w for b in bags for w in b)

    def weight(b, w):
        tf, idf = b[w], math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
        return idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * b.total() / mean))

    return {
        k for k, b in enumerate(bags)
        if sum(weight(b, w) for w in b if w in passage) >= (threshold - 1e-9) * sum(weight(b, w) for w in b)
    }


def test_block_max_wand_finds_what_full_scoring_finds():
    rng = random.Random(1)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, weights=range(60, 0, -1), k=rng.randrange(1, 30)))) for k in range(150)]
    for threshold in (0.3, 0.5, 0.8):
        index = decontam.Index(items, 64, threshold)
        for _ in range(60):
            words = [w.encode() for w in rng.choices(vocabulary, k=rng.randrange(1, 128))]
            found = index.search(set(words))
            assert {k for k, _ in found} == bm25(items, set(words), threshold)
            if found:  # the first look lets every such passage through
                assert (0, 0) in index.passages([words])


def test_first_look_knows_all_passages_of_a_batch():
    index = decontam.Index(ITEMS, 64)
    rng = random.Random(2)
    texts = []
    for k in range(30):
        words = plain(k, rng.randrange(0, 900)).split()
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = ITEMS[rng.randrange(40)][1].split()
        texts.append([w for x in words for w in decontam.words_of(x)])
    expected = {
        (k, p)
        for k, words in enumerate(texts)
        for p in range(-(-len(words) // 64))
        if index.search(set(words[64 * p : 64 * p + 128]))
    }
    assert expected and expected <= set(index.passages(texts))


def items_of(spark, items=ITEMS):
    return spark.createDataFrame(list(items), "item_id long, text string")


def test_hits(spark):
    first, second = ITEMS[3][1], ITEMS[4][1]
    question, answer = second.split("? ")
    docs = documents(spark)
    rows = [
        doc(100, f"{plain(1)} {first} {plain(2)}"),
        doc(101, first.upper().replace(" ", "\n  ")),
        doc(102, f"{LONG} {first} {second} {LONG}"),
        doc(103, question + f"? {plain(3, 40)}"),  # without its answer
        doc(104, f"{plain(4, 30)} {answer}"),
        doc(105, " ".join(w for k, w in enumerate(first.split()) if k != 9)),  # a word left out
        doc(106, " ".join(sorted(first.split()))),  # the same words in another order
    ]
    found = decontam.contaminated(docs.union(spark.createDataFrame(rows, docs.schema)), items_of(spark)).collect()
    hits = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in found if r["hits"]}
    assert hits == {100: [3], 101: [3], 102: [3, 4], 103: [4], 105: [3]}
    assert len(found) == docs.count() + 7


def test_many_indexes_find_the_same(spark, monkeypatch):
    items = [*ITEMS, (90, plain(90, 200, 7)), (91, None), (92, ""), (93, "lone"), (None, plain(94, 30, 7)), ITEMS[0]]
    docs = documents(spark)
    rows = [doc(100 + k, f"{plain(k)} {t} {plain(k + 1)}") for k, (_, t) in enumerate(items)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema))

    def found():
        rows = decontam.contaminated(docs, items_of(spark, items)).collect()
        scores.append({(r["doc_id"], h["item_id"]): h["score"] for r in rows for h in r["hits"]})
        return sorted((r["doc_id"], sorted(str(h["item_id"]) for h in r["hits"])) for r in rows if r["doc_id"] is not None)

    scores = []
    one = found()
    assert ("90" in dict(one)[140]) and dict(one)[100] == ["0", "0"] and dict(one)[144] == ["None"]
    monkeypatch.setattr(decontam, "MAX_WORDS", 200)
    assert found() == one
    assert scores[1] == pytest.approx(scores[0]) and len(scores[0]) > 40  # statistics are of all items, not of a block


def test_stage_and_empty_tables(spark, tmp_path):
    docs = documents(spark)
    items_of(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = spark.createDataFrame([doc(100, ITEMS[5][1])], docs.schema)
    kept = decontam.stage(spark, docs.union(leak), str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontam.contaminated(none(spark), items_of(spark)).count() == 0
    assert decontam.contaminated(docs, items_of(spark, [])).filter("size(hits) > 0").count() == 0


@pytest.mark.parametrize("text,parts", [("a b. c d", (2, 2)), ("only one", (2, 0)), ("q one? \n a", (2, 1)), ("...", (0, 0))])
def test_question_and_answer(text, parts):
    assert tuple(map(len, decontam.question_and_answer(text))) == parts
