import hashlib
import zlib
from collections import defaultdict

import pytest
from cases import doc, documents, none, plain
from pyspark.sql import functions as F

from shiftledger.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """The root and each node's steps upwards."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 3 * 3 : place // 3 * 3 + 3]
            steps[k].append(("".join(run[: place % 3]), "".join(run[place % 3 + 1 :])))
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], steps


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        by[r["source"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, text)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots = {}
    ways = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroots[s], ways[s] = tree([x[1] for x in by[s]])
    root, over = tree([subroots[s] for s in sources])
    found = []
    for k, s in enumerate(sources):
        for (doc_id, own, other), way in zip(by[s], ways[s]):
            at, steps = other, way + over[k]
            for left, right in steps:
                at = h(left, at, right)
            found.append((doc_id, own, subroots[s], root, h(*[x + y for x, y in steps]), at, at == root))
    return sorted(found, key=str)


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest(docs):
    return sorted((tuple(r[c] for c in COLS) for r in merkle.verify(merkle.manifest(docs)).collect()), key=str)


@pytest.mark.parametrize("digits", [6, 2])
def test_manifest_equals_the_plain_one(spark, monkeypatch, digits):
    """With two digits the trees take several rounds of blocks."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    docs = documents(spark)
    more = [doc(1000 + 3 * k, f"{plain(k, 3)}\n{k}", source="a" if k % 2 else f"s{k % 24}") for k in range(180)]
    more += [doc(77, "x\ny", source="one")] * 4
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    found = manifest(docs)
    assert found == expected(docs.collect())
    assert {x[-1] for x in found} == {True, False}
    assert manifest(docs.repartition(7)) == found


def test_empty_table_one_row_and_group_names(spark):
    assert merkle.verify(merkle.manifest(none(spark))).count() == 0
    for source in (None, "", "é"):
        docs = spark.createDataFrame([doc(5, "a\nb", source=source)], none(spark).schema)
        assert manifest(docs) == expected(docs.collect())


def test_levels_are_grouped_without_a_shuffle(spark):
    nodes = spark.range(5000).select(
        (F.col("id") % 2).alias("grp"), (F.col("id") * 0 + 2500).alias("n"), F.floor(F.col("id") / 2).alias("rank"), F.struct(F.sha2(F.col("id").cast("string"), 256).alias("hash")).alias("node")
    )
    plan = merkle.blocks(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
