import hashlib
import re
from collections import defaultdict
from fractions import Fraction

from cases import doc, documents, none, plain

from shiftledger.llm import mixing


def water_level(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess over the caps until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, left = {}, Fraction(sum(sizes.values()))
    while True:
        rest = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] >= most * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = Fraction(most * sizes[s])
            left -= capped[s]
        if len(capped) == len(order):
            return capped


def mixed(rows):
    """Takes by sorting each source by hash."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    h = [int(hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}|{r['text'] or ''}".encode()).hexdigest()[:9], 16) for r in rows]
    total, by_hash = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r, n, x in zip(rows, size, h):
        total[r["source"]] += n
        by_hash[r["source"]][x] += n
    targets, found = water_level(dict(total)), []
    below = {}
    for s in total:
        rounds = targets[s] // total[s] if total[s] else 0
        budget, used, limit = targets[s] - rounds * total[s], 0, 0
        for x in sorted(by_hash[s]):
            n = by_hash[s][x]
            if used + n > budget and used + n - budget >= budget - used:
                break
            limit, used = x + 1, used + n
            if used > budget:
                break
        below[s] = (rounds, limit)
    for r, n, x in zip(rows, size, h):
        rounds, limit = below[r["source"]]
        found.append((n, total[r["source"]], float(targets[r["source"]]), n * (rounds + (x < limit))))
    return sorted(found)


def test_mix_equals_the_plain_one(spark):
    docs = documents(spark)
    more = [doc(1000 + k, plain(k, 5 + k % 40), source=f"s{k % 7}") for k in range(300)]
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    found = mixing.mix(docs)
    rows = found.collect()
    assert sorted((r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == mixed(docs.collect())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert [c for c in docs.columns if c != "size"] == found.columns[: len(docs.columns) - 1]
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))


def test_targets_near(spark):
    rows = [doc(k, plain(k, 20 + k % 30), source=f"s{k % 5}") for k in range(2000)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    taken = defaultdict(int)
    target = {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 50 for s in target)


def test_empty_table_and_stage(spark):
    assert mixing.mix(none(spark)).count() == 0
    kept = mixing.stage(spark, documents(spark), "").collect()
    assert kept and all(r["taken"] > 0 for r in kept)
