"""The pipeline against a plain Python version of its stages."""

import random
import re
from collections import defaultdict

from cases import doc, documents, plain
from test_jaccard import joined, shingle_set
from test_mixing import mixed
from test_pii import base
from test_quality_rules import rules

import __spark_entry__ as entry
import corpus_pipeline

WORD = r"[^\x20\x09-\x0D]+"
TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def normal(line):
    return re.sub("[0-9]+", "0", " ".join(re.findall(WORD, line)).lower())


def after_quality(rows):
    lines = {k: [normal(x) for x in (r["text"] or "").split("\n") if re.search(WORD, x)] for k, r in enumerate(rows)}
    docs, ids = defaultdict(set), defaultdict(list)
    for k, own in lines.items():
        for line in own:
            for host in (rows[k]["source"], ...):
                docs[host, line].add(tuple(own))
                ids[host, line] += [rows[k]["doc_id"]] if rows[k]["doc_id"] is not None else []

    def often(host, line, least, share):
        return len(docs[host, line]) > max(least, share // len(line.split(" ")))

    kept = []
    for k, r in enumerate(rows):
        if rules(r["text"])[-1]:
            continue
        gone, first = [], 0
        for x in r["text"].split("\n"):
            if not re.search(WORD, x):
                continue
            everywhere = often(..., normal(x), 20, 500)
            if everywhere or often(r["source"], normal(x), 3, 25):
                gone.append(x)
                if r["doc_id"] == min(ids[... if everywhere else r["source"], normal(x)], default=...):
                    first += len(re.findall(WORD, x))
        n, left = rules(r["text"])[0], rules(r["text"])[0] - sum(len(re.findall(WORD, x)) for x in gone)
        if gone and (left < 20 or 5 * left < n):
            if left + first < 20 or 5 * (left + first) < n:
                continue
            gone = []
        text = "\n".join(x for x in r["text"].split("\n") if x not in gone)
        kept.append({**r, "text": text, "n_chars": len(text) if gone else r["n_chars"]})
    return kept


def after_join(rows):
    low = {}
    ids = [(r["doc_id"], r["text"]) for r in rows]
    for doc_id, _, component in joined(ids, 5, 80):
        low.setdefault(component, doc_id)
    keep = set(low)
    return [r for r in rows if (r["doc_id"] or -1) in keep or not shingle_set(r["text"], 5)]


def after_decontamination(rows, items):
    return [r for r in rows if not any(" ".join(t.split()) in " ".join((r["text"] or "").split()) for _, t in items)]


def after_pii(rows):
    found = []
    for r in rows:
        text, at, out = r["text"], 0, ""
        for s, _, e, kind in base(text):
            if s >= at:
                out += text[at:s] + TAGS[kind]
            at = max(at, e)
        out += text[at:]
        found.append({**r, "text": out, "n_chars": len(out) if out != text else r["n_chars"]})
    return found


def test_run_equals_the_plain_version(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, f"{plain(k, 18, 7)}. {plain(k, 9, 8)}.") for k in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [r for r in documents(spark).collect() if r["doc_id"] is not None and r["doc_id"] not in (7, 8)]
    rows = [tuple(r) for r in rows]
    for k in range(90):
        text = plain(k, 60 + k)
        if k % 2:
            text = f"the banner of this house\n{text}"
        if k % 7 == 0:
            text += f" a{k}@mail.example.org +1 (555) 123-45{k:02d} 10.1.2.{k}"
        if k % 11 == 0:
            text += f"\n{items[k % 5][1]} {plain(k, 9, 3)}"
        rows.append(doc(100 + k, text, source=f"s{k % 2}"))
        if k % 5 == 0:
            words = text.split(" ")
            words[rng.randrange(10, 40)] = "changed"
            rows += [doc(300 + k, text, source=f"s{k % 3}"), doc(500 + k, " ".join(words), source=f"s{k % 2}")]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain_rows = [r.asDict() for r in docs.collect()]
    steps = [after_quality, after_join, lambda x: after_decontamination(x, items), after_pii]
    for k, step in enumerate(steps):
        before = len(plain_rows)
        plain_rows = step(plain_rows)
        assert k == 3 or len(plain_rows) < before, "each stage that filters has something to do"
    found = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    takes = mixed(plain_rows)
    assert sorted((r["size"], r["source_size"], r["target"], r["taken"]) for r in found) == [x for x in takes if x[3]]
    by_id = {r["doc_id"]: r for r in plain_rows}
    for r in found:
        assert all(r[c] == by_id[r["doc_id"]][c] for c in ("text", "lang", "source", "n_chars")), r["doc_id"]
    assert len({r["doc_id"] for r in found}) == len(found)


def test_stages_and_registration():
    assert [f.__module__.rpartition(".")[2] for _, f in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontam", "pii", "mixing"]
    names = [x for x in entry.queries() if re.match(r"op\d+_|pipeline", x)]
    assert sorted(names, key=lambda x: int(re.sub(r"\D", "", x) or 99)) == [
        "op1_pii", "op2_html_extraction", "op3_url_filters", "op4_ngram_jaccard", "op5_language_id", "op6_decontamination",
        "op7_quality_rules", "op8_mixing", "op9_warc", "op10_lm_scoring", "op11_hard_negatives", "op12_merkle_manifest",
        "op13_substring_dedup", "pipeline",
    ]
