import hashlib
import random
import re
import time

from cases import LONG, doc, documents, none, plain

from shiftledger.llm import pii

# The patterns of the contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

TEXTS = [
    "a@b.c_x@d.e a@b@c.d a@b..c @x.y q@-.-", "x@y.z" * 30, "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.01 1.2.3", "999999999.1.1.1",
    "4111111111111111 4111 1111-1111 1111 4111-1111-1111-1112 41111111111111110000 4  111 79927398713 00000000000000",
    "+1 (988) 555-2485x +12 +123456789 + 1 +1234567890123456 +49.(0)30-1234567-", "\U0001f600 é a@b.de \U0001f600 10.1.2.3 \n+1-555-000-1111",
    "1" * 5000, "1 " * 5000, "a" * 5000 + "@b.c", "+1" + " " * 3000 + "2", "a@b" + ".c" * 4000, "4111111111111111@x.com", "+4111111111111111", None, "",
]


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    spans = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def test_base_equals_the_plain_patterns(spark):
    docs = documents(spark)
    docs = docs.union(spark.createDataFrame([doc(100 + k, t) for k, t in enumerate(TEXTS)], docs.schema))
    rows = pii.sanitise(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        spans = base(row["text"])
        assert row["spans"] == joined(spans), row["text"][:80]
        assert row["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(x[3] == k for x in spans) for k in PATTERNS]
        assert row["n_term"] == 0 and (row["text"] is None) == (row["sanitised"] is None)
        if not spans:
            assert row["sanitised"] == row["text"]
    clean = {r["doc_id"]: r["sanitised"] for r in rows}
    assert clean[12] == "mail me: [EMAIL] or [PHONE], ip [IP], card [CARD] \U0001f600 [EMAIL]"
    assert clean[7] == LONG and clean[100 + 6] == "\U0001f600 é [EMAIL] \U0001f600 [IP] \n[PHONE]"


def test_terms_that_disclose_an_entity(spark):
    mail = "boss@corp.example.com"
    near = [f"{plain(k, 20)} the zebrafish engineer {plain(50 + k, 3)} {mail} and {plain(80 + k, 20)}" for k in range(5)]
    far = [f"{plain(100 + k, 40)} the engineer and {plain(200 + k, 10)}" for k in range(60)]
    rows = [doc(k, t) for k, t in enumerate([*near, *far, f"a zebrafish! Zebrafish zebrafishes {plain(300, 30)}"])]
    rows += [doc(500 + k, f"{plain(900, 9)} copyword {plain(901, 2)} other@corp.example.com") for k in range(9)]
    found = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, documents(spark).schema)).collect()}
    last = found[65]
    assert last["spans"] == "term:2:11,term:13:22" and last["n_term"] == 2 and last["sanitised"].startswith("a !  zebrafishes")
    assert "zebrafish" not in found[0]["sanitised"] and "engineer" in found[0]["sanitised"] and "[EMAIL]" in found[0]["sanitised"]
    assert found[0]["n_email"] == 1 and found[0]["spans"].split(",")[1].startswith("email:")
    assert found[10]["n_term"] == 0  # common terms stay
    assert found[500]["n_term"] == 0  # one context, however often it is copied, proves nothing


def test_names_of_any_length_go(spark):
    names = {"Kim": 0, "Zbyszek": 1, "Li": 2}
    rows = [
        doc(10 * k + i, f"{plain(100 * k + i, 30)} write to {name} at {name[0]}x@corp{k}.example.com, {plain(500 + 100 * k + i, 30)}")
        for name, k in names.items() for i in range(5)
    ]
    rows += [doc(100 + k, f"{plain(2000 + k, 20)} write to me at home {plain(3000 + k, 20)}") for k in range(90)]
    found = pii.sanitise(spark.createDataFrame(rows, documents(spark).schema)).filter("n_email > 0").collect()
    for r in found:
        name = list(names)[r["doc_id"] // 10]
        assert r["n_term"] == 1 and "write to  at [EMAIL], " in r["sanitised"] and name not in r["sanitised"]
    assert len(found) == 15


def overlapping(spans):
    """Runs of spans and the terms that overlap nothing, one after the other."""
    fixed = [x for x in spans if x[1] < 4]
    kept = [x for x in spans if x[1] < 4 or not any(b[0] < x[2] and x[0] < b[2] for b in fixed)]
    runs = []
    for s, k, e in kept:
        if runs and runs[-1][2] > s:
            runs[-1][2] = max(runs[-1][2], e)
        else:
            runs.append([s, k, e])
    return kept, [tuple(x) for x in runs]


def test_runs_of_spans_equal_the_plain_ones(spark):
    rng = random.Random(5)
    rows = [()]
    for n in [1, 2, 3, 4, 5, 10, 17, 100, 400] * 4:
        starts = [rng.randrange(8 * n) for _ in range(n)]
        rows.append(tuple(sorted({(s, rng.randrange(5), s + rng.randrange(1, 9)) for s in starts})))
    df = spark.createDataFrame([(list(x),) for x in rows], "x array<struct<s: int, k: int, e: int>>")
    for r in df.withColumn("kept", pii.apart("x")).withColumn("runs", pii.merged("kept")).collect():
        assert ([tuple(x) for x in r["kept"]], [tuple(x) for x in r["runs"]]) == overlapping([tuple(x) for x in r["x"]])


def test_text_of_many_spans(spark):
    n = 16_000
    text = " ".join(f"m{k}@x.org" for k in range(n))
    start = time.monotonic()
    row = pii.sanitise(spark.createDataFrame([doc(1, text)], documents(spark).schema)).first()
    assert row["n_email"] == n and row["sanitised"] == " ".join(["[EMAIL]"] * n)
    assert time.monotonic() - start < 60


def test_stage_and_empty_table(spark):
    docs = documents(spark)
    kept = pii.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == docs.count()
    row = kept.filter("doc_id = 12").first()
    assert "@" not in row["text"] and row["n_chars"] == len(row["text"])
    assert pii.sanitise(none(spark)).count() == 0
