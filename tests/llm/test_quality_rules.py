import re
from collections import Counter

from cases import doc, documents, none, plain

from shiftledger.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def rules(text):
    """The fixed rules, written out plainly."""
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


def test_rules_equal_the_plain_ones(spark):
    docs = documents(spark)
    found = quality.judge(docs)
    assert found.columns == [c for c in docs.columns if c != "kept"] + [*quality.RULES, "n_removed", "cleaned", "kept"]
    for row in found.collect():
        assert tuple(row[c] for c in quality.RULES) == rules(row["text"]), row["doc_id"]
        assert row["kept"] is not row["base_failed"] and row["n_removed"] == 0 and row["cleaned"] == row["text"]
    assert found.count() == docs.count()


def test_boilerplate_goes_and_depleted_documents_with_it(spark):
    banner = "Subscribe to our letter number 12 today please"
    rows = [doc(k, f"{banner.replace('12', str(k))}\n{plain(k)}") for k in range(30)]
    rows += [doc(100 + k, plain(500)) for k in range(30)]  # copies count as one document
    rows.append(doc(200, "\n".join([banner] * 12)))
    rows.append(doc(201, f"{banner}\n{plain(201)}", source="other"))
    many = [plain(900 + k, 7) for k in range(9)]
    rows += [doc(300 + k, "\n".join([*many, plain(300 + k, 60)])) for k in range(20)]
    rows.append(doc(400, "\n".join([*many, "closing words"])))
    docs = spark.createDataFrame(rows, documents(spark).schema)
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert found[3]["cleaned"] == plain(3) and found[3]["n_removed"] == 8 and found[3]["kept"]
    assert found[110]["cleaned"] == plain(500) and found[110]["kept"]
    assert found[201]["n_removed"] == 0 and found[201]["kept"]
    assert found[305]["kept"] and found[305]["n_removed"] == 63
    assert not found[400]["base_failed"] and not found[400]["kept"]
    kept = {r["doc_id"]: r for r in quality.stage(spark, docs, "").collect()}
    assert kept[3]["text"] == plain(3) and kept[3]["n_chars"] == len(plain(3)) and 400 not in kept


def test_documents_with_equal_first_and_last_lines_are_told_apart(spark):
    """A number and a footer are the least and greatest line of every document of the host."""
    rows = [doc(k, f"{k}\n{plain(k)}\n\u00a9 all rights of this site reserved") for k in range(30)]
    rows += [doc(100 + k, f"7\n{plain(500)}\n\u00a9 all rights reserved", source="copies") for k in range(30)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    found = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(found[k]["cleaned"] == plain(k) and found[k]["n_removed"] == 8 for k in range(30))
    assert all(found[100 + k]["n_removed"] == 0 for k in range(30))  # copies count as one document


def test_limits_fall_with_length_and_stay_in_large_hosts(spark):
    """A long line may stand in three documents of a host, a short one in more, however many documents there are."""
    licence, short = plain(7000, 60), plain(7001, 5)
    rows = [doc(k, f"{plain(k)}\n{licence if k < 9 else plain(3000 + k, 60)}", source="small") for k in range(60)]
    rows += [doc(1000 + k, f"{plain(k, 40, 2)}\n{plain(k, 40, 3) if k >= 90 else licence}", source="large") for k in range(1000)]
    rows += [doc(3000 + k, f"{plain(k, 80, 4)}\n{plain(7002, 60)}", source="few") for k in range(3)]
    rows += [doc(4000 + k, f"{plain(k, 80, 5)}\n{short}", source="five") for k in range(5)]
    rows += [doc(5000 + k, f"{plain(k, 80, 6)}\n{short}", source="six") for k in range(6)]
    rows += [doc(6000 + k, f"{plain(k, 80, 8)}\n{plain(7003, 30)}", source=f"host {k}") for k in range(21)]
    rows += [doc(6100 + k, f"{plain(k, 80, 9)}\n{plain(7004, 30)}", source=f"host {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    found = {r["doc_id"]: r["n_removed"] for r in quality.judge(docs).filter("kept").collect()}
    assert len(found) == len(rows)
    assert all(found[k] == (60 if k < 9 else 0) for k in range(60))
    assert all(found[1000 + k] == (60 if k < 90 else 0) for k in range(1000))
    assert all(found[3000 + k] == 0 for k in range(3)) and all(found[4000 + k] == 0 for k in range(5))
    assert all(found[5000 + k] == 5 for k in range(6))
    assert all(found[6000 + k] == 30 for k in range(21)) and all(found[6100 + k] == 0 for k in range(20))


def test_one_of_near_copies_stays(spark):
    lines = [plain(800 + k, 40) for k in range(9)]
    rows = [doc(50 + k, "\n".join([*lines[: k % 9], plain(900 + k, 40), *lines[k % 9 :]])) for k in range(40)]
    rows += [doc(200 + k, "\n".join([*lines, plain(950 + k, 9)]), source=f"h{k}") for k in range(30)]
    rows += [doc(None, "\n".join([*lines, plain(999, 9)])), doc(50, rows[0][1])]
    found = quality.judge(spark.createDataFrame(rows, documents(spark).schema)).collect()
    assert [(r["doc_id"], r["n_removed"], r["cleaned"]) for r in found if r["kept"]] == [(50, 0, rows[0][1])] * 2
    assert all(r["n_removed"] == 360 for r in found if r["doc_id"] != 50)


def test_empty_table(spark):
    assert quality.judge(none(spark)).count() == 0
