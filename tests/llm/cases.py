"""Documents and pages with the odd cases that every operator must define."""

LONG = "lorem ipsum dolor sit amet " * 8000
CLASHING = "kept boolean, size string, score string, label string, hits string, spans string, text_key string, h int, key int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
PAGES = "page_id long, url string, html string, text string, host int, verdict int, digest int, payload int"

LETTERS = str.maketrans("0123456789", "abcdefghij")


def plain(k: int, n: int = 80, seed: int = 0) -> str:
    """Words that no other k and seed have."""
    return " ".join(f"w{k}x{seed}y{i * 7919 % 1009}" for i in range(n)).translate(LETTERS)


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *[None] * 9)


def documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with names of results."""
    copy = plain(1)
    rows = [
        doc(1, copy),
        doc(2, copy, source="b"),
        doc(3, copy + " and one more"),
        doc(4, None),
        doc(5, ""),
        doc(6, " \n\t "),
        doc(7, LONG),
        doc(8, plain(8), lang=None, source=None),
        doc(8, plain(8), lang=None, source=None),
        doc(None, plain(9)),
        doc(None, None, None, None),
        doc(10, "one two", source="\U0001f600"),
        doc(11, "one two"),
        doc(12, "mail me: a.b+c@x-y.example.org or +1 (555) 123-4567, ip 10.0.0.1, card 4111 1111 1111 1111 \U0001f600 d@e.fr"),
        doc(13, plain(13) + "\n" + plain(13) + "\n" + plain(13)),
        doc(14, "# $ % & | < > * " * 20),
    ]
    return spark.createDataFrame(rows, DOCS)


def none(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def page(page_id, url, html):
    return (page_id, url, html, "x", 1, 2, 3, 4)
