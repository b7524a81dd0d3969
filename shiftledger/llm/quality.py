"""Quality rules: fixed rules per document, then lines that too many documents of a host share.

A line's normal form is its words, A-Z in lower case and digit runs as 0, joined by one space. Documents are
told apart by a hash of all their normal lines, so that copies of one document count once. A line of n words is
boilerplate in a host where it stands in over ``max(least, share // n)`` of the host's documents, by the limits
``HOST_LIMITS``, and in every host where it stands in over that many of all documents, by ``ALL_LIMITS``. The limits
are fixed numbers at every size of a host: the longer a line, the less likely are different documents to share it
by chance. Boilerplate lines are removed; a document of which too little is left is rejected.

Documents that differ in a few words share nearly all their lines, so many of them would reject each other. The
first document of a boilerplate line is the one with the least id, of the host, or of all where the line is above
the limit of all. A document that would be depleted, but not if the lines it is the first document of had stayed,
keeps its whole text and is not rejected: of near copies one stays.

Defined cases: a null text is empty and a null host is a host of its own; a document without words fails the
fixed rules; a null id is never the first. Very long texts are read whole, their memory is in proportion to the text.
Documents with the same least id are all the first (a tie); repeated rows get equal results each. Columns of the
input that have the name of a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import SPACE, filled, let, lower_ascii, saved, words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Documents that may share a line of n words: max(least, share // n).
HOST_LIMITS = (3, 25)
ALL_LIMITS = (20, 500)
MIN_LEFT_WORDS = 20
MIN_LEFT_PERCENT = 20
RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def normal(line: Column) -> Column:
    spaced = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.regexp_replace(lower_ascii(spaced), "[0-9]+", "0")


def has_word(line: Column) -> Column:
    return F.length(F.translate(line, SPACES, "")) > 0


def neighbours(rows: Column, fn) -> Column:
    """``fn`` of each element and the next one."""
    n = F.greatest(F.size(rows) - 1, F.lit(0))
    return F.zip_with(F.slice(rows, F.lit(1), n), F.slice(rows, F.lit(2), n), fn)


def repeated_words(found: Column) -> Column:
    """Words in windows of three that occur twice or more.

    The windows' hashes are sorted with their places; equal neighbours are windows found again. Their places,
    sorted, cover three words each, less what the next one covers too.
    """

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def ordered(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def again(s: Column) -> Column:
        no = F.array(F.lit(False))
        return let(
            neighbours(s, lambda a, b: a["h"] == b["h"]),
            lambda equal: F.filter(
                F.zip_with(s, F.zip_with(F.concat(no, equal), F.concat(equal, no), lambda a, b: a | b), lambda x, m: F.when(m, x["i"])),
                lambda x: x.isNotNull(),
            ),
        )

    def covered(places: Column) -> Column:
        steps = neighbours(places, lambda a, b: F.least(b - a, F.lit(3)))
        return F.aggregate(steps, F.lit(3), lambda total, x: total + x)

    def of_hashes(h: Column) -> Column:
        return F.when(
            F.size(h) > F.size(F.array_distinct(h)),
            let(ordered(h), lambda s: let(F.sort_array(again(s)), covered)),
        ).otherwise(0)

    return let(found, lambda w: F.when(F.size(w) > 3, let(windows(w), of_hashes)).otherwise(0))


def with_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RULES``."""
    own = [c for c in docs.columns if c not in RULES]
    full = filled(text)
    lines = F.filter(F.split(full, "\n"), has_word)
    found = docs.select(
        *own,
        F.size(words(full)).cast("long").alias("n_words"),
        F.length(F.translate(full, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words(full)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return found.withColumn("base_failed", failed)


def document_key(doc_id: str, text: str, host: str) -> tuple[Column, Column]:
    """What tells rows apart: rows that agree in it are the same document with the same result."""
    return F.col(doc_id).alias("id"), F.xxhash64(F.col(host), F.col(text)).alias("key")


def document_lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """A row per line with a word: the document's key, host and the hash of its lines, the line's place, hash and words."""
    lines = F.transform(F.filter(F.split(filled(text), "\n"), has_word), normal)
    rows = docs.select(*document_key(doc_id, text, host), F.col(host).alias("host"), lines.alias("lines"))
    rows = rows.withColumn("told", F.xxhash64("lines"))
    rows = rows.select("id", "key", "host", "told", F.posexplode("lines").alias("pos", "line"))
    n = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return rows.select("id", "key", "host", "told", "pos", F.xxhash64("line").alias("line"), n.cast("long").alias("n"))


def above(docs: str, n: str, limits: tuple[int, int]) -> Column:
    """Whether so many documents are too many for a line of ``n`` words."""
    least, share = limits
    return F.col(docs) > F.greatest(F.lit(least), F.floor(F.lit(share) / F.col(n)))


def boilerplate_lines(
    lines: DataFrame, host_limits: tuple[int, int] = HOST_LIMITS, all_limits: tuple[int, int] = ALL_LIMITS
) -> DataFrame:
    """Host and hash of the lines above the limits, and the id of the line's first document."""
    counted = (F.max("n").alias("n"), F.countDistinct("told").alias("docs"), F.min("id").alias("first"))
    hosts = lines.groupBy("host", "line").agg(*counted).filter(above("docs", "n", host_limits))
    everywhere = lines.groupBy("line").agg(*counted).filter(above("docs", "n", all_limits))
    everywhere = saved(everywhere.select(F.col("line").alias("line2"), F.col("first").alias("first2")), "shared-lines")
    standing = lines.select("host", "line").join(everywhere, F.col("line") == F.col("line2"))
    standing = standing.groupBy("host", "line").agg(F.min("first2").alias("first"))
    rest = hosts.join(everywhere, F.col("line") == F.col("line2"), "left_anti")
    return standing.unionByName(rest.select("host", "line", "first"))


def too_little(left: Column) -> Column:
    return (left < MIN_LEFT_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words"))


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    host_limits: tuple[int, int] = HOST_LIMITS,
    all_limits: tuple[int, int] = ALL_LIMITS,
) -> DataFrame:
    """``docs`` with the rules' columns, ``n_removed`` words on boilerplate lines, ``cleaned`` text and ``kept``."""
    lines = saved(document_lines(docs, doc_id, text, host), "quality-lines")  # read four times
    often = saved(boilerplate_lines(lines, host_limits, all_limits), "boilerplate")
    often = often.select(F.col("host").alias("host2"), F.col("line").alias("line2"), "first")
    found = lines.join(often, (F.col("line") == F.col("line2")) & F.col("host").eqNullSafe(F.col("host2")))
    removed = (
        found.select("id", "key", "pos", "line", "n", "first")
        .distinct()  # a repeated row's lines count once
        .groupBy(F.col("id").alias("__id2"), F.col("key").alias("__key2"))
        .agg(
            F.sum("n").alias("__n"),
            F.sum(F.when(F.col("id") == F.col("first"), F.col("n")).otherwise(0)).alias("__first"),
            F.collect_set("line").alias("__lines"),
        )
    )
    id1, key1 = document_key(doc_id, text, host)
    judged = with_rules(docs.withColumns({"__id": id1, "__key": key1}), text).join(
        removed, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__key") == F.col("__key2")), "left"
    )
    n_left = F.col("n_words") - F.col("__n")
    # Whole: no boilerplate, or the first of near copies.
    whole = F.col("__n").isNull() | (too_little(n_left) & ~too_little(n_left + F.col("__first")))
    judged = judged.withColumn("__whole", whole)
    left = F.filter(
        F.split(filled(text), "\n"),
        lambda x: ~(has_word(x) & F.array_contains(F.col("__lines"), F.xxhash64(normal(x)))),
    )
    own = [c for c in docs.columns if c not in (*RULES, "n_removed", "cleaned", "kept")]
    return judged.select(
        *own,
        *RULES,
        F.when(F.col("__whole"), F.lit(0).cast("long")).otherwise(F.col("__n")).alias("n_removed"),
        F.when(F.col("__whole"), F.col(text)).otherwise(F.array_join(left, "\n")).alias("cleaned"),
        (~F.col("base_failed") & (F.col("__whole") | ~too_little(n_left))).alias("kept"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rejected documents go; the others lose their boilerplate lines."""
    kept = judge(docs).filter("kept")
    changed = F.col("n_removed") > 0
    return kept.withColumns(
        {
            "text": F.col("cleaned"),
            "n_chars": F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("n_chars")),
        }
    ).select(docs.columns)
