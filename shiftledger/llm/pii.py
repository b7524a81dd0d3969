"""Personal data: fixed kinds by pattern, then terms that reveal them, by what their co-occurrence tells.

The fixed kinds are e-mail addresses, IP addresses, card and phone numbers. Each value found is a protected
entity. The terms (runs of letters, A-Z in lower case) in the ``NEAR`` characters on either side of an entity
are its context. A term discloses an entity where the pointwise mutual information of the two is at least
``THRESHOLD`` of the information the entity itself carries, log(N / n_entity), and where they meet in at least
``MIN_CONTEXTS`` different contexts and different texts, so that one text and its copies prove nothing (the lesser
of the two numbers is what counts). N and the counts of terms are of all documents. Terms that disclose an entity are spans of kind ``term`` wherever they occur as whole terms.
In the sanitised text fixed kinds are generalised to their names in brackets and terms are removed.

Defined cases: a null text is empty. Very long texts are read whole; n spans of one text cost n times the root of n
steps. Spans of equal start (a tie) are ordered by kind. Letters beyond ASCII keep their case in a term.
Repeated rows count as documents and get equal results each. Positions are code points, ends exclusive. Input
columns with the name of a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, let, lower_ascii, running, saved

KINDS = ("email", "ip", "card", "phone")
NEAR = 60
CHUNK = 256
MIN_CONTEXTS = 3
THRESHOLD = 0.9

# The contract's patterns in a form that never backtracks into a run: a match starts at the start of a run of its
# first class, or where the last match ended (``\G``, as the text before a match is matched too).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole runs of digits with 14 to 19 of them; shorter and longer runs are matches that fail.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
TERM = r"\p{L}+"
NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "sanitised")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass: from the right, every second one is doubled and its digits added."""
    each = F.transform(
        F.split(F.reverse(digits(value)), ""),
        lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.coalesce(x, F.lit(0))) % 10 == 0


def matches(text: Column, pattern: Column, maybe: Column, kind: int, valid) -> Column:
    """Spans (start, kind, end, value) of the matches that are ``valid``; none is looked for unless ``maybe``.

    Each match is found together with the text before it, from where the last one ended; the lengths add up to
    positions.
    """
    whole = F.concat(F.lit(r"(?s)\G(.*?)("), pattern, F.lit(")"))
    none = F.array().cast("array<string>")
    steps = F.when(maybe, F.regexp_extract_all(text, whole, F.lit(0))).otherwise(none)
    values = F.when(maybe, F.regexp_extract_all(text, whole, F.lit(2))).otherwise(none)
    ends = running(F.transform(steps, F.length), lambda a, b: a + b)
    spans = F.zip_with(
        ends,
        values,
        lambda e, v: F.struct(
            (e - F.length(v)).alias("s"), F.lit(kind).alias("k"), e.alias("e"), v.alias("v")
        ),
    )
    return F.filter(spans, lambda x: valid(x["v"]))


def base_spans(text: Column) -> Column:
    """The spans of the fixed kinds by start, then kind."""

    def count(v, low, high):
        return F.length(digits(v)).between(low, high)

    four = f"^{BYTE}(?:[.]{BYTE}){{3}}$"
    found = (
        matches(text, F.lit(EMAIL), F.contains(text, F.lit("@")), 0, lambda v: F.lit(True)),
        matches(text, F.lit(IP), text.rlike(r"[0-9]\.[0-9]"), 1, lambda v: v.rlike(four)),
        matches(text, F.lit(CARD), text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), 2, luhn),
        matches(text, F.lit(PHONE), F.contains(text, F.lit("+")), 3, lambda v: count(v, 10, 15)),
    )
    return F.sort_array(F.concat(*found))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def text_key(text: str) -> Column:
    return F.xxhash64(filled(text))


def chunks(text: Column) -> Column:
    """The text in parts of ``CHUNK`` code points, as a position in a string is found by reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in ``chunks``."""
    first = F.floor(start / CHUNK).cast("int")
    n = F.floor(end / CHUNK).cast("int") - first + 1
    return F.substr(F.array_join(F.slice(parts, first + 1, n), ""), start - first * CHUNK + 1, end - start)


def contexts(found: DataFrame, text: str) -> DataFrame:
    """A row per text, entity, context and term in it. Words cut by the context or its entity don't count."""
    full = filled(text)

    def around(parts: Column, n: Column) -> Column:
        def of(x: Column) -> Column:
            before = F.regexp_replace(piece(parts, F.greatest(x["s"] - NEAR, F.lit(0)), x["s"]), r"\p{L}+$", "")
            after = F.regexp_replace(piece(parts, x["e"], F.least(x["e"] + NEAR, n)), r"^\p{L}+", "")
            before = F.when(x["s"] > NEAR, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
            after = F.when(x["e"] + NEAR < n, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
            return F.struct(x["k"].alias("k"), x["v"].alias("v"), F.concat(before, F.lit(" \n "), after).alias("around"))

        return F.transform("__base", of)

    each = let(chunks(full), lambda parts: let(F.length(full), lambda n: around(parts, n)))
    rows = found.select(text_key(text).alias("key"), F.explode(each).alias("x"))
    compact = F.when(F.col("x.k") == 0, lower_ascii(F.col("x.v"))).when(F.col("x.k") == 1, F.col("x.v"))
    entity = F.concat(F.col("x.k").cast("string"), F.lit(":"), F.coalesce(compact, digits(F.col("x.v"))))
    rows = rows.select("key", entity.alias("entity"), F.col("x.around").alias("around"))
    found_terms = F.array_distinct(terms(F.col("around"))).alias("t")
    rows = rows.select("key", "entity", F.xxhash64("around").alias("context"), found_terms)
    return rows.select("key", "entity", "context", F.explode("t").alias("term"))


def discloses(n: Column, of_term: str, threshold: float) -> Column:
    """Whether a term in ``of_term`` of ``n`` documents tells enough of an entity with ``both`` and ``of_entity``."""
    shared = F.log(F.col("both") * n / (F.col("of_entity") * F.col(of_term)))
    own = F.log(n / F.col("of_entity"))
    return (own > 0) & (shared >= threshold * own)


def disclosing(
    docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS
) -> DataFrame:
    """A row (key, terms) for each text that has terms which disclose an entity."""
    found = docs.select(text, base_spans(filled(text)).alias("__base")).filter(F.size("__base") > 0)
    near = saved(contexts(found, text), "pii-contexts")
    n = F.lit(docs.count()).cast("double")
    met = F.least(F.countDistinct("context"), F.countDistinct("key"))
    pairs = near.groupBy("entity", "term").agg(met.alias("both"))
    entities = near.groupBy(F.col("entity").alias("entity2")).agg(met.alias("of_entity"))
    # A term is in at least as many documents as near an entity. A pair that this bound rules out stays ruled
    # out by the count over all documents, so common terms need not be looked for.
    at_least = near.groupBy(F.col("term").alias("term2")).agg(F.countDistinct("key").alias("at_least"))
    pairs = (
        pairs.filter(F.col("both") >= min_contexts)
        .join(entities, F.col("entity") == F.col("entity2"))
        .join(at_least, F.col("term") == F.col("term2"))
        .filter(discloses(n, "at_least", threshold))
        .select("entity", "term", "both", "of_entity")
    )
    pairs = saved(pairs, "pii-pairs")
    candidates = pairs.select(F.col("term").alias("term2")).distinct()
    # One scan of all texts serves the counts of terms and the search for them.
    everywhere = docs.select(text_key(text).alias("key"), F.explode(F.array_distinct(terms(filled(text)))).alias("term"))
    hits = saved(everywhere.join(candidates, F.col("term") == F.col("term2"), "left_semi"), "pii-hits")
    of_term = hits.groupBy(F.col("term").alias("term3")).agg(F.count(F.lit(1)).alias("of_term"))
    flagged = (
        pairs.join(of_term, F.col("term") == F.col("term3"))
        .filter(discloses(n, "of_term", threshold))
        .select(F.col("term").alias("term4"))
        .distinct()
    )
    told = hits.join(flagged, F.col("term") == F.col("term4"), "left_semi")
    return saved(told.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "pii-terms")


def joined_spans(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    named = F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"]))
    return F.array_join(named, ",")


def apart(spans: str) -> Column:
    """The sorted ``spans`` without the terms that overlap a fixed kind: one that ends behind their start or starts before their end."""
    base = lambda x: x["k"] < len(KINDS)
    last_end = running(F.transform(spans, lambda x: F.when(base(x), x["e"]).otherwise(0)), F.greatest)
    far = F.lit(2**31 - 1)
    starts = F.transform(F.reverse(spans), lambda x: F.when(base(x), x["s"]).otherwise(far))
    next_start = F.reverse(running(starts, F.least))

    def kept(last: Column, after: Column) -> Column:
        return F.filter(spans, lambda x, i: base(x) | ((F.get(last, i) <= x["s"]) & (F.get(after, i) >= x["e"])))

    found = let(last_end, lambda last: let(next_start, lambda after: kept(last, after)))
    return F.when(F.size(F.filter(spans, lambda x: ~base(x))) == 0, F.col(spans)).otherwise(found)


def merged(spans: str) -> Column:
    """Runs (s, k, e) of the sorted ``spans`` that overlap, each of its first span's kind."""

    def runs(ends: Column) -> Column:
        first = F.filter(
            F.transform(spans, lambda x, i: F.when((i == 0) | (F.get(ends, i - 1) <= x["s"]), i)), lambda i: i.isNotNull()
        )
        return let(
            first,
            lambda at: F.transform(
                at,
                lambda i, n: F.struct(
                    F.get(F.col(spans), i)["s"].alias("s"),
                    F.get(F.col(spans), i)["k"].alias("k"),
                    F.get(ends, F.coalesce(F.get(at, n + 1), F.size(spans)) - 1).alias("e"),
                ),
            ),
        )

    return let(running(F.transform(spans, lambda x: x["e"]), F.greatest), runs)


def sanitise(
    docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, min_contexts: int = MIN_CONTEXTS
) -> DataFrame:
    """``docs`` with counts, spans and the ``sanitised`` text (null for null)."""
    told = disclosing(docs, text, threshold, min_contexts)
    told = told.select(F.col("key").alias("__key2"), F.col("terms").alias("__terms"))
    own = [c for c in docs.columns if c not in NAMES]
    rows = docs.withColumn("__key", text_key(text)).join(told, F.col("__key") == F.col("__key2"), "left")
    full = filled(text)
    any_term = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("__terms", "|"), F.lit(r")(?!\p{L})"))
    rows = rows.select(
        *docs.columns,
        base_spans(full).alias("__base"),
        matches(lower_ascii(full), any_term, F.col("__terms").isNotNull(), 4, lambda v: F.lit(True)).alias("__said"),
    )
    both = F.sort_array(F.concat("__base", "__said"))
    rows = rows.select(*docs.columns, "__base", both.alias("__both"))
    rows = rows.select(*docs.columns, "__base", apart("__both").alias("__spans"))
    rows = rows.select(*docs.columns, "__base", "__spans", merged("__spans").alias("__merged"))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def end_before(i: Column) -> Column:
        return F.coalesce(F.get("__merged", i - 1)["e"], F.lit(0))

    pieces = let(
        chunks(full),
        lambda parts: F.transform(
            "__merged", lambda x, i: F.concat(piece(parts, end_before(i), x["s"]), F.get(tags, x["k"]))
        ),
    )
    rest = F.substr(full, end_before(F.size("__merged")) + 1)
    clean = F.when(F.size("__merged") == 0, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), rest))

    def count(kind: int) -> Column:
        return F.size(F.filter("__base", lambda x: x["k"] == kind)).cast("long")

    return rows.select(
        *own,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined_spans(F.col("__base")), 256).alias("base_sha256"),
        joined_spans(F.col("__spans")).alias("spans"),
        (F.size("__spans") - F.size("__base")).cast("long").alias("n_term"),
        clean.alias("sanitised"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: texts are sanitised, all documents stay."""
    changed = F.col("sanitised").isNotNull() & (F.col("sanitised") != F.col("text"))
    return sanitise(docs).withColumns(
        {
            "n_chars": F.when(changed, F.length("sanitised").cast("long")).otherwise(F.col("n_chars")),
            "text": F.col("sanitised"),
        }
    ).select(docs.columns)
