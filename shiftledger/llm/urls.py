"""URL rules by expressions: host suffixes and path prefixes, joined on short hashes and confirmed in full.

A rule is a host, a path and an action. It fits its host and all subdomains where the URL's path starts with
its path. The longest rule text wins, then the longer host, then block. Each URL is expanded into the host
suffixes and path prefixes that have the length of some rule's; rules and expressions meet on the first
``PREFIX`` digits of a SHA-256, the join key, and are confirmed on all of it.

Defined cases: a null URL or one without ``://`` has an empty host and path and no rule. Repeated rows get
equal results each. Without rules every URL gets the default. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm.common import lower_ascii

PREFIX = 8
DEFAULT = "allow"

# The rules that the registered query applies.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "action"), rule)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def after_scheme(url: str) -> Column:
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def host_of(url: str) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; the length of the host keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their digest and a rank: the length of the text, the length of the host, then block, in one number."""
    known = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
    whole = F.length("host") + F.length("path")
    rank = (whole.cast("long") * 65536 + F.length("host")) * 2 + (F.col("action") == "block").cast("long")
    full = digest(F.col("host"), F.col("path"))
    return known.select(
        F.substring(full, 1, PREFIX).alias("rule_prefix"), full.alias("rule_digest"), rank.alias("rank"),
        F.length("host").alias("host_length"), F.length("path").alias("path_length"),
    )


def by_prefix(listed: DataFrame) -> DataFrame:
    """A row per digest prefix with its rules; as prefixes are 32 bits, a list is short, whatever the number of rules."""
    rules = listed.select("rule_prefix", "rule_digest", "rank").distinct()
    return rules.groupBy("rule_prefix").agg(F.collect_list(F.struct("rule_digest", "rank")).alias("candidates"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id", "url"),
    default: str = DEFAULT,
) -> DataFrame:
    """The ``keep`` columns with host, path, rule and verdict."""
    listed = prepared(rules)
    lengths = listed.agg(
        F.collect_set("host_length").alias("hosts"), F.collect_set("path_length").alias("paths")
    )  # one row, at most as many lengths as a URL can have
    rows = pages.select(
        *keep,
        F.monotonically_increasing_id().alias("__row"),
        host_of(url).alias("__host"),
        path_of(url).alias("__path"),
        lengths.select("hosts").scalar().alias("__hosts"),
        lengths.select("paths").scalar().alias("__paths"),
    )
    host, path = F.col("__host"), F.col("__path")
    n_host, n_path = F.length(host), F.length(path)
    suffixes = F.transform(
        F.filter(
            F.col("__hosts"),
            lambda n: (n == n_host) | ((n < n_host) & (F.substr(host, n_host - n, F.lit(1)) == ".")),
        ),
        lambda n: F.substr(host, n_host - n + 1),
    )
    prefixes = F.transform(
        F.filter("__paths", lambda n: n <= n_path), lambda n: F.substr(path, F.lit(1), n)
    )
    rows = rows.withColumns({"__suffixes": suffixes, "__prefixes": prefixes})
    digests = F.flatten(
        F.transform("__suffixes", lambda h: F.transform(F.col("__prefixes"), lambda p: digest(h, p)))
    )
    key = [*keep, "__row", "__host", "__path"]
    expressions = rows.select(*key, F.explode_outer(digests).alias("__digest"))
    # The short prefix alone is the join key; of the rules that share it the whole digest picks.
    found = expressions.join(by_prefix(listed), F.substring("__digest", 1, PREFIX) == F.col("rule_prefix"), "left")
    confirmed = F.filter("candidates", lambda c: c["rule_digest"] == F.col("__digest"))
    ranks = F.array_max(F.transform(confirmed, lambda c: c["rank"]))
    best = found.withColumn("__rank", ranks).groupBy(*key).agg(F.max("__rank").alias("__rank"))
    # The rank gives back the rule: lengths of its text and host, and the action in the last bit.
    whole = F.shiftright("__rank", 17).cast("int")
    n = F.shiftright("__rank", 1).bitwiseAND(65535).cast("int")
    rule = F.concat(F.substr(host, n_host - n + 1), F.substr(path, F.lit(1), whole - n))
    verdict = F.when(F.col("__rank").bitwiseAND(1) == 1, "block").when(F.col("__rank").isNotNull(), "allow")
    return best.select(
        *keep,
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("__rank").isNotNull(), rule).alias("rule"),
        F.coalesce(verdict, F.lit(default)).alias("verdict"),
    )
