"""Merkle manifest of a data set: a hash tree per group, a tree over the groups' roots, and a proof per row.

Leaves of a group are ranked by id. Written with the base ``RADIX``, a rank is its path in the tree, so the tree is
built by grouping: the rank's last digit is grouped away, then the last but one, and each group becomes one struct of
its hash and its children's structs. ``DIGITS`` digits make a block of at most ``RADIX ** DIGITS`` leaves, all its
levels are grouped inside the one partition that the block was sent to. One transform then walks the block's nested
struct downwards, collects the siblings beside the way, and an explode gives a row per leaf; leaves are joined with
nothing. The blocks' hashes are the leaves of the next round, and so on until each group has one node; then the
groups' roots go through the same rounds. Only block rows, one per ``RADIX ** DIGITS`` leaves, are joined with the
proof of the node above them.

Ranks come from a sort by range: rows are dealt to partitions by (group, id, leaf) and written, so that each holds a
range; a row's rank is its place in its range plus the sizes of the group's ranges before. A group that holds most of
the rows is thus spread over many tasks, and no task sees more than its range or one block.

A leaf is the hash of ``doc_id, source, lang, n_chars, text``, each ``-`` for null, otherwise its UTF-8 bytes' number,
``:`` and the value. H is the lowercase hex SHA-256 of its inputs' concatenation, digests as hex text. A run of one node
is hashed too while its level has more nodes; a single leaf is its group's root.

Defined cases: a null id comes first in its group and is never tampered with; ties of an id are ordered by the leaf, and
rows that are equal throughout share the leaf, so which of them comes first does not matter. A null group is a group of
its own and comes first. Empty and very long texts are values as others; a long text is hashed in its own row and not
carried further. Further columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import saved

RADIX = 3
DIGITS = 6
NO_STEPS = "array<struct<left: string, right: string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*[field(fields[name]) for name in FIELDS])


def tampered_text(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text without line feeds where 2 divides the checksum of the decimal id."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(hit, F.lit(False)), F.translate(text, "\n", "")).otherwise(F.col(text))


def leaves(docs: DataFrame) -> DataFrame:
    """A row per document: ``id``, ``grp``, its ``leaf`` and the leaf of the tampered row."""
    own = {name: F.col(name) for name in FIELDS}
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("grp"),
        leaf(own).alias("leaf"),
        leaf({**own, "text": tampered_text()}).alias("other"),
    )


def ranked(nodes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (grp, id, leaf, ...) with ``rank`` in the group from 0 and ``n``, the group's size.

    The table is written in ranges, so that a task that runs again reads the same ranges.
    """
    by = [F.col("grp"), F.col("id"), F.col("leaf")]
    ranges = nodes.repartitionByRange(*by).withColumn("part", F.spark_partition_id())
    stored = saved(ranges, name)
    upto = Window.partitionBy("grp").orderBy("part")
    whole = Window.partitionBy("grp")
    sizes = stored.groupBy("grp", "part").agg(F.count("*").alias("size"))
    sizes = sizes.select(
        F.col("grp").alias("grp2"),
        F.col("part").alias("part2"),
        (F.sum("size").over(upto) - F.col("size")).alias("before"),
        F.sum("size").over(whole).alias("n"),
    )
    inside = Window.partitionBy("grp", "part").orderBy("id", "leaf")
    placed = stored.withColumn("place", F.row_number().over(inside) - 1)
    same = F.col("grp").eqNullSafe(F.col("grp2")) & (F.col("part") == F.col("part2"))
    return placed.join(sizes, same).withColumn("rank", F.col("before") + F.col("place")).drop(
        "grp2", "part2", "part", "place", "before"
    )


def level_size(n: Column, level: int) -> Column:
    """Nodes on a level of a tree of ``n`` leaves."""
    return F.ceil(n / F.lit(float(RADIX**level))).cast("long")


def blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, n, rank, node) rolled up: grp, n, block and the ``tree``, a struct of the hash and the children.

    A level that has one node in the whole group passes it on.
    """
    rolled = nodes.select(
        "grp",
        "n",
        F.floor(F.col("rank") / RADIX**DIGITS).cast("long").alias("block"),
        *[(F.floor(F.col("rank") / RADIX**k) % RADIX).cast("int").alias(f"digit{k}") for k in range(DIGITS)],
        F.col("node").alias("tree"),
    ).repartition("grp", "block")
    for k in range(DIGITS):
        left = ["grp", "n", "block", *[f"digit{j}" for j in reversed(range(k + 1, DIGITS))]]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"digit{k}").alias("digit"), F.col("tree").alias("node"))))
        rolled = rolled.groupBy(*left).agg(kids.alias("kids"))
        hashes = F.transform("kids", lambda kid: kid["node"]["hash"])
        top = F.when(level_size(F.col("n"), k) == 1, F.get(hashes, F.lit(0))).otherwise(digest(F.array_join(hashes, "")))
        rolled = rolled.select(*left, F.struct(top.alias("hash"), F.col("kids").alias("kids")).alias("tree"))
    return rolled


def ways(tree: Column, n: Column, above: Column, level: int) -> Column:
    """An array of the leaves below ``tree``, a node on ``level``, each with its ``steps``: the siblings left and right
    of the way, upwards. ``above`` holds the steps from the tree's own node on.
    """
    if level == 0:
        return F.array(F.struct(tree.alias("node"), above.alias("steps")))

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(tree["kids"], keep), lambda kid: kid["node"]["hash"]), "")

    def down(kid: Column) -> Column:
        step = F.struct(
            side(lambda other: other["digit"] < kid["digit"]).alias("left"),
            side(lambda other: other["digit"] > kid["digit"]).alias("right"),
        )
        own = F.when(level_size(n, level - 1) > 1, F.array(step)).otherwise(F.array().cast(NO_STEPS))
        return ways(kid["node"], n, F.concat(own, above), level - 1)

    return F.flatten(F.transform(tree["kids"], down))


def proven(nodes: DataFrame, name: str, above) -> DataFrame:
    """``nodes`` (grp, n, rank, node) as (grp, node, told, steps): the steps lead to the group's root and on by ``above``.

    ``above`` gets the roots (grp, root) and gives a row per group: grp, what is ``told`` about it, and the steps beyond.
    """
    rolled = saved(blocks(nodes), f"{name}-blocks")
    same = F.col("grp").eqNullSafe(F.col("grp2"))
    if not rolled.agg(F.max("block")).first()[0]:  # each group is one block
        upper = above(rolled.select("grp", F.col("tree.hash").alias("root")))
        upper = upper.select(F.col("grp").alias("grp2"), "told", F.col("steps").alias("above"))
    else:
        tops = rolled.select(
            "grp",
            level_size(F.col("n"), DIGITS).alias("n"),
            F.col("block").alias("rank"),
            F.struct(F.col("tree.hash").alias("hash"), F.col("block")).alias("node"),
        )
        upper = proven(tops, f"{name}-up", above)
        upper = upper.select(
            F.col("grp").alias("grp2"), F.col("node.block").alias("block2"), "told", F.col("steps").alias("above")
        )
        same = same & (F.col("block") == F.col("block2"))
    leaves_up = F.explode(ways(F.col("tree"), F.col("n"), F.col("above"), DIGITS)).alias("leaf")
    return rolled.join(upper, same).select("grp", "told", leaves_up).select("grp", "told", "leaf.*")


def top_of_all(roots: DataFrame) -> DataFrame:
    """The way from each group's root to the root of all: the groups, in order, are the leaves of one tree."""
    named = roots.select(F.lit(0).alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf"))
    node = F.struct(F.col("leaf").alias("hash"), F.col("id")).alias("node")
    own = proven(
        ranked(named, "merkle-groups").select("grp", "n", "rank", node),
        "merkle-top",
        lambda top: top.select("grp", F.col("root").alias("told"), F.array().cast(NO_STEPS).alias("steps")),
    )
    told = F.struct(F.col("node.hash").alias("subroot"), F.col("told").alias("root")).alias("told")
    return own.select(F.col("node.id").alias("grp"), told, "steps")


def manifest(docs: DataFrame) -> DataFrame:
    """A row per document: ``id``, ``grp``, ``leaf``, the tampered row's leaf ``other``, ``subroot``, ``root`` and the
    proof as ``steps``, the hashes left and right of the way from the leaf to the root."""
    node = F.struct(F.col("leaf").alias("hash"), F.col("id"), F.col("other")).alias("node")
    placed = ranked(leaves(docs), "merkle-leaves").select("grp", "n", "rank", node)
    return proven(placed, "merkle", top_of_all).select(
        F.col("node.id").alias("id"),
        "grp",
        F.col("node.hash").alias("leaf"),
        F.col("node.other").alias("other"),
        "told.subroot",
        "told.root",
        "steps",
    )


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, start, lambda at, step: digest(step["left"], at, step["right"]))


def verify(found: DataFrame) -> DataFrame:
    """The manifest with the proof's digest and whether each row, tampered with or not, leads to the root."""
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""))
    again = found.withColumn("folded_root", folded(F.col("other"), F.col("steps")))
    return again.select(
        F.col("id").alias("doc_id"),
        F.col("grp").alias("source"),
        "leaf",
        "subroot",
        "root",
        proof.alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
        "steps",
    )
