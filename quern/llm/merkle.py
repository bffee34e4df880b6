"""A Merkle manifest of a table: a digest of every row, a tree for each source and one over the sources.

1. `record_digest` hashes every row where it is read, so that texts never cross the network.
2. `placed` numbers the rows of each tree in order: rows are dealt out by range, numbered within
   partitions, and shifted by the counts of the partitions before. No tree is sorted in one task.
3. `grow` goes up level by level. Each node computes the index of its sibling at slot zero (by XOR in a
   binary tree, by its slot's offset otherwise) and equijoins it; slot-zero rows then emit the parents. A level has
   the fan-out's fraction of the rows of the one below.
4. The sources' roots are leaves of a last tree, built alike, whose root stands for the table.
5. `descend` goes down again: what stands beside a run's parent, and beside all its ancestors, is
   joined to the run once, and to its leaves at last. A row's proof is this path of siblings.

`fold` recomputes a root from a leaf and its path, so one row can be checked without the others.

Defined results: nulls have a sign of their own, in any column; a null source is a tree of its own, before the others;
rows with a null id come first in their tree; rows that agree in all columns are leaves side by side;
a tree of one row has that leaf as root; an empty table has no root and gives an empty result. Texts are hashed whole.
Columns that are not hashed don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Rows of partition counts that may be broadcast; about 100 bytes each.
BROADCAST_ROWS = 50_000


def record_digest(values: Iterable[Column]) -> Column:
    """SHA-256, in hexadecimal digits, of values that are each preceded by their length in bytes and a colon; null is a hyphen."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of `path`."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_digest(path: Column) -> Column:
    """A digest of all siblings of a path, from the leaf up, each level from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """`rows` with `i`, their place in their `tree` in the given order from 0, and `size`, the tree's number of rows. Equal rows stand in any order."""
    # The tie-breaker lets the range partitioner cut through repeated rows.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "tie"]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    numbered = cut(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    counts = cut(numbered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    if counts.count() <= BROADCAST_ROWS:
        shifts = F.broadcast(shifts)
    return numbered.join(shifts, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def level_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """The runs of `fanout` nodes (tree, i, size, digest), as the nodes of the next level, with the run's digests in `members`."""
    slot = F.pmod("i", F.lit(fanout))
    sibling = F.col("i").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("i") - slot
    zero = nodes.filter(slot == 0).select("tree", "i", "size", "digest")
    others = nodes.filter(slot > 0).select("tree", sibling.alias("i"), slot.alias("slot"), F.col("digest").alias("other"))
    beside = F.transform(F.array_sort(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "other")))), lambda x: x["other"])
    joined = zero.join(others, ["tree", "i"], "left").groupBy("tree", "i").agg(F.first("size").alias("n"), F.first("digest").alias("own"), beside.alias("beside"))
    members = F.concat(F.array("own"), "beside")
    parent = F.sha2(F.concat("own", F.array_join("beside", "")), 256)
    whole = F.floor(F.col("i") / fanout) if fanout > 2 else F.shiftright("i", 1)
    return joined.select("tree", whole.cast("long").alias("i"), F.ceil(F.col("n") / fanout).cast("long").alias("size"), parent.alias("digest"), members.alias("members"))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs above `leaves` (tree, i, size, digest), lowest first, and the roots (tree, digest)."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels, nodes = [], leaves.select("tree", "i", "size", "digest")
    roots = nodes.filter("size = 1").select("tree", "digest")
    while most > 1:
        nodes = cut(level_up(nodes.filter("size > 1"), fanout))
        levels.append(nodes)
        roots = roots.union(nodes.filter("size = 1").select("tree", "digest"))
        most = -(-most // fanout)
    return levels, roots


def _beside(members: Column, slot: Column) -> Column:
    """What stands left and right of a slot of a run."""
    left = F.array_join(F.slice(members, F.lit(1), slot), "")
    right = F.array_join(F.slice(members, slot + 2, F.size(members)), "")
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """`leaves` with the columns of `above` (tree, path, ...), the path prolonged by the tree's own levels."""
    extra = [c for c in above.columns if c not in ("tree", "path")]
    keep = [c for c in leaves.columns if c != "tree"]
    lone = leaves.filter("size = 1").join(above, "tree").select("tree", *keep, *extra, "path")
    if not levels:
        return lone
    up = None
    for runs in [*reversed(levels), None]:
        low = (leaves if runs is None else runs).filter("size > 1")
        own = keep if runs is None else ["i", "members"]
        if up is not None:
            parent = up.select(F.col("tree").alias("_t"), F.col("i").alias("_i"), F.col("members").alias("_members"), F.col("path").alias("_path"), *extra)
            index = F.floor(F.col("i") / fanout).cast("long")
            low = low.join(parent, (F.col("tree") == F.col("_t")) & (index == F.col("_i")))
            path = F.concat(_beside(F.col("_members"), F.pmod("i", F.lit(fanout)).cast("int")), "_path")
            low = low.select("tree", *own, *extra, path.alias("path"))
        if runs is None:
            return low.union(lone)
        top = runs.filter("size = 1").join(above, "tree").select("tree", *own, *extra, "path")
        up = top if up is None else top.union(low)


def manifest(df: DataFrame, columns: Sequence[str] = COLUMNS, source: str = "source", doc_id: str = "doc_id", fanout: int = FANOUT, claim: Column | None = None) -> DataFrame:
    """One row per row of `df`: doc_id, source, i (its place in the source), leaf, claim, subroot, root and path.

    `claim` is another digest to be carried along, as of a row whose state is in doubt; the leaf itself by default.
    """
    if fanout < 2:
        raise ValueError("fanout has to be 2 at least")
    leaf = record_digest(F.col(f"`{c}`") for c in columns)
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = df.select(tree.alias("tree"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), leaf.alias("digest"), (leaf if claim is None else claim).alias("claim"))
    leaves = placed(rows, ["doc_id", "digest"])
    levels, subroots = grow(leaves, fanout)
    tops = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    high, roots = grow(tops, fanout)
    empty = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    summit = roots.select("tree", F.col("digest").alias("root"), empty.alias("path"))
    above = cut(descend(tops, high, summit, fanout).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path"))
    return descend(leaves, levels, above, fanout).select("doc_id", "source", "i", F.col("digest").alias("leaf"), "claim", "subroot", "root", "path")


def audited(df: DataFrame, claim: Column, **options) -> DataFrame:
    """`manifest` with each row's claim checked against its path: proof_sha256, folded_root and verified."""
    out = manifest(df, claim=claim, **options)
    folded = fold(F.col("claim"), F.col("path"))
    return out.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded}).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    """The text with A to Z as small letters, and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
