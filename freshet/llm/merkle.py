"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Leaves are hashed where the rows are read, sorted by range into runs, numbered within their group, and
written. Each level is one sequential reading of the level below and is written as Parquet of its own
(the node store), so a tree may be far larger than memory. Proofs come back down: at each level
the nodes met on the way are merged with the stored level by (tree, pos), which gives each child its
siblings. Digests are 32 bytes in the store and hex text where they are hashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm import common as C
from freshet.operators.network import numbered

FANOUT = 3
#: Levels that one job takes on the way down.
LEVELS_AT_ONCE = 4
_PATH = "array<struct<l:binary,r:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hashed(digests: Column) -> Column:
    """32 bytes: the hash of an array of digests as hex text, end to end."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), "").cast("binary"), 256))


def leaf_digest(values: list[Column]) -> Column:
    """32 bytes: the hash of the values, each `-` if null, else its UTF-8 length, a colon and itself as text."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def grow(leaves: DataFrame, fanout: int = FANOUT) -> list[C.Written]:
    """The levels of all trees of (tree, pos, n, digest), the leaves first; n is how many nodes a tree has on a level.

    `fanout` consecutive nodes of a level become one of the next until a tree has one node left. A level
    holds only trees that have not ended below, and of each node the digests of its children.
    """
    levels = [C.Written(leaves.withColumn("children", F.lit(None).cast("array<binary>")))]
    most = levels[0].table.agg(F.max("n")).first()[0] or 0
    while most > 1:
        most = -(-most // fanout)
        below = levels[-1].table.where("n > 1")
        # children of a node lie side by side in the file, so most are joined before the shuffle
        up = below.groupBy("tree", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"))
        up = up.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "digest"))), lambda x: x["digest"]).alias("children"))
        levels.append(C.Written(up.select("tree", "pos", "n", _hashed(F.col("children")).alias("digest"), "children").sortWithinPartitions("tree", "pos")))
    return levels


def tops(levels: list[C.Written]) -> DataFrame:
    """(tree, digest) of the last node of each tree."""
    out = None
    for level in levels:
        ended = level.table.where("n = 1").select("tree", "digest")
        out = ended if out is None else out.union(ended)
    return out


def proofs(levels: list[C.Written], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, pos, path) of each leaf: for each level upwards the siblings to the left and right, then the path of the tree.

    above: (tree, above), the path that each tree's top goes on with. Both sides of a join are sorted
    by (tree, pos) and merged, each node once; a path has as many steps as there are levels. Every
    LEVELS_AT_ONCE levels the nodes met are written.
    """
    held, before = None, None
    for k in reversed(range(len(levels))):
        here = levels[k].table.where("n = 1").join(above, "tree").select("tree", "pos", F.col("above").alias("path"))
        if held is not None:
            met = levels[k + 1].table.select("tree", "pos", "children").join(held.hint("merge"), ["tree", "pos"])
            each = met.select("tree", "pos", "children", "path", F.posexplode("children").alias("i", "own"))
            sides = (("l", F.slice("children", 1, F.col("i"))), ("r", F.slice("children", F.col("i") + 2, F.lit(fanout))))
            step = F.array(F.struct(*[F.unhex(F.array_join(F.transform(part, _hex), "")).alias(n) for n, part in sides]))
            here = each.select("tree", (F.col("pos") * fanout + F.col("i")).alias("pos"), F.concat(step, "path").alias("path")).union(here)
        held = here
        if k and (len(levels) - k) % LEVELS_AT_ONCE == 0:
            written = C.Written(here)
            if before is not None:
                before.drop()
            before, held = written, written.table
    return held


def fold(leaf: Column, path: Column) -> Column:
    """Hex root that a leaf (hex) and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(_hex(x["l"]), acc, _hex(x["r"])).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    """Hex digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["l"]), _hex(x["r"]))), "").cast("binary"), 256)


class Manifest:
    """Node store of a table: a tree for each group of rows, and a tree over the groups.

    leaves: (row, id, grp, tree, pos, digest, other); groups: levels of the groups' trees;
    crown: levels over their tops, ordered by group; root: hex digest, or None for an empty table.
    """

    def __init__(self, leaves: C.Written, groups: list[C.Written], crown: list[C.Written], root: str | None, fanout: int):
        self.leaves, self.groups, self.crown, self.root, self.fanout = leaves, groups, crown, root, fanout

    def proven(self) -> DataFrame:
        """leaves with subroot (hex) and path, the siblings of each level up to the root."""
        whole = self.leaves.table.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.array().cast(_PATH).alias("above"))
        crown = proofs(self.crown, whole, self.fanout)
        above = crown.select(F.col("pos").alias("tree"), F.col("path").alias("above"))
        paths = proofs(self.groups, above, self.fanout)
        subroots = tops(self.groups).select("tree", _hex(F.col("digest")).alias("subroot"))
        return self.leaves.table.join(paths.hint("merge"), ["tree", "pos"]).join(subroots, "tree")


def build(docs: DataFrame, id_col: str, group_col: str, fields: list[str], other: Callable[[dict[str, Column]], Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table: leaves of `fields` in the order of the id within their group, groups in the order of their names.

    Nulls come first in both orders and are a value of their own; rows of one id are ordered by their
    digests, and rows that are equal in everything are leaves of their own, so any order of the rows gives
    the same root. Texts are hashed whole, whatever their length. Columns that aren't named are not
    read. other(fields): a second digest for each leaf, kept beside the first. An empty table has no root.
    """
    named = {c: F.col(f"`{c.replace('`', '``')}`") for c in [*fields, id_col, group_col]}
    rows = docs.select(
        named[id_col].alias("id"), named[group_col].cast("string").alias("grp"),
        leaf_digest([named[c] for c in fields]).alias("digest"), (other(named) if other else F.lit(None).cast("binary")).alias("other"),
    )
    hashed = C.Written(rows.withColumn("row", F.monotonically_increasing_id()))
    # the row number parts even equal rows, so a run never grows with its repeats
    runs = hashed.table.repartitionByRange("grp", "id", "digest", "row").sortWithinPartitions("grp", "id", "digest", "row")
    runs = C.Written(runs.withColumn("_at", F.monotonically_increasing_id()).withColumn("_run", F.shiftright("_at", 33)))
    hashed.drop()
    # a row for each run and group that meet: as many as runs and groups
    parts = runs.table.groupBy("grp", "_run").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("grp", "_run", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"))
    trees = numbered(parts.select("grp").distinct(), "grp").select(F.col("grp").alias("_g"), (F.col("number") - 1).alias("tree"))
    parts = parts.join(trees, F.col("grp").eqNullSafe(F.col("_g"))).withColumnsRenamed({"grp": "_grp", "_run": "_r"})
    placed = runs.table.join(parts, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("_run") == F.col("_r")))
    placed = placed.select("row", "id", "grp", "tree", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n", "digest", "other")
    leaves = C.Written(placed.sortWithinPartitions("tree", "pos"))
    runs.drop()
    groups = grow(leaves.table.select("tree", "pos", "n", "digest"), fanout)
    heads = C.Written(tops(groups))
    count = heads.table.count()
    crown = grow(heads.table.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest"), fanout)
    head = tops(crown).select(_hex(F.col("digest"))).first()
    return Manifest(leaves, groups, crown, head[0] if head else None, fanout)


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text") -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 2 divides the CRC-32 of the id as text, the text's line breaks are deleted before the leaf is
    hashed again (tampering); folded_root is what that leaf and the untampered siblings lead to, and
    verified whether it is the root. Rows without an id, without a text or without line breaks are as they
    were and verify. See build() for order, nulls, repeats and ties; an empty table gives no rows.
    """

    def tampered(named: dict[str, Column]) -> Column:
        hit = F.crc32(named[id_col].cast("string").cast("binary")) % 2 == 0
        text = F.when(hit, F.replace(named[text_col], F.lit("\n"), F.lit(""))).otherwise(named[text_col])
        # hashed again only where something changes
        changed = hit & F.contains(named[text_col], F.lit("\n"))
        return F.when(changed, leaf_digest([text if c == text_col else named[c] for c in fields]))

    manifest = build(docs, id_col, group_col, list(fields), tampered)
    root = F.lit(manifest.root)
    folded = fold(_hex(F.coalesce("other", "digest")), F.col("path"))
    out = manifest.proven().select(
        F.col("id").alias(id_col), _hex(F.col("digest")).alias("leaf"), "subroot", root.alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
