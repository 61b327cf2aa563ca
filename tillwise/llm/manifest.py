"""Merkle manifest of a data set: a tree of hashes per language, and one over the trees.

H is the SHA-256 of its inputs, concatenated, in lowercase hex; digests go in as hex text.
A document's leaf is H of its doc_id, source, lang, n_chars and text, each `-` if null and
else its UTF-8 byte count, `:` and its value. The leaves of a language ascend by doc_id
(null first; rows with equal doc_ids by leaf). While a level has several nodes, each run of
FANOUT consecutive ones, the last perhaps shorter, becomes its H; the last node is the
language's subroot, a lone leaf being its own. The subroots, by language (null first, then
bytewise), make the root in the same way.

Slot pivot: conditional aggregates spread the children of a parent into FANOUT columns. The
columns concatenated and hashed are the parent; without its own column they are a child's
siblings. Levels are built upwards, each a table with a FANOUT-th of the rows; the pairs of
left and right siblings on the way to the root then go down the same tables, where a parent
unfolds into its children. So no row is joined with a whole level, and a language with any
share of all rows is spread over tasks by its places.

Every leaf is proved: its `proof_sha256` is H of all siblings from its run up to the root,
and `folded_root` is the root recomputed from the siblings and the leaf as delivered. What is
delivered may differ from what was listed: `tampered` gives the text of the delivered copy.

Nulls are values of their own in any column; empty texts are values of no bytes. Equal rows
have equal leaves at neighbouring places and a proof each. Texts of any length are hashed
once, and once more where tampered. Columns other than the five are not looked at. An empty
table has no rows and no root. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.ranks import ranked, row_number
from tillwise.llm.staging import Stages

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIBLINGS = "array<struct<left: string, right: string>>"


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return hashed(*(field(text if name == "text" else F.col(name)) for name in FIELDS))


def lowered(doc_id: Column, text: Column) -> Column:
    """The check's damage: A-Z become a-z where 3 divides the CRC-32 of the id's digits; a
    document without an id stays."""
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


SLOTS = [f"slot{k}" for k in range(FANOUT)]


def _raised(nodes: DataFrame, child: str, digest: str) -> DataFrame:
    """The parents of nodes(tree, pos, n): `child` of each child in its slot's column, and
    the hash of the children's digests. A lone node is no one's child, but its own parent.
    The wide expressions are SQL text, one call each to the driver's JVM."""
    spread = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("pos"), F.col("n").alias("kids")).agg(
        *(F.expr(f"max(CASE WHEN pos % {FANOUT} = {k} THEN {child} END) AS {slot}") for k, slot in enumerate(SLOTS))
    )
    digests = [slot + digest for slot in SLOTS]
    return spread.selectExpr(
        "*",
        f"(kids + {FANOUT - 1}) div {FANOUT} AS n",
        f"CASE WHEN kids = 1 THEN {digests[0]} ELSE sha2(concat_ws('', {', '.join(digests)}), 256) END AS node",
    )


def _unfolded(parents: DataFrame, digest: str, *more: str) -> DataFrame:
    """A row for each child of parents(slots.., path): its place, what its slot holds, and
    its path: the siblings on both sides, then its parent's path."""
    digests = [slot + digest for slot in SLOTS]

    def kid(k: int) -> str:
        left, right = (f"concat_ws('', {', '.join(side)})" if side else "''" for side in (digests[:k], digests[k + 1 :]))
        return f"struct(pos * {FANOUT} + {k} AS pos, {SLOTS[k]} AS child, struct({left} AS left, {right} AS right) AS sides)"

    kids = f"inline(filter(array({', '.join(map(kid, range(FANOUT)))}), x -> x.child IS NOT NULL)) AS (pos, child, sides)"
    unfolded = parents.withColumnRenamed("path", "above").selectExpr("tree", "kids", "above", *more, kids)
    path = "CASE WHEN kids = 1 THEN above ELSE concat(array(sides), above) END AS path"
    return unfolded.selectExpr("tree", "pos", "child", path, *more)


class Tree:
    """The levels above nodes(tree, pos, n, ...), each a written table."""

    def __init__(self, stages: Stages, name: str, nodes: DataFrame, child: str, digest: str) -> None:
        self.digest = digest
        most = nodes.agg(F.max("n")).first()[0] or 0
        self.levels = [stages.write(_raised(nodes, child, digest), f"{name}-1")]
        while most > FANOUT:
            most = -(-most // FANOUT)
            below = self.levels[-1].where("n > 1")
            self.levels.append(stages.write(_raised(below, "node", ""), f"{name}-{len(self.levels) + 1}"))

    def tops(self) -> DataFrame:
        """(tree, node): the one node that each tree comes to."""
        tops = [level.where("n = 1").select("tree", "node") for level in self.levels]
        out = tops[0]
        for top in tops[1:]:
            out = out.unionByName(top)
        return out

    def leaves(self, above: DataFrame, *more: str) -> DataFrame:
        """The lowest nodes with their paths, where above(tree, path, ...) are those of the
        trees' tops. Columns `more` of a top go down to all its leaves."""
        down = None
        for k, level in reversed(list(enumerate(self.levels))):
            paths = level.where("n = 1").select("tree", "pos").join(above, "tree").select("tree", "pos", "path", *more)
            if down is not None:
                paths = paths.unionByName(down)
            parents = level.drop("n", "node").join(paths, ["tree", "pos"])
            down = _unfolded(parents, "" if k else self.digest, *more)
            if k:
                down = down.drop("child")
        return down


def proved(docs: DataFrame, tampered=lowered) -> DataFrame:
    """A row per document: leaf, subroot, root, the digest of its proof, the root folded
    from the delivered text and whether that is the root."""
    stages = Stages(docs.sparkSession, "manifest")
    docs = docs.select(*FIELDS)
    delivered = tampered(F.col("doc_id"), F.col("text"))
    same = delivered.eqNullSafe(F.col("text"))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"),
        leaf(F.col("text")).alias("leaf"),
        F.when(~same, leaf(delivered)).alias("delivered"),
    )
    rows = stages.write(row_number(rows), "rows")
    placed = stages.write(ranked(stages, "leaves", rows, "tree", ["doc_id", "leaf", "row"]).drop("row"), "placed")
    trees = Tree(stages, "tree", placed, "struct(leaf, doc_id, delivered)", ".leaf")

    # "-", the tree of null, is below "=" and whatever follows it
    tops = trees.tops().select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "node")
    tops = ranked(stages, "tops", tops, "tree", ["lang"])
    forest = Tree(stages, "forest", tops, "struct(node AS leaf, lang)", ".leaf")
    root = forest.tops().select("tree", F.col("node").alias("root"), F.array().cast(SIBLINGS).alias("path"))
    subroots = forest.leaves(root, "root").select(
        F.col("child.lang").alias("tree"), F.col("child.leaf").alias("subroot"), "root", "path"
    )
    subroots = stages.write(subroots, "subroots")

    leaves = trees.leaves(subroots, "subroot", "root")
    sent = F.coalesce(F.col("child.delivered"), F.col("child.leaf"))
    folded = F.aggregate("path", sent, lambda below, at: hashed(at["left"], below, at["right"]))
    siblings = F.transform("path", lambda at: F.concat(at["left"], at["right"]))
    out = leaves.select(
        F.col("child.doc_id").alias("doc_id"),
        F.col("child.leaf").alias("leaf"),
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
