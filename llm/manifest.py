"""Merkle manifest of a dataset, folded through copied SHA-256 states.

Every document is a leaf, the leaves of a group (a language) are ordered by id, and ``FAN`` consecutive nodes become their
parent. A parent copies its hash state before each child slot. To recompute a root with one child replaced, the
state before that child is resumed and takes the replacement and the right siblings only; the left ones are in the state.

Trees are built by Spark in rounds: ``FAN`` ** ``LEVELS`` consecutive nodes of a group are one task's block, which yields one
node for the next round, so that a group of any size is spread over many tasks. Paths go down the same rounds: a block
receives the path of its own top node, a few kilobytes, and folds all its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm.common import running

FAN = 8
LEVELS = 5
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = ""


class Parent:
    """A node over up to ``FAN`` children, given as hex digests one after the other."""

    def __init__(self, children: bytes) -> None:
        self.children = children
        state = hashlib.sha256()
        self.states = []
        for at in range(0, len(children), HEX):
            self.states.append(state.copy())
            state.update(children[at : at + HEX])
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``, from the state before it."""
        state = self.states[slot].copy()
        state.update(replacement)
        state.update(self.children[HEX * (slot + 1) :])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return self.children[: HEX * slot] + self.children[HEX * (slot + 1) :]


class Step:
    """A parent above a block, of which the block's own node is one child: left and right siblings are enough."""

    def __init__(self, left: bytes, right: bytes) -> None:
        self.siblings = left + right
        self.state, self.right = hashlib.sha256(left), right

    def fold(self, replacement: bytes) -> bytes:
        state = self.state.copy()
        state.update(replacement)
        state.update(self.right)
        return state.hexdigest().encode()


def block_levels(nodes: Sequence[bytes], total: int, levels: int = LEVELS) -> list[list[Parent]]:
    """Up to ``levels`` levels above a block of a tree of ``total`` nodes; a short last block climbs as high as the full ones."""
    found: list[list[Parent]] = []
    while FAN ** len(found) < total and len(found) < levels:
        found.append([Parent(b"".join(nodes[i : i + FAN])) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in found[-1]]
    return found


def leaf_hash(text: Column | None = None) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or as a dash where null. ``text`` replaces the text."""
    values = {f: F.col(f).cast("string") for f in FIELDS} | ({} if text is None else {"text": text})
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(text, capitals, capitals.lower())


def leaves(docs: DataFrame, replaced: Column | None = None) -> DataFrame:
    """doc_id, tree, leaf, replacement and the leaf's place in its tree.

    Trees are named so that their order is null first, then the languages bytewise. ``replaced`` is the text a document
    has at verification, by default its own. Null ids come last; rows of equal id are ordered by their leaves.
    """
    hashed = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"),
        leaf_hash().alias("leaf"),
        leaf_hash(F.col("text") if replaced is None else replaced).alias("replacement"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("leaf").asc(), F.col("replacement").asc()]
    return running(materialize(hashed, "leaves"), ["tree"], order, name="place")


def block(levels: int) -> Column:
    return F.expr(f"place DIV {FAN**levels}").alias("block")


@dataclass(frozen=True)
class Forest:
    """Rounds of stored nodes (tree, place, hash, total): the first has the leaves, the last one node for each tree."""

    rounds: tuple[DataFrame, ...]
    levels: int = LEVELS


def build(first: DataFrame, levels: int = LEVELS) -> Forest:
    """``first`` has (tree, place, hash), places from 0 without gaps in each tree."""
    totals = first.groupBy("tree").agg((F.max("place") + 1).alias("total"))
    rounds = [materialize(first.select("tree", "place", "hash").join(totals, "tree"), "nodes")]

    span = FAN**levels

    def climb(nodes: pd.DataFrame) -> pd.DataFrame:
        rows = nodes.sort_values("place")
        found = block_levels([h.encode() for h in rows["hash"]], int(rows["total"].iloc[0]), levels)
        top = found[-1][0].digest.decode() if found else rows["hash"].iloc[0]
        place, total = int(rows["place"].iloc[0]) // span, -(-int(rows["total"].iloc[0]) // span)
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "place": [place], "hash": [top], "total": [total]})

    while not rounds[-1].where("total > 1").isEmpty():
        grouped = rounds[-1].groupBy("tree", block(levels))
        rounds.append(materialize(grouped.applyInPandas(climb, "tree string, place bigint, hash string, total bigint"), "nodes"))
    return Forest(tuple(rounds), levels)


def _steps(levels: list[list[Parent]], at: int) -> list[tuple[bytes, bytes]]:
    """Left and right siblings from a block's node up to the block's top."""
    found = []
    for level in levels:
        parent, slot = level[at // FAN], at % FAN
        found.append((parent.children[: HEX * slot], parent.children[HEX * (slot + 1) :]))
        at //= FAN
    return found


PATH = "path array<struct<left:string,right:string>>"


def paths(forest: Forest, top: DataFrame, first: int = 1) -> DataFrame:
    """(tree, place, path) of the nodes of a round, by default the second; ``top`` has the paths (tree, path) above the last round's."""
    now = top.select("tree", F.lit(0).cast("long").alias("place"), "path")
    levels = forest.levels

    def down(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = nodes.sort_values("place")
        found = block_levels([h.encode() for h in rows["hash"]], int(rows["total"].iloc[0]), levels)
        upper = list(above["path"].iloc[0])
        own = [[{"left": a.decode(), "right": b.decode()} for a, b in _steps(found, i)] + upper for i in range(len(rows))]
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "place": rows["place"].to_numpy(), "path": own})

    for nodes in reversed(forest.rounds[first:-1]):
        given = now.withColumnRenamed("place", "block").groupBy("tree", "block")
        now = materialize(nodes.groupBy("tree", block(levels)).cogroup(given).applyInPandas(down, f"tree string, place bigint, {PATH}"), "paths")
    return now


def _upper_paths(top: Forest, subroots: DataFrame) -> DataFrame:
    """(tree, subroot, path, root) of each tree, ``subroots``, in the tree of trees."""
    root = top.rounds[-1].select("tree", F.col("hash").alias("root"))
    whole = root.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = paths(top, whole, 0).join(root, "tree").select("place", "path", "root")
    return subroots.select("tree", "place", F.col("hash").alias("subroot")).join(above, "place").drop("place")


def verify(docs: DataFrame, replaced: Column | None = None, span: int = LEVELS) -> DataFrame:
    """Every document's leaf, subroot, root and proof digest, and the root folded with its present text.

    The manifest is built over ``docs`` as they are; ``replaced`` is the text at verification; a block has ``span`` levels. Null fields are dashes, an
    empty text has zero bytes, repeated rows are leaves of their own with equal hashes, texts of any length are hashed within
    the scan, other columns are ignored. An empty table has no rows.
    """
    placed = materialize(leaves(docs, replaced), "placed-leaves")
    forest = build(placed.select("tree", "place", F.col("leaf").alias("hash")), span)
    subroots = materialize(running(forest.rounds[-1].select("tree", "hash"), [], [F.col("tree").asc()], name="place"), "subroots")
    top = build(subroots.select(F.lit(TOP).alias("tree"), "place", "hash"), span)
    upper = materialize(_upper_paths(top, subroots), "upper-paths")
    above = paths(forest, upper.select("tree", "path")) if len(forest.rounds) > 1 else upper.select("tree", F.lit(0).cast("long").alias("place"), "path")
    kind = dict(docs.dtypes)["doc_id"]

    def fold(nodes: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        rows = nodes.sort_values("place")
        levels = block_levels([h.encode() for h in rows["leaf"]], int(rows["total"].iloc[0]), span)
        steps = [Step(s["left"].encode(), s["right"].encode()) for s in given["path"].iloc[0]]
        rest = b"".join(s.siblings for s in steps)
        # What a proof holds above each level, for the children of one parent.
        tails: list[list[bytes]] = [[rest]]
        for level in reversed(levels[1:]):
            size = len(levels[len(levels) - len(tails) - 1])
            tails.append([level[i // FAN].siblings(i % FAN) + tails[-1][i // FAN] for i in range(size)])
        roots, proofs = [], []
        for i, value in enumerate(rows["replacement"]):
            now, at = value.encode(), i
            for level in levels:
                now = level[at // FAN].fold(at % FAN, now)
                at //= FAN
            roots.append(reduce(lambda v, s: s.fold(v), steps, now).decode())
            proof = levels[0][i // FAN].siblings(i % FAN) + tails[-1][i // FAN] if levels else rest
            proofs.append(hashlib.sha256(proof).hexdigest())
        return pd.DataFrame({"doc_id": rows["doc_id"], "tree": rows["tree"], "leaf": rows["leaf"], "proof_sha256": proofs, "folded_root": roots})

    totals = forest.rounds[0].select("tree", "total").distinct()
    blocks = placed.join(totals, "tree").groupBy("tree", block(span))
    folded = blocks.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInPandas(
        fold, f"doc_id {kind}, tree string, leaf string, proof_sha256 string, folded_root string"
    )
    named = folded.join(upper.select("tree", "subroot", "root"), "tree")
    return named.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def tampered(docs: DataFrame, part: int = 3) -> Column:
    """The text in lower case for one document of ``part``, by its id's CRC; rows without id keep their text."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % part == 0
    return F.when(F.coalesce(hit, F.lit(False)), lowered(F.col("text"))).otherwise(F.col("text"))
