"""Near-duplicate detection by SimHash and multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``sum(radius + 1) - 1`` bits, then in some
segment they differ by no more than its radius. Every fingerprint therefore enters one table per segment under its own
key, and looks up all keys of a small Hamming ball; what meets under a key is verified over all bits. The links found
under a key are reported as a spanning forest, never as all pairs, and joined to components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm.common import shuffle_partitions

DISTANCE = 4
SHINGLE = 4
SEED = 42
# (first bit, bits, radius of the ball). With N fingerprints a key holds about N / 2^21 of them by chance; for corpora
# of far more than 10^8 documents, ((0, 32, 2), (32, 32, 1)) keeps that number small at 562 probes each.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
# Keys with more fingerprints than this are linked by the exact way of ``_dense``.
CROWDED = 20_000

_BITS = np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A number with the bits that are set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z only
    found = raw.split()  # bytes.split() parts at exactly the six ASCII spaces
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    reach = min(width, len(found)) - 1
    spans = zip(starts[: len(found) - reach].tolist(), stops[reach:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    return majority(hashes)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``tie`` (a hash of the text, null for null) and ``fingerprint`` (64 bits as a signed long)."""
    source = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "tie", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tie bigint, fingerprint bigint")


def check_segments(segments: tuple[tuple[int, int, int], ...], distance: int) -> None:
    """The segments must part all 64 bits and their radii must leave no pair out."""
    covered = [b for first, size, _ in segments for b in range(first, first + size)]
    if sorted(covered) != list(range(64)) or sum(r + 1 for *_, r in segments) <= distance:
        raise ValueError("segments must part 64 bits, with radii that add up to the distance")


def _flips(bits: int, radius: int) -> list[int]:
    """Masks of one to ``radius`` bits out of ``bits``."""
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]


def entries(distinct: DataFrame, segments=SEGMENTS) -> DataFrame:
    """Rows (segment, key, fingerprint, own): each fingerprint under its own keys and under those of its balls."""
    rows = []
    for number, (first, bits, radius) in enumerate(segments):
        key = F.shiftrightunsigned("fingerprint", first).bitwiseAND(F.lit((1 << bits) - 1))
        entry = lambda k, own: F.struct(F.lit(number).alias("segment"), k.alias("key"), F.lit(own).alias("own"))  # noqa: E731, B023
        rows.append(F.array(entry(key, True)))
        if radius:
            masks = F.array(*[F.lit(m).cast("long") for m in _flips(bits, radius)])
            rows.append(F.transform(masks, lambda m: entry(key.bitwiseXOR(m), False)))  # noqa: B023
    return distinct.select("fingerprint", F.explode(F.concat(*rows)).alias("e")).select("e.*", "fingerprint")


def _forest(own: np.ndarray, rest: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that share a key, as a star for each group of linked ones."""
    everyone = np.concatenate([own, rest])
    label = np.arange(len(everyone))
    for i in range(len(own)):
        near = np.bitwise_count(everyone ^ own[i]) <= distance
        names = np.unique(label[near])
        if len(names) > 1:
            label[np.isin(label, names)] = names[0]
    moved = label != np.arange(len(label))
    return everyone[label[moved]], everyone[moved]


def _linker(distance: int):
    """Reads rows sorted by (segment, key) and yields the links of each key."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        seg, key = rows["segment"].to_numpy(), rows["key"].to_numpy()
        own, value = rows["own"].to_numpy().astype(bool), rows["fingerprint"].to_numpy().view(np.uint64)
        new = np.r_[True, (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])] if len(seg) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(seg)])
        owners = np.add.reduceat(own.astype(np.int64), starts) if len(starts) else np.zeros(0, int)
        useful = (owners > 0) & (sizes > 1)
        a, b = [], []
        pairs = useful & (sizes == 2)
        first = starts[pairs]
        hit = first[np.bitwise_count(value[first] ^ value[first + 1]) <= distance]
        a.append(value[hit])
        b.append(value[hit + 1])
        for at, size in zip(starts[useful & (sizes > 2)], sizes[useful & (sizes > 2)]):
            part, mine = value[at : at + size], own[at : at + size]
            left, right = _forest(part[mine], part[~mine], distance)
            a.append(left)
            b.append(right)
        return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last key may go on in the next batch.
            same = (rows["segment"] == rows["segment"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
            cut = int((~same).sum())
            held = rows.iloc[cut:]
            if cut:
                yield links(rows.iloc[:cut])
        if held is not None and len(held):
            yield links(held)

    return run


def _dense(distinct: DataFrame, rows: DataFrame, crowded: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints that meet under a crowded key, without comparing them pair by pair.

    Two fingerprints differ in at most ``distance`` bits exactly if balls of half that radius around them share a point.
    Every ball is written out, a fixed number of points for each fingerprint, and linked to the smallest fingerprint
    that reaches the same point.
    """
    half = (distance + 1) // 2
    if 2 * half != distance:
        raise ValueError("the crowded way needs an even distance")
    members = rows.join(crowded, ["segment", "key"], "left_semi").select("fingerprint").distinct()
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in [0, *_flips(64, half)]])
    points = members.select("fingerprint", F.explode(F.transform(masks, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fingerprint").alias("a"), F.count("*").alias("n")).where("n > 1")
    return points.join(least, "point").where(F.col("a") != F.col("fingerprint")).select("a", F.col("fingerprint").alias("b"))


def links(distinct: DataFrame, distance: int = DISTANCE, segments=SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``distance`` bits that connect all that such pairs connect."""
    check_segments(segments, distance)
    rows = entries(distinct, segments)
    full = materialize(rows.where("own").groupBy("segment", "key").count().where(F.col("count") > crowded).select("segment", "key"), "crowded")
    any_full = full.head(1)
    # A key whose fingerprints are few is compared in its task, in order of the keys and one key at a time.
    sparse = rows.join(full, ["segment", "key"], "left_anti") if any_full else rows
    dealt = sparse.repartition(shuffle_partitions(distinct.sparkSession), "segment", "key").sortWithinPartitions("segment", "key")
    found = dealt.mapInPandas(_linker(distance), "a bigint, b bigint")
    if any_full:
        found = found.unionByName(_dense(distinct, rows, full, distance))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node of its component.

    Large and small star steps in turn: each links a node's neighbours to the smallest among them, so the number of
    edges does not grow; rounds end when the edges are stars, each node below one root and no root below another. A
    hub's edges are a streamed side of the join, which adaptive execution splits. Every round is a stored table.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct(), "edges")
    while not _is_stars(now):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = materialize(
            both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), "large-star"
        )
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        near = large.join(low, "b")
        small = near.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        now = materialize(small.distinct(), "small-star")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def _is_stars(edges: DataFrame) -> bool:
    """Whether every upper end of the edges (a < b) has one edge and is no lower end; the lower ends are then the roots."""
    lower = edges.select(F.col("a").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below"))
    upper = edges.select(F.col("b").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = lower.unionByName(upper).groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return ends.where("above > 1 OR (above = 1 AND below = 1)").isEmpty()


def classes(docs: DataFrame, distance: int = DISTANCE, segments=SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Every row's ``doc_id``, ``tie``, ``fingerprint`` (signed) and ``component_id``.

    Null text is empty; texts without words have fingerprint zero and are linked like any other. The component's id is
    its smallest doc_id, null only where no row of it has one. Copies are joined by fingerprint before any comparison.
    """
    stored = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(stored.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fingerprint"), distance, segments, crowded))
    named = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored.join(named.join(best, "root").select("fingerprint", "component_id"), "fingerprint")


def one_of_each(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of each component: its smallest doc_id; among rows of that id, the smallest text hash, once.

    The components are those of ``found``, a result of ``classes`` here or in ``near_copies``.

    A component none of whose rows has an id keeps the row of the smallest text hash. Decisions are made on the narrow
    table of fingerprints; texts move once, to meet them.
    """
    decided = (classes(docs) if found is None else found).select("doc_id", "tie", "fingerprint", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("tie").isNull().alias("no_tie"), F.col("tie").alias("tie"))
    group = F.when(F.col("component_id").isNull(), F.col("fingerprint"))
    chosen = decided.groupBy("component_id", group.alias("alone")).agg(F.min(place).alias("best")).select("best.*")
    chosen = chosen.select(F.col("no_id").alias("w_no_id"), F.coalesce("id", F.lit(0)).alias("w_id"), F.col("tie").alias("w_tie"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").isNull().alias("w_no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("w_id"),
        F.xxhash64("text").alias("w_tie"),
    )
    kept = rows.join(chosen, ["w_no_id", "w_id", "w_tie"], "left_semi")
    w = Window.partitionBy("w_no_id", "w_id", "w_tie").orderBy(F.xxhash64("row"))
    return kept.withColumn("w_place", F.row_number().over(w)).where("w_place = 1").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    found = classes(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
