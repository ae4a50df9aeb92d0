"""Near copies by SimHash, checked by the exact Jaccard similarity of their sets of word shingles, and a join with prefix filter.

Sets whose SimHash fingerprints are linked meet first, and what is similar there is joined. At a similarity of 0.8 most fingerprints
differ in more bits than any index can look up, so the join finds the rest:

Let all shingles have one order. Two sets of similarity t or more share one of the first n - ceil(t n) + 1 shingles of each,
so only these are looked up, and no pair is missed. The order is that of the shingles' hashes; it needs no counts.

A shingle that many texts have (a licence, a template) is no good key. Its texts are compared with the smallest of them, and
those that are not connected then are looked up anew in another order, rare shingles first, which are counted among
them alone. A text with fewer rare shingles than its prefix has may also match through frequent ones only. Then both sets of frequent
shingles differ in few places, at most what the similarity allows less the rare ones, and when all shingles are dealt into
more buckets than that, the sets agree in a bucket: its content is a key. So texts of one template meet only where they are
alike in a bucket, not under each shingle of the template.

Pairs under a key are first those with its smallest text, then those of texts not connected yet. What meets is compared by
the prefixes, which bound the similarity from above, then by the whole sets; no pair is compared twice. Before that, 256
parity bits of each set rule out pairs that differ in more shingles than the similarity allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowguard.session import BROADCAST_ROWS, materialize
from llm.common import shuffle_partitions
from llm.simhash import SEED, components, links, majority

WIDTH = 5
SIMILARITY = 0.8
# More texts than this make a shingle frequent.
FREQUENT = 32
PARITIES = ["parity_0", "parity_1", "parity_2", "parity_3"]
# Up to this sum of levels, keys are pairs of buckets.
PAIRED = 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, in lower case; a text of fewer words is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = memoryview(b" ".join(found))
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    reach = min(width, len(found)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(found) - reach].tolist(), stops[reach:].tolist())
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))


def least_common(m: np.ndarray | int, n: np.ndarray | int, similarity: float):
    """How many shingles sets of these sizes share at least at the similarity."""
    return np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9).astype(np.int64)


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def parities(values: np.ndarray) -> np.ndarray:
    """Four numbers of 64 bits: a bit is set where an odd number of the shingles falls on it.

    Sets differ in at least as many shingles as these bits differ, which bounds their similarity from above.
    """
    counts = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=256)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def nodes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``tie`` (hash of the text) and ``node`` (hash of the set of shingles) with its size, SimHash and parities, for every row."""
    source = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t.as_py(), width) for t in batch.column(2)]
                node = np.array([xxhash.xxh64_intdigest(v.tobytes(), SEED) for v in found], dtype=np.uint64).view(np.int64)
                size = pa.array([len(v) for v in found], pa.int32())
                bits = np.array([parities(v) for v in found], dtype=np.int64).reshape(-1, 4)
                prints = pa.array(np.array([majority(v) for v in found], dtype=np.uint64).view(np.int64))
                columns = [batch.column(0), batch.column(1), pa.array(node), size, prints, *(pa.array(bits[:, i].copy()) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "node", "size", "fingerprint", *PARITIES])

    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, tie bigint, node bigint, size int, fingerprint bigint, {', '.join(f'{p} bigint' for p in PARITIES)}")


def sets(docs: DataFrame, wanted: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], repeated: bool = True) -> DataFrame:
    """(node, size, values): ``part`` of the sets of the nodes ``wanted`` (node, doc_id, tie), made again from their texts.

    The wanted rows are counted; only few of them are broadcast, beyond that texts are shuffled to them. ``repeated`` tells whether
    an id may have the same text in several rows.
    """
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = wanted.select("node", F.col("doc_id").alias("w_id"), F.col("tie").alias("w_tie"))
    source = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tie") == F.col("w_tie"))
    met = source.join(F.broadcast(named) if small else named, same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [shingles(t.as_py(), width) for t in batch.column(1)]
                values = pa.array([part(v).view(np.int64) for v in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in found], pa.int32()), values], names=["node", "size", "values"])

    rows = met.mapInArrow(run, "node bigint, size int, values array<bigint>")
    if not repeated:
        return rows
    return rows.groupBy("node").agg(F.first("size").alias("size"), F.first("values").alias("values"))


def _parts(column: pa.ListArray) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b].view(np.uint64) for a, b in zip(offsets, offsets[1:])]


def _possible(similarity: float):
    """Keeps the pairs whose prefixes leave the similarity possible. Below the lesser of their last hashes both sets are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(_parts(batch.column(4)), _parts(batch.column(5)))):
                reach = min(x[-1], y[-1])
                x, y = x[: np.searchsorted(x, reach, side="right")], y[: np.searchsorted(y, reach, side="right")]
                most = len(np.intersect1d(x, y, assume_unique=True)) + min(m[i] - len(x), n[i] - len(y))
                good[i] = most >= least_common(m[i], n[i], similarity)
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = zip(_parts(batch.column(2)), _parts(batch.column(3)))
                common = [(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y)) for x, y in found]
                kept = pa.array([c >= least_common(total, 0, similarity) for c, total in common], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    return run


def discard(stored: DataFrame) -> None:
    """Deletes a stored table of a round whose result is stored itself, so rounds do not add up on disk."""
    spark = stored.sparkSession
    for uri in stored.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Join:
    """The similarity join of one table; ``edges`` grows, and ``tried`` holds the pairs that were compared."""

    def __init__(self, docs: DataFrame, width: int, similarity: float, frequent: int) -> None:
        self.docs, self.width, self.similarity, self.frequent = docs, width, similarity, frequent
        self.spark = docs.sparkSession
        self.rows = materialize(nodes(docs, width), "shingle-sets")
        self.repeated = not self.rows.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()
        best = F.min(F.struct("doc_id", "tie")).alias("best")
        equal = (F.first(c).alias(c) for c in ("size", "fingerprint", *PARITIES))
        self.distinct = materialize(
            self.rows.groupBy("node").agg(best, F.min("doc_id").alias("least"), *equal).select("node", "best.*", "least", "size", "fingerprint", *PARITIES), "distinct-sets"
        )
        limit = similarity
        self.prefixes = materialize(sets(docs, self.distinct.where("size > 0"), width, lambda v: v[: prefix_length(len(v), limit)], self.repeated), "prefixes")
        self.tried: DataFrame | None = None
        self.edges: DataFrame | None = None
        self._roots: DataFrame | None = None

    def roots(self) -> DataFrame:
        """Stored (node, root) of the components so far; made again only after new edges."""
        if self._roots is None:
            self._roots = materialize(components(self.edges), "roots")
        return self._roots

    def compare(self, pairs: DataFrame) -> bool:
        """Adds the similar ones of the pairs (a < b) to ``edges``; tells whether there are any."""
        new = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            new = new.join(self.tried, ["a", "b"], "left_anti")
        new = materialize(new, "pairs")
        side = lambda n, k, v: self.prefixes.select(F.col("node").alias(n), F.col("size").alias(k), F.col("values").alias(v))
        met = new.join(side("b", "n", "right"), "b").join(side("a", "m", "left"), "a")
        met = met.where(F.least("m", "n") >= F.lit(self.similarity) * F.greatest("m", "n") - 1e-9).select("a", "b", "m", "n", "left", "right")
        likely = materialize(met.mapInArrow(_possible(self.similarity), "a bigint, b bigint"), "likely-pairs")
        needed = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        whole = materialize(sets(self.docs, self.distinct.join(needed, "node"), self.width, lambda v: v, self.repeated), "compared-sets")
        both = likely.join(whole.select(F.col("node").alias("b"), F.col("values").alias("right")), "b")
        both = both.join(whole.select(F.col("node").alias("a"), F.col("values").alias("left")), "a").select("a", "b", "left", "right")
        found = materialize(both.mapInArrow(_similar(self.similarity), "a bigint, b bigint"), "links")
        discard(whole)
        discard(likely)
        self.tried = new if self.tried is None else self.tried.unionByName(new)
        if self.edges is not None and found.isEmpty():
            return False
        self.edges = found if self.edges is None else self.edges.unionByName(found)
        self._roots = None
        return True

    def alike(self) -> DataFrame:
        """Pairs (a, b) of every set with the least of its class of linked SimHash fingerprints."""
        given = self.distinct.where("size > 0").select("node", "fingerprint")
        prints = materialize(given.select("fingerprint").distinct(), "fingerprints")
        roots = components(links(prints)).select(F.col("node").alias("fingerprint"), "root")
        named = given.join(roots, "fingerprint", "left").select(F.coalesce("root", "fingerprint").alias("root"), F.col("node").alias("b"))
        return named.join(named.groupBy("root").agg(F.min("b").alias("a")), "root").where("a <> b").select("a", "b")

    def open_keys(self, met: DataFrame) -> DataFrame:
        """(key, root, node, own, size, place, parities) of the keys under which several components meet."""
        named = met.join(self.roots(), "node", "left").select("key", F.coalesce("root", "node").alias("root"), "node", "own", "size", "place")
        ends = Window.partitionBy("key")
        several = named.withColumns({"first": F.min("root").over(ends), "last": F.max("root").over(ends)})
        return several.where("first <> last").drop("first", "last").join(self.distinct.select("node", *PARITIES), "node").select("key", "root", "node", "own", "size", "place", *PARITIES)

    def connect(self, met: DataFrame) -> None:
        """Compares what meets under the keys of ``met`` (key, node, own, size, place), until the texts under a key are connected or all compared.

        A pair counts where at least one of the two is at a key of its own.
        """
        self.compare(stars(met, self.similarity))
        most, linked, left = self.frequent, True, None
        while True:
            if linked:
                if left is not None:
                    discard(left)
                left = materialize(self.open_keys(met), "open-keys")
                widest = left.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
            if widest is None:
                return
            dealt = left.repartition(shuffle_partitions(self.spark), "key").sortWithinPartitions("key", "root", "node")
            linked = self.compare(dealt.mapInPandas(_partners(most, self.similarity), "a bigint, b bigint"))
            if widest <= most:
                return
            most *= 16


def stars(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs of every node of a key with the least that is there of its own, where size and place allow it."""
    least = F.min(F.when(F.col("own"), F.struct("node", "size", "place"))).over(Window.partitionBy("key"))
    pairs = met.withColumn("a", least).where(F.col("a.node") != F.col("node"))
    share = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a.size") + F.col("size")) - 1e-9)
    long_enough = F.least("a.size", "size") >= F.lit(similarity) * F.greatest("a.size", "size") - 1e-9
    in_reach = F.least(F.col("a.size") - F.col("a.place"), F.col("size") - F.col("place")) >= share
    return pairs.where(long_enough & in_reach).select(F.col("a.node").alias("a"), F.col("node").alias("b"))


def _partners(most: int, similarity: float):
    """Reads rows (key, root, node, own, size, place, parities) sorted by key and root; pairs every own node with up to ``most`` nodes of other roots.

    Pairs of too different sizes or parities are left out, and those too few of whose shingles come after the key: if they
    are similar, they meet under an earlier key too.
    """

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        key, root, node, own = (rows[c].to_numpy() for c in ("key", "root", "node", "own"))
        sizes, left = rows["size"].to_numpy(), (rows["size"] - rows["place"]).to_numpy()
        bits = rows[PARITIES].to_numpy().view(np.uint64)  # numpy counts the bits of a signed number's absolute value
        every = np.arange(len(rows))

        def runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First row and number of rows of the run that each row is in."""
            starts = np.flatnonzero(np.r_[True, new])
            counts = np.diff(np.r_[starts, len(rows)])
            return np.repeat(starts, counts), np.repeat(counts, counts)

        new_key = key[1:] != key[:-1]
        start, n = runs(new_key)
        first, same = runs(new_key | (root[1:] != root[:-1]))
        after, others = first + same - start, n - same
        times = np.where(own.astype(bool), np.minimum(others, most), 0)
        who = np.repeat(every, times)
        step = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
        # Nodes of one root start at different partners.
        turn = (every - first) % np.maximum(others, 1)
        to = start[who] + (after[who] + (turn[who] + step) % np.maximum(others[who], 1)) % n[who]
        m, k = sizes[who], sizes[to]
        fits = (np.minimum(m, k) >= similarity * np.maximum(m, k) - 1e-9) & (np.minimum(left[who], left[to]) >= least_common(m, k, similarity))
        who, to, m, k = who[fits], to[fits], m[fits], k[fits]
        fits = np.bitwise_count(bits[who] ^ bits[to]).sum(axis=1) <= m + k - 2 * least_common(m, k, similarity)
        x, y = node[who[fits]], node[to[fits]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last key may go on in the next batch.
            cut = int((rows["key"] != rows["key"].iloc[-1]).sum()) if len(rows) else 0
            held = rows.iloc[cut:]
            if cut:
                yield pairs(rows.iloc[:cut])
        if held is not None and len(held):
            yield pairs(held)

    return run


def levels(most: float) -> list[int]:
    """0, 1, 2, 3, 4, 6, 8, 12, 16 ... up to the first that is not below ``most``."""
    found = [0, 1]
    while found[-1] < most:
        found.append(found[-2] * 2 if found[-1] > 2 else found[-1] + 1)
    return found


def bucket_keys(values: np.ndarray, size: int, rare: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the frequent shingles ``values`` of a set of ``size`` shingles, of which ``rare`` are not frequent; which are its own.

    Without common rare shingles, two sets differ in at most g + g' frequent ones, where g is the size times (1 - t) / (1 + t)
    less ``rare``. A set's level is the least not below its g. For each level that a partner can have, its shingles are dealt
    into more buckets than the two levels add up to. Keys are its own where the partner's level is not above.
    """
    share = (1 - similarity) / (1 + similarity)
    grid = levels(size / similarity * share)
    level = next(x for x in grid if x >= size * share - rare)
    mixed = values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    found, own = [], []
    for other in grid:
        # One bucket more than the sets must agree in leaves two that agree: few buckets are keys in pairs, many one by one.
        pairs = level + other < PAIRED
        buckets = level + other + (2 if pairs else 1)
        place = mixed % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64))
        raw, name = values[order], max(level, other) << 40 | min(level, other) << 20
        digests = [xxhash.xxh64_intdigest(raw[a:b].tobytes(), name + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        if pairs:
            digests = [xxhash.xxh64_intdigest(np.array(d, dtype=np.uint64).tobytes(), name) for d in combinations(digests, 2)]
        found += digests
        own += [level >= other] * len(digests)
    return np.array(found, dtype=np.uint64), np.array(own)


def rare_first(join: Join, among: DataFrame) -> DataFrame:
    """Stored keys (key, node, own, size, place) of the texts ``among`` (node, doc_id, tie), rare shingles first; see the head of this module."""
    whole = sets(join.docs, among, join.width, lambda v: v, join.repeated)
    long = whole.select("node", F.explode("values").alias("key"))
    n = F.col("n")
    counted = long.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    # Shingles that no other set has are only counted: they come first in the order and match nothing.
    table = counted.groupBy("node").agg(
        F.count("*").cast("int").alias("size"),
        F.count_if(n == 1).cast("int").alias("alone"),
        F.sort_array(F.collect_list(F.when((n > 1) & (n <= join.frequent), F.col("key")))).alias("shared"),
        F.sort_array(F.collect_list(F.when(n > join.frequent, F.col("key")))).alias("often"),
    )
    similarity = join.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, size, alone = (batch.column(i).to_numpy() for i in range(3))
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for i, (shared, often) in enumerate(zip(_parts(batch.column(3)), _parts(batch.column(4)))):
                reach, rare = prefix_length(int(size[i]), similarity), int(alone[i]) + len(shared)
                kept = shared[: max(reach - int(alone[i]), 0)]
                place = int(alone[i]) + np.arange(len(kept))
                found, own = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
                if rare < reach:
                    found, own = bucket_keys(np.sort(often), int(size[i]), rare, similarity)
                n = len(place) + len(found)
                new = (np.r_[kept, found], np.full(n, node[i]), np.r_[np.ones(len(place), dtype=bool), own], np.full(n, size[i]), np.r_[place, np.zeros(len(found), dtype=place.dtype)])
                for column, part in zip(columns, new):
                    column.append(part)
            key, *rest = map(np.concatenate, columns)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint64).view(np.int64)), *map(pa.array, rest[:2]), *(pa.array(c.astype(np.int32)) for c in rest[2:])], names=["key", "node", "own", "size", "place"])

    met = table.mapInArrow(run, "key bigint, node bigint, own boolean, size int, place int")
    ends = Window.partitionBy("key")
    useful = met.withColumns({"n": F.count("*").over(ends), "owners": F.max("own").over(ends)}).where("n > 1 AND owners")
    return materialize(useful.drop("n", "owners"), "shared-keys")


def classes(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """Every row's ``doc_id``, ``tie``, ``fingerprint`` (one number for each component) and ``component_id``, as ``simhash.classes``.

    A component joins what chains of pairs of at least the similarity connect; its id is its smallest doc_id, null only where no
    row of it has one. Null and blank texts are one component. Rows of one set of shingles, repeated rows among them, are
    joined before any comparison. Texts of any length are read whole, other columns are ignored, an empty table has no rows.
    """
    join = Join(docs, width, similarity, frequent)
    join.compare(join.alike())
    keys = join.prefixes.select("node", "size", F.lit(True).alias("own"), F.posexplode("values").alias("place", "key"))
    met = materialize(keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "shared-keys")
    join.connect(met.where(F.col("n") <= frequent).drop("n"))
    often = met.where(F.col("n") > frequent).drop("n")
    join.compare(stars(often, similarity))
    left = join.open_keys(often).select("node").distinct()
    among = materialize(join.distinct.join(left, "node"), "open-nodes")
    if not among.isEmpty():
        join.connect(rare_first(join, among))
    tree = join.distinct.join(join.roots(), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    best = tree.groupBy("root").agg(F.min("least").alias("component_id"))
    return join.rows.select("doc_id", "tie", "node").join(
        tree.join(best, "root").select("node", F.col("root").alias("fingerprint"), "component_id"), "node"
    ).drop("node")
