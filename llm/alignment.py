"""Alignment of two tokenizers over the bytes of a text, by fragments that compose.

Two streams of tokens cover the same bytes. Where tokens of both end, a group closes. A byte range yields a fragment: the
open prefix up to the first such common end, the closed groups, and the open suffix after the last. Fragments of
neighbouring ranges compose: suffix and prefix in between become one group. Composition is associative, so the ranges of
a very long text are read by different tasks and joined in a tree.

A range's tokens are those that end in it. To find them, the text is read from the last safe cut before the range to the
first one after it. A safe cut is a space between two printing ASCII characters, at which neither tokenizer ever merges.

Pairs of ids are counted over the corpus. Documents are kept in blocks with one dictionary of pairs each, so a count
travels once to a block instead of once to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm import packing
from llm.common import shuffle_partitions

CHUNK = 1 << 16
FAN = 8
# A block of documents ends at these numbers of rows or links.
BLOCK_ROWS, BLOCK_LINKS = 2048, 1 << 18

Ids = tuple[np.ndarray, np.ndarray]
NO_IDS = np.zeros(0, dtype=np.int64)


class Readers:
    """Both tokenizers: ids of a byte string that begins with a space, bytes and spelling of every id."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = packing.tokenizer(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_tokens = []
        for i in range(len(self.b)):
            piece = self.b.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"a piece reaches over a space, so that no cut is safe: {b_path}")
            b_tokens.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.tokens = (dict(self.a.tokens), dict(enumerate(b_tokens)))
        self.sizes, self.inner, self.last = [], [], []
        for tokens, end in zip(self.tokens, "|;"):
            size = np.zeros(max(tokens) + 1, dtype=np.int64)
            size[list(tokens)] = [len(t) for t in tokens.values()]
            self.sizes.append(size)
            self.inner.append(np.array([f"{i}," for i in range(len(size))], dtype=object))
            self.last.append(np.array([f"{i}{end}" for i in range(len(size))], dtype=object))

    def read(self, part: bytes) -> Ids | None:
        """Ids of both, or None if either does not give the bytes back."""
        a = np.frombuffer(self.a.ordinary(part.decode()), dtype="<u4").astype(np.int64)
        b = np.array(self.b.encode(part[1:].decode()), dtype=np.int64)
        for ids, tokens in zip((a, b), self.tokens):
            if b"".join(map(tokens.__getitem__, ids.tolist())) != part:
                return None
        return a, b


@lru_cache(maxsize=1)
def readers(a_path: str, b_path: str) -> Readers:
    return Readers(a_path, b_path)


@dataclass(frozen=True)
class Fragment:
    """``closed`` tells whether a common end lies within; without one, all tokens are in ``head``. ``text`` spells the closed groups."""

    closed: bool = False
    head: Ids = (NO_IDS, NO_IDS)
    tail: Ids = (NO_IDS, NO_IDS)
    groups: int = 0
    text: str = ""
    codes: np.ndarray = field(default_factory=lambda: NO_IDS)


def _joined(x: Ids, y: Ids) -> Ids:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def spell(own: Readers, ids: Ids, ends: Ids) -> tuple[int, str, np.ndarray]:
    """Number, spelling and links of closed groups. A link is A's id times 2^32 plus B's; ``ends`` finish with a common end.

    Between two neighbouring ends of either stream lies one token of each, and an overlapping pair has one such interval.
    """
    both = np.sort(np.concatenate(ends), kind="stable")
    both = both[np.r_[True, both[1:] != both[:-1]]]
    codes = (ids[0][np.searchsorted(ends[0], both)] << 32) | ids[1][np.searchsorted(ends[1], both)]
    common = np.intersect1d(*ends, assume_unique=True)
    words, order = [], []
    for stream in (0, 1):
        at = np.searchsorted(common, ends[stream])
        words.append(np.where(common[at] == ends[stream], own.last[stream][ids[stream]], own.inner[stream][ids[stream]]))
        order.append(2 * at + stream)
    place = np.argsort(np.concatenate(order), kind="stable")
    return len(common), "".join(np.concatenate(words)[place].tolist()), codes


def close(own: Readers, ids: Ids) -> tuple[int, str, np.ndarray]:
    """As ``spell``, for ids that make up one group."""
    return spell(own, ids, tuple(np.cumsum(size[i]) for size, i in zip(own.sizes, ids)))


def fragment(own: Readers, ids: Ids, ends: Ids) -> Fragment:
    common = np.intersect1d(*ends, assume_unique=True)
    if not len(common):
        return Fragment(head=ids)
    first = [np.searchsorted(e, common[0], side="right") for e in ends]
    stop = [np.searchsorted(e, common[-1], side="right") for e in ends]
    cut = lambda values, a, b: tuple(v[i:j] for v, i, j in zip(values, a, b))
    size = [len(e) for e in ends]
    inside = spell(own, cut(ids, first, stop), cut(ends, first, stop)) if len(common) > 1 else (0, "", NO_IDS)
    return Fragment(True, cut(ids, (0, 0), first), cut(ids, stop, size), *inside)


def compose(own: Readers, x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges. Associative; the fragment without tokens is neutral."""
    if not x.closed:
        return Fragment(y.closed, _joined(x.head, y.head), y.tail, y.groups, y.text, y.codes)
    if not y.closed:
        return Fragment(True, x.head, _joined(x.tail, y.head), x.groups, x.text, x.codes)
    n, text, codes = close(own, _joined(x.tail, y.head))
    return Fragment(True, x.head, y.tail, x.groups + n + y.groups, x.text + text + y.text, np.concatenate([x.codes, codes, y.codes]))


def finish(own: Readers, whole: Fragment | None) -> tuple[int, str, np.ndarray]:
    """Groups of a whole text, which begins and ends with a common end. None, a text that is not given back, has none."""
    if whole is None or not whole.closed:
        return 0, "", NO_IDS
    n, text, codes = close(own, whole.head)
    return n + whole.groups, text + whole.text, np.concatenate([codes, whole.codes])


def _safe(full: bytes, at: int) -> bool:
    return 0 < at < len(full) - 1 and full[at] == 32 and 32 < full[at - 1] < 127 and 32 < full[at + 1] < 127


def cut_before(full: bytes, at: int) -> int:
    """The last safe cut at or before ``at``, or 0."""
    while at > 0 and not _safe(full, at):
        at = max(full.rfind(b" ", 0, at), 0)
    return at


def cut_after(full: bytes, at: int) -> int:
    """The first safe cut at or after ``at``, or the end."""
    while at < len(full) and not _safe(full, at):
        at = full.find(b" ", at + 1)
        if at < 0:
            return len(full)
    return at


def ranges(full: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """(low, high, from, to): byte ranges and what is read for them. A range without safe cut is joined to the next, so no byte is read often."""
    edges = [0]
    for at in range(chunk, len(full), chunk):
        if cut_before(full, at) > edges[-1]:
            edges.append(at)
    edges.append(len(full))
    return [(a, b, cut_before(full, a), cut_after(full, b)) for a, b in zip(edges, edges[1:])]


def read_range(own: Readers, part: bytes, start: int, low: int, high: int) -> Fragment | None:
    """The fragment of the tokens that end above ``low`` and up to ``high``; ``part`` begins at ``start``."""
    ids = own.read(part)
    if ids is None:
        return None
    ends = tuple(start + np.cumsum(size[i]) for size, i in zip(own.sizes, ids))
    kept = [(e > low) & (e <= high) for e in ends]
    return fragment(own, tuple(i[k] for i, k in zip(ids, kept)), tuple(e[k] for e, k in zip(ends, kept)))


# --- Spark ---------------------------------------------------------------------------------------------------------------------

FRAGMENT = "bad boolean, closed boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, groups bigint, text string, codes array<bigint>"


def _row(found: Fragment | None) -> dict:
    f = found or Fragment()
    return {
        "bad": found is None, "closed": f.closed, "head_a": f.head[0].tolist(), "head_b": f.head[1].tolist(), "tail_a": f.tail[0].tolist(),
        "tail_b": f.tail[1].tolist(), "groups": f.groups, "text": f.text, "codes": f.codes.tolist(),
    }


def _fragment_of(row: dict) -> Fragment | None:
    ids = lambda name: np.asarray(row[name], dtype=np.int64)
    return None if row["bad"] else Fragment(row["closed"], (ids("head_a"), ids("head_b")), (ids("tail_a"), ids("tail_b")), row["groups"], row["text"], ids("codes"))


def _blocks(own: Readers, found: Iterator[tuple], kind: pa.DataType, branch: int) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, groups) in blocks. A block's last row has its dictionary: links and how often the block holds them."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        every = np.concatenate([codes for *_, codes in held])
        words, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        parts = np.split(inverse.astype(np.int32), np.cumsum([len(codes) for *_, codes in held])[:-1])
        a, b = (np.array([n for n in column], dtype=np.int64) for column in zip(*[(h[1], h[2]) for h in held]))
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, task << 32 | number << 1 | branch)),
                pa.array([*[h[0] for h in held], None], kind),
                pa.array([*a.tolist(), None], pa.int64()),
                pa.array([*b.tolist(), None], pa.int64()),
                pa.array([*[h[3] for h in held], None], pa.int64()),
                pa.array([*[hashlib.sha256(h[4][:-1].encode()).hexdigest() if h[4] else "" for h in held], None], pa.string()),
                pa.array([*parts, None], pa.list_(pa.int32())),
                pa.array([*[None] * n, words], pa.list_(pa.int64())),
                pa.array([*[None] * n, counts.astype(np.int64)], pa.list_(pa.int64())),
            ],
            names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "codes", "counts"],
        )

    links = 0
    for doc_id, (groups, text, codes) in found:
        # A group of a and b tokens is spelled with a + b marks, one of them the bar, one the semicolon.
        n_a, n_b = (0, 0) if not groups else _sizes(text)
        held.append((doc_id, n_a, n_b, groups, text, codes))
        links += len(codes)
        if len(held) >= BLOCK_ROWS or links >= BLOCK_LINKS:
            yield flush()
            held, links, number = [], 0, number + 1
    if held:
        yield flush()


def _sizes(text: str) -> tuple[int, int]:
    """Tokens of A and B in a spelling: every token is followed by one mark."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    marks = raw[(raw == 44) | (raw == 124) | (raw == 59)]
    ends = np.flatnonzero(marks != 44)
    size = np.diff(np.r_[-1, ends])
    return int(size[::2].sum()), int(size[1::2].sum())


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """Stored rows of all documents in blocks, each block with its dictionary of links."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    arrow_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = f"block bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>, codes array<bigint>, counts array<bigint>"
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = readers(a_path, b_path)

        def one(text: str) -> tuple[int, str, np.ndarray]:
            full = b" " + text.encode()
            return finish(own, read_range(own, full, 0, 0, len(full)))

        rows = ((d.as_py(), one(t.as_py()) if t.as_py() else (0, "", NO_IDS)) for b in batches for d, t in zip(b.column(0), b.column(1)))
        yield from _blocks(own, rows, arrow_kind, 0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*[c for c in batch.columns]):
                full = b" " + text.as_py().encode()
                for place, (low, high, start, stop) in enumerate(ranges(full, chunk)):
                    columns = [pa.array([v]) for v in (key.as_py(), place, low, high, start)]
                    yield pa.RecordBatch.from_arrays(
                        [columns[0], pa.array([doc_id.as_py()], arrow_kind), *columns[1:], pa.array([full[start:stop]], pa.binary())],
                        names=["key", "doc_id", "place", "low", "high", "start", "part"],
                    )

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        own = readers(a_path, b_path)
        for batch in batches:
            for r in batch.to_dict("records"):
                found = read_range(own, bytes(r["part"]), r["start"], r["low"], r["high"])
                yield pd.DataFrame([{"key": r["key"], "doc_id": r["doc_id"], "place": r["place"], **_row(found)}])

    def reduced(rows: pd.DataFrame) -> pd.DataFrame:
        own = readers(a_path, b_path)
        ordered = rows.sort_values("place").to_dict("records")
        parts = [_fragment_of(r) for r in ordered]
        whole = None if any(p is None for p in parts) else reduce(lambda x, y: compose(own, x, y), parts)
        return pd.DataFrame([{"key": ordered[0]["key"], "doc_id": ordered[0]["doc_id"], "place": ordered[0]["place"] // FAN, **_row(whole)}])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = readers(a_path, b_path)
        rows = ((r["doc_id"], finish(own, _fragment_of(r))) for b in batches for r in b.to_pylist())
        yield from _blocks(own, rows, arrow_kind, 1)

    near = docs.where(size < chunk).select("doc_id", "text").mapInArrow(short, schema)
    long = docs.where(size >= chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    cut = materialize(
        long.mapInArrow(windows, f"key bigint, doc_id {kind}, place bigint, low bigint, high bigint, start bigint, part binary"), "text-ranges"
    )
    head = f"key bigint, doc_id {kind}, place bigint, {FRAGMENT}"
    dealt = cut.repartition(shuffle_partitions(spark), "key", "place")
    now = materialize(dealt.mapInPandas(fragments, head), "fragments")
    while (now.agg(F.max("place")).head()[0] or 0) > 0:
        now = materialize(now.groupBy("key", F.expr(f"place DIV {FAN}").alias("parent")).applyInPandas(reduced, head), "fragments")
    return materialize(near.unionByName(now.mapInArrow(done, schema)), "alignments")


def pair_counts(stored: DataFrame) -> DataFrame:
    """(code, total, best): links of the corpus by pair of ids, and whether no other pair of the same B id has more."""
    words = stored.where("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "counts")).alias("w"))
    totals = materialize(words.groupBy(F.col("w.codes").alias("code")).agg(F.sum("w.counts").alias("total")), "pair-counts")
    b = F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = totals.groupBy(b).agg(F.max("total").alias("most"))
    # One row for each id of B's vocabulary.
    return totals.select("*", b).join(F.broadcast(most), "b").select("code", "total", (F.col("total") == F.col("most")).alias("best"))


def files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per document: tokens of both, groups, links, best links, the sum of their counts and a digest of the groups.

    Null and empty texts, and texts that either tokenizer does not give back, have zeros and an empty digest. Repeated rows
    are documents of their own and count as often. Texts from ``chunk`` bytes on are read in ranges. An empty table has no rows.
    """
    stored = aligned(docs, a_path or files()[0], b_path or files()[1], chunk)
    counts = pair_counts(stored)
    kind = dict(docs.dtypes)["doc_id"]
    words = stored.where("codes IS NOT NULL").select("block", F.explode("codes").alias("code"))
    answers = words.join(counts, "code").groupBy("block").agg(F.collect_list(F.struct("code", "total", "best")).alias("a"))
    answers = answers.select("block", F.sort_array("a").alias("a")).select("block", F.col("a.total").alias("totals"), F.col("a.best").alias("bests"))
    rows = stored.where("links IS NOT NULL").drop("codes", "counts")

    def weigh(found: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        total = np.asarray(given["totals"].iloc[0], dtype=np.int64) if len(given) else NO_IDS
        best = np.asarray(given["bests"].iloc[0], dtype=bool) if len(given) else np.zeros(0, dtype=bool)
        links = found["links"]
        return found.assign(
            n_links=[len(v) for v in links],
            n_best=[int(best[v].sum()) if len(v) else 0 for v in links],
            count_sum=[int(total[v].sum()) if len(v) else 0 for v in links],
        )[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    return rows.groupBy("block").cogroup(answers.withColumnRenamed("block", "of").groupBy("of")).applyInPandas(
        weigh,
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    )
