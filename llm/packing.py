"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous supersteps.

Pieces are range-sorted by length, open sequences by gap. A superstep takes all pieces of one length, longest first:
the successor sweep finds the smallest gaps that hold them, the k-th piece of the length goes to the k-th place found
(conflicts are resolved by rank), gaps shrink, and the next length follows. Pieces of equal length are alike to best-fit,
so a superstep matches runs (length, how many) with runs (gap, which sequences): its state is bounded by the sequence
length, not by the corpus. Ranks, and the placing of every piece, are distributed over the pieces themselves.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm.common import running

LIMIT = 1024
END = 2
_TWO_SPACES = re.compile(r"\s\s")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next free one after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Ids:
    """Ids of a byte-level BPE tokenizer file as bytes (little-endian unsigned 32 bit).

    The file's vocabulary is read into the faster of two readers. The pattern that parts a text into units looks ahead
    only within runs of white space, so texts without such runs take a pattern without that look-ahead. Strings of
    special tokens stand for these tokens, as in the file's own library, unless a text is read as ``ordinary``.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        file = Tokenizer.from_file(path)
        special, letters = file.get_added_tokens_decoder(), _byte_letters()
        ranks = {bytes(letters[c] for c in token): n for token, n in file.get_vocab().items() if n not in special}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        short = PATTERN.replace(r"\s+(?!\S)|", "")
        self.short = tiktoken.Encoding("short", pat_str=short, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {n: token for token, n in ranks.items()}
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in special.values()):
            raise ValueError(f"added tokens with conditions: {path}")
        self.special = {t.content: array("I", [n]).tobytes() for n, t in special.items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def ordinary(self, text: str) -> bytes:
        reader = self.full if _TWO_SPACES.search(text) else self.short
        return array("I", reader.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.marks.split(text) if self.special else [text]
        return b"".join(self.special[p] if i % 2 else self.ordinary(p) for i, p in enumerate(parts))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, limit: int = LIMIT, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, tie, piece, start, length and ids_crc32 of every piece. Each text ends with id ``end``; null is empty.

    Only documents longer than ``limit`` are cut: the first piece takes what is left over, all others are full.
    ``path`` is the tokenizer file, the same on all machines.
    """
    file = path or default_tokenizer()
    last = np.array([end], dtype="<u4").tobytes()
    names = ["doc_id", "tie", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(file)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(batch.column(2)):
                    ids = own.encode(text.as_py() or "") + last
                    n = len(ids) // 4
                    first = n % limit or min(n, limit)
                    edges = [0, *range(first, n + 1, limit)]
                    view = memoryview(ids)
                    rows += [(i, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                which, *columns = (np.array(c, dtype=np.int64) for c in zip(*rows))
                take = pa.array(which)
                columns[0] = columns[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, tie bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, schema)


def match(lengths: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """The supersteps. Rows (length, first rank, pieces, pieces for each sequence, first sequence, first place).

    ``lengths`` maps a length to its number of pieces. Pieces of ranks first, first + 1, ... of that length fill the
    row's sequences in turn. The result is best-fit decreasing; its size depends on ``limit`` alone.
    """
    gaps: dict[int, list[list[int]]] = {}  # gap: runs of sequences (first, how many)
    opened, steps = 0, []
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        for gap in [*sorted(g for g in gaps if g >= length), limit]:
            fit = gap // length
            runs = gaps.pop(gap, []) if gap < limit else [[opened, -(-left // fit)]] if left else []
            if gap == limit and left:
                opened += runs[0][1]
            for first, count in runs:
                full = min(count, left // fit)
                if full:
                    steps.append((length, rank, full * fit, fit, first, limit - gap))
                    gaps.setdefault(gap - fit * length, []).append([first, full])
                    rank, left = rank + full * fit, left - full * fit
                if full < count and left:
                    steps.append((length, rank, left, left, first + full, limit - gap))
                    gaps.setdefault(gap - left * length, []).append([first + full, 1])
                    rank, left, full = rank + left, 0, full + 1
                if full < count:
                    gaps.setdefault(gap, []).append([first + full, count - full])
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


def place(ranked: DataFrame, steps: np.ndarray) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``steps`` is bounded by the sequence length and travels with the tasks."""
    keys = (steps[:, 0] << 48) + steps[:, 1]
    order = np.argsort(keys)
    keys, table = keys[order], steps[order]
    names = [c for c in ranked.columns if c not in ("tie", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            step = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            at = rank - step[:, 1]
            sequence, offset = step[:, 4] + at // step[:, 3], step[:, 5] + (at % step[:, 3]) * length
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name in names]
    return ranked.mapInArrow(run, ", ".join([*fields, "sequence_id bigint", "offset bigint"]))


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there. Sequences are filled without gaps from 0.

    An empty or null text is one piece of one id. Repeated rows are packed one by one; among equal pieces the order is
    free. An empty table packs into nothing.
    """
    cut = materialize(pieces(docs, limit, end, path), "pieces")
    # At most ``limit`` rows.
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc(), F.col("piece").asc()]
    return place(running(cut, ["length"], order, name="rank"), match(counts, limit))
