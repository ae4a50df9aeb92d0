"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a unit there is exactly one token that its encoding ends with. It is a token that ends there (the
automaton over the vocabulary reports all suffixes of a prefix that are tokens, by its suffix links) and that the last
token of the remaining prefix tolerates on its right. The last tokens of all prefixes are stored, and following them
back from the end gives the ids. No merge is ever carried out, and the time is linear in the length of the unit.

Two tokens tolerate each other if no merge would join a piece of the left one to a piece of the right one while both
pieces exist. Only pieces at the border matter: the right spine of the left token's merges and the left spine of the right one's.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Units that a task remembers, and a quarter of the pairs; a full memory starts anew. Units above SHORT are not kept.
MEMORY = 1 << 18
SHORT = 64
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one after 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Merges:
    """What the border test needs: the spines of every token, with the ranks between which each piece exists."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]]) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int]] = {}
        born: dict[int, int] = {}
        for rank, (left, right) in enumerate(merges):
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.rank[pair] = rank
            if token in parts:
                raise ValueError("two merges make the same token")
            parts[token], born[token] = pair, rank
        size = max(vocabulary.values()) + 1
        # Spines from the whole token down to its outermost byte: (piece, rank that makes it, rank that uses it up).
        self.right: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        self.left: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
        self.whole = [False] * size
        for text, token in sorted(vocabulary.items(), key=lambda v: born.get(v[1], -1)):
            made = born.get(token, -1)
            if token in parts:
                a, b = parts[token]
                if not self.right[b] or not self.left[a]:
                    raise ValueError("a merge comes before the merges of its parts")
                tail = lambda spine: [(p, m, min(u, made)) for p, m, u in spine]  # noqa: E731, B023
                self.right[token] = [(token, made, NEVER), *tail(self.right[b])]
                self.left[token] = [(token, made, NEVER), *tail(self.left[a])]
                self.whole[token] = self.whole[a] and self.whole[b] and self.tolerate(a, b, made)
            else:
                self.right[token] = self.left[token] = [(token, -1, NEVER)]
                self.whole[token] = len(text) == 1

    def tolerate(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of a rank below ``until`` joins pieces of ``a`` and ``b`` at their border.

        Merges of one rank run from left to right: a piece that is used up at the same rank is gone if it lies on the
        left, and still there if it lies on the right.
        """
        right, left, rank = self.right[a], self.left[b], self.rank
        i = j = 0
        while True:
            x, made_x, used_x = right[i]
            y, made_y, used_y = left[j]
            at = rank.get((x, y))
            if at is not None and made_x < at and made_y < at and at < used_x and at <= used_y and at < until:
                return False
            # The piece made later makes room for what it was made of.
            if made_x > made_y or made_x == made_y and i + 1 < len(right):
                i += 1
            else:
                j += 1
            if i == len(right) or j == len(left):
                return True


class Bpe:
    """Ids of a byte-level tokenizer file, as the library that wrote it gives them without special tokens added."""

    def __init__(self, path: str, special: bool = True) -> None:
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError(f"added tokens with conditions: {path}")
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(vocabulary, pairs)
        self.added = {text: t["id"] for text, t in added.items()}
        self.letters = dict(enumerate(byte_letters()))
        byte_of = {c: b for b, c in self.letters.items()}
        self.bytes = {n: bytes(byte_of[c] for c in token) for token, n in vocabulary.items()} | {n: t.encode() for t, n in self.added.items()}
        self.automaton = ahocorasick.Automaton()
        for token, n in vocabulary.items():
            if self.merges.whole[n]:
                self.automaton.add_word(token, (n, len(token)))
        self.automaton.make_automaton()
        self.units = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if special and added else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def _learn(self, pair: int) -> bool:
        if len(self.pairs) >= 4 * MEMORY:
            self.pairs.clear()
        found = self.pairs[pair] = self.merges.tolerate(pair >> 32, pair & 0xFFFFFFFF)
        return found

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of a text within which all merges may act."""
        word = text.encode("utf-8").decode("latin-1").translate(self.letters)
        n = len(word)
        # Of every prefix: its last token, and where that begins. Arrays hold machine numbers, for units of any length.
        last, start = ([0] * (n + 1), [0] * (n + 1)) if n <= SHORT else (array("l", bytes(8 * (n + 1))), array("l", bytes(8 * (n + 1))))
        pairs = self.pairs
        done = 0  # the longest prefix whose last token is known
        for end, (token, size) in self.automaton.iter(word):
            if end >= done:
                at = end + 1 - size
                if at:
                    pair = last[at] << 32 | token
                    tolerated = pairs.get(pair)
                    if tolerated is None:
                        tolerated = self._learn(pair)
                    if not tolerated:
                        continue
                done = end + 1
                last[done], start[done] = token, at
        if done < n:
            raise ValueError("a prefix has no last token: the vocabulary lacks a byte")
        ids = []
        while n:
            ids.append(last[n])
            n = start[n]
        ids.reverse()
        return tuple(ids)

    def _ordinary(self, text: str, ids: list[int]) -> None:
        known = self.known
        for part in self.units.findall(text):
            found = known.get(part)
            if found is None:
                found = self.unit(part)
                if len(part) <= SHORT:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[part] = found
            ids.extend(found)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                ids.append(self.added[part])
            else:
                self._ordinary(part, ids)
        return ids

    def decode_bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        """The text; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def reader(path: str, special: bool = True) -> Bpe:
    return Bpe(path, special)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to ``doc_id``. Null is empty and has none; repeated rows are encoded one by one."""
    file = path or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(file)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = pa.array([own.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of the rows (doc_id, ids); null ids are an empty text."""
    file = path or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(file)
        for batch in batches:
            texts = pa.array([own.decode(v.as_py() or ()) for v in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(coded.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, a digest of them and one of the text decoded from them.

    Null and empty texts have no ids; a text of any length is read whole; other columns are ignored; an empty table has no rows.
    """
    file = path or default_file()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(file)
        spelled = {n: str(n) for n in own.bytes}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, coded, decoded = [], [], []
                for text in batch.column(1):
                    ids = own.encode(text.as_py() or "")
                    sizes.append(len(ids))
                    coded.append(sha(",".join(map(spelled.__getitem__, ids)).encode()))
                    decoded.append(sha(own.decode(ids).encode()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded), pa.array(decoded)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
