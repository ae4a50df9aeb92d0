"""Prefix encoding against the tokenizers library, and back."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from llm import bpe

SETS = ["ab", "aaaa ", "the ing", "  \n", "abcdefghijklmnopqrstuvwxyz", "'stlredm ", "éü中文😀a ", "0123456789.", "==--__##", "\x00  x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_file())


def texts():
    rng = random.Random(11)
    found = ["".join(rng.choice(rng.choice(SETS)) for _ in range(rng.randrange(60))) for _ in range(2000)]
    found += ["".join(rng.choices(rng.choice(SETS), k=40)) for _ in range(4000)]
    return found + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", " <|endoftext|> "]


def test_ids_equal_the_library_and_decode_to_the_text(library):
    own = bpe.reader(bpe.default_file())
    for text in texts():
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == text == library.decode(ids, skip_special_tokens=False)
    assert own.encode("a<|endoftext|>b")[1] == 50256


def test_any_ids_decode_as_the_library_does(library):
    own, rng = bpe.reader(bpe.default_file()), random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_units_of_any_length(library):
    own, rng = bpe.reader(bpe.default_file()), random.Random(5)
    for text in ("a" * 200_000, " " * 100_000, "中" * 50_000, "".join(rng.choices("etaoinshr", k=200_000))):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    own = bpe.Bpe(bpe.default_file())
    for text in texts()[:300]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digest_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (3, "a<|endoftext|>b"), (None, "x y"), (5, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for n, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((n, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.digest(docs).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digest(docs.limit(0)).collect() == []
    back = bpe.decode(bpe.encode(docs))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((n, t or "") for n, t in rows), key=repr)
