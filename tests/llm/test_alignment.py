"""Alignment of two tokenizers against a plain walk over both streams, in one range and in many."""

import hashlib
import random
from collections import Counter
from functools import reduce

import pandas as pd
import sentencepiece
from tokenizers import Tokenizer

from llm import alignment, bpe

A_FILE, B_FILE = alignment.files()
TA = Tokenizer.from_file(A_FILE)
TA.encode_special_tokens = True
LETTERS = {c: b for b, c in enumerate(bpe.byte_letters())}
A_BYTES = {n: bytes(LETTERS[c] for c in t) for t, n in TA.get_vocab(with_added_tokens=False).items()}
TB = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
B_BYTES = [bytes([int(TB.id_to_piece(i)[3:5], 16)]) if TB.is_byte(i) else TB.id_to_piece(i).replace("▁", " ").encode() for i in range(len(TB))]


def spans(ids, table):
    at, found = 0, []
    for i in ids:
        found.append((at, at + len(table[i]), i))
        at += len(table[i])
    return found


def walk(text):
    """Tokens, groups and links, or None where there are none."""
    full = (" " + (text or "")).encode()
    x, y = TA.encode(" " + (text or ""), add_special_tokens=False).ids, TB.encode(text or "")
    if not text or b"".join(A_BYTES[i] for i in x) != full or b"".join(B_BYTES[i] for i in y) != full:
        return None
    left, right = spans(x, A_BYTES), spans(y, B_BYTES)
    groups, links, i, j, open_a, open_b = [], Counter(), 0, 0, [], []
    while i < len(left):
        links[left[i][2], right[j][2]] += 1
        if left[i][1] == right[j][1]:
            groups.append(",".join(map(str, [*open_a, left[i][2]])) + "|" + ",".join(map(str, [*open_b, right[j][2]])))
            i, j, open_a, open_b = i + 1, j + 1, [], []
        elif left[i][1] < right[j][1]:
            open_a.append(left[i][2])
            i += 1
        else:
            open_b.append(right[j][2])
            j += 1
    return len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def odd_texts():
    rng = random.Random(3)
    words = ["house", "Häuser", "don't", "naïve", "中文", "x1", "antidisestablishmentarianism", "<|endoftext|>", "<s>", "...", "1999"]
    found = ["a▁b", "  x  y ", " ", "\n\n a\tb", "é" * 50, "a " * 100, "word " * 50 + "zz", "\x00 q", "nbsp x y", "unspaced" * 40]
    return found + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]


def test_ranges_of_any_size_give_the_whole_alignment():
    own, rng = alignment.readers(A_FILE, B_FILE), random.Random(4)
    for text in odd_texts():
        want, full = walk(text), b" " + text.encode()
        for chunk in (1, 7, 40, 1 << 16):
            parts = [alignment.read_range(own, full[a:b], a, low, high) for low, high, a, b in alignment.ranges(full, chunk)]
            if want is None:
                assert any(p is None for p in parts)
                continue
            while len(parts) > 1:  # any order of composition
                i = rng.randrange(len(parts) - 1)
                parts[i : i + 2] = [alignment.compose(own, parts[i], parts[i + 1])]
            groups, spelled, codes = alignment.finish(own, parts[0])
            links = Counter((int(c) >> 32, int(c) & 0xFFFFFFFF) for c in codes)
            assert (*alignment._sizes(spelled), groups, links, hashlib.sha256(spelled[:-1].encode()).hexdigest()) == want


def test_the_neutral_fragment():
    own = alignment.readers(A_FILE, B_FILE)
    full = b" some words here"
    f, none = alignment.read_range(own, full, 0, 0, len(full)), alignment.Fragment()
    for g in (alignment.compose(own, f, none), alignment.compose(own, none, f), reduce(lambda x, y: alignment.compose(own, x, y), [none, f, none])):
        assert alignment.finish(own, g)[1] == alignment.finish(own, f)[1]


def brute(rows):
    found = [walk(t) for _, t in rows]
    counts = sum((f[3] for f in found if f), Counter())
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    result = []
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            result.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        best = sum(n for (a, b), n in f[3].items() if counts[a, b] == most[b])
        result.append((doc_id, *f[:3], sum(f[3].values()), best, sum(n * counts[p] for p, n in f[3].items()), f[4]))
    return sorted(result, key=repr)


def test_digest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(odd_texts())) + [(500, None), (501, ""), (None, "no id"), (7, "twice the same"), (7, "twice the same")]
    rows.append((900, " ".join(rng.choices(["some", "longer", "words", "in a text", "中", "12"], k=4000))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).selectExpr("*", "1 AS block", "2 AS n_a", "3 AS code", "4 AS key")
    want = brute(rows)
    for chunk in (60, 1 << 16):
        assert sorted(map(tuple, alignment.digest(docs, chunk=chunk).collect()), key=repr) == want
    assert alignment.digest(docs.limit(0)).collect() == []


def test_blocks_may_be_small(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", 2)
    monkeypatch.setattr(alignment, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    own = alignment.readers(A_FILE, B_FILE)
    full = b" a few words"
    one = alignment.finish(own, alignment.read_range(own, full, 0, 0, len(full)))
    batches = list(alignment._blocks(own, iter([(i, one) for i in range(5)]), alignment.pa.int64(), 0))
    table = pd.concat([b.to_pandas() for b in batches])
    assert [len(b) for b in batches] == [3, 3, 2] and table.block.nunique() == 3
    assert table[table.codes.notna()].counts.map(sum).tolist() == [2 * len(one[2]), 2 * len(one[2]), len(one[2])]
