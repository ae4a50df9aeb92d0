"""Quality ledger and source mix on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from llm import mixing, quality_rules

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, failed int, row string"


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 8))
    return len(covered)


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r",
    "one two",
    " ".join(f"w{i}" for i in range(30)),
    " ".join(["a b c d e f g h i"] * 4),
    " ".join(f"x{i % 13}" for i in range(60)) + " tail",
    "\n".join(["same line here"] * 5 + ["", "other"]),
    " odd space é # * $ % & | < >",
    " ".join(f"long{i}" for i in range(3000)) + " " + " ".join(f"long{i}" for i in range(500)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1, 7, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", None, None, None, None, None), (3, "one two", None, "s", 1, 7, "clash")]
    return spark.createDataFrame(rows, DOCS)


def test_measures_match_brute_force(docs):
    got = quality_rules.ledger(docs).select("row.doc_id", "row.text", *quality_rules.MEASURES, "failed").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        body = r.text or ""
        words = [w for w in body.replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        lines = [x for x in body.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in body)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute_repeats(words) if len(words) < 500 else r.n_repeat_words == 1000
        assert bool(r.failed & 1) == (len(words) < 20)


def test_policies_and_ablations(docs):
    entries = quality_rules.ledger(docs)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {4, 6, 9} - ({6} if brute_repeats(TEXTS[6].split()) * 100 > 30 * 61 else set())
    table = {r.rule: (r.failed, r.rejected_alone) for r in quality_rules.ablations(entries, quality_rules.STRICT).collect()}
    bits = [r.failed for r in entries.select("failed").collect()]
    for rule, bit in quality_rules.BITS.items():
        mask = quality_rules.STRICT.mask
        assert table[rule] == (sum(bool(b & bit) for b in bits), sum((b & mask) == bit for b in bits))
    assert quality_rules.accepted(docs.limit(0)).count() == 0


def water(sizes, weights, most=3):
    """Shares of the total by weight, bounded by ``most`` times the size."""
    total, bound = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in bound]
        left = total - sum(bound.values())
        share = {i: weights[i] * left / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            return [bound.get(i, share.get(i)) for i in range(len(sizes))]
        bound |= {i: most * sizes[i] for i in over}


def test_mix_meets_targets(spark):
    rows, n = [], 0
    for source, count, size in (("a", 3, 4), ("b", 200, 30), ("c", 40, 25), ("é", 10, 7), (None, 60, 12), ("", 2, 0)):
        for k in range(count):
            rows.append((n, " ".join(["w"] * (size + k % 3 if size else 0)), source, "x", "y"))
            n += 1
    rows += [(5, None, "b", "x", "y"), (None, "p q", "b", "x", "y"), (0, rows[0][1], "a", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string, key string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in names]
    for name, size, target in zip(names, sizes, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        own = [r for r in got if r.source == name]
        assert {r.source_size for r in own} == {size}
        assert all(math.isclose(r.target, target, rel_tol=1e-12) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5
        assert all(r.taken <= 3 * r.size for r in own)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken = mixing.resample(docs)
    assert taken.columns == docs.columns
    words = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()}
    for name, size, target in zip(names, sizes, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(words.get(name, 0) - target) <= 32


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.resample(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0), (0, 0.0)]
