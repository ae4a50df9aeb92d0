"""Near copies of similarity 0.8 to 1 against all pairs."""

import random

import numpy as np
import pandas as pd

import corpus_pipeline
from llm import near_copies, simhash


def brute_classes(texts):
    def grams(text):
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    found = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, x in enumerate(found):
        for j in range(i):
            y = found[j]
            if x == y or x and y and len(x & y) / len(x | y) >= 0.8:
                pairs += x != y
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], pairs


def family_texts():
    rng = random.Random(8)
    texts = ["", None, "one two", "One two", "alone"]
    for f in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 600]))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(1, 1 + len(words) // 45 + f % 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


def test_components_match_all_pairs(spark):
    texts = family_texts()
    want, pairs = brute_classes(texts)
    assert pairs > 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for frequent in (2, 32):
        assert {r.doc_id: r.component_id for r in near_copies.classes(docs, frequent=frequent).collect()} == dict(enumerate(want))


def test_the_stage_drops_copies_of_similarity_08(spark):
    texts = family_texts()
    want, _ = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def template_texts(n):
    """One template with four changed words each, below the similarity but for chance."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    found = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(200), 4):
            words[at] = f"x{rng.randrange(10**6)}"
        found.append(" ".join(words))
    return found


def test_a_template_is_not_compared_pair_by_pair(spark, monkeypatch):
    texts = template_texts(600)
    want, _ = brute_classes(texts)
    compared = []
    plain = near_copies.Join.compare

    def counting(self, pairs):
        before = self.tried.count() if self.tried is not None else 0
        plain(self, pairs)
        compared.append(self.tried.count() - before)

    monkeypatch.setattr(near_copies.Join, "compare", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in near_copies.classes(docs).collect()} == dict(enumerate(want))
    assert sum(compared) < 20 * len(texts)


def test_buckets_meet_whatever_the_similarity_allows():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(20, 400)
        common = [rng.randrange(1 << 60) for _ in range(n)]
        take = lambda: set(common) - set(rng.sample(common, rng.randrange(0, n // 8 + 1)))
        x, y = take(), take()
        rx, ry = rng.randrange(0, n // 12 + 1), rng.randrange(0, n // 12 + 1)
        m, k = len(x) + rx, len(y) + ry
        if len(x & y) / (m + k - len(x & y)) >= 0.8:
            (a, own_a), (b, own_b) = (
                near_copies.bucket_keys(near_copies.np.array(sorted(s), dtype="uint64"), size, rare, 0.8) for s, size, rare in ((x, m, rx), (y, k, ry))
            )
            met = set(a.tolist()) & set(b.tolist())
            assert met & (set(a[own_a].tolist()) | set(b[own_b].tolist()))


def test_odd_rows_have_a_defined_result(spark):
    long = "word " * 3 + " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (None, None), (7, ""), (8, long), (2, long + " end"), (9, "A b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "2 AS tie", "3 AS size", "4 AS key")
    found = sorted(((r.doc_id, r.component_id) for r in near_copies.classes(docs).collect()), key=repr)
    assert found == sorted([(5, 5), (5, 5), (None, 5), (None, None), (None, 7), (7, 7), (8, 2), (2, 2), (9, 5)], key=repr)
    assert near_copies.classes(docs.limit(0)).collect() == []
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(5, "a b c d e f"), (None, "only here"), (7, ""), (2, long + " end")], key=repr
    )


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size, other in ((0, 0), (0, 3), (1, 1), (90, 95), (400, 380), (5000, 4700)):
        base = rng.integers(0, 2**64, size + other, dtype=np.uint64)
        x, y = np.unique(base[:size]), np.unique(base[size // 3 : size // 3 + other])
        bits = [near_copies.parities(v).view(np.uint64) for v in (x, y)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(x, y))
        assert len(bits[0]) == len(near_copies.PARITIES)


def test_partners_keep_every_pair_that_can_be_similar():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    found = [np.unique(np.r_[base[: 60 - i % 20], rng.integers(0, 2**64, i % 20, dtype=np.uint64)]) for i in range(40)]
    bits = np.array([near_copies.parities(v) for v in found])
    rows = pd.DataFrame({"key": 1, "root": range(40), "node": range(40), "own": True, "size": [len(v) for v in found], "place": 0, **dict(zip(near_copies.PARITIES, bits.T))})
    got = {(a, b) for part in near_copies._partners(64, 0.8)(iter([rows])) for a, b in part.to_numpy().tolist()}
    true = {(i, j) for i in range(40) for j in range(i + 1, 40) if len(np.intersect1d(found[i], found[j])) >= 0.8 * len(np.union1d(found[i], found[j]))}
    assert true and true <= got and len(got) < 40 * 39 // 2


def test_sets_with_linked_fingerprints_meet_first(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), " ".join(["y", *base[1:]]), " ".join(base[::-1]), "some other text of few words", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    join = near_copies.Join(docs, near_copies.WIDTH, near_copies.SIMILARITY, near_copies.FREQUENT)
    nodes = {r.doc_id: (r.node, r.fingerprint) for r in join.distinct.collect()}
    prints = {i: simhash.majority(near_copies.shingles(t)) for i, t in enumerate(texts)}
    assert all(p % 2**64 == prints[i] for i, (_, p) in nodes.items())
    near = {i for i in nodes if i < 5 and any(j != i and j < 5 and (prints[i] ^ prints[j]).bit_count() <= simhash.DISTANCE for j in nodes)}
    found = join.alike().collect()
    assert near and {n for r in found for n in r} == {nodes[i][0] for i in near}
    join.compare(join.alike())
    assert join.edges.count() >= 1
