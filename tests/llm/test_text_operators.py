"""Fingerprints, secrets, near-duplicates and personal data against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm import fingerprint, pii, secret_scan, simhash

KEY = "AKIA" + "Q" * 16
HEX = "0123456789abcdef" * 3
TEXTS = [
    None,
    "",
    "plain words only",
    f'é password = "{HEX}" and TOKEN:short then api_key: longenough1',
    f"{KEY} {KEY}x {HEX[:31]}g {HEX}",
    'secret: "token: abcdefghij" passwd=abcdefgh-._=/+',
    "-----BEGIN RSA PRIVATE KEY----- x ghp_" + "Z" * 36 + " eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12,
    "x" * 5000 + " AKIA" + "0" * 12,
    " ".join([f"secret={HEX}"] * 40),
]
PATTERNS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def brute_secrets(text):
    found = []
    for number, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def frame(spark, texts):
    rows = [(i, t, "x", 9) for i, t in enumerate(texts)] + [(None, "no id", "x", 9), (2, texts[2], "x", 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, blob string, n_chars bigint")


def test_secrets_match_brute_force(spark):
    docs = frame(spark, TEXTS)
    got = secret_scan.digest(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute_secrets((TEXTS[r.doc_id] if r.doc_id is not None else "no id") or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in PATTERNS)
        assert set(want) <= set(r.spans.split(",") if r.spans else ())
    assert {"pem", "github", "jwt"} == {s.split(":")[0] for r in got if r.doc_id == 6 for s in r.spans.split(",")}
    assert secret_scan.digest(docs.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, TEXTS[3]), (2, TEXTS[3]), (3, "x")], "doc_id int, text string")
    secret_scan.scan(one, path, secret_scan.BASE)
    assert secret_scan.read_ledger(spark, path).count() == 2
    more = one.union(spark.createDataFrame([(4, TEXTS[4])], "doc_id int, text string"))
    secret_scan.scan(more, path, secret_scan.BASE)
    assert secret_scan.read_ledger(spark, path).count() == 3
    newer = (*secret_scan.BASE, secret_scan.Rule("word", 1, "and"))
    secret_scan.scan(more, path, newer)
    rules = [tuple(r.rules) for r in secret_scan.read_ledger(spark, path).collect()]
    assert rules.count(("word@1",)) == 3 and len(rules) == 6
    spans = {len(r.spans) for r in secret_scan.entries(spark, path, newer).collect()}
    assert spans == {0, 3, 4}


def test_redaction(spark):
    docs = frame(spark, TEXTS)
    got = secret_scan.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    for r in got.where("doc_id is not null").collect():
        old = TEXTS[r.doc_id]
        if brute_secrets(old or "") or r.doc_id == 6:
            assert HEX not in r.text and KEY not in r.text and "[secret]" in r.text and r.n_chars == len(r.text)
        else:
            assert (r.text or "") == (old or "") and r.n_chars == 9


def test_fingerprints(spark):
    texts = [None, "", "one line", "a. b. c\nd | e\n\nf!" * 30, "z" * 700, "", "é\U0001f600" * 9, "a. b. c\nd | e\n\nf!" * 30]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(None, "late", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bucket string")
    got = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    assert len(got) == len(rows)
    order = [(t or "") for _, t, _ in rows]
    for i, (doc, text, _) in enumerate(rows):
        text, following = text or "", order[(i + 1) % len(order)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.near_edited == 1.0) == (changed == text) and (r.near_next == 1.0) == (text == following)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[9].fingerprint == got[21].fingerprint != got[12].fingerprint
    assert fingerprint.compare(docs.limit(0)).count() == 0
    assert fingerprint.compare(docs.where("doc_id = 9")).first().near_next == 1.0


def test_next_document_in_every_bucketing(spark):
    rows = [(i if i % 7 else None if i == 0 else i, f"t{i}") for i in range(60)] + [(11, "t11"), (11, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for buckets in (1, 7, 300):
        got = fingerprint.with_next(docs, buckets).select("row.doc_id", "body", "next_text").collect()
        assert sorted(r.body for r in got) == sorted(t for _, t in rows)
        assert sorted(r.next_text for r in got) == sorted(t for _, t in rows)
        named = [r for r in got if r.doc_id is not None and r.doc_id not in (10, 11, 59)]
        assert all(r.next_text == f"t{r.doc_id + 1}" for r in named)
        assert [r.next_text for r in got if r.doc_id is None] == ["t1"]


def test_changed_leaves(spark):
    a, b = "one. two. three.\nfour.", "one. two! three.\nfour."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.tree(F.col("a")).alias("a"), fingerprint.tree(F.col("b")).alias("b"))
    assert row.select(fingerprint.changed_leaves(F.col("a"), F.col("b")).alias("c")).first().c == [1]


def brute_classes(values, distance=4):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprint_definition():
    text = "The quick brown Fox\tjumps é over\nthe lazy dog"
    words = "the quick brown fox jumps é over the lazy dog".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("One  Two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("crowded", [20_000, 3])
def test_links_connect_what_brute_force_does(spark, crowded):
    rng = random.Random(5)
    values = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(14)]
    values = sorted(set(values + [0, (1 << 64) - 1, 15, 31]))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, crowded=crowded)).collect()}
    got = [roots.get(v, v) for v in signed]
    want = brute_classes(values)
    same = lambda x: {frozenset(i for i, y in enumerate(x) if y == v) for v in set(x)}
    assert same(got) == same(want)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicate_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base + " end", "x"), (9, base, "x"), (5, base, "x"), (1, "quite different text here", "x"), (None, base, "x"), (7, None, "x"), (8, " ", "x"), (None, "alone without id", "x"), (None, "alone without id", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = simhash.digest(docs)
    assert got.count() == len(rows)
    near = {r.doc_id: r.component_id for r in got.collect() if r.doc_id is not None}
    assert near == {5: 3, 3: 3, 9: 3, 1: 1, 7: 7, 8: 7}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 3, 7]
    assert simhash.digest(docs.limit(0)).count() == 0


def test_segments_are_checked():
    with pytest.raises(ValueError):
        simhash.check_segments(((0, 32, 1), (32, 32, 1)), 4)


PATTERNS_PII = dict(
    email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]"
)


def brute_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS_PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((k, *m.span()))
    return sorted(out)


def test_fixed_spans_match_brute_force():
    rng = random.Random(3)
    alphabet = ["@", ".", "a", "b.c", "1", "23", "255", "256", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "+1 (974) 555-3436", "x@y.org", "10.0.0.1", "é", "007"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        assert sorted(pii.fixed_spans(text)) == brute_pii(text), text
    assert pii.fixed_spans("a" * 200_000) == pii.fixed_spans("1" * 200_000) == []


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(1)
    field = pii.Field({}, np.zeros((1, 3)), rng.normal(size=(3, 3)))
    scores = [rng.normal(size=(n, 3)) for n in (1, 4, 3, 5, 1)]
    from itertools import product

    for got, score in zip(pii.viterbi(field, scores, cells=6), scores):
        value = lambda y: sum(score[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip((0, *y), (*y, 0)))  # noqa: B023, E731
        assert tuple(got) == max(product(range(3), repeat=len(score)), key=value)


def test_field_learns_shapes(spark):
    docs = spark.createDataFrame([(i, f"mail to u{i}@mail.example.com or +1 (974) 555-{1000 + i} in {1900 + i} at 10:{i % 60}") for i in range(60)] + [(None, None), (99, "")], "doc_id bigint, text string")
    field = pii.fit(docs)
    rows = [r for text, spans in pii.example_rows() for r in pii.labelled(text, spans)]
    right = total = 0
    for seen, labels in rows:
        got = pii.viterbi(field, [field.scores(seen)])[0]
        right, total = right + int((got == labels).sum()), total + len(labels)
    assert right / total > 0.95
    held_out = "reach me at (312) 555-0142 before 2031-04-05, host 10.20.30.40"
    (fixed, added), = pii.find([held_out], field)
    assert [held_out[a:b] for _, a, b in fixed] == ["10.20.30.40"]
    assert [(pii.KINDS[k], held_out[a:b]) for k, a, b in added] == [("phone", "(312) 555-0142")]
    got = pii.digest(docs, field).collect()
    assert len(got) == 62
    assert sum(r.n_email for r in got) == 60 and sum(r.n_phone for r in got) == 60
    assert {r.spans for r in got if r.doc_id in (None, 99)} == {""}
    assert pii.digest(docs.limit(0), field).count() == 0


LONG = 10**6


@pytest.mark.parametrize(
    "text, spans",
    [
        ("-----BEGIN " + "AB " * LONG, []),
        ("-----BEGIN " + "AB " * LONG + "PRIVATE KEY-----", [("pem", 0, 3 * LONG + 27)]),
        ("password: " + "g" * LONG, [("assign", 0, LONG + 10)]),
        ("password" + " " * LONG, []),
        ("AKIA" + "Z" * LONG, [("access", 0, LONG + 4)]),
        ("0" * LONG, [("hex", 0, LONG)]),
        ("ghp_" + "z" * LONG, [("github", 0, LONG + 4)]),
        ("xoxb-" + "z-" * LONG, [("slack", 0, 2 * LONG + 5)]),
        ("eyJ" * LONG, []),
        ("eyJ" + "z" * LONG + "." + "y" * LONG + "." + "x" * LONG, [("jwt", 0, 3 * LONG + 5)]),
        ("-----BEGIN RSA PRIVATE KEY-----\n" * 50_000, [("pem", 32 * i, 32 * i + 31) for i in range(50_000)]),
    ],
    ids=range(11),
)
def test_secrets_in_very_long_texts(spark, text, spans):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert secret_scan.digest(docs).head().spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
