"""The dataset manifest against plain recomputation, over several rounds of blocks."""

import hashlib
import zlib

from llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def rise(nodes):
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0]


def climb(nodes, at, value):
    """Root with ``value`` at ``at``, and the siblings on the way."""
    seen = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        seen += run[: at % 8] + run[at % 8 + 1 :]
        value = h(*run[: at % 8], value, *run[at % 8 + 1 :])
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at //= 8
    return value, seen


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is None, r[0] or 0, leaf(r))):
        groups.setdefault(r[2], []).append(r)
    subroots = [rise([leaf(r) for r in g]) for g in groups.values()]
    found = []
    for k, g in enumerate(groups.values()):
        hashes = [leaf(r) for r in g]
        for i, r in enumerate(g):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            sub, first = climb(hashes, i, leaf((*r[:4], text)))
            root, second = climb(subroots, k, sub)
            found.append((r[0], hashes[i], subroots[k], rise(subroots), h(*first, *second), root, root == rise(subroots)))
    return sorted(found, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def rows(n):
    langs = [None, "", "de", "en", "é", "en", "en", "en"]
    return [(i * 7 % n, f"s{i % 3}" if i % 5 else None, langs[i % 8], i if i % 4 else None, f"Text {i} ÄÖ \n" * (i % 4) if i % 6 else None) for i in range(n)]


def result(docs, **more):
    return sorted(map(tuple, manifest.verify(docs, manifest.tampered(docs), **more).collect()), key=repr)


def test_blocks_of_any_height_give_the_plain_tree(spark):
    data = rows(700) + [(None, None, "en", 1, "A"), (None, None, None, None, None), (3, "s", "en", 9, "Same")] + [(3, "s", "en", 9, "Same")] * 20
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = brute(data)
    assert {w[-1] for w in want} == {True, False}
    for span in (1, 2, 5):
        assert result(docs, span=span) == want


def test_many_groups_climb_in_the_upper_tree(spark):
    data = [(i, "s", f"l{i % 100}", i, f"Text {i}") for i in range(300)]
    assert result(spark.createDataFrame(data, SCHEMA), span=1) == brute(data)


def test_one_leaf_an_empty_table_and_other_columns(spark):
    one = [(5, None, None, None, "X" * 2_000_000)]
    docs = spark.createDataFrame(one, SCHEMA).selectExpr("*", "1 AS tree", "2 AS leaf", "3 AS place", "4 AS block", "5 AS hash")
    assert result(docs) == brute(one)
    assert result(docs)[0][4] == h()
    assert result(docs.limit(0)) == []
