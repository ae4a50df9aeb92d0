"""URL rules, WARC archives, HTML extraction, packing and the pipeline against brute force or exact round trips."""

import random
import zlib

import numpy as np
import pyarrow.fs as fs
import pytest

import corpus_pipeline
from flowguard.session import materialize
from llm import html_extract, near_copies, packing, quality_rules, secret_scan, url_filter, warc

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/en/1x?q#f", "https://blog.example.org/es/a", "http://example.org/es", "ftp://a.b.com/fr/x",
    "http://com/de/", "http://notexample.org/es/", "http://x.org?y=/z", "http://x.org#/z", "http://É.org/é", "a://b://c.com/fr/", "http://org/", "http://x.org.:80/",
]


def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_url_rules_match_brute_force(spark):
    rng = random.Random(2)
    hosts = ["org", "com", "example.org", "a.example.org", "b.a.example.org", "x.com", "y.x.com", "xx.com"]
    urls = URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de', ''])}/{rng.choice(['1', '12', 'q', ''])}" for _ in range(300)]
    rules = [*url_filter.RULES, ("a.example.org", "", "allow"), ("x.com", "/fr/1", "block"), ("example.org", "/e", "allow"), ("com", "/de/", "block")]
    rows = [(i if i % 11 else None, u, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    text = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(map(text, got)) == sorted(text((i, *brute_verdict(u, rules))) for i, u, _ in rows)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark, []), "block").collect()} == {"block"}


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(chr(rng.randint(33, 500)) for _ in range(n))
    shared, short = noise(400), "s" * 99
    rows = [(i, f"http://h/{i}", noise(rng.choice([0, 5, 3000]))) for i in range(40)]
    rows += [(100, "u\r\nX: y", shared), (90, None, shared), (None, "u", shared), (101, "u", shared), (90, "u", shared), (102, "u", short), (103, "u", short), (104, "u", None), (None, None, noise(150))]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload", "2 AS payload_digest", "3 AS record_type", "4 AS tie")


def test_archives_round_trip_at_any_split(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write(pages.repartition(3), folder)
    rows = pages.collect()
    want = sorted(
        (str(r.page_id), len((r.html or "").encode()), "revisit" if r.html and len(r.html.encode()) >= 100 and r.page_id != 90 and (r.page_id in (100, 101) or (r.page_id is None and r.url)) else "response")
        for r in rows
    )
    for split in (1 << 23, 2000, 97):
        got = warc.read(manifest, folder, split).collect()
        assert sorted((str(r.page_id), r.payload_bytes, r.record_type) for r in got) == want
        assert {r.refers_to for r in got if r.record_type == "revisit"} == {90}
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert sum(r.records for r in manifest.collect()) == len(rows)


def test_an_archive_inside_a_payload_is_not_read(tmp_path):
    inner = warc.member(warc.record(7, "u", b"inner", "00", 5, "response", None), 0)
    data = b""
    for page in (1, 2, 3):
        # Stored without compression, so that the inner archive lies in the file byte for byte.
        content = warc.record(page, "u", inner, "00", len(inner), "response", None)
        raw = zlib.compressobj(0, zlib.DEFLATED, 31)
        data += raw.compress(content) + raw.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    store, _ = fs.FileSystem.from_uri(str(tmp_path))
    for split in (len(data), 60):
        found = []
        for start in range(0, len(data), split):
            stop = min(start + split, len(data))
            with store.open_input_file(str(path)) as file:
                found += [c for c in warc.records(warc._Window(file, start, stop + 2), start, stop)]
        assert [c.split(b"urn:page:")[1][:1] for c in found] == [b"1", b"2", b"3"]


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="post"><nav><ul><li><a href=x>m</a><li>n</ul></nav><!-- c -->'
    '<div class="sidebar-left"><p>side</p></div><{tag}><h1>A &amp; B</h1><div class="notice">note</div><p>one<br>two <b>three</b>\n four<p>{text}</p>'
    "<form>f<input></form><script>var a='<p>no</p>';</script></{tag}><section id=comments><p>reader</p></section><footer>end</footer>"
)


def test_articles_are_found(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{tag}", ("article", 'div class="entry-content"')[i % 2], 1).replace("{tag}", ("article", "div")[i % 2]).replace("{text}", f"text {i}" * 9)) for i in range(12)]
    rows += [(50, None, None), (51, "http://h0.org/", ""), (52, "x", "bare words &am &lt;tag&gt; 1 < 2"), (None, "http://h0.org/", rows[0][2]), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, content string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        assert by[i] == f"A & B\none two three four\n{f'text {i}' * 9}"
    assert by[None] == by[0] and by[50] == by[51] == "" and by[52] == "bare words &am <tag> 1 < 2"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_wrappers_are_union_free():
    pages = ["nav ul li # li # li # /ul /nav article h1 # p # p # /article", "nav ul li # /ul /nav div.ad # /div article h1 # p # /article footer # /footer", "nav ul /ul /nav article h1 # p # p # p # /article"]
    wrapper: list[str] = []
    for page in pages:
        folded = html_extract.folded(page.split(" "))
        wrapper = html_extract.align(wrapper, folded) if wrapper else folded
    text = " ".join(wrapper)
    assert "|" not in text and "(footer)?" in text and "(div.ad)?" in text and ")+" in text
    assert html_extract.tokens_of(text) == wrapper


def test_wrappers_of_a_host_are_aligned_in_rounds(spark):
    rows = [(i, f"http://a.org/{i}", f"<nav>{'<b><div>m</div>' * (i % 7)}</nav><article><h1>t{i}</h1>{'<p>x</p><table>y</table>' * (i % 5)}</article>") for i in range(70)]
    rows += [(100, "http://b.org/", "<p>one</p>"), (101, None, None), (102, "http://b.org/", "<p>one</p>")]
    shapes = html_extract.page_shapes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for fan in (2, 3, 256):
        found = {r.host: r for r in html_extract.wrappers(shapes, fan).collect()}
        assert {h: r.pages for h, r in found.items()} == {"a.org": 70, "b.org": 2, "": 1}
        assert all("article" in c for c in found["a.org"].content) and found["b.org"].wrapper == "p #"
        assert "|" not in found["a.org"].wrapper and "article" in found["a.org"].wrapper
    with pytest.raises(ValueError, match="at least two"):
        html_extract.wrappers(shapes, 1)


def test_long_broken_pages_take_linear_time():
    for part in ("<p title='", "<", "<!--", "<a \"b", "&", "<script>", "</", "<li>"):
        html_extract.slots(part * 20_000)


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    own, plain = packing.Ids(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(8)
    parts = ["a", " the", "  ", "\n", "\n\n", "\t", "é", "日本", "'s", "'LL", "123", "!?", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u2003", "\U0001f600", " "]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_match_is_best_fit_decreasing():
    rng = random.Random(1)
    for limit in (10, 64):
        for _ in range(40):
            lengths = [rng.randint(1, limit) for _ in range(rng.randint(1, 200))]
            gaps = []
            for n in sorted(lengths, reverse=True):
                fit = min((g for g in gaps if g >= n), default=None)
                if fit is None:
                    gaps.append(limit - n)
                else:
                    gaps[gaps.index(fit)] = fit - n
            counts = {n: lengths.count(n) for n in set(lengths)}
            steps = packing.match(counts, limit)
            used: dict[int, list] = {}
            for length, _, pieces, each, first, place in steps.tolist():
                for k in range(pieces):
                    used.setdefault(first + k // each, []).append((place + (k % each) * length, length))
            assert len(used) == len(gaps)
            for parts in used.values():
                at = 0
                for offset, n in sorted(parts):
                    assert offset == at
                    at += n
                assert at <= limit


def test_packing_keeps_every_piece(spark):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["the", "of", "zebra", "é"]) for _ in range(rng.choice([0, 1, 30, 300, 2500]))), i) for i in range(60)]
    rows += [(7, None, 0), (7, None, 0), (3, "x  y\n\n z", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rank bigint")
    got = packing.pack(docs).collect()
    own = packing.Ids(packing.default_tokenizer())
    want = []
    for doc, text, _ in rows:
        ids = np.append(np.frombuffer(own.encode(text or ""), "<u4"), np.uint32(2))
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(str(doc), k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, ""), name)
        if name != "packing":
            assert after.columns == columns
        if name == "quality_rules":
            assert after.count() == quality_rules.ledger(before).where(quality_rules.passes(quality_rules.RELEASE)).count()
        if name == "near_duplicates":
            classes = {r.component_id for r in near_copies.classes(before).collect()}
            assert {r.doc_id for r in after.collect()} == classes and after.count() == len(classes)
        if name == "secret_scan":
            assert after.count() == before.count()
            assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in secret_scan.digest(after).collect())
        before = after
    assert before.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
