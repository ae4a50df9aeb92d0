"""Article text that neither a constant path nor a name on a wrapper may drop."""

from html.parser import HTMLParser

import pytest

from flowguard.session import materialize
from llm import html_extract
from llm.common import table
from tests.conftest import SF_SMALL


def test_constant_text_of_an_article_stays(spark):
    page = "<body><article><p>first {i} text</p>{more}</article></body>"
    rows = [(i, f"http://a.org/{i}", page.format(i=i, more="<blockquote>shared passage</blockquote>" if i < 3 else "")) for i in range(9)]
    copies = "<body><div>{i}</div><article><p>one article that is copied</p></article></body>"
    rows += [(20 + i, f"http://b.org/{i}", copies.format(i=i)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"first {i} text\nshared passage" for i in range(3)) and got[5] == "first 5 text"
    assert all(got[20 + i] == "one article that is copied" for i in range(4))


def choose(html):
    blocks = html_extract.slots(html)[1]
    own = {}
    for path, text in blocks:
        own[path] = own.get(path, 0) + len(text)
    wanted = set(html_extract.choose({p: (n, False) for p, n in own.items()}))
    return "\n".join(t for p, t in blocks if p in wanted)


@pytest.mark.parametrize("around", ["<form id=aspnetForm>{}</form>", "<div class='site has-sidebar'>{}</div>", "<main class='with-sidebar'>{}</main>"])
def test_a_wrapper_around_the_page_is_layout(around):
    assert choose("<body>" + around.format("<nav>menu</nav><div class=content><p>" + "long text " * 20 + "</p></div>") + "</body>") == ("long text " * 20).strip()


def test_what_is_not_closed_ends_with_its_parent_or_at_a_block():
    for tag in ("button", "select", "object"):
        assert choose(f"<body><div><{tag}>drop</div><p>kept</p><p>too</p></body>") == "kept\ntoo"
        assert choose(f"<body><div><{tag}>drop</div><p>kept</p><{tag}>b</{tag}><p>too</p></body>") == "kept\ntoo"
    assert choose("<body><button><div>drop</div></button><p>kept</p></body>") == "kept"


def extracted(spark, htmls):
    rows = [(i, f"http://a.org/{i}", html, "c", "x") for i, html in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, content string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    return [got[i] for i in range(len(rows))]


def test_text_in_sibling_containers_stays_whatever_its_size(spark):
    page = "<body><nav>menu {i}</nav><div><p>long {long}</p></div><div><h2>short {i}</h2><p>tail {i}</p></div><footer>end {i}</footer></body>"
    got = extracted(spark, [page.format(i=i, long=f"part {i} " * 20) for i in range(9)])
    assert got == [f"long {(f'part {i} ' * 20).strip()}\nshort {i}\ntail {i}" for i in range(9)]


def test_slots_of_one_path_are_told_apart_by_the_wrapper(spark):
    page = "<body><div><p>Sign up for our letter</p></div><div><h1>title {i}</h1><p>text {i} {more}</p><p>written by us</p></div></body>"
    htmls = [page.format(i=i, more="words " * 9) for i in range(9)]
    want = [f"title {i}\ntext {i} {('words ' * 9).strip()}\nwritten by us" for i in range(9)]
    assert extracted(spark, htmls) == want
    # With a wrapper that describes nothing, the notice cannot be told from the text.
    assert html_extract.article(htmls[0], "", set()) == "Sign up for our letter\n" + want[0]


def test_the_result_depends_on_the_wrapper(spark, monkeypatch):
    page = "<body><div><p>Notice</p></div><div><h1>t{i}</h1><p>text {i}</p></div></body>"
    htmls = [page.format(i=i) for i in range(5)]
    assert all("Notice" not in text for text in extracted(spark, htmls))
    monkeypatch.setattr(html_extract, "matched", lambda wrapper, shape: [-1] * (len(html_extract.tokens_of(shape)) + 1))
    assert all(html_extract.article(h, "p #", {"0:-1:html>body"}).startswith("Notice") for h in htmls)


def test_optional_text_of_some_pages_stays_and_repeats_are_one_slot(spark):
    page = "<body><div><h1>t{i}</h1>{more}{items}</div><div><p>always the same</p></div></body>"
    item = "<section><h3>a{j}</h3><p>b</p><p><b>c</b></p><ul><li>d<li>e</ul><table><tr><td>f</table></section>"
    htmls = [page.format(i=i, more="<blockquote>seen elsewhere</blockquote>" if i < 4 else "", items="".join(item.format(j=j) for j in range(i + 2))) for i in range(9)]
    for i, text in enumerate(extracted(spark, htmls)):
        want = [f"t{i}", *(["seen elsewhere"] if i < 4 else [])]
        for j in range(i + 2):
            want += [f"a{j}", "b", "c", "d", "e", "f"]
        assert text == "\n".join(want)
    nodes, lengths = html_extract.fold(html_extract.slots(htmls[3])[0])
    assert sum(lengths) == len(html_extract.slots(htmls[3])[0]) and any(n.startswith("(section ") and n.endswith(")+") for n in nodes)


def test_a_container_with_an_aside_name_around_the_article_is_layout():
    page = "<body><div class=has-sidebar><article><p>kept</p></article></div><footer>" + "long footer " * 30 + "</footer></body>"
    assert choose(page) == "kept"
    comments = "<body><article>kept</article><section class=comments><article class=comment>reader</article></section></body>"
    assert choose(comments) == "kept"


class Plain(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.skip, self.blocks, self.now = 0, 0, [], []

    def end(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag in html_extract.BLOCKS:
            self.end()
        self.open += tag == "article"
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCKS:
            self.end()
        self.open -= tag == "article"
        self.skip -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if self.open and not self.skip:
            self.now.append(data)


def test_all_pages_equal_a_plain_parser(spark):
    pages = materialize(table(spark, SF_SMALL, "pages"), "pages")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(rows) == len(got) > 200
    for row in rows:
        parser = Plain()
        parser.feed(row.html or "")
        parser.close()
        parser.end()
        assert got[row.page_id].text == "\n".join(parser.blocks) and got[row.page_id].n_chars == len(got[row.page_id].text)
