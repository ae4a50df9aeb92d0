"""Main text of web pages by union-free wrappers, inferred for each host.

A page is a stream of tokens: block tags and text slots. Repeats that follow one another are folded to groups. The
streams of a host are aligned one after another: what differs becomes an optional group, what repeats a repeated
group, and text becomes a slot, until one expression without unions, the wrapper, describes them all. Every page is
then matched against its host's wrapper, which says for each text in which slot it stands. Slots are counted over the
pages of the host and told apart: those with one text on all pages from those of the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm.url_filter import host_of

# Fixed values of HTML.
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "title", "select", "textarea", "button"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "table", "ul", "ol", "dl", "figure", "center", "td", "fieldset", "details", "dialog", "menu", "address", "blockquote"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "tbody", "thead", "tfoot", "caption", "pre", "hr", "figcaption", "summary", "legend", "option", "hgroup", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}
# Blocks that a dropped element may hold; any other one shows that it was not closed.
HOLDS = {"select": {"option", "hr", "legend"}, "button": {"div"}}
# Names of what is not the article: by tag, and by words within class or id.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "sharing", "social", "comment", "comments", "reply", "replies", "disqus", "respond", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form", "search", "pagination", "pager", "toolbar", "copyright", "disclaimer"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}

KNOWN_WORDS = ASIDE_WORDS | MAIN_WORDS | ROLES | {"hidden"}

# Longest group of tokens that is folded where it follows itself.
LONGEST = 64
# Wrappers and slots of all hosts are broadcast up to this many bytes, else joined by host.
BROADCAST_BYTES = 32 << 20
# Shapes, or partial wrappers, of one host that are aligned in one task.
FAN = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")


def label(tag: str, attributes: str) -> str:
    """A container's name: its tag and the words of its class, id and role."""
    words = []
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values).lower()
        if name.lower() in ("hidden", "aria-hidden"):
            if name.lower() == "hidden" or value == "true":
                words.append("hidden")
        else:
            words += _WORD.findall(value)
    return ".".join([tag, *dict.fromkeys(words)])


def known(name: str) -> str:
    """A container's name without the words that say nothing about its role, so paths do not grow with class names."""
    tag, *words = name.split(".")
    return ".".join([tag, *(w for w in words if w in KNOWN_WORDS)])


def slots(html: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The token stream of a page, and its text blocks as (path of containers, text), one for each "#" of the stream.

    Blocks end at every block tag. A close tag without an open one is passed over; what is not closed ends with its
    parent. White space within a block, line breaks included, is one space.
    """
    stream: list[str] = []
    blocks: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    pending: list[str] = []
    inside, depth = "", 0  # the dropped element around this place, and how often it is open
    inner: list[str] = []  # containers opened within it
    closed: dict[str, int] = {}

    def ends(tag: str, close: bool, at: int) -> bool:
        """Whether a block tag shows that the dropped element was never closed: its parent ends, or it cannot hold the block."""
        if inside == "head":
            return True
        if inside not in closed:
            closed[inside] = max((m.start() for m in re.finditer(f"</{inside}", html, re.I)), default=-1)
        if closed[inside] < at or (inside in HOLDS and not close and tag not in HOLDS[inside]):
            return True
        if tag in CONTAINERS:
            if not close:
                inner.append(tag)
            elif tag in inner:
                inner.remove(tag)
            else:
                return any(t == tag for t, _ in stack)
        return False

    def end_block() -> None:
        text = " ".join(unescape("".join(pending)).split())
        pending.clear()
        if text:
            path = stack[-1][1] if stack else ""
            stream.append("#")
            blocks.append((path, text))

    at = 0
    for found in _TOKEN.finditer(html):
        if not inside:
            pending.append(html[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if inside:
            if tag == inside and found["close"]:
                depth -= 1
            elif tag == inside == "object":
                depth += 1
            elif tag in BLOCKS and ends(tag, bool(found["close"]), found.start()):
                depth = 0
            if depth == 0:
                inside = ""
                inner.clear()
            if inside or tag in DROPPED:
                continue
        if tag in DROPPED:
            # Raw elements are one token; of these only head, select, object and button get here.
            end_block()
            if not found["close"]:
                inside, depth = tag, 1
            continue
        if tag not in BLOCKS:
            if tag == "br":
                pending.append(" ")
            continue
        end_block()
        if tag not in CONTAINERS:
            if not found["close"]:
                stream.append(label(tag, "") if tag not in VOID else tag)
            continue
        if found["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    stream.append("/" + tag)
                    break
        else:
            name = label(tag, found["attributes"])
            stack.append((tag, f"{stack[-1][1]}>{known(name)}" if stack else known(name)))
            stream.append(name)
    if not inside:
        pending.append(html[at:])
    end_block()
    return stream, blocks


def fold(stream: list[str], longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Groups of up to ``longest`` tokens that follow themselves become one repeated group, written "(a b)+".

    The second list says how many tokens of the stream each node stands for.
    """
    lengths = [1] * len(stream)
    for size in range(1, min(longest, len(stream) // 2) + 1):
        out: list[str] = []
        kept: list[int] = []
        at = 0
        while at < len(stream):
            stop = at + size
            if stop < len(stream) and stream[at] == stream[stop]:
                group = stream[at:stop]
                while stream[stop : stop + size] == group:
                    stop += size
            if stop > at + size:
                out.append(group[0] if size == 1 and group[0].endswith(")+") else f"({' '.join(group)})+")
                kept.append(sum(lengths[at:stop]))
                at = stop
            else:
                out.append(stream[at])
                kept.append(lengths[at])
                at += 1
        stream, lengths = out, kept
    return stream, lengths


def folded(stream: list[str], longest: int = LONGEST) -> list[str]:
    return fold(stream, longest)[0]


def text_nodes(stream: list[str], lengths: list[int]) -> list[tuple[int, int]]:
    """For each text of a stream its node in the folded stream, and the node that opens its container (-1: none)."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    tokens = iter(stream)
    for node, length in enumerate(lengths):
        for token in islice(tokens, length):
            tag = token.split(".")[0]
            if token == "#":
                found.append((node, stack[-1][1] if stack else -1))
            elif tag in CONTAINERS:
                stack.append((tag, node))
            elif tag[0] == "/":
                while stack.pop()[0] != tag[1:]:
                    pass
    return found


@lru_cache(4096)
def matched(wrapper: str, shape: str) -> list[int]:
    """For each node of a page's shape the node of the wrapper that describes it, -1 where none does; and -1 at the end."""
    nodes = [_bare(x) for x in tokens_of(shape)]
    found = [-1] * (len(nodes) + 1)
    for i, j, n in SequenceMatcher(None, [_bare(x) for x in tokens_of(wrapper)], nodes, autojunk=False).get_matching_blocks():
        found[j : j + n] = range(i, i + n)
    return found


def _bare(node: str) -> str:
    """A node without the marks for optional and repeated."""
    if node.endswith(")?"):
        node = node[1:-2]
    return node[1:-2] if node.endswith(")+") else node


def align(wrapper: list[str], stream: list[str]) -> list[str]:
    """One step of inference: the smallest change to the wrapper that also describes the stream."""
    out: list[str] = []
    a, b = [_bare(x) for x in wrapper], [_bare(x) for x in stream]

    def optional(nodes: list[str]) -> None:
        out.extend(x if x.endswith(")?") else f"({x})?" for x in nodes)

    def joined(x: str, y: str) -> str:
        node = _bare(x)
        if _bare_optional(x).endswith(")+") or _bare_optional(y).endswith(")+"):
            node = f"({node})+"
        return f"({node})?" if x.endswith(")?") or y.endswith(")?") else node

    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.extend(joined(x, y) for x, y in zip(wrapper[i:j], stream[k:m]))
        else:
            optional(wrapper[i:j])
            optional(stream[k:m])
    return folded(out)


def _bare_optional(node: str) -> str:
    return node[1:-2] if node.endswith(")?") else node


def is_aside(name: str) -> bool:
    tag, *words = name.split(".")
    return "hidden" in words or tag != "main" and (tag in ASIDE or not ASIDE_WORDS.isdisjoint(words) or not ROLES.isdisjoint(words))


def is_article(name: str) -> bool:
    return name.split(".")[0] == "article"


def is_main(name: str) -> bool:
    return name.split(".")[0] == "main" or name.endswith(".main")


def is_named(name: str) -> bool:
    tag, *words = name.split(".")
    return tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words)


def choose(keys: dict[str, tuple[int, bool]]) -> list[str]:
    """The slots of the article among a wrapper's: ``keys`` maps a slot to (characters, same text on all pages).

    A slot is written "node:box:path": its node in the wrapper, the node that opens its container, and the names of the
    containers around it. A page alone has paths only. Left out are slots inside a container whose name says it is
    something else, unless it is layout: it holds an article or main element and none is outside, or it holds nine tenths of
    the text and no such element is outside. Of the rest, an article element with text that differs holds the article,
    else a main element, else a container named so. Without any of these all slots whose text differs belong to it,
    whatever their size, and those with one text on all pages only where they share a container below the body
    with one that differs, or stand in an element as above. Nothing within an article is left out for having one text.
    """
    path = {k: k.rsplit(":", 1)[-1] for k in keys}
    everything: dict[str, int] = {}
    for key, (n, _) in keys.items():
        everything[path[key]] = everything.get(path[key], 0) + n
    weights = _weights(everything)
    total = sum(everything.values())
    mains = [p for p in everything if any(n.split(".")[0] in ("article", "main") and not is_aside(n) for n in p.split(">"))]

    def layout(container: str) -> bool:
        around = mains and not any(n.split(".")[0] in ("article", "main") for n in container.split(">"))
        return all(_within(p, container) for p in mains) and bool(around or 10 * weights[container] >= 9 * total)

    aside = {k for k in weights if is_aside(k.split(">")[-1]) and ("hidden" in k.split(">")[-1].split(".") or not layout(k))}

    def kept(p: str) -> bool:
        names = p.split(">")
        return not any(">".join(names[: i + 1]) in aside for i in range(_root(p), len(names)))

    open_paths = {p for p in everything if kept(p)}
    open_ = {k: v for k, v in keys.items() if path[k] in open_paths}
    whole = sum(n for n, _ in open_.values())
    varied = {k for k, v in open_.items() if not v[1]}
    # Where nearly all text is constant, the pages are copies of one article.
    if 10 * sum(open_[k][0] for k in varied) < whole:
        varied = set(open_)
    good_slots: set[str] = set()
    for good in (is_article, is_main, is_named):
        good_paths = {p for p in open_paths if any(good(n) for n in p.split(">"))}
        inside = [k for k in open_ if path[k] in good_paths]
        if not varied.isdisjoint(inside):
            return inside
        good_slots.update(inside)
    boxes = {_box(k) for k in varied} - {None}
    return [k for k in open_ if k in varied or k in good_slots or _box(k) in boxes]


def _box(key: str) -> str | None:
    """The container of a slot, as the wrapper has it; None for text right below the body or outside the wrapper."""
    parts = key.split(":")
    return ":".join(parts[1:]) if len(parts) == 3 and parts[1] != "-1" and _root(parts[2]) < len(parts[2].split(">")) else None


def _within(path: str, container: str) -> bool:
    return path == container or path.startswith(container + ">")


def _weights(paths: dict[str, int]) -> dict[str, int]:
    """Characters within every container."""
    weight: dict[str, int] = {}
    for path, n in paths.items():
        names = path.split(">")
        for i in range(len(names)):
            key = ">".join(names[: i + 1])
            weight[key] = weight.get(key, 0) + n
    return weight


def _root(path: str) -> int:
    """Names of html and body say nothing about what is in them."""
    names = path.split(">")
    return next((i for i, n in enumerate(names) if n.split(".")[0] not in ("html", "body")), len(names))


def page_shapes(pages: DataFrame) -> DataFrame:
    """host, page (hash of the html), shape and its texts in order: node, box, path, characters, hash."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("box", pa.int32()), ("path", pa.string()), ("chars", pa.int64()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, texts, hashes = [], [], []
            for html in batch.column(1):
                stream, blocks = slots(html.as_py())
                nodes, lengths = fold(stream)
                hashes.append(_hash(html.as_py()))
                shapes.append(" ".join(nodes))
                texts.append([{"node": n, "box": b, "path": p, "chars": len(t), "hash": _hash(t)} for (n, b), (p, t) in zip(text_nodes(stream, lengths), blocks)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64()), pa.array(shapes, pa.string()), pa.array(texts, kind)], names=["host", "page", "shape", "texts"])

    schema = "host string, page bigint, shape string, texts array<struct<node:int,box:int,path:string,chars:bigint,hash:bigint>>"
    return pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html")).mapInArrow(run, schema)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


def tokens_of(shape: str) -> list[str]:
    """Top-level nodes of a written stream or wrapper."""
    out, depth, now = [], 0, []
    for word in shape.split(" ") if shape else []:
        depth += word.count("(") - word.count(")")
        now.append(word)
        if depth == 0:
            out.append(" ".join(now))
            now = []
    return out


def _merge(shapes: list[str]) -> str:
    wrapper: list[str] = tokens_of(shapes[0])
    for shape in shapes[1:]:
        wrapper = align(wrapper, tokens_of(shape))
    return " ".join(wrapper)


def expressions(shapes: DataFrame, fan: int = FAN) -> DataFrame:
    """host, wrapper (the union-free expression) and pages (how many it describes).

    Pages are first counted by host and shape, so a host with many pages brings its distinct shapes only. They are
    aligned in order of frequency, about ``fan`` in a task; the partial wrappers of a host are aligned in the same way
    until one is left. No task holds all shapes of a host with more than that.
    """
    if fan < 2:
        raise ValueError("a task must align at least two shapes")

    def partial(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "shape"], ascending=[False, True])
        return pd.DataFrame({"host": rows["host"].iloc[:1], "shape": [_merge(list(rows["shape"]))], "pages": [rows["pages"].sum()]})

    merged = shapes.groupBy("host", "shape").agg(F.count("*").alias("pages"))
    while True:
        merged = materialize(merged, "partial-wrappers")
        sizes = merged.groupBy("host").agg(F.count("*").alias("n"))
        if sizes.where("n > 1").isEmpty():
            break
        salted = merged.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / F.lit(fan))))
        aligned = salted.groupBy("host", "salt").applyInPandas(partial, "host string, shape string, pages bigint")
        # Tasks that came to the same wrapper count as one.
        merged = aligned.groupBy("host", "shape").agg(F.sum("pages").alias("pages"))
    return merged.select("host", F.col("shape").alias("wrapper"), "pages")


def _with_host(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows with what is stored about their host, which is broadcast if it is measured to be small."""
    size = sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in hosts.columns)
    small = (hosts.agg(F.sum(size).alias("n")).first().n or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(hosts) if small else hosts, "host", "left")


def slot_table(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """host, slot, chars, pages (distinct pages that have it), optional (some lack it) and same (one text on all, three at least).

    Copies of a page count once. Slots are matched page by page and counted by partial sums, so a host of any number of pages
    is never in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, shape, wrapper, texts in zip(*(c.to_pylist() for c in batch.columns)):
                at = matched(wrapper, shape)
                own: dict[str, list] = {}
                for t in texts:
                    place = own.setdefault(f"{at[t['node']]}:{at[t['box']]}:{t['path']}", [0, []])
                    place[0] += t["chars"]
                    place[1].append(t["hash"])
                rows += [(host, k, n, _hash(str(h))) for k, (n, h) in own.items()]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "slot", "chars", "hash"])

    single = shapes.dropDuplicates(["host", "page"])
    counted = single.groupBy("host").agg(F.count("*").alias("all"))
    placed = _with_host(single, found).select("host", "shape", "wrapper", "texts").mapInArrow(run, "host string, slot string, chars bigint, hash bigint")
    return (
        placed.groupBy("host", "slot")
        .agg(F.sum("chars").alias("chars"), F.count("*").alias("pages"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        .join(counted, "host")
        .select("host", "slot", "chars", "pages", (F.col("pages") < F.col("all")).alias("optional"), ((F.col("pages") >= 3) & (F.col("pages") == F.col("all")) & (F.col("low") == F.col("high"))).alias("same"))
    )


def contents(slot_rows: DataFrame) -> DataFrame:
    """host and content: the slots of the article. A host's slots are bounded by its wrapper and the known names, not by its pages."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        found = choose({k: (int(c), bool(s)) for k, c, s in zip(rows["slot"], rows["chars"], rows["same"])})
        return pd.DataFrame({"host": rows["host"].iloc[:1], "content": [sorted(found)]})

    return slot_rows.groupBy("host").applyInPandas(pick, "host string, content array<string>")


def wrappers(shapes: DataFrame, fan: int = FAN) -> DataFrame:
    """host, wrapper, pages and content (the article's slots of the wrapper) of every host."""
    found = materialize(expressions(shapes, fan), "wrappers")
    return found.join(contents(slot_table(shapes, found)), "host", "left")


def article(html: str, wrapper: str, content: set[str]) -> str:
    """The text of a page: its blocks that stand in one of the article's slots of the wrapper, else by the page alone."""
    stream, blocks = slots(html)
    nodes, lengths = fold(stream)
    at = matched(wrapper, " ".join(nodes))
    keys = [f"{at[n]}:{at[b]}:{p}" for (n, b), (p, _) in zip(text_nodes(stream, lengths), blocks)]
    if content.isdisjoint(keys):
        own: dict[str, int] = {}
        keys = [p for p, _ in blocks]
        for p, t in blocks:
            own[p] = own.get(p, 0) + len(t)
        content = set(choose({p: (n, False) for p, n in own.items()}))
    return "\n".join(t for k, (_, t) in zip(keys, blocks) if k in content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null html is empty and has an empty text; null or odd urls share the wrapper of the empty host. Pages that lack all of
    their host's article slots are read by the same rules from the page alone. Repeated rows give equal rows, an empty table
    an empty one; other columns are not read. Texts of any length are read whole.
    """
    found = materialize(wrappers(materialize(page_shapes(pages), "page-shapes")), "wrapper-contents").select("host", "wrapper", "content")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    joined = _with_host(rows, found).select("page_id", "url", "html", "wrapper", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(h.as_py(), w.as_py() or "", set(c.as_py() or ())) for h, w, c in zip(*batch.columns[2:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")
