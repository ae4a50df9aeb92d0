"""One registered query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import alignment, bpe, fingerprint, html_extract, manifest, mixing, packing, pii, quality_rules, secret_scan, simhash, url_filter, warc
from llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op1_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
    l AS (
      SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
    ),
    win AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
    ),
    rep AS (
      SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE n > 1) GROUP BY doc_id
    ),
    m AS (
      SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
    ),
    f AS (
      SELECT *,
        (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 100000 THEN 4 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END)::BIGINT AS failed
      FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
      (failed & 75) = 0 AS kept, failed
    FROM f
    """,
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.passes(quality_rules.BASE)
    return entries.select(
        F.col("row.doc_id").alias("doc_id"),
        *[m for m in quality_rules.MEASURES if m != "n_lines"],
        (~base).alias("base_failed"),
        (base & quality_rules.passes(quality_rules.RELEASE)).alias("kept"),
        "failed",
    )


@query(
    "op2_mixing",
    rf"""
    WITH d AS (
      SELECT doc_id, source, len({WORDS})::BIGINT AS size,
        length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
        (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
          / 4503599627370496.0::DOUBLE AS u
      FROM documents
    ),
    k AS (
      SELECT *, -ln(u) / (CASE WHEN size > 0 THEN size::DOUBLE / (size + symbols)::DOUBLE ELSE 1 END) AS key FROM d
    ),
    s AS (
      SELECT source, sum(size)::HUGEINT AS source_size,
        ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight
      FROM k GROUP BY source
    ),
    c AS (
      SELECT *, sum(source_size) OVER ()::HUGEINT AS total, sum(weight) OVER ()::HUGEINT AS parts,
        coalesce(sum(3 * source_size) OVER o, 0)::HUGEINT AS cut, coalesce(sum(weight) OVER o, 0)::HUGEINT AS cut_weight
      FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    b AS (SELECT *, 3 * source_size * (parts - cut_weight) < weight * (total - cut) AS bounded FROM c),
    r AS (
      SELECT *, total - coalesce(sum(CASE WHEN bounded THEN 3 * source_size END) OVER (), 0) AS num,
        parts - coalesce(sum(CASE WHEN bounded THEN weight END) OVER (), 0) AS den
      FROM b
    ),
    t AS (
      SELECT source, source_size::BIGINT AS source_size,
        CASE WHEN bounded THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * num::DOUBLE / den::DOUBLE END AS target
      FROM r
    ),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
    q AS (SELECT *, floor(target + 0.5)::BIGINT - epochs * source_size AS budget FROM p),
    x AS (
      SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM k
    )
    SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(budget - earlier, 0), size))::BIGINT AS taken,
      x.source AS source, epochs
    FROM x JOIN q ON x.source IS NOT DISTINCT FROM q.source
    """,
)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _spans_sql() -> str:
    """Spans of every rule: the text is split at the matches, and a match starts where all before it end."""
    # The patterns of secret_scan.RULES as RE2 understands them (no look-behind, ASCII case only).
    kinds = [
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
        ("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", 0, 1),
        ("github", r"(?:^|[^A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
        ("slack", r"(?:^|[^A-Za-z0-9])(xox[abeoprs]-[A-Za-z0-9-]{10,})", 1, 1),
        ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 1),
    ]
    parts = []
    for number, (kind, pattern, group, least) in enumerate(kinds):
        # The character before a match is part of the hit where the pattern has one.
        before = "length(hit) - length(part)" if pattern.startswith("(?:^") else "0"
        parts.append(
            f"""
            SELECT doc_id, {number} AS number, '{kind}' AS kind, start + {before} AS start, start + length(hit) AS stop FROM (
              SELECT doc_id, hit, part, sum(length(piece)) OVER w + coalesce(sum(length(hit)) OVER v, 0) AS start
              FROM (
                SELECT doc_id, unnest(hits) AS hit, unnest(parts) AS part, unnest(pieces[1:len(hits)]) AS piece, unnest(range(len(hits))) AS i
                FROM (
                  SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS parts,
                    string_split_regex(text, '{pattern}') AS pieces
                  FROM d
                )
              )
              WINDOW w AS (PARTITION BY doc_id ORDER BY i), v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            ) WHERE length(part) >= {least}
            """
        )
    return " UNION ALL ".join(parts)


@query(
    "op4_secret_scan",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({_spans_sql()}),
    g AS (
      SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, number) FILTER (number < 3) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, number) AS spans
      FROM s GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, text: str) -> str:
    """CTEs that end in ``name``: root, the three levels and the distinct leaves of the column ``text``."""
    short = "substr(sha256(x), 1, 16)"
    return rf"""
    {name}_a AS (
      SELECT doc_id, list_transform(regexp_extract_all({text}, '[^\n.!?|]{{1,120}}[\n.!?|]*|[\n.!?|]+'),
        lambda x: {{'d': {short}, 'e': CASE WHEN ends_with(x, chr(10)) THEN ';' ELSE ',' END}}) AS leaf FROM texts
    ),
    {name}_b AS (
      SELECT doc_id, list_distinct(list_transform(leaf, lambda x: x.d)) AS leaves,
        array_to_string(list_transform(leaf, lambda x: x.d || x.e), '') AS leaf_level FROM {name}_a
    ),
    {name}_c AS (
      SELECT *, list_transform(list_filter(string_split(leaf_level, ';'), lambda x: x <> ''), lambda x: {short}) AS line FROM {name}_b
    ),
    {name}_d AS (
      SELECT *, list_transform(list_filter(string_split(array_to_string(list_transform(line,
        lambda x: x || CASE WHEN x[1] = '0' THEN ';' ELSE ',' END), ''), ';'), lambda x: x <> ''), lambda x: {short}) AS section FROM {name}_c
    ),
    {name} AS (
      SELECT doc_id, leaves, sha256(array_to_string(section, ',') || '/' || leaf_level) AS root,
        sha256(array_to_string(section, ',') || '/' || leaf_level) || '/' || array_to_string(section, ',') || '/'
          || array_to_string(line, ',') || '/' || leaf_level AS whole
      FROM {name}_d
    )"""


def _near_sql(a: str, b: str) -> str:
    common = f"len(list_intersect({a}.leaves, {b}.leaves))::DOUBLE"
    return f"CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({a}.leaves) + len({b}.leaves))::DOUBLE END"


@query(
    "op8_fingerprint",
    f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    ordered AS (
      SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM base
    ),
    texts AS (
      SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(following, 1, length(text) // 2) AS changed FROM ordered
    ),
    {_tree_sql("a", "text")}, {_tree_sql("b", "changed")}, {_tree_sql("c", "following")}
    SELECT t.doc_id, length(t.text)::BIGINT AS n_chars, sha256(t.changed) AS edited_sha256, a.whole AS fingerprint,
      b.whole AS edited_fingerprint, {_near_sql("a", "b")} AS near_edited, {_near_sql("a", "c")} AS near_next
    FROM texts t JOIN a USING (doc_id) JOIN b USING (doc_id) JOIN c USING (doc_id)
    """,
)
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query(
    "op6_url_filter",
    r"""
    WITH rules(rh, rp, v) AS (
      VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
    ),
    u AS (
      SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS raw,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages
    ),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
    f AS (
      SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
    )
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f USING (page_id)
    """,
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


@query(
    "op7_warc",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op10_html_extract")
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def _levels_sql(name: str, source: str, levels: int) -> str:
    """CTEs ``name``_0 to ``name``_<levels>: the nodes (tree, i, n, h) of ``source`` (tree, i, h), eight to a parent while there are several."""
    parts = [f"{name}_0 AS (SELECT tree, i, count(*) OVER (PARTITION BY tree) AS n, h FROM {source})"]
    for k in range(levels):
        parts.append(
            f"""{name}_{k + 1} AS (
              SELECT tree, i // 8 AS i, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h
              FROM {name}_{k} GROUP BY tree, i // 8
            )"""
        )
    return ", ".join(parts)


def _folds_sql(name: str, source: str, nodes: str, levels: int) -> str:
    """CTEs ``name``_0 to ``name``_<levels>: the rows (id, tree, i, v, proof) of ``source``, folded up the nodes."""
    parts = [f"{name}_0 AS (SELECT id, tree, i, v, proof FROM {source})"]
    for k in range(levels):
        parts.append(
            f"""{name}_{k + 1} AS (
              SELECT f.id, f.tree, f.i // 8 AS i,
                CASE WHEN g.n > 1 THEN sha256(array_to_string(g.hs[1:f.i % 8], '') || f.v || array_to_string(g.hs[f.i % 8 + 2:], '')) ELSE f.v END AS v,
                CASE WHEN g.n > 1 THEN f.proof || array_to_string(g.hs[1:f.i % 8], '') || array_to_string(g.hs[f.i % 8 + 2:], '') ELSE f.proof END AS proof
              FROM {name}_{k} f JOIN (SELECT tree, i // 8 AS p, max(n) AS n, list(h ORDER BY i) AS hs FROM {nodes}_{k} GROUP BY tree, i // 8) g
                ON f.tree = g.tree AND f.i // 8 = g.p
            )"""
        )
    return ", ".join(parts)


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))) + ")"


# Levels of eight: enough for 8^8 documents of a language and 8^3 languages.
LEAF_LEVELS, TOP_LEVELS = 8, 3


@query(
    "op11_manifest",
    f"""
    WITH c AS (
      SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::UBIGINT)),
        lambda acc, b: list_reduce(list_prepend(xor(acc, b), list_transform(range(8), lambda z: 0::UBIGINT)),
          lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::UBIGINT) ELSE r // 2 END)) AS crc
      FROM documents
    ),
    d AS (
      SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf_sql("text")} AS leaf,
        {_leaf_sql("CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS replacement
      FROM c
    ),
    l AS (
      SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf, replacement) - 1 AS i FROM d
    ),
    src AS (SELECT tree, i, leaf AS h FROM l),
    {_levels_sql("a", "src", LEAF_LEVELS)},
    sub AS (SELECT tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM a_{LEAF_LEVELS}),
    tops AS (SELECT '' AS tree, i, h FROM sub),
    {_levels_sql("b", "tops", TOP_LEVELS)},
    given AS (SELECT id, tree, i, replacement AS v, '' AS proof FROM l),
    {_folds_sql("f", "given", "a", LEAF_LEVELS)},
    lifted AS (SELECT f.id, '' AS tree, sub.i, f.v, f.proof FROM f_{LEAF_LEVELS} f JOIN sub ON f.tree = sub.name),
    {_folds_sql("g", "lifted", "b", TOP_LEVELS)}
    SELECT l.doc_id, l.leaf, sub.h AS subroot, r.h AS root, sha256(g.proof) AS proof_sha256, g.v AS folded_root, g.v = r.h AS verified
    FROM l JOIN g_{TOP_LEVELS} g USING (id) JOIN sub ON l.tree = sub.name JOIN b_{TOP_LEVELS} r ON r.tree = ''
    """,
)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.verify(docs, manifest.tampered(docs))


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))
