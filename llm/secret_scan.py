"""Secret scans over an incremental blob ledger.

Every historical version of every path is named by the SHA-256 of its content. A blob is scanned once for each rule
version, wherever it occurs; findings are kept in a ledger (a Parquet folder that is only appended to) and joined back
to all paths that hold the blob. A later scan reads only blobs, or rules, that the ledger has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.session import materialize, scratch_path
from llm.common import bind, whole_row


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1  # characters of the group; shorter matches are dropped
    needs: tuple[str, ...] = ()  # a text without any of these has no match

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values. No pattern repeats a group of varying length other than possessively: Java would match it by recursion and
# end the process on a long text. The runs of "access" and "hex" are cut at their least length within the pattern, which finds the same
# matches as filtering whole runs, without listing every short run of a text.
BASE = (
    Rule("assign", 1, r"""(?=[pstaPSTA])(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, (":", "=")),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", needs=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z0-9]+ )*+PRIVATE KEY-----", needs=("-----BEGIN ",)),
    Rule("github", 1, r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}", needs=("_",)),
    Rule("slack", 1, r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", needs=("eyJ",)),
)
RULES = BASE + ADDED


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the UTF-8 text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def running_sums(values: Column, block: int = 256) -> Column:
    """Sums of a long array up to and with each place. An array grows by copying, so sums are taken in blocks first."""
    empty = F.array().cast("array<bigint>")

    def short(part: Column) -> Column:
        return F.aggregate(part, empty, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + v)))

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block) - 1, F.lit(0)).cast("int")), lambda i: F.slice(values, i * block + 1, F.lit(block))
    )
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, v: acc + v)
    return bind(
        blocks,
        lambda b: bind(
            short(F.transform(b, total)),
            lambda t: F.flatten(F.transform(b, lambda part, i: bind(F.get(t, i) - total(part), lambda before: F.transform(short(part), lambda v: v + before)))),
        ),
    )


def find(text: Column, rule: Rule) -> Column:
    """Spans (start, stop) of a rule in a text that is not null, in code points.

    The text is split at the matches; a match starts where the pieces and matches before it end.
    """
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    pattern = F.lit(rule.pattern)

    def placed(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda p: p["before"] + p["length"]))
        return bind(
            F.zip_with(ends, parts, lambda end, p: end - p["length"]),
            lambda s: F.transform(
                F.filter(
                    F.transform(
                        parts,
                        lambda p, i: F.struct(
                            F.get(s, i).alias("start"), p["size"].alias("size"), (F.get(s, i) + p["length"]).alias("stop")
                        ),
                    ),
                    lambda x: x["size"] >= rule.least,
                ),
                lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")),
            ),
        )

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = bind(
        F.struct(F.split(text, rule.pattern, -1).alias("pieces"), found.alias("found"), groups.alias("groups")),
        lambda x: F.transform(
            x["found"],
            lambda m, i: F.struct(
                F.length(F.get(x["pieces"], i)).cast("long").alias("before"),
                F.length(m).cast("long").alias("length"),
                F.length(F.get(x["groups"], i)).alias("size"),
            ),
        ),
    )
    may = F.lit(True)
    for i, needed in enumerate(rule.needs):
        may = F.contains(text, F.lit(needed)) if i == 0 else may | F.contains(text, F.lit(needed))
    return F.when(may & text.rlike(rule.pattern), bind(parts, placed)).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def scan(contents: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at ``path`` lacks and appends it; returns the ledger's entries for ``rules``.

    ``contents`` has ``text``; null counts as empty. The result has one row for each blob ever scanned: ``blob`` and
    ``spans``, sorted by start and then by the rule's place in ``rules``. The shuffle by blob keeps one text of a group of
    copies for each task before it moves, so a blob that fills a third of the table is no hot group.
    """
    spark = contents.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = (
        contents.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .select(blob_of(F.col("text")).alias("blob"), "text")
        .groupBy("blob")
        .agg(F.first("text").alias("text"))
    )
    known = read_ledger(spark, path)
    if known is None:
        unseen = blobs.withColumn("todo", names)
    else:
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = F.array_except(names, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
        unseen = blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
    text = F.col("text")
    none = F.array().cast("array<struct<rule:string,start:bigint,stop:bigint>>")

    def findings(rule: Rule) -> Column:
        named = lambda x: F.struct(F.lit(rule.name).alias("rule"), x["start"].alias("start"), x["stop"].alias("stop"))
        return F.when(F.array_contains("todo", rule.name), F.transform(find(text, rule), named)).otherwise(none)

    scanned = unseen.select("blob", F.col("todo").alias("rules"), F.concat(*[findings(r) for r in rules]).alias("findings"))
    scanned.write.mode("append").parquet(path)
    return entries(spark, path, rules)


def entries(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and its ``spans`` (start, kind number, stop) under the given rule versions."""
    stored = read_ledger(spark, path)
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    wanted = F.filter("findings", lambda x: F.array_contains(F.array(*[F.lit(r.name) for r in rules]), x["rule"]))
    spans = F.transform(
        wanted, lambda x: F.struct(x["start"].alias("start"), F.element_at(number, x["rule"]).alias("kind"), x["stop"].alias("stop"))
    )
    # A blob has a row for each batch of rules that it was scanned with.
    return stored.select("blob", spans.alias("spans")).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans and all spans.

    A null text is empty and has none; repeated rows have equal results. Without ``path`` the ledger is a new folder.
    """
    ledger = scan(docs.select("text"), path or scratch_path(docs.sparkSession, "secret-ledger"))
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))

    def of_kind(number: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == number)).cast("long")

    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    findings = ledger.select("blob", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    # Findings are stored, so that nothing but the join needs a blob's rows together and a hot blob's paths are split.
    return paths.join(materialize(findings, "findings"), "blob").drop("blob")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with the union of its spans replaced by ``mask``."""
    fresh = lambda x: F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop")))
        return F.when(F.size(acc) == 0, fresh(x)).otherwise(
            F.when(x["start"] < last["stop"], F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.concat(acc, fresh(x)))
        )

    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), join)
    part = lambda start, stop: F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))
    pieces = lambda m: F.concat(
        F.transform(m, lambda x, i: part(F.coalesce(F.get(m, i - 1)["stop"], F.lit(0).cast("long")), x["start"])),
        F.array(part(F.element_at(m, -1)["stop"], F.length(text).cast("long"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(bind(merged, pieces), mask))


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with secrets masked; rows without findings stay as they are. ``n_chars`` follows the text."""
    ledger = scan(docs.select("text"), path or scratch_path(docs.sparkSession, "secret-ledger"))
    ledger = materialize(ledger.where(F.size("spans") > 0), "findings")
    joined = docs.select(whole_row(docs), blob_of(F.col("text")).alias("blob")).join(ledger, "blob", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>"))
    changed = joined.select("row", spans.alias("spans"), masked(F.col("row.text"), spans).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return changed.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
