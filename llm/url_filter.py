"""URL rules by a sort-merge range join.

A host's labels are reversed ("blog.example.org" becomes "org.example.blog."), so that a host and all its subdomains
share a prefix: every rule is an interval of keys, and intervals are nested or apart. Rules and urls are range-sorted
together; one sweep over each range keeps a stack of the rules whose interval is open. Rules opened before a range
begins are found by the prefixes of its first key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.session import materialize
from llm.common import shuffle_partitions

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


class _Open:
    """An open interval: the rules of one host, by path."""

    def __init__(self, key: str) -> None:
        self.key, self.rules, self.sizes = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        self.rules[path] = (len(host) + len(path), len(host), host + path, verdict)
        self.sizes = sorted({len(p) for p in self.rules}, reverse=True)

    def best(self, path: str):
        for size in self.sizes:
            if size <= len(path) and (found := self.rules.get(path[:size])):
                return found
        return None


def _sweep(default: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Open] = []
        now = None
        for batch in batches:
            ids, hosts, paths, names, verdicts = [], [], [], [], []
            for place, key, kind, page, host, path, verdict in zip(
                batch["place"], batch["key"], batch["kind"], batch["page_id"], batch["host"], batch["path"], batch["verdict"]
            ):
                if place != now:
                    stack, now = [], place
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(host, path, verdict)
                    continue
                found = max((r for r in (o.best(path) for o in stack) if r), default=None)
                ids.append(page)
                hosts.append(host)
                paths.append(path)
                names.append(found[2] if found else None)
                verdicts.append(found[3] if found else default)
            columns = {"page_id": ids, "host": hosts, "path": paths, "rule": names, "verdict": verdicts}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``; ``rules`` has host, path and verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; of the rules that fit,
    that with the longest host and path together wins, then that with the longer host. A rule given twice counts once
    (its smallest verdict). Without a rule the verdict is ``default``. A null url, or one without "://", has empty host
    and path. Repeated rows and null ids are judged like any other.
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    kind_of = dict(pages.dtypes)["page_id"]
    given = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    opened = given.select(key_of(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(kind_of).alias("page_id"), "host", "path", "verdict")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    # A host with many pages is split by path and id over several ranges.
    order = ["key", "kind", "path", "page_id"]
    dealt = materialize(opened.unionByName(urls).repartitionByRange(n, *order).withColumn("place", F.spark_partition_id()), "url-ranges")
    # One row for each range, and one for each label of its first host.
    firsts = dealt.groupBy("place").agg(F.min("key").alias("first"))
    labels = F.split("first", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit(".")))
    carried = firsts.select("place", F.explode(prefixes).alias("key")).join(opened, "key").select(*dealt.columns)
    swept = dealt.unionByName(carried).repartition(n, "place").sortWithinPartitions("place", *order)
    schema = f"page_id {kind_of}, host string, path string, rule string, verdict string"
    # Ids travel as text, so that nulls do not turn whole numbers into floats.
    return (
        swept.withColumn("page_id", F.col("page_id").cast("string"))
        .mapInPandas(_sweep(default), schema.replace(f"page_id {kind_of}", "page_id string", 1))
        .withColumn("page_id", F.col("page_id").cast(kind_of))
    )
