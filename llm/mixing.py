"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate divided by its quality weight, so the order of keys within a source is a
weighted sample without replacement. A source's target is first met by complete epochs; the rest is the prefix of that
order which fills the remaining budget.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.session import BROADCAST_ROWS, materialize
from llm.common import running, whole_row, words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix-1"


def uniform(doc_id: Column, text: Column) -> Column:
    """A number inside (0, 1) from the id; rows without an id use their text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    top = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), name)), 1, 13), 16, 10).cast("long")
    return (top.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def quality_weight(text: Column, size: Column) -> Column:
    """One for clean prose, less the more symbols there are for a word."""
    body = F.coalesce(text, F.lit(""))
    symbols = F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))
    return F.when(size > 0, size.cast("double") / (size + symbols).cast("double")).otherwise(F.lit(1.0))


def keyed(docs: DataFrame) -> DataFrame:
    """``row`` beside size, sampling key and the source's two key columns (missing flag, text)."""
    return (
        docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.col("text").alias("body"), F.col("source").alias("from"))
        .withColumn("size", size_of(F.col("body")))
        .select(
            "row",
            "id",
            "size",
            F.col("from").isNull().alias("no_source"),
            F.coalesce(F.col("from").cast("string"), F.lit("")).alias("source_key"),
            (-F.log(uniform(F.col("id"), F.col("body"))) / quality_weight(F.col("body"), F.col("size"))).alias("key"),
        )
    )


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


SOURCE = ["no_source", "source_key"]
ORDER = ["key", "id", "size"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table of sources with ``source_size``.

    Sources in order of their names, null last, take the weights in turn and share the total. A share above ``most``
    times the source's size is cut there; what is cut is shared by weight among the others, until none is above. Each
    round is one aggregation over the sources, with exact decimals, and at least one more source reaches its bound.
    """
    order = [F.col("no_source").asc(), F.col("source_key").asc()]
    ranked = running(sizes.withColumn("all", F.lit(0)), ["all"], order, name="rank").drop("all")
    rank = F.col("rank") % len(weights)
    stored = materialize(
        ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank + 1).cast("int")).cast("long")),
        "sources",
    )
    exact = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
    whole, parts = stored.agg(F.sum(exact("source_size")), F.sum(exact("weight"))).first()
    left, shares, bounded = whole, parts, -1

    def at_bound() -> Column:
        return exact("source_size") * most * F.lit(Decimal(shares or 0)) < exact("weight") * F.lit(Decimal(left or 0))

    while whole:
        n, taken, weight = stored.where(at_bound()).agg(F.count("*"), F.sum(exact("source_size") * most), F.sum(exact("weight"))).first()
        if n == bounded:
            break
        bounded, left, shares = n, whole - (taken or 0), parts - (weight or 0)
    share = F.col("weight").cast("double") * F.lit(float(left or 0)) / F.lit(float(shares or 1))
    limit = (F.col("source_size") * most).cast("double")
    return stored.withColumn("target", F.when(at_bound(), limit).otherwise(share))


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with ``before`` (words of their source that come earlier in key order), and the sources with
    ``epochs`` (complete passes) and ``budget`` (words of the last, partial pass)."""
    narrow = materialize(keyed(docs).select("id", "size", *SOURCE, "key"), "mix-keys")
    sizes = narrow.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    sources = (
        targets(sizes)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", goal - F.col("epochs") * F.col("source_size"))
    )
    order = [F.col("key").asc(), F.col("id").asc_nulls_last(), F.col("size").asc()]
    return running(narrow, SOURCE, order, "size"), materialize(sources, "mix-sources")


def mix(docs: DataFrame) -> DataFrame:
    """The manifest of the mix: one row for each document, with ``taken``, the words that the mix takes from it.

    Null text has size 0 and takes 0; a null source is a source of its own, after all others; repeated rows are
    taken one by one, in any order among equals. The document at the end of a source's budget is taken in part, so
    that the source meets its target to the word.
    """
    ordered, sources = plan(docs)
    last = F.least(F.greatest(F.col("budget") - F.col("before"), F.lit(0)), F.col("size"))
    return ordered.join(sources, SOURCE).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        F.when(~F.col("no_source"), F.col("source_key")).alias("source"),
        "epochs",
    )


def resample(docs: DataFrame) -> DataFrame:
    """The rows of the mix: every document as often as the mix takes it. Documents stay whole: the one at the end of
    a budget is taken once more if at least half of it fits. Rows of equal key, id and size are treated alike.

    Only each source's last key is joined to the documents, so texts are not shuffled while the sources are few
    enough to broadcast (they are counted).
    """
    ordered, sources = plan(docs)
    inside = (F.col("budget") > F.col("before")) & (2 * (F.col("budget") - F.col("before")) >= F.col("size"))
    order = F.struct(F.col("key"), F.col("id").isNull().alias("no_id"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("size"))
    ends = ordered.join(sources, SOURCE).where(inside).groupBy(*SOURCE).agg(F.max(order).alias("end"))
    bounds = materialize(sources.select(*SOURCE, "epochs").join(ends, SOURCE, "left"), "mix-bounds")
    few = bounds.count() <= BROADCAST_ROWS
    copies = F.col("epochs") + F.when(order <= F.col("end"), F.lit(1)).otherwise(F.lit(0))
    return (
        keyed(docs)
        .join(F.broadcast(bounds) if few else bounds, SOURCE)
        .withColumn("copies", copies)
        .where(F.col("copies") > 0)
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select("row.*")
    )
