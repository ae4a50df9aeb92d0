"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are a text's paragraphs, long ones cut into passages; inner nodes are paragraphs (lines) and sections (runs of
lines, ended where a line's own digest says so, hence stable under edits elsewhere); the root covers the sections. Equal
roots mean equal texts; where roots differ, differing branches lead to the changed leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import bind, shuffle_partitions, whole_row

# A passage ends at a line break, a sentence mark or after 120 characters; every character belongs to one passage.
PASSAGE = r"[^\n.!?|]{1,120}[\n.!?|]*|[\n.!?|]+"
SECTION_END = "0"  # first hex digit of the last line's digest: one line in sixteen ends a section


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def tree(text: Column) -> Column:
    """Struct of root, sections, lines and leaves; ``leaves`` is null-free, empty for an empty text.

    Levels are strings of digests: "," parts the members of a node and ";" parts the nodes.
    """
    passages = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PASSAGE), F.lit(0))

    def grouped(items: Column, ends) -> Column:
        """Digests, each followed by ";" where its item ends a node and else by ","."""
        return F.array_join(F.transform(items, lambda x: F.concat(x["digest"], F.when(ends(x), F.lit(";")).otherwise(F.lit(",")))), "")

    def nodes(level: Column) -> Column:
        return F.transform(
            F.array_remove(F.split(level, ";"), ""), lambda x: F.struct(_digest(x).alias("digest"))
        )

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["digest"]), ",")

    leaves = F.transform(passages, lambda x: F.struct(_digest(x).alias("digest"), F.endswith(x, F.lit("\n")).alias("last")))
    return bind(
        leaves,
        lambda found: bind(
            grouped(found, lambda x: x["last"]),
            lambda leaf_level: bind(
                nodes(leaf_level),
                lambda lines: bind(
                    nodes(grouped(lines, lambda x: F.startswith(x["digest"], F.lit(SECTION_END)))),
                    lambda sections: F.struct(
                        F.sha2(F.concat_ws("/", joined(sections), leaf_level), 256).alias("root"),
                        joined(sections).alias("sections"),
                        joined(lines).alias("lines"),
                        leaf_level.alias("leaf_level"),
                        F.array_distinct(F.transform(found, lambda x: x["digest"])).alias("leaves"),
                    ),
                ),
            ),
        ),
    )


def spelled(node: Column) -> Column:
    """The tree as one string, levels from the root down."""
    return F.concat_ws("/", node["root"], node["sections"], node["lines"], node["leaf_level"])


def likeness(a: Column, b: Column) -> Column:
    """One for equal roots, else the share of distinct leaves that both trees hold (Dice)."""
    common = F.size(F.array_intersect(a["leaves"], b["leaves"])).cast("double")
    both = (F.size(a["leaves"]) + F.size(b["leaves"])).cast("double")
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.lit(2.0) * common / both)


def changed_leaves(a: Column, b: Column) -> Column:
    """Places (0-based) of the leaves of ``a`` that ``b`` does not hold, none when the roots are equal."""
    digests = lambda t: F.array_remove(F.split(t["leaf_level"], "[,;]"), "")
    places = F.transform(digests(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(
        bind(b["leaves"], lambda held: F.transform(F.filter(places, lambda p: ~F.array_contains(held, p["x"])), lambda p: p["i"]))
    )


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``row``, its text (null as empty) and ``next_text``, the text of the next document by doc_id; the first follows
    the last. Rows without an id come last; rows with equal ids are ordered by a hash of the text.

    Ids are cut into ranges at quantiles, texts move once, to their range. The first row of every range is also sent to
    the range before it, where the last row needs it.
    """
    spark = docs.sparkSession
    n = buckets or 4 * shuffle_partitions(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(whole_row(docs), F.col("doc_id").alias("id"), body.alias("body"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # The cut points are searched in two steps, so that a row costs about the root of their number.
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    id_ = F.col("id")

    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda c: c <= id_))

    if groups:
        outer = F.array(*[F.lit(g[0]) for g in groups])
        inner = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
        place = bind(below(outer), lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * width + below(F.get(inner, g - 1))))
    else:
        place = F.lit(0)
    tie = F.xxhash64("body")
    keyed = plain.withColumn("tie", tie).withColumn(
        "bucket", F.when(id_.isNull(), F.lit(len(cuts) + 1) + F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))), 60).cast("int")).otherwise(place)
    )
    order = F.struct(F.col("id"), F.col("tie"))
    heads = sorted(keyed.groupBy("bucket").agg(F.min(order).alias("head")).collect())
    if not heads:
        return plain.select("row", "body", F.col("body").alias("next_text"))
    before = {h.bucket: heads[i - 1].bucket for i, h in enumerate(heads)}
    first = spark.createDataFrame(
        [(h.bucket, h.head.id, h.head.tie, before[h.bucket]) for h in heads], f"bucket int, id {dict(docs.dtypes)['doc_id']}, tie bigint, earlier int"
    )
    # One row for each range: as many as there are cut points.
    guests = keyed.join(
        F.broadcast(first.withColumnRenamed("id", "head_id").withColumnRenamed("tie", "head_tie").withColumnRenamed("bucket", "head_bucket")),
        (F.col("bucket") == F.col("head_bucket")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")),
        "left",
    )
    copy = lambda b, guest: F.struct(b.alias("bucket"), F.lit(guest).alias("guest"))
    own = copy(F.col("bucket"), 0)
    sent = guests.select(
        "row", "id", "tie", "body",
        F.explode(F.when(F.col("earlier").isNull(), F.array(own)).otherwise(F.array(own, copy(F.col("earlier"), 1)))).alias("to"),
    ).select("row", "id", "tie", "body", "to.*")
    w = Window.partitionBy("bucket").orderBy(F.col("guest").asc(), F.col("id").asc_nulls_last(), F.col("tie").asc())
    return sent.withColumn("next_text", F.lead("body").over(w)).where(F.col("guest") == 0).select("row", "body", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many from the start of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both, and of the next document.

    A null text is empty. Two empty texts are equal, so their likeness is 1.
    """
    texts = with_next(docs).select(
        F.col("row.doc_id").alias("doc_id"), "body", "next_text", edited(F.col("body"), F.col("next_text")).alias("changed")
    )
    trees = texts.select(
        "doc_id",
        F.length("body").cast("long").alias("n_chars"),
        F.sha2("changed", 256).alias("edited_sha256"),
        tree(F.col("body")).alias("own"),
        tree(F.col("changed")).alias("changed"),
        tree(F.col("next_text")).alias("following"),
    )
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
