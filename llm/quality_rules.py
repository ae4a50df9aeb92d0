"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per failed rule, so that a
policy (a versioned set of rules) is a bitwise test over the ledger, and the effect of leaving a rule out is a count
over distinct bit patterns; the texts are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bind, whole_row, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# The position of a rule is its bit in the ledger: rules are appended, never moved.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_words", "n_words > 100000"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
# Mean word length differs between languages, so the release policy leaves those two rules to the ledger.
RELEASE = Policy("release-1", ("few_words", "repeated_words", "symbols", "repeated_lines"))
STRICT = Policy("strict-1", tuple(name for name, _ in RULES))


def _repeated(found: Column) -> Column:
    """Words that lie in a window of eight found twice or more. Windows are told apart by a 64-bit hash."""
    # A window's hash is made of the hashes of its halves, each of which is a hash of halves again.
    def paired(parts: Column, reach: int) -> Column:
        return bind(parts, lambda p: F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + reach))))

    hashes = bind(
        paired(paired(paired(found, 1), 2), 4),
        lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
    )

    def covered(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])

        # A window reaches to the next repeated one or over its own eight words.
        return bind(
            F.sort_array(bind(in_order, twice)),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.get(p, i + 1) - x, F.lit(WINDOW)).cast("long")),
                F.lit(0).cast("long"),
                lambda total, n: total + n,
            ),
        )

    return bind(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` as the struct ``row``, beside the measures. Null text counts as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = df.select(
        whole_row(df),
        body.alias("body"),
        words(body).alias("found"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return split.select(
        "row",
        F.size("found").cast("long").alias("n_words"),
        F.length(F.array_join("found", "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("found")).alias("n_repeat_words"),
    )


def failed_bits() -> Column:
    """One bit for every rule, set where it fails. Needs the measures."""
    bits = F.lit(0).cast("long")
    for name, test in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of the input), the measures and ``failed`` (bits), one row for each row of the input.

    Null or empty text has no words and fails ``few_words``. Repeated rows are judged alike, an empty table gives
    an empty ledger.
    """
    return measured(df, text).withColumn("failed", failed_bits())


def passes(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def accepted(docs: DataFrame, policy: Policy = RELEASE) -> DataFrame:
    """The rows that pass a policy, with the columns they came with."""
    return ledger(docs).where(passes(policy)).select("row.*")


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of a policy: documents that fail it, and those that only this rule rejects.

    Only distinct bit patterns (at most two to the number of rules) are shuffled.
    """
    patterns = entries.groupBy("failed").agg(F.count("*").alias("documents"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    within = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    return (
        patterns.select("failed", "documents", rules.alias("r"))
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(within.bitwiseAND(F.col("r.bit")) != 0, F.col("documents")).otherwise(0)).alias("failed"),
            F.sum(F.when(within == F.col("r.bit"), F.col("documents")).otherwise(0)).alias("rejected_alone"),
        )
    )
