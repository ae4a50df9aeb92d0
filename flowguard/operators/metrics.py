"""Classification quality. Every function scores all groups of ``by`` in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.functions.columns import fixed_text, ratio
from flowguard.operators.prefix import ROWS_PER_BUCKET, bucket_offsets, running_totals, value_splits, within_bucket
from flowguard.operators.quantiles import bucketed
from flowguard.session import driver_rows, materialize


def _labelled_counts(y: str, pred: str) -> dict[str, Column]:
    truth, guess = F.col(y) == 1, F.col(pred) == 1
    return {
        "tp": F.count_if(truth & guess),
        "fp": F.count_if(~truth & guess),
        "fn": F.count_if(truth & ~guess),
        "tn": F.count_if(~truth & ~guess),
    }


def _binary_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "f1": ratio(tp * 2, tp * 2 + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
    }


def binary_metrics(
    df: DataFrame, y: str, pred: str, score: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """accuracy, f1, precision, recall and, with a score, auroc; 0 where a ratio is undefined."""
    counts = df.groupBy(*by).agg(*[c.alias(n) for n, c in _labelled_counts(y, pred).items()])
    table = counts.select(*by, *[c.alias(n) for n, c in _binary_columns().items()])
    if score is None:
        return table
    areas = auroc(df, y, score, by)
    if by:
        return table.join(areas, list(by), "left")
    return table.withColumn("one", F.lit(1)).join(areas.withColumn("one", F.lit(1)), "one").drop("one")


def score_counts(
    df: DataFrame, y: str, score: str, by: Sequence[str], rows_per_bucket: int
) -> tuple[DataFrame, bool]:
    """Positive and negative rows per distinct score with the score's bucket; tells if there are several buckets."""
    rows = df.select(*by, F.col(y).alias("y"), F.col(score).cast("double").alias("score"))
    splits = value_splits(rows, ["score"], rows_per_bucket)
    counts = rows.groupBy(*by, "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")
    )
    return bucketed(counts, "score", splits, "bucket"), bool(splits)


def auroc(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """P(score of a positive > score of a negative) + half of the ties; null for a single class."""
    counts, _ = score_counts(df, y, score, by, rows_per_bucket)
    below = F.coalesce(F.sum("neg").over(within_bucket(by, "score", inclusive=False)), F.lit(0))
    buckets = (
        counts.withColumn("won", F.col("pos") * (below.cast("double") + F.col("neg") / F.lit(2.0)))
        .groupBy(*by, "bucket")
        .agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    offsets = bucket_offsets(buckets, by, {"neg_before": "neg"})
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    won = F.sum(F.col("won") + F.col("pos").cast("double") * F.col("neg_before"))
    return offsets.groupBy(*by).agg(F.try_divide(won, pairs).alias("auroc"))


def roc_points(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score: the rates of rows with score >= threshold."""
    counts, several = score_counts(df, y, score, by, rows_per_bucket)
    if several:
        # The distinct scores are read three times.
        counts = materialize(counts, "score-counts")
    joined = running_totals(counts, by, "score", {"pos_below": "pos", "neg_below": "neg"}, several)
    if not several:
        group = Window.partitionBy(*by, "bucket")
        joined = joined.withColumns({f"{n}_all": F.sum(n).over(group) for n in ("pos", "neg")})
    elif by:
        totals = counts.groupBy(*by).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
        joined = joined.join(totals, list(by))
    else:
        row = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        joined = joined.withColumns({"pos_all": F.lit(row.pos), "neg_all": F.lit(row.neg)})
    rate = {n: (F.col(f"{n}_all") - F.col(f"{n}_below")).cast("double") for n in ("pos", "neg")}
    return joined.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(rate["neg"], F.col("neg_all").cast("double")).alias("fpr"),
        F.try_divide(rate["pos"], F.col("pos_all").cast("double")).alias("tpr"),
    )


def confusion_counts(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def per_class_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """support, predicted, tp, precision, recall, f1 per class of the union of true and predicted classes."""
    counts = confusion_counts(df, y, pred, by)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("tp")),
            F.struct(F.col("p").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
        )
    )
    table = (
        counts.select(*by, sides.alias("s"))
        .groupBy(*by, F.col("s.cls").alias("cls"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")])
    )
    return table.withColumns(
        {
            "precision": ratio("tp", "predicted"),
            "recall": ratio("tp", "support"),
            "f1": ratio(F.col("tp") * 2, F.col("support") + F.col("predicted")),
        }
    )


def multiclass_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, f1_weighted, f1_macro, precision_weighted, recall_weighted out of confusion counts."""
    table = per_class_metrics(df, y, pred, by)
    rows = F.sum("support")

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("support")), rows)

    return table.groupBy(*by).agg(
        ratio(F.sum("tp"), rows).alias("accuracy"),
        weighted("f1").alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
    )


def auroc_ovr(df: DataFrame, y: str, scores: str, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest areas weighted by class prevalence; ``scores`` is an array indexed by class id.

    Null unless more than two classes occur.
    """
    long = df.select(*by, F.col(y).alias("y"), F.posexplode(scores).alias("cls", "score")).withColumn(
        "hit", (F.col("y") == F.col("cls")).cast("int")
    )
    areas = auroc(long, "hit", "score", [*by, "cls"])
    support = df.groupBy(*by, F.col(y).alias("cls")).agg(F.count("*").alias("support"))
    joined = support.join(areas, [*by, "cls"])
    value = ratio(F.sum(F.col("auroc") * F.col("support")), F.sum("support"))
    return joined.groupBy(*by).agg(F.when(F.count("*") > 2, value).alias("auroc_ovr_weighted"))


def evaluate_auto(df: DataFrame, y: str, pred: str, scores: str | None = None) -> DataFrame:
    """Multiclass metrics, plus the area that fits the number of true classes."""
    table = multiclass_metrics(df, y, pred)
    if scores is None:
        return table
    classes = len(driver_rows(df.select(y).distinct(), "classes"))
    if classes > 2:
        area = auroc_ovr(df, y, scores)
    else:
        area = auroc(df.withColumn("second", F.element_at(scores, 2)), y, "second")
    return table.withColumn("one", F.lit(1)).join(area.withColumn("one", F.lit(1)), "one").drop("one")


def confusion_matrix(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(y, p, n) for every pair of occurring classes, zeros included."""
    counts = confusion_counts(df, y, pred)
    classes = driver_rows(
        counts.select(F.explode(F.array("y", "p")).alias("c")).distinct(), "classes", limit=5000
    )
    labels = sorted(r.c for r in classes)
    grid = (
        df.sparkSession.createDataFrame([(c,) for c in labels], f"y {counts.schema['y'].dataType.simpleString()}")
        .withColumn("p", F.explode(F.array(*[F.lit(c) for c in labels])))
        .withColumn("p", F.col("p").cast(counts.schema["p"].dataType))
    )
    return grid.join(counts, ["y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_accuracy(df: DataFrame, group: str, y: str, pred: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def fold_f1(df: DataFrame, y: str, pred: str, by: Sequence[str]) -> DataFrame:
    """2·TP / max(predicted + actual positives, 1) and the predicted attack rate per fold."""
    both = F.count_if((F.col(y) == 1) & (F.col(pred) == 1)).cast("double") * 2
    either = F.greatest(F.count_if(F.col(y) == 1) + F.count_if(F.col(pred) == 1), F.lit(1))
    return df.groupBy(*by).agg(
        F.count("*").alias("heldout_rows"),
        (both / either.cast("double")).alias("f1"),
        F.avg((F.col(pred) == 1).cast("double")).alias("attack_rate_pred"),
    )


def metric_rows(table: DataFrame, model: str) -> DataFrame:
    """A one-row metric table as (model, metric, value)."""
    return table.unpivot([], table.columns, "metric", "value").select(F.lit(model).alias("model"), "metric", "value")


def evaluate_bundle(
    df: DataFrame,
    classes: tuple[str, str, str],
    hybrid: tuple[str, str, str],
    fusion: tuple[str, str, str],
) -> DataFrame:
    """Baseline multiclass, hybrid binary and fusion binary metrics as (model, metric, value).

    Each argument names the true, predicted and score columns of its model.
    """
    baseline = multiclass_metrics(df, *classes[:2]).withColumn("one", F.lit(1))
    areas = auroc_ovr(df, classes[0], classes[2]).withColumn("one", F.lit(1))
    parts = [
        metric_rows(baseline.join(areas, "one").drop("one"), "baseline_multiclass"),
        metric_rows(binary_metrics(df, *hybrid), "hybrid_binary"),
        metric_rows(binary_metrics(df, *fusion), "fusion_binary"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Fixed value: first line of a report, before its title.
REPORT_HEADING = "# Experiment Report: "


def report_lines(metrics: DataFrame, artifacts: DataFrame, title: Column | str, by: Sequence[str]) -> DataFrame:
    """The text report of each run as ordered lines: three metric blocks and the artifact list.

    ``metrics`` is (by, model, position, metric, value); ``artifacts`` is (by, position, name, location).
    """
    # Headings of the report.
    headings = {
        "baseline_multiclass": "### Baseline Multiclass (XGBoost)",
        "hybrid_binary": "### Hybrid Binary (Dual Consistency)",
        "fusion_binary": "### Fusion Binary",
    }
    block = F.lit(None).cast("int")
    for i, model in enumerate(headings):
        block = F.when(F.col("model") == model, i + 1).otherwise(block)
    metric_lines = metrics.select(
        *by,
        block.alias("block"),
        F.col("position").alias("position"),
        F.concat(F.lit("- "), "metric", F.lit(": "), fixed_text("value", 6)).alias("line"),
    )
    artifact_lines = artifacts.select(
        *by, F.lit(4).alias("block"), "position", F.format_string("- %s: %s", "name", "location").alias("line")
    )
    fixed = list(enumerate([*headings.values(), "### Artifacts"], start=1))
    runs = metrics.select(*by, (title if isinstance(title, Column) else F.col(title)).alias("title")).distinct()
    frame = runs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("block"), F.lit(0).alias("position"), F.concat(F.lit(REPORT_HEADING), "title").alias("line")),
                *[F.struct(F.lit(b).alias("block"), F.lit(-2).alias("position"), F.lit("").alias("line")) for b, _ in fixed],
                *[F.struct(F.lit(b).alias("block"), F.lit(-1).alias("position"), F.lit(h).alias("line")) for b, h in fixed],
            )
        ).alias("l"),
    ).select(*by, "l.*")
    return metric_lines.unionByName(artifact_lines).unionByName(frame)


def report_documents(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, report): the lines of ``report_lines`` as one text for each run. It has as many lines as its run has metrics and artifacts."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "position", "line")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("report"))


def document_lines(reports: DataFrame, report: str = "report") -> DataFrame:
    """(run_name, line_no, line) of report texts; the run's name is read from the heading."""
    lines = F.split(report, "\n")
    name = F.substring(lines[0], len(REPORT_HEADING) + 1, 2**31 - 1)
    return reports.select(name.alias("run_name"), F.posexplode(lines).alias("at", "line")).select(
        "run_name", (F.col("at") + 1).alias("line_no"), "line"
    )
