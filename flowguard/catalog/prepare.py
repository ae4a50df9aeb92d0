"""Preprocessing, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.registration import query, r6
from flowguard.config import PrepConfig
from flowguard.functions.columns import rounded
from flowguard.operators import prep, splits
from flowguard.operators.ordering import shuffle_rank as shuffle_ranks
from flowguard.plans.flow import prepare
from flowguard.plans.views import FLOW_FEATURES, TRAFFIC_FEATURES, view, with_views
from flowguard.session import materialize, scratch_path
from flowguard.sources import stores


# ---- SQL building blocks -------------------------------------------------------------------------


def split_sql(source: str) -> str:
    """Named queries ending in ``splits``: the source rows with their split."""
    return f"""strata AS (SELECT label, count(*) AS n FROM {source} GROUP BY label),
sized AS (SELECT label, n, CAST(sum(n) OVER () AS BIGINT) AS size,
  CAST(sum(n) OVER () - ceil(0.2 * sum(n) OVER ()) AS BIGINT) AS rest FROM strata),
kept0 AS (SELECT *, (n * rest) // size AS low,
  row_number() OVER (ORDER BY (n * rest) % size DESC, label) AS pos FROM sized),
kept1 AS (SELECT label, n, rest, low + CASE WHEN pos <= rest - sum(low) OVER () THEN 1 ELSE 0 END AS kept FROM kept0),
train0 AS (SELECT *, CAST(rest - ceil(0.125 * rest) AS BIGINT) AS goal FROM kept1),
train1 AS (SELECT *, (kept * goal) // rest AS low,
  row_number() OVER (ORDER BY (kept * goal) % rest DESC, label) AS pos FROM train0),
quota AS (SELECT label, n - kept AS n_test,
  kept - (low + CASE WHEN pos <= goal - sum(low) OVER () THEN 1 ELSE 0 END) AS n_val FROM train1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY md5(concat_ws('|', '42', CAST(row_key AS VARCHAR))), CAST(row_key AS VARCHAR)) AS rn FROM {source}),
splits AS (SELECT ranked.* EXCLUDE (rn), CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_val THEN 'val'
  ELSE 'train' END AS split FROM ranked JOIN quota USING (label))"""


def prep_sql(train: str, rows: str, features: list[str], keep: str) -> str:
    """Named queries ending in ``transformed``: ``rows`` by the statistics of ``train``."""

    def per(template: str) -> str:
        return ", ".join(template.format(f=f) for f in features)

    return f"""fills AS (SELECT {per("quantile_cont({f}, 0.5) AS fill_{f}")} FROM {train}),
imputed AS (SELECT {per("coalesce({f}, fill_{f}) AS {f}")} FROM {train}, fills),
bounds AS (SELECT {per("quantile_cont({f}, 0.001) AS lo_{f}, quantile_cont({f}, 0.999) AS hi_{f}")} FROM imputed),
clipped AS (SELECT {per("least(greatest({f}, lo_{f}), hi_{f}) AS {f}")} FROM imputed, bounds),
scales AS (SELECT {per("avg({f}) AS mean_{f}, stddev_pop({f}) AS std_{f}")} FROM clipped),
transformed AS (SELECT {keep}, {per("(least(greatest(coalesce({f}, fill_{f}), lo_{f}), hi_{f}) - mean_{f}) / CASE WHEN std_{f} = 0 THEN 1 ELSE std_{f} END AS {f}")}
  FROM {rows}, fills, bounds, scales)"""


FOLDS_SQL = """attacks AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS fold, label AS held_out_attack
  FROM (SELECT DISTINCT label FROM traffic WHERE label <> 'benign')),
benign AS (SELECT fold, row_key AS benign_key, row_number() OVER (PARTITION BY fold ORDER BY
    md5(concat_ws('|', CAST(fold + 42 AS VARCHAR), CAST(row_key AS VARCHAR))), CAST(row_key AS VARCHAR)) AS rn,
    ceil(0.3 * count(*) OVER (PARTITION BY fold)) AS n_test
  FROM traffic, attacks WHERE label = 'benign'),
folds AS (SELECT a.fold, a.held_out_attack, t.row_key, t.label, t.f_k,
    CASE WHEN t.label = 'benign' THEN CASE WHEN b.rn <= b.n_test THEN 'test' ELSE 'train' END
      WHEN t.label = a.held_out_attack THEN 'test' ELSE 'train' END AS role
  FROM traffic t CROSS JOIN attacks a LEFT JOIN benign b ON b.fold = a.fold AND b.benign_key = t.row_key)"""


def round_all(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


def rounded_sql(names: list[str]) -> str:
    return ", ".join(f"{r6(n)} AS {n}" for n in names)


# ---- fit / transform -----------------------------------------------------------------------------


@query(
    "impute_fit",
    with_views("traffic")
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r6(f"quantile_cont({f}, 0.5)")} AS median, {r6(f"avg({f})")} AS mean,
  (SELECT {f} FROM traffic WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1) AS most_frequent,
  -1.0E0 AS constant FROM traffic"""
        for f in TRAFFIC_FEATURES
    ),
)
def impute_fit(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    fits = {
        s: prep.fit_impute(traffic, TRAFFIC_FEATURES, PrepConfig(impute_strategy=s, impute_constant=-1.0))
        for s in ("median", "mean", "most_frequent", "constant")
    }
    rows = [
        (f, *[fits[s].features[i].fill for s in ("median", "mean", "most_frequent", "constant")])
        for i, f in enumerate(TRAFFIC_FEATURES)
    ]
    table = spark.createDataFrame(rows, "feature string, median double, mean double, most_frequent double, constant double")
    return round_all(table, ["median", "mean"])


@query(
    "impute_apply",
    with_views("traffic")
    + "SELECT row_key, coalesce(f_value, (SELECT quantile_cont(f_value, 0.5) FROM traffic)) AS f_value, f_user FROM traffic",
)
def impute_apply(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    params = prep.fit_impute(traffic, ["f_value", "f_user"])
    return prep.transform(traffic, params, keep=["row_key"])


def _flow_prep(rest: str) -> str:
    return with_views("flows", rest=prep_sql("flows", "flows", FLOW_FEATURES, "row_key, label")) + rest


@query(
    "clip_fit",
    _flow_prep(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {r6(f'lo_{f}')} AS lower, {r6(f'hi_{f}')} AS upper FROM bounds" for f in FLOW_FEATURES
        )
    ),
)
def clip_fit(spark, sf_dir):
    flows = view(spark, sf_dir, "flows")
    params = prep.fit_clip(flows, prep.fit_impute(flows, FLOW_FEATURES))
    return round_all(params.to_frame(spark).select("feature", "lower", "upper"), ["lower", "upper"])


@query(
    "clip_apply",
    _flow_prep(
        "SELECT row_key, "
        + ", ".join(f"least(greatest({f}, lo_{f}), hi_{f}) AS {f}" for f in FLOW_FEATURES)
        + " FROM flows, bounds"
    ),
)
def clip_apply(spark, sf_dir):
    flows = view(spark, sf_dir, "flows")
    params = prep.fit_clip(flows, prep.fit_impute(flows, FLOW_FEATURES))
    return prep.transform(flows, params, keep=["row_key"])


@query(
    "scale_fit",
    _flow_prep(
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, {r6(f'mean_{f}')} AS mean, {r6(f'std_{f}')} AS std FROM scales" for f in FLOW_FEATURES
        )
    ),
)
def scale_fit(spark, sf_dir):
    params = prep.fit_preprocessor(view(spark, sf_dir, "flows"), FLOW_FEATURES)
    return round_all(params.to_frame(spark).select("feature", "mean", "std"), ["mean", "std"])


@query("scale_apply", _flow_prep(f"SELECT row_key, {rounded_sql(FLOW_FEATURES)} FROM transformed"))
def scale_apply(spark, sf_dir):
    flows = view(spark, sf_dir, "flows")
    params = prep.fit_preprocessor(flows, FLOW_FEATURES)
    return round_all(prep.transform(flows, params, keep=["row_key"]), FLOW_FEATURES)


@query(
    "label_encode",
    with_views("traffic") + "SELECT row_key, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM traffic",
)
def label_encode(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic").select("row_key", "label")
    return prep.encode_labels(rows, prep.label_classes(rows))


def _traffic_prep(rows: str, keep: str, rest: str) -> str:
    train = "train_rows AS (SELECT * FROM splits WHERE split = 'train')"
    return (
        with_views(
            "traffic", rest=", ".join([split_sql("traffic"), train, prep_sql("train_rows", rows, TRAFFIC_FEATURES, keep)])
        )
        + rest
    )


LABEL_ID_SQL = """CAST((SELECT count(DISTINCT d.label) FROM train_rows d WHERE d.label < transformed.label) AS INTEGER)"""


@query(
    "preprocess_transform",
    _traffic_prep(
        "splits",
        "row_key, label, split",
        f"SELECT row_key, label, split, {LABEL_ID_SQL} AS label_id, {rounded_sql(TRAFFIC_FEATURES)} FROM transformed",
    ),
)
def preprocess_transform(spark, sf_dir):
    rows = materialize(splits.stratified_split(view(spark, sf_dir, "traffic"), "label", "row_key"), "splits", "split")
    train = rows.where("split = 'train'")
    params = prep.fit_preprocessor(train, TRAFFIC_FEATURES)
    table = prep.transform(rows, params, keep=["row_key", "label", "split"])
    return round_all(prep.encode_labels(table, prep.label_classes(train)), TRAFFIC_FEATURES)


@query(
    "preprocess_infer",
    _traffic_prep(
        "(SELECT * FROM splits WHERE split = 'test')",
        "row_key",
        f"SELECT row_key, {rounded_sql(TRAFFIC_FEATURES)} FROM transformed",
    ),
)
def preprocess_infer(spark, sf_dir):
    rows = materialize(splits.stratified_split(view(spark, sf_dir, "traffic"), "label", "row_key"), "splits", "split")
    params = prep.fit_preprocessor(rows.where("split = 'train'"), TRAFFIC_FEATURES)
    unlabelled = rows.where("split = 'test'").select("row_key", *TRAFFIC_FEATURES)
    return round_all(prep.transform(unlabelled, params, keep=["row_key"]), TRAFFIC_FEATURES)


@query(
    "phase1_flow",
    _traffic_prep(
        "splits",
        "row_key, label, attack_family, source_path, split",
        f"""SELECT row_key, label, attack_family, source_path AS source_file, split, {LABEL_ID_SQL} AS label_id,
  {rounded_sql(TRAFFIC_FEATURES)} FROM transformed""",
    ),
)
def phase1_flow(spark, sf_dir):
    labelled = view(spark, sf_dir, "traffic").withColumnRenamed("source_path", "source_file")
    return round_all(prepare(labelled, key="row_key", device="device_a").table, TRAFFIC_FEATURES)


@query(
    "params_roundtrip",
    _flow_prep(
        " UNION ALL ".join(
            f"""SELECT {i} AS ord, '{f}' AS feature, {r6(f'fill_{f}')} AS fill, {r6(f'lo_{f}')} AS lower, {r6(f'hi_{f}')} AS upper,
  {r6(f'mean_{f}')} AS mean, {r6(f'std_{f}')} AS std, true AS scaled FROM fills, bounds, scales"""
            for i, f in enumerate(FLOW_FEATURES)
        )
    ),
)
def params_roundtrip(spark, sf_dir):
    params = prep.fit_preprocessor(view(spark, sf_dir, "flows"), FLOW_FEATURES)
    path = scratch_path(spark, "prep-params")
    stores.write_table(params.to_frame(spark), path)
    back = prep.PrepParams.from_frame(stores.read_table(spark, path))
    return round_all(back.to_frame(spark), ["fill", "lower", "upper", "mean", "std"])


# ---- splits --------------------------------------------------------------------------------------


@query("split_stratified", with_views("traffic", rest=split_sql("traffic")) + "SELECT row_key, label, split FROM splits")
def split_stratified(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic").select("row_key", "label")
    return splits.stratified_split(rows, "label", "row_key")


def stored_splits(spark: SparkSession, sf_dir: str) -> str:
    rows = view(spark, sf_dir, "flows")
    path = scratch_path(spark, "splits")
    stores.write_splits(splits.stratified_split(rows, "label", "row_key"), path)
    return path


@query(
    "split_sink",
    with_views("flows", rest=split_sql("flows"))
    + "SELECT split, label, CAST(count(*) AS BIGINT) AS n_rows, sum(f_qty) AS sum_qty FROM splits GROUP BY split, label",
)
def split_sink(spark, sf_dir):
    table = stores.read_splits(spark, stored_splits(spark, sf_dir))
    return table.groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.sum("f_qty").alias("sum_qty"))


@query("split_source", with_views("flows", rest=split_sql("flows")) + "SELECT row_key, label, f_qty FROM splits WHERE split = 'val'")
def split_source(spark, sf_dir):
    return stores.read_split(spark, stored_splits(spark, sf_dir), "val").select("row_key", "label", "f_qty")


@query(
    "union_splits",
    with_views("flows") + "SELECT label, CAST(count(*) AS BIGINT) AS n_rows, sum(f_qty) AS sum_qty FROM flows GROUP BY label",
)
def union_splits(spark, sf_dir):
    path = stored_splits(spark, sf_dir)
    parts = [stores.read_split(spark, path, s) for s in stores.SPLITS]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum("f_qty").alias("sum_qty"))


@query(
    "split_stats",
    with_views("flows", rest=split_sql("flows"))
    + """SELECT CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE split = 'val') AS BIGINT) AS val_rows,
  CAST(count(*) FILTER (WHERE split = 'test') AS BIGINT) AS test_rows, 4 AS feature_count FROM splits""",
)
def split_stats(spark, sf_dir):
    rows = splits.stratified_split(view(spark, sf_dir, "flows"), "label", "row_key")
    return rows.agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in stores.SPLITS],
        F.lit(len(FLOW_FEATURES)).alias("feature_count"),
    )


@query(
    "shuffle_rank",
    with_views("flows")
    + "SELECT row_key, CAST(row_number() OVER (ORDER BY md5(concat_ws('|', '42', row_key)), row_key) AS BIGINT) AS shuffle_rank FROM flows",
)
def shuffle_rank(spark, sf_dir):
    return shuffle_ranks(view(spark, sf_dir, "flows").select("row_key"), "row_key", 42)


# ---- leave one attack out ------------------------------------------------------------------------


@query("loao_labels", with_views("traffic") + "SELECT DISTINCT label AS attack FROM traffic WHERE label <> 'benign'")
def loao_labels(spark, sf_dir):
    return (
        view(spark, sf_dir, "traffic").select(F.col("label").alias("attack")).where("attack <> 'benign'").distinct()
    )


def traffic_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.loao_folds(view(spark, sf_dir, "traffic").select("row_key", "label", "f_k"), "row_key")


@query(
    "loao_folds",
    with_views("traffic", rest=FOLDS_SQL) + "SELECT fold, held_out_attack, role, row_key, label, f_k FROM folds",
)
def loao_folds(spark, sf_dir):
    return traffic_folds(spark, sf_dir)


@query(
    "loao_fold_counts",
    with_views("traffic", rest=FOLDS_SQL)
    + "SELECT fold, held_out_attack, role, CAST(count(*) AS BIGINT) AS n_rows FROM folds GROUP BY fold, held_out_attack, role",
)
def loao_fold_counts(spark, sf_dir):
    return traffic_folds(spark, sf_dir).groupBy("fold", "held_out_attack", "role").agg(F.count("*").alias("n_rows"))


@query(
    "loao_leakage",
    with_views("traffic", rest=FOLDS_SQL)
    + """SELECT fold, CAST(count(*) FILTER (WHERE sides > 1) AS BIGINT) AS leaked_rows
FROM (SELECT fold, row_key, count(DISTINCT role) AS sides FROM folds GROUP BY fold, row_key) GROUP BY fold""",
)
def loao_leakage(spark, sf_dir):
    return splits.fold_leakage(traffic_folds(spark, sf_dir), "row_key")


@query("loao_summary", with_views("traffic") + "SELECT label, CAST(count(*) AS BIGINT) AS n_rows FROM traffic GROUP BY label")
def loao_summary(spark, sf_dir):
    return view(spark, sf_dir, "traffic").groupBy("label").agg(F.count("*").alias("n_rows"))
