"""Sources, sinks, projections, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.catalog.registration import query, r6
from flowguard.functions.columns import coerced, fixed_text, rounded
from flowguard.operators import checks
from flowguard.operators.ordering import exact_sample, first_rows_per_group
from flowguard.operators.prep import feature_columns
from flowguard.plans.views import TRAFFIC_FEATURES, view, with_views
from flowguard.session import scratch_path
from flowguard.sources import stores, traffic_csv

FEATURE_LIST = ", ".join(TRAFFIC_FEATURES)
CSV_COLUMNS = ["row_key", *TRAFFIC_FEATURES]


def traffic_tree(spark: SparkSession, sf_dir: str) -> tuple[str, list[str]]:
    """The traffic rows as the CSV tree of one device."""
    root = scratch_path(spark, "traffic-csv")
    traffic_csv.write_tree(view(spark, sf_dir, "traffic"), "source_path", root, CSV_COLUMNS)
    device = f"{root}/device_a"
    return f"{device}/benign_traffic.csv", [f"{device}/gafgyt_attacks", f"{device}/mirai_attacks", f"{device}/no_attacks"]


def as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


PATH_SQL = """
  CASE WHEN regexp_matches(source_path, '_attacks/')
    THEN regexp_extract(source_path, '([^/]+)_attacks/([^/]+)\\.csv', 1) || '_' ||
         regexp_extract(source_path, '([^/]+)_attacks/([^/]+)\\.csv', 2) ELSE 'benign' END AS label,
  CASE WHEN regexp_matches(source_path, '_attacks/')
    THEN regexp_extract(source_path, '([^/]+)_attacks/([^/]+)\\.csv', 1) ELSE 'benign' END AS attack_family,
  regexp_extract(source_path, '([^/]+\\.csv)', 1) AS source_file"""


@query("ingest_labels", with_views("traffic") + f"SELECT row_key, {PATH_SQL} FROM traffic")
def ingest_labels(spark, sf_dir):
    paths = view(spark, sf_dir, "traffic").select("row_key", "source_path")
    return paths.select("row_key", *[c.alias(n) for n, c in traffic_csv.path_columns("source_path").items()])


@query(
    "label_strings",
    with_views("traffic")
    + """SELECT source_path, replace(split_part(source_path, '/', 2), '_attacks', '') AS folder_family,
  regexp_extract(source_path, '([^/]+)\\.csv$', 1) AS stem, regexp_extract(source_path, '([^/]+)$', 1) AS file_name,
  contains(source_path, 'device_a') AS on_device, concat_ws('|', label, attack_family) AS joined,
  substr(label, 1, 12) AS short_label, printf('%.4f', avg(f_k)) AS mean_text
FROM traffic GROUP BY source_path, label, attack_family""",
)
def label_strings(spark, sf_dir):
    path = F.col("source_path")
    return (
        view(spark, sf_dir, "traffic")
        .groupBy("source_path", "label", "attack_family")
        .agg(fixed_text(F.avg("f_k"), 4).alias("mean_text"))
        .select(
            "source_path",
            F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(2)), "_attacks", "").alias("folder_family"),
            F.regexp_extract(path, r"([^/]+)\.csv$", 1).alias("stem"),
            F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
            path.rlike("device_a").alias("on_device"),
            F.concat_ws("|", "label", "attack_family").alias("joined"),
            F.substring("label", 1, 12).alias("short_label"),
            "mean_text",
        )
    )


_FLOAT_SQL = ", ".join(f"CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}" for f in CSV_COLUMNS)


@query("ingest_scan", with_views("traffic") + f"SELECT {_FLOAT_SQL}, {PATH_SQL} FROM traffic")
def ingest_scan(spark, sf_dir):
    benign, attacks = traffic_tree(spark, sf_dir)
    return as_doubles(traffic_csv.scan(spark, benign, attacks), *CSV_COLUMNS)


_PER_FILE = """SELECT source_file, label, attack_family, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(f_value) AS BIGINT) AS n_value, sum(f_k) AS sum_k FROM {0} GROUP BY source_file, label, attack_family"""


def per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file", "label", "attack_family").agg(
        F.count("*").alias("n_rows"), F.count("f_value").alias("n_value"), F.sum(F.col("f_k").cast("double")).alias("sum_k")
    )


@query(
    "ingest_union",
    with_views("traffic", rest=f"files AS (SELECT f_value, f_k, {PATH_SQL} FROM traffic)") + _PER_FILE.format("files"),
)
def ingest_union(spark, sf_dir):
    benign, attacks = traffic_tree(spark, sf_dir)
    return per_file(traffic_csv.load(spark, benign, attacks))


@query(
    "ingest_cached",
    with_views(
        "traffic",
        rest=f"""files AS (SELECT f_value, f_k, {PATH_SQL},
          row_number() OVER (PARTITION BY source_path ORDER BY row_key) AS rn FROM traffic)""",
    )
    + _PER_FILE.format("files")
    .replace("GROUP BY", "WHERE rn <= 150 GROUP BY"),
)
def ingest_cached(spark, sf_dir):
    benign, attacks = traffic_tree(spark, sf_dir)
    cache = scratch_path(spark, "raw-cache")
    traffic_csv.load(spark, benign, attacks, "row_key", 150, cache)
    return per_file(traffic_csv.load(spark, benign, attacks, "row_key", 150, cache))


@query(
    "schema_infer",
    with_views("traffic")
    + """SELECT c.ord, c.feature, c.type, CAST((SELECT count(*) FROM traffic WHERE label = 'benign') AS BIGINT) AS n_rows
FROM (VALUES (0, 'row_key', 'float'), (1, 'f_value', 'float'), (2, 'f_user', 'float'), (3, 'f_hour', 'float'),
  (4, 'f_k', 'float'), (5, 'f_const', 'float')) AS c(ord, feature, type)""",
)
def schema_infer(spark, sf_dir):
    benign, _ = traffic_tree(spark, sf_dir)
    schema = traffic_csv.feature_schema(traffic_csv.infer_features(spark, benign))
    columns = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)]
    cells = ", ".join(f"{i}, '{n}', '{t}', n" for i, n, t in columns)
    rows = spark.read.schema(schema).option("header", True).csv(benign).agg(F.count("*").alias("n"))
    return rows.selectExpr(f"stack({len(columns)}, {cells}) AS (ord, feature, type, n_rows)")


@query("select_features", with_views("traffic") + f"SELECT row_key, {FEATURE_LIST} FROM traffic")
def select_features(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    names = feature_columns(traffic, ("label", "attack_family", "source_path"))
    return traffic.select("row_key", *names)


@query("feature_cap", with_views("traffic") + "SELECT row_key, f_value, f_user, f_hour, label FROM traffic")
def feature_cap(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    names = feature_columns(traffic, ("label", "attack_family", "source_path"), limit=3)
    return traffic.select("row_key", *names, "label")


@query(
    "cap_per_source",
    with_views("traffic")
    + """SELECT row_key, source_path FROM (SELECT row_key, source_path,
  row_number() OVER (PARTITION BY source_path ORDER BY row_key) AS rn FROM traffic) WHERE rn <= 100""",
)
def cap_per_source(spark, sf_dir):
    rows = view(spark, sf_dir, "traffic").select("row_key", "source_path")
    return first_rows_per_group(rows, "source_path", "row_key", 100).select("row_key", "source_path")


@query(
    "filter_with_fallback",
    with_views("traffic")
    + """SELECT p.pattern, CAST(count(*) AS BIGINT) AS n_rows, sum(f_k) AS sum_k
FROM traffic, (VALUES ('mirai_attacks'), ('another_device')) AS p(pattern)
WHERE contains(source_path, p.pattern) OR NOT EXISTS (SELECT 1 FROM traffic t WHERE contains(t.source_path, p.pattern))
GROUP BY p.pattern""",
)
def filter_with_fallback(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    parts = [
        traffic_csv.device_filter(traffic, "source_path", p)
        .agg(F.count("*").alias("n_rows"), F.sum("f_k").alias("sum_k"))
        .withColumn("pattern", F.lit(p))
        for p in ("mirai_attacks", "another_device")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "sample_exact",
    with_views("flows")
    + "SELECT row_key, label, f_qty FROM flows ORDER BY md5(concat_ws('|', '42', row_key)), row_key LIMIT 15000",
)
def sample_exact(spark, sf_dir):
    return exact_sample(view(spark, sf_dir, "flows"), "row_key", 15000, 42).select("row_key", "label", "f_qty")


@query("binary_target", with_views("flows") + "SELECT row_key, CAST(label <> 'benign' AS INTEGER) AS y FROM flows")
def binary_target(spark, sf_dir):
    return view(spark, sf_dir, "flows").select("row_key", (F.col("label") != "benign").cast("int").alias("y"))


@query(
    "coerce_numeric",
    with_views("dirty")
    + """SELECT row_key, CASE WHEN isnan(k) THEN NULL ELSE k END AS k,
  CASE WHEN isinf(u) OR isnan(u) THEN NULL ELSE u END AS finite_user,
  u IS NULL OR isnan(u) AS user_missing, coalesce(isinf(u), false) AS user_infinite
FROM (SELECT row_key, TRY_CAST(c_k AS DOUBLE) AS k, TRY_CAST(c_user AS DOUBLE) AS u FROM dirty)""",
)
def coerce_numeric(spark, sf_dir):
    user = coerced("c_user")
    infinite = F.coalesce(F.abs(user) == F.lit(float("inf")), F.lit(False))
    return view(spark, sf_dir, "dirty").select(
        "row_key",
        coerced("c_k").alias("k"),
        F.when(~infinite, user).alias("finite_user"),
        user.isNull().alias("user_missing"),
        infinite.alias("user_infinite"),
    )


@query(
    "check_required_columns",
    with_views("dirty")
    + """SELECT 'label' AS "column", true AS present, CAST(count(label) AS BIGINT) AS filled_rows FROM dirty
UNION ALL SELECT 'attack_family', true, CAST(count(attack_family) AS BIGINT) FROM dirty
UNION ALL SELECT 'source_file', true, CAST(count(source_file) AS BIGINT) FROM dirty
UNION ALL SELECT 'device', false, CAST(0 AS BIGINT)""",
)
def check_required_columns(spark, sf_dir):
    return checks.column_presence(view(spark, sf_dir, "dirty"), ("label", "attack_family", "source_file", "device"))


@query(
    "check_duplicate_columns",
    with_views("traffic")
    + """SELECT c.name AS "column", c.times AS occurrences, c.times > 1 AS duplicated,
  CAST((SELECT count(*) FROM traffic) AS BIGINT) AS rows
FROM (VALUES ('row_key', 1), ('label', 2), ('f_k', 1)) AS c(name, times)""",
)
def check_duplicate_columns(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    return checks.column_occurrences(traffic.select("row_key", "label", "f_k", F.col("attack_family").alias("label")))


_RAW_VIOLATIONS = """
SELECT row_key, 'c_k' AS "column", 'coerce_double' AS "check", c_k AS failure_case FROM dirty
  WHERE c_k IS NOT NULL AND TRY_CAST(c_k AS DOUBLE) IS NULL
UNION ALL SELECT row_key, 'c_user', 'coerce_double', c_user FROM dirty
  WHERE c_user IS NOT NULL AND TRY_CAST(c_user AS DOUBLE) IS NULL
UNION ALL SELECT row_key, 'c_k', 'not_infinite', c_k FROM dirty WHERE isinf(TRY_CAST(c_k AS DOUBLE))
UNION ALL SELECT row_key, 'c_user', 'not_infinite', c_user FROM dirty WHERE isinf(TRY_CAST(c_user AS DOUBLE))"""


@query("validate_raw", with_views("dirty") + _RAW_VIOLATIONS)
def validate_raw(spark, sf_dir):
    return checks.validate_raw(view(spark, sf_dir, "dirty"), ["c_k", "c_user"])


@query(
    "validate_labeled",
    with_views("dirty")
    + _RAW_VIOLATIONS
    + "".join(
        f" UNION ALL SELECT row_key, '{c}', 'not_null', NULL FROM dirty WHERE {c} IS NULL"
        for c in ("label", "attack_family", "source_file")
    ),
)
def validate_labeled(spark, sf_dir):
    return checks.validate_labeled(view(spark, sf_dir, "dirty"), ["c_k", "c_user"])


@query(
    "check_inf",
    with_views("dirty")
    + """SELECT 'c_k' AS "column", CAST(count(*) FILTER (WHERE isinf(TRY_CAST(c_k AS DOUBLE))) AS BIGINT) AS infinite_rows
FROM dirty UNION ALL
SELECT 'c_user', CAST(count(*) FILTER (WHERE isinf(TRY_CAST(c_user AS DOUBLE))) AS BIGINT) FROM dirty""",
)
def check_inf(spark, sf_dir):
    return checks.infinite_counts(view(spark, sf_dir, "dirty"), ["c_k", "c_user"])


@query(
    "check_label_null",
    with_views("dirty") + "SELECT CAST(count(*) FILTER (WHERE label IS NULL) AS BIGINT) AS null_labels FROM dirty",
)
def check_label_null(spark, sf_dir):
    return checks.null_labels(view(spark, sf_dir, "dirty"))


_QUALITY = f"""SELECT CAST(count(*) AS BIGINT) AS rows, 9 AS "columns", 5 AS feature_columns,
  {r6(" + ".join(f"avg(CASE WHEN {f} IS NULL THEN 1.0E0 ELSE 0.0E0 END)" for f in TRAFFIC_FEATURES).join("()") + " / 5")}
  AS missing_ratio FROM traffic"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = checks.quality_summary(view(spark, sf_dir, "traffic"), TRAFFIC_FEATURES)
    return summary.withColumn("missing_ratio", rounded("missing_ratio"))


@query("quality_summary", with_views("traffic") + _QUALITY)
def quality_summary(spark, sf_dir):
    return quality(spark, sf_dir)


@query("label_distribution", with_views("dirty") + "SELECT label, CAST(count(*) AS BIGINT) AS rows FROM dirty GROUP BY label")
def label_distribution(spark, sf_dir):
    return checks.distribution(view(spark, sf_dir, "dirty"), "label")


@query(
    "family_distribution",
    with_views("dirty") + "SELECT attack_family, CAST(count(*) AS BIGINT) AS rows FROM dirty GROUP BY attack_family",
)
def family_distribution(spark, sf_dir):
    return checks.distribution(view(spark, sf_dir, "dirty"), "attack_family")


@query(
    "distribution_sets",
    with_views("traffic")
    + """SELECT label, attack_family, CAST(count(*) AS BIGINT) AS rows,
  CAST(grouping(label) * 2 + grouping(attack_family) AS INTEGER) AS level
FROM traffic GROUP BY GROUPING SETS ((label), (attack_family), ())""",
)
def distribution_sets(spark, sf_dir):
    return checks.distribution_sets(view(spark, sf_dir, "traffic"))


@query("report_json", with_views("traffic") + _QUALITY)
def report_json(spark, sf_dir):
    path = scratch_path(spark, "quality-report")
    stores.write_report(quality(spark, sf_dir), path)
    return stores.read_report(
        spark, path, "rows bigint, columns int, feature_columns int, missing_ratio double"
    )


@query(
    "quality_report",
    with_views("traffic", rest=f"""summary AS ({_QUALITY}),
labels AS (SELECT coalesce(label, 'NaN') AS k, count(*) AS n FROM (SELECT CASE WHEN f_k <> 1 THEN label END AS label FROM traffic) GROUP BY label),
families AS (SELECT attack_family AS k, count(*) AS n FROM traffic GROUP BY attack_family)""")
    + """SELECT rows, "columns", feature_columns, missing_ratio,
  (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM labels) AS label_distribution,
  (SELECT string_agg(k || ':' || n, ',' ORDER BY k) FROM families) AS family_distribution FROM summary""",
)
def quality_report(spark, sf_dir):
    """The nested report of rows some of which have lost their label, written as JSON and read back."""
    path = scratch_path(spark, "nested-report")
    rows = view(spark, sf_dir, "traffic").withColumn("label", F.when(F.col("f_k") != 1, F.col("label")))
    report = checks.quality_report(rows, TRAFFIC_FEATURES)
    stores.write_report(report.withColumn("missing_ratio", rounded("missing_ratio")), path)
    flat = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias(c)
    stored = stores.read_report(spark, path, checks.REPORT_SCHEMA)
    return stored.select("rows", "columns", "feature_columns", "missing_ratio", flat("label_distribution"), flat("family_distribution"))


@query(
    "report_read",
    with_views("experiments")
    + f"""SELECT run_name, {r6("baseline_f1_weighted")} AS baseline_f1_weighted, {r6("fusion_f1")} AS fusion_f1,
  {r6("fusion_auroc")} AS fusion_auroc FROM experiments""",
)
def report_read(spark, sf_dir):
    path = scratch_path(spark, "experiment-reports")
    documents = view(spark, sf_dir, "experiments").select(
        "run_name",
        F.struct(F.col("baseline_f1_weighted").alias("f1_weighted")).alias("baseline_multiclass"),
        F.struct(F.col("fusion_f1").alias("f1"), F.col("fusion_auroc").alias("auroc")).alias("fusion_binary"),
    )
    stores.write_report(documents, path)
    back = stores.read_report(
        spark,
        path,
        "run_name string, baseline_multiclass struct<f1_weighted: double>, fusion_binary struct<f1: double, auroc: double>",
    )
    return back.select(
        "run_name",
        rounded("baseline_multiclass.f1_weighted").alias("baseline_f1_weighted"),
        rounded("fusion_binary.f1").alias("fusion_f1"),
        rounded("fusion_binary.auroc").alias("fusion_auroc"),
    )


@query(
    "feature_list",
    with_views("traffic")
    + """SELECT CAST(f.ord AS INTEGER) AS ord, f.feature, f.filled_rows FROM (
  SELECT 0 AS ord, 'f_value' AS feature, CAST(count(f_value) AS BIGINT) AS filled_rows FROM traffic
  UNION ALL SELECT 1, 'f_user', CAST(count(f_user) AS BIGINT) FROM traffic
  UNION ALL SELECT 2, 'f_hour', CAST(count(f_hour) AS BIGINT) FROM traffic) AS f""",
)
def feature_list(spark, sf_dir):
    traffic = view(spark, sf_dir, "traffic")
    path = scratch_path(spark, "feature-list")
    names = feature_columns(traffic, ("label", "attack_family", "source_path"), limit=3)
    stores.write_table(spark.createDataFrame(list(enumerate(names)), "ord int, feature string"), path)
    filled = traffic.agg(*[F.count(f).alias(f) for f in TRAFFIC_FEATURES]).unpivot(
        [], TRAFFIC_FEATURES, "feature", "filled_rows"
    )
    return stores.read_table(spark, path).join(filled, "feature").select("ord", "feature", "filled_rows")
