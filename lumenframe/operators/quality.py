"""Data quality: missing values, types, duplicates, cardinality, imputation, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import count_if, is_missing, numeric_columns, ratio, with_group_extremes
from ..functions.quantiles import exact_quantiles
from .ordered import filled


def _rows_of(one: DataFrame, names: list[str], metrics: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate with fields ``<metric>__<i>`` into a row per column."""
    parts = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}__{i}").cast(t).alias(m) for m, t in metrics.items()])
        for i, c in enumerate(names)
    ]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_missing, pct_missing) in one scan."""
    names = columns or df.columns
    aggs = [x for i, c in enumerate(names) for x in (F.count(F.lit(1)).alias(f"n_rows__{i}"), count_if(is_missing(df, c)).alias(f"n_missing__{i}"))]
    out = _rows_of(df.agg(*aggs), names, {"n_rows": "long", "n_missing": "long"})
    return out.withColumn("pct_missing", F.round(F.coalesce(ratio(F.col("n_missing") * 100, F.col("n_rows")), F.lit(0.0)), 6))


def column_kinds(df: DataFrame) -> DataFrame:
    """(column_name, storage_type, kind): kind is numeric, datetime, boolean or string."""
    rows = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        kind = "datetime" if t.startswith(("timestamp", "date")) else "boolean" if t == "boolean" else "string" if t == "string" else "numeric" if f.name in numeric_columns(df) else "object"
        rows.append((f.name, t, kind))
    return df.sparkSession.createDataFrame(rows, "column_name string, storage_type string, kind string")


def castable_mix(df: DataFrame, column: str) -> DataFrame:
    """How many non-null strings read as long, double, timestamp or none: a mixed column has several kinds."""
    c = F.col(column)
    kind = (
        F.when(c.try_cast("long").isNotNull(), "long")
        .when(c.try_cast("double").isNotNull(), "double")
        .when(c.try_cast("timestamp").isNotNull(), "timestamp")
        .otherwise("string")
    )
    return df.where(c.isNotNull()).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def detect_duplicates(df: DataFrame, subset: list[str], keep: str | None = "first") -> DataFrame:
    """One row: n_rows, n_duplicates, pct_duplicates, n_unique. ``keep`` None flags every row of a repeated group."""
    groups = df.groupBy(*subset).agg(F.count("*").alias("n"))
    flagged = F.col("n") - 1 if keep else F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    out = groups.agg(F.sum("n").cast("long").alias("n_rows"), F.sum(flagged).cast("long").alias("n_duplicates"), F.count("*").alias("n_unique"))
    return out.withColumn("pct_duplicates", F.round(ratio(F.col("n_duplicates") * 100, F.col("n_rows")), 6))


def duplicate_value_counts(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.groupBy(*subset).agg(F.count("*").alias("n")).where("n > 1")


def flag_duplicates(df: DataFrame, subset: list[str], order_by: list[str], keep: str | None = "first") -> DataFrame:
    """``df`` with is_duplicate and group_id (the first order value of the group; ``order_by`` tells all rows apart)."""
    own = F.struct(*[F.col(c) for c in order_by])
    # a struct of the subset is a key that may hold NULLs
    extremes = {"_first": ("min", own), "_last": ("max", own)}
    found = with_group_extremes(df.withColumn("_key", F.struct(*subset)), ["_key"], own, extremes)
    kept = own if keep is None else F.col("_first" if keep == "first" else "_last")
    flag = F.col("_first") != F.col("_last") if keep is None else own != kept
    return found.select(*df.columns, flag.alias("is_duplicate"), F.col("_first")[order_by[0]].alias("group_id"))


def remove_duplicates(df: DataFrame, subset: list[str], order_by: list[str], keep: str | None = "first") -> DataFrame:
    """Rows that survive: the first, the last, or (None) only those without a twin."""
    return flag_duplicates(df, subset, order_by, keep).where("NOT is_duplicate").drop("is_duplicate", "group_id")


CARDINALITY_LIMITS = [(0.01, "very_low"), (0.05, "low"), (0.2, "medium"), (0.5, "high"), (1.0, "very_high")]


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_values, n_unique, unique_ratio, cardinality)."""
    aggs = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n_values__{i}"), F.count_distinct(c).alias(f"n_unique__{i}"))]
    out = _rows_of(df.agg(*aggs), columns, {"n_values": "long", "n_unique": "long"})
    r = F.coalesce(ratio(F.col("n_unique"), F.col("n_values")), F.lit(0.0))
    label = F.when(F.col("n_values") == 0, "empty")
    for limit, name in CARDINALITY_LIMITS:
        label = label.when(r < limit, name)
    return out.withColumn("unique_ratio", F.round(r, 6)).withColumn("cardinality", label.otherwise("unique"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(value, n, pct): the k most frequent values (ties by value), nulls as 'Missing', the rest as 'Other'."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("Missing")).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(k)
    n_all = df.agg(F.count("*").alias("n_all"))
    rest = n_all.join(top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_top")), F.lit(True)).select(F.lit("Other").alias("value"), (F.col("n_all") - F.col("n_top")).alias("n")).where("n > 0")
    return top.unionByName(rest).join(F.broadcast(n_all), F.lit(True)).select("value", "n", F.round(ratio(F.col("n") * 100, F.col("n_all")), 6).alias("pct"))


def impute(df: DataFrame, columns: list[str], strategy: str, value=None, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Fill missing values by drop, mean, median, mode (smallest on ties), constant or interpolate (linear over row order)."""
    missing = {c: is_missing(df, c) for c in columns}
    if strategy == "drop":
        for m in missing.values():
            df = df.where(~m)
        return df
    if strategy == "constant":
        if value is None:
            raise ValueError("strategy 'constant' needs a value")
        return df.withColumns({c: F.when(m, F.lit(value)).otherwise(F.col(c)) for c, m in missing.items()})
    if strategy == "median":
        middle = exact_quantiles(df, {c: F.when(~m, F.col(c)) for c, m in missing.items()}, [0.5])
        return df.withColumns({c: F.when(m, F.lit(middle[c][0]).cast("double")).otherwise(F.col(c)) for c, m in missing.items()})
    if strategy in ("mean", "mode"):
        how = {"mean": F.avg, "mode": lambda c: F.mode(c, True)}[strategy]
        fill = df.agg(*[how(F.when(~m, F.col(c))).alias(f"_fill_{c}") for c, m in missing.items()])
        df = df.join(F.broadcast(fill), F.lit(True))
        return df.withColumns({c: F.when(m, F.col(f"_fill_{c}")).otherwise(F.col(c)) for c, m in missing.items()}).drop(*[f"_fill_{c}" for c in columns])
    if strategy != "interpolate":
        raise ValueError(f"unknown strategy {strategy!r}")
    if not order_by:
        raise ValueError("strategy 'interpolate' needs order_by")
    return filled(df, missing, order_by, partition_by or [])


def outlier_bounds(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """One row with lo__<c> and hi__<c>: a value outside is an outlier; NULL bounds flag nothing."""
    aggs = []
    quartiles = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75]) if method == "iqr" else {}
    for c in columns:
        if method == "iqr":
            q = [F.lit(x).cast("double") for x in quartiles[c]]
            lo, hi = F.max(q[0] - threshold * (q[1] - q[0])), F.max(q[1] + threshold * (q[1] - q[0]))
        elif method == "zscore":
            sd = F.nullif(F.stddev_samp(c), F.lit(0.0))
            lo, hi = F.avg(c) - threshold * sd, F.avg(c) + threshold * sd
        else:
            raise ValueError(f"unknown method {method!r}")
        aggs += [lo.alias(f"lo__{c}"), hi.alias(f"hi__{c}")]
    return df.agg(*aggs)


def detect_outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """``df`` with outlier_<c> per column. Methods: iqr, zscore, modified_zscore (median and MAD)."""
    if method == "modified_zscore":
        middle = exact_quantiles(df, {c: F.col(c) for c in columns}, [0.5])
        off = {c: F.abs(F.col(c) - F.lit(middle[c][0]).cast("double")) for c in columns}
        mad = exact_quantiles(df, off, [0.5])
        score = {c: ratio(F.lit(0.6745) * off[c], F.nullif(F.lit(mad[c][0]).cast("double"), F.lit(0.0))) for c in columns}
        return df.withColumns({f"outlier_{c}": F.coalesce(s > threshold, F.lit(False)) for c, s in score.items()})
    df = df.join(F.broadcast(outlier_bounds(df, columns, method, threshold)), F.lit(True))
    flag = {f"outlier_{c}": F.coalesce((F.col(c) < F.col(f"lo__{c}")) | (F.col(c) > F.col(f"hi__{c}")), F.lit(False)) for c in columns}
    return df.withColumns(flag).drop(*[f"{p}__{c}" for c in columns for p in ("lo", "hi")])


def drop_outliers(df: DataFrame, columns: list[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows that are no outlier in any column."""
    out = detect_outliers(df, columns, method, threshold)
    for c in columns:
        out = out.where(~F.col(f"outlier_{c}"))
    return out.drop(*[f"outlier_{c}" for c in columns])
