"""Exploratory statistics: univariate summaries, correlation, association, PCA."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import count_if, is_missing, running_totals
from ..functions.quantiles import exact_quantiles
from ..sources.tables import materialize

PERCENTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: counts, moments, exact percentiles, zeros and negatives, all columns at once."""
    names = [f"p{round(q * 100):02d}" for q in PERCENTILES]
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(~is_missing(df, c), F.col(c).cast("double"))
        one = {"n": F.count(v), "n_missing": count_if(is_missing(df, c)), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v), "n_zero": count_if(v == 0), "n_negative": count_if(v < 0)}
        aggs += [a.alias(f"{k}__{i}") for k, a in one.items()]
    wide = df.agg(*aggs)
    q = exact_quantiles(df, {c: F.when(~is_missing(df, c), F.col(c).cast("double")) for c in columns}, PERCENTILES)
    plain = ["n", "n_missing", "mean", "std", "min", "max", "n_zero", "n_negative"]
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}__{i}").alias(k) for k in plain], *[F.lit(q[c][j]).cast("double").alias(n) for j, n in enumerate(names)]) for i, c in enumerate(columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n): equal-width bins, by Sturges' rule up to 50 unless given."""
    s = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"), F.least(F.lit(50), F.ceil(F.log2(F.greatest(F.count(column), F.lit(1)))) + 1).alias("k"))
    s = s.withColumn("k", F.lit(bins) if bins else F.col("k"))
    x = df.where(F.col(column).isNotNull()).join(F.broadcast(s), F.lit(True))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    at = F.least(F.col("k") - 1, F.coalesce(F.floor(F.try_divide(F.col(column) - F.col("lo"), width)), F.lit(0)))
    return x.groupBy(at.cast("int").alias("bin"), (F.col("lo") + at * width).alias("low"), (F.col("lo") + (at + 1) * width).alias("high")).agg(F.count("*").alias("n"))


def datetime_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    days = F.floor((F.unix_micros(F.max(c.cast("timestamp"))) - F.unix_micros(F.min(c.cast("timestamp")))) / F.lit(86400 * 10**6))
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), days.cast("long").alias("range_days"), F.count_distinct(F.year(c)).alias("n_years"), F.count_distinct(F.month(c)).alias("n_months"))


def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    """(part, value, n) for year, month and weekday (Monday is 0)."""
    c = F.col(column)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), f(c).cast("int").alias("value")) for n, f in (("year", F.year), ("month", F.month), ("weekday", F.weekday))])
    return df.where(c.isNotNull()).select(F.explode(parts).alias("p")).groupBy("p.part", "p.value").agg(F.count("*").alias("n"))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair, over rows where both are present; one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


#: Ranks of a column with so many distinct values, approximately, are broadcast; beyond them rows meet their ranks by shuffle.
BROADCAST_VALUES = 1_000_000


def _centred_ranks(counts: DataFrame, column: str, n: int) -> DataFrame:
    """``counts`` with _rank: the average rank of each distinct value less the mean of all n, a multiple of a half and so exact."""
    ranks = running_totals(counts, [], column, ["_n"])
    return ranks.select(*counts.columns, (F.col("run__n") - (F.col("_n") - 1) / 2 - F.lit((n + 1) / 2)).alias("_rank"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson on average ranks over rows where all columns are present; NULL without variation.

    Ranks come from written counts of distinct values. Rows get those of all columns but the one with most values; its
    products are sums per value, so its rows are counted and never joined.
    """
    whole = df.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)]).na.drop()
    at = range(len(columns))
    n, *distinct = whole.agg(F.count("*"), *[F.approx_count_distinct(f"_v{i}") for i in at]).head()
    *others, last = sorted(at, key=lambda i: distinct[i])
    rows = whole
    for i in others:
        counts = materialize(whole.groupBy(f"_v{i}").agg(F.count("*").alias("_n")), "counts")
        ranks = _centred_ranks(counts, f"_v{i}", n).select(f"_v{i}", F.col("_rank").alias(f"_r{i}"))
        few = distinct[i] <= BROADCAST_VALUES
        rows = rows.join(F.broadcast(ranks) if few else ranks, f"_v{i}").drop(f"_v{i}")
        rows = rows if few else materialize(rows, "ranks")
    among = rows.agg(*[F.sum(F.col(f"_r{i}") * F.col(f"_r{j}")).alias(f"p{min(i, j)}_{max(i, j)}") for i, j in combinations_with_replacement(others, 2)])
    counts = materialize(rows.groupBy(f"_v{last}").agg(F.count("*").alias("_n"), *[F.sum(f"_r{i}").alias(f"_r{i}") for i in others]), "counts")
    ranks = _centred_ranks(counts, f"_v{last}", n)
    beside = ranks.agg(F.sum(F.col("_n") * F.col("_rank") * F.col("_rank")).alias(f"p{last}_{last}"), *[F.sum(F.col("_rank") * F.col(f"_r{i}")).alias(f"p{min(i, last)}_{max(i, last)}") for i in others])
    r = lambda i, j: F.try_divide(F.col(f"p{i}_{j}"), F.sqrt(f"p{i}_{i}") * F.sqrt(f"p{j}_{j}"))
    found = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), r(i, j).alias("r")) for i, j in combinations(at, 2)]
    return among.join(beside, F.lit(True)).select(F.explode(F.array(*found)).alias("x")).select("x.*")


def correlation_network(df: DataFrame, columns: list[str], threshold: float = 0.5) -> DataFrame:
    """(node, degree, centrality) over edges with |r| >= threshold."""
    edges = pearson(df, columns).where(F.abs("r") >= threshold)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).withColumn("centrality", F.col("degree") / F.lit(float(len(columns) - 1)))


def numeric_association(df: DataFrame, feature: str, target: str) -> DataFrame:
    """One row: n, Pearson r, slope, intercept and R2 of the simple regression of target on feature."""
    return df.agg(F.regr_count(target, feature).alias("n"), F.corr(feature, target).alias("pearson"), F.regr_slope(target, feature).alias("slope"), F.regr_intercept(target, feature).alias("intercept"), F.regr_r2(target, feature).alias("r2"))


def anova(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row: k groups, n, F statistic and eta squared, from per-group moments."""
    g = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value) * F.count("*"), F.lit(0.0)).alias("ss"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    f = F.try_divide(between / F.nullif(F.col("k") - 1, F.lit(0)), F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    return t.select("k", "n", f.alias("f_statistic"), F.try_divide(between, between + F.col("within")).alias("eta_squared"))


def group_stats(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def bivariate(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, measure, value) of every feature against the target: pearson, eta_squared (one side of categories) or cramers_v."""
    text = {c for c, t in df.dtypes if t in ("string", "boolean")}
    out = None
    for f in features:
        if f in text and target in text:
            one = chi_square(df, f, target).select(F.lit("cramers_v").alias("measure"), F.col("cramers_v").alias("value"))
        elif f in text or target in text:
            category, number = (f, target) if f in text else (target, f)
            one = anova(df, category, number).select(F.lit("eta_squared").alias("measure"), F.col("eta_squared").alias("value"))
        else:
            one = df.agg(F.corr(f, target).alias("value")).select(F.lit("pearson").alias("measure"), "value")
        one = one.select(F.lit(f).alias("feature"), "measure", "value")
        out = one if out is None else out.unionByName(one)
    return out


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, row_pct, col_pct) in long form."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    share = lambda key: F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy(key)), 3)
    return c.withColumns({"row_pct": share("a"), "col_pct": share("b")})


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 (Yates for 2 x 2), dof, n and bias-corrected Cramér's V."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, cb = (c.groupBy(k).agg(F.sum("n").alias(f"n_{k}")) for k in ("a", "b"))
    t = c.agg(F.sum("n").alias("n_all"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    # cells without rows add nothing to n * (sum of o^2 / (row * column) - 1), so only cells with rows are read
    cells = c.join(ra, "a").join(cb, "b").join(F.broadcast(t), F.lit(True))
    share = F.sum(F.col("n") * F.col("n") / (F.col("n_a") * F.col("n_b").cast("double")))
    out = cells.agg((F.max("n_all") * (share - 1)).alias("plain"), F.max("n_all").alias("n"), F.max("r").alias("r"), F.max("k").alias("k"), F.max(F.struct("n", "n_a", "n_b")).alias("one"))
    # 2 x 2: |o - e| is the same in all four cells, and Yates' correction takes half a row off it
    e = F.col("one.n_a") * F.col("one.n_b") / F.col("n")
    off = F.abs(F.col("one.n") - e)
    yates = F.col("plain") * F.pow(F.coalesce(F.try_divide(off - F.least(F.lit(0.5), off), off), F.lit(0.0)), 2)
    out = out.withColumn("chi2", F.greatest(F.lit(0.0), F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(F.col("plain"))))
    r, k, n = F.col("r"), F.col("k"), F.col("n")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (r - 1) * (k - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    v = F.sqrt(F.try_divide(phi, F.least(rc, kc) - 1))
    return out.select("chi2", ((r - 1) * (k - 1)).alias("dof"), "n", v.alias("cramers_v"))


def pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """(component, explained, cumulative) after filling nulls with 0 and standardising."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=columns, outputCol="v").transform(df.select(*columns).na.fill(0))
    x = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(x).transform(x)
    ratios = PCA(k=k, inputCol="s", outputCol="p").fit(x).explainedVariance.toArray().tolist()
    rows = [(i + 1, float(r), float(sum(ratios[: i + 1]))) for i, r in enumerate(ratios)]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def pca_scores(df: DataFrame, id_col: str, columns: list[str], k: int = 2) -> tuple[DataFrame, DataFrame]:
    """((id, pc1..pck) of every row, (feature, pc1..pck) loadings) after filling nulls with 0 and standardising."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = VectorAssembler(inputCols=columns, outputCol="v").transform(df.select(id_col, *columns).na.fill(0, columns))
    x = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(x).transform(x)
    model = PCA(k=k, inputCol="s", outputCol="p").fit(x)
    names = [f"pc{i + 1}" for i in range(k)]
    scores = model.transform(x).select(id_col, vector_to_array("p").alias("p")).select(id_col, *[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    rows = [(c, *map(float, model.pc.toArray()[j])) for j, c in enumerate(columns)]
    return scores, df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in names))


def feature_importance(df: DataFrame, features: list[str], target: str, trees: int = 20, seed: int = 42) -> DataFrame:
    """(feature, importance) of a random forest; classification for at most ten distinct targets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x = df.select(*features, F.col(target).cast("double").alias("_y")).na.drop()
    kind = RandomForestClassifier if x.select("_y").distinct().limit(11).count() <= 10 else RandomForestRegressor
    model = kind(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(VectorAssembler(inputCols=features, outputCol="_v").transform(x))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


