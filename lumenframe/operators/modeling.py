"""Feature selection, splits, folds, metrics, calibration and a small automatic model, on tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import ratio, running_totals
from ..functions.quantiles import exact_quantiles
from ..sources.tables import materialize
from .ordered import by_pos, ordered
from .stats import anova, feature_importance, pearson

# selection


def select_by_variance(df: DataFrame, columns: list[str], threshold: float = 0.0) -> DataFrame:
    """(feature, variance) of columns whose population variance exceeds the threshold."""
    wide = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "variance").where(F.col("variance") > threshold)


def select_by_correlation(df: DataFrame, columns: list[str], target: str, threshold: float = 0.5) -> DataFrame:
    """(feature, r) with |r| at or over the threshold against the target."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "r").where(F.abs("r") >= threshold)


def select_by_anova(df: DataFrame, columns: list[str], category: str, k: int = 10) -> DataFrame:
    """The k features (feature, f_statistic) that separate the classes best."""
    parts = [anova(df, category, c).select(F.lit(c).alias("feature"), "f_statistic") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("f_statistic"), "feature").limit(k)


def mutual_information(df: DataFrame, feature: str, target: str, bins: int = 10) -> DataFrame:
    """One row (feature, n, mi, nmi): mutual information in nats from joint counts, and over the larger entropy.

    Numbers with more than ``bins`` distinct values are cut into as many equal widths; strings, booleans and few values count as they are.
    """
    rows = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull())

    def discrete(c: str, out: DataFrame) -> DataFrame:
        if df.schema[c].dataType.typeName() in ("string", "boolean") or out.select(c).distinct().limit(bins + 1).count() <= bins:
            return out.withColumn(f"_{c}", F.col(c).cast("string"))
        s = out.agg(F.min(c).cast("double").alias("_lo"), F.max(c).cast("double").alias("_hi"))
        at = F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
        return out.join(F.broadcast(s), F.lit(True)).withColumn(f"_{c}", at.cast("string")).drop("_lo", "_hi")

    joint = discrete(target, discrete(feature, rows)).groupBy(F.col(f"_{feature}").alias("x"), F.col(f"_{target}").alias("y")).agg(F.count("*").alias("c"))
    sides = {k: joint.groupBy(k).agg(F.sum("c").alias(f"c_{k}")) for k in ("x", "y")}
    total = joint.agg(F.sum("c").alias("n"))
    cells = joint.join(sides["x"], "x").join(sides["y"], "y").join(F.broadcast(total), F.lit(True))
    mi = cells.agg(F.max("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("c_x") * F.col("c_y")))).alias("mi"))
    for k, side in sides.items():
        share = F.col(f"c_{k}") / F.col("n")
        mi = mi.join(F.broadcast(side.join(F.broadcast(total), F.lit(True)).agg((-F.sum(share * F.log(share))).alias(f"h_{k}"))), F.lit(True))
    return mi.select(F.lit(feature).alias("feature"), "n", "mi", F.try_divide("mi", F.greatest("h_x", "h_y")).alias("nmi"))


def select_by_mutual_information(df: DataFrame, columns: list[str], target: str, k: int | None = None, percentile: float | None = None, bins: int = 10, digits: int | None = None) -> DataFrame:
    """(feature, mi, nmi) of the k features, or of the given share of them, that tell most about the target.

    Features that tell as much, to ``digits`` decimals where given, go by name.
    """
    out = None
    for c in columns:
        one = mutual_information(df, c, target, bins).select("feature", "mi", "nmi")
        out = one if out is None else out.unionByName(one)
    k = k if k is not None else max(1, round(len(columns) * (percentile if percentile is not None else 0.5)))
    return out.orderBy(F.desc("mi" if digits is None else F.round("mi", digits)), "feature").limit(k)


def select_by_lag(df: DataFrame, columns: list[str], target: str, order_by: list[str], max_lag: int = 5) -> DataFrame:
    """(feature, lag, r): the lag at which a feature's past correlates most with the target."""
    blocks = ordered(df.select(*dict.fromkeys([*columns, target, *order_by])), order_by).blocks(max_lag)
    lagged = blocks.select("_own", F.col(target).alias("_t"), *[F.lag(c, k).over(by_pos()).alias(f"{c}@{k}") for c in columns for k in range(1, max_lag + 1)])
    wide = lagged.where("_own").agg(*[F.corr(F.col(f"`{c}@{k}`"), F.col("_t")).alias(f"{c}@{k}") for c in columns for k in range(1, max_lag + 1)])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(k).alias("lag"), F.col(f"`{c}@{k}`").alias("r")) for c in columns for k in range(1, max_lag + 1)]
    out = wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return out.groupBy("feature").agg(F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("b")).select("feature", "b.lag", "b.r")


def select_cumulative(importances: DataFrame, share: float = 0.9) -> DataFrame:
    """(feature, importance, cumulative): the strongest features up to the share, the crossing one included."""
    w = W.orderBy(F.desc("importance"), "feature")
    out = importances.withColumn("cumulative", F.sum("importance").over(w) / F.sum("importance").over(W.partitionBy()))
    before = F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))
    return out.withColumn("_before", before).where(F.col("_before") < share).drop("_before")


def group_importance(importances: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, importance): sums over features whose name contains the pattern; a feature may count for several."""
    p = importances.sparkSession.createDataFrame([(x,) for x in patterns], "pattern string")
    return importances.join(F.broadcast(p), F.col("feature").contains(F.col("pattern"))).groupBy("pattern").agg(F.sum("importance").alias("importance"))


def redundant_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    return pearson(df, columns).where(F.abs("r") >= threshold)


# splits


def hash_order(id_col: str, seed: int = 42) -> Column:
    """A deterministic order that both engines can compute: md5 of the seed and the id."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def split_hash(df: DataFrame, id_col: str, test_size: float = 0.2, stratify_by: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with split: exactly floor(n * test_size) test rows of every stratum, by hash order.

    Hashes are counted by their first digits; only rows whose digits are those of a stratum's cut are put in order.
    """
    key = F.col(stratify_by) if stratify_by else F.lit(0)
    keyed = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_k", key).withColumn("_p", F.substring("_h", 1, 3))
    sizes = keyed.where("_p IS NOT NULL AND _k IS NOT NULL").groupBy("_k", "_p").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_k").orderBy("_p"))
    want = F.floor(F.sum("_c").over(W.partitionBy("_k")) * test_size)
    before = sizes.select("_k", "_p", (want - upto + F.col("_c")).alias("_left")).where("_left >= 0")
    cuts = before.groupBy("_k").agg(F.max(F.struct(F.col("_p").alias("_cut"), "_left")).alias("_at")).select("_k", "_at.*")
    met = keyed.where("_p IS NOT NULL").join(F.broadcast(cuts), "_k")
    sure = met.where("_p <> _cut").withColumn("split", F.when(F.col("_p") < F.col("_cut"), "test").otherwise("train"))
    rank = F.row_number().over(W.partitionBy("_k").orderBy("_h"))
    near = met.where("_p = _cut").withColumn("split", F.when(rank <= F.col("_left"), "test").otherwise("train"))
    return sure.unionAll(near).drop("_h", "_k", "_p", "_cut", "_left")


def split_time(df: DataFrame, date_col: str, test_size: float = 0.2, gap: str | None = None) -> DataFrame:
    """``df`` with split: rows from the date at place n - floor(n * test_size) on are test; train ends ``gap`` before; NULL in between.

    The place is found by numbered ranges, so no window holds all rows.
    """
    o = ordered(df.select(date_col), [date_col])
    cut = o.rows.where(F.col("pos") == o.n - math.floor(o.n * test_size)).agg(F.min(date_col).alias("_cut"))
    out = df.join(F.broadcast(cut), F.lit(True))
    edge = F.col("_cut") - F.expr(f"INTERVAL {gap}") if gap else F.col("_cut")
    return out.withColumn("split", F.when(F.col(date_col) >= F.col("_cut"), "test").when(F.col(date_col) < edge, "train")).drop("_cut")


def split_time_by_group(df: DataFrame, group_col: str, order_by: list[str], test_size: float = 0.2) -> DataFrame:
    """``df`` with split: the last max(1, floor(n * test_size)) rows of each group, at most n - 1."""
    n = F.count("*").over(W.partitionBy(group_col))
    rn = F.row_number().over(W.partitionBy(group_col).orderBy(*order_by))
    size = F.least(F.greatest(F.lit(1), F.floor(n * test_size)), n - 1)
    return df.withColumn("split", F.when(rn > n - size, "test").otherwise("train"))


def kfold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with fold in 0 .. k - 1 by md5."""
    return df.withColumn("fold", (F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long") % k).cast("int"))


def walk_forward(df: DataFrame, order_by: list[str], folds: int = 5, expanding: bool = True) -> DataFrame:
    """(fold, role, n, first, last) over rows in order: equal test blocks, all or only the last block before as train."""
    o = ordered(df.select(*order_by), order_by)
    rn = o.rows.select(F.col(order_by[0]).alias("o"), o.ntile(folds + 1).alias("block"))
    blocks = rn.groupBy("block").agg(F.count("*").alias("n"), F.min("o").alias("first"), F.max("o").alias("last"))
    f = df.sparkSession.range(1, folds + 1).select(F.col("id").cast("int").alias("fold"))
    near = (F.col("block") <= F.col("fold") + 1) if expanding else F.col("block").between(F.col("fold"), F.col("fold") + 1)
    role = F.when(F.col("block") == F.col("fold") + 1, "test").otherwise("train").alias("role")
    return f.join(F.broadcast(blocks), near).groupBy("fold", role).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


# metrics


def classification_metrics(df: DataFrame, truth: str, predicted: str, average: str = "macro") -> DataFrame:
    """One row: accuracy and averaged precision, recall and F1 from the confusion table."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p")))).alias("s"), "n", (F.col("t") == F.col("p")).alias("hit"))
    per = sides.groupBy("s.c").agg(F.sum(F.col("n") * F.col("s.is_t")).alias("support"), F.sum(F.col("n") * F.col("s.is_p")).alias("called"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.is_t")).otherwise(0)).alias("tp"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.withColumns({"precision": z(ratio(F.col("tp"), F.col("called"))), "recall": z(ratio(F.col("tp"), F.col("support")))})
    per = per.withColumn("f1", z(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    mean = (lambda c: F.avg(c)) if average == "macro" else (lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support"))
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *[mean(c).alias(c) for c in ("precision", "recall", "f1")])


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row (auc): by average ranks over distinct scores, so ties count half."""
    c = df.groupBy(score).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    c = running_totals(c, [], score, ["n"])
    r = c.select("p", "n", (F.col("run_n") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return r.agg(F.try_divide(F.sum(F.col("rank") * F.col("p")) - pos * (pos + 1) / 2, (pos * neg).cast("double")).alias("auc"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: mse, rmse, mae, median_ae, mape (denominators of at least 1e-10) and r2."""
    middle = exact_quantiles(df, {"e": F.abs(F.col(truth) - F.col(predicted))}, [0.5])["e"][0]
    return mean_errors(df, truth, predicted).select("mse", "rmse", "mae", F.lit(middle).cast("double").alias("median_ae"), "mape", "r2")


def mean_errors(df: DataFrame, truth: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, mse, rmse, mae, mape, r2): what one scan tells, without the median."""
    e, t = F.col(truth) - F.col(predicted), F.col(truth)
    out = df.groupBy(*(keys or [])).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(1e-10))).alias("mape"), F.var_pop(t).alias("_v"))
    return out.select(*(keys or []), "mse", F.sqrt("mse").alias("rmse"), "mae", "mape", (1 - ratio(F.col("mse"), F.col("_v"))).alias("r2"))


def threshold_curve(df: DataFrame, truth: str, score: str, steps: int = 99) -> DataFrame:
    """(threshold, tp, fp, fn, tn, f1, ...) at 0.01 .. 0.99: scores are counted in bins first, so rows meet the grid once."""
    bins = df.groupBy(F.least(F.lit(steps), F.floor(F.col(score) * (steps + 1) + 1e-9)).cast("int").alias("bin")).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(1, steps + 1).select((F.col("id") / (steps + 1)).alias("threshold"), F.col("id").cast("int").alias("at"))
    hit = F.col("bin") >= F.col("at")
    c = grid.join(F.broadcast(bins), F.lit(True)).groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("p")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("p"))).alias("fn"), F.sum(F.when(hit, 0).otherwise(F.col("n") - F.col("p"))).alias("tn"),
    )
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "f1": z(2 * tp, 2 * tp + fp + fn), "accuracy": z(tp + tn, tp + fp + fn + tn), "youden": z(tp, tp + fn) + z(tn, tn + fp) - 1})


def optimal_threshold(df: DataFrame, truth: str, score: str, metric: str = "f1") -> DataFrame:
    """The row of threshold_curve with the best metric, the lowest threshold on ties."""
    return threshold_curve(df, truth, score).orderBy(F.desc(F.round(metric, 12)), "threshold").limit(1)


def calibration_bins(df: DataFrame, truth: str, score: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, observed, gap)."""
    b = F.least(F.lit(n_bins - 1), F.floor(F.col(score) * n_bins)).cast("int").alias("bin")
    out = df.groupBy(b).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("observed"))
    return out.withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def calibration_error(df: DataFrame, truth: str, score: str, n_bins: int = 10) -> DataFrame:
    """One row: brier, ece_uniform (gaps over all bins) and ece_weighted (by rows)."""
    bins = calibration_bins(df, truth, score, n_bins).agg((F.sum("gap") / n_bins).alias("ece_uniform"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece_weighted"))
    return df.agg(F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2))).alias("brier")).join(F.broadcast(bins), F.lit(True))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share, weight): weights that give every class the same mass."""
    c = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = W.partitionBy()
    return c.select("label", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.sum("n").over(w) / (F.count("*").over(w) * F.col("n"))).alias("weight"))


def undersample(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class cut to about the smallest one's size, by hash of the id."""
    c = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    share = c.select("_l", (F.min("_n").over(W.partitionBy()) / F.col("_n")).alias("_s"))
    unit = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.join(F.broadcast(share), F.col(label) == F.col("_l")).where(unit < F.col("_s")).drop("_l", "_s")


def oversample(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Every class brought to about the largest one's size by whole copies, and one more of a part of its rows, by hash of the id."""
    c = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    times = c.select("_l", (F.max("_n").over(W.partitionBy()) / F.col("_n")).alias("_t"))
    unit = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    copies = (F.floor("_t") + (unit < F.col("_t") - F.floor("_t")).cast("int")).cast("int")
    return df.join(F.broadcast(times), F.col(label) == F.col("_l")).select(*df.columns, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


# models


def make_model(name: str, problem: str, **params):
    """An ML estimator by name: linear, ridge, lasso, logistic, forest, gbt, tree or svm."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    known = {
        "classification": {"logistic": C.LogisticRegression, "forest": C.RandomForestClassifier, "gbt": C.GBTClassifier, "tree": C.DecisionTreeClassifier, "svm": C.LinearSVC},
        "regression": {"linear": R.LinearRegression, "forest": R.RandomForestRegressor, "gbt": R.GBTRegressor, "tree": R.DecisionTreeRegressor, "ridge": lambda **p: R.LinearRegression(regParam=p.pop("alpha", 1.0), elasticNetParam=0.0, **p), "lasso": lambda **p: R.LinearRegression(regParam=p.pop("alpha", 1.0), elasticNetParam=1.0, **p)},
    }
    if name not in known[problem]:
        raise ValueError(f"{problem} model {name!r} is not one of {sorted(known[problem])}")
    return known[problem][name](**params)


def auto_model(df: DataFrame, id_col: str, target: str, numeric: list[str], categorical: list[str], problem: str = "regression", model: str | None = None):
    """(fitted pipeline, test metrics): hash split, imputed numbers, one-hot categories, one model.

    The columns at work are split and written once; every stage reads them again.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler

    used = list(dict.fromkeys([*numeric, *categorical, target]))
    rows = split_hash(df.where(F.col(target).isNotNull()).select(*dict.fromkeys([id_col, *used])), id_col).select(*used, "split")
    rows = materialize(rows.withColumns({c: F.col(c).cast("double") for c in [*numeric, target]}), "split")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    stages = [Imputer(inputCols=numeric, outputCols=[f"{c}_in" for c in numeric])]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_ix", outputCol=f"{c}_in")]
    stages.append(VectorAssembler(inputCols=[f"{c}_in" for c in [*numeric, *categorical]], outputCol="features"))
    stages.append(make_model(model or {"regression": "linear", "classification": "logistic"}[problem], problem).setLabelCol(target))
    fitted = Pipeline(stages=stages).fit(train)
    metrics = regression_metrics if problem == "regression" else classification_metrics
    return fitted, metrics(fitted.transform(test), target, "prediction")


def cross_validate(df: DataFrame, id_col: str, target: str, features: list[str], model: str = "linear", problem: str = "regression", k: int = 3) -> DataFrame:
    """(fold, metrics): one model per fold column value."""
    from pyspark.ml.feature import VectorAssembler

    rows = kfold(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df), id_col, k).withColumn(target, F.col(target).cast("double"))
    metrics = regression_metrics if problem == "regression" else classification_metrics
    out = None
    for f in range(k):
        fitted = make_model(model, problem).setLabelCol(target).fit(rows.where(F.col("fold") != f))
        one = metrics(fitted.transform(rows.where(F.col("fold") == f)), target, "prediction").withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


#: What select_features knows; each takes (df, columns, target, ...) and returns a table with ``feature``.
SELECTORS = {
    "variance": lambda df, columns, target, **p: select_by_variance(df, columns, **p),
    "correlation": select_by_correlation,
    "anova": select_by_anova,
    "mutual_information": select_by_mutual_information,
    "percentile": lambda df, columns, target, percentile=0.5, **p: select_by_mutual_information(df, columns, target, percentile=percentile, **p),
    "importance": lambda df, columns, target, k=5, **p: feature_importance(df, columns, target, **p).orderBy(F.desc("importance"), "feature").limit(k),
    "lag": select_by_lag,
}


def select_features(df: DataFrame, columns: list[str], target: str, method: str, **params) -> tuple[DataFrame, DataFrame]:
    """(``df`` with the selected features and all columns that were no candidates, the table of selected features)."""
    if method not in SELECTORS:
        raise ValueError(f"method {method!r} is not one of {sorted(SELECTORS)}")
    found = SELECTORS[method](df, columns, target, **params)
    kept = {r["feature"] for r in found.select("feature").collect()}  # at most the number of columns
    return df.select(*[c for c in df.columns if c in kept or c not in columns]), found


def train_cross_validated(df: DataFrame, id_col: str, target: str, features: list[str], model: str = "linear", problem: str = "regression", grid: dict[str, list] | None = None, k: int = 3, parallelism: int = 2):
    """(best model, table of params and mean metric): a parameter grid over k folds dealt by hash of the id."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    estimator = make_model(model, problem).setLabelCol(target)
    builder = ParamGridBuilder()
    for name, values in (grid or {}).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    evaluator = RegressionEvaluator(labelCol=target) if problem == "regression" else MulticlassClassificationEvaluator(labelCol=target)
    whole = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), estimator])
    rows = kfold(df, id_col, k).select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])], F.col("fold").cast("int").alias("fold"))
    rows = materialize(rows, "folds")
    cv = CrossValidator(estimator=whole, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=k, foldCol="fold", parallelism=parallelism).fit(rows)
    names = [",".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)) for m in cv.getEstimatorParamMaps()]
    table = df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, cv.avgMetrics, strict=True)], f"params string, {evaluator.getMetricName()} double")
    return cv.bestModel, table


def permutation_importance(fitted, df: DataFrame, id_col: str, target: str, features: list[str], metric: str = "rmse", seed: int = 42) -> DataFrame:
    """(feature, importance): how much worse a regression metric gets when a feature's values are dealt anew by hash order.

    Rows are dealt to buckets and numbered there in two orders; a row takes the features' values of the row with its number in
    the other order. Every row comes once as it is and once for every feature, and one model run scores them all.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(64)).alias("_b")
    own = df.select("*", place).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(id_col)))
    other = df.select(place, F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("_h"), *[F.col(f).alias(f"_v{i}") for i, f in enumerate(features)])
    other = other.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h"))).drop("_h")
    versions = [F.struct(F.lit(n).alias("_n"), *[F.col(f"_v{i}" if n == i + 1 else f).alias(f"_v{i}") for i, f in enumerate(features)]) for n in range(len(features) + 1)]
    kept = [c for c in df.columns if c not in features]
    each = own.join(other, ["_b", "_r"]).select(*kept, F.explode(F.array(*versions)).alias("_x"))
    dealt = each.select(*kept, "_x._n", *[F.col(f"_x._v{i}").alias(f) for i, f in enumerate(features)])
    scored = fitted.transform(dealt).select("_n", F.col(target).alias("_t"), F.col("prediction").alias("_p"))
    if metric == "median_ae":
        scored = materialize(scored, "scored")
        middle = exact_quantiles(scored, {str(n): F.when(F.col("_n") == n, F.abs(F.col("_t") - F.col("_p"))) for n in range(len(versions))}, [0.5])
        found = df.sparkSession.createDataFrame([(int(n), v[0]) for n, v in middle.items()], "_n int, m double")
    else:
        found = mean_errors(scored, "_t", "_p", ["_n"]).select("_n", F.col(metric).alias("m"))
    base = F.max(F.when(F.col("_n") == 0, F.col("m"))).over(W.partitionBy())
    return found.withColumn("_base", base).where("_n > 0").select(F.element_at(F.array(*map(F.lit, features)), F.col("_n")).alias("feature"), (F.col("m") - F.col("_base")).alias("importance"))


def calibrate(df: DataFrame, truth: str, score: str, method: str = "isotonic") -> DataFrame:
    """``df`` with <score>_calibrated by isotonic regression or a logistic (sigmoid) fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    x = VectorAssembler(inputCols=[score], outputCol="_x").transform(df).withColumn("_y", F.col(truth).cast("double"))
    if method == "isotonic":
        out = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_p").fit(x).transform(x).withColumn(f"{score}_calibrated", F.col("_p"))
    elif method == "sigmoid":
        out = LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_c").fit(x).transform(x)
        out = out.withColumn(f"{score}_calibrated", vector_to_array("_p")[1])
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select(*df.columns, f"{score}_calibrated")


def stability_selection(df: DataFrame, id_col: str, features: list[str], target: str, rounds: int = 20, threshold: float = 0.6, keep: int | None = None) -> DataFrame:
    """(feature, frequency): in how many hash halves of the rows a feature is among the most correlated with the target.

    All halves are one aggregate over the table.
    """
    keep = keep or max(1, len(features) // 2)
    half = lambda r: F.pmod(F.xxhash64(F.lit(r), F.col(id_col)), F.lit(2)) == 0
    wide = df.agg(*[F.corr(F.when(half(r), F.col(f)), F.col(target)).alias(f"c{r}_{i}") for r in range(rounds) for i, f in enumerate(features)])
    rows = [F.struct(F.lit(r).alias("round"), F.lit(f).alias("feature"), F.abs(F.col(f"c{r}_{i}")).alias("r")) for r in range(rounds) for i, f in enumerate(features)]
    ranked = wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("rk", F.row_number().over(W.partitionBy("round").orderBy(F.desc_nulls_last("r"), "feature")))
    return ranked.groupBy("feature").agg((F.sum(F.when(F.col("rk") <= keep, 1).otherwise(0)) / rounds).alias("frequency")).where(F.col("frequency") >= threshold)


def recursive_elimination(df: DataFrame, id_col: str, features: list[str], target: str, least: int = 1) -> DataFrame:
    """(n_features, features, r2): drop the feature with the weakest standardised weight, refit, repeat; test r2 by hash split."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    left, rows, used = list(features), [], list(dict.fromkeys([*features, target]))
    data = split_hash(df.select(*dict.fromkeys([id_col, *used])), id_col).select(*[F.col(c).cast("double").alias(c) for c in used], "split")
    data = materialize(data, "split")
    while len(left) >= least:
        x = VectorAssembler(inputCols=left, outputCol="_raw", handleInvalid="skip").transform(data)
        x = StandardScaler(inputCol="_raw", outputCol="features").fit(x).transform(x)
        fitted = make_model("linear", "regression").setLabelCol(target).fit(x.where("split = 'train'"))
        score = mean_errors(fitted.transform(x.where("split = 'test'")), target, "prediction").head()["r2"]
        rows.append((len(left), ",".join(left), float(score)))
        weakest = min(zip(map(abs, fitted.coefficients.toArray()), left, strict=True))[1]
        left.remove(weakest)
    return df.sparkSession.createDataFrame(rows, "n_features int, features string, r2 double")
