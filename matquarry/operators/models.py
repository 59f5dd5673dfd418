"""Splits, metrics and boosted-tree baselines over composition features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..scratch import cut
from .ranks import quantiles, running

FEATURES = ["n_elements", "log_total", "entropy", "mean_z", "std_z", "min_z", "max_z", "range_z", "max_fraction", "norm"]


def hash_split(key: Column) -> Column:
    """80/10/10 by the first 8 hex digits of SHA-256."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(h < 80, "train").when(h < 90, "validation").otherwise("test")


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count("*")
    q90 = quantiles(df.withColumn("__far", F.abs(e)), keys, "__far", {"q90": 0.9})
    metrics = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(1 - F.sum(e * e) / F.nullif(total, F.lit(0.0)), 6).alias("r2"),
    )
    return metrics.join(q90, keys, "left").withColumn("q90", F.round("q90", 6))


def classification_metrics(df: DataFrame, keys: list[str], y: str, score: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, F1 and ROC-AUC; the AUC sums average ranks over distinct scores."""
    Y, C = F.col(y), F.col(predicted)
    # One row for each distinct score: average rank = rows below + (rows here + 1) / 2.
    ties = df.groupBy(*keys, score).agg(F.count("*").alias("n"), F.count_if(Y).alias("pos"))
    ranks = running(ties, keys, score).withColumn("rank_sum", F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2))
    auc = ranks.groupBy(*keys).agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    auc = auc.select(*keys, F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * F.col("q"), F.lit(0)), 6).alias("auc"))
    main = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(C == Y, 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.round((F.count_if(Y & C) / F.count_if(Y) + F.count_if(~Y & ~C) / F.count_if(~Y)) / 2, 6).alias("balanced"),
        F.round(2 * F.count_if(Y & C) / (2 * F.count_if(Y & C) + F.count_if(C != Y)), 6).alias("f1"),
    )
    return main.join(auc, keys)


def validate_composition(df: DataFrame, key: str, symbol: str, count: str, most: int | None = 18) -> DataFrame:
    """Status of each composition: element number (``most`` at most, if given), repeated symbols, count and total bounds."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(symbol).alias("kinds"), F.max(count).alias("most"), F.sum(count).alias("total"))
    many = F.lit(False) if most is None else F.col("n") > most
    status = F.when(F.col("n") < 2, "too_few").when(many, "too_many").when(F.col("kinds") < F.col("n"), "duplicate").when(F.col("most") > 18, "count").when(F.col("total") > 24, "total").otherwise("ok")
    return g.select(key, status.alias("status"))


#: Largest value of each target and whether its logarithm is learnt (fixed values).
TARGETS = {"formation": (None, False), "gap": (15.0, True), "tc": (400.0, True)}
METAL = 0.05
#: Training rows that are worth a task of their own in each job of each tree.
ROWS_A_TASK = 20_000


def training_rows(measured: DataFrame) -> DataFrame:
    """key, elements, features, split and one target column for each property, of each composition.

    ``measured`` holds formula, property, value.  Targets are medians over all replicates of a composition; rows out
    of a target's range are left out.  The split goes by composition, so no composition is on two sides.
    """
    f = chem.per_formula(measured, "formula", key=chem.composition_key, comp=lambda c: c).where("key is not null")
    ok = F.lit(False)
    for name, (most, _) in TARGETS.items():
        ok = ok | ((F.col("property") == name) & (F.col("value").between(0, most) if most else F.col("value").isNotNull()))
    f = f.where(ok)
    targets = f.groupBy("key").pivot("property", list(TARGETS)).agg(F.median("value"))
    comps = f.select("key", "comp").groupBy("key").agg(F.any_value("comp").alias("comp"))
    stats = chem.features(comps, "key", "comp")
    rows = targets.join(comps, "key").join(stats, "key")
    return cut(rows.select("key", F.map_keys("comp").alias("elements"), chem.feature_vector(F.col("comp")).alias("fractions"), *FEATURES, hash_split(F.col("key")).alias("split"), *TARGETS))


def _vectors(rows: DataFrame) -> DataFrame:
    """vector: 118 fractions and the statistics."""
    return rows.withColumn("vector", array_to_vector(F.concat("fractions", F.array(*[F.col(c).cast("double") for c in FEATURES]))))


def _fitted(estimator, rows: DataFrame, y: Column):
    """The model fitted to ``rows`` (with a key) and ``y``; every tree reads the rows again, so they are kept while it is fitted.

    A tree is several jobs, so rows are dealt to no more tasks than ``ROWS_A_TASK`` each asks for.  They are sorted by key, so
    the sample of each tree doesn't depend on how the rows were stored.
    """
    parts = -(-rows.count() // ROWS_A_TASK) or 1
    rows = _vectors(rows).select("key", "vector", y.alias("y")).repartitionByRange(parts, "key").sortWithinPartitions("key").select("vector", "y").persist()
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def fit_regressor(rows: DataFrame, target: str, trees: int = 180) -> GBTRegressionModel:
    """Boosted trees for one property, on log1p where ``TARGETS`` says so; gaps are learnt on non-metals alone."""
    train = rows.where(F.col(target).isNotNull() & (F.col("split") == "train"))
    if target == "gap":
        train = train.where(F.col("gap") > METAL)
    y = F.log1p(target) if TARGETS[target][1] else F.col(target)
    gbt = GBTRegressor(labelCol="y", featuresCol="vector", maxIter=trees, maxDepth=3, stepSize=0.045, minInstancesPerNode=14, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=7)
    return _fitted(gbt, train, y)


def predict(model: GBTRegressionModel, rows: DataFrame, target: str) -> Column:
    """The prediction on the target's own scale, not below 0 where its logarithm is learnt."""
    return F.greatest(F.lit(0.0), F.expm1("prediction")) if TARGETS[target][1] else F.col("prediction")


def measured(model: GBTRegressionModel, rows: DataFrame, target: str) -> DataFrame:
    test = rows.where(F.col(target).isNotNull() & (F.col("split") == "test"))
    test = test.where(F.col("gap") > METAL) if target == "gap" else test
    scored = model.transform(_vectors(test)).select(F.lit(target).alias("property"), F.col(target).alias("y"), predict(model, rows, target).alias("p"))
    return regression_metrics(scored, ["property"], "y", "p")


def train_and_measure(rows: DataFrame, trees: int = 180) -> DataFrame:
    """Test metrics of one regressor for each target."""
    return reduce(DataFrame.unionByName, [measured(fit_regressor(rows, t, trees), rows, t) for t in TARGETS])


def fit_classifier(rows: DataFrame, trees: int = 180) -> GBTClassificationModel:
    """Metal (gap of ``METAL`` at most) or not."""
    train = rows.where(F.col("gap").isNotNull() & (F.col("split") == "train"))
    gbt = GBTClassifier(labelCol="y", featuresCol="vector", maxIter=trees, maxDepth=3, stepSize=0.045, minInstancesPerNode=14, subsamplingRate=0.8, featureSubsetStrategy="sqrt", seed=7)
    return _fitted(gbt, train, (F.col("gap") <= METAL).cast("double"))


def train_classifier(rows: DataFrame, trees: int = 180) -> DataFrame:
    test = _vectors(rows.where(F.col("gap").isNotNull() & (F.col("split") == "test")))
    scored = fit_classifier(rows, trees).transform(test).select((F.col("gap") <= METAL).alias("y"), vector_to_array("probability")[1].alias("p"), (F.col("prediction") > 0).alias("c"), F.lit("all").alias("part"))
    return classification_metrics(scored, ["part"], "y", "p", "c")


def score_compositions(rows: DataFrame, trees: int = 180) -> DataFrame:
    """Predictions of all targets and of the metal class for each composition, each with its test error's 90 % quantile,
    and whether the composition is inside what training has seen: outside for unseen elements, limited beyond six."""
    seen = rows.where("split = 'train'").select(F.explode("elements").alias("e")).agg(F.array_sort(F.collect_set("e")).alias("seen"))
    domain = F.when(F.size(F.array_except("elements", "seen")) > 0, "outside").when(F.size("elements") > 6, "limited").otherwise("inside")
    out = _vectors(rows)
    for t in TARGETS:
        model = fit_regressor(rows, t, trees)
        out = model.transform(out).withColumn(f"predicted_{t}", F.round(predict(model, rows, t), 4)).drop("prediction")
        out = out.join(F.broadcast(measured(model, rows, t).select(F.col("q90").alias(f"q90_{t}"))), F.lit(True), "left")
    out = fit_classifier(rows, trees).transform(out).withColumn("metal", F.round(vector_to_array("probability")[1], 4))
    names = [f"{kind}_{t}" for t in TARGETS for kind in ("predicted", "q90")]
    return out.join(F.broadcast(seen), F.lit(True)).select("key", *names, "metal", domain.alias("domain"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
