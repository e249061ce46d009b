"""Hotspot model: features, labels, training, scoring, evaluation."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.fixed_values import BASIC_FEATURE_NAMES, FEATURE_NAMES
from ..functions.paths import is_source
from ..session import cut_lineage
from .grouping import exact_quantiles, hash_share, skew_join
from .history import COMMIT, FILE


def recent_author_count(commits: DataFrame, file_changes: DataFrame, n: int = 10) -> DataFrame:
    """Distinct author addresses among the newest ``n`` commits touching each file."""
    order = W.partitionBy(*FILE).orderBy(F.desc("committed_at"), F.desc("commit_hash"))
    newest = (file_changes.select(*COMMIT, "file_path")
              .join(commits.select(*COMMIT, "committed_at", "author_email"), COMMIT)
              .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n))
    return newest.groupBy(*FILE).agg(F.size(F.collect_set("author_email")).cast("long").alias("author_count"))


def training_rows(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """One row per touch of a source file."""
    source = file_changes.filter(is_source(F.col("file_path")))
    authors = recent_author_count(commits, source)
    return skew_join(source, authors, FILE).select(
        *FILE, F.col("lines").alias("lines_changed"), "insertions", "deletions",
        F.lit(1).cast("long").alias("commit_frequency"), "author_count",
        F.lit(False).alias("is_hotspot"))


def engineer_features(rows: DataFrame) -> DataFrame:
    """Thirteen features per file and whether it was ever marked."""
    base = rows.groupBy(*FILE).agg(
        F.sum("lines_changed").alias("lines_changed_sum"), F.avg("lines_changed").alias("lines_changed_mean"),
        F.coalesce(F.stddev_samp("lines_changed"), F.lit(0.0)).alias("lines_changed_std"),
        F.sum("insertions").alias("insertions_sum"), F.avg("insertions").alias("insertions_mean"),
        F.sum("deletions").alias("deletions_sum"), F.avg("deletions").alias("deletions_mean"),
        F.sum("commit_frequency").alias("commit_frequency_sum"),
        F.max("author_count").alias("author_count_max"), F.bool_or("is_hotspot").alias("is_hotspot"))
    frequency = F.col("commit_frequency_sum") + 1
    return base.select(
        *base.columns[:-1],
        (F.col("lines_changed_sum") / frequency).alias("change_rate"),
        (F.col("insertions_sum") / (F.col("deletions_sum") + 1)).alias("insertion_deletion_ratio"),
        (F.col("lines_changed_std") / (F.col("lines_changed_mean") + 1)).alias("change_volatility"),
        (F.col("author_count_max") / frequency).alias("author_diversity"), "is_hotspot")


def engineer_features_basic(touches: DataFrame) -> DataFrame:
    """Short variant: sums, mean complexity and two ratios. ``touches`` carries ``complexity``."""
    base = touches.groupBy(*FILE).agg(
        F.sum("lines").alias("lines_changed"), F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"), F.count(F.lit(1)).alias("commit_frequency"),
        F.avg("complexity").alias("complexity"))
    return base.select("*", (F.col("lines_changed") / F.col("commit_frequency")).alias("change_rate"),
                       (F.col("insertions") / (F.col("deletions") + 1)).alias("insertion_deletion_ratio"))


def _above(rows: DataFrame, limits: dict[str, tuple[str, float]], also: Column | None = None) -> DataFrame:
    """Mark rows above the exact per-repository quantile of every listed column."""
    test = F.lit(True) if also is None else also
    for name, (column, _) in limits.items():
        test = test & (F.col(column) > F.col(name))
    return (skew_join(rows, exact_quantiles(rows, ["repo_id"], limits), ["repo_id"])
            .withColumn("is_hotspot", test).drop(*limits))


def label_hotspots_synthetic(rows: DataFrame, frequency: str = "commit_frequency",
                             lines: str = "lines_changed", authors: str = "author_count") -> DataFrame:
    """Hot: frequency above its 0.8 quantile, lines above their 0.7 quantile, over two authors."""
    return _above(rows, {"_qf": (frequency, 0.8), "_ql": (lines, 0.7)}, F.col(authors) > 2)


def label_hotspots(features: DataFrame, frequency: str = "commit_frequency",
                   complexity: str = "complexity") -> DataFrame:
    """Hot: frequency and complexity both above their 0.75 quantile."""
    return _above(features, {"_qf": (frequency, 0.75), "_qc": (complexity, 0.75)})


def class_balance(df: DataFrame, label: str = "is_hotspot") -> DataFrame:
    """Rows and share per repository and label."""
    counts = df.groupBy("repo_id", label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("repo_id").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "repo_id").select("repo_id", label, "n", (F.col("n") / F.col("_total")).alias("share"))


def stratified_split(df: DataFrame, label: str = "is_hotspot", test_fraction: float = 0.2, seed: int = 42,
                     id_columns=("repo_id", "file_path"), stratified: bool = True) -> DataFrame:
    """Add ``is_test``: exactly the whole part of the fraction, per label when stratified."""
    if stratified:
        return hash_share(df, [label], list(id_columns), test_fraction, seed, "is_test")
    flat = df.withColumn("_all", F.lit(1))
    return hash_share(flat, ["_all"], list(id_columns), test_fraction, seed, "is_test").drop("_all")


def with_class_weight(df: DataFrame, label: str = "is_hotspot") -> DataFrame:
    """Add ``weight`` = rows / (classes * rows of the class), computed over two label counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    total, classes = sum(r["n"] for r in counts), len(counts)
    chain = F
    for r in counts:
        chain = chain.when(F.col(label) == r[label], F.lit(total / (classes * r["n"])))
    return df.withColumn("weight", chain.otherwise(F.lit(1.0)) if counts else F.lit(1.0))


def train_hotspot_model(train: DataFrame, features=FEATURE_NAMES, label: str = "is_hotspot",
                        trees: int = 200, depth: int = 10, seed: int = 42) -> PipelineModel:
    """Assembler, scaler and a class-weighted random forest.

    The training rows are written once: every stage and tree level reads them again.
    """
    kept = train.select(*features, label, F.col(label).cast("double").alias("label"))
    rows = with_class_weight(cut_lineage(kept), label)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
                               maxDepth=depth, minInstancesPerNode=2, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def train_basic_model(train: DataFrame, seed: int = 42) -> PipelineModel:
    """Short variant: five features, 100 trees."""
    return train_hotspot_model(train, BASIC_FEATURE_NAMES, trees=100, seed=seed)


def score_hotspots(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Add ``score``: probability of the hot class, or of the only class."""
    p = F.col("_p")
    return (model.transform(features).withColumn("_p", vector_to_array("probability"))
            .withColumn("score", F.when(F.size(p) > 1, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))))
            .drop("_p", "raw_features", "features", "rawPrediction", "probability"))


def confusion_matrix(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.groupBy(F.col(label).cast("double").alias("label"), "prediction").agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class, from the class pair counts."""
    pairs = confusion_matrix(predictions, label)
    rows = pairs.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"),
                 F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))))
    sums = rows.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("guessed").alias("_g"),
                                     F.sum("hit").alias("_h"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (sums.withColumn("precision", ratio("_h", "_g")).withColumn("recall", ratio("_h", "support"))
            .withColumn("f1", F.coalesce(F.try_divide(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
            .select("class", "precision", "recall", "f1", "support"))


def accuracy(predictions: DataFrame, label: str = "label") -> DataFrame:
    return predictions.agg(F.avg((F.col(label).cast("double") == F.col("prediction")).cast("double")).alias("accuracy"))


def feature_importance(spark: SparkSession, model: PipelineModel, k: int = 10) -> DataFrame:
    """The ``k`` most important features, best first."""
    names, weights = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(k)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model_or_none(spark: SparkSession, path: str) -> PipelineModel | None:
    """The stored model, or None when the folder holds none: the rule scores then apply."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return PipelineModel.load(path)


def _features(values) -> list[Column]:
    return [v.cast("double").alias(name) for name, v in zip(FEATURE_NAMES, values)]


def subsystem_features(rollup: DataFrame) -> DataFrame:
    """Serving features per subsystem, estimated from its rollup."""
    total, n, authors = F.col("total_files"), F.col("n"), F.col("authors")
    spread = F.when(n > 1, F.col("std_files")).otherwise(F.lit(0.0))
    return rollup.select("repo_id", "subsystem", *_features([
        total, total / n, spread, total * 0.6, total * 0.4, total * 0.4, total * 0.2, n, authors,
        total / (n + 1), F.lit(1.5), F.lit(0.5), authors / (n + 1)]))


def file_features(trends: DataFrame) -> DataFrame:
    """Serving features per file, estimated from complexity and change frequency."""
    c, f = F.col("complexity"), F.col("change_frequency")
    people = F.greatest(F.lit(1), F.floor(f / 3))
    return trends.select(*FILE, *_features([
        c * f, c, c * 0.1, c * 0.6, c * 0.5, c * 0.4, c * 0.3, f, people, c * f / (f + 1),
        F.lit(1.5), F.lit(0.3), people / (f + 1)]))


def file_scores(model: PipelineModel | None, trends: DataFrame) -> DataFrame | None:
    """Model score per file, or None without a model: the rule scores then apply."""
    return None if model is None else score_hotspots(model, file_features(trends)).select(*FILE, "score")


def subsystem_scores(model: PipelineModel | None, rollup: DataFrame) -> DataFrame | None:
    """Model score per subsystem, or None without a model."""
    if model is None:
        return None
    return score_hotspots(model, subsystem_features(rollup)).select("repo_id", "subsystem", "score")
