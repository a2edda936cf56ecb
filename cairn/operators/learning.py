"""Model-backed operators on ``pyspark.ml``: importance, imputation, model choice, topics.

Everything trains distributed; features that are missing are imputed by their mean. Seeds are fixed, so
results repeat on the same partitions. Tables with fewer than two labels give empty results.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from cairn.operators.clean import handle_missing
from cairn.operators.profile import finite
from cairn.operators.relational import hash_order


def _features(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    x = df.select(*keep, *[finite(df.schema, c).alias(c) for c in names])
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(handle_missing(x, "mean", names))


def importance(df: DataFrame, names: list[str], target: str, trees: int = 20, seed: int = 1) -> DataFrame:
    """(column_name, importance) by a random forest on an indexed target."""
    x = _features(df.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("string")), names, ["_y"])
    x = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(x).transform(x)
    m = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed).fit(x)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(names, m.featureImportances.toArray())], "column_name string, importance double")


def model_impute(df: DataFrame, key: str, name: str, by: list[str], kind: str = "forest", seed: int = 1) -> DataFrame:
    """(key, imputed) of rows without ``name``: predicted from the other columns by a forest, boosted trees or a line."""
    est = {"forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed), "boosted": GBTRegressor(maxIter=15, maxDepth=4, seed=seed), "linear": LinearRegression(regParam=0.01)}[kind]
    est = est.setLabelCol("label")
    x = _features(df.withColumn("label", finite(df.schema, name)), by, [key, "label"])
    model = est.fit(x.where("label IS NOT NULL"))
    return model.transform(x.where("label IS NULL")).select(key, F.col("prediction").alias("imputed"))


def leaderboard(df: DataFrame, key: str, names: list[str], target: str, folds: int = 3, task: str = "classification", seed: int = 42) -> DataFrame:
    """(model, score, rank): cross-validated over folds by a seeded hash of the key; f1 or negative rmse."""
    if task == "classification":
        x = df.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("string"))
        x = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(x).transform(x)
        models = {"logistic": LogisticRegression(maxIter=20), "tree": DecisionTreeClassifier(maxDepth=5, seed=seed), "forest": RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed)}
        ev, sign = MulticlassClassificationEvaluator(metricName="f1"), 1
    else:
        x = df.withColumn("label", finite(df.schema, target)).where("label IS NOT NULL")
        models = {"linear": LinearRegression(maxIter=20), "tree": DecisionTreeRegressor(maxDepth=5, seed=seed), "forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed)}
        ev, sign = RegressionEvaluator(metricName="rmse"), -1
    fold = (F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long") % folds).cast("int")
    x = _features(x.withColumn("fold", fold), names, ["label", "fold"])
    rows = []
    for n, m in models.items():
        s = [sign * ev.evaluate(m.fit(x.where(F.col("fold") != k)).transform(x.where(F.col("fold") == k))) for k in range(folds)]
        rows.append((n, float(sum(s) / len(s))))
    rows = [(n, s, i + 1) for i, (n, s) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    return df.sparkSession.createDataFrame(rows, "model string, score double, rank int")


def pipeline(names: list[str], target: str) -> Pipeline:
    """An unfitted pipeline for a table: label index, assembled features, a forest."""
    return Pipeline(stages=[StringIndexer(inputCol=target, outputCol="label"), VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"), RandomForestClassifier(seed=1)])


def topics(df: DataFrame, key: str, name: str, k: int = 5, words_each: int = 8, seed: int = 1) -> DataFrame:
    """(topic, word, weight) of a topic model over words of four letters and more; the vocabulary is bounded."""
    tokens = F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(\p{L}{4,})"), 1), lambda w: w != "")
    x = df.select(key, tokens.alias("words")).where(F.size("words") >= 5)
    cv = CountVectorizer(inputCol="words", outputCol="features", vocabSize=5000, minDF=2.0).fit(x)
    m = LDA(k=k, maxIter=8, seed=seed, optimizer="online").fit(cv.transform(x))
    vocab = cv.vocabulary
    rows = [(r["topic"], vocab[i], float(w)) for r in m.describeTopics(words_each).collect() for i, w in zip(r["termIndices"], r["termWeights"])]
    return df.sparkSession.createDataFrame(rows, "topic int, word string, weight double")
