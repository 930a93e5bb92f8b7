"""Text classification: TF-IDF of words and pairs, linear SVM, metrics by `analytics` (M1 to M4)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def terms(df: DataFrame, text: str, name: str = "terms") -> DataFrame:
    """Words of two characters or more, lower case, and adjacent pairs of them."""
    t = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    rows = df.withColumn("__w", t)
    n = F.greatest(F.size("__w") - 1, F.lit(0))
    two = F.zip_with(F.slice("__w", F.lit(1), n), F.slice("__w", F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return rows.withColumn(name, F.concat("__w", two)).drop("__w")


def fit(train: DataFrame, text: str, label: str, size: int = 5000, iterations: int = 50) -> PipelineModel:
    """M1, M2: vocabulary and weights of the training rows only; one SVM per label, rows weighted inversely to their label's share."""
    rows = terms(train, text)
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep").fit(rows)
    counts = CountVectorizer(inputCol="terms", outputCol="counts", vocabSize=size).fit(rows)
    counted = counts.transform(index.transform(rows))
    # Smoothed inverse document frequency with one added, as the usual definition has it.
    idf = IDF(inputCol="counts", outputCol="idf").fit(counted)
    scale = ElementwiseProduct(scalingVec=idf.idf.toArray() + 1.0, inputCol="counts", outputCol="scaled")
    norm = Normalizer(p=2.0, inputCol="scaled", outputCol="features")
    ready = norm.transform(scale.transform(counted))
    share = ready.groupBy("label_index").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy()  # one row per label is left
    weights = share.select("label_index", (F.sum("__n").over(whole) / (F.count("*").over(whole) * F.col("__n"))).alias("weight"))
    ready = ready.join(F.broadcast(weights), "label_index").select("label_index", "features", "weight").cache()  # one row per label is broadcast
    svm = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.001), labelCol="label_index", featuresCol="features", predictionCol="prediction", weightCol="weight").fit(ready)
    ready.unpersist()
    model = PipelineModel([index, counts, scale, norm, svm])
    return model


def predict(model: PipelineModel, df: DataFrame, text: str, label: str, id_col: str | None = "id_review") -> DataFrame:
    """M3: [id], text, emotion_real, emotion_pred."""
    index, *rest = model.stages
    rows = terms(df, text)
    for stage in rest:
        rows = stage.transform(rows)
    names = F.array(*map(F.lit, index.labels))
    keep = [id_col] if id_col and id_col in df.columns else []
    return rows.select(*keep, text, F.col(label).alias("emotion_real"), F.get(names, F.col("prediction").cast("int")).alias("emotion_pred"))
