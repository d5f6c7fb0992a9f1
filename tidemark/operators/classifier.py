"""Two-class multi-layer classifier on embeddings, with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions.fixed_values import BATCH_SIZE, EPOCHS, HIDDEN_LAYERS, SPLIT_SEED


def train(
    dataset: DataFrame,
    size: int,
    hidden: Sequence[int] = tuple(HIDDEN_LAYERS),
    epochs: int = EPOCHS,
    embedding: str = "embedding",
    label: str = "label",
    block: int = BATCH_SIZE,
    seed: int = SPLIT_SEED,
) -> MultilayerPerceptronClassificationModel:
    """Fit ``size -> hidden… -> 2``; gradients are summed over the partitions."""
    estimator = MultilayerPerceptronClassifier(
        layers=[size, *hidden, 2],
        maxIter=epochs,
        blockSize=block,
        seed=seed,
        featuresCol="_features",
        labelCol="_label",
    )
    return estimator.fit(
        dataset.select(
            array_to_vector(F.col(embedding).cast("array<double>")).alias("_features"),
            F.col(label).cast("double").alias("_label"),
        )
    )


def argmax_class(probability: Column) -> Column:
    """1 if its probability is the larger one; a tie is class 0."""
    return F.when(probability[1] > probability[0], 1).otherwise(0)


def predict(
    model: MultilayerPerceptronClassificationModel, dataset: DataFrame, embedding: str = "embedding"
) -> DataFrame:
    """Add ``probability`` (two numbers) and ``prediction``."""
    vectors = dataset.withColumn("_features", array_to_vector(F.col(embedding).cast("array<double>")))
    scored = model.setPredictionCol("_class").setRawPredictionCol("_raw").setProbabilityCol("_p").transform(vectors)
    with_p = scored.withColumn("probability", vector_to_array("_p"))
    return with_p.withColumn("prediction", argmax_class(F.col("probability"))).select(
        *dataset.columns, "probability", "prediction"
    )


def history(model: MultilayerPerceptronClassificationModel, dataset: DataFrame) -> DataFrame:
    """Training loss per iteration; the first row is the loss before training."""
    losses = [(i, float(loss)) for i, loss in enumerate(model.summary().objectiveHistory)]
    schema = StructType([StructField("epoch", IntegerType()), StructField("loss", DoubleType())])
    return dataset.sparkSession.createDataFrame(losses, schema)
