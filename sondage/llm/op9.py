"""Query of the toxicity classifier."""

from pyspark.sql import functions as F

from .folds import fold
from .registry import case, table
from .toxicity import score, train_by_id


@case("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 3) != 1)
    model = train_by_id(docs, labels, label="toxic")
    return score(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
