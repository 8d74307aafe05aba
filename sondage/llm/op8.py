"""Query of language identification."""

from pyspark.sql import functions as F

from .folds import fold
from .language import identify, train
from .registry import case, table


@case("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
