"""Query of the URL filters."""

from pyspark.sql import functions as F

from .registry import case, table
from .urlrules import judge, path


def labelled(pages, labels):
    """``url, label`` of the pages whose document has labels: the path is /language/doc_id. Toxic or low quality is block."""
    number = F.regexp_extract(path(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    known = labels.select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow").alias("label"))
    return pages.select("url", number.try_cast("long").alias("doc_id")).join(known, "doc_id").select("url", "label")


@case("op10_url_rules")
def op10_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, labelled(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", "mined")
