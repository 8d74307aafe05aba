"""Query of the fixity audit: the pages against a copy with known damage."""

from pyspark.sql import functions as F

from .fixity import audit
from .registry import case, table


def damaged(pages):
    """A replica that lost some records, changed others and has some under ids of its own."""
    kept = pages.where("page_id % 211 != 7")
    changed = kept.withColumn("html", F.when(F.col("page_id") % 97 == 3, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    return changed.unionByName(pages.where("page_id % 503 = 5").withColumn("page_id", -F.col("page_id") - 1))


_BYTES = """strlen('WARC/1.1') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:record:>')
          + strlen(CAST(page_id AS VARCHAR)) + 2 + strlen('WARC-Target-URI: ') + strlen(url) + 2 + strlen('Content-Length: ')
          + strlen(CAST(strlen(html) AS VARCHAR)) + 4 + strlen(html) + 4"""


@case("op5_fixity_audit", f"""
    WITH copy AS (SELECT page_id, url, CASE WHEN page_id % 97 = 3 THEN html || ' ' ELSE html END AS html FROM pages WHERE page_id % 211 != 7
        UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % 503 = 5),
      o AS (SELECT page_id, {_BYTES} AS n, sum(n) OVER (ORDER BY page_id) - n AS at FROM pages),
      c AS (SELECT page_id, {_BYTES} AS n, sum(n) OVER (ORDER BY page_id) - n AS at FROM copy)
    SELECT page_id AS record_id, CASE WHEN o.at IS NULL THEN 'extra' WHEN c.at IS NULL THEN 'missing' ELSE 'changed' END AS kind,
      CAST(o.at AS BIGINT) AS "offset", CAST(o.n AS BIGINT) AS length, CAST(c.at AS BIGINT) AS replica_offset, CAST(1 AS BIGINT) AS copies
    FROM o FULL JOIN c USING (page_id) WHERE o.at IS NULL OR c.at IS NULL OR page_id % 97 = 3""")
def op5_fixity_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))
