"""op1: `pages` as WARC records against a replica whose damage follows a rule, so that SQL can name what the audit must find.

The rule stands for a damaged copy, not for a filter: all pages are hashed in both replicas. Pages whose id leaves 7 on
division by 50 have one byte of their payload altered; those that leave 11 on division by 500 are lost; those that leave
13 on division by 500 have an unknown twin with a negative id.
"""

from pyspark.sql import functions as F

from .common import table
from .merkle import audit, warc_record

NAME = "op1_warc_fixity"


def damaged(pages):
    middle = F.floor(F.length("html") / 2).cast("int")
    altered = F.concat(F.substring("html", F.lit(1), middle), F.lit("~"), F.expr("substring(html, cast(floor(length(html) / 2) as int) + 2)"))
    rest = pages.where("page_id is null or page_id % 500 <> 11").withColumn("html", F.when(F.col("page_id") % 50 == 7, altered).otherwise(F.col("html")))
    return rest.unionByName(pages.where("page_id % 500 = 13").withColumn("page_id", -1 - F.col("page_id")))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages), "page_id", warc_record(F.col("url"), F.col("html"))).withColumnRenamed("key", "page_id")


SQL = """
WITH damaged AS (
    SELECT page_id, url, CASE WHEN page_id % 50 = 7 THEN left(html, length(html) // 2) || '~' || substring(html, length(html) // 2 + 2) ELSE html END AS html
    FROM pages WHERE page_id % 500 <> 11
    UNION ALL SELECT -1 - page_id, url, html FROM pages WHERE page_id % 500 = 13),
both_replicas AS (SELECT 0 AS replica, page_id, url, html FROM pages UNION ALL SELECT 1, page_id, url, html FROM damaged),
records AS (SELECT replica, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM both_replicas),
hashed AS (SELECT replica, page_id, strlen(record) AS n_bytes, sha256(record) AS h FROM records),
sums AS (SELECT replica, page_id, sum(n_bytes)::BIGINT AS n_bytes, count(*) AS n,
    sum(('0x' || substring(h, 1, 15))::BIGINT)::VARCHAR AS p0, sum(('0x' || substring(h, 16, 15))::BIGINT)::VARCHAR AS p1,
    sum(('0x' || substring(h, 31, 15))::BIGINT)::VARCHAR AS p2, sum(('0x' || substring(h, 46, 15))::BIGINT)::VARCHAR AS p3 FROM hashed GROUP BY replica, page_id),
leaves AS (SELECT replica, page_id, n_bytes, sha256(concat_ws(':', n, p0, p1, p2, p3)) AS digest FROM sums),
good AS (SELECT page_id, n_bytes, (sum(n_bytes) OVER (ORDER BY page_id) - n_bytes)::BIGINT AS first_offset, digest FROM leaves WHERE replica = 0)
SELECT coalesce(g.page_id, o.page_id) AS page_id, first_offset, g.n_bytes AS n_bytes, g.digest AS digest, o.digest AS other_digest
FROM good g FULL OUTER JOIN (SELECT * FROM leaves WHERE replica = 1) o ON g.page_id = o.page_id
WHERE g.digest IS DISTINCT FROM o.digest
"""
