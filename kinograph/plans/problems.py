"""Registered queries of the data-processing problems that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.operators.skew import dominant_items, item_activity
from kinograph.sources.lines import parse_lines, rejected_lines, valid_rows

#: Rows of ``interactions`` with normal ids; one row for each user, item and timestamp.
USABLE = r"""
coded AS (SELECT nullif(regexp_extract(user_id, '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1), '') AS u,
                 nullif(regexp_extract(item_id, '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1), '') AS i, timestamp AS ts, event_id
          FROM interactions WHERE timestamp > 0),
usable AS (SELECT CAST(u AS BIGINT) AS u, CAST(i AS BIGINT) AS i, ts, min(event_id) AS event_id FROM coded
           WHERE u IS NOT NULL AND i IS NOT NULL GROUP BY 1, 2, 3)"""

#: The cells of each line and the reason that it fails.
LINES = r"""
stripped AS (SELECT *, coalesce(CASE WHEN line LIKE '%' || chr(13) THEN left(line, length(line) - 1) ELSE line END, '') AS t,
                    source_file LIKE '%.csv' AS pairs FROM raw_lines),
celled AS (SELECT *, pairs AND NOT regexp_full_match(t, '(?s)("([^"]|"")*"|[^",][^,]*|)(,("([^"]|"")*"|[^",][^,]*|))*') AS broken,
                  CASE WHEN pairs THEN [CASE WHEN c LIKE '"%' THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END
                                        FOR c IN regexp_extract_all(t || ',', '(?s)("(?:[^"]|"")*"|[^",][^,]*|),', 1)]
                       ELSE string_split(t, '::') END AS cells FROM stripped),
fields AS (SELECT *, regexp_extract(cells[1], '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1) AS u, regexp_extract(cells[2], '^[ \t]*0*([1-9][0-9]*)[ \t]*$', 1) AS i,
                  CASE WHEN NOT pairs THEN try_cast(cells[3] AS DOUBLE) END AS r, cells[CASE WHEN pairs THEN 3 ELSE 4 END] AS ts FROM celled),
judged AS (SELECT *, CASE WHEN broken THEN 'quoting' WHEN t = '' OR len(cells) <> CASE WHEN pairs THEN 3 ELSE 4 END THEN 'columns'
                  WHEN u = '' THEN 'user' WHEN i = '' THEN 'item'
                  WHEN NOT pairs AND (r IS NULL OR NOT isfinite(r) OR r < 0.5 OR r > 5 OR r * 2 <> floor(r * 2)) THEN 'rating'
                  WHEN NOT regexp_full_match(ts, '[0-9]+') OR try_cast(ts AS HUGEINT) IS NULL
                       OR try_cast(ts AS HUGEINT) > CASE WHEN pairs THEN 9223372036854775807 ELSE 9223372036854775 END THEN 'timestamp' END AS reason FROM fields)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_lines(parse_lines(table(spark, sf_dir, "raw_lines"))).select("line_id", "reason")


def p2_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(parse_lines(table(spark, sf_dir, "raw_lines"))).drop("line_no")


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_lines(table(spark, sf_dir, "raw_lines"))
    return parsed.groupBy("source_file", F.coalesce("reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_items(table(spark, sf_dir, "interactions"))


def p3_item_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_activity(table(spark, sf_dir, "interactions")).withColumn("share", F.round("share", 12))


QUERIES = {f.__name__: f for f in (p2_found, p2_valid_rows, p2_reasons, p3_found, p3_item_activity)}

ORACLE = {
    "p2_found": f"WITH {LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p2_valid_rows": f"""WITH {LINES} SELECT line_id, source_file, u AS user_id, i AS item_id, r AS rating,
        CAST(ts AS BIGINT) * CASE WHEN pairs THEN 1 ELSE 1000 END AS timestamp FROM judged WHERE reason IS NULL""",
    "p2_reasons": f"WITH {LINES} SELECT source_file, coalesce(reason, 'valid') AS outcome, count(*) AS lines FROM judged GROUP BY 1, 2",
    "p3_found": f"WITH {USABLE} SELECT i AS item_id FROM usable GROUP BY 1 HAVING count(*) > 0.02 * (SELECT count(*) FROM usable)",
    "p3_item_activity": f"""WITH {USABLE} SELECT i AS item_id, count(*) AS rows, count(DISTINCT u) AS users,
        round(count(*) / CAST((SELECT count(*) FROM usable) AS DOUBLE), 12) AS share, min(ts) AS first_timestamp, max(ts) AS last_timestamp
        FROM usable GROUP BY 1""",
}
