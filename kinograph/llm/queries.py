"""Registered queries of the data-processing problems of this package, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.cooccurrence import item_pairs
from kinograph.llm.neighbours import graph_search, most_similar, similar_pairs
from kinograph.llm.packing import pack_documents
from kinograph.llm.reading import fit, reading_levels
from kinograph.llm.sequences import frequent_sequences
from kinograph.llm.tokens import encode_texts, not_restored
from kinograph.llm.truncation import cut_shares, judged_outputs, storage_limits
from kinograph.plans.problems import USABLE, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_sequences(table(spark, sf_dir, "interactions")).select("pattern")


def p1_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_sequences(table(spark, sf_dir, "interactions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_pairs(table(spark, sf_dir, "interactions"), min_lift=2).select("item_a", "item_b")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = item_pairs(table(spark, sf_dir, "interactions"))
    return pairs.withColumns({"lift": F.round("lift", 9), "pmi": F.round("pmi", 9)})


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_similar(table(spark, sf_dir, "feature_vectors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(p6_neighbours(spark, sf_dir))


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search(table(spark, sf_dir, "feature_vectors"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_not_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_restored(table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading_levels(documents, fit(documents, table(spark, sf_dir, "reading_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("level >= 3").select("doc_id")


def p5_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_outputs(table(spark, sf_dir, "scene_outputs"), table(spark, sf_dir, "generation_arms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_judged(spark, sf_dir).where("cut").select("output_id")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_shares(p5_judged(spark, sf_dir))


def p5_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage_limits(table(spark, sf_dir, "scene_outputs").where(r"raw_output RLIKE '\\S'").select("arm", "raw_output"))


QUERIES = {f.__name__: f for f in (p1_found, p1_supports, p4_found, p4_pairs, p5_judged, p5_found, p5_shares, p5_limits, p6_neighbours, p6_found, p6_search, p7_ids, p7_not_restored, p8_containers, p9_levels, p9_found)}

PAIRS = f"""{USABLE}, ui AS (SELECT DISTINCT u, i FROM usable), total AS (SELECT count(DISTINCT u) AS n FROM ui),
margins AS (SELECT i, count(*) AS n FROM ui GROUP BY 1),
pairs AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS users FROM ui a JOIN ui b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 12),
lifts AS (SELECT p.*, a.n AS users_a, b.n AS users_b, total.n AS total FROM pairs p JOIN margins a ON p.item_a = a.i JOIN margins b ON p.item_b = b.i, total)"""

#: Histories without the most frequent items; ``two`` the pairs, ``three`` the triples that follow each other. Patterns of any
#: length are grown from those one item shorter.
SEQUENCES = f"""{USABLE}, heavy AS (SELECT i FROM usable GROUP BY 1 HAVING count(*) > 0.01 * (SELECT count(*) FROM usable)),
h AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY ts, event_id) AS p FROM usable WHERE i NOT IN (SELECT i FROM heavy)),
grown AS (
    SELECT 1 AS k, CAST(i AS VARCHAR) AS pattern, u, min(p) AS p, 0 AS users FROM h GROUP BY i, u
    UNION ALL
    SELECT * FROM (SELECT k, pattern, u, p, count(*) OVER (PARTITION BY pattern) AS users FROM (
        SELECT g.k + 1 AS k, g.pattern || '>' || h.i AS pattern, g.u, min(h.p) AS p FROM grown g JOIN h ON g.u = h.u AND h.p > g.p GROUP BY g.k, g.pattern, h.i, g.u))
    WHERE users >= 12)"""

_MEASURES = {
    "characters": "length(t)",
    "utf8_bytes": "strlen(t)",
    "utf16_units": "length(t) + wide",
    "html_escaped": "length(t) + 4 * (length(t) - length(replace(t, '&', ''))) + 3 * (length(t) - length(replace(replace(t, '<', ''), '>', ''))) + 5 * quotes + 4 * (length(t) - length(replace(t, chr(39), '')))",
    "json_escaped": "length(t) + escaped",
    "json_ascii": r"length(t) + escaped + 5 * length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) + 6 * wide",
    "crlf_lines": "length(t) + lines - (length(t) - length(replace(t, chr(13) || chr(10), ''))) // 2",
}

#: Outputs with text, their lengths in all stored forms, and the lengths at which the different texts of an arm pile up.
LIMITS = rf"""
texts AS (SELECT output_id, arm, raw_output AS t, tokens, coalesce(finish_reason, '') AS reason, coalesce(list_contains(warning, 'TOKEN_LIMIT'), false) AS warned
    FROM scene_outputs WHERE regexp_matches(raw_output, '\S')),
parts AS (SELECT DISTINCT arm, t, length(t) - length(replace(t, '"', '')) AS quotes, length(t) - length(replace(t, chr(10), '')) AS lines,
    len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) AS wide FROM texts),
forms AS (SELECT *, quotes + lines + length(t) - length(replace(t, chr(13), '')) + length(t) - length(replace(t, chr(9), '')) + length(t) - length(replace(t, chr(92), '')) AS escaped FROM parts),
lengths AS ({" UNION ALL ".join(f"SELECT arm, t, '{m}' AS measure, CAST({c} AS BIGINT) AS length FROM forms" for m, c in _MEASURES.items())}),
counts AS (SELECT arm, measure, length, count(*) AS texts FROM lengths GROUP BY 1, 2, 3),
near AS (SELECT a.arm, a.measure, a.length, a.texts, coalesce(sum(b.texts), 0) AS near FROM counts a LEFT JOIN counts b
    ON a.arm = b.arm AND a.measure = b.measure AND a.length <> b.length AND b.length BETWEEN a.length - 10 AND a.length + 10 GROUP BY 1, 2, 3, 4),
limits AS (SELECT arm, measure, length, texts FROM near JOIN (SELECT arm, count(*) AS total FROM parts GROUP BY 1) USING (arm)
    WHERE texts >= 12 AND texts >= 5 * near / 20.0 AND texts >= 0.005 * total)"""

ENDINGS = rf"""{LIMITS},
hits AS (SELECT l.arm, l.t, min(measure) AS measure FROM lengths l JOIN limits USING (arm, measure, length) GROUP BY 1, 2),
bodies AS (SELECT x.*, a.representation = 'graph' AS graph, max_new_tokens AS most, h.measure, regexp_matches(x.t, '^\s*```') AS fenced,
    string_split(replace(regexp_replace(x.t, '^\s*```[^\n]*\n|\n```\s*$|\s+$', '', 'g'), chr(13) || chr(10), chr(10)), chr(10)) AS lines
    FROM texts x LEFT JOIN generation_arms a ON x.arm = a.arm LEFT JOIN hits h ON x.arm = h.arm AND x.t = h.t),
ends AS (SELECT *, lines[-1] AS last, [l FOR l IN lines IF regexp_full_match(l, '(?i)\W*(?:context|entities|actions)\W*')][-1] AS section,
    trim(string_split(lines[-1], '; ')[-1]) AS place, [trim(n) FOR n IN flatten([string_split(string_split(l, ';')[1], ':') FOR l IN lines])] AS names FROM bodies),
complete AS (SELECT *, CASE WHEN graph THEN (NOT fenced OR regexp_matches(t, '\n```\s*$')) AND coalesce(lower(section) LIKE '%actions%', false)
        AND (trim(last) = 'none' OR regexp_matches(last, '^[^;]*?\S - [^;]*?\S - [^;]+; [^;]+; [^;]+$') AND (place IN ('unknown', 'none') OR list_contains(names, place)))
    ELSE regexp_matches(t, '(?s)[.!?…。！？](?:["''”’»」』)\]*`\s]|[\p{{So}}\p{{Sk}}\x{{FE0F}}\x{{200D}}])*$') AND NOT regexp_matches(t, '(?i)\b(?:e\.g|i\.e|cf|vs|approx|fig|mr|mrs|ms|dr)\.\s*$')
        AND NOT (fenced AND NOT regexp_matches(t, '```\s*$')) AND NOT regexp_matches(t, '(?s)\([^()]*$') END AS whole,
    regexp_matches(reason, '(?i)length|max_?tokens|token_?limit') OR warned AS says FROM ends),
judged AS (SELECT output_id, arm, measure, CASE WHEN says OR (coalesce(tokens >= most, false) AND NOT regexp_matches(reason, '(?i)stop|end_?turn|eos')) THEN 'token_limit'
    WHEN measure IS NOT NULL AND (NOT whole OR coalesce(length(regexp_replace(t, '[^\x00-\x7F]+', '', 'g')) > 0.9 * length(t) AND NOT coalesce(tokens >= most, false) AND length(t) < 3.45 * tokens, false)) THEN 'storage_limit'
    WHEN NOT whole THEN 'transfer' END AS cause FROM complete)"""

ORACLE = {
    "p5_limits": f"WITH {LIMITS} SELECT arm, measure, length, texts FROM limits",
    "p5_found": f"WITH {ENDINGS} SELECT output_id FROM judged WHERE cause IS NOT NULL",
    "p5_judged": f"WITH {ENDINGS} SELECT output_id, arm, cause IS NOT NULL AS cut, cause, CASE WHEN cause = 'storage_limit' THEN measure END AS limit_measure FROM judged",
    "p5_shares": f"""WITH {ENDINGS} SELECT arm, count(*) AS outputs, count(cause) AS cut, count(cause) / CAST(count(*) AS DOUBLE) AS share,
        {", ".join(f"count(*) FILTER (cause = '{c}') AS {c}" for c in ("token_limit", "storage_limit", "transfer"))} FROM judged GROUP BY 1""",
    "p1_found": f"WITH RECURSIVE {SEQUENCES} SELECT DISTINCT pattern FROM grown WHERE k > 1",
    "p1_supports": f"WITH RECURSIVE {SEQUENCES} SELECT DISTINCT pattern, users FROM grown WHERE k > 1",
    "p6_found": """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN vec] AS v FROM feature_vectors WHERE len(vec) = 64
            AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN vec]) AND list_bool_or([x <> 0 FOR x IN vec])),
        u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
        c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / a.n / b.n AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c WHERE s >= 0.9)
        SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE r <= 10""",
    "p7_not_restored": "SELECT doc_id FROM documents WHERE false",
    "p4_found": f"WITH {PAIRS} SELECT item_a, item_b FROM lifts WHERE users * total >= 2 * users_a * users_b",
    "p4_pairs": f"""WITH {PAIRS} SELECT item_a, item_b, users, users_a, users_b,
        round(users * CAST(total AS DOUBLE) / users_a / users_b, 9) AS lift, round(log2(users * CAST(total AS DOUBLE) / users_a / users_b), 9) AS pmi FROM lifts""",
}
