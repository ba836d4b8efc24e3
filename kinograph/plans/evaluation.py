"""Registered queries over ranks, comparisons, counts over time, graphs and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions import graphtext
from kinograph.operators import bundle as B
from kinograph.operators import cohort as K
from kinograph.operators import diagnosis as D
from kinograph.operators import ranking as R
from kinograph.operators import throughput as T
from kinograph.operators import vectors as V
from kinograph.operators.indexing import dense_index, first_seen_ids
from kinograph.operators.segments import hash_number
from kinograph.plans.cohorts import RETAINED, retained, stored_retained
from kinograph.plans.graphs import BUNDLE, GRAPHS
from kinograph.plans.media import STORED, latest_scenes
from kinograph.plans.problems import table
from kinograph.session import written

DIMENSIONS, BATCH, DRAWS, SEEDS = 64, 128, 10_000, (42, 43, 44)


def catalog_vectors(spark: SparkSession, sf_dir: str, index: DataFrame) -> DataFrame:
    """``item_idx, vector`` of all retained items: the first usable catalog vector of the item's content, in thousandths, else zeros."""
    usable = table(spark, sf_dir, "feature_vectors").where((F.col("origin") == "catalog_vectors") & V.usable("vec", DIMENSIONS))
    first = usable.groupBy("content_id").agg(F.min_by("vec", "vec_id").alias("vec"))
    items = index.join(table(spark, sf_dir, "item_inventory").select(F.col("item_id").cast("bigint").alias("item"), "content_id"), "item", "left")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(DIMENSIONS))
    return items.join(first, "content_id", "left").select("item_idx", F.coalesce(V.scaled("vec"), zeros).alias("vector"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored_retained(spark, sf_dir)
    index = K.item_index(kept)
    tests = K.history_inputs(kept, index).join(kept.where("back = 1 AND position > 0").select("event_id"), "event_id", "left_semi")
    items = written(catalog_vectors(spark, sf_dir, index), "items")
    return R.masked_ranks(written(R.user_vectors(tests, items, DIMENSIONS), "users"), items, DIMENSIONS)


def catalog_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir)


def hr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _ranks(spark, sf_dir).select(*R.metrics(F.col("rank")))
    return scored.agg(F.count("*").alias("events"), *(F.round(F.avg(F.col(f"`{c}`")), 9).alias(c.replace("@", "_")) for c in scored.columns))


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    kept = stored_retained(spark, sf_dir)
    index = K.item_index(kept)
    train = K.history_inputs(kept, index).join(kept.where("back > 2 AND position > 0").select("event_id"), "event_id", "left_semi")
    rows = dense_index(train.select("event_id", "target", "history"), ["event_id"], "n")
    batch = rows.select("event_id", "target", "history", F.floor(F.col("n") / BATCH).alias("batch_id"), (F.col("n") % BATCH).alias("row"))
    return batch, index, kept


def inbatch_negative_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, _, _ = _batches(spark, sf_dir)
    masked = R.negative_mask(batch)
    return masked.groupBy("batch_id", "row").agg(F.count("*").alias("others"), F.count_if("masked").alias("masked"))


def inbatch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, index, kept = _batches(spark, sf_dir)
    items = catalog_vectors(spark, sf_dir, index)
    log_q = K.popularity(K.leave_one_out(kept)).join(index, "item").select(F.col("item_idx").alias("target"), "log_q")
    return R.history_loss(batch, items, log_q, DIMENSIONS, 1e7).withColumn("loss", F.round("loss", 6))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user, arm, seed, rank, NDCG@10``: made-up runs of the arms over the retained users, from digests."""
    users = retained(spark, sf_dir).where("back = 1").select("user")
    arms = F.array(*map(F.lit, arm_names(spark, sf_dir)))  # eight
    runs = users.select("user", F.explode(arms).alias("arm")).select("user", "arm", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"))
    ranked = runs.withColumn("rank", 1 + hash_number("arm", "seed", "user") % (10 + F.length("arm")))
    return ranked.select("user", "arm", "seed", "rank", F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0).alias("ndcg"))


def arm_names(spark: SparkSession, sf_dir: str) -> list[str]:
    return sorted(r.arm for r in table(spark, sf_dir, "generation_arms").select("arm").collect())


def seed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.seed_summary(run_metrics(spark, sf_dir), "ndcg").select("arm", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = D.seed_summary(run_metrics(spark, sf_dir), "ndcg")
    return D.relative_change(summary, "desc_gemini").withColumn("change", F.round("change", 9))


def user_seed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.user_means(run_metrics(spark, sf_dir), "ndcg").withColumn("value", F.round("value", 9))


def _resampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = D.user_means(run_metrics(spark, sf_dir), "ndcg")
    return values.groupBy("arm").agg(F.avg("value").alias("mean")), D.bootstrap(values, DRAWS)


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resampled(spark, sf_dir)[1].withColumn("mean", F.round("mean", 9))


def pairwise_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed, resampled = _resampled(spark, sf_dir)
    found = D.comparisons(observed, resampled, arm_names(spark, sf_dir))
    return found.select(F.col("left").alias("left_arm"), F.col("right").alias("right_arm"), *(F.round(c, 8).alias(c) for c in ("difference", "low", "high")), "superior", "inferior")


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = run_metrics(spark, sf_dir)
    one, two = (runs.where(F.col("seed") == s).select("user", "arm", "ndcg") for s in SEEDS[:2])
    return D.compare_runs(one, two, ["user", "arm"], "ndcg").withColumn("difference", F.round("difference", 9))


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = table(spark, sf_dir, "generation_arms").select(F.col("arm").alias("run"))
    curves = arms.select("run", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("epoch"))
    score = (hash_number("run", "epoch") % 1000 + 20 * F.col("epoch")) / 1000
    return D.early_stopping(curves.withColumn("score", score), patience=5, min_delta=0.01)


def trailing_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trailing_counts(table(spark, sf_dir, "events"))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tumbling_counts(table(spark, sf_dir, "events"), "1 hour", by=("event_type",)).withColumn("start", F.col("start").cast("string"))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sliding_counts(table(spark, sf_dir, "events"), "3 hours", "1 hour").withColumn("start", F.col("start").cast("string"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = T.session_counts(table(spark, sf_dir, "events"), "6 hours", "user_id")
    return sessions.withColumn("start", F.col("start").cast("timestamp").cast("bigint"))


def vocabulary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = first_seen_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"], "text_id")
    return ids.select(F.md5("text").alias("text_md5"), "text_id")


def parsed_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = latest_scenes(spark, sf_dir).where("representation = 'graph' AND error IS NULL AND raw_output IS NOT NULL")
    uncut = graphs.where(~F.coalesce(F.col("finish_reason").rlike(r"(?i)length|max_?tokens"), F.lit(False)))
    return graphtext.with_graphs(uncut.select("content_id", "scene_idx", "output_id", "raw_output"), F.col("raw_output")).drop("raw_output")


def graph_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (F.size("graph.entities").alias("entities"), F.size("graph.actions").alias("actions"))
    return parsed_graphs(spark, sf_dir).select("output_id", "mode", F.col("parse_error").isNotNull().alias("failed"), *counts)


def native_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs without repair, with what SQL can count in their text."""
    native = parsed_graphs(spark, sf_dir).where("mode = 'native'")
    return native.select("output_id", F.size("graph.entities").alias("entities"), F.size("graph.actions").alias("actions"), "graph.medium", F.array_join("graph.topics", "; ").alias("topics"))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_graphs(spark, sf_dir).where("graph IS NOT NULL").select("content_id", "scene_idx", "graph")


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_graphs(spark, sf_dir).where("mode = 'native'").select("content_id", "scene_idx", "graph")


def native_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts of the graphs without repair."""
    return B.contexts(_native(spark, sf_dir))


def native_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node texts of the graphs without repair; those of an entity with its number in the text."""
    nodes = B.nodes(_native(spark, sf_dir))
    return nodes.select("content_id", "scene_idx", "kind", "key", "text")


def native_role_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role states of the graphs without repair, with the key of the linked entity."""
    native = _native(spark, sf_dir)
    nodes = B.nodes(native).select("content_id", "scene_idx", "node", "key")
    linked = B.role_states(native).join(nodes.withColumnRenamed("node", "action_node").withColumnRenamed("key", "action"), ["content_id", "scene_idx", "action_node"])
    named = linked.join(nodes.withColumnRenamed("node", "entity_node").withColumnRenamed("key", "entity"), ["content_id", "scene_idx", "entity_node"], "left")
    return named.select("content_id", "scene_idx", "action", "role", "state", "entity")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nodes(_admitted(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.edges(_admitted(spark, sf_dir))


def graph_role_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.role_states(_admitted(spark, sf_dir))


def graph_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.contexts(_admitted(spark, sf_dir))


def graph_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.vocabulary(_admitted(spark, sf_dir))


def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.content_statistics(_admitted(spark, sf_dir))


def scene_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = table(spark, sf_dir, "scene_outputs").select("content_id", "scene_idx").distinct()
    return B.scene_offsets(scenes)


def _scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_vectors").where(V.usable("vec", DIMENSIONS))
    return rows.select("vec_id", "content_id", V.scaled("vec").alias("vector"))


def group_vector_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled_vectors(spark, sf_dir).where("content_id IS NOT NULL")
    groups = table(spark, sf_dir, "item_inventory").select("content_id")
    means = V.group_mean(rows, groups, ["content_id"], DIMENSIONS)
    return means.select("content_id", "size", F.round(F.col("mean")[0], 6).alias("first"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), 4).alias("square"))


def hyperedge_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scaled_vectors(spark, sf_dir)
    members = rows.select(F.explode(F.array(F.col("vec_id") % 97, 100 + F.col("vec_id") % 101)).alias("segment"), F.col("vec_id").alias("scene"))
    _, received = V.hyperedge_messages(members, rows.select(F.col("vec_id").alias("scene"), "vector"), DIMENSIONS)
    return received.select("scene", "degree", F.round(F.col("received")[0], 6).alias("first"), F.round(F.aggregate("received", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        catalog_rank, hr_ndcg, inbatch_negative_mask, inbatch_loss, seed_mean_sd, relative_change, user_seed_means, bootstrap_means, pairwise_comparisons,
        run_comparison, early_stopping, trailing_throughput, tumbling_counts, sliding_counts, session_windows, vocabulary_ids, graph_text_parse, native_graphs,
        native_contexts, native_nodes, native_role_states, graph_nodes, graph_edges, graph_role_states, graph_contexts, graph_vocabulary, graph_statistics, scene_offsets, group_vector_mean, hyperedge_messages,
    )
}

USABLE_VECTOR = "len(vec) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN vec]) AND list_bool_or([x <> 0 FOR x IN vec])"

VECTORS = f"""{RETAINED},
firsts AS (SELECT content_id, arg_min(vec, vec_id) AS vec FROM feature_vectors WHERE origin = 'catalog_vectors' AND {USABLE_VECTOR} GROUP BY 1),
items AS (SELECT item_idx, coalesce([round(CAST(x AS DOUBLE) * 1000) FOR x IN vec], list_resize(CAST([] AS DOUBLE[]), 64, 0.0)) AS v FROM indexed LEFT JOIN item_inventory ON CAST(item_id AS BIGINT) = item LEFT JOIN firsts USING (content_id)),
inputs AS (SELECT event_id, back, position, item_idx AS target, coalesce(list(item_idx) OVER (PARTITION BY "user" ORDER BY position ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS history
    FROM kept JOIN indexed USING (item)),
parts AS (SELECT event_id, d, sum(v[d]) AS x FROM (SELECT event_id, unnest(history) AS item_idx FROM inputs) JOIN items USING (item_idx), range(1, 65) t(d) GROUP BY 1, 2),
users AS (SELECT event_id, list(x ORDER BY d) AS u FROM parts GROUP BY 1)"""

RANKS = f"""{VECTORS},
tests AS (SELECT i.event_id, i.target, i.history, u, list_dot_product(u, v) AS s, list_contains(history, target) AS masked
    FROM inputs i JOIN users USING (event_id) JOIN items t ON t.item_idx = i.target WHERE back = 1 AND position > 0),
ranks AS (SELECT event_id, target, 1 + count(*) FILTER (o > m OR (o = m AND item_idx < target)) AS rank FROM (
    SELECT event_id, target, item_idx, CASE WHEN masked THEN -CAST('inf' AS DOUBLE) ELSE s END AS m,
        CASE WHEN list_contains(history, item_idx) THEN -CAST('inf' AS DOUBLE) ELSE list_dot_product(u, v) END AS o FROM tests, items) GROUP BY 1, 2)"""

BATCHES = """
numbered AS (SELECT event_id, target, history, row_number() OVER (ORDER BY event_id) - 1 AS n FROM inputs WHERE back > 2 AND position > 0),
batch AS (SELECT *, n // 128 AS batch_id, n % 128 AS row FROM numbered)"""

RUNS = f"""{RETAINED},
runs AS (SELECT "user", arm, seed, 1 + CAST('0x' || substr(md5(concat_ws('|', arm, seed, "user")), 1, 8) AS BIGINT) % (10 + length(arm)) AS rank
    FROM kept, generation_arms, (VALUES (42), (43), (44)) s(seed) WHERE back = 1),
metrics AS (SELECT *, CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END AS ndcg FROM runs)"""

_MIX = f"(xor(x, x >> 16) * {D.MIXER}) & 4294967295"
_WEIGHT = "CASE " + " ".join(f"WHEN x < {limit} THEN {k}" for k, limit in enumerate(D.POISSON)) + f" ELSE {len(D.POISSON)} END"

RESAMPLED = f"""{RUNS},
means AS (SELECT "user", arm, avg(ndcg) AS value FROM metrics GROUP BY 1, 2),
hashed AS (SELECT "user", draw, (CAST('0x' || substr(md5(concat_ws('|', 42, "user")), 1, 8) AS BIGINT) + draw * {D.STRIDE}) & 4294967295 AS x FROM (SELECT DISTINCT "user" FROM means), range(0, {DRAWS}) t(draw)),
once AS (SELECT "user", draw, {_MIX} AS x FROM hashed), twice AS (SELECT "user", draw, {_MIX} AS x FROM once), mixed AS (SELECT "user", draw, xor(x, x >> 16) AS x FROM twice),
drawn AS (SELECT "user", draw, {_WEIGHT} AS w FROM mixed),
resampled AS (SELECT draw, arm, sum(w * value) / sum(w) AS mean FROM means JOIN drawn USING ("user") GROUP BY 1, 2)"""

UNCUT = r"""
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY content_id, scene_idx ORDER BY output_id DESC) AS r FROM scene_outputs o JOIN generation_arms a USING (arm) WHERE a.representation = 'graph'),
uncut AS (SELECT * FROM ranked WHERE r = 1 AND error IS NULL AND raw_output IS NOT NULL AND NOT regexp_matches(coalesce(finish_reason, ''), '(?i)length|max_?tokens'))"""

#: Texts that a strict reader accepts, by one pattern: names and actions without marks inside.
NATIVE = rf"""{UNCUT},
ended AS (SELECT output_id, content_id, scene_idx, rtrim(raw_output, chr(32) || chr(10)) AS raw_output FROM uncut),
sections AS (SELECT output_id, content_id, scene_idx, regexp_extract(raw_output, 'format: ([^\n]+)', 1) AS format, regexp_extract(raw_output, '(?s)\[Entities\]\n(.*)\n\[Actions\]', 1) AS e, regexp_extract(raw_output, '(?s)\[Actions\]\n(.*)$', 1) AS a,
    regexp_extract(raw_output, 'medium: ([^\n]+)', 1) AS medium, regexp_extract(raw_output, 'topics: ([^\n]+)', 1) AS topics, raw_output FROM ended),
rows AS (SELECT *, string_split(e, chr(10)) AS es, CASE WHEN a = 'none' THEN [] ELSE string_split(a, chr(10)) END AS acts FROM sections),
strict AS (SELECT *, [string_split(x, '; ')[1] FOR x IN es] AS names FROM rows
    WHERE regexp_full_match(raw_output, '\[Context\]\nmedium: [^\n]+\nformat: [^\n]+\ntopics: [^\n]+\n\[Entities\]\n(?:[^\n;:\[]+(?:; [^\n;:]+)*\n)+\[Actions\]\n(?:none|[^\n;]+ - [^\n;]+ - [^\n;]+(?:; [^\n;]+; [^\n;]+)?(?:\n[^\n;]+ - [^\n;]+ - [^\n;]+(?:; [^\n;]+; [^\n;]+)?)*)')),
refs AS (SELECT *, list_bool_and([x IN ('none', 'unknown') OR list_contains(names, x) FOR x IN flatten([[string_split(l, ' - ')[1], string_split(string_split(l, ' - ')[3], '; ')[1], string_split(l, '; ')[2], string_split(l, '; ')[3]] FOR l IN acts]) IF x IS NOT NULL]) AS declared FROM strict),
native AS (SELECT * FROM refs WHERE coalesce(declared, true)),
steps AS (SELECT content_id, scene_idx, names, k - 1 AS k, string_split(acts[k], '; ') AS p FROM (SELECT *, unnest(range(1, len(acts) + 1)) AS k FROM native)),
bodies AS (SELECT *, string_split(p[1], ' - ') AS b FROM steps),
roles AS (SELECT content_id, scene_idx, names, k, unnest([b[1], b[3], coalesce(p[2], 'none'), 'none', coalesce(p[3], 'unknown')]) AS value, unnest([0, 1, 2, 3, 4]) AS role FROM bodies)"""

#: The uncut graphs of the latest scenes.
_CHOSEN = rf"""WITH {GRAPHS}, {STORED}, chosen AS (SELECT output_id, content_id, scene_idx FROM latest WHERE representation = 'graph' AND error IS NULL
    AND raw_output IS NOT NULL AND NOT coalesce(regexp_matches(finish_reason, '(?i)length|max_?tokens'), false))"""
_BUNDLE = f"{_CHOSEN}, {BUNDLE}"

ORACLE = {
    "catalog_rank": f"WITH {RANKS} SELECT * FROM ranks",
    "hr_ndcg": f"""WITH {RANKS} SELECT count(*) AS events, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 9) AS HR_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0 END), 9) AS NDCG_{k}" for k in R.CUTOFFS)} FROM ranks""",
    "inbatch_negative_mask": f"""WITH {VECTORS}, {BATCHES} SELECT a.batch_id, a.row, count(*) AS others, count(*) FILTER (list_contains(a.history, b.target) OR a.target = b.target) AS masked
        FROM batch a JOIN batch b ON a.batch_id = b.batch_id AND a.row <> b.row GROUP BY 1, 2""",
    "inbatch_loss": f"""WITH {VECTORS}, {BATCHES}, c AS (SELECT item_idx AS target, count(*) AS n FROM split JOIN indexed USING (item) WHERE phase = 'train' AND position > 0 GROUP BY 1),
        q AS (SELECT target, ln(n / CAST((SELECT sum(n) FROM c) AS DOUBLE)) AS log_q FROM c),
        f AS (SELECT b.*, u, v, log_q FROM batch b JOIN users USING (event_id) JOIN items i ON i.item_idx = b.target JOIN q USING (target)),
        l AS (SELECT a.batch_id, a.row, a.row = b.row AS own, CASE WHEN a.row <> b.row AND (list_contains(a.history, b.target) OR a.target = b.target) THEN -10000.0 ELSE list_dot_product(a.u, b.v) / 1e7 - b.log_q END AS x
            FROM f a JOIN f b ON a.batch_id = b.batch_id),
        t AS (SELECT batch_id, row, max(x) AS top, max(x) FILTER (own) AS mine FROM l GROUP BY 1, 2),
        s AS (SELECT batch_id, row, ln(sum(exp(x - top))) + any_value(top) - any_value(mine) AS e FROM l JOIN t USING (batch_id, row) GROUP BY 1, 2)
        SELECT batch_id, round(avg(e), 6) AS loss FROM s GROUP BY 1""",
    "seed_mean_sd": f"WITH {RUNS}, s AS (SELECT arm, seed, avg(ndcg) AS m FROM metrics GROUP BY 1, 2) SELECT arm, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS sd FROM s GROUP BY 1",
    "relative_change": f"""WITH {RUNS}, s AS (SELECT arm, seed, avg(ndcg) AS m FROM metrics GROUP BY 1, 2), a AS (SELECT arm, avg(m) AS m FROM s GROUP BY 1)
        SELECT a.arm, round(a.m / b.m - 1, 9) AS change FROM a, a b WHERE b.arm = 'desc_gemini'""",
    "user_seed_means": f"""WITH {RUNS} SELECT "user", arm, round(avg(ndcg), 9) AS value FROM metrics GROUP BY 1, 2""",
    "bootstrap_means": f"WITH {RESAMPLED} SELECT CAST(draw AS INTEGER) AS draw, arm, round(mean, 9) AS mean FROM resampled",
    "pairwise_comparisons": f"""WITH {RESAMPLED}, o AS (SELECT arm, avg(value) AS m FROM means GROUP BY 1),
        d AS (SELECT l.arm AS left_arm, r.arm AS right_arm, l.mean - r.mean AS d FROM resampled l JOIN resampled r ON l.draw = r.draw AND l.arm > r.arm),
        c AS (SELECT left_arm, right_arm, quantile_cont(d, {0.05 / 28 / 2!r}) AS low, quantile_cont(d, {1 - 0.05 / 28 / 2!r}) AS high FROM d GROUP BY 1, 2)
        SELECT left_arm, right_arm, round(a.m - b.m, 8) AS difference, round(low, 8) AS low, round(high, 8) AS high, low > 0 AS superior, high < 0 AS inferior
        FROM c JOIN o a ON a.arm = left_arm JOIN o b ON b.arm = right_arm""",
    "run_comparison": f"""WITH {RUNS} SELECT a.arm, count(*) AS events, round(avg(b.ndcg - a.ndcg), 9) AS difference FROM metrics a JOIN metrics b ON a."user" = b."user" AND a.arm = b.arm AND a.seed = 42 AND b.seed = 43 GROUP BY 1""",
    "trailing_throughput": """WITH s AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS events FROM events WHERE ts IS NOT NULL GROUP BY 1)
        SELECT second, events, CAST(sum(events) OVER (ORDER BY second RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing FROM s""",
    "tumbling_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "sliding_counts": """SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM events, range(0, 3) t(k) GROUP BY 1""",
    "session_windows": """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM l)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS events FROM s GROUP BY user_id, n""",
    "vocabulary_ids": r"""WITH t AS (SELECT coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') AS text, min(doc_id) AS p FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, '') GROUP BY 1)
        SELECT md5(text) AS text_md5, CASE WHEN text = '' THEN 0 ELSE row_number() OVER (ORDER BY text = '', p, text) END AS text_id FROM t""",
    "graph_text_parse": rf"""{_CHOSEN}, n AS (SELECT output_id, CAST(count(*) AS INTEGER) AS n FROM ents GROUP BY 1)
        SELECT output_id, CASE WHEN native THEN 'native' WHEN ok THEN 'repaired' END AS mode, NOT ok AS failed, CASE WHEN ok THEN coalesce(n, 0) END AS entities,
            CASE WHEN ok THEN CAST(len(cells_a) AS INTEGER) END AS actions FROM chosen JOIN graphs USING (output_id) LEFT JOIN n USING (output_id)""",
    "graph_nodes": f"{_BUNDLE} SELECT content_id, scene_idx, node, kind, key, text FROM nodes",
    "graph_role_states": f"{_BUNDLE} SELECT content_id, scene_idx, action_node, role, state, entity_node FROM states",
    "graph_edges": f"""{_BUNDLE} SELECT content_id, scene_idx, entity_node AS src, action_node AS dst, role FROM states WHERE state = -1
        UNION ALL SELECT content_id, scene_idx, action_node, entity_node, role + 5 FROM states WHERE state = -1""",
    "graph_contexts": f"{_BUNDLE} SELECT content_id, scene_idx, text FROM contexts",
    "graph_vocabulary": f"""{_BUNDLE}, t AS (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, min((content_id, scene_idx, node)) AS place
            FROM (SELECT content_id, scene_idx, node, text FROM nodes UNION ALL SELECT content_id, scene_idx, 2147483647, text FROM contexts) GROUP BY 1)
        SELECT text, row_number() OVER (ORDER BY place, text) AS text_id FROM t WHERE text <> '' UNION ALL SELECT '', 0""",
    "graph_statistics": f"""{_BUNDLE}, s AS (SELECT content_id, output_id, len(cells_a) AS actions FROM chosen JOIN graphs USING (output_id) WHERE ok)
        SELECT content_id, count(*) AS scenes, count(*) FILTER (actions = 0) AS actionless, CAST(sum((SELECT count(*) FROM ents e WHERE e.output_id = s.output_id)) AS BIGINT) AS entities,
            CAST(sum(actions) AS BIGINT) AS actions FROM s GROUP BY 1""",
    "native_graphs": rf"""WITH {NATIVE} SELECT output_id, len(es) AS entities, len(acts) AS actions, medium, CASE WHEN topics = 'none' THEN '' ELSE topics END AS topics FROM refs WHERE coalesce(declared, true)""",
    "native_contexts": rf"""WITH {NATIVE} SELECT content_id, scene_idx, 'Format: ' || format || chr(10) || 'Medium: ' || medium || chr(10) || 'Topics: ' ||
        CASE WHEN topics = 'none' THEN '' ELSE array_to_string(list_sort(string_split(topics, '; ')), ', ') END AS text FROM native""",
    "native_nodes": rf"""WITH {NATIVE}, e AS (SELECT content_id, scene_idx, k, string_split(es[k], '; ') AS p FROM (SELECT *, unnest(range(1, len(es) + 1)) AS k FROM native))
        SELECT content_id, scene_idx, 0 AS kind, 'e' || k AS key, trim('Name: ' || p[1] || chr(10) || 'Attributes: ' || array_to_string(list_sort(p[2:]), ', ')) AS text FROM e
        UNION ALL SELECT content_id, scene_idx, 1, 'action_' || k, b[2] FROM bodies""",
    "native_role_states": rf"""WITH {NATIVE} SELECT content_id, scene_idx, 'action_' || k AS action, role, CASE WHEN value = 'unknown' THEN 1 WHEN value = 'none' THEN 0 ELSE -1 END AS state,
        CASE WHEN value NOT IN ('none', 'unknown') THEN 'e' || (len(names) + 1 - list_position(list_reverse(names), value)) END AS entity FROM roles""",
    "early_stopping": """WITH RECURSIVE curve AS (SELECT arm AS run, e AS epoch, (CAST('0x' || substr(md5(concat_ws('|', arm, e)), 1, 8) AS BIGINT) % 1000 + 20 * e) / 1000.0::DOUBLE AS score
            FROM generation_arms, range(1, 51) t(e)),
        s AS (SELECT run, 1 AS epoch, 1 AS best, score AS top, 1 AS moved, score AS level, false AS stop FROM curve WHERE epoch = 1
            UNION ALL SELECT s.run, s.epoch + 1, CASE WHEN c.score > top THEN c.epoch ELSE best END, greatest(c.score, top), CASE WHEN c.score > level + 0.01::DOUBLE THEN c.epoch ELSE moved END,
                CASE WHEN c.score > level + 0.01::DOUBLE THEN c.score ELSE level END, c.epoch - CASE WHEN c.score > level + 0.01::DOUBLE THEN c.epoch ELSE moved END >= 5
            FROM s JOIN curve c ON s.run = c.run AND c.epoch = s.epoch + 1 WHERE NOT stop)
        SELECT run, CAST(arg_max(best, epoch) AS INTEGER) AS best_epoch, arg_max(top, epoch) AS best_score, CAST(max(epoch) AS INTEGER) AS stop_epoch FROM s GROUP BY 1""",
    "scene_offsets": "WITH s AS (SELECT DISTINCT content_id, scene_idx FROM scene_outputs), n AS (SELECT *, row_number() OVER (ORDER BY content_id, scene_idx) - 1 AS r FROM s) SELECT content_id, min(r) AS first_scene, count(*) AS scenes FROM n GROUP BY 1",
    "group_vector_mean": f"""WITH v AS (SELECT content_id, [round(CAST(x AS DOUBLE) * 1000) FOR x IN vec] AS v FROM feature_vectors WHERE content_id IS NOT NULL AND {USABLE_VECTOR}),
        p AS (SELECT content_id, d, avg(v[d]) AS m, count(*) AS n FROM v, range(1, 65) t(d) GROUP BY 1, 2),
        g AS (SELECT content_id, max(n) AS size, list(m ORDER BY d) AS m FROM p GROUP BY 1)
        SELECT i.content_id, coalesce(size, 0) AS size, coalesce(round(m[1], 6), 0.0) AS first, coalesce(round(list_dot_product(m, m), 4), 0.0) AS square FROM item_inventory i LEFT JOIN g ON i.content_id = g.content_id""",
    "hyperedge_messages": f"""WITH v AS (SELECT vec_id, [round(CAST(x AS DOUBLE) * 1000) FOR x IN vec] AS v FROM feature_vectors WHERE {USABLE_VECTOR}),
        m AS (SELECT vec_id, v, unnest([vec_id % 97, 100 + vec_id % 101]) AS segment FROM v),
        e AS (SELECT segment, d, avg(v[d]) AS x FROM m, range(1, 65) t(d) GROUP BY 1, 2),
        r AS (SELECT vec_id, d, avg(x) AS x, count(*) AS n FROM m JOIN e USING (segment) GROUP BY 1, 2)
        SELECT vec_id AS scene, max(n) AS degree, round(max(x) FILTER (d = 1), 6) AS first, round(sum(x), 4) AS total FROM r GROUP BY 1""",
}
