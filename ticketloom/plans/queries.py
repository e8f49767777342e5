"""The query catalogue: each query applies operators to whole driver tables; ORACLE_SQL says the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.functions import intents, labels, text, vectors
from ticketloom.operators import incremental, kmeans, prepare, reports
from ticketloom.operators.embed import HashedNgrams, embed_tasks
from ticketloom.plans import config, pipeline
from ticketloom.session import work_dir
from ticketloom.streaming import sessions, updates

START = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as tickets: the first line is the summary."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_micros(F.unix_micros(F.expr(START)) + F.col("doc_id") * 60_000_000)
    return d.select(
        F.concat(F.lit("DOC-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("issue_id"), F.substring_index("text", "\n", 1).alias("summary"), F.col("text").alias("description"),
        at.alias("created_at"), at.alias("updated_at"), F.col("source").alias("cluster_label"), F.col("doc_id").alias("ord"),
    )


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later delivery of the same tickets with edits, other times and new ids."""
    t, n = tasks(spark, sf_dir), F.col("ord")
    new_id = F.concat(F.lit("DOC-"), F.lpad((n + 1_000_000).cast("string"), 8, "0"))
    edit = (n % 5 == 0) | (n % 17 == 0)
    shift = F.when(n % 7 == 0, 2_000_000).otherwise(0) + F.when(n % 11 == 0, 500_000).otherwise(0) - F.when(n % 17 == 0, 86_400_000_000).otherwise(0)
    return t.withColumns({
        "issue_id": F.when(n % 13 == 0, new_id).otherwise(F.col("issue_id")),
        "description": F.when(edit, F.concat("description", F.lit(" edited"))).otherwise(F.col("description")),
        "updated_at": F.timestamp_micros(F.unix_micros("updated_at") + shift),
    })


def vector_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as clustered tickets."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("V"), "vec_id").alias("issue_id"), F.concat(F.lit("vector "), "vec_id").alias("summary"), F.col("vec_id").alias("ord"), "embedding", F.col("label").alias("cluster_id"))


def _with_centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = vector_tasks(spark, sf_dir)
    c = kmeans.centroid_table(t)
    x = t.join(c.select(F.col("cluster_id").alias("_c"), "centroid"), F.col("cluster_id") == F.col("_c")).drop("_c")
    return x.withColumn("cluster_confidence", vectors.kmeans_confidence(F.col("embedding"), F.col("centroid"))), c


def _flat(report: DataFrame) -> DataFrame:
    return report.select("cluster_id", "size", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("centroid_distance", 6).alias("centroid_distance"), "is_noise", F.array_join(F.transform("sample_tasks", lambda s: s["issue_id"]), ",").alias("samples"))


def q01_clean_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_description(F.col("text")).alias("cleaned"))


def q02_clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_description(F.col("html"), 500).alias("cleaned"))


def q03_feature_text(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return t.select("issue_id", text.feature_text(F.col("summary"), text.clean_description(F.col("description"))).alias("feature_text"))


def q04_content_fingerprint(spark, sf_dir):
    return prepare.with_fingerprint(tasks(spark, sf_dir)).select("issue_id", "fingerprint")


def q05_keep_last_by_key(spark, sf_dir):
    both = tasks(spark, sf_dir).withColumn("v", F.lit(0)).unionByName(changed(spark, sf_dir).withColumn("v", F.lit(1)))
    return prepare.keep_last(both, "issue_id", "v", "ord").select("issue_id", "v", F.length("description").alias("n"))


def q06_categorize_updates(spark, sf_dir):
    x = incremental.categorize(changed(spark, sf_dir), tasks(spark, sf_dir))
    return x.select("new.issue_id", "category")


def q07_update_statistics(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return incremental.statistics(incremental.categorize(changed(spark, sf_dir), t), t)


def _clustered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("label").alias("cluster_id"))
    t = tasks(spark, sf_dir).join(e, F.col("ord") == F.col("_v"), "left").drop("_v")
    return t.withColumns({"cluster_confidence": F.when(F.col("cluster_id").isNotNull(), 0.5), "cleaned_description": text.clean_description(F.col("description"))})


def q08_merge_updates(spark, sf_dir):
    new = changed(spark, sf_dir).withColumns({"cluster_id": F.lit(None).cast("int"), "cluster_confidence": F.lit(None).cast("double"), "cleaned_description": text.clean_description(F.col("description"))})
    return incremental.delta(new, _clustered(spark, sf_dir)).select("issue_id", "category", "cluster_id", "cluster_confidence")


def q09_jaccard_pairs(spark, sf_dir):
    """Each benchmark item with the one that follows it."""
    b = table(spark, sf_dir, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(nxt, "item_id").select("item_id", F.round(text.character_jaccard(F.col("text"), F.col("other")), 6).alias("similarity"))


PART_LABELS = {
    "metal": {"keywords": ["STEEL", "copper", "brass", "tin", "nickel"], "description": "metal parts"},
    "finish": {"keywords": ["polished", "plated", "brushed", "burnished", "anodized"], "description": "surface work"},
    "size": {"keywords": ["small", "medium", "large", "economy"], "description": "by size"},
}


def q10_keyword_label(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = labels.labelling_text(F.col("p_name"), F.col("p_type"))
    return p.select("p_partkey", F.coalesce(labels.keyword_label(t, PART_LABELS), F.lit("unclassified")).alias("label"), F.array_join(labels.matching_labels(t, PART_LABELS), ",").alias("all_labels"))


MESSAGES = (
    (1, "Please load the data"), (2, "run a cluster analysis now"), (3, "show me the results"), (4, "change the parameters: min size 12"), (5, "HELP"), (6, "epsilon 0.35 please"),
    (7, "导入这批数据"), (8, "聚类分析"), (9, "导出全部结果"), (10, "最小聚类大小设为15"), (11, "怎么用"), (12, "nothing of the kind"), (13, "load data and show results"), (14, "minimum cluster size is 7, epsilon=1"),
)


def _messages(spark):
    return spark.createDataFrame(list(MESSAGES), "id int, message string")


def q11_intent(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("id"), F.col("text").alias("message"))
    x = _messages(spark).select(F.col("id").cast("long").alias("id"), "message").unionByName(turns)
    return x.select("id", intents.intent(F.col("message")).alias("intent"), intents.intent(F.col("message"), intents.DEMO_INTENTS).alias("demo_intent"))


def q12_parameter_extract(spark, sf_dir):
    m = F.col("message")
    return _messages(spark).select("id", intents.parameter(m, "min_size", 10).alias("min_size"), intents.parameter(m, "epsilon").alias("epsilon"))


def q13_cluster_report(spark, sf_dir):
    x, c = _with_centroids(spark, sf_dir)
    return _flat(reports.cluster_report(x, "ord", centroids=c))


def q14_point_confidence(spark, sf_dir):
    x, _ = _with_centroids(spark, sf_dir)
    return x.select(F.col("ord").alias("vec_id"), F.round(vectors.euclidean(F.col("embedding"), F.col("centroid")), 6).alias("distance"), F.round("cluster_confidence", 6).alias("confidence"))


def q15_cosine_topk(spark, sf_dir):
    """The queries are the vectors whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return pipeline.top_k_in_passes(e.where(F.col("vec_id") % 20 == 0), e, 5).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


def q16_nearest_centroid(spark, sf_dir):
    t = vector_tasks(spark, sf_dir)
    c = kmeans.centroid_table(t).orderBy("cluster_id").collect()  # a row for each label
    got = kmeans.assign(t.drop("cluster_id"), [r.centroid for r in c])
    return got.select(F.col("ord").alias("vec_id"), F.get(F.array(*[F.lit(r.cluster_id) for r in c]), F.col("cluster_id")).alias("nearest"))


def q17_silhouette(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("l"), F.col("embedding").cast("array<double>").alias("v"))
    return kmeans.silhouette_rows(e).groupBy(F.col("l").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def q18_noise_report(spark, sf_dir):
    t = vector_tasks(spark, sf_dir).withColumn("_l", F.when(F.col("cluster_id") >= 8, -1).otherwise(F.col("cluster_id"))).withColumn("_p", F.lit(0.5))
    return _flat(reports.cluster_report(reports.assignments(t, "_l", "_p"), "ord"))


def q19_top_clusters(spark, sf_dir):
    x, _ = _with_centroids(spark, sf_dir)
    return reports.top_clusters(reports.cluster_report(x, "ord")).select("cluster_id", "size", F.format_string("%.2f", "avg_confidence").alias("confidence"))


def q20_export_rows(spark, sf_dir):
    t = vector_tasks(spark, sf_dir).withColumn("_l", F.when(F.col("cluster_id") >= 8, -1).otherwise(F.col("cluster_id"))).withColumn("_p", F.lit(0.5))
    return reports.export_rows(reports.cluster_report(reports.assignments(t, "_l", "_p"), "ord"))


def q21_optimal_k(spark, sf_dir):
    """k from 2 to 20, ten starts each."""
    k = kmeans.optimal_k(table(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(k,)], "k int")


def q22_hdbscan(spark, sf_dir):
    t = vector_tasks(spark, sf_dir).drop("cluster_id")
    r = pipeline.cluster_tasks(t, config.ClusteringParameters(min_cluster_size=5, cluster_selection_epsilon=0.3), order="ord")
    return r.report.select("cluster_id", "size", "avg_confidence", "is_noise")


def q23_session_rollup(spark, sf_dir):
    return sessions.session_rollup(table(spark, sf_dir, "conversations"))


def q24_batch_size(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("a"))
    return d.select("source", F.round("a", 6).alias("average_length"), config.batch_size_column(F.col("a")).alias("batch_size"), config.batch_size_column(F.col("a"), 1024.0, 256).alias("large_model_batch"))


def q25_suggest_params(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", "lang", "n", *[c.alias(k) for k, c in config.suggested(F.col("n")).items()])


def q26_upsert_stream(spark, sf_dir):
    """events as a stream; the last event of each user."""
    schema = table(spark, sf_dir, "events").schema
    root = fresh_folder(spark, "stream")
    store = updates.SnapshotStore(spark, f"{root}/state", schema, key="user_id")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    updates.start_last_by_key(stream, store, "event_id", f"{root}/checkpoint").awaitTermination()
    return store.read().select("user_id", "event_id", "event_type")


def q27_required_filter(spark, sf_dir):
    """documents as raw text cells, some of them missing."""
    n = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        F.when(n % 10 == 3, F.lit("NA")).otherwise(n.cast("string")).alias("issue_id"), F.when(n % 7 == 2, None).otherwise(F.concat(F.lit("  "), F.substring_index("text", "\n", 1), F.lit(" "))).alias("summary"),
        F.when(n % 4 == 1, F.lit("null")).otherwise(F.col("text")).alias("description"), F.when(n % 9 == 5, F.lit("no date")).otherwise(F.lit("2024-03-01T10:00:00Z")).alias("created_at"),
        F.when(n % 6 == 0, None).otherwise(F.lit("2024-03-02 11:30:00.250")).alias("updated_at"), F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "source")).alias("cluster_label"), F.lit("open").alias("status"),
    )
    x = prepare.decode_tasks(prepare.missing_to_null(raw), F.expr(START))
    return x.select("issue_id", "summary", F.length("description").alias("n"), F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "cluster_label")


def q28_review_decisions(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    pick = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accept").when(F.col("toxic") == 1, "keep").otherwise("hybrid")
    d = lab.select(F.concat(F.lit("DOC-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("issue_id"), pick.alias("decision"), F.lit("by hand").alias("reviewer_label"))
    return pipeline.review(tasks(spark, sf_dir).withColumn("proposed_label", F.upper("cluster_label")), d).select("issue_id", "decision", "final_label")


def q29_recent_half_year(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return pipeline.recent(o, F.expr("DATE '1998-08-01'"), 6, "o_orderdate").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def q30_window_counts(spark, sf_dir):
    x = updates.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", late="10 minutes", by=("event_type",))
    return x.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n")


def q31_inverted_index(spark, sf_dir):
    return labels.inverted_index(labels.dictionary_table(spark, labels.load_dictionary())).select("keyword", F.array_join("labels", ",").alias("labels"))


def q32_all_labels(spark, sf_dir):
    return labels.all_labels(labels.dictionary_table(spark, PART_LABELS)).select("label", "label_ord", "description")


def q33_contains_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return labels.label_join(p.withColumn("t", labels.labelling_text(F.col("p_name"), F.col("p_type"))), labels.dictionary_table(spark, PART_LABELS), "t", "p_partkey").select("p_partkey", "label")


def q34_first_seen(spark, sf_dir):
    x = prepare.first_seen(tasks(spark, sf_dir).withColumn("v", F.lit(0)), changed(spark, sf_dir).withColumn("v", F.lit(1)), "issue_id")
    return x.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("issue_id").alias("ids"))


def q35_snapshot(spark, sf_dir):
    t = tasks(spark, sf_dir)
    new = changed(spark, sf_dir)
    none = {"cluster_id": F.lit(None).cast("int"), "cluster_confidence": F.lit(None).cast("double")}
    clean = {"cleaned_description": text.clean_description(F.col("description"))}
    t, new = t.withColumns(none | clean), new.withColumns(none | clean)
    return incremental.upsert(t, incremental.delta(new, t), "ord").select("issue_id", F.length("description").alias("n"), F.unix_micros("updated_at").alias("updated"))


def q36_demo_distribution(spark, sf_dir):
    from ticketloom.plans.cli import demo_distribution

    return demo_distribution(tasks(spark, sf_dir)).select(F.col("demo_cluster").cast("int").alias("demo_cluster"), "n", "first_summary")


def q37_vector_functions(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("dims"), F.round(vectors.norm(e), 6).alias("length"), F.round(vectors.population_std(e), 6).alias("spread"))


def q38_session_windows(spark, sf_dir):
    x = updates.session_counts(table(spark, sf_dir, "events"), "ts", "30 minutes", ("user_id",))
    return x.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")


def q39_embed_tasks(spark, sf_dir):
    """The offline embedder over all tickets."""
    x = embed_tasks(prepare.preprocess_tasks(tasks(spark, sf_dir)), HashedNgrams())
    return x.select("issue_id", F.size("embedding").alias("dims"), F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


def q40_clean_by_language(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", text.clean_description(F.col("text")).alias("c"), text.content_fingerprint(F.lit(""), F.col("text")).alias("f"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("c")), 6).alias("avg_length"), F.count_distinct("f").alias("fingerprints"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}


# ---- the same in DuckDB's SQL ----


def _clean(x: str, n: int = 500) -> str:
    for p, r in (("(?s)```.*?```", ""), ("`[^`]*`", ""), ("(ERROR|WARN|DEBUG|INFO|TRACE)[^\\n]*", ""), ("\\tat\\s+[\\w\\.$]+\\([^\\n]*?\\)", ""), ("Exception in thread[^\\n]*", ""), ("\\[[^\\n]*?\\][^\\n]*", ""), ("<[^>]+>", " "), ("\\s+", " ")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return f"(SELECT CASE WHEN length(c) > {n} THEN substr(c, 1, {n}) || '...' ELSE c END FROM (SELECT trim({x}) AS c))"


_TASKS = f"""t AS (SELECT 'DOC-' || lpad(doc_id::VARCHAR, 8, '0') AS issue_id, split_part(text, chr(10), 1) AS summary, text AS description,
 {START} + INTERVAL 1 MINUTE * doc_id AS created_at, {START} + INTERVAL 1 MINUTE * doc_id AS updated_at, source AS cluster_label, doc_id AS ord FROM documents)"""
_CHANGED = _TASKS + """, n AS (SELECT CASE WHEN ord % 13 = 0 THEN 'DOC-' || lpad((ord + 1000000)::VARCHAR, 8, '0') ELSE issue_id END AS issue_id, summary,
 CASE WHEN ord % 5 = 0 OR ord % 17 = 0 THEN description || ' edited' ELSE description END AS description, created_at,
 updated_at + INTERVAL 1 MILLISECOND * (CASE WHEN ord % 7 = 0 THEN 2000 ELSE 0 END + CASE WHEN ord % 11 = 0 THEN 500 ELSE 0 END - CASE WHEN ord % 17 = 0 THEN 86400000 ELSE 0 END) AS updated_at, cluster_label, ord FROM t)"""
_MARK = "substr(md5({0}.summary || '|' || {0}.description || '|' || coalesce({0}.cluster_label, '')), 1, 16)"
_CATEGORY = f"""c AS (SELECT n.*, o.issue_id AS old_id, o.description AS old_description, o.summary AS old_summary, o.ord AS old_ord,
 CASE WHEN o.issue_id IS NULL THEN 'new' WHEN epoch_us(n.updated_at) - epoch_us(o.updated_at) > 1000000 OR {_MARK.format("n")} <> {_MARK.format("o")} THEN 'updated' ELSE 'unchanged' END AS category
 FROM n LEFT JOIN t AS o ON n.issue_id = o.issue_id)"""


def _jaccard(a: str, b: str) -> str:
    x, y = (f"list_distinct(string_split(lower({v}), ''))" for v in (a, b))
    return f"(CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"


_CENTROIDS = """u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
 m AS (SELECT label, i, avg(x) AS c FROM u GROUP BY label, i),
 d AS (SELECT u.vec_id, u.label, sqrt(sum((u.x - m.c) ^ 2)) AS dist, stddev_pop(u.x) AS sd FROM u JOIN m ON u.label = m.label AND u.i = m.i GROUP BY u.vec_id, u.label),
 p AS (SELECT vec_id, label, dist, least(greatest(exp(-dist / CASE WHEN sd = 0 THEN 1 ELSE sd END), 0), 1) AS conf FROM d)"""
_NOISE = """x AS (SELECT vec_id, CASE WHEN label >= 8 THEN NULL ELSE label END AS cluster_id FROM embeddings),
 r AS (SELECT cluster_id, count(*) AS size, 0.5::DOUBLE AS avg_confidence, false AS is_noise FROM x WHERE cluster_id IS NOT NULL GROUP BY cluster_id
 UNION ALL SELECT -1, count(*), 0.0, true FROM x WHERE cluster_id IS NULL HAVING count(*) > 0)"""


def _label_case(t: str) -> str:
    any_of = lambda v: " OR ".join(f"contains(lower({t}), '{k.lower()}')" for k in v["keywords"])
    return "[" + ", ".join(f"CASE WHEN {any_of(v)} THEN '{k}' END" for k, v in PART_LABELS.items()) + "]"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c) for c in r) + ")" for r in rows) + ")"


def _intent_case(m: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({m}), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}'" for k, ps in table.items()) + " ELSE 'unknown' END"


def _parameter(m: str, name: str) -> str:
    return ", ".join(f"nullif(regexp_extract({m}, '(?i){p}', 1), '')" for p in intents.PARAMETERS[name])


_PART_TEXT = "coalesce(p_name, '') || ' ' || coalesce(p_type, '')"
ORACLE_SQL = {
    "q01_clean_documents": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "q02_clean_pages": f"SELECT page_id, {_clean('html')} AS cleaned FROM pages",
    "q03_feature_text": f"WITH {_TASKS} SELECT issue_id, trim(concat_ws(' | ', nullif(summary, ''), nullif({_clean('description')}, ''))) AS feature_text FROM t",
    "q04_content_fingerprint": f"WITH {_TASKS} SELECT issue_id, {_MARK.format('t')} AS fingerprint FROM t",
    "q05_keep_last_by_key": f"WITH {_CHANGED}, a AS (SELECT *, 0 AS v FROM t UNION ALL SELECT *, 1 AS v FROM n) SELECT issue_id, v, length(description)::INT AS n FROM a QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY v DESC, ord DESC) = 1",
    "q06_categorize_updates": f"WITH {_CHANGED}, {_CATEGORY} SELECT issue_id, category FROM c",
    "q07_update_statistics": f"WITH {_CHANGED}, {_CATEGORY} SELECT count(*) AS total_comparisons, count(*) FILTER (category = 'new') AS new_tasks, count(*) FILTER (category = 'updated') AS updated_tasks, count(*) FILTER (category = 'unchanged') AS unchanged_tasks, (SELECT count(*) FROM t) AS total_existing FROM c",
    "q08_merge_updates": f"""WITH {_CHANGED}, {_CATEGORY}, k AS (SELECT c.*, e.label AS old_cluster, {_clean('c.description')} AS nc, {_clean('c.old_description')} AS oc FROM c LEFT JOIN embeddings e ON e.vec_id = c.old_ord WHERE category <> 'unchanged'),
 z AS (SELECT *, category = 'updated' AND old_cluster IS NOT NULL AND {_jaccard('summary', 'old_summary')} >= 0.8 AND {_jaccard('nc', 'oc')} >= 0.8 AS keep FROM k)
 SELECT issue_id, category, CASE WHEN keep THEN old_cluster END AS cluster_id, CASE WHEN keep THEN 0.5::DOUBLE END AS cluster_confidence FROM z""",
    "q09_jaccard_pairs": f"SELECT a.item_id, round({_jaccard('a.text', 'b.text')}, 6) AS similarity FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1",
    "q10_keyword_label": f"WITH x AS (SELECT p_partkey, list_filter({_label_case(_PART_TEXT)}, lambda y: y IS NOT NULL) AS l FROM part) SELECT p_partkey, coalesce(l[1], 'unclassified') AS label, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END AS all_labels FROM x",
    "q11_intent": f"WITH x AS (SELECT id::BIGINT AS id, message FROM {_values(MESSAGES)} v(id, message) UNION ALL SELECT conv_id * 1000 + turn + 1000, text FROM conversations) SELECT id, {_intent_case('message', intents.INTENTS)} AS intent, {_intent_case('message', intents.DEMO_INTENTS)} AS demo_intent FROM x",
    "q12_parameter_extract": f"SELECT id, coalesce({_parameter('message', 'min_size')}, '10')::INT AS min_size, coalesce({_parameter('message', 'epsilon')})::DOUBLE AS epsilon FROM {_values(MESSAGES)} v(id, message)",
    "q13_cluster_report": f"""WITH {_CENTROIDS}, s AS (SELECT label, string_agg('V' || vec_id, ',' ORDER BY vec_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 3 GROUP BY label)
 SELECT p.label AS cluster_id, count(*) AS size, round(avg(conf), 6) AS avg_confidence, round(any_value(q.len), 6) AS centroid_distance, false AS is_noise, any_value(s.samples) AS samples FROM p JOIN (SELECT label, sqrt(sum(c * c)) AS len FROM m GROUP BY label) q ON p.label = q.label JOIN s ON p.label = s.label GROUP BY p.label""",
    "q14_point_confidence": f"WITH {_CENTROIDS} SELECT vec_id, round(dist, 6) AS distance, round(conf, 6) AS confidence FROM p",
    "q15_cosine_topk": """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS c FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
 SELECT query_id, id, round(c, 6) AS cosine, (row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id))::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) <= 5""",
    "q16_nearest_centroid": f"WITH {_CENTROIDS}, z AS (SELECT u.vec_id, m.label, sum((u.x - m.c) ^ 2) AS s FROM u JOIN m ON u.i = m.i GROUP BY u.vec_id, m.label) SELECT vec_id, arg_min(label, (s, label)) AS nearest FROM z GROUP BY vec_id",
    "q17_silhouette": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON true GROUP BY 1, 2, 3),
 y AS (SELECT vec_id, own, max(s) FILTER (own = other) / greatest(1, max(n) FILTER (own = other) - 1) AS a, min(s / n) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS size FROM x GROUP BY 1, 2)
 SELECT own AS label, count(*) AS n, round(avg(CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette FROM y GROUP BY own""",
    "q18_noise_report": f"""WITH {_NOISE}, s AS (SELECT cluster_id, string_agg('V' || vec_id, ',' ORDER BY vec_id) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS rn FROM x WHERE cluster_id IS NOT NULL) WHERE rn <= 3 GROUP BY cluster_id)
 SELECT r.cluster_id, size, avg_confidence, NULL::DOUBLE AS centroid_distance, is_noise, samples FROM r LEFT JOIN s ON r.cluster_id = s.cluster_id""",
    "q19_top_clusters": f"WITH {_CENTROIDS} SELECT label AS cluster_id, count(*) AS size, format('{{:.2f}}', avg(conf)) AS confidence FROM p GROUP BY label ORDER BY size DESC, label LIMIT 3",
    "q20_export_rows": f"WITH {_NOISE} SELECT cluster_id, size, avg_confidence, is_noise FROM r",
    "q23_session_rollup": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS transcript FROM conversations GROUP BY conv_id",
    "q24_batch_size": """WITH x AS (SELECT source, avg(length(text)) AS a FROM documents GROUP BY source), y AS (SELECT *, CASE WHEN a > 500 THEN 0.5 WHEN a > 200 THEN 0.75 ELSE 1.0 END AS f FROM x)
 SELECT source, round(a, 6) AS average_length, greatest(8, least(64, floor(87381 * f)))::INT AS batch_size, greatest(8, least(256, floor(128 * f)))::INT AS large_model_batch FROM y""",
    "q25_suggest_params": """WITH x AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) SELECT source, lang, n,
 (CASE WHEN n < 20 THEN 15 WHEN n < 100 THEN 10 WHEN n < 500 THEN 5 ELSE least(100, greatest(10, n // 50)) END)::INT AS min_cluster_size,
 (CASE WHEN n < 20 THEN 0.8 WHEN n < 100 THEN 0.5 WHEN n < 500 THEN 0.3 ELSE 0.6 END)::DOUBLE AS cluster_selection_epsilon,
 (CASE WHEN n < 20 THEN 10 WHEN n < 100 THEN 15 WHEN n < 500 THEN 25 ELSE least(30, n // 10) END)::INT AS max_clusters FROM x""",
    "q26_upsert_stream": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "q27_required_filter": f"""SELECT doc_id::VARCHAR AS issue_id, trim(split_part(text, chr(10), 1)) AS summary, (CASE WHEN doc_id % 4 = 1 THEN 0 ELSE length(trim(text)) END)::INT AS n,
 epoch_us(TIMESTAMP '2024-03-01 10:00:00') AS created, epoch_us(CASE WHEN doc_id % 6 = 0 THEN TIMESTAMP '2024-03-01 10:00:00' ELSE TIMESTAMP '2024-03-02 11:30:00.25' END) AS updated, CASE WHEN doc_id % 5 <> 0 THEN source END AS cluster_label
 FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 7 <> 2 AND doc_id % 9 <> 5""",
    "q28_review_decisions": f"""WITH {_TASKS}, d AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accept' WHEN toxic = 1 THEN 'keep' ELSE 'hybrid' END AS decision FROM labels)
 SELECT issue_id, coalesce(decision, 'pending') AS decision, CASE decision WHEN 'accept' THEN upper(cluster_label) WHEN 'keep' THEN cluster_label WHEN 'hybrid' THEN 'by hand' END AS final_label FROM t LEFT JOIN d ON t.ord = d.doc_id""",
    "q29_recent_half_year": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-08-01' - INTERVAL 6 MONTH GROUP BY o_orderpriority",
    "q30_window_counts": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q31_inverted_index": "WITH x AS (SELECT * FROM " + _values([(i, k.lower(), label) for i, (label, v) in enumerate(labels.load_dictionary().items()) for k in v["keywords"]]) + " v(o, keyword, label)) SELECT keyword, string_agg(label, ',' ORDER BY o) AS labels FROM x GROUP BY keyword",
    "q32_all_labels": "SELECT label, label_ord, description FROM " + _values([(k, i, v["description"]) for i, (k, v) in enumerate(PART_LABELS.items())]) + " v(label, label_ord, description)",
    "q33_contains_join": f"WITH x AS (SELECT p_partkey, list_filter({_label_case(_PART_TEXT)}, lambda y: y IS NOT NULL) AS l FROM part) SELECT p_partkey, unnest(l) AS label FROM x",
    "q34_first_seen": f"WITH {_CHANGED}, a AS (SELECT 0 AS v, issue_id FROM t UNION ALL SELECT 1, issue_id FROM n WHERE issue_id NOT IN (SELECT issue_id FROM t)) SELECT v, count(*) AS n, count(DISTINCT issue_id) AS ids FROM a GROUP BY v",
    "q35_snapshot": f"""WITH {_CHANGED}, {_CATEGORY}, a AS (SELECT issue_id, description, updated_at, 1 AS v, ord FROM c WHERE category <> 'unchanged' UNION ALL SELECT issue_id, description, updated_at, 0, ord FROM t)
 SELECT issue_id, length(description)::INT AS n, epoch_us(updated_at) AS updated FROM a QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY v DESC, ord DESC) = 1""",
    "q36_demo_distribution": f"WITH {_TASKS} SELECT (ord % 3)::INT AS demo_cluster, count(*) AS n, arg_min(summary, ord) AS first_summary FROM t GROUP BY 1",
    "q37_vector_functions": "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, count(*)::INT AS dims, round(sqrt(sum(x * x)), 6) AS length, round(stddev_pop(x), 6) AS spread FROM u GROUP BY vec_id",
    "q38_session_windows": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM b GROUP BY user_id, k""",
    "q40_clean_by_language": f"SELECT lang, count(*) AS n, round(avg(length(c)), 6) AS avg_length, count(DISTINCT f) AS fingerprints FROM (SELECT lang, {_clean('text')} AS c, substr(md5('|' || text || '|'), 1, 16) AS f FROM documents) GROUP BY lang",
}
