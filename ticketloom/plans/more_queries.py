"""More of the catalogue: files and back, reports, streams, routing, models, chat and executors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import labels, text, vectors
from ticketloom.operators import embed, hdbscan, kmeans, prepare, reports
from ticketloom.plans import chat, config, executor, pipeline
from ticketloom.plans.queries import _CATEGORY, _CENTROIDS, _CHANGED, _NOISE, _TASKS, PART_LABELS, _clean, _label_case, _values, _with_centroids, changed, fresh_folder, table, tasks, vector_tasks
from ticketloom.schema import PROCESSED
from ticketloom.sources import sinks, tickets
from ticketloom.streaming import updates



def _moment():
    return F.expr("TIMESTAMP '2024-06-01 12:00:00'")


def _noisy(spark, sf_dir):
    t = vector_tasks(spark, sf_dir).withColumn("_l", F.when(F.col("cluster_id") >= 8, -1).otherwise(F.col("cluster_id"))).withColumn("_p", F.lit(0.5))
    return reports.assignments(t, "_l", "_p")


def _report(spark, sf_dir):
    return reports.cluster_report(_noisy(spark, sf_dir), "ord")


def _document(spark, sf_dir):
    return sinks.result_document(_report(spark, sf_dir), reports.totals(_noisy(spark, sf_dir)), 1.5, _moment())


def q41_csv_round_trip(spark, sf_dir):
    """Every document as a ticket of a CSV file, quotes and line ends included, read back by its suffix."""
    path = fresh_folder(spark, "tickets") + ".csv"
    sinks.write_tickets_csv(tasks(spark, sf_dir).select("issue_id", "summary", "description", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "cluster_label", F.lit("open").alias("status")), path)
    x = tickets.load_tickets(spark, path)
    return x.select("issue_id", "summary", F.length("description").alias("n"), F.md5("description").alias("mark"), F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "cluster_label")


def _processed(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").alias("cluster_id"))
    x = prepare.preprocess_tasks(tasks(spark, sf_dir), as_of=_moment()).drop("embedding", "cluster_id").join(e, F.col("ord") == F.col("_v"), "left")
    return x.withColumn("cluster_confidence", F.when(F.col("cluster_id").isNotNull(), 0.25)).select(*PROCESSED.fieldNames())


def _processed_columns(x):
    return x.select("issue_id", F.length("cleaned_description").alias("n"), F.unix_micros("created_at").alias("created"), F.unix_micros("processed_at").alias("processed"), F.size("embedding").alias("dims"), "cluster_id", "cluster_confidence")


def q42_processed_lines(spark, sf_dir):
    """Processed tickets to JSON lines and back."""
    path = fresh_folder(spark, "processed")
    sinks.write_tasks(_processed(spark, sf_dir), path)
    return _processed_columns(tickets.read_processed(spark, path))


def q43_processed_parquet(spark, sf_dir):
    path = fresh_folder(spark, "processed") + ".parquet"
    sinks.write_tasks(_processed(spark, sf_dir), path)
    return _processed_columns(tickets.read_processed(spark, path))


def q44_processed_array(spark, sf_dir):
    """Processed tickets to one JSON array in one file and back; what has an embedding."""
    path = fresh_folder(spark, "processed") + ".json"
    sinks.write_json_array(_processed(spark, sf_dir), path)
    return _processed_columns(prepare.with_embedding(tickets.read_processed(spark, path)))


def q45_result_file(spark, sf_dir):
    """A clustering result to its JSON document and back, a row for each cluster."""
    path = fresh_folder(spark, "result") + ".json"
    sinks.write_result(_document(spark, sf_dir), path)
    doc = tickets.read_result(spark, path)
    rows = tickets.result_rows(doc).select("cluster_id", "size", "avg_confidence", "is_noise", F.size("sample_tasks").alias("samples"))
    return rows.crossJoin(F.broadcast(doc.select("total_tasks", "clusters_found", "processing_time", "generated_at")))  # one row


def q46_export_csv(spark, sf_dir):
    path = fresh_folder(spark, "export")
    sinks.export(_document(spark, sf_dir), _report(spark, sf_dir), path, "CSV")
    return spark.read.option("header", True).schema("cluster_id int, size long, avg_confidence double, is_noise boolean").csv(path)


def q47_export_json(spark, sf_dir):
    path = fresh_folder(spark, "export")
    sinks.export(_document(spark, sf_dir), _report(spark, sf_dir), path, "json")
    return tickets.result_rows(tickets.read_result(spark, path)).select("cluster_id", "size", "is_noise", "description")


def q48_console_rows(spark, sf_dir):
    return reports.console_rows(_report(spark, sf_dir))


def q49_issues_document(spark, sf_dir):
    """The documents as {"issues": [...]}, one document by source."""
    path = fresh_folder(spark, "issues")
    t = tasks(spark, sf_dir).select("issue_id", "summary", "description", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "cluster_label")
    t.groupBy("cluster_label").agg(F.collect_list(F.struct(*t.columns)).alias("issues")).select("issues").write.option("maxRecordsPerFile", 1).json(path)  # a file is a document
    return tickets.read_issues(spark, path, _moment()).select("issue_id", F.length("description").alias("n"), F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"))


def q50_lenient_tasks(spark, sf_dir):
    """The demonstration's loader over rows that lack most columns."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("description"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("summary"))
    return tickets.lenient_tasks(d, _moment()).select("issue_id", "summary", F.length("description").alias("n"), "created_at", "status", "cleaned_description")


def q51_rejects(spark, sf_dir):
    """What decoding drops, counted by reason."""
    n = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        F.when(n % 10 != 3, n.cast("string")).alias("issue_id"), F.when(n % 7 != 2, F.col("lang")).alias("summary"),
        F.when(n % 9 == 5, F.lit("no date")).otherwise(F.lit("2024-03-01T10:00:00Z")).alias("created_at"), F.when(n % 11 == 1, F.lit("nor this")).alias("updated_at"),
    )
    return prepare.rejects(raw)


def q52_totals(spark, sf_dir):
    return reports.totals(_noisy(spark, sf_dir))


def q53_embed_once(spark, sf_dir):
    """Each ticket's vector has length 1, or none without text; embedding equal texts once gives the same vectors."""
    x = prepare.preprocess_tasks(tasks(spark, sf_dir))
    one, two = embed.embed_tasks(x), embed.embed_tasks(x, dedupe=True).select("issue_id", F.col("embedding").alias("other"))
    n = vectors.norm(F.col("embedding"))
    return one.join(two, "issue_id").select("issue_id", F.size("embedding").alias("dims"), (F.abs(n - 1) < 1e-5).alias("unit"), F.col("embedding").eqNullSafe(F.col("other")).alias("same"))


def q54_embedding_statistics(spark, sf_dir):
    return embed.embedding_statistics(prepare.preprocess_tasks(tasks(spark, sf_dir)))


def q55_kmeans_fit(spark, sf_dir):
    """Ten starts over the vectors: sizes add up, nearest centroids are means, and the labels' own means cost no less."""
    e = vector_tasks(spark, sf_dir)
    r = pipeline.cluster_tasks(e, config.ClusteringParameters(algorithm="kmeans"), order="ord", k=10)
    got = r.assignments.join(kmeans.centroid_table(r.assignments).select(F.col("cluster_id").alias("_c"), "centroid"), F.col("cluster_id") == F.col("_c"))
    d = vectors.euclidean(F.col("embedding"), F.col("centroid"))
    mine = got.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster_id").alias("clusters"), F.sum(d * d).alias("cost"), F.min("cluster_confidence").alias("low"), F.max("cluster_confidence").alias("high"))
    x, _ = _with_centroids(spark, sf_dir)
    d = vectors.euclidean(F.col("embedding"), F.col("centroid"))
    theirs = x.agg(F.sum(d * d).alias("labels_cost"))
    return mine.crossJoin(theirs).select("rows", "clusters", (F.col("cost") <= F.col("labels_cost") * 1.001).alias("no_worse"), ((F.col("low") >= 0) & (F.col("high") <= 1)).alias("within"))  # one row each


def _moved():
    """Each vector moved to a place of its label: small beside the distances between places, but whole."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i == F.col("label"), 10.0).otherwise(0.0) + x * 0.05)


def q56_hdbscan_copies(spark, sf_dir):
    """Vectors set far apart by label and moved by little: a cluster for each label, sizes as they are, no noise."""
    t = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("V"), "vec_id").alias("issue_id"), "label", _moved().alias("embedding"))
    got = hdbscan.cluster(t, min_cluster_size=10, epsilon=0.5).where("_label >= 0").groupBy("label", "_label").agg(F.count(F.lit(1)).alias("n"), (F.min("_probability") > 0).alias("sure"))
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.every("sure").alias("sure"))


def q57_best_k(spark, sf_dir):
    """The same vectors: the silhouette is largest at the number of labels."""
    return spark.createDataFrame([(kmeans.optimal_k(table(spark, sf_dir, "embeddings").select(_moved().alias("embedding"))),)], "k int")


def q58_route(spark, sf_dir):
    """Each vector to the most similar label mean, if the cosine exceeds 0.2."""
    t = vector_tasks(spark, sf_dir)
    got = updates.route(t.drop("cluster_id"), kmeans.centroid_table(t), 0.2)
    return got.select(F.col("ord").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "cluster_id")


def q59_update_stream(spark, sf_dir):
    """Tickets, then a later delivery of them, as batches of a stream into the bucketed snapshot."""
    root = fresh_folder(spark, "updates")
    fill = lambda x: prepare.preprocess_tasks(x, as_of=_moment()).select(*PROCESSED.fieldNames())
    store = updates.SnapshotStore(spark, f"{root}/state", PROCESSED)
    updates.apply_batch(store, fill(tasks(spark, sf_dir)), -1, "updated_at")
    fill(changed(spark, sf_dir)).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(PROCESSED).parquet(f"{root}/in")
    updates.start_updates(stream, store, "updated_at", f"{root}/checkpoint").awaitTermination()
    return store.read().select("issue_id", F.length("description").alias("n"), F.unix_micros("updated_at").alias("updated"))


def q60_previews(spark, sf_dir):
    """Clipped and cut texts, cache keys and extended cleaning."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    noisy = F.concat(t, F.lit(" " + "QUJD" * 20 + " tail"))
    return d.select("doc_id", text.clip(t, 100).alias("preview"), text.truncate(t, 200).alias("cut"), embed.text_key_column(t).alias("key"), F.md5(text.clean_description(noisy, 100_000, extended=True)).alias("extended"))


def q61_describe(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select("p_partkey", labels.keyword_label(labels.labelling_text(F.col("p_name"), F.col("p_type")), PART_LABELS).alias("label"))
    return labels.describe(x, labels.dictionary_table(spark, PART_LABELS)).select("p_partkey", "label", "description")


def q62_near_centroid(spark, sf_dir):
    """The five vectors nearest each label's mean."""
    return pipeline.near_centroid(vector_tasks(spark, sf_dir), 5, "ord").select("cluster_id", F.col("ord").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def q63_cluster_labels(spark, sf_dir):
    """Clusters of parts by brand take the keyword label of most of the five parts nearest their mean."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("issue_id"), F.concat_ws(" ", "p_name", "p_type").alias("summary"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("embedding"), F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("cluster_id"))
    x = pipeline.label_clusters(p, PART_LABELS)
    return x.select("cluster_id", "label")


PRESET_CHECKS = ((10, "conservative"), (30, "conservative"), (19, "balanced"), (20, "balanced"), (9, "aggressive"), (1000, "kmeans_focused"))


def q64_validation(spark, sf_dir):
    """Presets checked against numbers of rows; validation's verdicts."""
    rows = []
    for n, name in PRESET_CHECKS:
        c = config.preset(name)
        v = config.validate(c, n)
        rows.append((n, name, c.min_cluster_size, c.cluster_selection_epsilon, c.max_clusters, c.algorithm, v["valid"], len(v["issues"]), len(v["suggestions"])))
    odd = config.validate(config.ClusteringParameters(algorithm="kmeans", max_clusters=2, cluster_selection_epsilon=1.5))
    rows.append((0, "odd", 10, 1.5, 2, "kmeans", odd["valid"], len(odd["issues"]), len(odd["suggestions"])))
    return spark.createDataFrame(rows, "n int, name string, min_cluster_size int, epsilon double, max_clusters int, algorithm string, valid boolean, issues int, suggestions int")


def q65_executor(spark, sf_dir):
    """Python over every supplier's name on the cluster: ordered results, errors in place, batches. The caller's list is the
    input, so it is a small table's."""
    names = [r.s_name for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()]

    def words(name):
        if "7" in name:
            raise ValueError(name)
        return len(name.split("#"))

    got = executor.submit_batch(spark, words, [(n,) for n in names])
    sizes = executor.map_parallel(spark, len, names)
    upper = executor.batch_process(spark, lambda part: [x.upper() for x in part], names, 10)
    return spark.createDataFrame([(i + 1, None if isinstance(g, Exception) else g, s, u) for i, (g, s, u) in enumerate(zip(got, sizes, upper))], "i int, words int, size int, upper string")


CHAT = (
    ("help", None), ("聚类分析", None), ("导入数据", "file_upload"), ("导出全部结果", None), ("修改设置：最小聚类大小设为15", None), ("nothing of the kind", None), ("已上传，请导入数据", None), ("聚类分析", None), ("show me the results", "export_options"),
)


def q66_chat(spark, sf_dir):
    """A conversation over the documents as a ticket file: what each message means and asks for, and what is known after it."""
    path = fresh_folder(spark, "chat") + ".csv"
    sinks.write_tickets_csv(tasks(spark, sf_dir).select("issue_id", "summary", "description"), path)
    agent = chat.Agent(spark)
    session = agent.create_session()
    rows = []
    for n, (message, _) in enumerate(CHAT):
        if "已上传" in message:
            agent.sessions[session].context.update(file_uploaded=True, uploaded_file_path=path)
        r = agent.process_message(session, message)
        c = agent.sessions[session].context
        rows.append((n, chat.recognize_intent(message), r.action_required, c.get("total_tasks"), bool(c.get("data_processed")), bool(c.get("analysis_completed")), c.get("min_cluster_size"), len(agent.sessions[session].messages)))
    agent.close()
    return spark.createDataFrame(rows, "n int, intent string, action string, tickets long, loaded boolean, clustered boolean, min_size int, messages int")


def q67_large_dictionary(spark, sf_dir):
    """Each word of parts' names as a keyword, looked for in all names and types; in shards of a few hundred bytes."""
    p = table(spark, sf_dir, "part").withColumn("t", F.concat_ws(" ", "p_type", "p_name"))
    words = p.select(F.explode(F.split("p_name", " ")).alias("keyword")).distinct()
    base = words.select("keyword", F.upper("keyword").alias("label"), F.length("keyword").alias("label_ord"))
    return labels.label_join(p, base, "t", "p_partkey", shard_bytes=500).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("labels"), F.sum("label_ord").cast("long").alias("letters"))


def q68_views(spark, sf_dir):
    """A run's tables under SQL."""
    r = pipeline.ClusteringResult(_noisy(spark, sf_dir), _report(spark, sf_dir), 0, 0, 0.0)
    pipeline.register_views(spark, r, "run_")
    return spark.sql("SELECT c.cluster_id, c.size, count(a.issue_id) AS counted FROM run_clusters c LEFT JOIN run_assignments a ON c.cluster_id = coalesce(a.cluster_id, -1) GROUP BY c.cluster_id, c.size")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}


# ---- the same in DuckDB's SQL ----

_PROCESSED = f"""SELECT issue_id, length({_clean('description')})::INT AS n, epoch_us(created_at) AS created, epoch_us(TIMESTAMP '2024-06-01 12:00:00') AS processed, CASE WHEN e.vec_id IS NULL THEN NULL ELSE len(e.embedding)::INT END AS dims, e.label AS cluster_id, CASE WHEN e.label IS NOT NULL THEN 0.25::DOUBLE END AS cluster_confidence
 FROM t LEFT JOIN embeddings e ON e.vec_id = t.ord"""
_SAMPLES = "s AS (SELECT cluster_id, least(3, count(*))::INT AS samples, string_agg('vector ' || vec_id, ', ' ORDER BY vec_id) FILTER (rn <= 2) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS rn FROM x WHERE cluster_id IS NOT NULL) GROUP BY cluster_id)"
_PART_WORDS = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part)"
_CHAT_ROWS = [
    (n, i, a, loaded, done, size)
    for n, (i, a, loaded, done, size) in enumerate([
        ("help", None, 0, 0, None), ("clustering", None, 0, 0, None), ("data_import", "file_upload", 0, 0, None), ("results", None, 0, 0, None), ("parameters", None, 0, 0, 15), ("unknown", None, 0, 0, 15),
        ("data_import", None, 1, 0, 15), ("clustering", None, 1, 1, 15), ("results", "export_options", 1, 1, 15),
    ])
]


def _null(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_STAY = "split_part(text, chr(10), 1)"
ORACLE_SQL = {
    "q41_csv_round_trip": f"""WITH {_TASKS}, r AS (SELECT *, CASE WHEN summary IN ('') THEN NULL ELSE trim(summary) END AS s, trim(description) AS d FROM t)
 SELECT issue_id, s AS summary, length(d)::INT AS n, md5(d) AS mark, epoch_us(created_at) AS created, epoch_us(created_at) AS updated, nullif(trim(cluster_label), '') AS cluster_label FROM r WHERE s IS NOT NULL""",
    "q42_processed_lines": f"WITH {_TASKS} {_PROCESSED}",
    "q43_processed_parquet": f"WITH {_TASKS} {_PROCESSED}",
    "q44_processed_array": f"WITH {_TASKS} {_PROCESSED} WHERE e.vec_id IS NOT NULL",
    "q45_result_file": f"""WITH {_NOISE}, {_SAMPLES} SELECT r.cluster_id, size, avg_confidence, is_noise, samples, (SELECT count(*) FROM x) AS total_tasks, (SELECT count(DISTINCT cluster_id) FROM x)::INT AS clusters_found, 1.5::DOUBLE AS processing_time, '2024-06-01T12:00:00' AS generated_at
 FROM r LEFT JOIN s ON r.cluster_id = s.cluster_id""",
    "q46_export_csv": f"WITH {_NOISE} SELECT cluster_id, size, avg_confidence, is_noise FROM r",
    "q47_export_json": f"WITH {_NOISE} SELECT cluster_id, size, is_noise, CASE WHEN is_noise THEN '{reports.NOISE_TEXT}' END AS description FROM r",
    "q48_console_rows": f"WITH {_NOISE}, {_SAMPLES} SELECT r.cluster_id, size, format('{{:.3f}}', avg_confidence) AS confidence, coalesce(CASE WHEN length(preview) > 50 THEN substr(preview, 1, 50) || '...' ELSE preview END, '') AS samples FROM r LEFT JOIN s ON r.cluster_id = s.cluster_id",
    "q49_issues_document": f"WITH {_TASKS} SELECT issue_id, length(trim(description))::INT AS n, epoch_us(created_at) AS created, epoch_us(created_at) AS updated FROM t WHERE summary <> ''",
    "q50_lenient_tasks": "SELECT printf('TASK-%03d', doc_id + 1) AS issue_id, CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'No summary' END AS summary, CASE WHEN doc_id % 3 > 0 THEN length(text) ELSE 0 END::INT AS n, '2024-06-01T12:00:00' AS created_at, 'To Do' AS status, CASE WHEN doc_id % 3 > 0 THEN substr(text, 1, 200) ELSE '' END AS cleaned_description FROM documents",
    "q51_rejects": "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN 'no issue_id' WHEN doc_id % 7 = 2 THEN 'no summary' WHEN doc_id % 9 = 5 THEN 'unreadable created_at' WHEN doc_id % 11 = 1 THEN 'unreadable updated_at' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason",
    "q52_totals": f"WITH {_NOISE} SELECT count(*) AS total_tasks, count(DISTINCT cluster_id)::INT AS clusters_found FROM x",
    "q53_embed_once": f"WITH {_TASKS} SELECT issue_id, 384 AS dims, trim(concat_ws(' | ', nullif(summary, ''), nullif({_clean('description')}, ''))) <> '' AS unit, true AS same FROM t",
    "q54_embedding_statistics": f"WITH {_TASKS}, f AS (SELECT trim(concat_ws(' | ', nullif(summary, ''), nullif({_clean('description')}, ''))) AS f FROM t) SELECT count(*)::BIGINT AS texts, count(DISTINCT f) AS different, round(100.0 * (count(*) - count(DISTINCT f)) / count(*), 1)::DOUBLE AS saved_percent FROM f",
    "q55_kmeans_fit": "SELECT count(*) AS rows, 10::BIGINT AS clusters, true AS no_worse, true AS within FROM embeddings",
    "q56_hdbscan_copies": "SELECT label, 1::BIGINT AS clusters, count(*)::BIGINT AS n, true AS sure FROM embeddings GROUP BY label",
    "q57_best_k": "SELECT count(DISTINCT label)::INT AS k FROM embeddings",
    "q58_route": f"""WITH {_CENTROIDS}, z AS (SELECT u.vec_id, m.label, sum(u.x * m.c) / sqrt(sum(u.x * u.x)) / sqrt(sum(m.c * m.c)) AS s FROM u JOIN m ON u.i = m.i GROUP BY u.vec_id, m.label)
 SELECT vec_id, round(max(s), 6) AS similarity, CASE WHEN max(s) > 0.2 THEN arg_max(label, s) END AS cluster_id FROM z GROUP BY vec_id""",
    "q59_update_stream": f"""WITH {_CHANGED}, {_CATEGORY}, a AS (SELECT issue_id, description, updated_at, 1 AS v, ord FROM c WHERE category <> 'unchanged' UNION ALL SELECT issue_id, description, updated_at, 0, ord FROM t)
 SELECT issue_id, length(description)::INT AS n, epoch_us(updated_at) AS updated FROM a QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY v DESC, ord DESC) = 1""",
    "q60_previews": f"""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, substr(text, 1, 200) AS cut, substr(md5(text), 1, 16) AS key, md5({_clean("regexp_replace(regexp_replace(regexp_replace(text || ' tail', '(?s)```.*?```', '', 'g'), '`[^`]*`', '', 'g'), '(?:[A-Za-z0-9+/]{4}){16,}={0,2}', '', 'g')", 100_000)}) AS extended FROM documents""",
    "q61_describe": f"""WITH x AS (SELECT p_partkey, list_filter({_label_case("coalesce(p_name, '') || ' ' || coalesce(p_type, '')")}, lambda y: y IS NOT NULL)[1] AS label FROM part)
 SELECT p_partkey, x.label, description FROM x LEFT JOIN {_values([(k, v["description"]) for k, v in PART_LABELS.items()])} d(label, description) ON x.label = d.label""",
    "q62_near_centroid": f"WITH {_CENTROIDS} SELECT label AS cluster_id, vec_id, round(dist, 6) AS distance, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id)::INT AS rank FROM d QUALIFY rank <= 5",
    "q63_cluster_labels": f"""WITH x AS (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS cluster_id, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b, list_filter({_label_case("p_name || ' ' || p_type")}, lambda y: y IS NOT NULL)[1] AS label FROM part),
 m AS (SELECT cluster_id, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY cluster_id), y AS (SELECT x.*, row_number() OVER (PARTITION BY cluster_id ORDER BY (a - ma) ^ 2 + (b - mb) ^ 2, p_partkey::VARCHAR) AS rn FROM x JOIN m USING (cluster_id)),
 v AS (SELECT cluster_id, label, count(label) AS n FROM y WHERE rn <= 5 GROUP BY cluster_id, label) SELECT cluster_id, v.label FROM v LEFT JOIN {_values([(i, k) for i, k in enumerate(PART_LABELS)])} d(o, label) ON v.label = d.label QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, o NULLS LAST) = 1""",
    "q64_validation": "SELECT * FROM (VALUES (10, 'conservative', 15, 0.8::DOUBLE, 10, 'hdbscan', false, 1, 1), (30, 'conservative', 15, 0.8, 10, 'hdbscan', true, 0, 0), (19, 'balanced', 10, 0.5, 15, 'hdbscan', false, 1, 1), (20, 'balanced', 10, 0.5, 15, 'hdbscan', true, 0, 0), (9, 'aggressive', 5, 0.3, 25, 'hdbscan', false, 1, 1), (1000, 'kmeans_focused', 8, 0.5, 12, 'kmeans', true, 0, 0), (0, 'odd', 10, 1.5, 2, 'kmeans', false, 1, 2)) v(n, name, min_cluster_size, epsilon, max_clusters, algorithm, valid, issues, suggestions)",
    "q65_executor": "SELECT row_number() OVER (ORDER BY s_suppkey)::INT AS i, CASE WHEN NOT contains(s_name, '7') THEN len(string_split(s_name, '#'))::INT END AS words, length(s_name)::INT AS size, upper(s_name) AS upper FROM supplier",
    "q66_chat": "WITH d AS (SELECT count(*) AS k FROM documents WHERE " + _STAY + " <> '') SELECT n, intent, action, CASE WHEN loaded = 1 THEN k END AS tickets, loaded = 1 AS loaded, clustered = 1 AS clustered, min_size, 2 * n + 2 AS messages FROM (VALUES " + ", ".join("(" + ", ".join(map(_null, r)) + ")" for r in _CHAT_ROWS) + ") v(n, intent, action, loaded, clustered, min_size), d",
    "q67_large_dictionary": f"WITH {_PART_WORDS} SELECT p_partkey, count(*) AS labels, sum(length(keyword))::BIGINT AS letters FROM part JOIN w ON contains(lower(p_type || ' ' || p_name), lower(keyword)) GROUP BY p_partkey",
    "q68_views": f"WITH {_NOISE} SELECT cluster_id, size, size AS counted FROM r",
}
