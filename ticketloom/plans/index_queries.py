"""Queries over indexes, searches and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import tables
from ticketloom.operators import hdbscan_blocks, history, ticket_search, vector_index
from ticketloom.plans import pipeline
from ticketloom.plans.more_queries import ORACLE_SQL as _MORE
from ticketloom.plans.queries import ORACLE_SQL as _BASE, _CHANGED, changed, fresh_folder, table, tasks
from ticketloom.sources import tickets, workbooks
from ticketloom.streaming import chat_state


def _index(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, vector_index.build(e, fresh_folder(spark, "index"))


def q69_index_recall(spark, sf_dir):
    """Vectors whose id is divisible by 20, searched in the index with as many probes as a sample needs: of the five true neighbours,
    measured against all rows, 0.9 or more are found."""
    e, index = _index(spark, sf_dir)
    q = e.where("vec_id % 20 = 0")
    found = vector_index.search(index, q, 5, vector_index.tuned_probes(index, q, 5))
    return vector_index.recall(found, pipeline.top_k_in_passes(q, e, 5)).select("queries", (F.col("recall") >= 0.9).alias("enough"))


def q70_index_exact(spark, sf_dir):
    """The same queries' neighbours, with every cell that may hold one."""
    e, index = _index(spark, sf_dir)
    return vector_index.search(index, e.where("vec_id % 20 = 0"), 5, exact=True).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


LEVELS = (1.17, 1.18, 1.19, 1.2)


def q71_linkage_levels(spark, sf_dir):
    """The spanning tree of mutual reachability over the whole vectors, made in blocks: what is connected up to some distances."""
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    return spark.createDataFrame(hdbscan_blocks.levels(hdbscan_blocks.spanning_tree(x, 5, block=200), list(LEVELS)), "distance double, components long, largest long, alone long")


def q72_ticket_search(spark, sf_dir):
    """All documents searched for words of every benchmark item: its second to fifth, of odd items the second and third as a phrase."""
    w = ticket_search.words(F.col("text"))
    plain, phrase = F.array_join(F.slice(w, 2, 4), " "), F.concat(F.lit('"'), F.array_join(F.slice(w, 2, 2), " "), F.lit('" '), F.array_join(F.slice(w, 4, 2), " "))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 1, phrase).otherwise(plain).alias("query"))
    index = ticket_search.build(table(spark, sf_dir, "documents"), fresh_folder(spark, "search"), id_col="doc_id", text_col="text")
    return ticket_search.search(index, queries)


def q73_workbooks(spark, sf_dir):
    """Every document as a ticket of an Excel workbook of up to 300, as a column of attachments, and back."""
    path = fresh_folder(spark, "workbooks")
    x = tasks(spark, sf_dir).select("issue_id", F.nullif("summary", F.lit("")).alias("summary"), "description", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "cluster_label", F.lit("open").alias("status"))
    workbooks.workbooks_of(x, rows=300).write.parquet(path)
    x = tickets.tasks_from_dataframe(workbooks.rows_of(spark.read.parquet(path)))
    return x.select("issue_id", "summary", F.length("description").alias("n"), F.md5("description").alias("mark"), F.unix_micros("created_at").alias("created"), F.unix_micros("updated_at").alias("updated"), "cluster_label")


def q74_session_state(spark, sf_dir):
    """All conversations as a stream of three batches, turns out of order, kept as state by session."""
    root = fresh_folder(spark, "chats")
    c = table(spark, sf_dir, "conversations")
    for n in range(3):
        c.where((F.col("turn") * 2 + F.col("conv_id")) % 3 == n).write.mode("append").parquet(f"{root}/in/{n}")
        stream = spark.readStream.schema(c.schema).parquet(f"{root}/in/*")
        chat_state.start_sessions(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    x = chat_state.latest(spark, f"{root}/out")
    return x.select(F.col("session").cast("long").alias("conv_id"), "turns", "user_turns", "last_turn", "transcript")


def _ticket_versions(spark, sf_dir):
    return tasks(spark, sf_dir).withColumn("seq", F.lit(0)).unionByName(changed(spark, sf_dir).withColumn("seq", F.lit(1))).select("issue_id", "updated_at", "seq", F.length("description").alias("n"))


def q75_state_as_of(spark, sf_dir):
    """Which version of each ticket held a second after, a minute before and a day before it was first written."""
    t = tasks(spark, sf_dir).select("issue_id", F.explode(F.array(F.expr("INTERVAL 1 SECOND"), F.expr("INTERVAL -1 MINUTE"), F.expr("INTERVAL -1 DAY"))).alias("d"), "updated_at").select("issue_id", (F.col("updated_at") + F.col("d")).alias("moment"))
    x = history.as_of(t, _ticket_versions(spark, sf_dir), "issue_id", "updated_at", "seq")
    return x.select("issue_id", F.unix_micros("moment").alias("moment"), F.col("version.seq").alias("seq"), F.col("version.n").alias("n"))


def q76_intervals(spark, sf_dir):
    """From when to when each version of the tickets held."""
    x = history.intervals(_ticket_versions(spark, sf_dir), "issue_id", "updated_at", "seq")
    return x.select("issue_id", "seq", "n", F.unix_micros("valid_from").alias("since"), F.unix_micros("valid_to").alias("until"))


def q77_json_entries(spark, sf_dir):
    """Events as documents of one object by event id for each user, and back to rows by the table function."""
    tables.register(spark)
    e = table(spark, sf_dir, "events")
    entry = F.struct(F.col("event_id").cast("string").alias("k"), F.struct("event_type", "value", "props").alias("v"))
    d = e.groupBy("user_id", (F.col("event_id") % 16).alias("part")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # a sixteenth of a user's events
    name = "events_" + fresh_folder(spark, "v").rpartition("-")[2]
    d.select("user_id", F.to_json(F.struct(F.struct("m").alias("by"))).alias("doc")).createOrReplaceTempView(name)
    return spark.sql(f"SELECT user_id, t.event_id, t.event_type, round(t.value, 6) AS value, t.props FROM {name}, LATERAL json_entries(doc, 'by.m', '{tables.schema_json('event_id long, event_type string, value double, props string')}') t")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "q" and k[1:3].isdigit()}

_VERSIONS = f"{_CHANGED}, w AS (SELECT issue_id, updated_at, 0 AS seq, length(description)::INT AS n FROM t UNION ALL SELECT issue_id, updated_at, 1, length(description)::INT FROM n), z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY issue_id, updated_at ORDER BY seq DESC) = 1)"
ORACLE_SQL = {
    "q75_state_as_of": f"WITH {_VERSIONS}, m AS (SELECT issue_id, updated_at + unnest([INTERVAL 1 SECOND, INTERVAL '-1 minute', INTERVAL '-1 day']) AS moment FROM t) SELECT m.issue_id, epoch_us(moment) AS moment, seq, z.n FROM m ASOF LEFT JOIN z ON m.issue_id = z.issue_id AND m.moment >= z.updated_at",
    "q76_intervals": f"WITH {_VERSIONS} SELECT issue_id, seq, n, epoch_us(updated_at) AS since, epoch_us(lead(updated_at) OVER (PARTITION BY issue_id ORDER BY updated_at)) AS until FROM z",
    "q69_index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "q70_index_exact": _BASE["q15_cosine_topk"],
    "q77_json_entries": "SELECT user_id, event_id, event_type, round(value, 6) AS value, props FROM events",
    "q74_session_state": _BASE["q23_session_rollup"],
    "q73_workbooks": _MORE["q41_csv_round_trip"],
    "q72_ticket_search": r"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[2:5] AS w FROM benchmark),
 n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), tok AS (SELECT id, len(w) AS words, unnest(w) AS term FROM d), tf AS (SELECT id, term, any_value(words) AS words, count(*) AS tf FROM tok GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 qt AS (SELECT query_id, unnest(list_distinct(w)) AS term FROM q),
 s AS (SELECT query_id, id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, id),
 b AS (SELECT DISTINCT id, w[i] AS a, w[i + 1] AS z FROM d, unnest(range(1, len(w))) u(i)), f AS (SELECT s.* FROM s JOIN q USING (query_id) WHERE query_id % 2 = 0 OR EXISTS (SELECT 1 FROM b WHERE b.id = s.id AND b.a = q.w[1] AND b.z = q.w[2]))
 SELECT query_id, id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id))::INT AS rank FROM f QUALIFY rank <= 10""",
    "q71_linkage_levels": f"""WITH RECURSIVE e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings), p AS MATERIALIZED (SELECT a.i AS a, b.i AS b, list_distance(a.v, b.v) AS d FROM e a, e b), c AS (SELECT a AS i, list_sort(list(d))[5] AS core FROM p GROUP BY a),
 m AS MATERIALIZED (SELECT a, b, greatest(d, x.core, y.core) AS w FROM p JOIN c x ON x.i = a JOIN c y ON y.i = b WHERE a <> b), t AS (SELECT unnest({list(LEVELS)}::DOUBLE[]) AS t),
 r AS (SELECT t, i AS a, i AS b FROM e, t UNION SELECT r.t, r.a, m.b FROM r JOIN m ON r.b = m.a AND m.w <= r.t), k AS (SELECT t, root, count(*) AS n FROM (SELECT t, a, min(b) AS root FROM r GROUP BY t, a) GROUP BY t, root)
 SELECT t AS distance, count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS alone FROM k GROUP BY t""",
}
