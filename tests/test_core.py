"""Text, preparation, incremental updates, labels, intents, configuration, sources and sinks."""

import json
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.functions import intents, labels, text, vectors
from ticketloom.operators import incremental, prepare, reports
from ticketloom.plans import config
from ticketloom.plans.chat import Agent, extract_parameter, recognize_intent
from ticketloom.plans.cli import health, main
from ticketloom.plans.executor import as_column, batch_process, map_parallel, submit_batch
from ticketloom.plans.pipeline import review
from ticketloom.sources import sinks, tickets


def slow_clean(t, n=500):
    if t is None or not str(t).strip():
        return ""
    t = re.sub(r"```.*?```", "", str(t), flags=re.S)
    t = re.sub(r"`[^`]*`", "", t)
    for p in (r"(ERROR|WARN|DEBUG|INFO|TRACE).*", r"\tat\s+[\w\.$]+\(.*?\)", r"Exception in thread.*", r"\[.*?\].*"):
        t = re.sub(p, "", t)
    t = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", t)).strip()
    return t[:n] + "..." if len(t) > n else t


STRINGS = [
    None, "", "  \t ", "plain  text", "a `b\nc` d", "x ```code\nmore``` y", "open ``` fence `pair` z", "INFORMATION is lost\nnext", "mid ERROR line\nkept", "see [link] gone\nkept [open", "\tat com.foo.Bar$1(Baz.java:3)\nok",
    "\tat 类.方法(源.java)\nok", "Exception in thread main\nok", "<p>tag\nspan <b\nc>x</b>", "a\r\nb\rc", "a\x85b c", "　wide space\x1c", "😀" * 501, "q" * 600, "WARN same line", "ab\x1dcd",
]


def test_cleaning(spark):
    random.seed(1)
    parts = ["`", "```", "ERROR", "\tat a.b(c)", "[x]", "<b>", "\n", " ", "word", "　", "\r", "é"]
    rows = STRINGS + ["".join(random.choices(parts, k=random.randint(1, 20))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.clean_description(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.c == slow_clean(rows[r.i]), repr(rows[r.i])
    assert spark.range(1).select(text.clean_description(F.lit(12345))).first()[0] == "12345"
    ext = spark.createDataFrame([("a " + "QUJD" * 20 + " b\nTraceback (most recent call last):\n  File x\nValueError: no\nend",)], "t string")
    assert ext.select(text.clean_description(F.col("t"), extended=True)).first()[0] == "a b end"


def test_text_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.feature_text(F.lit("s"), F.lit("c"))) == "s | c" and one(text.feature_text(F.lit(""), F.lit("c"))) == "c" and one(text.feature_text(F.lit("s"), F.lit(""))) == "s"
    a = one(text.content_fingerprint(F.lit("s"), F.lit("d"), F.lit(None).cast("string")))
    assert len(a) == 16 and a == one(text.content_fingerprint(F.lit("s"), F.lit("d"), F.lit(""))) and a != one(text.content_fingerprint(F.lit("s"), F.lit("d"), F.lit("x")))
    j = lambda x, y: one(text.character_jaccard(F.lit(x), F.lit(y)))
    assert abs(j("Hello World", "Hello Universe") - 6 / 13) < 1e-12 and j("", "") == 1 and j("a", "") == 0 and j("😀a", "A") == 0.5
    assert one(text.clip(F.lit("x" * 101), 100)) == "x" * 100 + "..." and one(text.truncate(F.lit("abc"), 2)) == "ab"


RAW = [
    ("1", " first ", "d", "2024-01-01T00:00:00Z", None, " lab ", "open"), (None, "no id", "d", None, None, None, "x"), ("3", None, "d", None, None, None, "x"), ("4", "  ", None, None, None, "", "x"),
    ("5", "bad date", "d", "not a date", None, None, "x"), ("006", "zeros", "d", "2024-05-01 10:00:00.5+02:00", "2024-05-02", "NA", "x"), ("7", "bad update", "d", None, "never", None, "x"),
]


def test_decode(spark):
    raw = spark.createDataFrame(RAW, "issue_id string, summary string, description string, created_at string, updated_at string, cluster_label string, status string")
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    got = {r.issue_id: r for r in tickets.tasks_from_dataframe(raw, as_of).collect()}
    assert set(got) == {"1", "4", "006"}
    assert got["1"].summary == "first" and got["1"].cluster_label == "lab" and got["1"].updated_at == got["1"].created_at == datetime(2024, 1, 1)
    assert got["4"].summary == "" and got["4"].description == "" and got["4"].created_at == datetime(2030, 1, 1) and got["4"].cluster_label is None
    assert got["006"].created_at == datetime(2024, 5, 1, 8, 0, 0, 500000) and got["006"].cluster_label is None
    assert prepare.decode_tasks(raw.select("summary")).count() == 0
    few = prepare.decode_tasks(raw.where("issue_id = '1'").select("issue_id", "summary"), as_of).first()
    assert few.description == "" and few.created_at == datetime(2030, 1, 1)
    nan = prepare.decode_tasks(raw.where("issue_id = '7'").drop("updated_at"), as_of, compat_nan_label=True).first()
    assert nan.cluster_label == "nan"
    p = prepare.preprocess_tasks(tickets.tasks_from_dataframe(raw, as_of), as_of=as_of)
    assert p.first().cleaned_description == "d" and p.first().embedding is None


def test_files(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text('issue_id,summary,description,created_at,extra\nA-1,"say ""hi""","two\nlines",2024-01-01T00:00:00Z,1\nA-2,null,x,,2\nA-3,ok,nan,,3\n', encoding="utf-8")
    got = {r.issue_id: r for r in tickets.load_tickets(spark, str(csv)).collect()}
    assert set(got) == {"A-1", "A-3"} and got["A-1"].summary == 'say "hi"' and got["A-1"].description == "two\nlines" and got["A-3"].description == ""
    for bad in ("x.txt", "x.CSV", "x.json"):
        with pytest.raises(ValueError, match="Unsupported file format"):
            tickets.load_tickets(spark, bad)
    p = prepare.preprocess_tasks(tickets.load_tickets(spark, str(csv)))
    for path in (str(tmp_path / "out"), str(tmp_path / "out.parquet")):
        sinks.write_tasks(p, path)
        assert sorted(r.issue_id for r in tickets.read_processed(spark, path).collect()) == ["A-1", "A-3"]
    sinks.write_json_array(p, str(tmp_path / "a.json"))
    assert len(json.loads((tmp_path / "a.json").read_text())) == 2
    again = tickets.read_processed(spark, str(tmp_path / "a.json"))
    assert {(r.issue_id, r.cleaned_description) for r in again.collect()} == {(r.issue_id, r.cleaned_description) for r in p.collect()}
    (tmp_path / "i.json").write_text('{"issues": [{"issue_id": "I-1", "summary": "s"}, {"issue_id": "I-2"}]}')
    assert [r.issue_id for r in tickets.read_issues(spark, str(tmp_path / "i.json")).collect()] == ["I-1"]
    lenient = tickets.lenient_tasks(spark.createDataFrame([("only this", 0), (None, 1)], "summary string, ord int")).orderBy("issue_id").collect()
    assert [(r.issue_id, r.summary, r.status) for r in lenient] == [("TASK-001", "only this", "To Do"), ("TASK-002", "No summary", "To Do")]


T = "issue_id string, summary string, description string, cleaned_description string, created_at timestamp, updated_at timestamp, cluster_label string, cluster_id int, cluster_confidence double, ord int"


def row(i, s="a summary of it", d="text x", at=0.0, label=None, cid=None, ord=0):
    t = datetime(2024, 1, 1, 0, 0, int(at), int(at % 1 * 1e6))
    return (i, s, d, d, t, t, label, cid, None if cid is None else 0.9, ord)


def test_incremental(spark):
    old = spark.createDataFrame([row("A", cid=3), row("B", cid=4), row("C", at=5), row("D", label=None), row("E", cid=None)], T)
    new = spark.createDataFrame([
        row("A", d="text tex", at=0), row("B", d="entirely different words 123", s="zzz qqq", at=0), row("C", at=5.5), row("C", at=6.0), row("C", at=7.5), row("C", at=1, d="older but edited"), row("D", label=""), row("N"), row("N", ord=1, s="later"), row("E", at=9),
    ], T)
    x = incremental.categorize(new, old)
    got = [(r.new.issue_id, r.new.updated_at.second + r.new.updated_at.microsecond / 1e6, r.category) for r in x.collect()]
    assert sorted(got) == sorted([("A", 0, "updated"), ("B", 0, "updated"), ("C", 5.5, "unchanged"), ("C", 6.0, "unchanged"), ("C", 7.5, "updated"), ("C", 1, "updated"), ("D", 0, "unchanged"), ("N", 0, "new"), ("N", 0, "new"), ("E", 9, "updated")])
    s = incremental.statistics(x, old).first()
    assert (s.total_comparisons, s.new_tasks, s.updated_tasks, s.unchanged_tasks, s.total_existing) == (10, 2, 5, 3, 5)
    delta = incremental.merge_delta(x)
    ids = {(r.issue_id, r.category): r for r in delta.collect()}
    assert delta.count() == 7 and ids["A", "updated"].cluster_id == 3 and ids["A", "updated"].cluster_confidence == 0.9
    assert ids["B", "updated"].cluster_id is None and ids["E", "updated"].cluster_id is None
    snap = {r.issue_id: r for r in incremental.upsert(old, delta, "ord").collect()}
    assert set(snap) == set("ABCDEN") and snap["N"].summary == "later"


def test_labels(spark):
    d = labels.load_dictionary()
    assert len(d) == 22 and sum(len(v["keywords"]) for v in d.values()) == 106
    x = spark.createDataFrame([(1, "MySQL connection"), (2, ""), (3, None), (4, "nothing here"), (5, "docker and k8s")], "i int, t string")
    got = {r.i: r for r in x.select("i", labels.keyword_label(F.col("t"), d).alias("l"), labels.matching_labels(F.col("t"), d).alias("m")).collect()}
    names = list(d)
    assert got[1].l == names[0] and got[2].l is got[3].l is got[4].l is None and len(got[5].m) >= 3 and got[5].l == got[5].m[0]
    table = labels.dictionary_table(spark, d)
    index = {r.keyword: r.labels for r in labels.inverted_index(table).collect()}
    assert len(index) == 96 and sum(len(v) > 1 for v in index.values()) == 10
    assert [r.label for r in labels.all_labels(table).collect()] == names
    unknown = labels.describe(spark.createDataFrame([(names[0],), ("nope",)], "label string"), table).collect()
    assert {r.label: r.description for r in unknown} == {names[0]: d[names[0]]["description"], "nope": None}
    assert {r.i for r in labels.label_join(x, table, "t", "i").collect()} == {1, 5}
    assert labels.load_json_config("/nowhere.json") is None


def test_intents_agree(spark):
    said = ["请帮我导入数据", "load my DATA", "聚类分析一下", "show me results", "调整一下参数", "help", "怎么用", "什么", "cluster the analysis", "分析这些任务", ""]
    got = [r[0] for r in spark.createDataFrame([(i, m) for i, m in enumerate(said)], "i int, m string").orderBy("i").select(intents.intent(F.col("m"))).collect()]
    assert got == [recognize_intent(m) for m in said] and got[0] == "data_import" and got[7] == "unknown"
    m = ["最小聚类大小设为15", "min cluster size 20", "epsilon设为0.3", "EPSILON 1.", "none", "把25作为最小"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(m)], "i int, m string").orderBy("i").select(intents.parameter(F.col("m"), "min_size", 10).alias("a"), intents.parameter(F.col("m"), "epsilon").alias("b")).collect()
    assert [r.a for r in rows] == [extract_parameter(x, "min_size", 10) for x in m] and [r.b for r in rows] == [extract_parameter(x, "epsilon") for x in m]


def test_config(monkeypatch):
    assert [config.suggest_parameters(n).min_cluster_size for n in (19, 20, 99, 100, 499, 500, 1000, 5049, 5050, 10**6)] == [15, 10, 10, 5, 5, 10, 20, 100, 100, 100]
    for bad in ({"min_cluster_size": 1}, {"cluster_selection_epsilon": 3.0}, {"max_clusters": 51}, {"algorithm": "dbscan"}):
        with pytest.raises(ValueError):
            config.ClusteringParameters(**bad)
    with pytest.raises(ValueError):
        config.preset("none")
    v = config.validate(config.ClusteringParameters(algorithm="kmeans", max_clusters=2, cluster_selection_epsilon=1.5), rows=10)
    assert not v["valid"] and len(v["issues"]) == 2 and len(v["suggestions"]) == 3
    monkeypatch.setenv("MIN_CLUSTER_SIZE", "7")
    assert config.from_env().min_cluster_size == 7
    assert config.batch_size(None) == config.batch_size(100) == config.batch_size(600) == 64 and config.batch_size(600, "bge-m3", 10**6) == 16384


def test_reports(spark):
    rows = [(f"T{i}", "s" * (101 if i == 0 else 3), i, i % 3 if i % 4 else None, 0.5 if i % 4 else None) for i in range(40)]
    x = spark.createDataFrame(rows, "issue_id string, summary string, ord int, cluster_id int, cluster_confidence double")
    r = reports.cluster_report(x, "ord")
    got = r.collect()
    assert [g["size"] for g in got] == [10, 10, 10, 10] and sum(g.is_noise for g in got) == 1
    assert [s.issue_id for s in next(g for g in got if g.cluster_id == 1).sample_tasks] == ["T1", "T7", "T10"]
    assert next(g for g in got if g.is_noise).sample_tasks is None
    t = reports.totals(x).first()
    assert (t.total_tasks, t.clusters_found) == (40, 3) and reports.totals(x, 9).first().clusters_found == 9
    assert "cluster 0: 10 tasks (confidence 0.50)" in reports.summary_text(r, 40, 3, 1.0)
    assert "mean confidence 0.500" in reports.detailed_text(r, 40, 3, 1.0, "now")
    assert {c.samples for c in reports.console_rows(r).collect()} >= {"sss, sss"}
    none = x.where("cluster_id is not null")
    assert not reports.cluster_report(none, "ord").where("is_noise").count()


def test_result_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("T1", "one", 1, 0, 0.5), ("T2", "two", 2, None, None)], "issue_id string, summary string, ord int, cluster_id int, cluster_confidence double")
    report = reports.cluster_report(x, "ord")
    doc = sinks.result_document(report, reports.totals(x), 1.5)
    sinks.write_result(doc, str(tmp_path / "r.json"))
    back = tickets.read_result(spark, str(tmp_path / "r.json"))
    assert back.first().total_tasks == 2
    assert {(r.cluster_id, r["size"], r.is_noise) for r in tickets.result_rows(back).collect()} == {(0, 1, False), (-1, 1, True)}
    assert main(["export", "-i", str(tmp_path / "r.json"), "-o", str(tmp_path / "csv"), "-f", "CSV"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "d.csv").write_text("summary,description\none,\"text, of\ntwo lines\"\n,second\n" + "x,y\n" * 20)
    assert main(["demo", "-i", str(tmp_path / "d.csv"), "-o", str(tmp_path / "demo")]) == 0
    demo = {r.issue_id: r for r in spark.read.json(str(tmp_path / "demo")).collect()}
    assert len(demo) == 10 and demo["TASK-001"].description == "text, of\ntwo lines" and demo["TASK-002"].summary == "No summary"
    assert main(["export", "-i", str(tmp_path / "r.json"), "-o", str(tmp_path / "x"), "-f", "pdf"]) == 1 and main(["export", "-i", str(tmp_path / "no.json"), "-o", "x"]) == 1
    with pytest.raises(ValueError):
        sinks.export(doc, report, str(tmp_path / "y"), "xml")


def test_vectors(spark):
    x = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 1.0])], "a array<float>, z array<float>, o array<float>")
    r = x.select(vectors.norm(F.col("a")).alias("n"), vectors.euclidean(F.col("a"), F.col("z")).alias("d"), vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.cosine(F.col("a"), F.col("a")).alias("one"), vectors.population_std(F.col("o")).alias("s"), vectors.kmeans_confidence(F.col("a"), F.col("a")).alias("k"), vectors.kmeans_confidence(F.lit(None).cast("array<float>"), F.col("a")).alias("h")).first()
    assert (r.n, r.d, r.c, r.s, r.k, r.h) == (5.0, 5.0, None, 1.0, 1.0, 0.5) and abs(r.one - 1) < 1e-12


def test_executor(spark):
    out = submit_batch(spark, lambda a, b: a // b, [(6, 2), (1, 0), (9, 3)])
    assert out[0] == 3 and isinstance(out[1], ZeroDivisionError) and out[2] == 3
    assert map_parallel(spark, lambda x: x * x, range(20)) == [x * x for x in range(20)] and submit_batch(spark, len, []) == []
    with pytest.raises(ZeroDivisionError):
        map_parallel(spark, lambda x: 1 // x, [1, 0])
    assert batch_process(spark, lambda xs: [x + 1 for x in xs], list(range(25)), 10) == list(range(1, 26))
    plus = as_column("long")(lambda v: v + 1)
    assert [r[0] for r in spark.range(3).select(plus(F.col("id"))).collect()] == [1, 2, 3]


def test_review_and_chat(spark, tmp_path):
    t = spark.createDataFrame([("A", "old", "new"), ("B", "old", "new"), ("C", "old", "new"), ("D", "old", "new")], "issue_id string, cluster_label string, proposed_label string")
    d = spark.createDataFrame([("A", "accept", None), ("B", "keep", None), ("C", "hybrid", "mine")], "issue_id string, decision string, reviewer_label string")
    assert {(r.issue_id, r.final_label, r.decision) for r in review(t, d).collect()} == {("A", "new", "accept"), ("B", "old", "keep"), ("C", "mine", "hybrid"), ("D", None, "pending")}
    agent = Agent(spark)
    s = agent.create_session()
    assert agent.process_message(s, "上传文件").action_required == "file_upload"
    assert "first" in agent.process_message(s, "聚类分析").message
    topics = ["database mysql connection pool exhausted", "certificate ssl expired renew", "deploy docker image release"]
    lines = ["issue_id,summary,description"] + [f"T-{i},{topics[i % 3]},{topics[i % 3]} number {i}" for i in range(30)]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    agent.sessions[s].context.update(file_uploaded=True, uploaded_file_path=str(tmp_path / "f.csv"))
    assert "30" in agent.process_message(s, "导入数据文件").message
    assert agent.process_message(s, "change the parameters min size 5").parameters == {"min_cluster_size": 5}
    assert "3 clusters" in agent.process_message(s, "cluster analysis").message
    assert agent.process_message(s, "show results").action_required == "export_options"
    assert "help" in agent.process_message(s, "blah").message and len(agent.sessions[s].messages) == 14
    agent.cleanup_session(s)
    assert s not in agent.sessions and set(health()) >= {"pyspark", "data_directory"}
