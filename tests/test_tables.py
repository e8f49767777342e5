"""The JSON table function from SQL."""

import pytest

from ticketloom.functions import tables

DOCS = [
    (1, '{"details": {"0": {"size": 3, "ok": true, "tags": ["a", null, 5], "in": {"x": 1.5, "y": "7"}}, "7": {"size": "4"}, "x": null}}'), (2, '{"details": {}}'), (3, "broken {"), (4, None), (5, '{"other": 1}'),
    (6, '{"details": [1, {"size": 3000000000}, {"size": 2.0}, {"size": 2.5}, {"size": true}, {"size": -1}]}'), (7, "[1]"), (8, '{"details": {"é": {"size": 1}, "é": {"size": 2}}}'),
]


def test_any_schema(spark):
    tables.register(spark)
    spark.createDataFrame(DOCS, "i int, d string").repartition(3).createOrReplaceTempView("json_docs")
    q = lambda schema, path="details": sorted(map(tuple, spark.sql(f"SELECT i, t.* FROM json_docs, LATERAL json_entries(d, '{path}', '{tables.schema_json(schema)}') t").collect()), key=repr)
    assert q("id int, size int") == sorted([(1, 0, 3), (1, 7, 4), (1, None, None), (6, 0, None), (6, 1, None), (6, 2, 2), (6, 3, None), (6, 4, None), (6, 5, -1), (8, None, 2)], key=repr)
    rich = spark.sql(f"SELECT t.* FROM json_docs, LATERAL json_entries(d, 'details', '{tables.schema_json('id string, ok boolean, tags array<string>, in struct<x: double, y: long, z: int>, entry string')}') t WHERE i = 1 AND id = '0'").first()
    assert rich.ok is True and rich.tags == ["a", None, "5"] and tuple(rich["in"]) == (1.5, 7, None) and rich.entry.startswith('{"size": 3')
    assert [r[1:] for r in q("id string, size long", "details") if r[0] == 6][1] == ("1", 3000000000)
    assert q("name string, entry string", "") and q("x int", "details.0.in.x") == []
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT * FROM json_docs, LATERAL json_entries(d, 'details', d)").collect()


def test_json_array_of_many_rows(spark, tmp_path, monkeypatch):
    """More rows than one file takes: a folder of arrays, whose rows don't go through the driver, with every row in it."""
    import json

    from pyspark.sql import DataFrame, functions as F

    from ticketloom.sources import sinks, tickets

    x = spark.range(250, numPartitions=3).select(F.format_string("T-%04d", "id").alias("issue_id"), F.lit('a "b"\nc').alias("summary"))
    path = str(tmp_path / "a.json")
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a: pytest.fail("rows go through the driver"))
    sinks.write_json_array(x, path, rows=40)
    files = [json.loads(p.read_text()) for p in (tmp_path / "a.json").glob("part-*")]
    assert sum(map(len, files)) == 250 and max(map(len, files)) == 40
    again = tickets.read_processed(spark, path)
    assert again.where("summary = 'a \"b\"\nc'").select("issue_id").distinct().count() == 250 == again.count()
    sinks.write_json_array(x.limit(40), path, rows=40)  # the folder is replaced by one file
    assert len(json.loads((tmp_path / "a.json").read_text())) == 40 and tickets.read_processed(spark, path).count() == 40
