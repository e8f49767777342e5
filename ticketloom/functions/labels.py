"""Keyword labels: a dictionary of label -> keywords, description.

A dictionary of configuration, of a size that is checked (`MAX_KEYWORDS`), goes into the plan as literals; one kept as a table goes
to the tasks as an automaton. Neither shuffles texts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_KEYWORDS = 20_000


def load_dictionary(path: str | None = None) -> dict:
    """label -> {keywords, description}; without a path the packaged dictionary of fixed values."""
    text = open(path, encoding="utf-8").read() if path else resources.files("ticketloom.plans").joinpath("cluster_labels.json").read_text(encoding="utf-8")
    got = json.loads(text)["cluster_labels"]
    if sum(len(v["keywords"]) for v in got.values()) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords: use label_join")
    return got


def load_json_config(path: str) -> dict | None:
    """As json.load; None if the file is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def dictionary_table(spark: SparkSession, labels: dict) -> DataFrame:
    rows = [(label, i, k, j, v.get("description")) for i, (label, v) in enumerate(labels.items()) for j, k in enumerate(v["keywords"])]
    return spark.createDataFrame(rows, "label string, label_ord int, keyword string, keyword_ord int, description string")


def matching_labels(text: Column, labels: dict) -> Column:
    """All labels with a keyword in the text, in dictionary order; null if there is none or no text."""
    low = F.lower(text)
    hits = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in v["keywords"]], F.lit(False)), F.lit(label)) for label, v in labels.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when((F.length(text) > 0) & (F.size(found) > 0), found)


def keyword_label(text: Column, labels: dict) -> Column:
    """The first matching label in dictionary order."""
    return F.get(matching_labels(text, labels), F.lit(0))


def labelling_text(summary: Column, description: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(description, F.lit("")))


#: Bytes of keywords and labels that go to every task at once.
SHARD_BYTES = 32 << 20
_AUTOMATA: dict[str, object] = {}


def _automaton(key: str, words: dict[str, tuple[int, ...]]):
    """The worker's automaton of a dictionary, built once; the last few are kept."""
    if key not in _AUTOMATA:
        import ahocorasick

        while len(_AUTOMATA) > 3:
            _AUTOMATA.pop(next(iter(_AUTOMATA)))
        made = ahocorasick.Automaton()
        for word, numbers in words.items():
            made.add_word(word, numbers)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _matcher(key: str, words, names: pa.Table, id_name: str):
    def run(batches):
        found = _automaton(key, words.value)
        for b in batches:
            row, label = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                hits = {n for _, numbers in found.iter(text) for n in numbers}
                row += [i] * len(hits)
                label += sorted(hits)
            own = names.take(pa.array(label, pa.int64())).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
            yield pa.record_batch([b.column(0).take(pa.array(row, pa.int64())), *columns], [id_name, "label", "label_ord"])

    return run


def label_join(docs: DataFrame, table: DataFrame, text_col: str, id_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, label, label_ord): as matching_labels, for dictionaries kept as a table, a row for each row of docs and label.

    All keywords are looked for at once by an Aho-Corasick automaton, which each worker builds from the keywords; a pass reads the texts and
    shuffles nothing. A dictionary of more than `shard_bytes` is dealt into shards by label, each of them a pass of its own.
    """
    spark = docs.sparkSession
    t = docs.select(id_col, F.lower(text_col).alias("_t")).where(F.length("_t") > 0)
    k = table.select(F.lower("keyword").alias("k"), "label", F.col("label_ord").cast("int").alias("label_ord")).where(F.length("k") > 0).distinct()
    size = k.agg(F.sum(F.octet_length("k") + F.octet_length("label") + 16)).first()[0] or 0
    shards, schema = max(1, -(-size // shard_bytes)), f"`{id_col}` {dict(t.dtypes)[id_col]}, label string, label_ord int"
    out = None
    for s in range(shards):
        part = k.where(F.pmod(F.xxhash64("label", "label_ord"), F.lit(shards)) == s).toArrow()  # about shard_bytes
        names = part.select(["label", "label_ord"]).group_by(["label", "label_ord"]).aggregate([]).sort_by("label_ord")
        number = {(x["label"], x["label_ord"]): i for i, x in enumerate(names.to_pylist())}
        words: dict[str, tuple[int, ...]] = {}
        for x in part.to_pylist():
            words[x["k"]] = (*words.get(x["k"], ()), number[x["label"], x["label_ord"]])
        if words:
            got = t.mapInArrow(_matcher(uuid.uuid4().hex, spark.sparkContext.broadcast(words), names, id_col), schema)
            out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def inverted_index(table: DataFrame) -> DataFrame:
    """keyword -> labels in dictionary order."""
    g = table.groupBy(F.lower("keyword").alias("keyword")).agg(F.array_sort(F.collect_set(F.struct("label_ord", "label"))).alias("_l"))
    return g.select("keyword", F.transform("_l", lambda x: x["label"]).alias("labels"))


def all_labels(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.min("label_ord").alias("label_ord"), F.first("description").alias("description")).orderBy("label_ord")


def describe(df: DataFrame, table: DataFrame, label_col: str = "label") -> DataFrame:
    """df with description; unknown labels get null."""
    d = all_labels(table).select(F.col("label").alias("_label"), "description")
    return df.join(d, df[label_col] == d["_label"], "left").drop("_label")
