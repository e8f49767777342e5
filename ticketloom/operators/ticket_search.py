"""Search in tickets: positional postings by term, ranked by BM25, with exact phrases.

The index is three Parquet tables at a path: postings bucketed and sorted by slot and term, terms with their document counts,
and totals. A row of postings has a term's tickets of one batch of texts: ids, words of each, and all positions in one list with
where each ticket's start, so that neither term nor list weighs on every ticket. A term's rows lie in as many slots as its
postings fill, so a word of every third text
isn't one bucket's own. A search with few terms names them and their slots in the scan's filters, by which buckets
and row groups are skipped; only matches of the queries' terms are shuffled, as a query, an id and a number each, and with
positions only where a phrase asks for them.

A query is words and "phrases in quotes". A ticket must hold every phrase, word for word; its score sums over all distinct
words of the query. Words are runs of letters and digits, lower-cased. Null and empty texts and queries match nothing;
repeated ids are separate tickets of equal name and are found as one, with the counts of both.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[\p{L}\p{N}]+"
#: Distinct query words up to which they are named in the scan, and up to which matches are looked up by broadcast.
NAMED, BROADCAST = 500, 50_000


@dataclass(frozen=True)
class SearchConfig:
    k1: float = 1.2
    b: float = 0.75
    #: Postings that a slot of a term holds, about, and slots of the table.
    slot_postings: int = 500_000
    slots: int = 256


@dataclass(frozen=True)
class TicketIndex:
    postings: DataFrame
    terms: DataFrame
    tickets: int
    mean_words: float
    config: SearchConfig


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _postings(batches):
    """(term, ids, words, starts, positions) of batches (id, tokens): each term of a batch once, starts with the end of the last."""
    for b in batches:
        lists = b.column(1)
        tokens = lists.flatten()
        if not len(tokens):
            continue
        n = np.diff(lists.offsets.to_numpy())
        coded = tokens.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # by ticket and place within a term
        code, doc = code[order], np.repeat(np.arange(len(n)), n)[order]
        at = order - (np.cumsum(n) - n)[doc]
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
        own, term = doc[first], code[first]
        group = np.flatnonzero(np.append(True, term[1:] != term[:-1]))  # a term's first ticket
        upto = np.append(group, len(first))
        base = np.append(first[group], len(order))
        starts = np.insert(first, upto[1:], base[1:]) - np.repeat(base[:-1], np.diff(upto) + 1)
        listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.record_batch(
            [coded.dictionary.take(pa.array(term[group])), listed(upto, b.column(0).take(pa.array(own))), listed(upto, pa.array(n[own], pa.int32())), listed(upto + np.arange(len(upto)), pa.array(starts, pa.int32())), listed(base, pa.array(at, pa.int32()))],
            ["term", "ids", "words", "starts", "positions"],
        )


def _slot(term: Column, part: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term, part), F.lit(slots)).cast("int")


def build(tickets: DataFrame, path: str, cfg: SearchConfig = SearchConfig(), id_col: str = "issue_id", text_col: str = "description") -> TicketIndex:
    """Index all tickets in the folder `path`, which is new."""
    spark, path = tickets.sparkSession, path.rstrip("/")
    x = tickets.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("tokens"))
    kind = x.schema["id"].dataType.simpleString()
    raw = x.where(F.size("tokens") > 0).mapInArrow(_postings, f"term string, ids array<{kind}>, words array<int>, starts array<int>, positions array<int>")
    raw.write.parquet(f"{path}/raw")
    raw = spark.read.schema(raw.schema).parquet(f"{path}/raw")
    terms = raw.groupBy("term").agg(F.sum(F.size("ids")).alias("tickets"))
    terms.withColumn("parts", F.ceil(F.col("tickets") / cfg.slot_postings).cast("int")).write.parquet(f"{path}/terms")
    x.agg(F.count(F.lit(1)).alias("tickets"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean_words")).write.parquet(f"{path}/totals")
    wide = spark.read.parquet(f"{path}/terms").where("parts > 1").select("term", "parts")  # no more of them than postings fill slots
    part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.coalesce("parts", F.lit(1))).cast("int")  # rows of a term, whole
    placed = raw.join(F.broadcast(wide), "term", "left").select(_slot(F.col("term"), part, cfg.slots).alias("slot"), *raw.columns)
    name = f"search_{uuid.uuid4().hex}"
    placed.repartition(cfg.slots, "slot").write.bucketBy(cfg.slots, "slot").sortBy("slot", "term").option("path", f"{path}/postings").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return open_index(spark, path, cfg, kind)


def open_index(spark: SparkSession, path: str, cfg: SearchConfig = SearchConfig(), kind: str = "string") -> TicketIndex:
    path, name = path.rstrip("/"), f"search_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (slot INT, term STRING, ids ARRAY<{kind}>, words ARRAY<INT>, starts ARRAY<INT>, positions ARRAY<INT>) USING parquet CLUSTERED BY (slot) SORTED BY (slot, term) INTO {cfg.slots} BUCKETS LOCATION '{path}/postings'")
    t = spark.read.parquet(f"{path}/totals").first()
    return TicketIndex(spark.table(name), spark.read.parquet(f"{path}/terms"), t.tickets, t.mean_words, cfg)


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, term, phrases: in which phrases and where the term stands, needed: how many phrases the query has), a row for each
    distinct word of a query (query_id, query)."""
    phrases = F.filter(F.transform(F.regexp_extract_all("query", F.lit('"([^"]*)"'), F.lit(1)), lambda p: words(p)), lambda p: F.size(p) > 0)
    x = queries.select("query_id", words(F.col("query")).alias("every"), F.coalesce(phrases, F.array().cast("array<array<string>>")).alias("phrases"))
    places = F.flatten(F.transform("phrases", lambda p, i: F.transform(p, lambda w, j: F.named_struct(F.lit("word"), w, F.lit("phrase"), i, F.lit("place"), j))))
    x = x.select("query_id", F.explode(F.array_distinct("every")).alias("term"), places.alias("p"), F.size("phrases").alias("needed"), F.transform("phrases", lambda p: F.size(p)).alias("lengths"))
    return x.select("query_id", "term", F.filter("p", lambda s: s["word"] == F.col("term")).alias("places"), "needed", "lengths")


def search(index: TicketIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the k best tickets of each query (query_id, query). Scores are rounded to 6 digits, ties go to the
    lower id."""
    cfg = index.config
    asked = parsed(queries).join(index.terms, "term")
    slots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: _slot(F.col("term"), p, cfg.slots)))
    few = asked.select("term", F.explode(slots).alias("slot")).distinct().limit(NAMED + 1).collect()
    found = index.postings
    if len(few) <= NAMED:
        found = found.where(F.col("slot").isin(sorted({r.slot for r in few})) & F.col("term").isin(sorted({r.term for r in few})))
    small = asked.limit(BROADCAST + 1).count() <= BROADCAST
    idf = F.log1p((index.tickets - F.col("tickets") + 0.5) / (F.col("tickets") + 0.5))
    at = lambda i: F.get("starts", i)

    def ticket(i: Column, *more: Column) -> Column:
        tf = at(i + 1) - at(i)
        part = idf * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * F.get("words", i) / max(index.mean_words, 1e-300)))
        return F.struct(F.get("ids", i).alias("id"), part.alias("part"), *more)

    # Made before rows are: beside a ticket no list of its whole row is kept.
    def joined(which: str, one, *more: str) -> DataFrame:
        x = found.join(F.broadcast(asked.where(which)) if small else asked.where(which), "term")
        return x.select("query_id", *more, F.inline(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), one)))

    # Matches are shuffled before they are grouped: else the aggregate would keep rows with the lists that they come from.
    plain = joined("needed = 0", lambda i: ticket(i)).repartition("query_id", "id").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    # A list of starts for each place of a phrase that the word has.
    own = lambda i: F.when(F.size("places") > 0, F.slice("positions", at(i) + 1, at(i + 1) - at(i))).alias("own")
    places = F.transform("places", lambda s: F.named_struct(F.lit("phrase"), s["phrase"], F.lit("place"), s["place"], F.lit("starts"), F.transform("own", lambda p: p - s["place"])))
    hits = joined("needed > 0", lambda i: ticket(i, own(i)), "places").select("query_id", "id", "part", F.when(F.size("places") > 0, places).alias("places")).repartition("query_id", "id")
    every = F.flatten(F.transform(F.flatten(F.collect_list("places")), lambda s: F.transform(s["starts"], lambda at: F.named_struct(F.lit("phrase"), s["phrase"], F.lit("start"), at, F.lit("place"), s["place"]))))
    x = hits.groupBy("query_id", "id").agg(F.sum("part").alias("score"), every.alias("starts"))  # a row for each word of the query
    about = asked.where("needed > 0").select("query_id", "needed", "lengths").dropDuplicates(["query_id"])
    x = x.join(F.broadcast(about) if small else about, "query_id")
    # A phrase stands where each of its places has the same start.
    whole = lambda i: F.exists(F.array_distinct(F.transform(F.filter("starts", lambda s: s["phrase"] == i), lambda s: s["start"])), lambda at: F.size(F.array_distinct(F.transform(F.filter("starts", lambda s: (s["phrase"] == i) & (s["start"] == at)), lambda s: s["place"]))) == F.element_at("lengths", i + 1))
    x = plain.unionByName(x.where(F.forall(F.sequence(F.lit(0), F.col("needed") - 1), whole)).select("query_id", "id", "score"))
    x = x.select("query_id", "id", F.round("score", 6).alias("score"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
