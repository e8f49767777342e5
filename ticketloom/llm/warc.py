"""WARC archives of captures, and an index of them in global order by an external merge.

Archives are written by Spark's text writer: a record is a string (bytes as they are), and the line separator is the
CRLF CRLF that ends a record. They are read back as a stream of pieces between such separators, joined by the lengths
that records state, so a task holds one record at a time, whatever the size of an archive. Of captures with equal
payloads the one with the largest id carries the payload, others are revisit records that refer to it.

The index: each task sorts what it reads into runs, cut into blocks of `block` entries. Blocks are split at the range
limits (taken from a bounded number of keys, uniform by hash; they decide only balance), dealt by range, and each range merges
its runs with a loser tree: blocks come in order of their first key and enter the tree when the merge gets there, so
it holds the blocks under the frontier and no more. A URL with very many captures is spread by time, as ranges are of
(URL key, time, id).

Defined results: a null payload is empty, a null URL is left out of its record and has the key '', a null time is the epoch; a
null id is never the largest one and comes back as null; captures with one id and payload are all of the same type; control
characters and blanks of a URL are percent-encoded. Empty tables give an empty archive and index; long payloads go
through whole. A file that isn't a WARC archive raises an error that names it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ticketloom.llm._store import arrow_rows, materialise

END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:capture:"
ENTRY = "url_key string, at string, record_id string, type string, uri string, payload_bytes long, payload_digest string, intact boolean, refers_to string, file string, offset long, length long"

_KINDS = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


@dataclass(frozen=True)
class WarcConfig:
    #: Least bytes of a payload that others refer to.
    revisits_from: int = 0
    #: Most records of an archive file.
    records: int = 50_000
    #: Entries of a run that is sorted at once, of a block, and by range.
    run: int = 50_000
    block: int = 512
    range_entries: int = 500_000
    #: Keys by range, uniform by hash, from which the limits are taken.
    keys: int = 16


# ---- writing ----


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: four digits for each five hexadecimal ones."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(key: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(">"))


def record(row_id: Column, uri: Column, at: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """One WARC record without the separator after it; a revisit where refers_to isn't null."""
    again = refers_to.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    uri = F.regexp_replace(uri, "\r", "%0D")
    for char in "\n\t\f\x0b\0 ":
        uri = F.replace(uri, F.lit(char), F.lit(f"%{ord(char):02X}"))
    when = F.date_format(F.to_utc_timestamp(F.coalesce(at, F.timestamp_seconds(F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.when(again, "revisit").otherwise("response")), _header("WARC-Record-ID", _urn(row_id)),
        F.coalesce(_header("WARC-Target-URI", uri), F.lit("")), _header("WARC-Date", when), _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {_REVISIT}\r\n"), _header("WARC-Refers-To", _urn(refers_to)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(size)).cast("string")), F.lit("\r\n"), http, F.when(again, "").otherwise(payload),
    )


def write_archives(captures: DataFrame, path: str, id_col: str, uri: str, at: str, payload: str, cfg: WarcConfig = WarcConfig()) -> None:
    """captures as gzipped archives in the folder `path`. payload: text (as UTF-8) or bytes."""
    x = captures.select(F.col(id_col).alias("id"), F.col(uri).cast("string").alias("uri"), F.col(at).cast("timestamp").alias("at"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    x = x.withColumns({"size": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    # Payloads that come more than once, as a table whose size decides how it is joined; copies are combined before the shuffle.
    several = x.where(F.col("size") >= cfg.revisits_from).groupBy("digest", "size").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null").drop("n")
    x = x.join(materialise(several, "several"), ["digest", "size"], "left")
    refers_to = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    x = x.select(record(*map(F.col, ("id", "uri", "at", "payload", "size", "digest")), refers_to).alias("value"))
    x.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", cfg.records).text(path)


# ---- reading ----


def url_key(uri: str | None) -> str:
    """The URL with its host's labels turned around, as com,example,www)/path?query."""
    m = re.match(r"(?s)(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)([^#]*)", uri or "")
    if not m:
        return uri or ""
    host, port = re.fullmatch(r"(?s)(.*?)(:\d*)?", m[1]).groups()
    if not host.startswith("["):
        host = ",".join(reversed(host.lower().rstrip(".").split(".")))
    return f"{host}{'' if port in (None, ':', ':80', ':443') else port}){m[2] or '/'}"


def _records(pieces, file: str):
    """(offset, length, header, block) of one archive, given as pieces: bytes, and whether a separator follows them."""
    end = END.encode()
    pieces, kept, at = iter(pieces), b"", 0

    def more(least: int | None) -> bool:
        """Hold at least so many bytes, or else a whole header."""
        nonlocal kept
        parts, n = [kept], len(kept)
        while n < least if least is not None else end not in parts[-1]:
            p = next(pieces, None)
            if p is None:
                break
            parts.append(p)
            n += len(p)
        kept = b"".join(parts)
        return bool(kept)

    while more(None):
        gap = len(kept) - len(kept.lstrip(b"\r\n"))  # archives may have more line ends between records
        if gap:
            kept, at = kept[gap:], at + gap
            continue
        cut = kept.find(end)
        head = kept[:cut].decode("utf-8", "replace").split("\r\n")
        names = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in head[1:])}
        if cut < 0 or not head[0].startswith("WARC/") or not names.get("content-length", "").isdigit():
            raise ValueError(f"no WARC record at {at} of {file}")
        size = int(names["content-length"])
        more(cut + 4 + size)
        if len(kept) < cut + 4 + size:
            raise ValueError(f"the record at {at} of {file} is cut short")
        yield at, cut + 4 + size, names, kept[cut + 4 : cut + 4 + size]
        kept, at = kept[cut + 4 + size :], at + cut + 4 + size


def _entry(file: str, at: int, length: int, h: dict, block: bytes) -> tuple[tuple, bytes | None]:
    """The index entry of a record, and its payload: what follows the HTTP header, none of a revisit."""
    stated = h.get("warc-payload-digest", "").partition(":")[2] or None
    kind, payload, digest = h.get("warc-type"), None, stated
    if kind != "revisit":
        http = h.get("content-type", "").startswith("application/http")
        payload = block.partition(END.encode())[2] if http else block
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
    uri = h.get("warc-target-uri")
    uri = uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri
    trim = lambda x: x[1:-1] if x and x[0] == "<" else x
    size = None if payload is None else len(payload)
    return (url_key(uri), h.get("warc-date", ""), trim(h.get("warc-record-id")) or "", kind, uri, size, digest, stated is None or digest == stated, trim(h.get("warc-refers-to")), file, at, length), payload


def _streamed(batches):
    """(file, record) of batches (file, value), where the values of a file come one after another."""
    rows = ((f, v) for b in batches for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    end, ahead = END.encode(), next(rows, None)

    def of(name):
        nonlocal ahead
        while ahead is not None and ahead[0] == name:
            value = ahead[1]
            ahead = next(rows, None)
            yield value + end  # the last one may have had none, which no length asks for

    while ahead is not None:
        file = ahead[0]
        for r in _records(of(file), file):
            yield file, r


def _pieces(spark: SparkSession, path: str, compressed: bool) -> DataFrame:
    """(file, value): gzipped archives as pieces between separators, in order, as such files aren't split; others whole."""
    x = spark.read.text(path, lineSep=END).withColumn("value", F.col("value").cast("binary")) if compressed else spark.read.format("binaryFile").load(path).withColumnRenamed("content", "value")
    return x.select(F.col("_metadata.file_name").alias("file"), "value")


def read_archives(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """A row for each record: ENTRY, and payload (bytes; null for revisits)."""

    def run(batches):
        rows, held = [], 0
        done = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*_KINDS, pa.binary()])], [*_NAMES, "payload"])
        for file, r in _streamed(batches):
            entry, payload = _entry(file, *r)
            rows.append((*entry, payload))
            held += len(r[3])
            if held > 1 << 24 or len(rows) >= 1000:
                yield done()
                rows, held = [], 0
        if rows:
            yield done()

    return _pieces(spark, path, compressed).mapInArrow(run, ENTRY + ", payload binary")


# ---- the index ----


class LoserTree:
    """Merges sorted lists that may join while it runs. Each inner node keeps who lost there; the winner is the least."""

    def __init__(self):
        self.size = 0
        self._grow()

    def _grow(self) -> None:
        self.keys = getattr(self, "keys", []) + [None] * max(2, self.size)
        self.lists = getattr(self, "lists", []) + [None] * max(2, self.size)
        self.free = list(range(len(self.keys) - 1, self.size - 1, -1))
        self.size = len(self.keys)
        won = list(range(self.size)) * 2
        self.lost = [0] * self.size
        for node in range(self.size - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.lost[node] = (b, a) if self._less(b, a) else (a, b)
        self.winner = won[1]

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x[0] < y[0])

    @property
    def least(self):
        return self.keys[self.winner]

    def add(self, entries: list) -> None:
        """A sorted list of (key, value) whose first key is not above the least one: so it wins wherever it meets another."""
        if not self.free:
            self._grow()
        slot = self.free.pop()
        rest = iter(entries)
        node, below, hole = (self.size + slot) >> 1, self.size + slot, None
        while node:
            # Who lost here came up from the new list's side: it is pushed down to where that side lost before.
            other = self.lost[node]
            if other == slot:
                hole = node
            elif hole is not None and (self.size + other) >> (self.size.bit_length() - below.bit_length()) == below:
                self.lost[hole], hole = other, node
            node, below = node >> 1, node
        if hole is not None:
            self.lost[hole] = self.winner
        self.winner, self.lists[slot], self.keys[slot] = slot, rest, next(rest)

    def pop(self):
        """The least entry; its list's next one takes its place."""
        slot = self.winner
        out, self.keys[slot] = self.keys[slot], next(self.lists[slot], None)
        if self.keys[slot] is None:
            self.lists[slot] = None
            self.free.append(slot)
        node, up = (self.size + slot) >> 1, slot
        while node:
            if self._less(self.lost[node], up):
                self.lost[node], up = up, self.lost[node]
            node >>= 1
        self.winner = up
        return out


def merged(blocks):
    """The (key, value) of sorted blocks, which come in the order of their first keys, in one order."""
    tree, ahead = LoserTree(), next(blocks, None)
    while ahead is not None or tree.least is not None:
        while ahead is not None and (tree.least is None or ahead[0][0] <= tree.least[0]):
            tree.add(ahead)
            ahead = next(blocks, None)
        yield tree.pop()


_STRUCT = pa.struct(list(zip(_NAMES, _KINDS)))
_KEY = [("url_key", pa.string()), ("at", pa.string()), ("record_id", pa.string())]
BLOCK = "first struct<url_key string, at string, record_id string>, n int, entries array<struct<" + ENTRY.replace(" ", ": ").replace(",:", ",") + ">>"


def _block_batch(blocks: list[list[tuple]], **more) -> pa.RecordBatch:
    entries = [e for b in blocks for e in b]
    upto = [0]
    for b in blocks:
        upto.append(upto[-1] + len(b))
    columns = [pa.array(c, t) for c, t in zip(zip(*entries), _KINDS)]
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_STRUCT)))
    first = pa.StructArray.from_arrays([c.take(pa.array(upto[:-1])) for c in columns[:3]], fields=list(pa.struct(_KEY)))
    return pa.record_batch([first, pa.array([len(b) for b in blocks], pa.int32()), lists, *more.values()], ["first", "n", "entries", *more])


def _plain(e: tuple) -> tuple:
    """By url_key, at and record_id, ties by type, file and place. Python orders strings by code points, which is the order of their bytes."""
    return (e[0], e[1], e[2], e[3] or "", e[9], e[10])


def sorted_runs(spark: SparkSession, path: str, cfg: WarcConfig = WarcConfig(), compressed: bool = True) -> DataFrame:
    """Blocks of sorted runs: what a task reads, up to `run` entries at a time."""

    def run(batches):
        def blocks(entries):
            entries.sort(key=_plain)
            return _block_batch([entries[i : i + cfg.block] for i in range(0, len(entries), cfg.block)])

        held = []
        for file, r in _streamed(batches):
            held.append(_entry(file, *r)[0])
            if len(held) >= cfg.run:
                yield blocks(held)
                held = []
        if held:
            yield blocks(held)

    return _pieces(spark, path, compressed).mapInArrow(run, BLOCK)


def merge_runs(blocks: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(range, place, ENTRY): entries of all runs in one order, that of range and place."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cfg.range_entries))
    key = blocks.select(F.explode(F.arrays_zip("entries.url_key", "entries.at", "entries.record_id")).alias("k")).select(F.struct("k.url_key", "k.at", "k.record_id").alias("k"))
    keys = key.orderBy(F.xxhash64("k")).limit(cfg.keys * ranges).select("k.*").collect()  # bounded; they decide balance only
    keys = sorted({(r.url_key, r.at, r.record_id) for r in keys})
    limits = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def cut(batches):
        for b in batches:
            out, own = [], []
            for raw in b.column(2):
                entries = [tuple(e.values()) for e in raw.as_py()]
                lo, hi = (bisect_right(limits, e[:3]) for e in (entries[0], entries[-1]))
                at = [bisect_left(entries, k, key=lambda e: e[:3]) for k in limits[lo:hi]]
                for i, (a, z) in enumerate(zip([0, *at], [*at, len(entries)])):
                    if z > a:
                        out.append(entries[a:z])
                        own.append(lo + i)
            if out:
                yield _block_batch(out, range=pa.array(own, pa.int32()))

    def merge(batches):
        rows = ((r, [(_plain(t), t) for t in (tuple(e.values()) for e in raw.as_py())]) for b in batches for r, raw in zip(b.column(3).to_pylist(), b.column(2)))
        ahead = next(rows, None)

        def of(number):
            nonlocal ahead
            while ahead is not None and ahead[0] == number:
                block = ahead[1]
                ahead = next(rows, None)
                yield block

        while ahead is not None:
            number, place, held = ahead[0], 0, []
            for e in merged(of(number)):
                held.append((number, place, *e[1]))
                place += 1
                if len(held) >= 10_000:
                    yield _index_batch(held)
                    held = []
            if held:
                yield _index_batch(held)

    pieces = blocks.mapInArrow(cut, BLOCK + ", range int")
    # Spark orders strings by their bytes, as the runs do.
    dealt = pieces.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "first.url_key", "first.at", "first.record_id")
    return dealt.mapInArrow(merge, "range int, place long, " + ENTRY)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), *_KINDS])], ["range", "place", *_NAMES])


def capture_index(spark: SparkSession, path: str, cfg: WarcConfig = WarcConfig(), compressed: bool = True) -> DataFrame:
    """The archives' records as capture histories: in order of URL key, time and id."""
    runs = materialise(sorted_runs(spark, path, cfg, compressed), "runs", rows=1000)
    with arrow_rows(spark, 64):
        return materialise(merge_runs(runs, cfg), "captures", rows=64)


def with_position(index: DataFrame) -> DataFrame:
    """index with `position`, from 0 over all ranges: a row for each range is summed up."""
    sizes = index.groupBy("range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("range").alias("_r"), (F.sum("_n").over(Window.orderBy("range")) - F.col("_n")).alias("_before"))
    return index.join(before, F.col("range") == F.col("_r")).withColumn("position", F.col("_before") + F.col("place")).drop("_r", "_before")


def resolved(index: DataFrame) -> DataFrame:
    """index with the payload_bytes of what revisits refer to (null where it isn't there)."""
    there = index.where("type <> 'revisit'").groupBy(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    again = index.where("type = 'revisit'")
    again = again.join(there, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = again.withColumn("payload_bytes", F.col("_bytes")).drop("_id", "_digest", "_bytes")
    return index.where("type <> 'revisit'").unionByName(again)


def row_id(urn: Column) -> Column:
    """The id that a record's name was made from, as text; '' for a null one."""
    return F.url_decode(F.substring(urn, len(_URN) + 1, 1 << 20))
