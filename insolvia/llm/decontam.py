"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the runs of alphanumeric bytes (every non-ASCII byte counts) of the lowered text. Each
benchmark item gives its windows of `span` consecutive words, an item with fewer words gives all of
them as one. The automaton runs over word numbers, so a text is scanned once whatever the number of
items; the scan's positions are word positions, and the byte places of those words lead back to the
original text.

The benchmark is counted before anything of it is sent to the tasks. Up to `block_pairs` words and
BLOCK_BYTES bytes one automaton holds all of it. Above, the distinct pairs of window and item are dealt by
hash into blocks of about that size; each block gives one automaton, the documents are scanned once per
block, and word places and item ids are merged per row (id and text digest). Nothing is dropped at any
size; `max_words` only lets a caller ask for a refusal.

Defined cases: null and empty texts have no words and are clean; an item without a word matches
nothing; equal items both count as found; a null item id is written as an empty string; repeated
rows get equal answers; an empty benchmark finds nothing; only the named columns are read, and
`clean_documents` passes every column through.
"""
from __future__ import annotations

import pickle
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_collect, materialize
from .words import ALNUM, chunked, row_id, shown_id, text_bytes

SPAN = 10
# One automaton: about 1.15 KB a window, so some 230 MB in a worker.
BLOCK_PAIRS, BLOCK_BYTES = 200_000, 64 << 20
_WORD = re.compile(rb"[^ ]+")


class WindowScanner:
    """All windows of a benchmark, searched at once."""

    def __init__(self, items: list[tuple[str, bytes]], span: int = SPAN):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = text.translate(ALNUM).split()
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            for at in range(max(1, len(ids) - span + 1) if ids else 0):
                windows.setdefault(ids[at : at + span], set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, names in windows.items():
            self.automaton.add_word(window, (len(window), frozenset(names)))
        self.empty = not windows
        if windows:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, the places of the words hit, the items found."""
        words = text.translate(ALNUM).split()
        none = np.zeros(0, np.int64)
        if self.empty or not words:
            return len(words), none, set()
        get = self.numbers.get
        ids = tuple([get(w, 0) for w in words])
        found = list(self.automaton.iter(ids))
        if not found:
            return len(words), none, set()
        hit = np.zeros(len(words) + 1, np.int64)
        names: set[str] = set()
        for end, (size, items) in found:
            hit[end - size + 1] += 1
            hit[end + 1] -= 1
            names |= items
        return len(words), np.flatnonzero(np.cumsum(hit)[:-1]), names

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Passages of the original text, as code point positions, that windows cover."""
        raw = text.encode()
        _, hit, _ = self.scan(raw)
        if not len(hit):
            return []
        places = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
        groups = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
        return [(len(raw[: places[g[0]][0]].decode()), len(raw[: places[g[-1]][1]].decode())) for g in groups]


_kept: dict[bytes, WindowScanner] = {}


def _scanner(blob: bytes) -> WindowScanner:
    """The scanner of a block; a worker holds one at a time."""
    if blob not in _kept:
        _kept.clear()
        _kept[blob] = WindowScanner(*pickle.loads(blob))
    return _kept[blob]


def _windows(items: DataFrame, span: int) -> DataFrame:
    """Distinct pairs of window (its words, lowered, with a space between) and item."""

    def run(batches):
        for batch in chunked(batches, "text"):
            for name, raw in zip(batch.column("id"), text_bytes(batch.column("text"))):
                words = raw.translate(ALNUM).split()
                count = max(1, len(words) - span + 1) if words else 0
                for begin in range(0, count, 50_000):
                    found = [b" ".join(words[at : at + span]) for at in range(begin, min(begin + 50_000, count))]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), pa.array(found, pa.binary())], names=["id", "window"])

    return items.mapInArrow(run, "id string, window binary").distinct()


def _blocks(items: DataFrame, span: int, ident: str, text: str, max_words: int | None, block_pairs: int):
    """Number of blocks, and their broadcasts one by one; the items are counted before any is collected."""
    items = items.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))
    words, size = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))), F.sum(F.octet_length("text") + F.octet_length("id"))).first()
    words, size = words or 0, size or 0
    if max_words is not None and words > max_words:
        raise ValueError(f"the benchmark has {words} words; the caller allows {max_words}")
    context = items.sparkSession.sparkContext
    items = items.where(F.col("text").isNotNull())
    if words <= block_pairs and size <= BLOCK_BYTES:
        # Every row counts as one word at least, so there are no more rows than block_pairs.
        rows = bounded_collect(items, block_pairs)
        return 1, iter([context.broadcast(pickle.dumps((sorted((r["id"], r["text"].encode()) for r in rows), span)))])
    pairs = materialize(_windows(items, span), "benchmark-windows")
    count, size = pairs.agg(F.count("*"), F.sum(F.octet_length("window") + F.octet_length("id"))).first()
    n = max(1, -(-count // block_pairs), -(-(size or 0) // BLOCK_BYTES))
    # Pairs, not windows: a window that many items share is dealt over the blocks too.
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("window", "id"), F.lit(n)))

    def blobs():
        for k in range(n):
            rows = bounded_collect(dealt.where(F.col("block") == k).select("id", "window"), 2 * block_pairs + 1000)
            yield context.broadcast(pickle.dumps((sorted((r["id"], bytes(r["window"])) for r in rows), span)))

    return n, blobs()


def _passages(scanner: WindowScanner, raw: bytes, hit: np.ndarray, with_spans: bool) -> list[dict]:
    """The words hit: place, and with_spans start and end as code points."""
    if not with_spans or not len(hit):
        return [{"place": int(p), "start": 0, "end": 0} for p in hit]
    places = [m.span() for m in _WORD.finditer(raw.translate(ALNUM))]
    # Code points before each byte: UTF-8 continuation bytes start none.
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"place": int(p), "start": int(points[places[p][0]]), "end": int(points[places[p][1]])} for p in hit]


def _find_in_blocks(docs: DataFrame, blobs, with_spans: bool, ident: str, text: str) -> DataFrame:
    """find_contamination by one scan per block; the first gives every row, the others only rows with hits."""
    rows = docs.select(row_id(ident).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("key"), F.col(text).cast("string").alias("text"))
    place = pa.list_(pa.struct([("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("hits", place), ("items", pa.list_(pa.string()))])
    parts = []
    for k, blob in enumerate(blobs):

        def run(batches, blob=blob, every=k == 0):
            scanner = _scanner(blob.value)
            for batch in chunked(batches, "text"):
                kept, out = [], [[], [], []]
                for at, raw in enumerate(text_bytes(batch.column("text"))):
                    total, hit, names = scanner.scan(raw)
                    if every or names:
                        kept.append(at)
                        for column, value in zip(out, (total, _passages(scanner, raw, hit, with_spans), sorted(names))):
                            column.append(value)
                same = batch.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([same.column("id"), same.column("key"), *(pa.array(c, t) for c, t in zip(out, schema.types[2:]))], schema=schema)

        part = rows.mapInArrow(run, "id long, key binary, n_words long, hits array<struct<place: long, start: long, end: long>>, items array<string>")
        parts.append(materialize(part, "contamination-block"))
        blob.destroy()
    found = parts[0].where(F.size("items") > 0)
    for part in parts[1:]:
        found = found.unionByName(part)
    # Equal rows of one block give equal hits: a set has one entry per block at most.
    found = found.groupBy("id", "key").agg(F.collect_set("hits").alias("hits"), F.collect_set("items").alias("items"))
    found = found.select("id", "key", F.sort_array(F.array_distinct(F.flatten("hits"))).alias("hits"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items"))
    done = parts[0].select("id", "key", "n_words").join(found, ["id", "key"], "left")
    none = F.array().cast("array<struct<place: long, start: long, end: long>>")
    done = done.withColumn("hits", F.coalesce("hits", none))
    columns = [shown_id(F.col("id")).alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    if with_spans:
        first = F.filter("hits", lambda h, i: (i == 0) | (F.get(F.col("hits"), i - 1)["place"] < h["place"] - 1))
        last = F.filter("hits", lambda h, i: (i == F.size("hits") - 1) | (F.get(F.col("hits"), i + 1)["place"] > h["place"] + 1))
        columns.append(F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end"))).alias("spans"))
    return done.select(*columns)


def find_contamination(
    docs: DataFrame, items: DataFrame, span: int = SPAN, ident: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int | None = None, with_spans: bool = False, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (sorted), and with_spans the covered passages as [start, end) code points."""
    blocks, blobs = _blocks(items, span, item_id, item_text, max_words, block_pairs)
    if blocks > 1:
        return _find_in_blocks(docs, blobs, with_spans, ident, text)
    blob = next(blobs)
    place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", place)])

    def run(batches):
        scanner = _scanner(blob.value)
        for batch in chunked(batches, "text"):
            out = [[], [], [], []]
            for raw in text_bytes(batch.column("text")):
                total, hit, names = scanner.scan(raw)
                spans = [{"start": a, "end": b} for a, b in scanner.spans(raw.decode())] if with_spans and names else []
                for column, value in zip(out, (total, len(hit), sorted(names), spans)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, schema.types[1:]))], schema=schema)

    rows = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(run, "id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")
    columns = [shown_id(F.col("id")).alias("doc_id"), "n_words", "n_hit", "items"]
    return done.select(*columns, *(["spans"] if with_spans else []))


def clean_documents(
    docs: DataFrame, items: DataFrame, span: int = SPAN, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_words: int | None = None, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """The rows of docs, all columns, in which no window occurs."""
    blocks, blobs = _blocks(items, span, item_id, item_text, max_words, block_pairs)
    if blocks > 1:
        return _clean_in_blocks(docs, blobs, text)
    blob = next(blobs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches):
        scanner = _scanner(blob.value)
        for batch in chunked(batches, names[at]):
            clean = [not scanner.scan(raw)[2] for raw in text_bytes(batch.column(names[at]))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    rows = docs.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def _clean_in_blocks(docs: DataFrame, blobs, text: str) -> DataFrame:
    """clean_documents by one scan per block: the digests of texts with a hit, then the rows without one of them."""
    rows = docs.select(F.unhex(F.sha2(F.col(text).cast("string"), 256)).alias("key"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    hit = None
    for blob in blobs:

        def run(batches, blob=blob):
            scanner = _scanner(blob.value)
            for batch in chunked(batches, "text"):
                found = [bool(scanner.scan(raw)[2]) for raw in text_bytes(batch.column("text"))]
                yield batch.select(["key"]).filter(pa.array(found, pa.bool_()))

        part = materialize(rows.mapInArrow(run, "key binary").distinct(), "contamination-block")
        blob.destroy()
        hit = part if hit is None else hit.unionByName(part)
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.toDF(*names).withColumn("key", F.unhex(F.sha2(F.col(names[docs.columns.index(text)]).cast("string"), 256)))
    # A null text has no digest, joins nothing and stays.
    return keyed.join(hit.distinct(), "key", "left_anti").select(*names).toDF(*docs.columns)


def items_digest(names: list[str]) -> str:
    return sha256(",".join(names).encode()).hexdigest()
