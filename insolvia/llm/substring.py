"""Exact removal of repeated passages by super-k-mer partitioning.

A window is `span` consecutive words of one text. Every window has a minimiser, the smallest hash
among its runs of `core` words, and equal windows have equal minimisers; consecutive windows that
share one form a super-k-mer of at most `MAX_WINDOWS` windows (more only come in a row where a text
repeats itself). The steps:

1. Each text gives one thin row per super-k-mer (minimiser, place, length). Minimisers that occur
   under one document id only cannot hold a repeated window and are dropped.
2. The others travel to the bucket of their minimiser as one packed string. Equal packed strings
   are combined before the shuffle, so a passage copied by a third of all rows arrives once per map task.
3. In a bucket the windows of the packed strings are sorted by their bytes, so that equal ones meet
   and the smallest document id of each is exact. A bucket of more than `bucket_strings` different
   strings, or of more than `bucket_bytes` bytes of windows (a frequent core in many contexts, very long
   words), is dealt out by the digest of the single window instead, places of one window over `SALTS` groups.
4. The smallest ids of a string are one row, a list of runs of neighbouring windows. Each place looks up
   the row of its string, and a window seen under a smaller id marks its words.

Defined cases: null and empty texts have no words; a text with fewer than `span` words has no window;
a null id counts as an id after all others; rows that share an id are one document, so they never
remove each other's words; a place is known by id and text, so repeated rows get equal answers;
only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .words import chunked, flat_bytes, ranges, row_id, run_hashes, shown_id, text_bytes, word_hashes, word_spans

SPAN = 50
CORE = 8
# Different packed strings that one task compares at a time.
BUCKET_STRINGS = 20_000
# Bytes of single windows that one task sorts at a time.
BUCKET_BYTES = 64 << 20
# Windows of one packed string.
MAX_WINDOWS = 1_000
# Groups that the places of one frequent window are dealt out to.
SALTS = 256


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _super_kmers(data, starts, ends, first, span, core):
    """Text, first window's word, number of windows and minimiser of every super-k-mer of a chunk."""
    words = word_hashes(data, starts, ends)
    if len(words) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = _window_minima(run_hashes(words, core), span - core + 1)  # one entry per window start
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(least))
    inside = place + span <= first[1:][text_of[: len(least)]]
    place = place[inside]
    least, owner = least[inside], text_of[: len(inside)][inside]
    if not len(place):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(place), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    new[(np.arange(len(place)) - np.repeat(at, np.diff(np.append(at, len(place))))) % MAX_WINDOWS == 0] = True
    at = np.flatnonzero(new)
    return owner[at], place[at], np.diff(np.append(at, len(place))), least[at]


def _thin(span: int, core: int):
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("minimiser", pa.int64()), ("place", pa.int32()), ("windows", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            data, bounds = flat_bytes(text_bytes(batch.column("text")))
            starts, ends, first = word_spans(data, bounds)
            owner, place, windows, least = _super_kmers(data, starts, ends, first, span, core)
            ids, keys = batch.column("id").to_numpy(), batch.column("text_key").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(keys[owner]), pa.array(least.view(np.int64)), pa.array((place - first[owner]).astype(np.int32)), pa.array(windows.astype(np.int32))], schema=schema
            )

    return run, "id long, text_key long, minimiser long, place int, windows int"


def _pack(span: int):
    """Cut the named super-k-mers out of their texts: words joined by one space."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("minimiser", pa.int64()), ("place", pa.int32()), ("bytes", pa.int64()), ("packed", pa.large_binary())])

    def run(batches):
        for batch in chunked(batches, "text"):
            out = [[], [], [], [], [], []]
            rows = zip(batch.column("id").to_pylist(), batch.column("text_key").to_pylist(), text_bytes(batch.column("text")), batch.column("kmers").to_pylist())
            for ident, key, text, kmers in rows:
                words = text.split()
                for k in kmers:
                    at, n = k["place"], k["windows"]
                    packed = b" ".join(words[at : at + n + span - 1])
                    slices = n * len(packed) * span // (n + span - 1)  # about what its windows take one by one
                    for column, value in zip(out, (ident, key, k["minimiser"], at, slices, packed)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run, "id long, text_key long, minimiser long, place int, bytes long, packed binary"


def _windows_of(packed: bytes, span: int) -> Iterator[bytes]:
    cut = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts = [0, *(cut + 1).tolist()]
    ends = [*cut.tolist(), len(packed)]
    return (packed[a:b] for a, b in zip(starts, ends[span - 1 :]))


_FOUND = pa.schema([("minimiser", pa.int64()), ("string", pa.binary()), ("runs", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("least", pa.int64())])))])
_FOUND_TYPE = "minimiser long, string binary, runs array<struct<low: int, high: int, least: long>>"


def _found(minimisers, strings, sizes: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    """One row per string, from the smallest id of each of its windows in order: neighbours of one id make a run."""
    begin = np.cumsum(sizes) - sizes
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[begin] = True
    at = np.flatnonzero(new)
    low = at - np.repeat(begin, sizes)[at]
    runs = pa.StructArray.from_arrays(
        [pa.array(low.astype(np.int32)), pa.array((low + np.diff(np.append(at, len(least))) - 1).astype(np.int32)), pa.array(least[at])], fields=list(_FOUND.field("runs").type.value_type)
    )
    offsets = np.searchsorted(at, np.append(begin, len(least))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(minimisers, pa.int64()), pa.array(strings, pa.binary()), pa.ListArray.from_arrays(offsets, runs, type=_FOUND.field("runs").type)], schema=_FOUND)


def _in_bucket(span: int):
    """Rows arrive sorted by minimiser: sort the windows of one bucket, give each string the smallest ids in runs."""

    def answer(bucket):
        listed = [(window, ident, k, j) for k, (_, ident, _, packed) in enumerate(bucket) for j, window in enumerate(_windows_of(packed, span))]
        listed.sort()
        least = [[0] * (packed.count(b" ") + 2 - span) for _, _, _, packed in bucket]
        last, best = None, 0
        for window, ident, k, j in listed:  # sorted: the first of equal windows has the smallest id
            if window != last:
                last, best = window, ident
            least[k][j] = best
        return [(minimiser, string, ids) for (minimiser, _, string, _), ids in zip(bucket, least)]

    def table(rows):
        minimisers, strings, least = zip(*rows) if rows else ((), (), ())
        sizes = np.fromiter(map(len, least), np.int64, len(least))
        return _found(minimisers, strings, sizes, np.fromiter((i for ids in least for i in ids), np.int64, int(sizes.sum())))

    def run(batches):
        bucket, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "id", "string", "packed"))):
                if bucket and bucket[0][0] != row[0]:
                    out.extend(answer(bucket))
                    bucket = []
                    if len(out) > 5_000:
                        yield table(out)
                        out = []
                bucket.append(row)
        if bucket:
            out.extend(answer(bucket))
        yield table(out)

    return run, _FOUND_TYPE


def _in_runs(batches):
    """Strings with their windows (low, least) in order: the windows in runs."""
    for batch in batches:
        windows = batch.column("windows")
        yield _found(batch.column("minimiser"), batch.column("string"), windows.value_lengths().to_numpy().astype(np.int64), windows.flatten().field("least").to_numpy())


def _single_windows(span: int):
    schema = pa.schema([("minimiser", pa.int64()), ("string", pa.binary()), ("low", pa.int32()), ("id", pa.int64()), ("window", pa.binary())])

    def run(batches):
        for batch in batches:
            for minimiser, string, ident, packed in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "string", "id", "packed"))):
                windows = [sha256(w).digest() for w in _windows_of(packed, span)]
                n = len(windows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([minimiser] * n, pa.int64()), pa.array([string] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([ident] * n, pa.int64()), pa.array(windows, pa.binary())], schema=schema
                )

    return run, "minimiser long, string binary, low int, id long, window binary"


def repeated_windows(docs: DataFrame, ident: str = "doc_id", text: str = "text", span: int = SPAN, core: int = CORE, bucket_strings: int = BUCKET_STRINGS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Windows whose words also start in a document with a smaller id: id, text_key, hits (runs of windows by first word: low, high)."""
    rows = docs.select(row_id(ident).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    thin = materialize(rows.mapInArrow(*_thin(span, core)), "kmers-thin")
    shared = thin.groupBy("minimiser").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("minimiser")
    wanted = (
        thin.join(shared, "minimiser")
        .groupBy("id", "text_key").agg(F.collect_set(F.struct("place", "windows", "minimiser")).alias("kmers"))
    )
    packed = materialize(
        rows.join(wanted, ["id", "text_key"]).mapInArrow(*_pack(span)).withColumn("string", F.unhex(F.md5("packed"))), "kmers-packed"
    )
    strings = packed.groupBy("minimiser", "string", "packed").agg(F.min("id").alias("id"))
    crowded_by = lambda n, size: (F.col(n) > bucket_strings) | (F.col(size) > bucket_bytes)
    load = packed.groupBy("minimiser").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where(crowded_by("n", "size")).select("minimiser")
    hot = materialize(
        packed.join(load, "minimiser", "left_semi").groupBy("minimiser", "string").agg(F.max("bytes").alias("bytes"))
        .groupBy("minimiser").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).where(crowded_by("n", "size")).select("minimiser"),
        "kmers-hot",
    )
    crowded = not hot.isEmpty()
    calm = strings.join(hot, "minimiser", "left_anti") if crowded else strings
    found = calm.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(*_in_bucket(span))
    if crowded:
        single = materialize(strings.join(hot, "minimiser", "left_semi").mapInArrow(*_single_windows(span)), "kmers-single")
        # A window that stands in most strings is dealt out by salt: its least id per salt, then over its salts.
        salted = single.withColumn("salt", F.pmod(F.xxhash64("string", "low"), F.lit(SALTS)))
        least = (
            salted.groupBy("window", "salt").agg(F.min("id").alias("id"))
            .select("window", "salt", F.min("id").over(Window.partitionBy("window")).alias("least"))
        )
        answered = salted.drop("id").join(least, ["window", "salt"]).groupBy("minimiser", "string").agg(F.sort_array(F.collect_list(F.struct("low", "least"))).alias("windows"))
        found = found.unionByName(answered.mapInArrow(_in_runs, _FOUND_TYPE))
    place = F.col("place")
    hits = F.transform(F.filter("runs", lambda r: r["least"] < F.col("id")), lambda r: F.struct((place + r["low"]).alias("low"), (place + r["high"]).alias("high")))
    return (
        packed.select("id", "text_key", "minimiser", "place", "string")
        .join(found, ["minimiser", "string"])  # one row per place
        .select("id", "text_key", hits.alias("hits"))
        .where(F.size("hits") > 0)
        .groupBy("id", "text_key").agg(F.flatten(F.collect_set("hits")).alias("hits"))
    )


def _cover(span: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches):
        for batch in chunked(batches, "text"):
            out = [[], [], [], [], []]
            for ident, text, hits in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), batch.column("hits").to_pylist()):
                words = text.split()
                total = len(words)
                if hits:
                    gone = np.zeros(total + 1, np.int64)
                    np.add.at(gone, [h["low"] for h in hits], 1)
                    np.add.at(gone, [h["high"] + span for h in hits], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:total] == 0)]
                kept = b" ".join(words)
                for column, value in zip(out, (ident, total, total - len(words), sha256(kept).hexdigest(), kept.decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", span: int = SPAN, core: int = CORE, bucket_strings: int = BUCKET_STRINGS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and kept_text (the words that stay, joined by one space)."""
    hits = repeated_windows(docs, ident, text, span, core, bucket_strings, bucket_bytes)
    rows = docs.select(row_id(ident).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    done = rows.join(hits, ["id", "text_key"], "left").select("id", "text", "hits").mapInArrow(*_cover(span))
    return done.withColumn("doc_id", shown_id(F.col("doc_id")))
