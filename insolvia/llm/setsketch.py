"""Near duplicates from SetSketch registers.

1. A text's set is its distinct shingles of `size` words (a shorter text's whole sequence). Each of
   `registers` registers holds the exponentially spaced, truncated minimum of the set's exponential
   hash values; sketches of parts merge by taking the larger register.
2. Texts with equal sets are one node from here on (a class), told by the digest of the whole set.
3. Bands of the first registers put nodes into buckets. In each bucket one leader, the node with the fullest
   buckets, is compared with all others: links, not pairs. Linked nodes are one component.
4. Buckets that still hold several components get all registers of their texts and compare the nodes outside their largest component with
   the others, block by block, by the joint likelihood of the registers (larger, smaller, equal) and the set sizes: a pair whose
   likeliest similarity comes within the estimate's error of the one asked for is confirmed too. Leader pairs are confirmed
   without an estimate.
5. Every link is confirmed on the full sets, and the components of the confirmed links are the groups.

A hot bucket is split into blocks of `block` rows; the leaders' side of every join has one row a key.

Defined cases: null, empty and blank texts have an empty set, link with nothing and form their own
component; a null id counts as an id after all others; in `near_duplicates` rows that share an id are one document, linked
if any of them is (`keep_one` tells their texts apart); only the two named columns are read; an empty table gives an empty result.
"""
from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import connected_components
from .words import LAST_ID, LOWERED, chunked, flat_bytes, free_names, mixed, row_id, run_hashes, shown_id, text_bytes, word_hashes, word_spans

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = 512
BASE, RATE = 1.001, 20.0
LIMIT = 65_534  # registers are 16 bits wide
# How many standard errors an estimate may fall short before a pair is not confirmed.
ERRORS = 4.0
BLOCK = 4_096


@lru_cache(maxsize=4)
def _seeds(registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Factor and summand of each register; the first registers are the same whatever their number."""
    drawn = np.random.default_rng(97).integers(0, 1 << 63, (registers, 2), dtype=np.int64).astype(np.uint64)
    odd = drawn * np.uint64(2) + np.uint64(1)
    return odd[:, 0].copy(), odd[:, 1].copy()


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each (already lowered) text."""
    data, bounds = flat_bytes(texts)
    starts, ends, first = word_spans(data, bounds)
    words = word_hashes(data, starts, ends)
    runs = run_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mixed(run_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers floor(1 - log_b h) of the least exponential value h, kept within 0 .. LIMIT + 1."""
    times, plus = _seeds(registers)
    least = np.full(registers, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 128):
        least = np.minimum(least, (times[:, None] * shingles[None, at : at + 128] + plus[:, None]).min(axis=1))
    if not len(shingles):
        return np.zeros(registers, np.uint16)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _more(t: np.ndarray) -> np.ndarray:
    """Chance that a register of one set is the larger, t being the share of the union's elements that only this set has
    (scaled by the sizes' sum); and the chance's slope in t."""
    c = (BASE - 1) / BASE
    return -np.log(np.maximum(1e-12, 1 - t * c)) / np.log(BASE)


def _slope(t: np.ndarray) -> np.ndarray:
    c = (BASE - 1) / BASE
    return c / np.maximum(1e-12, 1 - t * c) / np.log(BASE)


def reaches(similarity: float, up: np.ndarray, down: np.ndarray, n: np.ndarray, m: np.ndarray, registers: int, errors: float = ERRORS) -> np.ndarray:
    """Whether the similarity of greatest joint likelihood of two sketches comes within `errors` standard errors of the one
    asked for, or above it. up and down count the registers in which the first or second is larger, n and m are the set sizes.

    The log likelihood is concave in the similarity, so its maximum lies at or above a cut exactly if its slope there is not
    negative. The standard error is that of Fisher's information at the similarity asked for."""
    total = np.maximum(1, n + m).astype(float)
    u, v = n / total, m / total
    top = np.minimum(n, m) / np.maximum(1, np.maximum(n, m))  # no two sets of these sizes are more similar

    def parts(j):
        x, y = np.maximum(1e-9, u - v * j), np.maximum(1e-9, v - u * j)
        more, less = np.clip(_more(x), 1e-9, 1), np.clip(_more(y), 1e-9, 1)
        return more, less, np.clip(1 - more - less, 1e-9, 1), -v * _slope(x), -u * _slope(y)

    more, less, same, dm, dl = parts(np.minimum(similarity, top))
    error = 1 / np.sqrt(registers * (dm**2 / more + dl**2 / less + (dm + dl) ** 2 / same))
    cut = np.maximum(0.0, np.minimum(similarity, top) - errors * error - 0.5 / registers)
    more, less, same, dm, dl = parts(cut)
    return (up * dm / more + down * dl / less - (registers - up - down) * (dm + dl) / same >= 0) | (cut <= 0)


def joint_estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """The similarity of greatest likelihood for two sketches, the set sizes being known."""
    grid = np.linspace(0, min(n, m) / max(1, n, m), 201)
    total = max(1, n + m)
    x, y = np.maximum(0, n - m * grid) / total, np.maximum(0, m - n * grid) / total
    more, less = np.clip(_more(x), 1e-9, 1), np.clip(_more(y), 1e-9, 1)
    same = np.clip(1 - more - less, 1e-9, 1)
    up, down = int((a > b).sum()), int((a < b).sum())
    return float(grid[np.argmax(up * np.log(more) + down * np.log(less) + (len(a) - up - down) * np.log(same))])


def _lowered_sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return shingle_sets([t.translate(LOWERED) for t in text_bytes(batch.column("text"))], size)


def _banded(size: int, bands: int, rows: int):
    """Set size, digest of the set, and the hash of each band of registers."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
    factor = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    number = mixed(np.arange(101, 101 + bands, dtype=np.uint64))

    def run(batches):
        for batch in chunked(batches, "text"):
            out = [[], [], []]
            for shingles in _lowered_sets(batch, size):
                r = sketch(shingles, bands * rows)
                keys = mixed((r.reshape(bands, rows).astype(np.uint64) * factor).sum(axis=1) + number) if len(shingles) else ()
                for column, value in zip(out, (len(shingles), blake2b(shingles.tobytes(), digest_size=16).digest(), np.asarray(keys, np.uint64).view(np.int64).tolist())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, schema.types[1:]))], schema=schema)

    return run, "id long, n long, digest binary, bands array<long>"


def _registers(size: int, registers: int):
    """Set size and all registers."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("registers", pa.binary())])

    def run(batches):
        for batch in chunked(batches, "text"):
            sets = _lowered_sets(batch, size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s, registers).tobytes() for s in sets], pa.binary())], schema=schema)

    return run, "id long, n long, registers binary"


def _confirm(size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        last, sets = None, {}
        for batch in chunked(batches, "text_b"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            one, two = (text_bytes(batch.column(c)) for c in ("text_a", "text_b"))
            different = {t: None for t in [*one, *two]}  # a leader's text stands in many rows
            for t, s in zip(different, shingle_sets([t.translate(LOWERED) for t in different], size)):
                different[t] = s
            linked = []
            for t, u in zip(one, two):
                s, v = different[t], different[u]
                small, large = sorted((len(s), len(v)))
                if 100 * small < percent * large or not small:
                    linked.append(False)
                    continue
                common = small + large - len(np.unique(np.concatenate([s, v])))
                linked.append(100 * common >= percent * (small + large - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], schema=schema)

    return run, "a long, b long, linked boolean"


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. docs has id and text."""
    first = docs.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = docs.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # the second join deals out by a, a bucket's leader: its text is one row, its pairs are split when many
    return pairs.join(second.hint("merge"), "b").join(first.hint("merge"), "a").mapInArrow(*_confirm(size, percent)).where("linked").select("a", "b").distinct()


def _compare_block(bands: int, rows: int, registers: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, part, outside, asks = ids[order], *(table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("part", "outside", "asks"))
        n = table.column("n").to_numpy()[order]
        r = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(len(ids), registers)[order]
        band = key[1].as_py()
        data = ~asks
        found_a, found_b = [], []
        for q in np.flatnonzero(asks):
            # other components; between two that ask, the smaller id does
            to = data & (part != part[q]) & ~(outside & (ids < ids[q]))
            at = np.flatnonzero(to)
            at = at[100 * np.minimum(n[at], n[q]) >= percent * np.maximum(n[at], n[q])]
            if not len(at):
                continue
            equal = r[at] == r[q]
            same, up = equal.sum(axis=1), (r[at] > r[q]).sum(axis=1)
            enough = reaches(percent / 100, up, registers - same - up, n[at], np.full(len(at), n[q]), registers)
            at, equal = at[enough], equal[enough]
            if not len(at):
                continue
            shared = equal[:, : bands * rows].reshape(len(at), bands, rows).all(axis=2).argmax(axis=1)
            at = at[shared == band]  # a pair is compared in the first band it shares
            found_a += [int(ids[q])] * len(at)
            found_b += ids[at].tolist()
        return pa.Table.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=schema)

    return run


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    percent = round(100 * similarity)
    texts = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
    drawn = materialize(texts.mapInArrow(*_banded(size, bands, rows)), "sketches")
    full = drawn.where("n > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("id").alias("node")), "sketch-classes")
    members = full.select("id", "digest").join(classes.hint("merge"), "digest")
    # Sides that grow with the corpus are joined by merging at every size, never by a broadcast.
    nodes = full.join(classes.withColumnRenamed("node", "id").hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    nodes = materialize(nodes.drop("digest"), "sketch-nodes")

    # Buckets with more than one node, and each node's standing: how full its buckets are.
    placed = nodes.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = placed.groupBy("band", "key").agg(F.count("*").alias("fill")).where("fill > 1")
    shared = materialize(placed.join(crowded, ["band", "key"]), "buckets")
    standing = shared.groupBy("id").agg(F.sum("fill").alias("standing"))
    ranked = shared.join(standing, "id")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("standing", (-F.col("id")).alias("back"))).alias("best")).select("band", "key", (-F.col("best.back")).alias("leader"))
    stars = shared.join(leaders, ["band", "key"]).where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    same = members.where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    # Only texts that meet another one are compared: they are fetched once.
    met = materialize(texts.join(shared.select("id").distinct().hint("merge"), "id"), "bucket-texts")
    links = materialize(confirmed(stars, met, size, percent), "links-leaders")
    parts = connected_components(links)

    # Where a bucket still holds several components, compare across them.
    located = shared.join(parts.withColumnRenamed("node", "id"), "id", "left").select("band", "key", "id", F.coalesce("part", "id").alias("part"))
    by_part = located.groupBy("band", "key", "part").agg(F.count("*").alias("held"))
    split = (
        by_part.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("held").alias("fill"), F.max(F.struct("held", (-F.col("part")).alias("back"))).alias("main"))
        .where("parts > 1").select("band", "key", F.ceil(F.col("fill") / F.lit(block)).cast("int").alias("blocks"), (-F.col("main.back")).alias("main"))
    )
    open_rows = located.join(split, ["band", "key"]).withColumn("outside", F.col("part") != F.col("main"))
    open_rows = materialize(open_rows, "open-rows")
    sketches = met.join(open_rows.select("id").distinct().hint("merge"), "id").mapInArrow(*_registers(size, registers))
    open_rows = open_rows.join(sketches.hint("merge"), "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    data = open_rows.withColumn("block", own).withColumn("asks", F.lit(False))
    asking = open_rows.where("outside").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    columns = ["key", "band", "block", "id", "part", "n", "registers", "outside", "asks"]
    tried = (
        data.select(columns).unionByName(asking.select(columns))
        .groupBy("key", "band", "block").applyInArrow(_compare_block(bands, rows, registers, percent), "a long, b long").distinct()
    )
    late = materialize(confirmed(materialize(tried, "links-tried"), met, size, percent), "links-across")
    groups = connected_components(links.unionByName(late).unionByName(same))

    done = drawn.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("part", "id").alias("component"))
    return done.select(shown_id(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown_id(F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that stay when each group keeps its smallest id.

    A document is an id with a text: rows that share an id but not the text, and rows without an id, are documents of their
    own, ordered by id (null last), then by the text's digest. Of rows with equal id and text one stays."""
    own, mark, node, count = free_names(docs, "_id", "_mark", "_node", "_rows")
    marked = docs.withColumn(own, row_id(ident)).withColumn(mark, F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    per_id = marked.groupBy(own).agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    if not per_id.where((F.col("low") != F.col("high")) | (F.col(own) == LAST_ID)).isEmpty():
        # Ids do not name documents: number the different (id, text) pairs in their order.
        order = [F.col(ident).isNull().alias("none"), own, mark]
        pairs = marked.select(*order).distinct().orderBy("none", own, mark).select(own, mark, "none", F.monotonically_increasing_id().alias(node))
        pairs = materialize(pairs, "near-documents")
        none = free_names(docs, "_none")[0]
        marked = marked.withColumn(none, F.col(ident).isNull()).join(pairs.withColumnRenamed("none", none).hint("merge"), [own, mark, none])
        marked = materialize(marked.dropDuplicates([node]).select(*docs.columns, node), "near-numbered")
        groups = near_duplicates(marked.select(node, text), node, text, **options).where("kept").select(F.col("doc_id").alias(node))
        return marked.join(materialize(groups, "near-kept").hint("merge"), node, "left_semi").drop(node)
    groups = near_duplicates(docs, ident, text, **options).where("kept").select(F.col("doc_id").alias(own)).groupBy(own).agg(F.count("*").alias(count))
    groups = materialize(groups, "near-kept")
    if groups.where(F.col(count) > 1).isEmpty():
        return marked.join(groups.hint("merge"), own, "left_semi").drop(own, mark)
    return marked.join(groups.hint("merge"), own, "left_semi").dropDuplicates([own]).drop(own, mark)
