"""Token ids in binary files: frequency-ranked ids, byte-aligned codes, separate control bytes.

Ids are replaced by their rank (0 is the most frequent id of the corpus), so frequent ids take one
byte. A file holds the documents of one range of ids in ascending order, in blocks:

    magic "RKID", then per block
      documents, values (unsigned 32-bit, little endian)
      per document its id (64-bit) and number of values (32-bit)
      control bytes: two bits per value, its code length less one, four values to a byte
      data bytes: the ranks, little endian, without leading zero bytes

and beside the files one table that names the id of each rank. Control bytes are decoded by looking
up four lengths at a time in a 256-row numpy table.

The texts are dealt out and sorted by id once; the tasks tokenise them into draft files of raw ids
and count the ids. When the counts are known each draft is rewritten by rank and goes. Files are
written into the shared folder under a name of the attempt and moved into place, so a repeated task
replaces its own file, or finds it done.

Defined cases: a null text is empty and holds the end id alone; a null document id comes after all
others; rows that share an id stand next to each other in the order of their text's hash and each
keep their row; an empty table writes no file.
"""
from __future__ import annotations

import itertools
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_collect, materialize, new_path, shuffle_partitions
from .bpe import default_vocabulary, encoder, ids_only
from .words import chunked, row_id, shown_id, text_bytes

MAGIC = b"RKID"
END_ID = 0
BLOCK_VALUES = 1 << 19
# Bytes of text whose different fragments are looked up at a time.
CHUNK = 2 << 20
# Characters that one task tokenises: files stay near this size at any input.
FILE_LETTERS = 32 << 20
MAX_IDS = 4_000_000  # the rank table is proportional to the vocabulary

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
_SHIFTS = np.array([0, 2, 4, 6], np.uint8)
_BYTES_OF = np.array([0, 8, 16, 24], np.uint32)


def pack_values(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = extra
    control = np.bitwise_or.reduce(padded.reshape(-1, 4) << _SHIFTS, axis=1).astype(np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes() + data.tobytes()


def unpack_values(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """n values from position `at`, and the position after them."""
    n_control = -(-n // 4)
    lengths = _LENGTHS[np.frombuffer(raw, np.uint8, n_control, at)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    begin = at + n_control
    size = int(ends[-1]) if n else 0
    data = np.concatenate([np.frombuffer(raw, np.uint8, size, begin), np.zeros(3, np.uint8)])
    starts = ends - lengths
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= data[starts[longer] + k].astype(np.uint32) << _BYTES_OF[k]
    return out, begin + size


def write_block(ids, sizes, values: np.ndarray) -> bytes:
    head = struct.pack("<II", len(ids), len(values))
    return head + np.array(ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + pack_values(values)


def read_file(raw: bytes):
    """Yields (document ids, numbers of values, values) of each block."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    at = 4
    while at < len(raw):
        documents, n = struct.unpack_from("<II", raw, at)
        ids = np.frombuffer(raw, "<i8", documents, at + 8)
        sizes = np.frombuffer(raw, "<u4", documents, at + 8 + 8 * documents)
        values, at = unpack_values(raw, n, at + 8 + 12 * documents)
        yield ids, sizes, values


def _put(store, base: str, name: str, blocks) -> None:
    """Write a whole file under a hidden name, then move it into place."""
    hidden = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        for block in blocks:
            out.write(block)
    if _there(store, f"{base}/{name}"):
        store.delete_file(f"{base}/{name}")
    store.move(hidden, f"{base}/{name}")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type == fs.FileType.File


def _draft(vocabulary: str, tail: bytes, where: str):
    """Tokenise an ordered partition into its draft file; one row for the file (token null) and one per id that occurs."""
    schema = pa.schema([("part", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        part, bpe = TaskContext.get().partitionId(), encoder(vocabulary, ids_only)
        total = np.zeros(len(bpe.tokens) + 1, np.int64)
        state = {"n": 0}

        def blocks():
            ids, sizes, held, waiting = [], [], [], 0
            for batch in chunked(batches, "text", CHUNK):
                values, counts = bpe.encode_flat(text_bytes(batch.column("text")), tail)
                ids.extend(batch.column("id").to_pylist())
                sizes.extend(counts.tolist())
                held.append(values)
                waiting += len(values)
                if waiting >= BLOCK_VALUES:
                    yield block(ids, sizes, held)
                    ids, sizes, held, waiting = [], [], [], 0
            if ids:
                yield block(ids, sizes, held)

        def block(ids, sizes, held):
            nonlocal total
            values = np.concatenate(held)
            seen = np.bincount(values, minlength=len(total))
            total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)]) + seen
            state["n"] += len(values)
            narrow = values.astype("<u2") if len(total) <= 1 << 16 else values
            body = zstandard.ZstdCompressor(level=1).compress(np.array(ids, "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + narrow.tobytes())
            return struct.pack("<IIII", len(body), len(ids), len(values), narrow.itemsize) + body

        parts = blocks()
        first = next(parts, None)
        if first is None:
            return
        _put(store, base, f"part-{part:08d}.draft", itertools.chain([first], parts))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at) + 1, part)), pa.array([None, *at.tolist()], pa.int64()), pa.array(np.append(state["n"], total[at]))], schema=schema
        )

    return run, "part long, token long, n long"


def _read_draft(raw: bytes):
    at = 0
    while at < len(raw):
        size, documents, n, width = struct.unpack_from("<IIII", raw, at)
        body = zstandard.ZstdDecompressor().decompress(raw[at + 16 : at + 16 + size])
        ids = np.frombuffer(body, "<i8", documents)
        sizes = np.frombuffer(body, "<u4", documents, 8 * documents)
        yield ids, sizes, np.frombuffer(body, f"<u{width}", n, 12 * documents)
        at += 16 + size


def write_token_files(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int | None = END_ID) -> tuple[DataFrame, DataFrame]:
    """Writes the corpus; returns the manifest (path, where, part, n_values, one row per file) and the rank table (token, rank)."""
    spark = docs.sparkSession
    folder = new_path(spark, "token-files")
    spark.createDataFrame([(0,)], "empty int").write.parquet(f"{folder}/folder")  # makes the folder on any store
    where = _absolute(spark, folder)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    rows = docs.select(row_id(ident).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    letters = docs.agg(F.sum(F.length(F.col(text)))).first()[0] or 0
    files = max(shuffle_partitions(spark), -(-letters // FILE_LETTERS))
    ordered = rows.repartitionByRange(int(files), "id", "key").sortWithinPartitions("id", "key").select("id", "text")
    drafts = materialize(ordered.mapInArrow(*_draft(vocabulary or default_vocabulary(), tail, where)), "token-drafts")

    # As many tokens as the vocabulary has: a bounded table, whatever the corpus.
    counted = bounded_collect(drafts.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), MAX_IDS)
    token_of = np.array([r["token"] for r in sorted(counted, key=lambda r: (-r["n"], r["token"]))], np.int64)
    rank_of = np.zeros(int(token_of.max()) + 1 if len(token_of) else 1, "<u4")
    rank_of[token_of] = np.arange(len(token_of), dtype="<u4")
    ranks = materialize(spark.createDataFrame([(int(t), k) for k, t in enumerate(token_of)], "token long, rank long"), "token-ranks")
    table = spark.sparkContext.broadcast(rank_of)

    def rewrite(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
                name = f"part-{part:08d}"
                if not _there(store, f"{base}/{name}.rkid"):
                    with store.open_input_file(f"{base}/{name}.draft") as f:
                        raw = f.read()
                    _put(store, base, f"{name}.rkid", itertools.chain([MAGIC], (write_block(ids, sizes, table.value[values]) for ids, sizes, values in _read_draft(raw))))
                if _there(store, f"{base}/{name}.draft"):
                    store.delete_file(f"{base}/{name}.draft")
                yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}.rkid"]), pa.array([part], pa.int64()), pa.array([n], pa.int64())], names=["path", "part", "n_values"])

    listed = drafts.where("token is null").select("part", "n").repartition(int(files), "part")
    return materialize(listed.mapInArrow(rewrite, "path string, part long, n_values long"), "token-manifest").withColumn("where", F.lit(where)), ranks


def _absolute(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that pyarrow understands."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_token_files(manifest: DataFrame, ranks: DataFrame) -> DataFrame:
    """From the files: doc_id, start (values of all documents before it), n_tokens, ids (little-endian 32-bit)."""
    spark = manifest.sparkSession
    rows = bounded_collect(ranks.orderBy("rank").select("token"), MAX_IDS)
    table = spark.sparkContext.broadcast(np.array([r["token"] for r in rows], "<u4"))
    before = F.coalesce(F.sum("n_values").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", "where", before.alias("base"), "part")  # one row per file
    files = max(1, placed.count())
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path, where, base in zip(*(batch.column(c).to_pylist() for c in ("path", "where", "base"))):
                store, _ = fs.FileSystem.from_uri(where)
                with store.open_input_file(path) as f:
                    raw = f.read()
                for ids, sizes, values in read_file(raw):
                    tokens = table.value[values]
                    ends = np.cumsum(sizes, dtype=np.int64)
                    parts = [tokens[b - s : b].tobytes() for s, b in zip(sizes.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(base + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(parts, pa.binary())], schema=schema)
                    base += int(ends[-1])

    dealt = placed.repartition(files, "part")
    done = dealt.select("path", "where", "base").mapInArrow(read, "id long, start long, n_tokens long, ids binary")
    return done.withColumn("id", shown_id(F.col("id"))).withColumnRenamed("id", "doc_id")
