"""Byte-level BPE encoding and decoding by forced boundaries.

No merge can join two bytes that stand side by side in no token of the vocabulary. Such a pair is a
certain cut as long as the pre-tokeniser's pattern sees the same on both sides of it, which needs:
the cut does not follow white space (a run of spaces looks ahead), does not precede an apostrophe
(contractions), and falls between characters. The fragments between cuts are encoded independently
by the tokenizers library, each different fragment once per worker, and the ids put back in order.
Strings of special tokens are cut out first, as the library does.

Defined cases: a null text counts as empty and has no ids; equal texts have equal ids; only the
named columns are read.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunked, ranges, row_id, shown_id, text_bytes

# A worker keeps at most this many encoded fragments (a memory bound; the ids do not depend on it).
KEPT_FRAGMENTS = 500_000

_WHITE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
# UTF-8 of the white space beyond ASCII.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Bytes that no UTF-8 text holds mark cuts and ends of texts while a chunk is split.
_CUT, _END = 0xFF, 0xFE
_END_PIECE = bytes([_END])
# Fragments that begin with a space are handed to the library so many at a time: each is a certain cut.
_TOGETHER = 16


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class FragmentEncoder:
    """Encodes whole texts from independently encoded fragments; one per worker and vocabulary.

    What is kept for a fragment is made by `entry` from its ids and their little-endian bytes.
    """

    def __init__(self, path: str, entry: Callable[[FragmentEncoder, list[int], bytes], object], kept: int = KEPT_FRAGMENTS):
        from tokenizers import Tokenizer

        self.library, self.entry, self.kept = Tokenizer.from_file(path), entry, kept
        self.library.no_truncation()
        self.library.no_padding()
        letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary = content["model"]["vocab"]
        added = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.tokens: list[bytes] = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        joined = np.zeros((256, 256), bool)
        for token, number in vocabulary.items():
            if token in added:
                continue
            self.tokens[number] = raw = bytes(letters[c] for c in token)
            pair = np.frombuffer(raw, np.uint8)
            joined[pair[:-1], pair[1:]] = True
        for token, number in added.items():
            self.tokens[number] = token.encode()
        self.token_sizes = np.array(list(map(len, self.tokens)))
        self.decimals = [str(i).encode() for i in range(len(self.tokens))]
        cut = ~joined
        cut[_WHITE, :] = False
        cut[:, 39] = False
        cut[:, 128:192] = False
        cut[_END, :] = cut[:, _END] = False
        self.cut = cut.ravel()
        narrow = cut.copy()  # where a text holds a wide space, no cut may follow a byte of a longer character
        narrow[128:, :] = False
        self.narrow = narrow.ravel()
        self.special = {t.encode() for t in added}
        self.split = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if added else None
        self.cache: dict[bytes, object] = {}

    def _is_cut(self, whole: bytes, data: np.ndarray) -> np.ndarray:
        """Whether a certain cut falls after each byte but the last of texts joined by the end byte."""
        table = self.narrow if _WIDE_SPACE.search(whole) else self.cut
        return table[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]

    def fragments(self, texts: list[bytes]) -> list[list[bytes]]:
        """The fragments of each text; a special token is a fragment."""
        whole = bytes([_END]).join(texts)
        if self.split is not None and self.split.search(whole):
            if len(texts) > 1:
                return [f for t in texts for f in self.fragments([t])]
            return [[f for p in self.split.split(texts[0]) if p for f in ([p] if p in self.special else self.fragments([p])[0])]]
        if not whole:
            return [[] for _ in texts]
        data = np.frombuffer(whole, np.uint8)
        at = np.flatnonzero(self._is_cut(whole, data)) + 1
        marked = np.full(len(data) + len(at), _CUT, np.uint8)
        places = np.ones(len(marked), bool)
        places[at + np.arange(len(at))] = False
        marked[places] = data
        mark = bytes([_CUT])
        return [t.split(mark) if t else [] for t in marked.tobytes().split(bytes([_END]))]

    def encode(self, texts: list[bytes]) -> list[list]:
        """For each text the entries of its fragments in order."""
        if not texts:
            return []
        pieces = self.fragments(texts)
        if len(self.cache) > self.kept:
            self.cache.clear()
        get = self.cache.get
        found = [list(map(get, p)) for p in pieces]
        open_texts = [k for k, f in enumerate(found) if None in f]
        if open_texts:
            self._learn({p for k in open_texts for p, f in zip(pieces[k], found[k]) if f is None})
            for k in open_texts:
                found[k] = list(map(self.cache.__getitem__, pieces[k]))
        return found

    def encode_flat(self, texts: list[bytes], tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by `tail`, and how many each text has then.

        Arrow numbers the different fragments, and only those are looked up one by one. Needs an encoder
        of `ids_only` entries.
        """
        pieces, first = self._spans(texts)
        coded = pieces.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.cache) > self.kept:
            self.cache.clear()
        self.cache[_END_PIECE] = tail
        new = {p for p in different if p not in self.cache}
        if new:
            self._learn(new)
        entries = list(map(self.cache.__getitem__, different))
        flat = np.frombuffer(b"".join(entries), "<u4")
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) >> 2
        number = coded.indices.to_numpy()
        counts = sizes[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat[ranges((np.cumsum(sizes) - sizes)[number], counts)], np.diff(ends[first])

    def _spans(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The fragments of all texts, each text's followed by the end byte, as one Arrow array, and where each text's begin (one more entry: the end)."""
        whole = bytes([_END]).join([*texts, b""])
        if len(whole) >= 1 << 31 or (self.split is not None and self.split.search(whole)):
            listed = [[*self.fragments([t])[0], _END_PIECE] for t in texts]
            return pa.array([p for f in listed for p in f], pa.large_binary()), np.cumsum([0, *map(len, listed)])
        data = np.frombuffer(whole, np.uint8)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        begins = np.concatenate([[0], stops])
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = self._is_cut(whole, data)
        edge[begins] = edge[stops - 1] = True
        edges = np.flatnonzero(edge).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(whole)])
        return pieces, np.searchsorted(edges, begins)

    def _learn(self, new: set[bytes]) -> None:
        spaced = [p for p in new if p[0] == 32 and p not in self.special]
        alone = [p for p in new if p[0] != 32 or p in self.special]
        # A fragment that ends in white space would lean on what follows it.
        alone += [p for p in spaced if p[-1] in _WHITE or p[-1] >= 128]
        spaced = [p for p in spaced if not (p[-1] in _WHITE or p[-1] >= 128)]
        groups = [spaced[k : k + _TOGETHER] for k in range(0, len(spaced), _TOGETHER)] + [[p] for p in alone]
        encoded = self.library.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)
        order = [p for g in groups for p in g]
        ids = [i for one in encoded for i in one.ids]
        flat = np.array(ids, "<u4")
        token_ends = np.cumsum(self.token_sizes[flat])
        ends = np.cumsum([len(p) for p in order])
        last = np.searchsorted(token_ends, ends)
        if len(order) and not (token_ends[last] == ends).all():
            raise ValueError("a token crosses a forced boundary")
        raw, begin = flat.tobytes(), 0
        for piece, stop in zip(order, (last + 1).tolist()):
            self.cache[piece] = self.entry(self, ids[begin:stop], raw[4 * begin : 4 * stop])
            begin = stop

    def decode(self, ids) -> str:
        """Text of a sequence of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


def ids_only(encoder: FragmentEncoder, ids: list[int], raw: bytes) -> bytes:
    return raw


def full_entry(encoder: FragmentEncoder, ids: list[int], raw: bytes) -> tuple[bytes, bytes, bytes]:
    """Ids in binary, decimal ids joined by commas, bytes of the tokens."""
    return raw, b",".join([encoder.decimals[i] for i in ids]), b"".join([encoder.tokens[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str, entry=full_entry) -> FragmentEncoder:
    """The worker's own encoder, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return FragmentEncoder(path, entry)


def _encoded(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_sha256", pa.string()), ("decoded", pa.string())])

    def run(batches):
        bpe = encoder(path)
        for batch in chunked(batches, "text"):
            out = [[], [], [], []]
            for found in bpe.encode(text_bytes(batch.column("text"))):
                binary, decimal, raw = zip(*found) if found else ((), (), ())
                ids = b"".join(binary)
                for column, value in zip(out, (len(ids) >> 2, ids, sha256(b",".join(decimal)).hexdigest(), b"".join(raw).decode("utf-8", "replace"))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(out, schema.types[1:]))], schema=schema)

    return run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded string"


def encode_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (little-endian 32-bit), ids_sha256 (of the decimal ids joined by commas), decoded."""
    rows = docs.select(row_id(ident).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(*_encoded(vocabulary or default_vocabulary())).withColumn("doc_id", shown_id(F.col("doc_id")))


def decode_ids(rows: DataFrame, ident: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: doc_id and the text of its ids (little-endian 32-bit); null ids are none."""
    path = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(b or b"", "<u4")) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], schema=schema)

    done = rows.select(row_id(ident).alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded string")
    return done.withColumn("doc_id", shown_id(F.col("doc_id")))
