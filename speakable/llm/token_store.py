"""Token ids on disk: one zstandard frame per document under a shared dictionary.

A store is a folder with two Parquet tables that any Spark file system holds:

* ``dictionary``: one row with the shared dictionary, its hash and the width
  of an id in bytes;
* ``segments``: one row per run of documents in ascending id order. Its
  ``payload`` is a header (magic, dictionary hash, number of documents), an
  index with one entry per document (id, whether the id is null, offset of
  its frame, bytes of its frame, number of ids) and the frames. Each
  document is compressed on its own, so a short document is read by slicing
  one frame; ``first_id`` and ``last_id`` let the scan skip other segments.

The dictionary is trained on at most ``sample_blocks`` blocks of at most
``block_ids`` ids, picked by hash; it changes sizes only, never content.

Defined cases: a null or empty text holds the end id alone; null document
ids come first; rows that repeat an id are all kept, side by side, in the order
of the hash of their texts; texts of any length are one frame; an empty table
gives a store without segments.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, sample_ids, steps
from .words import FIRST, WHOLE, Parts, WordCoder

MAGIC = b"TOKSEG1\0"
HEAD = struct.Struct("<8s16sI")
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u4")])
SEGMENT_BYTES = 4_000_000
LEVEL = 3
# The split pattern of byte-level tokenizers, and the characters that stand for the 256 bytes.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
# The rules of plain byte-level tokenizer files.
BYTE_SPEC = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
#: Bytes of text that are coded together.
STEP_BYTES = 6_000_000
#: Words, and parts of words, that a worker keeps the ids of.
KEPT_WORDS, KEPT_PARTS = 200_000, 300_000


class BpeEncoder:
    """Ids of a text by the tokenizers library, cut so that equal words are encoded once.

    The pre-tokenizer starts a new token at every space that follows a
    non-blank character, so what stands between such spaces is independent.
    A word that is new is cut further, by the pre-tokenizer's own pattern, and the
    library's merge model codes each part that is new. Files that ask for
    another normalizer or pre-tokenizer are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        by_word = all(spec[k] == v for k, v in BYTE_SPEC.items())
        ids = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(ids.values()) < 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.coder = WordCoder(self._encode, self.dtype, lambda text: not by_word or any(s in text for s in special), KEPT_WORDS)
        self.parts = Parts(self._part, KEPT_PARTS)

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            chars = part.replace(" ", BYTE_CHARS[32])
        else:
            chars = part.encode().decode("latin-1").translate(BYTE_CHARS)
        return array(self.dtype.char, [t.id for t in self.tokenizer.model.tokenize(chars)]).tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        out, part = [], self.parts.__getitem__
        for word in words:
            mark = word[:1]
            if mark == WHOLE:
                ids = self.tokenizer.encode(word[1:], add_special_tokens=False).ids
                out.append(np.array(ids, self.dtype).tobytes())
                continue
            piece = word[1:] if mark == FIRST else " " + word
            if word.isalpha():
                out.append(part(piece))
            else:
                out.append(b"".join(map(part, (_ASCII if word.isascii() else PATTERN).findall(piece))))
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.coder(texts)


def encoder(path: str, _made: dict = {}) -> BpeEncoder:  # noqa: B006
    """One encoder per worker process and tokenizer file."""
    if path not in _made:
        _made[path] = BpeEncoder(path)
    return _made[path]


def pack_segment(ids: list[int | None], counts: list[int], frames: list[bytes], dict_hash: bytes) -> bytes:
    index = np.zeros(len(ids), ENTRY)
    index["doc_id"] = [0 if i is None else i for i in ids]
    index["null"] = [i is None for i in ids]
    index["size"] = [len(f) for f in frames]
    index["offset"] = np.r_[0, np.cumsum(index["size"][:-1], dtype=np.uint64)]
    index["n_tokens"] = counts
    return HEAD.pack(MAGIC, dict_hash, len(ids)) + index.tobytes() + b"".join(frames)


def open_segment(payload: bytes, dict_hash: bytes) -> tuple[np.ndarray, memoryview]:
    """Index and frames; raises if the segment was packed with another dictionary."""
    magic, packed_with, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    if packed_with != dict_hash:
        raise ValueError("the segment was packed with another dictionary")
    start = HEAD.size + n * ENTRY.itemsize
    return np.frombuffer(payload, ENTRY, n, HEAD.size), memoryview(payload)[start:]


def _hash(dictionary: bytes) -> bytes:
    import hashlib

    return hashlib.md5(dictionary, usedforsecurity=False).digest()


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def _unpacker(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def train_dictionary(docs: DataFrame, tokenizer: str, sample_rows: int, sample_blocks: int, block_ids: int, dict_bytes: int) -> bytes:
    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        code = encoder(tokenizer)
        found = code([t or "" for t in texts])
        return pd.Series([[d[i : i + block_ids].tobytes() for i in range(0, len(d), block_ids)] for d in found])

    # The ids are picked on their own, so that no text is sorted; sample_rows bounds the broadcast.
    picked = sample_ids(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "doc_id", sample_rows)
    rows = docs.join(F.broadcast(picked), "doc_id")
    blocks = rows.select("doc_id", F.posexplode(cut("text")).alias("pos", "block"))
    picked = blocks.orderBy(F.xxhash64("doc_id", "pos"), "doc_id", "pos").limit(sample_blocks)
    samples = [bytes(r.block) for r in picked.select("block").collect()]
    size = min(dict_bytes, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 2048:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    sample_rows: int = 2000,
    sample_blocks: int = 4000,
    block_ids: int = 1024,
    dict_bytes: int = 64_000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write a store to ``path``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, sample_rows, sample_blocks, block_ids, dict_bytes)
    dict_hash = _hash(dictionary)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, packer = encoder(tokenizer), _packer(dictionary)
        end = np.array([end_id], code.dtype).tobytes()
        ids, counts, frames, size, local, seq = [], [], [], 0, 0, 0

        def segment() -> pd.DataFrame:
            known = [i for i in ids if i is not None]
            row = (seq, local, sum(counts), min(known, default=None), max(known, default=None), pack_segment(ids, counts, frames, dict_hash))
            return pd.DataFrame([row], columns=["seq", "local_start", "n_tokens", "first_id", "last_id", "payload"]).astype({"first_id": "Int64", "last_id": "Int64"})

        for batch in batches:
            keys = [None if k is None else int(k) for k in batch["doc_id"]]
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for at, run in steps(batch["text"], STEP_BYTES):
                for key, found in zip(keys[at : at + len(run)], code(texts[at : at + len(run)]), strict=True):
                    data = found.tobytes() + end
                    frame = packer.compress(data)
                    ids.append(key)
                    counts.append(len(data) // code.dtype.itemsize)
                    frames.append(frame)
                    size += len(frame)
                    if size >= SEGMENT_BYTES:
                        yield segment()
                        local, seq = local + sum(counts), seq + 1
                        ids, counts, frames, size = [], [], [], 0
        if ids:
            yield segment()

    width = encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(bytearray(dictionary), bytearray(dict_hash), width)], "dictionary binary, hash binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()
    )
    # Ids travel as text: pandas would hold a column of integers with nulls as floats.
    made = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(pack, "seq int, local_start long, n_tokens long, first_id long, last_id long, payload binary")
    # Payloads are compressed already.
    made.withColumn("part", F.spark_partition_id()).write.option("compression", "uncompressed").parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, bytes, np.dtype]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return bytes(row.dictionary), bytes(row.hash), np.dtype(f"<u{row.width}")


def read_store(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """All documents: doc_id, start (ids before it), n_tokens, ids as little-endian bytes of ``<u4``.

    With ``digest`` their unsigned crc32 stands in place of the ids.
    """
    dictionary, dict_hash, dtype = _dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    # One row per partition of the writer, whatever the size of the table: a proven bound.
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("local_start")).alias("start"), "payload")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = _unpacker(dictionary)
        for batch in batches:
            for first, payload in zip(batch["start"], batch["payload"], strict=True):
                index, frames = open_segment(payload, dict_hash)
                start = int(first) + np.r_[0, np.cumsum(index["n_tokens"][:-1], dtype=np.int64)].astype(np.int64)
                for at in range(0, len(index), 256):
                    part = index[at : at + 256]
                    ids = [
                        np.frombuffer(unpacker.decompress(frames[int(o) : int(o) + int(s)]), dtype).astype("<u4").tobytes()
                        for o, s in zip(part["offset"], part["size"], strict=True)
                    ]
                    doc_id = pd.Series(part["doc_id"].astype(np.int64)).astype("Int64").mask(part["null"] == 1)
                    last = {"ids_crc32": [zlib.crc32(x) for x in ids]} if digest else {"ids": ids}
                    yield pd.DataFrame({"doc_id": doc_id, "start": start[at : at + 256], "n_tokens": part["n_tokens"].astype(np.int64), **last})

    return placed.mapInPandas(unpack, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
    """The ids of a few documents: only segments that can hold them are read, only their frames are unpacked."""
    dictionary, dict_hash, dtype = _dictionary(spark, path)
    wanted = sorted({int(i) for i in doc_ids})
    hit = F.lit(False)
    for i in wanted:
        hit = hit | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    unpacker, found = _unpacker(dictionary), {i: [] for i in wanted}
    for row in spark.read.parquet(f"{path}/segments").filter(hit).select("payload").toLocalIterator():
        index, frames = open_segment(bytes(row.payload), dict_hash)
        for e in index[np.isin(index["doc_id"], wanted) & (index["null"] == 0)]:
            frame = frames[int(e["offset"]) : int(e["offset"]) + int(e["size"])]
            found[int(e["doc_id"])].append(np.frombuffer(unpacker.decompress(frame), dtype))
    return found


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace the ids by their unsigned crc32."""
    crc = F.pandas_udf(lambda ids: ids.map(zlib.crc32), "long")
    return tokens.withColumn("ids_crc32", crc("ids")).drop("ids")


def stored_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, digest: bool = False) -> DataFrame:
    """Write a store (to the shared folder unless a path is given) and read it back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return read_store(spark, path, digest)
