"""Token-id shards as sorted string tables.

A shard holds documents in ascending order of their identifier. Its layout, all numbers little-endian:

    block*   zstd frame of: entries, then the offset (u32) of every RESTART-th entry, then their number (u32)
    entry    shared key bytes, own key bytes, value bytes (varints), own key bytes, value
    index    zstd frame of: for each block, last key (varint length, bytes), offset u64, size u32, crc32 u32
    bloom    zstd frame of the Bloom filter's bits
    footer   index offset u64, size u32; bloom offset u64, size u32; hashes u8, bytes of an id u8, docs u64, MAGIC

A key is the identifier plus 2**63 as 8 big-endian bytes; a null identifier has the empty key, which sorts first. A value is
the document's ids with the end id. Within a block a key shares its first bytes with the one before, but for restart
points, between which a lookup searches by halves.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, small_batches, text_or_empty
from .encoding import encoder, tokenizer_path

MAGIC = b"TLSST001"
RESTART = 16
FOOTER = struct.Struct("<QIQIBBQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS = 10
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(key)
    step = (h >> 33) | 1
    return [(h + i * step) % bits for i in range(hashes)]


#: Compressed bytes after which a shard ends.
SHARD_BYTES = 256 << 20


class TableWriter:
    """Writes one shard to a binary stream; keys must not fall."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index, self.keys, self.docs = bytearray(), [], 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.n, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not fall")
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.n, self.last, self.docs = self.n + 1, key, self.docs + 1
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, data = self.at, self.zip.compress(bytes(data))
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _close_block(self) -> None:
        if self.n:
            self.block += struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            crc = zlib.crc32(self.block)
            at, size = self._put(self.block)
            self.index += _varint(len(self.last)) + self.last + struct.pack("<QII", at, size, crc)
            self._open()

    def close(self) -> None:
        self._close_block()
        bits = max(64, len(self.keys) * BLOOM_BITS)
        hashes, bloom = 7, bytearray((bits + 7) // 8)
        for key in set(self.keys):
            for b in _probes(key, hashes, len(bloom) * 8):
                bloom[b >> 3] |= 1 << (b & 7)
        index, filt = self._put(self.index), self._put(bloom)
        self.out.write(FOOTER.pack(*index, *filt, hashes, self.width, self.docs, MAGIC))


class TableReader:
    """Reads a shard from a seekable stream: in order by iterating, one key by get()."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.zip = stream, zstandard.ZstdDecompressor()
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.hashes, self.width, self.docs, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, self.last_keys, self.places, at = self._get(index_at, index_size), [], [], 0
        self.bloom = self._get(bloom_at, bloom_size)
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            self.places.append(struct.unpack_from("<QII", raw, at + n))
            at += n + 16

    def _get(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.zip.decompress(self.stream.read(size))

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...], int]:
        at, size, crc = self.places[i]
        data = self._get(at, size)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        return data, struct.unpack_from(f"<{n}I", data, end), end

    @staticmethod
    def _entry(data: bytes, at: int, last: bytes) -> tuple[bytes, int, int]:
        shared, at = _read_varint(data, at)
        own, at = _read_varint(data, at)
        size, at = _read_varint(data, at)
        return last[:shared] + data[at : at + own], at + own, size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.places)):
            data, _, end = self._block(i)
            at, key = 0, b""
            while at < end:
                key, at, size = self._entry(data, at, key)
                yield key, data[at : at + size]
                at += size

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] & 1 << (b & 7) for b in _probes(key, self.hashes, len(self.bloom) * 8))

    def get(self, key: bytes) -> bytes | None:
        """The value of a key (of the first of equal keys), or None: filter, index, restart points, then at most RESTART entries."""
        import bisect

        if not self.may_have(key) or (i := bisect.bisect_left(self.last_keys, key)) == len(self.places):
            return None
        data, restarts, end = self._block(i)
        low, high = 0, len(restarts)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._entry(data, restarts[mid], b"")[0] < key else (low, mid)
        at, found = restarts[low], b""
        while at < end:
            found, at, size = self._entry(data, at, found)
            if found >= key:
                return data[at : at + size] if found == key else None
            at += size
        return None


def open_path(path: str, mode: str = "rb"):
    """A stream for a path or URI on any file system that pyarrow knows."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "rb":
        return files.open_input_file(inner)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    return files.open_output_stream(inner, compression=None)  # a name in .gz is no wish to compress


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Encodes docs (doc_id, text) and writes a shard for each range of doc_id under folder; returns the shards in order.

    Null texts count as empty; each document ends with end_id. Rows of equal doc_id stand side by side, ordered by
    their text's hash. A shard ends after shard_bytes compressed, so that what a writer holds (keys for the filter, the block index) is bounded
    however large a range is. Each attempt of a task writes a file of its own and the list names those of the attempts that
    counted, so repeated tasks do no harm. The list has one row a shard.
    """

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, out, made = encoder(tokenizer), None, []
        end = np.array([end_id], encode.dtype).tobytes()

        def close() -> None:
            out.close()
            stream.close()
            made.append((TaskContext.get().partitionId(), len(made), path, out.docs, tokens, first, last))

        for part in parts:
            for doc_id, ids in zip(part["doc_id"].tolist(), encode.many(part["text"].tolist()), strict=True):
                if out is None:
                    path, tokens, first = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst", 0, None
                    stream = open_path(path, "wb")
                    out = TableWriter(stream, encode.dtype.itemsize)
                key = key_of(None if doc_id is None or doc_id != doc_id else int(doc_id))
                value = ids + end
                out.add(key, value)
                tokens += len(value) // encode.dtype.itemsize
                first, last = first if first is not None else key, key
                if out.at >= shard_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["part", "n", "path", "docs", "tokens", "first_key", "last_key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # Nullable integers reach pandas as floats, which can't hold every long: a string stands for the identifier.
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(write, "part int, n int, path string, docs long, tokens long, first_key binary, last_key binary").collect()
    return [r.asDict() for r in sorted(made, key=lambda r: (r.part, r.n))]


def read_shards(spark, shards: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document in shards, read from the files, one task a shard."""
    starts, at = [], 0
    for s in shards:
        starts.append((s["path"], at))
        at += s["tokens"]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, start in zip(part["path"], part["start"], strict=True):
                rows: list[tuple] = []
                with open_path(path) as stream:
                    table = TableReader(stream)
                    kind = np.dtype(f"<u{table.width}")
                    for key, value in table:
                        ids = np.frombuffer(value, kind)
                        doc_id = id_of(key)
                        rows.append((None if doc_id is None else str(doc_id), int(start), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                        start += len(ids)
                        if len(rows) >= 20_000:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
                            rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    kind = "doc_id string, start long, n_tokens long, ids_crc32 long, shard string"
    if not starts:
        return spark.createDataFrame([], kind).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Each path goes to a task of its own: createDataFrame deals its rows out evenly over so many slices.
    listed = spark.createDataFrame(spark.sparkContext.parallelize(starts, len(starts)), "path string, start long")
    return listed.mapInPandas(read, kind).withColumn("doc_id", F.col("doc_id").cast("long"))


def lookup(shards: list[dict], doc_id: int | None) -> list[int] | None:
    """The ids of one document: the shard by its key range, then within it filter, index and binary search."""
    key = key_of(doc_id)
    for s in shards:
        if bytes(s["first_key"]) <= key <= bytes(s["last_key"]):
            with open_path(s["path"]) as stream:
                table = TableReader(stream)
                if (found := table.get(key)) is not None:
                    return np.frombuffer(found, f"<u{table.width}").tolist()
    return None


def token_shards(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs as sorted string tables and reads them back: doc_id, start, n_tokens, ids_crc32, shard.

    docs has doc_id and text; other columns are ignored. An empty table gives no shard and no row; an empty or null text
    gives one id, end_id; repeated rows each keep their place.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, folder or scratch(spark, "tokens"), tokenizer or tokenizer_path(), end_id))
