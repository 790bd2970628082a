"""Token ids in binary files: blocks of ids as bit or byte planes, each compressed, with a chunk index."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import grouped, quoted, shuffle_partitions, stored, text_or_empty, tidied
from .vocabularies import check_splitting
from .words import WordIds

MAGIC = b"IDPLANE1"
HEADER = struct.Struct("<8sQIB3x")  # magic, ids, ids a chunk, bits a plane (1 or 8)
#: Ids of one chunk.
CHUNK = 1 << 16
#: Ids after which a file ends, with the document that reaches them.
FILE_IDS = 1 << 20
TOGETHER = 6_000_000


def pack_ids(ids: np.ndarray, chunk: int = CHUNK, bits: int = 8, level: int = 3) -> bytes:
    """A file of ids: header, planes of each chunk, index.

    A chunk's little-endian 32-bit ids are transposed into 4 byte planes (``bits`` 8) or 32 bit planes (1); each is
    compressed alone, and planes that are all zero take a few bytes. The index at the end has every chunk's place and
    the sizes of its planes, and the last 8 bytes are the index's place.
    """
    ids = np.ascontiguousarray(ids, "<u4")
    squeeze = zstandard.ZstdCompressor(level=level).compress
    parts, index = [HEADER.pack(MAGIC, len(ids), chunk, bits)], []
    place = HEADER.size
    for start in range(0, len(ids), chunk):
        octets = ids[start : start + chunk].view(np.uint8).reshape(-1, 4)
        if bits == 8:
            planes = np.ascontiguousarray(octets.T)
        else:
            planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
        blobs = [squeeze(plane.tobytes()) for plane in planes]
        sizes = np.array([len(blob) for blob in blobs], "<u4")
        index.append(struct.pack("<Q", place) + sizes.tobytes())
        parts += blobs
        place += int(sizes.sum())
    return b"".join([*parts, *index, struct.pack("<Q", place)])


def unpack_ids(file: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from ``start`` to ``stop`` of a file of ids; only the chunks that hold them are read."""
    magic, n, chunk, bits = HEADER.unpack_from(file)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    planes = 32 // bits
    entry = 8 + 4 * planes
    (index,) = struct.unpack_from("<Q", file, len(file) - 8)
    expand = zstandard.ZstdDecompressor().decompress
    found = []
    for k in range(start // chunk, (stop - 1) // chunk + 1):
        (place,) = struct.unpack_from("<Q", file, index + k * entry)
        sizes = np.frombuffer(file, "<u4", planes, index + k * entry + 8).tolist()
        count = min(chunk, n - k * chunk)
        rows = []
        for size in sizes:
            rows.append(np.frombuffer(expand(file[place : place + size]), np.uint8))
            place += size
        if bits == 8:
            octets = np.ascontiguousarray(np.stack(rows).T)
        else:
            octets = np.packbits(np.unpackbits(np.stack(rows), axis=1, count=count, bitorder="little").T, axis=1, bitorder="little")
        found.append(np.ascontiguousarray(octets).view("<u4").reshape(-1))
    first = start // chunk * chunk
    return np.concatenate(found)[start - first : stop - first].astype(np.uint32)


@lru_cache(maxsize=4)
def _library_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    return WordIds(encode, special)


def _bytes(ids: np.ndarray) -> bytes:
    """Ids on their way to a file: the bytes an id takes, 2 if all fit and else 4, then the ids."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype("<u4")


def encoded(docs: DataFrame, vocabulary: str, end: int | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tie, ids): each whole text's ids by the tokenizers library, with ``end`` appended, as binary (see ``_bytes``).

    The library encodes each distinct word of its byte-level splitting rule once. tie: a hash of the text, which orders
    rows of equal id. A file with another splitting rule is an error.
    """
    check_splitting(vocabulary)
    kind = docs.schema[id].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _library_ids(vocabulary)
        last = np.array([] if end is None else [end], "<u4")
        for group in grouped(batches, "text", TOGETHER):
            table = pa.Table.from_batches(group).combine_chunks()
            texts = table.column("text").to_pylist()
            blobs = pa.array([_bytes(np.concatenate([x.astype("<u4"), last])) for x in ids_of(texts)], pa.binary())
            columns = [table.column(name).combine_chunks() for name in ("id", "tie")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, blobs], ["id", "tie", "ids"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())])
    source = docs.select(quoted(id).alias("id"), F.xxhash64(text_or_empty(text)).alias("tie"), text_or_empty(text).alias("text"))
    return source.mapInArrow(tidied(encode), schema)


def write_token_files(
    docs: DataFrame, vocabulary: str, *, end: int | None = None, id: str = "doc_id", text: str = "text", bits: int = 8,
    file_ids: int = FILE_IDS, chunk: int = CHUNK,
) -> DataFrame:
    """Writes the ids of all texts in ascending order of ``id``; one row a file: part, file, n_ids, ids, sizes, data.

    Rows are encoded once and written to the shared folder, dealt out by ranges of (id, hash of the text), so that
    neither a frequent id nor long texts crowd one range, sorted, and packed one file of about ``file_ids`` ids after
    the other. ``data`` is the file (see ``pack_ids``); ``ids`` and ``sizes`` list its documents. Files are values of a
    table that Spark's own writer commits, so a lost executor leaves no half of one, in whatever store the shared folder
    is. (part, file) gives their order. A null text is empty and has the end id alone; null ids come first; rows of
    equal id follow the hash of their text; no rows, no files.
    """
    kind = docs.schema[id].dataType
    rows = stored(encoded(docs, vocabulary, end, id, text))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id", "tie").sortWithinPartitions("id", "tie")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys, sizes, held, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            lists = pa.array([pa.concat_arrays(keys).tolist()], pa.list_(keys[0].type))
            data = pack_ids(np.concatenate([_ids(blob) for blob in held]), chunk, bits)
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), lists,
                       pa.array([sizes], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "file", "n_ids", "ids", "sizes", "data"])

        for batch in batches:
            column = batch.column(0)
            for at, blob in enumerate(batch.column(2).to_pylist()):
                keys.append(column.slice(at, 1))
                sizes.append((len(blob) - 1) // blob[0])
                held.append(blob)
                size += sizes[-1]
                if size >= file_ids:
                    yield close()
                    number += 1
                    keys, sizes, held, size = [], [], [], 0
        if keys:
            yield close()

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("n_ids", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType()),
        ]
    )
    return stored(rows.mapInArrow(pack, schema))


def read_token_files(files: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files.

    start: the ids of all documents before it. Files are counted within their range first and ranges among one another,
    as many as there were partitions, last.
    """
    kind = files.schema["ids"].dataType.elementType

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                part, file, _, keys, sizes, data = (column[at] for column in batch.columns)
                sizes = np.array(sizes.as_py(), np.int64)
                ids = unpack_ids(data.as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(sizes.tolist(), ends.tolist())]
                n = len(sizes)
                columns = [pa.array([part.as_py()] * n, pa.int32()), pa.array([file.as_py()] * n, pa.int32()), keys.values,
                           pa.array(ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "file", "id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), T.StructField("id", kind),
            T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        ]
    )
    sizes = files.select("part", "file", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), nothing).alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("file")), nothing)
    offsets = sizes.select("part", "file", within.alias("file_start")).join(parts, "part")
    rows = files.select("part", "file", "n_ids", "ids", "sizes", "data").mapInArrow(read, schema)
    return rows.join(offsets, ["part", "file"]).select(
        F.col("id").alias(id), (F.col("part_start") + F.col("file_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
