"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of records, each

    8 bytes  length of the payload, little-endian
    4 bytes  masked CRC-32 of those 8 bytes
    payload
    4 bytes  masked CRC-32 of the payload
    1 byte   0x0A

and a payload is: 1 byte flags (1: the key is null; 2: ids take four bytes, else two), 8 bytes key, 8 bytes
number of ids, the ids. A mask rotates a CRC right by 15 bits and adds a constant, so that the CRC of a
payload that itself holds CRCs stays a good one. Files hold ascending keys, and so do their part numbers.

The index (Parquet: part, path, ordinal, key, offset, length, n_tokens, start, ids_crc32) gives each record's
place: a shuffled read takes any rows of it and reads length bytes at offset.

Spark's text writer puts the records down (a string column made of bytes is written as it is, each row
followed by the byte 0x0A) and its binaryFile reader takes them up, so any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.llm.tokens import encoder as shared_encoder
from trackmill.llm.tokens import slices, small_batches
from trackmill.shared import materialize, new_path

HEAD, KEY = struct.Struct("<QI"), struct.Struct("<BqQ")
CRC_MASK = 0xA282EAD8
#: Bytes of text that go to one data file, about; a file is read whole.
FILE_BYTES = 24 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + CRC_MASK) & 0xFFFFFFFF


def record(key: int | None, ids: np.ndarray) -> bytes:
    """One record without its last byte."""
    payload = KEY.pack((key is None) | 2 * (ids.dtype.itemsize == 4), key or 0, len(ids)) + ids.tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def records(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, key and ids of each record of a file; ValueError where it is damaged."""
    at, end = 0, len(content)
    while at < end:
        if at + HEAD.size > end:
            raise ValueError(f"record at {at}: cut off")
        length, crc = HEAD.unpack_from(content, at)
        if masked(content[at : at + 8]) != crc:
            raise ValueError(f"record at {at}: its length is damaged")
        body = at + HEAD.size
        payload = content[body : body + length]
        stop = body + length + 5
        if stop > end or struct.unpack_from("<I", content, body + length)[0] != masked(payload) or content[stop - 1] != 10:
            raise ValueError(f"record at {at}: its payload is damaged")
        flags, key, n = KEY.unpack_from(payload)
        yield at, stop - at, None if flags & 1 else key, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, KEY.size)
        at = stop


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every text (null: empty), append end_id and write data files in ascending order of key to path.

    Null keys come first; rows of one key are in order of their text; other columns are not read. The number
    of files follows the bytes of text. Rows are dealt by ranges of key and a hash of the text, so that the
    rows of one repeated key can go to several files.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        last = np.array([end_id], encoder.dtype)
        for batch in slices(batches):
            keys = batch.column("key").to_pylist()
            out, size = [], 0
            for k, ids in zip(keys, encoder.encode(batch.column("text").to_pylist()), strict=True):
                out.append(record(k, np.concatenate([ids, last])))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "key", "h").sortWithinPartitions("key", "h", "text")
    made = dealt.select("key", "text").mapInArrow(encode, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 0).text(path)  # a part is one file


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read the data files at path and return their index, with the ids that precede each record's in its file as before."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                columns: list[list] = [[] for _ in range(7)]
                before = 0
                for i, (offset, length, key, ids) in enumerate(records(content.as_buffer().to_pybytes())):
                    for c, v in zip(columns, (i, key, offset, length, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        c.append(v)
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["path", "ordinal", "key", "offset", "length", "n_tokens", "before", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = files.mapInArrow(parse, "path string, ordinal long, key long, offset long, length long, n_tokens long, before long, ids_crc32 long")
    return rows.withColumn("part", F.regexp_extract("path", r"part-(\d+)", 1).cast("long"))


def build_index(spark: SparkSession, path: str, index_path: str | None = None) -> DataFrame:
    """Index of all data files at path, written to index_path too; start: ids of all records before it."""
    rows = materialize(read_index(spark, path), "record-index")
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    ahead = ends.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    index = rows.join(ahead, "part").select("part", "path", "ordinal", "key", "offset", "length", "n_tokens", (F.col("before") + F.col("ahead")).alias("start"), "ids_crc32")
    if index_path:
        index.write.parquet(index_path)
        index = spark.read.schema(index.schema).parquet(index_path)
    return index


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write docs' records and their index under path (a new folder of the shared one by default); returns the index read from the files.

    Empty tables give no record. Repeated rows give a record each.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-records")
    write_records(docs, f"{path}/data", tokenizer, end_id, key, text)
    return build_index(spark, f"{path}/data", f"{path}/index")
