"""Token ids in length-delimited binary records with an offset index.

A shard file is a run of frames, one for each document, in ascending doc_id order:

    uint64 length | uint32 masked CRC-32 of those 8 bytes | payload | uint32 masked CRC-32 of the payload

all little-endian; the payload holds the ids, two bytes each where the vocabulary has
at most 65,536 ids, else four. The mask rotates a checksum right by 15 bits and adds
0xA282EAD8, so that checksums of data that hold checksums stay useful. Beside the
shards a Parquet table has one row for each document: shard, offset, length, doc_id,
number of ids and the number of ids before it, so a reader can take any documents in
any order.

Documents are dealt by ranges of doc_id; each task writes one shard under a private
name and renames it, so a task that runs twice leaves the same file. Null ids come
first, equal ids are ordered by a hash of the text, null text is encoded as empty.
Other columns are ignored, an empty table gives an index without rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from waymark.llm.bpe import encoder
from waymark.llm.tables import lookup, partitions_for, shared_folder, written

INDEX = "shard long, offset long, length long, doc_id {id}, n_tokens long, before long"
HEAD, TAIL, MASK = 12, 4, 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes) -> bytes:
    """The payload of a frame; a ValueError where a length or checksum is wrong."""
    size, payload = data[:8], data[HEAD:-TAIL]
    if len(data) < HEAD + TAIL or int.from_bytes(data[8:HEAD], "little") != masked(size) or int.from_bytes(size, "little") != len(payload):
        raise ValueError("a record's length is damaged")
    if int.from_bytes(data[-TAIL:], "little") != masked(payload):
        raise ValueError("a record's ids are damaged")
    return payload


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder, as tasks and the driver both see it."""
    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, end: int | None = 2, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", batch: int = 1000) -> DataFrame:
    """Encode and write the documents below folder (default: the shared one); the index with a column `file` comes back."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")
    kind = docs.schema[doc_id].dataType.simpleString()
    store, root = opened(folder)
    store.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = encoder(tokenizer), TaskContext.get()
        tail = b"" if end is None else np.array([end], tokens.type).tobytes()
        files, path = opened(folder)
        number, private = task.partitionId(), f"{path}/.{task.taskAttemptId()}"
        place = before = 0
        with files.open_output_stream(private) as out:
            for rows in batches:
                for at in range(0, len(rows), batch):
                    part = rows.slice(at, batch)
                    data = [ids.tobytes() + tail for ids in tokens.encode(part.column("text"))]
                    size = np.array([len(x) for x in data], np.int64)
                    count, length = size // tokens.type.itemsize, size + HEAD + TAIL
                    out.write(b"".join(map(frame, data)))
                    columns = {"shard": np.full(len(data), number, np.int64), "offset": place + np.cumsum(length) - length, "length": length, "doc_id": part.column("doc_id"),
                               "n_tokens": count, "before": before + np.cumsum(count) - count}
                    yield pa.RecordBatch.from_pydict(columns)
                    place, before = place + int(length.sum()), before + int(count.sum())
        files.move(private, f"{path}/shard-{number:07d}.rec")

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    parts = partitions_for(spark, docs.rdd.getNumPartitions(), 1)
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    index = written(dealt.mapInArrow(shard, INDEX.format(id=kind)), "record-index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))  # a row for each shard
    first = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("first"))
    return (index.join(lookup(written(first, "record-shards")), "shard")
            .select("doc_id", "shard", "offset", "length", "n_tokens", (F.col("first") + F.col("before")).alias("start"),
                    F.format_string(f"{folder}/shard-%07d.rec", "shard").alias("file")))


def _payloads(rows: pd.DataFrame) -> Iterator[np.ndarray]:
    """The ids of the index rows, which may be any rows in any order."""
    files, _ = opened(rows["file"].iloc[0])
    handles = {}
    for file, offset, length, count in zip(rows["file"], rows["offset"], rows["length"], rows["n_tokens"]):
        if file not in handles:
            handles[file] = files.open_input_file(opened(file)[1])
        payload = unframe(handles[file].read_at(length, offset))
        yield np.frombuffer(payload, f"<u{len(payload) // count}" if count else "<u2")
    for handle in handles.values():
        handle.close()


def read(index: DataFrame) -> DataFrame:
    """The index rows (or some of them) with their ids as an array."""
    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), 200):
                part = rows.iloc[at:at + 200]
                yield part.assign(ids=[x.astype(np.int32) for x in _payloads(part)])
    return index.mapInPandas(ids, f"{', '.join(f'`{c}` {t}' for c, t in index.dtypes)}, ids array<int>")


def digests(index: DataFrame) -> DataFrame:
    """The index rows with `ids_crc32`, the CRC-32 of the ids read back as unsigned 32-bit little-endian numbers."""
    def crc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(ids_crc32=[zlib.crc32(x.astype("<u4").tobytes()) for x in _payloads(rows)] if len(rows) else [])
    return index.mapInPandas(crc, f"{', '.join(f'`{c}` {t}' for c, t in index.dtypes)}, ids_crc32 long")
