"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are ranked by how often they occur over all documents, so that frequent ids take one byte. A block holds a table
of its documents, then two control bits an id (its length in bytes, less one; four ids a control byte), then the data
bytes. Reading looks a control byte up in numpy tables: how many bytes its four ids take, and where they go.

A folder holds ranks.bin (ids by rank, little-endian unsigned 32-bit integers) and files 00000000.ids, ... in ascending
order of doc_id. File: 8 bytes "IDRANK01", then blocks. Block: four little-endian unsigned 64-bit integers (documents,
ids, control bytes, data bytes), doc_id (8 bytes each), a null flag (1 byte each), ids (8 bytes each), control, data.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, gathered, only, scratch, tidy, written
from .tokens import END_ID, default_vocabulary, encoder, slices

MAGIC = b"IDRANK01"
_HEAD = struct.Struct("<4Q")
#: By control byte: the length of each of its four ids, their sum, and which of 16 output bytes are filled.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(1)
FILLED = (np.arange(4)[None, None, :] < LENGTHS[:, :, None]).reshape(256, 16)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks; the last control byte is filled up with zeros, which add one data byte each."""
    r = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    r[: len(ranks)] = ranks
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = r.view(np.uint8).reshape(-1, 16)[FILLED[control]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    c = np.frombuffer(control, np.uint8)
    out = np.zeros((len(c), 16), np.uint8)
    out[FILLED[c]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


def write_block(out, docs: list, ids: list[np.ndarray], rank_of: np.ndarray) -> None:
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    control, data = encode_ranks(rank_of[every])
    out.write(_HEAD.pack(len(docs), len(every), len(control), len(data)))
    out.write(np.array([d or 0 for d in docs], "<i8").tobytes())
    out.write(np.array([d is None for d in docs], np.uint8).tobytes())
    out.write(np.array([len(i) for i in ids], "<u8").tobytes())
    out.write(control)
    out.write(data)


def read_blocks(stream, id_of: np.ndarray):
    """(doc_ids, ids of each) block by block."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(_HEAD.size):
        docs, n, n_control, n_data = _HEAD.unpack(head)
        keys = np.frombuffer(stream.read(8 * docs), "<i8")
        null = np.frombuffer(stream.read(docs), np.uint8)
        sizes = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        control, data = stream.read(n_control), stream.read(n_data)
        ids = id_of[decode_ranks(control, data, n)]
        yield [None if z else int(k) for k, z in zip(keys, null, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if docs else []


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and ids (bytes, of the encoder's width) of every document, each with the end id.

    At its end each task adds a row with `counts` alone: how often it saw each id (64-bit integers by id).
    """

    def run(batches):
        enc = encoder(vocabulary)
        width, total = enc.dtype.itemsize, np.zeros(max(enc.vocab_size, END_ID + 1), np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for batch in gathered(batches):
            for at, size in slices(batch.column(1)):
                part = batch.slice(at, size)
                ids, n = enc.encode(part.column(1))
                total += np.bincount(ids, minlength=len(total))
                ends = (np.concatenate([[0], np.cumsum(n)]) * width).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), raw, pa.nulls(len(part), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return only(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, counts binary")


def ranking(encoded: DataFrame, size: int) -> np.ndarray:
    """Ids by rank, the most frequent first, ties to the smaller id. The driver gets a row for each id of the vocabulary at most."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    total = np.zeros(size, np.int64)
    for r in encoded.where("counts is not null").select("counts").mapInArrow(tidy(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -total)).astype("<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, tokens_per_file: int = 1 << 25, block_docs: int = 256) -> list[tuple[int, int, int]]:
    """Writes the documents' ids below `path`, a folder every executor reaches; returns (file, documents, ids) by file.

    The driver keeps one row for each file. A file is written under another name and then renamed, so a repeated task
    leaves one whole file.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    encoded = written(encode_documents(docs, vocabulary), "ids")
    enc = encoder(vocabulary)
    width, size = enc.dtype.str, max(enc.vocab_size, END_ID + 1)
    id_of = ranking(encoded, size)
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as out:
        out.write(id_of.tobytes())
    total = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // tokens_per_file))
    if total >= 1 << 20:  # so that small inputs use the cores too
        files = max(files, spark.sparkContext.defaultParallelism)

    def run(batches):
        from pyspark import TaskContext

        k, rank_of = TaskContext.get().partitionId(), np.empty(size, np.uint32)
        fs, root = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            rank_of[np.frombuffer(f.read(), "<u4")] = np.arange(size)
        part, n_docs, n_ids = f"{root}/.{k:08d}-{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(part) as out:
            out.write(MAGIC)
            for batch in batches:
                for at in range(0, len(batch), block_docs):
                    cut = batch.slice(at, block_docs)
                    ids = [np.frombuffer(x.as_buffer(), width) for x in cut.column(1)]
                    write_block(out, cut.column(0).to_pylist(), ids, rank_of)
                    n_docs, n_ids = n_docs + len(ids), n_ids + sum(map(len, ids))
        fs.move(part, f"{root}/{k:08d}.ids")
        yield pa.RecordBatch.from_pylist([{"file": k, "docs": n_docs, "ids": n_ids}], pa.schema([("file", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = encoded.where("counts is null").select("doc_id", "ids").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.crc32("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids"), "ids")
    made = sorted(tuple(r) for r in ordered.mapInArrow(tidy(run), "file long, docs long, ids long").collect())
    dropped(spark, encoded)
    return made


def read_token_files(spark: SparkSession, path: str, made: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files; start counts all ids before it."""
    plan, before = [], 0
    for k, docs, ids in made:
        if docs:
            plan.append((k, before))
        before += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not plan:
        return spark.createDataFrame([], schema)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                with fs.open_input_stream(f"{root}/{row['file']:08d}.ids", buffer_size=1 << 20) as f:
                    for docs, ids in read_blocks(f, id_of):
                        n = np.array([len(i) for i in ids], np.int64)
                        first = start + np.cumsum(n) - n
                        start += int(n.sum())
                        crc = [zlib.crc32(i.tobytes()) for i in ids]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(plan, "file long, start long").repartition(len(plan)).mapInArrow(tidy(run), schema)


def token_digests(docs: DataFrame, vocabulary: str | None = None, path: str | None = None) -> DataFrame:
    """Writes token files of documents (doc_id, text) and returns the digests read back from them.

    A null or empty text is its end id alone; a null doc_id sorts first; rows with one doc_id follow each other in order
    of their ids; an empty table gives no files and no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-files")
    return read_token_files(spark, path, write_token_files(docs, path, vocabulary))
