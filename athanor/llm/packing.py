"""Packing along a space-filling curve.

A document's hashed token vector is projected to a few dimensions (fixed random signs per token id),
squashed to a grid and mapped to its Hilbert key.  Documents are range-sorted by that key, so neighbours
on the curve share sequences, and each range is cut into sequences of `length` ids with no gap between
documents.  Only the last sequence of a range can need padding.

Cases: null and empty texts hold the end id alone; equal texts have one key and ties are ordered by id, so a
hot text spreads over many ranges; repeated rows are packed as often as they occur, null ids are carried as null; an
empty table gives no piece; a very long document runs on over as many sequences as it needs; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .kernels import trim
from .scratch import Scratch

DIMS, BITS = 4, 15
#: Tokens that one range holds on average: 8 MB of ids.
RANGE_TOKENS = 4_000_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys along the Hilbert curve of integer points (rows) in [0, 2**bits) per dimension, after
    Skilling's transposition."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0])
            x[0] = x[0] ^ swap
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for one in x:
            key = (key << 1) | (((one ^ turn) >> b) & 1)
    return key


def curve_positions(ids: np.ndarray, ends: np.ndarray, vocabulary: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end, document i up to ends[i]."""
    signs = np.random.Generator(np.random.PCG64(17)).standard_normal((vocabulary, dims)).astype(np.float32)
    starts = np.concatenate(([0], ends[:-1]))
    sums = np.stack([np.add.reduceat(signs[:, d][ids], starts, dtype=np.float64) for d in range(dims)], axis=1)
    mean = sums / (ends - starts)[:, None]
    grid = np.floor((np.tanh(4 * mean) + 1) / 2 * ((1 << bits) - 1)).astype(np.int64)
    return hilbert_keys(grid, bits)


def tokenised(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """(id, key, n, ids as little-endian 16- or 32-bit bytes) of every document."""
    wide = tokens.id_kind(tokenizer_path)
    size = _vocabulary(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [tokens.encode_document(t, tokenizer_path, end_id, wide) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(x) for x in own])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(curve_positions(np.concatenate(own), ends, size)),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([x.tobytes() for x in own], pa.binary()),
                    ],
                    ["id", "key", "n", "ids"],
                )
            trim()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, key long, n long, ids binary")


def _vocabulary(path: str) -> int:
    return tokens._tokenizer(path).get_vocab_size()


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key, and with
    `with_ids` the ids themselves (binary, little-endian unsigned 32-bit)."""
    spark = df.sparkSession
    tokenizer_path = tokenizer_path or tokens.default_path()
    wide = tokens.id_kind(tokenizer_path)
    table = Scratch(spark, "packing").write(tokenised(df, id_col, text_col, tokenizer_path, end_id), "ids")
    total = table.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, math.ceil(total / RANGE_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "sequence", "offset", "ids")}
            for i, raw in enumerate(batch.column(3)):
                ids = np.frombuffer(raw.as_buffer(), dtype=wide).astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at, length)
                    n = min(length - offset, len(ids) - start)
                    piece = ids[start : start + n].tobytes()
                    for k, v in zip(rows, (i, start, n, zlib.crc32(piece), base + sequence, offset, piece if with_ids else None)):
                        rows[k].append(v)
                    start, at = start + n, at + n
            row = pa.array(rows["row"], pa.int64())
            out = [batch.column(0).take(row), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")), batch.column(2).take(row), *(pa.array(rows[k], pa.int64()) for k in ("sequence", "offset")), batch.column(1).take(row)]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows["ids"], pa.binary())] * with_ids, names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"] + ["ids"] * with_ids
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long" + ", ids binary" * with_ids
    return table.repartitionByRange(ranges, "key", "id").sortWithinPartitions("key", "id").mapInArrow(run, schema)
