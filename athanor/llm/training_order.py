"""Training-order materialisation of token sequences.

Documents of a scan partition run end to end and are cut into sequences of `length` ids; sequence number i of
all partitions together gets slot P(i), where P is a keyed Feistel network over the smallest even number of
bits, walked along its cycle until it lands below the number of sequences.  P is a permutation, so slots are
dealt to shards by division alone, without sampling or sorting globally, and every shard file holds its
slots at a fixed stride: slot s lies at (s - first slot) * stride, which makes reads sequential and resumable.

Sequences are written once, compressed, so that they can be counted before they are dealt; the exchange and
the shards follow from that table.

Cases: null and empty texts hold the end id alone; the last sequence of a partition is padded; repeated rows
are written as often as they occur, null ids are carried as null; an empty table gives no shard and no row; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import tokens
from .kernels import U64, mix64
from .scratch import Scratch


@dataclass(frozen=True)
class Order:
    length: int = 2048
    key: int = 0x0DDBA11
    rounds: int = 6
    end_id: int = 1
    pad_id: int = 0
    shard_slots: int = 4096


def feistel(x: np.ndarray, count: int, key: int, rounds: int) -> np.ndarray:
    """The keyed permutation of 0 .. count-1 at the places `x`, by cycle-walking."""
    half = max(1, ((max(count - 1, 1)).bit_length() + 1) // 2)
    low = U64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (1 << 64) - 1))

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> U64(half), v & low
        for k in keys:
            a, b = b, a ^ (mix64(b ^ k) & low)
        return (a << U64(half)) | b

    out = once(np.asarray(x, U64))
    outside = np.flatnonzero(out >= count)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= count]
    return out.astype(np.int64)


#: More scan partitions than this are joined by a shuffle with the numbers of their first sequences.
BROADCAST_PARTS = 2_000_000
#: Sequences that are compressed together in the intermediate table.
UNIT = 16


def _sequences(docs: DataFrame, path: str, o: Order, kind: str) -> DataFrame:
    """Units of up to UNIT sequences: part, at (number of the first in its partition), and per sequence its length, crc,
    doc_ids, doc_starts and offsets; `ids` holds all their ids, compressed."""
    wide = tokens.id_kind(path)
    own = to_arrow_type(docs.schema["id"].dataType)
    many = lambda t: pa.list_(pa.list_(t))
    schema = pa.schema([("part", pa.int64()), ("at", pa.int64()), ("n", pa.list_(pa.int64())), ("crc", pa.list_(pa.int64())), ("doc_ids", many(own)), ("doc_starts", many(pa.int64())), ("offsets", many(pa.int64())), ("ids", pa.binary())])

    def unit(ids: np.ndarray, at: int, pieces: list[tuple]) -> pa.RecordBatch:
        n = -(-len(ids) // o.length)
        meta: list[list] = [[[] for _ in range(n)] for _ in range(3)]
        for i, a, b in pieces:
            for s in range(max(a, 0) // o.length, min(n, -(-b // o.length))):
                begin = max(a, s * o.length)
                for column, value in zip(meta, (i, begin - a, begin - s * o.length)):
                    column[s].append(value)
        blobs = [ids[s * o.length : (s + 1) * o.length] for s in range(n)]
        row = TaskContext.get().partitionId(), at, [len(x) for x in blobs], [zlib.crc32(x.astype("<u4").tobytes()) for x in blobs], *meta, zstandard.ZstdCompressor(level=9).compress(ids.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest, pieces, size = 0, np.zeros(0, wide), [], UNIT * o.length
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                fresh = [tokens.encode_document(t, path, o.end_id, wide) for t in batch.column(1).slice(k, 256).to_pylist()]
                begin = len(rest)
                for i, x in zip(batch.column(0).slice(k, 256).to_pylist(), fresh):
                    pieces.append((i, begin, begin + len(x)))
                    begin += len(x)
                rest = np.concatenate([rest, *fresh])
                while len(rest) >= size:
                    yield unit(rest[:size], at, pieces)
                    at, rest = at + UNIT, rest[size:]
                    pieces = [(i, a - size, b - size) for i, a, b in pieces if b > size]
        if len(rest):
            yield unit(rest, at, pieces)

    lists = f"doc_ids array<array<{kind}>>, doc_starts array<array<long>>, offsets array<array<long>>"
    return docs.mapInArrow(run, f"part long, at long, n array<long>, crc array<long>, {lists}, ids binary")


def write_training_order(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, o: Order = Order()) -> DataFrame:
    """Write the shards and return one row per sequence: slot, shard, position (byte offset in its shard), length
    (ids before padding), ids_crc32, and the pieces in it: doc_ids, doc_starts (ids of the document before the
    piece) and offsets.

    Shards are files named by their number under `folder` (by default in the shared scratch folder), of
    little-endian unsigned ids, 16-bit where the vocabulary allows.  A file appears under its name when whole.
    """
    spark = df.sparkSession
    path = tokenizer_path or tokens.default_path()
    scratch = Scratch(spark, "order")
    folder = (folder or scratch.path("shards")).rstrip("/")
    wide = tokens.id_kind(path)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    table = scratch.write(_sequences(docs, path, o, kind), "sequences")
    # One row per scan partition, of which the driver plans as many tasks anyway.
    counted = table.groupBy("part").agg(F.sum(F.size("n")).alias("sequences"))
    parts, count = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("sequences"), F.lit(0))).first()
    before = F.sum("sequences").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    table = table.join(F.broadcast(offsets) if parts <= BROADCAST_PARTS else offsets, "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in batches:
            for k in range(batch.num_rows):
                _, at, n, crc, *meta, ids, first = (c[k].as_py() for c in batch.columns)
                raw = zstandard.ZstdDecompressor().decompress(ids)
                slots = feistel(np.arange(first + at, first + at + len(n)), count, o.key, o.rounds)
                step = o.length * np.dtype(wide).itemsize
                packed = [squeeze.compress(raw[s * step : (s + 1) * step]) for s in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // o.shard_slots), *(pa.array(x, t.value_type) for x, t in zip((n, crc, *meta), batch.schema.types[2:7])), pa.array(packed, pa.binary())], [*names, "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = target = None
        for batch in batches:
            slots, shards, sizes = (batch.column(k).to_pylist() for k in (0, 1, 2))
            for shard, n, ids in zip(shards, sizes, batch.column(7)):
                if shard != name:
                    if out is not None:
                        _finish(out, target)
                    name, target = shard, f"{folder}/shard-{shard:08d}.bin"
                    out = _open(target)
                out.write(zstandard.ZstdDecompressor().decompress(ids.as_buffer()) + np.full(o.length - n, o.pad_id, wide).tobytes())
            position = pa.array([s % o.shard_slots * o.length * np.dtype(wide).itemsize for s in slots], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], position, *batch.columns[2:7]], [*names[:2], "position", *names[2:]])
        if out is not None:
            _finish(out, target)

    names = ["slot", "shard", "length", "ids_crc32", "doc_ids", "doc_starts", "offsets"]
    rest = f"doc_ids array<{kind}>, doc_starts array<long>, offsets array<long>"
    placed = table.mapInArrow(place, f"slot long, shard long, length long, ids_crc32 long, {rest}, ids binary")
    shards = max(1, -(-count // o.shard_slots))
    # Slots are a permutation, so every shard but the last gets exactly shard_slots sequences.
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(write, f"slot long, shard long, position long, length long, ids_crc32 long, {rest}")


def _open(target: str):
    """A file beside `target`, named by the attempt, so that a second attempt can't harm a whole file."""
    sink, place = fs.FileSystem.from_uri(target)
    sink.create_dir(place.rpartition("/")[0], recursive=True)
    return sink.open_output_stream(f"{place}.{TaskContext.get().taskAttemptId()}")


def _finish(out, target: str) -> None:
    out.close()
    sink, place = fs.FileSystem.from_uri(target)
    sink.move(f"{place}.{TaskContext.get().taskAttemptId()}", place)


def read_slots(folder: str, first: int, count: int, width: int = 2, o: Order = Order()) -> np.ndarray:
    """`count` sequences from slot `first` on, as rows: one seek per shard, then sequential reads."""
    out, stride = [], o.length * width
    while count > 0:
        shard, at = divmod(first, o.shard_slots)
        source, place = fs.FileSystem.from_uri(f"{folder}/shard-{shard:08d}.bin")
        with source.open_input_file(place) as f:
            f.seek(at * stride)
            raw = f.read(min(count, o.shard_slots - at) * stride)
        if not raw:
            break
        got = np.frombuffer(raw, f"<u{width}").reshape(-1, o.length)
        out.append(got)
        first, count = first + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros((0, o.length), f"<u{width}")
