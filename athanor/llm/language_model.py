"""Language-model scoring by deleted interpolation.

    p(w | h) = sum over m of a_bm * c(h_m w) / c(h_m) + b_b * c(w) / N + c_b * 1 / (V + 1)

where h_m is the last m - 1 words, m from 2 to `order`.  The mixture weights depend on the bucket b: the longest context
that was seen and the bucket of its frequency.  They are learned by expectation-maximisation on held-out counts: one fold
of the learning documents is deleted from the counts and its n-grams are predicted from the rest.  The final counts are
those of all learning documents.

Layout.  Texts are written once as chunks of a million tokens, numbered within the chunk.  A chunk lists its distinct words
and n-grams as sorted hashes with their counts, cut into at most `fan` ranges of the hash space, which are exchanged and not
written; a range meets those of all other chunks, and a chunk gets back the totals of what other chunks hold too (what it
alone holds it knows).
Both ways carry distinct n-grams of chunks, not occurrences, and every task handles a chunk or a range of
bounded size.  A corpus that needs more ranges takes more levels: as many chunks as there are ranges are merged in each
range, which makes a larger chunk of about the same size for a part of the hash space, and that is cut again.  So rows
and bytes of a level are in proportion to the corpus, and levels grow with its logarithm to the base `fan`.  What goes
back is in the chunk's own order, so it needs no hashes.

Words are told apart by 64-bit hashes, n-grams by `hash_bits`, whatever the corpus's size.  Ids may have any type.  Cases:
null text counts as empty and is one end token; a null id belongs to the fold of the empty string; repeated rows count as
often as they occur; unseen words have the uniform share; an empty table gives an empty result; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import U64, mix64, slices, text_buffers, trim, words
from .scratch import Scratch, release

END = U64(0x452821E638D01376) & ~U64(1)
PAIR = U64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Interpolation:
    """Folds by crc32 of the id as text: `score_fold` is not learned from, `deleted_fold` is held out for EM."""

    order: int = 3
    folds: int = 5
    score_fold: int = 1
    deleted_fold: int = 2
    buckets: int = 24
    rounds: int = 15
    least: float = 1e-4
    hash_bits: int = 54
    chunk_tokens: int = 1_000_000
    range_entries: int = 700_000
    #: Ranges that a chunk is cut into at most, and about as many chunks are merged to a larger one.
    fan: int = 1024

    def fans(self, size: int) -> list[int]:
        """Cuts of each level for a corpus of so many bytes."""
        ranges = max(1, math.ceil(size / 6 / self.range_entries))
        levels = max(1, math.ceil(math.log(ranges) / math.log(self.fan) - 1e-9))
        return [min(self.fan, math.ceil(ranges ** (1 / levels)))] * levels


def _pack(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=U64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, U64), dtype=U64)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts by their width in bytes and their planes."""
    wide = len(x) and int(x.max()) >= 1 << 32
    return (b"8" if wide else b"4") + _pack(x.astype(np.uint64 if wide else np.uint32))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], np.uint64 if data[:1] == b"8" else np.uint32).astype(np.int64)


def _pack_column(x: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([x], ["x"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _unpack_column(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()["x"].combine_chunks()


def _grams(tokens: np.ndarray, first: np.ndarray, p: Interpolation) -> Iterator[np.ndarray]:
    """For each order from 2 on the hash of each token with those before it; a text begins after ends."""
    whole, edge = tokens, END
    for _ in range(2, p.order + 1):
        before = np.concatenate(([edge], whole[:-1]))
        before[first] = edge
        whole, edge = mix64(before * PAIR + tokens), mix64(np.array([edge * PAIR + END]))[0]
        yield whole >> U64(64 - p.hash_bits)


def _entries(local: np.ndarray, vocabulary: np.ndarray, lengths: np.ndarray, folds: np.ndarray, p: Interpolation):
    """The counts (learning, deleted) of the chunk's words, and per order its distinct n-grams, each token's place among
    them, and their counts."""
    learn = np.repeat(folds != p.score_fold, lengths)
    deleted = np.repeat(folds == p.deleted_fold, lengths)
    count = lambda at, n: np.stack([np.bincount(at, weights=w, minlength=n).astype(np.uint32) for w in (learn, deleted)])
    grams = []
    for hashes in _grams(vocabulary[local], np.cumsum(lengths) - lengths, p):
        distinct, place = np.unique(hashes, return_inverse=True)
        grams.append((distinct, place, count(place, len(distinct))))
    return count(local, len(vocabulary)), grams


def _cuts(hashes: np.ndarray, first: int, last: int, ranges: int, bits: int) -> list[int]:
    """Where ranges first .. last of `ranges` equal ones begin and end in sorted hashes of `bits` bits."""
    bounds = np.array([(k << bits) // ranges for k in range(first + 1, last)], dtype=U64)
    return [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]


def _ranged(chunk: int, lists: list[tuple[np.ndarray, np.ndarray]], first: int, last: int, ranges: int, p: Interpolation) -> Iterator[tuple[int, int, list[bytes]]]:
    """(chunk, range, blobs) of the ranges first .. last of sorted (hashes, counts), words and then each order."""
    cuts = [_cuts(x, first, last, ranges, p.hash_bits if k else 64) for k, (x, _) in enumerate(lists)]
    for b in range(last - first):
        if any(c[b + 1] > c[b] for c in cuts):
            blobs = []
            for c, (hashes, counts) in zip(cuts, lists):
                i, j = c[b], c[b + 1]
                blobs += [_pack_sorted(hashes[i:j]), *map(_pack_counts, counts[:, i:j])]
            yield chunk, first + b, blobs


CHUNK = pa.schema([("chunk", pa.int64()), ("p", pa.list_(pa.binary()))])
ENTRY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("p", pa.list_(pa.binary()))])


def _chunks(df: DataFrame, p: Interpolation) -> DataFrame:
    """Rows (chunk, p) of the documents (id, fold, text): ids, folds, lengths, tokens by number, and the vocabulary."""

    def emit(chunk: int, tokens: list, lengths: list, folds: list, ids: list) -> pa.RecordBatch:
        whole = np.concatenate(tokens)
        tokens.clear()
        vocabulary, local, seen = np.unique(whole, return_inverse=True, return_counts=True)
        del whole
        order = np.argsort(-seen, kind="stable")  # frequent words get small numbers, which compress
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocabulary = vocabulary[order]
        back = np.argsort(vocabulary)
        row = [_pack_column(pa.concat_arrays(ids)), _pack(np.concatenate(folds)), _pack(np.concatenate(lengths).astype(np.uint32)), _pack(rank[local].astype(np.uint32)), _pack_sorted(vocabulary[back]), _pack(back.astype(np.uint32))]
        return pa.RecordBatch.from_pylist([{"chunk": chunk, "p": row}], CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        tokens, lengths, folds, ids = [], [], [], []
        for batch in batches:
            raw, offs = text_buffers(batch.column(2))
            fold = batch.column(1).to_numpy().astype(np.uint8)
            for i, j in slices(offs):
                hashes, rows = words(raw, offs[i : j + 1])
                sizes = np.diff(rows)
                tokens.append(np.insert(hashes & ~U64(1), np.cumsum(sizes), END))
                lengths.append(sizes + 1)
                folds.append(fold[i:j])
                ids.append(batch.column(0).slice(i, j - i))
                held += len(tokens[-1])
                if held >= p.chunk_tokens:
                    yield emit(chunk, tokens, lengths, folds, ids)
                    chunk, held = chunk + 1, 0
                    tokens, lengths, folds, ids = [], [], [], []
                    trim()
        if ids:
            yield emit(chunk, tokens, lengths, folds, ids)
        tokens, lengths, folds, ids = [], [], [], []
        trim()

    return df.mapInArrow(run, "chunk long, p array<binary>")


@dataclass
class Opened:
    """A chunk as it was written, with its entries."""

    ids: pa.Array
    folds: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray  # sorted
    back: np.ndarray  # the numbers of the words in that order
    local: np.ndarray  # tokens by number
    word_counts: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _opened(row: list[bytes], p: Interpolation) -> Opened:
    ids, folds, sizes, local, vocabulary, back = row
    lengths, local, back = _unpack(sizes, np.uint32).astype(np.int64), _unpack(local, np.uint32), _unpack(back, np.uint32)
    in_order, folds = _unpack_sorted(vocabulary), _unpack(folds, np.uint8)
    by_number = np.empty_like(in_order)
    by_number[back] = in_order
    return Opened(_unpack_column(ids), folds, lengths, in_order, back, local, *_entries(local, by_number, lengths, folds, p))


def _chunk_entries(chunks: DataFrame, p: Interpolation, ranges: int) -> DataFrame:
    """Rows (chunk, bucket, p): each chunk's distinct words and n-grams by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = _opened(row.as_py(), p)
                lists = [(c.vocabulary, c.word_counts[:, c.back]), *((hashes, counts) for hashes, _, counts in c.grams)]
                del c
                for made in _ranged(number, lists, 0, ranges, ranges, p):
                    yield pa.RecordBatch.from_pylist([dict(zip(ENTRY.names, made))], ENTRY)
                del lists
                trim()

    return chunks.mapInArrow(run, E_SCHEMA)


TOTALS = ("tokens", "kinds", "tokens_left", "kinds_left")


def _summed(hashes: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct hashes and their sums; and for each entry, as given, its place among them and whether another part holds it."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(every) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(np.concatenate(c).astype(np.int64)[order], first) if len(every) else np.zeros(0, np.int64) for c in counts]
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[first], sums, place, np.bincount(place, minlength=len(first))[place] > 1


def _parts(rows: list[list[bytes]], order: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """The hashes and both counts that each row has of one order."""
    return [_unpack_sorted(x[3 * order]) for x in rows], [[_unpack_counts(x[3 * order + k]) for x in rows] for k in (1, 2)]


def _returned(hashes: list[np.ndarray], sums: list[np.ndarray], place: np.ndarray, shared: np.ndarray) -> Iterator[list[bytes]]:
    """For each part which of its entries others hold too, in its own order, and their totals."""
    end = 0
    for own in hashes:
        begin, end = end, end + len(own)
        mask, where = shared[begin:end], place[begin:end]
        yield [_pack(np.packbits(mask)), *(_pack_counts(s[where[mask]]) for s in sums)]


def _apply(counts: np.ndarray, blobs: list[bytes], begin: int, end: int, names: np.ndarray | None = None) -> np.ndarray:
    """Set the totals that came back for entries begin .. end, and return which entries those are."""
    own = begin + np.flatnonzero(np.unpackbits(_unpack(blobs[0], np.uint8), count=end - begin)) if end > begin else np.zeros(0, np.int64)
    if names is not None:
        own = names[own]
    counts[:, own] = np.stack([_unpack_counts(x) for x in blobs[1:3]])
    return own


E_SCHEMA = "chunk long, bucket long, p array<binary>"


def _blobs(table: pa.Table) -> list[list[bytes]]:
    return [x.as_py() for x in table["p"]]


def _table(rows: list[tuple[int, int, list[bytes]]], stats: list[int] | None = None) -> pa.Table:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.binary())))]
    out = pa.Table.from_arrays(columns, ["chunk", "bucket", "p"])
    if stats is None:
        return out
    held = out.append_column("s", pa.nulls(len(rows), pa.list_(pa.int64())))
    return pa.concat_tables([held, pa.Table.from_arrays([pa.nulls(1, t) for t in held.schema.types[:3]] + [pa.array([stats], pa.list_(pa.int64()))], schema=held.schema)])


def _totals(p: Interpolation):
    """One hash range: for every chunk what others hold too, and a row of the range's sums."""

    def run(table: pa.Table) -> pa.Table:
        rows, back = _blobs(table), [[] for _ in range(table.num_rows)]
        stats: list[int] = []
        for order in range(p.order):
            hashes, counts = _parts(rows, order)
            _, sums, place, shared = _summed(hashes, counts)
            if not order:
                left = sums[0] - sums[1]
                stats = [int(sums[0].sum()), int((sums[0] > 0).sum()), int(left.sum()), int((left > 0).sum())]
            for row, own in zip(back, _returned(hashes, sums, place, shared)):
                row += own
        out = _table(list(zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), back)), stats)
        del rows, back
        trim()
        return out

    return run


def _merged(p: Interpolation, groups: int, fan: int, ranges: int):
    """Chunks of one range and group: one larger chunk, cut into `fan` of the next level's `ranges` ranges."""

    def run(table: pa.Table) -> pa.Table:
        bucket, group = table["bucket"][0].as_py(), table["group"][0].as_py()
        rows = _blobs(table)
        lists = []
        for order in range(p.order):
            hashes, sums, _, _ = _summed(*_parts(rows, order))
            lists.append((hashes, np.stack(sums)))
        return _table(list(_ranged(bucket * groups + group, lists, bucket * fan, (bucket + 1) * fan, ranges, p)))

    return run


def _shared_out(p: Interpolation, fan: int, ranges: int):
    """Hand what came back for the larger chunk to the chunks that it was merged from."""

    def run(table: pa.Table, own: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        bucket, rows, returned = table["bucket"][0].as_py(), _blobs(table), _blobs(own)
        back: list[list] = [[] for _ in rows]
        for order in range(p.order):
            hashes, counts = _parts(rows, order)
            distinct, sums, place, shared = _summed(hashes, counts)
            totals, elsewhere = np.stack(sums), np.zeros(len(distinct), bool)
            cuts = _cuts(distinct, bucket * fan, (bucket + 1) * fan, ranges, p.hash_bits if order else 64)
            for b, blobs in zip(own["bucket"].to_pylist(), returned):
                at = b - bucket * fan
                elsewhere[_apply(totals, blobs[3 * order : 3 * order + 3], cuts[at], cuts[at + 1])] = True
            for row, part in zip(back, _returned(hashes, list(totals), place, shared | elsewhere[place])):
                row += part
        return _table(list(zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), back)))

    return run


def _resolved_entries(entries: DataFrame, chunks: int, fans: list[int], p: Interpolation, scratch: Scratch, before: int = 1) -> tuple[DataFrame, dict[str, int]]:
    """What comes back for each chunk and range of `entries`, and the corpus's sums.  `before` ranges of the level above
    were cut into fans[0] each; `chunks` is about how many chunks there are in each of those."""
    ranges, name = before * fans[0], f"{len(fans)}"
    if len(fans) == 1:
        found = scratch.write(entries.groupBy("bucket").applyInArrow(_totals(p), f"{E_SCHEMA}, s array<long>"), f"totals-{name}")
        sums = {k: v or 0 for k, v in zip(TOTALS, found.agg(*(F.sum(F.col("s")[i]) for i in range(len(TOTALS)))).first())}
        return found.filter("s is null").select("chunk", "bucket", "p"), sums
    groups = max(1, math.ceil(chunks / fans[0]))
    grouped = entries.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)))
    merged = scratch.write(grouped.groupBy("bucket", "group").applyInArrow(_merged(p, groups, fans[1], ranges * fans[1]), E_SCHEMA), f"merged-{name}")
    above, sums = _resolved_entries(merged, groups, fans[1:], p, scratch, ranges)
    above = above.select(F.expr(f"chunk div {groups}").alias("up"), F.col("chunk").alias("larger"), F.pmod("chunk", F.lit(groups)).alias("group"), "bucket", "p")
    above = above.select("larger", "group", F.col("up").alias("range"), "bucket", "p")
    back = grouped.groupBy("bucket", "group").cogroup(above.groupBy("range", "group")).applyInArrow(_shared_out(p, fans[1], ranges * fans[1]), E_SCHEMA)
    return scratch.write(back, f"back-{name}"), sums


@dataclass
class Resolved:
    ids: pa.Array
    folds: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray  # per token: per order, longest first, the counts of n-gram and context, and last the word's


def _resolved(documents: pa.Table, totals: pa.Table, p: Interpolation, ranges: int, left: bool) -> Resolved:
    """A chunk's tokens with the counts of all learning texts or, with `left`, of those but the deleted fold."""
    o = _opened(documents["p"][0].as_py(), p)
    counts = [o.word_counts.astype(np.int64), *(c.astype(np.int64) for _, _, c in o.grams)]
    hashes, places = [o.vocabulary, *(x for x, _, _ in o.grams)], [o.local, *(x for _, x, _ in o.grams)]
    o.grams = []
    cuts = [_cuts(x, 0, ranges, ranges, p.hash_bits if k else 64) for k, x in enumerate(hashes)]
    for b, row in zip(totals["bucket"].to_pylist(), totals["p"]):
        blobs = row.as_py()
        for k, (c, held) in enumerate(zip(cuts, counts)):
            _apply(held, blobs[3 * k : 3 * k + 3], c[b], c[b + 1], None if k else o.back)
    first, end = np.cumsum(o.lengths) - o.lengths, int(o.back[np.searchsorted(o.vocabulary, END)])
    del hashes
    wanted = [c[0] - c[1] if left else c[0] for c in counts]
    del counts
    out = np.empty((2 * p.order - 1, len(o.local)), np.int64)
    for k, order in enumerate(range(p.order - 1, 0, -1)):
        out[2 * k] = wanted[order][places[order]]
        out[2 * k + 1, 1:] = wanted[order - 1][places[order - 1][:-1]]
        out[2 * k + 1, first] = wanted[0][end]  # every text begins after an end
    out[-1] = wanted[0][places[0]]
    return Resolved(o.ids, o.folds, o.lengths, out)


#: Tokens whose probabilities are computed at once.
SLICE_TOKENS = 100_000


def _bucket(counts: np.ndarray, p: Interpolation) -> np.ndarray:
    """The bucket of the longest context seen: `buckets` for each order, 0 where none was seen."""
    out = np.zeros(counts.shape[1], np.int64)
    for k, order in enumerate(range(p.order, 1, -1)):
        context = counts[2 * k + 1]
        own = (order - 2) * p.buckets + np.minimum(np.frexp(context.astype(np.float64))[1], p.buckets - 1)
        out = np.where((out == 0) & (context > 0), own, out)
    return out


def _event_columns(p: Interpolation) -> list[str]:
    return [f"{x}{m}" for m in range(p.order, 1, -1) for x in ("gram", "context")] + ["word", "bucket"]


def learn_weights(events: DataFrame, tokens: int, kinds: int, p: Interpolation) -> list[list[float]]:
    """Expectation-maximisation over events (counts, bucket, n): per bucket the weights of the orders, longest first, of
    the word's share and of the uniform share."""
    parts = p.order + 1
    weights = [[1 / parts] * parts for _ in range(max(1, p.order - 1) * p.buckets)]
    for _ in range(p.rounds):
        share = lambda k: F.element_at(F.array(*(F.lit(float(w[k])) for w in weights)), (F.col("bucket") + 1).cast("int"))  # noqa: B023,E731
        terms = [share(k) * F.when(F.col(f"context{m}") > 0, F.col(f"gram{m}") / F.col(f"context{m}")).otherwise(0.0) for k, m in enumerate(range(p.order, 1, -1))]
        terms += [share(parts - 2) * F.col("word") / F.lit(max(tokens, 1)), share(parts - 1) / F.lit(kinds + 1)]
        total = sum(terms[1:], terms[0])
        sums = events.groupBy("bucket").agg(*(F.sum(F.col("n") * x / total).alias(f"w{k}") for k, x in enumerate(terms))).collect()
        for r in sums:
            own = [max(r[f"w{k}"] or 0.0, 0.0) for k in range(parts)]
            whole = sum(own) or 1.0
            own = [max(x / whole, p.least) for x in own]
            weights[r["bucket"]] = [x / sum(own) for x in own]
    return weights


def interpolated_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Interpolation = Interpolation()) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "lm")
    own_fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(p.folds))
    docs = df.select(F.col(id_col).alias("id"), own_fold.alias("fold"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    id_type = df.schema[id_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not size and not docs.take(1):
        return spark.createDataFrame([], schema)
    fans = p.fans(size)
    ranges = fans[0]
    chunk = scratch.write(_chunks(docs, p), "chunks", compression="uncompressed")
    back, totals = _resolved_entries(_chunk_entries(chunk, p, ranges), math.ceil(size / 6 / p.chunk_tokens), fans, p, scratch)
    for k in range(len(fans), 1, -1):
        scratch.drop(f"merged-{k}")
        scratch.drop(f"back-{k - 1}" if k > 2 else "totals-1")
    release(spark)
    columns = _event_columns(p)

    def events(documents: pa.Table, own: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * (len(columns) + 1), [*columns, "n"])
        r = _resolved(documents, own, p, ranges, left=True)
        c = r.counts[:, np.repeat(r.folds == p.deleted_fold, r.lengths)]
        del r
        bucket = _bucket(c, p)
        for k in range(0, len(c) - 1, 2):
            c[k + 1][c[k] == 0] = 0  # without the n-gram only the context's bucket counts
        rows, n = np.unique(np.vstack((c, bucket)), axis=1, return_counts=True)
        del c
        trim()
        return pa.Table.from_arrays([*(pa.array(x, pa.int64()) for x in rows), pa.array(n, pa.int64())], [*columns, "n"])

    seen = chunk.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(events, ", ".join(f"{c} long" for c in [*columns, "n"]))
    seen = scratch.write(seen.groupBy(*columns).agg(F.sum("n").alias("n")), "events")
    release(spark)
    weights = np.array(learn_weights(seen, totals["tokens_left"], totals["kinds_left"], p))
    tokens, kinds = totals["tokens"], totals["kinds"]
    out_schema = pa.schema([(id_col, to_arrow_type(id_type)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scores(documents: pa.Table, own: pa.Table) -> pa.Table:
        if not documents.num_rows:
            return out_schema.empty_table()
        r = _resolved(documents, own, p, ranges, left=False)
        ends = np.cumsum(r.lengths)
        starts, sums, i = ends - r.lengths, [np.zeros(len(r.lengths), t) for t in (np.int64, float, float)], 0
        while i < len(starts):  # rows of so many tokens at once
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_TOKENS, side="right")))
            counts = r.counts[:, starts[i] : ends[j - 1]]
            w, word = weights[_bucket(counts, p)], counts[-1]
            mixed = w[:, -2] * word / max(tokens, 1) + w[:, -1] / (kinds + 1)
            for k in range(p.order - 1):
                gram, context = counts[2 * k], counts[2 * k + 1]
                mixed += w[:, k] * np.divide(gram, context, out=np.zeros(len(gram)), where=context > 0)
            base = np.log10((word + 0.5) / (tokens + 0.5 * (kinds + 1)))
            for total, x in zip(sums, ((word > 0).astype(np.int64), base, np.log10(mixed))):
                total[i:j] = np.add.reduceat(x, starts[i:j] - starts[i])
            i = j
        r.counts = np.zeros(0)
        trim()
        return pa.Table.from_arrays(
            [r.ids.cast(out_schema.types[0]), pa.array(r.folds == p.score_fold), pa.array(r.lengths, pa.int64()), pa.array(sums[0]), pa.array(np.full(len(starts), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=out_schema
        )

    return chunk.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(scores, schema)
