"""Near-duplicates by circulant MinHash.

Signatures: every shingle is placed in a universe of 2**32 by one permutation; the second permutation,
shifted circularly by 0, 1, 2, ... places, gives all coordinates of the signature, of which a coordinate is
the smallest value over the set.  Bands of coordinates make buckets, and documents that share a bucket are
compared on their full shingle sets.

Equal sets are one class from the start.  In a bucket the class that shares most buckets with others (the
hub) is compared with all the rest, and components are formed.  What then still lies outside a bucket's main
component is compared with the whole bucket: pair by pair in small buckets, and in large ones block by
block, where all intersections of two blocks are found at once and only links that join components come out.
No bucket is capped; a large one is split into parts of a few blocks, and a hub's set goes out in salted copies, so neither
a bucket nor a hub is one task's work.

Recall: documents with similarity 0.75 share none of 40 bands of 5 with probability 2e-5.

Cases: a document with fewer words than a shingle is one shingle; without words it is linked with nothing;
a row without an id is linked with nothing and kept; repeated rows share a component and have the same
result; ids are integers (other types are an error) and name one text: of an id with different texts one text is
looked at for links with others; an empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .components import components, contracted
from .kernels import U64, mix64, shingle_sets, slices, text_buffers, trim, words
from .scratch import Scratch

U32 = np.uint32


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    #: Buckets up to this size are compared pair by pair, larger ones block by block of so many members and shingles.
    small: int = 32
    block: int = 64
    block_shingles: int = 32_000
    #: Blocks of a large bucket that one join key compares with the whole bucket.
    part_blocks: int = 8
    #: Ids up to this many are broadcast to pick texts; more are joined by a shuffle.
    broadcast_ids: int = 2_000_000


def _permuted(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit integers."""
    x = (x ^ (x >> U32(16))) * U32(0x7FEB352D)
    x = (x ^ (x >> U32(15))) * U32(0x846CA68B)
    return x ^ (x >> U32(16))


def signature(shingles: np.ndarray, size: int, chunk: int = 4096) -> np.ndarray:
    """The circulant signature of a non-empty set of 64-bit shingles."""
    places = (shingles >> U64(32)).astype(U32)  # the first permutation's place of each shingle
    shifts = np.arange(size, dtype=U32)
    out = np.full(size, 0xFFFFFFFF, U32)
    for at in range(0, len(places), chunk):
        np.minimum(out, _permuted(places[at : at + chunk, None] + shifts).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit bucket keys; the band's number is part of the key."""
    x = sig.reshape(bands, rows).astype(U64)
    key = np.arange(bands, dtype=U64)
    for k in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + x[:, k])
    return key.view(np.int64)


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    raw, offs = text_buffers(column)
    for i, j in slices(offs):
        hashes, rows = words(raw, offs[i : j + 1])
        yield from shingle_sets(hashes, rows, shingle)


def sketches(df: DataFrame, p: NearDup) -> DataFrame:
    """(id, n, f1, f2, keys) of every row of `df` (id, text): set size, a 128-bit digest of the set, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, keys = [], [], [], []
            for s in _sets(batch.column(1), p.shingle):
                n.append(len(s))
                f1.append(int(s.sum(dtype=U64).view(np.int64)))
                f2.append(int(mix64(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).view(np.int64)))
                keys.append(band_keys(signature(s, p.bands * p.rows), p.bands, p.rows) if len(s) else np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), flat], ["id", "n", "f1", "f2", "keys"])
            trim()

    return df.mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def full_sets(df: DataFrame, p: NearDup) -> DataFrame:
    """(id, shingles): the sorted shingle sets of `df` (id, text) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in _sets(part.column(1), p.shingle)], pa.binary())], ["id", "shingles"])
            trim()

    return df.mapInArrow(run, "id long, shingles binary")


#: A hub with more members than this gets its set in as many copies, each for a part of the members.
HOT_PAIRS = 2000


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets, x and y, are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                at = np.searchsorted(u, v)
                both = int((u[np.minimum(at, len(u) - 1)] == v).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            trim()

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """One row per row of `df`: the id, n_shingles, component_id and kept."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    scratch = Scratch(df.sparkSession, "near")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.write(sketches(docs, p), "sketch")
    classes = scratch.write(
        sketch.filter("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes"
    )
    firsts = sketch.select("id", "n", "keys").join(classes.select(F.col("rep").alias("id"), F.col("n").alias("class_n")), "id").filter("n = class_n").dropDuplicates(["id"])
    placed = firsts.select("id", "n", F.explode("keys").alias("key"))
    shared = scratch.write(placed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shared")
    member = scratch.write(placed.join(shared, "key"), "member")
    roots = _linked(docs, member, scratch, p)
    copies = classes.filter("last > rep").select("n", "f1", "f2", "rep")
    found = sketch.select("id", "n", "f1", "f2").join(copies, ["n", "f1", "f2"], "left").withColumn("node", F.coalesce("rep", "id"))
    out = found.join(roots, "node", "left") if roots is not None else found.withColumn("root", F.lit(None).cast("long"))
    component = F.coalesce("root", "node")
    kind = df.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def block_links(one: list[dict], two: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between members (id, root, shingles) of two blocks that lie in different components, as many as
    join the same components: all intersections at once, by the shingles that the blocks share."""
    sets = [[np.frombuffer(m["shingles"], U64) for m in side] for side in (one, two)]
    sizes = [np.array([len(x) for x in side]) for side in sets]
    flat = [np.concatenate(side) for side in sets]
    owner = [np.repeat(np.arange(len(x)), x) for x in sizes]
    order = np.argsort(flat[1], kind="stable")
    right, at = flat[1][order], owner[1][order]
    a = np.searchsorted(right, flat[0])
    n = np.searchsorted(right, flat[0], side="right") - a
    place = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    both = np.bincount(np.repeat(owner[0], n) * len(two) + at[place], minlength=len(one) * len(two)).reshape(len(one), len(two))
    close = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
    roots = [np.array([m["root"] for m in side]) for side in (one, two)]
    close &= roots[0][:, None] != roots[1][None, :]
    ids = [np.array([m["id"] for m in side], np.int64) for side in (one, two)]
    a, b = np.nonzero(close)
    node, root = contracted(ids[0][a], ids[1][b])
    return list(zip(node.tolist(), root.tolist()))


def _linked(docs: DataFrame, member: DataFrame, scratch: Scratch, p: NearDup) -> DataFrame | None:
    """(node, root) of the classes that links join, or None without a shared bucket."""
    degree = scratch.write(member.groupBy("id").agg(F.sum("c").alias("degree")), "degree")
    n = degree.count()
    if not n:
        return None
    ids = degree.select("id")
    wanted = docs.join(F.broadcast(ids) if n <= p.broadcast_ids else ids, "id", "left_semi").filter("text is not null")
    sets = scratch.write(full_sets(wanted, p).dropDuplicates(["id"]), "sets")
    rank = F.struct("degree", (-F.col("id")).alias("back"))
    ranked = member.join(degree, "id")
    hub = scratch.write(ranked.groupBy("key").agg(F.max(rank).alias("rank"), F.max_by("n", rank).alias("hub_n")), "hub")
    copies = F.ceil(F.col("rank.degree") / HOT_PAIRS).cast("int")  # the degree is at least the number of the hub's members
    hub = hub.select("key", (-F.col("rank.back")).alias("hub"), "hub_n", copies.alias("copies"))
    size = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * p.percent
    unordered = F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    # A member has a pair per band at most, a hub one per member: only hubs' sets are copied.
    stars = member.join(hub, "key").filter((F.col("id") != F.col("hub")) & size).select(F.col("id").alias("a"), F.col("hub").alias("b"), "copies").distinct()
    one, two = (sets.select(F.col("id").alias(k), F.col("shingles").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    hubs = two.join(hub.select(F.col("hub").alias("b"), "copies").distinct(), "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    met = stars.withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).drop("copies").join(one, "a").join(hubs, ["b", "copy"])
    links = scratch.write(confirmed(met, p.percent), "star-links")
    roots = components(links, scratch, "stars")

    # What still lies in several components of a bucket.
    placed = member.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    open_ = counts.groupBy("key").agg(F.max_by("root", "k").alias("main"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    now = scratch.write(placed.join(open_, "key"), "open")
    small = now.filter(F.col("c") <= p.small)
    other = small.select("key", F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
    pairs = small.join(other, "key").filter((F.col("id") < F.col("hub")) & (F.col("root") != F.col("hub_root")) & size).select(*unordered).distinct()
    more = scratch.write(confirmed(pairs.join(one, "a").join(two, "b"), p.percent), "pair-links")
    blocks = F.greatest(F.ceil(F.col("c") / p.block), F.ceil(F.col("total") / p.block_shingles))
    large = now.filter(F.col("c") > p.small).withColumn("block", F.pmod(F.xxhash64("id"), blocks)).join(sets, "id")
    entry = F.collect_list(F.struct("id", "root", "shingles"))
    # The blocks outside the main component are dealt to parts of a few blocks, each of which meets the whole bucket.
    parts = F.ceil(blocks / p.part_blocks).cast("int")
    large = large.withColumn("parts", parts)
    rest = large.filter("root <> main").groupBy("key", "block").agg(entry.alias("one"), F.first("parts").alias("parts")).select("key", F.pmod("block", "parts").cast("int").alias("part"), "one")
    whole = large.groupBy("key", "block").agg(entry.alias("two"), F.first("parts").alias("parts")).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                found = block_links(one.as_py(), two.as_py(), p.percent)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    wide = scratch.write(rest.join(whole, ["key", "part"]).select("one", "two").mapInArrow(run, "a long, b long"), "block-links")
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(known.unionByName(more).unionByName(wide), scratch, "roots")


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: NearDup = NearDup()) -> DataFrame:
    """`df` with one document of each component, that of the smallest id; repeated rows of it are one."""
    dropped = near_duplicate_classes(df, id_col, text_col, p).filter("not kept").select(id_col).distinct()
    rest = df.join(dropped, id_col, "left_anti")
    return rest.filter(F.col(id_col).isNull()).unionByName(rest.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
