"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A window begins at every word of a document and is embedded by random walks: a walk reads a byte, emits it and steps on or
stays by a random bit that depends on the step and the byte, which maps edit distance to Hamming distance.  A key is a
sample of places of a walk.  The items are embedded alike from each of their words, so an item meets the window of its own
place and size through the walks from all of its words, and edits in front of a word don't put its walk out of step.
Equal keys of a window and of an item's word propose the item at one diagonal; where `votes` words of an item agree on
nearby diagonals, the item is verified by its exact edit distance inside the window and a margin.

At the edit limit two walks still agree on all places of a key with probability `share` (measured, one word, one key; far
more below the limit), and `repetitions` follows from that and from the target recall for an item of `words` words.

Items much longer than `segment` bytes are looked for in pieces of that size.  Pieces under `short` bytes have shorter walks
and need one vote; pieces under `tiny` bytes are cut into one part more than the limit has edits, one of which any match
keeps, and all parts are sought at once by an Aho-Corasick automaton, which misses nothing.  A piece so short that the
limit is no edit must stand between white space.

A-Z count as a-z, and white space around an item doesn't count.  Cases: null and empty texts and items without words match nothing; repeated rows and equal
items are reported each; texts are embedded in slices of fixed size, however long they are; benchmark items are read in
blocks of bounded bytes, whose index of some 60 bytes a byte a worker builds once, and a larger benchmark costs more
passes; an empty table gives an empty result; other columns of both tables, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import U64, lowered, text_buffers, trim, word_starts


@dataclass(frozen=True)
class Leaks:
    edit_percent: int = 20
    #: Steps of a walk, walks, and the places of a walk that make a key.
    steps: int = 36
    walks: int = 4
    samples: int = 8
    recall: float = 0.99
    share: float = 0.14
    words: int = 7
    votes: int = 3
    #: Diagonals so near each other are one proposal.
    shift: int = 24
    segment: int = 600
    short: int = 64
    short_steps: int = 14
    short_samples: int = 6
    tiny: int = 16
    block_bytes: int = 4 << 20
    #: Bytes of text whose windows are embedded at once.
    slice_bytes: int = 1 << 20

    @property
    def repetitions(self) -> int:
        """Keys per word: each of the votes is reached with the target's share of failures."""
        return self.votes * math.ceil(math.log(1 - self.recall) / (self.words * math.log(1 - self.share)))


GRAM = 4
BLANK = b" \t\n\x0b\x0c\r"


def edit_search(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(least edit distance of `pattern` to a substring of `text`, where that ends), bit-parallel."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def edit_span(pattern: bytes, text: bytes, limit: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best match in `text` within `limit` edits."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at, at + len(pattern)
    best, end = edit_search(pattern, text)
    if best > limit:
        return None
    _, back = edit_search(pattern[::-1], text[:end][::-1])
    return best, end - back, end


class Walks:
    """One family of random walks and the samples of their places that make keys."""

    BLOCK = 1 << 15

    def __init__(self, steps: int, walks: int, samples: int, repetitions: int):
        rng = np.random.Generator(np.random.PCG64(2718))
        self.steps = rng.integers(0, 2, (walks, steps, 256), dtype=np.uint8)
        # One place from each of equal stretches of the walk, so that every key tells apart about as much.
        cuts = np.arange(samples + 1) * steps // samples
        self.plan = [rng.integers(cuts[:-1], cuts[1:]) for _ in range(repetitions)]
        self.reach = steps

    def keys(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(repetitions x windows) keys of the windows that begin at `at`, and the last byte that each key read.

        `padded` has `reach` bytes more than the last window's beginning.  A key is a hash of up to eight bytes."""
        out, last = np.empty((len(self.plan), len(at)), U64), np.empty((len(self.plan), len(at)), np.int32)
        walks = len(self.steps)
        for a in range(0, len(at), self.BLOCK):
            begin = at[a : a + self.BLOCK].astype(np.int32)
            byte, step = np.empty(len(begin), np.uint8), np.empty(len(begin), np.uint8)
            for walk in range(walks):
                takes: dict[int, list[tuple[int, int]]] = {}
                for r in range(walk, len(self.plan), walks):
                    for column, t in enumerate(self.plan[r].tolist()):
                        takes.setdefault(t, []).append((r, column))
                read = {r: np.zeros((len(begin), 8), np.uint8) for r in range(walk, len(self.plan), walks)}
                place = begin.copy()
                for t in range(max(takes, default=-1) + 1):
                    np.take(padded, place, out=byte, mode="clip")
                    for r, column in takes.get(t, ()):
                        read[r][:, column] = byte
                        if t == self.plan[r][-1]:
                            last[r, a : a + self.BLOCK] = place
                    np.take(self.steps[walk, t], byte, out=step, mode="clip")
                    place += step
                for r, x in read.items():
                    out[r, a : a + self.BLOCK] = (x.view("<u8")[:, 0] + U64(r)) * U64(0x9E3779B97F4A7C15)
        return out, last


class Buckets:
    """The keys of some pieces from each of their words, by hash."""

    def __init__(self, pieces: list[tuple[int, bytes]], walks: Walks):
        self.walks = walks
        texts = [x for _, x in pieces]
        data = np.frombuffer(b"".join(texts) + bytes(walks.reach), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        begins = ends - [len(x) for x in texts]
        at = word_starts(data[: int(ends[-1])], begins)
        piece = np.searchsorted(ends, at, side="right")
        keys, last = walks.keys(data, at)
        inside = last < ends[piece]  # a key that read past its piece says nothing
        self.windows = np.bincount(piece[inside.any(axis=0)], minlength=len(texts))
        rep, word = np.nonzero(inside)
        keys = keys[rep, word]
        order = np.argsort(keys, kind="stable")
        self.hashes = keys[order]
        self.piece, self.shift = piece[word][order].astype(np.int32), (at - begins[piece])[word][order].astype(np.int16)
        self.bits = max(20, len(keys).bit_length() + 2)
        self.gate = np.zeros(1 << self.bits, bool)
        self.gate[(self.hashes >> U64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window's first byte, piece, piece's first byte by this window) wherever a key of a window is a piece's."""
        found = []
        for keys in self.walks.keys(padded, at)[0] if len(self.hashes) else ():
            hit = np.flatnonzero(self.gate[(keys >> U64(64 - self.bits)).astype(np.int64)])
            a, b = np.searchsorted(self.hashes, keys[hit]), np.searchsorted(self.hashes, keys[hit], side="right")
            hit, a, n = hit[b > a], a[b > a], (b - a)[b > a]
            each = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = np.repeat(at[hit], n)
            found.append((place, self.piece[each], place - self.shift[each]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


class Index:
    """The items of one block: their pieces, the buckets of long and of short ones, and the parts of tiny ones."""

    def __init__(self, items: list[tuple[object, str | None]], p: Leaks):
        self.p = p
        pieces: list[tuple[int, bytes]] = []
        for k, (_, text) in enumerate(items):
            raw = lowered(np.frombuffer((text or "").encode(), np.uint8)).tobytes().strip(BLANK)
            step = p.segment * 2 // 3
            parts = [raw] if len(raw) <= p.segment else [raw[i : i + step] for i in range(0, len(raw) - p.segment // 3, step)]
            pieces += [(k, x) for x in parts if x.strip(BLANK)]
        self.ids = [i for i, _ in items]
        r = p.repetitions
        kinds = (lambda n: n >= p.short, lambda n: p.tiny <= n < p.short)
        families = Walks(p.steps, p.walks, p.samples, r), Walks(p.short_steps, p.walks, p.short_samples, r)
        sorted_ = [[x for x in pieces if kind(len(x[1]))] for kind in kinds]
        self.tables = [(x, Buckets(x, walks), votes) for x, walks, votes in zip(sorted_, families, (p.votes, 1)) if x]
        self.tiny = [x for x in pieces if len(x[1]) < p.tiny]
        self.parts = ahocorasick.Automaton() if self.tiny else None
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.tiny):
            n = len(text) * p.edit_percent // 100 + 1
            for cut in range(n):
                a, b = len(text) * cut // n, len(text) * (cut + 1) // n
                owners.setdefault(text[a:b].decode("latin-1"), []).append((k, a))
        for part, own in owners.items():
            self.parts.add_word(part, (len(part), own))
        if self.parts:
            self.parts.make_automaton()

    def _proposed(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[tuple[int, bytes], int, int, int]]:
        """(piece, row, first and last of its first byte) of the proposals."""
        padded = np.concatenate((data, np.zeros(self.p.steps + self.p.short_steps, np.uint8)))
        found: list[list] = [[] for _ in self.tables]
        for a in range(0, len(data) if self.tables else 0, self.p.slice_bytes):
            part = data[max(a - 1, 0) : a + self.p.slice_bytes]
            at = word_starts(part, offs[(offs >= a) & (offs < a + self.p.slice_bytes)] - max(a - 1, 0)) + max(a - 1, 0)
            for held, (_, buckets, _) in zip(found, self.tables):
                held.append(buckets.hits(padded, at[at >= a]))
        for held, (pieces, buckets, votes) in zip(found, self.tables):
            place, piece, first = (np.concatenate(x) for x in zip(*held))
            if not len(place):
                continue
            row = np.searchsorted(offs, place, side="right") - 1
            order = np.lexsort((first, piece, row))
            place, piece, first, row = place[order], piece[order], first[order], row[order]
            new = np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1]) | (np.diff(first) > self.p.shift))
            group = np.cumsum(new) - 1
            begin = np.flatnonzero(new)
            # A window votes once in a group, whatever the number of its keys.
            order = np.lexsort((place, group))
            once = np.append(True, (np.diff(place[order]) != 0) | (np.diff(group[order]) != 0))
            count = np.bincount(group[order][once], minlength=len(begin))
            good = np.flatnonzero(count >= np.minimum(votes, buckets.windows[piece[begin]]))
            ends = np.append(begin[1:], len(first)) - 1
            for g in good.tolist():
                yield pieces[piece[begin[g]]], int(row[begin[g]]), int(first[begin[g]]), int(first[ends[g]])
        if self.parts:
            text = data.tobytes().decode("latin-1")
            for end, (size, own) in self.parts.iter(text):
                for k, shift in own:
                    at = end + 1 - size
                    row = int(np.searchsorted(offs, at, side="right")) - 1
                    if end < offs[row + 1]:
                        yield self.tiny[k], row, at - shift, at - shift

    def matches(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, object, int, int, int]]:
        """(row, item id, start, end, distance) in bytes of `raw`, the best match of each row and item."""
        base = int(offs[0])
        data, at = lowered(raw[base : int(offs[-1])]), np.asarray(offs) - base
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (item, text), row, first, last in self._proposed(data, at):
            limit = len(text) * self.p.edit_percent // 100
            old = best.get((row, item))
            if old and old[0] == 0:
                continue
            lo, hi = max(int(at[row]), first - limit), min(int(at[row + 1]), last + len(text) + limit)
            if hi - lo < len(text) - limit:
                continue
            region = data[lo:hi].tobytes()
            # Every edit breaks at most GRAM of the item's byte grams, so a match keeps the others.
            grams = len(text) - GRAM + 1
            if grams > GRAM * limit:
                there = {region[i : i + GRAM] for i in range(len(region) - GRAM + 1)}
                if sum(text[i : i + GRAM] in there for i in range(grams)) < grams - GRAM * limit:
                    continue
            span = edit_span(text, region, limit)
            if span and not limit and not (_blank(data, lo + span[1] - 1, at[row], at[row + 1]) and _blank(data, lo + span[2], at[row], at[row + 1])):
                continue
            if span and (not old or (span[0], lo + span[1]) < (old[0], old[1])):
                best[row, item] = span[0], lo + span[1], lo + span[2]
        return [(row, self.ids[item], base + a, base + b, d) for (row, item), (d, a, b) in sorted(best.items())]


def _blank(data: np.ndarray, at: int, begin: int, end: int) -> bool:
    """Whether byte `at` is white space or outside the text."""
    return not begin <= at < end or data[at] in BLANK


#: The last index that this worker built, by the name of its block.
_built: dict[str, Index] = {}


def _index(name: str, items: list, p: Leaks) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(items, p)
    return _built[name]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    block, held = [], 0
    for r in benchmark.select(id_col, text_col).orderBy(id_col, text_col).toLocalIterator():
        block.append((r[0], r[1]))
        held += len((r[1] or "").encode())
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", p: Leaks = Leaks()) -> DataFrame:
    """One row per document and item that it holds: id, item, start and end (code points) and distance (bytes)."""
    kinds = df.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, start long, end long, distance long"
    item_type = to_arrow_type(kinds[1])
    docs = df.select(F.col(id_col), F.col(text_col))
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, p.block_bytes):
        shared, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, p)
            for batch in batches:
                raw, offs = text_buffers(batch.column(1))
                found = index.matches(raw, offs)
                points = lambda r, at: int(np.count_nonzero((raw[offs[r] : at] & 0xC0) != 0x80))  # noqa: B023,E731
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                columns = [pa.array(list(x), pa.int64()) for x in zip(*((points(r, a), points(r, b), d) for r, _, a, b, d in found))] or [pa.array([], pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in found], item_type), *columns], [id_col, item_col, "start", "end", "distance"])
                trim()

        parts.append(docs.mapInArrow(run, schema))
    out = parts[0] if parts else df.sparkSession.createDataFrame([], schema)
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def without_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", p: Leaks = Leaks()) -> DataFrame:
    """`df` without the rows that hold a benchmark item, whatever their ids; nothing is joined or exchanged."""
    where = df.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, p.block_bytes):
        shared, name = df.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, p)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in index.matches(*text_buffers(batch.column(where)))]] = False
                yield batch.filter(pa.array(clean))
                trim()

        df = df.mapInArrow(run, df.schema)
    return df
