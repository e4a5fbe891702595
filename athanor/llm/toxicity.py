"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on toxic text.  A text is cut into windows of
a few words; a window's gain is the length it compresses to with the ordinary dictionary less that with the toxic one.
Windows are counted whose gain reaches each of a few thresholds, and the counts and their shares make a score by a logistic
calibration, which weighs the thresholds and sets the last one, 0.5; the mean gain ranks texts below them.

Two things keep chance out of the gains.  The text that the toxic dictionary is trained on is what toxic documents
hold significantly more often than ordinary ones, word by word: whole toxic texts are mostly ordinary, and a trainer fills its
dictionary with that.  And the toxic coder has the ordinary content nearest, the toxic content behind it, so ordinary words
compress alike in both.  Every byte is written twice before compression, so that a match's fixed cost weighs less.
How significant a word must be is what gives the least loss on examples that the dictionaries have not seen.

The classifier is fitted on at most `toxic_sample` and `ordinary_sample` labelled documents, those with the
smallest hashed ids, and at most `sample_bytes` of them; scoring covers every window of every text.

Cases: null text counts as empty and is one empty window; labels that are null are not learned from; without
toxic or without ordinary examples every score is the learned documents' share of toxic ones (0 without any);
repeated rows have equal scores; extra columns pass by unless they have a result's name.
"""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import trim, word_starts


@dataclass(frozen=True)
class Toxicity:
    window_words: int = 6
    #: A word is typical of toxic documents at so many times the rate of ordinary ones, and at this likelihood ratio.
    ratio: float = 5.0
    significance: float = 20.0
    #: Shares of the most significant word's ratio that a word must reach; one is chosen.
    shares: tuple[float, ...] = (0.1, 0.2)
    #: Gains that a window must reach to count.
    gains: tuple[int, ...] = (4, 6, 8, 10)
    ordinary_bytes: int = 112_640
    #: Twice the bytes of distinct words that the toxic dictionary takes, at most.
    toxic_bytes: int = 1 << 17
    level: int = 9
    #: Doubled bytes that a match needs.
    min_match: int = 6
    toxic_sample: int = 2000
    ordinary_sample: int = 8000
    sample_bytes: int = 32 << 20
    #: Examples of each kind, at most, for the choice.
    tuning: tuple[int, int] = (600, 1200)
    #: Windows of ordinary text to train on.
    training_windows: int = 60_000


def _lowered(text: str | None) -> bytes:
    return (text or "").lower().encode()


EDGE = b".,;:!?\"'()[]{}<>*#|-"


def _tokens(text: bytes) -> set[bytes]:
    return {w for w in (x.strip(EDGE) for x in text.split()) if w}


def typical_words(toxic: list[bytes], ordinary: list[bytes], p: Toxicity) -> dict[bytes, float]:
    """Words that toxic texts hold significantly more often, with their likelihood ratios."""
    ours, theirs = Counter(w for t in toxic for w in _tokens(t)), Counter(w for t in ordinary for w in _tokens(t))
    a, b = len(toxic), len(ordinary)
    found: dict[bytes, float] = {}
    for w, n in ours.items():
        m = theirs[w]
        if n / a > p.ratio * (m + 0.5) / b:
            expected = (n + m) * a / (a + b)
            g = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0))
            if g >= p.significance:
                found[w] = g
    return found


def _doubled(text: bytes) -> bytes:
    return np.repeat(np.frombuffer(text, np.uint8), 2).tobytes()


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; where they are too few for the trainer, the samples themselves."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 2)), samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def ordinary_dictionary(texts: list[bytes], p: Toxicity) -> bytes:
    step = max(1, sum(t.count(b" ") + 1 for t in texts) // p.window_words // p.training_windows)
    windows = [_doubled(b" %b " % b" ".join(w[i : i + p.window_words])) for w in (t.split() for t in texts) for i in range(0, len(w), p.window_words * step)]
    return _trained(windows, p.ordinary_bytes) if windows else b""


def toxic_dictionary(texts: list[bytes], typical: dict[bytes, float], share: float, p: Toxicity) -> bytes:
    least = share * max(typical.values(), default=0.0)
    taken = {w for w, g in typical.items() if g >= least}
    samples = [_doubled(b" %b " % b" ".join(own)) for own in (sorted(_tokens(t) & taken) for t in texts) if own]
    samples.sort(key=lambda x: (zlib.crc32(x), x))  # the trainer only tries its choice on the last ones, so they are mixed
    size = min(p.toxic_bytes, 4 * sum(len(w) + 2 for w in taken) + 2048)  # the trainer puts its own tables in as well
    return _trained(samples, size) if samples else b""


def windows(texts: list[bytes], n: int) -> tuple[zstandard.BufferWithSegments, np.ndarray]:
    """The doubled windows of `n` words, end to end, with the number of them in each text; a text without words has one."""
    joined = [b" %b " % b" ".join(t.split()) for t in texts]
    data = np.frombuffer(b"".join(joined), np.uint8)
    ends = np.cumsum([len(x) for x in joined])
    begins = np.concatenate(([0], ends[:-1]))
    starts = word_starts(data, begins)
    text = np.searchsorted(ends, starts, side="right")
    first = np.searchsorted(starts, begins)
    count = np.diff(np.append(first, len(starts)))
    lead = starts[(np.arange(len(starts)) - first[text]) % n == 0] - 1  # from the space before the first word
    counts = np.maximum(1, -(-count // n))
    lead = np.sort(np.concatenate((lead, begins[count == 0])))
    last = np.append(lead[1:] + 1, len(data))
    last[np.cumsum(counts) - 1] = ends
    segments = np.stack((lead * 2, (last - lead) * 2), axis=1).astype(np.uint64)
    return zstandard.BufferWithSegments(np.repeat(data, 2).tobytes(), segments.tobytes()), counts


@dataclass
class Scorer:
    """A fitted classifier; `constant` stands in where nothing could be learned."""

    p: Toxicity
    plain: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None
    threads: int = 0  # more than one only while the driver fits
    _tools: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None, "threads": 0}

    def _compressors(self) -> tuple:
        if self._tools is None:
            made = []
            for content in (self.plain, self.toxic + self.plain):
                how = zstandard.ZstdCompressionParameters.from_level(self.p.level, min_match=self.p.min_match, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
            self._tools = tuple(made)
        return self._tools

    def gains(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the windows' gains, the number of windows of each text)."""
        cut, counts = windows(texts, self.p.window_words)
        plain, toxic = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(cut, threads=self.threads)), np.int64, len(cut)) for c in self._compressors())
        return plain - toxic, counts

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Counts of the windows over each gain and their shares and the mean gain, about a MB of texts at a time."""
        out, i = np.ones((len(texts), 2 + 2 * len(self.p.gains))), 0
        while i < len(texts):
            j, held = i + 1, len(texts[i])
            while j < len(texts) and held + len(texts[j]) <= 1 << 20:
                held += len(texts[j])
                j += 1
            gains, counts = self.gains(texts[i:j])
            first = np.cumsum(counts) - counts
            over = [np.add.reduceat((gains >= g).astype(np.int64), first) for g in self.p.gains]
            out[i:j, 1:] = np.stack((*map(np.log1p, over), *(np.sqrt(x / counts) for x in over), np.add.reduceat(gains, first) / counts), axis=1)
            i = j
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _logistic(self.features([_lowered(t) for t in texts]) @ self.weights)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _calibrated(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights, by Newton steps of the ridge-penalised likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        q = _logistic(x @ w)
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (toxic - q) - 0.1 * w)
    return w


def _loss(q: np.ndarray, toxic: np.ndarray) -> float:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return float(-(toxic * np.log(q) + (1 - toxic) * np.log(1 - q)).mean())


def fit(texts: list[str | None], toxic: list[bool], p: Toxicity = Toxicity()) -> Scorer:
    lowered = [_lowered(t) for t in texts]
    bad, good = [t for t, y in zip(lowered, toxic) if y], [t for t, y in zip(lowered, toxic) if not y]
    if not bad or not good:
        return Scorer(p, constant=float(bool(bad)))
    plain = ordinary_dictionary(good, p)
    if not plain:
        return Scorer(p, constant=len(bad) / len(lowered))
    share, threads = p.shares[0], min(8, os.cpu_count() or 1)
    some, other = bad[: p.tuning[0]], good[: p.tuning[1]]
    if min(len(some), len(other)) >= 40:
        cuts = len(some) * 3 // 4, len(other) * 3 // 4
        seen, unseen = some[: cuts[0]] + other[: cuts[1]], some[cuts[0] :] + other[cuts[1] :]
        truths = np.array([1.0] * cuts[0] + [0.0] * cuts[1]), np.array([1.0] * (len(some) - cuts[0]) + [0.0] * (len(other) - cuts[1]))
        typical = typical_words(some[: cuts[0]], other[: cuts[1]] + good[len(other) : 3 * len(other)], p)
        losses = []
        for s in p.shares:
            one = Scorer(p, plain, toxic_dictionary(some[: cuts[0]], typical, s, p), threads=threads)
            w = _calibrated(one.features(seen), truths[0])
            losses.append((_loss(_logistic(one.features(unseen) @ w), truths[1]), s))
        # Ratios grow with the examples, so what was significant among fewer of them is a share as well.
        share = max(min(losses)[1], p.significance / max(typical.values(), default=p.significance))
    out = Scorer(p, plain, toxic_dictionary(bad, typical_words(bad, good, p), share, p), threads=threads)
    out.weights = _calibrated(out.features(lowered), np.array(toxic, float))
    return out


def learn(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, keep: Column, p: Toxicity) -> Scorer:
    """Fit on a bounded sample of the labelled rows for which `keep` holds: so many rows and bytes at most."""
    known = labels.filter(keep & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).alias("label"))
    order = (F.xxhash64(id_col), F.col(id_col))
    examples = []
    for label, rows in ((1, p.toxic_sample), (0, p.ordinary_sample)):
        picked = known.filter(F.col("label") == label).orderBy(*order).limit(rows)
        own = df.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(picked), id_col)
        some = own.orderBy(*order, "text").limit(rows)  # ids may repeat
        upto = F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).over(Window.orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0))
        share = rows / (p.toxic_sample + p.ordinary_sample)
        examples += [(r["text"], label == 1) for r in some.withColumn("upto", upto).filter(F.col("upto") <= int(p.sample_bytes * share)).select("text").collect()]
    return fit([t for t, _ in examples], [y for _, y in examples], p)


def scored(df: DataFrame, scorer: Scorer, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with score (0 to 1, higher: more likely toxic); without the text where it isn't wanted."""
    names = [c for c in df.columns if c != "score"]
    kept = df.select(*names)
    where = names.index(text_col)
    out = [i for i, c in enumerate(names) if keep_text or c != text_col]
    shared = df.sparkSession.sparkContext.broadcast(scorer)  # two dictionaries, of bounded bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = pa.array(own.scores(batch.column(where).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), scores], [*(names[i] for i in out), "score"])
            trim()

    schema = StructType([*(kept.schema.fields[i] for i in out), StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", p: Toxicity = Toxicity()) -> DataFrame:
    """Per row: id, held_out (its fold is 0 and was not learned from), score and predicted."""
    scorer = learn(df, labels, id_col, text_col, label_col, fold(id_col) != 0, p)
    out = scored(df.select(id_col, text_col), scorer, text_col, keep_text=False)
    return out.select(id_col, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", p: Toxicity = Toxicity()) -> DataFrame:
    """`df` without the documents predicted as toxic."""
    scorer = learn(df, labels, id_col, text_col, label_col, fold(id_col) != 0, p)
    return scored(df, scorer, text_col).filter("score < 0.5").select(*df.columns)
