"""Deleted interpolation against a plain computation of the same counts, mixture and EM."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import pytest

import athanor.llm.language_model as module
from athanor.llm.language_model import Interpolation, interpolated_scores
from athanor.llm.scratch import Scratch

P = Interpolation(order=2, chunk_tokens=60, range_entries=40, rounds=4)
TEXTS = ["the cat sat on the mat", "The Cat sat\ton a  mat", None, "", "a dog sat on the cat", "the dog", "übér the cat", "the the the the", "dog sat on the mat and the cat sat on it"] * 4


def plain(rows, p):
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    tokens = {i: [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] + [None] for i, t in rows}
    orders = range(1, p.order + 1)

    def grams(ts):
        padded = [None] * (p.order - 1) + ts
        for j in range(len(ts)):
            yield {m: tuple(padded[j + p.order - m : j + p.order]) for m in orders}

    def counted(folds):
        gram, context = {m: Counter() for m in orders}, {m: Counter() for m in orders}
        for i, ts in tokens.items():
            if fold[i] in folds:
                for g in grams(ts):
                    for m in orders:
                        gram[m][g[m]] += 1
                        context[m][g[m][:-1]] += 1
        return gram, context

    def bucket(g, context):
        for m in range(p.order, 1, -1):
            if context[m][g[m][:-1]]:
                return (m - 2) * p.buckets + min(context[m][g[m][:-1]].bit_length(), p.buckets - 1)
        return 0

    def terms(l, g, gram, context):
        n, v = sum(gram[1].values()), len(gram[1])
        out = [l[k] * (gram[m][g[m]] / context[m][g[m][:-1]] if context[m][g[m][:-1]] else 0) for k, m in enumerate(range(p.order, 1, -1))]
        return [*out, l[-2] * gram[1][g[1]] / max(n, 1), l[-1] / (v + 1)]

    left = counted({0, 3, 4})
    lam = [[1 / (p.order + 1)] * (p.order + 1) for _ in range(max(1, p.order - 1) * p.buckets)]
    for _ in range(p.rounds):
        sums = {}
        for i, ts in tokens.items():
            if fold[i] == 2:
                for g in grams(ts):
                    k = bucket(g, left[1])
                    x = terms(lam[k], g, *left)
                    own = sums.setdefault(k, [0] * len(x))
                    for j in range(len(x)):
                        own[j] += x[j] / sum(x)
        for k, own in sums.items():
            own = [max(x / sum(own), p.least) for x in own]
            lam[k] = [x / sum(own) for x in own]
    gram, context = counted({0, 2, 3, 4})
    n, v = sum(gram[1].values()), len(gram[1])
    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10((gram[1][b,] + 0.5) / (n + 0.5 * (v + 1))) for b in ts)
        score = sum(math.log10(sum(terms(lam[bucket(g, context)], g, gram, context))) for g in grams(ts))
        out[i] = (fold[i] == 1, len(ts), sum(gram[1][b,] > 0 for b in ts), n, base, score)
    return out


@pytest.mark.parametrize("changes", [{}, {"order": 3}, {"order": 1}, {"order": 4, "fan": 3}, {"fan": 3}, {"fan": 2, "range_entries": 10, "chunk_tokens": 20}])
def test_scores_equal_plain_computation(spark, changes):
    """At any order, and with one level of ranges or with several."""
    p, rows = replace(P, **changes), list(enumerate(TEXTS))
    got = interpolated_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p=p).collect()
    want = plain(rows, p)
    assert len(got) == len(rows)
    for r in got:
        for a, b in zip((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id]):
            assert a == b or abs(a - b) < 1e-9


def test_rows_of_the_layout_grow_with_the_corpus(spark, monkeypatch):
    """Rows of every level over 1, 4 and 16 times the texts, at small parameters: no product of chunks and ranges."""
    rng = random.Random(9)
    p = replace(P, chunk_tokens=50, range_entries=50, fan=4, rounds=1)
    rows: dict[int, list[int]] = {}
    kept = Scratch.drop
    monkeypatch.setattr(Scratch, "drop", lambda self, name="": None)
    for times in (1, 4, 16):
        sizes = []
        found = module._chunk_entries
        monkeypatch.setattr(module, "_chunk_entries", lambda *a: (out := found(*a), sizes.append(out.count()))[0])
        roots = []
        made = Scratch.__init__
        monkeypatch.setattr(Scratch, "__init__", lambda self, s, n: (made(self, s, n), roots.append(self.root))[0])
        texts = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(40))) for i in range(20 * times)]
        interpolated_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), p=p).count()
        monkeypatch.setattr(Scratch, "__init__", made)
        monkeypatch.setattr(module, "_chunk_entries", found)
        size = sum(len(t) for _, t in texts)
        levels = len(p.fans(size))
        rows[times] = sizes + [spark.read.parquet(f"{roots[0]}/merged-{k}").count() for k in range(levels, 1, -1)]
        assert all(x <= 1.7 * p.fan * (size / 6 / p.chunk_tokens + 2) for x in rows[times]), rows
    monkeypatch.setattr(Scratch, "drop", kept)
    assert len(rows[16]) > len(rows[1])


def test_text_ids(spark):
    rows = [("a", "b c"), (None, "b c"), ("x y", "b")]
    got = {r.doc_id: r.n_tokens for r in interpolated_scores(spark.createDataFrame(rows, "doc_id string, text string"), p=P).collect()}
    assert got == {"a": 3, None: 3, "x y": 2}


def test_empty_table(spark):
    assert interpolated_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_id_and_repeated_rows(spark):
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, "a b")]
    got = interpolated_scores(spark.createDataFrame(rows, "doc_id long, text string"), p=P).collect()
    assert len(got) == 4 and len({(r.n_tokens, round(r.score, 9)) for r in got}) == 1
