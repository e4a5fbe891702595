"""Operators that SQL can't express against plain versions on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from athanor.llm.audio import Audio, audio_digests, audio_patches, clip_features, resample, segments, tensor_table, wav_bytes, wav_samples
from athanor.llm.components import components
from athanor.llm.decontamination import Index, Leaks, edit_search, edit_span, find_leaks
from athanor.llm.kernels import text_buffers
from athanor.llm.near_duplicates import NearDup, near_duplicate_classes
from athanor.llm.scratch import Scratch
from athanor.llm.secrets import ACCOUNT, ADDRESS, RANDOM, SECTION, _looks_random, linked_spans, redact_secrets, scan_secrets, secret_digests, strong_spans
from athanor.llm.sharding import histogram_shards
from athanor.llm.toxicity import toxicity_scores, windows


def _words(rng, n, base="abcdefgh"):
    return [" ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 6))) for _ in range(n))][0]


def _mutated(rng, text, share):
    return " ".join(rng.choice("qrstu") * 4 if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("hot", [2000, 3])
def test_near_duplicate_components(spark, monkeypatch, hot):
    monkeypatch.setattr("athanor.llm.near_duplicates.HOT_PAIRS", hot)
    rng = random.Random(5)
    texts = []
    for group in range(12):
        first = _words(rng, 60)
        texts += [first, first, _mutated(rng, first, 0.02), _mutated(rng, first, 0.05), _mutated(rng, first, 0.2)]
    one = _words(rng, 50)
    texts += [_mutated(rng, one, 0.03) for _ in range(90)]  # a large group of near copies
    texts += [_words(rng, 6) + " " + one[:60] for _ in range(40)] + ["", None, "a b"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    for p in (NearDup(), NearDup(small=4, block=8, block_shingles=200, part_blocks=1 + hot % 3)):
        got = {r.doc_id: r for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), p=p).collect()}
        assert {i: (len(sets[i]), find(i), find(i) == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}


def test_components_in_several_tasks(spark, monkeypatch):
    import athanor.llm.components as module

    rng = random.Random(1)
    links = [(a, a + 1) for a in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)]
    want = {}
    for a in {x for l in links for x in l}:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for l in links:
                if x in l:
                    for y in l:
                        if y not in seen:
                            seen.add(y)
                            todo.append(y)
        want[a] = min(seen)
    for limit in (500_000, 30):
        monkeypatch.setattr(module, "LOCAL_LINKS", limit)
        got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()}
        assert {a: got.get(a, a) for a in want} == want


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_search_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n))) for n in (7, 12))
        want = min(_edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert edit_search(a, b)[0] == want
        d, i, j = edit_span(a, b, len(a))
        assert d == want == _edit(a, b[i:j])


def test_planted_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    items = [(i, _words(rng, rng.choice((8, 20, 45)), "abcdefghijklmnop").capitalize() + ".") for i in range(30)]
    docs, want = [], set()
    for i in range(150):
        body = _words(rng, 80, "abcdefghijklmnop")
        item, text = rng.choice(items)
        kind = i % 3
        if kind == 1:
            body = body[:100] + " " + text + " " + body[100:]
        elif kind == 2:
            chars = list(text)
            for _ in range(len(chars) * 6 // 100):
                chars[rng.randrange(len(chars))] = rng.choice("xyz")
            body = body[:50] + " " + "".join(chars) + body[50:]
        if kind:
            want.add((i, item))
        docs.append((i, body))
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def test_copies_without_an_intact_word_pair_are_found(spark):
    rng = random.Random(8)
    items = [(i, _words(rng, 40, "abcdefghijklmnop")) for i in range(40)]
    docs, want = [], set()
    for i, text in items:
        typos = [w[:k] + "z" + w[k + 1 :] if n % 2 else w for n, w in enumerate(text.split()) for k in [rng.randrange(len(w))]]
        chars = list(text)
        for k in rng.sample(range(len(chars)), len(chars) * 16 // 100):
            chars[k] = rng.choice("qxz")
        docs += [(2 * i, f"{_words(rng, 30)} {' '.join(typos)} {_words(rng, 30)}"), (2 * i + 1, f"{_words(rng, 30)} {''.join(chars)} {_words(rng, 30)}")]
        want |= {(2 * i, i), (2 * i + 1, i)}
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want)


def _edited(rng, text, share, kind):
    chars = list(text)
    if kind == "even":
        return "".join(rng.choice("qxz") if i % share == share - 1 else c for i, c in enumerate(chars))
    for _ in range(len(chars) * share // 100):
        k = 0 if kind == "replaced" else rng.randrange(3)
        at = rng.randrange(len(chars))
        chars[at : at + (k < 2)] = [] if k == 1 else [rng.choice("abcdefghij ")]
    return "".join(chars)


def test_recall_of_copies_at_the_edit_limit():
    rng = random.Random(12)
    items = [(i, _words(rng, rng.choice((20, 30, 50)), "abcdefghijklmnop")) for i in range(60)]
    index = Index(items, Leaks())
    for share, kind in ((6, "any"), (10, "any"), (14, "any"), (18, "any"), (20, "any"), (20, "replaced"), (8, "even"), (6, "even")):
        docs = [f"{_words(rng, 30)} {_edited(rng, t, share, kind)} {_words(rng, 30)}" for _, t in items for _ in range(3)]
        raw, offs = text_buffers(pa.array(docs))
        got = {(r, i) for r, i, *_ in index.matches(raw, offs)}
        true = {(k, k // 3) for k, d in enumerate(docs) if edit_search(items[k // 3][1].encode(), d.encode())[0] <= len(items[k // 3][1]) * 20 // 100}
        assert len(true & got) >= (0.93 if kind == "even" else 0.97) * len(true), (share, kind)


def test_matches_are_exact_substrings_of_least_distance():
    rng = random.Random(13)
    items = [(i, _words(rng, 25, "abcdefgh")) for i in range(10)]
    docs = [f"{_words(rng, 9)} {_edited(rng, t, 8, 'any')} {_words(rng, 9)}" for _, t in items]
    raw, offs = text_buffers(pa.array(docs))
    for row, item, a, b, d in Index(items, Leaks()).matches(raw, offs):
        inside = raw[a:b].tobytes()
        assert offs[row] <= a <= b <= offs[row + 1] and _edit(items[item][1].encode(), inside) == d == edit_search(items[item][1].encode(), docs[row].encode())[0]


def test_short_items_and_batches_without_a_match(spark):
    items = spark.createDataFrame([("a", "one"), ("b", "a short item of words"), ("c", "nineteen bytes here"), ("d", "tiny text"), ("e", "nothing like it in any of these documents, whatever their length may be")], "item_id string, text string")
    rows = [(1, "bone onerous ones"), (2, "ONE"), (3, "this is a shirt item of words"), (4, "some nineteen bytes hare end"), (5, "a tinytext"), (6, None), (7, "one")]
    got = {(r.doc_id, r.item_id, r.distance) for r in find_leaks(spark.createDataFrame(rows, "doc_id int, text string"), items).collect()}
    assert got == {(2, "a", 0), (7, "a", 0), (3, "b", 1), (4, "c", 1), (5, "d", 1)}
    clean = spark.createDataFrame([(1, "not a word of that")], "doc_id long, text string")
    assert find_leaks(clean, items.filter("item_id = 'e'")).count() == 0
    assert find_leaks(clean, items.filter("false")).count() == 0


def test_blocks_and_slices_change_nothing(spark):
    rng = random.Random(14)
    items = [(i, _words(rng, 20, "abcdefghijklmnop")) for i in range(12)]
    rows = [(k, f"{_words(rng, 20)} {items[k % 12][1]} {_words(rng, 200)}") for k in range(24)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, find_leaks(docs, bench).collect()))
    assert [(r[0], r[1]) for r in want] == [(k, k % 12) for k in range(24)]
    assert sorted(map(tuple, find_leaks(docs, bench, p=Leaks(block_bytes=300, slice_bytes=100)).collect())) == want


def test_strong_spans_follow_the_patterns(spark):
    texts = ["password = 'hunter2secret' and TOKEN:abc", "key AKIA" + "Z" * 12 + " AKIAshort " + "a1" * 20, "api_key=\"x+/_.=-y\" é" * 3, "ſecret=longenough kelvin toKen=longenough", "passwd token=secret=abcdefgh", None]
    for r, text in zip(secret_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect(), texts):
        t = text or ""
        found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert {x[2] for x in found} <= set(r.spans.split(",")) | {""}


def test_weak_parts_are_linked_only_in_scope():
    weak = "aB3dE5gH7jK9mN1pQ3rS5tU7"
    account, host = "user: alice", "endpoint=db.example.org:5432"

    def kinds(text):
        return sorted(k for _, _, k in linked_spans(text, strong_spans(text), 100))

    assert kinds(f"{weak} alone") == [] and kinds(f"{account} alone") == [] and kinds(f"{host} alone") == []
    assert kinds(f"{account}, {weak}") == ["account", "random"]
    assert kinds(f"{account}, {weak} at {host}") == ["account", "address", "random"]
    assert kinds(f"{weak} {'x ' * 80} {account}") == []
    assert kinds(f"{account}\n\n{weak}") == []
    assert kinds(f"AKIA{'Q' * 16} {weak}") == ["random"]
    assert kinds(f"{account} password=longenough {host}") == ["account", "address"]


def _linked_by_pairs(text, reach):
    strong = strong_spans(text)
    weak = [(*m.span(), k) for k, x in (("account", ACCOUNT), ("random", RANDOM), ("address", ADDRESS)) for m in x.finditer(text) if k != "random" or _looks_random(m[0])]
    meet = lambda a, b: a[0] < b[1] and b[0] < a[1]
    weak = [w for w in weak if not any(meet(w, s) for s in strong)]
    roles = {"access": "id", "account": "id", "assign": "secret", "hex": "secret", "random": "secret"}
    out = []
    for w in weak:
        near = set()
        for s in strong + weak:
            a, b = sorted((w, s))
            if s != w and not meet(w, s) and b[0] - a[1] <= reach and not any(a[0] < m.start() < b[0] for m in SECTION.finditer(text)):
                near.add(roles.get(s[2]))
        if {"account": {"secret"}, "random": {"id"}, "address": {"id", "secret"}}[w[2]] <= near:
            out.append(w)
    return sorted(out)


def test_linking_equals_all_pairs():
    rng = random.Random(11)
    parts = ["user: alice", "login=aB3dE5gH7jK9mN1pQ3rS5tU7", "client_id=Zx81kLmQw92PoRtYuB73cVnM", "aB3dE5gH7jK9mN1pQ3rS5tU7", "endpoint=db.example.org:5432", "https://Zx81kLmQw92PoRtYuB73cVnM.example/x", "password=longenough", "AKIA" + "Q" * 16, "a1" * 20, "words", "x " * 30, "\n", "\n\n", "\n \t\n"]
    seen = set()
    for _ in range(3000):
        text = rng.choice((" ", ", ", "\n")).join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        got = sorted(linked_spans(text, strong_spans(text), 60))
        assert got == _linked_by_pairs(text, 60), text
        seen |= {k for _, _, k in got}
    assert seen == {"account", "random", "address"}


def test_one_value_alone_is_no_credential():
    for text in ("login: aB3dE5gH7jK9mN1pQ3rS5tU7 and nothing else", "client_id=Zx81kLmQw92PoRtYuB73cVnM", "username: JohnSmithFromOslo1984"):
        assert linked_spans(text, strong_spans(text), 400) == []


def test_linked_parts_are_reported_and_redacted(spark):
    docs = spark.createDataFrame([(1, "user: alice\nkey aB3dE5gH7jK9mN1pQ3rS5tU7\nhost=db.example.org"), (2, "user: alice")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secret_digests(docs).collect()}
    assert spans == {1: "account:0:11,random:16:40,address:41:60", 2: ""}
    assert [r.text for r in redact_secrets(docs).orderBy("doc_id").collect()] == ["<account>\nkey <random>\n<address>", "user: alice"]


@pytest.mark.parametrize("cell_rows,broadcast", [(4096, 200_000), (20, 200_000), (20, 0)])
def test_shards_are_even_and_gapless(spark, monkeypatch, cell_rows, broadcast):
    monkeypatch.setattr("athanor.llm.sharding.BROADCAST_CELLS", broadcast)
    rng = random.Random(4)
    hot = _words(rng, 30)
    rows = [(i, hot if i % 3 == 0 else _words(rng, rng.randint(0, 40))) for i in range(3000)] + [(9000 + i, None) for i in range(20)]
    got = histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=16, bins=64, cell_rows=cell_rows).collect()
    text = dict(rows)
    by = {}
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(16)) and len(got) == len(rows)
    sums = [sum(r["size"] for r in x) for x in by.values()]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got) + 0.01 * sum(sums) / 16
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    # Equal texts lie together: over all shards in order, a text is one run of slots, its rows in a fixed order.
    runs = [text[r.doc_id] or "" for _, x in sorted(by.items()) for r in sorted(x, key=lambda r: r.slot)]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == len(set(runs)) - 1


def test_audio_round_trip_and_shapes(spark):
    data = bytes(range(256)) * 3
    assert wav_samples(wav_bytes(data, 12_000)) == (data, 12_000)
    text = "sounds like " * 400 + "é"
    r = audio_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    raw = text.encode()
    want = raw + b" " * (-len(raw) % 192)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
    assert r.media_bytes == len(want) + 44 and r.media_sha256 == hashlib.sha256(wav_bytes(want, 12_000)).hexdigest()
    p = Audio()
    patches = audio_patches(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("patch").toArrow()
    tensors = tensor_table(patches)["tensor"]
    frames, count, n_spans, voiced, _, digest, means = r.feature.split("|")
    assert tensors.type.shape == [p.patch, p.bands] and len(tensors) == int(count) == -(-int(frames) // p.patch)
    rows = zip(*(patches[c].to_pylist() for c in ("start_s", "end_s", "voiced", "tensor")))
    assert digest == hashlib.sha256(b"".join(np.array(x[:3], "<f8").tobytes() + np.array(x[3], "<f4").tobytes() for x in rows)).hexdigest()
    assert round(sum(patches["voiced"].to_pylist()) * p.patch) == int(voiced) and len(means.split(",")) == p.bands
    starts, ends = patches["start_s"].to_pylist(), patches["end_s"].to_pylist()
    assert all(a < b for a, b in zip(starts, ends)) and starts == sorted(starts)


def _plain_features(data, p):
    """Log-mel frames and segments from their definitions, sample by sample and frame by frame."""
    x = [(b - 128) / 128 for b in data]
    at = lambda i: x[min(max(i, 0), len(x) - 1)]
    up, down = 2, 3
    n = up * p.taps
    h = [np.sinc((i - (n - 1) / 2) / up * min(1, up / down)) * (0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1))) for i in range(n)]
    y = []
    for j in range(-(-len(x) * up // down)):
        k, phase = divmod(j * down, up)
        c = [h[(p.taps - 1 - i) * up + phase] for i in range(p.taps)]
        y.append(sum(c[i] * at(k - p.taps // 2 + i) for i in range(p.taps)) / sum(c))
    y += [0.0] * max(0, p.frame - len(y))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** ((mel(60) + (mel(p.target_rate / 2) - mel(60)) * i / (p.bands + 1)) / 2595) - 1) for i in range(p.bands + 2)]
    bands, energy = [], []
    for f in range(1 + (len(y) - p.frame) // p.hop):
        part = np.array(y[f * p.hop : f * p.hop + p.frame])
        part = (part - part.mean()) * np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / (p.frame - 1)) for i in range(p.frame)])
        power = np.abs(np.array([sum(part * np.exp(-2j * np.pi * k * np.arange(p.frame) / p.frame)) for k in range(p.frame // 2 + 1)])) ** 2
        row = []
        for b in range(p.bands):
            a, m, z = edges[b : b + 3]
            hz = [k * p.target_rate / p.frame for k in range(len(power))]
            row.append(math.log(max(sum(w * max(0, min((q - a) / (m - a), (z - q) / (z - m))) for w, q in zip(power, hz)), 1e-6)))
        bands.append(row)
        energy.append(10 * math.log10(max((part**2).mean(), 1e-9)))
    floor, spans, begin, high = np.percentile(energy, 10), [], None, False
    for f, e in enumerate([*energy, -1e9]):
        if e >= floor + p.leave_db:
            begin, high = (f if begin is None else begin), high or e >= floor + p.enter_db
        elif begin is not None:
            spans += [(begin, f)] if high else []
            begin, high = None, False
    return np.array(bands), spans


@pytest.mark.parametrize("blocks", [1, 16])
def test_audio_features_follow_their_definitions(blocks):
    p = Audio(block_patches=blocks, patch=8)
    rng = random.Random(15)
    for size in (192, 384, 192 * 20):
        loud = lambda i: 60 if i // 900 % 2 else 5
        data = bytes(128 + rng.randint(-loud(i), loud(i)) for i in range(size))
        clip = clip_features(data, p.source_rate, p)
        got = np.concatenate([x.tensors for x in clip.patches]).reshape(-1, p.bands)
        bands, spans = _plain_features(data, p)
        assert clip.frames == len(bands) and clip.spans == spans
        assert np.abs(got[: clip.frames] - bands).max() < 2e-3 and (got[clip.frames :] == np.float32(math.log(1e-6))).all()


def test_blocks_do_not_change_a_long_clip():
    data = bytes(random.Random(16).randbytes(192 * 700))
    one, two = (clip_features(data, 12_000, Audio(block_patches=b)) for b in (1, 1000))
    assert one.spans == two.spans
    parts = [np.concatenate([x.tensors for x in clip.patches]) for clip in (one, two)]
    assert parts[0].shape == parts[1].shape and np.abs(parts[0] - parts[1]).max() < 1e-3


def test_resampling_keeps_a_tone():
    t = np.arange(12_000) / 12_000
    out = resample(np.sin(2 * np.pi * 440 * t), 2, 3, 12)
    assert len(out) == 8000
    spectrum = np.abs(np.fft.rfft(out))
    assert abs(int(spectrum.argmax()) - 440) <= 1


def test_segments_need_the_upper_threshold():
    energy = np.array([0, 0, 2, 2, 0, 0, 2, 5, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], float)
    assert segments(energy, 3, 1.5) == [(6, 9)]


def test_windows_are_those_of_the_words():
    rng = random.Random(17)
    texts = [b"", b"  ", b"one", "é ü ß\tö".encode(), b"a b c d e f"] + [_words(rng, rng.randint(0, 20)).encode() for _ in range(50)]
    cut, counts = windows(texts, 3)
    want = [[w[i : i + 3] for i in range(0, max(len(w), 1), 3)] for w in (t.split() for t in texts)]
    doubled = lambda t: bytes(c for c in t for _ in range(2))
    assert counts.tolist() == [len(x) for x in want]
    assert [bytes(x.tobytes()) for x in cut] == [doubled(b" " + b" ".join(w) + b" ") for x in want for w in x]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["vile", "stinker", "wretch", "numbskull"]
    rows, labels = [], []
    for i in range(900):
        text = _words(rng, 60, "aeioustnr").split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        if i % 10:
            labels.append((i, y))
    got = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)


def test_array_spans(spark):
    r = scan_secrets(spark.createDataFrame([("token=abcdefgh1",)], "text string")).first()
    assert [(s.kind, s.start, s.end) for s in r.spans] == [("assign", 0, 15)]
