"""Secret scans with multipart credential linking.

Strong spans stand alone: assigned values, access identifiers and long hex runs.  Weak candidates (account
names, random-looking tokens, service addresses) say nothing alone; they are interval-joined with the other
parts inside a scope, which is a section of the text (blank lines end it) and at most `reach` code points
between two parts.  A weak secret is reported when an identifier lies in its scope, a weak identifier when a
secret does, an address when both do.  Spans that overlap are one part of a credential and never complement
each other.  The join looks up the nearest parts among sorted edges, one text at a time, so a text of any length
costs in proportion to its candidates (and a logarithm) and nothing is shuffled.

Cases: null text counts as empty and has no span; a weak candidate that overlaps a strong span is that span;
repeated rows give repeated rows; extra columns pass by unless they have a result's name.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# The patterns of strong spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that have 32 characters or more

ACCOUNT = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ADDRESS = re.compile(r"""(?:https?|ftp|s3|jdbc:[a-z0-9]+|mongodb|redis|amqp|mysql|postgres(?:ql)?)://[^\x20\x09-\x0D"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?""", re.ASCII | re.IGNORECASE)
SECTION = re.compile(r"\n[\x20\t\r]*\n")

KINDS = ("assign", "access", "hex", "account", "random", "address")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_IDS, _SECRETS = ("access", "account"), ("assign", "hex", "random")
Span = tuple[int, int, str]


def strong_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those too short dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def _looks_random(token: str) -> bool:
    counts = Counter(token)
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts.values())
    return entropy >= 3.5 and any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


def linked_spans(text: str, strong: list[Span], reach: int) -> list[Span]:
    """The weak candidates whose complementary parts lie in their scope."""
    low = text.lower()
    named = any(k in low for k in ("user", "login", "account", "client", "key"))
    weak: list[Span] = [(*m.span(), "account") for m in ACCOUNT.finditer(text)] if named else []
    if not weak and all(s[2] not in _IDS for s in strong):
        return []  # every rule needs an identifier
    weak += [(*m.span(), "random") for m in RANDOM.finditer(text) if _looks_random(m[0])]
    weak += [(*m.span(), "address") for m in ADDRESS.finditer(text)]
    if strong:
        starts, furthest, most = [s[0] for s in strong], [], 0
        for s in strong:
            furthest.append(most := max(most, s[1]))
        weak = [w for w in weak if not ((k := bisect.bisect_left(starts, w[1])) and furthest[k - 1] > w[0])]
    breaks = [m.start() for m in SECTION.finditer(text)]
    section = lambda at: bisect.bisect_right(breaks, at)
    near: dict[Span, set[str]] = {w: set() for w in weak}
    for role, kinds in (("id", _IDS), ("secret", _SECRETS)):
        # No span crosses a section's end, so the nearest part on either side that does not overlap decides.
        ends = sorted((s[1], s[0]) for s in [*strong, *weak] if s[2] in kinds)
        begins = sorted(s[0] for s in [*strong, *weak] if s[2] in kinds)
        for w in weak:
            before, after = bisect.bisect_right(ends, (w[0], w[0])) - 1, bisect.bisect_left(begins, w[1])
            if before >= 0 and w[0] - ends[before][0] <= reach and section(ends[before][1]) == section(w[0]):
                near[w].add(role)
            if after < len(begins) and begins[after] - w[1] <= reach and section(begins[after]) == section(w[0]):
                near[w].add(role)
    needs = {"account": {"secret"}, "random": {"id"}, "address": {"id", "secret"}}
    return [w for w in weak if needs[w[2]] <= near[w]]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))


def scan_secrets(df: DataFrame, text_col: str = "text", reach: int = 400) -> DataFrame:
    """`df` with spans, an array of (kind, start, end) in code points, end exclusive, by start then kind."""
    names = [c for c in df.columns if c != "spans"]
    kept = df.select(*names)
    where = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(where).to_pylist():
                strong = strong_spans(text) if text else []
                every = strong + linked_spans(text, strong, reach) if text else []
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in sorted(every, key=lambda s: (s[0], _ORDER[s[2]], s[1]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "spans"])

    schema = StructType([*kept.schema.fields, StructField("spans", ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])))])
    return kept.mapInArrow(run, schema)


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 400) -> DataFrame:
    """Per document the counts of strong spans, their digest and all spans as text; the texts stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                strong = strong_spans(text) if text else []
                counts = Counter(s[2] for s in strong)
                every = strong + linked_spans(text, strong, reach) if text else []
                rows.append((counts["assign"], counts["access"], counts["hex"], hashlib.sha256(_joined(strong).encode()).hexdigest(), _joined(every)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(df: DataFrame, text_col: str = "text", reach: int = 400, mark: str = "<{}>") -> DataFrame:
    """`df` with every found span of the text replaced by its kind; overlapping spans are replaced as one, under
    the first one's kind.  Texts without a span, null included, stay as they are."""
    names = df.columns
    where = names.index(text_col)

    def clean(text: str | None) -> str | None:
        strong = strong_spans(text) if text else []
        every = sorted(strong + linked_spans(text, strong, reach) if text else [], key=lambda s: (s[0], _ORDER[s[2]]))
        out, at = [], 0
        for a, b, kind in every:
            if a >= at:
                out += [text[at:a], mark.format(kind)]
            at = max(at, b)
        return "".join([*out, text[at:]]) if every else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[where] = pa.array([clean(t) for t in columns[where].to_pylist()], columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)
