"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are long runs of key characters.  Each belongs to a character class
(hexadecimal, alphanumeric, base64); a window slides over it and keeps character
counts up to date as one character enters and one leaves, so that the entropy of
every window costs constant time.  Windows above their class's threshold make a
span, unless an allow-list pattern explains the candidate; what fixed patterns have
already found is taken out of it, and the rest stays.  A filler explains only the part
of a candidate, between separators, that holds it.

Edge cases: null and empty texts have no spans; long texts are scanned whole;
repeated rows are scanned alike; an input column named ``spans`` is replaced.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrow import cut_out, give_back, replaced, text_slices, with_struct

#: Kinds in the order in which spans of one start are listed; ``entropy`` is what the windows add.
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character that a window of each class must reach, of at most 4, log2(20) and log2(20).
THRESHOLDS = {"hex": 3.1, "alnum": 3.7, "base64": 3.8}
#: Candidates that are known not to be secrets: UUIDs, content digests with their name, dates and numbers, repeated or counted-up fillers, paths of plain words.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",
    r"[0-9+/_=-]+",
    r"[A-Za-z+/_=-]+",
    r"(?:[A-Za-z]+[0-9]{0,4}[/_=+-]+)+[A-Za-z]*[0-9]{0,4}",
    r"(?P<filler>.*(?:EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ).*)",
)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN_LEAST, _RUN_LEAST = 6, 20
_SEPARATORS = "+/=_-"
_FILLED = re.compile(r"[A-Za-z0-9+]*(?:EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ)[A-Za-z0-9+]*")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GROWTH = [0.0] + [n * math.log2(n) for n in range(1, 4096)]

SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def character_class(value: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return "hex"
    return "alnum" if value.isalnum() else "base64"


def mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def window_spans(value: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """The joined windows of ``value`` whose entropy reaches ``threshold``.

    With counts c of n characters the entropy is log2(n) - sum(c log2 c) / n; the sum
    changes by two terms as the window moves on.
    """
    n = min(window, len(value))
    counts: dict[str, int] = {}
    total = 0.0
    limit = (math.log2(n) - threshold) * n + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(value):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _GROWTH[k + 1] - _GROWTH[k]
        if i >= n:
            old = value[i - n]
            k = counts[old]
            counts[old] = k - 1
            total -= _GROWTH[k] - _GROWTH[k - 1]
        if i >= n - 1 and total <= limit:
            start = i - n + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def unexplained(value: str, window: int, allowed: re.Pattern | None) -> list[tuple[int, str]]:
    """The stretches of a candidate that the allow list does not explain, with their places.

    A pattern explains the whole candidate; the one named ``filler`` only parts between separators, and the rest is judged anew.
    """
    why = allowed.fullmatch(value) if allowed is not None else None
    if why is None:
        return [(0, value)]
    if why.lastgroup != "filler":
        return []
    cuts = [(0, 0), *(m.span() for m in _FILLED.finditer(value)), (len(value), len(value))]
    rest = [(a, value[a:b]) for (_, a), (b, _) in zip(cuts, cuts[1:]) if b - a >= window]
    return [(a, part) for a, part in rest if not allowed.fullmatch(part.strip("/=_-"))]


class Found:
    """What fixed patterns have found: joined stretches, in order, to be taken out of others."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def left_over(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """What of the stretch lies outside."""
        for i in range(bisect.bisect_right(self.ends, a), len(self.starts)):
            if self.starts[i] >= b:
                break
            if a < self.starts[i]:
                yield a, self.starts[i]
            a = self.ends[i]
        if a < b:
            yield a, b


def scan(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """Spans of one text as (start, end, place of the kind in KINDS), sorted by start, then kind; the work grows with the text's length."""
    assigned, keys = [], []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        assigned = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    runs = [run.span() for run in _RUN.finditer(text)]  # what the other kinds match lies inside such a run
    for a, b in runs:
        keys += [(m.start(), m.end(), kind) for kind, pattern in ((1, _ACCESS), (2, _HEX)) for m in pattern.finditer(text, a, b)]
    known, starts, ends, found = Found(assigned + keys), {k[0] for k in keys}, {k[1] for k in keys}, assigned + keys
    for a, b in runs:
        for at, value in unexplained(text[a:b], window, allowed):
            for x, y in window_spans(value, window, thresholds[character_class(value)]):
                if not mixed(value[x:y]):
                    continue
                for s, e in known.left_over(a + at + x, a + at + y):
                    # beside a found key stays what looks like a key itself, or goes on without a separator
                    goes_on = s in ends and text[s] not in _SEPARATORS or e in starts and text[e - 1] not in _SEPARATORS
                    if mixed(text[s:e]) or goes_on:
                        found.append((s, e, 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def find(df: DataFrame, text_col: str = "text", window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allow_list: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Add ``spans``: kind, start and end (code points, end exclusive) of every secret in the whole text."""
    pattern = "|".join(f"(?:{p})" for p in allow_list)

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        allowed = re.compile(pattern, re.DOTALL) if pattern else None
        for texts in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(t, window, thresholds, allowed)] for part in text_slices(texts) for t in part]
            yield pa.StructArray.from_arrays([pa.array(rows, _SPANS_ARROW)], ["spans"])

    return with_struct(df, spans(F.col(text_col)), SPANS)


def mask(df: DataFrame, text_col: str = "text", window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allow_list: tuple[str, ...] = ALLOWED, by: str = "[SECRET]") -> DataFrame:
    """``find`` and ``redact`` in one pass over the texts, where spans are not wanted themselves."""
    pattern = "|".join(f"(?:{p})" for p in allow_list)

    @F.arrow_udf(T.StringType())
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        allowed = re.compile(pattern, re.DOTALL) if pattern else None
        for texts in batches:
            out = [cut_out(t, [s[:2] for s in scan(t, window, thresholds, allowed)], by) for part in text_slices(texts) for t in part]
            yield pa.array(out, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))
        give_back()

    return df.withColumn(text_col, masked(F.col(text_col)))


def redact(found: DataFrame, text_col: str = "text", out_col: str = "text", by: str = "[SECRET]") -> DataFrame:
    """Replace each stretch that spans cover (overlapping ones as one) by ``by``."""
    return found.withColumn(out_col, F.when(F.size("spans") > 0, replaced(F.col(text_col), F.col("spans"), by)).otherwise(F.col(text_col)))
