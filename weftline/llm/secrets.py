"""Secret scans: fixed patterns, and a battery of randomness tests.

Base spans, leftmost and non-overlapping per kind: ``assign`` (a keyword, ``:`` or
``=``, and a value of 6 or more), ``access`` (AKIA…, 20 or more), ``hex`` (24 or more).

The battery looks at runs of 20 or more of ``A-Za-z0-9+/_-``, with one or two ``=`` as
padding at their ends (an inner ``=``, as in NAME=value, parts two runs); of a run that
base spans overlap, the parts of 20 or more outside them. Per run an encoding is inferred from its symbols; under uniform symbols of
that alphabet three p-values are computed: chi-squared uniformity over alphabet bins,
the runs test about the middle of the alphabet, and lag-one serial correlation. A run
that any test rejects is not random. The evidence against ordinary text is an e-value,
the likelihood ratio of uniform symbols and a letter-and-case model of text, which
grows with the length; the e-values of a document go through the e-Benjamini-Hochberg
step, so the false-discovery rate within a document is at most ALPHA at every length.
Accepted runs are spans of kind ``random``.

Spans are code points, end exclusive; whole texts are scanned. Nulls: a null text is
empty and has no span. Repeated rows give equal results. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, table

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{18,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
LEAST = 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
ALPHA, REJECT = 0.01, 1e-4

#: Rounded relative letter frequencies of European text, a to z.
LETTERS = (72, 16, 35, 44, 140, 15, 20, 35, 73, 5, 9, 46, 27, 84, 60, 24, 6, 69, 70, 72, 38, 12, 12, 4, 10, 6)
#: Probability of the next class after a class, for lower, upper, digit, other.
NEXT_CLASS = ((0.955, 0.01, 0.015, 0.02), (0.5, 0.42, 0.04, 0.04), (0.05, 0.05, 0.84, 0.06), (0.5, 0.2, 0.2, 0.1))
#: Alphabets from narrow to wide.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    # lower() may only add such keywords (İ and K fold), never hide one
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(4 / (9 * k)))


def battery(symbols: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for symbol numbers of an alphabet."""
    n = len(symbols)
    bins = max(2, min(size, n // 5))
    counts = np.bincount(symbols * bins // size, minlength=bins)
    shares = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    uniform = _chi_tail(float(((counts - n * shares) ** 2 / (n * shares)).sum()), bins - 1)
    high = symbols >= size // 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-12))
        runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    serial = _normal_tail(float((centred[1:] * centred[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    return uniform, runs, serial


def log_evidence(run: str, size: int) -> float:
    """Log likelihood ratio of uniform symbols against the text model."""
    kinds = [0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 for c in run]
    total = sum(LETTERS)
    text = math.log(0.25)
    for before, kind in zip(kinds, kinds[1:], strict=False):
        text += math.log(NEXT_CLASS[before][kind])
    for c, kind in zip(run, kinds, strict=True):
        text += math.log(LETTERS[ord(c.lower()) - 97] / total) if kind < 2 else -math.log(10 if kind == 2 else 5)
    return -len(run) * math.log(size) - text


def _outside(start: int, end: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of [start, end) that no taken span covers."""
    parts = []
    for a, b in sorted((a, b) for a, b, _ in taken if a < end and start < b):
        if start < a:
            parts.append((start, a))
        start = max(start, b)
    return [*parts, (start, end)] if start < end else parts


def _score(run: str) -> float:
    """The log evidence of a run, minus infinity if it is digits only or a test rejects it."""
    core = run.rstrip("=") or run
    name, alphabet = next(((n, x) for n, x in ALPHABETS if set(core) <= set(x)), ("", ""))
    if not alphabet or name == "digits":
        return -math.inf
    where = {c: i for i, c in enumerate(alphabet)}
    ok = min(battery(np.array([where[c] for c in core]), len(alphabet))) >= REJECT
    return log_evidence(core, len(alphabet)) if ok else -math.inf


def random_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs accepted by the battery and the false-discovery step; hypotheses are all runs of the text, less what is taken."""
    tested = []
    for m in RUN.finditer(text):
        for start, end in _outside(*m.span(), taken):
            if end - start >= LEAST:
                tested.append((_score(text[start:end]), start, end))
    tested.sort(reverse=True)
    accepted = max((k for k, x in enumerate(tested, 1) if x[0] >= math.log(len(tested) / (k * ALPHA))), default=0)
    return [(start, end, "random") for _, start, end in tested[:accepted]]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def scanned(docs: DataFrame) -> DataFrame:
    """(_id, _th, n_assign, n_access, n_hex, n_random, base, spans) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                more = random_spans(text, base)
                rows.append((*(sum(s[2] == kind for s in [*base, *more]) for kind in KINDS), _joined(base), _joined([*base, *more])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), *arrays], ["_id", "_th", "n_assign", "n_access", "n_hex", "n_random", "base", "spans"])

    own = keyed(docs)
    return own.mapInArrow(run, f"_id {own.schema['_id'].dataType.simpleString()}, _th bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base string, spans string")


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_random")
