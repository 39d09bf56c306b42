"""Shared pieces of the training-data operators.

* lineage is cut by `materialise`, which writes a table into the shared folder that
  the cluster names in ``spark.checkpoint.dir``.
* vectorised text kernels (numpy over UTF-8 bytes): word spans, 64-bit word
  hashes, n-gram hashes and winnowing, all by whole text.
* `connected_components`: large-star / small-star over an edge table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import discard, materialise


#: rows of an Arrow batch; whole texts are large, and a batch is held at once by the JVM and by its Python worker
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds the Arrow batches of a session that has left them at Spark's default."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _th, text): the document key is the id with a hash of the text, so ids may repeat or be null."""
    prepare(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).cast("string").alias("text"))


def same_doc(a: DataFrame, b: DataFrame):
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


# --- UTF-8 kernels -----------------------------------------------------------------------


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value as a view, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else None


def _lower_lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


LOWER = _lower_lut()
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
CHUNK = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << max(n - 1, 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of lower-cased bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = is_word[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def hash_words(raw: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of the whole text, A-Z lower-cased; long texts go in chunks cut between words."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and is_word[LOWER[raw[end]]]:
            end += 1
        part = LOWER[raw[at:end]]
        starts, ends = word_spans(part, is_word)
        if len(starts):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=sums[1:])
            out.append(mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(part))[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 12:
        total = words[:n].copy()
        for j in range(1, k):
            total *= _STEP
            total += words[j : j + n]
        return mix(total)
    return span_hashes(prefix_sums(words), np.arange(n), np.arange(k, n + k))


def prefix_sums(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_STEP, len(words)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word spans [start, end) from `prefix_sums`; equal words at any place give equal hashes."""
    return mix((sums[ends] - sums[starts]) * powers(_STEP_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the minimum of at least one window of w consecutive hashes (all of equal minima)."""
    if len(hashes) < w or w == 1:
        return np.arange(len(hashes)) if w == 1 else np.zeros(0, np.int64)
    least = _sliding(hashes, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, w, np.maximum) == hashes)


# --- components --------------------------------------------------------------------------


#: edges of a task that are reduced to a forest at a time, which bounds its memory
FOREST_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) edges to (a, least node of its component) among FOREST_EDGES edges of one task at a time, by union-find."""
    parent: dict[int, int] = {}
    taken = 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def find_new(x: int) -> int:
        return find(x) if x in parent else parent.setdefault(x, x)

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find_new(a), find_new(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        taken += batch.num_rows
        if taken >= FOREST_EDGES:
            yield stars()
            parent, taken = {}, 0
    if parent:
        yield stars()


def _stars(state: DataFrame) -> bool:
    """Whether distinct (a, b) edges with b < a are stars: every a has one b, and no b is an a."""
    ends = state.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(state.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected_components(edges: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges`` (src, dst longs); root is the least node of its component.

    The edges of each task are first reduced to forests by union-find. Large-star and
    small-star steps then alternate over these until all are stars; every round is a
    written table, so a lost executor costs at most one round; tables of rounds gone by
    are deleted. The least neighbours are written too, so that the joins read plain
    shuffles and the star of one huge component can be split. The driver holds one answer a round. Rounds grow with the logarithm
    of the longest chain; after ``rounds`` of them, far more than any graph needs, an
    error is raised rather than a wrong answer given. Self-loops are ignored; an empty
    edge table gives an empty result.
    """
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    state = materialise(pairs.mapInArrow(_forest, "a bigint, b bigint").distinct(), f"{tag}-cc")
    for _ in range(rounds):
        if _stars(state):
            break
        both = state.union(state.select("b", "a"))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{tag}-least")
        large = materialise(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{tag}-large")
        discard(state, least)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{tag}-least")
        joined = large.join(least, "a").select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        state = materialise(joined.select("e.*").where("a <> b").distinct(), f"{tag}-cc")
        discard(large, least)
    else:
        raise RuntimeError("connected components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
