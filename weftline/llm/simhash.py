"""SimHash near-dedup with anchor-point covering.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of the
text's 3-word shingles, repeats included.

Linking within 2 bits: the anchors are the product of two perfect binary Golay codes
over bits 0-22 and 23-45, covering radius 3 a block. A fingerprint's home is the one
anchor within the radius in both blocks; it is also replicated to every anchor that a
fingerprint within 2 bits of it may have as home: in the blocks, distances of radius
plus t1 and radius plus t2 with t1 + t2 <= 2 (61 anchors on average). Two linked
fingerprints so meet at the home of the smaller one, and are compared there on all 64
bits. Distinct fingerprints only are replicated, so a group of exact copies, however
large, is one row; a fingerprint has at most 2080 others within 2 bits.

Components are found on distinct fingerprints (`connected_components`); documents get
their class by a join on the fingerprint. Joins of tables that Spark sizes too low (rows
that become many in Python, files that compress well) are sort-merge joins by a hint.

Nulls and texts without words have fingerprint zero and link like any other. A null
doc_id is a document; a component whose ids are all null has a null component_id, so
what is kept goes by the component's root, never by component_id.
Repeated rows are separate documents. Empty tables give empty results. Other columns
do not matter to `components`, and are kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, connected_components, keyed, materialise, table, texts_of, word_spans

SHINGLE = 3
THRESHOLD = 2
SEED = 42
GOLAY_BITS, GOLAY_RADIUS = 23, 3
#: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GOLAY_POLYNOMIAL = 0b101011100011
PART = 1 << 16


def fingerprint(raw: np.ndarray | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of whole UTF-8 bytes, as a signed number; shingles are counted in parts of bounded size."""
    if raw is None or not len(raw):
        return 0
    low = LOWER[raw]
    starts, ends = word_spans(low, NOT_SPACE)
    if not len(starts):
        return 0
    lengths = ends - starts
    data = low.tobytes()
    if len(starts) > 1 and ((starts[1:] - ends[:-1] != 1).any() or (low[ends[:-1]] != 0x20).any()):
        data = b" ".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
    k = min(shingle, len(starts))
    firsts, lasts = starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(firsts), PART):
        hashes = np.array([digest(data[s:e], SEED) for s, e in zip(firsts[at : at + PART], lasts[at : at + PART], strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(firsts), bitorder="little").view(np.int64)[0])


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """syndromes of all 23-bit values by halves; per syndrome the coset leader; per syndrome a padded list of nearby codeword offsets and how far each lies beyond the radius (9: padding)."""
    code = np.zeros(1, np.int64)
    for i in range(12):
        code = np.concatenate([code, code ^ (GOLAY_POLYNOMIAL << i)])

    def syndrome(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
        return x

    low, high = syndrome(np.arange(1 << 12)), syndrome(np.arange(1 << 11) << 12)
    bits = 1 << np.arange(GOLAY_BITS)
    pairs = (bits[:, None] | bits[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], pairs, (pairs[:, None] | bits[None, :]).ravel()]))
    leader = np.zeros(1 << 11, np.int64)
    leader[syndrome(errors)] = errors
    far = np.bitwise_count(leader[:, None] ^ code[None, :]).astype(np.int64) - GOLAY_RADIUS
    near = np.maximum(far, 0)
    order = np.argsort(near, axis=1, kind="stable")[:, :40]
    need = np.take_along_axis(near, order, 1)
    need[need > THRESHOLD] = 9
    return np.stack([np.resize(low, 1 << 12), np.resize(high, 1 << 12)]), leader, code[order], need


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home of each, index of the replicated fingerprint, anchor of the replica) for int64 fingerprints."""
    tables, leader, offsets, need = _golay()
    x = fps.view(np.uint64)
    centres, lists, needs = [], [], []
    for shift in (0, GOLAY_BITS):
        block = ((x >> np.uint64(shift)) & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64)
        s = tables[0][block & 0xFFF] ^ tables[1][block >> 12]
        centre = block ^ leader[s]
        centres.append(centre)
        lists.append(centre[:, None] ^ offsets[s])
        needs.append(need[s])
    home = centres[0] | (centres[1] << GOLAY_BITS)
    i, a, b = np.nonzero(needs[0][:, :, None] + needs[1][:, None, :] <= THRESHOLD)
    return home, i, lists[0][i, a] | (lists[1][i, b] << GOLAY_BITS)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 2048):
            fps = every[at : at + 2048]
            home, i, anchor = anchors(fps)
            out = [np.concatenate([home, anchor]), np.concatenate([fps, fps[i]]), np.repeat([True, False], [len(fps), len(i)])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["anchor", "fp", "is_home"])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(_id, _th, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(raw) for raw in texts_of(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), fps], ["_id", "_th", "fp"])

    own = keyed(docs)
    return own.mapInArrow(run, f"_id {own.schema['_id'].dataType.simpleString()}, _th bigint, fp bigint")


def linked(fps: DataFrame) -> DataFrame:
    """(src, dst) pairs of distinct fingerprints, src < dst, at 1 or 2 differing bits; from distinct (fp)."""
    # dealt out by number, as a fingerprint becomes some 61 rows: what adaptive execution sees before that is small
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = fps.select("fp").repartition(parts, "fp").mapInArrow(_meetings, "anchor bigint, fp bigint, is_home boolean")
    # Spark sizes replicas as if a fingerprint were one row, and would send all of them to the driver as a small table
    homes = met.where("is_home").select("anchor", F.col("fp").alias("src")).hint("merge")
    guests = met.where("not is_home").select("anchor", F.col("fp").alias("dst")).hint("merge")
    close = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= THRESHOLD)
    return homes.join(guests, (homes["anchor"] == guests["anchor"]) & close).select("src", "dst")


def components(docs: DataFrame) -> DataFrame:
    """One row a document: _id, _th, fp, root (the component's least fingerprint), component_id (the least id reachable by links)."""
    own = materialise(fingerprinted(docs), "simhash-docs")
    classes = own.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = connected_components(linked(classes), "simhash")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "root", "component_id")
    return own.join(labels.hint("merge"), "fp").select("_id", "_th", "fp", "root", "component_id")  # copies make the file of ``own`` small, not its rows


def least_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One document of each component in ``rooted`` (_id, _th, root): the one of least id (null ids last; of equal ids the least text hash, of rows equal in both the least hash of all columns), with all columns of ``docs``."""
    group = rooted.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("_id"), F.col("_th").alias("_th"))).alias("k")).select(F.col("k._id").alias("_wl_id"), F.col("k._th").alias("_wl_th"))
    kept = docs.join(group, docs["doc_id"].eqNullSafe(group["_wl_id"]) & (F.xxhash64(docs["text"]) == group["_wl_th"]))
    hashed = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    first = F.row_number().over(Window.partitionBy("_wl_id", "_wl_th").orderBy(F.xxhash64(*hashed)))
    return kept.withColumn("_wl_first", first).where("_wl_first = 1").select(*[docs[c] for c in docs.columns])


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, by `least_of_each`."""
    return least_of_each(docs, components(docs))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
