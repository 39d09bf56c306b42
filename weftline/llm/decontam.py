"""Benchmark decontamination by winnowing.

A benchmark item's windows are its 10-word spans (an item of fewer words is one
window). Of every text the minimum 5-gram hash per sliding window of 6 is kept, so a
span of 10 words always keeps at least one fingerprint, at the same place in the item
and in the document. Fingerprints are joined; each joined pair is extended: the window
hashes that contain the fingerprint are compared at equal alignment. Items of fewer
than 10 words are looked up as whole m-grams (a winnowing window of one).

Before the join, document fingerprints pass a bitmap of the benchmark's fingerprints.
Its size is fixed (8 MB of slots at most, whatever the benchmark), so it is safe to
send to every task; it only removes fingerprints that cannot join.

Nulls: a null or empty text has no words, and no hit. Null item texts have no window. An
item without an id has windows like any other, which are hit; it has no name to list, so
it counts in n_hit and contaminated, not in items and n_items.
Repeated rows are separate documents with equal results; repeated item ids count once.
Empty tables give empty results (documents against an empty benchmark: no hits).
Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts whose A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, gram_hashes, hash_words, keyed, materialise, mix, same_doc, table, texts_of, winnow

WINDOW = 10
GRAM = 5
#: bits of the slot number; a slot is a 64-bit word of the bitmap
SLOT_BITS = 20


def fingerprints(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position) of the winnowed grams, and the window hashes of the text."""
    grams = gram_hashes(words, gram)
    at = winnow(grams, window - gram + 1)
    return grams[at], at, gram_hashes(words, window)


def _windows_around(at: np.ndarray, wins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the hashes of the windows that contain its gram, by offset; second: whether there is such a window."""
    starts = at[:, None] - np.arange(window - gram + 1)[None, :]
    there = (starts >= 0) & (starts < len(wins))
    return wins[np.clip(starts, 0, max(len(wins) - 1, 0))] if len(wins) else np.zeros(starts.shape, np.uint64), there


def _slot(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))


_FP = "array<struct<h:bigint,len:int,pos:int,wins:array<bigint>>>"


def _fp_rows(words: np.ndarray, window: int, gram: int, short: list[int], keep=None) -> list[dict]:
    """The fingerprints of one text that pass ``keep``; wins: hash per offset, null where the text has no such window."""
    rows = []
    if len(words) >= window:
        h, at, wins = fingerprints(words, window, gram)
        if keep is not None and len(h):
            passed = keep(h)
            h, at = h[passed], at[passed]
        if len(h):
            around, there = _windows_around(at, wins, window, gram)
            for x, p, a, t in zip(h.astype(np.int64).tolist(), at.tolist(), around.astype(np.int64).tolist(), there.tolist(), strict=True):
                rows.append({"h": x, "len": window, "pos": p, "wins": [v if ok else None for v, ok in zip(a, t, strict=True)]})
    for m in short:
        h = mix(gram_hashes(words, m) + np.uint64(m))
        at = np.flatnonzero(keep(h)) if keep is not None else np.arange(len(h))
        rows += [{"h": int(x), "len": m, "pos": int(p), "wins": [int(x)]} for x, p in zip(h[at].astype(np.int64), at, strict=True)]
    return rows


def decontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row a document: _id, _th (see `keyed`), n_words, n_hit, items (sorted strings), spans (merged word spans hit)."""
    spark = docs.sparkSession
    fp_type = _FP

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw in texts_of(batch.column("text")):
                words = hash_words(raw, ALNUM) if raw is not None else np.zeros(0, np.uint64)
                n = len(words)
                found.append(_fp_rows(words, window, gram, [n] if 0 < n < window else []))
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, _arrow_fp())], ["item", "fps"])

    items = bench.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.mapInArrow(of_items, f"item string, fps {fp_type}").select("item", F.explode("fps").alias("f")).select("item", "f.h", "f.len", "f.pos", "f.wins")
    items = materialise(items.distinct(), "decontam-items")

    # At most `window` lengths, and at most 2**SLOT_BITS words of bitmap, come to the driver.
    short = sorted(r["len"] for r in items.where(F.col("len") < window).select("len").distinct().collect())
    words_of_map = items.select(F.shiftrightunsigned("h", 64 - SLOT_BITS).alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    set_words = words_of_map.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << SLOT_BITS, np.uint64)
    bitmap[set_words["slot"].to_numpy(np.int64)] = set_words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def keep(h: np.ndarray) -> np.ndarray:
            slot, bit = _slot(h)
            return (bits[slot] & bit) != 0

        for batch in batches:
            counts, found = [], []
            for raw in texts_of(batch.column("text")):
                words = hash_words(raw, ALNUM) if raw is not None else np.zeros(0, np.uint64)
                counts.append(len(words))
                found.append(_fp_rows(words, window, gram, short, keep))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(counts, pa.int64()), pa.array(found, _arrow_fp())], ["_id", "_th", "n_words", "fps"])

    own = keyed(docs)
    id_type = own.schema["_id"].dataType.simpleString()
    scanned = materialise(own.mapInArrow(of_docs, f"_id {id_type}, _th bigint, n_words bigint, fps {fp_type}"), "decontam-docs")

    cand = scanned.where(F.size("fps") > 0).select("_id", "_th", F.explode("fps").alias("f")).select("_id", "_th", "f.h", "f.len", "f.pos", "f.wins").distinct()
    # A benchmark fingerprint stands once per alignment of equal windows; items come in later, by window.
    by_window = items.select("h", "len", F.posexplode("wins").alias("off", "win"), "item").where("win is not null")
    windows = materialise(by_window.select("h", "len", "off", "win").distinct(), "decontam-windows")
    around = cand.select("_id", "_th", "h", "len", "pos", F.posexplode("wins").alias("off", "win")).where("win is not null")
    extended = around.join(windows, ["h", "len", "off", "win"])
    hits = extended.select("_id", "_th", "len", (F.col("pos") - F.col("off")).alias("start"), "win").distinct()
    hits = materialise(hits, "decontam-hits")

    spans = hits.groupBy("_id", "_th").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end")))).alias("s"))
    merged = F.aggregate(
        "s",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    spans = spans.select("_id", "_th", merged.alias("spans"))
    spans = spans.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))
    of_window = by_window.select("len", "win", "item").distinct()
    # The distinct windows of a document, then their items: equal windows of one document join once.
    leaked = hits.select("_id", "_th", "len", "win").distinct().join(of_window, ["len", "win"]).groupBy("_id", "_th").agg(F.array_sort(F.collect_set("item")).alias("items"))

    a, b = scanned.select("_id", "_th", "n_words").alias("a"), spans
    out = a.join(b, same_doc(a, b), "left").select(a["_id"], a["_th"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "spans")
    out = out.join(leaked, same_doc(out, leaked), "left").select(out["_id"], out["_th"], "n_words", "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out


def _arrow_fp() -> pa.DataType:
    return pa.list_(pa.struct([("h", pa.int64()), ("len", pa.int32()), ("pos", pa.int32()), ("wins", pa.list_(pa.int64()))]))


def clean_documents(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of ``docs`` that share no window with the benchmark, all their columns kept."""
    dirty = decontaminated(docs, bench).where("n_hit > 0").select("_id", "_th").distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_th"]), "left_anti")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.to_json("spans").alias("hit_spans"),
    )
