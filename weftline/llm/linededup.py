"""Line dedup by distinct-site spread.

A line (trimmed of white space at its ends, not empty) is boilerplate if it stands on at
least ``min_sites`` distinct sites, counted over distinct texts: a text counts at one
site, the least of its copies. So a document that was copied to many sites keeps its
text, and near-dedup decides about it, while a block of any length that stands in
different texts on many sites goes whole. Copies that were edited are different texts:
what they share on ``min_sites`` sites goes like any other line of such spread.

1. Every distinct text counts at the least site of its copies. Lines of one site are put
   aside by a partial aggregate; the others get a HyperLogLog sketch of their sites per
   line hash, built in the map-side aggregate and merged (a line of a third of all rows
   is one sketch per map task).
2. A line whose estimate lies within ``margin`` of the threshold gets the exact distinct
   count, taken for such lines alone; beyond that the estimate decides. ``margin`` is
   over six standard errors of the sketch.

The least site is that of the least number (60 bits of the md5 of the source).

Nulls: a null text keeps null; a null source is a site of its own; null ids are fine.
Repeated rows are one text. Empty and blank lines are never removed. Texts of any length
are read whole, line by line. Empty tables give empty results. All columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, table, texts_of

MIN_SITES = 5
MARGIN = 0.15
LOG_K = 12
_BLANKS = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")


def site_of(source: Column) -> Column:
    """The number of a site; null is a site of its own."""
    return F.coalesce(F.conv(F.substring(F.md5(source.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def line_hash(line: bytes) -> int | None:
    """A signed 64-bit hash of a trimmed line, None if it is blank."""
    line = line.translate(_BLANKS).strip(b" ")
    return xxhash.xxh64_intdigest(line) - (1 << 63) if line else None


def _bytes_of(column: pa.Array) -> Iterator[bytes | None]:
    for raw in texts_of(column):
        yield None if raw is None else raw.tobytes()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({h for x in (text or b"").split(b"\n") if (h := line_hash(x)) is not None}) for text in _bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_th", "site")), pa.array(found, pa.list_(pa.int64()))], ["_id", "_th", "site", "lines"])


def scanned(docs: DataFrame) -> DataFrame:
    """(_id, _th, site, lines) of every row: the distinct hashes of its lines that are not blank. Written."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), site_of(F.col("source")).alias("site"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_scan, f"_id {rows.schema['_id'].dataType.simpleString()}, _th bigint, site bigint, lines array<bigint>"), "lines-docs")


def spread(rows: DataFrame, min_sites: int, margin: float) -> DataFrame:
    """(line, n_sites) of the lines on at least ``min_sites`` distinct sites, from (line, site); n_sites is an estimate beyond the margin."""
    ends = rows.groupBy("line").agg(F.min("site").alias("s0"), F.max("site").alias("s1"))
    several = materialise(ends.where((F.col("s0") != F.col("s1")) | F.lit(min_sites < 2)).select("line"), "lines-several")
    wide = rows.join(several, "line")
    estimated = wide.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("n_sites"))
    estimated = materialise(estimated.where(F.col("n_sites") >= min_sites * (1 - margin)), "lines-estimated")
    near = F.col("n_sites") <= min_sites * (1 + margin)
    exact = rows.join(estimated.where(near).select("line"), "line").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n_sites"))
    return estimated.where(~near).select("line", F.col("n_sites").cast("long").alias("n_sites")).unionByName(exact.where(F.col("n_sites") >= min_sites))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line, n_sites) of the lines to remove, from `scanned` documents."""
    # equal texts have equal lines: one row stands for all copies
    texts = lines.where(F.size("lines") > 0).groupBy("_th").agg(F.min(F.struct("site", "lines")).alias("m")).select("m.site", "m.lines")
    rows = materialise(texts, "lines-texts").select("site", F.explode("lines").alias("line"))
    return materialise(spread(rows, min_sites, margin), "lines-out")


def stripped(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without boilerplate lines in ``text`` and with ``n_chars`` (if there) set anew; two more columns: _wl_lines, _wl_removed. No row is dropped."""
    lines = scanned(docs)
    gone = boilerplate(lines, **how).select("line")
    hit = lines.select("_id", "_th", F.explode("lines").alias("line")).join(gone, "line").groupBy("_id", "_th").agg(F.collect_set("line").alias("_wl_gone"))
    own = docs.withColumns({"_wl_id": F.col("doc_id"), "_wl_th": F.xxhash64("text")})
    joined = own.join(hit, own["_wl_id"].eqNullSafe(hit["_id"]) & (own["_wl_th"] == hit["_th"]), "left").select(*[own[c] for c in docs.columns], "_wl_gone")
    names = docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            at = names.index("text")
            texts, removed, totals, lengths = [], [], [], []
            for text, out in zip(_bytes_of(columns[at]), batch.column("_wl_gone").to_pylist(), strict=True):
                parts = text.split(b"\n") if text is not None else []
                kept = parts
                if out:
                    out = set(out)
                    kept = [x for x in parts if line_hash(x) not in out]
                    text = b"\n".join(kept)
                texts.append(text)
                totals.append(len(parts))
                removed.append(len(parts) - len(kept))
                lengths.append(int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)) if out else None)
            columns[at] = pa.array(texts, pa.binary()).view(pa.string())
            if chars is not None:
                fresh = pa.array(lengths, pa.int64()).cast(columns[chars].type)
                columns[chars] = pc.if_else(fresh.is_valid(), fresh, columns[chars])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*names, "_wl_lines", "_wl_removed"])

    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names]).withColumns({"_wl_lines": F.lit(0).cast("long"), "_wl_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(strip, schema)


def without_boilerplate(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text`` and ``n_chars`` (if there) set anew; no row is dropped."""
    return stripped(docs, **how).drop("_wl_lines", "_wl_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stripped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_wl_lines").cast("int").alias("n_lines"), F.col("_wl_removed").cast("int").alias("n_removed"), "text")
