"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Within a source every document expects ``target / source_size`` copies. The documents
of a source stand in one fixed order; their expected copies are prefix-summed, one
random offset (drawn from the seed and the source) is added, and a document is emitted
once per integer boundary that its interval crosses. As the order follows the document
size, the words taken from a source come within about one document of its target.

The prefix sum is two-level: (source, size class, slice) groups of bounded length are
ranked inside, and the group totals are summed per source. No task sorts a whole source.

Weights: sources by code point, null last, take ``weights`` in turn. Targets share
``share`` times all words by weight and stop at ``cap`` times the source's words; the
excess goes to the others by weight until none is above. As the targets are
``min(cap * size, level * weight)`` for one level, the sources are ordered by
``cap * size / weight`` and the level is read off running sums.

Nulls: a null text has size 0, a null source is a source. Repeated rows and ids are
separate documents. A source without words has target 0 and emits no copy; empty
tables give empty results. Other columns are carried by `mix_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

SPACED_WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SLICE_ROWS = 20_000


def spaced_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def tie_of(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def hex_number(digest: Column) -> Column:
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _in_order(rows: DataFrame, tag: str, *keys: Column) -> DataFrame:
    """``rows`` dealt into ranges of ``keys``, with the range's number as ``_part``; written, so that the ranges stay."""
    return materialise(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), tag)


def _ahead(ordered: DataFrame, value: Column) -> DataFrame:
    """(_part, _ahead): the sum of ``value`` over the ranges before; one row a range."""
    totals = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))
    return totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size) rows; one row a source, hot sources pre-aggregated.

    Sources may be many (hosts): both global orders, by name and by cap * size / weight,
    are ranges with running sums inside and over the ranges' totals.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    named = _in_order(own, "mix-names", name)
    turn = (F.row_number().over(Window.partitionBy("_part").orderBy(name)) + F.col("_ahead") - 1) % len(weights)
    weighed = named.join(_ahead(named, F.lit(1)), "_part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).drop("_part", "_ahead")
    limit, ratio = F.col("source_size") * F.lit(float(cap)), F.col("limit") / F.col("weight")
    limited = _in_order(weighed.withColumn("limit", limit), "mix-limits", ratio, name)
    whole = limited.agg((F.sum("source_size") * F.lit(float(share))).alias("total"), F.sum("weight").alias("all"))
    inside = Window.partitionBy("_part").orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, tag: F.coalesce(F.sum(c).over(inside), F.lit(0.0)) + F.col(tag)
    ranked = limited.join(_ahead(limited, F.col("limit")).withColumnRenamed("_ahead", "_limits"), "_part").join(_ahead(limited, F.col("weight")).withColumnRenamed("_ahead", "_weights"), "_part")
    ranked = ranked.withColumn("stopped", before("limit", "_limits")).withColumn("passed", before("weight", "_weights")).join(F.broadcast(whole))  # one row
    # with the sources before this one stopped, the level at which the rest would share what is left
    ranked = ranked.withColumn("level_here", (F.col("total") - F.col("stopped")) / (F.col("all") - F.col("passed")))
    level = ranked.where(F.col("level_here") * F.col("weight") <= F.col("limit")).agg(F.min(F.struct(F.col("stopped").alias("s"), F.col("level_here").alias("l")))["l"].alias("level"))
    return limited.join(F.broadcast(level)).select("source", "n_docs", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), "limit").alias("target"))


def copies_of(sizes: DataFrame, targets: DataFrame, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``sizes`` (source, size, doc_id, tie, …) with source_size, target and copies.

    ``tie`` orders documents of equal id; rows equal in all of these are interchangeable.
    """
    classed = sizes.withColumn("class", F.floor(F.sqrt(F.col("size").cast("double")) * 2).cast("int"))
    counts = classed.groupBy("source", "class").count()
    slices = counts.select("source", "class", F.ceil(F.col("count") / F.lit(slice_rows)).cast("int").alias("slices"))
    same = lambda a, b, *more: [a["source"].eqNullSafe(b["source"]), *(a[c] == b[c] for c in more)]
    sliced = classed.join(slices, same(classed, slices, "class"), "left").drop(slices["source"]).drop(slices["class"])
    sliced = sliced.withColumn("slice", F.pmod(hex_number(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "tie"))), F.col("slices")).cast("int"))
    groups = sliced.groupBy("source", "class", "slice").count()
    before = Window.partitionBy("source").orderBy(F.col("class").desc(), "slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "class", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "class", "slice").orderBy(F.col("size").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    placed = sliced.withColumn("rank", F.row_number().over(inside))
    placed = placed.join(groups, same(placed, groups, "class", "slice"), "left").drop(groups["source"]).drop(groups["class"]).drop(groups["slice"])
    rated = targets.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    rated = rated.withColumn("offset", hex_number(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source")))) / F.lit(float(1 << 32)))
    placed = placed.join(rated, same(placed, rated), "left").drop(rated["source"])
    upto = lambda n: F.floor(F.col("rate") * n + F.col("offset"))
    placed = placed.withColumn("copies", upto(F.col("before") + F.col("rank")) - upto(F.col("before") + F.col("rank") - 1))
    return placed.drop("class", "slices", "slice", "rank", "before", "rate", "offset")


def mixed(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken. Reruns agree."""
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), spaced_words(F.col("text")).alias("size"), tie_of(F.col("text")).alias("tie"))
    slim = materialise(slim, "mix-sizes")
    targets = materialise(source_targets(slim, weights, share, cap), "mix-targets")
    out = copies_of(slim, targets, seed)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def mix_documents(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mixed corpus: every column of ``docs`` plus ``mix_copy`` (1, 2, …), one row per emitted copy."""
    key = [F.col("doc_id").alias("_wl_id"), F.col("source").alias("_wl_source"), F.col("tie").alias("_wl_tie")]
    counted = mixed(docs, seed, weights, share, cap).groupBy(*key).agg(F.sum("copies").alias("_wl_n"), F.count("*").alias("_wl_rows")).where("_wl_n > 0")
    # rows equal in id, source and text share their copies evenly, in the order of a hash of all columns
    joined = docs.join(counted, docs["doc_id"].eqNullSafe(counted["_wl_id"]) & docs["source"].cast("string").eqNullSafe(counted["_wl_source"]) & (tie_of(docs["text"]) == counted["_wl_tie"]))
    hashed = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    turn = F.row_number().over(Window.partitionBy("_wl_id", "_wl_source", "_wl_tie").orderBy(F.xxhash64(*hashed)))
    joined = joined.withColumn("_wl_turn", turn)
    here = F.floor(F.col("_wl_n") * F.col("_wl_turn") / F.col("_wl_rows")) - F.floor(F.col("_wl_n") * (F.col("_wl_turn") - 1) / F.col("_wl_rows"))
    joined = joined.withColumn("_wl_copies", here.cast("int")).where("_wl_copies > 0")
    return joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_wl_copies"))).alias("mix_copy"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
