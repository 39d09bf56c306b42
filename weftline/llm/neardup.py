"""Near-duplicates by exact Jaccard similarity of 5-word shingle sets.

Two texts are linked if the Jaccard similarity of their sets of 5-word shingles (words
as in `simhash`, A-Z lower-cased; a shorter text is one shingle) is at least 0.8;
near-dedup groups are the connected components. No such pair is missed: of n shingles in
any fixed order, the first n - ceil(0.8 n) + 1 are the prefix, and two sets that similar
share a shingle of their prefixes. The order is by frequency in a sample of texts, then
by hash, so common shingles seldom stand in a prefix; the sample bears on speed alone.

Texts of one set are one class (a 64-bit hash of the set), so exact copies are one row.
First SimHash fingerprints of the classes (5-word shingles) link by anchor-point covering
(`simhash.linked`); each class is compared on whole sets with the least one of its
fingerprint, each fingerprint with its least neighbour. Most similar texts differ in more
bits than a covering reaches, so the exact join goes on from these groups.
Classes meet on prefix shingles. In some TURNS, each class is compared with a few
others of other groups: of the hubs of its shingles (some classes of each, by hash,
others in each turn) those it can be most similar to. That joins the members of large
groups without forming their pairs. Then all pairs of classes that meet and are
still in different groups are looked at that share a shingle early enough in both
prefixes: a pair goes on if the shingles it shares up to the end of the lesser prefix
leave room for the similarity, and is settled on the whole sets. Shingles are 64-bit
hashes.

Nulls and texts without words have the empty set and are one group. Null and repeated
ids are fine: groups have roots of their own. Empty tables give empty results.

Spark sizes a written table by its files, and near copies, hubs and shingles compress many
times over; such tables are joined by sort and merge (a hint), never sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, connected_components, discard, gram_hashes, hash_words, keyed, materialise, texts_of
from . import simhash
from .simhash import least_of_each

SHINGLE = 5
#: similarity as a fraction of whole numbers, so that it is compared exactly
OVER, UNDER = 4, 5
#: texts looked at for common shingles, and how many of these are kept
SAMPLE, COMMON = 20_000, 200_000
#: (hubs of a shingle, comparisons of a class) in each turn before pairs are formed; what the turns miss is found by the pairs
TURNS = ((8, 4), (48, 48))


def shingles(raw: np.ndarray | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = hash_words(raw, NOT_SPACE) if raw is not None and len(raw) else np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def set_hash(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), len(grams))).view(np.int64))


def _class_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(raw) for raw in texts_of(batch.column("text"))]
        out = [batch.column("_id"), batch.column("_th"), pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["_id", "_th", "cls", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in texts_of(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(raw).view(np.int64))], ["gram"])


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their counts) of those met most in a sample of about SAMPLE texts."""
    rate = max(1, -(-total // SAMPLE))
    part = docs.where(F.pmod(F.xxhash64("_th"), F.lit(rate)) == 0).dropDuplicates(["_th"]).select("text")
    counts = part.mapInArrow(_sampled, "gram bigint").groupBy("gram").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "gram").limit(COMMON).toArrow()
    grams, seen = top.column("gram").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(grams)
    return grams[order], seen[order]


def prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, their sample counts) of the prefix, in order."""
    known, seen = common
    counts = np.zeros(len(grams), np.int64)
    if len(known) and len(grams):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        counts = np.where(known[at] == grams, seen[at], 0)
    n = len(grams)
    first = np.lexsort((grams, counts))[: n - (OVER * n + UNDER - 1) // UNDER + 1] if n else np.zeros(0, np.int64)
    return grams[first], counts[first]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sorted sets have a Jaccard similarity of OVER / UNDER or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * UNDER >= OVER * (len(a) + len(b) - both)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = pa.array([simhash.fingerprint(raw, SHINGLE) for raw in texts_of(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("cls"), fps], ["cls", "fp"])


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """(src, dst) pairs of similar classes that their SimHash fingerprints bring together, at most two a class; from (cls, text)."""
    own = materialise(classes.select("cls", "text").mapInArrow(_fingerprinted, "cls bigint, fp bigint"), "neardup-fps")
    firsts = materialise(own.groupBy("fp").agg(F.min("cls").alias("first")), "neardup-firsts")
    nearest = simhash.linked(firsts).groupBy("dst").agg(F.min("src").alias("src"))
    a, b = firsts.select(F.col("fp").alias("src"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("dst"), F.col("first").alias("y"))
    near = nearest.join(a, "src").join(b, "dst").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    same = own.join(firsts, "fp").where("cls <> first").select(F.col("first").alias("src"), F.col("cls").alias("dst"))
    pairs = materialise(near.unionByName(same).distinct(), "neardup-near")
    found = _settled(pairs, classes)
    discard(own, firsts, pairs)
    return found


def linked(classes: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(src, dst) pairs of similar classes whose components are those of all such pairs; from (cls, n, text), one row a class."""
    spark = classes.sparkSession
    given = spark.sparkContext.broadcast(common)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, raw in zip(batch.column("cls").to_pylist(), texts_of(batch.column("text")), strict=True):
                grams, counts = prefix(shingles(raw), given.value)
                if len(grams):
                    last = [pa.array(np.full(len(grams), x, np.int64)) for x in (cls, len(grams), counts[-1], grams[-1:].view(np.int64)[0])]
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.arange(len(grams))), *last], ["gram", "i", "cls", "p", "c", "g"])

    every = materialise(classes.select("cls", "text").mapInArrow(posted, "gram bigint, i bigint, cls bigint, p bigint, c bigint, g bigint"), "neardup-posts")
    # Most prefix shingles stand in one class: a partial aggregate finds the others.
    shared = every.groupBy("gram").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x <> y").select("gram")
    held = materialise(every.join(shared, "gram").join(classes.select("cls", "n"), "cls"), "neardup-shared")
    discard(every)
    # Large groups first, without their pairs: in each turn every shingle that stands in several groups has other hubs.
    links, looked = by_fingerprint(classes), None
    roots = connected_components(links, "neardup-turn")
    posts = held.join(roots, held["cls"] == roots["node"], "left").select(*[held[c] for c in held.columns], F.coalesce(roots["root"], held["cls"]).alias("root"))
    posts = materialise(posts, "neardup-grouped")
    discard(held)
    held = posts
    for turn, (slots, best) in enumerate(TURNS):
        order = F.xxhash64("cls", F.lit(turn))
        hubs = posts.groupBy("gram", F.pmod(order, F.lit(slots)).alias("slot")).agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct(order.alias("order"), "cls", "root", "n")).alias("hub"))
        hubs = hubs.groupBy("gram").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.collect_list("hub").alias("hubs")).where("x <> y")
        hubs = materialise(hubs.select("gram", "hubs"), "neardup-hubs")
        posts = posts.join(hubs.hint("merge"), "gram")
        asked = posts.select("cls", F.explode(F.expr(f"filter(hubs, h -> root <> h.root and n * {UNDER} >= h.n * {OVER} and h.n * {UNDER} >= n * {OVER})")).alias("b"))
        asked = asked.select(F.col("cls").alias("src"), F.col("b.cls").alias("dst")).distinct()
        if looked is not None:
            asked = asked.join(looked.hint("merge"), ["src", "dst"], "left_anti")
        asked, sets = materialise(asked, "neardup-asked"), _sets(posts)
        judged = _judged(asked, sets)
        rank = F.row_number().over(Window.partitionBy("fits", "src").orderBy(F.desc("bound"), "dst"))
        judged = materialise(judged.withColumn("k", rank).where(f"not fits or k <= {best}").select("fits", "src", "dst"), "neardup-judged")
        discard(asked, sets)
        tried = judged.where("fits").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        found = _settled(tried, classes)
        done = judged.select("src", "dst").unionByName(judged.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        looked = done if looked is None else looked.unionByName(done)
        links = links.unionByName(found)
        roots = connected_components(links, "neardup-turn")
        posts = posts.join(roots, posts["cls"] == roots["node"], "left").select("gram", "i", "cls", "p", "c", "g", "n", F.coalesce(roots["root"], "cls").alias("root"))
        posts = materialise(posts, "neardup-grouped")
        discard(held, hubs)
        held = posts
    # What is left are shingles that stand in several groups: only pairs of different groups are formed, and all of these that can be similar but those looked at.
    mixed = posts.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("gram")
    mixed = materialise(mixed, "neardup-mixed")
    posts = materialise(posts.join(mixed, "gram"), "neardup-left")
    discard(held, mixed)
    a, b = posts.alias("a"), posts.alias("b").hint("merge")
    # The first shingle that a pair shares leaves no more common ones than the shorter rest: sets that similar share one this early.
    room = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) * (OVER + UNDER) >= (F.col("a.n") + F.col("b.n")) * OVER
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.cls") < F.col("b.cls")) & (F.col("a.root") != F.col("b.root")) & room)
    asked = met.select(F.col("a.cls").alias("src"), F.col("b.cls").alias("dst")).distinct().join(looked.hint("merge"), ["src", "dst"], "left_anti")
    asked, sets = materialise(asked, "neardup-asked"), _sets(posts)
    met = materialise(_judged(asked, sets).where("fits").select("src", "dst"), "neardup-met")
    discard(asked, sets, posts)
    return links.unionByName(_settled(met, classes))


def _sets(posts: DataFrame) -> DataFrame:
    """One written row a class of ``posts``: cls, what is known of its prefix and the prefix shingles in ``posts``."""
    sets = posts.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("p", "c", "g", "n")], F.collect_list("gram").alias("grams"))
    return materialise(sets, "neardup-sets")


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst, bound, fits) of pairs of different groups: whether the shingles shared up to the end of the lesser prefix leave room for the similarity.

    Such a pair shares no shingle that was left out of ``sets``: those stand in one group only.
    """
    a, b = sets.alias("a").hint("merge"), sets.alias("b").hint("merge")
    # Hashes are ordered as unsigned numbers: flipping the top bit makes signed order agree.
    end = lambda s: F.struct(F.col(f"{s}.c").alias("c"), F.col(f"{s}.g").bitwiseXOR(F.lit(-(1 << 63))).alias("g"))
    rest = F.when(end("a") <= end("b"), F.col("a.n") - F.col("a.p")).otherwise(F.col("b.n") - F.col("b.p"))
    most = F.size(F.array_intersect("a.grams", "b.grams")) + rest
    both = F.col("a.n") + F.col("b.n")
    met = pairs.join(a, F.col("src") == F.col("a.cls")).join(b, F.col("dst") == F.col("b.cls"))
    return met.select("src", "dst", (most / both).alias("bound"), (most * (OVER + UNDER) >= both * OVER).alias("fits"))


def _settled(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (src, dst) of ``pairs`` whose whole sets are similar, written."""
    texts = classes.join(pairs.select(F.explode(F.array("src", "dst")).alias("cls")).distinct(), "cls", "left_semi").select("cls", "text")
    texts = materialise(texts, "neardup-texts")
    of = lambda key, name: texts.select(F.col("cls").alias(key), F.col("text").alias(name)).hint("merge")
    sides = pairs.join(of("src", "a"), "src").join(of("dst", "b"), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(shingles(a), shingles(b)) for a, b in zip(texts_of(batch.column("a")), texts_of(batch.column("b")), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    found = materialise(sides.select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint"), "neardup-found")
    discard(texts)
    return found


def components(docs: DataFrame) -> DataFrame:
    """One row a document: _id, _th, root (the least class of its near-duplicate group)."""
    texts = keyed(docs)
    own = texts.mapInArrow(_class_of, f"_id {texts.schema['_id'].dataType.simpleString()}, _th bigint, cls bigint, n bigint")
    own = materialise(own, "neardup-docs")
    # Equal sets have equal members for every text: one text stands for its class.
    chosen = own.groupBy("cls").agg(F.min("n").alias("n"), F.min("_th").alias("_th"))
    one = texts.select("_th", "text").join(chosen, "_th").dropDuplicates(["cls"]).select("cls", "n", "text")
    classes = materialise(one, "neardup-classes")
    links = linked(classes, common_shingles(texts, own.count()))
    discard(classes)
    roots = connected_components(links, "neardup")
    return own.join(roots, own["cls"] == roots["node"], "left").select("_id", "_th", F.coalesce("root", "cls").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, by `simhash.least_of_each`."""
    return least_of_each(docs, components(docs))
