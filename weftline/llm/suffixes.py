"""Suffix-array dedup with sparse suffixes: passages of 50 words or more that repeat.

Suffixes start at minimiser positions only: positions whose 10-word hash is the least
of some 41 consecutive ones, so every span of 50 words holds one, chosen by its words
alone. A suffix owns the 50-word windows whose first least hash it holds; its reach is
the words of these windows (up to 40 before it, which it is extended to the left by,
and 50 after).

1. Suffixes of equal first words and equal reach are one content, aggregated before the
   shuffle: a passage that a third of all rows share is one row per task. All windows of
   a content that several documents have repeat.
2. The other contents whose first words stand in several documents are sorted by first
   words, then by what follows (the suffix order), and once more by what precedes (the
   prefix order). Neighbours of different documents are compared and extended both ways:
   words common to the left and to the right give the windows that they share. As
   neighbours of a sorted order are those with most words in common, they also bound
   what any other suffix can share to that side.
3. A window that neither neighbours mark nor both bounds rule out (it shares its left
   words with one suffix, its right words with another) is settled by its hash against
   the marked and open windows of equal first words at equal alignment.

This finds exactly the words that lie in some 50-word window that two documents share
(words are compared by 32 bits when extended, by 64 elsewhere). Sorted partitions are
ranges of (first words, following words, preceding words), so a common phrase with many
continuations is dealt to many tasks; what a task cannot see beyond its range counts as
open. No pairs are made.

Words are split at white space, A-Z lower-cased. Nulls: null and empty texts, and those
of fewer than 50 words, have no span. Rows equal in id and text are one document; a
repeat inside one document alone is no span. Empty tables give empty results. Other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, _sliding, gram_hashes, hash_words, keyed, materialise, mix, prefix_sums, same_doc, span_hashes, table, texts_of, winnow

SPAN = 50
GRAM = 10
#: bytes of a word in a context
WORD = 4
_RUNS = "array<struct<first:int,last:int>>"


def owners(grams: np.ndarray, w: int) -> np.ndarray:
    """For every window of w consecutive hashes the position of its first minimum."""
    least = _sliding(grams, w, np.minimum)
    at = winnow(grams, w)
    which = np.searchsorted(at, np.arange(len(least)))
    late = np.flatnonzero(grams[at[which]] != least)
    while len(late):
        which[late] += 1
        late = late[grams[at[which[late]]] != least[late]]
    return at[which]


def suffix_rows(words: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash of the first words, content hash, position, words before it in reach, number of windows) of a text's sparse suffixes.

    A suffix owns the windows whose first least hash it holds: consecutive ones, and
    every window has one owner. Equal windows give it at the same offset.
    """
    if len(words) < span:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    grams = gram_hashes(words, gram)
    owner = owners(grams, span - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    last = np.concatenate([first[1:], [len(owner)]])
    at = owner[first]
    reach = span_hashes(prefix_sums(words), first, last - 1 + span)
    content = mix(reach ^ mix(((at - first) * span + last - first).astype(np.uint64)))
    return grams[at], content, at, at - first, last - first


def common_words(a: bytes, b: bytes) -> int:
    """Number of words that two contexts have in common from their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (8 * n - differ.bit_length()) // (8 * WORD)


class Suffix:
    """A content with its contexts; ``owner`` is its document, None if it has several."""

    __slots__ = ("content", "h", "lead", "left", "owner", "right", "wins")

    def __init__(self, h, content, lo, many, lead, wins, left, right):
        self.h, self.content, self.owner, self.lead, self.wins, self.left, self.right = h, content, None if many else lo, lead, wins, left, right

    def differs(self, other: Suffix) -> bool:
        return self.owner is None or self.owner != other.owner


def _compared(span: int, forward: bool):
    """Compares each suffix of a sorted partition with its nearest neighbours of other documents."""

    def judge(x: Suffix, near: list[Suffix], open_end: bool) -> dict:
        runs, bound = [], 0
        for y in near:
            left, right = common_words(x.left, y.left), common_words(x.right, y.right)
            bound = max(bound, right if forward else left)
            first, last = max(span - right, x.lead - x.wins + 1), min(left, x.lead)
            if first <= last:
                runs.append({"first": first, "last": last})
        return {"h": x.h, "content": x.content, "lead": x.lead, "wins": x.wins, "forward": forward, "bound": span if open_end else bound, "runs": runs}

    schema = pa.schema([("h", pa.int64()), ("content", pa.int64()), ("lead", pa.int32()), ("wins", pa.int32()), ("forward", pa.bool_()), ("bound", pa.int32()), ("runs", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_h, last, before, waiting, out = None, None, None, [], []  # before: the nearest suffix ahead of `last` of another document

        def settle(after: Suffix | None, open_end: bool) -> None:
            for x, ahead in waiting:
                if x.owner is not None:
                    near = [y for y in (ahead, after) if y is not None]
                    out.append(judge(x, near, open_end or (ahead is None and x.h == first_h)))
            waiting.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "content", "lo", "many", "lead", "wins", "left", "right")), strict=True):
                x = Suffix(*row)
                first_h = x.h if first_h is None else first_h
                if last is None or last.h != x.h:
                    settle(None, False)
                    before = None
                elif x.differs(last):
                    settle(x, False)
                    before = last
                waiting.append((x, before))
                last = x
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        settle(None, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _neighbours(contexts: DataFrame, span: int, forward: bool) -> DataFrame:
    """For every content of one document: the windows shared with its neighbours in one sorted order, and the bound of that side."""
    keys = ["h", "right", "left"] if forward else ["h", "left", "right"]
    ordered = contexts.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(_compared(span, forward), f"h bigint, content bigint, lead int, wins int, forward boolean, bound int, runs {_RUNS}")


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """_id, _th, spans (merged [start, end) word spans), n_words, n_repeated for every document; spans is empty where nothing repeats."""
    own = keyed(docs)
    kind = own.schema["_id"].dataType.simpleString()

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = [], []
            for raw in texts_of(batch.column("text")):
                words = hash_words(raw, NOT_SPACE) if raw is not None else np.zeros(0, np.uint64)
                counts.append(len(words))
                lists.append(suffix_rows(words, span, gram))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])]).astype(np.int32))
            parts = [np.concatenate([x[i] for x in lists]) if lists else np.zeros(0) for i in range(5)]
            rows = pa.StructArray.from_arrays([pa.array(parts[0].view(np.int64)), pa.array(parts[1].view(np.int64)), *(pa.array(p.astype(np.int32)) for p in parts[2:])], ["h", "content", "pos", "lead", "wins"])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, rows)], ["_id", "_th", "n_words", "rows"])

    scanned = materialise(own.mapInArrow(suffixes, f"_id {kind}, _th bigint, n_words bigint, rows array<struct<h:bigint,content:bigint,pos:int,lead:int,wins:int>>"), "suffix-docs")
    rows = scanned.select("_id", "_th", F.explode("rows").alias("r")).select("_id", "_th", "r.*")
    doc = F.xxhash64(F.col("_id").cast("string"), F.col("_id").isNull(), "_th")

    # Most first words stand in one document; the rest of the work sees the others only.
    # (written, so that the join reads two plain shuffles and a hot key can be split)
    shared = materialise(rows.groupBy("h").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo < hi").select("h"), "suffix-firsts")
    rows = materialise(rows.join(shared, "h"), "suffix-shared")
    contents = rows.groupBy("h", "content").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), *[F.first(c).alias(c) for c in ("_id", "_th", "pos", "lead", "wins")])
    contents = materialise(contents.withColumn("many", F.col("lo") < F.col("hi")).drop("hi"), "suffix-contents")
    owned = F.array(F.struct((F.col("lead") - F.col("wins") + 1).alias("first"), F.col("lead").alias("last"))).cast(_RUNS)
    whole = contents.where("many").select("h", "content", owned.alias("runs"))

    # First words with several contents, one of them of a single document, are opened.
    several = materialise(contents.groupBy("h").agg(F.count("*").alias("n"), F.min("many").alias("all")).where("n > 1 and not all").select("h"), "suffix-several")
    asked = contents.join(several, "h").groupBy("_id", "_th").agg(F.collect_list(F.struct("h", "content", "lo", "many", "pos", "lead", "wins")).alias("asks"))
    held = asked.join(own, same_doc(asked, own)).select("asks", own["text"])

    def in_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "content", "lo", "many", "lead", "wins"]
        for batch in batches:
            for raw, asks in zip(texts_of(batch.column("text")), batch.column("asks"), strict=True):
                words = (hash_words(raw, NOT_SPACE) >> np.uint64(64 - 8 * WORD)).astype(">u4")
                n, ahead, back = len(words), words.tobytes(), words[::-1].tobytes()
                pos, lead, wins = (asks.values.field(c).to_numpy().astype(np.int64) for c in ("pos", "lead", "wins"))
                ends = pos - lead + wins - 1 + span
                left = [back[WORD * (n - p) : WORD * (n - p + k)] for p, k in zip(pos.tolist(), lead.tolist(), strict=True)]
                right = [ahead[WORD * p : WORD * e] for p, e in zip(pos.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(asks.values.field(c) for c in names), pa.array(left, pa.binary()), pa.array(right, pa.binary())], [*names, "left", "right"])

    # copies of a row answer for the same content again, which changes nothing below
    contexts = materialise(held.mapInArrow(in_context, "h bigint, content bigint, lo bigint, many boolean, lead int, wins int, left binary, right binary"), "suffix-contexts")
    judged = _neighbours(contexts, span, True).unionByName(_neighbours(contexts, span, False))
    judged = judged.groupBy("h", "content", "lead", "wins").agg(F.flatten(F.collect_set("runs")).alias("runs"), F.max(F.when(F.col("forward"), F.col("bound"))).alias("right"), F.max(F.when(~F.col("forward"), F.col("bound"))).alias("left"))
    unmarked = lambda o: ~F.exists("runs", lambda r: (r["first"] <= o) & (o <= r["last"]))
    left_over = F.filter(F.sequence(F.col("lead") - F.col("wins") + 1, "lead"), lambda o: (o <= F.col("left")) & (F.lit(span) - o <= F.col("right")) & unmarked(o))
    judged = materialise(judged.select("h", "content", "runs", left_over.alias("open")), "suffix-judged")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["window", "h", "content", "offset", "open", "lo", "many"]
        for batch in batches:
            for h, content, lo, many, lead, wins, left, right, runs, undecided in zip(*(batch.column(c).to_pylist() for c in ("h", "content", "lo", "many", "lead", "wins", "left", "right", "runs", "open")), strict=True):
                undecided = set(undecided or ())
                offsets = sorted(undecided.union(*(range(r["first"], r["last"] + 1) for r in runs or ())) if not many else range(lead - wins + 1, lead + 1))
                if offsets:
                    words = np.concatenate([np.frombuffer(left, ">u4")[::-1], np.frombuffer(right, ">u4")]).astype(np.uint64)
                    starts = lead - np.array(offsets)
                    hashes = span_hashes(prefix_sums(mix(words)), starts, starts + span)
                    key = mix(hashes ^ mix(np.uint64(h & (1 << 64) - 1) + np.array(offsets, np.uint64)))
                    n = len(offsets)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array([v] * n, pa.int64()) for v in (h, content)), pa.array(offsets, pa.int32()), pa.array([o in undecided for o in offsets]), pa.array([lo] * n, pa.int64()), pa.array([many] * n)], names)

    loose = contexts.join(judged.where(F.size("open") > 0).select("h").distinct(), "h").join(judged, ["h", "content"], "left")
    opened = materialise(loose.mapInArrow(windows, "window bigint, h bigint, content bigint, offset int, open boolean, lo bigint, many boolean"), "suffix-windows")
    met = opened.groupBy("window").agg(F.min("lo").alias("least"), F.max("lo").alias("most"), F.max("many").alias("many")).where("least < most or many").select("window")
    late = opened.where("open").join(met, "window").select("h", "content", F.array(F.struct(F.col("offset").alias("first"), F.col("offset").alias("last"))).cast(_RUNS).alias("runs"))
    marked = whole.unionByName(judged.where(F.size("runs") > 0).select("h", "content", "runs")).unionByName(late)

    hit = rows.join(marked, ["h", "content"]).select("_id", "_th", F.explode("runs").alias("run"), "pos")
    found = hit.groupBy("_id", "_th").agg(F.collect_set(F.struct((F.col("pos") - F.col("run.last")).alias("first"), (F.col("pos") - F.col("run.first")).alias("last"))).alias("starts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, totals = [], []
            for starts in batch.column("starts"):
                first, last = (starts.values.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
                order = np.lexsort((last, first))
                first, reach = first[order], np.maximum.accumulate(last[order]) + span
                cut = np.flatnonzero(first[1:] > reach[:-1])
                a, b = first[np.concatenate([[0], cut + 1])], reach[np.concatenate([cut, [len(first) - 1]])]
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                totals.append(int((b - a).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(totals, pa.int64())], ["_id", "_th", "spans", "n_repeated"])

    merged = found.mapInArrow(merge, f"_id {kind}, _th bigint, spans array<struct<start:bigint,end:bigint>>, n_repeated bigint")
    base = scanned.select("_id", "_th", "n_words")
    return base.join(merged, same_doc(base, merged), "left").select(base["_id"], base["_th"], "n_words", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated span: doc_id, its word span, and the document's words and repeated words."""
    out = repeated_spans(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_repeated", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), "n_words", "n_repeated")
