"""Repeated spans against brute force: passages cut at all lengths, set in different contexts, and phrases common to all."""

import numpy as np
import pytest

from weftline.llm import suffixes


def brute(docs, span=50):
    texts = {(d, t): (t or "").lower().split() for d, t in docs}
    owners = {}
    for key, w in texts.items():
        for at in range(len(w) - span + 1):
            owners.setdefault(tuple(w[at : at + span]), set()).add(key)
    return {key: {x for at in range(len(w) - span + 1) if len(owners[tuple(w[at : at + span])]) > 1 for x in range(at, at + span)} for key, w in texts.items()}


def passages(seed):
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    shared = [fresh(n) for n in (49, 50, 51, 60, 90, 200)]
    phrase = fresh(14)
    out = []
    for i in range(60):
        words = fresh(int(rng.integers(0, 60)))
        for _ in range(int(rng.integers(1, 4))):
            p = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, 12))
            words += p[a:] if i % 2 else p[: len(p) - a]
            words += phrase + fresh(int(rng.integers(0, 30)))
        out.append((i, " ".join(words)))
    loop = phrase * 6
    # left words shared with one document, right words with another, the window with none or with a third
    x, y, z = fresh(40), fresh(20), fresh(40)
    out += [(100, " ".join(x + y + fresh(40))), (101, " ".join(fresh(40) + y + z)), (102, " ".join(x + y + z)), (103, " ".join(x[5:] + y + z[:25]))]
    out += [(110, " ".join(loop)), (111, " ".join([*loop, "end"])), (112, " ".join(fresh(9) + shared[3] + fresh(9) + shared[3])), (113, " ".join(fresh(70) * 2)), (None, None), (5, "")]
    return out + out[:3]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 40)])
def test_repeated_spans_equal_brute_force(spark, seed, parts):
    docs = passages(seed)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, h string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = suffixes.repeated_spans(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = brute(docs)
    assert len(rows) == len(docs)
    found = {}
    for r in rows:
        hit = {x for s in r["spans"] for x in range(s["start"], s["end"])}
        assert len(hit) == r["n_repeated"] == sum(s["end"] - s["start"] for s in r["spans"])
        found.setdefault((r["_id"], r["n_words"]), []).append(hit)
    for (d, t), hit in expected.items():
        assert hit in found[d, len((t or "").split())]
    assert sum(map(bool, expected.values())) > 40


def test_contexts_have_common_words():
    words = lambda *x: np.array(x, ">u4").tobytes()
    assert suffixes.common_words(words(1, 2, 3), words(1, 2, 3, 4)) == 3
    assert suffixes.common_words(words(1, 2, 3), words(1, 2 | 1 << 31, 3)) == 1
    assert suffixes.common_words(words(0, 0), words(0, 1)) == 1 and suffixes.common_words(b"", words(5)) == 0
