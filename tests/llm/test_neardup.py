"""Near-duplicate groups against brute force over all pairs."""

import re

import numpy as np

from weftline.llm import neardup


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def copies():
    """Texts with copies that differ in a few words, on both sides of the threshold, and chains of them."""
    rng = np.random.default_rng(5)
    out = []
    for size in (4, 8, 40, 120, 400):
        for _ in range(6):
            words = [f"w{x}" for x in rng.integers(0, 3000, size)]
            out.append(" ".join(words))
            for changes in range(1, 1 + max(2, size // 25)):
                near = list(words)
                for at in rng.integers(0, size, changes):
                    near[at] = "changed"
                out.append(" ".join(near))
    return out


def test_groups_equal_brute_force(spark, no_documents):
    texts = [*copies(), None, "", " \n", "a b"]
    sets = [grams(t) for t in texts]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
                links += sets[a] != sets[b]
                group[find(a)] = find(b)
    assert links > 30
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in enumerate(texts)], no_documents.schema)
    roots = {r["_id"]: r["root"] for r in neardup.components(docs).collect()}
    pairs = {(find(i), roots[i]) for i in roots}
    assert len(roots) == len(texts) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(pairs)
    assert neardup.one_of_each(no_documents).count() == 0


def test_pipeline_stage_drops_a_near_copy(spark, no_documents):
    import corpus_pipeline

    words = [f"word{i}" for i in range(400)]
    near = [*words[:200], "another", "pair", *words[202:]]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1, "x"), (2, " ".join(near), "en", "a", 1, "x"), (None, "one", "en", "a", 1, "x"), (None, "two", "en", "a", 1, "x")], no_documents.schema)
    assert sorted(r["text"] for r in corpus_pipeline.stage_simhash(spark, docs, "").collect()) == sorted([" ".join(words), "one", "two"])


def test_fingerprints_bring_similar_texts_together(spark):
    """SimHash links are found and settled on whole sets: near copies and equal fingerprints, not texts that merely share a fingerprint."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(reversed(words))), (4, ""), (5, "alone")]
    found = neardup.by_fingerprint(spark.createDataFrame(rows, "cls long, text string")).collect()
    assert [(r["src"], r["dst"]) for r in found] == [(1, 2)]


def test_tables_that_compress_well_are_not_broadcast(spark, no_documents, monkeypatch):
    plans, write = {}, neardup.materialise

    def noted(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(neardup, "materialise", noted)
    neardup.components(spark.createDataFrame([(i, t, "en", "a", len(t), "x") for i, t in enumerate(copies())], no_documents.schema)).count()
    for tag in ("asked", "judged", "met", "found"):
        assert plans[f"neardup-{tag}"] and not any("BroadcastHashJoin" in x for x in plans[f"neardup-{tag}"]), tag
