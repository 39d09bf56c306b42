"""The pipeline and the query registry of the subpackage."""

from collections import Counter

import compare
import pytest

import corpus_pipeline
from test_neardup import grams
from test_operators import alnum, brute_kept_lines
from weftline.llm import common, entry, mixing, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_keep_columns(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["stage_toxicity", "stage_line_dedup", "stage_simhash", "stage_decontamination", "stage_mixing"]
    docs = common.table(spark, SMALL, "documents")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SMALL), "test")
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()


def test_pipeline_equals_plain_version(spark):
    """Each stage's decisions recomputed row by row from the operators' documented rules."""
    docs = common.table(spark, SMALL, "documents")
    model = toxicity.fit(docs, common.table(spark, SMALL, "labels"))
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r, s in zip(rows, model.scores([r["text"] for r in rows], {}), strict=True) if s < 0.5]
    kept = brute_kept_lines([(r["doc_id"], r["text"], r["source"]) for r in rows])
    rows = [r | {"text": text} for r, text in zip(rows, kept, strict=True)]
    sets = [grams(r["text"]) for r in rows]
    group = list(range(len(rows)))
    while True:
        before = list(group)
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    first = {}
    for g, r in zip(group, rows, strict=True):
        first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    rows = [r for g, r in zip(group, rows, strict=True) if r["doc_id"] == first[g]]
    windows = {}
    for item in common.table(spark, SMALL, "benchmark").collect():
        w = alnum(item["text"])
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))
    leaked = lambda w: any(tuple(w[i : i + n]) in s for n, s in windows.items() for i in range(len(w) - n + 1))
    rows = [r for r in rows if not leaked(alnum(r["text"]))]
    plain = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    expected = Counter({r["doc_id"]: r["copies"] for r in mixing.mixed(plain).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()) == expected


def test_every_operator_has_one_query():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = compare.connect(SMALL)
    assert compare.differences(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) == ""
