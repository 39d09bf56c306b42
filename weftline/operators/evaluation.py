"""Evaluation of retrievers, orders and admissions; contracts between relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, share, total

PAIR = ["customer_id", "article_id"]


@Q.op(lambda d, p: "SELECT source, count(*) AS pairs, count(t.article_id) AS found, count(t.article_id) FILTER (f.article_id IS NULL) AS marginal, round(count(t.article_id) / (SELECT count(*) FROM truth)::double, 6) AS recall FROM (SELECT 'neighbours' AS source, customer_id, article_id FROM src_item_neighbours UNION ALL SELECT 'seasonal', customer_id, article_id FROM src_seasonal UNION ALL SELECT 'cold', customer_id, article_id FROM src_cold_season) x LEFT JOIN truth t ON x.customer_id = t.customer_id AND x.article_id = t.article_id LEFT JOIN rrf_fused_topk f ON x.customer_id = f.customer_id AND x.article_id = f.article_id GROUP BY source")
def proxy_metrics(r, p):
    """Truth that three retrievers find by themselves, and beyond the present pool."""
    named = lambda x, n: r(x).select(*PAIR, F.lit(n).alias("source"))
    rows = named("src_item_neighbours", "neighbours").unionByName(named("src_seasonal", "seasonal")).unionByName(named("src_cold_season", "cold"))
    rows = rows.join(r("truth").withColumn("t", F.lit(1)), PAIR, "left").join(r("rrf_fused_topk").select(*PAIR, F.lit(1).alias("f")), PAIR, "left")
    found = rows.groupBy("source").agg(F.count("*").alias("pairs"), F.count("t").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNull()).alias("marginal"))
    whole = r("truth").agg(F.count("*").alias("n"))  # one row
    return found.join(F.broadcast(whole)).withColumn("recall", share(F.col("found"), F.col("n"))).drop("n")


@Q.op(lambda d, p: "SELECT o.ordering, k.k, i.segment, count(*) AS pairs, count(*) FILTER (o.rk <= k.k) AS found FROM (SELECT customer_id, article_id, 'fused' AS ordering, final_rank AS rk FROM two_ranker_fusion WHERE target = 1 UNION ALL SELECT customer_id, article_id, 'candidate', candidate_rank FROM two_ranker_fusion WHERE target = 1) o JOIN (SELECT article_id, CASE temperature WHEN 'strict_cold' THEN 'cold' WHEN 'sparse' THEN 'sparse' ELSE 'warm' END AS segment FROM item_temperature) i ON o.article_id = i.article_id CROSS JOIN (SELECT unnest([5, 12, 30]) AS k) k GROUP BY ALL")
def ordering_metrics(r, p):
    """Pool positives inside the first 5, 12 and 30 of two orders, by segment of the item."""
    hits = r("two_ranker_fusion").where("target = 1")
    orders = F.explode(F.array(F.struct(F.lit("fused").alias("ordering"), F.col("final_rank").alias("rk")), F.struct(F.lit("candidate").alias("ordering"), F.col("candidate_rank").alias("rk")))).alias("o")
    kind = F.when(F.col("temperature") == "strict_cold", "cold").when(F.col("temperature") == "sparse", "sparse").otherwise("warm")
    own = hits.select("article_id", orders).select("article_id", "o.*").join(r("item_temperature").select("article_id", kind.alias("segment")), "article_id")
    return own.withColumn("k", F.explode(F.array(F.lit(5), F.lit(12), F.lit(30)))).groupBy("ordering", "k", "segment").agg(F.count("*").alias("pairs"), F.count_if(F.col("rk") <= F.col("k")).alias("found"))


@Q.op(lambda d, p: "SELECT count(*) AS new_pairs, count(t.article_id) AS truth_pairs, round(1000.0 * count(t.article_id) / count(*), 6) AS per_thousand, (SELECT round(avg(abs(final_rank - candidate_rank)), 6) FROM two_ranker_fusion) AS mean_movement FROM src_item_neighbours n LEFT JOIN truth t ON n.customer_id = t.customer_id AND n.article_id = t.article_id WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = n.customer_id AND f.article_id = n.article_id)")
def incremental_efficiency(r, p):
    """Truth per thousand candidates that the pool lacks, and the mean movement of ranks between two orders."""
    fresh = r("src_item_neighbours").join(r("rrf_fused_topk").select(*PAIR), PAIR, "left_anti").join(r("truth").withColumn("t", F.lit(1)), PAIR, "left")
    found = fresh.agg(F.count("*").alias("new_pairs"), F.count("t").alias("truth_pairs"), F.round(1000.0 * F.count("t") / F.count("*"), 6).alias("per_thousand"))
    moved = r("two_ranker_fusion").agg(F.round(F.avg(F.abs(F.col("final_rank") - F.col("candidate_rank"))), 6).alias("mean_movement"))
    return found.join(moved)  # one row each


def average_precision(slate: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(customer_id, ap) of ranked slates (pair, rank) for every user with truth."""
    counts = truth.groupBy("customer_id").agg(F.count("*").alias("n"))
    hits = slate.where(F.col("rank") <= k).join(truth, PAIR, "left_semi").withColumn("precision", place("rank") / F.col("rank"))
    sums = hits.groupBy("customer_id").agg(F.sum("precision").alias("s"))
    return counts.join(sums, "customer_id", "left").select("customer_id", F.round(F.coalesce("s", F.lit(0.0)) / F.least("n", F.lit(k)), 8).alias("ap"))


def _ap_sql(slate: str, k: int) -> str:
    return f"SELECT n.customer_id, round(coalesce(sum(h.j / h.rank::double), 0) / least(n.n, {k}), 8) AS ap FROM truth_counts n LEFT JOIN (SELECT s.customer_id, s.rank, row_number() OVER (PARTITION BY s.customer_id ORDER BY s.rank) AS j FROM {slate} s JOIN truth t ON s.customer_id = t.customer_id AND s.article_id = t.article_id WHERE s.rank <= {k}) h ON n.customer_id = h.customer_id GROUP BY n.customer_id, n.n"


@Q.op(lambda d, p: f"""WITH warm AS (SELECT customer_id, article_id, final_rank AS rank FROM two_ranker_fusion WHERE final_rank <= {p.metric_k}), cold AS (SELECT c.customer_id, c.article_id, row_number() OVER (PARTITION BY c.customer_id ORDER BY c.source_rank) AS j FROM src_cold_season c WHERE NOT EXISTS (SELECT 1 FROM warm w WHERE w.customer_id = c.customer_id AND w.article_id = c.article_id) QUALIFY j <= 2),
slate AS (SELECT w.* FROM warm w WHERE rank <= {p.metric_k} - 2 OR NOT EXISTS (SELECT 1 FROM cold c WHERE c.customer_id = w.customer_id AND c.j = w.rank - {p.metric_k} + 2) UNION ALL SELECT customer_id, article_id, {p.metric_k} - 2 + j AS rank FROM cold)
SELECT b.customer_id, b.ap AS ap_before, a.ap AS ap_after, (SELECT count(*) FROM cold c JOIN truth t ON c.customer_id = t.customer_id AND c.article_id = t.article_id WHERE c.customer_id = b.customer_id) AS inserted_positives FROM ({_ap_sql('warm', p.metric_k)}) b JOIN ({_ap_sql('slate', p.metric_k)}) a ON b.customer_id = a.customer_id""")
def admission_effect(r, p):
    """Average precision per user before and after the last two slots went to the user's best unseen cold items, and the positives among these."""
    warm = r("two_ranker_fusion").where(F.col("final_rank") <= p.metric_k).select(*PAIR, F.col("final_rank").alias("rank"))
    cold = r("src_cold_season").join(warm.select(*PAIR), PAIR, "left_anti").withColumn("j", place("source_rank")).where("j <= 2").select(*PAIR, (F.col("j") + p.metric_k - 2).alias("rank"))
    slate = warm.join(cold.select("customer_id", "rank"), ["customer_id", "rank"], "left_anti").select(*PAIR, "rank").unionByName(cold)
    truth = r("truth")
    won = cold.join(truth, PAIR, "left_semi").groupBy("customer_id").agg(F.count("*").alias("c"))
    both = average_precision(warm, truth, p.metric_k).withColumnRenamed("ap", "ap_before").join(average_precision(slate, truth, p.metric_k).withColumnRenamed("ap", "ap_after"), "customer_id")
    return both.join(won, "customer_id", "left").select("customer_id", "ap_before", "ap_after", F.coalesce("c", F.lit(0)).alias("inserted_positives"))


@Q.op(lambda d, p: "WITH a AS (SELECT customer_id, challenger, victim FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY vote_gap / victim_rank DESC, challenger, victim) AS k FROM swap_pairs WHERE vote_gap > 0) WHERE k = 1), b AS (SELECT customer_id, challenger, victim FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY vote_gap * abs(delta) DESC, challenger, victim) AS k FROM swap_pairs WHERE vote_gap > 0) WHERE k = 1) SELECT (SELECT count(*) FROM a) AS users, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS changed_by_label_gain")
def label_gain_leakage(r, p):
    """How many choices differ if the gain of a slot is taken from the labels instead of its place."""
    pairs = r("swap_pairs").where("vote_gap > 0")
    choose = lambda v: pairs.withColumn("k", place(F.desc(v), "challenger", "victim")).where("k = 1").select("customer_id", "challenger", "victim")
    a, b = choose(F.col("vote_gap") / F.col("victim_rank")), choose(F.col("vote_gap") * F.abs("delta"))
    return a.agg(F.count("*").alias("users")).join(a.subtract(b).agg(F.count("*").alias("changed_by_label_gain")))


@Q.op(lambda d, p: f"SELECT round(avg(a.ap), 8) AS realised, round(avg(least(h.hits, {p.metric_k}) / least(a.truth, {p.metric_k})::double), 8) AS oracle, round(avg(a.ap) / avg(least(h.hits, {p.metric_k}) / least(a.truth, {p.metric_k})::double), 6) AS ratio FROM ap_table a JOIN (SELECT n.customer_id, count(f.article_id) AS hits FROM truth_counts n LEFT JOIN (SELECT f.customer_id, f.article_id FROM rrf_fused_topk f JOIN truth t ON f.customer_id = t.customer_id AND f.article_id = t.article_id) f ON n.customer_id = f.customer_id GROUP BY 1) h ON a.customer_id = h.customer_id")
def realised_ratio(r, p):
    """The part of the pool's best possible MAP that the slate realises."""
    hits = r("rrf_fused_topk").join(r("truth"), PAIR, "left_semi").groupBy("customer_id").agg(F.count("*").alias("h"))
    best = F.least(F.coalesce("h", F.lit(0)), F.lit(p.metric_k)) / F.least("truth", F.lit(p.metric_k))
    own = r("ap_table").join(hits, "customer_id", "left").agg(F.avg("ap").alias("a"), F.avg(best).alias("o"))
    return own.select(F.round("a", 8).alias("realised"), F.round("o", 8).alias("oracle"), F.round(F.col("a") / F.col("o"), 6).alias("ratio"))


@Q.op(lambda d, p: f"SELECT count(*) AS users, sum((n <> different)::int)::bigint AS repeated, sum((low <> 1 OR high <> n)::int)::bigint AS gaps, sum((n > {p.candidate_k})::int)::bigint AS too_many, sum((bad > 0)::int)::bigint AS unknown_items FROM (SELECT f.customer_id, count(*) AS n, count(DISTINCT f.article_id) AS different, min(candidate_rank) AS low, max(candidate_rank) AS high, count(*) FILTER (a.article_id IS NULL) AS bad FROM rrf_fused_topk f LEFT JOIN articles a ON f.article_id = a.article_id GROUP BY 1)")
def candidate_contract(r, p):
    """Users whose candidates break each rule of the artefact: repeats, gaps in ranks, too many, unknown items."""
    own = r("rrf_fused_topk").join(r("articles").select("article_id", F.lit(1).alias("known")), "article_id", "left").groupBy("customer_id")
    own = own.agg(F.count("*").alias("n"), F.countDistinct("article_id").alias("different"), F.min("candidate_rank").alias("low"), F.max("candidate_rank").alias("high"), F.count("known").alias("known"))
    rule = lambda c, n: F.count_if(c).alias(n)
    return own.agg(F.count("*").alias("users"), rule(F.col("n") != F.col("different"), "repeated"), rule((F.col("low") != 1) | (F.col("high") != F.col("n")), "gaps"), rule(F.col("n") > p.candidate_k, "too_many"), rule(F.col("known") < F.col("n"), "unknown_items"))


@Q.op(lambda d, p: "SELECT f.customer_id, f.article_id, f.candidate_rank, d.k AS own_rank FROM rrf_fused_topk f JOIN (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS k FROM (SELECT customer_id, article_id, round(fused_score, 4) AS score FROM rrf_fused_topk)) d ON f.customer_id = d.customer_id AND f.article_id = d.article_id")
def stabilised_order(r, p):
    """An order rebuilt from coarser scores, which ties differently, beside the reference order that is adopted, once both hold the same candidates."""
    own = r("rrf_fused_topk").select(*PAIR, place(F.desc(F.round("fused_score", 4)), "article_id").alias("own_rank"))
    return r("rrf_fused_topk").select(*PAIR, "candidate_rank").join(own, PAIR)


@Q.op(lambda d, p: "SELECT count(*) FILTER (f.article_id IS NULL OR s.article_id IS NULL) AS unmatched, count(*) FILTER (f.candidate_rank <> s.candidate_rank) AS changed, count(*) FILTER ((t.article_id IS NOT NULL)::int <> s.target) AS wrong_labels, count(*) - count(DISTINCT (coalesce(f.customer_id, s.customer_id), coalesce(f.article_id, s.article_id))) AS repeated FROM rrf_fused_topk f FULL JOIN two_ranker_fusion s ON f.customer_id = s.customer_id AND f.article_id = s.article_id LEFT JOIN truth t ON t.customer_id = s.customer_id AND t.article_id = s.article_id")
def outer_mismatch(r, p):
    """Pool against ranked rows by a full join: unmatched, changed, wrongly labelled and repeated rows. All must be none."""
    pool = r("rrf_fused_topk").select(*PAIR, F.col("candidate_rank").alias("was"), F.lit(1).alias("f"))
    own = pool.join(r("two_ranker_fusion").select(*PAIR, "candidate_rank", "target", F.lit(1).alias("s")), PAIR, "full").join(r("truth").withColumn("t", F.lit(1)), PAIR, "left")
    rows = own.groupBy(*PAIR).agg(F.count("*").alias("n"), F.count_if(F.col("f").isNull() | F.col("s").isNull()).alias("u"), F.count_if(F.col("was") != F.col("candidate_rank")).alias("c"), F.count_if(F.coalesce("t", F.lit(0)) != F.col("target")).alias("w"))
    return rows.agg(F.sum("u").alias("unmatched"), F.sum("c").alias("changed"), F.sum("w").alias("wrong_labels"), F.sum(F.col("n") - 1).alias("repeated"))


@Q.op(lambda d, p: "SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM item_vectors GROUP BY vector) GROUP BY copies")
def vector_duplicates(r, p):
    """Groups of items with exactly equal vectors by their size, grouped by hash first."""
    own = r("item_vectors").groupBy(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")).agg(F.count("*").alias("copies"))
    return own.groupBy("copies").agg(F.count("*").alias("groups"))


@Q.op(lambda d, p: "WITH early AS (SELECT customer_id, article_id, rank_a, round(final_score, 8) AS s FROM two_ranker_fusion WHERE candidate_rank <= 20), again AS (SELECT t.customer_id, t.article_id, t.rank_a, round(t.final_score, 8) AS s FROM two_ranker_fusion t JOIN early e ON t.customer_id = e.customer_id AND t.article_id = e.article_id) SELECT (SELECT count(*) FROM (SELECT * FROM early EXCEPT ALL SELECT * FROM again)) AS missing, (SELECT count(*) FROM (SELECT * FROM again EXCEPT ALL SELECT * FROM early)) AS extra, (SELECT count(*) FROM early) AS n")
def replay_parity(r, p):
    """An earlier cohort replayed inside the larger one, compared as bags both ways."""
    row = [*PAIR, "rank_a", F.round("final_score", 8).alias("s")]
    early = r("two_ranker_fusion").where("candidate_rank <= 20").select(*row)
    again = r("two_ranker_fusion").select(*row).join(early.select(*PAIR), PAIR, "left_semi")
    count = lambda x, n: x.agg(F.count("*").alias(n))
    return count(early.exceptAll(again), "missing").join(count(again.exceptAll(early), "extra")).join(count(early, "n"))


@Q.op(lambda d, p: f"SELECT CASE WHEN s.t_dat >= {d.shift(d.date(p.cutoff), -p.history_days // 3)} THEN 'recent' ELSE 'old' END AS part, a.article_id AS src, b.article_id AS dst, count(*) AS transitions, count(DISTINCT s.customer_id) AS users, round(sum(1.0 / (a.size * b.size)), 6) AS weight FROM transition_steps s JOIN sized_days a ON s.customer_id = a.customer_id AND s.t_dat = a.t_dat JOIN sized_days b ON s.customer_id = b.customer_id AND s.next_day = b.t_dat GROUP BY 1, 2, 3 UNION ALL SELECT 'full', a.article_id, b.article_id, count(*), count(DISTINCT s.customer_id), round(sum(1.0 / (a.size * b.size)), 6) FROM transition_steps s JOIN sized_days a ON s.customer_id = a.customer_id AND s.t_dat = a.t_dat JOIN sized_days b ON s.customer_id = b.customer_id AND s.next_day = b.t_dat GROUP BY 2, 3")
def transition_windows(r, p):
    """Transition edges of the whole window and of its old and recent parts, with transitions, users and weight; one pass for all three."""
    cut = F.date_sub(F.lit(p.cutoff).cast("date"), p.history_days // 3 + (p.history_days % 3 > 0))
    day = r("sized_days")
    a = day.select("customer_id", "t_dat", F.col("article_id").alias("src"), F.col("size").alias("sa"))
    b = day.select("customer_id", F.col("t_dat").alias("next_day"), F.col("article_id").alias("dst"), F.col("size").alias("sb"))
    steps = r("transition_steps").join(a, ["customer_id", "t_dat"]).join(b, ["customer_id", "next_day"])
    part = F.explode(F.array(F.lit("full"), F.when(F.col("t_dat") >= cut, "recent").otherwise("old")))
    return steps.withColumn("part", part).groupBy("part", "src", "dst").agg(F.count("*").alias("transitions"), F.countDistinct("customer_id").alias("users"), F.round(F.sum(1 / (F.col("sa") * F.col("sb"))), 6).alias("weight"))


@Q.op(lambda d, p: """WITH e AS (SELECT c.src, c.dst, c.similarity, k.cosine, x.product_type = y.product_type AS same, x.garment_group = y.garment_group AS group_same FROM covisit_neighbors c JOIN articles x ON c.src = x.article_id JOIN articles y ON c.dst = y.article_id LEFT JOIN item_knn k ON c.src = k.anchor AND c.dst = k.neighbour),
m AS (SELECT *, (rank() OVER (PARTITION BY src ORDER BY similarity) - 1 + (count(*) OVER (PARTITION BY src, similarity) + 1) / 2.0) / count(*) OVER (PARTITION BY src) AS pct FROM e)
SELECT label, count(*) AS edges, round(avg(pct), 5) AS mean_pct FROM (SELECT *, CASE WHEN same AND cosine IS NOT NULL THEN 'substitute' WHEN same THEN 'variant' WHEN pct > 0.8 AND group_same THEN 'complement' WHEN pct > 0.8 THEN 'bought together' WHEN cosine IS NOT NULL THEN 'look-alike' ELSE 'weak' END AS label FROM m) GROUP BY label""")
def relation_labels(r, p):
    """Co-purchase edges labelled by a cascade over type, closeness and the mid-rank percentile of their similarity at the source."""
    kinds = lambda key: r("articles").select(F.col("article_id").alias(key), F.col("product_type").alias(f"t_{key}"), F.col("garment_group").alias(f"g_{key}"))
    own = r("covisit_neighbors").select("src", "dst", "similarity").join(kinds("src"), "src").join(kinds("dst"), "dst")
    own = own.join(r("item_knn").select(F.col("anchor").alias("src"), F.col("neighbour").alias("dst"), "cosine"), ["src", "dst"], "left")
    ties = total(F.count("*"), ["src", "similarity"])
    from pyspark.sql import Window

    below = F.rank().over(Window.partitionBy("src").orderBy("similarity")) - 1
    own = own.withColumn("pct", (below + (ties + 1) / 2) / total(F.count("*"), "src"))
    same, near, high = F.col("t_src") == F.col("t_dst"), F.col("cosine").isNotNull(), F.col("pct") > 0.8
    label = F.when(same & near, "substitute").when(same, "variant").when(high & (F.col("g_src") == F.col("g_dst")), "complement").when(high, "bought together").when(near, "look-alike").otherwise("weak")
    return own.groupBy(label.alias("label")).agg(F.count("*").alias("edges"), F.round(F.avg("pct"), 5).alias("mean_pct"))


def weak_roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each weakly connected component of (src, dst), by least labels and pointer jumps; every round is a written table."""
    from ..storage import materialise

    both = materialise(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "graph-edges")
    state = materialise(both.select(F.col("src").alias("node")).union(edges.select("src")).union(edges.select("dst")).distinct().withColumn("root", F.col("node")), "graph-roots")
    for _ in range(rounds):
        near = both.join(state.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("m"))
        least = state.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("m", "root")).alias("new"))
        jump = least.select(F.col("node").alias("new"), F.col("new").alias("far"))
        fresh = materialise(least.join(jump, "new").select("node", "root", F.least("new", "far").alias("new")), "graph-roots")
        moved = fresh.where("new <> root").isEmpty()
        state = fresh.select("node", F.col("new").alias("root"))
        if moved:
            return state
    raise RuntimeError("components did not settle")


@Q.op(lambda d, p: ", ".join(["WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM basket_transitions WHERE weight >= 0.5 AND transitions >= 2 UNION SELECT dst, src FROM basket_transitions WHERE weight >= 0.5 AND transitions >= 2)", "reach AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)", "roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)", "sizes AS (SELECT root, count(*) AS n FROM roots GROUP BY root) SELECT count(*) AS components, sum(n)::bigint AS nodes, max(n) AS largest, round(max(n) / sum(n)::double, 6) AS largest_share, count(*) FILTER (n = 2) AS pairs FROM sizes"]))
def weak_components(r, p):
    """Weakly connected components of the stronger transitions: their number, nodes, largest share."""
    edges = r("basket_transitions").where("weight >= 0.5 AND transitions >= 2")
    sizes = weak_roots(edges).groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.sum("n").alias("nodes"), F.max("n").alias("largest"), share(F.max("n"), F.sum("n")).alias("largest_share"), F.count_if(F.col("n") == 2).alias("pairs"))
