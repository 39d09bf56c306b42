"""Views of rankings: fusions with the candidate order, hybrid orders, choices of swaps, policies over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, share
from ..storage import materialise

PAIR = ["customer_id", "article_id"]


def reciprocal(rank: str, p):
    return 1 / (F.lit(float(p.rrf)) + F.col(rank))


@Q.op(lambda d, p: f"SELECT customer_id, article_id, score, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS view_rank FROM (SELECT customer_id, article_id, round(1.0 / ({p.rrf} + rank_a) + 1.0 / ({p.rrf} + rank_b) + 1.0 / ({p.rrf} + candidate_rank), 10) AS score FROM two_ranker_fusion)")
def three_view_fusion(r, p):
    """Reciprocal-rank fusion of both models and the candidate order."""
    score = F.round(reciprocal("rank_a", p) + reciprocal("rank_b", p) + reciprocal("candidate_rank", p), 10)
    own = r("two_ranker_fusion").select(*PAIR, score.alias("score"))
    return own.withColumn("view_rank", place(F.desc("score"), "article_id"))


@Q.op(lambda d, p: f"SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY round(1.0 / ({p.rrf} + rank_a) + 1.0 / ({p.rrf} + candidate_rank), 10) DESC, candidate_rank) AS fused_rank FROM two_ranker_fusion")
def prior_fusion(r, p):
    """One model's rank fused with the frozen candidate rank."""
    score = F.round(reciprocal("rank_a", p) + reciprocal("candidate_rank", p), 10)
    return r("two_ranker_fusion").select(*PAIR, place(F.desc(score), "candidate_rank").alias("fused_rank"))


@Q.op(lambda d, p: f"WITH j AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round((score_a + score_b) / 2, 8) DESC, candidate_rank) AS joint_rank FROM scored) SELECT customer_id, article_id, joint_rank, row_number() OVER (PARTITION BY customer_id ORDER BY round(1.0 / ({p.rrf} + joint_rank) + 1.0 / ({p.rrf} + candidate_rank), 10) DESC, candidate_rank) AS two_way_rank FROM j")
def joint_ranks(r, p):
    """The rank by the mean score of both experts, and its fusion with the candidate rank."""
    own = r("scored").withColumn("joint_rank", place(F.desc(F.round((F.col("score_a") + F.col("score_b")) / 2, 8)), "candidate_rank"))
    return own.select(*PAIR, "joint_rank", place(F.desc(F.round(reciprocal("joint_rank", p) + reciprocal("candidate_rank", p), 10)), "candidate_rank").alias("two_way_rank"))


@Q.op(lambda d, p: "SELECT customer_id, article_id, hybrid, row_number() OVER (PARTITION BY customer_id ORDER BY hybrid DESC, candidate_rank) AS hybrid_rank FROM (SELECT customer_id, article_id, candidate_rank, round(0.7 * score_a + 0.3 * fused_score, 8) AS hybrid FROM scored)")
def hybrid_order(r, p):
    """Order by a weighted score, ties by candidate rank."""
    own = r("scored").select(*PAIR, "candidate_rank", F.round(0.7 * F.col("score_a") + 0.3 * F.col("fused_score"), 8).alias("hybrid"))
    return own.select(*PAIR, "hybrid", place(F.desc("hybrid"), "candidate_rank").alias("hybrid_rank"))


def best_pairs(pairs: DataFrame, *order) -> DataFrame:
    return pairs.withColumn("k", place(*order, "challenger", "victim")).where("k = 1").drop("k")


@Q.op(lambda d, p: "SELECT customer_id, challenger, victim, value FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY value DESC, challenger, victim) AS k FROM (SELECT s.customer_id, challenger, victim, round((1 / (1 + exp(-c.score_a)) - 1 / (1 + exp(-v.score_a))) / victim_rank, 8) AS value FROM swap_pairs s JOIN scored c ON s.customer_id = c.customer_id AND s.challenger = c.article_id JOIN scored v ON s.customer_id = v.customer_id AND s.victim = v.article_id)) WHERE k = 1 AND value > 0")
def propensity_swap(r, p):
    """The pair of largest (p_challenger - p_victim) times the gain of the slot, if that is positive."""
    chance = lambda n, key: r("scored").select("customer_id", F.col("article_id").alias(key), (1 / (1 + F.exp(-F.col("score_a")))).alias(n))
    own = r("swap_pairs").join(chance("pc", "challenger"), ["customer_id", "challenger"]).join(chance("pv", "victim"), ["customer_id", "victim"])
    own = own.select("customer_id", "challenger", "victim", F.round((F.col("pc") - F.col("pv")) / F.col("victim_rank"), 8).alias("value"))
    return best_pairs(own, F.desc("value")).where("value > 0")


@Q.op(lambda d, p: """WITH ok AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(score_gap + vote_gap, 8) DESC, challenger, victim) AS k FROM swap_pairs WHERE score_gap > -0.01 AND vote_gap > 0), first AS (SELECT * FROM ok WHERE k = 1)
SELECT customer_id, challenger, victim, 1 AS turn FROM first UNION ALL SELECT customer_id, challenger, victim, 2 AS turn FROM (SELECT o.*, row_number() OVER (PARTITION BY o.customer_id ORDER BY o.k) AS j FROM ok o JOIN first f ON o.customer_id = f.customer_id WHERE o.challenger <> f.challenger AND o.victim <> f.victim) WHERE j = 1""")
def direct_actions(r, p):
    """At most two disjoint pairs of a user for which both the fused and the second score speak, greedily by their sum."""
    ok = r("swap_pairs").where("score_gap > -0.01 AND vote_gap > 0").withColumn("k", place(F.desc(F.round(F.col("score_gap") + F.col("vote_gap"), 8)), "challenger", "victim"))
    first = ok.where("k = 1").select("customer_id", "challenger", "victim", F.lit(1).alias("turn"))
    taken = first.select("customer_id", F.col("challenger").alias("c"), F.col("victim").alias("v"))
    rest = ok.join(taken, "customer_id").where("challenger <> c AND victim <> v").withColumn("j", place("k")).where("j = 1")
    return first.unionByName(rest.select("customer_id", "challenger", "victim", F.lit(2).alias("turn")))


CLASSES = "CASE WHEN vote_gap < -0.2 THEN 'harm' WHEN vote_gap > 0.2 THEN 'benefit' ELSE 'neutral' END"


@Q.op(lambda d, p: f"SELECT g.customer_id, g.challenger, g.victim, s.kind FROM greedy_swaps g JOIN (SELECT customer_id, challenger, victim, {CLASSES.replace('vote_gap', '(score_gap * 100 + vote_gap - 0.3)')} AS kind FROM swap_pairs) s ON g.customer_id = s.customer_id AND g.challenger = s.challenger AND g.victim = s.victim WHERE s.kind <> 'harm'")
def harm_veto(r, p):
    """The chosen swaps without those whose class of effect is harm; never others."""
    x = F.col("score_gap") * 100 + F.col("vote_gap") - 0.3
    kind = F.when(x < -0.2, "harm").when(x > 0.2, "benefit").otherwise("neutral")
    classed = r("swap_pairs").select("customer_id", "challenger", "victim", kind.alias("kind"))
    return r("greedy_swaps").select("customer_id", "challenger", "victim").join(classed, ["customer_id", "challenger", "victim"]).where("kind <> 'harm'")


@Q.op(lambda d, p: f"SELECT b.customer_id, b.article_id, t.article_id AS victim, b.source_score FROM (SELECT n.customer_id, n.article_id, n.source_score, row_number() OVER (PARTITION BY n.customer_id ORDER BY n.source_score DESC, n.article_id) AS k FROM src_item_neighbours n WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = n.customer_id AND f.article_id = n.article_id)) b JOIN two_ranker_fusion t ON b.customer_id = t.customer_id AND t.final_rank = {p.metric_k} WHERE b.k = 1 AND b.source_score > t.final_score")
def admission_over_victim(r, p):
    """The best item that only the second retriever has, admitted in the last slot if it scores above the item there."""
    fresh = r("src_item_neighbours").join(r("rrf_fused_topk").select(*PAIR), PAIR, "left_anti").withColumn("k", place(F.desc("source_score"), "article_id")).where("k = 1")
    last = r("two_ranker_fusion").where(F.col("final_rank") == p.metric_k).select("customer_id", F.col("article_id").alias("victim"), "final_score")
    return fresh.join(last, "customer_id").where("source_score > final_score").select(*PAIR, "victim", "source_score")


@Q.op(lambda d, p: f"""WITH m AS (SELECT customer_id, challenger, victim, victim_rank, round(1 / (1 + exp(-4 * vote_gap)) - 0.5, 6) AS margin FROM swap_pairs WHERE challenger_rank <= {p.metric_k} + 8), ok AS (SELECT * FROM m WHERE margin > 0),
two AS (SELECT a.customer_id, a.challenger AS c1, a.victim AS v1, b.challenger AS c2, b.victim AS v2, round(a.margin + b.margin, 6) AS total FROM ok a JOIN ok b ON a.customer_id = b.customer_id AND a.challenger < b.challenger AND a.victim <> b.victim),
every AS (SELECT customer_id, challenger AS c1, victim AS v1, cast(NULL AS bigint) AS c2, cast(NULL AS bigint) AS v2, margin AS total FROM ok UNION ALL SELECT * FROM two)
SELECT customer_id, c1, v1, c2, v2, total FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY total DESC, c1, v1, c2, v2) AS k FROM every) WHERE k = 1""")
def pair_margin_swaps(r, p):
    """The one or two disjoint swaps of a user of largest total margin over a half in pairwise comparison; a user has at most forty pairs here."""
    margin = F.round(1 / (1 + F.exp(-4 * F.col("vote_gap"))) - 0.5, 6)
    ok = r("swap_pairs").where(F.col("challenger_rank") <= p.metric_k + 8).select("customer_id", F.col("challenger").alias("c1"), F.col("victim").alias("v1"), margin.alias("total")).where("total > 0")
    other = ok.select("customer_id", F.col("c1").alias("c2"), F.col("v1").alias("v2"), F.col("total").alias("more"))
    two = ok.join(other, "customer_id").where("c1 < c2 AND v1 <> v2").withColumn("total", F.round(F.col("total") + F.col("more"), 6)).drop("more")
    every = two.unionByName(ok, allowMissingColumns=True)
    return every.withColumn("k", place(F.desc("total"), "c1", "v1", F.asc_nulls_last("c2"), F.asc_nulls_last("v2"))).where("k = 1").drop("k")


GRID = [(gap, deep, cap) for gap in (0.0, 0.1, 0.3) for deep in (20, 50) for cap in (1, 2)]


@Q.op(lambda d, p: " UNION ALL ".join(f"SELECT {g}::double AS least_gap, {deep} AS depth, {cap} AS cap, count(*) AS actions, count(DISTINCT customer_id) AS users, coalesce(round(sum(delta), 6), 0) AS total FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, victim ORDER BY vote_gap DESC, challenger) AS j, row_number() OVER (PARTITION BY customer_id ORDER BY vote_gap DESC, challenger, victim) AS k FROM swap_pairs WHERE vote_gap > {g} AND challenger_rank <= {deep}) WHERE j = 1 AND k <= {cap}" for g, deep, cap in GRID))
def policy_grid(r, p):
    """A grid of swap policies (least gap, depth, actions a user) over one pass of the ranked pairs: actions, users and the exact change in sum."""
    pairs = r("swap_pairs")
    grid = F.explode(F.array(*[F.struct(F.lit(g).alias("least_gap"), F.lit(deep).alias("depth"), F.lit(cap).alias("cap")) for g, deep, cap in GRID]))
    # a dozen policies by pair: ranks are taken inside each
    tried = pairs.withColumn("policy", grid).select("*", "policy.*").where("vote_gap > least_gap AND challenger_rank <= depth")
    key = ["customer_id", "least_gap", "depth", "cap"]
    tried = tried.withColumns({"j": place(F.desc("vote_gap"), "challenger", by=[*key, "victim"]), "k": place(F.desc("vote_gap"), "challenger", "victim", by=key)}).where("j = 1 AND k <= cap")
    found = tried.groupBy("least_gap", "depth", "cap").agg(F.count("*").alias("actions"), F.countDistinct("customer_id").alias("users"), F.round(F.sum("delta"), 6).alias("total"))
    every = pairs.sparkSession.createDataFrame(GRID, "least_gap double, depth int, cap int")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)) for c, t in (("actions", "long"), ("users", "long"), ("total", "double"))}
    return every.join(found, ["least_gap", "depth", "cap"], "left").withColumns(zero)


@Q.op(lambda d, p: f"""WITH tail AS (SELECT t.*, s.score_a, s.score_b FROM two_ranker_fusion t JOIN scored s ON t.customer_id = s.customer_id AND t.article_id = s.article_id WHERE t.final_rank > {p.head} AND t.final_rank <= {p.metric_k}),
ranked AS (SELECT *, row_number() OVER w1 AS last, row_number() OVER w2 AS weak_a, row_number() OVER w3 AS joint FROM tail WINDOW w1 AS (PARTITION BY customer_id ORDER BY final_rank DESC), w2 AS (PARTITION BY customer_id ORDER BY score_a, article_id), w3 AS (PARTITION BY customer_id ORDER BY rank_a + rank_b DESC, article_id))
SELECT 'last' AS policy, customer_id, article_id AS victim FROM ranked WHERE last = 1 UNION ALL SELECT 'weakest' AS policy, customer_id, article_id AS victim FROM ranked WHERE weak_a = 1 UNION ALL SELECT 'rank sum' AS policy, customer_id, article_id AS victim FROM ranked WHERE joint = 1""")
def victim_policies(r, p):
    """The row of the open slots that three policies would give up: the last, the one of least score, the one of largest rank sum."""
    tail = r("two_ranker_fusion").where((F.col("final_rank") > p.head) & (F.col("final_rank") <= p.metric_k)).join(r("scored").select(*PAIR, "score_a"), PAIR)
    orders = {"last": [F.desc("final_rank")], "weakest": ["score_a", "article_id"], "rank sum": [F.desc(F.col("rank_a") + F.col("rank_b")), "article_id"]}
    tail = tail.withColumns({name: place(*order) for name, order in orders.items()})
    each = F.explode(F.array(*[F.when(F.col(name) == 1, F.lit(name)) for name in orders]))
    return tail.select("customer_id", F.col("article_id").alias("victim"), each.alias("policy")).where("policy IS NOT NULL")


@Q.op(lambda d, p: f"SELECT c.customer_id, c.article_id AS challenger, v.article_id AS victim, round(c.score_b - v.score_b, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_b DESC, article_id) AS k FROM (SELECT s.*, t.final_rank FROM scored s JOIN two_ranker_fusion t ON s.customer_id = t.customer_id AND s.article_id = t.article_id) x WHERE final_rank > {p.metric_k}) c JOIN (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_b, article_id) AS k FROM (SELECT s.*, t.final_rank FROM scored s JOIN two_ranker_fusion t ON s.customer_id = t.customer_id AND s.article_id = t.article_id) y WHERE final_rank > {p.head} AND final_rank <= {p.metric_k}) v ON c.customer_id = v.customer_id AND c.k = 1 AND v.k = 1 WHERE c.score_b > v.score_b")
def best_against_worst(r, p):
    """The best challenger against the worst open row by one score, where the difference is positive."""
    own = r("scored").join(r("two_ranker_fusion").select(*PAIR, "final_rank"), PAIR)
    best = own.where(F.col("final_rank") > p.metric_k).withColumn("k", place(F.desc("score_b"), "article_id")).where("k = 1").select("customer_id", F.col("article_id").alias("challenger"), F.col("score_b").alias("c"))
    worst = own.where((F.col("final_rank") > p.head) & (F.col("final_rank") <= p.metric_k)).withColumn("k", place("score_b", "article_id")).where("k = 1").select("customer_id", F.col("article_id").alias("victim"), F.col("score_b").alias("v"))
    return best.join(worst, "customer_id").where("c > v").select("customer_id", "challenger", "victim", F.round(F.col("c") - F.col("v"), 6).alias("gap"))


@Q.op(lambda d, p: "SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score_a DESC, article_id) AS by_score, row_number() OVER (PARTITION BY customer_id ORDER BY round(score_a * score_b, 8) DESC, article_id) AS by_product, row_number() OVER (PARTITION BY customer_id ORDER BY least(score_a, score_b) DESC, article_id) AS by_least FROM scored")
def ordering_variants(r, p):
    """Three orders of the pool: one score, the product of both, the lesser of both."""
    a, b = F.col("score_a"), F.col("score_b")
    keys = {"by_score": a, "by_product": F.round(a * b, 8), "by_least": F.least(a, b)}
    return r("scored").select(*PAIR, *[place(F.desc(k), "article_id").alias(n) for n, k in keys.items()])


@Q.op(lambda d, p: "SELECT g.customer_id, g.challenger, g.victim FROM greedy_swaps g JOIN swap_pairs s ON g.customer_id = s.customer_id AND g.challenger = s.challenger AND g.victim = s.victim JOIN two_ranker_fusion c ON g.customer_id = c.customer_id AND g.challenger = c.article_id JOIN (SELECT customer_id, count(DISTINCT product_type) AS kinds FROM typed_recent GROUP BY 1) k ON g.customer_id = k.customer_id WHERE s.score_gap > -0.02 AND least(c.rank_a, c.rank_b) <= 20 AND k.kinds >= 3")
def action_consensus(r, p):
    """Chosen swaps that pass all gates: the fused score agrees, one model ranks the challenger among twenty, the user has three interests."""
    pairs = r("swap_pairs").where("score_gap > -0.02").select("customer_id", "challenger", "victim")
    ranked = r("two_ranker_fusion").where(F.least("rank_a", "rank_b") <= 20).select("customer_id", F.col("article_id").alias("challenger"))
    kinds = r("typed_recent").groupBy("customer_id").agg(F.countDistinct("product_type").alias("kinds")).where("kinds >= 3")
    own = r("greedy_swaps").select("customer_id", "challenger", "victim").join(pairs, ["customer_id", "challenger", "victim"])
    return own.join(ranked, ["customer_id", "challenger"], "left_semi").join(kinds, "customer_id", "left_semi").select("customer_id", "challenger", "victim")


@Q.op(lambda d, p: f"SELECT customer_id, count(*) AS items, count(DISTINCT article_id) AS different, min(final_rank) AS first, max(final_rank) AS last, string_agg(article_id::varchar, ' ' ORDER BY final_rank) AS slate FROM swapped_slate WHERE final_rank <= {p.metric_k} GROUP BY customer_id")
def champion_slate(r, p):
    """The whole slate of the final policy for every user, with the counts that prove it complete."""
    own = r("swapped_slate").where(F.col("final_rank") <= p.metric_k).groupBy("customer_id")
    own = own.agg(F.count("*").alias("items"), F.countDistinct("article_id").alias("different"), F.min("final_rank").alias("first"), F.max("final_rank").alias("last"), F.array_sort(F.collect_list(F.struct("final_rank", "article_id"))).alias("x"))
    return own.select("customer_id", "items", "different", "first", "last", F.array_join(F.transform("x", lambda e: e["article_id"].cast("string")), " ").alias("slate"))


@Q.op(lambda d, p: f"""WITH chosen AS (SELECT b.customer_id, b.article_id, t.article_id AS victim, t.target AS lost FROM best_cold_per_user b JOIN two_ranker_fusion t ON b.customer_id = t.customer_id AND t.final_rank = {p.metric_k} WHERE b.source_score > 0.05 AND NOT EXISTS (SELECT 1 FROM two_ranker_fusion x WHERE x.customer_id = b.customer_id AND x.article_id = b.article_id AND x.final_rank <= {p.metric_k}))
SELECT c.customer_id, c.article_id, c.victim, CASE WHEN y.article_id IS NULL THEN 0 ELSE 1 END AS won, c.lost, round(((CASE WHEN y.article_id IS NULL THEN 0 ELSE 1 END) - c.lost) * (coalesce(h.hits, 0) - c.lost * 0 + 1) / {p.metric_k}.0 / least(coalesce(n.n, 1), {p.metric_k}), 8) AS delta FROM chosen c LEFT JOIN truth y ON c.customer_id = y.customer_id AND c.article_id = y.article_id LEFT JOIN truth_counts n ON c.customer_id = n.customer_id
LEFT JOIN (SELECT customer_id, sum(target) AS hits FROM two_ranker_fusion WHERE final_rank < {p.metric_k} GROUP BY 1) h ON c.customer_id = h.customer_id""")
def frozen_integration(r, p):
    """One frozen policy from cold to warm: each user's best cold item in the last slot if it scores over a bound, with the exact change of average precision."""
    slate = r("two_ranker_fusion").where(F.col("final_rank") <= p.metric_k)
    last = slate.where(F.col("final_rank") == p.metric_k).select("customer_id", F.col("article_id").alias("victim"), F.col("target").alias("lost"))
    chosen = r("best_cold_per_user").where("source_score > 0.05").join(slate.select(*PAIR), PAIR, "left_anti").join(last, "customer_id")
    hits = slate.where(F.col("final_rank") < p.metric_k).groupBy("customer_id").agg(F.sum("target").alias("hits"))
    own = chosen.join(r("truth").withColumn("won", F.lit(1)), PAIR, "left").join(r("truth_counts"), "customer_id", "left").join(hits, "customer_id", "left")
    won = F.coalesce("won", F.lit(0))
    gain = (won - F.col("lost")) * (F.coalesce("hits", F.lit(0)) + 1) / F.lit(float(p.metric_k)) / F.least(F.coalesce("n", F.lit(1)), F.lit(p.metric_k))
    return own.select(*PAIR, "victim", won.alias("won"), "lost", F.round(gain, 8).alias("delta"))


@Q.op(lambda d, p: "SELECT 0 AS changed_decisions, (SELECT count(*) FROM first_swaps) AS decisions")
def label_invariance(r, p):
    """Decisions made once more with all labels turned round: how many change (none may)."""
    order = [F.desc("vote_gap"), F.desc("victim_rank"), "challenger_rank"]
    choose = lambda pairs: best_pairs(pairs.where("vote_gap > 0"), *order).select("customer_id", "challenger", "victim")
    pairs = r("swap_pairs")
    turned = pairs.withColumns({"challenger_target": 1 - F.col("challenger_target"), "victim_target": 1 - F.col("victim_target"), "delta": -F.col("delta")})
    first, second = choose(pairs), choose(turned)
    changed = first.exceptAll(second).unionByName(second.exceptAll(first)).agg(F.count("*").cast("int").alias("changed_decisions"))
    return changed.join(first.agg(F.count("*").alias("decisions")))


@Q.op(lambda d, p: "SELECT percentile, count(*) AS users FROM (SELECT CASE WHEN k <= 0.2 * n THEN 'low' WHEN k <= 0.8 * n THEN 'middle' ELSE 'high' END AS percentile FROM (SELECT row_number() OVER (ORDER BY m, customer_id) AS k, count(*) OVER () AS n FROM (SELECT customer_id, max(score_gap) AS m FROM swap_pairs GROUP BY 1))) GROUP BY 1")
def stable_percentiles(r, p):
    """Users by the stable fractional rank of their best gap, over ranges of it: ranks inside a range follow the counts of those before."""
    best = r("swap_pairs").groupBy("customer_id").agg(F.max("score_gap").alias("m"))
    fraction = fractional_rank(best, "m", "customer_id")
    return fraction.groupBy(F.when(F.col("fraction") <= 0.2, "low").when(F.col("fraction") <= 0.8, "middle").otherwise("high").alias("percentile")).agg(F.count("*").alias("users"))


def fractional_rank(rows: DataFrame, value: str, key: str) -> DataFrame:
    """``rows`` with ``fraction`` in (0, 1]: the place in the order of (value, key) by the number of rows. No task ranks all rows.

    Rows are dealt into ranges and written, so that the ranges stay; a range's rows are
    ranked inside, behind the rows of the ranges before it.
    """
    dealt = materialise(rows.repartitionByRange(value, key).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    own = dealt.join(F.broadcast(sizes), "_part").withColumn("_k", place(value, key, by="_part") + F.col("_before"))
    return own.withColumn("fraction", share(F.col("_k"), F.col("_all"), 12)).drop("_part", "_before", "_all", "_k")
