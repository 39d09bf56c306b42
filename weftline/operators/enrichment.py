"""Features joined to pairs: family caches with a fill policy, aggregates for any key set, edges, states of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, share, total

PAIR = ["customer_id", "article_id"]
LEVELS = ("department", "index_group", "colour", "garment_group")


def aggregate_features(keys: DataFrame, r) -> DataFrame:
    """Point-in-time aggregates for any set of (customer_id, article_id): pair, item, user and type counters. Counts default to 0, prices and recencies to null."""
    item = r("item_stats").select("article_id", F.col("e7").alias("item_e7"), F.col("events").alias("item_events"), F.col("buyers").alias("item_buyers"), F.col("avg_price").alias("item_price"), F.col("recency").alias("item_recency"))
    user = r("user_stats").select("customer_id", F.col("events").alias("user_events"), F.col("avg_price").alias("user_price"))
    pair = r("pair_stats").select(*PAIR, F.col("events").alias("pair_events"), F.col("recency").alias("pair_recency"))
    kind = r("typed_recent").groupBy("customer_id", "product_type").agg(F.count("*").alias("type_events"))
    own = keys.join(r("articles").select("article_id", "product_type"), "article_id").join(item, "article_id", "left").join(user, "customer_id", "left")
    own = own.join(pair, PAIR, "left").join(kind, ["customer_id", "product_type"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.select(*keys.columns, *map(zero, ("pair_events", "item_e7", "item_events", "item_buyers", "user_events", "type_events")), "pair_recency", "item_recency", F.round("item_price", 6).alias("item_price"), F.round(F.col("item_price") - F.col("user_price"), 6).alias("price_gap"), share(F.coalesce("type_events", F.lit(0)), F.greatest(F.coalesce("user_events", F.lit(0)), F.lit(1))).alias("type_share"))


def aggregate_sql(keys: str, columns: str) -> str:
    return f"""SELECT {columns}, coalesce(q.events, 0) AS pair_events, coalesce(i.e7, 0) AS item_e7, coalesce(i.events, 0) AS item_events, coalesce(i.buyers, 0) AS item_buyers, coalesce(u.events, 0) AS user_events, coalesce(t.n, 0) AS type_events, q.recency AS pair_recency, i.recency AS item_recency,
round(i.avg_price, 6) AS item_price, round(i.avg_price - u.avg_price, 6) AS price_gap, round(coalesce(t.n, 0) / greatest(coalesce(u.events, 0), 1)::double, 6) AS type_share FROM {keys} k JOIN articles a ON k.article_id = a.article_id LEFT JOIN item_stats i ON k.article_id = i.article_id LEFT JOIN user_stats u ON k.customer_id = u.customer_id
LEFT JOIN pair_stats q ON k.customer_id = q.customer_id AND k.article_id = q.article_id LEFT JOIN (SELECT customer_id, product_type, count(*) AS n FROM typed_recent GROUP BY 1, 2) t ON k.customer_id = t.customer_id AND a.product_type = t.product_type"""


@Q.op(lambda d, p: aggregate_sql("rrf_fused_topk", "k.customer_id, k.article_id, k.candidate_rank"))
def pool_aggregates(r, p):
    """Aggregate features of the pool."""
    return aggregate_features(r("rrf_fused_topk").select(*PAIR, "candidate_rank"), r)


@Q.op(lambda d, p: aggregate_sql("src_item_neighbours", "k.customer_id, k.article_id, k.source_rank"))
def neighbour_aggregates(r, p):
    """The same features for another key set: what the vector retriever found."""
    return aggregate_features(r("src_item_neighbours").select(*PAIR, "source_rank"), r)


def attach(frame: DataFrame, families: dict[str, tuple[DataFrame, list[str]]], fill: dict[str, Column]) -> DataFrame:
    """``frame`` with the columns of each family joined on its keys; what a family lacks takes the value of ``fill``, or stays null."""
    for rows, keys in families.values():
        frame = frame.join(rows, keys, "left")
    return frame.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


@Q.op(lambda d, p: """SELECT f.customer_id, f.article_id, coalesce(i.e28, 0) AS e28, coalesce(i.e84, 0) AS e84, coalesce(u.events, 0) AS events, coalesce(q.events, 0) AS bought, coalesce(g.gap, -1) AS usual_gap, round(i.avg_price / nullif(u.avg_price, 0), 6) AS price_ratio, round(i.avg_price - u.avg_price, 6) AS price_gap, CASE WHEN g.gap > 0 THEN round(q.recency / g.gap, 6) END AS cycle_phase
FROM rrf_fused_topk f LEFT JOIN item_stats i ON f.article_id = i.article_id LEFT JOIN user_stats u ON f.customer_id = u.customer_id LEFT JOIN pair_stats q ON f.customer_id = q.customer_id AND f.article_id = q.article_id LEFT JOIN (SELECT customer_id, round(avg(gap), 4) AS gap FROM user_gaps GROUP BY 1) g ON f.customer_id = g.customer_id""")
def attached_features(r, p):
    """Item, user, pair and rhythm families joined to the pool under one fill policy, with price ratio, price gap and phase of the user's cycle."""
    rhythm = r("user_gaps").groupBy("customer_id").agg(F.round(F.avg("gap"), 4).alias("usual_gap"))
    families = {
        "item": (r("item_stats").select("article_id", "e28", "e84", F.col("avg_price").alias("ip")), ["article_id"]),
        "user": (r("user_stats").select("customer_id", "events", F.col("avg_price").alias("up")), ["customer_id"]),
        "pair": (r("pair_stats").select(*PAIR, F.col("events").alias("bought"), "recency"), PAIR),
        "rhythm": (rhythm, ["customer_id"]),
    }
    zero = F.lit(0)
    own = attach(r("rrf_fused_topk").select(*PAIR), families, {"e28": zero, "e84": zero, "events": zero, "bought": zero, "usual_gap": F.lit(-1.0)})
    phase = F.when(F.col("usual_gap") > 0, F.round(F.col("recency") / F.col("usual_gap"), 6))
    return own.select(*PAIR, "e28", "e84", "events", "bought", "usual_gap", share(F.col("ip"), F.col("up")).alias("price_ratio"), F.round(F.col("ip") - F.col("up"), 6).alias("price_gap"), phase.alias("cycle_phase"))


@Q.op(lambda d, p: " UNION ALL ".join(f"SELECT f.customer_id, f.article_id, '{x}' AS level, coalesce(s.e28, 0) AS e28, coalesce(s.e84, 0) AS e84, round(coalesce(s.e84, 0) / u.events::double, 6) AS part, s.recency FROM rrf_fused_topk f JOIN articles a ON f.article_id = a.article_id LEFT JOIN user_stats u ON f.customer_id = u.customer_id LEFT JOIN (SELECT customer_id, {x} AS v, count(*) FILTER (t_dat >= {d.shift(d.date(p.cutoff), -28)}) AS e28, count(*) FILTER (t_dat >= {d.shift(d.date(p.cutoff), -84)}) AS e84, {d.days('max(t_dat)', d.date(p.cutoff))} AS recency FROM typed_recent GROUP BY 1, 2) s ON f.customer_id = s.customer_id AND a.{x} = s.v" for x in LEVELS))
def hierarchy_affinity(r, p):
    """The user's ties to the candidate's place in four hierarchies: counts of 28 and 84 days, share, recency. One pass over the users' facts for all four."""
    cutoff = F.lit(p.cutoff).cast("date")
    stacked = lambda rows, *more: rows.select(*more, F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).cast("string").alias("v")) for x in LEVELS])).alias("x")).select(*more, "x.level", "x.v")
    since = lambda n: F.count_if(F.col("t_dat") >= F.date_sub(cutoff, n))
    ties = stacked(r("own_typed"), "customer_id", "t_dat").groupBy("customer_id", "level", "v").agg(since(28).alias("e28"), since(84).alias("e84"), F.datediff(cutoff, F.max("t_dat")).cast("long").alias("recency"))
    own = stacked(r("rrf_fused_topk").select(*PAIR).join(r("articles"), "article_id"), *PAIR).join(ties, ["customer_id", "level", "v"], "left").join(r("own_user_stats").select("customer_id", "events"), "customer_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return own.select(*PAIR, "level", zero("e28").alias("e28"), zero("e84").alias("e84"), share(zero("e84"), F.col("events")).alias("part"), "recency")


@Q.op(lambda d, p: "SELECT a.article_id, a.department, a.index_group, a.colour, lower(a.garment_group) AS appearance FROM articles a WHERE a.article_id IN (SELECT article_id FROM rrf_fused_topk)")
def dimension_table(r, p):
    """The dimensions of all articles in the pool."""
    own = r("articles").join(r("rrf_fused_topk").select("article_id"), "article_id", "left_semi")
    return own.select("article_id", "department", "index_group", "colour", F.lower("garment_group").alias("appearance"))


@Q.op(lambda d, p: f"""WITH c AS (SELECT customer_id, article_id, final_rank, final_score, percent_rank() OVER (PARTITION BY customer_id ORDER BY final_score) AS pct FROM two_ranker_fusion)
SELECT x.customer_id, x.article_id, v.article_id AS victim, v.final_rank AS slot, round(x.pct - v.pct, 6) AS pct_gap, round(x.pct * (1 - v.pct), 6) AS product, round(x.final_score - v.final_score, 8) AS score_gap FROM c x JOIN c v ON x.customer_id = v.customer_id AND v.final_rank <= {p.metric_k} AND x.final_rank > {p.metric_k} AND x.final_rank <= {p.metric_k} + 10""")
def edge_features(r, p):
    """Each near challenger against the slots of its user's slate: percentile difference, product, score gap. Ten by twelve edges a user."""
    from pyspark.sql import Window

    pct = F.percent_rank().over(Window.partitionBy("customer_id").orderBy("final_score"))
    c = r("two_ranker_fusion").select(*PAIR, "final_rank", "final_score", pct.alias("pct"))
    slots = c.where(F.col("final_rank") <= p.metric_k).select("customer_id", F.col("article_id").alias("victim"), F.col("final_rank").alias("slot"), F.col("final_score").alias("vs"), F.col("pct").alias("vp"))
    near = c.where((F.col("final_rank") > p.metric_k) & (F.col("final_rank") <= p.metric_k + 10))
    return near.join(slots, "customer_id").select(*PAIR, "victim", "slot", F.round(F.col("pct") - F.col("vp"), 6).alias("pct_gap"), F.round(F.col("pct") * (1 - F.col("vp")), 6).alias("product"), F.round(F.col("final_score") - F.col("vs"), 8).alias("score_gap"))


@Q.op(lambda d, p: "SELECT k.customer_id, k.article_id, coalesce(t.events, 0) AS type_events, t.recency AS type_recency, coalesce(g.events, 0) AS group_events, coalesce(c.events, 0) AS colour_events FROM branch_union k JOIN articles a ON k.article_id = a.article_id " + " ".join(f"LEFT JOIN affinity_long {s} ON k.customer_id = {s}.customer_id AND {s}.dimension = '{x}' AND {s}.value = a.{x}" for s, x in (("t", "product_type"), ("g", "garment_group"), ("c", "colour"))))
def no_decay_affinity(r, p):
    """Undecayed ties of the user to type, group and colour for the union of warm and cold candidates, in one join of the long table."""
    dims = ("product_type", "garment_group", "colour")
    keys = r("branch_union").select(*PAIR).join(r("articles"), "article_id")
    long = keys.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(x).alias("dimension"), F.col(x).alias("value")) for x in dims])).alias("x")).select(*PAIR, "x.*")
    own = long.join(r("affinity_long").select("customer_id", "dimension", "value", "events", "recency"), ["customer_id", "dimension", "value"], "left")
    pick = lambda x, c: F.max(F.when(F.col("dimension") == x, F.col(c)))
    zero = lambda x: F.coalesce(pick(x, "events"), F.lit(0))
    return own.groupBy(*PAIR).agg(zero("product_type").alias("type_events"), pick("product_type", "recency").alias("type_recency"), zero("garment_group").alias("group_events"), zero("colour").alias("colour_events"))


@Q.op(lambda d, p: """SELECT s.customer_id, s.article_id, s.final_rank, round(coalesce(c.cosine, 0), 6) AS best_cosine, coalesce(c.seeds, 0) AS seeds, round(coalesce(c.mean, 0), 6) AS mean_cosine FROM swapped_slate s LEFT JOIN (SELECT customer_id, article_id, max(cosine) AS cosine, count(*) AS seeds, avg(cosine) AS mean FROM seed_neighbours GROUP BY 1, 2) c ON s.customer_id = c.customer_id AND s.article_id = c.article_id WHERE s.final_rank <= 12""")
def dense_pair_features(r, p):
    """Closeness of any pairs (here the final slates) to the user's seeds: best and mean cosine and how many seeds are near; zero where none is."""
    near = r("seed_neighbours").groupBy(*PAIR).agg(F.max("cosine").alias("c"), F.count("*").alias("n"), F.avg("cosine").alias("m"))
    zero = lambda c, n: F.coalesce(F.round(c, 6), F.lit(0.0)).alias(n)
    return r("swapped_slate").where("final_rank <= 12").join(near, PAIR, "left").select(*PAIR, "final_rank", zero("c", "best_cosine"), F.coalesce("n", F.lit(0)).alias("seeds"), zero("m", "mean_cosine"))


STATE_SQL = """SELECT t.customer_id, t.article_id, t.final_rank, t.rank_a, t.rank_b, abs(t.rank_a - t.rank_b) AS rank_gap, round(s.score_a - avg(s.score_a) OVER w, 6) AS centred, round(s.score_a / nullif(max(s.score_a) OVER w, 0), 6) AS to_best, round(t.final_rank / count(*) OVER w::double, 6) AS fraction FROM two_ranker_fusion t JOIN scored s ON t.customer_id = s.customer_id AND t.article_id = s.article_id WINDOW w AS (PARTITION BY t.customer_id)"""


@Q.op(lambda d, p: STATE_SQL)
def ranker_state(r, p):
    """Per candidate the state of both rankings: ranks, their gap, the score against the user's mean and best, rank fraction."""
    own = r("two_ranker_fusion").join(r("scored").select(*PAIR, "score_a"), PAIR)
    a = F.col("score_a")
    return own.select(*PAIR, "final_rank", "rank_a", "rank_b", F.abs(F.col("rank_a") - F.col("rank_b")).alias("rank_gap"), F.round(a - total(F.avg(a)), 6).alias("centred"), share(a, total(F.max(a))).alias("to_best"), share(F.col("final_rank"), total(F.count("*"))).alias("fraction"))


@Q.op(lambda d, p: f"SELECT s.*, k.pair_events, k.item_events, k.type_share, coalesce(k.pair_recency, -1) AS pair_recency, CASE WHEN k.pair_recency IS NULL THEN 1 ELSE 0 END AS never_bought, coalesce(c.cosine, 0) AS cosine FROM ({STATE_SQL}) s JOIN ({aggregate_sql('rrf_fused_topk', 'k.customer_id, k.article_id')}) k ON s.customer_id = k.customer_id AND s.article_id = k.article_id LEFT JOIN (SELECT customer_id, article_id, max(cosine) AS cosine FROM seed_neighbours GROUP BY 1, 2) c ON s.customer_id = c.customer_id AND s.article_id = c.article_id WHERE s.final_rank <= 50")
def rich_candidates(r, p):
    """The first fifty of each user with states, aggregates and closeness side by side; missing values are -1 with a flag, or 0, by column."""
    more = aggregate_features(r("rrf_fused_topk").select(*PAIR), r).select(*PAIR, "pair_events", "item_events", "type_share", "pair_recency")
    near = r("seed_neighbours").groupBy(*PAIR).agg(F.max("cosine").alias("cosine"))
    own = ranker_state(r, p).where("final_rank <= 50").join(more, PAIR).join(near, PAIR, "left")
    return own.withColumns({"never_bought": F.col("pair_recency").isNull().cast("int"), "pair_recency": F.coalesce("pair_recency", F.lit(-1)), "cosine": F.coalesce("cosine", F.lit(0.0))})


@Q.op(lambda d, p: "SELECT s.customer_id, s.challenger, s.victim, " + ", ".join(f"coalesce(c.{x}, 0) - coalesce(v.{x}, 0) AS {x}_gap" for x in ("item_events", "pair_events", "type_events")) + ", round(c.type_share - v.type_share, 5) AS share_gap FROM swap_pairs s " + " ".join(f"JOIN ({aggregate_sql('rrf_fused_topk', 'k.customer_id, k.article_id')}) {t} ON s.customer_id = {t}.customer_id AND s.{k} = {t}.article_id" for t, k in (("c", "challenger"), ("v", "victim"))))
def affinity_deltas(r, p):
    """Differences of user-item features between challenger and victim of each pair."""
    names = ("item_events", "pair_events", "type_events", "type_share")
    every = aggregate_features(r("rrf_fused_topk").select(*PAIR), r).select(*PAIR, *names)
    side = lambda key: every.select("customer_id", F.col("article_id").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in names])
    own = r("swap_pairs").select("customer_id", "challenger", "victim").join(side("challenger"), ["customer_id", "challenger"]).join(side("victim"), ["customer_id", "victim"])
    gap = lambda c: F.col(f"challenger_{c}") - F.col(f"victim_{c}")
    return own.select("customer_id", "challenger", "victim", *[gap(c).alias(f"{c}_gap") for c in names[:3]], F.round(gap("type_share"), 5).alias("share_gap"))


@Q.op(lambda d, p: f"""SELECT t.customer_id, count(*) AS pool, count(*) FILTER (t.rank_a <= {p.metric_k} AND t.rank_b <= {p.metric_k}) AS overlap, round(stddev_pop(s.score_a), 6) AS sigma_a, round(stddev_pop(s.score_b), 6) AS sigma_b, round(corr(t.rank_a::double, t.rank_b::double), 5) AS rank_corr, count(*) FILTER (t.target <> s.target) AS mismatches FROM two_ranker_fusion t JOIN scored s ON t.customer_id = s.customer_id AND t.article_id = s.article_id GROUP BY 1""")
def user_meta_table(r, p):
    """One row a user on both models' predictions: joined with a check that nothing is lost or changed, overlap of slates, spread of scores, rank correlation."""
    own = r("two_ranker_fusion").join(r("scored").select(*PAIR, "score_a", "score_b", F.col("target").alias("other")), PAIR)
    inside = (F.col("rank_a") <= p.metric_k) & (F.col("rank_b") <= p.metric_k)
    sigma = lambda c: F.round(F.stddev_pop(c), 6)
    corr = F.round(F.corr(F.col("rank_a").cast("double"), F.col("rank_b").cast("double")), 5)
    return own.groupBy("customer_id").agg(F.count("*").alias("pool"), F.count_if(inside).alias("overlap"), sigma("score_a").alias("sigma_a"), sigma("score_b").alias("sigma_b"), corr.alias("rank_corr"), F.count_if(F.col("target") != F.col("other")).alias("mismatches"))


@Q.op(lambda d, p: "WITH g AS (SELECT customer_id FROM scored GROUP BY 1 HAVING 0 < sum(target) AND sum(target) < count(*)) SELECT s.customer_id, s.article_id, s.target, s.candidate_rank FROM scored s JOIN g ON s.customer_id = g.customer_id WHERE s.target = 1 OR s.candidate_rank <= 20")
def hard_pair_input(r, p):
    """Positives and the first twenty of each user that has both positives and negatives."""
    mixed = r("scored").groupBy("customer_id").agg(F.sum("target").alias("t"), F.count("*").alias("n")).where("0 < t AND t < n")
    return r("scored").join(mixed, "customer_id", "left_semi").where("target = 1 OR candidate_rank <= 20").select(*PAIR, "target", "candidate_rank")


@Q.op(lambda d, p: "SELECT customer_id, article_id, target, layer FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, layer, target ORDER BY candidate_rank, article_id) AS k FROM (SELECT *, CASE WHEN candidate_rank <= 12 THEN 'head' WHEN candidate_rank <= 36 THEN 'middle' ELSE 'tail' END AS layer FROM scored)) WHERE target = 1 OR k <= CASE layer WHEN 'head' THEN 6 WHEN 'middle' THEN 3 ELSE 2 END")
def layered_sample(r, p):
    """All positives and a quota of negatives from each layer of the pool."""
    rank = F.col("candidate_rank")
    layer = F.when(rank <= 12, "head").when(rank <= 36, "middle").otherwise("tail")
    quota = F.when(F.col("layer") == "head", 6).when(F.col("layer") == "middle", 3).otherwise(2)
    own = r("scored").withColumn("layer", layer).withColumn("k", place("candidate_rank", "article_id", by=["customer_id", "layer", "target"]))
    return own.where((F.col("target") == 1) | (F.col("k") <= quota)).select(*PAIR, "target", "layer")


@Q.op(lambda d, p: """WITH n AS (SELECT s.*, count(*) FILTER (s.target = 1 AND c.article_id IS NOT NULL) OVER (PARTITION BY s.customer_id) AS cold_hits, c.article_id IS NOT NULL AS cold FROM scored s LEFT JOIN cold_items c ON s.article_id = c.article_id WHERE s.customer_id IN (SELECT customer_id FROM truth)),
q AS (SELECT *, CASE WHEN cold_hits > 0 THEN 8 ELSE 4 END AS quota, CASE WHEN target = 0 THEN row_number() OVER (PARTITION BY customer_id, target ORDER BY cold DESC, candidate_rank) END AS k FROM n) SELECT customer_id, article_id, target, quota FROM q WHERE target = 1 OR k <= quota""")
def conditional_quota(r, p):
    """Negatives by a quota that depends on whether the user bought a cold item; cold negatives first, the rest fills up by rank."""
    cold = r("cold_items").select("article_id", F.lit(1).alias("c"))
    own = r("scored").join(r("truth").select("customer_id").distinct(), "customer_id", "left_semi").join(cold, "article_id", "left").withColumn("cold", F.col("c").isNotNull())
    own = own.withColumn("hits", total(F.count_if((F.col("target") == 1) & F.col("cold")))).withColumn("quota", F.when(F.col("hits") > 0, 8).otherwise(4))
    own = own.withColumn("k", place(F.desc("cold"), "candidate_rank", by=["customer_id", "target"]))
    return own.where((F.col("target") == 1) | (F.col("k") <= F.col("quota"))).select(*PAIR, "target", "quota")


@Q.op(lambda d, p: "SELECT customer_id, article_id, target, score_a FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_a DESC, article_id) AS k FROM scored) WHERE target = 1 OR k <= 10")
def hard_rows(r, p):
    """Positives and the rows that the first stage ranks highest."""
    return r("scored").withColumn("k", place(F.desc("score_a"), "article_id")).where("target = 1 OR k <= 10").select(*PAIR, "target", "score_a")


TRIPLET = "md5(concat({}, '-', {}))"


@Q.op(lambda d, p: f"""WITH pos AS (SELECT anchor, neighbour AS positive, neighbour_rank FROM item_knn WHERE neighbour_rank <= 5), near AS (SELECT anchor, neighbour FROM item_knn),
pick AS (SELECT x.anchor, x.positive, a.article_id AS negative, CASE WHEN a.product_type = o.product_type THEN 1 ELSE 2 END AS level, row_number() OVER (PARTITION BY x.anchor, x.positive ORDER BY CASE WHEN a.product_type = o.product_type THEN 1 ELSE 2 END, md5(concat(x.positive::varchar, '-', a.article_id::varchar)), a.article_id) AS k
FROM pos x JOIN articles o ON x.anchor = o.article_id JOIN articles a ON (a.product_type = o.product_type OR a.garment_group = o.garment_group AND a.index_group = o.index_group) AND a.article_id <> x.anchor WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.anchor = x.anchor AND n.neighbour = a.article_id))
SELECT anchor, positive, negative, level FROM pick WHERE k = 1""")
def hard_triplets(r, p):
    """(anchor, near positive, salted hard negative): an item of the anchor's type, or else of its group, that is not among its neighbours."""
    near = r("item_knn").select("anchor", "neighbour", "neighbour_rank")
    positive = near.where("neighbour_rank <= 5").select("anchor", F.col("neighbour").alias("positive"))
    kinds = r("articles").select(F.col("article_id").alias("anchor"), "product_type", "garment_group", "index_group")
    other = r("articles").select(F.col("article_id").alias("negative"), "product_type", "garment_group", "index_group")
    anchors = positive.select("anchor").distinct().join(kinds, "anchor")
    # two equi-joins instead of one join under OR; what both find counts at the closer level
    same = anchors.join(other, "product_type").select("anchor", "negative", F.lit(1).alias("level"))
    group = anchors.join(other, ["garment_group", "index_group"]).select("anchor", "negative", F.lit(2).alias("level"))
    hard = same.unionByName(group).where("anchor <> negative").groupBy("anchor", "negative").agg(F.min("level").alias("level")).join(near.select("anchor", F.col("neighbour").alias("negative")), ["anchor", "negative"], "left_anti")
    salt = F.md5(F.concat(F.col("positive").cast("string"), F.lit("-"), F.col("negative").cast("string")))
    return positive.join(hard, "anchor").withColumn("k", place("level", salt, "negative", by=["anchor", "positive"])).where("k = 1").select("anchor", "positive", "negative", "level")
