"""Whole-table orders and statistics without a task that holds the table.

Rows are dealt into ranges of their order and written, so that the ranges stay. Counts
and sums of the ranges (one row each) are summed over the ranges before; ranks and
running sums inside a range start from there. Equal keys always share a range.

The functions below replace single-partition forms in Spark; the declared relations of
the same names stay as the reference.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, rounded, share, total
from ..plans.graph import GRAPH, together
from ..storage import materialise

PAIR = ["customer_id", "article_id"]


def declared(name: str):
    """The declared SQL of a query as the reference of its distributed form; the name stays known to the graph."""
    return lambda d, p: f"SELECT * FROM {name}"


def ranges(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """``rows`` dealt into ranges of ``keys``, with the number of the range."""
    return materialise(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")


def before(dealt: DataFrame, **sums: Column) -> DataFrame:
    """``dealt`` with the sum of each expression over the ranges before (as named) and over all rows (``all_`` before the name)."""
    each = dealt.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    tops = each.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(Window.partitionBy()).alias(f"all_{n}") for n in sums])
    return dealt.join(F.broadcast(tops), "_part")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with their place ``k`` in the whole order and their number ``n``."""
    own = before(ranges(rows, *order), _c=F.lit(1))
    return own.withColumn("k", place(*order, by="_part") + F.col("_c")).withColumnRenamed("all__c", "n").drop("_part", "_c")


def tile(k: Column, n: Column, tiles: int) -> Column:
    """The tile of the k-th of n rows: the first n mod tiles ones hold one row more."""
    small, large = F.floor(n / tiles), F.pmod(n, F.lit(tiles))
    edge = large * (small + 1)
    return F.when(k <= edge, F.ceil(k / (small + 1))).otherwise(large + F.ceil((k - edge) / F.greatest(small, F.lit(1)))).cast("long")


def quantiles(rows: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """One row: interpolated quantiles of a column, from the rows at the places beside each."""
    own = numbered(rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL"), "v")
    out = []
    for name, q in points.items():
        at = F.lit(q) * (F.col("n") - 1) + 1
        weight = F.greatest(1 - F.abs(at - F.col("k")), F.lit(0.0))
        out.append(F.sum(F.when(weight > 0, weight * F.col("v"))).alias(name))
    return own.agg(*out)


@Q.op(declared("item_popularity_deciles"))
def item_popularity_deciles(r, p):
    """Items of the history window in deciles by events: head, mid and tail."""
    own = numbered(r("recent").groupBy("article_id").agg(F.count("*").alias("events")), F.desc("events"), "article_id")
    own = own.select("article_id", "events", tile(F.col("k"), F.col("n"), 10).alias("decile"))
    return own.withColumn("band", F.when(F.col("decile") == 1, "head").when(F.col("decile") <= 5, "mid").otherwise("tail"))


@Q.op(declared("sales_concentration"))
def sales_concentration(r, p):
    """Share of events of the top 1, 5, 10 and 50 percent of items."""
    own = numbered(r("tx").groupBy("article_id").agg(F.count("*").alias("events")), F.desc("events"), "article_id")
    top = lambda q: F.sum(F.when(F.col("k") <= F.ceil(F.col("n") * q), F.col("events")).otherwise(0))
    return own.agg(*[share(top(F.lit(q).cast("decimal(3,2)")), F.sum("events")).alias(f"top_{round(q * 100)}") for q in (0.01, 0.05, 0.10, 0.50)])


@Q.op(declared("discrimination"))
def discrimination(r, p):
    """Area under the ROC curve with half ties, correlation of score and target, positives; over the histogram of scores."""
    scored = r("scored").select("score_a", "target")
    bins = scored.groupBy("score_a").agg(F.sum("target").alias("pos"), F.count("*").alias("n"))
    own = before(ranges(bins, "score_a"), lower=F.col("n") - F.col("pos"), hits=F.col("pos"))
    inside = Window.partitionBy("_part").orderBy("score_a").rowsBetween(Window.unboundedPreceding, -1)
    negatives = F.col("lower") + F.coalesce(F.sum(F.col("n") - F.col("pos")).over(inside), F.lit(0))
    won = F.col("pos") * (negatives + (F.col("n") - F.col("pos")) / F.lit(2.0))
    area = own.select(won.alias("won"), "all_lower", "all_hits").agg((F.sum("won") / (F.max("all_hits") * F.max("all_lower").cast("double"))).alias("a"))
    whole = scored.agg(F.round(F.corr("score_a", F.col("target").cast("double")), 6).alias("pearson"), F.sum("target").alias("positives"))
    return area.join(whole).select(F.round("a", 8).alias("auc"), "pearson", "positives")  # one row each


def score_bins(r) -> DataFrame:
    own = numbered(r("scored").select(*PAIR, "score_a", "target"), "score_a", *PAIR)
    return own.withColumn("bin", tile(F.col("k"), F.col("n"), 10))


@Q.op(declared("reliability"))
def reliability(r, p):
    """Mean score and rate of positives per score decile."""
    return score_bins(r).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score_a"), 6).alias("mean_score"), F.round(F.avg(F.col("target").cast("double")), 6).alias("rate"))


@Q.op(declared("calibration_error"))
def calibration_error(r, p):
    """Expected calibration error over score deciles, Brier score and log loss, the score (at most 1) read as a probability."""
    chance = F.least("score_a", F.lit(1.0))
    safe = F.least(F.greatest(chance, F.lit(0.000001)), F.lit(0.999999))
    loss = -F.sum(F.when(F.col("target") == 1, F.ln(safe)).otherwise(F.ln(1 - safe)))
    bins = score_bins(r).groupBy("bin").agg(F.count("*").alias("c"), F.avg(chance).alias("m"), F.avg(F.col("target").cast("double")).alias("rate"), F.sum((chance - F.col("target")) ** 2).alias("b"), loss.alias("l"))
    mean = lambda c: F.round(F.sum(c) / F.sum("c"), 6)
    return bins.agg(mean(F.abs(F.col("m") - F.col("rate")) * F.col("c")).alias("ece"), mean(F.col("b")).alias("brier"), mean(F.col("l")).alias("log_loss"), F.sum("c").alias("n"))


@Q.op(declared("midrank_gate"))
def midrank_gate(r, p):
    """Users whose best challenger lies in the top fifth by average-tie percentile of its score."""
    best = r("swap_pairs").withColumn("rn", place(F.desc("score_gap"), "challenger", "victim")).where("rn = 1").select("customer_id", "challenger", "score_gap")
    own = before(ranges(best, "score_gap"), c=F.lit(1))
    below = F.rank().over(Window.partitionBy("_part").orderBy("score_gap")) - 1 + F.col("c")
    middle = (below + (F.count("*").over(Window.partitionBy("_part", "score_gap")) + 1) / F.lit(2.0)) / F.col("all_c")
    return own.select("customer_id", "challenger", middle.alias("m")).where("m > 0.8").select("customer_id", "challenger", F.round("m", 6).alias("percentile"))


@Q.op(declared("quota_admission"))
def quota_admission(r, p):
    """The best cold item of each user into the last slot, for the fifth of users where it scores highest."""
    own = numbered(r("best_cold_per_user"), F.desc("source_score"), "customer_id").where(F.col("k") <= F.ceil(F.col("n") * F.lit(0.2).cast("decimal(2,1)")))
    last = r("two_ranker_fusion").where(F.col("final_rank") == p.metric_k).select("customer_id", F.col("article_id").alias("victim"))
    return own.join(last, "customer_id").select("customer_id", "article_id", "victim")


@Q.op(declared("edge_stats"))
def edge_stats(r, p):
    """Entropy, concentration, self-loops and reciprocity of the transition graph, by aggregates of the edges."""
    edges = r("basket_transitions")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    whole = edges.agg(F.sum("weight").alias("whole"))  # one row
    own = edges.join(back, ["src", "dst"], "left").join(F.broadcast(whole)).withColumn("w", F.col("weight") / F.col("whole"))
    loop = F.col("src") == F.col("dst")
    return own.agg(
        F.count("*").alias("edges"), F.round(-F.sum(F.col("w") * F.ln("w")), 5).alias("entropy"), F.round(F.sum(F.col("w") ** 2), 8).alias("hhi"), F.round(F.max("w"), 8).alias("top_share"),
        F.round(F.sum(F.when(loop, F.col("w")).otherwise(0)), 6).alias("self_share"), F.count_if(F.col("back").isNotNull() & ~loop).alias("reciprocal_edges"),
    )


@Q.op(declared("out_degrees"))
def out_degrees(r, p):
    """Quantiles of out-degrees and the mean directional entropy."""
    edges = r("basket_transitions").groupBy("src").agg(F.count("*").alias("degree"), F.sum("weight").alias("s"), F.sum(F.col("weight") * F.ln("weight")).alias("wl"))
    own = edges.select("src", "degree", (F.ln("s") - F.col("wl") / F.col("s")).alias("entropy"))  # -sum(w/s ln(w/s))
    whole = own.agg(F.count("*").alias("sources"), F.max("degree").alias("most"), F.round(F.avg("entropy"), 6).alias("mean_entropy"))
    return whole.join(quantiles(own, "degree", {"p50": 0.5, "p90": 0.9})).select("sources", "p50", "p90", "most", "mean_entropy")  # one row each


@Q.op(lambda d, p: "SELECT count(*) AS users, bit_xor(('0x' || substr(md5(customer_id::varchar), 1, 15))::bigint) AS digest, sum(('0x' || substr(md5(customer_id::varchar), 16, 6))::bigint)::bigint AS total FROM users")
def population_fingerprint(r, p):
    """Digests of the set of user ids that do not depend on order: the exclusive or and the sum of each id's md5 parts."""
    part = lambda a, n: F.conv(F.substring(F.md5(F.col("customer_id").cast("string")), a, n), 16, 10).cast("long")
    return r("users").agg(F.count("*").alias("users"), F.bit_xor(part(1, 15)).alias("digest"), F.sum(part(16, 6)).alias("total"))


@Q.op(lambda d, p: f"SELECT t.*, coalesce(e.extra, 0) AS exact_duplicates FROM dataset_profile t, (SELECT sum(n - 1)::bigint AS extra FROM (SELECT count(*) AS n FROM tx GROUP BY ALL))e".replace("FROM tx GROUP BY ALL", "FROM tx GROUP BY t_dat, customer_id, article_id, price, channel"))
def dataset_profile(r, p):
    """Rows, users, items, days, exact duplicates, density, price quantiles and channel share; distinct counts one by one, quantiles by ranges."""
    tx = r("tx")
    different = lambda c, n: tx.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count("*").alias(n))
    out = tx.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.when(F.col("channel") == 1, 1.0).otherwise(0.0)), 6).alias("channel_one"))
    extra = tx.groupBy(*tx.columns).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("exact_duplicates"))
    for one in (different("customer_id", "n_users"), different("article_id", "n_items"), different("t_dat", "n_days"), extra, quantiles(tx, "price", {"p25": 0.25, "p50": 0.5, "p75": 0.75})):
        out = out.join(one)  # one row each
    density = F.round(F.col("n_rows") / (F.col("n_users").cast("double") * F.col("n_items")), 8).alias("density")
    return out.select("n_rows", "n_users", "n_items", "n_days", density, *[F.round(c, 3).alias(c) for c in ("p25", "p50", "p75")], "channel_one", F.coalesce("exact_duplicates", F.lit(0)).alias("exact_duplicates"))


def pool_quality(pools: DataFrame, truth: DataFrame, key: str, k: int) -> DataFrame:
    """Recall, hit rate and oracle MAP of many pools in one pass; from distinct (key, pair)."""
    counts = truth.groupBy("customer_id").agg(F.count("*").alias("n"))
    hits = pools.join(truth, PAIR, "left_semi").groupBy(key, "customer_id").agg(F.count("*").alias("hits")).join(counts, "customer_id")
    whole = counts.agg(F.count("*").alias("users"))
    recall, oracle = F.col("hits") / F.col("n").cast("double"), F.least("hits", F.lit(k)) / F.least("n", F.lit(k)).cast("double")
    sums = hits.groupBy(key).agg(F.sum(recall).alias("r"), F.count("*").alias("h"), F.sum(oracle).alias("o"))
    mean = lambda c, n: F.round(F.col(c) / F.col("users").cast("double"), 8).alias(n)
    return sums.join(F.broadcast(whole)).select(key, "users", mean("r", "recall"), mean("h", "hit_rate"), mean("o", "oracle_map"))


@Q.op(declared("source_metrics"))
def source_metrics(r, p):
    """Recall, hit rate and oracle MAP of every source, one pass over the long candidates; a source without a hit has zeros."""
    found = pool_quality(r("candidates_long").select("source", *PAIR), r("truth"), "source", p.metric_k)
    every = r("candidates_long").select("source").distinct().join(F.broadcast(r("truth_counts").agg(F.count("*").alias("users"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return every.join(found.drop("users"), "source", "left").select("source", "users", zero("recall"), zero("hit_rate"), zero("oracle_map"))


@Q.op(declared("candidate_metrics"))
def candidate_metrics(r, p):
    """The same of the pool at three depths, in one pass: a row counts at every depth that reaches it."""
    depths = F.explode(F.filter(F.array(*[F.lit(k) for k in (12, 30, 60)]), lambda k: F.col("candidate_rank") <= k))
    return pool_quality(r("rrf_fused_topk").select(*PAIR, depths.alias("depth")), r("truth"), "depth", p.metric_k)


@Q.op(declared("candidate_context"))
def candidate_context(r, p):
    """Rank fraction and strength share of the user's own events within the pool; pool and events are dealt out once, by user."""
    signals = r("own_recent").where("article_id IS NOT NULL").groupBy(*PAIR).agg(F.count("*").alias("events"))
    both = r("rrf_fused_topk").select(*PAIR, F.lit(True).alias("kept"), F.lit(0).cast("long").alias("events")).unionByName(signals.withColumn("kept", F.lit(False)))
    own = dealt(both, "customer_id").groupBy(*PAIR).agg(F.max("kept").alias("kept"), F.sum("events").alias("signal")).where("kept")
    own = own.withColumns({"total": total(F.sum("signal")).cast("double"), "n": total(F.count("*")), "rank": F.rank().over(Window.partitionBy("customer_id").orderBy(F.desc("signal")))})
    some = lambda c: F.when(F.col("total") > 0, rounded(c, 6))
    return own.select(*PAIR, some(F.col("rank").cast("double") / F.col("n")).alias("rank_fraction"), some(F.col("signal") / F.col("total")).alias("strength_share"))


@Q.op(declared("leave_one_source_out"))
def leave_one_source_out(r, p):
    """Pool recall when each source is left out of the fusion, in one pass over the candidates."""
    from .fusion import SOURCES

    others = F.explode(F.array_except(F.array(*[F.lit(s) for s in SOURCES]), F.array("source"))).alias("without")
    scores = r("candidates_long").select(*PAIR, "source_rank", others).groupBy("without", *PAIR).agg(F.round(F.sum(1 / (F.lit(float(p.rrf)) + F.col("source_rank"))), 10).alias("score"))
    pools = scores.withColumn("rk", place(F.desc("score"), "article_id", by=["without", "customer_id"])).where(F.col("rk") <= p.candidate_k)
    return pool_quality(pools.select("without", *PAIR), r("truth"), "without", p.metric_k).select("without", "recall")


#: bits of a sieve, whatever the number of keys
SIEVE = 1 << 24


def sifted(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in the one column of ``keys``, before they are dealt out; every row of a key stays. The bitmap of the keys' hashes is fixed in size."""
    slot = lambda c: f"pmod(xxhash64({c}), {SIEVE})"
    key = keys.columns[0]
    words = keys.where(F.col(key).isNotNull()).select(F.expr(f"{slot(key)} div 64").alias("_word"), F.expr(f"shiftleft(1L, cast({slot(key)} % 64 as int))").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", F.expr(f"{slot(column)} div 64")).join(F.broadcast(words), "_word")
    return met.where(F.expr(f"shiftright(_bits, cast({slot(column)} % 64 as int)) & 1L") == 1).select(*rows.columns)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys`` into as many parts as a shuffle has, however few bytes they are: for rows that become many more."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def aged(days: float, day: str, p) -> Column:
    """Half-life decay of a day up to the cutoff."""
    return F.pow(F.lit(2.0), -F.datediff(F.lit(p.cutoff).cast("date"), day) / F.lit(days))


def first(scored: DataFrame, k: int) -> DataFrame:
    """The first k rows (customer_id, article_id, last_day, source_score) of each user, as `retrieval.ranked` has them."""
    own = scored.withColumn("source_rank", place(F.desc("source_score"), F.desc("last_day"), "article_id"))
    return own.where(F.col("source_rank") <= k).select(*PAIR, "source_rank", "source_score")


def late_events(r, p) -> DataFrame:
    """The relation late: lines whose order is not of these days go before the join."""
    cutoff = F.lit(p.cutoff).cast("date")
    orders = r("dated_orders").where((F.col("t_dat") >= F.date_sub(cutoff, p.history_days)) & (F.col("t_dat") < F.date_add(cutoff, p.label_days)))
    out = sifted(r("order_lines"), "order_id", orders.select("order_id")).join(orders.hint("shuffle_hash"), "order_id")  # the lines, of which there are more, need no sort
    if p.hidden:
        out = out.where((F.col("article_id") % p.hidden != 0) | (F.col("t_dat") >= cutoff))
    return out.select("t_dat", *PAIR, "price", "channel")


def basket_lists(r, p) -> DataFrame:
    """The relation baskets, each as one row (customer_id, t_dat, items, blanks): its items, and the number of rows without one."""
    start = F.date_sub(F.lit(p.cutoff).cast("date"), p.covisit_days)
    day = ["customer_id", "t_dat"]
    rows = r("recent" if p.covisit_days <= p.history_days else "history").where(F.col("t_dat") >= start).where("customer_id IS NOT NULL").select(*day, "article_id")
    own = rows.repartition(*day).groupBy(*day).agg(F.array_distinct(F.collect_list("article_id")).alias("items"), F.max(F.col("article_id").isNull().cast("int")).alias("blanks"))
    return own.where((F.size("items") + F.col("blanks")).between(2, p.basket_cap))


def day_baskets(r, p) -> DataFrame:
    """The relation baskets."""
    every = F.transform(F.sequence(F.lit(0), F.size("items") + F.col("blanks") - 1), lambda i: F.get("items", i))
    return r("basket_lists").select("customer_id", "t_dat", F.explode(every).alias("article_id"))


def edges_bought(r, p, asked: DataFrame | None = None) -> DataFrame:
    """The relation covisit_edges, of the items ``asked`` (one column, article_id) or of all: lists without an asked item form no pairs, and pairs meet the counts of their items where these are formed."""
    rows = r("basket_lists").select("items", F.explode("items").alias("src"))
    counts = rows.groupBy(F.col("src").alias("article_id")).agg(F.count("*").alias("n"))
    if asked is not None:
        asked = asked.distinct()
        rows = sifted(rows, "src", asked)
    pairs = rows.select("src", F.explode("items").alias("dst")).where("src <> dst")
    pairs = pairs.join(counts.select(F.col("article_id").alias("dst"), F.col("n").alias("n_dst")), "dst")
    edges = pairs.repartition("src").groupBy("src", "dst").agg(F.count("*").alias("pairs"), F.min("n_dst").alias("n_dst")).where(F.col("pairs") >= p.min_pairs)
    if asked is not None:
        counts = counts.join(asked, "article_id", "left_semi")
    edges = edges.join(counts.select(F.col("article_id").alias("src"), F.col("n").alias("n_src")), "src")
    return edges.select("src", "dst", "pairs", rounded(F.col("pairs") / F.sqrt(F.col("n_src").cast("double") * F.col("n_dst")), 8).alias("similarity"))


def bought_together(r, p, asked: DataFrame | None = None) -> DataFrame:
    """The relation covisit_neighbors, of the items ``asked`` or of all."""
    edges = edges_bought(r, p, asked)
    return edges.withColumn("neighbour_rank", place(F.desc("similarity"), F.desc("pairs"), "dst", by="src")).where(F.col("neighbour_rank") <= p.neighbours)


def exact_sum(column: Column) -> Column:
    """The sum of doubles from 0 to 1, free of row order: whole numbers of 2^-40 and of 2^-80 are added."""
    unit = 2.0**40
    large = F.floor(column * unit)
    small = F.floor((column * unit - large) * unit)
    return (F.sum(large).cast("double") + F.sum(small).cast("double") / unit) / unit


def repurchase_source(r, p) -> DataFrame:
    """The relation src_repurchase over the users' own events."""
    own = r("own_recent").groupBy(*PAIR).agg(F.max("t_dat").alias("last_day"), F.count("*").alias("n"))
    return first(own.select(*PAIR, "last_day", rounded(aged(14, "last_day", p) * (1 + F.ln("n")), 8).alias("source_score")), p.source_k)


def covisit_source(r, p) -> DataFrame:
    """The relation src_covisit: neighbours are sought for the users' own items only."""
    seeds = r("own_recent").groupBy(*PAIR).agg(F.max("t_dat").alias("last_day")).withColumn("strength", aged(14, "last_day", p))
    near = bought_together(r, p, r("own_recent").select("article_id")).select("src", "dst", "similarity")
    score = exact_sum(F.col("strength") * F.col("similarity"))
    met = dealt(seeds.withColumnRenamed("article_id", "src").join(near, "src"), "customer_id")
    return first(met.groupBy("customer_id", F.col("dst").alias("article_id")).agg(F.max("last_day").alias("last_day"), rounded(score, 8).alias("source_score")), p.source_k)


def unsold_items(r, p) -> DataFrame:
    """The relation cold_items: of the whole history only the lines of articles that did not sell in the popularity window are joined."""
    doubt = materialise(r("articles").join(r("popularity").select("article_id"), "article_id", "left_anti").select(*r("articles").columns), "doubtful-articles")
    lines = r("order_lines").select("order_id", "article_id")
    lines = lines.where(F.col("article_id") % p.hidden != 0) if p.hidden else lines  # those sell after the cutoff only
    lines = materialise(sifted(lines, "article_id", doubt.select("article_id")), "doubtful-lines")
    before_cutoff = r("dated_orders").where(F.col("t_dat") < F.lit(p.cutoff).cast("date")).select("order_id")
    sold = sifted(before_cutoff, "order_id", lines.select("order_id")).join(lines, "order_id").select("article_id")
    return doubt.join(sold, "article_id", "left_anti").select(*doubt.columns)


def popular_source(r, p) -> DataFrame:
    """The relation src_recent_popularity: users are dealt out before they meet the top list."""
    top = r("top_popular").select("article_id", "source_rank", F.col("popularity").alias("source_score"))
    return dealt(r("users"), "customer_id").crossJoin(F.broadcast(top)).select(*PAIR, "source_rank", "source_score")


def segment_source(r, p) -> DataFrame:
    """The relation src_segment_popularity: the buckets' top lists are written, and users are dealt out before they meet them."""
    start = F.date_sub(F.lit(p.cutoff).cast("date"), p.popular_days)
    sold = r("recent" if p.popular_days <= p.history_days else "history").where(F.col("t_dat") >= start).select("t_dat", *PAIR)

    def tops(rows: DataFrame) -> DataFrame:
        scores = rows.join(r("user_bucket"), "customer_id").groupBy("bucket", "article_id").agg(rounded(F.sum(aged(7, "t_dat", p)), 8).alias("source_score"))
        return scores.withColumn("source_rank", place(F.desc("source_score"), "article_id", by="bucket")).where(F.col("source_rank") <= p.source_k)

    # the last week alone bounds each bucket's last place from below, and an item's popularity, times a customer's rows, bounds its scores from above
    least = tops(sold.where(F.col("t_dat") >= F.date_sub(F.lit(p.cutoff).cast("date"), 7))).where(F.col("source_rank") == p.source_k)
    least = least.agg(F.count("*").alias("full"), F.min("source_score").alias("bound"))
    homes = r("user_bucket").groupBy("customer_id", "bucket").agg(F.count("*").alias("rows"))
    bound = least.join(r("user_bucket").select("bucket").distinct().agg(F.count("*").alias("buckets"))).join(homes.agg(F.max("rows").alias("rows")))  # one row each
    able = materialise(r("popularity").join(F.broadcast(bound)).where((F.col("full") < F.col("buckets")) | ((F.col("popularity") + CELL) * F.col("rows") >= F.col("bound") - CELL)).select("article_id"), "segment-able")
    sold = sifted(sold, "article_id", able).unionByName(sold.where("article_id IS NULL"))
    top = materialise(tops(sold), "segment-top")
    own = sifted(r("user_bucket"), "customer_id", r("users")).join(r("users"), "customer_id")
    return dealt(own, "customer_id").join(F.broadcast(top), "bucket").select(*PAIR, "source_rank", "source_score")


def attribute_source(r, p) -> DataFrame:
    """The relation src_attribute_content: the pools, bounded by the numbers of types and groups, go to the users' seeds."""
    shared = ("index_group", "department", "colour")
    popular = r("popular_articles")
    own = r("own_recent").groupBy(*PAIR).agg(F.max("t_dat").alias("last_day"), F.count("*").alias("n"))
    own = own.withColumn("strength", rounded(aged(21, "last_day", p) * (1 + F.ln("n")), 8)).withColumn("rn", place(F.desc("strength"), F.desc("last_day"), "article_id")).where(F.col("rn") <= p.content_seeds)
    seeds = own.drop("n", "rn").join(sifted(r("articles"), "article_id", r("own_recent").select("article_id")), "article_id").drop("article_id", "product_code")
    seeds = dealt(seeds, "customer_id")

    def lane(key: str, k: int, base: float) -> DataFrame:
        pool = popular.where(F.col(key).isNotNull()).withColumn("at", place(F.desc("popularity"), "article_id", by=key)).where(F.col("at") <= k)
        pool = materialise(pool.select(key, "article_id", "popularity", *[F.col(c).alias(f"c_{c}") for c in shared]), "attribute-pool")
        bonus = reduce(lambda sum_, c: sum_ + F.when(F.col(c) == F.col(f"c_{c}"), F.lit({"index_group": 1.0, "department": 0.5, "colour": 0.25}[c])).otherwise(F.lit(0.0)), shared, F.lit(base))
        return seeds.join(F.broadcast(pool), key).select(*PAIR, "last_day", (F.col("strength") * bonus * (1 + F.ln(1 + F.col("popularity")))).alias("part"))

    types, groups = lane("product_type", p.type_pool, 3.0), lane("garment_group", p.group_pool, 1.5)
    both = [x.groupBy(*PAIR).agg(F.max("last_day").alias("last_day"), F.sum("part").alias("part")) for x in (types, groups)]
    both = dealt(both[0].unionByName(both[1]), "customer_id").groupBy(*PAIR).agg(F.max("last_day").alias("last_day"), rounded(F.sum("part"), 8).alias("source_score"))
    return first(both, p.source_k)


#: more than the width of a cell of scores that round alike, errors of double precision included
CELL = 1.1e-8


def shelved(items: DataFrame, by: str, k: int, least: Column | None = None) -> DataFrame:
    """``items`` (article_id, reach) with their place ``at`` in the group ``by`` by reach, then id, and the reach ``edge`` at place k; of equal reach the k least ids. ``least``: rows that are not `near` at this strength go before they are sorted."""
    if least is not None:
        top = items.select(by, "reach", place(F.desc("reach"), "article_id", by=by).alias("at")).where(F.col("at") <= k)
        edges = top.where(F.col("at") == k).select(by, F.col("reach").alias("edge"))
        items = items.join(edges, by, "left").where(F.col("edge").isNull() | ((F.col("edge") - F.col("reach")) * least <= CELL)).drop("edge")
    rows = items.withColumn("level", place("article_id", by=[by, "reach"])).where(F.col("level") <= k).drop("level")
    rows = rows.withColumn("at", place(F.desc("reach"), "article_id", by=by))
    return rows.withColumn("edge", F.max(F.when(F.col("at") == k, F.col("reach"))).over(Window.partitionBy(by)))


def near(strength: Column, k: int) -> Column:
    """Whether a row of `shelved` may be among the first k of its group when ``strength`` times reach is rounded."""
    return (F.col("at") <= k) | F.col("edge").isNull() | ((F.col("edge") - F.col("reach")) * strength <= CELL)


def family_source(r, p) -> DataFrame:
    """The relation src_product_family without the pairs of users and siblings that cannot be among a user's first.

    In a family all scores of a user are one strength times 1 + reach, so order by reach
    (then id) is order by score but for scores that round alike. Of each family stay the
    first k by reach, and those so near the k-th (``edge``) that they may tie with it; of
    equal reach the k least ids. The k best of one family also bound what the user's other
    families must score. The bounds leave out only what k others precede.
    """
    k, cutoff = p.source_k, F.lit(p.cutoff).cast("date")
    least = F.lit(2.0 ** (-p.history_days / 21))
    shelf = r("articles").select("article_id", "product_code").where("product_code IS NOT NULL").join(r("popularity").select("article_id", "popularity"), "article_id", "left")
    shelf = shelf.select("product_code", "article_id", F.ln(1 + F.coalesce("popularity", F.lit(0.0))).alias("reach"))
    shelf = materialise(shelved(shelf, "product_code", k, least).where(near(least, k)), "family-shelf")
    edges = shelf.where(F.col("at") == k).select("product_code", F.col("reach").alias("bar"))
    own = r("recent").join(r("users"), "customer_id")
    own = own.join(sifted(r("articles").select("article_id", "product_code"), "article_id", own.select("article_id")), "article_id").groupBy("customer_id", "product_code").agg(F.max("t_dat").alias("last_day"), F.count("*").alias("n"))
    own = own.withColumn("strength", F.pow(F.lit(2.0), -F.datediff(cutoff, "last_day") / F.lit(21.0)) * (1 + F.ln("n"))).drop("n")
    own = own.join(edges, "product_code", "left").withColumn("bar", F.max(F.col("strength") * (1 + F.col("bar"))).over(Window.partitionBy("customer_id")))
    score = F.col("strength") * (1 + F.col("reach"))
    met = own.join(shelf, "product_code").where(near(F.col("strength"), k) & (F.col("bar").isNull() | (score >= F.col("bar") - CELL)))
    return first(dealt(met.select(*PAIR, "last_day", rounded(score, 8).alias("source_score")), "customer_id"), k)


def cold_season_source(r, p) -> DataFrame:
    """The relation src_cold_season. The lane of a user's types is bounded as in `family_source`: the share of a type times the lift of its items, k being the lane's length."""
    k = p.global_k
    lifts = materialise(r("cold_lifts").select("article_id", "product_type", "score"), "cold-lifts")
    top = lifts.select("article_id", "score").orderBy(F.desc("score"), "article_id").limit(k)
    top = top.select("article_id", F.row_number().over(Window.orderBy(F.desc("score"), "article_id")).cast("long").alias("lane_rank"))  # k rows
    everyone = r("users").crossJoin(F.broadcast(top))
    kinds = r("typed_recent").select("customer_id", "product_type").join(r("users"), "customer_id").groupBy("customer_id", "product_type").agg(F.count("*").alias("n"))
    own = materialise(kinds.select("customer_id", "product_type", (F.col("n").cast("double") / total(F.sum("n"))).alias("share")), "type-shares")
    shelf = shelved(lifts.where("product_type IS NOT NULL").select("product_type", "article_id", (F.col("score") + 0.01).alias("reach")), "product_type", k)
    weakest = own.agg(F.min("share").alias("weakest"))  # one row
    shelf = materialise(shelf.join(F.broadcast(weakest)).where(near(F.col("weakest"), k)).drop("weakest"), "season-shelf")
    edges = shelf.where(F.col("at") == k).select("product_type", F.col("reach").alias("bar"))
    own = own.join(edges, "product_type", "left").withColumn("bar", total(F.max(F.col("share") * F.col("bar"))))
    score = F.col("share") * F.col("reach")
    met = own.join(shelf, "product_type").where(near(F.col("share"), k) & (F.col("bar").isNull() | (score >= F.col("bar") - CELL)))
    lane = met.select("customer_id", "article_id", place(F.desc(rounded(score, 8)), "article_id").alias("lane_rank")).where(F.col("lane_rank") <= k)
    lanes = everyone.unionByName(lane).groupBy("customer_id", "article_id").agg(rounded(F.sum(1 / (F.lit(float(p.rrf)) + F.col("lane_rank"))), 8).alias("source_score"))
    return lanes.select("customer_id", "article_id", place(F.desc("source_score"), "article_id").alias("source_rank"), "source_score").where(F.col("source_rank") <= k)


#: sources that may hold a pair more than once, where the feed repeats an article or a customer; the others group by pair
REPEATING = ("product_family", "segment_popularity")
#: sources of lists that users share, not written but met by the users anew
SHARED = ("recent_popularity", "segment_popularity")


def long_candidates(r, p) -> DataFrame:
    """The relation candidates_long: only sources that may repeat a pair are sorted to find its least rank."""
    from .fusion import SOURCES

    row = lambda s: r(f"src_{s}").select(*PAIR, F.lit(s).alias("source"), "source_rank", F.col("source_score").cast("double").alias("source_score"))
    once = lambda rows: rows.withColumn("rn", place("source_rank", F.desc("source_score"), by=PAIR)).where("rn = 1").drop("rn")
    every = reduce(DataFrame.unionByName, [once(row(s)) if s in REPEATING else row(s) for s in SOURCES])
    return every.withColumn("source_score", rounded(F.col("source_score"), 6))


def fused_pool(r, p) -> DataFrame:
    """The relation rrf_fused_topk, from the sources, made at the same time: users are dealt out once, a pair's least rank of each source is kept, and so repeats need no sort before. The lists that all users share are not dealt with the rows, only met by the users where these are."""
    from .fusion import SOURCES

    number = {s: i for s, (i, _) in SOURCES.items()}
    made = dict(zip(SOURCES, together(r, *[f"src_{s}" for s in SOURCES]), strict=True))
    row = lambda s: made[s].select(*PAIR, F.col("source_rank").cast("int").alias("at"), F.lit(number[s]).alias("source"))
    own = dealt(reduce(DataFrame.unionByName, [row(s) for s in SOURCES if s not in SHARED]), "customer_id")
    rows = dealt(reduce(DataFrame.unionByName, [own, *[row(s) for s in SHARED]]), "customer_id")
    pairs = rows.groupBy(*PAIR).agg(*[F.min(F.when(F.col("source") == number[s], F.col("at"))).alias(s) for s in SOURCES])
    parts = [F.coalesce(F.lit(SOURCES[s][1]["equal"]) / (F.lit(p.rrf) + F.col(s)), F.lit(0.0)) for s in SOURCES]
    score, count = reduce(lambda x, y: x + y, parts), reduce(lambda x, y: x + y, [F.col(s).isNotNull().cast("long") for s in SOURCES])
    own = pairs.withColumns({"fused_score": rounded(score, 10), "source_count": count})
    own = own.withColumn("candidate_rank", place(F.desc("fused_score"), F.desc("source_count"), "article_id")).where(F.col("candidate_rank") <= p.candidate_k)
    names = F.concat_ws(",", *[F.when(F.col(s).isNotNull(), s) for s in sorted(SOURCES, key=number.get)])
    return own.select(*PAIR, "candidate_rank", "fused_score", "source_count", names.alias("sources"))


def exchanges(r, p) -> DataFrame:
    """All pairs of a challenger and a victim of a user's slate, before their gaps are rounded: users are dealt out once, and their few victims go to each challenger in the window that counts the hits."""
    rank, k = F.col("final_rank"), p.metric_k
    votes = r("scored").select(*PAIR, "score_b")
    slate = dealt(r("two_ranker_fusion").where(rank <= 50).select(*PAIR, "final_rank", "target", "final_score").join(votes, PAIR, "left"), "customer_id")
    far = Window.partitionBy("customer_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inverse = F.coalesce(F.sum(F.when(F.col("target") == 1, 1.0 / rank).otherwise(F.lit(0.0))).over(far), F.lit(0.0))
    slate = slate.withColumns({"hits": F.sum("target").over(far), "inverse": inverse})
    victim = F.when((rank > p.head) & (rank <= k) & F.col("article_id").isNotNull(), F.struct(*[F.col(c) for c in ("article_id", "final_rank", "final_score", "score_b", "target", "hits", "inverse")]))
    slate = slate.withColumns({"victims": total(F.collect_list(victim)), "last": total(F.max(F.when(rank == k, F.col("inverse"))))})
    slate = slate.where((rank > k) & F.col("article_id").isNotNull() & F.col("customer_id").isNotNull() & F.col("last").isNotNull()).drop("hits", "inverse")
    return slate.withColumn("v", F.explode("victims")).drop("victims")


def swaps(r, p) -> DataFrame:
    """The relation swap_pairs."""
    own = exchanges(r, p).join(r("truth_counts"), "customer_id", "left")
    gain = (F.col("target") - F.col("v.target")) * ((F.col("v.hits") - F.col("v.target") + 1) / F.col("v.final_rank").cast("double") + (F.col("last") - F.col("v.inverse"))) / F.least(F.coalesce("n", F.lit(1)), F.lit(p.metric_k))
    return own.select(
        "customer_id", F.col("article_id").alias("challenger"), F.col("v.article_id").alias("victim"), F.col("final_rank").alias("challenger_rank"), F.col("v.final_rank").alias("victim_rank"),
        rounded(F.col("final_score") - F.col("v.final_score"), 10).alias("score_gap"), rounded(F.col("score_b") - F.col("v.score_b"), 8).alias("vote_gap"), F.col("target").alias("challenger_target"), F.col("v.target").alias("victim_target"), rounded(gain, 8).alias("delta"),
    )


def best_swaps(r, p) -> DataFrame:
    """The relation greedy_swaps from the slates, in one order of a user's pairs: those that share a row with the first go, and two stay."""
    gap = rounded(F.col("score_b") - F.col("v.score_b"), 8)
    pairs = exchanges(r, p).select("customer_id", F.col("article_id").alias("challenger"), F.col("v.article_id").alias("victim"), F.col("final_rank").alias("challenger_rank"), F.col("v.final_rank").alias("victim_rank"), gap.alias("vote_gap")).where("vote_gap > 0")
    order = [F.desc("vote_gap"), F.desc("victim_rank"), "challenger_rank", "challenger", "victim"]
    best = F.first(F.struct("challenger", "victim")).over(Window.partitionBy("customer_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pairs = pairs.withColumns({"turn": place(*order), "best": best})
    pairs = pairs.where((F.col("turn") == 1) | (F.col("challenger") != F.col("best.challenger")) & (F.col("victim") != F.col("best.victim")))
    return pairs.withColumn("turn", place(*order)).where("turn <= 2").select("customer_id", "challenger", "victim", "turn")


GRAPH.made["swap_pairs"] = swaps
GRAPH.made["greedy_swaps"] = best_swaps
GRAPH.made["late"] = late_events
GRAPH.made["recent"] = lambda r, p: r("late").where(F.col("t_dat") < F.lit(p.cutoff).cast("date"))
GRAPH.made["label_week"] = lambda r, p: r("late").where(F.col("t_dat") >= F.lit(p.cutoff).cast("date"))
GRAPH.made["own_recent"] = lambda r, p: sifted(r("recent"), "customer_id", r("users")).join(r("users"), "customer_id").select(*r("recent").columns)
GRAPH.made["basket_lists"] = basket_lists
GRAPH.made["baskets"] = day_baskets
GRAPH.made["covisit_neighbors"] = bought_together
GRAPH.made["cold_items"] = unsold_items
GRAPH.made["src_recent_popularity"] = popular_source
GRAPH.made["src_segment_popularity"] = segment_source
GRAPH.made["src_repurchase"] = repurchase_source
GRAPH.made["src_covisit"] = covisit_source
GRAPH.made["src_attribute_content"] = attribute_source
GRAPH.made["src_product_family"] = lambda r, p: family_source(lambda x: r("own_recent" if x == "recent" else x), p)
GRAPH.made["src_cold_season"] = cold_season_source
GRAPH.made["candidates_long"] = long_candidates
GRAPH.made["rrf_fused_topk"] = fused_pool
GRAPH.thin |= {"recent", "label_week", "baskets", *(f"src_{s}" for s in SHARED)}
GRAPH.stage("basket_lists", "late", "label_week", "own_recent", "popular_articles")
GRAPH.stage("recent", "users", "popularity", "baskets", "src_product_family", "cold_items", "src_segment_popularity", "src_attribute_content")
GRAPH.stage("truth", "src_covisit", "src_recent_popularity", "src_repurchase", "src_cold_content", "src_cold_season", "src_seasonal")
