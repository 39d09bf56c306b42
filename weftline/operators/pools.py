"""Candidate pools: other plans of the wide pool, appended and combined pools, pools of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, share, total
from ..plans.graph import together
from .distributed import edges_bought
from .fusion import SOURCES

PAIR = ["customer_id", "article_id"]
NAMES = list(SOURCES)


def unseen(rows: DataFrame, pool: DataFrame) -> DataFrame:
    """``rows`` without the pairs of ``pool``."""
    return rows.join(pool.select(*PAIR), PAIR, "left_anti")


def appended(pool: DataFrame, rows: DataFrame, limit: int, origin: str) -> DataFrame:
    """``pool`` (pair, candidate_rank, origin) with the best ``limit`` unseen rows of each user behind its last rank; from (pair, source_rank)."""
    last = pool.groupBy("customer_id").agg(F.max("candidate_rank").alias("last"))
    more = unseen(rows, pool).withColumn("k", place("source_rank", "article_id")).where(F.col("k") <= limit).join(last, "customer_id", "left")
    return pool.unionByName(more.select(*PAIR, (F.coalesce("last", F.lit(0)) + F.col("k")).alias("candidate_rank"), F.lit(origin).alias("origin")))


def base_pool(r) -> DataFrame:
    return r("rrf_fused_topk").select(*PAIR, "candidate_rank", F.lit("base").alias("origin"))


@Q.op(
    lambda d, p: "SELECT customer_id, article_id, round("
    + " + ".join(f"coalesce(1.0 / ({p.rrf} + {s}), 0)" for s in NAMES)
    + f", 10) AS fused_score, concat_ws(',', {', '.join(f'CASE WHEN {s} IS NOT NULL THEN {chr(39)}{s}{chr(39)} END' for s in NAMES)}) AS sources FROM (SELECT customer_id, article_id, "
    + ", ".join(f"max(source_rank) FILTER (source = '{s}') AS {s}" for s in NAMES)
    + " FROM candidates_long GROUP BY customer_id, article_id)"
)
def pivot_first_pool(r, p):
    """The fused pool by another plan: pivot the sources' ranks, then add contributions and join the names."""
    wide = r("candidates_long").groupBy(*PAIR).pivot("source", NAMES).agg(F.max("source_rank"))
    score = reduce(lambda a, s: a + F.coalesce(1 / (F.lit(float(p.rrf)) + F.col(s)), F.lit(0.0)), NAMES, F.lit(0.0))
    return wide.select(*PAIR, F.round(score, 10).alias("fused_score"), F.concat_ws(",", *[F.when(F.col(s).isNotNull(), s) for s in NAMES]).alias("sources"))


@Q.op(lambda d, p: "SELECT customer_id, article_id, candidate_rank, fused_score, " + ", ".join(f"max(source_rank) FILTER (source = '{s}') AS {s}_rank, max(source_score) FILTER (source = '{s}') AS {s}_score" for s in NAMES) + " FROM (SELECT f.*, l.source, l.source_rank, l.source_score FROM candidates_long l JOIN rrf_fused_topk f ON l.customer_id = f.customer_id AND l.article_id = f.article_id) GROUP BY ALL")
def grouped_wide_pool(r, p):
    """Wide candidates grouped from the long ones with their fused rank."""
    long = r("candidates_long").select(*PAIR, "source", "source_rank", "source_score").join(r("rrf_fused_topk").select(*PAIR, "candidate_rank", "fused_score"), PAIR)
    columns = [F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c.split('_')[1]}") for s in NAMES for c in ("source_rank", "source_score")]
    return long.groupBy(*PAIR, "candidate_rank", "fused_score").agg(*columns)


def _append_sql(pool: str, rows: str, limit: int, origin: str) -> str:
    return f"""SELECT * FROM {pool} UNION ALL SELECT n.customer_id, n.article_id, coalesce(m.last, 0) + n.k AS candidate_rank, '{origin}' AS origin FROM (
SELECT s.customer_id, s.article_id, row_number() OVER (PARTITION BY s.customer_id ORDER BY s.source_rank, s.article_id) AS k FROM {rows} s WHERE NOT EXISTS (SELECT 1 FROM {pool} q WHERE q.customer_id = s.customer_id AND q.article_id = s.article_id) QUALIFY k <= {limit}) n
LEFT JOIN (SELECT customer_id, max(candidate_rank) AS last FROM {pool} GROUP BY customer_id) m ON n.customer_id = m.customer_id"""


BASE_SQL = "base AS (SELECT customer_id, article_id, candidate_rank, 'base' AS origin FROM rrf_fused_topk)"


@Q.op(lambda d, p: f"WITH {BASE_SQL}, one AS ({_append_sql('base', 'src_item_neighbours', 20, 'neighbour')}) {_append_sql('one', 'src_covisit', 20, 'covisit')}")
def combined_pool(r, p):
    """The base pool with twenty unseen vector neighbours a user behind it, and twenty unseen co-visits behind these."""
    together(r, "rrf_fused_topk", "seed_neighbours")  # neither reads the other
    pool = appended(base_pool(r), r("src_item_neighbours"), 20, "neighbour")
    return appended(pool, r("src_covisit"), 20, "covisit")


def _found(pool: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    hit = F.count(F.when(F.col("t"), 1))
    return pool.join(truth.withColumn("t", F.lit(True)), PAIR, "left").agg(F.lit(name).alias("pool"), F.count("*").alias("pairs"), hit.alias("truth_pairs"), F.countDistinct("customer_id").alias("users"))


def _found_sql(pool: str, name: str) -> str:
    return f"SELECT '{name}' AS pool, count(*) AS pairs, count(t.article_id) AS truth_pairs, count(DISTINCT x.customer_id) AS users FROM {pool} x LEFT JOIN truth t ON x.customer_id = t.customer_id AND x.article_id = t.article_id"


def _variants(r, p, source: str, name: str) -> DataFrame:
    base, rows, truth = base_pool(r), r(source), r("truth")
    size = total(F.count("*"))
    free = base.select("customer_id", size.alias("n")).distinct()
    fresh = unseen(rows, base).withColumn("k", place("source_rank", "article_id"))
    fill = fresh.join(free, "customer_id", "left").where(F.col("k") <= F.lit(p.candidate_k) - F.coalesce("n", F.lit(0)))
    tail = base.where(F.col("candidate_rank") > 20).select(*PAIR, (1 / (F.lit(float(p.rrf)) + F.col("candidate_rank") - 20)).alias("s"))
    rival = fresh.select(*PAIR, (1 / (F.lit(float(p.rrf)) + F.col("k"))).alias("s"))
    mixed = tail.unionByName(rival).withColumn("k", place(F.desc(F.round("s", 10)), "article_id")).where(F.col("k") <= p.candidate_k - 20)
    competitive = base.where(F.col("candidate_rank") <= 20).select(*PAIR).unionByName(mixed.select(*PAIR))
    pools = {"base": base, name: rows, "vacancy": base.select(*PAIR).unionByName(fill.select(*PAIR)), "competitive": competitive, "expanded": base.select(*PAIR).unionByName(fresh.where(F.col("k") <= p.append_k).select(*PAIR))}
    return reduce(DataFrame.unionByName, [_found(x.select(*PAIR), truth, n) for n, x in pools.items()])


def _variants_sql(p, source: str, name: str) -> str:
    pair = "customer_id, article_id"
    return f"""WITH {BASE_SQL}, rows AS (SELECT * FROM {source}), fresh AS (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY source_rank, article_id) AS k FROM rows s WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.customer_id = s.customer_id AND b.article_id = s.article_id)),
sizes AS (SELECT customer_id, count(*) AS n FROM base GROUP BY 1), vacancy AS (SELECT {pair} FROM base UNION ALL SELECT f.customer_id, f.article_id FROM fresh f LEFT JOIN sizes z ON f.customer_id = z.customer_id WHERE f.k <= {p.candidate_k} - coalesce(z.n, 0)),
rivals AS (SELECT {pair}, 1.0 / ({p.rrf} + candidate_rank - 20) AS s FROM base WHERE candidate_rank > 20 UNION ALL SELECT {pair}, 1.0 / ({p.rrf} + k) AS s FROM fresh),
competitive AS (SELECT {pair} FROM base WHERE candidate_rank <= 20 UNION ALL SELECT {pair} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY round(s, 10) DESC, article_id) AS k FROM rivals) WHERE k <= {p.candidate_k} - 20),
expanded AS (SELECT {pair} FROM base UNION ALL SELECT {pair} FROM fresh WHERE k <= {p.append_k})
""" + " UNION ALL ".join(_found_sql(x, n) for x, n in (("base", "base"), ("rows", name), ("vacancy", "vacancy"), ("competitive", "competitive"), ("expanded", "expanded")))


@Q.op(lambda d, p: _variants_sql(p, "src_seasonal", "seasonal"))
def seasonal_pool_variants(r, p):
    """Truth found by five pools: base, the seasonal source, vacancies filled, tails in competition, and expansion."""
    return _variants(r, p, "src_seasonal", "seasonal")


@Q.op(lambda d, p: _variants_sql(p, "src_cold_season", "cold"))
def cold_pool_variants(r, p):
    """The same five pools with the cold source."""
    return _variants(r, p, "src_cold_season", "cold")


@Q.op(lambda d, p: "SELECT customer_id, article_id, max(b) AS in_base, max(n) AS in_neighbours, max(c) AS in_content, max(b) + 2 * max(n) + 4 * max(c) AS member FROM (SELECT customer_id, article_id, 1 AS b, 0 AS n, 0 AS c FROM rrf_fused_topk UNION ALL SELECT customer_id, article_id, 0, 1, 0 FROM src_item_neighbours UNION ALL SELECT customer_id, article_id, 0, 0, 1 FROM src_cold_content) GROUP BY 1, 2")
def source_factorial(r, p):
    """All pairs of three sources with a flag for each and their combination as a number."""
    flags = ("in_base", "in_neighbours", "in_content")
    rows = [r(x).select(*PAIR, F.lit(1).alias(f)) for x, f in zip(("rrf_fused_topk", "src_item_neighbours", "src_cold_content"), flags, strict=True)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    own = every.groupBy(*PAIR).agg(*[F.coalesce(F.max(f), F.lit(0)).alias(f) for f in flags])
    return own.withColumn("member", F.col("in_base") + 2 * F.col("in_neighbours") + 4 * F.col("in_content"))


@Q.op(lambda d, p: f"""WITH e AS (SELECT customer_id, article_id, source_rank, source_score, source_rank / count(*) OVER w::double AS fraction, (source_score - avg(source_score) OVER w) / nullif(stddev_pop(source_score) OVER w, 0) AS z FROM src_factor_rows WINDOW w AS (PARTITION BY customer_id)),
b AS (SELECT f.customer_id, f.article_id, f.candidate_rank, f.fused_score, 0 AS appended, e.source_rank, e.fraction, e.z FROM rrf_fused_topk f LEFT JOIN e ON f.customer_id = e.customer_id AND f.article_id = e.article_id),
m AS (SELECT e.customer_id, e.article_id, coalesce(x.last, 0) + row_number() OVER (PARTITION BY e.customer_id ORDER BY e.source_rank, e.article_id) AS candidate_rank, 0.0 AS fused_score, 1 AS appended, e.source_rank, e.fraction, e.z FROM e LEFT JOIN (SELECT customer_id, max(candidate_rank) AS last FROM rrf_fused_topk GROUP BY 1) x ON e.customer_id = x.customer_id WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = e.customer_id AND f.article_id = e.article_id))
SELECT customer_id, article_id, candidate_rank, fused_score, appended, coalesce(round(fraction, 6), 0) AS rank_fraction, coalesce(round(1.0 / ({p.rrf} + source_rank), 8), 0) AS reciprocal, coalesce(round(z, 5), 0) AS z_score FROM (SELECT * FROM b UNION ALL SELECT * FROM m)""".replace("src_factor_rows", "src_item_neighbours"))
def augmented_candidates(r, p):
    """The pool with another retriever's evidence (rank fraction, reciprocal rank, z-score within the user), its own finds ranked behind; absent columns are zero."""
    found = r("src_item_neighbours").select(*PAIR, "source_rank", "source_score")
    spread = total(F.stddev_pop("source_score"))
    found = found.select(*PAIR, "source_rank", (F.col("source_rank") / total(F.count("*")).cast("double")).alias("fraction"), ((F.col("source_score") - total(F.avg("source_score"))) / F.when(spread != 0, spread)).alias("z"))
    pool = r("rrf_fused_topk").select(*PAIR, "candidate_rank", "fused_score")
    base = pool.join(found, PAIR, "left").withColumn("appended", F.lit(0))
    last = pool.groupBy("customer_id").agg(F.max("candidate_rank").alias("last"))
    more = unseen(found, pool).join(last, "customer_id", "left").withColumn("candidate_rank", F.coalesce("last", F.lit(0)) + place("source_rank", "article_id"))
    more = more.select(*PAIR, "candidate_rank", F.lit(0.0).alias("fused_score"), "source_rank", "fraction", "z", F.lit(1).alias("appended"))
    zero = lambda c, n: F.coalesce(F.round(c, n), F.lit(0.0))
    return base.unionByName(more).select(*PAIR, "candidate_rank", "fused_score", "appended", zero("fraction", 6).alias("rank_fraction"), zero(1 / (F.lit(float(p.rrf)) + F.col("source_rank")), 8).alias("reciprocal"), zero("z", 5).alias("z_score"))


@Q.op(lambda d, p: f"""WITH deep AS (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS k FROM (
SELECT q.customer_id, n.dst AS article_id, round(sum(n.similarity * q.events), 6) AS score FROM pair_stats q JOIN users u ON q.customer_id = u.customer_id JOIN covisit_edges n ON q.article_id = n.src GROUP BY 1, 2) QUALIFY k <= 200)
SELECT CASE WHEN k <= 50 THEN '1-50' WHEN k <= 100 THEN '51-100' ELSE '101-200' END AS band, count(*) AS pairs, count(t.article_id) AS truth_pairs FROM deep x LEFT JOIN truth t ON x.customer_id = t.customer_id AND x.article_id = t.article_id
WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = x.customer_id AND f.article_id = x.article_id) GROUP BY 1""")
def deep_covisit(r, p):
    """Co-visitation two hundred deep over all edges of the users' items: pairs and truth that the pool lacks, by rank band."""
    own = r("own_pair_stats")
    scores = own.join(edges_bought(r, p, own.select("article_id")), own["article_id"] == F.col("src")).groupBy("customer_id", F.col("dst").alias("article_id")).agg(F.round(F.sum(F.col("similarity") * F.col("events")), 6).alias("score"))
    deep = scores.withColumn("k", place(F.desc("score"), "article_id")).where("k <= 200")
    band = F.when(F.col("k") <= 50, "1-50").when(F.col("k") <= 100, "51-100").otherwise("101-200")
    fresh = unseen(deep, r("rrf_fused_topk")).join(r("truth").withColumn("t", F.lit(1)), PAIR, "left")
    return fresh.groupBy(band.alias("band")).agg(F.count("*").alias("pairs"), F.count("t").alias("truth_pairs"))


@Q.op(lambda d, p: """SELECT s.customer_id, s.article_id, s.source_rank, round(ln(1 + coalesce(i.e28, 0)), 6) AS log_e28, round(ln(1 + coalesce(i.events, 0)), 6) AS log_events, round(coalesce(t.n, 0) / u.events::double, 6) AS type_share, round(abs(i.avg_price - u.avg_price), 6) AS price_gap, CASE WHEN y.article_id IS NULL THEN 0 ELSE 1 END AS target
FROM src_recent_popularity s JOIN articles a ON s.article_id = a.article_id LEFT JOIN item_stats i ON s.article_id = i.article_id LEFT JOIN user_stats u ON s.customer_id = u.customer_id
LEFT JOIN (SELECT customer_id, product_type, count(*) AS n FROM typed_recent GROUP BY 1, 2) t ON s.customer_id = t.customer_id AND a.product_type = t.product_type LEFT JOIN truth y ON s.customer_id = y.customer_id AND s.article_id = y.article_id""")
def popular_pair_features(r, p):
    """First-stage view of popular items for every user: log counts, share of the type, price gap, target."""
    types = r("typed_recent").groupBy("customer_id", "product_type").agg(F.count("*").alias("n"))
    items = r("item_stats").select("article_id", "e28", F.col("events").alias("item_events"), F.col("avg_price").alias("item_price"))
    users = r("user_stats").select("customer_id", "events", "avg_price")
    own = r("src_recent_popularity").join(r("articles").select("article_id", "product_type"), "article_id").join(items, "article_id", "left").join(users, "customer_id", "left")
    own = own.join(types, ["customer_id", "product_type"], "left").join(r("truth").withColumn("t", F.lit(1)), PAIR, "left")
    log = lambda c: F.round(F.log1p(F.coalesce(F.col(c), F.lit(0))), 6)
    return own.select(*PAIR, "source_rank", log("e28").alias("log_e28"), log("item_events").alias("log_events"), share(F.coalesce("n", F.lit(0)), F.col("events")).alias("type_share"), F.round(F.abs(F.col("item_price") - F.col("avg_price")), 6).alias("price_gap"), F.coalesce("t", F.lit(0)).alias("target"))
