"""Registry of the engine's queries with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, distributed, enrichment, evaluation, features, fusion, graphs, matching, metrics, nearest, policies, pools, population, rankings, retrieval, sampling, vectors, vocabulary  # noqa: F401  each declares its relations
from .plans.frames import FRAMES
from .plans.graph import GRAPH
from .plans.params import SMALL_FEED, Params
from .sources import canonical
from .streaming import stats

FLAGSHIP = "rrf_fused_topk"
GRAPH.stage("candidates_long", "rrf_fused_topk", "scored", "two_ranker_fusion", "swap_pairs", "greedy_swaps", "swapped_slate", "item_knn", "seed_neighbours", "src_item_neighbours", "covisit_neighbors", "basket_transitions", "ap_table", "src_cold_content", "pit_user_item_features")


def run(name: str, params: Params = SMALL_FEED):
    """The query ``name`` as a function of a session and a folder of tables."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        canonical.register(spark, folder)
        return GRAPH.frame(spark, name, params, folder)

    query.__name__, query.__doc__ = name, GRAPH.queries[name]
    return query


QUERIES = {name: run(name) for name in GRAPH.queries}
ORACLES = {name: GRAPH.oracle(name, SMALL_FEED) for name in GRAPH.queries}
QUERIES |= {name: FRAMES.run(name, SMALL_FEED, canonical.register) for name in FRAMES.built}
ORACLES |= {name: FRAMES.oracle(name, SMALL_FEED) for name in FRAMES.built}


def weekly_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.weekly_counts(spark.read.parquet(f"{folder}/events.parquet"))
    return out.select(F.to_date("week").alias("week"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.sessions(spark.read.parquet(f"{folder}/events.parquet"), gap="6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events", F.round("total", 4).alias("total"))


def matched_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Best slot matching per user; combinatorial, so no SQL states it."""
    pairs = QUERIES["swap_pairs"](spark, folder)
    return matching.match_slots(pairs.withColumn("weight", F.col("vote_gap")), 0.0, 2)


QUERIES |= {"weekly_event_counts": weekly_event_counts, "event_sessions": event_sessions, "matched_slots": matched_slots}
ORACLES |= {
    "weekly_event_counts": "SELECT cast(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS date) AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events, round(sum(value), 4) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, g""",
}
