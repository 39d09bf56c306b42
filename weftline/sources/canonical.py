"""Canonical relations over a feed: tx, articles, customers, item_vectors.

The operators read only these. This module maps the parquet feed of orders, lineitem,
part, customer and embeddings; another feed needs only another such module.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.graph import GRAPH, together

TABLES = ("orders", "lineitem", "part", "customer", "embeddings", "events")


def register(spark: SparkSession, folder: str) -> None:
    """Names the feed's tables in the session; plans made afterwards keep the folder they were made with."""
    for name, table in zip(TABLES, together(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"), *TABLES), strict=True):  # each read of a schema is a job
        table.createOrReplaceTempView(name)


@GRAPH.relation
def tx(d, p):
    """Purchase events; equal rows are separate events. A feed whose every article sold early has none that is cold: ``hidden`` takes the sales before the cutoff from each article of that residue."""
    hidden = f"\nWHERE l.l_partkey % {p.hidden} <> 0 OR cast(o.o_orderdate as date) >= {d.date(p.cutoff)}" if p.hidden else ""
    return """SELECT cast(o.o_orderdate as date) AS t_dat, o.o_custkey AS customer_id, l.l_partkey AS article_id, l.l_extendedprice AS price,
       CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 2 END AS channel
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""" + hidden


@GRAPH.relation
def articles(d, p):
    return f"""SELECT p_partkey AS article_id, p_type AS product_type, p_brand AS garment_group, cast(p_size as bigint) AS department, cast(p_size % 5 as bigint) AS index_group,
       {d.first_word("p_name")} AS colour, p_name AS product_code FROM part"""


@GRAPH.relation
def customers(d, p):
    return "SELECT c_custkey AS customer_id, cast(18 + c_custkey % 60 as bigint) AS age, c_mktsegment AS segment FROM customer"


@GRAPH.relation
def item_vectors(d, p):
    return "SELECT vec_id AS article_id, embedding AS vector FROM embeddings WHERE embedding IS NOT NULL"


@GRAPH.relation
def history(d, p):
    """Everything before the cutoff: features read only this."""
    return f"SELECT * FROM tx WHERE t_dat < {d.date(p.cutoff)}"


@GRAPH.relation
def recent(d, p):
    """The history window."""
    return f"SELECT * FROM history WHERE t_dat >= {d.shift(d.date(p.cutoff), -p.history_days)}"


@GRAPH.relation
def label_week(d, p):
    return f"SELECT * FROM tx WHERE t_dat >= {d.date(p.cutoff)} AND t_dat < {d.shift(d.date(p.cutoff), p.label_days)}"


@GRAPH.relation
def dated_orders(d, p):
    """Orders with their day, the smaller side of `tx`."""
    return "SELECT o_orderkey AS order_id, cast(o_orderdate as date) AS t_dat, o_custkey AS customer_id FROM orders"


@GRAPH.relation
def order_lines(d, p):
    """The larger side of `tx`."""
    return "SELECT l_orderkey AS order_id, l_partkey AS article_id, l_extendedprice AS price, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS channel FROM lineitem"


@GRAPH.relation
def late(d, p):
    """The history window and the label week together, made in one pass."""
    return f"SELECT * FROM tx WHERE t_dat >= {d.shift(d.date(p.cutoff), -p.history_days)} AND t_dat < {d.shift(d.date(p.cutoff), p.label_days)}"


@GRAPH.relation
def own_recent(d, p):
    """The history window of the run's users."""
    return "SELECT r.* FROM recent r JOIN users u ON r.customer_id = u.customer_id"


@GRAPH.relation
def popular_articles(d, p):
    """All articles with their popularity, 0 where they did not sell."""
    return "SELECT a.*, coalesce(q.popularity, 0) AS popularity FROM articles a LEFT JOIN popularity q ON a.article_id = q.article_id"
