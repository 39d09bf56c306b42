"""Expressions and set operations of the query vocabulary, each in a small query of its own."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from ..plans.frames import FRAMES as Q
from ..plans.frames import place, share


def zero_of(kind: DataType) -> Column:
    """The neutral value of a column type: an empty text, false, or zero."""
    return F.lit("" if isinstance(kind, StringType) else 0).cast(kind)


@Q.op(lambda d, p: "SELECT * EXCLUDE (product_code, colour) FROM articles")
def articles_without_text(r, p):
    """All article columns but two."""
    return r("articles").drop("product_code", "colour")


@Q.op(lambda d, p: "SELECT product_type, count(*) AS n FROM articles WHERE product_type LIKE 'PROMO%' AND product_type NOT LIKE '%STEEL' GROUP BY 1")
def types_by_prefix(r, p):
    """Articles per type, by a prefix and without a suffix."""
    own = r("articles").where(F.col("product_type").like("PROMO%") & ~F.col("product_type").like("%STEEL"))
    return own.groupBy("product_type").agg(F.count("*").alias("n"))


@Q.op(lambda d, p: "SELECT segment, count(*) AS n FROM customers WHERE NOT regexp_matches(segment, '^[A-M][A-Z]+$') GROUP BY segment")
def segments_off_pattern(r, p):
    """Customers whose segment does not match a pattern."""
    return r("customers").where(~F.col("segment").rlike("^[A-M][A-Z]+$")).groupBy("segment").agg(F.count("*").alias("n"))


@Q.op(lambda d, p: "SELECT count(*) AS n, count(*) FILTER (isfinite(v)) AS finite, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (isnan(v)) AS not_numbers FROM (SELECT CASE WHEN article_id % 7 = 0 THEN 'nan'::double WHEN article_id % 11 = 0 THEN 'infinity'::double WHEN article_id % 13 = 0 THEN NULL ELSE avg_price END AS v FROM item_stats)")
def finite_values(r, p):
    """Counts of finite, missing and undefined values of a measure (some are planted here)."""
    i = F.col("article_id")
    v = F.when(i % 7 == 0, float("nan")).when(i % 11 == 0, float("inf")).when(i % 13 != 0, F.col("avg_price"))
    own = r("item_stats").select(v.alias("v"))
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    return own.agg(F.count("*").alias("n"), F.count_if(finite).alias("finite"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(F.isnan("v")).alias("not_numbers"))


@Q.op(lambda d, p: "SELECT coalesce(c.customer_id, r.customer_id) AS customer_id, coalesce(c.article_id, r.article_id) AS article_id, coalesce(c.source_rank, 0) AS covisit_rank, coalesce(c.source_score, 0) AS covisit_score, coalesce(r.source_rank, 0) AS bought_rank, coalesce(r.source_score, 0) AS bought_score FROM src_covisit c FULL JOIN src_repurchase r ON c.customer_id = r.customer_id AND c.article_id = r.article_id")
def typed_zeros(r, p):
    """Two sources side by side; what one lacks is the zero of the column's type."""
    named = lambda x, n: r(x).select("customer_id", "article_id", F.col("source_rank").alias(f"{n}_rank"), F.col("source_score").alias(f"{n}_score"))
    both = named("src_covisit", "covisit").join(named("src_repurchase", "bought"), ["customer_id", "article_id"], "full")
    return both.select(*[F.coalesce(F.col(f.name), zero_of(f.dataType)).alias(f.name) for f in both.schema])


@Q.op(lambda d, p: "SELECT product_type, count(*) AS n, round(quantile_disc(price, 0.25), 4) AS low, round(quantile_disc(price, 0.75), 4) AS high FROM typed_recent GROUP BY product_type")
def price_quantiles(r, p):
    """Approximate quartiles of prices per type: a sketch per group, merged; its accuracy is one in a million ranks."""
    q = F.percentile_approx("price", [0.25, 0.75], 1_000_000)
    return r("typed_recent").groupBy("product_type").agg(F.count("*").alias("n"), q.alias("q")).select("product_type", "n", F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))


@Q.op(lambda d, p: "SELECT product_type, round(stddev_samp(price), 4) AS sample, round(stddev_pop(price), 4) AS population FROM typed_recent GROUP BY product_type")
def price_spread(r, p):
    """Sample and population deviation of prices per type; one sale has no sample deviation."""
    return r("typed_recent").groupBy("product_type").agg(F.round(F.stddev_samp("price"), 4).alias("sample"), F.round(F.stddev_pop("price"), 4).alias("population"))


@Q.op(lambda d, p: "SELECT events, users, round(sum(users) OVER (ORDER BY events) / sum(users) OVER ()::double, 6) AS below_or_equal FROM (SELECT events, count(*) AS users FROM user_stats GROUP BY events)")
def activity_cdf(r, p):
    """Empirical distribution function of users' event counts, from their histogram (as many rows as different counts)."""
    counts = r("user_stats").groupBy("events").agg(F.count("*").alias("users"))
    whole = counts.agg(F.sum("users").alias("all"))
    upto = F.sum("users").over(Window.orderBy("events"))
    return counts.join(F.broadcast(whole)).select("events", "users", share(upto, F.col("all")).alias("below_or_equal"))


@Q.op(lambda d, p: "SELECT customer_id, age_group, last_day, row_number() OVER (PARTITION BY age_group ORDER BY last_day DESC NULLS LAST, customer_id) AS place FROM (SELECT c.customer_id, floor(c.age / 10) * 10 AS age_group, max(h.t_dat) AS last_day FROM customers c LEFT JOIN recent h ON c.customer_id = h.customer_id GROUP BY c.customer_id, c.age)")
def latest_buyers(r, p):
    """Customers per decade of age by their last purchase, those without one last."""
    last = r("recent").groupBy("customer_id").agg(F.max("t_dat").alias("last_day"))
    own = r("customers").select("customer_id", (F.floor(F.col("age") / 10) * 10).alias("age_group")).join(last, "customer_id", "left")
    return own.withColumn("place", place(F.col("last_day").desc_nulls_last(), "customer_id", by="age_group"))


@Q.op(lambda d, p: "SELECT customer_id, events FROM user_stats ORDER BY customer_id LIMIT 100 OFFSET 200")
def user_page(r, p):
    """The third page of a hundred users, as batch inference reads them."""
    return r("user_stats").orderBy("customer_id").offset(200).limit(100).select("customer_id", "events")


@Q.op(lambda d, p: "SELECT 'covisit' AS origin, * FROM src_covisit UNION ALL BY NAME SELECT 'bought' AS origin, customer_id, article_id, events AS pair_events FROM pair_stats")
def aligned_union(r, p):
    """Rows of two relations by column name; a column that one lacks is null."""
    return r("src_covisit").withColumn("origin", F.lit("covisit")).unionByName(r("pair_stats").select("customer_id", "article_id", F.col("events").alias("pair_events"), F.lit("bought").alias("origin")), allowMissingColumns=True)


@Q.op(lambda d, p: "SELECT article_id FROM src_covisit UNION SELECT article_id FROM src_recent_popularity UNION SELECT article_id FROM src_repurchase")
def reached_items(r, p):
    """Items that one of three sources proposes to anyone."""
    one = lambda x: r(x).select("article_id")
    return one("src_covisit").union(one("src_recent_popularity")).union(one("src_repurchase")).distinct()


@Q.op(lambda d, p: "SELECT article_id FROM articles EXCEPT SELECT article_id FROM candidates_long")
def unreached_items(r, p):
    """Articles that no source proposes to anyone."""
    return r("articles").select("article_id").subtract(r("candidates_long").select("article_id"))


@Q.op(lambda d, p: "SELECT customer_id, lpad(article_id::varchar, 10, '0') AS padded FROM final_order")
def padded_ids(r, p):
    """Slate items under the ids of the raw files, ten digits."""
    return r("final_order").select("customer_id", F.lpad(F.col("article_id").cast("string"), 10, "0").alias("padded"))


@Q.op(lambda d, p: f"SELECT customer_id, len(xs) AS items, len(list_distinct(xs)) AS different, regexp_full_match(prediction, '[0-9]+( [0-9]+)*') AND len(xs) = len(list_distinct(xs)) AND len(xs) <= {p.metric_k} AS valid FROM (SELECT *, string_split(prediction, ' ') AS xs FROM submission)")
def submission_contract(r, p):
    """Whether each line of the submission is a list of different ids of the slate's length at most."""
    own = r("submission").withColumn("xs", F.split("prediction", " "))
    items, different = F.size("xs").cast("long"), F.size(F.array_distinct("xs")).cast("long")
    return own.select("customer_id", items.alias("items"), different.alias("different"), (F.col("prediction").rlike("^[0-9]+( [0-9]+)*$") & (items == different) & (items <= p.metric_k)).alias("valid"))
