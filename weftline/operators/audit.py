"""Data quality, profiles and contracts."""

from ..plans.graph import GRAPH as G


@G.query
def column_profile(d, p):
    """Missing (null or blank) and distinct values of article columns, one scan each way."""
    columns = ("product_type", "garment_group", "department", "index_group", "colour", "product_code")
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(CASE WHEN {c} IS NULL OR trim({d.text(c)}) = '' THEN 1 END) AS missing, count(DISTINCT {c}) AS unique_values FROM articles" for c in columns)


@G.query
def top_values(d, p):
    """The most frequent colours."""
    return f"SELECT coalesce({d.text('colour')}, '<MISSING>') AS value, count(*) AS n FROM articles GROUP BY coalesce({d.text('colour')}, '<MISSING>') ORDER BY n DESC, value LIMIT 10"


@G.query
def dataset_profile(d, p):
    """Rows, users, items, days, exact duplicates, density, price quantiles and channel share."""
    return f"SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_users, count(DISTINCT article_id) AS n_items, count(DISTINCT t_dat) AS n_days, round(count(*) / (cast(count(DISTINCT customer_id) as double) * count(DISTINCT article_id)), 8) AS density, round({d.quantile('price', 0.25)}, 3) AS p25, round({d.median('price')}, 3) AS p50, round({d.quantile('price', 0.75)}, 3) AS p75, round(avg(CASE WHEN channel = 1 THEN 1.0 ELSE 0.0 END), 6) AS channel_one FROM tx"


@G.query
def duplicate_events(d, p):
    """Events that repeat in every column, which stay events."""
    return "SELECT count(*) AS groups_repeated, coalesce(cast(sum(n - 1) as bigint), 0) AS extra_rows FROM (SELECT count(*) AS n FROM tx GROUP BY t_dat, customer_id, article_id, price, channel HAVING count(*) > 1) x"


@G.query
def monthly_activity(d, p):
    """Events, users and items per month."""
    return f"SELECT {d.month('t_dat')} AS month, count(*) AS events, count(DISTINCT customer_id) AS users, count(DISTINCT article_id) AS items FROM tx GROUP BY {d.month('t_dat')}"


@G.query
def sales_concentration(d, p):
    """Share of events of the top 1, 5, 10 and 50 percent of items."""
    cut = ", ".join(f"round(cast(sum(CASE WHEN rk <= ceil(m * {q}) THEN n ELSE 0 END) as double) / sum(n), 6) AS top_{int(q * 100)}" for q in (0.01, 0.05, 0.10, 0.50))
    return f"SELECT {cut} FROM (SELECT n, row_number() OVER (ORDER BY n DESC, article_id) AS rk, count(*) OVER (PARTITION BY 1) AS m FROM (SELECT article_id, count(*) AS n FROM tx GROUP BY article_id) x) y"


@G.query
def activity_distribution(d, p):
    """Users per number of events, an aggregate of an aggregate."""
    return "SELECT events, count(*) AS users FROM (SELECT customer_id, count(*) AS events FROM tx GROUP BY customer_id) x GROUP BY events"


@G.query
def basket_sizes(d, p):
    """Baskets per number of distinct items."""
    return "SELECT items, count(*) AS baskets FROM (SELECT customer_id, t_dat, count(DISTINCT article_id) AS items FROM tx GROUP BY customer_id, t_dat) x GROUP BY items"


@G.query
def key_integrity(d, p):
    """Foreign keys without a match, and cold users and items of the label week."""
    return """SELECT (SELECT count(*) FROM tx t LEFT JOIN articles a ON t.article_id = a.article_id WHERE a.article_id IS NULL) AS events_without_article, (SELECT count(*) FROM tx t LEFT JOIN customers c ON t.customer_id = c.customer_id WHERE c.customer_id IS NULL) AS events_without_customer,
(SELECT count(DISTINCT l.customer_id) FROM label_week l LEFT JOIN (SELECT DISTINCT customer_id FROM history) h ON l.customer_id = h.customer_id WHERE h.customer_id IS NULL) AS cold_users, (SELECT count(DISTINCT l.article_id) FROM label_week l LEFT JOIN warm_catalogue w ON l.article_id = w.article_id WHERE w.article_id IS NULL) AS cold_items"""


@G.query
def rule_coverage(d, p):
    """Truth pairs that repeat, family or popularity rules cover."""
    return """SELECT count(*) AS pairs, count(r.article_id) AS by_repeat, count(f.article_id) AS by_family, count(q.article_id) AS by_popularity FROM truth t LEFT JOIN src_repurchase r ON t.customer_id = r.customer_id AND t.article_id = r.article_id LEFT JOIN src_product_family f ON t.customer_id = f.customer_id AND t.article_id = f.article_id LEFT JOIN top_popular q ON t.article_id = q.article_id"""


@G.query
def pool_contract(d, p):
    """Users that break the pool's contract: gaps in ranks, repeats, or too many rows. Must be none."""
    return f"SELECT customer_id, count(*) AS n, count(DISTINCT article_id) AS items, min(candidate_rank) AS low, max(candidate_rank) AS high FROM rrf_fused_topk GROUP BY customer_id HAVING count(*) <> count(DISTINCT article_id) OR min(candidate_rank) <> 1 OR max(candidate_rank) <> count(*) OR count(*) > {p.candidate_k}"


@G.query
def plan_parity(d, p):
    """Two plans of the fusion compared value by value (null-safe): rows that differ. Must be none."""
    from .fusion import SOURCES

    joins = " ".join(f"LEFT JOIN (SELECT customer_id, article_id, source_rank FROM candidates_long WHERE source = '{s}') {s} ON k.customer_id = {s}.customer_id AND k.article_id = {s}.article_id" for s in SOURCES)
    total = " + ".join(f"coalesce(1.0 / ({p.rrf} + {s}.source_rank), 0)" for s in SOURCES)
    return f"SELECT count(*) AS differing FROM rrf_fused_topk f FULL OUTER JOIN (SELECT k.customer_id, k.article_id, {total} AS score FROM (SELECT customer_id, article_id FROM rrf_fused_topk) k {joins}) w ON f.customer_id = w.customer_id AND f.article_id = w.article_id WHERE (abs(f.fused_score - w.score) <= 0.00000001) IS DISTINCT FROM true"


@G.query
def bag_equality(d, p):
    """Both bag differences of a relation and its rebuilt form. Must be none."""
    a, b = "SELECT customer_id, article_id, source, source_rank FROM candidates_long", "SELECT customer_id, article_id, source, min(source_rank) AS source_rank FROM candidates_raw GROUP BY customer_id, article_id, source"
    return f"SELECT (SELECT count(*) FROM ({a} EXCEPT ALL {b}) x) AS missing, (SELECT count(*) FROM ({b} EXCEPT ALL {a}) y) AS extra"


@G.query
def window_coverage(d, p):
    """Articles with an image vector among those sold in each quarter: a range join with a small set of windows."""
    c = d.date(p.cutoff)
    windows = " UNION ALL ".join(f"SELECT {i} AS quarter, {d.shift(c, -91 * (i + 1))} AS start_day, {d.shift(c, -91 * i)} AS end_day" for i in range(4))
    return f"SELECT w.quarter, count(DISTINCT h.article_id) AS sold, count(DISTINCT v.article_id) AS with_vector FROM ({windows}) w JOIN history h ON h.t_dat >= w.start_day AND h.t_dat < w.end_day LEFT JOIN item_vectors v ON h.article_id = v.article_id GROUP BY w.quarter"


@G.query
def constant_features(d, p):
    """Features of the ranker's matrix with one value only."""
    columns = ("user_events", "user_items", "item_e28", "item_buyers", "pair_events", "type_events", "price_gap")
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS unique_values, min(cast({c} as double)) AS low, max(cast({c} as double)) AS high FROM pit_user_item_features" for c in columns)


@G.query
def slate_contract(d, p):
    """Slates after the swaps that are not twelve distinct items at ranks 1 to 12, or whose head moved. Must be none."""
    return f"SELECT s.customer_id, count(*) AS n FROM swapped_slate s JOIN two_ranker_fusion t ON s.customer_id = t.customer_id AND s.article_id = t.article_id WHERE s.final_rank <= {p.metric_k} GROUP BY s.customer_id HAVING count(DISTINCT s.article_id) <> count(*) OR max(s.final_rank) <> count(*) OR sum(CASE WHEN t.final_rank <= {p.head} AND s.final_rank <> t.final_rank THEN 1 ELSE 0 END) > 0"
