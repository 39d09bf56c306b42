"""Point-in-time features of users, items and pairs; all read `history` or `recent` only."""

import re

from ..plans.graph import GRAPH as G


def since(d, p, days: int, day: str = "t_dat") -> str:
    return f"{day} >= {d.shift(d.date(p.cutoff), -days)}"


def within(d, p, days: int, x: str = "1", agg: str = "count", day: str = "t_dat") -> str:
    return f"{agg}(CASE WHEN {since(d, p, days, day)} THEN {x} END)"


def age(d, p, x: str) -> str:
    return d.days(x, d.date(p.cutoff))


@G.relation
def user_stats(d, p):
    return f"SELECT customer_id, count(*) AS events, count(DISTINCT article_id) AS unique_items, avg(price) AS avg_price, avg(CASE WHEN channel = 2 THEN 1.0 ELSE 0.0 END) AS online_share, {age(d, p, 'max(t_dat)')} AS recency FROM recent GROUP BY customer_id"


@G.relation
def item_stats(d, p):
    return f"SELECT article_id, {within(d, p, 7)} AS e7, {within(d, p, 28)} AS e28, {within(d, p, 84)} AS e84, count(*) AS events, count(DISTINCT customer_id) AS buyers, avg(price) AS avg_price, {age(d, p, 'max(t_dat)')} AS recency FROM recent GROUP BY article_id"


@G.relation
def pair_stats(d, p):
    return f"SELECT customer_id, article_id, count(*) AS events, {age(d, p, 'max(t_dat)')} AS recency FROM recent GROUP BY customer_id, article_id"


@G.relation
def typed_recent(d, p):
    return "SELECT r.*, a.product_type, a.garment_group, a.department, a.index_group, a.colour, a.product_code FROM recent r JOIN articles a ON r.article_id = a.article_id"


@G.query
def pit_user_item_features(d, p):
    """The tabular features of the ranker: user, item, pair and user-category counters before the cutoff; counts default to 0, prices and recencies to null."""
    return """SELECT f.customer_id, f.article_id, f.candidate_rank, coalesce(u.events, 0) AS user_events, coalesce(u.unique_items, 0) AS user_items, round(u.avg_price, 6) AS user_price, round(u.online_share, 6) AS user_online, u.recency AS user_recency,
coalesce(i.e7, 0) AS item_e7, coalesce(i.e28, 0) AS item_e28, coalesce(i.e84, 0) AS item_e84, coalesce(i.buyers, 0) AS item_buyers, round(i.avg_price, 6) AS item_price, i.recency AS item_recency, round((coalesce(i.e7, 0) + 1) / (coalesce(i.e28, 0) / 4.0 + 1), 6) AS item_trend,
coalesce(q.events, 0) AS pair_events, q.recency AS pair_recency, coalesce(t.events, 0) AS type_events, round(coalesce(t.events, 0) / cast(greatest(coalesce(u.events, 0), 1) as double), 6) AS type_share, coalesce(de.events, 0) AS department_events,
round(abs(i.avg_price - u.avg_price), 6) AS price_gap, b.bucket, CASE WHEN tr.article_id IS NULL THEN 0 ELSE 1 END AS target
FROM rrf_fused_topk f JOIN articles a ON f.article_id = a.article_id LEFT JOIN user_stats u ON f.customer_id = u.customer_id LEFT JOIN item_stats i ON f.article_id = i.article_id LEFT JOIN pair_stats q ON f.customer_id = q.customer_id AND f.article_id = q.article_id
LEFT JOIN (SELECT customer_id, product_type, count(*) AS events FROM typed_recent GROUP BY customer_id, product_type) t ON f.customer_id = t.customer_id AND a.product_type = t.product_type
LEFT JOIN (SELECT customer_id, department, count(*) AS events FROM typed_recent GROUP BY customer_id, department) de ON f.customer_id = de.customer_id AND a.department = de.department
LEFT JOIN user_bucket b ON f.customer_id = b.customer_id LEFT JOIN truth tr ON f.customer_id = tr.customer_id AND f.article_id = tr.article_id"""


OWN = {"user_stats": "own_user_stats", "pair_stats": "own_pair_stats", "typed_recent": "own_typed", "user_bucket": "own_bucket", "recent": "own_recent"}


def of_users(sql: str) -> str:
    """A statement over the run's users only, for those who join nothing else."""
    return re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {OWN.get(m[2], m[2])}", sql)


@G.relation
def own_user_stats(d, p):
    return of_users(user_stats(d, p))


@G.relation
def own_pair_stats(d, p):
    return of_users(pair_stats(d, p))


@G.relation
def own_typed(d, p):
    return of_users(typed_recent(d, p))


@G.relation
def own_bucket(d, p):
    return "SELECT b.* FROM user_bucket b JOIN users u ON b.customer_id = u.customer_id"


@G.relation
def own_features(d, p):
    """pit_user_item_features, as it is made: the pool holds no other users, so their statistics are not formed."""
    return of_users(pit_user_item_features(d, p))


G.made["pit_user_item_features"] = lambda r, p: r("own_features")


DIMENSIONS = ("article_id", "product_code", "product_type", "garment_group", "department", "index_group", "colour")


@G.relation
def affinity_long(d, p):
    """Decayed user affinity for every value of the item and its six attributes, one aggregation over the exploded dimensions."""
    parts = d.stacked("customer_id, t_dat", DIMENSIONS, "typed_recent")
    return f"SELECT customer_id, dimension, value, {within(d, p, 28)} AS e28, count(*) AS events, {age(d, p, 'max(t_dat)')} AS recency, round(sum(exp(-ln(2) * {age(d, p, 't_dat')} / 28.0)), 6) AS decayed FROM ({parts}) x GROUP BY customer_id, dimension, value"


@G.query
def target_affinity_decay(d, p):
    """Affinity of the user for the candidate and its attributes, long by dimension."""
    keys = d.stacked("customer_id, article_id", DIMENSIONS, "(SELECT f.customer_id, a.* FROM rrf_fused_topk f JOIN articles a ON f.article_id = a.article_id) k")
    return f"SELECT k.customer_id, k.article_id, k.dimension, l.e28, l.events, l.recency, l.decayed FROM ({keys}) k JOIN affinity_long l ON k.customer_id = l.customer_id AND k.dimension = l.dimension AND k.value = l.value"


@G.relation
def user_gaps(d, p):
    """Days between the user's purchase days."""
    return f"SELECT customer_id, t_dat, {d.days('before', 't_dat')} AS gap FROM (SELECT customer_id, t_dat, lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat) AS before FROM (SELECT DISTINCT customer_id, t_dat FROM recent) x) y"


@G.query
def repeat_dynamics(d, p):
    """Per user and item: purchase days, median and last gap, cadence of the next purchase."""
    return f"""SELECT customer_id, article_id, days, median_gap, last_gap, round({age(d, p, 'last_day')} / greatest(median_gap, 1), 6) AS cadence FROM (
SELECT customer_id, article_id, count(*) AS days, {d.median('gap')} AS median_gap, {d.arg_max('gap', 't_dat')} AS last_gap, max(t_dat) AS last_day FROM (
SELECT customer_id, article_id, t_dat, {d.days('before', 't_dat')} AS gap FROM (SELECT customer_id, article_id, t_dat, lag(t_dat) OVER (PARTITION BY customer_id, article_id ORDER BY t_dat) AS before FROM (SELECT DISTINCT customer_id, article_id, t_dat FROM recent) x) y) z
GROUP BY customer_id, article_id HAVING count(*) > 1) w"""


@G.query
def trend_acceleration(d, p):
    """Weekly counts of items with velocity and least-squares slope."""
    week = lambda n: f"count(CASE WHEN {since(d, p, 7 * (n + 1))} AND NOT ({since(d, p, 7 * n)}) THEN 1 END)"
    return f"""SELECT article_id, w0, w1, w2, w3, e3, w0 - w1 AS velocity, round((3 * w0 + w1 - w2 - 3 * w3) / 10.0, 6) AS slope, item_age FROM (
SELECT article_id, {week(0)} AS w0, {week(1)} AS w1, {week(2)} AS w2, {week(3)} AS w3, {within(d, p, 3)} AS e3, {age(d, p, 'min(t_dat)')} AS item_age FROM history GROUP BY article_id) x WHERE w0 + w1 + w2 + w3 > 0"""


@G.query
def seasonal_shares(d, p):
    """Shares of product types now and a year ago, log ratio, agreement and adaptive share."""
    c = d.date(p.cutoff)
    now, prior = f"h.t_dat >= {d.shift(c, -28)}", f"h.t_dat >= {d.shift(c, -364 - 14)} AND h.t_dat < {d.shift(c, -364 + 14)}"
    return f"""SELECT product_type, round(s_now, 6) AS share_now, round(s_prior, 6) AS share_prior, round(ln((s_prior + 1e-6) / (s_now + 1e-6)), 5) AS log_ratio, round(exp(-abs(ln((s_prior + 1e-6) / (s_now + 1e-6)))), 5) AS agreement, round(0.5 * s_now + 0.5 * s_prior, 6) AS adaptive FROM (
SELECT product_type, n_now / nullif(cast(sum(n_now) OVER () as double), 0) AS s_now, n_prior / nullif(cast(sum(n_prior) OVER () as double), 0) AS s_prior FROM (
SELECT a.product_type, count(CASE WHEN {now} THEN 1 END) AS n_now, count(CASE WHEN {prior} THEN 1 END) AS n_prior FROM history h JOIN articles a ON h.article_id = a.article_id GROUP BY a.product_type) x) y"""


@G.query
def seasonal_prior_share_jsd(d, p):
    """Jensen-Shannon divergence of product-type shares, now against a year ago."""
    return """SELECT round(sum(0.5 * CASE WHEN share_now > 0 THEN share_now * ln(share_now / m) ELSE 0 END + 0.5 * CASE WHEN share_prior > 0 THEN share_prior * ln(share_prior / m) ELSE 0 END), 5) AS jsd
FROM (SELECT share_now, share_prior, (share_now + share_prior) / 2 AS m FROM seasonal_shares) x WHERE m > 0"""


@G.query
def item_demand(d, p):
    """Demand of items: window counts, buyers, days, growth, peak day, repeat share."""
    return f"""SELECT i.article_id, i.e1, i.e7, i.e28, i.e84, i.buyers, i.days, round((i.e7 + 1) / (i.e28 / 4.0 + 1), 6) AS growth, round(pk.n / cast(greatest(i.e28, 1) as double), 6) AS peak_share, pk.peak_age, round(1 - i.buyers / cast(i.events as double), 6) AS repeat_share, round(i.events / cast(greatest(i.item_age, 1) as double), 6) AS lifetime_rate FROM (
SELECT article_id, {within(d, p, 1)} AS e1, {within(d, p, 7)} AS e7, {within(d, p, 28)} AS e28, {within(d, p, 84)} AS e84, count(DISTINCT customer_id) AS buyers, count(DISTINCT t_dat) AS days, count(*) AS events, {age(d, p, 'min(t_dat)')} AS item_age FROM history GROUP BY article_id) i
LEFT JOIN (SELECT article_id, n, {age(d, p, 't_dat')} AS peak_age FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, t_dat DESC) AS rn FROM (SELECT article_id, t_dat, count(*) AS n FROM history WHERE {since(d, p, 28)} GROUP BY article_id, t_dat) x) y WHERE rn = 1) pk ON i.article_id = pk.article_id"""


@G.query
def user_rhythm(d, p):
    """Rhythm of users: windows, purchase days, gap mean, median, deviation and last, prices."""
    return f"""SELECT e.customer_id, e.e7, e.e28, e.e84, e.days, round(g.mean_gap, 5) AS mean_gap, g.median_gap, round(g.gap_sigma, 5) AS gap_sigma, g.last_gap, round(e.online, 6) AS online_share, round(e.median_price, 4) AS median_price, round(e.price_sigma, 3) AS price_sigma FROM (
SELECT customer_id, {within(d, p, 7)} AS e7, {within(d, p, 28)} AS e28, {within(d, p, 84)} AS e84, count(DISTINCT t_dat) AS days, avg(CASE WHEN channel = 2 THEN 1.0 ELSE 0.0 END) AS online, {d.median('price')} AS median_price, stddev_pop(price) AS price_sigma FROM recent GROUP BY customer_id) e
LEFT JOIN (SELECT customer_id, avg(cast(gap as double)) AS mean_gap, {d.median('gap')} AS median_gap, stddev_pop(cast(gap as double)) AS gap_sigma, {d.arg_max('gap', 't_dat')} AS last_gap FROM user_gaps WHERE gap IS NOT NULL GROUP BY customer_id) g ON e.customer_id = g.customer_id"""


@G.query
def repeat_affinity(d, p):
    """Recent counts of the candidate's type and group, and whether they match the last purchase."""
    return f"""SELECT f.customer_id, f.article_id, coalesce(t.e28, 0) AS type_e28, coalesce(g.e28, 0) AS group_e28, CASE WHEN l.product_type = a.product_type THEN 1 ELSE 0 END AS same_type_as_last, CASE WHEN l.garment_group = a.garment_group THEN 1 ELSE 0 END AS same_group_as_last, round(coalesce(1.0 / (1 + t.recency), 0), 6) AS type_strength
FROM rrf_fused_topk f JOIN articles a ON f.article_id = a.article_id LEFT JOIN affinity_long t ON t.dimension = 'product_type' AND f.customer_id = t.customer_id AND t.value = a.product_type LEFT JOIN affinity_long g ON g.dimension = 'garment_group' AND f.customer_id = g.customer_id AND g.value = a.garment_group
LEFT JOIN (SELECT customer_id, product_type, garment_group FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id) AS rn FROM typed_recent) x WHERE rn = 1) l ON f.customer_id = l.customer_id"""


@G.query
def source_features(d, p):
    """Agreement of the sources on a candidate: best and second rank, spread of log ranks, support."""
    return """SELECT customer_id, article_id, min(source_rank) AS best_rank, max(CASE WHEN rn = 2 THEN source_rank END) AS second_rank, round(stddev_pop(ln(source_rank)), 5) AS log_rank_sigma, count(CASE WHEN source_rank <= 10 THEN 1 END) AS support_10, count(CASE WHEN source_rank <= 30 THEN 1 END) AS support_30,
round(max(1.0 / source_rank) / sum(1.0 / source_rank), 6) AS best_strength FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, article_id ORDER BY source_rank, source) AS rn FROM candidates_long) x GROUP BY customer_id, article_id"""


@G.query
def category_competition(d, p):
    """Items within their type: share, rank fraction, growth against the type's."""
    return f"""SELECT article_id, product_type, round(e28 / cast(greatest(type_e28, 1) as double), 6) AS share, round(cast(rank() OVER (PARTITION BY product_type ORDER BY e28 DESC) as double) / type_items, 6) AS rank_fraction, round((e7 + 1) / (e28 / 4.0 + 1) - (type_e7 + 1) / (type_e28 / 4.0 + 1), 6) AS relative_growth FROM (
SELECT i.article_id, a.product_type, i.e7, i.e28, cast(sum(i.e28) OVER (PARTITION BY a.product_type) as bigint) AS type_e28, cast(sum(i.e7) OVER (PARTITION BY a.product_type) as bigint) AS type_e7, count(*) OVER (PARTITION BY a.product_type) AS type_items FROM item_stats i JOIN articles a ON i.article_id = a.article_id) x"""


@G.query
def price_features(d, p):
    """Item prices (median, deviation, range) and the gap to the user's prices in the type."""
    return f"""SELECT f.customer_id, f.article_id, round(i.median_price, 3) AS median_price, round(i.sigma / greatest(i.mean_price, 1e-6), 5) AS cv, round(i.top - i.low, 3) AS price_range, round(greatest(least((i.mean_price - t.mean_price) / greatest(t.sigma, 1.0), 5), -5), 4) AS standard_gap
FROM rrf_fused_topk f JOIN articles a ON f.article_id = a.article_id JOIN (SELECT article_id, {d.median('price')} AS median_price, avg(price) AS mean_price, stddev_pop(price) AS sigma, min(price) AS low, max(price) AS top FROM recent GROUP BY article_id) i ON f.article_id = i.article_id
LEFT JOIN (SELECT customer_id, product_type, avg(price) AS mean_price, stddev_pop(price) AS sigma FROM typed_recent GROUP BY customer_id, product_type) t ON f.customer_id = t.customer_id AND a.product_type = t.product_type"""


@G.query
def candidate_context(d, p):
    """Rank fraction and strength share of a signal within the user's pool; null where the user has none."""
    return """SELECT customer_id, article_id, CASE WHEN total > 0 THEN round(cast(rank() OVER (PARTITION BY customer_id ORDER BY signal DESC) as double) / n, 6) END AS rank_fraction, CASE WHEN total > 0 THEN round(signal / total, 6) END AS strength_share FROM (
SELECT f.customer_id, f.article_id, coalesce(q.events, 0) AS signal, cast(sum(coalesce(q.events, 0)) OVER (PARTITION BY f.customer_id) as double) AS total, count(*) OVER (PARTITION BY f.customer_id) AS n FROM rrf_fused_topk f LEFT JOIN pair_stats q ON f.customer_id = q.customer_id AND f.article_id = q.article_id) x"""


@G.query
def temporal_item(d, p):
    """Item counters over six windows with smoothed velocities; never-sold articles have recency 9999."""
    return f"""SELECT a.article_id, coalesce(c.e1, 0) AS e1, coalesce(c.e3, 0) AS e3, coalesce(c.e7, 0) AS e7, coalesce(c.e14, 0) AS e14, coalesce(c.e28, 0) AS e28, coalesce(c.e84, 0) AS e84, coalesce(c.buyers, 0) AS buyers, coalesce(c.first_age, 9999) AS first_age, coalesce(c.last_age, 9999) AS last_age,
round((coalesce(c.e7, 0) / 7.0 + 1e-3) / (coalesce(c.e28, 0) / 28.0 + 1e-3), 5) AS velocity_week, round((coalesce(c.e28, 0) / 28.0 + 1e-3) / (coalesce(c.e84, 0) / 84.0 + 1e-3), 5) AS velocity_month
FROM articles a LEFT JOIN (SELECT article_id, {within(d, p, 1)} AS e1, {within(d, p, 3)} AS e3, {within(d, p, 7)} AS e7, {within(d, p, 14)} AS e14, {within(d, p, 28)} AS e28, {within(d, p, 84)} AS e84, count(DISTINCT customer_id) AS buyers, {age(d, p, 'min(t_dat)')} AS first_age, {age(d, p, 'max(t_dat)')} AS last_age FROM history GROUP BY article_id) c ON a.article_id = c.article_id"""


@G.query
def asof_item_novelty(d, p):
    """Users' novelty: the item's sales strictly before each purchase day, by a running sum over item days (an as-of join without one)."""
    return """SELECT r.customer_id, count(*) AS events, round(avg(cast(s.before as double)), 5) AS mean_before, count(CASE WHEN s.before = 0 THEN 1 END) AS first_day_buys, min(s.before) AS least_before FROM recent r
JOIN (SELECT article_id, t_dat, cast(coalesce(sum(n) OVER (PARTITION BY article_id ORDER BY t_dat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as bigint) AS before FROM (SELECT article_id, t_dat, count(*) AS n FROM history GROUP BY article_id, t_dat) x) s ON r.article_id = s.article_id AND r.t_dat = s.t_dat GROUP BY r.customer_id"""


@G.query
def prior_residual(d, p):
    """Shrunken mean of each user's monthly deviation from the mean activity."""
    return f"""SELECT customer_id, count(*) AS n, round(avg(residual) * count(*) / (count(*) + 2.0), 6) AS shrunken FROM (SELECT customer_id, cast(n as double) - avg(cast(n as double)) OVER (PARTITION BY month) AS residual FROM (
SELECT customer_id, {d.month('t_dat')} AS month, count(*) AS n FROM recent GROUP BY customer_id, {d.month('t_dat')}) x) y GROUP BY customer_id"""


@G.query
def user_context(d, p):
    """Twelve-week counters, age and the largest type share of label-week users."""
    return """SELECT u.customer_id, coalesce(s.events, 0) AS events, c.age, round(coalesce(t.top_share, 0), 6) AS top_share FROM users u LEFT JOIN user_stats s ON u.customer_id = s.customer_id LEFT JOIN customers c ON u.customer_id = c.customer_id
LEFT JOIN (SELECT customer_id, max(cast(n as double) / total) AS top_share FROM (SELECT customer_id, n, cast(sum(n) OVER (PARTITION BY customer_id) as bigint) AS total FROM (SELECT customer_id, product_type, count(*) AS n FROM typed_recent GROUP BY customer_id, product_type) x) y GROUP BY customer_id) t ON u.customer_id = t.customer_id"""


@G.query
def history_shares(d, p):
    """Shares of the user's purchases per product code, type and colour, and days since the last."""
    return """SELECT customer_id, dimension, value, events, round(cast(events as double) / sum(events) OVER (PARTITION BY customer_id, dimension), 6) AS share, recency FROM affinity_long WHERE dimension IN ('product_code', 'product_type', 'colour')"""


@G.query
def history_context(d, p):
    """The latest 20 distinct items of users with their age and sales of all users."""
    return f"""SELECT x.customer_id, x.article_id, {age(d, p, 'x.last_day')} AS age_days, n.events FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, article_id) AS rn FROM (
SELECT h.customer_id, h.article_id, max(h.t_dat) AS last_day FROM history h JOIN users u ON h.customer_id = u.customer_id GROUP BY h.customer_id, h.article_id) y) x JOIN (SELECT article_id, count(*) AS events FROM history GROUP BY article_id) n ON x.article_id = n.article_id WHERE x.rn <= 20"""


@G.query
def normalized_confidence(d, p):
    """Within-user average-tie percentile, z-score and margin to the second of a score."""
    return """SELECT customer_id, article_id, round((low + (ties - 1) / 2.0 - 1) / nullif(n - 1, 0), 6) AS percentile, CASE WHEN sigma > 1e-12 THEN round((score_a - mean) / sigma, 5) END AS z, CASE WHEN sigma > 1e-12 THEN round((score_a - second) / sigma, 5) END AS margin FROM (
SELECT s.customer_id, s.article_id, s.score_a, cast(rank() OVER (PARTITION BY s.customer_id ORDER BY s.score_a) as bigint) AS low, count(*) OVER (PARTITION BY s.customer_id, s.score_a) AS ties, count(*) OVER (PARTITION BY s.customer_id) AS n, avg(s.score_a) OVER (PARTITION BY s.customer_id) AS mean, stddev_pop(s.score_a) OVER (PARTITION BY s.customer_id) AS sigma, z.second
FROM scored s JOIN (SELECT customer_id, max(CASE WHEN rn = 2 THEN score_a END) AS second FROM (SELECT customer_id, score_a, row_number() OVER (PARTITION BY customer_id ORDER BY score_a DESC, article_id) AS rn FROM scored) q GROUP BY customer_id) z ON s.customer_id = z.customer_id) x"""


@G.query
def category_codes(d, p):
    """Ordinal codes of a category fitted on training items; unseen and null are 0."""
    return """SELECT a.article_id, a.colour, coalesce(m.code, 0) AS code FROM articles a LEFT JOIN (SELECT colour, cast(row_number() OVER (ORDER BY colour) as bigint) AS code FROM (SELECT DISTINCT colour FROM typed_recent WHERE colour IS NOT NULL) x) m ON a.colour = m.colour"""


@G.query
def hard_negative_set(d, p):
    """Positives and well-ranked negatives of groups that have both."""
    return """SELECT s.customer_id, s.article_id, s.target FROM scored s JOIN (SELECT customer_id FROM scored GROUP BY customer_id HAVING sum(target) > 0 AND sum(target) < count(*)) g ON s.customer_id = g.customer_id WHERE s.target = 1 OR s.candidate_rank <= 20"""


@G.query
def feature_cutoff_audit(d, p):
    """Rows on or after the cutoff that features could see: must be none."""
    return f"SELECT count(*) AS leaked FROM recent WHERE t_dat >= {d.date(p.cutoff)}"
