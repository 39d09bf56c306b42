"""Basket-transition graphs, drift and concentration."""

from ..plans.graph import GRAPH as G


@G.relation
def transition_steps(d, p):
    """Consecutive baskets of a user."""
    return "SELECT customer_id, t_dat, next_day FROM (SELECT customer_id, t_dat, lead(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat) AS next_day FROM (SELECT DISTINCT customer_id, t_dat FROM user_days) x) y WHERE next_day IS NOT NULL"


@G.relation
def sized_days(d, p):
    return "SELECT customer_id, t_dat, article_id, count(*) OVER (PARTITION BY customer_id, t_dat) AS size FROM user_days"


@G.query
def basket_transitions(d, p):
    """Item edges of consecutive baskets, each weighted by the inverse of both sizes."""
    return "SELECT a.article_id AS src, b.article_id AS dst, count(*) AS transitions, round(sum(1.0 / (a.size * b.size)), 8) AS weight FROM transition_steps s JOIN sized_days a ON s.customer_id = a.customer_id AND s.t_dat = a.t_dat JOIN sized_days b ON s.customer_id = b.customer_id AND s.next_day = b.t_dat GROUP BY a.article_id, b.article_id"


@G.query
def type_transitions(d, p):
    """The same between product types."""
    return "SELECT x.product_type AS src, y.product_type AS dst, round(sum(t.weight), 6) AS weight FROM basket_transitions t JOIN articles x ON t.src = x.article_id JOIN articles y ON t.dst = y.article_id GROUP BY x.product_type, y.product_type"


@G.query
def edge_stats(d, p):
    """Entropy, concentration, self-loops and reciprocity of the transition graph."""
    return """SELECT count(*) AS edges, round(-sum(w * ln(w)), 5) AS entropy, round(sum(w * w), 8) AS hhi, round(max(w), 8) AS top_share, round(sum(CASE WHEN src = dst THEN w ELSE 0 END), 6) AS self_share, count(CASE WHEN back = 1 THEN 1 END) AS reciprocal_edges FROM (
SELECT a.src, a.dst, a.weight / sum(a.weight) OVER (PARTITION BY 1) AS w, CASE WHEN b.src IS NOT NULL AND a.src <> a.dst THEN 1 ELSE 0 END AS back FROM basket_transitions a LEFT JOIN basket_transitions b ON a.src = b.dst AND a.dst = b.src) x"""


@G.query
def out_degrees(d, p):
    """Quantiles of out-degrees and the mean directional entropy."""
    return f"SELECT count(*) AS sources, {d.median('cast(degree as double)')} AS p50, {d.quantile('cast(degree as double)', 0.9)} AS p90, max(degree) AS most, round(avg(entropy), 6) AS mean_entropy FROM (SELECT src, count(*) AS degree, -sum(w * ln(w)) AS entropy FROM (SELECT src, weight / sum(weight) OVER (PARTITION BY src) AS w FROM basket_transitions) x GROUP BY src) y"


@G.relation
def preference_counts(d, p):
    c = d.date(p.cutoff)
    return f"SELECT r.customer_id, a.product_type, count(CASE WHEN r.t_dat >= {d.shift(c, -p.history_days // 3)} THEN 1 END) AS n_new, count(CASE WHEN r.t_dat < {d.shift(c, -p.history_days // 3)} THEN 1 END) AS n_old FROM recent r JOIN articles a ON r.article_id = a.article_id GROUP BY r.customer_id, a.product_type"


@G.query
def preference_drift(d, p):
    """Per user: Jensen-Shannon divergence (base 2) and cosine of recent against past type preferences."""
    return """SELECT customer_id, round(sum(0.5 * CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END + 0.5 * CASE WHEN o > 0 THEN o * log2(o / m) ELSE 0 END), 5) AS jsd, round(sum(q * o) / (sqrt(sum(q * q)) * sqrt(sum(o * o))), 6) AS cosine FROM (
SELECT customer_id, q, o, (q + o) / 2 AS m FROM (SELECT customer_id, n_new / cast(sum(n_new) OVER (PARTITION BY customer_id) as double) AS q, n_old / cast(sum(n_old) OVER (PARTITION BY customer_id) as double) AS o FROM (
SELECT * FROM (SELECT *, sum(n_new) OVER (PARTITION BY customer_id) AS tn, sum(n_old) OVER (PARTITION BY customer_id) AS tt FROM preference_counts) w WHERE tn >= 3 AND tt >= 3) x) y) z WHERE m > 0 GROUP BY customer_id"""


@G.query
def transition_agreement(d, p):
    """Per user: cosine of own against global type transitions."""
    return """SELECT u.customer_id, count(*) AS kinds, round(sum(u.w * g.weight) / (sqrt(sum(u.w * u.w)) * max(g.norm)), 6) AS cosine FROM (SELECT s.customer_id, x.product_type AS src, y.product_type AS dst, sum(1.0 / (a.size * b.size)) AS w FROM transition_steps s JOIN sized_days a ON s.customer_id = a.customer_id AND s.t_dat = a.t_dat JOIN sized_days b ON s.customer_id = b.customer_id AND s.next_day = b.t_dat
JOIN articles x ON a.article_id = x.article_id JOIN articles y ON b.article_id = y.article_id GROUP BY s.customer_id, x.product_type, y.product_type) u JOIN (SELECT src, dst, weight, sqrt(sum(weight * weight) OVER (PARTITION BY 1)) AS norm FROM type_transitions) g ON u.src = g.src AND u.dst = g.dst GROUP BY u.customer_id"""


@G.query
def concentration(d, p):
    """Support, entropy, HHI and top share of types."""
    return "SELECT count(*) AS support, round(-sum(s * ln(s)), 6) AS entropy, round(sum(s * s), 6) AS hhi, round(max(s), 6) AS top FROM (SELECT n / cast(sum(n) OVER (PARTITION BY 1) as double) AS s FROM (SELECT product_type, count(*) AS n FROM typed_recent GROUP BY product_type) x) y"


@G.query
def popularity_rank_correlation(d, p):
    """Overlap and Spearman correlation of the 200 best sellers of two half-windows."""
    c, h = d.date(p.cutoff), p.history_days // 2
    top = lambda where: f"SELECT article_id, cast(row_number() OVER (ORDER BY n DESC, article_id) as double) AS rk FROM (SELECT article_id, count(*) AS n FROM recent WHERE {where} GROUP BY article_id ORDER BY n DESC, article_id LIMIT 200) x"
    return f"SELECT count(*) AS both, round(coalesce(corr(a.rk, b.rk), 0), 6) AS spearman FROM ({top(f't_dat >= {d.shift(c, -h)}')}) a JOIN ({top(f't_dat < {d.shift(c, -h)}')}) b ON a.article_id = b.article_id"


@G.query
def catalogue_turnover(d, p):
    """Items sold only before, only after, and on both sides of the middle of the window."""
    c, h = d.date(p.cutoff), p.history_days // 2
    return f"SELECT CASE WHEN n = 0 THEN 'gone' WHEN o = 0 THEN 'new' ELSE 'both' END AS kind, count(*) AS items FROM (SELECT article_id, count(CASE WHEN t_dat >= {d.shift(c, -h)} THEN 1 END) AS n, count(CASE WHEN t_dat < {d.shift(c, -h)} THEN 1 END) AS o FROM recent GROUP BY article_id) x GROUP BY CASE WHEN n = 0 THEN 'gone' WHEN o = 0 THEN 'new' ELSE 'both' END"


@G.query
def category_entropy(d, p):
    """Per user: type entropy, top share and number of types."""
    return "SELECT customer_id, round(-sum(s * ln(s)), 6) AS entropy, round(max(s), 6) AS top_share, count(*) AS types FROM (SELECT customer_id, n / cast(sum(n) OVER (PARTITION BY customer_id) as double) AS s FROM (SELECT customer_id, product_type, count(*) AS n FROM typed_recent GROUP BY customer_id, product_type) x) y GROUP BY customer_id"


@G.query
def support_matrix(d, p):
    """Symmetric co-purchase support of type pairs with the age of the last one."""
    return f"SELECT x.product_type AS a, y.product_type AS b, count(*) AS support, {d.days('max(l.t_dat)', d.date(p.cutoff))} AS last_age FROM baskets l JOIN baskets r ON l.customer_id = r.customer_id AND l.t_dat = r.t_dat JOIN articles x ON l.article_id = x.article_id JOIN articles y ON r.article_id = y.article_id WHERE l.article_id < r.article_id GROUP BY x.product_type, y.product_type"


@G.query
def warm_proxies(d, p):
    """The nearest warm items of every hidden item of a type, the same type first."""
    cosine = f"round({d.dot('a.vector', 'b.vector')} / (sqrt({d.dot('a.vector', 'a.vector')}) * sqrt({d.dot('b.vector', 'b.vector')})), 6)"
    return f"""SELECT article_id, proxy, same_type, cosine FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY same_type DESC, cosine DESC, proxy) AS rn FROM (SELECT c.article_id, b.article_id AS proxy, CASE WHEN c.product_type = x.product_type THEN 1 ELSE 0 END AS same_type, {cosine} AS cosine
FROM cold_items c JOIN item_vectors a ON c.article_id = a.article_id JOIN warm_catalogue w ON true JOIN item_vectors b ON w.article_id = b.article_id AND b.article_id <> c.article_id JOIN articles x ON b.article_id = x.article_id) z) y WHERE rn <= 3""".replace("JOIN warm_catalogue w ON true JOIN item_vectors b ON w.article_id = b.article_id AND b.article_id <> c.article_id", "JOIN item_vectors b ON b.article_id <> c.article_id JOIN warm_catalogue w ON w.article_id = b.article_id")


@G.query
def neighbour_graph_overlap(d, p):
    """Overlap of the co-visit and the vector neighbour graphs per anchor."""
    return "SELECT k.anchor, count(*) AS neighbours, count(c.dst) AS shared FROM item_knn k LEFT JOIN covisit_neighbors c ON k.anchor = c.src AND k.neighbour = c.dst GROUP BY k.anchor"


@G.query
def half_life_sensitivity(d, p):
    """Mean rank shift of the seeds' scores (decayed log sales) between two half-lives."""
    return "SELECT customer_id, round(avg(cast(abs(a - b) as double)), 6) AS shift FROM (SELECT customer_id, rank() OVER (PARTITION BY customer_id ORDER BY round(pow(0.5, age_days / 14.0) * ln(1 + events), 8) DESC) AS a, rank() OVER (PARTITION BY customer_id ORDER BY round(pow(0.5, age_days / 56.0) * ln(1 + events), 8) DESC) AS b FROM (SELECT s.customer_id, s.age_days, i.events FROM user_seeds s JOIN item_stats i ON s.article_id = i.article_id) k) x GROUP BY customer_id"
