"""Candidate generators: (customer_id, article_id, source_rank, source_score)."""

from ..plans.graph import GRAPH as G


def ranked(scored: str, k: int, order: str = "score DESC, last_day DESC, article_id") -> str:
    """The first k candidates of each user; scores are rounded so that equal scores tie."""
    return f"""SELECT customer_id, article_id, source_rank, score AS source_score FROM (SELECT customer_id, article_id, score, cast(row_number() OVER (PARTITION BY customer_id ORDER BY {order}) as bigint) AS source_rank FROM ({scored}) s) r WHERE source_rank <= {k}"""


def decay(d, p, half_life: float, day: str = "t_dat") -> str:
    return f"pow(2.0, -{d.days(day, d.date(p.cutoff))} / {half_life:.1f})"


@G.relation
def popularity(d, p):
    """Half-life popularity of every item in the popularity window."""
    return f"""SELECT article_id, round(sum({decay(d, p, 7)}), 8) AS popularity, count(*) AS events FROM {d.since(p, p.popular_days)} WHERE t_dat >= {d.shift(d.date(p.cutoff), -p.popular_days)} GROUP BY article_id"""


@G.query
def src_repurchase(d, p):
    """Own items again: decayed recency times log frequency."""
    return ranked(f"SELECT r.customer_id, article_id, max(t_dat) AS last_day, round({decay(d, p, 14, 'max(t_dat)')} * (1 + ln(count(*))), 8) AS score FROM recent r JOIN users u ON r.customer_id = u.customer_id GROUP BY r.customer_id, article_id", p.source_k)


@G.relation
def top_popular(d, p):
    return f"SELECT article_id, popularity, cast(row_number() OVER (ORDER BY popularity DESC, article_id) as bigint) AS source_rank FROM (SELECT article_id, popularity FROM popularity ORDER BY popularity DESC, article_id LIMIT {p.source_k}) t"


@G.query
def src_recent_popularity(d, p):
    """The globally most popular items for every user; the small side is the top list."""
    return "SELECT u.customer_id, t.article_id, t.source_rank, t.popularity AS source_score FROM users u CROSS JOIN top_popular t"


@G.query
def src_product_family(d, p):
    """Siblings of the user's products, by seed strength and popularity."""
    return ranked(f"""SELECT s.customer_id, a.article_id, s.last_day, round(s.strength * (1 + ln(1 + coalesce(q.popularity, 0))), 8) AS score
FROM (SELECT r.customer_id, x.product_code, max(r.t_dat) AS last_day, {decay(d, p, 21, 'max(r.t_dat)')} * (1 + ln(count(*))) AS strength FROM recent r JOIN users u ON r.customer_id = u.customer_id JOIN articles x ON r.article_id = x.article_id GROUP BY r.customer_id, x.product_code) s
JOIN articles a ON s.product_code = a.product_code LEFT JOIN popularity q ON a.article_id = q.article_id""", p.source_k)


@G.query
def src_segment_popularity(d, p):
    """The most popular items of the user's age bucket."""
    return f"""SELECT u.customer_id, t.article_id, t.source_rank, t.score AS source_score FROM users u JOIN user_bucket b ON u.customer_id = b.customer_id JOIN (
SELECT bucket, article_id, score, cast(row_number() OVER (PARTITION BY bucket ORDER BY score DESC, article_id) as bigint) AS source_rank FROM (
SELECT b.bucket, h.article_id, round(sum({decay(d, p, 7, 'h.t_dat')}), 8) AS score FROM {d.since(p, p.popular_days)} h JOIN user_bucket b ON h.customer_id = b.customer_id WHERE h.t_dat >= {d.shift(d.date(p.cutoff), -p.popular_days)} GROUP BY b.bucket, h.article_id) s) t
ON b.bucket = t.bucket WHERE t.source_rank <= {p.source_k}"""


@G.relation
def user_days(d, p):
    """Distinct items per user and day; baskets are those of 2 to the cap."""
    return f"SELECT DISTINCT customer_id, t_dat, article_id FROM {d.since(p, p.covisit_days)} WHERE t_dat >= {d.shift(d.date(p.cutoff), -p.covisit_days)}"


@G.relation
def baskets(d, p):
    return f"SELECT x.customer_id, x.t_dat, x.article_id FROM user_days x JOIN (SELECT customer_id, t_dat FROM user_days GROUP BY customer_id, t_dat HAVING count(*) BETWEEN 2 AND {p.basket_cap}) b ON x.customer_id = b.customer_id AND x.t_dat = b.t_dat"


@G.relation
def covisit_edges(d, p):
    """Directed cosine edges of items bought together; the basket cap bounds the pairs of a basket."""
    return f"""SELECT e.src, e.dst, e.pairs, round(e.pairs / sqrt(cast(a.n as double) * b.n), 8) AS similarity FROM (
SELECT src, dst, count(*) AS pairs FROM (
SELECT l.article_id AS src, r.article_id AS dst FROM baskets l JOIN baskets r ON l.customer_id = r.customer_id AND l.t_dat = r.t_dat WHERE l.article_id <> r.article_id) x GROUP BY src, dst HAVING count(*) >= {p.min_pairs}) e
JOIN basket_counts a ON e.src = a.article_id JOIN basket_counts b ON e.dst = b.article_id"""


@G.relation
def basket_counts(d, p):
    return "SELECT article_id, count(*) AS n FROM baskets GROUP BY article_id"


@G.query
def covisit_neighbors(d, p):
    """The nearest items of every item by co-purchase cosine."""
    return f"SELECT src, dst, pairs, similarity, neighbour_rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY src ORDER BY similarity DESC, pairs DESC, dst) as bigint) AS neighbour_rank FROM covisit_edges) e WHERE neighbour_rank <= {p.neighbours}"


@G.query
def src_covisit(d, p):
    """Neighbours of the user's recent items, by seed strength and similarity."""
    return ranked(f"""SELECT s.customer_id, n.dst AS article_id, max(s.last_day) AS last_day, round({d.total('s.strength * n.similarity')}, 8) AS score
FROM (SELECT r.customer_id, r.article_id, max(r.t_dat) AS last_day, {decay(d, p, 14, 'max(r.t_dat)')} AS strength FROM recent r JOIN users u ON r.customer_id = u.customer_id GROUP BY r.customer_id, r.article_id) s
JOIN covisit_neighbors n ON s.article_id = n.src GROUP BY s.customer_id, n.dst""", p.source_k)


@G.relation
def pooled_articles(d, p):
    """Popular articles per product type and garment group, the pools of the content source."""
    return """SELECT a.*, coalesce(q.popularity, 0) AS popularity, cast(row_number() OVER (PARTITION BY a.product_type ORDER BY coalesce(q.popularity, 0) DESC, a.article_id) as bigint) AS type_rank,
cast(row_number() OVER (PARTITION BY a.garment_group ORDER BY coalesce(q.popularity, 0) DESC, a.article_id) as bigint) AS group_rank FROM articles a LEFT JOIN popularity q ON a.article_id = q.article_id"""


@G.query
def src_attribute_content(d, p):
    """Pool articles that share attributes with the user's latest seeds."""
    bonus = "CASE WHEN s.index_group = c.index_group THEN 1.0 ELSE 0.0 END + CASE WHEN s.department = c.department THEN 0.5 ELSE 0.0 END + CASE WHEN s.colour = c.colour THEN 0.25 ELSE 0.0 END"
    seeds = f"""SELECT z.customer_id, z.last_day, z.strength, x.product_type, x.garment_group, x.department, x.index_group, x.colour, z.article_id FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY strength DESC, last_day DESC, article_id) AS rn FROM (
SELECT r.customer_id, r.article_id, max(r.t_dat) AS last_day, round({decay(d, p, 21, 'max(r.t_dat)')} * (1 + ln(count(*))), 8) AS strength FROM recent r JOIN users u ON r.customer_id = u.customer_id GROUP BY r.customer_id, r.article_id) y) z
JOIN articles x ON z.article_id = x.article_id WHERE z.rn <= {p.content_seeds}"""
    lane = lambda key, rank, k, base: f"SELECT s.customer_id, c.article_id, s.last_day, s.strength * ({base} + {bonus}) * (1 + ln(1 + c.popularity)) AS part FROM ({seeds}) s JOIN pooled_articles c ON s.{key} = c.{key} WHERE c.{rank} <= {k}"
    return ranked(f"SELECT customer_id, article_id, max(last_day) AS last_day, round(sum(part), 8) AS score FROM ({lane('product_type', 'type_rank', p.type_pool, 3.0)} UNION ALL {lane('garment_group', 'group_rank', p.group_pool, 1.5)}) b GROUP BY customer_id, article_id", p.source_k)


@G.query
def baseline_top12(d, p):
    """Repurchase list fused with popularity by fixed reciprocal ranks; popularity falls back to the full history when its window is empty."""
    return f"""SELECT customer_id, article_id, final_rank FROM (SELECT customer_id, article_id, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) as bigint) AS final_rank FROM (
SELECT customer_id, article_id, round(sum(part), 8) AS score FROM (
SELECT customer_id, article_id, 2.0 / (10 + rank_own) AS part FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, events DESC, article_id) AS rank_own FROM (
SELECT r.customer_id, r.article_id, max(r.t_dat) AS last_day, count(*) AS events FROM recent r JOIN users u ON r.customer_id = u.customer_id GROUP BY r.customer_id, r.article_id) a) b WHERE rank_own <= {p.candidate_k}
UNION ALL SELECT u.customer_id, t.article_id, 1.0 / (10 + t.source_rank) AS part FROM users u CROSS JOIN fallback_popular t) c GROUP BY customer_id, article_id) e) f WHERE final_rank <= {p.metric_k}"""


@G.relation
def fallback_popular(d, p):
    any_recent = "(SELECT count(*) FROM popularity)"
    return f"""SELECT article_id, cast(row_number() OVER (ORDER BY score DESC, article_id) as bigint) AS source_rank FROM (SELECT article_id, score FROM (
SELECT article_id, popularity AS score FROM popularity UNION ALL SELECT article_id, round(sum({decay(d, p, 7)}), 8) AS score FROM history WHERE {any_recent} = 0 GROUP BY article_id) x ORDER BY score DESC, article_id LIMIT {p.source_k}) y"""


@G.query
def purchase_sequences(d, p):
    """Distinct (day, item) sequences of customers, ordered by day, digest, item."""
    order = f"t_dat, md5(concat({d.text('article_id')}, '-{p.seed}')), article_id"
    return f"SELECT customer_id, count(*) AS events, {d.joined(d.text('article_id'), order, ' ')} AS items FROM (SELECT DISTINCT customer_id, t_dat, article_id FROM recent) x GROUP BY customer_id HAVING count(*) >= 2"


@G.query
def user_seeds(d, p):
    """The latest distinct items of each user that have a vector, with a half-life weight."""
    return f"""SELECT customer_id, article_id, age_days, seed_rank, round(pow(0.5, age_days / 28.0), 8) AS weight FROM (
SELECT customer_id, article_id, {d.days('last_day', d.date(p.cutoff))} AS age_days, cast(row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, article_id) as bigint) AS seed_rank FROM (
SELECT r.customer_id, r.article_id, max(r.t_dat) AS last_day FROM recent r JOIN users u ON r.customer_id = u.customer_id JOIN item_vectors v ON r.article_id = v.article_id GROUP BY r.customer_id, r.article_id) x) y WHERE seed_rank <= {p.seeds}"""


@G.relation
def unit_components(d, p):
    """Unit vectors by component, the form in which cosines are sums over an equi-join."""
    return f"""SELECT c.article_id, c.i, c.x / n.norm AS x FROM ({d.spread('article_id', 'vector', 'i', 'x', 'item_vectors')}) c
JOIN (SELECT article_id, sqrt(sum(x * x)) AS norm FROM ({d.spread('article_id', 'vector', 'i', 'x', 'item_vectors')}) y GROUP BY article_id HAVING sum(x * x) > 0) n ON c.article_id = n.article_id"""


@G.relation
def seed_items(d, p):
    return "SELECT DISTINCT article_id FROM user_seeds"


@G.query
def item_knn(d, p):
    """Exact nearest items by cosine for every seed item, itself excluded, ties by id."""
    cosine = d.dot("a.vector", "b.vector")
    norm = lambda t: f"sqrt({d.dot(f'{t}.vector', f'{t}.vector')})"
    return f"""SELECT anchor, neighbour, neighbour_rank, cosine FROM (SELECT anchor, neighbour, cosine, cast(row_number() OVER (PARTITION BY anchor ORDER BY cosine DESC, neighbour) as bigint) AS neighbour_rank FROM (
SELECT a.article_id AS anchor, b.article_id AS neighbour, round({cosine} / ({norm('a')} * {norm('b')}), 6) AS cosine FROM item_vectors a JOIN seed_items s ON a.article_id = s.article_id JOIN item_vectors b ON a.article_id <> b.article_id) c) r WHERE neighbour_rank <= {p.knn}"""


@G.relation
def seed_neighbours(d, p):
    return "SELECT s.customer_id, s.seed_rank, s.age_days, s.weight, n.neighbour AS article_id, n.neighbour_rank, n.cosine, round(n.cosine / (1 + 0.1 * (s.seed_rank - 1)) + 1e-12, 6) AS weighted FROM user_seeds s JOIN item_knn n ON s.article_id = n.anchor"


@G.query
def src_item_neighbours(d, p):
    """Vector neighbours of the seeds: best weighted cosine, seed support, top-three mean."""
    return f"""SELECT customer_id, article_id, source_rank, weighted AS source_score, cosine, support, mean_weighted, top3 FROM (
SELECT b.customer_id, b.article_id, b.weighted, b.cosine, a.support, a.mean_weighted, a.top3, cast(row_number() OVER (PARTITION BY b.customer_id ORDER BY b.weighted DESC, b.cosine DESC, b.article_id) as bigint) AS source_rank FROM (
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, article_id ORDER BY weighted DESC, cosine DESC, seed_rank, neighbour_rank) AS rn FROM seed_neighbours) x WHERE rn = 1) b
JOIN (SELECT customer_id, article_id, count(*) AS support, round(avg(weighted) + 1e-12, 6) AS mean_weighted, round(avg(CASE WHEN rn <= 3 THEN weighted END) + 1e-12, 6) AS top3 FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id, article_id ORDER BY weighted DESC, seed_rank) AS rn FROM seed_neighbours) y GROUP BY customer_id, article_id) a ON b.customer_id = a.customer_id AND b.article_id = a.article_id) z WHERE source_rank <= {p.item_candidates}"""


@G.query
def seed_direct_features(d, p):
    """Per user and candidate: best raw and decayed cosine, age and rank of the best seed, support, margin to the second."""
    return """SELECT customer_id, article_id, max(cosine) AS best_cosine, round(max(cosine * weight), 6) AS best_decayed, max(CASE WHEN rn = 1 THEN age_days END) AS age_at_best, max(CASE WHEN rn = 1 THEN seed_rank END) AS rank_at_best,
count(*) AS support, round(max(CASE WHEN rn = 1 THEN cosine END) - coalesce(max(CASE WHEN rn = 2 THEN cosine END), 0), 6) AS margin
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, article_id ORDER BY cosine DESC, seed_rank) AS rn FROM seed_neighbours) x GROUP BY customer_id, article_id"""


@G.relation
def type_season(d, p):
    """Product types with their share a year before the label week against the quarter around it."""
    c = d.date(p.cutoff)
    return f"""SELECT product_type, e28, e84, round((e28 / 28.0) / ((e84 + 1) / 84.0), 8) AS lift FROM (
SELECT a.product_type, count(CASE WHEN h.t_dat >= {d.shift(c, -364 - 14)} AND h.t_dat < {d.shift(c, -364 + 14)} THEN 1 END) AS e28, count(CASE WHEN h.t_dat >= {d.shift(c, -364 - 42)} AND h.t_dat < {d.shift(c, -364 + 42)} THEN 1 END) AS e84
FROM history h JOIN articles a ON h.article_id = a.article_id GROUP BY a.product_type) x"""


@G.query
def src_seasonal(d, p):
    """Three lanes (own types in season, seasonal global, last year's items) fused by reciprocal ranks."""
    c = d.date(p.cutoff)
    return f"""SELECT customer_id, article_id, source_rank, score AS source_score FROM (SELECT customer_id, article_id, score, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) as bigint) AS source_rank FROM (
SELECT customer_id, article_id, round(sum(1.0 / ({p.rrf} + lane_rank)), 8) AS score FROM (
SELECT customer_id, article_id, lane_rank FROM (SELECT f.customer_id, q.article_id, row_number() OVER (PARTITION BY f.customer_id ORDER BY round(f.share * ln(s.lift + 1) * ln(1 + q.events), 8) DESC, q.article_id) AS lane_rank
FROM (SELECT r.customer_id, a.product_type, cast(count(*) as double) / sum(count(*)) OVER (PARTITION BY r.customer_id) AS share FROM recent r JOIN users u ON r.customer_id = u.customer_id JOIN articles a ON r.article_id = a.article_id GROUP BY r.customer_id, a.product_type) f
JOIN seasonal_types s ON f.product_type = s.product_type JOIN typed_popular q ON s.product_type = q.product_type) l1 WHERE lane_rank <= {p.global_k}
UNION ALL SELECT u.customer_id, g.article_id, g.lane_rank FROM users u CROSS JOIN (SELECT q.article_id, row_number() OVER (ORDER BY round(q.popularity * s.lift, 8) DESC, q.article_id) AS lane_rank FROM typed_popular q JOIN seasonal_types s ON q.product_type = s.product_type) g WHERE g.lane_rank <= {p.global_k}
UNION ALL SELECT u.customer_id, g.article_id, g.lane_rank FROM users u CROSS JOIN (SELECT article_id, row_number() OVER (ORDER BY n DESC, article_id) AS lane_rank FROM (SELECT article_id, count(*) AS n FROM history WHERE t_dat >= {d.shift(c, -364)} AND t_dat < {d.shift(c, -364 + 28)} GROUP BY article_id) y) g WHERE g.lane_rank <= {p.global_k}
) lanes GROUP BY customer_id, article_id) z) w WHERE source_rank <= {p.source_k}"""


@G.relation
def seasonal_types(d, p):
    return f"SELECT product_type, lift FROM type_season WHERE e84 >= {p.min_prior_events} AND lift >= 0.9"


@G.relation
def typed_popular(d, p):
    return f"SELECT * FROM (SELECT q.article_id, a.product_type, q.popularity, q.events, row_number() OVER (PARTITION BY a.product_type ORDER BY q.popularity DESC, q.article_id) AS tr FROM popularity q JOIN articles a ON q.article_id = a.article_id) x WHERE tr <= 30"


@G.relation
def cold_lifts(d, p):
    """Cold items with the shrunken seasonal lifts of their attributes, summed."""
    c = d.date(p.cutoff)
    lift = lambda f, shrink: f"""SELECT {f}, e28, greatest(ln((e28 + 1.0) / 28 / ((e84 + 1.0) / 84)), 0) * e28 / (e28 + {shrink}.0) AS part FROM (SELECT a.{f}, count(CASE WHEN h.t_dat >= {d.shift(c, -28)} THEN 1 END) AS e28, count(*) AS e84 FROM {d.since(p, 84)} h JOIN articles a ON h.article_id = a.article_id WHERE h.t_dat >= {d.shift(c, -84)} GROUP BY a.{f}) s"""
    return f"""SELECT a.article_id, a.product_type, round(coalesce(t.part, 0) + coalesce(g.part, 0) + coalesce(co.part, 0), 8) AS score FROM cold_items a LEFT JOIN ({lift('product_type', 50)}) t ON a.product_type = t.product_type LEFT JOIN ({lift('garment_group', 30)}) g ON a.garment_group = g.garment_group LEFT JOIN ({lift('colour', 30)}) co ON a.colour = co.colour"""


@G.query
def src_cold_season(d, p):
    """Cold items in two lanes fused by reciprocal ranks: the global order of their seasonal lifts, and that of each user's types by share times lift."""
    return f"""SELECT customer_id, article_id, source_rank, score AS source_score FROM (SELECT customer_id, article_id, score, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) as bigint) AS source_rank FROM (
SELECT customer_id, article_id, round(sum(1.0 / ({p.rrf} + lane_rank)), 8) AS score FROM (
SELECT u.customer_id, k.article_id, k.lane_rank FROM users u CROSS JOIN (SELECT article_id, cast(row_number() OVER (ORDER BY score DESC, article_id) as bigint) AS lane_rank FROM (SELECT * FROM cold_lifts ORDER BY score DESC, article_id LIMIT {p.global_k}) f) k
UNION ALL SELECT customer_id, article_id, lane_rank FROM (SELECT s.customer_id, x.article_id, cast(row_number() OVER (PARTITION BY s.customer_id ORDER BY round(s.share * (x.score + 0.01), 8) DESC, x.article_id) as bigint) AS lane_rank
FROM (SELECT r.customer_id, r.product_type, cast(count(*) as double) / sum(count(*)) OVER (PARTITION BY r.customer_id) AS share FROM typed_recent r JOIN users u ON r.customer_id = u.customer_id GROUP BY r.customer_id, r.product_type) s JOIN cold_lifts x ON s.product_type = x.product_type) l WHERE lane_rank <= {p.global_k}
) lanes GROUP BY customer_id, article_id) z) w WHERE source_rank <= {p.global_k}"""


@G.relation
def cold_items(d, p):
    """Articles never sold before the cutoff."""
    return "SELECT a.* FROM articles a LEFT JOIN warm_catalogue w ON a.article_id = w.article_id WHERE w.article_id IS NULL"


@G.query
def src_cold_content(d, p):
    """Hidden items by the seeds' weighted cosines: best, top-three mean, support."""
    cosine = f"{d.dot('a.vector', 'b.vector')} / (sqrt({d.dot('a.vector', 'a.vector')}) * sqrt({d.dot('b.vector', 'b.vector')}))"
    return f"""SELECT customer_id, article_id, source_rank, score AS source_score, top3, support FROM (SELECT *, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) as bigint) AS source_rank FROM (
SELECT customer_id, article_id, max(weighted) AS score, round(avg(CASE WHEN rn <= 3 THEN weighted END) + 1e-12, 6) AS top3, count(CASE WHEN weighted > 0 THEN 1 END) AS support FROM (
SELECT s.customer_id, n.article_id, round(s.weight * n.cosine, 6) AS weighted, row_number() OVER (PARTITION BY s.customer_id, n.article_id ORDER BY round(s.weight * n.cosine, 6) DESC, s.seed_rank) AS rn FROM user_seeds s JOIN (
SELECT a.article_id AS anchor, b.article_id, {cosine} AS cosine FROM seed_items i JOIN item_vectors a ON i.article_id = a.article_id JOIN item_vectors b ON a.article_id <> b.article_id JOIN cold_items c ON b.article_id = c.article_id) n ON s.article_id = n.anchor) x GROUP BY customer_id, article_id) y) z WHERE source_rank <= {p.source_k}"""


@G.query
def history_reentry(d, p):
    """All-history repurchases that the fused pool lacks, by recency band, with truth found."""
    return f"""SELECT band, count(*) AS pairs, count(t.article_id) AS truth_pairs FROM (SELECT x.customer_id, x.article_id, CASE WHEN age <= 28 THEN '<=28' WHEN age <= 84 THEN '<=84' WHEN age <= 364 THEN '<=364' ELSE '>364' END AS band FROM (
SELECT h.customer_id, h.article_id, {d.days('max(h.t_dat)', d.date(p.cutoff))} AS age FROM history h JOIN users u ON h.customer_id = u.customer_id GROUP BY h.customer_id, h.article_id) x
WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = x.customer_id AND f.article_id = x.article_id)) y LEFT JOIN truth t ON y.customer_id = t.customer_id AND y.article_id = t.article_id GROUP BY band"""


@G.query
def popular_cascade(d, p):
    """Deeper popularity for all users: marginal truth outside the pool by rank band."""
    return """SELECT band, count(*) AS pairs, count(t.article_id) AS truth_pairs FROM (SELECT s.customer_id, s.article_id, CASE WHEN s.source_rank <= 10 THEN 1 WHEN s.source_rank <= 20 THEN 2 ELSE 3 END AS band FROM src_recent_popularity s
WHERE NOT EXISTS (SELECT 1 FROM src_repurchase f WHERE f.customer_id = s.customer_id AND f.article_id = s.article_id)) y LEFT JOIN truth t ON y.customer_id = t.customer_id AND y.article_id = t.article_id GROUP BY band"""


@G.query
def covisit_popular_consensus(d, p):
    """Items that both popularity and co-visitation propose and the user never bought."""
    return """SELECT s.customer_id, s.article_id, s.source_rank AS popular_rank, c.source_rank AS covisit_rank FROM src_segment_popularity s JOIN src_covisit c ON s.customer_id = c.customer_id AND s.article_id = c.article_id
LEFT JOIN src_repurchase r ON s.customer_id = r.customer_id AND s.article_id = r.article_id WHERE r.article_id IS NULL"""


@G.query
def profile_proxies(d, p):
    """Popular items of the garment groups a user bought last and most."""
    return f"""SELECT customer_id, article_id, min(lane) AS lane, min(item_rank) AS item_rank FROM (SELECT g.customer_id, g.lane, t.article_id, t.item_rank FROM (
SELECT customer_id, garment_group, CASE WHEN by_count = 1 THEN 'first' WHEN by_day = 1 THEN 'recent' ELSE 'top3' END AS lane FROM (SELECT customer_id, garment_group, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, garment_group) AS by_count, row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, garment_group) AS by_day FROM (
SELECT r.customer_id, a.garment_group, count(*) AS n, max(r.t_dat) AS last_day FROM recent r JOIN users u ON r.customer_id = u.customer_id JOIN articles a ON r.article_id = a.article_id GROUP BY r.customer_id, a.garment_group) x) y WHERE by_count <= 3 OR by_day = 1) g
JOIN (SELECT garment_group, article_id, cast(group_rank as bigint) AS item_rank FROM pooled_articles WHERE group_rank <= 10) t ON g.garment_group = t.garment_group) z GROUP BY customer_id, article_id"""


@G.relation
def user_profiles(d, p):
    return f"SELECT customer_id, article_id, sum(pow(0.5, {d.days('t_dat', d.date(p.cutoff))} / 28.0)) AS w FROM recent GROUP BY customer_id, article_id"


@G.relation
def user_postings(d, p):
    """Each item's buyers, the most recent first."""
    return f"SELECT * FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY article_id ORDER BY recency, customer_id) AS posting FROM pair_stats) x WHERE posting <= {p.postings}"


@G.relation
def user_pool(d, p):
    """The other users that each user's items lead to: a budget of postings shared evenly among the items, the most recent buyers first."""
    return f"""SELECT DISTINCT a.customer_id, b.customer_id AS other FROM (SELECT s.customer_id, s.article_id, floor({p.postings} / cast(count(*) OVER (PARTITION BY s.customer_id) as double)) AS quota FROM pair_stats s JOIN users u ON s.customer_id = u.customer_id) a
JOIN user_postings b ON a.article_id = b.article_id WHERE a.customer_id <> b.customer_id AND b.posting <= a.quota"""


@G.query
def src_user_knn(d, p):
    """Items of the hundred most similar users of each user's pool, by the cosine of whole profiles."""
    return ranked(f"""SELECT n.customer_id, q.article_id, round(sum(n.similarity * q.w / t.l1) / max(n.total), 8) AS score FROM (
SELECT customer_id, other, similarity, sum(similarity) OVER (PARTITION BY customer_id) AS total FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY similarity DESC, other) AS rn FROM (
SELECT k.customer_id, k.other, round(sum(a.w * b.w) / (max(na.norm) * max(nb.norm)), 8) AS similarity FROM user_pool k JOIN user_profiles a ON k.customer_id = a.customer_id JOIN user_profiles b ON k.other = b.customer_id AND a.article_id = b.article_id
JOIN profile_norms na ON k.customer_id = na.customer_id JOIN profile_norms nb ON k.other = nb.customer_id GROUP BY k.customer_id, k.other) x WHERE similarity > 0) z WHERE rn <= 100) n
JOIN user_profiles q ON n.other = q.customer_id JOIN profile_norms t ON n.other = t.customer_id GROUP BY n.customer_id, q.article_id""", p.source_k, "score DESC, article_id")


@G.relation
def profile_norms(d, p):
    return "SELECT customer_id, sqrt(sum(w * w)) AS norm, sum(w) AS l1 FROM user_profiles GROUP BY customer_id"


@G.query
def pseudo_cold_pool(d, p):
    """Fused items that sell in general but that the user never bought."""
    return f"""SELECT f.customer_id, f.article_id, f.candidate_rank FROM rrf_fused_topk f JOIN (SELECT article_id FROM history GROUP BY article_id HAVING count(*) > 5) g ON f.article_id = g.article_id
WHERE f.candidate_rank <= 50 AND NOT EXISTS (SELECT 1 FROM history h WHERE h.customer_id = f.customer_id AND h.article_id = f.article_id)"""


@G.query
def append_unseen(d, p):
    """Vector neighbours that the pool lacks, appended after each user's last rank."""
    return """SELECT n.customer_id, n.article_id, coalesce(m.last_rank, 0) + cast(row_number() OVER (PARTITION BY n.customer_id ORDER BY n.source_rank) as bigint) AS candidate_rank FROM src_item_neighbours n
LEFT JOIN (SELECT customer_id, max(candidate_rank) AS last_rank FROM rrf_fused_topk GROUP BY customer_id) m ON n.customer_id = m.customer_id
WHERE NOT EXISTS (SELECT 1 FROM rrf_fused_topk f WHERE f.customer_id = n.customer_id AND f.article_id = n.article_id)"""


@G.query
def propagated_factors(d, p):
    """One step of symmetric-normalised propagation of item vectors to users over distinct purchases, all components."""
    return f"""SELECT customer_id, i, round(sum(x / sqrt(cast(du as double) * di)), 6) AS value FROM (
SELECT e.customer_id, v.i, v.x, count(*) OVER (PARTITION BY e.customer_id, v.i) AS du, di.n AS di FROM (SELECT DISTINCT r.customer_id, r.article_id FROM recent r JOIN users u ON r.customer_id = u.customer_id) e JOIN unit_components v ON e.article_id = v.article_id
JOIN (SELECT article_id, count(DISTINCT customer_id) AS n FROM recent GROUP BY article_id) di ON e.article_id = di.article_id) z GROUP BY customer_id, i"""
