"""Training-set sampling; order is by digest of the ids, so reruns and engines agree."""

from ..plans.graph import GRAPH as G


def digest(d, p, *columns: str) -> str:
    parts = ", '-', ".join(d.text(c) for c in columns)
    return f"md5(concat('{p.seed}-', {parts}))"


@G.query
def positive_groups(d, p):
    """All rows of users with a positive."""
    return "SELECT s.customer_id, s.article_id, s.target FROM scored s WHERE EXISTS (SELECT 1 FROM scored t WHERE t.customer_id = s.customer_id AND t.target = 1)"


@G.query
def stratified_negatives(d, p):
    """Positives, and up to the ratio of negatives per positive, alternating between two rank strata."""
    return f"""SELECT customer_id, article_id, target FROM (SELECT x.*, row_number() OVER (PARTITION BY customer_id, target ORDER BY turn, stratum, article_id) AS take FROM (
SELECT s.*, CASE WHEN s.candidate_rank <= 20 THEN 0 ELSE 1 END AS stratum, g.positives, row_number() OVER (PARTITION BY s.customer_id, s.target, CASE WHEN s.candidate_rank <= 20 THEN 0 ELSE 1 END ORDER BY {digest(d, p, 's.customer_id', 's.article_id')}) AS turn
FROM scored s JOIN (SELECT customer_id, cast(sum(target) as bigint) AS positives FROM scored GROUP BY customer_id HAVING sum(target) > 0) g ON s.customer_id = g.customer_id) x) y WHERE target = 1 OR take <= {p.negatives} * positives"""


@G.query
def distribution_sample(d, p):
    """Negatives stratified by layer and rank tercile, taken round-robin, with inclusion probability and inverse weight."""
    return f"""SELECT customer_id, article_id, target, stratum, round(CASE WHEN target = 1 THEN 1.0 ELSE cast(taken as double) / size END, 6) AS probability, round(CASE WHEN target = 1 THEN 1.0 ELSE cast(size as double) / taken END, 5) AS weight FROM (
SELECT *, count(*) OVER (PARTITION BY customer_id, target, stratum) AS taken FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, target ORDER BY turn, stratum) AS take FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id, target, stratum ORDER BY {digest(d, p, 'customer_id', 'article_id')}) AS turn, count(*) OVER (PARTITION BY customer_id, target, stratum) AS size FROM (
SELECT s.customer_id, s.article_id, s.target, cast(ntile(3) OVER (PARTITION BY s.customer_id ORDER BY s.candidate_rank) as bigint) + CASE WHEN s.history_events > 5 THEN 10 ELSE 0 END AS stratum FROM scored s JOIN (SELECT customer_id FROM scored GROUP BY customer_id HAVING sum(target) > 0) g ON s.customer_id = g.customer_id) w) x) y WHERE target = 1 OR take <= {p.negatives}) z"""


@G.query
def training_pairs(d, p):
    """(positive, negative) pairs of a user, a few per hardness of the negative's rank."""
    return f"""SELECT customer_id, positive, negative, hardness FROM (SELECT a.customer_id, a.article_id AS positive, b.article_id AS negative, CASE WHEN b.candidate_rank < a.candidate_rank THEN 'hard' WHEN b.candidate_rank <= a.candidate_rank + 20 THEN 'medium' ELSE 'easy' END AS hardness,
row_number() OVER (PARTITION BY a.customer_id, a.article_id, CASE WHEN b.candidate_rank < a.candidate_rank THEN 'hard' WHEN b.candidate_rank <= a.candidate_rank + 20 THEN 'medium' ELSE 'easy' END ORDER BY {digest(d, p, 'a.article_id', 'b.article_id')}) AS rn
FROM scored a JOIN scored b ON a.customer_id = b.customer_id WHERE a.target = 1 AND b.target = 0) x WHERE rn <= 4"""


@G.query
def hashed_negatives(d, p):
    """Positives and a stable tenth of the negatives."""
    return f"SELECT customer_id, article_id, target FROM scored WHERE target = 1 OR {d.number(digest(d, p, 'customer_id', 'article_id'))} % 10 = 0"


@G.query
def weighted_edges(d, p):
    """All non-neutral edges, and a fiftieth of the neutral ones with weight 50."""
    return f"SELECT customer_id, challenger, victim, delta, CASE WHEN delta = 0 THEN 50 ELSE 1 END AS weight FROM swap_pairs WHERE delta <> 0 OR {d.number(digest(d, p, 'customer_id', 'challenger', 'victim'))} % 50 = 0"


@G.query
def deterministic_pairs(d, p):
    """All non-neutral pairs and the first neutral ones of each user by gap, ranks and ids."""
    return "SELECT customer_id, challenger, victim, delta FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, CASE WHEN delta = 0 THEN 0 ELSE 1 END ORDER BY score_gap DESC, challenger_rank, victim_rank, challenger, victim) AS rn FROM swap_pairs) x WHERE delta <> 0 OR rn <= 3"


@G.query
def boundary_sample(d, p):
    """Rows around the slate boundary of each user: a quota per stratum, filled from the next when one is short."""
    return "SELECT customer_id, article_id, final_rank, stratum FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY stratum, final_rank, article_id) AS rn FROM (SELECT *, CASE WHEN final_rank BETWEEN 8 AND 16 THEN 1 WHEN final_rank <= 30 THEN 2 ELSE 3 END AS stratum FROM two_ranker_fusion) x) y WHERE rn <= 16"


@G.query
def triplets(d, p):
    """(anchor, positive, negative): near items as positives, a stable item of the same type outside the neighbours as the negative."""
    return f"""SELECT anchor, positive, negative FROM (SELECT k.anchor, k.neighbour AS positive, n.article_id AS negative, row_number() OVER (PARTITION BY k.anchor, k.neighbour ORDER BY {digest(d, p, 'k.anchor', 'k.neighbour', 'n.article_id')}) AS rn
FROM item_knn k JOIN articles a ON k.anchor = a.article_id JOIN pooled_articles n ON a.product_type = n.product_type AND n.type_rank <= 20 LEFT JOIN item_knn x ON x.anchor = k.anchor AND x.neighbour = n.article_id WHERE k.neighbour_rank <= 5 AND x.anchor IS NULL AND n.article_id <> k.anchor) y WHERE rn = 1"""
