"""Vector operators over array columns and over components."""

from ..plans.graph import GRAPH as G


@G.query
def vector_norms(d, p):
    """Length and dimension of every vector."""
    return f"SELECT article_id, round(sqrt({d.dot('vector', 'vector')}), 6) AS norm FROM item_vectors"


@G.query
def unit_vectors(d, p):
    """Unit vectors by component."""
    return "SELECT article_id, i, round(x, 6) AS x FROM unit_components"


@G.query
def basket_mean_vectors(d, p):
    """Mean vector of each recent basket."""
    return "SELECT b.customer_id, b.t_dat, v.i, round(avg(v.x), 6) AS x FROM baskets b JOIN users u ON b.customer_id = u.customer_id JOIN unit_components v ON b.article_id = v.article_id GROUP BY b.customer_id, b.t_dat, v.i"


@G.query
def decayed_profiles(d, p):
    """Half-life weighted profile of each user's seeds."""
    return "SELECT s.customer_id, v.i, round(sum(s.weight * v.x) / sum(s.weight), 6) AS x FROM user_seeds s JOIN unit_components v ON s.article_id = v.article_id GROUP BY s.customer_id, v.i"


@G.query
def bucket_cosines(d, p):
    """Candidate cosines to the seeds by age bucket: best and mean."""
    return "SELECT customer_id, article_id, CASE WHEN age_days <= 28 THEN 'recent' WHEN age_days <= 84 THEN 'mid' ELSE 'old' END AS bucket, max(cosine) AS best, round(avg(cosine) + 1e-12, 6) AS mean FROM seed_neighbours GROUP BY customer_id, article_id, CASE WHEN age_days <= 28 THEN 'recent' WHEN age_days <= 84 THEN 'mid' ELSE 'old' END"


@G.query
def memory_scores(d, p):
    """Candidate against past seeds: best cosine, and softmax-weighted by closeness and age."""
    return "SELECT customer_id, article_id, max(cosine) AS best, round(sum(exp(cosine / 0.1 - ln(2) * age_days / 28.0) * cosine) / sum(exp(cosine / 0.1 - ln(2) * age_days / 28.0)), 6) AS attended FROM seed_neighbours GROUP BY customer_id, article_id"


@G.query
def catalogue_dispersion(d, p):
    """Per type: one less the squared length of the mean unit vector."""
    return "SELECT product_type, round(1 - sum(m * m), 6) AS dispersion FROM (SELECT a.product_type, v.i, avg(v.x) AS m FROM unit_components v JOIN articles a ON v.article_id = a.article_id GROUP BY a.product_type, v.i) x GROUP BY product_type"
