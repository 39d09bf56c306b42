"""Population, catalogue and temporal split."""

from ..plans.graph import GRAPH as G


@G.query
def resolve_cutoff(d, p):
    """The cutoff that leaves exactly the label window at the end of the data."""
    return f"SELECT max(t_dat) AS last_day, {d.shift('max(t_dat)', -(p.label_days - 1))} AS cutoff FROM tx"


@G.query
def temporal_split(d, p):
    """Rows, users and items of the history window and of the label week."""
    one = "count(*) AS n_rows, count(DISTINCT customer_id) AS users, count(DISTINCT article_id) AS items, min(t_dat) AS first_day, max(t_dat) AS last_day"
    return f"SELECT 'history' AS part, {one} FROM recent UNION ALL SELECT 'label' AS part, {one} FROM label_week"


@G.relation
def warm_catalogue(d, p):
    return "SELECT DISTINCT article_id FROM history"


@G.query
def eligible_catalogue(d, p):
    """Articles with whether they sold before the cutoff (strict catalogues keep only those)."""
    return "SELECT a.article_id, CASE WHEN w.article_id IS NULL THEN 0 ELSE 1 END AS warm FROM articles a LEFT JOIN warm_catalogue w ON a.article_id = w.article_id"


@G.relation
def users(d, p):
    """Label-week users, thinned by a stable digest of the id."""
    return f"SELECT DISTINCT customer_id FROM label_week WHERE {d.number(f'md5({d.text("customer_id")})')} % 10000 < {p.user_rate}"


@G.relation
def truth(d, p):
    return "SELECT DISTINCT l.customer_id, l.article_id FROM label_week l JOIN users u ON l.customer_id = u.customer_id"


@G.query
def truth_warm_cold(d, p):
    """Truth pairs, each warm or cold by whether the item sold before the cutoff."""
    return "SELECT t.customer_id, t.article_id, CASE WHEN w.article_id IS NULL THEN 'cold' ELSE 'warm' END AS temperature FROM truth t LEFT JOIN warm_catalogue w ON t.article_id = w.article_id"


@G.query
def ground_truth_lists(d, p):
    """The distinct items of each label-week user, in item order."""
    return f"SELECT customer_id, count(*) AS items, {d.joined(d.text('article_id'), 'article_id')} AS item_list FROM truth GROUP BY customer_id"


@G.query
def user_sample(d, p):
    """A stable tenth of all customers by digest of the id."""
    return f"SELECT customer_id FROM customers WHERE {d.number(f'md5({d.text("customer_id")})')} % 10000 < 1000"


@G.query
def user_activity_segments(d, p):
    """Users with their events in the history window and the segment 0 / 1-5 / 6-20 / 21+."""
    return """SELECT u.customer_id, coalesce(n.events, 0) AS events, CASE WHEN n.events IS NULL THEN '0' WHEN n.events <= 5 THEN '1-5' WHEN n.events <= 20 THEN '6-20' ELSE '21+' END AS activity
FROM users u LEFT JOIN (SELECT customer_id, count(*) AS events FROM recent GROUP BY customer_id) n ON u.customer_id = n.customer_id"""


@G.query
def item_popularity_deciles(d, p):
    """Items of the history window in deciles by events: head, mid and tail."""
    return """SELECT article_id, events, decile, CASE WHEN decile = 1 THEN 'head' WHEN decile <= 5 THEN 'mid' ELSE 'tail' END AS band
FROM (SELECT article_id, events, cast(ntile(10) OVER (ORDER BY events DESC, article_id) as bigint) AS decile FROM (SELECT article_id, count(*) AS events FROM recent GROUP BY article_id) a) b"""


@G.query
def item_temperature(d, p):
    """All articles by sales before the cutoff: strict cold, sparse, tail, middle, head."""
    return """SELECT a.article_id, coalesce(n.events, 0) AS events, CASE WHEN n.events IS NULL THEN 'strict_cold' WHEN n.events <= 5 THEN 'sparse' WHEN n.events <= 20 THEN 'tail' WHEN n.events <= 100 THEN 'middle' ELSE 'head' END AS temperature
FROM articles a LEFT JOIN (SELECT article_id, count(*) AS events FROM history GROUP BY article_id) n ON a.article_id = n.article_id"""


@G.query
def age_buckets(d, p):
    """Customers per age bucket."""
    return "SELECT bucket, count(*) AS n FROM user_bucket GROUP BY bucket"


@G.relation
def user_bucket(d, p):
    return """SELECT customer_id, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 20 THEN '<20' WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' WHEN age < 60 THEN '50s' ELSE '60+' END AS bucket FROM customers"""


@G.query
def recency_buckets(d, p):
    """Users by days since their last purchase before the cutoff."""
    return f"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN age <= 7 THEN '<=7' WHEN age <= 28 THEN '<=28' WHEN age <= 84 THEN '<=84' ELSE '>84' END AS bucket
FROM (SELECT customer_id, {d.days('max(t_dat)', d.date(p.cutoff))} AS age FROM history GROUP BY customer_id) a) b GROUP BY bucket"""


@G.query
def training_users(d, p):
    """Users with history and label activity."""
    return "SELECT u.customer_id FROM users u WHERE EXISTS (SELECT 1 FROM recent r WHERE r.customer_id = u.customer_id)"


@G.query
def population_fingerprint(d, p):
    """Digest of the ordered user ids."""
    return f"SELECT count(*) AS users, md5({d.joined(d.text('customer_id'), 'customer_id')}) AS digest FROM users"


@G.query
def static_dimensions(d, p):
    """Article attributes recovered from text, null where they do not parse."""
    return f"SELECT article_id, {d.try_int('substr(garment_group, 7)')} AS brand_no, {d.try_int('colour')} AS colour_no, lower(product_type) AS product_type FROM articles"
