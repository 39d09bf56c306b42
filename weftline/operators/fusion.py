"""Fusion of sources and composition of candidate pools."""

from ..plans.graph import GRAPH as G

#: source: order, and the weight in each profile
SOURCES = {
    "repurchase": (1, {"equal": 1.0, "diversity": 0.8, "popularity": 1.0}),
    "recent_popularity": (2, {"equal": 1.0, "diversity": 0.5, "popularity": 2.0}),
    "product_family": (3, {"equal": 1.0, "diversity": 1.2, "popularity": 0.8}),
    "attribute_content": (4, {"equal": 1.0, "diversity": 1.2, "popularity": 0.6}),
    "segment_popularity": (5, {"equal": 1.0, "diversity": 0.8, "popularity": 1.5}),
    "covisit": (6, {"equal": 1.0, "diversity": 1.5, "popularity": 0.8}),
}


def weight(profile: str, column: str = "source") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{s}' THEN {w[profile]}" for s, (_, w) in SOURCES.items()) + " ELSE 0.0 END"


@G.relation
def candidates_raw(d, p):
    return " UNION ALL ".join(f"SELECT customer_id, article_id, '{s}' AS source, source_rank, cast(source_score as double) AS source_score FROM src_{s}" for s in SOURCES)


@G.query
def candidates_long(d, p):
    """All sources, one row per user, item and source: least rank, then highest score."""
    return """SELECT customer_id, article_id, source, source_rank, round(source_score, 6) AS source_score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, article_id, source ORDER BY source_rank, source_score DESC) AS rn FROM candidates_raw) x WHERE rn = 1"""


def fused(d, p, profile: str) -> str:
    order = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for s, (i, _) in SOURCES.items()) + " END"
    return f"""SELECT customer_id, article_id, candidate_rank, fused_score, source_count, sources FROM (SELECT *, cast(row_number() OVER (PARTITION BY customer_id ORDER BY fused_score DESC, source_count DESC, article_id) as bigint) AS candidate_rank FROM (
SELECT customer_id, article_id, round(sum({weight(profile)} / ({p.rrf} + source_rank)), 10) AS fused_score, count(*) AS source_count, {d.joined('source', order)} AS sources FROM candidates_long GROUP BY customer_id, article_id) x) y WHERE candidate_rank <= {p.candidate_k}"""


@G.query
def rrf_fused_topk(d, p):
    """Reciprocal-rank fusion of the six sources, equal weights."""
    return fused(d, p, "equal")


@G.query
def rrf_diversity_topk(d, p):
    """The same with the diversity profile."""
    return fused(d, p, "diversity")


@G.query
def rrf_popularity_topk(d, p):
    """The same with the popularity profile."""
    return fused(d, p, "popularity")


@G.query
def round_robin_topk(d, p):
    """The diagnostic order: sources in turn, the least turn per item."""
    order = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for s, (i, _) in SOURCES.items()) + " END"
    return f"""SELECT customer_id, article_id, turn, candidate_rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY customer_id ORDER BY turn, article_id) as bigint) AS candidate_rank FROM (
SELECT customer_id, article_id, cast(min((source_rank - 1) * {len(SOURCES)} + {order}) as bigint) AS turn FROM candidates_long GROUP BY customer_id, article_id) x) y WHERE candidate_rank <= {p.candidate_k}"""


@G.query
def rrf_wide_pivot(d, p):
    """Fused candidates with each source's presence, rank, score and contribution; an absent source is null, never zero."""
    columns = ",\n".join(
        f"max(CASE WHEN l.source = '{s}' THEN 1 ELSE 0 END) AS {s}_present, max(CASE WHEN l.source = '{s}' THEN l.source_rank END) AS {s}_rank, max(CASE WHEN l.source = '{s}' THEN l.source_score END) AS {s}_score, round(max(CASE WHEN l.source = '{s}' THEN 1.0 / ({p.rrf} + l.source_rank) END), 10) AS {s}_rrf"
        for s in SOURCES
    )
    return f"SELECT f.customer_id, f.article_id, f.candidate_rank, f.fused_score, f.source_count, {columns} FROM rrf_fused_topk f JOIN candidates_long l ON f.customer_id = l.customer_id AND f.article_id = l.article_id GROUP BY f.customer_id, f.article_id, f.candidate_rank, f.fused_score, f.source_count"


@G.query
def source_outage(d, p):
    """The pool as if co-visitation had failed: its sole items go, its part of the score and its columns go."""
    return "SELECT customer_id, article_id, candidate_rank, round(fused_score - coalesce(covisit_rrf, 0), 8) AS fused_score, source_count - covisit_present AS source_count, cast(NULL as bigint) AS covisit_rank FROM rrf_wide_pivot WHERE NOT (covisit_present = 1 AND source_count = 1)"


@G.query
def expanded_pool(d, p):
    """The fused pool with unseen vector neighbours appended, up to the append limit."""
    return f"""SELECT customer_id, article_id, candidate_rank, 'base' AS origin FROM rrf_fused_topk UNION ALL
SELECT a.customer_id, a.article_id, a.candidate_rank, 'appended' AS origin FROM append_unseen a LEFT JOIN (SELECT customer_id, max(candidate_rank) AS last_rank FROM rrf_fused_topk GROUP BY customer_id) m ON a.customer_id = m.customer_id WHERE a.candidate_rank <= coalesce(m.last_rank, 0) + {p.append_k}"""


@G.query
def fixed_pool(d, p):
    """The pool and the neighbours fused by a full outer join of reciprocal ranks, cut to the pool size."""
    return f"""SELECT customer_id, article_id, score, candidate_rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) as bigint) AS candidate_rank FROM (
SELECT coalesce(b.customer_id, n.customer_id) AS customer_id, coalesce(b.article_id, n.article_id) AS article_id, round(coalesce(b.fused_score, 0) + coalesce(1.0 / ({p.rrf} + n.source_rank), 0), 10) AS score
FROM rrf_fused_topk b FULL OUTER JOIN src_item_neighbours n ON b.customer_id = n.customer_id AND b.article_id = n.article_id) x) y WHERE candidate_rank <= {p.candidate_k}"""


@G.query
def branch_union(d, p):
    """Warm and cold shortlists united, each row labelled by branch, with percentile ranks inside it."""
    return """SELECT coalesce(w.customer_id, c.customer_id) AS customer_id, coalesce(w.article_id, c.article_id) AS article_id, CASE WHEN c.article_id IS NULL THEN 'warm_only' WHEN w.article_id IS NULL THEN 'cold_only' ELSE 'warm_and_cold' END AS branch,
round(w.candidate_rank / cast(w.group_rows as double), 6) AS warm_pct, round(c.source_rank / cast(c.group_rows as double), 6) AS cold_pct
FROM (SELECT *, count(*) OVER (PARTITION BY customer_id) AS group_rows FROM rrf_fused_topk) w FULL OUTER JOIN (SELECT *, count(*) OVER (PARTITION BY customer_id) AS group_rows FROM src_cold_season) c ON w.customer_id = c.customer_id AND w.article_id = c.article_id"""


@G.relation
def scored(d, p):
    """The pool with two stable model scores (a digest stands for a model) and the target."""
    score = lambda salt: f"round({d.number(f'md5(concat({d.text("f.customer_id")}, {chr(39)}{salt}{chr(39)}, {d.text("f.article_id")}))')} / 4294967296.0 + 1.0 / (5 + f.candidate_rank), 8)"
    return f"""SELECT f.customer_id, f.article_id, f.candidate_rank, f.fused_score, CASE WHEN t.article_id IS NULL THEN 0 ELSE 1 END AS target, coalesce(n.events, 0) AS history_events, {score('-a-')} AS score_a, {score('-b-')} AS score_b
FROM rrf_fused_topk f LEFT JOIN truth t ON f.customer_id = t.customer_id AND f.article_id = t.article_id LEFT JOIN (SELECT customer_id, count(*) AS events FROM recent GROUP BY customer_id) n ON f.customer_id = n.customer_id"""


@G.query
def two_ranker_fusion(d, p):
    """Reciprocal-rank fusion of two model orders; users without history keep the candidate order."""
    return f"""SELECT customer_id, article_id, target, candidate_rank, rank_a, rank_b, final_score, cast(row_number() OVER (PARTITION BY customer_id ORDER BY CASE WHEN history_events = 0 THEN -candidate_rank ELSE final_score END DESC, candidate_rank, article_id) as bigint) AS final_rank FROM (
SELECT *, round(1.0 / ({p.rrf} + rank_a) + 1.0 / ({p.rrf} + rank_b), 10) AS final_score FROM (
SELECT *, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score_a DESC, candidate_rank, article_id) as bigint) AS rank_a, cast(row_number() OVER (PARTITION BY customer_id ORDER BY score_b DESC, candidate_rank, article_id) as bigint) AS rank_b FROM scored) x) y"""


@G.query
def blended_ranks(d, p):
    """Blend of two reciprocal ranks at a quarter."""
    return f"SELECT customer_id, article_id, round((a + b) + 2 * (0.25 - 0.5) * (b - a), 10) AS blend FROM (SELECT *, 1.0 / ({p.rrf} + rank_a) AS a, 1.0 / ({p.rrf} + rank_b) AS b FROM two_ranker_fusion) x"


@G.query
def top12_union(d, p):
    """Two slates united, with the rank in each."""
    one = lambda r: f"SELECT customer_id, article_id, {r} AS r FROM two_ranker_fusion WHERE {r} <= {p.metric_k}"
    return f"SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, coalesce(a.article_id, b.article_id) AS article_id, a.r AS rank_first, b.r AS rank_second FROM ({one('rank_a')}) a FULL OUTER JOIN ({one('rank_b')}) b ON a.customer_id = b.customer_id AND a.article_id = b.article_id"


@G.query
def submission(d, p):
    """The Top-12 of every user as one text."""
    return f"SELECT customer_id, {d.joined(d.text('article_id'), 'final_rank', ' ')} AS prediction FROM two_ranker_fusion WHERE final_rank <= {p.metric_k} GROUP BY customer_id"


@G.query
def warm_retention(d, p):
    """Share of pool positives kept at each shortlist depth."""
    return "SELECT k.k, count(CASE WHEN s.candidate_rank <= k.k THEN 1 END) AS kept, count(*) AS positives FROM scored s CROSS JOIN (SELECT 10 AS k UNION ALL SELECT 20 AS k UNION ALL SELECT 40 AS k UNION ALL SELECT 60 AS k) k WHERE s.target = 1 GROUP BY k.k"
