"""Exact ranking metrics and evaluation tables."""

from ..plans.graph import GRAPH as G


def precision_rows(relation: str, rank: str, k: int) -> str:
    """Hits of a ranked relation with the precision at each."""
    return f"""SELECT r.customer_id, r.rk, row_number() OVER (PARTITION BY r.customer_id ORDER BY r.rk) / cast(r.rk as double) AS prec FROM (SELECT customer_id, article_id, {rank} AS rk FROM {relation} WHERE {rank} <= {k}) r JOIN truth t ON r.customer_id = t.customer_id AND r.article_id = t.article_id"""


def per_user(relation: str, rank: str, k: int) -> str:
    return f"SELECT n.customer_id, n.n AS truth, coalesce(a.hits, 0) AS hits, round(coalesce(a.total, 0) / least(n.n, {k}), 8) AS ap FROM truth_counts n LEFT JOIN (SELECT customer_id, count(*) AS hits, sum(prec) AS total FROM ({precision_rows(relation, rank, k)}) h GROUP BY customer_id) a ON n.customer_id = a.customer_id"


@G.query
def ap_table(d, p):
    """Average precision of every user with truth; a user without prediction scores 0."""
    return per_user("two_ranker_fusion", "final_rank", p.metric_k)


@G.query
def map_at_12(d, p):
    """Mean average precision at 12 of the slate, before and after the swaps."""
    return f"SELECT 'before' AS slate, count(*) AS users, round(avg(ap), 8) AS map FROM ap_table UNION ALL SELECT 'after' AS slate, count(*) AS users, round(avg(ap), 8) AS map FROM ({per_user('swapped_slate', 'final_rank', p.metric_k)}) x"


@G.query
def swap_effect(d, p):
    """Exact change of average precision per user by the swaps."""
    return f"SELECT b.customer_id, b.ap AS ap_before, a.ap AS ap_after, round(a.ap - b.ap, 8) AS delta FROM ap_table b JOIN ({per_user('swapped_slate', 'final_rank', p.metric_k)}) a ON b.customer_id = a.customer_id WHERE a.ap <> b.ap"


def pool_metrics(relation: str, rank: str, depth: int, k: int) -> str:
    return f"""SELECT count(*) AS users, round(avg(hits / cast(n as double)), 8) AS recall, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 8) AS hit_rate, round(avg(least(hits, {k}) / cast(least(n, {k}) as double)), 8) AS oracle_map FROM (
SELECT n.customer_id, n.n, count(r.article_id) AS hits FROM truth_counts n JOIN truth t ON n.customer_id = t.customer_id LEFT JOIN (SELECT customer_id, article_id FROM {relation} WHERE {rank} <= {depth}) r ON t.customer_id = r.customer_id AND t.article_id = r.article_id GROUP BY n.customer_id, n.n) x"""


@G.query
def candidate_metrics(d, p):
    """Recall, hit rate and oracle MAP of the pool at three depths."""
    return " UNION ALL ".join(f"SELECT {k} AS depth, m.* FROM ({pool_metrics('rrf_fused_topk', 'candidate_rank', k, p.metric_k)}) m" for k in (12, 30, 60))


@G.query
def source_metrics(d, p):
    """The same for every source."""
    from .fusion import SOURCES

    return " UNION ALL ".join(f"SELECT '{s}' AS source, m.* FROM ({pool_metrics('src_' + s, 'source_rank', p.source_k, p.metric_k)}) m" for s in SOURCES)


@G.query
def source_overlap_jaccard(d, p):
    """Mean Jaccard overlap of each pair of sources over users."""
    return """SELECT a, b, count(*) AS users, round(avg(n_both / cast(na + nb - n_both as double)), 6) AS jaccard FROM (
SELECT x.customer_id, x.source AS a, y.source AS b, count(*) AS n_both, max(x.n) AS na, max(y.n) AS nb FROM (SELECT *, count(*) OVER (PARTITION BY customer_id, source) AS n FROM candidates_long) x JOIN (SELECT *, count(*) OVER (PARTITION BY customer_id, source) AS n FROM candidates_long) y
ON x.customer_id = y.customer_id AND x.article_id = y.article_id WHERE x.source < y.source GROUP BY x.customer_id, x.source, y.source) z GROUP BY a, b"""


@G.query
def leave_one_source_out(d, p):
    """Pool recall when each source is left out of the fusion."""
    from .fusion import SOURCES

    part = lambda s: f"""SELECT '{s}' AS without, round(avg(hits / cast(n as double)), 8) AS recall FROM (SELECT n.customer_id, n.n, count(r.article_id) AS hits FROM truth_counts n JOIN truth t ON n.customer_id = t.customer_id LEFT JOIN (
SELECT customer_id, article_id FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS rk FROM (SELECT customer_id, article_id, round(sum(1.0 / ({p.rrf} + source_rank)), 10) AS score FROM candidates_long WHERE source <> '{s}' GROUP BY customer_id, article_id) u) v WHERE rk <= {p.candidate_k}) r
ON t.customer_id = r.customer_id AND t.article_id = r.article_id GROUP BY n.customer_id, n.n) w"""  # noqa: E731
    return " UNION ALL ".join(part(s) for s in SOURCES)


@G.query
def cumulative_union_recall(d, p):
    """Truth pairs found by the sources up to each in order."""
    from .fusion import SOURCES

    order = "CASE source " + " ".join(f"WHEN '{s}' THEN {i}" for s, (i, _) in SOURCES.items()) + " END"
    return f"SELECT k.k AS sources, count(DISTINCT CASE WHEN c.o <= k.k THEN c.pair END) AS found FROM (SELECT {order} AS o, concat({d.text('l.customer_id')}, '-', {d.text('l.article_id')}) AS pair FROM candidates_long l JOIN truth t ON l.customer_id = t.customer_id AND l.article_id = t.article_id) c CROSS JOIN ({d.numbers(len(SOURCES), 'k')}) k GROUP BY k.k"


@G.query
def segment_metrics(d, p):
    """MAP and hits per activity segment of users."""
    return "SELECT s.activity, count(*) AS users, sum(a.hits) AS hits, round(avg(a.ap), 8) AS map FROM ap_table a JOIN user_activity_segments s ON a.customer_id = s.customer_id GROUP BY s.activity".replace("sum(a.hits)", "cast(sum(a.hits) as bigint)")


@G.query
def popularity_segment_recall(d, p):
    """Truth pairs found by the slate and the pool per temperature of the item."""
    return f"""SELECT i.temperature, count(*) AS truth_pairs, count(f.article_id) AS in_pool, count(CASE WHEN r.final_rank <= {p.metric_k} THEN 1 END) AS in_slate FROM truth t JOIN item_temperature i ON t.article_id = i.article_id LEFT JOIN rrf_fused_topk f ON t.customer_id = f.customer_id AND t.article_id = f.article_id
LEFT JOIN two_ranker_fusion r ON t.customer_id = r.customer_id AND t.article_id = r.article_id GROUP BY i.temperature"""


@G.query
def ranking_funnel(d, p):
    """Where truth pairs are lost: no source, outside the pool, outside the slate."""
    return f"""SELECT stage, count(*) AS pairs FROM (SELECT CASE WHEN l.article_id IS NULL THEN '1 no source' WHEN f.article_id IS NULL THEN '2 not in pool' WHEN r.final_rank > {p.metric_k} THEN '3 not in slate' ELSE '4 in slate' END AS stage FROM truth t LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM candidates_long) l ON t.customer_id = l.customer_id AND t.article_id = l.article_id
LEFT JOIN rrf_fused_topk f ON t.customer_id = f.customer_id AND t.article_id = f.article_id LEFT JOIN two_ranker_fusion r ON t.customer_id = r.customer_id AND t.article_id = r.article_id) x GROUP BY stage"""


@G.query
def hit_decomposition(d, p):
    """New, lost and shared parts of the MAP change by the swaps, hit by hit."""
    one = lambda rel: f"SELECT h.customer_id, t.article_id, h.prec / least(n.n, {p.metric_k}) AS part FROM ({precision_rows(rel, 'final_rank', p.metric_k)}) h JOIN {rel} t ON h.customer_id = t.customer_id AND h.rk = t.final_rank JOIN truth_counts n ON h.customer_id = n.customer_id"
    return f"SELECT CASE WHEN b.part IS NULL THEN 'new' WHEN a.part IS NULL THEN 'lost' ELSE 'shared' END AS kind, count(*) AS pairs, round(sum(coalesce(a.part, 0) - coalesce(b.part, 0)), 8) AS delta FROM ({one('two_ranker_fusion')}) b FULL OUTER JOIN ({one('swapped_slate')}) a ON b.customer_id = a.customer_id AND b.article_id = a.article_id GROUP BY CASE WHEN b.part IS NULL THEN 'new' WHEN a.part IS NULL THEN 'lost' ELSE 'shared' END"


@G.query
def discrimination(d, p):
    """Area under the ROC curve with half ties, correlation of score and target, mean reciprocal rank."""
    return """SELECT round((sum(CASE WHEN target = 1 THEN low + (ties - 1) / 2.0 ELSE 0 END) - max(pos) * (max(pos) + 1) / 2.0) / (max(pos) * cast(max(n) - max(pos) as double)), 8) AS auc, round(corr(score_a, cast(target as double)), 6) AS pearson, max(pos) AS positives FROM (
SELECT score_a, target, cast(rank() OVER (ORDER BY score_a) as bigint) AS low, count(*) OVER (PARTITION BY score_a) AS ties, cast(sum(target) OVER (PARTITION BY 1) as bigint) AS pos, count(*) OVER (PARTITION BY 1) AS n FROM scored) x"""


@G.query
def reliability(d, p):
    """Mean score and rate of positives per score decile."""
    return "SELECT bin, count(*) AS n, round(avg(score_a), 6) AS mean_score, round(avg(cast(target as double)), 6) AS rate FROM (SELECT score_a, target, cast(ntile(10) OVER (ORDER BY score_a, customer_id, article_id) as bigint) AS bin FROM scored) x GROUP BY bin"


@G.query
def calibration_error(d, p):
    """Expected calibration error over score deciles, Brier score and log loss, the score (at most 1) read as a probability."""
    prob = "least(score_a, 1.0)"
    safe = f"least(greatest({prob}, 0.000001), 0.999999)"
    return f"""SELECT round(sum(abs(mean_p - rate) * n) / sum(n), 6) AS ece, round(sum(brier) / sum(n), 6) AS brier, round(sum(loss) / sum(n), 6) AS log_loss, cast(sum(n) as bigint) AS n FROM (
SELECT bin, count(*) AS n, avg({prob}) AS mean_p, avg(cast(target as double)) AS rate, sum(({prob} - target) * ({prob} - target)) AS brier, -sum(CASE WHEN target = 1 THEN ln({safe}) ELSE ln(1 - {safe}) END) AS loss FROM (SELECT score_a, target, ntile(10) OVER (ORDER BY score_a, customer_id, article_id) AS bin FROM scored) x GROUP BY bin) y"""


@G.query
def low_frequency_recall(d, p):
    """Recall at 5 inside each cold list, for never-sold and rarely sold items."""
    return "SELECT i.temperature, count(*) AS pairs, count(CASE WHEN c.source_rank <= 5 THEN 1 END) AS at_5 FROM src_cold_content c JOIN item_temperature i ON c.article_id = i.article_id JOIN truth t ON c.customer_id = t.customer_id AND c.article_id = t.article_id GROUP BY i.temperature"


@G.relation
def paired_effects(d, p):
    """Average precision of every user with truth before and after the swaps."""
    return f"SELECT b.customer_id, b.ap AS before, a.ap AS after FROM ap_table b JOIN ({per_user('swapped_slate', 'final_rank', p.metric_k)}) a ON b.customer_id = a.customer_id"


@G.query
def bootstrap_interval(d, p):
    """Paired bootstrap of the swap effect over all users: 200 replicates with stable integer weights of the users, the same for both slates."""
    weight = "CASE WHEN u < 0.3678794 THEN 0 WHEN u < 0.7357589 THEN 1 WHEN u < 0.9196986 THEN 2 WHEN u < 0.9810118 THEN 3 ELSE 4 END"
    return f"""SELECT {d.quantile('m', 0.025)} AS low, {d.quantile('m', 0.5)} AS middle, {d.quantile('m', 0.975)} AS high, count(*) AS replicates, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_positive FROM (SELECT k, round(sum(w * (after - before)) / sum(w), 8) AS m FROM (
SELECT k, before, after, {weight} AS w FROM (SELECT b.k, a.before, a.after, {d.number(f"md5(concat({d.text('a.customer_id')}, '-', {d.text('b.k')}))")} / 4294967296.0 AS u FROM paired_effects a CROSS JOIN ({d.numbers(200, 'k')}) b) x) y GROUP BY k) z"""


@G.query
def history_coverage(d, p):
    """Truth pairs whose item sold, or was bought by the same user, in each span before the cutoff."""
    spans = " UNION ALL ".join(f"SELECT {w} AS weeks" for w in (1, 2, 4, 8))
    return f"""SELECT k.weeks, count(*) AS pairs, count(CASE WHEN i.age <= 7 * k.weeks THEN 1 END) AS item_seen, count(CASE WHEN q.age <= 7 * k.weeks THEN 1 END) AS pair_seen FROM truth t CROSS JOIN ({spans}) k
LEFT JOIN (SELECT article_id, {d.days('max(t_dat)', d.date(p.cutoff))} AS age FROM history GROUP BY article_id) i ON t.article_id = i.article_id LEFT JOIN (SELECT customer_id, article_id, {d.days('max(t_dat)', d.date(p.cutoff))} AS age FROM history GROUP BY customer_id, article_id) q ON t.customer_id = q.customer_id AND t.article_id = q.article_id GROUP BY k.weeks"""


@G.query
def retriever_overlap(d, p):
    """Overlap, truth gained and lost between two retrievers."""
    return "SELECT count(CASE WHEN a.article_id IS NOT NULL AND b.article_id IS NOT NULL THEN 1 END) AS both, count(CASE WHEN b.article_id IS NULL THEN 1 END) AS only_first, count(CASE WHEN a.article_id IS NULL THEN 1 END) AS only_second, count(CASE WHEN b.article_id IS NULL AND t.article_id IS NOT NULL THEN 1 END) AS truth_first, count(CASE WHEN a.article_id IS NULL AND t.article_id IS NOT NULL THEN 1 END) AS truth_second FROM src_covisit a FULL OUTER JOIN src_attribute_content b ON a.customer_id = b.customer_id AND a.article_id = b.article_id LEFT JOIN truth t ON coalesce(a.customer_id, b.customer_id) = t.customer_id AND coalesce(a.article_id, b.article_id) = t.article_id"


@G.query
def improved_harmed_users(d, p):
    """Users improved, harmed and unchanged by fusing two models, against the first alone."""
    return f"SELECT CASE WHEN f.ap > a.ap THEN 'improved' WHEN f.ap < a.ap THEN 'harmed' ELSE 'same' END AS outcome, count(*) AS users, round(sum(f.ap - a.ap), 7) AS total FROM ap_table f JOIN ({per_user('two_ranker_fusion', 'rank_a', p.metric_k)}) a ON f.customer_id = a.customer_id GROUP BY CASE WHEN f.ap > a.ap THEN 'improved' WHEN f.ap < a.ap THEN 'harmed' ELSE 'same' END"


@G.query
def slate_geometry(d, p):
    """Overlap and rank distance of the two models' slates per user."""
    k = p.metric_k
    return f"SELECT customer_id, round(count(CASE WHEN rank_a <= {k} AND rank_b <= {k} THEN 1 END) / {k}.0, 6) AS overlap, round(avg(abs(rank_a - rank_b)), 5) AS distance, round(max(CASE WHEN rank_a = {k} THEN score_gap_base END) - max(CASE WHEN rank_a = {k} + 1 THEN score_gap_base END), 8) AS gap_12_13 FROM (SELECT *, 1.0 / (60 + rank_a) AS score_gap_base FROM two_ranker_fusion) x GROUP BY customer_id"
