"""Ordering, admission and replacement policies. Ranks 1 to head are protected, the rest of the slate may be replaced."""

from ..plans.graph import GRAPH as G


@G.query
def final_order(d, p):
    """The final slate: users without history by candidate rank, others by score."""
    return f"SELECT customer_id, article_id, final_rank FROM two_ranker_fusion WHERE final_rank <= {p.metric_k}"


@G.relation
def truth_counts(d, p):
    return "SELECT customer_id, count(*) AS n FROM truth GROUP BY customer_id"


@G.relation
def hit_sums(d, p):
    """Ranked rows with the hits up to and before them, and the weighted hits between."""
    return f"""SELECT customer_id, article_id, final_rank, target, final_score, cast(sum(target) OVER w as bigint) AS hits, coalesce(sum(CASE WHEN target = 1 THEN 1.0 / final_rank ELSE 0 END) OVER w, 0) AS inverse FROM two_ranker_fusion WHERE final_rank <= 50
WINDOW w AS (PARTITION BY customer_id ORDER BY final_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@G.query
def swap_pairs(d, p):
    """Challenger and victim pairs of a user with score gap and the exact change of average precision if they swap."""
    hit_inside = "(c.target - v.target)"
    return f"""SELECT v.customer_id, c.article_id AS challenger, v.article_id AS victim, c.final_rank AS challenger_rank, v.final_rank AS victim_rank, round(c.final_score - v.final_score, 10) AS score_gap, round(s.score_b - t.score_b, 8) AS vote_gap, c.target AS challenger_target, v.target AS victim_target,
round({hit_inside} * ((v.hits - v.target + 1) / cast(v.final_rank as double) + (e.inverse - v.inverse)) / least(coalesce(n.n, 1), {p.metric_k}), 8) AS delta
FROM hit_sums v JOIN hit_sums c ON v.customer_id = c.customer_id JOIN hit_sums e ON v.customer_id = e.customer_id JOIN scored s ON c.customer_id = s.customer_id AND c.article_id = s.article_id JOIN scored t ON v.customer_id = t.customer_id AND v.article_id = t.article_id LEFT JOIN truth_counts n ON v.customer_id = n.customer_id
WHERE v.final_rank > {p.head} AND v.final_rank <= {p.metric_k} AND c.final_rank > {p.metric_k} AND c.final_rank <= 50 AND e.final_rank = {p.metric_k}"""


@G.query
def greedy_swaps(d, p):
    """At most two disjoint swaps of a user by vote gap: the best pair, then the best that shares neither row with it."""
    order = "vote_gap DESC, victim_rank DESC, challenger_rank, challenger, victim"
    return f"""SELECT customer_id, challenger, victim, turn FROM first_swaps UNION ALL SELECT customer_id, challenger, victim, cast(2 as bigint) AS turn FROM (
SELECT s.customer_id, s.challenger, s.victim, row_number() OVER (PARTITION BY s.customer_id ORDER BY {order.replace('vote_gap', 's.vote_gap').replace('victim_rank', 's.victim_rank').replace('challenger_rank', 's.challenger_rank').replace(', challenger, victim', ', s.challenger, s.victim')}) AS rn
FROM swap_pairs s JOIN first_swaps f ON s.customer_id = f.customer_id WHERE s.vote_gap > 0 AND s.challenger <> f.challenger AND s.victim <> f.victim) x WHERE rn = 1"""


@G.relation
def first_swaps(d, p):
    return "SELECT customer_id, challenger, victim, cast(1 as bigint) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY vote_gap DESC, victim_rank DESC, challenger_rank, challenger, victim) AS rn FROM swap_pairs WHERE vote_gap > 0) x WHERE rn = 1"


@G.query
def swapped_slate(d, p):
    """The slate after the greedy swaps, as an exchange of ranks."""
    return """SELECT t.customer_id, t.article_id, t.target, coalesce(m.new_rank, t.final_rank) AS final_rank FROM two_ranker_fusion t LEFT JOIN (
SELECT g.customer_id, g.challenger AS article_id, v.final_rank AS new_rank FROM greedy_swaps g JOIN two_ranker_fusion v ON g.customer_id = v.customer_id AND g.victim = v.article_id
UNION ALL SELECT g.customer_id, g.victim AS article_id, c.final_rank AS new_rank FROM greedy_swaps g JOIN two_ranker_fusion c ON g.customer_id = c.customer_id AND g.challenger = c.article_id) m ON t.customer_id = m.customer_id AND t.article_id = m.article_id"""


@G.query
def best_expected_swap(d, p):
    """The best pair of each user by (2p - 1) times the unit gain, for p over a half (p from the vote gap)."""
    return "SELECT customer_id, challenger, victim, expected FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY expected DESC, challenger, victim) AS rn FROM (SELECT customer_id, challenger, victim, round((2 / (1 + exp(-vote_gap)) - 1) / victim_rank, 6) AS expected FROM swap_pairs WHERE vote_gap > 0) x) y WHERE rn = 1"


@G.query
def unanimous_admission(d, p):
    """One swap into the last slot only if both models prefer the challenger."""
    return f"SELECT customer_id, challenger, victim FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_gap DESC, vote_gap DESC, challenger) AS rn FROM (SELECT s.*, a.rank_a AS ca, v.rank_a AS va, a.rank_b AS cb, v.rank_b AS vb FROM swap_pairs s JOIN two_ranker_fusion a ON s.customer_id = a.customer_id AND s.challenger = a.article_id JOIN two_ranker_fusion v ON s.customer_id = v.customer_id AND s.victim = v.article_id WHERE s.victim_rank = {p.metric_k}) x WHERE cb < vb OR ca < va) y WHERE rn = 1"


@G.query
def cold_injection(d, p):
    """Active users: the first two cold items take the last slots, the rest keep their order."""
    return f"""SELECT customer_id, article_id, final_rank, 'kept' AS origin FROM two_ranker_fusion WHERE final_rank <= {p.metric_k} - 2 UNION ALL
SELECT c.customer_id, c.article_id, {p.metric_k} - 2 + row_number() OVER (PARTITION BY c.customer_id ORDER BY c.source_rank) AS final_rank, 'cold' AS origin FROM (SELECT k.*, row_number() OVER (PARTITION BY k.customer_id ORDER BY k.source_rank) AS rn FROM src_cold_season k LEFT JOIN two_ranker_fusion t ON k.customer_id = t.customer_id AND k.article_id = t.article_id AND t.final_rank <= {p.metric_k} WHERE t.article_id IS NULL) c WHERE c.rn <= 2"""


@G.query
def oracle_replacement(d, p):
    """The label-aware bound: hits beyond the slate replace misses in the open slots, first to last."""
    return f"""SELECT c.customer_id, c.article_id AS inserted, v.article_id AS removed, v.final_rank FROM (SELECT customer_id, article_id, row_number() OVER (PARTITION BY customer_id ORDER BY final_rank) AS k FROM two_ranker_fusion WHERE final_rank > {p.metric_k} AND target = 1) c
JOIN (SELECT customer_id, article_id, final_rank, row_number() OVER (PARTITION BY customer_id ORDER BY final_rank) AS k FROM two_ranker_fusion WHERE final_rank > {p.head} AND final_rank <= {p.metric_k} AND target = 0) v ON c.customer_id = v.customer_id AND c.k = v.k"""


@G.query
def single_slot_gain(d, p):
    """The change of average precision for putting a hit into each open slot."""
    return f"""SELECT v.customer_id, v.final_rank AS slot, v.target AS had, round((1 - v.target) * ((v.hits + 1) / cast(v.final_rank as double) + (e.inverse - v.inverse)) / least(coalesce(n.n, 1), {p.metric_k}), 8) AS gain FROM hit_sums v JOIN hit_sums e ON v.customer_id = e.customer_id AND e.final_rank = {p.metric_k} LEFT JOIN truth_counts n ON v.customer_id = n.customer_id WHERE v.final_rank > {p.head} AND v.final_rank <= {p.metric_k}"""


@G.query
def midrank_gate(d, p):
    """Users whose best challenger lies in the top fifth by average-tie percentile of its score."""
    return """SELECT customer_id, challenger, round((below + (ties + 1) / 2.0) / n, 6) AS percentile FROM (SELECT customer_id, challenger, rank() OVER (ORDER BY score_gap) - 1 AS below, count(*) OVER (PARTITION BY score_gap) AS ties, count(*) OVER (PARTITION BY 1) AS n FROM (
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score_gap DESC, challenger, victim) AS rn FROM swap_pairs) x WHERE rn = 1) y WHERE (below + (ties + 1) / 2.0) / n > 0.8"""


@G.query
def best_cold_per_user(d, p):
    """The best cold candidate of each user."""
    return "SELECT customer_id, article_id, source_score FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY source_score DESC, article_id) AS rn FROM src_cold_content) x WHERE rn = 1"


@G.query
def quota_admission(d, p):
    """The best cold item of each user into slot 12, for the fifth of users where it scores highest."""
    return f"""SELECT b.customer_id, b.article_id, t.article_id AS victim FROM (SELECT *, row_number() OVER (ORDER BY source_score DESC, customer_id) AS rn, count(*) OVER (PARTITION BY 1) AS n FROM best_cold_per_user) b JOIN two_ranker_fusion t ON b.customer_id = t.customer_id AND t.final_rank = {p.metric_k} WHERE b.rn <= ceil(b.n * 0.2)"""


@G.query
def action_utility(d, p):
    """Three-class utility of each user's best pair: benefit mass less harm mass, and the conditional gate."""
    return """SELECT customer_id, challenger, victim, round(pb * mb - ph * mh, 6) AS utility, CASE WHEN pb / (pb + ph) > mh / (mb + mh) THEN 1 ELSE 0 END AS passes FROM (SELECT customer_id, challenger, victim, 1 / (1 + exp(-vote_gap)) * 0.5 AS pb, (1 - 1 / (1 + exp(-vote_gap))) * 0.5 AS ph, 1.0 / victim_rank AS mb, 1.0 / (victim_rank + 1) AS mh, row_number() OVER (PARTITION BY customer_id ORDER BY vote_gap DESC, challenger, victim) AS rn FROM swap_pairs) x WHERE rn = 1"""


@G.query
def screened_choice(d, p):
    """Per user the fused or the first model's slate, by which ranks the user's pool score higher, in two stable folds."""
    return f"SELECT customer_id, {d.number(f'md5({d.text("customer_id")})')} % 2 AS fold, CASE WHEN corr_a > corr_b THEN 'a' ELSE 'b' END AS choice FROM (SELECT customer_id, round(coalesce(corr(cast(rank_a as double), cast(final_rank as double)), 0), 6) AS corr_a, round(coalesce(corr(cast(rank_b as double), cast(final_rank as double)), 0), 6) AS corr_b FROM two_ranker_fusion GROUP BY customer_id) x"
