"""Parameters of the operators, with the defaults of production and those that suit the small test feed."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Params:
    cutoff: str = "2020-09-16"
    label_days: int = 7
    history_days: int = 84
    popular_days: int = 28
    covisit_days: int = 28
    basket_cap: int = 20
    min_pairs: int = 2
    source_k: int = 100
    candidate_k: int = 100
    neighbours: int = 50
    rrf: int = 60
    seeds: int = 5
    content_seeds: int = 20
    type_pool: int = 50
    group_pool: int = 30
    knn: int = 100
    item_candidates: int = 300
    append_k: int = 200
    global_k: int = 50
    metric_k: int = 12
    head: int = 7
    min_lift: float = 1.15
    min_prior_events: int = 50
    negatives: int = 30
    seed: int = 20260831
    #: share of users in a run, in ten-thousandths; 10000 takes all
    user_rate: int = 10_000
    #: neighbours' postings that a user may read, shared among the items bought
    postings: int = 2000
    #: simulates cold articles on a feed without any: those whose id divides by this lose their sales before the cutoff; 0 hides none
    hidden: int = 0

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.type == "int" and getattr(self, f.name) < 0:
                raise ValueError(f"{f.name} must not be negative")
        if self.head >= self.metric_k:
            raise ValueError("the protected head must be shorter than the slate")


#: The test feed is sparse: wider windows, no minimum pair count, a lower minimum of events, and a twentieth of its articles made cold. All limits are the defaults.
SMALL_FEED = Params(cutoff="2001-07-26", history_days=364, popular_days=364, covisit_days=364, min_pairs=1, min_prior_events=5, hidden=20)
