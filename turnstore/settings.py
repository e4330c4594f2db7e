"""Defaults that define what the jobs return."""

from __future__ import annotations

from dataclasses import dataclass

# Results depend on them, so they are stated once, here.
RECALL_WEIGHT = 0.5            # share of the recall question in the fused score
RETURN_LIMIT = 100             # most memories returned for one query
RETURN_CHAR_BUDGET = 400_000   # most characters returned for one query
WINDOW_RADIUS = 1              # turns brought along on either side of a hit
MAX_FACTS = 24                 # facts kept from one model reply
MIN_FACT_CHARS = 3             # a bullet line must be longer than this
DEDUPE_KEY_CHARS = 120         # code points compared for near-duplicates
PROMPT_OPTIONS = 10            # answer options shown to a model
REFLECT_ITEMS = 15             # results shown to the reflection model
REFLECT_CHARS = 200            # code points of each of them
SECONDS_BELOW = 100_000_000_000  # positive timestamps below this are seconds
MIN_MILLIS = -62_135_596_800_000  # 0001-01-01T00:00:00Z
MAX_MILLIS = 253_402_300_799_999  # 9999-12-31T23:59:59.999Z
CORPUS_CHUNK_TURNS = 20        # turns in one replayed Add request
CORPUS_TURN_MILLIS = 60_000    # spacing of replayed turns
CORPUS_DEFAULT_MILLIS = 1_672_531_200_000  # 2023-01-01T00:00:00Z
EXCLUDED_CATEGORY = 5          # questions without a supporting memory
RECALL_CUTOFFS = (1, 5, 10, 20, 40, 100)
KIND_CUTOFF = 20               # cutoff of the per-kind and per-category recall
JUDGE_RAW_CHARS = 400          # code points of a judge's reply that are kept
EMBED_BATCH = 64               # texts an embedding model gets at once
DEGRADED_MIN_CALLS = 5
DEGRADED_FAILURE_SHARE = 0.5
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CORRECT = "CORRECT"
RRF_K = 60
RRF_CANDIDATES = 200
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
CHUNK_CAP = 2                  # memories per source chunk in the diversity arm

# Scores are compared at this precision, so that the summation order inside a
# task never decides a rank; equal scores are ordered by ``seq``.
SCORE_DECIMALS = 9


@dataclass(frozen=True)
class SearchSettings:
    """Knobs of one search job."""

    recall_weight: float = RECALL_WEIGHT
    return_limit: int = RETURN_LIMIT
    char_budget: int = RETURN_CHAR_BUDGET
    radius: int = WINDOW_RADIUS
    ordering: str = "raw_first"
    second_round: bool = False
    # Hits ranked per query in the first pass, as a multiple of the largest answer.
    hit_factor: int = 2
    # Two-level merging of hits, for users whose memories lie in very many blocks; 0 for one level.
    salts: int = 0
