"""What a right selection must satisfy, stated as conditions on its result."""

import re
from itertools import accumulate


def near_key(text):
    return re.sub(r"\s+", " ", text.strip().lower())[:120]


def offers_of(items, scores, radius):
    """All offers in order: hits by score, then age, each followed by the turns around it."""
    ranked = sorted(items, key=lambda i: (-scores[i["id"]], i["seq"]))
    turns = {(i["id"][:16], int(i["id"][18:])): i for i in items if i["id"][17] == "r"}
    offers = []
    for hit in ranked:
        around = []
        if hit["id"][17] == "r":
            here = (hit["id"][:16], int(hit["id"][18:]))
            around = [turns[k] for k in sorted(turns) if k[0] == here[0] and 0 < abs(k[1] - here[1]) <= radius]
        offers += [(o["id"], near_key(o["content"]), len(o["content"]), scores[hit["id"]]) for o in (hit, *around)]
    return offers


def check_selection(got, items, scores, limit, budget, radius):
    """*got*: [(id, score)] in take order. Raises if a condition is broken.

    1. The taken offers stand in the order of the offers, with the score of their hit.
    2. Their keys differ; each but the first fits the budget that those before it leave.
    3. Every offer passed over before the last taken one was unacceptable where it stood:
       its key was already taken, or it did not fit.
    4. The selection ends at the limit, with no budget left, or when no later offer is acceptable.
    """
    offers = offers_of(items, scores, radius) if limit > 0 else []
    places, at = [], 0
    for wanted in got:
        at = next(p for p in range(at, len(offers)) if (offers[p][0], round(offers[p][3], 6)) == wanted)
        places.append(at)
        at += 1
    assert len(got) <= max(limit, 0)
    spent = [0, *accumulate(offers[p][2] for p in places)]

    def acceptable(place, n_before):
        key, size = offers[place][1:3]
        fresh = all(offers[p][1] != key for p in places[:n_before])
        return fresh and (n_before == 0 or size <= budget - spent[n_before])

    for n, place in enumerate(places):
        assert acceptable(place, n)
        assert n == 0 or budget - spent[n] > 0
    for place in set(range(len(offers))) - set(places):
        n_before = sum(p < place for p in places)
        if n_before < len(places):
            assert not acceptable(place, n_before)
        else:
            ended = len(places) >= limit or (places and budget - spent[-1] <= 0)
            assert ended or not acceptable(place, n_before)
