"""Trie of conversations against a dictionary of prefixes, on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from turnstore.llm import prefix_trie

RND = random.Random(1)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TEXTS = ["hi there", "x y\tz", "", None, "lo ng"]
ROWS = [(c, None if t == 0 and c % 9 == 0 else t, RND.choice(["u", "a", None]), RND.choice(TEXTS))
        for c in [*range(130), -3, -45, 200, 203, 205] for t in range(RND.choice([1, 1, 2, 3, 5, 9]))]
ROWS += [(c, t, "u", "same") for c in (300, 320, 340) for t in range(60)]
ROWS += [(c, t, "u", "z" if c == 380 and t == 35 else f"deep {t}") for c in (360, 380) for t in range(70)]
ROWS += [(None, 1, "u", "nobody's"), (210, 2, "u", "again"), (210, 2, "u", "again")]


def brute(rows):
    original = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in original.items()}
    whole, members, children = {}, collections.defaultdict(list), collections.defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = tuple(original.get(leader, [])[:h] + own[h:])
        for depth in range(len(whole[c]) + 1):
            members[whole[c][:depth]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals, found = {}, collections.Counter()
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[n] for n in children[node]]
        totals[node] = (sum(b[0] for b in below) or 1, (len(members[node]) - 1) * words + sum(b[1] for b in below))
    for node, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(node))
        found[min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), *totals[node],
              hashlib.sha256(ends.encode()).hexdigest()] += 1
    return found


def trie(turns, **limits):
    conv = F.col("conv_id")
    blocks = {"block_turns": limits["block_turns"]} if limits else {}
    conversations, rebuilt = prefix_trie.rebuilt_turns(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4, **blocks)
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(conversations, rebuilt, **limits).collect())


@pytest.mark.parametrize("limits", [{}, {"shard_nodes": 25, "queue_messages": 3, "block_turns": 7}])
def test_trie(spark, monkeypatch, limits):
    if limits:
        monkeypatch.setattr(prefix_trie, "ID_CHARS", 5)
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, place string, depth int")
    assert trie(turns.repartition(3), **limits) == brute(ROWS)


def test_empty_table(spark):
    assert not trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))


def test_queue_spills_and_keeps_order():
    queue, items = prefix_trie.SpillingQueue(2, bound=10), [(RND.randrange(50), i) for i in range(500)]
    out = []
    for i, item in enumerate(items):
        queue.push(item)
        if i % 3 == 2:
            out.append(queue.pop())
    rest = []
    while queue.least() is not None:
        rest.append(queue.pop())
    assert rest == sorted(rest) and sorted(out + rest) == sorted(items) and queue.least() is None
