from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import mixing, tokens
from evidara.llm.packing import pack, plan


def filled(runs):
    load, ranks = Counter(), defaultdict(set)
    for size, rank, count, first, each in runs:
        for k in range(count):
            load[first + k // each] += size
            assert rank + k not in ranks[size]
            ranks[size].add(rank + k)
    return load, ranks


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.sampled_from([100, 120, 250]))
def test_plan_is_whole_and_no_worse_than_best_fit(items, capacity):
    load, ranks = filled(plan(dict(Counter(items)), capacity))
    assert {s: len(r) for s, r in ranks.items()} == dict(Counter(items))
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(len(load)))
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    assert len(load) <= len(rooms) + 1


def test_dominating_pairs_are_fixed():
    load, _ = filled(plan({70: 3, 30: 3, 60: 2, 35: 2}, 100))
    assert sorted(load.values()) == [95, 95, 100, 100, 100]


def test_pack(spark):
    rows = [(1, "word " * 300), (2, "a b c"), (3, None), (4, ""), (5, "é😀" * 150), (6, "a b c"), (6, "a b c")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, size int, rank int")
    got = pack(df, "doc_id", "text", 64).collect()
    load = Counter()
    for r in got:
        load[r["container_id"]] += r["size"]
    assert max(load.values()) <= 64
    text = dict(rows)
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start"], r["end"]))
    assert 3 not in spans and len(spans[6]) == 2 and len(spans[2]) == 1 and spans[4] == [(0, 0)]
    for i in (1, 5):
        assert "".join(text[i][a:b] for a, b in sorted(spans[i])) == text[i] and len(spans[i]) > 1
    assert pack(df.limit(0), "doc_id", "text", 64).count() == 0
    assert [r["container_id"] for r in pack(df.where("doc_id = 4"), "doc_id", "text", 64).collect()] == [-1]


def test_pieces_keep_to_the_limit():
    text = "Zürich 😀😀 naïve " * 40
    got = tokens.pieces(text, 10)
    assert "".join(text[a:b] for a, b, _ in got) == text
    assert all(n == len(tokens.encoding().encode_ordinary(text[a:b])) <= 10 for a, b, n in got)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(size, key):
    out = mixing.permuted(np.arange(size), size, np.full(size, key, np.uint64))
    assert sorted(out.tolist()) == list(range(size))


def drawn(totals, shards, seed=4):
    return list(mixing.shard_counts(totals, shards, seed, 0, shards))


def test_shard_counts_come_to_their_totals():
    totals = [5000, 3000, 17, 0]
    got = drawn(totals, 8)
    assert [k for k, *_ in got] == list(range(8))
    assert [sum(x) for x in zip(*(n for _, n, _ in got), strict=True)] == totals
    so_far = [0] * 4
    for _, n, before in got:
        assert before == so_far and min(n) >= 0
        so_far = [a + b for a, b in zip(so_far, n, strict=True)]
    assert {sum(n) for _, n, _ in got} == {1002, 1003}
    assert [x for a in range(8) for x in mixing.shard_counts(totals, 8, 4, a, a + 1)] == got


def test_shard_counts_vary_like_multinomial_draws():
    got = np.array([n for seed in range(40) for _, n, _ in drawn([6400, 3200], 16, seed)])
    assert abs(got[:, 0].std() - (600 * 2 / 9 * 15 / 16) ** 0.5) < 1.2


def test_shard_counts_at_full_size():
    totals = [10**11, 3 * 10**10, 7]
    got = drawn(totals, 130)
    assert [sum(x) for x in zip(*(n for _, n, _ in got), strict=True)] == totals and all(min(n) >= 0 for _, n, _ in got)
    assert {sum(n) for _, n, _ in got} <= {sum(totals) // 130, sum(totals) // 130 + 1}
    last = mixing.shards_of(sum(totals))
    (k, n, before), = mixing.shard_counts(totals, last, 4, last - 1, last)
    assert k == last - 1 and [a + b for a, b in zip(n, before, strict=True)] == totals and sum(n) <= 1025


def test_mix(spark):
    docs = [(i, f"text {i} " * (5 + i % 40), ("big", "small", "none", None)[i % 4] if i % 8 else "big") for i in range(800)]
    docs += [(9001, None, "big"), (9002, "", "small")]
    df = spark.createDataFrame([(*d, 1, 1) for d in docs], "doc_id long, text string, source string, block int, shard int")
    weights = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("absent", 0.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, weights, "doc_id", "text", "source", block=32)
    rows = mixed.collect()
    uses = Counter((r["source"], r["doc_id"], r["tok_from"], r["tok_to"]) for r in rows)
    assert max(n for (s, *_), n in uses.items() if s == "big") == 1
    assert max(n for (s, *_), n in uses.items() if s == "small") <= 3
    assert all(0 < r["tokens"] == r["tok_to"] - r["tok_from"] for r in rows)
    slot = Counter()
    for r in rows:
        slot[(r["shard"], r["slot"])] += r["tokens"]
    assert max(slot.values()) == 32 and sum(v < 32 for v in slot.values()) <= 4
    share = {r["source"]: r for r in mixing.reached(mixed, weights, "doc_id").collect()}
    assert abs(share["big"]["actual_share"] - 0.4) < 0.01 and share["absent"]["tokens"] == 0
    # One whole pass uses every token of the source that limits the mix.
    assert mixing.mix(df.limit(0), weights, "doc_id", "text", "source").count() == 0
    assert mixing.mix(df, weights.limit(0), "doc_id", "text", "source").count() == 0
