from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stoagraph.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12))
def test_every_item_once_within_capacity(hist):
    lengths, counts = np.array(sorted(hist)), np.array([hist[k] for k in sorted(hist)])
    packed, bound = P.configuration_program(lengths, counts, 50)
    assert (sum(c * t for c, t in packed) == counts).all()
    assert all((c * lengths).sum() <= 50 for c, _ in packed)
    n = sum(t for _, t in packed)
    assert n >= bound - 1e-9 and n >= (lengths * counts).sum() / 50


def test_knapsack_against_all_configurations():
    lengths, prices = np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0])
    for capacity in range(1, 25):
        best = max(2.0 * a + 3.1 * b + 5.0 * c for a in range(9) for b in range(7) for c in range(4) if 3 * a + 4 * b + 7 * c <= capacity)
        assert (P.best_configuration(lengths, prices, capacity) * prices).sum() == pytest.approx(best)
        most = np.array([2, 1, 1])
        best = max(2.0 * a + 3.1 * b + 5.0 * c for a in range(3) for b in range(2) for c in range(2) if 3 * a + 4 * b + 7 * c <= capacity)
        found = P.best_configuration(lengths, prices, capacity, most)
        assert (found * prices).sum() == pytest.approx(best) and (found <= most).all()


def test_hard_halves_reach_the_bound():
    lengths, counts = np.array([30, 35, 65, 70]), np.array([500, 500, 500, 500])
    packed, bound = P.configuration_program(lengths, counts, 100)
    assert sum(t for _, t in packed) <= bound * 1.02 + 1


def _greedy(lengths, counts, capacity):
    """First fit by falling size."""
    rooms = []
    for size in np.repeat(lengths, counts)[::-1].tolist():
        k = next((k for k, r in enumerate(rooms) if r >= size), None)
        if k is None:
            rooms.append(capacity)
            k = -1
        rooms[k] -= size
    return len(rooms)


#: Lengths, their counts and a capacity that first fit needs one to four containers more for than there must be.
HARD = [
    ([8, 13, 18, 19, 33], [71, 60, 31, 75, 22], 57),
    ([16, 21, 54], [56, 49, 40], 107),
    ([20, 25, 37], [11, 22, 35], 87),
    ([24, 26, 27], [49, 43, 74], 99),
]


@pytest.mark.parametrize("lengths,counts,capacity", HARD)
def test_program_wins_where_greedy_loses(lengths, counts, capacity):
    lengths, counts = np.array(lengths), np.array(counts)
    packed, bound = P.configuration_program(lengths, counts, capacity)
    n = sum(t for _, t in packed)
    assert n == int(np.ceil(bound - 1e-9)) < _greedy(lengths, counts, capacity)


def test_packed_table(spark):
    sizes = {1: 5, 2: 0, 3: 25, 4: 10, 5: 10, 6: 3, 7: 7, 8: 20} | {100 + i: 10 for i in range(200)}
    df = spark.createDataFrame(list(sizes.items()), "item_id bigint, n_tokens bigint").selectExpr("item_id", "n_tokens", "1 AS rank")
    packed, bound = P.pack(df, 10)
    rows = packed.collect()
    got = Counter()
    for r in rows:
        got[r["item_id"]] += r["n_tokens"]
    assert got == Counter({k: v for k, v in sizes.items() if v})
    assert len({(r["item_id"], r["piece_no"]) for r in rows}) == len(rows)
    load = {r["container_id"]: r for r in P.containers(packed, 10).collect()}
    assert max(r["n_tokens"] for r in load.values()) <= 10 and len(load) >= bound
    assert sorted(load) == list(range(len(load)))
    ranks = P.ranked(P.split_items(df, 10), 400, per_bucket=30).collect()
    by = {}
    for r in ranks:
        by.setdefault(r["n_tokens"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_tokens_and_empty(spark):
    texts = [(1, "a b"), (2, None), (3, ""), (4, "word " * 5000), (5, "z" * 20000), (6, "<|endoftext|>")]
    out = {r["item_id"]: r["n_tokens"] for r in P.token_counts(spark.createDataFrame(texts, "id bigint, text string"), "id", "text").collect()}
    assert set(out) == {1, 4, 5, 6} and out[1] == 2 and out[4] >= 5000 and out[6] > 1
    packed, bound = P.pack(spark.createDataFrame([], "item_id bigint, n_tokens bigint"))
    assert packed.count() == 0 and bound == 0
