import random
import zlib

import numpy as np
import pytest

from folioscope.llm import sharding


def plain_difference(sizes, k):
    """Differencing with whole member lists, the two of the largest spread at a time."""
    parts = [(i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b), *rest = parts
        joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        parts = [*rest, (made, sorted(joined, key=lambda x: -x[0]))]
        made += 1
    return sorted(total for total, _ in parts[0][1])


@pytest.mark.parametrize("seed", range(5))
def test_differencing_gives_the_plain_sums(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 1000) for _ in range(40)]
    k = rng.choice([2, 3, 7])
    sums = np.zeros((len(sizes), k), np.int64)
    sums[:, 0] = sizes
    shard = sharding.difference(sums)[:, 0]
    totals = sorted(np.bincount(shard, weights=sizes, minlength=k).astype(int).tolist())
    assert totals == plain_difference(sizes, k)


@pytest.mark.parametrize("bundles", [sharding.BUNDLES, 10])
def test_rows_groups_slots_and_balance(docs_of, bundles):
    random.seed(4)
    texts = ["é" * random.randint(0, 300) + str(i) for i in range(300)] + ["same"] * 40 + [None, "", "x" * 3000]
    docs = docs_of([(random.choice([None, 1, 2, i]), t) for i, t in enumerate(texts)])
    rows = sharding.shard_rows(docs, 6, bundles=bundles).collect()
    assert len(rows) == len(texts)
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts
    )
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in group) == list(range(len(group))) for group in by_shard.values())
    assert len({(r.text_crc32, r.shard) for r in rows}) == len({r.text_crc32 for r in rows})
    totals = [sum(r.size for r in group) for group in by_shard.values()]
    assert len(totals) == 6 and max(totals) - min(totals) <= 20


def test_a_group_larger_than_a_shard_leaves_the_others_equal(docs_of):
    random.seed(8)
    docs = docs_of(["hot"] * 1000 + ["x" * random.randint(1, 60) + str(i) for i in range(400)])
    rows = sharding.shard_rows(docs, 5, bundles=100).collect()
    totals = {}
    for r in rows:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    *others, hot = sorted(totals.values())
    assert hot == 11_000 and max(others) - min(others) <= 20


def test_few_rows_and_none(docs_of):
    rows = sharding.shard_rows(docs_of(["a", "b"]), 24).collect()
    assert len({r.shard for r in rows}) == 2 and [r.slot for r in rows] == [0, 0]
    assert sharding.shard_rows(docs_of(["a"]).filter("false"), 24).count() == 0
