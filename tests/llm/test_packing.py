import random

import pytest
from stationweave.llm import packing
from stationweave.llm.packing import pack


def test_every_item_once_and_none_beyond_capacity():
    r = random.Random(3)
    for capacity in (1, 7, 64):
        sizes = [r.randint(1, capacity) for _ in range(300)]
        sources = [r.choice("abc") for _ in sizes]
        container, place, n = pack(sizes, sources, capacity, {"a": 0.5, "b": 0.5}, {})
        assert set(container) == set(range(n))
        assert len(set(zip(container, place))) == len(sizes)
        assert all(sum(s for s, c in zip(sizes, container) if c == k) <= capacity for k in range(n))


def test_containers_keep_the_proportions():
    r = random.Random(5)
    share = {"a": 0.5, "b": 0.3, "c": 0.2}
    sources = r.choices(list(share), list(share.values()), k=20_000)
    sizes = [r.choice((3, 8, 20, 60)) for _ in sources]
    container, _, n = pack(sizes, sources, 512, share, {})
    held = [dict.fromkeys(share, 0) for _ in range(n)]
    for c, s, k in zip(container, sources, sizes):
        held[c][s] += k
    assert sum(sizes) > 0.995 * 512 * n
    for h in held[: int(0.9 * n)]:
        assert all(abs(h[s] / sum(h.values()) - w) < 0.13 for s, w in share.items())


def rows_of(spark, **how):
    r = random.Random(9)
    data = [(i, r.choice(["x", "y", None]), r.choice([0, 1, 5, 40, 99, 100, 101, 730])) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    return {d[0]: d for d in data}, packing.pack_corpus(df, capacity=100, shard_tokens=8000, **how).collect()


@pytest.mark.parametrize("mixture", [None, {"x": 3.0, "z": 1.0}])
def test_whole_corpus(spark, mixture):
    docs, rows = rows_of(spark, mixture=mixture)
    held, parts = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append((r.token_from, r.size))
        if r.container_id is not None:
            held[r.container_id] = held.get(r.container_id, 0) + r.size
    assert parts.keys() == docs.keys() and max(held.values()) <= 100
    for k, p in parts.items():
        n = docs[k][2]
        assert len(p) == 1 or n > 100
        assert [a for a, _ in sorted(p)] == [sum(s for _, s in sorted(p)[:i]) for i in range(len(p))]
        assert sum(s for _, s in p) == n
    assert sum(held.values()) > 0.97 * 100 * len(held)


def test_deficits_go_on_across_shards(spark):
    rows = spark.createDataFrame([(s, v) for s in range(3000) for v in (1,)], "shard bigint, tokens bigint")
    got = {r.shard: r.before for r in packing._sum_before(rows, "tokens", "before").collect()}
    assert got == {s: s for s in range(3000)}
    keyed = spark.createDataFrame([("a", 0, 5), ("a", 2, 7), ("b", 1100, 1), ("a", 2500, 1)], "src string, shard bigint, tokens bigint")
    got = {(r.src, r.shard): r.before for r in packing._sum_before(keyed, "tokens", "before", "src").collect()}
    assert got == {("a", 0): 0, ("a", 2): 5, ("a", 2500): 12, ("b", 1100): 0}


def test_empty_corpus(spark):
    assert packing.pack_corpus(spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")).count() == 0
