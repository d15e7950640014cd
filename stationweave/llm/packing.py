"""Texts into containers of a fixed number of tokens, mixed by source.

Each source is a queue. For every container each queue's deficit grows by its
share of the capacity. The queues take turns, the one that is owed most first,
and place one item a turn, their largest that fits into the space left; what an
item has beyond its queue's deficit is owed back by later containers. Deficits are
carried from container to container. The corpus is packed in shards of a bounded
number of tokens; what a shard's queues start with is the deficit that all shards
before it leave, known beforehand from the sums per shard and source, so the
shards need not wait for each other.

Large items go first, while many small ones are left to fill up with, so a
container lacks its proportions only by what its large item has too much.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: A text beyond the capacity is cut into parts of so many tokens: smaller than a container, so that each container can mix sources.
PART_TOKENS = CAPACITY // 4
#: Tokens of a shard; a shard is packed by one task and leaves at most one container badly filled.
SHARD_TOKENS = 4_000_000
#: Shards whose sums are added up together, before the sums of such blocks are.
BLOCK = 1024


class _Queue:
    """Items of one source by size: the largest that fits is found by bisection."""

    def __init__(self):
        self.sizes: list[int] = []
        self.items: dict[int, list[int]] = {}
        self.left = 0

    def add(self, size: int, item: int) -> None:
        if size not in self.items:
            self.items[size] = []
            self.sizes.append(size)
        self.items[size].append(item)
        self.left += 1

    def seal(self) -> None:
        self.sizes.sort()

    def fitting(self, space: int) -> int:
        """Size of the largest item of at most `space`, or 0."""
        k = bisect_right(self.sizes, space)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        held = self.items[size]
        item = held.pop()
        self.left -= 1
        if not held:
            del self.items[size]
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return item


def pack(
    sizes: list[int], sources: list[str], capacity: int, share: dict[str, float], deficit: dict[str, float]
) -> tuple[list[int], list[int], int]:
    """(container of each item, place in it, number of containers) by deficit round-robin.

    sizes are 1 to capacity. share: part of each container that a source should
    fill; a source that isn't named has none, and its items only fill space left
    over. deficit: tokens that each source is owed at the start. Of equal sizes
    the last item goes first, of equal deficits the source first by name.
    """
    queues: dict[str, _Queue] = {}
    for i, (n, s) in enumerate(zip(sizes, sources)):
        queues.setdefault(s, _Queue()).add(n, i)
    for q in queues.values():
        q.seal()
    owed = {s: float(deficit.get(s, 0.0)) for s in queues}
    container, place = [0] * len(sizes), [0] * len(sizes)
    left, c = len(sizes), 0
    while left:
        space, at = capacity, 0
        live = [s for s, q in queues.items() if q.left]
        whole = sum(share.get(s, 0.0) for s in live) or 1.0
        for s in live:
            owed[s] += capacity * share.get(s, 0.0) / whole
        while space and left:
            for s in sorted(live, key=lambda s: (-owed[s], s)):
                if size := queues[s].fitting(space):
                    break
            else:
                break
            i = queues[s].take(size)
            container[i], place[i] = c, at
            owed[s] -= size
            space -= size
            at += 1
            left -= 1
        c += 1
    return container, place, c


def items_of(lengths: DataFrame, capacity: int, part_tokens: int) -> DataFrame:
    """One row per item: a text, or of a text beyond the capacity its consecutive parts of `part_tokens` tokens and the rest.

    Texts without tokens are no items.
    """
    beyond = F.col("n_tokens") > capacity
    parts = F.when(beyond, F.ceil(F.col("n_tokens") / F.lit(part_tokens))).otherwise(1).cast("int")
    return (
        lengths.where("n_tokens > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("token_from", F.col("part").cast("bigint") * part_tokens)
        .withColumn(
            "size", F.when(beyond, F.least(F.lit(part_tokens), F.col("n_tokens") - F.col("token_from"))).otherwise(F.col("n_tokens")).cast("int")
        )
    )


def _sum_before(sums: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """sums (shard, keys, value) with the sum of value over all earlier shards of the same keys.

    Added up by blocks of shards, so no key's shards ever meet in one task.
    """
    rows = sums.withColumn("block", F.floor(F.col("shard") / BLOCK))
    blocks = rows.groupBy(*keys, "block").agg(F.sum(value).alias("_all"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_earlier", F.coalesce(F.sum("_all").over(upto(*keys).orderBy("block")), F.lit(0)))
    within = F.coalesce(F.sum(value).over(upto(*keys, "block").orderBy("shard")), F.lit(0))
    return (
        rows.withColumn("_within", within)
        .join(blocks.drop("_all"), [*keys, "block"])
        .withColumn(name, F.col("_earlier") + F.col("_within"))
        .drop("block", "_earlier", "_within")
    )


def pack_corpus(
    lengths: DataFrame, key: str = "doc_id", source: str = "source", capacity: int = CAPACITY,
    mixture: dict[str, float] | None = None, shard_tokens: int = SHARD_TOKENS, part_tokens: int | None = None,
) -> DataFrame:
    """(key, part, token_from, size, container_id, place): every text of a corpus in a container.

    lengths: key, source and n_tokens, best written out before, as it is read
    twice, once (for the number of shards) while the result is being built.
    mixture: weights of the sources; left out, the corpus's own proportions. A
    NULL source is a source of its own. Texts without tokens come out with part
    0, size 0 and a NULL container. Repeated rows are packed as often as they
    come. No text is split unless it alone exceeds the capacity; one that does is
    cut into parts of part_tokens, a quarter of the capacity if left out.
    """
    part_tokens = part_tokens or max(1, capacity // 4)
    rows = lengths.select(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"), "n_tokens"
    )
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(total) // shard_tokens))
    items = items_of(rows, capacity, part_tokens).withColumn(
        "shard", F.pmod(F.xxhash64("key", "part", "n_tokens"), F.lit(shards)).cast("bigint")
    )
    sums = items.groupBy("shard", "src").agg(F.sum("size").alias("tokens"))
    if mixture is None:
        shares = sums.groupBy("src").agg((F.sum("tokens") / F.lit(float(max(int(total), 1)))).alias("share"))
    else:
        whole = float(sum(mixture.values())) or 1.0
        shares = lengths.sparkSession.createDataFrame([(s, w / whole) for s, w in mixture.items()], "src string, share double")
    per_shard = _sum_before(sums.groupBy("shard").agg(F.sum("tokens").alias("all")), "all", "all_before")
    owed = (
        _sum_before(sums, "tokens", "before", "src")
        .join(per_shard, "shard")
        .join(shares, "src", "left")
        .withColumn("share", F.coalesce("share", F.lit(0.0)))
        .withColumn("deficit", F.col("share") * F.col("all_before") - F.col("before"))
        .groupBy(F.col("shard").alias("owed_shard"))
        .agg(F.collect_list(F.struct("src", "share", "deficit")).alias("owed"))  # a shard's own sources
    )

    def run(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "part"], kind="stable")
        given = list(start["owed"].iloc[0]) if len(start) else []
        container, place, _ = pack(
            pdf["size"].tolist(), pdf["src"].tolist(), capacity,
            {o["src"]: o["share"] for o in given}, {o["src"]: o["deficit"] for o in given},
        )
        out = pdf[["key", "part", "token_from", "size"]].copy()
        out["container_id"] = [int(pdf["shard"].iloc[0]) * 10_000_000 + c for c in container]
        out["place"] = place
        return out

    kind = dict(lengths.dtypes)[key]
    schema = f"key {kind}, part int, token_from bigint, size int, container_id bigint, place int"
    packed = items.groupBy("shard").cogroup(owed.groupBy("owed_shard")).applyInPandas(run, schema)
    none = rows.where("n_tokens = 0").select(
        "key", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("token_from"), F.lit(0).alias("size"),
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("place"),
    )
    return packed.unionByName(none).withColumnRenamed("key", key)
