"""Filling fixed-capacity containers with items.

Documents within the capacity are never split; a larger one becomes full pieces,
each a container of its own, and a rest that is packed like a document. A grouping
genetic algorithm packs them: a chromosome is a list of containers; crossover
injects the best filled containers of one parent into the other, drops those that
then hold an item twice, and reinserts the displaced items by best fit.

Items are spread over blocks of about `block` items, and every block is evolved on
`islands` islands, each a task of its own. An island rests as soon as one of its
chromosomes takes the fewest containers the items' total size allows. After each epoch the islands' elites
migrate to their neighbours through a table in the shared folder. The
containers that stay below `full` of the capacity are opened, and their items form
new blocks in a second pass. Nothing grows with the data but the number of blocks.

Defined cases: NULL, empty and blank texts have no tokens and take no container;
ids that repeat are items of their own (each row has a number of its own); items
of exactly the capacity fill one container; very long texts are cut every
`capacity` tokens; an empty table gives no containers. Only named columns are
read, so others can't clash.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiza.functions.lineage import written
from tamiza.llm.tokens import n_tokens

Bins = list[list[int]]


def best_fit(items: list[int], size: np.ndarray, capacity: int, bins: Bins, load: list[int]) -> None:
    """Adds items, largest first, each to the fullest container that takes it."""
    free = sorted((capacity - x, i) for i, x in enumerate(load))
    for it in sorted(items, key=lambda i: -size[i]):
        s = int(size[it])
        at = bisect.bisect_left(free, (s, -1))
        if at == len(free):
            bins.append([it])
            load.append(s)
            bisect.insort(free, (capacity - s, len(bins) - 1))
        else:
            left, i = free.pop(at)
            bins[i].append(it)
            load[i] += s
            bisect.insort(free, (left - s, i))


def fitness(load: np.ndarray, capacity: int) -> float:
    """Mean squared fill: rewards well filled containers rather than evenly filled ones."""
    return float(np.mean((load / capacity) ** 2)) if len(load) else 0.0


def _loads(bins: Bins, size: np.ndarray) -> list[int]:
    if not bins:
        return []
    of = np.fromiter((i for b in bins for i in b), dtype=np.int64)
    return np.add.reduceat(size[of], np.cumsum([0, *map(len, bins[:-1])])).tolist()


def crossover(a: Bins, b: Bins, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Injects well filled containers of b into a."""
    load = np.array(_loads(b, size))
    share = rng.uniform(0.1, 0.5)
    order = np.argsort(-load + rng.integers(0, max(2, capacity // 200), len(load)), kind="stable")
    inject = [list(b[i]) for i in order[: max(1, int(len(b) * share))]]
    taken = np.zeros(len(size), dtype=bool)
    for g in inject:
        taken[g] = True
    kept, displaced = [], []
    for g in a:
        twice = taken[g]
        if twice.any():
            displaced += [i for i, t in zip(g, twice) if not t]
        else:
            kept.append(list(g))
    out = inject + kept
    best_fit(displaced, size, capacity, out, _loads(out, size))
    return out


def mutate(a: Bins, size: np.ndarray, capacity: int, rng: np.random.Generator) -> Bins:
    """Opens the emptiest containers and a few others."""
    load = np.array(_loads(a, size))
    k = max(2, len(a) // 20)
    worst = set(np.argsort(load)[:k].tolist()) | set(rng.integers(0, len(a), k).tolist())
    out = [list(g) for i, g in enumerate(a) if i not in worst]
    displaced = [i for w in worst for i in a[w]]
    jitter = size + rng.integers(0, 1 + int(size.max()) // 10, len(size))
    load_ = _loads(out, size)
    free = sorted((capacity - x, i) for i, x in enumerate(load_))
    for it in sorted(displaced, key=lambda i: -jitter[i]):
        s = int(size[it])
        at = bisect.bisect_left(free, (s, -1))
        if at == len(free):
            out.append([it])
            bisect.insort(free, (capacity - s, len(out) - 1))
        else:
            left, i = free.pop(at)
            out[i].append(it)
            bisect.insort(free, (left - s, i))
    return out


def evolve(size: np.ndarray, capacity: int, start: list[Bins], seed: int, population: int, generations: int) -> list[Bins]:
    """The population's best two after some generations on one island."""
    rng = np.random.default_rng(seed)
    every = list(range(len(size)))
    bound = math.ceil(int(size.sum()) / capacity)
    pool = list(start)
    # A packing of `bound` containers leaves nothing to search for: none takes fewer.
    while len(pool) < population and min(map(len, pool), default=bound + 1) > bound:
        bins: Bins = []
        if not pool:
            best_fit(every, size, capacity, bins, [])
        else:
            # Random first fit gives the others something new to inject.
            order = rng.permutation(len(size))
            bins = [every[:0]]
            load = [0]
            for i in order.tolist():
                if load[-1] + size[i] > capacity:
                    bins.append([])
                    load.append(0)
                bins[-1].append(i)
                load[-1] += int(size[i])
            bins = mutate([b for b in bins if b], size, capacity, rng)
        pool.append(bins)
    score = [fitness(np.array(_loads(p, size)), capacity) for p in pool]
    for _ in range(generations):
        if min(map(len, pool)) <= bound:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        a, b = (i, j) if score[i] >= score[j] else (j, i)
        child = crossover(pool[b], pool[a], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        s = fitness(np.array(_loads(child, size)), capacity)
        worst = int(np.argmin(score))
        if s > score[worst]:
            pool[worst], score[worst] = child, s
    return [pool[i] for i in np.argsort([-s for s in score], kind="stable")[:2]]


def _flat(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, g in enumerate(bins):
        for i in g:
            out[i] = k
    return out


def _bins(of: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, k in enumerate(of.tolist()):
        out[k].append(i)
    return [g for g in out if g]


def _pack_blocks(items: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int, tasks: int) -> DataFrame:
    """(block, uid, piece, size, bin): items (block, uid, piece, size) packed within their block. A block's items are bounded by its making."""
    block = items.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("size", "uid", "piece"))).alias("items"))
    block = written(block)
    n_parts = max(1, tasks)
    state = block.select("block", "items", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("elites"))

    for epoch in range(epochs):

        def step(parts: Iterator[pd.DataFrame], epoch: int = epoch) -> Iterator[pd.DataFrame]:
            for p in parts:
                rows = []
                for r in p.itertuples(index=False):
                    size = np.array(r.sizes, dtype=np.int64)
                    start = [_bins(np.array(e)) for e in r.elites if len(e)]
                    got = evolve(size, capacity, start, int(r.block) * 7919 + int(r.island) * 31 + epoch, population, generations)
                    rows.append((r.block, r.island, [_flat(g, len(size)) for g in got], fitness(np.array(_loads(got[0], size)), capacity)))
                yield pd.DataFrame(rows, columns=["block", "island", "elites", "fit"])

        todo = state.select("block", "island", F.transform("items", lambda x: x["size"]).alias("sizes"), "elites").repartition(n_parts, "block", "island")
        done = written(todo.mapInPandas(step, "block long, island int, elites array<array<int>>, fit double"))
        if epoch + 1 < epochs:
            own = done.select("block", "island", "elites")
            moved = done.select("block", ((F.col("island") + 1) % islands).cast("int").alias("island"), F.slice("elites", 1, 1).alias("elites"))
            both = own.unionByName(moved).groupBy("block", "island").agg(F.flatten(F.collect_list("elites")).alias("elites"))
            state = both.join(block, "block")
    best = done.groupBy("block").agg(F.max_by(F.element_at("elites", 1), F.struct("fit", -F.col("island"))).alias("of"))
    packed = best.join(block, "block").select("block", F.posexplode("items").alias("at", "it"), "of")
    return packed.select("block", "it.uid", "it.piece", "it.size", F.get("of", F.col("at")).alias("bin"))


def pieces(df: DataFrame, id_col: str, text: str, capacity: int, path: str | None = None) -> DataFrame:
    """(uid, id, n_tokens, piece, size), written: one row per piece of every document with tokens."""
    sized = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.when(F.col(text).rlike(r"[^\s]"), F.col(text)).alias("t"))
    sized = sized.select("uid", "id", n_tokens(F.col("t"), path).alias("n_tokens")).filter("n_tokens > 0")
    cut = sized.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece"))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * F.lit(capacity).cast("long"))
    return written(cut.select("uid", "id", "n_tokens", "piece", size.alias("size")))


def pack(df: DataFrame, id_col: str, text: str, capacity: int, path: str | None = None, block: int = 1000, islands: int = 3, epochs: int = 2, population: int = 5, generations: int = 12, full: float = 0.97) -> DataFrame:
    """(container, id, uid, piece, size, n_tokens): every piece in exactly one container of at most `capacity` tokens."""
    spark = df.sparkSession
    own = pieces(df, id_col, text, capacity, path)
    whole = own.filter(F.col("size") == capacity).select(F.concat_ws("-", F.lit("f"), "uid", "piece").alias("container"), "uid", "piece")
    rest = own.filter(F.col("size") < capacity).select("uid", "piece", "size")
    width = spark.sparkContext.defaultParallelism * 3

    def blocks(items: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(items.count() / block))
        return items.withColumn("block", F.pmod(F.xxhash64("uid", "piece"), F.lit(n))), n

    first, n = blocks(rest)
    packed = written(_pack_blocks(first, capacity, islands, epochs, population, generations, min(n * islands, max(width, n * islands // 8))))
    load = packed.groupBy("block", "bin").agg(F.sum("size").alias("load"))
    kept = packed.join(load.filter(F.col("load") >= F.lit(full) * capacity), ["block", "bin"])
    opened = written(packed.join(load.filter(F.col("load") < F.lit(full) * capacity), ["block", "bin"]).select("uid", "piece", "size"))
    second, m = blocks(opened)
    again = _pack_blocks(second, capacity, islands, epochs, population, generations, min(m * islands, max(width, m * islands // 8)))
    name = lambda tag: F.concat_ws("-", F.lit(tag), "block", "bin").alias("container")
    at = whole.unionByName(kept.select(name("a"), "uid", "piece")).unionByName(again.select(name("b"), "uid", "piece"))
    return at.join(own, ["uid", "piece"]).select("container", "id", "uid", "piece", "size", "n_tokens")
