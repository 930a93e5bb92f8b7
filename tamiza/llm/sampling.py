"""Sample matching target category proportions.

Needs per category come from the targets; spread over a second attribute they give
a fractional two-way table. Controlled rounding makes it integer by flows: each
cell becomes its floor or ceiling, and so does each column total, while each row
total stays exact. Columns of any number are rounded the same way, streamed in blocks:
fractional cells that form a cycle are pushed round it until one is whole, so a block
never holds more than a forest of them and leaves at most as many columns as there are
targets; max-flow rounds what all blocks leave. The number of blocks is fixed and their
order is that of the values, so quotas hang neither on size nor layout.
Each cell's quota is then drawn exactly: the rows of smallest
random key. The key at which a cell is full is found from counts of key ranges,
and only the range in which the quota ends is ordered, so a cell of any size is
never in one task.

Defined cases: NULL and blank categories are not eligible (nor are NULL ids);
categories compare trimmed and without case; an id with several categories counts
for the smallest; a NULL second attribute is a value of its own; categories without a target
count for the total but are not drawn; a category with fewer ids than it needs
gives all it has and is reported; a category that a plan targets twice is drawn for the larger need; ties cannot occur beyond equal ids; an empty
table meets only needs of 0. Only named columns are read, so others can't clash.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamiza.functions.lineage import written
from tamiza.functions.text import is_blank, strip

#: Ranges of the random key that are counted per cell.
RANGES = 4096
#: Blocks of columns of the quota table. Quotas hang on it.
BLOCKS = 64
#: Cells per Arrow batch.
BATCH = 10_000


def category_form(x: Column) -> Column:
    return F.lower(strip(x.cast("string")))


def eligible(df: DataFrame, id_col: str, category: Column, second: Column, valid: Column) -> DataFrame:
    """(id, category, second): one row per id."""
    rows = df.filter(F.coalesce(valid, F.lit(False)) & F.col(id_col).isNotNull() & ~is_blank(category.cast("string")))
    rows = rows.select(F.col(id_col).alias("id"), category_form(category).alias("category"), F.coalesce(second.cast("string"), F.lit("")).alias("second"))
    return rows.groupBy("id").agg(F.min(F.struct("category", "second")).alias("m")).select("id", "m.category", "m.second")


def columned(rows: DataFrame, most: int) -> DataFrame:
    """rows with at most `most` values of `second`, for callers who want a coarser table; quotas need none. Margins hold for the values that share a column together."""
    if rows.select("second").distinct().limit(most + 1).count() <= most:
        return rows
    return rows.withColumn("second", F.concat(F.lit("group "), F.pmod(F.xxhash64("second"), F.lit(most)).cast("string")))


def needs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, category, need, available, met) per target row of one table: plan, category, sample_pct, target_pct, min_rows."""
    have = rows.groupBy(F.col("category").alias("__c")).agg(F.count("*").alias("__n"))
    n = have.agg(F.sum("__n")).collect()[0][0] or 0  # one number
    t = targets.join(have, category_form(F.col("category")) == F.col("__c"), "left")
    size = F.floor(F.lit(n) * F.col("sample_pct") / 100)
    need = F.greatest(F.col("min_rows").cast("long"), F.ceil(size * F.col("target_pct") / 100))
    t = t.select("plan", "category", need.alias("need"), F.coalesce("__n", F.lit(0)).alias("available"))
    return t.withColumn("met", F.col("available") >= F.col("need"))


def controlled_rounding(table: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """Integer table: cells and column totals at their floor or ceiling, row totals (whole numbers) kept."""
    low = {k: math.floor(v + 1e-9) for k, v in table.items()}
    rows: dict[str, float] = {}
    cols: dict[str, float] = {}
    for (r, c), v in table.items():
        rows[r] = rows.get(r, 0.0) + v
        cols[c] = cols.get(c, 0.0) + v
    # What the floors leave of each margin; a column may take its floor or its ceiling.
    supply = {r: round(v) - sum(n for (a, _), n in low.items() if a == r) for r, v in rows.items()}
    least = {c: math.floor(v + 1e-9) - sum(n for (_, b), n in low.items() if b == c) for c, v in cols.items()}
    most = {c: math.ceil(v - 1e-9) - sum(n for (_, b), n in low.items() if b == c) for c, v in cols.items()}
    cap: dict[tuple, int] = {}
    out: dict[object, list] = {}

    def edge(a, b, n: int) -> None:
        cap[a, b] = cap.get((a, b), 0) + n
        cap.setdefault((b, a), 0)
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)

    for r, n in supply.items():
        edge("s", ("r", r), n)
    for k, v in table.items():
        if v - low[k] > 1e-9:
            edge(("r", k[0]), ("c", k[1]), 1)
    for c in cols:
        edge(("c", c), "floors", least[c])
        edge(("c", c), "t", most[c] - least[c])
    edge("floors", "t", 0)

    def push(goal: str) -> int:
        """Breadth-first augmenting paths from s."""
        done = 0
        while True:
            before: dict = {"s": None}
            queue = deque(["s"])
            while queue and goal not in before:
                a = queue.popleft()
                for b in out.get(a, ()):
                    if b not in before and cap[a, b] > 0:
                        before[b] = a
                        queue.append(b)
            if goal not in before:
                return done
            path, b = [], goal
            while before[b] is not None:
                path.append((before[b], b))
                b = before[b]
            n = min(cap[e] for e in path)
            for a, b in path:
                cap[a, b] -= n
                cap[b, a] += n
            done += n

    push("floors")  # every column its floor first; later paths never take it back below
    push("t")
    return {k: low[k] + (1 if v - low[k] > 1e-9 and cap[("r", k[0]), ("c", k[1])] == 0 else 0) for k, v in table.items()}


class Forest:
    """The cells of a table that are not whole yet, in parts of `one`, as edges between rows (numbers) and columns (texts); without cycles."""

    def __init__(self, one: int):
        self.one, self.near, self.part = one, {}, {}

    def add(self, row: int, column: str, x: int) -> list[tuple[int, str, int]]:
        """Adds a cell. If it closes a cycle, its cells rise and fall in turn until one is whole, which keeps every total. The cells that are whole then, as 0 or 1."""
        before: dict = {column: None}
        todo = [column]
        while todo and row not in before:
            a = todo.pop()
            for b in self.near.get(a, ()):
                if b not in before:
                    before[b] = a
                    todo.append(b)
        self.part[row, column] = x
        self.near.setdefault(row, {})[column] = self.near.setdefault(column, {})[row] = None
        if row not in before:
            return []
        path, a = [], row
        while before[a] is not None:
            path.append((a, before[a]) if isinstance(a, int) else (before[a], a))
            a = before[a]
        up, down = path[::2], [(row, column), *path[1::2]]
        n = min(*(self.one - self.part[e] for e in up), *(self.part[e] for e in down))
        for e in up:
            self.part[e] += n
        for e in down:
            self.part[e] -= n
        return [(*e, self.drop(*e)) for e in path + [(row, column)] if self.part[e] in (0, self.one)]

    def drop(self, row: int, column: str) -> int:
        for a, b in ((row, column), (column, row)):
            del self.near[a][b]
            if not self.near[a]:
                del self.near[a]
        return self.part.pop((row, column)) // self.one


def reduced(columns: Iterable[tuple[str, list[tuple[str, int]]]], shares: dict[str, dict[str, tuple[int, int]]]) -> Iterator[tuple[str, str, str, int, float]]:
    """(plan, category, column, quota, part): every cell of a block, whole (part 0) or its floor and what is left of it.

    columns: each with its categories' counts; shares: of each plan, (take, available) by category. Row totals and what columns
    may still take stay exact; no plan is left with parts in more columns than it has categories. A column total is whole with a cell of
    no category (row -1) that holds what it lacks."""
    plans = []
    for plan, share in shares.items():
        plans.append((plan, share, {c: i for i, c in enumerate(share)}, list(share), Forest(math.lcm(*(n for _, n in share.values()))), {}))
    for column, cells in columns:
        for plan, share, index, names, forest, low in plans:
            total, settled = 0, []
            for c, n in cells:
                if c in share:
                    take, available = share[c]
                    floor, x = divmod(take * n, available)
                    if x == 0:
                        yield plan, c, column, floor, 0.0
                        continue
                    x *= forest.one // available
                    total += x
                    low[index[c], column] = floor
                    settled += forest.add(index[c], column, x)
            if total % forest.one:
                settled += forest.add(-1, column, -total % forest.one)
            for row, name, up in settled:
                if row >= 0:
                    yield plan, names[row], name, low.pop((row, name)) + up, 0.0
    for plan, _, _, names, forest, low in plans:
        for (row, column), floor in low.items():
            yield plan, names[row], column, floor, forest.part[row, column] / forest.one


def quotas(rows: DataFrame, need: DataFrame) -> DataFrame:
    """(plan, category, second, quota): the integer table of every plan; any number of values of `second`."""
    spark = rows.sparkSession
    wanted = need.select("plan", category_form(F.col("category")).alias("category"), F.least("need", "available").alias("take"), "available").filter("take > 0")
    shares: dict[str, dict[str, tuple[int, int]]] = {}
    for r in sorted(wanted.collect(), key=lambda r: (r["category"], r["take"])):  # one row per target
        shares.setdefault(r["plan"], {})[r["category"]] = (r["take"], r["available"])
    schema = "plan string, category string, second string, quota long, part double"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("plan", pa.string()), ("category", pa.string()), ("second", pa.string()), ("quota", pa.int64()), ("part", pa.float64())])
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types.types)], schema=types)
        cells = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for _, block in groupby(cells, lambda r: r[0]):
            for row in reduced(((s, [r[2:] for r in column]) for s, column in groupby(block, lambda r: r[1])), shares):
                out.append(row)
                if len(out) == BATCH:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    cells = rows.filter(F.col("category").isin(sorted({c for share in shares.values() for c in share}))).groupBy("category", "second").agg(F.count("*").alias("n"))
    cells = cells.select(F.pmod(F.xxhash64("second"), F.lit(BLOCKS)).alias("block"), "second", "category", "n")
    table = written(cells.repartition("block").sortWithinPartitions("block", "second", "category").mapInArrow(blocks, schema))
    left: dict[str, list] = {}
    for r in sorted(table.filter("part > 0").collect(), key=lambda r: (r["second"], r["category"])):  # of each block at most two cells per target
        left.setdefault(r["plan"], []).append(r)
    out = []
    for plan, got in left.items():
        up = controlled_rounding({(r["category"], r["second"]): r["part"] for r in got})
        out += [(plan, r["category"], r["second"], r["quota"] + up[r["category"], r["second"]]) for r in got]
    names = ["plan", "category", "second", "quota"]
    types = [pa.string()] * 3 + [pa.int64()]
    rest = pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
    return table.filter("part = 0").select(names).unionByName(spark.createDataFrame(rest))


def draw(rows: DataFrame, quota: DataFrame, seed: int = 11) -> DataFrame:
    """(plan, id, category, second): exactly quota rows of each cell, those of smallest random key."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    keyed = rows.withColumn("key", key).withColumn("range", F.floor((F.col("key") / F.lit(float(1 << 64)) + F.lit(0.5)) * RANGES).cast("int"))
    counts = keyed.groupBy("category", "second", "range").agg(F.count("*").alias("n"))
    # At most RANGES rows per cell.
    upto = F.sum("n").over(Window.partitionBy("category", "second").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ends = counts.withColumn("before", F.coalesce(upto, F.lit(0))).join(quota.filter("quota > 0"), ["category", "second"])
    last = ends.filter((F.col("before") < F.col("quota")) & (F.col("before") + F.col("n") >= F.col("quota"))).select("plan", "category", "second", F.col("range").alias("last"), (F.col("quota") - F.col("before")).alias("rest"))
    # As many rows as there are cells, so it is written: broadcast if small, else joined, and AQE splits a hot cell.
    near = keyed.join(written(last), ["category", "second"]).filter(F.col("range") <= F.col("last"))
    whole = near.filter("range < last").select("plan", "id", "category", "second")
    rank = F.row_number().over(Window.partitionBy("plan", "category", "second").orderBy("key", "id"))
    edge = near.filter("range = last").repartition("plan", "category", "second").withColumn("rank", rank).filter("rank <= rest").select("plan", "id", "category", "second")
    return whole.unionByName(edge)


def shortfalls(drawn: DataFrame, need: DataFrame) -> DataFrame:
    """The targets of `need` of which fewer rows were drawn than needed, with `drawn`."""
    got = drawn.groupBy(F.col("plan").alias("__plan"), F.col("category").alias("__c")).agg(F.count("*").alias("__n"))
    out = need.join(F.broadcast(got), (F.col("plan") == F.col("__plan")) & (category_form(F.col("category")) == F.col("__c")), "left")  # one row per target
    return out.withColumn("drawn", F.coalesce("__n", F.lit(0))).drop("__plan", "__c", "__n").filter("drawn < need")
