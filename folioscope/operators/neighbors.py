"""Nearest neighbours of vectors, and kernel weights between neighbours with a bandwidth per point.

``nearest_graph`` splits the distinct vectors by random hyperplanes at sample medians into groups of bounded size, several times
over; a task splits its group further and compares every two vectors of a leaf. The nearest found in any of the trees stay.
Tables of one leaf are exact; on larger ones a neighbour is missed where no tree has both in one leaf, so recall is
measured (``recall``), and ``TREES`` raises it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import vectors as V
from folioscope.session import cut_lineage

#: Times the vectors are split anew, rows of a group and of a leaf, and rows of the sample that gives the medians: so many
#: for each group, and in all.
TREES, GROUP_ROWS, LEAF_ROWS, SAMPLE_PER_GROUP, SAMPLE_ROWS = 8, 50_000, 1000, 50, 200_000


@dataclass(frozen=True)
class Splits:
    """A tree of hyperplanes: node ``n`` has the children ``2n + 1`` and ``2n + 2``; nodes of depth ``depth`` are groups."""

    depth: int
    directions: np.ndarray
    bounds: np.ndarray

    def groups(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            right = (vectors * self.directions[node]).sum(axis=1) > self.bounds[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)


def splits_of(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Splits:
    """Hyperplanes of random directions through the medians of a sample."""
    directions = rng.normal(size=(2**depth - 1, sample.shape[1]))
    bounds = np.zeros(len(directions))
    members = {0: np.arange(len(sample))}
    for node in range(2**depth - 1):
        own = members.pop(node)
        along = sample[own] @ directions[node]
        bounds[node] = np.median(along) if len(own) else 0.0
        members[2 * node + 1], members[2 * node + 2] = own[along <= bounds[node]], own[along > bounds[node]]
    return Splits(depth, directions, bounds)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    width = len(lists[0]) if len(lists) else 0
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _dealt(trees: list[Splits]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            for number, tree in enumerate(trees):
                made = {"tree": pa.array(np.full(len(vectors), number, np.int32)), "group": pa.array(tree.groups(vectors))}
                yield pa.RecordBatch.from_pydict(made | {"id": batch.column("id"), "vector": batch.column("vector")})

    return run


def _leaves(vectors: np.ndarray, rows: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The rows of each leaf; vectors that no direction parts are cut by place."""
    left = [np.arange(len(vectors))]
    while left:
        own = left.pop()
        if len(own) <= rows:
            yield own
            continue
        along = vectors[own] @ rng.normal(size=vectors.shape[1])
        order = own[np.argsort(along, kind="stable")]
        left += [order[: len(own) // 2], order[len(own) // 2 :]]


def _nearest_step(k: int, leaf_rows: int, seed: int, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, vectors = table.column("id").combine_chunks(), _matrix(table.column("vector"))
        rng = np.random.default_rng([seed, table.column("tree")[0].as_py(), table.column("group")[0].as_py()])
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own in _leaves(vectors, leaf_rows, rng):
            own = np.sort(own)
            near = vectors[own]
            sizes = (near * near).sum(axis=1)
            rough = sizes[:, None] + sizes[None, :] - 2 * (near @ near.T)
            np.fill_diagonal(rough, np.inf)
            # some more than asked for, as the rough distances may differ from the exact ones in the last digits
            wide = min(len(own) - 1, k + 4)
            if wide < 1:
                continue
            chosen = np.argpartition(rough, wide - 1, axis=1)[:, :wide]
            gaps = near[:, None, :] - near[chosen]
            exact = np.round((gaps * gaps).sum(axis=2), 9)
            order = np.lexsort((chosen, exact), axis=1)[:, :k]
            chosen, exact = np.take_along_axis(chosen, order, 1), np.take_along_axis(exact, order, 1)
            parts.append((np.repeat(own, chosen.shape[1]), own[chosen].ravel(), exact.ravel()))
        a, b, d = (np.concatenate([p[at] for p in parts]) if parts else np.empty(0) for at in range(3))
        made = {"i": ids.take(pa.array(a.astype(np.int64))).cast(kind), "j": ids.take(pa.array(b.astype(np.int64))).cast(kind)}
        return pa.table(made | {"d": pa.array(d, pa.float64())})

    return run


def nearest_graph(
    docs: DataFrame, k: int, key: str = "doc_id", vector: str = "vector", trees: int = TREES, seed: int = 0,
    group_rows: int | None = None, leaf_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``i, j, d``: the ``k`` nearest other vectors of every distinct vector by squared Euclidean distance, to nine digits, ties to
    the lower id; and the membership (key, ``rep``), as rows of equal vectors enter once, under their least key.

    Null vectors are left out; all are to have one length.
    """
    group_rows, leaf_rows = group_rows or GROUP_ROWS, leaf_rows or LEAF_ROWS
    given = docs.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), V.as_doubles(F.col(vector)).alias("vector"))
    reps = cut_lineage(given.groupBy("vector").agg(F.min("id").alias("rep")))
    members = given.join(reps, "vector").select(F.col("id").alias(key), "rep")
    points = reps.select(F.col("rep").alias("id"), "vector")
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / group_rows)))
    wanted = min(SAMPLE_ROWS, SAMPLE_PER_GROUP * 2**depth)
    rng = np.random.default_rng(seed)
    sample = np.zeros((0, 0))
    if depth:
        drawn = points.sample(min(1.0, 1.2 * wanted / n), seed).limit(wanted).select("vector").collect()
        sample = np.array([r["vector"] for r in drawn], float)
    made = [splits_of(sample, depth, rng) for _ in range(trees if n > leaf_rows else 1)]
    kind = docs.schema[key].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = f"tree int, `group` bigint, id {kind}, vector array<double>"
    dealt = points.mapInArrow(_dealt(made), schema)
    found = dealt.groupBy("tree", "group").applyInArrow(_nearest_step(k, leaf_rows, seed, arrow), f"i {kind}, j {kind}, d double")
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    best = found.distinct().withColumn("place", place).filter(F.col("place") <= k)
    return best.select("i", "j", "d"), members


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of ``exact`` (``i, j``) that is in ``found``."""
    both = exact.select("i", "j").join(found.select("i", "j"), ["i", "j"], "left_semi").count()
    return both / max(1, exact.count())

# The floor of a weight, the powers of four that a round of the bandwidth search tries, and its refinement.
FLOOR = 1e-100
POWERS = 12
PARTS, REFINEMENTS = 16, 5
# neighbours up to which a point is handled in one row, and numbers a task handles at once
HELD_NEIGHBORS, SLICE_GAPS = 1000, 1_000_000


def _entropies(edges: DataFrame, betas: list[Column]) -> DataFrame:
    """Entropy of every point's kernel for several precisions at once: partial sums per (point, precision)."""
    sums = []
    for at, beta in enumerate(betas):
        kernel = F.exp(-F.col("gap") * beta)
        sums += [F.sum(kernel).alias(f"z{at}"), F.sum(F.col("gap") * kernel).alias(f"g{at}")]
    grouped = edges.groupBy("i").agg(*sums, *[F.first(b).alias(f"b{at}") for at, b in enumerate(betas)])
    steps = [
        F.struct(
            F.col(f"b{at}").alias("beta"),
            (F.log(f"z{at}") + F.col(f"b{at}") * F.col(f"g{at}") / F.col(f"z{at}")).alias("h"),
        )
        for at in range(len(betas))
    ]
    return grouped.select("i", F.array(*steps).alias("steps"))


def _bracket(steps: DataFrame, target: float) -> DataFrame:
    """Greatest precision whose entropy is above the target and least one whose entropy is not."""
    above = F.array_max(F.transform(F.filter("steps", lambda s: s["h"] > target), lambda s: s["beta"]))
    below = F.array_min(F.transform(F.filter("steps", lambda s: s["h"] <= target), lambda s: s["beta"]))
    return steps.select("i", above.alias("lo"), below.alias("hi"))


def _brackets(gaps: DataFrame, target: float) -> DataFrame:
    """``i, lo, hi``: precisions between which every point's entropy reaches the target.

    The first round looks around the inverse of the mean gap; points whose target lies outside look further. Where the target is
    out of reach, as a point has too few neighbours or too many at its least distance, no precision (0) or one beyond
    all gaps is taken from both sides.
    """
    ties = F.count_if(F.col("gap") == 0)
    told = gaps.groupBy("i").agg(F.count(F.lit(1)).alias("n"), ties.alias("ties"), F.avg(F.nullif("gap", F.lit(0.0))).alias("mean"))
    told = cut_lineage(told.join(gaps.filter("gap > 0").groupBy("i").agg(F.min("gap").alias("next")), "i", "left"))
    flat = F.log("n") <= target
    steep = F.log("ties") >= target
    # at this precision the next gap weighs nothing
    beyond = F.coalesce(1000 / F.col("next"), F.lit(1.0))
    fixed = told.filter(flat | steep).select("i", F.when(flat, F.lit(0.0)).otherwise(beyond).alias("lo"))
    found = [fixed.select("i", "lo", F.col("lo").alias("hi"))]
    open_ = told.filter(~(flat | steep)).select("i", (1 / F.col("mean")).alias("base"), F.lit(0).alias("shift"))
    while True:
        open_ = cut_lineage(open_)
        if open_.isEmpty():
            break
        betas = [F.col("base") * F.pow(F.lit(4.0), F.col("shift") + e) for e in range(-POWERS, POWERS + 1)]
        looked = cut_lineage(_bracket(_entropies(gaps.join(open_, "i"), betas), target))
        found.append(looked.filter("lo is not null and hi is not null"))
        step = F.when(F.col("lo").isNull(), F.lit(-2 * POWERS)).otherwise(F.lit(2 * POWERS))
        further = looked.filter("lo is null or hi is null").withColumn("step", step)
        open_ = open_.join(further, "i").select("i", "base", (F.col("shift") + F.col("step")).alias("shift"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return cut_lineage(whole)


def _held_betas(gaps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, target: float) -> np.ndarray:
    """The precisions that ``_brackets`` and the refinements find, of points whose gaps lie side by side."""

    def above(beta: np.ndarray) -> np.ndarray:
        kernel = np.exp(-gaps * np.repeat(beta, sizes))
        z, g = np.add.reduceat(kernel, starts), np.add.reduceat(gaps * kernel, starts)
        return np.log(z) + beta * g / z > target

    positive = gaps > 0
    ties = sizes - np.add.reduceat(positive.astype(np.int64), starts)
    total, following = np.add.reduceat(gaps, starts), np.minimum.reduceat(np.where(positive, gaps, np.inf), starts)
    flat = np.log(sizes) <= target
    steep = ~flat & (np.log(np.maximum(ties, 1)) >= target)
    open_ = ~(flat | steep)
    # at this precision the next gap weighs nothing
    beyond = np.where(np.isinf(following), 1.0, 1000 / following)
    base = np.where(open_, (sizes - ties) / np.where(open_, total, 1.0), 1.0)
    power = np.zeros(len(sizes))
    up = above(base)
    going = open_.copy()
    while going.any():
        power[going] += np.where(up, 1.0, -1.0)[going]
        going &= above(base * 4.0**power) == up
    hi = base * 4.0 ** np.where(up, power, power + 1)
    lo = hi / 4
    for _ in range(REFINEMENTS * int(math.log2(PARTS))):
        middle = (lo + hi) / 2
        more = above(middle)
        lo, hi = np.where(more, middle, lo), np.where(more, hi, middle)
    return np.where(flat, 0.0, np.where(steep, beyond, (lo + hi) / 2))


def _held_step(target: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near")
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten()
            names, d = flat.field("j"), flat.field("d").to_numpy(zero_copy_only=False)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLICE_GAPS, side="right")) - 1)
                sizes, starts = np.diff(bounds[first : last + 1]), bounds[first:last] - bounds[first]
                own = d[bounds[first] : bounds[last]]
                gaps = own - np.repeat(np.minimum.reduceat(own, starts), sizes)
                kernel = np.exp(-gaps * np.repeat(_held_betas(gaps, starts, sizes, target), sizes))
                share = kernel / np.repeat(np.add.reduceat(kernel, starts), sizes)
                points = batch.column("i").take(pa.array(np.repeat(np.arange(first, last), sizes)))
                yield pa.RecordBatch.from_pydict({"i": points, "j": names.slice(bounds[first], len(own)), "p": pa.array(share)})
                first = last

    return run


def neighbor_affinity(edges: DataFrame, perplexity: float, held: int | None = None) -> DataFrame:
    """Symmetric weights (i, j, p) from distances (i, j, d) of points and their neighbours.

    The precision of every point is found by bracketing and refining until the entropy of its kernel is
    ln(perplexity). Points of up to ``held`` neighbours are handled in one row each. Of the others, all candidates of a round
    are evaluated in one pass of partial sums, so a point with very many neighbours is never gathered. Weights are
    (p(j|i) + p(i|j)) / 2n, at least 1e-100.
    """
    target = math.log(perplexity)
    edges = cut_lineage(edges.select("i", "j", F.col("d").cast("double").alias("d")))
    unclear = F.count_if(F.col("d").isNull() | F.isnan("d"))
    many = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"), unclear.alias("unclear"))
    wide = cut_lineage(many.filter((F.col("n") > (HELD_NEIGHBORS if held is None else held)) | (F.col("unclear") > 0)).select("i"))
    some = not wide.isEmpty()
    narrow = edges.join(wide, "i", "left_anti") if some else edges
    packed = narrow.groupBy("i").agg(F.collect_list(F.struct("j", "d")).alias("near"))
    kinds = dict(edges.dtypes)
    shares = packed.mapInArrow(_held_step(target), f"i {kinds['i']}, j {kinds['j']}, p double")
    if some:
        shares = shares.unionByName(_wide_shares(edges.join(wide, "i", "left_semi"), target))
    shares = cut_lineage(shares)
    n = shares.select("i").union(shares.select("j")).agg(F.count_distinct("i").alias("n")).scalar()
    both = shares.unionByName(shares.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    summed = both.groupBy("i", "j").agg(F.sum("p").alias("p"))
    return summed.select("i", "j", F.greatest(F.col("p") / (2 * n), F.lit(FLOOR)).alias("p"))


def _wide_shares(edges: DataFrame, target: float) -> DataFrame:
    """``i, j, p``: the share of every neighbour in its point's kernel, by rounds of partial sums."""
    nearest = edges.groupBy("i").agg(F.min("d").alias("_near"))
    gaps = cut_lineage(edges.join(nearest, "i").select("i", "j", (F.col("d") - F.col("_near")).alias("gap")))
    bracket = _brackets(gaps, target)
    for _ in range(REFINEMENTS):
        inner = [F.col("lo") + (F.col("hi") - F.col("lo")) * (at / PARTS) for at in range(1, PARTS)]
        finer = _bracket(_entropies(gaps.join(bracket, "i"), inner), target).select(
            "i", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")
        )
        bracket = cut_lineage(
            bracket.join(finer, "i").select(
                "i", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi")
            )
        )
    beta = bracket.select("i", ((F.col("lo") + F.col("hi")) / 2).alias("beta"))
    kernel = gaps.join(beta, "i").select("i", "j", F.exp(-F.col("gap") * F.col("beta")).alias("k"))
    totals = kernel.groupBy("i").agg(F.sum("k").alias("z"))
    return kernel.join(totals, "i").select("i", "j", (F.col("k") / F.col("z")).alias("p"))
