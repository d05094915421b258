"""Samples whose shares of several label fields meet given targets, by controlled rounding.

1. Each field's target counts are laid out so that they add up to the sample size: a category gets the larger of
   its minimum and its share, at most what there is; what one category lacks goes to the others in proportion.
2. The cells of all fields together get fractional quotas by raking the available counts to these margins.
3. The cell table is made integer one field at a time. Each step is a two-way table (the cells so far against the
   categories of the next field) with whole margins on both sides; a maximum flow through the fractional parts
   rounds every cell up or down and keeps both margins. Where what is available stops the flow, a second flow
   uses what other cells have left.
4. Each cell takes exactly its quota of rows with the smallest random keys (a hash of the id).

Rows that repeat an id count once (the earliest received stays; ties by all their labels). Labels are compared in
normal form; a row with a null or unknown label in any field is counted as available in the other fields but never
drawn. An empty table gives an empty sample and a report in which every category with a target falls short.
"""

from __future__ import annotations

import itertools
import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from veilspark.functions.columns import normal
from veilspark.functions.materialize import cut

#: Bits of the random key that name a bucket; a bucket holds about 2**-16 of its cell.
KEY_BITS = 16


def max_flow(capacity: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Flow through a bipartite network with the given row, column and edge capacities, by shortest augmenting paths."""
    r, c = capacity.shape
    flow = np.zeros((r, c), np.int64)
    left, right = rows.astype(np.int64).copy(), cols.astype(np.int64).copy()
    while True:
        seen_r, seen_c, queue = np.full(r, -2), np.full(c, -1), deque()
        for i in np.flatnonzero(left > 0):
            seen_r[i] = -1
            queue.append(int(i))
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for j in np.flatnonzero((capacity[i] > flow[i]) & (seen_c < 0)):
                seen_c[j] = i
                if right[j] > 0:
                    end = int(j)
                    break
                for k in np.flatnonzero((flow[:, j] > 0) & (seen_r == -2)):
                    seen_r[k] = j
                    queue.append(int(k))
        if end < 0:
            return flow
        path, j = [], end
        while True:
            i = int(seen_c[j])
            path.append((i, j, 1))
            if seen_r[i] == -1:
                break
            path.append((i, int(seen_r[i]), -1))
            j = int(seen_r[i])
        amount = min([int(left[path[-1][0]]), int(right[end])] + [int(capacity[i, j] - flow[i, j]) if d > 0 else int(flow[i, j]) for i, j, d in path])
        for i, j, d in path:
            flow[i, j] += d * amount
        left[path[-1][0]] -= amount
        right[end] -= amount


def whole_parts(values: np.ndarray, total: int, most: np.ndarray) -> np.ndarray:
    """Whole numbers near ``values`` that add up to ``total`` and don't exceed ``most``, largest remainders first."""
    out = np.minimum(np.floor(values + 1e-9).astype(np.int64), most)
    for i in np.argsort(-(values - out), kind="stable"):
        if out.sum() < total and out[i] < most[i]:
            out[i] += 1
    while out.sum() < total and (out < most).any():
        i = int(np.argmax(most - out))
        out[i] += min(int(most[i] - out[i]), int(total - out.sum()))
    while out.sum() > total:
        out[int(np.argmax(out - values))] -= 1
    return out


def margin(share: np.ndarray, least: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Target counts of one field that add up to ``size`` or to all there is."""
    total = min(size, int(available.sum()))
    low, high = 0.0, 1.0

    def at(scale: float) -> np.ndarray:
        return np.minimum(available, np.maximum(np.minimum(least, available), share * size * scale))

    while at(high).sum() < total and high < 1e9:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if at(middle).sum() < total else (low, middle)
    return whole_parts(at(high), total, available.astype(np.int64))


def rake(cells: np.ndarray, margins: list[np.ndarray], most: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Fractional cells, no more than ``most``, whose sums along each axis come as near to the margins as they can."""
    x = cells.astype(float)
    for _ in range(rounds):
        for axis, want in enumerate(margins):
            sums = x.sum(axis=tuple(a for a in range(x.ndim) if a != axis))
            factor = np.divide(want, sums, out=np.zeros(len(want)), where=sums > 0)
            x = np.minimum(x * factor.reshape([-1 if a == axis else 1 for a in range(x.ndim)]), most)
    return x


def round_table(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole table near ``x`` with the row and column sums given, as far as ``most`` allows."""
    base = np.minimum(np.floor(x + 1e-9).astype(np.int64), most)
    for sums, want, axis in ((base.sum(1), rows, 0), (base.sum(0), cols, 1)):
        for i in np.flatnonzero(sums > want):  # raking that didn't end leaves a floor above its margin
            line = base[i] if axis == 0 else base[:, i]
            while line.sum() > want[i]:
                line[int(np.argmax(line))] -= 1
    up = ((x - base > 1e-9) & (base < most)).astype(np.int64)
    base = base + max_flow(up, rows - base.sum(1), cols - base.sum(0))
    return base + max_flow(most - base, rows - base.sum(1), cols - base.sum(0))


def cell_quotas(available: np.ndarray, margins: list[np.ndarray]) -> np.ndarray:
    """Whole quotas of all cells. ``available`` has one axis for each field."""
    x = rake(available, margins, available)
    quotas = margins[0].reshape(-1, 1).sum(1)
    for axis in range(1, available.ndim):
        later = tuple(range(axis + 1, available.ndim))
        most = available.sum(axis=later).reshape(len(quotas), -1).astype(np.int64)
        part = rake(x.sum(axis=later).reshape(most.shape) + 1e-12 * (most > 0), [quotas, margins[axis]], most, 50)
        quotas = round_table(part, quotas, margins[axis], most).reshape(-1)
    return quotas.reshape(available.shape)


def _targets(targets: DataFrame, fields: list[str], limit: int = 10_000) -> dict[str, list[Row]]:
    """Targets by field, in order of the category; they are parameters, so their number has a bound."""
    rows = targets.where(F.col("field").isin(fields) & F.col("category").isNotNull()).groupBy("field", "category").agg(F.max("target_share").alias("share"), F.max("min_rows").alias("least")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} target categories")
    return {f: sorted((r for r in rows if r["field"] == f), key=lambda r: r["category"]) for f in fields}


def distinct_requests(df: DataFrame, id_col: str, fields: list[str], order_col: str | None = None) -> DataFrame:
    """One row for each id with its labels in normal form; rows without an id are dropped."""
    labels = F.struct(*([F.col(order_col).alias("_at")] if order_col else []), *[normal(f).alias(f) for f in fields])
    return df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(labels).alias("r")).select("id", *[F.col(f"r.{f}").alias(f) for f in fields])


#: Cells of all fields' categories together; categories are parameters, and so is their table.
MOST_CELLS = 1_000_000


def fill(quotas: np.ndarray, margins: list[np.ndarray], most: np.ndarray, total: int) -> np.ndarray:
    """Quotas raised to ``total`` where rounding one field after another left rows undrawn: each row goes to the cell
    with spare rows whose categories are furthest below their margins."""
    out = quotas.copy()
    while out.sum() < min(total, most.sum()):
        lack = np.zeros(out.shape)
        for axis, want in enumerate(margins):
            got = out.sum(axis=tuple(a for a in range(out.ndim) if a != axis))
            lack = lack + np.minimum((want - got) / np.maximum(want, 1), 1.0).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out[np.unravel_index(int(np.where(out < most, lack, -np.inf).argmax()), out.shape)] += 1
    return out


def quota_sample(df: DataFrame, targets: DataFrame, id_col: str, fields: list[str], fraction: float = 0.5, seed: int = 7, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The sample (id, *fields) and the report (field, category, target_share, min_rows, needed, available, drawn,
    actual_share, short, size, drawn_total): ``needed`` is the larger of min_rows and target_share x size, rounded half
    up; ``size`` is the size asked for and ``drawn_total`` what the sample has."""
    spark = df.sparkSession
    rows = cut(distinct_requests(df, id_col, fields, order_col))
    wanted = _targets(targets, fields)
    names = {f: [r["category"] for r in wanted[f]] for f in fields}
    known = {f: dict(zip(names[f], itertools.count())) for f in fields}
    if math.prod(len(names[f]) for f in fields) > MOST_CELLS:
        raise ValueError(f"the categories of all fields make more than {MOST_CELLS} cells")
    # One pass: counts of every combination of categories, unknown labels folded into null.
    folded = rows.select(*[F.when(F.col(f).isin(names[f]), F.col(f)).alias(f) for f in fields]) if fields else rows
    counts = folded.groupBy(*fields).agg(F.count(F.lit(1)).alias("n")).collect()
    size = math.floor(fraction * sum(r["n"] for r in counts))
    cells = np.zeros([len(names[f]) for f in fields], np.int64)
    single = {f: np.zeros(len(names[f]), np.int64) for f in fields}
    for r in counts:
        for f in fields:
            if r[f] is not None:
                single[f][known[f][r[f]]] += r["n"]
        if all(r[f] is not None for f in fields):
            cells[tuple(known[f][r[f]] for f in fields)] += r["n"]
    reach = min(size, int(cells.sum()))
    margins = []
    for axis, f in enumerate(fields):
        there = cells.sum(axis=tuple(a for a in range(len(fields)) if a != axis))
        margins.append(margin(np.array([r["share"] or 0.0 for r in wanted[f]]), np.array([r["least"] or 0 for r in wanted[f]]), there, reach))
    quotas = fill(cell_quotas(cells, margins), margins, cells, reach) if cells.size else cells
    table = [(*[names[f][i] for f, i in zip(fields, at)], int(q)) for at, q in np.ndenumerate(quotas) if q]
    sample = exact_quota(rows, spark.createDataFrame(table, ", ".join([*[f"`{f}` string" for f in fields], "quota long"])), fields, seed)
    lines = []
    for axis, f in enumerate(fields):
        drawn = quotas.sum(axis=tuple(a for a in range(len(fields)) if a != axis)) if quotas.size else np.zeros(len(names[f]), int)
        for r, have, got in zip(wanted[f], single[f], drawn):
            need = max(r["least"] or 0, math.floor((r["share"] or 0.0) * size + 0.5 + 1e-9))
            lines.append((f, r["category"], r["share"], r["least"], int(need), int(have), int(got), float(got / quotas.sum()) if quotas.sum() else 0.0, bool(have < need), int(size), int(quotas.sum())))
    report = spark.createDataFrame(lines, "field string, category string, target_share double, min_rows int, needed long, available long, drawn long, actual_share double, short boolean, size long, drawn_total long")
    return sample, report


def exact_quota(rows: DataFrame, quotas: DataFrame, fields: list[str], seed: int) -> DataFrame:
    """The ``quota`` rows of each cell with the smallest keys, without gathering a cell in one task.

    Keys are cut into buckets; counts of the buckets (a bounded number for each cell) show which bucket holds a
    cell's last rows, and only the rows of that bucket are ranked.
    """
    keyed = rows.join(F.broadcast(quotas.select(*fields)), fields).withColumn("_key", F.xxhash64("id", F.lit(seed)))
    keyed = keyed.withColumn("_bucket", F.shiftright("_key", 64 - KEY_BITS))
    cells = Window.partitionBy(*fields).orderBy("_bucket")
    counts = keyed.groupBy(*fields, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(cells) - F.col("_n"))
    last = counts.join(F.broadcast(quotas), fields).where("_before < quota and _before + _n >= quota").select(*fields, F.col("_bucket").alias("_last"), (F.col("quota") - F.col("_before")).alias("_left"))
    near = keyed.join(F.broadcast(last), fields).where("_bucket <= _last")
    whole = near.where("_bucket < _last").select("id", *fields)
    rank = F.row_number().over(Window.partitionBy(*fields, "_bucket").orderBy("_key", "id"))
    return whole.unionByName(near.where("_bucket = _last").withColumn("_rank", rank).where("_rank <= _left").select("id", *fields))
