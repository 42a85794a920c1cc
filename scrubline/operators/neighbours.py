"""Exact nearest neighbours among rows with gaps, whatever columns each of them has.

Distances are Euclidean over the columns that both rows have, scaled up for the absent ones. Donors
are cut into cells by a tree of cuts along the most spread columns, in which rows without the column
go a way of their own; a cell knows its limits in each column and which columns all or some of its
rows have. A column that a row lacks matches anything, so the least distance from a row to a cell is
bounded by the columns that the cell's rows are sure to have. Rows are searched in groups of
neighbouring cells: first where the most promising cell of each gap is, then in those with a cell that can
hold a donor before the k-th so far, a few first. Each visited group is cut finer.

Rows that lack a column that the cuts follow can not tell its cells apart: they would visit ever more of
them as the table grows. Where many do, the donors are stored once more in a view whose cuts follow the
columns that such rows have. A row searches the view that is cut least along what it lacks; all views hold all
donors, so the choice decides the speed alone and patterns of gaps need not be listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.storage import write_table

CELL_ROWS = 1024
#: Cells at most; of larger tables they get larger, and are searched in parts.
MAX_CELLS = 4096
#: Donors, and rows with gaps, that meet in one task.
GROUP_ROWS = 16_384
#: A task cuts its donors into leaves of about so many rows.
LEAF_ROWS = 128
#: Groups that a row visits in the second round; what these leave open is visited in the third.
FEW_GROUPS = 3
#: Donors that the cuts are chosen from. They decide how fast the search is, never what it finds.
SAMPLE_ROWS = 1 << 16
BLOCK_ROWS = 1024
#: Rows whose distances to all groups are held at once.
REACH_ROWS = 2048
#: Views at most, each of which stores the donors once.
MAX_VIEWS = 8
#: Patterns of gaps, the costliest first, that views are tried for.
VIEW_PATTERNS = 16


@dataclass(init=False)
class Tree:
    """Cuts that lead each row to its cell."""

    nodes: list[tuple]
    size: int

    def __init__(self, sample: np.ndarray, cells: int, columns: np.ndarray | None = None):
        """Cuts follow ``columns`` as long as these tell rows apart, and the others after them."""
        self.nodes = []
        self.size = 0
        self.columns = np.ones(sample.shape[1], bool) if columns is None else columns
        #: How many cuts along each column a row meets.
        self.cuts = np.zeros(sample.shape[1])
        if len(sample):
            self._grow(sample, max(2, 2 * len(sample) // max(cells, 1)))
            self.cuts /= len(sample)
        else:
            self._leaf()

    @classmethod
    def of(cls, nodes: list[tuple], size: int) -> Tree:
        """The tree of cuts that were found before."""
        tree = cls.__new__(cls)
        tree.nodes, tree.size = nodes, size
        return tree

    def _leaf(self) -> int:
        self.nodes.append((-1, 0.0, self.size, 0, 0))
        self.size += 1
        return len(self.nodes) - 1

    def _grow(self, rows: np.ndarray, least: int) -> int:
        """A node over ``rows``; cells are numbered from left to right, so neighbours are alike."""
        if len(rows) < least:
            return self._leaf()
        there = ~np.isnan(rows)
        n = there.sum(0)
        filled = np.where(there, rows, 0.0)
        centre = filled.sum(0) / np.maximum(n, 1)
        spread = np.where(there, (filled - centre) ** 2, 0.0).sum(0)
        # The mean of equal values may be off by rounding.
        spread[np.where(there, rows, -np.inf).max(0) <= np.where(there, rows, np.inf).min(0)] = 0.0
        for columns in (self.columns, ~self.columns):
            if (spread[columns] > 0).any():
                axis, equal = int(np.argmax(np.where(columns, spread, -1.0))), False
                break
            # All that is there is equal: only what is absent can tell rows apart.
            mixed = columns & (n > 0) & (n < len(rows))
            if mixed.any():
                axis, equal = int(np.argmax(np.where(mixed, n, -1))), True
                break
        else:
            return self._leaf()
        self.cuts[axis] += len(rows)
        have, cut = there[:, axis], -np.inf
        if not equal:
            values = rows[have, axis]
            cut = float(np.median(values))
            if not (values < cut).any():
                cut = float(values[values > cut].min())
        at = len(self.nodes)
        self.nodes.append(())
        below = have & (np.where(have, rows[:, axis], np.inf) < cut)
        parts = [~have, below, have & ~below]
        ways = [self._grow(rows[p], least) if p.any() else -1 for p in parts]
        spare = next(w for w in reversed(ways) if w >= 0)
        self.nodes[at] = (axis, cut, *[w if w >= 0 else spare for w in ways])
        return at

    def cells(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            axis, cut, absent, low, high = self.nodes[at]
            if axis < 0:
                out[who] = absent
                continue
            x = rows[who, axis]
            gone = np.isnan(x)
            below = x < cut
            for way, part in ((absent, gone), (low, below), (high, ~gone & ~below)):
                if part.any():
                    todo.append((way, who[part]))
        return out


@dataclass
class Boxes:
    """For each cell and column: limits, whether all rows have the column, whether some do."""

    low: np.ndarray
    high: np.ndarray
    full: np.ndarray
    some: np.ndarray

    @classmethod
    def around(cls, rows: np.ndarray, starts: np.ndarray) -> Boxes:
        """Of the runs of ``rows`` that begin at ``starts``."""
        there = ~np.isnan(rows)
        counts = np.add.reduceat(there, starts, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(rows)))[:, None]
        return cls(
            np.minimum.reduceat(np.where(there, rows, np.inf), starts, axis=0),
            np.maximum.reduceat(np.where(there, rows, -np.inf), starts, axis=0), counts == sizes, counts > 0,
        )

    def part(self, start: int, end: int) -> Boxes:
        return Boxes(self.low[start:end], self.high[start:end], self.full[start:end], self.some[start:end])

    def joined(self, starts: np.ndarray) -> Boxes:
        """One box around each run of boxes that begins at ``starts``."""
        return Boxes(np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts),
                     np.logical_and.reduceat(self.full, starts), np.logical_or.reduceat(self.some, starts))

    def least_distances(self, rows: np.ndarray) -> np.ndarray:
        """(rows, cells): no row of the cell is nearer; infinite if none shares a column.

        A mean over the shared columns is not below the smallest of them, nor below what the columns
        that are sure to be shared add to a mean over all that may be.
        """
        sure = np.zeros((len(rows), len(self.low)))
        least = np.full(sure.shape, np.inf)
        with np.errstate(invalid="ignore"):
            for axis in range(rows.shape[1]):
                x, low, high, full = rows[:, axis, None], self.low[:, axis], self.high[:, axis], self.full[:, axis]
                # A column that the row lacks is passed over: its differences are NaN.
                off = np.maximum(low - x, x - high)
                least = np.fmin(least, np.maximum(off, 0.0))
                off = np.fmax(np.where(full, off, 0.0), 0.0)
                off *= off
                sure += off
        sure /= np.maximum(self.shared(rows), 1)
        return np.sqrt(rows.shape[1] * np.maximum(sure, least * least)) * (1 - 1e-9)

    def shared(self, rows: np.ndarray) -> np.ndarray:
        """(rows, cells): how many columns a row may share with rows of the cell."""
        return (~np.isnan(rows)).astype(float) @ self.some.T.astype(float)

    def needed(self, reach: np.ndarray, far: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(rows, cells): the cell can hold a donor that comes before the k-th so far of a gap.

        ``far`` and ``value`` (rows, columns) are the distance and value of that donor: infinite if there
        is none yet, negative if the row has the column. No donor is nearer than one at distance zero,
        so of a cell only smaller values can come before it.
        """
        out = np.zeros(reach.shape, bool)
        for axis in range(far.shape[1]):
            who = np.flatnonzero(far[:, axis] >= 0)
            if len(who):
                d, v = far[who, axis][:, None], value[who, axis][:, None]
                out[who] |= (reach[who] <= d) & np.where(d > 0, self.some[:, axis], self.low[:, axis] < v)
        return out & np.isfinite(reach)

    def promising(self, reach: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): for each gap the nearest cell whose rows have the column.

        Of equally near ones it is that with which the row shares the fewest columns: less can differ.
        """
        shared = self.shared(rows)
        found = []
        for axis in range(rows.shape[1]):
            who = np.flatnonzero(np.isnan(rows[:, axis]))
            near = np.where(self.some[:, axis], reach[who], np.inf)
            best = near.min(1, keepdims=True)
            cell = np.where(near == best, shared[who], np.inf).argmin(1)
            any_ = np.isfinite(best[:, 0])
            found.append((who[any_], cell[any_]))
        return tuple(np.concatenate(part) for part in zip(*found))


@dataclass
class Deal:
    """Which group each cell's rows belong to: ``parts`` groups from ``first`` on."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, rows: int) -> Deal:
        first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        group, held = 0, 0
        for cell, n in enumerate(sizes):
            if held and held + n > rows:
                group, held = group + 1, 0
            first[cell], parts[cell] = group, max(1, -(-int(n) // (2 * rows)))
            group, held = (group + parts[cell], 0) if parts[cell] > 1 else (group, held + n)
        return cls(first, parts)

    @property
    def groups(self) -> int:
        return int((self.first + self.parts).max(initial=1))

    def group_of(self, cells: np.ndarray, chance: np.ndarray) -> np.ndarray:
        return self.first[cells] + chance % self.parts[cells]


@dataclass
class View:
    """A way to cut all donors: cells dealt into groups, both numbered on from those of the views before.

    ``columns`` are those that the cuts follow, ``cuts`` how many along each column a row meets.
    """

    tree: Tree
    boxes: Boxes
    deal: Deal
    columns: np.ndarray
    cuts: np.ndarray
    first_cell: int
    first_group: int

    def bundles(self) -> tuple[np.ndarray, np.ndarray, Boxes]:
        """The first cell and the first group of each run of cells that share groups, and its box."""
        first, starts = np.unique(self.deal.first, return_index=True)
        return starts, first, self.boxes.joined(starts)

    def starts(self, rows: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group): for each gap the nearest group with a cell whose rows have the column.

        Of equally near ones it is that with the cell with which the row shares the fewest columns: less can differ.
        """
        cells, first, joined = self.bundles()
        reach = joined.least_distances(rows)
        patterns, own = np.unique(np.isnan(rows), axis=0, return_inverse=True)
        own = own.ravel()
        shared = (~patterns).astype(float) @ self.boxes.some.T.astype(float)
        row, bundle = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for axis in np.flatnonzero(patterns.any(0)):
            fewest = np.minimum.reduceat(np.where(self.boxes.some[:, axis] & (shared > 0), shared, np.inf), cells, axis=1)
            who = np.flatnonzero(patterns[own, axis])
            ties = fewest[own[who]]
            near = np.where(np.isfinite(ties), reach[who], np.inf)
            best = near.min(1, keepdims=True)
            any_ = np.isfinite(best[:, 0])
            row.append(who[any_])
            bundle.append(np.where(near == best, ties, np.inf).argmin(1)[any_])
        row, bundle = np.concatenate(row), np.concatenate(bundle)
        return row, self.first_group + self.deal.group_of(cells[bundle], chance[row])

    def visits(self, rows: np.ndarray, far: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, least distance): the groups with a cell that is ``needed``.

        Cells are looked at where the box around all of a group is needed.
        """
        cells, first, joined = self.bundles()
        ends = np.append(cells[1:], self.tree.size)
        needed = joined.needed(joined.least_distances(rows), far, value)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in np.flatnonzero(needed.any(0)):
            who = np.flatnonzero(needed[:, at])
            part = self.boxes.part(cells[at], ends[at])
            reach = part.least_distances(rows[who])
            near = np.where(part.needed(reach, far[who], value[who]), reach, np.inf).min(1)
            use = np.isfinite(near)
            for group in range(self.first_group + first[at], self.first_group + first[at] + self.deal.parts[cells[at]]):
                found.append((who[use], np.full(use.sum(), group), near[use]))
        return tuple(np.concatenate(part) for part in zip(*found))


@dataclass
class Donors:
    """The stored donors ``table`` (x, n, cell, group): distinct rows and their number, at most k, once for each view.

    What the driver holds of them, ``tree``, ``boxes`` and ``deal`` and those of the further views, is bounded
    by MAX_CELLS and MAX_VIEWS.
    """

    width: int
    k: int
    table: DataFrame
    means: list[float]
    tree: Tree | None = None
    boxes: Boxes | None = None
    deal: Deal | None = None
    cuts: np.ndarray | None = None
    further: list[View] = field(default_factory=list)

    @property
    def views(self) -> list[View]:
        if self.tree is None:
            return []
        cuts = self.cuts if self.cuts is not None else np.zeros(self.width)
        return [View(self.tree, self.boxes, self.deal, np.ones(self.width, bool), cuts, 0, 0), *self.further]

    @property
    def groups(self) -> int:
        last = self.views[-1]
        return last.first_group + last.deal.groups


def _best_view(rows: np.ndarray, views: list[View]) -> np.ndarray:
    """For each row the view that is cut least along the columns that the row lacks."""
    return (np.isnan(rows).astype(float) @ np.array([v.cuts for v in views]).T).argmin(1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow column of arrays; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _finite(rows: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(rows), rows, np.nan)


def _celled(rows: DataFrame, views: list[View], width: int, extra: str, best: bool = False) -> DataFrame:
    """``rows`` with the cell of their ``x``, once in each view or once in the best view of the row."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _finite(_matrix(batch.column("x"), width))
            found = np.array([v.first_cell + v.tree.cells(x) for v in views], dtype=np.int32)
            for cells in [found[_best_view(x, views), np.arange(len(x))]] if best else found:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*names, "cell"])

    return rows.mapInArrow(run, f"{extra}, cell int")


def _dealt(rows: DataFrame, deal: Deal, to: str) -> DataFrame:
    """``rows`` with the group of their cell."""
    listed = rows.sparkSession.createDataFrame(
        [(c, int(f), int(p)) for c, (f, p) in enumerate(zip(deal.first, deal.parts))], "cell int, first_ long, parts_ long")
    # At most MAX_CELLS cells.
    return rows.join(F.broadcast(listed), "cell").withColumn(
        to, F.col("first_") + F.pmod(F.xxhash64("x"), F.col("parts_"))).drop("first_", "parts_")


def fit_donors(values: DataFrame, k: int) -> Donors:
    """Store the rows of ``values`` (v0, v1, ... doubles) as donors; infinite values count as absent.

    Of equal rows the first k count: more can not be among the nearest k of a row.
    """
    names = values.columns
    width = len(names)
    finite = [F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in names]
    known = values.select(*finite)
    rows = write_table(known.groupBy(F.array(*names).alias("x")).agg(
        F.least(F.count(F.lit(1)), F.lit(k)).alias("n"),
        # Sums weighted by all copies, for the columns' means.
        F.count(F.lit(1)).alias("copies"),
    ).where(F.exists("x", lambda v: v.isNotNull())), "donor-rows")
    stats = rows.agg(
        F.count(F.lit(1)), *[F.sum(F.col("x")[i] * F.col("copies")) / F.sum(
            F.when(F.col("x")[i].isNotNull(), F.col("copies"))) for i in range(width)],
    ).first()
    n, means = stats[0], [float(m) if m is not None else float("nan") for m in stats[1:]]
    rows = rows.drop("copies")
    if n <= GROUP_ROWS:
        zero = F.lit(0).cast("long")
        return Donors(width, k, rows.withColumns({"cell": zero.cast("int"), "group": zero}), means)
    # About SAMPLE_ROWS rows, by their hashes.
    bound = (2**63 - 1) * min(SAMPLE_ROWS, n) // n
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(9), "x"), 1) <= bound).select("x").limit(2 * SAMPLE_ROWS).toArrow()
    sample = _matrix(drawn["x"].combine_chunks(), width)
    wanted = min(MAX_CELLS, -(-n // CELL_ROWS))
    trees = _trees(sample, wanted, n)
    none = Deal(np.zeros(0, np.int64), np.zeros(0, np.int64))
    first_cells = np.cumsum([0, *[t.size for t in trees]])
    views = [View(t, None, none, t.columns, t.cuts, int(c), 0) for t, c in zip(trees, first_cells)]
    celled = write_table(_celled(rows, views, width, "x array<double>, n long"), "donor-cells")
    x = [F.col("x")[i] for i in range(width)]
    found = celled.groupBy("cell").agg(
        F.count(F.lit(1)), *[F.min(c) for c in x], *[F.max(c) for c in x], *[F.count(c) for c in x]).collect()
    cells = int(first_cells[-1])
    sizes = np.zeros(cells, np.int64)
    boxes = Boxes(np.full((cells, width), np.inf), np.full((cells, width), -np.inf), *np.zeros((2, cells, width), bool))
    for r in found:
        c, sizes[r[0]] = r[0], r[1]
        low, high, count = (np.array(r[2 + i * width:2 + (i + 1) * width], dtype=float) for i in range(3))
        boxes.some[c], boxes.full[c] = count > 0, count == r[1]
        boxes.low[c], boxes.high[c] = np.where(count > 0, low, np.inf), np.where(count > 0, high, -np.inf)
    groups = 0
    for view in views:
        end = view.first_cell + view.tree.size
        view.boxes, view.deal = boxes.part(view.first_cell, end), Deal.of(sizes[view.first_cell:end], GROUP_ROWS)
        view.first_group, groups = groups, groups + view.deal.groups
    dealt = Deal(np.concatenate([v.first_group + v.deal.first for v in views]), np.concatenate([v.deal.parts for v in views]))
    own = views[0]
    return Donors(width, k, _dealt(celled, dealt, "group"), means, own.tree, own.boxes, own.deal, own.cuts, views[1:])


def _trees(sample: np.ndarray, cells: int, rows: int) -> list[Tree]:
    """The tree over all columns, and those that spare rows with gaps more cells than the table has rows.

    A row has to look into twice as many cells for each cut along a column that it lacks.
    """
    trees = [Tree(sample, cells)]
    patterns, times = np.unique(np.isnan(sample), axis=0, return_counts=True)
    use = patterns.any(1) & ~patterns.all(1)
    patterns, times = patterns[use], times[use] * (rows / max(len(sample), 1))

    def looks(tree: Tree) -> np.ndarray:
        return times * 2.0 ** np.minimum(patterns @ tree.cuts, np.log2(tree.size))

    cost = looks(trees[0])
    tried = np.zeros(len(cost), bool)
    for _ in range(VIEW_PATTERNS):
        if len(trees) == MAX_VIEWS or tried.all() or cost.sum() - times.sum() < rows:
            break
        at = int(np.where(tried, -1.0, cost).argmax())
        tried[at] = True
        tree = Tree(sample, cells, ~patterns[at])
        less = np.minimum(cost, looks(tree))
        if (cost - less).sum() > rows:
            trees.append(tree)
            cost = less
    return trees


def nearest_means(values: DataFrame, donors: Donors) -> DataFrame:
    """(x, filled): the distinct rows of ``values`` with gaps as arrays, and their filled columns.

    A gap gets the mean of the k nearest donors that have the column, ties going to the smaller
    value; of all if there are fewer, and the column's mean if no donor shares a column.
    """
    names, k, width, means = values.columns, donors.k, donors.width, donors.means
    gaps = values.where(" or ".join(f"{c} is null" for c in names)).groupBy(F.array(*names).alias("x")).agg(F.lit(1)).select("x")
    gaps = gaps.withColumn("id", F.monotonically_increasing_id())
    schema = "x array<double>, id long"
    if donors.tree is not None:
        gaps = _celled(gaps, donors.views, width, schema, best=True)
    else:
        gaps = gaps.withColumn("cell", F.lit(0))
    gaps = write_table(gaps, "gaps")
    sizes = np.zeros(sum(v.tree.size for v in donors.views) or 1, np.int64)
    for r in gaps.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    gaps = _dealt(gaps, Deal.of(sizes, GROUP_ROWS), "chunk")
    if donors.deal is None or donors.groups == 1:
        unbound = [F.lit(None).cast("array<double>").alias(c) for c in ("far", "value")]
        near = _search(gaps.select("x", "id", "cell", "chunk", F.lit(0).cast("long").alias("group"), *unbound), donors)
    else:
        gaps = gaps.repartition(_partitions(gaps, int(sizes.sum()) // GROUP_ROWS), "id")
        near = write_table(_search(_first_visits(gaps, donors), donors), "near")
        for most in (FEW_GROUPS, None):
            more = write_table(_search(_further(gaps.join(_found(near), "id"), donors, most), donors), "near")
            near = near.unionByName(more)
    merged = _found(near)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare = np.array(means)
        for batch in batches:
            rows = _matrix(batch.column("x"), width)
            row, axis, best_d, best_v = _merged(rows, batch.column("found"), k)
            n = np.isfinite(best_d).sum(1)
            total = np.where(np.isfinite(best_d), best_v, 0.0).sum(1)
            rows[row, axis] = np.where(n > 0, total / np.maximum(n, 1), spare[axis])
            filled = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([batch.column("x"), filled], ["x", "filled"])

    return gaps.select("x", "id").join(merged, "id").select("x", "found").mapInArrow(
        mean, "x array<double>, filled array<double>")


def _found(near: DataFrame) -> DataFrame:
    """(id, found): all that the visits of a row found."""
    return near.groupBy("id").agg(F.collect_list(F.struct("group", "d", "v")).alias("found"))


def _merged(rows: np.ndarray, found: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of each gap, and the k nearest distances and values over all visits."""
    row, axis = np.nonzero(np.isnan(rows))
    slots = np.bincount(row, minlength=len(rows))
    times = np.diff(found.offsets.to_numpy()) if len(found) else np.zeros(0, np.int64)
    parts = found.flatten()
    # Each list has k places for every gap of its row.
    of = np.repeat(np.arange(len(rows)), times)
    first = np.cumsum(slots) - slots
    places = slots[of]
    before = np.cumsum(places) - places
    slot = np.repeat(np.arange(places.sum()) - np.repeat(before, places) + np.repeat(first[of], places), k)
    d, v = (parts.field(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
    best_d, best_v = np.full((len(row), k), np.inf), np.zeros((len(row), k))
    use = np.isfinite(d)
    _keep_best(best_d, best_v, slot[use], d[use], v[use], k)
    return row, axis, best_d, best_v


def _keep_best(best_d: np.ndarray, best_v: np.ndarray, slot: np.ndarray, d: np.ndarray, v: np.ndarray, k: int) -> None:
    """Merge new (slot, distance, value) into the k best of each slot, nearest first, in place."""
    if not len(slot):
        return
    touched = np.unique(slot)
    slot = np.concatenate([np.repeat(touched, k), slot])
    d = np.concatenate([best_d[touched].ravel(), d])
    v = np.concatenate([best_v[touched].ravel(), v])
    order = np.lexsort((v, d, slot))
    slot, d, v = slot[order], d[order], v[order]
    starts = np.searchsorted(slot, touched)
    place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
    kept = place < k
    best_d[touched], best_v[touched] = d[kept].reshape(-1, k), v[kept].reshape(-1, k)


VISIT = "x array<double>, id long, cell int, chunk long, group long, far array<double>, value array<double>"


def _visits(part: pa.RecordBatch, row: np.ndarray, group: np.ndarray, far: pa.Array, value: pa.Array) -> Iterator[pa.RecordBatch]:
    """Records of VISIT: the rows ``row`` of ``part`` to the groups ``group``."""
    for start in range(0, len(row), 10_000):
        who = pa.array(row[start:start + 10_000])
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c).take(who) for c in ("x", "id", "cell", "chunk")],
             pa.array(group[start:start + 10_000]), far.take(who), value.take(who)],
            ["x", "id", "cell", "chunk", "group", "far", "value"])


def _by_view(rows: np.ndarray, views: list[View]) -> Iterator[tuple[View, np.ndarray]]:
    """Each view with the places of the rows that search it."""
    best = _best_view(rows, views)
    for at in np.unique(best):
        yield views[at], np.flatnonzero(best == at)


def _first_visits(gaps: DataFrame, donors: Donors) -> DataFrame:
    """Rows with the most promising group for each of their gaps; all rows have one at least.

    A row's own cell may hold no donor with the column it lacks; without any, no cell could be left out.
    """
    width, views, groups = donors.width, donors.views, donors.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REACH_ROWS):
                part = batch.slice(at, REACH_ROWS)
                rows, cell, chance = _finite(_matrix(part.column("x"), width)), part.column("cell").to_numpy(), part.column("id").to_numpy()
                both = []
                for view, own in _by_view(rows, views):
                    row, group = view.starts(rows[own], chance[own])
                    lost = np.setdiff1d(np.arange(len(own)), row)
                    spare = view.first_group + view.deal.group_of(cell[own[lost]] - view.first_cell, chance[own[lost]])
                    both.append(own[np.concatenate([row, lost])] * groups + np.concatenate([group, spare]))
                both = np.unique(np.concatenate(both))
                none = pa.nulls(len(rows), pa.list_(pa.float64()))
                yield from _visits(part, both // groups, both % groups, none, none)

    return gaps.select("x", "id", "cell", "chunk").mapInArrow(run, VISIT)


def _further(found: DataFrame, donors: Donors, most: int | None) -> DataFrame:
    """Rows once for each other group with a cell that can hold a donor that comes before their k-th so far.

    Those are the ``most`` nearest groups, or all.
    """
    width, k, views, groups = donors.width, donors.k, donors.views, donors.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REACH_ROWS):
                part = batch.slice(at, REACH_ROWS)
                raw, seen = _matrix(part.column("x"), width), part.column("found")
                gap_row, axis, best_d, best_v = _merged(raw, seen, k)
                far, value = np.full(raw.shape, -1.0), np.full(raw.shape, -np.inf)
                far[gap_row, axis], value[gap_row, axis] = best_d[:, -1], best_v[:, -1]
                rows = _finite(raw)
                found = []
                for view, own in _by_view(rows, views):
                    row, group, near = view.visits(rows[own], far[own], value[own])
                    found.append((own[row], group, near))
                row, group, near = (np.concatenate(f) for f in zip(*found))
                # Nearest first.
                both = (row * groups + group)[np.lexsort((near, row))]
                visited = np.repeat(np.arange(len(rows)), np.diff(seen.offsets.to_numpy())) * groups
                both = both[~np.isin(both, visited + seen.flatten().field(0).to_numpy())]
                row = both // groups
                if most is not None:
                    both = both[np.arange(len(row)) - np.searchsorted(row, row) < most]
                    row = both // groups
                ends = pa.array(np.append(0, np.cumsum(np.bincount(gap_row, minlength=len(rows)))).astype(np.int32))
                yield from _visits(
                    part, row, both % groups, pa.ListArray.from_arrays(ends, pa.array(best_d[:, -1].copy())),
                    pa.ListArray.from_arrays(ends, pa.array(best_v[:, -1].copy())))

    return found.select("x", "id", "cell", "chunk", "found").mapInArrow(run, VISIT)


def _partitions(df: DataFrame, wanted: int) -> int:
    """Partitions for rows that are few in bytes but take long: Spark would join them into too few."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(wanted, MAX_CELLS))


def _search(visits: DataFrame, donors: Donors) -> DataFrame:
    """(id, group, d, v): for each row and visited group the k nearest donors of each gap in it.

    Both arrays have k places for each gap of the row, columns ascending; unused ones are infinitely
    far. ``far`` and ``value`` have the k-th found before, or are null; what does not come before it is
    left out. The donors of a group are sent as often as its visitors fill a task.
    """
    width, k = donors.width, donors.k
    ways = [(v.first_group, v.columns) for v in donors.views] or [(0, np.ones(width, bool))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "group": pa.array([], pa.int64()),
                             "d": pa.array([], pa.list_(pa.float64())), "v": pa.array([], pa.list_(pa.float64()))})
        left = left.take(np.argsort(left["cell"].to_numpy(), kind="stable"))
        raw = _matrix(left["x"].combine_chunks(), width)
        gap = np.isnan(raw)
        slots = gap.sum(1)
        first = np.cumsum(slots) - slots
        far, value = np.full(int(slots.sum()), np.inf), np.zeros(int(slots.sum()))
        if left["far"].null_count == 0:
            far, value = (left[c].combine_chunks().flatten().to_numpy().copy() for c in ("far", "value"))
        best_d, best_v = np.full((len(far), k), np.inf), np.zeros((len(far), k))
        if right.num_rows:
            group = left["group"][0].as_py()
            columns = next(c for g, c in reversed(ways) if g <= group)
            _scan_alike(_finite(raw), gap, first, far, value, best_d, best_v, right, width, k, columns)
        ends = pa.array((np.append(first, len(far)) * k).astype(np.int32))
        return pa.table({"id": left["id"], "group": left["group"], "d": pa.ListArray.from_arrays(ends, pa.array(best_d.ravel())),
                         "v": pa.ListArray.from_arrays(ends, pa.array(best_v.ravel()))})

    visits = write_table(visits, "visits")
    # Alike rows meet in one task, and no task gets more than others.
    before = F.coalesce(F.sum("n").over(
        Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = write_table(visits.groupBy("group", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "group", "chunk", F.floor(before / GROUP_ROWS).alias("part")), "visit-parts")
    tasks = parts.select("group", "part").distinct()
    n = _partitions(visits, 2 * tasks.count())
    come = visits.join(parts, ["group", "chunk"]).drop("chunk")
    sent = donors.table.join(tasks, "group").select(F.col("group").alias("group_"), F.col("part").alias("part_"), "x", "n")
    return come.repartition(n, "group", "part").groupBy("group", "part").cogroup(
        sent.repartition(n, "group_", "part_").groupBy("group_", "part_")).applyInArrow(
        run, "id long, group long, d array<double>, v array<double>")


def _alike(x: np.ndarray, gap: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, own): a row of each kind and the kind of each row.

    Rows of a kind have the same gaps and are equal in the columns ``some``, so donors with no other
    columns are as far from all of them.
    """
    seen = some & ~np.isnan(x)
    key = np.ascontiguousarray(np.hstack([np.where(seen, x, 0.0), seen, gap]))
    _, one, own = np.unique(key.view(f"V{key.itemsize * key.shape[1]}").ravel(), return_index=True, return_inverse=True)
    # Kinds in the order of their first rows, which lies alike rows side by side.
    order = np.argsort(one)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return one[order], place[own]


def _scan_alike(x, gap, first, far, value, best_d, best_v, donors: pa.Table, width: int, k: int, columns: np.ndarray) -> None:
    """``_scan`` for one row of each kind; of the limits of alike rows the last counts for all.

    Where donors lack the column that tells most rows apart, these go first, having few kinds to serve.
    """
    there = ~np.isnan(_matrix(donors["x"].combine_chunks(), width))
    some = there.any(0)
    one, own = _alike(x, gap, some)
    lack = (~there).sum(0)
    mixed = np.flatnonzero(some & (lack >= LEAF_ROWS))
    if len(mixed) and len(one) > LEAF_ROWS:
        axis = max(mixed, key=lambda c: len(np.unique(x[one, c])))
        if 2 * len(_alike(x[one], gap[one], some & (np.arange(width) != axis))[0]) <= len(one):
            for part in (~there[:, axis], there[:, axis]):
                _scan_alike(x, gap, first, far, value, best_d, best_v, donors.filter(pa.array(part)), width, k, columns)
            return
    slots = gap.sum(1)
    starts = np.cumsum(slots[one]) - slots[one]
    slot = np.arange(len(far)) + np.repeat(starts[own] - first, slots)
    order = np.lexsort((value, far, slot))
    last = order[np.append(np.diff(slot[order]) > 0, True)]
    one_d, one_v = np.full((len(last), k), np.inf), np.zeros((len(last), k))
    _scan(x[one], gap[one], starts, far[last], value[last], one_d, one_v, donors, width, k, columns)
    d, v = one_d[slot], one_v[slot]
    found = np.isfinite(d)
    _keep_best(best_d, best_v, np.repeat(np.arange(len(far)), found.sum(1)), d[found], v[found], k)
    last_d, last_v = best_d[:, -1], best_v[:, -1]
    nearer = (last_d < far) | ((last_d == far) & (last_v < value))
    far[nearer], value[nearer] = last_d[nearer], last_v[nearer]


def _scan(x, gap, first, far, value, best_d, best_v, donors: pa.Table, width: int, k: int, columns: np.ndarray) -> None:
    """Search all donors of a group for all rows, leaf by leaf, nearest leaves first.

    Leaves are cut along ``columns`` first.
    """
    y, n = _matrix(donors["x"].combine_chunks(), width), donors["n"].to_numpy()
    leaf = Tree(y, -(-len(y) // LEAF_ROWS), columns).cells(y)
    order = np.argsort(leaf, kind="stable")
    y, n, leaf = y[order], n[order], leaf[order]
    starts = np.flatnonzero(np.diff(leaf, prepend=-1))
    ends = np.append(starts[1:], len(y))
    boxes = Boxes.around(y, starts)
    slot_of = first[:, None] + np.cumsum(gap, 1) - 1
    row_of, axis_of = np.nonzero(gap)
    for at in range(0, len(x), BLOCK_ROWS):
        block = np.arange(at, min(at + BLOCK_ROWS, len(x)))
        slots = np.where(gap[block], slot_of[block], -1)
        reach = boxes.least_distances(x[block])
        limits, values = np.where(slots >= 0, far[slots], -1.0), np.where(slots >= 0, value[slots], -np.inf)
        needed = boxes.needed(reach, limits, values)
        order = np.lexsort((boxes.shared(x[block]).mean(0), np.where(np.isfinite(reach), reach, 1e300).mean(0)))
        for c in order[needed.any(0)[order]]:
            who = np.flatnonzero(needed[:, c])
            mine, last = limits[who], values[who]
            wanted = np.where(mine > 0, boxes.some[c], boxes.low[c] < last) & (reach[who, c, None] <= mine)
            live = wanted.any(1)
            if not live.any():
                continue
            who, mine, last = who[live], mine[live], last[live]
            leaf = y[starts[c]:ends[c]]
            if np.isinf(mine).any():
                mine, last = _bounded(x[block[who]], mine, last, leaf, k)
            row, donor, d = _candidates(x[block[who]], mine, leaf, last)
            offered = leaf[donor]
            before = (d[:, None] < mine[row]) | ((d[:, None] == mine[row]) & (offered < last[row]))
            pair, axis = np.nonzero(before & ~np.isnan(offered))
            if not len(pair):
                continue
            touched = slots[who[row[pair]], axis]
            times = n[starts[c] + donor[pair]]
            _keep_best(best_d, best_v, np.repeat(touched, times), np.repeat(d[pair], times),
                       np.repeat(offered[pair, axis], times), k)
            touched = np.unique(touched)
            last_d, last_v = best_d[touched, -1], best_v[touched, -1]
            nearer = (last_d < far[touched]) | ((last_d == far[touched]) & (last_v < value[touched]))
            touched, last_d, last_v = touched[nearer], last_d[nearer], last_v[nearer]
            far[touched], value[touched] = last_d, last_v
            limits[row_of[touched] - at, axis_of[touched]], values[row_of[touched] - at, axis_of[touched]] = last_d, last_v


def _centred(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x0, mx, y0, my, slack): both less the mean of ``y``, zero where absent, and which are there.

    Sums of squares from matrix products of these are off by ``slack`` at most for each row of ``x``.
    """
    width = x.shape[1]
    there_x, there_y = ~np.isnan(x), ~np.isnan(y)
    centre = np.where(there_y, y, 0.0).sum(0) / np.maximum(there_y.sum(0), 1)
    x0, y0 = np.where(there_x, x - centre, 0.0), np.where(there_y, y - centre, 0.0)
    slack = 1e-14 * width * (4 + width) * ((x0 * x0).sum(1) + (y0 * y0).sum(1).max())
    return x0, there_x.astype(float), y0, there_y.astype(float), slack


def _bounded(x: np.ndarray, limits: np.ndarray, values: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``limits`` and ``values`` with infinite limits lowered to what the k nearest of ``y`` are sure to be within."""
    x0, mx, y0, my, slack = _centred(x, y)
    shared = mx @ my.T
    with np.errstate(divide="ignore", invalid="ignore"):
        square = (np.hstack([x0 * x0, mx, -2 * x0]) @ np.hstack([my, y0 * y0, y0]).T) * x.shape[1] / shared
    square[~(shared > 0)] = np.inf
    limits, values = limits.copy(), values.copy()
    for axis in np.flatnonzero(np.isinf(limits).any(0)):
        who, have = np.flatnonzero(np.isinf(limits[:, axis])), np.flatnonzero(my[:, axis])
        if len(have) >= k:
            kth = np.partition(square[np.ix_(who, have)], k - 1, axis=1)[:, k - 1]
            limits[who, axis] = np.sqrt(np.maximum(kth, 0.0) + slack[who]) * (1 + 1e-9) + 1e-300
            values[who, axis] = np.inf
    return limits, values


def _candidates(
    x: np.ndarray, limits: np.ndarray, y: np.ndarray, values: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, donor, distance) of the pairs that may be among the nearest of one of the row's gaps.

    Where a limit is zero, only donors whose value is below that of ``values`` are.

    Matrix products give all distances but for rounding; those within it of a limit are computed
    again, column by column. Where a gap has no limit yet, all donors with its column are.
    """
    width = x.shape[1]
    x0, mx, y0, my, slack = _centred(x, y)
    there_y = my > 0
    farthest = np.where(np.isfinite(limits), limits, -1.0).max(1)
    # Squares less what is allowed for each shared column; where nothing is, no pair is near.
    allowed = np.where(farthest >= 0, farthest * farthest * (1 + 1e-12) + 2 * slack, -1.0)[:, None]
    near = np.hstack([width * x0 * x0 - allowed * mx, width * mx, -2 * width * x0]) @ np.hstack([my, y0 * y0, y0]).T <= 0
    for axis in np.flatnonzero(np.isinf(limits).any(0)):
        near[np.ix_(np.isinf(limits[:, axis]), there_y[:, axis])] = True
    row, donor = np.nonzero(near)
    if values is not None:
        use = (limits[row] > 0) & there_y[donor] | (y[donor] < values[row])
        row, donor = row[use.any(1)], donor[use.any(1)]
    some = (mx[row] * my[donor]).any(1)
    row, donor = row[some], donor[some]
    total, common = np.zeros(len(row)), np.zeros(len(row))
    for axis in range(width):
        off = x[row, axis] - y[donor, axis]
        both = ~np.isnan(off)
        total += np.where(both, off * off, 0.0)
        common += both
    return row, donor, np.sqrt(width / common * total)
