"""Embedding near-duplicates by an inverted multi-index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import components, smallest
from scrubline.storage import write_table

#: Vectors the codebooks are learned from, and centroids of each at most.
SAMPLE_VECTORS, MAX_CENTROIDS = 16_384, 1024
#: Vectors that are compared with all rows to find how many cells a search has to visit.
QUERIES, TARGET_RECALL, LEAST_VISITS = 512, 0.995, 4
#: Cells a vector may visit; a grid that needs more gives way to one with a quarter of the centroids.
MOST_VISITS = 256
#: Queries with more links than this are judged apart, so that they do not outvote the others.
MANY_LINKS = 64
#: Rows of one side of a cell that are compared in one block.
BLOCK_ROWS = 1024
#: Rows of a task of the search.
TASK_ROWS = 8192


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the two halves of the unit vectors; a cell is a pair of them."""

    left: np.ndarray
    right: np.ndarray

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to its centroids."""
        half = unit.shape[1] // 2
        out = []
        for x, c in ((unit[:, :half], self.left), (unit[:, half:], self.right)):
            out.append(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0))
        return out[0], out[1]

    def traverse(self, unit: np.ndarray, visits: int) -> np.ndarray:
        """Multi-sequence traversal: the ``visits`` nearest cells of each vector, nearest first.

        The r-th nearest cell pairs centroids of ranks i and j with (i + 1) (j + 1) <= r, so only
        those pairs of the two sorted sequences are looked at.
        """
        d1, d2 = self.distances(unit)
        s1, s2 = np.argsort(d1, 1, "stable")[:, :visits], np.argsort(d2, 1, "stable")[:, :visits]
        d1, d2 = np.take_along_axis(d1, s1, 1), np.take_along_axis(d2, s2, 1)
        i, j = np.meshgrid(np.arange(d1.shape[1]), np.arange(d2.shape[1]), indexing="ij")
        near = ((i + 1) * (j + 1) <= visits).ravel()
        i, j = i.ravel()[near], j.ravel()[near]
        order = np.argsort(d1[:, i] + d2[:, j], 1, "stable")[:, :visits]
        rows = np.arange(len(unit))[:, None]
        return s1[rows, i[order]] * len(self.right) + s2[rows, j[order]]


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """At most ``k`` centroids of the points; empty ones are left out."""
    rng = np.random.Generator(np.random.PCG64(seed))
    distinct = np.unique(points, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = ((centers * centers).sum(1) - 2 * points @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centers))
        centers = sums[n > 0] / n[n > 0, None]
    return centers


def thinned(unit: np.ndarray, threshold: float) -> np.ndarray:
    """The rows without those that link with an earlier one that stays: a crowd leaves few."""
    kept = unit[:0]
    for at in range(0, len(unit), 512):
        part = unit[at:at + 512]
        if len(kept):
            part = part[(part @ kept.T < threshold).all(1)]
        linked, stays = part @ part.T >= threshold, np.ones(len(part), bool)
        for i in range(len(part)):
            if stays[i]:
                stays[i + 1:] &= ~linked[i, i + 1:]
        kept = np.concatenate([kept, part[stays]])
    return kept


def _matrix(column) -> np.ndarray:
    """Vectors of a binary column of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column])


def unit_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, dim, unit): the vector scaled to length 1, null if it can not be compared."""
    id_type = dict(df.dtypes)[vec_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units = [], []
            for v in batch.column(1):
                values = v.values if v.is_valid else None
                body = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()
                        body = (x / np.sqrt((x * x).sum())).tobytes()
                dims.append(len(body) // 8 if body else None)
                units.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "dim", "unit"])

    return df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e")).mapInArrow(
        run, f"vec_id {id_type}, dim int, unit binary")


def fit_codebooks(vectors: DataFrame, k: int, threshold: float) -> Codebooks:
    """Codebooks of at most ``k`` centroids from at most SAMPLE_VECTORS vectors, the first by their key.

    Of sampled vectors that link with each other few are learned from, so that a crowd of near copies
    does not draw centroids to itself and lies in few cells.
    """
    sample = smallest(vectors.select("key", "unit"), F.xxhash64("key"), ["key"], SAMPLE_VECTORS, vectors.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = [(k.as_py(), np.frombuffer(v.as_buffer(), np.float64)) for b in batches for k, v in zip(b.column(0), b.column(1))]
        if points:
            x = thinned(np.stack([p[1] for p in sorted(points, key=lambda p: p[0])]), threshold)
            half = x.shape[1] // 2
            books = [k_means(x[:, :half], k), k_means(x[:, half:], k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.tobytes()]) for b in books] + [pa.array([len(b)]) for b in books], ["l", "r", "nl", "nr"])

    # A bounded sample: one task learns from it, and the driver gets the codebooks.
    row = sample.repartition(1).mapInArrow(run, "l binary, r binary, nl long, nr long").first()
    return Codebooks(np.frombuffer(row["l"]).reshape(row["nl"], -1), np.frombuffer(row["r"]).reshape(row["nr"], -1))


def find_visits(vectors: DataFrame, books: Codebooks, threshold: float, target: float) -> int | None:
    """How many cells to visit so that ``target`` of the links of a sample of queries are found.

    At most QUERIES vectors are compared with all rows in blocks. Of each link it is noted at which
    visit one of its ends meets the cell of the other. The target has to hold for queries with many
    links and for the others; None if MOST_VISITS are too few for that, which they never are for a grid of
    no more cells.
    """
    queries = smallest(
        vectors.select("key", "unit"), F.xxhash64("key", F.lit(1)), ["key"], QUERIES, vectors.count()).toArrow()
    q = _matrix(queries.column("unit").combine_chunks())
    names = queries.column("key").to_numpy()
    most = int(min(len(books.left) * len(books.right), MOST_VISITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = books.traverse(q, most)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column(1))
                a, b = np.nonzero(q @ x.T >= threshold)
                other = names[a] != part.column(0).to_numpy()[b]
                a, b = a[other], b[other]
                if not len(a):
                    continue
                ends, b = np.unique(b, return_inverse=True)
                back = books.traverse(x[ends], most)
                met = np.full(len(a), most, np.int64)
                for i in range(0, len(a), 1 << 14):  # as many links at once as fit in memory
                    some = slice(i, i + (1 << 14))
                    for cells, own in ((seen[a[some]], back[b[some], 0]), (back[b[some]], seen[a[some], 0])):
                        hit = cells == own[:, None]
                        met[some] = np.minimum(met[some], np.where(hit.any(1), hit.argmax(1), most))
                place, n = np.unique(a * (most + 1) + met, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place // (most + 1)), pa.array(place % (most + 1) + 1), pa.array(n)], ["query", "visits", "n"])

    # At most 257 rows for each of the queries.
    found = vectors.select("key", "unit").mapInArrow(run, "query long, visits long, n long").groupBy(
        "query", "visits").agg(F.sum("n").alias("n")).toArrow()
    query, at, n = (found.column(c).to_numpy() for c in ("query", "visits", "n"))
    many = np.bincount(query, n, len(q))[query] > MANY_LINKS
    needed = LEAST_VISITS
    for judged in (many, ~many):
        reached = np.cumsum(np.bincount(at[judged], n[judged], most + 2))
        least = int(np.argmax(reached >= target * reached[-1])) if judged.any() else 0
        if least > most:
            return None
        needed = max(needed, least)
    return needed


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that connect all that a matrix of links connects.

    Every row with links has an edge to its first column and every column to the least row of its
    component that it can be led to: no more edges than rows and columns, and one for each step of
    the least label through the matrix.
    """
    rows = len(linked)
    label, edges = np.arange(rows), []
    met = np.flatnonzero(linked.any(0))
    linked_met = linked[:, met]
    while True:
        best = np.where(linked_met, label[:, None], rows).argmin(0)  # the row with the least label
        edges.append((best, met))
        low = label[best]
        first = np.where(linked_met, low, rows).argmin(1)
        some = linked_met.any(1)
        edges.append((np.flatnonzero(some), met[first[some]]))
        new = np.where(some, np.minimum(label, low[first]), label)
        if (new == label).all():
            break
        label = new
    return np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every row of ``df`` with its links by cosine.

    Vectors link if their cosine, in double precision, is at least ``threshold``; ``n_links`` counts
    the other rows found to link with a row, ``component_id`` is the smallest id that links reach, its
    own included, and ``kept`` marks the rows that are their component's id. Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, others only with those of as
    many components. Rows with equal vectors link; rows that share an id are counted each. A null id is kept if no row with an id is in its component. An empty table gives no
    rows; further columns are ignored.

    Equal vectors are one with a weight. The halves of the unit vectors have a codebook each, learned
    from a bounded sample; every vector is filed in its cell of the product grid and visits the cells
    nearest to it, as many as a sample of queries needs for ``target`` of its links. If that takes too many
    visits the grid is made coarser, down to a single cell, which compares all pairs. Both ends of a link
    may find it. Cells with many rows are compared in blocks, of which only sums and a spanning forest
    go on, never the pairs. Each number of components has an index of its own; but for the commonest, those
    of at most BLOCK_ROWS vectors are one block.
    """
    units = write_table(unit_vectors(df, vec_id, embedding), "vectors")
    rows = units.withColumn("key", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))
    vectors = write_table(rows.where("key is not null").groupBy("key").agg(
        F.first("unit").alias("unit"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("weight"),
        F.min("vec_id").alias("first")), "distinct-vectors")
    # As many rows as there are numbers of components; few have many vectors.
    dims = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    common = [tuple(r) for r in dims.where(F.col("n") > BLOCK_ROWS).collect()] or [
        tuple(r) for r in dims.orderBy(F.desc("n"), "dim").limit(1).collect()]
    if not common:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    rare = vectors.where(~F.col("dim").isin([d for d, _ in common]))
    found = write_table(rare.groupBy("dim").applyInArrow(_compare_all(threshold), LINKS), "vector-links")
    for dim, n in common:
        found = found.unionByName(_indexed_links(vectors.where(F.col("dim") == dim), n, threshold, target))
    counts = found.where("u = v").groupBy("u").agg(F.sum("n").alias("n"))
    roots = write_table(components(found.where("u <> v").select("u", "v").distinct()), "vector-roots")
    placed = vectors.select("key", "first", "weight").join(roots, F.col("key") == F.col("node"), "left").select(
        "key", "first", "weight", F.coalesce("root", F.col("key")).alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_key = placed.join(names, "root").join(counts, F.col("key") == F.col("u"), "left").select(
        F.col("key").alias("_key"), "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    done = rows.join(of_key, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


#: Sums of links (u = v) and edges of a spanning forest.
LINKS = "u long, v long, n long"


def _links_table(us: list, vs: list, ns: list) -> pa.Table:
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.table({"u": pa.array(join(us)), "v": pa.array(join(vs)), "n": pa.array(join(ns))})


def _compare_all(threshold: float):
    """Links among the at most BLOCK_ROWS vectors of a group, compared in whole."""
    def run(table: pa.Table) -> pa.Table:
        key, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
        unit = _matrix(table.column("unit").combine_chunks())
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        x, y = forest(linked) if linked.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return _links_table([key, key[x]], [key, key[y]], [linked @ weight, np.zeros(len(x), np.int64)])

    return run


def _indexed_links(vectors: DataFrame, n: int, threshold: float, target: float) -> DataFrame:
    """Links among the ``n`` distinct vectors of one number of components, by the index."""
    k = int(min(MAX_CENTROIDS, max(1, round(np.sqrt(n)))))
    while True:
        books = fit_codebooks(vectors, k, threshold)
        visits = find_visits(vectors, books, threshold, target)
        if visits is not None:
            break
        k = max(1, k // 4)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = books.traverse(_matrix(part.column(1)), visits)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(list(cells.astype(np.int64)), pa.list_(pa.int64()))],
                    ["key", "unit", "weight", "cells"])

    filed = write_table(vectors.select("key", "unit", "weight").mapInArrow(
        file, "key long, unit binary, weight long, cells array<long>"), "filed-vectors")
    members = filed.select(F.element_at("cells", 1).alias("cell"), "*")
    probes = filed.select(F.explode("cells").alias("cell"), "*")
    # Blocks of the cells with many members or probes; the others are one block.
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).join(
        probes.groupBy("cell").agg(F.count(F.lit(1)).alias("p")), "cell")
    large = write_table(sizes.where((F.col("m") > BLOCK_ROWS) | (F.col("p") > BLOCK_ROWS)).select(
        "cell", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("mb"), F.ceil(F.col("p") / BLOCK_ROWS).cast("int").alias("pb"),
        "m", "p"), "large-cells")
    # Rows that large cells deal out again, once for each block of the other side.
    again = large.agg(F.coalesce(F.sum(F.col("m") * (F.col("pb") - 1) + F.col("p") * (F.col("mb") - 1)), F.lit(0))).first()[0]
    large = large.drop("m", "p")

    def dealt(side: DataFrame, own: str, other: str, role: int) -> DataFrame:
        """Rows with their block and each block of the other side."""
        wide = side.join(large, "cell", "left").withColumns({
            own: F.pmod(F.xxhash64("key", F.lit(role)), F.coalesce(own, F.lit(1))).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)),
        })
        return wide.select("cell", "mb", "pb", F.lit(role).alias("role"), "key", "unit", "weight", "cells")

    # Probes of cells without members meet nothing.
    probes = probes.join(members.select("cell").distinct(), "cell", "left_semi")
    both = dealt(members, "mb", "pb", 0).unionByName(dealt(probes, "pb", "mb", 1))
    tasks = max(1, -(-(n * (visits + 1) + again) // TASK_ROWS))
    both = both.withColumn("task", F.pmod(F.xxhash64("cell", "mb", "pb"), F.lit(tasks)).cast("int"))

    def search(table: pa.Table) -> pa.Table:
        cell, mb, pb, role = (table.column(c).to_numpy() for c in ("cell", "mb", "pb", "role"))
        order = np.lexsort((role, pb, mb, cell))
        same = (np.diff(cell[order]) == 0) & (np.diff(mb[order]) == 0) & (np.diff(pb[order]) == 0)
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(order)]])
        key, weight = table.column("key").to_numpy(), table.column("weight").to_numpy()
        unit = _matrix(table.column("unit").combine_chunks())
        cells = table.column("cells").combine_chunks()
        seen = cells.flatten().to_numpy().reshape(len(key), -1)
        us, vs, ns = [], [], []
        for a, z in zip(starts[:-1], starts[1:]):
            group = order[a:z]
            m, p = group[role[group] == 0], group[role[group] == 1]
            if not len(m) or not len(p):
                continue
            linked = unit[p] @ unit[m].T >= threshold
            linked &= key[p][:, None] != key[m]
            pi, mi = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            if not len(pi):
                continue
            p, m, linked = p[pi], m[mi], linked[np.ix_(pi, mi)]
            # If the member visits the probe's cell too, the end with the smaller key counts.
            own, which = np.unique(seen[p, 0], return_inverse=True)
            visited = np.stack([(seen[m] == c).any(1) for c in own])[which]
            linked &= ~visited | (key[p][:, None] < key[m])
            us += [key[p], key[m]]
            vs += [key[p], key[m]]
            ns += [linked @ weight[m], weight[p] @ linked]
            if linked.any():
                x, y = forest(linked)
                us.append(key[p][x])
                vs.append(key[m][y])
                ns.append(np.zeros(len(x), np.int64))
        return _links_table(us, vs, ns)

    return write_table(both.groupBy("task").applyInArrow(search, LINKS), "vector-links")
