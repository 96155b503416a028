"""Exact k nearest neighbours by pivots, without comparing every block with every other.

References are dealt into cells: each belongs to the nearest of a bounded number of pivots
(sampled references), and each cell is a folder of its own.  Per cell a few numbers reach the driver: size, bounding box,
largest and smallest distance to the pivot, the k smallest such distances.  They bound, for each query, the
distance of a whole cell from below (triangle inequality, bounding box, and the half-space between two pivots).

Queries are sorted by the cell they lie in and go in blocks through tasks that read cells from the shared folder: first
the queries' own cell, which tells how near the k-th neighbour must be, then every other cell that may hold a nearer
row.  Nothing but the neighbours found is shuffled; a task holds a block of queries and a block of one cell.  Squared
distances pick the candidates, with room for their rounding; the distances of the candidates are computed one by one.

Rows with gaps (imputation) are dealt by the pattern of their gaps first.  Within a pattern the
distance over common coordinates is bounded by the box over these coordinates; rare patterns
share cells without bounds, which every query visits.  All columns are filled in one pass.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number_or_null
from ..session import bounded_collect, materialize, new_path

QUERY_BLOCK, REFERENCE_BLOCK = 2_048, 32_768
CHUNK = 256
# Rows a cell should have, and how many cells and separate patterns of gaps there may be.
CELL_ROWS, MAX_CELLS, MAX_PATTERNS = 4_096, 1_024, 64
# Relative slack of the bounds: rounding may not lose a neighbour.
SLACK = 1e-9
# Pairs compared at once, coordinates up to which they are summed one by one, bytes of cells a task keeps.
PAIRS, FEW, KEPT_BYTES = 1 << 17, 16, 48_000_000
NO_ID = np.iinfo(np.int64).max


def _blocks(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def _squares(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, one coordinate after the other."""
    out, gap, r = np.zeros((len(q), len(r))), np.empty((len(q), len(r))), np.ascontiguousarray(r.T)
    for j in range(q.shape[1]):
        np.subtract(q[:, j, None], r[j], out=gap)
        gap *= gap
        out += gap
    return out


def _near_squares(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs, and how far each query's may be off."""
    if q.shape[1] <= FEW or not (len(q) and len(r)):
        return _squares(q, r), np.zeros(len(q))
    centre = r.mean(axis=0)
    q, r = q - centre, r - centre
    qq, rr = (q * q).sum(axis=1), (r * r).sum(axis=1)
    out = q @ r.T
    out *= -2
    out += qq[:, None]
    out += rr
    return out, 16 * q.shape[1] * np.finfo(float).eps * (qq + rr.max())


def _vectors(column) -> np.ndarray:
    """Arrow or pandas lists of doubles as a matrix, null entries as NaN."""
    if isinstance(column, pa.ListArray) and len(column) and column.null_count == 0:
        width = len(column[0])
        if (np.diff(column.offsets.to_numpy()) == width).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    rows = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), -1)


# ---------------------------------------------------------------- cells
class Cells:
    """What is known of every cell: pattern of present coordinates, pivot, size, box, radii."""

    def __init__(self, pivots: np.ndarray, present: np.ndarray, mixed: np.ndarray):
        self.pivots, self.present, self.mixed = pivots, present, mixed  # one row per cell
        n, d = pivots.shape
        self.size = np.zeros(n, np.int64)
        self.low, self.high = np.full((n, d), np.inf), np.full((n, d), -np.inf)
        self.radii: list[np.ndarray] = [np.zeros(0)] * n  # the smallest distances to the pivot
        self.largest = np.zeros(n)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of each row; a row goes to the cells of its own pattern, if there are any."""
        own = ~np.isnan(x)
        cell, radius = np.full(len(x), -1), np.zeros(len(x))
        for pattern in np.unique(own, axis=0):
            rows = np.flatnonzero((own == pattern).all(axis=1))
            at = np.flatnonzero((self.present == pattern).all(axis=1) & ~self.mixed)
            if not len(at):
                cell[rows] = np.flatnonzero(self.mixed)[0]
                continue
            for part in np.array_split(rows, _blocks(len(rows), CHUNK)):
                d = np.sqrt(_squares(x[part][:, pattern], self.pivots[at][:, pattern]))
                cell[part], radius[part] = at[d.argmin(axis=1)], d.min(axis=1)
        return cell, radius

    def blocks(self) -> np.ndarray:
        return np.maximum(1, -(-self.size // REFERENCE_BLOCK))

    def bounds(self, x: np.ndarray, gaps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries x cells: least distance a row of the cell may have, distance to its pivot, coordinates in common."""
        n = len(self.size)
        has = ~np.isnan(x)
        box, pivot, count = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros((len(x), n))
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(x.shape[1]):
                q, common = x[:, j, None], has[:, j, None] & self.present[None, :, j]
                out = np.maximum(0, np.maximum(self.low[:, j] - q, q - self.high[:, j]))
                off = self.pivots[:, j] - q
                box += np.where(common, out * out, 0.0)
                pivot += np.where(common, off * off, 0.0) if gaps else off * off
                count += common
            scale = x.shape[1] / count if gaps else 1.0
            lower, pivot = np.sqrt(box * scale), np.sqrt(pivot * scale)
        if not gaps:
            alive = self.size > 0
            least = np.array([r[0] if len(r) else 0.0 for r in self.radii])
            nearest = np.where(alive, pivot, np.inf).min(axis=1, initial=np.inf)[:, None]
            with np.errstate(invalid="ignore"):
                lower = np.maximum.reduce([lower, pivot - self.largest, least - pivot, (pivot - nearest) / 2])
        lower[:, self.mixed] = 0.0
        return lower, pivot, count

    def home(self, x: np.ndarray, gaps: bool) -> np.ndarray:
        """The cell each query starts with: that of the nearest pivot, with gaps the one of the least lower bound."""
        lower, pivot, _ = self.bounds(x, gaps)
        alive = self.size > 0
        return np.where(alive & ~self.mixed, lower, np.inf).argmin(axis=1) if gaps else np.where(alive, pivot, np.inf).argmin(axis=1)

    def visits(self, x: np.ndarray, k: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Queries x cells: whether the cell may hold one of the k nearest, as far as the cells' numbers tell; and each
        query's home.  With ``wanted`` (queries x coordinates), one of
        the k nearest among the rows that have the coordinate, for any wanted one."""
        n = len(self.size)
        out, alive = np.zeros((len(x), n), bool), self.size > 0
        lower, pivot, count = self.bounds(x, wanted is not None)
        home = self.home(x, wanted is not None)
        if wanted is None:
            radii = np.full((n, k), np.inf)
            for j in np.flatnonzero(alive):
                radii[j, : len(self.radii[j][:k])] = self.radii[j][:k]
            for i in range(len(x)):
                near = (pivot[i][:, None] + radii).ravel()
                bound = np.partition(near, k - 1)[k - 1]
                out[i] = alive & (lower[i] <= bound * (1 + SLACK) + SLACK)
            return out, home
        for i, q in enumerate(x):
            common = self.present & ~np.isnan(q)
            with np.errstate(invalid="ignore", divide="ignore"):
                reach = np.where(common, np.maximum(np.abs(q - self.low), np.abs(q - self.high)), 0.0)
                upper = np.sqrt((reach**2).sum(axis=1) * len(q) / count[i])
            upper[self.mixed] = np.inf
            usable = alive & ((count[i] > 0) | self.mixed)
            for c in np.flatnonzero(wanted[i]):
                fit = usable & (self.present[:, c] | self.mixed)
                order = np.argsort(np.where(fit, upper, np.inf))
                held = np.cumsum(np.where(fit & ~self.mixed, self.size, 0)[order])
                at = np.searchsorted(held, k)
                bound = upper[order[at]] if at < n else np.inf
                out[i] |= fit & (lower[i] <= bound * (1 + SLACK) + SLACK)
        return out, home


def _sampled_pivots(refs: DataFrame, dims: int) -> Cells:
    """Pivots of every common pattern, in proportion to its rows; at most MAX_CELLS rows are kept on the driver."""
    pattern = F.transform("vec", lambda v: F.when(v.isNull() | F.isnan(v), F.lit("0")).otherwise(F.lit("1")))
    marked = refs.withColumn("pattern", F.concat_ws("", pattern))
    sizes = marked.groupBy("pattern").count().orderBy(F.desc("count"), "pattern").limit(MAX_PATTERNS).collect()
    total = sum(r["count"] for r in sizes)
    room = max(1, MAX_CELLS - len(sizes) - 1)
    asked = {r["pattern"]: max(1, min(_blocks(r["count"], CELL_ROWS), int(room * r["count"] / max(1, total)) or 1)) for r in sizes}
    place = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1 << 40))
    share = F.lit(None).cast("double")
    for r in sizes:  # twice as many as asked, so that enough are drawn; all of a small pattern
        p = min(1.0, (2.0 * asked[r["pattern"]] + 20) / r["count"])
        share = F.when(F.col("pattern") == r["pattern"], F.lit(p * float(1 << 40))).otherwise(share)
    drawn = marked.where(place < share).select("pattern", "vec", place.alias("place"), "id")
    found: dict[str, list] = {}
    for r in bounded_collect(drawn.orderBy("pattern", "place", "id"), 40 * MAX_PATTERNS + 8 * MAX_CELLS):
        mine = found.setdefault(r["pattern"], [])
        if len(mine) < asked[r["pattern"]]:
            mine.append(r["vec"])
    rows = [(v, [c == "1" for c in p], False) for p in found for v in found[p]] + [([0.0] * dims, [True] * dims, True)]
    pivots = np.array([[0.0 if x is None or x != x else x for x in v] for v, _, _ in rows], float).reshape(len(rows), dims)
    return Cells(pivots, np.array([p for _, p, _ in rows]).reshape(len(rows), dims), np.array([m for _, _, m in rows]))


def _celled(refs: DataFrame, k: int, dims: int) -> tuple[DataFrame, Cells]:
    """The references with their cell, written to a folder per cell, and the cells with their numbers."""
    cells = _sampled_pivots(refs, dims)
    schema = T.StructType([*refs.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, radius = cells.assign(_vectors(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(radius, pa.float64())], names=[*batch.schema.names, "cell", "radius"])

    cells.path = new_path(refs.sparkSession, "neighbour-cells")
    refs.mapInArrow(assign, schema).repartition("cell").write.partitionBy("cell").parquet(cells.path)
    stored = refs.sparkSession.read.schema(schema).parquet(cells.path)

    def parts(batches):
        part = Cells(cells.pivots, cells.present, cells.mixed)
        for batch in batches:
            x, cell, radius = _vectors(batch.column("vec")), batch.column("cell").to_numpy(), batch.column("radius").to_numpy()
            for j in np.unique(cell):
                at = cell == j
                part.size[j] += at.sum()
                part.low[j], part.high[j] = np.fmin(part.low[j], np.fmin.reduce(x[at])), np.fmax(part.high[j], np.fmax.reduce(x[at]))
                part.largest[j] = max(part.largest[j], radius[at].max())
                part.radii[j] = np.sort(np.concatenate([part.radii[j], radius[at]]))[:k]
        live = np.flatnonzero(part.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(live, pa.int32()), pa.array(part.size[live]), pa.array(part.largest[live]), *[pa.array([list(m[j]) for j in live], pa.list_(pa.float64())) for m in (part.low, part.high, part.radii)]],
            names=["cell", "size", "largest", "low", "high", "radii"],
        )

    kinds = "cell int, size long, largest double, low array<double>, high array<double>, radii array<double>"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = np.min(np.stack(pdf["low"]), axis=0), np.max(np.stack(pdf["high"]), axis=0)
        radii = np.sort(np.concatenate(list(pdf["radii"])))[:k]
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "size": [pdf["size"].sum()], "largest": [pdf["largest"].max()], "low": [low], "high": [high], "radii": [radii]})

    numbers = stored.select("vec", "cell", "radius").mapInArrow(parts, kinds).groupBy("cell").applyInPandas(merge, kinds)
    for r in bounded_collect(numbers, MAX_CELLS + 1):
        j = r["cell"]
        cells.size[j], cells.largest[j], cells.low[j], cells.high[j], cells.radii[j] = r["size"], r["largest"], r["low"], r["high"], np.array(r["radii"])
    return stored, cells


# ---------------------------------------------------------------- search
class _Reader:
    """Blocks of a cell's rows from its folder: vectors, ids, payloads; small cells are kept for the next block of queries."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, self.base = fs.FileSystem.from_uri(path)
        self.kept: dict[int, list] = {}
        self.held = 0

    def blocks(self, cell: int):
        if cell in self.kept:
            yield from self.kept[cell]
            return
        import pyarrow.parquet as pq
        from pyarrow import fs

        seen, size = [], 0
        for info in sorted(self.store.get_file_info(fs.FileSelector(f"{self.base}/cell={cell}")), key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            with self.store.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=REFERENCE_BLOCK):
                    ids = batch.column("id").fill_null(NO_ID).to_numpy()
                    payload = batch.column("payload").to_numpy(zero_copy_only=False).astype(float) if "payload" in batch.schema.names else None
                    part = (_vectors(batch.column("vec")), ids, payload)
                    size += part[0].nbytes + 16 * len(ids)
                    if size <= KEPT_BYTES // 4:
                        seen.append(part)
                    yield part
        if size <= KEPT_BYTES // 4:
            if self.held + size > KEPT_BYTES:
                self.kept, self.held = {}, 0
            self.kept[cell] = seen
            self.held += size


class _Best:
    """The k nearest rows found so far, per query and slot (one slot, or one per coordinate to fill)."""

    def __init__(self, n: int, slots: int, k: int):
        self.k = k
        self.distance, self.id = np.full((n, slots, k), np.inf), np.full((n, slots, k), NO_ID)
        self.value, self.found = np.full((n, slots, k), np.nan), np.zeros((n, slots), int)

    def limit(self) -> np.ndarray:
        """Distance of the k-th row, infinite while there are fewer."""
        return np.where(self.found == self.k, self.distance[:, :, -1], np.inf)

    def add(self, slot: int, query: np.ndarray, distance: np.ndarray, ident: np.ndarray, value: np.ndarray) -> None:
        fits = distance <= self.limit()[query, slot]
        query, distance, ident, value = query[fits], distance[fits], ident[fits], value[fits]
        if not len(query):
            return
        some = np.unique(query)
        held = np.arange(self.k) < self.found[some, slot][:, None]
        query = np.concatenate([np.repeat(some, held.sum(axis=1)), query])
        distance = np.concatenate([self.distance[some, slot][held], distance])
        ident = np.concatenate([self.id[some, slot][held], ident])
        value = np.concatenate([self.value[some, slot][held], value])
        order = np.lexsort((ident, distance, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        order, query, rank = order[keep], query[keep], rank[keep]
        self.distance[query, slot, rank], self.id[query, slot, rank], self.value[query, slot, rank] = distance[order], ident[order], value[order]
        self.found[some, slot] = np.bincount(np.searchsorted(some, query), minlength=len(some))


def _meet(best: _Best, x: np.ndarray, rows: np.ndarray, block: tuple, wanted: list[int], gaps: bool) -> None:
    """Queries ``rows`` (all with the same gaps) against a block of references with the same gaps."""
    ref, ident, payload = block
    own = ~np.isnan(x[rows[0]])
    there = ~np.isnan(ref[0])
    slots = [i for i, c in enumerate(wanted) if there[c]] if gaps else [0]
    cols = np.flatnonzero(own & there) if gaps else np.arange(x.shape[1])
    if not (len(cols) and len(slots)):
        return
    factor = x.shape[1] / len(cols) if gaps else 1.0
    size = max(CHUNK // 4, PAIRS // len(ref))
    thin = np.ascontiguousarray(ref[:, cols])
    for begin in range(0, len(rows), size):
        some = rows[begin : begin + size]
        square, off = _near_squares(x[some][:, cols], thin)
        limit = (best.limit()[some][:, slots].max(axis=1) ** 2 / factor) * (1 + SLACK) + off
        free = np.flatnonzero(~np.isfinite(limit))
        if len(free) and len(ref) >= best.k:  # the k-th of this block is a bound
            limit[free] = np.partition(square[free], best.k - 1, axis=1)[:, best.k - 1] * (1 + SLACK) + 2 * off[free]
        q, r = np.nonzero(square <= limit[:, None])
        if not len(q):
            continue
        gap = ref[r] - x[some[q]]
        if gaps:
            total = np.where(np.isnan(gap), 0.0, gap)
            distance = np.sqrt((total**2).sum(axis=1) * x.shape[1] / len(cols))
        else:
            distance = np.sqrt((gap**2).sum(axis=1))
        for slot in slots:
            best.add(slot, some[q], distance, ident[r], ref[r, wanted[slot]] if gaps else payload[r])


def _same_gaps(x: np.ndarray) -> list[np.ndarray]:
    """Rows by the pattern of their gaps."""
    own = ~np.isnan(x)
    patterns, of = np.unique(own, axis=0, return_inverse=True)
    return [np.flatnonzero(of.ravel() == i) for i in range(len(patterns))]


def _found(x: np.ndarray, home: np.ndarray, cells: Cells, reader: _Reader, k: int, gaps: bool) -> tuple[_Best, list[int]]:
    """The k nearest rows of queries with the same gaps."""
    wanted = np.flatnonzero(np.isnan(x[0])).tolist() if gaps else [-1]
    best = _Best(len(x), len(wanted), k)
    lower, pivot, count = cells.bounds(x, gaps)
    fit = np.stack([(cells.size > 0) & (cells.mixed | cells.present[:, c] if gaps else True) for c in wanted])
    if gaps:
        fit &= cells.mixed | (count[0] > 0)
    usable = fit.any(axis=0)

    def visit(cell: int, rows: np.ndarray) -> None:
        for block in reader.blocks(cell):
            for same in _same_gaps(block[0]) if gaps else [np.flatnonzero(~np.isnan(block[0]).any(axis=1))]:
                if not len(same):
                    continue
                _meet(best, x, rows, tuple(None if b is None else b[same] for b in block), wanted, gaps)

    first = np.where(usable & ~cells.mixed, pivot, np.inf).argmin(axis=1) if gaps else home
    for cell in np.unique(first):
        if usable[cell]:
            visit(int(cell), np.flatnonzero(first == cell))
    with np.errstate(invalid="ignore"):
        near = np.where(np.isnan(pivot), np.inf, pivot).mean(axis=0)
        for cell in np.argsort(near, kind="stable"):
            if usable[cell]:
                reach = np.where(fit[:, cell], best.limit(), -np.inf).max(axis=1)
                rows = np.flatnonzero((lower[:, cell] <= reach * (1 + SLACK) + SLACK) & (first != cell))
                if len(rows):
                    visit(int(cell), rows)
    return best, wanted


def _met(queries: DataFrame, references: DataFrame, k: int, gaps: bool) -> tuple[DataFrame, DataFrame]:
    """(q_id, at, r_id, distance, value) of the k nearest rows of each query and slot; and the pairs of homes and blocks
    of cells that the cells' numbers alone would let meet.  Queries of one home look at the same cells, so they go together."""
    first = references.select(F.size("vec").alias("d")).first()
    _, cells = _celled(references, k, first["d"] if first else 1)

    def at_home(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                x = _vectors(part.column("vec"))
                home = cells.home(x, gaps) if cells.size.any() else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32())], names=[*part.schema.names, "home"])

    homed = materialize(queries.mapInArrow(at_home, T.StructType([*queries.schema.fields, T.StructField("home", T.IntegerType())])), "neighbour-queries")

    def search(batches):
        reader = _Reader(cells.path)
        for block in _gathered(batches, QUERY_BLOCK):
            every, ids, home = _vectors(block.column("vec")), block.column("id"), block.column("home").to_numpy()
            for rows in (_same_gaps(every) if gaps else [np.arange(len(every))]) if cells.size.any() else []:
                best, wanted = _found(every[rows], home[rows], cells, reader, k, gaps)
                q, slot, rank = np.nonzero(np.arange(k) < best.found[:, :, None])
                ident = best.id[q, slot, rank]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[q])).cast(pa.int64()), pa.array(np.array(wanted)[slot], pa.int32()), pa.array(ident, pa.int64(), mask=ident == NO_ID),
                     pa.array(best.distance[q, slot, rank]), pa.array(best.value[q, slot, rank], from_pandas=True)],
                    names=["q_id", "at", "r_id", "distance", "value"],
                )

    dealt = homed.repartitionByRange(_blocks(homed.count(), QUERY_BLOCK), "home", F.xxhash64("id")).sortWithinPartitions("home")
    found = dealt.mapInArrow(search, "q_id bigint, at int, r_id bigint, distance double, value double")
    return found, _pairs(homed, cells, k, gaps)


def _gathered(batches, size: int):
    """The rows of a task in batches of ``size``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = size - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pairs(homed: DataFrame, cells: Cells, k: int, gaps: bool) -> DataFrame:
    counts = cells.blocks()

    def route(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                x = _vectors(part.column("vec"))
                row, cell = np.nonzero(cells.visits(x, k, np.isnan(x) if gaps else None)[0])
                each = counts[cell]
                row, cell = np.repeat(row, each), np.repeat(cell, each)
                block = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                home = part.column("home").to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in (cell, block, home)], names=["cell", "block", "home"])

    return homed.mapInArrow(route, "cell int, block int, home int").distinct()


def nearest(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """(q_id, r_id, distance, payload, rank) with Euclidean distances.

    Both sides have ``id`` and ``vec array<double>`` without gaps; references also a ``payload
    double``.  Ties are broken by the reference id.
    """
    met, _ = _met(queries.select("id", "vec"), references.select("id", "vec", "payload"), k, False)
    found = met.select("q_id", "r_id", "distance", F.col("value").alias("payload"))
    w = Window.partitionBy("q_id").orderBy("distance", "r_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_probability(queries: DataFrame, references: DataFrame, k: int = 15, weights: str = "uniform") -> DataFrame:
    """Vote share of class 1 among the k nearest references (payload = label).  With
    distance weights, exact matches outvote everything else."""
    return vote_share(nearest(queries, references, k), weights)


def vote_share(near: DataFrame, weights: str) -> DataFrame:
    """Votes of neighbours that were found; see ``knn_probability``."""
    if weights == "uniform":
        return near.groupBy(F.col("q_id").alias("id")).agg(F.avg("payload").alias("p"))
    inverse = F.when(F.col("distance") > 0, 1 / F.col("distance"))
    exact = F.count_if(F.col("distance") == 0)
    on_exact = F.avg(F.when(F.col("distance") == 0, F.col("payload")))
    weighted = F.sum(inverse * F.col("payload")) / F.sum(inverse)
    return near.groupBy(F.col("q_id").alias("id")).agg(F.when(exact > 0, on_exact).otherwise(weighted).alias("p"))


def knn_impute(df: DataFrame, train: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """Fill each gap (null or NaN) with the mean of that column over the k nearest train rows that
    have it (distances over the coordinates both rows have), else with the train mean."""
    columns = list(columns)
    vec = F.array(*[F.coalesce(number_or_null(c), F.lit(float("nan"))) for c in columns])
    gap = F.lit(False)
    for c in columns:
        gap = gap | number_or_null(c).isNull()
    queries = df.filter(gap).select(F.col(key).alias("id"), vec.alias("vec"))
    found, _ = _met(queries, train.select(F.col(key).alias("id"), vec.alias("vec")), k, True)
    w = Window.partitionBy("q_id", "at").orderBy("distance", "r_id")
    near = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    fills = near.groupBy(F.col("q_id").alias(key)).agg(*[F.avg(F.when(F.col("at") == i, F.col("value"))).alias(f"_fill_{i}") for i in range(len(columns))])
    means = train.agg(*[F.avg(number_or_null(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    out = df.join(fills, key, "left")
    return out.withColumns({c: F.coalesce(number_or_null(c), F.col(f"_fill_{i}"), F.lit(means[f"m{i}"])) for i, c in enumerate(columns)}).drop(*[f"_fill_{i}" for i in range(len(columns))])
