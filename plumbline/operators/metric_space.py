"""Exact neighbours and density in any number of columns, by metric partitioning.

Points are dealt to the nearest of some pivots, and cells of near pivots to blocks.  The triangle inequality tells
which cells can hold a point within a distance: a point is sent to the blocks of those cells only, of which there are
sixteen to thirty-two up to a million points, and meets in a block those cells only.  That needs nothing of the metric
but the inequality; cosine distance is half the squared Euclidean distance of unit vectors, which orders alike.
Results never depend on the pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ordered import null_safe_join, running
from plumbline.functions.settings import cut_lineage

METRICS = ("euclidean", "cityblock", "manhattan", "chebyshev", "canberra", "cosine")
BLOCKS = 16              # blocks that points are dealt to, as long as none gets over
BLOCK = 65_536           # points; these meet half as many of the points sent to a block in one task
PIVOT_BYTES = 32 << 20   # size of the pivots, which every task gets
CHUNK = 1 << 18          # numbers that a task computes at a time
STEP = 512               # points of a task that look for cells at a time
HITS = 1 << 20           # neighbours that a task holds before it drops all but the nearest
SLACK = 1e-9             # what rounding may take from a bound, as a share


def coordinates(p: np.ndarray, metric: str) -> np.ndarray:
    """Points as the metric compares them: for cosine unit vectors, with a direction of its own for the zero vector."""
    if metric != "cosine":
        return p
    largest = np.abs(p).max(axis=1, initial=0.0)
    scaled = p / np.where(largest > 0, largest, 1.0)[:, None]    # squares neither overflow nor vanish
    length = np.sqrt((scaled ** 2).sum(axis=1))
    return np.c_[scaled / np.where(length > 0, length, 1.0)[:, None], (length == 0).astype(float)]


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of rows of ``a`` to rows of ``b`` (cosine: Euclidean distances of coordinates)."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):    # one column after the other: a pair's distance is the same in any task
        gap = np.subtract.outer(a[:, i], b[:, i])
        if metric in ("euclidean", "cosine"):
            gap *= gap
            total += gap
            continue
        np.abs(gap, out=gap)
        if metric == "chebyshev":
            np.maximum(total, gap, out=total)
        elif metric == "canberra":
            size = np.abs(a[:, i])[:, None] + np.abs(b[:, i])
            total += np.divide(gap, size, out=np.zeros_like(gap), where=size > 0)
        else:
            total += gap
    return np.sqrt(total, out=total) if metric in ("euclidean", "cosine") else total


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1 if len(column) else 0)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _chunks(many: int, others: int) -> Iterator[slice]:
    step = max(1, CHUNK // max(1, others))
    return (slice(at, min(many, at + step)) for at in range(0, many, step))


@dataclass(frozen=True)
class Cells:
    """Pivots, and of each cell its points, their least and greatest distance to the pivot, its first block and its number of blocks."""

    pivots: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def bounds(self, d: np.ndarray, own: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What points at distances ``d`` from pivots, and ``own`` from their own, are away from the points of those cells at least.

        A point of a cell lies between the least and greatest distance from its pivot, and is no nearer to another pivot.
        """
        return np.maximum(np.maximum(d - self.most[cells], self.least[cells] - d), (d - own[:, None]) / 2) - SLACK * (1 + d)


def _dealt(pivots: np.ndarray, sizes: np.ndarray, room: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: cells are halved between two far pivots until a block has room for them."""
    first, parts, blocks = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0
    todo = [np.flatnonzero(sizes > 0)]
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and sizes[cells].sum() > room:
            x = pivots[cells]
            one = distances(x[:1], x, metric)[0].argmax()
            a = distances(x[one:one + 1], x, metric)[0]
            b = distances(x[a.argmax()][None], x, metric)[0]
            cells = cells[np.argsort(a - b, kind="stable")]
            half = np.cumsum(sizes[cells])
            cut = min(max(1, int(np.searchsorted(half, half[-1] / 2))), len(cells) - 1)
            todo += [cells[cut:], cells[:cut]]
        elif len(cells):
            first[cells], parts[cells] = blocks, max(1, math.ceil(sizes[cells].sum() / room)) if len(cells) == 1 else 1
            blocks += int(parts[cells[0]])
    return first, parts


class MetricSpace:
    """Weighted points (``p``, ``n``, key and other columns) dealt to pivots and blocks; only points of equal keys ever meet."""

    def __init__(self, points: DataFrame, metric: str, keys: Sequence[str] = ()):
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric!r}; it has to be one of {', '.join(METRICS)}")
        self.metric, self.keys, spark = metric, list(keys), points.sparkSession
        points = cut_lineage(points)
        self.types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in self.keys)
        self.types += ", " if self.keys else ""
        self.total = points.count()
        if not self.total:
            return
        wide = len(points.first()["p"]) + 1
        many = min(math.ceil(math.sqrt(self.total)), PIVOT_BYTES // (8 * wide))
        chosen = points.select("p").orderBy(F.xxhash64("p"), "p").limit(many).collect()
        pivots = coordinates(np.array([r.p for r in chosen], float).reshape(len(chosen), wide - 1), metric)
        sent = spark.sparkContext.broadcast(pivots)
        named, types = points.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cell, own = coordinates(_matrix(batch.column("p")), metric), [], []
                for rows in _chunks(len(x), len(sent.value)):
                    d = distances(x[rows], sent.value, metric)
                    cell.append(d.argmin(axis=1))
                    own.append(d.min(axis=1))
                empty = not len(x)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in named], pa.array([] if empty else np.concatenate(cell), pa.int64()),
                                                  pa.array([] if empty else np.concatenate(own), pa.float64())], [*named, "cell", "own"])

        points = cut_lineage(points.mapInArrow(assign, f"{types}, cell long, own double"))
        sizes, least, most = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for cell, n, low, high in points.groupBy("cell").agg(F.count(F.lit(1)), F.min("own"), F.max("own")).collect():    # a row per pivot at most
            sizes[cell], least[cell], most[cell] = n, low, high
        first, parts = _dealt(pivots, sizes, min(BLOCK, max(1, math.ceil(self.total / BLOCKS))), metric)
        self.cells = spark.sparkContext.broadcast(Cells(pivots, sizes, least, most, first, parts))
        table = F.broadcast(spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(sizes).tolist()], "cell long, _first long, _parts long"))
        self.points = cut_lineage(points.join(table, "cell").withColumn("block", F.col("_first") + F.pmod(F.xxhash64("p"), F.col("_parts"))).drop("_first", "_parts"))

    def copied(self, points: DataFrame, reach: str, after: bool = False) -> DataFrame:
        """``points`` once per block, their own left out, that may hold a point within ``reach`` (a column), as column ``at``.

        With ``after`` only blocks after a point's own: of two blocks that meet one sends."""
        cells, metric = self.cells, self.metric

        def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known, x = cells.value, coordinates(_matrix(batch.column("p")), metric)
                reaches, own, block = (np.asarray(batch.column(c)) for c in (reach, "own", "block"))
                holds = np.flatnonzero(known.sizes)
                span = np.arange((known.first + known.parts)[holds].max())
                member = (span >= known.first[holds][:, None]) & (span < (known.first + known.parts)[holds][:, None])    # cell x block
                lists = []
                for rows in _chunks(len(x), len(holds)):
                    d = distances(x[rows], known.pivots[holds], metric)
                    near = known.bounds(d, own[rows], holds) <= reaches[rows][:, None]
                    goes = near.astype(np.float32) @ member.astype(np.float32) > 0
                    goes[np.arange(len(d)), block[rows]] = False
                    if after:
                        goes &= span > block[rows][:, None]
                    lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, goes.sum(axis=1).cumsum()], pa.int32()), pa.array(np.nonzero(goes)[1], pa.int64())))
                to = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, to], [*batch.schema.names, "at"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
        return points.mapInArrow(targets, f"{schema}, at array<long>").withColumn("at", F.explode("at"))

    def meet(self, guests: DataFrame, hosts: DataFrame, compare, schema: str) -> DataFrame:
        """``compare(guests, hosts)`` for parts of the points sent to a block and the block's own, as Arrow tables.

        ``compare`` gives the columns besides the keys, and for each row the guest that it belongs to.
        """
        spark, keys = guests.sparkSession, self.keys
        counts = {r["at"]: r["count"] for r in guests.groupBy("at").count().collect()}    # a row per block at most
        table = F.broadcast(spark.createDataFrame([(b, math.ceil(2 * n / BLOCK)) for b, n in counts.items()], "_block long, _come long"))
        left = guests.join(table, F.col("at") == F.col("_block")).withColumn("_s", F.pmod(F.xxhash64("p"), F.col("_come"))).drop("_block", "_come")
        right = hosts.select(*[F.col(c).alias(c) for c in hosts.columns])    # names of its own beside ``guests``
        right = right.join(table, F.col("block") == F.col("_block")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_come") - 1))) \
            .withColumn("at", F.col("block")).drop("_block", "_come")
        by = [*keys, "at", "_s"]

        def both(a: pa.Table, b: pa.Table) -> pa.Table:
            rows, found = compare(a, b) if len(a) and len(b) else (np.zeros(0, np.int64), None)
            if found is None or not len(rows):
                return pa.table({})
            return pa.table({**{k: a[k].take(pa.array(rows)) for k in keys}, **found})

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(both, f"{self.types}{schema}")

    def within(self, points: DataFrame, compare, schema: str) -> DataFrame:
        """``compare(points, points)`` for each block, as in ``meet``."""
        keys = self.keys

        def alone(table: pa.Table) -> pa.Table:
            rows, found = compare(table, table)
            return pa.table({**{k: table[k].take(pa.array(rows)) for k in keys}, **found}) if len(rows) else pa.table({})
        return points.groupBy(*keys, "block").applyInArrow(alone, f"{self.types}{schema}")


def measure(d: np.ndarray, metric: str) -> np.ndarray:
    return d * d / 2 if metric == "cosine" else d


def _ordered(p: np.ndarray) -> np.ndarray:
    """Places of points in the order of their numbers, so that of equal distances the first is the smallest point."""
    return np.lexsort(p.T[::-1])


def _meetings(a: pa.Table, b: pa.Table, known: Cells, metric: str, reach: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(some of ``a``, points of a cell of ``b``, their distances), for cells that may hold a point within ``reach`` of them.

    Near cells come first.  Who reads this may lessen ``reach`` and clear ``open_`` on the way, which saves the rest.
    """
    x, own, y, at = coordinates(_matrix(a["p"]), metric), a["own"].to_numpy(), coordinates(_matrix(b["p"]), metric), b["cell"].to_numpy()
    order = np.argsort(at, kind="stable")
    cells, starts = np.unique(at[order], return_index=True)
    ends = np.r_[starts[1:], len(at)]
    turn = np.argsort(a["cell"].to_numpy(), kind="stable")
    for begin in range(0, len(turn), STEP):
        rows = turn[begin:begin + STEP]
        bound = np.concatenate([known.bounds(distances(x[rows], known.pivots[cells[i]], metric), own[rows], cells[i]) for i in _chunks(len(cells), STEP)], axis=1)
        for c in np.argsort(bound.min(axis=0), kind="stable"):
            near = rows[(bound[:, c] <= reach[rows]) & open_[rows]]
            for there in _chunks(ends[c] - starts[c], 64):
                to = order[starts[c]:ends[c]][there]
                for some in _chunks(len(near), len(to)):
                    here = near[some]
                    here = here[open_[here]]
                    if len(here):
                        yield here, to, distances(x[here], y[to], metric)


def nearest(points: DataFrame, k: int, metric: str = "euclidean", keys: Sequence[str] = ()) -> DataFrame:
    """For each weighted point its k nearest others: ``near`` = sorted [(d, q, m)], ties to the smaller point.

    With a column ``ids``, the sorted first k names of a point's rows, ties go to the point of the first name, and ``near``
    is [(d, first, q, m, ids)].  The own block gives a first k-th distance; only cells that can hold a nearer point are then met.
    """
    space = MetricSpace(points, metric, keys)
    if not space.total:
        return points.withColumn("near", F.array().cast("array<struct<d:double,q:array<double>,m:bigint>>"))
    keys, cells, named = space.keys, space.cells, "ids" in points.columns

    def compare(a: pa.Table, b: pa.Table):
        p, q = _matrix(a["p"]), _matrix(b["p"])
        reach = a["reach"].to_numpy().copy()
        place = np.empty(len(q), np.int64)
        place[np.argsort(pc.list_element(b["ids"], 0).to_numpy(), kind="stable") if named else _ordered(q)] = np.arange(len(q))
        held, parts = 0, []

        def best():
            i, j, d = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            turn = np.lexsort((place[j], d, i))
            i, j, d = i[turn], j[turn], d[turn]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            full = rank == k - 1
            reach[i[full]] = np.minimum(reach[i[full]], d[full] * (1 + SLACK))
            return i[rank < k], j[rank < k], d[rank < k]

        for rows, to, d in _meetings(a, b, cells.value, metric, reach, np.ones(len(p), bool)):
            i, j = np.nonzero(d == 0)
            own = (p[rows[i]] == q[to[j]]).all(axis=1)
            d[i[own], j[own]] = np.inf
            if d.shape[1] >= k and np.isinf(reach[rows]).any():
                reach[rows] = np.minimum(reach[rows], np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + SLACK))
            i, j = np.nonzero((d <= reach[rows][:, None]) & np.isfinite(d))
            parts.append((rows[i], to[j], d[i, j]))
            held += len(i)
            if held > HITS + 2 * k * len(p):
                parts[:] = [best()]
                held = len(parts[0][0])
        at, to, far = best()
        return at, {"s": _lists(p[at]), "own": a["n"].take(pa.array(at)), "d": pa.array(far), "q": _lists(q[to]), "m": b["n"].take(pa.array(to)),
                    **({"ids": b["ids"].take(pa.array(to))} if named else {})}

    schema = "s array<double>, own long, d double, q array<double>, m long" + (f", ids {points.schema['ids'].dataType.simpleString()}" if named else "")
    order = Window.partitionBy(*keys, "s").orderBy("d", *([F.col("ids")[0]] if named else []), "q")

    def best(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))

    first = best(space.within(space.points.withColumn("reach", F.lit(float("inf"))), compare, schema))
    limit = first.where(F.col("r") == k).select(*keys, F.col("s").alias("p"), (F.col("d") * (1 + SLACK)).alias("reach"))
    reached = null_safe_join(space.points, limit, [*keys, "p"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    others = space.meet(space.copied(reached, "reach"), space.points, compare, schema)
    found = best(first.drop("r").unionByName(others))
    d = F.col("d") * F.col("d") / 2 if metric == "cosine" else F.col("d")
    return found.groupBy(*keys, F.col("s").alias("p"), F.col("own").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct(d.alias("d"), *([F.col("ids")[0].alias("first")] if named else []), "q", "m", *(["ids"] if named else [])))).alias("near"))


def _joined(x: np.ndarray, inside, metric: str) -> np.ndarray:
    """Component numbers of points linked when ``inside`` their distance.  A point is met by those not yet reached only."""
    out, rest, found = np.zeros(len(x), np.int64), np.arange(len(x)), -1
    front = rest[:0]
    while len(rest):
        if not len(front):
            found += 1
            front, rest = rest[:1], rest[1:]
            out[front] = found
        now, front = front[:16], front[16:]
        hit = np.zeros(len(rest), bool)
        for part in _chunks(len(rest), len(now)):
            hit[part] = inside(distances(x[now], x[rest[part]], metric)).any(axis=0)
        out[rest[hit]] = found
        front, rest = np.concatenate((front, rest[hit])), rest[~hit]
    return out


def _linked(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, inside, metric: str) -> list[tuple[int, int]]:
    """Links that join the components ``a`` (of points x) and ``b`` (of points y) as all links would; joined ones are not met again."""
    names, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    mine, theirs, root, links = code[:len(a)], code[len(a):], np.arange(len(names)), []
    turn = np.argsort(mine, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(mine[turn]) > 0]) if len(turn) else []
    for begin, end in zip(starts, [*starts[1:], len(turn)]):
        me, at, step = mine[turn[begin]], begin, 16
        rest = np.flatnonzero(root[theirs] != root[me])
        while at < end and len(rest):
            now = turn[at:min(at + step, end)]
            at, step = at + step, 256
            hit = np.zeros(len(rest), bool)
            for part in _chunks(len(rest), len(now)):
                hit[part] = inside(distances(x[now], y[rest[part]], metric)).any(axis=0)
            for other in np.unique(theirs[rest[hit]]):
                if root[other] != root[me]:
                    links.append((int(names[me]), int(names[other])))
                    root[root == root[other]] = root[me]
            if hit.any():
                rest = rest[root[theirs[rest]] != root[me]]
    return links


def density(points: DataFrame, eps: float, least: int, metric: str = "euclidean", keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with ``core`` and ``ball``, border points with the ``ball`` they join, links ``a``, ``b`` of balls).

    A core point has ``least`` rows within ``eps``, itself included; it stops counting there.  The core points of a block that
    links join are a ball; of two blocks those links are formed that join balls not joined yet, so that however dense the
    points are, links are fewer than balls.  A border point joins the ball of its nearest core point.
    """
    space = MetricSpace(points, metric, keys)
    keys, none = space.keys, points.sparkSession.createDataFrame([], "a long, b long")
    if not space.total:
        empty = points.withColumns({"core": F.lit(False), "ball": F.lit(0).cast("long")})
        return empty, empty.select(*keys, "p", "ball"), none
    cells, radius = space.cells, math.sqrt(2 * eps) if metric == "cosine" else float(eps)
    wide, inside = radius * (1 + SLACK), lambda d: measure(d, metric) <= eps

    def count(a: pa.Table, b: pa.Table):
        seen, n, open_ = np.zeros(len(a), np.int64), b["n"].to_numpy(), np.ones(len(a), bool)
        for rows, to, d in _meetings(a, b, cells.value, metric, np.full(len(a), wide), open_):
            seen[rows] += inside(d) @ n[to]
            open_[rows] = seen[rows] < least
        return np.arange(len(a)), {"p": a["p"], "seen": pa.array(seen)}

    def seen(counts: DataFrame) -> DataFrame:
        return counts.groupBy(*keys, "p").agg(F.sum("seen").alias("seen"))
    at_home = cut_lineage(null_safe_join(space.points, seen(space.within(space.points, count, "p array<double>, seen long")), [*keys, "p"], "left"))
    guests = space.copied(at_home.where(F.col("seen") < least).drop("seen").withColumn("reach", F.lit(wide)), "reach")
    abroad = seen(space.meet(guests, space.points, count, "p array<double>, seen long")).withColumnRenamed("seen", "_more")
    marked = null_safe_join(at_home, abroad, [*keys, "p"], "left")
    marked = cut_lineage(marked.withColumn("core", F.col("seen") + F.coalesce("_more", F.lit(0)) >= least).drop("seen", "_more"))

    def cover(table: pa.Table) -> pa.Table:
        ball = _joined(coordinates(_matrix(table["p"]), metric), inside, metric)
        return pa.table({**{k: table[k] for k in [*keys, "p", "n", "cell", "own", "block"]}, "ball": pa.array(ball)})

    kind = f"{space.types}p array<double>, n long, cell long, own double, block long"
    tag = F.xxhash64(*keys) if keys else F.lit(0)
    cores = marked.where("core").groupBy(*keys, "block").applyInArrow(cover, f"{kind}, ball long")
    # numbers of balls: by key, then block and component
    if keys:
        known = cores.select(*keys, "block", "ball").distinct()
        known = cut_lineage(running(known.withColumn("_o", F.struct(tag, *keys, "block", "ball")), [], "_o", {"_ball": F.lit(1)}).drop("_o"))
        cores = null_safe_join(cores, known, [*keys, "block", "ball"], "left").withColumn("ball", F.col("_ball").cast("long")).drop("_ball")
    else:
        cores = cores.withColumn("ball", F.shiftleft("block", 32) + F.col("ball"))
    cores = cut_lineage(cores)

    def link(a: pa.Table, b: pa.Table):
        x, y = (coordinates(_matrix(t["p"]), metric) for t in (a, b))
        links = _linked(x, a["ball"].to_numpy(), y, b["ball"].to_numpy(), inside, metric)
        return np.zeros(len(links), np.int64), {"a": pa.array([i for i, _ in links], pa.int64()), "b": pa.array([j for _, j in links], pa.int64())}

    def border(a: pa.Table, b: pa.Table):
        p, q, ball = _matrix(a["p"]), _matrix(b["p"]), b["ball"].to_numpy()
        place = np.empty(len(q), np.int64)
        place[_ordered(q)] = np.arange(len(q))
        reach, far, to = np.full(len(p), wide), np.full(len(p), np.inf), np.zeros(len(p), np.int64)
        for rows, others, d in _meetings(a, b, cells.value, metric, reach, np.ones(len(p), bool)):
            d = measure(d, metric)
            low = d.min(axis=1)
            j = np.where(d == low[:, None], place[others], len(q)).argmin(axis=1)
            better = (low <= eps) & ((low < far[rows]) | ((low == far[rows]) & (place[others[j]] < place[to[rows]])))
            far[rows[better]], to[rows[better]] = low[better], others[j[better]]
        at = np.flatnonzero(np.isfinite(far))
        return at, {"p": _lists(p[at]), "ball": pa.array(ball[to[at]]), "d": pa.array(far[at]), "q": _lists(q[to[at]])}

    reach = lambda rows: rows.withColumn("reach", F.lit(wide))
    edges = space.meet(space.copied(reach(cores), "reach", after=True), cores, link, "a long, b long").select("a", "b").distinct()
    rest = reach(marked.where("NOT core").drop("core"))
    everywhere = space.copied(rest, "reach").unionByName(rest.withColumn("at", F.col("block")))
    joins = space.meet(everywhere, cores, border, "p array<double>, ball long, d double, q array<double>")
    joins = joins.groupBy(*keys, "p").agg(F.min_by("ball", F.struct("d", "q")).alias("ball"))
    out = null_safe_join(marked.select(*keys, "p", "n", "core"), cores.select(*keys, "p", "ball"), [*keys, "p"], "left")
    return cut_lineage(out), joins, edges
