"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. The vectors are rotated by a fixed random
rotation and split into blocks. If a pair is within the whole squared-distance budget, it is
within a proportional part of it in at least one block, so a range join in each block finds
every pair. Pairs found are verified exactly with the cosine in double precision, and a pair
counts in the first block in which it is near, so nothing has to be made distinct. Single
precision only finds candidates: which block is the first is decided in double precision from
the stored rotated vectors, so that all tasks that meet a pair decide alike.

The range join of a block sorts the vectors by the block's first coordinate into tiles of
equal size; two tiles meet if their ranges are no further apart than the block's radius.
Tiles are cut by rank, so groups of near-equal vectors, however large, spread over tiles;
vectors that are exactly equal are joined once and counted with their number. A task holds
a run of neighbouring tiles (a ``BANDS``-th of all, ``WIDE`` tiles at most) and reads the later tiles that
meet one of them in pieces of a tile, so that a vector is copied about ``BANDS`` / 2 times and not once for every
tile. It gives, per vector and piece, the number of its links and one edge to the component that it has there.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows
with a null id, link with nothing; vectors of different lengths link only within their
length; rows of the same id are one node; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.components import components
from notewell.llm.tables import bounded_batches, settle

COSINE = 0.95
BLOCKS = 4
TILE_ROWS = 8192
BANDS, WIDE = 16, 8  # runs of tiles that a block is cut into, and the most tiles of a run
STRIP = 256  # rows of a run that are compared with a tile at once
SLACK = 1e-5  # on a block's squared distance, so that a pair within the budget is near in some block


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def block_edges(n: int, blocks: int) -> list[tuple[int, int]]:
    cut = [round(k * n / blocks) for k in range(blocks + 1)]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def prepared(vectors: DataFrame, blocks: int) -> DataFrame:
    """Distinct usable vectors: ``rep`` (smallest id), ``copies``, ``size``, ``vector`` (doubles as given), the leading coordinate of each block and ``turned`` (unit length, rotated)."""

    def run(batches):
        for batch in batches:
            lead, turned = [None] * len(batch), np.empty(len(batch.column(1).flatten()))
            border = np.asarray(batch.column(1).offsets)
            values, size = batch.column(1).flatten().to_numpy(), np.diff(border)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                places = (border[rows] - border[0])[:, None] + np.arange(n)
                x = values[places]
                turned[places] = x = rotated(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                for row, values_of in zip(rows, x[:, [a for a, _ in block_edges(n, blocks)]].tolist(), strict=True):
                    lead[row] = values_of
            turned = pa.ListArray.from_arrays(pa.array(border - border[0], pa.int32()), pa.array(turned))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.list_(pa.float64())), turned], ["rep", "vector", "copies", "lead", "turned"])

    flat = vectors.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"))
    return flat.select("rep", "vector", "copies").mapInArrow(run, "rep long, vector array<double>, copies long, lead array<double>, turned array<double>")


_rotations: dict[int, np.ndarray] = {}


def rotated(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    if n not in _rotations:
        _rotations[n] = rotation(n)
    return x @ _rotations[n]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that can link; minus zero becomes zero, so equal vectors are equal."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def block_distances(y: np.ndarray, a: np.ndarray, b: np.ndarray, edge: tuple[int, int]) -> np.ndarray:
    """Squared distances of the pairs within a block: the same number whichever side and place the two rows have."""
    out = np.zeros(len(a))
    for j in range(*edge):
        step = y[a, j] - y[b, j]
        out += step * step
    return out


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Bring the components of linked positions together: ``label`` leads each position to the first of its component."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _join(blocks: int, cosine: float):
    """Per (block, run) group of rows that arrive sorted by it, the run's own rows first: (rep, links, rep of its component), for the run and for each piece of later rows."""
    budget = 2 - 2 * cosine

    def solve(block: int, rep: np.ndarray, copies: np.ndarray, later: np.ndarray, x: np.ndarray, turned: np.ndarray):
        norm = np.sqrt((x * x).sum(axis=1))
        y = turned.astype(np.float32)
        edges = block_edges(x.shape[1], blocks)
        near = [budget * (b - a) / x.shape[1] + SLACK for a, b in edges]
        error = [4e-7 * (b - a + 3) for a, b in edges]  # bound for squared distances of parts of unit vectors in single precision
        one = np.ones((len(x), 1), np.float32)
        forth, back = [], []  # their products are squared distances
        for a, b in edges[: block + 1]:
            part = y[:, a:b]
            square = (part * part).sum(axis=1, keepdims=True)
            forth.append(np.hstack((-2 * part, square, one)))
            back.append(np.hstack((part, one, square)))
        left, right = np.flatnonzero(later == 0), np.flatnonzero(later)
        alone = not len(right)
        right = left if alone else right
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        over = [np.ascontiguousarray(b[right].T) for b in back]
        strip = max(8, STRIP * TILE_ROWS // max(len(right), TILE_ROWS))
        for at in range(0, len(left), strip):
            i = left[at : at + strip]
            found = forth[block][i] @ over[block] <= near[block] + error[block]
            if alone:
                found &= np.arange(len(right))[None, :] > np.arange(at, at + len(i))[:, None]
            some = np.flatnonzero(found.any(axis=1))
            if not len(some):
                continue
            i, found = i[some], found[some]
            for k in range(block):  # an earlier block has this pair for certain
                found &= forth[k][i] @ over[k] > near[k] - error[k]
            p, q = np.nonzero(found)
            for lo in range(0, len(p), 65536):
                a, b = i[p[lo : lo + 65536]], right[q[lo : lo + 65536]]
                good = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
                a, b = a[good], b[good]
                mine = block_distances(turned, a, b, edges[block]) <= near[block]
                for k in range(block):
                    mine &= block_distances(turned, a, b, edges[k]) > near[k]
                a, b = a[mine], b[mine]
                links += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
                unite(label, a, b)
        hit = np.flatnonzero(links)
        return rep[hit], links[hit], rep[label[hit]]

    def run(batches):
        key, own, held, size = None, None, [], 0

        def out(found):
            columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "with"])

        def close():
            """The rows held: those of the run among themselves, later ones against the run."""
            nonlocal own, held, size
            rows = [np.concatenate([h[k] for h in held]) for k in range(5)]
            held, size = [], 0
            if rows[2][0]:
                return solve(key[0], *(np.concatenate((mine, more)) for mine, more in zip(own, rows, strict=True)))
            own = rows
            return solve(key[0], *rows)

        for batch in batches:
            found = []
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(4)])
            at = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(batch)])) if len(batch) else [0]
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if tuple(keys[lo]) != key:
                    if held:
                        found.append(close())
                    key = tuple(keys[lo])
                elif key[3] and size >= TILE_ROWS:
                    found.append(close())
                values = (batch.column(k).slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, key[1]) for k in (6, 7))
                held.append((*(batch.column(k).to_numpy()[lo:hi] for k in (4, 5)), keys[lo:hi, 3], *values))
                size += hi - lo
            yield out(found)
        if held:
            yield out([close()])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors`` (``vec_id``, ``embedding``)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    good = usable(vectors)
    points = settle(prepared(good, blocks), "vectors")
    leads = points.select("rep", F.size("vector").alias("size"), F.posexplode("lead").alias("block", "lead"))
    # ranks by block: the borders are approximate, the tiles between them are exact
    counts = leads.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("n") / tile_rows)).cast("int"))
    most = shares.agg(F.max("tiles")).first()[0] or 1
    grid = [k / most for k in range(1, most)] or [0.5]
    borders = leads.groupBy("size", "block").agg(F.percentile_approx("lead", grid, 10 * most + 1000).alias("borders"))
    tile = F.size(F.filter("borders", lambda b: b < F.col("lead"))).alias("tile") if most > 1 else F.lit(0).alias("tile")
    placed = settle(leads.join(F.broadcast(borders), ["size", "block"]).select("rep", "size", "block", "lead", tile), "tiles")
    ranges = placed.groupBy("size", "block", "tile").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    other = ranges.select("size", "block", F.col("tile").alias("with"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    radius = F.sqrt((2 - 2 * cosine) * F.ceil(F.col("size") / blocks) / F.col("size") + SLACK) + 1e-3
    meet = ranges.join(other, ["size", "block"]).where((F.col("lo2") <= F.col("hi") + radius) & (F.col("lo") <= F.col("hi2") + radius)).select("size", "block", "tile", "with")
    wide = min(WIDE, -(-most // BANDS))
    run, run_of_other = (F.floor(F.col(c) / wide).cast("int") for c in ("tile", "with"))
    own = ranges.select("size", "block", "tile", run.alias("run"), F.lit(0).alias("later"))
    later = meet.where(run < run_of_other).select("size", "block", F.col("with").alias("tile"), run.alias("run"), F.lit(1).alias("later")).distinct()
    keyed = placed.join(F.broadcast(own.unionByName(later)), ["size", "block", "tile"]).select("size", "block", "run", "later", "rep")
    loaded = keyed.join(points.select("rep", "copies", "vector", "turned"), "rep").select("block", "size", "run", "later", "rep", "copies", "vector", "turned")
    order = ["block", "size", "run"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = settle(loaded.repartition(parts, *order).sortWithinPartitions(*order, "later", "rep").mapInArrow(_join(blocks, cosine), "rep long, links long, with long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    first = components(found.select(F.col("rep").alias("a"), F.col("with").alias("b")))

    named = points.select("rep", "vector", "copies").join(links, "rep", "left").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    mine = good.join(named, "vector").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(mine, "vec_id", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
