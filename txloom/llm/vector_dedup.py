"""Embedding near-duplicates by PCA-ordered tiled comparison (operator 2).

Equal vectors are one class with a weight. Unit vectors are rotated to their principal
axes, so leading coordinates carry most of a product. Leaves of a tree over the leading
axes, cut into tiles of bounded size, hold like vectors; vectors within the threshold are
at most sqrt(2 - 2 cosine) apart in any of their coordinates together, so two leaves whose
boxes are farther apart never meet. The tiles of all other leaves meet in pairs and are
compared in blocks: the products over the leading axes, plus the product of the norms
of what remains, bound the cosine from above (one matrix product, as the norm is carried
as one more coordinate). Pairs under the bound stop there; the others add the next axes
and are bounded again, then get the rest. A tile pair gives link counts and the spanning
links of its rows, never all its pairs.

A row travels once for each tile that it meets. Where leaves don't part (vectors evenly
in all directions) that is every tile, and the work is quadratic in the distinct vectors.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite
component link with nothing; vectors of different lengths don't link; every row is a
vector of its own, also under a repeated or null ``vec_id``; null ids come after all
others: a component of null ids only has a null ``component_id``; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .workspace import Workspace

THRESHOLD = 0.9
#: Rows of a tile at most, and numbers in it, half as many again where a leaf is cut; a large tile saves copies of rows.
TILE, TILE_VALUES = 32768, 1 << 21
#: Few vectors are dealt to about so many tiles, so that several tasks share the work.
TILES = 8
BLOCK = 1024
STEPS = (16, 32)
SLACK = 1e-9
#: Most leaves for each length: pairs of leaves are looked at on the driver.
LEAVES = 256
#: Vectors that the cuts of the tree are read off; they decide where tiles part, not what is found.
SAMPLE = 20_000
#: Longer vectors are compared unrotated; any axes give right bounds.
MOST_AXES = 4096


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v, one, two) for each row; v is null where it can't link, one and two are 128 bits of hash of it."""
    kind = "array<float>" if dict(df.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(whole, v).alias("v"))
    hashes = {"one": F.xxhash64("v"), "two": F.xxhash64(F.lit(2), "v")}
    return rows.withColumns({k: F.when(F.col("v").isNotNull(), h) for k, h in hashes.items()})


def _rows(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        lengths = np.asarray(b.column(b.schema.get_field_index("d")))
        for d in np.unique(lengths).tolist():
            x = unit(_rows(b.column(b.schema.get_field_index("v")).filter(pa.array(lengths == d))))
            total[d] = x.T @ x + total.get(d, 0)
    yield _by_length(total)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[d] = np.frombuffer(m) + total.get(d, 0)
    yield _by_length(total)


def _by_length(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["d", "m"])


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length axes as columns, largest share first; from the second moments of all rows, a small matrix for each task."""
    partial = rows.mapInArrow(_moments, "d int, m binary")
    total: dict[int, np.ndarray] = {}
    for r in partial.repartition(8).mapInArrow(_added, "d int, m binary").collect():
        total[r["d"]] = np.frombuffer(r["m"]) + total.get(r["d"], 0)
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in total.items()}


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the components of ``a`` and ``b``; ``label`` holds each row's head, the least row of its component.

    Only heads are hooked, so all members of both sides follow; a head hooked to
    several others keeps the least, and the links to the rest are seen again.
    """
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            return label
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not (label[label] == label).all():
            label = label[label]


def block_links(q: np.ndarray, rest: dict[int, np.ndarray], x: np.ndarray, r: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i in r, j in c) with cosine at or over the threshold; q is rotated, x is as given."""
    d = q.shape[1]
    first = min(STEPS[0], d)
    lead = np.hstack([q[r, :first], rest[first][r, None]]) @ np.hstack([q[c, :first], rest[first][c, None]]).T
    i, j = np.nonzero(lead >= threshold - SLACK)
    i, j = r[i], c[j]
    if len(i) > 0.1 * lead.size:  # a block of like vectors: one matrix product
        exact = x[r] @ x[c].T
        i, j = np.nonzero(exact >= threshold - SLACK)
        near, i, j = exact[i, j], r[i], c[j]
    else:
        near = np.empty(len(i))
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            live, value, done = np.arange(len(a)), np.zeros(len(a)), 0
            for stop in sorted({first, *(s for s in STEPS if s < d), d}):
                p, s = a[live], b[live]
                value = value + np.einsum("ij,ij->i", q[p, done:stop], q[s, done:stop])
                ok = value + rest[stop][p] * rest[stop][s] >= threshold - SLACK
                live, value, done = live[ok], value[ok], stop
            near[at + live], keep[at + live] = value, True
        i, j, near = i[keep], j[keep], near[keep]
    edge = np.abs(near - threshold) <= 2 * SLACK
    if edge.any():  # decided on the vectors as they were given
        near[edge] = np.einsum("ij,ij->i", x[i[edge]], x[j[edge]])
    ok = near >= threshold
    return i[ok], j[ok]


def tile_rows(d: int, n: int) -> int:
    """About as many of ``n`` vectors of length ``d`` make a tile."""
    return max(min(1024, TILE), min(TILE, TILE_VALUES // d, n // TILES))


class Tree:
    """Median cuts along leading axes."""

    def __init__(self, q: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, low side, high side; a side under 0 is leaf -1 - side
        self.leaves = 0
        self.root = self._grown(q, leaves)

    def _grown(self, q: np.ndarray, leaves: int) -> int:
        spread = q.max(axis=0) - q.min(axis=0) if len(q) else np.zeros(1)
        axis = int(spread.argmax())
        if leaves > 1 and spread[axis] > 0:
            cut = float(np.median(q[:, axis]))
            low = q[:, axis] < cut
            if low.any() and not low.all():
                self.nodes.append((axis, cut, 0, 0))
                k = len(self.nodes) - 1
                self.nodes[k] = (axis, cut, self._grown(q[low], (leaves + 1) // 2), self._grown(q[~low], leaves // 2))
                return k
        self.leaves += 1
        return -self.leaves

    def leaf(self, q: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(q), np.int32), [(self.root, np.arange(len(q)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                out[rows] = -1 - k
            elif len(rows):
                axis, cut, low, high = self.nodes[k]
                on = q[rows, axis] < cut
                todo += [(low, rows[on]), (high, rows[~on])]
        return out


def _leading(axes: dict[int, np.ndarray], x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    first = min(STEPS[0], d)
    return x @ axes[d][:, :first] if d in axes else x[:, :first]


def _projected(axes: dict[int, np.ndarray]):
    """(d, lead) of vectors: their leading coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(0))
            for d in np.unique(lengths).tolist():
                q = _leading(axes, unit(_rows(b.column(1).filter(pa.array(lengths == d)))))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(q), pa.int32()), pa.array(q.tolist(), pa.list_(pa.float64()))], names=["d", "lead"])

    return run


def _placed(axes: dict[int, np.ndarray], trees: dict[int, Tree]):
    """Adds the leading coordinates and the leaf to (cls, m, d, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(b.column(2))
            for d in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == d))
                q = _leading(axes, unit(_rows(part.column(3))))
                leaf = trees[d].leaf(q) if d in trees else np.zeros(len(q), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf), pa.array(q.tolist(), pa.list_(pa.float64()))], names=[*part.schema.names, "leaf", "lead"])

    return run


def near_leaves(low: np.ndarray, high: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each box (rows of least and largest coordinates) the boxes near enough for a link, itself included."""
    limit = 2 - 2 * threshold + SLACK
    return [np.flatnonzero((np.maximum(0, np.maximum(low - high[k], low[k] - high)) ** 2).sum(axis=1) <= limit) for k in range(len(low))]


def layout(placed: DataFrame, threshold: float) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(d, leaf, tiles, [(near leaf, its tiles)]): at most LEAVES rows for each length of several tiles, one for any other."""
    sizes = {(r["d"], r["leaf"]): r["n"] for r in placed.groupBy("d", "leaf").agg(F.count("*").alias("n")).collect()}
    total = Counter()
    for (d, _), n in sizes.items():
        total[d] += n
    tiles = {(d, leaf): max(1, round(n / tile_rows(d, total[d]))) for (d, leaf), n in sizes.items()}
    several = sorted({d for d, _ in sizes if sum(x == d for x, _ in sizes) > 1})
    boxes: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
    if several:
        sides = placed.where(F.col("d").isin(several)).select("d", "leaf", F.posexplode("lead").alias("axis", "x"))
        for r in sides.groupBy("d", "leaf", "axis").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
            boxes.setdefault((r["d"], r["leaf"]), {})[r["axis"]] = (r["lo"], r["hi"])
    out = [(d, leaf, n, [(leaf, n)]) for (d, leaf), n in tiles.items() if d not in several]
    for d in several:
        leaves = sorted(leaf for x, leaf in sizes if x == d)
        sides = np.array([[boxes[d, leaf][k] for k in sorted(boxes[d, leaf])] for leaf in leaves])
        for k, others in enumerate(near_leaves(sides[:, :, 0], sides[:, :, 1], threshold)):
            out.append((d, leaves[k], tiles[d, leaves[k]], [(leaves[j], tiles[d, leaves[j]]) for j in others.tolist()]))
    return out


def _tile_pair(axes: dict[int, np.ndarray], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("cls"))
        if not len(ids):
            return pa.table({"cls": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "head": pa.array([], pa.int64())})
        tile, x, m = np.asarray(table.column("tile")), unit(_rows(table.column("v"))), np.asarray(table.column("m"))
        q = x @ axes[x.shape[1]] if x.shape[1] in axes else x
        tails = np.sqrt(np.maximum(0, np.cumsum((q**2)[:, ::-1], axis=1)[:, ::-1]))
        rest = {s: tails[:, s] if s < q.shape[1] else np.zeros(len(q)) for s in {*STEPS, min(STEPS[0], q.shape[1]), q.shape[1]} if s <= q.shape[1]}
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        low, high, same = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi), lo == hi
        count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p in range(0, len(low), BLOCK):
            for s in range(p if same else 0, len(high), BLOCK):
                i, j = block_links(q, rest, x, low[p : p + BLOCK], high[s : s + BLOCK], threshold)
                if same and p == s:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    # weights are whole numbers, exact in doubles
                    count += (np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))).astype(np.int64)
                    label = _merge(label, i, j)
        on = count > 0
        return pa.table({"cls": pa.array(ids[on]), "links": pa.array(count[on]), "head": pa.array(ids[label[on]])})

    return run


def near_vectors(df: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``df`` (vec_id, embedding)."""
    rows = usable(df)
    equal = rows.where("v is not null").groupBy("one", "two").agg(F.first("v").alias("v"), F.min("vec_id").alias("least"), F.count("*").alias("m"))
    # the number of a class is made once, when the table is written
    classes = ws.save(equal.withColumns({"cls": F.monotonically_increasing_id(), "d": F.size("v")}), "classes")
    counts = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row for each length
    spark = df.sparkSession
    turned = [d for d, n in counts.items() if d < n and d <= MOST_AXES]
    axes = principal_axes(classes.where(F.col("d").isin(turned)).select("d", "v")) if turned else {}
    trees = {}
    for d, n in counts.items():
        if n > tile_rows(d, n):
            some = classes.where(F.col("d") == d).sample(min(1.0, SAMPLE / n), seed=2).limit(2 * SAMPLE).select("d", "v")
            lead = some.mapInArrow(_projected(axes), "d int, lead array<double>").select("lead").toPandas().lead  # at most 2 * SAMPLE rows
            trees[d] = Tree(np.array(lead.tolist()).reshape(len(lead), -1), min(LEAVES, -(-n // tile_rows(d, n))))
    vectors = dict(classes.dtypes)["v"]
    placed = ws.save(classes.select("cls", "m", "d", "v").mapInArrow(_placed(axes, trees), f"cls long, m long, d int, v {vectors}, leaf int, lead array<double>"), "placed")
    plan = spark.createDataFrame(layout(placed, threshold), "d int, leaf int, tiles int, near array<struct<leaf: int, tiles: int>>")
    number = lambda leaf, tile: F.shiftleft(leaf.cast("long"), 32) + tile
    met = placed.drop("lead").join(F.broadcast(plan), ["d", "leaf"]).withColumn("tile", number(F.col("leaf"), F.pmod(F.xxhash64("cls"), F.col("tiles"))))
    met = met.select("cls", "m", "d", "v", "tile", F.explode("near").alias("o")).select("cls", "m", "d", "v", "tile", "o.leaf", F.explode(F.sequence(F.lit(0), F.col("o.tiles") - 1)).alias("other"))
    met = met.withColumn("other", number(F.col("leaf"), F.col("other"))).select("cls", "m", "d", "v", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    found = ws.save(met.groupBy("d", "lo", "hi").applyInArrow(_tile_pair(axes, threshold), "cls long, links long, head long"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    heads = components(found.select(F.col("cls").alias("a"), F.col("head").alias("b")), ws).withColumnRenamed("id", "cls")
    named = classes.select("cls", "one", "two", "least", "m").join(links, "cls", "left").join(heads, "cls", "left")
    named = ws.save(named.select("one", "two", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # written first, so that a hot vector's join has plain exchanges, which adaptive execution splits
    result = ws.save(named.join(least, "component").select("one", "two", "n_links", "component_id"), "result")
    out = rows.select("vec_id", "one", "two").join(result, ["one", "two"], "left")
    component = F.when(F.col("one").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
