"""Nearest neighbours and radius queries, exact.

Radius queries go by a grid whose cells are as wide as the radius: a block of rows of a cell meets only the 3^d cells around it.  k-nearest queries take the points in blocks of neighbouring points (leaves of a k-d tree over a bounded sample, cut
further by a hash where a leaf holds many).  A block of queries first meets one block of points of its own leaf, which
bounds how far its neighbours can be; then only blocks whose bounding boxes reach that near.  The k best of all blocks
are merged; no task holds more than two blocks.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import groups
from ..core.col import INF, dbl, finite, ieee_div, total
from ..functions.ts import leaves

#: Rows of a block; leaves of the tree and points of the sample that it is made from, at most.
BLOCK, LEAVES, SAMPLED = 4096, 1024, 20_000
#: Pairs of a radius query that are looked at together.
PAIRS = 1 << 20


def distance(features: list, point: list[float], dist: str = "sql2") -> Column:
    d = [dbl(f) - float(v) for f, v in zip(features, point)]
    if dist in ("l2", "sql2"):
        s = total(x * x for x in d)
        return F.sqrt(s) if dist == "l2" else s
    if dist == "l1":
        return total(F.abs(x) for x in d)
    if dist == "inf":
        return F.greatest(*(F.abs(x) for x in d)) if len(d) > 1 else F.abs(d[0])
    if dist == "cosine":
        n = math.sqrt(sum(v * v for v in point))
        return 1 - ieee_div(total(dbl(f) * float(v) for f, v in zip(features, point)), F.sqrt(total(dbl(f) * dbl(f) for f in features)) * n)
    if dist in ("h", "haversine"):
        from ..functions.num import haversine

        return haversine(features[0], features[1], F.lit(float(point[0])), F.lit(float(point[1])))
    raise ValueError(dist)


def within_dist_from(*features, pt: list[float], r: float, dist: str = "sql2") -> Column:
    return distance(list(features), pt, dist) <= r


def is_knn_from(df: DataFrame, *features, pt: list[float], k: int, dist: str = "sql2", name: str = "is_knn") -> DataFrame:
    """The frame with a flag for the k rows nearest to the point; ties with the k-th are kept."""
    d = df.withColumn("d_", distance(list(features), pt, dist))
    kth = d.filter("d_ IS NOT NULL").orderBy("d_").limit(k).agg(F.max("d_").alias("k_"))
    return d.crossJoin(F.broadcast(kth)).withColumn(name, F.coalesce(F.col("d_") <= F.col("k_"), F.lit(False))).drop("d_", "k_")  # one row


def _np_dist(a: np.ndarray, b: np.ndarray, dist: str) -> np.ndarray:
    if dist in ("l2", "sql2"):
        d = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            d += (a[:, j, None] - b[None, :, j]) ** 2
        return np.sqrt(d) if dist == "l2" else d
    if dist == "l1":
        return sum(np.abs(a[:, j, None] - b[None, :, j]) for j in range(a.shape[1]))
    if dist == "inf":
        d = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            np.maximum(d, np.abs(a[:, j, None] - b[None, :, j]), out=d)
        return d
    raise ValueError(dist)


def _vectors(df: DataFrame, features: tuple, index: str, mask: Column | None, extra: list[str]) -> DataFrame:
    v = F.array(*(dbl(f) for f in features)) if not (len(features) == 1 and df.select(features[0] if isinstance(features[0], Column) else F.col(features[0])).schema[0].dataType.typeName() == "array") else F.col(features[0]).cast("array<double>")
    d = df.filter(mask) if mask is not None else df
    ok = ~F.exists("v_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == INF))
    return d.select(F.col(index).alias("id_"), v.alias("v_"), *extra).filter(ok)


def _top(df: DataFrame, features: tuple, index: str, k: int, dist: str, eval_mask=None, data_mask=None, max_bound: float = 99999.0, extra: list[str] | None = None, min_bound: float = -INF) -> DataFrame:
    """(id_, nn_, d_, rank_): each query's k nearest points of those from min_bound to max_bound away, ties by id."""
    extra = extra or []
    q, p = _vectors(df, features, index, eval_mask, []), _vectors(df, features, index, data_mask, extra)
    n_q, n_p = (max(1, math.ceil(x.count() / BLOCK)) for x in (q, p))
    id_type = df.schema[index].dataType.simpleString()
    kind = f"id_ {id_type}, nn_ {id_type}, d_ double" + "".join(f", `{e}` {df.schema[e].dataType.simpleString()}" for e in extra)

    def nearest(qs, ps):
        """For parts of the queries: their ids, and in order the places and distances of their nearest points; and the points."""
        a, b = np.array([list(r["v_"]) for r in qs], float), np.array([list(r["v_"]) for r in ps], float)
        ids, pid = np.array([r["id_"] for r in qs]), np.array([r["id_"] for r in ps])
        order = np.argsort(pid, kind="stable")
        b = b[order]
        for i in range(0, len(a), 512):
            d = _np_dist(a[i : i + 512], b, dist)
            d[d < min_bound] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, d.shape[1])]
            yield ids[i : i + 512], order[near], np.take_along_axis(d, near, 1), pid

    def run(batches):
        for pdf in batches:
            for qs, ps in zip(pdf["q_"], pdf["p_"]):
                cols = {e: np.array([r[e] for r in ps]) for e in extra}
                for ids, near, d, pid in nearest(qs, ps):
                    ok = ((d <= max_bound) & (d < np.inf)).ravel()
                    yield pd.DataFrame({"id_": np.repeat(ids, d.shape[1])[ok], "nn_": pid[near].ravel()[ok], "d_": d.ravel()[ok], **{e: c[near].ravel()[ok] for e, c in cols.items()}})

    def reach(batches):
        for pdf in batches:
            far = [max((float(d[:, -1].max()) if d.shape[1] == k else math.inf) for _, _, d, _ in nearest(qs, ps)) for qs, ps in zip(pdf["q_"], pdf["p_"])]
            yield pd.DataFrame({"bq_": pdf["bq_"], "far_": far})

    if n_q * n_p == 1:
        pairs = _blocks(q, F.lit(0), 1, "q_").crossJoin(_blocks(p, F.lit(0), 1, "p_"))  # a row each
    else:
        leaf, leaves = _tree(p, n_p)
        bq, bp = _blocks(q, leaf, math.ceil(n_q / leaves), "q_"), _blocks(p, leaf, math.ceil(n_p / leaves), "p_")
        some = bq.join(bp.filter("part_p_ = 0"), bq["leaf_q_"] == bp["leaf_p_"]).select("bq_", "q_", "p_")
        far = some.repartition(n_q).mapInPandas(reach, "bq_ string, far_ double")
        boxes_q = bq.select("bq_", "lo_q_", "hi_q_").join(far, "bq_", "left").withColumn("far_", F.least(F.coalesce("far_", F.lit(INF)), F.lit(float(max_bound))))
        # boxes only, no points: which blocks come near enough
        near = boxes_q.crossJoin(bp.select("bp_", "lo_p_", "hi_p_")).filter(_least_distance(dist) <= F.col("far_")).select("bq_", "bp_")
        pairs = near.join(bq.select("bq_", "q_"), "bq_").join(bp.select("bp_", "p_"), "bp_")
    found = pairs.select("q_", "p_").repartition(max(n_q, n_p)).mapInPandas(run, kind)
    w = Window.partitionBy("id_").orderBy("d_", "nn_")
    return found.withColumn("rank_", F.row_number().over(w)).filter(F.col("rank_") <= k)


def _tree(points: DataFrame, n: int) -> tuple[Column, int]:
    """The leaf of a vector ``v_`` in a k-d tree whose leaves hold about as many points each, and the number of leaves."""
    rows = points.select("id_", "v_").orderBy(F.xxhash64("id_"), "id_").limit(SAMPLED).collect()
    x = np.array([r.v_ for r in rows], float)
    depth = min(math.ceil(math.log2(max(n, 1))), int(math.log2(LEAVES)), int(math.log2(max(len(x), 1))))
    count = itertools.count()

    def leaf(x: np.ndarray, left: int) -> Column:
        wide = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        j = int(np.argmax(wide))
        if not left or not wide[j] > 0:
            return F.lit(next(count))
        cut = float(np.median(x[:, j]))
        cut = cut if (x[:, j] < cut).any() else float(x[:, j][x[:, j] > cut].min())
        below = x[:, j] < cut
        return F.when(F.get("v_", F.lit(j)) < cut, leaf(x[below], left - 1)).otherwise(leaf(x[~below], left - 1))

    e = leaf(x, depth)
    return e, max(next(count), 1)


def _blocks(x: DataFrame, leaf: Column, parts: int, tag: str) -> DataFrame:
    """A row a block: its name, leaf and number in it, its rows, and the least and greatest value in each dimension."""
    name = f"b{tag}"
    first = x.select(F.size("v_").alias("n")).first()
    d = first.n if first else 0
    e = lambda f: F.array(*(f(F.get("v_", F.lit(j))) for j in range(d)))
    cut = x.withColumns({f"leaf_{tag}": leaf, f"part_{tag}": F.pmod(F.xxhash64("id_"), F.lit(parts)).cast("int")})
    out = cut.groupBy(f"leaf_{tag}", f"part_{tag}").agg(F.collect_list(F.struct(*x.columns)).alias(tag), e(F.min).alias(f"lo_{tag}"), e(F.max).alias(f"hi_{tag}"))
    return out.withColumn(name, F.concat_ws("-", f"leaf_{tag}", f"part_{tag}"))


def _least_distance(dist: str) -> Column:
    """No pair of points of two boxes is nearer than this."""
    if dist not in ("l1", "l2", "sql2", "inf"):
        return F.lit(-INF)
    gaps = F.transform(F.arrays_zip("lo_q_", "hi_q_", "lo_p_", "hi_p_"), lambda b: F.greatest(b["lo_p_"] - b["hi_q_"], b["lo_q_"] - b["hi_p_"], F.lit(0.0)))
    if dist == "inf":
        return F.array_max(gaps) * (1 - 1e-9)
    s = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + (g if dist == "l1" else g * g))
    return (F.sqrt(s) if dist == "l2" else s) * (1 - 1e-9)


def query_knn_ptwise(df: DataFrame, *features, index: str, k: int, dist: str = "sql2", return_dist: bool = False, eval_mask: Column | None = None, data_mask: Column | None = None, max_bound: float = 99999.0) -> DataFrame:
    """(index, neighbours): ids of the k + 1 nearest points, itself among them, nearest first; with ``return_dist`` (id, dist) pairs."""
    t = _top(df, features, index, k + 1, dist, eval_mask, data_mask, max_bound)
    x = F.array_sort(F.collect_list(F.struct("rank_", F.col("nn_").alias("id"), F.col("d_").alias("dist"))))
    out = F.transform(x, lambda s: F.struct(s["id"].alias("id"), s["dist"].alias("dist"))) if return_dist else F.transform(x, lambda s: s["id"])
    return t.groupBy(F.col("id_").alias(index)).agg(out.alias("neighbours"))


def query_dist_from_kth_nb(df: DataFrame, *features, index: str, k: int, dist: str = "sql2", max_bound: float = 99999.0) -> DataFrame:
    return _top(df, features, index, k + 1, dist, max_bound=max_bound).filter(F.col("rank_") == k + 1).select(F.col("id_").alias(index), F.col("d_").alias("dist"))


def query_knn_freq_cnt(df: DataFrame, *features, index: str, k: int, **options) -> DataFrame:
    t = _top(df, features, index, k + 1, options.pop("dist", "sql2"), **options)
    return t.groupBy(F.col("nn_").alias(index)).agg(F.count(F.lit(1)).alias("count"))


def query_knn_avg(df: DataFrame, *features, index: str, target: str, k: int, dist: str = "sql2", weighted: bool = False, min_bound: float = 1e-9, max_bound: float = 99999.0) -> DataFrame:
    """Mean target of the k nearest points that are min_bound away at least and have a target."""
    p = df.withColumn("target_", dbl(target))
    t = _top(p, features, index, k, dist, None, F.col("target_").isNotNull(), max_bound, ["target_"], min_bound)
    w = ieee_div(1.0, "d_") if weighted else F.lit(1.0)
    return t.groupBy(F.col("id_").alias(index)).agg((F.sum(w * F.col("target_")) / F.sum(w)).alias("value"))


def libm_square(x: np.ndarray) -> np.ndarray:
    """x ** 2 as the C library's pow rounds it, which SQL engines call: now and then it is a bit off x * x, which orders near ties."""
    p = x * x
    c = 134217729.0 * x
    hi = c - (c - x)
    lo = x - hi
    rest = ((hi * hi - p) + 2 * hi * lo) + lo * lo
    # pow is within 0.54 units of the last place: only where the exact square lies that near the middle can the two differ
    open_ = np.flatnonzero(np.abs(rest) > 0.45 * np.spacing(p))
    p[open_] = [math.pow(v, 2.0) for v in x[open_].tolist()]
    return p


def _near(q: np.ndarray, p: np.ndarray, r: np.ndarray, dist: str, sure: bool):
    """For parts of the queries: the first one, how many, those surely within their r (counted, if ``sure``), and (queries, points, distances) of the other pairs within r."""
    step = max(1, PAIRS // max(len(p), 1))
    for i in range(0, len(q), step):
        a, reach = q[i : i + step], r[i : i + step, None]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = _np_dist(a, p, dist)
            slack = np.abs(reach) * 1e-12
            maybe = rough <= reach + slack
            counted = np.zeros(len(a), np.int64)
            if sure:
                inside = rough < reach - slack
                counted = np.count_nonzero(inside, axis=1)
                maybe &= ~inside
            at, nn = np.nonzero(maybe)
            if dist in ("l2", "sql2"):
                d = sum(libm_square(a[at, j] - p[nn, j]) for j in range(q.shape[1]))
                d = np.sqrt(d) if dist == "l2" else d
            else:
                d = rough[at, nn]
        ok = d <= reach[at, 0]
        yield i, len(a), counted, at[ok], nn[ok], d[ok]


def _counted(q: np.ndarray, p: np.ndarray, r: np.ndarray, dist: str) -> np.ndarray:
    """How many points lie within each query's r: leaves of points that lie wholly within are counted, those wholly outside left, and only the others' points met."""
    out = np.zeros(len(q), np.int64)
    if not len(q) or not len(p):
        return out

    def boxes(x: np.ndarray) -> tuple:
        order, depth = leaves(x)
        edges = (np.arange((1 << depth) + 1) * len(x)) >> depth
        v = x[order]
        return order, edges, np.minimum.reduceat(v, edges[:-1]), np.maximum.reduceat(v, edges[:-1])

    oq, eq, lq, hq = boxes(q)
    op, ep, lp, hp = boxes(p)
    p, sizes = p[op], np.diff(ep)
    norm = {"l1": lambda x: x.sum(axis=1), "inf": lambda x: x.max(axis=1), "sql2": lambda x: (x * x).sum(axis=1), "l2": lambda x: np.sqrt((x * x).sum(axis=1))}[dist]
    for i in range(len(lq)):
        at = oq[eq[i] : eq[i + 1]]
        least = norm(np.maximum(np.maximum(lp - hq[i], lq[i] - hp), 0.0))
        most = norm(np.maximum(hp - lq[i], hq[i] - lp))
        low, high = r[at].min(), r[at].max()
        inside = most < low - abs(low) * 1e-12
        open_ = ~inside & (least <= high + abs(high) * 1e-12)
        out[at] += int(sizes[inside].sum())
        for j, m, counted, near, _, _ in _near(q[at], p[np.repeat(open_, sizes)], r[at], dist, True):
            out[at[j : j + m]] += counted + np.bincount(near, minlength=m)
    return out


def _within(df: DataFrame, features: tuple, index: str, r, dist: str, lists: bool, sort: bool = False) -> DataFrame:
    """(index, neighbours) or (index, count): the points within r of each.

    Cells of a grid as wide as the greatest radius are cut into blocks of queries; a block meets the points of the 3^d cells
    around its own in one call, and gives its rows' whole results: no pairs are shuffled.
    """
    if dist not in ("l1", "l2", "sql2", "inf"):
        raise ValueError(f"no radius search by {dist}")
    own = isinstance(r, str | Column)
    top = float((df.agg(F.max(dbl(r)).alias("m")).first().m or 0.0) if own else r)
    width = math.sqrt(max(top, 0.0)) if dist == "sql2" else top
    width = width if width > 0 else 1.0
    dims = len(features)
    grid = min(dims, 3)  # cells over the first dimensions are a necessary condition; the test is exact
    names = [f"f{i}_" for i in range(dims)]
    base = df.select(F.col(index).alias("id_"), *(finite(f).alias(n) for f, n in zip(features, names)), (dbl(r) if own else F.lit(top)).alias("r_")).dropna(subset=names)
    cells = [f"c{i}_" for i in range(grid)]
    base = base.withColumns({c: F.floor(F.col(n) / width).cast("long") for c, n in zip(cells, names)})
    counts = base.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts_"))
    part = F.pmod(F.xxhash64("id_"), F.col("parts_")).cast("long")
    # a row a block of queries and cell around it
    shifts = F.array(*(F.struct(*(F.lit(s).cast("long").alias(f"s{i}") for i, s in enumerate(c))) for c in itertools.product((-1, 0, 1), repeat=grid)))
    reach = counts.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1))).withColumn("s_", F.explode(shifts))
    reach = reach.select(*((F.col(c) + F.col(f"s_.s{i}")).alias(c) for i, c in enumerate(cells)), F.struct("part_", *(F.col(c).alias(f"q{c}") for c in cells)).alias("block_"))
    queries = base.join(counts, cells).select(F.struct(part.alias("part_"), *(F.col(c).alias(f"q{c}") for c in cells)).alias("block_"), F.lit(True).alias("query_"), "id_", *names, "r_")
    points = base.join(reach, cells).select("block_", F.lit(False).alias("query_"), "id_", *names, "r_")
    both = queries.unionByName(points).repartition(F.col("block_"))
    placed = both.withColumn("place_", F.row_number().over(Window.partitionBy("block_").orderBy("query_", "id_"))).drop("block_")
    kind = df.schema[index].dataType.simpleString()

    def run(batches):
        for t, first, sizes in groups.whole(batches):
            for one in (t.slice(i, n) for i, n in zip(first.tolist(), sizes.tolist())):
                asks = one.column("query_").to_numpy()
                n = int((~asks).sum())  # points come first, in the order of their ids
                ids, v = one.column("id_").combine_chunks(), np.column_stack([one.column(c).to_numpy() for c in names])
                reach = one.column("r_").to_numpy()[n:]
                if not lists:
                    yield pa.RecordBatch.from_arrays([ids.slice(n), pa.array(_counted(v[n:], v[:n], reach, dist))], names=[index, "count"])
                    continue
                for i, m, _, at, nn, d in _near(v[n:], v[:n], reach, dist, False):
                    if sort:
                        o = np.lexsort((d, at))
                        at, nn = at[o], nn[o]
                    ends = np.append(0, np.cumsum(np.bincount(at, minlength=m)))
                    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(nn)))
                    yield from pa.table([ids.slice(n + i, m), found], names=[index, "neighbours"]).to_batches(256)

    return placed.mapInArrow(run, f"`{index}` {kind}, " + (f"neighbours array<{kind}>" if lists else "count long"))


def query_radius_ptwise(df: DataFrame, *features, index: str, r: float, dist: str = "sql2", sort: bool = True) -> DataFrame:
    """(index, neighbours): ids within r, itself too, nearest first, ties by id."""
    return _within(df, features, index, r, dist, True, sort).filter(F.size("neighbours") > 0)


def query_radius_ptwise_null_safe(df: DataFrame, *features, index: str, r: float, dist: str = "sql2", sort: bool = True) -> DataFrame:
    """As before, and null for rows with a value that is null or not finite."""
    found = query_radius_ptwise(df, *features, index=index, r=r, dist=dist, sort=sort)
    odd = df.filter(reduce(lambda a, b: a | b, (finite(f).isNull() for f in features)) if r >= 0 else F.lit(True))
    return found.unionByName(odd.select(index, F.lit(None).cast(found.schema["neighbours"].dataType).alias("neighbours")))


def query_radius_freq_cnt(df: DataFrame, *features, index: str, r: float, dist: str = "sql2") -> DataFrame:
    """Points that have the row within r: as many as the row has within r, since distances are the same both ways."""
    return query_nb_cnt(df, *features, index=index, r=float(r), dist=dist)


def query_nb_cnt(df: DataFrame, *features, index: str, r, dist: str = "sql2") -> DataFrame:
    """Neighbours within r, itself too; r may be a column with a radius for each row."""
    return _within(df, features, index, r, dist, False).filter("count > 0")
