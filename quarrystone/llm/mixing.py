"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each row gets the key ``-ln(u) / quality`` with ``u`` from a digest of its id, so that reruns agree.
Ordered by key within its source, the rows' sizes are summed until the source's token budget is met.
A budget of more than the source holds is first spent on whole epochs; only its rest is sampled.

No source is ever sorted as a whole: sizes are first summed by (source, key bucket), with a fixed number of buckets.  The
one bucket in which a budget ends is split into as many again, until it holds few rows; only those are looked at row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, n_words, stage

BUCKETS = 4096
#: Different (key, id) of a source that one task sorts, at most, and how often a bucket is split for that.
SORTED, LEVELS = 50_000, 5
#: Sources are a small table: beyond this many the mix is refused.
MAX_SOURCES = 200_000


def letter_share(text: Column) -> Column:
    """Quality weight of a text: the share of letters among its characters, 0.05 at least."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = letters / F.greatest(F.char_length(text), F.lit(1))
    return F.coalesce(F.greatest(share, F.lit(0.05)), F.lit(0.05))


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; none is above ``cap`` times its size, the excess is shared again by weight.

    If every source is at its cap, what is left over has no taker.
    """
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    left, weight, out = float(total), float(sum(weights)), [0.0] * len(sizes)
    for k, i in enumerate(order):
        if left * weights[i] / weight > cap * sizes[i]:
            out[i] = cap * sizes[i]
            left, weight = left - out[i], weight - weights[i]
        else:
            for j in order[k:]:
                out[j] = left * weights[j] / weight
            break
    return out


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_of: Callable[[int, str | None], float] = lambda rank, _: (5.0, 2.0, 1.0)[rank % 3],
    share: float = 1.5,
    cap: float = 2.0,
    quality: Callable[[Column], Column] = letter_share,
    seed: int = 42,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the columns size, source_size, target, copies and taken; without ``with_text`` it lacks the text, and texts are read once.

    ``weight_of(rank, source)`` weighs a source by its place among the sources in code point order, null last.
    ``copies`` is how often the mix takes the row, ``taken`` its words times that.  The row at which a
    source's budget ends is taken if that brings the source nearer to its target.

    Defined cases: null and empty texts have size 0 and come with the rows around them, or in whole epochs; a null id is an
    id of its own; rows that repeat id and text are taken or left together, rows of equal keys come in the order of their ids; an empty table
    gives an empty result; a source of size 0 has target 0 and none of its rows is taken.  A very long text is one row of
    its size.  If the table has columns of the new names, the new ones get underscores before their names.
    """
    if cap <= 0 or share < 0:
        raise ValueError("cap must be positive and share not negative")
    new = {n: free_name(docs, n) for n in ("size", "source_size", "target", "copies", "taken")}
    names = {n: free_name(docs, f"mix_{n}") for n in ("key", "id", "source", "epochs", "cut_key", "cut_id")}
    text = F.col(f"`{text_col}`")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), ident))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.withColumns({new["size"]: n_words(text), names["key"]: -F.log(u) / quality(text), names["id"]: ident})
    own = [names["id"], names["key"], new["size"]]
    staged = stage(keyed.select(F.col(f"`{source_col}`"), *own) if with_text else keyed.drop(text_col), "mix")
    slim = staged.select(F.col(f"`{source_col}`").alias("s"), *(F.col(c).alias(n) for c, n in zip(own, ("id", "key", "n"))))
    spark = docs.sparkSession
    totals = slim.groupBy("s").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r.s is None, (r.s or "").encode("utf-32-be") if isinstance(r.s, str) or r.s is None else r.s))
    weights = [float(weight_of(i, r.s)) for i, r in enumerate(totals)]
    targets = water_fill([r.n for r in totals], weights, share * sum(r.n for r in totals), cap) if totals else []
    plan = []
    for r, target in zip(totals, targets):
        epochs = int(target // r.n) if r.n else 0
        plan.append((r.s, int(r.n), target, epochs, target - epochs * r.n))
    kind = slim.schema["s"].dataType.simpleString()
    cuts = _cuts(slim, [(s, rest) for s, _, _, _, rest in plan if rest > 0], kind)
    limits = [(s, n, t, e, *cuts.get(s, (None, None))) for s, n, t, e, _ in plan]
    limit_df = F.broadcast(spark.createDataFrame(limits, f"{names['source']} {kind}, `{new['source_size']}` long, `{new['target']}` double, {names['epochs']} int, {names['cut_key']} double, {names['cut_id']} string"))
    key, i, cut_key, cut_id = (F.col(names[n]) for n in ("key", "id", "cut_key", "cut_id"))
    chosen = F.coalesce((key < cut_key) | ((key == cut_key) & (i <= cut_id)), F.lit(False))
    out = (keyed if with_text else staged).join(limit_df, F.col(f"`{source_col}`").eqNullSafe(F.col(names["source"])), "left").withColumn(new["copies"], F.col(names["epochs"]) + chosen.cast("int"))
    out = out.withColumn(new["taken"], F.col(new["copies"]) * F.col(new["size"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if with_text or c != text_col), *(new[n] for n in ("size", "source_size", "target", "copies", "taken")))


def _cuts(slim: DataFrame, rests: list[tuple], kind: str) -> dict:
    """For each source the last (key, id) that is taken of rows (s, id, key, n) so that their sizes come nearest to the source's rest.

    Each level splits the source's interval of keys (of key / (1 + key), which is below 1) into BUCKETS and goes on in the bucket
    where the rest ends.  What is collected is a row a source.
    """
    spark, cuts = slim.sparkSession, {}
    at = F.col("key") / (F.col("key") + 1.0)
    # source, rest, sum of sizes before the interval, its begin and end
    open_ = [(s, float(rest), 0, 0.0, 1.0) for s, rest in rests]
    for level in range(LEVELS + 1):
        if not open_:
            break
        where = F.broadcast(spark.createDataFrame(open_, f"ps {kind}, rest double, before long, lo double, hi double"))
        inside = slim.join(where, F.col("s").eqNullSafe(F.col("ps")) & (at >= F.col("lo")) & ((at < F.col("hi")) | (F.col("hi") == 1.0)))
        bucket = F.least(F.floor((at - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        sums = inside.groupBy("s", bucket.alias("b"), "rest", "before", "lo", "hi").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        w = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.col("before") + F.sum("n").over(w)
        # the bucket where the rest ends, or the last one if all are within it
        mine = sums.withColumn("upto", upto).withColumn("beyond", F.col("upto") > F.col("rest"))
        ends = mine.groupBy("s").agg(F.min(F.when(F.col("beyond"), F.struct("b", "upto", "n", "rows", "lo", "hi", "rest"))).alias("hit"), F.max(F.struct("b", "upto", "n", "rows", "lo", "hi", "rest")).alias("end")).collect()
        again, ready = [], []
        for r in ends:
            e = r.hit or r.end
            step = (e.hi - e.lo) / BUCKETS
            row = (r.s, e.rest, e.upto - e.n, e.lo + e.b * step, e.hi if e.b == BUCKETS - 1 else e.lo + (e.b + 1) * step)
            (again if e.rows > SORTED and level < LEVELS and step > 1e-15 else ready).append(row)
        if ready:
            cuts |= _cut_rows(slim, ready, kind, at)
        open_ = again
    return cuts


def _cut_rows(slim: DataFrame, intervals: list[tuple], kind: str, at: Column) -> dict:
    """As ``_cuts``, in intervals of few rows; the last row before an interval is the cut if none in it is taken."""
    where = F.broadcast(slim.sparkSession.createDataFrame(intervals, f"ps {kind}, rest double, before long, lo double, hi double"))
    inside = slim.join(where, F.col("s").eqNullSafe(F.col("ps")) & (at >= F.col("lo")) & ((at < F.col("hi")) | (F.col("hi") == 1.0)))
    w = Window.partitionBy("s").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = inside.groupBy("s", "key", "id", "before", "rest").agg(F.sum("n").alias("n")).withColumn("upto", F.col("before") + F.sum("n").over(w))
    last = rows.filter(2 * F.col("upto") - F.col("n") <= 2 * F.col("rest")).groupBy("s").agg(F.max(F.struct("key", "id")).alias("last"))
    found = {r.s: (r.last.key, r.last.id) for r in last.collect()}  # one row a source at most
    # all keys before the interval, none in it
    return {s: found.get(s, (lo / (1.0 - lo) if lo < 1 else None, "")) for s, _, _, lo, _ in intervals}


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: the columns of ``docs``, each row as often as the mix takes it.

    Defined cases are those of ``mix``; columns of any names pass through, and an empty table stays empty.
    """
    mixed = mix(docs, **options)
    copies = mixed.columns[-2]
    return mixed.filter(F.col(copies) > 0).withColumn(free_name(mixed, "copy"), F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))
