"""Quality rules: statistics of a text as Spark columns, and decision lists learned over them.

``learn`` fits an ordered list of rules by sequential covering (grow, prune, cover, repeat) on a bounded sample
of labelled rows.  A rule is a conjunction of thresholds; the list becomes one ``CASE WHEN`` expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, words

#: Labelled rows that ``learn`` looks at, at most (those with the smallest hash of their id).
MAX_LABELLED = 20_000
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "distinct_rate", "upper_rate", "digit_rate", "bang_rate", "bar_rate")


def _rate(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def with_stats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base counts and the features; the names they got (underscores go before a name that is taken)."""
    names = {n: free_name(docs, n) for n in dict.fromkeys(BASE + FEATURES)}
    t = {n: free_name(docs, f"q_{n}") for n in ("text", "words", "lines", "hashes", "wins", "sorted", "at")}
    c = {n: F.col(f"`{x}`") for n, x in (names | t).items()}
    keep = [F.col(f"`{x}`") for x in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    one = docs.select(*keep, text.alias(t["text"]), words(text).alias(t["words"]), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(t["lines"]))
    # a hash of each window of words: of the hashes of its words
    two = one.withColumn(t["hashes"], F.transform(c["words"], lambda w: F.xxhash64(w)))
    hashed = two.withColumn(t["wins"], F.when(F.size(c["hashes"]) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(c["hashes"]) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(c["hashes"], i, WINDOW)))))
    # only texts in which a window comes twice go on: windows sorted by hash, those with an equal neighbour, in text order
    sorted_ = hashed.withColumn(t["sorted"], F.when(F.size(c["wins"]) != F.size(F.array_distinct(c["wins"])), F.array_sort(F.transform(c["wins"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = sorted_.withColumn(t["at"], F.when(c["sorted"].isNotNull(), F.array_sort(F.filter(F.transform(c["sorted"], lambda x, k: F.when((x["h"] == F.get(c["sorted"], k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(c["sorted"], k + 1)["h"]).eqNullSafe(True), x["i"])), lambda i: i.isNotNull()))))
    covered = F.aggregate(c["at"], F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]
    left_out = lambda rx: F.char_length(F.regexp_replace(c["text"], rx, ""))
    n_chars = F.char_length(c["text"])
    base = again.select(
        *keep,
        c["text"],
        F.size(c["words"]).cast("long").alias(names["n_words"]),
        left_out(r"[\x20\x09-\x0D]+").cast("long").alias(names["word_chars"]),
        (n_chars - left_out(r"[#*$%&|<>]+")).cast("long").alias(names["n_symbols"]),
        (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long").alias(names["n_dup_lines"]),
        # tied to a row number that changes nothing: else a filter on any statistic would be pushed below this step, and
        # all steps before it written out again in each place that uses them
        F.when(F.monotonically_increasing_id() >= 0, F.coalesce(covered, F.lit(0)).cast("long")).alias(names["n_repeat_words"]),
        _rate(F.size(c["lines"]) - F.size(F.array_distinct(c["lines"])), F.size(c["lines"])).alias(names["dup_line_rate"]),
        _rate(F.size(F.array_distinct(c["words"])), F.size(c["words"])).alias(names["distinct_rate"]),
    )
    words_ = c["n_words"]
    out = base.withColumns({
        names["symbol_rate"]: _rate(c["n_symbols"], words_),
        names["repeat_rate"]: _rate(c["n_repeat_words"], words_),
        names["word_length"]: _rate(c["word_chars"], words_),
        names["upper_rate"]: _rate(n_chars - left_out(r"\p{Lu}+"), c["word_chars"]),
        names["digit_rate"]: _rate(n_chars - left_out("[0-9]+"), c["word_chars"]),
        names["bang_rate"]: _rate(n_chars - left_out("!+"), words_),
        names["bar_rate"]: _rate(n_chars - left_out(r"\|+"), words_),
    })
    return out.drop(t["text"]), names


@dataclass(frozen=True)
class Rule:
    """All of ``conditions`` (feature, "<=" or ">=", threshold) hold: the row gets ``verdict``."""

    conditions: tuple[tuple[str, str, float], ...]
    verdict: bool
    covered: int = 0
    precision: float = 0.0

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {x:.6g}" for f, op, x in self.conditions) + f" -> {'keep' if self.verdict else 'reject'} ({self.covered} rows, {self.precision:.3f})"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool = True

    def column(self, names: dict[str, str] | None = None) -> Column:
        """The list as one conditional expression, first rule that holds first."""
        out = None
        for r in self.rules:
            test = F.lit(True)
            for f, op, x in r.conditions:
                col = F.col(f"`{(names or {}).get(f, f)}`")
                test = test & (col <= x if op == "<=" else col >= x)
            out = (F if out is None else out).when(test, F.lit(r.verdict))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))


def _holds(row: tuple, conditions, index: dict[str, int]) -> bool:
    return all(row[index[f]] <= x if op == "<=" else row[index[f]] >= x for f, op, x in conditions)


def _best_condition(rows: list[tuple], features: tuple[str, ...], index: dict[str, int]) -> tuple[float, tuple | None]:
    """The threshold with the greatest FOIL gain over rows (..., target)."""
    p0, n0 = sum(r[-1] for r in rows), len(rows)
    if not p0 or p0 == n0:
        return 0.0, None
    before, best, found = math.log2(p0 / n0), 0.0, None
    for f in features:
        k = index[f]
        ordered = sorted(rows, key=lambda r: r[k])
        p = 0
        for i in range(n0 - 1):
            p += ordered[i][-1]
            a, b = ordered[i][k], ordered[i + 1][k]
            if a == b:
                continue
            mid = (a + b) / 2
            for op, pos, n in (("<=", p, i + 1), (">=", p0 - p, n0 - i - 1)):
                if pos and (gain := pos * (math.log2(pos / n) - before)) > best + 1e-12:
                    best, found = gain, (f, op, mid)
    return best, found


def fit(rows: list[tuple], features: tuple[str, ...] = FEATURES, *, min_covered: int = 5, min_precision: float = 0.8, max_rules: int = 24, max_conditions: int = 4) -> DecisionList:
    """Sequential covering.  ``rows``: the features in order, then True for a row to reject.

    Two of three rows grow a rule, the third prunes it.  A rule that covers fewer than ``min_covered`` rows, or too
    few of the class to reject among them, ends the search.  No rows, or one class only: no rules.
    """
    index = {f: k for k, f in enumerate(features)}
    left, rules = list(rows), []
    while len(rules) < max_rules and any(r[-1] for r in left):
        grow, prune = [r for i, r in enumerate(left) if i % 3 != 2], [r for i, r in enumerate(left) if i % 3 == 2]
        conditions: list[tuple] = []
        inside = grow
        while len(conditions) < max_conditions:
            _, found = _best_condition(inside, features, index)
            if not found:
                break
            conditions.append(found)
            inside = [r for r in inside if _holds(r, [found], index)]
        if not conditions:
            break

        def worth(cs: list[tuple]) -> float:
            held = [r for r in prune if _holds(r, cs, index)]
            p = sum(r[-1] for r in held)
            return (2 * p - len(held)) / len(held) if held else -1.0

        best = max(range(1, len(conditions) + 1), key=lambda n: (worth(conditions[:n]), -n))
        conditions = conditions[:best]
        held = [r for r in left if _holds(r, conditions, index)]
        p = sum(r[-1] for r in held)
        tested = [r for r in prune if _holds(r, conditions, index)]
        if len(held) < min_covered or p < min_precision * len(held) or (tested and sum(r[-1] for r in tested) < min_precision * len(tested)):
            break
        rules.append(Rule(tuple(conditions), False, len(held), p / len(held)))
        left = [r for r in left if not _holds(r, conditions, index)]
    return DecisionList(tuple(rules))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """A decision list that rejects rows like those labelled 0; at most ``max_labelled`` labelled rows are looked at.

    Defined cases: labels that are null, or whose id is null or in no document, say nothing; an id with several labels counts
    as each; of several documents of an id the one whose text has the least digest counts; no labels, or of one kind only: no
    rules; columns of any other names play no part.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), (F.col(label_col) == 0).alias("l_bad"))
    some = known.orderBy(F.xxhash64("l_id"), "l_id", "l_bad").limit(max_labelled)
    slim = docs.select(F.col(f"`{id_col}`").alias("l_doc"), F.col(f"`{text_col}`").alias("l_text"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("l_digest"))
    # the sample is bounded, so it is the side that is sent everywhere
    joined = slim.join(F.broadcast(some), F.col("l_doc") == F.col("l_id"))
    stats, names = with_stats(joined, "l_text")
    one = stats.groupBy("l_id", "l_bad").agg(F.min_by(F.struct(*(F.col(names[f]).cast("double").alias(f) for f in FEATURES)), "l_digest").alias("f"))
    rows = one.collect()  # as many as the sample has at most
    return fit([(*r.f, r.l_bad) for r in sorted(rows, key=lambda r: (r.l_id, r.l_bad))])


def judge(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed and kept.

    base_failed: fewer than 20 words, or more than 30 % of them in windows of 8 words found twice or more.
    kept: False if base_failed, else what the list says.

    Defined cases: null and empty texts have no words and fail; repeated rows are judged alike; a value equal to a threshold
    meets it on both sides; existing columns of the new names push underscores before the new ones; an empty table gives
    an empty result.  A very long text's words and windows are arrays of one row.
    """
    stats, names = with_stats(docs, text_col)
    n, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = free_name(stats, "base_failed")
    out = stats.withColumn(failed, (n < 20) | (100 * repeated > 30 * n))
    return out.withColumn(free_name(out, "kept"), F.when(F.col(failed), F.lit(False)).otherwise(rules.column(names)))


def keep(docs: DataFrame, rules: DecisionList, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns only (columns of any names pass through).  Defined cases are those of ``judge``."""
    judged = judge(docs, rules, text_col=text_col)
    return judged.filter(F.col(judged.columns[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
