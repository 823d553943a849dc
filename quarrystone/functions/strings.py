"""String functions.  Built-in expressions where Spark has them, else vectorised Python over the batch's distinct pairs."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.col import dbl, ieee_div, to_col, total
from . import batch


def _pairwise(kernel, kind: str, whole_table: bool = False, as_bytes: bool = False):
    """A pandas UDF of two strings by a kernel over many pairs; equal pairs of a batch are computed once."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = pd.DataFrame({"a": a.to_numpy(object), "b": b.to_numpy(object)})
        some = pairs.dropna().drop_duplicates()
        read = (lambda t: t.encode().decode("latin-1")) if as_bytes else (lambda t: t)
        some["v"] = pd.Series(batch.over_blocks(kernel, [read(t) for t in some["a"]], [read(t) for t in some["b"]], whole_table), index=some.index, dtype=object)
        out = pairs.merge(some, on=["a", "b"], how="left")["v"] if len(some) else pd.Series([None] * len(pairs), dtype=object)
        out = out.where(out.notna(), None)
        return out.astype(object if kind in ("string", "boolean") else "Int64" if kind == "long" else float)

    return run


def _text(x) -> Column:
    return to_col(x).cast("string")


def filter_by_levenshtein(c, other, bound: int, as_bytes: bool = False) -> Column:
    if as_bytes:
        return str_leven(c, other, as_bytes=True) <= bound
    return F.levenshtein(_text(c), _text(other), bound) >= 0


def str_leven(c, other, return_sim: bool = False, as_bytes: bool = False) -> Column:
    a, b = _text(c), _text(other)
    if as_bytes:  # one character for each byte
        a, b = (F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b))
    d = F.levenshtein(a, b)
    return _as_similarity(d, a, b) if return_sim else d.cast("long")


def _as_similarity(d: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide(d.cast("double"), longest.cast("double")))


def str_hamming(c, other, pad: bool = False) -> Column:
    """Places that differ; for unequal lengths null, or with ``pad`` the excess counts too."""
    a, b = _text(c), _text(other)
    n = F.least(F.length(a), F.length(b))
    chars = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (~x.eqNullSafe(y)).cast("long"))
    d = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(chars, F.lit(0).cast("long"), lambda s, x: s + x))
    return d + F.abs(F.length(a) - F.length(b)) if pad else F.when(F.length(a) == F.length(b), d)


def filter_by_hamming(c, other, bound: int, pad: bool = False) -> Column:
    a, b = _text(c), _text(other)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(str_hamming(a, b, pad) <= bound, F.lit(False)))


def _grams(x: Column, n: int) -> Column:
    """The different runs of n bytes; a shorter text is one, an empty one has none."""
    raw = F.encode(x, "UTF-8")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(x) - (n - 1), F.lit(1))), lambda i: F.substring(raw, i, F.lit(n)))
    return F.when(F.octet_length(x) == 0, F.array().cast("array<binary>")).otherwise(F.array_distinct(each))


def _of_grams(f, n: int):
    def run(x: Column, y: Column) -> Column:
        # in a lambda, so that the sets are made once
        def share(s: Column) -> Column:
            top, bottom = f(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]), F.size(s["b"]))
            return ieee_div(top, bottom)

        both = F.transform(F.array(F.struct(_grams(x, n).alias("a"), _grams(y, n).alias("b"))), share)
        return F.when(x.isNotNull() & y.isNotNull(), F.get(both, F.lit(0)))

    return run


def str_jaccard(c, other, substr_size: int = 2) -> Column:
    return _of_grams(lambda m, a, b: (m, a + b - m), substr_size)(_text(c), _text(other))


def str_overlap_coeff(c, other, substr_size: int = 2) -> Column:
    return _of_grams(lambda m, a, b: (m, F.least(a, b)), substr_size)(_text(c), _text(other))


def str_sorensen_dice(c, other, substr_size: int = 2) -> Column:
    return _of_grams(lambda m, a, b: (2 * m, a + b), substr_size)(_text(c), _text(other))


def str_tversky_sim(c, other, alpha: float, beta: float, substr_size: int = 2) -> Column:
    if alpha < 0 or beta < 0:
        raise ValueError("alpha and beta must not be negative")
    return _of_grams(lambda m, a, b: (m, m + alpha * (a - m) + beta * (b - m)), substr_size)(_text(c), _text(other))


def jaro(x: str, y: str) -> float:
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(max(len(x), len(y)) // 2 - 1, 0)
    taken, found = [False] * len(y), []
    for i, ch in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == ch:
                taken[j] = True
                found.append(ch)
                break
    m = len(found)
    if not m:
        return 0.0
    swapped = sum(p != q for p, q in zip(found, (ch for j, ch in enumerate(y) if taken[j]))) // 2
    return (m / len(x) + m / len(y) + (m - swapped) / m) / 3


def jaro_winkler(x: str, y: str, weight: float = 0.1) -> float:
    s = jaro(x, y)
    prefix = 0
    while prefix < min(4, len(x), len(y)) and x[prefix] == y[prefix]:
        prefix += 1
    return min(1.0, s + prefix * weight * (1 - s)) if s > 0.7 else s


def str_jaro(c, other) -> Column:
    return _pairwise(batch.jaro, "double")(_text(c), _text(other))


def str_jw(c, other, weight: float = 0.1) -> Column:
    return _pairwise(lambda *pairs: batch.jaro_winkler(*pairs, weight), "double")(_text(c), _text(other))


def damerau(x, y) -> int:
    """Edits and swaps of neighbours, where what was swapped may be edited again."""
    last: dict = {}
    top = len(x) + len(y)
    d = [[top] * (len(y) + 2) for _ in range(len(x) + 2)]
    for i in range(len(x) + 1):
        d[i + 1][1] = i
    for j in range(len(y) + 1):
        d[1][j + 1] = j
    for i, p in enumerate(x, 1):
        at = 0
        for j, q in enumerate(y, 1):
            i2, j2 = last.get(q, 0), at
            if p == q:
                at = j
            d[i + 1][j + 1] = min(d[i][j] + (p != q), d[i + 1][j] + 1, d[i][j + 1] + 1, d[i2][j2] + (i - i2 - 1) + 1 + (j - j2 - 1))
        last[p] = i
    return d[-1][-1]


def osa(x: str, y: str) -> int:
    """Edits and swaps of neighbours, no place edited twice."""
    before, row = None, list(range(len(y) + 1))
    for i in range(1, len(x) + 1):
        new = [i]
        for j in range(1, len(y) + 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def _distance(kernel, c, other, return_sim: bool, **options) -> Column:
    a, b = _text(c), _text(other)
    d = _pairwise(kernel, "long", **options)(a, b)
    return _as_similarity(d, a, b) if return_sim else d


def str_d_leven(c, other, return_sim: bool = False, as_bytes: bool = False) -> Column:
    return _distance(batch.damerau, c, other, return_sim, whole_table=True, as_bytes=as_bytes)


def str_osa(c, other, return_sim: bool = False) -> Column:
    return _distance(batch.osa, c, other, return_sim)


def lcs_length(x: str, y: str) -> int:
    at: dict = {}
    for i, ch in enumerate(x):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        if m := at.get(ch):
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(x) - row.bit_count()


def lcs_subseq(x: str, y: str) -> str:
    n = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            n[i + 1][j + 1] = n[i][j] + 1 if x[i] == y[j] else max(n[i][j + 1], n[i + 1][j])
    i, j, out = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(x[i])
        elif n[i - 1][j] >= n[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(out))


def lcs_substr(x: str, y: str) -> str:
    """The longest common substring that is found first in the longer string."""
    long, short = (x, y) if len(x) >= len(y) else (y, x)
    best, end = 0, 0
    row = [0] * (len(short) + 1)
    for i, ch in enumerate(long, 1):
        new = [0] * (len(short) + 1)
        for j, other in enumerate(short, 1):
            if ch == other:
                new[j] = row[j - 1] + 1
                if new[j] > best:
                    best, end = new[j], i
        row = new
    return long[end - best : end]


def str_lcs_substr(c, other) -> Column:
    return _pairwise(batch.lcs_substr, "string")(_text(c), _text(other))


def str_lcs_subseq(c, other) -> Column:
    return _pairwise(batch.lcs_subseq, "string", whole_table=True)(_text(c), _text(other))


def str_lcs_subseq_dist(c, other, return_sim: bool = True) -> Column:
    a, b = _text(c), _text(other)
    d = F.greatest(F.length(a), F.length(b)).cast("long") - _pairwise(batch.lcs_length, "long")(a, b)
    return _as_similarity(d, a, b) if return_sim else d


def str_fuzz(c, other) -> Column:
    a, b = _text(c), _text(other)
    both = F.length(a) + F.length(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * _pairwise(batch.lcs_length, "long")(a, b) / both)


def str_nearest(c, word: str, threshold: int = 100, metric: str = "lv") -> Column:
    """The value nearest to ``word`` within the threshold, as an aggregate; ties go to the smallest value."""
    c = _text(c)
    d = str_leven(c, F.lit(word)) if metric == "lv" else str_hamming(c, F.lit(word))
    return F.min_by(F.when(d <= threshold, c), F.when(d <= threshold, F.struct(d.alias("d"), c.alias("c"))))


def similar_to_vocab(c, vocab: list[str], threshold: float, metric: str = "lv", strategy: str = "avg") -> Column:
    measure = {"lv": lambda a, b: str_leven(a, b, return_sim=True), "dlv": lambda a, b: str_d_leven(a, b, return_sim=True), "osa": lambda a, b: str_osa(a, b, return_sim=True), "jw": str_jw, "jaro": str_jaro, "fuzz": str_fuzz}[metric]
    sims = [measure(_text(c), F.lit(v)) for v in vocab]
    if strategy == "avg":
        return total(sims) / len(sims) >= threshold
    tests = [s >= threshold for s in sims]
    out = tests[0]
    for t in tests[1:]:
        out = out & t if strategy == "all" else out | t
    return out


def extract_numbers(c, ignore_comma: bool = False, join_by: str = "", dtype: str = "string") -> Column:
    c = F.regexp_replace(_text(c), ",", "") if ignore_comma else _text(c)
    found = F.regexp_extract_all(c, F.lit(r"(\d*\.?\d+)"), 1)
    return F.array_join(found, join_by) if join_by else F.transform(found, lambda x: x.try_cast(dtype)) if dtype != "string" else found


def replace_non_ascii(c, value: str = "") -> Column:
    return F.regexp_replace(_text(c), r"[^\p{ASCII}]", value.replace("\\", "\\\\").replace("$", "\\$"))


def _one(f):
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(f, na_action="ignore")

    return run


def remove_diacritics(c) -> Column:
    """Decomposes accented characters and keeps what is ASCII."""
    return _one(lambda s: s if s.isascii() else unicodedata.normalize("NFD", s).encode("ascii", "ignore").decode())(_text(c))


def normalize_string(c, form: str = "NFC") -> Column:
    return _one(lambda s: unicodedata.normalize(form, s))(_text(c))


def map_words(c, mapping: dict[str, str]) -> Column:
    c = F.trim(F.regexp_replace(_text(c), r"\s+", " "))
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
    ws = F.split(c, " ")
    return F.array_join(F.transform(ws, lambda w: F.coalesce(pairs[w], w)) if pairs is not None else ws, " ")


def normalize_whitespace(c, only_spaces: bool = False) -> Column:
    return F.regexp_replace(_text(c), " +", " ") if only_spaces else F.trim(F.regexp_replace(_text(c), r"\s+", " "))


_BREAK = re.compile(r"[^\W_]+")


def _case_words(s: str) -> list[str]:
    out = []
    for run in _BREAK.findall(s):
        out += re.findall(r"[A-ZÀ-ÖØ-Þ]+(?![^A-ZÀ-ÖØ-Þ\W\d_])|[A-ZÀ-ÖØ-Þ]?[^A-ZÀ-ÖØ-Þ\W\d_]+|\d+|\w", run)
    return [w.lower() for w in out]


def _title(w: str) -> str:
    return w[:1].upper() + w[1:]


def to_camel_case(c) -> Column:
    return _one(lambda s: "".join(w if i == 0 else _title(w) for i, w in enumerate(_case_words(s))))(_text(c))


def to_pascal_case(c) -> Column:
    return _one(lambda s: "".join(map(_title, _case_words(s))))(_text(c))


def to_snake_case(c) -> Column:
    return _one(lambda s: "_".join(_case_words(s)))(_text(c))


def to_constant_case(c) -> Column:
    return _one(lambda s: "_".join(_case_words(s)).upper())(_text(c))


__all__ = [n for n in dir() if n.startswith(("str_", "to_", "filter_"))] + ["similar_to_vocab", "extract_numbers", "replace_non_ascii", "remove_diacritics", "normalize_string", "map_words", "normalize_whitespace", "dbl", "ieee_div"]
