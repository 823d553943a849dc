"""URL filters whose rules are indexed by their rarest literal token.

A rule is a pattern over ``host`` followed by ``path``:

* ``||`` at the front: the host itself or any of its subdomains begins here;
* ``*``: any characters; ``^``: one character that is no letter, digit, ``_``, ``-``, ``.`` or ``%``, or the end;
* everything else stands for itself.

A token is a run of letters and digits.  Tokens of a rule that a URL must hold whole (on either side a
literal separator, ``||`` or ``^``) can index it; the one that is rarest in the table's URLs does.  A rule without such a
token is indexed by the rarest piece of GRAM characters of its literal parts, which are then parts of a URL's tokens.  Every
distinct URL fetches, by its tokens and their pieces, the rules that can match, and only those are tried as regular
expressions; a rule with no literal part of that length is tried on all.  All of it is DataFrame code; the rules are a parameter of bounded size and are broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

MAX_RULES = 100_000
#: Characters of the pieces of tokens.
GRAM = 4


@dataclass(frozen=True)
class Rule:
    """``name`` is what results show.  Of the rules that match a URL the highest tier wins, then the longest pattern, then block."""

    pattern: str
    verdict: str
    name: str | None = None
    tier: int = 0


def regex_of(pattern: str) -> str:
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||")
    out = "".join({"*": ".*", "^": r"(?:[^\w\-.%]|$)"}.get(c) or re.sub(r"([^\w/\-])", r"\\\1", c) for c in body)
    return (r"^(?:[^/]*\.)?" if anchored else "") + out


def tokens_of(pattern: str) -> list[str]:
    """Tokens that every URL matched by the pattern holds as whole tokens."""
    anchored, body = pattern.startswith("||"), pattern.removeprefix("||")
    found = []
    for m in re.finditer(r"[A-Za-z0-9]+", body):
        before, after = body[: m.start()], body[m.end() :]
        # on the left the anchor or a literal separator, on the right a literal separator or ^
        if (before[-1:] not in ("", "*") or (not before and anchored)) and after[:1] not in ("", "*") and re.match(r"[\x00-\x7f]", after):
            found.append(m[0])
    return list(dict.fromkeys(found))


def pieces_of(pattern: str) -> list[str]:
    """Pieces of GRAM characters, marked by ``*``, that stand in a token of every URL matched by the pattern."""
    runs = re.findall(rf"[A-Za-z0-9]{{{GRAM},}}", pattern.removeprefix("||"))
    return list(dict.fromkeys(f"*{r[i : i + GRAM]}" for r in runs for i in range(len(r) - GRAM + 1)))


def _pieces(tokens: Column) -> Column:
    each = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.concat(F.lit("*"), F.substring(t, i, F.lit(GRAM))))
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) >= GRAM), each)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (the winner's name), pattern (the winner's) and verdict.

    Defined cases: a null URL, or one without ``://``, has an empty host and path and gets ``default``, unless a
    rule without literal parts matches the empty string; repeated URLs are judged alike; an empty table
    gives an empty result; a very long URL is one row with all its tokens.  If the table has columns of the new names, the new ones get underscores before.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    new = {n: free_name(pages, n) for n in ("host", "path", "rule", "pattern", "verdict")}
    at, place = free_name(pages, "url_at"), free_name(pages, "url_place")
    parts = pages.withColumns({new["host"]: host_of(F.col(url_col)), new["path"]: path_of(F.col(url_col))}).withColumn(place, F.concat(F.col(new["host"]), F.col(new["path"])))
    # whole tokens of each distinct place
    places = parts.select(F.col(place).alias("place")).distinct().withColumn("tokens", F.array_distinct(F.regexp_extract_all(F.col("place"), F.lit("[A-Za-z0-9]+"), 0)))
    rows = [(i, r.pattern, regex_of(r.pattern), r.verdict, r.name, r.tier, tokens_of(r.pattern) or pieces_of(r.pattern)) for i, r in enumerate(rules)]
    if any(ts and ts[0].startswith("*") for *_, ts in rows):
        places = places.withColumn("tokens", F.concat("tokens", _pieces(F.col("tokens"))))
    wanted = sorted({t for *_, ts in rows for t in ts})
    seen: dict[str, int] = {}
    if wanted:
        known = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))
        counted = places.select(F.explode("tokens").alias("token")).join(known, "token").groupBy("token").count()
        seen = {r["token"]: r["count"] for r in counted.collect()}  # one row a rule's token at most
    index = [(min(ts, key=lambda t: (seen.get(t, 0), t)) if ts else "", rx, (tier, len(p), v == "block", -i), p, v, n) for i, p, rx, v, n, tier, ts in rows]
    index_df = F.broadcast(spark.createDataFrame(index, "token string, rx string, rank struct<tier: int, length: int, block: boolean, first: int>, pattern string, verdict string, name string"))
    # rules without a token are candidates for every place, under the empty token
    every = F.array(F.lit("")) if any(not ts for *_, ts in rows) else F.array().cast("array<string>")
    fetched = places.select("place", F.explode(F.concat(F.col("tokens"), every)).alias("token")).join(index_df, "token")
    won = (
        fetched.filter(F.expr("rlike(place, rx)"))
        .groupBy("place")
        .agg(F.max(F.struct("rank", "pattern", "verdict", "name")).alias(at))
        .withColumnRenamed("place", free_name(parts, "won_place"))
    )
    key = won.columns[0]
    return parts.join(won, F.col(place) == F.col(key), "left").select(
        *(F.col(f"`{c}`") for c in pages.columns),
        F.col(new["host"]),
        F.col(new["path"]),
        F.col(f"{at}.name").alias(new["rule"]),
        F.col(f"{at}.pattern").alias(new["pattern"]),
        F.coalesce(F.col(f"{at}.verdict"), F.lit(default)).alias(new["verdict"]),
    )
