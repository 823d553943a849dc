"""The pipeline's stages, each against a plain version of what it decides, written without the operator it calls."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarrystone.llm import common, decontaminate, order_minhash
from quarrystone.llm.common import stage
from quarrystone.llm.queries import learned_rules, table, tokenizer_path

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(common.WORD, text or "")


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage gets and gives, on the smallest tables."""
    docs = table(spark, SF, "documents")
    out = {"documents": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = stage(f(spark, docs, SF), name)
        out[name] = docs
    return out


def rows(df):
    return [tuple(r) for r in df.orderBy(*df.columns).collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "token_ids"]
    assert all(steps[n].columns == steps["documents"].columns for n in list(steps)[:-1])
    assert steps["token_ids"].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_stage(spark, steps):
    """Base rules and the learned list, on counts made here."""
    rules = learned_rules(spark, SF).rules

    def features(text):
        ws, lines = words(text), [x for x in text.split("\n") if words(x)]
        wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        often = collections.Counter(wins)
        again = len({k for i, w in enumerate(wins) if often[w] > 1 for k in range(i, i + 8)})
        n, chars = max(len(ws), 1), max(sum(map(len, ws)), 1)
        count = lambda rx: len(re.findall(rx, text))
        return {
            "n_words": len(ws), "symbol_rate": count(r"[#*$%&|<>]") / n, "dup_line_rate": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_rate": again / n,
            "word_length": sum(map(len, ws)) / n, "distinct_rate": len(set(ws)) / n, "upper_rate": sum(c.isupper() for c in text) / chars, "digit_rate": count("[0-9]") / chars, "bang_rate": text.count("!") / n, "bar_rate": text.count("|") / n,
            "again": again,
        }

    def kept(text):
        f = features(text or "")
        if f["n_words"] < 20 or 100 * f["again"] > 30 * f["n_words"]:
            return False
        return next((r.verdict for r in rules if all(f[a] <= x if op == "<=" else f[a] >= x for a, op, x in r.conditions)), True)

    want = sorted(r.doc_id for r in steps["documents"].collect() if kept(r.text))
    assert sorted(r.doc_id for r in steps["quality_rules"].collect()) == want


def test_near_dedup_stage(steps):
    """All pairs by the longest common subsequence of five-word shingles, computed here."""
    docs = [(r.doc_id, r.text) for r in steps["quality_rules"].collect()]
    shingles = {}
    for i, t in docs:
        ws, seen = words(t), collections.Counter()
        shingles[i] = []
        for k in range(max(len(ws) - 4, 1)):
            w = tuple(ws[k : k + 5])
            shingles[i].append((w, seen[w]))
            seen[w] += 1
    sets = {i: set(x) for i, x in shingles.items()}
    comp = {i: i for i in sets}

    def subsequence(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for i, j in itertools.combinations(sorted(sets), 2):
        n = len(sets[i] & sets[j])
        if 1.8 * n >= 0.8 * (len(sets[i]) + len(sets[j])):
            m = n if shingles[i] == shingles[j] else subsequence(shingles[i], shingles[j])
            if m >= 0.8 * (len(shingles[i]) + len(shingles[j]) - m):
                a, b = comp[i], comp[j]
                comp = {k: min(a, b) if c in (a, b) else c for k, c in comp.items()}
    assert sorted(r.doc_id for r in steps["near_dedup"].collect()) == sorted(set(comp.values()))


def test_decontamination_stage(spark, steps):
    """Items looked for in every window of every text; the texts that hold one go, and no other."""
    docs = {r.doc_id: r.text for r in steps["near_dedup"].collect()}
    space = decontaminate.fit(steps["near_dedup"])
    items = decontaminate._items([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()], space)
    held = set()
    for i, t in docs.items():
        h = decontaminate.word_ids(pa.array([t]))[0].tolist()
        for item in items:
            n = len(item.words)
            if set(item.words) & set(h) and any(item.check(h[k : k + 2 * n + 32]) for k in range(0, max(len(h) - n // 2, 1), 8)):
                held.add(i)
                break
    left = {r.doc_id for r in steps["decontamination"].collect()}
    gone = set(docs) - left
    assert gone <= held and len(held - gone) <= 0.1 * max(len(held), 1)


def test_mix_stage(steps):
    """Sums, targets and Efraimidis-Spirakis keys, sorted here."""
    import hashlib

    docs = steps["decontamination"].collect()
    size, by = {}, collections.defaultdict(list)
    for r in docs:
        size[r.doc_id] = len(words(r.text))
        letters = sum(c.isalpha() for c in r.text or "") / max(len(r.text or ""), 1)
        u = (int(hashlib.md5(f"42:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        by[r.source].append((-np.log(u) / max(letters, 0.05), str(r.doc_id), r.doc_id))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for *_, i in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, target, free = 1.5 * sum(total.values()), {}, set(names)
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        for s in full or free:
            target[s] = 2 * total[s] if full else share[s]
        budget -= sum(target[s] for s in full)
        free -= full or free
    got = collections.Counter(r.doc_id for r in steps["mix_sources"].collect())
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for _, _, i in sorted(by[s]):
            upto += size[i]
            assert got[i] == epochs + (rest > 0 and 2 * upto - size[i] <= 2 * rest), (s, i)


def test_token_stage(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    want, at = [], 0
    for i, t in sorted((r.doc_id, r.text) for r in steps["mix_sources"].collect()):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in steps["token_ids"].collect()) == sorted(want)


ODD = "doc_id long, text string, source string, kept_id int, kept_digest int, hit_id int, size int, n_words int, _n_words int"


@pytest.mark.parametrize("n", range(5))
def test_stages_on_odd_tables(spark, n):
    """Nulls in every column, empty, repeated and very long texts, names that clash, and no rows."""
    name, step = corpus_pipeline.STAGES[n]
    long = " ".join(f"w{i}" for i in range(60_000))
    odd = [(None, None, None), (1, None, "a"), (2, "", None), (3, "a b", "a"), (3, "a b", "a"), (None, "c d e", "b"), (None, "c d e", "b"), (7, long, "a"), (8, " \n\t", "b")]
    df = spark.createDataFrame([(*r, 1, None, 3, None, 5, 6) for r in odd], ODD)
    out = step(spark, df, SF)
    got = out.collect()
    if name != "token_ids":
        assert out.columns == df.columns
    assert step(spark, df.limit(0), SF).count() == 0
    ids = collections.Counter((r.doc_id, r.text) if name != "token_ids" else r.doc_id for r in got)
    if name == "quality_rules":
        assert set(ids) <= {(7, long)}
    elif name == "near_dedup":
        # the four texts without words but one are equal only to their own copies; copies of a null id are one
        assert ids == {(1, None): 1, (3, "a b"): 1, (None, "c d e"): 1, (7, long): 1, (8, " \n\t"): 1}
    elif name == "decontamination":
        assert sum(ids.values()) == len(odd)
    elif name == "mix_sources":
        assert all(c <= 2 * odd.count(next(o for o in odd if o[:2] == k)) for k, c in ids.items())
    else:
        assert sum(ids.values()) == len(odd) and ids[None] == 3


def test_entry_has_the_pipeline(spark):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and sum(n.startswith("op") for n in entry.queries()) == 10
    assert order_minhash.SHINGLE == 5 and order_minhash.SIMILARITY == 0.8
