"""Each operator on small tables: against brute force, and on nulls, empty and repeated rows, and names that clash."""

import collections
import contextlib
import html
import io
import itertools
import pickle
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarrystone.llm import attention_lm, chat, common, decontaminate, html_extract, line_dedup, mixing, order_minhash, quality, queries, token_output, url_filter

DOCS = "doc_id long, text string, source string"
SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(rng, n):
    return " ".join(rng.choice(["ab", "cde", "fghi", "klm", "no", "pqrst", "uv"]) + rng.choice("xyzw") + rng.choice("1234567") for _ in range(n))


# --- hashing

def test_word_hashes_tell_words_apart():
    texts = ["a b\tc", "", None, "ü a  b", "\x0b"]
    raw, at = common.texts_of(pa.array(texts))
    b, e, first = common.spans(raw, at)
    assert np.diff(first).tolist() == [3, 0, 0, 3, 0]
    h = common.span_hashes(raw, b, e)
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4


# --- 1

def test_mix(spark):
    rng = random.Random(0)
    rows = [(i, words(rng, rng.randint(1, 30)), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(600, None, "a"), (None, "x y", "b")]
    df = docs(spark, rows).withColumnRenamed("doc_id", "size").withColumnRenamed("size", "doc_id")
    out = mixing.mix(df).toPandas()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = ["a", "b", "c", None]
    want = mixing.water_fill([sizes[s] for s in order], [5, 2, 1, 5], 1.5 * total, 2.0)
    assert sum(want) == pytest.approx(1.5 * total)
    for s, t in zip(order, want):
        mine = out[out.source.isna()] if s is None else out[out.source == s]
        assert mine.target.iloc[0] == pytest.approx(t)
        assert abs(mine.taken.sum() - t) <= 30
    assert (out.taken <= 2 * out["size"]).all() and len(out) == len(rows)
    again = mixing.mix(df.repartition(3)).toPandas()
    assert dict(zip(out.doc_id.fillna(-1), out.taken)) == dict(zip(again.doc_id.fillna(-1), again.taken))
    assert mixing.take(df).count() == out["copies"].sum()


def test_mix_splits_full_buckets_and_leaves_empty_texts_at_the_cap(spark, monkeypatch):
    """Texts without letters have keys 20 times as great; equal ids have equal keys; buckets are split down to single rows."""
    rng = random.Random(19)
    rows = [(i % 500, " ".join("12 34 5".split()[: rng.randint(0, 3)]), rng.choice("ab")) for i in range(900)]
    df = docs(spark, rows)
    want = sorted((r.doc_id, r.source, r["size"], r.copies, r.taken) for r in mixing.mix(df).collect())
    for buckets, most in ((2, 1), (3, 10), (4096, 5)):
        monkeypatch.setattr(mixing, "BUCKETS", buckets)
        monkeypatch.setattr(mixing, "SORTED", most)
        monkeypatch.setattr(mixing, "LEVELS", 4)
        got = mixing.mix(df, with_text=False)
        assert "text" not in got.columns and sorted((r.doc_id, r.source, r["size"], r.copies, r.taken) for r in got.collect()) == want
    out = mixing.mix(df).toPandas()
    for _, mine in out.groupby("source"):
        # the brute way: all rows of the source in the order of their keys
        target, n = mine.target.iloc[0], mine["size"].sum()
        assert abs(mine.taken.sum() - target) <= 3 and mine.copies.max() <= 2
    # one source only: its share is 150 %, so half of it twice; at the cap nothing is drawn a third time
    one = mixing.mix(docs(spark, [(i, "a b" if i % 2 else None, "s") for i in range(40)]), share=5.0).toPandas()
    assert (one.copies == 2).all() and one.taken.sum() == 80


def test_mix_of_clashing_and_empty(spark):
    df = docs(spark, [(1, "a b", "s", 9)], DOCS + ", size int")
    assert mixing.mix(df).columns == ["doc_id", "text", "source", "size", "_size", "source_size", "target", "copies", "taken"]
    assert mixing.mix(docs(spark, [])).count() == 0


# --- 2

def test_url_rules_against_plain_matching(spark):
    rng = random.Random(1)
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "example.com", "b.org", "org", "spam-farm.io", "xspam-farm.io", "EXAMPLE.com", "a.net:80"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/de/x?q#f", "/fr/", "/EN/1", "?/en/", "/wp-login.php", "/wp-login.phpx")] + [None, "", "no scheme", "://"]
    got = url_filter.judge(spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string"), queries.url_rules()).toPandas()
    assert got.columns.tolist() == ["page_id", "url", "rule", "host", "path", "_rule", "pattern", "verdict"]
    for r in got.itertuples():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(p), p, v) for p, v in queries.HOST_RULES if ("." + host).endswith("." + p.split("/")[0]) and path.startswith("/" + p.split("/", 1)[1])]
        assert (r.host, r.path) == (host, path)
        name = max(fits)[1] if fits else None
        assert (None if r[6] is None or r[6] != r[6] else r[6]) == name, r
        if fits:
            assert r.verdict == max(fits)[2]
        else:
            plain = any(re.search(url_filter.regex_of(p), host + path) for p in queries.PATTERNS)
            assert r.verdict == ("block" if plain else "allow"), r


def test_rules_without_whole_tokens_are_found_by_pieces(spark):
    rng = random.Random(20)
    patterns = ["||*casino.", "*cheap", "*ab", "||*-porn.", "*x*longword*y", "/wp-", "*1234*", "||*spam-farm.", "*"]
    assert [url_filter.pieces_of(p)[:1] for p in patterns[:3]] == [["*casi"], ["*chea"], []]
    words_ = ["casino", "mycasinos", "cheaper", "ab", "x", "longwordy", "porn", "-porn", "wp-", "12345", "spam-farm", ".", "/", "-"]
    urls = [(i, "http://" + "".join(rng.choices(words_, k=rng.randint(1, 6)))) for i in range(400)]
    rules = [url_filter.Rule(p, "block", p) for p in patterns[:-1]]
    got = {r.page_id: r["rule"] for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    for i, u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        place = m[1].lower() + m[2]
        fits = [r for r in rules if re.search(url_filter.regex_of(r.pattern), place)]
        assert got[i] == (max(fits, key=lambda r: (len(r.pattern), -rules.index(r))).name if fits else None), place


def test_tokens_bound_the_match():
    assert url_filter.tokens_of("||ads-track.") == ["ads", "track"]
    assert url_filter.tokens_of("*foo*/bar/baz") == ["bar"]


# --- 3

def plain_chunks(text):
    """Chunks of a text by their definition, line by line; of the operator's code only the hash of a line."""
    lines = text.split("\n")
    n = [len(re.findall(common.WORD, x)) for x in lines]
    raw, at = common.texts_of(pa.array(lines))
    h = common.mix(common.span_hashes(raw, at[:-1], at[1:])) % np.uint64(line_dedup.MEAN_LINES)
    long = [x >= line_dedup.LONG_WORDS for x in n]
    cut = [i + 1 == len(lines) or h[i] == 0 or long[i] or long[i + 1] for i in range(len(lines))]
    enough = lambda a, b: b - a >= 2 and sum(n[a:b]) >= line_dedup.LEAST_WORDS
    out = {(i, i + 1) for i in range(len(lines)) if long[i]}
    for i in range(len(lines)):
        out |= set([(i, j) for j in range(i + 2, len(lines) + 1) if enough(i, j) and cut[j - 1]][:1])
        out |= set([(j, i + 1) for j in range(i - 1, -1, -1) if enough(j, i + 1) and (j == 0 or cut[j - 1])][:1])
    return lines, out


def brute_lines(rows):
    """Chunks, and such as stand twice with a line more on a side where no such chunk holds it, less those that stand before."""
    docs = {i: plain_chunks(t) for i, t in rows}
    text = lambda i, a, b: "\n".join(docs[i][0][a:b])
    often = collections.Counter(text(i, *c) for i, (_, cs) in docs.items() for c in cs)
    seen, out = set(), {}
    for i, (lines, cs) in sorted(docs.items()):
        cs = {c for c in cs if often[text(i, *c)] > 1}
        held = {k for a, b in cs for k in range(a, b)}
        cs |= {(a - 1, b) for a, b in cs if a and a - 1 not in held} | {(a, b + 1) for a, b in cs if b < len(lines) and b not in held}
        gone = set()
        for a, b in sorted(cs):
            if text(i, a, b) in seen:
                gone |= set(range(a, b))
            seen.add(text(i, a, b))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_chunks_by_definition():
    rng = random.Random(16)
    texts = ["", "\n\n", words(rng, 60)] + ["\n".join(words(rng, rng.choice([0, 1, 3, 8, 30])) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    doc, first, after, *_ = line_dedup.chunks_of(*common.texts_of(pa.array(texts)))
    for k, t in enumerate(texts):
        assert {(a, b) for d, a, b in zip(doc.tolist(), first.tolist(), after.tolist()) if d == k} == plain_chunks(t)[1]


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = [words(rng, rng.randint(0, 40)) for _ in range(30)]
    shared = "\n".join(words(rng, 60) for _ in range(3))
    rows = []
    for i in range(40):
        own = [words(rng, rng.randint(1, 12)) for _ in range(8)]
        rows.append((i, "\n".join([*own[:4], shared, *rng.sample(pool, 6), *own[4:]]) if i % 3 else "\n".join(own)))
    df = spark.createDataFrame([(*r, 5) for r in [*rows, (90, None), (91, ""), (0, rows[0][1])]], "doc_id long, text string, digest int")
    got = line_dedup.dedup_lines(df).collect()
    want = brute_lines(rows)
    for r in got:
        if r.doc_id < 90:
            assert r.kept_text == want[r.doc_id]
    holders = [r for r in got if shared.split("\n")[0] in (r.kept_text or "")]
    assert [r.doc_id for r in holders] == [1]
    assert {r.doc_id: r.n_lines for r in got if r.doc_id >= 90} == {90: 0, 91: 1}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_passages_go_whole(spark):
    """Passages of over 50 words in short lines, in contexts of their own: nearly all lines of their second places go, and no other line."""
    rng = random.Random(17)
    line = lambda n: " ".join(f"{words(rng, 1)}{rng.randint(0, 9999)}" for _ in range(n))
    rows, planted = [], {}
    for i in range(120):
        n = rng.choice([2, 3, 5, 8, 20])
        passage = [line(max(3, -(-52 // n)) + rng.randint(0, 3)) for _ in range(n)]
        for k in (2 * i, 2 * i + 1):
            rows.append((k, "\n".join([line(rng.randint(1, 20)) for _ in range(rng.randint(1, 8))] + passage + [line(rng.randint(1, 20)) for _ in range(rng.randint(1, 8))])))
        planted[2 * i + 1] = set(passage)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_removed_lines == 0 for k, _ in rows if k not in planted)
    left = {k: planted[k] & set(got[k].kept_text.split("\n")) for k in planted}
    assert all(got[k].n_removed_lines == len(planted[k]) - len(left[k]) for k in planted)
    assert sum(not x for x in left.values()) >= 0.9 * len(left)


def test_line_boundaries_do_not_shift():
    """Lines put before a text change no boundary inside it but near its top."""
    rng = random.Random(18)
    lines = [words(rng, 6) for _ in range(60)]
    place = lambda t: {(a, b) for a, b in zip(*(x.tolist() for x in line_dedup.chunks_of(*common.texts_of(pa.array([t])))[1:3]))}
    plain = place("\n".join(lines))
    for extra in (1, 2, 7):
        moved = {(a - extra, b - extra) for a, b in place("\n".join([words(rng, 5) for _ in range(extra)] + lines))}
        assert {c for c in plain if c[0] > 12} == {c for c in moved if c[0] > 12}


# --- 4

def brute_cost(roles, costs):
    """Least cost over all role sequences."""
    best = float("inf")
    for choice in itertools.product((1, 2, 3), repeat=len(roles)):
        prev, total = 0, 0.0
        for own, role in zip(roles, choice):
            options = [c for c, state, _ in chat.steps(prev, own, costs) if state == role]
            if not options:
                total = float("inf")
                break
            total, prev = total + min(options), role
        best = min(best, total + chat.closing(prev, costs))
    return best


def cost_of(roles, done, costs):
    prev, total = 0, 0.0
    for own, (role, how) in zip(roles, done):
        total += next(c for c, state, h in chat.steps(prev, own, costs) if (state, h) == (role, how))
        prev = role
    return total + chat.closing(prev, costs)


def test_repair_is_cheapest():
    rng = random.Random(3)
    costs = chat.Costs()
    for _ in range(200):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 6))]
        assert cost_of(roles, chat.trace(roles, costs), costs) == brute_cost(roles, costs)


@pytest.mark.parametrize("parts", [1, 5])
def test_chats_of_any_cut(spark, parts):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "Human"]), f"{c}-{t}") for c in (1, 1, 2, None) for t in range(25 if c == 1 else 4)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(out) == len(rows)
    costs = chat.Costs()
    for c in (1, 2, None):
        mine = sorted((r for r in out if r.conv_id == c), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(len(mine)))
        roles = [chat.role_of(r.role) for r in mine]
        done = [(chat.ROLES.index(r.new_role), "keep" if r.action in ("keep", "relabel") else r.action.removeprefix("relabel+")) for r in mine]
        assert cost_of(roles, done, costs) == cost_of(roles, chat.trace(roles, costs), costs)
        whole = "".join(r.rendered for r in mine)
        order = re.findall(r"<\|(system|user|assistant)\|>", whole)
        assert re.fullmatch(r"s?(ua)+", "".join(x[0] for x in order)) and whole.count("<|end|>") == len(order)


# --- 5

def test_shard_round_trip():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 50000, n).astype("<u4").tobytes() for n in (0, 1, 700, 100000, 3)]
    out = io.BytesIO()
    w = token_output.ShardWriter(out, frame_bytes=1000)
    for i, x in zip((None, 3, 3, 9, 10), texts):
        w.add(i, x)
    w.close()
    data = out.getvalue()
    r = token_output.ShardReader(io.BytesIO(data), len(data))
    assert [r.ids(k) for k in range(5)] == texts and list(r.find(3)) == texts[1:3] and list(r.find(None)) == [texts[0]] and not list(r.find(4))
    with pytest.raises(Exception):
        bad = bytearray(data)
        bad[10] ^= 255
        token_output.ShardReader(io.BytesIO(bytes(bad)), len(bad)).ids(1)


ODD_TEXTS = [
    "Hello, wörld!! don't <|endoftext|> x1.5\n\n ÉTÉ\tstraße á Σας İ 漢字", "", None, "  a  ", "co-op_'s %% 12ab", "a<|endoftext|>b<|startoftext|>", "<|EndOfText|>",
    "x y \u0301z", "ΑΣ ΑΣΑ", "\n", "é×÷ß ÿÀÞ×Ö", "\u00a0a\u00a0b", "naïve,ÉTÉ!!a-b_c1234%%%(10.5)", "it's we'll 'tis", "\x00\x7f ~", "ab" * 3000,
]


@pytest.mark.parametrize("literal", [False, True])
def test_encoder_equals_the_library(literal):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    library.encode_special_tokens = literal
    e = token_output.ChunkEncoder(queries.tokenizer_path(), 1, literal)
    assert e.by_chunk
    rng = random.Random(11)
    glyphs = ["a", "B", "é", "É", "ß", "×", "1", "'", "-", "<|endoftext|>", " ", "\n", "\t", "Σ", "漢", "\u0301", "s", "\u2003"]
    texts = ODD_TEXTS + ["".join(rng.choices(glyphs, k=rng.randint(0, 30))) for _ in range(2000)]
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want
    assert e.encode(texts) == want  # from memory
    assert e.encode([]) == [] and e.encode([None]) == [b"\x01\0\0\0"]
    assert literal or 49407 in np.frombuffer(e.encode(texts[:1])[0], "<u4")


def test_encoder_of_long_texts_and_other_tokenizers(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    e = token_output.ChunkEncoder(queries.tokenizer_path(), 1)
    text = "Some words, é ' 12 <|endoftext|>\n" * 40
    monkeypatch.setattr(token_output, "SLICE", 50)
    monkeypatch.setattr(token_output, "REMEMBERED", 5)
    assert e.encode_long(text) == e.encode([text])[0]
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = token_output.ChunkEncoder(path, 50256)
    assert not other.by_chunk
    for t in (text, "", " a  b"):
        assert np.frombuffer(other.encode_long(t), "<u4").tolist() == [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 50256] == np.frombuffer(other.encode([t])[0], "<u4").tolist()


def test_token_output(spark):
    rows = [(5, "Hello there"), (2, None), (9, "b " * 3000), (2, "same id"), (None, "no id"), (-(1 << 63), "least id"), (2, "same id")]
    path, shards = token_output.write_shards(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids_crc32 int"), queries.tokenizer_path())
    got = token_output.read_shards(spark, shards, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got][0] is None and [r.doc_id for r in got][1:] == [-(1 << 63), 2, 2, 2, 5, 9]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and r.ids[-4:] == b"\x01\0\0\0"
        at += r.n_tokens
    assert token_output.read_shards(spark, []).count() == 0


# --- 6

def test_alignment_against_plain():
    rng = random.Random(6)
    for _ in range(100):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
        assert order_minhash.matched(a, b, 60) == n[-1][-1]
        s = n[-1][-1] / (len(a) + len(b) - n[-1][-1]) if a or b else 0.0
        if s >= 0.8:
            assert order_minhash.similarity(a, b, 0.8) == s


def edited(rng, text, share):
    return " ".join(words(rng, 1) if rng.random() < share else w for w in text.split())


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(f"{words(rng, 1)}{rng.random():.5f}" for _ in range(120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, edited(rng, base[0], 0.012)) for i in range(40)] + [(200 + i, edited(rng, base[1], 0.05)) for i in range(20)]
    rows += [(300, base[2]), (301, base[2]), (302, "a b"), (303, "a b"), (304, "a c"), (305, ""), (306, None), (307, " "), (None, base[3]), (300, base[2])]
    got = order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    sh = [order_minhash.labelled(*common.texts_of(pa.array([t])))[0].tolist() for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        if (rows[x][1] or "") == (rows[y][1] or "") or order_minhash.similarity(sh[x], sh[y], 0.8) >= 0.8:
            up[top(x)] = top(y)
    want = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        want[top(k)].append(i)
    names = sorted((min(x for x in v if x is not None), len(v)) for v in want.values() for _ in v)
    assert sorted((r.class_id, r.class_size) for r in got) == names
    kept = order_minhash.keep_one(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept_id int, kept_digest int"))
    assert kept.columns == ["doc_id", "text", "kept_id", "kept_digest"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((x for x in v if x is not None), default=None)) for v in want.values())
    nameless = spark.createDataFrame([(None, base[0]), (None, edited(rng, base[0], 0.01)), (None, base[0]), (None, base[5])], "doc_id long, text string")
    assert order_minhash.keep_one(nameless).count() == 2
    assert order_minhash.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_of_a_loose_group(spark, monkeypatch, rounds):
    """Copies of copies, 0.5 to 1 of one another: classes equal those of all pairs, however many leader rounds come first."""
    monkeypatch.setattr(order_minhash, "ROUNDS", rounds)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.random():.6f}" for _ in range(80))]
    for _ in range(150):
        texts.append(" ".join(f"w{rng.random():.6f}" if rng.random() < rng.choice([0.01, 0.05]) else w for w in rng.choice(texts[-20:]).split()))
    sh = [order_minhash.labelled(*common.texts_of(pa.array([t]))) for t in texts]
    maps = [order_minhash.bit_maps(*x)[0] for x in sh]
    lists = [x[0].tolist() for x in sh]
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(set(lists[i]) & set(lists[j]))
        both = sum(int(x).bit_count() for x in (maps[i] & maps[j]).view(np.uint64))
        assert shared <= min(len(lists[k]) - sum(int(x).bit_count() for x in maps[k].view(np.uint64)) + both for k in (i, j))
        if order_minhash.similarity(lists[i], lists[j], 0.8) >= 0.8:
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    got = order_minhash.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(comp))


def test_recall_of_near_copies_on_a_table(spark):
    """Ids divisible by 20 against all texts: at least 9 of 10 similar pairs are in one class."""
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    sh = {r.doc_id: order_minhash.labelled(*common.texts_of(pa.array([r.text])))[0].tolist() for r in rows}
    sets = {i: set(x) for i, x in sh.items()}
    named = {r.doc_id: r.class_id for r in order_minhash.classes(spark.read.parquet(path)).collect()}
    found = total = 0
    for i in sh:
        if i % 20 == 0:
            for j in sh:
                n = len(sets[i] & sets[j])
                if i != j and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) and n and order_minhash.similarity(sh[i], sh[j], 0.8) >= 0.8:
                    total, found = total + 1, found + (named[i] == named[j])
    assert total >= 5 and found >= 0.9 * total, (found, total)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(1, 2), (3, 2), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in order_minhash.components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 1: 1, 2: 1, 3: 1}


# --- 7

def lm_table(rng):
    rows = [(i, words(rng, rng.randint(0, 60)).replace("a", "A")) for i in range(60)] + [(60, None), (61, "x"), (61, "x"), (None, "né b\x0bc"), (62, ""), (63, "<|endoftext|> don't")]
    return [(*r, 1.0) for r in rows]


def test_lm_base_and_coverage(spark, monkeypatch):
    rows = lm_table(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    toks = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [0] for _, t, _ in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    c = collections.Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), h, n) for ws, h in zip(toks, held))
    for frequent in (attention_lm.FREQUENT, 3, 0):  # what is kept in memory changes nothing
        monkeypatch.setattr(attention_lm, "FREQUENT", frequent)
        got = attention_lm.train_and_score(df, queries.tokenizer_path()).collect()
        assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out, r.train_tokens) for r in got) == want
    assert all(r["_score"] < 0 for r in got)
    assert attention_lm.train_and_score(df.limit(0), queries.tokenizer_path()).count() == 0
    none = attention_lm.train_and_score(df.filter("doc_id = 2"), queries.tokenizer_path()).collect() if held[2] else []
    assert all(r.train_tokens == 0 and np.isfinite(r["_score"]) for r in none)


def test_lm_scores_hang_on_no_partition(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "GROUP_IDS", 500)
    monkeypatch.setattr(attention_lm, "BUFFER", 300)
    df = spark.createDataFrame(lm_table(random.Random(8)), "doc_id long, text string, x double")
    score = lambda d: sorted((str(r.doc_id), r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in attention_lm.train_and_score(d, queries.tokenizer_path()).collect())
    want = score(df)
    assert score(df.repartition(7, "x", "text")) == want and score(df.coalesce(1).orderBy("text")) == want


def test_lm_training_takes_each_id_once_at_any_size(spark, monkeypatch):
    taken, add = [], attention_lm.tree_sum

    def noted(parts, n=None, kind="f8"):
        sums = add(parts, n, kind)
        taken.append(sums[-1] if n is not None and len(sums) else 0)
        return sums

    monkeypatch.setattr(attention_lm, "tree_sum", noted)
    df = spark.createDataFrame([(i, f"some words {i} " * 20) for i in range(80)], "doc_id long, text string")
    for n, group_ids in ((40, attention_lm.GROUP_IDS), (80, 300)):  # one group a round, and several
        monkeypatch.setattr(attention_lm, "GROUP_IDS", group_ids)
        taken.clear()
        docs = df.filter(f"doc_id < {n}")
        attention_lm.train_and_score(docs, queries.tokenizer_path())
        # the first sum is that of the ids' counts
        assert len(taken) == 1 + attention_lm.ROUNDS
        taught = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
        assert sum(taken) == len(token_output.encoder(queries.tokenizer_path(), 0, True).arrays(pa.array(taught))[0])


def test_lm_workers_give_memory_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some words {i} " * 20) for i in range(20)], "doc_id long, text string")
    tasks, plain = [], type(df).mapInArrow

    def noted(self, func, schema, *more):
        tasks.append((func, schema))
        return plain(self, func, schema, *more)

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    attention_lm.train_and_score(df, queries.tokenizer_path())
    # words, texts, ids, each round, scores
    assert len(tasks) == 4 + attention_lm.ROUNDS
    for k, (func, _) in enumerate(tasks):
        common.span_hashes(np.zeros(100, np.uint8), np.array([0]), np.array([100]))
        token_output.encoder(queries.tokenizer_path(), 0, True)
        with contextlib.suppress(Exception):  # outside of a task some find no context or weights
            list(func(iter([])))
        assert len(common._powers) == len(common._inverse) == 1, k
        # only between tasks that encode are encoded pieces kept
        assert bool(token_output._encoders) == (k == 1), k
    assert len(common.span_hashes(np.zeros(100, np.uint8), np.array([0]), np.array([100]))) == 1
    # what is free in the middle of the heap goes back, too
    held = [bytes(40_000) for _ in range(3000)]
    held = held[::30]
    anon = lambda: int(re.search(r"Anonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])  # noqa: E731, SIM115
    before = anon()
    attention_lm._give_back()
    assert anon() < before - 50_000, len(held)


def small_model(rng, size=40):
    counts = rng.integers(0, 30, size).astype(float)
    counts[:5] = 0
    v = attention_lm.Vocabulary(counts)
    m = attention_lm.Attention(v)
    texts = [rng.choice(size, rng.integers(1, 70), p=(counts + 0.1) / (counts + 0.1).sum()) for _ in range(60)]
    attention_lm._fit_buffer(m, [v.place[t] for t in texts], 1)
    return v, m, texts


def plain_log_p(v, m, ids, at):
    """ln p of each id after ids[:at], in double precision, one place at a time."""
    w = {k: x.astype(np.float64) for k, x in m.w.items()}
    window = at // attention_lm.HALF
    places = [v.begin, *(int(v.place[i]) for i in ids[:at])]
    context = places[max(0, (window - 1) * attention_lm.HALF) : at + 1]
    e = w["embed"][context]
    far = np.arange(len(context))[::-1]
    s = (e @ w["k"]) @ (e[-1] @ w["q"]) / attention_lm.DIM**0.5 + w["far"][far]
    a = np.exp(s - s.max())
    h = (a / a.sum()) @ (e @ w["v"]) + e[-1] @ w["last"]
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    top, out = soft(w["top"] @ h + w["top_bias"]), np.full(v.size, v.log_unseen)
    for j in range(v.n_classes):
        lo, hi = v.starts[j], v.starts[j + 1]
        out[v.order[lo:hi]] = v.log_seen + top[j] + soft(w["out"][lo:hi] @ h + w["out_bias"][lo:hi])
    return out


def test_lm_score_equals_a_plain_loop_and_sums_to_one():
    rng = np.random.default_rng(9)
    v, m, texts = small_model(rng)
    texts = [*texts[:8], *(rng.integers(0, v.size, n) for n in (1, 15, 16, 17, 32, 33, 100))]
    got = m.score(v.place[np.concatenate(texts)], np.array([len(t) for t in texts]))
    for t, g in zip(texts, got):
        each = [plain_log_p(v, m, t, k) for k in range(len(t))]
        assert g == pytest.approx(sum(x[i] for x, i in zip(each, t)), abs=1e-2, rel=1e-4)
        assert all(np.exp(x).sum() == pytest.approx(1.0) for x in each)


def test_lm_learns_and_its_gradients_are_right():
    rng = np.random.default_rng(10)
    v, m, texts = small_model(rng)
    rows, targets, at, _ = attention_lm.windows_of(np.concatenate([v.place[t] for t in texts]), np.array([len(t) for t in texts]), v)
    x, y = np.concatenate([rows[at], rows[at + 1]], axis=1), targets[at]
    loss = lambda model: sum(model.score(v.place[np.concatenate(texts)], np.array([len(t) for t in texts])))
    fresh = attention_lm.Attention(v)
    assert loss(m) > loss(fresh)
    # a gradient is what Adagrad adds squared
    n, before = ((y >= 0) & (y < v.n)).sum(), m.flat.copy()
    moved = attention_lm.Attention(v, before)
    moved.fit(x, y)
    unseen = sum(v.log_unseen for t in texts for i in t if v.place[i] >= v.n)
    for name in ("q", "k", "v", "last", "far", "embed", "top", "top_bias", "out", "out_bias"):
        g = np.sqrt(np.maximum(moved.g[name].astype(float) - m.g[name], 0))
        place = np.unravel_index(np.argmax(g), g.shape)
        up, down = (attention_lm.Attention(v, before) for _ in "ab")
        up.w[name][place] += 0.02
        down.w[name][place] -= 0.02
        slope = ((loss(up) - unseen) - (loss(down) - unseen)) / 0.04 / n
        assert abs(slope) == pytest.approx(g[place], rel=0.08, abs=2e-4), name


def test_lm_output_takes_few_sums_a_step():
    rng = np.random.default_rng(11)
    counts = rng.permutation(np.floor(1e6 / np.arange(1, 3001)))
    v = attention_lm.Vocabulary(counts)
    width, share = np.diff(v.starts), np.bincount(v.class_of, weights=v.count) / v.count.sum()
    # as many classes as ids of a class, on average
    assert v.n_classes == pytest.approx((width * share).sum(), rel=0.05)
    for bands, most in ((v.bands, 1 + np.log2(width.max() / width.min())), (v.alone, v.n_classes)):
        assert len(bands) <= most
        assert [j for first, end, *_ in bands for j in range(first, end)] == list(range(v.n_classes))
        assert np.array_equal(np.concatenate([ids.ravel()[real] for _, _, ids, _, real in bands]), np.arange(v.n))
    m = attention_lm.Attention(v)
    texts = [rng.choice(3000, 50, p=counts / counts.sum()) for _ in range(30)]
    attention_lm._fit_buffer(m, [v.place[t] for t in texts], 1)
    h, y = np.ones((3000, attention_lm.DIM + 1), np.float32) * 0.3, rng.permutation(v.n)
    alone = m.log_p(h, y)[0]
    assert np.log(np.exp(alone).sum()) == pytest.approx(v.log_seen, abs=1e-3)
    v.alone = v.bands
    assert m.log_p(h, y)[0] == pytest.approx(alone, abs=1e-4)
    # the weights travel once
    raw = pickle.dumps(m)
    assert len(raw) < 1.2 * (m.flat.nbytes + len(pickle.dumps(v)))
    again = pickle.loads(raw)
    assert np.array_equal(again.flat, m.flat) and np.shares_memory(again.w["out"], again.flat)


def test_lm_beats_word_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    r = attention_lm.train_and_score(docs, queries.tokenizer_path()).filter("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "sum(base_score) / sum(n_tokens) AS b").first()
    assert r.s > r.b, r


# --- 8

def test_leaks(spark):
    rng = random.Random(9)
    filler = [words(rng, 300) for _ in range(60)]
    items = [(i, " ".join(f"{words(rng, 1)}q{rng.randint(0, 99)}" for _ in range(n)) + ". " + words(rng, 5) + ".") for i, n in enumerate((12, 30, 50, 130))]
    rows = [(i, t) for i, t in enumerate(filler)]
    for i, t in items:
        ws = t.split()
        rows.append((100 + i, filler[i][:700] + " " + t.upper() + " " + filler[i][700:]))
        rows.append((200 + i, filler[i + 5][:400] + " " + " ".join(w for k, w in enumerate(ws) if k % 12 != 3) + " " + filler[i + 5][400:]))
    rows += [(300, None), (301, "")]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, (9, None), (10, "..")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(b + i, i) for i in range(4) for b in (100, 200)}
    assert decontaminate.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    left = decontaminate.without_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == set(range(60)) | {300, 301}


def test_latent_space_holds_what_a_whole_decomposition_holds(spark):
    """The randomised directions keep nearly all that as many exact singular vectors keep of the passages."""
    rng = random.Random(13)
    topics = [[words(rng, 1) + str(k) for k in range(40)] for _ in range(12)]
    texts = [" ".join(rng.choice(topics[i % 12]) for _ in range(96)) for i in range(80)]
    space = decontaminate.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    h, first = decontaminate.word_ids(pa.array(texts))
    starts, _ = decontaminate._passages(first)
    grid = decontaminate._grid(decontaminate._terms(h), starts)
    df = np.bincount(grid.ravel(), minlength=decontaminate.TERMS + 1)[: decontaminate.TERMS]
    idf = np.log((len(grid) + 1) / (df + 1)) + 0.1
    assert np.allclose(space.idf, idf, atol=1e-5)
    used = np.flatnonzero(df)
    x = np.zeros((len(grid), decontaminate.TERMS + 1))
    np.put_along_axis(x, grid.astype(int), 1.0, axis=1)
    x = x[:, : decontaminate.TERMS]
    x = ((x - np.outer(x.sum(axis=1), df / df.sum())) * idf)[:, used]
    # rows of the space: (loadings x idf - mean); the loadings span what the method keeps
    q, _ = np.linalg.qr(((space.rows[:-1] + space.mean) / idf[:, None])[used])
    _, best, v = np.linalg.svd(x, full_matrices=False)
    # the strong directions (12 topics less their mean) wholly, the flat rest as far as one pass over so few extra directions gets
    assert (np.linalg.norm(v[:11] @ q, axis=1) > 0.95).all()
    assert np.square(x @ q).sum() >= 0.85 * np.square(best[: q.shape[1]]).sum()


def test_leaks_against_all_windows(spark):
    """Items put into texts of the table with up to 3 of 10 words left out: at least 9 of 10 pairs that a look at all windows finds, and no other."""
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text IS NOT NULL")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rng = random.Random(14)
    texts, items = sorted(map(tuple, docs_.collect())), sorted((r.item_id, r.text) for r in bench.collect())[:20]
    rows = {}
    for k, (i, t) in enumerate([x for x in texts if 60 < len(x[1].split()) < 400][:60]):
        ws, item = t.split(), [w for w in items[k % 20][1].split() if rng.random() > (0, 0.1, 0.2, 0.3)[k % 4]]
        at = rng.randint(0, len(ws))
        rows[i] = " ".join(ws[:at] + item + ws[at:])
    df = spark.createDataFrame([(i, rows.get(i, t)) for i, t in texts], "doc_id long, text string")
    space = decontaminate.fit(df)
    want = set()
    for item in decontaminate._items(items, space):
        for i, t in rows.items():
            h, n = decontaminate.word_ids(pa.array([t]))[0].tolist(), len(item.words)
            if any(item.check(h[k : k + 2 * n + 32]) for k in range(0, max(len(h) - n // 2, 1), 4)):
                want.add((i, item.item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id in rows}
    assert len(want) >= 25 and got <= want and len(got) >= 0.9 * len(want), (len(want), want - got, got - want)


def test_leaks_in_a_small_corpus_against_all_windows(spark):
    """Fewer directions than the space could have: what is only rounding must not count as one."""
    rng = random.Random(14)
    items = [(i, " ".join(f"{words(rng, 1)}{rng.randint(0, 30)}" for _ in range(rng.choice([15, 25, 45]))) + ". " + words(rng, 4) + ".") for i in range(12)]
    items.append((3, items[3][1]))  # the same item again
    rows = []
    for i in range(90):
        t = words(rng, rng.randint(0, 250)).split()
        if i % 3 == 0:
            ws = [w for w in items[i % 12][1].split() if rng.random() > rng.choice([0.0, 0.1, 0.3, 0.5])]
            at = rng.randint(0, len(t))
            t[at:at] = ws
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    want = set()
    for item in decontaminate._items(items, decontaminate.fit(df)):
        for i, t in rows:
            h, n = decontaminate.word_ids(pa.array([t]))[0].tolist(), len(item.words)
            if any(item.check(h[k : k + 2 * n + 32]) for k in range(0, max(len(h) - n // 2, 1), 4)):
                want.add((i, item.item_id))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 15 and got <= want and len(got) >= 0.9 * len(want), (len(want), want - got, got - want)


def test_leaks_that_a_third_of_all_texts_hold(spark):
    """An item so common that it is a strong direction of the latent space."""
    rng = random.Random(21)
    items = [(i, " ".join(f"{words(rng, 1)}k{i}" for _ in range(35)) + ".") for i in range(3)]
    rows = [(i, words(rng, 120) + " " + (items[1][1] if i % 3 == 0 else items[2][1] if i == 1 else "") + " " + words(rng, 60)) for i in range(150)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, 1) for i in range(0, 150, 3)} | {(1, 2)}


def test_leaks_of_clashing_names_and_blocks(spark, monkeypatch):
    rng = random.Random(15)
    items = [(i, " ".join(f"{words(rng, 1)}k{i}" for _ in range(30)) + ".") for i in range(5)]
    rows = [(i, items[i][1] if i < 5 else words(rng, 80), 1, 2, 3) for i in range(12)] + [(20, None, 1, 2, 3), (None, items[1][1], 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hit_id int, hit_digest int, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id, round(r.matched, 6)) for r in decontaminate.leaks(df, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(decontaminate, "COSINES", 40)
    assert {(r.doc_id, r.item_id, round(r.matched, 6)) for r in decontaminate.leaks(df, bench).collect()} == one
    left = decontaminate.without_leaks(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {*range(5, 12), 20}
    assert decontaminate.without_leaks(df, bench.limit(0)).count() == len(rows)


def test_tree_sum(spark):
    rows = [(i, (np.arange(5.0) * i).tobytes()) for i in range(300)]
    df = spark.createDataFrame(rows, "part long, v binary").repartition(7)
    assert common.tree_sum(df, 300).tolist() == (np.arange(5.0) * sum(range(300))).tolist()
    assert not len(common.tree_sum(df.limit(0), 300))


# --- 9

def brute_stats(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = collections.Counter(wins)
    hit = {k for i, w in enumerate(wins) if n[w] > 1 for k in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(10)
    texts = [words(rng, 50), " ".join(["a b c d e f g h i"] * 4) + " x", "#*$ é|\n\n é|\n é|\n\x0b", None, "", "a " * 100, "q w e r t y u i\nq w e r t y u i o " * 2]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    stats, names = quality.with_stats(df)
    for r in stats.collect():
        assert tuple(r[names[n]] for n in quality.BASE) == brute_stats(texts[r.doc_id]), texts[r.doc_id]
    assert names["n_words"] == "_n_words"


def test_decision_list():
    rng = random.Random(11)
    rows = []
    for _ in range(900):
        a, b = rng.random(), rng.random()
        rows.append((a, b, (a > 0.7 and b < 0.5) or b > 0.9))
    rules = quality.fit(rows, ("a", "b"))
    wrong = 0
    for _ in range(500):
        a, b = rng.random(), rng.random()
        verdict = next((r.verdict for r in rules.rules if quality._holds((a, b), r.conditions, {"a": 0, "b": 1})), True)
        wrong += verdict == ((a > 0.7 and b < 0.5) or b > 0.9)
    assert wrong < 25 and quality.fit([], ("a", "b")).rules == ()


def test_quality_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (1, "other", "y"), (None, None, None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (7, 0), (1, None)], "doc_id long, quality int")
    assert quality.learn(df, labels).rules == () and quality.learn(df.limit(0), labels).rules == () and quality.learn(df, labels.limit(0)).rules == ()
    rules = quality.DecisionList((quality.Rule((("n_words", ">=", 30.0), ("digit_rate", ">=", 0.0)), False), ))
    out = quality.judge(df, rules)
    assert out.columns[:3] == df.columns and out.columns[-1] == "_kept" and [r["_kept"] for r in out.collect()] == [False] * 4
    assert quality.judge(df.limit(0), rules).count() == 0 and quality.keep(df, rules).columns == df.columns
    # a threshold is met by the value itself, on both sides
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    for op in ("<=", ">="):
        assert not quality.judge(long, quality.DecisionList((quality.Rule((("n_words", op, 30.0),), False),))).first()["kept"]


def test_quality_on_held_out_labels(spark):
    d, l = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality.learn(d, l.filter("doc_id % 2 = 0"))
    out = quality.judge(d.select("doc_id", "text"), rules).join(l.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.95 and bad.kept.mean() < 0.5


# --- 10

PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Menu</a><li><a href=/b>Other</a></ul></nav>
<div id=main><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b> words, long enough to be the article.<p>Second &eacute; paragraph<br>with a break, also long enough.</p><div class="ad">BUY</div><ul><li>one<li>two</ul></article>
<aside>Side</aside><div class="comments"><p>Reader says a long thing that is not the article at all, however long it may go on.</p></div></div><div class="cookie-notice">We use cookies</div><form>Name <input></form><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    want = "Title & more First paragraph with bold words, long enough to be the article. Second é paragraph with a break, also long enough. one two"
    assert html_extract.extract(PAGE) == want
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text"), (5, "u", "<p>unclosed <b>bold <a href='x"), (6, "u", "<" * 50 + '<a "' * 50)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "text")).collect()
    by = {r.page_id: r["_text"] for r in got}
    assert len(got) == 7 and by[1] == want and by[2] == "" and by[3] == "" and by[4] == "plain text"
    assert all(r.n_chars == len(r["_text"]) for r in got)


def page_truths(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    text = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    for url, page in zip(pages.url, pages.html):
        title = html.unescape(re.search(r"(?s)<h1>(.*?)</h1>", page)[1])
        yield page, " ".join((title + " " + text[int(re.search(r"/(\d+)", url.split("//")[1])[1])]).split())


def test_pages_give_their_headline_and_document(spark):
    for page, want in page_truths(spark):
        assert html_extract.extract(page) == want


def test_density_decides(spark, monkeypatch):
    """Without any mark of class or tag, density alone finds the article of 19 pages in 20; without density, the body is none."""
    pages = list(page_truths(spark))
    monkeypatch.setattr(html_extract, "DOUBT", 1.0)
    assert sum(html_extract.extract(page) == want for page, want in pages) > 0.95 * len(pages)
    monkeypatch.undo()
    monkeypatch.setattr(html_extract, "content_of", lambda root: (next(x for x in html_extract._walk(root) if x.tag == "body"), 0.0))
    assert not any(html_extract.extract(page) == want for page, want in pages)


def test_density_against_its_definition():
    """Counts, densities and sums by plain recursion over a tree of another parser."""
    import xml.etree.ElementTree as ET

    page = "<html><body><div><p>one two three</p><ul><li><a>x</a></li><li><a>yy</a> z</li></ul>tail</div><p>Longer text <b>in</b> a paragraph</p><a>link</a></body></html>"
    count = lambda t: len((t or "").replace(" ", ""))
    body = ET.fromstring(page)[0]

    def chars(x):
        return count("".join(x.itertext()))

    def linked(x):
        return sum(chars(c) if c.tag == "a" else linked(c) for c in x)

    def links(x):
        return sum((c.tag == "a") + links(c) for c in x)

    def tags(x):
        return sum(1 + tags(c) for c in x)

    def density(c, l, t, lt):
        if not c:
            return 0.0
        base = np.log(c / max(c - l, 1) * l + linked(body) / chars(body) * c + np.e)
        return c / max(t, 1) * max(np.log(c / max(l, 1) * max(t, 1) / max(lt, 1)) / np.log(base), 0)

    of = lambda x: density(chars(x), linked(x), tags(x), links(x))
    nodes = html_extract._walk(html_extract.parse(page))
    html_extract._measure(nodes, next(x for x in nodes if x.tag == "body"))
    mine = collections.Counter((x.tag, round(x.density, 9), round(x.total, 9)) for x in nodes if x.tag not in ("#root", "html"))
    plain = collections.Counter((x.tag, round(of(x), 9), round(sum(map(of, x)) + density(count(x.text) + sum(count(c.tail) for c in x), 0, 1, 0), 9)) for x in body.iter())
    assert mine == plain


@pytest.mark.parametrize("wrapper", ["content no-sidebar", "has-sidebar", "with-comments", "search-result", "sidebar", "footer-above", "post"])
def test_marks_around_an_article_say_nothing(wrapper):
    text = "First paragraph with quite a few words in it, enough to be read. "
    page = f'<body><header><h1>Site</h1></header><div class="{wrapper}"><header><h1>Head</h1></header><div class="x"><p>{text * 3}</p><p>Of.</p></div></div><div id="comments"><p>{text * 9}</p></div><footer>About {text}</footer></body>'
    got = html_extract.extract(page)
    assert got.startswith(("Head First", "First")) and got.endswith("read. Of.") and "About" not in got and got.count("First") == 3


def test_page_tables_of_any_shape(spark):
    got = html_extract.main_text(spark.createDataFrame([], "page_id long, html string, n_chars int"))
    assert got.columns == ["page_id", "html", "n_chars", "text", "_n_chars"] and got.count() == 0
    long = "<body><nav><a href=/>x</a></nav><article>" + "<p>some words of a paragraph</p>" * 50_000 + "</article></body>"
    assert html_extract.extract(long) == " ".join(["some words of a paragraph"] * 50_000)
    deep = "<body>" + "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    assert html_extract.extract(deep) == "deep text"
    tie = "<body><div><p>same words here</p></div><div><p>same words here</p></div></body>"
    assert html_extract.extract(tie) == "same words here same words here"


# --- odd tables, one for each operator: nulls in every column, empty, repeated and very long texts, ties, names that clash, no rows

LONG = "\n".join(f"line {i} of a text that is long " + "x" * (i % 50) for i in range(40_000))
ODD_DOCS = [(None, None, None), (1, None, "a"), (2, "", None), (3, "a b", "a"), (3, "a b", "a"), (None, "c d e", "b"), (None, "c d e", "b"), (7, LONG, "a"), (8, " \n\t", "b"), (9, LONG, "b")]


def odd(spark, extra):
    names = extra.split()
    return spark.createDataFrame([(*r, *range(len(names))) for r in ODD_DOCS], DOCS + "".join(f", {n} int" for n in names))


def test_odd_urls(spark):
    long = "http://a.example.net/en/" + "x/" * 200_000
    rows = [(i, u, 1, None) for i, u in enumerate([None, "", "://", "http://", long, long, "http://EXAMPLE.com/de/", "x://net", "http://net?/", "http://casino.x/"])]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict int, url_place int")
    got = url_filter.judge(df, queries.url_rules())
    assert got.columns == ["page_id", "url", "verdict", "url_place", "host", "path", "rule", "pattern", "_verdict"]
    by = {r.page_id: (r.host, r.rule, r["_verdict"]) for r in got.collect()}
    assert by[0] == by[1] == by[2] == ("", None, "allow") and by[4] == by[5] == ("a.example.net", "example.net/en/", "allow")
    # a rule's path begins with a slash, which an empty path has not
    assert by[6] == ("example.com", "example.com/de/", "block") and by[7][1] is None and by[8][1] is None and by[9] == ("casino.x", None, "block")
    assert url_filter.judge(df.limit(0), queries.url_rules()).count() == 0 and url_filter.judge(df, []).count() == len(rows)
    # of rules alike the longest wins, of equally long ones the block, then the first
    tie = [url_filter.Rule("||a.b/", "allow", "one"), url_filter.Rule("||a.b/", "block", "two"), url_filter.Rule("||a.b/", "block", "three")]
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string"), tie).first()["rule"] == "two"


def test_odd_lines(spark):
    got = line_dedup.dedup_lines(odd(spark, "r_id r_lines digest kept_text"))
    assert got.columns[-4:] == ["_kept_text", "n_lines", "n_removed_lines", "n_removed_chars"]
    rows = got.collect()
    assert len(rows) == len(ODD_DOCS) and line_dedup.dedup_lines(odd(spark, "").limit(0)).count() == 0
    long = {r.doc_id: r for r in rows if r.doc_id in (7, 9)}
    # the text stands twice: it stays in the first document and goes from the second
    assert long[7]["_kept_text"] == LONG and long[7].n_lines == 40_000 and long[9].n_removed_lines == 40_000 and long[9]["_kept_text"] == ""
    assert [r["_kept_text"] for r in rows if r.doc_id == 3] == ["a b"] * 2 and all(r["_kept_text"] is None for r in rows if r.text is None)


def test_odd_chats(spark):
    rows = [(None, None, None, None, 1), (1, 1, "user", "hi", 1), (1, 1, "user", "hi", 1), (1, None, "Assistant", "", 1), (2, 5, "user", LONG, 1), (2, 6, "assistant", LONG, 1), (3, 1, "", None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action int")
    out = chat.format_chats(df)
    assert out.columns == ["conv_id", "turn", "role", "text", "action", "position", "new_role", "_action", "rendered"]
    got = out.collect()
    assert len(got) == len(rows) and chat.format_chats(df.limit(0)).count() == 0
    whole = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position))
    assert whole.count(LONG) == 2 and re.findall(r"<\|(user|assistant)\|>", whole) == ["user", "assistant"]


def test_odd_tokens(spark):
    df = odd(spark, "start n_tokens ids")
    _, shards = token_output.write_shards(df, queries.tokenizer_path(), n_shards=3)
    got = token_output.read_shards(spark, shards, with_ids=True).collect()
    e = token_output.ChunkEncoder(queries.tokenizer_path(), 1)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == collections.Counter((i, e.encode([t])[0]) for i, t, _ in ODD_DOCS)
    _, none = token_output.write_shards(df.limit(0), queries.tokenizer_path())
    assert none == [] and token_output.read_shards(spark, none).count() == 0


def test_odd_near_duplicates(spark):
    got = order_minhash.classes(odd(spark, "digest class_id class_size rid"))
    rows = got.drop("digest").collect()
    assert got.columns == ["doc_id", "digest", "class_id", "class_size"]
    # 7 and 9 are copies; texts without words are copies only of equal bytes (null: empty); null ids name no class that has another
    want = [(None, 1, 3), (1, 1, 3), (2, 1, 3), (3, 3, 2), (3, 3, 2), (None, None, 2), (None, None, 2), (7, 7, 2), (9, 7, 2), (8, 8, 1)]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_odd_scores(spark):
    got = attention_lm.train_and_score(odd(spark, "held_out n_known lm_row lm_ids rare_row"), queries.tokenizer_path())
    rows = got.collect()
    assert "text" not in got.columns and got.columns[-6:] == ["_held_out", "train_tokens", "n_tokens", "_n_known", "base_score", "score"]
    assert len(rows) == len(ODD_DOCS) and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (7, 9)} == {len(LONG.split()) + 1} and {r.n_tokens for r in rows if r.doc_id in (1, 2, 8)} == {1}
    same = collections.defaultdict(set)
    for (i, t, _), r in zip(sorted(ODD_DOCS, key=str), sorted(rows, key=lambda r: str((r.doc_id, next(t for j, t, _ in ODD_DOCS if j == r.doc_id and (r.n_tokens > 1) == bool((t or "").split())), r.source)))):
        same[r.doc_id, r.n_tokens].add(round(r.score, 6))
    assert all(len(v) == 1 for v in same.values())


def test_odd_mix(spark):
    got = mixing.mix(odd(spark, "mix_key mix_id copies")).collect()
    assert len(got) == len(ODD_DOCS) and all(r.taken <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (7, 9)} == {len(LONG.split())}
