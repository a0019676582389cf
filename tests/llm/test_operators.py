"""Each operator against a plain version, and on odd rows."""

import hashlib
import html
import itertools
import math
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import (
    op1_license,
    op2_packing,
    op3_secrets,
    op4_neardup,
    op5_embeddings,
    op6_decontaminate,
    op7_toxicity,
    op8_html,
    op9_quality,
    op10_language,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, fp string, label string"
LONG = "many words of one text that never ends " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated rows, a null key, and columns with clashing names."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, LONG), (6, "one two"), (6, "one two"), (7, "ONE two"), (None, "no key here at all, but words"), (8, "a" * 50_000), (9, "### !!")]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 3, "x", "y") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def empty(df):
    return df.where("false")


# 1


def test_license_finds_what_plain_containment_finds(spark, sf, docs):
    made = [(n, set(op1_license.shingles(op1_license.words(t)))) for n, ts in op1_license.TEMPLATES.items() for t in ts]
    got = {r.doc_id: r for r in op1_license.query(spark, sf).collect()}
    found = 0
    for i, text in docs.items():
        s = set(op1_license.shingles(op1_license.words(text)))
        want = {n for n, t in made if len(s & t) >= 0.8 * len(t)}
        names = set(filter(None, got[i].licenses.split(",")))
        assert names <= want and bool(names) == bool(want)
        found += bool(names)
    assert found and len(got) == len(docs)


def test_license_spans_long_templates_and_odd_rows(spark, odd):
    mit = op1_license.TEMPLATES["MIT"][2]
    df = spark.createDataFrame([(1, f"before {mit} after"), (2, "x " * 500 + mit.replace("copies of the Software", "copies of it")), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    rows = {r.doc_id: r.matches for r in op1_license.scan(df).collect()}
    assert [m.license for m in rows[1]] == ["MIT"] and rows[1][0].start == 1 and rows[1][0].containment == 1
    assert {m.license for m in rows[2]} == {"MIT"} and {m.license for m in rows[3]} == {"CC-BY-NC-4.0"}
    out = op1_license.scan(odd).collect()
    assert len(out) == 11 and not any(r.matches for r in out)
    assert op1_license.scan(empty(odd)).count() == 0


def test_license_of_whole_license_texts(spark, tmp_path):
    """Templates of thousands of words, from files, against plain containment; the expression's operators stay as they are."""
    rng = np.random.default_rng(8)
    makes = {f"L{k}": " ".join(f"w{x}" for x in rng.integers(0, 900, 3000)) for k in range(4)}
    for name, text in makes.items():
        (tmp_path / f"{name}.txt").write_text(text)
    templates = op1_license.read_templates(spark, str(tmp_path))
    assert templates == {k: [v] for k, v in makes.items()}
    w = makes["L1"].split()
    texts = {1: makes["L0"], 2: "head " * 50 + " ".join(x for i, x in enumerate(w) if i % 60), 3: " ".join(w[:2000]), 4: makes["L2"] + " between " * 9 + makes["L3"], 5: " ".join(w[:1500] + ["new"] * 200 + w[1500:])}
    want = {}
    for i, t in texts.items():
        s = set(op1_license.shingles(op1_license.words(t)))
        want[i] = {n for n, x in makes.items() for k in [set(op1_license.shingles(op1_license.words(x)))] if len(s & k) >= 0.8 * len(k)}
    found = {r.doc_id: r.matches for r in op1_license.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), templates).collect()}
    assert {i: {m.license for m in ms} for i, ms in found.items()} == want == {1: {"L0"}, 2: {"L1"}, 3: set(), 4: {"L2", "L3"}, 5: {"L1"}}
    assert (found[2][0].start, found[4][1].start, found[4][1].end) == (50, 3009, 6009)
    assert op1_license.matches(makes, "text").count("transform(") == op1_license.matches(dict(list(makes.items())[:1]), "text").count("transform(")


# 2


def test_packing_round_trip(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    rows = op2_packing.pack(odd.repartition(2)).collect()
    want = defaultdict(int)
    for r in odd.collect():
        want[r.doc_id, tuple(coder.encode(r.text or "", add_special_tokens=False).ids + [0])] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *itertools.accumulate(r.length for r in s)][:-1]
        assert sum(r.length for r in s) <= 1024
    for (key, ids), n in want.items():
        mine = sorted((r.start, tuple(r.ids)) for r in pieces[key])
        assert all(ids[a : a + len(x)] == x for a, x in mine)
        assert sum(len(x) for _, x in mine) == n * len(ids)
    assert op2_packing.pack(empty(odd)).count() == 0


def test_packing_pads_little(spark, sf):
    rows = op2_packing.query(spark, sf).groupBy("sequence_id").sum("length").collect()
    used = [r[1] for r in rows]
    assert 1 - sum(used) / sum(u if u & (u - 1) == 0 else 1024 for u in used) < 0.02


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.sets(st.integers(1, 100), max_size=6))
def test_packing_cost_is_least(lengths, sentences):
    size, total = 16, sum(lengths)
    ends = np.cumsum(lengths)
    sentences = np.array(sorted(x for x in sentences if x < total), int)
    cuts, cost = op2_packing.best_cuts(total, ends[:-1], sentences, size)
    points = sorted({0, total, *ends.tolist(), *sentences.tolist(), *range(0, total, 16)})
    f = {0: 0.0}
    for p in points[1:]:
        pen = 0 if p == total or p in ends else op2_packing.SENTENCE if p in sentences else op2_packing.INSIDE
        f[p] = min(f[q] + size - (p - q) for q in points if q < p and p - q <= size and q in f) + op2_packing.WINDOW + pen
    assert cost == f[total] and cuts[-1] == total and all(0 < b - a <= size for a, b in zip([0, *cuts], cuts, strict=False))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_the_two_tokenizers_agree(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    encode, _ = op2_packing.encoder()
    assert (encode(text).tolist() if text else []) == coder.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 300_000, " \n" * 100_000, "x <|endoftext|>" + " " * 1_000_000 + "<|endoftext|>"])
def test_texts_on_which_one_tokenizer_gives_up(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    encode, _ = op2_packing.encoder(path("byte_bpe_50k.json"))
    assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_packing_knows_added_tokens(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "one.  <|endoftext|><|endoftext|>\n two", "<|endoftext", "x <|endoftext|>" + " " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = defaultdict(list)
    for r in sorted(op2_packing.pack(df).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(found[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found[r.doc_id] += r.ids
    assert found == {i: coder.encode(x).ids + [0] for i, x in enumerate(texts)}
    assert found[0].count(50256) == 1 and len(found[0]) == 5


# 3


def plain_base(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (p, n, name) in enumerate([(r"AKIA[A-Z0-9]+", 16, "access"), (r"[0-9a-f]+", 32, "hex")], 1):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(p, text) if len(m[0]) >= n]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(out)]


def test_secrets_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_secrets.query(spark, sf).collect()
    assert sum(r.n_assign for r in rows)
    for r in rows:
        want = plain_base(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k + ":") for w in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(","))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "api_key", "é", "😀", " = ", ":", '"', "AKIA", "Z9" * 8, "deadbeef" * 4, "x1y2z3w4", "ſecret", " "]), max_size=10).map("".join))
def test_secrets_base_on_any_text(text):
    assert [f"{k}:{a}:{b}" for a, b, k in op3_secrets.find(text) if k != "guess"] == plain_base(text)


def test_guess_cost():
    cost = op3_secrets.guess_cost
    assert cost("password") < 1 < cost("password2019") < 9 and cost("aaaaaaaaaaaa") < 5 and cost("qwertyuiop") < 5
    assert cost("kX9#vQ2$mZ7!") > 15 and cost("") == 0
    assert [k for *_, k in op3_secrets.find("db_pwd: kX9#vQ2$mZ7!")] == ["guess"]
    assert not op3_secrets.find("db_pwd: changeme2024")
    assert not op3_secrets.find("author: Featherstonehaugh") and not op3_secrets.find("secretary: Featherstonehaugh")


def test_secrets_under_long_names():
    value = "kX9#vQ2$mZ7!"
    for name in ("DB_PASSWORD_PRODUCTION_READ_REPLICA: ", "SECRET_KEY_FOR_PRODUCTION_DATABASE=", "token_for_the_staging_cluster = ", f"my-auth-{'x1_' * 1000}=> ", f"{'x1_' * 1000}token: "):
        assert op3_secrets.find(name + value) == [(len(name), len(name) + len(value), "guess")]
    assert not op3_secrets.find(f"authoring_guide_for_the_new_editors: {value}")
    assert not op3_secrets.find("token_" * 100_000 + " " + value)  # far beyond any test's patience if time were quadratic


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKENS", "secretary", "authKey", "api_key", "x", "_", "-", "S", "é", " ", "\t", ":", "=", "=>", "\"", "'", "\n", "kX9#vQ2$", "abcdef1"]), max_size=16).map("".join))
def test_secrets_context_is_that_of_every_word(text):
    word = r"(?:passphrase|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?(?-i:(?![a-z]))[A-Za-z0-9_-]*"
    value = r"""["']?[ \t]*(?:[:=]|=>|:=)[ \t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|`([^`\r\n]+)`|([^\s"'`,;<>]+))"""
    plain = re.compile(word + value, re.ASCII | re.IGNORECASE)
    assert [m.regs[1:] for m in op3_secrets.CONTEXT.finditer(text)] == [m.regs[1:] for m in plain.finditer(text)]


def plain_cost(s):
    """The least over all segmentations, each segment by its own definition."""
    low, plain, n = s.lower(), s.lower().translate(op3_secrets.LEET), len(s)
    size = sum(k for r, k in op3_secrets.BRUTE if r.search(s)) + 33 * bool(re.search(r"[^0-9A-Za-z]", s))
    char = math.log10(max(size, 10))

    def segments(i, j):
        part, first = s[i:j], math.log10(2) * (i > 0)
        if j == i + 1:
            yield 0.5 if part in " _-." else char
        if low[i:j] in op3_secrets.RANK:
            yield first + op3_secrets.RANK[low[i:j]] + 0.3 * (part != low[i:j])
        elif plain[i:j] in op3_secrets.RANK:
            yield first + op3_secrets.RANK[plain[i:j]] + 0.6
        if (m := op3_secrets.DATE.match(s, i)) and m.end() == j:
            yield first + (math.log10(36500) if j - i > 4 else 2.0)
        for unit in range(1, min(64, (j - i) // 2) + 1):
            if j - i >= 3 and part == part[:unit] * ((j - i) // unit) and (j + unit > n or s[j : j + unit] != part[:unit]):
                yield first + unit * char + math.log10((j - i) // unit)
        steps = [(b[0] - a[0], b[1] - a[1]) if op3_secrets.near(x, y) else None for x, y in itertools.pairwise(low[i:j]) for a, b in [(op3_secrets.PLACE.get(x), op3_secrets.PLACE.get(y))]]
        if 3 <= j - i <= len(op3_secrets.PLACE) and None not in steps:
            turns = 1 + sum(a != b for a, b in itertools.pairwise(steps))
            yield first + math.log10(len(op3_secrets.PLACE) * (j - i)) + turns * math.log10(4)
        ups = {ord(y) - ord(x) for x, y in itertools.pairwise(part)}
        if j - i >= 3 and ups in ({1}, {-1}) and (j == n or ord(s[j]) - ord(s[j - 1]) not in ups):
            yield first + math.log10(124 * (j - i))

    best = [0.0]
    for j in range(1, n + 1):
        best.append(min(best[i] + c for i in range(j) for c in segments(i, j)))
    return best[n]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "qwe", "2024-01-02", "1999", "password", "P@ss", "zz", "X", "abcd", "9876", "-", " ", "x7q", "x7q"]), max_size=8).map("".join))
def test_guess_cost_is_the_least(value):
    assert abs(op3_secrets.guess_cost(value) - plain_cost(value)) < 1e-9


def test_secrets_of_any_writing_and_by_a_dictionary(spark):
    for text, value in [
        ("password = \"it's!kX9#vQ2$mZ7\"", "it's!kX9#vQ2$mZ7"),
        ("password=kX9(vQ2)mZ7!aa", "kX9(vQ2)mZ7!aa"),
        ("(pwd: kX9#vQ2$mZ7!)", "kX9#vQ2$mZ7!"),
        ("pwd=aB3$x", "aB3$x"),
        ("auth: `x\"y'zK9#vQ2$`", "x\"y'zK9#vQ2$"),
    ]:
        assert [text[a:b] for a, b, k in op3_secrets.find(text) if k == "guess"] == [value]
    for text in ("auth = getAuth(arg)", "pwd: ${VAULT_KEY}", "pwd = config[1]", "pwd=$HOME", "pwd: x7kq"):
        assert not op3_secrets.find(text)
    assert op3_secrets.guess_cost("x7!kq" * 3) < 11
    text = "auth: required-for-everyone"
    df = spark.createDataFrame([(i, f"it is required for work {i}, by everyone") for i in range(9)] + [(9, text), (10, None)], "doc_id long, text string")
    words = op3_secrets.dictionary(df)
    assert {r.word: r.n for r in words.collect()}["everyone"] == 10
    found = {r.doc_id: r.found for r in op3_secrets.scan(df, words=words).collect()}
    assert not found[9] and op3_secrets.scan(df).where("size(found) > 0").count() == 1
    assert op3_secrets.redact(df, words=words).exceptAll(df).count() == 0 and op3_secrets.dictionary(empty(df)).count() == 0


def test_guess_cost_of_whole_values():
    low = "password" * 9 + "aaaa" * 5_000  # much of a value costs little; its end decides
    assert op3_secrets.guess_cost(low, 30.0) < 30.0 <= op3_secrets.guess_cost(low + "kX9#vQ2$mZ7!kX9#vQ2$mZ7!", 30.0)
    text = "api-key: '" + "kX9#vQ2$mZ7! " * 400 + "'"
    assert [(a, b, k) for a, b, k in op3_secrets.find(text)] == [(10, len(text) - 1, "guess")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "qwe", "2024-01-02", "password", "P@ss", "zz", "X", "abcdef", "9876", "İ"]), max_size=12).map("".join), st.floats(0, 30))
def test_guess_cost_bound(value, enough):
    whole, bound = op3_secrets.guess_cost(value), op3_secrets.guess_cost(value, enough)
    assert bound <= whole and (bound >= enough) == (whole >= enough)


def test_secrets_odd_rows_and_redaction(spark, odd):
    found = {r.doc_id: r.found for r in op3_secrets.scan(odd).collect()}
    assert [k for k, v in found.items() if v] == [8] and [(x.start, x.end, x.kind) for x in found[8]] == [(0, 50_000, "hex")] and op3_secrets.scan(empty(odd)).count() == 0
    df = spark.createDataFrame([(1, 'token = "abcdef0123456789" é', "x")], "doc_id long, text string, found string")
    out = op3_secrets.redact(df).first()
    assert out.text == 'token = "[SECRET]" é' and out.found == "x"
    assert [r.text for r in op3_secrets.redact(odd).exceptAll(odd).collect()] == ["[SECRET]"]


# 4


def plain_components(rows, per=85):
    sets = {}
    for k, t in rows:
        w = t.encode().translate(op4_neardup.TABLE).split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= per * len(x | y):
            p, q = sorted((root(a), root(b)))
            up[q] = p
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_neardup_finds_all_components(spark, sf, docs):
    want = plain_components(docs.items())
    rows = op4_neardup.query(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_neardup_of_a_large_ambiguous_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    want = plain_components(rows)
    got = op4_neardup.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 1


@pytest.mark.parametrize("homes, copies", [(0, op4_neardup.BLOCKS + 2), (1, 1.1)])
def test_neardup_sends_a_row_so_often_whatever_its_group(spark, monkeypatch, homes, copies):
    """Two buckets of the same 100,000 texts without a link: no copies by the square of the size, and none where all rows meet elsewhere."""
    n, sent = 100_000, []
    monkeypatch.setattr(op4_neardup, "dealt", lambda df, rows, by, each: sent.append((rows, df.count())) or df.limit(0))
    rows = spark.range(n).selectExpr("id as bk", "cast(cast(id as string) as binary) as fp", "100L as n", f"array_repeat(0L, {op4_neardup.LONGS}) as sig", "array_repeat(0L, 16) as bands", "1L as home")
    rows = rows.withColumn("label", rows.fp).withColumn("bk", rows.n * 0 + (1 if not homes else 2))
    if homes:  # a few that are not in the other bucket
        rows = rows.selectExpr("bk", "fp", "n", "sig", "bands", "if(hash(fp) % 1000 = 0, 2L, home) as home", "label")
    for mode in ("nearest", "open"):
        op4_neardup.across(rows, mode, 85, 100, op4_neardup.Workspace(spark))
    assert all(x == y and n <= x <= copies * n for x, y in sent) and len(sent) == 2


def test_neardup_odd_rows(odd):
    rows = {}
    for r in op4_neardup.components_of(odd).collect():
        rows.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert rows[1] == [(0, 1, True)] and rows[2] == [(0, 2, True)] and rows[3] == [(0, 3, True)]
    assert rows[5][0][1:] == (4, False) and rows[7] == [(1, 6, False)] and len(rows[6]) == 2
    assert rows[None][0][1] is None
    kept = op4_neardup.distinct_documents(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 9]
    assert op4_neardup.components_of(empty(odd)).count() == 0 == op4_neardup.distinct_documents(empty(odd)).count()


def test_bbit_estimate_is_corrected():
    a, b = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(600, 4600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x, y = op4_neardup.packed(op4_neardup.minima(a)).view(np.uint64), op4_neardup.packed(op4_neardup.minima(b)).view(np.uint64)
    z = x ^ y
    equal = op4_neardup.HASHES - int(np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(int("5" * 16, 16))).sum())
    assert abs(op4_neardup.estimate(equal) - 3400 / 4600) < 0.12


# 5


def test_embeddings_recall_counts_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 16))
    rows = []
    for i in range(600):
        v = base[0] if i % 3 == 0 else base[i % 60]
        rows.append((i, [float(x) for x in v + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.35])], i % 2))
    rows += [(1000, rows[0][1], 0), (1001, None, 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [None] + [1.0] * 15, 0), (1005, [1.0] * 3, 0)]
    got = op5_embeddings.link_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")).collect()
    assert len(got) == len(rows)
    good = [(i, np.float32(v)) for i, v, _ in rows[:601]]
    x = np.array([v for _, v in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = {good[k][0]: int(link[k].sum()) for k in range(601)}
    mine = {r.vec_id: r.n_links for r in got}
    assert all(mine[i] <= n for i, n in want.items()) and sum(mine[i] for i in want) >= 0.95 * sum(want.values())
    assert all(mine[i] == 0 for i in (1001, 1002, 1003, 1004, 1005))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert op5_embeddings.link_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    turn = [(k, [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]) for k, a in enumerate([0.0, np.arccos(0.9) - 1e-12, -np.arccos(0.9) - 1e-10])]
    double = op5_embeddings.link_components(spark.createDataFrame(turn, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in double} == {0: (1, 0), 1: (1, 0), 2: (0, 2)}


def test_embeddings_of_any_width_and_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [5e-324, 0.0]), (4, [1.0]), (5, [7.0]), (6, [-2.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 1.0, 1.01]), (9, None), (10, [0.0]), (None, [3.0]), (12, [float("inf")]), (13, [1.0, 1.0, 1.0]), (14, [0.0, 1.0])]
    got = op5_embeddings.link_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (2, 4), 5: (2, 4), None: (2, 4), 6: (0, 6), 7: (2, 7), 8: (2, 7), 13: (2, 7), 9: (0, 9), 10: (0, 10), 12: (0, 12), 14: (0, 14)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(rows)


def test_embeddings_in_blocks(spark, monkeypatch):
    """Many cells, blocks of a hot cell, and two widths, against brute force."""
    for name, value in {"CELL": 60, "ONCE": 64, "BLOCK": 16, "BLOCK_MOST": 64}.items():
        monkeypatch.setattr(op5_embeddings, name, value)
    rng = np.random.default_rng(11)
    base = {w: rng.standard_normal((40, w)) for w in (8, 12)}
    rows = []
    for i in range(1500):
        w = 8 if i % 4 else 12
        v = base[w][0 if i % 3 == 0 else int(rng.integers(40))]
        rows.append((i, [float(x) for x in v + rng.standard_normal(w) * 0.15]))
    want = {}
    for w in (8, 12):
        x = op5_embeddings.unit(np.array([v for _, v in rows if len(v) == w]))
        link = x @ x.T >= 0.9
        np.fill_diagonal(link, False)
        want |= dict(zip([i for i, v in rows if len(v) == w], link.sum(1).tolist(), strict=True))
    got = {r.vec_id: r for r in op5_embeddings.link_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()}
    assert all(got[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(want.values())
    assert all(got[r.component_id].kept and r.component_id <= i for i, r in got.items())


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    x = op5_embeddings.unit(rng.standard_normal((300, 8)))
    index = op5_embeddings.Index(x, 8)
    got = index.order(x[:20], 12)
    d = op5_embeddings.distances(x[:20, :4], index.a)[:, :, None] + op5_embeddings.distances(x[:20, 4:], index.b)[:, None, :]
    full = np.sort(d.reshape(20, -1), 1)[:, :12]
    assert np.allclose(np.take_along_axis(d.reshape(20, -1), got, 1), full)


# 6


def plain_hits(text, items, window=13):
    ws = op6_decontaminate.words(text)
    hit, found = set(), set()
    for name, it in items:
        grams = {tuple(it[i : i + window]) for i in range(len(it) - window + 1)} if len(it) >= window else {tuple(it)} if it else set()
        for g in grams:
            for i in range(len(ws) - len(g) + 1):
                if tuple(ws[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(name)
    return len(ws), len(hit), found


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=60))
def test_automaton_equals_plain_search(items, text):
    items = [(str(i), [w.encode() for w in it]) for i, it in enumerate(items)]
    spans, found = op6_decontaminate.Automaton(items, 4).scan([w.encode() for w in text])
    _, hit, names = plain_hits(" ".join(text).encode(), items, 4)
    assert found == names and sum(b - a for a, b in spans) == hit


def test_decontamination_query(spark, sf, docs):
    items = [(str(r.item_id), op6_decontaminate.words((r.text or "").encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {g for _, it in items for g in ([tuple(it[i : i + 13]) for i in range(len(it) - 12)] if len(it) >= 13 else [tuple(it)])}
    assert grams
    rows = op6_decontaminate.query(spark, sf).collect()
    assert any(r.contaminated for r in rows)
    for r in rows[::5] + [r for r in rows if r.n_hit][:10]:
        n, hit, found = plain_hits(docs[r.doc_id].encode(), items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_in_blocks_and_odd_rows(spark, sf, odd):
    documents, benchmark = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a = op6_decontaminate.hits(documents, benchmark).select("doc_id", "__n", "__spans", "__items").collect()
    b = op6_decontaminate.hits(documents, benchmark, block=700).select("doc_id", "__n", "__spans", "__items").collect()
    assert sorted(a) == sorted(b)
    short = spark.createDataFrame([(1, "one two"), (2, None), (3, "!!")], "item_id long, text string")
    rows = {(r.doc_id, r.text): r for r in op6_decontaminate.hits(odd, short).collect()}
    assert rows[7, "ONE two"]["__spans"] == [[0, 2]] and rows[1, None]["__n"] == 0
    kept = op6_decontaminate.remove_spans(odd, short)
    assert kept.columns == odd.columns and kept.count() == 8
    assert op6_decontaminate.remove_spans(odd, empty(short)).exceptAll(odd).count() == 0


def test_decontamination_and_near_copies_take_any_names(spark):
    names = "doc_id long, text string, __n string, __spans string, __items int, __fp string, __component long, __again boolean, __FP_1 int"
    long_ = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, "n", "s", 1, "f", 2, True, 3) for i, t in enumerate([long_, long_ + " more", "one two", None])]
    df = spark.createDataFrame(rows, names)
    benchmark = spark.createDataFrame([("a", "one two"), ("b", " ".join(f"w{i}" for i in range(3, 16)))], "item_id string, text string")
    for block in (1000, 5):  # in one pass, and in several
        found = {r.doc_id: r for r in op6_decontaminate.hits(df, benchmark, block=block, out=("n1", "s1", "i1")).collect()}
        assert found[0].s1 == [[3, 16]] and found[2].i1 == ["a"] and found[3].n1 == 0 and found[0]["__n"] == "n"
    out = op6_decontaminate.remove_spans(df, benchmark)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()}[0].split() == [f"w{i}" for i in range(40) if not 3 <= i < 16]
    kept = op4_neardup.distinct_documents(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]


# 7, 9, 10


def labelled(spark, n, make):
    rows = [(i, *make(i)) for i in range(n)]
    return spark.createDataFrame([(i, t, None, "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string"), spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int"), {i: y for i, _, y in rows}


def test_toxicity_learns_words_and_finds_sentences(spark, odd):
    rng = np.random.default_rng(2)

    def make(i):
        ws = [f"word{rng.integers(80)}" for _ in range(60)]
        y = int(i % 4 == 0)
        if y:
            ws[int(rng.integers(60))] = "nasty" + str(rng.choice(["", "er", "est"]))
        return " ".join(ws[:20]) + ". " + " ".join(ws[20:40]) + ". " + " ".join(ws[40:]), y

    documents, labels, y = labelled(spark, 400, make)
    model = op7_toxicity.train(documents, labels)
    rows = op7_toxicity.score(documents, model).collect()
    assert np.mean([(r.score >= 0.3) == y[r.doc_id] for r in rows]) > 0.98
    text = {r.doc_id: r.text for r in documents.collect()}
    assert all("nasty" in text[r.doc_id][s.start : s.end] for r in rows for s in r.sentences)
    out = {r.doc_id: r.score for r in op7_toxicity.score(odd, model).collect()}
    assert out[1] == out[2] == 0 and all(0 <= s <= 1 for s in out.values())
    nothing = op7_toxicity.train(documents, empty(labels))
    assert op7_toxicity.score(odd, nothing).count() == 11


def test_toxicity_is_the_noisy_or_of_distinct_sentences():
    model = op7_toxicity.Model({"bad": 9.0, "wor-": 5.0, "worse": 3.0}, -8.0)

    def plain(text):
        clean = 1.0
        for s in {frozenset(re.findall(r"[^\W\d_]+", a)) for a in re.split(r"[.!?]+\s|\n", text.lower())} - {frozenset()}:
            known = {t for w in s for t in [w, *(w[:k] + "-" for k in (3, 4, 5, 6) if len(w) > k)]}
            p = 1 / (1 + np.exp(8.0 - sum(model.weights.get(t, 0) for t in known)))
            clean *= 1 - p if p >= op7_toxicity.FLOOR else 1
        return 1 - clean

    for text in ("", "123\n45", "a bad day", "a bad day. a bad day. worst of all", "Worse!\nworse. BAD? x", "fine.\n" * 50 + "worse"):
        assert abs(model.score(text) - plain(text)) < 1e-12
    neutral = model.score("a plain line of text. " * 10_000), model.score(" ".join(f"line number q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} here.\n" for i in range(10_000))), model.score("12345\n" * 3000)
    assert neutral == (0, 0, 0) and model.score("a bad day. " * 3000) == model.score("a bad day.")


def test_toxicity_learns_from_the_rows_that_fit(spark):
    documents, labels, _ = labelled(spark, 200, lambda i: ("nasty word here " * 3 if i % 4 == 0 else "plain words here " * 3, int(i % 4 == 0)))
    documents = documents.union(spark.createDataFrame([(1000, "x " * 50_000, None, "s")], documents.schema))
    labels = labels.union(spark.createDataFrame([(1000, 1, 1)], labels.schema))
    assert op7_toxicity.train(documents, labels, chars=20_000).weights == op7_toxicity.train(documents.where("doc_id < 1000"), labels).weights != {}


def test_quality_votes(spark, odd):
    rng = np.random.default_rng(4)
    documents, labels, y = labelled(spark, 300, lambda i: (" ".join((f"Word{rng.integers(500)}!!".upper() if i % 3 == 0 else f"word{rng.integers(500)}") for _ in range(50)), int(i % 3 > 0)))
    model = op9_quality.train(documents, labels)
    assert np.mean([(r.score >= 0.7) == y[r.doc_id] for r in op9_quality.score(documents, model).collect()]) > 0.98
    out = {r.doc_id: r.score for r in op9_quality.score(odd, model).collect()}
    assert out[1] == out[2] == out[3] == 0 and all(0 <= s <= 1 for s in out.values())
    kept = op9_quality.keep(odd, model, 0.7)
    assert kept.columns == odd.columns and op9_quality.keep(empty(odd), model, 0.7).count() == 0
    nothing = op9_quality.train(documents, empty(labels))
    assert op9_quality.score(odd, nothing).count() == 11 and op9_quality.keep(odd, nothing, 0.7).count() == 11


def test_quality_space_is_that_of_the_leading_vectors():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((300, 120)) * 0.9 ** np.arange(120)).astype(np.float32)
    square = x.T @ x
    got, want = op9_quality.leading(square, 10), np.linalg.eigh(square)[1][:, ::-1][:, :10]
    assert np.allclose(np.abs(np.sum(got * want, 0)), 1, atol=1e-3)
    counts = np.abs(rng.standard_normal((50, op9_quality.WIDTH))).astype("<f2")
    y = (np.arange(50) % 2).astype(float)
    a, b = (op9_quality.Model(counts, y, block) for block in (7, 50))
    near = op9_quality.unit(a.weigh(counts.astype(np.float32)) @ a.axes) @ a.vectors.T  # every cosine, at once
    k = np.argsort(-near, 1)[:, : op9_quality.NEIGHBOURS]
    w = np.maximum(np.take_along_axis(near, k, 1), 1e-6) ** op9_quality.POWER
    votes = (w * y[k]).sum(1) / w.sum(1)
    assert np.allclose(a.score(counts.astype(np.float32)), votes, atol=1e-4) and np.allclose(a.idf, b.idf) and a.vectors.shape == b.vectors.shape


def test_language_mixtures(spark, sf, odd):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    model = op10_language.train(documents)
    rows = {r.doc_id: r for r in op10_language.query(spark, sf).collect()}
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in documents.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    by = defaultdict(list)
    for r in documents.where("lang in ('en', 'de') and length(text) > 600").collect():
        by[r.lang].append(r.text[:600])
    names, _, share = model.infer([by["en"][0] + " " + by["de"][0]])
    assert {model.names[j] for j in np.flatnonzero(share[0] > 0.2)} == {"en", "de"}
    out = {r.doc_id: r for r in op10_language.identify(odd, model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[9].lang_pred == "und" and out[1].score == 0 and out[4].lang_pred in model.names
    mixed = " ".join(by["en"][0:1] + by["de"][0:1] + [r.text[:600] for x in ("fr", "es") for r in documents.where(f"lang = '{x}' and length(text) > 600").limit(1).collect()])
    assert len(np.flatnonzero(model.infer([mixed])[2][0] > 0.1)) == 4
    nothing = op10_language.train(empty(documents))
    assert {r.lang_pred for r in op10_language.identify(odd, nothing).collect()} == {"und"}


# 8


class Tree(HTMLParser):
    """Blocks with their tag paths as text, from the standard library's parser; for pages whose elements are all closed."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.at, self.out, self.link, self.hidden = [], [], [], 0, 0
        self.text, self.linked = "", 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if t := " ".join(self.text.split()):
            self.out.append((tuple(self.path), t, min(self.linked, len(t))))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link += 1
        elif tag == "br":
            self.text += " "
        elif tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag not in op8_html.INLINE and tag not in op8_html.VOID:
            self.flush()
            if self.path and self.path[-1].split(".")[0] == "p":  # a paragraph ends where the next block begins
                self.path.pop()
            self.path.append(f"{tag}.{dict(attrs).get('class', '')}")

    def handle_endtag(self, tag):
        if tag == "a":
            self.link -= 1
        elif tag in ("script", "style", "head"):
            self.hidden -= 1
        elif tag not in op8_html.INLINE:
            self.flush()
            names = [x.split(".")[0] for x in self.path]
            if tag in names:
                del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            self.linked += len(html.escape(data, quote=False).strip()) * (self.link > 0)


def plain_extract(page):
    """By sums over paths written as text, with every ancestor looked at anew."""
    found = Tree(page).out
    ratio, share, prior = {}, {}, {}
    for path in {p for p, *_ in found}:
        mine = [(t, k) for p, t, k in found if p == path]
        length, n = sum(len(t) for t, _ in mine), len(mine)
        free = share[path] = max(0.0, 1 - sum(k for _, k in mine) / length)
        ratio[path] = length / n * (1 + math.log1p(sum(len(op8_html.PUNCTUATION.findall(t)) for t, _ in mine) / n)) * free**2 * math.log(2 + length)
        p, inside = 1.0, False
        for x in path:
            tag, _, name = x.partition(".")
            p *= 1.0 if inside and tag in ("article", "main", "header") else op8_html.LIKELY.get(tag, 1.0)
            if name and tag not in ("html", "body", "article", "main"):
                p *= op8_html.MARKED if op8_html.MARKS.search(name) else op8_html.CONTENT if op8_html.GOOD.search(name) and not inside else 1.0
            inside = inside or tag in ("article", "main")
        prior[path] = p
    score = {}
    tag = lambda p: p[-1].split(".")[0]
    for path, r in ratio.items():
        near, weight, prose, up = 0.0, 0.5, tag(path) in op8_html.PROSE, path[:-1]
        inside = lambda p: any(x.split(".")[0] in ("article", "main") for x in p)
        while up and weight >= 0.12 and (inside(up) or len(up) >= 3 or prose):
            near = max([near, *(weight * v for p, v in ratio.items() if p[: len(up)] == up)])
            if tag(up) not in op8_html.FORM:
                weight, prose = weight * 0.6, False
            up = up[:-1]
        score[path] = max(r, near * (max(share[path], 0.6) if inside(path) else share[path]) ** 2) * prior[path]
    return "\n".join(t for p, t, _ in found if score[p] >= 0.12 * max(score.values()) and score[p] > 0)


def test_html_equals_a_plain_version(spark, sf):
    pages = [r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    pages = [p for p in pages if p.count("<b>") == p.count("</b>")] or pages
    got = [op8_html.extract(p) for p in pages]
    assert len(pages) > 20 and got == [plain_extract(p) for p in pages]
    assert sum(a != op8_html.extract(p, use=False) for a, p in zip(got, pages, strict=True)) > len(pages) / 2  # the ratios decide


def test_html_weighs_tags_and_names():
    one = "Whoever reads on, reads this; it has its marks."
    long = " ".join([one] * 4)
    for page, want in [
        (f"<nav><a href=1>Home</a></nav><article><h1>Tit</h1><p>Short one.</p></article><footer>{long}</footer>", "Tit\nShort one."),
        (f"<article><h1>T</h1><p>{one}</p><section class='comments'><h2>Comments</h2><div class='comment'><p>{long}</p></div></section></article>", f"T\n{one}"),
        (f"<div id='header'><h1>Site</h1></div><div class='menu'><ul><li>One</li></ul></div><div id='main'><h1>T</h1><p>{one}</p><p>ok.</p><ul><li>item</li></ul></div><div class='sidebar'><p>{long}</p></div>", f"T\n{one}\nok.\nitem"),
        (f"<main><h1>T</h1><p>{one}</p><aside><p>{long}</p></aside><figure><figcaption>Cap</figcaption></figure><table><tr><td>a<td>b</table></main><form><p>{long}</p></form>", f"T\n{one}\nCap\na\nb"),
        (f"<h1>T</h1><p id=p1>{one}</p><p id=p2>No.</p><div class=ad>{one}</div><footer>{one}</footer>", f"T\n{one}\nNo."),
        (f"<article><h1><a href=x>T</a></h1><p>{one}</p><p><a href=y>All of it linked</a></p></article>", f"T\n{one}\nAll of it linked"),
        (f"<div class='notice'>{long}</div><div class='content'><p>{one}</p></div><p style='display: none'>{long}</p>", one),
    ]:
        assert op8_html.extract(f"<body>{page}</body>") == want


def test_html_finds_text_by_ratios_alone():
    body = "".join(f"<p>Sentence {i} is here, long enough, and has its marks; so it reads on.</p>" for i in range(5))
    links = "".join(f"<li><a href={i}>Another page {i}</a></li>" for i in range(30))
    page = f"<body><div class=x1><ul>{links}</ul></div><div class=x2><h2>About it</h2>{body}<ul><li>One, short.</li><li>Two, too.</li></ul></div><div class=x3>Home page of us</div></body>"
    text = op8_html.extract(page)
    assert text.startswith("About it\nSentence 0") and text.endswith("Two, too.") and "Another" not in text and "Home" not in text
    assert "Another" in op8_html.extract(page, use=False)


@pytest.mark.parametrize("page", ["<a " * 333_333, "<div>" * 100_000 + "x", "<div>x" * 100_000, '<a href="x ' * 90_000, "<!-- " * 200_000, "<div>" * 50_000 + "</span></p></center>" * 40_000, "<li><h1>x" * 60_000, "<script>" * 100_000, "<x a=b c='d" * 80_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    op8_html.extract(page)
    assert time.process_time() - began < 5


def test_html_of_broken_pages():
    assert op8_html.extract("one <p>two <a href='x") == "one\ntwo"
    assert op8_html.extract("a < b and <p>x > y <!--> z") == "a < b and\nx > y z"
    assert op8_html.extract('<p title="it\'s > that">yes, it is') == "yes, it is"
    assert op8_html.extract('<p class="x>no quote ends here</p><p>but this is read</p>').endswith("but this is read")
    assert op8_html.extract("<p>&lt;b&gt; &amp;c&nbsp;d&#x41;</p>") == "<b> &c dA"


def test_html_main_text(spark, sf):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a>A</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, as all do, and say so here.</div><div id="content"><h1>Head &amp; line</h1><p>First, a   long
    sentence with <b>bold</b> words, and <a href=x>links</a>.<p>Second one; it is long enough, too.<!-- <p>no</p> --><script>var t="</p>";</script></div>
    <div class="sidebar"><p>Other stories, which are long, and many.</p></div><form><p>Subscribe now, please, to our letter.</p></form>
    <div class="comments"><p>I think, as a reader, that this is fine.</p></div><footer>&copy; us</footer></body>"""
    assert op8_html.extract(page) == "Head & line\nFirst, a long sentence with bold words, and links.\nSecond one; it is long enough, too."
    assert op8_html.extract(None) == op8_html.extract("") == op8_html.extract("<p> </p>") == "" and op8_html.extract("plain, text") == "plain, text"
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", page, 2), (2, "u", page, 2)], "page_id long, url string, html string, text int")
    rows = op8_html.main_text(df).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and len(rows) == 3
    assert op8_html.query(spark, sf).where("n_chars = 0").count() == 0


# SQL


@pytest.mark.parametrize("module", [op4_neardup, op5_embeddings, op6_decontaminate])
def test_query_equals_its_sql(spark, sf, module):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(module.SQL)
    assert sorted(map(tuple, module.query(spark, sf).select(want.columns).collect())) == sorted(want.fetchall())
