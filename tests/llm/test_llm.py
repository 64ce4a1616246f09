"""Small fixtures: brute force, exact round trips, held-out accuracy, and awkward rows, for every training-data operator."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, common, decontam, langid, mixing, pii, secrets, simhash, tokens, toolcalls, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(spark, extra=()):
    r = random.Random(3)
    texts = [prose(r, 60) for _ in range(20)]
    texts += [texts[0], texts[1] + " more", texts[2].upper(), "", None, "   ", "one", "x " * 3000, "Ünï cödé", *extra]
    return spark.createDataFrame([(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


# ---- nearest neighbours ----


def vectors(spark, n=300, d=12, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    x[50:60] = x[5]  # equal vectors tie by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * d), (1002, [float("nan")] * d), (1003, [None] + [1.0] * (d - 1)), (1004, [1.0] * (d - 1)), (None, [1.0] * d), (1020, [float("inf")] * d)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_neighbours_against_brute_force(spark):
    x, df = vectors(spark)
    got = {}
    for r in ann.nearest(df.withColumns({"q": F.lit(1), "sim": F.lit("x"), "node": F.lit(2)}), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    exact, hits = x.astype(np.float64) @ x.astype(np.float64).T, 0
    for q, found in got.items():
        s = exact[q].copy()
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
        hits += len(set(want) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


# ---- mixing ----


def test_mix_meets_budgets(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randint(0, 30)), None, "a" if i % 3 else ("b" if i % 2 else None), 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"copies": F.lit(9), "weight": F.lit("x"), "rows": F.lit(0)})
    got = mixing.mix(df).collect()
    assert len(got) == 400
    tokens_by, drawn, share = {}, {}, {}
    for x in got:
        tokens_by[x.source] = tokens_by.get(x.source, 0) + x.n_tokens
        drawn[x.source] = drawn.get(x.source, 0) + x.n_tokens * x.copies
        share[x.source] = x.weight
    total = sum(tokens_by.values())
    assert abs(sum(share.values()) - 1) < 1e-9
    for s, budget in ((s, int(share[s] * total)) for s in share):
        assert budget - 31 < drawn[s] <= budget
    exponent, weights = mixing.solve(tokens_by)
    assert 0 < exponent < 1 and abs(weights["a"] - share["a"]) < 1e-12
    for x in got:  # brute force of the last pass: leading documents by block and hash
        key = hashlib.md5(f"{mixing.SEED}:{x.doc_id}".encode()).hexdigest()
        assert x.block == int(key[:3], 16)
    for s in share:
        passes, rest = divmod(int(share[s] * total), tokens_by[s])
        used = 0
        for x in sorted((x for x in got if x.source == s), key=lambda x: (hashlib.md5(f"{mixing.SEED}:{x.doc_id}".encode()).hexdigest(), x.doc_id)):
            used += x.n_tokens
            assert x.copies == passes + (used <= rest)


def test_mix_limits_and_edges(spark):
    assert mixing.solve({"a": 1000, "b": 1}, repeat_limit=2.0)[1]["b"] * 1001 <= 2.0 + 1e-6
    assert mixing.solve({"a": 5, "b": 5})[1] == {"a": 0.5, "b": 0.5}
    assert mixing.solve({"a": 0})[1] == {"a": 0.0}
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 0), (1, " ", None, "a", 0)], SCHEMA)
    assert [(r.n_tokens, r.copies) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]
    counted = spark.createDataFrame([("a\tb\n c ",), ("",), (None,), (" ",)], "t string").select(mixing.word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in counted] == [3, 0, 0, 1]
    nameless = documents(spark).unionAll(spark.createDataFrame([(None, "alpha beta", "en", None, 0)], SCHEMA)).withColumn("weight", F.lit("w"))
    got = mixing.with_copies(nameless)
    assert got.count() == nameless.count() and got.filter("copies IS NULL").count() == 0 and dict(got.dtypes)["weight"] == "double"
    assert mixing.draws(mixing.mix(documents(spark))).filter("pass < 0").count() == 0


# ---- token counts ----


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(secrets.vocabulary(secrets.DEFAULT_VOCABULARY))


def test_edits_equal_full_counts(counter):
    r = random.Random(5)
    bits = list("ab'sl  \n\té1 2.,!-ï") + ["'ll", "   ", "\n\n", "hello", " world"]
    for _ in range(250):
        text = "".join(r.choice(bits) for _ in range(r.choice([0, 3, 40, 700])))
        tree = tokens.TokenTree(text, counter)
        for _ in range(4):
            a = r.randint(0, len(text))
            b = min(len(text), a + r.choice([0, 1, 5, 60, 400]))
            new = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 6, 50, 900])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            fresh = tokens.TokenTree(text, counter)
            assert tree.text == text and tree.leaves() == fresh.leaves()
            assert tree.total == len(counter.enc.encode_ordinary(text))


def test_edit_encodes_little(counter):
    text = prose(random.Random(1), 5000)
    tree = tokens.TokenTree(text, counter)
    assert tree.edit(len(text) // 2, len(text) // 2 + 3, "zzz") < 10


def test_counts_on_tables(spark, counter):
    df = documents(spark).withColumns({"tree": tokens.tree_of(spark, F.col("text"))})
    for r in df.select("text", tokens.n_tokens(F.col("tree")).alias("n")).collect():
        assert r.n == len(counter.enc.encode_ordinary(r.text or ""))
    edits = spark.createDataFrame([(0, 0, 5, "X"), (0, 10, 10, None), (4, 3, 99999, "tail")], "doc_id long, a int, b int, new string")
    before = texts_of(documents(spark))
    for r in tokens.apply_edits(df.select("doc_id", "text", "tree"), edits).collect():
        want = before[r.doc_id] if r.doc_id not in (0, 4) else "X" + before[0][5:] if r.doc_id == 0 else before[4][:3] + "tail"
        assert r.text == want and sum(r.tree.counts) == len(counter.enc.encode_ordinary(want or ""))


# ---- language ----


def test_languages(spark):
    r = random.Random(2)
    other = "der die das und ist nicht schön Straße über mit".split()
    rows = [(i, prose(r, 40) if i % 2 else " ".join(r.choice(other) for _ in range(40)), "en" if i % 2 else "de", None, 0) for i in range(80)]
    rows += [(100, None, "en", None, 0), (101, "123 ###", "en", None, 0), (102, "日本語", None, None, 0), (None, "alpha beta", "en", None, 0), (3, rows[3][1], "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("language", F.lit("clash"))
    held = df.withColumn("held", common.fold("doc_id", 3, 1))
    grams = langid.train(held.filter("NOT held"))
    got = langid.with_language(held.drop("language"), grams).collect()
    assert len(got) == len(rows)
    for x in got:
        assert 0 <= x.language.score <= 1
        if x.text is None or not any(c.isalpha() for c in x.text):
            assert x.language.lang_pred == "und"
        elif x.lang and x.doc_id != 102:
            assert x.language.lang_pred == x.lang
        else:
            assert x.language.lang_pred in ("en", "de")
    assert langid.train(empty(spark)) == {}
    assert langid.Filters({}).predict("alpha") == ("und", 0.0)


def test_filter_corrects_false_positives():
    rng = np.random.default_rng(1)
    grams = {f"l{i:02d}": rng.integers(0, 2**63, 3000).astype(np.uint64) for i in range(70)}  # two planes
    f = langid.Filters(grams)
    strange = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert f.counts(strange).max() < 50 and abs(f.counts(grams["l66"])[66] - 3000) < 5
    assert f.langs[int(np.argmax(f.counts(grams["l66"])))] == "l66"


# ---- secrets ----


def test_base_spans():
    text = 'x PASSWORD = "hunter22" token:ab AKIA' + "A1" * 9 + " " + "0f" * 12 + " api-key=abcdefgſpasswd=1234567"
    kinds = [(k, text[a:b]) for a, b, k in secrets.base_spans(text)]
    assert kinds == [("assign", 'PASSWORD = "hunter22'), ("access", "AKIA" + "A1" * 9), ("hex", "0f" * 12), ("assign", "passwd=1234567")]


def naive_base(text):
    out = []
    for kind, pattern, least, group in (("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(a, b, k) for a, _, k, b in sorted(out)]


def test_base_spans_by_brute_force():
    r = random.Random(4)
    bits = ["token", "Secret", "=", ":", " ", '"', "'", "AKIA", "abc123", "0123456789abcdef", "deadbeef" * 4, "ZZZZ9999", "api_key", "é", "passwd", "password=", "token=token=abcdefgh", "secret=token:abcdef"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert secrets.base_spans(text) == naive_base(text), text


def test_random_strings(spark):
    r = random.Random(7)
    noise = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(32))
    rows = [(1, f"key {noise} end"), (2, "d41d8cd98f00b204e9800998ecf8427eX"[:32].upper()), (3, "123e4567-e89b-12d3-a456-426614174000"), (4, "the_quick_brown_fox_jumps_2024"), (5, None), (6, "word " * 5000), (5, "")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    assert [r.spans for r in got] == ["random:4:36", "", "", "", "", "", ""]
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert secrets.scan(empty(spark)).count() == 0


# ---- simhash ----


def naive_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    r = random.Random(6)
    for text in [None, "", " \t", "One", "a b", "Ä b c\x0bd", *(prose(r, n) for n in (2, 3, 4, 50))]:
        assert simhash.fingerprint(text) == naive_print(text)


@pytest.mark.parametrize("limit", [64, 1])
def test_links_and_components_by_brute_force(spark, limit):
    r = random.Random(8)
    prints = []
    for _ in range(40):
        base = r.getrandbits(64)
        prints.append(base)
        for _ in range(r.randint(0, 6)):
            base ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            prints.append(base)
    prints += [0, 1, (1 << 64) - 1, (1 << 63)]
    prints = sorted(set(prints))
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                x, y = root[i], root[j]
                root = [min(x, y) if v in (x, y) else v for v in root]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, node long")
    got = {x.node: x.root for x in simhash.components(simhash.links(df, limit)).collect()}
    assert {i: got.get(i, i) for i in range(len(prints))} == dict(enumerate(root))


def test_near_duplicates(spark):
    df = documents(spark).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "node": F.lit(0)})
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    texts = texts_of(df)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == {i: naive_print(t) for i, t in texts.items()}
    assert got[20].component_id == 0 and got[22].component_id == 2 and got[24].component_id == got[23].component_id == got[25].component_id == 23
    kept = simhash.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns and 20 not in texts_of(kept) and 0 in texts_of(kept)
    nameless = documents(spark).unionAll(spark.createDataFrame([(None, "alpha", "en", None, 0), (None, "alpha", None, None, 0)], SCHEMA))
    assert simhash.keep_first(nameless).filter("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(empty(spark)).count() == 0


# ---- personal data ----


def test_surrogates():
    s = pii.Surrogates("k")
    text = "Write bob.42@mail8.example.com or BOB.42@mail8.example.com, +1 (988) 555-2485, 988-555-2485; 42.144.35.254; 4111 1111 1111 1111 4785380592391135 078-05-1120 DE89 3704 0044 0532 0130 00. Mr. John Smith, Mrs Mary Smith, Dr Иван Петров"
    new, found = pii.replace(text, s)
    by = {}
    for a, b, kind, made in found:
        by.setdefault(kind, []).append((text[a:b], made))
        assert made != text[a:b]
    assert [len(by[k]) for k in ("email", "phone", "ip", "card", "ssn", "iban", "name")] == [2, 2, 1, 2, 1, 1, 3]
    assert by["email"][0][1].lower() == by["email"][1][1].lower() and by["email"][1][1].startswith(by["email"][0][1][:3].upper())
    assert re.sub(r"\D", "", by["phone"][0][1])[1:] == re.sub(r"\D", "", by["phone"][1][1])
    assert pii._luhn(by["card"][0][1].replace(" ", "")) and not pii._luhn(by["card"][1][1]) and pii._iban_ok(by["iban"][0][1].replace(" ", ""))
    assert by["name"][0][1].split()[0] in pii.GIVEN["latin", "m"] and by["name"][1][1].split()[0] in pii.GIVEN["latin", "f"] and by["name"][2][1].split()[0] in pii.GIVEN["cyrillic", "m"]
    assert by["name"][0][1].split()[1] == by["name"][1][1].split()[1]  # the same surname
    assert all(v not in new for k in by for v, _ in by[k])
    assert pii.replace(text, pii.Surrogates("k"))[0] == new != pii.replace(text, pii.Surrogates("other"))[0]


@pytest.mark.parametrize("kind", ["phone", "ip", "card", "ssn", "email"])
def test_surrogates_are_one_to_one(kind):
    r, s = random.Random(9), pii.Surrogates("k")
    make = {"phone": lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04d}", "ip": lambda: ".".join(str(r.randint(1, 223)) for _ in range(4)), "card": lambda: str(r.randint(10**15, 10**16 - 1)), "ssn": lambda: f"{r.randint(100, 999)}-{r.randint(0, 99):02d}-{r.randint(0, 9999):04d}", "email": lambda: f"{r.choice('abc')}{r.randint(0, 99)}@x{r.randint(0, 9)}.org"}[kind]
    values = {make() for _ in range(4000)}
    assert len({s.of(kind, v) for v in values}) == len(values)
    assert all(pii.detect(f" {s.of(kind, v)} ")[0][2] == kind for v in list(values)[:300])


def test_surrogates_on_tables(spark):
    df = documents(spark, ["a@b.org, a@b.org", "x" * 200_000 + "@" + "y" * 10]).withColumns({"safe": F.lit(1), "doc": F.lit("d")})
    got = pii.replaced(df)
    assert got.columns == df.columns
    before, after = texts_of(df), texts_of(got)
    assert [i for i in before if before[i] != after[i]] == [29]
    assert got.filter("doc_id = 29").first().n_chars == len(after[29]) and got.filter("doc_id = 24").first().n_chars == 0
    assert pii.collisions(pii.pairs(df)).count() == 0
    assert pii.replaced(empty(spark)).count() == 0


# ---- decontamination ----


def naive_hits(text, items):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for name, item in items:
        x = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in item or ""))
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_decontamination_by_brute_force(spark, pass_bytes):
    r = random.Random(10)
    items = [(i, prose(r, n)) for i, n in enumerate([20, 15, 13, 12, 5, 2, 1, 30])] + [(8, None), (9, " , "), (10, "Ünï Cödé"), (2, "a second text of item two that is long enough to be cut into windows here")]
    extra = [prose(r, 20) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(r, 30), items[1][1] * 2, items[3][1], "Ünï... cödé!", items[7][1][:80]]
    docs = documents(spark, extra).withColumns({"found": F.lit(1), "item_id": F.lit(2)}).drop("found")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.with_verdict(decontam.with_occurrences(docs, bench, pass_bytes=pass_bytes)).collect()
    for x in got:
        n, hit, found = naive_hits(x.text, items)
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
        assert x.contaminated == (hit > 0 and 20 * hit >= n)
    assert decontam.keep_clean(documents(spark), bench.limit(0)).count() == documents(spark).count()
    assert decontam.with_occurrences(empty(spark), bench).count() == 0


# ---- toxicity ----


def test_segments_by_brute_force():
    def slow(scores):
        """Recursive definition: the best segment, then both sides."""
        best, at = 0.0, None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        if at is None:
            return []
        left, right = slow(scores[: at[0]]), slow(scores[at[1] :])
        return left + [(at[0], at[1], best)] + [(a + at[1], b + at[1], s) for a, b, s in right]

    r = random.Random(11)
    for _ in range(400):
        scores = [round(r.uniform(-3, 2), 3) for _ in range(r.randint(0, 14))]
        got = toxicity.segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in slow(scores)], scores


def test_toxicity_held_out(spark):
    r, bad = random.Random(12), ["vile", "scumbag", "moronic", "loserish"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = prose(r, 60).split()
        if toxic:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), None, None, 0))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, 0), (901, "", None, None, 0), (None, "x", None, None, 0)]
    labels += [(None, 1, 1), (900, 1, None), (0, 1, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA).withColumn("toxic", F.lit(5)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.filter(~common.fold("doc_id", 4, 2)), marks.filter(~common.fold("doc_id", 4, 2)))
    got = toxicity.with_score(docs, model).withColumn("held", common.fold("doc_id", 4, 2)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    right = [(x.score >= toxicity.THRESHOLD) == (x.doc_id % 5 == 0) for x in got if x.held and x.doc_id < 400]
    assert sum(right) >= 0.97 * len(right)
    nothing = toxicity.train(empty(spark), marks.limit(0))
    assert {x.score < 0.3 for x in toxicity.with_score(docs, nothing).collect()} == {True}


# ---- tool calls ----


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"call_id": F.lit("x"), "valid": F.lit(3)})


def test_tool_calls(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False)}}
    calls = '{"tool_calls":[{"id":"c2","name":"add","arguments":{"b":1.5,"a":"${c1}"}},{"id":"c1","name":"add","arguments":"{\\"a\\": 1}"}]}'
    rows = [(1, 0, "assistant", calls), (1, 1, "tool", '{"tool_call_id":"c1","content":{"z":1,"a":[2]}}'), (1, 2, "system", "hi"), (1, 3, "tool", '{"tool_call_id":"gone","content":1}')]
    got = {(r.kind, r.call_id): r for r in toolcalls.link(messages(spark, rows), schemas).collect()}
    one, two = got["call", "c1"], got["call", "c2"]
    assert (one.round, one.linked, one.valid, one.json) == (0, True, True, '{"arguments":{"a":1},"id":"c1","name":"add","result":{"a":[2],"z":1},"type":"tool_call"}')
    assert (two.round, two.linked, two.valid) == (1, False, False) and two.json.startswith('{"arguments":{"a":"${c1}","b":1.5},')
    assert got["result", "gone"].linked is False and got["result", "c1"].linked is True and got["message", None].json == '{"content":"hi","role":"system","type":"message"}'


def test_tool_call_order(spark):
    def call(name, *deps):
        return '{"id":"%s","name":"t","arguments":{"x":"%s"}}' % (name, " ".join("${%s}" % d for d in deps))

    text = '{"tool_calls":[%s]}' % ",".join([call("d", "c", "b"), call("c", "b"), call("b", "a"), call("a"), call("p", "q"), call("q", "p"), call("r", "p"), call("s", "nobody")])
    got = {r.call_id: r["round"] for r in toolcalls.link(messages(spark, [(1, 0, "assistant", text)]), {}).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "p": None, "q": None, "r": None, "s": 0}


def test_plain_chats_and_edges(spark):
    rows = [(7, 0, "user", 'say "é"\n'), (7, 1, "assistant", "é"), (7, 2, "user", None), (None, 3, "user", "x"), (7, None, "assistant", "y"), (7, 0, "user", 'say "é"\n'), (8, 1, "assistant", '{"tool_calls": 3}')]
    got = toolcalls.link(messages(spark, rows)).collect()
    assert len(got) == len(rows)
    first = [r for r in got if r.kind == "call" and r.turn == 0]
    assert len(first) == 2 and all(r.linked and r.valid and r.json == '{"arguments":{"prompt":"say \\"é\\"\\n","turn":0},"id":"7:0","name":"reply","result":"é","type":"tool_call"}' for r in first)
    assert [(r.linked, r.valid) for r in got if r.turn == 2] == [(False, False)]
    assert [r.linked for r in got if r.conv_id is None or r.turn is None] == [False, False]
    assert toolcalls.link(messages(spark, rows).limit(0)).count() == 0


def test_tool_calls_are_native(spark):
    plan = toolcalls.link(messages(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- shared ----


def test_lookup_with_a_hot_key(spark):
    left = spark.range(6000).select((F.when(F.col("id") < 4000, 7).otherwise(F.col("id"))).alias("key"), F.col("id").alias("x"))
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("most")).filter("key <> 5999")
    got = common.lookup(left, right, "key", "n")
    assert got.count() == 6000 and got.filter("key = 7 AND most = 3999").count() == 4000
    assert got.filter("most IS NULL").count() == 1 and got.columns == ["key", "x", "most"]


def test_pipeline_by_brute_force(spark, tmp_path):
    r = random.Random(13)
    docs = documents(spark, ["mail me: bob.42@mail8.example.com " + prose(r, 30), "###", prose(r, 40)])
    bench = spark.createDataFrame([(1, texts_of(docs)[5])], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, want = docs, texts_of(docs)
    grams = langid.Filters(langid.train(docs))
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = common.cut(stage(spark, rows, str(tmp_path)))
        if name != "mixture":
            assert rows.columns == docs.columns, name
        if name == "language_id":
            want = {i: t for i, t in want.items() if (p := grams.predict(t))[0] != "und" and p[1] >= langid.LEAST_SCORE}
        elif name == "near_duplicates":
            prints = {i: naive_print(t) for i, t in want.items()}
            group = {i: i for i in want}
            for _ in want:
                group = {i: min(group[j] for j in want if bin(prints[i] ^ prints[j]).count("1") <= 2) for i in want}
            want = {i: t for i, t in want.items() if group[i] == i}
        elif name == "decontaminate":
            want = {i: t for i, t in want.items() if not ((h := naive_hits(t, [(1, texts_of(docs)[5])]))[1] and 20 * h[1] >= h[0])}
        elif name == "personal_data":
            want = {i: pii.replace(t, pii.Surrogates(pii.DEFAULT_KEY))[0] for i, t in want.items()}
        else:
            assert {x.doc_id for x in rows.collect()} == {x.doc_id for x in mixing.mix(before).collect() if x.copies > 0}
            continue
        assert texts_of(rows) == want, name
    assert 5 not in want and 20 not in want and 30 not in want and "bob.42" not in want[29]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()
