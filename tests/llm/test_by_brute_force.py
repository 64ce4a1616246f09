"""Decisions, spans, surrogates and scores against plain versions of what the docstrings say."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, pii, secrets, toxicity


# ---- language ID ----


def test_bit_sliced_counts_equal_plain_filters():
    r = np.random.default_rng(1)
    grams = {f"l{i:02d}": r.integers(0, 2**63, 4000, dtype=np.uint64) for i in range(70)}  # two planes
    filters = langid.Filters(grams)
    asked = np.concatenate([grams["l03"][:50], grams["l66"][:30], r.integers(0, 2**63, 200, dtype=np.uint64)])
    plain = {}
    for lang, own in grams.items():
        table = np.zeros(1 << langid.FILTER_BITS, bool)
        for at in langid._positions(own):
            table[at] = True
        false = table.mean() ** langid.HASHES
        hits = sum(all(table[at[i]] for at in langid._positions(asked)) for i in range(len(asked)))
        plain[lang] = max(0.0, (hits - len(asked) * false) / (1 - false))
        assert hits >= sum(g in set(own.tolist()) for g in asked.tolist())
    assert np.allclose(filters.counts(asked), [plain[x] for x in filters.langs])
    assert filters.langs[int(np.argmax(filters.counts(asked)))] == max(sorted(plain), key=lambda x: plain[x]) == "l03"


def test_decision_is_the_largest_count_and_the_first_of_ties():
    a, b = (np.unique(langid.ngrams(t)[0]) for t in ("alpha beta gamma", "alpha beta gamma"))
    filters = langid.Filters({"zz": a, "aa": b})
    assert filters.predict("alpha beta")[0] == "aa" and filters.predict("12 ...") == ("und", 0.0) and filters.predict(None) == ("und", 0.0)
    assert filters.predict("qqqq wwww")[1] < 0.01


# ---- secrets ----


def plain_random(text, base, enc):
    """The rules of the docstring, run by run."""
    safe = set(string.ascii_letters + string.digits + "+/_-")
    alnum = set(string.ascii_letters + string.digits)
    hot = {i for a, b, _ in base for i in range(a, b)}
    out = []

    def well(s):
        return len(s) >= secrets.MAX_RATIO * len(enc.encode_ordinary(s))

    def reported(a, b):
        s = text[a:b]
        if hot & set(range(a, b)) or well(s) or secrets.is_known(s) or not any(c.isalpha() for c in s):
            return False
        body = s[1:] if s[0].isalpha() else s
        word = s.isalpha() and (s.isupper() or body.islower() or not body)
        if len(s) < (secrets.MIN_WORD if word else secrets.MIN_RANDOM):
            return False
        out.append((a, b, "random"))
        return True

    def runs(a, b, kind):
        i = a
        while i < b:
            j = i
            while j < b and text[j] in kind:
                j += 1
            if j > i:
                yield i, j
            i = j + 1 if j == i else j

    for a, b in list(runs(0, len(text), safe)):
        if b - a < secrets.MIN_RANDOM:
            continue
        end = b
        while end < len(text) and end < b + 2 and text[end] == "=":
            end += 1
        if secrets.is_fixed(text[a:end]) or reported(a, end):
            continue
        stretch, found = None, []
        for p, q in runs(a, end, alnum):
            if well(text[p:q]):
                stretch = None
            elif stretch is None:
                found.append(stretch := [p, q])
            else:
                stretch[1] = q
        for p, q in found:
            if not reported(p, q):
                for x, y in list(runs(p, q, alnum)):
                    reported(x, y)
    return out


def test_random_spans_equal_the_plain_rules():
    r = random.Random(4)
    enc = secrets.encoder(secrets.vocabulary(secrets.DEFAULT_VOCABULARY))
    make = [
        lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randint(10, 40))), lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(14, 30))),
        lambda: "/".join(r.choice(["home", "user", "v2", "2024", "docs", "Qx9Zk2Lm8Vt4Rw7Pq1"]) for _ in range(r.randint(2, 6))), lambda: "password=" + "".join(r.choice("abcXYZ012") for _ in range(12)),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([24, 32, 40]))), lambda: "plain words here", lambda: "AKIA" + "".join(r.choice(string.ascii_uppercase) for _ in range(18)), lambda: "x" * r.randint(10, 60) + "==",
    ]
    some = 0
    for _ in range(400):
        text = r.choice([" ", "\n", "", ";", "é"]).join(r.choice(make)() for _ in range(r.randint(1, 8)))
        base = secrets.base_spans(text)
        got = secrets.random_spans(text, base, enc)
        assert got == plain_random(text, base, enc), text
        some += len(got)
    assert some > 200


# ---- personal data ----


def planted(r):
    """A text of known entities, and their spans."""
    year = lambda: r.randint(1950, 2005)
    kinds = {
        "email": lambda: (f"{r.choice('abcdef')}{r.randint(10, 99)}.x@mail{r.randint(0, 9)}.example.com", ""), "ip": lambda: (f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", ""),
        "ssn": lambda: (f"{r.randint(100, 665):03d}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", ""), "name": lambda: (f"{r.choice(['Quentin', 'Odette', 'Basil'])} {r.choice(['Marlow', 'Teasdale', 'Winslow'])}", "Mrs "),
        "birth": lambda: (f"{year()}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", "born on "),
    }
    text, spans = "", []
    for kind in r.sample(sorted(kinds), r.randint(1, 5)):
        value, before = kinds[kind]()
        text += f"then {before}"
        spans.append((len(text), len(text) + len(value), kind))
        text += f"{value} and so on, "
    return text, spans


def test_planted_entities_are_found_where_they_are():
    r = random.Random(11)
    for _ in range(300):
        text, spans = planted(r)
        assert pii.detect(text) == spans, text


@pytest.mark.parametrize("kind", ["email", "phone", "ip", "ssn", "name", "iban", "card", "birth"])
def test_surrogates_are_distinct_stable_and_of_the_same_form(kind):
    r = random.Random(3)
    make = {
        "email": lambda i: f"user{i}@host{i % 7}.example.com", "phone": lambda i: f"+49 30 {1000000 + i}", "ip": lambda i: f"10.{i // 250}.{i % 250}.7", "ssn": lambda i: f"{100 + i % 500}-{10 + i // 500}-4321", "name": lambda i: "Ka" + "".join(r.choice("abdeiklmnorstu") for _ in range(5)) + f" {string.ascii_uppercase[i % 26]}u",
        "iban": lambda i: f"DE00{10**17 + i}", "card": lambda i: f"4{10**14 + i}", "birth": lambda i: f"19{50 + i % 50}-{1 + i // 50 % 12:02d}-{1 + i // 600 % 28:02d}",
    }[kind]
    values = sorted({make(i) for i in range(1500)})
    own, again, other = pii.Surrogates("k1"), pii.Surrogates("k1"), pii.Surrogates("k2")
    told = [own.of(kind, v) for v in values]
    assert len({pii._normal(kind, t) for t in told}) == len({pii._normal(kind, v) for v in values}) and told == [again.of(kind, v) for v in values]
    assert [other.of(kind, v) for v in values[:50]] != told[:50]
    shape = lambda s: "".join("d" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    same = [shape(t) == shape(v) for t, v in zip(told, values, strict=True)]
    assert all(same) or kind in ("ip", "email") and all(t.count(".") == v.count(".") for t, v in zip(told, values, strict=True))


# ---- toxicity ----


def test_log_odds_equal_the_formula(spark):
    counts = [("a", 30, 2), ("b", 1, 40), ("c", 10, 10), ("d", 4, 0)]
    n1, n0 = (sum(c[i] for c in counts) for i in (1, 2))
    df = spark.createDataFrame(counts, "f string, c1 long, c0 long")
    delta, z = toxicity.log_odds(F.col("c1"), F.col("c0"), float(n1), float(n0))
    for r in df.select("f", "c1", "c0", delta.alias("d"), z.alias("z")).collect():
        share = (r.c1 + r.c0) / (n1 + n0)
        x1, x0 = r.c1 + toxicity.PRIOR * share * n1, r.c0 + toxicity.PRIOR * share * n0
        want = math.log(x1 / (n1 + toxicity.PRIOR * n1 - x1)) - math.log(x0 / (n0 + toxicity.PRIOR * n0 - x0))
        assert math.isclose(r.d, want) and math.isclose(r.z, want / math.sqrt(1 / x1 + 1 / x0))


def test_tail_fit_is_the_most_likely():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 2000, 3000).astype(float)
    rate, k = 0.8, 0.05
    best = (np.log(k * n) - np.log(-np.log(rng.uniform(size=len(n))))) / rate

    def likelihood(rate, log_k):
        x = log_k + np.log(n) - rate * best
        return float((math.log(rate) + x - np.exp(x)).sum())

    got = toxicity.tail_fit(best, n)
    around = max(likelihood(got[0] * (1 + a), got[1] + b) for a in np.linspace(-0.2, 0.2, 21) for b in np.linspace(-0.5, 0.5, 21))
    assert likelihood(*got) >= around - 1e-6 and abs(got[0] - rate) < 0.05 and abs(got[1] - math.log(k)) < 0.2


def test_score_is_what_the_segments_say():
    model = {"scores": {"bad": 2.0, "awful": 3.0, "nice": -2.0, "awf-": 1.5}, "background": -0.5, "rate": 0.9, "log_k": -2.0, "slope": 1.3, "base": -1.1}
    own, r = toxicity.Scorer(model), random.Random(6)
    for _ in range(200):
        text = " ".join(r.choice(["bad", "awful", "awfully", "nice", "tree", "Bad"]) for _ in range(r.randint(0, 25)))
        scores = [max((model["scores"][f] for f in toxicity.features(w) if f in model["scores"]), key=abs, default=-0.5) for w in text.lower().split()]
        assert [own.word(w) for w in text.lower().split()] == scores
        total = 0.0
        for a, b, s in toxicity.segments(scores):
            assert math.isclose(s, sum(scores[a:b]))
            tail = -math.log(-math.expm1(-math.exp(min(30.0, -2.0 + math.log(len(scores)) - 0.9 * s))))
            total += tail if tail > 1 else 0
        assert math.isclose(own.score(text), 1 / (1 + math.exp(-(-1.1 + 1.3 * math.log1p(total)))), rel_tol=1e-9)
    assert own.score(None) == own.score("") == 1 / (1 + math.exp(1.1))
