"""Surrogates do not depend on the document: no fixed points, distinct and the same over a whole table."""

from itertools import product

import pytest

from tessera.llm import pii

C, V = "bcdfghjklmnpqrstvwxyz", "aeiou"


@pytest.mark.parametrize("key", ["k", pii.DEFAULT_KEY])
def test_short_formats_are_permuted_without_fixed_points(key):
    s = pii.Surrogates(key)
    domain = "mail0.example.com"
    formats = {
        "name": [[a.upper() + b for a, b in product(C, V)], [a.upper() + b for a, b in product(V, V)], [n for g in pii.GIVEN.values() for n in g]],
        "email": [[f"{a}@{domain}" for a in V], [f"{a}@{domain}" for a in C], [f"{a}{b}@{domain}" for a, b in product(C, V)]],
    }
    for kind, lists in formats.items():
        for values in lists:
            made = {v: s.of(kind, v) for v in values}
            assert all(v != m for v, m in made.items()) and len(set(made.values())) == len(made)
    assert {s.of("name", v) for v in formats["name"][0]} == set(formats["name"][0])


def test_distinct_and_the_same_over_a_table(spark):
    rows = [f"{a}{b}@mail0.example.com" for a, b in product(C, V)] + [f"Mr. {a.upper()}{b} and" for a, b in product(C, V)]
    rows += ["Mr Anna Smith", "Mrs Anna Smith", "+353 1 234 5678", "+35312345678", "2001:db8::1", "2001:0db8:0:0:0:0:0:1"]
    pairs = pii.pairs(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert pii.collisions(pairs).count() == 0 and pairs.filter("value = surrogate").count() == 0
    assert pairs.count() == len(rows)


def test_later_mentions_of_a_name():
    s = pii.Surrogates("k")
    text = "Smith said: Dr. John Smith-Will came. John Smith-Will knew Smith; Smithy will not. John!"
    new, found = pii.replace(text, s)
    assert [text[a:b] for a, b, _, _ in found] == ["Smith", "John Smith-Will", "John Smith-Will", "Smith", "John"]
    assert found[0][3] == found[3][3] == found[1][3].split(" ")[1].split("-")[0] and found[4][3] == found[1][3].split(" ")[0]
    assert "Smithy will" in new and "John" not in new


def test_compressed_addresses():
    s = pii.Surrogates("k")
    for value in ("2001:db8::1", "::1", "fe80::", "2001:DB8::A:1", "1::2:3:4:5:6:7"):
        new, found = pii.replace(f"at {value}, or", s)
        assert [(k, v) for _, _, k, v in found] == [("ip6", new[3:-4])] and new[3:-4] != value and pii.detect(new)[0][2] == "ip6"
    assert all(pii.detect(t) == [] for t in ("std::vector a :: b", "1::2::3", "::", "x::1"))
