"""Surrogates in any script, of birth dates and addresses, with a key of the session; time in proportion to the text."""

import time
from datetime import date

import pytest

from tessera.llm import pii

S = pii.Surrogates("k")


def kinds(text):
    new, found = pii.replace(text, S)
    assert all(made != text[a:b] for a, b, _, made in found)
    return new, [(k, text[a:b]) for a, b, k, _ in found]


def test_values_of_unlisted_scripts_are_replaced():
    for text, kind, value in [
        ("王伟@例え.jp", "email", "王伟@例え.jp"), ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"), ("call +٩٧١٥٠١٢٣٤٥٦٧ now", "phone", "+٩٧١٥٠١٢٣٤٥٦٧"),
        ("我见到王伟先生", "name", "王伟"), ("田中さん", "name", "田中"), ("السيد محمد", "name", "محمد"), ("श्री मोहन", "name", "मोहन"), ("김철수 씨", "name", "김철수"), ("Anna Schmidt", "name", "Anna Schmidt"),
    ]:
        new, found = kinds(text)
        assert found == [(kind, value)] and value not in new and (len(new) == len(text) or value == "Anna Schmidt")
    assert kinds("４１１１１１１１１１１１１１１１")[0] == "".join(chr(ord(c) + 0xFEE0) for c in kinds("4111111111111111")[0])


def test_later_mentions_without_spaces():
    new, found = kinds("王伟先生来了。王伟很好。")
    assert len(found) == 2 and "王伟" not in new and new[:2] == new[7:9]


def test_birth_dates_are_the_same_day_in_every_form():
    new, found = kinds("born on 3/4/1980, DOB: 1980-04-03; geboren am 03.04.1980; born April 3, 1980, born 3 April 1980; due 1980-04-03")
    days = [pii._day(made)[0] for _, _, _, made in pii.replace("born on 3/4/1980, DOB: 1980-04-03; geboren am 03.04.1980; born April 3, 1980, born 3 April 1980", S)[1]]
    assert len(found) == 5 and len(set(days)) == 1 and new.endswith("due 1980-04-03")
    values = [date.fromordinal(pii._FIRST_DAY + i).isoformat() for i in range(3000)]
    made = {S.of("birth", v) for v in values}
    assert len(made) == len(values) and not any(S.of("birth", v) == v for v in values)
    for v in ("12/25/1990", "25/12/1990", "31/02/1990", "99.99.1990"):
        assert S.of("birth", v) != v and (pii._day(S.of("birth", v)) is None) == (pii._day(v) is None)


def test_addresses_keep_their_kind():
    new, found = kinds("at 12 Baker Street, Hauptstraße 5, 3 rue de la Paix and Calle Mayor 7.")
    assert [k for k, _ in found] == ["address"] * 4 and all(x in new for x in (" Street, ", "straße ", " rue de la ", "Calle "))
    assert "Baker" not in new and "Paix" not in new


def test_endings_of_names_stay():
    assert S.of("name", "Иванова").endswith("ова") and S.of("name", "Katarina").endswith("a")


@pytest.mark.parametrize("name", ["a.b", "_id", "_m", "_kept", "doc", "safe", "x`y"])
def test_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(1, "bob@x.org", "c")], ["doc_id", "text", name])
    row = pii.replaced(df).first().asDict()
    assert set(row) == {"doc_id", "text", name} and row[name] == "c" and row["text"] != "bob@x.org"


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "bob@x.org")], ["doc_id", "text"])
    assert pii.key_of(spark) == pii.DEFAULT_KEY and len(pii.DEFAULT_KEY) == 64
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.replaced(df).first().text == pii.replace("bob@x.org", pii.Surrogates("mine"))[0]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_time_grows_with_the_text():
    def seconds(n):
        text = " ".join(f"a{i}@b{i % 9}.org x" for i in range(n))
        began = time.perf_counter()
        assert len(pii.detect(text)) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(32_000) < 30 * max(0.005, seconds(4000))
