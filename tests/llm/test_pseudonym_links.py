"""Equal values in several formats get one pseudonym; what the key must not show up in; more kinds of values."""

import re

import pytest

from colonnade.llm import pii
from test_dedup_quality_text import KEY, characters, feistel


def pseudonyms(spark, values, key=KEY):
    df = spark.createDataFrame([(k, f"see {v} there") for k, v in enumerate(values)], "k int, text string")
    return [r["text"].removeprefix("see ").removesuffix(" there") for r in pii.pseudonymize(df, key).orderBy("k").collect()]


def digits(v):
    return re.sub("[^0-9]", "", v)


def canonical(kind, v):
    if kind == "date":
        if "/" in v:
            m, d, y = map(int, v.split("/"))
        elif "." in v:
            d, m, y = map(int, v.split("."))
        else:
            y, m, d = map(int, v.split("-"))
        return y, m, d
    if kind == "phone":
        return digits(v.replace("(0)", ""))[-10:]
    if kind == "email":
        return v.lower()
    return v.replace(" ", "").replace("-", "") if kind != "ip6" else v


FORMS = {
    "phone": ["+1 (663) 555-6869", "+1 663 555 6869", "+1-663-555-6869", "+16635556869", "+1.663.555.6869", "(663) 555-6869", "663-555-6869", "663.555.6869"],
    "email": ["Ann.Smith9@Mail.example.com", "ann.smith9@Mail.example.com", "ANN.SMITH9@Mail.example.com"],
    "card": ["4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437"],
    "iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"],
    "date": ["1984-02-09", "09.02.1984", "02/09/1984", "9.2.1984", "2/9/1984", "1984-2-9"],
    "ip6": ["2001:db8:0:0:0:0:0:1", "2001:0db8::1", "2001:DB8::0:1"],
}


@pytest.mark.parametrize("kind", FORMS)
def test_all_formats_of_a_value_are_linked(spark, kind):
    got = pseudonyms(spark, FORMS[kind])
    assert len({canonical(kind, v) for v in got}) == 1
    for v, p in zip(FORMS[kind], got):
        assert p != v
        if kind != "ip6":
            assert kind == "date" or re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", p)))


def test_calling_codes_and_trunk_zeros(spark):
    got = pseudonyms(spark, ["+44 (0)20 7946 0958", "+44 20 7946 0958", "+353 1 234 5678", "+35312345678"])
    assert got[0].startswith("+44 (0)") and digits(got[0].replace("(0)", "")) == digits(got[1]) != "442079460958"
    assert digits(got[2]) == digits(got[3]) and got[3].startswith("+353")
    assert got[0][7:] == got[1][4:]


def test_ip6_equals_brute_force(spark):
    [got] = pseudonyms(spark, ["fe80::1ff:fe23:4567:890a"])
    assert got == ":".join(f"{x:x}" for x in feistel([0xFE80, 0, 0, 0, 0x1FF, 0xFE23, 0x4567, 0x890A], [65536] * 8, "ip6"))


@pytest.mark.parametrize("head, body", [("ghp_", "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dE3fG5"), ("AIza", "SyA-1234567890abcdefghijklmnopqrstu"), ("sk_live_", "4eC39HqLyjWDarjtT1zdp7dc"), ("glpat-", "abcDEF123ghiJKL456mn"), ("AKIA", "IOSFODNN7EXAMPLE")])
def test_credentials(spark, head, body):
    assert pseudonyms(spark, [head + body]) == [head + characters(body, "secret")]


def test_scopes_and_times_stay(spark):
    same = ["std::vector", "a::b", "dead::beef", "12:30:45", "1:2:3:4:5:6:7:8:9", "::", "task-force", "skip sk-short"]
    assert pseudonyms(spark, same) == same


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([("8.8.8.8", "x")], "text string, own_key string")
    out = pii.pseudonymize(df, "SUPERSECRET")
    out.collect()
    told = out._jdf.queryExecution().toString()
    assert "SUPERSECRET" not in told and pii.derived("SUPERSECRET") not in told and out.columns == df.columns
    assert "CartesianProduct" not in told and "NestedLoop" not in told


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "call +1 663 555 6869"), (1, "call +1 663 555 6869"), (None, "call +1 663 555 6869"), (2, None)], "doc_id int, text string")
    got = [r["text"] for r in pii.pseudonymize(df, KEY).collect()]
    assert len(got) == 4 and len(set(got)) == 2


def test_no_key_that_others_know(monkeypatch):
    from colonnade.llm import queries

    monkeypatch.setenv("COLONNADE_PII_KEY", "mine")
    assert queries.pii_key() == "mine"
    monkeypatch.delenv("COLONNADE_PII_KEY")
    monkeypatch.setattr(queries, "_DRAWN", [])
    drawn = queries.pii_key()
    assert len(drawn) == 64 and queries.pii_key() == drawn
    monkeypatch.setattr(queries, "_DRAWN", [])
    assert queries.pii_key() != drawn
