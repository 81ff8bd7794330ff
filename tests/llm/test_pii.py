import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    n = lambda m: len(re.sub("[^0-9]", "", m.group()))
    span = lambda ms: [m.span() for m in ms]
    return {"email": span(EMAIL.finditer(t)),
            "ip": span(m for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))),
            "card": span(m for m in CARD.finditer(t) if 13 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))),
            "phone": span(m for m in PHONE.finditer(t) if 9 <= n(m) <= 15)}


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.%+-_@1207 ()é\n-0:/", max_size=60))
def test_base_spans_match_the_patterns(t):
    got = pii.find(t)
    assert {k: got[k] for k in pii.BASE} == brute(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4041894974608795", "10.0.0.1", "+49 30 1234567", "a.b@c.de", "@", "..", "+", "256.1.1.1.9",
                                 " ", "x", "4041 8949 7460 8795", "1.2.3.4.5.6.7.8", "a@b@c.de.f", "12-34"]), max_size=12))
def test_joined_fragments(parts):
    t = "".join(parts)
    got = pii.find(t)
    assert {k: got[k] for k in pii.BASE} == brute(t)


def test_added_spans_and_boundaries():
    t = "See https://ex.org/a?b=1. IBAN: DE44500105175407324931, account no. 1234567; accounting 99999"
    got = pii.find(t)
    assert [t[a:b] for a, b in got["url"]] == ["https://ex.org/a?b=1"]
    assert [t[a:b] for a, b in got["account"]] == ["DE44500105175407324931", "1234567"]


def test_long_runs_take_linear_time():
    for t in ("1" * 400_000, "1." * 200_000, "+1" + " " * 300_000, "a" * 300_000 + "@", "@" * 200_000, "1 " * 200_000):
        pii.find(t)


def test_rows(odd, none):
    rows, docs = pii.personal_data(odd).collect(), odd.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.base_sha256 == empty and r.spans == "" for r in rows)
    assert pii.personal_data(none).collect() == []


def test_masking(spark):
    df = spark.createDataFrame([(1, "mail a@b.de or 10.0.0.1"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.masked(df).collect()} == {1: "mail <email> or <ip>", 2: None}
