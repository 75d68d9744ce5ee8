"""Formats of personal data that the test tables don't hold."""

import ipaddress
import re
import time

import pytest

from passerine.llm import pii

PHONES = ["+1 743 555 3824", "(743) 555-3824", "743-555-3824", "743.555.3824", "1-800-555-0199", "+44 20 7946 0958", "+49 30 123456", "+49 (0)30 1234567", "+442079460958", "+33 6 12 34 56 78", "06 12 34 56 78", "030/1234567", "020 7946 0958", "(030) 123456", "Tel: 5552345678", "phone 5552345678"]
CARDS = ["378282246310005", "3782 822463 10005", "30569309025904", "4222222222222", "4000 0000 0000 0000 006", "4465-7583-8288-9437"]
NAMES = ["Mr McDonald", "Mrs Anne-Marie Smith", "Mr. Seán O'Brien", "Dr. Lea Müller-Lüdenscheidt", "Herr Max von der Heide"]
SSNS = ["078-05-1120", "219-09-9999"]
IBANS = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947"]
IPV6 = ["2001:db8:85a3:0:0:8a2e:370:7334", "fe80::1", "2606:4700::6810:85E5"]
UNTITLED = ["Alice Johnson", "Peter J. Müller", "Hans von Berg", "Мария Иванова"]
PLAIN = ["2024-01-02 03:04:05", "pages 100-200 of 1234567890123", "version 1.2.3, 12 345 678 rows", "378282246310006", "0.123456789", "Mr who", "GB82 WEST 1234 5698 7654 33", "Grace Period", "Alice was here", "std::vector a::b", "00:1b:44:11:3a:b7 12:30:45", "000-12-3456", "5552345678"]


ALL = PHONES + CARDS + NAMES + SSNS + IBANS + IPV6 + UNTITLED + PLAIN


@pytest.fixture(scope="module")
def out(spark):
    rows = [f"x {v}, y" for v in ALL]
    found = pii.with_surrogates(spark.createDataFrame([(v, t) for v, t in zip(ALL, rows)], "doc_id string, text string"), "k")
    return {r["doc_id"]: r for r in found.collect()}


@pytest.mark.parametrize("kind,values", [("phone", PHONES), ("card", CARDS), ("name", NAMES + UNTITLED), ("ssn", SSNS), ("iban", IBANS), ("ipv6", IPV6)])
def test_other_formats_are_found_whole(out, kind, values):
    for v in values:
        r = out[v]
        assert r["n_entities"] == r[f"n_{kind}"] == 1, r
        assert r["text"].startswith("x ") and r["text"].endswith(", y") and v not in r["text"], r
        if kind == "iban":
            new = r["text"][2:-3]
            account = new.replace(" ", "")
            assert [c == " " for c in new] == [c == " " for c in v] and new[:2] == v[:2]
            assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
        elif kind == "ssn":
            assert re.fullmatch("x 9[0-9]{2}-[0-9]{2}-[0-9]{4}, y", r["text"])
        elif kind == "ipv6":
            assert ipaddress.ip_address(r["text"][2:-3]) in ipaddress.ip_network("2001:db8::/32")
        elif kind != "name":
            shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
            assert shape(r["text"]) == shape(f"x {v}, y")
        assert not set(v.split(" ")[1:]) - {"von", "der"} & set(r["text"].replace(",", "").split(" ")) or kind != "name", r


def test_other_numbers_stay(out):
    for v in PLAIN:
        assert (out[v]["text"], out[v]["n_entities"]) == (f"x {v}, y", 0)


def test_no_letter_stays_and_empty_parts_stay_empty(spark):
    values = ["Mr John", "Mr Šimák", "Frau Đỗ", "Herr Łukasz Ødegård", "Mr Ωμέγα", "Mr Юлий Щукин", "Mr Ћирић"]
    made = {r["value"]: r["surrogate"] for r in pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "k").collect()}
    assert made["Mr John"].split(" ")[1].lower() in pii.GIVEN["m"]
    for v in values[1:]:
        assert len(made[v]) == len(v) and made[v].split(" ")[0] == v.split(" ")[0]
        for a, b in zip(v.split(" ", 1)[1], made[v].split(" ", 1)[1]):
            assert (a == b) == (a == " ") and a.isupper() == b.isupper(), (v, made[v])


def test_one_person_and_one_number_have_one_replacement(spark):
    text = "Mr. John Smith met Mr John Smith, MR Smith's friend Mr. Smith and Mrs SMITH. Frau Ingrid Braun; Frau Xwilda Smith; Herr Weiß. Ann.B@Corp.com, ann.b@corp.com; +1 (743) 555-3824 or +1 743 555 3824; 378282246310005, 3782 822463 10005."
    out = pii.with_surrogates(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()["text"]
    first, second = re.findall(r"Mr\.? (\w+) (\w+)", out)[:2]
    assert first == second and first[0].lower() in pii.GIVEN["m"] and first[1] != "Smith"
    assert re.findall(r"Mr\. (\w+) and", out) == [first[1]] and re.findall(r"Mrs (\w+)\.", out) == [first[1].upper()]
    assert re.search(r"Frau (\w+) (\w+);", out)[1].lower() in pii.GIVEN["f"]
    strange = re.findall(r"Frau (\w+) (\w+);", out)[1]
    assert strange[0].endswith("a") and strange[1] == first[1] and len(strange[0]) == len("Xwilda")
    mails = re.findall(r"\S+@[^,;]+", out)
    assert mails[0] == mails[1] != "ann.b@corp.com"
    phones = [re.sub("[^0-9]", "", p) for p in re.findall(r"\+1 [0-9() -]+[0-9]", out)]
    assert phones[0] == phones[1] != "17435553824" and len(phones[0]) == 11
    cards = [re.sub(" ", "", c) for c in re.findall(r"\d{4} ?\d{6} ?\d{5}", out)]
    digits = [int(c) for c in cards[0]][::-1]
    assert cards[0] == cards[1] != "378282246310005" and sum(digits[::2]) + sum(d * 2 // 10 + d * 2 % 10 for d in digits[1::2]) == 10 * (sum(digits[::2]) // 10 + (sum(digits[::2]) % 10 + sum(d * 2 // 10 + d * 2 % 10 for d in digits[1::2])) // 10)


def test_spellings_share_a_replacement(out):
    assert out["Tel: 5552345678"]["text"][-13:-3] == out["phone 5552345678"]["text"][-13:-3]
    assert out[IBANS[0]]["text"].replace(" ", "") == out[IBANS[1]]["text"].replace(" ", "")


def test_long_texts_take_linear_time(spark):
    """A million characters each of what the patterns could run on in, and of many entities."""
    n = 1_000_000
    units = ["a", "7", "1.2.", "+1 ", "(030) ", "030-", "030 123456 12 ", "+49 30 123456 ", "x@y ", "Abc-", "Mr A", "1234 ", "ab12:", "DE12 ", "é", "ann@corp.com Mr John Smith "]
    rows = [(i, u * (n // len(u))) for i, u in enumerate(units)] + [(99, "a@" + "b." * (n // 2) + "c"), (100, "Mr " + "A" * n), (101, "+49 30 1234567 " + "7" * n)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "k").collect()}
    took = time.time() - began
    assert len(got) == len(rows) and got[0]["text"] == rows[0][1] and got[15]["n_email"] == n // len(units[15])
    assert "ann@corp.com" not in got[15]["text"] and "Smith" not in got[15]["text"]
    assert took < 150, took


def test_replacements_grow_until_they_are_free(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRIES", 0)
    values = [*PHONES[:2], CARDS[0], SSNS[0], IBANS[0], IPV6[1], "Mr Xwilda", "1.2.3.4", "a@b.org"]
    made = [r["surrogate"] for r in pii.surrogates(spark.createDataFrame([(v,) for v in values], "value string"), "k").collect()]
    assert len(set(made)) == len(values) and not set(made) & set(values)


def by_hand(text):
    """E-mail addresses of a text, grown to both sides from each @."""
    found, local, domain = [], set("._%+-"), set("-")
    good = lambda c, more: c.isascii() and c.isalnum() or c in more
    for m in re.finditer("@", text):
        a, b = m.start(), m.end()
        while a and good(text[a - 1], local):
            a -= 1
        while b < len(text) and (good(text[b], domain) or text[b] == "." and b + 1 < len(text) and good(text[b + 1], domain)):
            b += 1
        if a < m.start() and "." in text[m.end() : b] and (not found or a >= found[-1][1]):
            found.append((a, b, text[a:b]))
    return [x for *_, x in found]


def test_addresses_of_the_test_table_by_brute_force(spark):
    """Every address is replaced, one for one and alike everywhere; texts without entities stay as they are."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    mapping = {}
    for r in pii.with_surrogates(docs, "k").collect():
        old, new = by_hand(before[r["doc_id"]]), by_hand(r["text"])
        assert len(old) == len(new) == r["n_email"], (old, new)
        for a, b in zip(old, new):
            assert mapping.setdefault(a.lower(), b) == b and b.endswith(".example.org")
        assert r["n_entities"] or r["text"] == before[r["doc_id"]]
    assert mapping and len(set(mapping.values())) == len(mapping) and not set(mapping) & {v.lower() for v in mapping.values()}
