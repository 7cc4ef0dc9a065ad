"""Entities beside other text: nothing leaks, nothing else changes."""

import pytest

from millrace.llm import pii_surrogates as pii

CARD, AMEX, IBAN = "4111 1111 1111 1111", "3782-822463-10005", "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize(("text", "kind", "value"), [
    (f"pay {CARD} 12/27 now", "card", CARD), ("4111111111111111 123", "card", "4111111111111111"), (f"{CARD} 2027", "card", CARD), (f"no. 77 {CARD}", "card", CARD), (f"12 {AMEX} 9", "card", AMEX), (f"on 2024-01-02 {CARD}.", "card", CARD),
    ("call +33 1 23 45 67 89 today", "phone", "+33 1 23 45 67 89"), ("+33 6 12 34 56 78", "phone", "+33 6 12 34 56 78"), ("01 23 45 67 89", "phone", "01 23 45 67 89"), ("+33(0)6.12.34.56.78", "phone", None),
    ("no 123 45 6789", "ssn", "123 45 6789"), (f"to {IBAN} by noon", "iban", IBAN), ("GB82WEST12345698765432, please", "iban", "GB82WEST12345698765432"), (f"{IBAN} ABCD", "iban", IBAN),
    ("Mr Smith I would", "person_m", "Smith"), ("Mr Smith He came", "person_m", "Smith"), ("Dr. Anna Berg And so", "person_n", "Anna Berg"), ("MR SMITH JONES went", "person_m", "SMITH JONES"), ("mr smith went", "person_m", "smith"),
    ("г-н Иванов", "person_m", "Иванов"), ("Г-ЖА ИВАНОВА сказала", "person_f", "ИВАНОВА"), ("chez M. Dupont hier", "person_m", "Dupont"), ("mrs Anna Berg", "person_f", "Anna Berg"), ("Frau O'Neil-Berg. Die", "person_f", "O'Neil-Berg"),
])
def test_found_alone(text, kind, value):
    found = pii.find_entities(text)
    assert [k for *_, k in found] == [kind] and (value is None or text[slice(*found[0][:2])] == value)
    new, n = pii.replace_entities(text, "k", {}, {})
    s, e, _ = found[0]
    assert n == 1 and text[s:e] not in new and new.startswith(text[:s]) and new.endswith(text[e:])
    # the surrogate is found as what it stands for
    assert [k for *_, k in pii.find_entities(new)] == [kind]


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 12/27", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "J. M. Dupont", "Mr I am", "Mr The man", "m. Dupont", "ms office", "DE88 3704 1044 1532 1130 10", "sold 12 34 56 78 90 12 pieces", "", "9" * 25, "1-2" * 5000])
def test_left_alone(text):
    assert pii.replace_entities(text, "k", {}, {}) == (text, 0)


def test_many_cards_in_one_run():
    text = " ".join([CARD, "5555 5555 5555 4444", "7", "4012888888881881"] * 3)
    assert [text[s:e] for s, e, k in pii.find_entities(text) if k == "card"] == [CARD, "5555 5555 5555 4444", "4012888888881881"] * 3


def test_case_does_not_part_a_person():
    new = [pii.replace_entities(t, "k", {}, {})[0] for t in ("Mr Anna Berg", "MR ANNA BERG", "mr Anna Berg")]
    assert new[1] == new[0].upper() and new[2] == new[0].replace("Mr", "mr")


def test_account_numbers_stay_valid_and_apart():
    olds = {f"DE{pii.iban_check('DE', rest)}{rest}" for rest in (f"{i:018d}" for i in range(2000))}
    news = {pii.surrogate("iban", v, "k") for v in olds}
    assert len(news) == 2000 and all(pii.iban_check(v[:2], v[4:]) == v[2:4] and len(v) == 22 for v in news)


def test_exhausted_formats_fall_to_a_free_name(spark, monkeypatch):
    real = pii.surrogate
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    monkeypatch.setattr(pii, "surrogate", lambda kind, v, key, attempt=0: "same" if attempt < 2 else real(kind, v, key, attempt))
    known = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(20)], "kind string, value string")
    tried = {r.value: r.attempt for r in pii.resolve_collisions(known, "k").collect()}
    assert len(tried) == 19 and set(tried.values()) == {2}
    assert len({pii.surrogate("ssn", v, "k", 2) for v in tried}) == 19
    assert pii.fit_layout("ssn", "000-00-0001", pii.surrogate("ssn", "000000001", "k", 2)).startswith("ssn-")
