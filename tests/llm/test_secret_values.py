"""Values that are priced whatever their letters, and values that a base span cuts."""

import time

import pytest

from quern.llm import secrets


@pytest.mark.parametrize("text", ["pwd: kXvQwpLzRtYbNm", "passphrase: correct-horse-battery-zqv", "password: kXv!wpL#RtY"])
def test_values_without_digits_are_priced(text):
    value = text.split()[1]
    assert [text[s:e] for s, _, e in secrets.guess_spans(text, secrets.base_spans(text))] == [value]
    assert secrets.redacted(text) == text.split()[0] + " [SECRET]"


def test_value_beyond_its_base_span_goes_whole():
    text = "x password: Abcdefghijkl$9xQ!z y"
    base = secrets.base_spans(text)
    assert [text[s:e] for s, _, e in base] == ["password: Abcdefghijkl"]
    assert [text[s:e] for s, _, e in secrets.guess_spans(text, base)] == ["Abcdefghijkl$9xQ!z"]
    assert secrets.redacted(text) == "x [SECRET] y"


def test_cheap_values_and_whole_base_spans_stay():
    for text in ("password: changeme", "login: password2019", "token: abcdefghijklmnop", "secret: aaaaaaaaaaaa"):
        assert not secrets.guess_spans(text, secrets.base_spans(text))


def test_names_in_chains_and_quoted_values_lose_nothing():
    for text, value in (
        ("login: password= Qx$7!kd9&zPw@3", "Qx$7!kd9&zPw@3"), ("secret: passphrase: correct-horse-battery-zqv", "correct-horse-battery-zqv"), ("password = 'Qx7 kd9, zPw33'", "Qx7 kd9, zPw33"),
        ('{"db_password_prod": "a;b <Zk9 wq!xx>"}', "a;b <Zk9 wq!xx>"), ("token = 'no end Zk9$wq!xx77", ""), ("my-api-key=Zk9$wq!xx77Pq.", "Zk9$wq!xx77Pq"), ("token__x: Zk9$wq!xx77Pq", ""),
    ):
        spans = secrets.guess_spans(text, secrets.base_spans(text))
        assert [text[s:e] for s, _, e in spans] == ([value] if value else [])
        assert secrets.redacted(text) == (text.replace(value, "[SECRET]") if value else text)


def test_hostile_texts_take_linear_time():
    for part in ("token_", "token:", "token: ", "token='", 'token="a', "_-", "login: ", "password:!", "token......"):
        took = []
        for n in (1 << 16, 1 << 18):
            text = part * (n // len(part))
            began = time.process_time()
            secrets.redacted(text)
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5
