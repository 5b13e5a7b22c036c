import time

from sensorlake.llm import pii


def test_long_secrets_are_found_and_redacted():
    for n in (20, 200, 201, 5000):
        value = "a1B2" * (n // 4) + "x" * (n % 4)
        text = f'token = "{value}" and more'
        assert [(k, text[a:b]) for k, a, b, *_ in pii.spans_of(text) if k == "secret"] == [("secret", value)]
        assert value[-20:] not in pii.redact_text(text)


def test_open_quotes_are_linear():
    begun = time.time()
    pii.spans_of('="' + "a=" * 500_000)
    pii.spans_of('="a1' * 250_000)
    assert time.time() - begun < 20


def kinds(text):
    return [(k, text[a:b]) for k, a, b, *_ in pii.spans_of(text)]


def test_secrets_after_colons_and_in_single_quotes():
    for text in ('password: "abcdefghij0123456789xyzabc"', "token='abcdefghij0123456789xyzabc'", '{"api_key": "abcdefghij0123456789xyzabc"}'):
        assert kinds(text) == [("secret", "abcdefghij0123456789xyzabc")], text
    assert kinds("token='abcdefghij0123456789xyzabc\"") == []


def test_context_is_whole_words():
    for text in ("She said the model was 123-45-6789 in that box", "a wide road 123-45-6789 for that box", "said" + " " * 36 + "123-45-6789", "123-45-6789" + " " * 37 + "identity"):
        assert kinds(text) == [], text
    for text in ("her id is 123-45-6789", "IDs: 123-45-6789", "social security 123-45-6789", "tax_id 123-45-6789", "123-45-6789 (SSN)"):
        assert kinds(text) == [("national_id", "123-45-6789")], text
    score = lambda text: pii.spans_of(text)[0][3]
    assert score("a ship at 10.0.0.1 x") == 0.6 and score("the ip 10.0.0.1 x") == 0.75
    assert score("hotel room +1 743 555 3824") == 0.7 and score("telephone +1 743 555 3824") == 0.85
    assert score("the party 4111 1111 1111 1111") == 0.8 and score("part 4111 1111 1111 1111") == 0.65
