"""PII against the plain patterns, applied literally."""

import hashlib
import random
import re

from sensorlake.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        total += sum(map(int, str(int(c) * (1 + k % 2))))
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def base(text):
    return [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS]


def test_base_spans_equal_the_plain_patterns_on_random_texts():
    rng = random.Random(3)
    pieces = ["a", "B7", "@", ".", "..", "-", " ", "1", "4111 1111 1111 1111", "256", "10.0.0.1", "+1 (743) 555-3824", "x.y@z.com", "é", "+", "(", "%", "\n", "0", "9.", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert base(text) == plain(text), text


def test_base_spans_equal_the_plain_patterns_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for r in rows:
        assert base(r.text or "") == plain(r.text or "")


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "@" * 200_000, "a@" * 100_000):
        pii.spans_of(text)


def test_added_kinds_and_context():
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    assert kinds("bank iban GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("bank iban GB83 WEST 1234 5698 7654 32 please") == []
    assert kinds("my social security number is 123-45-6789") == ["national_id"]
    assert kinds("the part 123-45-6789") == []
    assert pii.spans_of("pay by card 4111 1111 1111 1111")[0][3] > pii.spans_of("order 4111 1111 1111 1111")[0][3]
    assert pii.redact_text("write to a.b@c.org or +1 (743) 555-3824.") == "write to [EMAIL] or [PHONE]."


def test_nulls_empty_repeated_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "a@b.co", "y"), (3, "a@b.co", "y")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 5 and [len(r.spans) for r in out] == [0, 0, 1, 1, 1]
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "ip 10.0.0.1, mail a@b.co, id 1"), (2, None), (3, 'secret token = "aaaabbbbccccdddd11112222"')], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert got[1].spans == "ip:3:11,email:18:24"
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert (got[3].n_spans, got[3].spans, got[3].base_sha256) == (1, "secret:16:40", hashlib.sha256(b"").hexdigest())
    assert got[1].n_spans == 2 and got[2].n_spans == 0
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_ibans_end_at_their_country_s_length():
    def found(text):
        return [text[a:b] for k, a, b, *_ in pii.spans_of(text) if k == "iban"]

    assert found("IBAN: DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert found("IBAN DE89 3704 0044 0532 0130 00 EUR 100") == ["DE89 3704 0044 0532 0130 00"]
    assert found("GB82WEST12345698765432 USD") == ["GB82WEST12345698765432"]
    assert found("to NO93 8601 1117 947 and FR14 2004 1010 0505 0001 3M02 606.") == ["NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    for wrong in ("DE89370400440532013001", "DE8937040044053201300", "DE893704004405320130000", "DE89370400440532013000X", "ZZ82WEST12345698765432", "xDE89370400440532013000", "DE89  370400440532013000"):
        assert found(f"iban {wrong} end") == []
    assert found("DE89370400440532013000 DE89370400440532013000") == ["DE89370400440532013000"] * 2
