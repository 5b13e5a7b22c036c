"""Personal data: regular expressions propose spans, checksums and ranges confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A failing run of digits is left at once: no later start within it could match either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_CODE = re.compile(r"[A-Z0-9](?:\x20?[A-Z0-9])*+")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"""[=:]\x20?(["'])([A-Za-z0-9_+/=-]{20,}+)\1""")
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Characters of a country's IBANs, as registered.
IBAN_LENGTHS = {c: int(n) for c, n in (x.split(":") for x in """
AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20
EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30
KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15
OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23
TN:24 TR:26 UA:29 VA:22 VG:24 XK:20""".split())}
#: Score before context, words that raise it, words that lower it. Words stand for all that begin with them, those of up
#: to four letters for themselves and their plural only.
CONTEXT = {
    "email": (0.9, ("mail", "email", "contact", "write", "address"), ("package", "version")),
    "ip": (0.6, ("ip", "host", "server", "login", "address"), ("version", "release", "section", "chapter")),
    "card": (0.8, ("card", "visa", "pay", "paid", "payment", "credit", "expir"), ("order", "tracking", "serial", "part")),
    "phone": (0.7, ("call", "phone", "tel", "telephone", "mobile", "fax"), ("version", "serial")),
    "iban": (0.8, ("iban", "bank", "account", "transfer"), ("part", "serial")),
    "national_id": (0.45, ("ssn", "social", "security", "tax", "id"), ("part", "order", "version")),
    "local_phone": (0.5, ("call", "phone", "tel", "telephone", "mobile", "fax"), ("serial", "order")),
    "secret": (0.4, ("token", "key", "apikey", "secret", "password", "passwd", "auth", "authorization"), ("class", "href", "style")),
}
WINDOW, STEP, KEEP = 40, 0.15, 0.5


def _any_word(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"(?<![^\W_])(?:" + "|".join(w + r"s?(?![^\W_])" * (len(w) <= 4) for w in words) + ")")


_CONTEXT = {kind: (prior, _any_word(up), _any_word(down)) for kind, (prior, up, down) in CONTEXT.items()}
_CUT_FIRST, _CUT_LAST = re.compile(r"^[^\W_]+"), re.compile(r"[^\W_]+$")


def nearby(text: str, start: int, end: int) -> str:
    """The whole words within WINDOW characters of a span, in lower case."""
    before, after = text[max(0, start - WINDOW - 1) : start], text[end : end + WINDOW + 1]
    before = _CUT_FIRST.sub("", before) if len(before) > WINDOW else before
    after = _CUT_LAST.sub("", after) if len(after) > WINDOW else after
    return f"{before}\n{after}".lower()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Codes of their country's length, blanks between characters aside, that end where a word ends and pass mod-97. The
    words after a code aren't part of it, even if they look alike."""
    done = 0
    for m in _IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[0][:2])
        if not n or m.start() < done:
            continue
        # every character may have a blank before it
        run = _CODE.match(text, m.start(), m.start() + 2 * n)
        ends = [k for k, c in enumerate(run[0], m.start() + 1) if c != " "]
        if len(ends) >= n and not text[ends[n - 1] : ends[n - 1] + 1].isalnum() and mod97(text[m.start() : ends[n - 1]]):
            done = ends[n - 1]
            yield m.start(), done


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from the @ signs: the user part is the whole run before one, so long runs of letters
    are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _USER:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (done := m.end())
        at = text.find("@", max(done, at + 1))


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, checked) by start, then kind. Base kinds are all kept; the other kinds from KEEP on."""
    found = [("email", a, b, False) for a, b in emails(text)]
    found += [("ip", *m.span(), True) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(("card", *m.span(), True))
    phones = []
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [("phone", *s, True) for s in phones]
    found += [("iban", *s, True) for s in ibans(text)]
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            found.append(("national_id", *m.span(), True))
    if "(" in text:
        found += [("local_phone", *m.span(), False) for m in _LOCAL_PHONE.finditer(text) if not any(a <= m.start() < b for a, b in phones)]
    if '"' in text or "'" in text:
        found += [("secret", *m.span(2), False) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m[2])]
    out = []
    for kind, start, end, checked in found:
        prior, up, down = _CONTEXT[kind]
        near = nearby(text, start, end)
        score = prior + STEP * bool(up.search(near)) - STEP * bool(down.search(near))
        if kind in BASE_KINDS or score >= KEEP:
            out.append((kind, start, end, round(min(1.0, score), 2), checked))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind: string, start: long, end: long, score: double, checked: boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("checked", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` of every document, one row per input row; other columns are ignored.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans; equal texts have equal spans;
    an empty table gives an empty result. Texts are read whole, in slices of bounded size, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8_000_000):
            spans = [[dict(zip(("kind", "start", "end", "score", "checked"), s)) for s in spans_of(t or "")] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _ARROW)], ["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact_text(text: str) -> str:
    """Spans give way to their kind in brackets; of overlapping spans the first names the whole."""
    out, end = [], 0
    covered: list[list] = []
    for kind, a, b, _, _ in spans_of(text):
        if covered and a < covered[-1][2]:
            covered[-1][2] = max(covered[-1][2], b)
        else:
            covered.append([kind, a, b])
    for kind, a, b in covered:
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def redacted(text: Column) -> Column:
    """``text`` with personal data replaced; null stays null, texts without any are unchanged."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(redact_text, na_action="ignore")

    return redact(text)


def query(spark, sf_dir: str) -> DataFrame:
    """The spans of every document, as text and counted, and the digest of its base spans."""
    x = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return x.select("doc_id", *map(count, BASE_KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
