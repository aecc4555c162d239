"""Personal data in texts: patterns propose spans, checksums and ranges confirm them, words nearby move their score.

A proposal has the score of its kind; each kind's context words within WINDOW characters add CONTEXT. Spans of the four base kinds
are sure once confirmed and stay whatever the context. Of the added kinds those with a score of ACCEPT or more stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel", "key", "secret")
WINDOW, CONTEXT, ACCEPT = 48, 0.3, 0.5
#: Score of a confirmed proposal without context.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.2, "key": 0.9, "secret": 0.3}
WORDS = {
    "email": r"e-?mail|contact|mail", "ip": r"ip|address|host|server|login", "card": r"card|visa|credit|payment|karte|carte|tarjeta", "phone": r"phone|call|tel|mobile|fax",
    "iban": r"iban|account|bank|konto|compte|cuenta", "ssn": r"ssn|social security", "tel": r"phone|call|tel|mobile|fax", "key": r"key|secret|token|password",
    "secret": r"(?:api|access|private|client|auth)?[_ -]?(?:key|secret|token|password|passwd|pwd|credential)s?|bearer",
}
NEAR = {k: re.compile(rf"(?<!\w)(?:{w})(?!\w)", re.IGNORECASE) for k, w in WORDS.items()}
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that failed at the start of a run of digits fails everywhere in it, so looking behind changes no match and keeps it linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
TEL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
#: Long runs of hexadecimal digits, of one case with a letter and a digit, or of base 64 with a capital, a small letter and a digit.
SECRET = re.compile(r"(?<![A-Za-z0-9+/])(?:(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}+|(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{32,}+|(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,}+={0,2}+)(?![A-Za-z0-9+/])")
#: Length of an account number by country; fixed values.
IBAN_LENGTH = {"AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24}

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the characters before an @ back to the last match, then the domain. Linear however long the runs are."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def account(m: re.Match) -> int | None:
    """Where the account number in a proposal ends, if its country's length and its check digits hold."""
    seen, want = 0, IBAN_LENGTH.get(m[0][:2], 0)
    for i, c in enumerate(m[0]):
        seen += c != " "
        if seen == want:
            return m.start() + i + 1 if mod97(m[0][: i + 1].replace(" ", "")) else None
    return None


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of all kinds, by kind and then start."""
    yield from (("email", s, e) for s, e in emails(text))
    yield from (("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    yield from (("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15)
    yield from (("iban", m.start(), end) for m in IBAN.finditer(text) if (end := account(m)))
    yield from (("ssn", *m.span()) for m in SSN.finditer(text))
    yield from (("tel", *m.span()) for m in TEL.finditer(text))
    yield from (("key", *m.span()) for m in KEY.finditer(text))
    yield from (("secret", *m.span()) for m in SECRET.finditer(text))


def spans(text: str) -> list[Span]:
    """(kind, start, end, score) in code points, end exclusive, by kind and then start."""
    out: list[Span] = []
    for kind, s, e in proposals(text):
        near = NEAR[kind].search(text[max(0, s - WINDOW): s]) or NEAR[kind].search(text[e: e + WINDOW])
        score = min(1.0, SCORE[kind] + CONTEXT * bool(near))
        if score >= ACCEPT and not (kind == "tel" and any(a < e and s < b for k, a, b, _ in out if k in ("phone", "card"))):
            out.append((kind, s, e, round(score, 2)))
    return out


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of kind, start, end, score) of every row; null text is empty and has none.

    Repeated rows give repeated results, null doc_ids stay, an empty table gives an empty result. Overlapping spans of different
    kinds are all listed.
    """
    found = F.pandas_udf(lambda s: s.map(lambda t: [{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in spans(t)]), "array<struct<kind:string,start:long,end:long,score:double>>")
    return texts(docs).select("doc_id", found("text").alias("spans"))


def masked(text: str) -> str:
    """The text with each span, overlapping ones as one, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` masked and `n_chars`, if there, counted again; null texts stay null."""
    mask = F.pandas_udf(lambda s: pd.Series([None if t is None else masked(t) for t in s], dtype=object), "string")
    out = docs.withColumn("text", mask("text"))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
