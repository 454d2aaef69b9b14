"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, schemes, digits, plus signs and
identifier cues in one pass; a parser of each kind expands an anchor to its
boundaries and validates what it found.  No parser looks at a character
twice for two anchors of its kind, so a text costs time in proportion to
its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectspark.session import ship_package

#: Kinds in the order of the result.  The first four are validated patterns;
#: the others are found from cues: an account number (IBAN) behind its name,
#: an address with a login, and the value of a token, key or password.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address", "identifier")

ACCOUNT_CUES = ("IBAN", "iban", "Iban")
IDENTIFIER_CUES = ("token", "Token", "TOKEN", "password", "Password", "PASSWORD", "secret", "Secret", "api_key",
                   "API_KEY", "apikey")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"[\s:]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/@:\"'<>]+:[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
VALUE = re.compile(r"[\"']?\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_-]{16,})")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid_account(number: str) -> bool:
    """The remainder by 97 of the number with its first four characters last."""
    turned = number[4:] + number[:4]
    return 15 <= len(number) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def email_at(text: str, at: int, start: int) -> Span | None:
    """Around an at-sign; the local part does not reach before ``start``."""
    begin = at
    while begin > start and text[begin - 1] in LOCAL:
        begin -= 1
    found = DOMAIN.match(text, at + 1) if begin < at else None
    return (begin, found.end()) if found else None


def ips_at(text: str, at: int) -> tuple[list[Span], int]:
    """Groups of four in the chain of dotted numbers from a digit, and its end."""
    chain = DOTTED.match(text, at)
    parts, spans, begin = chain.group().split("."), [], at
    for k in range(0, len(parts), 4):
        group = parts[k:k + 4]
        end = begin + sum(map(len, group)) + len(group) - 1
        small = (p.lstrip("0") or "0" for p in group)
        if len(group) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in small):
            spans.append((begin, end))
        begin = end + 1
    return spans, chain.end()


def card_at(text: str, at: int) -> tuple[Span | None, int]:
    """The chain of digits with single separators from a digit, and its end."""
    chain = CHAIN.match(text, at)
    digits = chain.group().replace(" ", "").replace("-", "")
    return ((at, chain.end()) if 16 <= len(digits) <= 19 and luhn(digits) else None), chain.end()


def phone_at(text: str, at: int) -> tuple[Span | None, int]:
    found = PHONE.match(text, at)
    if not found:
        return None, at
    digits = sum(c in "0123456789" for c in found.group())
    return ((at, found.end()) if 8 <= digits <= 15 else None), found.end()


def account_at(text: str, after: int) -> Span | None:
    found = ACCOUNT.match(text, after)
    return found.span(1) if found and valid_account(found.group(1).replace(" ", "")) else None


def address_at(text: str, at: int) -> Span | None:
    """A scheme's ``://`` with a login behind it."""
    begin = at
    while begin > 0 and at - begin < 32 and text[begin - 1] in SCHEME:
        begin -= 1
    found = LOGIN.match(text, at + 3) if begin < at else None
    return (begin, found.end()) if found else None


def identifier_at(text: str, after: int) -> Span | None:
    found = VALUE.match(text, after)
    return found.span(1) if found else None


_AUTOMATON = []


def automaton():
    """One automaton per worker: an anchor's end gives its kind and length."""
    if not _AUTOMATON:
        import ahocorasick

        found = ahocorasick.Automaton()
        for kind, words in (("@", "@"), ("+", "+"), ("digit", "0123456789"), ("://", ("://",)),
                            ("account", ACCOUNT_CUES), ("identifier", IDENTIFIER_CUES)):
            for word in words:
                found.add_word(word, (kind, len(word)))
        found.make_automaton()
        _AUTOMATON.append(found)
    return _AUTOMATON[0]


def private_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of all spans, by kind and start."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    email_end = dotted_end = chain_end = phone_end = 0
    for last, (anchor, size) in automaton().iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= dotted_end:
                found, dotted_end = ips_at(text, at)
                spans["ip"] += found
            if at >= chain_end:
                one, chain_end = card_at(text, at)
                spans["card"] += [one] * (one is not None)
            continue
        one = kind = None
        if anchor == "@":
            kind, one = "email", email_at(text, at, email_end)
            email_end = one[1] if one else email_end
        elif anchor == "+":
            if at >= phone_end:
                kind, (one, phone_end) = "phone", phone_at(text, at)
        elif anchor == "://":
            kind, one = "address", address_at(text, at)
        elif anchor == "account":
            kind, one = "account", account_at(text, last + 1)
        else:
            kind, one = "identifier", identifier_at(text, last + 1)
        if one:
            spans[kind].append(one)
    return [(k, b, e) for k in KINDS for b, e in sorted(set(spans[k]))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: kind, start and end of all personal data.

    Spans of a kind do not overlap; those of different kinds may.  A null
    text has none.  Rows are scanned one by one, whole: ids may be null or
    repeated, other columns are not read.
    """
    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in private_spans(text.as_py() or "")]
                     for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
