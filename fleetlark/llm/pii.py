"""Operator 1: personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in a text: at-signs, plus signs, digits, schemes
and identifier cues. From each anchor a deterministic local parser expands to the boundaries
of a candidate and checks it; no pattern runs over the text.

Base kinds and what they accept, leftmost and non-overlapping for each kind:

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     four dotted numbers, none above 255
* ``card``   digits with at most one space or hyphen between two, 13 to 19 of them, Luhn sum right
* ``phone``  ``\\+[0-9][ ().0-9-]+[0-9]`` with 9 to 15 digits

Kinds added by cues, in any case: ``account`` (after iban, an IBAN whose mod-97 check holds; after ssn,
social security or account, their number; the word number, num, no or nr may stand between), ``address`` (a URL that carries user information before its
host), ``credential`` (the value after ``password=``, ``secret=``, ``token = ``, and AWS key ids).

Defined cases: null and empty texts have no spans. Rows are treated one by one, so repeated rows
and ids, extra columns and empty tables need no care; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlark.llm.common import table, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("account", "address", "credential")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
ACCOUNT_CUES = ("iban", "ssn", "social security", "account")
NUMBER_WORDS = ("number", "num", "no", "nr")
SECRET_CUES = ("password", "passwd", "secret", "token", "api_key")

_DIGIT = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LABEL = _ALNUM | {"-"}
_LOCAL = _ALNUM | set("._%+-")
_PHONE = _DIGIT | set(" ().-")
_SECRET = _ALNUM | set("+/_-")


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at a place."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign; nothing before ``floor`` may belong to it."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    whole = None
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        whole = end = more
    return (start, whole) if whole else None


def ips_at(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of dotted numbers that starts at a digit, and the chain's end."""
    parts = [(at, _run(text, at, _DIGIT))]
    while (dot := parts[-1][1]) < len(text) and text[dot] == "." and (end := _run(text, dot + 1, _DIGIT)) > dot + 1:
        parts.append((dot + 1, end))
    found = []
    for k in range(0, len(parts) - 3, 4):
        values = [text[a:b].lstrip("0") for a, b in parts[k:k + 4]]
        if all(len(v) <= 3 and int(v or 0) <= 255 for v in values):
            found.append((parts[k][0], parts[k + 3][1]))
    return found, parts[-1][1]


def card_at(text: str, at: int) -> tuple[bool, int]:
    """Whether the run of digits and single separators from here is a card, and its end."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in _DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGIT:
            end += 2
        else:
            break
    if not 13 <= end - at <= 37:
        return False, end
    digits = text[at:end].replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits), end


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _run(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    digits = sum(c in _DIGIT for c in text[at:end])
    return (at, end) if 9 <= digits <= 15 else None


def iban(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not (value[:2].isascii() and value[:2].isalpha() and value[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in (value[4:] + value[:4]).upper())) % 97 == 1


def _skip(text: str, at: int, most: int = 3) -> int:
    """Past the separators between a cue and its value."""
    end = at
    while end < len(text) and end < at + most and text[end] in ' :#="\'':
        end += 1
    return end


def _skip_number_word(text: str, at: int) -> int:
    """Past a word such as "No." and the separators after it, which must be there."""
    for word in NUMBER_WORDS:
        if text[at:at + len(word)].lower() == word:
            end = at + len(word)
            end = _skip(text, end + (text[end:end + 1] == "."))
            return end if end > at + len(word) else at
    return at


def account_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    start = _skip(text, end)
    if start == end:
        return None
    start = _skip_number_word(text, start)
    if cue == "iban":
        stop = start  # groups of four, apart by single spaces
        while stop < len(text) and stop < start + 42 and (text[stop] in _ALNUM or text[stop] == " "):
            stop += 1
        for cut in range(stop, start, -1):
            if text[cut - 1] != " " and (cut == len(text) or text[cut] not in _ALNUM) and iban(text[start:cut].replace(" ", "")):
                return start, cut
        return None
    stop = _run(text, start, _DIGIT | {"-"})
    digits = text[start:stop].replace("-", "")
    if stop > start and text[stop - 1] != "-" and (len(digits) == 9 if cue != "account" else 8 <= len(digits) <= 17):
        return start, stop
    return None


def address_at(text: str, end: int) -> tuple[int, int] | None:
    """The user information and host that follow a scheme, if there is user information."""
    stop = _run(text, end, _LOCAL | set(":~!$&'()*,;="))
    if stop == end or stop >= len(text) or text[stop] != "@":
        return None
    host = _run(text, stop + 1, _LABEL | {"."})
    return (end, host) if host > stop + 1 else None


def credential_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    if cue == "akia":
        if text[end - 4:end] != "AKIA":
            return None
        stop = _run(text, end, _ALNUM)
        alone = end == 4 or text[end - 5] not in _ALNUM
        value = text[end:stop]
        return (end - 4, stop) if alone and len(value) == 16 and value == value.upper() else None
    start = _skip(text, end, 4)
    if not set(text[end:start]) & set("=:"):
        return None
    stop = _run(text, start, _SECRET)
    return (start, stop) if stop - start >= 8 and any(c in _DIGIT for c in text[start:stop]) else None


def automaton():
    """Every anchor with its class, in lower case, for texts lower-cased by ``lowered``."""
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", c))
    found.add_word("@", ("at", "@"))
    found.add_word("+", ("plus", "+"))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("secret", ("akia",))):
        for word in words:
            found.add_word(word, (kind, word))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text with A to Z in lower case; places stay, as no other character changes."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order, as code points with the end left out."""
    out: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS + ADDED_KINDS}
    ip_from = card_from = 0
    for last, (kind, word) in anchors.iter(lowered(text)):
        if kind == "digit":
            if last >= ip_from:
                spans, ip_from = ips_at(text, last)
                out["ip"] += spans
            if last >= card_from:
                good, card_from = card_at(text, last)
                if good:
                    out["card"].append((last, card_from))
            continue
        span = None
        if kind == "at":
            kind, floor = "email", out["email"][-1][1] if out["email"] else 0
            span = email_at(text, last, floor)
        elif kind == "plus":
            kind, span = "phone", phone_at(text, last)
        elif kind == "account":
            span = account_at(text, word, last + 1)
        elif kind == "scheme":
            kind, span = "address", address_at(text, last + 1)
        else:
            kind, span = "credential", credential_at(text, word, last + 1)
        if span and (not out[kind] or span[0] >= out[kind][-1][1]):
            out[kind].append(span)
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def detect_pii(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, spans)``: all spans of a text, base kinds first, each kind in order."""
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            spans = [[{"kind": kind, "start": a, "end": b} for kind, found in find_spans(text, anchors).items() for a, b in found]
                     for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    return docs.select("doc_id", text_or_empty().alias("text")).mapInPandas(
        detect, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def op1_pii(spark, sf_dir) -> DataFrame:
    found = detect_pii(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [f"CAST(size(filter(spans, s -> s.kind = '{kind}')) AS long) AS n_{kind}" for kind in BASE_KINDS]
    return found.selectExpr("doc_id", *counts, f"sha2({joined.format(base)}, 256) AS base_sha256", f"{joined.format('spans')} AS spans")
