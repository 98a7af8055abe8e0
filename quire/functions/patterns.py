"""Validated pattern finders: e-mail addresses, payment cards, IBANs, phone numbers and dates.

E-mails and cards are native expressions. The other three need a check inside the scan and run as Arrow
pandas UDFs behind a native pre-filter.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
EMAIL = r"[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]*+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?=[.\-]*(?:[^A-Za-z0-9.\-]|$))"
# A whole run of digit groups, and the letter or digit that may spoil its end.
DIGIT_RUN = rf"(?<!{ALNUM})[0-9]++(?:[ -][0-9]++)*+{ALNUM}?"
CARD_SHAPE = r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}([ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"


def emails(text: Column) -> Column:
    """Array of addresses; the filter on @ spares the scan most lines."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def cards(text: Column) -> Column:
    """Array of card numbers of 13 to 19 digits in a usual grouping with a right check digit."""
    runs = F.regexp_extract_all(text, F.lit(DIGIT_RUN), F.lit(0))
    good = F.filter(runs, lambda r: r.rlike(CARD_SHAPE) & F.call_function("luhn_check", F.regexp_replace(r, "[ -]", "")))
    return F.when(text.rlike("[0-9]"), good).otherwise(F.array().cast("array<string>"))


# English names of months.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join([*MONTHS, *(rf"{m[:3]}\.?" for m in MONTHS), r"sept\.?"])
_YEAR = r"[12][0-9]{3}(?![\p{L}\p{M}\p{N}])"
_NUMERIC = regex.compile(r"([0-9]{1,4}+)([-/.])([0-9]{1,2}+)\2([0-9]{1,4}+)(?![\p{L}\p{N}])(?![-/][0-9])")
_WORDED = regex.compile(
    rf"(?i)(?:(?P<d>[0-9]{{1,2}}+)(?:st|nd|rd|th)? (?:{_MONTH})(?<=[\p{{L}}.])(?!\p{{L}}),? ?{_YEAR}"
    rf"|(?:{_MONTH})(?!\p{{L}}) (?:(?P<e>[0-9]{{1,2}}+)(?:st|nd|rd|th)?,? ?)??{_YEAR})"
)
_BEFORE = regex.compile(r"(?<![\p{L}\p{N}])(?=[\p{L}0-9])")


def date_at(text: str, at: int) -> int | None:
    """End of a date that starts at ``at``."""
    if m := _NUMERIC.match(text, at):
        a, b, d, la, ld = int(m[1]), int(m[3]), int(m[4]), len(m[1]), len(m[4])
        if la == 4 and ld <= 2 and 1000 <= a <= 2999 and 1 <= b <= 12 and 1 <= d <= 31:
            return m.end()
        if la <= 2 and a and b and min(a, b) <= 12 and max(a, b) <= 31 and (ld == 2 or (ld == 4 and 1000 <= d <= 2999)):
            return m.end()
    if (m := _WORDED.match(text, at)) and 1 <= int(m["d"] or m["e"] or 1) <= 31:
        return m.end()
    return None


def date_spans(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _BEFORE.finditer(text):
        if m.start() >= end and (found := date_at(text, m.start())):
            end = found
            out.append((m.start(), end))
    return out


_SEP = r"[ \-.()/]"
_PHONE = regex.compile(rf"(?<![\p{{L}}\p{{N}}+\-./@#])(?:\+(?:{_SEP}{{0,2}}[0-9])++|\({_SEP}?[0-9](?:{_SEP}{{0,2}}[0-9])*+|[0-9](?:{_SEP}{{0,2}}[0-9])*+)")


def phone_spans(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _PHONE.finditer(text):
        run = m[0]
        groups = regex.findall("[0-9]+", run)
        digits = sum(map(len, groups))
        if regex.match(r"[\p{L}\p{N}]", text[m.end() : m.end() + 1]) or regex.fullmatch(r"[0-9]+\.[0-9]+", run):
            continue
        if (dated := date_at(text, m.start())) and dated >= m.end():
            continue
        low, high = {"+": (8, 15), "(": (7, 15), "0": (9, 12)}.get(run[0], (10, 11))
        if low <= digits <= high and (run[0] in "+(0" or len(groups) >= 3):
            out.append(m.span())
    return out


_IBAN = regex.compile(r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*+")


def iban_spans(text: str) -> list[tuple[int, int]]:
    """The longest prefix of each candidate that ends at a word's end and has remainder 1 modulo 97."""
    out, end = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < end:
            continue
        for stop in range(m.end(), m.start() + 14, -1):
            compact = text[m.start() : stop].replace(" ", "")
            if text[stop - 1] == " " or not 15 <= len(compact) <= 34 or regex.match(r"[\p{L}\p{N}]", text[stop : stop + 1]):
                continue
            if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                end = stop
                out.append((m.start(), end))
                break
    return out


SPANS = {"date": date_spans, "phone": phone_spans, "iban": iban_spans}
#: What a line must have for a finder to be worth calling.
NEEDS = {"email": "@", "card": "[0-9]{4}", "date": "[0-9]{2}", "phone": "[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9].*[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}


def may_hold(text: Column, patterns: list[str]) -> Column:
    """Whether a finder is worth calling: a filter on it keeps all other lines from Python."""
    return text.rlike("|".join(f"(?:{NEEDS[p]})" for p in patterns))


def found_in(text: Column, pattern: str) -> Column:
    """Array of the texts that a finder marks."""
    if pattern in ("email", "card"):
        return {"email": emails, "card": cards}[pattern](text)
    spans = SPANS[pattern]

    @F.pandas_udf("array<string>")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: [t[a:b] for a, b in spans(t)] if t else [])

    return F.when(text.rlike(NEEDS[pattern]), run(F.when(text.rlike(NEEDS[pattern]), text))).otherwise(F.array().cast("array<string>"))
