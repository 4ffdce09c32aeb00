"""How a locale writes numbers, amounts and dates: offences of a text against it, and rewriting."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import locales as L
from . import entities as E

#: Names of separators in messages.
NAMES = {".": "a full stop", ",": "a comma", "'": "an apostrophe", "’": "a typographic apostrophe", " ": "a space", " ": "a no-break space", " ": "a narrow no-break space", " ": "a thin space"}


def _group(digits: str, sep: str) -> str:
    return regex.sub(r"(?<=\d)(?=(\d{3})+$)", sep, digits)


def spelled(e: dict, p: L.Locale, raw: str) -> str | None:
    """A number token as locale p writes it: grouped if it was, its decimals as they are; None for codes."""
    v = e["value"]
    if v is None or v.startswith("#"):
        return None
    whole, dot, frac = v.partition(".")
    grouped = bool(regex.search(r"\d['’    .,]\d", raw[: len(raw) - (len(frac) + 1 if dot else 0)]))
    dash = regex.search(r"[.,](--|[-–—])$", raw)
    out = _group(whole, p.thousands) if grouped else whole
    if dot:
        return f"{out}{p.decimal}{frac}"
    return f"{out}{p.decimal}{dash[1]}" if dash and p.keep_dash else out


def number_of(e: dict) -> str:
    return regex.search(E.NUMBER, e["raw"])[0]


def expected(e: dict, p: L.Locale) -> str | None:
    """How p writes an entity; None if it is never rewritten."""
    if e["kind"] == "date":
        d, m, y = regex.split(r"[./-]", e["raw"])
        two = (lambda s: s.zfill(2)) if p.pad else str
        return f"{two(d)}{p.date_sep}{two(m)}{p.date_sep}{y}"
    if e["kind"] in ("number", "unit"):
        return spelled(e, p, number_of(e))
    if e["kind"] == "currency":
        n = spelled(e, p, number_of(e))
        if n is None:
            return None
        mark = L.CURRENCIES[e["currency"]]
        gap = " " if p.space == "nbsp" else " "
        gap = "" if p.space == "none" and not mark.isalpha() else gap
        return f"{mark}{gap}{n}" if p.position == "before" else f"{n}{gap}{mark}"
    return None


def offences(text: str, locale: str) -> list[tuple[str, int, int, str]]:
    """(aspect, start, end, expected) of what in a text isn't written as the locale writes it."""
    p, out = L.PROFILES[locale], []
    for e in E.extract(text, p.language):
        want = expected(e, p)
        if want is None:
            continue
        aspect = {"date": "date", "currency": "currency"}.get(e["kind"], "number")
        have = number_of(e) if aspect == "number" else e["raw"]
        plain = lambda s: regex.sub(r"[   ]", " ", s)
        seps = set(regex.findall(r"(?<=\d)[^\d](?=\d{3}(?!\d))", have)) if aspect == "number" else set()
        if plain(have) != plain(want) and not (seps and seps <= {*p.accepted, p.decimal} and regex.sub(r"\D", "", have) == regex.sub(r"\D", "", want) and have.count(p.decimal) <= 1 and "." not in seps - {*p.accepted}):
            if not (aspect == "currency" and p.either_side and number_of(e) in want):
                at = e["start"] + e["raw"].index(have)
                out.append((aspect, at, at + len(have), want))
    return out


def normalize(source: str, target: str, source_lang: str, locale: str) -> tuple[str, list[tuple[str, str, str]]]:
    """The target with the counterparts of the source's numbers, amounts and dates as the locale writes them, and (aspect, from, to) of each change."""
    p, edits, used, changes = L.PROFILES[locale], [], set(), []
    theirs = [(i, e) for i, e in enumerate(E.extract(target, p.language)) if e["kind"] in ("number", "unit", "currency", "date")]
    for s in E.extract(source, source_lang):
        want = expected(s, p)
        if want is None:
            continue
        same = lambda t: {"unit": "number"}.get(t["kind"], t["kind"]) == {"unit": "number"}.get(s["kind"], s["kind"]) and t["currency"] == s["currency"]  # noqa: B023, E731
        digits = lambda x: regex.sub(r"\D", "", x["raw"])
        pool = [(i, t) for i, t in theirs if i not in used and same(t)]
        hit = next(((i, t) for i, t in pool if t["raw"] == s["raw"] or want in (t["raw"], number_of(t) if t["kind"] != "date" else "")), None) or next(((i, t) for i, t in pool if t["value"] == s["value"] and digits(t) == digits(s)), None)
        if hit is None:
            continue
        used.add(hit[0])
        t = hit[1]
        aspect = {"date": "date", "currency": "currency"}.get(s["kind"], "number")
        have = number_of(t) if aspect == "number" else t["raw"]
        if have != want:
            at = t["start"] + t["raw"].index(have)
            edits.append((at, at + len(have), want))
            changes.append((aspect, have, want))
    for a, z, want in sorted(edits, reverse=True):
        target = target[:a] + want + target[z:]
    return target, changes


def offences_of(text: Column, locale: str) -> Column:
    @F.pandas_udf("array<struct<aspect:string,start:int,end:int,expected:string>>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("aspect", "start", "end", "expected"), o, strict=True)) for o in offences(x or "", locale)] for x in t], dtype=object)

    return run(text)


def normalized(source: Column, target: Column, lang: Column, locale: str) -> Column:
    @F.pandas_udf("struct<text:string,changes:int>")
    def run(s: pd.Series, t: pd.Series, g: pd.Series) -> pd.DataFrame:
        rows = [normalize(a or "", b or "", c or "en", locale) for a, b, c in zip(s, t, g, strict=True)]
        return pd.DataFrame([(x, len(y)) for x, y in rows], columns=["text", "changes"])

    return run(source, target, lang)
