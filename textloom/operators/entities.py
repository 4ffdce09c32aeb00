"""Entities of plain text in a fixed order of kinds; what a kind takes, later kinds don't see."""

from __future__ import annotations

import bisect

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locales as L

ENTITY = "struct<kind:string,raw:string,start:int,end:int,value:string,unit:string,currency:string>"
#: Patterns of kinds that need no reading of numbers.
URL = r"https?://[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![\p{L}\p{N}_])(\d{1,2})([./-])(\d{1,2})\2(\d{4}|\d{2})(?!\p{N})"
PHONES = (r"\+\d{1,3}(?:[\s.-]?\(?\d\)?){8,12}", r"\b0(?:[\s.-]?\d){9}\b")
CODES = (r"\b[A-Z]{1,5}-\d{2,}[A-Z0-9-]*\b", r"\b[A-Z]{2,6}\d{2,}[A-Z0-9-]*\b")
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:['’   ]\d{3}(?!\d))*(?:[.,]\d+)*(?:[.,](?:--|[-–—])(?!\d))?"
#: What may stand between a number and its marker or unit: one space, of any kind that text setters use.
GAP = "[ \u00a0\u202f\u2009]"


def _any(words, bound: str) -> str:
    """One of words, the longest that fits; those of letters within bound, where {} stands for the word."""
    return "(?:" + "|".join((bound if w.isalpha() else "{}").format(regex.escape(w)) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


_CURRENCY_OF = {sign: code for code, sign in L.CURRENCIES.items()} | {code: code for code in L.CURRENCIES}
_UNIT = "(?:" + "|".join(map(regex.escape, sorted(set(L.UNITS), key=lambda u: (-len(u), u)))) + r")(?![\p{L}\p{N}])"
#: How a number may be written: marks of groups and the decimal mark. Without decimals all groups are parted alike; before a decimal mark any other may part them.
_ALIKE, _DECIMAL = ("", "[.]", "[,]", f"(?:['’]|{GAP})"), {"[.]": f"(?:[,'’]|{GAP})", "[,]": f"(?:[.'’]|{GAP})"}
_READINGS = {
    (group, mark): regex.compile(rf"(?P<whole>{rf'[1-9][0-9]{{0,2}}(?:{group}[0-9]{{3}})+' if group else '[0-9]+'}){rf'(?:{mark}(?:(?P<part>[0-9]+)|--|[-–—]))' if mark else ''}")
    for group, mark in (*((g, "") for g in _ALIKE), *((g, m) for m, others in _DECIMAL.items() for g in ("", others)))
}


def value_of(raw: str, lang: str) -> str | None:
    """A number token's canonical digits, or None if its marks contradict each other; the scalar twin of functions.numbers.parse_number.

    The token is read in every way it may be written in. Where a mark may part groups as well as decimals, the language decides. Digits
    after a leading zero are a code, not a quantity.
    """
    if regex.match("0[0-9]", raw):
        return None if regex.search("[^0-9][^0-9]|[^0-9]$", raw) and not regex.search(r"[.,](?:--|[-–—])$", raw) else f"#{raw}"
    found = {(group, mark): m for (group, mark), way in _READINGS.items() if (m := way.fullmatch(raw))}
    if len(found) > 1:
        decimal = "[.]" if lang == "en" else "[,]"
        found = {k: m for k, m in found.items() if (k[1] == decimal if any(mark == decimal for _, mark in found) else not k[1])}
    if not found:
        return None
    m = next(iter(found.values()))
    part = m.groupdict().get("part")
    return regex.sub("[^0-9]", "", m["whole"]) + (f".{part}" if part else "")


def _dated(m, lang: str) -> dict | None:
    day, month, year = m[1], m[3], m[4]
    real = 1 <= int(day) <= 31 and 1 <= int(month) <= 12 and (len(year) == 4 or len(day) + len(month) == 4)
    return {"value": f"{int(day)}.{int(month)}.{year}"} if real else None


def _money(m, lang: str) -> dict | None:
    return {"value": value_of(m["n"], lang), "currency": _CURRENCY_OF[m["sign"]]}


def _measured(m, lang: str) -> dict | None:
    value = value_of(m["n"], lang)
    return value and {"value": value, "unit": m["unit"], "kind": "unit" if m["unit"] else "number"}


def _plain(m, lang: str) -> dict | None:
    return {}


_BEFORE, _BEHIND = (f"(?P<sign>{_any(_CURRENCY_OF, bound)})" for bound in (r"(?<![\p{{L}}\p{{N}}]){}", r"{}(?![\p{{L}}\p{{N}}])"))
_N = f"(?P<n>(?>{NUMBER}))"
#: Kinds by rank: name, a character class that a text must have for it, patterns, and what a match says (None: it is none).
_KINDS = [
    (name, regex.compile(need), [regex.compile(p) for p in patterns], read)
    for name, need, patterns, read in (
        ("url", r"://|www\.", (rf"(?:{URL})(?<![.,;:!?])",), _plain),
        ("email", "@", (EMAIL,), _plain),
        ("date", "[0-9]", (DATE,), _dated),
        ("phone", "[0-9]", PHONES, _plain),
        ("currency", "[0-9]", (f"{_BEFORE}{GAP}?{_N}", f"{_N}{GAP}?{_BEHIND}"), _money),
        ("product_code", "[0-9]", CODES, _plain),
        ("brand", "", (), _plain),
        ("number", "[0-9]", (rf"{_N}(?:{GAP}?(?P<unit>{_UNIT}))?",), _measured),
    )
]


def extract(text: str, lang: str = "en", brands: tuple[str, ...] = ()) -> list[dict]:
    """Entities in order of their places: urls, e-mail addresses, dates, phones, amounts, product codes, brands, then numbers with their units.

    All kinds propose spans; of proposals that overlap, that of the earlier kind stands, of a kind the one further left, of brands the longer name's.
    """
    proposed = []
    for rank, (kind, need, patterns, read) in enumerate(_KINDS):
        if kind == "brand":
            patterns = [regex.compile(rf"(?<![\p{{L}}\p{{N}}_]){r'\s+'.join(map(regex.escape, b.split()))}(?![\p{{L}}\p{{N}}_])") for b in sorted(brands, key=len, reverse=True)]
        if patterns and need.search(text):
            for place, pattern in enumerate(patterns):
                for m in pattern.finditer(text):
                    if (more := read(m, lang)) is not None:
                        proposed.append((rank, place if kind == "brand" else 0, m.start(), place, m.end(), {"kind": kind} | more))
    starts: list[int] = []
    kept: list[dict] = []
    for _, _, a, _, z, more in sorted(proposed, key=lambda p: p[:5]):
        i = bisect.bisect_left(starts, a)
        if (i == 0 or kept[i - 1]["end"] <= a) and (i == len(kept) or z <= kept[i]["start"]):
            starts.insert(i, a)
            kept.insert(i, {"raw": text[a:z], "start": a, "end": z, "value": None, "unit": None, "currency": None} | more)
    return kept


def entities(text: Column, lang: Column, brands: tuple[str, ...] = ()) -> Column:
    @F.pandas_udf(f"array<{ENTITY}>")
    def run(t: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([extract(x or "", y or "en", brands) for x, y in zip(t, g, strict=True)], dtype=object)

    return run(text, lang)


def entity_rows(docs: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    return docs.select("doc_id", F.explode_outer(entities(F.col("text"), F.col("lang"), brands)).alias("e")).where("e IS NOT NULL").select("doc_id", "e.*")


def resolve_overlaps(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of overlapping spans the longest, then the earliest."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(set(spans), key=lambda s: (s[0] - s[1], s[0])):
        if all(z <= b or a >= y for b, y in out):
            out.append((a, z))
    return sorted(out)


def match_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of source and target (keys…, k) as multisets: a row for each k with n_source, n_target, missing and extra, by counting rather than pairing."""
    both = source.select(*keys, "k", F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(*keys, "k", F.lit(0).alias("s"), F.lit(1).alias("t")))
    g = both.groupBy(*keys, "k").agg(F.sum("s").alias("n_source"), F.sum("t").alias("n_target"))
    return g.withColumn("missing", F.greatest(F.lit(0), F.col("n_source") - F.col("n_target"))).withColumn("extra", F.greatest(F.lit(0), F.col("n_target") - F.col("n_source")))
