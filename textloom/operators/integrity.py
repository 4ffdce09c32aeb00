"""Rules that have to read a text's entities: preservation, formats, market claims and terminology, in one Arrow pass over source and target."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inline
from ..functions import locales as L
from . import claims, entities, formats
from .rules import FINDING

NUMERIC = ("number", "unit", "currency", "date")
#: Ids and severities of the rules, and the kinds that each preservation rule keeps.
PRESERVE = {"INTEGRITY-ENTITY": ("critical", (*NUMERIC, "product_code", "brand", "phone")), "INTEGRITY-URL": ("critical", ("url",)), "INTEGRITY-EMAIL": ("critical", ("email",))}
FORMAT_RULES = {"number": "FORMAT-NUMBER", "currency": "FORMAT-CURRENCY", "date": "FORMAT-DATE"}


def _key(e: dict) -> str:
    """A numeric entity by its value without trailing zeros; another one by its text."""
    if e["kind"] == "date":
        return f"date|{e['value']}"
    if e["kind"] in NUMERIC:
        v = e["value"] or e["raw"]
        whole, dot, frac = v.partition(".")
        return f"number|{v if v.startswith('#') else whole.lstrip('0') or '0'}{'' if v.startswith('#') or not frac.rstrip('0') else '.' + frac.rstrip('0')}"
    return f"{e['kind']}|{regex.sub(r'\s+', ' ', e['raw'])}"


def preserved(source: list[dict], target: list[dict], kinds: tuple[str, ...], known: set[str] = frozenset()) -> list[tuple[str, dict | None]]:
    """(what is wrong, the target's entity or None): units and currencies that changed, what is missing, figures that the source doesn't have.

    Entities are matched as multisets: with all their attributes first, then by value alone. known are keys of facts that a
    target may state of itself.
    """
    src, tgt = [e for e in source if e["kind"] in kinds], [e for e in target if e["kind"] in kinds]
    full = lambda e: (_key(e), e["unit"], e["currency"])
    left = Counter(map(full, src))
    rest = []
    for t in tgt:
        if left[full(t)] > 0:
            left[full(t)] -= 1
        else:
            rest.append(t)
    out: list[tuple[str, dict | None]] = []
    missing = list(left.elements())
    for key, unit, money in missing:
        t = next((t for t in rest if _key(t) == key), None)
        if t is None:
            out.append((f"missing {key.partition('|')[2]}", None))
        else:
            rest.remove(t)
            if unit != t["unit"] and unit:
                out.append((f"unit {unit} became {t['unit'] or 'none'}", t))
            elif money != t["currency"] and money:
                out.append((f"currency {money} became {t['currency'] or 'none'}", t))
    has = {_key(e) for e in src}
    out += [(f"not in the source: {t['raw']}", t) for t in rest if t["kind"] in NUMERIC and _key(t) not in has and _key(t) not in known]
    return out


def check(source: str, target: str, source_lang: str, source_region: str, locale: str, fact: str | None, glossary: dict[str, dict[str, tuple[str, ...]]], brands: tuple[str, ...]) -> list[dict]:
    """Findings of all these rules for one pair of plain texts."""
    lang = locale[:2]
    a, b = entities.extract(source, source_lang, brands), entities.extract(target, lang, brands)
    known = {_key(e) for e in entities.extract(fact, lang)} if fact else set()
    out = []

    def add(rule: str, severity: str, found: str, start: int | None, end: int | None, to: str | None = None) -> None:
        out.append({"rule": rule, "severity": severity, "start": start, "end": end, "found": found, "replacement": to})

    for rule, (severity, kinds) in PRESERVE.items():
        for what, e in preserved(a, b, kinds, known):
            add(rule, severity, what, e and e["start"], e and e["end"])
    for aspect, start, end, _ in formats.offences(target, locale):
        add(FORMAT_RULES[aspect], "major", target[start:end], start, end)
    for c in claims.restated(source, target, source_region, locale[3:], fact):
        add("INTEGRITY-MARKET-CLAIM", "major", c["phrase"], c["start"], c["end"])
    low = target.lower()
    for t in {h["term_id"] for h in claims.terms(source, {k: v.get(source_lang, ()) for k, v in glossary.items()})}:
        forms = glossary[t].get(locale, ())
        if forms and not any(f.lower() in low for f in forms):
            add("TERM-GLOSSARY-01", "minor", t, None, None)
    return out


def findings(source: Column, target: Column, source_lang: Column, source_locale: Column, locale: str, fact: str | None = None, glossary: dict | None = None, brands: tuple[str, ...] = ()) -> Column:
    """The findings of a pair of placeholder-bearing texts as an array; offsets are those of the target's plain text."""
    terms = glossary or {}

    @F.pandas_udf(f"array<{FINDING}>")
    def run(s: pd.Series, t: pd.Series, g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([check(inline.plain_map(a or "")[0], inline.plain_map(b or "")[0], c or "en", (d or "")[3:], locale, fact, terms, brands) for a, b, c, d in zip(s, t, g, p, strict=True)], dtype=object)

    return run(source, target, source_lang, source_locale)


def with_integrity(linted: DataFrame, locale: str, **more) -> DataFrame:
    """Linted rows (source_text, target_text, source_lang, page_locale, operation, findings) with these rules' findings too, where the text isn't a copy."""
    own = findings(F.col("source_text"), F.col("target_text"), F.col("source_lang"), F.col("page_locale"), locale, **more)
    return linted.withColumn("findings", F.when(F.col("operation") == "SKIP_IDENTICAL", F.col("findings")).otherwise(F.concat("findings", own)))


def currency_policy(docs: DataFrame, locale: str, priced: str | None = None) -> DataFrame:
    """(doc_id, currency, amounts, shown) of amounts in other currencies than the locale's and the one its prices are in."""
    e = entities.entity_rows(docs).where("kind = 'currency'")
    g = e.groupBy("doc_id", "currency").agg(F.count("*").alias("amounts"), F.array_join(F.slice(F.array_sort(F.collect_set("raw")), 1, 3), ", ").alias("shown"))
    return g.where(~F.col("currency").isin(L.PROFILES[locale].currency, priced or ""))
