"""Market claims and glossary terms in text, with overlaps resolved."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import resolve_overlaps

#: Names of countries and the regions each stands for.
COUNTRIES = {
    "NL": ("Nederland", "Netherlands", "Niederlande", "Niederlanden", "Holland", "Olanda", "Paesi Bassi"),
    "BENELUX": ("Benelux",),
    "BE": ("België", "Belgie", "Belgium", "Belgien", "Belgio"),
    "LU": ("Luxemburg", "Luxembourg", "Lussemburgo"),
    "DE": ("Duitsland", "Germany", "Deutschland", "Germania"),
    "AT": ("Oostenrijk", "Austria", "Österreich", "Oesterreich"),
    "CH": ("Zwitserland", "Switzerland", "Schweiz", "Svizzera"),
    "IT": ("Italië", "Italie", "Italy", "Italien", "Italia"),
    "GB": ("Verenigd Koninkrijk", "United Kingdom", "Great Britain", "Britain", "UK", "Groot-Brittannië", "Groot-Brittannie", "Vereinigtes Königreich", "Vereinigten Königreich", "Großbritannien", "Grossbritannien", "Regno Unito", "Gran Bretagna", "Engeland", "England"),
    "FR": ("Frankrijk", "France", "Frankreich", "Francia"),
}
REGIONS = {k: (k,) for k in COUNTRIES} | {"BENELUX": ("NL", "BE", "LU")}
#: Words that make a country's name a claim, in turn before it. A slot is one of its words; "" means it may be left out.
FORMS = (
    # Dutch: the whole of a country, service to it
    (("in", "door", "over", "binnen", "voor"), ("heel", "geheel", "gans")),
    (("in", "door", "over", "binnen"), ("de", "het"), ("hele",)),
    (("levering", "bezorging", "verzending", "service", "onderhoud"), ("in", "naar"), ("", "de")),
    # English
    (("across", "throughout", "all over"), ("", "the"), ("", "whole of", "entire")),
    (("in",), ("all of", "the whole of", "the entire"), ("", "the")),
    (("delivery", "shipping", "dispatch", "service"), ("to", "in"), ("", "the")),
    # German
    (("in", "durch", "über"), ("ganz",)),
    (("in",), ("den", "der", "dem", "die", "das"), ("gesamten", "ganzen")),
    (("Lieferung", "Versand", "Service"), ("in", "nach"), ("", "die", "den", "der")),
    # Italian
    (("in",), ("tutta",), ("", "l'")),
    (("in",), ("tutto",), ("", "il")),
    (("consegna", "spedizione", "assistenza", "servizio"), ("in", "per"), ("", "l'")),
)
#: Words that claim the whole of a text's own market.
GENERIC = ("landelijk", "landelijke", "nationwide", "bundesweit", "deutschlandweit", "schweizweit", "österreichweit", "in tutto il Paese", "in tutto il territorio nazionale")


def _spelled(words: str) -> str:
    """A pattern for words with any white space between them; an apostrophe, straight or curled, joins the next word."""
    return r"\s+".join(regex.escape(w).replace("'", "['’]") for w in words.split())


def _slot(words: tuple[str, ...]) -> str:
    one = "|".join(_spelled(w) + (r"\s*" if w.endswith("'") else r"\s+") for w in words if w)
    return f"(?:{one}){'?' if '' in words else ''}"


def _whole(body: str) -> regex.Pattern:
    return regex.compile(rf"\b{body}\b", regex.I)


_patterns = [(country, _whole("".join(map(_slot, form)) + f"(?:{'|'.join(map(_spelled, names))})")) for country, names in COUNTRIES.items() for form in FORMS]
_patterns += [(None, _whole(_spelled(words))) for words in GENERIC]


def claims(text: str) -> list[dict]:
    """Claims of a scope of service: country (None for the text's own market), phrase, start, end; of overlapping ones the longest."""
    found = {m.span(): c for c, p in _patterns for m in p.finditer(text)}
    return [{"country": found[s], "phrase": text[s[0] : s[1]], "start": s[0], "end": s[1]} for s in resolve_overlaps(list(found))]


def restated(source: str, target: str, source_region: str, target_region: str, fact: str | None = None) -> list[dict]:
    """Claims of a target that restate a source's claim for another market and aren't the fact that is known of it."""
    out, seen = [], set()
    known = [m.span() for m in regex.finditer(regex.escape(fact), target, regex.I)] if fact else []
    theirs = claims(target)
    for c in claims(source):
        own = target_region in REGIONS[c["country"]] if c["country"] else source_region == target_region
        for t in [] if own else theirs:
            same = t["country"] == c["country"] if c["country"] else t["country"] is None or source_region in REGIONS[t["country"]]
            if same and t["start"] not in seen and all(t["end"] <= a or t["start"] >= z for a, z in known):
                seen.add(t["start"])
                out.append(t)
    return out


def terms(text: str, forms: dict[str, tuple[str, ...]]) -> list[dict]:
    """Glossary terms in a text by whole words, the longest form of overlapping ones."""
    found = {}
    low = text.lower()
    for term, own in forms.items():
        for f in own:
            if f.lower() in low:
                for m in regex.finditer(rf"(?<![\p{{L}}\p{{N}}_]){regex.escape(f)}(?![\p{{L}}\p{{N}}_])", text, regex.I):
                    found.setdefault(m.span(), term)
    return [{"term_id": found[s], "start": s[0], "end": s[1], "found": text[s[0] : s[1]]} for s in resolve_overlaps(list(found))]


def claims_of(text: Column) -> Column:
    @F.pandas_udf("array<struct<country:string,phrase:string,start:int,end:int>>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([claims(x or "") for x in t], dtype=object)

    return run(text)


def terms_of(text: Column, forms: dict[str, tuple[str, ...]]) -> Column:
    @F.pandas_udf("array<struct<term_id:string,start:int,end:int,found:string>>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([terms(x or "", forms) for x in t], dtype=object)

    return run(text)
