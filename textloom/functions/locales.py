"""Locale profiles and shared language data. Everything here is data of bounded size that plans take in as literals or broadcast rows."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The target locales, languages, severities, verdicts from worst to best, stages, operations, block types and meta kinds.
LOCALES = ("nl-NL", "en-NL", "en-GB", "de-DE", "de-AT", "de-CH", "it-IT")
LANGUAGES = ("nl", "en", "de", "it")
WEIGHTS = {"minor": 1, "major": 5, "critical": 25}
VERDICTS = ("FAIL", "HUMAN_REVIEW", "PASS_WITH_NOTES", "PASS")
STAGES = ("language_detection", "translation", "localization", "validation", "backtranslation", "repair")
CANDIDATE_STAGES = ("translation", "localization", "repair")
JUDGE_STAGES = ("validation", "backtranslation")
OPERATIONS = ("TRANSLATE_LOCALIZE", "TRANSLATE_ONLY", "ADAPT_ONLY", "SKIP_IDENTICAL")
PREFIXES = {"heading": "h", "paragraph": "p", "list_item": "li", "table_cell": "td", "alt": "alt", "anchor": "a", "meta": "meta"}
META_KINDS = ("title", "description", "slug", "keyword", "og_title", "og_description")
#: Thresholds and limits.
PASS, JUDGE_MIN, DETECT_MIN, F1_MIN, WORDS_FLOOR, REPAIR_LOOPS = 90, 0.7, 0.8, 0.4, 100, 2
BATCH_SEGMENTS, BATCH_CHARS, CEILING_USD = 12, 6000, 5.0

#: Symbol units, currency markers, regions that a country-code domain tells, and month names.
UNITS = (
    "m³/min", "m³/h", "m³/s", "m³", "m²", "l/min", "l/s", "l/h", "L/min", "L/s", "mbar", "barg", "bar", "kPa", "MPa", "Pa", "psi", "kWh", "kW", "MW", "Wh", "W", "kVA", "VA", "kV", "V", "mA", "A", "kHz", "Hz",
    "rpm", "min⁻¹", "1/min", "°C", "°F", "K", "%", "‰", "mm", "cm", "dm", "km", "µm", "μm", "m/s", "m/h", "kNm", "Nm", "kg", "mg", "dB(A)", "dB", "ml", "cl", "mWC", "mH2O", "mWS", "m", "g", "t", "l",
)
CURRENCIES = {"EUR": "€", "GBP": "£", "CHF": "CHF", "USD": "$"}
REGION_HINTS = {("nl", "nl"): "NL", ("en", "uk"): "GB", ("de", "de"): "DE", ("de", "at"): "AT", ("de", "ch"): "CH", ("it", "it"): "IT", ("it", "ch"): "CH"}
MONTHS = {
    "nl": ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"),
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "de-AT": ("Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "it": ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
#: Targets of each source language.
DEFAULT_TARGETS = {"nl": ("en-NL", "en-GB", "de-DE", "de-AT", "de-CH", "it-IT"), "en": ("en-NL", "en-GB", "de-DE", "de-AT", "de-CH", "it-IT")}


@dataclass(frozen=True)
class Locale:
    code: str
    decimal: str
    thousands: str
    accepted: tuple[str, ...]
    keep_dash: bool
    currency: str
    position: str
    space: str
    date_sep: str
    pad: bool
    quotes: tuple[str, str]
    transliterate: dict[str, str] = field(default_factory=dict)
    either_side: bool = False

    @property
    def language(self) -> str:
        return self.code[:2]

    @property
    def region(self) -> str:
        return self.code[3:]


_WIDE = ("\u0020", "\u00a0", "\u202f")
#: How each locale writes numbers, money, dates, quotation marks and slugs.
PROFILES = {
    p.code: p
    for p in (
        Locale("nl-NL", ",", ".", (".", *_WIDE), True, "EUR", "before", "space", "-", True, ("‘", "’"), either_side=True),
        Locale("en-NL", ".", ",", (",",), False, "EUR", "before", "none", "/", True, ("‘", "’")),
        Locale("en-GB", ".", ",", (",",), False, "GBP", "before", "none", "/", True, ("‘", "’")),
        Locale("de-DE", ",", ".", (".", *_WIDE), True, "EUR", "after", "nbsp", ".", True, ("„", "“"), UMLAUTS),
        Locale("de-AT", ",", ".", (".", *_WIDE), True, "EUR", "before", "space", ".", True, ("„", "“"), UMLAUTS, True),
        Locale("de-CH", ".", "'", ("'", "’", *_WIDE), True, "CHF", "before", "space", ".", True, ("«", "»"), UMLAUTS),
        Locale("it-IT", ",", ".", (".", *_WIDE), False, "EUR", "after", "nbsp", "/", True, ("«", "»"), either_side=True),
    )
}
