"""Rules as data, compiled to Spark expressions.

All rules of a locale become one array column of findings over one scan: there is no join of segments with rules, and a rule
whose scope or cheap test fails costs a comparison. Patterns are java.util.regex.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T

FINDING = "struct<rule:string,severity:string,start:bigint,end:bigint,found:string,replacement:string>"
#: Rule types that hold for a segment that is already in its target locale.
FOR_IDENTICAL = ("lexicon", "format", "length", "slug", "first_mention")


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str
    terms: tuple[tuple[str, str | None], ...] = ()
    keep_case: bool | tuple[bool, ...] = True  # for all terms, or for each
    when_source: str = ""
    unless_source: str = ""
    forbid: tuple[str, ...] = ()
    require: tuple[str, ...] = ()
    most: int = 0
    least_words: int = 3
    blocks: tuple[str, ...] = ()
    metas: tuple[str, ...] = ()
    autofix: bool = False
    hypothesis: bool = False
    locales: tuple[str, ...] = field(default=())


def _word(p: str) -> str:
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"


GERMAN, ENGLISH = ("de-DE", "de-AT", "de-CH"), ("en-NL", "en-GB")
#: Fixed values of orthography: ß after long vowels and diphthongs (what stands for ss, its spelling, its endings), where ss is never right.
SHARP_S = (
    ("aussen", "außen", ""), ("ausser", "außer", "dem halb ordentlich"), ("draussen", "draußen", ""), ("dreissig", "dreißig", ""), ("fleissig", "fleißig", "e en er es em"),
    ("fuss", "fuß", "es"), ("füsse", "füße", "n"), ("gefäss", "gefäß", "e en es"), ("gemäss", "gemäß", ""), ("giessen", "gießen", ""), ("gross", "groß", "e en er es em"),
    ("grösse", "größe", "n r"), ("grösst", "größt", "e en er es em"), ("gruss", "gruß", ""), ("grüsse", "grüße", "n"), ("heiss", "heiß", "e en er es em"), ("heissen", "heißen", ""), ("massnahme", "maßnahme", "n"),
    ("massstab", "maßstab", ""), ("regelmässig", "regelmäßig", "e en er es em"), ("schliessen", "schließen", ""), ("schliesslich", "schließlich", ""), ("schweissen", "schweißen", ""), ("spass", "spaß", ""),
    ("strasse", "straße", "n"), ("süss", "süß", "e en er es em"), ("weiss", "weiß", "e en er es em"),
)
#: Fixed values of British spelling: stems in -our, -re, -ogue, -yse, -ence for -or, -er, -og, -yze, -ense, stems that double their l, and single words.
OUR = "arb ard arm behavi cand clam col endeav fav ferv flav harb hon hum lab neighb od parl rum sav splend tum val vap vig".split()
RE = "calib cent fib lit lust meag sab scept somb spect theat".split()
OGUE, YSE, ENCE = ("anal", "catal", "dial"), ("anal", "catal", "paral"), ("def", "off", "pret")
DOUBLED = ("cancel", "channel", "dial", "equal", "fuel", "label", "level", "model", "signal", "total", "travel")
SINGLE = (("gray", "grey"), ("aluminum", "aluminium"), ("plow", "plough"), ("mold", "mould"), ("skeptical", "sceptical"))


def _british() -> tuple[tuple[str, str], ...]:
    any_of = lambda stems: f"({'|'.join(stems)})"
    return (
        (_word(f"{any_of(OUR)}or(s|ed|ing|ful|less)?"), "$1our$2"), (_word(f"{any_of(RE)}er(s|ed)?"), "$1re$2"), (_word(f"{any_of(OGUE)}og(s)?"), "$1ogue$2"), (_word(f"{any_of(YSE)}yz(e|es|ed|er|ing)"), "$1ys$2"),
        (_word(f"{any_of(ENCE)}ense(s)?"), "$1ence$2"), (_word(f"{any_of(DOUBLED)}(ed|ing)"), "$1l$2"), *((_word(us), uk) for us, uk in SINGLE),
    )


def _sharp_s() -> tuple[tuple[str, str], ...]:
    return tuple((_word(f"{plain}({ends.replace(' ', '|')})?" if ends else plain), f"{right}$1" if ends else right) for plain, right, ends in SHARP_S)


#: Rule data. Severity, patterns and replacements are fixed values of the locales' conventions.
RULES = (
    Rule("DECH-SZ-01", "lexicon", "critical", (("ß", "ss"), ("ẞ", "SS")), keep_case=False, autofix=True, locales=("de-CH",)),
    Rule("DECH-QUOTE-01", "lexicon", "major", ((r'"([^"\n]{1,300})"', "«$1»"), (r"„([^“”\n]{1,300})[“”]", "«$1»")), keep_case=False, autofix=True, locales=("de-CH",)),
    Rule("DE-QUOTE-01", "lexicon", "minor", ((r'"([^"\n]{1,300})"', "„$1“"), (r"«([^»\n]{1,300})»", "„$1“")), keep_case=False, autofix=True, locales=("de-DE", "de-AT")),
    Rule("DE-SZ-01", "lexicon", "major", _sharp_s(), autofix=True, locales=("de-DE", "de-AT")),
    Rule("DE-DU-01", "lexicon", "major", ((_word("du|dich|dir|dein(?:e|en|em|er|es)?"), None),), locales=GERMAN),
    Rule("EN-SPELL-01", "lexicon", "minor", _british(), autofix=True, locales=ENGLISH),
    Rule("EN-TERM-01", "conditional", "minor", when_source=_word("offerte"), forbid=(_word("offer"),), require=(_word("quot(?:e|ation)"),), locales=ENGLISH),
    Rule("INTEGRITY-TAGS", "inline_tags", "critical"),
    Rule("INTEGRITY-EMPTY", "empty_output", "critical"),
    Rule("INTEGRITY-UNTRANSLATED", "untranslated", "major", least_words=3),
    Rule("BT-DRIFT-01", "backtranslation_similarity", "minor", hypothesis=True),
    Rule("SEO-TITLE-LEN", "length", "minor", most=60, blocks=("meta",), metas=("title", "og_title")),
    Rule("SEO-META-LEN", "length", "minor", most=155, blocks=("meta",), metas=("description", "og_description")),
    Rule("SEO-SLUG-01", "slug", "major", blocks=("meta",), metas=("slug",), autofix=True),
)


def rules_for(locale: str, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """A locale's own rules first, then those of all locales; ids must not repeat."""
    own = [r for r in rules if locale in r.locales] + [r for r in rules if not r.locales]
    if len({r.id for r in own}) < len(own):
        raise ValueError("rule ids repeat")
    return tuple(own)


def applies(rule: Rule, block_type: Column, meta_kind: Column, operation: Column) -> Column:
    ok = F.lit(True)
    if rule.blocks:
        ok = ok & block_type.isin(*rule.blocks)
    ok = ok & ((block_type != "meta") | (meta_kind.isin(*rule.metas) if rule.metas else (meta_kind != "slug")))
    if rule.type not in FOR_IDENTICAL:
        ok = ok & (operation != "SKIP_IDENTICAL")
    return F.coalesce(ok, F.lit(False))


def _finding(rule: Rule, start: Column, end: Column, found: Column, to: Column | None = None) -> Column:
    return F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), start.cast("long").alias("start"), end.cast("long").alias("end"), found.alias("found"), (to if to is not None else F.lit(None).cast("string")).alias("replacement"))


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def _once(rule: Rule, bad: Column, text: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_finding(rule, F.lit(0), F.length(text), text))).otherwise(_none())


def _replaced(rule: Rule, pattern: str, prefer: str | None, keep_case: bool):
    """A match as a finding of a lexicon term."""

    def one(m: Column) -> Column:
        to = None
        if prefer is not None:
            to = F.regexp_replace(m["match"], pattern, prefer)
            to = T.match_case(m["match"], to) if keep_case else to
        return _finding(rule, m["start"], m["end"], m["match"], to)

    return one


def normalized(c: Column) -> Column:
    return F.lower(T.normalize_space(c))


def evaluate(rule: Rule, s: dict[str, Column]) -> Column:
    """Findings of a segment rule as an array; s has source, target (plain), words, operation, source_lang, target_lang, translatable, back, back_lang and the placeholder-bearing source_text, target_text."""
    target = s["target"]
    if rule.type == "lexicon":
        parts = [F.filter(F.transform(T.match_spans(target, pattern), _replaced(rule, pattern, prefer, keep)), lambda f: f["replacement"].isNull() | (f["replacement"] != f["found"])) for (pattern, prefer), keep in zip(rule.terms, rule.keep_case if isinstance(rule.keep_case, tuple) else [rule.keep_case] * len(rule.terms), strict=True)]
        return F.concat(*parts)
    if rule.type == "conditional":
        trigger = s["source"].rlike(rule.when_source)
        if rule.unless_source:
            trigger = trigger & ~s["source"].rlike(rule.unless_source)
        parts = [F.transform(T.match_spans(target, p), lambda m: _finding(rule, m["start"], m["end"], m["match"])) for p in rule.forbid]
        if rule.require:
            lacks = F.lit(True)
            for p in rule.require:
                lacks = lacks & ~target.rlike(p)
            parts.append(F.when(lacks, F.array(_finding(rule, F.lit(None), F.lit(None), F.lit(None).cast("string")))).otherwise(_none()))
        return F.when(trigger, F.concat(*parts)).otherwise(_none())
    if rule.type == "length":
        return _once(rule, F.length(target) > rule.most, target)
    if rule.type == "slug":
        slug = T.slugify(target, L.UMLAUTS)
        bad = ~T.is_slug(target)
        return F.when(bad, F.array(_finding(rule, F.lit(0), F.length(target), target, F.when(slug != "", slug)))).otherwise(_none())
    if rule.type == "inline_tags":
        a, b = T.signature(s["source_text"]), T.signature(s["target_text"])
        return _once(rule, (a != b) | ~T.nests(s["target_text"]), target)
    if rule.type == "empty_output":
        return _once(rule, (F.trim(s["source"]) != "") & (F.trim(target) == ""), target)
    if rule.type == "untranslated":
        translating = s["operation"].isin("TRANSLATE_LOCALIZE", "TRANSLATE_ONLY") & s["translatable"] & (s["source_lang"] != s["target_lang"])
        return _once(rule, translating & (s["words"] >= rule.least_words) & (normalized(target) == normalized(s["source"])), target)
    if rule.type == "backtranslation_similarity":
        return _once(rule, s["back"].isNotNull() & (s["back_lang"] == s["source_lang"]) & (s["words"] >= 6) & (T.token_f1(s["source_text"], s["back"]) < L.F1_MIN), target)
    raise ValueError(f"no evaluator for {rule.type}")


def lint(segments: DataFrame, locale: str, rules: tuple[Rule, ...] | None = None, again: Column | None = None) -> DataFrame:
    """segments with a column findings: all of a locale's rules over each row, in one pass; of rows linted before only those of which again holds.

    segments has source_text, target_text, source_lang, operation, block_type and may have meta_kind, back, back_lang.
    """
    have = set(segments.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    rows = segments.withColumn("__s", T.plain_text(F.col("source_text"))).withColumn("__t", T.plain_text(F.col("target_text"))).withColumn("__w", T.word_count(F.col("source_text")))
    s = {
        "source": F.col("__s"), "target": F.col("__t"), "words": F.col("__w"), "source_text": F.col("source_text"), "target_text": F.col("target_text"), "operation": F.col("operation"), "source_lang": F.col("source_lang"),
        "target_lang": F.lit(locale[:2]), "translatable": F.col("translatable") if "translatable" in have else F.lit(True), "back": col("back"), "back_lang": col("back_lang"),
    }
    parts = [F.when(applies(r, F.col("block_type"), col("meta_kind"), F.col("operation")), evaluate(r, s)).otherwise(_none()) for r in rules or rules_for(locale)]
    found = F.concat(*parts) if again is None else F.when(again, F.concat(*parts)).otherwise(F.col("findings"))
    return rows.withColumn("findings", found).drop("__s", "__t", "__w")


def check_result(findings: Column, severity: str, hypothesis: bool) -> Column:
    """FAIL or WARN for a rule with findings; PASS only of a critical rule."""
    return F.when(F.size(findings) > 0, "WARN" if hypothesis or severity == "minor" else "FAIL").when(F.lit(severity == "critical"), "PASS")


def autofix(text: Column, findings: Column) -> Column:
    """text with the replacements of findings, earliest first; of overlapping ones the earlier counts, and what has none stays."""
    fixes = F.array_sort(F.transform(F.filter(findings, lambda f: f["replacement"].isNotNull()), lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e"), f["replacement"].alias("r"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, f: Column) -> Column:
        free = f["s"] >= a["at"]
        grown = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (f["s"] - a["at"]).cast("int")), f["r"])
        return F.struct(F.when(free, f["e"]).otherwise(a["at"]).alias("at"), F.when(free, grown).otherwise(a["out"]).alias("out"))

    done = F.aggregate(fixes, zero, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(fixes) > 0, done).otherwise(text)


def first_mention(rows: DataFrame, keys: list[str], order: str, trigger: str, term: str, required: str) -> DataFrame:
    """For each document whose source has the trigger: whether the target's first term, in order of its segments, has the required form there."""
    spot = F.when(F.col("target_text").rlike(term), F.struct(F.col(order).alias("o"), F.regexp_instr("target_text", F.lit(term)).alias("at"), F.col("target_text").alias("t")))
    g = rows.groupBy(*keys).agg(F.max(F.col("source_text").rlike(trigger)).alias("asked"), F.min(spot).alias("first"))
    ok = F.substring(F.col("first.t"), F.col("first.at"), F.length("first.t")).rlike(f"^(?:{required})")
    return g.where("asked AND first IS NOT NULL").select(*keys, F.col("first.o").alias("ord"), F.col("first.at").cast("long").alias("at"), ok.alias("ok"))
