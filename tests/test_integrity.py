"""Preservation, claims, terms, rule files and providers."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import integrity, stages
from textloom.sources import config

#: Dutch sources and their targets: a pair that keeps what its rule asks for, then pairs that break it.
CASES = [
    # figures, their units and their money
    ("Brood van 800 g voor 3,40 euro", "Bread, 800 g, for 3.40 euro", "en-GB", []),
    ("Brood van 800 g", "Bread, 900 g", "en-GB", ["INTEGRITY-ENTITY", "INTEGRITY-ENTITY"]),
    ("Brood van 800 g", "Bread, 800 kg", "en-GB", ["INTEGRITY-ENTITY"]),
    ("Twee dozen van 12", "Two boxes", "en-GB", ["INTEGRITY-ENTITY"]),
    ("Kaartje EUR 9", "Ticket GBP 9", "en-NL", ["FORMAT-CURRENCY", "INTEGRITY-ENTITY"]),
    # codes, numbers to call, addresses
    ("Fiets RX-900 in voorraad", "Fahrrad RX-900 auf Lager", "de-AT", []),
    ("Fiets RX-900 in voorraad", "Fahrrad RX-090 auf Lager", "de-AT", ["INTEGRITY-ENTITY"]),
    ("Atelier: +32 2 555 01 99 88", "Atelier: +32 2 555 01 99 89", "de-AT", ["INTEGRITY-ENTITY"]),
    ("Kaart: www.kaart.example/gent", "Karte: www.kaart.example/wien", "de-AT", ["INTEGRITY-URL"]),
    ("Schrijf balie@bieb.example", "Scrivi a banco@bieb.example", "it-IT", ["INTEGRITY-EMAIL"]),
    # claims, money's form, terms
    ("Verzending naar Nederland op zaterdag", "Dispatch to the Netherlands on Saturday", "en-GB", ["INTEGRITY-MARKET-CLAIM"]),
    ("Verzending op zaterdag", "Dispatch on Saturday", "en-GB", []),
    ("Kost € 2.600,00", "Kostet € 2.600,00", "de-CH", ["FORMAT-CURRENCY"]),
    ("Een bakfiets huren", "Ein Rad mieten", "de-AT", ["TERM-GLOSSARY-01"]),
    ("Een bakfiets huren", "Ein Lastenrad mieten", "de-AT", []),
]
TERMS = {"cargo": {"nl": ("bakfiets",), "de-AT": ("Lastenrad", "Transportrad")}}


@pytest.mark.parametrize("source,target,locale,want", CASES)
def test_integrity(source, target, locale, want):
    assert sorted(f["rule"] for f in integrity.check(source, target, "nl", "NL", locale, None, TERMS, ())) == want


def test_column(spark):
    df = spark.createDataFrame([("Kamer <b1>17</b1>", "Zimmer <b1>71</b1>", "nl", "nl-NL", "TRANSLATE_LOCALIZE")], "source_text string, target_text string, source_lang string, page_locale string, operation string")
    df = df.withColumn("findings", F.array().cast(f"array<{integrity.FINDING}>"))
    assert [f.rule for f in integrity.with_integrity(df, "de-DE").first().findings] == ["INTEGRITY-ENTITY"] * 2
    assert integrity.with_integrity(df.withColumn("operation", F.lit("SKIP_IDENTICAL")), "de-DE").first().findings == []


def test_rule_files(spark):
    from textloom.operators import rules

    text = "lexicons:\n  l:\n    - {pattern: '\\bgross\\b', prefer: groß}\nrules:\n  - {id: A, type: lexicon, severity: major, lexicon_ref: l, autofix: true, tests: []}\n  - {id: B, type: lexicon, severity: critical, flags: '', terms: [{pattern: ß, prefer: ss, preserve_case: false}]}\n"
    mine = config.load_rules(text, "de-DE")
    df = spark.createDataFrame([("x", "Gross und Größe", "de", "ADAPT_ONLY", "paragraph")], "source_text string, target_text string, source_lang string, operation string, block_type string")
    assert [(f.rule, f.replacement) for f in rules.lint(df, "de-DE", mine).first().findings] == [("A", "Groß"), ("B", "ss")]
    with pytest.raises(ValueError):
        config.load_rules("rules: [{id: A, type: length, severity: minor, oops: 1}]", "de-DE")
    with pytest.raises(ValueError):
        config.load_rules("rules: [{id: A, type: length, severity: minor}, {id: A, type: slug, severity: minor}]", "de-DE")


def test_providers(tmp_path, monkeypatch):
    (tmp_path / "own.py").write_text("def create_provider(word):\n    def run(rows):\n        return rows[['key']].assign(output=word)\n    return run\n")
    p = config.Providers()
    p.load("own", str(tmp_path / "own.py"), word="hi")
    p.route(translation="own")
    import pandas as pd

    assert p.of("translation")(pd.DataFrame({"key": ["a"]}))["output"].tolist() == ["hi"] and p.independent("translation") and p.of("repair") is p.known["mock"]
    with pytest.raises(ValueError):
        p.route(repair="none")
    monkeypatch.delenv("TL_X", raising=False)
    monkeypatch.setenv("TL_Y", "kept")
    (tmp_path / ".env").write_text("# c\nexport TL_X='1'\nTL_Y=2\n")
    assert config.load_env(str(tmp_path / ".env")) == {"TL_X": "1", "TL_Y": "kept"}


def test_judge_that_fails(spark):
    rows = spark.createDataFrame([(1, "p-1", "x")], "doc_id long, segment_id string, target_text string")

    def broken(rows):
        raise RuntimeError

    assert stages.judge(rows, broken).first().judged is None
