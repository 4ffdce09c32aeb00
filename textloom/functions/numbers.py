"""Numbers in text: reading them by a language's separators and writing them by a locale's, as digit strings and never rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators that can only part thousands: apostrophes and spaces.
THOUSANDS = r"['’ \x{00a0}\x{202f}\x{2009}]"
#: A number in text: not within a word, groups joined by . or , or by an apostrophe or space before three digits, perhaps a dash for no cents.
NUMBER = r"(?<![\p{L}\p{N}_])[0-9]+(?:" + THOUSANDS + r"[0-9]{3}(?![0-9]))*(?:[.,][0-9]+)*(?:[.,](?:--|[-–—])(?![0-9]))?"
PARSED = "struct<value:string,int_digits:string,frac:string,grouped:boolean,dash:boolean,opaque:boolean>"


def parse_number(raw: Column, lang: Column) -> Column:
    """A number token as struct PARSED, null if its marks contradict each other.

    Of . and , together the last parts decimals; one alone parts decimals unless three digits follow one to three that don't
    start with 0, where the language decides (English writes 1,234.5). Several like marks group thousands. A leading zero makes
    a token opaque: a code or day-month pair, kept as written.
    """
    dash = raw.rlike(r"[.,](--|[-–—])$")
    body = F.regexp_replace(raw, r"[.,](--|[-–—])$", "")
    dash_mark = F.when(dash, F.regexp_extract(raw, r"([.,])(?:--|[-–—])$", 1))
    marks = F.regexp_replace(body, "[0-9]|" + THOUSANDS, "")
    last = F.substring(marks, -1, 1)
    spaced = body.rlike(THOUSANDS)
    n = F.length(marks)
    same = n - F.length(F.replace(marks, last, F.lit("")))
    mixed = (n > 0) & (same < n)
    tail = F.regexp_extract(body, r"([0-9]*)$", 1)
    head = F.regexp_extract(body, r"^([0-9]*)", 1)
    could_group = (F.length(tail) == 3) & F.length(head).between(1, 3) & ~F.startswith(head, F.lit("0"))
    decimal = F.when(lang == "en", ".").otherwise(",")
    # null: contradictory; else whether the last group is decimals
    by_mark = (
        F.when(n == 0, False)
        .when(mixed, F.when((same == 1) & body.rlike(r"[.,][0-9]+$"), True))
        .when(spaced, F.when((n == 1) & body.rlike(r"[.,][0-9]+$"), True))
        .when(n > 1, False)
        .when(~could_group, True)
        .otherwise(last == decimal)
    )
    has = F.when(dash, F.when(~F.contains(marks, dash_mark), False)).otherwise(by_mark)
    whole = F.when(has, F.regexp_replace(body, r"[.,][0-9]+$", "")).otherwise(body)
    groups = F.split(whole, "[^0-9]")
    valid = (F.size(groups) == 1) | (F.length(groups[0]).between(1, 3) & (groups[0] != "0") & F.forall(F.slice(groups, 2, 99), lambda g: F.length(g) == 3))
    well = body.rlike(r"^[0-9]+(?:(?:[.,]|" + THOUSANDS + r")[0-9]+)*$")
    digits = F.array_join(groups, "")
    frac = F.when(has, tail)
    opaque = (F.length(head) > 1) & F.startswith(head, F.lit("0"))
    f = lambda v, i, fr, g, o: F.struct(v.alias("value"), i.alias("int_digits"), fr.alias("frac"), g.alias("grouped"), dash.alias("dash"), o.alias("opaque")).cast(PARSED)
    none = F.lit(None).cast("string")
    return F.when(well & opaque, f(body, body, none, F.lit(False), F.lit(True))).when(
        well & has.isNotNull() & valid, f(F.when(has, F.concat(digits, F.lit("."), tail)).otherwise(digits), digits, frac, F.size(groups) > 1, F.lit(False))
    )


def numeric_key(parsed: Column, raw: Column) -> Column:
    """A key by value: no leading or trailing zeros; opaque tokens as written."""
    whole = F.regexp_replace(parsed["int_digits"], "^0+(?=[0-9])", "")
    frac = F.regexp_replace(F.coalesce(parsed["frac"], F.lit("")), "0+$", "")
    return F.when(parsed["opaque"], F.concat(F.lit("#"), raw)).when(frac != "", F.concat(whole, F.lit("."), frac)).otherwise(whole)


def format_number(parsed: Column, raw: Column, decimal: str, thousands: str, keep_dash: bool = True) -> Column:
    """A parsed number with a locale's separators: grouped if it was, its decimals as written."""
    grouped = F.regexp_replace(parsed["int_digits"], r"(?<=[0-9])(?=([0-9]{3})+$)", thousands)
    whole = F.when(parsed["grouped"], grouped).otherwise(parsed["int_digits"])
    out = F.when(parsed["frac"].isNotNull(), F.concat(whole, F.lit(decimal), parsed["frac"]))
    if keep_dash:
        out = out.when(parsed["dash"], F.concat(whole, F.lit(decimal), F.regexp_extract(raw, r"(--|[-–—])$", 1)))
    return F.when(parsed["opaque"], raw).otherwise(F.coalesce(out, whole))


def date_text(day: Column, month: Column, year: Column, sep: str = ".", pad: bool = True) -> Column:
    two = (lambda c: F.lpad(c.cast("string"), 2, "0")) if pad else (lambda c: c.cast("string"))
    return F.concat(two(day), F.lit(sep), two(month), F.lit(sep), year.cast("string"))
