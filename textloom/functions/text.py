"""Text functions as Column -> Column; all run in the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The inline tags that segment text may hold as placeholders, such as <a1>…</a1> and <br2/>.
INLINE_TAGS = ("a", "strong", "b", "em", "i", "u", "sup", "sub", "br", "code", "abbr", "small", "mark")
TOKEN = r"<(/?)(" + "|".join(INLINE_TAGS) + r")([0-9]+)(/?)>"
#: White space as web content has it, no-break and other Unicode spaces too.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
INVISIBLE = r"[\x{00ad}\x{200b}\x{2060}\x{feff}]"
#: Letters with marks and what they are without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīįłńňőřśšťūůűźžż"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegiilnnorsstuuuzzz"


def plain_text(c: Column) -> Column:
    """Segment text without its inline placeholders, &lt; and &gt; decoded: what rules, counters and detectors see."""
    return unescape_literal(F.regexp_replace(c, TOKEN, ""))


def strip_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, TOKEN, "")


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_literal(c: Column) -> Column:
    return _swap(c, ("<", "&lt;"), (">", "&gt;"))


def unescape_literal(c: Column) -> Column:
    return _swap(c, ("&lt;", "<"), ("&gt;", ">"))


def escape_html(c: Column) -> Column:
    return _swap(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_html_attr(c: Column) -> Column:
    return _swap(escape_html(c), ('"', "&quot;"))


def inline_tokens(c: Column) -> Column:
    """The placeholders of a text in order."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def signature(c: Column) -> Column:
    """The sorted multiset of placeholders, as close:a1, open:a1 or self:br2."""
    name = lambda t: F.concat(F.when(F.contains(t, F.lit("/>")), "self:").when(F.startswith(t, F.lit("</")), "close:").otherwise("open:"), F.regexp_replace(t, "[</>]", ""))
    return F.array_sort(F.transform(inline_tokens(c), name))


def nests(c: Column) -> Column:
    """Whether a text's placeholder pairs nest: each closes the one that was opened last, and none stays open."""
    found = inline_tokens(c)
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("open"))

    def step(a: Column, t: Column) -> Column:
        name = F.regexp_replace(t, "[</>]", "")
        ends = F.struct((a["ok"] & F.get(a["open"], F.lit(0)).eqNullSafe(name)).alias("ok"), F.slice(a["open"], 2, F.size(a["open"]) + 1).alias("open"))
        begins = F.struct(a["ok"].alias("ok"), F.concat(F.array(name), a["open"]).alias("open"))
        return F.when(F.contains(t, F.lit("/>")), a).when(F.startswith(t, F.lit("</")), ends).otherwise(begins)

    return F.when(F.size(found) > 0, F.aggregate(found, start, step, lambda a: a["ok"] & (F.size(a["open"]) == 0))).otherwise(True)


def multiset_minus(a: Column, b: Column) -> Column:
    """Elements of sorted multiset a beyond their number in b, each as often as it is over."""
    over = lambda x: F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x))
    return F.flatten(F.transform(F.array_distinct(a), lambda x: F.array_repeat(x, F.greatest(F.lit(0), over(x)))))


def text_hash(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 12)


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def collapse_space(c: Column) -> Column:
    """Invisible characters go, each run of white space becomes one space."""
    return F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), rf"{SPACE}+", " ")


def word_count(c: Column) -> Column:
    """Words between white space of the plain text."""
    p = normalize_space(plain_text(c))
    return F.when(p == "", 0).otherwise(F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1).cast("long")


def spaced_words(c: Column) -> Column:
    """Words of a text that has no placeholders and one space between words, none at its ends, and isn't empty."""
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("long")


def char_length(c: Column) -> Column:
    return F.length(plain_text(c)).cast("long")


def round_half_up(c: Column, digits: int = 2) -> Column:
    """floor(x * 10**digits + 0.5) / 10**digits, which is the same in every engine."""
    f = float(10**digits)
    return F.floor(c * F.lit(f) + F.lit(0.5)) / F.lit(f)


def match_case(sample: Column, to: Column) -> Column:
    """to in the capitals of sample: all of them, the first letter, or as it is."""
    letters = F.regexp_replace(sample, r"[^\p{L}]", "")
    first = F.substring(letters, 1, 1)
    capital = lambda x: (x == F.upper(x)) & (x != F.lower(x))
    return (
        F.when((sample == "") | (to == ""), to)
        .when((F.length(letters) > 1) & capital(letters), F.upper(to))
        .when((letters != "") & capital(first), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, F.lit(2), F.length(to))))
        .otherwise(to)
    )


def slugify(c: Column, transliterate: dict[str, str] | None = None, max_length: int | None = None) -> Column:
    """Lower-case ASCII words joined by hyphens; letters of transliterate first, then all marks are dropped."""
    s = _swap(F.lower(c), *((transliterate or {}).items()))
    s = F.regexp_replace(F.translate(s, MARKED, PLAIN), r"['’`´]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    if max_length:
        head = F.substring(s, 1, max_length)
        short = F.substring(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, "-", -1)) - 1)
        cut = F.when(F.contains(head, F.lit("-")) & (F.length(short) >= 0.6 * max_length), short).otherwise(head)
        s = F.when(F.length(s) > max_length, F.regexp_replace(cut, "-+$", "")).otherwise(s)
    return s


def is_slug(c: Column) -> Column:
    return c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def slug_words(url: Column) -> Column:
    """The words of a URL's last path part; empty if there is none or its escapes are malformed."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    last = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    # A plus sign is no space in a path; it is kept from the decoder and becomes one after it, as hyphens do.
    words = F.regexp_replace(F.regexp_replace(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), r"(?i)\.[a-z0-9]{2,5}$", ""), "[-_+]+", " ")
    return F.coalesce(F.lower(F.trim(words)), F.lit(""))


def language_of(tag: Column) -> Column:
    return F.lower(F.split_part(F.replace(tag, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)))


def region_of(tag: Column) -> Column:
    """The two-letter region of a locale tag, or null."""
    r = F.regexp_extract(F.replace(tag, F.lit("_"), F.lit("-")), r"^[A-Za-z]{2,3}(?:-[A-Za-z]{4})?-([A-Za-z]{2})(?:-|$)", 1)
    return F.when(r != "", F.upper(r))


def natural_language(c: Column, units: tuple[str, ...] = ()) -> Column:
    """Whether some token is a word: three letters or more, no unit, no URL, no e-mail address; runs of over 256 characters don't count."""
    chunks = F.split(normalize_space(plain_text(c)), " ")
    prose = F.filter(chunks, lambda x: (F.length(x) <= 256) & ~x.rlike(r"(?i)^[(\"'\[<]*(?:https?://|www\.)") & ~x.rlike(r"^[^@]+@[^@]+\.[^@]+$"))
    known = F.array(*(F.lit(u.lower()) for u in units)) if units else F.array().cast("array<string>")
    word = lambda t: t.rlike(r"^\p{L}{3,}$") & ~F.array_contains(known, F.lower(t))
    return F.exists(prose, lambda x: F.exists(F.split(x, r"[^\p{L}\p{N}°³²µ%/'’-]+"), word))


def letters_words(c: Column) -> Column:
    """Words of letters with inner apostrophes or hyphens, 2 to 64 characters, from runs of at most 256 that are no URL or address."""
    runs = F.filter(F.split(normalize_space(plain_text(c)), " "), lambda x: (x != "") & (F.length(x) <= 256) & ~x.rlike(r"(?i)://|^www\.|@"))
    parts = F.flatten(F.transform(runs, lambda x: F.split(x, r"[^\p{L}\p{N}'’-]+")))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"^['’-]+|['’-]+$", ""))
    return F.filter(bare, lambda w: F.length(w).between(2, 64) & w.rlike(r"^\p{L}+(?:['’-]\p{L}+)*$"))


def evidence_tag(rule: Column) -> Column:
    return F.concat(F.lit("[EVIDENCE: "), rule, F.lit("]"))


def ensure_tagged(c: Column, tag: Column) -> Column:
    """c with the tag after it unless it carries one already."""
    return F.when(c.rlike(r"\[(EVIDENCE: [^\]]+|HYPOTHESIS[^\]]*)\]"), c).otherwise(F.concat(c, F.lit(" "), tag))


#: Shapes of secrets in logs.
SECRETS = (
    r"sk-ant-[A-Za-z0-9_-]{16,}",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{30,}",
    r"gsk_[A-Za-z0-9]{20,}",
    r"(?i)Bearer\s+[A-Za-z0-9._~+/=-]{16,}",
    r"(?i)(api[_-]?key|authorization|x-api-key)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9._~+/=-]{12,}",
)


def redact(c: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Known secrets of 8 characters or more and everything shaped like a key become [REDACTED]."""
    c = _swap(c, *((s, "[REDACTED]") for s in sorted({s for s in secrets if len(s) >= 8}, key=lambda s: (-len(s), s))))
    for p in SECRETS:
        c = F.regexp_replace(c, p, "[REDACTED]")
    return c


def unsafe_url(c: Column) -> Column:
    """Whether a URL would run something: control characters and spaces don't hide its scheme."""
    return F.lower(F.regexp_replace(c, r"[\x00-\x20\x{007f}]", "")).rlike("^(javascript|vbscript|data):")


def guard_formula(c: Column, guard: str = " ") -> Column:
    """A cell that a spreadsheet would take for a formula gets a guard before it."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit(guard), c)).otherwise(c)


def clamp_cell(c: Column, most: int = 32_000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("… [truncated, "), (F.length(c) - most).cast("string"), F.lit(" more characters]"))).otherwise(c)


def escape_markdown(c: Column, cell: bool = False, brackets: bool = False) -> Column:
    """A run of plain text that stays text in Markdown."""
    c = F.regexp_replace(c, r"\s*[\r\n]+\s*", " ")
    c = F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", r"\\\\\\\\$1")
    c = F.regexp_replace(c, r"&lt;|<", r"\\\\<")
    if cell:
        c = F.replace(c, F.lit("|"), F.lit("\\|"))
    if brackets:
        c = _swap(c, ("[", "\\["), ("]", "\\]"))
    return c


def call_cost(n_in: Column, n_cached: Column, n_out: Column, in_price: Column, cached_price: Column, out_price: Column) -> Column:
    """USD of a call at prices for a million tokens; null without a price. Cached input costs as input where it has no price."""
    return (n_in * in_price + F.coalesce(n_cached, F.lit(0)) * F.coalesce(cached_price, in_price) + n_out * out_price) / F.lit(1_000_000.0)


def match_spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, match), offsets in code points. The pattern must not match nothing."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,end:bigint,match:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("n"), h.alias("h")))
    one = lambda a, x: F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["h"].alias("match"))
    walk = F.aggregate(steps, zero, lambda a, x: F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.concat(a["out"], F.array(one(a, x))).alias("out")), lambda a: a["out"])
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(kind))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' multisets of letter and digit tokens, lower-cased; 0 if either has none.

    Each text's tokens are sorted once and bound to a lambda's variable, for an expression within a lambda runs again for each
    element. Equal tokens are told apart by their place among themselves, so that a set intersection counts multisets.
    """
    words = lambda c: F.array_sort(F.regexp_extract_all(F.lower(plain_text(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    told = lambda xs: F.transform(xs, lambda w, i: F.struct(w.alias("w"), (i - F.array_position(xs, w)).alias("k")))

    def f1(s: Column) -> Column:
        both = F.size(F.array_intersect(told(s["x"]), told(s["y"])))
        return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(s["x"]) + F.size(s["y"])))

    return F.get(F.transform(F.array(F.struct(words(a).alias("x"), words(b).alias("y"))), f1), F.lit(0))
