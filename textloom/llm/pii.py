"""Personal data in texts, found by DataFrame functions alone.

Four base patterns (email, ip, card, phone) give spans that always stay. Beside them generators with a high recall propose
overlapping candidates. Gradient-boosted trees score a candidate by features of its format and its context; a threshold
calibrated for each kind selects, and of overlapping candidates the best. The trees are trained in numpy on counts of feature
rows, whose number is bounded by the features' values, and run as one column expression.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns as Java has them. Possessive repeats and a look behind find the same matches as the plain patterns, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all: one fast look saves most texts the pattern.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
GENERATORS = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]{2,63}+){1,4}",),
    "ip": (r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": (r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])", r"(?<![0-9])3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9])"),
    "phone": (r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])", r"\+1[\x20.-]?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
}
GENERATOR_NEEDS = {"email": ("at",), "ip": (".", ":"), "card": ("", "", ""), "phone": ("+", "+", "")}
CONTEXT = r"(?i)(?:mail|contact|phone|call|tel|fax|mobile|card|visa|credit|pay|host|server|addr|ip)[^\n]{0,24}$"
FEATURES = ("kind", "digits", "luhn", "octets", "plus", "paren", "separators", "before", "after", "context", "first", "length")
#: The most frequent feature rows that the trees are fitted on; lessons() alone give some hundreds.
FIT_ROWS = 50_000
_SPAN = "array<struct<s:int,e:int,t:string>>"


def find(text: Column, pattern: str, need: str = "") -> Column:
    """Leftmost non-overlapping matches of a pattern as structs (s, e, t), offsets in code points, end exclusive."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    walk = F.aggregate(
        steps,
        zero,
        lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["h"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + F.length(x["h"])).alias("e"), x["h"].alias("t")))).alias("out")),
        lambda a: a["out"],
    )
    there = text.rlike(pattern)
    if need:
        there = F.when(F.contains(text, F.lit(need)), there).otherwise(F.lit(False))
    return F.when(there, walk).otherwise(F.array().cast(_SPAN))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _octets(t: Column) -> Column:
    return F.forall(F.split(t, "\\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))


def _valid(kind: str, t: Column) -> Column:
    n = F.length(_digits(t))
    return {"email": F.lit(True), "ip": _octets(t), "card": n.between(13, 19) & F.call_function("luhn_check", _digits(t)), "phone": n.between(9, 15)}[kind]


def _passes(kind: str):
    return lambda x: _valid(kind, x["t"])


def _span(k: int, *more: str):
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *(x[c].alias(c) for c in more))


def _labelled(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), _valid(KINDS[k], x["t"]).cast("int").alias("label"))


def _of_kind(k: int):
    return lambda b: b["k"] == k


def base_spans(text: Column) -> Column:
    """All base spans as structs (k, s, e), k the kind's place in KINDS, in order."""
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(F.transform(F.filter(find(text, BASE[kind], NEEDS[kind]), _passes(kind)), _span(k)))
    return F.array_sort(F.concat(*parts))


def _class(c: Column) -> Column:
    """0: nothing or white space, 1: another mark, 2: a letter or digit, 3: one of . - : that may go on with a number."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", 0).when(c.rlike(r"^[.:-]$"), 3).when(c.rlike(r"^[\p{L}\p{N}_]$"), 2).otherwise(1)


def candidates(text: Column) -> Column:
    """Distinct candidate spans as structs (k, s, e, f), f the features in the order of FEATURES."""
    parts = []
    for k, kind in enumerate(KINDS):
        for pattern, need in zip(GENERATORS[kind], GENERATOR_NEEDS[kind], strict=True):
            parts.append(F.transform(find(text, pattern, need), _span(k, "t")))

    def features(x: Column) -> Column:
        t, digits = x["t"], _digits(x["t"])
        n = F.length(digits)
        before = F.substring(text, F.greatest(F.lit(1), x["s"] - 29), F.least(x["s"], F.lit(30)))
        rows = [
            x["k"], F.least(n, F.lit(25)), F.when(n.between(13, 19) & F.call_function("luhn_check", digits), 1).otherwise(0), F.when(t.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _octets(t).cast("int")).otherwise(F.when(F.contains(t, F.lit(":")), 2).otherwise(3)),
            F.when(t.startswith("+"), 1).otherwise(0), F.when(F.contains(t, F.lit("(")), 1).otherwise(0), F.least(F.length(F.regexp_replace(t, r"[^\x20.-]", "")), F.lit(8)),
            _class(F.when(x["s"] > 0, F.substring(text, x["s"], F.lit(1)))), _class(F.substring(text, x["e"] + 1, F.lit(1))), F.when(before.rlike(CONTEXT), 1).otherwise(0),
            F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10)), F.least(F.floor((x["e"] - x["s"]) / 4), F.lit(12)).cast("int"),
        ]
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*(r.cast("int") for r in rows)).alias("f"))

    return F.transform(F.array_distinct(F.concat(*parts)), features)


@dataclass
class Trees:
    """Boosted trees of depth 3 as nested tuples (feature, cut, left, right) or leaf values; thresholds by kind."""

    trees: list
    thresholds: tuple[float, ...]

    def column(self, f: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, cut, left, right = node
            return F.when(f[feature] <= cut, walk(left)).otherwise(walk(right))

        total = walk(self.trees[0]) if self.trees else F.lit(0.0)
        for t in self.trees[1:]:
            total = total + walk(t)
        return 1 / (1 + F.exp(-total))

    def scores(self, X: np.ndarray) -> np.ndarray:
        def walk(node, rows: np.ndarray) -> np.ndarray:
            if not isinstance(node, tuple):
                return np.full(len(rows), float(node))
            feature, cut, left, right = node
            out, low = np.empty(len(rows)), X[rows, feature] <= cut
            out[low], out[~low] = walk(left, rows[low]), walk(right, rows[~low])
            return out

        total = np.zeros(len(X))
        for t in self.trees:
            total += walk(t, np.arange(len(X)))
        return 1 / (1 + np.exp(-total))


def boost(X: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3) -> list:
    """Logistic gradient boosting with Newton leaves over small integer features and weighted rows."""
    total, trees = np.zeros(len(y)), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left:
            for f in range(X.shape[1]):
                order = rows[np.argsort(X[rows, f], kind="stable")]
                cg, ch, v = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1], X[order, f]
                gain = np.where(v[1:] > v[:-1], cg**2 / (ch + 1) + (G - cg) ** 2 / (H - ch + 1) - G**2 / (H + 1), 0)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], f, int(v[i]))
        if best[1] is None:
            return -rate * G / (H + 1)
        low = X[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(len(y)), w * (p - y), w * p * (1 - p), depth)
        trees.append(tree)
        total = total + np.log(np.clip(Trees([tree], ()).scores(X), 1e-12, 1 - 1e-12) / np.clip(1 - Trees([tree], ()).scores(X), 1e-12, 1))
    return trees


def _luhn(body: str) -> str:
    s = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(body)))
    return body + str(-s % 10)


def lessons(n: int = 300, seed: int = 11) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label) by rule: formats of each kind in plain and in telling contexts, and what only looks like one."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    words = lambda k: " ".join("".join(r.choice("abcdefghinorstu") for _ in range(r.randint(2, 8))) for _ in range(k))
    out = []
    for i in range(n):
        card = _luhn(r.choice("3456") + digits(14))
        bad = card[:-1] + str((int(card[-1]) + r.randint(1, 9)) % 10)
        four = lambda c, s: s.join(c[j : j + 4] for j in range(0, 16, 4))
        name, host = words(1).replace(" ", ""), words(1).replace(" ", "")
        phone = f"+{r.randint(1, 99)}{r.choice(' -.')}{digits(3)}{(s := r.choice(' -.'))}{digits(3)}{s}{digits(4)}"
        us = f"+1 ({r.randint(2, 9)}{digits(2)}) {digits(3)}-{digits(4)}"
        local = f"{r.choice(['({})', '{}']).format(digits(3))}-{digits(3)}-{digits(4)}"
        octets = ".".join(str(r.randint(1, 255)) for _ in range(4))
        wrong = ".".join([str(r.randint(300, 999)), *(str(r.randint(1, 255)) for _ in range(3))])
        six = ":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8))
        kinds = [
            (2, card, 1, ""), (2, four(card, r.choice(" -")), 1, "card "), (2, bad, 0, ""), (2, four(bad, " "), 0, "order "), (2, digits(r.randint(13, 19)), None, "id "),
            (3, phone, 1, ""), (3, us, 1, "call "), (3, us, 1, ""), (3, local, 1, "phone "), (3, local, 0, "part "),
            (1, octets, 1, ""), (1, octets, 1, "server "), (1, wrong, 0, ""), (1, six, 1, ""), (0, f"{name} (at) {host} (dot) com", 1, ""), (0, f"{name}[at]{host}.org", 1, "mail "),
        ]
        kind, span, label, hint = kinds[i % len(kinds)]
        if label is None:
            label = int(span == _luhn(span[:-1]))
        head = f"{words(r.randint(0, 5))} {hint}"
        tail = r.choice([" ", ". ", ", ", "", f" {card} "]) + words(r.randint(0, 5))
        out.append((head + span + tail, kind, len(head), len(head) + len(span), label))
    return out


def train(spark: SparkSession, docs: DataFrame | None = None, n: int = 1600) -> Trees:
    """Trees from lessons() and, with docs, from the base rules' own verdicts on candidates of all its texts.

    A candidate that is a base match teaches 1 if the base rules pass it, else 0; one within a longer match teaches nothing. Only
    counts of equal feature rows reach the driver. Every fifth feature row is held out, and each kind's threshold is the
    least that selects with a precision of 0.95 there, 0.5 at least.
    """
    rows = spark.createDataFrame(lessons(n), "text string, kind int, s int, e int, label int")
    c = rows.select("kind", "s", "e", "label", F.explode(candidates(F.col("text"))).alias("c")).where("c.k = kind AND c.s = s AND c.e = e")
    taught = c.select("c.f", "label").groupBy("f", "label").count()
    if docs is not None:
        text = F.coalesce("text", F.lit(""))
        found = F.concat(*(F.transform(find(text, BASE[kind], NEEDS[kind]), _labelled(k)) for k, kind in enumerate(KINDS)))
        own = docs.select(candidates(text).alias("c"), found.alias("b")).where(F.size("c") > 0)
        own = own.select(F.explode(F.transform("c", lambda x: F.struct(x["f"].alias("f"), F.get(F.filter("b", lambda b: (b["k"] == x["k"]) & (b["s"] == x["s"]) & (b["e"] == x["e"])), F.lit(0))["label"].alias("label")))).alias("x"))
        taught = taught.unionByName(own.select("x.*").where("label IS NOT NULL").groupBy("f", "label").count())
    taught = taught.orderBy(F.col("count").desc(), "f", "label").limit(FIT_ROWS)
    got = sorted((tuple(r.f), r.label, r["count"]) for r in taught.collect())
    X = np.array([f for f, _, _ in got], np.int64).reshape(-1, len(FEATURES))
    y, w = np.array([v for _, v, _ in got], float), np.log1p(np.array([k for _, _, k in got], float))
    part = np.arange(len(y)) % 5 == 4
    model = Trees(boost(X[~part], y[~part], w[~part]), ())
    p, cuts = model.scores(X[part]), []
    for k in range(len(KINDS)):
        own = X[part][:, 0] == k
        tries = [t for t in np.arange(0.5, 0.96, 0.05) if (m := own & (p >= t)).any() and (w[part] * y[part])[m].sum() >= 0.95 * w[part][m].sum()]
        cuts.append(float(min(tries, default=0.9)))
    return Trees(model.trees, tuple(cuts))


def personal_data(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """For every row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Offsets count code points, end exclusive. Base spans are the leftmost non-overlapping matches of each kind that pass its check;
    the method adds spans that overlap no base span nor a better added one. Null texts count as empty and have no spans.
    """
    model = model or train(docs.sparkSession, docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("c"))
    cut = F.array(*(F.lit(t) for t in model.thresholds))
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    scored = F.transform(F.filter("c", apart), lambda x: F.struct(model.column(x["f"]).alias("p"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    rows = rows.withColumn("scored", F.when(F.size("c") > 0, scored).otherwise(F.array().cast("array<struct<p:double,k:int,s:int,e:int>>")))
    fit = F.filter("scored", lambda x: x["p"] >= F.get(cut, x["k"]))
    # Best first: the longer of overlapping candidates, then the likelier, then the earlier.
    best = F.array_sort(F.transform(fit, lambda x: F.struct((x["s"] - x["e"]).alias("n"), (-x["p"]).alias("p"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    added = F.aggregate(
        best,
        F.array().cast("array<struct<k:int,s:int,e:int>>"),
        lambda a, x: F.when(F.exists(a, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])), a).otherwise(F.concat(a, F.array(F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))),
    )
    rows = rows.withColumn("added", F.when(F.size("scored") > 0, added).otherwise(F.array().cast("array<struct<k:int,s:int,e:int>>")))
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
