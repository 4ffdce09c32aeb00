"""Toxicity scores from a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of the word and of its first four letters, each under two hash functions, so that a
word that meets a toxic one in one table doesn't meet it in the other. Filters of widths 1, 2 and 3 run over the whole text, each
keeps its largest response (max pooling), and a linear layer gives a logit. Thresholds are set by language, which is guessed
from the text's own frequent words, on all labelled texts of the training folds; the score maps the language's threshold to 0.7.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, release, save, small_batches, text_or_empty, trim

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Bounds of the sample that the model is fitted on: labelled rows of each class, and characters of a text in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 5000, 20_000
THRESHOLD = 0.7
#: Bins of logits to a unit, and the largest logit told apart, when thresholds are set; labels that are broadcast at most.
BINS, FAR, BROADCAST_ROWS = 64, 200, 1_000_000
#: Slope of a filter's response below zero.
LEAK = 0.1
#: Texts of the sample that a word must be in to count.
LEAST_TEXTS = 4
#: Part of a text's words that a pass of the training leaves out, so that each word has to tell by itself.
DROP = 0.4
#: Words that are scored at a time.
GROUP = 50_000
#: Very frequent words by which a text's language is told.
FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "with"),
    "fr": ("le", "les", "et", "des", "est", "une", "dans", "que"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "für"),
    "es": ("el", "los", "y", "las", "una", "del", "por", "con"),
}
LANGS = (*FREQUENT, "other")
_WORD = re.compile(r"\w+")


class Words(dict):
    """Word -> row of a growing table of its four buckets and of its language votes."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit
        self.rows: list[tuple[int, int, int, int]] = []
        self.votes: list[int] = []
        self.lang = {w: i for i, ws in enumerate(FREQUENT.values()) for w in ws}

    def __missing__(self, word: str) -> int:
        whole, head = word.encode("utf-8", "surrogatepass"), word[:4].encode("utf-8", "surrogatepass")
        row = tuple(zlib.crc32(x, seed) % BUCKETS for x, seed in ((b"w" + whole, 1), (b"w" + whole, 77), (b"p" + head, 3), (b"p" + head, 99)))
        n = self[word] = len(self)
        self.rows.append(row)
        self.votes.append(self.lang.get(word, len(FREQUENT)))
        return n

    def ids(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def language(votes: np.ndarray) -> int:
    n = np.bincount(votes, minlength=len(LANGS))[: len(FREQUENT)]
    return int(n.argmax()) if n.max() else len(FREQUENT)


class Model:
    """The network's arrays; forward() gives pooled responses and where they were found."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.E = (r.standard_normal((BUCKETS, DIM)) / 100).astype(np.float32)
        self.F = [(r.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.u = (r.standard_normal(FILTERS * len(WIDTHS)) / 3).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.shift = np.zeros(len(LANGS))
        self.scale = 1.0

    def forward(self, X: np.ndarray, starts: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """X: word vectors, each text followed by two rows of zeros that aren't real; starts: where texts begin. Pooled (texts, filters), argmax.

        A window starts at a word of its text; the empty places stand for no response, so no text sees the next one.
        """
        n, pooled, where = len(X), [], []
        ends = np.append(starts[1:], n)
        for k, w in enumerate(WIDTHS):
            out = X @ self.F[k][0]
            for j in range(1, w):
                out[: n - j] += X[j:] @ self.F[k][j]
            out[~real] = 0
            best = np.maximum.reduceat(out, starts, axis=0)
            pooled.append(best)
            if self.train:
                at = np.empty((len(starts), FILTERS), np.int64)
                for i, (a, z) in enumerate(zip(starts, ends, strict=True)):
                    at[i] = a + out[a:z].argmax(0)
                where.append(at)
        return np.concatenate(pooled, 1) + self.b, np.concatenate(where, 1) if self.train else None

    train = False

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.where(pooled > 0, pooled, LEAK * pooled) @ self.u + self.c[0]

    def score(self, logits: np.ndarray, langs: np.ndarray) -> np.ndarray:
        x = self.scale * (logits.astype(np.float64) - self.shift[langs]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of texts in a row, -1 for the two empty places after each, and the texts' starts."""
    gap = np.array([-1, -1])
    starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
    return np.concatenate([x for t in texts for x in (t, gap)]), starts


def fit(texts: list[str], labels: list[int], epochs: int = 10, batch: int = 64, seed: int = 7, steps: int = 800) -> Model:
    """Trains on texts and calibrates thresholds on every fifth of them, which training leaves out. Small samples are gone over more often, to so many steps."""
    model, words = Model(seed), Words()
    ids = [words.ids(t) for t in texts]
    y = np.array(labels, np.float32)
    langs = np.array([language(np.array([words.votes[j] for j in i], int) if len(i) else np.array([], int)) for i in ids], int) if ids else np.array([], int)
    H = np.array(words.rows, np.int64).reshape(-1, 4)
    part = np.arange(len(y)) % 5 == 4
    fitting = np.flatnonzero(~part)
    if len(fitting) and 0 < y[fitting].sum() < len(fitting):
        r = np.random.default_rng(seed)
        weight = np.where(y > 0, 0.5 / max(y[fitting].mean(), 1e-6), 0.5 / max(1 - y[fitting].mean(), 1e-6)).astype(np.float32)
        named = [*model.F, model.b, model.u, model.c]
        m, v = [np.zeros_like(p) for p in named], [np.zeros_like(p) for p in named]
        G2 = np.full(model.E.shape, 1e-8, np.float32)
        step, model.train = 0, True
        # Only buckets of LEAST_TEXTS texts or more can say anything: rarer words would be learnt by heart.
        texts_of = np.zeros(BUCKETS, np.int64)
        for j in fitting:
            texts_of[np.unique(H[ids[j]])] += 1
        told = texts_of >= LEAST_TEXTS
        model.E[~told] = 0
        for _ in range(max(epochs, -(-steps * batch // len(fitting)) if len(fitting) > batch else epochs)):
            order = r.permutation(fitting)
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                at, starts = _lay([ids[j][r.random(len(ids[j])) > DROP] for j in pick])
                X = np.zeros((len(at), DIM), np.float32)
                real = at >= 0
                X[real] = model.E[H[at[real]]].sum(1)
                pooled, where = model.forward(X, starts, real)
                hidden = np.where(pooled > 0, pooled, LEAK * pooled)
                p = 1 / (1 + np.exp(-np.clip(hidden @ model.u + model.c[0], -30, 30)))
                d = (p - y[pick]) * weight[pick] / len(pick)
                back = (d[:, None] * model.u) * np.where(pooled > 0, 1, LEAK)
                grads = [np.zeros_like(f) for f in model.F]
                rows, vals = [], []
                for k, w in enumerate(WIDTHS):
                    a = where[:, k * FILTERS : (k + 1) * FILTERS]
                    g = back[:, k * FILTERS : (k + 1) * FILTERS] * real[a]
                    for j in range(w):
                        src = np.minimum(a + j, len(X) - 1)
                        grads[k][j] = np.einsum("nfd,nf->df", X[src], g)
                        rows.append(src.ravel())
                        vals.append((g[:, :, None] * model.F[k][j].T[None]).reshape(-1, DIM))
                rows, vals = np.concatenate(rows), np.concatenate(vals)
                keep = (at[rows] >= 0) & (np.abs(vals).sum(1) > 0)
                buckets = H[at[rows[keep]]].ravel()
                uniq, inv = np.unique(buckets, return_inverse=True)
                ge = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(ge, inv, np.repeat(vals[keep], 4, axis=0))
                ge[~told[uniq]] = 0
                G2[uniq] += ge * ge
                model.E[uniq] -= 0.1 * ge / np.sqrt(G2[uniq])
                step += 1
                for q, (pp, g) in enumerate(zip(named, [*grads, back.sum(0), hidden.T @ d, d.sum(keepdims=True)], strict=True)):
                    m[q] = 0.9 * m[q] + 0.1 * g
                    v[q] = 0.99 * v[q] + 0.01 * g * g
                    pp -= 0.01 * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-8)
        model.train = False
    vectors = model.E[H].sum(1) if len(H) else np.zeros((0, DIM), np.float32)
    logits = np.concatenate([_logits(model, vectors, ids[i : i + 64]) for i in range(0, len(ids), 64)]) if ids else np.zeros(0)
    _calibrate(model, logits, y, langs, part)
    return model


def _logits(model: Model, vectors: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    at, starts = _lay(ids)
    X = np.zeros((len(at), DIM), np.float32)
    X[at >= 0] = vectors[at[at >= 0]]
    return model.logits(model.forward(X, starts, at >= 0)[0])


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray, langs: np.ndarray, part: np.ndarray) -> None:
    """For each language the logit that makes the fewest errors in the held part; the widest such gap's middle. With under 20 rows of a class: that of all languages."""

    def best(z: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        z, t = z[order], t[order]
        wrong = np.concatenate([[0], np.cumsum(t)]) + ((1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)]))
        cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        gap = np.concatenate([[0], z[1:] - z[:-1], [0]])
        least = np.flatnonzero(wrong == wrong.min())
        return float(cuts[least[gap[least].argmax()]])

    every = best(logits[part], y[part]) if part.any() and 0 < y[part].sum() < part.sum() else 3.0
    for k in range(len(LANGS)):
        own = part & (langs == k)
        model.shift[k] = best(logits[own], y[own]) if min(y[own].sum(), (1 - y[own]).sum()) >= 20 else every
    spread = np.abs(logits[part] - every).mean() if part.any() else 1.0
    model.scale = float(3.0 / max(spread, 1e-3))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training folds, crc32(doc_id as text) mod 3 not 1; of rows with the same doc_id the largest label counts."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Labelled texts of the training folds, crc32(doc_id as text) mod 3 not 1: the first SAMPLE_TOXIC and SAMPLE_CLEAN by the hash of doc_id.

    Rows with a null label or doc_id are left out; of rows with the same doc_id the largest label counts. The broadcast
    list of identifiers is bounded by those two numbers.
    """
    known = known_labels(labels)
    h = F.xxhash64("doc_id")
    pick = known.where("toxic > 0").orderBy(h, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic <= 0").orderBy(h, "doc_id").limit(SAMPLE_CLEAN))
    rows = docs.select("doc_id", text_or_empty().alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(pick), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [r.text for r in rows], [int(r.toxic > 0) for r in rows]


def score_texts(model: Model, parts: Iterator[pd.Series], raw: bool = False) -> Iterator[pd.Series | pd.DataFrame]:
    """Scores of whole texts; raw: their languages and bins of logits instead. Each word is looked up once and kept, up to a limit, with what every filter tap makes of it."""
    taps = np.concatenate([f for f in model.F], 0)  # one for each place in each width: (places, DIM, FILTERS)
    words, known = Words(), 0
    # Room for the limit and for what one group may add beyond it, taken once.
    table, votes = np.zeros((len(taps), FILTERS, words.limit + 2 * GROUP + 1), np.float32), np.zeros(words.limit + 2 * GROUP, np.int8)
    for part in parts:
        out, texts = [], part.tolist()
        i = 0
        while i < len(texts):
            if len(words) > words.limit:
                words, known = Words(), 0
            group, n = [], 0
            while i < len(texts) and n < GROUP:
                group.append(words.ids(texts[i]))
                n += len(group[-1])
                i += 1
            if (now := len(words)) > known:
                if now >= table.shape[2]:  # one very long text of new words
                    table = np.concatenate([table, np.zeros((len(taps), FILTERS, now), np.float32)], 2)
                    votes = np.concatenate([votes, np.zeros(now, np.int8)])
                new = model.E[np.array(words.rows, np.int64)].sum(1)
                table[:, :, known + 1 : now + 1] = np.einsum("nd,tdf->tfn", new, taps, optimize=True)  # row 0 is the empty place
                votes[known:now] = words.votes
                words.rows, words.votes, known = [], [], now
            at, starts = _lay(group)
            at += 1
            gap = np.flatnonzero(at == 0)
            pooled, tap = np.zeros((len(group), FILTERS * len(WIDTHS)), np.float32), 0
            for k, w in enumerate(WIDTHS):
                for f in range(FILTERS):
                    r = table[tap, f].take(at)
                    for j in range(1, w):
                        r[:-j] += table[tap + j, f].take(at[j:])
                    r[gap] = 0
                    pooled[:, k * FILTERS + f] = np.maximum.reduceat(r, starts)
                tap += w
            langs = np.array([language(votes[g]) for g in group], int)
            logits = model.logits(pooled + model.b)
            out.append(np.stack([langs, np.rint(np.clip(logits, -FAR, FAR) * BINS)], 1) if raw else model.score(logits, langs))
        if raw:
            yield pd.DataFrame(np.concatenate(out or [np.zeros((0, 2))]).astype(np.int32), columns=["lang", "bin"])
        else:
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))


def scorer(spark, model: Model):
    """A column function: text -> score."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only()
        yield from score_texts(held.value, parts)
        trim()

    return score


def histogram(model: Model, docs: DataFrame, labels: DataFrame) -> list:
    """(lang, bin, toxic, clean): rows by language, bin of logit and label, of all labelled texts of the training folds; 2 * FAR * BINS + 1 bins a language at most."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang: int, bin: int>")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only()
        yield from score_texts(held.value, parts, raw=True)
        trim()

    known = save(known_labels(labels), "toxic-labels")
    # Up to so many labels go to all executors, so that texts aren't shuffled.
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id").select(place("text").alias("p"), (F.col("toxic") > 0).alias("t"))
    return rows.groupBy("p.lang", "p.bin").agg(F.count_if("t").alias("toxic"), F.count_if(~F.col("t")).alias("clean")).collect()


def set_thresholds(model: Model, counts: list) -> None:
    """As _calibrate(), from a histogram of all labelled rows. Without rows of both classes nothing changes."""
    table = np.array(sorted((r.bin, r.lang, r.toxic, r.clean) for r in counts), float).reshape(-1, 4)

    def best(t: np.ndarray) -> float:
        z, at = np.unique(t[:, 0], return_inverse=True)
        toxic, clean = (np.bincount(at, t[:, k], len(z)) for k in (2, 3))
        wrong = np.concatenate([[0], np.cumsum(toxic)]) + (clean.sum() - np.concatenate([[0], np.cumsum(clean)]))
        z = z / BINS
        cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        gap = np.concatenate([[0], z[1:] - z[:-1], [0]])
        least = np.flatnonzero(wrong == wrong.min())
        return float(cuts[least[gap[least].argmax()]])

    if not table[:, 2].sum() or not table[:, 3].sum():
        return
    every = best(table)
    for k in range(len(LANGS)):
        own = table[table[:, 1] == k]
        model.shift[k] = best(own) if min(own[:, 2].sum(), own[:, 3].sum()) >= 20 else every
    spread = np.average(np.abs(table[:, 0] / BINS - every), weights=table[:, 2] + table[:, 3])
    model.scale = float(3.0 / max(spread, 1e-3))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    release(docs.sparkSession)
    model = fit(*sample(docs, labels))
    trim()  # what fitting took stays with the driver else
    set_thresholds(model, histogram(model, docs, labels))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with two more columns, score (0 to 1) and predicted (1 if score >= 0.7, else 0), for every row.

    Null and empty texts have no words and get the score of no evidence. With no labelled rows of both classes nothing is
    learnt and nothing is predicted toxic. Columns of docs named score or predicted are replaced.
    """
    small_batches(docs.sparkSession)
    made = scorer(docs.sparkSession, model or trained(docs, labels))
    return docs.withColumn("score", made(text_or_empty())).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their own columns."""
    small_batches(docs.sparkSession)
    made = scorer(docs.sparkSession, trained(docs, labels))
    return docs.where(made(text_or_empty()) < THRESHOLD)
