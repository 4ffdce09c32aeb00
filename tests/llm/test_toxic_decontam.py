import hashlib
import re
import zlib

import numpy as np

from textloom.llm import decontam, toxic

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UP))


def brute(docs, items, window=10):
    """Straight from the definition: every window at every place."""
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    lengths = {len(k) for k in wins}
    out = {}
    for i, text in docs:
        w = words(text)
        hit, found = [0] * len(w), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if (own := wins.get(tuple(w[a : a + k]))) is not None:
                    found |= own
                    hit[a : a + k] = [1] * k
        ids = ",".join(sorted(found))
        out[i] = (len(w), sum(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0)
    return out


def got(rows):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}


def test_contamination_of_tables(spark, docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = decontam.contamination(docs, bench).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(rows) == want and any(v[4] for v in want.values())


def test_contamination_edges(spark, frame, monkeypatch):
    long_item = " ".join(f"w{i}" for i in range(30))
    items = [(1, "Alpha beta, GAMMA!"), (2, long_item), (2, long_item), (3, None), (4, "?!"), (5, "ééé"), (6, "alpha beta gamma delta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "x alpha BETA-gamma y"), (4, f"q {' '.join(f'W{i}' for i in range(5, 22))} z"), (5, "ééé ÉÉÉ é"), (6, "alpha beta"), (7, "a " * 50_000 + "alpha beta gamma delta"), (8, "alpha beta alpha beta gamma gamma")]
    frame_ = frame(rows)
    assert got(decontam.contamination(frame_, bench).collect()) == brute(rows, [i for i in items if i[1]])
    by = {r.doc_id: r for r in decontam.contamination(frame_, bench).collect()}
    assert (by[4].longest_words, by[4].longest_item_id, by[4].longest_at) == (17, "2", 1) and by[1].longest_item_id is None
    monkeypatch.setattr(decontam.write_blocks, "__defaults__", (10,))  # many blocks give the same
    assert got(decontam.contamination(frame_, bench).collect()) == brute(rows, [i for i in items if i[1]])
    clean = decontam.remove_contaminated(frame_, bench)
    assert clean.columns == frame_.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 6]


def test_contamination_empty(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.contamination(frame([(1, "a b c")]), none).collect()] == [0]
    assert decontam.contamination(frame([]), none).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxic.score_documents(docs, labels).join(labels, "doc_id").select("doc_id", "predicted", "score", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    tp = sum(r.predicted and r.toxic for r in held)
    # Some labels of this table stand on texts with nothing to see in them.
    assert tp >= 0.75 * sum(r.toxic for r in held) and tp >= 0.9 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_edges(spark, frame):
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame([(i, ("vile words " if i % 2 == 0 else "kind words ") * 3) for i in range(60)] + [(70, None), (71, ""), (72, "!?"), (None, "vile"), (73, "vile " * 40_000), (73, "kind")])
    rows = toxic.score_documents(docs, labels).collect()
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (70, 71, 72)}) == 1
    assert toxic.keep_clean(docs, labels).columns == docs.columns
    nothing = toxic.score_documents(docs, labels.limit(0)).collect()
    assert all(r.predicted == 0 for r in nothing)
    assert toxic.score_documents(frame([]), labels).count() == 0


def test_scores_do_not_depend_on_neighbours():
    texts = ["vile mean words here", "kind words", "", "vile", None] * 40
    model = toxic.fit([t or "" for t in texts], [int("vile" in (t or "")) for t in texts])
    import pandas as pd

    alone = np.concatenate([next(iter(toxic.score_texts(model, iter([pd.Series([t])])))) for t in texts[:5]])
    assert np.allclose(np.concatenate(list(toxic.score_texts(model, iter([pd.Series(texts)]))))[:5], alone, atol=1e-6)


def test_thresholds_on_all_labelled_rows(spark, frame, monkeypatch):
    """Rows beyond the fitting sample, by number and by length, count for thresholds."""
    monkeypatch.setattr(toxic, "SAMPLE_TOXIC", 20)
    monkeypatch.setattr(toxic, "SAMPLE_CLEAN", 20)
    n = 150
    docs = frame([(i, ("vile words " if i % 2 else "kind words ") * (3 if i < 100 else 2500)) for i in range(n)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, toxic int")
    folds = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    model = toxic.fit(*toxic.sample(docs, labels))
    counts = toxic.histogram(model, docs, labels)
    assert sum(r.toxic for r in counts) == sum(i % 2 for i in folds) and sum(r.clean for r in counts) == sum(1 - i % 2 for i in folds)
    rows = toxic.score_documents(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)
