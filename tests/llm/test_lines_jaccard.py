import random
import re

import numpy as np
import pytest

from textloom.llm import jaccard, lines
from textloom.llm.common import components


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_lines(rows, near=one_edit):
    """Of every line the earliest earlier duplicate, by comparing all pairs."""
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for n, line in enumerate((text or "").split("\n")):
            if not line.strip(" "):
                continue
            w = line.strip(" ").split(" ")
            for j, m, other, v in seen:
                if other == line or min(len(w), len(v)) >= 5 and near(w, v):
                    out[i, n] = (j, m)
                    break
            seen.append((i, n, line, w))
    return out


def test_lines_of_tables(docs):
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()]
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in lines.duplicate_lines(docs.where("length(text) < 4000")).collect()}
    assert got == brute_lines(rows) and got


def test_lines_random(frame):
    r = random.Random(2)
    rows = [(i, "\n".join(" ".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " a b c a b c "), (104, "a b c a b c"), (-3, "z z z z y\nz z z z y")]
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows)).collect()}
    assert got == brute_lines(rows)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def fifth_near(a, b):
    return distance(a, b) <= max(len(a), len(b)) // 5


@pytest.mark.parametrize("letters, hot, few", [("abc", 16, 16), ("abcdefghijklmnopqrstuvwxyzäöü", 16, 16), ("abcdefgh", 1, 2)])
def test_lines_at_a_fifth(frame, monkeypatch, letters, hot, few):
    """Copies with as many edits as their length allows, on both sides of the bound, short and long, of few and of many words; groups split and not."""
    r = random.Random(len(letters))
    rows = []
    for i in range(150):
        if i % 5 == 0:
            base = [r.choice(letters) * r.randint(1, 2) for _ in range(r.choice([5, 6, 9, 10, 14, 19, 20, 21, 24, 25, 26, 29, 30, 45]))]
        w = list(base)
        for _ in range(r.randint(0, len(base) // 5 + 1)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice([[], ["zz"], [r.choice(letters)]])
        rows.append((i, " ".join(w)))
    for name, value in (("HOT", hot), ("FEW", few)):
        monkeypatch.setattr(lines, name, value)
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows), lines.a_fifth).collect()}
    assert got == brute_lines(rows, fifth_near) and len(got) > 50


def test_lines_of_a_large_group_make_few_pairs(frame, monkeypatch):
    """Near copies of one line, many of them not near the earliest: each meets the next ones only until one answers."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        w = list(base)
        for at in r.sample(range(40), 5):
            w[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    made, save = {}, lines.save

    def counted(df, name):
        out = save(df, name)
        made[name] = made.get(name, 0) + out.count() * name.endswith("pairs")
        return out

    monkeypatch.setattr(lines, "save", counted)
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows), lines.a_fifth).collect()}
    assert got == brute_lines(rows, fifth_near) and len(got) > 100
    assert sum(made.values()) < 12 * len(rows)


def test_lines_that_share_keys_by_chance_stay_narrow(frame, monkeypatch):
    """Groups of a few dozen lines make no ranks, and words are only fetched of lines that sketches let pass."""
    r = random.Random(4)
    rows = [(i, " ".join(f"p{k} q{k}" for k in r.sample(range(40), 15))) for i in range(28)]
    rows += [(i + 100, text.replace(" q", " x", 1)) for i, text in rows[:3]]
    made, save = {}, lines.save

    def counted(df, name):
        out = save(df, name)
        made.setdefault(name, out.count())
        return out

    monkeypatch.setattr(lines, "save", counted)
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows), lines.a_fifth).collect()}
    assert got == brute_lines(rows, fifth_near) and len(got) == 3
    assert made["lines-few"] > 100 and made["lines-ranked"] == 0 and made["lines-words"] < 20


def test_lines_kept_documents(frame):
    rows = [(1, "keep this line\nand this other line of words"), (2, "keep this line"), (3, "new text\nkeep this line\n\nmore"), (4, None), (5, ""), (6, "and this other row of words")]
    df = frame(rows)
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup_lines(df).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 3: ("new text\n\nmore", 14), 4: (None, None), 5: ("", 0)}
    assert lines.dedup_lines(df).columns == df.columns
    assert lines.dedup_lines(frame([])).count() == 0


def test_lines_null_and_repeated_ids(frame):
    df = frame([(None, "one line here"), (None, "one line here"), (5, "one line here"), (5, "another line"), (6, "x" * 100_000)])
    left = sorted((r.doc_id is not None, r.doc_id, r.text[:20]) for r in lines.dedup_lines(df).collect())
    assert left == [(False, None, "one line here")] * 2 + [(True, 5, "another line"), (True, 6, "x" * 20)]


def test_lines_use_no_python(docs):
    plan = lines.duplicate_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_classes(rows, k, percent):
    s = sets_of(rows, k)
    ids = sorted(s)
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in ids}


def test_jaccard_of_tables(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, k, percent).collect()}
        assert got == brute_classes(rows, k, percent)


def test_jaccard_random(frame, monkeypatch):
    """Near the threshold, with classes that only chains join, hot shingles, and buckets of several blocks."""
    r = random.Random(6)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) for _ in range(r.randint(8, 60))] for _ in range(12)]
    rows = []
    for i in range(220):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(["q", "Zz", "é"])
        rows.append((i * 3 - 50, " ".join(w) + r.choice(["", "\n", " the common tail of all these many texts here"])))
    rows += [(900, None), (901, ""), (902, "Two words"), (903, "two\tWORDS"), (904, "é É"), (905, "é é")]
    monkeypatch.setattr(jaccard, "COMMON", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_documents(frame(rows), 4, 85).collect()}
    assert got == brute_classes(rows, 4, 85)


def test_jaccard_null_and_repeated_ids(frame):
    rows = jaccard.similar_documents(frame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")]), 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows if r.doc_id) == [(1, 1), (1, 1), (2, 1)] and len(rows) == 4
    assert jaccard.similar_documents(frame([])).count() == 0


def test_keep_one(frame):
    df = frame([(5, "a b c d e f g"), (3, "A b c d e f g"), (8, "something else with six words"), (9, None), (10, "")])
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [3, 8, 9, 10] and jaccard.keep_one(df).columns == df.columns


def test_tree_pairs_lose_nothing():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in r.integers(1, 400, 40)]
    for _ in range(160):
        s = sets[r.integers(len(sets))]
        sets.append(np.unique(np.concatenate([s[r.random(len(s)) > r.random() * 0.2], r.integers(0, 1 << 63, int(r.integers(0, 20))).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    bits, sizes = jaccard.bitmaps(sets), np.array([len(s) for s in sets])
    i, j = jaccard.tree_pairs(bits, sizes, np.arange(len(sets)), 85)
    found = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 8


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(2000, 2200)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if any(a != b and x in (a, b) for a, b in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_lines_with_more_edits(frame, monkeypatch):
    """Lines near by a fifth of the longer one's words, against all pairs."""
    r = random.Random(5)
    made = []
    for _ in range(25):
        base = [r.choice(["the", "of", *(f"w{k}" for k in range(60))]) for _ in range(r.choice([5, 9, 10, 14, 20, 33, 60]))]
        for _ in range(5):
            w = list(base)
            for _ in range(r.randint(0, len(base) // 5 + 2)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [r.choice("xyz")], [w[at], r.choice("xyz")]])
            made.append(" ".join(w))
    r.shuffle(made)
    rows = [(i, "\n".join(made[i::30])) for i in range(30)]
    want, seen = {}, []
    for i, text in rows:
        for n, line in enumerate(text.split("\n")):
            w = line.split(" ")
            for j, m, v in seen:
                if w == v or min(len(w), len(v)) >= 5 and word_edits(w, v) <= max(len(w), len(v)) // 5:
                    want[i, n] = (j, m)
                    break
            seen.append((i, n, w))
    got = {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows), lines.a_fifth).collect()}
    assert got == want and len(want) > 40
    monkeypatch.setattr(lines, "FEW", 3)  # keys of very many lines give the same
    assert got == {(x.doc_id, x.line_no): (x.first_doc_id, x.first_line_no) for x in lines.duplicate_lines(frame(rows), lines.a_fifth).collect()}
