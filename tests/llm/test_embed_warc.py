import base64
import gzip
import hashlib
import json
import random

import numpy as np
import pytest

from textloom.llm import embed, warc


def brute(rows, threshold=0.95):
    ok = {}
    for i, e in rows:
        if e is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            v = np.array(e, float)
            ok[i] = v / np.abs(v).max()
    ids = sorted(ok)
    up, n = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], top(i), i == top(i)) for i, _ in rows}


def run(df, **k):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(df, **k).collect()}


def test_vectors_with_edges(spark, monkeypatch):
    r = np.random.default_rng(8)
    heads = r.standard_normal((6, 16))
    rows = [(i, (heads[i % 6] + r.standard_normal(16) * 0.04 * (i % 5)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, r.standard_normal(16).tolist()) for i in range(60)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0, None]), (3005, [float("inf")] * 16), (3006, [1.0]), (3007, [2.0]), (3008, [1e300] * 16), (3009, [1e-300] * 16)]
    monkeypatch.setattr(embed, "BLOCK", 32)
    got = run(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), probes=50)
    assert got == brute(rows)


def test_vectors_of_tables_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 0.6)
    got = run(df, threshold=0.6)
    assert sum(n for n, *_ in got.values()) >= 0.9 * sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_no_vectors(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert run(spark.createDataFrame([(4, None)], "vec_id long, embedding array<float>")) == {4: (0, 4, True)}


def test_repeated_and_null_ids(spark):
    """Equal rows link with each other; of several vectors of one id the same one counts each time; columns that clash with inner names are ignored."""
    rows = [(1, [1.0, 0.0], 9, "d"), (1, [1.0, 0.0], 9, "d"), (2, [0.0, 1.0], 9, "d"), (2, [1.0, 0.02], 9, "d"), (None, [1.0, 0.0], 9, "d"), (3, [1.0, 0.01], 9, "d")]
    kind = "vec_id long, embedding array<float>, rep long, d string"
    seen = {tuple(sorted(map(tuple, embed.near_duplicates(spark.createDataFrame(rows[i:] + rows[:i], kind).repartition(2)).collect()), key=str)) for i in range(3)}
    assert len(seen) == 1
    got = {(r[0], *r[1:]) for r in next(iter(seen))}
    n = {i: links for i, links, _, _ in got}
    assert n[None] == 0 and n[1] == n[3] + (0 if n[2] else 0) and n[1] in (2, 4) and {(i, c) for i, _, c, _ in got} >= {(1, 1), (3, 1), (None, None)}


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, sha string, date_ string").repartition(3)


ROWS = [(i, f"https://www.Site{i % 4}.example/{i % 9}?q={i}#f", f"<p>page {i % 11} é</p>\r\n\r\nWARC/1.1\r\n" * (i % 5)) for i in range(90)] + [(500, None, None), (501, "bad url:[", ""), (502, "http://h.example:8080/a", "z" * 200_000), (503, "x\r\ny", "A\r\n\r\nB")]


@pytest.mark.parametrize("least", [0, 40])
def test_archives_round_trip(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "RUN_LINES", 20)
    monkeypatch.setattr(warc, "SPARSE", 4)
    df, index = warc.archive_pages(pages(spark, ROWS), str(tmp_path / str(least)), min_bytes=least)
    first = {}
    for i, _, h in sorted(ROWS):
        first.setdefault(h or "", i)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}
    for i, _, h in ROWS:
        raw = (h or "").encode()
        again = first[h or ""] if first[h or ""] != i and len(raw) >= least else None
        assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again is not None else "response", again)
    assert sum(s["n"] for s in index) == len(ROWS)


def test_index_is_in_order_and_finds_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN_LINES", 10)
    monkeypatch.setattr(warc, "SPARSE", 4)
    made = warc.write_archives(pages(spark, ROWS), str(tmp_path))
    index = warc.merge_index(spark, made, str(tmp_path), shards=5)
    lines = [line.split(" ", 2) for s in index for line in open(s["path"], encoding="utf-8").read().splitlines()]
    order = [(x, y) for x, y, _ in lines]
    assert order == sorted(order) and len(lines) == len(ROWS) and len(index) > 2
    for key, _, facts in lines[::7]:
        f = json.loads(facts)
        with open(tmp_path / f["filename"], "rb") as stream:
            stream.seek(f["offset"])
            fields, _, _ = warc.parse(gzip.decompress(stream.read(f["length"])))
        assert fields["X-Page-Id"] == f["page_id"] and warc.url_key(fields["WARC-Target-URI"]) == key.replace("%0A", "\n")


def test_records_come_by_the_merged_index(spark, tmp_path, monkeypatch):
    """Rows are those of the index, in its order; a line that is left out takes its record with it, a wrong one is found out."""
    for name, value in (("RUN_LINES", 5), ("SPARSE", 2), ("FAN_IN", 2), ("READ_LINES", 7)):
        monkeypatch.setattr(warc, name, value)
    made = warc.write_archives(pages(spark, ROWS), str(tmp_path))
    index = warc.merge_index(spark, made, str(tmp_path), shards=3)
    for shard in index:
        pieces = list(warc.records_of(shard["path"], str(tmp_path)))
        facts = [f for piece in pieces for f, _ in piece]
        assert [json.loads(x.split(" ", 2)[2]) for x in open(shard["path"], encoding="utf-8").read().splitlines()] == facts and max(map(len, pieces)) <= 7
    assert warc.read_archives(spark, index, str(tmp_path)).count() == len(ROWS)
    whole = open(index[0]["path"], encoding="utf-8").read().splitlines(True)
    open(index[0]["path"], "w", encoding="utf-8").writelines(whole[1:])
    assert warc.read_archives(spark, index, str(tmp_path)).count() == len(ROWS) - 1
    facts = json.loads(whole[1].split(" ", 2)[2])
    other = json.loads(whole[2].split(" ", 2)[2])
    open(index[0]["path"], "w", encoding="utf-8").write("k 1 " + json.dumps(facts | {k: other[k] for k in ("filename", "offset", "length")}) + "\n")
    with pytest.raises(Exception, match="has another record"):
        warc.read_archives(spark, index, str(tmp_path)).count()


def test_revisits_can_be_resolved(spark, tmp_path):
    """Revisits name the page, URL and date of their response; rows alike have record ids of their own; a column captured_at means nothing unless named."""
    rows = [(1, "http://a.example/", "same", "not a time"), (1, "http://a.example/", "same", None), (7, "http://b.example/", "same", "2020-05-06"), (None, "http://c.example/", "same", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at string")
    _, index = warc.archive_pages(df, str(tmp_path))
    got = [warc.parse(c)[0] for s in index for piece in warc.records_of(s["path"], str(tmp_path)) for _, c in piece]
    assert len({f["WARC-Record-ID"] for f in got}) == 4 and sorted(f["WARC-Type"] for f in got) == ["response"] * 3 + ["revisit"]
    again = next(f for f in got if f["WARC-Type"] == "revisit")
    first = next(f for f in got if f["X-Page-Id"] == "1")
    assert (again["X-Refers-To-Page"], again["WARC-Refers-To-Target-URI"], again["WARC-Refers-To-Date"]) == ("1", "http://a.example/", first["WARC-Date"]) and first["WARC-Date"] == "2024-01-01T00:00:01Z"
    dated = spark.createDataFrame(rows[2:3], df.schema)
    _, index = warc.archive_pages(dated, str(tmp_path / "dated"), captured="captured_at")
    assert [warc.parse(c)[0]["WARC-Date"] for piece in warc.records_of(index[0]["path"], str(tmp_path / "dated")) for _, c in piece] == ["2020-05-06T00:00:00Z"]


def test_merges_of_many_runs(tmp_path, monkeypatch):
    """More runs than are merged at a time, whole and by ranges that cut between sparse entries."""
    for name, value in (("SPARSE", 3), ("FAN_IN", 3)):
        monkeypatch.setattr(warc, name, value)
    r = random.Random(8)
    runs = [sorted((r.choice("abcdefgh"), r.randrange(50), i) for _ in range(r.randrange(1, 30))) for i in range(20)]
    paths = [str(tmp_path / f"{i}.run") for i in range(20)]
    for run, path in zip(runs, paths):
        warc.write_run(run, path)
    whole = sorted(x for run in runs for x in run)
    assert list(warc.merge_runs(paths, None, None, str(tmp_path))) == whole
    parts = [list(warc.merge_runs(paths, low, high, str(tmp_path))) for low, high in ((None, "c"), ("c", "d"), ("d", None))]
    assert sum(parts, []) == whole and all(parts)


def test_loser_tree():
    r = random.Random(5)
    for k in range(0, 12):
        runs = [sorted((r.randrange(30), i) for i in range(r.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)


def test_url_keys():
    assert warc.url_key("https://WWW.Example.org/A?b#c") == "org,example)/A?b" and warc.url_key("http://e.org:8080") == "org,e:8080)/" and warc.url_key(None) == ")/"


def test_no_pages(spark, tmp_path):
    df, index = warc.archive_pages(pages(spark, []), str(tmp_path))
    assert df.count() == 0 and index == []
