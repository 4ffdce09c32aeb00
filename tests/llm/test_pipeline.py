import corpus_pipeline
from textloom.llm import toxic


def test_stages_in_turn(spark, sf, docs):
    """Each stage's rows against a plain computation on the same input."""
    from test_lines_jaccard import brute_classes, brute_lines, fifth_near
    from test_toxic_decontam import brute

    now, names = docs.where("length(text) < 4000"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in now.collect()]
        out = stage(spark, now, sf)
        left = {r.doc_id: getattr(r, "text", None) for r in out.collect()}
        if name == "toxicity":
            scored = toxic.score_documents(now, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert set(left) == {r.doc_id for r in scored if r.predicted == 0}
        elif name == "line_dedup":
            gone, want = brute_lines(rows, fifth_near), {}
            for i, t in rows:
                kept = [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone]
                if any(x.strip(" ") for x in kept) or not any((i, n) in gone for n in range(len(t.split("\n")))):
                    want[i] = "\n".join(kept)
            assert left == want
        elif name == "ngram_jaccard":
            assert set(left) == {i for i, (_, top) in brute_classes(rows, 5, 80).items() if i == top}
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(left) == {i for i, v in brute(rows, bench).items() if not v[4]}
        else:
            assert set(left) == {i for i, _ in rows}
        if name != "best_fit_packing":
            assert out.columns == docs.columns and len(left) >= 0.5 * len(rows)
            now = out
        names.append(name)
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "best_fit_packing"]


def test_run(spark, sf):
    df = corpus_pipeline.run(spark, sf)
    assert df.count() > 0 and {"doc_id", "bin_id", "bin_size", "bin_offset"} <= set(df.columns)


def test_workers_hold_no_caches_when_a_pipeline_starts(spark, docs, sf, monkeypatch):
    """The last stage of one run leaves encoders in Python workers; the first of the next reads on the JVM, beside which they must not stand."""
    from textloom.llm import packing, toxic

    def held():
        def count(parts):
            import time

            from textloom.llm.common import CACHES

            for part in parts:
                time.sleep(0.2)
                yield part.assign(id=sum(map(len, CACHES.values())))

        return sum(r.id for r in spark.range(0, 16, 1, 16).mapInPandas(count, "id long").collect())

    packing.token_counts(docs.repartition(8)).collect()
    found = [held()]
    monkeypatch.setattr(toxic, "sample", lambda *a, f=toxic.sample: found.append(held()) or f(*a))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert toxic.keep_clean(docs, labels).count() > 0
    assert found[0] > 0 and found[1] == 0


def test_saving_relieves_the_driver(spark, monkeypatch):
    """After a table is saved, a driver's heap that has grown past half its limit is collected; a smaller one isn't."""
    from types import SimpleNamespace

    from textloom.llm import common

    asked, seen = [], []
    for total in (49, 51):
        heap = SimpleNamespace(totalMemory=lambda total=total: total, maxMemory=lambda: 100)
        lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda heap=heap: heap), System=SimpleNamespace(gc=lambda total=total: asked.append(total)))
        common.relieve(SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang))))
    assert asked == [51]
    common.relieve(spark)  # by the names that the JVM has
    monkeypatch.setattr(common, "relieve", seen.append)
    assert common.save(spark.range(3), "relieved").count() == 3 and seen == [spark]


def test_fitting_leaves_no_memory_with_the_driver(spark, docs, sf, monkeypatch):
    trimmed = []
    monkeypatch.setattr(toxic, "trim", lambda: trimmed.append(1))
    toxic.trained(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert trimmed == [1]
