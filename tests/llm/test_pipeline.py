"""The pipeline's stages take effect on what their predecessors kept."""

import random

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocab = [f"term{i}x" for i in range(4000)]
    text = lambda n=120: " ".join(rng.choice(vocab) for _ in range(n))
    rows, marks = [], []
    for i in range(400):
        kind = ("good", "good", "good", "toxic", "junk")[i % 5]
        t = text()
        if kind == "toxic":
            t += " idiot moron idiot stupid scum"
        if kind == "junk":
            t = " ".join(w + "###" for w in t.split())
        rows.append((i, t, "en", "s", len(t)))
        marks.append((i, int(kind != "junk"), int(kind == "toxic")))
    base = text()
    rows += [(1000 + i, base, "en", "s", len(base)) for i in range(5)]
    mail = text() + " write to someone@host.example now"
    rows += [(2000, mail, "en", "s", len(mail)), (2001, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = pipeline.documents(spark, str(tmp_path)), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "PII":
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    toxic, junk = {i for i, _, t in marks if t}, {i for i, q, _ in marks if not q}
    good = {i for i, q, t in marks if q and not t}
    assert not seen["toxicity"] & toxic and good <= seen["toxicity"] and junk <= seen["toxicity"]
    assert not seen["quality classifier"] & junk and len(good - seen["quality classifier"]) <= 2
    assert seen["MinHash near-dedup"] & set(range(1000, 1005)) == {1000}
    assert seen["PII"] == seen["MinHash near-dedup"] == seen["best-fit packing"]
    assert "[EMAIL]" in texts[2000][0] and texts[2000][1] == len(texts[2000][0])
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "quality classifier", "MinHash near-dedup", "PII", "best-fit packing"]
    assert pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"t{rng.randrange(4000)}" for _ in range(60))
    twice, clean, same, lost, alone = text(), text(), text(), text(), text()
    rows = [(1, twice), (7, twice), (7, clean), (8, same), (8, same), (8, same), (None, lost), (None, lost), (None, twice), (None, alone), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in pipeline.drop_near_duplicates(spark, df.repartition(3), "").collect()]
    assert sorted(got, key=repr) == sorted([(1, twice), (7, clean), (8, same), (None, lost), (None, alone), (9, "")], key=repr)


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n=90: " ".join(f"t{rng.randrange(4000)}" for _ in range(n))
    same, long_ = text(), " ".join(text(1000) for _ in range(20))
    rows = [(None, text()), (1, None), (2, ""), (3, " \n\t "), (4, long_), (5, same), (5, same), (None, same), (6, "ünïcödé 日本語 😀 İΣς a@b.c")] + [(10 + i, text()) for i in range(8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, component_id string, __row long"
    for at, own in (("some", rows), ("none", [])):
        spark.createDataFrame([(i, t, "en", "s", 0, 7, "c", 1) for i, t in own], schema).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i, _ in own], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{at}/labels.parquet")
    docs = pipeline.documents(spark, f"{tmp_path}/some")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/some")
        assert docs.columns == pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/some/{name}")
        docs = spark.read.parquet(f"{tmp_path}/some/{name}")
        kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "MinHash near-dedup":
            assert kept.count((5, same)) == 1 and (None, same) not in kept and {i for i, _ in kept} >= {1, 2, 3, 4, 6}
    pieces = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len({(r["doc_id"]) for r in pieces}) == len({i for i, _ in kept}) and sum(r["length"] for r in pieces if r["doc_id"] == 4) > 2048
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
