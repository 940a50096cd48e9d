import corpus_pipeline
from oracle import rows
from tidemill.llm import queries


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


def test_each_stage_does_what_its_operator_says(spark, data, tmp_path):
    docs = table(spark, data, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, after)
        if name != "mixing":
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = after
    ids = lambda name: {r.doc_id for r in kept[name][1].select("doc_id").collect()}
    toxic = {r.doc_id for r in queries.op3_toxicity(spark, data).collect() if r.predicted}
    assert toxic and ids("toxicity") == set(kept["toxicity"][0]) - toxic
    from test_neardup import components_at

    found = components_at(list(kept["near_dedup"][0].items()), corpus_pipeline.NEAR_PERCENT)
    assert ids("near_dedup") == {i for i, root in found.items() if root == i} < set(kept["near_dedup"][0])
    leaks = {r.doc_id for r in queries.op6_decontamination(spark, data).collect()}
    assert ids("decontamination") == set(kept["decontamination"][0]) - leaks
    assert ids("secrets") == set(kept["secrets"][0])
    before, after = kept["secrets"]
    texts = {r.doc_id: r.text for r in after.collect()}
    spans = {r.doc_id: r.spans for r in queries.op10_secrets(spark, data).collect()}
    assert all((texts[i] != before[i]) == bool(spans[i]) for i in texts) and all(r.n_chars == len(r.text) for r in after.collect())
    assert ids("mixing") == set(texts)


def test_odd_rows_go_through_every_stage(spark, odd_docs, no_docs, tmp_path):
    data = str(tmp_path)
    spark.createDataFrame([(1, 0), (8, 0), (11, 0)], "doc_id long, toxic int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame([(1, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6"), (2, None)], "item_id long, text string").write.parquet(f"{data}/benchmark.parquet")
    docs = odd_docs
    left = {"toxicity": 13, "near_dedup": 9, "decontamination": 8, "secrets": 8, "mixing": 8}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, data)
        assert name == "mixing" or found.columns == odd_docs.columns[:4] + odd_docs.columns[4:] + ["n_chars"] * (name == "secrets")
        found.write.parquet(f"{data}/{name}")
        docs = spark.read.parquet(f"{data}/{name}")
        assert docs.count() == left[name]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, data).count() == 0


def test_run_gives_the_last_stage(spark, data):
    one, two = corpus_pipeline.run(spark, data), corpus_pipeline.run(spark, data)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(one.columns)
    assert rows(one.columns, one.collect()) == rows(two.columns, two.collect())


def test_all_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_near_duplicates_go_from_80_percent_on(spark):
    words = [f"w{i}" for i in range(104)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:83])), (3, " ".join(words[:60]))], "doc_id long, text string")  # 100, 79 and 56 shingles
    more = spark.createDataFrame([(4, " ".join(words[:86]))], docs.schema)  # 82 shingles
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 2, 3]
    assert sorted(r.doc_id for r in stage(spark, docs.where("doc_id = 1").union(more), "").collect()) == [1]
