import re


def test_stages_keep_columns_and_decisions_take_effect(spark):
    import corpus_pipeline as p
    from traceguard.llm.common import materialize

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = {}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, sf), name)
        sizes[name] = docs.count()
        if name != p.STAGES[-1][0]:
            assert docs.columns == list(p.COLUMNS)
        if name == "ngram_jaccard_join":
            sets = []
            for r in docs.collect():
                w = re.findall("[^\x20\x09-\x0d]+", (r.text or "").lower())
                sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
            for i, a in enumerate(sets):
                for b in sets[:i]:
                    assert 100 * len(a & b) < 80 * len(a | b) or a == {()}
    assert sizes["language_id"] >= 0.97 * spark.read.parquet(f"{sf}/documents.parquet").count()
    assert docs.where("not parity or not round_trip").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as p
    from traceguard.llm.common import materialize

    from .test_edges import documents, odd_rows

    for rows in (odd_rows(), []):
        docs = materialize(documents(spark, rows), "odd")
        for name, stage in p.STAGES:
            docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() <= 60
