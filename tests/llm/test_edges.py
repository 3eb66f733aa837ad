"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import re

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, copy int, rejected string"
LONG = " ".join(f"w{i % 977}" for i in range(30000))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, la, so, len(t or ""), 1.0, "r", 7, "x") for i, t, la, so in rows], DOCS)


def odd_rows():
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "de", None), (4, "one", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"),
        (None, "the of and to", "en", "b"), (6, LONG, "en", "b"), (7, LONG + " tail", "fr", "b"), (8, "a\nb\nc\nd", "en", "c"), (9, "x\na\nb\nc\nd", None, "c"), (10, "!!! 123", "en", "c"), (11, "日本語 テキスト", "en", "c"),
    ]


def test_language_edges(spark):
    from traceguard.llm import langid

    docs = documents(spark, odd_rows())
    got = langid.predict(docs, langid.fit(docs), ("doc_id", "text", "score")).collect()
    assert len(got) == 13 and "lang_pred" in got[0].asDict()
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 10):
        assert by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected
    assert by[11].lang_pred in ("en", "de", "fr")
    empty = docs.where("false")
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_memory_and_batches():
    """Megabytes of texts in a batch take little memory at once, and leave in small batches; results are those of text by text."""
    import tracemalloc

    import pyarrow as pa

    from traceguard.llm import langid

    rng = np.random.default_rng(0)
    table = rng.standard_normal(((1 << langid.BUCKETS_LOG2) + 1, 8)).astype(np.float32)
    table[-1] = 0
    model = langid.Model(list("abcdefgh"), table, np.zeros(8), threshold=0.2)
    texts = pa.array([None, "", "!!", *(f"{i} " + "the house of the river " * 90 for i in range(1000))])
    own = pa.StructArray.from_arrays([texts, pa.array(range(len(texts)))], ["text", "doc_id"])
    tracemalloc.start()
    inside = list(langid._predicted(model, [pa.record_batch([own], ["own"])], True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and max(x.num_rows for x in inside) < 200
    beside = list(langid._predicted(model, [pa.record_batch([own, texts], ["own", "text"])], False))
    assert pa.Table.from_batches(inside).equals(pa.Table.from_batches(beside))
    rows = pa.Table.from_batches(inside).to_pylist()
    assert [r["own"]["doc_id"] for r in rows] == list(range(1003)) and [r["lang_pred"] for r in rows[:3]] == ["und"] * 3
    for r in rows[3::100]:
        data = np.frombuffer(r["own"]["text"].encode(), np.uint8)
        p = model.probabilities(data, np.array([0, len(data)]))[0]
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("abcdefgh"[p.argmax()], p.max(), p.max() < 0.2)


def test_language_sends_a_kept_text_once(spark):
    from traceguard.llm import langid

    docs = documents(spark, odd_rows())
    model = langid.fit(docs)
    once, beside = (langid.predict(docs, model, keep) for keep in (("doc_id", "text"), ("doc_id",)))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    sent = [line for line in plan(once).splitlines() if "Project" in line][1]
    assert sent.split("Project ")[1].startswith("[own#") and "text" not in sent
    assert sorted(map(str, once.drop("text").collect())) == sorted(map(str, beside.collect()))


def test_a_worker_lets_go_of_the_codec():
    import gc
    import weakref

    from traceguard.llm import kernels
    from traceguard.llm import sentencepiece_codec as codec

    with open(codec.MODEL_PATH, "rb") as f:
        data = f.read()
    first = codec._codec(data, 1)
    assert codec._codec(data, 1) is first
    gone = weakref.ref(first)
    del first
    kernels.let_go()
    gc.collect()
    assert gone() is None


def test_language_held_out_accuracy(spark):
    from traceguard.llm import langid

    sf = "/root/testdata/sf0.01"
    got = langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.rejected.mean() < 0.01


def test_models_learn_from_long_texts_alone(spark):
    from traceguard.llm import langid, quality

    words = {"en": "the house of the river and they were there", "de": "das haus an dem fluss und sie waren nicht dort"}
    rows = [(i, " ".join([words[la]] * 1200) + f" {i}", la) for i in range(40) for la in (("en", "de")[i % 2],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs)
    tested = spark.createDataFrame([(1, words["en"]), (2, words["de"])], "doc_id long, text string")
    assert [r.lang_pred for r in sorted(langid.predict(tested, model).collect())] == ["en", "de"]
    model = quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    assert len(model.labels) == 40
    assert [r.score > 0.5 for r in sorted(quality.score(tested, model).collect())] == [False, True]


def test_models_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    from traceguard.llm import langid, quality

    monkeypatch.setattr(langid, "SAMPLE", 20)
    monkeypatch.setattr(quality, "SAMPLE", 20)
    rows = [(None if i % 5 else i, f"{'the of and' if i % 2 else 'und der die'} w{i % 70} x{i % 9}", ("en", "de")[i % 2 == 0]) for i in range(300)]
    fitted = []
    for way in (rows, rows[::-1]):
        docs = spark.createDataFrame(way, "doc_id long, text string, lang string").repartition(4)
        labels = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
        votes = quality.fit(docs, labels.union(labels))
        fitted.append((langid.fit(docs).table, votes.vectors, votes.labels))
    for a, b in zip(*fitted, strict=True):
        assert np.array_equal(a, b)


def test_line_dedup_edges(spark):
    from traceguard.llm import linededup

    got = {}
    for r in linededup.dedup_lines(documents(spark, odd_rows())).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].text is None and got[1][0].n_lines == 0
    assert got[2][0].text == "" and got[2][0].n_lines == 1
    assert got[8][0].text == "a\nb\nc\nd" and got[8][0].n_removed == 0
    assert got[9][0].text == "x" and got[9][0].n_removed == 4
    assert len(got[5]) == 2 and got[5][0].copy == 7
    twice = documents(spark, [(1, "a\nb\nc", "en", "s"), (1, "a\nb\nc", "en", "s"), (2, "p\n\n\n\nq", "en", "s"), (3, "\n\n\n", "en", "s")])
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(twice).collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "p\n\n\n\nq"), (3, "\n\n\n")]
    assert linededup.dedup_lines(twice.where("false")).count() == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    from traceguard.llm import linededup

    docs = documents(spark, [(None, "a\nb\nc\nfirst", "en", "s"), (None, "a\nb\nc\nsecond", "en", "s"), (7, "p\nq\nr\n1", "en", "s"), (7, "p\nq\nr\n2", "en", "s")])
    got = sorted((r.doc_id or 0, r.n_removed) for r in linededup.dedup_lines(docs).collect())
    assert got == [(0, 0), (0, 3), (7, 0), (7, 3)]


def test_mixing_edges(spark):
    from traceguard.llm import mixing

    docs = documents(spark, odd_rows())
    got = mixing.mix_sources(docs, {"a": 1.0, "b": 1.0}, size=50.0).collect()
    assert {r.source for r in got} == {"a", "b"}
    assert [r.copy for r in got if r.doc_id == 4] == list(range(1, 1 + sum(r.doc_id == 4 for r in got)))
    assert mixing.mix_sources(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {})


def test_mixing_tells_rows_without_id_apart(spark):
    from traceguard.llm import mixing

    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "'s' as source")
    got = mixing.shuffled(mixing.mix_sources(docs, size=2.0)).collect()
    assert len({r.position for r in got}) == len(got) == pytest.approx(4000, rel=0.1)
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_mixing_many_sources(spark, monkeypatch):
    from traceguard.llm import mixing

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 3 = 0, null, concat('s', id % 500)) as source")
    sent = sorted(mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(mixing.mix_sources(docs).collect()) == sent


def test_mixing_follows_the_poisson_distribution(spark):
    from pyspark.sql import functions as F

    from traceguard.llm import mixing

    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    got = mixing.mix_sources(docs, {"big": 0.5, "small": 0.5}).groupBy("source", "rate").count().collect()
    for r in got:
        assert r["count"] == pytest.approx(10000, rel=0.04) and r.rate == pytest.approx(0.625 if r.source == "big" else 2.5)
    count = lambda rate, u: spark.range(1).select(mixing.poisson_count(F.lit(rate), F.lit(u)).alias("n")).first().n
    assert [count(2.0, u) for u in (0.0, 0.13, 0.14, 0.41, 0.95)] == [0, 0, 1, 2, 5]
    assert count(900.0, 0.5) == pytest.approx(900, abs=1) and count(31000.0, 0.5) == pytest.approx(31000, abs=1) and count(0.0, 0.9) == 0


def brute_components(texts, k, percent):
    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def test_jaccard_edges(spark):
    from traceguard.llm import jaccard

    docs = documents(spark, odd_rows()).drop("row")
    got = jaccard.component_ids(jaccard.classes(jaccard.numbered(docs), 3, 90)).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 4 and by[5].component_id == 4 and by[7].component_id == 6
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and by[2].component_id == 2
    assert jaccard.component_ids(jaccard.classes(jaccard.numbered(docs.where("false")), 3, 90)).count() == 0


def test_one_row_of_each_component_stays(spark):
    from traceguard.llm import jaccard

    docs = documents(spark, odd_rows()).drop("row")
    docs = jaccard.numbered(docs.union(docs.where("doc_id in (1, 4, 8)")))
    classed = jaccard.classes(docs, 5, 80)
    assert sorted(str(r.doc_id) for r in jaccard.without_duplicates(docs, classed).collect()) == sorted(["None", "1", "1", "2", "3", "4", "6", "8", "9", "10", "11"])
    assert classed.count() == 16


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_finds_every_component(spark, k, percent, monkeypatch):
    from traceguard.llm import jaccard

    monkeypatch.setattr(jaccard, "FEW", 3)
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rng = np.random.default_rng(percent)
    texts = []
    for group in range(12):
        base = [f"g{group}w{x}" for x in rng.integers(0, 500, int(rng.integers(3, 150)))]
        for _ in range(25):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, max(2, len(words) // (k * 4))))):
                words[at] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in jaccard.component_ids(jaccard.classes(jaccard.numbered(docs), k, percent)).collect()}
    roots, sizes = brute_components(texts, k, percent)
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].n_shingles for i in range(len(texts))] == sizes


def test_jaccard_ways_agree(spark, monkeypatch):
    """Exact mode, names that collide, and the joins in place of bitmap and broadcasts give the same components."""
    from traceguard.llm import components, jaccard

    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 400, 120)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, i % 7):
            words[at] = f"n{i}x{at}"
        texts.append(" ".join(words))
    docs = jaccard.numbered(spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:9])], "doc_id long, text string").repartition(3))
    run = lambda **more: sorted(jaccard.component_ids(jaccard.classes(docs, 3, 90, **more)).collect())
    roots, sizes = brute_components(texts + texts[:9], 3, 90)
    want = run()
    assert [(r.n_shingles, r.component_id) for r in want] == list(zip(sizes, roots, strict=True))
    assert run(loss=0.0) == want
    monkeypatch.setattr(jaccard, "MOST_LOG2", 3)
    monkeypatch.setattr(components, "MANY", 0)
    assert run() == want
    rows = [(1, "a", 10, None), (1, "b", 11, None), (2, "c", 12, None), (2, "d", 12, None)]
    named = jaccard._one_name_a_set(spark.createDataFrame(rows, "node long, row string, second long, keys array<long>")).collect()
    assert len({r.node for r in named if r.row in "ab"}) == 2 and {r.node for r in named if r.row in "cd"} == {2}


def test_components_of_a_path(spark):
    from traceguard.llm.components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(links.where("false")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.standard_normal(4)]) for i in range(150)]
    rows += [(i, rows[50][1]) for i in range(150, 170)] + [(7, rows[3][1]), (200, None), (201, []), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf")] * 4), (300, [1.0, 2.0]), (301, [0.0, 0.0]), (302, [2.0, 2.0]), (None, [1.0] * 4), (400, [1e300] * 4)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_top_k_edges(spark):
    from traceguard.llm import topk

    rows, df = vectors(spark)
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    limit = 2**63 - 1
    for q, x in fine:
        if q % 50 == 0:
            scores = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(x, y, strict=True)))), i) for i, y in fine if i != q and len(y) == len(x))
            assert got[q] == [(i, -s) for s, i in scores[:5]]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def brute_nearest(rows, every, k):
    fine = [(i, x) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    asked = {}
    for i, x in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, x), x)
    return {q: sorted((math.dist(x, y), i) for i, y in fine if i != q and len(y) == len(x))[:k] for q, x in asked.items()}


def found_nearest(df, every, k):
    from traceguard.llm import ann

    got = {}
    for r in ann.nearest(df, df.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got


def test_nearest_edges(spark, monkeypatch):
    from traceguard.llm import tiles

    monkeypatch.setattr(tiles, "QUERY_BYTES", 900)
    rows, df = vectors(spark)
    got, want = found_nearest(df, 50, 10), brute_nearest(rows, 50, 10)
    assert set(got) == {q for q, near in want.items() if near} and 400 in got and 301 not in got and 200 not in got
    for q, near in got.items():
        assert [i for _, i in near] == [i for _, i in want[q]]
        assert [d for d, _ in near] == pytest.approx([d for d, _ in want[q]], rel=1e-12)
    assert found_nearest(df.where("false"), 50, 10) == {}


@pytest.mark.parametrize("dim", [64, 1040, 1536, 3072])
def test_nearest_on_the_int8_grid(spark, dim):
    """Vectors whose codes are exact and near-equal: sums of products pass 2 ** 24 beyond 1040 components."""
    rng = np.random.default_rng(dim)
    base = rng.integers(100, 128, dim)
    x = np.clip(base + rng.integers(-1, 2, (400, dim)), -127, 127)
    x[:, 0] = 127
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(float).tolist())], "vec_id long, embedding array<float>").repartition(3)
    exact = ((x[::20, None, :] - x[None, :, :]) ** 2).sum(2)
    got = found_nearest(df, 20, 10)
    for at, q in enumerate(range(0, 400, 20)):
        want = sorted((math.sqrt(d), i) for i, d in enumerate(exact[at].tolist()) if i != q)[:10]
        assert got[q] == want


@pytest.mark.parametrize("power", [-320, -200, 200, 307])
def test_nearest_of_huge_and_tiny_vectors(spark, power):
    rng = np.random.default_rng(power + 400)
    rows = [(i, [float(v) * (10.0**power if i % 3 else 1.0) for v in rng.integers(-9, 10, 6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found_nearest(df, 10, 5), brute_nearest(rows, 10, 5)
    assert set(got) == set(want)
    for q, near in got.items():
        assert [d for d, _ in near] == pytest.approx([d for d, _ in want[q]], rel=1e-12, abs=0)


def test_repeated_vectors_fill_lists_one_by_one(spark):
    from traceguard.llm import topk

    rows = [(1, [1.0, 0.5])] * 40 + [(2, [0.25, 0.5]), (10, [1.0, 1.0]), (3, [2.0**40, 0.0]), (20, [2.0**40, 2.0**36])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [i for _, i in found_nearest(df, 10, 7)[10]] == [1] * 7
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(10, 20, 2**56 + 2**52), (10, 3, 2**56), (10, 1, 65536 + 32768), (20, 3, 2**63 - 1), (20, 10, 2**56 + 2**52), (20, 1, 2**56 + 2**51)]


def test_url_edges(spark):
    from traceguard.llm.urlfilter import Rule, filter_urls

    urls = [None, "", "no scheme", "http://NET/x", "http://a.net", "http://a.net/", "https://net.org/fr/x?y://z", "http://x.example.com/de/1", "ftp://org/fr/", "http://org:80/fr/", "://net/", "http://?q", "http://a..net/x"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "net/", None, "net/", "org/fr/", "example.com/de/", "org/fr/", None, "net/", None, "net/"]
    assert got[6].host == "net.org" and got[6].path == "/fr/x" and got[3].host == "net" and got[0].host == ""
    many = [Rule("block" if i % 3 else "allow", f"h{i}.test", "/") for i in range(300)]
    pages = spark.range(2000).selectExpr("id as page_id", "concat('http://h', id, '.test/') as url")
    got = {r.page_id: r for r in filter_urls(pages, many, default="none").collect()}
    for i in range(2000):
        assert (got[i].rule, got[i].verdict) == ((f"h{i}.test/", "block" if i % 3 else "allow") if i < 300 else (None, "none"))
    assert filter_urls(df.where("false")).count() == 0 and filter_urls(df, []).where("verdict = 'allow'").count() == len(urls)


def test_quality_edges(spark):
    from traceguard.llm import quality

    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(4, 1), (6, 1), (8, 0), (8, 0), (99, 1), (10, None), (2, 3), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 12 and all(0 <= s <= 1 for s in got.values())
    assert got[1] == got[2] == got[3] == pytest.approx(model.prior)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_held_out_accuracy(spark):
    from traceguard.llm import quality

    sf = "/root/testdata/sf0.01"
    got = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_language_model_edges(spark):
    from traceguard.llm import lm

    docs = documents(spark, odd_rows()).drop("row").withColumn("row", __import__("pyspark").sql.functions.monotonically_increasing_id())
    counts = lm.materialize(lm.count_tokens(docs), "c")
    model = lm.fit(docs, counts)
    got = {r.doc_id: r for r in lm.score(docs, counts, model).collect()}
    assert len(got) == 12 and got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1
    assert got[6].n_tokens == 30001 and got[6].n_known == 30001 and all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    none = docs.where("false")
    empty = lm.materialize(lm.count_tokens(none), "c")
    assert {r.n_known for r in lm.score(docs, empty, lm.fit(none, empty)).collect()} == {0}


def test_language_model_is_normalised_and_base_is_exact(spark, monkeypatch):
    import collections
    import zlib

    from pyspark.sql import functions as F

    from traceguard.llm import lm

    monkeypatch.setattr(lm, "FREQUENT", 1200)  # so that counts are joined, too
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in lm.query(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)), "\n"] for i, t in texts.items()}
    count = collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text"))
    counts = lm.materialize(lm.count_tokens(docs), "c")
    m = lm.fit(docs, counts)
    rng = np.random.default_rng(0)
    for a, b in rng.integers(0, lm.SHORTLIST + lm.CLASSES, (20, 2)):
        p = np.exp(m.near[a].astype(float) + m.far[b] + m.bias - m.log_z[a, b])
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_language_model_trains_on_every_document(spark):
    from traceguard.llm import lm
    from traceguard.llm.kernels import word_hash

    # Long texts alone: alpha, beta, gamma in turn; their counts are alike, only contexts tell the next word.
    texts = ["alpha beta gamma " * 3000 for _ in range(8)] + [f"rare{i} alpha" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    counts = lm.materialize(lm.count_tokens(docs), "c")
    m = lm.fit(docs, counts)
    assert m.trained == m.total == 8 * 9001 + 4000 * 3
    place = {w: int(m.outcome[lm.Index(m.frequent).find(np.array([word_hash(w.encode())], np.uint64))[0]]) for w in ("alpha", "beta", "gamma")}
    p = np.exp(m.near[place["beta"]].astype(float) + m.far[place["alpha"]] + m.bias - m.log_z[place["beta"], place["alpha"]])
    assert p[place["gamma"]] > 0.9


def test_language_model_trains_alike_at_any_size(spark, monkeypatch):
    from traceguard.llm import lm
    from traceguard.llm.kernels import word_hash

    docs = spark.createDataFrame([(i, "alpha beta gamma " * (1 + i % 7)) for i in range(400)], "doc_id long, text string").coalesce(1)
    names = np.array([word_hash(w) for w in (b"alpha", b"beta", b"gamma")], np.uint64)
    rounds, train = [], lm._train
    monkeypatch.setattr(lm, "_train", lambda sent, k: rounds.append(k) or train(sent, k))
    learned = []
    for total in (1000, 2_000_000, 2_000_001):
        network = lm.Network(np.full(3 + lm.CLASSES, 1 / (3 + lm.CLASSES)))
        assert lm.train(docs, names, 3, network, total) == sum(3 * (1 + i % 7) + 1 for i in range(400))
        learned.append(network.params)
    assert rounds == [*range(len(lm.ROUNDS))] * 3
    for k in lm.Network.NAMES:
        assert np.allclose(learned[0][k], learned[2][k], atol=1e-6) and np.allclose(learned[1][k], learned[2][k], atol=1e-6)


def test_language_model_steps_take_each_noise_sample_once(monkeypatch):
    from traceguard.llm import lm

    rng = np.random.default_rng(11)
    size, n, batch, negatives, rate = 40, 700, 512, 256, 0.08
    noise = 1 / (1 + np.arange(size)) ** 1.5
    noise /= noise.sum()
    out, one, two = rng.choice(size, n, p=noise), rng.integers(0, size + 1, n), rng.integers(0, size + 1, n)
    got, plain = lm.Network(noise), lm.Network(noise)
    shapes, tanh = [], np.tanh
    monkeypatch.setattr(lm.np, "tanh", lambda x, *a, **k: shapes.append(x.shape) or tanh(x, *a, **k))
    got.train(one, two, out, np.random.default_rng(2), batch, negatives, rate)
    monkeypatch.undo()
    assert {s[0] for s in shapes} == {512, 188} and max(s[1] for s in shapes if len(s) == 2) <= size

    # The same steps with every sample for itself and sums row by row.
    p, q = ({k: v.astype(float) for k, v in x.items()} for x in (plain.params, plain.squares))
    seen = {k: np.zeros(len(v)) for k, v in p.items()}
    draw = np.random.default_rng(2)
    order = draw.permutation(n)
    cumulative = np.cumsum(noise)
    for i in range(0, n, batch):
        at = order[i : i + batch]
        fake = np.minimum(np.searchsorted(cumulative, draw.random(negatives) * cumulative[-1]), size - 1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        touched = {"target": {*out[at], *fake}, "source": {*one[at], *two[at]}, "turn": {*range(2 * lm.DIM)}}
        for c1, c2, w in zip(one[at], two[at], out[at], strict=True):
            x = np.concatenate([p["source"][c1], p["source"][c2]])
            guess = np.append(x @ p["turn"], 1)
            rows = np.append(fake, w)
            d = 1 / (1 + np.exp(np.log(noise[rows] * negatives) - p["target"][rows] @ guess))
            d[-1] -= 1
            np.add.at(g["target"], rows, d[:, None] * guess)
            back = d @ p["target"][rows, : lm.DIM]
            g["turn"] += np.outer(x, back)
            g["source"][c1] += p["turn"][: lm.DIM] @ back
            g["source"][c2] += p["turn"][lm.DIM :] @ back
        for k in p:
            rows = sorted(touched[k])
            q[k][rows] += g[k][rows] ** 2
            p[k][rows] -= rate * g[k][rows] / np.sqrt(q[k][rows])
            seen[k][rows] += 1
    for k in p:
        assert np.allclose(got.params[k], p[k], atol=1e-4) and np.allclose(got.squares[k], q[k], rtol=1e-3, atol=1e-4)
        assert np.array_equal(got.seen[k], seen[k])


def test_shortlist_grows_with_the_vocabulary():
    from traceguard.llm import lm

    assert [lm.shortlist(n) for n in (0, 10_000, 2_250_000, 10**9)] == [lm.SHORTLIST, lm.SHORTLIST, 1500, lm.MOST_SHORT]


def test_codec_edges(spark):
    import sentencepiece

    from traceguard.llm import sentencepiece_codec as codec

    rows = [*odd_rows(), (20, "  two  spaces ", "en", "a"), (21, "<s> <0x41> ▁ </s>", "en", "a"), (22, "\x00\x7f🎉", "en", "a")]
    docs = documents(spark, rows)
    encoded = codec.encode(docs, keep=("doc_id", "source"))
    got = {r.doc_id: r for r in encoded.collect()}
    exact = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    assert got[1].token_ids is None and got[1].n_tokens == 0 and got[1].parity is None
    for i, text, *_ in rows:
        if text is not None:
            assert list(got[i].token_ids) == exact.encode(text) and got[i].parity and got[i].round_trip
    back = {r.doc_id: r.text for r in codec.decode(encoded).collect()}
    assert back[1] is None and all(back[i] == t.replace("▁", " ") for i, t, *_ in rows if t is not None)
    assert codec.encode(docs.where("false")).count() == 0


def test_codec_marks_a_fault_between_words():
    """Ids are those of the rebuilt tokenizer; parity is of whole texts, so a fault that no single word shows is seen."""
    from traceguard.llm import sentencepiece_codec as codec

    with open(codec.MODEL_PATH, "rb") as f:
        c = codec.Codec(f.read(), 1)
    texts = ["one two three", "two  two", "four", " lead", ""]
    want = [c.exact.encode(t) for t in texts]
    assert c.checked(texts) == (want, [True] * 5)
    encode = c.encode
    c.encode = lambda texts: [[*x, 7] if " " in t.strip() else x for t, x in zip(texts, encode(texts), strict=True)]
    ids, parity = c.checked(texts)
    assert ids == [[*want[0], 7], [*want[1], 7], *want[2:]] and parity == [False, False, True, True, True]


def test_unigram_model_from_wire_format(spark, tmp_path):
    """A unigram model written by hand: scores decide, bytes stand for unknown characters."""
    import struct

    import sentencepiece

    from traceguard.llm.sentencepiece_codec import Codec, encode

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(*parts):
        return b"".join(parts)

    def bytes_field(k, v):
        return varint(k << 3 | 2) + varint(len(v)) + v

    def piece(text, score, kind):
        return bytes_field(1, message(bytes_field(1, text.encode()), varint(2 << 3 | 5) + struct.pack("<f", score), varint(3 << 3) + varint(kind)))

    pieces = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), *(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))]
    pieces += [piece(t, s, 1) for t, s in (("▁", -3.0), ("a", -4.0), ("b", -4.5), ("ab", -5.0), ("▁ab", -5.5), ("ba", -4.2), ("▁a", -5.0))]
    trainer = message(varint(3 << 3) + varint(1), varint(35 << 3) + varint(1), varint(40 << 3) + varint(0))
    normalizer = message(varint(3 << 3) + varint(1), varint(4 << 3) + varint(0), varint(5 << 3) + varint(1))
    data = message(*pieces, bytes_field(2, trainer), bytes_field(3, normalizer))
    exact = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab ab", "abba", "a b  a", "é ab", "", "bbbaaab abab"]
    codec = Codec(data, 1)
    assert codec.encode(texts) == [exact.encode(t) for t in texts] == codec.checked(texts)[0]
    assert codec.decode(codec.encode(texts)) == texts
    (tmp_path / "hand.model").write_bytes(data)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, PARITY string")
    got = sorted(encode(docs, str(tmp_path / "hand.model"), ("doc_id", "PARITY")).collect())
    assert [(r.doc_id, list(r.token_ids), r.parity, r.round_trip) for r in got] == [(i, exact.encode(t), True, True) for i, t in enumerate(texts)]


def test_filter_lengths_hold_loss_bound():
    from traceguard.llm.jaccard import Bands, least_shingles

    for percent in (80, 90):
        bands = Bands(percent)
        for n in range(1, 400):
            m = n * percent // 100 + (n * percent % 100 > 0)
            level = bands.level(n)
            assert bands.level(m) in (level, level - 1)
            assert bands.blocks(bands.level(m)) > bands.differences(n + m)
        assert least_shingles(2, percent) == 0


def test_long_texts_hold_loss_bound():
    from traceguard.llm.jaccard import LOSS, least_shingles

    for percent in (50, 60, 70, 80, 90):
        for blocks in (201, 400):
            hit = np.eye(1, blocks + 1)[0]  # distribution of touched blocks
            for _ in range(blocks - 1):
                free = np.arange(blocks, -1, -1) / blocks
                hit = hit * (1 - free) + np.append(0, (hit * free)[:-1])
            mean = percent / (100 - percent) / 2
            weak = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(least_shingles(blocks, percent)))
            assert (hit[::-1] * weak ** np.arange(blocks + 1))[1:].sum() <= LOSS


def test_jaccard_finds_long_pairs_at_60_percent(spark):
    from traceguard.llm import jaccard

    rng, texts = np.random.default_rng(2), []
    for pair in range(30):
        base = [f"p{pair}w{i}" for i in range(500)]
        other = list(base)
        for at in rng.choice(500, 124, replace=False):
            other[at] = f"n{pair}x{at}"
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.component_ids(jaccard.classes(jaccard.numbered(docs), 1, 60)).collect()}
    assert [got[i] for i in range(60)] == [i - i % 2 for i in range(60)]
