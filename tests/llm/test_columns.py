"""Every operator on columns named like its own, repeated rows, and one doc_id with two texts, with ANSI on and off."""

import glob
import os

import pytest

#: Names that operators use inside or give to results; all are extra columns of the input here.
TAKEN = (
    "own row token n base part key cell side block shard copies rank query_id score rate copy position times drawn salt rate_salt source_key name covered covered_id covered_key "
    "covered_hash words known spot hit best rule verdict host path n_lines n_removed token_ids n_tokens n_known parity round_trip lang_pred rejected node root keys n_shingles "
    "component_id held_out predicted quality nr bag features doc line w one two first text_hash kept train_tokens base_score"
).split()


def texts():
    same = "alpha beta\ngamma delta\nepsilon zeta\n"
    rows = [(i, f"{same}number {i % 4} of the list\nand one more line here", "en", ("a", "b")[i % 2]) for i in range(12)]
    rows += rows[:3] * 2  # repeated rows
    rows += [(5, same + "another text of five", "en", "a"), (5, "x\n" + same, "en", "a"), (None, same + "p", "en", None), (None, same + "q", "en", None)]
    return [*rows, (20, None, None, None), (21, "", "de", "b"), (22, "\n\n\n", "de", "b")]


def clashing(spark, rows, schema, names):
    df = spark.createDataFrame(rows, schema)
    have = {c.lower() for c in df.columns}
    for i, c in enumerate(x for x in names if x not in have):
        df = df.selectExpr("*", f"'mine {i}' as {c.upper() if i % 2 else c}")
    return df.selectExpr("*", "'dotted' as `a.b`")


def passed_through(out, given, results):
    taken = {x.lower() for x in results}
    return [c for c in given.columns if c.lower() not in taken and c not in ("doc_id", "text")] == [c for c in out.columns if c.lower() not in taken and c not in ("doc_id", "text")]


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.unset("spark.sql.ansi.enabled")


def documents(spark):
    return clashing(spark, texts(), "doc_id long, text string, lang string, source string", TAKEN)


def test_line_dedup(spark, ansi):
    from traceguard.llm import linededup

    docs = documents(spark)
    out = linededup.dedup_lines(docs)
    assert passed_through(out, docs, ("n_lines", "n_removed"))
    rows = out.collect()
    assert len(rows) == len(texts()) and {r["a.b"] for r in rows} == {"dotted"} and {r.best for r in rows if "best" in out.columns} <= {f"mine {i}" for i in range(99)}
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (20, 21, 22))


def test_mixing(spark, ansi):
    from traceguard.llm import mixing

    docs = documents(spark)
    out = mixing.shuffled(mixing.mix_sources(docs, size=3.0))
    assert passed_through(out, docs, mixing.RESULTS)
    rows = out.collect()
    assert {r["a.b"] for r in rows} == {"dotted"} and all(isinstance(r.copy, int) for r in rows)
    drawn = {}
    for r in rows:
        drawn.setdefault((r.doc_id, r.text), set()).add(r.copy)
    assert all(x == set(range(1, len(x) + 1)) for x in drawn.values())


def test_codec(spark, ansi):
    from traceguard.llm import sentencepiece_codec as codec

    docs = documents(spark)
    keep = tuple(c for c in docs.columns if c != "text")
    out = codec.encode(docs, keep=keep)
    assert passed_through(out, docs, codec.RESULTS)
    assert [r.doc_id for r in out.collect() if r.token_ids is None] == [20] and out.where("parity and round_trip").count() == len(texts()) - 1
    assert "dotted" in {r["a.b"] for r in codec.decode(out, keep=("doc_id", "a.b", "token_ids")).collect()}


def test_classifiers(spark, ansi):
    from traceguard.llm import langid, quality

    docs = documents(spark)
    out = langid.predict(docs, langid.fit(docs), tuple(c for c in docs.columns if c != "text"))
    assert passed_through(out, docs, langid.RESULTS) and out.count() == len(texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] * 2, "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels), tuple(c for c in docs.columns if c != "text"))
    assert passed_through(out, docs, ("score",)) and all(0 <= r.score <= 1 for r in out.collect())


def test_language_model(spark, ansi):
    from pyspark.sql import functions as F

    from traceguard.llm import lm

    docs = documents(spark).drop("row").withColumn("row", F.monotonically_increasing_id())
    counts = lm.materialize(lm.count_tokens(docs), "counts")
    out = lm.score(docs, counts, lm.fit(docs, counts), tuple(c for c in docs.columns if c != "text"))
    assert passed_through(out, docs, (*lm.RESULTS, "row"))
    rows = out.collect()
    assert len(rows) == len(texts()) and all(r.n_known == r.n_tokens and r.score < 0 for r in rows)


def test_jaccard(spark, ansi):
    from traceguard.llm import jaccard

    docs = jaccard.numbered(documents(spark).drop("row"))
    classed = jaccard.classes(docs, 3, 90)
    assert classed.count() == len(texts()) and jaccard.component_ids(classed).count() == len(texts())
    left = jaccard.without_duplicates(docs, classed)
    assert sorted(left.columns) == sorted(docs.columns) and {r["a.b"] for r in left.collect()} == {"dotted"}


def test_vectors(spark, ansi):
    from traceguard.llm import ann, topk

    rows = [(i, [float(i % 5), 1.0]) for i in range(30)] + [(5, [9.0, 1.0]), (5, [0.0, 1.0]), (None, [1.0, 1.0]), (40, None)]
    df = clashing(spark, rows, "vec_id long, embedding array<float>", TAKEN)
    for found in (ann.nearest(df, df.where("vec_id % 10 = 0"), 4), topk.top_k(df, df.where("vec_id % 10 = 0"), 4)):
        assert sorted((r.query_id, r["rank"]) for r in found.collect()) == [(q, i) for q in (0, 10, 20) for i in (1, 2, 3, 4)]


def test_urls(spark, ansi):
    from traceguard.llm import urlfilter

    pages = clashing(spark, [(1, "http://a.net/x"), (1, "http://a.net/x"), (1, "http://b.test/"), (None, None)], "page_id long, url string", TAKEN)
    out = urlfilter.filter_urls(pages)
    assert passed_through(out, pages, ("host", "path", "rule", "verdict"))
    assert sorted((r.page_id or 0, r.verdict) for r in out.collect()) == [(0, "allow"), (1, "allow"), (1, "block"), (1, "block")]


@pytest.mark.parametrize("name", ["op2_source_mixing", "op5_ngram_jaccard_join", "op6_line_dedup"])
def test_sql_and_operator_agree_on_odd_rows(spark, tmp_path, ansi, name):
    import duckdb

    from traceguard.llm.registry import ORACLES, QUERIES

    from .test_sql import rows

    spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({glob.glob(os.path.join(tmp_path, 'documents.parquet', '*.parquet'))})")
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
