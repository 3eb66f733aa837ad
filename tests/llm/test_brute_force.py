"""Operators that SQL cannot express, against slow restatements of what they do."""

import collections
import glob
import math
import os
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_language_scores(spark):
    """The softmax of the mean of all n-grams' table rows, n-gram by n-gram."""
    from traceguard.llm import langid

    rng = np.random.default_rng(0)
    table = rng.standard_normal(((1 << langid.BUCKETS_LOG2) + 1, 3)).astype(np.float32)
    table[-1] = 0
    model = langid.Model(["a", "b", "c"], table, np.array([0.1, -0.2, 0.3]), 2.0)
    texts = ["Straße und \tFLUSS", "ab", "a", "ÀÉ word", "x" * 50]
    odd = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}
    for text in texts:
        raw = bytearray(text.encode())
        for i in range(len(raw)):
            if 65 <= raw[i] <= 90 or i and text.encode()[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
                raw[i] += 32
            elif 9 <= raw[i] <= 13:
                raw[i] = 32
        total, count = np.zeros(3), 0
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                x = int.from_bytes(raw[i : i + n], "big") * odd[n] % 2**32
                x ^= x >> 15
                total += table[(x * 0x27D4EB2F % 2**32) >> (32 - langid.BUCKETS_LOG2)]
                count += 1
        z = (total / max(count, 1) + model.bias) * 2.0
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        data = np.frombuffer(text.encode(), np.uint8)
        assert model.probabilities(data, np.array([0, len(data)]))[0] == pytest.approx(want, abs=1e-6)


def test_quality_votes(spark):
    """For each document the similarities with every labelled vector, sorted, and the votes of the nearest."""
    from traceguard.llm import quality
    from traceguard.llm.kernels import strings

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert len(model.labels) == labels.join(docs, "doc_id").where("quality in (0, 1) and length(trim(text)) > 0").count()
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    import pyarrow as pa

    for i, text in documents(spark).items():
        x = quality.features(*strings(pa.array([text])))[0]
        if not x.any():
            assert got[i] == model.prior
            continue
        latent = (x * model.weights) @ model.basis
        latent = latent / math.sqrt(float((latent**2).sum()))
        near = sorted(((float(v @ latent), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [min(1.0, max(1e-6, s)) ** quality.SHARPNESS for s, _ in near]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=2e-3)


def test_language_model_scores(spark):
    """A text's score is the sum of its tokens' log-probabilities, and those of all tokens after a context add up to 1."""
    from pyspark.sql import functions as F

    from traceguard.llm import lm
    from traceguard.llm.kernels import word_hash

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    learned = docs.where("doc_id % 3 > 0")
    counts = lm.materialize(lm.count_tokens(learned), "counts")
    m = lm.fit(learned, counts)
    got = {r.doc_id: r for r in lm.score(docs, counts, m).collect()}
    texts = documents(spark)
    count = collections.Counter(t for i, text in texts.items() if i % 3 for t in [*words(text), None])
    name = {t: lm.END if t is None else word_hash(t.encode()) for t in {t for text in texts.values() for t in [*words(text), None]}}
    short = {int(n): int(o) for n, o in zip(m.frequent, m.outcome, strict=True) if o >= 0}

    def klass(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return int(lm.tokens(data, np.array([0, len(data)])).group[0])

    group = {t: klass(t) for t in name if t is not None and name[t] not in short}
    size, members = collections.Counter(), collections.Counter()
    for t, n in count.items():
        if name[t] not in short:
            size[group[t]] += n
            members[group[t]] += 1
    border = m.short + lm.CLASSES
    outcome = lambda t: short.get(name[t], m.short + group.get(t, 0))

    def probability(t, one, two):
        o = outcome(t)
        p = math.exp(float(m.near[one, o]) + float(m.far[two, o]) + float(m.bias[o]) - float(m.log_z[one, two]))
        return p if name[t] in short else p * (count[t] + 1) / (size[group[t]] + members[group[t]] + 1)

    for i in list(texts)[:60]:
        one = two = border
        total = 0.0
        for t in [*words(texts[i]), None]:
            total += math.log10(probability(t, one, two))
            one, two = outcome(t), one
        assert got[i].score == pytest.approx(total, rel=1e-5)
    for one, two in ((border, border), (0, border), (1, 0), (m.short + 3, 2)):
        known = sum(probability(t, one, two) for t in count)
        # One unknown token has a share in each class.
        unknown = sum(math.exp(float(m.near[one, o]) + float(m.far[two, o]) + float(m.bias[o]) - float(m.log_z[one, two])) / (size[c] + members[c] + 1) for c in range(lm.CLASSES) for o in (m.short + c,))
        assert known + unknown == pytest.approx(1, abs=1e-3)


def test_pipeline_stages_against_sql(spark):
    """Line dedup and mixing in the pipeline give what their SQL gives on the same input; kept rows are those of the stage before."""
    import duckdb

    import corpus_pipeline as p
    from traceguard.llm import linededup, mixing
    from traceguard.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = materialize(p.identify_language(spark, docs, SF), "told")
    cleaned = materialize(p.drop_repeated_lines(spark, told, SF), "cleaned")
    single = materialize(p.drop_near_duplicates(spark, cleaned, SF), "single")
    mixed = p.mix(spark, single, SF)

    def sql(df, text):
        con = duckdb.connect()
        place = df.inputFiles()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({[x.removeprefix('file://') for x in place]})")
        return con.execute(text).fetchall()

    want = sorted((i, t) for i, t, _, n in sql(told, f"SELECT doc_id, text, n_lines, n_removed FROM ({linededup.ORACLE})") if n == 0 or t.strip(" ") != "")
    assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == want
    want = sorted((i, t) for i, t in sql(single, f"SELECT doc_id, text FROM ({mixing.ORACLE})"))
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == want
    rows = {(r.doc_id, r.text) for r in cleaned.collect()}
    assert {(r.doc_id, r.text) for r in single.collect()} <= rows


def test_jaccard_join_over_whole_documents(spark):
    """All documents of sf0.01 at both thresholds, against components of an exact join on shingles."""
    import duckdb

    from traceguard.llm import jaccard

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({glob.glob(os.path.join(sf, 'documents.parquet'))})")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, percent in ((3, 90), (5, 80)):
        text = jaccard.ORACLE.replace("i + 2", f"i + {k - 1}").replace("len(w) - 2", f"len(w) - {k - 1}").replace("90 *", f"{percent} *")
        got = jaccard.component_ids(jaccard.classes(jaccard.numbered(docs), k, percent)).collect()
        assert sorted(tuple(r) for r in got) == sorted(con.execute(text).fetchall())


def test_held_out_rows_are_told_by_crc32(spark):
    from traceguard.llm.common import held_out

    got = spark.range(50).select("id", held_out("id", 7, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in got)
