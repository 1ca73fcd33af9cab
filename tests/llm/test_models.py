"""Learned operators: accuracy on held-out rows, and defined results for awkward ones."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import _tokens as tk
from panelkit.llm import language_id, quality
from tests.llm.cases import documents, empty, frame

SF = "/root/testdata/sf0.01"


def test_grams_stay_in_their_row():
    data, offsets = tk.text_buffer(pa.array(["Ab, c", None, "", "ÉÀ", "123", "x"]))
    points, row, has = language_id.normalised(data, offsets)
    assert has.tolist() == [True, False, False, True, False, True]
    assert ["".join(map(chr, points[row == k])) for k in range(6)] == ["ab c", "", "", "éà", "", "x"]
    together = language_id.grams(points, row)
    for k in range(6):
        alone = language_id.grams(*(x[row == k] for x in (points, row)))
        assert sorted(together[0][together[1] == k].tolist()) == sorted(alone[0].tolist())


def test_language_held_out(spark):
    out = language_id.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    docs = frame(spark, documents())
    model = language_id.train(docs)
    assert model.languages == ["de", "en", "fr"]
    out = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    by = {d: (p, s) for d, p, s in out}
    assert len(out) and all(by[d] == ("und", 0.0) for d in (1, 2, 3, 8))
    assert by[6][0] in model.languages and language_id.predict(docs, model).count() == docs.count()
    none = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0
    kept = language_id.keep_known(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}


def test_language_score_by_hand():
    model = language_id.Model(["a", "b"], np.log([0.5, 0.5]), np.log(np.random.default_rng(0).dirichlet(np.ones(language_id.BUCKETS), 2)))
    data, offsets = tk.text_buffer(pa.array(["hello there", "xyz"]))
    points, row, _ = language_id.normalised(data, offsets)
    bucket, at = language_id.grams(points, row)
    best, score = model.decide(*model.sums(bucket, at, 2))
    for k in range(2):
        total = model.log_prior + model.log_prob[:, bucket[at == k]].sum(axis=1)
        assert best[k] == total.argmax() and 0.5 <= score[k] <= 1


def brute_grams(text, buckets=language_id.BUCKETS):
    """Buckets of all grams, by way of a string."""
    marks = "".join(c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    line = " " + re.sub(" +", " ", marks).lstrip(" ")
    out = []
    for end in range(1, len(line)):
        for size in range(1, 4):
            if end - size + 1 < 0 or (size == 1 and line[end] == " "):
                continue
            code = 0
            for c in line[end - size + 1 : end + 1]:
                code = (code << 21 | ord(c)) % 2**64
            out.append((((code * 0x9E3779B97F4A7C15 % 2**64) ^ (size * 0x51ED270B)) * 0xD6E8FEB86659FD93 % 2**64) >> (64 - buckets.bit_length() + 1))
    return out


def has_letter(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


@pytest.mark.parametrize("slice_bytes", [40, 1 << 20])
def test_language_by_brute_force(spark, monkeypatch, slice_bytes):
    """Counts, probabilities and scores of the whole model, also of texts that come in many pieces."""
    monkeypatch.setattr(language_id, "SLICE_BYTES", slice_bytes)
    rows = [r for r in documents() if len(r[1] or "") < 9000] + [(900, "\u0301\u0308 \u0301", "en", "a"), (901, "\U00010400\U0001d11e x", "zz", "a"), (902, "12 34", "qq", "a"), (903, "a\u0301 ", "fr", "a")]
    counts, docs = {}, Counter()
    for _, text, lang, _ in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
            docs[lang] += has_letter(text)
    names = sorted(x for x in docs if docs[x])
    prob = {x: lambda b, c=counts[x], n=sum(counts[x].values()): math.log((c[b] + language_id.SMOOTHING) / (n + language_id.SMOOTHING * language_id.BUCKETS)) for x in names}
    df = frame(spark, rows)
    # scored here and not by a worker, which doesn't know the changed size
    batch = pa.record_batch({"lang": pa.array([r[2] for r in rows]), "text": pa.array([r[1] for r in rows])})
    model = language_id.train(df)
    assert model.languages == names
    for k, x in enumerate(names):
        assert model.log_prior[k] == pytest.approx(math.log(docs[x] / sum(docs.values())))
        assert model.log_prob[k].tolist() == pytest.approx([prob[x](b) for b in range(language_id.BUCKETS)])
    pred, score = language_id._predicted(model, batch)
    for (_, text, _, _), mine, own in zip(rows, pred, score, strict=True):
        if not has_letter(text):
            assert (mine, own) == ("und", 0.0)
            continue
        found = brute_grams(text)
        total = [model.log_prior[k] + sum(prob[x](b) for b in found) for k, x in enumerate(names)]
        best = max(range(len(names)), key=lambda k: total[k])
        share = [math.exp((t - total[best]) * min(1, language_id.TEMPERED_GRAMS / len(found))) for t in total]
        assert mine == names[best] and own == pytest.approx(1 / sum(share), rel=1e-6)


@pytest.mark.parametrize("texts", [[None] * 5, [""] * 5, ["12 34", "!?", " "], ["\u0301\u0301", None], [None, "", "--"]])
def test_language_of_nothing(spark, texts):
    """Whole tables, and so whole batches, without a letter."""
    known = language_id.train(frame(spark, documents()))
    for partitions in (1, 4):
        docs = frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)], partitions)
        got = language_id.predict(docs, known).collect()
        assert len(got) == len(texts) and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
        assert language_id.keep_known(docs, known).count() == 0
        nothing = language_id.train(docs)
        assert nothing.languages == [] and language_id.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0


def test_quality_held_out(spark):
    out = quality.op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rows = out.where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_cases(spark):
    docs = frame(spark, documents())
    labels = spark.createDataFrame([(100 + k, k % 2) for k in range(20)] + [(100, 1), (None, 1), (9, None), (9, 0), (999, 1)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    rows = quality.score(docs, forest).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = quality.train(docs.repartition(7), labels)
    assert np.array_equal(forest.threshold, same.threshold) and np.array_equal(forest.value, same.value)
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty(spark), forest).count() == 0
    twice = [(1, "one text of an id", "en", "a"), (1, "Another, quite different! 12345", "en", "a"), (2, "x y z", "en", "a")]
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, other int")
    forests = [quality.train(frame(spark, twice[::step], n), marks.toDF("doc_id", "quality", "Doc_Id")) for step, n in ((1, 1), (-1, 3))]
    assert np.array_equal(forests[0].threshold, forests[1].threshold) and np.array_equal(forests[0].value, forests[1].value)
    few = quality.train(docs, labels, max_sample=4)
    assert len(few.roots) == quality.TREES


def test_statistics_do_not_depend_on_the_batch():
    texts = [r[1] for r in documents()]
    data, offsets = tk.text_buffer(pa.array(texts))
    together = quality.statistics(data, offsets)
    for k, t in enumerate(texts):
        assert np.allclose(quality.statistics(*tk.text_buffer(pa.array([t], pa.string())))[0], together[k])


def test_trees_by_hand():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = forest.base
        for root in forest.roots:
            node = root
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])


@pytest.mark.parametrize("op,rest", [(language_id, 0), (quality, 2)])
def test_held_out_rows(spark, op, rest):
    import zlib

    ids = [random.Random(1).randint(0, 10**9) for _ in range(50)] + [None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select(op.held_out(F.col("doc_id"))).collect()]
    mod = 5 if rest == 0 else 4
    assert got == [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids]
