"""Texts in as many languages as the corpus has."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id


def test_text_in_all_languages(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 600")
    langs = sorted(r["lang"] for r in given.select("lang").distinct().collect())
    assert len(langs) >= 4
    parts = {x: " ".join(r["text"] for r in given.where(F.col("lang") == x).orderBy("doc_id").limit(8).collect()) for x in langs}
    size = min(map(len, parts.values())) // 4
    rows = [(-1 - k, " ".join(parts[x][: size * (w if k else 4)] for w, x in enumerate(langs, 1)), None, True) for k in range(2)]
    rows += [(-3 - k, parts[x], None, True) for k, x in enumerate(langs)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, out boolean")
    docs = given.select("doc_id", "text", "lang", F.lit(False).alias("out")).unionByName(more)
    found = {r["doc_id"]: r for r in language_id.identify(docs, F.col("out")).where("doc_id < 0").collect()}
    assert found[-1]["languages"] == found[-2]["languages"] == langs
    shares = np.array([1, 2, 3, 4][: len(langs)]) / 10
    assert np.abs(np.array(found[-1]["proportions"]) - 0.25).max() < 0.07 and np.abs(np.array(found[-2]["proportions"]) - shares).max() < 0.07
    assert [found[-3 - k]["lang_pred"] for k in range(len(langs))] == langs


def test_stopping_loses_no_set():
    """Against every set size tried on every text, with more languages than texts use."""
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    chances = rng.dirichlet(np.full(27, 0.3), 7)
    draw = lambda k, n: letters[rng.choice(27, n, p=chances[k])].tobytes()
    model = np.full((language_id.BINS, 7), 0.5)
    for k in range(7):
        data = np.frombuffer(draw(k, 200000), np.uint8)
        bins, _ = language_id.trigrams(data, np.array([0, len(data)]))
        model[:, k] += np.bincount(bins, minlength=language_id.BINS)
    model /= model.sum(axis=0)
    texts = [b"".join(draw(k, 30 * int(rng.integers(1, 30))) for k in rng.permutation(7)[:used]) for used in range(1, 8) for _ in range(4)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, wide, within = language_id.mixtures(np.frombuffer(b"".join(texts), np.uint8), off, model)
    for t, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        bins, _ = language_id.trigrams(data, np.array([0, len(data)]))
        best, chosen = -np.inf, None
        for k in range(1, 8):
            weights = np.zeros(7)
            first = np.argsort(-wide[t], kind="stable")[:k]
            weights[first] = wide[t][first] / wide[t][first].sum()
            for _ in range(language_id.SET_STEPS):
                part = model[bins] * weights
                weights = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
            value = np.log(model[bins] @ weights).sum() - (k - 1) * language_id.PENALTY * np.log(len(bins))
            if value > best:
                best, chosen = value, weights
        assert np.allclose(within[t], chosen, atol=1e-9)
    assert (within > 0).sum(axis=1).max() > 4
