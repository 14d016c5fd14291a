"""Verdicts and scores against plain Python: every document's distances, and the network place by place."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import kernel, language_id, quality_cnn, quality_rules
from millrace.llm.common import held_out

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
Q = quality_rules


def histograms(text):
    """Class counts, word bins, number of words and whether the base counts fail, one byte and one word at a time."""
    raw = (text or "").encode()
    classes = Counter(int(Q.CHAR_CLASS[b]) for b in raw if not 0x80 <= b < 0xC0)
    words, bins = WORD.findall(raw), []
    for w in words:
        cut = w
        for _ in range(3):
            if cut and 5 <= Q.CHAR_CLASS[cut[-1]] <= 7:
                cut = cut[:-1]
        data = np.frombuffer(cut.lower(), np.uint8)
        bins.append(int(kernel.span_digest(data, np.array([0]), np.array([len(data)]))[0]) >> 50)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return classes, bins, len(words), len(words) < 20 or 100 * len(again) > 30 * len(words)


def distance(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, total / 2))


def test_quality_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, None, "de"), (-2, "", "en"), (-3, "zq " * 300, None), (-4, "#$%& " * 99, None)], docs.schema)
    rows = {r["doc_id"]: r for r in docs.unionByName(more).collect()}
    facts = {k: histograms(r["text"]) for k, r in rows.items()}
    sums = {}
    for k, (classes, bins, _, failed) in facts.items():
        if rows[k]["lang"] is not None and not failed:
            own = sums.setdefault(rows[k]["lang"], (Counter(), Counter()))
            own[0].update(classes), own[1].update(bins)
    refs = {}
    for lang in sorted(sums):
        c = [sums[lang][0][j] + 1e-9 for j in range(Q.CLASSES)]
        common = sorted(range(Q.WORD_BINS), key=lambda b: (-sums[lang][1][b], b))[: Q.COMMON]
        cell = {b: j for j, b in enumerate(common)}
        w = [sums[lang][1][b] for b in common]
        w.append(sum(sums[lang][1].values()) - sum(w))
        refs[lang] = ([x / sum(c) for x in c], cell, [x / sum(w) for x in w])
    found = {r["doc_id"]: r for r in Q.quality_rules(docs.unionByName(more)).collect()}
    verdicts = Counter()
    for k, (classes, bins, n_words, failed) in facts.items():
        by_word = {}
        for lang, (_, cell, share) in refs.items():
            counts = Counter(cell.get(b, Q.COMMON) for b in bins)
            by_word[lang] = distance([counts[j] / max(1, len(bins)) for j in range(Q.COMMON + 1)], share)
        near = min(by_word, key=lambda x: (by_word[x], x))
        n = sum(classes.values())
        by_class = distance([classes[j] / max(1, n) for j in range(Q.CLASSES)], refs[near][0])
        r = found[k]
        assert r["word_distance"] == pytest.approx(by_word[near], abs=1e-6) and r["class_distance"] == pytest.approx(by_class, abs=1e-4)
        fits = n < Q.MIN_CHARS or by_class <= Q.CLASS_LIMIT + Q.CLASS_NOISE / math.sqrt(n)
        fits &= n_words < Q.MIN_WORDS or by_word[near] <= Q.WORD_LIMIT + Q.WORD_NOISE / math.sqrt(n_words)
        assert r["kept"] == (fits and not failed)
        verdicts[r["kept"], failed] += 1
    assert verdicts[True, False] and verdicts[False, True] and verdicts[False, False]


TEXTS = [b"", b"a", b"one two three. " * 60, bytes(range(256)) * 5, b"x" * 511, b"x" * 513, ("äöü 日本 " * 70).encode()]


def network():
    net = quality_cnn.Network(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    return net


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_network_place_by_place():
    """Filters, pooling and chunks as loops over the places of each text."""
    net, (data, off) = network(), joined(TEXTS)
    scores = net.score(data, off)
    codes, first = quality_cnn.layout(data, off)
    x = net.w["byte"][codes]
    step, per = quality_cnn.STEP, quality_cnn.BLOCK // quality_cnn.STEP
    for t in range(len(TEXTS)):
        begin, end = first[t] * per, first[t + 1] * per
        pooled = []
        for b in range(first[t], first[t + 1]):
            answers = []
            for place in range(b * per, (b + 1) * per):
                near = x[place * step : (place + 1) * step].ravel()
                far = x[(place + 1) * step : (place + 2) * step].ravel()
                y = near @ net.w["near"] + (far @ net.w["far"] if len(far) else 0)
                answers.append(np.maximum(y, 0))
            pooled.append(np.max(answers, axis=0))
        assert end - begin == len(pooled) * per
        chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:], strict=False)] or pooled
        hidden = np.tanh(np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)]) @ net.w["in"] + net.w["bias"])
        assert scores[t] == pytest.approx(1 / (1 + math.exp(-(hidden @ net.w["out"] + net.w["base"][0]))), abs=1e-9)


def test_gradient_by_differences():
    net, (data, off) = network(), joined(TEXTS[2:])
    label = np.array([0, 1, 1, 0, 1], float)

    def loss():
        p = net.score(data, off)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    rng = np.random.default_rng(0)
    for k, g in net.gradient(data, off, label).items():
        for at in rng.integers(0, net.w[k].size, 12):
            flat, old = net.w[k].reshape(-1), net.w[k].reshape(-1)[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert np.asarray(g).reshape(-1)[at] == pytest.approx((up - down) / 2e-6, abs=2e-5)


def test_classifier_takes_any_row(spark):
    """Nulls, empty and very long texts, repeated rows and columns with the names used inside."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 60000), (-4, "same"), (-4, "same"), (None, "x")], "doc_id long, text string")
    docs = given.unionByName(more).select("*", F.lit(7).alias("score"), F.lit("z").alias("quality"), F.lit(1).alias("predicted"))
    found = quality_cnn.classify(docs, labels, held_out(F.col("doc_id"))).where("doc_id < 0 or doc_id is null").collect()
    by = {r["doc_id"]: r["score"] for r in found}
    assert len(found) == 6 and by[-1] == by[-2] and all(0 <= s <= 1 for s in by.values())
    assert len({r["score"] for r in found if r["doc_id"] == -4}) == 1


@pytest.mark.parametrize("learn", [lambda d: language_id.learn(d), lambda d: quality_rules.learn(d, "text", "lang")])
def test_too_many_labels(spark, learn):
    with pytest.raises(ValueError, match="256"):
        learn(spark.range(300).select(F.lit("some text").alias("text"), F.col("id").cast("string").alias("lang")))
