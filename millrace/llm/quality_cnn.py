"""Quality classifier: a byte-level convolutional network in numpy.

Each byte becomes a few channels by a learned table of 257 rows: one for each value of a byte, one for padding. Learned
filters of four bytes run over the whole text in steps of two. Their rectified answers are max-pooled over
overlapping chunks of ``2 * BLOCK`` bytes; the chunks' largest and mean answers go through one hidden layer to one
probability. The network is fitted on the driver on at most ``FIT_ROWS`` labelled rows of at most ``FIT_BYTES`` each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, prepare, slices, utf8

FIT_ROWS, FIT_BYTES, EPOCHS, BATCH, RATE, DECAY = 2400, 1 << 15, 20, 24, 0.01, 1e-4
STEP, BLOCK, FILTERS, HIDDEN = 2, 256, 24, 12
BYTES, CHANNELS = 257, 8  # 256 values and the pad


def layout(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice, every text padded to whole blocks, and the first block of each text."""
    size = off[1:] - off[:-1]
    blocks = -(-(size + STEP) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.full(int(first[-1]) * BLOCK, BYTES - 1, np.int16)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK - off[:-1], size)] = data
    return padded, first


class Network:
    """Weights, forward pass and gradient."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        wide = STEP * CHANNELS
        self.w = {
            "byte": rng.normal(0, 0.5, (BYTES, CHANNELS)),
            "near": rng.normal(0, 0.3, (wide, FILTERS)),
            "far": rng.normal(0, 0.3, (wide, FILTERS)),
            "in": rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)),
            "bias": np.zeros(HIDDEN),
            "out": rng.normal(0, 0.3, HIDDEN),
            "base": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def blocks(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers of all filters at all places, by block; and the bytes' channels in steps."""
        a = self.w["byte"][codes].reshape(-1, STEP * CHANNELS)
        y = a @ self.w["near"]
        y[:-1] += (a @ self.w["far"])[1:]
        return np.maximum(y, 0, out=y).reshape(-1, BLOCK // STEP, FILTERS), a

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two neighbouring blocks are a chunk (one, if a text has no more): their numbers, and each text's first chunk."""
        count = np.maximum(1, np.diff(first) - 1)
        begin = np.concatenate([[0], np.cumsum(count)])
        one = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
        return one, np.minimum(one + 1, np.repeat(first[1:] - 1, count)), begin

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(features @ self.w["in"] + self.w["bias"])
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w["out"] + self.w["base"][0], -30, 30))), hidden

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        codes, first = layout(data, off)
        y, _ = self.blocks(codes)
        z = y.max(axis=1)
        one, two, begin = self.chunks(first)
        c = np.maximum(z[one], z[two])
        high = np.maximum.reduceat(c, begin[:-1], axis=0)
        mean = np.add.reduceat(c, begin[:-1], axis=0) / np.diff(begin)[:, None]
        return self.head(np.concatenate([high, mean], axis=1))[0]

    def gradient(self, data: np.ndarray, off: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        codes, first = layout(data, off)
        y, a = self.blocks(codes)
        at = y.argmax(axis=1)
        z = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
        one, two, begin = self.chunks(first)
        left = z[one] >= z[two]
        c = np.where(left, z[one], z[two])
        n = len(label)
        best = np.array([begin[k] + c[begin[k] : begin[k + 1]].argmax(axis=0) for k in range(n)])
        high = np.take_along_axis(c, best, axis=0)
        size = np.diff(begin)
        features = np.concatenate([high, np.add.reduceat(c, begin[:-1], axis=0) / size[:, None]], axis=1)
        p, hidden = self.head(features)
        e = (p - label).astype(np.float32) / n
        d_hidden = e[:, None] * self.w["out"] * (1 - hidden * hidden)
        d_features = d_hidden @ self.w["in"].T
        d_c = np.repeat(d_features[:, FILTERS:] / size[:, None], size, axis=0)
        np.add.at(d_c, (best, np.arange(FILTERS)[None, :]), d_features[:, :FILTERS])
        d_z = np.zeros_like(z)
        np.add.at(d_z, one, np.where(left, d_c, 0))
        np.add.at(d_z, two, np.where(left, 0, d_c))
        d_z[z <= 0] = 0
        place = np.arange(len(z))[:, None] * (BLOCK // STEP) + at
        out = {"in": features.T @ d_hidden, "bias": d_hidden.sum(axis=0), "out": hidden.T @ e, "base": e.sum(keepdims=True)}
        near, far = np.zeros_like(self.w["near"]), np.zeros_like(self.w["far"])
        steps = codes.reshape(-1, STEP)
        seen, slope = [], []
        for f in range(FILTERS):
            used = np.flatnonzero(d_z[:, f])
            for grad, weights, ahead in ((near, self.w["near"], 0), (far, self.w["far"], 1)):
                # The last place has nothing ahead of it.
                g, at_step = d_z[used, f], place[used, f] + ahead
                g, at_step = g[at_step < len(a)], at_step[at_step < len(a)]
                grad[:, f] = g @ a[at_step]
                seen.append(steps[at_step].ravel())
                slope.append((g[:, None] * weights[:, f]).reshape(-1, CHANNELS))
        seen, slope = np.concatenate(seen), np.concatenate(slope)
        byte = np.stack([np.bincount(seen, weights=slope[:, c], minlength=BYTES) for c in range(CHANNELS)], axis=1)
        return out | {"near": near, "far": far, "byte": byte}

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam over shuffled batches; deterministic for given rows in a given order."""
        rng = np.random.default_rng(seed)
        first, second, t = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2)), None, 0
        first, second = tuple(first)
        total = epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                data = np.concatenate([texts[k] for k in pick])
                off = np.concatenate([[0], np.cumsum([len(texts[k]) for k in pick])])
                t += 1
                rate = RATE * (1 - 0.9 * t / total)
                for k, g in self.gradient(data, off, labels[pick]).items():
                    g = g + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, fit_rows: int = FIT_ROWS) -> Network | None:
    """A network fitted on a bounded sample of the labelled rows that are not held out; None without any."""
    known = labels.where("quality is not null").where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    picked = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.where(f"text is not null and octet_length(text) <= {FIT_BYTES}").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    # At most fit_rows ids are broadcast; ids that repeat give one text, so as many texts of bounded size come back.
    found = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    data, off = utf8(found.column("text"))
    network = Network()
    network.fit([data[off[k] : off[k + 1]] for k in range(found.num_rows)], np.asarray(found.column("quality")).astype(np.float32))
    return network


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(shared):
    def run(batches):
        network = shared.value
        for whole in batches:
            for part, data, off in slices(whole, "text", 1 << 19):
                score = network.score(data, off).astype(np.float64) if network else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema=OUT)

    return lean(run)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row.

    Only whole texts are read for a score. Null and empty texts are scored as empty ones. Without labelled rows all
    scores are 0.5. Null ids stay null; repeated rows give equal scores; other columns are not read; an empty table
    gives an empty table.
    """
    spark = prepare(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(fit(rows, labels, held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")
