"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document posterior probabilities of the domains ``clean``,
``low`` and ``toxic``. Document rates then solve a nonnegative least-squares problem:

    minimise over r >= 0:  |sum_i r_i t_i p_i / T - target|^2 / 2  +  RIDGE / (2 T) * sum_i t_i (r_i - 1)^2

with ``t_i`` the document's tokens, ``p_i`` its posteriors and ``T`` the corpus' tokens. At the optimum the residual
``y`` of the domains fixes all rates, ``r_i = max(0, 1 - p_i y / RIDGE)``, so the dual problem has one unknown for each
domain. Newton's method solves it; each step needs only a few sums over the documents, which are taken distributed. The
dual is strongly convex with constant one, so its gradient bounds the error of ``y``, and with it that of the rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, materialise, prepare, slices
from millrace.llm.quality_rules import CLASSES, WORD_BINS, facts

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.90, "low": 0.06, "toxic": 0.04}
FIT_ROWS, FIT_BYTES, SEEN_IN, FIT_STEPS, FIT_RATE, FIT_RIDGE = 4000, 1 << 15, 8, 120, 0.15, 2e-5
RIDGE, MAX_STEPS, TOLERANCE = 1e-4, 60, 1e-9
DENSE = CLASSES + 5


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words), dense features, and the distinct word bins of each text with their text numbers."""
    base, classes, bins, text_no = facts(data, off)
    words, chars = base["n_words"], np.maximum(1, classes.sum(axis=1))
    dense = np.empty((len(words), DENSE))
    dense[:, :CLASSES] = 5 * classes / chars[:, None]
    dense[:, CLASSES] = 5 * base["n_repeat_words"] / np.maximum(1, words)
    dense[:, CLASSES + 1] = 5 * base["n_dup_lines"] / np.maximum(1, words)
    dense[:, CLASSES + 2] = 5 * base["n_symbols"] / chars
    dense[:, CLASSES + 3] = np.log1p(words) / 10
    key = np.unique(text_no * WORD_BINS + bins)
    owner = key // WORD_BINS
    dense[:, CLASSES + 4] = 3 * np.bincount(owner, minlength=len(words)) / np.maximum(1, words)
    return words, dense, key % WORD_BINS, owner


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class DomainClassifier:
    """Softmax regression over dense features and the presence of words in hashed bins."""

    def __init__(self):
        self.dense = np.zeros((DENSE, len(DOMAINS)))
        self.words = np.zeros((WORD_BINS, len(DOMAINS)))
        self.base = np.zeros(len(DOMAINS))

    def posteriors(self, dense: np.ndarray, bins: np.ndarray, owner: np.ndarray) -> np.ndarray:
        value = dense @ self.dense + self.base
        for d in range(len(DOMAINS)):
            value[:, d] += np.bincount(owner, weights=self.words[bins, d], minlength=len(dense))
        return _softmax(value)

    def fit(self, dense: np.ndarray, bins: np.ndarray, owner: np.ndarray, domain: np.ndarray) -> None:
        n = len(domain)
        use = np.bincount(bins, minlength=WORD_BINS)[bins] >= SEEN_IN  # rarer words would only be learned by heart
        bins, owner = bins[use], owner[use]
        truth = np.eye(len(DOMAINS))[domain]
        moment = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("dense", "words", "base")}
        for t in range(1, FIT_STEPS + 1):
            e = (self.posteriors(dense, bins, owner) - truth) / n
            grad = {"dense": dense.T @ e + FIT_RIDGE * self.dense, "base": e.sum(axis=0)}
            grad["words"] = np.stack([np.bincount(bins, weights=e[owner, d], minlength=WORD_BINS) for d in range(len(DOMAINS))], axis=1) + FIT_RIDGE * self.words
            for k, g in grad.items():
                one, two = moment[k]
                one += 0.1 * (g - one)
                two += 0.01 * (g * g - two)
                setattr(self, k, getattr(self, k) - FIT_RATE * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.99**t)) + 1e-9))


def fit_domains(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DomainClassifier | None:
    """Fitted on at most ``fit_rows`` labelled rows of at most ``FIT_BYTES`` each; None without any."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    picked = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.where(f"text is not null and octet_length(text) <= {FIT_BYTES}").join(F.broadcast(picked), "doc_id")
    found = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("domain").alias("domain")).toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    parts, n = [], 0
    for batch in found.to_batches():
        # Features come slice by slice, so the driver never holds more than one slice's arrays.
        for part, data, off in slices(batch, "text", 1 << 19):
            _, dense, bins, owner = features(data, off)
            parts.append((dense.astype(np.float32), bins.astype(np.int32), (owner + n).astype(np.int32)))
            n += part.num_rows
    dense, bins, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = DomainClassifier()
    out.fit(dense, bins, owner, np.asarray(found.column("domain")))
    return out


_P = [(f"p_{d}", pa.float64()) for d in DOMAINS]
_P_SQL = ", ".join(f"p_{d} double" for d in DOMAINS)


def _posteriors(shared, schema: pa.Schema, text: str = "text", keep_text: bool = False):
    def run(batches):
        model = shared.value
        for whole in batches:
            for part, data, off in slices(whole, text):
                words, dense, bins, owner = features(data, off)
                part = part if keep_text else part.drop_columns([text])
                p = model.posteriors(dense, bins, owner) if model else np.full((len(words), len(DOMAINS)), 1 / len(DOMAINS))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(words), *[pa.array(p[:, d]) for d in range(len(DOMAINS))]], schema=schema)

    return lean(run)


def _rate(y: np.ndarray) -> Column:
    """A document's rate at the residual ``y``."""
    return F.greatest(F.lit(0.0), 1 - sum(F.col(f"p_{d}") * float(v / RIDGE) for d, v in zip(DOMAINS, y, strict=True)))


def fit_rates(mix: DataFrame, targets: dict[str, float]) -> np.ndarray:
    """The residual that fixes all rates; an error if it is not found to ``TOLERANCE``."""
    unit, dims = np.array([targets[d] for d in DOMAINS]), len(DOMAINS)
    unit = unit / unit.sum()
    total = float(mix.agg(F.sum("tokens").alias("total")).first()["total"] or 0)
    if not total:
        return np.zeros(dims)

    def at(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and Hessian of the dual."""
        rows = mix.withColumn("rate", _rate(y)).where("rate > 0")
        sums = [F.sum(F.col("tokens") * F.col("rate") * F.col("rate"))]
        sums += [F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{a}")) for a in DOMAINS]
        sums += [F.sum(F.col("tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")) for a in DOMAINS for b in DOMAINS]
        found = np.array([x or 0.0 for x in rows.agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()]) / total
        gram = found[1 + dims :].reshape(dims, dims)
        return y @ y / 2 + unit @ y + RIDGE * found[0] / 2, y + unit - found[1 : 1 + dims], np.eye(dims) + gram / RIDGE

    y = np.zeros(dims)
    value, grad, hessian = at(y)
    for _ in range(MAX_STEPS):
        if np.abs(grad).max() < TOLERANCE:
            return y
        move, part = -np.linalg.solve(hessian, grad), 1.0
        while True:
            new = at(y + part * move)
            # Close to the optimum values differ by less than their rounding, and the gradient tells.
            if new[0] <= value + 1e-4 * part * (grad @ move) or np.abs(new[1]).max() < np.abs(grad).max() / 2:
                break
            part /= 2
            if part < 1e-9:
                raise ArithmeticError(f"rates do not converge: gradient {np.abs(grad).max():.1e}")
        y, (value, grad, hessian) = y + part * move, new
    if np.abs(grad).max() < TOLERANCE:
        return y
    raise ArithmeticError(f"rates do not converge in {MAX_STEPS} steps: gradient {np.abs(grad).max():.1e}")


def mix_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, tokens, p_clean, p_low, p_toxic, rate, copies)`` for each row.

    ``rate`` is how often a document is expected to be drawn for the corpus' size to stay and its domains to weigh as
    ``targets`` say; ``copies`` is the drawn number, the rate rounded up or down by a hash of the id. Null and empty
    texts have no tokens and rate like any other. Without labels all domains are equally likely. If targets cannot be
    met, the rates come as near as least squares can. Null ids stay null; repeated rows are equal; other columns are not
    read; an empty table gives an empty table.
    """
    spark = prepare(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(fit_domains(rows, labels, fit_rows))
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), *_P])
    mix = materialise(rows.mapInArrow(_posteriors(shared, schema), f"doc_id long, tokens long, {_P_SQL}"), "mix")
    out = mix.withColumn("rate", _rate(fit_rates(mix, targets or TARGETS)))
    return out.withColumn("copies", draw(F.col("rate"), F.col("doc_id")))


def draw(rate: Column, key: Column) -> Column:
    """The rate rounded up or down so that the mean over keys is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit(10)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("long")


def keep_drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are drawn at least once.

    Each stays once: further copies would undo deduplication, and the rates tell how often to repeat a row in training.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = prepare(docs)
    others = docs.columns
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(fit_domains(rows, labels))
    inner = docs.select(*[(F.col(c).cast("string") if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(others)])
    sql = inner.withColumns({"tokens": F.lit(0).cast("long"), **{k: F.lit(0.0) for k, _ in _P}}).schema
    text = f"c{others.index(text_col)}"
    mix = materialise(inner.mapInArrow(_posteriors(shared, to_arrow_schema(sql), text, True), sql), "mix")
    out = mix.withColumn("rate", _rate(fit_rates(mix.select("tokens", *[k for k, _ in _P]), targets or TARGETS)))
    return out.where(draw(F.col("rate"), F.col(f"c{others.index(id_col)}").cast("long")) >= 1).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
