"""Language identification by multilingual mixture inference.

Each language is a distribution over letter trigrams, counted over all rows that may be learned from. A document is a
mixture of languages: expectation-maximisation estimates its proportions from its trigrams' likelihoods. The set of
languages is then chosen by penalised likelihood: the first one, two and so on by proportion, each further one paying
``PENALTY`` times the logarithm of the number of trigrams. A text is done once an upper bound on its likelihood under all
languages shows that no larger set can win. The answer is the chosen set's largest language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import lean, prepare, require_few, slices

BINS = 1 << 16
MAX_LANGUAGES = 256  # of a model; a label beyond the most frequent ones is refused, not dropped silently
SMOOTHING, PENALTY = 0.5, 3.0
FIRST_STEPS, SET_STEPS = 8, 4
UNDETERMINED = "und"

# Letters in lower case; all else becomes a space. UTF-8's second bytes of capital Latin letters fold as well.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
FOLD[0x80:0x9F] = np.arange(0xA0, 0xBF)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams inside texts that are not blank, and their text numbers."""
    m = len(data) - 2
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    folded = FOLD[data].astype(np.uint32)
    code = folded[:m] << np.uint32(16) | folded[1 : m + 1] << np.uint32(8) | folded[2:]
    inside = code != np.uint32(0x202020)
    for back in (1, 2):
        edge = off[1:-1] - back
        inside[edge[(edge >= 0) & (edge < m)]] = False
    place = np.flatnonzero(inside)
    bins = (code[place] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return bins.astype(np.int64), np.searchsorted(off, place, side="right") - 1


COUNTS = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])


@lean
def _count(batches):
    """Trigram counts by language over one partition."""
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for part, data, off in slices(whole, "text"):
            codes = part.column("lang").dictionary_encode()
            names, index = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            bins, text_no = trigrams(data, off)
            both = np.bincount(index[text_no] * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
            for k, name in enumerate(names):
                total[name] = total[name] + both[k] if name in total else both[k]
    for name, counts in total.items():
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full].astype(np.int64))], schema=COUNTS)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Names and (bins, languages) probabilities from all rows with a language.

    What comes to the driver is bounded by ``BINS`` times ``MAX_LANGUAGES`` counts, however many rows there are.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    require_few(rows, "lang", MAX_LANGUAGES)
    counts = rows.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    table = np.zeros((BINS, len(names)))
    if found.num_rows:
        np.add.at(table, (np.asarray(found.column("bin")), [number[x] for x in found.column("lang").to_pylist()]), np.asarray(found.column("n")))
    table += SMOOTHING
    return names, (table / table.sum(axis=0)).astype(np.float32) if names else table


def mixtures(data: np.ndarray, off: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of trigrams, proportions over all languages, and proportions within the chosen set."""
    n, langs = len(off) - 1, model.shape[1]
    bins, text_no = trigrams(data, off)
    key, count = np.unique(text_no * BINS + bins, return_counts=True)
    owner, p, count = key // BINS, model[key % BINS].astype(np.float64), count.astype(np.float64)
    size = np.bincount(owner, weights=count, minlength=n)
    full = np.flatnonzero(size)
    begin = np.searchsorted(owner, full)
    row = np.searchsorted(full, owner)
    length = size[full]
    prior = np.full((len(full), langs), 1.0 / langs)

    def step(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights after one step; the likelihood before it, and a bound on that of any weights over all languages."""
        if not len(length):
            return weights, np.zeros(0), np.zeros(0)
        total = np.maximum((p * weights[row]).sum(axis=1), 1e-300)
        gain = np.add.reduceat(p * (count / total)[:, None], begin, axis=0) / length[:, None]
        likelihood = np.add.reduceat(count * np.log(total), begin)
        # By Jensen's inequality other weights gain at most the logarithm of their mean gain for each trigram.
        return weights * gain, likelihood, likelihood + length * np.log(np.maximum(gain.max(axis=1), 1.0))

    for _ in range(FIRST_STEPS):
        prior, _, _ = step(prior)
    order = np.argsort(-prior, axis=1, kind="stable")
    best, chosen = np.full(len(full), -np.inf), np.zeros((len(full), langs))
    live, guide, limit = np.arange(len(full)), prior, np.full(len(full), np.inf)
    for k in range(1, langs + 1):
        fee = (k - 1) * PENALTY * np.log(np.maximum(length, 2))
        keep = limit - fee > best[live]
        if not keep.all():
            of = keep[row]
            p, count, row = p[of], count[of], (np.cumsum(keep) - 1)[row[of]]
            live, guide, limit, length, fee = live[keep], guide[keep], limit[keep], length[keep], fee[keep]
            begin = np.searchsorted(row, np.arange(len(live)))
        if not len(live):
            break
        weights, first = np.zeros((len(live), langs)), order[live, :k]
        np.put_along_axis(weights, first, np.take_along_axis(prior[live], first, axis=1), axis=1)
        weights /= weights.sum(axis=1, keepdims=True)
        for _ in range(SET_STEPS if k > 1 else 0):
            weights, _, _ = step(weights)
        _, likelihood, bound = step(weights)
        guide, _, wider = step(guide)
        limit = np.minimum(limit, np.minimum(bound, wider))
        value = likelihood - fee
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], weights[better]
    wide, within = np.zeros((n, langs)), np.zeros((n, langs))
    wide[full], within[full] = prior, chosen
    return size.astype(np.int64), wide, within


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    sure = K.sum_by_text(ASCII_LETTER[data], off) > 0
    for k in np.flatnonzero(~sure):
        sure[k] = any(c.isalpha() for c in data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return sure


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])


def predict_slice(data: np.ndarray, off: np.ndarray, names: list[str], model: np.ndarray) -> tuple[list[str], np.ndarray, list[list[str]], list[list[float]]]:
    size, wide, within = mixtures(data, off, model)
    letters = _has_letter(data, off)
    top = within.argmax(axis=1)
    langs, scores, sets, shares = [], np.zeros(len(size)), [], []
    for k in range(len(size)):
        # A text with letters and less than one trigram still gets a learned language: the first, with an even score.
        if not letters[k] or not names:
            langs.append(UNDETERMINED), sets.append([]), shares.append([])
            continue
        langs.append(names[top[k]])
        scores[k] = wide[k, top[k]] if size[k] else 1.0 / len(names)
        used = np.flatnonzero(within[k]) if size[k] else []
        sets.append([names[j] for j in used]), shares.append([float(within[k, j]) for j in used])
    return langs, np.clip(scores, 0.0, 1.0), sets, shares


def _predict(names: list[str], shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                langs, scores, sets, shares = predict_slice(data, off, names, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], schema=PREDICTED)

    return lean(run)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages, proportions)`` for each row.

    Learns from rows with a language that are not ``held_out``. ``und`` with score 0 if the text is null, empty or has
    no letter, or if there is nothing to learn from. ``languages`` is the chosen set and ``proportions`` its shares.
    Null ids stay null; repeated rows get equal answers; ties go to the language first by name; other columns are not
    read. An empty table gives an empty table.
    """
    spark = prepare(docs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    names, model = learn(docs.where("not held_out"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(_predict(names, spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")


def _accept(names: list[str], shared, text: str, schema: pa.Schema):
    def run(batches):
        model = shared.value
        for whole in batches:
            for part, data, off in slices(whole, text):
                langs = predict_slice(data, off, names, model)[0]
                yield part.filter(pa.array([x != UNDETERMINED for x in langs])).cast(schema)

    return lean(run)


def keep_identified(docs: DataFrame, held_out: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = prepare(docs)
    names, model = learn(docs.where(~held_out), text_col, lang_col)
    inner = docs.select(*[(F.col(c).cast("string") if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    accept = _accept(names, spark.sparkContext.broadcast(model), f"c{docs.columns.index(text_col)}", to_arrow_schema(inner.schema))
    return inner.mapInArrow(accept, inner.schema).toDF(*docs.columns)
