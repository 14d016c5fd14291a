"""Quality rules by distribution divergence.

Two histograms of a document, of character classes and of common words, are compared with references by
Jensen-Shannon distance. A reference is the sum of both histograms over all documents of a language that pass the base
counts. Words are counted in ``WORD_BINS`` hashed bins; a language's ``COMMON`` fullest bins are its common words and
all other words share one cell. A document is held against its nearest reference. Short documents are noisy: limits
widen with the root of their size, and documents under the minimum length get no verdict from a histogram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import lean, prepare, require_few, slices

WORD_BINS, COMMON, MAX_LANGUAGES = 1 << 14, 48, 256
MIN_CHARS, MIN_WORDS = 100, 50
CLASS_LIMIT, CLASS_NOISE = 0.20, 1.0
WORD_LIMIT, WORD_NOISE = 0.22, 1.5
SYMBOLS = b"#*$%&|<>"

# Fixed classes: lower, upper, digit, blank, line end, sentence end, other ASCII marks, listed symbols, non-ASCII lead.
CLASSES = 9
CHAR_CLASS = np.full(256, 6, np.int64)
CHAR_CLASS[97:123], CHAR_CLASS[65:91], CHAR_CLASS[48:58] = 0, 1, 2
CHAR_CLASS[list(b" \t\r\v\f")], CHAR_CLASS[10] = 3, 4
CHAR_CLASS[list(b".?!")], CHAR_CLASS[list(SYMBOLS)] = 5, 7
CHAR_CLASS[192:], CHAR_CLASS[128:192] = 8, CLASSES  # the last cell holds continuation bytes and is not counted
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def facts(data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each text, its class histogram, and bins and text numbers of its words in lower case."""
    n = len(off) - 1
    start, end, text_no = K.words(data, off)
    n_words = K.counts_by_text(text_no, n)
    hashes = K.span_digest(data, start, end)
    lead = (data & 0xC0) != 0x80
    word_chars = K.sum_by_text(lead & K.IS_WORD[data], off)

    # Lines with a word that equal an earlier line of the text.
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1][off[1:] > off[:-1]], cut + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.concatenate([cut, [len(data)]])[np.searchsorted(cut, begin)], off[np.searchsorted(off, begin, side="right")]) if len(begin) else begin
    has = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop = begin[has], stop[has]
    line_text = np.searchsorted(off, begin, side="right") - 1
    line = K.span_digest(data, begin, stop)
    order = np.lexsort((line, line_text))
    again = np.zeros(len(line), bool)
    again[order[1:]] = (line[order][1:] == line[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])

    # Words in windows of eight words that the text holds twice or more.
    window, first = K.word_windows(hashes, text_no, 8)
    order = np.lexsort((window, text_no[first]))
    w, t = window[order], text_no[first][order]
    equal = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
    twice = np.zeros(len(w), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    cover = np.zeros(len(hashes) + 1, np.int64)
    place = first[order[twice]]
    np.add.at(cover, place, 1)
    np.add.at(cover, place + 8, -1)
    covered = np.cumsum(cover[:-1]) > 0

    base = {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": K.sum_by_text(_IS_SYMBOL[data], off),
        "n_dup_lines": K.counts_by_text(line_text[again], n),
        "n_repeat_words": np.bincount(text_no[covered], minlength=n)[:n].astype(np.int64),
    }
    base["base_failed"] = (n_words < 20) | (100 * base["n_repeat_words"] > 30 * n_words)
    text_of = np.repeat(np.arange(n), off[1:] - off[:-1])
    classes = np.bincount(text_of * (CLASSES + 1) + CHAR_CLASS[data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]
    # Common words compare without case and without marks at their ends.
    lower = K.LOWER_ASCII[data]
    mark = (CHAR_CLASS[data] >= 5) & (CHAR_CLASS[data] <= 7)
    s, e = start.copy(), end.copy()
    for _ in range(3):
        e -= (e > s) & mark[np.maximum(e - 1, 0)] if len(e) else e
    bins = (K.span_digest(lower, s, e) >> np.uint64(64 - 14)).astype(np.int64)
    return base, classes, bins, text_no


COUNTS = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])


@lean
def _count(batches):
    """Class cells (0 to CLASSES - 1) and word bins (from CLASSES on) by language over one partition."""
    total: dict[str, np.ndarray] = {}
    for whole in batches:
        for part, data, off in slices(whole, "text"):
            base, classes, bins, text_no = facts(data, off)
            codes = part.column("lang").dictionary_encode()
            names, index = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            good = ~base["base_failed"]
            for k, name in enumerate(names):
                use = good & (index == k)
                row = np.concatenate([classes[use].sum(axis=0), np.bincount(bins[use[text_no]], minlength=WORD_BINS)])
                total[name] = total[name] + row if name in total else row
    for name, row in total.items():
        full = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(row[full].astype(np.int64))], schema=COUNTS)


class References:
    """Reference distributions of all languages."""

    def __init__(self, names: list[str], classes: np.ndarray, words: np.ndarray):
        self.names = names
        self.classes = (classes + 1e-9) / (classes + 1e-9).sum(axis=1, keepdims=True)
        self.cell = np.full((len(names), WORD_BINS), COMMON, np.int64)
        self.words = np.zeros((len(names), COMMON + 1))
        for k in range(len(names)):
            common = np.argsort(-words[k], kind="stable")[:COMMON]
            self.cell[k, common] = np.arange(COMMON)
            share = np.bincount(self.cell[k], weights=words[k], minlength=COMMON + 1)
            self.words[k] = share / max(1.0, share.sum())


def learn(docs: DataFrame, text_col: str, lang_col: str) -> References:
    """References from all rows with a language; at most MAX_LANGUAGES times (CLASSES + WORD_BINS) counts come back."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    require_few(rows, "lang", MAX_LANGUAGES)
    found = rows.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    table = np.zeros((len(names), CLASSES + WORD_BINS))
    if found.num_rows:
        np.add.at(table, ([number[x] for x in found.column("lang").to_pylist()], np.asarray(found.column("cell"))), np.asarray(found.column("n")))
    return References(names, table[:, :CLASSES], table[:, CLASSES:])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits) between rows and one distribution."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.maximum(0.0, (left + right) / 2))


def distances(refs: References, classes: np.ndarray, bins: np.ndarray, text_no: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its nearest reference by common words, and both distances to it (0 where it has none)."""
    n = len(classes)
    if not refs.names:
        return np.full(n, -1), np.zeros(n), np.zeros(n)
    word = np.empty((len(refs.names), n))
    for k in range(len(refs.names)):
        count = np.bincount(text_no * (COMMON + 1) + refs.cell[k][bins], minlength=n * (COMMON + 1)).reshape(n, COMMON + 1)
        word[k] = divergence(count / np.maximum(1, count.sum(axis=1, keepdims=True)), refs.words[k])
    near = word.argmin(axis=0)
    share = classes / np.maximum(1, classes.sum(axis=1, keepdims=True))
    return near, divergence(share, refs.classes[near]), word[near, np.arange(n)]


def limits(n_chars: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest distances that pass: infinite under the minimum lengths."""
    chars = np.where(n_chars < MIN_CHARS, np.inf, CLASS_LIMIT + CLASS_NOISE / np.sqrt(np.maximum(1, n_chars)))
    words = np.where(n_words < MIN_WORDS, np.inf, WORD_LIMIT + WORD_NOISE / np.sqrt(np.maximum(1, n_words)))
    return chars, words


OUT = pa.schema(
    [("doc_id", pa.int64()), *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
)


def _judge(shared):
    def run(batches):
        refs = shared.value
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                base, classes, bins, text_no = facts(data, off)
                near, by_class, by_word = distances(refs, classes, bins, text_no)
                most_class, most_word = limits(classes.sum(axis=1), base["n_words"])
                kept = ~base["base_failed"] & (by_class <= most_class) & (by_word <= most_word)
                names = np.array([*refs.names, None], object)[near]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(v) for v in base.values()], pa.array(kept), pa.array(names, pa.string()), pa.array(by_class), pa.array(by_word)], schema=OUT)

    return lean(run)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, nearest, ...)``.

    Words are maximal runs without ASCII white space. ``base_failed``: under 20 words, or over 30 % of the words in
    windows of eight words that occur twice or more. ``kept``: not that, and both distances within their limits. A null
    text has no words and is not kept. Languages serve to build references only; a document is compared with whichever
    is nearest, ties by name. Without any reference, distances are 0. Null ids stay null; rows are judged one by one,
    repeated or not; other columns are not read; an empty table gives an empty table.
    """
    spark = prepare(docs)
    shared = spark.sparkContext.broadcast(learn(docs, text_col, lang_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"{k} long" for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.mapInArrow(_judge(shared), f"{counts}, base_failed boolean, kept boolean, nearest string, class_distance double, word_distance double")
