"""Token counts by rank-synchronous merging over ragged arrays.

Texts are normalised and cut into pre-tokens. The distinct pre-tokens of a batch stand as one ragged array of symbols.
In each round every sequence finds its lowest-ranked pair and all sequences apply theirs at once; a sequence without a
mergeable pair is done, and its surviving symbols are counted. Counts of pre-tokens are kept in a bounded table.

Python's Unicode tables and those of the vocabulary file's library may be of different versions. Characters on which they
differ, or which any of them does not know, are found once; texts that hold one, and all texts under a file with
another normaliser or split, are cut by the library itself.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenizers import Regex, Tokenizer, pre_tokenizers

from millrace.llm.common import lean, prepare, slices

NO_RANK = np.iinfo(np.int64).max
REMEMBERED = 400_000
SEGMENT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
# The normaliser and the split that are restated here.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _normalised(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letters are lowered one by one


@functools.cache
def unsure(path: str) -> np.ndarray:
    """For each code point: whether Python's tables and the library's may treat it differently."""
    out = np.zeros(0x110000, bool)
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k) != "|"]
    out[0xD800:0xE000] = True
    joined = "".join(every)
    for kind, own in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}"), (r"\p{Cn}", r"\p{Cn}")):
        pieces = pre_tokenizers.Split(Regex(f"(?:(?!{kind})[\\s\\S])+"), "removed").pre_tokenize_str(joined)
        theirs = {c for piece, _ in pieces for c in piece}
        ours = set(regex.findall(own, joined))
        # What either does not know is unsure; else what only one of them counts in.
        out[[ord(c) for c in (theirs | ours if kind == r"\p{Cn}" else theirs ^ ours)]] = True
    out[[ord(c) for c in every if unicodedata.category(c) == "Cn"]] = True
    # Normalised one by one; white space, which both make a cut, is left out.
    known = [c for c in every if not out[ord(c)] and not c.isspace()]
    theirs = Tokenizer.from_file(path).normalizer.normalize_str("|".join(known)).split("|")
    ours = _normalised("|".join(known)).split("|")
    if len(theirs) != len(known) or len(ours) != len(known):
        raise ValueError("the normaliser changes its separator")
    out[[ord(c) for c, a, b in zip(known, theirs, ours, strict=True) if a != b]] = True
    return out


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """Merges of a byte-level vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{model['type']} is not BPE")
        self.vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.final = np.array([self.vocab[c + suffix] for c in alphabet], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.width = int(max(self.vocab.values())) + 1
        keys, rank = left * self.width + right, np.arange(len(pairs))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        # Where each symbol is made before it is used, a merge never opens a pair of lower rank, and all places of a
        # sequence's lowest pair may be merged in one round.
        born = np.full(self.width, -1, np.int64)
        np.maximum.at(born, made, rank)
        self.ordered = bool((np.maximum(born[left], born[right]) < rank).all())
        self.specials = [t["content"] for t in spec["added_tokens"]]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        size = np.array([len(t) for t in tokens], np.int64)
        out = np.zeros(len(tokens), np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbol = self.inner[raw]
        last = np.cumsum(size)[size > 0] - 1
        symbol[last] = self.final[raw[last]]
        owner = np.repeat(np.arange(len(tokens)), size)
        while len(symbol):
            rank = np.full(len(symbol), NO_RANK)
            joined = owner[:-1] == owner[1:]
            rank[:-1][joined] = self.rank_of(symbol[:-1][joined], symbol[1:][joined])
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.concatenate([first, [len(symbol)]]))
            done = low == NO_RANK
            out[owner[first[done]]] = length[done]
            live = np.repeat(~done, length)
            hit = live & (rank == np.repeat(low, length))
            at = np.flatnonzero(hit)
            if self.ordered:
                # Of overlapping places, each other one from the left: runs of neighbours keep their even members.
                run = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0)) if len(at) else at
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            symbol[at] = self.made[rank[at]]
            live[at + 1] = False
            symbol, owner = symbol[live], owner[live]
        return out


class TokenCounter:
    """Counts of whole texts."""

    def __init__(self, path: str, odd: np.ndarray | None = None):
        self.table = MergeTable(path)
        self.own = Tokenizer.from_file(path)
        self.odd = unsure(path) if odd is None else odd
        spec = json.loads(self.own.to_str())
        self.restated = spec["normalizer"] == NORMALISER and spec["pre_tokenizer"] == SPLIT
        self.bytes = {c: bytes([k]) for k, c in enumerate(byte_alphabet())}
        self.known: dict[str, int] = {}
        specials = self.table.specials
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(specials, key=len, reverse=True))) if specials else None
        self.sign = os.path.commonprefix(specials)

    @staticmethod
    def segments(text: str) -> list[str]:
        return SEGMENT.findall(text.lower() if text.isascii() else _normalised(text))

    def is_odd(self, text: str) -> bool:
        if not self.restated:
            return True
        return not text.isascii() and bool(self.odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def _by_library(self, text: str) -> int:
        """Count of a text that the library itself normalises and cuts."""
        cut = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text) if self.own.normalizer else text)
        return int(self.table.count([b"".join(map(self.bytes.__getitem__, piece)) for piece, _ in cut]).sum()) if cut else 0

    def counts(self, texts: list[str]) -> np.ndarray:
        cut, base = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            parts = [text]
            if self.special and self.sign in text and self.special.search(text):
                base[k] = len(self.special.findall(text))
                parts = self.special.split(text)
            if self.is_odd(text):
                base[k] += sum(map(self._by_library, parts))
                parts = []
            cut.append([s for part in parts for s in self.segments(part)])
        known = self.known
        new = list({s for segments in cut for s in segments if s not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list({s for segments in cut for s in segments})
            for s in range(0, len(new), 100_000):
                part = new[s : s + 100_000]
                known.update(zip(part, self.table.count([t.encode("utf-8") for t in part]).tolist(), strict=True))
        for k, segments in enumerate(cut):
            base[k] += sum(map(known.__getitem__, segments))
        return base


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _run(path: str, limit: int, odd: np.ndarray):
    def run(batches):
        counter = TokenCounter(path, np.unpackbits(odd).astype(bool))
        for whole in batches:
            for part, _, off in slices(whole, "text", 1 << 20):
                tokens = counter.counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(off[1:] - off[:-1]), pa.array(tokens), pa.array(tokens > limit)], schema=OUT)

    return lean(run)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row, as the vocabulary file's own library counts.

    No begin, end or added tokens; special strings inside a text count as one token each. Null and empty texts have 0.
    Null ids stay null; repeated rows get equal counts; other columns are not read; an empty table gives an empty one.
    ``path`` must be readable where the driver and the tasks run.
    """
    prepare(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(path, limit, np.packbits(unsure(path))), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
