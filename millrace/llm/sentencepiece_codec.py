"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores and byte fallback are rebuilt from it, for
unigram and BPE models. Texts are cut where no piece can reach across: before each run of markers and, if line breaks
are only ever fallback bytes, before each line break. The distinct words that are new to a task are encoded together by
the library's threads, and their ids are decoded by the backend. Parity is verified on each of them: the
model's own library encodes every such word too (or every whole text, where a model cannot be cut). Where the two
differ, ``parity`` is false for all texts that hold the word, and the own library's ids are used.
"""

from __future__ import annotations

import hashlib
import re
import struct
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers

from millrace.llm.common import lean, prepare, slices

MARK = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBERED, TOGETHER = 600_000, 200
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LINE_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def _fields(data: bytes):
    """(field number, value) of a protobuf message; lengths, fixed and variable integers."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


class ModelFile:
    """What encoding needs of a SentencePiece model file. Field numbers are those of its public schema."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_mark = bool(trainer.get(24, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        if self.suffix_mark or not self.escape or any(p[2] == USER_DEFINED for p in self.pieces):
            raise ValueError("models with suffix marks, plain spaces or user-defined pieces are not supported")


class Codec:
    def __init__(self, path: str):
        self.model = m = ModelFile(path)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        vocab = {piece: k for k, (piece, _, _) in enumerate(m.pieces)}
        usable = {piece for piece, _, kind in m.pieces if kind == NORMAL}
        unknown = next(piece for piece, _, kind in m.pieces if kind == UNKNOWN)
        if m.kind == BPE:
            merges = []
            for k, (piece, score, kind) in enumerate(m.pieces):
                if kind == NORMAL:
                    merges += [(-score, k, i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in usable and piece[i:] in usable]
            backend = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback)
        elif m.kind == UNIGRAM:
            backend = models.Unigram([(piece, score) for piece, score, _ in m.pieces], vocab[unknown], m.byte_fallback)
        else:
            raise ValueError(f"model type {m.kind}")
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(re_spaces(), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        self.normaliser = normalizers.Sequence(steps)
        self.plain = not m.charsmap and not m.squeeze
        self.tokenizer = Tokenizer(backend)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        # No piece goes on with a mark after another character, so texts may be cut before each run of marks.
        self.cut = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in usable)
        # A word alone and within its text are the same to the own library only if normalising leaves it as it is.
        self.by_word = self.cut and self.plain and m.dummy_prefix and MARK in usable
        # A line break that stands in no piece becomes its fallback byte, and nothing reaches across it.
        self.lines = self.by_word and m.byte_fallback and sum(kind == BYTE for *_, kind in m.pieces) == 256 and not any("\n" in piece for piece, _, kind in m.pieces if kind in (NORMAL, UNUSED))
        self.unknown = vocab[unknown]
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        # Words whose ids decode to something else, if all known words have been decoded.
        self.changed: dict[str, str] = {}
        self.decoded = True
        # Characters that an id stands for: a fallback byte counts if it begins a character.
        self.width = np.array([(kind != BYTE or not 0x80 <= int(piece[3:-1], 16) < 0xC0) * (1 if kind == BYTE else len(piece)) for piece, _, kind in m.pieces], np.int64)

    def forget(self) -> None:
        """Drop what was learned from texts, so that an idle process holds no memory for it."""
        self.known.clear()
        self.odd.clear()
        self.changed.clear()
        self.decoded = True

    def normalise(self, text: str) -> str:
        if self.plain:
            return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)
        return self.normaliser.normalize_str(text)

    def _cut(self, text: str) -> list[str]:
        """Words of a text, in order. Where texts run by word, a word that begins with a mark is held without this mark."""
        if not self.by_word:
            whole = self.normalise(text)
            return _WORD.findall(whole) if self.cut else [whole] * bool(whole)
        if "  " in text or text[:1] == " " or MARK in text:
            # Runs of marks stay together.
            return [w if w[0] == "\n" else w[1:] for w in (_LINE_WORD if self.lines else _WORD).findall(self.normalise(text))]
        if self.lines:
            text = text.replace("\n", " \n")
        return text.split(" ") if text else []

    def _after_mark(self, word: str) -> bool:
        return not (self.lines and word[:1] == "\n")

    def _plain(self, word: str) -> str:
        """What a word stands for in a text."""
        return " " + word.replace(MARK, " ") if self._after_mark(word) else word

    def _learn(self, words: list[str], decode: bool) -> None:
        """Encode new words, and decode them; where texts can be cut, ``TOGETHER`` words run as one text and their ids are parted again."""
        if not self.by_word:
            for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
                self.known[word] = pack(f"<{len(e.ids)}i", *e.ids)
            return
        self.decoded &= decode or not words
        alone = []
        # Runs of marks alone would grow into the next word.
        for word in [w for w in words if w[-1:] in ("", MARK)]:
            ids, own = self.tokenizer.encode(MARK + word, add_special_tokens=False).ids, self.own.encode(" " * len(word)) if word else [self.own.piece_to_id(MARK)]
            if ids != own:
                self.odd.add(word)
            self.known[word] = pack(f"<{len(own)}i", *own)
            alone.append(word)
        words = [w for w in words if w[-1:] not in ("", MARK)]
        for rows in ([w for w in words if self._after_mark(w)], [w for w in words if not self._after_mark(w)]):
            groups = [rows[s : s + TOGETHER] for s in range(0, len(rows), TOGETHER)]
            for s in range(0, len(groups), 1000):
                alone += self._learn_groups(groups[s : s + 1000], decode)
        if decode:
            for word, back in zip(alone, self.decode([np.frombuffer(self.known[w], "<i4").tolist() for w in alone]), strict=True):
                # The decoder drops the mark in front.
                if (back := " " + back if self._after_mark(word) else back) != self._plain(word):
                    self.changed[word] = back

    def _learn_groups(self, groups: list[list[str]], decode: bool) -> list[str]:
        """Groups of words that all begin with a mark, or all with a line break; the latter follow a mark of their own.

        Returns the words that are still to be decoded one by one: those of groups that do not decode to what they were
        made from, with as many characters for each word. The others decode to themselves.
        """
        marked = self._after_mark(groups[0][0])
        parts = [[MARK + w for w in g] if marked else [MARK, *g] for g in groups]
        joined = ["".join(p) for p in parts]
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        theirs = self.own.encode([j[1:].replace(MARK, " ") for j in joined], num_threads=1)
        backs, alone = self.decode(theirs) if decode else [None] * len(groups), []
        for group, part, whole, ids, own, back in zip(groups, parts, joined, ours, theirs, backs, strict=True):
            if self.unknown in ids or self.unknown in own:
                # An unknown id does not tell how many characters it stands for, so these words go one by one.
                self._learn_each(group)
                alone += group
                continue
            ids_of, even = self._parted(part, own)
            if ids != own:
                self.odd.update(w for w, a, b in zip(group, ids_of[not marked :], self._parted(part, ids)[0][not marked :], strict=True) if a != b)
            self.known.update(zip(group, ids_of[not marked :], strict=True))
            if not even or back != whole[1:].replace(MARK, " "):
                alone += group
        return alone

    def _learn_each(self, words: list[str]) -> None:
        """Words encoded alone by both libraries; the own library adds the mark that each word begins with."""
        ours = self.tokenizer.encode_batch_fast([MARK + w for w in words], add_special_tokens=False)
        for word, e, own in zip(words, ours, self.own.encode([w.replace(MARK, " ") for w in words], num_threads=1), strict=True):
            if e.ids != own:
                self.odd.add(word)
            self.known[word] = pack(f"<{len(own)}i", *own)

    def _parted(self, group: list[str], ids: list[int]) -> tuple[list[bytes], bool]:
        """Ids of each word of a joined text, by the characters that ids stand for, and whether those add up for each word."""
        own = np.array(ids, "<i4")
        upto, wanted = np.cumsum(self.width[own]), np.cumsum([len(w) for w in group])
        ends = np.searchsorted(upto, wanted, side="right")
        # Ids without a character of their own (continuation bytes) go with the character before.
        raw, out, at = own.tobytes(), [], 0
        for end in (4 * ends).tolist():
            out.append(raw[at:end])
            at = end
        return out, bool(ends[0]) and bool((upto[ends - 1] == wanted).all())

    def _encode(self, texts: list[str], decode: bool = False) -> tuple[list[list[str]], list[bytes], list[bool]]:
        cut = list(map(self._cut, texts))
        distinct, known = set().union(*cut), self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            self.forget()
            new = list(distinct)
        self._learn(new, decode)
        near = {w: known[w] for w in distinct}  # smaller than all that is known, so it stays in the processor's cache
        ids = [b"".join(map(near.__getitem__, words)) for words in cut]
        if self.by_word:
            return cut, ids, [not self.odd or self.odd.isdisjoint(words) for words in cut]
        theirs = [np.array(i, "<i4").tobytes() for i in self.own.encode(texts, num_threads=1)]
        same = [a == b for a, b in zip(ids, theirs, strict=True)]
        return cut, [a if s else b for a, b, s in zip(ids, theirs, same, strict=True)], same

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text as little-endian 32-bit numbers, and whether both libraries agree on it."""
        return self._encode(texts)[1:]

    def there_and_back(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[str]]:
        """As ``encode``, and the texts that the ids decode to; where texts run by word, new words are decoded, and texts put together.

        Words begin at tokens and hold whole characters, so neither a piece nor a run of fallback bytes that makes one
        character crosses from one word to the next. If every word of a text decodes to itself, the text does.
        """
        if not self.decoded:
            self.forget()
        cut, ids, same = self._encode(texts, True)
        if not self.by_word:
            return ids, same, self.decode([np.frombuffer(i, "<i4").tolist() for i in ids])
        changed, back = self.changed, []
        for text, words in zip(texts, cut, strict=True):
            if MARK in text or changed and not changed.keys().isdisjoint(words):
                text = "".join([changed[w] if w in changed else self._plain(w) for w in words])[1:]
            back.append(text)
        return ids, same, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids, by the backend's decoder: marks as spaces, fallback bytes joined, without the dummy prefix."""
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def re_spaces():
    from tokenizers import Regex

    return Regex(" {2,}")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model and process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _digests(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])

    def run(batches):
        coder = codec(path)
        for whole in batches:
            for part, _, off in slices(whole, "text", 1 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, same, back = coder.there_and_back(texts)
                columns = [part.column("doc_id").cast(pa.int64()), off[1:] - off[:-1], [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids]]
                columns += [[hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back], [a == b for a, b in zip(texts, back, strict=True)], same]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        coder.forget()

    return lean(run)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, ids_sha256, decoded_sha256, round_trip, parity)`` for each row.

    Ids are hashed as little-endian 32-bit numbers. Null and empty texts have no ids and decode to the empty text.
    Null ids stay null; repeated rows give equal rows; other columns are not read; an empty table gives an empty table.
    """
    prepare(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean")


def _ids(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("parity", pa.bool_())])

    def run(batches):
        coder = codec(path)
        for whole in batches:
            for part, _, _ in slices(whole, "text", 1 << 20):
                ids, same = coder.encode([t or "" for t in part.column("text").to_pylist()])
                size = np.array([len(i) // 4 for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                columns = [part.column("doc_id").cast(pa.int64()), part.column("lang"), part.column("source"), pa.array(size), lists, pa.array(same)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        coder.forget()

    return lean(run)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, token_ids, parity)`` for each row of a documents table; nulls as above."""
    prepare(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_ids(path), "doc_id long, lang string, source string, n_tokens long, token_ids array<int>, parity boolean")


def _texts(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        coder = codec(path)
        for batch in batches:
            back = coder.decode([x or [] for x in batch.column("token_ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(back, pa.string())], schema=schema)

    return lean(run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give the empty text."""
    prepare(encoded)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(_texts(path), "doc_id long, text string")
