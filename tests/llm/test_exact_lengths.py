"""Repeated passages of several lengths, one range split into many buckets, and codecs without byte fallback."""

import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import sentencepiece_codec, suffix_dedup, token_counts
from tests.llm import plain


@pytest.mark.parametrize(("length", "ranges"), [(32, 4096), (50, 1), (100, 3), (300, 4096)])
def test_lengths(spark, monkeypatch, length, ranges):
    monkeypatch.setattr(suffix_dedup, "RANGES", ranges)
    rng = random.Random(length)
    prose = lambda n: "".join(rng.choices("abcd ef", k=n))
    hot, warm = prose(3 * length), prose(length)
    rows = [(k, prose(rng.randint(0, 400)) + [hot, warm, hot[length // 3 :], warm * 3, ""][k % 5] + prose(rng.randint(0, 99))) for k in range(80)]
    rows += [(80, None), (81, ""), (82, "x" * 5 * length)]
    found = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=length).collect()}
    assert found == {k: sum(gone) for k, (_, gone) in plain.repeated(rows, length).items()} and sum(found.values())


@pytest.mark.parametrize("length", [0, 24, 1 << 20])
def test_other_lengths_are_refused(spark, length):
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=length)


def model_file(path, kind, pieces):
    """A SentencePiece model without byte fallback, written by hand: identity normaliser, dummy prefix, no squeezing."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda n, data: varint(n << 3 | 2) + varint(len(data)) + data
    number = lambda n, value: varint(n << 3) + varint(value)
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + number(3, k)) for p, s, k in pieces)
    body += field(2, number(3, kind)) + field(3, field(1, b"identity") + number(3, 1) + number(4, 0) + number(5, 1))
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize("kind", [sentencepiece_codec.UNIGRAM, sentencepiece_codec.BPE])
def test_unknown_characters(tmp_path, kind):
    m = sentencepiece_codec.MARK
    words = [m, "a", "b", "c", "ab", m + "a", "bc", m + "ab", m + "b", "abc", m + "abc", "ca"]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(w, -1.0 - k * 0.7 if kind == sentencepiece_codec.BPE else -2.0 - 0.3 * k + len(w), 1) for k, w in enumerate(words)]]
    path = model_file(tmp_path / "m.model", kind, pieces)
    own, coder = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    rng = random.Random(kind)
    texts = ["abé ca", "aé", "é", "é é é", "ééé abc", "", " ", "  a  b ", "a日本b 🙂", *["".join(rng.choices("abc é日 ", k=rng.randint(1, 40))) for _ in range(400)]]
    ids, same = coder.encode(texts)
    ids = [np.frombuffer(x, "<i4").tolist() for x in ids]
    assert ids == own.encode(texts)
    backend = [e.ids for e in coder.tokenizer.encode_batch([coder.normalise(t) for t in texts], add_special_tokens=False)]
    assert all(x == y for x, y, s in zip(ids, backend, same, strict=True) if s)
    assert sum(same) > len(texts) // 2


def test_characters_of_any_version():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, own, rng = token_counts.TokenCounter(path), Tokenizer.from_file(path), random.Random(7)
    odd = np.flatnonzero(counter.odd & (np.arange(0x110000) // 0x800 != 27)).tolist()
    texts = ["a₝b x", "x₝<|endoftext|>ΑΣ ΟΔΟΣ"]
    for _ in range(3000):
        texts.append("".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.choice(odd)])) for _ in range(rng.randint(1, 12))))
    assert counter.counts(texts).tolist() == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
