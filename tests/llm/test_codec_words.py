"""The codec by distinct word: texts put together from words are what both libraries make of whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_exact_lengths import model_file

from millrace.llm import sentencepiece_codec
from millrace.llm.sentencepiece_codec import BPE, MARK, UNIGRAM, Codec

PARTS = ["\n", " ", "  ", MARK, "é", "日", "🙂", "ab", "the", " and", ".\n", "\r\n", "\t", "<0x0A>", "<unk>", "\0", "...", "</s>"]


def some_texts(parts, n, rng):
    hard = ["", "\n", "\n\n", " \n", "\n ", "a\n", "\na", " ", MARK, f"a\n{MARK}b", "é\né", "日\n\n🙂", "a  \nb", "a "]
    return hard + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(n)]


def check(coder, own, texts):
    ids, same, back = coder.there_and_back(texts)
    ids = [np.frombuffer(x, "<i4").tolist() for x in ids]
    ours = [e.ids for e in coder.tokenizer.encode_batch([coder.normalise(t) for t in texts], add_special_tokens=False)]
    assert ids == own.encode(texts) and back == coder.decode(ids)
    assert all(x == y for x, y, s in zip(ids, ours, same, strict=True) if s)
    return same


@pytest.mark.parametrize("together", [3, 200])
def test_words_of_a_large_model(monkeypatch, together):
    monkeypatch.setattr(sentencepiece_codec, "TOGETHER", together)
    coder = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(check(coder, coder.own, some_texts(PARTS, 3000, random.Random(together))))


def test_line_breaks_part_words():
    """Words on either side of a line break are learned once, not once for each pair."""
    coder = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    names = [f"name{chr(97 + k)}" for k in range(20)]
    assert all(check(coder, coder.own, [f"{a}\n{b}" for a in names for b in names]))
    assert len(coder.known) == 40


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
def test_words_that_decode_to_something_else(tmp_path, kind):
    """Without fallback bytes, unknown characters, line breaks among them, do not come back."""
    words = [MARK, "a", "b", MARK + "a", "ab", MARK + "ab"]
    path = model_file(tmp_path / "m.model", kind, [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(w, -1.0 - k, 1) for k, w in enumerate(words)]])
    coder, rng = Codec(path), random.Random(kind)
    check(coder, sentencepiece.SentencePieceProcessor(model_file=path), some_texts(["a", "b", "é", "日", "\n", " ", "  ", MARK], 400, rng))
    assert coder.changed and not coder.lines


def test_decoding_after_encoding_alone():
    coder = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    ids, _ = coder.encode(["one two\nthree"])
    assert coder.there_and_back(["one two\nthree"])[::2] == (ids, ["one two\nthree"])
