"""Each operator on small tables with nulls, empty and long texts, repeats and clashing column names, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import archive_source, language_id, licenses, media, mixing, near_dup, quality_cnn, quality_rules, sentencepiece_codec, suffix_dedup, token_counts
from millrace.llm.common import held_out

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage = prose(120), prose(60)
    out = [None, "", " \n", "a", "Short one", base, base, base + " " + prose(3), prose(40) + passage + prose(30), prose(20) + "\n" + passage, "ab " * 400, "x" * 5000, prose(30000)]
    out += ["one\none\n\ntwo # $\none", "日本語 テキスト 🙂", "<|endoftext|> DON'T 123", "All rights reserved.\n" + prose(30), "Released under the MIT License. " + prose(20)]
    for k in range(40):
        words = base.split()
        words[k] = "changed"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", 1, True, 5) for k, t in enumerate(texts)]
    rows += [(None, "no id " * 5, None, None, None, None, None), (5, texts[5], "en", "s", 1, True, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long"
    return spark.createDataFrame(rows, schema).repartition(5)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, docs):
    none, labels = docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path, bpe = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    found = [media.media_features(none), quality_rules.quality_rules(none), quality_cnn.classify(none, labels, held_out(F.col("doc_id"))), suffix_dedup.repeated_bytes(none), sentencepiece_codec.encode_digests(none, path)]
    found += [licenses.scan(none), token_counts.token_counts(none, bpe), near_dup.near_duplicates(none), language_id.identify(none, held_out(F.col("doc_id"))), mixing.mix_rates(none, labels)]
    assert [df.count() for df in found] == [0] * 10


def test_media_columns(docs, texts):
    found = media.media_features(docs)
    assert found.count() == len(texts) + 2 and found.where("error is not null").count() == 0
    for k, r in by_id(found).items():
        raw = ("no id " * 5 if k is None else texts[k] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_members_are_retried_alone(spark, docs, tmp_path):
    folder = media.write_archives(docs.coalesce(1), "doc_id", "text", str(tmp_path / "media"))
    reader = archive_source.MediaArchiveReader({"path": folder, "rangeBytes": "2000"})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) > 1 and len(rows) == docs.count() and len({r["offset"] for r in rows}) == len(rows)
    archive = next((tmp_path / "media").glob("*.zip"))
    body = bytearray(archive.read_bytes())
    body[rows[3]["offset"] + 60] ^= 255
    archive.write_bytes(body)
    again = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] is not None for r in again] == [k == 3 for k in range(len(rows))]


def test_quality_rules(docs, texts):
    for k, r in by_id(quality_rules.quality_rules(docs)).items():
        if k is None:
            continue
        t = texts[k] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r["kept"])


def test_divergence_is_a_bounded_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.divergence(p, q)[0] == pytest.approx(1) and quality_rules.divergence(p, p[0])[0] == 0


def test_quality_classifier(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_cnn.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, held_out(F.col("doc_id"))).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and found.score.between(0, 1).all()


def test_suffix_array_dedup(docs, texts):
    unique = docs.where("n_chars is null or true").dropDuplicates(["doc_id"])
    found, seen = by_id(suffix_dedup.repeated_bytes(unique)), set()
    for k, text in [*enumerate(texts), (None, "no id " * 5)]:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = raw[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        r = found[k]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(raw), sum(gone), hashlib.sha256(rest).hexdigest())
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id = 0").first()["text"] is None


def test_near_duplicates(docs, texts):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall((t or "").translate(low))
        sets[k] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    parent = {k: k for k in sets}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    found = near_dup.near_duplicates(docs)
    assert found.count() == len(texts) + 2
    for k, r in by_id(found).items():
        expected = (None, True) if k is None else (parent[k], parent[k] == k)
        assert (r["component_id"], r["kept"]) == expected and (k is None or r["n_shingles"] == len(sets[k]))


def test_sentencepiece(docs, texts):
    coder = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    hard = [*[t or "" for t in texts], "  a  b   c ", "▁▁a ▁b", " ", "a\nb\tc", "<s> </s> <0x41>"]
    ids, same = coder.encode(hard)
    ids = [np.frombuffer(i, "<i4").tolist() for i in ids]
    assert all(same) and ids == coder.own.encode(hard) and coder.decode(ids) == coder.tokenizer.decode_batch(ids, skip_special_tokens=False)
    found = by_id(sentencepiece_codec.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model")))
    assert all(r["parity"] and r["round_trip"] for r in found.values()) and found[0]["n_tokens"] == 0


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    hard = [*[t or "" for t in texts], "ΑΣ ΟΔΟΣ", "don't I'LL", "é İstanbul ß", "a" * 3000, "\x1ca\x85b　c", "!?" * 500]
    own = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(hard, add_special_tokens=False)]
    assert token_counts.TokenCounter(path).counts(hard).tolist() == own
    found = by_id(token_counts.token_counts(docs, path))
    assert [found[k]["n_tokens"] for k in range(len(texts))] == own[: len(texts)]


def test_license_scans(spark, docs, texts):
    for text in licenses.SENTENCES.values():
        assert re.search(licenses.HINT, text.lower())
    full = "\n".join(licenses.SENTENCES[k] for k in ("mit.grant", "mit.notice", "mit.warranty", "mit.liability"))
    more = spark.createDataFrame([(900, full.replace(" the ", "\nthe ")), (901, "SPDX-License-Identifier: MIT"), (902, licenses.SENTENCES["mit.grant"])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).unionByName(more)
    found = licenses.scan(rows).toPandas().sort_values("doc_id").reset_index(drop=True)
    got = found.set_index("doc_id").licences
    assert (got[900], got[901], got[902], got[16], got[17], got[0]) == ("MIT", "MIT", "", "All-Rights-Reserved", "MIT", "")
    documents = rows.toPandas()  # noqa: F841
    expected = duckdb.sql(licenses.oracle()).df().sort_values("doc_id").reset_index(drop=True)[found.columns]
    assert found[found.doc_id.notna()].astype(str).equals(expected[expected.doc_id.notna()].astype(str))


def test_language_id(spark, docs):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(given, held_out(F.col("doc_id"))).join(given.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found[found.held_out].lang_pred == found[found.held_out].lang).mean() > 0.97
    small = by_id(language_id.identify(docs, held_out(F.col("doc_id"))))
    assert [small[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and small[14]["lang_pred"] != "und"
    assert language_id.keep_identified(docs, held_out(F.col("doc_id"))).columns == docs.columns


def test_mixing(spark, docs):
    given, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = mixing.mix_rates(given, labels).toPandas()
    shares = [(found.rate * found.tokens * found[f"p_{d}"]).sum() / found.tokens.sum() for d in mixing.DOMAINS]
    assert shares == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], abs=2e-3) and (found.rate >= 0).all()
    few = mixing.mix_rates(docs, labels.where("false"))
    assert few.count() == docs.count() and mixing.keep_drawn(docs, labels.where("false")).columns == docs.columns
