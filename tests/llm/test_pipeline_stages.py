"""Each pipeline stage on its own input; hot groups of the pair operators.

Near-duplicates and repeated passages are held against plain Python, encoding by round trip. Language and mixing are
held against their own operators' results only: that the stage keeps the rows which the operator says, unchanged.
"""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language_id, mixing, near_dup, quality_rules, sentencepiece_codec, suffix_dedup
from millrace.llm.common import held_out
from tests.llm import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, both as read back."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        out[name] = (docs, found)
        docs = found
    return out


def as_rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_all_but_the_last_return_documents(steps):
    for before, after in list(steps.values())[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes and 0 < after.count() <= before.count()


def test_language_stage(steps):
    before, after = steps["language_id"]
    known = language_id.identify(before, held_out(F.col("doc_id"))).where("lang_pred <> 'und'")
    wanted = {r["doc_id"] for r in known.collect()}
    rows, every = as_rows(after), as_rows(before)
    assert set(rows) == wanted and all(rows[k] == every[k] for k in rows)
    assert {k for k, r in every.items() if not any(c.isalpha() for c in r["text"] or "")}.isdisjoint(rows)


def test_near_duplicate_stage(steps):
    before, after = (as_rows(df) for df in steps["minhash_near_dedup"])
    found = plain.components({k: r["text"] for k, r in before.items()}, 5)
    assert after == {k: r for k, r in before.items() if found[k] == k}
    assert len(after) < len(before)


def test_repeated_passages_stage(steps):
    before, after = (as_rows(df) for df in steps["suffix_array_dedup"])
    expected = {}
    for k, (raw, gone) in plain.repeated((k, before[k]["text"]) for k in sorted(before)).items():
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        if rest or not raw:
            expected[k] = rest.decode("utf-8", "replace")
    assert {k for k, r in after.items() if r["text"] != before[k]["text"]}
    assert set(after) == set(expected)
    ascii_only = [k for k in after if (before[k]["text"] or "").isascii()]
    assert ascii_only and all(after[k]["text"] == expected[k] for k in ascii_only)
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_mixing_stage(spark, steps):
    before, after = steps["mixing"]
    drawn = mixing.mix_rates(before, spark.read.parquet(f"{SF}/labels.parquet")).where("copies >= 1")
    every = as_rows(before)
    assert as_rows(after) == {r["doc_id"]: every[r["doc_id"]] for r in drawn.collect()}


def test_encoding_stage(steps):
    before, after = steps["sentencepiece"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(after, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert back == {r["doc_id"]: r["text"] for r in before.collect()} and after.where("not parity").count() == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_hot_passage(spark, parts):
    """One passage in most texts, several times in some, cut and shifted in others, over one block or many."""
    rng = random.Random(parts)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    prose = lambda n: " ".join(word() for _ in range(n))
    hot, warm = prose(60), prose(30)
    texts = []
    for k in range(150):
        cut = rng.randint(0, 200)
        texts.append([hot, hot + hot, prose(9) + hot[cut:] + prose(9) + hot, prose(40), hot[:cut] + warm + hot[cut:], warm + prose(3) + warm][k % 6])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, F.xxhash64("doc_id"))
    found = as_rows(suffix_dedup.repeated_bytes(rows))
    for k, (raw, gone) in plain.repeated(enumerate(texts)).items():
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (found[k]["n_removed"], found[k]["kept_sha256"]) == (sum(gone), hashlib.sha256(rest).hexdigest())
        assert found[k]["n_spans"] == len([s for s in bytes(gone).split(b"\0") if s])


def test_large_groups_of_near_copies(spark):
    """A chain and a star of near copies, exact copies, and pairs on either side of the threshold."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    texts, now = {}, list(base)
    for k in range(60):
        texts[k] = " ".join(now)
        now = [*now]
        now[rng.randrange(200)] = f"c{k}"
    for k in range(60, 200):
        star = [*base]
        for _ in range(k % 9):
            star[rng.randrange(200)] = f"s{k}"
        texts[k] = " ".join(star)
    texts |= {k: texts[7].upper() for k in range(200, 260)}
    found = as_rows(near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)))
    assert {k: r["component_id"] for k, r in found.items()} == plain.components(texts, 4)


def test_ids_with_several_texts(spark):
    """Rows of one id tie the groups of all their texts, whichever of them is the greater."""
    rng = random.Random(11)
    one, two, far = ([f"{k}{rng.randint(0, 10**6)}" for _ in range(60)] for k in "uvw")
    near = lambda x: " ".join([*x[:59], "changed"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (7, near(one)), (8, near(two)), (9, " ".join(far)), (9, " ".join(far)), (None, " ".join(one)), (3, None), (4, near(far))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 4, False), (4, 4, True), (3, 3, True), (None, None, True)}


def test_words_that_meet_under_sums_of_powers(spark):
    """A Thue-Morse word and its complement are two words to all operators that compare hashes."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    filler = " ".join(f"w{k}" for k in range(3))
    rows = spark.createDataFrame([(1, f"{word}\n{other}"), (2, f"{word} {filler}"), (3, f"{other} {filler}"), (4, word[:400]), (5, other[:400])], "doc_id long, text string")
    found = as_rows(near_dup.near_duplicates(rows))
    assert {k: r["component_id"] for k, r in found.items()} == {k: k for k in range(1, 6)}
    judged = as_rows(quality_rules.quality_rules(rows.withColumn("lang", F.lit(None).cast("string"))))
    assert judged[1]["n_dup_lines"] == 0


@pytest.mark.parametrize("straight", [0, 64])
def test_crowded_keys(spark, monkeypatch, straight):
    """Texts that share most of their words but are not similar enough, among groups that are; by key and by rare shingle."""
    monkeypatch.setattr(near_dup, "STRAIGHT", straight)
    rng = random.Random(straight)
    common = [f"c{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for k in range(120):
        own = [f"o{rng.randint(0, 10**6)}" for _ in range(20 + k % 25)]
        texts[2 * k] = " ".join(common + own)
        texts[2 * k + 1] = " ".join(common[: 119 - k % 7] + own)
    found = as_rows(near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)))
    assert {k: r["component_id"] for k, r in found.items()} == plain.components(texts, 4)
    assert len({r["component_id"] for r in found.values()}) > 1
