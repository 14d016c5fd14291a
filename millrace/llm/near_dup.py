"""Near-duplicate documents: multi-index Hamming join over b-bit MinHash signatures, then exact confirmation.

A document's set holds its distinct word shingles. ``PERMUTATIONS`` minima of ``BITS`` bits each form its signature,
cut into ``CHUNKS`` chunks. Two signatures that differ in at most ``2 * CHUNKS - 1`` of the values have, by the
pigeonhole principle, one chunk with at most one differing value. Every document is indexed under each chunk with each
single value left out, so every such pair meets under some key. The chance that two documents at a similarity of
exactly 0.8 share no key is 0.18 ** 8, about one in a million, and it falls fast above.

Links are confirmed on full sets, kept as lists of shingle hashes and compared inside Spark. Equal sets are one class
from the start, named by one of its rows. Inside a key, classes are first compared with one leader, in a few rounds with
other leaders, so a large group of copies costs a few comparisons for each member and never all pairs. What a key then
still holds besides its largest component is compared with all classes of the key. Where that is more than ``STRAIGHT``
classes, the key is hot: more rounds with leaders follow while they help, and what is left meets by rarer things, since
sets that are similar enough share one of the rarest shingles of each (prefix filtering). No step loses a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import discard, lean, materialise, prepare, slices
from millrace.llm.components import connected_components

PERMUTATIONS, BITS, CHUNKS = 32, 16, 8
STAR_ROUNDS, CROWDED_ROUNDS, PARITY_BITS, FOLDED_BITS, STRAIGHT, TOKEN_BITS, RANGE_BITS = 2, 2, 1024, 256, 64, 18, 6
PER_CHUNK = PERMUTATIONS // CHUNKS
_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_KEY = _rng.integers(1, 1 << 63, (CHUNKS, PER_CHUNK, PER_CHUNK), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, and offsets by text. A text of fewer words is one shingle of all of them."""
    n = len(off) - 1
    start, end, text_no = K.words(data, off)
    hashes = K.span_digest(K.LOWER_ASCII[data], start, end)
    full, first = K.word_windows(hashes, text_no, width)
    owner = text_no[first]
    have = K.counts_by_text(text_no, n)
    begin = np.concatenate([[0], np.cumsum(have)])
    for length in range(1, width):
        short = np.flatnonzero(have == length)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(length):
                total += hashes[begin[short] + k] * np.uint64(pow(K._BASE, 2 * k + 1, 1 << 64))
            full = np.concatenate([full, K.mix(total + np.uint64(length))])
            owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return full[order], np.concatenate([[0], np.cumsum(K.counts_by_text(owner, n))])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The b-bit minima of a non-empty set."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 8192):
        low = np.minimum(low, (shingles[None, s : s + 8192] * _A[:, None] + _B[:, None]).min(axis=1))
    return K.mix(low) >> np.uint64(64 - BITS)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature: a key for each chunk and each value of the chunk that may differ."""
    parts = signatures.reshape(-1, CHUNKS, PER_CHUNK)
    keys = np.empty((len(parts), CHUNKS, PER_CHUNK), np.uint64)
    for out in range(PER_CHUNK):
        rest = [i for i in range(PER_CHUNK) if i != out]
        keys[:, :, out] = (parts[:, :, rest] * _KEY[None, :, out, : len(rest)]).sum(axis=2) + _KEY[None, :, out, -1]
    return K.mix(keys.reshape(len(parts), -1)).view(np.int64)


SKETCH = "row long, doc_id long, version long, n_shingles long, s1 long, s2 long, keys array<long>, parity array<long>"


def _sketch(width: int):
    schema = pa.schema([*[(k, pa.int64()) for k in ("row", "doc_id", "version", "n_shingles", "s1", "s2")], ("keys", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                hashes, begin = shingle_hashes(data, off, width)
                n = part.num_rows
                sizes, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                parity = np.zeros((n, PARITY_BITS // 64), np.int64)
                signatures, full = np.zeros((n, PERMUTATIONS), np.uint64), np.zeros(n, bool)
                for i in range(n):
                    if begin[i + 1] > begin[i]:
                        own = np.unique(hashes[begin[i] : begin[i + 1]])
                        sizes[i], full[i] = len(own), True
                        s1[i] = own.sum(dtype=np.uint64).view(np.int64)
                        s2[i] = K.mix(own ^ np.uint64(K._BASE)).sum(dtype=np.uint64).view(np.int64)
                        signatures[i] = signature(own)
                        odd = np.bincount((own & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
                        parity[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                keys = index_keys(signatures[full])
                lengths = np.where(full, keys.shape[1], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(keys.ravel()))
                parities = pa.FixedSizeListArray.from_arrays(pa.array(parity.ravel()), PARITY_BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("version"), pa.array(sizes), pa.array(s1), pa.array(s2), lists, parities], schema=schema)
                row += n

    return lean(run)


def _whole_sets(width: int):
    schema = pa.schema([("class", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for part, data, off in slices(whole, "text"):
                hashes, begin = shingle_hashes(data, off, width)
                own = [np.unique(hashes[s:e]) for s, e in zip(begin[:-1], begin[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("class"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))], schema=schema)

    return lean(run)


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(class, hashes)`` from the text of one row of each class; rows that repeat an id and its text are one."""
    texts = docs.where("doc_id is not null").groupBy("doc_id", "version").agg(F.max("text").alias("text"))
    return texts.join(wanted, ["doc_id", "version"]).select("class", "text").mapInArrow(_whole_sets(width), "class long, hashes array<long>")


def _judged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``linked``: whether full sets are similar enough. Sets of ``b``, where leaders stand, are joined last and not shuffled on."""
    one = sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb")).cast("long")
    sizes = F.size("ha").cast("long") + F.size("hb")
    linked = ((100 + percent) * common >= percent * sizes).alias("linked")
    return pairs.join(one, "a").join(two, "b").select(*pairs.columns, linked)


def _star_pairs(placed: DataFrame, turn: int) -> DataFrame:
    """Each class (a) against one leader (b) of each key where it is not yet in the leader's component; another each turn.

    Leaders come first in one order of all classes, so that keys with the same classes have the same leader.
    """
    rank = F.col("class") if turn == 0 else F.xxhash64("class", F.lit(turn))
    leads = placed.where("not other") if "other" in placed.columns else placed
    lead = leads.groupBy("key").agg(F.min_by("class", rank).alias("b"), F.min_by("component", rank).alias("cb"))
    return placed.join(lead, "key").where("component <> cb").select(F.col("class").alias("a"), "b", F.col("component").alias("ca"), "cb").distinct()


def _relabelled(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components after new links: each takes the smallest one that it is linked with. Equal labels are always connected."""
    new = pairs.where("linked").select(F.greatest("ca", "cb").alias("component"), F.least("ca", "cb").alias("to"))
    to = new.groupBy("component").agg(F.min("to").alias("to"))
    return placed.join(to, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")


def _possible(percent: int, left: str = "pa", right: str = "pb", bits: int = PARITY_BITS) -> str:
    """What two sets must meet to be similar enough, without loss.

    The intersection is at most the smaller set and the union at least the larger. Bits that differ between the sets'
    parity maps are at most as many as shingles that only one of them has.
    """
    differ = " + ".join(f"bit_count({left}[{i}] ^ {right}[{i}])" for i in range(bits // 64))
    return f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {100 + percent} * ({differ}) <= {100 - percent} * (na + nb)"


def _folded(parity: str) -> Column:
    """A smaller parity map from a larger one: bits that fall together are added without carry."""
    words, kept = PARITY_BITS // 64, FOLDED_BITS // 64
    return F.expr(f"array({', '.join(' ^ '.join(f'{parity}[{i}]' for i in range(k, words, kept)) for k in range(kept))})")


def _could_match(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    one, two = (facts.select(F.col("class").alias(k), F.col("n").alias("n" + k), F.col("parity").alias("p" + k)) for k in "ab")
    return pairs.join(one, "a").join(two, "b").where(_possible(percent)).select(*pairs.columns)


def _apart(rows: DataFrame) -> DataFrame:
    """Rows with a ``key`` and a ``component``, of keys with several components, and ``other``: not in the key's largest one."""
    held = rows.groupBy("key", "component").agg(F.count("*").alias("members"))
    main = held.groupBy("key").agg(F.max(F.struct("members", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return rows.join(main.select("key", F.col("most.component").alias("main")), "key").withColumn("other", F.col("component") != F.col("main")).drop("main")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a key and no component; one of the two is not in the key's largest component."""
    left = rows.where("other").select("key", F.col("class").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("folded").alias("fa"))
    right = rows.select("key", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("folded").alias("fb"), "other")
    near = f"ca <> cb and (a < b or not other) and {_possible(percent, 'fa', 'fb', FOLDED_BITS)}"
    return left.join(right, "key").where(near).select("a", "b").distinct()


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)


def _packed(total: np.ndarray) -> pa.RecordBatch:
    """One row for each of the ``2 ** RANGE_BITS`` ranges of bins that has counts: its bins and their counts."""
    full = np.flatnonzero(total)
    ranges, first = np.unique(full >> (TOKEN_BITS - RANGE_BITS), return_index=True)
    begin = pa.array(np.append(first, len(full)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.ListArray.from_arrays(begin, pa.array(full.astype(np.int32))), pa.ListArray.from_arrays(begin, pa.array(total[full]))], names=["range", "bins", "n"])


@lean
def _token_counts(batches):
    total = np.zeros(1 << TOKEN_BITS, np.int64)
    for batch in batches:
        total += np.bincount(_bin(np.asarray(batch.column("hashes").flatten()).view(np.uint64)), minlength=len(total))
    yield _packed(total)


@lean
def _summed_counts(batches):
    total = np.zeros(1 << TOKEN_BITS, np.int64)
    for batch in batches:
        np.add.at(total, np.asarray(batch.column("bins").flatten()), np.asarray(batch.column("n").flatten()))
    yield _packed(total)


def _bin_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bin; each task sends one row a range of bins, however many it has read."""
    schema = "range int, bins array<int>, n array<long>"
    found = sets.select("hashes").mapInArrow(_token_counts, schema).repartition(1 << RANGE_BITS, "range").mapInArrow(_summed_counts, schema).toArrow()
    counts = np.zeros(1 << TOKEN_BITS, np.int64)
    for bins, n in zip(found.column("bins").chunks, found.column("n").chunks, strict=True):
        counts[np.asarray(bins.flatten())] = np.asarray(n.flatten())
    return counts


def _rarest(shared, percent: int):
    schema = pa.schema([(k, pa.int64()) for k in ("key", "class", "component")] + [("folded", pa.list_(pa.int64())), ("n", pa.int64()), ("place", pa.int64()), ("lead", pa.bool_())])

    def run(batches):
        counts = shared.value
        for batch in batches:
            keys, rows, sizes, places, leads = ([] for _ in range(5))
            for i, own in enumerate(batch.column("hashes")):
                own = np.asarray(own.values).view(np.uint64)
                often, n = counts[_bin(own)], len(own)
                first = np.lexsort((own, often))[: n - -(-n * percent // 100) + 1]
                place = np.flatnonzero(often[first] > 1)  # a bin with one shingle is met by no other set
                keys.append(own[first[place]].view(np.int64)), rows.append(np.full(len(place), i))
                sizes.append(np.full(len(place), n)), places.append(place + 1)
                leads.append(place + 1 <= n + (-2 * percent * n // (100 + percent)) + 1)
            if keys:
                at = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(keys)), *[batch.column(k).take(at) for k in ("class", "component", "folded")], *[pa.array(np.concatenate(x)) for x in (sizes, places, leads)]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return lean(run)


def _rare(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each class with its rarest shingles as keys, and the place of each: as many as any similar set may force.

    The order is by how many shingles of all these sets fall into a shingle's bin, the fewest first; any order that is
    the same for all sets is right. At most ``2 ** TOKEN_BITS`` counts are broadcast. Two sets of ``na`` and ``nb``
    shingles that are similar enough have ``c >= percent * (na + nb) / (100 + percent)`` in common, so one of those is
    among the first ``na - c + 1`` of the one set and among the first ``nb - c + 1`` of the other. ``lead``: the place
    may count for the smaller set of a pair, whose partner is at least as large.
    """
    held = classes.join(sets, "class").select("class", "component", "folded", "hashes")
    shared = sets.sparkSession.sparkContext.broadcast(_bin_counts(held))
    return held.mapInArrow(_rarest(shared, percent), "key long, class long, component long, folded array<long>, n long, place long, lead boolean")


def _across_rare(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of several components that meet at a place which both sizes allow; the smaller set is ``a``."""
    left = tokens.where("lead").select("key", "other", F.col("class").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("at_a"), F.col("folded").alias("fa"))
    right = tokens.select("key", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("at_b"), F.col("folded").alias("fb"), F.col("other").alias("other_b"))
    common = f"ceil({percent} * (na + nb) / {100 + percent})"
    near = f"ca <> cb and (na < nb or na = nb and a < b) and {_possible(percent, 'fa', 'fb', FOLDED_BITS)} and at_a <= na - {common} + 1 and at_b <= nb - {common} + 1"
    found = left.where("other").join(right, "key").where(near).select("a", "b")
    return found.unionByName(left.where("not other").join(right.where("other_b"), "key").where(near).select("a", "b")).distinct()


def _hot(rows: DataFrame) -> DataFrame:
    return rows.where("other").groupBy("key").agg(F.count("*").alias("others")).where(F.col("others") > STRAIGHT).select("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Null and empty texts, and texts without words,
    have an empty set: size 0, linked with nothing, kept. A row with a null id links with nothing, has a null
    component and is kept. Rows that repeat an id are one node with all their texts: what one of them links with, the
    others do; each row has the size of its own text. An empty table gives an empty table. Other columns, whatever their
    names, are not read. A component is named by its smallest id, which is the one kept.
    """
    spark = prepare(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    sketched = materialise(docs.mapInArrow(_sketch(width), SKETCH), "sketched")
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    low = some.groupBy("n_shingles", "s1", "s2").agg(F.min(F.struct("row", "doc_id", "version", "keys", "parity")).alias("low"), F.min("doc_id").alias("smallest"))
    classes = materialise(low.select("n_shingles", "s1", "s2", F.col("low.row").alias("class"), "low.doc_id", "low.version", "low.keys", "low.parity", "smallest"), "classes")
    entries = classes.select("class", F.explode("keys").alias("key"))
    facts = classes.select("class", F.col("n_shingles").alias("n"), "parity")
    shared = entries.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    met = materialise(entries.join(shared, "key"), "met")
    wanted = classes.select("class", "doc_id", "version").join(met.select("class").distinct(), "class")
    sets = materialise(_sets_of(docs, wanted, width), "sets")
    tested, kept = None, []

    def judge(pairs: DataFrame) -> DataFrame:
        """New pairs, told apart by their full sets; nothing is compared twice."""
        nonlocal tested
        if tested is not None:
            before = tested.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            pairs = pairs.join(before, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
        done = materialise(_judged(pairs, sets, percent), "pairs")
        kept.append(done)
        tested = done.select("a", "b", "linked") if tested is None else tested.unionByName(done.select("a", "b", "linked"))
        return done

    placed = met.withColumn("component", F.col("class"))
    for turn in range(STAR_ROUNDS):
        done = judge(_could_match(_star_pairs(placed, turn), facts, percent))
        last, placed = placed, materialise(_relabelled(placed, done), "placed")
        discard(last)

    # The classes that share a key and still not a component: the rest of the comparisons.
    rows = materialise(_apart(placed.join(facts.select("class", "n", _folded("parity").alias("folded")), "class")), "apart")
    hot = _hot(rows)
    calm, crowded = rows.join(hot, "key", "left_anti"), materialise(rows.join(hot, "key"), "crowded")
    rest = _across(calm, percent)
    for turn in range(CROWDED_ROUNDS):
        if crowded.isEmpty():
            break
        done = judge(_could_match(_star_pairs(crowded, STAR_ROUNDS + turn), facts, percent))
        still = materialise(_apart(_relabelled(crowded, done).drop("other")), "still")
        hot = _hot(still)
        rest = rest.unionByName(_across(still.join(hot, "key", "left_anti"), percent))
        kept += [crowded, still]
        crowded = materialise(still.join(hot, "key"), "crowded")
        if done.where("linked").isEmpty():
            break
    if not crowded.isEmpty():
        rare = materialise(_rare(crowded.select("class", "component", "folded").distinct(), sets, percent), "rare")
        kept.append(rare)
        rest = rest.unionByName(_across_rare(_apart(rare), percent))
    rest = materialise(rest.distinct(), "rest")
    judge(_could_match(rest, facts, percent))
    discard(rows, crowded, rest, placed)

    # Rows that share an id tie their classes together; a component is then named by the smallest id of its classes.
    names = classes.select("n_shingles", "s1", "s2", "class", "smallest")
    owned = sketched.join(names, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", *[F.when(F.col("doc_id").isNotNull(), F.col(k)).alias(k) for k in ("class", "smallest")])
    owned = materialise(owned, "owned")
    ties = owned.where("class is not null").groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("high")).where("b <> high")
    ties = owned.join(ties, "doc_id").where("class <> b").select(F.col("class").alias("a"), "b")
    found = connected_components(tested.where("linked").select("a", "b").unionByName(ties))
    linked = found.join(classes.select(F.col("class").alias("node"), "smallest"), "node")
    named = linked.join(linked.groupBy("component").agg(F.min("smallest").alias("component_id")), "component").select("node", "component_id")
    named = materialise(named, "named")
    discard(found, met, sets, classes, sketched, *kept)
    out = owned.join(named, F.col("class") == F.col("node"), "left")
    component = F.coalesce("component_id", "smallest", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each near-duplicate group; all columns stay as they are.

    Of rows that repeat the id that is kept, all stay. Nulls and empty tables as in ``near_duplicates``.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
