"""Exact repeated passages: a sparse suffix array over content-chosen suffixes, sorted in range-partitioned buckets.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Every such string holds an anchor: its
least-hashed run of ``GRAM`` bytes, a function of the string alone, so two copies hold the same anchor at the same
place. Only suffixes at anchors are sorted, about one in forty.

1. Texts are packed into blocks. Each block sends its anchors' hashes to hash buckets; a bucket answers which occur in
   several blocks. A passage in a third of all documents costs one entry for each block.
2. Blocks cut the stretch that an anchor rules (all strings whose anchor it is) out of the text for repeated anchors
   only. Equal stretches of a block are settled there: all but its first go, and only that one is sent on, so a hot
   passage costs one row for each block. Splitters sampled from the corpus range-partition the suffixes by their leading
   bytes. A leading key that takes several splitters is hot: it is dealt to as many buckets by the anchor's offset in
   the string, since strings can only be equal at equal offsets.
3. A bucket sorts by multikey quicksort, eight bytes at a time, going on with ties only. Equal stretches are one class:
   all but its first member go. First members of different classes with one anchor are compared string by string.
   Splitters never part equal leading keys except by offset, so no equal strings meet across a bucket's boundary.
4. Runs go back to their blocks, which join them and cut the bytes out.

All results depend on compared bytes; hashes choose candidates, and a false candidate changes nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernel as K
from millrace.llm.common import lean, materialise, prepare, slices

GRAM = 24
BLOCK_BYTES, PIECE_BYTES, BUCKET_BYTES = 4 << 20, 1 << 20, 6 << 20
SAMPLES = 16
SHORTEST, LONGEST = GRAM + 8, 1 << 14
RANGES, SAMPLED = 4096, 50_000
_POSITION = np.uint64((1 << 24) - 1)
LAST = np.iinfo(np.int64).max


def _pieces(off: np.ndarray, length: int):
    """Cut a block into parts of bounded size: (first byte, end, offsets of the texts within, text numbers).

    A text longer than a part is cut into parts that overlap by ``length - 1`` bytes, so that each string of ``length``
    bytes stands in exactly one of them.
    """
    n, i = len(off) - 1, 0
    while i < n:
        if off[i + 1] - off[i] > 2 * PIECE_BYTES:
            for s in range(int(off[i]), int(off[i + 1]) - length + 1, PIECE_BYTES):
                e = min(s + PIECE_BYTES + length - 1, int(off[i + 1]))
                yield s, e, np.array([0, e - s]), np.array([i])
            i += 1
            continue
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + PIECE_BYTES, side="right")) - 1))
        yield int(off[i]), int(off[j]), off[i : j + 1] - off[i], np.arange(i, j)
        i = j


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes within the texts: hash, position, first and last start it rules."""
    none = np.zeros(0, np.int64)
    starts = len(data) - length + 1
    if starts <= 0:
        return none.astype(np.uint64), none, none, none
    place = np.arange(len(data) - GRAM + 1)
    grams = K.mix(K.span_hash(K.prefix_hash(data), place, place + GRAM))
    key = (grams & ~_POSITION) | place.astype(np.uint64)
    width = length - GRAM + 1
    rows = -(-len(key) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & _POSITION).astype(np.int64)
    valid = np.zeros(starts + 1, np.int32)
    has = off[1:] - off[:-1] >= length
    np.add.at(valid, off[:-1][has], 1)
    np.add.at(valid, off[1:][has] - length + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    change = np.empty(starts, bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    texts = off[:-1][has]
    change[texts] = True
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [starts]]) - 1
    use = inside[first]
    first, last = first[use], last[use]
    return grams[at[first]], at[first], first, last


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, in the order of bytes; data must have eight bytes to spare."""
    return np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))


def refine(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of multikey quicksort: sort by (group, key); the order and the finer groups along it."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.empty(len(g), np.int64)
    if len(g):
        new[0] = 0
        np.cumsum((g[1:] != g[:-1]) | (k[1:] != k[:-1]), out=new[1:])
    return order, new


def ties(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the rows whose group has others."""
    if not len(group):
        return rows, group
    many = np.bincount(group)[group] > 1
    return rows[many], group[many]


def multikey(rows: np.ndarray, group: np.ndarray, levels) -> tuple[np.ndarray, np.ndarray]:
    """Sort within groups level by level and go on with ties only; the rest has equal keys at all levels."""
    for level in levels:
        if not len(rows):
            break
        order, group = refine(group, level(rows))
        rows, group = ties(rows[order], group)
    return rows, group


def not_first(rows: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of rows in groups of equals: those that some other precedes."""
    if not len(rows):
        return rows
    low = np.full(int(group.max()) + 1, LAST, np.int64)
    np.minimum.at(low, group, rank[rows])
    return rows[rank[rows] != low[group]]


def bucket_repeats(data: np.ndarray, at: np.ndarray, size: np.ndarray, anchor: np.ndarray, rank: np.ndarray, length: int, low: np.ndarray, high: np.ndarray):
    """Which strings of a bucket's stretches stand earlier too.

    A stretch ``i`` is ``data[at[i] : at[i] + size[i]]`` with its anchor ``anchor[i]`` bytes in; only strings whose
    anchor lies ``low[i]`` to ``high[i]`` bytes in count. Returns rows with the first and last start of repeated runs.
    """
    word = _words(data)
    rows = np.arange(len(at))
    rows, group = multikey(rows, np.zeros(len(rows), np.int64), [lambda r, d=d: word[at[r] + anchor[r] + d].astype(np.uint64) for d in range(0, GRAM, 8)])
    if not len(rows):
        return [np.zeros(0, np.int64)] * 3
    gram = np.full(len(at), -1, np.int64)
    gram[rows] = group
    most = int(size[rows].max())

    def level(d: int):
        # The last word of a stretch is read so that it ends with the stretch.
        return lambda r: word[at[r] + np.minimum(d, size[r] - 8)].astype(np.uint64)

    same, cls = multikey(rows, group, [lambda r: (size[r] << 32 | anchor[r]).astype(np.uint64), lambda r: (low[r] << 32 | high[r]).astype(np.uint64), *[level(d) for d in range(0, most, 8)]])
    later = not_first(same, cls, rank)
    out = [(later, np.maximum(0, anchor[later] - high[later]), np.minimum(size[later] - length, anchor[later] - low[later]))]
    first = np.ones(len(at), bool)
    first[later] = False
    reps, group = ties(rows[first[rows]], gram[rows[first[rows]]])
    for lead in range(0, length - GRAM + 1, 8):
        for part in np.array_split(np.arange(len(reps)), max(1, len(reps) // 150_000)):
            # Groups may be cut here only where they end.
            if len(part) == 0:
                continue
            s, e = part[0], part[-1] + 1
            while s and s < len(reps) and group[s] == group[s - 1]:
                s += 1
            while e < len(reps) and group[e] == group[e - 1]:
                e += 1
            own = reps[s:e]
            if not len(own):
                continue
            offset = np.arange(lead, min(lead + 8, length - GRAM + 1))
            start = anchor[own][:, None] - offset[None, :]
            good = (start >= 0) & (start <= (size[own] - length)[:, None]) & (offset >= low[own][:, None]) & (offset <= high[own][:, None])
            who, o = np.nonzero(good)
            begin = start[who, o]
            who_row, place = own[who], at[own[who]] + begin
            w_rows, w_group = multikey(np.arange(len(who)), group[s:e][who] * 256 + o, [lambda r, d=d: word[place[r] + d].astype(np.uint64) for d in (*range(0, length - 7, 8), length - 8)])
            again = not_first(w_rows, w_group, rank[who_row])
            out.append((who_row[again], begin[again], begin[again]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _equal_runs(values: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values; none for an empty array."""
    if not len(values):
        return []
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True))


def join_runs(*columns: np.ndarray) -> list[np.ndarray]:
    """Join overlapping and touching [start, end) runs; the last two columns are start and end, the others the owner."""
    order = np.lexsort(columns[::-1])
    *owner, start, end = (c[order] for c in columns)
    if not len(start):
        return [*owner, start, end]
    new = np.zeros(len(start), bool)
    new[0] = True
    for c in owner:
        new[1:] |= c[1:] != c[:-1]
    # The furthest end so far within the owner: ends are shifted so that owners do not mix.
    number = np.cumsum(new) - 1
    shift = number * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + shift) - shift
    new[1:] |= start[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return [*(c[first] for c in owner), start[first], far[last]]


# --- the passes over blocks -------------------------------------------------------------------------------------------

BLOCKS = pa.schema([("block", pa.int64()), ("raw", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("lead", pa.list_(pa.int64())), ("payload", pa.binary()), ("extra", pa.binary())])
FRAGMENTS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
REPLIES = pa.schema([("block", pa.int64()), ("body", pa.binary())])


def _pack(keep_extra: bool):
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        packer = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for part, data, off in slices(whole, "text", BLOCK_BYTES):
                spots = np.linspace(0, max(0, len(data) - 8), SAMPLES).astype(np.int64) if len(data) >= 8 else np.zeros(0, np.int64)
                lead = _words(np.concatenate([data, np.zeros(8, np.uint8)]))[spots].astype(np.uint64).view(np.int64)
                extra = b""
                if keep_extra:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema.remove(part.schema.get_field_index("text"))) as writer:
                        writer.write_batch(part.drop_columns(["text"]))
                    extra = packer.compress(sink.getvalue())
                ids = part.column("doc_id").cast(pa.int64()).fill_null(LAST)
                gone = np.asarray(part.column("text").is_null())
                sizes = np.where(gone, -1, off[1:] - off[:-1]).astype(np.int32)
                yield pa.RecordBatch.from_pylist([{"block": number, "raw": len(data), "ids": ids.to_pylist(), "sizes": sizes.tolist(), "lead": lead.tolist(), "payload": packer.compress(data.tobytes()), "extra": extra}], schema=BLOCKS)
                number += 1

    return lean(run)


def _open(sizes: np.ndarray, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8), np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))]).astype(np.int64)


def _block_hashes(buckets: int, length: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[i].values)
                data, off = _open(sizes, batch.column("payload")[i].as_py())
                found = [anchors(data[s:e], o, length)[0] for s, e, o, _ in _pieces(off, length)]
                own = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                where = ((own >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cut = np.searchsorted(where, np.arange(buckets + 1))
                full = np.flatnonzero(cut[1:] > cut[:-1])
                if len(full):
                    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), batch.column("block")[i].as_py())), pa.array([own[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], schema=FRAGMENTS)

    return lean(run)


@lean
def _repeated(batches):
    """Within a partition: the hashes that several blocks have, told to each of them."""
    blocks, bodies = [], []
    for batch in batches:
        blocks += batch.column("block").to_pylist()
        bodies += [np.frombuffer(x, np.uint64) for x in batch.column("body").to_pylist()]
    if not blocks:
        return
    order = np.argsort(np.array(blocks), kind="stable")
    sizes = [len(x) for x in bodies]
    every = np.concatenate(bodies)
    by = np.argsort(every, kind="stable")
    equal = every[by][1:] == every[by][:-1]
    many = np.zeros(len(every), bool)
    many[by[1:][equal]] = True
    many[by[:-1][equal]] = True
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for k in order:
        got = every[begin[k] : begin[k + 1]][many[begin[k] : begin[k + 1]]]
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array([blocks[k]], pa.int64()), pa.array([got.tobytes()], pa.binary())], schema=REPLIES)


_META = np.dtype([("doc", "<i8"), ("text", "<i4"), ("start", "<i4"), ("size", "<u4"), ("anchor", "<u2"), ("low", "<u2"), ("high", "<u2")])


def _settled(data, ids, a, lo, size, t, b, low, high) -> np.ndarray:
    """Stretches of a block that equal an earlier one of the block byte by byte, with the same anchor and offsets."""
    word = _words(np.concatenate([data, np.zeros(8, np.uint8)]))
    shape, dealt = (size << 32 | (a - lo)).astype(np.uint64), (low << 32 | high).astype(np.uint64)
    most = int(size.max()) if len(size) else 0
    levels = [lambda r: shape[r], lambda r: dealt[r], *[lambda r, d=d: word[lo[r] + np.minimum(d, size[r] - 8)].astype(np.uint64) for d in range(0, most, 8)]]
    rows, cls = multikey(np.arange(len(a)), b, levels)
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((lo, t, ids[t]))] = np.arange(len(a))
    return not_first(rows, cls, rank)


def _stretches(splitters: np.ndarray, fan: int, length: int):
    """Cut out what the repeated anchors of a block rule, and deal it to buckets by leading bytes.

    Each range between splitters has ``fan`` buckets, told apart by the anchor's hash: equal strings have equal anchors.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for i in range(left.num_rows):
            ids = np.asarray(left.column("ids")[i].values)
            sizes = np.asarray(left.column("sizes")[i].values)
            data, off = _open(sizes, left.column("payload")[i].as_py())
            told = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in right.column("body").to_pylist()]])
            grams, at, first, last, text = ([] for _ in range(5))
            for s, e, o, numbers in _pieces(off, length):
                g, a, lo, hi = anchors(data[s:e], o, length)
                grams.append(g), at.append(a + s), first.append(lo + s), last.append(hi + s)
                text.append(numbers[np.searchsorted(o, lo, side="right") - 1])
            if not grams:
                continue
            g, a, lo, hi, t = (np.concatenate(x) for x in (grams, at, first, last, text))
            if not len(g):
                continue
            values, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
            elsewhere = np.isin(values, told)[inverse]
            use = (count > 1)[inverse] | elsewhere
            a, lo, hi, t, code, elsewhere, part = (x[use] for x in (a, lo, hi, t, inverse, elsewhere, ((g >> np.uint64(32)) % np.uint64(fan)).astype(np.int64)))
            lead = _words(np.concatenate([data, np.zeros(8, np.uint8)]))[a].astype(np.uint64)
            one, two = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
            ways = np.clip(two - one, 1, length - GRAM + 1)
            hot = two - one >= 2
            bucket = np.where(hot, one, two)
            share = np.where(hot, ways, 1)
            pick = np.repeat(np.arange(len(a)), share)
            way = np.arange(len(pick)) - np.repeat(np.cumsum(share) - share, share)
            span = length - GRAM + 1
            low, high = span * way // share[pick], span * (way + 1) // share[pick] - 1
            a, lo, hi, t, code, elsewhere, b = *(x[pick] for x in (a, lo, hi, t, code, elsewhere)), (bucket[pick] + way) * fan + part[pick]
            lo, hi = np.maximum(lo, a - high), np.minimum(hi, a - low)
            good = lo <= hi
            a, lo, hi, t, code, elsewhere, b, low, high = (x[good] for x in (a, lo, hi, t, code, elsewhere, b, low, high))
            packer = zstandard.ZstdCompressor(level=1)
            number = left.column("block")[i].as_py()
            later = _settled(data, ids, a, lo, hi + length - lo, t, b, low, high)
            if len(later):
                runs = join_runs(t[later], lo[later] - off[t[later]], hi[later] + length - off[t[later]])
                rows.append({"bucket": -1 - ((number >> 33) * 31 + number & 0x3FFFFFFF), "block": number, "body": packer.compress(np.stack(runs).astype(np.int32).tobytes())})
            send = np.ones(len(a), bool)
            send[later] = False
            # An anchor that only this block holds is sent on if stretches that differ share it.
            _, place, many = np.unique(code[send] * ((len(splitters) + length) * fan) + b[send], return_inverse=True, return_counts=True)
            send[send] = (many[place] > 1) | elsewhere[send]
            kept = np.flatnonzero(send)
            order = kept[np.argsort(b[kept], kind="stable")]
            a, lo, hi, t, b, low, high = (x[order] for x in (a, lo, hi, t, b, low, high))
            meta = np.empty(len(a), _META)
            meta["doc"], meta["text"], meta["start"], meta["size"], meta["anchor"] = ids[t], t, lo - off[t], hi + length - lo, a - lo
            meta["low"], meta["high"] = low, high
            for s, e in _equal_runs(b):
                size = meta["size"][s:e].astype(np.int64)
                index = np.repeat(lo[s:e] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                body = np.int64(e - s).tobytes() + meta[s:e].tobytes() + data[index].tobytes()
                rows.append({"bucket": int(b[s]), "block": number, "body": packer.compress(body)})
        return pa.Table.from_pylist(rows, schema=FRAGMENTS)

    return run


RUNS = pa.schema([("block", pa.int64()), ("text", pa.list_(pa.int32())), ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32()))])


def _sort_bucket(length: int):
    """Sort one partition's stretches and tell each block which runs of its texts go."""

    def run(batches):
        by_bucket: dict[int, list[tuple[int, bytes]]] = {}
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, block, body in zip(*(batch.column(k).to_pylist() for k in ("bucket", "block", "body")), strict=True):
                if bucket < 0:
                    text, start, end = np.frombuffer(opener.decompress(body), np.int32).reshape(3, -1)
                    yield pa.RecordBatch.from_pylist([{"block": block, "text": text, "start": start, "end": end}], schema=RUNS)
                else:
                    by_bucket.setdefault(bucket, []).append((block, body))
        for bucket in sorted(by_bucket):
            metas, blocks, bytes_ = [], [], []
            for block, body in sorted(by_bucket.pop(bucket)):
                raw = opener.decompress(body)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                metas.append(np.frombuffer(raw, _META, n, 8))
                blocks.append(np.full(n, block))
                bytes_.append(np.frombuffer(raw, np.uint8, offset=8 + n * _META.itemsize))
            meta, block, data = np.concatenate(metas), np.concatenate(blocks), np.concatenate([*bytes_, np.zeros(8, np.uint8)])
            del metas, blocks, bytes_
            size = meta["size"].astype(np.int64)
            rank = np.empty(len(meta), np.int64)
            rank[np.lexsort((meta["start"], meta["text"], block, meta["doc"]))] = np.arange(len(meta))
            part = [meta[k].astype(np.int64) for k in ("anchor", "low", "high")]
            rows, begin, end = bucket_repeats(data, np.cumsum(size) - size, size, part[0], rank, length, part[1], part[2])
            start = meta["start"][rows].astype(np.int64)
            block, text, start, end = join_runs(block[rows], meta["text"][rows].astype(np.int64), start + begin, start + end + length)
            for s, e in _equal_runs(block):
                yield pa.RecordBatch.from_pylist([{"block": int(block[s]), "text": text[s:e], "start": start[s:e], "end": end[s:e]}], schema=RUNS)

    return lean(run)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut_out(extra_schema: pa.Schema | None):
    """Cut the runs out of a block's texts: digests, or the rows themselves with their remaining text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        runs = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(x.values) for x in right.column(k)]]) for k in ("text", "start", "end")]
        text, start, end = join_runs(*runs)
        for i in range(left.num_rows):
            ids, sizes = np.asarray(left.column("ids")[i].values), np.asarray(left.column("sizes")[i].values)
            data, off = _open(sizes, left.column("payload")[i].as_py())
            cut = np.searchsorted(text, np.arange(len(ids) + 1))
            removed = np.zeros(len(ids), np.int64)
            rest, hashes = [], []
            for k in range(len(ids)):
                own = data[off[k] : off[k + 1]]
                s, e = start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]]
                removed[k] = int((e - s).sum())
                if extra_schema is None:
                    if len(s):
                        sums = np.zeros(len(own) + 1, np.int8)
                        sums[s] += 1
                        sums[e] -= 1
                        own = own[np.cumsum(sums[:-1]) == 0]
                    hashes.append(hashlib.sha256(own.tobytes()).hexdigest())
                    continue
                inner = (own & 0xC0) == 0x80 if len(s) else own
                keep = np.ones(len(own), bool)
                for x, y in zip(s, e, strict=True):
                    # A character that is only partly covered stays.
                    while x < y and inner[x]:
                        x += 1
                    while y > x and y < len(own) and inner[y]:
                        y -= 1
                    keep[x:y] = False
                rest.append(None if sizes[k] < 0 else own[keep].tobytes().decode("utf-8", "replace"))
            if extra_schema is None:
                columns = [pa.array(ids, mask=ids == LAST), np.maximum(sizes, 0).astype(np.int64), removed, cut[1:] - cut[:-1], pa.array(hashes, pa.string())]
                out.append(pa.table(columns, schema=DIGESTS))
            else:
                table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(left.column("extra")[i].as_py())).read_all().drop_columns(["doc_id"])
                table = table.append_column("__text", pa.array(rest, pa.string())).append_column("__removed", pa.array(removed))
                out.append(table.rename_columns(extra_schema.names).cast(extra_schema))
        return pa.concat_tables(out)

    return run


def _find_runs(docs: DataFrame, length: int, keep_extra: bool) -> tuple[DataFrame, DataFrame, int]:
    if not SHORTEST <= length <= LONGEST:
        raise ValueError(f"length must be from {SHORTEST} to {LONGEST} bytes")
    blocks = materialise(docs.mapInArrow(_pack(keep_extra), "block long, raw long, ids array<long>, sizes array<int>, lead array<long>, payload binary, extra binary"), "blocks")
    total = blocks.agg(F.sum("raw")).first()[0] or 0
    # Many more buckets than partitions even the partitions out; a task sorts one bucket at a time. Splitters are bounded,
    # so beyond RANGES ranges each of them has several buckets; tasks hold as many bytes however large the input is.
    buckets = max(32, total // BUCKET_BYTES)
    ranges = min(buckets, RANGES)
    fan = -(-buckets // ranges)
    parts, wide = max(8, buckets // 5), max(8, total // (4 * BLOCK_BYTES))
    slim = blocks.select("block", "ids", "sizes", "payload")
    hashes = slim.mapInArrow(_block_hashes(buckets, length), "bucket int, block long, body binary")
    replies = hashes.repartition(parts, "bucket").mapInArrow(_repeated, "block long, body binary")
    # A bounded sample of leading keys, a dozen for each range; unsigned order, as bytes compare.
    share = min(1.0, SAMPLED / max(1, SAMPLES * (total // BLOCK_BYTES + 1)))
    leads = blocks.select(F.explode("lead").alias("lead"))
    sample = np.sort((leads.sample(share, seed=4) if share < 1 else leads).toPandas()["lead"].to_numpy(np.int64).view(np.uint64))
    splitters = sample[np.linspace(0, len(sample) - 1, ranges + 1).astype(int)[1:-1]] if len(sample) else np.zeros(0, np.uint64)
    stretches = _beside(slim, replies, wide).applyInArrow(_stretches(splitters, fan, length), "bucket int, block long, body binary")
    runs = stretches.repartition(parts, "bucket").mapInArrow(_sort_bucket(length), "block long, text array<int>, start array<int>, end array<int>")
    return blocks, runs, wide


def _beside(blocks: DataFrame, others: DataFrame, parts: int):
    """Blocks with what is told to each of them, over partitions that hold a bounded number of blocks."""
    return blocks.repartition(parts, "block").groupBy("block").cogroup(others.repartition(parts, "block").groupBy("block"))


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: at a smaller id, or earlier
    in the same text; rows with one id follow in the order in which they were packed, and a null id comes last. Null
    and empty texts, and texts shorter than ``length``, lose nothing. Other columns are not read. An empty table gives
    an empty table. ``length`` may be from ``SHORTEST`` to ``LONGEST``; another is an error.
    """
    prepare(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks, runs, wide = _find_runs(docs, length, False)
    blocks = blocks.select("block", "ids", "sizes", "payload")
    return _beside(blocks, runs, wide).applyInArrow(_cut_out(None), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated passages cut out of the text; a text that loses all is dropped.

    Characters that a removed run covers only in part stay whole. Null and empty texts stay as they are. Column names
    are free: none clashes with those used inside.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(docs)
    names = docs.columns
    others = [c for c in names if c != text_col]
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    blocks, runs, wide = _find_runs(inner, length, True)
    result = inner.drop("doc_id", "text").withColumn("out_text", F.lit(None).cast("string")).withColumn("out_removed", F.lit(None).cast("long")).schema
    blocks = blocks.select("block", "ids", "sizes", "payload", "extra")
    out = _beside(blocks, runs, wide).applyInArrow(_cut_out(to_arrow_schema(result)), result)
    out = out.where("not (out_removed > 0 and out_text = '')")
    return out.select(*[F.col("out_text" if c == text_col else f"c{others.index(c)}").alias(c) for c in names])
