"""Operator 9, suffix-array dedup: remove bytes covered by a SPAN-byte string of a smaller document.

The order of all suffixes is not needed, only which of them agree for SPAN bytes. So, as in induced
sorting, a sample of the suffixes is sorted, and what the others need is induced from it:

1. Sampling. Of every SPAN-byte window the GRAM-byte substring with the least hash is its anchor;
   equal windows have equal anchors at equal offsets. About one position in ten is an anchor.
2. Sorting. Anchors are dealt into buckets by hash and sorted there; those whose substring stands
   in one document only are dropped, and with them all windows they are anchors of.
3. Inducing. The remaining anchors are dealt and sorted again with the bytes beside them, at most
   SPAN - GRAM to the left and right. Every window of an anchor is a slice of these; slices that
   are equal are equal windows, and the least document of each is found for all anchors at once.
4. The windows with a smaller document go back to their text and are removed.

A substring that very many documents have as an anchor would fill one bucket. Such ones are found first, as
those that are frequent in some stretch of the input; there are few, as a document has few anchors. Their
windows are dealt one by one instead, by the hash of all their bytes, with the least document of each
group of texts, so that a window costs a tuple for each group, however many documents have it; what
comes back is the least document of all, and the group compares its own with it.

Tuples travel packed by the thousand in binary columns, so a bucket is sorted as arrays; buckets and
groups of texts are of bounded size, as their number follows the input. A bucket is one partition and is read
where Arrow put it; it is sorted by RANGES of hashes one after another, and texts are hashed CHUNK bytes at a
time, so that a worker holds little beside the bucket or the batch itself. Equal texts are one row: of
a copy everything goes.

The recursion of external induced sorting and its disk-backed priority queues are not used; the
README says why, with figures.

Edge cases: a null text counts as empty; a text under SPAN bytes loses nothing; a very long text is one
chunk, in memory that follows its length; of equal hashes in a window the first is the anchor; rows with equal ids
never count as smaller than one another; a null id counts as larger than all others; repeated rows
each return a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, durable, table

SPAN = 50
GRAM = 32
SIDE = SPAN - GRAM
#: Bytes of text to one bucket of anchors and to one group of texts.
BUCKET_BYTES, GROUP_BYTES = 24 << 20, 12 << 20
#: Bytes of text that are hashed at once, and whose anchors are dealt together.
CHUNK, DEALT_BYTES = 256 << 10, 2 << 20
#: Into how many ranges of hashes, two to this power, a bucket is cut for its sorting.
RANGES = 3
#: Bytes of a gram's hash that decide whether it may stand in two documents.
PART = 6
#: A gram is frequent if one in so many documents of a stretch, and in all, has it as an anchor, and that many at least.
FREQUENT, LEAST_FREQUENT = 256, 1000
_NO_DOC = np.iinfo(np.int64).max
_HIGH = np.uint64(0xFFFFFFFF00000000)


def anchors(chunk: kernels.Chunk) -> tuple[np.ndarray, ...]:
    """position, gram hash, first and last window start of each anchor of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    if len(data) < SPAN:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none
    grams = kernels.rolling(data, GRAM)
    least = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < SIDE + 1:
        step = min(width, SIDE + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    crossing = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(crossing, np.maximum(offsets[1:] - SPAN + 1, offsets[:-1]), 1)
    np.add.at(crossing, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(crossing[: len(least)]) == 0)
    if not len(start):
        return anchors(kernels.Chunk(0, 0, data[:0], offsets[:1]))
    at = (least[start] & ~_HIGH).astype(np.int64)
    change = np.flatnonzero(at[1:] != at[:-1])
    first, last = np.append(0, change + 1), np.append(change, len(at) - 1)
    at = at[first]
    return at, grams[at], start[first], start[last]


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray], name: str) -> pa.Table:
    """One row for each bucket, with the columns of its tuples as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    begin = np.append(0, cut)[: len(bucket)]
    arrays = {name: pa.array(bucket[begin].astype(np.int32))}
    for k, v in columns.items():
        v = np.ascontiguousarray(v[order])
        if k == "doc":  # tuples are in order of their texts: steps from one document to the next pack well
            steps = np.diff(v, prepend=np.int64(0))
            steps[begin] = v[begin]
            v = steps
        each = v.nbytes // len(v) if len(v) else 0
        ends = np.append(begin, len(v)).astype(np.int64) * each
        if len(v) and ends[-1] > np.iinfo(np.int32).max:  # of a very long text: more than the offsets of one column reach
            arrays[k] = pa.array([v[x:y].tobytes() for x, y in zip(begin, np.append(begin[1:], len(v)))], pa.binary())
        else:
            arrays[k] = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends[: len(begin) + 1].astype(np.int32)), pa.py_buffer(v)])
    return pa.table(arrays)


def _values(columns: list[pa.Array], dtype, steps: bool = False) -> np.ndarray:
    """The tuples' values in columns of packed rows, as they lie in memory if there is one column; ``steps``: summed
    up again row by row."""
    parts = []
    for column in columns:
        column = column.fill_null(b"") if column.null_count else column
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
        if offsets[0] == offsets[-1]:
            continue
        size = np.dtype(dtype).itemsize
        part = np.frombuffer(column.buffers()[2], dtype=dtype, count=int(offsets[-1] - offsets[0]) // size, offset=int(offsets[0]))
        if steps:
            summed = np.empty(len(part), dtype=dtype)
            cut = ((offsets - offsets[0]) // size).tolist()
            for x, y in zip(cut, cut[1:]):
                np.cumsum(part[x:y], out=summed[x:y])
            part = summed
        parts.append(part)
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=dtype), *parts])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes & ~_HIGH) % np.uint64(n)).astype(np.int64)


def _group(docs: np.ndarray, n: int) -> np.ndarray:
    """The group of a document; ``_group_column`` says the same of a column."""
    return (docs ^ (docs >> 20) ^ (docs >> 40)) % n


def _group_column(n: int):
    doc = F.col("doc")
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 20)).bitwiseXOR(F.shiftright(doc, 40)), F.lit(n)).cast("int")


def _per_bucket(batches: Iterator[pa.RecordBatch], columns: dict[str, object]) -> Iterator[dict[str, np.ndarray]]:
    """The tuples of one bucket after another, from rows sorted by bucket."""
    now, held = None, []
    of = lambda held: {k: _values([b[k] for b in held], t, k == "doc") for k, t in columns.items()}
    for b in batches:
        bucket = b["bucket"].to_numpy()
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for x, y in zip(np.append(0, cut).tolist(), np.append(cut, len(bucket)).tolist()):
            if x == y:
                continue
            if bucket[x] != now and held:
                yield of(held)
                held = []
            now = bucket[x]
            held.append(b.slice(x, y - x))
    if held:
        yield of(held)


def _ranges(top: np.ndarray) -> Iterator[np.ndarray]:
    """Which tuples are in each range of hashes, by the highest byte of each hash."""
    of = top >> np.uint8(8 - RANGES)
    for i in range(1 << RANGES):
        some = np.flatnonzero(of == i)
        if len(some):
            yield some


def _groups(order: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tuples in the order of their key: the group of each, and each group's least and greatest document."""
    key, doc = key[order], doc[order]
    new = np.append(True, key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    return np.cumsum(new) - 1, np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)


def frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """gram and n: those that many texts of a stretch have as an anchor, and how many; ``least``: in all."""
    for b in batches:
        found, n = [np.zeros(0, dtype=np.uint64)], 0
        for chunk in kernels.chunks(b["text"], CHUNK):
            at, gram, _, _ = anchors(chunk)
            owner = np.searchsorted(chunk.offsets, at, "right") - 1
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            found.append(gram[np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))[: len(gram)]])
            n += chunk.last - chunk.first
        for i in range(1 << RANGES):  # each chunk's grams are sorted
            low, high = np.uint64(i << 64 - RANGES), np.uint64((i + 1 << 64 - RANGES) - 1)
            grams, counts = np.unique(np.concatenate([f[np.searchsorted(f, low) : np.searchsorted(f, high, "right")] for f in found]), return_counts=True)
            often = counts > min(n // FREQUENT, least)
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often], pa.int64())], names=["gram", "n"])


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``some``, which is sorted."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), dtype=bool)


def sampled(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs = b["doc"].to_numpy()
        grams, owners, size = [], [], 0
        for chunk in kernels.chunks(b["text"], CHUNK):
            at, gram, _, _ = anchors(chunk)
            cold = ~_among(gram, hot)
            at, gram = at[cold], gram[cold]
            grams.append(gram)
            owners.append(docs[chunk.first + np.searchsorted(chunk.offsets, at, "right") - 1])
            size += len(chunk.data)
            if size < DEALT_BYTES and chunk.last < len(b):
                continue
            gram, doc = np.concatenate(grams), np.concatenate(owners)
            grams, owners, size = [], [], 0
            if len(gram):
                yield from _dealt(_bucket(gram, buckets), {"gram": gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PART], "doc": doc}, "bucket").to_batches()


def _pair(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key of the part of a gram's hash that was dealt, and a document; a clash only adds a candidate."""
    return kernels.mix((gram & np.uint64((1 << 8 * PART) - 1)) ^ kernels.mix(doc.view(np.uint64)))


def shared(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """For each group of documents, which (gram, document) have the gram in another document too."""
    for t in _per_bucket(batches, {"gram": np.uint8, "doc": np.int64}):
        part_of_gram = t["gram"].reshape(-1, PART)
        pairs, parts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)]
        for some in _ranges(part_of_gram[:, PART - 1]):
            whole = np.zeros((len(some), 8), dtype=np.uint8)
            whole[:, :PART] = part_of_gram[some]
            gram, doc = whole.view("<u8").ravel(), t["doc"][some]
            order = np.argsort(gram)
            group, low, high = _groups(order, gram, doc)
            order = order[(low != high)[group]]
            gram, doc = gram[order], doc[order]
            pairs.append(_pair(gram, doc))
            parts.append(_group(doc, groups).astype(np.int32))
        yield from _dealt(np.concatenate(parts), {"pair": np.concatenate(pairs)}, "part").to_batches()


def _lanes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of bytes whose width is a multiple of eight."""
    h = np.zeros(len(rows), dtype=np.uint64)
    for lane in np.ascontiguousarray(rows).view(np.uint64).T:
        h = kernels.mix(h * np.uint64(0x9FB21C651E98DF25) + lane)
    return h


def _nth(texts: pa.Table) -> np.ndarray:
    """Which of the texts of its document each is, in the order of their keys; equal rows are one."""
    docs, keys = texts["doc"].to_numpy(), texts["row_key"].to_numpy()
    order = np.lexsort((keys, docs))
    new_doc = np.append(True, docs[order][1:] != docs[order][:-1])
    new = new_doc | np.append(True, keys[order][1:] != keys[order][:-1])
    count = np.cumsum(new)
    out = np.empty(len(docs), dtype=np.int32)
    out[order] = count - np.maximum.accumulate(np.where(new_doc, count, 0))
    return out


def hot_windows(texts: pa.Table, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, hash and document of each window of a group of texts whose anchor is a frequent gram."""
    parts = [tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64))]
    docs = texts["doc"].to_numpy()
    column = texts["text"].combine_chunks()
    for chunk in kernels.chunks(column if isinstance(column, pa.Array) else column.chunk(0), CHUNK) if len(hot) and len(texts) else ():
        at, gram, low, high = anchors(chunk)
        mine = np.flatnonzero(_among(gram, hot))
        low, high = low[mine], high[mine]
        n = high - low + 1
        start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.searchsorted(chunk.offsets, start, "right") - 1
        for first in range(0, len(start), 1 << 16):
            some = slice(first, first + (1 << 16))
            window = np.zeros((len(start[some]), -(-SPAN // 8) * 8), dtype=np.uint8)
            window[:, :SPAN] = chunk.data[start[some, None] + np.arange(SPAN)]
            parts.append((chunk.first + owner[some], start[some] - chunk.offsets[owner[some]], _lanes(window), docs[chunk.first + owner[some]]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the least document of each."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    return key[first], doc[first]


def surrounded(texts: pa.Table, told: pa.Table, buckets: int, hot: np.ndarray, part: int) -> pa.Table:
    """The shared anchors of a group of texts, with their sides; and after them, in buckets of their own, the windows of
    frequent grams, with the least document of the group."""
    _, _, key, doc = hot_windows(texts, hot)
    key, doc = _least(key, doc)
    windows = _dealt(_bucket(key, buckets) + buckets, {"window": key, "least": doc, "group": np.full(len(key), part, dtype=np.int32)}, "bucket")
    return pa.concat_tables([_surrounded(texts, told, buckets), windows], promote_options="default").select(["bucket", *TUPLE, *WINDOW])


#: Columns of a bucket of anchors, and of one of windows.
TUPLE = {"gram": np.uint64, "again": np.uint32, "context": np.uint8, "doc": np.int64, "nth": np.int32, "at": np.int64}
WINDOW = {"window": np.uint64, "least": np.int64, "group": np.int32}


def _surrounded(texts: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    pairs = np.unique(_values(told["pair"].chunks, np.uint64))
    parts = []
    column = texts["text"].combine_chunks()
    docs, nth = texts["doc"].to_numpy(), _nth(texts)
    side = np.arange(SIDE)
    for chunk in kernels.chunks(column if isinstance(column, pa.Array) else column.chunk(0), CHUNK) if len(pairs) and len(texts) else ():
        at, gram, low, high = anchors(chunk)
        owner = np.searchsorted(chunk.offsets, at, "right") - 1
        doc = docs[chunk.first + owner]
        key = _pair(gram, doc)
        keep = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
        at, gram, low, high, owner, doc = (x[keep] for x in (at, gram, low, high, owner, doc))
        padded = np.concatenate([np.zeros(SIDE, dtype=np.uint8), chunk.data, np.zeros(SIDE, dtype=np.uint8)])
        left, right = at - low, high + SPAN - at - GRAM
        context = np.zeros((len(at), 2 * SIDE + 4), dtype=np.uint8)
        context[:, :SIDE] = np.where(side >= SIDE - left[:, None], padded[at[:, None] + side], 0)
        context[:, SIDE : 2 * SIDE] = np.where(side < right[:, None], padded[at[:, None] + SIDE + GRAM + side], 0)
        context[:, 2 * SIDE], context[:, 2 * SIDE + 1] = left, high - low
        again = _lanes(chunk.data[at[:, None] + np.arange(GRAM)]).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        parts.append((gram, again, context, doc, nth[chunk.first + owner], (at - chunk.offsets[owner]).astype(np.int64)))
    if not parts:
        return _dealt(np.zeros(0, dtype=np.int64), {k: np.zeros(0) for k in ("gram", "again", "context", "doc", "nth", "at")}, "bucket")
    gram, again, context, doc, nth, at = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    return _dealt(_bucket(gram, buckets), {"gram": gram, "again": again, "context": context, "doc": doc, "nth": nth, "at": at}, "bucket")


def induced(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """For each group of documents: the anchors with windows that a smaller document has, and which."""
    width = 2 * SIDE + 4
    for t in _per_bucket(batches, TUPLE | WINDOW):
        if len(t["window"]):
            # which groups have a window whose least document is another's
            key, least = _least(t["window"], t["least"])
            least = least[np.searchsorted(key, t["window"])]
            tell = np.flatnonzero(least < t["least"])
            yield from _told({"window": t["window"][tell], "least": least[tell]}, t["group"][tell].astype(np.int64))
            continue
        context, doc = t["context"].reshape(-1, width), t["doc"]
        mask = np.zeros(len(doc), dtype=np.uint32)
        for some in _ranges((t["gram"] >> np.uint64(56)).astype(np.uint8)):
            mask[some] = _smaller(t["gram"][some], t["again"][some], context[some], doc[some])
        hit = np.flatnonzero(mask)
        columns = {"doc": doc[hit], "nth": t["nth"][hit], "at": t["at"][hit], "mask": mask[hit]}
        yield from _told(columns, _group(doc[hit], groups))


def _smaller(gram: np.ndarray, again: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of all anchors of some grams: which windows a smaller document has, a bit for each byte they start before it."""
    same_gram = kernels.mix(gram * np.uint64(3) ^ again)
    whole = kernels.mix(_lanes(context) ^ same_gram)
    order = np.argsort(whole)
    group, low, _ = _groups(order, whole, doc)
    of = np.empty(len(doc), dtype=np.int64)
    of[order] = group
    head = np.empty(len(low), dtype=np.int64)
    head[group] = order
    context, same_gram = context[head], same_gram[head]
    left, more = context[:, 2 * SIDE].astype(np.int64), context[:, 2 * SIDE + 1].astype(np.int64)
    mask = np.zeros(len(doc), dtype=np.uint32)
    for back in range(SIDE + 1):  # the window that starts so many bytes before the anchor
        has = np.flatnonzero((left - more <= back) & (back <= left))
        if not len(has):
            continue
        window = np.zeros((len(has), -(-SIDE // 8) * 8), dtype=np.uint8)
        window[:, :SIDE] = context[has, SIDE - back : 2 * SIDE - back]
        key = kernels.mix(_lanes(window) ^ same_gram[has])
        order = np.argsort(key)
        group, least, _ = _groups(order, key, low[has])
        smallest = np.full(len(low), _NO_DOC)
        smallest[has[order]] = least[group]
        mask |= (smallest[of] < doc).astype(np.uint32) << np.uint32(back)
    return mask


def _told(columns: dict[str, np.ndarray], part: np.ndarray) -> list[pa.RecordBatch]:
    made = _dealt(part, columns, "part")
    none = pa.nulls(len(made), pa.binary())
    return pa.table({k: made[k] if k in made.column_names else none for k in TOLD}).to_batches()


TOLD = ("part", "doc", "nth", "at", "mask", "window", "least")


def removed(texts: pa.Table, told: pa.Table, hot: np.ndarray) -> pa.Table:
    """doc, row_key, n_removed, n_spans and kept_sha256 of the texts of a group that lose anything."""
    doc, at = _values(told["doc"].chunks, np.int64, True), _values(told["at"].chunks, np.int64)
    nth, mask = _values(told["nth"].chunks, np.int32), _values(told["mask"].chunks, np.uint32)
    text_of, start, key, owner = hot_windows(texts, hot)
    keys, least = _least(np.concatenate([key, _values(told["window"].chunks, np.uint64)]), np.concatenate([owner, _values(told["least"].chunks, np.int64)]))
    hit = np.flatnonzero(least[np.searchsorted(keys, key)] < owner) if len(key) else np.zeros(0, dtype=np.int64)
    order = np.argsort(text_of[hit], kind="stable")
    text_of, start = text_of[hit][order], start[hit][order]
    found: dict[tuple[int, int], slice] = {}
    order = np.lexsort((doc, nth))
    doc, nth, at, mask = doc[order], nth[order], at[order], mask[order]
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1])) + 1
    for x, y in zip(np.append(0, cut), np.append(cut, len(doc))):
        if y > x:
            found[int(doc[x]), int(nth[x])] = slice(x, y)
    out, done = [], set()
    for i, (d, r, k, text) in enumerate(zip(texts["doc"].to_pylist(), texts["row_key"].to_pylist(), _nth(texts).tolist(), texts["text"])):
        if (d, k) in done:  # equal rows are told once
            continue
        done.add((d, k))
        mine = found.get((d, k), slice(0, 0))
        windows = start[np.searchsorted(text_of, i) : np.searchsorted(text_of, i, "right")]
        if mine.start == mine.stop and not len(windows):
            continue
        data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
        steps = np.zeros(len(data) + 1, dtype=np.int32)
        anchor, back = np.nonzero((mask[mine, None] >> np.arange(SIDE + 1, dtype=np.uint32)) & np.uint32(1))
        np.add.at(steps, at[mine][anchor] - back, 1)
        np.add.at(steps, at[mine][anchor] - back + SPAN, -1)
        np.add.at(steps, windows, 1)
        np.add.at(steps, windows + SPAN, -1)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((d, r, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    names = ("doc", "row_key", "n_removed", "n_spans", "kept_sha256")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.table({n: pa.array([o[i] for o in out], k) for i, (n, k) in enumerate(zip(names, kinds))})


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NO_DOC)))
    rows = docs.select("doc_id", doc.alias("doc"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("same"))
    row_key = F.xxhash64("doc", "text").alias("row_key")
    digest = durable(rows.select("doc_id", "doc", "same", row_key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256")))
    total = digest.agg(F.sum("n_bytes")).first()[0] or 0
    buckets, groups = max(1, math.ceil(total / BUCKET_BYTES)), max(1, math.ceil(total / GROUP_BYTES))

    copies = durable(digest.groupBy("same").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("same", "first"))
    known = digest.join(bounded(copies), "same", "left")
    later = durable(known.filter("doc > first").select("doc", "same").distinct())
    firsts = rows.filter(F.octet_length("text") >= SPAN).join(bounded(later), ["doc", "same"], "left_anti").select("doc", row_key, "text")

    binary = lambda *names: ", ".join(f"{n} binary" for n in names)
    least = max(LEAST_FREQUENT, digest.count() // FREQUENT)
    often = firsts.select("text").mapInArrow(lambda it: frequent(it, least), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # at most FREQUENT times the anchors of a document: a sorted array that goes with the code
    hot = np.sort(np.array([r.gram for r in often.filter(F.col("n") > least).select("gram").toLocalIterator()], dtype=np.int64).view(np.uint64))
    tuples = firsts.select("doc", "text").mapInArrow(lambda it: sampled(it, buckets, hot), "bucket int, " + binary("gram", "doc"))
    tuples = tuples.repartitionById(buckets, "bucket")
    met = tuples.mapInArrow(lambda it: shared(it, groups), "part int, pair binary")

    texts = firsts.select(_group_column(groups).alias("part"), "*").groupBy("part")
    sides = texts.cogroup(met.groupBy("part")).applyInArrow(lambda key, a, b: surrounded(a, b, buckets, hot, key[0].as_py()), "bucket int, " + binary(*TUPLE, *WINDOW))
    # a bucket of anchors and the one of windows beside it
    sides = sides.repartitionById(buckets, F.col("bucket") % buckets).sortWithinPartitions("bucket")
    told = sides.mapInArrow(lambda it: induced(it, groups), "part int, " + binary(*TOLD[1:]))
    lost = texts.cogroup(told.groupBy("part")).applyInArrow(lambda a, b: removed(a, b, hot), "doc long, row_key long, n_removed long, n_spans long, kept_sha256 string")
    lost = bounded(durable(lost).withColumnsRenamed({"doc": "lost_doc", "row_key": "lost_key"}))
    out = known.join(lost, (F.col("doc") == F.col("lost_doc")) & (F.col("row_key") == F.col("lost_key")), "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)) & (F.col("n_bytes") >= SPAN)
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
