"""Near-duplicate passages across documents, by compact windows.

A text is a sequence of 5-word shingles (A-Z lower-cased). Under a hash, the Cartesian tree over the shingles'
values groups all subsequences that share their minimum: a node is a compact window (first, centre, last), within
which every subsequence over the centre has the centre's value as its minimum. Only windows of at least LEAST
shingles matter, so the tree is cut there: about 2 n / LEAST windows a hash, and a window is read as far as stretches
of LEAST shingles over its centre reach, since a longer passage is made of such stretches. A passage that two documents
share yields one value in both, under each hash with the probability of the passages' similarity.

1. Documents with equal word sequences are one class: only its smallest id goes on, the others are returned as its copies.
2. The windows of HASHES hashes are grouped by value. In a group of up to CROWDED windows all pairs are made. In a larger
   one, in order of ids, each window is paired with the NEAREST before it, so pairs are linear in the windows; its windows
   are kept for step 4, which makes up for the other pairs.
3. Interval join: the windows that two documents share, no further apart than a passage's least length, form an
   interval, which stays if it has windows of ENOUGH hashes. Overlapping intervals of one document, whatever the
   partner, are a region; regions are cut out of the texts once, and every pair with an interval is verified on full
   sets, passage by passage.
4. The links over the centres of a crowded group's windows part it into classes. Within a class no link is lost. Of a group
   with several, all pairs of windows of different classes are compared by sketches of the shingles around the centre: a
   stretch of LEAST over both centres holds three of six parts of PART places whole, in a row beside the centre, and at most
   6 of their shingles are not common.
   The pairs with ALIKE bits in common there, and whose common shingles can make a passage, are searched, unless links
   found before over both centres connect them. A group of more windows than a BLOCK is dealt to pairs of blocks, each
   pair one task, so none is dropped.

A pair of passages at 80 % shares values of ENOUGH of the HASHES hashes with a probability over 0.9999. Either ENOUGH of
these values have small groups, and the pair is verified in step 3, or one has a crowded group, and step 4 sees it.

Edge cases: null, empty and short texts (under WORDS words) have no passages. Repeats within one document are not
paired. Null ids are ignored. Repeated rows with one id are one document. Very long texts are read whole. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirgate.llm.common import join_counted, materialize, mix, rolled_shingles, text_chunks, word_bounds, word_hashes
from weirgate.llm.components import components

SHINGLE = 5
WORDS = 50  # words of a passage at least
LEAST = WORDS - SHINGLE + 1
HASHES, ENOUGH = 8, 2
CROWDED = 32  # windows of a value of which all pairs are made
NEAREST = 2  # windows before it that a window of a larger group is paired with at first
PART, ALIKE = 11, 20  # places of a part of a sketch, bits that three parts in a row have in common at least
GAPS = (2 * SHINGLE + 1, SHINGLE + 1, 1)  # steps between matching shingles that a passage may hold, widest first
CROWD = 64
DENSE_MATCHES, DENSE_PLACES = 4, 1 << 14  # matches a place, from which those of a place are linked at once, in a text of so many places twice as many
PERCENT = 80  # similarity of passages
BUCKETS, HELD = 1 << 13, 1 << 19  # packs of rows for a shuffle, and windows that are packed at once
CACHED = 1 << 17  # bytes of texts read at once, so that their arrays stay in a core's cache
BLOCK = 300_000  # shingles around the windows of a task's block, about
DENSE = 3 * LEAST // 4  # places of LEAST that have a common shingle, before a pair is searched
REACH = 2 * LEAST - 1  # places that stretches of LEAST over one centre reach
AT_ONCE = 1 << 19  # pairs of places that are compared at once
MOST_SHARES = 1 + 100 / PERCENT + 1e-6  # of a / c + b / c, if c of a and b elements are common and the sets alike
_SEEDS = [np.uint64(x) for x in mix(np.arange(1, HASHES + 1, dtype=np.uint64)).tolist()]


def compact_windows(s: np.ndarray, whole: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values, centres, first and last places of the Cartesian tree's nodes that span LEAST places or more.

    Stretches of LEAST places in one node have its centre as their minimum, so sliding minima find all nodes at once;
    first and last are where its stretches begin and end. `whole` marks the places from which a stretch lies in one
    text; the leftmost minimum is the centre."""
    none = np.empty(0, np.int64)
    if len(s) < LEAST:
        return none.view(np.uint64), none, none, none
    value = mix(s ^ seed)
    low = np.uint64((1 << int(len(s)).bit_length()) - 1)
    least = (value & ~low) | np.arange(len(s), dtype=np.uint64)  # the place breaks ties
    span = 1
    while 2 * span <= LEAST:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < LEAST:
        least = np.minimum(least[: span - LEAST], least[LEAST - span :])
    centre = (least & low).astype(np.int64)
    new = whole.copy()
    new[1:] &= (centre[1:] != centre[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new)
    ends = whole.copy()
    ends[:-1] &= new[1:] | ~whole[1:]
    last = np.flatnonzero(ends) + LEAST - 1
    return value[centre[first]], centre[first], first, last


def _read(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of chunks of rows: first and end row, word hashes, and each row's first word (one more at the end)."""
    for lo, hi, data, offsets in text_chunks(texts, CACHED):
        starts, ends, first = word_bounds(data, offsets)
        yield lo, hi, word_hashes(data, starts, ends), first


def _identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest and the number of words of each text long enough to hold a passage."""
    for batch in batches:
        digest, n = [], []
        for _, _, words, first in _read(batch.column(1)):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                digest.append(hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b - a >= WORDS else None)
                n.append(b - a)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32())], ["doc_id", "digest", "n_words"])


_WINDOW = np.dtype([("value", "<i8"), ("doc", "<i8"), ("span", "<i8")])
_PAIR = np.dtype([("doc", "<i8"), ("other", "<i8"), ("span", "<i8"), ("other_span", "<i8"), ("hash", "u1")])


def _packed(bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows that come by bucket, those of a bucket as one row of bytes."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    edges = (np.append(at, len(rows)) * rows.dtype.itemsize).astype(np.int32)
    packs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), packs], ["bucket", "rows"])


def _unpacked(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The rows of whole buckets; the batches come sorted by bucket."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        bucket, packs = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
        edges = np.frombuffer(packs.buffers()[1], np.int64)[packs.offset : packs.offset + len(packs) + 1]
        rows = np.frombuffer(packs.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(kind)
        new = np.flatnonzero(np.diff(bucket, prepend=bucket[0] if last is None else last))
        if len(new):
            cut = int(edges[new[-1]] - edges[0]) // kind.itemsize
            yield np.concatenate([*held, rows[:cut]])
            held, rows = [], rows[cut:]
        held.append(rows.copy())
        last = bucket[-1]
    if held:
        yield np.concatenate(held)


def _bucket(key: np.ndarray) -> np.ndarray:
    """The bucket of mixed keys."""
    return (key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint16)


def _span(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 32) | last.astype(np.int64)


def _chain(value: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and rows before them of equal value, of other documents: all of a group of up to CROWDED rows, of a larger one
    the NEAREST, the rest of which _unresolved makes up for. The rows are sorted, their groups whole."""
    size, rank = _groups(value)
    for back in range(1, max(CROWDED, NEAREST + 1)):
        at = np.flatnonzero((rank >= back) & ((size <= CROWDED) | (back <= NEAREST)))
        at = at[doc[at] != doc[at - back]]
        if len(at):
            yield at, at - back


def _groups(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows have each row's value, and how many of them are before it; the rows are sorted."""
    opens = np.ones(len(value), bool)
    opens[1:] = value[1:] != value[:-1]
    begin = np.flatnonzero(opens)
    size = np.diff(np.append(begin, len(value)))
    return np.repeat(size, size), np.arange(len(value)) - np.repeat(begin, size)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each batch, packed by their value's bucket."""

    def rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        value, doc, centre, before, after = map(np.concatenate, zip(*parts, strict=True))
        key = mix(value)
        order = np.argsort(key)
        # equal values in order of their places: the sort need not be stable
        run = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        order = np.sort((run << 32) | order) & ((1 << 32) - 1)
        value, doc, centre, before, after = value[order], doc[order], centre[order], before[order], after[order]
        # windows of one value that touch in a document are one
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(centre) > after[:-1] + before[1:] + 1)
        at = np.flatnonzero(new)
        out = np.empty(len(at), _WINDOW)
        out["value"], out["doc"], out["span"] = value[at].view(np.int64), doc[at], _span(centre[at], np.maximum.reduceat(centre, at))
        return _packed(_bucket(key[order[at]]), out)

    parts, n_held = [], 0
    for batch in batches:
        ids = batch.column(0).fill_null(0).to_numpy()
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for lo, hi, words, start in _read(batch.column(1)):
            s = rolled_shingles(words, SHINGLE)
            row = np.repeat(np.arange(lo, hi), np.diff(start))  # of each word
            n = max(0, len(row) - WORDS + 1)
            whole = (row[:n] == row[WORDS - 1 :]) & known[row[:n]]
            for h in range(HASHES):
                v, c, a, b = compact_windows(s, whole, _SEEDS[h])
                if len(v):  # the low bits name the hash
                    parts.append([(v & ~np.uint64(15)) | np.uint64(h), ids[row[a]], c - start[row[a] - lo], c - a, b - c])
                    n_held += len(v)
            if n_held > HELD:
                yield rows(parts)
                parts, n_held = [], 0
    if parts:
        yield rows(parts)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of windows, the larger document first, with the bit of their hash, packed by their documents' bucket.

    A window of a crowded group also comes alone, with its own document as the other, and the value as the other span."""
    for rows in _unpacked(batches, _WINDOW):
        value = rows["value"]
        by = np.argsort(value)
        ranked = value[by]
        same = ranked[1:] == ranked[:-1]
        by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # a window alone has no pair
        if not len(by):
            continue
        rows = rows[by]
        rows = rows[np.lexsort((rows["span"], rows["doc"], rows["value"]))]
        value, doc, span = (np.ascontiguousarray(rows[c]) for c in _WINDOW.names)
        ends = list(_chain(value, doc))
        alone = np.flatnonzero(_groups(value)[0] > CROWDED)
        i, j = (np.concatenate([*(e[k] for e in ends), alone]) for k in (0, 1))
        if not len(i):
            continue
        i, j = np.where(doc[i] < doc[j], j, i), np.where(doc[i] < doc[j], i, j)
        bucket = _bucket(mix(doc[i].view(np.uint64) ^ mix(doc[j].view(np.uint64))))
        order = np.argsort(bucket, kind="stable")
        out = np.empty(len(i), _PAIR)
        out["doc"], out["other"], out["span"], out["other_span"], out["hash"] = doc[i], doc[j], span[i], span[j], 1 << (value[i] & 15)
        out["other_span"][len(i) - len(alone) :], out["hash"][len(i) - len(alone) :] = value[alone], 0
        yield _packed(bucket[order], out[order])


def _whole_keys(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Sorted rows as arrays, cut so that rows of equal keys (the first columns) stay together."""
    held: list[list[np.ndarray]] = []  # of one key
    for batch in batches:
        if not len(batch):
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if all(first[0] == last[-1] for first, last in zip(held[0][:n_keys], held[-1][:n_keys], strict=True)):
            continue
        now = [np.concatenate(c) for c in zip(*held, strict=True)]
        same = np.logical_and.reduce([k == k[-1] for k in now[:n_keys]])
        cut = int(np.flatnonzero(~same)[-1]) + 1
        yield [x[:cut] for x in now]
        held = [[x[cut:] for x in now]]
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _islands(new_key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where groups of overlapping intervals begin; the rows are sorted by key and first."""
    key = np.cumsum(new_key)
    reach = np.maximum.accumulate(last + (key << 33)) - (key << 33)  # the furthest end so far within the key
    out = new_key.copy()
    out[1:] |= first[1:] > reach[:-1]
    return np.flatnonzero(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of two documents, from the first to the last shared centre, with windows of ENOUGH hashes and centres.

    The windows of crowded groups go on as they are, with their value; that of an interval is null."""
    low = (1 << 32) - 1
    names = ["doc_id", "first", "last", "other_id", "other_first", "other_last", "value"]
    for rows in _unpacked(batches, _PAIR):
        rows = rows[np.lexsort((rows["span"], rows["other"], rows["doc"]))]
        doc, other, span, other_span, bit = (np.ascontiguousarray(rows[c]) for c in _PAIR.names)
        alone = doc == other
        if alone.any():
            d, p, v = doc[alone], span[alone], other_span[alone]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (d, p >> 32, p & low, d, p >> 32, p & low, v)], names)
            doc, other, span, other_span, bit = (c[~alone] for c in (doc, other, span, other_span, bit))
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])
        at = _islands(new, span >> 32, (span & low) + LEAST)
        hashes = np.bitwise_count(np.bitwise_or.reduceat(bit, at))
        fresh = new.copy()
        fresh[1:] |= span[1:] != span[:-1]
        centres = np.add.reduceat(fresh.astype(np.int64), at)
        # a text of one repeated shingle has one centre, which all hashes share
        enough = (hashes >= ENOUGH) & ((centres >= ENOUGH) | (hashes >= HASHES - 2))
        cols = [doc[at], np.minimum.reduceat(span >> 32, at), np.maximum.reduceat(span & low, at)]
        cols += [other[at], np.minimum.reduceat(other_span >> 32, at), np.maximum.reduceat(other_span & low, at)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[enough]) for c in cols), pa.nulls(np.count_nonzero(enough), pa.int64())], names)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each interval of a document, with the number of the candidate it comes from."""
    for doc, first, last, candidate in _whole_keys(batches, 1):
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        at = _islands(new, first, last)
        n = np.diff(np.append(at, len(doc)))
        cols = [doc, np.repeat(first[at], n), np.repeat(np.maximum.reduceat(last, at), n), candidate, first, last]
        names = ["doc_id", "first", "last", "candidate", "own_first", "own_last"]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names)


def _classes(node: np.ndarray, link: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the n nodes that links connect with each; node and link are the ends of edges."""
    label = np.arange(n)
    while len(node):
        low = np.full(int(link.max()) + 1, n)
        np.minimum.at(low, link, label[node])
        new = label.copy()
        np.minimum.at(new, node, low[link])
        np.minimum.at(new, label[node], low[link])
        while ((up := new[new]) != new).any():
            new = up
        if (new == label).all():
            break
        label = new
    return label


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the crowded groups that links part into several classes, with the number of the class.

    The rows have a window and a link over it (0: none), and come sorted by value, document and place."""
    for value, doc, first, last, link in _whole_keys(batches, 1):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])
        node, at = np.cumsum(new) - 1, np.flatnonzero(new)
        group = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
        by = np.lexsort((link, group))
        by = by[link[by] != 0]
        fresh = np.concatenate([[False], (group[by[1:]] != group[by[:-1]]) | (link[by[1:]] != link[by[:-1]])]) if len(by) else by
        label = _classes(node[by], np.cumsum(fresh), len(at))
        begin = np.flatnonzero(np.diff(group[at], prepend=-1))
        several = [np.minimum.reduceat(c, begin) != np.maximum.reduceat(c, begin) for c in (label, doc[at])]
        some = np.flatnonzero((several[0] & several[1])[group[at]])
        cols = [*(c[at][some] for c in (value, doc, first, last)), label[some]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["value", "doc_id", "first", "last", "class"])


def _parted_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each window of a parted group; the rows come sorted by document and first."""
    for doc, first, last, value, label in _whole_keys(batches, 1):
        new = np.ones(len(doc), bool)
        new[1:] = doc[1:] != doc[:-1]
        at = _islands(new, first, last + LEAST)
        n = np.diff(np.append(at, len(doc)))
        cols = [doc, np.repeat(first[at], n), np.repeat(np.maximum.reduceat(last, at), n), value, label, first, last]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["doc_id", "first", "last", "value", "class", "own_first", "own_last"])


def _sketch(shingles: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray, centre: np.ndarray, step: int) -> np.ndarray:
    """For the centre of each of the rows, bits of the shingles of the first, the first two and the first three parts before
    (step -1) or after it (1), in 1, 2 and 2 words; all bits where some of these shingles are equal."""
    place = centre[:, None] + step * np.arange(1, 3 * PART + 1)
    there = (place >= 0) & (place < size[rows, None])
    some = shingles[np.where(there, begin[rows, None] + place, 0)].astype(np.uint64)
    bit = np.where(there, np.uint64(1) << (some & np.uint64(63)), np.uint64(0))
    odd = (some >> np.uint64(6)) & np.uint64(1) == 1
    words = [np.bitwise_or.reduce(bit[:, :PART], axis=1)]
    for n in (2 * PART, 3 * PART):
        words += [np.bitwise_or.reduce(np.where(w, bit, np.uint64(0))[:, :n], axis=1) for w in (odd, ~odd)]
    ranked = np.sort(np.where(there, some, (np.uint64(1) << np.uint64(40)) + np.arange(3 * PART, dtype=np.uint64)), axis=1)
    repeats = (ranked[:, 1:] == ranked[:, :-1]).any(axis=1)
    return np.stack([np.where(repeats, ~np.uint64(0), w) for w in words])


_AROUND = ("value", "class", "doc_id", "node", "first", "last", "blocks")


def _structs(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct of a column of lists, and the structs' fields."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each region of a parted group, with the shingles that stretches of LEAST places over them reach."""
    for batch in batches:
        node, doc, start = (c.to_numpy() for c in batch.columns[:3])
        row, (value, label, first, last, blocks) = _structs(batch.column(4))
        shingles, lo = batch.column(3).to_pylist(), np.maximum(0, first - LEAST + 1 - start[row])
        parts = [shingles[r][4 * u : 4 * v] for r, u, v in zip(row.tolist(), lo.tolist(), (last + LEAST - start[row]).tolist(), strict=True)]
        arrays = [*map(pa.array, (value, label, doc[row], node[row], first, last, blocks, start[row] + lo)), pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, [*_AROUND, "start", "shingles"])


def _parted_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between windows of one task, of different classes and documents; rows come sorted by task.

    Of the stretches of LEAST places over a centre, the one with most shingles that other classes of the task have too
    shows how many can be common; a window with fewer than DENSE has no link here, unless it repeats shingles that are not
    common (see _few_missed). The others are compared
    by sketches, and the pairs left are searched unless links found before over both centres connect them. Of a task of
    two blocks, the pairs across are compared."""
    for task, block, label, doc, first, last, start, shingles in _whole_keys(batches, 1):
        out = []
        edges = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(task)]])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            of = slice(lo, hi)
            out += _task_links(block[of], label[of], doc[of], first[of], last[of], start[of], [np.frombuffer(x, np.uint32) for x in shingles[of]])
        cols = list(zip(*out, strict=True)) or [[]] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_FOUND))


def _task_links(block, label, doc, first, last, start, parts: list[np.ndarray]) -> list[list[int]]:
    size = np.array([len(p) for p in parts])
    s, row, at = np.concatenate(parts), np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    order = np.argsort(s, kind="stable")
    ranked, of = s[order], label[row[order]]
    begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    several = np.minimum.reduceat(of, begin) != np.maximum.reduceat(of, begin)
    hit = np.empty(len(s), np.int64)
    hit[order] = np.repeat(several, np.diff(np.append(begin, len(s))))
    hits = np.concatenate([[0], np.cumsum(hit)])
    most = np.zeros(len(size), np.int64)
    if len(s) >= LEAST:
        inside = row[: len(s) - LEAST + 1] == row[LEAST - 1 :]
        np.maximum.at(most, row[: len(s) - LEAST + 1][inside], (hits[LEAST:] - hits[:-LEAST])[inside])
    again = (ranked[1:] == ranked[:-1]) & (row[order[1:]] == row[order[:-1]])
    before = np.full(len(s), -1)
    before[order[1:][again]] = order[:-1][again] - at[row[order[:-1][again]]]
    good = most >= DENSE
    for k in np.unique(row[(hit == 0) & (before >= 0)]).tolist():  # places do not show how many different ones are missed
        here = slice(at[k], at[k] + size[k])
        good[k] = size[k] >= LEAST and _few_missed([hit[None, here] > 0], [before[None, here]])[0]
    out, label = _run_links(s, row, at, label, doc, first, start)
    some = _unlike(np.flatnonzero(good), block, label, doc, first - start, last - start, parts)
    if not len(some):
        return out
    sides = np.concatenate([_sketch(s, at, size, some, (c - start)[some], step) for c, step in ((first, -1), (last, 1))])
    sides[:, (first != last)[some]] = ~np.uint64(0)  # which of several centres counts is open
    share, root, blocks, docs = LEAST / most[some], label[some].copy(), block[some], doc[some]
    # shingles that several classes have, as numbers of one range, a row a window; 0 is any other
    number = np.empty(len(s), np.int32)
    number[order] = np.repeat(np.where(several, np.cumsum(several), 0), np.diff(np.append(begin, len(s))))
    n_numbers, is_long = int(several.sum()) + 1, size[some] > REACH
    plain = ~np.isin(some, row[before >= 0])
    numbers, befores = np.zeros((len(some), REACH), np.int32), np.full((len(some), REACH), -1)
    for k in np.flatnonzero(~is_long).tolist():
        here = slice(at[some[k]], at[some[k]] + size[some[k]])
        numbers[k, : size[some[k]]], befores[k, : size[some[k]]] = number[here], before[here]
    one_block = block.min() == block.max()
    tile = max(1, min(256, (1 << 24) // n_numbers))
    for x, y in ((x, y) for x in range(0, len(some), tile) for y in range(x, len(some), tile)):
        a, b = slice(x, x + tile), slice(y, y + tile)
        differ = (root[a, None] != root[None, b]) & (docs[a, None] != docs[None, b])
        if not one_block:
            differ &= blocks[a, None] != blocks[None, b]
        if x == y:
            differ = np.triu(differ)
        if not differ.any():
            continue
        same = [np.bitwise_count(side[a, None] & side[None, b]) for side in sides]
        (l1, l2, l3), (r1, r2, r3) = ((w[0], w[1] + w[2], w[3] + w[4]) for w in (same[:5], same[5:]))
        good = ((l3 >= ALIKE) | (l2 + r1 >= ALIKE) | (l1 + r2 >= ALIKE) | (r3 >= ALIKE)) & differ
        i, j = np.nonzero(good)
        fits = is_long[x + i] | is_long[y + j]
        k, l = i[~fits], j[~fits]
        fits[~fits] = _can_link(numbers[a], numbers[b], befores[a], befores[b], k, l, n_numbers, plain[x + k] & plain[y + l])
        for k, l in zip((x + i[fits]).tolist(), (y + j[fits]).tolist(), strict=True):
            if root[k] == root[l]:
                continue
            p, q = int(some[k]), int(some[l])
            pair = _numbered(parts[p], parts[q])
            over = False
            for u, v, g, h in () if (is_long[k] or is_long[l]) and _hopeless(*pair) else _passages(*pair, PERCENT):
                out.append(_found((doc[p], start[p], u, v), (doc[q], start[q], g, h)))
                over |= bool(u <= first[p] - start[p] and last[p] - start[p] <= v and g <= first[q] - start[q] and last[q] - start[q] <= h)
            if over:
                root[root == root[l]] = root[k]
    return out


def _run_links(s, row, at, label, doc, first, start) -> tuple[list[list[int]], np.ndarray]:
    """Links between windows whose centre's shingle stands LEAST times in a row or more, and the classes they leave.

    Such a run alone is a passage, the same one in all these windows, so one link a class to the first of them is enough."""
    begin = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(begin, len(s)))
    begin, size = (c[size >= LEAST] for c in (begin, size))
    same = s[begin] == s[at[row[begin]] + (first - start)[row[begin]]]
    begin, size = begin[same], size[same]
    begin, size = (c[np.argsort(doc[row[begin]], kind="stable")] for c in (begin, size))
    out, joined = [], set()
    for x, n in zip(begin.tolist(), size.tolist(), strict=True):
        k, top = row[x], row[begin[0]]
        if label[k] != label[top] and label[k] not in joined and doc[k] != doc[top]:
            joined.add(label[k])
            places = [(doc[w], start[w], y - at[w], y - at[w] + m - 1) for w, y, m in ((k, x, n), (top, int(begin[0]), int(size[0])))]
            out.append(_found(*places))
    return out, np.where(np.isin(label, list(joined)), label[row[begin[0]]], label) if joined else label


def _unlike(some: np.ndarray, block, label, doc, first, last, parts: list[np.ndarray]) -> np.ndarray:
    """Some of the windows without those that have a twin: one of the same class, with the same shingles around the same
    place. A link of one links the class of both. Two documents of each stay, as a document is not linked with itself."""
    seen: dict[tuple, set] = {}
    out = []
    for k in some.tolist():
        docs = seen.setdefault((block[k], label[k], first[k], last[k], parts[k].tobytes()), set())
        if len(docs) < 2 and doc[k] not in docs:
            docs.add(doc[k])
            out.append(k)
    return np.array(out, np.int64)


def _least_share(hit: np.ndarray) -> np.ndarray:
    """For each row of hits, the least of places / hits of its stretches of LEAST places or more.

    Stretches of twice LEAST consist of two, one of which is as dense, so shorter ones are enough."""
    best, width = np.full(len(hit), 1e-9), hit.shape[1]
    if width >= LEAST:
        n = np.arange(LEAST, 2 * LEAST)
        step = max(1, AT_ONCE // (LEAST * width))
        for lo in range(0, len(hit), step):
            part = hit[lo : lo + step]
            # beyond the end nothing is hit, so a stretch that reaches there is no denser than the last one within
            sums = np.zeros((len(part), width + LEAST), np.int32)
            np.cumsum(part, axis=1, out=sums[:, 1 : width + 1])
            sums[:, width + 1 :] = sums[:, width : width + 1]
            ends = np.lib.stride_tricks.sliding_window_view(sums[:, LEAST:], LEAST, axis=1)
            for at in range(0, ends.shape[1], many := max(1, AT_ONCE // LEAST)):  # a long text in parts
                share = ((ends[:, at : at + many] - sums[:, : ends.shape[1], None][:, at : at + many]) / n).max(axis=(1, 2))
                best[lo : lo + step] = np.maximum(best[lo : lo + step], share)
    return 1 / best


def _few_missed(hits, befores) -> np.ndarray:
    """For each row of hits in two texts, whether some stretches of LEAST places miss few enough different shingles.

    Of sets with c common elements that are 80 % alike, at most c / 4 elements are not common, and a longer stretch misses
    no fewer than one within it. `befores` has the place of each shingle's occurrence before (-1: none); it counts in the
    stretches that begin after that."""
    missed = 0
    for hit, before in zip(hits, befores, strict=True):
        n = hit.shape[1]
        row, place = np.nonzero(~hit)
        begin = np.maximum(np.maximum(before[row, place] + 1, place - LEAST + 1), 0)
        counts = np.bincount(row * (n + 1) + begin, minlength=len(hit) * (n + 1)) - np.bincount(row * (n + 1) + place + 1, minlength=len(hit) * (n + 1))
        missed = missed + np.cumsum(counts.reshape(len(hit), n + 1), axis=1)[:, : n - LEAST + 1].min(axis=1)
    return (100 - PERCENT) * (hits[0] & (befores[0] < 0)).sum(axis=1) >= PERCENT * missed


def _repeats(hit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each row whether a shingle that is no hit repeats, so that fewer are missed than places show."""
    return (~hit & (before >= 0)).any(axis=1)


def _can_link(one: np.ndarray, two: np.ndarray, one_before: np.ndarray, two_before: np.ndarray, i: np.ndarray, j: np.ndarray, n_numbers: int, plain: np.ndarray) -> np.ndarray:
    """Whether the rows i of one and j of two can have a passage, pair by pair.

    Of `plain` pairs, which repeat no shingle, the common ones in one order, the answer is exact; of others stretches that
    are dense enough and miss few enough shingles may be a passage (see _hopeless)."""
    places = []  # of each number in each row, from 1
    for rows in (one, two):
        table = np.zeros((len(rows), n_numbers), np.int8)
        table[np.arange(len(rows))[:, None], rows] = np.arange(1, rows.shape[1] + 1, dtype=np.int8)
        table[:, 0] = 0
        places.append(table)
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        todo = np.arange(lo, min(lo + 4096, len(i)))
        for rows, before, r, table, t in ((two, two_before, j, places[0], i), (one, one_before, i, places[1], j)):
            other = table[t[todo][:, None], rows[r[todo]]]
            sums = np.cumsum(other > 0, axis=1, dtype=np.int16)
            enough = np.maximum(sums[:, LEAST - 1], (sums[:, LEAST:] - sums[:, :-LEAST]).max(axis=1)) >= DENSE
            enough |= _repeats(other > 0, before[r[todo]])
            todo, other, sums = todo[enough], other[enough], sums[enough]
        top = np.maximum.accumulate(other, axis=1)
        exact = plain[todo] & ((other[:, 1:] > top[:, :-1]) | (other[:, 1:] == 0)).all(axis=1)
        out[todo[exact]] = _has_passage(other[exact], sums[exact])
        rest = todo[~exact]
        hits = other[~exact] > 0, places[0][i[rest][:, None], two[j[rest]]] > 0
        befores = one_before[i[rest]], two_before[j[rest]]
        fits = np.flatnonzero(_few_missed(hits, befores))
        dense = _repeats(hits[0][fits], befores[0][fits]) | _repeats(hits[1][fits], befores[1][fits])
        open_ = fits[~dense]
        dense[~dense] = _least_share(hits[0][open_]) + _least_share(hits[1][open_]) <= MOST_SHARES
        out[rest[fits[dense]]] = True
    return out


def _has_passage(other: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether stretches of LEAST places or more, from one common shingle to another, are alike in both texts; a row holds
    the place in the other text of each shingle (0: none), ascending, and how many have one so far."""
    hit, other = other > 0, other.astype(np.int16)
    gain = (100 + PERCENT) * rank - PERCENT * (np.arange(other.shape[1], dtype=np.int16) + other)
    # the least gain so far shows which ends have a begin, if any distance in the other text would do
    least = np.minimum.accumulate(np.where(hit, gain, np.int16(2**14)), axis=1)
    some = np.flatnonzero((hit[:, LEAST - 1 :] & (gain[:, LEAST - 1 :] - least[:, : 1 - LEAST] >= PERCENT - 100)).any(axis=1))
    out, n_begins = np.zeros(len(hit), bool), hit.shape[1] - LEAST + 1
    apart = np.arange(n_begins) >= np.arange(n_begins)[:, None]  # a row a begin, from which ends are LEAST places away
    step = max(1, AT_ONCE // n_begins**2)
    for at in (some[lo : lo + step] for lo in range(0, len(some), step)):
        begin = np.where(hit[at], gain[at], np.int16(2**14))[:, :n_begins, None]
        end = np.where(hit[at], gain[at], np.int16(-(2**14)))[:, None, LEAST - 1 :]
        fits = (end - begin >= PERCENT - 100) & apart
        fits &= other[at][:, None, LEAST - 1 :] - other[at][:, :n_begins, None] >= LEAST - 1
        out[at] = fits.any(axis=(1, 2))
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the regions out of each document, as 32-bit shingles, with where they begin."""
    for batch in batches:
        node, ids, begin, parts = [], [], [], []
        docs, (of, (nodes, firsts, lasts)) = batch.column(0).to_pylist(), _structs(batch.column(2))
        edges = np.searchsorted(of, np.arange(len(batch) + 1)).tolist()
        nodes, firsts, lasts = nodes.tolist(), firsts.tolist(), lasts.tolist()
        for lo, hi, words, start in _read(batch.column(1)):
            short = (rolled_shingles(words, SHINGLE) >> np.uint64(32)).astype(np.uint32)
            start = start.tolist()
            for i in range(lo, hi):
                for k in range(edges[i], edges[i + 1]):
                    # a passage over a centre reaches less than LEAST places beyond it
                    first = max(0, firsts[k] - LEAST + 1)
                    last = min(lasts[k] + LEAST - 1, start[i - lo + 1] - start[i - lo] - SHINGLE)
                    node.append(nodes[k])
                    ids.append(docs[i])
                    begin.append(first)
                    parts.append(short[start[i - lo] + first : start[i - lo] + last + 1].tobytes())
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip((node, ids, begin, parts), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["node", "doc_id", "first", "shingles"])


def _runs(places: np.ndarray, gap: int) -> list[np.ndarray]:
    return np.split(places, np.flatnonzero(np.diff(places) > gap) + 1)


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of equal shingles, by place in a, then backwards in b.

    A shingle that would give over CROWD times as many pairs as places is aligned by its rank, from either end."""
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    lo, hi = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    n = hi - lo
    if n.max(initial=0) > CROWD:
        _, of, in_a = np.unique(a, return_inverse=True, return_counts=True)
        crowded = (n > 0) & (in_a[of] * n > CROWD * (in_a[of] + n))
    else:
        crowded = np.zeros(len(a), bool)
    at = np.flatnonzero((n > 0) & ~crowded)
    k = n[at]
    p = np.repeat(at, k)
    q = order[np.repeat(hi[at], k) - 1 - (np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))]
    if crowded.any():
        more = np.flatnonzero(crowded)
        by = more[np.argsort(a[more], kind="stable")]
        new = np.concatenate([[True], a[by[1:]] != a[by[:-1]]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(by)))
        rank = np.arange(len(by)) - np.repeat(start, size)
        back = np.repeat(size, size) - 1 - rank
        front = order[lo[by] + np.minimum(rank, n[by] - 1)]
        rear = order[hi[by] - 1 - np.minimum(back, n[by] - 1)]
        pq = np.unique(np.concatenate([np.stack([p, q]), np.stack([by, front]), np.stack([by, rear])], axis=1), axis=1)
        p, q = pq
        back_first = np.lexsort((-q, p))
        p, q = p[back_first], q[back_first]
    return p, q


def _best_links(p: np.ndarray, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The score of the best chain that ends with each match, and the match before it there (-1: none).

    Where places of the first text have many matches, those of one place are taken at once."""
    begin = np.flatnonzero(np.diff(p, prepend=-1))
    if len(p) >= DENSE_MATCHES * len(begin) * (1 + int(q.max()) / DENSE_PLACES):
        return _dense_links(p, q, percent, begin)
    # ends of chains that no end at an earlier place in b is as good as: ascending places, ascending scores
    places: list[int] = []
    tops: list[tuple[int, int]] = []
    score, link = [0] * len(p), [-1] * len(p)
    step = 100 + percent
    for i, (at, here) in enumerate(zip(q.tolist(), (percent * (p + q)).tolist(), strict=True)):
        k = bisect_left(places, at)
        gain = step
        if k:
            # matches of one place in a come backwards in b, so the one before is at an earlier place of both
            best, link[i] = tops[k - 1]
            if best > here:
                gain += best - here
        score[i] = gain
        entry = (gain + here, i)
        if k and tops[k - 1] > entry:
            continue
        j = k
        while j < len(places) and tops[j] < entry:
            j += 1
        if j == k and k < len(places) and places[k] == at:
            continue
        places[k:j], tops[k:j] = [at], [entry]
    return np.array(score), np.array(link)


def _dense_links(p: np.ndarray, q: np.ndarray, percent: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_best_links, with the best end of a chain before each place of the second text in an array; begin is where places of
    the first text begin. An end is its score and what its places cost, then its number, in one integer."""
    places, at = np.unique(q, return_inverse=True)
    score, look = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    cost, number, bits = percent * (p + q).astype(np.int64), np.arange(len(p)), int(len(p)).bit_length()
    entry, after = (cost + 100 + percent << bits) | number, at + 1
    best = np.full(len(places) + 1, -1, np.int64)
    edges = np.append(begin, len(p)).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        here = best[at[lo:hi]]
        look[lo:hi] = here
        # a chain that loses more by the places between than it has does not add to the match's own gain
        gain = np.maximum((here >> bits) - cost[lo:hi], 0)
        score[lo:hi] = gain
        to = after[lo:hi]
        best[to] = np.maximum(best[to], entry[lo:hi] + (gain << bits))
        first = to[-1]  # the matches of a place come backwards
        np.maximum.accumulate(best[first:], out=best[first:])
    return score + 100 + percent, np.where(look < 0, -1, look & ((1 << bits) - 1))


def _chains(p: np.ndarray, q: np.ndarray, percent: int, free: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of matches that follow each other in both texts: each match continues the one before it that loses least by the places between.

    A chain in whose reach no place of the first text is free when its turn comes is left out."""
    if len(p) < 2 or np.all(np.diff(p) > 0) and np.all(np.diff(q) > 0):
        yield np.arange(len(p))
        return
    score, link = _best_links(p, q, percent)
    # from every end back to a match that another chain has, and as far into that chain as a shortest stretch over the joint can reach
    reach = 4 * LEAST
    back = np.append(link, len(p))
    back[back < 0] = len(p)  # before a chain's first match
    root = np.where(link < 0, np.arange(len(p)), link)
    while ((up := root[root]) != root).any():
        root = up
    steps, furthest, jump = reach - 1, np.arange(len(p) + 1), back
    while steps:
        if steps & 1:
            furthest = jump[furthest]
        steps >>= 1
        jump = jump[jump]
    furthest = np.where(furthest < len(p), furthest, np.append(root, len(p)))
    inner = np.zeros(len(p) + 1, bool)
    inner[back] = True
    seen, link = np.zeros(len(p), bool).tolist(), link.tolist()
    ends = np.flatnonzero(~inner[:-1])
    for end in ends[np.argsort(-score[ends], kind="stable")].tolist():
        chain, last = [], end
        while end >= 0 and not seen[end]:
            seen[end] = True
            chain.append(end)
            end = link[end]
        first = int(furthest[end]) if end >= 0 else chain[-1]
        if not free[p[first] : p[last] + 1].any():
            continue
        for _ in range(reach):
            if end < 0:
                break
            chain.append(end)
            end = link[end]
        if 100 * len(chain) >= percent * LEAST:
            yield np.array(chain[::-1])


def _stretches(p: np.ndarray, q: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """First and last of the longest stretches of a chain whose matches are `percent` of all shingles they span in both texts, LEAST at least."""
    gain = (100 + percent) * np.arange(len(p)) - percent * (p + q)
    todo = [(0, len(p))]
    while todo:
        lo, hi = todo.pop()
        if 100 * (hi - lo) < percent * LEAST:
            continue
        g = gain[lo:hi]
        ahead = np.maximum.accumulate(g[::-1])  # ascending; the largest gain from each match on
        last = hi - 1 - np.searchsorted(ahead, g - (100 - percent), "left")
        first = np.arange(lo, hi)
        fits = (p[last] - p[first] + 1 >= LEAST) & (q[last] - q[first] + 1 >= LEAST)
        if not fits.any():
            continue
        k = int(np.argmax(np.where(fits, last - first, -1)))
        u, v = lo + k, int(last[k])
        yield u, v
        todo += [(lo, u), (v + 1, hi)]


def _dense(hit: np.ndarray, percent: int) -> np.ndarray:
    """The places in stretches of LEAST or more of which `percent` are hits; a passage's are, in both texts."""
    rise = np.concatenate([[0], np.cumsum(100 * hit.astype(np.int64) - percent)])
    ahead = np.maximum.accumulate(rise[::-1])
    end = len(hit) - np.searchsorted(ahead, rise, "left")
    first = np.flatnonzero(end - np.arange(len(rise)) >= LEAST)
    cover = np.zeros(len(hit) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, end[first], -1)
    return np.cumsum(cover)[:-1] > 0


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The shingles of a and b as numbers of one range, in their order, and how many numbers there are."""
    both = np.concatenate([a, b])
    order = np.argsort(both)
    ranked = both[order]
    number = np.empty(len(both), np.int64)
    number[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])[: len(both)])
    return number[: len(a)], number[len(a) :], int(number[order[-1]]) + 1 if len(both) else 0


def _among(numbers: np.ndarray, size: int) -> np.ndarray:
    """Which numbers of a range occur."""
    has = np.zeros(size, bool)
    has[numbers] = True
    return has


def _alike(a: np.ndarray, b: np.ndarray, size: int, percent: int) -> bool:
    use, mine = _among(a, size), _among(b, size)
    both = np.count_nonzero(use & mine)
    return bool(100 * both >= percent * (np.count_nonzero(use) + np.count_nonzero(mine) - both))


def passages(a: np.ndarray, b: np.ndarray, percent: int = 80) -> list[tuple[int, int, int, int]]:
    """(first, last) in a and (first, last) in b of passages of LEAST shingles or more whose sets are similar.

    All that lies between the outermost common shingles is one passage if it is similar. Else common shingles are
    chained, and the longest stretches of a chain that are similar are passages. In what those leave of a, runs of
    common shingles are bridged over gaps as wide as GAPS allow; the part of a run that fails is cut at narrower gaps."""
    return _passages(*_numbered(a, b), percent)


def _passages(a: np.ndarray, b: np.ndarray, size: int, percent: int) -> list[tuple[int, int, int, int]]:
    """passages() of numbered shingles."""
    found: list[tuple[int, int, int, int]] = []
    hit = _among(b, size)[a]
    where = np.flatnonzero(hit)
    if len(where) < 2 or where[-1] - where[0] + 1 < LEAST:
        return found
    in_b = np.flatnonzero(_among(a, size)[b])
    lo, hi, x, y = int(where[0]), int(where[-1]), int(in_b[0]), int(in_b[-1])
    if y - x + 1 < LEAST:
        return found
    if _alike(a[lo : hi + 1], b[x : y + 1], size, percent):
        return [(lo, hi, x, y)]
    free = hit.copy()

    def keep(u: int, v: int, x: int, y: int) -> bool:
        if not _alike(a[u : v + 1], b[x : y + 1], size, percent):
            return False
        found.append((u, v, x, y))
        free[u : v + 1] = False
        return True

    if 100 * len(where) >= percent * LEAST:
        in_a = np.flatnonzero(_dense(hit, percent))
        in_b = np.flatnonzero(_dense(_among(a[in_a], size)[b], percent))
        p, q = _matches(a[in_a], b[in_b])
        p, q = in_a[p], in_b[q]
        for chain in _chains(p, q, percent, free):
            cp, cq = p[chain], q[chain]
            for u, v in _stretches(cp, cq, percent):
                if free[cp[u] : cp[v] + 1].any():
                    keep(int(cp[u]), int(cp[v]), int(cq[u]), int(cq[v]))
    left = np.flatnonzero(free)
    todo = [(part, 0) for part in _split(left, where)]
    while todo:
        places, level = todo.pop()
        for run in _runs(places, GAPS[level]):
            lo, hi = int(run[0]), int(run[-1])
            if hi - lo + 1 < LEAST:
                continue
            in_b = np.flatnonzero(_among(a[lo : hi + 1], size)[b])
            for r in _runs(in_b, GAPS[level]):
                x, y = int(r[0]), int(r[-1])
                if y - x + 1 < LEAST:
                    continue
                inside = run[_among(b[x : y + 1], size)[a[run]]]  # b may hold a part of the run only
                u, v = int(inside[0]), int(inside[-1])
                if v - u + 1 >= LEAST:
                    keep(u, v, x, y)
            rest = run[free[run]]
            if len(rest) and level + 1 < len(GAPS):
                todo += [(part, level + 1) for part in _split(rest, run)]
    return found


def _split(some: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Some of the places, cut where others of them lie between."""
    if not len(some):
        return []
    return np.split(some, np.flatnonzero(np.diff(np.searchsorted(places, some)) > 1) + 1)


_FOUND = ("doc_id", "from_word", "to_word", "other_id", "other_from_word", "other_to_word")


def _found(one: tuple, other: tuple) -> list[int]:
    """A link of (document, start of its region, first and last place in it) twice, the larger document first."""
    pair = (one, other) if one[0] > other[0] else (other, one)
    return [n for doc, start, first, last in pair for n in (doc, start + first, start + last + SHINGLE)]


def _hopeless(a: np.ndarray, b: np.ndarray, size: int) -> bool:
    """Whether even the densest stretches of LEAST places or more have too few common shingles.

    Sets of a and b elements, c of them common, are 80 % alike if a / c + b / c is 2.25 at most."""
    if min(len(a), len(b)) < LEAST:
        return True
    use, mine = _among(a, size), _among(b, size)
    hits = [mine[a][None], use[b][None]]
    most = []
    for hit in hits:
        n = np.concatenate([[0], np.cumsum(hit)])
        most.append(int((n[LEAST:] - n[:-LEAST]).max()))
    if min(most) < LEAST and (100 - PERCENT) * np.count_nonzero(use & mine) < PERCENT:
        return True  # none may be missed
    if np.count_nonzero(use) < len(a) or np.count_nonzero(mine) < len(b):
        befores = [_before(x)[None] for x in (a, b)]
        if not _few_missed(hits, befores)[0]:
            return True
        if any(_repeats(h, x)[0] for h, x in zip(hits, befores, strict=True)):
            return False
    if min(most) < DENSE:
        return True
    return LEAST / most[0] + LEAST / most[1] > MOST_SHARES and sum(float(_least_share(hit)[0]) for hit in hits) > MOST_SHARES


def _before(numbers: np.ndarray) -> np.ndarray:
    """The place before each at which its number occurs, or -1."""
    order, out = np.argsort(numbers, kind="stable"), np.full(len(numbers), -1)
    again = numbers[order[1:]] == numbers[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


def _around(shingles: bytes, first: int, lo: int, hi: int) -> tuple[np.ndarray, int]:
    """The part of a region that passages over the centres lo to hi can reach, and where it begins."""
    begin = max(0, lo - LEAST + 1 - first)
    return np.frombuffer(shingles, np.uint32)[begin : hi + LEAST - first], first + begin


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of pairs of regions."""
    for batch in batches:
        out = []
        a, b, *sides = (c.to_pylist() for c in batch.columns)
        for x, y, doc, first, one, lo, hi, other, other_first, two, other_lo, other_hi in zip(a, b, *sides, strict=True):
            one, first = _around(one, first, lo, hi)
            two, other_first = _around(two, other_first, other_lo, other_hi)
            pair = _numbered(one, two)
            for u, v, p, q in () if _hopeless(*pair) else _passages(*pair, PERCENT):
                out.append((x, y, *_found((doc, first, u, v), (other, other_first, p, q))))
        cols = list(zip(*out, strict=True)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", *_FOUND])


def _candidates(texts: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals of two classes' documents that have windows of ENOUGH hashes in common, and the windows of crowded groups."""
    packed = "bucket int, rows binary"
    windows = texts.mapInArrow(_windows, packed).repartition("bucket").sortWithinPartitions("bucket")
    pairs = windows.mapInArrow(_paired, packed).repartition("bucket").sortWithinPartitions("bucket")
    found = pairs.mapInArrow(_joined, "doc_id long, first long, last long, other_id long, other_first long, other_last long, value long")
    found = materialize(found, "passage-intervals")
    # copies stand for their class, which has the same words at the same places
    for side in ("doc_id", "other_id"):
        rep = copies.select(F.col("doc_id").alias("copy_id"), F.col("rep").alias("of"))
        found = found.join(rep, F.col(side) == F.col("copy_id"), "left").withColumn(side, F.coalesce("of", side)).drop("copy_id", "of")
    crowded = found.where("value IS NOT NULL").select("value", "doc_id", "first", "last").distinct()
    return found.where("value IS NULL AND doc_id != other_id").drop("value").distinct().withColumn("candidate", F.xxhash64("doc_id", "other_id", "first", "other_first")), crowded


def _region_pairs(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions (node, doc_id, first, last), and the pairs (a, b) of them that have a candidate, and how far their candidates
    reach on either side."""
    one = candidates.select("doc_id", "first", "last", "candidate")
    two = candidates.select(F.col("other_id").alias("doc_id"), F.col("other_first").alias("first"), F.col("other_last").alias("last"), "candidate")
    sides = one.unionAll(two).repartition("doc_id").sortWithinPartitions("doc_id", "first")
    placed = sides.mapInArrow(_regions, "doc_id long, first long, last long, candidate long, own_first long, own_last long")
    placed = materialize(placed.withColumn("node", F.xxhash64("doc_id", "first")), "passage-regions")
    side = F.struct("node", "own_first", "own_last")
    pairs = placed.groupBy("candidate").agg(F.min(side).alias("x"), F.max(side).alias("y")).where("x.node != y.node")
    reach = [f(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for f, c in ((F.min, "own_first"), (F.max, "own_last"))]
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(*reach)
    return placed.select("node", "doc_id", "first", "last").distinct(), materialize(pairs, "passage-pairs")


def _verify(pairs: DataFrame, slices: DataFrame) -> DataFrame:
    """The links (a, b, and the passages) of pairs of regions around what they share."""
    one = slices.toDF("a", "doc_id", "first", "shingles")
    two = slices.toDF("b", "other_id", "other_first", "other_shingles")
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "doc_id", "first", "shingles", "x_own_first", "x_own_last", "other_id", "other_first", "other_shingles", "y_own_first", "y_own_last")
    return met.mapInArrow(_verified, "a long, b long, " + ", ".join(f"{c} long" for c in _FOUND))


def _cut(texts: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """The shingles of regions (node, doc_id, first, last)."""
    wanted = regions.groupBy("doc_id").agg(F.collect_list(F.struct("node", "first", "last")).alias("wanted"))
    cut = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    slices = cut.mapInArrow(_slices, "node long, doc_id long, first long, shingles binary")
    return materialize(slices.dropDuplicates(["node"]), name)


def _unresolved(crowded: DataFrame, links: DataFrame, texts: DataFrame) -> DataFrame:
    """The links between windows of the crowded groups that the given links do not connect."""
    link = F.xxhash64(*_FOUND)
    sides = [links.select(F.col(d).alias("of"), F.col(a).alias("from_word"), F.col(b).alias("to_word"), link.alias("link")) for d, a, b in (_FOUND[:3], _FOUND[3:])]
    over = (F.col("doc_id") == F.col("of")) & (F.col("first") >= F.col("from_word")) & (F.col("last") <= F.col("to_word") - SHINGLE)
    marked = crowded.join(sides[0].unionAll(sides[1]).distinct(), over, "left").select("value", "doc_id", "first", "last", F.coalesce("link", F.lit(0)).alias("link"))
    parted = marked.repartition("value").sortWithinPartitions("value", "doc_id", "first").mapInArrow(_parted, "value long, doc_id long, first long, last long, class long")
    placed = parted.select("doc_id", "first", "last", "value", "class").repartition("doc_id").sortWithinPartitions("doc_id", "first")
    placed = placed.mapInArrow(_parted_regions, "doc_id long, first long, last long, value long, class long, own_first long, own_last long")
    placed = materialize(placed.withColumn("node", F.xxhash64("doc_id", "first")), "passage-parted")
    slices = _cut(texts, placed.select("node", "doc_id", "first", "last").distinct(), "passage-parted-slices")
    # the sizes of groups are joined to windows before these carry their shingles
    sizes = placed.groupBy("value").agg(F.count("*").alias("rows"))
    blocks = F.ceil(F.col("rows") * F.lit(2 * LEAST - 1) / F.lit(BLOCK)).cast("long").alias("blocks")
    windows = join_counted(placed.select("node", "value", "class", "own_first", "own_last"), sizes, "value", "rows", placed.count())
    windows = windows.groupBy("node").agg(F.collect_list(F.struct("value", "class", "own_first", "own_last", blocks)).alias("windows"))
    around = slices.join(windows, "node").select("node", "doc_id", "first", "shingles", "windows").mapInArrow(_surroundings, ", ".join(f"{c} long" for c in (*_AROUND, "start")) + ", shingles binary")
    dealt = around.withColumn("block", F.pmod(F.xxhash64("node", "first"), "blocks"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.xxhash64("value", F.least("block", b), F.greatest("block", b)))
    tasks = dealt.select(F.explode(meets).alias("task"), "block", "class", "doc_id", "first", "last", "start", "shingles").repartition("task").sortWithinPartitions("task", "block", "doc_id")
    return tasks.mapInArrow(_parted_links, ", ".join(f"{c} long" for c in _FOUND))


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of near-duplicate passages: doc_id, from_word, to_word (exclusive) and the same of the smaller other_id.

    A copy of a whole document is paired with the smallest id that has these words, and with nothing else; of other
    documents, passages that links connect are not expanded into all pairs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    known = materialize(texts.mapInArrow(_identity, "doc_id long, digest binary, n_words int").where("digest IS NOT NULL"), "passage-texts")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1")
    copies = join_counted(known, classes, "digest", "rows", known.count()).where("doc_id != rep").select("doc_id", "rep", "n_words").distinct()
    copies = materialize(copies, "passage-copies")
    candidates, crowded = _candidates(texts, copies)
    regions, pairs = _region_pairs(candidates)
    slices = _cut(texts, regions, "passage-slices")
    links = materialize(_verify(pairs, slices), "passage-links")
    hidden = _unresolved(crowded, links, texts)
    ints = [F.col(c).cast("long" if c in ("doc_id", "other_id") else "int").alias(c) for c in _FOUND]
    whole = copies.select("doc_id", F.lit(0), "n_words", "rep", F.lit(0), "n_words").toDF(*_FOUND)
    return links.select(*_FOUND).unionByName(hidden).select(*ints).distinct().unionAll(whole)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans to drop: doc_id, from_word, to_word of passages that a document with a smaller id has too, overlaps merged."""
    found = shared_passages(docs, id_col, text_col)
    w = Window.partitionBy("doc_id").orderBy("from_word", "to_word")
    reach = F.max("to_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("from_word") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)
    begins = found.withColumn("reach", reach).withColumn("island", F.sum(opens).over(w))
    spans = (F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.min("other_id").alias("other_id"))
    return begins.groupBy("doc_id", "island").agg(*spans).drop("island")
