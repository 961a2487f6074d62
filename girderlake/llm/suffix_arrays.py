"""Byte passages that repeat: suffix arrays by induced sorting, shard by shard, and their common prefixes.

Windows that may have an equal one elsewhere meet in buckets (see ``anchors``: records of equal content are merged
there, and one of each comes here with its text). Texts of some anchors make a shard, whose suffix array is built by induced
sorting: suffixes are classed as smaller or larger than the next, substrings between leftmost-smaller suffixes are sorted
and named, the string of names is sorted recursively in the same way, and two scans over buckets of first symbols induce
all the rest. A scan takes as many buckets at once as don't feed each other, so it is array work at every level. Common
prefixes are computed in text order: an irreducible one by comparing words of eight bytes, any other as one less
than the one before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from girderlake.llm.anchors import Plan, Symbols, document_key, read_texts, repeats_removed, text_bytes, windows_table
from girderlake.llm.arrays import DEAL

#: Bytes of a shard whose suffix array a task builds at once; a single anchor with more has a longer one.
SHARD_BYTES = 1 << 21


def _smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller."""
    n = len(text)
    sign = np.zeros(n, np.int8)
    sign[:-1] = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    sign[-1] = 1
    decided = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _placed(array: np.ndarray, fill: np.ndarray, suffixes: np.ndarray, chars: np.ndarray, step: int) -> None:
    """Put suffixes, in their order, at the fronts (step 1) or, from the end, the backs (-1) of their buckets ``chars``."""
    if not len(suffixes):
        return
    by = np.argsort(chars, kind="stable")
    chars = chars[by]
    rank = (np.arange(len(by)) - np.searchsorted(chars, chars)).astype(np.int32)
    if step > 0:
        at = fill[chars] + rank
        fill[chars] = at + 1  # of a bucket's places the last one stays
    else:
        at = fill[chars] - 1 - rank
        fill[chars] = at
    array[at] = suffixes[by]


def _scan(array: np.ndarray, text: np.ndarray, begin: np.ndarray, fill: np.ndarray, kind: np.ndarray, step: int) -> None:
    """Induce the suffixes of one kind, bucket by bucket up (step 1, larger ones) or down (-1, smaller ones).

    Places of ``array`` without a suffix hold len(text). Buckets are taken many at a time, as far as none of them induces
    a suffix of another of them; one that induces suffixes of its own (a run of one symbol) is read on as it fills.
    """
    n, sigma, most = len(text), len(begin) - 1, 64
    induces = np.zeros(n + 1, bool)  # suffixes whose predecessor is of the kind
    induces[1:n] = kind[:-1]
    char = np.empty(n + 1, text.dtype)  # the predecessor's symbol
    char[1:] = text

    def read(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of the places a to b, in the scan's order, that induce one: which, and that one's bucket."""
        found = array[a:b] if step > 0 else array[a:b][::-1]
        at = np.flatnonzero(induces[found])
        found = found[at]
        return at, found, char[found]

    c = 0 if step > 0 else sigma - 1
    while 0 <= c < sigma:
        stop = min(c + most, sigma) if step > 0 else max(c - most, -1)
        a, b = (begin[c], begin[stop]) if step > 0 else (begin[stop + 1], begin[c + 1])
        at, found, chars = read(a, b)
        near = stop
        if len(chars):
            near = min(int(chars.min()), stop) if step > 0 else max(int(chars.max()), stop)
        if near == stop:
            _placed(array, fill, found - 1, chars, step)
            c, most = stop, most * 2
        elif near != c:  # up to the first bucket that gets more
            own = np.searchsorted(at, begin[near] - a if step > 0 else b - begin[near + 1])
            _placed(array, fill, found[:own] - 1, chars[:own], step)
            c, most = near, 2 * abs(near - c)
        else:
            place, end = (begin[c], begin[c + 1]) if step > 0 else (begin[c + 1], begin[c])
            while place != fill[c]:  # those of the kind itself, as far as there are
                to = fill[c]
                _, found, chars = read(min(place, to), max(place, to))
                place = to
                _placed(array, fill, found - 1, chars, step)
            _, found, chars = read(min(place, end), max(place, end))
            _placed(array, fill, found - 1, chars, step)
            c, most = c + step, max(most // 2, 1)


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes in their (or their substrings') order."""
    n = len(text)
    begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int32)
    array = np.full(n, n, np.int32)
    seeds = lms[::-1]
    _placed(array, begin[1:].copy(), seeds, text[seeds], -1)
    _scan(array, text, begin, begin[:-1].copy(), ~smaller, 1)
    array[np.append(smaller, False)[array]] = n  # seeds are induced anew
    fill = begin[1:].copy()
    array[0], fill[0] = n - 1, 0
    _scan(array, text, begin, fill, smaller, -1)
    return array


def suffix_array(text: np.ndarray, sigma: int, levels: list[int] | None = None) -> np.ndarray:
    """Suffix array of ``text``, whose last symbol must be its only 0. levels: gets the length of the string at each level."""
    n = len(text)
    if levels is not None:
        levels.append(n)
    if n < 3:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    smaller = _smaller(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    first = _induce(text, smaller, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # names: substrings from one leftmost-smaller suffix to the next, equal where all symbols agree
    end = np.full(n, n - 1)
    end[lms[:-1]] = lms[1:]
    length = end - np.arange(n) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live, d = np.flatnonzero(same), 0
    while len(live):
        live = live[d < length[a[live]]]
        ok = text[a[live] + d] == text[b[live] + d]
        same[live[~ok]] = False
        live, d = live[ok], d + 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] == len(lms) - 1:
        return _induce(text, smaller, ordered, sigma)
    of = np.empty(n, np.int32)
    of[ordered] = names
    return _induce(text, smaller, lms[suffix_array(of[lms], int(names[-1]) + 1, levels)], sigma)


def common_prefixes(text: np.ndarray, array: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each suffix, by place in the text, its common prefix with the one before it in the array, up to ``limit``.

    limit: for each place, symbols that may be compared from it; it falls by one from place to place, or rises.
    """
    n = len(text)
    phi = np.full(n, -1)
    phi[array[1:]] = array[:-1]
    at = np.arange(n)
    irreducible = np.ones(n, bool)
    inner = (at > 0) & (phi > 0)
    irreducible[inner] = text[at[inner] - 1] != text[phi[inner] - 1]
    irreducible[1:] |= limit[1:] != limit[:-1] - 1
    irreducible[1:][inner[1:]] |= limit[phi[1:][inner[1:]]] != limit[phi[1:][inner[1:]] - 1] - 1
    most = np.where(phi >= 0, np.minimum(limit, limit[phi]), 0)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & (most > 0))
    padded = np.concatenate([text.astype(np.uint16), np.zeros(8, np.uint16)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    d = 0
    while len(live):
        equal = (eight[live + d] == eight[phi[live] + d]).astype(np.int8)
        run = np.where(equal.all(1), 8, equal.argmin(1))
        out[live] = np.minimum(d + run, most[live])
        d += 8
        live = live[(run == 8) & (most[live] > d)]
    source = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.where(irreducible, out, np.minimum(np.maximum(out[source] - (at - source), 0), most))


def repeated_windows(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each string, whether each of its windows of ``width`` bytes occurs again in any of them."""
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    text = raw.astype(np.int16) + 2
    stop = np.cumsum(sizes + 1) - 1
    text[stop] = 1
    text[-1] = 0
    limit = np.repeat(stop, sizes + 1) - np.arange(len(text))
    array = suffix_array(text, 258)
    prefix = common_prefixes(text, array, limit)
    again = prefix >= width
    again[array[:-1]] |= prefix[array[1:]] >= width
    return [again[e - n : e - width + 1] for e, n in zip(stop.tolist(), sizes.tolist())]


def may_share(anchor: np.ndarray, count: np.ndarray, size: np.ndarray, raw: bytes, width: int, k: int) -> np.ndarray:
    """Whether each text agrees with another of its anchor in half of a window's other bytes, on one side of the anchor.

    A window holds the ``k`` bytes of its anchor and, before or after them, at least half of the rest; so texts without
    this share no window, and need not be sorted.
    """
    data, half = np.frombuffer(raw, np.uint8), (width - k) // 2
    n, stop = len(size), np.cumsum(size, dtype=np.int64)
    begin = stop - size
    sums = DEAL.sums(data)
    grams = DEAL.grams(sums, k)
    of = np.repeat(np.arange(n), size)[: len(grams)]
    at = np.flatnonzero(grams == anchor[of])
    at = at[at - begin[of[at]] >= count[of[at]] - 1]  # every window of the record holds it
    place = np.full(n, -1)
    place[of[at[::-1]]] = at[::-1]  # of several places the first one stays
    out = np.zeros(n, bool)
    for first, last in ((place - half, place + k), (place, place + k + half)):
        rows = np.flatnonzero((place >= 0) & (first >= begin) & (last <= stop))
        side = DEAL.spans(sums, first[rows], last[rows])
        order = np.lexsort((side, anchor[rows]))
        same = (side[order[1:]] == side[order[:-1]]) & (anchor[rows[order[1:]]] == anchor[rows[order[:-1]]])
        out[rows[order[1:][same]]] = out[rows[order[:-1][same]]] = True
    return out


def shared_windows(table: pa.Table, width: int, k: int, most: int = SHARD_BYTES) -> pa.Table:
    """Of the texts of one bucket, the windows that occur anywhere else; those of texts known as copied are settled already."""
    f, raw = read_texts(table)
    stop = np.cumsum(f["size"], dtype=np.int64)
    rows = np.flatnonzero(may_share(f["anchor"], f["count"], f["size"], raw, width, k))
    order = rows[np.argsort(f["anchor"][rows], kind="stable")]
    anchor = f["anchor"][order]
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)) if len(anchor) else np.zeros(0, np.int64)
    total = np.append(0, np.cumsum(f["size"][order], dtype=np.int64))
    docs, parts, gone = [], [], []
    at = 0
    while at < len(order):
        fits = int(np.searchsorted(total[ends], total[at] + most, "right")) - 1
        to = int(ends[fits]) if fits >= 0 and ends[fits] > at else int(ends[np.searchsorted(ends, at, "right")])
        shard = order[at:to].tolist()
        flags = repeated_windows([raw[stop[i] - f["size"][i] : stop[i]] for i in shard], width)
        for i, flag in zip(shard, flags, strict=True):
            if not f["known"][i] and flag.any():
                hit = np.flatnonzero(flag)
                docs.append(np.full(len(hit), f["doc"][i]))
                parts.append(np.full(len(hit), f["part"][i]))
                gone.append(f["start"][i] + hit)
        at = to
    return windows_table(docs, parts, gone, width)


def _kept_bytes(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    raw = data.tobytes()
    spans = np.searchsorted(of, np.arange(len(offsets)))
    first, last = first.tolist(), last.tolist()
    kept = []
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        parts, at = [], a
        for j in range(spans[i], spans[i + 1]):
            parts.append(raw[at : a + first[j]])
            at = a + last[j]
        kept.append(b"".join([*parts, raw[at:b]]))
    size = np.diff(offsets)
    removed = size - np.array([len(x) for x in kept], np.int64)
    return [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(spans), pa.int64()), pa.array(kept, pa.binary())]


def remove_repeated_bytes(docs: DataFrame, width: int = 200, gram: int = 40, id_col: str = "doc_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Strings are judged on the input, overlaps count, and matches never cross documents. A null or empty text has no
    bytes, one shorter than ``width`` loses none. A row that repeats another (same id and text) counts as the same document:
    it is no other place, and gets the same answer. Rows of one id and different texts are different documents, as are
    documents without id and of different texts. gram: bytes of an anchor. most: records that may share one (see ``anchors``).
    """
    source, plan = document_key(docs, id_col, text_col), Plan.of(text_bytes(docs, text_col))
    schema = "n_bytes long, n_removed long, n_spans long, kept binary"
    gram = min(gram, width)
    return repeats_removed(source, plan, Symbols(False), width, gram, True, lambda table: shared_windows(table, width, gram), _kept_bytes, schema, most)
