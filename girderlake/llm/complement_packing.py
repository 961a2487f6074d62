"""Best-fit packing by exact complements: single, pair and triple length sums that fill gaps, then best fit.

The plan is made on the histogram of piece lengths, which has at most ``capacity`` entries however many
pieces there are: how many sequences have which lengths in them. Pieces then find their sequence by their
length and their rank among pieces of that length, without meeting each other in any task.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.llm.arrays import IN_WORD, of_each, sliced
from girderlake.llm.store import cut

#: Words whose ids a worker remembers; when full it starts anew.
CACHE_ENTRIES = 300_000
#: Letters, then symbols: in the tokenizer's pattern two pieces, or one.
PLAIN = re.compile(r"([^\W\d_]*)([!-/:-@\[-`{-~]*)")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one free from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 32]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


BYTE_NAMES = _byte_names()


#: Normaliser and splitter of the tokenizer that the short cuts below are made for; fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Ids of whole texts, word by word, from a tokenizer that never looks across ASCII white space; of any other one text by text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.by_word = said["normalizer"] == NORMALIZER and said["pre_tokenizer"] == SPLITTER and said["post_processor"] is None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        raw = data.tobytes()
        if not self.by_word:
            texts = [raw[a:b].decode("utf-8") for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if b"<|" not in raw:  # else a special token might come of it
            raw = raw.lower()
        raw, offsets = _commas_apart(raw, offsets)
        split = [raw[a:b].split() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        if len(self.young) > CACHE_ENTRIES // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        missing = set().union(*split).difference(young)
        young.update((w, old[w]) for w in missing if w in old)
        self._learn([w for w in missing if w not in old])
        get = young.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def _learn(self, missing: list[bytes]) -> None:
        """Ids of words: letters and a tail of ASCII symbols go straight to the merges, any other word through the tokenizer."""
        cache, merge = self.young, self.tokenizer.model.tokenize
        for word in missing:
            if word.isalpha():  # ASCII letters
                cache[word] = array("I", [t.id for t in merge(word.lower().decode())]).tobytes()
                continue
            text = word.decode("utf-8")
            m = PLAIN.fullmatch(text)
            if m and (not m[1] or m[1].isalpha() and m[1].isascii()):
                ids = [t.id for part in m.groups() if part for t in merge(part.lower())]
            elif m and m[1].isalpha() and unicodedata.is_normalized("NFC", m[1]) and len(low := m[1].lower()) == len(m[1]) and "\u03a3" not in m[1] and unicodedata.is_normalized("NFC", low):
                ids = [t.id for t in merge(low.encode("utf-8").decode("latin-1").translate(BYTE_NAMES))]
                if m[2]:
                    ids += [t.id for t in merge(m[2])]
            else:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            cache[word] = array("I", ids).tobytes()


def _commas_apart(raw: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """A space before each full stop or comma between an ASCII letter and white space, where the tokenizer cuts anyway."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < 3:
        return raw, offsets
    mark = (data == 0x2C) | (data == 0x2E)
    before = (data[:-2] >= 97) & (data[:-2] <= 122)
    at = np.flatnonzero(mark[1:-1] & before & ~IN_WORD[data[2:]]) + 1
    at = at[~np.isin(at, offsets)]
    return np.insert(data, at, 0x20).tobytes(), offsets + np.searchsorted(at, offsets)


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Token pieces of every document with the task that made them and their rank in it among pieces of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = word_ids(tokenizer_path), np.zeros(capacity + 1, np.int64)
        task, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                ids = [x + end for x in encoder.encode(data, offsets)]
                total = np.array([len(x) // 4 for x in ids])
                n = -(-total // capacity)
                of, piece = np.repeat(np.arange(len(ids)), n), of_each(n)
                start = piece * capacity
                length = np.minimum(total[of] - start, capacity)
                crc = [zlib.crc32(memoryview(ids[i])[4 * a : 4 * (a + k)]) for i, a, k in zip(of.tolist(), start.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(of), np.int64)
                rank[order] = of_each(counts[counts > 0]) + seen[length[order]]
                seen += counts
                yield pa.record_batch(
                    [rows.column(0).take(pa.array(of)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(of), task)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return docs.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, task long, rank long")


class SumIndex:
    """Which lengths are left, and in how many ways two of them sum to each number: single and pair sums under counts.

    A triple sum is looked up as one length and a pair sum. Pair sums change only where a length's count reaches one or
    none, by one pass over the lengths.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        have = (left > 0).astype(np.int64)
        self.pairs = np.convolve(have, have)  # ordered pairs, and each length with itself
        self.pairs[2 * np.flatnonzero(left == 1)] -= 1  # which takes two of it

    def take(self, length: int, n: int) -> None:
        before = int(self.left[length])
        self.left[length] = after = before - n
        if after == 0:
            others = np.flatnonzero(self.left > 0)
            self.pairs[others + length] -= 2
        if before > 1 >= after:
            self.pairs[2 * length] -= 1

    def partners(self, total: int, taken: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """The pair with the longest member of at most ``most`` that sums to ``total``, besides the lengths ``taken``."""
        if total < 2 or not self.pairs[total]:
            return None
        long = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        short = total - long
        long_left, short_left = self.left[long].copy(), self.left[short].copy()
        for x in taken:
            long_left -= long == x
            short_left -= short == x
        fits = np.flatnonzero((long_left > 0) & (short_left > 0) & ((long != short) | (long_left > 1)))
        return (int(long[fits[0]]), int(short[fits[0]])) if len(fits) else None

    def complement(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths, none longer than ``length``, that fill a gap beside it exactly."""
        if gap <= length and self.left[gap] > (gap == length):
            return (gap,)
        if pair := self.partners(gap, (length,), length):
            return pair
        thirds = np.arange(min(length, gap - 2), 0, -1)
        thirds = thirds[(self.left[thirds] > (thirds == length)) & (self.pairs[gap - thirds] > 0)]
        for x in thirds.tolist():
            if pair := self.partners(gap - x, (length, x), x):
                return (x, *pair)
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences as (how many, their lengths), every piece of the histogram in exactly one.

    From the longest length down, each gap is filled exactly by one, two or three available lengths wherever such a sum
    exists (the one with the longest member is taken, as often as the counts allow). A length without any exact
    complement waits. What waits is packed by best fit decreasing.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    if left[capacity]:
        out.append((int(left[capacity]), (capacity,)))
        left[capacity] = 0
    index = SumIndex(left)
    residual: list[tuple[int, int]] = []
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            found = index.complement(length, capacity - length)
            if found is None:
                residual.append((length, int(left[length])))
                index.take(length, int(left[length]))
                break
            need = Counter((length, *found))
            n = min(int(left[x]) // k for x, k in need.items())
            for x, k in need.items():
                index.take(x, n * k)
            out.append((n, (length, *found)))
    return out + _best_fit(residual, capacity)


def _best_fit(residual: list[tuple[int, int]], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit decreasing on counts: equal pieces go together into equal open sequences of the smallest gap that takes them."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # gap: contents: count
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, contents: tuple[int, ...], n: int) -> None:
        open_[gap][contents] = open_[gap].get(contents, 0) + n
        gaps[gap] = True

    for length, n in residual:
        while n:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                contents, have = open_[gap].popitem()
                each = min(gap // length, max(1, n // have))  # as many to each as best fit would put there in the end
                take = min(have, n // each)
                if have > take:
                    put(gap, contents, have - take)
                elif not open_[gap]:
                    gaps[gap] = False
                put(gap - each * length, contents + (length,) * each, take)
                n -= take * each
            else:
                each = min(capacity // length, n)
                put(capacity - each * length, (length,) * each, n // each)
                n -= n // each * each
    return [(n, contents) for by in open_.values() for contents, n in by.items()]


class Slots:
    """Where the r-th piece of a length goes: ranges of ranks, each for some place in equal sequences."""

    def __init__(self, planned: list[tuple[int, tuple[int, ...]]], capacity: int):
        self.used = np.zeros(capacity + 1, np.int64)
        ranges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        sequence = 0
        for n, parts in planned:
            offset = 0
            for length in parts:
                ranges[length].append((int(self.used[length]), sequence, offset))
                self.used[length] += n
                offset += length
            sequence += n
        self.sequences = sequence
        self.first = np.zeros(capacity + 2, np.int64)
        rows = []
        for length in range(capacity + 1):
            self.first[length] = len(rows)
            rows += ranges[length]
        self.first[capacity + 1] = len(rows)
        self.begin, self.sequence, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(3))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows):
                a, b = self.first[length[rows[0]]], self.first[length[rows[0]] + 1]
                i = a + np.searchsorted(self.begin[a:b], rank[rows], "right") - 1
                sequence[rows] = self.sequence[i] + rank[rows] - self.begin[i]
                offset[rows] = self.offset[i]
        return sequence, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of ``capacity`` tokens; one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is the tokenizer's ids of its whole
    text (null: none) and ``end_id``; only one longer than ``capacity`` is cut, into full pieces and a rest. Rows
    that repeat, or have a null id, are packed each by itself; an empty table gives no rows. The driver holds one
    count for each length, at most ``capacity``. Pieces are written once, so later steps see the same ranks even
    if an executor is lost.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    made = cut(pieces(source, tokenizer_path, capacity, end_id))
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = slots.value.find(batch.column("length").to_numpy(), rank)
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = made.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return ranked.mapInArrow(place, "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
