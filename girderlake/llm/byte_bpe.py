"""Byte-level BPE: pre-tokens by an associative scan over codepoint classes, ids by cached pair merging.

Splitting a text is the run of a small automaton over codepoint classes. A step of it is a function from
state to state; functions compose associatively, and all compositions that can occur are few, so each gets a
number and composing two is one table lookup. A scan over blocks then gives every codepoint's state with
array operations only. Pre-token slices are looked up in a cache of the worker; those missing are merged
together, one array step for all of them at a time.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from girderlake.llm.arrays import of_each, sliced

#: The pattern whose matches the automaton finds; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens that a worker remembers; when full it starts anew.
CACHE_ENTRIES = 300_000

# Symbols: codepoint classes, refined by what follows.
LETTER, NUMBER, OTHER, SPACE_IN_RUN, LAST_SPACE, LAST_BLANK, SHORT_QUOTE, LONG_QUOTE, FIRST = range(9)
# States after a codepoint; FRESH: whatever follows begins a pre-token.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINS, ONE_MORE, TWO_MORE, FRESH = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the codepoint begins a pre-token."""
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FRESH, ONE_MORE)[state == TWO_MORE], False
        return IN_LETTERS, state not in (IN_LETTERS, JOINS)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINS)
    if symbol == OTHER or symbol in (SHORT_QUOTE, LONG_QUOTE) and state in (IN_OTHERS, JOINS):
        return IN_OTHERS, state not in (IN_OTHERS, JOINS)
    if symbol in (SHORT_QUOTE, LONG_QUOTE):
        return (ONE_MORE if symbol == SHORT_QUOTE else TWO_MORE), True
    if symbol == SPACE_IN_RUN:
        return IN_SPACES, state != IN_SPACES
    return (JOINS if symbol == LAST_BLANK else FRESH), True  # FIRST too: it stands before a text


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function number of each symbol, composition table, functions as rows of states, begins by state and symbol."""
    single = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    numbers = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in single:
            if (h := tuple(g[s] for s in f)) not in numbers:
                numbers[h] = len(numbers)
                todo.append(h)
    rows = list(numbers)
    table = np.array([[numbers[tuple(g[s] for s in f)] for g in rows] for f in rows], np.int16)
    begins = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([numbers[f] for f in single], np.int16), table, np.array(rows, np.int8), begins


@functools.cache
def codepoint_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every codepoint."""
    out = np.full(0x110000, OTHER, np.uint8)
    valid = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, valid):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            out[lo : hi + 1] = np.where((np.arange(lo, hi + 1) >= 0xD800) & (np.arange(lo, hi + 1) < 0xE000), OTHER, kind)
    return out


def _prefix_states(functions: np.ndarray) -> np.ndarray:
    """State after each codepoint, from compositions of all functions up to it."""
    _, table, rows, _ = _automaton()
    flat, m = table.ravel(), len(table)
    width = 64
    if len(functions) <= width:
        out, f = np.empty(len(functions), np.int8), 0
        for i, g in enumerate(functions):
            f = table[f, g]
            out[i] = rows[f, FRESH]
        return out
    n = -(-len(functions) // width) * width
    grid = np.zeros(n, np.int64)
    grid[: len(functions)] = functions
    grid = np.ascontiguousarray(grid.reshape(-1, width).T)
    for i in range(1, width):
        grid[i] = flat[grid[i - 1] * m + grid[i]]
    entry = np.empty(grid.shape[1], np.int8)
    entry[0], entry[1:] = FRESH, _prefix_states(grid[-1])[:-1]
    return np.ascontiguousarray(rows.ravel()[grid * 8 + entry].T).ravel()[: len(functions)]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of the texts, and n + 1 offsets of texts into them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = codepoint_classes()[code]
    first = np.unique(np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]]))
    n = len(code)
    ends = np.zeros(n + 2, bool)  # whether a text ends before this codepoint
    ends[first], ends[n:] = True, True
    symbol = kind.copy()
    space = kind == 3
    follows = np.zeros(n, bool)  # a codepoint of the same text that isn't white space
    follows[:-1] = ~space[1:]
    follows &= ~ends[1 : n + 1]
    symbol[space & follows] = LAST_SPACE
    symbol[space & follows & (code == 0x20)] = LAST_BLANK
    quotes = np.flatnonzero((code == 0x27) & ~ends[1 : n + 1])
    if len(quotes):
        padded = np.append(code, [0, 0])
        a, b = padded[quotes + 1], padded[quotes + 2]
        symbol[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT_QUOTE
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[quotes[two & ~ends[quotes + 2]]] = LONG_QUOTE
    numbers, _, _, begins = _automaton()
    symbol = np.insert(symbol, first, FIRST)
    states = _prefix_states(numbers[symbol])
    before = np.empty(len(states), np.int8)
    before[0], before[1:] = FRESH, states[:-1]
    starts = at[begins[before, symbol][symbol != FIRST]]
    return starts, np.searchsorted(starts, offsets)


class Vocabulary:
    """Ranks of byte strings, and the rank that each pair of ranks merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        get, keys, merged = self.ranks.get, [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.of_byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int64)
        self.cache: dict[bytes, bytes] = {}
        top = max(self.bytes, default=-1) + 1
        self.size_of = np.array([len(self.bytes.get(i, b"")) for i in range(top)], np.int64)
        self.place_of = np.cumsum(self.size_of) - self.size_of
        self.letters = np.frombuffer(b"".join([self.bytes.get(i, b"") for i in range(top)]), np.uint8)

    NONE = 1 << 40

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (left >= 0) & (right >= 0), self.merged[i], self.NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is None:
                todo.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        todo.sort(key=lambda i: len(pieces[i]))
        at = 0
        while at < len(todo):  # pieces of like length together, so that little is padded
            longest = max(16, len(pieces[todo[at]]) * 5 // 4)
            stop = at
            while stop < len(todo) and len(pieces[todo[stop]]) <= longest and (stop - at) * longest < 1 << 18:
                stop += 1
            stop = max(stop, at + 1)
            group = todo[at:stop]
            if len(pieces[group[-1]]) > 4096:
                for i in group:
                    out[i] = self._merge_long(pieces[i])
            else:
                for i, ids in zip(group, self._merge_group([pieces[i] for i in group]), strict=True):
                    out[i] = ids
            at = stop
        return out

    def _merge_group(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[:, :width][np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        active = np.arange(len(pieces))
        done: list[bytes] = [b""] * len(pieces)
        while len(active):
            best = ranks.argmin(1)
            rows = np.arange(len(active))
            rank = ranks[rows, best]
            if (over := rank == self.NONE).any():
                for r in np.flatnonzero(over):
                    row = ids[r]
                    done[active[r]] = row[row >= 0].astype("<u4").tobytes()
                keep = ~over
                active, ids, ranks, best, rank = active[keep], ids[keep], ranks[keep], best[keep], rank[keep]
                rows = rows[: len(active)]
                if not len(active):
                    break
            ids[rows, best] = rank
            width = ids.shape[1]
            take = np.arange(width - 1) + (np.arange(width - 1) > best[:, None])
            ids = np.take_along_axis(ids, take, 1)
            ids = np.concatenate([ids, np.full((len(ids), 1), -1)], 1)
            take = np.minimum(np.arange(width - 1) + (np.arange(width - 1) > best[:, None]), width - 2)
            ranks = np.take_along_axis(ranks, take, 1)
            ranks[:, -1] = self.NONE
            ranks[rows, best] = self._pair_ranks(ids[rows, best], ids[rows, best + 1])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._pair_ranks(ids[left, best[left] - 1], ids[left, best[left]])
        return done

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece: a heap of pairs over a linked list."""
        import heapq

        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        pair = {int(k): int(v) for k, v in zip(self.keys, self.merged, strict=True)} if not hasattr(self, "pair") else self.pair
        self.pair = pair
        ids, n = ids.tolist(), len(ids)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := pair.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
        """For each text its ids, and of each of its pre-tokens the byte where it starts and how many ids it has."""
        starts, of_text = pretokens(data, offsets)
        raw = data.tobytes()
        bounds = [*starts.tolist(), len(raw)]
        pieces = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        missing = [p for p in set(pieces) if p not in cache]
        cache.update(zip(missing, self.merge(missing), strict=True))
        ids = [cache[p] for p in pieces]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return [(b"".join(ids[a:b]), starts[a:b] - t, counts[a:b]) for a, b, t in zip(of_text.tolist(), of_text[1:].tolist(), offsets[:-1].tolist())]

    def decode(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
        """Bytes of the ids, those of each pre-token at the place where it started."""
        size = self.size_of[ids]
        inside = np.cumsum(size) - size  # from the first id on
        first = np.cumsum(counts) - counts
        at = np.repeat(starts - inside[first], counts) + inside
        out = np.zeros(int((at[-1:] + size[-1:]).sum()), np.uint8)
        step = of_each(size)
        out[np.repeat(at, size) + step] = self.letters[np.repeat(self.place_of[ids], size) + step]
        return out.tobytes()

@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, n_pretokens, ids, starts, counts, decoded.

    ids, and the byte where each pre-token starts and how many ids it has, are little-endian uint32 in binary; decoded is
    the bytes that ids give when each pre-token's are put where it started.

    A null or empty text has no tokens and decodes to no bytes. Rows may repeat and may have a null id; each
    row is answered by itself. The vocabulary file must be on every executor at ``vocab_path``. pattern: the vocabulary's
    own; any other than PATTERN is an error, since the automaton is made for that.
    """
    if pattern != PATTERN:
        raise ValueError(f"pre-tokens are found for the pattern {PATTERN} only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(vocab_path)
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                made = own.encode(data, offsets)
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array([len(x) // 4 for x, _, _ in made], pa.int64()),
                        pa.array([len(c) for _, _, c in made], pa.int64()),
                        pa.array([x for x, _, _ in made], pa.binary()),
                        pa.array([s.astype("<u4").tobytes() for _, s, _ in made], pa.binary()),
                        pa.array([c.astype("<u4").tobytes() for _, _, c in made], pa.binary()),
                        pa.array([own.decode(np.frombuffer(x, "<u4"), s, c) for x, s, c in made], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "n_pretokens", "ids", "starts", "counts", "decoded"],
                )

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long, ids binary, starts binary, counts binary, decoded binary")


