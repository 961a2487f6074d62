"""SentencePiece encoding and decoding for merge-type vocabularies, in Arrow batches.

Merging follows scores, not word bounds: all adjacent pairs of symbols whose joined text is a piece stand on an agenda,
the best score first and of equal scores the leftmost. The best is joined, its neighbours offer new pairs, and
entries whose symbols have changed since are passed over. Short runs of one batch keep their agendas as rows of an array,
so that each step joins the best pair of every run at once; long runs keep a heap. A pair that crosses from another letter to the space mark can't
join if no piece holds such a pair, so texts fall into runs at these places, and merged runs are kept by their text.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from girderlake.llm.arrays import sliced

SPACE = "▁"
#: Merged runs that a task keeps before it starts anew.
KEPT_RUNS = 1 << 19
#: Letters of a run whose agenda is a row of an array, and cells of such an array.
SHORT, CELLS = 64, 1 << 18
#: An offer is the place of a joined score, above the piece that it makes; no piece is above all.
PIECE_BITS, NO_PAIR, PAD = 32, 1 << 62, -1
#: Bytes of text that a task encodes at once.
SLICE = 2 << 20
#: Kinds of pieces and of models in a model file; fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message: integers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class Pieces:
    """A merge-type model: pieces with scores, and what it does to a text before merging."""

    def __init__(self, model: bytes):
        parts = list(_fields(model))
        trainer = dict(chain.from_iterable(_fields(v) for k, v in parts if k == 2))
        normalizer = dict(chain.from_iterable(_fields(v) for k, v in parts if k == 3))
        self.texts: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(dict(_fields(v)) for k, v in parts if k == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            self.texts.append(text)
            if kind == NORMAL:
                self.ids[text], self.scores[text] = i, struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            elif kind == BYTE:
                self.bytes[int(text[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind != CONTROL:
                raise ValueError(f"pieces of kind {kind} are not supported")
        if trainer.get(3, 1) != MERGES or len(self.bytes) != 256:
            raise ValueError("only merge-type models with pieces for all bytes are supported")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that change no character and keep white space are supported")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        whole = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        self._runs = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._kept: dict[str, bytes] = {}
        # symbols: pieces, then letters that only stand in pieces; a letter of none is -2 less its codepoint
        symbols = dict(self.ids)
        for c in sorted({c for t in self.ids for c in t} - symbols.keys()):
            symbols[c] = len(self.texts) + len(symbols) - len(self.ids)
        self._letters = {i: t for t, i in symbols.items() if t not in self.ids}
        self._symbol = -2 - np.arange(0x110000, dtype=np.int64)
        for t, i in symbols.items():
            if len(t) == 1:
                self._symbol[ord(t)] = i
        score_counts = Counter(self.scores[t] for t in self.ids if len(t) > 1)
        places = {score: i for i, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs = sorted((symbols[t[:k]] << 32 | symbols[t[k:]], places[self.scores[t]] << PIECE_BITS | i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols)
        self._pairs, self._offer = (np.array([x[i] for x in pairs] or [0], np.int64) for i in range(2))
        # of pieces of one score the leftmost pair goes first, which an array's least offer doesn't tell
        shared = [t for t in self.ids if len(t) > 1 and score_counts[self.scores[t]] > 1]
        shortest = [t for t in shared if not any(o in t for o in shared if len(o) < len(t))]
        self._tied = re.compile("|".join(map(re.escape, shortest)) or "(?!)")
        self._out = [b"" for _ in self.texts]  # unknown and control pieces have no text here
        for text, i in self.ids.items():
            self._out[i] = text.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self._out[i] = bytes([byte])

    def merge(self, run: str) -> bytes:
        """Ids of one run as 32-bit integers, by an agenda that is a heap."""
        n = len(run)
        symbols, before, after = list(run), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, int]] = []
        scores = self.scores

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                joined = symbols[left] + symbols[right]
                score = scores.get(joined)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, right, len(joined)))

        for i in range(1, n):
            offer(i - 1, i)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out.extend([i] if i is not None else [self.bytes[b] for b in s.encode()])
        return np.array(out, np.int32).tobytes()

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of symbols offer."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (left >= 0) & (right >= 0), self._offer[at], NO_PAIR)

    def _merge_short(self, runs: list[str]) -> None:
        """Keep the ids of runs of like length, none with pairs of equal scores: every step joins the best pair of each."""
        lengths = np.array([len(r) for r in runs])
        width = int(lengths.max())
        symbols = np.full((len(runs), width + 1), PAD, np.int64)
        symbols[:, :width][np.arange(width) < lengths[:, None]] = self._symbol[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)]
        offers = self._offers(symbols[:, :-1], symbols[:, 1:])
        active, rows = np.arange(len(runs)), np.arange(len(runs))
        while len(active):
            best = offers.argmin(1)
            taken = offers[rows, best]
            ended = taken == NO_PAIR
            if ended.any():
                self._keep([runs[r] for r in active[ended].tolist()], symbols[ended])
                active, symbols, offers, best, taken = (x[~ended] for x in (active, symbols, offers, best, taken))
                rows = rows[: len(active)]
                if not len(active):
                    break
                # what no row needs any more
                used = int((symbols != PAD).any(0).sum()) + 1
                symbols, offers = symbols[:, :used], offers[:, : used - 1]
            symbols[rows, best] = taken & ((1 << PIECE_BITS) - 1)
            # what stands right of the joined pair moves up
            moved = np.arange(offers.shape[1]) > best[:, None]
            symbols[:, :-1][moved] = symbols[:, 1:][moved]
            symbols[:, -1] = PAD
            later = moved[:, :-1]
            offers[:, :-1][later] = offers[:, 1:][later]
            offers[:, -1] = NO_PAIR
            offers[rows, best] = self._offers(symbols[rows, best], symbols[rows, best + 1])
            left = np.flatnonzero(best)
            offers[left, best[left] - 1] = self._offers(symbols[left, best[left] - 1], symbols[left, best[left]])

    def _keep(self, runs: list[str], symbols: np.ndarray) -> None:
        """Keep the ids of runs, from rows of symbols; a letter that is no piece is its bytes."""
        flat = symbols[symbols != PAD]
        of = np.repeat(np.arange(len(runs)), (symbols != PAD).sum(1))
        for at in np.flatnonzero((flat < 0) | (flat >= len(self.texts)))[::-1].tolist():
            letter = chr(-2 - flat[at]) if flat[at] < 0 else self._letters[int(flat[at])]
            ids = [self.bytes[b] for b in letter.encode()]
            flat, of = np.concatenate([flat[:at], ids, flat[at + 1 :]]), np.concatenate([of[:at], np.full(len(ids), of[at]), of[at + 1 :]])
        raw, edges = flat.astype(np.int32).tobytes(), (4 * np.searchsorted(of, np.arange(len(runs) + 1))).tolist()
        self._kept.update(zip(runs, [raw[a:b] for a, b in zip(edges, edges[1:])], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; none of an empty one."""
        split = [self._runs.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        kept = self._kept
        if len(kept) > KEPT_RUNS:
            kept.clear()
        found = set().union(*split).difference(kept)
        plain = [r for r in found if len(r) <= SHORT and not self._tied.search(r)]
        missing, others = sorted(plain, key=len), found.difference(plain)
        lengths = np.array([len(r) for r in missing])
        at = 0
        while at < len(missing):
            widest = min(max(8, int(lengths[at]) * 5 // 4), SHORT)
            stop = min(int(np.searchsorted(lengths, widest, "right")), at + 1 + CELLS // widest)
            self._merge_short(missing[at:stop])
            at = stop
        for run in others:
            kept[run] = self.merge(run)
        out = [np.frombuffer(b"".join(map(kept.__getitem__, runs)), np.int32) for runs in split]
        for run in others:
            if len(run) > SHORT:
                del kept[run]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids that ``encode`` gave: pieces joined, the mark that stands before the first word left out."""
        raw = b"".join(map(self._out.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[Pieces, sentencepiece.SentencePieceProcessor]:
    return Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def encode_documents(docs: DataFrame, model_file: str, checked: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array of int), n_tokens, decoded (the text of the ids).

    A null text counts as empty: no ids, an empty text. Rows that repeat are encoded each by itself; other columns, of
    whatever names, play no part; an empty table gives no rows. A text is read whole, and a task holds half a megabyte of
    text or one text. checked: every Arrow batch is held against the sentencepiece library, ids and
    decoded texts, and a difference ends the job. The model is read on the driver and sent to tasks (the file's size).
    """
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, library = _loaded(model.value)
        for batch in batches:
            for rows, _, _ in sliced(batch, "text", SLICE):
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids = pieces.encode(texts)
                sizes, plain = np.array([len(i) for i in ids], np.int64), [i.tolist() for i in ids]
                decoded = [pieces.decode(i) for i in plain]
                if checked:
                    if library.encode(texts, num_threads=1) != plain:
                        raise ValueError("ids differ from those of the sentencepiece library")
                    if library.decode(plain, num_threads=1) != decoded:
                        raise ValueError("decoded texts differ from those of the sentencepiece library")
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.record_batch([rows.column(0), listed, pa.array(sizes), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")
