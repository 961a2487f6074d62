"""Word passages that repeat: suffixes split by prefixes of variable length into groups that fit in memory, a tree for each.

Every window of ``width`` words is the top of a suffix. Those that may have an equal one elsewhere meet in buckets (see
``anchors``: records of equal content are merged there, and one of each comes here with its text). In a bucket, suffixes
are split by a prefix of five words; one with a prefix of its own is a leaf and goes, and a group with more than
``GROUP`` suffixes is split again by a prefix twice as long, until it fits or the prefix is the whole window. Of each group
a subtree is built: words that all suffixes of a node share are skipped at once, as the label of an edge, and the next word
splits it. An internal node at depth ``width`` is a maximal repeat cut at that depth: its suffixes are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from girderlake.llm.anchors import Plan, Symbols, document_key, read_texts, repeats_removed, text_bytes, windows_table
from girderlake.llm.arrays import WORDS, of_each, word_hashes, words

#: Suffixes whose subtrees a task builds at once.
GROUP = 1 << 17


def prefix_groups(codes: np.ndarray, tops: np.ndarray, width: int, prefix: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(places in ``tops``, group of each, length of the prefix): all suffixes that share a prefix with another.

    A group with more than ``most`` suffixes is split by longer prefixes, so it is larger only if whole windows are equal.
    Groups come several at a time, ``most`` suffixes in all.
    """
    sums = WORDS.sums(codes)
    at, depth = np.arange(len(tops)), min(prefix, width)
    while len(at):
        key = WORDS.spans(sums, tops[at], tops[at] + depth)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        size = np.bincount(group)[group]
        fits = (size <= most) | (depth == width)
        chosen = np.flatnonzero((size > 1) & fits)
        first = np.flatnonzero(np.append(True, np.diff(group[chosen]) != 0)) if len(chosen) else chosen
        a = 0
        while a < len(chosen):
            i = max(int(np.searchsorted(first, a + most, "right")) - 1, int(np.searchsorted(first, a)) + 1)
            b = int(first[i]) if i < len(first) and a + most < len(chosen) else len(chosen)
            yield at[chosen[a:b]], group[chosen[a:b]] - group[chosen[a]], depth
            a = b
        at, depth = at[~fits], min(2 * depth, width)


def deep_nodes(codes: np.ndarray, tops: np.ndarray, label: np.ndarray, depth: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, node of each) of the internal nodes at depth ``width``, in subtrees of groups ``label`` that share ``depth`` words."""
    at, deep = np.arange(len(tops)), np.full(len(tops), depth)
    while len(at):
        order = np.argsort(label, kind="stable")
        at, label, deep = at[order], label[order], deep[order]
        size = np.bincount(label)[label]
        at, label, deep = at[size > 1], label[size > 1], deep[size > 1]  # leaves go
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = label[1:] != label[:-1]
        head = np.flatnonzero(new)
        label = np.cumsum(new) - 1
        # the edge: words that every suffix of the node shares with its first
        shared, leader = np.full(len(at), width), head[label]
        open_, d = np.flatnonzero(deep < width), 0
        while len(open_):
            where = deep[open_] + d
            same = where < width
            same[same] = codes[tops[at[open_[same]]] + where[same]] == codes[tops[at[leader[open_[same]]]] + where[same]]
            shared[open_[~same]] = np.minimum(where[~same], width)
            open_, d = open_[same], d + 1
        reach = np.minimum.reduceat(shared, head)[label]
        done = reach >= width
        if done.any():
            yield at[done], label[done]
        at, label, reach = at[~done], label[~done], reach[~done]
        branch = codes[tops[at] + reach]
        order = np.lexsort((branch, label))
        at, label, reach, branch = at[order], label[order], reach[order], branch[order]
        new = np.ones(len(at), bool)
        new[1:] = (label[1:] != label[:-1]) | (branch[1:] != branch[:-1])
        label, deep = np.cumsum(new) - 1, reach + 1


def later_windows(table: pa.Table, width: int, prefix: int, most: int = GROUP) -> pa.Table:
    """Of the texts of one bucket, the windows that an equal one of a smaller document, or earlier in it, precedes."""
    f, raw = read_texts(table)
    raw = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(raw, np.append(0, np.cumsum(f["size"], dtype=np.int64)))
    codes = word_hashes(raw, starts, ends)
    count = f["count"].astype(np.int64)
    first = np.cumsum(count + (width - 1)) - (count + (width - 1))
    of = np.repeat(np.arange(len(count)), count)
    tops = first[of] + of_each(count)
    start = f["start"][of] + of_each(count)
    docs, parts, gone = [], [], []
    for places, label, depth in prefix_groups(codes, tops, width, prefix, most):
        for at, node in deep_nodes(codes, tops[places], label, depth, width):
            at = places[at]
            doc, part, s = f["doc"][of[at]], f["part"][of[at]], start[at]
            order = np.lexsort((s, part, doc, node))
            doc, part, s, node = doc[order], part[order], s[order], node[order]
            new = np.ones(len(order), bool)
            new[1:] = node[1:] != node[:-1]
            docs.append(doc[~new])
            parts.append(part[~new])
            gone.append(s[~new])
    return windows_table(docs, parts, gone, width)


def _kept_words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    raw = data.tobytes()
    spans = np.searchsorted(of, np.arange(len(offsets))).tolist()
    first, last = first.tolist(), last.tolist()
    n_words, n_removed, texts = [], [], []
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        own = raw[a:b].split()  # at the same bytes as words()
        kept, at = [], 0
        for j in range(spans[i], spans[i + 1]):
            kept += own[at : first[j]]
            at = last[j]
        kept += own[at:]
        n_words.append(len(own))
        n_removed.append(len(own) - len(kept))
        texts.append(b" ".join(kept).decode("utf-8"))
    return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())]


def remove_repeated_passages(docs: DataFrame, width: int = 20, prefix: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), whole_if_clean: bool = False, most: int | None = None) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier: doc_id, n_words, n_removed, kept_text.

    Earlier: in a document of smaller id, or before it in the same. Windows are judged on the input. kept_text is
    the words that stay, joined by one space; with whole_if_clean, a text that loses none stays as it is. A null or empty
    text has no words, a text shorter than ``width`` loses none. A row that repeats another (same id and text) counts as the
    same document and gets the same answer. Rows of one id and different texts are different documents, ordered by a
    hash of their texts; so are documents without id, which come after all others. prefix: words of the shortest prefix that
    splits suffixes, and of anchors. keep: input columns to hand on. most: records that may share an anchor (see ``anchors``).
    """
    source = document_key(docs, id_col, text_col, keep)

    def kept(data: np.ndarray, offsets: np.ndarray, of: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
        out = _kept_words(data, offsets, of, first, last)
        if whole_if_clean:
            raw, edges = data.tobytes(), offsets.tolist()
            texts = [t if n else raw[a:b].decode("utf-8") for t, n, a, b in zip(out[2].to_pylist(), out[1].to_pylist(), edges[:-1], edges[1:], strict=True)]
            out[2] = pa.array(texts, pa.string())
        return out

    plan = Plan.of(text_bytes(docs, text_col))
    schema = "n_words long, n_removed long, kept_text string"
    out = repeats_removed(source, plan, Symbols(True), width, min(prefix, width), False, lambda table: later_windows(table, width, prefix), kept, schema, most)
    return out.withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})
