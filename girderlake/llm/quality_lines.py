"""Quality rules: counts within each text, and lines that too many documents of one host share.

A line is normalised to its words with A-Z lower-cased and hashed. For each host (``source``) the documents with a
line are counted, documents of one text as one. Lines above the limits are removed, and a document that
loses too much by that is depleted. All of it is counting: distinct (host, line, text) rows, then two sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderlake.llm.arrays import BYTES, IN_WORD, LOWER, WORDS, SpanHash, mix, sliced, word_hashes, words
from girderlake.llm.store import cut

#: Symbols whose number in a text is counted; fixed values.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, np.int32)
_IS_SYMBOL[list(SYMBOLS)] = 1
_ROWS = SpanHash(4)
WINDOW = 5

PROFILE = "row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<struct<line:long,words:int>>"


def _again(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of each code, whether another of the same document equals it, and whether an earlier one does: as two masks."""
    order = np.argsort(mix(codes ^ mix(of.astype(np.uint64))), kind="stable")
    c, d = codes[order], of[order]
    same = (c[1:] == c[:-1]) & (d[1:] == d[:-1])
    any_, earlier = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    earlier[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, earlier


def profiles(rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The counts of each text and its lines with a word."""
    n = len(rows)
    starts, ends, of_doc = words(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(of_doc))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return total[offsets[1:]] - total[offsets[:-1]]

    word_chars = per_doc(IN_WORD[data] & ((data & 0xC0) != 0x80))
    sums = BYTES.sums(data)
    codes = BYTES.spans(sums, starts, ends)
    # windows of five words
    m = max(0, len(codes) - WINDOW + 1)
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :]) if m else np.zeros(0, np.int64)
    grams = WORDS.grams(WORDS.sums(codes), WINDOW)
    twice, _ = _again(grams[inside], doc[inside])
    cover = np.zeros(len(codes) + 1, np.int64)
    hit = inside[twice]
    cover[hit] += 1
    np.subtract.at(cover, hit + WINDOW, 1)
    covered = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
    n_repeat = covered[of_doc[1:]] - covered[of_doc[:-1]]
    # lines with a word
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    line_end = np.where(data[stop - 1] == 0x0A, stop - 1, stop)
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, line_end)
    full = np.flatnonzero(last > first)
    line_doc = doc[first[full]]
    _, earlier = _again(_ROWS.spans(_ROWS.sums(data), begin[full], line_end[full]), line_doc)
    n_dup = np.bincount(line_doc[earlier], minlength=n)
    lower = word_hashes(LOWER[data], starts, ends)
    line = WORDS.spans(WORDS.sums(lower), first[full], last[full]).view(np.int64)
    size = (last - first)[full].astype(np.int32)
    line_of = np.searchsorted(line_doc, np.arange(n + 1)).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(line_of), pa.StructArray.from_arrays([pa.array(line), pa.array(size)], names=["line", "words"]))
    whole = BYTES.spans(sums, offsets[:-1], offsets[1:]).view(np.int64)
    columns = [rows, np.diff(of_doc), word_chars, per_doc(_IS_SYMBOL[data]), n_dup, n_repeat, whole]
    return pa.record_batch([*(pa.array(c) for c in columns), lines], names=["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines"])


def judge(docs: DataFrame, share: float = 0.05, least: int = 2, depleted: float = 0.5, min_words: int = 10, max_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.

    base_failed: fewer than ``min_words`` words, or 100 * n_repeat_words > max_repeat * n_words. A line is above the
    limits if more than ``least`` documents of its host have it, and more than ``share`` of the host's documents;
    documents of equal text are one here, so that mere copies are left to deduplication. removed_words: words
    of the document's lines above the limits; it is depleted if they are more than ``depleted`` of its words. kept:
    neither base_failed nor depleted. A null text counts as empty, a null host is a host of its own; rows that repeat
    are judged each by itself.
    """
    judged, _ = _judged(docs, share, least, depleted, min_words, max_repeat, id_col, text_col, host_col)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def clean(docs: DataFrame, share: float = 0.05, least: int = 2, depleted: float = 0.5, min_words: int = 10, max_repeat: int = 20, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, without their lines above the limits; other lines stay as they are.

    Columns are those of ``docs``. A text without any such line is handed on unchanged.
    """
    judged, often = _judged(docs, share, least, depleted, min_words, max_repeat, id_col, text_col, host_col)
    drop = often.groupBy("row").agg(F.collect_set("line").alias("drop"))
    kept = judged.where("kept").join(drop, "row", "left").select("doc_id", "host", "text_key", "drop").dropDuplicates(["doc_id", "host", "text_key"])
    own = docs.select(*(docs[c].alias(f"own_{i}") for i, c in enumerate(docs.columns)))  # its columns may have any names
    of = lambda name: F.col(f"own_{docs.columns.index(name)}")
    same = of(id_col).cast("long").eqNullSafe(F.col("doc_id")) & of(host_col).eqNullSafe(F.col("host")) & (F.xxhash64(of(text_col)) == F.col("text_key"))
    met = own.join(kept, same).select(*own.columns, "drop")
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, lines in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if lines:
                    texts[i] = _without(texts[i], np.array(lines, np.int64))
            held = list(batch.columns[:-1])
            held[place] = pa.array(texts, batch.schema.types[place])
            yield pa.record_batch(held, names=names)

    return met.mapInArrow(run, docs.schema)


def _without(text: str, lines: np.ndarray) -> str:
    """A text without the lines of these hashes."""
    parts = text.split("\n")
    data = np.frombuffer("\n".join(parts).encode(), np.uint8)
    edges = np.append(0, np.cumsum([len(p.encode()) + 1 for p in parts]))
    edges[-1] -= 1
    starts, ends, _ = words(data, np.array([0, len(data)]))
    lower = word_hashes(LOWER[data], starts, ends)
    first, last = np.searchsorted(starts, edges[:-1]), np.searchsorted(starts, edges[1:])
    hashes = WORDS.spans(WORDS.sums(lower), first, last).view(np.int64)
    drop = np.isin(hashes, lines) & (last > first)
    return "\n".join(p for p, gone in zip(parts, drop.tolist(), strict=True) if not gone)


def _judged(docs: DataFrame, share: float, least: int, depleted: float, min_words: int, max_repeat: int, id_col: str, text_col: str, host_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its counts and verdict (text_key tells its text), and (row, line, words) of lines above the limits."""
    numbered = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[host_col].alias("host"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                made = profiles(np.zeros(rows.num_rows, np.int64), data, offsets)
                yield pa.record_batch([rows.column(0), rows.column(1), rows.column(3), *made.columns[1:]], names=["doc_id", "host", "text_key", *made.schema.names[1:]])

    base = cut(numbered.mapInArrow(run, PROFILE.replace("row long", "doc_id long, host string, text_key long")).withColumn("row", F.monotonically_increasing_id()))
    lines = base.select("row", "host", "text_hash", F.explode("lines").alias("l")).select("row", "host", "text_hash", "l.line", "l.words")
    hosts = base.select(F.col("host").alias("whole"), "text_hash").distinct().groupBy("whole").agg(F.count("*").alias("documents"))
    seen = lines.select("host", "line", "text_hash").distinct().groupBy("host", "line").agg(F.count("*").alias("having")).where(F.col("having") > least)
    limit = seen.join(hosts, F.col("host").eqNullSafe(F.col("whole"))).where(F.col("having") > share * F.col("documents")).select(F.col("host").alias("h"), F.col("line").alias("often"))
    over = lines.join(limit, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("often"))).select("row", "line", "words")
    removed = over.groupBy("row").agg(F.sum("words").alias("removed_words"))
    out = base.drop("lines", "text_hash").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (F.col("removed_words") <= depleted * F.col("n_words"))), over
