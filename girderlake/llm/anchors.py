"""Two rounds that bring equal windows of text together: hashes of runs first, then text only where runs meet.

A window's anchor is the least hash of the k-grams in its ``width`` symbols, so equal windows have equal anchors wherever
they stand, and neighbouring windows mostly share one. A run of windows with one anchor is a record: anchor, a second hash
of all that the run covers, its place. In the first round only these hashes travel. Records of one anchor meet in a bucket:
an anchor met once has no repeat and is dropped; records of the same content (both hashes and the length agree) are
merged, the first place leads. Only where an anchor has records of different content are the leaders' texts asked for; they
travel in the second round, and a tree or suffix array decides about them. Most text never travels.

Both rounds are dealt by hashes into buckets whose number follows the bytes of the input (``Plan``), whatever the
session's settings are. Anchors with very many different records (those at the edges of a passage that many documents
share) are counted before: their windows are dealt one by one by hashes of the whole window, which is the longest prefix
there is, so that windows that meet are equal and no text is needed. There are at most 2**20 such anchors (``hot_anchors``).

Anchors only deal. What decides that two records of one anchor are the same is a hash modulo the prime 2**61 - 1, which takes
two different ones for the same by a chance of some 2**-50, and their length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderlake.llm.arrays import CHECK, DEAL, of_each, sliced, window_min, word_hashes, words
from girderlake.llm.store import cut

#: Bytes of text whose records a task combines before it hands them on.
UNIT_BYTES = 32 << 20
#: Records of different content that may share an anchor, besides one for each unit; windows of others are dealt one by one.
MOST_RECORDS = 2048
#: Of an anchor key: low bits that hold the position, which ends ties of hashes.
PLACE_BITS = 24
SEGMENT = 1 << 22
#: States of a record: it leads its unit's places of this content; there are more in the unit; it is a single window.
LEAD, TWICE, WINDOW = 1, 2, 4

NO_ID = (1 << 63) - 1
KEY = {"anchor": np.uint64, "check": np.uint64, "doc": np.int64, "part": np.int64, "start": np.int64, "count": np.int32, "state": np.int8}
TEXT = {"anchor": np.uint64, "doc": np.int64, "part": np.int64, "start": np.int64, "count": np.int32, "size": np.int32, "known": np.int8}
SPANS = "doc long, part long, first long, last long"
MET = f"{SPANS}, anchor long, known boolean"


@dataclass(frozen=True)
class Symbols:
    """What windows are made of: words of a text, or its bytes."""

    of_words: bool

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Codes, offsets of documents into them, and byte starts and ends of each symbol (None: it is a byte)."""
        if not self.of_words:
            return data, offsets, None, None
        starts, ends, of_doc = words(data, offsets)
        return word_hashes(data, starts, ends), of_doc, starts, ends


@dataclass(frozen=True)
class Plan:
    """Tasks and buckets for so many bytes of text: tasks of 4 MB, of more only beyond 4096 of them; buckets of at most 32 MB.

    The second round has less to carry, so it has a quarter of them where that leaves some for every core of a machine.
    """

    tasks: int
    buckets: int

    @property
    def second(self) -> Plan:
        return Plan(max(min(self.tasks, 16), self.tasks // 4), max(min(self.buckets, 16), self.buckets // 4))

    @classmethod
    def of(cls, n_bytes: int) -> Plan:
        share = min(max(n_bytes // 4096, 4 << 20), 256 << 20)
        return cls(-(-n_bytes // share) + 1, -(-n_bytes // min(share, 32 << 20)) + 1)


def document_key(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc, part, text, and columns to keep as kept_0, ...

    (doc, part) tells documents apart and orders them: doc is the id, or above all ids where it is null; part is a 64-bit hash of
    the text, so that rows of one id and different texts are different documents, and rows that repeat both are one. Two
    different texts among n rows of one id, or without id, have one key by a chance of n * n / 2**65.
    """
    doc, text = docs[id_col].cast("long"), docs[text_col]
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("part"), text.alias("text"), *(docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(docs[text_col]).cast("long"))).first()[0] or 0


def window_runs(grams: np.ndarray, valid: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each run with one anchor, and the anchor's place.

    grams: hashes of k-grams; valid: for each window start, whether the window lies within one text.
    """
    starts, counts, places = [], [], []
    span = width - k + 1
    n = len(valid)
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT)
        part = grams[a : b + span - 1]
        least = window_min((part >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(part), dtype=np.uint64), span)
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)[: b - a]
        own = np.flatnonzero(valid[a:b])
        if not len(own):
            continue
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(at[own]) != 0) | (np.diff(own) != 1)
        first = np.flatnonzero(new)
        starts.append(own[first] + a)
        counts.append(np.diff(np.append(first, len(own))))
        places.append(at[own[first]] + a)
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(places)


Fields = dict[str, np.ndarray]


def stacked(parts: list[Fields], types: dict) -> Fields:
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in types.items()}


def taken(f: Fields, rows: np.ndarray) -> Fields:
    return {k: v[rows] for k, v in f.items()}


def records(symbols: Symbols, docs: np.ndarray, parts: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int, k: int, hot: np.ndarray) -> Fields:
    """The records of some texts; those of anchors in ``hot`` window by window."""
    codes, of_doc, _, _ = symbols.read(data, offsets)
    n = len(codes) - width + 1
    if n <= 0:
        return stacked([], KEY)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(of_doc))
    sums, again = DEAL.sums(codes), CHECK.sums(codes)
    grams = DEAL.grams(sums, k)
    first, count, place = window_runs(grams, owner[:n] == owner[width - 1 :], width, k)
    anchor, state = grams[place], np.full(len(first), LEAD, np.int8)
    check = CHECK.spans(again, first, first + count + (width - 1))
    split = np.isin(anchor, hot)
    if split.any():
        each = np.repeat(first[split], count[split]) + of_each(count[split])
        first = np.concatenate([first[~split], each])
        count = np.concatenate([count[~split], np.ones(len(each), np.int64)])
        anchor = np.concatenate([anchor[~split], DEAL.spans(sums, each, each + width)])
        check = np.concatenate([check[~split], CHECK.spans(again, each, each + width)])
        state = np.concatenate([state[~split], np.full(len(each), LEAD | WINDOW, np.int8)])
    of = owner[first]
    return {"anchor": anchor, "check": check, "doc": docs[of], "part": parts[of], "start": first - of_doc[of], "count": count.astype(np.int32), "state": state}


def units(batches: Iterator[pa.RecordBatch], make: Callable) -> Iterator[Fields]:
    """The combined records that ``make(docs, parts, data, offsets)`` finds in about UNIT_BYTES of text at a time."""
    held, size = [], 0
    for batch in batches:
        for rows, data, offsets in sliced(batch, "text"):
            held.append(make(rows.column(0).to_numpy(), rows.column(1).to_numpy(), data, offsets))
            size += len(data)
            if size >= UNIT_BYTES:
                yield combined(stacked(held, KEY))
                held, size = [], 0
    if held:
        yield combined(stacked(held, KEY))


def by_content(f: Fields) -> tuple[Fields, np.ndarray]:
    """Records ordered by content, then place, without repeated places; and whether each begins another content."""
    order = np.lexsort((f["start"], f["part"], f["doc"], f["count"], f["check"], f["anchor"]))
    f = taken(f, order)
    new, fresh = np.ones(len(order), bool), np.ones(len(order), bool)
    new[1:] = (f["anchor"][1:] != f["anchor"][:-1]) | (f["check"][1:] != f["check"][:-1]) | (f["count"][1:] != f["count"][:-1])
    fresh[1:] = new[1:] | (f["doc"][1:] != f["doc"][:-1]) | (f["part"][1:] != f["part"][:-1]) | (f["start"][1:] != f["start"][:-1])
    if len(new):  # a place that is named twice may know of others only once
        f["state"] = f["state"] | (np.maximum.reduceat(f["state"] & TWICE, np.flatnonzero(new))[np.cumsum(new) - 1])
    return taken(f, fresh), new[fresh]


def combined(f: Fields) -> Fields:
    """Records of one unit: the first place of each content leads, others follow."""
    f, new = by_content(f)
    if len(new):
        more = np.bincount(np.cumsum(new) - 1) > 1
        f["state"] = (f["state"] & WINDOW) | np.where(new, LEAD, 0).astype(np.int8) | np.where(more[np.cumsum(new) - 1], TWICE, 0).astype(np.int8)
    return f


def hot_anchors(source: DataFrame, make: Callable, most: int) -> np.ndarray:
    """Anchors with more than ``most`` records of different content, but never more than 2**20 of them.

    A unit's only record of an anchor is not counted. Where very many anchors have more, the limit rises to a 2**20th of
    their records, so no more anchors than that can be over it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in units(batches, make):
            anchor, n = np.unique(f["anchor"][f["state"] & LEAD > 0], return_counts=True)
            yield pa.record_batch([pa.array(anchor[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64())], names=["anchor", "n"])

    counted = source.select("doc", "part", "text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    over = cut(counted.where(F.col("n") > most))
    limit = max(most, (over.agg(F.sum("n")).first()[0] or 0) >> 20)
    return np.sort(np.array([r["anchor"] for r in over.where(F.col("n") > limit).select("anchor").collect()], np.int64).view(np.uint64))


BLOB = "bucket long, records long, header binary, body binary"


def blob_batch(f: Fields, types: dict, bucket: np.ndarray, texts: list[bytes] | None = None) -> pa.RecordBatch:
    """Records as a compressed row for each bucket."""
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[by])) + 1
    press = zstandard.ZstdCompressor(level=5)
    out: list[list] = [[], [], [], []]
    for rows in np.split(by, cuts) if len(by) else []:
        out[0].append(int(bucket[rows[0]]))
        out[1].append(len(rows))
        out[2].append(press.compress(b"".join(np.ascontiguousarray(f[k][rows].astype(t)).tobytes() for k, t in types.items())))
        out[3].append(press.compress(b"".join([texts[i] for i in rows.tolist()])) if texts is not None else None)
    return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["bucket", "records", "header", "body"])


def read_headers(table: pa.Table, types: dict) -> Fields:
    press, parts = zstandard.ZstdDecompressor(), []
    for count, header in zip(table.column("records").to_pylist(), table.column("header"), strict=True):
        raw, at, f = press.decompress(header.as_py()), 0, {}
        for k, t in types.items():
            f[k] = np.frombuffer(raw, t, count, at)
            at += count * np.dtype(t).itemsize
        parts.append(f)
    return stacked(parts, types)


def read_texts(table: pa.Table) -> tuple[Fields, bytes]:
    """Records of the second round and their texts, one after the other; one of each place, as a repeated row sends all again."""
    press = zstandard.ZstdDecompressor()
    f, raw = read_headers(table, TEXT), b"".join([press.decompress(b.as_py()) for b in table.column("body")])
    order = np.lexsort((f["start"], f["part"], f["doc"], f["anchor"]))
    again = np.zeros(len(order), bool)
    again[1:] = np.logical_and.reduce([f[k][order[1:]] == f[k][order[:-1]] for k in ("anchor", "doc", "part", "start")])
    if again.any():
        stop = np.cumsum(f["size"], dtype=np.int64)
        rows = order[~again]
        raw = b"".join([raw[stop[i] - f["size"][i] : stop[i]] for i in rows.tolist()])
        f = taken(f, rows)
    return f, raw


def spans_table(doc: np.ndarray, part: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
    return pa.table([pa.array(doc, pa.int64()), pa.array(part, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["doc", "part", "first", "last"])


def meet(table: pa.Table, width: int, everywhere: bool) -> pa.Table:
    """Of one bucket's records: spans that are known to repeat (anchor null), and leaders whose text must be compared.

    everywhere: all places of a repeated content go; else all but the first.
    """
    f = read_headers(table, KEY)
    lead = f["state"] & LEAD > 0
    followers = taken(f, ~lead)
    f, new = by_content(taken(f, lead))
    if len(new):
        content = np.cumsum(new) - 1
        copied = (np.bincount(content) > 1) | (f["state"][new] & TWICE > 0)
        gone = copied[content] if everywhere else ~new
        # anchors with records of different content
        head = np.flatnonzero(new & (f["state"] & WINDOW == 0))
        a = f["anchor"][head]
        alone = np.ones(len(head), bool)
        alone[1:] &= a[1:] != a[:-1]
        alone[:-1] &= a[1:] != a[:-1]
        ask = head[~alone]
        asked, known = taken(f, ask), copied[content[ask]]
    else:
        gone, asked, known = np.zeros(0, bool), f, np.zeros(0, bool)
    gone = stacked([followers, taken(f, gone)], KEY)
    both = stacked([gone, asked], KEY)
    anchor = np.concatenate([np.zeros(len(gone["doc"]), np.uint64), asked["anchor"]]).view(np.int64)
    said = spans_table(both["doc"], both["part"], both["start"], both["start"] + both["count"] + (width - 1))
    said = said.append_column("anchor", pa.array(anchor, pa.int64(), mask=np.arange(len(anchor)) < len(gone["doc"])))
    return said.append_column("known", pa.array(np.concatenate([np.zeros(len(gone["doc"]), bool), known])))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths of a list column's rows (null: none), and all elements."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), pc.list_flatten(column)


def repeats_removed(source: DataFrame, plan: Plan, symbols: Symbols, width: int, k: int, everywhere: bool, decide: Callable[[pa.Table], pa.Table], apply: Callable, schema: str, most: int | None = None) -> DataFrame:
    """Every row of ``source`` (see ``document_key``) with its repeated windows taken out by ``apply``.

    decide(table of texts of one bucket) gives the spans that go, of those texts; apply(data, offsets, of, first, last) makes
    the columns of ``schema`` from texts and their spans, which don't overlap. doc_id and kept columns stand around them.
    """
    cold = np.zeros(0, np.uint64)
    hot = hot_anchors(source, lambda docs, parts, data, offsets: records(symbols, docs, parts, data, offsets, width, k, cold), MOST_RECORDS if most is None else most)
    held = source.sparkSession.sparkContext.broadcast(hot)
    buckets = plan.buckets

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in units(batches, lambda docs, parts, data, offsets: records(symbols, docs, parts, data, offsets, width, k, held.value)):
            # a follower needs no meeting with others, so it goes where its document's number says
            by = np.where(f["state"] & LEAD > 0, f["anchor"] % np.uint64(buckets), f["doc"].view(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(buckets))
            yield blob_batch(f, KEY, by.astype(np.int64))

    first = source.select("doc", "part", "text").mapInArrow(keys, BLOB).select("bucket", "records", "header").repartition(plan.tasks, "bucket")
    met = first.groupBy("bucket").applyInArrow(lambda table: meet(table, width, everywhere), MET)
    span, ask = F.struct("first", "last"), F.struct("first", "last", "anchor", "known")
    listed = F.collect_list(F.when(F.col("anchor").isNull(), span)).alias("spans"), F.collect_list(F.when(F.col("anchor").isNotNull(), ask)).alias("asks")
    per_doc = met.repartition(plan.tasks, "doc", "part").groupBy("doc", "part").agg(*listed)
    # one row per document with what the first round says of it; read twice, from one shuffle of the texts
    whole = source.repartition(plan.tasks, "doc", "part").join(per_doc.hint("shuffle_hash"), ["doc", "part"], "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("doc", "part", "asks")}
            batch = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column(at["asks"])), 0), 0))
            for rows, data, offsets in sliced(batch, "text"):
                n, asks = _lists(rows.column(at["asks"]))
                of = np.repeat(np.arange(len(n)), n)
                lo, hi = (asks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                _, of_doc, starts, ends = symbols.read(data, offsets)
                a, b = lo + of_doc[of], hi + of_doc[of]
                if starts is not None:
                    a, b = starts[a], ends[b - 1]
                docs, parts = (rows.column(at[x]).to_numpy()[of] for x in ("doc", "part"))
                raw = data.tobytes()
                f = {"anchor": asks.field(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), "doc": docs, "part": parts, "start": lo, "count": hi - lo - (width - 1), "size": b - a, "known": asks.field(3).to_numpy(zero_copy_only=False)}
                held.append((f, [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
                size += int((b - a).sum())
                if size >= UNIT_BYTES // 4:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        f = stacked([h[0] for h in held], TEXT)
        return blob_batch(f, TEXT, (f["anchor"] % np.uint64(plan.second.buckets)).astype(np.int64), [t for h in held for t in h[1]])

    second = whole.mapInArrow(texts, BLOB).repartition(plan.second.tasks, "bucket").groupBy("bucket").applyInArrow(decide, SPANS)
    decided = second.repartition(plan.tasks, "doc", "part").groupBy("doc", "part").agg(F.collect_list(span).alias("more"))
    kept = [f for f in source.schema if f.name.startswith("kept_")]
    joined = whole.join(decided.hint("shuffle_hash"), ["doc", "part"], "left").select("doc_id", "text", "spans", "more", *(f.name for f in kept))
    schema = ", ".join(["doc_id long", schema, *(f"{f.name} {f.dataType.simpleString()}" for f in kept)])
    names = [x.split()[0] for x in schema.split(", ")[: len(schema.split(", ")) - len(kept)]] + [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                sides = [_lists(rows.column(i)) for i in (2, 3)]
                of = np.concatenate([np.repeat(np.arange(len(n)), n) for n, _ in sides])
                lo, hi = (np.concatenate([x.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for _, x in sides]) for i in (0, 1))
                yield pa.record_batch([rows.column(0), *apply(data, offsets, *joined_spans(of, lo, hi)), *rows.columns[4:]], names=names)

    return joined.mapInArrow(run, schema)


def joined_spans(of: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order, those of one text that touch or overlap as one."""
    if not len(of):
        return of, first, last
    order = np.lexsort((first, of))
    of, first, last = of[order], first[order], last[order]
    shift = of * (1 << 40)
    reach = np.maximum.accumulate(last + shift)
    new = np.ones(len(of), bool)
    new[1:] = first[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return of[at], first[at], (reach - shift)[np.append(at[1:], len(of)) - 1]


def windows_table(docs: list, parts: list, starts: list, width: int) -> pa.Table:
    """Windows that go, as spans; those of one document that touch as one."""
    if not docs:
        return spans_table(*(np.zeros(0, np.int64),) * 4)
    doc, part, start = np.concatenate(docs), np.concatenate(parts), np.concatenate(starts)
    order = np.lexsort((start, part, doc))
    doc, part, start = doc[order], part[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] > start[:-1] + width)
    at = np.flatnonzero(new)
    return spans_table(doc[at], part[at], start[at], start[np.append(at[1:], len(doc)) - 1] + width)
