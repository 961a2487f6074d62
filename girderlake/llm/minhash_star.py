"""Near copies by one-permutation MinHash: densified bins, banded buckets, star-shaped candidates, full check.

One hash of each shingle fills all bins; an empty bin borrows from bins drawn by a hash of its own number. Texts
with the same shingle set are one class from the start. In a bucket every class is paired with one hub only: the class
whose bands are the most crowded, which in a cloud of edited copies is the text that they stem from. What these stars miss
(members that belong with each other, not with the hub) is found among the members of one hub, in blocks of bounded
size: those outside the main component of its members are held against all of them, and a block hands on the links of
a spanning forest, never its pairs. Every link is checked on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from girderlake.llm.anchors import NO_ID, document_key
from girderlake.llm.arrays import LOWER, WORDS, mix, of_each, sliced, word_hashes, words
from girderlake.llm.components import connected_components
from girderlake.llm.store import cut

BINS, ROWS = 128, 4
#: Members that a hub's text is sent out for at once.
STAR = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and n + 1 offsets of texts into them. Fewer than k words: one shingle."""
    data = LOWER[data]
    starts, ends, of_doc = words(data, offsets)
    codes = word_hashes(data, starts, ends)
    n = np.diff(of_doc)
    sums = WORDS.sums(codes)
    shingles = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    first = of_doc[doc] + of_each(shingles)
    last = np.minimum(first + k, of_doc[doc + 1])
    hashes = WORDS.spans(sums, first, last)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def _draws(tries: int) -> np.ndarray:
    """For each try, the bin that each bin looks at."""
    x = np.arange(tries * BINS, dtype=np.uint64).reshape(tries, BINS)
    return (mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)) >> np.uint64(57)).astype(np.int64)


_DRAWS = _draws(1024)


def bin_minima(hashes: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
    """Densified minima, a row of BINS for each text with shingles (others: empty marks)."""
    n = len(of_doc) - 1
    out = np.full((n, BINS), _EMPTY, np.uint64)
    if not len(hashes):
        return out
    spread = mix(hashes + np.uint64(0x51ED270B))
    cell = np.repeat(np.arange(n), np.diff(of_doc)) * BINS + (spread >> np.uint64(57)).astype(np.int64)
    order = np.lexsort((spread, cell))
    cell = cell[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out.ravel()[cell[first]] = spread[order][first]
    filled = out.copy()
    row, col = np.nonzero((out == _EMPTY) & (np.diff(of_doc) > 0)[:, None])
    for look in _DRAWS:
        if not len(row):
            break
        value = out[row, look[col]]
        ok = value != _EMPTY
        filled[row[ok], col[ok]] = value[ok]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row.tolist(), col.tolist()):  # after 1024 empty draws, which a set of one meets once in 3000 bins
        have = np.flatnonzero(out[r] != _EMPTY)
        filled[r, c] = out[r, have[np.argmin((have - c) % BINS)]]
    return filled


def _sketches(source: DataFrame, k: int) -> DataFrame:
    """doc, part, n_shingles, two hashes of the set, a hash for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                hashes, of_doc = shingle_sets(data, offsets, k)
                n = np.diff(of_doc)
                totals = [np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(s)))) for s in (11, 12)]
                a, b = ((t[of_doc[1:]] - t[of_doc[:-1]]).view(np.int64) for t in totals)
                bins = bin_minima(hashes, of_doc)
                bands = np.zeros((len(n), BINS // ROWS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * np.uint64(31) + bins[:, r::ROWS])
                bands = mix(bands + np.arange(BINS // ROWS, dtype=np.uint64)).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                yield pa.record_batch([*rows.columns[:2], pa.array(n), pa.array(a), pa.array(b), listed], names=["doc", "part", "n_shingles", "set_a", "set_b", "bands"])

    return source.select("doc", "part", "text").mapInArrow(run, "doc long, part long, n_shingles long, set_a long, set_b long, bands array<long>")


def _alike(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (hub, member), those whose full sets have percent / 100 of their union in common.

    Members of a hub are dealt to as many tasks as they fill STAR times. Hubs of one task need no salt, so only the others'
    numbers are joined, from a stored table, so that a hub with very many members can be split in that join too.
    """
    pairs = cut(pairs)
    sizes = cut(pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts")))
    dealt = pairs.join(sizes.where("salts > 1"), "hub", "left").select("hub", F.expr("pmod(xxhash64(member), coalesce(salts, 1))").cast("int").alias("salt"), "member", F.lit(False).alias("is_hub"))
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("member"), F.lit(True).alias("is_hub"))
    held = dealt.union(hubs).join(texts.select(F.col("node").alias("member"), "text"), "member")
    held = held.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.desc("is_hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                hashes, of_doc = shingle_sets(data, offsets, k)
                hubs, members, leads = rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
                found: tuple[list[int], list[int]] = ([], [])
                for i in range(rows.num_rows):
                    mine = hashes[of_doc[i] : of_doc[i + 1]]
                    if leads[i]:
                        hub, own = hubs[i], mine
                        continue
                    assert hub == hubs[i]
                    if not len(mine) or not len(own):
                        continue
                    at = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                    common = int((own[at] == mine).sum())
                    if 100 * common >= percent * (len(own) + len(mine) - common):
                        found[0].append(hub)
                        found[1].append(members[i])
                own = own.copy()  # not a view of a whole slice
                yield pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return held.select("hub", "salt", "member", "is_hub", "text").mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near copies: doc_id, n_shingles, component_id, kept; one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set is its distinct ``shingle``-word
    shingles (with fewer words, all of them as one). Two documents are linked if 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable. A null, empty or wordless text has an empty set and is
    linked with nothing. Rows of one doc_id and one text are one document; rows of one doc_id and different texts are different
    ones, linked only if alike. Documents without id are told apart by text and come after all others; a group of such
    alone has a null component_id, and one of its texts is kept.
    """
    out = _grouped(document_key(docs, id_col, text_col), shingle, percent)
    own = (F.col("doc") == F.col("lead.doc")) & ((F.col("doc") < NO_ID) | (F.col("part") == F.col("lead.part")))
    return out.select(_named("doc").alias("doc_id"), "n_shingles", _named("lead.doc").alias("component_id"), own.alias("kept"))


def _named(column: str) -> Column:
    return F.when(F.col(column) < NO_ID, F.col(column))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group (see ``near_copies``) the document of the smallest id.

    Rows that repeat doc_id and text are one document, of which one row stays; documents without words all stay. Columns
    may have any names.
    """
    source = document_key(docs, id_col, text_col)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(docs[text_col]).alias("part"))
    stays = _grouped(source, shingle, percent).where("doc = lead.doc AND part = lead.part").select("doc", "part").distinct()
    one = F.row_number().over(Window.partitionBy("doc", "part").orderBy(F.lit(0)))
    return rows.join(stays, ["doc", "part"], "left_semi").withColumn("place", one).where("place = 1").select("row.*")


def _grouped(source: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc, part, n_shingles and the least (doc, part) of its group, for every row of ``source``.

    Texts of one set are a class, a node of the graph. Small sides of joins on keys that may be hot (band, hub, node) are
    repartitioned or stored first, so that Spark can split the other side.
    """
    base = cut(_sketches(source, shingle))
    some = base.where("n_shingles > 0")
    classes = some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc", "part")).alias("who"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    member = classes.select("node", "n", F.explode("bands").alias("band"))
    sizes = member.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowd = cut(member.join(sizes.repartition("band"), "band"))
    hubs = crowd.join(crowd.groupBy("node").agg(F.sum("size").alias("crowding")), "node")
    hubs = hubs.groupBy("band").agg(F.max(F.struct("crowding", (-F.col("node")).alias("least"), "n")).alias("hub"))
    stars = crowd.join(hubs.repartition("band"), "band").select((-F.col("hub.least")).alias("hub"), F.col("hub.n").alias("other"), F.col("node").alias("member"), "n")
    stars = cut(stars.distinct())
    wanted = classes.join(crowd.select("node").distinct(), "node", "left_semi").select("who.doc", "who.part", "node")
    texts = cut(source.select("doc", "part", "text").join(wanted, ["doc", "part"]).groupBy("doc", "part", "node").agg(F.first("text").alias("text")).select("node", "text"))
    near = f"hub != member AND 100 * least(n, other) >= {percent} * greatest(n, other)"
    edges = cut(_alike(stars.where(near).select("hub", "member"), texts, shingle, percent))
    found = cut(connected_components(edges))

    among = cut(stars.join(found.withColumnRenamed("node", "member"), "member", "left").select("hub", "member", "n", F.coalesce("component", "member").alias("component")))
    parts = among.groupBy("hub", "component").agg(F.count("*").alias("size"), F.sum(F.greatest("n", F.lit(LEAST_WEIGHT))).alias("weight"))
    main = F.max(F.struct("size", "component", "weight"))
    mixed = parts.groupBy("hub").agg(main.alias("main"), F.sum("weight").alias("weight"), F.count("*").alias("parts")).where("parts > 1")
    slices = lambda x: F.greatest(F.ceil(x / BLOCK), F.lit(1)).cast("int")
    mixed = cut(mixed.select("hub", F.col("main.component").alias("main"), slices(F.col("weight") - F.col("main.weight")).alias("rows"), slices(F.col("weight")).alias("columns")))
    if not mixed.isEmpty():
        open_ = among.join(mixed, "hub")
        place = lambda n: F.pmod(F.xxhash64("member"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outside = open_.where("component != main").select("hub", "member", "component", F.lit(True).alias("outside"), place("rows").alias("row"), every("columns").alias("column"))
        others = open_.select("hub", "member", "component", F.lit(False).alias("outside"), every("rows").alias("row"), place("columns").alias("column"))
        edges = edges.union(cut(_alike_within(outside.union(others), texts, shingle, percent)))
        found = cut(connected_components(edges))
    groups = classes.join(found, "node", "left").select("set_a", "set_b", "who", F.coalesce("component", "node").alias("component"))
    leads = groups.groupBy("component").agg(F.min("who").alias("lead"))
    groups = groups.join(leads.repartition("component"), "component").select("set_a", "set_b", "lead")
    out = base.drop("bands").join(groups.repartition("set_a", "set_b"), ["set_a", "set_b"], "left")
    return out.select("doc", "part", "n_shingles", F.coalesce("lead", F.struct("doc", "part")).alias("lead"))


def common_counts(sets: np.ndarray, of_set: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Shingles that each of the sets ``rows`` has in common with each of the sets ``columns``.

    Shingles that many have are columns of matrices to multiply; for the others every (row, column) that meets is counted.
    """
    out = np.zeros((len(rows), len(columns)), np.float32)
    side = []
    for chosen in (rows, columns):
        size = np.diff(of_set)[chosen]
        at = np.repeat(of_set[chosen], size) + of_each(size)
        order = np.argsort(sets[at], kind="stable")
        side.append((sets[at][order], np.repeat(np.arange(len(chosen)), size)[order]))
    (a, i), (b, j) = side
    known = np.intersect1d(a, b)
    a0, a1, b0, b1 = (np.searchsorted(x, known, how) for x in (a, b) for how in ("left", "right"))
    na, nb = a1 - a0, b1 - b0
    often = na * nb > 0.02 * len(rows) * len(columns)
    for some in np.array_split(np.flatnonzero(often), -(-int(often.sum()) // 512) or 1):
        x, y = np.zeros((len(rows), len(some)), np.float32), np.zeros((len(columns), len(some)), np.float32)
        for m, who, start, count in ((x, i, a0[some], na[some]), (y, j, b0[some], nb[some])):
            m[who[np.repeat(start, count) + of_each(count)], np.repeat(np.arange(len(some)), count)] = 1
        out += x @ y.T
    rare = np.flatnonzero(~often)
    pairs = np.cumsum(na[rare] * nb[rare])
    for some in np.split(rare, np.searchsorted(pairs, np.arange(PAIRS, pairs[-1] if len(pairs) else 0, PAIRS))):
        each = na[some] * nb[some]
        k, which = of_each(each), np.repeat(np.arange(len(some)), each)
        row, column = i[a0[some][which] + k // nb[some][which]], j[b0[some][which] + k % nb[some][which]]
        out += np.bincount(row * len(columns) + column, minlength=out.size).reshape(out.shape)
    return out


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a block that connect the same keys as all its links do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = y
        return x

    out: tuple[list[int], list[int]] = ([], [])
    for r, c in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = int(rows[r]), int(columns[c])
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            out[0].append(a)
            out[1].append(b)
    return out


def _alike_within(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the outside members of each block and its others, as spanning forests."""
    held = blocks.join(texts.withColumnRenamed("node", "member"), "member").select("hub", "row", "column", "member", "component", "outside", "text")

    def run(table: pa.Table) -> pa.Table:
        keys, component, outside = (table.column(x).to_numpy() for x in ("member", "component", "outside"))
        sets, counts = [], []
        for batch in table.combine_chunks().to_batches():
            for _, data, offsets in sliced(batch, "text"):
                hashes, of_doc = shingle_sets(data, offsets, k)
                sets.append(hashes)
                counts.append(np.diff(of_doc))
        of_set = np.append(0, np.cumsum(np.concatenate(counts)))
        rows, columns = np.flatnonzero(outside), np.flatnonzero(~outside)
        found: tuple[list[int], list[int]] = ([], [])
        if len(rows) and len(columns):
            n = np.diff(of_set)
            common = common_counts(np.concatenate(sets), of_set, rows, columns).astype(np.int64)
            linked = 100 * common >= percent * (n[rows][:, None] + n[columns][None] - common)
            found = forest(linked & (component[rows][:, None] != component[columns][None]), keys[rows], keys[columns])
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return held.groupBy("hub", "row", "column").applyInArrow(run, "a long, b long")


#: Shingles of one side of a block, about; of a single set that has more, all.
BLOCK = 1 << 18
#: Shingles that a set counts for at least there, so that a block has some 2,000 rows and columns at most.
LEAST_WEIGHT = 128
#: Meetings of rare shingles that are counted at once.
PAIRS = 1 << 20
