"""Merkle manifest of a dataset: a tree of hashes for each source, one over the sources, and a proof for every row.

Hashes of rows (leaves) are sorted once, as runs over ranges of (source, id), and get their coordinates from counts of runs. The node store is a
folder of Parquet with a part for each level; a level is made by reading the one below it, ``FAN`` consecutive nodes a parent. Proofs
come from the top: a node's path is its siblings and its parent's path, so each level of the store is
met once with the paths of its nodes, by coordinate, and only the last meeting is as large as the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderlake.llm.store import cut, shared_folder, until_exit

#: Nodes of one parent.
FAN = 3
#: Bits of a number of ``monotonically_increasing_id`` that count rows of one run.
RUN_BITS = 33
PATH = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its bytes' number, a colon and itself."""
    return F.sha2(F.concat(*(_field(c) for c in (doc_id, source, lang, n_chars, text))), 256)


class Store:
    """Parquet in a folder that driver and executors share; it goes when the driver ends."""

    def __init__(self, spark):
        self.spark = spark
        self.folder = until_exit(spark, f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}")

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")


def _in_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows sorted by keys (nulls first) over ranges, with ``m``: run and place in it."""
    order = [F.asc_nulls_first(k) for k in keys]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())


def _shifts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, run, size, shift) of sorted rows: m + shift counts the rows of one ``by`` from 0 through its runs."""
    parts = rows.groupBy(*by, F.shiftright("m", RUN_BITS).alias("run")).agg(F.min("m").alias("low"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(*by, "run", "rows", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))


def _levels(store: Store, name: str, leaves: DataFrame) -> list[DataFrame]:
    """Levels of nodes (tree, pos, n, hash, children), level 0 first; n: the tree's leaves. A tree of n leaves ends where one node is left."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, reach = [leaves], 1
    while reach < most:
        below = levels[-1].where(F.col("n") > reach)
        child = F.struct(F.col("pos"), F.col("hash"), F.col("payload")) if len(levels) == 1 else F.struct("pos", "hash")
        nodes = below.groupBy("tree", F.expr(f"pos div {FAN}").alias("pos"), "n").agg(F.sort_array(F.collect_list(child)).alias("children"))
        levels.append(store.put(f"{name}/level={len(levels)}", nodes.withColumn("hash", F.sha2(F.array_join("children.hash", ""), 256))))
        reach *= FAN
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, hash) of the last node of every tree."""
    out = None
    for k, nodes in enumerate(levels):
        top = nodes.where(_ends_at(k)).select("tree", "hash")
        out = top if out is None else out.union(top)
    return out


def _ends_at(k: int) -> Column:
    return (F.col("n") <= FAN**k) & (F.col("n") > (FAN ** (k - 1) if k else 0))


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, payload, hash, path, ...) of every leaf: its siblings, then those of each node above it.

    tops: (tree, path, ...) what stands above each tree's last node, with columns to hand down.
    """
    handed = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(levels) - 1, 0, -1):
        ending = levels[k].where(_ends_at(k)).select("tree", "pos").join(tops, "tree")
        above = ending if above is None else above.unionByName(ending)
        met = levels[k].select("tree", "pos", "children").join(above, ["tree", "pos"])
        siblings = F.struct(
            F.array_join(F.expr("slice(children.hash, 1, i)"), "").alias("before"),
            F.array_join(F.expr(f"slice(children.hash, i + 2, {FAN})"), "").alias("after"),
        )
        spread = met.select("tree", "children", "path", *handed, F.posexplode("children").alias("i", "child"))
        own = ["child.payload", "child.hash"] if k == 1 else []
        above = spread.select("tree", F.col("child.pos").alias("pos"), *own, F.concat(F.array(siblings), "path").alias("path"), *handed)
    alone = levels[0].where(_ends_at(0)).select("tree", "pos", "payload", "hash").join(tops, "tree")
    return alone if above is None else above.unionByName(alone)


def manifest(docs: DataFrame, tampered_text: Column | None = None, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", n_chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, path, tampered_leaf.

    Leaves of a source ascend by id, null first, rows of one id by their hash; sources ascend by their bytes, null first
    and a source of its own. path: of each level, the siblings before and after the node on the way, as joined hex. tampered_leaf: the hash with
    ``tampered_text`` for the text, null where that is null or not given. Rows that repeat are leaves of their own;
    null fields and empty texts have hashes that differ; other columns play no part; an empty table gives no rows.
    """
    store = Store(docs.sparkSession)
    fields = [docs[id_col].cast("long"), docs[source_col].cast("string"), docs[lang_col].cast("string"), docs[n_chars_col].cast("long")]
    tampered = F.lit(None).cast("string") if tampered_text is None else F.when(tampered_text.isNotNull(), leaf_hash(*fields, tampered_text))
    hashed = cut(docs.select(fields[1].alias("source"), fields[0].alias("doc_id"), leaf_hash(*fields, docs[text_col].cast("string")).alias("hash"), tampered.alias("tampered")))
    rows = store.put("rows", _in_runs(hashed, "source", "doc_id", "hash"))

    shifts = _shifts(rows, ["source"])
    sources = store.put("sources", _in_runs(shifts.groupBy("source").agg(F.sum("rows").alias("n")), "source"))
    run = F.shiftright("m", RUN_BITS)
    numbers = _shifts(sources.withColumn("all", F.lit(0)), ["all"]).select(F.col("run").alias("source_run"), "shift")
    trees = sources.join(numbers, run == F.col("source_run")).select(F.col("source").alias("of"), (F.col("m") + F.col("shift")).alias("tree"), "n")
    placed = shifts.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("of", F.col("run").alias("of_run"), "tree", "n", "shift")
    # by source and run, so that a source of very many rows is many keys
    leaves = rows.join(placed, F.col("source").eqNullSafe(F.col("of")) & (run == F.col("of_run")))
    leaves = store.put("trees/level=0", leaves.select("tree", (F.col("m") + F.col("shift")).alias("pos"), "n", "hash", F.struct("doc_id", "tampered").alias("payload")))

    levels = _levels(store, "trees", leaves)
    count = trees.count()
    subroots = _tops(levels).select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "hash", F.struct(F.col("tree").alias("below")).alias("payload"))
    upper = _levels(store, "sources_tree", store.put("sources_tree/level=0", subroots))
    root = (_tops(upper).first() or {"hash": None})["hash"]
    over = _paths(upper, docs.sparkSession.range(1).select(F.lit(0).alias("tree"), F.array().cast(PATH).alias("path")))
    tops = over.select(F.col("payload.below").alias("tree"), "path", F.col("hash").alias("subroot"))
    found = _paths(levels, store.put("tops", tops))
    return found.select("payload.doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", F.col("payload.tampered").alias("tampered_leaf"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, joined."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")
