"""Source divergence audit: how far the term shares of each source of a language lie from those of the others.

The distance of two sources is a sum over all kept terms of a language, most of which neither of the two holds. It is
priced by inclusion and exclusion over their supports: first as if no term were shared, each side's terms against the share that
the other gives to a term it lacks, which needs only the side's histogram of counts; then what is wrong about shared terms is put
right by joining postings; terms that both lack have a constant. So work follows terms present, not sources times terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girderlake.llm.arrays import LOWER, sliced
from girderlake.llm.store import cut

#: Shares are whole numbers of so many parts; each count is raised by PRIOR. Fixed values.
PARTS, PRIOR = 1_000_000_000, 5
#: Terms with counts that a task holds before it hands them on.
HELD = 1 << 18
#: Bytes of one text that are split into terms at once.
CHUNK = 1 << 20

#: Bytes of terms stay, A-Z as a-z; all others (ASCII but letters) become spaces.
_TERM_BYTES = bytes(LOWER[b] if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, some at a time."""
    at, flat = 0, text.translate(_TERM_BYTES)
    while at < len(flat):
        stop = flat.find(b" ", at + CHUNK)
        stop = len(flat) if stop < 0 else stop
        yield flat[at:stop].split()
        at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from columns lang, source and text without nulls: parts of counts, several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                raw, bounds = data.tobytes(), offsets.tolist()
                for i, key in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                    n, having = held.setdefault(key, (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for terms in _terms(raw[bounds[i] : bounds[i + 1]]):
                        n.update(terms)
                        seen.update(terms)
                    having.update(seen)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from handed_on(held)
                    held = {}
        yield from handed_on(held)

    def handed_on(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, having) in held.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms, pa.array(list(n.values()), pa.int64()), pa.array([having[t] for t in n], pa.int64())]
                yield pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(PARTS * (count + PRIOR) / (total + PRIOR * terms)), in whole numbers."""
    return F.expr(f"1 + (CAST({PARTS} AS DECIMAL(19,0)) * CAST({count} + {PRIOR} AS DECIMAL(19,0))) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(19,0))")


def audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs, nulls read as ''.

    Kept terms of a lang are in ``min_docs`` of its rows at least; each row is a document, repeated rows too. Part ``pair``:
    every other source of the lang and the distance, 0 if no term is kept; part ``term``: the source's terms whose share is
    above the lang's, by the difference, up to rank ``top_terms``. Ties of values rank by the item's UTF-8 bytes.
    A source alone in its lang has no pairs, one without kept terms no terms; an empty table gives no rows.
    Other columns play no part. Exact: shares are whole numbers, and sums of a source's shares stay near PARTS.

    Work: a row per source and kept term, joined with itself by term for sources that share it; the result has a row for
    every two sources of a lang. No task holds more than the sources of one term, or the distinct counts of one source.
    """
    own = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    key = ["lang", "source"]
    by_term = Window.partitionBy("lang", "term")
    counted = term_counts(own).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = counted.select(*key, "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), (F.col("source") == F.min("source").over(by_term)).alias("leads"))
    postings = cut(spread.where(F.col("lang_docs") >= min_docs).drop("lang_docs"))

    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("terms"))
    sums = postings.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = own.select(key).distinct().join(sums, key, "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "lang_total", "terms"])
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(F.lit(0)))
    priced = postings.join(groups, key).withColumn("p", _share("n", "total", "terms"))
    whole = priced.groupBy(key).agg(F.sum("p").alias("mass"))
    groups = cut(groups.join(whole, key, "left").na.fill(0, ["mass"]))
    priced = postings.join(groups, key).withColumn("p", _share("n", "total", "terms"))

    pairs = _pairs(groups, priced)
    best = Window.partitionBy(key).orderBy(F.desc("value"), "item")
    over = priced.withColumn("value", F.col("p") - _share("lang_n", "lang_total", "terms")).where("value > 0")
    terms = over.select(*key, F.lit("term").alias("part"), F.col("term").alias("item"), "value", F.row_number().over(best.orderBy(F.desc("value"), "term")).alias("rank")).where(F.col("rank") <= top_terms)
    return pairs.select(*key, F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank")).union(terms)


def _pairs(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a lang, in both directions."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("support").alias("other_support"))
    met = groups.join(other, "lang").where(F.col("source") != F.col("other"))
    # terms of a side alone: the sum of |p - z| over its histogram, for every z, from running sums in order of p
    points = priced.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("k")).select("lang", "source", F.col("p").alias("at"), "k", *(F.lit(None).cast(t).alias(c) for c, t in (("other", "string"), ("fixed", "long"))))
    neither = F.when(F.col("source") < F.col("other"), (F.col("terms") - F.col("support") - F.col("other_support")) * F.abs(F.col("zero") - F.col("other_zero"))).otherwise(0)
    probes = met.select("lang", "source", F.col("other_zero").alias("at"), F.lit(0).cast("long").alias("k"), "other", (F.col("mass") - F.col("support") * F.col("other_zero") + neither).alias("fixed"))
    below = Window.partitionBy("lang", "source").orderBy("at")
    summed = points.union(probes).withColumn("under", F.sum("k").over(below) * F.col("at") - F.sum(F.col("k") * F.col("at")).over(below))
    alone = summed.where("other IS NOT NULL").select("lang", F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high"), (F.col("fixed") + 2 * F.col("under")).alias("value"))
    # terms of both: what they cost together, less what was charged for each alone, and the constant taken once too often
    side = lambda name: priced.select("lang", "term", *(F.col(c).alias(f"{name}_{c}") for c in ("source", "p", "zero")))
    a, b = side("a"), side("b")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("a_source < b_source")
    mended = gap("a_p", "b_p") - gap("a_p", "b_zero") - gap("b_p", "a_zero") + gap("a_zero", "b_zero")
    shared = both.groupBy("lang", F.col("a_source").alias("low"), F.col("b_source").alias("high")).agg(F.sum(mended).alias("value"))
    total = alone.union(shared).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return total.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")
