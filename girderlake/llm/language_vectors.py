"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters,
each permuted by its place; a text's vector bundles (adds) those of all its n-grams, and a language's those of its
training texts. A text's language is the prototype of greatest cosine. Nothing is stored but letter vectors, which
follow from a seed, and one vector for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderlake.llm.arrays import sliced
from girderlake.llm.byte_bpe import LETTER, codepoint_classes

DIMENSIONS, GRAM = 512, 3
#: Letters below this codepoint have vectors of their own, others share as many again by remainder.
OWN_LETTERS = 2048
UNKNOWN = "und"


def letter_vectors(seed: int = 8) -> np.ndarray:
    """Row 0 stands for whatever isn't a letter."""
    return (2 * np.random.default_rng(seed).integers(0, 2, (2 * OWN_LETTERS + 1, DIMENSIONS), np.int8) - 1).astype(np.int8)


def _lower() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


class _Tables:
    lower: np.ndarray | None = None
    vectors: np.ndarray | None = None
    symbol: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.symbol is None:
            low = _lower()
            number = np.where(low < OWN_LETTERS, low, OWN_LETTERS + low % OWN_LETTERS) + 1
            cls.symbol = np.where(codepoint_classes() == LETTER, number, 0).astype(np.int64)
            cls.vectors = letter_vectors()
        return cls.symbol, cls.vectors


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-gram codes and counts of texts, n + 1 offsets of texts into them, and whether each text has letters.

    Runs of other characters count as one boundary; each text stands between two.
    """
    symbol, _ = _Tables.get()
    base = 2 * OWN_LETTERS + 1
    n = len(offsets) - 1
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    size = np.diff(starts)
    doc = np.repeat(np.arange(n), size + 2)
    s = np.zeros(len(doc), np.int64)
    s[np.arange(len(code)) + 2 * np.repeat(np.arange(n), size) + 1] = symbol[code]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (doc[1:] != doc[:-1])
    s, doc = s[keep], doc[keep]
    letters = np.bincount(doc[s > 0], minlength=n) > 0
    m = max(0, len(s) - GRAM + 1)
    inside = (doc[:m] == doc[GRAM - 1 :]) & letters[doc[:m]] if m else np.zeros(0, bool)
    gram = s[:m].copy()
    for i in range(1, GRAM):
        gram = gram * base + s[i : m + i]
    gram, doc = gram[inside], doc[:m][inside]
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return gram[at], np.diff(np.append(at, len(gram))), np.searchsorted(doc[at], np.arange(n + 1)), letters


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes: the i-th letter from the end rotated by i places, all multiplied."""
    _, vectors = _Tables.get()
    base = 2 * OWN_LETTERS + 1
    out = np.ones((len(grams), DIMENSIONS), np.int8)
    for i in range(GRAM):
        out *= np.roll(vectors, i, axis=1)[grams % base]
        grams = grams // base
    return out


def bundles(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(text, its vector) for texts with letters."""
    grams, counts, at, letters = gram_counts(data, offsets)
    known, which = np.unique(grams, return_inverse=True)
    vectors = gram_vectors(known)
    counts = counts.astype(np.float32)
    for i in np.flatnonzero(letters).tolist():
        a, b = at[i], at[i + 1]
        yield i, counts[a:b] @ vectors[which[a:b]].astype(np.float32)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None) -> dict[str, np.ndarray]:
    """Prototypes by language, from texts with letters and non-null lang outside ``held_out``.

    Each training task sums the n-gram counts of its texts by language and binds them once; sums of vectors meet
    by language and dimension. Languages are few by nature, and only their vectors reach the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull()) if held_out is None else docs.where(F.col(lang_col).isNotNull() & ~held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in sliced(batch, "text"):
                langs = part.column(1).to_pylist()
                grams, counts, at, _ = gram_counts(data, offsets)
                names = sorted(set(langs))
                number = {x: i for i, x in enumerate(names)}
                lang = np.repeat([number[x] for x in langs], np.diff(at))
                known, which = np.unique(grams, return_inverse=True)
                if not len(known):
                    continue
                vectors = gram_vectors(known).astype(np.float32)
                for name, i in number.items():
                    own = np.bincount(which[lang == i], weights=counts[lang == i], minlength=len(known))
                    sums[name] = sums.get(name, np.zeros(DIMENSIONS)) + own.astype(np.float32) @ vectors
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(run, "lang string, vector array<double>")
    # sums of whole numbers are exact in any order
    total = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    by_lang = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).select("lang", "v.x").collect()
    return {r["lang"]: np.array(r["x"]) for r in by_lang if any(r["x"])}


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has letters; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in sliced(batch, text_col):
                yield part.filter(pa.array(gram_counts(data, offsets)[3]))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 at least) of every row; ``und`` and 0 for texts without letters (or no prototypes).

    A null text has no letters. Ties go to the language that sorts first. Rows that repeat, or have no id, are
    answered by themselves. keep: input columns to hand on.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in names], np.float32).T if names else np.zeros((DIMENSIONS, 0), np.float32)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *(docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)))
    extra = "".join(f", kept_{i} {source.schema[f'kept_{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in sliced(batch, "text"):
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                for i, vector in bundles(data, offsets) if names else ():
                    cosine = vector @ matrix
                    best = int(cosine.argmax())
                    lang[i], score[i] = names[best], min(1.0, max(0.0, float(cosine[best] / max(np.linalg.norm(vector), 1e-9))))
                yield pa.record_batch([part.column(0), pa.array(lang), pa.array(score), *part.columns[2:]], names=["doc_id", "lang_pred", "score", *part.schema.names[2:]])

    out = source.mapInArrow(run, "doc_id long, lang_pred string, score double" + extra)
    return out.withColumnsRenamed({f"kept_{i}": c for i, c in enumerate(keep)})
