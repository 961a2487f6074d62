"""Texts without id, or of one id, whose hashes agree in 32 bits stay apart wherever documents are told by their text."""

import random

import pytest
from pyspark.sql import functions as F

from girderlake.llm import minhash_star, suffix_arrays, suffix_trees

xxhash = pytest.importorskip("xxhash")


@pytest.fixture(scope="module")
def colliding():
    """Two texts of 26 words each, nothing in common, whose 64-bit hashes agree in their upper half."""
    rng, seen = random.Random(9), {}
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(2000)]
    while True:
        text = " ".join(rng.choice(vocab) + str(rng.randrange(10**6)) for _ in range(26))
        half = xxhash.xxh64_intdigest(text.encode(), 42) >> 32
        if half in seen:
            return seen[half], text
        seen[half] = text


@pytest.mark.parametrize("own_id", [None, 7])
def test_colliding_texts_are_two_documents(spark, colliding, own_id):
    a, b = colliding
    rows = [(1, a), (own_id, a + " end"), (own_id, b), (own_id, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    halves = docs.where(F.col("text").isin(a, b)).select(F.shiftright(F.xxhash64("text"), 32)).distinct().count()
    assert halves == 1
    kept = {r.text for r in minhash_star.one_of_each(docs, shingle=5, percent=80).collect()}
    assert b in kept and len(kept & {a, a + " end"}) == 1
    assert {r.n_shingles for r in minhash_star.near_copies(docs, shingle=3, percent=85).collect()} == {24, 25}
    removed = sorted((r.n_words, r.n_removed) for r in suffix_trees.remove_repeated_passages(docs.where(F.col("text") != b).union(docs.where(F.col("text") == b).limit(1)), width=20).collect())
    assert removed == [(26, 0), (26, 0), (27, 26)]
    spans = sorted((r.n_bytes, r.n_removed) for r in suffix_arrays.remove_repeated_bytes(docs.where(F.col("text") != b).union(docs.where(F.col("text") == b).limit(1)), width=200).collect())
    assert sorted(n for _, n in spans) == sorted([0, len(a), len(a)])
