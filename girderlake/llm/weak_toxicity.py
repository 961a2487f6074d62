"""Toxicity by weak supervision: many voters, a label model over their votes, a linear classifier on its posteriors.

Voters are words and letter n-grams that stand in toxic texts of a bounded training sample more often than chance gives,
and patterns of a text's form. The label model is generative (see ``label_model``): expectation maximisation estimates, from
the votes, how often each voter fires in each class and which voters go along with each other; the given label is one
more voter, of estimated accuracy. A logistic regression on all votes is then trained on the posteriors, and scores every
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girderlake.llm.arrays import BYTES, LOWER, of_each, runs, sliced
from girderlake.llm.store import cut

#: Labelled training rows that all fitting is done on; more are thinned by a hash of their id.
SAMPLE_ROWS = 20_000
#: Voters of each kind, at most: those with the most evidence.
VOTERS = 160
#: Bytes of letter n-grams that may become voters.
GRAMS = (4, 5, 6)
#: How much likelier (as twice a logarithm) its own share of toxic texts must make a term's counts than the overall share
#: does, for the term to vote; chance alone gives this to fewer than one in 3,000 terms.
EVIDENCE = 13.0

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True  # any letter beyond ASCII has only such bytes
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def terms(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, hashes, text of each, starts, ends): words (kind 0) and n-grams of bytes in words (kind n)."""
    low = LOWER[data]
    starts, ends = runs(_LETTER[low], offsets)
    sums = BYTES.sums(low)
    doc = np.searchsorted(offsets, starts, "right") - 1
    yield 0, BYTES.spans(sums, starts, ends), doc, starts, ends
    for n in GRAMS:
        count = np.maximum(ends - starts - n + 1, 0)
        first = np.repeat(starts, count) + of_each(count)
        yield n, BYTES.spans(sums, first, first + n), np.repeat(doc, count), first, first + n


def patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes by form, a column each: many exclamation marks, many capitals, many symbols, very short, very long."""

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    size = np.diff(offsets)
    symbol = np.isin(data, np.frombuffer(b"#*$%&@", np.uint8))
    return np.stack([share(data == 33) > 0.01, share(_UPPER[data]) > 0.2, share(symbol) > 0.02, size < 60, size > 20_000], axis=1)


PATTERNS = 5


@dataclass
class Model:
    """Terms by kind (sorted hashes and their columns), and the classifier's weights; the last weight is the constant."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    columns: dict[int, np.ndarray] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(PATTERNS + 1))
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    say: np.ndarray = field(default_factory=lambda: np.zeros(0))
    label_rates: np.ndarray = field(default_factory=lambda: np.full(2, 0.5))

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """1 where a voter fires, by text and voter."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.names) + PATTERNS), np.float32)
        for kind, hashes, doc, _, _ in terms(data, offsets):
            known = self.hashes.get(kind)
            if known is None or not len(known) or not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            out[doc[hit], self.columns[kind][at[hit]]] = 1
        if len(data):
            out[:, len(self.names) :] = patterns(data, offsets)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.votes(data, offsets) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Labelled:
    """What the label model finds: posteriors of class 1, rates of firing by class, voters' say, right labels by class."""

    posterior: np.ndarray
    rates: np.ndarray
    say: np.ndarray
    label_rates: np.ndarray


def label_model(votes: np.ndarray, labels: np.ndarray | None = None, rounds: int = 30, strength: float = 2.0) -> Labelled:
    """Expectation maximisation over the votes of a generative model with two classes.

    A text's unseen class sets how likely each voter fires, and so what its silence says. The label, where there is one,
    is one more voter, which speaks for either class and whose accuracy in each is estimated like the others'. It begins
    from the share of a text's voters that fire. In each round rates are estimated on the posteriors (``strength`` texts of
    the overall rate stand behind every one), then correlations of voters within a class from what the rates leave over: a
    voter's say is one over the sum of its positive correlations.
    """
    n, m = votes.shape
    posterior = _first_guess(votes)
    side = None if labels is None else np.stack([1 - labels, labels]).astype(np.float64)
    if side is not None:
        posterior = (posterior + side[1]) / 2
    out = Labelled(posterior, np.full((2, m), 0.5), np.ones(m), np.full(2, 0.5))
    overall = (votes.sum(0) + 0.5) / (n + 1)
    for _ in range(rounds):
        weight = np.stack([1 - out.posterior, out.posterior])
        prior = np.clip(weight.sum(1) / max(n, 1), 1e-3, 1 - 1e-3)
        out.rates = np.clip((weight @ votes + strength * overall) / (weight.sum(1, keepdims=True) + strength), 1e-6, 1 - 1e-6)
        shared = np.zeros((m, m))
        for w, rate, p in zip(weight, out.rates, prior, strict=True):
            rest = (votes - rate) * np.sqrt(w)[:, None]
            spread = np.sqrt((rest**2).sum(0)) + 1e-9
            shared += (rest.T @ rest) / spread[:, None] / spread[None, :] * p
        out.say = 1 / np.maximum(np.where(shared > 0.2, shared, 0).sum(1), 1)
        quiet = np.log((1 - out.rates[1]) / (1 - out.rates[0])) * out.say
        z = np.log(prior[1] / prior[0]) + quiet.sum() + votes @ (np.log(out.rates[1] / out.rates[0]) * out.say - quiet)
        if side is not None:
            right = (weight * side).sum(1)
            out.label_rates = np.clip((right + 0.9 * strength) / (weight.sum(1) + strength), 0.5, 1 - 1e-4)
            odds = np.log(out.label_rates / (1 - out.label_rates[::-1]))
            z += side[1] * odds[1] - side[0] * odds[0]
        before, out.posterior = out.posterior, 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(before - out.posterior).max(initial=0) < 1e-6:
            break
    return out


def _first_guess(votes: np.ndarray) -> np.ndarray:
    """Where EM begins: more voters than usual fire."""
    fired = votes.sum(1)
    return 0.1 + 0.8 * fired / (fired + max(fired.mean(), 1e-9) if len(fired) else 1)


def classifier(votes: np.ndarray, target: np.ndarray, ridge: float = 1e-5, rounds: int = 30) -> np.ndarray:
    """Logistic regression weights with a constant, by Newton steps."""
    x = np.concatenate([votes, np.ones((len(votes), 1))], 1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) / len(x) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most about SAMPLE_ROWS labelled rows for which ``training`` (a condition on the id) holds.

    Labels that are null, and ids with more than one label, are read as the greatest. Without both classes in the
    sample the model knows no terms and scores the share of toxic rows.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    total = known.count()
    if total > SAMPLE_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(1e6 * SAMPLE_ROWS / total))
    ids = known.select(F.col(id_col).cast("long").alias("id"), "label")  # about SAMPLE_ROWS ids, so they may be broadcast
    sample = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids), "id").select("id", "label", "text").distinct()  # rows of one id and other texts are other texts
    sample = cut(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                label = rows.column(1).to_numpy()
                for kind, hashes, doc, starts, ends in terms(data, offsets):
                    order = np.lexsort((doc, hashes))
                    h, d = hashes[order], doc[order]
                    first = np.ones(len(h), bool)
                    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    h, d, at = h[first], d[first], order[first]
                    new = np.ones(len(h), bool)
                    new[1:] = h[1:] != h[:-1]
                    head = np.flatnonzero(new)
                    if not len(head):
                        continue
                    toxic = np.add.reduceat(label[d].astype(np.int64), head)
                    texts = np.diff(np.append(head, len(h)))
                    some = np.flatnonzero(toxic > 0)  # a term of no toxic text here adds only to its texts elsewhere
                    raw = LOWER[data].tobytes()
                    names = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[head]].tolist(), ends[at[head]].tolist())] if kind == 0 else None
                    shown = [""] * len(head)
                    for i in some.tolist():
                        shown[i] = names[i] if names else raw[starts[at[head[i]]] : ends[at[head[i]]]].decode("utf-8", "replace")
                    yield pa.record_batch([pa.array(np.full(len(head), kind)), pa.array(h[head].view(np.int64)), pa.array(toxic), pa.array(texts), pa.array(shown)], names=["kind", "hash", "toxic", "texts", "name"])

    counted = sample.mapInArrow(count, "kind long, hash long, toxic long, texts long, name string").groupBy("kind", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts"), F.max("name").alias("name"))
    both = sample.groupBy().agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    base = float(np.clip((both["toxic"] or 0) / max(both["n"], 1), 1e-3, 1 - 1e-3))
    t, c = F.col("toxic"), F.col("texts") - F.col("toxic")
    part = lambda n, p: F.when(n > 0, n * F.log(n / (F.col("texts") * p))).otherwise(F.lit(0.0))
    good = cut(counted.withColumn("evidence", 2 * (part(t, base) + part(c, 1 - base))).where((F.col("evidence") > EVIDENCE) & (t > base * F.col("texts"))))  # read once for each kind
    model = Model()
    for kind in (0, *GRAMS):
        top = good.where(F.col("kind") == kind).orderBy(F.desc("evidence"), "name", "hash").limit(VOTERS).collect()
        rows = sorted((np.int64(r["hash"]).view(np.uint64), r["name"]) for r in top)
        model.hashes[kind] = np.array([r[0] for r in rows], np.uint64)
        model.columns[kind] = np.arange(len(rows)) + len(model.names)
        model.names += [r[1] for r in rows]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                fired = held.value.votes(data, offsets).astype(bool)
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array([np.flatnonzero(x).astype(np.int32) for x in fired], pa.list_(pa.int32()))], names=["id", "label", "fired"])

    cast = sample.mapInArrow(vote, "id long, label int, fired array<int>").orderBy("id").collect()  # about SAMPLE_ROWS short rows
    target = np.array([r["label"] for r in cast], np.float64)
    votes = np.zeros((len(cast), len(model.names) + PATTERNS), np.float32)
    for i, r in enumerate(cast):
        votes[i, r["fired"]] = 1
    model.weights = np.zeros(votes.shape[1] + 1)
    if not len(cast) or target.min() == target.max():
        share = float(np.clip(target.mean() if len(cast) else 0.0, 1e-3, 1 - 1e-3))
        model.weights[-1] = np.log(share / (1 - share))
        return model
    found = label_model(votes.astype(np.float64), target)
    model.rates, model.say, model.label_rates = found.rates, found.say, found.label_rates
    model.weights = classifier(votes, found.posterior)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every whole text; null counts as empty. Rows that repeat are scored each by itself."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in sliced(batch, "text"):
                value = held.value.score(data, offsets)
                yield pa.record_batch([rows.column(0), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, score double, predicted int")
