"""Divergence audit, SentencePiece and Merkle manifest against brute force, on nulls, ties, repeats, long texts and odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from girderlake.llm import merkle_manifest, piece_bpe, source_divergence

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

#: With extra columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, p long, pos int, n long, hash string, tree int, m long, ids string"


def frame(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    filled = [(i, t, g, s, None if t is None else len(t), "x", 1, 2, 3, "h", 4, 5, "i") for i, t, g, s in rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcXYZéß漢") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice([None, "", "a", "b", "é", "z0"]) if i % 3 else "hot"
        text = rng.choice(["", None, "12 345 !?", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))]) if i % 5 == 0 else " ".join(rng.choice(vocab) + rng.choice(["", ",", "1", "\n"]) for _ in range(rng.randint(1, 40)))
        rows.append((i, text, lang, source))
    rows += rows[:7]  # repeated rows
    rows += [(None, "no id", "en", "a"), (None, None, None, None), (5, "another text of id 5", "en", "a"), (900, "abc " * 30000, "en", "long"), (901, "alone", "fr", "only")]
    return rows


# 11 Source divergence ----------------------------------------------------------------------------------------------


def brute_audit(rows, min_docs, top):
    counts, having = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(g or "", s or "") for _, _, g, s in rows})
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        having[lang or ""].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in having[lang].items() if n >= min_docs]
        whole = Counter({t: sum(counts[k][t] for k in groups if k[0] == lang) for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + (10**9 * (c[t] + 5)) // (total + 5 * len(kept)) for t in kept}

        p, q = shares(counts[lang, source]), shares(whole)
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            r = shares(counts[lang, other])
            pairs.append((-sum(abs(p[t] - r[t]) for t in kept), other.encode(), other))
        terms = [(q[t] - p[t], t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("min_docs", "top"), [(30, 50), (5, 3), (10**6, 50)])
def test_audit(spark, corpus, min_docs, top):
    got = source_divergence.audit(frame(spark, corpus), min_docs=min_docs, top_terms=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_audit(corpus, min_docs, top)


def test_audit_hands_on_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(source_divergence, "CHUNK", 50)
    terms = [t for part in source_divergence._terms("Abc é-É xyz1Q ".encode() * 30) for t in part]
    assert terms == ["abc".encode(), "é".encode(), "É".encode(), b"xyz", b"q"] * 30
    assert not list(source_divergence._terms(b""))
    assert source_divergence.audit(frame(spark, [])).count() == 0


def test_audit_plan_has_no_cartesian_product(spark, corpus):
    plan = source_divergence.audit(frame(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


# 12 SentencePiece --------------------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    with open(MODEL, "rb") as f:
        return piece_bpe.Pieces(f.read())


ODD = ["", " ", "  ", "\n", "a", " a", "a ", "  lead", "tail  ", "▁", "▁▁a", "a▁b", "<s>", "</s><unk>", "<0x41>", "\x00b", "🙂🙂 x", "é", "�", "漢字かな", " " * 1000, "x" * 3000, "ab" * 2000, "▁ ▁", "a b　c", "￿"]


def test_pieces_equal_the_library(pieces, library):
    rng = random.Random(3)
    alphabet = "abcdefgh  \n\t.,<>/s▁éüñß漢字🙂\x00'\"0123456789"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [" ".join(library.id_to_piece(rng.randrange(32000)).replace("▁", " ") for _ in range(60)) for _ in range(100)]
    for text, own in zip(texts, pieces.encode(texts), strict=True):
        ids = library.encode(text)
        assert own.tolist() == ids, text
        assert pieces.decode(ids) == library.decode(ids), text


def test_pieces_of_whole_text_equal_those_of_its_runs(pieces):
    text = "▁the quick  brown\n\n   fox".replace(" ", "▁")
    assert pieces.merge(text) == b"".join(pieces.merge(run) for run in pieces._runs.findall(text))


def test_rows_and_heap_give_the_same(pieces):
    rng = random.Random(4)
    runs = ["".join(rng.choice("etaoin▁🙂漢lsx\n") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    runs = [r for r in runs if "▁▁" not in r]
    assert pieces._tied.pattern == "▁▁"
    pieces._kept.clear()
    pieces._merge_short(runs)
    assert [pieces._kept[r] for r in runs] == [pieces.merge(r) for r in runs]


def test_pieces_of_documents(spark, corpus, library):
    rows = corpus + [(2000 + i, t, "en", "s") for i, t in enumerate(ODD)]
    got = Counter((r.doc_id, tuple(r.ids), r.n_tokens, r.decoded) for r in piece_bpe.encode_documents(frame(spark, rows), MODEL).collect())
    want = Counter((i, tuple(library.encode(t or "")), len(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _, _ in rows)
    assert got == want
    assert piece_bpe.encode_documents(frame(spark, []), MODEL).count() == 0


def test_models_of_other_kinds_are_refused():
    with open(MODEL, "rb") as f:
        model = f.read()
    ids, library = piece_bpe._loaded(model)
    assert ids.encode(["the"])[0].tolist() == library.encode("the")
    for other in (model + bytes([0x12, 0x02, 0x18, 0x01]), model + bytes([0x1A, 0x02, 0x20, 0x01])):  # of another kind; that drops white space
        with pytest.raises(ValueError, match="only"):
            piece_bpe.Pieces(other)


# 13 Merkle manifest ------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves):
    """Root and, of each leaf, its siblings level by level as (before, after)."""
    level, paths = [(h, [i]) for i, h in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        above = []
        for j in range(0, len(level), 3):
            run = level[j : j + 3]
            for k, (_, below) in enumerate(run):
                for i in below:
                    paths[i].append(("".join(h for h, _ in run[:k]), "".join(h for h, _ in run[k + 1 :])))
            above.append((sha("".join(h for h, _ in run)), [i for _, b in run for i in b]))
        level = above
    return level[0][0], paths


def brute_manifest(rows):
    by_source = defaultdict(list)
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        changed = None if text is None else text.replace("\n", "")
        by_source[source].append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for s in order:
        own = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found[s] = own, *tree([h for _, h, _ in own])
    root, upper = tree([found[s][1] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        own, subroot, paths = found[s]
        for (i, h, changed), path in zip(own, paths, strict=True):
            fold = changed
            for before, after in path + up:
                fold = sha(before + fold + after)
            out.append((i, h, subroot, root, sha("".join(a + b for a, b in path + up)), fold))
    return Counter(out)


def listed(spark, rows):
    made = merkle_manifest.manifest(frame(spark, rows), tampered_text=F.replace("text", F.lit("\n"), F.lit("")))
    proof = F.sha2(merkle_manifest.proof_text(F.col("path")), 256)
    fold = merkle_manifest.folded(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return Counter(tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", proof, fold).collect())


def test_manifest(spark, corpus):
    want = brute_manifest(corpus)
    assert listed(spark, corpus) == want
    assert {r[3] == r[5] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"t\n{i}", "en", "s") for i in range(n)]
    assert listed(spark, rows) == brute_manifest(rows)


def test_manifest_of_lone_leaves_and_empty_tables(spark):
    rows = [(i, None if i % 2 else "", None, f"s{i}") for i in range(5)]
    assert listed(spark, rows) == brute_manifest(rows)
    assert listed(spark, []) == Counter()


def test_manifest_without_tampering(spark, corpus):
    made = merkle_manifest.manifest(frame(spark, corpus[:50]))
    assert made.where("tampered_leaf IS NOT NULL").count() == 0
    assert made.where(merkle_manifest.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert made.select("root").distinct().count() == 1
