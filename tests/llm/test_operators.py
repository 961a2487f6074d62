"""Every training-data operator against brute force, on texts with nulls, ties, repeats, long words and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from girderlake.llm import anchors, byte_bpe, chat_templates, complement_packing, language_vectors, minhash_star, permutation_index, quality_lines, suffix_arrays, suffix_trees, weak_toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, bucket string, key long, size int, n long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijéüñ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = sentence(45), sentence(8)
    out = [None, "", " \t\n", "one", "A b", "x " * 60, "é" * 500, "\x0b\x0cword\x1c\x85tail", "ab" * 400, sentence(4000)]
    base = sentence(120)
    out += [base, base, base.upper(), base.replace(" ", "\n"), base + " more"]
    for i in range(40):
        w = base.split()
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = rng.choice(vocab) + "q"
        out.append(" ".join(w))
    for i in range(60):
        out.append(sentence(rng.randint(5, 60)) + "\n" + (line if i % 2 else sentence(6)) + "\n" + (passage if i % 5 == 0 else sentence(20)))
    out += [passage, passage + " " + passage, "zz " + passage[10:]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"h{(i or 0) % 2}", "b", 1, 2, 3) for i, t in texts], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 Permutation index -----------------------------------------------------------------------------------------------


def exact_neighbours(ids, vectors, q, k):
    d = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
    d[q] = np.inf
    best = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in best if np.isfinite(d[i])]


def test_permutation_index_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[:900] = x[0] + 0.01 * rng.normal(size=(900, 24))  # a third are near copies
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = defaultdict(list)
    for r in permutation_index.nearest(table, "id % 100 = 0", least=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    hits = 0
    for q in range(0, 3000, 100):
        want = exact_neighbours(np.arange(3000), x, q, 10)
        assert [r for _, _, r in got[q]] == list(range(1, 11))
        for v, s, _ in got[q]:
            assert s == pytest.approx(math.dist(x[q], x[v]), rel=1e-12)
        hits += len({v for v, _ in want} & {v for v, _, _ in got[q]})
    assert hits >= 0.9 * 300


def test_permutation_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (8, [2.0]), (None, [1.0, 1.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (100, [1.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in permutation_index.nearest(table, "id % 100 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 0.5), (0, 4, 9, 2.0), (100, 1, 0, 0.5), (100, 2, 1, 0.5), (100, 3, 2, 0.5), (100, 4, 9, math.sqrt(4.25))]
    assert permutation_index.nearest(table.limit(0), "id % 100 = 0").count() == 0


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(1)
    orders = np.stack([rng.permutation(12)[:5] for _ in range(50)]).astype(np.int32)
    files = permutation_index.InvertedFiles(orders, 12)
    place = lambda o: {p: i for i, p in enumerate(o.tolist())}
    for q in orders[:5]:
        want = [sum(abs(place(q).get(p, 5) - place(o).get(p, 5)) for p in range(12)) for o in orders]
        assert files.footrule(q).tolist() == want


# 2 Quality rules ---------------------------------------------------------------------------------------------------


def quality_by_hand(rows, share, least, depleted, min_words=10, max_repeat=20):
    having, hosts, info = defaultdict(set), defaultdict(set), []
    for i, host, text in rows:
        w = words(text)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        keys = [tuple(words(lower(x))) for x in lines]
        hosts[host].add(text or "")
        for k in keys:
            having[host, k].add(text or "")
        info.append((i, host, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), sum(c - 1 for c in Counter(lines).values()), len(covered), keys))
    out = {}
    for i, host, n, chars, symbols, dup, repeat, keys in info:
        over = lambda k, h=host: len(having[h, k]) > least and len(having[h, k]) > share * len(hosts[h])
        gone = sum(len(k) for k in keys if over(k))
        failed = n < min_words or 100 * repeat > max_repeat * n
        out[i] = (n, chars, symbols, dup, repeat, failed, gone, not failed and gone <= depleted * n)
    return out


def test_quality_rules(spark, docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_lines.judge(docs, share=0.1, least=3).collect()}
    want = quality_by_hand([(i, f"h{i % 2}", t) for i, t in texts], 0.1, 3, 0.5)
    assert got == want
    assert any(r[6] for r in want.values())
    assert quality_lines.judge(empty(spark)).count() == 0


def test_quality_limits_of_the_query(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)) + "\nshared line"
    rows = [(i, text(), "en", host, "b", 1, 2, 3) for host, n in (("two", 2), ("three", 3)) for i in range(n)]
    rows += [(100, rows[0][1], "en", "two", "b", 1, 2, 3)]  # a copy is no further text
    rows += [(200 + i, text() if i < 4 else text().split("\n")[0], "en", "share", "b", 1, 2, 3) for i in range(80)]  # 4 of 80: not over a twentieth
    got = quality_lines.judge(spark.createDataFrame(rows, SCHEMA)).groupBy("removed_words").count().collect()
    assert {r["removed_words"]: r["count"] for r in got} == {0: 83, 2: 3}


def test_data_of_the_correctness_check_hold_lines_above_the_limits(spark):
    """Or equal rows of query and SQL would show nothing of the method."""
    got = quality_lines.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert got.where("removed_words > 0").count() > 100
    assert got.where("NOT base_failed AND NOT kept").count() > 0


def test_clean_removes_frequent_lines(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) for _ in range(30)) + "\nSHARED Line here\nlast", "en", None, "b", 1, 2, 3) for i in range(8)]
    rows.append((99, "shared line HERE\n" + "shared line here " * 0 + "a b c d e f g h", "en", None, "b", 1, 2, 3))
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r["text"] for r in quality_lines.clean(df, share=0.5, least=3).collect()}
    assert set(out) == {*range(8), 99}
    assert out[99] == "a b c d e f g h"
    assert all(t.count("\n") == 0 and "SHARED" not in t and "last" not in t for t in out.values())


# 3 Chat formatting -------------------------------------------------------------------------------------------------


def read(rows_by_conv, got):
    for conv, turns in rows_by_conv.items():
        r = got[conv]
        said = "".join(f"{a or ''}\n{b or ''}\n" for a, b in turns)
        loss = "".join(b or "" for a, b in turns if a == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss))


@pytest.mark.parametrize("part", [3, 50, 1 << 20])
def test_conversations_are_read_back(spark, part):
    hostile = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|x", "|", "<", "", None, "é<|😀|>\n", "\\n", "<" * 5 + "|"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\\n\nb"]), rng.choice(hostile) if t % 2 else "".join(rng.choice("<|\\im_end>a\n") for _ in range(30))) for c in [None, -1, *range(12)] for t in range(c or 5)]
    rows = [r for r in rows if r[0] is None or r[0] >= 0] + [(-1, 0, "user", hostile[0]), (-1, 1, "assistant", hostile[0])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    parts = chat_templates.format_conversations(df, part=part)
    got = {r["conv_id"]: r for r in chat_templates.read_back(parts).collect()}
    read({c: [(r, x) for _, r, x in sorted(v, key=lambda z: z[0])] for c, v in by.items()}, got)
    assert set(got) == set(by)
    assert chat_templates.read_back(chat_templates.format_conversations(df.limit(0))).count() == 0


def render(template, **variables):
    return "".join(t for t, _ in chat_templates.compiled(template)(variables))


def test_template_language():
    assert render("{% for m in ms %}{{ loop.index }}{% if not loop.last %}, {% endif %}{% endfor %}", ms=[{}, {}, {}]) == "1, 2, 3"
    assert render("{% set x = 'a' ~ 1 %}{{ x }}{% if x == 'a1' and y %}!{% elif y == none %}?{% else %}-{% endif %}") == "a1?"
    assert render("{{ m['k'] | upper }}{{ m.absent }}{{ 'b' in 'abc' }}", m={"k": "v"}) == "Vtrue"
    pieces = list(chat_templates.compiled("a{% generation %}b{{ x }}{% endgeneration %}c")({"x": "y"}))
    assert "".join(t for t, m in pieces if m) == "by"
    # nothing of Python can be reached
    assert render("{{ x.__class__ }}{{ 'a'.upper }}", x="s") == ""
    for bad in ("{% if x %}", "{{ f(x) }}", "{{ }}", "{% nothing %}", "{{ a | unknown }}", "{% endfor %}", "{{ 'a }}"):
        with pytest.raises(chat_templates.TemplateError):
            chat_templates.compiled(bad)


def test_constants_are_folded():
    tree = chat_templates.folded(chat_templates.parse("a{{ 'b' ~ 2 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false and x %}d{% endif %}"))
    assert tree == (chat_templates.Put(chat_templates.Const("ab2c")),)


# 4 MinHash near-dedup ----------------------------------------------------------------------------------------------


def components_by_hand(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, docs, texts, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_star.near_copies(docs, k, percent).collect()}
    assert got == components_by_hand(texts, k, percent)


def test_near_copies_odd_rows(spark, texts):
    text = texts[-1][1]
    rows = [(None, text), (5, text), (5, text), (None, "alone in the world"), (None, "alone in the world"), (7, None)]
    df = frame(spark, rows)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_star.near_copies(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (7, 7, True)], key=str)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in minhash_star.one_of_each(df).collect())
    assert kept == [(False, 5), (False, 7), (True, 0)]
    assert minhash_star.near_copies(empty(spark)).count() == 0


def test_block_counts_and_forest():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    at = np.append(0, np.cumsum([len(s) for s in sets]))
    rows, columns = np.arange(10), np.arange(10, 40)
    common = minhash_star.common_counts(np.concatenate(sets), at, rows, columns)
    assert common.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in columns] for i in rows]
    a, b = minhash_star.forest(np.ones((4, 5), bool), np.arange(4), np.arange(4, 9))
    assert len(a) == 8


# 5 Best-fit packing ------------------------------------------------------------------------------------------------


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = complement_packing.pack_documents(docs, path, capacity=256).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 256))
        for r in own:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert sum(r["length"] for r in own) == len(ids)
    gaps = []
    for length in sorted((r["length"] for r in rows), reverse=True):  # plain best fit decreasing
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 256) - length)
    assert check_packing(rows, 256) <= len(gaps)
    assert complement_packing.pack_documents(empty(spark), path).count() == 0


def test_plan_finds_every_exact_complement():
    """Against trying all combinations of up to three lengths, and with sums that only the last splits give."""
    rng = random.Random(8)
    for _ in range(60):
        capacity = 60
        left = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(2, 12)):
            left[rng.randint(1, capacity - 1)] += rng.randint(1, 2)
        index = complement_packing.SumIndex(left)
        for _ in range(3):
            length = int(np.flatnonzero(left)[-1]) if left.any() else 0
            if not length:
                break
            have = [x for x in range(1, length + 1) for _ in range(int(left[x]))]
            have.remove(length)
            gap = capacity - length
            want = {1: gap in have, 2: any(a + b == gap for i, a in enumerate(have) for b in have[i + 1 :]), 3: any(a + b + c == gap for i, a in enumerate(have) for j, b in enumerate(have[i + 1 :], i + 1) for c in have[j + 1 :])}
            found = index.complement(length, gap)
            assert (len(found) if found else None) == next((k for k in (1, 2, 3) if want[k]), None)
            if found:
                assert sum(found) == gap and not Counter(found) - Counter(have)
            for x in (length, *(found or ())):
                index.take(x, 1)
            have = (left > 0).astype(int)
            pairs = np.convolve(have, have)
            pairs[2 * np.flatnonzero(left == 1)] -= 1
            assert index.pairs.tolist() == pairs.tolist()
    many = {4096 - 200: 1, **{x: 1 for x in range(2, 3000, 4)}, 1: 1, 79: 1, 120: 1}  # 120 + 79 + 1 alone fills the first gap
    planned = complement_packing.plan(many, 4096)
    assert any(3896 in parts and sum(parts) == 4096 for _, parts in planned)


def test_tokenizer_of_another_kind(tmp_path):
    """Word by word only for the normaliser and splitter that it is made for."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"A": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    encoder = complement_packing.WordIds(str(tmp_path / "t.json"))
    texts = ["A b", "", "a A. b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(data, offsets)] == [own.encode(t).ids for t in texts]


def test_plan_uses_every_piece_once():
    rng = random.Random(6)
    for _ in range(20):
        histogram = Counter(rng.randint(1, 64) for _ in range(rng.randint(1, 400)))
        planned = complement_packing.plan(dict(histogram), 64)
        used = Counter()
        for n, parts in planned:
            assert sum(parts) <= 64
            for x in parts:
                used[x] += n
        assert used == histogram


# 6 and 7 Passages --------------------------------------------------------------------------------------------------


def passages_by_hand(texts, width):
    first, covered = {}, {}
    for i, t in sorted(texts):
        w = words(t)
        gone = set()
        for j in range(len(w) - width + 1):
            if tuple(w[j : j + width]) in first:
                gone.update(range(j, j + width))
            else:
                first[tuple(w[j : j + width])] = i
        covered[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return covered


@pytest.mark.parametrize("width", [20, 8])
def test_substring_dedup(spark, docs, texts, width):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in suffix_trees.remove_repeated_passages(docs, width=width).collect()}
    assert got == passages_by_hand(texts, width)
    kept = suffix_trees.remove_repeated_passages(docs, width=width, keep=("source", "size")).columns
    assert kept == ["doc_id", "n_words", "n_removed", "kept_text", "source", "size"]


def test_substring_dedup_repeated_and_unnamed_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_trees.remove_repeated_passages(frame(spark, [(3, text), (3, text), (None, text), (9, None)])).collect()), key=str)
    assert got == sorted([(3, 0), (3, 0), (None, 30), (9, 0)], key=str)
    assert suffix_trees.remove_repeated_passages(empty(spark)).count() == 0


def bytes_by_hand(texts, width):
    seen = defaultdict(list)
    data = {i: (t or "").encode() for i, t in texts}
    for i, b in data.items():
        for j in range(len(b) - width + 1):
            seen[b[j : j + width]].append((i, j))
    gone = {i: np.zeros(len(b), bool) for i, b in data.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + width] = True
    out = {}
    for i, b in data.items():
        g = gone[i]
        spans = int((np.diff(np.append(0, g.astype(int))) == 1).sum()) if len(g) else 0
        out[i] = (len(b), int(g.sum()), spans, bytes(x for x, y in zip(b, g) if not y))
    return out


@pytest.mark.parametrize("width", [200, 60])
def test_suffix_array_dedup(spark, docs, texts, width):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_arrays.remove_repeated_bytes(docs, width=width).collect()}
    assert got == bytes_by_hand(texts, width)
    assert suffix_arrays.remove_repeated_bytes(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def shared_passage():
    """A passage between words of each document's own, in 150 documents; some of them twice, one row repeated."""
    own = lambda i, side: " ".join(f"{side}{i}q{j}" for j in range(25))
    passage = " ".join(f"p{j}" for j in range(60))
    out = [(i, f"{own(i, 'a')} {passage} {own(i, 'b')}" + (f" {passage}" if i % 7 == 0 else "")) for i in range(150)]
    return [*out, (None, passage), (200, own(3, "a"))]


@pytest.mark.parametrize("by_word", [True, False])
def test_no_anchor_takes_all_records(spark, shared_passage, by_word):
    symbols, width, k = (anchors.Symbols(True), 20, 5) if by_word else (anchors.Symbols(False), 200, 40)
    source = anchors.document_key(frame(spark, shared_passage), "doc_id", "text")
    make = lambda hot: lambda docs, parts, data, offsets: anchors.records(symbols, docs, parts, data, offsets, width, k, hot)
    none = np.zeros(0, np.uint64)

    def largest(hot):
        batches = source.select("doc", "part", "text").coalesce(1).toArrow().to_batches()
        (f,) = list(anchors.units(iter(batches), make(hot)))
        return max(Counter(f["anchor"][(f["state"] & anchors.LEAD > 0) & (f["state"] & anchors.WINDOW == 0)].tolist()).values())

    assert largest(none) > 100
    assert largest(anchors.hot_anchors(source, make(none), 20)) <= 23  # one record for each of the three units may stay uncounted


@pytest.mark.parametrize("most", [0, 2, 20, 1 << 40])
def test_passages_dealt_by_window(spark, texts, shared_passage, monkeypatch, most):
    monkeypatch.setattr(anchors, "MOST_RECORDS", most)
    for rows in (texts, [(300 if i is None else i, t) for i, t in shared_passage]):
        df = frame(spark, [*rows, rows[20], rows[20]])
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in suffix_trees.remove_repeated_passages(df, width=20).collect()}
        assert got == passages_by_hand(rows, 20)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_arrays.remove_repeated_bytes(df, width=200).collect()}
        assert got == bytes_by_hand(rows, 200)


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_powers_of_two_confuse(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2**64 are equal, whatever the base, are still different."""
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"x y {one}"), (4, f"x y {other}"), (5, f"{one}\n{other}\n{one}")]
    df = frame(spark, rows)
    quality = {r["doc_id"]: r["n_dup_lines"] for r in quality_lines.judge(df).collect()}
    assert quality[5] == 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_star.near_copies(df, 3, 85).collect()} == components_by_hand(rows, 3, 85)
    assert all(r["n_removed"] == 0 for r in suffix_trees.remove_repeated_passages(df).collect())
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (5, one[:300] + "zz" + other[:300])]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_arrays.remove_repeated_bytes(frame(spark, rows)).collect()}
    assert got == bytes_by_hand(rows, 200)


def test_rows_of_one_id_and_different_texts(spark):
    """They are different documents in every operator that compares documents; which comes first is set by the texts."""
    shared, own = " ".join(f"s{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    df = frame(spark, [(1, shared), (7, shared), (7, own), (7, own)])
    got = sorted((r["doc_id"], r["kept_text"], r["n_removed"]) for r in suffix_trees.remove_repeated_passages(df).collect())
    assert got == sorted([(1, shared, 0), (7, "", 40), (7, own, 0), (7, own, 0)])
    got = sorted((r["doc_id"], bytes(r["kept"]).decode(), r["n_removed"]) for r in suffix_arrays.remove_repeated_bytes(df, width=100).collect())
    assert got == sorted([(1, "", len(shared)), (7, "", len(shared)), (7, own, 0), (7, own, 0)])
    near = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_star.near_copies(df).collect())
    assert near == [(1, 1, True), (7, 1, False), (7, 7, True), (7, 7, True)]
    assert sorted((r["doc_id"], r["text"]) for r in minhash_star.one_of_each(df).collect()) == [(1, shared), (7, own)]


@pytest.mark.parametrize("most", [1, 2, 7, 1 << 20])
def test_prefixes_grow_until_groups_fit(most):
    rng, width = np.random.default_rng(9), 12
    codes = rng.integers(0, 3, 4000).astype(np.uint64)
    codes[1000:1200] = codes[:200]
    tops = np.sort(rng.choice(len(codes) - width, 1500, replace=False))
    nodes, depths = set(), set()
    for places, label, depth in suffix_trees.prefix_groups(codes, tops, width, 2, most):
        depths.add(depth)
        sizes = Counter(label.tolist())
        assert len(places) <= most or len(sizes) == 1
        assert depth == width or max(sizes.values()) <= most
        for at, node in suffix_trees.deep_nodes(codes, tops[places], label, depth, width):
            for x in np.unique(node):
                nodes.add(frozenset(tops[places[at[node == x]]].tolist()))
    want = defaultdict(set)
    for t in tops.tolist():
        want[tuple(codes[t : t + width].tolist())].add(t)
    assert nodes == {frozenset(x) for x in want.values() if len(x) > 1}
    assert depths == {1: {12}, 1 << 20: {2}}.get(most, depths) and (2 in depths) == (most > 1000)


def test_induced_sorting_recurses():
    """A megabyte of prose takes several levels, each sorted by induction, however many names it has."""
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    raw = " ".join(rng.choice(vocab) for _ in range(180_000)).encode()[: 1 << 20]
    raw = raw[:900_000] + raw[100_000:200_000] + raw[1_000_000:]
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0).astype(np.int16)
    levels = []
    array = suffix_arrays.suffix_array(text, 258, levels)
    assert len(levels) >= 3 and levels[1] > 100_000
    assert (np.sort(array) == np.arange(len(text))).all()
    rank = np.empty(len(text) + 1, np.int64)
    rank[array], rank[-1] = np.arange(len(text)), -1
    a, b = array[:-1], array[1:]
    assert ((text[a] < text[b]) | ((text[a] == text[b]) & (rank[a + 1] < rank[b + 1]))).all()


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_of_many_symbols(seed):
    rng = np.random.default_rng(seed)
    sigma = int(rng.choice([2, 3, 50, 2000]))
    text = np.append(rng.integers(1, sigma, 3000), 0)
    if seed % 2:
        text[1500:2900] = text[:1400]
    if seed % 3 == 0:
        text[200:900] = 1
    assert suffix_arrays.suffix_array(text, sigma).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("raw", [b"banana", b"aaaaaaa", b"abcabcabcx", bytes(range(256)), b"", b"a"])
def test_suffix_array_by_induction(raw):
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.int16) + 1, 0).astype(np.int16)
    array = suffix_arrays.suffix_array(text, 258).tolist()
    assert array == sorted(range(len(text)), key=lambda i: text[i:].tolist())


# 8 Language --------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = language_vectors.predict(docs, language_vectors.learn(docs, held_out=held), keep=("lang",)).where(held & F.col("lang").isNotNull()).collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_by_definition(spark):
    rows = [(0, "der hund", "de"), (1, "the dog", "en"), (2, "", "en"), (3, None, "de"), (4, "1 2 3", "en"), (5, "the", None), (6, "the", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = language_vectors.learn(df.where("lang <> ''"))

    def bundle(text):
        symbol, vectors = language_vectors._Tables.get()
        runs = [0, *[int(symbol[ord(c)]) for c in text], 0]
        s = [x for i, x in enumerate(runs) if x or not i or runs[i - 1]]
        total = np.zeros(language_vectors.DIMENSIONS)
        for i in range(len(s) - 2):
            gram = np.ones(language_vectors.DIMENSIONS)
            for back, x in enumerate(reversed(s[i : i + 3])):
                gram = gram * np.roll(vectors[x], back)
            total += gram
        return total

    assert set(prototypes) == {"de", "en"}
    assert np.array_equal(prototypes["de"], bundle("der hund"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_vectors.predict(df, prototypes).collect()}
    assert {i for i, v in got.items() if v[0] == "und"} == {2, 3, 4}
    v, p = bundle("the"), prototypes["en"]
    assert got[5][0] == "en" and got[5][1] == pytest.approx(v @ p / np.linalg.norm(v) / np.linalg.norm(p), rel=1e-4)
    assert all(r["lang_pred"] == "und" for r in language_vectors.predict(df, {}).collect())


# 9 Toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = weak_toxicity.fit(docs, labels, training=~held)
    rows = weak_toxicity.score(docs, model).join(labels, "doc_id").where(held).select("toxic", "predicted", "score").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert len(toxic) > 20
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)


def test_label_model_finds_accuracies():
    """On simulated votes: rates by class, the accuracy of labels that are often wrong, and what copies of a voter may say."""
    rng = np.random.default_rng(3)
    n, rates = 6000, np.array([[0.02, 0.05, 0.03, 0.10, 0.04, 0.05], [0.60, 0.45, 0.50, 0.70, 0.30, 0.55]])
    truth = (rng.random(n) < 0.25).astype(int)
    votes = (rng.random((n, 6)) < rates[truth]).astype(float)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)
    labels = np.where(rng.random(n) < 0.15, 1 - truth, truth).astype(float)
    found = weak_toxicity.label_model(votes, labels)
    assert np.abs(found.rates[:, :6] - rates).max() < 0.06
    assert np.abs(found.label_rates - 0.85).max() < 0.05
    assert found.say[[0, 6, 7]].max() < 0.4 and found.say[1:6].min() > 0.8
    assert ((found.posterior > 0.5) == truth).mean() > 0.95 > (labels == truth).mean()
    alone = weak_toxicity.label_model(votes)  # no labels at all
    assert ((alone.posterior > 0.5) == truth).mean() > 0.9


def test_few_toxic_texts(spark):
    """Five of twenty are toxic, and say the same two words."""
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(12))
    rows = [(i, line() + (" zzgrub kwarp" if i < 5 else "")) for i in range(20)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 5)) for i in range(20)] + [(4, 0), (4, None)], "doc_id long, toxic int")
    model = weak_toxicity.fit(df, labels, training=F.lit(True))
    scores = {r["doc_id"]: r["score"] for r in weak_toxicity.score(df.union(df), model).collect()}
    assert min(scores[i] for i in range(5)) > 0.5 > max(scores[i] for i in range(5, 20))
    nothing = weak_toxicity.fit(empty(spark), labels.limit(0), training=F.lit(True))
    assert weak_toxicity.score(df, nothing).where("predicted = 1").count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    model = weak_toxicity.fit(docs, labels, training=F.lit(True))
    rows = weak_toxicity.score(docs, model).collect()
    assert {r["predicted"] for r in rows} == {0} and len(rows) == docs.count()
    assert weak_toxicity.score(empty(spark), model).count() == 0


# 10 Byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(spark, docs, texts, tiktoken_encoding):
    odd = ["it's  'tis 'Ve'll\n\n  x", "a  b c　", "12ab³½ ٣", "'s's'd're", "<|endoftext|>", "\x00\x01\x85\x1c x", "😀👩‍👩‍👧 é́", "a" * 5000, " " * 3000 + "x", "!?" * 3000, "'", "'r", "x'l", "\n \n"]
    rows = [*texts, *[(1000 + i, t) for i, t in enumerate(odd)], (None, "x"), (1000, odd[0])]
    got = byte_bpe.encode_documents(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(rows)
    by_id = dict(rows)
    for r in got:
        text = by_id[r["doc_id"]] or ""
        want = tiktoken_encoding.encode_ordinary(text)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want, text[:50]
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(want)
        starts, counts = (np.frombuffer(bytes(r[c]), "<u4").tolist() for c in ("starts", "counts"))
        assert sum(counts) == len(want) and len(starts) == r["n_pretokens"]
        at = np.append(0, np.cumsum(counts)).tolist()
        for a, b, i, j in zip(starts, [*starts[1:], len(text.encode())], at, at[1:]):
            assert tiktoken_encoding.decode_bytes(want[i:j]) == text.encode()[a:b]
    assert byte_bpe.encode_documents(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern="x")
