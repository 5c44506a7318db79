import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from causeway.llm import scoring as M


def test_counts_base_and_gain(spark, few, rows):
    cond = M.id_crc() % 7 != 2
    words = [(d, (t or "").encode().lower().split() + [b""]) for d, t, *_ in rows]
    c = Counter()
    for d, w in words:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    M_HEAD, M.HEAD = M.HEAD, 50  # most words take the join
    try:
        out = M.score_documents(few.withColumn("train", F.lit(1)), cond).collect()
    finally:
        M.HEAD = M_HEAD
    want = sorted((d if d is not None else -1, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for d, w in words)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want
    held = [r for r in out if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    m = M.Model(rng.standard_normal(M.CLASSES).astype(np.float32), [rng.standard_normal((n, M.CLASSES)).astype(np.float32) for n in M.FEATURES])
    rows = [rng.integers(0, n, 40) for n in M.FEATURES]
    assert np.allclose(sum(np.exp(m.log_p(rows, np.full(40, c))) for c in range(M.CLASSES)), 1, atol=1e-5)


def test_step_lowers_loss():
    rng = np.random.default_rng(2)
    cls = rng.integers(0, 4, 4000)
    cls[1::2] = cls[::2]  # each class comes twice
    code = np.arange(4000) % 1
    rows = M.features(cls, cls * 7 + code, np.array([0, 4000]))
    m = M.Model.start(np.zeros(M.CLASSES))
    loss = lambda: -m.log_p(rows, cls).mean()
    before, p = loss(), np.exp(m.logits(rows))
    p /= p.sum(1, keepdims=True)
    for _ in range(20):
        expected = [np.zeros(t.shape) for t in m.tables]
        m.expect(rows, expected)
        if _ == 0:  # against a plain sum
            want = np.zeros(m.tables[0].shape)
            np.add.at(want, rows[0], p)
            assert np.allclose(expected[0], want, rtol=1e-4)
        for t, n, e in zip(m.tables, m.seen(rows, cls), expected, strict=True):
            t += M.RATE * np.log((n + M.RARE) / (e + M.RARE))
    assert loss() < before - 1


def test_scores_do_not_depend_on_how_rows_are_dealt(few, rows):
    one, other = ({(r.doc_id, r.n_tokens): r.score for r in M.score_documents(few.select("doc_id", "text").repartition(n), M.id_crc() % 7 != 2).collect()} for n in (2, 8))
    assert one.keys() == other.keys()
    assert all(abs(one[k] - other[k]) <= 1e-5 * max(1, abs(one[k])) for k in one)


def test_features_stop_at_texts():
    rows = M.features(np.array([3, 4, 0, 5, 0]), np.array([30, 40, 0, 50, 0]), np.array([0, 3, 5]))
    assert rows[0].tolist() == [0, 30, 40, 0, 50] and rows[1].tolist() == [0, 0, 30, 0, 0]


def test_empty(none, few):
    assert M.score_documents(none, F.lit(True)).count() == 0
    out = M.score_documents(few.limit(5), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in out)


def test_words_of_a_class_sum_to_one_and_depend_on_history():
    rng = np.random.default_rng(4)
    leaves = np.arange(40)
    c = M.Choice(M.Tree(np.full(40, 3), rng.integers(1, 900, 40).astype(float)), rng.standard_normal(1 << 14).astype(np.float32))
    for word in (5, 6):
        history = M.Choice.history(np.array([word, 0]), np.array([0, 2]))
        p = np.exp(c.log_p([np.repeat(h[1:], 40) for h in history], leaves))
        assert np.isclose(p.sum(), 1, atol=1e-4)
        assert word == 5 or not np.allclose(p, other, rtol=0.1)
        other = p


def test_history_chooses_the_word_inside_its_class(spark):
    # bxx follows k1, cxx follows k2, with one ending: the class says nothing of which of the two comes.
    texts = [(i, " ".join(["k1 bxx" if (i * 7 + j * j) % 3 else "k2 cxx" for j in range(40)])) for i in range(400)]
    texts += [(1000, "k1 bxx k2 cxx " * 10), (1001, "k1 cxx k2 bxx " * 10)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    out = {r.doc_id: r for r in M.score_documents(docs, F.col("doc_id") < 1000).collect()}
    assert abs(out[1000].base_score - out[1001].base_score) < 1e-6
    assert out[1000].score > out[1001].score + 10


def plain_scores(rows, trained, cut, whole=False):
    """The model in plain loops: {index of row: score} of rows (doc_id, text); words more frequent than ``cut`` are the head."""
    full = 2**64 - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & full
        return x ^ (x >> 33)

    texts = [(t or "").encode() for _, t in rows]
    learn = [(xxhash.xxh64_intdigest(x, 42) if t is not None else 42, x) for (_, t), x, on in zip(rows, texts, trained, strict=True) if on]
    c = Counter(w for _, x in learn for w in [*x.lower().split(), b""])
    by_end = Counter()
    for w, n in c.items():
        if w:
            by_end[M.ending(w)] += n
    top = {e: i + 2 for i, (e, _) in enumerate(sorted(by_end.items(), key=lambda x: (-x[1], x[0]))[: M.CLASSES - 2])}
    class_of = lambda w: top.get(M.ending(w), 1) if w else 0
    size = [1.0] * M.CLASSES
    for w, n in c.items():
        size[class_of(w)] += n
    bias = [math.log(x / sum(size)) for x in size]
    head = sorted((w for w, n in c.items() if w and n > cut), key=lambda w: (-c[w], w))
    place = {w: i for i, w in enumerate(head)}
    rare = [1.0] * (M.CLASSES - 1)
    for w, n in c.items():
        if w and w not in place:
            rare[class_of(w) - 1] += n + 1
    leaf_of = lambda w: place.get(w, len(head) + class_of(w) - 1)
    # Trees: ways[leaf] lists (node, side) from the leaf up.
    leaves = [(class_of(w), c[w] + 1.0) for w in head] + [(k, rare[k - 1]) for k in range(1, M.CLASSES)]
    ways, odds, nodes = [[] for _ in leaves], {}, len(leaves)
    for k in range(1, M.CLASSES):
        open_ = sorted((m, i, [i]) for i, (cls, m) in enumerate(leaves) if cls == k)
        while len(open_) > 1:
            (a, _, left), (b, _, right) = open_[:2]
            odds[nodes - len(leaves)] = math.log(b) - math.log(a)
            for i in left + right:
                ways[i].append((nodes - len(leaves), i in right))
            open_ = sorted([*open_[2:], (a + b, nodes, left + right)])
            nodes += 1
    shift = 32 - max(14, math.ceil(math.log2(8 * len(c))))
    low = 2**32 - 1
    tables = [{} for _ in range(4)]
    weights = {}

    def tokens(x):
        """Class features, (class, word), and the word's decisions: side, the weights' places, odds of side 1."""
        words = [*x.lower().split(), b""]
        k, r, f = [class_of(w) for w in words], [xxhash.xxh32_intdigest(w) % M.WORD_ROWS if w else 0 for w in words], [leaf_of(w) + 1 if w else 0 for w in words]
        for i, w in enumerate(words):
            back = lambda of, d, i=i: of[i - d] if i >= d else 0
            pair = lambda d, k=k, back=back: (back(k, d) * M.CLASSES + back(k, d + 1)) % M.CLASS_ROWS
            history = [mixed(back(f, d) * 4 + d) & low for d in (1, 2)]
            met = []
            for node, side in ways[leaf_of(w)] if w else ():
                places = [((h ^ (mixed(node + 1) & low)) * 0x9E3779B1 & low) >> shift for h in history]
                met.append((side, places, 1 / (1 + math.exp(-odds[node] - sum(weights.get(p, 0.0) for p in places)))))
            y = [bias[q] + sum(t.get((row, q), 0.0) for t, row in zip(tables, (back(r, 1), back(r, 2), pair(1), pair(3)), strict=True)) for q in range(M.CLASSES)]
            total = sum(map(math.exp, y))
            yield w, k[i], (back(r, 1), back(r, 2), pair(1), pair(3)), [math.exp(v) / total for v in y], met

    clip = lambda x, bound: max(-bound, min(bound, x))
    for part in range(M.ROUNDS):
        seen, expected, decided = [Counter() for _ in tables], [Counter() for _ in tables], {}
        for h, x in learn:
            if not whole and (h - (full + 1 if h > full // 2 else 0)) % M.ROUNDS != part:
                continue
            for _, k, own, p, met in tokens(x):
                for s, e, row in zip(seen, expected, own, strict=True):
                    s[row, k] += 1
                    for q in range(M.CLASSES):
                        e[row, q] += p[q]
                for side, places, one in met:
                    for at in places:
                        d = decided.setdefault(at, [0, 0.0, 0])
                        d[0], d[1], d[2] = d[0] + side, d[1] + one, d[2] + 1
        for t, s, e in zip(tables, seen, expected, strict=True):
            for key in e:
                t[key] = clip(t.get(key, 0.0) + M.RATE * math.log((s[key] + M.RARE) / (e[key] + M.RARE)), M.BOUND)
        for at, (one, e, n) in decided.items():
            step = math.log((one + M.WORD_RARE) / (e + M.WORD_RARE)) - math.log((n - one + M.WORD_RARE) / (n - e + M.WORD_RARE))
            weights[at] = clip(weights.get(at, 0.0) + M.WORD_RATE * step, M.WORD_BOUND)
    out = []
    for x in texts:
        score = 0.0
        for w, k, _, p, met in tokens(x):
            score += math.log10(p[k]) + sum(math.log10(one if side else 1 - one) for side, _, one in met)
            if w and w not in place:  # its share of the bucket
                score += math.log10((c[w] + 1) / rare[k - 1])
        out.append(score)
    return out


@pytest.mark.parametrize(("head", "whole"), [(M.HEAD, False), (25, False), (M.HEAD, True)])
def test_scores_against_plain_loops(spark, tmp_path, monkeypatch, head, whole):
    """The registered query (and training over all rows in each round) on a small table."""
    rng = random.Random(6)
    known = ["%s%s" % (a, b) for a in "klmnprst" for b in ("ab", "ing", "ed", "er", "ion", "o", "é")]
    rows, last = [], 0
    for i in range(70):
        words = []
        for _ in range(rng.randrange(14)):
            last = (last * 3 + rng.randrange(4)) % len(known)
            words.append(known[last])
        rows.append((i, " ".join(words)))
    rows += [(70, None), (71, ""), (72, "never SEEN kab Kab"), (73, rows[4][1]), (None, "king ked")]
    cond = [d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows]
    monkeypatch.setattr(M, "HEAD", head)
    c = Counter(w for (_, t), on in zip(rows, cond, strict=True) if on for w in [*(t or "").encode().lower().split(), b""])
    cut = 0
    if len(c) > head:
        numbers = spark.createDataFrame([(n,) for n in c.values()], "n long")
        cut = numbers.agg(F.percentile_approx("n", F.lit(1.0 - head / len(c)), F.lit(10_000))).first()[0]
        assert cut > 0 and sum(n > cut for n in c.values()) <= 2 * head
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if whole:
        got = M.score_documents(docs, M.id_crc() % 7 != 2, whole=True).collect()
    else:
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        got = M.op2_lm_scoring(spark, str(tmp_path)).collect()
        assert {r.doc_id: r.held_out for r in got} == {d: d is not None and not on for (d, _), on in zip(rows, cond, strict=True)}
    want = dict(zip([d for d, _ in rows], plain_scores(rows, cond, cut, whole), strict=True))
    assert {r.doc_id for r in got} == set(want) and len(got) == len(rows)
    assert all(abs(r.score - want[r.doc_id]) <= 1e-4 * max(1, abs(want[r.doc_id])) for r in got)


def test_sums_of_probabilities_cost_little_beside_the_probabilities():
    """Most of the CPU seconds of a round of training went into adding up what a softmax expected, row by row."""
    rng = np.random.default_rng(7)
    tables = [rng.standard_normal((n, M.CLASSES)).astype(np.float32) for n in (M.MOST_ROWS, M.MOST_ROWS, *M.FEATURES[2:])]
    m = M.Model(np.zeros(M.CLASSES, np.float32), tables)
    rows = [rng.zipf(1.2, M.BATCH) % len(t) for t in tables]
    target, expected = rng.integers(0, M.CLASSES, M.BATCH), [np.zeros(t.shape, order="F") for t in tables]

    def least(run):
        took = []
        for _ in range(15):
            before = time.thread_time()
            run()
            took.append(time.thread_time() - before)
        return min(took)

    assert least(lambda: m.expect(rows, expected)) < 6 * least(lambda: m.log_p(rows, target))


def test_words_are_those_of_bytes():
    texts = ["".join(map(chr, range(256))) + " ÀÉ\u2003x", None, "", "  a\tB\x0b\x0c\r\nc ", " \t ", "one"]
    words, size = M.split(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert size.tolist() == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]
    sliced, size = M.split(pa.array(texts)[3:5])
    assert sliced.to_pylist() == [b"a", b"b", b"c"] and size.tolist() == [3, 0]
    assert list(M.slices(pa.array([], pa.string()))) == [] and list(M.slices(pa.array(["x" * M.CHUNK, None, "y"]))) == [(0, 3)]


@pytest.mark.parametrize("head", [[], [b"kab"], [b"kab", b"the", b"ing"]])
def test_coder_gives_the_same_numbers_with_and_without_a_head(head):
    code = M.Coder([b"ab", b"he"], head, buckets=4)
    cls, row, leaf, starts, words = code(pa.array(["Kab the. new", None, "ING kab"]))
    assert words.to_pylist() == [b"kab", b"the.", b"new", b"ing", b"kab"] and starts.tolist() == [0, 4, 5, 8]
    assert cls.tolist() == [2, 3, 1, 0, 0, 1, 2, 0] and row.tolist()[:1] == [xxhash.xxh32_intdigest(b"kab") % M.WORD_ROWS]
    assert [i for i, x in enumerate(leaf.tolist()) if x == -1] == [3, 4, 7]
    for i, w in zip((0, 1, 2, 5, 6), words.to_pylist(), strict=True):
        assert (leaf[i] == head.index(w)) if w in head else (len(head) <= leaf[i] < len(head) + (M.CLASSES - 1) * 4)


def test_sums_of_decisions_against_plain_sums():
    rng = np.random.default_rng(8)
    tree = M.Tree(rng.integers(1, M.CLASSES, 300), rng.integers(1, 900, 300).astype(float))
    c = M.Choice(tree, rng.standard_normal(1 << 14).astype(np.float32))
    leaf = rng.integers(-1, 300, 2000)
    history = M.Choice.history(leaf, np.array([0, 500, 2000]))
    met, expected = np.zeros(2 << 14, np.int64), np.zeros(1 << 14)
    c.sums(history, leaf, met, expected)
    names = [int(x) for x in M.mix(np.arange(1, len(tree.odds) + 1, dtype=np.uint64)).astype(np.uint32)]
    seen, hoped = Counter(), Counter()
    for i, x in enumerate(leaf.tolist()):
        for j in range(*tree.start[x : x + 2]) if x >= 0 else ():
            node, side = tree.node[j], int(tree.side[j])
            places = [((int(h[i]) ^ names[node]) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - 14) for h in history]
            p = 1 / (1 + math.exp(-float(tree.odds[node]) - sum(float(c.weights[q]) for q in places)))
            for q in places:
                seen[2 * q + side] += 1
                hoped[q] += p
    assert {int(k): int(met[k]) for k in np.flatnonzero(met)} == dict(seen)
    assert all(np.isclose(expected[q], x, rtol=1e-4) for q, x in hoped.items())
