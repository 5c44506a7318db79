"""LM scoring (operator 2): a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). Words fall into classes by their ending (the ``CLASSES`` - 2 most
frequent endings, one class for all others, one for the end of a text), so that rare and unknown words have classes
too. The class is predicted by a softmax over hashed features of the history: the last word, the word before it (a
skip), the classes of the last two words together (an n-gram) and of the two before those (a skip n-gram).

Inside a class a word is reached by binary decisions down a Huffman tree, whose leaves are the class's frequent words and
buckets of its other words. A decision's odds are those of the counts below it (the closed form of a model of word
features alone) times the weights of its own hashed features of the history: the last word and the word before it, each
with the decision. Words of a bucket share it by smoothed frequency, (c + 1) /
(N_bucket + V_bucket + 1), whose last share is for unknown words; so all probabilities of a history sum to one. Leaves,
buckets and rows of weights rise with the vocabulary up to ``HEAD``, ``MOST_ROWS``, ``MOST_BUCKETS`` and ``MOST_BITS``, which bound
a worker's memory.

Counting and training read all training documents. Training goes in ``ROUNDS`` Spark jobs, each over its own share of the
rows (by a hash of the text): one pass over the rows in that many batches. With ``whole`` each round goes over all rows
instead. In a round, tasks sum what each feature has seen and what the model of the round before expected of it (the two
terms of the gradient), the sums are added up by blocks in two levels of shuffles, and each weight moves by the logarithm
of the one over the other (iterative scaling). The sums do not depend on how rows are dealt to tasks, so neither does the
model. Counts of the ``HEAD`` most frequent words are broadcast (a bound on their size);
tokens of all other words meet their counts in a join.
"""

from __future__ import annotations

import heapq
import math
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import giving_back, id_crc, kept, materialize, mix

CLASSES = 32
#: Bytes of a word's ending.
ENDING = 2
#: Words whose counts are broadcast, about; twice as many at most.
HEAD = 100_000
#: Rows of the tables of word features and of class features.
WORD_ROWS, CLASS_ROWS = 4096, 1024
FEATURES = (WORD_ROWS, WORD_ROWS, CLASS_ROWS, CLASS_ROWS)
#: Rows of word features, buckets of rare words in a class, and bits of the table of decisions' weights, at most.
MOST_ROWS, MOST_BUCKETS, MOST_BITS = 8192, 256, 19
#: Rounds of training; rate, smoothing and bound of the weights of classes and of decisions.
ROUNDS, RATE, RARE, BOUND, WORD_RATE, WORD_RARE, WORD_BOUND = 3, 0.4, 4.0, 10.0, 0.5, 4.0, 5.0
#: Tokens that a task works on at a time: their arrays stay in a core's cache.
BATCH = 16_384
#: Rows of weights whose sums travel together, and tasks that send sums at most (else two for each core).
BLOCK, MOST_TASKS = 256, 16_384
#: Bytes of text whose words are coded, and counted, at a time.
CHUNK, COUNTED = 1_200_000, 6_000_000


def ending(word: bytes) -> bytes:
    """The last bytes of a word without closing ASCII punctuation."""
    return (word.rstrip(b".,;:!?)\"'") or word)[-ENDING:]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts one after the other, A-Z lower-cased, and how many each text has. Arrow's ASCII functions look
    at bytes alone; they give empty words at the ends of a text, which are none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, size = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        size = np.bincount(np.repeat(np.arange(len(size)), size)[full], minlength=len(size))
        words = words.filter(pa.array(full))
    return words, size


def slices(texts: pa.Array, limit: int = CHUNK):
    """Ranges of texts of about ``limit`` bytes together."""
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield lo, hi


def power(x: float, least: int, most: int) -> int:
    """The least power of two from ``x`` on, between bounds that are powers of two."""
    return min(max(1 << max(int(np.ceil(np.log2(max(x, 1)))), 0), least), most)


class Coder:
    """A word's class, its row in the table of word features, and its leaf, as one number.

    Leaves are the places of head words, then ``buckets`` of other words for each class but the first. Numbers of head
    words are kept, so their memory is bounded and few words need more than a look-up.
    """

    def __init__(self, endings: list[bytes], head: list[bytes], rows: int = WORD_ROWS, buckets: int = 1):
        self.endings = {e: i + 2 for i, e in enumerate(endings)}
        self.rows, self.buckets, self.first = rows, buckets, len(head)
        self.head, self.numbers = pa.array(head, pa.binary()), np.append(self.codes(head, np.arange(len(head))), 0)

    def codes(self, words: list[bytes], leaf: np.ndarray | None = None) -> np.ndarray:
        """Numbers of many words, by default of words outside the head."""
        cls = np.fromiter(map(self.endings.get, map(ending, words), repeat(1)), np.int64, len(words))
        h = np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words))
        if leaf is None:
            leaf = self.first + (cls - 1) * self.buckets + (h >> 20) % self.buckets
        return (cls << 48) | ((h % self.rows) << 32) | (leaf + 1)

    def __call__(self, texts: pa.Array):
        """For all tokens, ends included: class, word row, leaf (-1: end); and where each text begins. Words also as an array."""
        words, size = split(texts)
        place = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy()
        own, away = self.numbers[place], np.flatnonzero(place < 0)
        own[away] = self.codes(words.take(pa.array(away)).to_pylist())
        starts = np.append(0, np.cumsum(size + 1))
        code = np.zeros(starts[-1], np.int64)  # zero: the end, of class 0
        code[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = own
        return code >> 48, (code >> 32) & 0xFFFF, (code & 0xFFFFFFFF) - 1, starts, words


def backs(starts: np.ndarray):
    """A function that shifts a column of tokens by ``d`` places, with zeros before each text."""
    n = int(starts[-1])
    depth = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))

    def back(x: np.ndarray, d: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[d:] = x[: n - d] if n > d else x[:0]
        out[depth < d] = 0
        return out

    return back


def features(cls: np.ndarray, row: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each token's rows in the four tables. Before a text there are only end tokens."""
    back = backs(starts)
    c = [back(cls, d) for d in (1, 2, 3, 4)]
    return [back(row, 1), back(row, 2), (c[0] * CLASSES + c[1]) % CLASS_ROWS, (c[2] * CLASSES + c[3]) % CLASS_ROWS]


class Model:
    def __init__(self, bias: np.ndarray, tables: list[np.ndarray]):
        self.bias, self.tables = bias, tables

    @classmethod
    def start(cls, bias: np.ndarray, rows: int = WORD_ROWS) -> Model:
        return cls(bias.astype(np.float32), [np.zeros((n, CLASSES), np.float32) for n in (rows, rows, *FEATURES[2:])])

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        y = self.tables[0].take(rows[0], axis=0)
        for t, r in zip(self.tables[1:], rows[1:], strict=True):
            y += t.take(r, axis=0)
        y += self.bias
        return y

    def log_p(self, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Logarithms of the targets' probabilities. Weights are bounded, so no exponential overflows."""
        y = self.logits(rows)
        own = y[np.arange(len(y)), target]
        return own - np.log(np.exp(y, out=y) @ np.ones(CLASSES, np.float32))

    def seen(self, rows: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
        """How often each class came with each feature row."""
        return [np.bincount(r * CLASSES + target, minlength=t.size).reshape(t.shape) for t, r in zip(self.tables, rows, strict=True)]

    def expect(self, rows: list[np.ndarray], into: list[np.ndarray]) -> None:
        """Adds the probabilities of all classes, by feature row; class after class, so columns of ``into`` should be contiguous."""
        y = self.logits(rows)
        np.exp(y, out=y)
        y /= (y @ np.ones(CLASSES, np.float32))[:, None]
        for k, p in enumerate(y.T.astype(np.float64, order="C")):
            for r, total in zip(rows, into, strict=True):
                total[:, k] += np.bincount(r, p, len(total))


class Tree:
    """Huffman trees of all classes: for each leaf the decisions on its way and the sides taken, for each decision its odds."""

    def __init__(self, cls: np.ndarray, mass: np.ndarray):
        n = len(cls)
        parent, side, weight = [-1] * n, [0] * n, mass.tolist()
        for k in range(1, CLASSES):
            agenda = [(weight[i], i) for i in np.flatnonzero(cls == k).tolist()]
            heapq.heapify(agenda)
            while len(agenda) > 1:
                a, b = heapq.heappop(agenda), heapq.heappop(agenda)
                parent[a[1]] = parent[b[1]] = len(parent)
                side[b[1]] = 1
                heapq.heappush(agenda, (a[0] + b[0], len(parent)))
                parent.append(-1)
                side.append(0)
                weight.append(a[0] + b[0])
        up, side, weight = np.array(parent, np.int64), np.array(side, np.int8), np.array(weight, np.float64)
        odds = np.zeros(len(up) - n)
        child = np.flatnonzero(up >= 0)
        np.add.at(odds, up[child] - n, np.where(side[child] == 1, 1, -1) * np.log(weight[child]))
        self.odds = odds.astype(np.float32)
        at, who, ways = np.arange(n), np.arange(n), []
        while len(at):
            on = up[at] >= 0
            at, who = at[on], who[on]
            ways.append((who, up[at] - n, side[at]))
            at = up[at]
        who, node, taken = (np.concatenate([w[i] for w in ways]) if ways else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(who, kind="stable")
        self.node, self.side = node[order].astype(np.int32), taken[order].astype(np.int8)
        self.start = np.append(0, np.cumsum(np.bincount(who, minlength=n))).astype(np.int64)


class Choice:
    """The factor of a word inside its class: a logistic model of each decision over hashed features of the history."""

    def __init__(self, tree: Tree, weights: np.ndarray):
        self.tree, self.weights = tree, weights
        self.shift = np.uint32(32 - (len(weights).bit_length() - 1))
        names = mix(np.arange(1, len(tree.odds) + 1, dtype=np.uint64)).astype(np.uint32)
        # Of each decision on each leaf's way: its name, odds and the side not taken (1, -1). The last leaf stands for ends
        # (-1), which have none. Weights are bounded, so no exponential of odds overflows.
        self.name, self.odds, self.other = names[tree.node], tree.odds[tree.node], 1 - 2 * tree.side.astype(np.float32)
        self.first, self.size = np.append(tree.start[:-1], 0), np.append(np.diff(tree.start), 0)

    @staticmethod
    def history(leaf: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Each token's features, the last word and the word before it, as 32-bit hashes."""
        back = backs(starts)
        return [mix(back(leaf + 1, d).astype(np.uint64) * np.uint64(4) + np.uint64(d)).astype(np.uint32) for d in (1, 2)]

    def decisions(self, history: list[np.ndarray], leaf: np.ndarray):
        """Of all tokens one after the other: how many each token has, the side not taken (1, -1), the weights' places, the log odds of side 1."""
        size = self.size[leaf]
        at = np.repeat(self.first[leaf] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        name, z, places = self.name.take(at), self.odds.take(at), []
        for h in history:
            place = np.repeat(h, size)
            place ^= name
            place *= np.uint32(0x9E3779B1)
            place >>= self.shift
            places.append(place.astype(np.intp))
            z += self.weights.take(places[-1])
        return size, self.other.take(at), places, z

    def log_p(self, history: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
        size, other, _, z = self.decisions(history, leaf)
        z *= other
        np.exp(z, out=z)
        z += 1
        np.log(z, out=z)
        out, some = np.zeros(len(leaf)), np.flatnonzero(size)
        out[some] = -np.add.reduceat(z, (np.cumsum(size) - size)[some])
        return out

    def sums(self, history: list[np.ndarray], leaf: np.ndarray, met: np.ndarray, expected: np.ndarray) -> None:
        """Adds, for each weight, how often its feature met side -1 and side 1 (a pair of ``met``), and how often side 1 was expected."""
        _, other, places, z = self.decisions(history, leaf)
        one = other < 0
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        p = np.divide(1, z, dtype=np.float64)
        for place in places:
            np.add.at(expected, place, p)
            place *= 2
            place += one
            np.add.at(met, place, 1)


def counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts; the end token is the empty word."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts, COUNTED):
                found = pc.value_counts(split(texts[lo:hi])[0])
                word, n = (pa.concat_arrays([found.field(k), pa.array([x], found.field(k).type)]) for k, x in ((0, b""), (1, hi - lo)))
                yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(giving_back(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def updated(docs: DataFrame, parts, bias: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """One round: the weights ``tables`` after a gradient update over all of ``docs``.

    ``parts`` broadcasts what makes a coder, and the tree. The last table holds the decisions' weights. The sums that
    travel are as large as the model, for each task; at most ``MOST_TASKS`` tasks send any. A block of the model is summed
    by about the square root of the tasks' number of reducers first, and those sums by one.
    """
    spark = docs.sparkSession
    before = spark.sparkContext.broadcast(tables)
    names = ["t", "b", "data"]

    def rows(t: int, b: int, data: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names=names)

    def summed(batches):
        mark, coder_parts, tree = parts.value
        code, own = kept("scoring", mark, lambda: Coder(*coder_parts)), before.value
        model, choice = Model(bias.astype(np.float32), own[:-1]), Choice(tree, own[-1].reshape(-1))
        fresh = not any(t.any() for t in own[:-1])  # then all expect what the bias says
        seen, expected = ([np.zeros(t.shape, order=o) for t in own[:-1]] for o in "CF")
        met, decided, tokens = np.zeros(2 * own[-1].size, np.int64), np.zeros(own[-1].size), 0
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(texts):
                cls, row, leaf, starts, _ = code(texts[lo:hi])
                own_rows, history = features(cls, row, starts), choice.history(leaf, starts)
                for total, more in zip(seen, model.seen(own_rows, cls), strict=True):
                    total += more
                for a in range(0, len(cls), BATCH):
                    if not fresh:
                        model.expect([r[a : a + BATCH] for r in own_rows], expected)
                    choice.sums([h[a : a + BATCH] for h in history], leaf[a : a + BATCH], met, decided)
                tokens += len(cls)
        if not tokens:
            return
        if fresh:
            p = np.exp(bias) / np.exp(bias).sum()
            expected = [x.sum(1, keepdims=True) * p for x in seen]
        decided = np.stack([met[1::2], decided, met[::2] + met[1::2]])
        wide = [*(np.stack(x) for x in zip(seen, expected, strict=True)), decided.reshape(3, -1, CLASSES)]
        for t, table in enumerate(wide):
            for b in range(0, table.shape[1], BLOCK):
                yield rows(t, b, table[:, b : b + BLOCK])

    def total(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for t, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(data, np.float32).astype(np.float64)
                held[t, b] = held[t, b] + more if (t, b) in held else more
        for (t, b), data in held.items():
            yield rows(t, b, data)

    schema = "t int, b int, data binary"
    tasks = min(MOST_TASKS, 2 * spark.sparkContext.defaultParallelism)
    local = docs.select(F.col("text").cast("string")).coalesce(tasks).mapInArrow(giving_back(summed), schema)
    # Each task of ``total`` holds the running sums of its blocks, not their rows; the model is of a bounded size.
    dealt = local.withColumn("some", F.spark_partition_id() % math.isqrt(tasks)).repartition(F.col("t"), F.col("b"), F.col("some"))
    some = dealt.drop("some").mapInArrow(total, schema)
    blocks = some.repartition(F.col("t"), F.col("b")).mapInArrow(total, schema).toArrow()
    before.destroy()
    tables = [t.copy() for t in tables]
    for t, b, data in zip(*(blocks.column(c).to_pylist() for c in names), strict=True):
        last = t == len(tables) - 1
        x = np.frombuffer(data, np.float32).reshape(3 if last else 2, -1, CLASSES)
        own = tables[t][b : b + x.shape[1]]
        if last:
            one, expected, n = x
            own += WORD_RATE * (np.log((one + WORD_RARE) / (expected + WORD_RARE)) - np.log((n - one + WORD_RARE) / (n - expected + WORD_RARE)))
            np.clip(own, -WORD_BOUND, WORD_BOUND, out=own)
        else:
            own += RATE * np.log((x[0] + RARE) / (x[1] + RARE))
            np.clip(own, -BOUND, BOUND, out=own)
    return tables


def score_documents(docs: DataFrame, training, whole: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), scored by a model of those for which ``training`` (a column) holds.

    With ``whole`` each round of training goes over all rows, else over its share of them.

    Columns: doc_id, n_tokens, n_known, train_tokens, base_score, score. Null texts are empty and have the end token;
    rows with a null condition are not trained on; equal rows get equal scores; with no training rows all words are
    unknown and the classes equally likely; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(training, F.lit(False)).alias("train"))
    learn = slim.filter("train").select("text")
    c = materialize(counts(learn), "counts")
    n_all, v_all = c.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    def by_ending(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ending(w) if w else b"" for w in b.column(0).to_pylist()], pa.binary()), b.column(1)], names=["e", "n"])

    ends = materialize(c.mapInArrow(by_ending, "e binary, n long").groupBy("e").agg(F.sum("n").alias("n"), F.count("*").alias("v")), "endings")
    top = [bytes(r["e"]) for r in ends.filter("length(e) > 0").orderBy(F.desc("n"), "e").limit(CLASSES - 2).collect()]
    which = {e: i + 2 for i, e in enumerate(top)}
    size_n, size_v = np.zeros(CLASSES), np.zeros(CLASSES)
    chosen = ends.filter(F.col("e").isin(top) | (F.length("e") == 0))
    for r in chosen.collect():  # at most CLASSES rows
        k = which.get(bytes(r["e"]), 0)
        size_n[k], size_v[k] = r["n"], r["v"]
    size_n[1], size_v[1] = n_all - size_n.sum(), v_all - size_v.sum()
    # The head: words above a count that leaves about HEAD of them, 2 * HEAD at most; no task or partition sends more.
    cut = 0
    if v_all > HEAD:
        cut = c.agg(F.percentile_approx("n", F.lit(1.0 - HEAD / v_all), F.lit(10_000))).first()[0]
        while c.filter(F.col("n") > cut).count() > 2 * HEAD:
            cut *= 2
    head_rows = sorted(((bytes(r["word"]), r["n"]) for r in c.filter((F.length("word") > 0) & (F.col("n") > cut)).collect()), key=lambda x: (-x[1], x[0]))
    head, head_n = [w for w, _ in head_rows], np.array([n for _, n in head_rows], np.int64)
    bias = np.log((size_n + 1) / (size_n + 1).sum())
    coder_parts = (top, head, power(v_all / 256, WORD_ROWS, MOST_ROWS), power(v_all / (256 * CLASSES), 1, MOST_BUCKETS))
    n_rows, n_buckets = coder_parts[2:]

    def by_bucket(batches):
        code = Coder(top, [], n_rows, n_buckets)
        for b in batches:
            leaf = (code.codes(b.column(0).to_pylist()) & 0xFFFFFFFF) - 1
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column(1)], names=["leaf", "n"])

    rare = np.ones((CLASSES - 1) * n_buckets)
    tail = c.filter((F.length("word") > 0) & (F.col("n") <= cut)).mapInArrow(by_bucket, "leaf int, n long")
    for r in tail.groupBy("leaf").agg((F.sum("n") + F.count("*")).alias("mass")).collect():  # a row for each bucket at most
        rare[r["leaf"]] += r["mass"]
    head_cls = np.array([which.get(ending(w), 1) for w in head], np.int64)
    tree = Tree(np.concatenate([head_cls, np.repeat(np.arange(1, CLASSES), n_buckets)]), np.concatenate([head_n + 1.0, rare]))
    parts = spark.sparkContext.broadcast((uuid.uuid4().hex, coder_parts, tree))
    decisions = np.zeros((power(8 * v_all, 1 << 14, 1 << MOST_BITS) // CLASSES, CLASSES), np.float32)
    tables = [*Model.start(bias, n_rows).tables, decisions]
    for i in range(ROUNDS):
        share = learn if whole else learn.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == i)
        tables = updated(share, parts, bias, tables)
    weights = spark.sparkContext.broadcast(tables)

    base_norm = np.log10(float(n_all + v_all + 1))
    log_rare = np.log10(rare)
    end_n = size_n[0]

    def base_parts(batches):
        """A row for each text with what is known at once, and its words outside the head, with counts and classes."""
        mark, own_parts, tree_ = parts.value
        code, m = kept("scoring", mark, lambda: Coder(*own_parts)), Model(bias.astype(np.float32), weights.value[:-1])
        choice = Choice(tree_, weights.value[-1].reshape(-1))
        log_head = np.append(np.log10(head_n + 1.0), np.log10(end_n + 1.0))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                cls, row, leaf, starts, words = code(texts[lo:hi])
                rows, history = features(cls, row, starts), choice.history(leaf, starts)
                lp = np.empty(len(cls))
                for a in range(0, len(cls), BATCH):
                    lp[a : a + BATCH] = m.log_p([r[a : a + BATCH] for r in rows], cls[a : a + BATCH])
                    lp[a : a + BATCH] += choice.log_p([h[a : a + BATCH] for h in history], leaf[a : a + BATCH])
                place = np.where(leaf < len(head_n), leaf, -1)
                shared = np.where(leaf < len(head_n), 0.0, log_rare[np.maximum(leaf - len(head_n), 0)])
                last = starts[1:] - 1
                place[last] = len(head_n)
                known = place >= 0
                word = np.where(known, log_head[place], 0.0)
                sums = [np.add.reduceat(x, starts[:-1]) for x in (lp / np.log(10), word, shared, known.astype(np.int64))]
                n = np.diff(starts)
                known_n = sums[3] - (end_n == 0)
                away = np.flatnonzero(~known)
                owner = np.searchsorted(starts, away, "right") - 1  # each text before has an end more than words
                upto = np.append(0, np.cumsum(np.bincount(owner, minlength=hi - lo)))
                other = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.take(pa.array(away - owner)))
                yield pa.RecordBatch.from_arrays(
                    [ids[lo:hi], pa.array(n, pa.int64()), pa.array(known_n, pa.int64()), pa.array(sums[1] - n * base_norm), pa.array(sums[0] - sums[2]), other],
                    names=["doc_id", "n_tokens", "n_known", "base", "own", "other"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base double, own double, other array<binary>"
    # The row number stands for the row while its words are away; it is written once and read twice.
    scored = slim.select("doc_id", "text").mapInArrow(giving_back(base_parts), schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    parts.destroy()
    weights.destroy()
    words = scored.select("row", F.explode("other").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
    met = words.join(c.filter(F.col("n") <= cut), "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("gain"))
    out = scored.drop("other").join(met, "row", "left")
    gain, more = F.coalesce("gain", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("own") + gain).alias("score"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_documents(docs, id_crc() % 7 != 2)
    return out.withColumn("held_out", F.coalesce(id_crc() % 7 == 2, F.lit(False)))


QUERIES = {"op2_lm_scoring": op2_lm_scoring}
