"""Language identification (operator 4): prediction by partial matching over bytes.

A text is coded word by word. A word's bytes, with a space before and after, are coded one after the other; the context
of a byte is the up to ``ORDER`` bytes before it in the word (the leading space included). Each language has a context
tree with the counts of the bytes that followed each context in its training words (each word as often as it
occurs). The code length under frozen statistics is PPM's, with escape method C: in the longest known context a byte
that followed it n times costs -log2(n / (total + distinct)), any other costs an escape of -log2(distinct / (total +
distinct)) and is looked for in the next shorter context, down to a uniform one over 256 bytes. There is no exclusion, so
a byte's cost depends on its context alone, and a word's cost on the word: costs are cached by word and summed.

The trees are fitted on a bounded sample: at most about ``SAMPLE`` labelled documents of each language (``EQUAL`` times as
many of all), chosen by hash among all those outside the held-out fold. Prediction reads all words of all texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import CACHE_BYTES, CACHE_WORDS, as_bytes, drop_others, giving_back, id_crc, kept

ORDER = 4
#: Labelled documents of each language that the trees are fitted on, about; with more than ``EQUAL`` languages, in proportion fewer.
SAMPLE, EQUAL = 2500, 8
#: Costs (a number for each language) that a worker keeps, and that it works on at a time.
HELD, AT_ONCE = 4_000_000, 500_000
#: Bytes of text that are coded at a time, and bytes whose contexts are counted at a time.
CHUNK_BYTES, COUNT_BYTES = 1_000_000, 200_000
#: A stage rejects texts without letters and those that no language codes in this many bits a byte.
REJECT_BITS = 7.0
#: Fixed values of the hash of a context: an odd multiplier.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


WHITE = re.compile(rb"[\x20\x09-\x0D]")


def slices(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """The column in runs of rows of at most ``limit`` bytes together; a row beyond that is a run of its own."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi


def parts(texts: list[bytes | None], limit: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Words of about ``limit`` bytes of text at a time, with the numbers of the texts that they come from.

    A long text comes in several parts, cut at white space, so it need not be split into words at once.
    """
    owners, words, size = [], [], 0
    for i, text in enumerate(texts):
        lo, end = 0, len(text or b"")
        while lo < end:
            cut = WHITE.search(text, lo + limit - size) if end - lo > limit - size else None
            hi = cut.start() if cut else end
            owners.append(i)
            words.append(text[lo:hi].split())
            size, lo = size + hi - lo, hi
            if size >= limit:
                yield owners, words
                owners, words, size = [], [], 0
    if owners:
        yield owners, words


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ' word ' for all words in a row; for each word where it begins (one more entry than words)."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return data, np.concatenate([[0], np.cumsum(sizes)])


def places(starts: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All coded bytes (those of the words and the space that closes each), ``step`` at a time: where they are, the number
    of their word and their depth in it."""
    for lo in range(1, int(starts[-1]) + 1, step):
        at = np.arange(lo, min(lo + step, int(starts[-1]) + 1))
        word = np.searchsorted(starts, at) - 1
        yield at, word, at - starts[word]


def added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def context_counts(texts: list[bytes | None], order: int, limit: int = COUNT_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Keys of contexts and the bytes after them in the texts' words, and how often they come. Besides the result, the
    memory that it takes depends on ``limit``, not on the texts."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, words in parts(texts, limit):
        data, starts = padded([w for own in words for w in own])
        for at, _, depth in places(starts, limit):
            found = [(key, n)]
            for o in range(order + 1):
                use = at[depth >= o]
                found.append(np.unique((context_keys(data, use, o) << np.uint64(8)) | data[use], return_counts=True))
            key, n = added(*map(np.concatenate, zip(*found)))
    return key, n


def context_keys(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Keys of the ``order`` bytes before each position in ``at``: exact for up to 7 bytes (the bytes and the order)."""
    key = np.full(len(at), order, np.uint64)
    for j in range(order, 0, -1):
        key = (key << np.uint64(8)) | data[at - j]
    return key


class Table:
    """An open-addressing table from 64-bit keys to row numbers, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.rows[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            win = left[first][free[first]]
            self.keys[slot[win]], self.rows[slot[win]] = keys[win], win
            left = np.setdiff1d(left, win, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        rows = self.rows[slot]
        out = np.where((rows >= 0) & (self.keys[slot] == keys), rows, -1)
        left = np.flatnonzero((rows >= 0) & (out < 0))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            rows = self.rows[slot]
            hit = self.keys[slot] == keys[left]
            out[left[(rows >= 0) & hit]] = rows[(rows >= 0) & hit]
            stay = (rows >= 0) & ~hit
            left, slot = left[stay], slot[stay]
        return out


class Trees:
    """Frozen context trees of all languages. Costs in bits by word, one for each language."""

    def __init__(self, languages: list[str], order: int, keys: np.ndarray, cost: np.ndarray, contexts: np.ndarray, escape: np.ndarray):
        self.languages, self.order = languages, order
        # Bytes after contexts (key: context and byte) and contexts; costs are NaN where a language has not seen one.
        self.cost, self.escape = cost, escape
        self.symbols, self.contexts = Table(keys), Table(contexts)
        self.fresh()

    def fresh(self) -> None:
        """An empty cache of word costs."""
        self.room = min(CACHE_WORDS, HELD // max(1, len(self.languages)))
        self.known, self.held = Known(), np.zeros((self.room, len(self.languages)), np.float32)

    @classmethod
    def fit(cls, lang: np.ndarray, key: np.ndarray, n: np.ndarray, languages: list[str], order: int) -> Trees:
        """Counts: of each language, key of context and byte, how often."""
        key = key.astype(np.int64).view(np.uint64)
        keys, row = np.unique(key, return_inverse=True)
        table = np.zeros((len(keys), len(languages)))
        table[row, lang] = n
        contexts, parent = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, parent, table)
        np.add.at(distinct, parent, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = -np.log2(table / (total + distinct)[parent])
            escape = -np.log2(distinct / (total + distinct))
        cost[table == 0] = np.nan
        escape[total == 0] = np.nan
        return cls(languages, order, keys, cost.astype(np.float32), contexts, escape.astype(np.float32))

    def cost_of(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word in each language."""
        data, starts = padded(words)
        out = np.zeros((len(words), len(self.languages)))
        for at, word, depth in places(starts, max(1, AT_ONCE // max(1, len(self.languages)))):
            bits, lo = self.bits_at(data, depth, at), word[0]
            for k in range(len(self.languages)):
                sums = np.bincount(word - lo, bits[:, k])
                out[lo : lo + len(sums), k] += sums
        return out

    def bits_at(self, data: np.ndarray, depth: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the bytes at ``at``, each after the bytes before it, in each language."""
        bits = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.ones(bits.shape, bool)
        for order in range(self.order, -1, -1):
            use = np.flatnonzero((depth >= order) & open_.any(1))
            if not len(use):
                continue
            context = context_keys(data, at[use], order)
            row = self.symbols.find((context << np.uint64(8)) | data[at[use]])
            c = np.where(row[:, None] >= 0, self.cost[row] if len(self.cost) else np.nan, np.nan)
            up = self.contexts.find(context)
            e = np.where(up[:, None] >= 0, self.escape[up] if len(self.escape) else np.nan, np.nan)
            todo, known = open_[use], ~np.isnan(c)
            bits[use] += np.where(todo & known, c, np.where(todo & ~np.isnan(e), e, 0))
            open_[use] = todo & ~known
        return bits + np.where(open_, np.float32(8), np.float32(0))

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and its bytes with one white space after each word."""
        bits, size = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owners, words in parts(texts, CHUNK_BYTES):
            flat = []
            for i, own in zip(owners, words):
                size[i] += sum(map(len, own)) + len(own)
                flat.append(np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)))
            rows, ends = np.concatenate(flat), list(map(len, words))
            cost = np.empty((len(rows), len(self.languages)), np.float32)
            old = rows < CACHE_WORDS
            cost[old] = self.held[rows[old]]
            cost[~old] = self.settle()[rows[~old] - CACHE_WORDS]
            at, lo = np.repeat(owners, ends) - owners[0], owners[0]
            for k in range(len(self.languages)):
                sums = np.bincount(at, cost[:, k])
                bits[lo : lo + len(sums), k] += sums
        return bits, size

    def settle(self) -> np.ndarray:
        """Costs of the words that ``known`` met for the first time; as many as fit join the cache."""
        new = list(self.known.new)
        self.known.new = {}
        cost = self.cost_of(new).astype(np.float32) if new else np.zeros((0, len(self.languages)), np.float32)
        at = len(self.known)
        short = [j for j, w in enumerate(new) if len(w) <= CACHE_BYTES][: self.room - at]
        for i, j in enumerate(short):
            self.known[new[j]] = at + i
        self.held[at : at + len(short)] = cost[short]
        return cost


class Known(dict):
    """Rows of cached words; other words get numbers from ``CACHE_WORDS`` on until they are settled."""

    def __init__(self):
        super().__init__()
        self.new: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        return self.new.setdefault(word, CACHE_WORDS + len(self.new))


def fit(labelled: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Trees:
    """Trees from ``labelled`` (doc_id, text, lang): every row may be drawn, at most about ``sample`` of a language are.

    Rows with a null text or lang teach nothing. The sample bounds what reaches the driver.
    """
    rows = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count()
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())  # the model has a column for each
    sample = min(sample, EQUAL * sample // max(1, len(languages)) + 1)
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")).alias("share"))
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    index = {x: i for i, x in enumerate(languages)}

    def count(batches):
        drop_others("language fit")
        for batch in batches:
            for language in set(batch.column(1).to_pylist()):
                own, key, n = batch.column(0).filter(pc.equal(batch.column(1), language)), np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for piece in slices(own, CHUNK_BYTES):
                    key, n = added(*map(np.concatenate, zip((key, n), context_counts(as_bytes(piece), order))))
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), index[language]), pa.int32()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "key", "n"])

    counted = drawn.select("text", "lang").mapInArrow(giving_back(count), "lang int, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # bounded: the sample's contexts
    return Trees.fit(*[table.column(c).to_numpy() for c in ("lang", "key", "n")], languages, order)


LETTER = r"\p{L}"


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the winner's share of the languages' likelihoods a byte, 0 to 1) and
    ``bits_per_byte`` (of the winner).

    A text that is null or has no letter is ``und`` with score 0; ties go to the first language by name; every row
    stays, repeated ones too, with its other columns; result columns that clash are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((trees.languages, trees.order, trees.symbols, trees.cost, trees.contexts, trees.escape))
    names, mark = trees.languages, uuid.uuid4().hex

    def own() -> Trees:
        t = Trees.__new__(Trees)
        t.languages, t.order, t.symbols, t.cost, t.contexts, t.escape = shared.value
        t.fresh()
        return t

    def coded(batches):
        for batch in batches:
            if not names:
                yield struct(["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch)))
                continue
            found = [kept("language", mark, own).texts(as_bytes(piece)) for piece in slices(batch, CHUNK_BYTES)]
            bits, size = map(np.concatenate, zip((np.zeros((0, len(names))), np.zeros(0, np.int64)), *found))
            top = bits.argmin(1)
            # Likelihoods of the whole text differ by hundreds of bits; by the square root of its length they stay apart from 0 and 1.
            scaled = -(bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None]
            odds = np.exp2(scaled)
            yield struct(np.array(names, object)[top], odds.max(1) / odds.sum(1), bits.min(1) / np.maximum(size, 1))

    @F.arrow_udf("lang string, score double, bits double")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(coded)(batches)

    def struct(*columns) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["lang", "score", "bits"])

    t, found = F.col(f"`{text}`"), f"_best_{mark}"
    has = F.coalesce(t.rlike(LETTER), F.lit(False))
    # Not deterministic to the optimiser, which else runs it once for a filter and once for the columns.
    out = docs.withColumn(found, best.asNondeterministic()(t))
    learned = has if names else F.lit(False)
    return out.withColumns({
        "lang_pred": F.when(learned, F.col(f"{found}.lang")).otherwise("und"),
        "score": F.when(learned, F.col(f"{found}.score")).otherwise(0.0),
        "bits_per_byte": F.when(learned, F.col(f"{found}.bits")),
    }).drop(found)

def held_out():
    return F.coalesce(id_crc() % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    trees = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


QUERIES = {"op4_language_id": op4_language_id}
