"""SentencePiece encoding and decoding (operator 9): seeded merge-dropout.

A BPE model merges neighbouring symbols by an agenda: the best-scored merge first, the leftmost of equals. Here each
candidate merge (the places in its word where it begins, joins and ends) of each occurrence of a word is skipped for good
if a keyed hash of seed, variant, document, place of the word in the document, word and places falls under ``dropout``.
The same seed gives the same segmentation again; another seed, or another variant, gives another one.
With ``dropout`` 0 the ids are those of the sentencepiece library.

No piece holds a space after another character, so a text falls into words (spaces and what follows them) that are
encoded on their own. What is cached of a word is not a result of dropout but its agenda: the merges that are done
if a given set of candidates is skipped, the empty set first. An occurrence draws the merges of its agenda; if it skips
some, it goes on with the agenda of the set with these added, until it skips none. An agenda is made where two
occurrences of a batch want it; an occurrence that is alone draws its candidates while it merges, which gives the same.
Both are done for all words of a batch together in numpy, one merge of each word at a time;
words over ``LONG`` characters go through a heap, in n log n. Characters without a piece become byte pieces, and so
does the character that stands for a space in pieces; decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import kept, mix
from causeway.llm.language import Table

SPACE = "▁"
#: Characters of a word that goes through a heap; the merges of shorter ones fit into a mask of ``BITS`` bits.
LONG, BITS = 40, 40
WORD = re.compile(" +[^ ]*")
CACHE = 120_000
CHUNK_CHARS = 1_500_000


class Vocabulary:
    def __init__(self, model: str):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=model)
        n = s.vocab_size()
        names = [s.id_to_piece(i) for i in range(n)]
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if s.is_byte(i)}
        plain = {names[i]: i for i in range(n) if not (s.is_byte(i) or s.is_control(i) or s.is_unknown(i) or s.is_unused(i))}
        self.data = [bytes([int(x[3:5], 16)]) if s.is_byte(i) else b"" if s.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.char = np.full(0x110000, -1, np.int64)
        for name, i in plain.items():
            if len(name) == 1 and name != SPACE:
                self.char[ord(name)] = i
        self.char[0x20] = plain[SPACE]
        # Priorities: equal scores are equal, so that the leftmost goes first.
        scores = {i: s.get_score(i) for i in plain.values()}
        order = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.priority = np.zeros(n, np.int64)
        self.priority[list(scores)] = [order[x] for x in scores.values()]
        pairs = {}
        for name, i in plain.items():
            for cut in range(1, len(name)):
                left, right = plain.get(name[:cut]), plain.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        keys = np.array(list(pairs), np.uint64)
        self.pairs, self.table, self.merged = pairs, Table(keys), np.array(list(pairs.values()), np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        row = self.table.find((np.maximum(left, 0).astype(np.uint64) << np.uint64(20)) | np.maximum(right, 0).astype(np.uint64))
        return np.where((row >= 0) & (left >= 0) & (right >= 0), self.merged[row], -1)


def skipped(word: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash skips the merge of [a, b) and [b, c) in a word."""
    places = (a.astype(np.uint64) << np.uint64(42)) ^ (b.astype(np.uint64) << np.uint64(21)) ^ c.astype(np.uint64)
    return (mix(word ^ mix(places + np.uint64(1))) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def keyed(word: str, key: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=key & ((1 << 64) - 1))


def by_heap(v: Vocabulary, word: str, key: int, dropout: float) -> list[int]:
    """Symbols of one word (piece ids; -1 - place for a character without one), by a heap as the agenda."""
    sym = v.char[[ord(x) for x in word]].tolist()
    n = len(sym)
    start, end, left, right = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    hashed, agenda = np.array([keyed(word, key)], np.uint64), []

    def offer(i: int) -> None:
        j = right[i]
        made = v.pairs.get(sym[i] << 20 | sym[j]) if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 else None
        if made is not None and not (dropout and skipped(hashed, np.array([start[i]]), np.array([end[i]]), np.array([end[j]]), dropout)[0]):
            heapq.heappush(agenda, (int(v.priority[made]), start[i], i, j, end[i], end[j], made))

    for i in range(n - 1):
        offer(i)
    while agenda:
        _, a, i, j, b, c, made = heapq.heappop(agenda)
        if start[i] != a or end[i] != b or right[i] != j or end[j] != c or sym[i] is None or sym[j] is None:
            continue  # one side has been merged since
        sym[i], end[i], right[i] = made, c, right[j]
        sym[j] = None
        if right[j] >= 0:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s if s >= 0 else -1 - start[i] for i, s in enumerate(sym) if s is not None]


def with_bytes(v: Vocabulary, word: str, symbols: list[int]) -> bytes:
    ids = []
    for s in symbols:
        ids.extend([s] if s >= 0 else [v.byte[b] for b in word[-1 - s].encode()])
    return np.array(ids, "<u4").tobytes()


def together(v: Vocabulary, words: list[str], key: int, dropout: float) -> list[bytes]:
    """Ids of many short words at once, as little-endian 32-bit bytes."""
    hashed = np.fromiter((keyed(w, key) for w in words), np.uint64, len(words))
    return agendas(v, words, lambda k, a, b, c: skipped(hashed[k], a, b, c, dropout) if dropout else np.zeros(len(k), bool))[0]


def agendas(v: Vocabulary, words: list[str], skip) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids of many short words, and the merges done: the word of each and its places. ``skip`` tells which merges may not be done."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    a = np.arange(len(code)) - first[owner]
    sym, b = v.char[code], a + 1
    sym = np.where(sym < 0, -1 - a, sym)
    done, ways = [], [(np.zeros(0, np.int64),) * 2]

    def candidates(i: np.ndarray) -> np.ndarray:
        """The piece that symbols i and i + 1 make, or -1."""
        made = np.full(len(i), -1, np.int64)
        use = np.flatnonzero(i + 1 < len(sym))
        use = use[owner[i[use]] == owner[i[use] + 1]]
        made[use] = v.merge(sym[i[use]], sym[i[use] + 1])
        use = np.flatnonzero(made >= 0)
        k = i[use]
        made[use[skip(owner[k], a[k], b[k], b[k + 1])]] = -1
        return made

    made = candidates(np.arange(len(sym)))
    while len(sym):
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        rank = np.where(made >= 0, (v.priority[made] << 32) | np.arange(len(sym)), np.iinfo(np.int64).max)
        best = np.minimum.reduceat(rank, heads)
        live = best < np.iinfo(np.int64).max
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(sym))))
        stay = live[group]
        if not stay.all():
            done.append((owner[~stay], sym[~stay]))
        at = best[live] & 0xFFFFFFFF
        ways.append((owner[at], a[at] << 12 | b[at] << 6 | b[at + 1]))
        sym[at], b[at] = made[at], b[at + 1]
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        at = place[at]
        sym, owner, a, b, made = sym[stay], owner[stay], a[stay], b[stay], made[stay]
        if len(sym):
            touched = np.zeros(len(sym), bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            again = np.flatnonzero(touched)
            made[again] = candidates(again)
    owner, sym = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
    order = np.argsort(owner, kind="stable")
    owner, sym = owner[order], sym[order]
    data = sym.astype("<u4").tobytes()
    ends = np.cumsum(np.bincount(owner, minlength=len(words)))
    odd = set(owner[sym < 0].tolist())
    out, lo = [], 0
    for i, hi in enumerate(ends.tolist()):
        out.append(with_bytes(v, words[i], sym[lo:hi].tolist()) if i in odd else data[4 * lo : 4 * hi])
        lo = hi
    who, way = (np.concatenate(x) for x in zip(*ways, strict=True))
    order = np.argsort(who, kind="stable")
    return out, who[order], way[order]


class Agendas:
    """Agendas by number: the word, the skipped candidates, the ids and the merges done. They only depend on word and skipped set."""

    def __init__(self, v: Vocabulary):
        self.v, self.number, self.word, self.skips, self.ids = v, {}, [], [], []
        #: The agenda that follows if some of an agenda's merges are skipped, by its number and a mask of these merges.
        self.next: dict[int, int] = {}
        self.ways, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def add(self, wanted: list[tuple[str, frozenset]]) -> None:
        new = [x for x in dict.fromkeys(wanted) if x not in self.number]
        if not new:
            return
        gone = np.sort(np.array([i << 18 | m for i, (_, s) in enumerate(new) for m in s] or [-1], np.int64))

        def skip(k, a, b, c):
            at = k << 18 | a << 12 | b << 6 | c
            return gone[np.minimum(np.searchsorted(gone, at), len(gone) - 1)] == at

        ids, who, way = agendas(self.v, [w for w, _ in new], skip)
        for x in new:
            self.number[x] = len(self.number)
            self.word.append(x[0])
            self.skips.append(x[1])
        self.ids.extend(ids)
        self.ways = np.concatenate([self.ways, way])
        self.start = np.append(self.start, self.start[-1] + np.cumsum(np.bincount(who, minlength=len(new))))


class Encoder:
    def __init__(self, model: str, dropout: float, seed: int, variant: int = 0):
        self.v, self.dropout, self.seed, self.variant = Vocabulary(model), dropout, seed, variant
        self.agendas = Agendas(self.v)

    def short(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of occurrences of words, each drawn by its own key."""
        if len(self.agendas.number) > CACHE:
            self.agendas = Agendas(self.v)
        g = self.agendas
        times = Counter(words)
        g.add([(w, frozenset()) for w, n in times.items() if n > 1])
        number = {w: g.number.get((w, frozenset()), -1) for w in times}
        now = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        alone = [np.flatnonzero(now < 0)]
        left = np.flatnonzero(now >= 0) if self.dropout else alone[0][:0]
        while len(left):
            own = now[left]
            size = g.start[own + 1] - g.start[own]
            who = np.repeat(np.arange(len(left)), size)
            way = g.ways[np.arange(len(who)) + np.repeat(g.start[own] - (np.cumsum(size) - size), size)]
            out = np.flatnonzero(skipped(keys[left[who]], way >> 12, way >> 6 & 63, way & 63, self.dropout))
            if not len(out):
                break
            bit = np.int64(1) << (out - np.repeat(np.cumsum(size) - size, size)[out])
            who = who[out]
            heads = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            keys_, at, times_ = np.unique(own[who[heads]] << BITS | np.bitwise_or.reduceat(bit, heads), return_inverse=True, return_counts=True)
            fresh, nxt = [k for k, n in zip(keys_.tolist(), times_.tolist(), strict=True) if n > 1 and k not in g.next], []
            for k in fresh:
                n, mask = k >> BITS, k & (1 << BITS) - 1
                merges = g.ways[g.start[n] : g.start[n + 1]].tolist()
                nxt.append((g.word[n], g.skips[n].union([m for j, m in enumerate(merges) if mask >> j & 1])))
            g.add(nxt)
            g.next.update(zip(fresh, map(g.number.__getitem__, nxt), strict=True))
            left = left[who[heads]]
            now[left] = np.fromiter((g.next.get(k, -1) for k in keys_.tolist()), np.int64, len(keys_))[at]
            alone.append(left[now[left] < 0])
            left = left[now[left] >= 0]
        made = list(map(g.ids.__getitem__, now.tolist())) if g.ids else [b""] * len(words)  # those alone are still to come
        places = np.concatenate(alone)
        if not len(places):
            return made
        drawn = keys[places]
        skip = lambda k, a, b, c: skipped(drawn[k], a, b, c, self.dropout) if self.dropout else np.zeros(len(k), bool)
        for i, ids in zip(places.tolist(), agendas(self.v, [words[i] for i in places.tolist()], skip)[0], strict=True):
            made[i] = ids
        return made

    def __call__(self, doc_ids: list, texts: list[str | None]) -> list[bytes]:
        words = [WORD.findall(" " + t) if t else [] for t in texts]
        flat = [w for x in words for w in x]
        ends = np.cumsum([len(x) for x in words], dtype=np.int64)
        doc = np.array([xxhash.xxh64_intdigest(str(d).encode(), seed=(self.seed * 1_000_003 + self.variant) & ((1 << 64) - 1)) for d in doc_ids], np.uint64)
        size = np.diff(np.append(0, ends))
        place = np.arange(len(flat)) - np.repeat(ends - size, size)
        keys = mix(np.repeat(doc, size) + mix(place.astype(np.uint64) + np.uint64(1)))
        long = np.fromiter(map(len, flat), np.int64, len(flat)) > LONG
        if not long.any():
            made = self.short(flat, keys)
        else:
            made, short = [b""] * len(flat), np.flatnonzero(~long)
            for i, x in zip(short.tolist(), self.short([flat[i] for i in short.tolist()], keys[short]), strict=True):
                made[i] = x
        for i in np.flatnonzero(long).tolist():
            made[i] = with_bytes(self.v, flat[i], by_heap(self.v, flat[i], int(keys[i]), self.dropout))
        return [b"".join(made[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.data.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


def encoder(*how) -> Encoder:
    """One for each worker."""
    return kept("pieces", how, lambda: Encoder(*how))


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def ranges(texts: list[str | None]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 7, variant: int = 0, model: str | None = None) -> DataFrame:
    """doc_id, ids for each row of ``docs`` (doc_id, text); null and empty texts have no ids. Equal rows give equal ids."""
    how = (model or model_file(), dropout, seed, variant)

    def run(batches):
        e = encoder(*how)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in ranges(texts):
                made = [np.frombuffer(x, "<i4") for x in e(ids[lo:hi], texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text for each row of ``encoded`` (doc_id, ids); null ids give a null text."""
    how = (model or model_file(), 0.0, 0, 0)

    def run(batches):
        e = encoder(*how)
        for batch in batches:
            texts = [None if x is None else e.decode(np.array(x, "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded with dropout and decoded: a digest of the ids, and of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    how = (model_file(), 0.1, 7, 0)

    def run(batches):
        e = encoder(*how)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in ranges(texts):
                made = e(doc_ids[lo:hi], texts[lo:hi])
                back = [e.decode(x) for x in made]
                same = [b == (t or "").encode() for b, t in zip(back, texts[lo:hi], strict=True)]
                columns = [doc_ids[lo:hi], [len(x) // 4 for x in made], [zlib.crc32(x) for x in made], [zlib.crc32(x) for x in back]]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "lossless"])

    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, lossless boolean")


QUERIES = {"op9_sentencepiece_dropout": op9_sentencepiece_dropout}
