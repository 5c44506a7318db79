"""Cross-tokenizer alignment (operator 11): whitespace-token anchors.

1. Tasks encode each whole text with both tokenizers (A: byte-level BPE of a space and the text, B: pieces that add the
   space themselves) and compare the joined bytes of either with the text. Where both have a token that begins with a
   space at the same byte, everything before is a shared end: such anchors split a document into windows of token ids.
   No token of either reaches over a space between two characters other than white space; there a window is a word.
2. A window's alignment depends on its ids alone, so it is made once and kept by its word, or else by its pair of id
   tuples: groups between shared ends, links, and how often each pair of ids is linked. A document is the sequence of its
   windows.
3. A task writes a row for each block of documents (``BLOCK_BYTES`` of text): what its documents have, and each distinct id
   pair of the block once with the number of its documents that hold it. These are summed up to the counts of the corpus,
   each block's pairs are joined with the counts and come back to the block, and its documents add them up.

So what is shuffled is distinct pairs of blocks, not tokens or links, and no count table has to fit anywhere. A pair that
every document holds meets its count once for each block, in a join that AQE may split.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import chunks, give_back, kept, materialize
from causeway.llm.packing import RUN, tokenizer_files
from causeway.llm.pieces import SPACE, model_file

#: An id pair is ``a << BITS | b``.
BITS = 20
#: Bytes of text of a block.
BLOCK_BYTES = 2_000_000
#: Windows that a worker keeps; beyond, it begins anew with the next block.
CACHE = 200_000
#: The mark of B's ids in a window.
OF_B = np.uint32(1 << 31)
#: Links of a group that are listed one by one; larger groups multiply the counts of their distinct ids.
LISTED = 4_096


@dataclass
class Side:
    """A tokenizer: ids of a text, the ids of many words that each follow a space (one after the other, and how many each
    has), the bytes of each id, their number, and whether a space is first."""

    encode: object
    words: object
    data: list[bytes]

    def __post_init__(self):
        self.size = np.array([len(x) for x in self.data], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in self.data])


def flat(made: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after the other, and how many each has."""
    counts = np.fromiter(map(len, made), np.int64, len(made))
    return np.fromiter(chain.from_iterable(made), np.int64, int(counts.sum())), counts


def byte_side(ranks: str, pattern: str) -> Side:
    """Byte-level BPE of a space and the text; strings of special tokens are ordinary text.

    Words are encoded together, parted by spaces, but for those that are empty or begin with white space.
    """
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    data = [b""] * (max(table.values()) + 1)
    for k, i in table.items():
        data[i] = k
    length = np.array([len(x) for x in data], np.int64)

    def apart(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([plain(" " + w) for w in of])

    def together(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, want = np.array(plain(" " + " ".join(of)) if of else [], np.int64), np.cumsum([len(w.encode()) + 1 for w in of])
        upto = np.cumsum(length[ids])
        last = np.searchsorted(upto, want)
        same = len(ids) and upto[-1] == want[-1] and (upto[last] == want).all()
        return (ids, np.diff(last, prepend=-1)) if same else apart(of)

    def words(of: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = np.fromiter((not w or w[0].isspace() for w in of), bool, len(of))
        parts = [(at, *how([of[i] for i in at.tolist()])) for how, at in ((together, np.flatnonzero(~alone)), (apart, np.flatnonzero(alone)))]
        counts = np.zeros(len(of), np.int64)
        for at, _, n in parts:
            counts[at] = n
        starts, ids = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int64)
        for at, own, n in parts:
            ids[spread(starts[at], n)[1]] = own
        return ids, counts

    return Side(lambda text: plain(" " + text), words, data)


def piece_side(model: str) -> Side:
    """SentencePiece with its own leading space; byte pieces are their byte, control pieces nothing."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [s.id_to_piece(i) for i in range(s.vocab_size())]
    data = [bytes([int(x[3:5], 16)]) if s.is_byte(i) else b"" if s.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
    # The library adds no space to nothing, so an empty word (two spaces, the end of a text) is a space alone.
    alone = [s.piece_to_id(SPACE)]
    return Side(s.encode, lambda words: flat([x if w else alone for w, x in zip(words, s.encode(words, num_threads=1), strict=True)]), data)


def shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two rising sequences of what both have."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a) if len(b) else at[:0]
    return hit, at[hit]


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``sizes`` from ``starts``: which range, and which place, for each member of each."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[who]


class Alignments:
    """Alignments of windows, numbered and found by their word or their two id tuples (as bytes): text of the groups, tokens
    of both, groups, links, id pairs and their times. Words of which a side's bytes differ have number -1."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.forget()
        self.names = [f"{i}{c}" for side, end in ((a, "|"), (b, ";")) for i in range(len(side.data)) for c in (",", end)]
        self.names_at = (0, 2 * len(a.data))

    def forget(self) -> None:
        self.number: dict[str | bytes, int] = {}
        self.text: list[str] = []
        self.n_a, self.n_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.groups, self.links, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, windows: list[str | bytes], ids: list[np.ndarray], count: list[np.ndarray]) -> None:
        """Aligns new windows, all together, of which each side has its ids one after the other. Both tuples of a window have
        the same bytes, so its end is shared."""
        ends = [np.cumsum(side.size[x]) for side, x in zip((self.a, self.b), ids, strict=True)]
        last = shared(*ends)  # the last tokens of each group
        first = [np.append(0, x[:-1] + 1) for x in last]
        size = [x - f + 1 for x, f in zip(last, first, strict=True)]
        owner = np.searchsorted(np.cumsum(count[0]), last[0], "right")
        links = size[0] * size[1]
        groups = np.bincount(owner, minlength=len(windows))
        some = np.flatnonzero(links <= LISTED)
        who, off = spread(np.zeros(len(some), np.int64), links[some])
        g = some[who]
        found = [(owner[g], ids[0][first[0][g] + off // size[1][g]] << BITS | ids[1][first[1][g] + off % size[1][g]], np.ones(len(g), np.int64))]
        for k in np.flatnonzero(links > LISTED).tolist():
            (x, n), (y, m) = (np.unique(ids[j][first[j][k] : last[j][k] + 1], return_counts=True) for j in (0, 1))
            found.append((np.full(len(x) * len(y), owner[k]), (x[:, None] << BITS | y).ravel(), (n[:, None] * m).ravel()))
        who, pair, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((pair, who))
        who, pair, times = who[order], pair[order], times[order]
        heads = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])))
        # Ids as text in the order of groups, A before B, each with what follows it: a comma, or at a group's end | or ;
        place = [np.arange(len(ids[0])) + np.repeat(first[1], size[0]), np.arange(len(ids[1])) + np.repeat(last[0] + 1, size[1])]
        tokens = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            own = 2 * ids[k]
            own[last[k]] += 1
            tokens[place[k]] = own + self.names_at[k]
        made = list(map(self.names.__getitem__, tokens.tolist()))
        lo = 0
        for w, hi in zip(windows, np.cumsum(count[0] + count[1]).tolist(), strict=True):
            self.number[w] = len(self.text)
            self.text.append("".join(made[lo:hi])[:-1])
            lo = hi
        self.n_a, self.n_b = np.append(self.n_a, count[0]), np.append(self.n_b, count[1])
        self.groups, self.links = np.append(self.groups, groups), np.append(self.links, np.bincount(owner, links, len(windows)).astype(np.int64))
        self.start = np.append(self.start, self.start[-1] + np.cumsum(np.bincount(who[heads], minlength=len(windows))))
        self.pairs, self.times = np.append(self.pairs, pair[heads]), np.append(self.times, np.add.reduceat(times, heads))

    def of(self, windows: list[bytes]) -> np.ndarray:
        """The numbers of windows of ids."""

        def learn(new: list[bytes]) -> None:
            both = np.frombuffer(b"".join(new), "<u4")
            of_b = both >= OF_B
            who = np.repeat(np.arange(len(new)), np.fromiter(map(len, new), np.int64, len(new)) // 4)
            ids = [(both[m] & (OF_B - np.uint32(1))).astype(np.int64) for m in (~of_b, of_b)]
            self.add(new, ids, [np.bincount(who[m], minlength=len(new)) for m in (~of_b, of_b)])

        return self.found(windows, learn)

    def of_words(self, words: list[str]) -> np.ndarray:
        """The numbers of words that each follow a space."""

        def learn(new: list[str]) -> None:
            own = [(" " + w).encode() for w in new]
            whole, sizes = b"".join(own), np.fromiter(map(len, own), np.int64, len(own))
            same, made = np.ones(len(new), bool), []
            for side in (self.a, self.b):
                ids, count = side.words(new)
                made.append((ids, count))
                data, ends = list(map(side.data.__getitem__, ids.tolist())), np.append(0, np.cumsum(count))
                if (np.diff(np.append(0, np.cumsum(side.size[ids]))[ends]) != sizes).any() or b"".join(data) != whole:
                    same &= [b"".join(data[i:j]) == x for i, j, x in zip(ends[:-1].tolist(), ends[1:].tolist(), own, strict=True)]
            if not same.all():
                self.number.update((new[i], -1) for i in np.flatnonzero(~same).tolist())
                new = [new[i] for i in np.flatnonzero(same).tolist()]
                made = [(ids[np.repeat(same, count)], count[same]) for ids, count in made]
            if new:
                self.add(new, *map(list, zip(*made, strict=True)))

        return self.found(words, learn)

    def found(self, windows: list, learn) -> np.ndarray:
        """The numbers of windows; ``learn`` is given those that are new, once each."""
        numbers = np.fromiter(map(self.number.get, windows, repeat(-2)), np.int64, len(windows))
        missing = np.flatnonzero(numbers == -2)
        if len(missing):
            new = [windows[i] for i in missing.tolist()]
            learn(list(dict.fromkeys(new)))
            numbers[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        return numbers


class Aligner:
    def __init__(self, ranks: str, pattern: str, model: str):
        self.a, self.b = byte_side(ranks, pattern), piece_side(model)
        self.known = Alignments(self.a, self.b)

    def forget(self) -> None:
        self.known.forget()

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both for each text, encoded whole; none where the joined bytes of either are not a space and the text."""
        out = []
        for t in texts:
            ids, whole = (self.a.encode(t), self.b.encode(t)) if t else ((), ()), (" " + t).encode()
            same = all(b"".join(map(side.data.__getitem__, x)) == whole for side, x in zip((self.a, self.b), ids, strict=True))
            out.append(tuple(array("I", x).tobytes() for x in ids) if same else (b"", b""))
        return out

    def windows(self, a: list[bytes], b: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """All windows of documents with tokens (the ids of A, then those of B, marked), and how many each document has."""
        raw = [b"".join(x) for x in (a, b)]
        at = []
        for x, data, side in zip((a, b), raw, (self.a, self.b), strict=True):
            ids = np.frombuffer(data, "<u4")
            size, mark = side.size[ids], side.spaced[ids]
            docs = np.cumsum([0] + [len(y) // 4 for y in x[:-1]])
            mark[docs] = True
            places = np.flatnonzero(mark)
            at.append((places, (np.cumsum(size) - size)[places], docs))
        hit = shared(at[0][1], at[1][1])
        cut = [at[k][0][hit[k]] for k in (0, 1)]
        counts = np.diff(np.append(np.searchsorted(cut[0], at[0][2]), len(cut[0])))
        # One row of ids in which each window's of A stand before its of B, which carry a mark.
        ids = [np.frombuffer(x, "<u4") for x in raw]
        upto = [np.append(c[1:], len(x)) for c, x in zip(cut, ids, strict=True)]
        both = np.empty(len(ids[0]) + len(ids[1]), "<u4")
        both[np.arange(len(ids[0])) + np.repeat(cut[1], upto[0] - cut[0])] = ids[0]
        both[np.arange(len(ids[1])) + np.repeat(upto[0], upto[1] - cut[1])] = ids[1] | OF_B
        data, ends = both.tobytes(), (4 * (upto[0] + upto[1])).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)], counts

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each document with tokens, in their order: the document, and the window's number.

        The windows of a text are its words, but for texts with spaces beside white space, which are encoded whole.
        """
        plain = {i: t.split(" ") for i, t in enumerate(texts) if t and t[0] != " " and "  " not in t and not RUN.search(" " + t)}
        doc = np.repeat(np.fromiter(plain, np.int64, len(plain)), np.fromiter(map(len, plain.values()), np.int64, len(plain)))
        own = self.known.of_words(list(chain.from_iterable(plain.values())))
        odd = np.unique(doc[own < 0])
        if len(odd):
            some = ~np.isin(doc, odd)
            doc, own = doc[some], own[some]
        rest = [i for i, t in enumerate(texts) if t and i not in plain]
        made = {i: x for i, x in zip(rest, self.tokens([texts[i] for i in rest]), strict=True) if x[0]}
        if made:
            windows, counts = self.windows(*map(list, zip(*made.values(), strict=True)))
            doc, own = np.append(doc, np.repeat(list(made), counts)), np.append(own, self.known.of(windows))
            order = np.argsort(doc, kind="stable")
            doc, own = doc[order], own[order]
        return doc, own

    def block(self, texts: list[str | None], digest: bool) -> dict:
        """A block's row but for the ids: what each document has, and the block's distinct id pairs."""
        k, n = self.known, len(texts)
        if len(k.number) > CACHE:
            k.forget()
        out = {"groups": [""] * n} | {c: np.zeros(n, np.int64) for c in PER_DOC}
        doc, own = self.numbered(texts)
        if not len(doc):
            return out | {"body": b"", "pairs": [], "held": []}
        for name, x in (("n_a", k.n_a), ("n_b", k.n_b), ("n_groups", k.groups), ("n_links", k.links)):
            out[name] = np.bincount(doc, x[own], n).astype(np.int64)
        lo = 0
        numbers = own.tolist()
        for i, hi in enumerate(np.cumsum(np.bincount(doc, minlength=n)).tolist()):
            if hi > lo:
                text = ";".join(map(k.text.__getitem__, numbers[lo:hi]))
                out["groups"][i] = hashlib.sha256(text.encode()).hexdigest() if digest else text
                lo = hi
        # Each document's distinct pairs: of its distinct windows, then summed up.
        mine, own = np.unique(own, return_inverse=True)
        who, place = spread(k.start[mine], k.start[mine + 1] - k.start[mine])
        pairs, local = np.unique(k.pairs[place], return_inverse=True)
        size = np.bincount(who, minlength=len(mine))
        seen, times = np.unique(doc * len(mine) + own, return_counts=True)
        doc, own = np.divmod(seen, len(mine))
        who, at = spread((np.cumsum(size) - size)[own], size[own])
        local, place = local[at], place[at]
        key, at = np.unique(doc[who] * len(pairs) + local, return_inverse=True)
        total = np.bincount(at, k.times[place] * times[who]).astype("<u4")
        doc, local = np.divmod(key, len(pairs))
        out["size"] = np.bincount(doc, minlength=n)
        body = zstandard.ZstdCompressor(level=1).compress(np.diff(local, prepend=0).astype("<i4").tobytes() + total.tobytes())
        return out | {"body": body, "pairs": pairs, "held": np.bincount(local)}


def aligner(*how: str) -> Aligner:
    """One for each worker."""
    return kept("alignment", how, lambda: Aligner(*how))


PER_DOC = ("n_a", "n_b", "n_groups", "n_links", "size")
BLOCK = "doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in PER_DOC) + ", groups array<string>, body binary, pairs array<long>, held array<long>"


def blocks(docs: DataFrame, how: tuple[str, str, str], digest: bool) -> DataFrame:
    """A row for each block of documents."""
    kinds = {"groups": pa.list_(pa.string()), "body": pa.binary()}
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches):
        own = aligner(*how)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in chunks(texts.cast(pa.binary()).to_pylist(), BLOCK_BYTES):
                row = own.block(texts[lo:hi].to_pylist(), digest) | {"doc_id": ids[lo:hi]}
                yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.list_(pa.int64()))) for c in names], names=names)
        own.forget()  # a worker may stand idle while later stages need the memory
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, BLOCK)


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best) from (pair, held): in how many documents an id pair is linked, and whether none of its A id is in more.

    An A id has at most as many rows as B has ids.
    """
    counts = held.groupBy("pair").agg(F.sum("held").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", BITS)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, files: tuple[str, str] | None = None, model: str | None = None, digest: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair no other
    pair of its A id exceeds in the corpus, ties included), count_sum (documents that hold a link's pair, over links) and
    ``groups`` (``a1,a2|b1;a3|b2``), or with ``digest`` only its ``groups_sha256``.

    ``files``: ranks and pattern of A; ``model``: B. Null and empty texts, and those that one tokenizer does not give back
    byte by byte, have no tokens: zeros and empty groups. Repeated rows are documents of their own; null ids stay null; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    how = (*(files or tokenizer_files()[1:]), model or model_file())
    made = materialize(blocks(docs, how, digest).withColumn("block", F.monotonically_increasing_id()), "blocks")
    counts = materialize(pair_counts(made.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select(F.col("x.pairs").alias("pair"), "x.held")), "pair-counts")
    replies = made.select("block", F.posexplode("pairs").alias("at", "pair")).join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")
    name = "groups_sha256" if digest else "groups"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {name} string"

    def add_up(block: pa.Table, reply: pa.Table) -> pa.Table:
        own = {c: block.column(c)[0].values for c in block.column_names if c not in ("block", "body")}
        at = reply.column("at").to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = reply.column("n").to_numpy(), reply.column("best").to_numpy()
        body = block.column("body")[0].as_py()
        size = own["size"].to_numpy()
        local, times = np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(body) if body else b"", "<i4"), 2)
        local, times, ends = np.cumsum(local), times.astype(np.int64), np.cumsum(size)
        each = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x))[ends]))
        made = {"n_best": each(times * best[local]), "count_sum": each(times * n[local])}
        columns = [own["doc_id"], *[own[c] for c in PER_DOC[:-1]], pa.array(made["n_best"]), pa.array(made["count_sum"]), own["groups"]]
        return pa.table(columns, names=[x.split()[0] for x in schema.split(", ")])

    return made.drop("pairs", "held").groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(add_up, schema)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` aligned between the two tokenizers."""
    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_tokenizer_alignment": op11_tokenizer_alignment}
