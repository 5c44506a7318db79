"""Substring dedup (operator 5): seed and extend.

1. Seed. Of each ``length`` consecutive words (a window) the least hash of ``seed`` consecutive words is its anchor, so that
   equal windows have equal anchors in equal places (winnowing). Neighbouring windows mostly share an anchor: one row
   carries an anchor and all windows around it.
2. Join. Rows meet by anchor. Windows around a hot anchor (of a frequent phrase, say) have rows of their own, which meet by
   anchor and window, so that no task holds all windows of such an anchor; a sample of the documents tells which
   anchors are hot, and the result does not depend on it.
   A task sorts them by anchor and document and goes through them once: it never makes
   pairs, and keeps of an anchor only the distinct windows.
3. Extend. Around equal anchors the windows tell how far two documents agree to both sides, up to a window's length;
   windows that overlap make up maximal repeats. A window that a document with a smaller id also has is marked.
4. Cut. Marks go back to the texts by document; covered words are removed.

Copies within one chunk of documents are marked before the shuffle, and only a window's first document in the chunk sends
it, so a passage that a third of all documents share crosses the network once a chunk. A window is told by 48 bits of its
anchor's hash and 48 of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import as_bytes, chunks, giving_back, hashed_words, materialize, mix, rolled

LENGTH = 13
SEED = 4
#: Bytes kept of a window's hash.
TELL = 6
#: An anchor is hot if of every ``ONE_IN`` -th document ``HOT`` rows or more have it, or one of ``MOST`` of all of these rows.
ONE_IN, HOT, MOST = 64, 16, 100_000


def window_hash(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive words, from two overlapping blocks of a power of two."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m, block = 1, mix(words + np.uint64(0x51))
    while 2 * m <= length:
        block = mix(block[: len(block) - m] * np.uint64(0x9E3779B97F4A7C15) + block[m:])
        m *= 2
    return mix(block[:n] * np.uint64(0xD6E8FEB86659FD93) + block[length - m : length - m + n])


def anchors(words: np.ndarray, starts: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one document: where it starts, its document, its anchor's place, and all seed hashes."""
    seeds = rolled(words, seed)
    ends = starts[1:]
    counts = np.maximum(ends - starts[:-1] - length + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[:-1][doc]
    place = at.copy()
    if len(at):
        least = seeds[at]
        for j in range(1, length - seed + 1):
            other = seeds[at + j]
            better = other < least
            np.copyto(least, other, where=better)
            np.copyto(place, at + j, where=better)
    return at, doc, place, seeds


def rows_of(doc_ids: np.ndarray, ths: np.ndarray, texts: list[bytes | None], length: int, seed: int, hot: np.ndarray | None = None):
    """(anchor, doc_id, place, mask, tell) for one chunk, whose documents are in order of doc_id.

    ``place`` is 24 bits of the text's hash above the first window's start; ``mask`` has a bit for each window from there
    on. A window whose anchor is one of ``hot`` (sorted) has a row and an anchor of its own, made of both hashes. Rows
    without ``tell`` hold windows that are marked already; they only travel, dealt evenly.
    """
    words, starts = hashed_words(texts, lower=False)
    at, doc, place, seeds = anchors(words, starts, length, seed)
    if not len(at):
        return
    tell = window_hash(words, length)[at]
    # Windows that occur twice in the chunk: those of later documents are marked at once and not sent.
    order = np.sort(tell)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    maybe = np.zeros(1 << 16, bool)
    maybe[twice & np.uint64(0xFFFF)] = True
    some = np.flatnonzero(maybe[tell & np.uint64(0xFFFF)])
    some = some[np.isin(tell[some], twice)]
    marked = np.zeros(len(at), bool)
    if len(some):
        some = some[np.argsort(tell[some], kind="stable")]
        new = np.append(True, tell[some][1:] != tell[some][:-1])
        head = some[new][np.cumsum(new) - 1]
        later = doc_ids[doc[some]] > doc_ids[doc[head]]
        marked[some[later]] = True
    for chosen, told in ((np.flatnonzero(~marked), True), (np.flatnonzero(marked), False)):
        if not len(chosen):
            continue
        # A run: windows of one document with one anchor.
        p, d = place[chosen], doc[chosen]
        alone = np.zeros(len(chosen), bool)
        if told and hot is not None and len(hot):
            own = (seeds[p] >> np.uint64(16)).view(np.int64)
            alone = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
        first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | alone[1:]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(chosen))))
        bit = (at[chosen] - at[chosen[first]][run]).astype(np.uint64)
        mask = np.bitwise_or.reduceat(np.uint64(1) << bit, first)
        head = chosen[first]
        where = (ths[doc[head]] << 32) | (at[head] - starts[doc[head]])
        anchor = np.where(alone[first], mix(seeds[place[head]] ^ mix(tell[head])), seeds[place[head]]) if told else mix(doc_ids[doc[head]].view(np.uint64) ^ where.view(np.uint64))
        columns = [(anchor >> np.uint64(16)).view(np.int64), doc_ids[doc[head]], where, mask.view(np.int64)]
        out = [pa.array(c) for c in columns]
        if told:
            data = np.ascontiguousarray(tell[chosen].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TELL])
            offsets = (np.append(first, len(chosen)) * TELL).astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]))
        else:
            out.append(pa.nulls(len(first), pa.binary()))
        yield pa.RecordBatch.from_arrays(out, names=["anchor", "doc_id", "place", "mask", "tell"])


def bits_of(mask: np.ndarray) -> np.ndarray:
    """A row of 64 flags for each mask."""
    return np.unpackbits(np.ascontiguousarray(mask.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def tells_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows as numbers, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, TELL)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, :TELL] = data
    return wide.view("<u8").ravel(), np.diff(offsets) // TELL


def marks_of(batches):
    """Goes once through rows in order of anchor and doc_id; yields the marked windows."""
    names = ["doc_id", "place", "mask"]
    open_anchor, open_first = None, {}  # of the anchor at the end of the last batch: its windows' first documents
    for batch in batches:
        done = pc.is_null(batch.column("tell"))
        yield batch.filter(done).select(names)
        batch = batch.filter(pc.invert(done))
        n = batch.num_rows
        if not n:
            continue
        anchor, doc, mask = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "mask"))
        tell, size = tells_of(batch.column("tell"))
        row = np.repeat(np.arange(n), size)
        new = np.append(True, anchor[1:] != anchor[:-1])
        group = np.cumsum(new) - 1
        first = np.full(len(tell), np.iinfo(np.int64).max)
        several = np.bincount(group) > 1
        use = np.flatnonzero(several[group[row]])
        if len(use):
            use = use[np.lexsort((tell[use], group[row[use]]))]  # stable: documents stay in order
            g, t = group[row[use]], tell[use]
            head = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))
            first[use] = doc[row[use[head]]][np.cumsum(head) - 1]
        if open_anchor == anchor[0]:
            for i in np.flatnonzero(group[row] == 0).tolist():
                first[i] = min(first[i], open_first.get(tell[i].item(), first[i]))
        removed = first < doc[row]
        if group[-1] or open_anchor != anchor[0]:
            open_first = {}
        open_anchor = anchor[-1]
        for i in np.flatnonzero(group[row] == group[-1]).tolist():
            open_first.setdefault(tell[i].item(), doc[row[i]].item())
        hit = np.flatnonzero(np.bincount(row[removed], minlength=n))
        if len(hit):
            flags = bits_of(mask)
            r, b = np.nonzero(flags)
            flags[r, b] = removed
            kept = np.packbits(flags[hit], axis=1, bitorder="little").view("<i8").ravel()
            out = [batch.column("doc_id").take(pa.array(hit)), batch.column("place").take(pa.array(hit)), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(out, names=names)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("th", F.expr("cast(xxhash64(text) >> 40 as int)"))


def sent(slim: DataFrame, length: int, seed: int, hot: np.ndarray | None = None) -> DataFrame:
    """The rows that meet, of (doc_id, th, text)."""

    def emit(batches):
        for batch in batches:
            ids, ths, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), as_bytes(batch.column(2))
            order = np.argsort(ids, kind="stable")
            texts = [texts[i] for i in order]
            for lo, hi in chunks(texts):
                yield from rows_of(ids[order[lo:hi]], ths[order[lo:hi]], texts[lo:hi], length, seed, hot)

    return slim.select("doc_id", "th", "text").mapInArrow(giving_back(emit), "anchor long, doc_id long, place long, mask long, tell binary")


def hot_anchors(slim: DataFrame, length: int, seed: int) -> np.ndarray:
    """Anchors that very many documents have, sorted; at most ``MOST``. They are counted in every ``ONE_IN`` -th document."""
    some = sent(slim.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ONE_IN)) == 0), length, seed).filter("tell is not null")
    n = materialize(some.groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = n.filter(F.col("n") >= max(HOT, total / MOST)).select("anchor").toArrow().column("anchor")
    return np.sort(found.to_numpy())


def repeats(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(doc_id, th, marks): for each document with marked windows an array of (start, mask)."""
    if not 1 <= length - seed <= 63:
        raise ValueError("length - seed must be 1 to 63")
    slim = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).filter("doc_id is not null and text is not null")
    rows = sent(slim, length, seed, hot_anchors(slim, length, seed))
    # Hash-partitioned by anchor, of a hot one with the window; rows of one anchor arrive in order of document.
    met = rows.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id")
    marked = met.mapInArrow(giving_back(marks_of), "doc_id long, place long, mask long")
    th, start = F.expr("cast(place >> 32 as int)").alias("th"), F.expr("cast(place & 4294967295L as int)").alias("start")
    return marked.groupBy("doc_id", th).agg(F.collect_list(F.struct(start, "mask")).alias("marks"))


def covered(n: int, marks: list[dict] | None, length: int) -> np.ndarray:
    """Which of ``n`` words some marked window covers."""
    edge = np.zeros(n + 1, np.int32)
    for m in marks or ():
        starts = m["start"] + np.flatnonzero(bits_of(np.array([m["mask"]], np.int64))[0])
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def packed(batches):
    """Compresses the texts (third column), which else make up a third of what is shuffled."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [None if t is None else pack(t) for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary()), *batch.columns[3:]], names=batch.schema.names)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, seed: int = SEED, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its maximal repeats removed.

    Every word is removed that a window of ``length`` words covers which also starts in a document with a smaller doc_id;
    windows are judged on the input. Result: doc_id, n_words, n_removed, spans (removed runs of words: start, end), and
    the kept text: with ``digest`` only its ``kept_sha256`` (kept words joined by one space), else ``kept_text`` (the
    text as it was outside the removed runs), and the columns named in ``carry``. Null texts have no words; rows with one doc_id are not before one another;
    a null doc_id is neither before nor after any; equal rows give equal rows; an empty table gives none.
    """
    extra = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)]
    slim = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra))
    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    slim = slim.select("doc_id", "th", "text", *[f"_{i}" for i in range(len(carry))]).mapInArrow(giving_back(packed), "doc_id long, th int, text binary" + kinds)
    joined = slim.join(repeats(docs, length, seed), ["doc_id", "th"], "left").drop("th").select("doc_id", "text", "marks", *[f"_{i}" for i in range(len(carry))])

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, texts, marks = batch.column(0), [None if t is None else unpack(t) for t in batch.column(1).to_pylist()], batch.column(2)
            n_words, n_removed, spans, kept = [], [], [], []
            valid = marks.is_valid().to_pylist()
            for i, t in enumerate(texts):
                words = (t or b"").split()
                gone = []
                if valid[i]:
                    flags = covered(len(words), marks[i].as_py(), length)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                    gone = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                n_words.append(len(words))
                n_removed.append(sum(e - s for s, e in gone))
                spans.append([{"s": s, "e": e} for s, e in gone])
                if digest:
                    kept.append(hashlib.sha256(b" ".join([w for a, b in zip([0, *[e for _, e in gone]], [*[s for s, _ in gone], len(words)], strict=True) for w in words[a:b]] if gone else words)).hexdigest())
                else:
                    kept.append(t if not gone else without(t, words, gone))
            span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            text = pa.array(kept, pa.string()) if digest else pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), text, *batch.columns[3:]], names=["doc_id", "n_words", "n_removed", "spans", "kept", *batch.schema.names[3:]])

    out = joined.mapInArrow(giving_back(cut), "doc_id long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept string" + kinds)
    return out.withColumnsRenamed({"kept": "kept_sha256" if digest else "kept_text"} | {f"_{i}": c for i, c in enumerate(carry)})


def without(text: bytes, words: list[bytes], gone: list[tuple[int, int]]) -> bytes:
    """``text`` without the runs of words and the white space after each run."""
    places, at = [], 0
    for w in words:
        at = text.index(w, at)
        places.append(at)
        at += len(w)
    places.append(len(text))
    out, last = [], 0
    for s, e in gone:
        out.append(text[last : places[s]])
        last = places[e]
    return b"".join([*out, text[last:]])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the windows of 13 words that earlier documents have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same rows in DuckDB: each window's first document, and a frame over the windows that cover a word.
ORACLE_SQL = {
    "op5_substring_dedup": r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 11)) as i, w from d where len(w) >= 13),
keyed as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as k from win),
marked as (select doc_id, i, min(doc_id) over (partition by k) < doc_id as m from keyed),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
gone as (select words.doc_id, words.i, x, coalesce(bool_or(m) over (partition by words.doc_id order by words.i rows between 12 preceding and current row), false) as r from words left join marked on marked.doc_id = words.doc_id and marked.i = words.i)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join (select doc_id, count(*) filter (r) as n, string_agg(x, ' ' order by i) filter (not r) as k from gone group by doc_id) g on g.doc_id = d.doc_id"""
}
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
