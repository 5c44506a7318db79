"""Best-fit packing (operator 1): bound-certified repacking.

1. Tasks tokenize whole texts and emit a row for each piece (at most ``CAPACITY`` ids): numbers only, so the texts are
   never shuffled. The table is written to the shared folder; nothing is tokenized twice.
2. Pieces are dealt by hash into groups of about ``GROUP`` pieces. Each group runs best-fit decreasing, and dual-feasible
   functions give a lower bound on the bins that it needs. A group that meets its bound is certified and final.
3. The pieces in the bins with gaps of all other groups are dealt anew, with another hash and into as few groups as
   they need, and packed again; full bins stay. If the exchange saves no bin, the earlier placement stays.

Tokens: the ids of the ``tokenizers`` file, with its special-token strings recognised, then the end id. The same
vocabulary through tiktoken gives the same ids (tested on all documents of a test table) at a fraction of the cost,
and byte-level BPE never merges across a space that stands between two characters other than white space, so ids are
cached by the piece of text between spaces. A text that holds a special-token string, or white space that such cuts
could split, takes the plain way.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import CHUNK_BYTES, Words, giving_back, kept, materialize

CAPACITY = 1024
END = 2
GROUP = 50_000
ROUNDS = 3
#: White space on both sides of a space, or a space after white space at the end of the text.
RUN = re.compile(r"\s (?:\s|$)")
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of a text as little-endian 32-bit bytes."""

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        self.file, self.whole = tokenizer, None
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.after_space = Words(lambda piece: np.array(self.plain(" " + piece), "<u4").tobytes())

    def __call__(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:  # large, and needed by few texts
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if RUN.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u4").tobytes() + b"".join(map(self.after_space.__getitem__, rest))


def encoder(*files: str) -> Encoder:
    """One for each worker."""
    return kept("packing", files, lambda: Encoder(*files))


def tokenizer_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, files: tuple[str, str, str] | None = None) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    files = files or tokenizer_files()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names=names)

    def run(batches):
        encode = encoder(*files)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = encode(text) + end if text else end
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                for i, lo in enumerate([0, *range(first, n, capacity)]):
                    hi = first if i == 0 else lo + capacity
                    own = ids[4 * lo : 4 * hi]
                    rows.append((doc, i, lo, hi - lo, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else ())))
                held += len(ids)
                if held > CHUNK_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(giving_back(run), schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: longest first, each into the open bin that it leaves least room in."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0  # a bit for each amount of room that some bin has left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions: thresholds (over capacity - t counts as a whole bin, under t
    as nothing) and roundings u_k (multiples of capacity / (k + 1))."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    t = np.arange(0, capacity // 2 + 1)
    large = n[-1] - n[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int((-(-(large * capacity + middle) // capacity)).max())
    for k in range(1, 21):
        whole = sizes * (k + 1) % capacity == 0
        value = np.where(whole, sizes * k, sizes * (k + 1) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


PLACED = "uid long, length long, deal long, bin long, offset long, room long, group_bins long, group_bound long"


def packed_groups(items: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """``items`` (uid, length) dealt by a hash of uid into groups of bounded size, each packed and bounded."""

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        n = len(lengths)
        found = [bins, offsets, capacity - fill[bins], np.full(n, len(fill)), np.full(n, lower_bound(lengths, capacity))]
        return pa.table([table.column("uid"), table.column("length"), table.column("deal"), *[pa.array(x, pa.int64()) for x in found]], names=[x.split()[0] for x in PLACED.split(", ")])

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(groups)).alias("deal"))
    return dealt.groupBy("deal").applyInArrow(pack, PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS, with_ids: bool = False) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text): where it starts and ends in its document, and its place.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (gapless from 0 in each sequence), certified
    (its group met the lower bound on its bins), and ids if ``with_ids``. Null and empty texts are one end id; every
    row is a document, repeated ones too; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    made = materialize(pieces(docs, capacity, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    items, seed, settled = made.select("uid", "length"), 0, []
    n = items.count()
    placed = materialize(packed_groups(items, max(1, -(-n // group)), seed, capacity).withColumn("round", F.lit(0)), "packed")
    while True:
        gap = F.col("group_bins") > F.col("group_bound")
        loose = gap & (F.col("room") > 0)
        m, bins = placed.filter(loose).agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        seed += 1
        if not m or seed > rounds:
            break
        again = materialize(packed_groups(placed.filter(loose), max(1, -(-m // group)), seed, capacity).withColumn("round", F.lit(seed)), "packed")
        if again.filter("offset = 0").count() >= bins:
            break
        settled.append(placed.filter(~loose))
        placed = again
    for part in settled:
        placed = placed.unionByName(part)
    # Round, group and bin together name a sequence; the ranges are bounded by the rounds and the pieces of a group.
    number = F.col("round") * F.lit(1 << 58) + F.col("deal") * F.lit(1 << 24) + F.col("bin")
    placed = placed.select("uid", number.alias("sequence_id"), "offset", (F.col("group_bins") == F.col("group_bound")).alias("certified"))
    return made.join(placed, "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, doc_ids (in order), ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``capacity`` ids
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
