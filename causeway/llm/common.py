"""What the corpus operators share: the scratch folder, let-bindings in column expressions, word rules.

Words are maximal runs of anything but space and 0x09-0x0D. ``bytes.split()`` and ``bytes.lower()`` follow
exactly these rules on UTF-8 (only ASCII white space splits, only A-Z change), so tasks that need Python work
on bytes; the regular expression below says the same to the JVM.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Entries that a worker's word cache may hold, and bytes of each; other words are computed each time instead.
CACHE_WORDS, CACHE_BYTES = 150_000, 64
#: Bytes of text that a task works on at a time.
CHUNK_BYTES = 4_000_000


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine, where it may be unset, one under /tmp."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "/tmp/checkpoints/causeway"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it again.

    Later steps read the files, so a lost executor costs no recomputation of what lies before.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def id_crc(column: str = "doc_id") -> Column:
    """CRC-32 of an id written as text, as the train and held-out folds use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


_KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Returns memory that is no longer used to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def drop_others(owner: str) -> None:
    """Drops what other operators have left in this worker; a task that keeps nothing itself calls it where it needs much memory."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = {}
        give_back()


def kept(owner: str, key, make):
    """What a Python worker keeps for one operator from task to task, made once.

    Workers are used by one stage after another: what another operator has left in this one is dropped first.
    """
    drop_others(owner)
    own = _KEPT[owner]
    if key not in own:
        own.clear()
        own[key] = make()
    return own[key]


def giving_back(run):
    """An Arrow task that returns what it no longer uses when it ends, as its worker may stand idle while others need memory."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


class Words(dict):
    """A bounded cache from a word to what ``make`` gives; use it as ``map(cache.__getitem__, words)``."""

    def __init__(self, make, size: int = CACHE_WORDS):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.size and len(word) <= CACHE_BYTES:
            self[word] = value
        return value


def word_hash(word: bytes) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def hashed_words(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """All words of all texts as 64-bit hashes, one after the other, and where each text begins (one more entry than texts)."""
    known = kept("hashes", None, lambda: Words(word_hash))
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        words = (t.lower() if lower else t).split() if t else ()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        starts[i + 1] = starts[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)).view(np.uint64), starts


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive words; it depends on their order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def chunks(texts: list[bytes | None], limit: int = CHUNK_BYTES):
    """Ranges of texts of about ``limit`` bytes together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
