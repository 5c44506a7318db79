"""Token counts (operator 12): a digest cache.

1. Tasks digest the normalised content of each text; only ids, sizes and digests are written.
2. The digests are joined with the counts that the cache holds for this version of the tokenizer. Of each digest that it
   lacks one row is chosen, the one with the smallest doc_id.
3. Only the texts of chosen rows are encoded: a semi-join on digest and doc_id picks them, so the copies of a text,
   however many, are spread and never meet; texts travel compressed.
4. The new counts are appended to the cache, and every row takes its count from there.

Content is normalised as far as the tokenizer cannot tell: runs of ASCII white space are one space, none stands at the
ends, and A-Z are lower case. Letters keep their case in a text that holds a special token's string in any case, or that is
not in composed form (NFC) before and after: there case decides tokens. The tokenizer's version is a digest of its file
and of the library's name and version, so another file or library never reads stale counts.

The tokenizer never joins characters across ASCII white space, so the count of a text is the sum over its words (tested
against the library on whole documents and by property tests); a worker caches words.
"""

from __future__ import annotations

import hashlib
import unicodedata
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import CHUNK_BYTES, Words, kept, materialize, scratch

LIMIT = 2048
STORED = "digest binary, n_tokens long"


class Counter:
    """Tokens of a content as the library for the file gives them: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, file: str):
        if file.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(file)
            t.no_truncation()
            t.no_padding()
            self.specials = [x.content.lower().encode() for x in t.get_added_tokens_decoder().values()]
            words = Words(lambda w: len(t.encode(w.decode(), add_special_tokens=False).ids))
            self.normalised, self.count = self.by_words, lambda content: sum(map(words.__getitem__, content[1:].split()))
        else:
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=file)
            # White space and case matter to such a model.
            self.normalised, self.count = (lambda raw: b"\x02" + raw), lambda content: len(s.encode(content[1:].decode()))

    def by_words(self, raw: bytes) -> bytes:
        """The content that decides the count, after a byte that tells whether its case was folded."""
        own = b" ".join(raw.split())
        low = own.lower()
        if own.isascii():
            plain = True
        else:
            plain = unicodedata.is_normalized("NFC", own.decode()) and unicodedata.is_normalized("NFC", low.decode())
        if plain and not any(s in low for s in self.specials):
            return b"\x00" + low
        return b"\x01" + own


def counter(file: str) -> Counter:
    """One for each worker."""
    return kept("counts", file, lambda: Counter(file))


def version(file: str) -> str:
    """A digest of the tokenizer: the bytes of its file and the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if file.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    with open(file, "rb") as f:
        return hashlib.sha256(library.encode() + b"\x00" + f.read()).hexdigest()


def digests(docs: DataFrame, file: str, with_content: bool = False) -> DataFrame:
    """doc_id, n_bytes, digest of each row of ``docs`` (doc_id, text; null text: empty).

    ``with_content``: doc_id, digest and the compressed content instead, once for each doc_id and digest of a task.
    """
    schema = "doc_id long, digest binary, content binary" if with_content else "doc_id long, n_bytes long, digest binary"
    kinds = (pa.int64(), pa.binary(), pa.binary()) if with_content else (pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        normalised, press, seen = counter(file).normalised, zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                content = normalised(raw)
                digest = hashlib.sha256(content).digest()
                if not with_content:
                    rows.append((doc, len(raw), digest))
                elif (doc, digest) not in seen:
                    seen.add((doc, digest))
                    rows.append((doc, digest, press(content)))
                    held += len(rows[-1][2])
                if held > CHUNK_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def encoded(contents: DataFrame, file: str) -> DataFrame:
    """digest, n_tokens of rows (digest, content)."""

    def run(batches):
        count, unpack, seen = counter(file).count, zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            keys, numbers = [], []
            for digest, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:  # rows that share doc_id and text
                    seen.add(digest)
                    keys.append(digest)
                    numbers.append(count(unpack(content.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(numbers, pa.int64())], names=["digest", "n_tokens"])

    return contents.select("digest", "content").mapInArrow(run, STORED)


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """What a cache folder holds for a version of a tokenizer, a row for each digest; nothing where it does not exist.

    Two runs that append at once may both store a digest; their counts are equal, and it counts once here.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/tokenizer={tokenizer}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(place.toString()).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, file: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit``) of each row of ``docs`` (doc_id, text).

    ``cache``: a folder that all executors share; it is made where it is missing, and what it lacks is appended. Null texts
    count as empty: no bytes, no tokens. Repeated rows each get a row; null ids stay null; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark, tokenizer = docs.sparkSession, version(file)
    keyed = materialize(digests(docs, file), "digests")
    lacking = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(stored(spark, cache, tokenizer), "digest", "left_anti")
    lacking = materialize(lacking, "misses")
    if not lacking.isEmpty():
        own = digests(docs, file, with_content=True)
        chosen = lacking.select(F.col("digest").alias("d"), F.col("doc_id").alias("i")).hint("shuffle_hash")
        picked = own.join(chosen, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
        encoded(picked, file).write.mode("append").parquet(f"{cache.rstrip('/')}/tokenizer={tokenizer}")
    # A table of the counts that are needed, so that Spark can split the copies of one text in the join that follows.
    counts = materialize(stored(spark, cache, tokenizer).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    out = keyed.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``. The cache is a new folder, so that no earlier run saves this one work."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, f"{scratch(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}", tokenizer_file())


QUERIES = {"op12_token_counts": op12_token_counts}
