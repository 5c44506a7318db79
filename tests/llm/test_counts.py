from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.llm import counts as C
from causeway.llm.alignment import model_file


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(C.tokenizer_file())


def expected(rows):
    lib = library()
    size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    return sorted(((r[0], len((r[1] or "").encode()), size(r[1] or ""), size(r[1] or "") > C.LIMIT) for r in rows), key=str)


def test_counts(few, rows, tmp_path):
    got = C.count_tokens(few.withColumn("digest", F.lit("x")).withColumn("n_tokens", F.lit(0)), f"{tmp_path}/cache", C.tokenizer_file())
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_query(spark, few, rows, tmp_path):
    few.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, C.op12_token_counts(spark, str(tmp_path)).collect()), key=str) == expected(rows)


# Case that decides composition, letters whose case folding is long, special strings in either case, odd white space.
PARTS = list("aAhHtTjIK '1.\n\t\x0b\x0c\x1c\x85\xa0 ̱́̊̌̇éÉßẞΣςİſ😀") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'LL", "'s"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=16).map("".join))
def test_words_and_normalised_content(text):
    counter, lib = C.counter(C.tokenizer_file()), library_once()
    assert counter.count(counter.normalised(text.encode())) == len(lib.encode(text, add_special_tokens=False).ids)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=5).map("".join), min_size=2, max_size=40))
def test_equal_contents_count_alike(texts):
    by = defaultdict(set)
    for t in texts + [t.lower() for t in texts] + [f" {t}\n" for t in texts]:
        by[C.counter(C.tokenizer_file()).normalised(t.encode())].add(len(library_once().encode(t, add_special_tokens=False).ids))
    assert all(len(x) == 1 for x in by.values())


_LIB = []


def library_once():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def texts_encoded(spark, cache):
    """Digests stored, with repeats."""
    return spark.read.parquet(cache).count()


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache, file = f"{tmp_path}/cache", C.tokenizer_file()
    first = spark.createDataFrame([(i, ["The  same text", "the same\ntext ", "THE SAME TEXT"][i % 3]) for i in range(90)] + [(None, "other"), (None, "other"), (7, "other")], "doc_id long, text string").repartition(6)
    assert {tuple(r)[1:] for r in C.count_tokens(first, cache, file).filter("doc_id < 90").select("doc_id", "n_tokens").collect()} == {(3,), (1,)}
    assert texts_encoded(spark, cache) == 2
    again = C.count_tokens(first.unionByName(spark.createDataFrame([(500, "a new one")], first.schema)), cache, file)
    assert again.count() == 94 and texts_encoded(spark, cache) == 3
    C.count_tokens(first, cache, file).count()
    assert texts_encoded(spark, cache) == 3


def test_stored_counts_are_used_and_versions_kept_apart(spark, tmp_path):
    cache, file = f"{tmp_path}/cache", C.tokenizer_file()
    docs = spark.createDataFrame([(1, "stored")], "doc_id long, text string")
    digest = C.digests(docs, file).first().digest
    spark.createDataFrame([(bytes(digest), 77)], C.STORED).write.parquet(f"{cache}/tokenizer={C.version(file)}")
    assert C.count_tokens(docs, cache, file).first().n_tokens == 77
    assert C.count_tokens(docs, cache, model_file()).first().n_tokens == 1 or C.count_tokens(docs, cache, model_file()).first().n_tokens < 77


def test_sentencepiece_file(few, rows, tmp_path):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model_file())
    got = C.count_tokens(few, f"{tmp_path}/cache", model_file()).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], len(s.encode(r[1] or ""))) for r in rows), key=str)


def test_empty(none, tmp_path):
    assert C.count_tokens(none, f"{tmp_path}/cache", C.tokenizer_file()).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(few, rows, tmp_path, partitions):
    got = C.count_tokens(few.repartition(partitions), f"{tmp_path}/cache", C.tokenizer_file()).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
