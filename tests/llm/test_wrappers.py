"""Registered queries on a small table with edge rows, against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm.neighbours import op8_nearest_neighbours
from causeway.llm.packing import op1_best_fit_packing
from causeway.llm.pieces import op9_sentencepiece_dropout
from causeway.llm.sharding import op3_sharding


@pytest.fixture(scope="module")
def folder(few, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    few.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op1(spark, folder, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {(r[0], r[1] or ""): np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    by_id = {k[0]: v for k, v in ids.items()}
    times, total, bins = Counter(r[0] for r in rows), Counter(), defaultdict(list)
    for r in op1_best_fit_packing(spark, folder).collect():
        assert r.ids_crc32 == zlib.crc32(by_id[r.doc_id][r.start : r.start + r.length].tobytes())
        total[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert total == {k: len(v) * times[k] for k, v in by_id.items()}
    for own in bins.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= -(-sum(total.values()) // 1024) + 1


def test_op3(spark, folder, rows):
    out = op3_sharding(spark, folder).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    shards = defaultdict(list)
    for r in out:
        assert r.law == "rows" and r.grown_shard is None
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_op9(spark, folder, rows):
    out = op9_sentencepiece_dropout(spark, folder).collect()
    assert all(r.lossless for r in out)
    assert Counter((r.doc_id, r.decoded_crc32, r.n_ids > 0) for r in out) == Counter((r[0], zlib.crc32((r[1] or "").encode()), bool(r[1])) for r in rows)


def test_op8(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in op8_nearest_neighbours(spark, sf).collect():
        assert abs(r.score - np.sqrt(((rows[r.query_id] - rows[r.vec_id]) ** 2).sum())) < 1e-9 and r.query_id != r.vec_id
        got[r.query_id].append(r["rank"])
    assert set(got) == {i for i in rows if i % 100 == 0} and all(sorted(x) == list(range(1, 11)) for x in got.values())
