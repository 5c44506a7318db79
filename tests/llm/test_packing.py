import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import packing as P


def whole(texts):
    from tokenizers import Tokenizer

    return [x.ids + [P.END] for x in Tokenizer.from_file(P.tokenizer_files()[0]).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_are_the_tokenizers(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(400).collect()]
    encode = P.encoder(*P.tokenizer_files())
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [x[:-1] for x in whole(texts)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab'1 .\n\t é<|endoftext|>\x1d")), max_size=24))
def test_cached_ids(text):
    assert np.frombuffer(P.encoder(*P.tokenizer_files())(text), "<u4").tolist() == whole([text])[0][:-1]


def test_pack(spark, few, rows):
    out = P.pack(few, capacity=128, group=100, with_ids=True).collect()
    ids = dict(zip([(r[0], r[1]) for r in rows], whole([r[1] for r in rows]), strict=True))
    by_doc = defaultdict(list)
    for k, v in ids.items():
        by_doc[k[0]].append(v)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == r.length <= 128
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert any(v[r.start : r.start + r.length] == list(r.ids) for v in by_doc[r.doc_id])
    for d, v in by_doc.items():
        copies = sum(1 for x in rows if x[0] == d)
        assert sum(p.length for p in pieces[d]) == len(v[0]) * copies
        for p in pieces[d]:
            assert p.piece == 0 or p.length == 128
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= -(-sum(r.length for r in out) // 128) * 1.02 + 1
    joined = P.sequences(P.pack(few, capacity=128, with_ids=True)).collect()
    assert sum(len(r.ids) for r in joined) == sum(r.length for r in out)


def test_empty(none):
    assert P.pack(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_bins(lengths):
    lengths = np.array(lengths)
    bins, offsets = P.best_fit_decreasing(lengths, 20)
    assert all(np.bincount(bins, weights=lengths) <= 20)

    def least(left, rooms):
        if not left:
            return len(rooms)
        best = len(rooms) + len(left)
        for i in sorted(set(rooms)):
            if i >= left[0]:
                again = list(rooms)
                again[again.index(i)] -= left[0]
                best = min(best, least(left[1:], again))
        return min(best, least(left[1:], [*rooms, 20 - left[0]]))

    true = least(sorted(lengths.tolist(), reverse=True), [])
    assert P.lower_bound(lengths, 20) <= true <= bins.max() + 1


def test_exchange_saves_bins(spark):
    """Small groups leave gaps; the exchange packs their loose bins together."""
    docs = spark.createDataFrame([(i, "ab " * (i % 37 + 3)) for i in range(600)], "doc_id long, text string")
    one = P.pack(docs, capacity=64, group=20, rounds=0)
    more = P.pack(docs, capacity=64, group=20, rounds=3)
    count = lambda df: df.select("sequence_id").distinct().count()
    assert count(more) < count(one)
