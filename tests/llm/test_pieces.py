import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import pieces as Q


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=Q.model_file())


def test_without_dropout_like_the_library(rows):
    texts = [r[1] for r in rows if r[1] is not None and Q.SPACE not in r[1]]
    e = Q.Encoder(Q.model_file(), 0.0, 7, 1)
    got = [np.frombuffer(x, "<u4").tolist() for x in e([1] * len(texts), texts)]
    assert got == library().encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abtheing ▁é\n😀<s>")), max_size=80), st.integers(0, 5))
def test_lossless_and_both_agendas(text, seed):
    e = Q.encoder(Q.model_file(), 0.3, 7, 2)
    assert e.decode(e([seed], [text])[0]).decode() == text
    words = [w for w in Q.WORD.findall(" " + text) if len(w) <= Q.LONG]
    if words:
        assert Q.together(e.v, words, seed, 0.3) == [Q.with_bytes(e.v, w, Q.by_heap(e.v, w, seed, 0.3)) for w in words]


def test_varied_and_reproducible(few, rows, none):
    one = {(r.doc_id, str(r.ids)) for r in Q.encode(few, seed=1).collect()}
    assert one == {(r.doc_id, str(r.ids)) for r in Q.encode(few.repartition(3), seed=1).collect()}
    assert len(one & {(r.doc_id, str(r.ids)) for r in Q.encode(few, seed=2).collect()}) < len(one) / 4
    back = sorted(str((r.doc_id, r.text)) for r in Q.decode(Q.encode(few, dropout=0.5)).collect())
    assert back == sorted(str((r[0], r[1] or "")) for r in rows)
    assert Q.encode(none).count() == 0


def test_each_occurrence_is_drawn_anew():
    e = Q.Encoder(Q.model_file(), 0.1, 7)
    n = 3000
    one = e([1], [" ".join(["international"] * n)])[0]
    same = e([1] * 3, ["international"] * 3)
    assert same[0] == same[1] == same[2] and e.decode(one).decode() == " ".join(["international"] * n)
    ways = [e([d], ["international"])[0] for d in range(n)]
    assert len(set(ways)) > 4
    # Results are those of drawing each candidate in turn.
    plain = e.agendas.number[" international", frozenset()]
    merges = e.agendas.start[plain + 1] - e.agendas.start[plain]
    assert 0.9**merges - 0.05 < sum(w == e.agendas.ids[plain] for w in ways) / n < 0.95  # other ways may end in the same piece
    words = [" international", " governments", " the"] * 50
    keys = np.arange(150, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    skip = lambda k, a, b, c: Q.skipped(keys[k], a, b, c, 0.1)
    assert e.short(words, keys) == Q.agendas(e.v, words, skip)[0]


def one_by_one(e, word, key):
    """Pieces of a word by looking through all neighbours for each merge."""
    own = np.array([Q.keyed(word, int(key)) if len(word) > Q.LONG else key], np.uint64)
    symbols = [(int(e.v.char[ord(x)]), i, i + 1) for i, x in enumerate(word)]
    while True:
        offers = []
        for i, ((p, a, b), (q, _, c)) in enumerate(zip(symbols, symbols[1:], strict=False)):
            made = e.v.pairs.get(p << 20 | q) if p >= 0 and q >= 0 else None
            if made is not None and not Q.skipped(own, np.array([a]), np.array([b]), np.array([c]), e.dropout)[0]:
                offers.append((int(e.v.priority[made]), i, (made, a, c)))
        if not offers:
            return [x for p, a, _ in symbols for x in ([p] if p >= 0 else [e.v.byte[b] for b in word[a].encode()])]
        _, i, made = min(offers)
        symbols[i : i + 2] = [made]


def test_dropout_against_a_plain_loop(rows):
    import xxhash

    texts = [(d, t) for d, t, *_ in rows if t and len(t) < 3000][:40] + [(5, "the the " * 30 + "antidisestablishmentarianism" * 3 + " é😀 naïve")]
    for dropout in (0.1, 0.5):
        e = Q.Encoder(Q.model_file(), dropout, 7, 3)
        got = e([d for d, _ in texts], [t for _, t in texts])
        for (d, t), ids in zip(texts, got, strict=True):
            doc = np.uint64(xxhash.xxh64_intdigest(str(d).encode(), seed=7 * 1_000_003 + 3))
            words = Q.WORD.findall(" " + t)
            with np.errstate(over="ignore"):
                keys = Q.mix(doc + Q.mix(np.arange(len(words), dtype=np.uint64) + np.uint64(1)))
            assert np.frombuffer(ids, "<u4").tolist() == [x for w, k in zip(words, keys, strict=True) for x in one_by_one(e, w, k)]
