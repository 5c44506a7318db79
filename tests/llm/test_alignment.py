import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from causeway.llm import alignment as A
from causeway.llm.packing import tokenizer_files
from causeway.llm.pieces import model_file

_MADE = []


def libraries():
    if not _MADE:
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        s = sentencepiece.SentencePieceProcessor(model_file=model_file())
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
        assert set(back) == set(ByteLevel.alphabet())
        _MADE.append((t, s, back))
    return _MADE[0]


def tokens(text):
    t, s, back = libraries()
    if not text:
        return [], []
    whole = (" " + text).encode()
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda x: bytes([int(x[3:5], 16)]) if len(x) == 6 and x[:3] == "<0x" else x.replace("▁", " ").encode()
    b = [(i, piece(s.id_to_piece(i))) for i in s.encode(text)]
    return (a, b) if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])


def groups(text):
    """[(A ids, B ids)] of a text."""
    a, b = tokens(text)
    ends = lambda x: [sum(len(y[1]) for y in x[: i + 1]) for i in range(len(x))] if len(x) < 300 else running(x)
    cut = sorted(set(ends(a)) & set(ends(b)))
    out, i, j, ea, eb = [], 0, 0, ends(a), ends(b)
    for c in cut:
        x, y = [], []
        while i < len(a) and ea[i] <= c:
            x.append(a[i][0])
            i += 1
        while j < len(b) and eb[j] <= c:
            y.append(b[j][0])
            j += 1
        out.append((x, y))
    return out


def running(x):
    out, n = [], 0
    for y in x:
        n += len(y[1])
        out.append(n)
    return out


def printed(found):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)


def brute(rows):
    held, links = Counter(), []
    for r in rows:
        found = groups(r[1])
        own = Counter()
        for x, y in found:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    own[p, q] += n * m
        held.update(own.keys())
        links.append((r[0], found, own))
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for d, found, own in links:
        n_a, n_b = sum(len(x) for x, _ in found), sum(len(y) for _, y in found)
        best = sum(n for k, n in own.items() if held[k] == most[k[0]])
        digest = hashlib.sha256(printed(found).encode()).hexdigest() if found else ""
        out.append((d, n_a, n_b, len(found), sum(own.values()), best, sum(n * held[k] for k, n in own.items()), digest))
    return sorted(out, key=str)


def test_query(spark, few, rows, tmp_path):
    few.withColumn("block", F.lit(1)).withColumn("pairs", F.lit("x")).withColumn("n_a", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = A.op11_tokenizer_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_groups_as_text(few, rows):
    got = A.align(few).select("doc_id", "groups").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], printed(groups(r[1]))) for r in rows), key=str)


def test_one_block_or_many(few):
    """How documents are dealt and cut into blocks does not matter."""
    one, many = (sorted(map(str, A.align(few.repartition(n), digest=True).collect())) for n in (1, 9))
    assert one == many


ODD = list("ab'1 .\n\té▁\x1d😀xq<") + ["<|endoftext|>", "<s>", "<0x41>", "  ", "tokenization", "ﬁ", "́"]


def aligner():
    return A.aligner(*tokenizer_files()[1:], model_file())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=14).map("".join))
def test_tokens(text):
    a, b = aligner().tokens([text])[0]
    ids = lambda x: [int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)]
    assert (ids(a), ids(b)) == tuple([i for i, _ in x] for x in tokens(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), min_size=1, max_size=6))
def test_windows_and_groups(texts):
    row = aligner().block(texts, digest=False)
    assert row["groups"] == [printed(groups(t)) for t in texts]
    assert row["n_links"].tolist() == [sum(len(x) * len(y) for x, y in groups(t)) for t in texts]


@pytest.mark.parametrize("listed", [0, 3, 10**9])
def test_large_groups(monkeypatch, listed):
    """Links listed one by one and as products of counts are the same."""
    monkeypatch.setattr(A, "LISTED", listed)
    own = A.Aligner(*tokenizer_files()[1:], model_file())
    texts = ["zzzzzzzzzzqqqqzzzzzzz " * 3, "word " + "x" * 3000, "ababab😀😀😀bab", ""]
    row = own.block(texts, digest=False)
    held = Counter()
    for t in texts:
        held.update({(p, q) for x, y in groups(t) for p in x for q in y})
    assert {(int(p) >> A.BITS, int(p) & (1 << A.BITS) - 1): int(n) for p, n in zip(row["pairs"], row["held"], strict=True)} == held


def test_memo_begins_anew(monkeypatch):
    monkeypatch.setattr(A, "CACHE", 5)
    own = A.Aligner(*tokenizer_files()[1:], model_file())
    for t in ("one two three four five six seven", "eight nine ten", "one two"):
        assert own.block([t], digest=False)["groups"] == [printed(groups(t))]
    assert len(own.known.text) == 5


def test_empty(none):
    assert A.align(none).count() == 0


def test_words_of_a_block_are_encoded_together_and_found_by_name(monkeypatch):
    """A call of the tokenizer for each new word, and ids looked up by all windows, took most of the CPU seconds."""
    import tiktoken

    calls, real = [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: calls.append(text) or real(self, text))
    own = A.Aligner(*tokenizer_files()[1:], model_file())
    words = [f"w{i}ord{i * 7 % 11}" for i in range(500)]
    texts = [" ".join(words), " ".join(words[::3]), None, "", "ends in a space ", "a \nb c\n", "two  spaces here", "odd ▁ one", "▁"]
    row = own.block(texts, digest=False)
    assert row["groups"] == [printed(groups(t or "")) for t in texts]
    assert row["n_a"].tolist() == [sum(len(x) for x, _ in groups(t or "")) for t in texts] and row["n_b"].tolist() == [sum(len(y) for _, y in groups(t or "")) for t in texts]
    assert len(calls) < 10 and own.known.number.keys() >= set(words)
    assert own.known.number["▁"] == -1
    again = len(calls)
    assert own.block(texts[:2], digest=False)["groups"] == row["groups"][:2] and len(calls) == again
