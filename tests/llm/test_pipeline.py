import re

import corpus_pipeline as C

from causeway.llm import neardup, packing
from causeway.llm.common import materialize


def test_stages_against_brute_force(spark, few, rows):
    docs, kept = few, []
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, ""), "stage")
        kept.append([tuple(r) for r in docs.collect()])
        if name != C.STAGES[-1][0]:
            assert docs.columns == list(C.COLUMNS)
    lang, near, cut, clean, packed = kept
    # 1: rows with a letter stay, whatever else they have
    want = sorted(str((r[0], r[1])) for r in rows if r[1] is not None and any(c.isalpha() for c in r[1]))
    got = sorted(str((r[0], r[1])) for r in lang)
    assert set(got) <= set(want) and len(want) - len(got) <= 2  # junk of one letter may go
    # 2: one of each component
    sets = {}
    for r in lang:
        sets.setdefault(r[0], neardup.shingle_set(r[1].encode(), 5))
    top = {d: d for d in sets if d is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(top)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    assert sorted(r[0] for r in near if r[0] is not None) == [d for d in ids if find(d) == d]
    # 3: no window of 50 words is left that an earlier document has
    first = {}
    for d, t, *_ in sorted(near, key=lambda r: (r[0] is None, r[0] or 0)):
        w = t.split(" ")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    assert len(cut) <= len(near)
    for d, t, *_, n in cut:
        w = t.split(" ")
        assert n == len(t) and all(first.get(tuple(w[i : i + 50]), d) == d for i in range(len(w) - 49))
    # 4: no base secret is left
    hexes = re.compile("[0-9a-f]{32,}")
    assert len(clean) == len(cut) and not any(hexes.search(r[1]) for r in clean)
    # 5: every document is packed whole
    encode = packing.encoder(*packing.tokenizer_files())
    assert sum(r[3] for r in packed) == sum(len(encode(r[1])) // 4 + 1 for r in clean)
    by = {}
    for r in packed:
        by.setdefault(r[5], []).append((r[6], r[3]))
    assert all(sum(n for _, n in b) <= 1024 for b in by.values())


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 900
