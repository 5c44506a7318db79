import random

import pytest

from causeway.llm import neardup as N


def brute(rows, k):
    sets = [N.shingle_set((t or "").encode(), k) for _, t in rows]
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted(str((d, len(s), None if d is None else find(d))) for (d, _), s in zip(rows, sets, strict=True))


def found(df, k):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in N.near_duplicates(df, k).collect())


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(few, rows, k):
    assert found(few, k) == brute([(r[0], r[1]) for r in rows], k)


def test_chains_groups_and_small_sets(spark):
    """Chains of near copies, a group whose members are near one text only, tiny sets, and rows that share ids."""
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    rows, n = [], 0
    for _ in range(6):
        text = [word() for _ in range(60)]
        for _ in range(9):
            rows.append((n, " ".join(text)))
            n += 1
            text[rng.randrange(60)] = word()
            text[rng.randrange(60)] = word()
    base = [word() for _ in range(80)]
    for _ in range(60):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(80)] = word()
        rows.append((n, " ".join(own)))
        n += 1
    rows.append((n, " ".join(base)))
    for t in ("a b c d e", "a b c d e f", "a b c d", "q", "q", "q r", "", None):
        n += 1
        rows.append((n, t))
    rows += [(n + 1, "only here once"), (n + 1, "and another text of that id"), (n + 2, "and another text of that id")]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), 2) == brute(rows, 2)


def test_empty(none):
    assert N.near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1050)]
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_differences_find_every_similar_pair(spark):
    """Members far from the pivot that share edits: all similar pairs are found, most others are not."""
    rng = random.Random(8)
    pivot = set(range(150))
    sets = []
    for g in range(8):
        shared = set(pivot) - set(rng.sample(range(150), 10 + 3 * g)) | {1000 * (g + 1) + i for i in range(10 + 3 * g)}
        for m in range(6):
            own = set(rng.sample(sorted(shared), len(shared) - rng.randrange(12))) | {10**6 + 1000 * (6 * g + m) + i for i in range(rng.randrange(10))}
            sets.append(own)
    rows = [(0, i + 1, len(s), True, i + 1, sorted(s ^ pivot)) for i, s in enumerate(sets)]
    close = spark.createDataFrame(rows, "pivot long, cls long, n long, ok boolean, root long, diff array<long>")
    got = {(r.u, r.v) for r in N.by_differences(close).collect()}
    similar = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = {(i + 1, j + 1) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and similar(a, b) and not (similar(a, pivot) and similar(b, pivot))}
    assert len(want) > 20 and want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_prefixes_find_every_similar_pair(spark):
    """Sets of common and own elements: all similar pairs with other roots are found, most others are not."""
    rng = random.Random(9)
    sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(60)]
    for i in range(60):
        near = set(rng.choice(sets))
        near -= set(rng.sample(sorted(near), len(near) // rng.choice((5, 8, 12))))
        sets.append(near | {1000 * (i + 1) + j for j in range(rng.randrange(4))})
    rows = [(i, len(s), i % 50, e) for i, s in enumerate(sets) for e in s]
    got = {(r.u, r.v) for r in N.by_prefixes(spark.createDataFrame(rows, "cls long, n long, root long, e long")).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and i % 50 != j % 50 and 100 * len(a & b) >= 80 * len(a | b)}
    assert len(want) > 20 and want <= got and len(got) < len(sets) * (len(sets) - 1) / 4
