"""Near-dedup of texts on one template, and the prefix filter that keeps them apart."""

import itertools
import random

import numpy as np
import pyarrow as pa

from pagewright.llm import minhash


def family(rng, m, shared=300, own=45):
    """m texts that share ``shared`` words, with ``own`` words of their own in between: similar, but below 0.8."""
    words = [f"t{i}" for i in range(shared)]
    return [" ".join([*words, *(f"o{rng.randrange(10**9)}" for _ in range(own))]) for _ in range(m)]


def frames(spark, texts, size=2):
    sets = minhash.shingle_sets(pa.array(texts), size)
    rows = [(i, len(s), bytearray(minhash.signature(s).tobytes()), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "id long, n long, sig binary, set binary")
    return frame, frame.selectExpr("id", "id as c")


def test_prefixes_lose_no_similar_pair(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(3, 60))]
        for _ in range(4):
            edited = [w if rng.random() > 0.06 else f"x{rng.randrange(9)}" for w in base] + [f"y{i}" for i in range(rng.randrange(4))]
            texts.append(" ".join(edited))
    sets, live = frames(spark, texts)
    plain = [set(s.tolist()) for s in minhash.shingle_sets(pa.array(texts), 2)]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if plain[i] and plain[j] and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
    of = {}
    for r in minhash._meeting(live, sets, 0.8).collect():
        of.setdefault(r.id, set()).add(r.token)
    assert want and all(of[a] & of[b] for a, b in want)
    links = {(r.a, r.b) for r in minhash._across(minhash._meeting(live, sets, 0.8), sets, 0.8).collect()}
    assert links <= want
    root = list(range(len(texts)))

    def find(x, of):
        while of[x] != x:
            x = of[x]
        return x

    def joined(pairs):
        of = list(root)
        for a, b in pairs:
            a, b = find(a, of), find(b, of)
            of[max(a, b)] = min(a, b)
        return [find(i, of) for i in root]

    assert joined(links) == joined(want)


def test_texts_of_a_template_make_no_candidates(spark):
    rng = random.Random(1)
    counts = {}
    for m in (100, 400):
        sets, live = frames(spark, family(rng, m))
        rarity = minhash._rarity(sets)
        counts[m] = minhash._prefixes(sets.join(live, "id"), rarity, 80).count()
        assert minhash._meeting(live, sets, 0.8).count() == 0
    assert counts[400] <= 4.1 * counts[100]


def test_families_come_out_apart_and_copies_together(spark):
    rng = random.Random(2)
    texts = family(rng, 120)
    texts += [t + " tail" for t in texts[:20]] + texts[20:30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, size=2).collect()}
    assert got == {i: i if i < 120 else i - 120 for i in range(150)}


def test_prefix_sizes():
    for n, m in itertools.product(range(1, 60), repeat=2):
        if n <= m:
            least = -(-80 * (n + m) // 180)
            assert minhash.prefix_sizes(n, 80)[0] >= n - least + 1 and minhash.prefix_sizes(m, 80)[1] >= m - least + 1 or least > n
    assert minhash.prefix_sizes(300, 80) == (34, 61) and np.array(minhash.prefix_sizes(1, 80)).tolist() == [1, 1]
