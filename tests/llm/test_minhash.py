import random

import numpy as np

from quernstone.llm import p3_minhash as m

WORDS = [f"w{i}" for i in range(400)]


def texts(seed: int, n: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(80)] for _ in range(n)]
    out = [(f"a{i:03}", " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        edited = list(w)
        for _ in range(i % 9):
            edited[r.randrange(80)] = r.choice(WORDS)
        out.append((f"b{i:03}", " ".join(edited).upper() + "."))
    return out


def truth(rows) -> set:
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows if len(w := t.lower().rstrip(".").split()) >= 40}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "chunk_id string, contents string, class string, member int")


def test_pairs_equal_brute_force(spark):
    rows = texts(1, 40) + [("short", "too short"), ("empty", ""), ("null", None), (None, "x " * 50)]
    got = {tuple(r) for r in m.expanded(*m.near_duplicates(frame(spark, rows + rows[:3]))).collect()}
    want = truth([(a, b) for a, b in rows if a and b])
    assert len(want) > 20 and got <= want and len(got) >= 0.97 * len(want)


def test_hot_buckets_find_the_same(spark):
    rows = texts(2, 20)
    plain = {tuple(r)[:2] for r in m.near_duplicates(frame(spark, rows))[1].collect()}
    hot = {tuple(r)[:2] for r in m.near_duplicates(frame(spark, rows), hot=1)[1].collect()}
    assert plain == hot and plain


def test_large_group_of_copies_is_a_star(spark):
    t = " ".join(WORDS[:60])
    rows = [(f"c{i:03}", t) for i in range(30)]
    members, links = m.near_duplicates(frame(spark, rows))
    assert members.select("class").distinct().count() == 1 and links.count() == 0
    assert m.expanded(members, links).count() == 30 * 29 // 2
    star = {tuple(r) for r in m.expanded(members, links, expand=10).collect()}
    assert star == {("c000", f"c{i:03}") for i in range(1, 30)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    s = m.Sketcher(192)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    x, y = m.packed(np.stack([s.minima(a), s.minima(b)]), 2).view(np.uint64).reshape(2, 2, 3)
    share = 1 - np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=0)).sum() / 192
    assert abs((share - 0.25) / 0.75 - 700 / 1300) < 0.15


def test_empty(spark):
    assert m.expanded(*m.near_duplicates(frame(spark, []))).count() == 0


def test_large_class_keeps_pairs_between_different_texts(spark):
    t = " ".join(WORDS[:60])
    spellings = [t, t.upper(), t + "."]
    rows = [(f"{'abc'[i % 3]}{i:02}", spellings[i % 3]) for i in range(30)] + [("z", " ".join(WORDS[:58] + ["other", "end"])), ("z2", " ".join(WORDS[:58] + ["other", "end"]))]
    got = {tuple(r) for r in m.expanded(*m.near_duplicates(frame(spark, rows + rows[:5])), expand=10).collect()}
    firsts = ["a00", "b01", "c02"]
    star = {(f, i) for f in firsts for i, _ in rows if i[0] == f[0] and i != f}
    between = {("a00", "b01"), ("a00", "c02"), ("b01", "c02")}
    across = {(f, z) for f in firsts for z in ("z", "z2")}
    assert got == star | between | across | {("z", "z2")}
