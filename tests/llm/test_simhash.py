import random
import re

import numpy as np
import xxhash

from veilspark.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """doc_id lists to smallest reachable, by comparing all pairs."""
    comp = list(range(len(prints)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                comp[root(i)] = root(j)
    best = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            best[root(i)] = min(doc, best.get(root(i), doc))
    return [(doc, fp, best.get(root(i))) for i, (doc, fp) in enumerate(prints)]


def test_fingerprints():
    texts = [None, "", " \t\n", "One", "One two", "ÀB c\x0bD e\xa0f g", "a b c d e f g " * 30, "x" * 100_000 + " y z q"]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_keys_meet_for_all_small_distances():
    draw = random.Random(3)
    for _ in range(300):
        x = draw.getrandbits(64)
        y = x
        for bit in draw.sample(range(64), draw.randint(0, 3)):
            y ^= 1 << bit
        rows, found = simhash.keys(np.array([x, y], np.uint64))
        assert set(found[rows == 0]) & set(found[rows == 1])
        assert len(found[rows == 0]) == len(set(found[rows == 0])) <= 108


def test_components_as_brute_force(spark):
    draw = random.Random(8)
    prints, doc = [], 0
    for size, spread in ((1, 0), (40, 3), (25, 2), (120, 4), (1, 0), (60, 1)):
        centre = draw.getrandbits(64)
        for _ in range(size):
            fp = centre
            for bit in draw.sample(range(64), draw.randint(0, spread)):
                fp ^= 1 << bit
            doc += draw.randint(1, 3)
            prints.append((doc, fp))
    prints += [(10_000 + i, draw.getrandbits(64)) for i in range(300)] + [(prints[0][0], prints[0][1]), (None, prints[3][1]), (None, 77)]
    chain = draw.getrandbits(64)
    for k in range(0, 60, 3):
        prints.append((20_000 - k, chain))
        chain ^= 7 << k
    draw.shuffle(prints)
    signed = [(d, fp - (1 << 64) if fp >> 63 else fp) for d, fp in prints]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()]
    assert sorted(got, key=str) == sorted(brute_components(prints), key=str)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    texts = [(5, base), (3, base.upper()), (9, base + " extra"), (1, "other text entirely here"), (2, None), (4, ""), (None, base), (7, "x")]
    frame = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, fp string")
    want = brute_components([(d, slow_fingerprint(t)) for d, t in texts])
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted([(d, f"{fp:016x}", c) for d, fp, c in want], key=str)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def reached_by(fps):
    """The component of each fingerprint, by trying all pairs."""
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(sorted(fps), np.uint64)
    for k, f in enumerate(array):
        for g in array[k + 1 :][np.bitwise_count(array[k + 1 :] ^ f) <= simhash.DISTANCE]:
            parent[find(int(g))] = find(int(f))
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def as_signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_oversized_buckets_are_split(spark):
    from veilspark.llm import common

    draw = np.random.default_rng(3)
    base = int(draw.integers(0, 1 << 62))
    fps = set()
    # two segments alike and the third free, and each segment with a few flips: buckets of very many rows
    for low, bits in simhash.SEGMENTS:
        fps |= {base & ~(((1 << bits) - 1) << low) | int(x) << low for x in draw.integers(0, 1 << bits, 500)}
    fps |= {f ^ (1 << int(draw.integers(0, 64))) ^ (1 << int(draw.integers(0, 64))) for f in list(fps)[::3]}
    fps |= {int(x) for x in draw.integers(0, 1 << 63, 300)}
    frame = spark.createDataFrame([(as_signed(f),) for f in fps], "fp long")
    for limit in (5, 64, 10_000):
        groups = {}
        for r in common.connected_components(simhash.links(frame, limit)).collect():
            groups.setdefault(r.component, set()).add(r.node & (1 << 64) - 1)
        assert sorted(map(sorted, groups.values())) == [g for g in reached_by(fps) if len(g) > 1]


def test_further_keys_lose_no_pair():
    draw = np.random.default_rng(4)
    x = draw.integers(0, 1 << 63, 400).astype(np.uint64)
    y = x.copy()
    for k in range(3):
        y[k:] ^= np.uint64(1) << draw.integers(0, 64, len(y) - k).astype(np.uint64)
    for a, b in zip(x, y):
        pair = np.array([a, b], np.uint64)
        rows, found = simhash.keys(pair)
        shared = [k for k in set(found[rows == 0]) & set(found[rows == 1])]
        assert shared
        met = False
        for key in shared:
            numbers, subs = simhash.further_keys(np.array([key, key]), pair)
            met |= bool(set(subs[numbers == 0]) & set(subs[numbers == 1]))
            numbers, subs = simhash.quarter_keys(np.array([key, key]), pair)
            assert set(subs[numbers == 0]) & set(subs[numbers == 1])
        assert met


def test_one_very_large_bucket(spark):
    """A hundred thousand fingerprints that share two segments."""
    low, bits = simhash.SEGMENTS[2]
    values = np.random.default_rng(6).choice(1 << bits, 100_000, replace=False)
    frame = spark.createDataFrame([(as_signed(int(v) << low | 12345),) for v in values], "fp long")
    from veilspark.llm import common

    found = common.connected_components(simhash.links(frame))
    # so many of two million values lie within three bits of another
    assert found.count() > 99_000 and found.select("component").distinct().count() <= 3


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "end"
    (row,) = simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.component_id == 1 and row.fingerprint == f"{simhash.fingerprint(text):016x}"
