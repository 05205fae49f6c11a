"""Near duplicates by SimHash, found through nearby codewords of the Golay code.

Two fingerprints of 64 bits with at most 3 differing bits, cut to three segments, have at most one differing bit in
at least two of them. The perfect (23, 12) Golay code maps a segment to the index of its nearest codeword; the
indices nearest to the segment or to any of its one-bit neighbours are few (six for most segments, else one). So
the index pair of one fingerprint is among the index pairs of any other that is near enough, for some pair of
segments: rows keyed by those pairs meet, and are verified by their full distance.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
WORDS = 3
DISTANCE = 3
#: (lowest bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Groups of up to so many rows are compared by shifting whole batches.
SHIFTS = 8
#: Rows of a bucket that are compared at once; the rows of a larger one are dealt out by further keys first.
LIMIT = 4096

_TABLES: dict = {}


def golay():
    """(remainder of a 12-bit message, nearest index's offset by syndrome, offsets of nearby indices by segment and syndrome)."""
    import numpy as np

    if not _TABLES:
        def remainder(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        messages = np.array([remainder(m << 11) for m in range(4096)], np.int64)
        patterns = [0] + [1 << i for i in range(23)]
        patterns += [1 << i | 1 << j for i in range(23) for j in range(i)]
        patterns += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        error = np.zeros(2048, np.int64)
        for p in patterns:
            error[remainder(p)] = p

        def nearest(word: int) -> int:
            return (word ^ int(error[remainder(word)])) >> 11

        near = []
        for _, bits in SEGMENTS:
            # of a word with error e, relative to its own codeword; -1 fills up
            rows = [sorted({nearest(int(e) ^ (1 << i)) for i in range(bits)} | {0}) for e in error]
            table = np.full((2048, max(map(len, rows))), -1, np.int64)
            for k, row in enumerate(rows):
                table[k, : len(row)] = row
            near.append(table)
        _TABLES["golay"] = messages, error >> 11, near
    return _TABLES["golay"]


def indices(fingerprints, segment: int):
    """(index of the nearest codeword, nearby indices with -1 for none) of a segment of each fingerprint."""
    import numpy as np

    messages, offset, near = golay()
    low, bits = SEGMENTS[segment]
    word = ((fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    syndrome = (word & 2047) ^ messages[word >> 11]
    own = (word >> 11) ^ offset[syndrome]
    table = near[segment][syndrome]
    return own, np.where(table < 0, -1, own[:, None] ^ table)


def keys(fingerprints):
    """(row numbers, keys): every pair of nearby indices of every pair of segments."""
    import numpy as np

    found = [indices(fingerprints, s)[1] for s in range(3)]
    rows, out = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y = found[a][:, :, None], found[b][:, None, :]
        good = np.nonzero((x >= 0) & (y >= 0))
        rows.append(good[0])
        out.append((number << 24) + ((x << 12) + y)[good])
    return np.concatenate(rows), np.concatenate(out)


def _mixed(key, kind: int, value):
    """A key for each row from a bucket's key and a value; rows that share one by chance are compared and found to differ."""
    import numpy as np

    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1) + value.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


def further_keys(key, fingerprints):
    """(row numbers, keys) that split an index pair's bucket so that any two near rows of it which it has to find still meet.

    They have one differing bit at most in either segment of the pair. If they have one at most in the third segment too, they
    meet by its nearby indices; else by the bits of that segment of the pair in which they do not differ.
    """
    import numpy as np

    rows, out = [], []
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        own = np.flatnonzero(key >> 24 == number)
        if not len(own):
            continue
        near = indices(fingerprints[own], 3 - a - b)[1]
        good = np.nonzero(near >= 0)
        rows.append(own[good[0]])
        out.append(_mixed(key[rows[-1]], 1, near[good]))
        for kind, (low, bits) in ((2, SEGMENTS[a]), (3, SEGMENTS[b])):
            rows.append(own)
            out.append(_mixed(key[own], kind, (fingerprints[own] >> np.uint64(low)) & np.uint64((1 << bits) - 1)))
    return np.concatenate(rows), np.concatenate(out)


def quarter_keys(key, fingerprints):
    """(row numbers, keys) that split any bucket: of four sets of bits, every fourth each, three differing bits leave one alike."""
    import numpy as np

    masks = [np.uint64(sum(1 << bit for bit in range(k, 64, 4))) for k in range(4)]
    return np.tile(np.arange(len(key)), 4), np.concatenate([_mixed(key, 4 + k, fingerprints & m) for k, m in enumerate(masks)])


def fingerprint(text: str | None) -> int:
    """A bit is set if it is in over half of the XXH64 hashes of the word shingles; A-Z lowered; 0 without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - WORDS + 1)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts, hashed = [0, *(e + 1 for e in ends)], xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for block in range(0, n, 1 << 16):
        some = b"".join([hashed(line[s:e], SEED) for s, e in zip(starts[block : min(n, block + (1 << 16))], ends[block + min(WORDS, len(words)) - 1 :])])
        counts += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long. A null text has no words."""
    common.small_batches(docs.sparkSession)

    def run(batches):
        import numpy as np

        common.kept("simhash")
        for batch in batches:
            fps = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(fps):
    """Links (a, b) that join all of fps that a chain of near ones joins; one link less than fingerprints in each chain.

    Each fingerprint takes what is near it out of those left, so a dense group costs little more than its size.
    """
    import numpy as np

    left, links = fps, []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            close = np.bitwise_count(left ^ at) <= DISTANCE
            if close.any():
                found = left[close]
                links += [(at, b) for b in found]
                frontier += list(found)
                left = left[~close]
    return links


def _close_pairs(key, fp):
    """Links (a, b) in whole groups of rows sorted by key, enough to join all that chains of near ones join."""
    import numpy as np

    a, b = [], []
    size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
    of_row = np.repeat(size, size)
    small = of_row <= SHIFTS
    k, f = key[small & (of_row > 1)], fp[small & (of_row > 1)]
    for shift in range(1, SHIFTS):
        near = (k[shift:] == k[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= DISTANCE)
        a.append(f[:-shift][near])
        b.append(f[shift:][near])
    begins = np.cumsum(size) - size
    for g in np.flatnonzero(size > SHIFTS):
        found = forest(fp[begins[g] : begins[g] + size[g]])
        if found:
            x, y = zip(*found)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
    return np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)


def _matched(keyed: DataFrame, limit: int | None) -> DataFrame:
    """(a, b, key) for rows (key, fp): links between near rows of a key, with a null key; and the rows a of keys with over limit rows, with their key."""

    def match(batches):
        import numpy as np

        def out(a, b, key):
            arrays = [pa.array(x.view(np.int64), pa.int64()) for x in (a, b)]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(a), pa.int64()) if key is None else pa.array(key, pa.int64())], names=["a", "b", "key"])

        def whole(key, fp):
            """What becomes of rows whose groups are whole."""
            if limit is not None:
                size = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
                many = np.repeat(size, size) > limit
                if many.any():
                    yield out(fp[many], fp[many], key[many])
                    key, fp = key[~many], fp[~many]
            if len(key):
                yield out(*_close_pairs(key, fp), None)

        parts, passing = [], None
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            if passing is not None:
                # more rows of a key that is known to have too many
                n = int(np.searchsorted(key, passing, side="right"))
                if n:
                    yield out(fp[:n], fp[:n], key[:n])
                    key, fp = key[n:], fp[n:]
                if not len(key):
                    continue
                passing = None
            parts.append((key, fp))
            if parts[0][0][0] == key[-1] and (limit is None or sum(len(k) for k, _ in parts) <= limit):
                continue  # one group so far, which may go on
            key, fp = (np.concatenate(x) for x in zip(*parts))
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield from whole(key[:end], fp[:end])
            parts = [(key[end:], fp[end:])]
            if limit is not None and len(key) - end > limit:
                passing = key[-1]
                yield out(fp[end:], fp[end:], key[end:])
                parts = []
        if parts:
            yield from whole(*(np.concatenate(x) for x in zip(*parts)))

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(match, "a long, b long, key long")


def _keyed(rows: DataFrame, make) -> DataFrame:
    """(key, fp) for rows (key, fp), by a function that gives row numbers and new keys."""

    def emit(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                key, fps = some.column(0).to_numpy(), some.column(1).to_numpy().view(np.uint64)
                numbers, found = make(key, fps)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(fps[numbers].view(np.int64), pa.int64())], names=["key", "fp"])

    return rows.mapInArrow(emit, "key long, fp long")


def links(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between different near fingerprints of a frame (fp): enough to join all that chains of near ones join.

    Rows of a bucket of over limit rows are dealt out by further keys, and where these still gather too many, by a fourth of
    their bits at a time, so what is compared does not grow with the square of a bucket.
    """
    common.small_batches(distinct.sparkSession)
    # a fingerprint makes up to 108 rows, so the few bytes of fingerprints are dealt out first
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select(F.lit(0).cast("long").alias("key"), "fp").repartition(tasks)
    found = []
    for make, most in ((lambda key, fps: keys(fps), limit), (further_keys, limit), (quarter_keys, None)):
        made = common.cut(_matched(_keyed(rows, make), most), "links")
        found.append(made.where("key IS NULL").select("a", "b"))
        rows = made.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct()


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, fp): component_id is the smallest doc_id that links reach.

    Exact copies share a fingerprint and are reduced to it before the search, so a group of copies costs one row.
    """
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    joined = common.cut(common.connected_components(links(distinct)), "joined").withColumnRenamed("node", "fp")
    roots = joined.join(distinct, "fp")
    smallest = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    # a component with very many fingerprints is pre-aggregated above, and its join is broadcast or split as it runs
    linked = joined.join(common.small(common.cut(smallest, "smallest")), "component").select("fp", "component_id")
    reached = common.cut(distinct.join(linked, "fp", "left").select("fp", F.least("first", "component_id").alias("component_id")), "reached")
    return prints.join(common.small(reached), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    A null text counts as empty; texts without words have fingerprint 0, linked like any other. Null doc_ids are
    kept, and are a component's smallest only (as null) if it has no other. Repeated rows and ties share a
    component; an empty table gives an empty one; other columns are ignored. A text of any length takes memory
    in proportion to itself alone.
    """
    prints = common.cut(fingerprints(docs), "prints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
