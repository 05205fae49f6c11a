import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veilspark.llm import common, quality, toxicity


def prose(draw, n=120):
    return " ".join(("the", "of", "and")[draw.randint(0, 2)] if draw.random() < 0.4 else "".join(draw.choice(("an", "er", "on", "ti", "re", "st")) for _ in range(draw.randint(1, 4))) for _ in range(n)).capitalize() + "."


def junk(draw):
    kind, word = draw.randint(0, 2), prose(draw, 1)
    return (f"{word} " * 90, " ".join(f"{w.upper()}!!" for w in prose(draw).split()), " ".join(f"{w}###" for w in prose(draw).split()))[kind]


def test_prior_and_risk():
    draw = np.random.default_rng(1)
    p, n = draw.normal(2, 1, (3000, 2)), draw.normal(-2, 1, (3000, 2))
    u = np.concatenate([p[:1400], n[:600]])
    model = quality.fit(p[1500:], u)
    assert abs(model["prior"] - 0.7) < 0.1
    assert (quality.scores_of(model, p) > 0.5).mean() > 0.95 and (quality.scores_of(model, n) < 0.3).mean() > 0.95


def frames(spark):
    draw = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        docs.append((i, junk(draw) if bad else prose(draw), "x"))
        if i % 3 == 0:
            labels.append((i, 0 if bad else 1, 0, 9))
    docs += [(1000, None, ""), (1001, "", ""), (None, prose(draw), ""), (1, docs[1][1], "x"), (1002, "é " * 100_000, "")]
    labels += [(None, 1, 1, 9), (3, None, None, 9), (0, 0, 0, 9), (9999, 1, 1, 9)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")


def test_quality(spark):
    docs, labels = frames(spark)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {by[1000].score} and len({r.score for r in got if r.doc_id == 1}) == 1
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in held) >= 0.97 * len(held)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def edits(a, b):
    """Whether b begins with a word within one edit of a, the first letter kept."""
    ways = {a} | {a[:i] + a[i + 1 :] for i in range(1, len(a))} | {a[:i] + c + a[i + 1 :] for i in range(1, len(a)) for c in set(b)} | {a[:i] + c + a[i:] for i in range(1, len(a) + 1) for c in set(b)}
    return any(b.startswith(w) for w in ways)


def test_automaton_as_brute_force():
    stems = {"idiot": 4.0, "scum": 5.0, "worthless": 3.0, "chón": 6.0, "idle": 2.0}
    lexicon, draw = toxicity.Lexicon(stems), random.Random(6)
    words = ["", "i", "idiot", "idiots", "idoit", "idot", "iidiot", "1diot", "idxiot", "scum", "scm", "scumbag", "chónita", "chon", "worthles", "wrthlessly", "xworthless", "idl", "idleness"]
    words += ["".join(draw.choice("idotscumwrhleónx") for _ in range(draw.randint(1, 9))) for _ in range(500)]
    for stem in list(stems) * 60:
        w = list(stem)
        for _ in range(draw.randint(0, 2)):
            at = draw.randrange(len(w) + 1)
            draw.choice([lambda: w.insert(at, draw.choice("abios")), lambda: w and w.pop(min(at, len(w) - 1))])()
        words.append("".join(w))
    for word in words:
        exact = [s for s in stems if word.startswith(s)]
        near = [s for s in stems if len(s) >= toxicity.FUZZY and edits(s, word)]
        want = (max(exact, key=stems.get), 0) if exact else (max(near, key=stems.get), 1) if near else None
        assert lexicon.match(word) == want, word


def test_quotation_is_told_apart():
    words = toxicity._Words(toxicity.Lexicon({"idiot": 5.0}))
    found = lambda text: [(e, q) for _, _, e, q in toxicity.matches(words, text)]
    assert found("You idiot, go away") == [(0, False)]
    assert found('They shouted "you idiot" at us') == [(0, True)]
    assert found("He called them idiot yesterday") == [(0, True)]
    assert found("«idiot»") == [(0, True)] and found("an idoit? no: an idiiot") == [(1, False)]
    assert toxicity.features(words, "you idiot")[0] > toxicity.features(words, '"you idiot"')[0] == 0


def test_toxicity(spark):
    draw, stems = random.Random(9), ("slimebag", "vequ", "grotten")
    docs, labels = [], []
    for i in range(500):
        text, bad = prose(draw, 60).split(), i % 6 == 0
        if bad:
            for _ in range(3):
                text.insert(draw.randint(0, 50), draw.choice(stems) + draw.choice(("", "ment", "s")))
        docs.append((i, " ".join(text), 1))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs += [(900, None, 1), (901, "", 1), (None, "slimebag " * 5, 1), (0, docs[0][1], 1)]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame([*labels, (None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame, known).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == 0 for r in got if r.doc_id in (900, 901)) and all(r.predicted == 1 for r in got if r.doc_id is None)
    assert toxicity.classify(frame.limit(0), known).count() == 0
    assert {r.score for r in toxicity.classify(frame, known.limit(0)).collect()} == {0.0}


def test_folds(spark):
    from zlib import crc32

    got = spark.range(50).select("id", common.crc_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == crc32(str(r.id).encode()) % 5 for r in got)


def alignment(a, b):
    """Edits from a to each prefix of b, a swap of neighbours counting as one; the fewest."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return min(d[-1][1:], default=9)


def test_wide_automaton_as_brute_force():
    stems = {"idiot": 4.0, "scum": 5.0, "worthless": 3.0, "chón": 6.0, "idle": 2.0, "disgusting": 3.5}
    lexicon, draw = toxicity.WideLexicon(stems), random.Random(16)
    words = ["", "s", "1diot", "mdiot", "ediot", "idoit", "diot", "xidiot", "skum", "scvm", "csum", "wrothles", "owrthelss", "disgustign", "idsgutsing", "idiots", "scumbag"]
    words += ["".join(draw.choice("idotscumwrhleónxg") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    for stem in list(stems) * 60:
        w = list(stem)
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(max(1, len(w) - 1))
            w[at : at + 2] = draw.choice([w[at : at + 2][::-1], w[at : at + 1], ["q", *w[at : at + 2]], ["z", *w[at + 1 : at + 2]]])
        words.append("".join(w) + draw.choice(("", "es")))
    for word in words:
        near = [(e, -stems[s], s) for s in stems if (e := alignment(s, word)) <= toxicity.allowed(s)]
        assert lexicon.match(word) == ((min(near)[2], min(near)[0]) if near else None), word
    for word in ("1diot", "mdiot", "ediot", "idoit", "xidiot", "skum", "scvm"):
        assert any(toxicity.features(toxicity._words_of(stems), f"you {word} there")), word


def test_rare_terms_are_learned(spark):
    draw = random.Random(3)
    toxic = [(prose(draw, 20) + (" slimebag" if i % 100 == 0 else "") + " vequ",) for i in range(2500)]
    clean = [(prose(draw, 20),) for _ in range(2500)]
    stems = toxicity.learn_lexicon(*(spark.createDataFrame(x, "text string") for x in (toxic, clean)))
    assert any("slimebag".startswith(s) for s in stems)


def slow_shape(text):
    """The features of a text by plain counting."""
    words = text.split()
    if not words:
        return [0.0] * 20
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    seen, pairs, others, upper, letters = {}, {}, 0, 0, 0
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    for k in range(n - 1):
        pairs[words[k], words[k + 1]] = pairs.get((words[k], words[k + 1]), 0) + 1
    for c in text:
        letters += c.isalpha()
        upper += c.isupper()
        others += not (c.isalnum() or c == "_" or c.isspace() or c in ".,;:!?'\"|()[]{}<>-")
    blocks = [" ".join(words[k : k + 8]) for k in range(0, n, 8)]
    return [
        min(len(str(n)), 6) / 5, len(seen) / n**0.9, sum(words[k] == words[k + 1] for k in range(n - 1)) / n, max(seen.values()) / n, 1 - len(set(lines)) / len(lines),
        min(letters / n, 30) / 10, sum(len(w) > 15 for w in seen) / len(seen), upper / max(1, letters), sum(c.isdigit() for c in text) / len(text), others / len(text),
        text.count("!") / len(text), sum(not w[-1].isalnum() for w in words) / n, text.count("|") / len(text), min(n / len(lines), 200) / 100,
        sum(c in ".?" for c in text) / n, sum(w[0].isupper() for w in words) / n, 1 - len(set(blocks)) / len(blocks), max(pairs.values(), default=0) / n, sum(c in "()[]{}<>" for c in text) / len(text), others / n,
    ]


def test_quality_scores_as_a_plain_version(spark):
    docs, labels = frames(spark)
    more = spark.createDataFrame([(2000, "A (b) [c] {d} <e> | f!!\n\n1 2 3 ## ~~ \u00e9_x\nA (b) [c]", "x"), (2001, "one", "x"), (2002, "same " * 64, "x")], docs.schema)
    docs = docs.union(more)
    model = quality.train(docs, labels, common.crc_fold(F.col("doc_id"), 5) != 0)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    want = []
    for _, text in texts:
        z = [max(-6.0, min(6.0, (x - m) / s)) for x, m, s in zip(slow_shape(text), model["mean"], model["spread"])]
        want.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, model["weights"])) + model["weights"][-1]))))
    got = sorted(((r.doc_id, r.score) for r in quality.classify(docs, labels).collect()), key=lambda r: str(r[0]))
    by = {}
    for (d, _), w in zip(texts, want):
        by.setdefault(d, []).append(w)
    for d, s in got:
        assert min(abs(s - w) for w in by[d]) < 1e-9


def test_the_risk_is_what_is_minimised():
    draw = np.random.default_rng(13)
    p, u = draw.normal(1, 1, (400, 3)), np.concatenate([draw.normal(1, 1, (300, 3)), draw.normal(-1.5, 1, (300, 3))])
    model = quality.fit(p, u)

    def risk(w):
        z = lambda x: np.clip((x - model["mean"]) / model["spread"], -6, 6) @ w[:-1] + w[-1]
        log = lambda t: np.log1p(np.exp(-t))
        c = model["prior"]
        return c * log(z(p)).mean() + max(0.0, log(-z(u)).mean() - c * log(-z(p)).mean()) + quality.PENALTY / 2 * (w @ w)

    best = risk(model["weights"])
    assert abs(model["prior"] - 0.5) < 0.15
    assert all(risk(model["weights"] + step) >= best - 1e-3 for step in draw.normal(0, 0.3, (300, 4)))


def slow_toxicity(stems, text):
    """The features of a text by trying every stem against every word."""
    words, found = text.lower().split(), []
    for k, w in enumerate(words):
        core = w
        while core and not core[0].isalnum():
            core = core[1:]
        while core and not core[-1].isalnum():
            core = core[:-1]
        near = [(e, -stems[s], s) for s in stems if core and (e := alignment(s, core)) <= toxicity.allowed(s)]
        if near:
            e, _, stem = min(near)
            before, after = words[max(0, k - 6) : k], words[k : k + 7]
            strip = lambda t: "".join(c for c in t if c.isalnum())
            said = any(strip(t) in toxicity.REPORTING for t in before[-3:])
            opens = any(t[0] in toxicity.QUOTES and not (len(t) > 1 and t[-1] in toxicity.QUOTES) for t in before) or w[0] in toxicity.QUOTES
            closes = any((c := t.rstrip(".,;:!?"))[-1:] in toxicity.QUOTES and c for t in after)
            found.append((k, stem, e, said or opens and closes))
    if not found:
        return [0.0] * 10
    sure = lambda s, e: not e or e == 1 and len(s) >= 5
    weight = lambda s: stems[s] / 5
    exact = sum(weight(s) for _, s, e, q in found if sure(s, e) and not q and not e)
    edited = sum(weight(s) for _, s, e, q in found if sure(s, e) and not q and e)
    quoted = sum(weight(s) for _, s, e, q in found if sure(s, e) and q)
    short = sum(weight(s) / (1 + q) for _, s, e, q in found if not sure(s, e) and e == 1)
    twice = sum(weight(s) / (1 + q) for _, s, e, q in found if not sure(s, e) and e == 2)
    plain = [(k, weight(s) / (1 + e)) for k, s, e, q in found if sure(s, e) and not q]
    most = max([sum(x for j, x in plain if k - 24 <= j <= k) for k, _ in plain], default=0)
    kinds = len({s for _, s, e, q in found if not e and not q and sure(s, e)})
    return [math.log1p(x) for x in (exact, edited, quoted, 100 * exact / len(words), most)] + [min(kinds, 5) / 5] + [math.log1p(x) for x in (short, twice, 100 * short / len(words), 100 * twice / len(words))]


def test_toxicity_scores_as_a_plain_version(spark):
    draw, stems = random.Random(19), ("slimebag", "vequ", "grotten", "ploombat")
    docs, labels = [], []
    for i in range(240):
        text, bad = prose(draw, 40).split(), i % 4 == 0
        for _ in range(3 * bad):
            w = draw.choice(stems)
            at = draw.randrange(len(w) - 1)
            w = draw.choice([w, w, w[:at] + w[at + 1] + w[at] + w[at + 2 :], w[:at] + "0" + w[at + 1 :], f'"{w}"', f"said {w}", w.upper() + "!", w[:at] + w[at + 1 :]])
            text.insert(draw.randint(0, 30), w)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs += [(900, None), (901, " \n"), (None, "slimebga " * 9), (902, "prose " * 30_000 + "slimebag grottn")]
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, known, common.crc_fold(F.col("doc_id"), 3) != 1)
    assert len(model["stems"]) >= 3
    want = {}
    for d, t in docs[:-1]:
        x = slow_toxicity(model["stems"], t or "")
        want[d] = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(x, model["weights"])) + model["weights"][-1])))
    got = {r.doc_id: r.score for r in toxicity.classify(frame, known).collect()}
    assert all(abs(got[d] - w) < 1e-9 for d, w in want.items()) and 0 <= got[902] <= 1


def test_states_are_forgotten_by_size(monkeypatch):
    stems = {"slimebag": 5.0, "grotwit": 4.0, "vile": 4.5}
    draw = random.Random(31)
    words = ["".join(draw.choice("slimebagrotwv") for _ in range(draw.randrange(3, 11))) for _ in range(300)] + ["slimebga", "limebag", "grottwit", "vlie", "x" * 500]
    want = [toxicity.WideLexicon(stems).match(w) for w in words]
    few = toxicity.WideLexicon(stems)
    monkeypatch.setattr(toxicity, "STATE_BYTES", 20 * toxicity.OF_STATE, raising=False)
    most = 0
    for word, found in zip(words, want):
        assert few.match(word) == found, word
        most = max(most, len(few.states))
    assert most < 60 and sum(map(bool, want)) > 3


def test_a_worker_lets_go_of_what_another_operator_kept(spark):
    import gc
    import weakref

    from veilspark.llm import simhash

    class Here:
        """A frame whose Python function runs in this process."""

        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return list(function(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b c"]})])))

    words = toxicity._words_of({"slimebag": 5.0})
    assert toxicity._words_of({"slimebag": 5.0}) is words
    alive = weakref.ref(words.lexicon)
    del words
    assert simhash.fingerprints(Here())[0].num_rows == 1
    gc.collect()
    assert alive() is None
