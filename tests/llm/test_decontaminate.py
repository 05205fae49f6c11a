import hashlib
import re

from pyspark.sql import functions as F

from veilspark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, bench in items:
            b = words(bench)
            for k in range(max(1, len(b) - 9)) if b else ():
                win = b[k : k + 10]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        named.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


PASSAGE = " ".join(f"term{i % 7}x{i} the" for i in range(12))
ITEMS = [(1, PASSAGE), (2, "short Item"), (10, "the " * 15), (3, None), (4, "..."), (5, "unseen words only in tests never elsewhere at all my dear friend now"), (None, "nobody owns this"), (1, PASSAGE)]
DOCS = [
    (1, "start " + PASSAGE.upper() + " end"),
    (2, " ".join(PASSAGE.split()[3:14]) + "\nfiller, " + " ".join(PASSAGE.split()[:9])),
    (3, "a SHORT, item; and another short item"),
    (4, "the, " * 40),
    (5, None),
    (6, ""),
    (7, "é" * 20_000 + " " + PASSAGE + " " + PASSAGE),
    (8, "clean prose about É nothing"),
    (None, "nobody owns this"),
    (1, "start " + PASSAGE.upper() + " end"),
    (1, "another text of one id"),
    (9, ("the " * 9 + "x ") * 10),
]


def test_as_brute_force(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, item string")
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, term int")
    assert sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=str) == brute(DOCS, ITEMS)
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r.contaminated for r in none)


def test_proximity_ignores_order(spark):
    docs = spark.createDataFrame([(1, "zeta filler alpha more beta"), (2, "alpha then nothing of it"), (3, "alpha beta zeta"), (4, "alpha " + "x " * 40 + "beta zeta")], "doc_id long, text string").coalesce(1)
    tests = decontaminate.test_set(spark.createDataFrame([(1, "alpha beta zeta")], "item_id long, text string"))
    postings = decontaminate.index(docs, tests)
    ranked = decontaminate.anchors(postings, tests)
    ids = {r.row: r.doc_id for r in postings.where("doc_id is not null").collect()}
    assert {ids[r.row] for r in decontaminate.proximity(postings, ranked, slack=2).collect()} == {1, 3}
    assert {ids[r.row] for r in decontaminate.proximity(postings, ranked, slack=60).collect()} == {1, 3, 4}
    assert {ids[r.row] for r in decontaminate.phrases(postings, ranked).collect()} == {3}


def test_postings_are_those_of_all_test_terms(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    tests = decontaminate.test_set(spark.createDataFrame(ITEMS, "item_id long, text string"))
    terms = {r.no: r.term for r in tests.terms.collect()}
    assert set(terms.values()) == {w for _, t in ITEMS for w in words(t)}
    postings = decontaminate.index(docs, tests).collect()
    ids = {r.row: r.doc_id for r in postings if r.no == decontaminate.END}
    got = sorted(((ids[r.row], terms[r.no], r.position) for r in postings if r.no != decontaminate.END), key=str)
    assert got == sorted(((d, w, k) for d, t in DOCS for k, w in enumerate(words(t), 1) if w in terms.values()), key=str)


def test_lower_case_of_every_character(spark):
    docs = spark.range(0x110000).where("id <> 0 and (id < 55296 or id > 57343)").selectExpr("id AS doc_id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    docs = docs.selectExpr("doc_id", "concat('Q', c, 'Z') AS text")
    wrong = docs.select("text", decontaminate.words(F.col("text")).alias("w")).toArrow().to_pylist()
    assert all(words(r["text"]) == r["w"] for r in wrong) and len(wrong) == 0x110000 - 2049


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.common, "BROADCAST_BYTES", 0)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=str) == brute(DOCS, ITEMS)


def test_no_python_and_one_cut_into_words(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert "Python" not in decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
