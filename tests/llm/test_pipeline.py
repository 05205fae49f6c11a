import hashlib
import random
from array import array

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F
from test_classifiers import junk, prose
from test_decontaminate import brute
from test_simhash import brute_components, slow_fingerprint

from veilspark.llm import bpe, common, quality, toxicity


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), str(folder / f"{name}.parquet"))


def tables(folder):
    draw = random.Random(12)
    docs, labels, bad = [], [], set()
    items = [(1, prose(draw, 30)), (2, prose(draw, 6)), (3, None)]
    for i in range(500):
        text = junk(draw) if i % 7 == 0 else prose(draw)
        if i % 9 == 0 and i % 7:
            text = text.replace(" ", " slimebag ", 2)
        if i % 50 == 1:
            text += " " + items[0][1]
        if i % 20 == 3 and docs:
            text = docs[-1][1]
        if i % 20 == 4:
            text = docs[-2][1].upper() if i % 40 == 4 else docs[-2][1] + " end"
        # copies are as bad as what they are copies of
        if i % 20 in (3, 4) and docs and docs[i - 1 if i % 20 == 3 else i - 2][0] in bad or i % 20 not in (3, 4) and i % 7 == 0:
            bad.add(i)
        docs.append((i, text, "en", "s", len(text), "clash"))
        if i % 3 == 0:
            labels.append((i, int(i not in bad), int("slimebag" in text)))
    docs += [(600, None, None, None, None, None), (601, "", "en", "s", 0, ""), (None, prose(draw), None, None, 1, None), (10, docs[10][1], "en", "s", 1, "")]
    write(folder, "documents", docs, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.string())]))
    write(folder, "labels", labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    write(folder, "benchmark", items, pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    return docs, items, bad


def one_of_each(docs):
    """The row of each group of near copies with the smallest id, by comparing all pairs."""
    groups: dict = {}
    for k, (_, _, smallest) in enumerate(brute_components([(k, slow_fingerprint(d[1])) for k, d in enumerate(docs)])):
        groups.setdefault(smallest, []).append(docs[k])
    return [min(rows, key=lambda d: (d[0] is None, d[0] or 0)) for rows in groups.values()]


def test_as_brute_force(spark, tmp_path):
    docs, items, bad = tables(tmp_path)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    # the models as the stages learn them, applied here text by text
    frame, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    fold = common.crc_fold
    model = quality.train(frame, labels, fold(F.col("doc_id"), 5) != 0)
    import numpy as np

    scores = quality.scores_of(model, np.array([quality.features(d[1] or "") for d in docs]))
    kept = [d for d, s in zip(docs, scores) if s >= 0.3]
    assert len(kept) > 400 and not any(d[0] in bad for d in kept)
    good = spark.createDataFrame([d[:5] for d in kept], "doc_id long, text string, lang string, source string, n_chars long")
    lexicon = toxicity.train(good, labels, fold(F.col("doc_id"), 3) != 1)
    words = toxicity._Words(toxicity.WideLexicon(lexicon["stems"]))
    mild = quality._sigmoid(np.array([toxicity.features(words, d[1] or "") for d in kept]) @ lexicon["weights"][:-1] + lexicon["weights"][-1])
    kept = [d for d, s in zip(kept, mild) if s < 0.7]
    assert not any("slimebag" in (d[1] or "") for d in kept)
    kept = one_of_each(kept)
    kept = [d for d in kept if not brute([d[:2]], items)[0][5]]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    want = []
    for d in kept:
        ids = theirs.encode_ordinary(d[1] or "")
        want.append((d[0], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tmp_path):
    tables(tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == list(corpus_pipeline.COLUMNS) and made.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_texts_that_share_an_id_are_dropped_apart(spark, tmp_path):
    draw = random.Random(21)
    first, other, leak, clean, nobody = (prose(draw, 60) for _ in range(5))
    write(tmp_path, "benchmark", [(1, leak)], pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    rows = [(1, first), (2, first), (2, other), (3, leak), (3, clean), (None, leak), (None, nobody)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_copies_stage(spark, docs, str(tmp_path)).collect()}
    assert got == set(rows) - {(2, first), (None, leak)}
    got = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()}
    assert got == {r for r in rows if r[1] != leak}


def test_repeats_ties_nulls_and_long_texts(spark, tmp_path):
    draw = random.Random(22)
    text, near, alone, leak = (prose(draw, 80) for _ in range(4))
    write(tmp_path, "benchmark", [(1, leak), (2, None), (None, "")], pa.schema([("item_id", pa.int64()), ("text", pa.string())]))
    long = " ".join(prose(draw, 200) for _ in range(600))
    rows = [(4, text), (4, text), (9, text.upper()), (None, text), (None, near), (None, near), (7, None), (6, ""), (None, " \n"), (3, alone), (5, long), (8, long + " " + leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted([(4, text), (None, near), (6, ""), (3, alone), (5, long)], key=str) == sorted(one_of_each(rows), key=str)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert got == sorted(rows[:-1], key=str)
    write(tmp_path, "labels", [(k, 1, 0) for k in range(3)], pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.toxicity_stage):
        assert sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str) == sorted(rows, key=str)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.tokens_stage(spark, docs, str(tmp_path)).collect()) == sorted(str(i) for i, _ in rows)


def test_a_stage_leaves_no_tables(spark, tmp_path):
    tables(tmp_path)
    common.release(spark)
    corpus_pipeline.run(spark, str(tmp_path)).count()
    from pathlib import Path

    left = sorted(p.name.split("-")[0] for p in Path(common.shared_dir(spark)).glob("veilspark-*/*"))
    assert left == ["byte"]
