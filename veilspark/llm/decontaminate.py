"""Benchmark passages in training text, by a positional inverted index queried from the rarest terms on.

DataFrame functions only. One pass over the corpus cuts it into words and stores the postings (row, term, position) of
every term that the test set uses. Counts of terms come from the index; a window of the test set is looked up from its
rarest term on: that term's list, shifted by the term's place in the window, is intersected with the shifted list of the
next rarest, and what is left with the lists of all others. The text is never looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Consecutive words of a window.
WINDOW = 10
#: What stands between words, once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The number of the term that ends each text.
END = -1


def spaced_words(text):
    """A text column's words, A-Z lowered, between an empty string before and one after them. A null text has none."""
    return F.split(F.concat(F.lit(" "), common.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP)


def words(text):
    """Words of a text column; A-Z lowered. A null text has none."""
    found = spaced_words(text)
    return F.slice(found, 2, F.size(found) - 2)


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window) for each run of size words of an item; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))))
    return items.select("item", "words", starts.alias("start")).select("item", F.slice("words", F.col("start"), size).alias("window")).distinct()


@dataclass(frozen=True)
class TestSet:
    """A test set's windows, stored: items (item, win), windows (win, window) of different ones, terms (term, no)."""

    __test__ = False
    items: DataFrame
    windows: DataFrame
    terms: DataFrame


def test_set(benchmark: DataFrame, size: int = WINDOW) -> TestSet:
    every = common.cut(windows_of(benchmark, size), "windows")
    # numbers are fixed by being stored
    windows = common.cut(every.select("window").distinct().select("window", F.monotonically_increasing_id().alias("win")), "windows")
    terms = common.cut(windows.select(F.explode("window").alias("term")).distinct().select("term", F.monotonically_increasing_id().alias("no")), "terms")
    return TestSet(common.cut(every.join(windows, "window").select("item", "win"), "items"), windows, terms)


test_set.__test__ = False


def index(docs: DataFrame, tests: TestSet) -> DataFrame:
    """The stored index of docs for a test set: postings (row, no, position, doc_id), positions from 1 on.

    row numbers the rows of docs, so rows that share an id or are repeated are told apart; doc_id is null but in the posting
    of the term END, which each row has one word after its last.
    """
    wanted = tests.terms.select("term", "no").union(docs.sparkSession.sql(f"SELECT '' AS term, {END}L AS no"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), spaced_words(F.col("text").cast("string")).alias("words"))
    tokens = rows.select("row", "doc_id", F.posexplode("words").alias("position", "term")).where("position > 0")
    return common.cut(tokens.join(common.small(wanted), "term").select("row", "no", "position", F.when(F.col("no") == END, F.col("doc_id")).alias("doc_id")), "postings")


def anchors(postings: DataFrame, tests: TestSet) -> DataFrame:
    """(win, size, ranked), stored, for each window whose terms all occur: their numbers and offsets, rarest first by counts over the whole corpus."""
    counts = postings.where(F.col("no") != END).groupBy("no").agg(F.count("*").alias("n"))
    places = tests.windows.select("win", F.size("window").alias("size"), F.posexplode("window").alias("offset", "term"))
    # an inner join: a window with a word that no document has can't occur
    ranked = places.join(tests.terms, "term").join(counts, "no").groupBy("win", "size").agg(F.array_sort(F.collect_list(F.struct("n", "no", "offset"))).alias("ranked"))
    return common.cut(ranked.where("size(ranked) = size"), "anchors")


def _lists(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("no") != END).select("row", "no", "position")


def _of_rows(lists: DataFrame, some: DataFrame) -> DataFrame:
    """The postings in rows of some, dropped before any shuffle if those rows are few."""
    rows = common.cut(some.select("row").distinct(), "rows")
    marked = common.small(rows)
    return lists.join(marked, "row", "left_semi") if marked is not rows else lists


def phrases(postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(row, start, win, length), stored, of every occurrence of a window, exactly."""
    lists = _lists(postings)
    firsts = common.small(common.cut(ranked.selectExpr("win", "size", "ranked[0].no AS no", "ranked[0].offset AS ahead", "get(ranked, 1).no AS next", "get(ranked, 1).offset AS further"), "firsts"))
    begun = lists.join(firsts, "no").select("row", (F.col("position") - F.col("ahead")).alias("start"), "win", "size", "next", "further").where("start > 0")
    one = begun.where("size = 1").select("row", "start", "win", "size")
    seconds = common.small(common.cut(ranked.selectExpr("get(ranked, 1).no AS no").where("no IS NOT NULL").distinct(), "seconds"))
    shifted = begun.where("size > 1").select("row", "start", "win", "size", F.col("next").alias("no"), (F.col("start") + F.col("further")).alias("position"))
    two = common.cut(shifted.join(lists.join(seconds, "no", "left_semi"), ["row", "position", "no"]).select("row", "start", "win", "size"), "pairs")
    more = two.where("size > 2")
    others = common.small(common.cut(ranked.where("size > 2").selectExpr("win", "slice(ranked, 3, size) AS others"), "others"))
    expected = more.join(others, "win").select("row", "start", "win", "size", F.explode("others").alias("o")).selectExpr("row", "start", "win", "size", "o.no AS no", "start + o.offset AS position")
    there = expected.join(_of_rows(lists, more), ["row", "position", "no"])
    whole = there.groupBy("row", "start", "win", "size").agg(F.count("*").alias("n")).where("n = size - 2").select("row", "start", "win", "size")
    return common.cut(one.union(two.where("size = 2")).union(whole).withColumnRenamed("size", "length"), "hits")


def proximity(postings: DataFrame, ranked: DataFrame, slack: int = 0) -> DataFrame:
    """(row, win, position) of a window's rarest term where all its terms are among the words around, in any order: up to
    size - 1 + slack words away. Terms meet by blocks of positions, so a long text is no single group."""
    lists = _lists(postings)
    near = ranked.selectExpr("win", f"size - 1 + {int(slack)} AS reach", "ranked[0].no AS no", "array_except(array_distinct(ranked.no), array(ranked[0].no)) AS others")
    begun = lists.join(common.small(common.cut(near, "near")), "no")
    alone = begun.where("size(others) = 0").select("row", "win", "position")
    block = 64
    asked = begun.select("row", "win", "position", "reach", F.size("others").alias("needed"), F.explode("others").alias("no")).select(
        "*", F.explode(F.expr(f"sequence((position - reach) div {block}, (position + reach) div {block})")).alias("block")
    )
    found = asked.join(lists.select("row", "no", F.col("position").alias("there"), F.expr(f"position div {block}").alias("block")), ["row", "no", "block"]).where("abs(there - position) <= reach")
    met = found.select("row", "win", "position", "needed", "no").distinct().groupBy("row", "win", "position", "needed").agg(F.count("*").alias("n"))
    return alone.union(met.where("n = needed").select("row", "win", "position")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    A word is hit inside any occurrence of a window; hits of overlapping windows count once. Null texts have no
    words; null doc_ids are kept; rows repeated with id and text give a row each; a null item_id is the item named
    null; repeated items and windows count once; without benchmark rows nothing is hit; an empty docs table gives an
    empty one; other columns are ignored. Texts may be of any length: postings of one text are spread by position, its
    hits are merged in order without being held, and only the names of its items come together.
    """
    tests = test_set(benchmark, size)
    postings = index(docs, tests)
    found = phrases(postings, anchors(postings, tests))
    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    upto = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), upto - F.greatest(F.coalesce(F.max(upto).over(before), F.lit(0)), F.col("start")))
    covered = found.select("row", "start", "length").distinct().select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.select("row", "win").distinct().join(common.small(tests.items), "win").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    ends = postings.where(F.col("no") == END).select("row", "doc_id", (F.col("position") - 1).cast("long").alias("n_words"))
    return (
        ends.join(covered.join(named, "row"), "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


#: contamination() of documents by benchmark, in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS gram, least(10, len(w)) AS size
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
starts AS (
    SELECT doc_id, text, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS gram
    FROM (SELECT doc_id, text, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)
), hits AS (
    SELECT s.doc_id, s.text, s.i, s.size, item FROM starts s JOIN windows x ON s.gram = x.gram AND s.size = x.size
), covered AS (
    SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(range(i, i + size)) AS p FROM hits) GROUP BY ALL
), named AS (
    SELECT doc_id, text, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, text, item FROM hits) GROUP BY ALL
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d
LEFT JOIN covered c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text IS NOT DISTINCT FROM c.text
LEFT JOIN named n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.text IS NOT DISTINCT FROM n.text
"""
