"""Chat formatting in turn-aligned windows under a token budget, with a loss mask that counts each target once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Tokens (words, and one for the turn's marks) in a window, with history and system turn.
BUDGET = 256
#: Turns of history that a window repeats, as far as they fit.
HISTORY = 2
#: Turns numbered together in one task; longer conversations are numbered block by block.
BLOCK = 4096


def _escape(text: str) -> str:
    """SQL that makes control strings impossible inside a text: no < and > remain, and & starts an entity."""
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _unescape(text: str) -> str:
    return f"replace(replace(replace({text}, '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"


def _numbered(turns: DataFrame, budget: int, block: int) -> DataFrame:
    """Turns (conv_id, position, role, text, tokens, system, start, stop), stored.

    system is the tokens of a conversation's system turn that is repeated in each window, else 0. The other turns lie one
    after another from 0 on, each from start up to stop; the repeated one takes no place.
    """
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("*", F.floor(F.col("turn") / block).alias("block"), (F.size(F.split("text", r"\s+")) + 1).cast("long").alias("tokens"))
    inside = W.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.select("*", F.row_number().over(inside).alias("nth"), F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    upto = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        t.groupBy("conv_id", "block")
        .agg(F.count("*").alias("n"), F.sum("tokens").alias("s"), F.max(F.when(F.col("nth") == 1, F.struct("role", "tokens"))).alias("head"))
        .select(
            F.col("conv_id").alias("b_conv"),
            F.col("block").alias("b_block"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
            F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"),
            F.first("head").over(upto).alias("head"),
        )
    )
    system = F.when((F.col("head.role") == "system") & (F.col("head.tokens") < budget), F.col("head.tokens")).otherwise(0)
    placed = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))).select(
        "conv_id", (F.col("n_before") + F.col("nth") - 1).alias("position"), "role", "text", "tokens", system.alias("system"), (F.col("s_before") + F.col("upto") - system).alias("stop")
    )
    return common.cut(placed.withColumn("start", F.when((F.col("position") == 0) & (F.col("system") > 0), 0).otherwise(F.col("stop") - F.col("tokens"))), "turns")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Formats turns (conv_id, turn, role, text) to (conv_id, window, tokens, over, formatted, loss_spans).

    Turns go by turn, then role and text, so ties and repeated rows have a fixed order and all count. Prefix sums of turn
    tokens lay a conversation out in cells as wide as the budget leaves beside its system turn. The turns that lie
    within one cell are a span; a turn that crosses into another cell joins the span of the cell that it ends in if that
    fits, else it is a span of its own. So spans are aligned to turns and found without going through a conversation
    turn by turn. Every span but the first repeats the system turn, if the first turn is one, and up to `history` turns
    before it, the last ones first, as far as the budget allows; repeated turns are marked and never under the loss mask, so
    each assistant text is a target once. tokens, with all that is repeated, are within the budget, but where one turn
    alone is not: then over is true, and nothing is repeated. A system turn that fills the budget is like any other.
    window is the position of the span's first turn. loss_spans are (start, length) in code points of formatted, of
    escaped assistant texts.

    Null role or text is the empty text; null conv_id is a conversation of its own, null turns come first; an
    empty table gives an empty one; other columns are ignored. Long conversations are numbered in blocks of
    turn // block: only one row per block meets in a task, and history is matched by (conv_id, position). Turns of one
    block are sorted in one task, which spills; a window's texts, which the budget bounds, are all that is held.
    """
    cell = F.lit(budget) - F.col("system")
    t = _numbered(turns, budget, block)
    first, last = F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell)
    crosses = (first != last) & (F.col("stop") > F.col("start"))
    t = t.select("*", crosses.alias("crosses"), F.when(crosses, F.floor(F.col("stop") / cell)).otherwise(first).alias("cell"))
    # a crossing turn and the span of the cell it ends in are one window where they fit, as decided here and again with the texts
    length = F.col("stop") - F.col("start")
    one = F.col("crossing").isNotNull() & F.col("rest").isNotNull() & (F.col("crossing.length") + F.col("rest.length") <= cell)
    parts = t.groupBy("conv_id", "cell", "system").agg(
        F.max(F.when(F.col("crosses"), F.struct("position", "start", length.alias("length")))).alias("crossing"),
        F.sum(F.when(~F.col("crosses"), length)).alias("sum"),
        F.min(F.when(~F.col("crosses"), F.struct("position", "start"))).alias("begin"),
    )
    parts = parts.withColumn("rest", F.when(F.col("begin").isNotNull(), F.struct("begin.position", "begin.start", F.col("sum").alias("length"))))
    both = F.struct("crossing.position", "crossing.start", (F.col("crossing.length") + F.col("rest.length")).alias("length"))
    spans = parts.select("conv_id", "cell", "system", F.explode(F.when(one, F.array(both)).otherwise(F.filter(F.array("crossing", "rest"), lambda s: s.isNotNull()))).alias("span"))
    # what a span leaves of the budget; the first has the system turn itself
    room = F.lit(budget) - F.col("system") - F.col("span.length")
    spans = spans.where("span.position > 0").select("conv_id", "cell", "system", "span.position", "span.start", room.alias("room")).where("room >= 0")
    wanted = spans.select(
        F.col("conv_id").alias("w_conv"),
        F.col("cell").alias("w_cell"),
        F.col("position").alias("w_span"),
        F.col("start").alias("w_start"),
        "room",
        F.explode(F.expr(f"array_union(if(system > 0, array(0L), array()), sequence(greatest(0L, position - {int(history)}), position - 1))" if history else "if(system > 0, array(0L), array())")).alias("w_position"),
    )
    fits = (F.col("w_start") - F.col("start") <= F.col("room")) & (F.col("position") >= F.col("w_span") - history)
    repeated = (
        wanted.join(t, F.col("w_conv").eqNullSafe(F.col("conv_id")) & (F.col("w_position") == F.col("position")))
        .where(fits | (F.col("position") == 0) & (F.col("system") > 0))
        .select("conv_id", F.col("w_cell").alias("cell"), "position", F.lit("repeat").alias("kind"), "role", "text", "tokens", "system", F.lit(0).cast("long").alias("length"), F.col("w_span").alias("span"))
    )
    own = t.select(
        "conv_id", "cell", "position", F.when(F.col("role") == "assistant", "target").otherwise("input").alias("kind"), "role", "text", "tokens", "system", length.alias("length"),
        F.when(F.col("crosses"), F.col("position")).alias("span"),
    )
    held = own.unionByName(repeated).groupBy("conv_id", "cell", "system").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "role", "text", "tokens", "length", "span"))).alias("parts"))
    # the crossing turn, if there is one, comes before the others of its cell; a repeated turn names the span that it is for
    crossing = "filter(parts, p -> p.kind <> 'repeat' and p.span is not null)"
    held = held.withColumn("at", F.expr(f"get({crossing}, 0).position"))
    too_long = f"exists(parts, p -> p.kind <> 'repeat' and p.span is null) and aggregate(parts, 0L, (n, p) -> n + p.length) > {int(budget)} - system"
    split = f"if(at is not null and {too_long}, array(filter(parts, p -> p.span <=> at), filter(parts, p -> not p.span <=> at)), array(parts))"
    grouped = held.select("conv_id", F.explode(F.expr(split)).alias("parts")).select(
        "conv_id",
        F.expr("filter(parts, p -> p.kind <> 'repeat')[0].position").alias("window"),
        F.expr("aggregate(parts, 0L, (n, p) -> n + p.tokens)").alias("tokens"),
        "parts",
    )
    pieces = f"""transform(parts, p -> named_struct(
        'kind', p.kind,
        'head', concat('<turn ', p.position, ' ', p.kind, ' ', {_escape('p.role')}, '>'),
        'body', {_escape('p.text')}))"""
    spans = """aggregate(pieces, named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
        (acc, p) -> named_struct(
            'at', acc.at + length(p.head) + length(p.body) + length('</turn>\\n'),
            'spans', if(p.kind = 'target',
                concat(acc.spans, array(named_struct('start', acc.at + length(p.head), 'length', cast(length(p.body) as bigint)))),
                acc.spans)),
        acc -> acc.spans)"""
    return grouped.select("conv_id", "window", "tokens", F.expr(pieces).alias("pieces")).select(
        "conv_id",
        "window",
        "tokens",
        (F.col("tokens") > budget).alias("over"),
        F.expr("array_join(transform(pieces, p -> concat(p.head, p.body, '</turn>\\n')), '')").alias("formatted"),
        F.expr(spans).alias("loss_spans"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads windows back: (conv_id, window, turns, losses), from formatted and loss_spans alone.

    turns are (position, kind, role, text) with repeats; losses the unescaped texts under the mask, in order.
    """
    mark = r"(?s)^<turn ([0-9]+) ([a-z]+) ([^>]*)>(.*)$"

    def got(k: int) -> str:
        return f"regexp_extract(x, '{mark}', {k})"

    turns = f"""transform(filter(split(formatted, '</turn>\\n'), x -> x <> ''), x -> named_struct(
        'position', cast({got(1)} as bigint), 'kind', {got(2)}, 'role', {_unescape(got(3))}, 'text', {_unescape(got(4))}))"""
    losses = f"transform(loss_spans, s -> {_unescape('substring(formatted, cast(s.start + 1 as int), cast(s.length as int))')})"
    return formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.expr(turns).alias("turns"), F.expr(losses).alias("losses"))


def digests(turns: DataFrame, **options) -> DataFrame:
    """Per conversation, what its windows read back to: turn count, digest of turns, and digest of texts under the loss mask.

    A digest of a whole conversation needs its text in one row, so the last aggregation holds one conversation at a time.
    """
    read = parse(windows(turns, **options)).select(
        "conv_id",
        "window",
        "chars",
        F.expr("filter(turns, t -> t.kind <> 'repeat')").alias("own"),
        F.expr("array_join(losses, '')").alias("loss"),
    )
    whole = read.select(
        "conv_id",
        "window",
        "chars",
        F.size("own").cast("long").alias("n"),
        F.expr("array_join(transform(own, t -> concat(t.role, '\\n', t.text, '\\n')), '')").alias("said"),
        "loss",
    )
    return (
        whole.groupBy("conv_id")
        .agg(
            F.sum("n").alias("n_turns"),
            F.array_sort(F.collect_list(F.struct("window", "said"))).alias("said"),
            F.array_sort(F.collect_list(F.struct("window", "loss"))).alias("lost"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "n_turns",
            F.sha2(F.array_join("said.said", "").cast("binary"), 256).alias("turns_sha256"),
            F.length(F.array_join("lost.loss", "")).cast("long").alias("loss_chars"),
            F.sha2(F.array_join("lost.loss", "").cast("binary"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


#: digests() of conversations and of one with control strings, in DuckDB's SQL.
ORACLE_SQL = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
    SELECT *, row_number() OVER o - 1 AS pos, first_value(CASE WHEN role = 'system' AND tok < {BUDGET} THEN tok ELSE 0 END) OVER o AS sys
    FROM (SELECT *, len(regexp_split_to_array(text, '\s+')) + 1 AS tok FROM t) WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
    SELECT *, sum(eff) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, {BUDGET} - sys AS cell
    FROM (SELECT *, CASE WHEN pos = 0 AND sys > 0 THEN 0 ELSE tok END AS eff FROM n)
), k AS (
    SELECT *, upto - eff AS before, eff > 0 AND (upto - eff) // cell <> (upto - 1) // cell AS crosses FROM p
), spans AS (
    SELECT conv_id, 2 * (before // cell) + CASE WHEN crosses THEN 1 ELSE 0 END AS span, sum(eff) AS s FROM k GROUP BY ALL
), w AS (
    SELECT k.*, CASE WHEN crosses AND k.eff + j.s <= cell THEN j.span ELSE 2 * (before // cell) + CASE WHEN crosses THEN 1 ELSE 0 END END AS win
    FROM k LEFT JOIN spans j ON k.crosses AND j.conv_id IS NOT DISTINCT FROM k.conv_id AND j.span = 2 * (k.upto // k.cell)
), starts AS (
    SELECT conv_id, win, sys, min(pos) AS start, min(before) AS place, {BUDGET} - sys - sum(eff) AS room FROM w GROUP BY conv_id, win, sys HAVING min(pos) > 0 AND {BUDGET} - sys - sum(eff) >= 0
), pieces AS (
    SELECT conv_id, pos, CASE WHEN role = 'assistant' THEN 'target' ELSE 'input' END AS kind, role, text FROM w
    UNION ALL SELECT w.conv_id, w.pos, 'repeat', role, text FROM starts s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id
        AND (w.pos BETWEEN s.start - {HISTORY} AND s.start - 1 AND s.place - w.before <= s.room AND NOT (w.pos = 0 AND s.sys > 0) OR w.pos = 0 AND s.sys > 0)
), f AS (
    SELECT conv_id, sum(length('<turn ' || pos || ' ' || kind || ' ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>'
        || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</turn>' || chr(10))) AS chars FROM pieces GROUP BY ALL
), g AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256
    FROM w GROUP BY conv_id
)
SELECT g.*, CAST(f.chars AS BIGINT) AS formatted_chars FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id
"""
