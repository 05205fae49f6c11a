import hashlib
import re

from pyspark.sql import functions as F

from veilspark.llm import chat

SAID = "\\### Assistant: </turn> ok"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv_id, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        out[conv_id] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


ROWS = [
    (-7, 0, "user", SAID),
    (-7, 1, "assistant", SAID),
    (1, 0, "system", "be & <kind> &amp;lt; &lt;"),
    *[(1, k, "user" if k % 2 else "assistant", f"word {k} " * (k % 7) + "é🙂</turn>\n<turn 0 target assistant>") for k in range(1, 40)],
    (2, 0, "user", None),
    (2, 1, None, ""),
    (2, 1, None, ""),
    (2, None, "assistant", "first"),
    (None, 3, "assistant", "nobody's"),
    (3, 5, "assistant", "long " * 5000),
    (4, 1, "assistant", ""),
]


def check(spark, **options):
    frame = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, window string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(frame, **options).collect()}
    assert got == brute(ROWS)
    return frame


def test_round_trip_whole(spark):
    frame = check(spark)
    assert chat.digests(frame.limit(0)).count() == 0


def spans_of(rows, budget, history):
    """{conv_id: [(own positions, repeated positions)]} by going through each conversation."""
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv_id, turns in by.items():
        turns.sort()
        size = [len(re.split(r"\s+", x)) + 1 for _, _, x in turns]
        system = size[0] if turns[0][1] == "system" and size[0] < budget else 0
        wide, at, cells = budget - system, 0, {}
        for p, n in enumerate(size):
            if p == 0 and system:
                cells.setdefault(0, ([], []))[1].append(0)
                continue
            crosses = at // wide != (at + n - 1) // wide
            cells.setdefault((at + n) // wide if crosses else at // wide, ([], []))[0 if crosses else 1].append(p)
            at += n
        found = []
        for crossing, rest in cells.values():
            own = sum(size[p] for p in crossing + rest if p or not system)
            found += [crossing + rest] if not crossing or not rest or own <= wide else [crossing, rest]
        found.sort()
        out[conv_id] = []
        for own in found:
            left = budget - system - sum(size[p] for p in own if p or not system)
            again = [0] if system and own[0] and left >= 0 else []
            for p in range(own[0] - 1, max(-1, own[0] - 1 - history), -1):
                left -= size[p] if p or not system else 0
                if left >= 0 and p not in again:
                    again.append(p)
            out[conv_id].append((own, sorted(again), sum(size[p] for p in own + again)))
    return out


def test_windows_keep_to_the_budget(spark):
    for budget, history, block in ((12, 3, 4), (40, 2, 4096), (64, 9, 7), (1, 0, 1), (100_000, 2, 16)):
        frame = check(spark, budget=budget, history=history, block=block)
        made = chat.windows(frame, budget=budget, history=history, block=block)
        got, tokens = {}, {(r.conv_id, r.window): (r.tokens, r.over) for r in made.collect()}
        for row in chat.parse(made).orderBy("window").collect():
            own, again = ([t.position for t in row.turns if (t.kind == "repeat") == k] for k in (False, True))
            n, over = tokens[row.conv_id, row.window]
            got.setdefault(row.conv_id, []).append((own, again, n))
            assert own == list(range(own[0], own[-1] + 1)) and own[0] == row.window
            assert over == (n > budget) and (not over or len(own) == 1 and not again)
        assert got == spans_of(ROWS, budget, history)
    assert len(spans_of(ROWS, 64, 9)[1]) > 5 and any(again[:1] == [0] and len(again) > 2 for _, again, _ in spans_of(ROWS, 64, 9)[1])


def test_masks_are_offsets_of_targets(spark):
    made = chat.windows(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")).where(F.col("conv_id") == -7).first()
    (span,) = made.loss_spans
    inside = made.formatted[span.start : span.start + span.length]
    assert inside.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&") == SAID
    assert made.formatted.count("</turn>") == 2
