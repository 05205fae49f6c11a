"""A word language model with latent states: Baum-Welch over partitions, and exact likelihoods of whole texts.

The most frequent words have an emission probability in every state. All other words, seen or not, share one class
that states emit, within which a word's probability depends on its corpus count alone; that factor is the same
in every state, so a text's likelihood is the forward recursion over classes times the factors of its rare words,
which join the vocabulary in a shuffle. So no task ever holds the vocabulary.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STATES = 8
#: Words with emission probabilities of their own, at most; they and their counts are broadcast, and a class takes two bytes.
HEAD = 65_535
#: Steps of a doubling of counts, by which the most frequent words are told from the rest.
STEPS = 64
#: Baum-Welch ends with the round that adds less than this part to the log likelihood (with the priors' part).
SETTLED = 1e-4
#: Tokens, of all sequences together, that a training pass takes at a time; messages are handed on from piece to piece.
PIECE = 400_000
#: Tokens, of whole steps, whose emissions and counts are gone through while they are in a core's cache.
BLOCK = 8_000
#: Steps after which forward probabilities are scaled; a product of so many stays far from the least double.
RESCALE = 8
#: Tokens beyond which texts are trained on apart from shorter ones, together, as each of them takes as many steps.
LONG = 1024
#: Sequences in a step from which its moves are counted by themselves.
WIDE = 256
#: Tasks of a training round for each core; each passes on counts of all classes, so they grow with the cluster and not with the corpus.
TASKS_PER_CORE = 2
#: Tokens of texts recursed over together, in scoring and in training (twice as many of long ones).
TRAINED_TOGETHER = 1_500_000
#: Tables of expected counts that one task, or the driver, adds up.
FAN = 8
#: Entries of a task's word counts beyond which they are passed on; twice as many are gathered before repeats are summed.
COUNTS = 400_000
#: Weight of the corpus frequencies in each state's emissions, in tokens; and of every move and start.
PRIOR, MOVE_PRIOR = 20.0, 0.1
SEED = 17
END = b""
#: For each byte, what it is as a part of a word, and whether it is one.
LOWERED, IN_WORDS = bytes(range(256)).lower(), bytes(not bytes([b]).isspace() for b in range(256))


def encoded(texts):
    """The tokens of an Arrow array of texts: words, A-Z lowered, and an end after each text. As (distinct tokens, the number of
    each token among these, where each text's tokens begin and the last one's end)."""
    import numpy as np

    texts = texts.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data, at = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]
    kept, edge = np.frombuffer(IN_WORDS, bool)[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    # two bytes of words side by side are of one word, unless one text ends and another begins between them
    joined = kept[1:] & kept[:-1] & ~edge[1:-1]
    first, last = kept.copy(), kept.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    before = np.searchsorted(first, at)
    bounds = np.zeros(len(first) + len(texts) + 1, np.int64)
    bounds[np.arange(1, len(first) + 1) + np.repeat(np.arange(len(texts)), np.diff(before))] = last - first + 1
    np.cumsum(bounds, out=bounds)
    lowered = np.frombuffer(LOWERED, np.uint8)[data[kept]]
    found = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(lowered)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), before + np.arange(len(at))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of docs; counts are summed per task before they are shuffled."""
    import numpy as np

    common.small_batches(docs.sparkSession)
    most = COUNTS

    def summed(words, counts):
        found = pa.concat_arrays(words).dictionary_encode()
        # sums of whole numbers, so exact as doubles
        return [found.dictionary], [np.bincount(found.indices.to_numpy(), np.concatenate(counts), len(found.dictionary))]

    def rows(words, counts):
        return pa.RecordBatch.from_arrays([words[0].cast(pa.binary()), pa.array(counts[0].astype(np.int64))], names=["word", "n"])

    def run(batches):
        words, counts = [], []
        for batch in batches:
            if batch.num_rows:
                some, codes, _ = encoded(batch.column(0))
                words.append(some)
                counts.append(np.bincount(codes, minlength=len(some)))
            if sum(map(len, words)) > 2 * most:
                words, counts = summed(words, counts)
                if len(words[0]) > most:
                    yield rows(words, counts)
                    words, counts = [], []
        if words:
            yield rows(*summed(words, counts))

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """Start, transitions and emissions (classes by states); the last class is that of rare words."""

    def __init__(self, start, moves, emits):
        self.start, self.moves, self.emits = start, moves, emits


def first_model(frequencies, states: int = STATES) -> Model:
    """Corpus frequencies, unlike in each state by a fixed draw, with states that tend to stay."""
    import numpy as np

    draw = np.random.default_rng(SEED)
    emits = frequencies[:, None] * draw.uniform(0.3, 1.7, (len(frequencies), states))
    stay = 0.9 if states > 1 else 0.0
    moves = np.full((states, states), (1 - stay) / max(1, states))
    moves[np.diag_indices(states)] += stay
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def _packed(pieces):
    """Pieces, longest first, as (classes, how many go on at each time, where each time begins): time by time, without gaps."""
    import numpy as np

    sizes = np.array([len(p) for p in pieces])
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    begins = np.cumsum(alive) - alive
    time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    classes = np.empty(len(time), np.int32)
    classes[begins[time] + np.repeat(np.arange(len(sizes)), sizes)] = np.concatenate(pieces)
    return classes, alive, begins


class _Forward:
    """The scaled forward recursion over sequences, step by step through all of them at once, longest first, a row of states a token.

    It goes in pieces of about PIECE tokens, and through these in blocks of steps. Probabilities are scaled every RESCALE steps and at the end of each piece.
    """

    def __init__(self, model: Model, sequences):
        import numpy as np

        self.model, self.sequences = model, sequences
        self.sizes = np.array([len(s) for s in sequences])
        self.emits, self.ones = np.ascontiguousarray(model.emits), np.ones(len(model.start))
        self.pieces, at = [], 0
        while at < self.sizes[0]:
            n = int(np.searchsorted(-self.sizes, -at, side="left"))
            self.pieces.append((at, n, max(1, PIECE // n)))
            at += self.pieces[-1][2]

    def piece(self, number: int, before):
        """(classes, alive, begins, forward probabilities, scales by step) of a piece, after the last probabilities of the one before."""
        import numpy as np

        at, n, length = self.pieces[number]
        classes, alive, begins = _packed([s[at : at + length] for s in self.sequences[:n]])
        ahead, scales = np.empty((len(classes), len(self.ones))), {}
        onward, ones, moves = np.empty((n, len(self.ones))), self.ones, self.model.moves
        starts, counts = begins.tolist(), alive.tolist()
        for first, after, low, high in _blocks(starts, counts):
            self.emitted(classes[low:high].astype(np.intp), ahead[low:high])
            for t in range(first, after):
                n, a = counts[t], ahead[starts[t] : starts[t] + counts[t]]
                if before is None:
                    a *= self.model.start
                else:
                    a *= np.matmul(before[:n], moves, out=onward[:n])
                if t % RESCALE == RESCALE - 1 or t == length - 1:
                    scales[t] = a @ ones
                    a /= scales[t][:, None]
                before = a
        return classes, alive, begins, ahead, scales

    def emitted(self, classes, out):
        """Fills out with the emission probabilities of classes."""
        return self.emits.take(classes, axis=0, out=out, mode="clip")

    def message(self, number: int, begins, ahead):
        """The last probabilities of the sequences that go on after a piece."""
        going = self.pieces[number + 1][1] if number + 1 < len(self.pieces) else 0
        return ahead[begins[-1] : begins[-1] + going].copy()

    def totals(self, number: int, begins, ahead):
        """The sum of probabilities at each sequence's last step in a piece: 1 where it goes on."""
        import numpy as np

        at, n, length = self.pieces[number]
        return ahead[begins[np.minimum(self.sizes[:n] - at, length) - 1] + np.arange(n)] @ self.ones


def _blocks(starts, counts):
    """(first step, step after the last, first token, token after the last) of the runs of steps, of about BLOCK tokens, in a piece."""
    found, first, low = [], 0, 0
    for t, high in enumerate(map(int.__add__, starts, counts)):
        if high - low >= BLOCK or t + 1 == len(counts):
            found.append((first, t + 1, low, high))
            first, low = t + 1, high
    return found


def _add_rows(into, classes, rows) -> None:
    """Adds each row to that of its class, by pairs of doubles where states are even: a complex number adds both at once."""
    import numpy as np

    kind = float if into.shape[1] % 2 else complex
    sums, parts = into.view(kind), rows.view(kind)
    for k in range(sums.shape[1]):
        np.add.at(sums[:, k], classes, parts[:, k])


def expected_counts(model: Model, sequences, into) -> None:
    """Adds the sequences' expected starts, moves and emissions to into (start, moves, emits, log likelihood).

    The counts are exact: messages go on from piece to piece in both directions. Beyond twice TRAINED_TOGETHER tokens only the
    messages at the pieces' ends are kept, and each piece's forward pass is made again.
    """
    import numpy as np

    states, backward = len(model.start), np.ascontiguousarray(model.moves.T)
    way = _Forward(model, sorted(sequences, key=len, reverse=True))
    hold = way.sizes.sum() <= 2.2 * TRAINED_TOGETHER
    messages, passes = [None], []
    for number in range(len(way.pieces)):
        made = way.piece(number, messages[-1])
        messages.append(way.message(number, made[2], made[3]))
        passes.append(made if hold or number + 1 == len(way.pieces) else None)
    # what the step after passes back to each sequence that goes on: emission times all that follows, scaled as ahead is
    later, moved = np.empty((0, states)), np.zeros((states, states))
    for number in reversed(range(len(way.pieces))):
        classes, alive, begins, ahead, scales = passes.pop() or way.piece(number, messages[number])
        totals = way.totals(number, begins, ahead)
        into[3] += sum(np.log10(c).sum() for c in scales.values()) + np.log10(totals).sum()
        starts, counts = begins.tolist(), alive.tolist()
        for first, after, low, high in reversed(_blocks(starts, counts)):
            # moves are counted step by step where many sequences go on, else for the whole block at once
            wide = high - low > WIDE * (after - first)
            own = classes[low:high].astype(np.intp)
            seen = way.emitted(own, np.empty((high - low, states)))
            behind = np.empty((counts[first] if wide else high - low, states))
            for t in range(after - 1, first - 1, -1):
                b, n, going = starts[t], counts[t], len(later)
                beta = behind[:n] if wide else behind[b - low : b - low + n]
                np.matmul(later, backward, out=beta[:going])
                if going < n:
                    beta[going:] = 1 / totals[going:n, None]
                later = seen[b - low : b - low + n]
                later *= beta
                if t in scales:
                    later /= scales[t][:, None]
                if wide:
                    ahead[b : b + n] *= beta
                    if t:
                        moved += ahead[starts[t - 1] : starts[t - 1] + n].T @ later
            if not wide:
                # each token but a piece's first ones comes after the token as many places before it as were there then
                t, b = max(first, 1), max(low, counts[0])
                before = np.arange(b, high) - np.repeat(alive[t - 1 : after - 1], alive[t:after])
                moved += ahead.take(before, axis=0).T @ seen[b - low :]
                ahead[low:high] *= behind
            _add_rows(into[2], own, ahead[low:high])
        if number:
            moved += messages[number].T @ later
        else:
            into[0] += ahead[: counts[0]].sum(0)
    into[1] += model.moves * moved


def log_likelihoods(model: Model, sequences):
    """log10 of the probability of each sequence of classes, exactly, by the scaled forward recursion."""
    import numpy as np

    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    way = _Forward(model, [sequences[i] for i in order])
    logs, before = np.zeros(len(order)), None
    for number, (_, n, _) in enumerate(way.pieces):
        _, _, begins, ahead, scales = way.piece(number, before)
        for c in scales.values():
            logs[: len(c)] += np.log10(c)
        logs[:n] += np.log10(way.totals(number, begins, ahead))
        before = way.message(number, begins, ahead)
    out = np.empty(len(order))
    out[order] = logs
    return out


def _whole_steps(words: DataFrame, step, most: int, descending: bool = False):
    """(the last step that still fits or None, words taken): as many whole steps, in order, as have no more than most words."""
    sizes = dict(words.groupBy(step.alias("step")).count().collect())
    last, taken = None, 0
    for k in sorted(sizes, reverse=descending):
        if taken + sizes[k] > most:
            break
        last, taken = k, taken + sizes[k]
    return last, taken, next((k for k in sorted(sizes, reverse=descending) if last is None or (k < last if descending else k > last)), None)


def most_frequent(words: DataFrame, most: int) -> dict[bytes, int]:
    """Words of (word, n) and their counts, no more than most: whole steps of frequency from the top, and of the step that no longer fits the words of lowest hash."""
    step, cell = F.floor(F.log2("n") * STEPS).cast("int"), F.shiftrightunsigned(F.xxhash64("word"), 48).cast("int")
    lowest, taken, following = _whole_steps(words, step, most, descending=True)
    chosen = F.lit(False) if lowest is None else step >= lowest
    if following is not None and taken < most:
        upto, _, _ = _whole_steps(words.where(step == following), cell, most - taken)
        chosen = chosen if upto is None else chosen | (step == following) & (cell <= upto)
    return {bytes(r.word): r.n for r in words.where(chosen).collect()}


def _class_type(classes: int):
    import numpy as np

    return np.uint16 if classes <= 1 << 16 else np.int32


def _together(batches, kind, columns: int = 0):
    """Lists of (values of the first columns, classes in the next one) of stored rows, about TRAINED_TOGETHER tokens in each.

    Texts of over LONG tokens come by themselves, twice as many: each of them takes as many steps as it has tokens.
    """
    import numpy as np

    lists, held = {False: [], True: []}, {False: 0, True: 0}
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in range(columns)))) or [()] * batch.num_rows
        for own, stored in zip(values, batch.column(columns)):
            s = np.frombuffer(stored.as_buffer(), kind)
            long = len(s) > LONG
            # a copy, so that a long text kept back does not keep its batch
            lists[long].append((own, s.copy() if long else s))
            held[long] += len(s)
            if held[long] > TRAINED_TOGETHER * (1 + long):
                yield lists[long]
                lists[long], held[long] = [], 0
    yield from (some for some in lists.values() if some)


def _prior(model: Model, frequencies) -> float:
    """log10 of the priors' density at a model, but for a constant: what Baum-Welch raises is this with the log likelihood."""
    import numpy as np

    emits = (PRIOR * frequencies[:, None] * np.log10(model.emits)).sum()
    return float(emits + MOVE_PRIOR * (np.log10(model.moves).sum() + np.log10(model.start).sum()))


def _added(table: DataFrame, rows: int):
    """The sum of stored rows (sums: doubles), FAN of them in a task until the driver can take the rest; None without rows."""
    import numpy as np

    def add(batches):
        total = None
        for batch in batches:
            for stored in batch.column(0):
                some = np.frombuffer(stored.as_buffer())
                total = some.copy() if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    while rows > FAN:
        rows = -(-rows // FAN)
        merged = common.cut(table.coalesce(rows).mapInArrow(add, "sums binary"), "sums")
        common.drop_scratch(table)
        table = merged
    found = [np.frombuffer(x.as_buffer()) for x in table.toArrow().column(0)]
    common.drop_scratch(table)
    return np.sum(found, axis=0) if found else None


def baum_welch(sequences: DataFrame, frequencies, states: int = STATES, settled: float = SETTLED) -> Model:
    """Trains on all of sequences (classes), as classified() stores them, in every round, until a round adds less than the part settled
    to the log likelihood. Each round's expected counts are summed within tasks, stored, and added up in a tree of few tasks. The model has
    what each round began with as reached."""
    import numpy as np

    spark = sequences.sparkSession
    common.small_batches(spark)
    model, size = first_model(frequencies, states), len(frequencies)
    kind, tasks = _class_type(size), TASKS_PER_CORE * max(1, spark.sparkContext.defaultParallelism)
    reached: list[float] = []
    while len(reached) < 2 or reached[-1] - reached[-2] > settled * abs(reached[-1]):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            into = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0]
            for some in _together(batches, kind):
                expected_counts(sent.value, [s for _, s in some], into)
            if into[0].any():
                sums = np.concatenate([into[2].ravel(), into[1].ravel(), into[0], [into[3]]])
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        stored = common.cut(sequences.select("classes").coalesce(tasks).mapInArrow(run, "sums binary"), "sums")
        sums = _added(stored, tasks)
        sent.destroy()
        if sums is None:
            break
        reached.append(sums[-1] + _prior(model, frequencies))
        emits = sums[: size * states].reshape(size, states) + PRIOR * frequencies[:, None]
        moves = sums[size * states : (size + states) * states].reshape(states, states) + MOVE_PRIOR
        begin = sums[-1 - states : -1] + MOVE_PRIOR
        model = Model(begin / begin.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    model.reached = reached
    return model


def classified(frame: DataFrame, head: list[bytes], counts) -> DataFrame:
    """Stores the rows of (doc_id, text, learned) as sequences of classes, with what is left of each text for the join of rare words:
    (doc_id, row, learned, classes, n_tokens, n_known, base, rare, times). row tells repeated rows apart. counts are those of head; base is of it alone, not yet normed."""
    import numpy as np

    sent = frame.sparkSession.sparkContext.broadcast((head, counts))

    def run(batches):
        head, counts = sent.value
        head, size = pa.array(head, pa.large_binary()), len(head)
        kind = _class_type(size + 1)
        logs, known = np.append(np.log10(counts + 1), 0.0), np.append(counts > 0, False).astype(np.int64)
        names = ["doc_id", "row", "learned", "classes", "n_tokens", "n_known", "base", "rare", "times"]
        for batch in batches:
            if not batch.num_rows:
                continue
            words, codes, at = encoded(batch.column(3))
            s = pc.index_in(words, head).fill_null(size).to_numpy().astype(kind)[codes]
            stored = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * s.itemsize), pa.py_buffer(s)])
            rest = np.flatnonzero(s == size)
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))[rest]
            # each text's distinct rare words, text by text
            rare, times = np.unique(of * len(words) + codes[rest], return_counts=True)
            lists = pa.array(np.searchsorted(rare, np.arange(len(at)) * len(words)), pa.int32())
            rare = words.take(pa.array(rare % len(words))).cast(pa.binary())
            numbers = [np.diff(at), np.add.reduceat(known[s], at[:-1]), np.add.reduceat(logs[s], at[:-1])]
            lists = [pa.ListArray.from_arrays(lists, x) for x in (rare, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], stored.cast(pa.binary()), *map(pa.array, numbers), *lists], names=names)

    made = frame.select("doc_id", F.monotonically_increasing_id().alias("row"), "learned", "text").mapInArrow(
        run, "doc_id long, row long, learned boolean, classes binary, n_tokens long, n_known long, base double, rare array<binary>, times array<int>"
    )
    return common.cut(made, "sequences")


def _likelihoods(sequences: DataFrame, model: Model) -> DataFrame:
    """(doc_id, row, n_tokens, n_known, base, model) of stored sequences."""
    sent, kind = sequences.sparkSession.sparkContext.broadcast(model), _class_type(len(model.emits))

    def run(batches):
        kinds = [pa.int64()] * 4 + [pa.float64()]
        for some in _together(batches, kind, 5):
            found = pa.array(log_likelihoods(sent.value, [s for _, s in some]), pa.float64())
            kept = [pa.array(x, k) for x, k in zip(zip(*(own for own, _ in some)), kinds)]
            yield pa.RecordBatch.from_arrays([*kept, found], names=["doc_id", "row", "n_tokens", "n_known", "base", "model"])

    return sequences.select("doc_id", "row", "n_tokens", "n_known", "base", "classes").mapInArrow(run, "doc_id long, row long, n_tokens long, n_known long, base double, model double")


def score(docs: DataFrame, learn, states: int = STATES, head_words: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Learns from the rows where the condition learn holds. base_score is the smoothed unigram log10 probability and
    score the model's. A null or empty text is the end alone; null doc_ids are kept; rows repeated with id and text
    give a row each and count each in training; an empty table gives an empty one; without training rows every
    word has the same probability; other columns are ignored. Words of equal counts that no longer all fit the
    vocabulary are taken by hash. Long texts are gone through in pieces that hand on their messages.
    """
    import numpy as np

    common.small_batches(docs.sparkSession)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frame = frame.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    words = common.cut(vocabulary(frame.where("learned")), "vocabulary")
    n_distinct, n_all = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = most_frequent(words, head_words - 1)
    end = words.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0]
    top[END] = end or 0
    head = sorted(top)
    rare_tokens, rare_words = n_all - sum(top.values()), max(0, n_distinct - sum(n > 0 for n in top.values()))
    counts = np.array([top[w] for w in head], float)
    every = np.append(counts, rare_tokens) + 1
    sequences = classified(frame, head, counts)
    model = baum_welch(sequences.where("learned"), every / every.sum(), states)
    whole, rare = float(np.log10(n_all + n_distinct + 1)), float(np.log10(rare_tokens + rare_words + 1))
    rares = (
        sequences.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
        .select("row", F.col("r.rare").alias("word"), F.col("r.times").cast("long").alias("times"))
        .join(words, "word", "left")
        .select("row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"), F.col("times").alias("rares"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("rare_known"))
    )
    both = _likelihoods(sequences, model).unionByName(rares, allowMissingColumns=True).groupBy("row")
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return both.agg(*(F.max(n).alias(n) for n in ("doc_id", "n_tokens", "n_known", "base", "model")), total("logs"), total("rares"), total("rare_known")).select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + F.col("logs") - F.col("rares") * F.lit(rare)).alias("score"),
    )


def evaluate(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """score() of every row, learned from outside the held fold, with held_out."""
    fold = common.crc_fold(F.col("doc_id"), folds)
    return score(docs, fold != held, **options).select("doc_id", (fold == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
