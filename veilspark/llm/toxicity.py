"""Toxic documents by a learned lexicon, matched through Levenshtein automata, and scored by the words around a match."""

from __future__ import annotations

import math
from array import array
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality

#: Rows of toxic and of clean labelled documents that the lexicon and the weights are fitted on, where there are more.
SAMPLE = 8_000
#: Letters of the shortest and the longest stem in the lexicon.
SHORTEST, LONGEST = 4, 10
#: A stem is in the lexicon if it is in so many toxic documents of the sample, with such log odds.
LEAST, ODDS = 3, 3.0
#: A longer stem replaces a shorter one that it accounts for by this share.
ACCOUNTS = 0.9
#: Letters from which a stem is matched with one edit.
FUZZY = 5
#: Letters from which the wide lexicon matches a stem with two edits; any other it matches with one.
LONG = 8
#: Words on each side of a match that are looked at.
CONTEXT = 6
#: Stems counted by a task before it hands them on.
CACHE = 500_000
#: Words remembered per worker: some 25 MB.
WORDS = 200_000
#: Bytes of states remembered per worker, at eight a member and so many for a state and its moves.
STATE_BYTES, OF_STATE = 128 << 20, 450
STEPS = 500
#: Numbers of a text that its score is made from.
FEATURES = 10

QUOTES = "\"“”„«»‹›‘’"
#: Words, in the languages of the web's larger parts, that report what someone else said.
REPORTING = frozenset(
    "said says wrote writes called quoted quote reported claimed slur word term insult "
    "dit disait écrit cité mot insulte terme dijo dice escribió llamó cita palabra insulto sagte sagt schrieb nannte zitat wort beleidigung".split()
)


def allowed(stem: str) -> int:
    """Edits with which the wide lexicon matches a stem."""
    return 2 if len(stem) >= LONG else 1


def _packed(state) -> bytes:
    """A state's members in a fixed order, eight bytes each."""
    return array("q", sorted((x[0] << 2 | x[1]) << 21 | (ord(x[2]) if len(x) == 3 and x[2] else 0) for x in state)).tobytes()


def _members(packed: bytes) -> list[tuple[int, int, str]]:
    return [(x >> 23, x >> 21 & 3, chr(x & 0x1FFFFF) if x & 0x1FFFFF else "") for x in array("q", packed)]


class Lexicon:
    """Stems in a trie, intersected with the Levenshtein automata of one edit of all of them.

    A state is a set of (trie node, edits made); states and their transitions are made when a word first needs them
    and kept, so a word costs one lookup per letter. A stem is matched by any word that begins with it.
    """

    def __init__(self, stems: dict[str, float]):
        self.weights = stems
        self.children: list[dict[str, int]] = [{}]
        self.stem_at: dict[int, str] = {}
        self.fuzzy: list[bool] = [False]
        for stem in sorted(stems):
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= len(stem) >= FUZZY
            self.stem_at[node] = stem
        self.fuzzy[0] = any(len(s) >= FUZZY for s in stems)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.found: list[tuple | None] = []
        self.moves: list[dict[str, int]] = []
        self.held = 0
        self.begin = self._state(self._closed({(0, 0)}))

    def _closed(self, state: set) -> frozenset:
        """With every node that skipping one letter of a stem reaches; without what a node with fewer edits covers."""
        wider = set(state)
        for node, edits in state:
            # the first letter has to be there: words that differ in it are rarely meant
            if not edits and node and self.fuzzy[node]:
                wider |= {(child, 1) for child in self.children[node].values() if self.fuzzy[child]}
        return frozenset(x for x in wider if x[1] == 0 or (x[0], 0) not in wider)

    def _state(self, state: frozenset) -> int:
        packed = _packed(state)
        if packed not in self.ids:
            self.ids[packed] = len(self.states)
            self.states.append(packed)
            self.moves.append({})
            self.held += OF_STATE + len(packed)
            hits = [(e, -self.weights[self.stem_at[n]], self.stem_at[n]) for n, e in state if n in self.stem_at and (not e or len(self.stem_at[n]) >= FUZZY)]
            self.found.append(min(hits) if hits else None)
        return self.ids[packed]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits, _ in _members(self.states[state]):
            child = self.children[node].get(c)
            if child is not None:
                after.add((child, edits))
            if not edits and node and self.fuzzy[node]:
                after.add((node, 1))  # a letter too many
                after |= {(other, 1) for other in self.children[node].values() if self.fuzzy[other]}  # another letter
        to = self.moves[state][c] = self._state(self._closed(after))
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(stem, edits) of the best stem that the word begins with: fewest edits, then the heaviest.

        States are forgotten between words where they take too much; one word adds no more than the longest stem has letters, and its edits.
        """
        if self.held > STATE_BYTES:
            self.reset()
        state, best = self.begin, None
        moves, states, found = self.moves, self.states, self.found
        for c in word:
            state = moves[state].get(c, -1) if c in moves[state] else self._move(state, c)
            if not states[state]:
                break
            hit = found[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        return None if best is None else (best[2], best[0])


class WideLexicon(Lexicon):
    """A lexicon whose edits may be anywhere, the first letter too: one for short stems, two from LONG letters on; a swap of neighbours is one.

    A state is a set of (trie node, edits made, letter that a swap still waits for or "").
    """

    def reset(self) -> None:
        self.reach = [0] * len(self.children)
        for stem in self.weights:
            node = 0
            for c in ["", *stem]:
                node = self.children[node][c] if c else node
                self.reach[node] = max(self.reach[node], allowed(stem))
        super().reset()

    def _closed(self, state: set) -> frozenset:
        todo = [x if len(x) == 3 else (*x, "") for x in state]
        least: dict[tuple[int, str], int] = {}
        while todo:
            node, edits, waits = todo.pop()
            if edits > self.reach[node] or least.get((node, waits), 9) <= edits:
                continue
            least[node, waits] = edits
            if not waits and edits < self.reach[node]:
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
        return frozenset((node, edits, waits) for (node, waits), edits in least.items())

    def _state(self, state: frozenset) -> int:
        packed = _packed(state)
        if packed not in self.ids:
            self.ids[packed] = len(self.states)
            self.states.append(packed)
            self.moves.append({})
            self.held += OF_STATE + len(packed)
            hits = [(e, -self.weights[self.stem_at[n]], self.stem_at[n]) for n, e, waits in state if not waits and n in self.stem_at and e <= allowed(self.stem_at[n])]
            self.found.append(min(hits) if hits else None)
        return self.ids[packed]

    def _move(self, state: int, c: str) -> int:
        after = set()
        for node, edits, waits in _members(self.states[state]):
            if waits:
                if waits == c:
                    after.add((node, edits, ""))
                continue
            children = self.children[node]
            child = children.get(c)
            if child is not None:
                after.add((child, edits, ""))
            if edits < self.reach[node]:
                after.add((node, edits + 1, ""))  # a letter too many
                for letter, other in children.items():
                    after.add((other, edits + 1, ""))  # another letter
                    swapped = self.children[other].get(c)
                    if swapped is not None and letter != c:
                        after.add((swapped, edits + 1, letter))
        to = self.moves[state][c] = self._state(self._closed(after))
        return to


def _words_of(stems: dict[str, float]):
    """A worker's lexicon, kept from task to task with its states."""
    return common.kept("toxicity", stems, lambda: _Words(WideLexicon(stems)))


class _Words(dict):
    """Token of a text to its match."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        if len(self) > WORDS:
            self.clear()
        found = self.lexicon.match(plain(token))
        if len(token) < 64:
            self[token] = found
        return found


def plain(token: str) -> str:
    """A token's letters between the marks around it."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


def quoted(tokens: list[str], at: int) -> bool:
    """Whether the words around a match report it: it stands within quotation marks, or next to a reporting word."""
    near = tokens[max(0, at - CONTEXT) : at + CONTEXT + 1]
    here = min(at, CONTEXT)
    if any(plain(t) in REPORTING for t in near[max(0, here - 3) : here]):
        return True
    opened = any(t[0] in QUOTES and not (len(t) > 1 and t[-1] in QUOTES) for t in near[:here]) or near[here][0] in QUOTES
    closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?")[-1:] != "" for t in near[here:])
    return opened and closed


def matches(words: _Words, text: str) -> list[tuple[int, str, int, bool]]:
    """(word number, stem, edits, quoted) of each match in a text."""
    tokens = text.lower().split()
    return [(i, *hit, quoted(tokens, i)) for i, hit in enumerate(map(words.__getitem__, tokens)) if hit]


def features(words: _Words, text: str) -> list[float]:
    """Context scores of a text: sums of stem weights, apart for exact, misspelled and quoted matches, their density, and
    the largest sum within a window of words; apart from all these, sums and density of less sure matches: short stems with an edit, and two edits."""
    found = matches(words, text)
    if not found:
        return [0.0] * FEATURES
    weights = words.lexicon.weights
    n = len(text.split())
    sums, inside, most = [0.0] * 5, [], 0.0
    stems = set()
    for at, stem, edits, reported in found:
        w = weights[stem] / 5
        unsure = edits == 2 or bool(edits) and len(stem) < FUZZY
        sums[2 if reported and not unsure else 2 + edits // 2 + 1 if unsure else edits] += w / (1 + reported * unsure)
        if not reported and not unsure:
            if not edits:
                stems.add(stem)
            inside = [x for x in inside if x[0] >= at - 4 * CONTEXT] + [(at, w / (1 + edits))]
            most = max(most, sum(x[1] for x in inside))
    return [math.log1p(sums[0]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(100 * sums[0] / n), math.log1p(most), min(len(stems), 5) / 5, *(math.log1p(x) for x in sums[3:]), *(math.log1p(100 * x / n) for x in sums[3:])]


def _stems(text: str) -> set[str]:
    found = set()
    for word in {plain(t) for t in text.lower().split()}:
        found.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return found


def _document_counts(docs: DataFrame, wanted=None) -> DataFrame:
    """(stem, n): in how many texts of docs each stem begins a word; counts are summed per task before they are shuffled."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["stem", "n"])
            counts.clear()
            return rows

        common.kept("toxicity")
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for text in batch.column(0):
                stems = _stems(text.as_py() or "")
                counts.update(stems if keep is None else stems & keep)
            if len(counts) > CACHE:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))


def learn_lexicon(toxic: DataFrame, clean: DataFrame) -> dict[str, float]:
    """Stems and their log odds. Their number is bounded by the sample's words: each is in LEAST toxic documents of it."""
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return {}
    common_ones = {r.stem: r.n for r in _document_counts(toxic).where(F.col("n") >= LEAST).collect()}
    keep = toxic.sparkSession.sparkContext.broadcast(set(common_ones))
    in_clean = {r.stem: r.n for r in _document_counts(clean, keep).collect()}
    odds = {s: math.log((n + 0.5) / (n_toxic + 1)) - math.log((in_clean.get(s, 0) + 0.5) / (n_clean + 1)) for s, n in common_ones.items()}
    good = {s for s, w in odds.items() if w >= ODDS}
    longer = {s[:-1] for s in good if common_ones[s] >= ACCOUNTS * common_ones.get(s[:-1], 0)}
    ends = {s for s in good if s not in longer}
    # a stem that begins with another in the list adds nothing
    return {s: odds[s] for s in ends if not any(s[:k] in ends for k in range(SHORTEST, len(s)))}


def train(docs: DataFrame, labels: DataFrame, learn) -> dict:
    """Lexicon and weights from rows of docs where the condition learn holds, about SAMPLE of either label where there are more, by hash of doc_id."""
    import numpy as np

    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(learn)
    ids = [quality.sampled(known.where(F.col("toxic") == k), SAMPLE).withColumn("kind", F.lit(k)) for k in (1, 0)]
    chosen = F.broadcast(common.cut(ids[0].union(ids[1]), "chosen"))  # SAMPLE bounds this side
    texts = common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("kind", "text"), "sample")
    stems = learn_lexicon(texts.where("kind = 1"), texts.where("kind = 0"))
    model: dict = {"stems": stems, "weights": None}
    if not stems:
        return model
    sent = spark.sparkContext.broadcast(stems)

    def run(batches):
        words = _words_of(sent.value)
        for batch in batches:
            found = [features(words, t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["kind", "x"])

    got = texts.mapInArrow(run, "kind int, x array<double>").toArrow()
    y, x = got.column("kind").to_numpy().astype(float), np.array(got.column("x").to_pylist())
    order = np.lexsort((*x.T, y))
    x, y = np.column_stack([x, np.ones(len(x))])[order], y[order]

    def gradient(w):
        return x.T @ (quality._sigmoid(x @ w) - y) / len(y) + 1e-4 * w

    model["weights"] = quality._adam(np.zeros(x.shape[1]), gradient, STEPS)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns with score, 0 to 1; without a lexicon 0."""
    from pyspark.sql.types import DoubleType, StructType

    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    frame = docs.select(*[c for c in docs.columns if c != "score"])
    names, at = frame.columns, frame.columns.index("text")

    def run(batches):
        import numpy as np

        model = sent.value
        words = _words_of(model["stems"])
        for batch in batches:
            if model["weights"] is None:
                scores = np.zeros(batch.num_rows)
            else:
                x = np.array([features(words, t.as_py() or "") for t in batch.column(at)]).reshape(batch.num_rows, FEATURES)
                scores = quality._sigmoid(x @ model["weights"][:-1] + model["weights"][-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return frame.mapInArrow(run, StructType([*frame.schema.fields]).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels (doc_id, toxic) are learned from outside the held fold.

    A null or empty text matches nothing; null doc_ids are scored but never learned from; repeated rows score
    equally; an empty docs table gives an empty one; without labels of both kinds every score is 0; other columns
    are ignored. Of several labels of one id the highest counts. A text of any length is gone through whole, word by word.
    Of stems that fit a word, the one of fewest edits counts, then the heaviest, then the first by letters. Scores
    depend on the text alone; one at the threshold is predicted 1.
    """
    model = train(docs, labels, common.crc_fold(F.col("doc_id"), folds) != held)
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(frame, model).select(
        "doc_id", (common.crc_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
