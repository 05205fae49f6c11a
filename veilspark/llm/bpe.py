"""Byte-level BPE by backtracking over longest matches, equal to repeated merging."""

from __future__ import annotations

import base64
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries kept of encoded pieces and of checked pairs, per Python worker.
CACHE = 400_000
#: Bytes of texts and ids in a batch that goes back to Spark.
OUT_BYTES = 4 << 20


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}


class Bpe:
    """Exact merges of a rank vocabulary.

    Bytes map to Latin-1 characters, so that one automaton over all tokens finds the longest token at every
    position. Encoding walks those longest matches; a token may follow another only if merging the two apart
    would keep them apart (compatible, memoised), otherwise it falls back to the next shorter prefix token and
    then backtracks, never visiting a dead position twice.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.words = {rank: word for word, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, rank in ranks.items():
            self.automaton.add_word(word.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.widest = max(map(len, ranks), default=0)
        self.shorter: dict[int, int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        self.never = 1 + max(self.words, default=0)
        for word, rank in ranks.items():
            prefix = next((ranks[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in ranks), None)
            if prefix is not None:
                self.shorter[rank] = prefix

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of left and right ends in just these two.

        Merges elsewhere never change the order of those in here, so tokens whose neighbours all pass this are
        the encoding of a text. It holds too where a token ranks before its own parts.
        """
        ranks, never = self.ranks, self.never
        border = len(self.words[left])
        spans = [bytes((x,)) for x in self.words[left] + self.words[right]]
        costs = [ranks.get(spans[i] + spans[i + 1], never) for i in range(len(spans) - 1)]
        ends = list(range(1, len(spans) + 1))
        while costs:
            cost = min(costs)
            if cost == never:
                break
            i = costs.index(cost)
            if ends[i] == border:
                return False
            spans[i : i + 2] = [spans[i] + spans[i + 1]]
            del ends[i], costs[i]
            if i:
                costs[i - 1] = ranks.get(spans[i - 1] + spans[i], never)
            if i < len(costs):
                costs[i] = ranks.get(spans[i] + spans[i + 1], never)
        return len(spans) == 2

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) > CACHE:
                self.memo.clear()
            found = self.memo[key] = self._apart(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if not piece:
            return []
        size, text = len(piece), piece.decode("latin-1")
        words, shorter, memo = self.words, self.shorter, self.memo
        alive = bytearray(b"\1") * (size + 1)
        out: list[int] = []
        at, token = 0, self._longest(text, piece, 0)
        while True:
            last = out[-1] if out else None
            while True:
                end = at + len(words[token])
                if alive[end]:
                    fits = True if last is None else memo.get((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        out.append(token)
                        at = end
                        if at == size:
                            return out
                        token = self._longest(text, piece, at)
                        break
                if token in shorter:
                    token = shorter[token]
                    continue
                if last is None:
                    raise ValueError("the vocabulary lacks single bytes of this text")
                # nothing fits here: undo the last token and try its shorter prefixes
                alive[at] = 0
                out.pop()
                at -= len(words[last])
                token = last
                break

    def _longest(self, text: str, piece: bytes, at: int) -> int:
        """The longest token at a position: the automaton's trie bounds its length."""
        n = self.automaton.longest_prefix(text[at : at + self.widest])
        while n:
            rank = self.ranks.get(piece[at : at + n])
            if rank is not None:
                return rank
            n -= 1
        raise ValueError("the vocabulary lacks single bytes of this text")


class _Pieces(dict):
    """Piece of text to the bytes of its ids, little-endian and unsigned 32-bit."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = array("I", self.bpe.encode_piece(piece.encode("utf-8")))
        found = ids.tobytes()
        if len(piece) < 256:
            self[piece] = found
        return found


def codec(vocabulary: bytes, pattern: str):
    """(text -> bytes of ids, bytes of ids -> bytes of text), built once per Python worker."""
    import regex

    def make():
        bpe = Bpe(read_ranks(vocabulary))
        pieces, find, words = _Pieces(bpe), regex.compile(pattern).findall, bpe.words

        def encode(text: str) -> bytes:
            return b"".join(map(pieces.__getitem__, find(text)))

        def decode(ids: bytes) -> bytes:
            return b"".join(map(words.__getitem__, array("I", ids)))

        return encode, decode

    return common.kept("bpe", (hash(vocabulary), pattern), make)


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """docs' doc_id with ids (binary, little-endian unsigned 32-bit), n_tokens, and decoded (binary, from the ids).

    Each match of pattern is encoded by itself and no special tokens exist, as tiktoken's encode_ordinary does.
    A null text is the empty text, with no ids. Equal rows give equal rows; an empty table gives an empty one; a
    null doc_id stays null; other columns are ignored. A text may be of any length: a piece takes linear time
    and memory, and batches back to Spark hold a few MB at most beside one text. The vocabulary (under 1 MB, a
    fixed file) goes to each worker with the task, read by the driver from vocabulary_path.
    """
    common.small_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        encode, decode = codec(vocabulary.value, pattern)
        kinds = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                back = decode(ids)
                rows.append((doc_id, len(ids) // 4, ids, back))
                held += len(ids) + len(back)
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)
                rows, held = [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded binary"
    )


def digests(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """Per document its token count and the digests of its ids and of what they decode to."""
    return encode_decode(docs, vocabulary_path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
