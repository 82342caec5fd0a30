"""Token counts by a compiled finite-state transducer.

The vocabulary of a piece tokenizer is compiled, as it is needed, into a
deterministic transducer.  A state holds, for each position at which a piece
that reaches the present position could have begun, the trie node reached
since then, the last token before it and the token count there relative to
now.  A token sequence is the tokenizer's output exactly when each pair of
neighbours is the output for their concatenation, so one token ends at each
position and the next state is determined.  Transitions carry the change in
the number of emitted tokens; their sum along a text is its token count.

A text is read in chunks.  A chunk's state map sends the entry state to the
exit state and the tokens emitted.  At a word start and at a line feed (which
no piece spans) every entry state leads to the same state, so a map is the
part before the first such point, the tokens counted after it, and the exit
state.  Maps compose associatively, and a prefix scan over the chunks gives
the text's count.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import kept_in_worker, map_batches, returned, worker_cache_limit

SPACE = "▁"
#: Where any entry state leads to the same state: before a run of word marks, and around a line feed.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\\n]*|\\n|[^{SPACE}\\n]+")


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the pieces that merging may form."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces:
        raise ValueError("the transducer takes a BPE model with byte fallback and no normalisation")
    scores = {p.piece: p.score for p in model.pieces if p.type == 1}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in scores):
        raise ValueError("a piece spans a word start or a line feed")
    return scores


class Transducer:
    """Compiled lazily; ``step`` is a table lookup once a transition is known."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.alphabet = {c for p in scores for c in p}
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        for piece in {*scores, *self.alphabet}:
            node = 0
            for c in piece:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(None)
                node = self.trie[node][c]
            self.piece_at[node] = piece
        self.pairs: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}

    def trim(self, limit: int) -> None:
        """Forgets compiled transitions beyond a bound; they are compiled anew when needed."""
        if len(self.moves) > limit:
            self._clear()
        if len(self.pairs) > limit:
            self.pairs.clear()

    def weight(self, piece: str) -> int:
        return 1 if piece in self.scores else len(piece.encode())

    def merged(self, text: str) -> list[str]:
        """The merging procedure itself, for the pairs that the compiler asks about."""
        parts = list(text)
        while True:
            best = max(((s, -i) for i in range(len(parts) - 1) if (s := self.scores.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def adjacent(self, left: str | None, right: str) -> bool:
        if left is None:
            return self.merged(right) == [right]
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def compile(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.alphabet:
            self.moves[state, c] = out = (0, len(c.encode()))
            return out
        grown = [(child, last, count) for node, last, count in self.states[state] if (child := self.trie[node].get(c)) is not None]
        ends = [(self.piece_at[node], count) for node, last, count in grown if (p := self.piece_at[node]) is not None and self.adjacent(last, p)]
        if len(ends) != 1:
            raise ValueError(f"{len(ends)} tokens end at one position")
        token, count = ends[0]
        delta = count + self.weight(token)
        alive = (*((node, last, n - delta) for node, last, n in grown if self.trie[node]), (0, token, 0))
        to = self.ids.get(alive)
        if to is None:
            to = self.ids[alive] = len(self.states)
            self.states.append(alive)
        self.moves[state, c] = out = (to, delta)
        return out

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        total, moves = 0, self.moves
        for c in text:
            move = moves.get((state, c))
            if move is None:
                move = self.compile(state, c)
            state = move[0]
            total += move[1]
        return state, total


@dataclass(frozen=True)
class ChunkMap:
    """State map of a chunk: ``head`` is read from the entry state; without a reset the map is ``head`` alone."""

    head: str
    reset: bool
    count: int
    exit: int


class Counter(dict):
    """Token counts of words, by the transducer; a bounded memo table over it."""

    def __init__(self, scores: dict[str, float], chunk: int = 1 << 16):
        super().__init__()
        self.machine, self.chunk, self.limit = Transducer(scores), chunk, worker_cache_limit()

    def __missing__(self, word: str) -> int:
        n = self.machine.run(word if word[:1] == "\n" else SPACE + word)[1]
        if len(word) <= 48:
            self[word] = n
        return n

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The exit state is that of the last segment, which is read from the reset state."""
        parts = SEGMENT.findall(chunk)
        if chunk[:1] not in (SPACE, "\n"):
            head, parts = parts[0], parts[1:]
        else:
            # a run of word marks may continue one of the chunk before
            head, parts = (parts[0], parts[1:]) if chunk[0] == SPACE else ("", parts)
        if not parts:
            return ChunkMap(head, False, 0, 0)
        total = state = 0
        for part in parts:
            state, n = self.machine.run(part)
            total += n
        return ChunkMap(head, True, total, state)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """``a`` then ``b``; associative."""
        if not a.reset:
            return ChunkMap(a.head + b.head, b.reset, b.count, b.exit)
        # a head that starts a word does not depend on what precedes, unless that is a run of word marks: the state knows
        state, n = self.machine.run(b.head, a.exit)
        return ChunkMap(a.head, True, a.count + n + b.count, b.exit if b.reset else state)

    def count_long(self, text: str) -> int:
        """By chunks of any text with the word mark at its start."""
        maps = [self.chunk_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)]
        last = list(accumulate(maps, self.compose, initial=ChunkMap("", True, 0, 0)))[-1]
        return last.count

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self) > self.limit:
            self.clear()
            self.machine.trim(self.limit)
        marked = text.replace("\n", " \n")
        if len(self.machine.moves) > 2 * self.limit:
            self.machine.trim(self.limit)
        if len(text) > 4 * self.chunk or "  " in marked or marked[-1] == " " or marked[0] == " ":
            return self.count_long(SPACE + text.replace(" ", SPACE))
        return sum(map(self.__getitem__, marked.split(" ")))


@kept_in_worker
def counter_for(model: str) -> Counter:
    """One for each worker process, which serves many tasks."""
    return Counter(vocabulary(model))


def count_tokens(docs: DataFrame, model: str, over: int, text: str = "text", keys: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keys``, n_bytes, n_tokens and over_limit for every row of ``docs``.

    Null and empty texts have no bytes and no tokens.  Rows are independent:
    one map over the scan, no shuffle; repeated rows give repeated results.
    """
    keys = list(keys)
    small = docs.select(*keys, text)
    schema = returned(small, keys, "n_bytes bigint, n_tokens bigint, over_limit boolean")

    def make():
        counter = counter_for(model)

        def handle(batch: pa.RecordBatch):
            texts = batch.column(batch.num_columns - 1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = pa.array([0 if not x else counter.count(x) for x in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n_bytes, n, pc.greater(n, over)], [*keys, "n_bytes", "n_tokens", "over_limit"])

        return handle

    return map_batches(small, schema, make, counter_for)
