"""Token counts by a finite-state compilation of a merge tokenizer.

A merge tokenizer's output has a local test: a sequence of pieces is what it
gives for their text just when it gives every two neighbours for theirs. So the
last piece of a prefix's tokens follows from the last pieces of the few
prefixes that a piece can reach back to. Those, with the characters since, are
the state of a deterministic transducer; a transition reads a character and
carries the number of tokens it adds (or takes back). States are bounded by the
longest piece, and are compiled when first met.

No piece holds a space after another character, so such a place sets the
machine to one state whatever came before. A chunk of text with such places is
a constant, the sum over the words between them, each of which is run once and
remembered; only what comes before the first and after the last is open, and
chunks are joined two by two. A run without such a place, however long, is cut
into chunks that are maps from entry state to exit state and count. A map is
computed for the state that the characters before the chunk lead to from the
start, which is nearly always the one that comes; maps compose in any grouping,
so they are joined by a parallel prefix scan, and where another state comes the
chunk is run from that.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.workers import tidy
from inkglass.session import ship

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16  # characters
RUN, WARM = 1 << 14, 64  # characters of a chunk of a run without spaces, and before it
WORDS, STATES = 500_000, 250_000  # remembered by a worker at most
KEPT, HELD = 256, 1 << 24  # characters of a remembered word, and of all of them, at most
SPACE = "▁"
ORIGIN = ("", ("",), (0,))  # the state at the start


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Transducer:
    """Counts the tokens of words.

    A state is the text since the oldest place a piece can still reach back to,
    and, for each place in it where one may start, the piece that ends there
    and the tokens from there on. States are numbered as they are met.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}  # less is merged earlier
        for k in range(model.vocab_size()):
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
                self.rank[model.id_to_piece(k)] = -model.get_score(k)
        self.prefixes = {p[:k] for p in self.rank for k in range(1, len(p) + 1)}
        self.beside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.last_merge: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.moves: dict[tuple[str, str], tuple] = {}
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.held = 0  # characters of known words and parts
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []  # of each state: character to next state and tokens added
        self.numbers: dict[tuple, int] = {}
        self.start = self.number(ORIGIN)

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return n

    def merge(self, text: str) -> list[str]:
        """What the merge rules give: the earliest-ranked neighbours first, leftmost of ties."""
        n, rank = len(text), self.rank
        parts, after, before = list(text), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, 2) for k in range(n - 1) if (r := rank.get(text[k : k + 2])) is not None]
        heapify(heap)
        last = None
        while heap:
            _, k, size = heappop(heap)
            j = after[k]
            if not parts[k] or j < 0 or len(parts[k]) + len(parts[j]) != size:
                continue  # one of the two has grown or gone since
            last = parts[k], parts[j]
            parts[k], parts[j], after[k] = parts[k] + parts[j], "", after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := rank.get(parts[x] + parts[y])) is not None:
                    heappush(heap, (r, x, len(parts[x]) + len(parts[y])))
        if last and parts[0] == text:
            self.last_merge.setdefault(text, last)
        return [p for p in parts if p]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece; None for a character, or a piece
        that the rules don't make of its own text."""
        if piece not in self.last_merge:
            whole = len(piece) > 1 and self.merge(piece) == [piece]
            if not whole:
                self.last_merge[piece] = None
        return self.last_merge[piece]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the text of both pieces gives these two. Their merges are
        undone from the last one on; the pieces that meet at the border at each
        time must not merge before they grow."""
        key = (left, right)
        out = self.pairs.get(key)
        if out is None:
            out = (len(left) < 2 or self.halves(left) is not None) and (len(right) < 2 or self.halves(right) is not None)
            limit, strict, rank = float("inf"), True, self.rank
            while out and left:
                r = rank.get(left + right)
                if r is not None and (r < limit or (r == limit and not strict)):
                    out = False
                    break
                x, y = self.halves(left), self.halves(right)
                if x and (not y or rank[left] > rank[right]):  # of ties the left one was made first
                    limit, strict, left = rank[left], True, x[1]
                elif y:
                    limit, strict, right = rank[right], False, y[0]
                else:
                    break
            if len(self.pairs) > STATES:
                self.pairs.clear()
            self.pairs[key] = out
        return out

    def move(self, text: str, c: str) -> tuple:
        """Pieces that may end with ``c``, each with the number of the place it
        starts at; the next state's text; which places stay."""
        live = [k for k in range(len(text)) if text[k:] in self.prefixes] + [len(text)]
        more = text + c
        ends = [(i, more[k:]) for i, k in enumerate(live) if more[k:] in self.rank][::-1]
        stay = [i for i, k in enumerate(live) if more[k:] in self.prefixes]
        return ends, more[live[stay[0]] :] if stay else "", stay

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The next state, and the tokens added."""
        if c not in self.rank:  # bytes; nothing merges with them
            out = (self.start, len(c.encode()))
        else:
            text, before, since = self.states[state]
            move = self.moves.get((text, c))
            if move is None:
                if len(self.moves) > STATES:
                    self.moves.clear()
                move = self.moves[text, c] = self.move(text, c)
            ends, text, stay = move
            get = self.pairs.get
            for i, piece in ends:
                ok = get((before[i], piece))
                if ok or ok is None and self.neighbours(before[i], piece):
                    break
            else:
                raise ValueError(f"no piece ends at {c!r} after {text!r}")
            added = 1 - since[i]
            out = (self.number((text, (*[before[k] for k in stay], piece), (*[since[k] + added for k in stay], 0))), added)
        self.steps[state][c] = out
        return out

    def walk(self, text: str, entry: tuple) -> tuple[tuple, int]:
        """The state after a text from the state ``entry``, and its tokens."""
        if len(self.states) > STATES:
            self.forget()
        n, state, steps = 0, self.number(entry), self.steps
        for c in text:
            move = steps[state].get(c)
            if move is None:
                move = self.step(state, c)
            state, k = move
            n += k
        return self.states[state], n

    def run(self, text: str, size: int = 0) -> int:
        """Tokens of a text from the start state."""
        size = size or RUN
        if len(text) <= size:
            return self.walk(text, ORIGIN)[1]
        chunks = [text[k : k + size] for k in range(0, len(text), size)]
        entries = [ORIGIN, *(self.walk(c[-WARM:], ORIGIN)[0] for c in chunks[:-1])]
        return scan([Map.of(c, e, self) for c, e in zip(chunks, entries, strict=True)], self)[-1].to[ORIGIN][1]

    def remember(self, where: dict[str, int], text: str, n: int) -> None:
        """Keeps a count. Both memories are bounded by entries and characters."""
        if len(text) <= KEPT:
            self.held += len(text)
            if self.held > HELD or len(where) > WORDS:
                self.known.clear()
                self.parts.clear()
                self.held = len(text)
            where[text] = n

    def part(self, text: str) -> int:
        n = self.parts.get(text)
        if n is None:
            # runs of spaces have one score, so the local test can't tell their ties: by the rules themselves
            n = self.by_rules(text) if text.startswith(SPACE * 2) else self.run(text)
            self.remember(self.parts, text, n)
        return n

    def by_rules(self, text: str) -> int:
        runs = re.split("([" + "".join(map(re.escape, {c for c in text if c not in self.rank} or "\n")) + "])", text)
        return sum(len(r.encode()) if k % 2 else len(self.merge(r)) for k, r in enumerate(runs))

    def word(self, text: str) -> int:
        """Tokens of a run of spaces with the characters up to the next one; the
        first space is left out of ``text``. It is cut between runs of letters
        and of others where the two characters stand together in no piece."""
        n = self.known.get(text)
        if n is None:
            n, open_ = 0, ""
            for run in _runs(SPACE + text.replace(" ", SPACE)):
                if open_ and open_[-1] + run[0] not in self.beside:
                    n += self.part(open_)
                    open_ = run
                else:
                    open_ += run
            n += self.part(open_)
            self.remember(self.known, text, n)
        return n


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """One a worker process: what it has compiled serves the tasks after."""
    return Transducer(path)


_RUN = re.compile(f"{SPACE}+|[^\\W\\d_]+|[^{SPACE}\\w]+(?:[\\d_]+[^{SPACE}\\w]*)*|[\\d_]+(?:[^{SPACE}\\w]+[\\d_]*)*")


def _runs(text: str) -> list[str]:
    """Letters with the spaces before them, and what lies between, in order."""
    out, letters = [], True
    for run in reversed(_RUN.findall(text)):
        if run[0].isalpha():
            out.append(run)
            letters = True
        elif run[0] == SPACE and out and out[-1][0].isalpha() or not letters:
            out[-1] = run + out[-1]
        else:
            out.append(run)
            letters = False
    return out[::-1]


_SYNC = re.compile("(?<=[^ ])(?= )")
_WORD = re.compile(" ( *[^ ]*)")


@dataclass(frozen=True)
class Chunk:
    """A chunk's map. head: its text up to the first place that sets the
    machine; body: tokens of the whole words after; tail: the text of the word
    still open at its end, or None where no such place is in it."""

    head: str
    body: int
    tail: str | None

    @staticmethod
    def of(text: str, t: Transducer) -> Chunk:
        at = _SYNC.search(text)
        if at is None:
            return Chunk(text, 0, None)
        rest = text[at.start() :]
        words = _WORD.findall(rest) if "  " in rest else rest[1:].split(" ")
        last = words.pop()
        get, word = t.known.get, t.word
        return Chunk(text[: at.start()], sum([get(w) or word(w) for w in words]), " " + last)

    def then(self, other: Chunk, t: Transducer) -> Chunk:
        """This chunk's map, then the other's. A head that opens with a space
        after another character is a word of its own."""
        if self.tail is None:
            joint = self.head + other.head
            at = _SYNC.search(joint, max(0, len(self.head) - 1)) if self.head and other.head else None
            if at is None:
                return Chunk(joint, other.body, other.tail)
            first = Chunk(joint[: at.start()], 0, joint[at.start() :])
            return first if other.tail is None else Chunk(first.head, t.word(first.tail[1:]) + other.body, other.tail)
        if self.tail and other.head[:1] == " " and self.tail[-1] != " ":
            body, tail = self.body + t.word(self.tail[1:]), other.head
        else:
            body, tail = self.body, self.tail + other.head
        return Chunk(self.head, body, tail) if other.tail is None else Chunk(self.head, body + t.word(tail[1:]) + other.body, other.tail)

    def total(self, t: Transducer) -> int:
        """Tokens of a text whose first chunk, which opens with a space, is in this one."""
        return t.word(self.head[1:]) + self.body + (t.word(self.tail[1:]) if self.tail else 0)


@dataclass(frozen=True)
class Map:
    """Of a stretch of a run: exit state and tokens for entry states that came
    up; and its chunk, or the two maps it is made of, for other states."""

    to: dict[tuple, tuple[tuple, int]]
    chunk: str
    parts: tuple[Map, Map] | None = None

    @staticmethod
    def of(chunk: str, entry: tuple, t: Transducer) -> Map:
        return Map({entry: t.walk(chunk, entry)}, chunk)

    def at(self, entry: tuple, t: Transducer) -> tuple[tuple, int]:
        if entry not in self.to:
            if self.parts:
                state, n = self.parts[0].at(entry, t)
                state, k = self.parts[1].at(state, t)
                self.to[entry] = state, n + k
            else:
                self.to[entry] = t.walk(self.chunk, entry)
        return self.to[entry]

    def then(self, other: Map, t: Transducer) -> Map:
        out = Map({}, "", (self, other))
        for entry in self.to:
            out.at(entry, t)
        return out


def scan(maps: list[Map], t: Transducer) -> list[Map]:
    """Prefix compositions, in a number of rounds that is the logarithm of theirs."""
    out, gap = list(maps), 1
    while gap < len(out):
        out = [out[k - gap].then(out[k], t) if k >= gap else out[k] for k in range(len(out))]
        gap *= 2
    return out


def joined(chunks: list[Chunk], t: Transducer) -> Chunk:
    """All chunks as one, two by two."""
    while len(chunks) > 1:
        chunks = [chunks[k].then(chunks[k + 1], t) if k + 1 < len(chunks) else chunks[k] for k in range(0, len(chunks), 2)]
    return chunks[0]


def count(text: str, t: Transducer, size: int = CHUNK) -> int:
    if not text:
        return 0
    text = " " + text.replace(SPACE, " ")
    if len(text) <= size:
        return Chunk.of(text, t).total(t)
    return joined([Chunk.of(text[k : k + size], t) for k in range(0, len(text), size)], t).total(t)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            n_bytes, n = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                n_bytes.append(len(text.encode()))
                n.append(count(text, t))
            yield pa.record_batch([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return tidy(run, "token_counts")


def token_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: what the library
    gives for the whole text, without begin and end ids. Null counts as empty,
    which has no tokens; rows without doc_id are counted like others."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_count(model or default_model(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
