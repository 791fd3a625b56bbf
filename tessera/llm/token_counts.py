"""Token counts by a deterministic transducer whose transitions carry the number of tokens that they add.

A byte-fallback BPE model of pieces is compiled into a finite-state machine over characters.
A state holds what may still become of the text's end: for every place where a piece could have
begun that goes on, its node in the tree of pieces, the token that ends there, and the difference of the counts there
and here. Reading a character, exactly one piece can end the text's prefix: the one that the token before it tolerates,
which is if the two, written together, are merged into just them. So the count of a prefix's tokens changes by a number
that state and character give, below zero where pieces merge. States are made when first met and forgotten beyond a bound.

Texts run through the machine as one stream of characters, cut into lanes of equal length
that advance side by side. A lane is a map of states to (state, count), known for the states in which it may be
entered: what its left neighbours' ends give, begun with a guess from the characters before it. A parallel prefix
scan composes the lanes' maps, and with them the counts at every text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for white space in pieces, and before every text.
SPACE = "▁"
#: No token, or one that tolerates everything.
FREE = -1
#: Slots of the table of transitions (a power of two), at most half of them used, and states that are remembered.
SLOTS, STATES = 1 << 22, 150_000
#: Characters that run at once, lanes at most, and characters from which a lane's first state is guessed.
STREAM, LANES, BEFORE = 1 << 22, 4096, 32
#: The code of transitions' values: the next state times 64, plus the count plus 32.
_CODE, _ZERO = 64, 32
#: Spreads keys over slots: any odd 64-bit number does.
_SPREAD = 0x9E3779B97F4A7C15


class Transducer:
    """The machine of one model file; codes of characters, states and transitions are its own numbers."""

    def __init__(self, path: str, states: int = STATES, slots: int = SLOTS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        special = (model.is_byte, model.is_unknown, model.is_control, model.is_unused)
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        self.texts = [p for p, _ in pieces]
        self.scores, self.numbers = dict(pieces), {p: i for i, (p, _) in enumerate(pieces)}
        letters = sorted(p for p in self.scores if len(p) == 1)
        if SPACE not in letters or len(letters) + 6 > 1 << 16:
            raise ValueError("a model whose pieces hold the mark of white space and fewer than 65,530 characters is asked for")
        self.letters = {c: i for i, c in enumerate(letters)}
        self.unknown, self.start, self.idle = len(letters), len(letters) + 4, len(letters) + 5
        codes = np.full(0x110000, self.unknown + 3, np.uint16)
        for n, end in ((2, 0x10000), (1, 0x800), (0, 0x80)):
            codes[:end] = self.unknown + n
        codes[[ord(c) for c in letters]] = range(len(letters))
        codes[0x20] = codes[ord(SPACE)]
        self.codes = codes
        self.children: dict[tuple[int, int], int] = {}
        self.piece_at: dict[int, int] = {}
        pairs = set()
        for number, piece in enumerate(self.texts):
            node = 0
            for c in piece:
                node = self.children.setdefault((node, self.letters[c]), len(self.children) + 1)
            self.piece_at[node] = number
            pairs.update(zip(piece, piece[1:]))
        self.goes_on = {node for node, _ in self.children}
        #: Letters after which, within a piece, a letter may come.
        self.pairs = {(self.letters[a], self.letters[b]) for a, b in pairs}
        self.last = [self.letters[p[-1]] for p in self.texts]
        self.most, self.slots = states, slots
        self.tolerated: dict[tuple[int, int], bool] = {}
        self.sides: dict[int, tuple[list, list] | None] = {}
        self._forget([])

    def _forget(self, keep: list[tuple]) -> None:
        self.states, self.known = [], {}
        self.keys, self.values = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        self.used, self.bits = 0, 65 - self.slots.bit_length()
        self.tolerated.clear()
        for state in (((0, FREE, 0),), *keep):
            self._state(state)

    def compact(self, *held: np.ndarray) -> list[np.ndarray]:
        """The arrays of states with the numbers they have from now on; if there are too many states or transitions, all others are forgotten."""
        if len(self.states) <= self.most and self.used <= self.slots // 2 - (1 << 16):
            return list(held)
        olds = np.unique(np.concatenate(held))
        kept = [self.states[i] for i in olds.tolist()]
        self._forget(kept)
        new = np.array([self.known[s] for s in kept], np.int64)
        return [new[np.searchsorted(olds, x)] for x in held]

    def _state(self, state: tuple) -> int:
        number = self.known.get(state)
        if number is None:
            number = self.known[state] = len(self.states)
            self.states.append(state)
        return number

    def merged(self, text: str, trace: list | None = None) -> list[str]:
        """The pieces of a text of known characters: the best-scored pair that makes a piece is merged, the leftmost of several, until none is left.

        trace: gets score, place and number of parts of each merge.
        """
        parts, scores = list(text), self.scores
        while True:
            made = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
            if not made:
                return parts
            score, i = min(made)
            if trace is not None:
                trace.append((-score, i, parts[0], parts[-1], len(parts)))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _sides(self, number: int) -> tuple[list, list] | None:
        """A token's first parts and its last parts while it is merged, each with the score of the merge that ends it; None if scores rise meanwhile."""
        if number not in self.sides:
            trace: list = []
            self.merged(self.texts[number], trace)
            steady = all(a[0] >= b[0] for a, b in zip(trace, trace[1:]))
            firsts = [(first, score) for score, i, first, _, _ in trace if i == 0] + [(self.texts[number], -np.inf)]
            lasts = [(last, score) for score, i, _, last, n in trace if i == n - 2] + [(self.texts[number], -np.inf)]
            self.sides[number] = (firsts, lasts) if steady else None
        return self.sides[number]

    def _apart(self, token: int, piece: int) -> bool:
        """Whether the two, written together, are merged into just them: nothing is merged across the place where they meet, as long as parts last there."""
        a, b = self.texts[token], self.texts[piece]
        sides = self._sides(token), self._sides(piece)
        if SPACE * 2 in a + b or None in sides:
            return self.merged(a + b) == [a, b]
        lasts, firsts, i, j = sides[0][1], sides[1][0], 0, 0
        while True:
            (x, x_ends), (y, y_ends) = lasts[i], firsts[j]
            across = self.scores.get(x + y)
            if across is not None and across > x_ends and across >= y_ends:
                return False
            if x_ends == y_ends == -np.inf:
                return True
            if x_ends >= y_ends:
                i += 1
            else:
                j += 1

    def tolerates(self, token: int, piece: int) -> bool:
        known = self.tolerated.get((token, piece))
        if known is None:
            known = self.tolerated[token, piece] = self._apart(token, piece)
        return known

    def step(self, state: tuple, code: int) -> tuple[tuple, int]:
        """The state after a character, and the number of tokens that it adds."""
        if code == self.idle:
            return state, 0
        if code >= self.unknown:
            return ((0, FREE, 0),), 0 if code == self.start else code - self.unknown + 1
        open_, found = [], None
        for node, token, less in state:
            if node == 0 and token != FREE and (self.last[token], code) not in self.pairs:
                token = FREE
            child = self.children.get((node, code))
            if child is None:
                continue
            piece = self.piece_at.get(child)
            if found is None and piece is not None and (token == FREE or self.tolerates(token, piece)):
                found = piece, less + 1
            if child in self.goes_on:
                open_.append((child, token, less))
        piece, added = found
        return (*((node, token, less - added) for node, token, less in open_), (0, piece, 0)), added

    def _make(self, key: int) -> None:
        state, added = self.step(self.states[key >> 16], key & 0xFFFF)
        slot = (key * _SPREAD & (1 << 64) - 1) >> self.bits
        while self.keys[slot] != -1:
            slot = (slot + 1) % self.slots
        self.keys[slot], self.values[slot] = key, self._state(state) * _CODE + added + _ZERO
        self.used += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(self.bits)).astype(np.int64)

    def follow(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The transitions' values, lane by lane."""
        keys = (states << 16) | codes
        slots = self._slots(keys)
        rest = np.flatnonzero(self.keys[slots] != keys)
        while len(rest):
            there = self.keys[slots[rest]]
            for key in np.unique(keys[rest[there == -1]]).tolist():
                self._make(key)
            there = self.keys[slots[rest]]
            rest = rest[there != keys[rest]]
            slots[rest] = (slots[rest] + 1) % self.slots
            rest = rest[self.keys[slots[rest]] != keys[rest]]
        return self.values[slots]


class Stream:
    """Runs a machine over codes, block by block; the state carries over."""

    def __init__(self, machine: Transducer, lanes: int = LANES, before: int = BEFORE):
        self.machine, self.lanes, self.before, self.state = machine, lanes, before, ((0, FREE, 0),)

    def _run(self, codes: np.ndarray, states: np.ndarray, held: list[np.ndarray], added: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """The states after all rows of codes (one row a step), with the counts of each step in added; held: states to go on with."""
        for t in range(len(codes)):
            states, *held = self.machine.compact(states, *held)
            values = self.machine.follow(states, codes[t])
            states = values // _CODE
            if added is not None:
                added[t] = values % _CODE - _ZERO
        return states, held

    def counts(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many tokens the first ends[i] of codes add, for each i."""
        m, n = self.machine, len(codes)
        length = max(64, -(-n // self.lanes))
        lanes = -(-n // length)
        grid = np.full(lanes * length, m.idle, np.uint16)
        grid[:n] = codes
        # guesses: what the characters before a lane lead to
        steps = np.full((self.before, lanes), m.idle, np.uint16)
        for k in range(min(self.before, n)):
            at = np.arange(1, lanes) * length - 1 - k
            steps[self.before - 1 - k, 1:] = np.where(at >= 0, grid[at], m.idle)
        guess, _ = self._run(steps, np.zeros(lanes, np.int64), [], None)
        guess[0] = m._state(self.state)
        across = np.ascontiguousarray(grid.reshape(lanes, length).T)
        lane, entry, exit_ = np.arange(lanes), guess, np.zeros(0, np.int64)
        added = np.zeros((length, 0), np.int8)
        todo = np.arange(lanes)
        while len(todo):
            own = np.zeros((length, len(todo)), np.int8)
            out, (entry, exit_) = self._run(across[:, lane[todo]], entry[todo], [entry, exit_], own)
            exit_, added = np.concatenate([exit_, out]), np.concatenate([added, own], axis=1)
            known = np.unique((lane << 32) | entry)
            needed = np.unique(((lane[todo] + 1) << 32) | out)
            new = needed[(needed >> 32 < lanes) & ~np.isin(needed, known)]
            todo = np.arange(len(lane), len(lane) + len(new))
            lane, entry = np.concatenate([lane, new >> 32]), np.concatenate([entry, new & 0xFFFFFFFF])
        # the lanes' maps: places of entry states to places in the next lane
        order = np.lexsort((entry, lane))
        first = np.searchsorted(lane[order], np.arange(lanes + 1))
        place = np.zeros(len(lane), np.int64)
        place[order] = np.arange(len(lane)) - first[lane[order]]
        by = np.argsort((lane << 32) | entry)
        to = np.minimum(np.searchsorted(((lane << 32) | entry)[by], ((lane + 1) << 32) | exit_), len(by) - 1)
        width = int(place.max()) + 1
        maps, sums = np.zeros((lanes, width), np.int64), np.zeros((lanes, width), np.int64)
        maps[lane, place] = np.where(lane + 1 < lanes, place[by[to]], 0)
        sums[lane, place] = added.sum(axis=0, dtype=np.int64)
        d = 1
        while d < lanes:
            then = maps[:-d]
            sums[d:], maps[d:] = sums[:-d] + np.take_along_axis(sums[d:], then, 1), np.take_along_axis(maps[d:], then, 1)
            d *= 2
        begun = int(place[0])
        entered = np.concatenate([[begun], maps[:-1, begun]])
        base = np.concatenate([[0], sums[:, begun]])
        at = np.zeros((lanes, width), np.int64)
        at[lane, place] = np.arange(len(lane))
        real = at[np.arange(lanes), entered]
        self.state = m.states[int(exit_[real[-1]])]
        within = np.cumsum(added[:, real], axis=0, dtype=np.int32)
        in_lane, offset = np.divmod(ends, length)
        partial = np.where(offset > 0, within[np.maximum(offset, 1) - 1, np.minimum(in_lane, lanes - 1)], 0)
        return base[in_lane] + partial

    def of_texts(self, texts: list[str], size: int = STREAM) -> np.ndarray:
        """The number of tokens of each text. size: characters that run at once; longer texts run in parts."""
        m, totals, i = self.machine, np.zeros(len(texts), np.int64), 0
        while i < len(texts):
            j, n = i, 0
            while j < len(texts) and (n == 0 or n + len(texts[j]) <= size):
                n += len(texts[j])
                j += 1
            some = [k for k in range(i, j) if texts[k]]
            i = j
            for lo in range(0, n, size):
                parts = [texts[k][lo : lo + size] for k in some] if n > size else [texts[k] for k in some]
                # every text begins with the mark of a start and that of white space
                heads = ["\0" + SPACE if lo == 0 else ""] * len(parts)
                joined = "".join(h + p for h, p in zip(heads, parts, strict=True))
                codes = m.codes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
                ends = np.cumsum([len(h) + len(p) for h, p in zip(heads, parts, strict=True)])
                starts = np.concatenate([[0], ends[:-1]])
                if lo == 0:
                    codes[starts] = m.start
                counts = self.counts(codes, np.concatenate([starts, ends]))
                totals[some] += counts[len(parts) :] - counts[: len(parts)]
                if n <= size:
                    break
        return totals


_streams: dict[str, Stream] = {}


def stream(path: str) -> Stream:
    """The machine of a file, compiled once a Python worker and used by all its tasks."""
    if path not in _streams:
        _streams[path] = Stream(Transducer(path))
    return _streams[path]


def counted(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (n_tokens > limit) of each row.

    Tokens are those of the whole text by the model file at path, without begin or end; null texts and empty texts have
    none. A row's count depends on its text alone; repeated rows and null doc_ids are rows like others, and columns besides doc_id and
    text are ignored. Nothing is shuffled; a text runs in parts of STREAM characters, so that its length costs no memory but its own. An empty table
    gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["n_tokens"] = stream(path).of_texts(rows.text.tolist())
            yield rows[["doc_id", "n_bytes", "n_tokens"]].astype({"doc_id": "Int64"})

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
