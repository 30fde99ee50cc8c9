"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary with word ends.

Why a transducer exists.  In byte-pair encoding the tokens of a word's prefix end in one determined token, and a token
can follow another only if merging the two strings alone gives back just these two.  So, reading a word left to right,
it is enough to know, for every earlier place from which a vocabulary entry may still be growing, the last token there.
That knowledge is a state: a set of (trie node, last token, tokens so far), tokens counted from the smallest of the set.
What is subtracted to get there is emitted on the transition, as in the determinisation of weighted automata, so each
transition carries its count; the last byte of a word has transitions of its own, which emit the rest and lead back to
the start.  States and transitions are made when first needed and kept in one table.

Running it.  Texts become symbols (bytes, word-final bytes apart) with array operations and are cut into chunks of CHUNK
symbols.  A chunk's state map is known without its entry state but for its head, the symbols up to its first word end:
behind that the state is the start.  All tails run in lockstep, one table look-up a step.  The state maps of heads
(entry state to exit state and count) are composed along the chunks; only chunks inside one giant word pass states on.
Of such a map those entries are made that can occur: all chunks of a word run in lockstep from the exit states that their
predecessors have shown so far.  Words forget where they were cut after a few symbols, so two rounds do as a rule; in
periodic ones a handful of states comes again and again, so the commonest are run for all chunks, and composing is then
looking up.  Sums of emitted counts are the token counts.

Words come from the vocabulary's own rules: lower case, NFC, runs of letters, single digits, runs of other signs, English
contractions; white space is dropped, special strings are one token each.  Character classes are asked from the
tokenizer file's own splitting rule, one character at a time, when first met.

Null text counts as empty and has no tokens; every row is counted for itself, whole; other columns do not matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

CHUNK = 1_024
CHARS_AT_ONCE = 1 << 21
MOST_STATES = 200_000
COMMON_STATES = 16
LIMIT = 2_048
WORD_END = "</w>"
NEVER = float("inf")
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
START = 0


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens as sequences of symbols (0 to 255 a byte, 256 to 511 a byte that ends a word), and when they merge."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.single = [ids[c] for c in letters] + [ids[c + WORD_END] for c in letters]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.symbols: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(self.single)}
        for n, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left, right] = (n, whole)
            self.symbols.setdefault(whole, self.symbols[left] + self.symbols[right])
        self.specials = [t["content"] for t in self.spec["added_tokens"]]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, symbols in self.symbols.items():
            node = 0
            for s in symbols:
                node = self.children[node].setdefault(s, len(self.children))
                if node == len(self.token_at):
                    self.children.append({})
                    self.token_at.append(-1)
            self.token_at[node] = token
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: tuple[int, ...]) -> list[tuple]:
        """Byte-pair encoding by its definition, as trees (token, left tree, right tree, rank of their merge)."""
        parts: list[tuple] = [(self.single[s], None, None, -1) for s in symbols]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i][0], parts[i + 1][0]), (NEVER,))[0])
            found = self.rank.get((parts[best][0], parts[best + 1][0]))
            if found is None:
                break
            parts[best:best + 2] = [(found[1], parts[best], parts[best + 1], found[0])]
        return parts

    def spines(self, token: int) -> tuple[list, list] | None:
        """(first parts, last parts) of a token over its merges, each (token, rank of the merge that ends it); None if
        the token's own string is never encoded as the token."""
        if token not in self._spines:
            tree = self.merged(self.symbols[token])
            sides = []
            for side in (1, 2):
                node, end, spine = tree[0], NEVER, []
                while node is not None:
                    spine.append((node[0], end))
                    node, end = node[side], node[3]
                sides.append(spine)
            self._spines[token] = (sides[0], sides[1]) if len(tree) == 1 else None
        return self._spines[token]

    def follows(self, first: int, second: int) -> bool:
        """Whether the strings of two tokens, put together, are encoded as these two tokens."""
        key = (first, second)
        if key not in self._follows:
            a, b = self.spines(first), self.spines(second)
            self._follows[key] = a is not None and b is not None and not any(
                (m := self.rank.get((x, y))) and m[0] < x_end and m[0] <= y_end for x, x_end in a[1] for y, y_end in b[0])
        return self._follows[key]


class Transducer:
    """Deterministic states and transitions with emitted counts, made on demand."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.column = np.full(512, -1, dtype=np.int64)
        self.width = 64
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: START}
        self.column[:] = -1
        self.symbol_of: list[int] = []
        self.table = np.full((1_024, self.width), -1, dtype=np.int32)  # next state * 256 + emitted count

    def make_room(self) -> None:
        """Forget everything if too many states were made; between runs only."""
        if len(self.states) > MOST_STATES:
            self._clear()

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.column[s] < 0:
                if len(self.symbol_of) == self.width:
                    self.width *= 2
                    self.table = np.hstack([self.table, np.full_like(self.table, -1)])
                self.column[s] = len(self.symbol_of)
                self.symbol_of.append(int(s))
        return self.column[symbols]

    def _make(self, state: int, column: int) -> int:
        v, symbol = self.vocabulary, self.symbol_of[column]
        grown = []
        reached = None
        for node, last, count in self.states[state]:
            child = v.children[node].get(symbol)
            if child is None:
                continue
            grown.append((child, last, count))
            token = v.token_at[child]
            if token >= 0 and (last < 0 and v.spines(token) is not None or last >= 0 and v.follows(last, token)):
                reached = (token, count + 1)
        if reached is None:
            raise ValueError("no token ends here; the vocabulary has no single bytes")
        if reached[1] > 255:
            raise ValueError("a transition would emit more tokens than its table cell holds")
        if symbol >= 256:
            return START * 256 + reached[1]
        grown.append((0, reached[0], reached[1]))
        base = min(count for _, _, count in grown)
        key = tuple((node, last, count - base) for node, last, count in grown if v.children[node])
        if key not in self.number:
            if len(self.states) == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, -1)])
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key] * 256 + base

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and emitted count of each stretch of symbol columns, all stretches in lockstep."""
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state, count = entry[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        for step, m in enumerate(active):
            column = symbols[at[:m] + step]
            found = self.table[state[:m], column]
            if (missing := np.flatnonzero(found < 0)).size:
                for pair in np.unique(state[missing] * 512 + column[missing]):
                    s, c = divmod(int(pair), 512)
                    made = self._make(s, c)
                    self.table[s, c] = made
                found = self.table[state[:m], column]
            state[:m] = found >> 8
            count[:m] += found & 255
        out_state, out_count = np.empty_like(state), np.empty_like(count)
        out_state[order], out_count[order] = state, count
        return out_state, out_count


class Splitter:
    """Texts to symbols: normal form, words, and word ends, by array operations."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def normal(self, text: str) -> str:
        if text.isascii() or (max(text) < "ɐ" and unicodedata.is_normalized("NFC", text)):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _kind_of(self, char: str) -> int:
        split = lambda s: [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]
        if len(split(f"a{char}a")) == 1:
            return LETTER
        if len(split(f"!{char}!")) == 1:
            return OTHER
        return NUMBER if split(char) else SPACE

    def kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (new := kinds == UNKNOWN).any():
            for p in np.unique(points[new]):
                self.kind[p] = self._kind_of(chr(p))
            kinds = self.kind[points]
        return kinds

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts (in normal form), and where each text's symbols end."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kind = self.kinds(points)
        starts = np.ones(len(points), dtype=bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        self._contractions(points, kind, starts)
        ends = np.ones(len(points), dtype=bool)
        ends[:-1] = starts[1:]
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        symbols = np.frombuffer(joined.encode(), dtype=np.uint8).astype(np.int64)
        symbols[np.cumsum(sizes)[ends] - 1] += 256
        solid = np.repeat(kind != SPACE, sizes)
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1  # place of the line break behind each text
        before = np.cumsum(np.where(kind != SPACE, sizes, 0))
        return symbols[solid], before[breaks]

    @staticmethod
    def _contractions(points: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> None:
        """At the start of a run of signs, ' with s, t, m, d, re, ve or ll is one word, whatever letters follow."""
        at = np.flatnonzero((points == ord("'")) & starts)
        at = at[at + 2 < len(points)]
        one, two = points[at + 1], points[at + 2]
        is_ = lambda p, c: p == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = (is_(one, "r") | is_(one, "v")) & is_(two, "e") | is_(one, "l") & is_(two, "l")
        for found, size in ((at[short], 2), (at[long], 3)):
            for k in range(1, size):
                starts[found + k] = False
            starts[found[found + size < len(points)] + size] = True


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str) -> None:
        self.splitter = Splitter(path)
        self.vocabulary = Vocabulary(path)
        self.transducer = Transducer(self.vocabulary)
        self.special = re.compile("|".join(map(re.escape, self.vocabulary.specials)) or r"(?!)")

    def count(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), dtype=np.int64)
        batch: list[str] = []
        owner: list[int] = []
        chars = 0
        for i, text in enumerate(texts):
            pieces = self.special.split(text)
            counts[i] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    batch.append(self.splitter.normal(piece))
                    owner.append(i)
                    chars += len(piece)
            if chars >= CHARS_AT_ONCE:
                np.add.at(counts, owner, self._counted(batch))
                batch, owner, chars = [], [], 0
        if batch:
            np.add.at(counts, owner, self._counted(batch))
        return counts

    def _counted(self, texts: list[str]) -> np.ndarray:
        symbols, text_ends = self.splitter.symbols(texts)
        machine = self.transducer
        machine.make_room()
        columns = machine.columns(symbols)
        text_starts = np.r_[0, text_ends[:-1]]
        sizes = text_ends - text_starts
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        first = np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = text_starts[owner] + (np.arange(len(owner)) - first) * CHUNK
        end = np.minimum(start + CHUNK, text_ends[owner])
        counts = np.zeros(len(texts), dtype=np.int64)
        if not len(owner):
            return counts
        # The head of a chunk ends with its first word end; a chunk that begins a text has no head.
        word_ends = np.flatnonzero(symbols >= 256) + 1
        next_end = np.r_[word_ends, len(symbols) + 1][np.searchsorted(word_ends, start, side="right")]
        begins = np.arange(len(owner)) == first
        resets = begins | (next_end <= end)
        tail = np.where(begins, start, np.minimum(next_end, end))
        at_start = np.zeros(len(owner), dtype=np.int64)
        exits, tail_counts = machine.run(columns, tail, end - tail, at_start)
        np.add.at(counts, owner, tail_counts)
        # Heads whose predecessor ends in a known state, then those inside giant words.
        heads = np.flatnonzero(~begins)
        heads = heads[tail[heads] > start[heads]]
        inner = ~resets[heads - 1]
        plain = heads[~inner]
        states, head_counts = machine.run(columns, start[plain], tail[plain] - start[plain], exits[plain - 1])
        np.add.at(counts, owner[plain], head_counts)
        passed = ~resets[plain]
        exits[plain[passed]] = states[passed]
        giant = heads[inner]
        np.add.at(counts, owner[giant], self._composed(columns, giant, start[giant], tail[giant] - start[giant], exits))
        return counts

    def _composed(self, columns: np.ndarray, chunks: np.ndarray, starts: np.ndarray, lengths: np.ndarray, exits: np.ndarray) -> np.ndarray:
        """Emitted counts of heads whose entry state is the exit state of the head before; `exits` has it where known."""
        linked = np.r_[False, np.diff(chunks) == 1].tolist() if len(chunks) else []
        maps: list[dict[int, tuple[int, int]]] = [{} for _ in linked]
        counts = np.zeros(len(linked), dtype=np.int64)
        rounds = 0
        while True:
            wanted, after = [], START
            for k, joined in enumerate(linked):  # compose from the left, on guesses where a map lacks the entry
                state = after if joined else int(exits[chunks[k] - 1])
                if state in maps[k]:
                    after, counts[k] = maps[k][state]
                else:
                    wanted.append((k, state))
                    after = next(reversed(maps[k].values()))[0] if maps[k] else START
            if not wanted:
                return counts
            if rounds > 3:  # not forgetful: run the commonest states for all chunks of such words
                unsure = {k for k, _ in wanted}
                seen = Tally(state for k in unsure for state, _ in maps[k].values())
                wanted += [(k, state) for state, _ in seen.most_common(COMMON_STATES) for k in unsure if state not in maps[k]]
            pairs = sorted(set(wanted))
            at = np.array([k for k, _ in pairs], dtype=np.int64)
            found, emitted = self.transducer.run(columns, starts[at], lengths[at], np.array([e for _, e in pairs], dtype=np.int64))
            for (k, e), state, n in zip(pairs, found.tolist(), emitted.tolist()):
                maps[k][e] = state, n
            rounds += 1


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column under the tokenizer file at `path`."""
    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counter(path).count([t or "" for t in texts]))

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
