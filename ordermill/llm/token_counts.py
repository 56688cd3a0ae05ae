"""Token counts by compiled finite-state transducers, for BPE vocabularies with word ends.

Two deterministic transducers give the count that the tokenizer's library would give:

- The *lexer* reads character classes and marks where pieces begin (runs of letters, single
  digits, runs of other signs, contractions). It has seven states, so a chunk of text is a map
  from entry state to exit state. All chunks of a block run in lockstep from every state, their
  maps compose by a parallel prefix scan, and a second run from the then known entry states
  marks the pieces.
- The *merger* reads the bytes of a piece. Its states hold what the rest of a piece can still
  depend on: for every suffix that may grow into a longer token, the token before it and the
  count up to there. A transition carries the number of tokens it emits, negative when bytes
  join earlier ones to one token. States are compiled when text first reaches them and kept, up
  to a bound. It rests on a property of BPE: the last token of a prefix is the only token that
  ends it and stays apart from the last token of what comes before.

Defined cases: null and empty texts have no tokens and no bytes. Texts of any length are read
whole, in blocks cut at white space. Every row gets its own result; null ids are kept. Other
input columns are ignored. The strings of special tokens inside a text count as one token each.
Classes of letters are the library's, which is asked for them; texts that hold a letter whose
lower or composed form it knows otherwise than this process does are counted by the library itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LIMIT = 2048
BLOCK = 1 << 20
CHUNK = 1024
KEPT_WORDS = 200_000
KEPT_TRANSITIONS = 400_000

# --- the lexer -----------------------------------------------------------------------------

# character classes
SPACE, DIGIT, OTHER, APOSTROPHE, LETTER, ENDING, LETTER_R, LETTER_V, LETTER_L, LETTER_E = range(10)
# states: between pieces; in letters; in other signs; after an opening apostrophe, alone and
# with r, v or l behind it
OUT, IN_LETTERS, IN_OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
BEGINS, BEGAN_BEFORE = 1, 2  # a piece begins here; one began at the character before


def _compile_lexer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for each (state, class), flattened."""
    after = np.zeros((7, 10), np.uint8)
    marks = np.zeros((7, 10), np.uint8)
    letters = range(LETTER, 10)
    for state in range(7):
        undecided = state >= QUOTE_R
        for c in range(10):
            if c in (SPACE, DIGIT):
                after[state, c] = OUT
            elif c in letters:
                after[state, c] = IN_LETTERS
            elif c == APOSTROPHE and state not in (IN_OTHERS, QUOTE):
                after[state, c] = QUOTE
            else:
                after[state, c] = IN_OTHERS
            inside = (
                c == SPACE
                or (c in letters and (state == IN_LETTERS or undecided))
                or (c in (OTHER, APOSTROPHE) and state in (IN_OTHERS, QUOTE))
            )
            # a letter held back after an apostrophe turns out to begin a piece of its own
            marks[state, c] = (0 if inside else BEGINS) | (BEGAN_BEFORE if undecided else 0)
    for c, state in ((LETTER_R, QUOTE_R), (LETTER_V, QUOTE_V), (LETTER_L, QUOTE_L)):
        after[QUOTE, c], marks[QUOTE, c] = state, 0
    for state, c in ((QUOTE, ENDING), (QUOTE_R, LETTER_E), (QUOTE_V, LETTER_E), (QUOTE_L, LETTER_L)):
        after[state, c], marks[state, c] = OUT, 0
    return after.ravel(), marks.ravel()


_AFTER, _MARKS = _compile_lexer()


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(
        map(chr, range(0xE000, 0x110000))
    )
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, number in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\p{White_Space}+", SPACE)):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = number
    out[0xD800:0xE000] = OTHER
    for letter, number in zip("stmdrvle'", [ENDING] * 4 + [LETTER_R, LETTER_V, LETTER_L, LETTER_E, APOSTROPHE], strict=True):
        out[ord(letter)] = number
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row c becomes the map of chunks 0 to c. In log2 steps."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.intp), 1)
        step *= 2
    return out


def piece_bounds(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every piece. The classes must end with SPACE."""
    size = len(classes)
    chunks = -(-size // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:size] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[:, None], chunks, 1)
    for step in steps:
        maps = _AFTER[maps * np.uint8(10) + step]
    scanned = compose(np.ascontiguousarray(maps.T))
    state = np.zeros(chunks, np.uint8)
    state[1:] = scanned[:-1, OUT]
    marks = np.empty_like(steps)
    for step, out in zip(steps, marks, strict=True):
        at = state * np.uint8(10) + step
        out[:] = _MARKS[at]
        state = _AFTER[at]
    flat = marks.T.ravel()[:size]
    begins = (flat & BEGINS).astype(bool)
    begins[:-1] |= (flat[1:] & BEGAN_BEFORE) > 0
    start = np.flatnonzero(begins)
    # a piece ends where the next begins, or at the first space before that
    space = np.flatnonzero(classes == SPACE)
    first_space = space[np.searchsorted(space, start)]
    return start, np.minimum(first_space, np.append(start[1:], size))


# --- the merger ----------------------------------------------------------------------------


def _byte_of_sign() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger(dict):
    """The transducer of one vocabulary. Keys are state * 256 + byte, values (state, emitted)."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        byte, end = _byte_of_sign(), self.end

        def symbols(token: str) -> tuple[int, ...]:
            # a byte that ends a word is another symbol than the same byte elsewhere
            final = bool(end) and token.endswith(end)
            data = [byte[c] for c in (token[: -len(end)] if final else token)]
            return (*data[:-1], data[-1] + 256) if final else tuple(data)

        self.rank: dict[tuple, int] = {}
        for i, (a, b) in enumerate(model["merges"]):
            self.rank[symbols(a), symbols(b)] = i
        whole = {symbols(t) for t in model["vocab"] if t}
        self.tokens = {t for t in whole if self.merge(t) == [t]}
        self.beginnings = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.apart: dict[tuple, bool] = {}
        self.forget()

    def merge(self, symbols: tuple[int, ...]) -> list[tuple[int, ...]]:
        """BPE as defined: join the leftmost pair of the lowest rank until none is left."""
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def forget(self) -> None:
        """Back to the start state, which has read nothing and emitted nothing."""
        self.clear()
        self.apart.clear()
        # a state: for each open suffix, longest first, (symbols, token before it, count there)
        self.states = [(((), None, 0),)]
        self.numbers = {self.states[0]: 0}

    def stays_apart(self, left: tuple | None, right: tuple) -> bool:
        if left is None:
            return True
        known = self.apart.get((left, right))
        if known is None:
            known = self.apart[left, right] = self.merge(left + right) == [left, right]
        return known

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """The last token once the symbol is read, and the tokens emitted by then."""
        for suffix, before, count in state:
            token = (*suffix, symbol)
            if token in self.tokens and self.stays_apart(before, token):
                return token, count + 1
        raise ValueError("the vocabulary lacks a byte")

    def __missing__(self, key: int) -> tuple[int, int]:
        state, symbol = self.states[key >> 8], key & 255
        token, emitted = self.step(state, symbol)
        open_ = [
            ((*suffix, symbol), before, count - emitted)
            for suffix, before, count in state
            if (*suffix, symbol) in self.beginnings
        ]
        after = (*open_, ((), token, 0))
        number = self.numbers.setdefault(after, len(self.states))
        if number == len(self.states):
            self.states.append(after)
        self[key] = number, emitted
        return number, emitted

    def count(self, word: bytes) -> int:
        if len(self) > KEPT_TRANSITIONS:
            self.forget()
        state = total = 0
        inner = word[:-1] if self.end else word
        for byte in inner:
            state, emitted = self[state << 8 | byte]
            total += emitted
        if self.end:
            total += self.step(self.states[state], word[-1] + 256)[1]
        return total


class PieceCounts(dict):
    """piece bytes -> tokens, remembering a bounded number of pieces."""

    def __init__(self, merger: Merger) -> None:
        super().__init__()
        self.count = merger.count

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[piece] = self.count(piece)
        return value


@functools.lru_cache(maxsize=2)
def library_letters(path: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Where the tokenizer's library follows another version of Unicode than this process does:
    code points and their classes there, and the letters whose lower or composed form differs.

    Only planes that hold any signs are asked.
    """
    library = Tokenizer.from_file(path)
    points = np.array([*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)])
    own, theirs, odd = _classes(), [], []
    for at in range(0, len(points), 1 << 15):
        some = points[at : at + (1 << 15)]
        # a letter joins letters around it, any other sign but a digit joins signs
        probes = [f"a{chr(p)}a !{chr(p)}!\n" for p in some]
        ends = np.cumsum([len(p) for p in probes])
        found = library.pre_tokenizer.pre_tokenize_str("".join(probes))
        begins = np.array([begin for _, (begin, _) in found])
        of = np.searchsorted(ends, begins, "right")
        within = begins - np.append(0, ends)[of]
        letters = np.bincount(of[within < 3], minlength=len(some)) == 1
        others = np.bincount(of[within > 3], minlength=len(some)) == 1
        rest = np.where(own[some] == SPACE, SPACE, DIGIT)
        theirs.append(np.where(letters, LETTER, np.where(others, OTHER, rest)))
        # no sign composes with the bar between them
        lower = library.normalizer.normalize_str("".join(f"|{chr(p)}" for p in some)).split("|")[1:]
        mine = (_normalised(chr(p)) for p in some)
        odd += [chr(p) for p, a, b in zip(some, lower, mine, strict=True) if a != b and own[p] != SPACE]
    theirs = np.concatenate(theirs).astype(np.uint8)
    other = np.flatnonzero(theirs != own[points])
    return points[other], theirs[other], "".join(odd)


class TokenCounter:
    """Counts tokens of texts, many at a time. ``path`` is a tokenizer's JSON file.

    ``letters`` are the library's (``library_letters``); texts that hold one of those whose
    lower or composed form differs are counted by the library.
    """

    def __init__(self, path: str, letters: tuple[np.ndarray, np.ndarray, str] | None = None) -> None:
        merger = Merger(path)
        points, classes, odd = letters or library_letters(path)
        self.classes = _classes().copy()
        self.classes[points] = classes
        self.odd = regex.compile(f"[{odd}]") if odd else None
        self.library = Tokenizer.from_file(path)
        self.pieces = PieceCounts(merger)
        special = [t["content"] for t in merger.spec["added_tokens"]]
        self.special = (
            regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
            if special
            else None
        )

    def _blocks(self, text: str) -> Iterator[str]:
        """The normalised text in blocks that begin at white space."""
        start = 0
        while len(text) - start > BLOCK:
            cut = min((c for c in (text.find(s, start + BLOCK) for s in " \n") if c > 0), default=-1)
            if cut < 0:
                break
            yield _normalised(text[start:cut])
            start = cut
        yield _normalised(text[start:])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.odd and not text.isascii() and self.odd.search(text):
                totals[i] = len(self.library.encode(text, add_special_tokens=False).ids)
                continue
            if self.special:
                text, found = self.special.subn(" ", text)
                totals[i] += found
            for block in self._blocks(text):
                if size + len(block) > BLOCK and held:
                    self._add(held, owner, totals)
                    held, owner, size = [], [], 0
                held.append(block)
                owner.append(i)
                size += len(block)
        if held:
            self._add(held, owner, totals)
        return totals

    def _add(self, blocks: list[str], owner: list[int], totals: np.ndarray) -> None:
        joined = "\n".join(blocks) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start, end = piece_bounds(self.classes[points])
        if not len(start):
            return
        ends = np.cumsum([len(b) + 1 for b in blocks])
        block_of = np.searchsorted(ends, start, "right")
        data = joined.encode()
        if len(data) > len(points):
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(width)])
            start, end = at[start], at[end]
        pieces = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        counts = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        np.add.at(totals, np.array(owner), np.bincount(block_of, counts, len(blocks)).astype(np.int64))


def _normalised(text: str) -> str:
    """Composed and lower-cased letter by letter, so a final sigma is no special case."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


# One per Python worker, so tasks that follow each other share the compiled states
_counters: dict[str, TokenCounter] = {}


def _count(path: str, letters: tuple[np.ndarray, np.ndarray, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path)
        if counter is None:
            counter = _counters[path] = TokenCounter(path, letters)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = counter(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts)],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(
    documents: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        documents.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
            text.alias("text"),
        )
        .mapInArrow(_count(tokenizer_path, library_letters(tokenizer_path)), "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
