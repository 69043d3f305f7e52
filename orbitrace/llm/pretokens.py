"""Byte-level BPE pre-tokens by a finite-state transducer over character classes.

The transducer splits a text into contractions, letter runs, number runs, other runs (each of the last three with at most
one leading space) and white space. Its transitions are annotated with the number of pre-tokens they open, 0 or 1. A
stream of characters is cut into chunks; the chunks' state maps are worked out side by side, composed by a parallel
prefix scan, and each chunk is then read once from its true start state.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

from orbitrace.llm.text_hash import word_hashes

CHUNK = 128
# Input symbols. LONE and LAST tell whether a white space character is followed by a non-space.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_MID, SPACE_LAST, WHITE_MID, WHITE_LAST, STOP = range(10)
# States: what is open.
FRESH, LETTERS, NUMBERS, OTHERS, WHITE, PREFIX, ONE_LEFT, TWO_LEFT = range(8)
#: Code points of white space in the splitting pattern, and its contractions.
WHITE_SPACE = (
    9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009,
    0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, opened pre-tokens)`` tables by state and symbol."""
    nxt = np.zeros((8, 10), dtype=np.uint8)
    opens = np.zeros((8, 10), dtype=np.uint8)

    def rule(state, symbol, to, opened):
        nxt[state, symbol], opens[state, symbol] = to, opened

    for s in range(8):
        for symbol, run in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            rule(s, symbol, run, 0 if s in (run, PREFIX) else 1)
        for symbol, left in ((QUOTE2, ONE_LEFT), (QUOTE3, TWO_LEFT)):
            if s in (OTHERS, PREFIX):  # the quote goes on with, or starts, a run of others
                rule(s, symbol, OTHERS, 0)
            else:
                rule(s, symbol, left, 1)
        for symbol in (SPACE_MID, WHITE_MID):
            rule(s, symbol, WHITE, 0 if s == WHITE else 1)
        rule(s, SPACE_LAST, PREFIX, 1)
        rule(s, WHITE_LAST, WHITE, 1)
        rule(s, STOP, FRESH, 1)
    rule(ONE_LEFT, LETTER, FRESH, 0)
    rule(TWO_LEFT, LETTER, ONE_LEFT, 0)
    return nxt, opens


NEXT, OPENS = compile_transducer()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Symbol of every code point before look-ahead; white space is SPACE_MID or WHITE_MID."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE_SPACE)] = WHITE_MID
    table[32] = SPACE_MID
    return table


def symbols(chars: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Input symbols of code points ``chars``; ``stops`` are places that end a text."""
    out = class_table()[chars]
    out[stops] = STOP
    after = np.concatenate([out[1:], [STOP]])
    white = (out == SPACE_MID) | (out == WHITE_MID)
    followed = (after != SPACE_MID) & (after != WHITE_MID) & (after != STOP)
    out += white & followed
    quotes = np.flatnonzero(chars == 39)
    quotes = quotes[out[quotes] == OTHER]
    if len(quotes):
        padded = np.concatenate([chars, [0, 0]])
        one, two = padded[quotes + 1], padded[quotes + 2]
        for word in CONTRACTIONS:
            if len(word) == 2:
                out[quotes[one == ord(word[1])]] = QUOTE2
            else:
                out[quotes[(one == ord(word[1])) & (two == ord(word[2]))]] = QUOTE3
    return out


def chunk_maps(grid: np.ndarray) -> np.ndarray:
    """State map of every chunk, ``(chunks, 8)``; ``grid`` is ``(place, chunk)``.

    All white space and stop symbols lead every state to one state. A chunk with such a symbol has a constant map, so
    only what follows its last one is read; the other chunks are read for all eight start states.
    """
    chunk, rows = grid.shape
    maps = np.empty((rows, 8), dtype=np.uint8)
    settles = grid >= SPACE_MID
    has = settles.any(axis=0)
    last = chunk - 1 - np.argmax(settles[::-1], axis=0)
    live = np.flatnonzero(has)
    at = last[live]
    state = NEXT[0][grid[at, live]]
    maps[live] = state[:, None]
    while True:
        at = at + 1
        go = at < chunk
        if not go.any():
            break
        live, at, state = live[go], at[go], state[go]
        state = NEXT[state, grid[at, live]]
        maps[live] = state[:, None]
    rest = np.flatnonzero(~has)
    if len(rest):
        part = np.tile(np.arange(8, dtype=np.uint8), (len(rest), 1))
        for j in range(chunk):
            part = NEXT[part, grid[j, rest][:, None]]
        maps[rest] = part
    return maps


def scan(stream: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Pre-tokens opened at each place of a symbol stream that starts in FRESH."""
    n = len(stream)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, STOP, dtype=np.uint8)
    padded[:n] = stream
    grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    maps = chunk_maps(grid)
    # inclusive prefix scan of map composition, then shift by one chunk
    step = 1
    while step < rows and not (maps[:, :1] == maps).all():
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    width = NEXT.shape[1]
    both = (NEXT.astype(np.uint8) * width * 2 + OPENS).ravel()  # next state times width, and what opens
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = maps[:-1, FRESH] * width
    opened = np.empty((chunk, rows), dtype=np.uint8)
    for j in range(chunk):
        got = both[state + grid[j]]
        opened[j] = got & 1
        state = got >> 1
    return opened.T.ravel()[:n]


class Spans:
    """Pre-tokens of a batch of texts: ``start`` and ``end`` in ``joined``, ``row``, and a hash as ``key``, per pre-token."""

    def __init__(self, texts: list[str]):
        self.joined = "\x00".join(texts) + "\x00"
        chars = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stops = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) - 1
        opened = np.flatnonzero(scan(symbols(chars, stops)))
        # a stop symbol is an opening of its own, so each opening ends where the next one starts
        is_text = np.ones(len(opened), dtype=bool)
        is_text[np.searchsorted(opened, stops)] = False
        after = np.append(opened[1:], len(chars))
        self.start, self.end = opened[is_text], after[is_text]
        self.row = np.searchsorted(stops, self.start)
        self.key = word_hashes(chars, self.start, self.end)
        self.chars = chars

    def distinct(self) -> tuple[list[str], np.ndarray]:
        """Distinct pre-tokens, and each pre-token's place among them.

        Hashes bring equal ones together; each is then compared with the first of its hash, letter by letter, and one
        that differs is told apart by its text.
        """
        place, keys = pd.factorize(self.key)
        sample = np.empty(len(keys), dtype=np.int64)
        sample[place[::-1]] = np.arange(len(place))[::-1]
        words = [self.joined[a:b] for a, b in zip(self.start[sample].tolist(), self.end[sample].tolist(), strict=True)]
        odd = self._unlike(sample[place])
        if len(odd):
            place, known = place.copy(), {}
            for i in odd.tolist():
                word = self.text(i)
                if word not in known:
                    known[word] = len(words)
                    words.append(word)
                place[i] = known[word]
        return words, place

    def text(self, i: int) -> str:
        return self.joined[self.start[i] : self.end[i]]

    def _unlike(self, other: np.ndarray) -> np.ndarray:
        """Pre-tokens that are not letter by letter the ones whose numbers stand in ``other``."""
        size = self.end - self.start
        unlike = size != size[other]
        total = np.cumsum(size)
        if len(size):
            # letters of all pre-tokens one after the other, and those of the others beside them
            shift = np.repeat(self.start - (total - size), size)
            at = np.arange(total[-1]) + shift
            beside = np.minimum(at + np.repeat(self.start[other] - self.start, size), len(self.chars) - 1)
            wrong = np.flatnonzero(self.chars[at] != self.chars[beside])
            unlike[np.searchsorted(total, wrong, side="right")] = True
        return np.flatnonzero(unlike)


def split_special(texts: list[str], special: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Parts of the texts between special strings, the row of each part, and the rows at whose parts' ends one stood.

    The third list has, per part, the index of the special string that follows it, or -1.
    """
    pattern = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
    parts, rows, follows = [], [], []
    for row, text in enumerate(texts):
        at = 0
        if pattern is not None and any(s in text for s in special):
            for m in pattern.finditer(text):
                parts.append(text[at : m.start()])
                rows.append(row)
                follows.append(special.index(m.group()))
                at = m.end()
        parts.append(text[at:])
        rows.append(row)
        follows.append(-1)
    return parts, rows, follows
