"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into two transducers. The first (``pretokens``) reads characters and opens
pre-tokens. The second reads the bytes of a pre-token; each of its transitions is annotated with the number of tokens
that the longer prefix has more (or less) than the shorter one. It is determinised as states are met. Its state keeps
only what later bytes can still change: the places from which some longer vocabulary entry can start, with the last token
and the relative count at each.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orbitrace.llm.batches import bound_batches
from orbitrace.llm.pretokens import Spans, split_special

MAX_TRANSITIONS = 800_000
MAX_MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    shifted = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + k): b for k, b in enumerate(shifted)}


class CountingTransducer:
    """Deterministic transducer of one BPE tokenizer: ``count(data)`` is the number of tokens of a pre-token's bytes."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], vocabulary: set[bytes]):
        self.ranks = ranks
        self.vocabulary = {t for t in vocabulary if len(self.merge([t[i : i + 1] for i in range(len(t))])) == 1}
        # every proper prefix of an entry: a token may still grow from there
        self.open = {t[:k] for t in self.vocabulary for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((0, None, 0),))
        self.states = [start]
        self.numbers = {start: 0}
        self.moves: dict[int, int] = {}

    def merge(self, parts: list[bytes]) -> list[bytes]:
        """BPE: the pair of lowest rank is merged, leftmost first, until no pair has a rank."""
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get((parts[i], parts[i + 1]))
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def adjacent(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens can stand side by side: their joined bytes are tokenized as just these two."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MAX_TRANSITIONS:
                self.pairs.clear()
            both = left + right
            found = self.pairs[key] = self.merge([both[i : i + 1] for i in range(len(both))]) == [left, right]
        return found

    def compile(self, number: int, byte: int) -> int:
        """Add the transition of a state on a byte; the move is ``next state << 8 | (emitted + 128)``."""
        tail, live = self.states[number]
        tail += bytes((byte,))
        for at, last, count in live:
            token = tail[at:]
            if token in self.vocabulary and (last is None or self.adjacent(last, token)):
                emitted = count + 1
                break
        else:
            raise ValueError(f"no token ends at {tail!r}")
        kept = [(at, last, count - emitted) for at, last, count in live if tail[at:] in self.open]
        kept.append((len(tail), token, 0))
        cut = kept[0][0]
        state = (tail[cut:], tuple((at - cut, last, count) for at, last, count in kept))
        target = self.numbers.setdefault(state, len(self.states))
        if target == len(self.states):
            self.states.append(state)
        move = self.moves[number << 8 | byte] = target << 8 | (emitted + 128)
        return move

    def count(self, data: bytes) -> int:
        if len(self.moves) > MAX_TRANSITIONS:
            self.reset()
        state, total, moves = 0, 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self.compile(state, byte)
            state = move >> 8
            total += (move & 255) - 128
        return total


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> tuple[CountingTransducer, list[str]]:
    """Transducer and special strings of a byte-level BPE ``.json`` file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = (spec["model"].get("type"), (spec.get("pre_tokenizer") or {}).get("type"), spec.get("normalizer"))
    if kind != ("BPE", "ByteLevel", None):
        raise ValueError(f"not a byte-level BPE file: {kind}")
    alphabet = byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
    return CountingTransducer(ranks, {raw(t) for t in spec["model"]["vocab"] if t not in special}), special


class TokenCounter:
    """Token counts of batches of texts, with a bounded memo of pre-token counts."""

    def __init__(self, path: str):
        self.transducer, self.special = load_tokenizer(path)
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, rows, follows = split_special(texts, self.special)
        spans = Spans(parts)
        words, place = spans.distinct()
        memo, count = self.memo, self.transducer.count
        if len(memo) > MAX_MEMO:
            memo.clear()
        got = np.empty(len(words), dtype=np.int64)
        for i, word in enumerate(words):
            n = memo.get(word)
            if n is None:
                n = memo[word] = count(word.encode("utf-8", "surrogatepass"))
            got[i] = n
        rows = np.array(rows, dtype=np.int64)
        out = np.bincount(rows, weights=np.array(follows) >= 0, minlength=len(texts)).astype(np.int64)
        if len(words):
            out += np.bincount(rows[spans.row], weights=got[place], minlength=len(texts)).astype(np.int64)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``n_tokens`` is what the tokenizers library gives for the whole text without added tokens; a special string inside
    a text is one token. Null text counts as empty: no bytes, no tokens. Rows that repeat give rows that repeat, extra
    columns are ignored, an empty table gives an empty result. The file at ``tokenizer_path`` is read on the executors.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        counter = TokenCounter(tokenizer_path)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            n = counter.counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
