"""Unigram segmentation of texts into the pieces of a SentencePiece model, and back.

Pieces with their log scores stand in a double-array trie over UTF-8 bytes. A text is cut where no piece can cross (before
a run of white-space markers), and each unit gets its best-scoring segmentation by Viterbi. Characters without a piece are
spelled with byte pieces. Decoding joins the pieces, puts byte runs together and turns markers back into spaces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orbitrace.llm.batches import bound_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_MEMO = 500_000
#: Units up to this many bytes are segmented side by side.
LOCKSTEP_BYTES = 64


class DoubleArrayTrie:
    """Keys to values: the child of node ``s`` on byte ``b`` is ``base[s] + b + 1`` if ``check`` there is ``s``."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-1], [-1]
        self.used = bytearray(1)
        self.used[0] = 1
        free = 1
        searched = [0] * 257  # by number of children: where the last search for so many ended
        tree: dict = {}
        for key, v in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = v
        queue = deque([(0, tree)])
        while queue:
            state, node = queue.popleft()
            self.value[state] = node.pop(-1, -1)
            if not node:
                continue
            labels = sorted(node)
            while free < len(self.used) and self.used[free]:
                free += 1
            at = max(0, free - labels[0] - 1, searched[len(labels)])
            self._grow(at + 514)
            while any(self.used[at + b + 1] for b in labels):
                at += 1
                if at + 257 >= len(self.used):
                    self._grow(2 * len(self.used))
            searched[len(labels)] = at
            self.base[state] = at
            for b in labels:
                child = at + b + 1
                self.used[child] = 1
                self.check[child] = state
                queue.append((child, node[b]))
        self._grow(len(self.base) + 257)  # so that no step runs past the end
        self.tables = tuple(np.array(x, dtype=np.int32) for x in (self.base, self.check, self.value))

    def _grow(self, n: int) -> None:
        more = n - len(self.base)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more
            self.used += bytearray(more)

    def prefixes(self, data: bytes, start: int = 0) -> list[tuple[int, int]]:
        """``(end, value)`` of every key that begins at ``start``, shortest first."""
        base, check, value = self.base, self.check, self.value
        out, s = [], 0
        for j in range(start, len(data)):
            t = base[s] + data[j] + 1
            if check[t] != s:
                break
            s = t
            if value[t] >= 0:
                out.append((j + 1, value[t]))
        return out


class UnigramCodec:
    """Encoder and decoder over the pieces and scores of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.pieces = [self.model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in ids if self.model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.model.unk_id()
        hidden = {i for i in ids if self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i) or self.model.is_byte(i)}
        self.hidden = {i for i in hidden if i not in self.byte_of and i != self.unknown}
        shown = [i for i in ids if i not in hidden]
        self.scores = [self.model.get_score(i) for i in ids]
        self.floor = min(self.scores[i] for i in shown) - UNKNOWN_PENALTY
        self.trie = DoubleArrayTrie({self.pieces[i].encode(): i for i in shown})
        # units end before a run of markers, where no piece has a marker behind another character
        whole = any(MARK in self.pieces[i].lstrip(MARK) for i in shown)
        self.unit = re.compile("(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.prefixed = self.model.normalize("a").startswith(MARK)
        self.score_table = np.array(self.scores, dtype=np.float64)
        # pieces that decode on their own: shown ones, and bytes that are ASCII
        self.alone = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else p for i, p in enumerate(self.pieces)]
        self.plain = np.array([i in self.byte_of and self.byte_of[i] < 128 or i not in hidden for i in ids])
        self.memo: dict[str, tuple[bytes, float]] = {}

    def best_path(self, unit: str) -> tuple[list[int], float]:
        """Ids of the best segmentation and its score; of equal paths, the one whose last piece is the longest wins."""
        data = unit.encode("utf-8", "replace")
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = data[at]
            step = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, s, j, single = best[at], 0, at, False
            while j < n:
                t = base[s] + data[j] + 1
                if check[t] != s:
                    break
                s = t
                j += 1
                v = value[t]
                if v >= 0:
                    score = here + scores[v]
                    if best[j] is None or score > best[j]:
                        best[j], back[j] = score, (at, v)
                    if j == step:
                        single = True
            if not single:
                score = here + self.floor
                if best[step] is None or score > best[step]:
                    best[step], back[step] = score, (at, -1)
            at = step
        out: list[int] = []
        end = n
        while end:
            start, v = back[end]
            if v >= 0:
                out.append(v)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(data[start:end]))
            else:
                out.append(self.unknown)
            end = start
        return out[::-1], best[n]

    def best_paths(self, units: list[str]) -> None:
        """``best_path`` of many short units side by side, into the memo; every step handles one byte of all of them."""
        data = [u.encode("utf-8", "replace") for u in units]
        size = np.array([len(d) for d in data])
        n, width = len(data), int(size.max())
        grid = np.zeros((n, width + 1), dtype=np.int32)
        grid[np.arange(width + 1) < size[:, None]] = np.frombuffer(b"".join(data), dtype=np.uint8)
        grid = np.ascontiguousarray(grid.T)  # by place, then unit
        base, check, value = self.trie.tables
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        start_of, piece_of = np.zeros((width + 1, n), dtype=np.int16), np.full((width + 1, n), -1, dtype=np.int32)
        step_of = np.ones(256, dtype=np.int32)
        step_of[0xC0:0xE0], step_of[0xE0:0xF0], step_of[0xF0:] = 2, 3, 4
        for at in range(width):
            rows = np.flatnonzero((size > at) & ((grid[at] & 0xC0) != 0x80))
            if not len(rows):
                continue
            here, step = best[at][rows], step_of[grid[at][rows]]
            single = np.zeros(len(rows), dtype=bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int32)
            for end in range(at + 1, width + 1):
                r = rows[live]
                to = base[state] + grid[end - 1][r] + 1
                ok = np.flatnonzero((check[to] == state) & (size[r] >= end))
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                found = value[state]
                has = np.flatnonzero(found >= 0)
                if len(has):
                    k, v = live[has], found[has]
                    score, r = here[k] + self.score_table[v], rows[k]
                    better = np.flatnonzero(score > best[end][r])
                    r = r[better]
                    best[end][r], start_of[end][r], piece_of[end][r] = score[better], at, v[better]
                    single[k[end == at + step[k]]] = True
            k = np.flatnonzero(~single)
            if len(k):
                r, end, score = rows[k], at + step[k], here[k] + self.floor
                better = np.flatnonzero(score > best[end, r])
                r, end = r[better], end[better]
                best[end, r], start_of[end, r], piece_of[end, r] = score[better], at, -1
        starts, pieces, scores = start_of.T.tolist(), piece_of.T.tolist(), best[size, np.arange(n)].tolist()
        for unit, raw, start, piece, score in zip(units, data, starts, pieces, scores, strict=True):
            path, end = [], len(raw)
            while end:
                v = piece[end]
                if v >= 0:
                    path.append(v)
                elif self.bytes:
                    path.extend(self.bytes[b] for b in reversed(raw[start[end] : end]))
                else:
                    path.append(self.unknown)
                end = start[end]
            path.reverse()
            self.memo[unit] = array("I", path).tobytes(), score

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each text, normalised as the model says; units that are new are segmented together first."""
        if len(self.memo) > MAX_MEMO:
            self.memo.clear()
        split = [self.unit.findall(self.model.normalize(t)) for t in texts]
        new = sorted(set().union(*split).difference(self.memo), key=len)
        short = [u for u in new if 4 * len(u) <= LOCKSTEP_BYTES or len(u.encode("utf-8", "replace")) <= LOCKSTEP_BYTES]
        for lo in range(0, len(short), 4096):
            self.best_paths(short[lo : lo + 4096])
        long = [u for u in new if u not in self.memo]
        for u in long:
            ids, score = self.best_path(u)
            self.memo[u] = array("I", ids).tobytes(), score
        out = []
        for units in split:
            found = [self.memo[u] for u in units]
            out.append((np.frombuffer(b"".join([f[0] for f in found]), dtype="<u4"), float(sum([f[1] for f in found]))))
        for u in long:  # long units are not kept
            del self.memo[u]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Text of ids; control pieces vanish, malformed byte runs become replacement characters."""
        ids = np.asarray(ids, dtype=np.int64)
        if self.plain[ids].all():
            return self._unmark("".join(map(self.alone.__getitem__, ids.tolist())))
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                out.append(self.pieces[i])
        out.append(run.decode("utf-8", "replace"))
        return self._unmark("".join(out))

    def _unmark(self, text: str) -> str:
        text = text.replace(MARK, " ")
        return text[1:] if self.prefixed and text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_chars, n_pieces, n_byte_pieces, ids_crc32, score, round_trip`` for every row, with ``ids`` if asked.

    ``round_trip`` tells whether decoding gives the text back (it does unless the text itself has the marker or the model
    normalises it). Null text counts as empty and has no pieces. Rows that repeat give rows that repeat, extra columns
    are ignored, an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, n_pieces long, n_byte_pieces long, ids_crc32 long, score double, round_trip boolean"

    def run(batches):
        codec = UnigramCodec(model_path)
        byte_ids = np.zeros(len(codec.pieces), dtype=bool)
        byte_ids[list(codec.byte_of)] = True
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for text, (ids, score) in zip(texts, codec.encode_batch(texts), strict=True):
                listed = ids.tolist() if with_ids else None
                row = (len(text), len(ids), int(byte_ids[ids].sum()), zlib.crc32(ids.tobytes()), score, codec.decode(ids) == text, listed)
                for o, x in zip(out, row, strict=False):
                    o.append(x)
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.bool_(), pa.list_(pa.int64())]
            names = ["n_chars", "n_pieces", "n_byte_pieces", "ids_crc32", "score", "round_trip", "ids"][: 7 if with_ids else 6]
            arrays = [pa.array(o, k) for o, k in zip(out, kinds, strict=False)][: len(names)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids array<long>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; a null list gives a null text."""
    bound_batches(encoded.sparkSession)

    def run(batches):
        codec = UnigramCodec(model_path)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
