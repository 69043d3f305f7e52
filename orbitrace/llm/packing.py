"""Best-fit decreasing packing of token sequences.

Documents are cut into pieces and the pieces are packed longest first, each into the open bin with the least room that
still holds it. Lengths are whole numbers up to the capacity, so all pieces of one length and all bins of one remaining
capacity are alike: the plan is worked out on the histogram of lengths, whole runs of pieces at a time, with a segment
tree over remaining capacities that finds the tightest open one in logarithmic time. The plan's size is bounded by the
capacity and not by the data; the pieces themselves are ranked and placed by Spark.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches
from orbitrace.llm.pretokens import Spans, split_special
from orbitrace.llm.token_counts import byte_alphabet
from orbitrace.session import materialize

MAX_MEMO = 200_000
#: Pieces that one ranking group may hold on average at most.
SALT_ROWS = 50_000


class OpenBins:
    """Bins by remaining capacity; the tree's leaves are capacities, its inner nodes tell whether any below is open."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = [False] * (2 * self.leaves)
        self.runs: dict[int, list[list[int]]] = {}  # remaining capacity -> [first bin, number of bins], a stack

    def _mark(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.open[i] = value
        i //= 2
        while i:
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]
            i //= 2

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0:
            self.runs.setdefault(room, []).append([first, n])
            self._mark(room, True)

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least ``need`` that some bin has."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None

    def take(self, room: int, n: int) -> tuple[int, int]:
        """Up to ``n`` bins of one run with this remaining capacity: first bin and how many."""
        first, have = self.runs[room][-1]
        used = min(n, have)
        if used == have:
            self.runs[room].pop()
            if not self.runs[room]:
                self._mark(room, False)
        else:
            self.runs[room][-1] = [first + used, have - used]
        return first, used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on ``{length: pieces}``: rows ``(length, first rank, pieces, first bin, offset)``.

    Piece ``first rank + i`` of that length goes to bin ``first bin + i`` at ``offset``. A bin that has just taken a piece
    is tighter than before, so it takes pieces of this length as long as they fit, and then the next bin does: that is
    what taking piece by piece gives, and bins of one room are filled alike.
    """
    bins, made, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            each = min(left, (capacity if room is None else room) // length)
            if room is None:
                first, used, room = made, left // each, capacity
                made += used
            else:
                first, used = bins.take(room, left // each)
            for k in range(each):
                plan.append((length, rank, used, first, capacity - room + k * length))
                rank += used
            bins.add(room - each * length, first, used)
            left -= each * used
    return plan


class Encoder:
    """Token ids of batches of texts by the tokenizers library.

    For a byte-level BPE file the library's model gets each distinct pre-token once; the memo has two generations, the
    older of which is dropped when the newer one is full. Other files get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.names = list(self.special)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_pretoken = (spec["model"].get("type"), (spec.get("pre_tokenizer") or {}).get("type"), spec.get("normalizer")) == ("BPE", "ByteLevel", None)
        shown = {b: c for c, b in byte_alphabet().items()}
        self.letters = {b: shown[b] for b in range(256)}
        self.memo: dict[str, np.ndarray] = {}
        self.older: dict[str, np.ndarray] = {}

    def _remember(self, words: list[str]) -> dict[str, np.ndarray]:
        """The memo, which then has all of ``words``."""
        if len(self.memo) > MAX_MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, tokenize = self.memo, self.older, self.library.model.tokenize
        for word in words:
            if word not in memo:
                ids = older.get(word)
                if ids is None:
                    shown = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
                    ids = np.array([t.id for t in tokenize(shown)], dtype=np.uint32)
                memo[word] = ids
        return memo

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as the library gives them without added tokens; a special string in a text is its own id."""
        if not self.by_pretoken:
            return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
        parts, rows, follows = split_special(texts, self.names)
        spans = Spans(parts)
        words, place = spans.distinct()
        memo = self._remember(words)
        each = [memo[word] for word in words]
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        flat = np.concatenate(each) if each else np.zeros(0, np.uint32)
        heads = np.cumsum(sizes) - sizes
        n = sizes[place]
        total = np.concatenate([[0], np.cumsum(n)])
        stream = flat[np.repeat(heads[place] - total[:-1], n) + np.arange(total[-1])]
        cuts = total[np.searchsorted(spans.row, np.arange(len(parts) + 1))]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for k, row in enumerate(rows):
            out[row].append(stream[cuts[k] : cuts[k + 1]])
            if follows[k] >= 0:
                out[row].append(np.array([self.special[self.names[follows[k]]]], dtype=np.uint32))
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut where longer than ``capacity``.

    Of a document that is cut, the first piece takes what the full pieces leave, so it may be shorter.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer_path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or min(capacity, len(ids)), len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``; lengths are from 1 to ``capacity``.

    Pieces of one length are ranked in salted groups, so a common length is no single task. Ties of all columns take
    neighbouring ranks in any order, which gives the same set of rows.
    """
    spark = pieces.sparkSession
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # a ranking group holds at most half of an even task's rows
    parts, common = int(spark.conf.get("spark.sql.shuffle.partitions")), max(histogram.values(), default=0)
    most = max(1, min(SALT_ROWS, sum(histogram.values()) // (2 * parts)))
    salts = max(1, -(-common // most))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
        .select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    )
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(order) - 1).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).select(*pieces.columns, "__rank")
    plan = np.array(plan_bins(histogram, capacity), dtype=np.int64).reshape(-1, 5)
    # ordered by length and rank; a rank stays below 2**50
    order_key = plan[:, 0] << 50 | plan[:, 1]
    by_key = np.argsort(order_key)
    shared = spark.sparkContext.broadcast((order_key[by_key], plan[by_key]))
    names = [*pieces.columns, "sequence_id", "offset"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def place(batches):
        keys, rows = shared.value
        for batch in batches:
            rank, length = batch.column("__rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(keys, length << 50 | rank, side="right") - 1
            got = rows[at]
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(got[:, 3] + rank - got[:, 1], pa.int64()), pa.array(got[:, 4], pa.int64())],
                names=names,
            )

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all texts with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of ``end_id`` alone. Rows that repeat are packed as often as they occur; null
    ids are kept. Extra columns are ignored; an empty table gives an empty result. Offsets in a sequence have no gaps.
    """
    return pack_pieces(materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
