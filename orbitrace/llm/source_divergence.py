"""Source divergence audit over count-level bitmaps.

How far apart are the term distributions of two sources of one language? Within a block of 64 terms, each (group, count) is
a bitset of the terms that occur that often in the group; a group's zeros are what its other bitsets leave of the block. AND
and popcount of two groups' bitsets give the cells of their joint table of counts, and every cell is multiplied by the
difference of the two probabilities. All arithmetic is on whole numbers.

Blocks are dealt by ranges of term hashes, groups by tiles; a task holds the bitsets of one block of two tiles and the sums of
the pairs between them, whatever the vocabulary and the number of sources.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches
from orbitrace.session import materialize

#: Terms that one task counts before it passes its counts on.
HELD_TERMS = 1 << 18
#: Sources of a tile on average at most, and rows of bitsets that meet another tile at a time.
TILE, ROWS = 16, 256
#: Rows of counts in one range of terms at least, and groups whose table may be broadcast.
RANGE_ROWS, BROADCAST_GROUPS = 4000, 200_000
SCALE, SMOOTH = 1_000_000_000, 5
#: Letters a-z and all bytes above 0x7F stand for themselves, A-Z are lower-cased, everything else parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters A-Z, a-z and characters above 0x7F, with A-Z lower-cased."""
    return text.translate(_TERM).split()


def _counted(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed():
        for (lang, source), (n, docs) in held.items():
            k = len(n)
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), words, pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()
        for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, terms = len(n), terms_of(text)
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
            if size >= HELD_TERMS:
                yield from passed()
                held, size = {}, 0
    yield from passed()


def term_counts(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """``lang, source, term, n, lang_n, head`` of the kept terms that occur in a group: the term's occurrences there and in its
    language; ``head`` is 1 in one row per (lang, term)."""
    part = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    own = part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    across = Window.partitionBy("lang", "term")  # one row per source of the language
    own = own.withColumns({"in_docs": F.sum("docs").over(across), "lang_n": F.sum("n").over(across), "head": F.row_number().over(across.orderBy("source"))})
    return own.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", (F.col("head") == 1).cast("int").alias("head"))


def with_probability(df: DataFrame, name: str, count: str, total: str, terms: str = "terms") -> DataFrame:
    """``df`` with ``name``: 1 + floor(10^9 (count + 5) / (total + 5 terms)), exact; 0 where there are no terms."""
    over = f"(CAST({count} AS DECIMAL(19,0)) + {SMOOTH}) * CAST({SCALE} AS DECIMAL(10,0))"
    under = f"(CAST({total} AS DECIMAL(19,0)) + CAST({terms} AS DECIMAL(18,0)) * CAST({SMOOTH} AS DECIMAL(1,0)))"
    return df.withColumn(name, F.expr(f"CASE WHEN {terms} > 0 THEN 1L + ({over}) div {under} ELSE 0L END"))


def group_totals(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per occurring (lang, source), written: occurrences ``total`` of kept terms there and ``lang_total`` in the language,
    the language's ``terms`` and rows of counts ``lang_rows``, and ``zero``, the probability of a term that does not occur."""
    here = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("terms"), F.count("*").alias("lang_rows"))
    groups = docs.select("lang", "source").distinct().join(here, ["lang", "source"], "left").join(whole, "lang", "left")
    return materialize(with_probability(groups.fillna(0), "zero", "0", "total"), "groups")


def _pair_sums(batches):
    """Sums over the terms of each range of the differences between the groups of two tiles."""
    at, groups, sums, block, full, rows = None, None, None, None, np.uint64(0), []

    def close_block():
        nonlocal rows
        if block is not None:
            sides = []
            for tile, (names, zero) in enumerate(groups):
                own = [r for r in rows if r[0] == at[2 + tile]]
                code = np.concatenate([np.array([names[s] for s in r[1]], np.int64) for r in own] or [np.zeros(0, np.int64)])
                bits = np.concatenate([r[2] for r in own] or [np.zeros(0, np.uint64)])
                p = np.concatenate([r[3] for r in own] or [np.zeros(0, np.int64)])
                # zeros by complement: what no count level of the group has
                some = np.zeros(len(zero), np.uint64)
                np.bitwise_or.at(some, code, bits)
                code, bits, p = np.concatenate([code, np.arange(len(zero))]), np.concatenate([bits, full & ~some]), np.concatenate([p, zero])
                order = np.argsort(code, kind="stable")
                sides.append((code[order], bits[order], p[order], np.searchsorted(code[order], np.arange(len(zero)))))
            (ca, ba, pa_, _), (_, bb, pb, heads) = sides
            if len(heads):
                for i in range(0, len(ca), ROWS):
                    cells = np.bitwise_count(ba[i : i + ROWS, None] & bb[None, :]).astype(np.int64) * np.abs(pa_[i : i + ROWS, None] - pb[None, :])
                    np.add.at(sums, ca[i : i + ROWS], np.add.reduceat(cells, heads, axis=1))
        rows = []

    def close():
        if at is None:
            return
        close_block()
        (a, _), (b, _) = groups
        na, nb = list(a), list(b)
        # within one tile every pair stands twice
        i, j = np.nonzero(np.triu(np.ones(sums.shape, bool), 1)) if at[2] == at[3] else np.nonzero(np.ones(sums.shape, bool))
        if len(i):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(i), pa.string()), pa.array([na[x] for x in i], pa.string()), pa.array([nb[x] for x in j], pa.string()), pa.array(sums[i, j], pa.int64())],
                names=["lang", "a", "b", "value"],
            )

    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("lang", "range", "ta", "tb", "block", "kind", "tile", "source")}
        bits, p = np.asarray(batch.column("bits")).view(np.uint64), np.asarray(batch.column("p"))
        keys = list(zip(cols["lang"], cols["range"], cols["ta"], cols["tb"], cols["block"], cols["kind"], cols["tile"], strict=True))
        i = 0
        while i < len(keys):
            j = i + 1
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            key, own = keys[i][:4], keys[i][6]
            if key != at:
                yield from close()
                at, block, rows, sums = key, None, [], np.zeros((0, 0), np.int64)
                groups = [({}, np.zeros(0, np.int64)), ({}, np.zeros(0, np.int64))]
            if keys[i][4] < 0:  # the groups of a tile come before its bitsets
                for side in (0, 1):
                    if own == at[2 + side]:
                        names, zero = groups[side]
                        names |= {s: len(names) + x for x, s in enumerate(cols["source"][i:j])}
                        groups[side] = (names, np.concatenate([zero, p[i:j]]))
                sums = np.zeros((len(groups[0][1]), len(groups[1][1])), np.int64)
            else:
                if keys[i][5] == 0:
                    close_block()
                    block, full = keys[i][4], bits[i]
                else:
                    rows.append((own, cols["source"][i:j], bits[i:j], p[i:j]))
            i = j
    yield from close()


def pair_divergence(counts: DataFrame, groups: DataFrame, tile_groups: int = TILE) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways round: the differences of their probabilities
    summed over all kept terms. Sources are dealt into tiles of ``tile_groups`` on average."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("k"), F.max("lang_rows").alias("r")).agg(F.max("k").alias("k"), F.sum("r").alias("r"), F.count("*").alias("langs")).first()
    tiles = max(1, -(-(sizes.k or 0) // tile_groups))
    most = max(RANGE_ROWS, (sizes.r or 0) // (2 * parts))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("lang_rows") / most)).cast("int")
    tile = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    held = groups.select("lang", "source", "total", "terms", "zero", tile.alias("tile"), ranges.alias("ranges"))
    small = F.broadcast(held) if groups.count() <= BROADCAST_GROUPS else held
    levels = with_probability(counts.select("lang", "source", "term", "n").join(small, ["lang", "source"]), "p", "n", "total")
    levels = levels.withColumn("range", F.pmod(F.xxhash64("term", F.lit(1)), F.col("ranges")).cast("int"))
    # terms are numbered within their range; 64 of them make a block
    levels = levels.withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "range").orderBy("term")) - 1)
    levels = levels.withColumns({"block": F.expr("CAST(id div 64 AS int)"), "bit": F.expr("shiftleft(1L, CAST(id % 64 AS int))")})
    # one bitset per (group, count); the first row of a block also tells every two tiles which terms the block has
    levels = levels.groupBy("lang", "range", "block", "tile", "source", "n", "p").agg(F.bit_or("bit").alias("bits"))
    inside = Window.partitionBy("lang", "range", "block")
    levels = levels.withColumns({"full": F.bit_or("bits").over(inside), "lead": F.row_number().over(inside.orderBy("source", "n")) == 1})
    own = f"transform(sequence(0, {tiles - 1}), o -> struct(1 AS kind, least(tile, o) AS ta, greatest(tile, o) AS tb))"
    all_ = f"flatten(transform(sequence(0, {tiles - 1}), a -> transform(sequence(a, {tiles - 1}), b -> struct(0 AS kind, a AS ta, b AS tb))))"
    levels = levels.withColumn("to", F.explode(F.expr(f"CASE WHEN lead THEN concat({own}, {all_}) ELSE {own} END")))
    levels = levels.withColumn("bits", F.when(F.col("to.kind") == 0, F.col("full")).otherwise(F.col("bits")))
    header = held.select("lang", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"), F.lit(-1).alias("block"), "tile", "source", F.col("zero").alias("p"), F.lit(0).cast("long").alias("bits"))
    header = header.withColumn("to", F.explode(F.expr(own)))
    rows = levels.select(*header.columns).unionByName(header).select("*", "to.*").drop("to")
    dealt = rows.repartition(parts, "lang", "range", "ta", "tb").sortWithinPartitions("lang", "range", "ta", "tb", "block", "kind", "tile", "source", "p")
    sums = dealt.mapInArrow(_pair_sums, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def term_divergence(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every term of a group that is more probable there than in its language."""
    held = groups.select("lang", "source", "total", "lang_total", "terms")
    small = F.broadcast(held) if groups.count() <= BROADCAST_GROUPS else held
    rows = with_probability(with_probability(counts.join(small, ["lang", "source"]), "p", "n", "total"), "q", "lang_n", "lang_total")
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, tile_groups: int = TILE) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source of a language, how far each other source is (part ``pair``,
    all of them) and its most overrepresented terms (part ``term``, the first ``top``).

    Null text, lang and source are empty strings. A term is a maximal run of letters A-Z, a-z and characters above 0x7F, A-Z
    lower-cased; a language keeps the terms of at least ``least_docs`` of its documents. A document is a row: rows that repeat
    count as often as they occur. With V kept terms, of which N occurrences lie in a group, a term with ``count`` of them has
    p = 1 + floor(10^9 (count + 5) / (N + 5 V)); so has the language. Ranks go by falling value, ties by the item's UTF-8
    bytes. Groups without terms have pairs too (0 where V is 0). Extra columns are ignored; an empty table gives an empty
    result.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = materialize(term_counts(docs, least_docs), "terms")
    groups = group_totals(docs, counts)
    along = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": F.row_number().over(along)})
    pairs = ranked(pair_divergence(counts, groups, tile_groups), "pair")
    terms = ranked(term_divergence(counts, groups), "term").where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
