"""N-gram Jaccard self-join: MinHash LSH forest with exact verification.

Every distinct text gets ``trees`` labels of ``depth`` minima. A label is a path in its tree's prefix trie, and texts meet
where their paths share a prefix. They meet at full depth first, where a node holds near copies: what is like the node's
first text is settled with it. The prefix is then shortened step by step, and each time only the nodes are looked into that
still hold texts of different groups. It is shortened until a pair at the threshold has met in some tree with the target
recall; there all texts of different groups are compared, in path order. Candidate groups are then
verified exactly on shingle sets in blocks, which gives the link counts of every text without a row per pair.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches, unused
from orbitrace.llm.text_hash import distinct_shingles, minhash, mix64, scramble, shingle_hashes
from orbitrace.operators.graph import connected_components, merge_labels
from orbitrace.session import discard, materialize

TREES, DEPTH, TARGET = 20, 8, 0.99995
BLOCK_ROWS, BLOCK_BYTES, NODE_ROWS = 512, 8_000_000, 4096
#: Rows of a node's block, and of a verified one, at least, however many tasks there are.
LEAST_NODE_ROWS, LEAST_BLOCK_ROWS = 256, 128
#: A broadcast table of cluster members may hold this many rows (under 64 MB); above it the join shuffles.
BROADCAST_ROWS = 400_000


def stop_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """Longest prefix with which a pair at ``threshold`` shares a node in some tree with probability ``target``."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= target:
            return d
    return 1


def estimate_floor(threshold: float, slots: int) -> float:
    """Estimated similarity that a pair at ``threshold`` falls below about once in ten million times."""
    return threshold - 5.2 * math.sqrt(threshold * (1 - threshold) / slots)


def levels(threshold: float, trees: int, depth: int, target: float, step: int = 2) -> list[int]:
    """The prefix lengths at which texts meet, from ``depth`` down to ``stop_depth``."""
    last = stop_depth(threshold, trees, depth, target)
    return [*range(depth, last, -step), last]


def node_links(paths: np.ndarray, sketches: np.ndarray, shared: int, floor: float, groups: np.ndarray | None = None) -> np.ndarray:
    """Component label of each row of one trie node under "estimated similarity of at least ``floor``".

    Rows are in path order; ``groups`` has the number of a row with which each is linked already. Neighbours that share the longest prefixes are compared first, then ever shorter ones; at
    the end each row outside the largest component is compared with all rows. Every pair of different components has
    then been compared, so no link is lost, while a node of near copies costs one pass.
    """
    n = len(paths)
    labels = np.arange(n) if groups is None else merge_labels(np.arange(n), np.arange(n), groups)
    if n < 2 or labels.max() == 0:
        return labels
    depth = (paths[1:] == paths[:-1]).cumprod(axis=1).sum(axis=1)
    near = (sketches[1:] == sketches[:-1]).mean(axis=1) >= floor
    for d in range(paths.shape[1], shared - 1, -1):
        at = np.flatnonzero((depth >= d) & near)
        labels = merge_labels(labels, at, at + 1)
        if labels.max() == 0:
            return labels
    values, counts = np.unique(labels, return_counts=True)
    main = labels == values[counts.argmax()]
    rest = np.flatnonzero(~main)
    # equal sketches among them are linked to the same rows
    _, one = np.unique(np.ascontiguousarray(sketches[rest]).view(f"V{sketches.shape[1]}").ravel(), return_index=True)
    for i in rest[one]:
        hit = np.flatnonzero((sketches == sketches[i]).mean(axis=1) >= floor)
        if (labels[hit] != labels[i]).any():
            labels = merge_labels(labels, np.full(len(hit), i), hit)
    return labels


def block_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix: Jaccard of at least ``threshold`` between the shingle sets of two blocks (or one with itself)."""
    rows = sets_a if sets_b is None else sets_a + sets_b
    sizes = np.array([len(s) for s in rows], dtype=np.int64)
    n_a = len(sets_a)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    values, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[code] > 1  # a shingle of one text is in no intersection
    renumber = np.cumsum(counts > 1) - 1
    owner, code = owner[keep], renumber[code[keep]]
    m = int((counts > 1).sum())
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((n_a, n_a if sets_b is None else len(sets_b)), dtype=np.float64)
    step = max(1, 4_000_000 // max(1, len(rows)))
    for lo in range(0, m, step):
        i, j = np.searchsorted(code, [lo, lo + step])
        part = np.zeros((len(rows), min(step, m - lo)), dtype=np.float32)
        part[owner[i:j], code[i:j] - lo] = 1
        common += part[:n_a] @ (part if sets_b is None else part[n_a:]).T
    size_a, size_b = sizes[:n_a, None], (sizes[:n_a] if sets_b is None else sizes[n_a:])[None, :]
    union = size_a + size_b - common
    # exact in integers up to the last step; the small slack only absorbs the rounding of the product
    linked = (common > 0) & (common >= threshold * union - 1e-9)
    if sets_b is None:
        np.fill_diagonal(linked, False)
    return linked


def _signed(docs: DataFrame, trees: int, depth: int, lengths: list[int], width: int) -> DataFrame:
    """``doc_id, key, sketch, nodes``: text key (MD5), 8-bit sketch and, for each prefix length, the node id of every tree."""
    k = trees * depth

    def sign(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            values, off = shingle_hashes(text, width)
            m = minhash(values, off, k)
            cells = m.reshape(len(m), trees, depth).astype(np.uint64)
            node = np.arange(1, trees + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            found = {}
            for d in range(depth):
                node = mix64(node + cells[:, :, d])
                found[d + 1] = node
            made = np.concatenate([found[d] for d in lengths], axis=1).view(np.int64).tolist()
            full = np.diff(off) > 0
            sketch = scramble(m, 8)
            raw = [t.encode() for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.md5(t).digest() for t in raw], pa.binary()),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                    pa.array([x if ok else [] for x, ok in zip(made, full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "sketch", "nodes"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, key binary, sketch binary, nodes array<long>")


def _candidates(texts: DataFrame, trees: int, depth: int, lengths: list[int], floor: float) -> DataFrame:
    """Edges ``(src, dst)`` that join the texts of each candidate group, written.

    At every length but the last one the texts of a node are compared with its head only, which settles near copies without
    a copy of any row. At the last one all texts of different groups of a node are compared.
    """
    # a text is its own group at first
    groups = materialize(texts.select("key", F.col("key").alias("grp")).where("size(nodes) > 0"), "groups")
    for i, _ in enumerate(lengths[:-1]):
        met = _near_head(texts, groups, i * trees, trees, floor)
        found = connected_components(met.unionByName(_stars(groups))).select(F.col("node").alias("key"), F.col("component").alias("__grp"))
        after = materialize(groups.join(found, "key", "left").select("key", F.coalesce("__grp", "grp").alias("grp")), "groups")
        discard(met)
        discard(groups)
        groups = after
    return materialize(_met(texts, groups, (len(lengths) - 1) * trees, trees, depth, lengths[-1], floor).unionByName(_stars(groups)), "candidates")


def _stars(groups: DataFrame) -> DataFrame:
    return groups.where("key <> grp").select(F.col("key").alias("src"), F.col("grp").alias("dst"))


def _at_nodes(texts: DataFrame, groups: DataFrame, first: int, trees: int) -> DataFrame:
    placed = texts.select("key", F.slice("nodes", first + 1, trees).alias("at")).join(groups, "key")
    return placed.select(F.posexplode("at").alias("tree", "node"), "key", "grp")


def _near_head(texts: DataFrame, groups: DataFrame, first: int, trees: int, floor: float) -> DataFrame:
    """Written edges ``(src, dst)`` between texts and the first text of a node that they share, where both are of different groups
    and their sketches alike. Trees that give a text the same head give one pair."""
    slim = _at_nodes(texts, groups, first, trees)
    head = slim.groupBy("node").agg(F.min(F.struct("key", "grp")).alias("h"), (F.min("grp") != F.max("grp")).alias("apart")).where("apart")
    pairs = slim.join(head, "node").where("grp <> h.grp").select("key", F.col("h.key").alias("head")).distinct()
    sketch = texts.select("key", "sketch")
    both = pairs.join(sketch, "key").join(sketch.select(F.col("key").alias("head"), F.col("sketch").alias("other")), "head")

    def alike(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch", "other"))
            near = (a == b).mean(axis=1) >= floor if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["key", "head"]).filter(pa.array(near)).rename_columns(["src", "dst"])

    return materialize(both.select("key", "head", "sketch", "other").mapInArrow(alike, "src binary, dst binary"), "near_head")


def _met(texts: DataFrame, groups: DataFrame, first: int, trees: int, depth: int, shared: int, floor: float) -> DataFrame:
    """Edges ``(src, dst)`` between the texts of each trie node at depth ``shared`` whose sketches are alike, where the node holds
    texts of different groups.

    Rows of a node's largest group are not compared with each other: each of their blocks meets those of the others, so a
    row of a large settled group travels as often as the others have blocks, which is once as a rule.
    """
    spark = texts.sparkSession
    slim = _at_nodes(texts, groups, first, trees)
    sizes = slim.groupBy("node", "grp").agg(F.count("*").alias("n"), F.min("tree").alias("tree"))
    crowded = sizes.groupBy("node").agg(F.sum("n").alias("m"), F.max(F.struct("n", "grp")).alias("main"), F.count("*").alias("k"), F.min("tree").alias("tree")).where("k > 1").drop("k")
    crowded = materialize(crowded, "crowded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a block of a node holds at most half of an even task's rows
    most = min(NODE_ROWS, max(LEAST_NODE_ROWS, (crowded.agg(F.sum("m").alias("m")).first().m or 0) // (2 * parts)))
    whole = F.col("m") <= most
    others = F.when(whole, 1).otherwise(F.ceil((F.col("m") - F.col("main.n")) / most)).cast("int")
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("main.n") / most)).cast("int")
    rows = slim.drop("tree").join(crowded, "node").withColumns({"nr": others, "nm": mains}).withColumn("is_main", (F.col("grp") == F.col("main.grp")) & (F.col("nm") > 0))
    mixed = F.xxhash64("key")
    block = F.when(F.col("is_main"), F.col("nr") + F.pmod(mixed, F.greatest("nm", F.lit(1)))).otherwise(F.pmod(mixed, F.col("nr"))).cast("int")
    reach = F.when(F.col("is_main"), F.col("nr")).otherwise(F.col("nr") + F.col("nm"))
    placed = (
        rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), reach - 1)))
        .select("node", "tree", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "grp")
    )
    dealt = (
        placed.join(texts.select("key", "sketch"), "key")
        .repartition(parts, "node", "i", "j")
        .sortWithinPartitions("node", "i", "j")
        .select("node", "i", "j", "tree", "key", "grp", "sketch")
    )

    def link(batches):
        held: list[tuple] = []  # rows of the node that is being read
        at = None

        def close():
            tree = held[0][0]
            keys, groups = (np.array([r[c] for r in held], dtype=object) for c in (1, 2))
            sketches = np.frombuffer(b"".join(r[3] for r in held), dtype=np.uint8).reshape(len(held), -1)
            paths = sketches[:, tree * depth : (tree + 1) * depth]
            order = np.lexsort(paths.T[::-1])
            _, one, code = np.unique(groups[order], return_index=True, return_inverse=True)
            before = one[code]
            labels = node_links(paths[order], sketches[order], shared, floor, before)
            keys = keys[order]
            # one edge for each of the groups that are joined
            far = np.flatnonzero((labels != np.arange(len(labels))) & (before == np.arange(len(labels))))
            return keys[far], keys[labels[far]]

        for batch in batches:
            src, dst = [], []
            node, i, j, tree, key, grp, sketch = (c.to_pylist() for c in batch.columns)
            for r, place in enumerate(zip(node, i, j, strict=True)):
                if place != at and held:
                    a, b = close()
                    src.extend(a)
                    dst.extend(b)
                    held = []
                at = place
                held.append((tree[r], key[r], grp[r], sketch[r]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], names=["src", "dst"])
        if held:
            a, b = close()
            yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), pa.binary()), pa.array(b.tolist(), pa.binary())], names=["src", "dst"])

    return dealt.mapInArrow(link, "src binary, dst binary").distinct()


def _shingle_sets(docs: DataFrame, members: DataFrame, n_members: int, width: int) -> DataFrame:
    """``key, component, copies, set, shingles``: the sorted shingle hashes of every member text, and a digest of them.

    A row that repeats both id and text counts once here, and is combined before the shuffle.
    """
    sized = members.select("component", "key", "copies", "rep")
    if n_members <= BROADCAST_ROWS:
        sized = F.broadcast(sized)
    text = docs.select(F.col("doc_id").alias("__doc"), F.coalesce("text", F.lit("")).alias("text"))
    placed = text.join(sized, F.col("__doc").eqNullSafe(F.col("rep")) & (F.unhex(F.md5(F.col("text"))) == F.col("key"))).select("component", "key", "copies", "text")

    def shingle(batches):
        for batch in batches:
            sets = [s.tobytes() for s in distinct_shingles(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())],
                names=["component", "key", "copies", "set", "shingles"],
            )

    kind = members.schema["component"].dataType.simpleString()
    made = placed.mapInArrow(shingle, f"component {kind}, key binary, copies long, set binary, shingles binary")
    return made.groupBy("key").agg(*(F.first(c).alias(c) for c in ("component", "copies", "set", "shingles")))


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """``set, root, links``: per verification block the links of each shingle set, by multiplicity, and its component there.

    Equal sets travel once, with the number of rows that have them.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = sets.groupBy("component", "set").agg(F.sum("copies").alias("copies"), F.first("shingles").alias("shingles"))
    shape = one.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("b")).where("n > 1")
    # a block holds at most half of an even task's rows
    most = min(BLOCK_ROWS, max(LEAST_BLOCK_ROWS, sets.count() // (2 * parts)))
    nb = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int")
    placed = (
        one.join(shape.select("component", nb.alias("nb")), "component")
        .withColumn("block", F.pmod(F.xxhash64("set"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "copies", "shingles")
    )
    dealt = placed.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "block", "set")

    def verify(batches):
        held: list[tuple] = []
        at = None

        def close():
            sets = [np.frombuffer(r[3], dtype=np.uint64) for r in held]
            keys = [r[1] for r in held]
            copies = np.array([r[2] for r in held], dtype=np.int64)
            if at[1] == at[2]:
                linked = block_links(sets, None, threshold)
                links = linked @ copies
                a, b = np.nonzero(linked)
            else:
                n_a = sum(r[0] == at[1] for r in held)
                linked = block_links(sets[:n_a], sets[n_a:], threshold)
                links = np.concatenate([linked @ copies[n_a:], copies[:n_a] @ linked])
                a, b = np.nonzero(linked)
                b = b + n_a
            labels = merge_labels(np.arange(len(held)), a, b)
            some = np.flatnonzero(links > 0)
            return [keys[x] for x in some], [keys[labels[x]] for x in some], links[some].tolist()

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], names=["set", "root", "links"]
            )

        for batch in batches:
            out: list[list] = [[], [], []]
            comp, i, j, block, key, copies, shingles = (c.to_pylist() for c in batch.columns)
            for r, place in enumerate(zip(comp, i, j, strict=True)):
                if place != at and held:
                    for o, x in zip(out, close(), strict=True):
                        o.extend(x)
                    held = []
                at = place
                held.append((block[r], key[r], copies[r], shingles[r]))
            yield batch_of(out)
        if held:
            yield batch_of(close())

    return dealt.mapInArrow(verify, "set binary, root binary, links long")


def linked_texts(docs: DataFrame, texts: DataFrame, candidates: DataFrame, threshold: float, width: int, node: str = "key") -> DataFrame:
    """``key, component, n_links`` of the texts in a candidate group, by exact Jaccard; what is in none has no row.

    ``texts`` has ``key, rep, copies``, and ``candidates`` the edges ``src, dst`` between values of its column ``node``
    (or others, which then join texts and are none). A component is named by a shingle set of it; equal sets are alike.
    """
    groups = connected_components(candidates)
    of = texts.select(F.col(node).alias("node"), F.col("key").alias("__key"), "rep", "copies")
    members = materialize(groups.join(of, "node").select("component", F.col("__key").alias("key"), "rep", "copies"), "members")
    sets = materialize(_shingle_sets(docs, members, members.count(), width), "sets")
    checked = materialize(_verified(sets, threshold), "checked")
    classes = connected_components(checked.select(F.col("set").alias("src"), F.col("root").alias("dst")))
    weight = sets.groupBy("set").agg(F.sum("copies").alias("weight"))
    found = checked.groupBy("set").agg(F.sum("links").alias("links"))
    per_set = weight.join(found, "set", "left").join(classes.withColumnRenamed("node", "set"), "set", "left")
    out = materialize(
        sets.select("key", "set").join(per_set, "set")
        .select("key", F.coalesce("component", "set").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
        "linked",
    )
    for done in (members, sets, checked):
        discard(done)
    return out


def similarity_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, trees: int = TREES, depth: int = DEPTH, target: float = TARGET
) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, is_kept``.

    Two rows are linked when the Jaccard similarity of their ``width``-word shingle sets is at least ``threshold``, or
    when their texts are equal. ``n_links`` counts the other rows linked to a row, ``class_id`` is the smallest doc_id
    that can be reached over links (null ids are smallest), and ``is_kept`` marks one row of each class.

    Null text counts as empty. Texts without words are linked to equal texts only; texts of fewer than ``width`` words
    have one shingle. Rows that repeat an id and text are copies. Extra columns are ignored; an empty table gives an
    empty result. Nothing is capped: a crowded trie node and a large candidate group are cut into blocks, and every
    pair of blocks is worked on.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    lengths = levels(threshold, trees, depth, target)
    signed = materialize(_signed(docs, trees, depth, lengths, width), "signed")
    # the other columns depend on the key alone, so any copy's value serves
    texts = materialize(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null"), F.count("*").alias("copies"),
            F.first("sketch").alias("sketch"), F.first("nodes").alias("nodes"),
        ).withColumn("rep", F.when(~F.col("has_null"), F.col("low"))),
        "texts",
    )
    floor = estimate_floor(threshold, trees * depth)
    linked = linked_texts(docs, texts, _candidates(texts, trees, depth, lengths, floor), threshold, width)
    per_text = materialize(
        texts.select("key", "rep", "copies").join(linked, "key", "left")
        .select("key", "rep", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.col("copies") - 1).alias("n_links")),
        "per_text",
    )
    discard(texts)
    discard(linked)
    # the first text of a class is the one with the smallest id, null before all, then the smallest key
    head = per_text.groupBy("component").agg(
        F.min(F.struct(F.col("rep").isNotNull().alias("some"), F.col("rep").alias("rep"), F.col("key").alias("key"))).alias("head")
    )
    per_text = per_text.join(head, "component").select(
        "key", "n_links", F.col("head.rep").alias("class_id"), (F.col("head.key") == F.col("key")).alias("leads"), "rep"
    )
    # of the rows with the leading text and id, the one written first stays
    rows = signed.select("doc_id", "key")
    joined = rows.join(per_text, "key")
    leads = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("rep"))
    return joined.select("doc_id", "class_id", "n_links", leads.alias("is_kept"), F.hex("key").alias("text_key"))


def keep_one_per_class(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``docs`` with one row of each similarity class, all columns kept.

    The row with the smallest doc_id stays (null first, then the smallest text key). Of rows that repeat both id and
    text, one stays.
    """
    own = unused(docs, "__kept")
    kept_id, kept_key, kept_rows, row_key = (f"{own}_{k}" for k in ("id", "key", "rows", "row"))
    key = F.hex(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    kept = materialize(
        similarity_classes(docs, threshold, width).where("is_kept")
        .groupBy(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).agg(F.count("*").alias(kept_rows)),
        "kept",
    )
    marked = docs.withColumn(row_key, key)
    match = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(row_key) == F.col(kept_key))
    out = marked.join(kept, match, "left_semi")
    if kept.where(F.col(kept_rows) > 1).limit(1).count():
        out = out.dropDuplicates(["doc_id", row_key])
    return out.drop(row_key)
