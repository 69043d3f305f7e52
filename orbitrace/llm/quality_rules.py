"""Rule bitmask ledger: every quality rule is evaluated once, and its failures are kept as bits beside the measurements.

A policy is a named mask over the rule bits, so a policy changes without another pass over the texts, and ablations are
bitwise aggregates over the ledger. Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.llm.batches import unused

#: Rule name -> (bit, SQL condition of failure over the measurements). Bits are never reused.
RULES = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "many_symbols": (2, "10 * n_symbols > n_words"),
    "word_length": (3, "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    "duplicate_lines": (4, "100 * n_dup_lines > 50 * n_lines"),
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": BASE,
    "v1": ("few_words", "repeated_words", "many_symbols", "word_length", "duplicate_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_P = "__quality_"


def policy_mask(name: str) -> int:
    return sum(1 << RULES[r][0] for r in POLICIES[name])


def measured(docs: DataFrame, prefix: str = _P) -> DataFrame:
    """``docs`` and one struct column, ``prefix`` and ``m``, with the measurements and ``fail_bits``. No column of ``docs`` may
    start with ``prefix``.

    Words are maximal runs of characters other than space and 0x09-0x0D. Null text has no words. A text of fewer than
    three words has no window and so no repeated words. Windows are compared by a 64-bit hash within their own text,
    and by hash and place only in texts where some hash repeats.
    """
    steps = [
        ("t", "coalesce(text, '')"),
        ("w", rf"array_remove(split({prefix}t, '[\\x20\\x09-\\x0D]+'), '')"),
        ("n", f"size({prefix}w)"),
        (
            "h",
            f"CASE WHEN {prefix}n < 3 THEN CAST(array() AS array<bigint>) ELSE "
            f"transform(sequence(0, {prefix}n - 3), i -> xxhash64({prefix}w[i], {prefix}w[i + 1], {prefix}w[i + 2])) END",
        ),
        (
            "s",
            f"CASE WHEN size(array_distinct({prefix}h)) < size({prefix}h) THEN sort_array(transform({prefix}h, (x, i) -> struct(x, i))) END",
        ),
        ("l", rf"filter(split({prefix}t, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"),
        (
            "r",
            f"CASE WHEN {prefix}s IS NULL THEN 0 ELSE size(array_distinct(flatten(transform(filter({prefix}s, (e, k) -> "
            f"coalesce(e.x = get({prefix}s, k - 1).x, false) OR coalesce(e.x = get({prefix}s, k + 1).x, false)), "
            f"e -> array(e.i, e.i + 1, e.i + 2))))) END",
        ),
        (
            "m",
            f"struct(CAST({prefix}n AS bigint) AS n_words, CAST(length(array_join({prefix}w, '')) AS bigint) AS word_chars, "
            f"CAST(length(regexp_replace({prefix}t, '[^#*$%&|<>]+', '')) AS bigint) AS n_symbols, "
            f"CAST(size({prefix}l) - size(array_distinct({prefix}l)) AS bigint) AS n_dup_lines, "
            f"CAST({prefix}r AS bigint) AS n_repeat_words, CAST(size({prefix}l) AS bigint) AS n_lines)",
        ),
    ]
    out = docs
    for name, sql in steps:
        out = out.withColumn(prefix + name, F.expr(sql))
    bits = " | ".join(f"CASE WHEN {_qualified(cond, prefix)} THEN {1 << bit}L ELSE 0L END" for bit, cond in RULES.values())
    out = out.withColumn(prefix + "m", F.col(prefix + "m").withField("fail_bits", F.expr(bits)))
    # a filter on the measurements stays above a generator; pushed below, it would repeat all of these expressions
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(prefix + "m")).alias(prefix + "m"))


def _qualified(condition: str, prefix: str) -> str:
    for m in MEASURES:
        condition = condition.replace(m, f"{prefix}m.{m}")
    return condition


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``, one row per input row.

    Rows that repeat give rows that repeat; extra columns are ignored; an empty table gives an empty ledger. A text
    without words fails ``few_words`` only.
    """
    m = F.col(_P + "m")
    return measured(docs.select("doc_id", "text")).select("doc_id", *(m[c].alias(c) for c in MEASURES), m["fail_bits"].alias("fail_bits"))


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """``book`` with ``base_failed`` and ``kept`` under a policy; a document that fails the base rules is never kept."""
    base, mask = policy_mask("base"), policy_mask(policy) | policy_mask("base")
    bits = F.col("fail_bits")
    return book.withColumn("base_failed", bits.bitwiseAND(F.lit(base)) != 0).withColumn("kept", bits.bitwiseAND(F.lit(mask)) == 0)


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, those that fail it alone, and those that stay without it.

    Rows of ``book`` that repeat count as often as they occur, and ids play no part; an empty ledger gives zeros.
    """
    mask = policy_mask(policy)
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask))
    aggs = [F.count("*").alias("n"), F.coalesce(F.bit_or(bits), F.lit(0)).alias("any_bits"), F.coalesce(F.sum((bits == 0).cast("long")), F.lit(0)).alias("kept")]
    for name in POLICIES[policy]:
        bit = 1 << RULES[name][0]
        aggs.append(F.coalesce(F.sum((bits.bitwiseAND(F.lit(bit)) != 0).cast("long")), F.lit(0)).alias(f"f_{name}"))
        aggs.append(F.coalesce(F.sum((bits == bit).cast("long")), F.lit(0)).alias(f"o_{name}"))
    total = book.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"o_{n}").alias("failed_alone")) for n in POLICIES[policy]))
    return total.select("n", "kept", "any_bits", F.explode(rows).alias("r")).select(
        "r.rule", "r.failed", "r.failed_alone", (F.col("kept") + F.col("r.failed_alone")).alias("kept_without"), "n", "any_bits"
    )


def keep_quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, all their columns unchanged, whatever their names.

    Null and empty texts have no words and go. Rows that repeat stay or go together; an empty table gives none.
    """
    mask, prefix = policy_mask(policy) | policy_mask("base"), unused(docs, _P)
    return measured(docs, prefix).where(F.col(prefix + "m")["fail_bits"].bitwiseAND(F.lit(mask)) == 0).drop(prefix + "m")
