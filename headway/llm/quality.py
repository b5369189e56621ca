"""Rule bitmask ledger: every rule is evaluated once, policies and ablations only read bits.

The ledger holds, for each document, the measurements and one bigint whose bit i says that rule i
failed. A policy is a mask over the bits, so a new policy version, or the question "what would we lose
without rule 5", costs a bitwise operation on a narrow table and no further pass over the texts.

Everything here is DataFrame expressions; texts never leave the JVM and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import WHITE, word_list

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_ends")
#: Rule i owns bit i. Ratios are compared by integer products, so every engine decides alike.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "10 * n_upper > 5 * word_chars",
    "exclaiming": "5 * n_ends > n_words",
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"v1_base": BASE, "v2": tuple(RULES)}
CURRENT = "v2"


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _measured(texts: DataFrame) -> DataFrame:
    """texts: (row, text). Adds t (text), w (words), h (hash of the word triple from each word on) and d (hashes
    that come more than once)."""
    rows = texts.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("w", word_list(F.col("t")))
    w = F.col("w")
    triples = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    rows = rows.withColumn("h", F.slice(triples, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    again = F.transform(F.array(F.sort_array("h")), lambda s: F.filter(s, lambda x, k: x == F.get(s, k - 1)))
    return rows.withColumn("d", F.array_distinct(F.element_at(again, 1)))


def _covered() -> Column:
    """Number of words in a triple that comes more than once. A few such triples are looked up; many are
    found as neighbours of the sorted (hash, place) array, so a long text costs n log n."""
    h, d = F.col("h"), F.col("d")
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
    pairs = F.array(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    flagged = F.element_at(F.transform(pairs, lambda s: F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]))), 1)
    many = F.filter(flagged, lambda i: i.isNotNull())
    words = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 16, words(few)).otherwise(words(many))


def ledger(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of documents, whatever their names, the measurements (bigint) and fail_bits (bigint).

    Null texts count as empty: all measurements 0, which fails few_words. Long texts are measured whole. Rows are judged
    one by one, so repeated rows get equal verdicts, an empty table gives an empty ledger and the order is of no
    matter. A column of documents that has the name of a ledger column is replaced by it.
    """
    kept = [c for c in documents.columns if c not in (*MEASURES, "fail_bits")]
    rows = _measured(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text")))
    t, w = F.col("t"), F.col("w")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    measures = {
        "n_words": F.size(w),
        "word_chars": F.char_length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")),
        "n_ends": F.regexp_count(t, F.lit("[!?]")),
    }
    rows = rows.select("row", *[v.cast("bigint").alias(k) for k, v in measures.items()])
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, rule in enumerate(RULES.values())]
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fail_bits"))


def verdict(rules: tuple[str, ...], bits: str = "fail_bits") -> Column:
    """True where none of the rules failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(rules))) == 0


def apply_policies(led: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with a boolean kept_<version> for each policy."""
    return led.withColumns({f"kept_{name}": verdict(rules) for name, rules in policies.items()})


def ablation(led: DataFrame, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """One row for each policy and rule of it: documents, how many the policy rejects, how many fail
    the rule, and how many only this rule rejects (what dropping the rule would let back in).

    One pass over the ledger's bits: rows with equal bits are counted once and everything else reads the
    at most 2^rules counts."""
    counts = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(rules)).alias("m"), F.lit(mask((r,))).alias("bit")) for p, rules in policies.items() for r in rules])
    each = counts.select("n", "fail_bits", F.inline(rows))
    hit = F.col("fail_bits").bitwiseAND(F.col("m"))

    def total(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint").alias(name)

    return each.groupBy("policy", "rule").agg(F.sum("n").cast("bigint").alias("n_docs"), total(hit != 0, "n_rejected"), total(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, "n_failed"), total(hit == F.col("bit"), "n_only"))


def filter_quality(documents: DataFrame, text_col: str = "text", policy: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever their names. Null texts are empty and so
    have too few words; long texts are judged whole; repeated rows are judged alike; an empty table stays empty."""
    tagged = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # the bits pass through explode(array()), as a filter on them would else be pushed below the ledger and its
    # expressions evaluated again inside each other's lambdas
    judged = ledger(tagged).select("row", F.explode(F.array("fail_bits")).alias("bits")).where(verdict(POLICIES[policy], "bits"))
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in documents.columns])
