"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit per
rule; a policy is a named, versioned mask of rules, so policies are applied, compared and ablated from
the ledger without touching a text again. Ablations aggregate the bits: how many documents fail under a
mask, and how many fail by one rule alone.

All measurements are computed inside the row (no explode, no shuffle), in time n log n of its words.

Edge cases: a null text has no words; it and an empty text fail the base rule (under 50 words). Very
long texts are read whole. Repeated rows are judged alike. An empty table gives an empty ledger. Other
columns of the input are returned only by filter_quality, whose result has exactly the input's columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import WORD, fresh_name

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rule name -> SQL condition on the measurements under which a document fails. The position is the bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(column: str) -> Column:
    """Words of a column of words that lie in a 3-word window found twice or more in it."""
    words = F.col(column)
    n = F.size(words)

    def covered(s: Column) -> Column:
        # equal windows are adjacent in the sorted array; both neighbours of a repeated window are kept
        same = lambda a, b: (a[column] == b[column]) & (a["1"] == b["1"]) & (a["2"] == b["2"])
        again = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
        return _let(F.sort_array(F.transform(again, lambda x: x["3"])), lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]))

    windows = F.slice(F.arrays_zip(words, F.slice(words, 2, F.greatest(n, F.lit(1))), F.slice(words, 3, F.greatest(n, F.lit(1))), F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))), 1, F.greatest(n - 2, F.lit(0)))
    return F.when(n < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))


def measure(docs: DataFrame, text_col: str = "text", name: str = "quality_ledger") -> DataFrame:
    """docs with a struct of that name: the measurements and `failures`, the bits of all rules."""
    word_col = fresh_name("words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn(word_col, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    words = F.col(word_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    n_lines, distinct = F.size(lines).cast("long"), F.size(F.array_distinct(lines)).cast("long")
    measured = step.withColumn(
        name,
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (n_lines - distinct).alias("n_dup_lines"),
            _repeat_words(word_col).cast("long").alias("n_repeat_words"),
            n_lines.alias("n_lines"),
        ),
    ).drop(word_col)
    bits = None
    for bit, rule in enumerate(RULES.values()):
        names = "|".join((*MEASURES, "n_lines"))
        one = F.when(F.expr(re.sub(rf"\b({names})\b", rf"{name}.\1", rule)), F.lit(1 << bit)).otherwise(F.lit(0))
        bits = one if bits is None else bits.bitwiseOR(one)
    return measured.withColumn(name, F.struct(f"{name}.*", bits.cast("long").alias("failures")))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the measurements, and `failures`."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return measure(picked).select("doc_id", "quality_ledger.*")


def fails(policy: Policy, bits: str | Column = "failures") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = (BASE, STANDARD)) -> DataFrame:
    """For each policy and rule: documents that fail the rule, that fail by it alone, and the policy's rejections.

    The ledger is first counted by bit pattern (2^rules rows at most), which all policies then share."""
    spark = entries.sparkSession
    patterns = entries.groupBy("failures").agg(F.count("*").alias("docs"))
    terms = spark.createDataFrame([(p.name, p.version, r, p.mask, 1 << list(RULES).index(r)) for p in policies for r in p.rules], "policy string, version int, rule string, mask long, bit long")
    active = F.col("failures").bitwiseAND(F.col("mask"))
    counted = lambda c: F.coalesce(F.sum(F.when(c, F.col("docs"))), F.lit(0)).alias
    return patterns.join(F.broadcast(terms), F.lit(True)).groupBy("policy", "version", "rule").agg(counted(active.bitwiseAND(F.col("bit")) != 0)("failed"), counted(active == F.col("bit"))("failed_alone"), counted(active != 0)("rejected"))


def filter_quality(docs: DataFrame, policy: Policy = STANDARD, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the policy, with all their columns.

    The ledger goes through a generator, below which no filter is pushed, so each rule is evaluated once."""
    name, once = fresh_name("ledger"), fresh_name("entry")
    entries = measure(docs, text_col, name).withColumn(once, F.explode(F.array(F.col(f"{name}.failures"))))
    return entries.where(~fails(policy, F.col(once))).select(*[F.col(f"`{c}`") for c in docs.columns])
