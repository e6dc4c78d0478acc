"""Decisions around an application: options, agreement of values, repeated steps, messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def option_priority(wanted: Column, option: Column, either_way: bool) -> Column:
    """0 the same text, 1 contained (in a combobox either way), null neither."""
    w, o = F.lower(F.trim(wanted)), F.lower(F.trim(option))
    inside = F.contains(o, w) | (F.contains(w, o) if either_way else F.lit(False))
    return F.when((w == "") | (o == ""), None).when(w == o, 0).when(inside, 1)


def select_option(pairs: DataFrame, by: Sequence[str], wanted: str, option: str, order: str, either_way: bool = False) -> DataFrame:
    """The option chosen for each key: an exact one, else the first in order that contains; without a window, one aggregation."""
    scored = pairs.withColumn("priority", option_priority(F.col(wanted), F.col(option), either_way)).where("priority IS NOT NULL")
    return scored.groupBy(*by).agg(F.min(F.struct("priority", order, option)).alias("best")).select(*by, "best.*")


def values_agree(shown: Column, wanted: Column) -> Column:
    """Whether a control shows what was wanted: one contains the other, or half of the longer words are there."""
    a, b = F.lower(F.trim(shown)), F.lower(F.trim(wanted))
    words = lambda x: F.array_distinct(F.filter(F.split(x, "[^a-z0-9]+"), lambda t: F.length(t) > 2))
    share = F.try_divide(F.size(F.array_intersect(words(a), words(b))), F.size(words(b)))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | F.coalesce(share >= 0.5, F.lit(False)))


def first_repeat(steps: DataFrame, by: str, order: Sequence[str], signature: Column) -> DataFrame:
    """The first step of each run whose signature was seen before."""
    w = Window.partitionBy(by, "signature").orderBy(*order)
    seen = steps.withColumn("signature", signature).withColumn("nth", F.row_number().over(w)).where("nth = 2")
    return seen.groupBy(by).agg(F.min(F.struct(*order, "signature")).alias("s")).select(by, "s.*")


#: Our own classes of messages: the first whose text occurs gives the class.
MESSAGE_CLASSES = (("version", "version"), ("cannot find", "missing"), ("not found", "missing"), ("refused", "connection"), ("timed out", "timeout"), ("timeout", "timeout"), ("permission", "permission"), ("crash", "crash"))


def classify_message(x: Column, classes: Sequence[tuple[str, str]] = MESSAGE_CLASSES) -> Column:
    out, low = F.lit("other"), F.lower(F.coalesce(x, F.lit("")))
    for text, name in reversed(classes):
        out = F.when(F.contains(low, F.lit(text)), name).otherwise(out)
    return out


def sparse_scan(html: Column, controls: Column, markers: Sequence[str]) -> Column:
    """struct(sparse, n_scripts, script_heavy, markers): why a page shows few controls."""
    low = F.lower(html)
    scripts = (F.length(low) - F.length(F.replace(low, F.lit("<script"), F.lit("")))) / F.lit(7)
    found = F.slice(F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m)), 1, 3)
    return F.struct((controls < 6).alias("sparse"), scripts.cast("int").alias("n_scripts"), (scripts > 20).alias("script_heavy"), found.alias("markers"))
