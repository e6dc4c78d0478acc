"""The application history: an upsert that keeps what was first said, look-ups, summaries, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPORT_COLUMNS = ("applied_at", "company", "title", "location", "source", "status", "fields_filled", "fields_review", "message", "follow_up_at", "url")


def upsert(log: DataFrame, key: str, order: Sequence[str], first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """One row a key: columns `first` from its earliest row, `last` from its latest. One shuffle, combined before it."""
    seq = F.struct(*order)
    return log.groupBy(key).agg(*(F.min_by(c, seq).alias(c) for c in first), *(F.max_by(c, seq).alias(c) for c in last))


def summary(history: DataFrame, status: str = "status") -> DataFrame:
    return history.groupBy(status).agg(F.count("*").alias("n"))


def unseen(postings: DataFrame, history: DataFrame, key: str, retry: Sequence[str] = ("failed", "skipped"), status: str = "status") -> DataFrame:
    """Postings without an application, other than those that failed or were skipped."""
    return postings.join(history.where(~F.col(status).isin(list(retry))).select(key), key, "left_anti")


def first_unseen(postings: DataFrame, history: DataFrame, key: str, n: int, position: str, **params) -> DataFrame:
    """The first n unseen postings in input order."""
    return unseen(postings, history, key, **params).orderBy(position).limit(n)


def export(history: DataFrame, columns: Sequence[str | Column] = EXPORT_COLUMNS, newest: str = "applied_at", tie: str = "url") -> DataFrame:
    """Fixed columns, newest first."""
    return history.select(*columns, F.col(newest).alias("_newest"), F.col(tie).alias("_tie")).orderBy(F.col("_newest").desc(), "_tie").drop("_newest", "_tie")


def status_counts(matches: DataFrame, by: Sequence[str], status: str = "status", required: Column | None = None) -> DataFrame:
    """Counts of an application's controls by what became of them."""
    s, req = F.col(status), required if required is not None else F.col("required")
    n = lambda c: F.count_if(c)
    return matches.groupBy(*by).agg(
        n(s == "filled").alias("filled"),
        n(~s.isin("filled", "not_applicable")).alias("review"),
        n((s != "filled") & (s != "not_applicable") & req).alias("required_gaps"),
        n(s == "skipped_by_policy").alias("by_policy"),
        n(s == "skipped_no_match").alias("no_match"),
    )


def plan_summary(matches: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """The five counts of a plan: ready, yours (left to the applicant), gaps, failed, unknown."""
    names = {"ready": "filled", "yours": "skipped_by_policy", "gaps": "skipped_no_value", "failed": "failed", "unknown": "skipped_no_match"}
    return matches.groupBy(*by).agg(*(F.count_if(F.col(status) == s).alias(n) for n, s in names.items()))


def _named(keep: Column, order: str, name: str) -> Column:
    """The names of the rows that are kept, in order."""
    return F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(order, name)))), lambda x: x[name])


def required_gaps(matches: DataFrame, by: Sequence[str], name: str, order: str, status: str = "status", required: Column | None = None) -> DataFrame:
    """gaps: the names of the required controls that are neither filled nor not applicable, in order."""
    req = required if required is not None else F.col("required")
    return matches.groupBy(*by).agg(_named(req & ~F.col(status).isin("filled", "not_applicable"), order, name).alias("gaps"))


def next_steps(matches: DataFrame, by: Sequence[str], name: str, order: str, canonical: str, status: str = "status") -> DataFrame:
    """yours, gaps, failed: what is left, each name once, in order; keys: what a profile would have to supply for the gaps."""
    of = lambda s: F.array_distinct(_named(F.col(status) == s, order, name))
    keys = F.array_sort(F.collect_set(F.when((F.col(status) == "skipped_no_value") & (F.col(canonical) != ""), F.col(canonical))))
    return matches.groupBy(*by).agg(of("skipped_by_policy").alias("yours"), of("skipped_no_value").alias("gaps"), of("failed").alias("failed"), keys.alias("keys"))


def submit_gate(matches: DataFrame, by: Sequence[str], name: str, order: str, mode: str = "submit", status: str = "status", required: Column | None = None, shown: int = 5) -> DataFrame:
    """Whether an application may be submitted; if required controls need a review, the first of their names."""
    out = required_gaps(matches, by, name, order, status, required)
    blocked = F.size("gaps") > 0
    return out.select(*by, F.when(F.lit(mode) != "submit", "prepared").when(blocked, "needs_review").otherwise("submitted").alias("gate"), F.size("gaps").alias("n_gaps"), F.array_join(F.slice("gaps", 1, shown), ", ").alias("first_gaps"))
