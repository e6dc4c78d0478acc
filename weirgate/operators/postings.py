"""Postings: filters, choice of the description, term salience, coverage, letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.functions import vocab as V


def has_keyword(hay: Column, keywords: Sequence[str] | None) -> Column:
    """Any keyword as a substring, whatever its case. No list is no filter; a list of blanks keeps nothing."""
    if not keywords:
        return F.lit(True)
    wanted = [k.strip().lower() for k in keywords if k.strip()]
    low, found = F.lower(hay), F.lit(False)
    for k in wanted:
        found = found | F.contains(low, F.lit(k))
    return found


def in_location(place: Column, wanted: str) -> Column:
    return F.contains(F.lower(place), F.lit(wanted.strip().lower())) if wanted.strip() else F.lit(True)


def marker_score(x: Column, markers: Sequence[str] = V.DESCRIPTION_MARKERS) -> Column:
    """How many markers occur."""
    low, n = F.lower(x), F.lit(0)
    for m in markers:
        n = n + F.contains(low, F.lit(m)).cast("int")
    return n


def best_description(meta: Column, body: Column, markers: Sequence[str] = V.DESCRIPTION_MARKERS) -> Column:
    """The text with more markers, then the longer, then the body."""
    a, b = marker_score(meta, markers), marker_score(body, markers)
    return F.when(a > b, meta).when(b > a, body).when(F.length(meta) > F.length(body), meta).otherwise(body)


def term_counts(docs: DataFrame, id_col: str, text_col: str, stop: Sequence[str] = V.STOP_WORDS, phrases: Sequence[str] = V.KNOWN_PHRASES) -> DataFrame:
    exploded = docs.select(id_col, F.explode(T.terms(F.col(text_col), stop, phrases)).alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count("*").alias("n"))


def salient_terms(x: Column, n: int = 25, weight: int = 3, stop: Sequence[str] = V.STOP_WORDS, phrases: Sequence[str] = V.KNOWN_PHRASES) -> Column:
    """Array of struct(term, n): a text's most salient terms, all within the row.

    Terms and proper nouns (marked) are sorted together; a run of equal terms gives its count and whether it is marked."""
    mark = lambda c, m: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(m).alias("mark")))
    both = F.array_sort(F.concat(mark(T.terms(x, stop, phrases), 0), mark(T.proper_nouns(x), 1)))

    def runs(s: Column) -> Column:
        last = F.filter(F.transform(s, lambda e, i: F.when(~e["term"].eqNullSafe(F.get(s, i + 1)["term"]), i)), lambda i: i.isNotNull())
        counted = lambda ends: F.transform(ends, lambda i, k: F.struct(F.get(s, i).alias("at"), (i - F.coalesce(F.get(ends, k - 1), F.lit(-1))).alias("size")))
        return F.element_at(F.transform(F.array(last), counted), 1)

    found = F.element_at(F.transform(F.array(both), runs), 1)  # bound to a variable, so computed once
    term = F.transform(found, lambda r: F.struct(r["at"]["term"].alias("term"), (r["size"] - r["at"]["mark"]).cast("long").alias("n"), r["at"]["mark"].alias("mark")))
    ranked = F.array_sort(F.transform(F.filter(term, lambda r: r["n"] > 0), lambda r: F.struct((-r["n"] * F.when(r["mark"] == 1, weight).otherwise(1)).alias("salience"), r["term"].alias("term"), r["n"].alias("n"))))
    return F.transform(F.slice(ranked, 1, n), lambda r: F.struct(r["term"].alias("term"), r["n"].alias("n")))


def top_terms(docs: DataFrame, id_col: str, text_col: str, n: int = 25, weight: int = 3, **params) -> DataFrame:
    """id, term, n (plain count), rank of each document's most salient terms: counts, times weight for proper nouns; ties by term."""
    listed = docs.select(id_col, F.posexplode(salient_terms(F.col(text_col), n, weight, **params)).alias("pos", "t"))
    return listed.select(id_col, "t.term", "t.n", (F.col("pos") + 1).alias("rank"))


def in_corpus(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds `matched`: whether a term occurs in the corpus (one row, lower case) between characters that are no letters or digits.

    A term of letters and digits does if it is one of the corpus's runs of those: an equi-join. Others, such as c++ or node.js,
    are looked up by pattern."""
    text = corpus.columns[0]
    runs = corpus.select(F.explode(F.split(text, "[^a-z0-9]+")).alias("term")).where("term != ''").distinct().withColumn("is_run", F.lit(True))
    quoted = F.regexp_replace("term", r"([^A-Za-z0-9 ])", r"\\$1")
    by_pattern = F.regexp_like(corpus.scalar(), F.concat(F.lit("(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)")))
    found = F.coalesce("is_run", F.when(~F.col("term").rlike("^[a-z0-9]+$"), by_pattern), F.lit(False))
    return terms.join(runs, "term", "left").withColumn("matched", found).drop("is_run")


def keyword_gap(docs: DataFrame, id_col: str, text_col: str, corpus: DataFrame, n: int = 25, **params) -> DataFrame:
    """id, matched, missing (terms in order of salience), coverage, coverage_percent (half to even)."""
    ranked = in_corpus(top_terms(docs, id_col, text_col, n, **params), corpus)
    pick = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rank", "term")))), lambda x: x["term"])
    out = ranked.groupBy(id_col).agg(pick(F.col("matched")).alias("matched"), pick(~F.col("matched")).alias("missing"))
    share = F.coalesce(F.try_divide(F.size("matched"), F.size("matched") + F.size("missing")), F.lit(0.0))
    return docs.select(id_col).join(out, id_col, "left").select(id_col, *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("matched", "missing")), F.coalesce(share, F.lit(0.0)).alias("coverage"), F.coalesce(F.rint(share * 100), F.lit(0.0)).cast("int").alias("coverage_percent"))


def rank_by_coverage(gaps: DataFrame, id_col: str) -> DataFrame:
    """Gaps by falling coverage, ties in input order: a distributed sort."""
    return gaps.orderBy(F.col("coverage").desc(), id_col)


def cover_letter(title: Column, company: Column, overlap: Column, missing: Column, shown: int = 6) -> Column:
    """A draft of a letter, in our own words."""
    have, lack = F.array_join(F.slice(overlap, 1, shown), ", "), F.array_join(F.slice(missing, 1, shown), ", ")
    return F.concat(F.lit("Dear "), company, F.lit(" team,\n\nI would like to apply as "), title, F.lit("."), F.when(have != "", F.concat(F.lit(" My work so far covers "), have, F.lit("."))).otherwise(""), F.when(lack != "", F.concat(F.lit("\n\n[To add if true: "), lack, F.lit("]"))).otherwise(""), F.lit("\n\nKind regards"))
