"""Matching controls to canonical data: scores, scopes, greedy one-to-one assignment, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.functions import vocab as V


def pattern_score(x: Column, canonical: V.Canonical) -> Column:
    """The greatest strength of a pattern that occurs in normalised text; 0 if a negative does."""
    best = F.lit(0.0)
    for pattern, strength in sorted(canonical.patterns, key=lambda p: p[1]):
        best = F.when(x.rlike(pattern), F.lit(strength)).otherwise(best)
    for pattern in canonical.negatives:
        best = F.when(x.rlike(pattern), F.lit(0.0)).otherwise(best)
    return F.when(x == "", F.lit(0.0)).otherwise(best)


def accept_kind(accept: Column) -> Column:
    """'image', 'document' or '' for a file input's accept list."""
    low = F.lower(F.coalesce(accept, F.lit("")))
    tokens = F.filter(F.transform(F.split(low, ","), lambda t: F.trim(t)), lambda t: t != "")
    exts = F.transform(tokens, lambda t: F.when(t.startswith("."), t).otherwise(F.concat(F.lit("."), t)))
    has = lambda known: F.size(F.array_intersect(exts, F.array(*map(F.lit, known))))
    only_images = (F.size(exts) > 0) & (F.size(F.array_except(exts, F.array(*map(F.lit, V.IMAGE_EXTENSIONS)))) == 0)
    return F.when(F.trim(low) == "", "").when(F.contains(low, F.lit("image/")), "image").when(low.rlike("application/(pdf|msword)"), "document").when(has(V.DOCUMENT_EXTENSIONS) > 0, "document").when(only_images, "image").otherwise("")


def type_compatible(canonical: str | Column, field_type: Column, kind: Column) -> Column:
    """Whether a control of this type can hold the data at all."""
    c = F.lit(canonical) if isinstance(canonical, str) else canonical
    file = F.lower(field_type).isin("file", "input/file")
    choice = field_type.isin("radio", "checkbox", "input/radio", "input/checkbox")
    upload = c.isin("resume_file", "cover_letter")
    return F.when(c == "demographic_option", choice).when(file, (kind != "image") & upload).when(upload, F.lit(True)).when(field_type.isin("email", "input/email"), c.isin("email", "confirm_email")).otherwise(F.lit(True))


def attribute_score(canonical: V.Canonical) -> Column:
    """Over the columns n_label ... n_placeholder of normalised attributes: the greatest of strength times weight, to 4 places."""
    return F.round(F.greatest(*(pattern_score(F.col(f"n_{a}"), canonical) * w for a, w in V.ATTRIBUTE_WEIGHTS.items())), 4)


def field_score(canonical: V.Canonical) -> Column:
    score = attribute_score(canonical)
    if canonical.name == "resume_file":
        score = F.when(F.lower("field_type").isin("file", "input/file") & (F.col("kind") == "document"), F.greatest(F.lit(V.UPLOAD_CONFIDENCE), score)).otherwise(score)
    if canonical.name == "free_text_question":
        label = F.trim(T.first_non_empty(F.col("label"), F.col("aria_label")))
        prompt = (label != "") & (label.endswith("?") | (F.length(label) >= V.PROMPT_LENGTH))
        score = F.when((F.col("tag") == "textarea") & prompt, F.greatest(F.lit(V.ESSAY_CONFIDENCE), score)).otherwise(score)
    tokens = [k for k, v in V.AUTOCOMPLETE.items() if v == canonical.name]
    return F.when(F.col("n_autocomplete").isin(tokens), F.lit(1.0)).otherwise(score) if tokens else score


def with_normalized(fields: DataFrame) -> DataFrame:
    """Each attribute is normalised once, whatever the number of canonicals."""
    out = fields.withColumns({f"n_{a}": T.normalize(F.col(a)) for a in V.ATTRIBUTE_WEIGHTS})
    return out.withColumns({"n_autocomplete": F.replace(T.normalize(F.col("autocomplete")), F.lit(" "), F.lit("-")), "kind": accept_kind(F.col("accept"))})


def candidates(fields: DataFrame, threshold: float = V.THRESHOLD, vocabulary: Sequence[V.Canonical] = V.VOCABULARY) -> DataFrame:
    """form_id, field_idx, grp, grp_index, canonical, confidence, multi of all pairings at the threshold or above.

    Scores cost far more than the rows are large, so controls are dealt out before; not by form, else the shuffle of
    greedy() would go, and with it the reuse of the scores by all that reads its result."""
    grouped = F.coalesce(F.col("grp"), F.lit("")) != ""
    one = lambda c: F.when((grouped == F.lit(c.row_level)) & type_compatible(c.name, F.col("field_type"), F.col("kind")), F.struct(F.lit(c.name).alias("canonical"), field_score(c).alias("confidence"), F.lit(c.allow_multiple).alias("multi")))
    scored = with_normalized(fields.repartition("form_id", "field_idx")).select("form_id", "field_idx", F.when(grouped, F.col("grp")).otherwise("").alias("grp"), F.when(grouped, F.col("grp_index")).otherwise(-1).alias("grp_index"), F.explode(F.filter(F.array(*map(one, vocabulary)), lambda x: x["confidence"] >= threshold)).alias("c"))
    return scored.select("form_id", "field_idx", "grp", "grp_index", "c.canonical", "c.confidence", "c.multi")


def greedy(cands: DataFrame, scope: Sequence[str], idx: str = "field_idx", canonical: str = "canonical", confidence: str = "confidence", multi: str = "multi") -> DataFrame:
    """Greedy one-to-one assignment within each scope: pairings by falling confidence, then control, then name; a control is
    used once, a canonical once unless it is multi. A fold over the scope's candidates (tens of controls), one shuffle."""
    item = F.struct((-F.col(confidence)).cast("double").alias("neg"), F.col(idx).cast("long").alias("idx"), F.col(canonical).cast("string").alias("canon"), F.col(multi).alias("multi"))
    start = F.array().cast("array<struct<neg:double,idx:bigint,canon:string,multi:boolean>>")
    clash = lambda acc, x: F.exists(acc, lambda y: (y["idx"] == x["idx"]) | ((y["canon"] == x["canon"]) & ~x["multi"]))
    fold = F.aggregate(F.sort_array(F.collect_list(item)), start, lambda acc, x: F.when(clash(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return cands.groupBy(*scope).agg(fold.alias("won")).select(*scope, F.posexplode("won").alias("rank", "w")).select(*scope, "rank", F.col("w.idx").alias(idx), F.col("w.canon").alias(canonical), (-F.col("w.neg")).alias(confidence))


def signature() -> Column:
    """What a reader takes a control for: its first normalised name."""
    return T.first_non_empty(*(T.normalize(F.col(a)) for a in ("label", "aria_label", "name", "element_id")))


def propagate_duplicates(controls: DataFrame, assigned: DataFrame, scope: Sequence[str], sign: str, idx: str, canonical: str, confidence: str, least: float = V.DUPLICATE_CONFIDENCE) -> DataFrame:
    """Controls with no assignment take that of the first confident one with their signature; controls exclude file inputs. Adds `copied`.

    Both sides of each join grow with the controls, and what was exploded or compresses well looks small to the planner: no broadcasts."""
    keyed = assigned.join(controls.select(*scope, idx, sign).hint("merge"), [*scope, idx])
    firsts = keyed.where((F.col(confidence) >= least) & (F.col(sign) != "")).groupBy(*scope, sign).agg(F.min_by(F.struct(canonical, confidence), "rank").alias("w"))
    left = controls.select(*scope, idx, sign).join(assigned.select(*scope, idx).hint("merge"), [*scope, idx], "left_anti")
    copied = left.join(firsts.hint("merge"), [*scope, sign]).select(*scope, idx, F.col(f"w.{canonical}").alias(canonical), F.col(f"w.{confidence}").alias(confidence), F.lit(True).alias("copied"))
    return assigned.select(*scope, idx, canonical, confidence, F.lit(False).alias("copied")).unionByName(copied)


def match_forms(fields: DataFrame, threshold: float = V.THRESHOLD) -> DataFrame:
    """form_id, field_idx, grp, grp_index, canonical ('' if none), confidence, status."""
    scope = ["form_id", "grp", "grp_index"]
    cands = candidates(fields, threshold)
    won = greedy(cands, scope)
    grouped = F.coalesce(F.col("grp"), F.lit("")) != ""
    controls = fields.select("form_id", F.when(grouped, F.col("grp")).otherwise("").alias("grp"), F.when(grouped, F.col("grp_index")).otherwise(-1).alias("grp_index"), F.col("field_idx").cast("long").alias("field_idx"), signature().alias("sign"), F.col("field_type").isin("file", "input/file").alias("is_file"))
    files = won.join(controls.where("is_file").select(*scope, "field_idx").hint("merge"), [*scope, "field_idx"], "left_semi").select(*scope, "field_idx", "canonical", "confidence", F.lit(False).alias("copied"))
    rest = won.join(controls.where("NOT is_file").select(*scope, "field_idx").hint("merge"), [*scope, "field_idx"], "left_semi")
    found = propagate_duplicates(controls.where("NOT is_file"), rest, scope, "sign", "field_idx", "canonical", "confidence").unionByName(files)
    review = F.col("canonical").isin([c.name for c in V.VOCABULARY if c.review_only])
    joined = controls.join(found.hint("merge"), [*scope, "field_idx"], "left")
    return joined.select("form_id", "field_idx", "grp", "grp_index", F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("canonical").isNull(), "skipped_no_match").when(review, "skipped_by_policy").otherwise("skipped_no_value").alias("status"))


def renumber_rows(fields: DataFrame, by: Sequence[str], raw: str) -> Column:
    """Dense row numbers from 0 of a repeating section."""
    return F.dense_rank().over(Window.partitionBy(*by).orderBy(raw)) - 1
