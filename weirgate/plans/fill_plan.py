"""The fill plan: what value each matched control gets, from where, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.functions import vocab as V
from weirgate.operators import matching


def is_current(end_date: Column) -> Column:
    """A blank end counts as current."""
    return F.lower(F.trim(end_date)).isin("present", "current", "")


def current_position(positions: Column) -> Column:
    """The first position still held, else the first; null without positions."""
    return F.coalesce(F.get(F.filter(positions, lambda p: is_current(p["end_date"])), F.lit(0)), F.get(positions, F.lit(0)))


def degree_display(degree: Column, in_progress: Column) -> Column:
    return F.when(in_progress & (degree != ""), F.concat(degree, F.lit(" (In Progress)"))).otherwise(degree)


def group_source(group: Column) -> Column:
    """Which collection a repeating section shows."""
    g = T.normalize(group)
    return F.when(g.rlike("work|employment|experience|job|position"), "positions").when(g.rlike("education|school|degree|academic"), "education").otherwise("")


def resume_values(resumes: DataFrame) -> DataFrame:
    """resume_id, canonical, value: the flat values of each resume, unpivoted."""
    job, study = current_position(F.col("positions")), F.get("education", F.lit(0))
    value = {c: F.col(c) for c in ("first_name", "last_name", "email", "phone", "address_line1", "city", "state", "postal_code", "country", "linkedin_url", "github_url", "portfolio_url")}
    value |= {
        "full_name": F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))),
        "confirm_email": F.col("email"),
        "current_company": job["company"],
        "current_title": job["title"],
        "school": study["school"],
        "degree": degree_display(study["degree"], study["in_progress"]),
        "major": study["major"],
        "graduation_year": study["graduation_year"],
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("canonical"), F.coalesce(v, F.lit("")).alias("value")) for k, v in value.items()))
    return resumes.select("resume_id", F.inline(pairs))


def entry_values(resumes: DataFrame) -> DataFrame:
    """resume_id, source, row, canonical, value: the values of each row of a resume's history."""
    jobs = resumes.select("resume_id", F.posexplode("positions").alias("row", "p"))
    start, end = T.split_date(F.col("p.start_date")), T.split_date(F.col("p.end_date"))
    of_job = {"entry_title": F.col("p.title"), "entry_company": F.col("p.company"), "entry_description": F.col("p.description"), "entry_start_month": start["month"], "entry_start_year": start["year"], "entry_end_month": end["month"], "entry_end_year": end["year"], "entry_currently_here": F.when(is_current(F.col("p.end_date")), "yes").otherwise(""), "entry_location": F.col("p.location")}
    studies = resumes.select("resume_id", F.posexplode("education").alias("row", "e"))
    of_study = {"entry_school": F.col("e.school"), "entry_degree": degree_display(F.col("e.degree"), F.col("e.in_progress")), "entry_field_of_study": F.col("e.major"), "entry_end_year": F.col("e.graduation_year")}
    rows = lambda df, source, vs: df.select("resume_id", F.lit(source).alias("source"), "row", F.inline(F.array(*(F.struct(F.lit(k).alias("canonical"), F.coalesce(v, F.lit("")).alias("value")) for k, v in vs.items()))))
    return rows(jobs, "positions", of_job).unionByName(rows(studies, "education", of_study))


def plan(fields: DataFrame, resumes: DataFrame, profile: DataFrame, threshold: float = V.THRESHOLD, resume_path: str = "") -> DataFrame:
    """form_id, field_idx, canonical, confidence, value, status, reason. fields carry resume_id; profile is resume_id, canonical, supplied.

    Precedence: no match, the applicant's own answer, a policy, the resume's value, a blank that is the answer, a gap.
    Every table here grows with the applicants, so none is broadcast, however small the planner takes it to be."""
    matched = matching.match_forms(fields, threshold).join(fields.select("form_id", F.col("field_idx").cast("long").alias("field_idx"), "resume_id").hint("merge"), ["form_id", "field_idx"])
    matched = matched.withColumn("source", group_source(F.col("grp")))
    flat = matched.where("grp = ''").join(resume_values(resumes).hint("merge"), ["resume_id", "canonical"], "left")
    files = F.when(F.col("canonical") == "resume_file", F.lit(resume_path))
    flat = flat.withColumn("value", F.coalesce(F.col("value"), files, F.lit(""))).withColumn("rows", F.lit(0))
    counts = resumes.select("resume_id", F.size("positions").alias("rows"))
    entries = entry_values(resumes).withColumnRenamed("row", "grp_index")
    rows = matched.where("grp != ''").join(entries.hint("merge"), ["resume_id", "source", "grp_index", "canonical"], "left").join(counts.hint("merge"), "resume_id", "left").withColumn("value", F.coalesce("value", F.lit(""))).withColumn("rows", F.coalesce("rows", F.lit(0)))
    both = flat.unionByName(rows).join(profile.hint("merge"), ["resume_id", "canonical"], "left")
    own = F.coalesce(F.nullif("supplied", F.lit("")), F.lit(""))
    blank = (F.col("canonical") == "entry_currently_here") & (F.col("source") == "positions") & (F.col("grp_index") < F.col("rows"))
    none, policy = F.col("canonical") == "", F.col("status") == "skipped_by_policy"
    status = F.when(none, F.col("status")).when(own != "", "filled").when(policy, "skipped_by_policy").when(F.col("value") != "", "filled").when(blank, "not_applicable").otherwise("skipped_no_value")
    value = F.when(none, "").when(own != "", own).when(policy, "").otherwise(F.col("value"))
    reason = F.when(none, "nothing matches").when(own != "", "from the profile").when(policy, "for the applicant to answer").when(F.col("value") != "", "").when(blank, "not applicable here").otherwise("not in the resume")
    return both.select("form_id", "field_idx", "canonical", "confidence", value.alias("value"), status.alias("status"), reason.alias("reason"))


def plan_table(planned: DataFrame, width: int = 24, verbose: bool = False) -> DataFrame:
    """The plan as shown: texts cut to a width; controls that match nothing are hidden and counted unless verbose."""
    none = F.col("status") == "skipped_no_match"
    counted = planned.withColumn("hidden", F.lit(0).cast("long") if verbose else F.count_if(none).over(Window.partitionBy("form_id")))
    shown = counted if verbose else counted.where(~none)
    return shown.select("form_id", "field_idx", T.truncate(F.col("canonical"), width).alias("canonical"), T.truncate(F.col("value"), width).alias("value"), "status", "hidden")


def collapse_empty_rows(matches: DataFrame, group: list[str], filled: Column) -> DataFrame:
    """Rows without a filled control are left out; what is left, and how many rows went, per group."""
    return matches.groupBy(*group).agg(F.bool_or(filled).alias("any_filled"), F.count("*").alias("n"))
