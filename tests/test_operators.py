"""Behaviour of single operators on small cases."""

import random

from pyspark.sql import functions as F

from weirgate.functions import text as T
from weirgate.operators import decisions, history, matching, postings, resume
from weirgate.plans import catalog, fill_plan
from weirgate.sources import forms
from weirgate.sources import postings as sources
from weirgate.streaming.history import read_history, upsert_stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    for raw, want in (("firstName", "first name"), ("first_name", "first name"), ("  E-Mail* ", "e mail"), ("", ""), (None, ""), ("ABC2Def", "abc2 def")):
        assert one(spark, T.normalize(F.col("s")), s=raw) == want


def test_phone_takes_the_first_of_ten_digits_or_more(spark):
    assert one(spark, T.phone(F.col("s")), s="id 555-0100, call (210) 555-0100 ext. 4") == "(210) 555-0100 ext. 4"
    assert one(spark, T.phone(F.col("s")), s="none") == ""


def test_proper_nouns_skip_sentence_starts(spark):
    assert one(spark, T.proper_nouns(F.col("s")), s="We use Kubernetes. Nice tools: GraphQL and Go.\n• Design it") == ["go", "graphql", "kubernetes"]


def test_coverage_rounds_half_to_even(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta theta kappa"), (2, ""), (3, "alpha c++")], "doc_id int, text string")
    corpus = spark.createDataFrame([("alpha x c++",)], "c string")
    got = {r["doc_id"]: r for r in postings.keyword_gap(docs, "doc_id", "text", corpus).collect()}
    assert got[1]["coverage"] == 0.125 and got[1]["coverage_percent"] == 12
    assert got[2]["coverage_percent"] == 0 and got[2]["matched"] == []
    assert got[3]["matched"] == ["alpha", "c++"]


def test_keyword_filter_of_blanks_keeps_nothing(spark):
    df = spark.createDataFrame([("Data engineer",)], "t string")
    assert df.where(postings.has_keyword(F.col("t"), [" "])).count() == 0
    assert df.where(postings.has_keyword(F.col("t"), [])).count() == 1
    assert df.where(postings.has_keyword(F.col("t"), ["DATA "])).count() == 1


def test_upsert_keeps_what_was_first_said(spark):
    log = spark.createDataFrame([("u", 1, "A", "failed"), ("u", 2, "B", "submitted"), ("v", 1, "C", "failed")], "url string, seq int, title string, status string")
    table = history.upsert(log, "url", ["seq"], ["title"], ["status"])
    assert {tuple(r) for r in table.collect()} == {("u", "A", "submitted"), ("v", "C", "failed")}
    new = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    assert {r[0] for r in history.unseen(new, table, "url").collect()} == {"v", "w"}


def test_upsert_stream(spark, tmp_path):
    schema = "url string, seq int, title string, status string"
    source = str(tmp_path / "in")
    args = ("url", ["seq"], ["title"], ["status"])
    for batch in ([("u", 1, "A", "failed")], [("u", 2, "B", "done"), ("v", 3, "C", "failed")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        q = upsert_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "t"), *args, str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert {tuple(r) for r in read_history(spark, str(tmp_path / "t"), *args).collect()} == {("u", "A", "done"), ("v", "C", "failed")}


def test_greedy_is_the_sequential_greedy(spark):
    rng = random.Random(5)
    rows = [(f, i, rng.choice("abcde"), rng.choice((0.55, 0.6, 0.8, 0.9, 1.0))) for f in range(20) for i in range(8) for _ in range(2)]
    rows = sorted({(f, i, c): (f, i, c, s, c in "de") for f, i, c, s in rows}.values())
    want = set()
    for f in range(20):
        used, taken = set(), set()
        for _, i, c, s, multi in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[1], r[2])):
            if i not in used and (c not in taken or multi):
                used.add(i)
                taken.add(c)
                want.add((f, i, c, s))
    df = spark.createDataFrame(rows, "form int, field_idx int, canonical string, confidence double, multi boolean")
    assert {(r["form"], r["field_idx"], r["canonical"], r["confidence"]) for r in matching.greedy(df, ["form"]).collect()} == want


def test_plan_precedence(spark):
    got = {(r["form_id"], r["field_idx"]): r for r in catalog._planned(spark).collect()}
    assert got["f1", 7]["status"] == "filled" and got["f1", 7]["reason"] == "from the profile"
    assert got["f1", 6]["status"] == "skipped_by_policy"
    assert got["f1", 12]["status"] == "not_applicable"
    assert got["f1", 8]["value"] == "Ana"  # the same question twice


def test_scan_reads_labels_groups_and_options(spark):
    pages = spark.createDataFrame([("p", catalog._FORM), ("q", ""), ("r", None)], "form_id string, html string")
    got = forms.scan_forms(pages).orderBy("field_idx").collect()
    assert {r["form_id"] for r in got} == {"p"}
    assert [r["label"] for r in got][:4] == ["First Name *", "Email", "Are you authorized to work?", "Are you authorized to work?"]
    assert got[2]["options"] == ["Yes"] and got[6]["options"] == ["Spain", "Peru"]
    assert [(r["grp"], r["grp_index"]) for r in got if r["grp"]] == [("workExperience", 0), ("workExperience", 1)]
    assert got[9]["widget"] == "combobox" and got[9]["options"] == ["Lima"]


def test_resume_layouts(spark):
    text = "Head Analyst—Fern Works\nBoise, Idaho | Contract | Mar 2022 - Now\nSet the plans\nQuarry Ltd, Salem, Oregon   Feb 2019 to Oct 2020\nSecond Line Operator\nRan the desk"
    lines = spark.createDataFrame([("r", i, x) for i, x in enumerate(text.split("\n"))], "id string, pos int, line string")
    a, b = resume.positions(lines, "id").orderBy("row").collect()
    assert (a["title"], a["company"], a["location"], a["end_date"]) == ("Head Analyst", "Fern Works", "Boise, Idaho", "Present")
    assert (b["title"], b["company"], b["location"], b["description"]) == ("Second Line Operator", "Quarry Ltd", "Salem, Oregon", "Ran the desk")


def test_options_and_agreement(spark):
    pairs = spark.createDataFrame([(1, "Yes", "Yes, I do", 0), (1, "Yes", "yes", 1), (2, "United States of America", "United States", 0)], "k int, w string, o string, n int")
    assert {(r["k"], r["o"]) for r in decisions.select_option(pairs, ["k"], "w", "o", "n").collect()} == {(1, "yes")}
    assert (2, "United States") in {(r["k"], r["o"]) for r in decisions.select_option(pairs, ["k"], "w", "o", "n", either_way=True).collect()}
    assert one(spark, decisions.values_agree(F.col("a"), F.col("b")), a="New York City", b="York town city") is True
    assert one(spark, decisions.values_agree(F.col("a"), F.col("b")), a="Oslo", b="Lima") is False


def test_missing_url_column_is_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="url"):
        sources.csv_postings(spark.createDataFrame([("x",)], "title string"))


def test_current_position_prefers_open_ends(spark):
    df = spark.sql("SELECT array(named_struct('title', 'a', 'end_date', '2020'), named_struct('title', 'b', 'end_date', '')) AS p, array() AS none")
    assert df.select(fill_plan.current_position(F.col("p"))["title"]).first()[0] == "b"


def test_settings_fall_back_and_list_problems(tmp_path):
    from weirgate.sources.settings import Settings

    got = Settings.from_env({"WEIRGATE_THRESHOLD": "high", "WEIRGATE_LIMIT": "3", "WEIRGATE_VERBOSE": "Yes", "WEIRGATE_RESUME": str(tmp_path / "none")})
    assert (got.threshold, got.limit, got.verbose) == (0.55, 3, True) and len(got.problems()) == 1
    assert Settings(threshold=1.5).problems()


def test_views_and_letters(spark, tmp_path):
    from weirgate.plans import views
    from weirgate.sources.letters import write_letters

    views.register(spark, "/root/testdata/sf0.001", ["status_summary", "split_date"])
    assert spark.sql("SELECT sum(n) FROM status_summary").first()[0] > 0
    write_letters(spark.createDataFrame([("Data Dev!", "Dear")], "title string, letter string"), str(tmp_path / "l"))
    assert [(r["slug"], r["value"]) for r in spark.read.text(str(tmp_path / "l")).select("slug", "value").collect()] == [("data-dev", "Dear")]


def test_every_html_reference_is_read_once(spark):
    text = "<b>Caf&eacute; &#8217;s &#x1F600; &amp;lt; &copy 2 &notaname; R&D &#0; &amp;amp;</b>"
    assert one(spark, T.strip_html(F.col("s")), s=text) == " Caf\u00e9 \u2019s \U0001f600 &lt; \u00a9 2 &notaname; R&D \ufffd &amp; "


def test_meta_and_headings_of_saved_postings(spark):
    html = """<title>T</title><meta content='long &amp; quoted' property='og:description'><meta name=description content="short"><h2> Data <b>Dev</b></h2><p>x</p>"""
    got = one(spark, sources.html_posting(F.col("s")), s=html)
    assert (got["title"], got["meta"]) == ("Data Dev", "long & quoted")


def test_a_place_takes_no_other_places_code(spark):
    got = one(spark, resume.contact(F.col("s")), s="Austin, TX then Dallas, TX 75201")
    assert (got["city"], got["state"], got["postal_code"]) == ("Austin", "TX", "")
    assert one(spark, resume.infer_country(F.col("s")), s="mp") == "United States"


def test_list_items_are_trimmed_whatever_their_place(spark):
    assert one(spark, matching.accept_kind(F.col("s")), s="x, .pdf ") == "document"


def test_frames_are_scanned_and_a_stray_percent_stays(spark):
    pages = spark.createDataFrame([("/s/a.html", "<input name=a><iframe src='50%.html'></iframe>"), ("/s/50%.html", "<input name=b>")], "path string, html string")
    found = forms.scan_with_frames(pages, pages.where("path = '/s/a.html'"))
    assert [(r["frame_path"], r["field_idx"], r["name"]) for r in found.orderBy("field_idx").collect()] == [([], 0, "a"), ([0], 1, "b")]
    assert forms.contexts(found).first()["contexts"] == 2


def test_degrees_and_majors(spark):
    rows = [("r", 0, "Master of Science in Computer Science"), ("r", 1, "State University, 2017"), ("r", 2, "B.S. in Art and Design, expected 2027")]
    a, b = resume.education(spark.createDataFrame(rows, "id string, pos int, line string"), "id").orderBy("row").collect()
    assert (a["degree"], a["major"], a["school"], a["graduation_year"]) == ("Master of Science", "Computer Science", "State University", "2017")
    assert (b["degree"], b["major"], b["in_progress"]) == ("B.S", "Art and Design", True)


def test_the_fill_plan_broadcasts_no_table_that_grows(spark):
    df = catalog.QUERIES["profile_override"](spark, "/root/testdata/sf0.001")
    assert df.count() == 900
    built = df.select("*")
    built.collect()
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("BroadcastHashJoin") == 1 and "n_regionkey" in final  # the 25 nations
