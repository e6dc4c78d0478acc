"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirgate.llm import exact_dedup, langid, licenses, minhash_dedup, mixing, packing, quality, queries, substring_dedup, toxicity, url_filter
from weirgate.llm.common import mix
from weirgate.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id long, family string, pid int, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BODY = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, BODY), (2, BODY.upper()), (2, BODY.upper()), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, "one two"), (None, BODY), (None, None), (8, BODY + " more"), (9, "x" * 200_000), (10, "one two")]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i in (1, 6) else f"s{(i or 0) % 3}", None, True, 5, "f", 1, 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def smallest_reachable(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# ---- exact dedup

def test_exact_dedup_is_brute_force(docs, texts):
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[hashlib.sha256(t.translate(LOWER).encode()).hexdigest()].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_dedup(docs, keep).collect()
        assert {tuple(r) for r in got} == {(i, pick(g), len(g), i == pick(g), h) for h, g in groups.items() for i in g}


def test_exact_dedup_of_a_group_over_many_partitions(spark):
    df = spark.range(0, 4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), "id")).otherwise("SAME text").alias("text"))
    got = exact_dedup.exact_dedup(df, "largest")
    assert got.where("kept").count() == 4000 // 3 + 2
    assert got.where("group_size > 1").select("keep_id", "group_size").distinct().collect() == [(3998, 2666)]


def test_exact_dedup_of_odd_rows(odd, empty):
    got = exact_dedup.exact_dedup(odd, "smallest").collect()
    assert len(got) == 13 and sum(r["kept"] for r in got) == len({(t or "").translate(LOWER) for _, t, *_ in odd.collect()})
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


# ---- near dedup

@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_brute_force(docs, texts, k):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable(ids, links)
    got = minhash_dedup.near_duplicates(docs, k).collect()
    assert {tuple(r) for r in got} == {(i, len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_of_a_family_over_many_blocks(spark):
    """A family larger than a block, without a centre: each text is near the next only."""
    words = [f"c{i}" for i in range(1500)]
    chain = [(i, " ".join(words[i : i + 100])) for i in range(0, 1400, 2)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 4)
    assert got.select("component_id").distinct().collect() == [(0,)]


def test_near_duplicates_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_duplicates(odd, 4).collect()}
    assert {(1, 117, 1), (2, 117, 1), (8, 118, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7), (10, 1, 7), (9, 1, 9)} <= got
    kept = minhash_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {3, 4, 5, 6, 7, 9, 1} == {r["doc_id"] for r in kept.collect() if r["doc_id"]}
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 300), (5, 5), (None, 1)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(i, 0) for i in (*range(51), 100)} | {(200, 200), (300, 200)}


def test_components_of_stars_with_hot_nodes(spark):
    """Hubs that are the smallest, the largest and a middle node of over a thousand edges, joined by a path."""
    hubs = [(0, range(1, 2500)), (9000, range(3000, 5500)), (6500, range(5500, 8000))]
    edges = [(hub, leaf) for hub, leaves in hubs for leaf in leaves if leaf != hub] + [(2499, 3000), (5499, 5500), (10_000, 10_001)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(n, 0) for n in {n for e in edges for n in e} if n < 10_000} | {(10_000, 10_000), (10_001, 10_000)}
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "src string, dst string")
    assert {tuple(r) for r in components(names).collect()} == {(n, "a") for n in "abc"} | {(n, "x") for n in "xy"}


def test_families_beyond_a_broadcast(docs, monkeypatch):
    """Where ids are too many for a broadcast, the texts are shuffled: the same rows."""
    want = sorted(minhash_dedup.near_duplicates(docs, 4, 0.8).collect())
    monkeypatch.setattr(minhash_dedup, "MOST_IDS", 0)
    assert sorted(minhash_dedup.near_duplicates(docs, 4, 0.8).collect()) == want


# ---- quality rules

def test_measurements_are_brute_force(docs, odd):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    for table in (docs, odd):
        want = collections.Counter((r["doc_id"], *brute(r["text"])) for r in table.select("doc_id", "text").collect())
        got = collections.Counter((r["doc_id"], *(r[m] for m in quality.MEASURES)) for r in quality.ledger(table).collect())
        assert got == want


def test_policies_and_ablations(spark, docs, odd, empty):
    entries = quality.ledger(docs).cache()
    rows = entries.collect()
    got = {(r["policy"], r["rule"]): r for r in quality.ablations(entries).collect()}
    for policy in (quality.BASE, quality.STANDARD):
        for rule in policy.rules:
            bit = 1 << list(quality.RULES).index(rule)
            r = got[policy.name, rule]
            assert r["failed"] == sum(x["failures"] & bit != 0 for x in rows)
            assert r["failed_alone"] == sum(x["failures"] & policy.mask == bit for x in rows)
            assert r["rejected"] == sum(x["failures"] & policy.mask != 0 for x in rows)
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 8, None}  # 6 repeats itself
    assert quality.filter_quality(empty).count() == 0


def test_clashing_names_and_one_evaluation(spark, odd):
    names = ["quality_words", "quality_ledger", "near_doc_id", "mix_doc_id", "mix_copies", "mix_copy", "digest", "rows", "taken", "size_"]
    df = odd
    for n in names:
        df = df.withColumn(n, F.lit(f"own {n}"))
    for got in (quality.filter_quality(df), minhash_dedup.drop_near_duplicates(df), mixing.apply_mix(df), exact_dedup.drop_exact_duplicates(df)):
        rows = got.collect()
        assert got.columns == df.columns and rows and all(r[n] == f"own {n}" for r in rows for n in names)
    plan = quality.filter_quality(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


# ---- toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got.toxic == 1
    assert (got.predicted[toxic] == 1).mean() > 0.8 and (got.predicted[~toxic] == 1).mean() < 0.02
    assert docs.count() == 10_000


def test_obfuscation_is_read(docs):
    chars = toxicity.char_model(docs.select("text"))
    for token, want in {"m0r0n": "moron", "tr4$h": "trash", "st.u.p.i.d": "stupid", "i-d-i-o-t": "idiot"}.items():
        assert chars.read(token) == want
    assert toxicity.restore("an m o r o n and tr@sh", chars) == "an moron and trash"


def _found(texts, chars):
    """For each text the words of which it has a feature that its plain words do not give."""
    import pyarrow as pa

    from weirgate.llm.common import text_chunks

    def features(texts):
        (_, _, data, offsets), = text_chunks(pa.array(texts))
        row, f = toxicity._features(data, offsets, chars)
        return [set(f[row == i].tolist()) for i in range(len(texts))]

    plain = {w: features([w])[0] for w in ("stupid", "people", "trash", "moron")}
    return [{w for w, x in plain.items() if x <= got} for got in features(texts)]


def test_readings_of_any_length_and_sign(docs):
    chars = toxicity.char_model(docs.select("text"))
    many = " ".join("the people of the city and the people of the world")
    got = _found(["pe" + "o" * 90 + "ple", f"x {many}", "tr^ash", "st·upid", "tr`a~sh"], chars)
    assert got == [{"people"}, {"people"}, {"trash"}, {"stupid"}, {"trash"}]
    assert "people" in toxicity.restore(f"so {many}", chars).split()


def test_spaced_letters_at_the_border_of_documents(docs):
    chars = toxicity.char_model(docs.select("text"))
    alone = _found(["they are p e o p l e"], chars)
    assert alone == [{"people"}]
    assert _found(["they are p e o p l e", "I see", "- t r a s h"], chars) == [{"people"}, set(), {"trash"}]


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (7, 0), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(empty, labels.limit(0))):
        scores = [r["score"] for r in toxicity.score(odd, model).collect()]
        assert len(scores) == 13 and all(0 <= s <= 1 for s in scores)
        assert toxicity.score(empty, model).count() == 0


# ---- language id

def test_language_on_held_out_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(3)
    sizes = [0, 3, 1, 0, 5, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(first[-1], 3)).astype(np.float32) * 3
    got = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            paths = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a)
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            assert value(got[a:b]) == pytest.approx(max(map(value, paths)), abs=1e-4)


def test_viterbi_with_many_languages():
    scores = np.zeros((5, 300), np.float32)
    scores[:, 280] = 9
    assert langid.viterbi(scores, np.array([0, 2, 5])).tolist() == [280] * 5


def test_spans_and_odd_texts(spark, docs, odd, empty):
    model = langid.fit(docs)
    de, fr = (docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"][:400] for x in ("de", "fr"))
    df = spark.createDataFrame([(1, f"{de} {fr}"), (2, "12 34 !"), (3, None), (4, ""), (5, "Привет мир")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(df, model, with_spans=True).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["de", "fr"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4)) and got[5]["lang_pred"] in model.languages
    assert langid.predict(odd, model).count() == 13 and langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


# ---- licences

def test_licenses_are_brute_force(docs, texts, odd, empty):
    def tokens(t):
        return re.findall(r"[^\W_]+", t.lower())

    want = set()
    for i, t in texts.items():
        w = tokens(t)
        have = {" ".join(w[j : j + 5]) for j in range(len(w) - 4)}
        want |= {(i, name) for name, ns in licenses.TEMPLATES.items() for n in ns if set(licenses.template_shingles(n)) <= have}
    assert {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).where("containment = 1").collect()} == want
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0


def test_a_notice_with_an_edit_is_found(spark):
    for word, changed in (("redistribution", "distribution"), ("modification", "changes")):  # at the edge 1 of 17 shingles goes, inside 5
        notice = licenses.TEMPLATES["bsd"][0].lower().replace(word, changed)
        wanted = set(licenses.template_shingles(licenses.TEMPLATES["bsd"][0]))
        share = len(wanted & set(licenses.template_shingles(notice))) / len(wanted)
        df = spark.createDataFrame([(1, BODY + " " + notice + " " + BODY), (2, BODY), (1, notice)], "doc_id long, text string")
        found = [(r["doc_id"], round(r["containment"], 6)) for r in licenses.scan_licenses(df).collect()]
        assert found == ([(1, round(share, 6))] if share >= 0.8 else [])
    full = spark.createDataFrame([(3, BODY + " " + licenses.TEMPLATES["bsd"][0] + " " + BODY)], "doc_id long, text string")
    assert [(r["doc_id"], r["license"], r["containment"]) for r in licenses.scan_licenses(full).collect()] == [(3, "bsd", 1.0)]


def test_every_shingle_has_an_anchor():
    notices = [n for ns in licenses.TEMPLATES.values() for n in ns]
    marks = set(licenses.anchors(notices))
    assert all(marks & set(s.split()) for n in notices for s in licenses.template_shingles(n))


# ---- mixing

def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2.0) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([10, 1000], [3, 1], 1515, 2.0) == [20.0, 1495.0]
    assert mixing.targets([], [], 0, 2.0) == []
    assert mixing.targets([0, 5], [1, 1], 7.5, 2.0) == [0.0, 7.5]


def test_mix_meets_its_targets_and_reruns_agree(docs, texts):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    assert all(len(WORD.findall(texts[i])) == n for i, n in zip(got.doc_id, got["size"], strict=True))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    of = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    for _, g in of.groupby("source"):
        assert g["size"].sum() == g.source_size.iloc[0] and abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 13 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    assert mixing.apply_mix(odd).columns == odd.columns


def test_mix_over_many_groups(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.mix_sources(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 50 for r in got)


# ---- packing

def check_places(got, seq_len):
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= seq_len
    return len(by)


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    n = check_places(got, 4096)
    total = sum(r["length"] for r in got)
    assert n <= 1.05 * total / 4096 + 1
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert set(by) == set(texts)
    for i, rows in by.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1]
        rows.sort(key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in rows] == [(p, s, min(4096, len(ids) - s)) for p, s in enumerate(range(0, len(ids), 4096))]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in rows)


def test_words_are_tokenized_as_by_the_tokenizer():
    from tokenizers import Tokenizer

    spec = open(queries.tokenizer_path()).read()
    stream, plain = packing.TokenStream(spec), Tokenizer.from_str(spec)
    for t in ("", "Don't STOP!!! it's 1234", "É é ß Œ naïve ſ", " x y", "Σίσυφος ΟΔΟΣ", "é Å", "a\x1cb\x85c", "日本 語", "İstanbul", "x" * 5000, "'s't 're 'LL", "a\nb\r\n\tc", "¿Qué? ¡Sí!", "Ǆ Ȿ Ⱥ"):
        assert stream.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t
    for c in map(chr, (*range(0x20, 0x7F), 9, 10, 13, *range(0xA0, 0x250), 0x3A3, 0x301, 0x2028)):
        t = f"a{c}b {c}{c} '{c}1 {c}'s"
        assert stream.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, hex(ord(c))
    stream.words.begin()  # words move to the new generation
    assert stream.ids("a b don't").tolist() == plain.encode("a b don't", add_special_tokens=False).ids and len(stream.words) == 4


def test_packing_levels_and_odd_rows(spark, odd, empty, monkeypatch):
    path = queries.tokenizer_path()
    got = packing.pack_documents(odd, path).collect()
    check_places(got, 4096)
    assert sum(r["doc_id"] == 3 for r in got) == 1 and sum(r["doc_id"] == 2 for r in got) == 2
    assert packing.pack_documents(empty, path).count() == 0
    monkeypatch.setattr(packing, "GROUP", 20)
    lengths = spark.range(0, 2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(97)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    packed = packing.pack(lengths, 100).collect()
    assert len(packed) == 2000 and check_places(packed, 100) <= 1.15 * sum(r["length"] for r in packed) / 100


@pytest.mark.parametrize("low, high", [(51, 60), (1, 100), (20, 55), (34, 70)])
def test_packing_up_the_tree_loses_no_sequence(spark, monkeypatch, low, high):
    """As few sequences as without a bound on what goes up, and nearly as few as one best-fit over all pieces."""
    span = F.lit(high - low + 1)
    df = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), span) + low).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    lengths = np.sort([r["length"] for r in df.collect()])[::-1]
    count = lambda: check_places(packing.pack(df, 100).collect(), 100)
    assert count() <= 1.02 * len(packing.best_fit(lengths, 100)[2]) + 1
    monkeypatch.setattr(packing, "GROUP", 700)
    bounded = count()
    monkeypatch.setattr(packing, "PASS_ON", 10**9)
    assert bounded <= count()


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "three " * 50)], "doc_id long, text string")
    got = packing.sequences(df, queries.tokenizer_path(), 1, 16).collect()
    pieces = packing.tokenize_pieces(df, queries.tokenizer_path(), 1, 16).collect()
    assert sorted(x for r in got for x in r["ids"]) == sorted(x for r in pieces for x in r["ids"])


# ---- substring dedup

def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(1)
    least = substring_dedup.LEAST
    s = rng.integers(0, 2**63, 300).astype(np.uint64)
    s[200:220] = s[100:120]
    border = 170  # two texts
    whole = np.array([i + least <= border or i >= border for i in range(300 - least + 1)])
    value, centre, first, last = substring_dedup.compact_windows(s, whole, np.uint64(7))
    full = mix(s ^ np.uint64(7))
    assert (value == full[centre]).all()
    nodes = list(zip(first.tolist(), centre.tolist(), last.tolist(), strict=True))
    for a in np.flatnonzero(whole).tolist():
        c = a + int(full[a : a + least].argmin())
        assert sum(x <= a and y >= a + least - 1 and z == c for x, z, y in nodes) == 1
    for lo, hi in ((0, border), (border, 300)):  # a centre is a node of the tree: it spans LEAST places between smaller values
        for c in range(lo, hi):
            left = next((i for i in range(c - 1, lo - 1, -1) if full[i] <= full[c]), lo - 1)
            right = next((i for i in range(c + 1, hi) if full[i] < full[c]), hi)
            assert (right - left - 1 >= least) == (c in centre)
    assert all(y < border or x >= border for x, _, y in nodes)


def test_shared_passages(spark, odd, empty):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    common, edited = text(70), None
    words = common.split()
    words[35] = "changed"
    edited = " ".join(words)
    rows = [(i, f"{text(150)} {common if i % 2 else edited} {text(90)}") for i in range(1, 30)] + [(100, text(300)), (101, common[: len(common) // 3])]
    got = substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = smallest_reachable([i for i, _ in rows], [(r["doc_id"], r["other_id"]) for r in got])
    assert {linked[i] for i in range(1, 30)} == {1} and linked[100] == 100 and linked[101] == 101
    assert all(150 - 3 <= r["from_word"] <= 153 and r["to_word"] >= 217 for r in got)
    assert substring_dedup.shared_passages(empty).count() == 0
    assert {(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(odd).collect()} <= {(2, 1), (8, 2), (8, 1)}
    assert substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).count() >= 28


def exact_links(texts):
    """Pairs of documents that share 50 words in a row, as links of each run's documents to the first of them."""
    runs = collections.defaultdict(set)
    for i, t in texts.items():
        w = t.translate(LOWER).split()
        for j in range(len(w) - 49):
            runs[hash(tuple(w[j : j + 50]))].add(i)
    return {(max(p), min(p)) for v in runs.values() if len(v) > 1 for p in itertools.combinations(v, 2)}


def unconnected(links, found):
    top = smallest_reachable({i for p in (*links, *found) for i in p}, found)
    return [p for p in links if top[p[0]] != top[p[1]]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_no_exact_link_is_lost(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    links = exact_links({r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()})
    found = {(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(docs).collect()}
    assert len(links) >= 10 and not unconnected(links, found)


def test_near_passages_are_brute_force(spark, docs, texts):
    """All pairs of documents, searched whole, against the operator: all its links hold, and no link is lost."""
    def sequence(t):
        w = t.translate(LOWER).split()
        return np.array([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)], np.uint32)

    seqs = {i: s for i, t in texts.items() if len(s := sequence(t)) >= substring_dedup.LEAST}
    sets = {i: set(s.tolist()) for i, s in seqs.items()}
    links = {(a, b) for b, a in itertools.combinations(sorted(seqs), 2) if len(sets[a] & sets[b]) > 8 and substring_dedup.passages(seqs[a], seqs[b])}
    got = substring_dedup.shared_passages(docs).collect()
    found = {(r["doc_id"], r["other_id"]) for r in got}
    assert len(links) >= 10 and not unconnected(links, found)
    for r in got:
        a, b = (set(sequence(texts[r[i]])[r[x] : r[y] - 4].tolist()) for i, x, y in (("doc_id", "from_word", "to_word"), ("other_id", "other_from_word", "other_to_word")))
        assert 100 * len(a & b) >= 80 * len(a | b) and min(r["to_word"] - r["from_word"], r["other_to_word"] - r["other_from_word"]) >= 50


def test_a_document_between_hides_no_link(spark):
    """Documents 1 and 3 share 60 words; 2 lies between them, or before or after them, with 48 of these."""
    rng = np.random.default_rng(5)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    rows, links = [], set()
    for i in range(150):
        shared = text(60)
        low, high, thief = [(1, 3, 2), (2, 3, 1), (1, 2, 3)][i % 3]
        for k, part in ((low, shared), (high, shared), (thief, shared[6:54])):
            rows.append((10 * i + k, " ".join(text(100) + part + text(100))))
        links.add((10 * i + high, 10 * i + low))
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == links


def test_many_documents_between_hide_no_link(spark):
    """Of 202 documents the first and the last share 50 words; each of the others has 14 of these, too few for a strong pair."""
    rng = np.random.default_rng(5)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    rows = []
    for i in range(0, 6000, 1000):
        shared = text(50)
        parts = [shared, *(shared[max(0, k % 5 * 10 - 2) :][:14] for k in range(200)), shared]
        rows += [(i + k, " ".join(text(60) + part + text(60))) for k, part in enumerate(parts)]
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i + 201, i) for i in range(0, 6000, 1000)}


def test_differently_edited_copies_are_linked_by_their_base(spark):
    rng = np.random.default_rng(6)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    base, rows = text(60), []
    for i in range(120):
        part = list(base)
        if i != 77:  # one word each; two copies differ by more than 20 %
            part[5 + i % 50] = f"edit{i}"
        rows.append((i, " ".join(text(80) + part + text(80))))
    got = [(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert set(smallest_reachable(range(120), got).values()) == {0}


def test_large_families_are_dealt_to_blocks(spark, monkeypatch):
    """The families of one task and those over pairs of blocks give the same classes; copies hang on the smallest id."""
    rng = np.random.default_rng(8)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    common = text(64)
    rows = [(i, " ".join(text(30) + common + text(30 + i % 5))) for i in range(200)]
    rows += [(300 + i, rows[i % 7][1].upper()) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (200_000, 4_000):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        got = [(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(df).collect()]
        assert set(smallest_reachable([i for i, _ in rows], got).values()) == {0}
        assert {p for p in got if p[0] >= 300} == {(300 + i, i % 7) for i in range(100)}


def test_a_concentrated_edit_hides_no_passage(spark):
    """Three words edited amid 67 leave 56 of 70 shingles, 80 %, but no stretch of 46 is that dense."""
    rng = np.random.default_rng(9)
    text = lambda n: [f"v{x}" for x in rng.integers(0, 10**8, n)]
    rows, links = [], set()
    for i in range(0, 100, 10):
        one, other = text(32), text(32)
        rows += [(i + k, " ".join(text(40) + one + text(3) + other + text(40))) for k in (1, 2)]
        links.add((i + 2, i + 1))
    assert {(r["doc_id"], r["other_id"]) for r in substring_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == links


@pytest.mark.parametrize("repeats", [False, True])
def test_windows_of_one_task_are_brute_force(monkeypatch, repeats):
    """The windows of a crowded group: all that a search of all pairs connects; without repeats hardly a search finds nothing."""
    rng = np.random.default_rng(10)
    reach, n = substring_dedup.LEAST - 1, 120
    base, parts = rng.integers(0, 2**32, 2 * reach + 1, np.uint32), []
    for k in range(n):
        x = base.copy()
        for at in rng.integers(0, 2 * reach - 4, 2 if k % 3 else 4):
            x[at : at + 5] = rng.integers(0, 2**32, 5, np.uint32)
        if repeats:
            x[rng.integers(0, reach - 9) :][:9] = rng.integers(0, 2**32, dtype=np.uint32)
        x[reach] = base[reach]
        parts.append(x)
    parts += parts[:30]  # twins in other documents
    searched = []
    search = substring_dedup._passages
    monkeypatch.setattr(substring_dedup, "_passages", lambda *a: searched.append(search(*a)) or searched[-1])
    label = np.concatenate([np.arange(n), np.arange(30)])
    doc, zero = np.arange(len(parts)) + 1, np.zeros(len(parts), np.int64)
    found = substring_dedup._task_links(zero, label, doc, zero + reach, zero + reach, zero, parts)
    empty, calls = sum(not x for x in searched), len(searched)
    monkeypatch.setattr(substring_dedup, "_passages", search)
    links = [(b + 1, a + 1) for a, b in itertools.combinations(range(n), 2) if substring_dedup.passages(parts[a], parts[b])]
    twins = [(n + k + 1, k + 1) for k in range(30)]
    assert len(links) >= 10 and not unconnected(links, [(r[0], r[3]) for r in found] + twins)
    assert repeats or empty <= 0.1 * calls and calls < n  # before, pairs without a link were searched too


def test_windows_with_one_run_get_one_link_each():
    """Windows over two runs of a shingle, between words of their own: before, each pair gave its links."""
    rng = np.random.default_rng(11)
    own = lambda n: rng.integers(1, 2**32, n, np.uint32)
    run, n = np.zeros(substring_dedup.LEAST + 4, np.uint32), 40
    parts = [np.concatenate([own(30), run, own(20), run, own(30)]) for _ in range(n)]
    zero, doc = np.zeros(n, np.int64), np.arange(n) + 1
    found = substring_dedup._task_links(zero, np.arange(n), doc, zero + 30, zero + 2 * len(run) + 49, zero, parts)
    assert sorted((r[0], r[3]) for r in found) == [(i, 1) for i in range(2, n + 1)]
    assert {(r[1], r[2]) for r in found} <= {(30, 30 + len(run) + 4), (50 + len(run), 50 + 2 * len(run) + 4)}


@pytest.mark.parametrize("matches", [1, 10**9])
def test_best_links_are_brute_force(monkeypatch, matches):
    """Matches of repeated lines: those of a place linked at once, or one by one, as a search of all earlier ones links them."""
    monkeypatch.setattr(substring_dedup, "DENSE_MATCHES", matches)
    rng = np.random.default_rng(12)
    for n in (2, 7, 40):
        a, b = (np.concatenate([np.arange(9)[rng.integers(0, 5) :] for _ in range(n)]) for _ in range(2))
        p, q = substring_dedup._matches(a[:120], b[:120])
        score, link = substring_dedup._best_links(p, q, 80)
        want: list[tuple[int, int]] = []
        for i in range(len(p)):
            ends = [(want[k][0] + 80 * int(p[k] + q[k]), k) for k in range(i) if p[k] < p[i] and q[k] < q[i]]
            top, k = max(ends, default=(0, -1))
            want.append((180 + max(0, top - 80 * int(p[i] + q[i])), k))
        assert list(zip(score.tolist(), link.tolist(), strict=True)) == want


def test_least_share_is_brute_force(monkeypatch):
    rng, least = np.random.default_rng(13), substring_dedup.LEAST
    for at_once in (1, 1 << 19):
        monkeypatch.setattr(substring_dedup, "AT_ONCE", at_once)
        for width in (least - 1, least, least + 7, 2 * least - 1, 3 * least):
            hit = rng.random((5, width)) < rng.random((5, 1))
            best = [max((h[x:y].mean() for x in range(width) for y in range(x + least, width + 1)), default=0) for h in hit]
            assert np.allclose(1 / substring_dedup._least_share(hit), np.maximum(best, 1e-9))


def test_shingles_around_windows_are_cut_once(spark):
    """Before, the surroundings of all windows were cut and sent twice, for frequent values and for others."""
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 70))) for i in range(3)], "doc_id long, text string")
    plan = substring_dedup.shared_passages(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_surroundings(") == 1


def test_passages_beside_denser_edits():
    rng = np.random.default_rng(3)
    shingles = lambda w: np.lib.stride_tricks.sliding_window_view(np.array(w, np.uint64), 5) @ np.array([1, 10**3, 10**6, 10**9, 10**12], np.uint64)
    words = rng.permutation(900)[:300]
    edited = words.copy()
    at = [i for i in range(6, 300, 12) if not 100 <= i < 170] + [135]
    edited[at] = 900 + np.arange(len(at))
    (u, v, x, y), = substring_dedup.passages(shingles(words), shingles(edited))
    assert u <= 100 and v >= 165 and x <= 100 and y >= 165
    # parts of the passage occur before it too, and a second, more edited part follows a found one
    one, two = words[:80], words[100:170]
    other = np.concatenate([one[20:40], one, edited[170:250], two[:30], edited[:1], two[31:]])
    found = substring_dedup.passages(shingles(np.concatenate([one, words[170:250], two])), shingles(other))
    assert any(u <= 5 and v >= 70 for u, v, _, _ in found) and any(u <= 165 and v >= 220 for u, v, _, _ in found)


# ---- urls

def test_url_rules_and_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    rows = [
        (1, "https://A.Example.ORG/es/1#x", canonical("http://b.net/x")), (2, "http://b.net/x?utm_source=1", None), (3, None, None), (4, "nohost", ""),
        (5, "https://c.com/de/", '<meta http-equiv="refresh" content="0; url=/zz">'), (6, "https://c.com/zz", None), (7, "https://www.c.com/zz/", None), (8, "https://example.org/en/12", None),
        (9, "http://org/x", None), (10, "http://e.net", canonical("https://c.com/zz")), (11, "http://e.net", None), (12, "http://f.net/a", canonical("http://example.org/fr")), (13, "http://f.net/a", canonical("https://c.com/de/9")),
    ]
    for limit in (500, 0):  # rules in the plan, rules joined
        url_filter.LITERAL_RULES = limit
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
        assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("b.net", "/x", None, "block")
        assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
        assert got[5][3] == "block" and got[6][3] == "block" and got[7][3] == "block" and got[10][3] == "block" and got[11][3] == "block"
        assert got[8] == ("example.org", "/en/12", "example.org/en/1", "block") and got[9] == ("org", "/x", "org/", "allow")
        assert got[12][3] == "allow" and got[13][3] == "allow"  # an allowed alias goes before a blocked one
    url_filter.LITERAL_RULES = 500
    none = spark.createDataFrame([], "page_id long, url string, html string, host string")
    assert url_filter.judge_urls(none, queries.URL_RULES).count() == 0


def test_relative_links_and_either_order_of_refresh(spark):
    rows = [("http://a.com/x/y.html", '<link rel="canonical" href="page.html">'), ("http://a.com/x/y", '<meta content="0;url=../z?q=1" http-equiv=refresh>'), ("http://a.com", '<meta http-equiv="refresh" content="0; url=z">'), ("http://a.com/", '<link rel=canonical href="mailto:x">')]
    got = spark.createDataFrame(rows, "url string, html string").select(url_filter.link_targets(F.col("url"), F.col("html")).alias("t")).collect()
    assert [r["t"] for r in got] == [["http://a.com/x/page.html"], ["http://a.com/z?q=1"], ["http://a.com/z"], []]
