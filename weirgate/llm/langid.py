"""Language identification of words, spans and documents.

Each word's letters name its script; scripts narrow the candidate languages to those that use them in the
training texts. A word's score under a language is the log-likelihood of its letter trigrams. Viterbi over
the words of a text, with a penalty for switching, labels spans of mixed-language texts; a document's language
is the one that labels most of its letters, its score the share of letters so labelled.

Training counts trigrams in parallel; the model is a table of BUCKETS rows by language, broadcast. It is
fitted on a sample of at most about max_docs labelled documents, chosen by a hash of the id. Prediction is one
pass over the texts without a shuffle.

Edge cases: a text that is null or has no letters is `und` with score 0. Languages that are null teach
nothing; without any labelled text everything is `und`. Very long texts are labelled whole, in time linear in
their words, in memory of one score a word and language. Repeated rows are judged alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SWITCH = 6.0  # log-probability a change of language costs
SCRIPT_SHARE = 0.001  # a language uses a script that has this share of its letters
CHUNK = 1 << 24  # letters times languages of the texts that are labelled together; a longer text is labelled alone

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x3134F)],
}


@cache
def letter_scripts() -> np.ndarray:
    """Code point -> 0 for no letter, 1 for a letter of another script, else the script's number from 2."""
    table = np.zeros(0x110000, np.uint8)
    table[[i for i in range(0x32000) if chr(i).isalpha()]] = 1
    for n, ranges in enumerate(SCRIPTS.values(), 2):
        for lo, hi in ranges:
            part = table[lo : hi + 1]
            part[part > 0] = n
    return table


@dataclass
class Letters:
    """The letters of some texts: buckets of their trigrams, the words they form, the words' first index by text."""

    buckets: np.ndarray
    script: np.ndarray
    starts: np.ndarray
    first: np.ndarray


def letters(texts: list[str]) -> Letters:
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) + 1 for p in points])
    flat = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.uint32)  # a zero before, between and after texts
    at = 1
    for p in points:
        flat[at : at + len(p)] = p
        at += len(p) + 1
    script = letter_scripts()[flat]
    inside = script > 0
    code = np.where(inside, flat, 0).astype(np.uint64)
    where = np.flatnonzero(inside)
    h = code[where - 1] * np.uint64(0x9E3779B97F4A7C15) + code[where] * np.uint64(0xC2B2AE3D27D4EB4F) + code[where + 1] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.flatnonzero(~inside[where - 1])
    first = np.searchsorted(where[starts], np.concatenate([[0], ends])) if len(ends) else np.zeros(1, np.int64)
    return Letters((h >> np.uint64(64 - 15)).astype(np.int32), script[where], starts, first)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages, log-probabilities
    uses: np.ndarray  # scripts x languages, whether the language uses the script


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            got = letters([text.as_py() or ""])
            mine = tally.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
            mine += np.bincount(got.buckets, minlength=BUCKETS + 256)
            mine[BUCKETS:] += np.bincount(got.script, minlength=256)
    for lang, n in tally.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, max_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows of docs with a language, from about max_docs of them at most."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    n = rows.select("lang").count()
    share = min(1.0, max_docs / max(1, n))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20))).select("lang", "text")
    got = sample.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 256 rows a language at most
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + 256, len(names)))
    column = {x: i for i, x in enumerate(names)}
    counts[got.column("bucket").to_numpy(), [column[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(names, scores, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)))


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word (row of scores) in each text, all texts stepping together."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    base, lengths = first[:-1][order], lengths[order]
    kind = np.min_scalar_type(max(0, scores.shape[1] - 1))  # wide enough for the number of languages
    labels = np.zeros(len(scores), kind)
    if not len(scores):
        return labels
    came = np.empty(scores.shape, kind)
    own = np.arange(scores.shape[1], dtype=kind)[None, :]
    now = np.zeros((len(order), scores.shape[1]), np.float32)
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
    for t, k in enumerate(active.tolist()):
        v, at = now[:k], base[:k] + t
        best = v.argmax(axis=1)
        top = v[np.arange(k), best][:, None]
        switched = v < top - penalty
        came[at] = np.where(switched, best[:, None].astype(kind), own)
        v[:] = np.where(switched, top - penalty, v) - top + scores[at]
    state = now.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = int(active[t])
        at = base[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return labels


def predict(docs: DataFrame, model: Model, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score and, if asked, spans (words from, to and lang; words are runs of letters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            n = len(texts)
            found_labels, sizes, firsts, total, lo = [], [], [np.zeros(1, np.int64)], 0, 0
            while lo < n:  # texts are read and labelled in chunks; only a label a word stays
                hi, size, part = lo, 0, []
                while hi < n and (hi == lo or size * max(4, len(m.languages)) < CHUNK):
                    part.append(texts[hi].as_py() or "")
                    size += len(part[-1])
                    hi += 1
                got = letters(part)
                labels = np.zeros(len(got.starts), np.uint8)
                if len(got.starts) and m.languages:
                    word = np.add.reduceat(m.scores[got.buckets], got.starts, axis=0)
                    may = m.uses[got.script[got.starts]]
                    may = may | ~may.any(axis=1, keepdims=True)  # a script no language uses narrows nothing
                    word[~may] -= np.float32(1e4)
                    labels = viterbi(word, got.first)
                found_labels.append(labels)
                sizes.append(np.diff(np.append(got.starts, len(got.buckets))))
                firsts.append(got.first[1:] + total)
                total += len(got.starts)
                lo = hi
            first, size = np.concatenate(firsts), np.concatenate(sizes) if sizes else np.empty(0, np.int64)
            known = len(m.languages)
            labels = np.concatenate(found_labels) if found_labels else np.zeros(0, np.uint8)
            of = np.repeat(np.arange(n), np.diff(first))
            share = np.bincount(of * max(1, known) + labels, weights=size, minlength=n * max(1, known)).reshape(n, -1)
            best, letters_in = share.argmax(axis=1), share.sum(axis=1)
            found = (letters_in > 0) & (known > 0)
            name = np.array([*m.languages, "und"], object)[np.where(found, best, known)]
            score = np.where(found, share.max(axis=1) / np.maximum(1, letters_in), 0.0)
            arrays = [batch.column(0), pa.array(name, pa.string()), pa.array(score)]
            if with_spans:
                spans = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    cut = [a, *(np.flatnonzero(np.diff(labels[a:b])) + a + 1).tolist(), b] if b > a and known else []
                    spans.append([{"from": x - a, "to": y - a, "lang": m.languages[labels[x]]} for x, y in zip(cut[:-1], cut[1:], strict=True)])
                arrays.append(pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "spans"][: len(arrays)])

    fields = "doc_id long, lang_pred string, score double" + ", spans array<struct<from:int,to:int,lang:string>>" * with_spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(over, fields)


def fold(id_col: Column, folds: int) -> Column:
    """The fold of an id: crc32 of its text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
