"""Toxicity scores of deobfuscated texts.

Noisy channel: a token of any length that mixes letters with digits or symbols, repeats a letter three times or more, or is
spelled in single spaced letters becomes a lattice: each character stands for itself, for the letters it is
used for in leetspeak, or for nothing (separators, and repeats of the letter before). Viterbi finds the reading
with the best product of channel and character language model, a trigram model counted over all texts. Spaced
letters are read as one word and with word breaks, within their document. The words of the readings join the words of the text, and a logistic model over words and word beginnings scores
them; a feature found almost only in toxic documents also gives a score by itself, and the larger counts.

The model is learned from a sample of at most about max_docs labelled documents (a hash of the id chooses them);
its FEATURES features are those most over-represented in toxic documents, counted in parallel; only their
presence in the sample reaches the driver, which fits the weights. Scoring is one pass without a shuffle.

Edge cases: a null or empty text has no features and gets the model's base score. Without labels of both kinds
every score is the share of toxic labels, or 0. Very long texts are read whole. Repeated rows are judged alike.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import materialize, mix, shingle_hashes, text_chunks, word_bounds, word_hashes

FEATURES = 2048
RATIO = 8  # how much likelier a feature must be in toxic documents
PREFIXES = (3, 4, 5, 6, 7)  # letters of word beginnings
CAUTION = 40  # toxic documents a feature must outnumber before it counts by itself
MIN_TOXIC = 3  # toxic documents of the sample in which a feature must be
LONGEST = 40  # characters of a token whose reading is remembered; longer ones are decoded each time
READINGS = 50_000  # readings a worker remembers

#: The alphabet of the character model: 0 is the edge of a word; a-z, then the lower-case letters of Latin-1.
LETTERS = [*map(chr, range(ord("a"), ord("z") + 1)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_SIZE = 64

#: Letters that a sign is used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_DROPPED = set(".-_*~'`^·, ")
KEEP, SWAP, DROP, REPEAT, STRAY, BREAK = 0.0, -1.0, -0.5, -0.3, -8.0, -1.0  # log-probabilities of the channel, up to a constant

_STRIPPED = ".,;:?\"'()[]{}<>#%&=/"
_SIGNS = {c.encode() for c in {*LEET, *_DROPPED} - {" "}}
_WIDE_SIGNS = sorted(c for c in _SIGNS if len(c) > 1)
_SIGN = np.zeros(256, bool)
_SIGN[[c[0] for c in _SIGNS if len(c) == 1]] = True
_AT_EDGE = np.zeros(256, bool)
_AT_EDGE[[ord(c) for c in _STRIPPED]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xC4), *range(0x80, 0xC0)]] = True


@dataclass
class CharModel:
    """Log-probabilities of a letter after two others."""

    logp: np.ndarray
    readings: dict[str, str] = field(default_factory=dict)

    def __getstate__(self):
        return {"logp": self.logp, "readings": {}}

    def read(self, token: str, spaced: bool = False) -> str:
        """The most likely plain reading of a token; of spaced letters, with spaces where words end."""
        if len(token) > LONGEST:
            return self._decode(token, spaced)
        key = " " + token if spaced else token
        got = self.readings.get(key)
        if got is None:
            if len(self.readings) > READINGS:
                self.readings.clear()
            got = self.readings[key] = self._decode(token, spaced)
        return got

    def _decode(self, token: str, spaced: bool) -> str:
        # a text is its last letter and the text before it
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        logp = self.logp
        for c in token:
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            choices = [(_CODE[c], c, KEEP)] if c in _CODE else [(_CODE[x], x, SWAP) for x in LEET.get(c, "")]
            for (a, b), (score, text) in states.items():
                for code, letter, cost in choices:
                    s = score + cost + logp[a, b, code]
                    key = (b, code)
                    if key not in nxt or s > nxt[key][0]:
                        nxt[key] = (s, (letter, text))
                drop = REPEAT if text and c == text[0] else DROP if c in _DROPPED else None if c in _CODE else STRAY
                if drop is not None and (s := score + drop) > nxt.get((a, b), (-math.inf, ""))[0]:
                    nxt[(a, b)] = (s, text)
            states = nxt or states
            if spaced:
                ended = max(((s + BREAK + logp[a, b, 0], (" ", t)) for (a, b), (s, t) in states.items() if b), key=lambda x: x[0], default=None)
                if ended and ended[0] > states.get((0, 0), (-math.inf, None))[0]:
                    states[(0, 0)] = ended
        text = max(((s + (logp[a, b, 0] if b or not spaced else 0.0), t) for (a, b), (s, t) in states.items()), key=lambda x: x[0], default=(0.0, None))[1]
        out = []
        while text:
            out.append(text[0])
            text = text[1]
        return "".join(reversed(out)).strip()


@dataclass
class Model:
    chars: CharModel
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    alone: np.ndarray  # the score that a feature gives by itself
    bias: float


_LETTER_CODES = np.zeros(0x110000, np.uint8)
for _c, _i in _CODE.items():
    _LETTER_CODES[ord(_c)] = _i


def char_model(texts: DataFrame) -> CharModel:
    """Counted over every text; at most 64^3 counts reach the driver."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weirgate.llm.toxicity import _LETTER_CODES as table

        n = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for _, _, data, _ in text_chunks(batch.column(0)):
                points = np.frombuffer(("  " + data.tobytes().decode("utf-8", "replace").lower()).encode("utf-32-le", "replace"), np.uint32)
                c = table[points].astype(np.int32)
                a, b, c = np.where(c[1:-1] == 0, 0, c[:-2]), c[1:-1], c[2:]
                n += np.bincount((a * _SIZE + b) * _SIZE + c, minlength=_SIZE**3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["gram", "n"])

    got = texts.mapInArrow(over, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(_SIZE**3)
    n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    n = n.reshape(_SIZE, _SIZE, _SIZE)
    n[0, 0, 0] = 0
    two = n.sum(axis=0)
    back = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * _SIZE)
    return CharModel(np.log((n + 5.0 * back[None]) / (n.sum(axis=2, keepdims=True) + 5.0)))


def _features(data: np.ndarray, offsets: np.ndarray, chars: CharModel) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word and word beginning in some texts, and in the readings of their odd tokens."""
    text = data.tobytes()
    rows, words = [], []
    starts, ends, first = word_bounds(data, offsets)
    if len(starts):
        letter, sign, edge_sign = _LETTER[data], _SIGN[data], _AT_EDGE[data]
        for c in _WIDE_SIGNS:
            at = np.flatnonzero(np.logical_and.reduce([data[k : len(data) - len(c) + 1 + k] == x for k, x in enumerate(c)]))
            for k in range(len(c)):
                sign[at + k], letter[at + k] = True, False
        odd = np.zeros(len(data) + 1, np.int32)
        odd[1:] += sign & ~edge_sign
        borders = offsets[1:-1, None]  # what spans two documents is no sign
        beside = np.zeros(len(data), bool)
        beside[:-1] = edge_sign[:-1] & ~edge_sign[1:] & ~_SPACE[data[1:]]
        low = np.where((data >= 65) & (data <= 90), data + 32, data)
        beside[:-2] |= letter[:-2] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
        crossing = (borders - np.arange(1, 3)).ravel()
        beside[crossing[crossing >= 0]] = False
        wide = np.where((data >= 0x80) & (data < 0xC0), data | 0x20, 0).astype(np.uint16)[1:] * (data[:-1] == 0xC3)  # the second byte of a Latin letter
        thrice = np.zeros(len(data), bool)
        thrice[:-5] = (wide[:-4] > 0) & (wide[:-4] == wide[2:-2]) & (wide[:-4] == wide[4:])
        crossing = (borders - np.arange(1, 6)).ravel()
        thrice[crossing[crossing >= 0]] = False
        odd[1:] += beside | thrice
        marks, letters = np.cumsum(odd), np.concatenate([[0], np.cumsum(letter)])
        length = ends - starts
        mark = (marks[ends] - marks[starts] > 0) & (letters[ends] - letters[starts] >= 2)
        single = (length == 1) | (length == 2) & (data[starts] >= 0xC2) | (length == 3) & (data[starts] == 0xE2)
        of = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        for i in np.flatnonzero(mark).tolist():
            token = text[starts[i] : ends[i]].decode("utf-8", "replace").lower().strip(_STRIPPED)
            if sum(c in _CODE for c in token) >= 2:
                rows.append(int(of[i]))
                words.append(chars.read(token))
        alone = np.flatnonzero(single)
        # runs end with their document
        for run in np.split(alone, np.flatnonzero((np.diff(alone) > 1) | (np.diff(of[alone]) > 0)) + 1) if len(alone) else []:
            if len(run) >= 4:
                a, b = run[0], run[-1]
                letters_of = "".join(text[starts[a] : ends[b]].decode("utf-8", "replace").lower().split())
                for reading in {chars.read(letters_of), chars.read(letters_of, spaced=True)}:
                    rows.append(int(of[a]))
                    words.append(reading)
    extra = " ".join(words).encode()
    first_extra = len(text) + 1
    joined = (text + b"\n" + extra).decode("utf-8", "replace").lower()
    raw = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else None
    points = raw.astype(np.uint32) if raw is not None else np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    inside = (points >= 97) & (points <= 122) | (points >= 0xC0)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(s):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # rows: by character offsets of the texts, then of the readings
    if raw is not None and len(raw) == first_extra + len(extra):
        bounds = offsets[1:]
        extra_at = first_extra
    else:
        lengths = [len(text[a:b].decode("utf-8", "replace").lower()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        bounds = np.cumsum(lengths)
        extra_at = int(bounds[-1]) + 1 if len(lengths) else 1
    row = np.searchsorted(bounds, s, "right")
    if rows:
        place = np.cumsum([0, *(len(w) + 1 for w in words[:-1])]) + extra_at
        late = s >= extra_at
        row[late] = np.array(rows)[np.searchsorted(place, s[late], "right") - 1]
    n = e - s
    code = points.astype(np.uint64)
    h = np.zeros(len(s), np.uint64)
    out_rows, out = [], []
    for j in range(max(PREFIXES)):
        live = n > j
        h[live] += code[s[live] + j] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & (2**64 - 1))
        if j + 1 in PREFIXES:
            out_rows.append(row[live])
            out.append(mix(h[live] + np.uint64(j + 1)))
    inside_at = np.flatnonzero(inside)
    begin = np.cumsum(n) - n
    at = np.arange(len(inside_at)) - np.repeat(begin, n)
    whole = np.add.reduceat(code[inside_at] * mix((at + 17).astype(np.uint64)), begin)
    out_rows.append(row)
    out.append(mix(whole + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(out_rows), np.concatenate(out)


def _distinct(data: np.ndarray, offsets: np.ndarray, chars: CharModel, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature); with wanted, only those, as positions in it."""
    row, feature = _features(data, offsets, chars)
    if wanted is not None:
        if not len(wanted):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        seen = np.zeros(1 << 18, bool)
        seen[wanted >> np.uint64(46)] = True
        maybe = seen[feature >> np.uint64(46)]
        row, feature = row[maybe], feature[maybe]
        at = np.minimum(np.searchsorted(wanted, feature), len(wanted) - 1)
        hit = wanted[at] == feature
        row, feature = row[hit], at[hit]
    if not len(row):
        return row, feature
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    return row[new], feature[new]


def _least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds one hash minimum over the 5-word shingles of each text; near copies mostly share it."""
    for batch in batches:
        least: list[int] = []
        for _, _, data, offsets in text_chunks(batch.column(1)):
            starts, ends, first = word_bounds(data, offsets)
            least += [int(x.min()) >> 1 if len(x) else 0 for x in shingle_hashes(word_hashes(data, starts, ends), first, 5)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["toxic", "text", "least"])


def _count_features(model, wanted):
    """Documents in which each feature is."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_distinct(data, offsets, model.value, wanted)[1] for _, _, data, offsets in text_chunks(batch.column(0))]
            f, n = np.unique(np.concatenate(got) if got else np.empty(0, np.uint64), return_counts=True)
            if wanted is not None:
                f = wanted[f.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n"])

    return over


def _logistic(rows: list[np.ndarray], y: np.ndarray, width: int, l2: float = 1e-4, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """L2 logistic regression by adaptive gradient steps over all rows; rows hold the positions of the features present."""
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    prior = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = np.zeros(width + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[flat], len(rows)) + w[-1], -30, 30))) - y
        grad = np.append(np.bincount(flat, error[of], width) / len(rows) + l2 * w[:-1], error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labelled: DataFrame, max_docs: int = 15_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled (doc_id, toxic 0 or 1), of which about max_docs are used at most; the character model reads all docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = char_model(texts.select("text"))
    marked = labelled.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, max_docs / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64("of"), F.lit(1 << 20)) < round(share * (1 << 20)))
    # about max_docs rows: a bounded table; copies teach once, near copies seldom more
    drawn = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("toxic", "text").where("text IS NOT NULL")
    sample = materialize(drawn.mapInArrow(_least_shingle, "toxic int, text string, least long").dropDuplicates(["least", "toxic"]).select("text", "toxic"), "toxicity-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_rest = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_rest:
        base = math.log((n_toxic + 1e-9) / (n_rest + 1e-9)) if n_toxic or n_rest else -30.0
        return Model(chars, np.empty(0, np.uint64), np.empty(0), np.empty(0), min(max(base, -30.0), 30.0))
    shared = spark.sparkContext.broadcast(chars)
    toxic = sample.where("toxic = 1").select("text").mapInArrow(_count_features(shared, None), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TOXIC).orderBy(F.col("n").desc(), "feature").limit(16 * FEATURES).toArrow()
    name = toxic.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(name)
    name, in_toxic = name[order], toxic.column("n").to_numpy()[order]
    rest = sample.where("toxic = 0").select("text").mapInArrow(_count_features(shared, name), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    in_rest = np.zeros(len(name))
    in_rest[np.searchsorted(name, rest.column("feature").to_numpy().view(np.uint64))] = rest.column("n").to_numpy()
    p, q = in_toxic / n_toxic, in_rest / n_rest
    z = (p - q) / np.sqrt((in_toxic + in_rest + 1) / (n_toxic + n_rest) * (1 / n_toxic + 1 / n_rest))
    z[(in_toxic + 0.5) * (n_rest + 1) < RATIO * (in_rest + 0.5) * (n_toxic + 1)] = -np.inf
    order = np.argsort(-z, kind="stable")[:FEATURES]
    order = np.sort(order[z[order] > -np.inf])  # names stay sorted
    kept = name[order]
    alone = (in_toxic[order] / (in_toxic[order] + 3 * in_rest[order] + CAUTION)) ** 2  # a cautious share of toxic documents, squared

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[np.ndarray] = []
            for lo, hi, data, offsets in text_chunks(batch.column(0)):
                row, f = _distinct(data, offsets, shared.value, kept)
                lists += np.split(f.astype(np.int16), np.searchsorted(row, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in lists], pa.binary())], ["toxic", "found"])

    got = sample.mapInArrow(present, "toxic int, found binary").toArrow()  # about max_docs rows of feature numbers
    rows = [np.frombuffer(x, np.int16) for x in got.column("found").to_pylist()]
    w, b = _logistic(rows, got.column("toxic").to_numpy().astype(float), len(kept))
    return Model(chars, kept, w, alone, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                row, f = _distinct(data, offsets, m.chars, m.features)
                n = hi - lo
                total = np.bincount(row, m.weights[f], n) if len(f) else np.zeros(n)
                best = np.zeros(n)
                if len(f):
                    np.maximum.at(best, row, m.alone[f])
                out.append(np.maximum(best, 1 / (1 + np.exp(-np.clip(total + m.bias, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(over, "doc_id long, score double")


def restore(text: str, chars: CharModel) -> str:
    """A text with its odd tokens replaced by their most likely readings."""
    out, single = [], []

    def flush():
        if len(single) >= 4:
            out.append(chars.read("".join(single), spaced=True))
        else:
            out.extend(single)
        single.clear()

    for token in text.lower().split():
        if len(token) == 1:
            single.append(token)
            continue
        flush()
        odd = any(c in LEET or c in _DROPPED for c in token[:-1]) or any(a == b == c for a, b, c in zip(token, token[1:], token[2:], strict=False))
        out.append(chars.read(token) if odd and sum(c in _CODE for c in token) >= 2 else token)
    flush()
    return " ".join(out)
