"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Documents are tokenized, ended by one id, and only those longer than a sequence are cut. The pieces are
dealt to groups by a hash of their id; each group packs its pieces best-fit in falling order of length
and emits nearly full bins. Its underfull bins are items of the next level, where the groups of one branch
of a tree are packed again, until one group is left. No task grows with the input, and no sequence is lost by that:
best-fit leaves one bin of a group at most that is not over half full, and two bins only fit together if one of them
is not. So on each level above, a group meets FAN_IN such bins at most, and each of them spares one sequence by going
into one other bin. A group therefore passes on its FAN_IN emptiest bins for each of the LEVELS levels a tree can
have; the others could not spare a sequence, and are emitted as they are.

Only lengths travel: token ids stay with the pieces, which a caller joins to their places. Sequence numbers
follow from the ids and lengths alone, so recomputed tasks agree.

Edge cases: a null or empty text is a document of the end id alone. Very long texts are cut into full
pieces. Repeated rows (and the copies a mix makes) are packed as documents of their own. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import materialize

GROUP = 2048  # pieces of a group of the first level
FAN_IN = 16
NEARLY_FULL = 0.995
LEVELS = 16  # 2048 * 16^16 pieces, beyond any input
PASS_ON = FAN_IN * LEVELS
CACHE_WORDS = 350_000  # words of a generation of the cache

_FIELDS = "group long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long, done boolean"

#: Fixed value: the split pattern of the vocabulary file, as written there.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts in these characters (no numbers but 0-9, no marks) are lower-cased and split here; others by the tokenizer itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E\u00A1-\u00B1\u00B4-\u00B8\u00BA\u00BB\u00BF-\u017F]*")
#: _SPLIT for them: the alternatives begin with different characters, so the commonest may come first.
_WORDS = re.compile(r"[a-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sA-Za-z0-9\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+")


class _Words(dict):
    """Word -> number; the ids of numbered words lie in one array. When it is full, the words in use move to a new generation."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(keep)]
        self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}  # bytes as the byte-level vocabulary spells them
        self.old: dict[str, np.ndarray] = {}
        self.begin()

    def begin(self):
        """A new generation; the last one is kept beside it."""
        self.old = {w: self.flat[self.starts[n] : self.starts[n] + self.lengths[n]] for w, n in self.items()}
        self.clear()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def __missing__(self, word: str) -> int:
        ids = self.old.get(word)
        if ids is None:
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]
        n = len(self)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        if n >= len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n], self.lengths[n] = self.used, len(ids)
        self.used += len(ids)
        self[word] = n
        return n


class TokenStream:
    """Token ids of texts, the same as the tokenizer's own, with a bounded cache of words for vocabularies split by _SPLIT."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_words = _SPLIT.replace("\\", "\\\\") in spec and '"NFC"' in spec and '"Lowercase"' in spec and '"ByteLevel"' in spec
        self.words = _Words(self.tokenizer) if self.by_words else None
        self.split = _WORDS.findall

    def ids(self, text: str) -> np.ndarray:
        if self.by_words and _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text) and "İ" not in text:
            if len(self.words) > CACHE_WORDS:
                self.words.begin()
            found = self.split(text.lower())
            at = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
            lengths = self.words.lengths[at]
            total = int(lengths.sum())
            return self.words.flat[np.repeat(self.words.starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def _stream(spec: str) -> TokenStream:
    return TokenStream(spec)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, seq_len: int, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, ids (array of int)."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())  # one vocabulary file, a few MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _stream(spec.value)
        for batch in batches:
            rows: list[tuple] = []
            payload: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(stream.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), seq_len)):
                    part = ids[start : start + seq_len]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        payload.append(part.astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(payload, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, fields)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each item, and the fill of each bin; items are taken in the given order."""
    bins, places, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    free: list[int] = []  # spaces that some bin has, in order
    for i, n in enumerate(lengths.tolist()):
        k = bisect.bisect_left(free, n)
        if k < len(free):
            space = free[k]
            b = waiting[space].pop()
            if not waiting[space]:
                free.pop(k)
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], places[i] = b, fills[b]
        fills[b] += n
        space -= n
        if space:
            if not waiting[space]:
                bisect.insort(free, space)
            waiting[space].append(b)
    return bins, places, np.array(fills, np.int64)


def _level(depth: int, capacity: int, last: bool):
    def over(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["group"].iloc[0])
        if depth == 0:
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
            item, sizes = np.arange(len(rows)), rows["length"].to_numpy(np.int64)
        else:
            rows = rows.sort_values(["fill", "bin", "at"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            ids, first, item = np.unique(rows["bin"].to_numpy(np.int64), return_index=True, return_inverse=True)
            order = np.argsort(first)  # items in falling order of fill
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            item, sizes = rank[item], rows["fill"].to_numpy(np.int64)[np.sort(first)]
        bins, places, fills = best_fit(sizes, capacity)
        open_bins = np.flatnonzero(fills < NEARLY_FULL * capacity)
        open_bins = open_bins[np.argsort(fills[open_bins], kind="stable")][:PASS_ON]
        done = np.ones(len(fills), bool)
        if not last:
            done[open_bins] = False
        rows["at"] = rows["at"].to_numpy(np.int64) + places[item]
        rows["bin"] = (depth << 58) + (group << 24) + bins[item]
        rows["fill"], rows["done"] = fills[bins[item]], done[bins[item]]
        rows["group"] = group // FAN_IN
        return rows[["group", "doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill", "done"]]

    return over


def pack(pieces: DataFrame, seq_len: int) -> DataFrame:
    """Places of pieces (doc_id, piece, start, length, ids_crc32): with sequence_id and offset."""
    pieces = materialize(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pack-pieces")
    groups = max(1, math.ceil(pieces.count() / GROUP))
    level = pieces.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("group"), "*", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("fill"), F.lit(False).alias("done"))
    out, depth = None, 0
    while True:
        last = groups == 1
        packed = materialize(level.groupBy("group").applyInPandas(_level(depth, seq_len, last), _FIELDS), "pack-level")
        out = packed.where("done") if out is None else out.unionByName(packed.where("done"))
        if last:
            break
        level, groups, depth = packed.where("NOT done"), math.ceil(groups / FAN_IN), depth + 1
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, seq_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack docs: one row per piece with its place."""
    return pack(tokenize_pieces(docs, tokenizer_path, end_id, seq_len, False, id_col, text_col), seq_len)


def sequences(docs: DataFrame, tokenizer_path: str, end_id: int = 1, seq_len: int = 4096) -> DataFrame:
    """The packed sequences: sequence_id and ids (array of int), pieces in order of offset."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, end_id, seq_len), "pack-ids")
    placed = pack(pieces, seq_len).select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").dropDuplicates(["sequence_id", "offset"])
    numbered = lambda df, order: df.withColumn("copy", F.row_number().over(_by(order)))
    joined = numbered(placed, ["sequence_id", "offset"]).join(numbered(pieces.drop("start", "length"), ["ids_crc32"]), ["doc_id", "piece", "ids_crc32", "copy"])
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def _by(order):
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "piece", "ids_crc32").orderBy(*order)
