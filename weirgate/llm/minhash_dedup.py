"""Near-dedup: many universal hash minima with banding, verification on full sets, connected components.

1. One pass over the texts gives each document its set of word shingles (A-Z lower-cased), the digest of
   that set, and ROWS * BANDS minima under universal hashes, folded to one key per band. A pair at the
   threshold shares a band with probability over 0.99999.
2. Documents with equal sets are one class, represented by the smallest id: exact copies, however many,
   go on as one row.
3. Each member of a band's bucket is linked to the bucket's smallest id, never to all others. The connected
   components of these links are families: a superset of what can be linked by shared bands.
4. A family is verified on full sets: all its pairs are considered in memory, in blocks of BLOCK documents,
   most likely pairs first, skipping pairs that confirmed links already connect; only a forest of confirmed
   links leaves the block. Families are binned to tasks by hash; a family larger than a block is dealt to
   pairs of blocks. So no link between different sets is lost, also inside hot buckets.
5. Connected components of the confirmed links, by alternating large-star and small-star.

Edge cases: a text with fewer words than a shingle is one shingle; without words (or null) its set is empty
and links with nothing. A null id links nothing. Repeated rows share a class. An empty table gives an empty
result. Other columns of the input are ignored, or kept by drop_near_duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import fresh_name, join_counted, materialize, mix, shingle_hashes, text_chunks, word_bounds, word_hashes
from weirgate.llm.components import components

ROWS, BANDS = 6, 42
BLOCK = 512
BIN = 400  # documents of small families in a task's bin, about
MOST_IDS = 2_000_000  # ids of documents in families that are broadcast at most, about 80 MB
MARGIN = 0.15  # pairs whose minima agree this much less than the threshold are not verified: over 5 standard deviations

_A = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, ROWS * BANDS + 1001, dtype=np.uint64)).astype(np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash x -> a x + b mod 2^32, a odd."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(out, (x[None, lo : lo + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(texts):
        starts, ends, first = word_bounds(data, offsets)
        for s in shingle_hashes(word_hashes(data, starts, ends), first, k):
            yield np.unique(s)


def _signed(k: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys, lengths = [], [], [], []
            for s in _sets(batch.column(1), k):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    keys.append(band_keys(minima(s)))
                lengths.append(BANDS if len(s) else 0)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), bands], ["doc_id", "n_shingles", "digest", "bands"])

    return over


def _verify(k: int, percent: int):
    """Confirms the pairs of one task's families on full sets; a forest of links."""

    def links(sets: list[np.ndarray], sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        parent = list(range(len(sets)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        sizes = np.array([len(s) for s in sets])
        found, a_all, b_all, score_all = [], [], [], []
        same = len(left) == len(right) and bool(np.all(left == right))
        for i, a in enumerate(left.tolist()):
            others = right[i + 1 :] if same else right
            if not len(others):
                continue
            ok = (100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])) & (others != a)
            others = others[ok]
            score = (sigs[others] == sigs[a]).mean(axis=1)
            close = score >= percent / 100 - MARGIN
            a_all.append(np.full(int(close.sum()), a))
            b_all.append(others[close])
            score_all.append(score[close])
        if not a_all:
            return found
        a_all, b_all, score_all = map(np.concatenate, (a_all, b_all, score_all))
        for p in np.argsort(-score_all, kind="stable").tolist():
            a, b = int(a_all[p]), int(b_all[p])
            x, y = top(a), top(b)
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[x] = y
                found.append((a, b))
        return found

    def over(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["family", "block", "doc_id"]).reset_index(drop=True)
        sets = list(_sets(pa.array(rows["text"], pa.string()), k))
        sigs = np.array([minima(s) & np.uint32(0xFFFF) for s in sets], np.uint16).reshape(len(sets), -1)
        ids, family, block = (rows[c].to_numpy() for c in ("doc_id", "family", "block"))
        out: list[tuple[int, int]] = []
        edges = np.concatenate([[0], np.flatnonzero(np.diff(family)) + 1, [len(rows)]])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            at = np.arange(lo, hi)
            left, right = at[block[lo:hi] == block[lo]], at[block[lo:hi] == block[hi - 1]]
            local = links(sets[lo:hi], sigs[lo:hi], left - lo, right - lo)
            out += [(int(ids[lo + a]), int(ids[lo + b])) for a, b in local]
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return over


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    percent = round(100 * threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(texts.mapInArrow(_signed(k), "doc_id long, n_shingles long, digest binary, bands array<long>"), "minhash")
    classes = materialize(signed.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "minhash-classes")
    banded = materialize(signed.select("doc_id", "digest", "bands").join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("of")), "doc_id").where("digest = of").select("doc_id", F.explode("bands").alias("band")), "minhash-bands")
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other"), F.count("*").alias("members")).where("lead != other").drop("other")
    stars = join_counted(banded, shared, "band", "members", banded.count()).where("doc_id != lead").select(F.col("doc_id").alias("src"), F.col("lead").alias("dst"))
    families = materialize(components(stars).withColumnRenamed("component", "family"), "minhash-families")
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    total = families.count()
    bins = max(1, total // BIN)
    # the blocks of a family: members are dealt by a hash of their id, each pair of blocks meets once
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    member = families.join(sizes, "family").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # only texts of families travel; where the ids are too many for a broadcast, all texts are shuffled
    wanted = texts.join(F.broadcast(families.select("node")), F.col("doc_id") == F.col("node"), "left_semi") if total <= MOST_IDS else texts
    with_text = wanted.join(member, F.col("doc_id") == F.col("node"))
    meets = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = with_text.withColumn("meet", F.explode(meets)).withColumn(
        "task", F.when(F.col("blocks") == 1, F.concat(F.lit("bin"), F.pmod(F.xxhash64("family"), F.lit(bins)))).otherwise(F.concat_ws("-", F.col("family"), F.least("block", "meet"), F.greatest("block", "meet")))
    )
    links = dealt.select("task", "family", "block", "doc_id", "text").groupBy("task").applyInPandas(_verify(k, percent), "src long, dst long")
    found = components(links)
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rows", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "digest")
    # texts without words have no digest and no class; a digest of very many copies is joined by a broadcast
    out = join_counted(rows.where("digest IS NOT NULL"), named, "digest", "rows", signed.count(), "left")
    out = out.unionByName(rows.where("digest IS NULL").withColumns({"rows": F.lit(None).cast("long"), "component": F.lit(None).cast("long")}))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one document of each component, with all columns."""
    name = fresh_name("id")
    kept = near_duplicates(docs, k, threshold, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
