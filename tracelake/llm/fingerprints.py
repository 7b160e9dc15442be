"""Document fingerprints: MinHash signatures of five-word shingles, and near-duplicate classes from their bands.

A signature holds the minima of PERMUTATIONS multiply-add hash functions over the shingles of the whole text, 16 bits
of each; equal texts have equal signatures and the share of equal places estimates the Jaccard similarity.

Defined results: null text counts as empty; a text without words has the all-ones signature, so two such texts are
alike with 1.0.  Ties in the document order are broken by text; null ids come first.  Repeated rows are kept; an
empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracelake.llm.shingles import chunks, hashed, utf8
from tracelake.sources.shared import cut, drop

PERMUTATIONS = 128
BANDS = 32
ALIKE = 0.75
#: Documents to a range of ids, and the most ranges; a range is streamed, not held.
RANGE_DOCS, MOST_RANGES = 1000, 4096
NO_ID = -(1 << 63)

_rng = np.random.default_rng(7)
_mul = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signatures(texts: list[str]) -> np.ndarray:
    """One row of 16-bit minima a text."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    data, ends = utf8(pa.array(texts, pa.large_string()))
    for i, _, part, stops in chunks(data, ends):
        h, n, _ = hashed(part, stops)
        full = np.flatnonzero(n)
        if not len(full):
            continue
        begins = (np.cumsum(n) - n)[full]
        buffer = np.empty_like(h)
        for k in range(PERMUTATIONS):
            np.multiply(h, _mul[k], out=buffer)
            np.add(buffer, _add[k], out=buffer)
            out[i + full, k] = ((np.minimum.reduceat(buffer, begins) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
    return out


def text_of(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _ranges(rows: DataFrame) -> list[int]:
    """Bounds that cut the ids into ranges of about RANGE_DOCS documents; at most MOST_RANGES numbers reach the driver."""
    n = rows.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_DOCS))
    asked = [i / parts for i in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("ord", asked, max(10_000, 20 * parts)).alias("q")).first().q if asked else []
    return sorted(set(bounds or []))


def with_next(docs: DataFrame, classes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, ord, doc_id, text, class_id): each range of ids in order, followed by the first document of the
    next range.  The class of an id, from classes (v, component), is a row without text that precedes its documents."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = _ranges(rows)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), "right").astype(np.int32))

    least = sorted((r.bucket, r.least) for r in rows.select("ord").withColumn("bucket", bucket("ord")).groupBy("bucket").agg(F.min("ord").alias("least")).collect())
    before = {low: least[i - 1][0] for i, (_, low) in enumerate(least)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(np.int64), "right")
        return pd.Series([[b, -1 - before[x]] if x in before else [b] for x, b in zip(ids.tolist(), own.tolist(), strict=True)])

    dealt = rows.withColumn("place", F.explode(places("ord"))).select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), (F.col("place") < 0).alias("guest"), "ord", "doc_id", "text", F.lit(None).cast("long").alias("class_id"))
    told = classes.select(bucket("v").alias("bucket"), F.lit(False).alias("guest"), F.col("v").alias("ord"), F.col("v").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("component").alias("class_id"))
    return dealt.unionByName(told).repartition(max(1, len(least)), "bucket").sortWithinPartitions("bucket", "guest", "ord", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def made(rows: list[tuple[int | None, str, int | None]], following: str) -> pa.RecordBatch:
        texts = [t for _, t, _ in rows] + [following]
        own = signatures(texts)
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
        new = signatures(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _, _ in rows], pa.int64()),
            pa.array([len(t) for _, t, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([text_of(s) for s in own[:-1]], pa.string()),
            pa.array([text_of(s) for s in new], pa.string()),
            pa.array((own[:-1] == new).mean(axis=1), pa.float64()),
            pa.array((own[:-1] == own[1:]).mean(axis=1), pa.float64()),
            pa.array([c for _, _, c in rows], pa.int64()),
        ], names)

    held: list[tuple[int | None, str, int | None]] = []
    size, bucket, closed, told = 0, None, False, (None, None)
    for batch in batches:
        for b, guest, i, t, c in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text", "class_id")), strict=True):
            if t is None:
                told = (i, c)
                continue
            if b != bucket:
                bucket, closed = b, False
            if closed:
                continue
            if guest or size > 1 << 20:
                if held:
                    yield made(held, t)
                held, size, closed = [], 0, guest
            if not guest:
                held.append((i, t, told[1] if i is not None and told[0] == i else i))
                size += len(t)


def fingerprint(docs: DataFrame) -> DataFrame:
    """SCHEMA for each row: its fingerprint, that of its edited text (the last half replaced by the start of the next
    document by ascending id, the first after the last), the likeness of each to the other and to the next one's, and the
    class of its near copies (near_duplicates)."""
    return with_next(docs, classes(docs).where("v <> component")).mapInArrow(_fingerprints, SCHEMA)


def signed(docs: DataFrame) -> DataFrame:
    """(node, digest, signature) of each row with an id and a word: 128 bits of hash of its text, and its signature."""
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("node"), "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = signatures(texts)
            full = np.flatnonzero((s != 0xFFFF).any(axis=1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(full)), pa.array([hashlib.blake2b(texts[i].encode(), digest_size=16).digest() for i in full], pa.binary()),
                pa.array([s[i].astype(">u2").tobytes() for i in full], pa.binary()),
            ], ["node", "digest", "signature"])

    return rows.mapInArrow(of, "node long, digest binary, signature binary")


def bands(signs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """(key, node): BANDS hashes of parts of each signature."""
    width = 2 * PERMUTATIONS // n_bands
    return signs.select("node", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(n_bands)])).alias("key")).select("key", "node")


def classes(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(v, component) of the documents that have copies or near copies: equal texts go to their least id first, and only
    these meet in bands."""
    from tracelake.llm.links import components_of_buckets

    signs = cut(signed(docs))
    least = signs.groupBy("digest").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("digest", "a")
    copies = cut(signs.select("node", "digest").join(least, "digest").where("node > a").select("digest", "node", "a").distinct())
    own = cut(signs.join(copies, ["digest", "node"], "left_anti").select("node", "signature"))
    drop(signs)  # copies and own are written
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("node"), "text")
    found = components_of_buckets(bands(own), texts, alike, copies.select("a", F.col("node").alias("b")))
    drop(own)  # found is written
    return found


def near_duplicates(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(doc_id, class_id): the smallest id reachable through pairs that share a band (or are compared as members of mixed
    buckets) and whose exact Jaccard similarity over shingles is at least `alike`.  Texts without words stand alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = classes(docs, alike)
    return ids.join(found, ids.doc_id == found.v, "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
