"""Near-duplicate documents by b-bit MinHash over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorecal.llm.heap import frugal
from scorecal.llm.minhash import LANES, band_keys, minima, signatures, similar_components
from scorecal.llm.scratch import Scratch
from scorecal.llm.text import Words, mix, slices, utf8

LAST = 2**63 - 1
WORDS = 4  # signature words: 128 minima of 2 bits
SUMMARY = "doc_id long, h long, n long, d1 long, d2 long, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS))


def shingles(column: pa.Array, k: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; a shorter text is one shingle."""
    words = Words(*utf8(column), lower=lower)
    grams, first = words.grams(k)
    out = []
    for i in range(len(first) - 1):
        own = grams[first[i] : first[i + 1]]
        few = words.hashes[words.first[i] : words.first[i + 1]]
        if not len(own) and len(few):
            whole = np.uint64(len(few))
            for h in few:
                whole = mix(np.array([whole ^ h]))[0]
            own = np.array([whole])
        out.append(np.unique(own))
    return out


def _digest(items: np.ndarray) -> tuple[int, int]:
    """Order-free 128-bit identity of a set."""
    return int(np.add.reduce(mix(items)).view(np.int64)), int(np.bitwise_xor.reduce(mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64))


def _summary(k: int, lower: bool, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingles(batch.column("text"), k, lower)
            mins = np.stack([minima(x, WORDS * LANES) for x in sets])
            keys, sigs = band_keys(mins, bands, rows).view(np.int64), signatures(mins).view(np.int64)
            n = np.array([len(x) for x in sets])
            digests = np.array([_digest(x) if len(x) else (0, 0) for x in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists, *(pa.array(sigs[:, i].copy()) for i in range(WORDS))], [x.split()[0] for x in SUMMARY.split(", ")])

    return run


def _texts_of(k: int, lower: bool):
    """Keep the rows whose set has the digest asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [_digest(x) if len(x) else (0, 0) for x in shingles(batch.column("text"), k, lower)]
            asked = zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True)
            yield batch.filter(pa.array([f == a for f, a in zip(found, asked, strict=True)], pa.bool_())).select(["id", "text"])

    return run


def near_dedup(
    docs: DataFrame,
    k: int = 5,
    num: int = 80,
    den: int = 100,
    lower: bool = True,
    bands: int = 25,
    rows: int = 5,
    slack: float = 0.25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Components of documents whose k-word shingle sets have similarity num/den or more.

    ``lower`` lower-cases A-Z.  Two documents are linked when den * intersection
    >= num * union, confirmed on the full sets.  With 25 bands of 5 minima a
    pair at 0.85 is missed by all bands with probability 4e-7 and at 0.80 with
    5e-5; the 128 packed 2-bit minima drop a pair only if their estimate is
    ``slack`` below the threshold, with probability 4e-8 at 0.80 and 4e-9 at
    0.85.

    Returns one row per input row: doc_id, n_shingles, component_id (the
    smallest id reachable), kept (doc_id = component_id), text_hash (xxhash64 of
    the text).  A text with fewer
    than k words is one shingle; a text without words, or null, has none and is
    linked with nothing.  Null ids link, and sort after all others; they are
    never a component's id unless all its ids are null.  Rows that repeat an
    id share its component only through their texts; of identical rows all are
    marked alike.  An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    every = scratch.save(rows_in.mapInArrow(frugal(_summary(k, lower, bands, rows)), SUMMARY), "summary")
    sigs = [f"s{i}" for i in range(WORDS)]
    classes = every.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), *(F.first(s).alias(s) for s in sigs))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    keys = classes.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = scratch.save(keys.join(shared, "key"), "members")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "id", "d1", "d2")
        found = rows_in.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "h", "text").join(wanted, "doc")
        found = found.dropDuplicates(["doc", "id", "h"])  # no shuffle: the join dealt by doc
        return found.select("id", "text", "d1", "d2").mapInArrow(frugal(_texts_of(k, lower)), "id long, text string")

    found = similar_components(classes.select("id", "n", *sigs), members, texts, lambda c: shingles(c, k, lower), scratch, num, den, num / den - slack)
    named = classes.join(found, classes.id == found.v, "left").select("n", "d1", "d2", "doc_id", F.coalesce("m", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("n", "d1", "d2", "component_id")
    out = every.select("doc_id", "h", "n", "d1", "d2").join(of_class, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("h").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, and its own columns.

    Of rows with the same id and text one stays.  Documents without words are
    linked with nothing and stay.  In a component whose ids are all null, each
    different text stays.
    """
    columns = docs.columns
    marks = near_dedup(docs, id_col=id_col, text_col=text_col, **how).where("kept").select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.col("text_hash").alias("h")).distinct()
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *key).join(marks, ["doc", "h"])
    return whole.dropDuplicates(["doc", "h"]).select(*(F.col("row").getField(c).alias(c) for c in columns))
