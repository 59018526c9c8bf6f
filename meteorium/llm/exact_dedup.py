"""Exact duplicates against immutable snapshots, screened by static binary-fuse filters.

A snapshot is the digest table of the rows accepted so far: exact buckets ``exact`` (one row per digest) and, per shard of the
digest space, one binary-fuse filter in ``filters``.  A new batch is grouped on its own; its digests are screened by the filters
of every snapshot; only digests that pass join the exact buckets.  Every group of two or more rows is then compared by its bytes.
Only digests travel in these steps; texts move once, for rows that have to be compared.

Edge cases: a null text counts as empty; empty texts equal each other; an empty table gives an empty result; other columns are not looked at.
By document (the default) rows that repeat both id and text count as one and rows without an id are left out; with ``every_row`` each row
counts and is returned, also those, and a group without any id has a null ``keep_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, small
from . import fuse
from .common import free_name, shard_count

#: Digests of one filter, and digests screened by one copy of it.
SHARD_KEYS = 1 << 18
#: Rows of equal id and text that are written out at once.
STEP = 10_000


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, every_row: bool = False) -> DataFrame:
    """id, digest and times (rows that count) of each document; combined before the shuffle."""
    named = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    if every_row:
        return named.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    return named.filter("id IS NOT NULL").distinct().withColumn("times", F.lit(1).cast("long"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and the number of rows; combined before the shuffle."""
    return rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("times").alias("copies"))


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


def write_snapshot(groups: DataFrame, path: str) -> str:
    """Store exact buckets and their filters; a stored snapshot is never changed."""
    spark = groups.sparkSession
    groups.write.parquet(f"{path}/exact")
    exact = spark.read.schema(groups.schema).parquet(f"{path}/exact")
    shards = shard_count(exact.count(), SHARD_KEYS)

    def make(part: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, cells = fuse.build(part["key"].to_numpy().astype(np.uint64))
        return pd.DataFrame({"shards": [shards], "shard": [part["shard"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "cells": [cells]})

    key = _key(F.col("digest"))
    (exact.select(key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard")).groupBy("shard")
     .applyInPandas(make, "shards long, shard long, seed long, length long, segments long, cells binary").write.parquet(f"{path}/filters"))
    return path


def screen(groups: DataFrame, snapshot: str) -> DataFrame:
    """Digests of a batch that the snapshot may hold: all that it holds, and about one in 256 of the rest."""
    spark = groups.sparkSession
    filters = spark.read.parquet(f"{snapshot}/filters")
    first = filters.select("shards").first()
    if first is None:
        return groups.select("digest").limit(0)
    shards = first["shards"]
    salts = shard_count(groups.count(), shards * SHARD_KEYS)
    key = _key(F.col("digest"))
    keys = groups.select("digest", key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard"), F.pmod(F.xxhash64(key), F.lit(salts)).alias("salt"))
    copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def ask(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return asked[["digest"]].iloc[:0]
        one = held.iloc[0]
        made = (int(one["seed"]), int(one["length"]), int(one["segments"]), one["cells"])
        return asked.loc[fuse.contains(made, asked["key"].to_numpy().astype(np.uint64)), ["digest"]]

    kind = groups.schema["digest"].dataType.simpleString()
    return keys.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(ask, f"digest {kind}")


def known(groups: DataFrame, snapshot: str) -> DataFrame:
    """digest, keep_id and copies in the snapshot, for the batch's digests that it holds."""
    exact = groups.sparkSession.read.parquet(f"{snapshot}/exact")
    return exact.join(screen(groups, snapshot), "digest", "left_semi")


def _bodies(docs: DataFrame, id_col: str, text_col: str, suspects: DataFrame, on: list[str], digest) -> DataFrame:
    """id, digest and text of the rows that the suspects name; an id that is null names the rows without one."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("body")).withColumn("digest", digest(F.col("body")))
    same = reduce(Column.__and__, (rows[c].eqNullSafe(suspects[c]) for c in on))
    return rows.join(small(suspects), same, "left_semi")


def _equal_bytes(docs: DataFrame, id_col: str, text_col: str, suspects: DataFrame, digest, every_row: bool) -> DataFrame:
    """Groups of equal bytes among the suspect documents: digest, text, keep_id, copies."""
    count = F.count(F.lit(1)) if every_row else F.count_distinct("id")
    return _bodies(docs, id_col, text_col, suspects, ["id", "digest"], digest).groupBy("digest", "body").agg(F.max("id").alias("keep_id"), count.alias("copies"))


def _documents(docs: DataFrame, id_col: str, text_col: str, batches: list[Column] | None, digest, every_row: bool) -> DataFrame:
    """id, digest, times, keep_id and copies of every document (rows of equal id and text)."""
    if batches is None:
        batches = [F.pmod(F.xxhash64("id"), F.lit(2)) == 0]
    number = reduce(lambda rest, k: F.when(batches[k], k).otherwise(rest), reversed(range(len(batches))), F.lit(len(batches)))
    rows = materialize(digest_rows(docs, id_col, text_col, digest, every_row).withColumn("batch", number))
    store, snapshots, shared = scratch_path(docs.sparkSession, "exact"), [], []
    for k in range(len(batches) + 1):
        mine = materialize(grouped(rows.filter(F.col("batch") == k)))
        shared += [mine.filter("copies > 1").select("digest"), *(known(mine, s).select("digest") for s in snapshots)]
        snapshots.append(write_snapshot(mine, f"{store}/{k}") if k < len(batches) else None)
    repeated = materialize(reduce(DataFrame.unionByName, shared).distinct())
    suspects = materialize(rows.select("id", "digest").join(repeated, "digest", "left_semi"))
    bytes_ = materialize(_equal_bytes(docs, id_col, text_col, suspects, digest, every_row))
    by_digest = bytes_.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("texts"))
    out = rows.join(by_digest, "digest", "left").select("id", "digest", "times", "keep_id", "copies")
    clash = materialize(by_digest.filter("texts > 1").select("digest"))
    if not clash.isEmpty():  # digests that stand for more than one text: those documents are told apart by the text itself
        times = F.count(F.lit(1)) if every_row else F.lit(1).cast("long")
        doubtful = _bodies(docs if every_row else docs.filter(F.col(id_col).isNotNull()), id_col, text_col, clash, ["digest"], digest)
        doubtful = doubtful.groupBy("id", "digest", "body").agg(times.alias("times"))
        out = out.join(clash, "digest", "left_anti").unionByName(doubtful.join(bytes_, ["digest", "body"]).select(out.columns))
    return out.select("id", "digest", "times", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: list[Column] | None = None, digest=sha256_hex,
                every_row: bool = False) -> DataFrame:
    """id, digest, keep_id, group_size and kept of every document, or of every row; of equal texts the largest id stays.

    ``batches`` says by one condition each which rows arrive together; the first true one counts.  The rows of all earlier
    batches are snapshots to the later ones.  By default one half of the rows, by id hash, is the stored half.
    """
    out = _documents(docs, id_col, text_col, batches, digest, every_row)
    if every_row:  # rows of equal id and text are alike, so each stands as often as it was counted; in steps, so that no array is long
        out = out.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / STEP))))
        out = out.withColumn("one", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(STEP), F.col("times") - F.col("step") * STEP).cast("int"))))
    return out.select("id", "digest", "keep_id", F.col("copies").alias("group_size"), (F.col("id") == F.col("keep_id")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns: one with the largest id, or without an id if no row of the text has one."""
    found = materialize(_documents(docs, id_col, text_col, None, sha256_hex, True).filter("copies > 1"))
    stays, name = F.col("id").eqNullSafe(F.col("keep_id")), free_name(docs, "digest")
    marked = docs.withColumn(name, sha256_hex(F.col(text_col)))

    def beside(rows: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return rows.join(pairs, rows[id_col].eqNullSafe(pairs["id"]) & (rows[name] == pairs["digest"]), how)
    goes = materialize(found.filter(~stays).select("id", "digest"))
    out, again = beside(marked, small(goes), "left_anti"), found.filter(stays & (F.col("times") > 1))
    if not again.isEmpty():  # rows that repeat both id and text
        out = beside(out, again, "left_anti").unionByName(beside(out, again, "left_semi").dropDuplicates([id_col, name]))
    return out.drop(name)


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with a number in the order of their ids, those without an id last; it differs wherever id or text do."""
    pairs = docs.select(F.col(id_col).alias("id"), sha256_hex(F.col(text_col)).alias("digest")).distinct()
    pairs = materialize(pairs.orderBy(F.asc_nulls_last("id"), "digest").withColumn(name, F.monotonically_increasing_id()))
    same = docs[id_col].eqNullSafe(pairs["id"]) & (sha256_hex(docs[text_col]) == pairs["digest"])
    return materialize(docs.join(pairs, same).select(*(docs[c] for c in docs.columns), pairs[name]))
