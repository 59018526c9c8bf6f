"""Benchmark decontamination over a stored positional inverted index of the training tokens.

The index is cut by documents: each chunk of about ``CHUNK_WORDS`` words has, per term, the sorted places of the term in the
chunk (documents stand one after another with a gap of one place, so no phrase runs over a border).  A search takes the
benchmark in blocks of bounded size; per chunk it starts from the rarest term of a window and intersects the offset-adjusted
places of the other terms, from rare to common.  A chunk is one group of bounded size, so no term and no document can make
a task heavy; places of the terms that no test item has are not read into it.

Edge cases: a null text has no words; documents without words get a row without hits; an item without words has no windows; an
item without id marks words but is not counted as an item; rows that repeat are searched each on its own; one text longer
than a chunk makes a chunk of its own; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, scratch_path, small
from .common import text_batches

CHUNK_WORDS = 400_000
#: Bytes of test items that are sent to the executors at once.
BLOCK_BYTES = 8 << 20
WINDOW = 10

#: Bytes outside words become blanks, A-Z become a-z; bytes of characters beyond ASCII belong to words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Codes(dict):
    """Numbers for terms in order of their first sight."""

    def __missing__(self, term):
        self[term] = code = len(self)
        return code


def _chunk(number: int, ids: list, counts: list[int], words: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of one chunk: its documents (term null), and the places of each term as steps from one place to the next."""
    codes = Codes()
    coded = np.fromiter(map(codes.__getitem__, words), dtype=np.uint32, count=len(words))
    sizes = np.asarray(counts, dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    places = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(coded, kind="stable")
    held = np.bincount(coded, minlength=len(codes)) if len(words) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(held)
    steps = np.diff(places[order], prepend=0)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(held) else ends
    steps[first] = places[order][first]
    raw = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32) * 4), pa.py_buffer(steps.astype(np.uint32))])
    n = len(held) + 1
    none = [None] * (n - 1)
    columns = {"chunk": pa.array(np.full(n, number)), "term": pa.array([*codes, None], pa.binary()), "n": pa.array([*held.tolist(), len(ids)], pa.int64()),
               "steps": pa.concat_arrays([raw, pa.array([None], pa.binary())]), "ids": pa.array([*none, ids], schema.field("ids").type),
               "starts": pa.array([*none, starts.tolist()], pa.list_(pa.int64())), "sizes": pa.array([*none, counts], pa.list_(pa.int64()))}
    return pa.RecordBatch.from_arrays([columns[c].cast(schema.field(c).type) for c in schema.names], schema=schema)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Write the index of all words of all documents and give it back as read from the files."""
    text_batches(docs.sparkSession)
    kinds = {"chunk": T.LongType(), "term": T.BinaryType(), "n": T.LongType(), "steps": T.BinaryType(), "ids": T.ArrayType(docs.schema[id_col].dataType),
             "starts": T.ArrayType(T.LongType()), "sizes": T.ArrayType(T.LongType())}
    declared = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    schema = to_arrow_schema(declared)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids, counts, words = [], [], []
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                ids.append(one)
                counts.append(len(found))
                words += found
                if len(words) >= chunk_words:
                    yield _chunk(made, ids, counts, words, schema)
                    made, ids, counts, words = made + 1, [], [], []
        if ids:
            yield _chunk(made, ids, counts, words, schema)

    (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(chunks, declared)
     .write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.schema(declared).parquet(path)


def windows_of(items: list[tuple], width: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Each window of ``width`` consecutive words (a shorter item is one window) with its item ids."""
    out: dict[tuple[bytes, ...], set] = {}
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(tuple(words[k:k + width]), set()).add(item)
    return out


def _places(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the terms, for every start from which each term stands at most ``slop`` places away from its own."""
    rank = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    rarest = lists[rank[0]] - rank[0]
    at = np.unique(rarest[:, None] + np.arange(-slop, slop + 1)) if slop else rarest
    low, high = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
    for k in rank if slop else rank[1:]:
        if not len(at):
            break
        held, want = lists[k], at + k
        right = np.searchsorted(held, want)
        after, before = held[np.minimum(right, len(held) - 1)], held[np.maximum(right - 1, 0)]
        near = np.where(np.abs(after - want) <= np.abs(before - want), after, before)
        ok = np.abs(near - want) <= slop
        at, low, high = at[ok], np.minimum(low, near)[ok], np.maximum(high, near)[ok]
    return (low, high + 1) if slop else (at, at + len(lists))


def _merged(found: list[tuple]) -> list[tuple]:
    """(document, item, start, stop) with touching spans of the same document and item joined."""
    out: list[list] = []
    for doc, item, start, stop in sorted(found, key=lambda f: (f[0], f[1] is None, f[1] if f[1] is not None else 0, f[2], f[3])):
        if out and out[-1][0] == doc and out[-1][1] == item and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], stop)
        else:
            out.append([doc, item, start, stop])
    return out


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, slop: int = 0,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """chunk, doc_no, item_id, start, stop: spans of words (end exclusive, from the document's first) that hold windows of an item.

    ``slop`` 0 finds exact phrases.  A larger one also finds windows whose words all stand at most that many places from where
    they would stand in the phrase at some start.
    """
    spark, kind = index.sparkSession, items.schema[id_col].dataType.simpleString()
    asked = materialize(items.select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("text")).distinct())
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    out = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = windows_of([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.toLocalIterator()], width)
        found = _search_block(spark, index, windows, kind, slop)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark, index: DataFrame, windows: dict, kind: str, slop: int) -> DataFrame:
    codes = Codes()
    by_width: dict[int, tuple[list, list]] = {}
    for words, owners in windows.items():
        rows, ids = by_width.setdefault(len(words), ([], []))
        rows.append([codes[w] for w in words])
        ids.append(sorted(owners, key=lambda o: (o is None, o if o is not None else 0)))
    tests = [(np.asarray(rows, dtype=np.int32), ids) for rows, ids in by_width.values()]
    sent = spark.sparkContext.broadcast((dict(codes), tests))
    terms = spark.createDataFrame([(bytearray(w), True) for w in codes], "term binary, asked boolean")

    def intersect(part: pd.DataFrame) -> pd.DataFrame:
        numbers, jobs = sent.value
        about = part[part["term"].isna()].iloc[0]
        starts = np.asarray(about["starts"], dtype=np.int64)
        lists: dict[int, np.ndarray] = {}
        for term, steps in zip(part["term"], part["steps"]):
            if term is not None:
                lists[numbers[bytes(term)]] = np.cumsum(np.frombuffer(steps, dtype=np.uint32).astype(np.int64))
        here = np.zeros(len(numbers), dtype=bool)
        here[list(lists)] = True
        found = []
        for rows, ids in jobs:
            for k in np.flatnonzero(here[rows].all(axis=1)):
                low, high = _places([lists[c] for c in rows[k].tolist()], slop)
                doc = np.searchsorted(starts, low, side="right") - 1
                if slop:
                    same = doc == np.searchsorted(starts, high - 1, side="right") - 1
                    low, high, doc = low[same], high[same], doc[same]
                for d, a, z in zip(doc.tolist(), (low - starts[doc]).tolist(), (high - starts[doc]).tolist()):
                    found += [(d, item, a, z) for item in ids[k]]
        rows = _merged(found)
        return pd.DataFrame({"chunk": [about["chunk"]] * len(rows), "doc_no": [r[0] for r in rows], "item_id": pd.Series([r[1] for r in rows], dtype=object),
                             "start": [r[2] for r in rows], "stop": [r[3] for r in rows]})

    asked = index.join(F.broadcast(terms), "term", "left").filter("term IS NULL OR asked")
    return asked.groupBy("chunk").applyInPandas(intersect, f"chunk long, doc_no long, item_id {kind}, start long, stop long")


def indexed_documents(index: DataFrame) -> DataFrame:
    """chunk, doc_no, id and n_words of every indexed row."""
    one = F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("sizes").alias("n_words"))).alias("doc_no", "one")
    return index.filter("term IS NULL").select("chunk", one).select("chunk", F.col("doc_no").cast("long").alias("doc_no"), "one.id", "one.n_words")


def contamination(index: DataFrame, spans: DataFrame) -> DataFrame:
    """Per indexed row: id, n_words, n_hit (words inside any span) and items (sorted item ids as strings)."""
    so_far = F.max("stop").over(Window.partitionBy("chunk", "doc_no").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce("before", "start")))
    hit = (spans.withColumn("before", so_far).groupBy("chunk", "doc_no")
           .agg(F.sum(fresh).alias("n_hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return (indexed_documents(index).join(hit, ["chunk", "doc_no"], "left")
            .select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """``contamination`` of every document by the items, through an index that is built for it."""
    index = build_index(docs, scratch_path(docs.sparkSession, "index"), id_col, text_col)
    return contamination(index, search(index, items, item_col, item_text, width, slop))


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns; ids are taken as unique here."""
    hit = materialize(decontaminate(docs, items, id_col, text_col).filter("n_hit > 0").select(F.col("id").alias(id_col)).distinct())
    return docs.join(small(hit), id_col, "left_anti")
