"""Exact deduplication by counting quotient filters and byte verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm import quotient
from insightspark.llm.common import free_name, slices, stored, table_of, text_of

#: Fingerprints of one bucket of the merged filter, on average.
BUCKET_ROWS = 1 << 20


def normalised(text: str) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased."""
    return text.encode().lower()


def _print(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def _filters(bucket_bits: int):
    """Per partition: one filter for each bucket, from all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in slices(batches, 0):
            new = np.fromiter((_print(normalised(t)) for t in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            values, n = np.unique(new, return_counts=True)
            prints, counts = quotient.merge([(prints, counts), (values, n)]) if len(values) else (prints, counts)
        if not len(prints):
            return
        buckets = prints >> np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(len(prints), np.uint64)
        starts = np.nonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))[0]
        ends = np.append(starts[1:], len(prints))
        yield pa.record_batch({
            "bucket": pa.array(buckets[starts].astype(np.int64)),
            "filter": pa.array([quotient.build(prints[a:b], counts[a:b], bucket_bits) for a, b in zip(starts, ends, strict=True)], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Merge the filters of one bucket and give the fingerprints counted twice or more."""
    bucket = table.column("bucket")[0].as_py()
    prints, counts = quotient.merge([quotient.entries(x.as_py(), bucket) for x in table.column("filter")])
    return pa.table({"fp": pa.array(prints[counts > 1].view(np.int64), pa.int64())})


def repeated_prints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``fp`` of every normalised text met more than once, from merged counting quotient filters.

    A copy seen a million times in a partition is one counted entry there, so no group of copies meets in a task;
    the number of buckets follows the number of rows, so a merge task stays the same size.
    """
    texts = docs.select(text_of(text).alias("text"))
    rows = docs.count()
    bits = max(6, int(max(rows, 1) // BUCKET_ROWS).bit_length())
    filters = texts.mapInArrow(_filters(bits), "bucket long, filter binary")
    return stored(filters.groupBy("bucket").applyInArrow(_repeated, "fp long"), "repeated")


def _marked(columns: list[str], text: str, fp: str, sha: str, norm: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, columns.index(text)):
            texts = [normalised(t or "") for t in batch.column(columns.index(text)).to_pylist()]
            out = {c: batch.column(i) for i, c in enumerate(columns)}
            out[fp] = pa.array(np.fromiter(map(_print, texts), np.uint64, len(texts)).view(np.int64))
            out[sha] = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            if norm:
                out[norm] = pa.array(texts, pa.binary())
            yield pa.record_batch(list(out.values()), names=list(out))

    return run


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with all its columns and rows, and a struct column of the verdict; returns its name as well.

    The struct holds ``keep_id, group_size, kept, text_sha256``. Texts are equal when identical after lower-casing
    A-Z only; of equal texts the row with the largest ``doc_id`` stays (NULL ids are smaller than any other; of rows
    that tie, exactly one stays). NULL texts equal the empty text. An empty table gives no rows.

    1. Every partition builds counting quotient filters, which merge by bucket; what counts once is unique.
    2. Rows of the other fingerprints are stored with their normalised bytes and compared as bytes: grouped by the
       bytes (partial groups before the shuffle), then joined to their group on fingerprint, digest and bytes.

    The names added are chosen so as not to clash with any column that ``docs`` has.
    """
    repeated = repeated_prints(docs, text)
    fp, sha, norm, row, verdict, best, size = (free_name(docs, n) for n in ("fp", "sha", "norm", "row", "verdict", "best", "size"))
    fields = docs.schema.fields
    schema = T.StructType([*fields, T.StructField(fp, T.LongType()), T.StructField(sha, T.StringType())])
    wide = T.StructType([*schema.fields, T.StructField(norm, T.BinaryType())])
    known = repeated.select(F.col("fp").alias(fp))

    single = docs.mapInArrow(_marked(docs.columns, text, fp, sha, None), schema).join(known, fp, "left_anti")
    copies = docs.mapInArrow(_marked(docs.columns, text, fp, sha, norm), wide).join(known, fp, "left_semi")
    copies = stored(copies.withColumn(row, F.monotonically_increasing_id()), "copies")

    def packed(keep, rows, kept):
        return F.struct(keep.cast("long").alias("keep_id"), rows.alias("group_size"), kept.alias("kept"), F.col(sha).alias("text_sha256")).alias(verdict)

    names = [F.col(f"`{c}`") for c in docs.columns]
    alone = single.select(*names, packed(F.col(f"`{doc_id}`"), F.lit(1).cast("long"), F.lit(True)))
    groups = copies.groupBy(fp, sha, norm).agg(F.max(F.struct(F.col(f"`{doc_id}`").alias("id"), F.col(row).alias("row"))).alias(best), F.count(F.lit(1)).alias(size))
    met = copies.join(stored(groups, "groups"), [fp, sha, norm])
    return alone.unionByName(met.select(*names, packed(F.col(f"{best}.id"), F.col(size), F.col(row) == F.col(f"{best}.row")))), verdict


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with exactly its columns (see :func:`exact_groups`)."""
    groups, verdict = exact_groups(docs, text, doc_id)
    return groups.where(F.col(f"{verdict}.kept")).drop(verdict)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups, verdict = exact_groups(table_of(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", f"{verdict}.*")


SQL = """
select d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id as kept, k.h as text_sha256
from (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h from documents) d
join (select sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h, max(doc_id) as keep_id, count(*) as group_size
      from documents group by 1) k using (h)
"""
