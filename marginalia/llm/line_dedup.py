"""Line dedup over hashed lines.

Every document sends one row per distinct line key, a 128-bit hash with the
line's places. The rows are dealt by range of (key, document, first place) and
streamed in that order, so a key that fills a third of the corpus is spread over
many tasks. Each Arrow batch decides the keys that begin and end inside it; a key
that touches a batch's edge leaves its few open occurrences and a count, which are
settled by a second, small aggregation. What comes back is one compressed bitmap
per document, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts, raw

_LINES = "k1 long, k2 long, doc_id long, text_hash long, n_lines int, first int, places binary"
_MARKS = "kind string, k1 long, k2 long, doc_id long, text_hash long, n_lines int, first int, places binary, n long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _keys(min_chars: int):
    def run(batches):
        schema = _arrow(_LINES)
        for batch in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), raw(batch["text"]), strict=True):
                lines = (text or b"").split(b"\n")
                seen: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = line.strip().lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        seen.setdefault(key, []).append(i)
                for key, at in seen.items():
                    d = xxhash.xxh3_128_digest(key)
                    row = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, th, len(lines), at[0], np.array(at, "<u4").tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _decide(min_docs: int, keep_first: bool):
    """Marks of one sorted batch. ``drop``: decided. ``head``: decided, the first place stays. ``open``: an occurrence of an
    edge key that is still undecided. ``sum``: how many documents of the edge key
    this batch saw, with the first of them."""

    def run(batches):
        schema = _arrow(_MARKS)
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            k1, k2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            new = np.ones(size, bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, size))
            run_of = np.cumsum(new) - 1
            edge = np.zeros(len(start), bool)
            edge[[0, -1]] = True
            full = length >= min_docs
            first = np.arange(size) == start[run_of]
            drop = full[run_of] & ~(first & (edge[run_of] | keep_first))
            # At an edge the first occurrence stays open, as does all of a run that is too short by itself.
            left = edge[run_of] & (~full[run_of] | first)
            sums = start[edge]
            heads = np.flatnonzero(full[run_of] & first & ~edge[run_of]) if keep_first else sums[:0]
            out = []
            for kind, rows in (("drop", np.flatnonzero(drop)), ("head", heads), ("open", np.flatnonzero(left)), ("sum", sums)):
                if len(rows):
                    part = batch.take(pa.array(rows))
                    n = length[edge] if kind == "sum" else np.ones(len(rows), np.int64)
                    out.append(pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), *part.columns, pa.array(n, pa.int64())], schema=schema))
            yield from out

    return run


def _bitmap(places: list[bytes], n_lines: int) -> bytes:
    keep = np.ones(n_lines, np.uint8)
    for p in places:
        keep[np.frombuffer(p, "<u4")] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def _bitmaps(batches):
    schema = _arrow("doc_id long, text_hash long, n_lines int, keep_bitmap binary")
    for batch in batches:
        maps = [_bitmap(p, n) for p, n in zip(batch["places"].to_pylist(), batch["n_lines"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], batch["n_lines"], pa.array(maps, pa.binary())], schema=schema)


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """Bitmaps of the lines that stay, for documents that lose any.

    docs: ``doc_id`` (integer) and ``text``; other columns are ignored. A line's
    key is the line stripped of ASCII white space, with A-Z lower-cased; keys of
    fewer than `min_chars` code points never drop. A key found in at least
    `min_docs` documents drops everywhere (``keep="none"``) or everywhere but in its
    first document by (doc_id, text hash), at its first place (``keep="first"``).

    Each input row is a document: rows that repeat count each, and get the same
    bitmap. Null and empty texts are one empty line. A null doc_id is a value like
    any other. Returns doc_id, text_hash, n_lines, keep_bitmap (zlib of packed bits,
    most significant first); empty for an empty table.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep: none or first, not {keep}")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    lines = materialize(plain.mapInArrow(_keys(min_chars), _LINES))
    order = ["k1", "k2", "doc_id", "text_hash", "first"]
    dealt = lines.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    marks = materialize(dealt.mapInArrow(_decide(min_docs, keep == "first"), _MARKS))
    who = F.struct("doc_id", "text_hash", "first")
    settled = marks.where("kind = 'sum'").groupBy("k1", "k2").agg(F.sum("n").alias("total"), F.min(who).alias("head")).where(F.col("total") >= min_docs)
    late = marks.where("kind = 'open'").join(settled, ["k1", "k2"])
    cols = ["doc_id", "text_hash", "n_lines", "places"]
    rest = F.expr("substring(places, 5)").alias("places")  # a place has four bytes
    if keep == "first":
        late = late.withColumn("places", F.when(who.eqNullSafe(F.col("head")), rest).otherwise(F.col("places")))
    heads = marks.where("kind = 'head'").select(*cols[:3], rest)
    drops = marks.where("kind = 'drop'").select(cols).union(heads).union(late.select(cols)).where(F.length("places") > 0)
    grouped = drops.groupBy("doc_id", "text_hash", "n_lines").agg(F.collect_list("places").alias("places"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines int, keep_bitmap binary")


def _apply(digest: bool):
    def run(batches):
        for batch in batches:
            n_lines, dropped, out = [], [], []
            for text, bits in zip(raw(batch["text"]), batch["keep_bitmap"].to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if bits is not None:
                    mask = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
                    lines = [x for x, k in zip(lines, mask.tolist(), strict=True) if k]
                    text = b"\n".join(lines)
                dropped.append(n_lines[-1] - len(lines))
                out.append(hashlib.sha256(text or b"").hexdigest() if digest else None if text is None else text.decode())
            names = [c for c in batch.schema.names if c not in ("text", "keep_bitmap")]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(n_lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], names=[*names, "n_lines", "n_dropped", "out"])

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, carry: list[Column], digest: bool = False) -> DataFrame:
    """The `carry` columns of each row, then n_lines, n_dropped and ``out``: the
    kept text, or its SHA-256 if `digest`. A null text without a bitmap stays null."""
    b = bitmaps.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "keep_bitmap")
    d = docs.select(*carry, F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    both = d.join(b, d["_doc"].eqNullSafe(b["_d"]) & (d["_hash"] == b["_t"]), "left").drop("_d", "_t", "_doc", "_hash")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name not in ("text", "keep_bitmap")]
    return both.mapInArrow(_apply(digest), ", ".join([*kinds, "n_lines long", "n_dropped long", "out string"]))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """`docs` with the repeated lines taken out of ``text``; every row and column stays."""
    cols = docs.columns
    inner = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols) if c != "text"]
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, keep), inner)
    return out.select(*(F.col("out").alias("text") if c == "text" else F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)))


def op1(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    out = apply_bitmaps(docs, keep_bitmaps(docs, 10, 1, "none"), [F.col("doc_id")], digest=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.col("out").alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM (SELECT r, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
m AS (SELECT l.*, hot.k IS NOT NULL AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
