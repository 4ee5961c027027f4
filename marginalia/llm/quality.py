"""Quality by an interpolated modified Kneser-Ney model of trusted text.

The tokens are code points, so that every text has all its tokens known or nearly so.
Counts of n-grams, and of their continuations, are sharded by n-gram and joined order by
order into interpolated probabilities. Every trusted document counts, whole.

Documents meet the model in sharded joins as well: they are packed, the distinct n-grams of each
pack are aggregated to those of the corpus, these are joined with the model's tables order by
order, and each pack gets the logarithms of its own n-grams back, from which its documents
have their perplexity. No table of the model is collected or broadcast, and a text moves once, compressed. A
document is kept up to a quantile of its own language's trusted documents that the model has not seen.
"""

from __future__ import annotations

import bz2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, parts, table

#: Length of n-grams.
ORDER = 4
#: Bounds of `_bounded`: documents, and code points of all of them.
TRUSTED_DOCS, TRUSTED_CHARS = 20_000, 40_000_000
#: Quantile of the trusted documents' perplexities up to which a document is kept.
QUANTILE = 0.995
#: Code points of a piece of a text, which are handled at once, and of a pack.
PIECE, PACK = 1 << 20, 16 << 20
#: Packs that one task works on, and packs whose n-grams are a shard's.
PACKS, SHARE = 2, 20
#: Bits of the table in which most n-grams are found at once.
SLOTS = 20
_PAD, _END = "\x02" * (ORDER - 1), "\x03"
_K = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hash(code: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the n-grams of a code array; of whole rows, if it has two dimensions."""
    size = max(0, code.shape[0] - n + 1)
    h = np.full(size, (salt * 1000003 + n) & (1 << 63) - 1, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(31))) * _K + code[i : i + size]
    return (h ^ (h >> np.uint64(32))) * _K


def _grams(batches):
    """Each task's n-grams with their counts."""
    found: dict[tuple[str, str], int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            padded = _PAD + text + _END
            for at in range(0, len(padded) - ORDER + 1, PIECE):
                piece = padded[at : at + PIECE + ORDER - 1]
                _, first, n = np.unique(_hash(_codes(piece), ORDER, 0), return_index=True, return_counts=True)
                for i, k in zip(first.tolist(), n.tolist(), strict=True):
                    g = (lang, piece[i : i + ORDER])
                    found[g] = found.get(g, 0) + k
        if len(found) > 1_000_000:
            yield _rows(found)
            found = {}
    yield _rows(found)


def _rows(found):
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "g", "c"])


def _discounts(counts: DataFrame) -> DataFrame:
    """d1, d2, d3 of each language: one discount for counts of 1, of 2 and of more."""
    n = counts.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    out = [F.col("lang").alias("_lang")]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        fits = (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        # With too few counts of counts, or a value out of range, half of what the count allows.
        out.append(F.when(fits & (d > 0) & (d <= k), d).otherwise(F.lit(k / 2)).alias(f"d{k}"))
    return n.select(*out)


def fit(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model of texts (lang, text)."""
    return _fit(texts.select("lang", "text").mapInArrow(_grams, "lang string, g string, c long"))


def _fit(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of (lang, n, g, p) and (lang, n, h, weight) from n-grams with counts: the interpolated
    probability of each n-gram seen, and what each context leaves to the next lower order."""
    counts = {ORDER: materialize(found.groupBy("lang", "g").agg(F.sum("c").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = counts[n + 1].groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("c"))
    grams = contexts = lower = None
    for n in range(1, ORDER + 1):
        c = counts[n].join(F.broadcast(_discounts(counts[n])), F.col("lang") == F.col("_lang")).drop("_lang")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.select("lang", "g", "c", cut.alias("cut"), F.expr(f"left(g, {n - 1})").alias("h"), F.expr("substring(g, 2)").alias("low"))
        h = c.groupBy(F.col("lang").alias("l"), F.col("h").alias("hh")).agg(F.sum("c").alias("all"), F.sum("cut").alias("cuts"), F.count("*").alias("kinds"))
        h = h.select("l", "hh", "all", (F.col("cuts") / F.col("all")).alias("weight"), "kinds")
        c = c.join(h, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("hh")))
        if n == 1:
            c = c.withColumn("below", 1 / (F.col("kinds") + 1))
        else:
            c = c.join(lower, (F.col("lang") == F.col("l2")) & (F.col("low") == F.col("g2")))
        p = materialize(c.select("lang", F.lit(n).alias("n"), "g", ((F.col("c") - F.col("cut")) / F.col("all") + F.col("weight") * F.col("below")).alias("p")))
        lower = p.select(F.col("lang").alias("l2"), F.col("g").alias("g2"), F.col("p").alias("below"))
        # An unknown code point shares the root's remainder.
        w = h.select(F.col("l").alias("lang"), F.lit(n).alias("n"), F.col("hh").alias("h"), (F.col("weight") / (F.col("kinds") + 1) if n == 1 else F.col("weight")).alias("weight"))
        grams = p if grams is None else grams.union(p)
        contexts = w if contexts is None else contexts.union(w)
    return grams, contexts


def _packs(batches):
    """Pieces of texts with the ORDER - 1 code points before them; a long text has several, and one
    that isn't scored an empty one. The pieces of a pack stand by language."""
    part, made, rows = TaskContext.get().partitionId(), 0, 0
    pieces: list[tuple] = []
    size = 0

    def pack(kind):
        pieces.sort(key=lambda p: (p[2] is not None, p[2] or ""))
        text = "".join(p[4] for p in pieces).encode("utf-8", "surrogatepass")
        cols = [[(part << 32) + made], *([[p[k] for p in pieces]] for k in range(4)), [[len(p[4]) for p in pieces]], [bz2.compress(text)]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(kind), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["pack", "row", "doc_id", "lang", "chars", "size", "body"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for doc, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            padded = _PAD + text + _END if text and lang is not None else ""
            for at in range(0, max(1, len(padded) - ORDER + 1), PIECE):
                piece = padded[at : at + PIECE + ORDER - 1]
                pieces.append(((part << 40) + rows, doc, lang, 0 if at else len(text or ""), piece))
                size += len(piece) + 64
                if size > PACK:
                    yield pack(kind)
                    made, pieces, size = made + 1, [], 0
            rows += 1
    if pieces:
        yield pack(kind)


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang) >> 24


def _windows(row: dict, text: str | None = None):
    """Runs of pieces of one language, of not much more than PIECE code points: language, first and
    last piece, text, where the pieces begin in it, the places of n-grams within pieces, and their keys."""
    text = bz2.decompress(row["body"]).decode("utf-8", "surrogatepass") if text is None else text
    sizes, langs, at, i = row["size"], row["lang"], 0, 0
    while i < len(sizes):
        first, begin = i, at
        while i < len(sizes) and langs[i] == langs[first] and (i == first or at - begin < PIECE):
            at += sizes[i]
            i += 1
        if at == begin:
            continue
        ends = np.cumsum(np.array(sizes[first:i], np.int64))
        inside = np.ones(at - begin, bool)
        # The last ORDER - 1 places of a piece begin no n-gram; empty pieces have none.
        inside[(ends[:, None] - np.arange(1, ORDER)).ravel()[np.repeat(np.array(sizes[first:i]) > 0, ORDER - 1)]] = False
        part = text[begin:at]
        places = np.flatnonzero(inside)
        yield langs[first], first, i, part, np.append(0, ends[:-1]), places, _hash(_codes(part), ORDER, _salt(langs[first]))[places]


def _learned(batches):
    """The n-grams of the pieces of a pack that are trusted, with their counts. A piece has its own n-grams and no others."""
    found: dict[tuple[str, str], int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            mine, text = set(row["trusted"]), bz2.decompress(row["body"]).decode("utf-8", "surrogatepass")
            at, parts = 0, []
            for i, size in enumerate(row["size"]):
                if i in mine and size:
                    parts.append((row["lang"][i], size, text[at : at + size]))
                at += size
            cut = {"lang": [p[0] for p in parts], "size": [p[1] for p in parts]}
            for lang, _, _, part, _, places, h in _windows(cut, "".join(p[2] for p in parts)):
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                for i, k in zip(places[first].tolist(), n.tolist(), strict=True):
                    g = (lang, part[i : i + ORDER])
                    found[g] = found.get(g, 0) + k
                if len(found) > 1_000_000:
                    yield _rows(found)
                    found = {}
    yield _rows(found)


def _slots() -> np.ndarray:
    """A table of keys by their first bits; an empty slot has a key of another one."""
    return (np.arange(1 << SLOTS, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - SLOTS)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOTS)).astype(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _asked(shards: int):
    """The distinct n-grams of each pack, by shard and language."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found: dict[str, tuple] = {}
                for lang, _, _, part, _, places, h in _windows(row):
                    slots, old, grams = found.get(lang) or (_slots(), np.zeros(0, np.uint64), np.zeros(0, object))
                    left = np.flatnonzero(slots[_slot(h)] != h)
                    key, first = np.unique(h[left], return_index=True)
                    new = ~np.isin(key, old, assume_unique=True)
                    more = np.array([part[i : i + ORDER] for i in places[left[first[new]]].tolist()], object)
                    slots[_slot(key[new])] = key[new]
                    found[lang] = slots, np.append(old, key[new]), np.append(grams, more)
                rows = []
                for lang, (_, keys, grams) in found.items():
                    order = np.argsort(keys)
                    keys, grams = keys[order], grams[order]
                    shard = _shard(keys, shards)
                    cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
                    rows += [(int(shard[s]), row["pack"], lang, "".join(grams[s:e])) for s, e in zip(cut, cut[1:], strict=False)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "pack", "lang", "grams"])

    return run


def _keys(lang: str, grams: str) -> np.ndarray:
    """The keys of n-grams that stand one after the other."""
    code = _codes(grams).reshape(-1, ORDER).T
    return _hash_rows(code, ORDER, _salt(lang), code.shape[1])


def _distinct(asked: pa.Table) -> pa.Table:
    """The distinct n-grams of a shard."""
    found: dict[str, tuple] = {}
    for row in asked.to_pylist():
        keys = _keys(row["lang"], row["grams"])
        old, grams = found.get(row["lang"], (np.zeros(0, np.uint64), []))
        new = np.flatnonzero(~np.isin(keys, old, assume_unique=True))
        more = [row["grams"][i * ORDER : i * ORDER + ORDER] for i in new.tolist()]
        found[row["lang"]] = np.append(old, keys[new]), grams + more
    shard = asked["shard"][0]
    n = sum(len(g) for _, g in found.values())
    langs = [lang for lang, (_, g) in found.items() for _ in g]
    return pa.table({"shard": pa.array([shard.as_py()] * n, pa.int64()), "lang": pa.array(langs, pa.string()), "g": pa.array([x for _, g in found.values() for x in g], pa.string())})


def _answers(asked: pa.Table, logs: pa.Table) -> pa.Table:
    """For each pack of a shard, the logarithms of its n-grams; none in languages that the model doesn't have."""
    tables = {}
    langs, grams, p = np.array(logs["lang"].to_pylist(), object), np.array(logs["g"].to_pylist(), object), logs["p"].to_numpy()
    for lang in set(langs.tolist()):
        at = np.flatnonzero(langs == lang)
        keys = _keys(lang, "".join(grams[at]))
        order = np.argsort(keys)
        tables[lang] = keys[order], p[at][order].astype("<f4")
    out = []
    for row in asked.to_pylist():
        if row["lang"] in tables:
            keys, mine = tables[row["lang"]]
            out.append((row["pack"], row["lang"], row["grams"], mine[np.searchsorted(keys, _keys(row["lang"], row["grams"]))].tobytes()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    kinds = {"pack": pa.int64(), "lang": pa.string(), "grams": pa.string(), "logs": pa.binary()}
    return pa.table({k: pa.array(c, t) for c, (k, t) in zip(cols, kinds.items(), strict=True)})


def _summed(packs: pa.Table, said: pa.Table) -> pa.Table:
    """Sums of the logarithms over each piece, and the n-grams that it has."""
    row = packs.to_pylist()[0]
    tables: dict = {}
    for r in said.to_pylist():
        tables.setdefault(r["lang"], []).append((_keys(r["lang"], r["grams"]), np.frombuffer(r["logs"], "<f4").astype(np.float64)))
    for lang, got in tables.items():
        keys, logs = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        slots, at = _slots(), np.zeros(1 << SLOTS)
        slots[_slot(keys)], at[_slot(keys)] = keys, logs
        tables[lang] = keys, logs, slots, at
    size = np.array(row["size"], np.int64)
    total, n = np.full(len(size), np.nan), np.maximum(size - ORDER + 1, 0)
    for lang, first, last, part, begins, places, h in _windows(row):
        if lang in tables:
            keys, logs, slots, at = tables[lang]
            mine = at[_slot(h)]
            left = np.flatnonzero(slots[_slot(h)] != h)
            mine[left] = logs[np.searchsorted(keys, h[left])]
            found = np.zeros(len(part))
            found[places] = mine
            some = size[first:last] > 0
            total[first:last][some] = np.add.reduceat(found, begins[some])
    kind = packs.schema.field("doc_id").type.value_type
    heads = {"row": pa.array(row["row"], pa.int64()), "doc_id": pa.array(row["doc_id"], kind), "lang": pa.array(row["lang"], pa.string()), "n_chars": pa.array(row["chars"], pa.int64())}
    return pa.table(heads | {"log": pa.array(total, pa.float64(), from_pandas=True), "n": pa.array(n, pa.int64())})


def _hash_rows(rows: np.ndarray, n: int, salt: int, size: int) -> np.ndarray:
    h = np.full(size, (salt * 1000003 + n) & (1 << 63) - 1, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(31))) * _K + rows[i]
    return (h ^ (h >> np.uint64(32))) * _K


def log_probability(asked: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """lang, g, shard and p, the log10 probability of the last code point behind the others, for the
    distinct n-grams `asked` (lang, g, shard) of the model's languages. From the lowest order up, an
    n-gram has its own probability or, if it was not seen, what its context leaves to the next lower one."""
    wanted = {ORDER: asked}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select("lang", F.expr("substring(g, 2)").alias("g")).distinct()
    out = None
    for n in range(1, ORDER + 1):
        seen = grams.where(F.col("n") == n).select(F.col("lang").alias("_l"), F.col("g").alias("_g"), F.log10("p").alias("own"))
        rows = wanted[n].join(seen, (F.col("lang") == F.col("_l")) & (F.col("g") == F.col("_g")), "left").drop("_l", "_g")
        left = contexts.where(F.col("n") == n).select(F.col("lang").alias("_l"), F.col("h").alias("_h"), F.log10("weight").alias("left"))
        if n == 1:  # one row for each language of the model
            rows = rows.join(F.broadcast(left), F.col("lang") == F.col("_l")).select("lang", "g", F.coalesce("own", "left").alias("p"))
        else:
            rows = rows.withColumn("h", F.expr(f"left(g, {n - 1})")).withColumn("low", F.expr("substring(g, 2)"))
            rows = rows.join(left, (F.col("lang") == F.col("_l")) & (F.col("h") == F.col("_h")), "left").drop("_l", "_h")
            below = out.select(F.col("lang").alias("_l"), F.col("g").alias("_g"), F.col("p").alias("below"))
            rows = rows.join(below, (F.col("lang") == F.col("_l")) & (F.col("low") == F.col("_g")))
            rows = rows.select("lang", "g", *(["shard"] if n == ORDER else []), F.coalesce("own", F.coalesce("left", F.lit(0.0)) + F.col("below")).alias("p"))
        out = materialize(rows)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """The texts of doc_id, lang and text in packs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.mapInArrow(_packs, f"pack long, row array<long>, doc_id array<{kind}>, lang array<string>, chars array<long>, size array<int>, body binary"))


def perplexities(docs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars and perplexity of each row of doc_id, lang and text; null for
    null and empty texts and where the model doesn't have the language. Logarithms of n-grams
    travel as 32-bit floats, which a perplexity has in its seventh digit."""
    return _perplexities(packed(docs), grams, contexts)


def _perplexities(packs: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    least = parts(packs.sparkSession)
    kind = packs.schema["doc_id"].dataType.elementType.simpleString()
    n = packs.count()
    tasks, shards = max(least, n // PACKS), max(least, n // SHARE)
    asked = materialize(packs.mapInArrow(_asked(shards), "shard long, pack long, lang string, grams string"))
    distinct = asked.select("shard", "lang", "grams").repartition(shards, "shard").groupBy("shard").applyInArrow(_distinct, "shard long, lang string, g string")
    logs = log_probability(materialize(distinct), grams, contexts)
    said = asked.repartition(shards, "shard").groupBy("shard").cogroup(logs.repartition(shards, "shard").groupBy("shard")).applyInArrow(_answers, "pack long, lang string, grams string, logs binary")
    both = packs.repartition(tasks, "pack").groupBy("pack").cogroup(said.repartition(tasks, "pack").groupBy("pack"))
    sums = both.applyInArrow(_summed, f"row long, doc_id {kind}, lang string, n_chars long, log double, n long").groupBy("row")
    whole = sums.agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), *(F.sum(c).alias(c) for c in ("n_chars", "log", "n")))
    return whole.select("doc_id", "lang", "n_chars", F.when(F.col("n") > 0, F.pow(F.lit(10.0), -F.col("log") / F.col("n"))).alias("perplexity"))


def _bounded(rows: DataFrame) -> DataFrame:
    """No query uses this; a test holds it. Rows of the smallest hashes of doc_id, as many as the bounds allow. Sums by the
    hash's leading 16 bits, 65,536 numbers at most, tell where to stop; if already
    the first of them holds too much, the next 16 bits of those rows do."""
    h = F.xxhash64("doc_id")
    for level in range(4):
        part = F.shiftrightunsigned(h, 48 - 16 * level).bitwiseAND(F.lit(65535))
        sums = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect())
        n = chars = stop = 0
        for r in sums:
            n, chars = n + r["n"], chars + r["chars"]
            if n > TRUSTED_DOCS or chars > TRUSTED_CHARS:
                break
            stop = r["part"] + 1
        if stop or not sums:
            return rows.where(part < stop)
        rows = rows.where(part == sums[0]["part"])
    return rows.where("false")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Perplexity, threshold and decision for each row of `docs`.

    docs: doc_id, text, lang; labels: doc_id, quality. Trusted: documents with a label
    of quality 1 and none of 0. The model learns from all trusted documents whose
    crc32(doc_id as text) mod 5 is not 1, whole; the thresholds come from all the other trusted ones.
    Null and empty texts have no perplexity and are not kept. Languages without
    trusted text, null among them, have no perplexity or threshold: nothing speaks
    against their documents, which are kept. Repeated rows and null ids come back as they are;
    other columns are ignored. Very long texts are scored in pieces.
    Returns doc_id, lang, n_chars, perplexity, threshold, keep.
    """
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).where("q = 1").select("_id")
    packs = packed(docs.select("doc_id", "lang", "text"))
    # Trusted are places in packs, so that no text moves to be learned from: few bytes of a pack of 16 million code points.
    pieces = packs.select("pack", F.posexplode("doc_id").alias("at", "doc_id")).where(~held(F.col("doc_id"), 5, 1))
    mine = pieces.join(good, F.col("doc_id") == F.col("_id"), "left_semi").groupBy(F.col("pack").alias("_pack")).agg(F.collect_list("at").alias("trusted"))
    taught = packs.join(F.broadcast(mine), F.col("pack") == F.col("_pack")).select("lang", "size", "body", "trusted")
    grams, contexts = _fit(taught.mapInArrow(_learned, "lang string, g string, c long"))
    scored = materialize(_perplexities(packs, grams, contexts))
    fresh = scored.where(held(F.col("doc_id"), 5, 1)).join(good, F.col("doc_id") == F.col("_id"), "left_semi").where("perplexity IS NOT NULL")
    limit = fresh.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"))
    out = scored.join(F.broadcast(limit), F.col("lang") == F.col("_lang"), "left").drop("_lang")
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("n_chars") > 0))


def op10(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
