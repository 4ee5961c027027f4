"""LM scoring with a weighted backoff automaton.

The automaton of a trigram model has a state for each pair of words that was seen, one
for each word, and the root. A state has an arc for each word that was seen behind it, and a
failure arc: from a pair to its last word, from a word to the root, which has an arc for every
word. A text is one walk from left to right: the state is the longest of the last words that the
model knows; where it has no arc for the next word, the failure arcs' weights are paid on the
way down to a state that has one.

No task could hold the automaton whole. Documents are packed; a pack asks
the shards of the count table for its own n-grams, which builds the part of the
automaton its documents can reach, and traverses each document once, left to right.
What is counted, asked and answered grows with the corpus; it moves as packed arrays,
a distinct n-gram once for each pack, so a word or pair that is everywhere loads no shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, held, materialize, parts, raw, table

#: Text bytes of a pack; words of a segment (longer documents lie in several packs); words of the corpus for each shard.
PACK_BYTES, SEGMENT, SHARD = 8 << 20, 1 << 20, 2_000_000
#: Packs that one task works on.
PACKS = 4
#: Weights among which the weight of the lower order in a state is found, in tokens.
WEIGHTS = 2.0 ** np.arange(-8, 25)
END, BEGIN = np.uint64(0x7F4A7C159E3779B9), np.uint64(0x1CE4E5B9BF58476D)
_PACK = "pack long, row array<long>, doc_id array<long>, held array<boolean>, size array<int>, prev array<array<long>>, words int, vocab binary, ids binary"
_ASK = "shard long, kind int, pack long, n int, keys binary, counts binary"
_SAY = "pack long, kind int, shard long, totals binary, types long, tokens long, ones long, left array<double>"
#: Bytes of a key within its shard.
_WIDE = 6


def _schema(kinds: dict) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def _packs(batches):
    schema = _schema({"pack": pa.int64(), "row": pa.list_(pa.int64()), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "size": pa.list_(pa.int32()), "prev": pa.list_(pa.list_(pa.int64())), "words": pa.int32(), "vocab": pa.binary(), "ids": pa.binary()})
    part, made, rows = TaskContext.get().partitionId(), 0, 0
    known: dict[bytes, int] = {}
    segments: list[tuple] = []
    size = 0

    def pack():
        words = np.concatenate([s[4] for s in segments])
        vocab, ids = np.unique(words, return_inverse=True)
        cols = [[(part << 32) + made], *([[s[k] for s in segments]] for k in (0, 1, 2)), [[len(s[4]) for s in segments]], [[s[3] for s in segments]], [len(vocab)], [_sorted(vocab)], [_places(ids)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc, out, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), raw(batch["text"]), strict=True):
            words = (text or b"").lower().split()
            row, prev = (part << 40) + rows, [int(BEGIN.view(np.int64))]
            rows += 1
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for at in range(0, max(1, len(words)), SEGMENT):
                piece = words[at : at + SEGMENT]
                for w in set(piece).difference(known):
                    known[w] = xxhash.xxh3_64_intdigest(w)
                h = np.fromiter(map(known.__getitem__, piece), np.uint64, len(piece))
                if at + SEGMENT >= len(words):
                    h = np.append(h, END)
                segments.append((row, doc, out, prev, h))
                prev = [*prev, *h[-2:].view(np.int64).tolist()][-2:]
                size += 8 * len(piece)
                if size > PACK_BYTES:
                    yield pack()
                    made, segments, size = made + 1, [], 0
    if segments:
        yield pack()


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of an n-gram from that of its beginning and that of its last word."""
    key = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(29))


class Pack:
    """The tokens of a pack with the states before them, and its distinct n-grams.

    `word`, `pair` and `triple` are, for each token, the places of the n-grams that end
    there in `keys`; `one` and `two` those of the words before it (the last, the last two).
    `two` and `triple` are -1 where a document has no two words before the token."""

    def __init__(self, row: dict):
        self.row, self.doc_id, self.held, self.size = (row[c] for c in ("row", "doc_id", "held", "size"))
        vocab, ids = _unsorted(row["vocab"], row["words"]), _unplaced(row["ids"])
        last = np.array([p[-1] for p in row["prev"]], np.int64).view(np.uint64)
        far = np.array([p[0] for p in row["prev"]], np.int64).view(np.uint64)
        deep = np.array([len(p) > 1 for p in row["prev"]], bool)
        size = np.array(self.size, np.int64)
        start = np.cumsum(size) - size
        words = np.union1d(vocab, np.concatenate([last, far, [BEGIN]]))
        n = len(words)
        self.word = np.searchsorted(words, vocab)[ids]
        self.one = np.empty_like(self.word)
        self.one[1:] = self.word[:-1]
        self.one[start] = np.searchsorted(words, last)
        self.train = np.repeat(~np.array(self.held, bool), size)
        # Pairs of the tokens, and those that stand before a segment.
        code = self.one * n + self.word
        before = np.searchsorted(words, far) * n + self.one[start]
        pairs, at = np.unique(np.concatenate([code, before[deep]]), return_inverse=True)
        self.pair = at[: len(code)]
        self.two = np.empty_like(self.word)
        self.two[1:] = self.pair[:-1]
        self.two[start] = -1
        self.two[start[deep]] = at[len(code) :]
        pair_keys = _joined(words[pairs // n], words[pairs % n])
        there = self.two >= 0
        triples, at = np.unique(self.two[there] * n + self.word[there], return_inverse=True)
        self.triple = np.full(len(code), -1)
        self.triple[there] = at
        self.keys = (words, pair_keys, _joined(pair_keys[triples // n] + END, words[triples % n]))

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and own training counts: of words (as the begin, documents count), of pairs, of triples."""
        words, pairs, triples = self.keys
        word = np.bincount(self.word[self.train], minlength=len(words))
        begin = np.searchsorted(words, BEGIN)
        word[begin] = (self.one[self.train] == begin).sum()
        pair = np.bincount(self.pair[self.train], minlength=len(pairs))
        triple = np.bincount(self.triple[self.train & (self.triple >= 0)], minlength=len(triples))
        return [(words, word), (pairs, pair), (triples, triple)]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards hold ranges of keys, so that sorted keys are sorted by shard."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _offset(keys: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """Keys within their shard, in _WIDE bytes."""
    start = np.uint64(-(-(shard << 32) // shards) << 32)
    return (keys - start) >> np.uint64(max(0, 66 - shards.bit_length() - 8 * _WIDE))


def _sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as their differences, byte by byte from the lowest; the upper bytes hold
    little and are compressed. The first byte tells how many of the lower ones are as they are."""
    planes = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    whole = int(np.median(np.diff(x))).bit_length() // 8 if len(x) > 1 else 8
    return bytes([whole]) + np.ascontiguousarray(planes[:whole]).tobytes() + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes[whole:]).tobytes())


def _unsorted(x: bytes, n: int) -> np.ndarray:
    out = np.empty((n, 8), np.uint8)
    whole = x[0]
    out[:, :whole] = np.frombuffer(x, np.uint8, n * whole, 1).reshape(whole, n).T
    rest = zstandard.ZstdDecompressor().decompress(x[1 + n * whole :])
    out[:, whole:] = np.frombuffer(rest, np.uint8).reshape(8 - whole, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _places(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaced(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as hold them; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or x.max() < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


def _ask(shards: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for kind, (keys, counts) in enumerate(Pack(row).asked()):
                    order = np.argsort(keys)
                    keys, counts = keys[order], counts[order]
                    shard = _shard(keys, shards)
                    cut = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
                    for s, e in zip(cut, cut[1:], strict=False):
                        if e > s:
                            k = int(shard[s])
                            rows.append((k, kind, row["pack"], e - s, _sorted(_offset(keys[s:e], k, shards)), _narrow(counts[s:e])))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "kind", "pack", "n", "keys", "counts"])

    return run


def _say(shards: int):
    """Adds up a shard and answers each pack in the order in which it asked."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
        shard, kind = key[0].as_py(), key[1].as_py()
        sizes = asked["n"].to_pylist()
        keys = np.concatenate([_unsorted(k, n) for k, n in zip(asked["keys"].to_pylist(), sizes, strict=True)])
        counts = np.concatenate([_wide(c) for c in asked["counts"].to_pylist()]).astype(np.int64)
        distinct, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
        answer = np.split(total[inverse], np.cumsum(sizes)[:-1])
        own = total > 0
        if kind == 0 and _shard(np.array([BEGIN]), shards)[0] == shard:
            own &= distinct != _offset(np.array([BEGIN]), shard, shards)[0]
        seen = total[total > 0].astype(np.float64)
        times, many = np.unique(seen, return_counts=True)
        left = [float((many * times * w / (times + w)).sum()) for w in WEIGHTS] if kind < 2 else []
        first = [1] + [0] * (len(sizes) - 1)

        def once(x):
            return pa.array([int(x) * f for f in first], pa.int64())

        cols = {"pack": asked["pack"], "kind": asked["kind"], "shard": asked["shard"], "totals": pa.array([_narrow(a) for a in answer], pa.binary())}
        cols |= {"types": once(own.sum()), "tokens": once(total[own].sum()), "ones": once((total == 1).sum())}
        return pa.table(cols | {"left": pa.array([left] + [[]] * (len(sizes) - 1), pa.list_(pa.float64()))})

    return run


def weight_of(left: list[float], ones: int) -> float:
    """The weight w of the lower order for which what states leave to it, the sum of
    c * w / (c + w) over the states' counts c, is the number of n-grams that were seen
    once: as many tokens as, by Good and Turing, the next such text has of n-grams not seen."""
    if not left or ones <= left[0]:
        return float(WEIGHTS[0])
    if ones >= left[-1]:
        return float(WEIGHTS[-1])
    return float(f"{2 ** np.interp(np.log(ones), np.log(left), np.log2(WEIGHTS)):.4g}")


def _traverse(tokens: int, types: int, weights: tuple[float, float]):
    def run(key, packs: pa.Table, said: pa.Table) -> pa.Table:
        p = Pack(packs.to_pylist()[0])
        kind, shard, totals = said["kind"].to_numpy(), said["shard"].to_numpy(), said["totals"]
        count = []
        for k, keys in enumerate(p.keys):
            mine = np.flatnonzero(kind == k)
            out = np.empty(len(keys), np.float64)
            if len(keys):
                out[np.argsort(keys)] = np.concatenate([_wide(totals[int(i)].as_py()) for i in mine[np.argsort(shard[mine])]])
            count.append(out)
        word, pair, triple = count
        w1, w2 = weights
        root = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
        # Failure arcs of states; one that was never seen is left at no cost.
        fail1, fail2 = np.log10(w1 / (word + w1)), np.log10(w2 / (pair + w2))
        # The walk of all texts of the pack: what each token's step costs from the root, from
        # the state of the word before it, and from that of the two words before it.
        step = root[p.word]
        arc = np.log10((pair[p.pair] + w1 * 10**step) / (word[p.one] + w1))
        step = np.where(pair[p.pair] > 0, arc, fail1[p.one] + step)
        at = np.flatnonzero(p.two >= 0)
        seen, state = triple[p.triple[at]], p.two[at]
        arc = np.log10((seen + w2 * 10 ** step[at]) / (pair[state] + w2))
        step[at] = np.where(seen > 0, arc, fail2[state] + step[at])
        size = np.array(p.size)
        start = np.cumsum(size) - size
        sums = [np.add.reduceat(x, start) for x in (root[p.word], step, (word[p.word] > 0).astype(np.int64))]
        return pa.table({"row": pa.array(p.row, pa.int64()), "doc_id": pa.array(p.doc_id, pa.int64()), "held_out": pa.array(p.held, pa.bool_()), "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(sums[2], pa.int64()), "base_score": pa.array(sums[0], pa.float64()), "score": pa.array(sums[1], pa.float64())})

    return run


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1) -> DataFrame:
    """Log10 probabilities of whole texts under a trigram model of the others.

    docs: doc_id (integer) and text; other columns are ignored. The model learns from
    rows whose crc32(doc_id as text) mod `modulus` is not `remainder`; a null id
    counts as learned from. Tokens: words between ASCII white space with A-Z
    lower-cased, then one end. A null text is empty: only the end. The root gives a
    token (c + 0.5) / (N + 0.5 (V + 1)); the state of a word adds w1 times that to the counts
    of what followed the word, that of a pair w2 times the former. Both weights come from the
    training counts alone (weight_of). Very long texts are walked in segments. Each row is
    scored, repeated rows too; an empty table gives no rows. Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score (the root alone), score.
    """
    least = parts(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id"), modulus, remainder).alias("held"), "text")
    packs = materialize(plain.mapInArrow(_packs, _PACK))
    words, n = packs.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)), F.count("*")).collect()[0]
    shards = max(least, int((words or 0) // SHARD) + 1)
    tasks = max(least, n // PACKS)
    asked = packs.mapInArrow(_ask(shards), _ASK).repartition(max(least, shards), "shard", "kind")
    said = materialize(asked.groupBy("shard", "kind").applyInArrow(_say(shards), _SAY))
    # One row for each shard and kind has sums; those of `left` are few numbers.
    sums = said.where(F.size("left") > 0).select("kind", F.posexplode("left").alias("at", "x")).groupBy("kind", "at").agg(F.sum("x").alias("x")).collect()
    left = [[r["x"] for r in sorted(sums) if r["kind"] == kind] for kind in (0, 1)]
    counts = {r["kind"]: r for r in said.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("types", "tokens", "ones"))).collect()}
    types, tokens = (counts[0]["types"], counts[0]["tokens"]) if 0 in counts else (0, 0)
    weights = tuple(weight_of(left[k], counts[k + 1]["ones"] if k + 1 in counts else 0) for k in (0, 1))
    answers = said.select("pack", "kind", "shard", "totals").repartition(tasks, "pack")
    both = packs.repartition(tasks, "pack").groupBy("pack").cogroup(answers.groupBy("pack"))
    out = both.applyInArrow(_traverse(tokens, types, weights), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
