"""N-gram Jaccard join: exact links between shingle sets, and their components.

Sets are compared as sorted arrays of 64-bit shingle hashes; equal sets are one
class and take part once. In hash order, two sets that link share their first
hashes: each keeps `len - ceil(t * len) + l` of them, its prefix, of which at least
l are common. A set too few of whose prefix hashes occur elsewhere has no
partner, which leaves few candidates of any corpus.

The others meet in blocks, one for each hash of their shorter prefixes. First
each member is compared with the block's pivot, which joins groups of copies
without comparing their pairs. Blocks that then still hold several components are
joined by signature trees: nodes hold the OR of token bitmaps and the range of
sizes, and a dual traversal drops node pairs whose greatest possible overlap is too
small. What reaches the leaves, in different components, is compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, fresh, materialize, parts, raw, table

#: Part of a set's size that its prefix is longer than the shortest that is exact.
EXTRA = 0.15
#: Bits of a token bitmap, children of a tree node, members of a block that one task takes at once.
BITS, FAN, BLOCK = 4096, 8, 512
_K = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the word n-grams; all words as one if they are fewer."""
        words = (text or b"").lower().split()
        if not words:
            return np.zeros(0, np.int64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = len(words) - self.width + 1
        out = h[:size].copy()
        for i in range(1, self.width):
            out = (out ^ (out >> np.uint64(29))) * _K + h[i : i + size]
        out = (out ^ (out >> np.uint64(32))) * _K
        return np.unique((out ^ (out >> np.uint64(29))).view(np.int64))


def _least(n: int, percent: int) -> int:
    """Of n members, those that a partner must have."""
    return -(-percent * n // 100)


def _extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def _signatures(width: int, percent: int):
    def run(batches):
        shingles = Shingler(width)
        seen: set[int] = set()
        for batch in batches:
            n, sid, prefix, cut = [], [], [], []
            for text in raw(batch["text"]):
                s = shingles(text)
                n.append(len(s))
                sid.append(_name(s))
                if len(seen) > CACHE_ENTRIES:
                    seen.clear()
                again = sid[-1] in seen
                seen.add(sid[-1])
                short = len(s) - _least(len(s), percent)
                prefix.append(s[:0] if again else s[: short + _extra(len(s))])
                cut.append(s[short].item() if len(s) else None)
            sizes = np.cumsum([0, *map(len, prefix)])
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(cut, pa.int64()), lists], names=["doc_id", "n", "sid", "cut", "prefix"])

    return run


def _name(s: np.ndarray) -> int:
    """What a set goes by."""
    return np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64).item()


def _packed(batches):
    """Texts as they travel, compressed."""
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        texts = [pack(t or b"") for t in raw(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.binary())], names=["doc_id", "text"])


def _full(width: int):
    """Members of the sets that were asked for; of texts that only share an id, nothing comes."""

    def run(batches):
        shingles = Shingler(width)
        for batch in batches:
            sets = [shingles(zstandard.ZstdDecompressor().decompress(t)) for t in batch["text"].to_pylist()]
            own = [_name(x) == sid for x, sid in zip(sets, batch["sid"].to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch["sid"], pa.array([x.tobytes() for x in sets], pa.binary())], names=["sid", "members"])
            yield out.filter(pa.array(own, pa.bool_()))

    return run


def _compare(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    x = full.select(F.col("sid").alias("a"), F.col("members").alias("x"))
    y = full.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v and root, the smallest vertex reachable, for each vertex of the edges a, b.

    Every vertex takes its smallest neighbour; paths are shortened and the edges
    between what came together drop. Rounds grow with the logarithm of the vertices.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up")).select("v", F.least("v", "up").alias("up"))
        up = materialize(up)
        for _ in range(2):
            top = up.select(F.col("v").alias("_v"), F.col("up").alias("_up"))
            up = up.join(top, F.col("up") == F.col("_v"), "left").select("v", F.coalesce("_up", "up").alias("up"))
        up = materialize(up)
        to = up.select(F.col("v").alias("_v"), F.col("up").alias("_up"))
        found = up.select("v", F.col("up").alias("root")) if found is None else found.join(to, F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_up", "root").alias("root"))
        moved = edges.join(to, F.col("a") == F.col("_v")).select(F.col("_up").alias("a"), "b").join(to, F.col("b") == F.col("_v")).select("a", F.col("_up").alias("b"))
        edges = materialize(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = materialize(found)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")) if found is None else found


def _bitmap(members: bytes) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[np.frombuffer(members, np.uint64) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits).tobytes()


def _with_bitmaps(batches):
    for batch in batches:
        maps = [_bitmap(m) for m in batch["members"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["sid"], pa.array(maps, pa.binary())], names=["sid", "bits"])


def _pop(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """Levels from the members up: (bitmaps, least size, greatest size, most tokens that share a bit)."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.levels = [(bits, n, n, n - _pop(bits))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, more = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(more, at)))


def _children(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children of node pairs, each once; `size`: nodes of the lower level."""
    step = np.arange(FAN)
    p, q = np.broadcast_arrays(i[:, None, None] * FAN + step[:, None], j[:, None, None] * FAN + step)
    p, q = p.ravel(), q.ravel()
    inside = (p <= q) & (q < size)
    return p[inside], q[inside]


def dual_traversal(bits: np.ndarray, n: np.ndarray, percent: int, skip=None) -> np.ndarray:
    """Index pairs i < j of members whose greatest possible overlap reaches the
    threshold. `skip(i, j)` tells of leaf pairs that are not wanted. Node pairs wait
    on a stack in bundles, so that few are open at once."""
    tree = Tree(bits, n)
    found = [np.zeros((0, 2), np.int64)]
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if level < 0:  # pairs that were found wide enough before
            level = ~level
            if len(i) > 64:
                stack.append((~level, i[64:], j[64:]))
            stack.append((level - 1, *_children(i[:64], j[:64], len(tree.levels[level - 1][1]))))
            continue
        b, lo, hi, more = tree.levels[level]
        keep = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        if level == 0:
            keep &= i < j
            if skip is not None:
                keep &= ~skip(i, j)
        i, j = i[keep], j[keep]
        both = b[i] & b[j]
        most = _pop(both) + np.minimum(more[i], more[j])
        if level == 0:  # tokens of either side whose bit the other side lacks are not common
            most = np.minimum(most, np.minimum(n[i] - _pop(b[i] & ~both), n[j] - _pop(b[j] & ~both)))
        keep = (100 + percent) * np.minimum(most, np.minimum(hi[i], hi[j])) >= percent * (lo[i] + lo[j])
        i, j = i[keep], j[keep]
        if level == 0:
            found.append(np.stack((i, j), 1))
            continue
        # Children of the first bundle go on; the rest of the node pairs waits as it is.
        if len(i) > 64:
            stack.append((~level, i[64:], j[64:]))
            i, j = i[:64], j[:64]
        stack.append((level - 1, *_children(i, j, len(tree.levels[level - 1][1]))))
    return np.concatenate(found)


def _blocks(percent: int):
    """Candidate pairs of blocks; rows come sorted by block."""

    def join(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        sid, n, comp = (t[c].to_numpy() for c in ("sid", "n", "comp"))
        bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(sid), BITS // 64)
        order = np.lexsort((n, *(bits[:, k] for k in range(4))))
        sid, n, comp, bits, part = sid[order], n[order], comp[order], bits[order], t["part"].to_numpy()[order]
        across = t["i"][0].as_py() != t["j"][0].as_py()
        ij = dual_traversal(bits, n, percent, lambda i, j: (comp[i] == comp[j]) | (across & (part[i] == part[j])))
        # A pair that meets in several blocks belongs to that of the least hash.
        lead, token = [np.array(x, np.int64) for x in t["lead"].to_pylist()], t["token"][0].as_py()
        first = token == np.array([x[0] for x in lead])[order]
        mine = first[ij[:, 0]] | first[ij[:, 1]]  # the least of either side is the least of both
        for k in np.flatnonzero(~mine):
            x, y = lead[order[ij[k, 0]]], lead[order[ij[k, 1]]]
            x, y = x[x <= token], y[y <= token]
            mine[k] = len(np.intersect1d(x, y, True)) == 1
        ij = ij[mine]
        a, b = sid[ij[:, 0]], sid[ij[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch[c].to_numpy() for c in ("token", "i", "j")], 1)
            cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for s, e in zip(cut, cut[1:], strict=False):
                mine = tuple(k[s].tolist())
                if mine != key and held:
                    yield join(held)
                    held = []
                key = mine
                held.append(batch.slice(s, e - s))
        if held:
            yield join(held)

    return run


def spanning_links(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Classes of the join, and links that connect what its links connect.

    docs: doc_id (integer) and text. A document's set: the distinct `width`-word
    shingles of its words (between ASCII white space, A-Z lower-cased); fewer words
    are one shingle, none an empty set. Sets link where 100 * common >= percent * united.
    Returns (classes, links): doc_id, n, sid for every row, where sid names the set;
    and a, b, linked pairs of sids of different sets. Equal sets share a sid; empty ones have
    n 0 and never link. Each pair is a link, and linked sets are connected by pairs, but
    not every link is listed, so links of a document can't be counted here. Hashes have 64 bits. Null texts are empty; repeated rows are copies.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = materialize(plain.mapInArrow(_signatures(width, percent), "doc_id long, n long, sid long, cut long, prefix array<long>"))
    classes = sigs.select("doc_id", "n", "sid")
    # `cut` is the last hash of a set's shorter prefix; `times`, how often its prefix is in the table.
    reps = sigs.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("cut").alias("cut"), F.sum((F.size("prefix") > 0).cast("int")).alias("times"))
    tokens = sigs.select("sid", F.explode("prefix").alias("token"))
    common = tokens.groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("token")
    shared = materialize(tokens.join(common, "token", "left_semi"))
    must = F.greatest(F.lit(1), F.floor(F.ceil(F.lit(percent) * F.col("n") / 100) * EXTRA))
    alive = shared.groupBy("sid").agg(F.count("*").alias("k")).join(reps, "sid").withColumn("k", F.col("k") / F.col("times")).drop("times")
    alive = materialize(alive.where(F.col("k") >= must))
    # The member of whose prefix the most is common is the likeliest to be near all others.
    block = shared.join(alive.drop("rep"), "sid").where("token <= cut").select("token", "sid", "n", (F.col("k") / F.col("n")).alias("weight")).distinct()
    # Which sets have a candidate grows with the corpus: the texts are shuffled to them at every size.
    texts = plain.mapInArrow(_packed, "doc_id long, text binary")
    texts = texts.join(alive.select("sid", "rep").hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("sid", "text")
    full = materialize(texts.mapInArrow(_full(width), "sid long, members binary").dropDuplicates(["sid"]))

    pivot = block.groupBy("token").agg(F.max(F.struct("weight", "sid", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
    block = materialize(block.join(pivot, "token").select("token", "sid", "n", "size", F.col("p.sid").alias("p_sid"), F.col("p.n").alias("p_n")))
    near = block.where("sid <> p_sid").where((100 * F.col("n") >= percent * F.col("p_n")) & (100 * F.col("p_n") >= percent * F.col("n")))
    pairs = near.select(F.col("p_sid").alias("a"), F.col("sid").alias("b")).distinct()
    first = materialize(_verify(pairs, full, percent))

    comp = components(first).withColumnRenamed("v", "_v")
    placed = block.join(comp, F.col("sid") == F.col("_v"), "left").select("token", "sid", "n", "size", F.coalesce("root", "sid").alias("comp"))
    placed = materialize(placed)
    # Of blocks with the same members, that of the least hash is enough.
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.hash("sid")).alias("y")).where("lo <> hi")
    mixed = mixed.groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token")
    maps = full.mapInArrow(_with_bitmaps, "sid long, bits binary")
    # A block of more than BLOCK members is cut into parts; each pair of parts is a task's work.
    cuts = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), cuts).cast("int")
    ways = F.explode(F.transform(F.sequence(F.lit(0), cuts - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), mine.alias("part")))).alias("ij")
    blocks = materialize(placed.join(mixed, "token", "left_semi"))
    lead = blocks.groupBy("sid").agg(F.array_sort(F.collect_list("token")).alias("lead"))
    rows = blocks.select("token", "sid", "n", "comp", ways).select("token", "ij.*", "sid", "n", "comp").join(maps.join(lead, "sid"), "sid")
    rows = rows.select("token", "i", "j", "part", "sid", "n", "comp", "bits", "lead").repartition(parts(docs.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    more = rows.mapInArrow(_blocks(percent), "a long, b long").distinct()
    second = _verify(more, full, percent)
    return classes, materialize(first.union(second).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links,
    for every row of `docs`. Documents with an empty set stand alone; a null doc_id
    counts only where a group has no other."""
    classes, edges = spanning_links(docs, width, percent)
    comp = components(edges)
    least = classes.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = least.join(comp, F.col("sid") == F.col("v"), "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    named = materialize(named)
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(roots, "root").select(F.col("sid").alias("_sid"), "component_id")
    out = classes.join(of, (F.col("sid") == F.col("_sid")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with the document of the smallest doc_id of each group; of repeated
    rows all stay, as do documents without words."""
    (name,) = fresh(docs, "_gone")
    gone = groups(docs, width, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(materialize(gone), F.col("doc_id") == F.col(name), "left_anti")


def op4(spark, sf_dir):
    return groups(table(spark, sf_dir, "documents"))
