"""Token counts by a public tokenizer.

Texts are encoded in Arrow functions that return lengths only. Documents are cut
at boundaries that no token can cross, and each distinct piece is encoded once per
worker; pieces go to the library in batches of about equal bytes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes that one call to the library encodes.
BATCH_BYTES = 1 << 20
#: Bytes of pieces that a worker remembers before it forgets them all, and of a piece that is remembered.
CACHE_BYTES, CACHE_PIECE = 16 << 20, 64
_OUT = "n_bytes long, n_tokens long"


class SentencePieceCounter:
    """Counts as ``encode`` of the whole text would, without begin or end.

    Where the vocabulary has no piece with a space mark after another character,
    and none with a line feed beside another character, no merge crosses the
    place before a run of space marks or a line feed. A text is then the sum of its pieces.
    A piece is encoded behind a line feed, so that the mark that the library puts
    before every text stays apart; these two tokens are taken off again.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = all("▁" not in p.lstrip("▁") and ("\n" not in p or p == "\n") for p in pieces)
        probe = ["\n", "\n\n", " a\n b", "a  b", "\r\n"]
        self.safe = plain and all(self._whole(p) == self._cut(p) for p in probe)
        self.known: dict[str, int] = {}
        self.size = 0

    _piece = re.compile("\n|[ ▁]+[^ ▁\n]*|[^ ▁\n]+")

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def _cut(self, text: str) -> int:
        return sum(1 if p == "\n" else self._whole("\n" + p) - 2 for p in self._piece.findall(" " + text)) if text else 0

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [self._whole(t) for t in texts]
        cut = [self._piece.findall(" " + t) if t else [] for t in texts]
        if self.size > CACHE_BYTES:
            self.known, self.size = {}, 0
        self.known["\n"] = 1
        now: dict[str, int] = {}  # of pieces too long to be remembered
        new = [p for p in set().union(*cut) if p not in self.known]
        for part in _batches(new):
            for p, ids in zip(part, self.model.encode(["\n" + p for p in part], num_threads=1), strict=True):
                if len(p) > CACHE_PIECE:
                    now[p] = len(ids) - 2
                else:
                    self.known[p] = len(ids) - 2
                    self.size += len(p) + 100
        both = self.known | now if now else self.known
        return [sum(map(both.__getitem__, ps)) for ps in cut]


def _batches(texts: list[str]):
    """The texts in runs of about BATCH_BYTES; a longer one is a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        n = len(t.encode("utf-8", "surrogatepass"))
        if run and size + n > BATCH_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


class TokenizersCounter:
    """The `tokenizers` library; whole texts, special strings read as its default does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for part in _batches(texts) for e in self.model.encode_batch(part, add_special_tokens=False)]


_open: dict[str, object] = {}


def counter(path: str):
    if path not in _open:
        _open[path] = TokenizersCounter(path) if path.endswith(".json") else SentencePieceCounter(path)
    return _open[path]


def _count(path: str):
    def run(batches):
        c = counter(path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for part in _batches([t or "" for t in batch["text"].to_pylist()]):
                n_bytes += [len(t.encode()) for t in part]
                n_tokens += c.counts(part)
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`.

    A null text counts as empty: no bytes, no tokens. Rows that repeat and null ids
    come back as they are; other columns are ignored. `path` is a file of the
    `tokenizers` (.json) or `sentencepiece` (.model) library, on every executor.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(_count(path), f"doc_id {kind}, {_OUT}")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
