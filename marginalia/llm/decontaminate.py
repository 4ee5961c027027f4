"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, units and names become typed placeholders that keep their value beside
them. Windows of the template and of the plain words are hashed and joined with the benchmark's. The first
pass takes a document's windows at every fifth word only: with the benchmark's at every word, a
shared run of WIDTH + STRIDE - 1 words still meets one. Documents found so are
joined at every word, and at each offset so found item and document are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, table

#: Words of a window, and every how many words the first pass takes one.
WIDTH, STRIDE = 8, 5
#: Words of a window for items of fewer than WIDTH + STRIDE - 1 words; all of such an item must be found.
SHORT_WIDTH = 4
#: Words that must be shared, or the whole item if it is shorter.
RUN = 13
#: Words of a run that must not be placeholders, if it is not verbatim.
LITERAL = 4
#: Broadcast tables have at most so many rows of hashes and ids.
BROADCAST_ROWS = 500_000
#: Unit names (fixed values).
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|ft|feet|inch|inches|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|mph|kmh|usd|eur|dollars?|euros?|cents?|percent|degrees?|watts?|volts?|kwh|joules?|mb|gb|tb"
_NUM, _UNIT, _NAME, _INNER = "\u0001", "\u0002", "\u0003", "\u0004"


def tokens(text: Column) -> Column:
    """Words of letters and digits, lower-cased. A placeholder is its mark followed by the value."""
    t = F.coalesce(text, F.lit(""))
    t = F.translate(t, _NUM + _UNIT + _NAME + _INNER, "    ")
    names = F.regexp_replace(t, r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", _NAME + "$1")
    inner = F.regexp_replace(names, r"(?<=\d)[.,:/](?=\d)", _INNER)
    units = F.regexp_replace(inner, rf"(?i)(?<=\d)( ?)({UNITS}|%|€|£|\$)(?![\p{{L}}\p{{N}}])", rf"$1 {_UNIT}$2")
    nums = F.regexp_replace(units, rf"(?<![\p{{L}}\p{{N}}{_INNER}])(\d[\d{_INNER}]*)(?![\p{{L}}\d])", _NUM + "$1")
    marked = F.when(t.rlike(r"\d"), nums).otherwise(names)
    plain = F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}%€£\x01-\x04]+|(?<!{_UNIT})[%€£]", " ")
    return F.filter(F.split(F.trim(plain), " +"), lambda w: w != "")


def _template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w < F.lit(_INNER), F.substring(w, 1, 1)).otherwise(w))


def _value(word: Column) -> Column:
    return F.when(word < F.lit(_INNER), F.substr(word, F.lit(2))).otherwise(word)


def _streams(words: Column) -> Column:
    """The template and, where it has placeholders, the plain words, whose case says nothing."""
    marked = F.exists(words, lambda w: w < F.lit(_INNER))
    return F.when(marked, F.array(_template(words), F.transform(words, _value))).otherwise(F.array(words))


def _hashes(words: Column, width: int, stride: int, counted: bool = False) -> Column:
    """Structs of the place (from 0) and the hash of each window of the streams, if `counted` with
    its literal words. Words and streams are bound to variables, else each window would make them anew."""
    return F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform(_streams(w), lambda t: _windows(t, width, stride, counted)))))


def _windows(stream: Column, width: int, stride: int, counted: bool) -> Column:
    last = F.size(stream) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    more = (lambda own: [_literal(own).alias("n")]) if counted else (lambda own: [])
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(stream, i + 1, width), F.lit(width)).alias("h"), *more(F.slice(stream, i + 1, width))))


def _literal(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w >= F.lit(_INNER)))


def _items(benchmark: DataFrame, item: str) -> DataFrame:
    """item_id, item_hash, words, n_words, width, and `lead`: the first word as it is after a word of lower case."""
    after = F.concat(F.lit("a "), F.regexp_replace("text", r"^[^\p{L}\p{N}]+", ""))
    items = benchmark.where("text IS NOT NULL").select(F.col(item).alias("item_id"), F.xxhash64("text").alias("item_hash"), tokens(F.col("text")).alias("words"), F.get(tokens(after), F.lit(1)).alias("lead"))
    width = F.when(F.size("words") >= WIDTH + STRIDE - 1, WIDTH).otherwise(SHORT_WIDTH)
    return items.distinct().withColumns({"n_words": F.size("words"), "width": width}).where(F.col("n_words") >= SHORT_WIDTH)


def _benchmark(items: DataFrame) -> DataFrame:
    """A row for each window: item_id, item_hash, n_words, width, i_at, h, deep.

    Any window of an item can be the one at a document's fifth word, so the first pass
    takes them all. Only `deep` ones pair places with places: of RUN words with LITERAL
    literal ones, or of such a short item, one window has half of LITERAL at least.
    """
    out = None
    led = F.concat(F.array("lead"), F.slice("words", F.lit(2), F.size("words")))
    for width in (WIDTH, SHORT_WIDTH):
        both = F.concat(_hashes(F.col("words"), width, 1, True), F.slice(_hashes(led, width, 1, True), 1, 1))
        w = items.where(F.col("width") == width).select("item_id", "item_hash", "n_words", "width", F.explode(both).alias("w"))
        w = w.select("item_id", "item_hash", "n_words", "width", F.col("w.at").alias("i_at"), F.col("w.h").alias("h"), (F.col("w.n") >= LITERAL // 2).alias("deep")).distinct()
        w = w if width == WIDTH else w.where("deep")
        out = w if out is None else out.union(w)
    return out


def _compared(words: Column, lead: Column, theirs: Column) -> Column:
    """For each word of the item: how it agrees with the document's ('l' literal and the same,
    'v' a placeholder's value and the same, 't' of one type, '-' not), slot and value."""

    def one(w, i):
        d, own = F.get(theirs, i), F.when(i == 0, lead).otherwise(w)
        same = _value(d) == _value(w)
        typed = (own < F.lit(_INNER)) & (F.substring(own, 1, 1) == F.substring(d, 1, 1))
        how = F.when(same & (w >= F.lit(_INNER)), "l").when(same, "v").when(typed, "t").otherwise("-")
        return F.struct(how.alias("how"), F.when(own < F.lit(_INNER), own).alias("slot"), _value(d).alias("value"))

    return F.transform(words, one)


def _runs(compared: Column) -> Column:
    """The longest stretches of words that agree."""
    how = F.array_join(F.transform(compared, lambda c: c["how"]), "")
    return F.transform(
        F.filter(F.sequence(F.lit(1), F.length(how)), lambda i: (F.substr(how, i, F.lit(1)) != "-") & ((i == 1) | (F.substr(how, i - 1, F.lit(1)) == "-"))),
        lambda i: F.slice(compared, i, F.length(F.regexp_extract(F.substr(how, i), "^[lvt]+", 0))),
    )


def _is_held(run: Column, need: Column) -> Column:
    """Whether a run is long enough, verbatim or with LITERAL literal words and one value for each slot."""
    how = F.array_join(F.transform(run, lambda c: c["how"]), "")
    slots = F.filter(run, lambda c: c["slot"].isNotNull())
    pairs = F.size(F.array_distinct(F.transform(slots, lambda c: F.struct(c["slot"], c["value"]))))
    agree = pairs == F.size(F.array_distinct(F.transform(slots, lambda c: c["slot"])))
    verbatim = F.contains(F.translate(how, "l", "v"), F.repeat(F.lit("v"), need))
    literal = F.length(F.regexp_replace(how, "[^l]", "")) >= LITERAL
    return (F.size(run) >= need) & agree & (verbatim | literal)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows, counted, are few; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """Documents that hold an item of the benchmark, verbatim or with other numbers, units or names.

    docs: doc_id and text; benchmark: `item` and text; other columns are ignored.
    A document holds an item if at one offset min(RUN, words of the item) words or more
    in a row agree: they are the same, case and punctuation aside, or placeholders of
    one type, each of the item's placeholder values in the run standing for one value
    of the document. A run that is not verbatim needs LITERAL literal words. A run is looked
    for where a window (WIDTH words, SHORT_WIDTH for short items) is the same throughout or agrees
    throughout by placeholders. Items of under SHORT_WIDTH words, and null or empty
    texts match nothing. Repeated rows are one document where id and text agree; a
    null doc_id is a value like any other. Returns one row for each document and item:
    doc_id, text_hash, item_id, n_windows (of the longest run), n_words, n_changed
    (placeholders of that run with another value), in no order.
    """
    items = materialize(_items(benchmark, item))
    bench = materialize(_benchmark(items))
    d = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    widths = [r[0] for r in bench.select("width").distinct().collect()]  # two at most
    keys = _small(bench.select("width", F.col("h").alias("_h")).distinct())
    found = None
    for width in sorted(widths):
        at = d.select("doc_id", "text_hash", F.explode(_hashes(tokens(F.col("text")), width, STRIDE if width == WIDTH else 1)).alias("w"))
        hit = at.select("doc_id", "text_hash", F.col("w.h").alias("h")).join(keys, (F.col("h") == F.col("_h")) & (F.col("width") == width), "left_semi").select("doc_id", "text_hash")
        found = hit if found is None else found.union(hit)
    if found is None:
        found = d.select("doc_id", "text_hash").where("false")
    found = materialize(found.distinct())
    near = _small(found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")))
    full = d.join(near, d["doc_id"].eqNullSafe(near["_d"]) & (d["text_hash"] == near["_t"]), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    full = materialize(full.select("doc_id", "text_hash", tokens(F.col("text")).alias("words")))
    rows = None
    for width in sorted(widths):
        at = full.select("doc_id", "text_hash", F.explode(_hashes(F.col("words"), width, 1)).alias("w"))
        at = at.select("doc_id", "text_hash", F.col("w.at").alias("d_at"), F.col("w.h").alias("dh"))
        own = _small(bench.where((F.col("width") == width) & F.col("deep")))
        hit = at.join(own, F.col("dh") == F.col("h")).select("doc_id", "text_hash", "item_id", "item_hash", "n_words", (F.col("d_at") - F.col("i_at")).alias("offset"))
        rows = hit if rows is None else rows.union(hit)
    if rows is None:
        return found.select("doc_id", "text_hash", F.lit(None).cast(benchmark.schema[item].dataType).alias("item_id"), *(F.lit(0).cast("long").alias(c) for c in ("n_windows", "n_words", "n_changed"))).where("false")
    rows = materialize(rows.distinct())
    at = _small(rows.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}))
    theirs = F.transform(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: F.get("words", F.col("offset") + i)).alias("theirs")
    pairs = full.join(at, full["doc_id"].eqNullSafe(at["_d"]) & (full["text_hash"] == at["_t"])).select("doc_id", "text_hash", "item_id", "item_hash", "offset", theirs)
    own = _small(items.withColumnsRenamed({"item_id": "_i", "item_hash": "_h"}))
    pairs = pairs.join(own, pairs["item_id"].eqNullSafe(own["_i"]) & (pairs["item_hash"] == own["_h"]))
    need = F.least(F.lit(RUN), F.col("n_words"))
    # Bound to variables one after the other.
    runs = F.flatten(F.transform(F.array(_compared(F.col("words"), F.col("lead"), F.col("theirs"))), _runs))
    runs = pairs.select("doc_id", "text_hash", "item_id", "offset", "n_words", "width", need.alias("need"), F.explode(runs).alias("run"))
    runs = runs.where(F.size("run") >= F.col("need")).where(_is_held(F.col("run"), F.col("need")))
    changed = F.size(F.array_distinct(F.transform(F.filter("run", lambda c: c["how"] == "t"), lambda c: c["slot"])))
    best = F.struct(F.size("run").alias("n"), (-changed).alias("less"), (-F.col("offset")).alias("before"), "n_words", "width")
    out = runs.groupBy("doc_id", "text_hash", "item_id").agg(F.max(best).alias("best"))
    return out.select("doc_id", "text_hash", "item_id", (F.col("best.n") - F.col("best.width") + 1).cast("long").alias("n_windows"), F.col("best.n_words").cast("long").alias("n_words"), (-F.col("best.less")).cast("long").alias("n_changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """`docs` without the rows that hold an item; every other row and column stays."""
    d, t = fresh(docs, "_d", "_t")
    bad = materialize(matches(docs, benchmark, item).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t)).distinct())
    return docs.join(_small(bad), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left_anti")


def op6(spark, sf_dir):
    out = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash")
