import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, html_text, language_id, line_dedup, lm_score, mixing, ngram_join, quality, queries, token_counts
from marginalia.llm.common import table
from tests.conftest import SF, rows_of

from . import helpers as h


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_names(spark):
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


# Line dedup


def dropped(texts, min_docs, keep):
    """(doc, place) of the lines that go, and what is left, by counting."""
    where = defaultdict(list)
    for i in sorted(texts, key=lambda i: (i is not None, i)):
        for place, k in enumerate(h.keys(texts[i])):
            if k:
                where[k].append((i, place))
    gone = set()
    for at in where.values():
        if len({i for i, _ in at}) >= min_docs:
            gone |= set(at[1:] if keep == "first" else at)
    return gone


def test_line_dedup_matches_sql(spark, duck):
    got = line_dedup.op1(spark, SF).toPandas()
    want = duck.sql(line_dedup.OP1_SQL).df()
    assert rows_of(got, sorted(want.columns)) == rows_of(want, sorted(want.columns))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("batch", [3, 10000])
def test_line_dedup_edges(spark, keep, batch):
    texts = {i: f"Head \n line {i}\n\n  HEAD\nrare {i // 2}\nlong " + "x" * (20000 if i == 3 else 2) for i in range(12)} | {12: None, 13: "", 14: "é\nÉ", 15: "\x0bhead\t"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for least in (2, 5, 12):
            gone = dropped(texts, least, keep)
            out = line_dedup.dedup_lines(h.documents(spark, texts.items()), least, 1, keep)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "key"]
            got = {r["doc_id"]: r["text"] for r in out.collect()}
            want = {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in texts.items()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_line_dedup_sql_counts_rows(spark, duck, monkeypatch):
    """The SQL and the operator agree on rows that repeat: each counts."""
    import duckdb

    rows = [(1, "a\nb")] * 12 + [(2, "c\na"), (3, None), (None, "x\nA ")]
    df = h.documents(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(line_dedup.OP1_SQL).df()
    monkeypatch.setattr("marginalia.llm.common.table", lambda *_: df)
    got = line_dedup.op1(spark, "").toPandas()
    assert rows_of(got.astype({"doc_id": "Int64"}), sorted(want.columns)) == rows_of(want.astype({"doc_id": "Int64"}), sorted(want.columns)) and set(got.n_dropped) == {0, 1, 2}


def test_line_dedup_repeats_and_empty(spark):
    again = h.documents(spark, [(1, "a\nb"), (1, "a\nb"), (None, "a\nc"), (2, "d")])
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(again, 3).collect())
    assert got == [(0, "c"), (1, "b"), (1, "b"), (2, "d")]
    assert line_dedup.dedup_lines(again.where("false")).collect() == []


# Language


def test_language_held_out(spark, docs):
    got = language_id.op2(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert len(got) == docs.count() and (out.lang_pred == out.lang).mean() > 0.97
    assert all(h.crc(i, 3) == 1 for i in out.doc_id) and got.score.between(0, 1).all()


def test_language_edges(spark):
    train = h.documents(spark, [(1, "the cat and the dog"), (2, "the house")]).union(h.documents(spark, [(3, "der Hund und die Katze")], lang="de"))
    model = language_id.fit(train.union(h.documents(spark, [(4, None), (5, "...")])))
    ask = h.documents(spark, [(1, None), (2, ""), (3, "123 !"), (4, "und der Hund"), (5, "the dog " * 300_000), (4, "und der Hund")])
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(ask, model, [F.col("doc_id")]).collect()]
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")]
    none = language_id.fit(train.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(ask, none, []).collect()} == {"und"}


def test_language_letters_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL", 1 << 10)
    train = spark.createDataFrame([(i, f"word{i}", f"l{i:02}") for i in range(10)] + [(99, "common word", "l03")], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert len(model.langs) == 4 and "l03" in model.langs and len(model.weights) == 256
    ask = h.documents(spark, [(1, "½ ² Ⅷ ٣ _ 7"), (2, "ª"), (3, "漢")])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(ask, model, [F.col("doc_id")]).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"


def test_language_pieces_are_whole(monkeypatch):
    text = "Straße für alle, " * 40
    whole = Counter(x for ids in language_id.buckets(text) for x in ids.tolist())
    monkeypatch.setattr(language_id, "PIECE", 17)
    assert Counter(x for ids in language_id.buckets(text) for x in ids.tolist()) == whole


# N-gram Jaccard join


def test_ngram_join_matches_brute_force(spark, texts):
    want = h.components({i: h.shingles(t) for i, t in texts.items()})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op4(spark, SF).collect()}
    assert got == {i: (len(h.shingles(texts[i])), want[i]) for i in texts}


def test_ngram_join_chains_and_edges(spark):
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = {0: None, 1: "", 2: "  \n", 3: "one two", 4: "ONE  two", 5: "one two three"}
    for i in range(40):  # copies that drift away from the first
        base[(7 * i) % 160] = f"v{i}"
        texts[10 + i] = " ".join(base)
    for i in range(30):  # copies of one text with a few edits each
        own = base[:]
        for _ in range(rng.randrange(5)):
            own[rng.randrange(160)] = f"u{rng.randrange(10**6)}"
        texts[100 + i] = " ".join(own)
    texts[200] = texts[10]
    want = h.components({i: h.shingles(t) for i, t in texts.items()})
    docs = h.documents(spark, texts.items())
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.groups(docs).collect()} == want
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i in texts if want[i] == i}
    assert ngram_join.groups(docs.where("false")).collect() == []


def test_ngram_join_spanning_links(spark):
    words = [f"w{k}" for k in range(300)]
    texts = {i: " ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(20, 280, 20)}
    sets = {i: h.shingles(t) for i, t in texts.items()}
    classes, links = ngram_join.spanning_links(h.documents(spark, texts.items()))
    of = {r["sid"]: r["doc_id"] for r in classes.collect()}
    pairs = {(of[r["a"]], of[r["b"]]) for r in links.collect()}
    assert all(100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) for a, b in pairs)
    seen = {20}
    for _ in texts:
        seen |= {x for p in pairs if seen & set(p) for x in p}
    assert seen == set(texts)


def test_ngram_join_shared_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(None, a), (None, b), (7, a + " more"), (7, b + " more"), (8, b)]
    got = ngram_join.groups(h.documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["n_shingles"]) for r in got) == [(0, 7, 57), (0, 7, 57), (7, 7, 58), (7, 7, 58), (8, 7, 57)]


def test_ngram_join_parts_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    texts = {i: " ".join(f"a{k}" for k in range(60)) + f" b{i // 3} c{i // 3} " + " ".join(f"d{i // 3}x{k}" for k in range(12)) + f" e{i}" for i in range(30)}
    want = h.components({i: h.shingles(t) for i, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.groups(h.documents(spark, texts.items())).collect()} == want


def test_dual_traversal_loses_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 300)
    sets = []
    for k in range(200):
        s = rng.integers(0, 2**62, rng.integers(5, 300)) if k % 3 == 0 else base[: rng.integers(270, 300)].copy()
        if k % 3:
            s[rng.integers(0, len(s), 8)] = rng.integers(0, 2**62, 8)
        sets.append(np.unique(s))
    bits = np.stack([np.frombuffer(ngram_join._bitmap(s.tobytes()), np.uint64) for s in sets])
    n = np.array([len(s) for s in sets])
    found = {tuple(x) for x in ngram_join.dual_traversal(bits, n, 85).tolist()}
    links = set()
    for i in range(200):
        for j in range(i + 1, 200):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                links.add((i, j))
    assert links and links <= found and len(found) < 200 * 199 / 4


# Mixing


def test_targets_share_what_is_left(spark):
    rows = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 2.0), (None, 990, 3.0)], "source string, n long, w double")
    got = {r["source"]: r["target"] for r in mixing.targets(rows, 2000).collect()}
    assert got["a"] == 30 and got["b"] == pytest.approx(788) and got[None] == pytest.approx(1182)
    few = {r["source"]: r["target"] for r in mixing.targets(rows.where("source = 'a'"), 2000).collect()}
    assert few == {"a": 30}


def test_weights_go_by_code_point(spark):
    names = ["b", "a", "Z", "é", "", None, "aa"]
    rows = spark.createDataFrame([(s, 1) for s in names], "source string, n long")
    got = {r["source"]: r["w"] for r in mixing.weighted(rows, None).collect()}
    assert got == {s: 1 + i % 3 for i, s in enumerate(["", "Z", "a", "aa", "b", "é", None])}
    assert {r["source"]: r["w"] for r in mixing.weighted(rows, {"a": 5, None: 2}).collect()} == {"a": 5, None: 2}


def test_released_folders_go(spark, tmp_path, monkeypatch):
    from marginalia.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    since = common.made()
    one = common.materialize(spark.range(3))
    two = common.materialize(one.where("id > 0"))
    common.release(spark, since, keep=two)
    assert len(list(tmp_path.iterdir())) == 1 and two.count() == 2 and common.made() == since + 1


def test_mixing_of_a_source_without_words(spark):
    rows = [(i, s, t) for i, (s, t) in enumerate([("a", None), ("a", " "), ("b", "x y"), ("b", "x y"), ("c", "z " * 8), ("d", "")])]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r["source"]: r["target"] for r in got if r["source"] in "ad"} == {"a": 0.0, "d": 0.0}
    assert all(r["taken"] == 0 for r in got if r["size"] == 0) and 0 < sum(r["taken"] for r in got) <= 12


def test_mixing(spark, texts):
    got = mixing.op5(spark, SF).toPandas()
    again = mixing.op5(spark, SF).toPandas()
    assert rows_of(got, list(got.columns)) == rows_of(again, list(got.columns))
    assert got.set_index("doc_id")["size"].to_dict() == {i: len(h.words(t)) for i, t in texts.items()}
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    per = got.groupby("source").agg(n=("size", "sum"), given=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), most=("size", "max"))
    assert (per.n == per.given).all() and ((per.taken - per.target).abs() <= 2 * per.most).all()
    assert per.target.sum() == pytest.approx(per.n.sum())


def test_mixing_edges(spark):
    docs = h.documents(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e")]).withColumn("source", F.when(F.col("doc_id") == 3, "z"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 5 and sum(r["taken"] for r in rows) <= 8 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(docs.where("false")).collect() == []


def plain_mix(docs, budget, goal, times=3):
    """Words taken of each (source, size), one document a source or all of one size: passes in order of finish."""
    total, at, passes = Counter(), defaultdict(int), []
    for s, n in docs:
        total[s] += n
    for s, n in docs:
        at[s] += n
        passes += [((t * total[s] + at[s]) / goal[s], n, s) for t in range(times)]
    used, over = 0, float("inf")
    for finish, n, _ in sorted(passes):
        used += n
        if used > budget:
            over = finish
            break
    taken = Counter()
    for finish, n, s in passes:
        taken[s] += n * (finish < over)
    return taken


@pytest.mark.parametrize("docs", [[("a", 100)], [("a", 60000), *[("b", 300)] * 100], [(f"s{k:03}", 50 + k % 60) for k in range(300)]], ids=["one", "large", "singles"])
def test_mixing_large_documents_stay_in_budget(spark, docs):
    df = spark.createDataFrame([(i, s, "w " * n) for i, (s, n) in enumerate(docs)], "doc_id long, source string, text string")
    rows = mixing.mix(df).collect()
    budget, goal = sum(n for _, n in docs), {r["source"]: r["target"] for r in rows}
    got = Counter()
    for r in rows:
        got[r["source"]] += r["taken"]
    assert sum(got.values()) <= budget
    assert got == plain_mix(docs, budget, goal)


# Decontamination


def test_decontamination_finds_runs(spark):
    item = "Anna has 12 apples and gives 5 of the red ones to her old friend Ben before noon. How many are left for Anna?"
    rng_text = "entirely different words about weather in the mountains and nothing else worth telling anyone here today"
    cases = {
        1: f"{rng_text}. {item} {rng_text}",
        2: item.upper(),
        3: item.replace("12", "40").replace(" 5 ", " 7 ") + " " + rng_text,
        4: rng_text,
        5: None,
        6: "",
        7: " ".join(item.split()[:9]),  # too short a run
        8: "x " * 20000 + item,
    }
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, "tiny item of five words")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(h.documents(spark, cases.items()), bench).collect()}
    assert {d for d, i in got if i == 7} == {1, 2, 3, 8}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(h.documents(spark, cases.items()), bench).collect()}
    assert kept == {4, 5, 6, 7}
    assert decontaminate.matches(h.documents(spark, cases.items()), bench.where("false")).collect() == []
    assert decontaminate.matches(h.documents(spark, []), bench).collect() == []


def test_decontamination_without_broadcast_and_clashing_names(spark, docs, monkeypatch):
    bench = table(spark, SF, "benchmark")
    want = {tuple(r) for r in decontaminate.matches(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontaminate.matches(docs, bench).collect()} == want
    odd = docs.selectExpr("doc_id", "text", "'x' AS _d", "1 AS _t", "2 AS _gone")
    bad = {r[0] for r in want}
    assert {r["doc_id"] for r in decontaminate.decontaminate(odd, bench).collect()} == {r["doc_id"] for r in docs.collect()} - bad
    assert ngram_join.keep_one(odd.limit(20)).columns == odd.columns


def test_decontamination_ids_and_repeats(spark):
    item = "the quick brown fox jumped over one lazy dog and then it slept near the old mill until morning"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item + " again")], "item_id long, text string")
    rows = [(None, f"so {item}"), (5, item), (5, item), (5, "other words"), (6, "the quick brown fox " * 30)]
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.matches(h.documents(spark, rows), bench).collect())
    assert got == [(0, 1), (0, 2), (5, 1), (5, 2)]
    left = [r["doc_id"] for r in decontaminate.decontaminate(h.documents(spark, rows), bench).collect()]
    assert left == [5, 6]


def test_decontamination_slots_must_agree(spark):
    item = "if 3 boxes hold 9 balls each then 3 boxes and one more of them will hold some other number of balls in total"
    same = item.replace("3", "5").replace("9", "4")
    torn = item.replace("3 boxes hold", "5 boxes hold").replace("9", "4")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["n_changed"] for r in decontaminate.matches(h.documents(spark, [(1, same), (2, torn)]), bench).collect()}
    assert set(got) == {1} and got[1] == 2


def test_decontamination_against_brute_force(spark, duck, texts):
    items = {i: h.re.findall(r"[^\W_]+", t.lower()) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()}
    runs = defaultdict(set)
    for i, w in items.items():
        for k in range(len(w) - 12):
            runs[tuple(w[k : k + 13])].add(i)
    want = set()
    for d, t in texts.items():
        w = h.re.findall(r"[^\W_]+", (t or "").lower())
        for k in range(len(w) - 12):
            want |= {(d, i) for i in runs.get(tuple(w[k : k + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op6(spark, SF).collect()}
    assert got == want


def found_in(spark, item, *texts):
    """Places of the texts that hold the item."""
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r["doc_id"] for r in decontaminate.matches(h.documents(spark, enumerate(texts)), bench).collect()}


def test_decontamination_needs_one_run(spark):
    item = "we came home at the end of the long day the lamps were lit and supper stood ready on the old oak table"
    phrase = "at the end of the long day the"
    apart = f"he slept {phrase} whole night and then {phrase} other men went off to sea"
    broken = item.replace("lamps were lit", "dogs barked loud")  # 10 and 10 words at one offset
    assert found_in(spark, item, apart, broken, f"so {item}") == {2}


def test_decontamination_keeps_dense_numbers(spark):
    short = "How many apples does Tom have after 12 days?"
    assert found_in(spark, short, f"well. {short} yes", short.replace("12", "40"), "how many apples does Tom want") == {0, 1}
    dense = "Add 12, 15, 27, 33, 41 and 50 then double the sum of all"
    other = "Add 13, 16, 28, 34, 42 and 51 then double the sum of all"
    rows = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    for lead in ("", "a. ", "a b. ", "a b c. ", "a b c d. "):
        assert found_in(spark, dense, lead + dense, lead + other, rows) == {0, 1}
    assert found_in(spark, "3 5 8 13 21 34 55 89 144 233 377 610 987", "see 3 5 8 13 21 34 55 89 144 233 377 610 987", rows) == {0}


def test_decontamination_case_and_first_word(spark):
    item = "yesterday Anna met Ben and Carl near the river while Dora stayed at home to read a long book about old ships at sea"
    assert found_in(spark, item, item.lower(), item.upper(), item.title()) == {0, 1, 2}
    first = "Name the largest river that crosses the old capital of that far land"
    assert found_in(spark, first, f"he then asked {first}", f"he asked, {first.lower()}") == {0, 1}
    named = "Anna has 12 red apples and eats some of them at noon today"
    assert found_in(spark, named, "once Maria has 15 red apples and eats some of them at noon today") == {0}


# LM scoring


def plain_weight(counts, ones):
    """weight_of by bisection over the same points."""
    import math

    grid = [float(w) for w in lm_score.WEIGHTS]
    left = [sum(c * w / (c + w) for c in counts) for w in grid]
    if not counts or ones <= left[0]:
        return grid[0]
    if ones >= left[-1]:
        return grid[-1]
    i = next(k for k in range(len(grid)) if left[k + 1] >= ones)
    share = (math.log(ones) - math.log(left[i])) / (math.log(left[i + 1]) - math.log(left[i]))
    return float(f"{2 ** (math.log2(grid[i]) + share):.4g}")


def plain_scores(texts):
    """Counts and probabilities as stated, token by token."""
    import math

    words = {i: [*h.words(t), None] for i, t in texts.items()}
    train = [i for i in texts if i is None or h.crc(i, 5) != 1]
    one, two, three = Counter(), Counter(), Counter()
    for i in train:
        seq = ["<s>", *words[i]]
        one["<s>"] += 1
        for k, w in enumerate(words[i]):
            one[w] += 1
            two[seq[k], w] += 1
            if k:
                three[seq[k - 1], seq[k], w] += 1
    n, v = sum(c for w, c in one.items() if w != "<s>"), sum(1 for w in one if w != "<s>")
    w1 = plain_weight(list(one.values()), sum(c == 1 for c in two.values()))
    w2 = plain_weight(list(two.values()), sum(c == 1 for c in three.values()))
    out = {}
    for i, ws in words.items():
        base = score = 0.0
        seq = ["<s>", *ws]
        for k, w in enumerate(ws):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            p = (two[seq[k], w] + w1 * p) / (one[seq[k]] + w1)
            if k:
                p = (three[seq[k - 1], seq[k], w] + w2 * p) / (two[seq[k - 1], seq[k]] + w2)
            score += math.log10(p)
        out[i] = (i not in train, len(ws), sum(one[w] > 0 for w in ws), n, base, score)
    return out


@pytest.mark.parametrize("segment", [1, 3, 1 << 20])
def test_lm_score(spark, monkeypatch, segment):
    monkeypatch.setattr(lm_score, "SEGMENT", segment)
    monkeypatch.setattr(lm_score, "PACK_BYTES", 200)
    monkeypatch.setattr(lm_score, "SHARD", 100)
    texts = {i: f"the Cat {i % 3} sat on the mat {'again ' * (i % 5)}" for i in range(40)} | {50: None, 51: "", 52: "word " * (300 if segment == 1 else 3000), 53: "the", None: "the cat"}
    docs = h.documents(spark, texts.items())
    want = plain_scores(texts)
    rows = lm_score.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r["doc_id"]]
        assert tuple(r)[1:5] == w[:4] and r["base_score"] == pytest.approx(w[4]) and r["score"] == pytest.approx(w[5])


def test_lm_score_repeats_and_empty(spark):
    docs = h.documents(spark, [(1, "a b c"), (None, "a b"), (2, None)])
    assert lm_score.score(docs.where("false")).collect() == []
    assert len(lm_score.score(docs.union(docs)).collect()) == 6
    alone = lm_score.score(docs.where("doc_id = 2")).collect()
    assert [(r["n_tokens"], r["train_tokens"]) for r in alone] == [(1, 1 if h.crc(2, 5) != 1 else 0)]


def test_lm_score_is_better_than_its_root(spark):
    got = lm_score.op7(spark, SF).toPandas()
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


# Token counts


def test_token_counts(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    more = {1: None, 2: "", 3: "  a  b\n\n c ", 4: "x </s> <s> y", 5: "▁a▁▁b\r\n\tc", 6: "no_space" * 5000, 7: "été Ａ 漢字 🎉", 8: "a\n b", 9: " ", 10: "\n"}
    docs = h.documents(spark, [*more.items(), *((100 + i, t) for i, t in texts.items())])
    for r in token_counts.token_counts(docs, path).collect():
        t = (more[r["doc_id"]] if r["doc_id"] < 100 else texts[r["doc_id"] - 100]) or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(model.encode(t))), t[:40]
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.token_counts(docs.where("false"), path).collect() == []
    again = h.documents(spark, [(None, "a b"), (3, "a b"), (3, "a b")])
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(again, path).collect()) == [(0, 2), (3, 2), (3, 2)]
    counter = token_counts.SentencePieceCounter(path)
    counter.counts([f"w{i}" * 40 for i in range(50)])
    assert max(map(len, counter.known)) <= token_counts.CACHE_PIECE
    other = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(other) == docs.count()


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site-header"><a href="/">Site</a><p>A tagline, long, with commas.</p></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice"><p>We use cookies, many, and more.</p></div><div class="wrap"><div class="content"><h1>Title &amp; more</h1>
<p>First <b>para</b>, with commas,   and text.</p><div class="advert">Buy</div><ul><li>one<li>two</ul><script>var x = "<p>no</p>";</script><p>Second<br>line &lt;3<p>Third</div>
<div class="sidebar"><p>Other, stories, here.</p></div></div><section id="comments"><p>I disagree, totally, with this.</p></section><form><p>Mail</p></form><footer>c</footer></body></html>"""


def test_html_main_text():
    assert html_text.extract(PAGE) == "Title & more\nFirst para, with commas, and text.\none\ntwo\nSecond line <3\nThird"
    assert html_text.extract("") == html_text.extract(None) == html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("plain text") == "plain text"
    two = "<body><article><section><p>One, a b c.</p></section><aside>no</aside><section><p>Two.</p></section></article><div class='comments'><p>Long, long, long, comment, here.</p></div></body>"
    assert html_text.extract(two) == "One, a b c.\nTwo."


def test_html_pages(spark, duck):
    got = {r["page_id"]: r for r in html_text.op9(spark, SF).collect()}
    for i, page in duck.sql("SELECT page_id, html FROM pages").fetchall():
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [h.re.sub(r"\s+", " ", __import__("html").unescape(h.re.sub(r"<[^>]+>", "", p))).strip() for p in h.re.split(r"<p>|</p>|<h1>|</h1>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, "u", None), (None, None, "<p>x</p>"), (2, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.main_text(odd).collect()) == ["", "deep", "x"]
    assert html_text.main_text(odd.where("false")).collect() == []


# Quality


def plain_kneser_ney(texts):
    """A function (context, code point) to probability, by recursion over plain counts."""
    n = quality.ORDER
    counts = {n: Counter()}
    for t in texts:
        padded = quality._PAD + t + quality._END
        counts[n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, of = {}, {}
    for k, c in counts.items():
        m = [0, *(sum(v == j for v in c.values()) for j in (1, 2, 3, 4))]
        cut[k] = []
        for j in (1, 2, 3):
            d = j - (j + 1) * (m[1] / (m[1] + 2 * m[2])) * m[j + 1] / m[j] if m[j] and m[j + 1] else -1
            cut[k].append(d if 0 < d <= j else j / 2)
        of[k] = defaultdict(list)
        for g, v in c.items():
            of[k][g[:-1]].append(v)

    def p(h, w):
        k = len(h) + 1
        mine = of[k].get(h)
        below = p(h[1:], w) if k > 1 else 1 / (len(counts[1]) + 1)
        if not mine:
            return below
        d = lambda v: cut[k][min(v, 3) - 1]
        own = counts[k].get(h + w, 0)
        return ((own - d(own)) if own else 0) / sum(mine) + sum(map(d, mine)) / sum(mine) * below

    return p


def test_kneser_ney_matches_brute_force(spark, monkeypatch):
    import math

    monkeypatch.setattr(quality, "PIECE", 40)  # texts in several pieces
    monkeypatch.setattr(quality, "PACK", 300)
    monkeypatch.setattr(quality, "SLOTS", 5)
    train = ["abracadabra", "banana band", "cab" * 7, "band aid"]
    p = plain_kneser_ney(train)
    known = sorted({c for t in train for c in t})
    for start in ("   ", "ban", "xyz", "\x02\x02\x02"):
        total = sum(p(start, c) for c in [*known, quality._END, "?"])  # one code point that no text has stands for all of these
        assert total == pytest.approx(1, abs=1e-9)
    grams, contexts = quality.fit(h.documents(spark, list(enumerate(train))))
    ask = [(1, "abba"), (2, "zzz bandana" * 30), (2, "x"), (None, "cab"), (3, ""), (4, None), (5, "bandé 漢"), (1, "abba")]
    docs = h.documents(spark, ask).union(h.documents(spark, [(9, "abba")], lang="xx")).select("doc_id", "lang", "text")
    rows = quality.perplexities(docs, grams, contexts).collect()
    got = sorted(((r["doc_id"] or 0, r["n_chars"], r["perplexity"]) for r in rows), key=str)
    want = []
    for i, t in [*ask, (9, None)]:
        padded = quality._PAD + (t or "") + quality._END
        log = sum(math.log10(p(padded[k : k + 3], padded[k + 3])) for k in range(len(padded) - 3))
        want.append((i or 0, len(t or "") if i != 9 else 4, pytest.approx(10 ** (-log / (len(t) + 1))) if t else None))
    assert len(got) == len(want)
    for w in want:
        assert any(g[:2] == w[:2] and g[2] == w[2] for g in got), (w, got)
    assert quality.perplexities(docs.where("false"), grams, contexts).collect() == []


def test_quality_sample_is_bounded(spark, monkeypatch):
    rows = h.documents(spark, [(i, "some text") for i in range(300)]).select("doc_id", "lang", F.length("text").alias("chars"))
    for docs, chars, most in ((50, 10**6, 50), (10**6, 900, 100)):
        monkeypatch.setattr(quality, "TRUSTED_DOCS", docs)
        monkeypatch.setattr(quality, "TRUSTED_CHARS", chars)
        n = quality._bounded(rows).count()
        assert 0.8 * most <= n <= most


def test_quality_learns_from_all_trusted(spark, monkeypatch):
    """As many documents and code points as there are, also over the bounds that there were, in several packs and pieces."""
    for name, n in (("TRUSTED_DOCS", 5), ("TRUSTED_CHARS", 300), ("PACK", 900), ("PIECE", 40)):
        monkeypatch.setattr(quality, name, n)
    rows = [(i, f"text {i * i} of house {i % 7} by the river") for i in range(60)]
    docs = h.documents(spark, [*rows, (3, "once more"), (70, "none of it"), (None, "no id")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows] + [(70, 0, 0)], "doc_id long, quality int, toxic int")
    trusted = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").where(~quality.held(F.col("doc_id"), 5, 1))
    want = quality.perplexities(docs.select("doc_id", "lang", "text"), *quality.fit(trusted)).collect()
    got = quality.classify(docs, labels).collect()
    key = lambda r: (r["doc_id"] or 0, r["n_chars"])
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
    assert [r["perplexity"] for r in sorted(got, key=key)] == pytest.approx([r["perplexity"] for r in sorted(want, key=key)], rel=1e-6)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op10(spark, sf).toPandas()
    labels = table(spark, sf, "labels").toPandas()
    both = got.merge(labels, on="doc_id")
    assert len(got) == table(spark, sf, "documents").count()
    assert both[both.quality == 1].keep.mean() > 0.97 and both[both.quality == 0].keep.mean() < 0.5


def test_quality_edges(spark):
    clean = [(i, f"the old house stood by the river number {i} and nobody lived there") for i in range(200)]
    docs = h.documents(spark, [*clean, (900, None), (901, ""), (902, "QQ%%%## ZZ$$!! ~~~ ^^^ |||")]).union(h.documents(spark, [(903, "no trusted text")], lang="xx"))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert not got[900]["keep"] and not got[901]["keep"] and not got[902]["keep"] and got[903]["keep"]
    assert got[903]["perplexity"] is None and sum(got[i]["keep"] for i, _ in clean) >= 195
    assert quality.classify(docs.where("false"), labels).collect() == []
    assert all(r["keep"] == bool(r["n_chars"]) for r in quality.classify(docs, labels.where("false")).collect())


def test_kept_text_digest(spark, texts):
    gone = dropped(texts, 10, "none")
    for r in line_dedup.op1(spark, SF).collect():
        t = texts[r["doc_id"]] or ""
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if (r["doc_id"], p) not in gone)
        assert r["kept_sha256"] == hashlib.sha256(left.encode()).hexdigest()
