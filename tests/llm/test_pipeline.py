import corpus_pipeline
from marginalia.llm import decontaminate, mixing
from marginalia.llm.common import materialize, table
from tests.conftest import SF

from . import helpers as h
from .test_texts import dropped


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "mixing"]
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        out = materialize(stage(spark, docs, SF))
        if name != "mixing":
            assert out.columns == columns
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert out.where("n_chars <> length(text)").count() == 0 or name == "language_id"
            if name == "language_id":
                assert all(h.re.search(r"[^\W\d_]", t or "") for t in after.values()) and len(after) >= 0.98 * len(before)
            elif name == "line_dedup":
                gone = dropped(before, 10, "first")
                want = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in before.items()}
                assert after == {i: t for i, t in want.items() if h.words(t)}
            elif name == "ngram_jaccard_join":
                up = h.components({i: h.shingles(t) for i, t in before.items()})
                assert after == {i: t for i, t in before.items() if up[i] == i}
            else:
                bad = {r["doc_id"] for r in decontaminate.matches(docs, table(spark, SF, "benchmark")).collect()}
                assert bad and after == {i: t for i, t in before.items() if i not in bad}
        else:
            want = {tuple(r) for r in mixing.mix(docs).collect()}
            assert {tuple(r) for r in out.collect()} == want and {r["doc_id"] for r in out.collect()} == set(before)
        seen[name] = out.count()
        docs = out
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in docs.collect()}


def test_near_duplicates_of_five_words(spark):
    words = [f"w{k}" for k in range(200)]
    edited = [f"x{k}" if k in (40, 80, 120, 160) else w for k, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(edited), 3: " ".join(words[:163]), 4: " ".join(words[:120]), 5: " ".join(words[::-1])}
    up = h.components({i: h.shingles(t, 5) for i, t in texts.items()}, 80)
    out = corpus_pipeline.near_duplicates(spark, h.documents(spark, texts.items()), SF)
    assert {r["doc_id"] for r in out.collect()} == {i for i in texts if up[i] == i} == {1, 4, 5}


def test_empty_input(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() == 0, name
