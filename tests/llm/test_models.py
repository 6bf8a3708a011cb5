"""Operators 1, 2 and 7: round trips, held-out accuracy and brute force; and the pipeline."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from flowlure.llm import chat, knn, langid, queries
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.conftest import rows

TRAPS = ["<|turn|>", "<|body|><|end|>", "\\", "\\~", "\\\\~", "<", "[", "</", "[/INST]", "</s>[INST] ok [/INST]", "<s>\n", "<\\~|end|>", "é<|", "", None]


def test_chat_reads_back_what_went_in(spark):
    data = [(i, k, "assistant" if k % 2 else role, t) for i, role in enumerate(["user", None, "<|turn|>r"]) for k, t in enumerate(TRAPS)]
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(table.withColumn("content", chat.text_part(F.col("text"))))
    assert not re.search("Python|Arrow|Pandas", formatted._jdf.queryExecution().executedPlan().toString())
    for r in chat.read_back(formatted).collect():
        mine = [x for x in data if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss_texts"] == [(x[3] or "") if x[2] == "assistant" else "" for x in mine]
        spans = [chat.escape(F.lit(x[3] or "")) for x in mine]
        assert len(spans) == len(r["loss_spans"])


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    content = [part("text", "see <"), part("image", ref="i.png"), part("text", "|end|> and"), part("audio", ref="a.wav", tokens=7), part("document"), part(None, "x")]
    table = spark.createDataFrame([(1, 0, "user", content), (1, 0, "user", content), (1, None, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_conversations(table).first()
    turn = "<|turn|>user<|body|>see <\\~<|image:1|>|end|> and<|audio:3|><|document:4|>x<|end|>"
    assert r["formatted"] == "<|turn|>assistant<|body|><|end|>" + turn * 2
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]][:3] == [(2, 1, "image", "i.png", 576), (2, 3, "audio", "a.wav", 7), (2, 4, "document", None, 1024)]
    assert r["expanded_tokens"] == 2 * (576 + 7 + 1024)
    assert [s["length"] for s in r["loss_spans"]] == [0, 0, 0]


def test_chat_spans_point_at_the_text(spark):
    got = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "é<|x"), (1, 1, "assistant", "[/INST] ü")], "conv_id long, turn long, role string, text string").withColumn("content", chat.text_part(F.col("text")))).first()
    span = got["loss_spans"][1]
    assert got["formatted"][span["start"]: span["start"] + span["length"]] == "[\\~/INST] ü"


def test_chat_of_nothing(spark):
    assert chat.format_conversations(spark.createDataFrame([], f"conv_id long, turn long, role string, content array<{chat.PART}>")).count() == 0


def test_language_held_out(spark):
    found = queries.op2_language(spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.01


def test_language_of_odd_texts(spark, docs, no_docs, tricky):
    words = {"en": "the and with of house", "de": "der und mit von haus"}
    chance = random.Random(9)
    texts = [(" ".join(chance.choices(w.split(), k=30)), lang) for lang, w in words.items() for _ in range(20)]
    model = langid.train([t for t, _ in texts], [x for _, x in texts])
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert len(got) == len(tricky)
    for i, text in enumerate(tricky):
        letters = any(c.isalpha() for c in text or "")
        assert (got[i]["lang_pred"] == "und") == (not letters), text
        assert got[i]["rejected"] or letters
    assert langid.predict(no_docs, model).count() == 0
    none = langid.fit(no_docs)
    assert none.languages == [] and {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_language_learns_from_whole_texts(spark):
    """Texts of any length under one header of 200 words: what follows it tells the languages."""
    words = {"en": "the and with of house", "de": "der und mit von haus"}
    header, chance = " ".join(f"menu{chr(97 + i % 26)} licence" for i in range(100)), random.Random(3)
    texts = [(header + " " + " ".join(chance.choices(w.split(), k=k)), lang) for lang, w in words.items() for k in (150, 6000) for _ in range(20)]
    model = langid.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string"))
    plain = spark.createDataFrame([(0, "the house of the and"), (1, "der und von haus mit")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(plain, model).collect()} == {0: "en", 1: "de"}
    rows = spark.createDataFrame([(1, "x" * 100_000 + " a b", "en"), (2, " ".join(f"w{i}" for i in range(9000)), "en"), (3, "a b", "en")], "doc_id long, text string, lang string")
    drawn = {r["doc_id"]: r["text"].split() for r in langid._drawn(rows).collect()}
    assert drawn[3] == ["a", "b"] and all(len(x) <= langid.SEGMENTS_PER_TEXT * langid.SEGMENT for x in drawn.values())
    assert max(int(w[1:]) for w in drawn[2]) > 4500 and drawn[2] == sorted(drawn[2], key=lambda w: int(w[1:]))


def test_language_sample_is_bounded(spark, monkeypatch):
    """Neither one doc_id on many rows nor copies of one text fill the sample or pass its bound."""
    seen = []
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 10)
    monkeypatch.setattr(langid, "train", lambda texts, languages: seen.append(texts))
    texts = [(7, f"text of one id {i}") for i in range(50)] + [(i, "copied text") for i in range(100, 150)] + [(8, "repeated row")] * 50
    langid.fit(spark.createDataFrame([(i, t, "en") for i, t in texts], "doc_id long, text string, lang string"))
    langid.fit(spark.createDataFrame([(i, t, "en") for i, t in texts[50:]], "doc_id long, text string, lang string"))
    assert len(seen[0]) == len(set(seen[0])) == 10 and sorted(seen[1]) == ["copied text", "repeated row"]


def brute_top(vectors, k, is_query):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in whole:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 3, 400])
def test_top_k(spark, n):
    chance = random.Random(n)
    centres = [[chance.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    vectors = [(i, [float(f"{x + chance.gauss(0, 0.1):.2f}") for x in centres[i % 5]]) for i in range(n)]
    vectors += [(10_000, None), (10_050, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (10_100, [float("nan")] * 6), (10_150, [float("inf")] * 6)] if n else []
    vectors += [(n + k, vectors[0][1]) for k in range(8)] if n > 3 else []  # ties
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = knn.top_k(knn.quantised(table), F.col("vec_id") % 50 == 0, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(vectors, 5, lambda q: q % 50 == 0)


def test_top_k_splits_large_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART_ROWS", 20)
    vectors = [(i, [1.0, float(i % 3)]) for i in range(300)]
    got = knn.top_k(knn.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0, 5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(vectors, 5, lambda q: q % 50 == 0)


def test_top_k_of_repeated_ids(spark, tmp_path):
    """Copies of an id, alike and different, ask once and are all left out for their own id; SQL agrees."""
    chance = random.Random(3)
    vectors = [(i, [chance.gauss(4.0 * (i % 4), 0.2), chance.gauss(2.0, 0.2)]) for i in range(200)]
    vectors += [(50, [12.0, 2.0])] * 30 + [(50, [12.0, 2.5]), (7, [12.0, 2.0]), (7, [12.0, 2.0]), (100, [0.0, 1.0]), (100, [-1.0, 5.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op7_topk(spark, str(tmp_path)).collect())
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:
        asks = min(v for i, v in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(asks, v)), i) for i, v in whole if i != q)[:5]
        want += [(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)]
    assert got == sorted(want)
    sql = queries.ORACLE_SQL["op7_topk"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(duckdb.sql(f"SELECT query_id, rank, vec_id, score FROM ({sql})").fetchall()) == got


def test_pipeline_stages(spark, tricky, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    documents = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(10_000 + r[0], *r[1:5]) for r in rows(tricky)] + [(None, "words without an id", None, None, None)], schema)
    docs, before = documents.unionByName(odd), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r[0] for r in docs.select("doc_id").distinct().collect()}
        if name != "pack":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert None not in ids and (before is None or ids <= before)
        else:
            assert ids == before
        before = ids
    assert len(before) > 150
    assert len(corpus_pipeline.STAGES) in (4, 5)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_all_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.ORACLE_SQL) <= set(names)


def test_letters_are_unicode_letters(spark):
    """Number signs such as fractions and exponents are no letters: a text of them alone is ``und``."""
    seen = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(["the plain words of a text", "and more of them here"] * 10)], "doc_id long, text string, lang string, source string")
    model = langid.fit(seen)
    asked = spark.createDataFrame([(1, "½ ² 12"), (2, "Ⅷ ⑦ 3"), (3, "½a"), (4, "_ -"), (5, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"] > 0, r["rejected"]) for r in langid.predict(asked, model).collect()}
    assert found[1] == found[2] == found[4] == found[5] == ("und", False, True) and found[3][0] == "en" or model.languages == []
