"""Operators 3, 4 and 6 against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlure.llm import jaccard, linededup, suffixdedup
from flowlure.llm.components import components
from flowlure.llm.runindex import RunIndex
from tests.llm.conftest import LINE, rows


def near_copies(texts):
    sets, least = {}, {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k: k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
        least[i] = i
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a], changed = least[b], True
                elif least[a] < least[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[b], changed = least[a], True
    return {i: (len(sets[i]), least[i]) for i in sets}


def edited(seed=4, n=60):
    """Groups of texts with a few changed words, chained so that ends are linked only through the middle."""
    chance, out = random.Random(seed), []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(80)]
        for _ in range(n // 6):
            words = list(words)
            for _ in range(chance.randint(0, 2)):
                words[chance.randrange(len(words))] = f"e{chance.random()}"
            out.append(" ".join(words))
    return out


def test_near_copies(spark, docs, no_docs, tricky):
    texts = [*tricky, *edited()]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table).collect()}
    assert got == near_copies(enumerate(texts))
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_links_at_the_threshold(spark):
    """Sets of 7 with 6 in common: 100 * 6 >= 75 * 8 holds exactly; of 6 with 5 it does not."""
    def pair(k):
        words = [f"{k}x{i}" for i in range(k + 4)]
        return " ".join(words), " ".join([*words[:-1], "other"])

    table = spark.createDataFrame(list(enumerate([*pair(7), *pair(6)])), "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.near_duplicates(table).orderBy("doc_id").collect()] == [0, 0, 2, 3]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 100), (5, 5)], "a long, b long")
    assert {(r["a"], r["b"]) for r in components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(100, 99)}


def covered(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        mark = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i: i + length]] > 1:
                mark[i: i + length] = True
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out[k] = (len(d), int(mark.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~mark])).hexdigest())
    return out


@pytest.mark.parametrize(("length", "often"), [(200, 20000), (200, 2), (20, 3), (7, 20000)])
def test_long_repeats(spark, docs, no_docs, tricky, length, often):
    texts = [t if len(t or "") < 50_000 else t[:9000] for t in tricky]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixdedup.dedup(table, length, often).collect()}
    assert got == covered(texts, length)
    assert suffixdedup.dedup(no_docs, length).count() == 0


def test_run_index_matches():
    chance = random.Random(5)
    for _ in range(60):
        strings = [bytes(chance.choice(b"ab\x00") for _ in range(chance.randint(0, 20))) for _ in range(chance.randint(0, 5))]
        places = [(s, i) for s, x in enumerate(strings) for i in range(len(x))]
        index = RunIndex(strings)
        assert index.lengths.sum() == len(places)
        for (s, i), got in zip(places, index.matching_statistics()):
            best = 0
            for t, j in places:
                if (s, i) != (t, j):
                    k = 0
                    while k < min(len(strings[s]) - i, len(strings[t]) - j) and strings[s][i + k] == strings[t][j + k]:
                        k += 1
                    best = max(best, k)
            assert got == best


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixdedup, "PLACE_BITS", 10)
    chance = random.Random(6)
    raw = np.array([chance.choice(b"abcd") for _ in range(3000)], np.uint8)
    windows = []
    for h, p, s, e, d in zip(*suffixdedup._in_pieces(raw, np.array([0, len(raw)]), 60)):
        windows += range(s, e)
    assert sorted(windows) == list(range(len(raw) - 60 + 1))


def test_edit_distance_within_a_band(spark):
    chance, pairs = random.Random(7), []
    for _ in range(1500):
        a = [chance.choice("abé") for _ in range(chance.randint(0, 14))]
        b = list(a)
        for _ in range(chance.randint(0, 4)):
            at = chance.randint(0, len(b))
            b[at: at + chance.randint(0, 1)] = [chance.choice("abé")] * chance.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    table = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (1, 2, 3):
        wrong = table.where(linededup.within_edits(F.col("a"), F.col("b"), threshold) != (F.levenshtein("a", "b") <= threshold))
        assert wrong.count() == 0
        wrong = table.where(linededup.near(F.col("a"), F.col("b"), threshold) != (F.levenshtein("a", "b") <= threshold))
        assert wrong.count() == 0
        lost = table.where((F.levenshtein("a", "b") <= threshold) & ~linededup.pieces_kept(F.col("a"), F.col("b"), threshold))
        assert lost.count() == 0


def test_segments_miss_no_pair(spark):
    chance, lines = random.Random(8), set()
    for _ in range(60):
        base = "".join(chance.choice("abc") for _ in range(chance.randint(6, 12)))
        lines |= {base, base[:-1], "a" + base, base[:3] + "z" + base[4:], base[:2] + base[3:] + "y"}
    table = spark.createDataFrame([(x,) for x in sorted(lines)], "text string").withColumns({"h1": F.xxhash64("text"), "size": F.length("text"), "letters": linededup.letter_counts(F.col("text"))})
    for threshold in (1, 2):
        met = {(r["a"], r["b"]) for r in linededup.candidates(table, threshold).collect()}
        both = table.select(F.col("text").alias("x"), F.col("h1").alias("a")).crossJoin(table.select(F.col("text").alias("y"), F.col("h1").alias("b")))
        near = {(r["a"], r["b"]) for r in both.where((F.col("a") < F.col("b")) & (F.levenshtein("x", "y") <= threshold)).collect()}
        assert near and near <= met


def kept_lines(spark, texts):
    """Brute force: a line goes if an equal or near one stands at an earlier place."""
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts if t is not None], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    first, places = {}, []
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else ()):
            if re.search(r"[^\x20\x09-\x0D]", line):
                places.append(((i, hashes[t], k), line))
                first[line] = min(first.get(line, places[-1][0]), places[-1][0])

    def near(a, b):
        if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < linededup.LEAST_CHARS:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1] <= 2

    gone = defaultdict(set)
    for place, line in places:
        if any(p < place and (line == other or near(line, other)) for other, p in first.items()):
            gone[place[0]].add(place[2])
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)]


def test_line_dedup(spark, docs, no_docs, tricky):
    texts = [t if len(t or "") < 9000 else "long" for t in tricky]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(3)
    got = linededup.dedup_lines(table)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == kept_lines(spark, texts)
    assert sorted(set(got.columns)) == sorted(got.columns)
    assert linededup.dedup_lines(no_docs).count() == 0
    assert got.where("n_near > 0").count() > 0


def test_line_dedup_of_letters_of_several_bytes(spark, docs):
    """Near lines of which one, both or none are plain ASCII, at edits in each segment; a very long text of lines."""
    base = "the quick brown fox jumps over the lazy dog by the river"
    edits = [base, base.replace("quick", "qu\u00efck"), base.replace("fox", "f\u00f6\U0001f600x"), base.replace("river", "riv\u00e9r"), "\u00e9" + base, base[1:] + "\u00df", base + "abc", base.replace("o", "\u00f6")]
    texts = [*edits, "\n".join(f"a line {random.Random(i).random()} like no other" for i in range(2000)), "\n".join(["x", *edits[::-1], "y"] * 3)]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(4)
    got = [r["text"] for r in linededup.dedup_lines(table).orderBy("doc_id").collect()]
    assert got[8] == texts[8]
    assert got[:8] + got[9:] == kept_lines(spark, texts[:8] + texts[9:])


def test_line_dedup_without_ids(spark):
    table = spark.createDataFrame([(None, LINE.format(1)), (1, LINE.format(1)), (1, LINE.format(1)), (2, LINE.format(1))], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(table).collect()) == [(0, LINE.format(1)), (1, LINE.format(1)), (1, LINE.format(1)), (2, "")]


def test_line_dedup_moves_few_texts(spark, docs, monkeypatch):
    """Only texts of lines that share a segment are kept beside the input, by one plan at any size; copies of documents change nothing."""
    chance, kept, plans = random.Random(9), {}, {}
    lines = [" ".join(f"{chance.getrandbits(64):x}" for _ in range(20)) for _ in range(400)]
    texts = ["\n".join(lines[i:i + 40]) for i in range(0, 400, 40)] + [lines[7] + "xy", lines[3] + "\n" + lines[8][1:], lines[9] + "xyz"]
    keep = linededup.keep

    def watched(df, name):
        out = keep(df, name)
        kept[name] = sum(f.getLen() for f in spark._jvm.org.apache.hadoop.fs.Path(out._llm_path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(out._llm_path)))
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return out

    monkeypatch.setattr(linededup, "keep", watched)
    table = spark.createDataFrame(rows(texts) + rows(texts)[8:], docs.schema).repartition(3)
    got = [r["text"] for r in linededup.dedup_lines(table).orderBy("doc_id").collect()]
    left = [*texts[:10], "", "", texts[12]]  # three edits are too many
    assert got == [x for i, t in enumerate(left) for x in [t] * (1 + (i >= 8))]
    assert kept["lines"] + kept["line-texts"] < sum(map(len, texts)) / 3
    assert "Broadcast" not in plans["line-texts"]


def test_native_plans(spark, docs):
    """Operators 1 and 6 run no Python."""
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_digests_that_agree_in_32_bits(spark, docs):
    """Two linked texts whose digests agree in the low bits that told sets apart before."""
    words = [f"v{i}" for i in range(42)]
    texts = [" ".join([*words[:41], f"x{i}"]) for i in range(150_000)]
    h, offsets = jaccard.ngram_sets(pa.array(texts, pa.large_string()))
    d1, d2 = jaccard._digests(h, offsets)
    low = (d1 ^ (d2 >> 32)).astype(np.uint32)
    order = np.argsort(low, kind="stable")
    at = np.flatnonzero(low[order][1:] == low[order][:-1])
    assert len(at)
    pair = [texts[order[at[0]]], texts[order[at[0] + 1]]]
    found = jaccard.near_duplicates(spark.createDataFrame(rows([*pair, "other words here"]), docs.schema)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {0: 0, 1: 0, 2: 2}
