"""Operator 12 against a plain ranking and SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from flowlure.llm import maxscore
from flowlure.plans.compare import duckdb_connection, rows_of
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if i is not None and terms(t)]
    n_docs, n_words = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item, text in items:
        found = []
        ask = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in ask}
        for i, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n_docs) // n_words
            score = sum(ask[t] * w[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in ask)
            if score > 0:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def prose(seed, n, words=60):
    chance = random.Random(seed)
    return [" ".join(f"w{min(int(chance.paretovariate(0.7)), 300)}" for _ in range(chance.choice([1, 5, words, 10 * words]))) for _ in range(n)]


@pytest.fixture
def small_parts(monkeypatch):
    """Several shards, blocks, windows and blocks of queries on little data."""
    for name, value in (("SHARD_BYTES", 20_000), ("BLOCK", 4), ("WINDOW", 16), ("QUERY_CHARS", 300)):
        monkeypatch.setattr(maxscore, name, value)


def test_search(spark, docs, no_docs, tricky, small_parts):
    texts = [*tricky, *prose(1, 250), *prose(1, 20), "É naïve ÀB9 日本語 x_y"]
    table = spark.createDataFrame([*rows(texts), (None, "w1 w2", *rows([""])[0][2:]), (5, "w3 a again", *rows([""])[0][2:])], docs.schema).repartition(2)
    items = [(1, "w1 w2 W3 w3 w40"), (2, None), (3, ""), (4, "not-there"), (5, "É naïve 日本語 ab9 àb9"), (6, " ".join(prose(2, 3))), (None, "w7"), (7, "w7"), (7, "w7"), (7, "same line"), (8, "ab " * 50)]
    asked = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, query string, rank string")
    found = sorted([tuple(r) for r in maxscore.rank_items(table, asked).collect()], key=str)
    assert found == plain([*enumerate(texts), (None, "w1 w2"), (5, "w3 a again")], dict.fromkeys(items))
    assert maxscore.rank_items(no_docs, asked).count() == 0
    assert maxscore.rank_items(table, asked.limit(0)).count() == 0


def test_varint():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_152, 2**31 - 1, 5], np.int64)
    raw, size = maxscore.varint(values)
    assert maxscore.unvarint(raw).tolist() == values.tolist() and size.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 1]


def test_blocks_stay_packed(small_parts):
    """Block maxima keep blocks of the frequent, non-essential terms unopened; hits stay exact."""
    texts = [t + " common" for t in prose(3, 400, 30)] + ["rare word common"]
    batch = maxscore.index_shard(0, np.arange(len(texts)), pa.array(texts, pa.large_string()))
    frame = batch.to_pandas()
    n_words = int(frame["words"].dropna().iloc[0])
    shard = maxscore.Shard(frame, len(texts), n_words)
    df = frame[frame["term"].notna()].groupby("term")["count"].sum()
    query = [(t, maxscore.weight(len(texts), int(df[t]))) for t in ("w300", "w1", "w2", "common")]
    ids, scores = shard.search(query, 3)
    assert [(int(i), int(s)) for i, s in zip(ids, scores)] == [r[2:] for r in plain(list(enumerate(texts)), [(0, "w300 w1 w2 common")], 3)]
    blocks = sum(len(shard.lists[t][0]) for t, _ in query)
    assert shard.opened < 0.6 * blocks, (shard.opened, blocks)


def test_query_equals_sql(spark):
    con = duckdb_connection(SF_SMALL)
    found = entry.queries()["op12_search"](spark, SF_SMALL)
    told = con.execute(entry.oracle_sql()["op12_search"])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of([d[0] for d in told.description], told.fetchall())
