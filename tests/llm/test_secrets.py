"""Operator 11 against plain regular expressions and SQL."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowlure.llm import secretscan
from flowlure.plans.compare import duckdb_connection, rows_of
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows


def plain(text):
    out = []
    for i, r in enumerate(secretscan.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), i, f"{r.kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def expected(texts):
    out = []
    for i, t in enumerate(texts):
        found = plain(t)
        base = ",".join(s for _, k, s in found if k < 3)
        out.append((i, *(sum(k == j for _, k, _ in found) for j in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(s for *_, s in found)))
    return out


def secrets(seed=11, n=300):
    """Texts with real secrets, near misses and odd characters before them."""
    chance = random.Random(seed)
    word = lambda letters, a, b: "".join(chance.choice(letters) for _ in range(chance.randint(a, b)))
    low, both = "0123456789abcdef", "ABCdef019_"
    parts = [
        lambda: chance.choice(["password", "PassWD", "Secret", "token", "API_KEY", "apikey"]) + chance.choice(["", '"', "'"]) + chance.choice([" = ", ":", "=", "  :  ", " "]) + chance.choice(['"', "'", ""]) + word(both + "=/+.-", 8, 20),
        lambda: "token=api_key: " + word(both, 12, 20), lambda: "AKIA" + word("ABC012", 10, 20), lambda: "akia" + word("ABC012", 14, 16),
        lambda: word(low, 12, 60), lambda: "-----BEGIN " + chance.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----", lambda: "ghp_" + word("aZ09", 34, 40),
        lambda: "xoxb-" + word("aZ09-", 8, 14), lambda: "AIza" + word("aZ09_-", 33, 37), lambda: chance.choice("rs") + "k_live_" + word("aZ09", 14, 18),
        lambda: "eyJ" + word("aZ9", 8, 9) + ".eyJ" + word("aZ9", 7, 9) + "." + word("aZ9", 8, 9), lambda: "https://user:" + word("aZ9", 1, 5) + "@host", lambda: "é日😀\n", lambda: "plain words token of password ",
    ]
    return ["".join(chance.choice(parts)() + chance.choice(["", " ", "\n", "é "]) for _ in range(chance.randint(0, 8))) for _ in range(n)]


def test_secrets(spark, docs, no_docs, tricky):
    texts = [*tricky, *secrets(), "token = " + "x" * 200_000, "deadbeefdeadbeef " * 3000, "z" * 300_000 + "AKIA" + "A" * 14]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(4)
    got = sorted(tuple(r) for r in secretscan.digest(table, secretscan.scan(table)).collect())
    assert got == expected(texts)
    assert sum(r[1] for r in got) > 30 and sum(len(r[5].split(",")) for r in got) > 3000
    assert secretscan.digest(no_docs, secretscan.scan(no_docs)).count() == 0


def test_rows_alike_and_without_id(spark, docs):
    text = "token = abcdefghijklmnop AKIAABCDEFGHIJKLMN"
    table = spark.createDataFrame([(7, text, *"enstx"), (7, text, *"enstx"), (7, "AKIA", *"enstx"), (None, text, *"enstx"), (None, None, *"enstx")], "doc_id long, text string, lang string, source string, rule string, text_hash string, start string")
    got = [(r["doc_id"], r["spans"]) for r in secretscan.digest(table, secretscan.scan(table)).collect()]
    both = "assign:0:24,access:25:43"
    assert sorted(got, key=str) == sorted([(7, both), (7, both), (7, ""), (None, both), (None, "")], key=str)


def test_queries_follow_from_the_patterns():
    found = {r.kind: secretscan.trigram_query(r.pattern) for r in secretscan.RULES}
    assert found["hex"] == [] and found["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in found["assign"][0] and len(found["assign"]) == 1
    for r in secretscan.RULES:  # every match holds what its query asks for
        for text in secrets(3, 300):
            for m in re.finditer(r.pattern, text):
                assert all(any(all(g in m[0].lower() for g in alt) for alt in part) for part in found[r.kind])
    assert secretscan.trigram_query("(ab|c)+d?xyz*") == [] and secretscan.trigram_query("[a-z]+secret[0-9]") == [[frozenset({"sec", "ecr", "cre", "ret"})]]


def test_other_rules(spark, docs):
    own = (secretscan.Rule("pin", "[0-9]{4}", 0, 4),)
    table = spark.createDataFrame(rows(["a 1234 5678", "none"]), docs.schema)
    assert sorted((r["rule"], r["start"], r["end"], r["value"]) for r in secretscan.scan(table, own).collect()) == [("pin", 2, 6, "1234"), ("pin", 7, 11, "5678")]


def test_no_python_in_the_plan(spark):
    text = entry.queries()["op11_secrets"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", text)


@pytest.mark.parametrize("planted", [0, 1])
def test_query_equals_sql(spark, tmp_path, planted):
    sf = SF_SMALL
    if planted:
        spark.createDataFrame(rows(secrets(5)), "doc_id long, text string, lang string, source string, n_chars long, a string, b string, c string, d string").write.parquet(f"{tmp_path}/documents.parquet")
        sf = str(tmp_path)
    con = duckdb.connect() if planted else duckdb_connection(sf)
    if planted:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    found = entry.queries()["op11_secrets"](spark, sf)
    told = con.execute(entry.oracle_sql()["op11_secrets"])
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of([d[0] for d in told.description], told.fetchall())
    assert found.agg(F.sum("n_assign")).first()[0] > 0 or not planted
