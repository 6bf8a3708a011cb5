"""Operator 13 against the libraries on whole texts and components by plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from flowlure.llm import crosstoken
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stays]
    return {chr(b): b for b in stays} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def tokens(text, a, b):
    """[(id, begin, end)] of both, or nothing."""
    if not text:
        return [], []
    raw_a = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    raw_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        raw_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    told = (" " + text).encode()
    if b"".join(x for _, x in raw_a) != told or b"".join(x for _, x in raw_b) != told:
        return [], []

    def placed(raw):
        at, out = 0, []
        for i, x in raw:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out

    return placed(raw_a), placed(raw_b)


def expected(texts, a, b):
    found, counts = [], Counter()
    for text in texts:
        x, y = tokens(text, a, b)
        common = {e for *_, e in x} & {e for *_, e in y}
        sides = [[[]], [[]]]
        for side, row in zip(sides, (x, y)):
            for i, _, e in row:
                side[-1].append(str(i))
                if e in common:
                    side.append([])
        groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*sides)][:-1]
        by_end = {e: i for i, _, e in y}
        links = [(i, by_end[e]) for i, _, e in x if e in by_end]
        counts.update(links)
        found.append((len(x), len(y), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for k, (n_a, n_b, groups, links) in enumerate(found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((k, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out, counts


def odd_texts(n=400):
    chance = random.Random(13)
    bits = ["<|endoftext|>", "</s>", "<0x41>", "don't", "’", " ", "  ", "\n", "\t", "\n\n ", "é", "▁", "日本", "😀", "\x00", "\x85", " ", "abc", "Thequick", "1234", "ation", "A", ".", ", ", "​", "ß", "\x1c", "\r\n"]
    return ["".join(chance.choice(bits) for _ in range(chance.randint(0, 14))) for _ in range(n)]


def test_alignment(spark, docs, no_docs, tricky, libraries):
    texts = [*tricky, *odd_texts(), "Straße " * 3000, "x" * 20_000, "z" * 50 + " " * 500 + "z"]
    table = spark.createDataFrame(rows(texts), docs.schema).repartition(3)
    found = sorted(tuple(r) for r in crosstoken.align_documents(table).collect())
    told, counts = expected(texts, *libraries)
    for got, want in zip(found, told):
        assert got == want, texts[got[0]]
    assert len(found) == len(told) and sum(r[1] > 0 for r in told) > 200 and sum(r[1] == 0 for r in told) > 50
    aligned = crosstoken.align(table)
    assert {(r["a_id"], r["b_id"]): r["count"] for r in crosstoken.pair_counts(aligned).collect()} == dict(counts)
    text = {r["doc_id"]: r["groups"] for r in aligned.collect()}
    assert all(hashlib.sha256(text[k].encode()).hexdigest() == d if d else text[k] == "" for k, *_, d in told)
    assert crosstoken.align_documents(no_docs).count() == 0


def test_rows_alike_and_without_id(spark):
    table = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "1 as links", "2 as n_a", "3 as count")
    found = sorted((tuple(r) for r in crosstoken.align_documents(table).collect()), key=str)
    assert [r[:2] for r in found] == [(1, 3), (1, 3), (2, 0), (None, 0), (None, 3)] and {r[6] for r in found} == {0, 9}


def test_terminals():
    """Chains that take several doublings, against the ends that both sides share."""
    chance = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        end_a = np.append(2 * np.arange(1, n + 1), 2 * n + 1)
        end_b = np.append(2 * np.arange(n) + 1, 2 * n + 1)  # staggered: one chain over all tokens
        a, b = crosstoken.terminals(end_a, end_b)
        assert set(a) == set(b) == {len(end_b) - 1}
        end_a, end_b = (np.unique(np.append(chance.integers(1, 4 * n, n), 4 * n)) for _ in "ab")
        common = np.intersect1d(end_a, end_b)
        a, b = crosstoken.terminals(end_a, end_b)
        assert (end_b[a] == common[np.searchsorted(common, end_a)]).all() and (end_b[b] == common[np.searchsorted(common, end_b)]).all()


def test_memory_starts_anew(libraries):
    known = crosstoken.Vocabularies(crosstoken.VOCABULARY_A, crosstoken.VOCABULARY_B)
    small, large = crosstoken.Aligner(known, 5, 50), crosstoken.Aligner(known)
    texts = [t for t in odd_texts(200)]
    for at in range(0, len(texts), 20):
        some = pa.array(texts[at: at + 20], pa.large_string())
        one, two = small.align(some), large.align(some)
        assert (one[0] == two[0]).all() and one[1:] == two[1:]


def test_query(spark, libraries):
    found = sorted(tuple(r) for r in entry.queries()["op13_alignment"](spark, SF_SMALL).collect())
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    told, _ = expected([r["text"] for r in docs], *libraries)
    assert found == [(d["doc_id"], *t[1:]) for d, t in zip(docs, told)]
