"""Language identification by averaged hashed subword embeddings (operator 2).

A text is the mean of the embeddings of its words' hashed character n-grams; a linear
softmax reads the mean. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. A temperature, fitted on rows that the descent never saw,
calibrates the probabilities, and the rejection threshold is set on the same rows.

As the softmax is linear, embeddings and weights fold into one table of class scores per
n-gram bucket: a whole text costs one look-up per distinct word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.parts import once, slices
from flowlure.llm.words import VectorMemory, sums, words_of

BUCKETS = 1 << 15
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
#: Bounds of the training sample: rows per language, and segments of a row's text, drawn over its whole length.
ROWS_PER_LANGUAGE = 700
SEGMENTS_PER_TEXT = 8
#: Words of a segment; a run without white space counts as words of WORD_CHARS.
SEGMENT = 40
WORD_CHARS = 100
#: Languages with fewer labelled rows in the sample are not learned.
LEAST_ROWS = 5
#: Share of correctly read calibration texts that the rejection threshold may cost, and its highest value.
REJECTED_SHARE = 0.001
HIGHEST_THRESHOLD = 0.5
#: Words that a worker remembers.
REMEMBERED_WORDS = 300_000
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def ngrams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram; a word counts by its lower-case letters, with its ends marked."""
    clean = [(w if w.isalpha() else "".join(filter(str.isalpha, w))).lower() for w in words]
    marked = "".join("<" + w + ">" if w else "" for w in clean)
    points = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(clean)), [len(w) + 2 if w else 0 for w in clean])
    of, at = [], []
    for n in NGRAMS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k: k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1:]
        of.append(owner[:m][inside])
        at.append((h[inside] % np.uint64(buckets)).astype(np.int64))
    return (np.concatenate(of), np.concatenate(at)) if of else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class LanguageModel:
    """Trained scores. ``table``: per bucket a score per language; ``bias`` per language."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Per word the sum of its n-grams' scores, and their number."""
        owner, at = ngrams(words, len(self.table))
        n = len(words)
        scores = [np.bincount(owner, self.table[at, c], n) for c in range(self.table.shape[1])]
        return np.column_stack([*scores, np.bincount(owner, minlength=n)])

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities from summed word rows (``word_rows``)."""
        logits = (rows[:, :-1] / np.maximum(rows[:, -1:], 1) + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True, initial=-np.inf))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str], epochs: int = 6, rate: float = 20.0, batch: int = 64, segment: int = SEGMENT, seed: int = 7) -> LanguageModel:
    """Fit on bounded rows. Whole texts are cut into segments of words, so that short texts are learned too."""
    names = sorted({x for x in languages if languages.count(x) >= LEAST_ROWS})
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    bags, labels, held = [], [], []
    for i, (text, lang) in enumerate(zip(texts, languages)):
        if lang not in names:
            continue
        codes = [vocabulary.setdefault(w, len(vocabulary)) for w in text.split()]
        for a in range(0, len(codes), segment):
            bags.append(np.array(codes[a: a + segment]))
            labels.append(names.index(lang))
            held.append(i % 5 == 0)
    owner, at = ngrams(list(vocabulary), BUCKETS)
    bounds = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    size = np.diff(bounds)
    labels, held = np.array(labels, np.int64), np.array(held)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(names))), np.zeros(len(names))

    def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.concatenate([bags[r] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(bags[r]) for r in rows])
        n = size[words]
        where = at[np.repeat(bounds[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        row = np.repeat(row, n)
        return where, row, 1.0 / np.maximum(np.bincount(row, minlength=len(rows)), 1)

    def means(where: np.ndarray, row: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(row, embedding[where, d], len(share)) for d in range(DIMENSIONS)]) * share[:, None]

    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(bags))
    # Rare languages weigh as much as frequent ones.
    balance = len(learn) / (len(names) * np.maximum(np.bincount(labels[learn], minlength=len(names)), 1))
    for epoch in range(epochs):
        order = rng.permutation(learn)
        step = rate * (1 - epoch / epochs)
        for a in range(0, len(order), batch):
            rows = order[a: a + batch]
            where, row, share = features(rows)
            x = means(where, row, share)
            error = softmax(x @ weights + bias)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= np.minimum(balance, 5)[labels[rows]][:, None] / len(rows)
            back = (error @ weights.T) * share[:, None]
            used, place = np.unique(where, return_inverse=True)
            for d in range(DIMENSIONS):
                embedding[used, d] -= step * np.bincount(place, back[row, d], len(used))
            weights -= 0.1 * step * x.T @ error
            bias -= 0.1 * step * error.sum(axis=0)

    model = LanguageModel(names, (embedding @ weights).astype(np.float32), bias)
    check = np.flatnonzero(held) if held.any() else learn
    where, row, share = features(check)
    logits = means(where, row, share) @ weights + bias
    rows, right = np.arange(len(check)), labels[check]
    losses = {t: -np.log(np.maximum(softmax(logits / t)[rows, right], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(logits / model.temperature)
    good = p.max(axis=1)[p.argmax(axis=1) == right]
    if len(good):
        model.threshold = float(min(np.quantile(good, REJECTED_SHARE), HIGHEST_THRESHOLD))
    return model


def fit(labelled: DataFrame) -> LanguageModel:
    """Train on a sample of rows with text and lang, of at most ROWS_PER_LANGUAGE distinct texts a language.

    Rows without text, letters or lang are not drawn. The draw goes by a hash of the text, so
    it is the same in every run and copies count once, whatever their doc_id. Languages with
    fewer than LEAST_ROWS texts drawn are not learned. Of a text, of any length, the driver gets at most SEGMENTS_PER_TEXT segments (``_drawn``).
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    texts = usable.groupBy("lang", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("text_hash"), "text_hash")
    ids = texts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ROWS_PER_LANGUAGE).drop("place")
    key = ["doc_id", "lang", "text_hash"]  # bounded: rows per language
    found = usable.join(F.broadcast(ids), key, "left_semi").dropDuplicates(key)
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in found.transform(_drawn).collect())
    return train([r[2] for r in rows], [r[1] for r in rows])


def _drawn(rows: DataFrame) -> DataFrame:
    """doc_id, lang and text, cut down to SEGMENTS_PER_TEXT of its segments, in order, picked by a hash of their place."""
    worded = rows.select("doc_id", "lang", F.regexp_extract_all("text", F.lit(rf"(\S{{1,{WORD_CHARS}}})"), F.lit(1)).alias("words"))
    places = F.sequence(F.lit(0), F.ceil(F.size("words") / SEGMENT).cast("int") - 1)
    by_hash = F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i"))))
    picked = worded.withColumn("picked", F.array_sort(F.transform(F.slice(by_hash, 1, SEGMENTS_PER_TEXT), lambda x: x["i"])))
    kept = F.flatten(F.transform("picked", lambda i: F.slice("words", i * SEGMENT + 1, SEGMENT)))
    return picked.select("doc_id", "lang", F.array_join(kept, " ").alias("text"))


def predict(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (calibrated, 0 to 1) and rejected, for every whole text.

    Only doc_id and text are read; ``columns`` of the input come along, so that a filter on
    the prediction needs no join. Text that is NULL or has no letter gives ``und``, score 0,
    rejected; so does every text where no language was learned. Rows with equal doc_id are
    predicted each by itself; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = once(("langid", model.key), lambda: VectorMemory(model.word_rows, len(model.languages) + 1, REMEMBERED_WORDS))
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                codes, offsets, words = words_of(texts)
                rows = sums(memory.of(words)[codes], offsets)
                known = (rows[:, -1] > 0) & bool(model.languages)
                best, score = np.full(len(rows), len(model.languages)), np.zeros(len(rows))
                if known.any():
                    p = model.probabilities(rows[known])
                    best[known], score[known] = p.argmax(axis=1), p.max(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), pa.array(names[best], pa.string()), pa.array(score),
                    pa.array(~known | (score < model.threshold)), *(batch.column(k).slice(at, len(texts)) for k in range(2, batch.num_columns)),
                ], ["doc_id", "lang_pred", "score", "rejected", *columns])

    kinds = dict(docs.dtypes)
    along = [F.col(c).alias(f"along_{k}") for k, c in enumerate(columns)]
    return docs.select(F.col("doc_id").cast("long"), "text", *along).mapInArrow(run, SCHEMA + "".join(f", `{c}` {kinds[c]}" for c in columns))
