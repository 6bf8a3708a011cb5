"""Quality rules by tokeniser fertility (operator 10).

Public vocabularies read every whole text: letters per token of a sentencepiece and of a
byte-level vocabulary, the first one's byte-fallback share and the entropy of its tokens.
Words with a digit and addresses are left out of the letters per token.
A text is kept when each measure lies in the band of its language and dominant script. The
bands come from the rows themselves: medians, and spreads that allow a short text more.
Text that no vocabulary was made for (symbol junk, broken encodings, one phrase
over and over) shows as few letters a token, many byte pieces or low entropy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlure.llm.parts import PartMemory, library_encoder, once, slices, split_parts
from flowlure.llm.tables import keep

#: Bytes that separate words: space and 0x09 to 0x0D.
SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Band:
    """Lowest and highest accepted value of each measure."""

    piece_chars: tuple[float, float]
    bpe_chars: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


#: Bands per dominant script, used where a language has too few texts for one of its own.
SCRIPT_BANDS = {
    "latin": Band((1.6, 12.0), (1.45, 14.0), (0.0, 0.20), (4.0, 16.0)),
    "other": Band((0.2, 12.0), (0.15, 14.0), (0.0, 0.98), (2.0, 16.0)),
    "none": Band((1.6, 12.0), (1.45, 14.0), (0.0, 0.20), (4.0, 16.0)),
}
#: Distinct texts from which a language and script have a band of their own.
LEAST_TEXTS = 20
#: A band ends so many spreads from the median.
SPREADS = 3.5
#: Spread that texts of one language have at any length; of the letters per token as a share of the median.
OWN_SPREAD = {"piece_chars": 0.02, "bpe_chars": 0.02, "byte_share": 0.05, "entropy": 0.5}
#: The normal distribution's standard deviation in median absolute deviations.
MAD = 1.4826
SCRIPTS = tuple(SCRIPT_BANDS)
SCHEMA = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "script string, plain_tokens long, piece_chars double, bpe_chars double, byte_share double, entropy double"
)
LETTERS = re.compile(r"[^\W\d_]")
#: Words outside the letters per token: with a digit, or an address.
CODED = re.compile(r"\d|@|://|^www\.")
LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")


class WordPieces:
    """Ids of words by the sentencepiece library, and sizes under a byte-level vocabulary."""

    def __init__(self, pieces: str, bytes_file: str):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        self.is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        self.memory = PartMemory(lambda words: model.encode(words, num_threads=1))
        encoder = library_encoder(bytes_file, True)
        self.bpe = PartMemory(lambda words: [(len(x), len(LETTERS.findall(w)), len(LATIN.findall(w)), int(CODED.search(w) is None)) for w, x in zip(words, encoder.memory.encode_many([" " + w for w in words]))])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code per word, first word per text with a closing end, distinct words)."""
    raw, ends = _bytes(texts)
    spaced = raw.copy()
    spaced[SEPARATORS[raw]] = 0x20
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(spaced.tobytes()))
    codes, offsets, parts = split_parts(plain)
    if "" not in parts:
        return codes, offsets, parts
    real = codes != parts.index("")
    return codes[real], np.concatenate([[0], np.cumsum(real)])[offsets], parts


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, with a closing end."""
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(flags)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, words in three-word windows that the text holds twice or more."""
    n = len(codes)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(owner[2:] == owner[:-2]) if n > 2 else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    size = int(codes.max()) + 1
    pair = codes[starts] * size + codes[starts + 1]
    _, pair = np.unique(pair, return_inverse=True)
    tail = codes[starts + 2] * len(offsets) + owner[starts]
    order = np.lexsort((tail, pair))
    same = (pair[order][1:] == pair[order][:-1]) & (tail[order][1:] == tail[order][:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts[twice] + k] = True
    return _sums(covered, offsets)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text, lines with a word that equal an earlier line of it."""
    codes, offsets, lines = split_parts(texts, "\n")
    worded = np.array([bool(line.strip(" \t\n\v\f\r")) for line in lines], bool)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    _, first = np.unique(owner * (len(lines) + 1) + codes, return_index=True)
    again = np.ones(len(codes), bool)
    again[first] = False
    return _sums(again & worded[codes], offsets)


def entropies(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per text, entropy in bits of its token distribution."""
    keys, counts = np.unique(owner * np.int64(1 << 32) + ids, return_counts=True)
    owners = keys >> np.int64(32)
    total = np.bincount(owners, counts, n)
    logs = np.bincount(owners, counts * np.log2(counts), n)
    return np.where(total > 0, np.log2(np.maximum(total, 1)) - logs / np.maximum(total, 1), 0.0)


def measure(docs: DataFrame, pieces: str = "piece_bpe_32k.model", bytes_file: str = "byte_bpe_50k.json") -> DataFrame:
    """Base counts and fertility measures of every whole text, one row per input row.

    Rows need doc_id, text and lang (NULL where unknown); other columns are not read. NULL
    text counts as empty: all counts 0, script ``none``. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = once(("fertility", pieces, bytes_file), lambda: WordPieces(pieces, bytes_file))
        for batch in batches:
            for at, texts in slices(batch.column(2), 4_000_000):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in (0, 1)), *_measures(texts, tools)], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(run, SCHEMA)


def _measures(texts: pa.Array, tools: WordPieces) -> list[pa.Array]:
    n = len(texts)
    raw, ends = _bytes(texts)
    codes, offsets, words = _words(texts)
    n_words = np.diff(offsets)
    space = _sums(SEPARATORS[raw], ends)
    word_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False) - space
    symbols = _sums(SYMBOLS[raw], ends)
    slots = tools.memory.slots(words)[codes]
    sizes = tools.memory.size[slots]
    shift = tools.memory.start[slots] - (np.cumsum(sizes) - sizes)
    ids = tools.memory.pool[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].astype(np.int64)
    word_owner = np.repeat(np.arange(n), n_words)
    owner = np.repeat(word_owner, sizes)
    tokens = np.bincount(owner, minlength=n)
    bpe_slots = tools.bpe.slots(words)
    of_word = tools.bpe.pool.reshape(-1, 4)[tools.bpe.start[bpe_slots] // 4][codes].astype(np.int64)
    letters, latin = (np.bincount(word_owner, of_word[:, k], n) for k in (1, 2))
    plain = of_word[:, 3]
    bpe, plain_letters, plain_tokens = (np.bincount(word_owner, plain * x, n) for x in (of_word[:, 0], of_word[:, 1], sizes))
    script = np.where(letters < 0.2 * np.maximum(word_chars, 1), 2, np.where(latin >= 0.5 * letters, 0, 1))
    return [
        pa.array(n_words, pa.int64()), pa.array(word_chars, pa.int64()), pa.array(symbols, pa.int64()),
        pa.array(duplicate_lines(texts), pa.int64()), pa.array(repeated_words(codes, offsets), pa.int64()),
        pa.array(np.array(SCRIPTS, object)[script], pa.string()),
        pa.array(plain_tokens.astype(np.int64)),
        pa.array(plain_letters / np.maximum(plain_tokens, 1)), pa.array(plain_letters / np.maximum(bpe, 1)),
        pa.array(np.bincount(owner, tools.is_byte[ids], n) / np.maximum(tokens, 1)), pa.array(entropies(ids, owner, n)),
    ]


def bands(measured: DataFrame) -> DataFrame:
    """(group_lang, group_script, per measure its median and the spread of one token) of each group of LEAST_TEXTS texts.

    Texts that pass the base rules vote, those with equal measures (copies) once. Measures are
    rounded, so that a task holds few values and every run gives the same medians.
    """
    by = ["group_lang", "group_script"]
    votes = measured.where(~_base_failed() & (F.col("script") != "none") & (F.col("plain_tokens") > 0)).select(
        F.coalesce("lang", F.lit("")).alias("group_lang"), F.col("script").alias("group_script"), "plain_tokens", *OWN_SPREAD).distinct()
    medians = votes.groupBy(by).agg(F.count("*").alias("texts"), *(F.percentile(F.round(c, 3), 0.5).alias(f"{c}_mid") for c in OWN_SPREAD))
    medians = medians.where(F.col("texts") >= LEAST_TEXTS)
    away = {c: F.round(F.abs(F.col(c) - F.col(f"{c}_mid")) * F.sqrt("plain_tokens"), 2) for c in OWN_SPREAD}
    spreads = votes.join(F.broadcast(medians), by).groupBy(by).agg(*(F.percentile(x, 0.5).alias(f"{c}_one") for c, x in away.items()))
    return medians.join(F.broadcast(spreads), by).select(*by, *(f"{c}_mid" for c in OWN_SPREAD), *((MAD * F.col(f"{c}_one")).alias(f"{c}_one") for c in OWN_SPREAD))


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, scripts: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """Adds base_failed, in_band and kept, from bands of ``measured`` itself (``bands``)."""
    def inside(band: Band) -> Column:
        out = F.lit(True)
        for name in OWN_SPREAD:
            out &= F.col(name).between(*getattr(band, name))
        return out

    measured = keep(measured, "fertility")
    joined = measured.join(F.broadcast(bands(measured)), (F.coalesce("lang", F.lit("")) == F.col("group_lang")) & (F.col("script") == F.col("group_script")), "left")
    within, learned = F.lit(False), F.col("plain_tokens") > 0
    for script, band in scripts.items():
        within = F.when(F.col("script") == script, inside(band)).otherwise(within)
    for name, share in OWN_SPREAD.items():
        mid, value = F.col(f"{name}_mid"), F.col(name)
        own = share * mid if name.endswith("_chars") else F.lit(share)
        margin = SPREADS * F.sqrt(own * own + F.pow(f"{name}_one", F.lit(2)) / F.greatest("plain_tokens", F.lit(1)))
        learned &= value <= mid + margin if name == "byte_share" else value >= mid - margin
    within = F.when(F.col("group_lang").isNotNull(), learned).otherwise(within)
    return joined.select(*measured.columns, _base_failed().alias("base_failed"), within.alias("in_band")).withColumn("kept", ~F.col("base_failed") & F.col("in_band")).drop("plain_tokens")
