"""Line deduplication by a segment-partition edit join (operator 6).

Lines within a few edits of each other share a segment: a line cut into threshold + 1
segments keeps at least one of them whole under that many edits. Distinct lines are indexed
by (length, segment number, segment); a line probes the index of each admissible length at
the few places where such a segment can lie in it, and pairs that meet are verified with
banded bit-parallel edit distance. Everything is DataFrame functions on Spark's JVM side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.tables import drop_kept, keep

#: Edits (code points inserted, deleted or replaced) up to which lines are near-equal.
THRESHOLD = 2
#: Lines with fewer code points are only compared for equality: their segments say too little.
LEAST_CHARS = 24
#: Frequent letters whose counts tell lines apart before they are paired.
LETTERS = "aeiounrstdlhcmbv"
#: Pieces by which pairs are sifted before their edit distance.
PIECES = 12
COUNTS = ("n_lines", "n_removed", "n_near")
PLACE = ("doc_id", "text_hash", "line")


def _has_word(text: Column) -> Column:
    return F.ltrim(text, F.lit(" \t\n\x0b\x0c\r")) != ""


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of the documents that have lines with a place."""
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, text, h1, h2) of every line with a word; ``line`` counts from 0."""
    rows = _keyed(docs).select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return rows.where(_has_word(F.col("text"))).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, copies): each distinct line with its first place. Texts stay where they are."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies"))


def texts_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (h1, h2, first) with the text of the line that stands there.

    Documents move as they are and only the wanted lines of them are told apart, by one plan at any size.
    """
    wanted = places.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct("h1", "h2", "first")).alias("wanted"))
    told = _keyed(docs).join(wanted.hint("merge"), ["doc_id", "text_hash"])
    found = _let(F.split("text", "\n", -1), lambda parts: F.transform("wanted", lambda p: F.struct(p["h1"].alias("h1"), p["h2"].alias("h2"), p["first"].alias("first"), F.get(parts, p["first"]["line"]).alias("text"))))
    return told.select(F.inline(found)).dropDuplicates(["h1", "h2"])  # a document may be there more than once


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """(start from 1, size) of segment i of ``parts``; the last ones are one longer where it does not divide."""
    size = F.floor(length / parts).cast("int")
    long_from = parts - F.pmod(length, F.lit(parts))
    start = size * i + F.greatest(i - long_from, F.lit(0)) + 1
    return start.cast("int"), size + F.when(i >= long_from, 1).otherwise(0)


def signatures(lines: DataFrame, threshold: int) -> DataFrame:
    """(id, key, indexed): the substrings that each line probes with; its own segments are the ``indexed`` ones among them.

    With a line longer by d than the indexed one, segment i (from 0) can lie only where the
    edits left of it, at most i, and right of it, at most threshold - i, allow.
    """
    # One row of constants per key: twelve expressions side by side make a method too long for the JVM to compile.
    parts = threshold + 1
    specs = []
    for d in range(threshold + 1):
        for i in range(parts):
            low, high = max(-i, d - (threshold - i)), min(i, d + (threshold - i))
            specs += [(d, i, shift) for shift in range(low, high + 1)]
    spec = F.inline(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in specs]))
    # Substrings of bytes are found at once, those of strings by a walk from their begin: bytes where each is a letter.
    plain = F.when(F.octet_length("text") == F.col("size"), F.col("text").cast("binary"))
    rows = lines.select("h1", "text", "size", plain.alias("bytes")).select("h1", "text", "size", "bytes", spec)
    length = F.col("size") - F.col("d")
    start, width = _segment(length, F.col("i"), parts)
    place = start + F.col("shift")
    key = F.when(F.col("bytes").isNull(), F.xxhash64(length, "i", F.substr("text", place, width))).otherwise(F.xxhash64(length, "i", F.substr("bytes", place, width)))
    return rows.select(F.col("h1").alias("id"), key.alias("key"), ((F.col("d") == 0) & (F.col("shift") == 0)).alias("indexed"))


def shared_signatures(lines: DataFrame, threshold: int) -> DataFrame:
    """The signatures (key, id, indexed) that two lines have, one of them as a segment; a kept table.

    Most lines share nothing: they are out before anything but a hash and an id of theirs moves.
    Lines may come more than once.
    """
    alike = Window.partitionBy("key")
    every = signatures(lines, threshold).withColumns({"low": F.min("id").over(alike), "high": F.max("id").over(alike), "met": F.max("indexed").over(alike)})
    return keep(every.where((F.col("low") < F.col("high")) & F.col("met")).groupBy("key", "id").agg(F.max("indexed").alias("indexed")), "line-signatures")


def letter_counts(text: Column) -> Column:
    """Counts of LETTERS in a string, modulo 4 and Gray coded, packed in one number.

    One letter more or less flips one bit.
    """
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))  # one byte each
        packed = packed + F.shiftleft(count.bitwiseAND(F.lit(3)).cast("long"), 2 * k)
    low = int("55555555", 16)  # the lower bit of every pair
    return packed.bitwiseXOR(F.shiftright(packed, 1).bitwiseAND(F.lit(low).cast("long")))


def alike_letters(x: Column, y: Column, threshold: int) -> Column:
    """Whether letter counts differ by no more than ``threshold`` edits can: two bits for each."""
    return F.bit_count(x.bitwiseXOR(y)) <= 2 * threshold


def candidates(lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b): ids of lines that share a segment at admissible places and nearly all letters, a < b."""
    return meeting(shared_signatures(lines, threshold), lines.withColumn("letters", letter_counts(F.col("text"))), threshold)


def meeting(shared: DataFrame, told: DataFrame, threshold: int) -> DataFrame:
    """``candidates`` among lines with shared signatures."""
    letters = told.select(F.col("h1").alias("id"), "letters")
    signed = shared.join(letters, "id")
    index = signed.where("indexed").select("key", F.col("id").alias("x"), F.col("letters").alias("lx"))
    probe = signed.select("key", F.col("id").alias("y"), F.col("letters").alias("ly"))
    met = index.join(probe, "key").where((F.col("x") != F.col("y")) & alike_letters(F.col("lx"), F.col("ly"), threshold))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of two strings, of lengths at most ``threshold`` apart, is at most ``threshold``.

    Bit-parallel over the band of 2 * threshold + 1 diagonals: bit k of a step's vectors
    stands for row (column - threshold + k). The distance is followed down the lowest
    diagonal as far as the first string reaches, then along its last row.
    """
    width = 2 * threshold + 1
    ones = (1 << width) - 1
    x, y = F.split(a, ""), F.split(b, "")
    m, n = F.length(a), F.length(b)

    def step(s: Column, j: Column) -> Column:
        match = _let(F.get(s["y"], j), lambda c: reduce(lambda p, q: p.bitwiseOR(q), (F.when(F.get(s["x"], j - threshold + k) == c, 1 << k).otherwise(0) for k in range(width))))
        return _let(match, lambda pm: _let(_zeros(s["vp"], s["vn"], pm), lambda d0: _let(_horizontal(s, d0), lambda h: close(s, j, d0, h))))

    def _zeros(vp: Column, vn: Column, pm: Column) -> Column:
        return ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(ones))

    def _horizontal(s: Column, d0: Column) -> Column:
        plus = s["vn"].bitwiseOR(F.lit(ones) - d0.bitwiseOR(s["vp"]))
        return F.struct(plus.alias("plus"), d0.bitwiseAND(s["vp"]).alias("minus"), F.shiftright(d0, 1).alias("half"))

    def close(s: Column, j: Column, d0: Column, h: Column) -> Column:
        last = F.size(s["x"]) - 1 - (j - threshold)  # bit of the first string's last row
        bit = lambda v: F.call_function("shiftright", v, last).bitwiseAND(F.lit(1))
        down = F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)
        on = F.when(last >= 0, bit(h["plus"]) - bit(h["minus"])).otherwise(1)
        return F.struct(
            s["x"].alias("x"), s["y"].alias("y"),
            h["minus"].bitwiseOR(F.lit(ones) - h["half"].bitwiseOR(h["plus"])).alias("vp"),
            h["half"].bitwiseAND(h["plus"]).alias("vn"),
            (s["score"] + F.when(last >= width - 1, down).otherwise(on)).cast("int").alias("score"),
        )

    # Rows above the first are no edits away: their vertical steps count nothing.
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(ones & ~((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("score"))
    done = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["score"])
    # A first string shorter than the threshold has its last row inside the band from the start.
    return F.when(F.abs(m - n) > threshold, False).when((m <= threshold) | (n == 0), F.levenshtein(a, b) <= threshold).otherwise(done <= threshold)


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    return _let(F.array_position(differ, True), lambda at: F.when(at == 0, F.length(a)).otherwise(at - 1).cast("int"))


def near(a: Column, b: Column, threshold: int) -> Column:
    """``within_edits`` of what two strings leave without their common prefix and suffix.

    Neither changes the distance, and lines that share most of their text leave little.
    """
    def tails(p: Column) -> Column:
        return F.struct(F.reverse(F.substr(a, p + 1)).alias("a"), F.reverse(F.substr(b, p + 1)).alias("b"))

    def middles(s: Column) -> Column:
        return _let(_shared(s["a"], s["b"]), lambda q: _let(
            F.struct(F.substr(s["a"], q + 1).alias("a"), F.substr(s["b"], q + 1).alias("b")),
            lambda m: within_edits(m["a"], m["b"], threshold)))

    return _let(_shared(a, b), lambda p: _let(tails(p), middles))


def pieces_kept(a: Column, b: Column, threshold: int) -> Column:
    """Whether all but ``threshold`` of PIECES equal pieces of the first string lie somewhere in the second.

    Each edit touches one piece at most, so this holds for all pairs within the threshold;
    it spares the edit distance most pairs that share a segment and nothing else.
    """
    width = F.floor(F.length(a) / PIECES).cast("int")  # what is left at the end belongs to no piece
    found = [F.contains(b, F.substr(a, width * i + 1, width)).cast("int") for i in range(PIECES)]
    return reduce(lambda x, y: x + y, found) >= PIECES - threshold


def near_lines(docs: DataFrame, distinct: DataFrame, threshold: int) -> DataFrame:
    """(a, b, first_a, first_b, and second hashes) of the ``distinct`` lines of ``docs`` within ``threshold`` edits."""
    long = lines_of(docs).withColumn("size", F.length("text")).where(F.col("size") >= max(LEAST_CHARS, threshold + 1))
    shared = shared_signatures(long, threshold)
    # Ids grow with the lines: one plan at any size.
    ids = shared.select(F.col("id").alias("h1")).distinct()
    places = distinct.select("h1", "h2", "first").join(ids.hint("merge"), "h1", "left_semi")
    told = keep(texts_at(docs, places).withColumn("letters", letter_counts(F.col("text"))), "line-texts")
    pairs = keep(meeting(shared, told, threshold), "line-pairs")
    a = told.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("first").alias("first_a"), F.col("text").alias("text_a"))
    b = told.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("first").alias("first_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "a").join(b, "b")
    likely = both.where(pieces_kept(F.col("text_a"), F.col("text_b"), threshold))
    found = keep(likely.where(near(F.col("text_a"), F.col("text_b"), threshold)).select("a", "a2", "first_a", "b", "b2", "first_b"), "near-lines")
    drop_kept(pairs, shared, told)
    return found


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, removed, near): numbers of the lines to remove, and how many of them are not equal to an earlier line."""
    lines = lines_of(docs)
    distinct = keep(distinct_lines(lines), "lines")
    near = near_lines(docs, distinct, threshold)
    partners = near.select(F.col("a").alias("h1"), F.col("a2").alias("h2"), F.col("first_b").alias("other")).unionByName(near.select(F.col("b").alias("h1"), F.col("b2").alias("h2"), F.col("first_a").alias("other")))
    earliest = partners.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    # Only lines that occur again, or have a partner, can lose an occurrence.
    told = distinct.select("h1", "h2", "first", "copies").join(earliest, ["h1", "h2"], "left").where((F.col("copies") > 1) | F.col("other").isNotNull()).drop("copies")
    place = F.struct(*PLACE)
    lost = lines.drop("text").join(told, ["h1", "h2"]).where((place > F.col("first")) | (place > F.col("other")))
    out = keep(lost.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("removed"), F.countDistinct(F.when(place <= F.col("first"), F.col("line"))).alias("near")), "removed-lines")
    drop_kept(distinct, near)
    return out


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, with text replaced by what is left, and n_lines, n_removed, n_near.

    A line with a word goes if an equal line, or one within ``threshold`` edits (both of
    LEAST_CHARS code points or more), stands earlier in the input, by doc_id, then text hash,
    then line number; lines are judged on the input, not on what is left. Lines without a
    word stay. NULL text stays NULL, with no lines; rows without doc_id stay as they are and
    remove nothing. Input columns named like the counts are replaced. Rows alike in doc_id and text count as
    one place: neither removes the other's lines. An empty table gives no rows.
    """
    names = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in names else free("_" + c)  # noqa: E731 a column of the input may have the name
    text_hash, removed = free("text_hash"), free("removed")
    lost = removed_lines(docs, threshold).select(F.col("doc_id").alias(free("doc_key")), F.col("text_hash").alias(text_hash), F.col("removed").alias(removed), F.col("near").alias(free("near")))
    keyed = docs.withColumn(free("text_key"), F.xxhash64("text"))
    joined = keyed.join(lost, (keyed["doc_id"].cast("long") == F.col(free("doc_key"))) & (F.col(free("text_key")) == F.col(text_hash)), "left")
    left = lambda parts: F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(removed)))
    rest = _let(F.split("text", "\n", -1), lambda parts: F.array_join(F.transform(left(parts), lambda i: F.get(parts, i)), "\n"))
    kept = F.when(F.col(removed).isNull(), F.col("text")).otherwise(rest)
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.coalesce(F.size(removed), F.lit(0)).cast("long"),
        "n_near": F.coalesce(F.col(free("near")), F.lit(0)).cast("long"),
        free("left"): kept,
    }).select(*[F.col(free("left")).alias(c) if c == "text" else F.col(c) for c in docs.columns if c.lower() not in COUNTS], *COUNTS)
