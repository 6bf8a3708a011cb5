"""Secret scans over a trigram inverted index (operator 11).

Each rule's regular expression gives a Boolean query of trigrams that every match must hold.
The index has one posting per trigram that some rule asks for and text that holds it;
intersecting postings gives the (text, rule) pairs that can match, and only those meet the
regular expression. Rules without a mandatory trigram scan all texts. Everything is
DataFrame functions on Spark's JVM side; Python only reads the rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlure.llm.tables import drop_kept, keep


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in their order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so asking for the least length at once finds the same ones.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Further kinds, by the forms that their issuers publish.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,250}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,250}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[!-.0-9;-?A-~]{1,100}:[!-.0-9;-?A-~]{1,100}@"),
)
RULES = BASE + MORE

#: Strings that a part of a pattern may stand for, up to which they are followed one by one.
FOLLOWED = 32
KEY = ("doc_id", "text_hash")

#: A query in conjunctive form: every part needs one of its alternatives, an alternative all of its trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What a match of ``pattern`` must hold, in lower-cased trigrams; empty where nothing is mandatory."""
    strings, query = _walk(parser.parse(pattern))
    return query + _asked(strings)


def _asked(strings: set[str] | None) -> Query:
    """The part that says "one of these strings": nothing if one of them is too short to have a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return []
    return [_least({frozenset(s[i: i + 3] for i in range(len(s) - 2)) for s in strings})]


def _least(alternatives: set[frozenset[str]]) -> list[frozenset[str]]:
    """Alternatives without those that ask for more than another one."""
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _walk(tree) -> tuple[set[str] | None, Query]:
    """(the strings that a sequence of pattern items can end a match with, what was asked before them).

    None: any strings. Runs of followed strings are closed by an item that is not followed.
    """
    run: set[str] | None = {""}
    query: Query = []
    whole = True  # the run reaches back to the sequence's beginning
    for op, value in tree:
        strings, asked = _item(op, value)
        query += asked
        joined = {a + b for a, b in product(run, strings)} if run is not None and strings is not None else None
        if joined is not None and len(joined) <= FOLLOWED:
            run = joined
            continue
        query += _asked(run)
        whole, run = False, strings or {""}
    if whole:
        return run, query
    return None, query + _asked(run)


def _item(op, value) -> tuple[set[str] | None, Query]:
    """Strings an item can stand for (None: not followed) and what it asks for itself."""
    if op is C.LITERAL:
        return {chr(value).lower()}, []
    if op is C.IN:
        letters: set[str] = set()
        for kind, x in value:
            if kind is C.LITERAL:
                letters.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < FOLLOWED:
                letters |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None, []
        return (letters, []) if len(letters) <= FOLLOWED // 4 else (None, [])
    if op is C.SUBPATTERN:
        return _walk(value[-1])
    if op is C.BRANCH:
        found = [_walk(b) for b in value[1]]
        if all(s is not None and not q for s, q in found):
            return set().union(*(s for s, _ in found)), []
        # Alternatives of several parts: any one trigram set of each is a consequence of it.
        firsts = [q + _asked(s) for s, q in found]
        return None, [_least({alt for q in firsts for alt in q[0]})] if all(firsts) else []
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, body = value
        strings, asked = _walk(body)
        if least == 0:
            return ({""} | strings, []) if most == 1 and strings is not None and not asked else (None, [])
        if strings is not None and most == least == 1:
            return strings, asked
        return None, asked + _asked(strings)
    if op is C.AT:
        return {""}, []
    return None, []


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) with NULL text as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(texts: DataFrame, trigrams: list[str], scanned: tuple[Rule, ...] = ()) -> DataFrame:
    """(gram, doc_id, text_hash) per trigram that a text holds, in either case; and, from the
    same scan, (rule, doc_id, text_hash) per text that a rule without mandatory trigrams matches."""
    low = texts.withColumn("low", F.lower("text"))
    none = F.lit(None).cast("string")
    grams = [F.when(F.contains(F.col("low"), F.lit(g)), F.struct(F.lit(g).alias("gram"), none.alias("rule"))) for g in trigrams]
    hits = [F.when(F.col("text").rlike(r.pattern), F.struct(none.alias("gram"), F.lit(r.kind).alias("rule"))) for r in scanned]
    return low.select(*KEY, F.inline(F.array_compact(F.array(*grams, *hits))))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(rule, doc_id, text_hash) whose postings meet the rule's query.

    An alternative holds where as many of its trigrams have a posting as it has; a part where
    one of its alternatives holds; a query where all of its parts hold.
    """
    rows = [
        F.struct(F.lit(g).alias("gram"), F.lit(kind).alias("rule"), F.lit(p).alias("part"), F.lit(a).alias("alternative"), F.lit(len(alt)).alias("grams"), F.lit(len(query)).alias("parts"))
        for kind, query in queries.items() for p, part in enumerate(query) for a, alt in enumerate(part) for g in sorted(alt)
    ]
    # A row per rule's trigram: bounded by the rules, not by the data.
    asked = F.broadcast(index.sparkSession.range(1).select(F.inline(F.array(*rows))))
    found = index.where(F.col("gram").isNotNull()).select("gram", *KEY).distinct().join(asked, "gram")
    held = found.groupBy(*KEY, "rule", "part", "alternative").agg(F.count("*").alias("n"), F.min("grams").alias("grams"), F.min("parts").alias("parts")).where(F.col("n") == F.col("grams"))
    parts = held.select(*KEY, "rule", "part", "parts").distinct()
    return parts.groupBy(*KEY, "rule").agg(F.count("*").alias("n"), F.min("parts").alias("parts")).where(F.col("n") == F.col("parts")).select("rule", *KEY)


def _by_rule(rules: tuple[Rule, ...], value) -> Column:
    """A rule's value, looked up by the column ``rule``."""
    return F.create_map(*[F.lit(x) for r in rules for x in (r.kind, value(r))])[F.col("rule")]


def spans(texts: DataFrame, found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_hash, rule, place, start, end, value): verified matches, in code points, end exclusive.

    ``found`` names the (rule, text) pairs to look at. A match ends where the pieces between
    matches and the matches up to it end: a running sum, linear in their number.
    """
    named = found.select(F.col("rule"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    met = texts.join(named, texts["doc_id"].eqNullSafe(named["id"]) & (texts["text_hash"] == named["hash"]))
    # Rows alike in doc_id and text are one text here.
    once = met.groupBy(*KEY, "rule").agg(F.any_value("text").alias("text"))
    pattern, group = _by_rule(rules, lambda r: r.pattern), _by_rule(rules, lambda r: r.group)
    cut = once.select(*KEY, "rule", F.split("text", pattern, -1).alias("between"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"), F.regexp_extract_all("text", pattern, group).alias("value"))
    each = cut.select(*KEY, "rule", F.posexplode(F.arrays_zip("between", "match", "value")).alias("place", "m"))
    rows = each.select(*KEY, "rule", "place", F.length("m.match").alias("size"), F.length("m.between").alias("before"), F.col("m.value").alias("value")).where(F.col("size").isNotNull())
    so_far = Window.partitionBy(*KEY, "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    return placed.where(F.length("value") >= _by_rule(rules, lambda r: r.least)).select(*KEY, "rule", "place", "start", "end", "value")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, rule, place, start, end, value) of every secret in ``docs``.

    Matches of a rule are leftmost and do not overlap; those with a value shorter than the
    rule's least go afterwards. NULL text reads as empty; rows alike in doc_id and text give
    their matches once; rows without doc_id give theirs under NULL. Only doc_id and text are
    read, so other columns may have any name. An empty table gives no rows.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    grams = sorted({g for q in asked.values() for part in q for alt in part for g in alt})
    texts = folded(docs)
    index = keep(postings(texts, grams, tuple(r for r in rules if r.kind not in asked)), "trigram-index")
    whole = index.where(F.col("rule").isNotNull()).select("rule", *KEY).distinct()
    found = keep(candidates(index, asked).unionByName(whole) if asked else whole, "secret-candidates")
    out = keep(spans(texts, found, rules), "secrets")
    drop_kept(index, found)
    return out


def digest(docs: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per row of ``docs``: doc_id, counts per base kind, the digest of the base spans and all spans as text."""
    order = _by_rule(rules, lambda r: [x.kind for x in rules].index(r.kind))
    span = F.concat_ws(":", F.col("rule"), F.col("start").cast("string"), F.col("end").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("start"), order.alias("order"), span.alias("span"))))
    per_text = found.groupBy(*KEY).agg(listed.alias("all")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "all")
    keys = folded(docs).select(*KEY)
    joined = keys.join(per_text, keys["doc_id"].eqNullSafe(F.col("id")) & (keys["text_hash"] == F.col("hash")), "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,order:int,span:string>>"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: s["span"]), ",")
    of = lambda i: F.filter(every, lambda s: s["order"] == i)
    counts = [F.size(of(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules) if r in base]
    basic = F.filter(every, lambda s: s["order"] < len(base))
    return joined.select("doc_id", *counts, F.sha2(F.encode(text(basic), "utf-8"), 256).alias("base_sha256"), text(every).alias("spans"))
