"""Operator 2, license scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is what stands between line ends and sentence ends. A template is found in a block that has at least
``THRESHOLD`` of the template's distinct words, and in a stretch of as many words as the template has, across any line and
sentence ends, that has them (wrapped lines, "v. 2.0"). The join:

1. *Global order*: the words of all templates are counted over all documents and ordered from rare to frequent (their
   number is that of the templates' words, so it is the only thing that the driver ever sees).
2. *Prefix filter*: of a template with s words that needs c of them, a block must have one of the s - c + 1 rarest. Blocks
   meet templates by an equal join on those words; the templates are broadcast, a fixed table.
3. *Length filter*: the block has at least c distinct words.
4. *Position filter*: if the common word that brought them together stands at place p of the template's order and at place
   r among the block's template words, min(s - p, b - r) words at most follow, with those before it already ruled out or
   counted by their own match: only a pair's first common word goes on.
5. The remaining pairs are counted exactly.

Stretches go the same way: around each of the rarest words, the words that a window with it can reach are a block of their
own if they cross a block's end, and of those that pass, each window is counted. A word reaches as far as the longest template
that has it among its rarest, so whole licenses beside one-line wordings do not widen what stands around the wordings' words.
``n_blocks`` has the blocks that hold a template, and the places across ends that hold one which no block there holds (windows
that overlap the first of a place belong to it).
``OP2_SQL`` looks at every block and at every window across ends.

The base labels come from phrases at any place of the text. Rows are numbered so that repeated rows stay apart.

Defined cases: a null or empty text has no words and no labels, and score 0; first_word and last_word are null without base
places; a null doc_id is kept; an empty table gives an empty result; other columns, under any name, are not read; a very long
text is scanned whole, in its row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.license_texts import TEXTS, WORDINGS
from pairscope.llm.store import documents

THRESHOLD = 0.9

# fixed values: the phrases of the contract
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = WORDINGS + TEXTS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text in lower case
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of a text as it came
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_END = r"[\n\r]+|[.!?][ \t]"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def phrase_pattern(phrase: str) -> str:
    """The phrase's words in a text as it came, with word ends before and after."""
    words = GAP.join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in phrase.split())
    return rf"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]){words}(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def templates(texts: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Of each (label, text), its distinct words, how many of them are needed, and its length in words."""
    out = []
    for k, (label, text) in enumerate(texts):
        own = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        words = sorted(set(own))
        out.append({"template": k, "label": label, "words": words, "need": math.ceil(threshold * len(words)), "span": len(own)})
    return [t for t in out if t["words"]]


def _literal(words) -> Column:
    return F.array(*map(F.lit, words))


def _any_like(column: str, pattern: str) -> Column:
    return F.exists(column, lambda x: x.rlike(pattern))


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The templates' words by the number of documents that have them, rarest first."""
    own = F.array_intersect(F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), 0), _literal(words))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # at most the templates' words
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(text: Column, any_rare: str) -> Column:
    """The blocks that have a rare word: lo (the block's number), block."""
    each = F.transform(F.split(text, BLOCK_END), lambda b, i: F.struct(i.alias("lo"), b.alias("block")))
    return F.filter(each, lambda x: x["block"].rlike(any_rare))


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, grouped by the first letter so that few of them are tried at a place."""
    by = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def _stretches(text: Column, reach: dict[str, int]) -> Column:
    """Around each rare word, what windows of up to its ``reach`` can hold, if that crosses a block's end: at (the first
    word's place in the text), reach, own (word and number of the block of each)."""
    far = F.create_map(*(F.lit(x) for pair in reach.items() for x in pair))
    words = lambda b, i: F.transform(F.regexp_extract_all(lowered(b), F.lit(WORD), 0), lambda w: F.struct(w.alias("w"), i.alias("i")))
    spots = lambda all_: F.filter(F.transform(all_, lambda x, k: F.when(x["w"].isin(list(reach)), F.struct(k.alias("k"), x["w"].alias("w")))), lambda s: s.isNotNull())

    def around(all_: Column) -> Column:
        def cut(spot: Column) -> Column:
            k, own = spot["k"], F.element_at(far, spot["w"])
            at = F.greatest(k - (own - 1), F.lit(0))
            return F.struct(at.alias("at"), own.alias("reach"), F.slice(all_, at + 1, k - at + own).alias("own"))

        return F.filter(F.transform(spots(all_), cut), lambda s: F.element_at(s["own"], 1)["i"] < F.element_at(s["own"], -1)["i"])

    return _let(F.flatten(F.transform(F.split(text, BLOCK_END), words)), around)


def _places(hits: Column) -> Column:
    """How many places the windows' hits are: those of a template that overlap the first of a place belong to it."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("template"), F.lit(0).alias("start"))

    def step(s: Column, h: Column) -> Column:
        new = (h["template"] != s["template"]) | (h["start"] - s["start"] >= h["span"])
        return F.when(new, F.struct((s["n"] + 1).alias("n"), h["template"].alias("template"), h["start"].alias("start"))).otherwise(s)

    return F.aggregate(F.array_sort(hits), start, step, lambda s: s["n"])


def scan(docs: DataFrame, texts: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks of each row.

    ``texts``: (label, text) of each template, a table that is given (up to whole licenses) and does not grow with the data.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = templates(texts, threshold)
    order = word_order(docs, sorted({w for t in known for w in t["words"]}))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for t in known:
        words = sorted(t["words"], key=rank.get)
        rows += [(words[p], t["template"], t["label"], p, words, t["need"], t["span"]) for p in range(len(words) - t["need"] + 1)]
    table = docs.sparkSession.createDataFrame(rows, "word string, template int, label string, p int, words array<string>, need int, span int")
    reach = {}
    for word, *_, span in rows:
        reach[word] = max(span, reach.get(word, 0))
    rare = sorted(reach)

    text = F.col("text")
    every = "|".join(map(phrase_pattern, PHRASES))
    pieces, places = F.split(text, every), F.regexp_extract_all(text, F.lit(every), 0)
    count = lambda x: F.regexp_count(x, F.lit(ANY_WORD)).cast("long")
    any_rare = "(?i)(?<![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])" + any_of(rare) + "(?![^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F])"
    base = docs.select(
        F.monotonically_increasing_id().alias("row__"),
        "doc_id",
        count(text).alias("n_words"),
        F.when(text.rlike("(?i)license|cc" + GAP + "by"), places).otherwise(F.array().cast("array<string>")).alias("places"),
        F.when(text.rlike(any_rare), _blocks(text, any_rare)).alias("blocks"),
        F.when(text.rlike(any_rare), _stretches(text, reach)).alias("stretches"),
        F.when(text.rlike("(?i)license|cc" + GAP + "by"), pieces).alias("pieces"),
    )
    some = F.size("places") > 0
    base = base.select(
        "row__",
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.when(some, count(F.element_at("pieces", 1))).alias("first_word"),
        F.when(some, F.col("n_words") - count(F.element_at("pieces", -1)) - count(F.element_at("places", -1))).alias("last_word"),
        F.array_compact(F.array(*(F.when(_any_like("places", phrase_pattern(p)), label) for p, label in PHRASES.items()))).alias("base"),
        F.explode_outer(
            F.concat(
                F.transform("blocks", lambda b: F.struct(b["lo"].alias("lo"), b["block"].alias("block"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("reach"), F.lit(None).cast("array<struct<w:string,i:int>>").alias("seen"))),
                F.transform("stretches", lambda s: F.struct(F.lit(None).cast("int").alias("lo"), F.lit(None).cast("string").alias("block"), s["at"].alias("at"), s["reach"].alias("reach"), s["own"].alias("seen"))),
            )
        ).alias("piece"),
    ).select("*", "piece.*").drop("piece")
    # a block's or stretch's distinct words, and those of templates in the global order
    words = F.array_distinct(F.coalesce(F.transform("seen", lambda x: x["w"]), F.regexp_extract_all(lowered(F.col("block")), F.lit(WORD), 0)))
    met = base.withColumn("own", words).withColumn("common", F.array_intersect(_literal(order), "own")).withColumn("word", F.explode_outer(F.array_intersect(_literal(rare), "own")))
    pairs = met.join(F.broadcast(table), "word", "left")  # a row per word of a template's prefix
    follow = F.least(F.size("words") - F.col("p"), F.size("common") - F.array_position("common", F.col("word")) + 1)
    first = F.forall(F.slice("words", 1, F.col("p")), lambda w: ~F.array_contains("common", w))
    fits = F.col("reach").isNull() | (F.col("reach") >= F.col("span"))  # a longer template is looked for around its own words
    passed = fits & (F.size("own") >= F.col("need")) & (follow >= F.col("need")) & first
    shared = F.when(passed, F.size(F.array_intersect("words", "common")))
    shape = "array<struct<template:int,start:int,lo:int,hi:int,span:int,label:string,share:double>>"

    def hit(start: Column, lo: Column, hi: Column, n: Column) -> Column:
        return F.struct(F.col("template"), start.cast("int").alias("start"), lo.alias("lo"), hi.alias("hi"), F.col("span"), F.col("label"), (n / F.size("words")).alias("share"))

    def window(k: Column) -> Column:
        inside = lambda part: hit(F.col("at") + k, F.element_at(part, 1)["i"], F.element_at(part, -1)["i"], F.size(F.array_intersect("words", F.transform(part, lambda x: x["w"]))))
        return _let(F.slice("seen", k + 1, F.col("span")), inside)

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size("seen") - F.col("span"), F.lit(0))), window), lambda h: h["share"] * F.size("words") >= F.col("need") - 0.5)
    found = F.when(shared >= F.col("need"), F.when(F.col("seen").isNull(), F.array(hit(F.lit(None), F.col("lo"), F.col("lo"), shared)).cast(shape)).otherwise(windows.cast(shape)))
    own_key = ["row__", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    gathered = pairs.select(*own_key, found.alias("found")).groupBy(*own_key).agg(F.flatten(F.collect_list("found")).alias("found"))
    whole = F.filter("found", lambda h: h["start"].isNull())
    crossing = F.array_distinct(F.filter("found", lambda h: h["start"].isNotNull()))
    apart = F.filter("crossing", lambda h: ~F.exists("whole", lambda b: (b["template"] == h["template"]) & b["lo"].between(h["lo"], h["hi"])))
    split = gathered.select(*own_key, whole.alias("whole"), crossing.alias("crossing")).select(*own_key, "whole", apart.alias("apart"))
    split = split.withColumn("hits", F.concat("whole", "apart"))
    return split.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))).alias("score"),
        (F.size("whole") + _places(F.col("apart"))).cast("long").alias("n_blocks"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def sql(texts: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same rows from every block and every window across block ends; only texts that have enough of a template's words
    at all are looked into."""
    values = ", ".join(f"({t['template']}, '{t['label']}', {t['words']!r}, {t['need']}, {t['span']})" for t in templates(texts, threshold))
    hits = " UNION ALL ".join(
        f"SELECT r, i - 1 AS spot, '{label}' AS label FROM w, unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] = '{p.split()[0]}' AND list_slice(w, i, i + {len(p.split()) - 1}) = {p.split()!r}" for p, label in PHRASES.items()
    )
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM d),
hits AS ({hits}),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY r),
tpl(template, label, words, need, span) AS (VALUES {values}),
near AS (SELECT r, template, label, words, need, span FROM (SELECT r, list_distinct(w) AS own FROM w), tpl WHERE len(own) >= need AND len(list_intersect(own, words)) >= need),
parts AS (SELECT r, string_split_regex(t, '[\n\r]+|[.!?][ \t]') AS b FROM d WHERE r IN (SELECT r FROM near)),
blocks AS (SELECT r, i AS lo, regexp_extract_all(b[i], '{WORD}') AS own FROM parts, unnest(range(1, len(b) + 1)) AS u(i)),
whole AS (SELECT r, template, label, lo, len(list_intersect(list_distinct(own), words)) / len(words) AS share FROM blocks JOIN near USING (r) WHERE len(list_intersect(list_distinct(own), words)) >= need),
line AS (SELECT r, flatten(list(list_transform(own, lambda x: {{'w': x, 'i': lo}}) ORDER BY lo)) AS line FROM blocks GROUP BY r),
windows AS (SELECT r, template, label, words, need, span, start, list_slice(line, start + 1, start + span) AS part FROM line JOIN near USING (r), unnest(range(0, greatest(len(line) - span, 0) + 1)) AS u(start)),
crossing AS (SELECT r, template, label, span, start, part[1].i AS lo, part[-1].i AS hi, len(list_intersect(list_distinct(list_transform(part, lambda x: x.w)), words)) / len(words) AS share FROM windows
             WHERE part[1].i < part[-1].i AND len(list_intersect(list_distinct(list_transform(part, lambda x: x.w)), words)) >= need),
apart AS (SELECT * FROM crossing c WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.r = c.r AND b.template = c.template AND b.lo BETWEEN c.lo AND c.hi)),
places AS (SELECT r, template, span, min(start) AS start FROM apart GROUP BY r, template, span
           UNION ALL SELECT p.r, p.template, p.span, min(a.start) FROM places p JOIN apart a ON a.r = p.r AND a.template = p.template AND a.start >= p.start + p.span GROUP BY p.r, p.template, p.span, p.start),
found AS (SELECT r, label, share, 1 AS one FROM whole UNION ALL SELECT r, label, share, 0 FROM apart UNION ALL SELECT r, NULL, NULL, 1 FROM places),
added AS (SELECT r, list(DISTINCT label) FILTER (label IS NOT NULL) AS added, max(share) AS share, sum(one) AS n_blocks FROM found GROUP BY r)
SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(added, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM d JOIN w USING (r) LEFT JOIN base USING (r) LEFT JOIN added USING (r)
"""


OP2_SQL = sql()
