"""Operator 11, language ID: word-first backoff.

A word is a run of letters (and the marks on them) in lower case. A word that the model knows adds its log frequency in each
language. A word that no language knows is looked up by its character n-grams, spaces around it included: the longest kind of
which any is known decides, by the mean over the known ones; else the next shorter kind. A text's language has the greatest sum.

Learning: of each language the ``sample`` rows with the least hashes of their ids (of a language with fewer rows, all) are counted,
in one grouping by language and entry; a task counts its own first. Of each language and kind the ``words`` (or ``grams``) most
frequent entries make the model, so that it has a fixed bound beside the number of languages; it goes to the tasks as a whole.
Frequencies are (count + 1/2) / (total + entries / 2), totals over everything counted.

Defined cases: a null text, and one without a letter, is ``und`` with score 0, as is every text if nothing can be learned; a word
of which not even a single character is known says nothing, and a text of such words has equal scores (the first language in order
is named); ties go to the first language in order; rows with a null language, doc_id or text are not learned from; repeated rows are
predicted alike, each in a row of its own, and count each when they are learned from; an empty table gives an empty result; other
columns, under any name, are not read. Very long texts are read whole, in pieces that end where words end.
"""

from __future__ import annotations

import itertools
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.llm.store import as_table, documents

GRAMS = (5, 4, 3, 2, 1)
SAMPLE = 600  # learned rows of a language
WORDS = 40_000  # kept words of a language
KEPT = 20_000  # kept n-grams of a language and length
PIECE = 1 << 20  # characters of a text that are split at once
MEMORY = 300_000  # words that a task remembers
UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pieces(text: str):
    """A long text in parts; a part ends before a character that is part of no word (a word without end is one part)."""
    lo = 0
    while len(text) - lo > PIECE:
        found = regex.compile(r"[^\p{L}\p{M}]").search(text, lo + PIECE)
        if not found:
            break
        yield text[lo : found.start()]
        lo = found.start()
    yield text[lo:]


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)] if n > 1 else list(word)


def _counted(batches):
    """lang, kind (0: word, else the n-gram's length), entry, n: a task's own counts, sent whenever they are many."""

    def sent(held):
        for (lang, _), counts in held.items():
            grams = [Counter() for _ in GRAMS]
            for word, c in counts.items():
                for n, g in zip(GRAMS, grams):
                    for x in grams_of(word, n):
                        g[x] += c
            for kind, some in zip((0, *GRAMS), (counts, *grams)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array([kind] * len(some), pa.int32()), pa.array(list(some), pa.string()), pa.array(list(some.values()), pa.int64())],
                    names=["lang", "kind", "entry", "n"],
                )

    held: dict = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            for part in pieces(text.as_py()):
                held.setdefault((lang, 0), Counter()).update(words_of(part))
                if sum(map(len, held.values())) > 200_000:
                    yield from sent(held)
                    held = {}
    yield from sent(held)


@dataclass(frozen=True)
class Model:
    """langs in order; of each kind (0: words, else n-grams of that length) the entries, with a row of log frequencies each."""

    langs: list[str]
    place: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word: its own, or those of its longest known n-grams."""
        at = np.array([self.place[0].get(w, -1) for w in words], np.int64)
        out = np.zeros((len(words), len(self.langs)))
        out[at >= 0] = self.logs[0][at[at >= 0]]
        left = np.flatnonzero(at < 0).tolist()
        for n in GRAMS:
            get, found, sizes, none = self.place[n].get, [], [], []
            for k in left:
                known = [i for i in map(get, grams_of(words[k], n)) if i is not None]
                found += known
                sizes.append(len(known))
                if not known:
                    none.append(k)
            if found:
                sizes = np.array(sizes)
                mine = np.array(left)[sizes > 0]
                sizes = sizes[sizes > 0]
                out[mine] = np.add.reduceat(self.logs[n][found], np.cumsum(sizes) - sizes) / sizes[:, None]
            left = none
        return out


class _Known(dict):
    """Numbers of words in the order in which they were asked for first."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        return k


def _sums(model: Model, texts: list[list[str]], known: _Known, table: list[np.ndarray]) -> np.ndarray:
    """The sums of each text's words; ``known`` and ``table`` remember words from call to call, until they are many."""
    if len(known) > MEMORY:
        known.clear()
        table[0] = table[0][:0]
    had = len(known)
    sizes = np.array([len(t) for t in texts])
    at = np.fromiter((known[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    if len(known) > had:
        table[0] = np.concatenate([table[0], model.vectors(list(itertools.islice(known, had, None)))])
    out = np.zeros((len(texts), len(model.langs)))
    if len(at):
        out[sizes > 0] = np.add.reduceat(table[0][at], (np.cumsum(sizes) - sizes)[sizes > 0])
    return out


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = KEPT) -> Model:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0, at most ``sample`` ids of each language."""
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # ids alone; Spark limits a language's rows in every task before they meet
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("at", F.row_number().over(first)).where(F.col("at") <= sample).select("doc_id", "lang").distinct()
    counted = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(_counted, "lang string, kind int, entry string, n long")
    counts = as_table(counted.groupBy("lang", "kind", "entry").agg(F.sum("n").alias("n")), "counts")
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}  # six rows a language
    order = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "entry")
    most = F.when(F.col("kind") == 0, words).otherwise(grams)
    kept = counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).select("kind", "entry").distinct()
    rows = counts.join(kept, ["kind", "entry"]).select("lang", "kind", "entry", "n").toPandas()  # bounded by words and grams
    langs = sorted({lang for lang, _ in totals})
    place, logs = {}, {}
    for kind in (0, *GRAMS):
        own = rows[rows["kind"] == kind]
        entries = {e: k for k, e in enumerate(sorted(set(own["entry"])))}
        table = np.full((len(entries), len(langs)), 0.5)
        table[own["entry"].map(entries).to_numpy(np.int64), own["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(np.int64)] += own["n"].to_numpy()
        total = np.array([totals.get((x, kind), 0) for x in langs]) + len(entries) / 2
        place[kind], logs[kind] = entries, np.log(table) - np.log(np.maximum(total, 0.5))
    return Model(langs, place, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the winner's share among the languages) of each row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of ``train``

    def run(batches):
        model = shared.value
        known, table = _Known(), [np.zeros((0, len(model.langs)))]
        for batch in batches:
            total, letters = np.zeros((batch.num_rows, len(model.langs))), np.zeros(batch.num_rows, bool)
            held, rows, size = [], [], 0
            for row, text in enumerate(batch.column("text")):
                for part in pieces(text.as_py() or ""):
                    held.append(words_of(part))
                    rows.append(row)
                    size += len(held[-1])
                    if size > 200_000:
                        np.add.at(total, rows, _sums(model, held, known, table))
                        np.logical_or.at(letters, rows, [bool(w) for w in held])
                        held, rows, size = [], [], 0
            if rows:
                np.add.at(total, rows, _sums(model, held, known, table))
                np.logical_or.at(letters, rows, [bool(w) for w in held])
            if model.langs:
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                names = [model.langs[k] if any_ else UNKNOWN for k, any_ in zip(best.tolist(), letters.tolist())]
            else:
                share, names = np.zeros(batch.num_rows), [UNKNOWN] * batch.num_rows
            columns = [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "lang_pred", "score"])

    shape = docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"{shape}, held_out boolean, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, train(docs))
