"""Operator 7, substring dedup by De Bruijn compaction.

A node is a string of ``WINDOW - 1`` words, an edge a window of ``WINDOW`` words (from its first to its last node); a document
is a walk along edges. The graph is built of the edges that occur more than once:

1. Documents are dealt as runs of edges with one minimizer (see ``repeats``), as compaction of such graphs is usually
   distributed, and equal runs are merged, with the number of their places. If a minimizer has a single content, no walk
   branches inside: all its nodes have the degrees 1 and 1 there, and the run is a *strand*, compacted as it is. Otherwise
   its runs are opened into strands of one edge. (A node whose minimizer is in no edge around it, on one walk, goes to the
   minimizer as a run without edges, so that what it might branch from is opened.)
2. Strands are counted by a grouping; repeated ones keep their end nodes and one *source coordinate* (document, first word).
3. In- and out-degrees of the nodes come from a grouping of the strands' two ends. A node of degrees 1 and 1 links the strand
   that enters it to the one that leaves it: a join on the node tells each strand its predecessor, if it has just one.
4. Linked strands that follow each other at their source compact into *paths*: what starts a path is a strand without such a
   predecessor, and a window over the source's coordinates finds each strand's path. ``paths`` glues those of different sources
   into maximal ones by pointer jumping (joins of paths with paths, their number only); removal does not need it.
5. Runs are stated as pieces of paths, go back to the documents, and every long span is compared with the source coordinates of
   its path, stretch by stretch, by SHA-256 (see ``repeats``).

Defined cases: a null or empty text has no words; a text shorter than the window keeps all; repeated rows are places of
their own, so their long windows repeat; a null doc_id is a document like others; an empty table gives an empty result;
other columns, under any name, are not read; very long texts are treated in blocks (see ``repeats``), no word is left out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.llm.repeats import KEY, PIECES, WORDS, Windows, first_place, keyed, repeated_pieces, span, sums, with_lists, without_spans, word_codes
from pairscope.llm.store import as_table, chunks, documents, free

WINDOW = 35
ANCHOR = 10
STRAND = "anchor long, run long, places long, k1 long, k2 int, step int, at int, n int, edge long, head long, tail long"


def _strands(how: Windows):
    """The listed runs as strands: a whole run, or each of its edges where it is opened; with the nodes at their ends."""
    long, short = pa.int64(), pa.int32()

    def emit(batches):
        for batch in batches:
            found, k1, k2 = batch.column("found").to_pylist(), np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            for lo, hi, data, offsets in chunks(batch.column("text"), 1 << 20):
                codes, bounds = word_codes(data, offsets, how.seed)
                total = sums(codes)
                rows = [(f["anchor"], f["run"], f["places"], f["n"], f["at"], f["opened"], d) for d in range(hi - lo) for f in found[lo + d]]
                for some in itertools.batched(rows, 20_000):
                    anchor, run, places, n, at, opened, doc = (np.array(c) for c in zip(*some))
                    pieces = np.where(opened, n, 1)
                    which = np.repeat(np.arange(len(some)), pieces)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    size = np.where(opened, 1, n)[which]
                    first = at[which] + step
                    start = first + bounds[doc][which]
                    stop = start + size + how.window - 1
                    edge = np.where(opened[which], span(total, start, stop).view(np.int64), run[which])
                    columns = [anchor[which], run[which], places[which], k1[lo + doc[which]], k2[lo + doc[which]], step, first, size, edge]
                    nodes = [span(total, start, start + how.window - 1), span(total, stop - how.window + 1, stop)]
                    kinds = (long, long, long, long, short, short, short, short, long)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds)), *(pa.array(h.view(np.int64)) for h in nodes)],
                        names=[c.split(" ")[0] for c in STRAND.split(", ")],
                    )

    return emit


def repeated_strands(strands: DataFrame) -> DataFrame:
    """anchor, edge, n, head, tail, s1, s2, sat (the source coordinate) of each strand that occurs more than once."""
    own = (F.first(c).alias(c) for c in ("n", "head", "tail"))
    return strands.groupBy("anchor", "edge").agg(F.sum("places").alias("c"), *own, *first_place("s1", "s2", "sat")).where("c > 1").drop("c")


def compacted(repeated: DataFrame) -> DataFrame:
    """Repeated strands with ``path``, where the path that they are part of starts in the source (a place of the same document),
    and of each path's first strand the place before it (b1, b2, bat), if a node of degrees 1 and 1 lies between them."""
    last = F.struct("s1", "s2", (F.col("sat") + F.col("n")).alias("sat"))  # the edge after the strand, at its source
    ends = F.explode(F.array(F.struct(F.col("head").alias("node"), F.lit(None).cast(place_type(repeated)).alias("into")), F.struct(F.col("tail").alias("node"), last.alias("into"))))
    ends = repeated.select(ends.alias("e")).select("e.node", "e.into.*")
    into = F.sum(F.col("s1").isNotNull().cast("int"))
    out = F.sum(F.col("s1").isNull().cast("int"))
    # of nodes with one strand in and one out the strand in is the only one: any aggregate gives it
    nodes = ends.groupBy("node").agg(into.alias("i"), out.alias("o"), F.max("s1").alias("b1"), F.max("s2").alias("b2"), F.max("sat").alias("bat")).where("i = 1 and o = 1")
    linked = repeated.join(nodes.select("node", "b1", "b2", "bat"), repeated["head"] == nodes["node"], "left").drop("node")
    goes_on = F.coalesce((F.col("b1") == F.col("s1")) & (F.col("b2") == F.col("s2")) & (F.col("bat") == F.col("sat")), F.lit(False))
    along = Window.partitionBy("s1", "s2").orderBy("sat")
    path = F.max(F.when(~goes_on, F.col("sat"))).over(along)  # places of one source, in order: the last start so far
    before = [F.when(~goes_on, F.col(c)).alias(c) for c in ("b1", "b2", "bat")]
    return linked.select("anchor", "edge", "n", "s1", "s2", "sat", path.alias("path"), *before)


def place_type(repeated: DataFrame) -> str:
    return "struct<s1:{},s2:{},sat:{}>".format(*(repeated.schema[c].dataType.simpleString() for c in ("s1", "s2", "sat")))


def _pieces(batches):
    """Of each run, its repeated strands as pieces of paths."""
    shape = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int32()), ("sat", pa.int32()), ("path", pa.int32())]))
    for batch in batches:
        out = []
        for found in batch.column("found").to_pylist():
            pieces = []
            for f in sorted(found, key=lambda f: f["step"]):
                last = pieces[-1] if pieces else None
                if last and f["step"] == last["o"] + last["n"] and (f["s1"], f["s2"], f["path"]) == (last["s1"], last["s2"], last["path"]) and f["sat"] == last["sat"] + last["n"]:
                    last["n"] += f["n"]
                else:
                    pieces.append({"o": f["step"], "n": f["n"], "s1": f["s1"], "s2": f["s2"], "sat": f["sat"], "path": f["path"]})
            out.append(pieces)
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("run"), pa.array(out, shape)], names=["anchor", "run", "pieces"])


def _graph(docs: DataFrame, merged: DataFrame, how: Windows) -> tuple[DataFrame, DataFrame]:
    """The strands of the merged runs and the compacted graph, as tables."""
    several = as_table(merged.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", F.lit(True).alias("opened")), "several")
    marked = merged.where("n > 0").join(several, "anchor", "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
    texts, lists = with_lists(docs.select(*KEY, "text"), marked.where("opened or places > 1"), ["anchor", "run", "n", "at", "places", "opened"], "inner")
    # repeated rows say the same: their strands count for each of them, as they repeat anyway
    strands = as_table(texts.select(*KEY, "text", "found").mapInArrow(_strands(how), STRAND), "strands")
    repeated = as_table(repeated_strands(strands), "repeated")
    graph = as_table(compacted(repeated), "graph")
    free(several, lists, repeated)
    return strands, graph


def _resolve(how: Windows):
    def resolve(docs: DataFrame, merged: DataFrame) -> DataFrame:
        strands, graph = _graph(docs, merged, how)
        known = strands.select("anchor", "run", "step", "edge").join(graph.select("anchor", "edge", "n", "s1", "s2", "sat", "path"), ["anchor", "edge"])
        gathered = known.groupBy("anchor", "run").agg(F.collect_set(F.struct("step", "n", "s1", "s2", "sat", "path")).alias("found"))  # a run's edges
        decided = as_table(gathered.mapInArrow(_pieces, f"anchor long, run long, pieces {PIECES}"), "decided")
        free(strands, graph)
        return decided

    return resolve


def paths(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, seed: int = 0) -> DataFrame:
    """The compacted graph: n_edges and n_words of each maximal nonbranching path of repeated edges, with doc_key and first_word
    of the source where it starts. A ring without any branch is cut where its sources change."""
    how, out = Windows(word_codes, window, anchor, seed, True), []

    def resolve(docs: DataFrame, merged: DataFrame) -> DataFrame:
        strands, graph = _graph(docs, merged, how)
        out.append(glued(graph))
        free(strands, graph)
        return as_table(docs.sparkSession.createDataFrame([], f"anchor long, run long, pieces {PIECES}"), "decided")

    free(*repeated_pieces(keyed(docs), how, resolve)[1])
    return out[0].select(F.col("n").alias("n_edges"), (F.col("n") + window - 1).alias("n_words"), F.col("s1").alias("doc_key"), F.col("path").alias("first_word"))


def glued(graph: DataFrame) -> DataFrame:
    """s1, s2, path (where it starts) and n (edges) of maximal paths: each path learns by pointer jumping with which it begins."""
    here = ["s1", "s2", "path"]
    first = graph.groupBy(*here).agg(F.sum("n").cast("long").alias("n"), *(F.max(c).alias(c) for c in ("b1", "b2", "bat")))
    before = graph.select(F.col("s1").alias("b1"), F.col("s2").alias("b2"), (F.col("sat") + F.col("n")).alias("bat"), F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("path").alias("hp"))
    # h: a path that comes earlier (a root names itself); done: h is a root
    none = F.col("h1").isNull()
    heads = (F.when(none, F.col(own)).otherwise(F.col(h)).alias(h) for own, h in zip(here, ("h1", "h2", "hp")))
    jump = as_table(first.join(before, ["b1", "b2", "bat"], "left").select(*here, "n", *heads, none.alias("done")), "jump")
    open_ = None
    while True:
        left = jump.where("not done").count()
        if left == 0 or left == open_:  # what does not come nearer to a root goes round
            break
        open_ = left
        ahead = jump.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("path").alias("hp"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("hp").alias("gp"), F.col("done").alias("far"))
        moved = jump.where("not done").join(ahead, ["h1", "h2", "hp"]).select(*here, "n", F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("gp").alias("hp"), F.col("far").alias("done"))
        new = as_table(moved.unionByName(jump.where("done")), "jump")
        free(jump)
        jump = new
    root = [F.when(F.col("done"), F.col(h)).otherwise(F.col(own)).alias(own) for own, h in zip(here, ("h1", "h2", "hp"))]
    return jump.select(*root, "n").groupBy(*here).agg(F.sum("n").alias("n"))


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, seed: int = 0) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept (the words that stay, UTF-8, joined by one space) of each row."""
    docs, how = keyed(docs), Windows(word_codes, window, anchor, seed, True)
    return without_spans(docs, *repeated_pieces(docs, how, _resolve(how)), window, WORDS).withColumnRenamed("n", "n_words")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM hit, range(0, 35) AS s(k)),
p AS (SELECT r, doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.i) AS t, count(*) AS n FROM p ANTI JOIN gone ON p.r = gone.r AND p.i = gone.i GROUP BY p.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""
