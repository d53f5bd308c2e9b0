"""Operator 13, fill-in-middle: overlapping-chunk decomposition.

A text is a row of units (lines, words or characters). Where a unit ends is a predicate on two adjacent characters, so a text
can be cut into chunks of ``CHUNK`` bytes that overlap by one, and every chunk counts its ends by itself, all chunks of a batch
in one vector operation. Prefix sums over the counts (and over the chunks' numbers of characters) give the number of units of
each text and route the ranks of its two cuts to the chunks that own them; only those are scanned again for the place itself.
A document's output is one value, so its chunks stay in one task; tasks share nothing and there is no shuffle.

Cut ranks and form come from the first four 8-digit groups of a sha256 of the seed and the document's id.

Defined cases: a null text counts as empty; an empty text, or one that holds one of the three marks, stays plain (cut places are
null); a text without an end of line is one unit; a null doc_id is hashed as an empty string; repeated rows have equal results,
each in a row of its own; an empty table gives an empty result; other columns, under any name, are not read; of very long texts
the ends are counted chunk by chunk, so what is held is the text and its output.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.store import chunks, documents

CHUNK = 1 << 16
AT_ONCE = 64  # chunks
P, S, M = "<P>", "<S>", "<M>"


def _space(c: np.ndarray) -> np.ndarray:
    return (c == 32) | ((c >= 9) & (c <= 13))


# whether a unit ends between two adjacent bytes of UTF-8; the end of a text always ends one
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda here, after: here == 10,
    "word": lambda here, after: _space(here) & ~_space(after),
    "char": lambda here, after: (after & 0xC0) != 0x80,
}


class Chunked:
    """Texts of one array of bytes as chunks, with prefix sums of their unit ends and characters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ends: Callable, size: int = CHUNK):
        self.data, self.ends = data, ends
        many = -(-np.diff(offsets) // size)
        self.first = np.concatenate([[0], np.cumsum(many)])  # each text's first chunk
        owner = np.repeat(np.arange(len(many)), many)
        self.lo = offsets[owner] + (np.arange(len(owner)) - self.first[owner]) * size
        self.hi = np.minimum(self.lo + size, offsets[owner + 1])
        self.last = self.hi == offsets[owner + 1]
        units, chars = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for k in range(0, len(owner), AT_ONCE):
            lo, hi = self.lo[k : k + AT_ONCE], self.hi[k : k + AT_ONCE]  # neighbours
            mask = self._mask(int(lo[0]), int(hi[-1]))
            mask[hi[self.last[k : k + AT_ONCE]] - lo[0] - 1] = True
            units.append(np.add.reduceat(mask, lo - lo[0], dtype=np.int64))
            chars.append(np.add.reduceat((data[lo[0] : hi[-1]] & 0xC0) != 0x80, lo - lo[0], dtype=np.int64))
        self.units, self.chars = np.cumsum(np.concatenate(units)), np.cumsum(np.concatenate(chars))

    def _mask(self, lo: int, hi: int) -> np.ndarray:
        """Ends after each byte of a stretch, which is looked at with the byte that follows it."""
        seen = self.data[lo : hi + 1]
        if len(seen) == hi - lo:
            seen = np.append(seen, np.uint8(0))
        return self.ends(seen[:-1], seen[1:])

    def counts(self) -> np.ndarray:
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def places(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each text its first ``ranks`` units end, in bytes and in characters."""
        at, chars = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        base = self.units[self.first[:-1]]
        owner = np.searchsorted(self.units, base + ranks, "left") - 1  # the chunk that holds the end of that rank
        for t in np.flatnonzero(ranks > 0):
            k = owner[t]
            lo, hi = int(self.lo[k]), int(self.hi[k])
            mask = self._mask(lo, hi)
            if self.last[k]:
                mask[-1] = True
            stop = lo + int(np.flatnonzero(mask)[base[t] + ranks[t] - self.units[k] - 1]) + 1
            at[t] = stop - self.lo[self.first[t]]
            chars[t] = self.chars[k] - self.chars[self.first[t]] + int(((self.data[lo:stop] & 0xC0) != 0x80).sum())
        return at, chars


def _rearranged(unit: str, rate: int, spm_rate: int, size: int):
    marks = [m.encode() for m in (P, S, M)]
    fields = ["form", "n", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def emit(batches):
        for batch in batches:
            h = [np.asarray(batch.column(f"h{k}"), np.int64) for k in range(1, 5)]
            for lo, hi, data, offsets in chunks(batch.column("text")):
                cut = Chunked(data, offsets, UNITS[unit], size)
                n = cut.counts()
                one, two = h[0][lo:hi] % (n + 1), h[1][lo:hi] % (n + 1)
                (a, ca), (b, cb) = cut.places(np.minimum(one, two)), cut.places(np.maximum(one, two))
                rows = []
                for d in range(hi - lo):
                    text = data[offsets[d] : offsets[d + 1]].tobytes()
                    if not text or h[2][lo + d] % 100 >= rate or any(m in text for m in marks):
                        rows.append(("plain", n[d], None, None, text))
                        continue
                    prefix, middle, suffix = text[: a[d]], text[a[d] : b[d]], text[b[d] :]
                    spm = h[3][lo + d] % 100 < spm_rate
                    parts = (marks[1], suffix, marks[0], prefix, marks[2], middle) if spm else (marks[0], prefix, marks[1], suffix, marks[2], middle)
                    rows.append(("spm" if spm else "psm", n[d], ca[d], cb[d] - ca[d], b"".join(parts)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *columns], names=["doc_id", *fields])

    return emit


def rearranged(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50, size: int = CHUNK) -> DataFrame:
    """doc_id, form (plain, psm, spm), n (units), prefix_chars, middle_chars and output of each row. ``rate`` of a hundred texts
    are rearranged, of these ``spm_rate`` of a hundred with the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select("doc_id", "text", digest.alias("digest")).select("doc_id", "text", *groups)
    shape = docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1)
    return rows.mapInArrow(_rearranged(unit, rate, spm_rate, size), f"{shape}, form string, n long, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text again: what is rearranged holds each mark once, as its text holds none."""
    part = lambda s, mark, k: F.split_part(s, F.lit(mark), F.lit(k))
    from_fourth = lambda s: F.substring(s, 4, 1 << 30)
    psm = F.concat(from_fourth(part(output, S, 1)), part(output, M, 2), part(part(output, S, 2), M, 1))
    spm = F.concat(part(part(output, P, 2), M, 1), part(output, M, 2), from_fourth(part(output, P, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearranged(documents(spark, sf_dir))
    again = restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
