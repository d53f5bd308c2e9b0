"""Operator 3, exact deduplication by Grace hashing.

1. Every input task merges equal texts among its own rows in an open-addressing table (flushed when ``budget`` bytes of
   distinct texts are held) and writes each row with the row that stands for it. So a group that holds a third of all
   rows sends at most one text per flush of a task.
   A content that more than ``hot`` tasks or flushes have sent is merged once more before it goes to one place: its c rows are
   dealt by hash and by row to the square root of c groups, and each group's table sends one row on.
2. The standing rows are partitioned by hash bits into buckets of about half ``budget``; each bucket streams through an
   open-addressing table that compares complete content. What a bucket holds beyond ``budget`` bytes of distinct content
   is spilled; of each such bucket the spilled bytes are counted and it is partitioned again, by other hash bits, into
   as many buckets as these need, and so on until all fit: the depth grows with the logarithm of the data at most. A
   content is held or spilled as a whole, so no group is ever divided. Spill files are tables in the shared folder,
   so a lost executor costs a task and nothing else.
3. Rows find their group by the row that stands for them (a hot content's by that of its group), a key with no more rows than
   one input task or group has.

Defined cases: a null text equals an empty one; of equal texts the row with the largest ``doc_id`` (of any type with an
order) stays, null being smallest; of repeated rows with that id exactly one; a text longer than ``budget`` has a bucket's
table for itself and is compared whole; an empty table gives an empty result; other columns are kept by ``dedup`` under any
name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.store import as_table, documents, free, numbered, parts_for, plus

BUDGET = 128 << 20
HOT = 512  # standing rows of one content
SPARE = 10_000  # rows of other columns that may be held for winners that lost since
OVERHEAD = 200  # bytes of a content's entry, beside the content


class ContentTable:
    """Open addressing with linear probing; keys are complete contents, values are positions 0, 1, 2, ..."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def find(self, hashed: int, content: bytes, room: int) -> int:
        """The position of the content; it is added if it is new and fits in ``room`` bytes, else -1."""
        slots, mask = self.slots, len(self.slots) - 1
        at = hashed & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == hashed and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        if self.held + len(content) > room and self.contents:
            return -1
        slots[at] = k = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.held += len(content) + OVERHEAD
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return k

    def _grow(self) -> None:
        size = 4 * len(self.slots)
        slots = [-1] * size
        for k, hashed in enumerate(self.hashes):
            at = hashed & (size - 1)
            while slots[at] >= 0:
                at = (at + 1) & (size - 1)
            slots[at] = k
        self.slots = slots


def _merge_in_task(names: list[str], text_at: int, id_at: int, budget: int):
    """Adds to every row its number, the number of the row that stands for it, how many it stands for, and digests."""

    def run(batches):
        base, row = TaskContext.get().partitionId() << 40, 0
        table, best, held, held_bytes = ContentTable(), [], [], 0

        def flush():
            """best: of each content, the row that stays so far; its row number stands for the others."""
            count = np.bincount(np.concatenate([k for _, k, *_ in held]), minlength=len(best)) if held else []
            stands = np.array([b[-1] for b in best], np.int64)
            for batch, k, numbers, digests, hashes in held:
                first = stands[k] == numbers
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(numbers), pa.array(stands[k]), pa.array(np.where(first, count[k], 0)), pa.array(digests, pa.binary()), pa.array(hashes)],
                    names=[*names, "row", "stand", "n", "sha", "hash"],
                )

        for batch in batches:
            ids = batch.column(id_at).to_pylist()
            groups, digests, hashes = np.empty(len(ids), np.int64), [], np.empty(len(ids), np.int64)
            for j, text in enumerate(batch.column(text_at).to_pylist()):
                content = (text or "").encode()
                hashed = xxhash.xxh3_64_intdigest(content)
                digests.append(hashlib.sha256(content).digest())
                hashes[j] = hashed - (1 << 64) if hashed >> 63 else hashed
                groups[j] = k = table.find(hashed, content, 1 << 62)
                mine = (*_ranked(ids[j]), base + row + j)
                if k == len(best):
                    best.append(mine)
                elif mine > best[k]:
                    best[k] = mine
            held.append((batch, groups, base + row + np.arange(len(ids)), digests, hashes))
            row += len(ids)
            held_bytes += batch.nbytes
            if table.held > budget or held_bytes > budget:
                yield from flush()
                table, best, held, held_bytes = ContentTable(), [], [], 0
        yield from flush()

    return run


def _ranked(doc_id) -> tuple:
    """Orders ids of any type; null is smallest."""
    return (False, 0) if doc_id is None else (True, doc_id)


def _match(id_type: pa.DataType, budget: int):
    """Streams the standing rows of a bucket through one table; what does not fit is spilled with the bucket's number."""

    def run(batches):
        bucket = TaskContext.get().partitionId()
        table, best, total, members = ContentTable(), [], [], []
        for batch in batches:
            ids, rows, n, texts, hashes = (batch.column(c).to_pylist() for c in ("id", "row", "n", "text", "hash"))
            over = []
            for j, text in enumerate(texts):
                k = table.find(hashes[j] & (1 << 64) - 1, text.encode(), budget)
                if k < 0:
                    over.append(j)
                    continue
                mine = (*_ranked(ids[j]), rows[j])
                if k == len(best):
                    best.append(mine)
                    total.append(n[j])
                    members.append([rows[j]])
                else:
                    best[k] = max(best[k], mine)
                    total[k] += n[j]
                    members[k].append(rows[j])
            if over:
                rest = batch.take(pa.array(over))
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.nulls(len(over), pa.int64()), pa.nulls(len(over), id_type), pa.nulls(len(over), pa.int64()), pa.array([bucket] * len(over), pa.int32())],
                    names=[*rest.schema.names, "keep_row", "keep_id", "size", "bucket"],
                )
        for lo in range(0, len(best), 20_000):
            some = range(lo, min(lo + 20_000, len(best)))
            stands = [r for k in some for r in members[k]]
            k = np.repeat(np.arange(some.start, some.stop), [len(members[k]) for k in some])
            keep = [best[x] for x in k]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(k), id_type), pa.array(stands, pa.int64()), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.string()), pa.nulls(len(k), pa.int64()),
                 pa.array([b[-1] for b in keep], pa.int64()), pa.array([b[1] if b[0] else None for b in keep], id_type), pa.array([total[x] for x in k], pa.int64()), pa.nulls(len(k), pa.int32())],
                names=["id", "row", "n", "text", "hash", "keep_row", "keep_id", "size", "bucket"],
            )

    return run


def _size(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _deal_again(left: DataFrame, text: str, level: int, budget: int) -> DataFrame:
    """Each spilled bucket into buckets of its own, as many as its bytes need."""
    spilled = left.groupBy("bucket").agg(F.ceil(F.sum(_size(text)) / (budget / 2)).cast("int").alias("fan"))  # a row a bucket
    parts = spilled.agg(F.sum("fan")).first()[0]
    split = left.join(spilled, "bucket").withColumn("sub", F.pmod(F.xxhash64("hash", F.lit(level)), F.col("fan")))
    return split.repartition(parts, "bucket", "sub").drop("bucket", "fan", "sub")


def _levels(standing: DataFrame, text: str, parts: int, budget: int, match, schema, is_done: str) -> list[DataFrame]:
    """Each level's table, spilled rows included, until nothing is spilled."""
    dealt, out = standing.repartition(parts, F.xxhash64("hash", F.lit(0))), []
    while True:
        out.append(as_table(dealt.mapInArrow(match, schema), f"level{len(out)}"))
        left = out[-1].where(f"not ({is_done})").select(*standing.columns, "bucket")
        if left.isEmpty():
            return out
        dealt = _deal_again(left, text, len(out), budget)


def _hot(standing: DataFrame, hot: int) -> DataFrame:
    """hash, fan: contents that many rows stand for, and into how many groups these are dealt."""
    return as_table(standing.groupBy("hash").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("hash", F.ceil(F.sqrt("c")).cast("int").alias("fan")), "hot")


def _in_groups(standing: DataFrame, hot: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Standing rows of other contents, and those of the hot ones dealt by content and group."""
    marked = standing.join(hot, "hash", "left")
    group = F.pmod(F.xxhash64("row"), F.col("fan"))
    return marked.where("fan is null").select(*standing.columns), marked.where("fan is not null").repartition(parts, "hash", group).select(*standing.columns)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def groups_of_equal(df: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    df = df.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    id_kind = df.schema["id"].dataType.simpleString()
    rows = as_table(df.mapInArrow(_merge_in_task(["id", "text"], 1, 0, budget), plus(df.schema, "row long, stand long, n long, sha binary, hash long")), "rows")
    standing = rows.where("n > 0").select("id", "row", "n", F.coalesce("text", F.lit("")).alias("text"), "hash")
    shape = f"id {id_kind}, row long, n long, text string, hash long, keep_row long, keep_id {id_kind}, size long, bucket int"
    parts = parts_for(standing, _size("text"), max(1, budget // 2))
    match, moved = _match(_arrow(df, "id"), budget), None
    if not (often := _hot(standing, hot)).isEmpty():
        others, dealt = _in_groups(standing, often, parts)
        merged = as_table(dealt.mapInArrow(match, shape), "merged")
        on = merged.where("keep_row is null or keep_row = row").select("row", "size")  # what did not fit goes on as it is
        standing = others.unionByName(standing.join(on, "row").select("id", "row", F.coalesce("size", "n").alias("n"), "text", "hash"))
        moved = merged.where("keep_row <> row").select(F.col("row").alias("from"), F.col("keep_row").alias("stand"))
    levels = _levels(standing, "text", parts, budget, match, shape, "keep_row is not null")
    found = _union([done.where("keep_row is not null").select(F.col("row").alias("stand"), "keep_row", "keep_id", "size") for done in levels])
    if moved is not None:
        found = found.unionByName(moved.join(found, "stand").select(F.col("from").alias("stand"), "keep_row", "keep_id", "size"))
    return (
        rows.select("id", "row", "stand", "sha")
        .join(found, "stand")
        .select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _keep(names: list[str], text: str, id_column: str, budget: int):
    """As ``_match``, with all columns: of each content the row that stays; rows that do not fit come back not yet kept."""
    text_at, id_at, rest = names.index(text), names.index(id_column), [k for k, n in enumerate(names) if n != text]

    def run(batches):
        bucket = TaskContext.get().partitionId()
        table, best, place, none, held, base = ContentTable(), [], [], [], [], 0
        for batch in batches:
            ids, rows, hashes = batch.column(id_at).to_pylist(), *(batch.column(c).to_pylist() for c in ("row", "hash"))
            over, won = [], {}
            for j, t in enumerate(batch.column(text_at).to_pylist()):
                k = table.find(hashes[j] & (1 << 64) - 1, (t or "").encode(), budget)
                if k < 0:
                    over.append(j)
                    continue
                mine = (*_ranked(ids[j]), rows[j])
                if k == len(best):
                    best.append(mine)
                    place.append(0)
                    none.append(t is None)
                elif mine > best[k]:
                    best[k], none[k] = mine, t is None
                else:
                    continue
                won[k] = j
            if over:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(over)).columns, pa.array([False] * len(over)), pa.array([bucket] * len(over), pa.int32())], names=[*batch.schema.names, "kept", "bucket"])
            if won:
                held.append(pa.RecordBatch.from_arrays([batch.column(k) for k in rest], names=[str(k) for k in rest]).take(pa.array(list(won.values()))))
                for k in won:
                    place[k], base = base, base + 1
                if base > 2 * len(best) + SPARE:  # what has been superseded is let go
                    held = pa.Table.from_batches(held).take(pa.array(place)).combine_chunks().to_batches() if rest else []
                    place, base = list(range(len(best))), len(best)
        others = pa.Table.from_batches(held) if held else None
        for lo in range(0, len(best), 5_000):
            some = range(lo, min(lo + 5_000, len(best)))
            part = others.take(pa.array([place[k] for k in some])).combine_chunks() if rest else None
            texts = pa.array([None if none[k] else table.contents[k].decode() for k in some], pa.string())
            columns = [texts if n == text else part.column(str(k)).combine_chunks() for k, n in enumerate(names)]
            own = [pa.array([best[k][-1] for k in some]), pa.array(np.array([table.hashes[k] for k in some], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, *own, pa.array([True] * len(some)), pa.nulls(len(some), pa.int32())], names=[*names, "row", "hash", "kept", "bucket"])

    return run


def dedup(df: DataFrame, text: str = "text", id_column: str = "doc_id", budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """One row of each group of equal texts, with all columns as they came. Texts are shuffled once a level."""
    own, names = numbered(df)
    text, id_column, columns = own.columns[names.index(text)], own.columns[names.index(id_column)], own.columns
    schema = plus(own.schema, "row long, stand long, n long, sha binary, hash long")
    # of a task's equal rows the one that stands for them is the one that would stay
    standing = own.mapInArrow(_merge_in_task(columns, columns.index(text), columns.index(id_column), budget), schema).where("n > 0").select(*columns, "row", "hash")
    standing = as_table(standing, "standing")
    parts = parts_for(own, _size(text), max(1, budget // 2))
    keep, shape = _keep(columns, text, id_column, budget), plus(own.schema, "row long, hash long, kept boolean, bucket int")
    first = standing
    if not (often := _hot(standing, hot)).isEmpty():
        others, dealt = _in_groups(standing, often, parts)
        first = others.unionByName(as_table(dealt.mapInArrow(keep, shape), "merged").select(*standing.columns))
    levels = _levels(first, text, parts, budget, keep, shape, "kept")
    free(standing)
    return _union([done.where("kept").select(*columns) for done in levels]).toDF(*names)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_of_equal(documents(spark, sf_dir))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
