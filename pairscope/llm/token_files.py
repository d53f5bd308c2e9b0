"""Operator 6, token ids in flat binary files.

Documents are dealt by ranges of ``doc_id`` (and a hash of the text, so that not even one id's rows need share a partition),
as many as their bytes need, sorted, encoded, and each partition writes three files: ids (unsigned, 16 bit
where the vocabulary allows it, else 32; little-endian), the 64-bit starts of its documents (one more than documents), and
their 64-bit ids. A partition's base, the number of ids before it, is the prefix sum over a manifest of one row per
partition. Readers map the files into memory. File names carry the task attempt, and the manifest names the attempt that
counted, so a lost executor or a second attempt does no harm.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes first and is stored as the smallest
64-bit number; repeated rows, and rows of one ``doc_id`` in an order of their own that is the same each time, stand one after
another; an empty table gives an empty result; other columns are not read; a very long text is a group for itself.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.pretokens import split
from pairscope.llm.store import documents, parts_for, shared_path

END = 0
CACHE = 1_200_000  # words a worker remembers, about 200 bytes each
NO_ID = -(1 << 63)
PART = 64 << 20  # bytes of text in a partition


class Encoder:
    """The tokenizers library, asked once for each word that a worker has not met lately.

    A text that holds the string of a special token goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Asks the library for new words. Words of a space and letters stay apart in a row, so many go in as one text."""
        plain = [w for w in new if w[0] == " " and w[1:].isalpha()]
        alone = [w for w in new if not (w[0] == " " and w[1:].isalpha())]
        rows = [plain[lo : lo + 200] for lo in range(0, len(plain), 200)]
        for lo in range(0, len(rows), 100):
            some = rows[lo : lo + 100]
            for row, e in zip(some, self.tokenizer.encode_batch(["".join(r) for r in some], add_special_tokens=False)):
                owner = np.array(e.word_ids, np.int64)
                if not len(owner) or owner[-1] + 1 != len(row):  # the library sees other words
                    alone += row
                    continue
                packed, size = self.pack(e.ids), self.kind.itemsize
                ends = (np.flatnonzero(np.append(np.diff(owner), 1)) + 1) * size
                start = 0
                for w, end in zip(row, ends.tolist()):
                    self.known[w] = packed[start:end]
                    start = end
        for lo in range(0, len(alone), 20_000):
            some = alone[lo : lo + 20_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.known[w] = self.pack(e.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        words, counts = split(["" if k in whole else t for k, t in enumerate(texts)])
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn(set(words).difference(self.known))
        found = map(self.known.__getitem__, words)
        out = [b"".join(itertools.islice(found, n)) for n in counts.tolist()]
        for k in whole:
            out[k] = self.pack(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_groups(texts: list, most: int = 1 << 21):
    """Texts in order, together up to about ``most`` characters; null counts as empty."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most or k + 1 == len(texts):
            yield [x or "" for x in texts[lo : k + 1]]
            lo, size = k + 1, 0


def _write(tokenizer: str, folder: str, end_id: int):
    def run(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        name = f"{part:06d}-{attempt}"
        known, end = encoder(tokenizer), encoder(tokenizer).pack([end_id])
        docs = tokens = 0
        with store.open_output_stream(f"{base}/{name}.ids") as out, store.open_output_stream(f"{base}/{name}.starts") as begins, store.open_output_stream(f"{base}/{name}.docs") as names:
            begins.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                ids = batch.column(0)
                names.write(np.asarray(ids.fill_null(NO_ID), "<i8").tobytes())
                docs += len(ids)
                for texts in text_groups(batch.column(1).to_pylist()):
                    found = known.encode(texts)
                    ends = tokens + np.cumsum([len(packed) // len(end) + 1 for packed in found])
                    for packed in found:
                        out.write(packed + end)
                    begins.write(ends.astype("<i8").tobytes())
                    tokens = int(ends[-1])
        if docs:
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [docs], "n_tokens": [tokens], "width": [known.kind.itemsize]})
        else:
            for suffix in ("ids", "starts", "docs"):
                store.delete_file(f"{base}/{name}.{suffix}")

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END, parts: int | None = None) -> list[dict]:
    """Writes the files below ``folder`` (a URI of a shared store) and returns the manifest, bases included, by part."""
    parts = parts or parts_for(docs, F.octet_length("text").cast("long"), PART)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("spread"))
    rows = rows.repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread", "text").select("doc_id", "text")
    manifest = rows.mapInArrow(_write(tokenizer, folder, end_id), "part long, name string, n_docs long, n_tokens long, width long")
    found = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["part"])  # a row per partition
    bases = itertools.accumulate((r["n_tokens"] for r in found), initial=0)
    return [r | {"base": b} for r, b in zip(found, bases)]


def _mapped(store, path: str, kind: str) -> np.ndarray:
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if store.get_file_info(path).size else np.zeros(0, kind)
    return np.frombuffer(store.open_input_file(path).readall(), kind)


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict], each, schema: str) -> DataFrame:
    """Runs ``each`` over (doc ids, global starts, local starts, mapped ids) of every partition's files."""
    shape = "part long, name string, n_docs long, n_tokens long, width long, base long"

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                path = f"{base}/{r['name']}"
                ids = _mapped(store, f"{path}.ids", f"<u{r['width']}")
                starts = _mapped(store, f"{path}.starts", "<i8")
                yield from each(_mapped(store, f"{path}.docs", "<i8"), starts + r["base"], starts, ids)

    rows = spark.createDataFrame([tuple(r[k.split(" ")[0]] for k in shape.split(", ")) for r in manifest], shape)
    return rows.repartition(max(1, len(manifest)), "part").mapInArrow(run, schema)


def _digests(docs, starts, local, ids):
    for lo in range(0, len(docs), 20_000):
        hi = min(lo + 20_000, len(docs))
        crc = [zlib.crc32(ids[local[k] : local[k + 1]].astype("<u4").tobytes()) for k in range(lo, hi)]
        own = docs[lo:hi]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, mask=own == NO_ID), pa.array(starts[lo:hi]), pa.array(np.diff(local[lo : hi + 1])), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = shared_path(spark, "tokens")
    manifest = write_token_files(documents(spark, sf_dir), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder, manifest, _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
