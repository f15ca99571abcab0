"""Token ids as flat binary files that can be memory-mapped.

A folder holds, for each of its parts in document order, ``part-00000.bin`` (ids, little-endian
unsigned integers of 2 bytes if the vocabulary allows, else of 4), ``.idx`` (little-endian unsigned
64-bit offsets into it, in ids, one more than documents) and ``.doc`` (a byte that is 0 where the id
is null, and the signed 64-bit document id). The table ``manifest`` has the documents and ids of each
part; their running sums are the part's bases: the place of its first document and first id in the
whole corpus.
"""

from __future__ import annotations

import contextlib
import json
import math
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetflow.llm.batches import pieces
from assetflow.llm.bpe import load
from assetflow.llm.wordcache import Remembered
from assetflow.operators.organize import split_uri
from assetflow.shared import new_path

# Text of a part; a part is written by one task, in a stream.
PART_BYTES = 64 << 20
# Text encoded at once.
PIECE_BYTES = 8 << 20
# Documents that are read as one row of work.
READ_DOCUMENTS = 20_000
READ_BYTES = 8 << 20

_MARKS = ",.;:!?"
_DOCUMENT = np.dtype([("known", "u1"), ("id", "<i8")])
_OBJECT_STORES = ("s3", "gs", "az")
MANIFEST = "part int, documents long, ids long, width int"


class Encoder:
    """The ids of texts by the tokenizer library, each distinct word of a task encoded once.

    Words are told apart only where the tokenizer drops white space anyway and begins anew after it;
    other tokenizers get whole texts.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        spec = json.loads(content)
        for unused in ("truncation", "padding"):
            spec[unused] = None
        self._tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.by_words = drops_space(spec)
        self._words = Remembered(self._encode)

    def _encode(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 20_000):
            some = texts[i : i + 20_000]
            for encoded in self._tokenizer.encode_batch_fast(some, add_special_tokens=False):
                yield encoded.ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, ids of all texts); null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.by_words:
            # The library takes each of these for white space or for a word of its own as well.
            texts = pc.replace_substring(texts, "\n", " ")
            texts = pc.replace_substring_regex(texts, rf"([A-Za-z])([{_MARKS}])(\s|$)", r"\1 \2\3")
            lists = pc.split_pattern(texts, " ")
        else:
            lists = pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts)
        words = lists.flatten().dictionary_encode()
        rows = self._words.rows_of(words.dictionary.to_pylist())[words.indices.to_numpy()]
        sizes, ids = self._words.ids_of(rows)
        words_before = np.cumsum(lists.value_lengths().to_numpy())
        return np.diff(np.r_[0, np.cumsum(np.r_[0, sizes])[words_before]]), ids


def drops_space(spec: dict) -> bool:
    """True for tokenizers that take words by a pattern without white space or a letter before a mark."""
    added = "".join(t["content"] for t in spec["added_tokens"])
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first = steps[0]
    if not (first.get("type") == "Split" and first["invert"] and first["behavior"] == "Removed"):
        return False
    pattern = regex.compile(first["pattern"]["Regex"])
    probe = "a" + "".join(f"{m} \n1{m}\t a" for m in _MARKS)
    alone = all(pattern.findall(f"a{m}") == ["a", m] for m in _MARKS)
    return alone and not regex.search(r"\s|[,.;:!?]", added) and not any(
        regex.search(r"\s", word) for word in pattern.findall(probe)
    )


def _folder(path: str) -> tuple[fs.FileSystem, str, bool]:
    """(store, folder in it, whether files appear there only when they are complete)."""
    kind, _, inner = split_uri(path)
    if kind == "file":
        return fs.LocalFileSystem(), inner, False
    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))
    return store, inner, kind in _OBJECT_STORES


class _Part:
    """The three files of a part, written in a stream and visible when they are whole."""

    def __init__(self, path: str, number: int):
        self._store, folder, self._whole = _folder(path)
        self._store.create_dir(folder, recursive=True)
        name = f"part-{number:05d}"
        self._final = {e: f"{folder}/{name}.{e}" for e in ("bin", "idx", "doc")}
        attempt = f"_{name}-{uuid.uuid4().hex}"
        self._written = (
            self._final
            if self._whole
            else {e: f"{folder}/{attempt}.{e}" for e in self._final}
        )
        self._files = {e: self._store.open_output_stream(f) for e, f in self._written.items()}
        self.documents = self.ids = 0
        self._files["idx"].write(np.zeros(1, "<u8").tobytes())

    def add(self, doc_ids: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        documents = np.zeros(len(sizes), _DOCUMENT)
        documents["known"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        documents["id"] = doc_ids.fill_null(0).to_numpy()
        self._files["bin"].write(ids.tobytes())
        self._files["idx"].write((self.ids + np.cumsum(sizes)).astype("<u8").tobytes())
        self._files["doc"].write(documents.tobytes())
        self.documents += len(sizes)
        self.ids += len(ids)

    def commit(self) -> None:
        for file in self._files.values():
            file.close()
        if not self._whole:
            for e, written in self._written.items():
                self._store.move(written, self._final[e])

    def abandon(self) -> None:
        for e, file in self._files.items():
            with contextlib.suppress(OSError):
                file.close()
                self._store.delete_file(self._written[e])


def write(
    df: DataFrame,
    path: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
) -> None:
    """Encode ``text`` of each row and write all ids below ``path`` in ascending order of ``id``.

    Each document's ids are followed by ``end_id``. Null ids come first; rows of the same id follow a
    hash of their text. A null text is an empty one. Rows are dealt to parts by ranges of id, hash
    and row, so that an id with very many rows fills several parts; a part is one task's stream and
    a task that is run again writes the same files again. Other columns are not looked at; an empty
    table gives a folder without parts.
    """
    spark = df.sparkSession
    content = load(vocabulary)
    shared = spark.sparkContext.broadcast(content)
    spec = json.loads(content)
    highest = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id])
    kind = np.dtype("<u2" if highest < 1 << 16 else "<u4")

    rows = df.select(
        F.col(id).cast("long").alias("id"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).cast("string").alias("text"),
    )
    n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n_bytes / PART_BYTES))
    order = ["id", "hash", "row"]
    in_order = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def store(stream):
        part = None
        try:
            for batch in stream:
                if not batch.num_rows:
                    continue
                if part is None:
                    encoder = Encoder(shared.value)
                    number = TaskContext.get().partitionId()
                    part = _Part(path, number)
                ids, texts = batch.column(0), batch.column(1)
                for lo, hi in pieces(texts, PIECE_BYTES):
                    sizes, tokens = encoder.encode(texts.slice(lo, hi - lo))
                    ended = np.insert(tokens.astype(kind), np.cumsum(sizes), end_id)
                    part.add(ids.slice(lo, hi - lo), sizes + 1, ended)
            if part is not None:
                part.commit()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int32()),
                        pa.array([part.documents], pa.int64()),
                        pa.array([part.ids], pa.int64()),
                        pa.array([kind.itemsize], pa.int32()),
                    ],
                    names=["part", "documents", "ids", "width"],
                )
                part = None
        finally:
            if part is not None:
                part.abandon()

    in_order.select("id", "text").mapInArrow(store, MANIFEST).write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, documents, ids, width, first_document, first_id: a row per part, of which there are few."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumns(
        {
            "first_document": F.coalesce(F.sum("documents").over(before), F.lit(0)),
            "first_id": F.coalesce(F.sum("ids").over(before), F.lit(0)),
        }
    )


def _slices(path: str, name: str) -> Callable[[np.dtype, int, int], np.ndarray]:
    """A function that gives items ``lo`` to ``hi`` of a file: mapped, or a range read from a store."""
    store, folder, _ = _folder(path)
    if isinstance(store, fs.LocalFileSystem):
        def items(kind: np.dtype, lo: int, hi: int) -> np.ndarray:
            if lo == hi:
                return np.empty(0, kind)
            return np.memmap(f"{folder}/{name}", kind, "r", lo * kind.itemsize, (hi - lo,))
    else:
        file = store.open_input_file(f"{folder}/{name}")

        def items(kind: np.dtype, lo: int, hi: int) -> np.ndarray:
            return np.frombuffer(file.read_at((hi - lo) * kind.itemsize, lo * kind.itemsize), kind)

    return items


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document, straight from the files.

    ``start``: ids of all documents before it. ``ids``: little-endian unsigned 32-bit integers. A
    task maps a range of a part's documents, so parts of any size are read by many tasks.
    """
    ranges = manifest(spark, path).select(
        "part",
        "width",
        "first_id",
        "documents",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("documents") - 1, F.lit(READ_DOCUMENTS).cast("long"))).alias("lo"),
    )
    slots = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )

    def documents(stream):
        for batch in stream:
            for r in batch.to_pylist():
                lo, hi = r["lo"], min(r["lo"] + READ_DOCUMENTS, r["documents"])
                name = f"part-{r['part']:05d}"
                offsets = _slices(path, f"{name}.idx")(np.dtype("<u8"), lo, hi + 1).astype(np.int64)
                known = _slices(path, f"{name}.doc")(_DOCUMENT, lo, hi)
                ids = _slices(path, f"{name}.bin")
                kind = np.dtype(f"<u{r['width']}")
                at = 0
                while at < hi - lo:
                    # As many documents as fit into a few MB, one at least.
                    until = int(np.searchsorted(offsets, offsets[at] + READ_BYTES // 4, "right")) - 1
                    until = max(until, at + 1)
                    cut = offsets[at : until + 1]
                    tokens = ids(kind, int(cut[0]), int(cut[-1])).astype("<u4")
                    places = pa.py_buffer(((cut - cut[0]) * 4).astype(np.int64).tobytes())
                    some = known[at:until]
                    n = until - at
                    binary = pa.Array.from_buffers(
                        pa.large_binary(), n, [None, places, pa.py_buffer(tokens.tobytes())]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some["id"].astype(np.int64), mask=some["known"] == 0),
                            pa.array(r["first_id"] + cut[:-1], pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            binary.cast(pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = until

    return ranges.repartition(slots).mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids binary"
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "tokens")
    write(docs, path, end_id=2)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
