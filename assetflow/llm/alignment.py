"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

A byte-level tokenizer (A) and a tokenizer of pieces with byte fallback (B) spell out the same bytes.
The tokens of a text are divided where a token of each ends: an interval looks for such a shared cut
as near to its middle as there is one, by bisecting B's ends for ends of A, and both halves go on
alike, all intervals of a piece of text side by side. Intervals without a shared cut are groups.

Two tokens that end together are a link. One of them is then the end of the other, so the pairs of
ids that can be linked at all follow from the two vocabularies and are few (some 324,000 for the
public ones), whatever the corpus: each has a number, and a table of their counts is safe to send.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import map_pieces
from assetflow.llm.bpe import byte_letters
from assetflow.llm.wordcache import Remembered, runs
from assetflow.shared import stage

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Text aligned at once.
PIECE_BYTES = 1 << 20

_BLANK = "▁"
# A blank after anything but white space starts words for both tokenizers. White space in the widest sense.
_WORD_START = r"([^\s\p{Z}\x0b\x1c-\x1f\x{85}])( )"

ALIGNED = T.StructType(
    [
        T.StructField("n_a", T.LongType()),
        T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("groups", T.StringType()),
        T.StructField("links", T.ArrayType(T.IntegerType())),
    ]
)


def token_bytes(byte_level: str, pieces: bytes) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of A and of B; from the content of their files."""
    import sentencepiece

    spec = json.loads(byte_level)
    letters = {letter: byte for byte, letter in enumerate(byte_letters())}
    of_a = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
    of_a |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
    of_b = [
        bytes([int(model.id_to_piece(i)[3:5], 16)])
        if model.is_byte(i)
        else model.id_to_piece(i).replace(_BLANK, " ").encode()
        for i in range(model.get_piece_size())
    ]
    return [of_a.get(i, b"\0") for i in range(max(of_a) + 1)], of_b


def possible_pairs(of_a: list[bytes], of_b: list[bytes]) -> np.ndarray:
    """Sorted ``a << 32 | b`` of all ids that can end together: one's bytes end with the other's."""
    found = set()
    for shorts, longs, a_first in ((of_b, of_a, True), (of_a, of_b, False)):
        ids: dict[bytes, list[int]] = {}
        for i, value in enumerate(shorts):
            ids.setdefault(value, []).append(i)
        for i, value in enumerate(longs):
            for at in range(len(value)):
                for j in ids.get(value[at:], ()):
                    found.add(i << 32 | j if a_first else j << 32 | i)
    return np.sort(np.fromiter(found, np.int64, len(found)))


def shared_cuts(
    a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray, stops: np.ndarray
) -> np.ndarray:
    """True for each token of A whose end closes a group; ends are increasing offsets.

    ``starts`` and ``stops``: the tokens of A of each text, none of them empty.
    """
    closes = np.zeros(len(a_ends), bool)
    closes[stops - 1] = True
    # An open interval's candidates are the tokens lo to hi - 1; probe 0 is the middle one, further
    # probes are one further away each, on either side in turn.
    lo, hi = starts, stops - 1
    probe = np.zeros(len(lo), np.int64)
    lo, hi, probe = (x[starts < stops - 1] for x in (lo, hi, probe))
    while len(lo):
        middle = (lo + hi) // 2
        at = middle + np.where(probe & 1, -((probe + 1) >> 1), probe >> 1)
        inside = (at >= lo) & (at < hi)
        end = a_ends[np.where(inside, at, lo)]
        hit = inside & (b_ends[np.searchsorted(b_ends, end)] == end)
        cut = at[hit]
        closes[cut] = True
        # The last probe is the one that reaches past the further border.
        goes_on = ~hit & (probe < 2 * np.maximum(middle - lo, hi - middle))
        new_lo = np.concatenate([lo[hit], cut + 1, lo[goes_on]])
        new_hi = np.concatenate([cut, hi[hit], hi[goes_on]])
        new_probe = np.concatenate([np.zeros(2 * len(cut), np.int64), probe[goes_on] + 1])
        order = np.argsort(new_lo)
        order = order[new_lo[order] < new_hi[order]]
        lo, hi, probe = new_lo[order], new_hi[order], new_probe[order]
    return closes


def _spelt(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All values of a large string or binary column end to end, and where each begins and ends."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    return memoryview(data or b"").cast("B"), at


class Aligner:
    """Encodes texts by both tokenizers and aligns their tokens."""

    def __init__(self, byte_level: str, pieces: bytes, digests: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(byte_level) | {"truncation": None, "padding": None}
        self._a = Tokenizer.from_str(json.dumps(spec))
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        of_a, of_b = token_bytes(byte_level, pieces)
        if not all(of_a) or not all(of_b):
            raise ValueError("a token without bytes has no place")
        self.pairs = possible_pairs(of_a, of_b)
        self._bytes = [pa.array(x, pa.large_binary()) for x in (of_a, of_b)]
        self._lengths = [np.array([*map(len, x)]) for x in (of_a, of_b)]
        self._digests = digests
        # A piece that goes on after a blank could join words.
        self._by_words = not any(_BLANK in p.lstrip(_BLANK) for p in map(self._b.id_to_piece, range(len(of_b))))
        self._blank = [self._b.piece_to_id(_BLANK)]
        self._words = Remembered(self._encode_a, self._encode_b)
        # What is written for an id, by what follows it.
        n_a, n_b = len(of_a), len(of_b)
        self._written = pa.array(
            [f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, [",", ";", ""])) for end in ends for i in range(n)],
            pa.large_string(),
        )
        self._first_b = 2 * n_a

    def _encode_a(self, words: list[str]) -> Iterable[list[int]]:
        for i in range(0, len(words), 20_000):
            for found in self._a.encode_batch_fast(words[i : i + 20_000], add_special_tokens=False):
                yield found.ids

    def _encode_b(self, words: list[str]) -> Iterable[list[int]]:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            encoded = self._b.encode([w[1:] for w in some], num_threads=1)
            # The library puts no blank before nothing, as it stands at the end of a text.
            yield from (ids if w != " " else self._blank for w, ids in zip(some, encoded, strict=True))

    def _split(self, texts: pa.Array) -> pa.Array:
        """Parts of each text that both tokenizers encode as in the text; each begins with a blank."""
        if self._by_words:
            for code in (0, 1, 2, 3, 0xFDD0, 0xFDD1):
                mark = chr(code)
                if not pc.any(pc.match_substring(texts, mark)).as_py():
                    marked = pc.replace_substring_regex(texts, _WORD_START, rf"\1{mark}\2")
                    return pc.split_pattern(marked, mark)
        return pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), texts)

    def align(self, texts: list[bytes | None]) -> list:
        """Columns as in ``ALIGNED``."""
        spelt = [b" " + (t or b"") for t in texts]
        words = self._split(pa.array(spelt, pa.large_binary()).cast(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        rows = self._words.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        words_before = np.cumsum(words.value_lengths().to_numpy())
        ids, per_text = [], []
        fits = np.array([bool(t) for t in texts])
        for side in (0, 1):
            sizes, flat = self._words.ids_of(rows, side)
            per_text.append(np.diff(np.r_[0, np.cumsum(np.r_[0, sizes])[words_before]]))
            ids.append(flat)
            data, at = _spelt(self._bytes[side].take(pa.array(flat)))
            borders = at[np.r_[0, np.cumsum(per_text[side])]]
            fits &= [
                data[lo:hi] == text
                for lo, hi, text in zip(borders[:-1], borders[1:], spelt, strict=True)
            ]
        for side in (0, 1):
            if not fits.all():
                ids[side] = ids[side][np.repeat(fits, per_text[side])]
                per_text[side] = np.where(fits, per_text[side], 0)
        return self._columns(*ids, *per_text, fits)

    def _columns(
        self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, fits: np.ndarray
    ) -> list:
        a_ends, b_ends = (np.cumsum(n[x]) for n, x in zip(self._lengths, (a, b), strict=True))
        a_stops = np.cumsum(n_a)
        closes = shared_cuts(a_ends, b_ends, (a_stops - n_a)[fits], a_stops[fits])
        a_last = np.flatnonzero(closes)
        b_last = np.searchsorted(b_ends, a_ends[a_last])
        groups_before = np.r_[0, np.cumsum(closes)][np.r_[0, a_stops]]
        n_groups = np.diff(groups_before)
        links = np.searchsorted(self.pairs, a[a_last].astype(np.int64) << 32 | b[b_last])
        # Each group's tokens of A, then its tokens of B.
        a_sizes, b_sizes = np.diff(np.r_[-1, a_last]), np.diff(np.r_[-1, b_last])
        group_starts = np.cumsum(a_sizes + b_sizes) - a_sizes - b_sizes
        n = np.int64(len(self._lengths[1]))
        of_a = a + closes * np.int64(len(self._lengths[0]))
        of_b = b + np.int64(self._first_b)
        of_b[b_last] += n
        of_b[(np.cumsum(n_b) - 1)[fits]] += n
        codes = np.empty(len(a) + len(b), np.int64)
        codes[runs(group_starts, a_sizes)] = of_a
        codes[runs(group_starts + a_sizes, b_sizes)] = of_b
        written = self._written.take(pa.array(codes))
        data, at = _spelt(written)
        borders = at[np.r_[0, np.cumsum(n_a + n_b)]]
        if self._digests:
            groups = pa.array(
                [
                    hashlib.sha256(data[lo:hi]).hexdigest() if ok else ""
                    for lo, hi, ok in zip(borders[:-1], borders[1:], fits, strict=True)
                ],
                pa.string(),
            )
        else:
            groups = pa.Array.from_buffers(
                pa.large_string(), len(fits), [None, pa.py_buffer(borders), pa.py_buffer(data)]
            ).cast(pa.string())
        numbers = pa.ListArray.from_arrays(
            pa.array(groups_before, pa.int32()), pa.array(links, pa.int32())
        )
        return [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_groups)), groups, numbers]


def _load(byte_level: str | None, pieces: str | None) -> tuple[str, bytes]:
    """Content of the tokenizer files; read by the driver and sent to the tasks, 3 MB at most."""
    if byte_level is None or pieces is None:
        import public_tokenizers

        byte_level = byte_level or public_tokenizers.path(BYTE_LEVEL)
        pieces = pieces or public_tokenizers.path(PIECES)
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        return a.read(), b.read()


def align(
    df: DataFrame,
    text: str = "text",
    byte_level: str | None = None,
    pieces: str | None = None,
    digests: bool = False,
) -> DataFrame:
    """Columns of ``df`` but ``text``, then ``n_a n_b n_groups n_links groups links``.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids of each group, or with ``digests`` its SHA-256.
    ``links``: for each link, the number of its pair in ``possible_pairs``. Both tokenizers encode a
    space and the text; strings of special tokens are plain text. Texts that are null or empty, or
    that one of them does not spell out byte by byte, have no tokens: zeros, no links, and ``groups``
    is ''. Columns of ``df`` called like results make the names of the result ambiguous: drop them
    before. Rows are worked on one by one, without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(_load(byte_level, pieces))

    def make() -> Callable[[list[bytes | None]], list]:
        return Aligner(*shared.value, digests).align

    return map_pieces(df, text, make, ALIGNED, PIECE_BYTES)


def link_counts(aligned: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """How many links of all texts have each pair; there are no more rows than possible pairs."""
    numbers = aligned.select(F.explode("links").alias("pair")).groupBy("pair").count()
    counts = np.zeros(len(pairs), np.int64)
    found = numbers.toArrow()
    counts[found["pair"].to_numpy()] = found["count"].to_numpy()
    return counts


def highest_of_b(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """True for pairs whose count is the highest of their id of B, ties included."""
    b = pairs & 0xFFFFFFFF
    highest = np.zeros(b.max(initial=-1) + 1, np.int64)
    np.maximum.at(highest, b, counts)
    return counts == highest[b]


def score(aligned: DataFrame, pairs: np.ndarray) -> DataFrame:
    """``aligned`` with ``links`` replaced by ``n_best`` and ``count_sum``.

    ``n_best``: links whose pair is one of the most frequent of its id of B; ``count_sum``: sum of
    the counts of their pairs over all links. ``aligned`` is read twice and should be a stored table.
    """
    counts = link_counts(aligned, pairs)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, highest_of_b(pairs, counts)))
    at = aligned.columns.index("links")
    fields = [f for f in aligned.schema.fields if f.name != "links"]
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("n_best", "count_sum"))])

    def run(stream):
        counts, best = shared.value
        for batch in stream:
            lists = batch.column(at)
            numbers = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            sums = [np.diff(np.r_[0, np.r_[0, np.cumsum(x[numbers], dtype=np.int64)][ends]]) for x in (best, counts)]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in sums)], names=out.names)

    return aligned.mapInArrow(run, out)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = possible_pairs(*token_bytes(*_load(None, None)))
    aligned = stage(align(docs, digests=True), "aligned")
    return score(aligned, pairs).withColumnRenamed("groups", "groups_sha256")
