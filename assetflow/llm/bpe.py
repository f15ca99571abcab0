"""Byte-pair encoding by a trie of distinct words.

Words are put into a trie by their first symbols (bytes; the last one carries the word end). Going
down the trie, every node gets one state: the last token of the encoding of its prefix. It is the
token for which the pair (last token of the prefix without it, it) stays a pair when the merges are
applied to both together; the encoding of a prefix is that shorter prefix's encoding and this
token. So prefixes that words share are encoded once, and a word is read off by going back from its
leaf by the lengths of last tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import map_pieces
from assetflow.llm.wordcache import Remembered

DEFAULT_VOCABULARY = "word_bpe_49k.json"
# Text whose new words go into one trie, and pairs of tokens that a task remembers.
PIECE_BYTES = 2 << 20
REMEMBERED_PAIRS = 200_000

_NOTHING = 1 << 20  # stands before the first token; no token has this id
_END = "</w>"
_MARKS = ",.;:!?"
# White space as the pattern's engine has it; str.split() also splits at \x1c-\x1f.
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = regex.compile(r"[\x1c-\x1f]")

ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the rules that split a text, from a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern + "|\n")
        # Words with a mark at their end are then parts of their own, met more often.
        self.marks_apart = all(self._words.findall(f"a{m}") == ["a", m] for m in _MARKS)
        self._letters = {b: c for b, c in enumerate(byte_letters()) if b not in (10, 32)}
        # The strings and pairs of both tables are the same objects.
        one = {t: t for t in self.ids}
        split = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        pairs = [(one.get(a, a), one.get(b, b)) for a, b in split]
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.parts = {one.get(a + b, a + b): pair for pair in pairs for a, b in [pair]}
        self._right: dict[str, list[tuple[str, float]]] = {}
        self._left: dict[str, list[tuple[str, float]]] = {}
        self._alone: dict[str, bool] = {}

    def words_of(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk, in byte letters; chunks hold no white space."""
        joined = unicodedata.normalize("NFC", "\n".join(chunks)).replace("Σ", "σ").lower()
        words = " ".join(self._words.findall(joined))
        letters = words.encode().decode("latin-1").translate(self._letters)
        return [part.split() for part in letters.split("\n")]

    def _edge(self, token: str, side: int, known: dict) -> list[tuple[str, float]]:
        """What stands at one end of ``token`` while it is built, and the rank that uses it up."""
        if token not in known:
            steps, part, used = [], token, float("inf")
            while True:
                steps.append((part, used))
                if part not in self.parts:
                    break
                used = self.rank[self.parts[part]]
                part = self.parts[part][side]
            known[token] = steps
        return known[token]

    def merge_across(self, a: str, b: str, except_for: tuple[str, str] | None = None) -> bool:
        """True when building ``a`` and ``b`` side by side merges something across the border."""
        rank = self.rank
        for x, x_used in self._edge(a, 1, self._right):
            for y, y_used in self._edge(b, 0, self._left):
                r = rank.get((x, y))
                # Equal ranks are equal pairs that overlap; the left one is merged first.
                if r is not None and r < x_used and r <= y_used and (x, y) != except_for:
                    return True
        return False

    def alone(self, token: str) -> bool:
        """True when the merges turn the token's own symbols into it."""
        known = self._alone.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = parts is None or (
                self.alone(parts[0]) and self.alone(parts[1]) and not self.merge_across(*parts, parts)
            )
            self._alone[token] = known
        return known


class Encoder:
    """Encodes texts; the words of a piece that the task has not met before share one trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._stays: dict[int, bool] = {}
        self._known = Remembered(self.encode_parts)
        names = [t for t in vocabulary.ids if t not in vocabulary.special]
        self._letters_in = {vocabulary.ids[t]: len(t.removesuffix(_END)) for t in names}
        self._names = vocabulary.tokens
        # Tokens by their letters from the last to the first; "" leads to the token's id.
        self._inner: dict = {}
        self._final: dict = {}
        for t in names:
            node = self._final if t.endswith(_END) else self._inner
            for letter in reversed(t.removesuffix(_END)):
                node = node.setdefault(letter, {})
            node[""] = vocabulary.ids[t]
        size = max(self._names, default=-1) + 1
        self._strings = pa.array([self._names.get(i) for i in range(size)], pa.string())

    def _stays_apart(self, before: int, token: int) -> bool:
        key = before << 32 | token
        known = self._stays.get(key)
        if known is None:
            known = self.vocabulary.alone(self._names[token]) and (
                before == _NOTHING
                or not self.vocabulary.merge_across(self._names[before], self._names[token])
            )
            if len(self._stays) >= REMEMBERED_PAIRS:
                self._stays.clear()
            self._stays[key] = known
        return known

    def _last_token(self, path: str, node: dict, states: list[int]) -> int:
        """The last token of the encoding of ``path``; ``node`` is the root of its tokens."""
        fitting = []
        for at in range(len(path) - 1, -1, -1):
            node = node.get(path[at])
            if node is None:
                break
            token = node.get("")
            if token is not None:
                fitting.append((at, token))
        stays = self._stays
        for at, token in reversed(fitting):
            before = states[at]
            fits = stays.get(before << 32 | token)
            if fits if fits is not None else self._stays_apart(before, token):
                return token
        raise ValueError(f"no token ends {path!r}")

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each distinct word, from a depth-first walk over the trie of all."""
        root: dict = {}
        encoded: list[list[int]] = [[]] * len(words)
        for number, word in enumerate(words):
            if word in self.vocabulary.special:
                encoded[number] = [self.vocabulary.special[word]]
                continue
            node = root
            for letter in word[:-1]:
                below = node.get(letter)
                if below is None:
                    below = node[letter] = {}
                node = below
            node[word[-1] + _END] = number
        # states[d] is the last token of the first d letters of the path walked.
        states = [_NOTHING] * 64
        last_token, letters_in = self._last_token, self._letters_in
        todo = [(root, "")]
        while todo:
            node, path = todo.pop()
            depth = len(path)
            if depth:
                if depth >= len(states):
                    states.extend([_NOTHING] * depth)
                states[depth] = last_token(path, self._inner, states)
            for edge, child in node.items():
                if isinstance(child, dict):
                    todo.append((child, path + edge))
                    continue
                token = last_token(path + edge[0], self._final, states)
                tokens, at = [token], depth + 1 - letters_in[token]
                while at:
                    tokens.append(states[at])
                    at -= letters_in[states[at]]
                tokens.reverse()
                encoded[child] = tokens
        return encoded

    def _split(self, text: str) -> list[str]:
        """Chunks without white space; special tokens of the raw text are chunks of their own."""
        special = self.vocabulary.special
        if any(s in text for s in special):
            longest_first = sorted(special, key=len, reverse=True)
            parts = regex.split("(" + "|".join(map(regex.escape, longest_first)) + ")", text)
            return [c for p in parts for c in ([p] if p in special else self._split(p))]
        if _ODD_SPACE.search(text):
            return [part for part in _SPACE.split(text) if part]
        return text.split()

    def encode_parts(self, parts: list[str]) -> Iterator[list[int]]:
        """The tokens of each part of a text, all distinct; their words share one trie."""
        split = [self._split(part) for part in parts]
        chunks = [*dict.fromkeys(chain.from_iterable(split))]
        words_in = dict(zip(chunks, self.vocabulary.words_of(chunks), strict=True)) if chunks else {}
        for special in self.vocabulary.special:
            if special in words_in:
                words_in[special] = [special]
        words = [*dict.fromkeys(chain.from_iterable(words_in.values()))]
        encoded = dict(zip(words, self.encode_words(words), strict=True))
        for of_part in split:
            yield [t for chunk in of_part for word in words_in[chunk] for t in encoded[word]]

    def encode_texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(place of each text's first token, and of the end; token ids of all texts)."""
        spaced = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        if self.vocabulary.marks_apart:
            spaced = pc.replace_substring_regex(spaced, rf"([A-Za-z])([{_MARKS}])( |$)", r"\1 \2\3")
        parts = pc.split_pattern(spaced, " ")
        coded = parts.flatten().dictionary_encode()
        rows = self._known.rows_of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes, ids = self._known.ids_of(rows)
        ends = np.cumsum(parts.value_lengths().to_numpy())
        before = np.cumsum(np.r_[0, sizes])[np.r_[0, ends]]
        return pa.array(before, pa.int32()), pa.array(ids.astype(np.int32))

    def decode(self, offsets: pa.Array, ids: pa.Array) -> pa.Array:
        """Tokens joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self._strings.take(ids)), " ")


def load(path: str | None = None) -> str:
    """Content of a tokenizer file; read by the driver and sent to the tasks, 2 MB at most."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(
    df: DataFrame, text: str = "text", vocabulary: str | None = None, decoded: bool = True
) -> DataFrame:
    """Columns of ``df`` but ``text``, then ``n_tokens``, ``ids`` and, if asked for, ``decoded``.

    ``vocabulary``: path of a tokenizer file. Null and empty texts have no tokens. Rows are
    encoded one by one; no shuffle, and a task holds one trie of a piece's new words at a time.
    """
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))

    def make():
        encoder = Encoder(Vocabulary(shared.value))

        def run(texts):
            offsets, ids = encoder.encode_texts(pa.array(texts, pa.large_binary()))
            lists = pa.ListArray.from_arrays(offsets, ids)
            columns = [lists.value_lengths().cast(pa.int64()), lists]
            return [*columns, encoder.decode(offsets, ids)] if decoded else columns

        return run

    schema = ENCODED if decoded else T.StructType(ENCODED.fields[:2])
    return map_pieces(df, text, make, schema, PIECE_BYTES)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``ids`` replaced by ``decoded``, the tokens joined by a space; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(load(vocabulary))
    at = df.columns.index(ids)
    schema = T.StructType(
        [T.StructField("decoded", T.StringType()) if f.name == ids else f for f in df.schema.fields]
    )
    names = schema.names

    def run(stream):
        encoder = Encoder(Vocabulary(shared.value))
        for batch in stream:
            column = batch.column(at)
            flat = column.flatten()
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            texts = encoder.decode(offsets, flat)
            columns = batch.columns
            columns[at] = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """``ids`` and ``decoded`` replaced by their digests."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.withColumns(
        {"ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(F.col("decoded"), 256)}
    ).drop("ids", "decoded")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode(docs))
