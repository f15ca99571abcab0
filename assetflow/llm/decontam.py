"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

The automaton reads words, not characters: a benchmark word has a number, any other word is 0 and
sends the automaton back to its start. A document is normalised and scanned once; places of hits
are words, which are mapped to character offsets of the original text.
"""

from __future__ import annotations

import re
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import filter_pieces, map_pieces, utf8
from assetflow.shared import stage

WINDOW = 10
# Windows in one automaton, some 100 bytes for each of their words. A larger benchmark is dealt
# into several automata, and the documents are read once for each.
MAX_WINDOWS = 100_000

_WORD_BYTES = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256)
)
# The words of the original text, before lower-casing.
_ORIGINAL = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
            ),
        ),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Runs of ``window`` words; a shorter item is one run, an empty one none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per distinct window: ``words`` joined by a space, ``items`` that hold it.

    Items of one id are one item; those without an id are one item with an empty id.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"
    )
    schema = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])

    def make():
        return lambda texts: [
            [[b" ".join(w).decode() for w in set(windows_of(normal_words(t), window))] for t in texts]
        ]

    cut = map_pieces(items, "text", make, schema)
    return (
        cut.select("item", F.explode("words").alias("words"))
        .groupBy("words")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


class Automaton:
    """Finds the windows of a benchmark in normalised words."""

    def __init__(self, patterns: list[tuple[str, list[str]]]):
        import ahocorasick

        self._numbers: dict[bytes, int] = {}
        self._machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, items in patterns:
            parts = words.encode().split(b" ")
            key = tuple(self._numbers.setdefault(w, len(self._numbers) + 1) for w in parts)
            self._machine.add_word(key, (len(key), items))
        if patterns:
            self._machine.make_automaton()

    def find(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """(places of the words inside found windows, items of those windows)."""
        hit: set[int] = set()
        items: set[str] = set()
        if self._numbers and words:
            numbers = tuple(map(self._numbers.get, words, repeat(0)))
            if any(numbers):
                for last, (length, found) in self._machine.iter(numbers):
                    hit.update(range(last - length + 1, last + 1))
                    items.update(found)
        return hit, items


def spans_of(text: str, hit: set[int]) -> list[dict]:
    """Character ranges of the original text, one for each run of hit words."""
    spans: list[dict] = []
    before = -2
    for place, match in enumerate(_ORIGINAL.finditer(text)):
        if place not in hit:
            continue
        if place == before + 1:
            spans[-1]["end"] = match.end()
        else:
            spans.append({"start": match.start(), "end": match.end()})
        before = place
    return spans


_PLACES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _scan(df: DataFrame, text: str, windows: DataFrame, with_spans: bool) -> DataFrame:
    """One pass over ``df`` with one automaton; spans, or else the places of hit words."""
    patterns = [(r["words"], r["items"]) for r in windows.collect()]
    shared = df.sparkSession.sparkContext.broadcast(patterns)

    def make():
        automaton = Automaton(shared.value)

        def run(texts):
            words = [normal_words(t) for t in texts]
            found = [automaton.find(w) for w in words]
            counts, items = [len(w) for w in words], [sorted(f[1]) for f in found]
            if not with_spans:
                return [counts, [sorted(f[0]) for f in found], items]
            spans = [
                spans_of(t.decode(), hit) if hit else []
                for t, (hit, _) in zip(texts, found, strict=True)
            ]
            return [counts, [len(f[0]) for f in found], items, spans]

        return run

    return map_pieces(df, text, make, FOUND if with_spans else _PLACES)


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Columns of ``df`` but ``text``, with ``n_words``, ``n_hit``, ``items`` and ``spans``.

    A null text has no words. An empty benchmark hits nothing. Repeated rows get equal results.
    Columns of ``df`` named like a result must be renamed or left out before the call.
    """
    windows = stage(benchmark_windows(benchmark, window), "windows")
    blocks = -(-windows.count() // max_windows)
    if blocks <= 1:
        return _scan(df, text, windows, True)
    # A pass for each automaton; written with row numbers, so that hits can be put together.
    rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        hits = _scan(rows.select("_row", text), text, part, False).where(F.size("places") > 0)
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy(F.col("_row").alias("_hit_row")).agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("_places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"),
    )
    return _with_spans(rows.join(merged, rows["_row"] == F.col("_hit_row"), "left"), text, df.columns)


def _with_spans(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    at = [rows.columns.index(c) for c in (text, "_places", "_items")]
    others = [c for c in columns if c != text]
    kept = [rows.columns.index(c) for c in others]
    schema = T.StructType([*rows.select(*others).schema.fields, *FOUND.fields])
    names = schema.names

    def run(stream):
        for batch in stream:
            texts = utf8(batch.column(at[0]))
            places = [set(p or ()) for p in batch.column(at[1]).to_pylist()]
            spans = [spans_of(t.decode(), p) if p else [] for t, p in zip(texts, places, strict=True)]
            made = [
                pa.array([len(normal_words(t)) for t in texts], pa.int64()),
                pa.array([len(p) for p in places], pa.int64()),
                pa.array([i or [] for i in batch.column(at[2]).to_pylist()], pa.list_(pa.string())),
                pa.array(spans, _SPANS),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *made], names=names)

    return rows.mapInArrow(run, schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` without any hit word, with all their columns, whatever their names."""
    windows = stage(benchmark_windows(benchmark), "windows")
    total = windows.count()
    blocks = max(1, -(-total // MAX_WINDOWS))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block)
        df = _clean(df, text, part)
        if blocks > 1:
            df = stage(df, "clean")
    return df


def _clean(df: DataFrame, text: str, windows: DataFrame) -> DataFrame:
    patterns = [(r["words"], r["items"]) for r in windows.collect()]
    shared = df.sparkSession.sparkContext.broadcast(patterns)

    def make():
        automaton = Automaton(shared.value)
        return lambda texts: [not automaton.find(normal_words(t))[0] for t in texts]

    return filter_pieces(df, text, make)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def sql(table: str = "documents") -> str:
    """DuckDB SQL of ``op7_decontaminate`` over ``table``."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    leads = ", ".join(f"lead(w, {k}) over t as w{k}" for k in range(1, WINDOW))
    grams = " union all ".join(
        f"select r, i, {n} as n, concat_ws(' ', w{''.join(f', w{k}' for k in range(1, n))}) as gram from runs "
        f"where {n} in (select n from windows)" + (f" and w{n - 1} is not null" if n > 1 else "")
        for n in range(1, WINDOW + 1)
    )
    return f"""
    with items as (
      select coalesce(cast(item_id as varchar), '') as item, {words} as ws from benchmark),
    windows as (
      select distinct item, least(len(ws), {WINDOW}) as n,
        array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') as gram
      from (select *, unnest(range(1, greatest(1, len(ws) - {WINDOW - 1}) + 1)) as i from items where len(ws) > 0)),
    docs as (select row_number() over () as r, doc_id, {words} as ws from {table}),
    words as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from docs),
    runs as (select *, {leads} from words window t as (partition by r order by i)),
    grams as ({grams}),
    hits as (select g.r, g.i, g.n, w.item from grams g join windows w on g.n = w.n and g.gram = w.gram),
    places as (select r, count(distinct p) as n_hit
               from (select r, unnest(range(i, i + n)) as p from hits) group by r),
    found as (select r, count(distinct item) as n_items, string_agg(item, ',' order by item) as ids
              from (select distinct r, item from hits) group by r)
    select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
      coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 as contaminated
    from docs left join places on places.r = docs.r left join found on found.r = docs.r"""
