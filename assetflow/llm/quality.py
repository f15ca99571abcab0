"""Quality rules: how much of a text repeats itself, and a few base counts.

Every n-gram length is measured with rolling hashes over all texts of a batch at once; two
n-grams are the same when their 64-bit hashes are. Rows are independent of each other, so the
only cost is one scan. No shuffle, whatever the skew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import filter_pieces, map_pieces
from assetflow.llm.wordhash import Hasher, Words, _sums, mix

NGRAMS = (5, 6, 7, 8, 9, 10)
# Percent of a text's word characters that may lie in lines equal to an earlier line, and be symbols.
MAX_LINE_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE_WINDOW = 3
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def max_ngram_percent(n: int) -> int:
    """Percent of a text's word characters that may lie inside n-grams found twice or more.

    15 for 5 words, falling to 10 for 10: the longer what is repeated, the less of it is chance.
    """
    return min(15, max(10, 20 - n))


def _found_twice(keys: np.ndarray) -> np.ndarray:
    """True at each key that another key equals."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def _covered(words: Words, n: int) -> np.ndarray:
    """True at each word inside an n-gram that its text has twice or more."""
    hashes = words.hash_ngrams(n)
    places = np.flatnonzero(words.doc[: len(hashes)] == words.doc[n - 1 :]) if len(hashes) else []
    if not len(places):
        return np.zeros(len(words.hash), bool)
    salt = mix(words.doc[places].astype(np.uint64) + np.uint64(1))
    places = places[_found_twice(mix(hashes[places] ^ salt))]
    steps = np.zeros(len(words.hash) + 1, np.int64)
    steps[places] += 1
    steps[places + n] -= 1
    return np.cumsum(steps[:-1]) > 0


def _repeated_lines(words: Words, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: lines with a word that equal an earlier line, and their characters in words."""
    n_texts = len(words.text_start)
    breaks = np.flatnonzero(words.data == 10)
    start = np.sort(np.concatenate([words.text_start, breaks + 1]))
    end = np.sort(np.concatenate([words.text_end, breaks]))
    lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = hi > lo
    start, end, lo, hi = start[full], end[full], lo[full], hi[full]
    doc = np.searchsorted(words.text_start, start, side="right") - 1
    key = mix(words.hash_bytes(start, end) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    chars = _sums(points[words.end] - points[words.start])
    per_line = chars[hi] - chars[lo]
    return (
        np.bincount(doc[again], minlength=n_texts),
        np.bincount(doc[again], weights=per_line[again], minlength=n_texts).astype(np.int64),
    )


def measure_texts(hasher: Hasher, texts: list[bytes | None], ngrams=NGRAMS) -> dict[str, np.ndarray]:
    """The counts of each text; a null counts as an empty text."""
    words = hasher.words(texts)
    points = words.code_points()
    chars = points[words.end] - points[words.start]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    symbols = _sums(symbol[words.data].astype(np.int64))
    lines, line_chars = _repeated_lines(words, points)
    out = {
        "n_words": np.diff(words.first),
        "word_chars": words.by_text(chars),
        "n_symbols": symbols[words.text_end] - symbols[words.text_start],
        "n_dup_lines": lines,
        "n_repeat_words": words.by_text(_covered(words, BASE_WINDOW)),
        "dup_line_chars": line_chars,
    }
    for n in ngrams:
        out[f"dup_chars_{n}"] = words.by_text(np.where(_covered(words, n), chars, 0))
    return out


def verdicts(counts: dict[str, np.ndarray], ngrams=NGRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts."""
    n_words, chars = counts["n_words"], counts["word_chars"]
    failed = (n_words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    bad = failed | (100 * counts["n_symbols"] > MAX_SYMBOL_PERCENT * chars)
    bad |= 100 * counts["dup_line_chars"] > MAX_LINE_PERCENT * chars
    for n in ngrams:
        bad |= 100 * counts[f"dup_chars_{n}"] > max_ngram_percent(n) * chars
    return failed, ~bad


def measure(df: DataFrame, text: str = "text", ngrams=NGRAMS) -> DataFrame:
    """Columns of ``df`` but ``text``, the counts, ``base_failed`` and ``kept``.

    Null or empty text: all counts 0, ``base_failed``. Rows are judged one by one, so repeated
    rows get equal results and an empty table gives an empty one. A column of ``df`` that has the
    name of a count has to be renamed or left out before; ``keep_good`` needs neither.
    """
    names = [*COUNTS, *[f"dup_chars_{n}" for n in ngrams]]
    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in names]
        + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    )

    def make():
        hasher = Hasher()

        def run(texts):
            counts = measure_texts(hasher, texts, ngrams)
            return [*[counts[n] for n in names], *verdicts(counts, ngrams)]

        return run

    return map_pieces(df, text, make, schema)


def keep_good(df: DataFrame, text: str = "text", ngrams=NGRAMS) -> DataFrame:
    """The rows of ``df`` whose text passes all rules, with all their columns.

    Columns may have any name. Rows with a null or empty text go.
    """

    def make():
        hasher = Hasher()
        return lambda texts: verdicts(measure_texts(hasher, texts, ngrams), ngrams)[1]

    return filter_pieces(df, text, make)


def op10_repetition(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measure(docs).select(
        "doc_id",
        *[c for c in COUNTS if c != "dup_line_chars"],
        "base_failed",
        "kept",
        "dup_line_chars",
        *[F.col(f"dup_chars_{n}") for n in NGRAMS],
    )


def _repeats_sql(n: int, value: str) -> str:
    """Per row: a sum over the words inside n-word windows that a text has twice or more."""
    gram = " || ' ' || ".join(["w", *[f"lead(w, {k}) over t" for k in range(1, n)]])
    back = f"rows between {n - 1} preceding and current row"
    return f"""
      select r, sum({value}) as v from (
        select r, w, max(times) over (partition by r order by p {back}) as most from (
          select r, p, w, case when gram is null then 0 else count(*) over (partition by r, gram) end as times
          from (select r, p, w, {gram} as gram from words window t as (partition by r order by p))))
      where most > 1 group by r"""


def sql(table: str = "documents") -> str:
    """DuckDB SQL of ``op10_repetition`` over ``table``."""
    parts = ",\n".join(
        [f"rep as ({_repeats_sql(BASE_WINDOW, '1')})"]
        + [f"dup{n} as ({_repeats_sql(n, 'length(w)')})" for n in NGRAMS]
    )
    joins = " ".join(f"left join dup{n} on dup{n}.r = docs.r" for n in NGRAMS)
    dups = ",\n".join(f"cast(coalesce(dup{n}.v, 0) as bigint) as dup_chars_{n}" for n in NGRAMS)
    limits = " or ".join(f"100 * dup_chars_{n} > {max_ngram_percent(n)} * word_chars" for n in NGRAMS)
    return f"""
    with docs as (
      select row_number() over () as r, doc_id, coalesce(text, '') as t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws
      from {table}),
    words as (select r, unnest(ws) as w, unnest(range(len(ws))) as p from docs),
    lines as (
      select r, line, count(*) as times,
             any_value(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) as chars
      from (select r, unnest(string_split(t, chr(10))) as line from docs)
      where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r, line),
    again as (select r, sum(times - 1) as n, sum((times - 1) * chars) as chars from lines group by r),
    {parts},
    counted as (
      select doc_id, cast(len(ws) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars,
        cast(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(again.n, 0) as bigint) as n_dup_lines,
        cast(coalesce(rep.v, 0) as bigint) as n_repeat_words,
        cast(coalesce(again.chars, 0) as bigint) as dup_line_chars,
        {dups}
      from docs left join again on again.r = docs.r left join rep on rep.r = docs.r {joins})
    select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
      not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words
           or 100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars
           or 100 * dup_line_chars > {MAX_LINE_PERCENT} * word_chars or {limits}) as kept
    from counted"""
