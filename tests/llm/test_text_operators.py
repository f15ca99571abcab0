"""Quality rules, decontamination and encoding: against SQL, brute force and the tokenizer library."""

import hashlib
import re
from collections import Counter

import compare
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetflow.llm import bpe, decontam, quality
from assetflow.llm.wordhash import Hasher


def table(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


QUERIES = [(quality, quality.op10_repetition), (decontam, decontam.op7_decontaminate)]


@pytest.mark.parametrize("module, query", QUERIES, ids=lambda x: x.__name__)
@pytest.mark.parametrize("which", ["edge", "empty", "sf0.001"])
def test_query_equals_sql(spark, edge_dir, empty_dir, module, query, which):
    sf_dir = {"edge": edge_dir, "empty": empty_dir}.get(which, "/root/testdata/sf0.001")
    assert compare.rows_of_spark(query(spark, sf_dir)) == compare.rows_of_sql(table(sf_dir), module.sql())


def repeated_by_hand(words, n):
    """Characters inside n-grams found twice or more."""
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {p for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for p in range(i, i + n)}
    return len(inside), sum(len(words[p]) for p in inside)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n#\t\x0b", max_size=80)), max_size=6))
def test_counts_by_hand(texts):
    counts = quality.measure_texts(Hasher(), [None if t is None else t.encode() for t in texts], (2, 5))
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert counts["n_words"][i] == len(words)
        assert counts["word_chars"][i] == sum(map(len, words))
        assert counts["n_symbols"][i] == text.count("#")
        assert counts["n_repeat_words"][i] == repeated_by_hand(words, 3)[0]
        for n in (2, 5):
            assert counts[f"dup_chars_{n}"][i] == repeated_by_hand(words, n)[1]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert counts["n_dup_lines"][i] == len(lines) - len(set(lines))


def test_good_documents_stay_with_their_columns(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    judged = quality.measure(docs.select("doc_id", "text", "n_chars")).where("kept")
    assert sorted((r.doc_id, r.n_chars) for r in kept.collect()) == sorted((r.doc_id, r.n_chars) for r in judged.collect())
    texts = [r.text for r in kept.collect()]
    assert not any("###" in t or "spam ham" in t for t in texts)


def test_ngrams_of_long_texts_do_not_cross_texts():
    words = Hasher().words([b"a b c", b"a b c", None, b""])
    assert list(np.diff(words.first)) == [3, 3, 0, 0]
    assert words.hash_ngrams(3)[0] == words.hash_ngrams(3)[3]


# Decontamination


def test_spans_are_places_of_the_original(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    texts = dict((r.doc_id, r.text) for r in docs.collect())
    hit = decontam.find_contamination(docs, bench).where("n_hit > 0").collect()
    assert hit
    for row in hit:
        for start, end in row.spans:
            part = texts[row.doc_id][start:end]
            assert decontam.normal_words(part.encode())
            assert part[0].isalnum() and part[-1].isalnum()
        inside = sum(len(decontam.normal_words(texts[row.doc_id][s:e].encode())) for s, e in row.spans)
        assert inside == row.n_hit


def test_several_automata_find_the_same(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    columns = ["doc_id", "n_words", "n_hit", "items", "spans"]
    one = decontam.find_contamination(docs, bench).select(columns)
    many = decontam.find_contamination(docs, bench, max_windows=9).select(columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_contaminated_documents_go(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    bench = spark.read.parquet(f"{edge_dir}/benchmark.parquet")
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    hit = decontam.op7_decontaminate(spark, edge_dir).where("contaminated").count()
    assert clean.count() == docs.count() - hit
    assert hit >= 3


# Encoding


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.load()))


def both(encoder, texts):
    offsets, ids = encoder.encode_texts(pa.array(texts, pa.string()))
    at, flat = offsets.to_pylist(), ids.to_pylist()
    return [flat[a:b] for a, b in zip(at, at[1:])], encoder.decode(offsets, ids).to_pylist()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("which", ["edge", "empty"])
def test_encoding_equals_the_library(spark, library, edge_dir, empty_dir, which):
    sf_dir = {"edge": edge_dir, "empty": empty_dir}[which]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for row in docs:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((row.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded)))
    found = bpe.op9_bpe(spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabbltheoé'sßΣİ01 .,!-<|>\x1c\x85 中👍"), max_size=40), max_size=5))
def test_random_texts_encode_as_the_library_does(library, encoder, texts):
    ids, decoded = both(encoder, texts)
    for text, own, back in zip(texts, ids, decoded, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert own == expected
        assert back == library.decode(expected, skip_special_tokens=False)


def test_decoding_ids_gives_the_decoded_text(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    rows = bpe.encode(docs)
    again = bpe.decode(rows.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "was"))
    assert again.where("decoded != was").count() == 0


def test_one_trie_walk_equals_plain_merging(encoder):
    """Words that share beginnings, against merging pairs by rank."""
    vocabulary = encoder.vocabulary
    words = ["a" * n for n in range(1, 40)] + ["abab" * n for n in range(1, 9)] + ["thethe", "there", "then", "th"]

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            ranks = [vocabulary.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 30:
                return [vocabulary.ids[p] for p in parts]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    assert encoder.encode_words(words) == [merged(w) for w in words]


def test_a_long_repetition_decides_alone():
    """Ten words twice are 20 of 190: over 10 %, the limit for ten words, and below those for fewer."""
    words = [f"w{i:03d}" for i in range(180)]
    text = " ".join([*words[:100], *words[40:50], *words[100:]])
    counts = quality.measure_texts(Hasher(), [text.encode(), " ".join(words).encode()])
    bad = [[100 * c > quality.max_ngram_percent(n) * t for c, t in zip(counts[f"dup_chars_{n}"], counts["word_chars"], strict=True)] for n in quality.NGRAMS]
    assert [b[0] for b in bad] == [False] * 5 + [True] and not any(b[1] for b in bad)
    failed, kept = quality.verdicts(counts)
    assert failed.tolist() == [False, False] and kept.tolist() == [False, True]
