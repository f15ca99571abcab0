"""The pipeline on small tables: each stage against a plain reading of what it has to do."""

import re

import compare
import pyarrow.parquet as pq
import pyarrow as pa
import pytest
from test_similar import by_hand

import __spark_entry__ as entry_point
import corpus_pipeline
from assetflow.llm import bpe, decontam, quality, toxicity
from assetflow.llm import queries as llm_queries
from assetflow.llm.wordhash import Hasher

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLES))
def test_oracles_on_the_smallest_tables(spark, name):
    found = compare.rows_of_spark(llm_queries.QUERIES[name](spark, SF_DIR))
    assert found == compare.rows_of_sql(compare.database(SF_DIR), llm_queries.ORACLES[name])


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in llm_queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(llm_queries.QUERIES) | {"pipeline"} <= set(entry_point.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality", "toxicity", "near-duplicates", "decontamination", "encoding",
    ]


def plain_pipeline(spark, sf_dir):
    """Ids that are left, stage by stage, with rows handled one after the other."""
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(table["doc_id"], table["text"], strict=True))
    hasher = Hasher()
    rows = [
        r for r in rows
        if quality.verdicts(quality.measure_texts(hasher, [(r[1] or "").encode()]))[1][0]
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    at, limit = chain.categories.index("toxic"), chain.thresholds[chain.categories.index("toxic")]
    featurizer = toxicity.Featurizer(chain.vocabulary)
    rows = [r for r in rows if chain.probabilities([featurizer(r[1].encode())])[at][0] <= limit]
    kept = [j for r, j in zip(rows, by_hand(rows), strict=True) if j[3]]
    ids = {j[0] for j in kept}
    rows = [r for r in rows if r[0] in ids]
    bench = pq.read_table(f"{sf_dir}/benchmark.parquet")["text"].to_pylist()
    windows = {w for b in bench if b for w in decontam.windows_of(decontam.normal_words(b.encode()))}
    lengths = {len(w) for w in windows}

    def clean(text):
        words = decontam.normal_words(text.encode())
        return not any(tuple(words[i : i + n]) in windows for n in lengths for i in range(len(words) - n + 1))

    return [r for r in rows if clean(r[1])]


@pytest.mark.parametrize("which", ["edge", "sf0.001"])
def test_pipeline_equals_a_plain_one(spark, edge_dir, which):
    sf_dir = {"edge": edge_dir}.get(which, SF_DIR)
    found = corpus_pipeline.run(spark, sf_dir).collect()
    left = plain_pipeline(spark, sf_dir)
    assert left
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.load()))
    expected = []
    for doc_id, text in left:
        _, ids = encoder.encode_texts(pa.array([text]))
        expected.append((doc_id, len(ids), ids.to_pylist()))
    assert sorted(((r.doc_id, r.n_tokens, list(r.ids)) for r in found), key=str) == sorted(expected, key=str)


def test_encoded_documents_are_decoded(spark, edge_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = corpus_pipeline.encoded(spark, docs, edge_dir).collect()
    assert len(rows) == docs.count()
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in rows)


def test_stages_keep_the_columns(spark, edge_dir, empty_dir):
    for sf_dir in (edge_dir, empty_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for _, function in corpus_pipeline.STAGES[:-1]:
            left = function(spark, docs, sf_dir)
            assert left.columns == docs.columns
            assert left.count() <= docs.count()
    assert corpus_pipeline.run(spark, empty_dir).count() == 0
