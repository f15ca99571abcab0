import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetflow.llm import bpe, tokenfiles, wordcache

WORDS = "word_bpe_49k.json"


def plain(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def expected(rows, end_id=2):
    """Documents in order of id, one after the other; rows of a null id first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, plain(WORDS, [t or "" for _, t in rows]), strict=True):
        ids = [*ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def key(row):
    return row[1]


def test_edge_documents(spark, edge_dir, documents):
    got = sorted(map(tuple, tokenfiles.op12_token_files(spark, edge_dir).collect()), key=key)
    twice = [i for i, _ in documents if [j for j, _ in documents].count(i) > 1]
    want = expected(documents)
    # Rows of one id follow their hash, so only their sum is known here.
    apart = [r for r in want if r[0] not in twice]
    assert [r for r in got if r[0] not in twice] == apart
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] in twice) == sorted(
        (r[0], r[2], r[3]) for r in want if r[0] in twice
    )


def test_an_empty_table(spark, empty_dir):
    assert tokenfiles.op12_token_files(spark, empty_dir).collect() == []


def test_one_id_with_most_rows_fills_several_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_BYTES", 2000)
    monkeypatch.setattr(tokenfiles, "READ_DOCUMENTS", 7)
    monkeypatch.setattr(tokenfiles, "READ_BYTES", 64)
    rows = [(5, "the very same words, again and again")] * 300 + [(i, f"text {i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = f"{tmp_path}/tokens"
    tokenfiles.write(df, path, end_id=2)
    parts = tokenfiles.manifest(spark, path).orderBy("part").collect()
    assert max(p.documents for p in parts) < 150
    for before, after in zip(parts, parts[1:], strict=False):
        assert after.first_id == before.first_id + before.ids
        assert after.first_document == before.first_document + before.documents
    got = tokenfiles.read(spark, path).withColumn("ids", F.crc32("ids")).collect()
    assert [tuple(r) for r in sorted(got, key=key)] == expected(rows)


@pytest.mark.parametrize("end_id,width", [(2, 2), (1 << 16, 4)])
def test_the_format(spark, tmp_path, end_id, width):
    df = spark.createDataFrame([(None, "b"), (-4, "a b"), (9, None)], "doc_id long, text string")
    path = f"{tmp_path}/tokens"
    tokenfiles.write(df.coalesce(1), path, end_id=end_id)
    kinds = {"bin": f"<u{width}", "idx": "<u8", "doc": tokenfiles._DOCUMENT}
    found = {e: [] for e in kinds}
    for p in sorted(r.part for r in tokenfiles.manifest(spark, path).collect()):
        for e, kind in kinds.items():
            found[e].append(np.memmap(f"{path}/part-{p:05d}.{e}", kind, "r"))
    a, b, _ = (ids for ids in plain(WORDS, ["a", "b", ""]))
    assert np.concatenate(found["bin"]).tolist() == [*b, end_id, *a, *b, end_id, end_id]
    assert [x for part in found["idx"] for x in np.diff(part)] == [2, 3, 1]
    assert all(part[0] == 0 for part in found["idx"])
    assert [(bool(d["known"]), int(d["id"])) for part in found["doc"] for d in part] == [
        (False, 0),
        (True, -4),
        (True, 9),
    ]
    assert not [f for f in tmp_path.rglob("_part*")]


def test_a_second_writing_gives_the_same_files(spark, tmp_path, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    for name in ("a", "b"):
        tokenfiles.write(docs, f"{tmp_path}/{name}", end_id=2)
    files = {p.name: p.read_bytes() for p in (tmp_path / "a").glob("part*")}
    assert files and files == {p.name: p.read_bytes() for p in (tmp_path / "b").glob("part*")}


@pytest.mark.parametrize("name", [WORDS, "byte_bpe_50k.json"])
def test_words_are_encoded_as_in_their_text(documents, monkeypatch, name):
    monkeypatch.setattr(wordcache, "REMEMBERED_WORDS", 50)
    encoder = tokenfiles.Encoder(bpe.load(public_tokenizers.path(name)))
    assert encoder.by_words == (name == WORDS)
    texts = [t or "" for _, t in documents]
    texts += ["Don't, stop. ok,\tno,\n\nyes!", "a,́ é,  x　y. \x1c,z.", "it's: he'll; A.", ",", " . ", "x,"]
    want = plain(name, texts)
    for lo in range(0, len(texts), 9):
        sizes, ids = encoder.encode(pa.array(texts[lo : lo + 9]))
        assert sizes.tolist() == [len(w) for w in want[lo : lo + 9]]
        assert ids.tolist() == [i for w in want[lo : lo + 9] for i in w]
