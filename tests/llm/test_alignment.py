import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from assetflow.llm import alignment, wordcache
from assetflow.shared import stage

EMPTY = (0, 0, 0, 0, 0, 0, "")


def plain(rows):
    """doc_id and the columns of op13 by the tokenizers' own calls and sets of offsets."""
    a = Tokenizer.from_file(public_tokenizers.path(alignment.BYTE_LEVEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.PIECES))
    with open(public_tokenizers.path(alignment.PIECES), "rb") as file:
        of_a, of_b = alignment.token_bytes(open(public_tokenizers.path(alignment.BYTE_LEVEL)).read(), file.read())
    made = []
    for doc_id, text in rows:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        spelt = [b"".join(of[i] for i in ids) for of, ids in ((of_a, a_ids), (of_b, b_ids))]
        if not text or any(s != (" " + text).encode() for s in spelt):
            made.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((of_a, a_ids), (of_b, b_ids)))
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({*a_ends} & {*b_ends}):
            to_i, to_j = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a_ids[i:to_i], b_ids[j:to_j]))
            links.append((a_ids[to_i - 1], b_ids[to_j - 1]))
            i, j = to_i, to_j
        made.append((doc_id, a_ids, b_ids, groups, links))
    counts = Counter(pair for row in made for pair in row[4])
    best = defaultdict(int)
    for (_, b_id), n in counts.items():
        best[b_id] = max(best[b_id], n)
    out = []
    for doc_id, a_ids, b_ids, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id,
                len(a_ids),
                len(b_ids),
                len(groups),
                len(links),
                sum(counts[pair] == best[pair[1]] for pair in links),
                sum(counts[pair] for pair in links),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_edge_documents(spark, edge_dir, documents):
    got = alignment.op13_alignment(spark, edge_dir).select(*COLUMNS).collect()
    want = plain(documents)
    assert ordered(map(tuple, got)) == ordered(want)


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = alignment.op13_alignment(spark, folder).select(*COLUMNS).collect()
    want = plain([tuple(r) for r in rows])
    assert ordered(map(tuple, got)) == ordered(want)
    assert sum(r[3] for r in want) > 10_000


ODD = [
    "  two blanks  and\n\nlines \n and\ttabs ",
    "wide　　 blanks \x85 here\x0b x",
    "\x00 marks \x01 of \x02 all \x03 kinds ﷐ ﷑ end",
    "a ▁ real blank sign",
    "<s> <unk> <0x41> <|endoftext|>",
    "ﬁ é é 中文 字 👍🏽 ​ zero",
    "x" * 3000,
    " ",
    "\n",
    "ends in blanks  ",
    "ends in one ",
]


@pytest.mark.parametrize("remembered", [1, 500_000])
def test_odd_texts(spark, monkeypatch, remembered):
    monkeypatch.setattr(wordcache, "REMEMBERED_WORDS", remembered)
    monkeypatch.setattr(alignment, "PIECE_BYTES", 40)
    rows = [*enumerate(ODD), (None, ODD[0]), (0, ODD[0])]
    aligned = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    pairs = alignment.possible_pairs(*alignment.token_bytes(*alignment._load(None, None)))
    got = alignment.score(stage(aligned), pairs).collect()
    want = {tuple(r[:-1]): r[-1] for r in plain(rows)}
    assert {tuple(r[c] for c in COLUMNS[:-1]): hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in got} == want
    assert sum(r.n_groups == 0 for r in got) == 1  # only the text with a sign that B takes for a blank


def test_an_empty_table(spark, empty_dir):
    assert alignment.op13_alignment(spark, empty_dir).collect() == []


def test_null_and_empty_texts(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op13_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == [(1, *EMPTY), (2, *EMPTY)]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_of_random_ends(seed):
    """Dense, rare and one-sided shared ends, several texts side by side."""
    rng = np.random.default_rng(seed)
    a_ends, b_ends, starts, stops, base = [], [], [], [], 0
    for _ in range(5):
        size = int(rng.integers(1, 200))
        share = rng.choice([0.02, 0.5, 0.9])
        a = np.flatnonzero(rng.random(size) < share) + 1
        b = np.flatnonzero(rng.random(size) < rng.choice([0.02, 0.5, 0.9])) + 1
        if rng.random() < 0.5:  # shared ends at one side only
            b = b[b > size * 0.9]
        starts.append(len(a_ends))
        a_ends += [base + x for x in sorted({*a.tolist(), size})]
        b_ends += [base + x for x in sorted({*b.tolist(), size})]
        stops.append(len(a_ends))
        base += size
    got = alignment.shared_cuts(np.array(a_ends), np.array(b_ends), np.array(starts), np.array(stops))
    assert got.tolist() == [e in set(b_ends) for e in a_ends]


def test_pairs_that_can_end_together():
    of_a, of_b = [b"a", b"ba", b"c"], [b"a", b"cba", b"b"]
    pairs = alignment.possible_pairs(of_a, of_b)
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    counts = np.array([2, 3, 2, 1])
    assert alignment.highest_of_b(pairs, counts).tolist() == [True, True, True, False]
