"""Small tables with everything that is unusual: nulls, empty and long texts, ties, repeated rows,
columns that are called like results."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = (
    "the of and to in that was for with his this have from they which one you were all their water "
    "river stone house green letter summer winter garden market window bridge forest music paper "
    "table silver morning evening train island mountain street kitchen teacher doctor picture story"
).split()


def prose(rng, n):
    out = []
    for i in range(n):
        word = rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.3 else "")
        out.append(word.capitalize() + "," if rng.random() < 0.1 else word)
        out.append("\n" if i % 17 == 16 else " ")
    return "".join(out).strip()


def bench_texts():
    rng = random.Random(7)
    return [prose(rng, 30), prose(rng, 12), "Very short Item", "", None, "...", prose(rng, 10)]


def document_texts():
    rng = random.Random(3)
    base = prose(rng, 200)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:60], *prose(rng, 140).split(" ")])
    bench = bench_texts()
    line = prose(rng, 12).replace("\n", " ")
    return [
        base,
        base,
        near,
        base.upper(),
        far,
        None,
        "",
        "   \n\t ",
        "...!!! ???",
        "one two",
        "One  two",
        "one two three four five",
        "ünïcode Ünïcode straße STRASSE İstanbul Σίσυφος e\u0301te\u0301 \u4e2d\u6587 👍🏽 don't we'll it's 123",
        "a <|endoftext|> b<|startoftext|>c",
        prose(rng, 60) + " " + bench[0].upper() + " " + prose(rng, 60),
        prose(rng, 60) + "\n" + bench[1].replace(" ", ",  ") + "\n" + prose(rng, 20),
        "say very SHORT, item again",
        "\n".join([line] * 9 + [prose(rng, 60)]),
        "spam ham " * 80,
        " ".join(w + "###" for w in prose(rng, 80).split()),
        prose(rng, 30_000),
        "x" * 50_000,
        *[prose(rng, rng.randint(20, 120)) for _ in range(40)],
        "tab\tseparated\x0bwords\x0cand\rreturns\x1cnot\x85split",
    ]


def labelled_texts():
    """(text, toxic, quality): insults, and words of one stem with many endings."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        text, toxic, quality = prose(rng, rng.randint(30, 90)), i % 5 == 0, 1
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                bad = rng.choice(["idiot", "moron", "scum"]) if i % 2 else "zork" + rng.choice(WORDS)
                words.insert(rng.randrange(len(words)), bad)
            text = " ".join(words)
        if i % 7 == 0:
            text, quality = " ".join("junk" + w for w in text.split()), 0
        rows.append((text, int(toxic), quality))
    return rows


def _page(body):
    return (
        "<!DOCTYPE html><html lang='en'><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head>"
        "<body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        f"<div class='ad'>Buy this now.</div><article>{body}</article><footer>&copy; all of it</footer></body></html>"
    )


def page_rows():
    rng = random.Random(5)
    pages = [
        (i, f"https://www.{rng.choice(WORDS)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{i}?page=2#top",
         _page(f"<h1>Title {i}</h1><p><b>{prose(rng, 30)}<br><p>{prose(rng, 40)}</p><p>A &amp; B&nbsp;&lt;c&gt; {i}</p>"))
        for i in range(60)
    ]
    same = pages[3][2]
    return [
        *pages,
        (60, "http://example.NET/en/x", same),
        (61, "HTTP://Sub.Example.net:80?q=1", same),
        (61, "HTTP://Sub.Example.net:80?q=1", same),
        (62, None, None),
        (63, "no scheme here/path", ""),
        (64, "https://example.com/de", "short"),
        (65, "https://example.com/de/", "short"),
        (66, "https://a.org/fr/ b\r\nc", "<p>plain"),
        (None, "https://a.org/fr/", same),
        (67, "://x://net/en/", "<b"),
        (68, "https://notexample.net/en/z", "&amp"),
        (69, "https://example.net/en/", _page("<p>" + prose(rng, 20_000) + "</p>")),
    ]


def write(folder, name, columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def write_tables(folder, empty=False):
    texts = document_texts()
    labelled = labelled_texts()
    cut = (lambda x: x[:0]) if empty else (lambda x: x)
    ids = [*range(len(texts)), None, 3]
    all_texts = cut([*texts, "a text without an id", "another text of document three " * 3])
    n = len(all_texts)
    write(folder, "documents", {
        "doc_id": pa.array(cut(ids), pa.int64()),
        "text": pa.array(all_texts, pa.string()),
        "lang": pa.array([["en", "de", None][i % 3] for i in range(n)], pa.string()),
        "source": pa.array(["hot" if i % 3 else f"s{i % 7}" for i in range(n)], pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in all_texts], pa.int64()),
        **{c: pa.array([i % 2 for i in range(n)], pa.int64()) for c in (
            "kept", "n_words", "fp", "toxic", "ids", "n_tokens", "shard", "size", "held_out", "id", "part", "quality")},
    })
    rows = cut(labelled)
    write(folder, "labelled", {
        "doc_id": pa.array([1000 + i for i in range(len(rows))], pa.int64()),
        "text": pa.array([r[0] for r in rows], pa.string()),
    })
    write(folder, "labels", {
        "doc_id": pa.array(cut([*[1000 + i for i in range(len(rows))], None, 0]), pa.int64()),
        "quality": pa.array(cut([*[r[2] for r in rows], 1, None]), pa.int32()),
        "toxic": pa.array(cut([*[r[1] for r in rows], 1, 0]), pa.int32()),
        "text": pa.array(cut(["clash"] * (len(rows) + 2)), pa.string()),
    })
    bench = cut(bench_texts())
    write(folder, "benchmark", {
        "item_id": pa.array(cut([10, 9, 3, 4, 5, 6, None]), pa.int64()),
        "text": pa.array(bench, pa.string()),
        "n_words": pa.array([0] * len(bench), pa.int64()),
    })
    pages = cut(page_rows())
    write(folder, "pages", {
        "page_id": pa.array([p[0] for p in pages], pa.int64()),
        "url": pa.array([p[1] for p in pages], pa.string()),
        "html": pa.array([p[2] for p in pages], pa.string()),
        **{c: pa.array(["clash"] * len(pages), pa.string()) for c in ("text", "host", "id", "digest", "rule", "tokens")},
    })
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    return write_tables(tmp_path_factory.mktemp("empty"), empty=True)


@pytest.fixture(scope="session")
def documents(edge_dir):
    """(doc_id, text) of the edge documents, one row each."""
    table = pq.read_table(f"{edge_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return list(zip(table["doc_id"], table["text"], strict=True))
