"""Models: held-out accuracy, proper probabilities, and what the contracts fix, by hand."""

import math
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from assetflow.llm import htmltree, langmodel, toxicity, urlrules
from assetflow.shared import stage


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "\0end"]


# Toxicity


@pytest.fixture(scope="module")
def chain(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/labelled.parquet")
    train = docs.where("doc_id < 1300")
    return toxicity.fit(train, spark.read.parquet(f"{edge_dir}/labels.parquet"))


def test_held_out_toxicity(spark, edge_dir, chain):
    docs = spark.read.parquet(f"{edge_dir}/labelled.parquet").where("doc_id >= 1300")
    labels = pq.read_table(f"{edge_dir}/labels.parquet").to_pydict()
    truth = dict(zip(labels["doc_id"], labels["toxic"], strict=True))
    rows = toxicity.score(docs, chain).collect()
    assert len(rows) == 100
    assert sum(r.is_toxic != bool(truth[r.doc_id]) for r in rows) <= 2
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.is_toxic}


def test_later_categories_see_earlier_probabilities(chain):
    assert chain.categories == ["low_quality", "toxic", "severe"]
    assert [len(e) for e in chain.earlier] == [0, 1, 2]
    p = chain.probabilities([set()])
    altered = toxicity.Chain(**{**chain.__dict__, "earlier": [chain.earlier[0], chain.earlier[1], np.array([5.0, 0.0])]})
    assert altered.probabilities([set()])[2] > p[2] or chain.earlier[2][0] > 5


def test_edge_documents_are_scored(spark, edge_dir, empty_dir):
    rows = toxicity.op1_toxicity(spark, edge_dir).collect()
    assert len(rows) == pq.read_table(f"{edge_dir}/documents.parquet").num_rows
    assert not any(r.toxic for r in rows)  # one labelled document, which is clean
    assert toxicity.op1_toxicity(spark, empty_dir).count() == 0


def test_stems_are_features():
    assert toxicity.features_of("lowering") == ["lowering", "low*", "lowe*", "lower*", "loweri*", "lowerin*"]


def test_gradient_of_the_linear_model():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 4, 40)
    sample = toxicity._Sample(rng.integers(0, 6, sizes.sum()), sizes, np.zeros(40), np.zeros((1, 40), bool))
    y = (sample.dot(np.array([2.0, -1, 0, 0, 0, 0])) > 0.5)
    theta = toxicity._fit_linear(sample, np.zeros((0, 40)), y, np.ones(40, bool), 6)
    guess = sample.dot(theta[:6]) + theta[-1] > 0
    assert (guess == y).all()


# Language model


def by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2:
            counts.update(words_of(text))
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        words = words_of(text)
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        out.append((doc_id, held, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    return out


def test_base_score_of_edge_documents(spark, edge_dir, documents):
    rows = langmodel.op4_pitman_yor(spark, edge_dir).collect()
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(found, key=str) == sorted(by_hand(documents), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_no_documents_to_score(spark, empty_dir):
    assert langmodel.op4_pitman_yor(spark, empty_dir).count() == 0


def test_contexts_help_on_held_out_text(spark):
    rng = random.Random(2)
    follow = {a: rng.sample("kala mela nilo pora suta rive tomu vano".split(), 2) for a in "kala mela nilo pora suta rive tomu vano".split()}
    rows = []
    for i in range(300):
        word, text = "kala", []
        for _ in range(40):
            word = rng.choice(follow[word])
            text.append(word)
        rows.append((i, " ".join(text)))
    found = langmodel.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def test_whole_words_are_contexts(spark):
    """Words of one ending, each with a word that follows it: their endings tell nothing."""
    rng = random.Random(4)
    follow = {f"{a}{b}ing": f"{b}{a}er" for a in "bdfgk" for b in "lmnpr"}
    rows = []
    for i in range(300):
        words = [rng.choice(sorted(follow)) for _ in range(40)]
        rows.append((i, " ".join(f"{w} {follow[w]}" for w in words)))
    found = langmodel.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.9


def test_pairs_of_a_piece_are_a_word_after_a_word():
    piece = langmodel._Piece(langmodel.Hasher(), [b"making it", b"taking it", None])
    after = piece.ending == ord("n") * 256 + ord("g")
    assert after.sum() == 2 and len(set(piece.word_of[after].tolist())) == 1
    assert len(set(piece.context[after].tolist())) == 2
    assert len(piece.context) == 2 + 2 + 1 + 1


def model(texts):
    """A part that holds all words of some texts, after some sweeps, and its totals."""
    piece = langmodel._Piece(langmodel.Hasher(), [t.encode() for t in texts])
    per_word = np.bincount(piece.word_of, minlength=len(piece.words))
    part = langmodel._Part(piece.words, per_word, piece.ending.astype(np.uint16), piece.count(np.ones(len(texts), bool)))
    seats = part.start()

    def totals(discounts=None):
        keys, values = langmodel._totals_of(part, seats)
        dense = np.zeros(langmodel._ONCE + 6, np.int64)
        dense[keys] = values
        return langmodel._totals(dense, discounts)

    now = totals()
    rng = np.random.default_rng(5)
    for _ in range(30):
        part.sweep(seats, now, rng)
        now = totals(now.discounts)
    return part, seats, now


def test_seating_stays_consistent_and_probabilities_add_up():
    rng = random.Random(1)
    part, seats, totals = model([" ".join(rng.choice("aa ab bb ba cd dc".split()) for _ in range(60)) for _ in range(20)])
    top, middle, bottom = seats
    assert (bottom.customers == part.counts).all()
    assert (middle.customers == np.bincount(part.parent, bottom.tables, len(part.middle))).all()
    assert (top.customers == np.bincount(part.middle_word, middle.tables, len(part.words))).all()
    for tables in seats:
        assert (tables.size > 0).all() and tables.tables.sum() == len(tables.size)
        dish = np.repeat(np.arange(len(tables.tables)), tables.tables)
        assert (np.bincount(dish, tables.size) == tables.customers).all()
    assert bottom.tables.max() > 1  # more than the one table of the start

    p_top, p_middle = part.shares(seats, totals)
    unknown = totals.share(0, 0, 0, 1 / (totals.n_words + 1))
    assert p_top.sum() + unknown == pytest.approx(1)
    for last in np.unique(part.last):
        parent = totals.share(1, 0, 0, np.append(p_top, unknown), last)
        here = part.last == last
        parent[part.middle_word[here]] = p_middle[here]
        assert parent.sum() == pytest.approx(1)
        for ending in np.unique(part.ending[part.ending % 256 == last]):
            p = totals.share(2, 0, 0, parent, ending)
            own = part.ending == ending
            p[part.word_of[own]] = totals.share(2, bottom.customers[own], bottom.tables[own], parent[part.word_of[own]], ending)
            assert p.sum() == pytest.approx(1)


def test_gibbs_agrees_with_the_exact_distribution_of_tables():
    """One dish of four customers in one restaurant: the share of each number of tables."""
    theta, discount, parent = 1.0, 0.5, 0.3
    rng = np.random.default_rng(3)
    tables = langmodel._Tables(np.ones(4000, np.int64), np.full(4000, 4))
    everyone = np.arange(4000)
    for _ in range(60):
        tables.remove(everyone, rng)
        tables.add(everyone, (theta + discount * tables.tables) * parent, discount, rng)
    # Seatings of 4 customers at t tables, weighed by the process.
    ways = {}

    def seat(left, sizes, weight):
        if not left:
            ways[len(sizes)] = ways.get(len(sizes), 0) + weight
            return
        seat(left - 1, [*sizes, 1], weight * (theta + discount * len(sizes)) * (parent if sizes else 1))
        for i, n in enumerate(sizes):
            seat(left - 1, [*sizes[:i], n + 1, *sizes[i + 1 :]], weight * (n - discount))

    seat(4, [], 1.0)
    total = sum(ways.values())
    for n, weight in ways.items():
        assert (tables.tables == n).mean() == pytest.approx(weight / total, abs=0.03)


def mean_tables(customers, theta, discount, parent):
    """Exact mean number of tables of one dish alone in a restaurant."""
    t = np.arange(min(customers, 1000) + 2)
    weight = (t == 1).astype(float)  # of all seatings of the customers so far at t tables
    opening = (theta + discount * t) * parent
    for n in range(1, customers):
        joined, opened = weight * np.maximum(n - discount * t, 0), weight * opening
        weight = joined + np.concatenate([[0], opened[:-1]])
        weight /= weight.sum()
    return (weight * t).sum()


@pytest.mark.parametrize("customers, theta, discount, parent", [(2, 1, 0.9, 0.01), (4, 1, 0.5, 0.3), (60, 5, 0.7, 0.9), (60, 40, 0.7, 0.2), (300, 400, 0.3, 0.05)])
def test_a_sweep_reseats_every_customer(customers, theta, discount, parent):
    rng = np.random.default_rng(4)
    tables = langmodel._Tables(np.ones(3000, np.int64), np.full(3000, customers))
    opening, rise = np.full(3000, theta * parent), np.full(3000, discount * parent)
    counts = []
    for sweep in range(30):
        tables.reseat(opening, rise, discount, rng)
        assert (tables.customers == customers).all() and (tables._by_dish(tables.size) == customers).all()
        assert (tables.size > 0).all()
        if sweep >= 24:
            counts.append(tables.tables.mean())
    assert np.mean(counts) == pytest.approx(mean_tables(customers, theta, discount, parent), rel=0.02)


def test_frequent_pairs_get_the_tables_of_the_process():
    """A dish of 10,000 customers after the sweeps that a run has; one move a sweep made nine at most."""
    rng = np.random.default_rng(4)
    tables = langmodel._Tables(np.ones(100, np.int64), np.full(100, 10_000))
    for _ in range(langmodel.ROUNDS * langmodel.SWEEPS):
        tables.reseat(np.full(100, 70.0), np.zeros(100), 0.7, rng)
    assert tables.tables.mean() == pytest.approx(mean_tables(10_000, 70e9, 0.7, 1e-9), rel=0.1)


def test_taken_and_seated_customers_add_up():
    rng = np.random.default_rng(8)
    tables = langmodel._Tables(np.array([3, 1, 2]), np.array([5, 1, 4, 7, 2, 2]))
    tables.take(np.array([9, 0, 3]), rng)
    assert tables.customers.tolist() == [1, 7, 1] == tables._by_dish(tables.size).tolist()
    tables.grow(np.array([0, 40, 2]), np.full(3, 2.0), np.full(3, 0.1), 0.5, rng)
    assert tables.customers.tolist() == [1, 47, 3] == tables._by_dish(tables.size).tolist()


# Urls


def listed(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = []
    for rule, verdict in urlrules.RULES:
        rule_host, _, rule_path = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_listed_rules_by_hand(spark, edge_dir, empty_dir):
    pages = pq.read_table(f"{edge_dir}/pages.parquet").to_pydict()
    rows = urlrules.op5_url_rules(spark, edge_dir).collect()
    expected = []
    for page, url in zip(pages["page_id"], pages["url"], strict=True):
        host, path, rule, verdict = listed(url)
        expected.append((page, host, path, rule, verdict or "allow"))
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert urlrules.op5_url_rules(spark, empty_dir).count() == 0


def test_mined_rules_by_brute_force(spark):
    rng = random.Random(6)
    pages, labels = [], []
    for i in range(600):
        host, section = rng.choice(["good", "shop", "mail"]), rng.choice(["en", "win", "a"])
        pages.append((i, f"https://{host}.example.io/{section}/{i}", "x"))
        if i < 500:
            bad = host == "shop" and section == "win"
            labels.append((i, None, int(bad or rng.random() < 0.05)))
    found = urlrules.judge(
        spark.createDataFrame(pages, "page_id long, url string, verdict string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    for r in found:
        assert r.verdict == ("block" if r.host.startswith("shop") and r.path.startswith("/win/") else "allow")
    rules = {tuple(r.mined_rule) for r in found if r.mined_rule}
    assert rules == {("label:shop", "path:win")} or rules == {("host:shop.example.io", "path:win")}


def test_a_rule_may_need_five_tokens(spark):
    """Any four of the five are as often good as bad."""
    tokens = ["path:a", "path:b", "query:c", "query:d", "query:e"]
    sets = [(tokens, True)] + [([t for t in tokens if t != left], False) for left in tokens]
    labelled = spark.createDataFrame([s for s in sets for _ in range(30)], "tokens array<string>, bad boolean")
    rules = urlrules.mine(labelled).collect()
    assert [(r.rule, r.confidence) for r in rules] == [(tokens, 1.0)]
    seen = spark.createDataFrame([(tokens + ["path:z"],), (tokens[:4],)], "tokens array<string>")
    assert [r.tokens for r in urlrules.match(seen, urlrules.mine(labelled)).collect()] == [tokens + ["path:z"]]


def test_equal_urls_of_many_tokens_are_mined_at_once(spark):
    """Verdicts are those of all single tokens and pairs, which decide here."""
    rng = random.Random(3)
    hot = [f"path:h{i:02}" for i in range(40)] + ["scheme:https"]
    sets = [(hot, True)] * 40
    for _ in range(160):
        some = rng.sample([f"path:c{i}" for i in range(6)], 3) + ["scheme:https"]
        sets.append((some, {"path:c0", "path:c1"} <= set(some)))
    labelled = spark.createDataFrame(sets, "tokens array<string>, bad boolean")
    start = time.time()
    rules = stage(urlrules.mine(labelled), "rules")
    assert time.time() - start < 60
    seen = [["path:h07", "query:z"], ["path:h39", "path:h01", "path:c2"], ["path:c0", "path:c1"], ["path:c0"], ["scheme:https"], []]
    seen += [[t for t in tokens if rng.random() < 0.7] for tokens, _ in sets[30:]]
    seen = {tuple(sorted(s)) for s in seen}

    def share(part):
        marks = [bad for tokens, bad in sets if part <= set(tokens)]
        return sum(marks) / len(marks) if sum(marks) >= urlrules.MIN_URLS else 0.0

    def sure(tokens):
        known = [t for t in tokens if t in hot or t.startswith("path:c")]
        parts = [{a, b} for a in known for b in known]
        return max([share(p) for p in parts], default=0.0)

    frame = spark.createDataFrame([(list(s),) for s in seen], "tokens array<string>")
    found = {tuple(r.tokens): r for r in urlrules.match(frame, rules).collect()}
    for tokens in seen:
        best = sure(tokens)
        assert (tokens in found) == (best >= urlrules.MIN_CONFIDENCE), tokens
        if tokens in found:
            assert found[tokens].confidence == pytest.approx(best)
            assert set(found[tokens].mined_rule) <= set(tokens)
            assert share(set(found[tokens].mined_rule)) == pytest.approx(best)


def test_few_labels_give_no_rule(spark):
    pages = spark.createDataFrame([(i, "https://a.io/x") for i in range(10)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in urlrules.judge(pages, labels).collect()} == {"allow"}


# Pages


def test_main_text_of_edge_pages(spark, edge_dir, empty_dir):
    pages = pq.read_table(f"{edge_dir}/pages.parquet").to_pydict()
    rows = htmltree.op8_main_text(spark, edge_dir).collect()
    assert len(rows) == len(pages["page_id"])
    for r in rows:
        assert r.n_chars == len(r.text)
    text = {r.page_id: r.text for r in rows}
    lines = text[5].split("\n")
    assert lines[0] == "Title 5" and lines[-1] == "A & B <c> 5" and len(lines) == 4
    assert "Buy" not in text[5] and "Home" not in text[5]
    assert text[62] == "" and text[63] == ""
    assert len(text[69].split()) == 20_000
    assert htmltree.op8_main_text(spark, empty_dir).count() == 0


def tree(n, rng):
    elements = [htmltree.Element("html", -1, 0)]
    for _ in range(n - 1):
        parent = rng.randrange(len(elements))
        tag = rng.choice(["div", "p", "a", "nav", "article"])
        elements.append(htmltree.Element(tag, parent, elements[parent].depth + 1, [rng.choice(["ad", "main", "x"])], rng.randrange(50)))
    return elements


def test_messages_give_exact_marginals():
    rng = random.Random(3)
    theta = np.random.default_rng(3).normal(0, 1, htmltree.N_WEIGHTS)
    pages = [tree(7, rng), tree(1, rng), tree(5, rng)]
    forest = htmltree.Forest(pages)
    total, content, both = forest.infer(theta)
    scores = forest.scores(theta[: -3 * htmltree._KINDS])
    pair = np.concatenate([np.zeros((htmltree._KINDS, 1)), theta[-3 * htmltree._KINDS :].reshape(htmltree._KINDS, 3)], axis=1)
    pair = pair.reshape(htmltree._KINDS, 2, 2)
    n = len(forest.parent)
    weights, marginals = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        score = sum(scores[i] for i in range(n) if y[i])
        score += sum(pair[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
        weights += math.exp(score)
        marginals += np.array(y) * math.exp(score)
    assert total == pytest.approx(math.log(weights))
    assert content == pytest.approx(marginals / weights)
    child = forest.parent >= 0
    assert both[child].sum(axis=(1, 2)) == pytest.approx(np.ones(child.sum()))


def test_held_out_elements_are_told_apart():
    rng = random.Random(1)
    html = "<body><div class=top-nav><a>x y</a></div><article><h1>A b</h1><p>one two three four</p><ul><li>five six</li></ul></article><footer>f</footer>"
    elements, _ = htmltree.parse(html)
    labels = htmltree.labels_of(elements)
    train = [v for _ in range(40) for v in htmltree.variants(elements, labels, rng)]
    weights = htmltree.fit([t for t, _ in train], [m for _, m in train])
    test = [v for _ in range(10) for v in htmltree.variants(elements, labels, rng)]
    _, content, _ = htmltree.Forest([t for t, _ in test]).infer(weights)
    truth = np.array([x for _, m in test for x in m])
    assert ((content > 0.5) == truth).mean() > 0.97


def test_broken_markup():
    for page in ("", "<", "<<p>a<b", "</p></div>x", "<p a='>'>y</p>", "<script>if (a<b) '</div>'", "<!-- never closed <p>z", "<li>1<li>2<table><tr><td>3<td>4"):
        htmltree.parse(page)
    _, blocks = htmltree.parse("<ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table>")
    assert [t for _, t in blocks] == ["1", "2", "3", "4", "5"]
    _, blocks = htmltree.parse("<p>a<b>b<p>c</b>d&amp;e &#233;&nbsp;f<br>g")
    assert [t for _, t in blocks] == ["ab", "cd&e é f g"]


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<p title=it's>First</p><p>Second don't lose me</p><p>Third</p>", ["First", "Second don't lose me", "Third"]),
        ('<p class=a">First', ["First"]),
        ('<p class="x>First', ["First"]),
        ("<p class='x>y' id=z>First<p", ["First"]),
        ("a < b <c", ["a < b"]),
        ("<!-->a<!--->b<!-- x --!>c<!-- y >d", ["abcd"]),
        ("x</ foo>y</>z", ["xyz"]),
        ("<xmp>q</xmp><textarea>r</textareas></textarea>", ["q", "r</textareas>"]),
        ("<p>a</p><title>never closed <p>b", ["a"]),
    ],
)
def test_stray_quotes_and_open_markup(page, blocks):
    assert [t for _, t in htmltree.parse(page)[1]] == blocks


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>x" * 100_000, "<span>" * 50_000 + "<p>x" * 50_000, "<!--x>" * 150_000, '<a x="' * 150_000]
    + ["<a x='>" + '<a x=">t' * 75_001, "<body>" * 150_000, "<li>x" * 100_000, "</q>" * 200_000, "<" * 1_000_000],
)
def test_pages_of_broken_tags_and_deep_trees_take_linear_time(page):
    start = time.process_time()
    htmltree.extract_texts(np.zeros(htmltree.N_WEIGHTS), [page])
    assert time.process_time() - start < 15


def test_a_page_more_that_labels_itself_changes_no_text(spark):
    def labelled(n):
        return layouts(n)[2].replace("<div id=content>", "<article>", 1)

    others = [(100 + 10 * n + k, layouts(n)[k]) for n in range(4) for k in range(5)]
    texts = []
    for count in (19, 20):
        pages = spark.createDataFrame([(n, labelled(n)) for n in range(count)] + others, "page_id long, html string")
        found = htmltree.extract(pages, htmltree.train(pages)).collect()
        texts.append({r.page_id: r.text for r in found if r.page_id != 19})
    assert texts[0] == texts[1]
    for page, html in others:
        assert texts[0][page].split("\n") == [t for _, t in htmltree.parse(html)[1] if t.isupper()]


@pytest.mark.parametrize("body", ["<body><p>a<p>b</body>", "<p>a<p>b", "<div>a</div><div>b</div>", "</script>a<p>b", "<body>a<br>b"])
def test_a_head_without_its_end_tag(body):
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><noscript><img src=x>n</noscript>\n<template><p>t</p></template><script>var t</script>\n"
    elements, blocks = htmltree.parse(head + body)
    assert " ".join(t for _, t in blocks) == "a b"
    closed, same = htmltree.parse(head + "</head>" + body)
    assert [t for _, t in same] == [t for _, t in blocks] and [e.tag for e in closed] == [e.tag for e in elements]
    assert [e.depth for e in closed] == [e.depth for e in elements]


def layouts(n):
    """Pages without article or main elements, their words in capitals are the main text."""
    rng = random.Random(n)

    def prose(words):
        return " ".join(rng.choice("RIVER STONE HOUSE GREEN LETTER SUMMER".split()) for _ in range(words))

    menu = "<ul><li><a href=/>home</a></li><li><a href=/n>news</a></li><li><a href=/c>contact us</a></li></ul>"
    body = f"<h1>{prose(4)}</h1><p>{prose(50)}</p><p>{prose(70)}</p><p>{prose(60)}</p>"
    return [
        f"<html><head><title>T</title></head><body><div>{menu}</div><div>{body}</div><div>all rights <a href=/l>legal</a></div></body></html>",
        f"<html><body><table><tr><td><a href=/>home</a><br><a href=/n>news</a></td><td>{body}</td></tr></table></body></html>",
        f"<html><body><div id=nav>{menu}</div><div id=content>{body}</div><div class=footer>all rights</div></body></html>",
        f"<html><body><div>{menu}</div><div>{prose(80)}<br><br>{prose(90)}</div></body></html>",
        f"<p>{prose(60)}<p>{prose(40)}",
    ]


@pytest.mark.parametrize("kinds", [(0, 1, 2, 3, 4), (0,), (1,), (2,)])
def test_pages_that_do_not_label_themselves_keep_their_text(spark, kinds):
    rows = [(10 * n + k, layouts(n)[k]) for n in range(12) for k in kinds]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    found = {r.page_id: r.text for r in htmltree.extract(pages, htmltree.train(pages)).collect()}
    for page, html in rows:
        expected = [t for _, t in htmltree.parse(html)[1] if t.isupper()]
        assert found[page].split("\n") == expected, page
