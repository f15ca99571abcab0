"""Main text of web pages: a tree-structured graphical model over the DOM.

Every element is content or not. Its own look (tag, class and id words, text and link density)
gives a potential, and so does each pair of parent and child. Messages go from the leaves to the
root and back, which gives the exact probability of content for every element; a block of text
stays when that of its element is above one half. The weights are fitted by maximum likelihood on
a bounded sample of pages that label themselves by their sectioning elements; each is also used
with those elements turned into plain ones that only class words tell apart.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetflow.llm.batches import map_pieces
from assetflow.llm.optimize import minimize

# Bounds of the fit: pages of a sort, those with the least hashes of page_id; bytes of such a page;
# and made-up pages in old layouts, which are always added, so that plain pages are judged by more
# than the table happens to hold. Every page counts alike, whatever the table's size.
TRAIN_PAGES = 150
TRAIN_BYTES = 1 << 20
MADE_PAGES = 200
ITERATIONS = 150
REGULARIZATION = 2e-5

# Fixed values of HTML: elements without content, whose content is not markup, and that start and
# end a block of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_TEXT = frozenset("script style title iframe noembed noframes template head noscript".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption legend head script style title "
    "template noscript iframe noembed noframes textarea select option button".split()
)
_CLOSES_P = BLOCKS - frozenset("html body head script style title template noscript iframe button select option textarea".split())
# A start tag ends an open element of these names, up to an element that holds such children.
_ENDS = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
# What a head may hold; any other start tag ends an open head.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
TAGS = tuple(
    "article main section div p h1 h2 h3 h4 h5 h6 nav header footer aside form ul ol li dl dt dd table tr td "
    "th blockquote pre figure figcaption body html head a b span button select label address "
    "details dialog menu fieldset textarea".split()
)
# Words of class, id and role that hint at what an element is for.
CUES = {
    "content": "article content contents post entry main story body text blog prose page hentry copy",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs links",
    "header": "header masthead head banner topbar logo branding",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail related recommended popular trending widget widgets complementary",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion commercial",
    "form": "form search login register contact feedback",
    "comment": "comment comments commentlist reply replies discussion disqus respond response responses review reviews",
    "share": "share sharing social follow tags meta byline",
}
_CUE_OF = {word: cue for cue, words in CUES.items() for word in words.split()}
_DEEP_CUES = tuple(CUES)

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN_TAG = re.compile(r"[^>\"']*+>")
# An attribute's name, which may begin with =, and the = before its value.
_NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+(=)\s*+)?")
_UNQUOTED = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_CUE_ATTRIBUTES = ("class", "id", "role")
_CUE_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WITHOUT_VALUE = re.compile(r"[^=]*+")


def _end_of_tag(page: str, at: int) -> tuple[int, list[tuple[str, str]]] | None:
    """(end, attributes) of a tag whose name ends at ``at``; null when the page ends in it.

    A quote opens a value only right after the equals sign. One that is never closed is taken for a
    part of the value, so that its tag ends at the next >.
    """
    plain = _PLAIN_TAG.match(page, at)
    if plain and _WITHOUT_VALUE.fullmatch(page, at, plain.end()):
        return plain.end(), []
    attributes = []
    while True:
        name = _NAME.match(page, at)
        at = name.end()
        value = ""
        if name[2]:
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                found = _UNQUOTED.match(page, at)
                value, at = found[0], found.end()
        if name[1]:
            attributes.append((name[1].lower(), value))
        if at >= len(page):
            return None
        if page[at] == ">":
            return at + 1, attributes


def _markup(page: str):
    """The page as ("text", text), ("open", tag, attributes, self-closing) and ("close", tag).

    Read once from left to right, in time linear in its length. As in browsers, a tag or comment-like
    markup that the page ends in is dropped; a comment that is never closed ends at the next >.
    """
    at, start, comments_end = 0, 0, True
    while (mark := page.find("<", at)) >= 0:
        follows = page[mark + 1 : mark + 2]
        tag = _TAG.match(page, mark + 1)
        if not tag and not (follows in ("!", "?") and follows or page.startswith("</", mark)):
            at = mark + 1
            continue
        if mark > start:
            yield "text", page[start:mark]
        if tag:
            found = _end_of_tag(page, tag.end())
            if found is None:
                return
            start = at = found[0]
            name = tag[2].lower()
            if tag[1]:
                yield "close", name
                continue
            yield "open", name, found[1], page[at - 2] == "/"
            if name in RAW:
                end = _RAW_END[name].search(page, at)
                start = at = end.start() if end else len(page)
                if name in ("textarea", "xmp"):
                    yield "text", page[found[0] : at]
            continue
        end = None
        if comments_end and page.startswith("<!--", mark):
            if page.startswith((">", "->"), mark + 4):
                end = page.index(">", mark)
            else:
                closed = _COMMENT_END.search(page, mark + 4)
                comments_end = closed is not None
                end = closed.end() - 1 if closed else None
        end = page.find(">", mark) if end is None else end
        if end < 0:
            return
        start = at = end + 1
    if start < len(page):
        yield "text", page[start:]


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    names: list[str] = field(default_factory=list)
    words: int = 0  # of its own text, inline elements included
    link_words: int = 0
    links: int = 0
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """(elements in page order, blocks as (element, text)). Text of inline elements belongs to the
    nearest block element around them. Takes time in proportion to the page's length."""
    elements = [Element("html", -1, 0)]
    stack, blocks, run = [0], [], []
    owner = [0]  # the block element of each open element
    places: dict[str, list[int]] = {}  # where on the stack elements of a tag are
    silent = 0  # open elements whose text is never shown
    seen = set()

    def flush():
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((owner[-1], text))
            elements[owner[-1]].words += text.count(" ") + 1

    def close(down_to: int):
        nonlocal silent
        while len(stack) > down_to:
            tag = elements[stack[-1]].tag
            if tag in BLOCKS:
                flush()
            if len(stack) > 1:
                places[tag].pop()
                silent -= tag in NEVER_TEXT
            stack.pop()
            owner.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_open(names: str, limits: tuple[str, ...]):
        place = last(names.split())
        if place > last(limits):
            close(place)

    def end_head():
        # Not from inside of its template or noscript, which hold what they like.
        if elements[stack[-1]].tag == "head":
            close(len(stack) - 1)

    def take(text: str):
        if not text.isspace():
            end_head()
        if silent:
            return
        run.append(text)
        if places.get("a"):
            elements[owner[-1]].link_words += len(text.split())

    for kind, *what in _markup(page):
        if kind == "text":
            take(what[0])
            continue
        tag = what[0]
        if kind == "close":
            if place := last((tag,)):
                close(place)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag not in _IN_HEAD:
            end_head()
        if tag == "html" or (tag == "body" and tag in seen):
            continue
        if tag in _CLOSES_P:
            close_open("p", ("td", "th", "button", "table", "article", "div", "section"))
        if tag in _ENDS:
            close_open(*_ENDS[tag])
        if tag in BLOCKS:
            flush()
        names = [w.lower() for a, v in what[1] if a in _CUE_ATTRIBUTES for w in _CUE_WORD.findall(v)]
        if tag in VOID:
            continue
        elements.append(Element(tag, stack[-1], len(stack), names))
        seen.add(tag)
        if tag == "a":
            elements[owner[-1]].links += 1
        if not what[2] or tag in RAW:
            number = len(elements) - 1
            places.setdefault(tag, []).append(len(stack))
            stack.append(number)
            owner.append(number if tag in BLOCKS else owner[-1])
            silent += tag in NEVER_TEXT
    close(0)
    return elements, blocks


_FEATURES = (
    [f"tag {t}" for t in TAGS]
    + ["tag other"]
    + [f"cue {c}" for c in CUES]
    + [f"under {c}" for c in _DEEP_CUES]
    + "words0 words1-3 words4-12 words13-40 words41 links0 links1 links2-4 links5 dense link-only depth0 depth1 depth2-3 depth4".split()
    + ["bias"]
)
_AT = {name: i for i, name in enumerate(_FEATURES)}
_TAG_CUE = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form"}
# Pairs of parent and child are told apart by what the child is.
_KINDS = 3
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())


def _step(value: int, ends: tuple[int, ...], names: tuple[str, ...]) -> str:
    return names[sum(value > e for e in ends)]


def describe(elements: list[Element]) -> tuple[list[list[int]], list[int]]:
    """(features of each element, kind of its link to the parent)."""
    features, kinds, cues_above = [], [], []
    for e in elements:
        cues = {c for n in e.names if (c := _CUE_OF.get(n))}
        if e.tag in _TAG_CUE:
            cues.add(_TAG_CUE[e.tag])
        above = cues_above[e.parent] if e.parent >= 0 else frozenset()
        cues_above.append(above | cues)
        found = [_AT.get(f"tag {e.tag}", _AT["tag other"]), _AT["bias"]]
        found += [_AT[f"cue {c}"] for c in cues]
        found += [_AT[f"under {c}"] for c in above]
        found.append(_AT[_step(e.words, (0, 3, 12, 40), ("words0", "words1-3", "words4-12", "words13-40", "words41"))])
        found.append(_AT[_step(e.links, (0, 1, 4), ("links0", "links1", "links2-4", "links5"))])
        if e.words and e.link_words >= e.words:
            found.append(_AT["link-only"])
        elif e.words and 3 * e.link_words > e.words:
            found.append(_AT["dense"])
        found.append(_AT[_step(e.depth, (0, 1, 3), ("depth0", "depth1", "depth2-3", "depth4"))])
        features.append(found)
        kinds.append(1 if e.tag in _TEXT_TAGS else 0 if e.tag in BLOCKS else 2)
    return features, kinds


class Forest:
    """The elements of several pages as arrays; messages go over all trees at once, by depth."""

    def __init__(self, pages: list[list[Element]]):
        parents, depths, kinds, flat, sizes = [], [], [], [], []
        for elements in pages:
            first = len(parents)
            described, own_kinds = describe(elements)
            parents += [e.parent + first if e.parent >= 0 else -1 for e in elements]
            depths += [e.depth for e in elements]
            kinds += own_kinds
            sizes += map(len, described)
            flat += [i for d in described for i in d]
        self.parent = np.array(parents, np.int64)
        self.kind = np.array(kinds, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.flat = np.array(flat, np.int64)
        depth = np.array(depths, np.int64)
        ends = np.cumsum(np.bincount(depth, minlength=1))
        self.levels = np.split(np.argsort(depth, kind="stable"), ends[:-1])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(weights[self.flat])])
        ends = np.cumsum(self.sizes)
        return sums[ends] - sums[ends - self.sizes]

    def infer(self, theta: np.ndarray, pairs: bool = True):
        """(log Z, probability of content of each element, of each pair (parent, element) if asked)."""
        n_features = len(_FEATURES)
        pair = np.concatenate([np.zeros((_KINDS, 1)), theta[n_features:].reshape(_KINDS, 3)], axis=1)
        pair = pair.reshape(_KINDS, 2, 2)  # kind, parent's state, child's state
        belief = np.stack([np.zeros(len(self.parent)), self.scores(theta[:n_features])], axis=1)
        up = np.zeros_like(belief)
        for level in reversed(self.levels[1:]):
            up[level] = np.logaddexp.reduce(belief[level][:, None, :] + pair[self.kind[level]], axis=2)
            np.add.at(belief, self.parent[level], up[level])
        whole = belief.copy()
        both = np.zeros((len(self.parent) if pairs else 0, 2, 2))
        for level in self.levels[1:]:
            without = (whole[self.parent[level]] - up[level])[:, :, None] + pair[self.kind[level]]
            whole[level] = belief[level] + np.logaddexp.reduce(without, axis=1)
            if not pairs:
                continue
            joint = without + belief[level][:, None, :]
            both[level] = np.exp(joint - np.logaddexp.reduce(joint, axis=(1, 2), keepdims=True))
        total = np.logaddexp.reduce(belief[self.levels[0]], axis=1).sum()
        return total, np.exp(whole[:, 1] - np.logaddexp.reduce(whole, axis=1)), both


N_WEIGHTS = len(_FEATURES) + 3 * _KINDS


def fit(pages: list[list[Element]], labels: list[list[bool]]) -> np.ndarray:
    """Weights of greatest likelihood for pages with every element labelled."""
    forest = Forest(pages)
    y = np.array([v for own in labels for v in own], bool)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]].astype(int), y[child].astype(int)] = 1
    of_feature = np.repeat(np.arange(len(y)), forest.sizes)

    def loss_and_slope(theta):
        total, p, both = forest.infer(theta)
        n = len(y)
        gold = forest.scores(theta[: len(_FEATURES)])[y].sum()
        pair = np.concatenate([np.zeros((_KINDS, 1)), theta[len(_FEATURES) :].reshape(_KINDS, 3)], axis=1)
        gold += (seen[child] * pair.reshape(_KINDS, 2, 2)[forest.kind[child]]).sum()
        slope = np.bincount(forest.flat, (p - y)[of_feature], len(_FEATURES))
        pairs = np.zeros((_KINDS, 2, 2))
        np.add.at(pairs, forest.kind[child], both[child] - seen[child])
        slope = np.concatenate([slope, pairs.reshape(_KINDS, 4)[:, 1:].ravel()]) / n
        penalty = REGULARIZATION / 2 * theta @ theta
        return (total - gold) / n + penalty, slope + REGULARIZATION * theta

    return minimize(loss_and_slope, np.zeros(N_WEIGHTS), ITERATIONS)


_OUTSIDE = frozenset("nav header footer aside form menu dialog button select textarea".split()) | NEVER_TEXT


def labels_of(elements: list[Element]) -> list[bool] | None:
    """Content is what lies inside the page's article or main element but not in a menu, header and
    the like; null when the page has none or several."""
    for name in ("article", "main"):
        own = [i for i, e in enumerate(elements) if e.tag == name]
        if len(own) == 1:
            break
    else:
        return None
    return _inside(elements, own[0])


def labels_by_words(elements: list[Element]) -> list[bool] | None:
    """As ``labels_of`` with the only outermost element whose class, id or role names content and
    nothing else; null when there are none or several."""
    under, own = [], []
    for i, e in enumerate(elements):
        cues = {_CUE_OF.get(n) for n in e.names} - {None}
        hit = cues == {"content"} and e.tag in BLOCKS and e.tag not in ("html", "body") and e.tag not in _OUTSIDE
        above = e.parent >= 0 and under[e.parent]
        if hit and not above:
            own.append(i)
        under.append(hit or above)
    return _inside(elements, own[0]) if len(own) == 1 else None


def _inside(elements: list[Element], root: int) -> list[bool]:
    inside: list[bool] = []
    for i, e in enumerate(elements):
        cues = {_CUE_OF.get(n) for n in e.names}
        out = e.tag in _OUTSIDE or cues & {"advert", "comment", "notice", "share", "side", "menu"}
        inside.append(i == root or (e.parent >= 0 and inside[e.parent] and not out))
    return inside


def variants(elements: list[Element], labels: list[bool], rng: random.Random) -> list[tuple[list[Element], list[bool]]]:
    """The page as it is; with plain elements told apart by class words; with further boilerplate;
    and each of these with little left of the content."""

    def copied(e: Element, **changes) -> Element:
        return Element(**({k: getattr(e, k) for k in e.__dataclass_fields__} | changes))

    def word(cue: str) -> str:
        return rng.choice(CUES[cue].split())

    def plain() -> list[Element]:
        out = []
        for e in elements:
            cue = {"article": "content", "main": "content"}.get(e.tag) or _TAG_CUE.get(e.tag)
            if cue:
                e = copied(e, tag=rng.choice(["div", "div", "section"]), names=[word(cue)])
            out.append(e)
        return out

    def crowded(base: list[Element]) -> tuple[list[Element], list[bool]]:
        """Boilerplate of every sort, inside and outside of the content, long texts included; and
        lists, quotes, tables and the like in the content."""
        grown, marks = [copied(e) for e in base], list(labels)
        content = labels.index(True)
        outer = max(base[content].parent, 0)
        for shape in ("ul li", "ol li", "blockquote p", "table tr td", "figure figcaption", "div p", "section h2", "dl dd"):
            if rng.random() < 0.5:
                continue
            under = content
            for tag in shape.split():
                grown.append(Element(tag, under, grown[under].depth + 1))
                marks.append(True)
                under = len(grown) - 1
            for _ in range(rng.randint(1, 4)):
                words, linked = rng.choice([1, 3, 10, 30, 60]), rng.choice([0, 0, 0, 1])
                grown.append(Element(tag, grown[under].parent, grown[under].depth, [], words, linked * words // 4, linked))
                marks.append(True)
        for cue in (c for c in CUES if c != "content"):
            for under in (outer, content):
                if rng.random() < 0.5:
                    continue
                tag = rng.choice(["div", "section", "ul", "aside", "article" if cue == "comment" else "div"])
                grown.append(Element(tag, under, grown[under].depth + 1, [word(cue)]))
                marks.append(False)
                box = len(grown) - 1
                for _ in range(rng.randint(1, 4)):
                    words = rng.choice([2, 5, 15, 60])
                    links = rng.choice([0, 0, 1]) if cue != "menu" else 1
                    tag = rng.choice(["p", "div", "li", "h3", "article" if cue == "comment" else "p"])
                    grown.append(
                        Element(tag, box, grown[box].depth + 1, [], words, words * links, links)
                    )
                    marks.append(False)
        return grown, marks

    def thinned(base: list[Element], marks: list[bool]) -> tuple[list[Element], list[bool]]:
        """Without many of the content's leaves, so that no single sort of element has to be there."""
        parents = {e.parent for e in base}
        share = rng.choice([0.3, 0.9])
        left = [i for i in range(len(base)) if i in parents or not marks[i] or rng.random() > share]
        new = {old: i for i, old in enumerate(left)}
        return [copied(base[i], parent=new.get(base[i].parent, -1)) for i in left], [marks[i] for i in left]

    full = [(elements, labels), (plain(), labels), crowded(elements), crowded(plain())]
    return full + [thinned(tree, marks) for tree, marks in full]


def made_pages(count: int, rng: random.Random) -> list[tuple[list[Element], list[bool]]]:
    """Labelled pages in layouts of plain div and table elements, without a class word or a
    sectioning element, whose text is in paragraphs or right in the layout's element."""

    def words(lo: int, hi: int) -> str:
        return " ".join(["word"] * rng.randint(lo, hi))

    def links(lo: int, hi: int, around: str = "") -> str:
        made = [f"<a>{words(1, 6)}</a>" for _ in range(rng.randint(lo, hi))]
        return "".join(f"<{around}>{m}</{around}>" for m in made) if around else rng.choice([" | ", "<br>"]).join(made)

    def menu() -> str:
        return rng.choice([links(2, 8), f"<ul>{links(2, 8, 'li')}</ul>", f"<p>{links(2, 8)}</p>", f"<h3>{words(1, 3)}</h3>{links(3, 9, 'p')}"])

    def text() -> str:
        some = [words(8, 120) + rng.choice(["", "", f" <a>{words(1, 3)}</a> " + words(2, 9)]) for _ in range(rng.randint(1, 8))]
        more = rng.choice(["", "", f"<ul><li>{words(3, 15)}<li>{words(3, 15)}</ul>", f"<blockquote><p>{words(8, 40)}</p></blockquote>"])
        title = rng.choice(["", "", f"<h1>{words(2, 9)}</h1>", f"<h2>{words(2, 9)}</h2>"])
        kind = rng.choice(["p", "p", "div", ""])
        return title + ("".join(f"<{kind}>{t}</{kind}>" for t in some) if kind else "<br><br>".join(some)) + more

    def page() -> tuple[str, str]:
        foot = rng.choice([words(3, 9), words(2, 5) + " " + links(1, 3), links(2, 5), f"{words(1, 12)} <a>{words(1, 1)}</a>"])
        if rng.random() < 0.3:  # all of it right in the body
            if rng.random() < 0.5:
                return "html", text()
            menus = [rng.choice(["", f"<nav>{m}</nav>"]) for m in (menu(), foot)]
            return "body", f"<article>{menus[0]}{text()}{menus[1]}</article>"
        if rng.random() < 0.5:
            around = "<div>", "</div>"
            shape = "div", f"<div>{words(1, 4)}</div><div>{menu()}</div>%s<div>{menu()}</div><div>{foot}</div>"
        else:
            around = "", ""
            shape = "td", f"<table><tr><td>{menu()}</td>%s<td>{menu()}</td></tr></table><p>{foot}</p>"
        if rng.random() < 0.3:
            shape = shape[0], shape[1].replace(f"<div>{words(1, 4)}</div>", "", 1)
        wrapped = shape[1] % f"<article>{text()}</article>"
        return shape[0], "<body>" + (around[0] + wrapped + around[1] if rng.random() < 0.5 else wrapped)

    out = []
    for _ in range(count):
        tag, html = page()
        elements, _ = parse(html)
        labels = labels_of(elements) or [True] * len(elements)
        for e in elements:
            e.tag = {"article": tag, "nav": "div"}.get(e.tag, e.tag)
        out.append((elements, labels))
    return out


def train(pages: DataFrame) -> np.ndarray:
    """Weights from bounded samples of the pages that label themselves and of those that class words
    label, and from made-up pages. All three are always taken, so no count of pages changes the way."""

    def sample(of: DataFrame):
        small = of.where(F.octet_length("html") <= TRAIN_BYTES)
        least = (
            small.select("page_id", F.xxhash64("page_id").alias("h"))
            .orderBy("h", "page_id")
            .limit(TRAIN_PAGES)
            .select("page_id")
            .distinct()
        )
        chosen = small.select("page_id", "html").join(F.broadcast(least), "page_id").dropDuplicates(["page_id"])
        return chosen.orderBy("page_id").collect()

    trees, labels = [], []
    rng = random.Random(11)

    def learn(rows, labelled):
        for row in rows:
            elements, _ = parse(row["html"])
            own = labelled(elements)
            if own is not None:
                for tree, marks in variants(elements, own, rng):
                    trees.append(tree)
                    labels.append(marks)

    sectioned = F.col("html").rlike(r"(?i)<(article|main)[\s>]")
    learn(sample(pages.where(sectioned)), labels_of)
    learn(sample(pages.where(~sectioned)), labels_by_words)
    for elements, own in made_pages(MADE_PAGES, rng):
        trees.append(elements)
        labels.append(own)
    return fit(trees, labels)


def extract_texts(weights: np.ndarray, pages: list[str]) -> list[tuple[str, list[tuple[str, float]]]]:
    """(main text, every block with its element's probability of content) of each page."""
    parsed = [parse(p) for p in pages]
    _, content, _ = Forest([elements for elements, _ in parsed]).infer(weights, pairs=False)
    out, first = [], 0
    for elements, blocks in parsed:
        scored = [(text, float(content[first + i])) for i, text in blocks]
        out.append(("\n".join(text for text, p in scored if p > 0.5), scored))
        first += len(elements)
    return out


def extract(df: DataFrame, weights: np.ndarray, html: str = "html") -> DataFrame:
    """Columns of ``df`` but ``html``, then ``text`` and ``n_chars``; pages are read one by one.

    Null and empty pages, and pages without a content block, have an empty text. A column of
    ``df`` named like a result must be left out before the call.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def run(pages):
            texts = [t for t, _ in extract_texts(shared.value, [p.decode() if p else "" for p in pages])]
            return [texts, [len(t) for t in texts]]

        return run

    return map_pieces(df, html, make, schema)


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages))
