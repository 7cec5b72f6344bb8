"""HTML main-text extraction by a linear-chain CRF over DOM leaf blocks (operator 1).

A page is cut into leaf blocks: runs of text between block-level tags, each with its open elements. Features of ancestor tags, their
class and id words, and the text feed a linear-chain conditional random field with two labels, trained on labelled pages
and decoded by Viterbi. The blocks labelled content are the text.
"""

from __future__ import annotations

import functools
import html
import re
import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head title textarea svg iframe canvas audio video annotation annotation-xml".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
#: Block-level elements; all others, unknown and custom ones too, are inline.
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section "
    "summary table tbody td template tfoot th thead title tr ul xmp".split()
)
#: Inline controls: their text is a block of its own, without a cut in the text around them.
CONTROLS = set("button select".split())
OPTIONS = set("option optgroup".split())
#: What may stand in a head; any other start tag, or text, ends an open one.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Words of a class or id that name a part of a page; one feature for each.
PARTS = (
    "ad ads advert advertisement article author banner body breadcrumb byline caption comment comments content cookie consent copyright "
    "disqus entry footer foot form header head hero legal main masthead menu meta nav navbar navigation newsletter notice page pagination "
    "popup post promo recommended related reply response search share sharing sidebar side social sponsor sponsored story subscribe tag tags "
    "text toolbar topbar trending warning widget"
).split()
HASHED = 256
#: The bounds of the sample that the CRF is trained on: pages, and characters of one. Longer pages are not drawn; all are decoded.
SAMPLE_PAGES, SAMPLE_CHARS = 300, 200_000
#: Blocks of a training chain: longer pages are cut into several chains, all of which count.
CHAIN = 120
EPOCHS = 150
MARK = ""  # of private use: never in a page's own text

#: A whole tag by the standard's rules for attributes; possessive, so that it is read once.
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>)))?+|=)*+)>"""
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[a-z]+")
#: A start tag that ends an open paragraph or list item, as the HTML standard has it.
_CLOSES = {t: ("p",) for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_CLOSES |= {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = set("article aside body dl div footer form header main nav ol section table td th ul select".split())
#: Elements that an end tag does not reach out of.
_BARRIERS = set("caption html object table td template th".split())
_IN_TABLE = set("table tbody td tfoot th thead tr caption html body".split())


class Element:
    """An open element: tag, words of class, id and role, and the block element around it."""

    __slots__ = ("tag", "words", "parent", "features")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Element | None):
        self.tag, self.words, self.parent, self.features = tag, words, parent, None

    def up(self):
        e = self
        while e is not None:
            yield e
            e = e.parent


class Block:
    """A leaf block: its text, its innermost block-level element (None outside of all), how many characters are links."""

    __slots__ = ("text", "element", "linked", "begin")

    def __init__(self, text: str, element: Element | None, linked: int, begin: int):
        self.text, self.element, self.linked, self.begin = text, element, linked, begin

    @property
    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        return [(e.tag, e.words) for e in self.element.up()][::-1] if self.element else []


class _Run:
    """Text of a block that is still open."""

    __slots__ = ("parts", "linked", "element", "begin")

    def __init__(self):
        self.parts: list[str] = []
        self.linked, self.element, self.begin = 0, None, -1


class _Reader:
    """Reads a page once, in time linear in its length: open elements are found by their tags' own stacks of places."""

    def __init__(self):
        self.out: list[Block] = []
        self.late: list[Block] = []
        self.stack: list[tuple[str, Element | None]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block-level elements, of scopes and of barriers
        self.scopes: list[int] = []
        self.barriers: list[int] = []
        self.hidden = self.anchors = self.controls = 0
        self.main, self.control = _Run(), _Run()

    def take(self, run: _Run, to: list[Block]) -> None:
        if run.parts:
            text = " ".join("".join(run.parts).split())
            if text:
                to.append(Block(text, run.element, run.linked, run.begin))
            run.__init__()

    def flush(self) -> None:
        self.take(self.control, self.late)
        self.take(self.main, self.late)
        if self.late:
            self.late.sort(key=lambda b: b.begin)
            self.out += self.late
            self.late = []

    def add(self, text: str, at: int) -> None:
        if not text:
            return
        blank = text.isspace()
        if self.stack and self.stack[-1][0] == "head" and not blank:
            self.close(len(self.stack) - 1)
        if self.hidden:
            return
        run = self.control if self.controls else self.main
        text = html.unescape(text) if "&" in text else text
        if run.begin < 0 and not blank:
            run.begin, run.element = at, self.around()
        run.parts.append(text)
        if self.anchors:
            run.linked += len(" ".join(text.split()))

    def around(self) -> Element | None:
        if self.controls:
            return next(e for _, e in reversed(self.stack) if e is not None)
        return self.stack[self.blocks[-1]][1] if self.blocks else None

    def open(self, tag: str, words: tuple[str, ...]) -> None:
        at, own = len(self.stack), None
        if tag in BLOCKS or tag in CONTROLS:
            own = Element(tag, words, self.stack[self.blocks[-1]][1] if self.blocks else None)
        self.stack.append((tag, own))
        self.places.setdefault(tag, []).append(at)
        for kinds, places in ((BLOCKS, self.blocks), (_SCOPE, self.scopes), (_BARRIERS, self.barriers)):
            if tag in kinds:
                places.append(at)
        self.hidden += tag in HIDDEN
        self.anchors += tag == "a"
        self.controls += tag in CONTROLS

    def close(self, k: int) -> None:
        for tag, _ in self.stack[k:]:
            self.places[tag].pop()
            self.hidden -= tag in HIDDEN
            self.anchors -= tag == "a"
            if tag in CONTROLS:
                self.controls -= 1
                if not self.controls:
                    self.take(self.control, self.late)
        del self.stack[k:]
        for places in (self.blocks, self.scopes, self.barriers):
            while places and places[-1] >= k:
                places.pop()

    def end(self, tag: str) -> None:
        if self.controls and tag in OPTIONS:
            self.take(self.control, self.late)
        elif tag in BLOCKS:
            self.flush()
        mine = self.places.get(tag)
        if not mine:
            return
        wall = self.barriers if tag in BLOCKS or tag in CONTROLS else self.blocks
        if wall and wall[-1] > mine[-1] and tag not in _IN_TABLE:
            return
        self.close(mine[-1])

    def start(self, tag: str, attributes: str, at: int) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.close(len(self.stack) - 1)
        if tag == "br":
            self.add(" ", at)
        if self.controls and tag in OPTIONS:
            self.take(self.control, self.late)
        elif tag in BLOCKS:
            if self.places.get("select"):
                self.close(self.places["select"][-1])  # one left open
            self.flush()
        if tag in _CLOSES:
            reach = max((self.places[t][-1] for t in _CLOSES[tag] if self.places.get(t)), default=-1)
            scopes = self.scopes
            while reach >= 0 and not (scopes and scopes[-1] > reach):
                self.close(reach)
                break
        if tag in VOID or (attributes.rstrip().endswith("/") and self.foreign()):
            return
        words = tuple(w for a in _ATTR.findall(attributes) for w in _WORD.findall(" ".join(a[1:]).lower())) if "=" in attributes else ()
        self.open(tag, words)

    def foreign(self) -> bool:
        """Inside svg or math, where ``/>`` ends an element."""
        return bool(self.places.get("svg") or self.places.get("math"))


@functools.lru_cache(maxsize=32)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def leaf_blocks(page: str | None) -> list[Block]:
    """The visible leaf blocks of a page in order: text with references decoded and white space made one space, and the open
    elements (tag, attribute words) around it. Broken markup is read as the standard reads it, as far as it goes: a tag or comment that
    never ends takes the rest of the page. Null has no blocks."""
    page, reader, at = page or "", _Reader(), 0
    while at < len(page):
        found = page.find("<", at)
        if found < 0:
            reader.add(page[at:], at)
            break
        reader.add(page[at:found], at)
        after = page[found + 1 : found + 3]
        if after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:].isalpha() and len(after) == 2):
            if page.startswith("<!--", found):
                stop = page.find("-->", found + 2)
                at = stop + 3 if stop >= 0 else len(page)
            elif page.startswith("<![CDATA[", found) and reader.foreign():
                stop = page.find("]]>", found)
                stop = stop if stop >= 0 else len(page)
                reader.add(html.escape(page[found + 9 : stop]), found)
                at = stop + 3
            else:
                stop = page.find(">", found)
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
            reader.add("<", found)
            at = found + 1
            continue
        m = _TAG.match(page, found)
        if not m:  # a tag without an end
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            reader.end(tag)
            continue
        reader.start(tag, m[3], found)
        if tag in RAW and reader.stack and reader.stack[-1][0] == tag:
            stop = _end_of(tag).search(page, at)
            if not stop:
                break
            at = stop.start()
    reader.flush()
    return reader.out


#: Feature numbers: a bias, text features, tags and parts of ancestors, hashed tags and words beyond those.
TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset details summary address".split()
_TEXT = 24
_OF_TAG = {t: _TEXT + i for i, t in enumerate(TAGS)}
_NEAREST = {t: _TEXT + len(TAGS) + i for i, t in enumerate(TAGS)}
_OF_PART = {w: _TEXT + 2 * len(TAGS) + i for i, w in enumerate(PARTS)}
FEATURES = _TEXT + 2 * len(TAGS) + len(PARTS) + HASHED
_NOTICE = re.compile(r"©|copyright|all rights reserved|cookie|privacy|subscribe|newsletter|sign up|log ?in|click here|advert|sponsored|terms of|share (?:this|on)|read more|related", re.I)


def _hashed(word: str) -> int:
    h = 2166136261
    for c in word.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return FEATURES - HASHED + h % HASHED


@functools.lru_cache(maxsize=20_000)
def _own_features(tag: str, words: tuple[str, ...]) -> frozenset[int]:
    return frozenset([_OF_TAG[tag] if tag in _OF_TAG else _hashed(tag), *(_OF_PART[w] if w in _OF_PART else _hashed(w) for w in words)])


def _features_of(element: Element | None) -> frozenset[int]:
    """The features of an element and all around it; those that add none share their parent's."""
    todo = []
    while element is not None and element.features is None:
        todo.append(element)
        element = element.parent
    found = element.features if element is not None else frozenset()
    for e in reversed(todo):
        own = _own_features(e.tag, e.words)
        found = found if own <= found else found | own
        e.features = found
    return found


def block_features(blocks: list[Block]) -> list[list[int]]:
    """The active features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        marks = b.text.count(".") + b.text.count(",") + b.text.count(";")
        ends = b.text[-1] in ".!?:;…\"”'"
        share = b.linked / max(n, 1)
        f = [0, min((words + 1).bit_length(), 9), 10 + (share > 0) + (share > 0.3) + (share > 0.7), 14 + ends, 16 + (i == 0), 18 + (i == len(blocks) - 1)]
        f += [20] * bool(n < 400 and _NOTICE.search(b.text)) + [21] * bool(_DIGIT.search(b.text)) + [22] * (n < 25) + [23] * (marks * 40 > n)
        if b.element:
            f.append(_NEAREST.get(b.element.tag, _hashed("<" + b.element.tag)))
        out.append(sorted({*f, *_features_of(b.element)}))
    return out


class Crf:
    """Linear-chain CRF with the labels 0 (other) and 1 (content)."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps  # features x 2, and 2 x 2 transitions

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in features]).reshape(-1, 2)

    def viterbi(self, features: list[list[int]]) -> np.ndarray:
        """The best labels; of equals the content label."""
        if not features:
            return np.zeros(0, dtype=np.int64)
        s = self.scores(features).tolist()
        t = self.steps.tolist()
        best, back = s[0], []
        for e in s[1:]:
            prev = [[best[a] + t[a][b] for a in (0, 1)] for b in (0, 1)]
            back.append([int(p[1] >= p[0]) for p in prev])
            best = [max(prev[b]) + e[b] for b in (0, 1)]
        labels = [int(best[1] >= best[0])]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return np.array(labels[::-1])

    def with_content(self, features: list[list[int]], able: list[bool]) -> np.ndarray:
        """The best labels among those with a content block, where only blocks that are ``able`` may be content; none if no block is."""
        if not any(able):
            return np.zeros(len(features), dtype=np.int64)
        s, t, none = self.scores(features).tolist(), self.steps.tolist(), float("-inf")
        # states: the label, and whether content has been met
        states = [(0, False), (0, True), (1, True)]
        best = {(0, False): s[0][0], (0, True): none, (1, True): s[0][1] if able[0] else none}
        back = []
        for e, free in zip(s[1:], able[1:], strict=True):
            now, choice = {}, {}
            for b, met in states:
                before = [(a, m) for a, m in states if (m or b == 1 if met else not m)]
                choice[b, met] = max(before, key=lambda st: best[st] + t[st[0]][b])
                now[b, met] = best[choice[b, met]] + t[choice[b, met][0]][b] + e[b] if b == 0 or free else none
            best = now
            back.append(choice)
        at = max(states[1:], key=lambda st: best[st])
        labels = [at[0]]
        for choice in reversed(back):
            at = choice[at]
            labels.append(at[0])
        return np.array(labels[::-1], dtype=np.int64)

    @staticmethod
    def train(pages: list[tuple[list[list[int]], np.ndarray]], epochs: int = EPOCHS, l2: float = 3e-4, rate: float = 0.3) -> Crf:
        """Maximum likelihood with an L2 penalty, by Adagrad on whole-sample gradients from forward-backward sums. A page of more than
        ``CHAIN`` blocks is several chains, so that the time and memory follow the number of blocks."""
        chains = [(f[k : k + CHAIN], y[k : k + CHAIN]) for f, y in pages for k in range(0, len(f), CHAIN)]
        chains.sort(key=lambda c: -len(c[0]))
        size = np.array([len(f) for f, _ in chains], dtype=np.int64)
        most, n, total = (int(size.max()) if len(size) else 0), len(chains), int(size.sum())
        # active features one after another, and the block of each; blocks lie in chains of equal length, padded
        active = np.array([x for f, _ in chains for block in f for x in block], dtype=np.int64)
        block = np.repeat(np.arange(total), [len(b) for f, _ in chains for b in f]) if total else active
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if total else active
        inside = np.arange(most) < size[:, None]
        y = np.zeros((n, most, 2))
        y[inside] = np.eye(2)[np.concatenate([labels for _, labels in chains])] if total else 0
        w, t = np.zeros((FEATURES, 2)), np.zeros((2, 2))
        gw2, gt2 = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
        pairs = inside[:, 1:].astype(float)
        seen_t = np.einsum("nka,nkb,nk->ab", y[:, :-1], y[:, 1:], pairs) if n else t
        weight = max(len(pages), 1)
        for _ in range(epochs if n else 0):
            e = np.zeros((n, most, 2))
            e[inside] = np.add.reduceat(w[active], first, axis=0)
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for k in range(1, most):
                step = np.logaddexp(alpha[:, k - 1, 0, None] + t[0], alpha[:, k - 1, 1, None] + t[1])
                alpha[:, k] = np.where(inside[:, k, None], step + e[:, k], alpha[:, k - 1])
            for k in range(most - 2, -1, -1):
                ahead = e[:, k + 1] + beta[:, k + 1]
                step = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
                beta[:, k] = np.where(inside[:, k + 1, None], step, 0)
            total_ = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
            p = np.exp(alpha + beta - total_[:, :, None]) * inside[:, :, None]
            pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - total_[:, :, None, None]) * pairs[:, :, None, None]
            miss = (y - p)[inside][block]
            gw = np.stack([np.bincount(active, miss[:, c], FEATURES) for c in (0, 1)], axis=1) / weight - l2 * w
            gt = (seen_t - pair.sum(axis=(0, 1))) / weight - l2 * t
            gw2 += gw * gw
            gt2 += gt * gt
            w, t = w + rate * gw / np.sqrt(gw2), t + rate * gt / np.sqrt(gt2)
        return Crf(w, t)


OUTSIDE = set("nav aside footer form header button select".split())
NOISE = set("ad ads advert advertisement comment comments cookie consent sidebar related share social newsletter promo sponsored reply notice menu nav navbar footer header banner popup widget".split())


def _within(blocks: list[Block], own) -> list[bool]:
    """Whether each block lies in an element that ``own`` says yes to, at any depth."""
    known: dict = {None: False}
    for b in blocks:
        element, todo = b.element, []
        while element not in known:
            todo.append(element)
            element = element.parent
        found = known[element]
        for e in reversed(todo):
            found = known[e] = found or own(e)
    return [known[b.element] for b in blocks]


def _never_content(blocks: list[Block]) -> list[bool]:
    return _within(blocks, lambda e: e.tag in OUTSIDE or bool(NOISE & set(e.words)))


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels that a page's own layout suggests. Content lies in its ``article`` or ``main`` elements; where it has none, in the innermost
    element that holds nine tenths of the page's running text (words that are no links, in parts whose names aren't those of other
    things). Blocks in parts that are never content are not. None where there is no such text."""
    bad = _never_content(blocks)
    inside = _within(blocks, lambda e: e.tag in ("article", "main"))
    if not any(inside):
        text = [0 if x else len(b.text) - min(b.linked, len(b.text)) for b, x in zip(blocks, bad, strict=True)]
        held: dict[Element, int] = {}
        for b, n in zip(blocks, text, strict=True):
            for e in b.element.up() if b.element and n else ():
                held[e] = held.get(e, 0) + n
        if not any(text):
            return None
        enough = [e for e, n in held.items() if 10 * n >= 9 * sum(text)]
        if enough:
            best = max(enough, key=lambda e: sum(1 for _ in e.up()))
            inside = [b.element is not None and any(e is best for e in b.element.up()) for b in blocks]
        else:  # the page itself is what holds it
            inside = [True] * len(blocks)
    return np.array([int(a and not x) for a, x in zip(inside, bad, strict=True)], dtype=np.int64)


def labelled_pages(sample: list[str | None], seed: int = 1) -> list[tuple[list[list[int]], np.ndarray]]:
    """Training pages from sampled ones: the pages themselves with weak labels, and each one's texts laid out anew by templates of
    other kinds of page - plain ``div`` layouts, sidebars, notices, forms, comments - with labels that are known. Where no page has
    content that can be told, it warns, and made texts are laid out."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    bodies: list[list[str]] = []
    for page in sample:
        blocks = leaf_blocks(page)
        labels = weak_labels(blocks)
        if labels is not None and labels.any():
            out.append((block_features(blocks), labels))
            bodies.append([b.text for b, k in zip(blocks, labels, strict=True) if k])
    if not bodies:
        warnings.warn("no page of the sample has content that its layout tells; the extractor is trained on made pages only", stacklevel=2)
        bodies = [_made_body(rng) for _ in range(100)]
    for i in range(len(bodies)):
        made = _templates(bodies[i], bodies[int(rng.integers(len(bodies)))], rng)
        blocks = leaf_blocks(made)
        labels = np.array([int(b.text.startswith(MARK)) for b in blocks], dtype=np.int64)
        for b in blocks:
            b.text = b.text.removeprefix(MARK).strip() or "."
        out.append((block_features(blocks), labels))
    return out


def _made_body(rng) -> list[str]:
    """A heading and paragraphs of made words."""
    syllables = "an ber con den er fo gi ha in jo ka lo men ni or per qua re sta ti un ver wo xi yo zu".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    return [sentence(int(rng.integers(3, 9)))[:-1], *(" ".join(sentence(int(rng.integers(5, 16))) for _ in range(int(rng.integers(1, 7)))) for _ in range(int(rng.integers(1, 8))))]


def _templates(body: list[str], other: list[str], rng) -> str:
    """One made page; content blocks start with MARK."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    words = " ".join(other).split() or ["word"]

    def some(least: int, below: int) -> str:
        begin = int(rng.integers(len(words)))
        return html.escape(" ".join(words[k % len(words)] for k in range(begin, begin + int(rng.integers(least, below)))))

    links = lambda n: "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(n))
    mark = lambda t: MARK + html.escape(t)
    box = lambda tag, cls, inner: f'<{tag} class="{cls}">{inner}</{tag}>' if cls else f"<{tag}>{inner}</{tag}>"
    para = lambda t: pick(f"<p>{mark(t)}</p>", f"<p>{mark(t)}", f"<p>{mark(t)}</p>", f"<div>{mark(t)}</div>", f"<blockquote>{mark(t)}</blockquote>")
    inner = [f"<{(h := pick('h1', 'h1', 'h2'))}>{mark(body[0])}</{h}>", *map(para, body[1:])]
    if rng.random() < 0.3:
        inner.append("<ul>" + "".join(f"<li>{mark(t)}</li>" for t in (some(4, 14), some(4, 14))) + "</ul>")
    if rng.random() < 0.2:
        inner.append(f"<table><tr><td>{mark(some(2, 8))}</td><td>{mark(some(2, 8))}</td></tr></table>")
    noise = [
        lambda: box(pick("div", "aside", "section"), pick("ad", "advert", "advertisement", "sponsored", "promo", "ads"), pick(some(4, 16), f"<p>{some(6, 25)}</p>")),
        lambda: box(pick("div", "aside"), pick("share", "social", "related", "newsletter", "recommended"), pick(f"<ul>{links(3)}</ul>", f"<p>{some(4, 20)}</p>")),
    ]
    for make in noise:
        if rng.random() < 0.35:
            inner.insert(int(rng.integers(1, len(inner) + 1)), make())
    article = box(pick("article", "main", "div", "div", "section", "td"), pick("content", "article", "post", "entry content", "story body", "main content", "article body", "", "text"), "".join(inner))
    if article.startswith("<td"):
        article = f"<table><tr>{article}</tr></table>"
    if rng.random() < 0.12:  # a bare layout: nothing around the article, which may be no element at all
        return pick("{}", "<html><body>{}</body></html>", "<html><body><div>{}</div></body></html>", "<body>{}").format("".join(inner))
    comments = box(pick("div", "section", "ol"), pick("comments", "comment list", "responses", "disqus comments"), "".join(box(pick("div", "li", "article"), "comment", f"<p>{some(5, 40)}</p>") for _ in range(int(rng.integers(1, 4)))))
    side = box(pick("aside", "div", "div"), pick("sidebar", "side widget", "widget", "sidebar right"), pick(f"<h3>{some(1, 4)}</h3><ul>{links(4)}</ul>", f"<p>{some(5, 30)}</p><p>{some(5, 30)}</p>"))
    notice = box(pick("div", "section", "aside"), pick("cookie notice", "cookie consent", "notice", "banner", "popup", "legal notice"), f"<p>{pick('We use cookies. ', '', 'Please read our privacy terms. ')}{some(5, 25)}</p>")
    form = f'<form action="/s">{some(1, 4)} <input name="q"><label>{some(1, 5)}</label><p>{some(3, 15)}</p></form>'
    head = pick(box("header", pick("", "site header", "masthead"), f"<h2>{some(1, 5)}</h2><p>{some(3, 12)}</p>"), box("div", pick("header", "topbar", "masthead"), some(2, 12)))
    nav = pick(f"<nav><ul>{links(5)}</ul></nav>", box("div", pick("nav", "menu", "navbar", "navigation"), f"<ul>{links(5)}</ul>"), box("ul", "menu", links(5)))
    foot = pick(f"<footer>&copy; {some(3, 12)}</footer>", box("div", pick("footer", "foot", "site footer"), f"<p>&copy; {some(4, 15)}</p>"), f"<footer><p>{some(5, 25)}</p><ul>{links(3)}</ul></footer>")
    before = [x for x, p in ((head, 0.6), (nav, 0.8), (notice, 0.3), (form, 0.2), (side, 0.15)) if rng.random() < p]
    after = [x for x, p in ((comments, 0.45), (side, 0.4), (form, 0.25), (notice, 0.25), (foot, 0.85)) if rng.random() < p]
    middle = article
    if rng.random() < 0.3:
        middle = box("div", pick("page", "container", "wrap", ""), article + pick("", comments, side))
    return "<html><head><title>x</title></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>"


def train_extractor(
    df: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS
) -> Crf:
    """A CRF from ``sample_pages`` different pages of at most ``sample_chars`` characters, those of least hash of id and page: a documented
    bound of labelled rows, whatever ids repeat. Longer pages are not in the sample, so a table of such pages alone is read by a model
    trained on made pages (with a warning); no page is cut."""
    page = F.col(html_col).cast("string")
    rows = df.filter(F.length(page) <= sample_chars).select(F.xxhash64(F.lit("train"), id_col, page).alias("h"), page.alias("html"))
    n = max(rows.count(), 1)
    drawn = rows.filter(F.pmod("h", F.lit(n)) < 8 * sample_pages) if n > 8 * sample_pages else rows
    least = [r["h"] for r in drawn.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    if not least and n > 8 * sample_pages:  # few different pages, none of them drawn
        least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
        drawn = rows
    found = drawn.filter(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").limit(sample_pages)
    return Crf.train(labelled_pages([r["html"] for r in found.collect()]))


def main_text(page: str | None, crf: Crf) -> str:
    """The content blocks of a page, joined by newlines; empty for null or where no block can be content. Where the best labels have no content, the
    best ones that have some are taken, among blocks outside of parts that are never content: a page is not empty for its layout."""
    blocks = leaf_blocks(page)
    features = block_features(blocks)
    labels = crf.viterbi(features)
    if len(blocks) and not labels.any():
        labels = crf.with_content(features, [not x for x in _never_content(blocks)])
    return "\n".join(b.text for b, k in zip(blocks, labels, strict=True) if k)


def extract_main_text(df: DataFrame, crf: Crf, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with the main text of its pages in ``out_col`` (replaced if there): never null, empty for null, empty and contentless pages.

    The whole page is read whatever its length; rows are independent of each other.
    """

    @F.pandas_udf("string")
    def extracted(pages):
        return pages.map(lambda p: main_text(p, crf))

    return df.withColumn(out_col, extracted(F.col(html_col).cast("string")))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = extract_main_text(pages, train_extractor(pages)).select("page_id", "url", "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
