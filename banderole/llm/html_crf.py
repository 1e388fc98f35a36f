"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text whose innermost block-level element is the
same.  Features are the tags, class and id words of all ancestors, those of the nearest telling one
once more, and the text's shape (length, link share, punctuation).  The field has two labels, article and other, and is trained by full
forward-backward gradients on labelled pages; Viterbi decodes the best labelling of a page.

Labelled pages are generated on the driver from many page layouts (their number and seed are
parameters): what each part of a page is, is known as it is written.  No table is read for training.

Edge cases: a null page is an empty page (no text, zero characters); markup that is never closed is
closed as browsers do, but an embedded element without an end tag (svg, select, iframe and so on) holds nothing; a page without article text gives the empty text; null ids and repeated rows
are handled one by one; elements may be nested to any depth; an empty table gives no rows; extra
columns pass through, those named as the results are replaced.
"""

from __future__ import annotations

import html as htmllib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_columns

# Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PLAIN = frozenset("p li ul ol h1 h2 h3 h4 h5 h6 blockquote pre dl dt dd table tbody thead tr td th figure figcaption".split())  # say little about where they stand
EMBEDDED = frozenset("noscript template select svg iframe object".split())  # stand inside a run of text without ending it
LEAVES = frozenset("svg select".split())  # hold no blocks of text: one that opens in them ends them
BLOCKS = PLAIN | frozenset("div section article main header footer aside nav form address center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist"))}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea)(?![\w:-])[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[a-zA-Z/!?][^>]*+>?"
    r"|([^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
ENDS = re.compile(rf"</({'|'.join(sorted(EMBEDDED))})\s*>", re.IGNORECASE)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile("[a-z]+")


class Block:
    """A leaf block: its text, its ancestors' features, and how much of it is link text."""

    __slots__ = ("links", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], links: int):
        self.text, self.path, self.links = text, path, links


@lru_cache(maxsize=50_000)
def _element(tag: str, attributes: str) -> tuple[str, ...]:
    names = " ".join("".join(x) for x in NAMES.findall(attributes))
    return (f"a:{tag}", *sorted({f"c:{w}" for w in WORDS.findall(names.lower()) if len(w) > 1}))


class Open:
    """An open element: what its blocks' features take from it and all around it.

    ``path`` is the elements' features in order, without repeats, and only the ones in ``known``
    where that is given, so that it stays short however deep a page is nested.
    """

    __slots__ = ("around", "near", "parent", "path", "tag")

    def __init__(self, tag: str, features: tuple[str, ...], above: Open | None, known: frozenset[str] | None):
        self.tag, path, self.parent, self.near = tag, (), "none", ()
        if above:
            path, self.parent, self.near = above.path, above.parent, above.near
        if tag not in INLINE:
            self.parent = tag
            if tag not in PLAIN:
                self.near = features if known is None else tuple(f for f in features if f"n:{f}" in known)
        new = tuple(f for f in dict.fromkeys(features) if (known is None or f in known) and f not in path)
        self.path = path + new if new else path
        self.around: tuple[list[str], int] | None = None  # of an embedded element: the run that it stands in


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks in order, without scripts, styles, text areas, comments and empty runs."""
    stack: list[Open] = []
    open_now: dict[str, int] = {}  # how many elements of a tag are open
    embedded: list[int] = []  # where the open embedded elements stand in the stack
    out: list[Block] = []
    held: list[str] = []
    links, linked = 0, 0
    last = {m[1].lower(): m.start() for m in ENDS.finditer(page)}  # without one after its start tag an element holds nothing

    def push(tag: str, attributes: str) -> None:
        stack.append(Open(tag, _element(tag, attributes), stack[-1] if stack else None, known))
        open_now[tag] = open_now.get(tag, 0) + 1

    def pop() -> Open:
        nonlocal linked
        gone = stack.pop()
        open_now[gone.tag] -= 1
        linked -= gone.tag == "a"
        return gone

    def innermost(tag: str, above: int = -1) -> int:
        """Where the innermost open element of a tag stands; ``above`` if there is none beyond it."""
        if not open_now.get(tag):
            return above
        return next((i for i in range(len(stack) - 1, above, -1) if stack[i].tag == tag), above)

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            if text:
                top = stack[-1] if stack else None
                path, parent, near = (top.path, top.parent, top.near) if top else ((), "none", ())
                out.append(Block(text, (*path, f"p:{parent}", *(f"n:{f}" for f in near)), links))
            held.clear()
        links = 0

    def drop(k: int) -> None:
        nonlocal held, links
        while len(stack) > k:
            flush()
            gone = pop()
            if gone.around is not None:
                held, links = gone.around
                embedded.pop()

    for m in TOKEN.finditer(page):
        text, tag = m[5], m[3]
        if text is not None:
            held.append(text)
            if linked:
                links += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                held.append(" ")
            continue
        if m[2]:
            k = innermost(tag)
            if k < 0:
                continue
            if tag not in INLINE:
                drop(k)
            elif all(x.tag in INLINE for x in stack[k:]):
                while len(stack) > k:
                    pop()
            continue
        if tag in EMBEDDED:
            if (m[4] or "").endswith("/") or last.get(tag, -1) < m.start():
                continue
            push(tag, m[4] or "")
            stack[-1].around = (held, links)
            embedded.append(len(stack) - 1)
            held, links = [], 0
            continue
        if tag in INLINE:
            linked += tag == "a"
        else:
            inmost = embedded[-1] if embedded else -1
            if tag in BLOCKS and inmost >= 0 and stack[inmost].tag in LEAVES and innermost("foreignobject", inmost) == inmost:
                drop(inmost)
                inmost = embedded[-1] if embedded else -1
            flush()
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                floor = max(inmost, *(innermost(x, inmost) for x in within))
                first = [i for x in ends.split() if (i := innermost(x, floor)) > floor]
                if first:
                    drop(min(first))
            k = innermost("p", inmost)
            if k > inmost:
                drop(k)
        if not (m[4] or "").endswith("/"):
            push(tag, m[4] or "")
        elif tag == "a":
            linked -= 1
    drop(0)
    flush()
    return out


def text_features(b: Block) -> tuple[str, ...]:
    t = b.text
    n = len(t)
    size = min(n.bit_length(), 10)
    share = min(4, 4 * b.links // max(1, n))
    end = "dot" if t[-1] in ".!?…:\"'”»" else "none"
    return (f"size:{size}", f"links:{share}", f"end:{end}", f"size:{size}/links:{share}", "copyright" if "©" in t else "plain", f"commas:{min(3, t.count(','))}")


# --- the field ----------------------------------------------------------------------------------
class Field:
    """Weights of a two-label chain: emissions per feature, transitions, starts."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: np.ndarray, starts: np.ndarray):
        self.weights, self.moves, self.starts = weights, moves.tolist(), starts.tolist()
        self.known = frozenset(weights)
        self._paths: dict[tuple[str, ...], tuple[float, float]] = {}

    def _sum(self, features: tuple[str, ...]) -> tuple[float, float]:
        found = [w for f in features if (w := self.weights.get(f))]
        return sum(w[0] for w in found), sum(w[1] for w in found)

    def emission(self, b: Block) -> tuple[float, float]:
        path = self._paths.get(b.path)
        if path is None:
            if len(self._paths) > 100_000:
                self._paths.clear()
            path = self._paths[b.path] = self._sum(b.path)
        shape = self._sum(text_features(b))
        return path[0] + shape[0], path[1] + shape[1]

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves
        e0, e1 = self.emission(blocks[0])
        s0, s1, back = self.starts[0] + e0, self.starts[1] + e1, []
        for b in blocks[1:]:
            e0, e1 = self.emission(b)
            from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((from0, from1))
            s0, s1 = e0 + (s1 + m10 if from0 else s0 + m00), e1 + (s1 + m11 if from1 else s0 + m01)
        label = int(s1 > s0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True)), axis=axis)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = 150, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximise the labelled pages' conditional likelihood by Adam on exact gradients."""
    pages = [p for p in pages if p[0]]
    bags = [[(*b.path, *text_features(b)) for b in blocks] for blocks, _ in pages]
    names = sorted({f for bag in bags for fs in bag for f in fs})
    index = {f: k for k, f in enumerate(names)}
    n, longest = len(pages), max(len(b) for b in bags)
    row = np.array([i * longest + t for i, bag in enumerate(bags) for t, fs in enumerate(bag) for _ in fs])
    col = np.array([index[f] for bag in bags for fs in bag for f in fs])
    mask = np.zeros((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=int)
    for i, (_, labels) in enumerate(pages):
        mask[i, : len(labels)] = True
        gold[i, : len(labels)] = labels
    truth = np.eye(2)[gold] * mask[..., None]
    pairs = np.einsum("nti,ntj,nt->ij", truth[:, :-1], truth[:, 1:], mask[:, 1:])
    size = len(names) * 2
    w, m, v = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    for step in range(1, steps + 1):
        emit = np.stack([np.bincount(row, weights=w[k * len(names) : (k + 1) * len(names)][col], minlength=n * longest) for k in (0, 1)], axis=1).reshape(n, longest, 2)
        moves, starts = w[size : size + 4].reshape(2, 2), w[size + 4 :]
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = starts + emit[:, 0]
        for t in range(1, longest):
            on = mask[:, t, None]
            alpha[:, t] = np.where(on, emit[:, t] + _lse(alpha[:, t - 1, :, None] + moves, 1), alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _lse(moves + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        total = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        joint = np.exp(alpha[:, :-1, :, None] + moves + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        off = (p - truth).reshape(-1, 2)
        grad = np.concatenate([*(np.bincount(col, weights=off[row, k], minlength=len(names)) for k in (0, 1)), (joint.sum(axis=(0, 1)) - pairs).ravel(), (p[:, 0] - truth[:, 0]).sum(axis=0)]) / n + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    k = len(names)
    return Field({f: (float(w[i]), float(w[k + i])) for f, i in index.items()}, w[size : size + 4].reshape(2, 2), w[size + 4 :])


# --- labelled pages -----------------------------------------------------------------------------
# Names that pages give their parts, as plain lists.
ARTICLE_NAMES = "content main-content post post-content entry entry-content story article article-body text body-text page-content".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs tabs pagination".split(),
    "header": "header masthead site-header top banner-top logo branding tagline".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending tags".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert banner popup modal newsletter subscribe".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor banner-ad adbox".split(),
    "form": "form search search-form login signup contact-form".split(),
    "comments": "comments comment comment-list replies reply discussion responses disqus".split(),
    "share": "share social share-buttons follow toolbar".split(),
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
LETTERS = "abcdefghijklmnopqrstuvwxyzéèüöñç"


class Writer:
    """Writes one labelled page; what it writes while ``content`` is on is article text."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.html, self.labels = rng, [], []
        self.beside = rng.spawn(1)[0]  # for embedded elements, so that they leave the other draws alone

    def pick(self, *xs):
        return xs[self.rng.integers(len(xs))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int, stop: bool = False) -> str:
        r = self.rng
        ws = ["".join(r.choice(list(LETTERS), r.integers(2, 9))) for _ in range(r.integers(lo, hi + 1))]
        ws = [w + "," if r.random() < 0.06 else w for w in ws]
        return " ".join(ws).capitalize() + ("." if stop else "")

    def block(self, tag: str, text: str, label: int, link: bool = False) -> None:
        if link:
            text = f'<a href="/x">{text}</a>'
        elif label and self.chance(0.2):
            text = f"<b>{text}</b>" if self.chance(0.5) else f"{text[: len(text) // 2]}<br>{text[len(text) // 2 :]}"
        self.html.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and self.chance(0.15) else f"</{tag}>"))
        self.labels.append(label)

    def box(self, kind: str):
        name = self.pick(*OTHER_NAMES[kind])
        tag = TAGS.get(kind) if kind in TAGS and self.chance(0.6) else self.pick("div", "section", "div")
        attribute = f' {self.pick("class", "id")}="{name}"' if tag in ("div", "section") or self.chance(0.4) else ""
        return f"<{tag}{attribute}>", f"</{tag}>"

    def other(self, kind: str) -> None:
        start, end = self.box(kind)
        self.html.append(start)
        if kind in ("nav", "share") or kind == "sidebar" and self.chance(0.5):
            if kind == "sidebar":
                self.block("h3", self.words(1, 4), 0)
            if self.chance(0.8):
                self.html.append("<ul>")
                for _ in range(self.rng.integers(2, 9)):
                    self.block("li", self.words(1, 3), 0, link=self.chance(0.9))
                self.html.append("</ul>")
            else:
                self.html.append("<div>" + " ".join(f'<a href="/y">{self.words(1, 2)}</a>' for _ in range(self.rng.integers(2, 7))) + "</div>")
                self.labels.append(0)
        elif kind == "form":
            for _ in range(self.rng.integers(1, 4)):
                self.block(self.pick("p", "div"), self.words(1, 4) + " <input name=q>", 0)
            self.block("button", self.words(1, 2), 0)
        elif kind == "comments":
            self.block("h3", self.words(1, 3), 0)
            for _ in range(self.rng.integers(1, 6)):
                self.html.append(f'<div class="{self.pick("comment", "reply", "comment-body", "message")}">')
                if self.chance(0.6):
                    self.block(self.pick("h4", "div"), self.words(1, 3), 0)
                for _ in range(self.rng.integers(1, 3)):
                    self.block("p", self.words(5, 50, stop=True), 0)
                self.html.append("</div>")
        else:
            long = kind in ("notice", "ad", "sidebar")
            for k in range(self.rng.integers(1, 4 if kind != "ad" else 2)):
                text = self.words(3, 35 if long else 12, stop=self.chance(0.6))
                if kind == "footer":
                    text = self.pick("&copy; ", "&copy; ", "", "") + text
                if k == 0 and self.chance(0.35):
                    self.html.append(text)
                    self.labels.append(0)
                    break
                self.block(self.pick("p", "div", "p"), text, 0, link=self.chance(0.2))
        self.html.append(end)

    def embedded(self) -> None:
        """At times an element whose text isn't part of the article, or an icon without text."""
        self.rng, rest = self.beside, self.rng
        if self.chance(0.03):
            tag = self.pick("svg", "svg", "select", "noscript", "template", "iframe", "object")
            if tag == "svg" and self.chance(0.5):
                self.html.append(self.pick('<svg class="icon"/>', '<svg><path d="M0 0"/></svg>', '<svg-icon name="x"></svg-icon>'))
            else:
                n = int(self.rng.integers(1, 4)) if tag == "select" else 1
                texts = [self.words(1, 4 if tag in ("svg", "select") else 25, stop=self.chance(0.5)) for _ in range(n)]
                inner = {"svg": "<title>{}</title>", "select": "<option>{}</option>", "template": "<p>{}</p>"}.get(tag, "{}")
                self.html.append(f"<{tag}>" + "".join(inner.format(t) for t in texts) + f"</{tag}>")
                self.labels += [0] * n
        self.rng = rest

    def article(self) -> None:
        form = self.pick("article", "main", "div", "section", "article", "both")
        name = f' class="{self.pick(*ARTICLE_NAMES)}"' if form in ("div", "section") or self.chance(0.3) else ""
        tag = "article" if form == "both" else form
        self.html.append(("<main>" if form == "both" else "") + f"<{tag}{name}>")
        self.block(self.pick("h1", "h1", "h2"), self.words(1, 14), 1)
        inner = ("ad", "share", "sidebar", "form", "notice", "nav")
        for _ in range(self.rng.integers(0, 14)):
            self.embedded()
            r = self.rng.random()
            if r < 0.72:
                self.block("p", self.words(1, 90, stop=True), 1)
            elif r < 0.8:
                self.block(self.pick("h2", "h3"), self.words(1, 8), 1)
            elif r < 0.87:
                self.html.append("<ul>")
                for _ in range(self.rng.integers(1, 5)):
                    self.block("li", self.words(2, 20, stop=self.chance(0.5)), 1)
                self.html.append("</ul>")
            elif r < 0.94:
                self.html.append("<blockquote>")
                self.block("p", self.words(4, 40, stop=True), 1)
                self.html.append("</blockquote>")
            else:
                self.other(self.pick(*inner))
        if self.chance(0.15):
            self.other("comments")
        self.html.append(f"</{tag}>" + ("</main>" if form == "both" else ""))


def labelled_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A generated page and the label of each of its leaf blocks."""
    w = Writer(rng)
    w.html.append("<!DOCTYPE html><html><head>")
    if w.chance(0.9):
        w.block("title", w.words(1, 12), 0)
    w.html.append("<style>p{margin:0}</style></head><body>")
    for kind in ("header", "nav", "notice", "ad", "form", "share"):
        if w.chance(0.45):
            w.other(kind)
    if w.chance(0.2):
        w.other("sidebar")
    w.embedded()
    w.article()
    w.embedded()
    for kind in ("share", "ad", "sidebar", "comments", "form", "nav", "notice", "footer"):
        if w.chance(0.35 if kind != "footer" else 0.85):
            w.other(kind)
    w.html.append("</body></html>")
    return "".join(w.html), w.labels


@lru_cache
def trained(pages: int = 400, seed: int = 3) -> Field:
    """The field fitted to ``pages`` generated pages."""
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(pages):
        page, labels = labelled_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise AssertionError("a generated page's blocks don't match its labels")
        made.append((blocks, labels))
    return train(made)


def main_text(page: str | None, field: Field) -> str:
    """The article's blocks, joined in page order by blank lines."""
    blocks = leaf_blocks(page or "", field.known)
    return "\n\n".join(b.text for b, y in zip(blocks, field.viterbi(blocks)) if y)


def extract(pages: DataFrame, *, html: str = "html", column: str = "text", field: Field | None = None) -> DataFrame:
    """``pages`` with ``html`` replaced by its main text and ``n_chars`` (its code points) added."""
    field = field or trained()
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, np.array(field.moves), np.array(field.starts)))

    def make():
        f = Field(*shared.value)

        def of(texts: list[str]) -> list[pa.Array]:
            made = [main_text(x, f) for x in texts]
            return [pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())]

        return of

    return with_columns(pages, html, [T.StructField(column, T.StringType()), T.StructField("n_chars", T.LongType())], make, drop=(html,))
