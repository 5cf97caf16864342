"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags, each with its open elements. The field has two
states (main text or not), binary features of the elements and the text, and transition weights; it is trained on
labelled pages by gradient ascent of the regularised log-likelihood and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborist.llm.common import arrow_rows

#: Labelled pages that the default model is fitted on (made by a generator here), passes over them, and the penalty.
PAGES, EPOCHS, PENALTY = 400, 150, 1e-3

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page: scripts, styles, form input and what is not rendered.
RAW = frozenset("script style template iframe title textarea head".split())
#: An opening tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
_P_CLOSERS = BLOCK - {"br", "button", "label", "option", "legend", "summary", "caption", "td", "th", "tr"}
#: Words in class, id and role values that say what an element is for.
HINTS = (
    "nav menu breadcrumb header masthead footer bottom sidebar side aside widget ad ads advert advertisement banner promo sponsor "
    "sponsored cookie consent notice alert popup modal newsletter subscribe signup login form search comment comments reply replies "
    "discussion share social related recommended more tag tags meta author byline date article main content post entry body story text"
).split()

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Block:
    """Text of a leaf block, its open elements as features, and how many of its characters are links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


def _marks(name: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{name}"]
    if attributes and "=" in attributes:
        for m in _ATTR.finditer(attributes):
            words = _SPLIT.split((m[1] or m[2] or m[3] or "").lower())
            out += [f".{w}" for w in words if w in _HINTS]
    return tuple(out)


_HINTS = frozenset(HINTS)


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order; white space inside a block is one space, references are decoded."""
    page = page or ""
    found: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                found.append(Block(text, tuple(m for _, marks in open_ for m in marks), linked))
            parts, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            if links:
                linked += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            # a comment may close at once, or with an exclamation mark
            m = _COMMENT.match(page, lt)
            at = n if m is None else m.end()
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if m is None:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name = m[1], m[2].lower()
        if name in RAW and not closing:
            flush()
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end is None and name == "head":
                continue
            at = n if end is None else end.end()
            continue
        if name in BLOCK:
            flush()
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name not in BLOCK and any(x in BLOCK for x, _ in open_[k + 1 :]):
                        break
                    del open_[k:]
                    break
            links = sum(x == "a" for x, _ in open_)
            continue
        if name in VOID:
            continue
        if name in _P_CLOSERS:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    del open_[k:]
                    break
                if open_[k][0] in BLOCK:
                    break
        if name in CLOSES:
            gone, stops = CLOSES[name]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in stops:
                    break
                if open_[k][0] in gone:
                    del open_[k:]
                    break
        if m[3].endswith("/") and name not in BLOCK:
            continue
        open_.append((name, _marks(name, m[3])))
        links += name == "a"
    flush()
    return found


def features(found: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        density = b.linked / max(1, len(b.text))
        last = b.text[-1]
        row = {"bias", *b.path, f"in:{b.path[-1] if b.path else ''}"}
        row.add(f"words:{min(6, words.bit_length())}")
        row.add(f"links:{min(3, int(density * 4))}")
        row.add("stop" if last in ".!?…。\"”»" else "colon" if last == ":" else "open")
        if "©" in b.text or "all rights" in b.text.lower():
            row.add("copyright")
        if not k:
            row.add("first")
        if k == len(found) - 1:
            row.add("last")
        out.append(sorted(row))
    return out


class Field:
    """A trained field: weights of (feature, state) and of (state, state)."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: list[list[float]]) -> None:
        self.weights, self.steps = weights, steps

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable states, by Viterbi; ties go to state 0."""
        if not rows:
            return []
        get, none = self.weights.get, (0.0, 0.0)
        s = self.steps
        back = []
        a = b = None
        for row in rows:
            x = y = 0.0
            for name in row:
                w = get(name, none)
                x += w[0]
                y += w[1]
            if a is None:
                a, b = x, y
                continue
            from_a = (a + s[0][0] >= b + s[1][0], a + s[0][1] >= b + s[1][1])
            back.append(from_a)
            a, b = (a + s[0][0] if from_a[0] else b + s[1][0]) + x, (a + s[0][1] if from_a[1] else b + s[1][1]) + y
        state = int(b > a)
        states = [state]
        for step in reversed(back):
            state = 0 if step[state] else 1
            states.append(state)
        return states[::-1]


def _expectations(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray):
    """Log partition, state and step marginals of padded chains, by forward and backward sums."""
    pages, most, _ = scores.shape
    inside = np.arange(most)[None, :] < lengths[:, None]
    alpha = np.zeros_like(scores)
    beta = np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, most):
        step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + steps[None], axis=1) + scores[:, t]
        alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
    for t in range(most - 2, -1, -1):
        step = np.logaddexp.reduce(steps[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
        beta[:, t] = np.where(inside[:, t + 1, None], step, 0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    states = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
    pairs = alpha[:, :-1, :, None] + steps[None, None] + (scores + beta)[:, 1:, None, :] - z[:, None, None, None]
    return z, states, (np.exp(pairs) * inside[:, 1:, None, None]).sum(axis=(0, 1))


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, penalty: float = PENALTY) -> Field:
    """Fit a field to pages of (feature names of each block, states) by Adam on the full gradient."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for rows, _ in pages for row in rows for f in row})
    index = {f: k for k, f in enumerate(names)}
    lengths = np.array([len(rows) for rows, _ in pages])
    most = int(lengths.max())
    x = np.zeros((len(pages), most, len(names)), np.float32)
    y = np.zeros((len(pages), most, 2))
    seen = np.zeros((2, 2))
    for p, (rows, states) in enumerate(pages):
        for t, row in enumerate(rows):
            x[p, t, [index[f] for f in row]] = 1
            y[p, t, states[t]] = 1
            if t:
                seen[states[t - 1], states[t]] += 1
    flat = x.reshape(-1, len(names))
    theta = np.zeros(2 * len(names) + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, epochs + 1):
        weights, steps = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        _, states, pairs = _expectations((flat @ weights).reshape(len(pages), most, 2), steps, lengths)
        up = np.r_[(flat.T @ (y - states).reshape(-1, 2)).ravel(), (seen - pairs).ravel()] / len(pages) - penalty * theta
        first = 0.9 * first + 0.1 * up
        second = 0.999 * second + 0.001 * up * up
        theta = theta + 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    weights = theta[:-4].reshape(-1, 2)
    return Field({f: (float(weights[k, 0]), float(weights[k, 1])) for f, k in index.items()}, theta[-4:].reshape(2, 2).tolist())


LAYOUTS = ("regions", "columns", "divisions")


def labelled_page(rnd: random.Random, layout: str = "regions") -> tuple[str, list[tuple[str, int]]]:
    """A made-up page and its (block text, 1 if main) pairs, for training and tests.

    The layout is of regions (article or main beside nav, aside and so on), of the columns of a table, or of nested
    divisions.
    """
    marks: list[tuple[str, int]] = []
    vocabulary = [f"{a}{b}" for a in "ba de fi go lu mar ne or pi su ta vu".split() for b in ("", "n", "len", "rit", "so", "ved")]

    def text(low: int, high: int, main: int, stop: str = "") -> str:
        words = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(low, high))).capitalize() + stop
        marks.append((words, main))
        return words

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{text(1, 3, 0)}</a></li>' for k in range(n))

    def maybe(chance: float, make) -> str:
        return make() if rnd.random() < chance else ""

    def named(*names: str) -> str:
        return f'<div {rnd.choice(["class", "id"])}="{rnd.choice(names)}">'

    def article() -> str:
        out = [maybe(0.9, lambda: f"<h1>{text(2, 9, 1)}</h1>")]
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12])):
            kind = rnd.random()
            if kind < 0.75:
                out.append(f"<p>{text(1, 80, 1, rnd.choice(['.', '.', '.', '!', '']))}" + ("</p>" if rnd.random() < 0.8 else ""))
            elif kind < 0.82:
                out.append(f"<h2>{text(1, 7, 1)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{text(2, 12, 1)}</li>" for _ in range(rnd.randint(1, 5))) + "</ul>")
            elif kind < 0.93:
                out.append(f"<blockquote>{text(4, 40, 1, '.')}</blockquote>")
            elif kind < 0.96:
                out.append(f"<table><tr><td>{text(1, 4, 1)}</td><td>{text(1, 4, 1)}</td></tr></table>")
            else:
                out.append(f'{named("ad", "ads", "advert", "promo", "newsletter")}{text(2, 20, 0, ".")}</div>')
        return "".join(out)

    def written(parts: list[str]) -> tuple[str, list[tuple[str, int]]]:
        inside = "".join(parts)
        return f"<!DOCTYPE html><html><head><title>{rnd.choice(vocabulary)}</title></head><body>{inside}</body></html>", marks

    if layout == "columns":
        wide = rnd.choice(["", ' width="100%"', ' class="main"', ' id="content"'])
        head = [f"<tr><td colspan=2>{text(1, 6, 0)}</td></tr>", maybe(0.5, lambda: f'<tr><td colspan=2 class="banner">{text(2, 12, 0)}</td></tr>')]
        menu = f'<td class="{rnd.choice(["menu", "nav", "left", "side"])}">' + "<br>".join(f'<a href="/{k}">{text(1, 3, 0)}</a>' for k in range(rnd.randint(2, 8))) + "</td>"
        body = f"<td{wide}>{article()}</td>"
        right = maybe(0.5, lambda: f'<td class="{rnd.choice(["related", "sidebar", "ads"])}"><b>{text(1, 3, 0)}</b><ul>{links(3)}</ul></td>')
        foot = f'<tr><td colspan=3 class="footer">{text(2, 20, 0, ".")}</td></tr>'
        return written(["<table>", *head, "<tr>", menu, body, right, "</tr>", foot, "</table>"])
    if layout == "divisions":
        opened = rnd.choice(['<div role="main">', '<div class="col text">', '<section class="story">', '<div class="row"><div class="entry">', '<div id="main">'])
        closed = "</section>" if opened.startswith("<section") else "</div>" * opened.count("<div")
        before = [
            named("top header", "site-header") + text(1, 5, 0) + maybe(0.5, lambda: f"<span>{text(1, 3, 0)}</span>") + "</div>",
            named("top-menu", "main-menu", "nav bar") + " ".join(f'<a href="/{k}">{text(1, 2, 0)}</a>' for k in range(1)) + "</div>",
            maybe(0.4, lambda: named("cookie bar", "alert box", "notice") + text(4, 30, 0, ".") + "</div>"),
            maybe(0.4, lambda: named("login box", "search box") + f"<form>{text(1, 3, 0)}<input name=q><button>{text(1, 1, 0)}</button></form></div>"),
        ]
        main = opened + article() + maybe(0.2, lambda: f"<noscript>{text(2, 30, 1, '.')}</noscript>") + closed
        after = [
            maybe(0.4, lambda: named("related posts", "recommended") + f"<ul>{links(4)}</ul></div>"),
            maybe(0.5, lambda: named("user comments", "replies") + "".join(f"<div><b>{text(1, 2, 0)}</b><p>{text(2, 50, 0, '.')}</p></div>" for _ in range(rnd.randint(1, 4))) + "</div>"),
            maybe(0.2, lambda: f"<noscript>{text(4, 9, 0, '.')}</noscript>"),
            named("page footer", "bottom") + f"<p>{text(2, 25, 0, '.')}</p></div>",
        ]
        return written([*before, main, *after])
    top = [
        maybe(0.5, lambda: f"<header>{text(1, 6, 0)}</header>"),
        maybe(0.3, lambda: named("header", "masthead") + text(1, 12, 0, ".") + "</div>"),
        maybe(0.6, lambda: f"<nav><ul>{links(rnd.randint(1, 9))}</ul></nav>"),
        maybe(0.3, lambda: named("menu", "nav", "breadcrumb") + f"<ul>{links(rnd.randint(1, 6))}</ul></div>"),
        maybe(0.3, lambda: named("cookie-notice", "consent", "notice", "alert") + f"<p>{text(5, 40, 0, '.')}</p></div>"),
        maybe(0.5, lambda: named("ad", "ads", "banner", "sponsored") + text(2, 40, 0, ".") + "</div>"),
        maybe(0.2, lambda: f"<form>{text(1, 5, 0)}<button>{text(1, 2, 0)}</button></form>"),
        maybe(0.2, lambda: f"<aside><h3>{text(1, 4, 0)}</h3><p>{text(5, 60, 0, '.')}</p></aside>"),
    ]
    opened, closed = rnd.choice([
        ("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
        (named("content", "main-content", "post", "entry-content", "article-body", "story"), "</div>"),
    ])
    head = "".join(rnd.sample(top, len(top)))
    body = opened + article() + closed
    tail = [
        maybe(0.3, lambda: f"<aside>{text(3, 60, 0, '.')}<ul>{links(3)}</ul></aside>"),
        maybe(0.3, lambda: named("sidebar", "related", "widget", "recommended") + f"<h3>{text(1, 4, 0)}</h3><ul>{links(4)}</ul><p>{text(3, 50, 0, '.')}</p></div>"),
        maybe(0.35, lambda: named("comments", "comment-list", "discussion") + "".join(f'<div class="comment"><p>{text(2, 60, 0, ".")}</p></div>' for _ in range(rnd.randint(1, 6))) + "</div>"),
        maybe(0.1, lambda: f'<section id="comments"><h2>{text(1, 3, 0)}</h2><p>{text(2, 60, 0, ".")}</p></section>'),
        maybe(0.2, lambda: f"<form>{text(1, 6, 0)}<label>{text(1, 2, 0)}</label></form>"),
        maybe(0.8, lambda: f"<footer>&copy; {text(2, 40, 0, '.')}</footer>"),
        maybe(0.2, lambda: named("footer", "bottom") + f"<p>{text(2, 40, 0, '.')}</p></div>"),
    ]
    if rnd.random() < 0.05:  # an article and nothing else
        bare = article()
        made = opened + bare + closed
        return f"<!DOCTYPE html><html><body>{made}</body></html>", [m for m in marks if m[0] in bare]
    return written([head, body, *tail])


def labelled(page: str, marks: list[tuple[str, int]]) -> tuple[list[list[str]], list[int]]:
    """Features and states of a labelled page; a block is main if its text is marked so."""
    main = dict(marks)
    found = blocks(page)
    return features(found), [max((v for k, v in ((b.text, main.get(b.text)), (b.text.removeprefix("© "), main.get(b.text.removeprefix("© ")))) if v is not None), default=0) for b in found]


@cache
def default_field(pages: int = PAGES, seed: int = 11) -> Field:
    """The field fitted on `pages` made-up labelled pages, half of them of the first layout."""
    return fitted(LAYOUTS, pages, seed)


def fitted(layouts: tuple[str, ...], pages: int = PAGES, seed: int = 11) -> Field:
    """A field fitted on made-up labelled pages of the given layouts."""
    rnd = random.Random(seed)
    kinds = [layouts[0] if k % 2 == 0 else layouts[1 + k // 2 % (len(layouts) - 1)] if len(layouts) > 1 else layouts[0] for k in range(pages)]
    return train([labelled(*labelled_page(rnd, kind)) for kind in kinds])


def main_text(page: str | None, field: Field) -> list[str]:
    """Texts of the blocks that the field takes for main text."""
    found = blocks(page)
    return [b.text for b, s in zip(found, field.decode(features(found)), strict=True) if s]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", field: Field | None = None) -> DataFrame:
    """`keep` columns and blocks, the array of a page's main blocks in page order, for every row.

    A null or empty page has no blocks; unclosed and stray tags are tolerated; repeated rows are parsed each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in arrow_rows(batches):
            k = batch.num_columns - 1
            texts = [main_text(page, field) for page in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(texts, pa.list_(pa.string()))], names=[*batch.schema.names[:k], "blocks"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema)
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, f"{kinds}blocks array<string>")
