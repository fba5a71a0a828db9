"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: text between block-level tags, with the path of tags (and the words of
their class and id attributes) above it. A numpy bidirectional LSTM reads a vector per block (hashed path, hashed words,
length, links, position) in both directions and labels every block as main text or not, in view of the whole page.

No page comes labelled. The labeller learns from a bounded sample of pages taken apart and laid out anew: paragraphs of
articles in the containers that articles use, other blocks (and paragraphs posing as reader comments or adverts) in the
containers of menus, headers, footers, sidebars, notices, adverts, forms and comments, in random order and nesting.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, smallest_by_hash

PATH_DIM, WORD_DIM, EXTRA = 96, 32, 8
INPUT = PATH_DIM + WORD_DIM + EXTRA
HIDDEN = 24

# Elements of the HTML standard that start a block, are never closed, or hold no page text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea iframe object svg math canvas audio video title head select".split())
RAW = frozenset("script style textarea title noscript iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that a sibling's start looks past.
SOFT = frozenset("p td th dt dd li".split())
#: A start tag that ends an open paragraph, and the elements whose start ends a sibling of the same kind.
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
TAG_NAME = re.compile("(/?)([A-Za-z][A-Za-z0-9:-]*)")
SPECIAL = re.compile("[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Path(Sequence):
    """Labels from the page's root to an element; all elements share their ancestors' part."""

    __slots__ = ("above", "label", "depth", "kinds", "_vector")

    def __init__(self, above: "Path | None" = None, label: str = ""):
        self.above, self.label = above, label
        self.depth = above.depth + 1 if above is not None else 0
        self.kinds = above.kinds if above is not None else (False, False, False)
        self._vector = None
        if above is not None:
            tag = label.split(" ", 1)[0]
            heading, paragraph, item = self.kinds
            self.kinds = heading or tag in HEADINGS, paragraph or tag == "p", item or tag == "li"

    def __len__(self) -> int:
        return self.depth

    def __getitem__(self, k):
        labels, at = [], self
        while at.above is not None:
            labels.append(at.label)
            at = at.above
        return tuple(reversed(labels))[k]

    def __iter__(self):
        return iter(self[:])

    def vector(self) -> np.ndarray:
        """Signed counts of the hashed tags and names on the path."""
        way, at = [], self
        while at._vector is None and at.above is not None:
            way.append(at)
            at = at.above
        total = at._vector if at._vector is not None else np.zeros(PATH_DIM, np.int32)
        for at in reversed(way):
            total = at._vector = total + _label_vector(at.label)
        return total


ROOT = Path()


@dataclass
class Block:
    path: Path
    text: str
    linked: int = 0


@dataclass
class _Open:
    tag: str
    path: Path
    silent: bool


@lru_cache(maxsize=4096)
def _label(tag: str, attributes: str) -> str:
    words = {w for m in NAMES.finditer(attributes) for w in re.split(r"[^A-Za-z]+", next(g for g in m.groups() if g is not None).lower()) if w}
    return " ".join([tag, *sorted(words)])


class _TagEnds:
    """Where tags end, in time linear in the page: what was looked for once is remembered."""

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.looked = self.seen = -1  # no special character from `looked` up to `seen`

    def _special(self, at: int) -> int:
        m = SPECIAL.search(self.page, at)
        return m.start() if m else len(self.page)

    def after(self, at: int) -> int:
        """The place behind the ``>`` that ends a tag whose attributes start here, outside of quotes; -1 without one."""
        if not self.looked <= at <= self.seen:
            self.looked, self.seen = at, self._special(at)
        at, passed = self.seen, []
        while True:
            if at >= len(self.page):
                end = -1
            elif at in self.known:
                end = self.known[at]
            elif self.page[at] == ">":
                end = at + 1
            else:
                passed.append(at)
                if at < self.last[self.page[at]]:
                    at = self._special(self.page.find(self.page[at], at + 1) + 1)
                    continue
                end = -1
            self.known.update(dict.fromkeys(passed, end))
            return end

    def next_greater(self, at: int) -> int:
        return self.page.find(">", at) if at <= self.last[">"] else -1


class _Stack:
    """Open elements, with the places of every tag and of every element that stops a search."""

    def __init__(self):
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}

    def top(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, element: _Open) -> None:
        for name in self._names(element.tag):
            self.places.setdefault(name, []).append(len(self.open))
        self.open.append(element)

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            for name in self._names(self.open.pop().tag):
                self.places[name].pop()

    @staticmethod
    def _names(tag: str) -> list[str]:
        return [tag, *(["*block"] if tag in BLOCKS else []), *(["*stop"] if tag in BLOCKS and tag not in SOFT else [])]

    @property
    def path(self) -> Path:
        return self.open[-1].path if self.open else ROOT


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: references decoded, white space inside a block made one space, empty blocks left out."""
    out: list[Block] = []
    stack = _Stack()
    ends = _TagEnds(page)
    pieces: list[str] = []
    linked = at = seek = 0
    where = ROOT

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", "".join(pieces)).strip()
            if text:
                out.append(Block(where, text, linked))
            pieces.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked, where
        if not text or (stack.open and stack.open[-1].silent):
            return
        text = html_lib.unescape(text)
        if not pieces:
            if text.isspace():
                return
            where = stack.path
        pieces.append(text)
        if stack.top("a") >= 0:
            linked += len(text)

    n = len(page)
    while at < n:
        start = page.find("<", seek)
        if start < 0:
            take(page[at:])
            break
        name = None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            end = end if end > 2 else n
        elif page.startswith("<![CDATA[", start):
            end = page.find("]]>", start + 9) + 3
            end = end if end > 2 else n
        elif page.startswith(("<!", "<?"), start):
            end = ends.next_greater(start + 2) + 1
        else:
            name = TAG_NAME.match(page, start + 1)
            end = ends.after(name.end()) if name else -1
        if end <= 0:
            seek = start + 1  # no tag: the sign is text
            continue
        take(page[at:start])
        at = seek = end
        if name is None:
            if page.startswith("<![CDATA[", start):
                take(page[start + 9 : end].removesuffix("]]>"))
            continue
        tag = name.group(2).lower()
        if tag == "br":
            if pieces:
                pieces.append(" ")
            continue
        if tag in BLOCKS:
            close_block()
        if name.group(1):
            # A stray end tag of an inline element does not close blocks.
            place = stack.top(tag)
            if place >= 0 and (tag in BLOCKS or place > stack.top("*block")):
                stack.cut(place)
            continue
        if tag in VOID:
            continue
        place = stack.top(*SIBLINGS.get(tag, "p" if tag in BLOCKS else "").split())
        if place >= 0 and place >= stack.top("*stop"):
            stack.cut(place)
        silent = tag in SILENT or bool(stack.open and stack.open[-1].silent)
        attributes = page[name.end() : end - 1]
        if not attributes.endswith("/"):
            stack.push(_Open(tag, Path(stack.path, _label(tag, attributes)), silent))
            if tag in RAW:
                m = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                at = seek = m.end() if m else n
                stack.cut(len(stack.open) - 1)
    close_block()
    return out


@lru_cache(maxsize=20_000)
def _label_vector(label: str) -> np.ndarray:
    out = np.zeros(PATH_DIM, np.int32)
    tag, *words = label.split(" ")
    for name in (f"<{tag}>", *words):
        h = zlib.crc32(name.encode())
        out[h % PATH_DIM] += 1 if h >> 16 & 1 else -1
    return out


@lru_cache(maxsize=200_000)
def _word_spot(word: str) -> int:
    return zlib.crc32(word.lower().encode()) % WORD_DIM


def block_vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block; the whole text of each block counts."""
    out = np.zeros((len(blocks), INPUT))
    for k, b in enumerate(blocks):
        words = b.text.split(" ")
        out[k, :PATH_DIM] = np.clip(b.path.vector(), -2, 2)
        spots = np.bincount([_word_spot(w) for w in words], minlength=WORD_DIM)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = spots / np.sqrt((spots**2).sum())
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(b.text)) / 6, min(1.0, b.linked / len(b.text)), len(b.path) / 10, k / max(1, len(blocks) - 1),
            sum(b.text.count(c) for c in ".,;!?") / max(1, len(words)), *b.path.kinds,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """Bidirectional LSTM with one logistic output per block."""

    parameters: dict[str, np.ndarray] = field(default_factory=dict)
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 3) -> "BlockLabeller":
        rng = np.random.default_rng(seed)
        p = {"out": rng.normal(0, 0.3, 2 * HIDDEN), "out_b": np.zeros(1)}
        for side in ("f", "b"):
            p[f"w{side}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
            p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p[f"c{side}"] = np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN)))
        return cls(p)

    def _pass(self, x: np.ndarray, mask: np.ndarray, side: str):
        """Hidden states of one direction over ``x(time, page, input)``; what lies behind a page's end leaves its state alone."""
        p, (steps, pages, _) = self.parameters, x.shape
        lead = x @ p[f"w{side}"] + p[f"c{side}"]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        states, saved = np.zeros((steps, pages, HIDDEN)), [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = lead[t] + h @ p[f"u{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            forget, enter, leave = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            fresh = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            cell = forget * c + enter * fresh
            squashed = np.tanh(cell)
            saved[t] = (h, c, forget, enter, leave, fresh, squashed, m)
            h, c = m * leave * squashed + (1 - m) * h, m * cell + (1 - m) * c
            states[t] = h
        return states, saved

    def chances(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self._pass(x, mask, "f")[0], self._pass(x, mask, "b")[0]), axis=2)
        return _sigmoid(both @ self.parameters["out"] + self.parameters["out_b"][0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over blocks, by back-propagation through time."""
        p, out = self.parameters, {}
        sides = {s: self._pass(x, mask, s) for s in ("f", "b")}
        both = np.concatenate((sides["f"][0], sides["b"][0]), axis=2)
        slope = (_sigmoid(both @ p["out"] + p["out_b"][0]) - y) * mask / max(1.0, mask.sum())
        out["out"], out["out_b"] = np.einsum("tp,tph->h", slope, both), np.array([slope.sum()])
        for k, side in enumerate(("f", "b")):
            steps = len(x)
            own = slope[:, :, None] * p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
            dz = np.zeros((steps, x.shape[1], 4 * HIDDEN))
            du = np.zeros_like(p[f"u{side}"])
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                h, c, forget, enter, leave, fresh, squashed, m = sides[side][1][t]
                dh = dh + own[t]
                cell = dh * m * leave * (1 - squashed**2) + dc * m
                dz[t] = np.concatenate(
                    (cell * c * forget * (1 - forget), cell * fresh * enter * (1 - enter), dh * m * squashed * leave * (1 - leave), cell * enter * (1 - fresh**2)), axis=1
                )
                du += h.T @ dz[t]
                dh, dc = dz[t] @ p[f"u{side}"].T + dh * (1 - m), cell * forget + dc * (1 - m)
            out[f"w{side}"], out[f"u{side}"], out[f"c{side}"] = np.einsum("tpi,tpz->iz", x, dz), du, dz.sum(axis=(0, 1))
        return out

    def label(self, pages: list[list[Block]], at_once: int = 64) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < at_once and (hi - lo + 1) * len(pages[order[hi]]) <= 8192:
                hi += 1
            x, mask = padded([block_vectors(pages[k]) for k in order[lo:hi]])
            chance = self.chances(x, mask)
            for slot, k in enumerate(order[lo:hi]):
                out[k] = chance[: len(pages[k]), slot] >= self.threshold
            lo = hi
        return out


def padded(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, vectors))
    x, mask = np.zeros((steps, len(vectors), INPUT)), np.zeros((steps, len(vectors)))
    for k, v in enumerate(vectors):
        x[: len(v), k], mask[: len(v), k] = v, 1
    return x, mask


# Container wording the layouts are drawn from.
MAIN_NAMES = "content post entry story text body article main page-content post-body entry-content article-text".split()
SIDE_NAMES = (
    "nav menu navbar breadcrumb breadcrumbs topbar header masthead banner site-header footer site-footer copyright legal sidebar "
    "side widget related recommended more-stories share social follow ad ads advert advertisement sponsored promo cookie "
    "cookies consent notice alert popup newsletter subscribe signup login search form comment comments comment-body comment-text reply replies respond "
    "discussion tags pagination pager skip toolbar author-box rating disclaimer"
).split()
SIDE_TAGS = "nav header footer aside form div section ul".split()


def _attribute(rng: np.random.Generator, names: list[str]) -> str:
    return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'


#: Marks main text in a made-up layout until the layout is taken apart again (a private-use code point).
MARK = "\ue000"


def _side(rng: np.random.Generator, texts: list[str], prose: list[str]) -> str:
    """A container of other blocks; comments, adverts and teasers read like articles."""
    tag = str(rng.choice(SIDE_TAGS))
    named = tag in ("div", "section", "ul") or rng.random() < 0.4
    inner = []
    for _ in range(int(rng.integers(1, 5))):
        text = html_lib.escape(str(rng.choice(prose if rng.random() < 0.4 else texts)))
        shapes = (f"<li><a href='#'>{text}</a></li>", f"<p>{text}</p>", f"<div>{text}</div>", f"<span>{text}</span><br>", f"<h3>{text}</h3>")
        inner.append(shapes[rng.integers(0, len(shapes))])
    return f"<{tag}{_attribute(rng, SIDE_NAMES) if named else ''}>{''.join(inner)}</{tag}>"


def _main(rng: np.random.Generator, texts: list[str], prose: list[str]) -> str:
    """Paragraphs, headings, quotes and lists of an article, with an advert or sharing bar between them at times."""
    parts = [f"<h1>{MARK}{html_lib.escape(str(rng.choice(prose)))[:60]}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.choice([1, 2, 3, 4, 6, 8, 12, 20]))):
        text = str(rng.choice(prose))
        if rng.random() < 0.3:
            text = " ".join(text.split(" ")[: int(rng.integers(1, 8))])
        text = html_lib.escape(text)
        shapes = (
            *[f"<p>{MARK}{text}</p>"] * 5, f"<p><b>{MARK}{text}<br>", f"<h2>{MARK}{text[:50]}</h2>", f"<blockquote>{MARK}{text}</blockquote>",
            f"<ul><li>{MARK}{text}</li></ul>", f"<p>{MARK}{text[:60]} <a href='#'>{text[60:90]}</a></p>", f"<table><tr><td>{MARK}{text}</td></tr></table>",
        )
        parts.append(shapes[rng.integers(0, len(shapes))])
        if rng.random() < 0.1:
            parts.append(_side(rng, texts, prose))
    # One kind of block prevails on many pages.
    return "".join(p for p in parts if p.startswith(("<p>", "<h1>"))) or "".join(parts) if rng.random() < 0.4 else "".join(parts)


def _layout(rng: np.random.Generator, texts: list[str], prose: list[str]) -> str:
    shape = rng.integers(0, 6)
    body = _main(rng, texts, prose)
    if shape <= 2:
        body = f"<article{_attribute(rng, MAIN_NAMES) if rng.random() < 0.3 else ''}>{body}</article>"
    elif shape == 3:
        body = f"<main>{body}</main>"
    else:
        body = f"<div{_attribute(rng, MAIN_NAMES)}>{body}</div>"
    if rng.random() < 0.3:
        body = f"<main>{body}</main>"
    around = [_side(rng, texts, prose) for _ in range(int(rng.integers(1, 7)))]
    at = int(rng.integers(0, len(around) + 1))
    page = "".join(around[:at]) + body + "".join(around[at:])
    if rng.random() < 0.4:
        page = f"<div{_attribute(rng, ['wrapper', 'container', 'page', 'row', 'site', 'layout'])}>{page}</div>"
    return f"<html><head><title>t</title></head><body>{page}</body></html>"


@dataclass(frozen=True)
class LabellerPlan:
    """``fit_pages`` bounds the pages that the driver reads; ``layouts`` pages are made of their blocks, of which the
    first ``block_chars`` characters are learned from."""

    fit_pages: int = 150
    layouts: int = 900
    block_chars: int = 2000
    epochs: int = 14
    batch: int = 30
    rate: float = 0.01
    seed: int = 3


def fit(pages: list[str], plan: LabellerPlan = LabellerPlan()) -> BlockLabeller:
    """A labeller from pages taken apart and laid out anew; no page at all leaves made-up filler words."""
    rng = np.random.default_rng(plan.seed)
    texts, prose = ["home", "contact", "search", "log in"], []
    for page in pages:
        for b in blocks_of(page):
            (prose if len(b.text.split(" ")) >= 6 and b.linked * 2 < len(b.text) else texts).append(b.text[: plan.block_chars])
    prose = prose or ["some words that stand for a paragraph of an article."]
    model = BlockLabeller.fresh(plan.seed)
    examples = []
    for _ in range(plan.layouts):
        blocks = blocks_of(_layout(rng, texts, prose))
        y = np.array([b.text.startswith(MARK) for b in blocks], float)
        for b in blocks:
            b.text = b.text.removeprefix(MARK).strip() or "-"
        examples.append((block_vectors(blocks), y))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.parameters.items()}
    step = 0
    for epoch in range(plan.epochs):
        order = rng.permutation(len(examples))
        for lo in range(0, len(order), plan.batch):
            chosen = [examples[k] for k in order[lo : lo + plan.batch]]
            x, mask = padded([c[0] for c in chosen])
            y = np.zeros(mask.shape)
            for k, (_, own) in enumerate(chosen):
                y[: len(own), k] = own
            step += 1
            rate = plan.rate * (0.3 if epoch >= plan.epochs * 2 // 3 else 1.0)
            for name, g in model.gradients(x, mask, y).items():
                first, second = moment[name]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                model.parameters[name] -= rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def fit_on(pages: DataFrame, html: str = "html", plan: LabellerPlan = LabellerPlan()) -> BlockLabeller:
    """Labeller from at most ``fit_pages`` pages, smallest hash first."""
    rows = narrow(pages, html=html).filter("html IS NOT NULL").select(F.xxhash64("html").alias("h"), "html")
    return fit(smallest_by_hash(rows, "h", plan.fit_pages, "html").toArrow()["html"].to_pylist(), plan)


def extract(pages: DataFrame, model: BlockLabeller, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Blocks labelled as main text, joined by one newline in page order; empty when there is none. NULL and empty pages
    give an empty text. Pages are read whole. Rows may repeat; other columns are ignored; an empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [blocks_of(p or "") for p in part.column(2).to_pylist()]
                texts = [
                    "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)
                    for blocks, kept in zip(found, own.label(found), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = narrow(pages, page_id=page_id, url=url, html=html).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
