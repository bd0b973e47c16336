"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each with the
path of open block elements (names, class and id words) above it. A bidirectional LSTM
in numpy reads, for the whole sequence of a page's leaves, a hashed vector of the path,
a hashed vector of the words and a few measures, and labels each block as main text or
not, so every decision has the page as its context. Kept blocks are joined in order.

The labeller is trained on the driver from ``TRAIN_PAGES`` pages that a seeded
generator writes, with invented words, varied layouts and known labels; no row of
the input is used. Weights (about 100 kB) go to workers with the function.

Null html counts as an empty page; an empty page has the empty text. Rows are
independent: repeated ids give repeated rows, a null id or url stays null.
"""

from __future__ import annotations

import html as entities
import re
from functools import cache, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapper

PATH_DIM, WORD_DIM, MEASURES = 64, 32, 8
INPUT = PATH_DIM + WORD_DIM + MEASURES
HIDDEN = 16
TRAIN_PAGES = 480
EPOCHS = 12
BATCH_STEPS = 1 << 14

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Fixed values of the HTML standard: elements that hold no markup, void elements, and phrasing elements that do not end a block.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag that ends an element that is still open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tr", "td", "th"}}
HOLDERS = frozenset("ul ol dl table html body".split())
HIDDEN_WITHIN = frozenset({"head"})


def leaves(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters within links) of every block with text, in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            if block and not any(name in HIDDEN_WITHIN for name, _ in stack):
                out.append((tuple(p for _, p in stack), block, min(linked, len(block))))
            text.clear()
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            clean = entities.unescape(raw)
            text.append(clean)
            if link:
                linked += len(clean.strip())

    while True:
        found = _TAG.search(page, at)
        if not found:
            put(page[at:])
            break
        put(page[at : found.start()])
        at = found.end()
        if found[1] is not None:
            text.append(found[1])
        if not found[3]:
            continue
        name, ends = found[3].lower(), bool(found[2])
        if name in RAW and not ends:
            if name != "noscript":
                stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            if name not in INLINE:
                flush()
            continue
        if name in INLINE:
            if name == "a":
                link = not ends
            elif name == "br":
                text.append(" ")
            continue
        flush()
        link = False
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name == "body":
            stack[:] = [x for x in stack if x[0] not in HIDDEN_WITHIN]
        over = CLOSES.get(name)
        if over:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in over:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDERS:
                    break
        if name not in VOID and not found[4].rstrip().endswith("/"):
            said = " ".join(x[2] or x[3] or x[4] or "" for x in _ATTR.finditer(found[4]))
            stack.append((name, " ".join([name, *_NAME.findall(said.lower())])))
    flush()
    return out


@lru_cache(maxsize=1 << 17)
def _place(word: str) -> tuple[int, float]:
    h = crc32(word.encode())
    return h % PATH_DIM, 1.0 if h & 0x10000 else -1.0


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashed counts of the element names and class words of a path; the last two steps also on their own."""
    out = np.zeros(PATH_DIM, np.float32)
    for depth, step in enumerate(path):
        for word in step.split():
            i, sign = _place(word)
            out[i] += sign
        if depth >= len(path) - 2:
            i, sign = _place(f"{len(path) - depth}:{step.split()[0]}")
            out[i] += sign
    return out


def features(blocks: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    out = np.zeros((len(blocks), INPUT), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        words = text.lower().encode("utf-8", "replace").split()
        out[k, :PATH_DIM] = _path_vector(path)
        counts = np.bincount([crc32(w) % WORD_DIM for w in words], minlength=WORD_DIM)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = 0.5 * counts / max(1.0, float(np.sqrt(np.square(counts).sum())))
        n = len(text)
        stops = sum(map(text.count, ".!?"))
        out[k, PATH_DIM + WORD_DIM :] = (np.log1p(n) / 6, linked / n, min(1.0, stops / len(words)) if words else 0.0, text[-1] in ".!?\"'", len(words) > 8, len(words) > 25, k == 0, len(path) / 8)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """Forward and backward LSTM over padded sequences, one logit a step."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for side in "fb":
            self.p["x" + side] = (rng.standard_normal((INPUT, 4 * hidden)) * INPUT**-0.5).astype(np.float32)
            self.p["h" + side] = (rng.standard_normal((hidden, 4 * hidden)) * hidden**-0.5).astype(np.float32)
            self.p["c" + side] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        self.p["out"] = (rng.standard_normal(2 * hidden) * 0.2).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _scan(self, x: np.ndarray, mask: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """x: steps x pages x INPUT. The state stands still where the mask is 0, so padding on either end does nothing."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, self.h), np.float32), np.zeros((pages, self.h), np.float32)
        out = np.zeros((steps, pages, self.h), np.float32)
        pre = x @ self.p["x" + side] + self.p["c" + side]
        n = self.h
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + side]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            new_h = o * squashed
            if keep is not None:
                keep.append((t, i, f, o, g, c, squashed, h, m))
            h, c = m * new_h + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._scan(x, mask, "f", None), self._scan(x, mask, "b", None)], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the unmasked steps and its gradients, by back-propagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._scan(x, mask, s, kept[s]) for s in "fb"], axis=2)
        p = _sigmoid(both @ self.p["out"] + self.p["bias"])
        total = max(1.0, float(mask.sum()))
        loss = -float((mask * np.log(np.where(y > 0.5, p, 1 - p) + 1e-7)).sum()) / total
        d = (p - y) * mask / total
        grad = {"out": np.einsum("tp,tph->h", d, both), "bias": d.sum(keepdims=True)[0][:1]}
        n = self.h
        for k, side in enumerate("fb"):
            wh = self.p["h" + side]
            dh_all = d[:, :, None] * self.p["out"][k * n : (k + 1) * n]
            dh_next = np.zeros(x.shape[1:2] + (n,), np.float32)
            dc_next = np.zeros_like(dh_next)
            dz_all = np.zeros((*x.shape[:2], 4 * n), np.float32)
            gh = np.zeros_like(wh)
            for t, i, f, o, g, c_old, squashed, h_old, m in reversed(kept[side]):
                dh = dh_all[t] + dh_next
                inner, dc = m * dh, m * dc_next
                dc = dc + inner * o * (1 - squashed**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), inner * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += h_old.T @ dz
                dh_next = (1 - m) * dh + dz @ wh.T
                dc_next = (1 - m) * dc_next + dc * f
            flat = dz_all.reshape(-1, 4 * n)
            grad["x" + side], grad["h" + side], grad["c" + side] = x.reshape(-1, x.shape[2]).T @ flat, gh, flat.sum(axis=0)
        return loss, grad


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, 1
    return x, mask


_ARTICLE = ["article", "main", "div class=content", "div class=post", "div class=entry-content", "section class=story", "div id=article-body", "div class='article text'", "div id=main"]
_OUTER = ["div id=page", "div class=wrapper", "div class=container", "div class=row", "div class=layout", "div id=root"]
_BEFORE = ["nav", "header", "div class=menu", "div class=ad", "div class='cookie notice'", "div class=breadcrumb", "div id=banner", "div class=topbar", "aside", "div class=promo", "form class=search", "div class=advert"]
_AFTER = ["footer", "aside", "div class=sidebar", "div class=comments", "section id=comments", "div class=related", "div class=ads", "div class=share", "form class=newsletter", "div class=pagination", "div id=footer", "ol class=comment-list", "div class=widget", "form"]
_WITHIN = ["div class=ad", "aside", "div class=sponsor", "div class=share-buttons", "div class=promo", "form class=subscribe", "nav class=toc", "div class=notice"]


def generate(seed: int) -> tuple[str, list[bool]]:
    """A page with invented words, and whether each of its blocks is main text."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyzäéñöß"
    marks: list[bool] = []
    out: list[str] = []

    def some(items: list) -> str:
        return items[int(rng.integers(len(items)))]

    def word() -> str:
        return "".join(letters[int(i)] for i in rng.integers(len(letters), size=int(rng.integers(1, 10))))

    def sentence(low: int, high: int) -> str:
        w = [word() for _ in range(int(rng.integers(low, high)))]
        return " ".join(w).capitalize() + (some([".", ".", "!", "?", "&amp;"]) if rng.random() < 0.85 else "")

    def leaf(tag: str, text: str, main: bool, end: bool = True) -> None:
        out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if end else ""))
        marks.append(main)

    def within(tag: str, body) -> None:
        out.append(f"<{tag}>")
        body()
        out.append(f"</{tag.split()[0]}>")

    def links() -> None:
        kind = some(["ul", "ol", "div"])
        out.append(f"<{kind}>")
        for _ in range(int(rng.integers(2, 8))):
            text = f'<a href="/{word()}">{sentence(1, 4)}</a>'
            leaf("li" if kind != "div" else some(["p", "div"]), text, False)
        out.append(f"</{kind}>")

    def extra() -> None:
        how = rng.random()
        if how < 0.4:
            links()
        elif how < 0.7:
            out.append(some(["&copy; ", "", ""]) + " ".join(sentence(2, 12) for _ in range(int(rng.integers(1, 4)))))
            marks.append(False)
        else:
            for _ in range(int(rng.integers(1, 4))):
                leaf(some(["p", "div", "span class=x", "h4", "label", "li"]).replace("span class=x", "p").replace("label", "div"), sentence(2, 30), False)

    def paragraphs() -> None:
        if rng.random() < 0.8:
            leaf(some(["h1", "h1", "h2"]), sentence(1, 14), True)
        for _ in range(int(rng.integers(1, 14))):
            how = rng.random()
            if how < 0.62:
                text = " ".join(sentence(1, 30) for _ in range(int(rng.integers(1, 8))))
                lead = some(["", "", "<b>", "<i>"])
                leaf("p", lead + text + ("<br>" if lead and rng.random() < 0.5 else ""), True, end=rng.random() < 0.7)
            elif how < 0.72:
                leaf(some(["h2", "h3"]), sentence(1, 9), True)
            elif how < 0.80:
                out.append("<ul>")
                for _ in range(int(rng.integers(2, 6))):
                    leaf("li", sentence(1, 16), True)
                out.append("</ul>")
            elif how < 0.86:
                within("blockquote", lambda: leaf("p", sentence(3, 30), True))
            elif how < 0.89:
                within("table", lambda: within("tr", lambda: [leaf("td", sentence(1, 5), True) for _ in range(3)]))
            elif how < 0.91:
                leaf("pre", sentence(2, 12), True)
            elif how < 0.94:
                leaf("div", sentence(4, 30), True)
            else:
                within(some(_WITHIN), extra)

    out.append(f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>")
    shell = some(_OUTER) if rng.random() < 0.4 else ""
    if shell:
        out.append(f"<{shell}>")
    for _ in range(int(rng.integers(0, 4))):
        within(some(_BEFORE), extra)
    outer = "main" if rng.random() < 0.25 else ""
    out.append(f"<{outer}>" if outer else "")
    within(some(_ARTICLE), paragraphs)
    if rng.random() < 0.2:
        within(some(_AFTER), extra)
    out.append(f"</{outer}>" if outer else "")
    for _ in range(int(rng.integers(0, 4))):
        within(some(_AFTER), extra)
    out.append("</div>" if shell else "")
    out.append("</body></html>")
    return "".join(out), marks


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11, batch: int = 24) -> BiLstm:
    """Fit by Adam on generated pages; the same weights for the same arguments."""
    data = []
    for k in range(pages):
        page, marks = generate(seed * 100_003 + k)
        blocks = leaves(page)
        if len(blocks) != len(marks):
            raise ValueError(f"generated page {k} has {len(blocks)} blocks and {len(marks)} marks")
        data.append((features(blocks), np.array(marks, np.float32)))
    model, rng = BiLstm(), np.random.default_rng(seed)
    first, second, step = {}, {}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            some = [data[k] for k in order[i : i + batch]]
            x, mask = _padded([s[0] for s in some])
            y = np.zeros_like(mask)
            for k, s in enumerate(some):
                y[: len(s[1]), k] = s[1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for name, g in grad.items():
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                model.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


@cache
def trained() -> BiLstm:
    return train()


def label_pages(pages: list[list[tuple]], model: BiLstm) -> list[list[bool]]:
    """Whether each block is main text; pages of like length are scored together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(pages[order[j]]) * (j + 1 - i) <= BATCH_STEPS:
            j += 1
        x, mask = _padded([features(pages[k]) for k in order[i:j]])
        good = model.logits(x, mask) > 0
        for col, k in enumerate(order[i:j]):
            out[k] = good[: len(pages[k]), col].tolist()
        i = j
    return out


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row. Map-only; a worker holds one Arrow batch."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            htmls, texts = batch.column(2), []
            for at in range(0, len(htmls), 256):
                pages = [leaves(x.as_py() or "") for x in htmls[at : at + 256]]
                texts += ["\n\n".join(b[1] for b, good in zip(p, g, strict=True) if good) for p, g in zip(pages, label_pages(pages, model), strict=True)]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = df.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return slim.mapInArrow(mapper(run), "page_id bigint, url string, text string, n_chars bigint")
