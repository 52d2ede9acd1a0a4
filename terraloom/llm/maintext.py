"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks, the runs of text between block-level tags, each with the tags
and classes it stands in. Scripts, styles, comments and other text that is never shown are no blocks.
Blocks are labelled main text or not by a conditional random field: weights of a block's features
and of each pair of neighbouring labels, decoded by Viterbi. Features are of groups (a tag or class
of the menu, footer, notice or advert kind nearest to the block, and so on), so what is learned from one
advert holds for a sidebar with another name.

Training: pages that mark their article (``<article>`` or ``<main>``) are the labelled ones: a block inside
is main text, unless it stands in a menu, footer, form or the like there. In a third of the sample the mark is
hidden from the features, so that pages without it are decided by the rest; in another third all
but the groups is hidden, so that they count where tags and wording say little. The sample is bounded by ``PAGES`` pages of at most ``BLOCKS`` blocks, chosen by a hash of the id; every page of
the table is decoded, whole.

Defined results: a null or empty html gives an empty text of 0 characters; character references are
decoded; white space inside a block becomes one space; a tag cut off at the end of a page is no text;
without labelled pages the groups of tags alone decide; repeated rows are extracted one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import stored, utf8

PAGES = 400
BLOCKS = 120

#: The content model of HTML as far as it matters here.
UNSEEN = "script style template noscript iframe svg math canvas object select textarea title head"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HALT = frozenset("ul ol dl table article main section div body".split())
MAIN_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset address".split())
OTHER_WORDS = frozenset((
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus foot footer form header legal login masthead menu nav navbar navigation "
    "newsletter notice pager pagination paywall popup promo related respond reply replies search share sharing sidebar side signup social sponsor sponsored subscribe tags toolbar widget"
).split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text body".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|noscript|iframe|svg|math|canvas|object|select|textarea|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template"}
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TOKENS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    group: str  # nearest ancestor of a known kind: main, other, none
    marked: bool  # inside an <article> or <main>
    linked: int  # characters inside of links


@lru_cache(maxsize=4096)
def _kind(name: str, attrs: str) -> str:
    """What an element's own tag and names say about the text in it."""
    if name in OTHER_TAGS:
        return "other"
    words = {w for m in NAMED.finditer(attrs) for v in m.groups() if v for w in TOKENS.findall(v.lower())} if "=" in attrs else set()
    if words & OTHER_WORDS:
        return "other"
    return "main" if name in MAIN_TAGS else "named" if words & MAIN_WORDS else ""


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (tag, kind)
    parts: list[str] = []
    linked = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text and not any(t == "head" for t, _ in stack):
                group, tag, marked, inner = "none", "", False, False
                for t, k in reversed(stack):
                    if not tag and t not in INLINE:
                        tag = t
                    if k and group == "none" and not (t == "header" and any(x in MAIN_TAGS for x, _ in stack)):
                        group = "other" if k == "other" else "main"
                    marked = marked or t in MAIN_TAGS
                out.append(Block(text, tag, group, marked, linked))
        linked = 0

    for m in TAG.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        if m["raw"]:
            if m["raw"].lower() in ("select", "textarea"):
                flush()
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if inline and any(t not in INLINE for t, _ in stack[k:]):
                        break  # an inline end tag closes no block
                    del stack[k:]
                    break
            if name == "a":
                links = max(0, links - 1)
            continue
        if name not in IN_HEAD:  # a head without an end tag ends here
            for k, (t, _) in enumerate(stack):
                if t == "head":
                    flush()
                    del stack[k:]
                    break
        if not inline:
            closes = SIBLING.get(name, ()) + (("p",) if name not in VOID or name == "hr" else ())
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t in closes:
                    del stack[k:]
                    break
                if t in HALT or t in OTHER_TAGS:
                    break
            links = 0
        if name in VOID or (m["attrs"] or m["attrs2"] or "").endswith("/") and inline:
            continue
        stack.append((name, "" if inline else _kind(name, m["attrs"] or m["attrs2"] or "")))
        if name == "a":
            links += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def _size(n: int) -> int:
    return min(8, n.bit_length())


def features(bs: list[Block], view: int = 0) -> list[list[str]]:
    """Names of the features that each block has. View 1 hides the marks of main text, view 2 all but
    the groups."""
    out = []
    last = len(bs) - 1
    for i, b in enumerate(bs):
        words = b.text.count(" ") + 1
        group = "none" if view == 1 and b.group == "main" else b.group
        share = 4 * b.linked // max(1, len(b.text))
        groups = [f"group {group}", f"links {min(4, share)}", f"group {group} links {min(1, share)}"]
        out.append(groups if view == 2 else [
            *groups, f"tag {b.tag if b.tag in ('p', 'li', 'td', 'pre', 'blockquote', 'figcaption') else 'h' if b.tag[:1] == 'h' and b.tag[1:].isdigit() else 'box'}",
            f"words {_size(words)}", f"end {b.text[-1] in '.!?…:;\"”'}", f"mark {'©' in b.text or '®' in b.text}",
            f"tag and words {b.tag == 'p'} {_size(words)}", "first" if i == 0 else "last" if i == last else "inside",
        ])
    return out


@dataclass
class Model:
    weights: dict[str, tuple[float, float]]  # of a feature for the labels 0 and 1
    moves: tuple[tuple[float, float], tuple[float, float]]  # from label to label

    def decode(self, bs: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not bs:
            return []
        none = (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        for i, names in enumerate(features(bs)):
            e0 = e1 = 0.0
            for n in names:
                w = self.weights.get(n, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                from0, from1 = (0 if s0 + m00 >= s1 + m10 else 1), (0 if s0 + m01 > s1 + m11 else 1)
                back.append((from0, from1))
                s0, s1 = max(s0 + m00, s1 + m10) + e0, max(s0 + m01, s1 + m11) + e1
            else:
                s0, s1 = e0, e1
        labels = [0 if s0 > s1 else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    def extract(self, page: str) -> str:
        bs = blocks(page)
        return "\n\n".join(b.text for b, y in zip(bs, self.decode(bs)) if y)


#: Used where no page is labelled: the group of the nearest known tag decides, and links speak against.
UNTRAINED = Model({"group main": (0.0, 3.0), "group other": (4.0, 0.0), "tag p": (0.0, 1.0), "links 4": (2.0, 0.0), "links 3": (2.0, 0.0)}, ((0.0, 0.0), (0.0, 0.0)))


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def likelihood(weights: np.ndarray, moves: np.ndarray, ids: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood and its gradients. ids: (pages, blocks, features) with the last weight for
    padding; y: (pages, blocks); n: blocks of each page. By the forward-backward recursions."""
    s, t, f = ids.shape
    emit = weights[ids].sum(axis=2)
    alive = np.arange(t)[None, :] < n[:, None]
    fwd, bwd = np.zeros((t, s, 2)), np.zeros((t, s, 2))
    fwd[0] = emit[:, 0]
    for k in range(1, t):
        step = log_sum(fwd[k - 1][:, :, None] + moves[None], 1) + emit[:, k]
        fwd[k] = np.where(alive[:, k, None], step, fwd[k - 1])
    for k in range(t - 2, -1, -1):
        step = log_sum(moves[None] + (emit[:, k + 1] + bwd[k + 1])[:, None, :], 2)
        bwd[k] = np.where(alive[:, k + 1, None], step, 0.0)
    total = log_sum(fwd[t - 1], 1)
    node = np.exp(np.transpose(fwd + bwd, (1, 0, 2)) - total[:, None, None]) * alive[:, :, None]
    truth = np.eye(2)[y] * alive[:, :, None]
    pair = np.zeros((2, 2))
    score = (emit * truth).sum() - total.sum()
    for k in range(1, t):
        both = alive[:, k]
        p = np.exp(fwd[k - 1][:, :, None] + moves[None] + (emit[:, k] + bwd[k])[:, None, :] - total[:, None, None])
        seen = truth[:, k - 1][:, :, None] * truth[:, k][:, None, :]
        pair += ((seen - p) * both[:, None, None]).sum(axis=0)
        score += float((seen * moves[None])[both].sum())
    grad = np.zeros_like(weights)
    for label in (0, 1):
        grad[:, label] = np.bincount(ids.ravel(), np.repeat((truth - node)[:, :, label].ravel(), f), len(weights))
    grad[-1] = 0.0
    return score / s, grad / s, pair / s


def train(pages: list[list[Block]], steps: int = 80, rate: float = 0.15, ridge: float = 0.01) -> Model:
    """Fit by gradient ascent with per-weight steps (AdaGrad). Every page has at least one block."""
    if not pages or not any(b.marked for p in pages for b in p):
        return UNTRAINED
    names: dict[str, int] = {}
    rows = [[[names.setdefault(x, len(names)) for x in fs] for fs in features(p, k % 3)] for k, p in enumerate(pages)]
    t, f = max(map(len, rows)), max(len(fs) for r in rows for fs in r)
    ids = np.full((len(rows), t, f), len(names))
    y, n = np.zeros((len(rows), t), int), np.array([len(r) for r in rows])
    for i, (r, p) in enumerate(zip(rows, pages)):
        for j, (fs, b) in enumerate(zip(r, p)):
            ids[i, j, : len(fs)] = fs
            y[i, j] = b.marked and b.group != "other"
    w, moves = np.zeros((len(names) + 1, 2)), np.zeros((2, 2))
    sum_w, sum_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(steps):
        _, gw, gm = likelihood(w, moves, ids, y, n)
        gw, gm = gw - ridge * w, gm - ridge * moves
        sum_w += gw * gw
        sum_m += gm * gm
        w += rate * gw / np.sqrt(sum_w)
        moves += rate * gm / np.sqrt(sum_m)
    return Model({k: (float(w[i, 0]), float(w[i, 1])) for k, i in names.items()}, tuple(map(tuple, moves.tolist())))


def fit(pages: DataFrame, page_id: str = "page_id", source: str = "html", most: int = PAGES) -> Model:
    """Fit on a bounded sample, in the order of a hash of the ids."""
    marked = pages.select(F.col(page_id).cast("string").alias("id"), F.col(source).alias("html")).filter(F.lower("html").rlike("<(article|main)[\\s>]") & (F.octet_length("html") < 200_000))
    ids = stored(marked.select("id").filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most), "sample")
    rows = marked.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most).collect()  # most pages of bounded size
    return train([bs for r in rows for bs in [blocks(r.html)] if 0 < len(bs) <= BLOCKS])


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", most: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, page_id, source, most))  # a few hundred weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            texts = [m.extract(h.decode()) for h in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return narrow.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
