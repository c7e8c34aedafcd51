"""Operator 7: main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between
block-level tags).  A block is described by hashed vectors of its tag path
(tags, class and id words of its ancestors) and of its words, and a few counts.
A bidirectional LSTM (numpy) reads the whole sequence, so that every block is
classified with the context of the document; blocks labelled content are
joined in page order.

The network is trained on the driver on a bounded sample of pages, of any
length: of a long one, a run of blocks from a hashed place.  Labels are
weak: a block is boilerplate if the vocabulary of boilerplate containers
occurs on its path, content if that of content containers does, otherwise
content if it is a long run of unlinked words.  Each sampled page is also used
in re-templated forms (other containers around the same texts), so that the
network does not depend on one site's markup.  Where no sampled page has a
block, the weak labels themselves decide.

Defined results: null and empty html, and pages without a content block, give
the empty text; unclosed and truncated tags are tolerated; repeated rows are
read one by one; other columns are ignored."""

from __future__ import annotations

import html
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofreq.llm.common import map_arrow, row_sample, utf8

SAMPLE_PAGES = 240  # pages the network is trained on, at most about
SAMPLE_CHARS = 30_000  # of a longer sampled page, a run of blocks of about this length is used
WINDOW_BLOCKS = 120  # a training sequence; of a longer one a random run of blocks is used
PATH_DIM, WORD_DIM, HIDDEN = 256, 24, 12

# fixed values: words of class and id attributes and tags, by what they hold
BOILERPLATE = """nav navbar navigation menu header masthead topbar footer bottom aside sidebar side rail ad ads advert
advertisement adslot sponsor sponsored banner promo promotion cookie cookies consent notice alert popup modal overlay
newsletter subscribe signup share sharing social related recommended trending popular comments comment reply replies
respond discussion disqus form login search breadcrumb breadcrumbs pagination pager copyright legal widget toolbar
tags meta byline""".split()
CONTENT = "article main content post entry story articlebody postbody text body-text entry-content post-content".split()
_BOILER, _CONTENT = frozenset(BOILERPLATE), frozenset(CONTENT)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
              "strong strike sub sup time tt u var wbr img".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY_SAME = {"li", "tr", "td", "th", "dt", "dd", "option"}
_BLOCK_IN_P = "p"
_SKIPPED = set("script style noscript template title textarea select svg iframe button".split())
_MARK = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)|<[!?]")
# up to the '>' of a tag; a quote counts after '=' only, and an unclosed one is an ordinary character
_ATTRS = re.compile(r"(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)*+")
_TAIL = re.compile(r"<!--.*|<[/!a-zA-Z][^<>]*+\Z", re.S)
_ENDS = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _SKIPPED}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)?")


@lru_cache(maxsize=50_000)
def _named(tag: str, attrs: str) -> tuple[str, ...]:
    words = [tag]
    for m in _NAMED.finditer(attrs):
        for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
            words += [w, *(w.split("-") if "-" in w else ())]
    return tuple(words)


def _tags(page: str):
    """(start, end, closing, tag, attributes) of the markup of a page; the tag
    is empty for comments and declarations, the attributes are None for skipped
    elements.  Linear: where scans for the end of a tag have failed over eight
    times the page, a tag ends at the first '>'."""
    at, failed, last = 0, 0, page.rfind(">")
    while (m := _MARK.search(page, at, last + 1)) is not None:
        start, tag = m.start(), (m[2] or "").lower()
        if not tag:
            end = page.find("-->", start + 4) + 2 if m[0] == "<!--" else page.find(">", start)
            at = end + 1 if end > start else len(page)
            yield start, at, False, "", ""
            continue
        end = _ATTRS.match(page, m.end()).end() if failed <= 8 * len(page) else len(page)
        if end == len(page):  # the only '>' are in quotes
            failed += end - start
            end = page.find(">", m.end())
        attrs, at = page[m.end():end], end + 1
        if tag in _SKIPPED and not m[1] and not (tag == "svg" and attrs.rstrip().endswith("/")):
            close = _ENDS[tag].search(page, at)
            at = close.end() if close else len(page)
            yield start, at, False, tag, None
        else:
            yield start, at, bool(m[1]), tag, attrs
    for m in _TAIL.finditer(page, max(at, last + 1)):  # cut off in a comment or tag
        yield m.start(), m.end(), False, "", ""


def blocks(page: str) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, linked characters) of each leaf block."""
    return [(path, text, linked) for path, text, linked in _unwrapped(_leaves(page))]


def _unwrapped(leaves: list) -> list:
    """Paths of names.  Utility classes on wrappers say nothing about what is
    inside them: ``html`` and ``body`` are bare tags, and a container that holds
    most of the page's text, a content container among it, loses the words of
    boilerplate."""
    size: dict[int, int] = {}
    inside: set[int] = set()
    for path, text, _ in leaves:
        for k, (number, names) in enumerate(path):
            size[number] = size.get(number, 0) + len(text)
            if not _BOILER.isdisjoint(names) and any(
                    not _CONTENT.isdisjoint(below) and _BOILER.isdisjoint(below) for _, below in path[k + 1:]):
                inside.add(number)
    half = sum(len(text) for _, text, _ in leaves) / 2
    wrapper = {number for number in inside if size[number] > half}
    plain = lambda names: (names[0], *(w for w in names[1:] if w not in _BOILER))
    return [(tuple(plain(names) if number in wrapper else names for number, names in path), text, linked)
            for path, text, linked in leaves]


def _leaves(page: str) -> list:
    """Leaf blocks whose paths are (number of the container, its names)."""
    out: list = []
    n_open = 0
    stack: list[tuple[str, tuple[int, tuple[str, ...]]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(n for _, n in stack), text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) if in_link else 0

    for start, end, closing, tag, attrs in _tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if attrs is None:
            close()
            continue
        if tag == "a":
            in_link = not closing
        if tag in _INLINE:
            continue
        close()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID and not attrs.rstrip().endswith("/"):
            if stack and stack[-1][0] == _BLOCK_IN_P or tag in _CLOSED_BY_SAME and stack and stack[-1][0] == tag:
                stack.pop()  # a paragraph ends where a block begins
            n_open += 1
            if tag in ("html", "body"):
                attrs = ""
            # long attributes are not kept in the cache
            stack.append((tag, (n_open, (_named if len(attrs) <= 4096 else _named.__wrapped__)(tag, attrs))))
    add(page[at:])
    close()
    return out


@lru_cache(maxsize=200_000)
def _hash(word: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return h % dim, 1.0 if h & 0x10000 else -1.0


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    j, sign = _hash.__wrapped__(word, WORD_DIM)
    return j + WORD_DIM * (sign > 0)


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    x = np.zeros(PATH_DIM)
    for depth, names in enumerate(reversed(path)):
        for w in names:
            i, sign = _hash(w, PATH_DIM)
            x[i] += sign / (1 + 0.5 * depth)
    return x


def features(found: list, first: int = 0, total: int | None = None) -> np.ndarray:
    """Of a page's blocks, or of a run of them from block ``first`` of ``total``."""
    total = total or len(found)
    x = np.zeros((len(found), PATH_DIM + WORD_DIM + 5))
    for i, (path, text, linked) in enumerate(found):
        x[i, :PATH_DIM] = _path_vector(path)
        words = text.split(" ")
        slot = _slot if max(map(len, words)) <= 64 else _slot.__wrapped__  # long words are not kept in the cache
        count = np.bincount(list(map(slot, words)), minlength=2 * WORD_DIM)
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = (count[WORD_DIM:] - count[:WORD_DIM]) / (4 * len(words) ** 0.5)
        x[i, -5:] = (np.log1p(len(words)) / 4, linked / max(1, len(text)),
                     sum(map(text.count, ".,;:!?")) / max(1, len(words)), (first + i) / total, 1.0)
    return x


def window(page: str) -> tuple[list, int, int]:
    """(blocks, number of the first, number in the page): all blocks, or a run
    of about ``SAMPLE_CHARS`` characters from a hashed place."""
    found = blocks(page)
    sizes = np.array([len(text) + sum(len(n) for names in path for n in names) for path, text, _ in found], np.int64)
    if sizes.sum() <= SAMPLE_CHARS:
        return found, 0, len(found)
    ends = np.cumsum(sizes)
    # a place among the characters, so that the run is not cut short by the end
    place = zlib.crc32(page.encode("utf-8", "replace")) / 2 ** 32 * max(0, int(ends[-1]) - SAMPLE_CHARS)
    first = int(np.searchsorted(ends, place, "right"))
    out, left = [], SAMPLE_CHARS
    for (path, text, linked), size in zip(found[first:], sizes[first:]):
        if left <= 0:
            break
        part = text[:max(1, left)]
        out.append((path, part, linked * len(part) // len(text)))
        left -= int(size)
    return out, first, len(found)


def weak_label(block) -> int:
    path, text, linked = block
    words = {w for names in path for w in names}
    if words.intersection(BOILERPLATE):
        return 0
    if words.intersection(CONTENT):
        return 1
    return int(len(text.split(" ")) >= 8 and linked < 0.3 * len(text))


def retemplated(rng: np.random.Generator, pages: list[list]) -> tuple[list, list[int]]:
    """The texts of one page in other containers, with texts of other pages as
    boilerplate around (and between) them, as (blocks, labels)."""
    own = pages[rng.integers(len(pages))]
    core = [b for b in own if weak_label(b)] or own
    other = [b for i in rng.integers(len(pages), size=3) for b in pages[i]] or own
    pick = lambda words: words[rng.integers(len(words))]
    top = (("html",), ("body",))
    wrap = (("div",),) * int(rng.integers(0, 3))
    tag = ("article", "main", "div", "section")[rng.integers(4)]
    # names that say nothing: some templates name no container by what it holds
    bare = lambda: "".join("bcdfghjklmnpqrstvwxz"[i] for i in rng.integers(20, size=int(rng.integers(1, 5))))
    silent, thread = rng.random() < 0.3, ("thread", "msg", "msgs", "note-list")[rng.integers(4)]
    named = f'class="{pick(CONTENT)} {pick(CONTENT)}"' if rng.random() < 0.5 else f'class="{pick(CONTENT)}"'
    if silent:
        tag, named = ("div", "section")[rng.integers(2)], f'class="{bare()}"'
    holder = _named(tag, "" if tag in ("article", "main") else named)
    body = top + wrap + (holder,)
    out, labels = [], []

    def boiler() -> None:
        word = pick(BOILERPLATE)
        place = (word,) if word in ("nav", "header", "footer", "aside", "form") else _named("div", f'class="{word}"')
        if silent and rng.random() < 0.5:
            place = _named("div", f'class="{bare()}"')
        elif rng.random() < 0.1:
            place = _named("div", f'class="{thread}"')
        # a container beside the text, or inside its holder
        base = body if rng.random() < 0.5 else top + wrap
        inner = (("p",), ("p",), ("li",), ("div",))[rng.integers(4)]
        for _ in range(int(rng.integers(1, 7))):
            _, text, linked = other[rng.integers(len(other))]
            out.append((base + (place, inner) if rng.random() < 0.7 else base + (place,), text, linked))
            labels.append(0)

    for _ in range(int(rng.integers(0, 4))):
        boiler()
    for i, (_, text, linked) in enumerate(core):
        kind = ("h1",) if i == 0 and rng.random() < 0.6 else (("p",), ("p",), ("li",), ("div",), ("h2",))[rng.integers(5)]
        out.append((body + (kind,) if rng.random() < 0.9 else body, text, linked))
        labels.append(1)
        if rng.random() < 0.12:
            boiler()
    for _ in range(int(rng.integers(0, 4))):
        boiler()
    return out, labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """A bidirectional LSTM with a logistic output for each position."""

    def __init__(self, dim: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = rng.standard_normal((dim, 4 * hidden)) / np.sqrt(dim)
            self.p["u" + d] = rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)
            self.p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden)
        self.p["o"] = rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)
        self.p["q"] = np.zeros(dim)  # direct input to output
        self.p["z"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """Hidden states [time, batch, hidden] and what the way back needs."""
        n = self.hidden
        pre = x @ self.p["w" + d] + self.p["c" + d]
        h, c = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
        states, trace = np.zeros((*x.shape[:2], n)), []
        for t in (range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)):
            g = pre[t] + h @ self.p["u" + d]
            s, a = _sigmoid(g[:, :3 * n]), np.tanh(g[:, 3 * n:])
            i, f, o = s[:, :n], s[:, n:2 * n], s[:, 2 * n:]
            keep = mask[t][:, None]
            new = np.where(keep, f * c + i * a, c)
            trace.append((t, h, c, i, f, o, a, new))
            th = np.tanh(new)
            h, c = np.where(keep, o * th, h), new
            states[t] = h
        return states, trace

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], axis=2)
        return both @ self.p["o"] + x @ self.p["q"] + self.p["z"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        diff = (_sigmoid(both @ self.p["o"] + x @ self.p["q"] + self.p["z"]) - y) * mask / mask.sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.einsum("tb,tbh->h", diff, both)
        g["q"] = np.einsum("tb,tbd->d", diff, x)
        g["z"] = diff.sum(keepdims=True).ravel()
        n = self.hidden
        for k, d in enumerate("fb"):
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            dpre = np.zeros((*x.shape[:2], 4 * n))
            out = self.p["o"][k * n:(k + 1) * n]
            for t, h, c, i, f, o, a, new in reversed(runs[d][1]):
                keep = mask[t][:, None]
                dh = dh + diff[t][:, None] * out
                th = np.tanh(new)
                dnew = np.where(keep, dh * o * (1 - th ** 2), 0) + dc
                dg = np.concatenate([dnew * a * i * (1 - i), dnew * c * f * (1 - f), dh * th * o * (1 - o),
                                     dnew * i * (1 - a ** 2)], axis=1) * keep
                dpre[t] = dg
                g["u" + d] += h.T @ dg
                dh = np.where(keep, dg @ self.p["u" + d].T, dh)
                dc = np.where(keep, dnew * f, dnew)
            g["w" + d] = np.einsum("tbd,tbg->dg", x, dpre, optimize=True)
            g["c" + d] = dpre.sum(axis=(0, 1))
        return g


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, seqs))
    x = np.zeros((longest, len(seqs), seqs[0].shape[1]))
    mask = np.zeros((longest, len(seqs)), bool)
    for i, s in enumerate(seqs):
        x[:len(s), i], mask[:len(s), i] = s, True
    return x, mask


def train(pages: list[list], epochs: int = 16, batch: int = 64, rate: float = 0.02, seed: int = 3,
          places: list[tuple[int, int]] | None = None) -> BiLstm | None:
    """Fit on the weak labels of ``pages`` and of re-templated forms of them;
    None if they have no block.  ``places`` are the first block and the number
    of blocks of the pages that are windows of longer ones."""
    net = BiLstm(PATH_DIM + WORD_DIM + 5)
    kept = [(p, at) for p, at in zip(pages, places or [(0, len(p)) for p in pages]) if p]
    pages = [p for p, _ in kept]
    if not pages:
        return None
    rng = np.random.default_rng(seed)
    data = [(p, [weak_label(b) for b in p], at) for p, at in kept]
    data += [(*retemplated(rng, pages), (0, None)) for _ in range(max(500, 2 * len(pages)))]
    runs = [int(rng.integers(max(1, len(b) - WINDOW_BLOCKS + 1))) for b, _, _ in data]
    data = [(features(b, *at)[r:r + WINDOW_BLOCKS], np.array(y[r:r + WINDOW_BLOCKS])) for (b, y, at), r in zip(data, runs)]
    data.sort(key=lambda d: len(d[0]))
    groups = [data[i:i + batch] for i in range(0, len(data), batch)]
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[i]])
            y = np.zeros(mask.shape)
            for j, d in enumerate(groups[i]):
                y[:len(d[1]), j] = d[1]
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                net.p[k] -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> BiLstm | None:
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.length("html") > 0)
    n = rows.count()
    picked = row_sample(rows, "id", n, SAMPLE_PAGES).limit(2 * SAMPLE_PAGES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [json.dumps(window(h.decode("utf-8", "replace"))) for h in utf8(batch, "html")]
        return pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["cut"])

    got = [json.loads(r["cut"]) for r in sorted(map_arrow(picked.select("html"), run, "cut string").collect())]
    pages = [[(tuple(map(tuple, path)), text, linked) for path, text, linked in found] for found, _, _ in got]
    return train(pages, places=[(first, total) for _, first, total in got])


def label(net: BiLstm | None, pages: list[list]) -> list[np.ndarray]:
    """Which blocks of each page are content; pages of similar length are read
    together.  Without a network the weak labels decide."""
    if net is None:
        return [np.array([weak_label(b) for b in p], bool) for p in pages]
    out: list = [np.zeros(0, bool)] * len(pages)
    order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if pages[i]]
    for at in range(0, len(order), 64):
        some = order[at:at + 64]
        x, mask = _padded([features(pages[i]) for i in some])
        logit = net.logits(x, mask)
        for j, i in enumerate(some):
            out[i] = logit[:len(pages[i]), j] > 0
    return out


def extract(df: DataFrame, net: BiLstm | None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``[page_id, url, text, n_chars]`` for every row."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    shared = df.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pages = [blocks((h or b"").decode("utf-8", "replace")) for h in utf8(batch, "html")]
        texts = [" ".join(b[1] for b, keep in zip(p, content) if keep) for p, content in zip(pages, label(shared.value, pages))]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return map_arrow(rows, run, f"page_id {kind}, url string, text string, n_chars bigint")
