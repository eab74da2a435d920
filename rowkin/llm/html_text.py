"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: the text between block-level tags, in page order. Each block is read as a vector of its tag path (tags, and the words of
class, id and role on the way down, hashed), of its hashed words, of how many elements opened and closed before it, and of a few shares. A bidirectional LSTM in numpy passes
over the whole sequence, so a block's label depends on all that stands before and behind it on the page; blocks labelled as main text are joined.

The labeller is trained in the session on at most ``SAMPLE`` pages of the table, and ``CHARS`` characters of them, drawn by a hash on every size alike. Their labels come from pages
that say themselves what is what (article or main, navigation, footer and so on), and from the same content laid out anew, with sidebars, notices,
forms, adverts and reader comments among it. So that the labeller does not lean on these names, most pages are read for training with their names hidden: tags such as article or footer
as div, class words dropped or replaced by invented ones; the labels stay. Without a page of the first kind in the sample, generated pages alone train it.

Scripts, styles, comments of the markup and the like are no text. Character references are decoded; white space inside a block becomes one space.

Defined cases: null and empty pages have an empty text, as have pages without main text; null ids and urls are carried; repeated rows are each extracted; an empty
table gives an empty result; extra columns are ignored; markup that does not close or nest is read as far as it goes, in time that grows with its length.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import small_batches, table

#: Pages to train on, characters of one, and of all together.
SAMPLE, LONGEST, CHARS, SEED = 400, 100_000, 8_000_000, 7
PATHS, WORDS, SHARES, HIDDEN = 64, 32, 13, 24
EPOCHS, BATCH, RATE = 9, 12, 0.012

_BLOCK = set("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_SILENT = "script|style|noscript|template|svg|iframe|object"
_VOID = {"hr"}
_PARTS = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<silent>{_SILENT})\b[^>]*>.*?(?:</(?P=silent)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_SPACE = re.compile(r"\s+")
#: Parts of a page that are not its main text, by tag or by a word of class, id or role.
ASIDE = ("nav", "menu", "header", "footer", "aside", "sidebar", "notice", "cookie", "banner", "ad", "ads", "advert", "sponsored", "promo", "form", "comment", "comments", "reply", "related", "share", "social", "subscribe", "newsletter", "login", "search", "breadcrumb", "widget", "head", "title", "button", "select", "popup", "disclaimer", "copyright")
MAIN = ("article", "main")


#: Tags that say what a part is; hidden in most pages to train on.
_TELLING = set("article main nav menu header footer aside section form address".split())


class Path:
    """The open block-level elements at a place of a page: the last one's tag, whether one of all is a main part or is set aside, and their hashed words as counts.

    ``shown`` is what the counts read, the element's own tag and words or others.
    """

    __slots__ = ("tag", "main", "aside", "depth", "counts", "below", "_vector")

    def __init__(self, parent: Path | None = None, tag: str = "", words: tuple[str, ...] = (), shown: tuple[str, ...] = ()):
        self.tag, self.below, self._vector = shown[0] if shown else tag, {}, None
        self.main, self.aside, self.depth = tag in MAIN, tag in ASIDE or any(w in ASIDE for w in words), 0
        if parent is None:
            self.counts = np.zeros(PATHS, np.float32)
            return
        self.main, self.aside, self.depth, self.counts = self.main or parent.main, self.aside or parent.aside, parent.depth + 1, parent.counts.copy()
        for w in shown:
            self.counts[zlib.crc32(w.encode()) % (PATHS - 16)] += 1

    @property
    def vector(self) -> np.ndarray:
        if self._vector is None:
            self._vector = np.log1p(self.counts) * np.float32(1.4)
            self._vector[PATHS - 16 + zlib.crc32(self.tag.encode()) % 16] = 1
        return self._vector


@dataclass
class Block:
    path: Path
    text: str
    linked: int  # characters in links
    opened: int  # block-level elements since the block before
    closed: int


_top = Path()
_paths = 0  # below _top


def blocks_of(page: str | None, shown=None) -> list[Block]:
    """The leaf blocks of a page, in order. ``shown``: for training, the words to read in the place of an element's tag and class, id and role words."""
    global _top, _paths
    if _paths > 20_000:
        _top, _paths = Path(), 0
    out: list[Block] = []
    stack, path, open_tags = [], Path() if shown else _top, Counter()
    parts: list[str] = []
    linked, inside, opened, closed = 0, False, 0, 0

    def flush():
        nonlocal linked, opened, closed
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(path, text, linked, opened, closed))
                opened = closed = 0
            parts.clear()
        linked = 0

    def close(n: int):
        """Leave the last n open elements."""
        nonlocal path, closed
        for _ in range(n):
            tag, path = stack.pop()
            open_tags[tag] -= 1
        closed += n

    for m in _PARTS.finditer(page or ""):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if inside:
                linked += len(text)
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if tag == "a":
                inside = not m["close"]
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m["close"]:
            if open_tags[tag]:
                close(next(n for n, (t, _) in enumerate(reversed(stack), 1) if t == tag))
        elif tag not in _VOID:
            if stack and (stack[-1][0] == tag and tag in ("p", "li", "option", "dd", "dt", "td", "th") or stack[-1][0] == "p"):
                close(1)
            words = tuple(x for v in _NAMES.findall(m["rest"]) for x in re.findall("[a-z]+", v.lower())) if m["rest"] else ()
            stack.append((tag, path))
            open_tags[tag] += 1
            opened += 1
            if (below := path.below.get((tag, words))) is None:
                below = path.below[tag, words] = Path(path, tag, words, shown(tag, words) if shown else (tag, *words))
                _paths += not shown
            path = below
    flush()
    return out


def hidden(rnd: random.Random):
    """A way to show the elements of a page to train on: as they are, or telling tags as div and words kept, dropped or replaced by invented ones."""
    way = rnd.choices(("plain", "kept", "dropped", "invented"), (3, 2, 3, 2))[0]
    instead: dict[str, str] = {}
    neutral = rnd.choice(("div", "div", "section"))

    def shown(tag: str, words: tuple[str, ...]) -> tuple[str, ...]:
        if way == "plain":
            return tag, *words
        tag = neutral if tag in _TELLING else tag
        if way == "kept":
            return tag, *words
        return (tag, *(instead.setdefault(w, f"w{rnd.randrange(10**6)}") for w in words)) if way == "invented" else (tag,)

    return shown


_word_cache: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _word_cache.get(word)
    if found is None:
        found = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS
        if len(_word_cache) < 200_000 and len(word) <= 32:
            _word_cache[word] = found
    return found


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """A matrix for each page, one row for each block."""
    every = [b for page in pages for b in page]
    words = [b.text.split() for b in every]
    n = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(every)), n)
    bags = np.bincount(owner * WORDS + np.fromiter((_bucket(w) for row in words for w in row), np.int64, int(n.sum())), minlength=len(every) * WORDS).reshape(-1, WORDS) / np.maximum(n, 1)[:, None] * 4
    chars = np.array([len(b.text) for b in every], np.int64)
    place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p] or [np.zeros(0)])
    stops = np.array([sum(w[-1] in ".,;:!?" for w in row) for row in words]) if every else np.zeros(0)
    of_block = np.array([(b.linked, b.opened, b.closed, b.path.depth) for b in every], np.float32).reshape(-1, 4)
    shares = np.column_stack([np.log1p(n) / 3, np.log1p(chars) / 5, of_block[:, 0] / np.maximum(chars, 1), stops / np.maximum(n, 1), place, np.ones(len(every)), np.log1p(of_block[:, 1:]), of_block[:, 1:3] >= 2, of_block[:, 1:3] >= 3]) if every else np.zeros((0, SHARES))
    paths = np.array([b.path.vector for b in every]).reshape(-1, PATHS)
    rows = np.concatenate([paths, bags, shares], axis=1).astype(np.float32)
    return np.split(rows, np.cumsum([len(p) for p in pages])[:-1]) if pages else []


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, width: int = PATHS + WORDS + SHARES, hidden: int = HIDDEN, seed: int = SEED):
        rnd = np.random.default_rng(seed)
        draw = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.weights = {}
        for d in "fb":
            self.weights |= {f"{d}x": draw(width, 4 * hidden), f"{d}h": draw(hidden, 4 * hidden), f"{d}0": np.zeros(4 * hidden, np.float32)}
            self.weights[f"{d}0"][hidden : 2 * hidden] = 1  # remember at first
        self.weights |= {"o": draw(2 * hidden, 1)[:, 0], "o0": np.zeros(1, np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """One direction over x (pages, blocks, width); states after each block, and what the way back needs."""
        w, size = self.weights, self.hidden
        inputs = x @ w[f"{d}x"] + w[f"{d}0"]
        h = c = np.zeros((x.shape[0], size), np.float32)
        states, steps = np.zeros((*x.shape[:2], size), np.float32), []
        for t in range(x.shape[1]):
            z = inputs[:, t] + h @ w[f"{d}h"]
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            on = mask[:, t, None]
            new = (f * c + i * g) * on
            tc = np.tanh(new)
            if keep:
                steps.append((h, c, i, f, o, g, tc, on))
            h, c = o * tc * on, new
            states[:, t] = h
        return states, steps

    def _back(self, x: np.ndarray, steps: list, d: str, above: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        wide = np.zeros((*x.shape[:2], 4 * self.hidden), np.float32)
        dh = dc = np.zeros((x.shape[0], self.hidden), np.float32)
        gh = np.zeros_like(w[f"{d}h"])
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, i, f, o, g, tc, on = steps[t]
            dh = (dh + above[:, t]) * on
            dn = (dc + dh * o * (1 - tc * tc)) * on
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - g * g)], axis=1)
            wide[:, t] = dz
            gh += h.T @ dz
            dh, dc = dz @ w[f"{d}h"].T, dn * f
        flat = wide.reshape(-1, wide.shape[2])
        return {f"{d}x": x.reshape(-1, x.shape[2]).T @ flat, f"{d}h": gh, f"{d}0": flat.sum(axis=0)}

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        """Both directions of pages of unequal length: the second has each page's blocks from its end."""
        size = max(map(len, pages))
        x = np.zeros((len(pages), size, pages[0].shape[1]), np.float32)
        back, mask = np.zeros_like(x), np.zeros(x.shape[:2], np.float32)
        for k, p in enumerate(pages):
            x[k, : len(p)], back[k, : len(p)], mask[k, : len(p)] = p, p[::-1], 1
        return x, back, mask

    @staticmethod
    def _turned(states: np.ndarray, lengths: list[int]) -> np.ndarray:
        out = np.zeros_like(states)
        for k, n in enumerate(lengths):
            out[k, :n] = states[k, :n][::-1]
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of each block to be main text."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):  # pages of like length together, at most 64 pages and about 20,000 blocks
            to = at + 1
            while to < len(order) and to - at < 64 and (to + 1 - at) * len(pages[order[to]]) <= 20_000:
                to += 1
            part = [pages[k] for k in order[at:to]]
            x, back, mask = self._padded(part)
            lengths = list(map(len, part))
            both = np.concatenate([self._pass(x, mask, "f", False)[0], self._turned(self._pass(back, mask, "b", False)[0], lengths)], axis=2)
            p = _sigmoid(both @ self.weights["o"] + self.weights["o0"])
            for k, i in enumerate(order[at:to]):
                out[i] = p[k, : lengths[k]]
            at = to
        return out

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks, and its gradients."""
        x, back, mask = self._padded(pages)
        lengths, n = list(map(len, pages)), mask.sum()
        y = np.zeros(mask.shape, np.float32)
        for k, l in enumerate(labels):
            y[k, : len(l)] = l
        ahead, steps = self._pass(x, mask, "f", True)
        behind, steps_b = self._pass(back, mask, "b", True)
        both = np.concatenate([ahead, self._turned(behind, lengths)], axis=2)
        p = _sigmoid(both @ self.weights["o"] + self.weights["o0"])
        loss = float(-((y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)) * mask).sum() / n)
        dy = (p - y) * mask / n
        above = dy[:, :, None] * self.weights["o"]
        found = {"o": np.einsum("ptw,pt->w", both, dy), "o0": dy.sum(keepdims=True)[0]}
        found |= self._back(x, steps, "f", above[:, :, : self.hidden])
        found |= self._back(back, steps_b, "b", self._turned(above[:, :, self.hidden :], lengths))
        return loss, found

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam over shuffled batches of pages of like length; the rate falls to zero."""
        rnd, step = random.Random(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        order = [k for k in range(len(pages)) if len(pages[k])]
        total = epochs * -(-len(order) // BATCH)
        for _ in range(epochs):
            rnd.shuffle(order)
            order.sort(key=lambda k: len(pages[k]))
            batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
            rnd.shuffle(batches)
            for chosen in batches:
                _, found = self.gradients([pages[k] for k in chosen], [labels[k] for k in chosen])
                step += 1
                rate = RATE * (1 - (step - 1) / total)
                for name, g in found.items():
                    g = np.clip(g, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.weights[name] = (self.weights[name] - rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its own parts: main text is inside article or main and in no part that is set aside. None without such a mark."""
    if not any(b.path.main for b in blocks):
        return None
    return np.array([b.path.main and not b.path.aside for b in blocks], np.float32)


_INVENTED = "lorem ipsum dolor sit amet consectetur elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim minim veniam quis nostrud".split()


def layouts(texts: list[list[str]], rnd: random.Random, number: int) -> list[tuple[str, list[bool]]]:
    """Generated pages of the given articles' paragraphs in varied markup, with the label of each of their blocks."""
    pool = [p for t in texts for p in t] or [" ".join(rnd.choices(_INVENTED, k=rnd.randrange(8, 60))).capitalize() + "." for _ in range(50)]
    articles = [t for t in texts if t] or [rnd.sample(pool, rnd.randrange(1, 8)) for _ in range(20)]
    words = [w for p in pool[:500] for w in p.split()[:40]]
    short = lambda a, b: html.escape(" ".join(rnd.choices(words, k=rnd.randrange(a, b))))
    sentence = lambda: html.escape(" ".join(rnd.choice(pool).split()[: rnd.randrange(4, 40)]))
    out = []
    for _ in range(number):
        page: list[str] = []
        labels: list[bool] = []

        def put(markup: str, *said: bool, page=page, labels=labels):
            page.append(markup)
            labels.extend(said)

        def box(name: str, items: list[str], put=put):
            """A part set aside: by its own tag, or a div, section or ul with the name among its class or id words."""
            tag = name if name in ("nav", "header", "footer", "aside", "form") and rnd.random() < 0.7 else rnd.choice(("div", "section", "div"))
            if tag != name and rnd.random() < 0.4:  # a name never seen
                name = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 10)))
            attribute = "" if tag == name and rnd.random() < 0.6 else f' {rnd.choice(("class", "id", "class", "role"))}="{rnd.choice(("", "", "site-", "page-", "main-", "top ", "block "))}{name}{rnd.choice(("", "", "-box", " small", "-list", "-wrap"))}"'
            put(f"<{tag}{attribute}>")
            style = rnd.random()
            if style < 0.35:
                put("<ul>" + "".join(f'<li>{f"<a href=/{k}>{i}</a>" if rnd.random() < 0.7 else i}</li>' for k, i in enumerate(items)) + "</ul>", *[False] * len(items))
            elif style < 0.7:
                put("".join(f"<p>{i}</p>" for i in items), *[False] * len(items))
            elif style < 0.85:
                put("".join(f"<div>{i}</div>" for i in items), *[False] * len(items))
            else:
                put(" <br> ".join(items), False)
            put(f"</{tag}>")

        body = rnd.choice(("<body>", "<body>", "<body class=home>", "", "<body><div id=page>"))
        bare = rnd.random() < 0.12  # an article and nothing else
        if not bare or rnd.random() < 0.5:
            put(f"<!DOCTYPE html><html><head><title>{short(1, 9)}</title><script>var a='<p>';</script></head>", False)
        put(body)
        for name in () if bare else ("header", "nav", "menu", "breadcrumb", "notice", "cookie", "banner", "search", "ad"):
            if rnd.random() < 0.3:
                box(name, [short(1, 6) for _ in range(rnd.randrange(1, 7))] if rnd.random() < 0.6 else [sentence() for _ in range(rnd.randrange(1, 3))])
        frame = rnd.choice(("article", "main", "article", "article class=post", "article class=x id=y", "main id=content", "div class=content", "div class=post-body", "div class=article-text", "div id=main", "div class=entry", "div class=story", "section", "div", ""))
        if frame:
            put(f"<{frame}>")
        if rnd.random() < 0.85:
            head = rnd.choice(("h1", "h1", "h1", "h2", "div", "p"))
            put(f"<{head}>{short(3, 12)}</{head}>", True)
        paragraphs = rnd.choice(articles)
        chance = rnd.random()
        if chance < 0.15:  # a short article
            paragraphs = [" ".join(p.split()[: rnd.randrange(2, 12)]) for p in rnd.choices(paragraphs or pool, k=rnd.randrange(1, 4))]
        elif chance < 0.35:  # many short lines, some of them again and again
            paragraphs = [" ".join(p.split()[: rnd.randrange(1, 6)]) for p in rnd.choices(paragraphs or pool, k=rnd.randrange(1, 60))]
            paragraphs = [p if p.endswith(".") else p + "." for p in paragraphs if p]
        in_divs = rnd.random() < 0.15
        for k, p in enumerate(paragraphs):
            style = rnd.random()
            p = html.escape(p)
            put(f"<div>{p}</div>" if in_divs or 0.85 <= style < 0.9 else f"<p>{p}</p>" if style < 0.75 else f"<p><b>{p}<br>" if style < 0.85 else f"<h2>{p}</h2>" if len(p) < 80 else f"<blockquote>{p}</blockquote>", True)
            if k + 1 < len(paragraphs) and rnd.random() < 0.08:
                box(rnd.choice(("ad", "promo", "related", "newsletter", "advert", "share", "aside")), [sentence() for _ in range(rnd.randrange(1, 3))])
        if frame:
            put(f"</{frame.split()[0]}>")
        for name in () if bare else ("aside", "sidebar", "related", "share", "comments", "comment", "form", "subscribe", "ad", "notice", "footer"):
            if rnd.random() < (0.9 if name == "footer" else 0.3):
                box(name, [sentence() for _ in range(rnd.randrange(1, 6))] if name.startswith("comment") or rnd.random() < 0.4 else [short(1, 8) for _ in range(rnd.randrange(1, 6))])
        put("</body></html>")
        out.append(("".join(page), labels))
    return out


def fit(pages: list[str], seed: int = SEED) -> Labeller:
    """A labeller trained on sample pages and on twice as many generated ones, at least 300, from their content."""
    rnd = random.Random(seed)
    sequences, labels, texts = [], [], []
    for page in pages:
        blocks = blocks_of(page, hidden(rnd))
        own = own_labels(blocks)
        if own is not None:
            sequences.append(blocks)
            labels.append(own)
            texts.append([b.text for b, y in zip(blocks, own, strict=True) if y])
    for page, said in layouts(texts, rnd, max(300, 2 * len(texts))):
        blocks = blocks_of(page, hidden(rnd))
        if len(blocks) == len(said):
            sequences.append(blocks)
            labels.append(np.array(said, np.float32))
    return Labeller(seed=seed).train(vectors(sequences), labels)


def sample_of(pages: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` pages of up to ``LONGEST`` characters, and ``CHARS`` in all, drawn by a hash of id and content."""
    known = pages.select(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "html").alias("k"), "html").filter(F.length("html") <= LONGEST)
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("html")).alias("chars")).first()
    if not size["n"]:
        return []
    share = min(1.0, 1.2 * most / size["n"], 1.2 * CHARS / max(1, size["chars"]))
    # the limit holds where one page is repeated very often
    drawn = known.filter(F.pmod("k", F.lit(1 << 30)) < (int(share * (1 << 30)) or 1)).limit(2 * most).collect()
    out, left = [], CHARS
    for r in sorted(drawn)[:most]:
        left -= len(r["html"])
        if left >= 0:
            out.append(r["html"])
    return out


def extract(page_html: list[str | None], labeller: Labeller) -> list[str]:
    pages = [blocks_of(p) for p in page_html]
    return ["\n".join(b.text for b, s in zip(p, scores, strict=True) if s >= 0.5) for p, scores in zip(pages, labeller.scores(vectors(pages)), strict=True)]


def main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    model, kind = pages.sparkSession.sparkContext.broadcast(labeller), pages.schema["page_id"].dataType
    of_id = to_arrow_type(kind)

    def of_batch(batches):
        for b in batches:
            texts = []
            for at in range(0, b.num_rows, 128):
                texts += extract(b.column(2).slice(at, 128).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(of_id), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(of_batch, f"page_id {kind.simpleString()}, url string, text string, n_chars long")


def fitted(pages: DataFrame) -> Labeller:
    """A labeller for a table, trained on its sample in one task, whose arithmetic takes one core."""
    import pickle

    spark = pages.sparkSession
    sample = spark.sparkContext.broadcast(sample_of(pages))

    def train(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample.value).weights)], pa.binary())], ["weights"])

    labeller = Labeller()
    labeller.weights = pickle.loads(spark.range(0, 1, 1, 1).mapInArrow(train, "weights binary").first()["weights"])
    return labeller


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fitted(pages))
