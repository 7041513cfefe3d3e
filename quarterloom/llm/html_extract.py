"""Main-text extraction with a recurrent block labeller.

Method: a page's leaf blocks, in page order, become vectors: hashed tags of their path from
the root, all its words hashed, and a few shapes (length, share of linked text). A bidirectional
LSTM in numpy reads the whole sequence, so that each block is judged in the context of
the document, and labels it main text or not. It is trained here, by the driver, on
pages that this module generates with known labels (GENERATED_PAGES of them, fixed seed).

Markup, scripts, styles and comments never become blocks. Other elements without text to
read (forms' parts, drawings) are left out if they end inside their parent; one that doesn't is
only a stray tag, and what follows it is read. Each page is handled by
itself, in batches of similar length; nothing is shuffled.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GENERATED_PAGES = 1500
TAG_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 48, 32, 6, 16
DIM = TAG_DIM + WORD_DIM + SHAPE_DIM
#: Passes over the generated pages, and pages of one training step.
EPOCHS, STEP_PAGES = 14, 32
#: Blocks of one matrix when pages are labelled.
BATCH_BLOCKS = 4096

#: Elements that hold no text to read.
SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas select textarea button".split())
#: Of those, the ones whose text runs to their end tag, or else to the page's end.
RAW = frozenset(("script", "style"))
#: And those that hold nothing but text.
TEXT_ONLY = frozenset(("title", "textarea", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of the key closes an open element of the values first.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^\s>/]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def skipped_to(page: str, at: int, el: str, around: set[str]) -> int | None:
    """Where the skipped element that opens before ``at`` ends; None if it isn't closed inside its parent.

    ``around`` are the open elements: the end tag of one of them, unless it belongs to an
    element opened inside, comes too late for this one.
    """
    end = re.compile(rf"</{re.escape(el)}\b[^>]*>", re.I)
    if el in RAW:
        m = end.search(page, at)
        return m.end() if m else len(page)
    if el in TEXT_ONLY:
        m = end.search(page, at)
        again = re.compile(rf"<{re.escape(el)}\b", re.I).search(page, at, m.start()) if m else None
        if m is None or again:
            return None
        closing = re.compile(r"</([a-zA-Z][^\s>/]*)")
        return None if any(c[1].lower() in around and c[1].lower() not in INLINE for c in closing.finditer(page, at, m.start())) else m.end()
    inside: list[str] = []
    while (m := _TOKEN.search(page, at)) is not None:
        at = m.end()
        tag = m.group()
        name = _NAME.match(tag)
        if name is None:
            continue
        other = name[1].lower()
        if tag[1] == "/":
            if other in inside:
                while inside.pop() != other:
                    pass
            elif other == el:
                return at
            elif other in around and other not in INLINE:
                return None
        elif other in RAW:
            at = skipped_to(page, at, other, around)
        elif other not in VOID and other not in INLINE and not tag.endswith("/>"):
            inside.append(other)
    return None


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[str, ...], linked: float) -> None:
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: white space joined, references decoded, empties left out."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # (element, element with its class, id and role words)
    parts: list[str] = []
    inline_links = linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(_html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.append(Block(text, tuple(s[1] for s in stack), min(1.0, linked / max(len(text), 1))))
        parts.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if inline_links:
                linked += len(piece)
        at = m.end()
        tag = m.group()
        name = _NAME.match(tag)
        if name is None:
            if tag.startswith("<![CDATA["):
                parts.append(_html.escape(tag[9:-3] if tag.endswith("]]>") else tag[9:]))
            continue
        el = name[1].lower()
        if tag[1] == "/":
            if el == "a":
                inline_links = max(0, inline_links - 1)
            if el in INLINE:
                continue
            if any(s[0] == el for s in stack):
                flush()
                while stack.pop()[0] != el:
                    pass
            elif el == "p":
                flush()
            continue
        if el in SKIPPED:
            if not tag.endswith("/>"):
                at = skipped_to(page, at, el, {s[0] for s in stack}) or at
            continue
        if el == "a":
            inline_links += 1
        if el in INLINE:
            continue
        flush()
        inline_links = 0 if el != "a" else inline_links
        if el in VOID:
            continue
        while stack and stack[-1][0] in CLOSES.get(el, ()):
            stack.pop()
        if not tag.endswith("/>"):
            words = " ".join(a or b or c for _, a, b, c in _ATTR.findall(tag)).lower()
            stack.append((el, f"{el} {words}" if words else el))
    flush()
    return out


@lru_cache(maxsize=200_000)
def _bucket(kind: str, word: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode("utf-8", "surrogatepass")) % size


def vectors(bs: list[Block]) -> np.ndarray:
    """One row a block: hashed tag path, hashed words, shapes."""
    x = np.zeros((len(bs), DIM), dtype=np.float32)
    for i, b in enumerate(bs):
        for depth, el in enumerate(reversed(b.path)):
            tag, *names = el.split(" ")
            x[i, _bucket("tag", tag, TAG_DIM)] += 1.0 if depth < 2 else 0.7
            for w in {w for name in names for w in re.split(r"[^a-z]+", name) if w}:
                x[i, _bucket("name", w, TAG_DIM)] += 1.0
        words = b.text.lower().split()
        for w in words:
            x[i, TAG_DIM + _bucket("word", w.strip(".,;:!?()"), WORD_DIM)] += 1.0 / len(words)
        n = len(b.text)
        x[i, TAG_DIM + WORD_DIM :] = (min(n, 400) / 400, min(n, 40) / 40, b.linked, float(b.text[-1] in ".!?:\"'”»"), i / max(len(bs), 1), float("©" in b.text[:3]))
    return x


# ---- the labeller ---------------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output a step."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = params

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        p = {}
        for d in "fb":
            p[f"w{d}"] = rng.normal(0, 0.15, (DIM + HIDDEN, 4 * HIDDEN))
            p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["wo"], p["bo"] = rng.normal(0, 0.15, (2 * HIDDEN + DIM,)), np.zeros(1)
        return Labeller(p)

    def _stacked(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input weights, recurrent weights and biases of both directions."""
        w = np.stack([self.p["wf"], self.p["wb"]]).astype(kind)
        return w[:, :DIM], w[:, DIM:], np.stack([self.p["cf"], self.p["cb"]]).astype(kind)

    def _run(self, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of both directions, step by step together: the second reads backwards."""
        n, steps, _ = x.shape
        win, rec, bias = self._stacked(x.dtype.type)
        pre = np.stack([x @ win[0] + bias[0], x[:, ::-1] @ win[1] + bias[1]])
        masks = np.stack([mask, mask[:, ::-1]])
        h = c = np.zeros((2, n, HIDDEN), x.dtype)
        out, tape = np.zeros((2, n, steps, HIDDEN), x.dtype), []
        for t in range(steps):
            z = pre[:, :, t] + h @ rec
            ifo, g = _sigmoid(z[..., : 3 * HIDDEN]), np.tanh(z[..., 3 * HIDDEN :])
            i, f, o = ifo[..., :HIDDEN], ifo[..., HIDDEN : 2 * HIDDEN], ifo[..., 2 * HIDDEN :]
            m = masks[:, :, t, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, :, t] = h
        return out, tape

    @staticmethod
    def _features(out: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.concatenate([out[0], out[1, :, ::-1], x], axis=2)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feat = self._features(self._run(x, mask, False)[0], x)
        return feat @ self.p["wo"].astype(x.dtype) + self.p["bo"].astype(x.dtype)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients, by back-propagation through time."""
        out, tape = self._run(x, mask, True)
        feat = self._features(out, x)
        wo = self.p["wo"].astype(x.dtype)
        p = _sigmoid(feat @ wo + self.p["bo"].astype(x.dtype))
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        e = mask * (p - y) / total
        g = {"wo": np.tensordot(e, feat, axes=([0, 1], [0, 1])), "bo": np.array([e.sum()])}
        _, rec, _ = self._stacked(x.dtype.type)
        xs, errors = np.stack([x, x[:, ::-1]]), np.stack([e, e[:, ::-1]])
        to_hidden = np.stack([wo[:HIDDEN], wo[HIDDEN : 2 * HIDDEN]])[:, None, :]
        dzs = np.zeros((2, len(x), x.shape[1], 4 * HIDDEN), x.dtype)
        dh = dc = np.zeros((2, len(x), HIDDEN), x.dtype)
        grec = np.zeros_like(rec)
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, i, f, o, gg, tc, m = tape[t]
            dh = dh + errors[:, :, t, None] * to_hidden
            dhm, dcm = dh * m, dc * m
            dct = dcm + dhm * o * (1 - tc * tc)
            dz = dzs[:, :, t]
            dz[..., :HIDDEN] = dct * gg * i * (1 - i)
            dz[..., HIDDEN : 2 * HIDDEN] = dct * c * f * (1 - f)
            dz[..., 2 * HIDDEN : 3 * HIDDEN] = dhm * tc * o * (1 - o)
            dz[..., 3 * HIDDEN :] = dct * i * (1 - gg * gg)
            grec += h.transpose(0, 2, 1) @ dz
            dh = dz @ rec.transpose(0, 2, 1) + dh * (1 - m)
            dc = dct * f + dc * (1 - m)
        for k, d in enumerate("fb"):
            g[f"w{d}"] = np.concatenate([np.tensordot(xs[k], dzs[k], axes=([0, 1], [0, 1])), grec[k]])
            g[f"c{d}"] = dzs[k].sum(axis=(0, 1))
        return float(loss), g


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x, mask = np.zeros((len(seqs), steps, seqs[0].shape[1]), seqs[0].dtype), np.zeros((len(seqs), steps), seqs[0].dtype)
    for i, s in enumerate(seqs):
        x[i, : len(s)], mask[i, : len(s)] = s, 1
    return x, mask


# ---- generated training pages -----------------------------------------------------------

_SYLLABLES = "an ar be co da de el en er es fi ga he in is ka la le li ma mi na ne no on or pa que re ri ro sa se si ta te ti tion to un ve vi".split()


def _words(rng: random.Random, n: int) -> str:
    w = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    style = rng.random()
    if style < 0.1:
        w = [x + rng.choice(["***", "&amp;&amp;", "%%%", "!!"]) for x in w]
    elif style < 0.2:
        w = [x.upper() for x in w]
    return " ".join(w).capitalize()


def _sentence(rng: random.Random) -> str:
    return _words(rng, rng.randint(1, 30)) + rng.choice([".", ".", ".", "!", "?", "", "…"])


def generated_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and the blocks of its main text."""
    short = lambda: _words(rng, rng.randint(1, 5))
    links = lambda: "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(rng.randint(2, 9)))
    wrap = rng.choice(["div", "section", "aside"])
    noise = {
        "nav": lambda: f'<nav{rng.choice(["", " class=menu", " id=main-nav"])}><ul>{links()}</ul></nav>',
        "menu": lambda: f'<div class="{rng.choice(["menu", "navbar", "breadcrumbs", "topnav"])}"><ul>{links()}</ul></div>',
        "header": lambda: f"<header><{rng.choice(['h1', 'p', 'div'])}>{short()}</header>",
        "ad": lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "ad-banner", "promo"])}">{_sentence(rng)}</div>',
        "notice": lambda: f'<div class="{rng.choice(["cookie", "notice", "consent", "cookie-banner", "gdpr", "newsletter", "popup"])}"><p>{_sentence(rng)}</p></div>',
        "form": lambda: f"<form><label>{short()}</label> <input name=q><p>{_sentence(rng)}</p></form>",
        "side": lambda: f'<{wrap} class="{rng.choice(["sidebar", "related", "widget", "share", "social"])}"><h3>{short()}</h3><ul>{links()}</ul><p>{_sentence(rng)}</p></{wrap}>',
        "aside": lambda: f"<aside><h4>{short()}</h4><p>{_sentence(rng)}</p></aside>",
        "comments": lambda: f'<{rng.choice(["section", "div"])} {rng.choice(["id", "class"])}="{rng.choice(["comments", "comment-list", "replies", "discussion"])}">' + "".join(f'<{rng.choice(["div", "p"])} class="comment">{_sentence(rng)} {_sentence(rng)}' for _ in range(rng.randint(1, 6))) + "</div></section>",
        "footer": lambda: f"<footer>{rng.choice(['&copy; ', '', '© 2020 '])}{short()} {rng.choice(['&middot; ', '| ', ''])}{_sentence(rng)}</footer>",
        "bottom": lambda: f'<div class="{rng.choice(["footer", "copyright", "site-info"])}"><p>{_sentence(rng)}</p></div>',
    }
    main: list[str] = []
    body = []

    def add(fmt: str, text: str) -> None:
        body.append(fmt.format(text))
        if plain := " ".join(_html.unescape(re.sub(r"<[^>]*>", "", text)).split()):
            main.append(plain)

    add(rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<h1 class=title>{}</h1>"]), _words(rng, rng.randint(1, 14)))
    for _ in range(rng.choice([rng.randint(0, 14), rng.randint(0, 14), rng.randint(20, 60)])):
        k = rng.random()
        text = _words(rng, rng.randint(1, 3)) + rng.choice([".", "", "!"]) if rng.random() < 0.2 else " ".join(_sentence(rng) for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.2:
            text = text.replace(" ", f' <a href="/x">{short()}</a> ', 1)
        add("<p>{}</p>" if k < 0.6 else "<p><b>{}<br>" if k < 0.7 else "<p>{}" if k < 0.75 else "<h2>{}</h2>" if k < 0.82 else "<ul><li>{}</li></ul>" if k < 0.88 else "<blockquote>{}</blockquote>" if k < 0.92 else "<div>{}</div>" if k < 0.96 else "<pre>{}</pre>", text)
        if rng.random() < 0.05:
            body.append(noise[rng.choice(["ad", "aside", "side", "form"])]())
    inner = "".join(body)
    outer = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="article" class="post">{}</div>', '<div class="entry-content">{}</div>'])
    before = [noise[k]() for k in ("header", "nav", "menu", "ad", "notice", "form", "side") if rng.random() < (0.7 if k == "nav" else 0.35)]
    after = [noise[k]() for k in ("comments", "side", "aside", "ad", "form", "notice", "menu", "footer", "bottom") if rng.random() < (0.8 if k == "footer" else 0.25)]
    rng.shuffle(before)
    page = f'<!DOCTYPE html><html><head><title>{short()}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>' + "".join(before) + outer.format(inner) + "".join(after)
    return page + rng.choice(["</body></html>", ""]), main


def labelled_page(rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    page, main = generated_page(rng)
    bs, y, at = blocks(page), [], 0
    for b in bs:
        hit = at < len(main) and b.text == main[at] and not any(re.search(r"\b(nav|aside|form|footer|header)\b", el) for el in b.path)
        at += hit
        y.append(float(hit))
    return vectors(bs), np.array(y, dtype=np.float32)


@lru_cache(maxsize=2)
def trained(pages: int = GENERATED_PAGES, seed: int = 5) -> Labeller:
    """The labeller, trained by Adam on generated pages; the same for the same arguments."""
    rng = random.Random(seed)
    data = sorted((labelled_page(rng) for _ in range(pages)), key=lambda d: len(d[0]))
    groups = [data[i : i + STEP_PAGES] for i in range(0, len(data), STEP_PAGES)]
    model = Labeller.fresh(np.random.default_rng(seed))
    m, v, step = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(3))
    t = 0
    for epoch in range(EPOCHS):
        rate = 0.025 * 0.78**epoch
        rng.shuffle(groups)
        for g in groups:
            x, mask = _padded([d[0] for d in g])
            y = _padded([d[1][:, None] for d in g])[0][:, :, 0]
            _, grad = model.gradients(x, mask, y)
            t += 1
            for k, gk in grad.items():
                gk = np.clip(gk, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                model.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Labeller({k: x.astype(np.float32) for k, x in model.p.items()})


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """The main text of each page: its kept blocks, joined by line feeds."""
    parsed = [blocks(p) for p in pages]
    keep: list[np.ndarray | None] = [None] * len(pages)
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    group: list[int] = []
    for k, i in enumerate(order):
        group.append(i)
        size = len(parsed[order[k + 1]]) if k + 1 < len(order) else 0
        if not size or size * (len(group) + 1) > BATCH_BLOCKS:
            x, mask = _padded([vectors(parsed[j]) for j in group])
            z = model.logits(x, mask)
            for r, j in enumerate(group):
                keep[j] = z[r, : len(parsed[j])] > 0
            group = []
    return ["\n".join(b.text for b, k in zip(bs, ks, strict=True) if k) if ks is not None else "" for bs, ks in zip(parsed, keep, strict=True)]


def extract(df: DataFrame, html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """Replace the html by ``text`` and ``n_chars`` (code points); other columns stay.

    Defined cases: null and empty html give empty text; a page is read whole, however
    long, with as many steps as it has blocks; repeated rows get equal texts; columns named
    text or n_chars are replaced; an empty table gives none.
    """
    params = (model or trained()).p
    keep = [f.name for f in df.schema.fields if f.name not in (html_col, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Labeller(params)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = main_texts(part.column(len(keep)).to_pylist(), m)
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    cols = [F.col(f"`{c}`") for c in keep]
    schema = df.select(*cols, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return df.select(*cols, F.col(html_col).alias("__html")).mapInArrow(run, schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
