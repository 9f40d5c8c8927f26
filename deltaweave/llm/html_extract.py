"""Operator 4: main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text that no block-level
tag interrupts, each with the path of its open tags. A block is a vector: the sum
of learned embeddings of the tags and the class, id and role words on its path and
of all its words, hashed. A bidirectional LSTM in numpy reads the whole
sequence, so each label depends on the blocks before and after it; labelled blocks are
joined.

The labeller is trained here by backpropagation through time on pages that are
made up from public HTML conventions (articles, menus, sidebars, notices, adverts,
forms, comments) and filled with words of a bounded sample of the real pages
(``sample`` rows). Some of the other parts say what such parts say on any site, with or
without telling names around them, so that words count where tags don't tell.

What is never text (comments, scripts, styles, templates, the head) is left out
by the reader, before labels. End tags that the standard lets out are supplied: a tag
or text that can't be in the head ends it, page content ends a drawing or a list of
options, and of other such elements that are never closed only the tag is left out.

Defined results: a null or empty page, and one without main text, gives the empty
string; stray tags end or open nothing else; a tag whose quote is left open ends at
its first ``>``; repeated rows get equal results; an empty table gives no rows. Extra
columns are carried untouched; ``into`` must not be one of them.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recurrent as rnn
from .shared import lean, row_blocks

# Element kinds of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea".split())
_RAW = frozenset("script style title textarea iframe".split())
_IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template".split())
_LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: An opening tag that ends an open one of the same group.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol dl table tbody thead tfoot div section article main body aside nav".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

_BLOCK = 4 << 20
_PATH_ROWS, _WORD_ROWS, _WIDTH, _HIDDEN = 3072, 8192, 24, 16
_TABLE = _PATH_ROWS + _WORD_ROWS


def _row(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode()) % _PATH_ROWS


def _word_row(word: str) -> int:
    return _PATH_ROWS + zlib.crc32(word.lower().encode()) % _WORD_ROWS


def blocks_of(page: str) -> list[tuple[tuple[tuple[str, ...], ...], str]]:
    """(path, text) of the leaf blocks of a page in order; a path is a tag's name and words for each level."""
    out: list[tuple[tuple[tuple[str, ...], ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    path: tuple[tuple[str, ...], ...] = ()
    skipped = 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((path, text))
            held.clear()

    def pop(k: int) -> None:
        nonlocal skipped
        skipped -= sum(n in _SKIPPED for n, _ in stack[k:])
        del stack[k:]

    unclosed: set[str] = set()  # of which no end tag follows

    def closed(name: str, begin: int) -> int:
        """Where the next end tag of this name begins; -1 if there is none."""
        if name in unclosed:
            return -1
        stop = re.compile(f"</{name}(?![a-zA-Z0-9:-])", re.I).search(page, begin)
        if not stop:
            unclosed.add(name)
        return stop.start() if stop else -1

    def leave(names) -> None:
        for k, (n, _) in enumerate(stack):
            if n in names:
                pop(k)
                break

    at, size = 0, len(page)
    while at < size:
        mark = page.find("<", at)
        found = (_MARKUP.match(page, mark) or _LOOSE.match(page, mark)) if mark >= 0 else None
        if mark < 0 or not found:
            end = size if mark < 0 else mark + 1
        else:
            end = mark
        if end > at and skipped and stack[-1][0] == "head" and not page[at:end].isspace():
            pop(len(stack) - 1)
        if end > at and not skipped:
            if not held:
                path = tuple(w for n, w in stack if n not in _INLINE)
            held.append(page[at:end])
        at = end
        if not found:
            continue
        at = found.end()
        name = (found[2] if found.re.groups and found[2] else "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if name in _INLINE and stack[k][0] not in _INLINE:
                    break
            continue
        if skipped:
            if name not in _IN_HEAD:
                leave(("head",))
            if name in _LEAVES_FOREIGN:
                leave(("svg", "math"))
            if name in _CLOSES_P:
                leave(("select",))
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if name in _ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _ENDS[name]:
                    pop(k)
                    break
                if stack[k][0] in _HOLDS:
                    break
        if name in _VOID or found[3].endswith("/"):
            continue
        if name in _SKIPPED and name not in ("head", "script", "style", "svg", "math", "select") and closed(name, at) < 0:
            if name == "title":
                at = page.find("<", at) if "<" in page[at:] else size
            continue
        words = [name]
        for _, value in _NAMED.findall(found[3]):
            words += [x.lower() for x in _PART.findall(value)]
        stack.append((name, tuple(words)))
        skipped += name in _SKIPPED
        if name in _RAW:
            stop = closed(name, at)
            at = stop if stop >= 0 else size
    flush()
    return out


@lru_cache(200_000)
def _path_rows(path: tuple[tuple[str, ...], ...]) -> tuple[int, ...]:
    rows = {_row("on", w) for level in path for w in level}
    if path:
        rows.add(_row("in", path[-1][0]))
    return tuple(rows)


_word_row_of = lru_cache(200_000)(_word_row)


def features(path: tuple[tuple[str, ...], ...], text: str) -> list[int]:
    """Rows of the embedding table: tags and words of the path, the parent once more, and all words of the text."""
    return [*_path_rows(path), *map(_word_row_of, text.split())]


def flat_rows(page: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, blocks' first rows): the path's rows by the root of their number, the words' by their mean."""
    sizes = np.fromiter(map(len, page), np.int64, len(page))
    rows = np.fromiter(chain.from_iterable(page), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(page)), sizes)
    word = rows >= _PATH_ROWS
    number = np.bincount(owner * 2 + word, minlength=2 * len(page))[owner * 2 + word]
    return rows, (np.where(word, 0.25, 1.0) / np.where(word, number, np.sqrt(number))).astype(np.float32)[:, None], np.cumsum(sizes) - sizes


@dataclass
class Labeller:
    params: rnn.Params

    def scores(self, pages: list[list[list[int]]], keep: bool = False):
        """Probabilities (page, block) that a block is main text; padded with what is to be ignored."""
        p = self.params
        lengths = np.array([len(b) for b in pages])
        steps = int(lengths.max())
        x = np.zeros((len(pages), steps, _WIDTH), np.float32)
        for i, page in enumerate(pages):
            rows, weights, first = flat_rows(page)
            x[i, : len(page)] = np.add.reduceat(p["embed"][rows] * weights, first)
        mask = (np.arange(steps)[None, :] < lengths[:, None]).astype(np.float32)
        turn = rnn.reversal(lengths, steps)
        xb = np.take_along_axis(x, turn[:, :, None], 1)
        f = rnn.lstm_forward(x @ p["wf"] + p["bf"], mask, p["uf"], keep)
        b = rnn.lstm_forward(xb @ p["wb"] + p["bb"], mask, p["ub"], keep)
        (f, saved_f), (b, saved_b) = (f, b) if keep else ((f, None), (b, None))
        back = np.take_along_axis(b, turn[:, :, None], 1)
        out = rnn.sigmoid(f @ p["of"] + back @ p["ob"] + x @ p["ox"] + p["o"])
        return (out, x, xb, mask, turn, f, back, saved_f, saved_b) if keep else out


# Words that public page templates use for the parts of a page.
_MAIN = ["article", "main", "content", "post", "entry", "story", "body", "text", "page", "container", "wrapper", "row", "column", "section", "prose"]
_OTHER = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "links", "tabs"],
    "header": ["header", "masthead", "banner", "top", "logo", "brand", "site", "toolbar", "topbar"],
    "footer": ["footer", "bottom", "copyright", "legal", "colophon", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "tags", "archive", "complementary"],
    "notice": ["cookie", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "gdpr", "banner"],
    "ad": ["ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "dfp", "outbrain", "taboola"],
    "form": ["form", "login", "search", "contact", "register"],
    "comments": ["comment", "comments", "disqus", "replies", "reply", "discussion", "respond", "thread", "reader"],
    "share": ["share", "social", "sharing", "follow", "author", "byline", "meta", "likes"],
}
_OTHER_TAGS = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div"], "form": ["form"], "comments": ["section", "div", "ol"]}


def made_page(rng: np.random.Generator, words: list[str]) -> list[tuple[tuple[tuple[str, ...], ...], str, bool]]:
    """A page of (path, text, main) blocks after public conventions."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    few = [pick(words) for _ in range(2)]  # some pages say the same again and again
    own = few if rng.random() < 0.15 else words
    say = lambda lo, hi: " ".join(pick(own) for _ in range(int(rng.integers(lo, hi))))
    root = (("html",), ("body",))
    if rng.random() < 0.3:
        root += (("div", *[pick(["page", "wrapper", "container", "site", "root", "app"]) for _ in range(2)]),)

    def other(kind: str, at, long: bool) -> list:
        tag = pick(_OTHER_TAGS.get(kind, ["div", "section", "p", "aside"]))
        named = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        level = (tag,) if named else (tag, *[pick(_OTHER[kind]) for _ in range(int(rng.integers(1, 3)))])
        inner = [("ul",), ("li",)] if kind == "nav" and rng.random() < 0.7 else [("p",)] if rng.random() < 0.4 else [("div",)] if rng.random() < 0.2 else []
        telling = rng.random() < 0.4
        if telling and at is root and rng.random() < 0.2:
            level, inner = (pick(["div", "section", "aside"]),), []  # nothing but the words tells

        def words_of(lo, hi):
            if not telling:
                return say(lo, hi)
            return " ".join(pick(_OTHER[kind]) if rng.random() < 0.5 else pick(own) for _ in range(int(rng.integers(max(3, lo), max(6, hi)))))

        some = [((*at, level, *inner), words_of(1, 40 if long else 8), False) for _ in range(int(rng.integers(1, 8)))]
        return [((*at, level, (pick(["h2", "h3", "h4"]),)), say(1, 4), False)] * (rng.random() < 0.3) + some

    out: list = []
    for kind in ("header", "nav", "notice", "ad", "share", "form"):
        if rng.random() < 0.5:
            out += other(kind, root, kind in ("notice", "ad"))
    if rng.random() < 0.07:
        body = root
    elif rng.random() < 0.75:
        body = (*root, ("article",) if rng.random() < 0.7 else ("article", pick(_MAIN))) if rng.random() < 0.8 else (*root, ("main",))
    else:
        body = (*root, ("div", *[pick(_MAIN[:7]) for _ in range(int(rng.integers(1, 3)))]))
    if rng.random() < 0.3:
        body += ((pick(["div", "section"]), pick(_MAIN)),)
    if rng.random() < 0.7:
        out.append(((*body, ("h1",)), say(1, 12), True))
    for _ in range(int(rng.integers(0, 10 if rng.random() < 0.7 else 60))):
        leaf = pick([("p",), ("p",), ("p",), ("p",), ("h2",), ("h3",), ("blockquote",), ("li",), ("td",), ("pre",), ("figcaption",), None])
        extra = (("ul",),) if leaf == ("li",) else (("table",), ("tr",)) if leaf == ("td",) else ()
        out.append(((*body, *extra, *((leaf,) if leaf else ())), say(1, 60), True))
        if rng.random() < 0.12:
            out += other(pick(list(_OTHER)), body, rng.random() < 0.5)
    if rng.random() < 0.25:
        out += other("comments", body, True)
    for kind in ("comments", "share", "aside", "form", "ad", "notice", "footer"):
        if rng.random() < (0.75 if kind == "footer" else 0.4):
            out += other(kind, root, kind in ("comments", "ad", "footer"))
    return out or [((*body, ("p",)), say(1, 30), True)]


def train(words: list[str], pages: int = 800, epochs: int = 6, batch: int = 16, rate: float = 0.008, seed: int = 1, trace: list | None = None) -> Labeller:
    rng = np.random.default_rng(seed)
    # Words of no page besides, so that the rows of words that don't tell are alike for all blocks.
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = [*words, *("".join(rng.choice(letters, int(n))) for n in rng.integers(2, 12, 20_000))]
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    k = _HIDDEN
    p: rnn.Params = {
        "embed": (rng.standard_normal((_TABLE, _WIDTH)) * 0.3).astype(np.float32),
        "wf": normal(_WIDTH, 4 * k), "bf": np.zeros(4 * k, np.float32), "uf": rnn.lstm_init(rng, k),
        "wb": normal(_WIDTH, 4 * k), "bb": np.zeros(4 * k, np.float32), "ub": rnn.lstm_init(rng, k),
        "of": normal(k), "ob": normal(k), "ox": normal(_WIDTH), "o": np.zeros((), np.float32),
    }
    model, adam = Labeller(p), rnn.Adam(p, rate)
    made = [made_page(rng, words) for _ in range(pages)]
    rows = [[features(path, text) for path, text, _ in page] for page in made]
    goals = [np.array([m for _, _, m in page], np.float32) for page in made]
    flat = lambda a: a.reshape(-1, a.shape[-1])
    total, done = epochs * -(-pages // batch), 0
    for _ in range(epochs):
        # Pages of like length share a batch, and batches come in any order.
        order = np.argsort([len(g) + rng.random() for g in goals])
        for lo in rng.permutation(np.arange(0, pages, batch)):
            own = order[lo : lo + batch]
            out, x, xb, mask, turn, f, back, saved_f, saved_b = model.scores([rows[i] for i in own], True)
            goal = np.zeros_like(out)
            for row, i in enumerate(own):
                goal[row, : len(goals[i])] = goals[i]
            d = out - goal
            # The block alone must say what it can, so that a page much longer than these can't drown it.
            lone = (rnn.sigmoid(x @ p["ox"] + p["o"]) - goal) * mask / mask.sum()
            if trace is not None:
                trace.append(float((np.abs(d) * mask > 0.5).sum() / mask.sum()))
            d = (d * mask / mask.sum()).astype(np.float32)
            g = {"of": (f * d[:, :, None]).sum((0, 1)), "ob": (back * d[:, :, None]).sum((0, 1)), "ox": (x * (d + lone)[:, :, None]).sum((0, 1)), "o": (d + lone).sum()}
            dxf, g["uf"] = rnn.lstm_backward(d[:, :, None] * p["of"], mask, p["uf"], saved_f)
            dxb, g["ub"] = rnn.lstm_backward(np.take_along_axis(d[:, :, None] * p["ob"], turn[:, :, None], 1), mask, p["ub"], saved_b)
            for side, at, dx in (("f", x, dxf), ("b", xb, dxb)):
                g["w" + side], g["b" + side] = flat(at).T @ flat(dx), flat(dx).sum(0)
            dx = dxf @ p["wf"].T + np.take_along_axis(dxb @ p["wb"].T, turn[:, :, None], 1) + (d + lone)[:, :, None] * p["ox"]
            flats = [flat_rows(rows[i]) for i in own]
            used, weights = (np.concatenate([f[k] for f in flats]) for k in (0, 1))
            back_to = np.concatenate([np.repeat(dx[row, : len(rows[i])], [len(b) for b in rows[i]], 0) for row, i in enumerate(own)]) * weights
            order_of = np.argsort(used, kind="stable")
            found, first = np.unique(used[order_of], return_index=True)
            g["embed"] = np.zeros_like(p["embed"])
            g["embed"][found] = np.add.reduceat(back_to[order_of], first)
            adam.rate = rate * (1 - done / total) + 1e-4
            adam.step(g)
            done += 1
    return model


def learn(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = 60, sample_chars: int = 50_000, **how) -> Labeller:
    """Train on made-up pages filled with words of at most ``sample`` pages of at most ``sample_chars``."""
    own = F.xxhash64(html)
    some = pages.where(F.char_length(html) <= sample_chars)
    # Keys and hashes choose the pages; only the chosen ones are fetched.
    chosen = some.select(F.col(key).alias("k"), own.alias("h")).distinct().orderBy(F.xxhash64("k", "h"), "k", "h").limit(sample)
    held = some.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("k")) & (own == F.col("h")), "left_semi")
    rows = held.select(html).distinct().collect()
    words = sorted({w for r in rows for _, text in blocks_of(r[0] or "") for w in text.split()})
    return train(words, **how)


def main_text(model: Labeller, pages: list[str | None], cells: int = 1 << 15) -> list[str]:
    """The main text of each page; pages of like length share a batch of at most ``cells`` blocks, padding included."""
    read = [blocks_of(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(read) if b), key=lambda i: len(read[i]))
    while order:
        own = [order.pop()]
        longest = len(read[own[0]])
        while order and (len(own) + 1) * longest <= cells:
            own.append(order.pop())
        scores = model.scores([[features(path, text) for path, text in read[i]] for i in own])
        for row, i in enumerate(own):
            out[i] = " ".join(text for (_, text), s in zip(read[i], scores[row], strict=False) if s >= 0.5)
            read[i] = []
    return out


def extract(pages: DataFrame, model: Labeller, html: str = "html", into: str = "main_text") -> DataFrame:
    """Add ``into``: the main text of each page's whole html."""
    if into in pages.columns:
        raise ValueError(f"the pages have a column {into!r} already")
    schema = pages.select("*", F.lit("").alias(into)).schema
    place = pages.columns.index(html)
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in row_blocks(batch.column(place), _BLOCK):
                part = batch.slice(lo, hi - lo)
                found = main_text(held.value, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], schema.names)

    return pages.mapInArrow(lean(run), schema)
