"""Main text of web pages with a linear-chain conditional random field over leaf blocks (operator 5).

A page becomes a sequence of leaf blocks: runs of text between the starts and ends of block elements, each with the tags and
the class and id words of the elements around it. A chain model labels each block as main text or not. Its features are the
ancestors' tags and words, the parent, and properties of the text (length, share of link text, sentence punctuation, typical
words of notices, place in the page). It is trained by gradient steps on the exact likelihood (forward-backward), on pages
that ``labelled_pages`` composes in many layouts, with known labels; a page's labels are decoded by Viterbi.

The model is a table of ``1 << BITS`` weights for each label, broadcast whole. Pages are independent: no shuffle takes place.

Defined cases: null and empty pages give the empty text; broken or cut markup is read as far as it goes, elements left open
end with their parents or the page; an element without text that is never closed ends at its start tag, as svg does where
that ends in "/", but script and style go on to the page's end; a tag ends at the first ">" outside a value that is quoted after
"="; repeated rows and null keys are passed through; other columns are dropped.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.llm._text import bounded, project

BITS = 14
#: Fixed values of HTML: elements whose content is no text, that never have content, and that don't start a block.
SILENT = ("script", "style", "template", "svg", "iframe", "textarea")
#: Of these, the ones that go on to the page's end where they are not closed.
ENDLESS = ("script", "style", "textarea")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded semantics".split())
#: Elements that end when one of the named elements starts.
ENDED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
ENDERS = frozenset().union(*ENDED_BY.values())
#: Elements that an open p, li and the like is not looked for beyond.
SCOPE = frozenset("ul ol dl table div article section aside main body blockquote td".split())

TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"']))*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
BLANK = re.compile(r"[\s\xa0]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, float]]:
    """(path, text, share of link text) of each leaf block; a path has an entry for each element: its tag, then its words."""
    out: list[tuple[tuple[str, ...], str, float]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    links = linked = at = 0
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal linked
        if text:
            joined = BLANK.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append((tuple(p for _, p in stack), joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)

    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                text.append(" ")
            elif name not in INLINE:
                close()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            continue
        if name in SILENT:
            end = None if name in unclosed or (name == "svg" and m[3].endswith("/")) else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None and not m[3].endswith("/"):
                unclosed.add(name)  # no end from here on: not looked for again
            at = end.end() if end else len(page) if name in ENDLESS else at
            if name != "svg":
                close()
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links += 1
            continue
        close()
        links = 0
        for k in range(len(stack) - 1, -1, -1) if name in ENDERS else ():
            if name in ENDED_BY.get(stack[k][0], ()):
                del stack[k:]
                break
            if stack[k][0] in SCOPE:
                break
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        words = " ".join(p.lower() for g in NAMES.findall(m[3]) for p in PARTS.findall(" ".join(g)))
        stack.append((name, f"{name} {words} hidden" if HIDDEN.search(m[3]) else f"{name} {words}".rstrip()))
    close()
    return out


@lru_cache(maxsize=200_000)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(maxsize=50_000)
def of_path(path: tuple[str, ...]) -> tuple[int, ...]:
    """Features of the elements around a block."""
    out = set()
    for n, element in enumerate(path):
        tag, *words = element.split(" ")
        out.add(f"in {tag}")
        out.update(f"word {w}" for w in words)
        out.update(f"stem {w[:5]}" for w in words)
        if n >= len(path) - 2:
            out.add(f"{len(path) - n} {tag}")
            out.update(f"near {w}" for w in words)
    out.add("bare" if len(path) < 3 else "deep")
    return tuple(bucket(f) for f in sorted(out))


NOTICE = re.compile(r"cookie|consent|subscrib|newsletter|sign up|log ?in|advert|sponsor|all rights|privacy|terms of|copyright|©|share this|related|read more|comment|reply", re.I)


STOP = re.compile(r"[.!?…](?:\s|$)")


def of_text(text: str, linked: float, place: float) -> list[int]:
    """Features of a block's own text."""
    words = text.count(" ") + 1
    stops = len(STOP.findall(text))
    out = [f"words {min(8, words.bit_length())}", f"links {int(linked * 4 + 0.5)}", f"stops {min(3, stops)}", f"ends {text[-1] in '.!?…:;'}", f"notice {words < 40 and bool(NOTICE.search(text))}", f"place {int(place * 5)}"]
    return [bucket(f) for f in out]


def featured(page: list[tuple[tuple[str, ...], str, float]]) -> list[list[int]]:
    n = len(page)
    return [[bucket("always"), *of_path(path), *of_text(text, linked, i / n)] for i, (path, text, linked) in enumerate(page)]


class Chain:
    """A chain model with two labels (1: main text): weights by feature, between neighbours, and for the first block."""

    def __init__(self) -> None:
        self.emit = np.zeros((1 << BITS, 2))
        self.step = np.zeros((2, 2))
        self.start = np.zeros(2)

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        ends = np.cumsum([len(r) for r in rows])
        return np.add.reduceat(self.emit[flat], np.concatenate(([0], ends[:-1])), axis=0)

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not rows:
            return []
        (a, b), s = (self.scores(rows)[0] + self.start).tolist(), self.scores(rows).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        back = []
        for x, y in s[1:]:
            from_a, from_b = (a + aa >= b + ba), (a + ab >= b + bb)
            a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
            back.append((0 if from_a else 1, 0 if from_b else 1))
        label = int(b > a)
        out = [label]
        for prior in reversed(back):
            label = prior[label]
            out.append(label)
        return out[::-1]

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
        """Adam steps on the log likelihood of all pages at once."""
        n, long = len(pages), max(len(y) for _, y in pages)
        label = np.zeros((n, long), np.int64)
        real = np.zeros((n, long), bool)
        page, place, feature = [], [], []
        for i, (rows, y) in enumerate(pages):
            label[i, : len(y)], real[i, : len(y)] = y, True
            for t, r in enumerate(rows):
                page += [i] * len(r)
                place += [t] * len(r)
                feature += r
        cell, feature = np.array(page) * long + np.array(place), np.array(feature)
        parts = [self.emit, self.step, self.start]
        first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        total = real.sum()
        for k in range(1, rounds + 1):
            s = np.stack([np.bincount(cell, weights=self.emit[feature, c], minlength=n * long) for c in (0, 1)], axis=-1).reshape(n, long, 2)
            node, edge = self._marginals(s, real)
            want = np.stack([label == 0, label == 1], axis=-1) & real[..., None]
            diff = (node - want) * real[..., None]
            grads = [np.stack([np.bincount(feature, weights=diff.reshape(-1, 2)[cell, c], minlength=1 << BITS) for c in (0, 1)], axis=-1), edge.copy(), (node[:, 0] - want[:, 0]).sum(axis=0)]
            pair = real[:, 1:]
            np.subtract.at(grads[1], (label[:, :-1][pair], label[:, 1:][pair]), 1)
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                g = g / total + ridge * p / n
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return self

    def _marginals(self, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, long, _ = s.shape
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0] + self.start
        for t in range(1, long):
            forward[:, t] = np.where(real[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + self.step, axis=1) + s[:, t], forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            backward[:, t] = np.where(real[:, t + 1, None], np.logaddexp.reduce(self.step + (s[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0)
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        node = np.exp(forward + backward - norm[:, None, None]) * real[..., None]
        edge = np.zeros((2, 2))
        for t in range(1, long):
            on = real[:, t]
            edge += np.exp(forward[on, t - 1, :, None] + self.step + (s[on, t] + backward[on, t])[:, None, :] - norm[on, None, None]).sum(axis=0)
        return node, edge


def labelled_pages(n: int = 440, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Composed pages in varied layouts, each with the texts of its main blocks."""
    rnd = random.Random(seed)
    syllables = "ba co de fi gu la me no pe ri so tu va ze al en is or un st".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(2, 16).capitalize() + rnd.choice("...?!") for _ in range(rnd.randint(a, b)))

    def links(a: int, b: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{words(1, 1)}">{words(1, 4)}</a></{tag}>' for _ in range(rnd.randint(a, b)))

    def maybe(chance: float, make) -> str:
        return make() if rnd.random() < chance else ""

    def box(tags: str, names: str, inner: str) -> str:
        tag, name = rnd.choice(tags.split()), rnd.choice(names.split())
        attr = rnd.choice(["class", "id"]) if name != "-" else ""
        return f"<{tag}{f' {attr}="{name}"' if attr else ''}>{inner}</{tag}>"

    def person() -> str:
        return words(1, 2).title()

    for number in range(n):
        main: set[str] = set()
        if number % 12 == 5:  # a page that is little else than a short text
            short = [sentences(1, 3) for _ in range(rnd.choice((1, 1, 2)))]
            main.update(short)
            tag = rnd.choice(("p", "div", "p", "div", "")) if len(short) == 1 else rnd.choice(("p", "div"))
            inner = "".join(f"<{tag}>{x}</{tag}>" if tag else x for x in short)
            head = rnd.choice(("", f"<head><title>{words(2, 6)}</title></head>"))
            yield rnd.choice((inner, f"<html>{head}<body>{inner}</body></html>", f"<body>{inner}{maybe(0.5, lambda: f'<footer>&copy; {sentences(1, 1)}</footer>')}</body>")), main
            continue
        bare = rnd.choice([0, 0, 0, 0.1, 0.9])  # share of paragraphs that are plain div elements

        def keep(text: str, main: set[str] = main) -> str:
            main.add(text)
            return text

        def paragraph() -> str:
            text = keep(sentences(1, 7) if rnd.random() < 0.9 else words(1, 6).capitalize())
            if rnd.random() < 0.15:
                head, _, rest = text.partition(" ")
                text = f"<{(t := rnd.choice(['b', 'em', 'a href=x', 'strong']))}>{head}</{t.split()[0]}> {rest}"
            if rnd.random() < bare:
                return f"<div>{text}</div>\n"
            end = "</p>" if rnd.random() < 0.85 else ""
            return f"<p>{'<b>' if rnd.random() < 0.1 else ''}{text}{rnd.choice(['', '', '<br>'])}{end}\n"

        def body() -> str:
            out = [f"<h1>{keep(words(2, 9).capitalize())}</h1>"] if rnd.random() < 0.9 else []
            for _ in range(rnd.randint(1, 9)):
                kind = rnd.random()
                if kind < 0.78:
                    out.append(paragraph())
                elif kind < 0.86:
                    out.append(f"<h2>{keep(words(2, 6).capitalize())}</h2>{paragraph()}")
                elif kind < 0.91:
                    full = rnd.random() < 0.5
                    out.append("<ul>" + "".join(f"<li>{keep(sentences(1, 1) if full else words(1, 5))}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>")
                elif kind < 0.95:
                    out.append(f"<blockquote>{keep(sentences(1, 3))}</blockquote>")
                elif kind < 0.97:
                    out.append(f"<pre>{keep(words(4, 10))}</pre>")
                else:
                    out.append(f"<table><tr><td>{keep(words(1, 3))}</td><td>{keep(words(1, 3))}</td></tr></table>")
                if rnd.random() < 0.06:
                    out.append(box("div aside", "ad advert advertisement sponsored promo banner", rnd.choice([sentences(1, 2), f"<p>{sentences(1, 2)}</p>"])))
                if rnd.random() < 0.04:
                    out.append(box("div aside", "related newsletter share-buttons social", links(2, 4, "span")))
            return "".join(out)

        article = box("article article article main div section div", "- - article post-content entry-content content story article-body main text", body())
        if bare > 0.5 and rnd.random() < 0.6:  # no element around the text
            article = body() if rnd.random() < 0.6 else "".join(paragraph() for _ in range(rnd.randint(1, 6)))
        elif rnd.random() < 0.2:
            article = f"<main>{article}</main>"
        comments = maybe(0.35, lambda: box("section div ol ul", "comments comment-list responses discussion feedback user-comments disqus_thread fb-comments thread replies", f"<h3>{rnd.randint(2, 40)} comments</h3>" + "".join(box("div li article p", "- comment reply comment-body response post-comment feedback-item", f"<b>{person()}</b><p>{sentences(1, 4)}</p>") for _ in range(rnd.randint(1, 5)))))
        menu = maybe(0.9, lambda: box("nav nav nav div ul", "- menu navbar navigation nav top-links", f"<ul>{links(3, 8)}</ul>"))
        header = maybe(0.5, lambda: box("header header div", "- header site-header masthead top", f"<div>{words(1, 3).title()}</div><span>{sentences(1, 1)}</span>"))
        side = maybe(0.5, lambda: box("aside aside div", "- sidebar side widget rail", f"<h3>{words(1, 3).title()}</h3><p>{sentences(1, 3)}</p><ul>{links(2, 6)}</ul>"))
        notice = maybe(0.4, lambda: box("div div section p", "cookie-banner notice consent cookie-notice alert popup gdpr", f"{rnd.choice(['We use cookies. ', 'By going on you consent. ', ''])}{sentences(1, 2)}<button>{words(1, 2)}</button>"))
        ad = maybe(0.5, lambda: box("div div aside", "ad ads advert advertisement sponsor ad-slot promo", sentences(1, 3)))
        form = maybe(0.25, lambda: f"<form action=/x><label>{words(1, 3)}</label><select><option>{words(1, 2)}<option>{words(1, 2)}</select><p>{sentences(1, 1)}</p><button>{words(1, 1)}</button></form>")
        script = maybe(0.2, lambda: f"<noscript>{rnd.choice(['', '<p>'])}{sentences(1, 2)}</noscript>")
        crumbs = maybe(0.2, lambda: box("div nav ol", "breadcrumbs breadcrumb", links(2, 4, "span")))
        footer = maybe(0.9, lambda: box("footer footer footer div", "- footer site-footer bottom", f"{rnd.choice(['&copy; ', ''])}{sentences(1, 2)}{maybe(0.4, lambda: f'<ul>{links(2, 5)}</ul>')}"))
        before = [menu, header, ad, notice, crumbs, script]
        after = [comments, side, form]
        rnd.shuffle(before)
        rnd.shuffle(after)
        if rnd.random() < 0.3:
            before.append(after.pop())
        yield f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}{footer}{'</body></html>' if rnd.random() < 0.8 else ''}", main


@lru_cache(maxsize=1)
def trained(n: int = 440, seed: int = 11) -> Chain:
    """The model, trained on n composed pages."""
    pages = []
    for page, main in labelled_pages(n, seed):
        found = blocks(page)
        pages.append((featured(found), [int(text in main) for _, text, _ in found]))
    return Chain().fit(pages)


def main_text(model: Chain, page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(text for (_, text, _), label in zip(found, model.decode(featured(found)), strict=True) if label)


def extract(df: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html", out: str = "text") -> DataFrame:
    """(keys, out) with the main text of every whole page."""
    rows = project(df, **{k: k for k in keys}, _page=page)
    shared = df.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "_page"):
            texts = [main_text(shared.value, p) for p in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string())], names=[*keys, out])

    return rows.mapInArrow(run, schema)
