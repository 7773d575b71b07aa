"""Main text of web pages: a conditional random field labels the leaf blocks of a page's element tree."""

from __future__ import annotations

import bisect
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeloom.llm import crf
from routeloom.llm.common import bounded_batches, table, with_columns

#: Elements that start and end a block of text, that have no end tag, and whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template svg math iframe object textarea head".split())
RAW = SILENT - {"head"}
#: Elements that say what they hold; a block's innermost one, or the innermost with a class, id or role, counts most.
SECTIONS = frozenset("article aside dialog footer form header main nav section".split())
#: An open element of the key ends when one of the values starts directly in it.
CLOSED_BY = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option"},
}

TEXT = re.compile(r"[^<]+")
#: A comment, a tag, or another declaration that ends at the next `>`.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?/][^>]*>""", re.S
)
TAG_START, OTHER = re.compile("</?[a-zA-Z]"), re.compile("</[^>]*>")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: The mark of main text in labelled pages; it is no feature.
MARK = "data-main"

Block = tuple[str, bool, frozenset[str], str, int]


class Unclosed:
    """Says where a `<` can't start a tag since no `>` outside quotes follows.

    A tag's text runs from quote to quote until a `>`. Once a run has failed, so does any that comes to one of its
    opening quotes; those are kept, so all runs of a page together take time linear in its length.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.marks: list[int] | None = None
        self.dead: set[int] = set()

    def __call__(self, at: int) -> bool:
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("[\"'>]", self.html)]
        met = []
        while True:
            k = bisect.bisect_left(self.marks, at)
            mark = self.marks[k] if k < len(self.marks) else -1
            if mark >= 0 and self.html[mark] == ">":
                return False
            end = self.html.find(self.html[mark], mark + 1) if mark >= 0 and mark not in self.dead else -1
            if mark >= 0:
                met.append(mark)
            if end < 0:
                self.dead.update(met)
                return True
            at = end + 1


def blocks(html: str | None, known: Container[str] | None = None) -> Iterator[Block]:
    """(text, marked, features of the ancestors, tag, characters in links) of each leaf block in page order.

    Text is decoded and its white space made single spaces. Unclosed and stray tags are taken as browsers take the
    common cases: a paragraph ends where a block starts, an end tag closes up to its element or nothing. Given `known`,
    only those features are kept, which bounds what deep pages carry along.
    """
    html = html or ""
    #: name, features, nearest block's tag, marked, features of the innermost section, place of the nearest block element
    root = ("", frozenset(), "", False, frozenset(), 0)
    stack, opened = [root], Counter()
    held: list[str] = []
    unclosed, failed = Unclosed(html), False
    linked = at = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    def flush() -> Iterator[Block]:
        nonlocal linked
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            _, features, tag, marked, inner, _ = stack[-1]
            yield text, marked, features | inner if inner else features, tag, linked
        linked = 0

    while at < len(html):
        if html[at] != "<":
            found = TEXT.match(html, at)
        elif at > unclosed.last and not html.startswith("<!--", at):
            found = None
        elif failed and TAG_START.match(html, at) and unclosed(at + 1):
            found = OTHER.match(html, at)
        else:
            found = TOKEN.match(html, at)
            failed = failed or found is None or found[2] is None and bool(TAG_START.match(html, at))
        if found is None or found.re is TEXT:
            piece = found[0] if found else "<"
            at += len(piece)
            held.append(piece)
            if opened["a"] > 0:
                linked += len(piece.strip())
            continue
        at = found.end()
        if found.re is OTHER or found[2] is None:
            continue
        closing, name, rest = found.groups()
        name = name.lower()
        if closing:
            if name in BLOCKS:
                yield from flush()
            if name == "br":
                held.append(" ")
            elif opened[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at) if not rest.endswith("/") else None
            at = end.end() if end else at if rest.endswith("/") else len(html)
            continue
        if name in BLOCKS:
            yield from flush()
            near = stack[-1][5]  # formatting may lie between
            if name in CLOSED_BY.get(stack[near][0], ()):
                while len(stack) > near:
                    pop()
        if name in VOID:
            held.append(" ")
            continue
        words = {
            w for m in NAMES.finditer(rest) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w
        }
        _, features, tag, marked, inner, near = stack[-1]
        own = {f"in={name}"} | {f"name={w}" for w in words}
        if words or name in SECTIONS:
            inner = frozenset(
                g for f in own
                if (name in SECTIONS or f[:2] != "in") and (known is None or f"inner {f}" in known)
                for g in (f"inner {f}",)
            )
        more = {f for f in own if f not in features and (known is None or f in known)}
        stack.append(
            (
                name,
                features | more if more else features,
                name if name in BLOCKS else tag,
                marked or MARK in rest,
                inner,
                len(stack) if name in BLOCKS else near,
            )
        )
        opened[name] += 1
        if rest.endswith("/") and name not in BLOCKS:
            pop()
    yield from flush()


def describe(text: str, ancestors: frozenset[str], tag: str, linked: int) -> list[str]:
    """The features of a block: its ancestors' tags and names, and what its text looks like."""
    words = text.count(" ") + 1
    size = next(k for k, most in enumerate((1, 2, 5, 10, 20, 50, 1 << 60)) if words <= most)
    links = min(3, int(4 * linked / max(1, len(text))))
    out = [
        *ancestors,
        f"tag={tag}",
        f"size={size}",
        f"links={links}",
        f"tag={tag} links={links}",
        f"end={text[-1] if text[-1] in '.!?:' else ''}",
    ]
    if text[0] in "©»«|·•":
        out.append("start=mark")
    if "in=article" not in ancestors and "in=main" not in ancestors:
        out += ["outside", f"outside size={size}", f"outside links={links}"]
    return out


#: What the parts around a main text are called and look like: tags, then names of classes and ids.
PARTS = {
    "menu": ("nav nav div ul ol", "menu nav navigation navbar main-menu breadcrumb breadcrumbs topnav links nav-menu"),
    "ad": (
        "div div aside section p",
        "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner ad-slot adbox",
    ),
    "notice": (
        "div section dialog p",
        "cookie cookies cookie-notice consent notice notices gdpr alert popup modal overlay warning announcement",
    ),
    "head": ("header header div", "header head masthead site-header branding topbar banner logo page-header"),
    "foot": ("footer footer div", "footer foot site-footer copyright legal bottom imprint colophon"),
    "side": (
        "aside aside div section", "sidebar side related widget recommended trending popular teaser related-posts"
    ),
    "form": ("form form div", "form search login signup contact newsletter subscribe subscription"),
    "comments": (
        "section div ol ul",
        "comments comment-list commentlist discussion responses replies reader-comments user-comments",
    ),
    "share": ("div ul p", "share social sharing tags pagination pager social-links share-buttons"),
}
CONTENT_NAMES = "content post entry story article article-body post-content main-text text body-text entry-content".split()
WRAPPERS = "wrapper container page site row layout inner outer col".split()


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Small invented pages in many layouts, in which data-main marks the elements of the main text."""
    rng = random.Random(seed)
    syllables = "ta ri on el ve mo sha in or du pel ka è ß ñ the und que an".split()

    vocabulary = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(1000)]

    def word() -> str:
        return rng.choice(vocabulary)

    def text(low: int, high: int) -> str:
        style = rng.random()
        words = rng.choices(vocabulary, k=rng.randint(low, high))
        if style < 0.02:
            return rng.choice(["x", "7", "–", "A."])
        if style < 0.06:
            return "!! ".join(words).upper() + "!!"
        if style < 0.12:
            return " | ".join(words)
        if style < 0.18:
            return " ".join(w + rng.choice(["%%%", "###", "$$$", "***", "&amp;&amp;"]) for w in words)
        if style < 0.22:
            return " ".join([words[0]] * len(words))
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def links(k: int, tag: str = "li") -> str:
        each = [f'<a href="/{word()}">{text(1, 3)}</a>' for _ in range(k)]
        return "".join(f"<{tag}>{x}</{tag}>" for x in each) if tag else rng.choice([" ", " | ", " » "]).join(each)

    def paragraph() -> str:
        kind = rng.random()
        extra = f' class="{word()}"' if rng.random() < 0.1 else ""
        if kind < 0.62:
            return f"<p {MARK}{extra}>{text(1, rng.choice([3, 20, 60]))}</p>"
        if kind < 0.7:
            return f"<p {MARK}><b>{text(1, 12)}<br><p {MARK}>{text(3, 40)}"
        if kind < 0.77:
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))} {MARK}>{text(1, 9)}</{h}>"
        if kind < 0.81:
            return f"<blockquote {MARK}>{rng.choice(['', '<p>'])}{text(4, 40)}</blockquote>"
        if kind < 0.84:
            return f"<pre {MARK}>{text(4, 20)}</pre>"
        if kind < 0.91:
            tag = rng.choice(["ul", "ul", "ol"])
            return f"<{tag} {MARK}>" + "".join(
                f"<li>{text(1, 20)}</li>" for _ in range(rng.randint(2, 4))
            ) + f"</{tag}>"
        if kind < 0.94:
            return f"<table {MARK}>" + "".join(
                f"<tr><td>{text(1, 3)}</td><td>{text(1, 3)}</td></tr>" for _ in range(rng.randint(1, 3))
            ) + "</table>"
        return f'<p {MARK}>{text(1, 10)} <a href="/{word()}">{text(1, 4)}</a> {text(1, 20)}</p>'

    def comment() -> str:
        said = rng.choice(
            [
                f"<p>{text(2, 40)}</p>",
                text(2, 30),
                f"<b>{text(1, 2)}</b><p>{text(2, 30)}</p>",
                f"{text(1, 2)}: {text(2, 30)}",
            ]
        )
        tag = rng.choice(["div", "li", "article", "p"])
        return f'<{tag} class="{rng.choice(["comment", "comment", "reply", "comment-body"])}">{said}</{tag}>' if rng.random() < 0.6 else f"<{rng.choice(['li', 'p', 'div'])}>{said}"

    def inside(kind: str) -> str:
        plain = rng.choice(
            [
                f"<p>{text(2, 30)}</p>",
                text(2, 30),
                f"<h3>{text(1, 4)}</h3><p>{text(2, 30)}</p>",
                f"<p>{text(2, 20)}</p><p>{text(2, 20)}</p>",
                f'{text(2, 12)} <a href="/{word()}">{text(1, 2)}</a>',
            ]
        )
        if kind in ("menu", "share"):
            return rng.choice([f"<ul>{links(rng.randint(2, 7))}</ul>", links(rng.randint(2, 6), ""), links(3)])
        if kind == "form":
            return f"<label>{text(1, 4)}</label><input name='q'>{plain}<select><option>{word()}<option>{word()}</select><button>{text(1, 2)}</button>"
        if kind == "comments":
            return rng.choice(["", f"<h2>{text(1, 3)}</h2>"]) + "".join(comment() for _ in range(rng.randint(1, 4)))
        if kind == "head":
            return rng.choice(
                [
                    f"<h1>{text(1, 4)}</h1><p>{text(2, 9)}</p>",
                    text(1, 6),
                    f'<a href="/">{text(1, 3)}</a>',
                    f"<h1>{text(1, 5)}</h1>",
                    plain,
                ]
            )
        if kind == "foot":
            return rng.choice(["&copy; ", "© ", "", "<p>"]) + rng.choice(
                [f"{text(2, 25)} &middot; {text(1, 6)}", text(1, 12), links(3, ""), plain]
            )
        if kind == "side":
            return rng.choice([f"<h3>{text(1, 3)}</h3><ul>{links(3)}</ul>", plain, plain])
        return plain + (f"<button>{word()}</button>" if kind == "notice" and rng.random() < 0.4 else "")

    def noise() -> str:
        kind = rng.choice(list(PARTS))
        tags, names = (x.split() for x in PARTS[kind])
        if kind == "comments" and rng.random() < 0.25:
            return comment() if rng.random() < 0.1 else f'<article class="comment"><p>{text(2, 30)}</p></article>'
        tag, name = rng.choice(tags), rng.choice(names)
        bare = tag in ("nav", "header", "footer", "aside", "form", "dialog") and rng.random() < 0.6
        return f"<{tag}>{inside(kind)}</{tag}>" if bare else f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">{inside(kind)}</{tag}>'

    pages = []
    for _ in range(n):
        body = [f"<h1 {MARK}>{text(1, 12)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 7, 9])):
            body.append(paragraph())
            if rng.random() < 0.22:
                body.append("</p>" + noise())
        main = "".join(body)
        div = lambda x: f'<div {rng.choice(["class", "id"])}="{rng.choice(CONTENT_NAMES)}">{x}</div>'
        layouts = [
            lambda x: f"<article>{x}</article>",
            lambda x: f"<main>{x}</main>",
            lambda x: f"<main><article>{x}</article></main>",
            div,
            lambda x: div(div(x)),
            lambda x: f'<article class="{rng.choice(CONTENT_NAMES)}">{x}</article>',
            lambda x: f"<main>{div(x)}</main>",
            lambda x: f"<div>{x}</div>",
            lambda x: x,
        ]
        main = rng.choices(layouts, [6, 3, 2, 4, 2, 2, 1, 2, 3])[0](main)
        around = lambda: "".join(noise() for _ in range(rng.choice([0, 0, 1, 2, 3, 4])))
        page = around() + main + around()
        for _ in range(rng.choice([0, 0, 1, 2])):
            page = f'<div {rng.choice(["class", "id"])}="{rng.choice(WRAPPERS)}">{page}</div>'
        pages.append(
            f"<!DOCTYPE html><html><head><title>{text(1, 9)}</title><style>p{{}}</style></head><body>{page}" + rng.choice(
                ["</body></html>", ""]
            )
        )
    return pages


def train(pages: list[str]) -> crf.Crf:
    """A field fitted to labelled pages: an element with the mark, and all in it, is main text."""
    sequences = []
    for page in pages:
        found = list(blocks(page))
        sequences.append(
            ([describe(t, a, tag, n) for t, _, a, tag, n in found], [int(marked) for _, marked, _, _, _ in found])
        )
    return crf.train(sequences, 2)


@cache
def own_model() -> crf.Crf:
    """The field of the built-in labelled pages; no randomness is left, so every process fits the same one."""
    return train(labelled_pages())


def main_texts(htmls: list[str | None], model: crf.Crf) -> list[str]:
    """The main text of each page: the blocks labelled as such, joined by line feeds."""
    pages = [list(blocks(h, model.features)) for h in htmls]
    labels = model.decode([model.emissions([describe(t, a, tag, n) for t, _, a, tag, n in page]) for page in pages])
    return ["\n".join(b[0] for b, keep in zip(page, own) if keep) for page, own in zip(pages, labels)]


def extract_main_text(pages: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """`pages` with text, the main text of html, and n_chars, its code points.

    A null or empty html, or one without main text, has an empty text; pages of any length are read whole; repeated
    rows get equal texts; columns of these names are replaced; an empty table gives an empty result. Without a given
    model the one of the built-in labelled pages is used.
    """
    bounded_batches(pages.sparkSession)
    field = model or own_model()

    @F.pandas_udf(T.StringType())
    def extract(htmls: pd.Series) -> pd.Series:
        return pd.Series(main_texts(htmls.tolist(), field))

    texts = with_columns(pages, {"text": extract("html")})
    return with_columns(texts, {"n_chars": F.length("text").cast("long")})


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
