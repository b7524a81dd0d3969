"""Main text of pages by templates that equivalence classes of tokens reveal.

A token is a tag or a piece of text in its place, the path of containers it stands in. Tokens of a host that
occur equally often on every page share an occurrence vector and form an equivalence class. Classes of at least
``MIN_CLASS`` tokens found on at least half of a host's pages make its template; on a page a class is valid only
where its tokens stand in the class's order, and a class inside another lies in one gap of it. Text between
template tokens fills the page's slots. The slots of menus, headers, footers, sidebars, notices, adverts, forms,
comments and the like, told by their containers, are left out, and so is template text; a container that holds
the article is not one of them by its name. On a page with an article
element the slots inside it are the main ones. There a class counts only where ``MIN_PAGES`` pages hold it, and
only in containers below the article that hold template text alone and no heading, as a notice does: headings and
lines that all articles of a host share stay. Where template tokens leave less than ``MIN_OWN_PERCENT`` of the
article's characters, its pages are copies of one article, which stays whole.

Vectors are never laid out: a vector's signature is the exclusive or of a hash of (page, count) over its pages,
so each token costs one row however many pages a host has.

Defined cases: null html is empty; a page without text in a slot gives an empty text. A null URL is of a host
without name. Repeated rows count as pages and get equal results each. Broken html (open tags, cut ends) is read as
far as it goes; memory grows with the length of a page, however deep its elements are nested. Input columns with the name of a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, lower_ascii, saved

MIN_CLASS = 3
MIN_PAGES = 4
SUPPORT_PERCENT = 50
MIN_OWN_PERCENT = 10

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[A-Za-z/!?][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")

# Elements by their part in a page.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "button"}
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr script style noscript template".split())
CONTAINERS = set("html head body nav header footer aside form article main section div ul ol dl table figure fieldset dialog menu".split())
IMPLIED = {"p", "li", "dt", "dd"}
BOILERPLATE = set("head nav header footer aside form dialog menu fieldset".split())
ARTICLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNNAMED = {"html", "body"} | ARTICLE | BOILERPLATE
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id or role that name such parts.
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice"
    " notices notification alert popup modal newsletter subscribe signup sidebar widget menu nav navbar navigation"
    " navigations breadcrumb breadcrumbs pagination pager header footer masthead toolbar comment comments respond replies"
    " discussion disqus share sharing social related recommended search login complementary contentinfo dialog".split()
)
# Words that a name of such a part may add.
FORMS = set("area bar box button buttons icons item items link links list posts site slot unit".split())


def named(tag: str, attributes: str) -> bool:
    """Whether a whole name in class, id or role says that the element is boilerplate: "cookie-notice", not "has-sidebar"."""
    if tag in UNNAMED:
        return False
    for name in " ".join(x for m in ATTRIBUTE.findall(attributes) for x in m).lower().split():
        said = [x for x in re.split(r"[^a-z]+", name) if x]
        if any(x in NAMES for x in said) and all(x in NAMES or x in FORMS for x in said):
            return True
    return False


@dataclass(eq=False, slots=True)
class Box:
    """An open container: its place, whether it is an article or named as boilerplate, and what was seen in it."""

    parent: Box | None = None
    place: str = ""
    is_article: bool = False
    named: Box | None = None  # the nearest named container, itself included
    depth: int = 0  # the named containers at and above it
    heading: bool = False
    own: bool = False

    def note(self, flag: str) -> None:
        """Set a flag here and on the containers above, up to those that have it."""
        box = self
        while box is not None and not getattr(box, flag):
            setattr(box, flag, True)
            box = box.parent

    def names(self) -> Iterator[Box]:
        """The named containers at and above it, innermost first."""
        box = self.named
        while box is not None:
            yield box
            box = box.parent.named


def tokens(page: str) -> Iterator[tuple[int, str | None, bool, bool, Box]]:
    """(hash in its place, text, in an article, in boilerplate, container) of each token.

    The text is that of a piece of text, empty for a tag that ends a block and None for one that doesn't.
    """
    found = list(marked_tokens(page))
    free = unmarked(found)
    for token, text, article, skip, box in found:
        yield token, text, bool(article), skip or not is_free(box, free), box


def is_free(box: Box, free: set[Box]) -> bool:
    """Whether no named container marks what stands in ``box``; with a container, those above it are in ``free`` too."""
    return box.named is None or box.named in free


def unmarked(found: list) -> set[Box]:
    """The named containers that hold the article, which their names do not mark.

    Of several articles those inside the fewest named containers count; a main element counts as one where the
    text outside the articles' named containers is the longer one, or where it is alone.
    """
    opened: dict[str, set[Box]] = {}
    for _, _, article, skip, _ in found:
        if article and not skip:
            opened.setdefault(article[0], set()).add(article[1])
    free: dict[str, set[Box]] = {}
    for tag, boxes in opened.items():
        least = min(box.depth for box in boxes)
        kept = free.setdefault(tag, set())
        for box in boxes:
            for name in box.names() if box.depth == least else ():
                if name in kept:
                    break
                kept.add(name)
    if len(free) < 2 or free["article"] <= free["main"]:
        return free.get("article", free.get("main", set()))
    inner = outer = 0
    for _, text, article, skip, box in found:
        if text and article and not skip:
            n = len(text.strip())
            outer += n if is_free(box, free["main"]) else 0
            inner += n if not is_free(box, free["main"]) and is_free(box, free["article"]) else 0
    return free["main"] if outer > inner else free["article"]


def marked_tokens(page: str) -> Iterator[tuple[int, str | None, tuple | None, bool, Box]]:
    """As ``tokens``, with the tag and the container of the article a token is in.

    A place is a hash of the place around it, so it has one size at any depth, and an end tag without a start
    tag is told by a count, so that no token costs more where elements are nested deeply.
    """
    path: list[tuple[str, tuple | None, bool, Box]] = [("", None, False, Box())]
    n_open: Counter[str] = Counter()
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = (m.group(2) or "").lower()
        if tag and not m.group(1) and path[-1][0] in IMPLIED and tag not in INLINE:
            if path[-1][0] == "p" or path[-1][0] == tag:  # its end tag is left out
                n_open[path.pop()[0]] -= 1
        _, article, skip, box = path[-1]
        if not tag:
            piece = m.group()
            if piece[0] != "<" or piece == "<":
                yield xxhash.xxh64_intdigest(f"{box.place}>{SPACE.sub(' ', piece).strip()}"), piece, article, skip, box
            continue
        ends_block = None if tag in INLINE else ""
        if m.group(1):
            if n_open[tag]:
                while (closed := path.pop()[0]) != tag:
                    n_open[closed] -= 1
                n_open[tag] -= 1
            box = path[-1][3]
            yield xxhash.xxh64_intdigest(f"{box.place}</{tag}"), ends_block, article, skip, box
            continue
        attributes = m.group(3) or ""
        if tag in HEADINGS:
            box.note("heading")
        yield xxhash.xxh64_intdigest(f"{box.place}<{tag}"), ends_block, article, skip, box
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
        elif (mark := named(tag, attributes)) or tag in CONTAINERS or tag in BOILERPLATE:
            said = " ".join(sorted(x for m in ATTRIBUTE.findall(attributes) for x in m))
            place = xxhash.xxh64_hexdigest(f"{box.place}/{tag} {said}")
            inner = Box(box, place, tag in ARTICLE, box.named, box.depth)
            if mark:
                inner.named, inner.depth = inner, box.depth + 1
            if tag in ARTICLE and (not article or article[0] == "main"):
                article = (tag, inner)
            path.append((tag, article, skip or tag in BOILERPLATE, inner))
            n_open[tag] += 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def count_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per host and token of a batch: its pages, their part of the signature and the sum of its places.

    Token 0 stands for the page itself.
    """
    task = TaskContext.get().partitionId()
    n = 0
    for frame in frames:
        found: dict[tuple[str, int], list] = {}
        for host, page in zip(frame["host"], frame["html"]):
            n += 1
            places: dict[int, list[int]] = {0: [0]}
            for k, (token, *_) in enumerate(marked_tokens(page)):
                places.setdefault(token, []).append(k)
            for token, ks in places.items():
                row = found.setdefault((host, token), [0, 0, 0.0])
                row[0] ^= xxhash.xxh64_intdigest(f"{task} {n} {len(ks)}")
                row[1] += 1
                row[2] += ks[0]
        yield pd.DataFrame(
            [(host, signed(token), signed(x), pages, at) for (host, token), (x, pages, at) in found.items()],
            columns=["host", "token", "signature", "pages", "place"],
        )


def host_of(url: str) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(filled(url), r"://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row (host, classes, seldom) per host: the tokens of each class in their order, and those on few pages.

    A template token is on at least half of the host's pages, so there are at most twice as many as a page has.
    """
    rows = pages.select(host_of(url).alias("host"), filled(html).alias("html"))
    counted = rows.mapInPandas(count_tokens, "host string, token long, signature long, pages long, place double")
    found = counted.groupBy("host", "token").agg(
        F.bit_xor("signature").alias("signature"), F.sum("pages").alias("pages"), F.sum("place").alias("place")
    )
    found = saved(found.filter(F.col("pages") >= MIN_PAGES / 2), "html-tokens")
    sizes = found.filter("token = 0").select(F.col("host").alias("host2"), F.col("pages").alias("all_pages"))
    often = (F.col("all_pages") >= MIN_PAGES) & (100 * F.col("pages") >= SUPPORT_PERCENT * F.col("all_pages"))
    kept = found.filter("token <> 0").join(sizes, F.col("host") == F.col("host2")).filter(often)
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token")
    classes = kept.groupBy("host", "signature").agg(
        F.sort_array(F.collect_list(member))["token"].alias("members"), F.max("pages").alias("pages")
    )
    classes = classes.filter(F.size("members") >= MIN_CLASS)
    few = F.when(F.col("pages") < MIN_PAGES, F.col("members"))
    found = classes.groupBy("host").agg(
        F.collect_list("members").alias("classes"), F.flatten(F.collect_list(few)).alias("seldom")
    )
    return saved(found, "html-templates")


def template_places(found: list[int], classes) -> set[int]:
    """The places on a page of the tokens of the classes that are valid on it: in order, and inside one gap of the largest."""
    at: dict[int, list[int]] = {}
    for k, token in enumerate(found):
        at.setdefault(token, []).append(k)
    valid = []
    for members in sorted(classes, key=len, reverse=True):
        firsts = [at[t][0] for t in members if t in at]
        if firsts and all(a < b for a, b in zip(firsts, firsts[1:])):
            valid.append(sorted(k for t in members for k in at.get(t, ())))
    if not valid:
        return set()
    root = valid[0]
    inside = [ks for ks in valid[1:] if len(set(np.searchsorted(root, ks).tolist())) == 1]
    return {k for ks in (root, *inside) for k in ks}


def own_places(found: list, template: set[int], seldom) -> set[int]:
    """The template's places on a page with an article, less those that are the article's own text."""
    seldom = set(seldom)
    template = {k for k in template if not (found[k][2] and signed(found[k][0]) in seldom)}
    sizes = {k: len(text.strip()) for k, (_, text, article, skip, _) in enumerate(found) if text and article and not skip}
    left = sum(n for k, n in sizes.items() if k not in template)
    if 100 * left < MIN_OWN_PERCENT * sum(sizes.values()):
        return set()
    for k, n in sizes.items():
        if n and k not in template:
            found[k][4].note("own")
    return {k for k in template if not (found[k][2] and belongs(found[k][4]))}


def belongs(box: Box) -> bool:
    """Whether template text in a container of an article is the article's: with own text or a heading, or directly in it."""
    return box.is_article or box.own or box.heading


def main_text(page: str, classes=(), seldom=()) -> str:
    """The text of the page's main slots, blocks joined by a space."""
    found = list(tokens(page))
    has_article = any(article for _, _, article, _, _ in found)
    template = template_places([signed(t) for t, *_ in found], classes)
    if has_article:
        template = own_places(found, template, seldom)
    blocks, block = [], []
    for k, (_, text, article, skip, _) in enumerate(found):
        if text == "" or (text is not None and (skip or (has_article and not article) or k in template)):
            blocks.append("".join(block))
            block = []
        elif text is not None:
            block.append(references.unescape(text))
    blocks.append("".join(block))
    clean = (SPACE.sub(" ", b).strip(" ") for b in blocks)
    return " ".join(b for b in clean if b)


def main_texts(pages: pd.Series, classes: pd.Series, seldom: pd.Series) -> pd.Series:
    rows = zip(pages, classes, seldom)
    return pd.Series([main_text(page, *(() if c is None else (c, few))) for page, c, few in rows], dtype=object)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the main ``text`` and its ``n_chars``."""
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    found = templates(pages, url, html)
    found = found.select(*(F.col(c).alias(f"__{c}2" if c == "host" else f"__{c}") for c in found.columns))
    rows = pages.withColumn("__host", host_of(url)).join(found, F.col("__host") == F.col("__host2"), "left")
    rows = rows.withColumn("__text", F.pandas_udf(main_texts, "string")(filled(html), "__classes", "__seldom"))
    return rows.select(*own, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
