"""Main text of web pages.

A page is read as a flat list of text blocks in one pass. Each block has its word count and link density, those of
its neighbours before and after it, and those of its neighbours in the same container and in the one around; weaker
features say whether it is a heading, whether tags or class names, or parts of names, speak of page furniture or of an
article, and whether it follows a heading of reader comments. A decision tree (Gini splits) is trained on the blocks of the small labelled example pages below and says which blocks
are main text.

Defined cases: a null or empty page, or one without main text, gives the empty string; unclosed tags, stray end
tags and broken markup are read on; scripts, styles, markup comments, controls and hidden elements never give text;
the text of forms is furniture to the tree like that of menus; pages are read whole, in time in proportion to their length; repeated rows are treated alike; other columns are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea select option button title svg math iframe object canvas".split())
_OPEN = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements inside a line of text; all others end a block, but for line breaks, which are white space.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset("nav footer aside form header menu dialog head".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements that lay a page out: of their classes only whole names say something, as "has-sidebar" is no sidebar.
_LAYOUT_TAGS = frozenset("article center div main section table tbody td tr".split())
#: Words in class, id or role that mark furniture or the article.
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion reader-comments related replies reply search share sharing sidebar side-bar signup social sponsor sponsored sponsor subscribe toolbar widget widgets alert complementary contentinfo".split()
)
#: A name that begins so says what is around or what is missing.
_ABOUT = frozenset("has have no not non with without hide hides show shows".split())
#: Headings over reader comments, whatever stands before or after them in digits and marks.
_COMMENTS = re.compile(r"[\W\d_]*(?:(?:reader|user|your|all|latest|post|leave|add|write|view|show|an?|the)\s+)*(?:comments?|repl(?:y|ies)|responses?|discussion|kommentare?|comentarios?|commentaires?)[\W\d_]*", re.I)
_ARTICLE_WORDS = frozenset("article article-body main main-content post post-content entry-content story story-body content".split())
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = (
    "words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "container_words", "container_link_density",
    "container_share", "outer_words", "outer_link_density", "furniture", "article", "heading", "named_part", "after_comments",
)
#: The labelled table: blocks of example pages as (containers, tag, words, linked words, 1 for main text). Blocks that
#: follow each other with the same containers are in the same ones; a mark (') makes another container; a tag may carry its
#: text (h3=Comments).
EXAMPLES = (
    # a news page
    (("nav/ul", "li", 1, 1, 0), ("nav/ul", "li", 1, 1, 0), ("nav/ul", "li", 2, 2, 0), ("nav/ul", "li", 1, 1, 0), ("div.ad", "", 9, 0, 0),
     ("article", "h1", 8, 0, 1), ("article", "p", 40, 0, 1), ("article", "p", 90, 0, 1), ("article", "p", 1, 0, 1), ("article", "p", 60, 0, 1),
     ("article", "p", 2, 0, 1), ("article", "p", 150, 3, 1), ("article", "p", 30, 12, 1), ("footer", "", 12, 0, 0)),
    # the same without names
    (("div/ul", "li", 2, 2, 0), ("div/ul", "li", 1, 1, 0), ("div/ul", "li", 3, 3, 0), ("div/ul", "li", 2, 2, 0), ("div", "h1", 6, 0, 1), ("div", "p", 70, 0, 1),
     ("div", "p", 45, 2, 1), ("div", "p", 4, 0, 1), ("div", "p", 120, 0, 1), ("div", "p", 15, 0, 1), ("div'", "p", 7, 0, 0)),
    (("div", "p", 2, 2, 0), ("div", "p", 3, 3, 0), ("div'", "h1", 9, 0, 1), ("div'", "p", 200, 0, 1), ("div'", "p", 130, 0, 1), ("div'", "p", 6, 0, 1), ("div'", "p", 60, 4, 1),
     ("div", "p", 8, 0, 0), ("div'", "p", 14, 2, 0)),
    # linked and short paragraphs, and a list of links, inside an article
    (("nav", "", 3, 3, 0), ("article", "h1", 5, 0, 1), ("article", "p", 50, 0, 1), ("article", "p", 4, 4, 1), ("article", "p", 2, 0, 1), ("article", "p", 80, 0, 1),
     ("article/ul", "li", 3, 3, 0), ("article/ul", "li", 2, 2, 0), ("article/ul", "li", 5, 5, 0), ("article/ul", "li", 4, 4, 0), ("article", "p", 30, 0, 1)),
    (("article", "p", 45, 0, 1), ("article", "p", 25, 0, 1), ("article/ul", "li", 3, 3, 0), ("article/ul", "li", 3, 3, 0), ("article/ul", "li", 9, 9, 0), ("article/ul", "li", 3, 3, 0)),
    (("article", "p", 60, 0, 1), ("article", "p", 3, 3, 1), ("article", "p", 2, 0, 1), ("article", "p", 75, 0, 1)),
    (("article", "p", 9, 0, 1), ("article", "p", 3, 3, 1), ("article", "p", 2, 0, 1), ("article", "p", 12, 0, 1)),
    # titles in headers, asides and comments
    (("header", "p", 3, 3, 0), ("article/header", "h1", 7, 0, 1), ("article/header", "p", 12, 0, 1), ("article", "p", 60, 0, 1), ("article", "p", 85, 0, 1),
     ("article/aside", "p", 25, 0, 0), ("article", "p", 33, 0, 1), ("article/aside", "p", 40, 0, 0), ("article", "p", 28, 0, 1),
     ("article/div.comments", "p", 20, 0, 0), ("article/div.comments", "p", 44, 0, 0), ("article/div.comments", "p", 9, 0, 0), ("footer", "p", 16, 0, 0)),
    (("article", "p", 100, 0, 1), ("article", "p", 130, 0, 1), ("article", "p", 90, 0, 1), ("section.comments", "p", 120, 0, 0), ("section.comments", "p", 200, 0, 0), ("section.comments", "p", 80, 0, 0)),
    (("main", "h1", 4, 0, 1), ("main", "p", 35, 0, 1), ("main", "p", 55, 0, 1), ("div.comments", "p", 30, 0, 0), ("div.comments", "p", 90, 0, 0), ("div.comments", "p", 140, 0, 0), ("div.comments", "p", 60, 0, 0)),
    # furniture names around the only text of a page
    (("div.banner", "p", 220, 0, 1), ("div.banner", "p", 240, 0, 1), ("div.banner", "p", 190, 4, 1)),
    (("div.nav/ul", "li", 2, 2, 0), ("div.nav/ul", "li", 2, 2, 0), ("div.sidebar", "p", 180, 0, 1), ("div.sidebar", "p", 250, 0, 1), ("div.sidebar", "p", 90, 0, 1), ("div.sidebar", "p", 4, 0, 1)),
    (("div.sidebar", "p", 25, 0, 0), ("footer", "p", 25, 0, 0)),
    (("div.banner", "p", 150, 0, 1), ("div.banner", "p", 130, 0, 1)), (("div.menu", "p", 90, 0, 1), ("div.menu", "p", 140, 0, 1), ("div.menu", "p", 60, 0, 1)),
    (("div.banner", "p", 40, 0, 0), ("div.banner", "p", 12, 0, 0)),
    (("div.ad", "p", 30, 0, 0),),
    # notices, lists of text, forms
    (("div.cookie", "p", 30, 0, 0), ("div.cookie", "p", 2, 2, 0), ("main", "h1", 6, 0, 1), ("main", "p", 70, 0, 1), ("main", "p", 44, 0, 1), ("main/ul", "li", 9, 0, 1), ("main/ul", "li", 14, 1, 1),
     ("main/ul", "li", 7, 0, 1), ("main", "h2", 3, 0, 1), ("main", "p", 40, 0, 1), ("form", "p", 8, 0, 0)),
    (("div.notice", "p", 18, 0, 0), ("article", "h1", 5, 0, 1), ("article", "p", 22, 0, 1), ("article", "p", 11, 0, 1), ("article/div.notice", "p", 24, 0, 0), ("article", "p", 18, 0, 1)),
    # teasers around prose
    (("div", "p", 12, 12, 0), ("div", "p", 15, 13, 0), ("div", "p", 9, 9, 0), ("div'", "p", 60, 0, 1), ("div'", "p", 90, 0, 1), ("div'", "p", 70, 10, 1), ("div", "p", 18, 16, 0), ("div", "p", 20, 18, 0)),
    (("article", "p", 60, 0, 1), ("article", "p", 75, 0, 1), ("article/div.related", "p", 10, 10, 0), ("article/div.related", "p", 12, 11, 0), ("article", "p", 25, 0, 1)),
    # sections and tables
    (("article/section", "h2", 2, 0, 1), ("article/section", "p", 50, 0, 1), ("article/section'", "h2", 4, 0, 1), ("article/section'", "p", 80, 0, 1), ("article/section'", "p", 12, 0, 1), ("article/section", "h2", 3, 0, 1), ("article/section", "p", 20, 0, 1)),
    (("table/tr/td", "p", 2, 2, 0), ("table/tr/td", "p", 3, 3, 0), ("table/tr/td'", "p", 90, 0, 1), ("table/tr/td'", "p", 60, 0, 1), ("table/tr/td'", "p", 3, 0, 1), ("table/tr/td", "p", 10, 10, 0)),
    # short articles
    (("nav/ul", "li", 1, 1, 0), ("nav/ul", "li", 1, 1, 0), ("article", "h1", 3, 0, 1), ("article", "p", 12, 0, 1), ("footer", "", 9, 0, 0)),
    (("nav/ul", "li", 1, 1, 0), ("div.ad", "", 11, 0, 0), ("article", "h1", 1, 0, 1), ("article", "p", 1, 0, 1), ("footer", "", 14, 0, 0)),
    (("div.ad", "", 7, 0, 0), ("article", "h1", 2, 0, 1), ("article", "p", 2, 0, 1), ("article", "p", 5, 0, 1), ("div.ad", "", 10, 0, 0), ("footer", "", 7, 0, 0)),
    (("article", "p", 1, 0, 1),),
    (("div", "p", 14, 0, 1), ("div", "p", 14, 0, 1)), (("div", "p", 40, 0, 1), ("div", "p", 40, 0, 1)), (("div", "p", 120, 0, 1), ("div", "p", 120, 0, 1)),
    (("", "h1", 4, 0, 1), ("", "p", 60, 0, 1), ("", "p", 80, 0, 1), ("", "p", 3, 0, 1), ("", "p", 20, 0, 1)),
    # small containers beside short texts
    (("div", "h1", 2, 0, 1), ("div", "p", 25, 0, 1), ("div", "p", 25, 0, 1), ("div'", "p", 7, 0, 0)),
    (("article", "h1", 1, 0, 1), ("article", "p", 24, 0, 1), ("article", "p", 22, 0, 1), ("div", "p", 7, 0, 0), ("div'", "p", 12, 0, 0)),
    (("div/div/ul", "li", 1, 1, 0), ("div/div/ul", "li", 1, 1, 0), ("div/div'", "h2", 2, 0, 1), ("div/div'", "p", 25, 0, 1), ("div/div'", "p", 1, 0, 1), ("div/div'", "p", 25, 0, 1), ("div/div", "", 3, 0, 0)),
    (("div/div", "p", 50, 0, 1), ("div/div'", "p", 60, 0, 1), ("div/div", "p", 45, 0, 1), ("div/div'", "p", 30, 0, 1)),
    (("div", "h1", 3, 0, 1), ("div", "p", 14, 0, 1), ("div", "p", 16, 0, 1), ("div'", "p", 4, 0, 0), ("div", "p", 5, 1, 0)),
    # headings of furniture and of lists
    (("aside", "h3", 1, 0, 0), ("aside", "p", 12, 0, 0), ("article", "h1", 4, 0, 1), ("article", "p", 40, 0, 1), ("article", "h2", 2, 0, 1), ("article", "p", 35, 0, 1), ("div.sidebar", "h2", 2, 0, 0), ("div.sidebar/ul", "li", 2, 2, 0),
     ("footer", "h4", 2, 0, 0), ("footer", "p", 6, 0, 0)),
    (("article", "h2", 3, 0, 1), ("article", "p", 80, 0, 1), ("article/div.related", "h3", 2, 0, 0), ("article/div.related", "p", 5, 5, 0), ("article/div.comments", "h3", 1, 0, 0), ("article/div.comments", "p", 15, 0, 0)),
    (("div", "h3", 2, 0, 0), ("div", "p", 5, 5, 0), ("div", "p", 6, 6, 0), ("div", "p", 4, 4, 0), ("div'", "h1", 4, 0, 1), ("div'", "p", 60, 0, 1), ("div'", "p", 50, 0, 1), ("div", "h3", 2, 0, 0), ("div", "p", 7, 7, 0)),
    (("article", "p", 23, 0, 1),), (("article", "p", 25, 0, 1),), (("article", "h1", 2, 0, 1), ("article", "p", 24, 0, 1)), (("div", "p", 24, 0, 1),), (("main", "p", 22, 0, 1), ("footer", "p", 9, 0, 0)),
    # names of which a part says something: notices, adverts, widgets; and such that do not
    (("div.cookie-notice", "p", 30, 0, 0), ("article", "h1", 5, 0, 1), ("article", "p", 45, 0, 1), ("article", "p", 60, 0, 1), ("div.cookie-notice", "p", 60, 0, 0)),
    (("div.cookie-notice", "p", 90, 0, 0), ("div.cookie-notice", "p", 3, 3, 0), ("div", "h1", 5, 0, 1), ("div", "p", 80, 0, 1), ("div", "p", 55, 0, 1), ("div'", "p", 9, 0, 0)),
    (("div.site-notice", "p", 12, 0, 0), ("main", "h1", 4, 0, 1), ("main", "p", 50, 0, 1), ("main", "p", 25, 0, 1), ("section.newsletter-box", "h3", 3, 0, 0), ("section.newsletter-box", "p", 45, 0, 0)),
    (("article", "h1", 5, 0, 1), ("article", "p", 40, 0, 1), ("article/div.ad-slot", "p", 8, 0, 0), ("article", "p", 35, 0, 1), ("article/div.ad-slot", "p", 25, 0, 0), ("article", "p", 50, 0, 1), ("article/div.ad-slot", "p", 60, 0, 0), ("article", "p", 30, 0, 1)),
    (("article", "p", 60, 0, 1), ("article/div.ad-slot", "p", 120, 4, 0), ("article", "p", 70, 0, 1), ("article/section.related-posts", "p", 14, 3, 0), ("article/section.related-posts", "p", 30, 0, 0)),
    (("div", "p", 70, 0, 1), ("div", "p", 40, 0, 1), ("div/div.sponsored-box", "p", 30, 0, 0), ("div", "p", 45, 0, 1), ("div'/div.sidebar-widget", "p", 40, 0, 0), ("div'/div.footer-text", "p", 18, 0, 0)),
    (("article/div.post-header", "h1", 6, 0, 1), ("article/div.post-header", "p", 14, 0, 1), ("article", "p", 60, 0, 1), ("article", "p", 40, 0, 1), ("div.site-footer", "p", 20, 0, 0)),
    (("div.entry-header", "h1", 6, 0, 1), ("div.entry-text", "p", 60, 0, 1), ("div.entry-text", "p", 50, 0, 1)),
    (("div.content-sidebar-wrap", "h1", 5, 0, 1), ("div.content-sidebar-wrap", "p", 70, 0, 1), ("div.content-sidebar-wrap", "p", 90, 0, 1), ("div.content-sidebar-wrap", "p", 40, 0, 1)),
    (("div.has-sidebar", "h1", 3, 0, 1), ("div.has-sidebar", "p", 40, 0, 1), ("div.has-sidebar", "p", 60, 0, 1)), (("div.no-ads", "p", 25, 0, 1), ("div.no-ads", "p", 40, 0, 1)),
    (("article", "p", 25, 0, 1), ("article", "p", 25, 0, 1), ("article/div.comment-list", "p", 20, 0, 0), ("article/div.comment-list", "p", 60, 0, 0), ("div.comment-list", "p", 90, 0, 0)),
    # reader comments without names
    (("article", "h1", 4, 0, 1), ("article", "p", 40, 0, 1), ("article", "p", 60, 0, 1), ("div", "h3=Comments", 1, 0, 0), ("div", "p", 30, 0, 0), ("div", "p", 12, 0, 0), ("div", "p", 80, 0, 0)),
    (("article", "h1", 4, 0, 1), ("article", "p", 35, 0, 1), ("article", "p", 20, 0, 1), ("article/div", "h3=3 comments", 2, 0, 0), ("article/div", "p", 25, 0, 0), ("article/div", "p", 60, 0, 0), ("article/div", "p", 8, 0, 0)),
    (("div", "h1", 4, 0, 1), ("div", "p", 55, 0, 1), ("div", "p", 45, 0, 1), ("div'", "h2=Leave a reply", 3, 0, 0), ("div'", "p", 10, 0, 0), ("div'", "p", 40, 0, 0), ("div'", "p", 120, 0, 0)),
    (("article", "h2", 4, 0, 1), ("article", "p", 30, 0, 1), ("article", "h2=Comments", 1, 0, 0), ("article", "p", 22, 0, 0), ("article", "p", 45, 0, 0), ("article", "p", 90, 0, 0)),
    # forms of any length
    (("article", "h1", 4, 0, 1), ("article", "p", 50, 0, 1), ("form", "p", 30, 0, 0), ("form", "p", 60, 0, 0), ("form", "p", 120, 0, 0)),
    (("article", "p", 50, 0, 1), ("article/form", "p", 20, 0, 0), ("article", "p", 45, 0, 1), ("article/form", "p", 80, 0, 0)),
    # pages of links
    (("div.content/ul", "li", 5, 5, 0), ("div.content/ul", "li", 4, 4, 0), ("div.content/ul", "li", 6, 6, 0), ("div.content/ul", "li", 5, 5, 0)),
    (("article", "p", 4, 4, 0), ("article", "p", 5, 5, 0), ("article", "p", 3, 3, 0)),
    (("div", "p", 2, 2, 0), ("div", "p", 3, 2, 0), ("div", "p", 6, 6, 0), ("div'", "p", 4, 4, 0)),
)


#: Pages that are made by ``varied``.
VARIED = 1_500


def varied(n_pages: int = VARIED, seed: int = 0) -> Iterator[tuple]:
    """More example pages: an article of one to eight paragraphs, with or without a menu and a footer, and up to two more
    pieces before, inside or after it: notices and adverts by a part of their name, forms, asides, and comments under
    their heading. All blocks' lengths come from one distribution, so that no length alone tells them apart."""
    rng = np.random.default_rng(seed)
    words = lambda low=3, high=150: int(np.exp(rng.uniform(np.log(low), np.log(high + 1))))
    for _ in range(n_pages):
        holder = ("article", "article", "main", "div", "div.content")[rng.integers(5)]
        body = [[(holder, "h1", words(1, 9), 0, 1)], *([(holder, "p", words(), 0, 1)] for _ in range(rng.integers(1, 9)))]
        if rng.random() < 0.3:
            body.insert(int(rng.integers(1, len(body))), [(holder, "h2", words(1, 8), 0, 1)])
        before, after, comments = [], [], []
        for _ in range(rng.integers(0, 3)):
            kind = ("div.cookie-notice", "div.ad-slot", "form", "aside", "comments")[rng.integers(5)]
            inside = rng.random() < 0.5
            where = kind if not inside else f"{holder}/{kind}"
            if kind == "comments":
                where = (f"{holder}/div" if rng.random() < 0.5 else holder) if inside else ("div'" if rng.random() < 0.7 else "")
            piece = [(where, "p", words(), 0, 0) for _ in range(rng.integers(1, 4))]
            if kind == "comments":
                piece.insert(0, (where, "h3=Comments", 1, 0, 0))
            elif rng.random() < 0.3:
                piece.insert(0, (where, "h3", words(1, 5), 0, 0))
            if kind == "comments":  # they end the article or the page
                comments = piece
            elif inside:
                body.insert(int(rng.integers(1, len(body) + 1)), piece)
            else:
                (before if rng.random() < 0.5 else after).extend(piece)
        body.append(comments)
        menu = [("nav/ul", "li", n, n, 0) for n in (words(1, 3) for _ in range(rng.integers(0, 8)))]
        foot = [("footer", "p", words(1, 20), 0, 0) for _ in range(rng.integers(0, 3))]
        foot = [("footer", "", *foot[0][2:])] if len(foot) == 1 else foot
        yield (*menu, *before, *(r for part in body for r in part), *after, *foot)


def example_page(rows: tuple) -> str:
    """The HTML of an example page."""
    out, open_ = [], []
    for path, tag, words, linked, _ in rows:
        names = [n for n in path.split("/") if n]
        same = 0
        while same < min(len(names), len(open_)) and names[same] == open_[same]:
            same += 1
        for name in reversed(open_[same:]):
            out.append(f"</{name.rstrip(chr(39)).split('.')[0]}>")
        for name in names[same:]:
            kind, _, cls = name.rstrip("'").partition(".")
            out.append(f'<{kind} class="{cls}">' if cls else f"<{kind}>")
        open_ = names
        tag, _, text = tag.partition("=")
        text = text or (f"<a href=x>{'w ' * linked}</a>" if linked else "") + "w " * (words - linked)
        out.append(f"<{tag}>{text}</{tag}>" if tag else text)
    return "".join(out) + "".join(f"</{name.rstrip(chr(39)).split('.')[0]}>" for name in reversed(open_))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the example pages' blocks."""
    pages = [*EXAMPLES, *varied()]
    rows = [f for page in pages for _, f in features(example_page(page))]
    return np.array(rows, dtype=float), np.array([r[4] for page in pages for r in page], dtype=float)


class Tree:
    """A small classification tree."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 12):
        self.value = float(labels.mean()) if len(labels) else 0.0
        self.split: tuple[int, float] | None = None
        if depth == 0 or self.value in (0.0, 1.0):
            return
        n = len(labels)
        best = 2 * n * self.value * (1 - self.value) - 1e-9
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            value, ones = rows[order, f], np.cumsum(labels[order])
            cut = np.flatnonzero(value[1:] > value[:-1]) + 1  # rows below each cut
            if len(cut):
                low, high = ones[cut - 1], ones[-1] - ones[cut - 1]
                found = 2 * (low * (1 - low / cut) + high * (1 - high / (n - cut)))  # Gini impurity of both sides
                k = int(np.argmin(found))
                if found[k] < best - 1e-12:
                    best, self.split = found[k], (f, float(value[cut[k] - 1] + value[cut[k]]) / 2)
        if self.split:
            low = rows[:, self.split[0]] <= self.split[1]
            self.low, self.high = Tree(rows[low], labels[low], depth - 1), Tree(rows[~low], labels[~low], depth - 1)

    def __call__(self, row: tuple) -> float:
        node = self
        while node.split:
            node = node.low if row[node.split[0]] <= node.split[1] else node.high
        return node.value


def train(columns: tuple[str, ...] = FEATURES) -> Tree:
    """The tree of the labelled table; features that are not among ``columns`` are held at 0."""
    rows, labels = labelled()
    rows[:, [k for k, name in enumerate(FEATURES) if name not in columns]] = 0.0
    return Tree(rows, labels)


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(furniture, article, hidden, part of a name says furniture) of an element."""
    furniture, article, part = tag in _FURNITURE_TAGS, tag in _ARTICLE_TAGS, False
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return furniture, article, False, False
    if tag not in ("html", "body"):
        for m in _NAMES.finditer(attrs):
            names = (m[1] or m[2] or m[3] or "").lower().split()
            parts = set(names) if tag in _LAYOUT_TAGS else {p for n in names for p in (n, *re.split(r"[-_]+", n))}
            furniture = furniture or bool(parts & _FURNITURE_WORDS)
            article = article or bool(set(names) & _ARTICLE_WORDS)
            for pieces in (re.split(r"[-_]+", n) for n in names):
                part = part or len(pieces) > 1 and pieces[0] not in _ABOUT and not _FURNITURE_WORDS.isdisjoint(pieces)
    return furniture, article, bool(_HIDDEN.search(attrs)), part


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, end, attributes): the text before each tag and the tag, empty for what is passed over and at the
    end. Every search either moves on by what it read or is not repeated."""
    lower = None
    at = start = 0
    last = page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0 or at > last and not page.startswith("<!--", at):
            break  # no tag ends after this
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], "", False, ""
            at = start = len(page) if end < 0 else end + 3
            continue
        m = _OPEN.match(page, at)
        if m:
            tag = m["tag"].lower()
            yield page[start:at], tag, bool(m["end"]), m["attrs"]
            at = start = m.end()
            if tag in _RAW and not m["end"]:
                if lower is None:
                    lower = page.lower() if len(page.lower()) == len(page) else page.translate(_ASCII_LOWER)
                end = lower.find("</" + tag, at)
                end = len(page) if end < 0 else page.find(">", end)
                at = start = len(page) if end < 0 or end == len(page) else end + 1
        elif page[at + 1 : at + 2] in ("!", "?", "/") or page[at + 1 : at + 2].isalpha():
            # a declaration or broken markup: up to the next end of a tag
            yield page[start:at], "", False, ""
            at = start = page.find(">", at) + 1
        else:
            at += 1
    yield page[start:], "", False, ""


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Elements that hold one block; their neighbours are in the element around.
_LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd pre figcaption caption".split())


def features(page: str) -> list[tuple[str, tuple]]:
    """The page's text blocks in order with their FEATURES."""
    found: list[tuple] = []  # text, words, link density, furniture, article, heading, container, part, after comments
    parts: list[str] = []
    linked: list[str] = []
    above = [0]  # the container around each container; 0 is the page
    sums = [[0, 0]]  # words and linked words in each container
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []  # open elements: tag, furniture, article, hidden, container, part
    comments: int | None = None  # the container of the last heading of comments, while no other heading follows
    opened: dict[str, int] = {}
    link = heading = 0

    def flush() -> None:
        nonlocal comments
        if parts:
            words = html.unescape("".join(parts)).split()
            if words and not (stack and stack[-1][3]):
                links = min(len(words), len(html.unescape(" ".join(linked)).split()))
                _, furniture, article, _, at, part = stack[-1] if stack else ("", False, False, False, 0, False)
                if stack and stack[-1][0] in _LEAVES:
                    at = above[at]
                sums[at][0] += len(words)
                sums[at][1] += links
                text = " ".join(words)
                if heading:
                    comments = at if len(text) < 60 and _COMMENTS.fullmatch(text) else None
                elif comments is not None and not inside(at, comments):
                    comments = None
                found.append((text, len(words), links / len(words), int(furniture), int(article), int(bool(heading)), at, int(part), int(comments is not None)))
            parts.clear()
            linked.clear()

    def inside(at: int, outer: int) -> bool:
        for _ in range(8):  # containers around a comment are few
            if at == outer:
                return True
            at = above[at]
        return False

    def close(n: int) -> None:
        for tag, *_ in stack[n:]:
            opened[tag] -= 1
        del stack[n:]

    for text, tag, end, attrs in tokens(page):
        if text:
            parts.append(text)
            if link:
                linked.append(text)
        if not tag:
            continue
        if tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            parts.append(" ")
        elif tag not in _INLINE:
            flush()
            link = 0
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                heading = 0 if end else 1
            elif tag in ("p", "li"):
                heading = 0
            if tag in _VOID:
                continue
            if end:
                if opened.get(tag):
                    n = len(stack) - 1
                    while stack[n][0] != tag:
                        n -= 1
                    close(n)
                continue
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or heading:
                # these close of themselves when the next begins
                while stack and (stack[-1][0] == tag or stack[-1][0] == "p"):
                    close(len(stack) - 1)
            elif stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            furniture, article, hidden, part = _marks(tag, attrs)
            _, was_furniture, was_article, was_hidden, at, was_part = stack[-1] if stack else ("", False, False, False, 0, False)
            if tag == "header" and was_article:
                furniture = False  # an article's own header holds its title
            above.append(at)
            sums.append([0, 0])
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, furniture or was_furniture and tag not in _ARTICLE_TAGS, article or was_article, hidden or was_hidden, len(above) - 1, part or was_part and tag not in _ARTICLE_TAGS))
    flush()
    for at in range(len(above) - 1, 0, -1):  # inner containers come later
        for k in (0, 1):
            sums[above[at]][k] += sums[at][k]
    density = lambda at: sums[at][1] / max(1, sums[at][0])
    out = []
    none = (None, 0, 0.0)
    for k, (text, words, links, furniture, article, is_heading, at, part, comment) in enumerate(found):
        before = found[k - 1] if k else none
        after = found[k + 1] if k + 1 < len(found) else none
        around = above[at]
        out.append((text, (words, links, before[1], before[2], after[1], after[2], sums[at][0], density(at), sums[at][0] / max(1, sums[0][0]), sums[around][0], density(around), furniture, article, is_heading, part, comment)))
    return out


def main_text(page: str | None, tree: Tree) -> str:
    return "\n\n".join(text for text, row in features(page or "") if tree(row) >= 0.5)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    model = tree or train()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
