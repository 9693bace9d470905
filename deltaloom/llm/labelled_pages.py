"""Labelled pages from a rule: templates in many styles whose words say what they are.

Words that begin with ``k`` belong to the main text, words that begin with ``z`` do not. The
pages vary in elements, class names, order, nesting and in what is missing; they stand for
hand-labelled pages and are the only source of the extractor's weights.
"""

from __future__ import annotations

import random

# Element and class names in common use on web pages.
MAIN = [
    '<article>', '<article class="post">', '<main>', '<main id="content">', '<div class="content">',
    '<div class="article-body">', '<div id="main-content">', '<div class="entry-content">', '<section class="story">',
    '<div class="post-content">', '<div class="text">', '<div itemprop="articleBody">', '<div>', '<td class="body">',
]
BOILERPLATE = [
    '<nav>', '<nav class="menu">', '<ul class="menu">', '<div class="navbar">', '<div id="nav">', '<header>',
    '<div class="header">', '<div class="site-header">', '<footer>', '<div class="footer">', '<div id="footer">',
    '<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">',
    '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="banner">',
    '<div class="sponsored">', '<div class="promo">', '<div class="cookie-notice">', '<div id="cookie">',
    '<div class="notice">', '<div class="consent">', '<div class="gdpr">', '<div class="popup">', '<div class="modal">',
    '<div class="alert">', '<div class="newsletter">', '<div class="subscribe">', '<form>', '<form class="search">',
    '<div class="login">', '<div class="comments">', '<section id="comments">', '<ol class="comment-list">',
    '<div class="comment">', '<div class="replies">', '<div class="reader-comments">', '<div class="related">',
    '<div class="recommended">', '<div class="share">', '<div class="social">', '<div class="breadcrumb">',
    '<div class="pagination">', '<div class="tags">', '<div class="copyright">', '<div class="skip">', '<select>',
    '<button>', '<div role="navigation">', '<div role="banner">', '<div role="contentinfo">',
    '<div role="complementary">', '<div class="outbrain">', '<div class="toolbar">', '<div class="menu">',
]
HEAD = ["<title>", "<style>", "<script>", "<noscript>"]
WRAPS = ['<div class="page">', '<div class="wrapper">', '<div id="container">', '<div class="row">', "<div>", "<section>", ""]
BLOCKS = ["p", "p", "p", "p", "p", "h2", "h3", "blockquote", "ul", "ol", "pre", "table", "figure", "div", "section"]
INLINE = ["b", "i", "em", "strong", "a", "span", "code"]


def close(tag: str) -> str:
    return f"</{tag[1:].split()[0].rstrip('>')}>" if tag else ""


def page(rng: random.Random) -> str:
    def words(kind: str, least: int, most: int) -> str:
        made = [kind + "x" * rng.randint(1, 8) for _ in range(rng.randint(least, most))]
        if kind == "k" and rng.random() < 0.4:
            at, tag = rng.randrange(len(made)), rng.choice(INLINE)
            made[at] = f"<{tag}>{made[at]}</{tag}>" if rng.random() < 0.8 else f"<{tag}>{made[at]}"
        return " ".join(made)

    def block() -> str:
        tag = rng.choice(BLOCKS)
        if tag in ("ul", "ol"):
            return f"<{tag}>" + "".join(f"<li>{words('k', 2, 20)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if tag == "table":
            return "<table><tr>" + "".join(f"<td>{words('k', 1, 6)}</td>" for _ in range(3)) + "</tr></table>"
        if tag == "figure":
            return f"<figure><img src='x'><figcaption>{words('k', 3, 12)}</figcaption></figure>"
        if tag in ("h2", "h3"):
            return f"<{tag}>{words('k', 2, 9)}</{tag}>"
        body = words("k", 1, 120).replace(" ", "<br> " if rng.random() < 0.1 else " ", 3)
        return f"<{tag}>{body}" + (f"</{tag}>" if rng.random() < 0.85 else "")

    def boilerplate() -> str:
        tag = rng.choice(BOILERPLATE)
        inner = rng.choice(["li", "links", "text", "p"])
        if inner == "li":
            body = "<ul>" + "".join(f"<li><a href='#'>{words('z', 1, 4)}</a></li>" for _ in range(rng.randint(1, 9))) + "</ul>"
        elif inner == "links":
            body = " | ".join(f"<a href='#'>{words('z', 1, 3)}</a>" for _ in range(rng.randint(1, 6)))
        elif inner == "p":
            body = "".join(f"<p>{words('z', 2, 40)}</p>" for _ in range(rng.randint(1, 4)))
        else:
            body = words("z", 1, 40)
        return tag + body + close(tag)

    head = "".join(t + words("z", 1, 12) + close(t) for t in HEAD if rng.random() < 0.8)
    before = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
    after = "".join(boilerplate() for _ in range(rng.randint(0, 4)))
    parts = [f"<h1>{words('k', 2, 12)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(rng.randint(1, 10)):
        parts.append(block())
        if rng.random() < 0.08:
            parts.append(boilerplate())
    main, wrap = rng.choice(MAIN), rng.choice(WRAPS)
    body = before + main + "".join(parts) + close(main) + after
    return f"<!DOCTYPE html><html><head>{head}</head><body>{wrap}{body}{close(wrap)}</body></html>"


def pages(n: int, seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
