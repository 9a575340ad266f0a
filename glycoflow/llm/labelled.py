"""Labelled pages to train the block classifier on: composed from layouts of common sites, with made-up words.

Every page is HTML in which the blocks of the main text carry a mark, which is taken off again after the page is cut into
blocks. Layouts differ in where the article stands (semantic elements, named boxes, tables, bare paragraphs) and in what
surrounds and interrupts it: menus, adverts, notices, side bars, forms, share bars, related links, reader comments.
"""

from __future__ import annotations

import random

from glycoflow.llm.blocks import Block, blocks

#: A character of the private use area.
MARK = ""
#: How sites name their boxes.
ARTICLE = ["article", "post", "entry", "story", "content", "main", "text", "body", "page content", "article body", "post content", "entry content", "story text"]
ADVERT = ["ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "ad slot", "promotion"]
NOTICE = ["notice", "cookie", "consent", "alert", "banner notice", "cookie notice", "gdpr", "disclaimer", "message", "warning", "popup", "modal", "paywall"]
SIDE = ["sidebar", "side", "widget", "aside", "related", "recommended", "popular", "trending", "tags", "archive", "more", "teaser", "most read"]
MENU = ["nav", "menu", "navigation", "breadcrumb", "breadcrumbs", "navbar", "toolbar", "links", "skip", "pagination", "pager", "topbar"]
HEAD = ["header", "masthead", "top", "site header", "logo", "branding"]
FOOT = ["footer", "foot", "copyright", "colophon", "bottom", "site footer", "legal", "credits"]
COMMENTS = ["comments", "comment", "comment list", "discussion", "replies", "reply", "responses", "reader comments", "respond", "thread", "disqus"]
FORM = ["form", "newsletter", "subscribe", "signup", "search", "login", "contact", "poll"]
SHARE = ["share", "social", "sharing", "meta", "byline", "follow", "share buttons", "author box", "actions"]
LEGAL = ["All rights reserved", "Privacy", "Terms of use", "Contact", "Imprint", "About us"]
SYLLABLES = ["an", "be", "ca", "de", "er", "fo", "ge", "ha", "in", "ja", "ke", "lo", "ma", "no", "or", "pe", "qui", "re", "st", "ti", "un", "ve", "wi", "é", "ü", "ção", "ñe"]


class Site:
    """Words, sentences and boxes of one page."""

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.words = ["".join(self.random.choices(SYLLABLES, k=self.random.randint(1, 4))) for _ in range(300)]

    def phrase(self, least: int, most: int) -> str:
        said = " ".join(self.random.choices(self.words, k=self.random.randint(least, most)))
        return said[:1].upper() + said[1:]

    def sentences(self, least: int, most: int) -> str:
        r = self.random
        out = []
        for _ in range(r.randint(least, most)):
            said = self.phrase(2, 18)
            if r.random() < 0.4:
                said = said.replace(" ", ", ", 1)
            out.append(said + r.choice("...!?") * (r.random() < 0.93))
        return " ".join(out)

    def box(self, names: list[str], inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        r = self.random
        name = r.choice(names).replace(" ", r.choice("-_ "))
        return "<{0} {1}=\"{2}\">{3}</{0}>".format(r.choice(tags), r.choice(["class", "class", "id"]), name, inner)

    def links(self, least: int, most: int) -> str:
        r = self.random
        items = [f'<a href="/{r.choice(self.words)}">{self.phrase(1, 5)}</a>' for _ in range(r.randint(least, most))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (r.random() < 0.9) for x in items) + "</ul>"
        return r.choice([" | ", " ", "<br>", " &middot; "]).join(items)

    def aside(self) -> str:
        """Something beside the main text."""
        r = self.random
        kind = r.randrange(7)
        if kind == 0:
            return self.box(ADVERT, r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", f'<a href="/x">{self.phrase(2, 9)}</a>']), ("div", "aside", "section"))
        if kind == 1:
            return self.box(NOTICE, r.choice([self.sentences(1, 4), f"<p>{self.sentences(1, 3)}</p><button>{self.phrase(1, 2)}</button>"]), ("div", "aside", "section"))
        if kind == 2:
            inner = f"<h{r.randint(2, 4)}>{self.phrase(1, 3)}</h3>" + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>"])
            return f"<aside>{inner}</aside>" if r.random() < 0.4 else self.box(SIDE, inner, ("div", "aside", "section"))
        if kind == 3:
            inner = f"<label>{self.phrase(1, 3)}</label><input name=q><p>{self.sentences(1, 2)}</p><button>{self.phrase(1, 2)}</button>"
            return f"<form action=/s>{inner}</form>" if r.random() < 0.5 else self.box(FORM, f"<form>{inner}</form>")
        if kind == 4:
            return self.box(SHARE, r.choice([self.links(2, 5), self.phrase(2, 6), f"<span>{self.phrase(1, 3)}</span> <time>{r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 25)}</time>"]))
        if kind == 5:
            return f"<nav>{self.links(2, 9)}</nav>" if r.random() < 0.5 else self.box(MENU, self.links(2, 9), ("div", "nav", "ul"))
        return f"<!-- {self.phrase(1, 9)} --><script>var t = \"<p>{self.phrase(2, 9)}</p>\";</script>"

    def marked(self, text: str) -> str:
        return MARK + text

    def with_data(self, text: str) -> str:
        """Text with numbers, addresses, prices, code or one word over and over."""
        r = self.random
        words = text.split(" ")
        for _ in range(r.randint(1, 5)):
            number = str(r.randrange(10 ** r.randint(1, 17)))
            data = [number, number, f"+{number}", f"{r.choice(self.words)}@{r.choice(self.words)}.example", f"https://{r.choice(self.words)}.example/{number}",
                    f"${number}", f"{r.choice(self.words)}_{number}();", f"{number[:4]}-{number[4:8]}", f"## {number} ##", "&amp;", "&lt;b&gt;", "&quot;x&quot;", "*" * r.randint(1, 9)]
            words.insert(r.randrange(len(words) + 1), r.choice(data))
        if r.random() < 0.1:
            words += [r.choice(self.words)] * r.randint(5, 60)
        return " ".join(words)

    def paragraph(self) -> str:
        r = self.random
        text = self.sentences(1, 7) if r.random() < 0.85 else self.phrase(1, 5) + "."
        if r.random() < 0.15:
            text = " | ".join(self.phrase(1, 2) for _ in range(r.randint(3, 20)))
        if r.random() < 0.1:
            text = text.upper() if r.random() < 0.5 else text.replace(".", "!!").replace(" ", "!! ")
        if r.random() < 0.15:
            text = self.with_data(text)
        if r.random() < 0.3:
            words = text.split(" ")
            at = r.randrange(len(words))
            words[at] = r.choice(['<a href="/y">{}</a>', "<b>{}</b>", "<em>{}</em>", "<code>{}</code>"]).format(words[at])
            text = " ".join(words)
        if r.random() < 0.15:
            text = "<b>" + text
        return self.marked(text)

    def article(self) -> str:
        """Main text: headings, paragraphs, lists, quotations and tables, with what interrupts it."""
        r = self.random
        out = []
        if r.random() < 0.85:
            title = self.sentences(1, 2) if r.random() < 0.4 else self.phrase(2, 12)
            out.append(f"<h1>{self.marked(title)}</h1>")
        for _ in range(r.randint(1, r.choice([2, 14, 14]))):
            kind = r.random()
            if kind < 0.68:
                out.append(f"<p>{self.paragraph()}" + r.choice(["</p>", "</p>", "</p>", "", "<br>"]))
            elif kind < 0.74:
                out.append(f"<h{r.randint(2, 4)}>{self.marked(self.phrase(1, 8))}</h2>")
            elif kind < 0.80:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.marked(self.phrase(1, 12))}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.83:
                out.append(f"<blockquote><p>{self.paragraph()}</p></blockquote>")
            elif kind < 0.85:
                out.append(f"<pre>{self.marked(self.phrase(3, 20))}</pre>")
            elif kind < 0.88:
                rows = "".join("<tr>" + "".join(f"<td>{self.marked(self.phrase(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.90:
                out.append(f"<figure><img src=/i><figcaption>{self.marked(self.phrase(3, 14))}</figcaption></figure>")
            else:
                out.append(self.aside())
        body = "\n".join(out)
        kind = r.random()
        if kind < 0.45:
            return f"<article>{body}</article>" if r.random() < 0.6 else self.box(ARTICLE, body, ("article", "main"))
        if kind < 0.55:
            return f"<main>{body}</main>"
        if kind < 0.9:
            return self.box(ARTICLE, body)
        if kind < 0.95:
            return f"<table><tr><td>{self.links(3, 6)}</td><td>{body}</td></tr></table>"
        return body

    def comments(self) -> str:
        r = self.random
        out = [f"<h3>{self.phrase(1, 3)}</h3>"]
        for _ in range(r.randint(1, 6)):
            said = f"<b>{self.phrase(1, 2)}</b> " * (r.random() < 0.5) + self.sentences(1, 4)
            out.append(r.choice(["<li><p>{}</p></li>", "<p>{}</p>", '<div class="comment"><p>{}</p></div>', "<article><p>{}</p></article>"]).format(said))
        if r.random() < 0.4:
            out.append(f"<form><textarea>{self.phrase(1, 4)}</textarea><button>{self.phrase(1, 2)}</button></form>")
        return self.box(COMMENTS, "".join(out), ("div", "section", "ol", "aside"))

    def page(self) -> str:
        r = self.random
        top = [f"<title>{self.phrase(2, 9)}</title><style>p{{margin:0}}</style>"]
        head = [self.links(3, 8) if r.random() < 0.7 else self.phrase(1, 4), f"<p>{self.phrase(1, 6)}</p>" * (r.random() < 0.3)]
        before = [f"<header>{''.join(head)}</header>" if r.random() < 0.4 else self.box(HEAD, "".join(head))] * (r.random() < 0.6)
        before += [f"<nav>{self.links(2, 9)}</nav>" if r.random() < 0.6 else self.box(MENU, self.links(2, 9))] * (r.random() < 0.8)
        before += [self.aside() for _ in range(r.randint(0, 3))]
        after = [self.comments()] * (r.random() < 0.4) + [self.aside() for _ in range(r.randint(0, 3))]
        legal = r.choice(["&copy; ", "© 2024 ", "Copyright "]) + f"{r.choice(self.words)}.example.org &middot; " + r.choice([self.sentences(1, 3), self.links(2, 6), r.choice(LEGAL)])
        after += [f"<footer>{legal}</footer>" if r.random() < 0.6 else self.box(FOOT, f"<p>{legal}</p>" if r.random() < 0.5 else legal)] * (r.random() < 0.9)
        if r.random() < 0.12:
            # A page, or a piece of one, with little or nothing beside the main text.
            before, after = before[:1] * (r.random() < 0.3), after[-1:] * (r.random() < 0.3)
        inside = r.random() < 0.15
        article = self.article()
        if inside and "</article>" in article:
            # Comments and the like within the article's own element.
            article = article.replace("</article>", self.comments() + "</article>", 1) if r.random() < 0.5 else article
        body = "".join(before) + article + "".join(after)
        if r.random() < 0.06:
            return body
        if r.random() < 0.3:
            body = f'<div id="wrapper"><div class="container">{body}</div></div>'
        return f"<!DOCTYPE html><html lang=\"en\"><head><meta charset=\"utf-8\">{''.join(top)}</head><body>{body}</body></html>"


def labelled_page(seed: int) -> tuple[str, list[Block], list[int]]:
    """A page, its blocks, and which of them are main text."""
    page = Site(seed).page()
    found = blocks(page)
    labels = [int(MARK in b.text) for b in found]
    for b in found:
        marks = b.text.count(MARK)
        b.text = b.text.replace(MARK, "").strip(" ")
        b.linked = min(b.linked, len(b.text)) if marks else b.linked
    both = [(b, y) for b, y in zip(found, labels, strict=True) if b.text]
    return page.replace(MARK, ""), [b for b, _ in both], [y for _, y in both]
