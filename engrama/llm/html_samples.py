"""Generated web pages with labelled text blocks, to train the extraction model on.

Words are invented, so that a model can only learn from structure. Layouts vary in tags, hints, nesting, order, and in
how much boilerplate of which kind there is; some pages have no hints at all.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

GOOD = ["content", "post-content", "entry", "article-body", "story", "main-content", "text", "post"]
BAD = {
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "pagination"],
    "head": ["header", "masthead", "site-header", "topbar", "logo"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom"],
    "side": ["sidebar", "aside", "widget", "related", "recommended", "popular", "tags"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner"],
    "note": ["cookie-notice", "consent", "notice", "popup", "alert", "gdpr", "paywall"],
    "talk": ["comments", "comment-list", "replies", "discussion", "respond"],
    "form": ["newsletter", "login", "search-form", "subscribe", "share", "social"],
}


class Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.wanted = rng, set()
        self.bits = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def words(self, low: int, high: int, stops: bool = True) -> str:
        r, out, left = self.rng, [], 0
        for _ in range(r.randint(low, high)):
            w = r.choice(self.bits)
            if not left:
                w, left = w.capitalize(), r.randint(3, 16)
            left -= 1
            if stops and not left:
                w += r.choice("....!?")
            elif stops and r.random() < 0.08:
                w += ","
            out.append(w)
        return " ".join(out) + ("." if stops and r.random() < 0.8 else "")

    def block(self, tag: str, text: str, good: bool, attrs: str = "") -> str:
        r = self.rng
        if good:
            self.wanted.add(" ".join(text.split()))
        text = html.escape(text, quote=False)
        if r.random() < 0.2:
            text = text.replace(" ", "  \n", 1)
        if r.random() < 0.25 and text.count(" ") > 4:
            a, b, rest = text.split(" ", 2)
            text = f"{a} <{(t := r.choice(['b', 'em', 'a href=x', 'span']))}>{b}</{t.split()[0]}> {rest}"
        open_end = tag in ("p", "li") and r.random() < 0.15
        return f"<{tag}{attrs}>{text}" + ("" if open_end else f"</{tag}>") + r.choice(["", "\n", "<br>"])

    def hint(self, names: list[str], chance: float) -> str:
        r = self.rng
        return "" if r.random() > chance else f' {r.choice(["class", "class", "id"])}="{r.choice(names)}{r.choice(["", " box", " col-2"])}"'

    def links(self, n: int, tag: str = "ul") -> str:
        items = [f'<a href="/{k}">{self.words(1, 4, False)}</a>' for k in range(n)]
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice([" | ", " ", " &middot; "]).join(items)

    def bad(self, kind: str, chance: float) -> str:
        r = self.rng
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}.get(kind, "div")
        if r.random() < 0.35:
            tag = r.choice(["div", "section"])
        elif kind in ("ad", "note") and r.random() < 0.3:
            tag = "aside"
        own = self.hint(BAD[kind], max(chance, 0.97 if tag in ("div", "section") else 0.5))
        if kind == "nav":
            body = self.links(r.randint(3, 9), r.choice(["ul", "ul", "a"]))
        elif kind == "head":
            body = self.block(r.choice(["p", "div", "h1"]), self.words(1, 5, False), False) + (self.links(r.randint(2, 6)) if r.random() < 0.6 else "")
        elif kind == "foot":
            body = "&copy; " + self.words(2, 14) + (self.links(r.randint(2, 5), "a") if r.random() < 0.5 else "")
            body = body if r.random() < 0.5 else f"<p>{body}</p>"
        elif kind == "side":
            body = self.block("h3", self.words(1, 4, False), False) + (self.links(r.randint(3, 8)) if r.random() < 0.7 else self.block("p", self.words(5, 40), False))
        elif kind in ("ad", "note"):
            body = self.words(4, 30) if r.random() < 0.6 else self.block("p", self.words(4, 40), False)
        elif kind == "talk":
            body = self.block("h3", self.words(1, 3, False), False) + "".join(f'<{(t := r.choice(["div", "li", "article"]))}{self.hint(["comment", "reply"], 0.8)}>' + self.block("p", self.words(1, 3, False), False) + self.block("p", self.words(5, 60), False) + f"</{t}>" for _ in range(r.randint(1, 6)))
        else:
            body = self.block("label", self.words(1, 5, False), False) + '<input type="text" value="x">' + f"<button>{self.words(1, 2, False)}</button>" + (self.block("p", self.words(4, 25), False) if r.random() < 0.5 else "")
        return f"<{tag}{own}>{body}</{tag}>"

    def article(self, chance: float) -> str:
        r, parts = self.rng, []
        if r.random() < 0.08:  # next to nothing but a title
            tag = r.choice(["article", "article", "main"])
            return f"<{tag}{self.hint(GOOD, chance * 0.5)}>" + self.block("h1", self.words(1, 4), True) + self.block("p", self.words(1, 5), True) + f"</{tag}>"
        if r.random() < 0.85:
            title = self.block(r.choice(["h1", "h1", "h2"]), self.words(3, 14, r.random() < 0.5), True)
            parts.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.74:
                parts.append(self.block("p", self.words(1, 120) if r.random() < 0.8 else self.words(1, 5), True))
            elif x < 0.82:
                parts.append(self.block(r.choice(["h2", "h3"]), self.words(1, 8, False), True))
            elif x < 0.88:
                parts.append("<ul>" + "".join(self.block("li", self.words(2, 25, r.random() < 0.5), True) for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.92:
                parts.append("<blockquote>" + self.block("p", self.words(5, 50), True) + "</blockquote>")
            elif x < 0.95:
                parts.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.words(1, 5, False), True) for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            elif x < 0.97:
                parts.append(self.block("pre", self.words(5, 30), True))
            else:
                parts.append(self.bad(r.choice(["ad", "side", "form", "note"]), 1.0))
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.hint(GOOD, 0.5)}>{body}</div>"
        tag = r.choice(["article", "article", "main", "div", "section"])
        return f"<{tag}{self.hint(GOOD, 0.95 if tag in ('div', 'section') else chance * 0.5)}>{body}</{tag}>"


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """(page, the texts of its content blocks), n of them."""
    for k in range(n):
        rng = random.Random(f"{seed}:{k}")
        w, chance = Writer(rng), rng.choice([0.2, 0.6, 0.95])
        before = [w.bad(kind, chance) for kind in ("note", "head", "nav", "ad", "form", "nav") if rng.random() < 0.45]
        after = [w.bad(kind, chance) for kind in ("side", "talk", "ad", "form", "side", "foot", "note") if rng.random() < 0.45]
        if rng.random() < 0.15:
            before.append(after.pop(0)) if after else None
        core = w.article(chance)
        if rng.random() < 0.3:
            core = f"<main>{core}{after.pop(0) if after and rng.random() < 0.5 else ''}</main>"
        if rng.random() < 0.2:  # a layout by table: links in one row, the article in another, and nothing marked as such
            bar = w.links(rng.randint(2, 8), "a")
            row = f"<tr><td>{core}</td></tr>"
            core = f"<table width=100%><tr><td>{bar}</td></tr>{row}</table>" if rng.random() < 0.7 else f"<table>{row}<tr><td>{bar}</td></tr></table>"
        if rng.random() < 0.1:
            after.append(f"<form action=/search><input name=q><button>{w.words(1, 4, False)}</button></form>")
        head = f"<head><title>{w.words(2, 9, False)}</title><style>p{{margin:0}}</style></head>"
        yield f"<!DOCTYPE html><html>{head}<body><script>var a='</p>';</script>{''.join(before)}{core}{''.join(after)}</body></html>", w.wanted
