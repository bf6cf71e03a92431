"""Labelled pages to train the extractor: made from a grammar of page layouts.

Each element carries ``y``: 1 inside the article, 0 outside it or inside a part
of it that isn't the article's (share bars, adverts, forms, comments). Words are
invented; layouts use section elements, class names, or bare containers.
"""

from __future__ import annotations

import random

#: Names that page authors give to parts.
PARTS = {
    "menu": ("nav", ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "pagination", "toc", "links"]),
    "header": ("header", ["header", "masthead", "banner", "top", "logo", "branding", "site"]),
    "footer": ("footer", ["footer", "bottom", "copyright", "colophon", "legal", "foot"]),
    "sidebar": ("aside", ["sidebar", "aside", "related", "widget", "rail", "secondary", "recommended", "trending", "popular", "more", "tags"]),
    "notice": ("div", ["cookie", "consent", "notice", "alert", "gdpr", "popup", "modal", "overlay", "warning", "message", "paywall", "privacy"]),
    "advert": ("div", ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "outbrain"]),
    "form": ("form", ["form", "search", "login", "subscribe", "newsletter", "signup", "contact"]),
    "share": ("div", ["share", "social", "sharing", "follow", "buttons", "toolbar", "rating"]),
    "comments": ("section", ["comments", "comment", "replies", "reply", "disqus", "discussion", "responses", "thread"]),
}
ARTICLE = ["article", "post", "entry", "content", "story", "main", "body", "text", "page", "blog", "news"]
SYLLABLES = "ra me to li su ven dor al ti pe gon mar es qui na lo fer bu ci ka".split()


class Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.out: list[str] = []

    def words(self, n: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.08 else "") for _ in range(n)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def open(self, tag: str, y: int, names: list[str] | None = None) -> None:
        own = f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(["-", " ", "_"]).join(names)}"' if names else ""
        self.out.append(f'<{tag} y="{y}"{own}>')

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def link(self, n: int) -> str:
        return f'<a href="/x">{self.words(n)}</a>'

    def part(self, kind: str) -> None:
        r = self.rng
        tag, names = PARTS[kind]
        plain = tag in ("div",) or r.random() < 0.5
        tag = r.choice(["div", "div", "section", "ul" if kind == "menu" else "div"]) if plain else tag
        own = r.sample(names, r.randint(1, 2)) if plain or r.random() < 0.5 else None
        if own and r.random() < 0.3:
            own.append(r.choice(["wrapper", "container", "inner", "box", "block", "item"]))
        self.open(tag, 0, own)
        if kind == "menu" or kind == "share":
            if tag != "ul":
                self.open("ul", 0)
            for _ in range(r.randint(2, 7)):
                self.open("li", 0)
                self.out.append(self.link(r.randint(1, 3)))
                self.close("li")
            if tag != "ul":
                self.close("ul")
        elif kind in ("sidebar",):
            self.open("h3", 0)
            self.out.append(self.words(2))
            self.close("h3")
            for _ in range(r.randint(1, 4)):
                self.open("p", 0)
                self.out.append(self.link(r.randint(3, 8)) if r.random() < 0.7 else self.words(r.randint(5, 30)))
                self.close("p")
        elif kind == "comments":
            self.open("h3", 0)
            self.out.append(self.words(2))
            self.close("h3")
            for _ in range(r.randint(1, 4)):
                self.open("div", 0, ["comment"] if r.random() < 0.7 else None)
                self.open("p", 0)
                self.out.append(self.words(r.randint(4, 60)))
                self.close("p")
                self.close("div")
        elif kind == "form":
            self.open("p", 0)
            self.out.append(self.words(r.randint(2, 12)) + '<input type="text">')
            self.close("p")
        else:
            if r.random() < 0.5:
                self.out.append(self.words(r.randint(2, 25)) + (self.link(2) if r.random() < 0.4 else ""))
            else:
                for _ in range(r.randint(1, 2)):
                    self.open("p", 0)
                    self.out.append(self.words(r.randint(3, 25)) + (self.link(2) if r.random() < 0.4 else ""))
                    self.close("p")
        self.close(tag)

    def article(self) -> None:
        r = self.rng
        kind = r.random()
        tag = "article" if kind < 0.5 else "main" if kind < 0.6 else r.choice(["div", "section", "td"])
        outer = r.random() < 0.3
        if outer:
            self.open("main" if r.random() < 0.5 else "div", 1, r.choice([None, ["main"], ["content"], ["container"]]))
        self.open(tag, 1, r.sample(ARTICLE, r.randint(1, 2)) if tag not in ("article", "main") or r.random() < 0.4 else None)
        if r.random() < 0.7:
            self.open("h1", 1)
            self.out.append(self.words(r.randint(3, 12)))
            self.close("h1")
        longest = r.choice([4, 15, 120, 120])
        for _ in range(0 if r.random() < 0.06 else r.choice([r.randint(1, 10), r.randint(1, 30)])):
            x = r.random()
            if x < 0.7:
                self.open("p", 1)
                self.out.append(self.words(r.randint(1, longest)) + (f" {self.link(2)} {self.words(9)}" if r.random() < 0.2 else ""))
                if r.random() < 0.9:
                    self.close("p")
            elif x < 0.78:
                self.open(r.choice(["h2", "h3"]), 1)
                self.out.append(self.words(r.randint(1, 7)))
                self.close("h2")
                self.close("h3")
            elif x < 0.84:
                self.open("ul", 1)
                for _ in range(r.randint(2, 5)):
                    self.open("li", 1)
                    self.out.append(self.words(r.randint(3, 25)))
                    self.close("li")
                self.close("ul")
            elif x < 0.88:
                self.open("blockquote", 1)
                self.out.append(self.words(r.randint(5, 40)))
                self.close("blockquote")
            elif x < 0.91:
                self.open("pre", 1)
                self.out.append(self.words(r.randint(5, 40)))
                self.close("pre")
            else:
                self.part(r.choice(["advert", "share", "sidebar", "form", "advert", "notice"]))
        if r.random() < 0.15:
            self.part("comments")
        self.close(tag)
        if outer:
            self.close("main")
            self.close("div")

    def build(self) -> str:
        r = self.rng
        for kind in ("notice", "header", "menu", "advert", "form"):
            if r.random() < 0.5:
                self.part(kind)
        self.article()
        for kind in ("comments", "share", "sidebar", "advert", "form", "notice", "footer"):
            if r.random() < (0.8 if kind == "footer" else 0.35):
                self.part(kind)
        return '<html y="1"><body y="1">' + "".join(self.out) + "</body></html>"


def pages(n: int, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [Page(rng).build() for _ in range(n)]
