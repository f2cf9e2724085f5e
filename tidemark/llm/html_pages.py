"""Labelled pages to train the extractor on: layouts made from a seed, every leaf block marked as article or not.

The layouts vary what surrounds and interrupts an article on the web: menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, marked by tags or by class and id names only, inside or outside the article.
"""

from __future__ import annotations

import random

#: Names by which pages mark their parts. Fixed lists of common usage.
MENU = ["nav", "menu", "navbar", "main-menu", "breadcrumbs", "toc", "topnav", "pagination"]
HEADER = ["header", "masthead", "site-header", "top-bar", "banner", "branding"]
FOOTER = ["footer", "site-footer", "copyright", "colophon", "legal", "bottom"]
SIDEBAR = ["sidebar", "side", "widget", "related", "recommended", "popular", "tags", "author-box", "aside", "teaser"]
NOTICE = ["notice", "cookie", "cookie-banner", "consent", "alert", "gdpr", "popup", "modal", "subscribe-notice", "warning"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "sponsor"]
FORM = ["newsletter", "signup", "subscribe", "search", "login", "contact-form"]
COMMENTS = ["comments", "comment", "reader-comments", "replies", "discussion", "disqus", "comment-list", "responses"]
SHARE = ["share", "social", "share-buttons", "follow"]
ARTICLE = ["content", "article", "post", "entry", "story", "main-content", "post-body", "article-body", "entry-content", "text", "page-content"]

_SYLLABLES = "ka lo mi ren ta su vor el an ist que tion mar pe di lu sha bre on er".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 18) + self.r.choice(".....?!") for _ in range(self.r.randint(low, high)))

    def block(self, tag: str, text: str, label: int, attrs: str = "", inner: str = "{}") -> None:
        close = "" if tag in ("p", "li") and self.r.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attrs}>{inner.format(text)}{close}")
        self.labels.append((text, label))

    def named(self, names: list[str]) -> str:
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.word()}"', f' class="{self.word()} {name}"'])

    def links(self, wrap: str, attrs: str, n: int) -> None:
        bare = wrap == "div" and attrs and self.r.random() < 0.3
        self.out.append(f"<ul{attrs}>" if bare else f"<{wrap}{attrs}><ul>")
        for _ in range(n):
            self.block("li", self.words(1, 3), 0, inner='<a href="/x">{}</a>')
        self.out.append("</ul>" if bare else f"</ul></{wrap}>")

    def aside(self, tag: str, names: list[str]) -> None:
        """Text that is no article, from a word to several sentences, so that length alone tells little."""
        own = self.r.random() < 0.5
        self.out.append(f"<{tag if own else 'div'}{'' if own and tag != 'div' else self.named(names)}>")
        for i in range(self.r.randint(1, 3)):
            text = self.words(1, 8) if self.r.random() < 0.5 else self.sentences(1, 4)
            if i == 0 and self.r.random() < 0.3:
                self.out.append(text)
                self.labels.append((text, 0))
                break
            self.block(self.r.choice(["p", "div", "h3"]), text, 0)
        self.out.append(f"</{tag if own else 'div'}>")

    def form(self) -> None:
        self.out.append(f"<form{self.named(FORM) if self.r.random() < 0.5 else ''}>")
        self.block("label" if self.r.random() < 0.5 else "p", self.words(1, 8), 0)
        self.out.append("<input type=text><br></form>")

    def comments(self) -> None:
        tag = self.r.choice(["section", "div", "div", "ol"])
        self.out.append(f"<{tag}{self.named(COMMENTS)}>")
        self.block("h3", self.words(1, 4), 0)
        for _ in range(self.r.randint(1, 4)):
            if tag == "ol":
                self.block("li", self.sentences(1, 4), 0)
            else:
                each = self.r.choice(["div", "div", "article"])
                self.out.append(f"<{each}{self.named(COMMENTS) if self.r.random() < 0.5 else ''}>")
                self.block("p", self.sentences(1, 5), 0)
                self.out.append(f"</{each}>")
        self.out.append(f"</{tag}>")

    def interruption(self) -> None:
        kind = self.r.randrange(6)
        if kind == 0:
            self.aside("div", ADVERT)
        elif kind == 1:
            self.aside("aside", SIDEBAR)
        elif kind == 2:
            self.aside("div", NOTICE)
        elif kind == 3:
            self.form()
        elif kind == 4:
            self.aside("div", SHARE)
        else:
            self.links("nav" if self.r.random() < 0.5 else "div", self.named(MENU + SIDEBAR), self.r.randint(2, 5))

    def article(self) -> None:
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        plain = tag in ("article", "main") and self.r.random() < 0.7
        self.out.append(f"<{tag}{'' if plain else self.named(ARTICLE)}>")
        nested = self.r.random() < 0.3
        if nested:
            self.out.append(f"<div{self.named(ARTICLE) if self.r.random() < 0.6 else ''}>")
        if self.r.random() < 0.85:
            self.block(self.r.choice(["h1", "h1", "h2"]), self.words(1, 10), 1)
        for _ in range(self.r.randint(1, 8)):
            x = self.r.random()
            if x < 0.62:
                self.block("p", self.sentences(1, 6) if self.r.random() < 0.8 else self.words(1, 4), 1, inner=self.r.choice(["{}", "{}", "<b>{}</b>", "<b>{}<br>", "<em>{}</em>", '<a href="/y">{}</a>' if self.r.random() < 0.3 else "{}"]))
            elif x < 0.68:
                self.block("h2", self.words(1, 6), 1)
            elif x < 0.74:
                self.block("blockquote", self.sentences(1, 3), 1)
            elif x < 0.78:
                self.block("pre", self.words(2, 8), 1)
            elif x < 0.84:
                self.out.append("<ul>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("li", self.words(2, 10), 1)
                self.out.append("</ul>")
            elif x < 0.88:
                self.out.append("<table><tr>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("td", self.words(1, 3), 1)
                self.out.append("</tr></table>")
            else:
                self.interruption()
        if nested:
            self.out.append("</div>")
        if self.r.random() < 0.2:
            self.comments()
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        self.out.append("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        if self.r.random() < 0.6:
            self.aside("header", HEADER)
        elif self.r.random() < 0.5:
            self.out.append("<header>")
            self.block("h1", self.words(1, 4), 0)
            self.links("nav", "", self.r.randint(1, 6))
            self.out.append("</header>")
        if self.r.random() < 0.8:
            self.links("nav" if self.r.random() < 0.6 else "div", self.named(MENU) if self.r.random() < 0.6 else "", self.r.randint(1, 8)) if self.r.random() < 0.9 else self.aside("nav", MENU)
        for _ in range(self.r.randint(0, 2)):
            self.interruption()
        self.article()
        if self.r.random() < 0.3:
            self.comments()
        for _ in range(self.r.randint(0, 2)):
            self.interruption()
        if self.r.random() < 0.85:
            self.aside("footer", FOOTER)
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


#: Names in other languages, by the same parts; fixed lists of common usage.
OTHER_NAMES = {
    "MENU": "navigation hauptmenue navi menue navegacion navigazione liens".split(),
    "HEADER": "kopf kopfzeile entete cabecera encabezado testata".split(),
    "FOOTER": "fuss fusszeile pied pie piedipagina impressum".split(),
    "SIDEBAR": "seitenleiste randspalte colonne barra lateral marginalie".split(),
    "NOTICE": "hinweis meldung avis aviso avviso".split(),
    "ADVERT": "anzeige werbung publicite pub anuncio pubblicita".split(),
    "FORM": "suche formular recherche formulaire buscar anmelden".split(),
    "COMMENTS": "kommentare leserbriefe commentaires comentarios commenti".split(),
    "SHARE": "teilen partager compartir".split(),
    "ARTICLE": "inhalt artikel hauptteil beitrag contenu texte contenido cuerpo testo".split(),
}


class _Bare(_Maker):
    """Pages whose containers are plain elements, without names, with names that mean nothing, or with foreign ones. What is
    no article is short, linked, or apart from the bulk of the prose; the article has the bulk."""

    def __init__(self, seed: int, foreign: bool = True):
        super().__init__(seed)
        self.style = self.r.choice(["none", "none", "random", "random", "foreign" if foreign else "none", "known"])
        self.box = self.r.choice(["div", "div", "div", "section", "table", "center"])
        self.semantic = self.r.random() < 0.2

    def name(self, kind: str) -> str:
        if self.style == "none" or self.r.random() < 0.25:
            return ""
        names = {"random": [self.word()], "foreign": OTHER_NAMES[kind], "known": globals()[kind]}[self.style]
        word = self.r.choice(names)
        extra = self.r.choice(["", "", "-" + self.word(), "_" + str(self.r.randint(1, 9)), self.word().capitalize()])
        return f' {self.r.choice(["class", "id"])}="{word}{extra}"'

    def open(self, kind: str, tag: str = "") -> str:
        """Open a container; what closes it."""
        box = tag if tag and self.semantic else self.box
        if box == "table":
            self.out.append(f"<table{self.name(kind)}><tr><td>")
            return "</td></tr></table>"
        self.out.append(f"<{box}{self.name(kind)}>")
        return f"</{box}>"

    def menu(self, kind: str = "MENU", tag: str = "nav") -> None:
        end = self.open(kind, tag)
        if kind == "SIDEBAR" and self.r.random() < 0.6:
            self.block(self.r.choice(["h2", "h3", "h4", "div"]), self.words(1, 4), 0)
        wrap = self.r.choice(["li", "li", "div", "span", "p"])
        if wrap == "span":
            texts = [self.words(1, 3) for _ in range(self.r.randint(2, 9))]
            sep = self.r.choice([" | ", " ", " · "])
            self.out.append(sep.join(f'<a href="/x">{t}</a>' for t in texts))
            self.labels.append((sep.join(texts), 0))
        else:
            self.out.append("<ul>" if wrap == "li" else "")
            for _ in range(self.r.randint(2, 9)):
                self.block(wrap, self.words(1, 8 if kind == "SIDEBAR" else 3), 0, inner='<a href="/x">{}</a>')
            self.out.append("</ul>" if wrap == "li" else "")
        self.out.append(end)

    def short(self, kind: str, tag: str = "") -> None:
        """A notice, advert or share line: a sentence or a few words, mostly with a link or button."""
        end = self.open(kind, tag)
        for _ in range(self.r.randint(1, 2)):
            text = self.words(1, 6) if self.r.random() < 0.5 else self.sentences(1, 1)
            self.block(self.r.choice(["p", "div", "div"]), text, 0, inner=self.r.choice(["{}", '<a href="/z">{}</a>', "<b>{}</b>"]))
        if self.r.random() < 0.4:
            self.out.append(f"<button>{self.word()}</button>")
        self.out.append(end)

    def head(self) -> None:
        end = self.open("HEADER", "header")
        self.block(self.r.choice(["h1", "div", "p", "h2"]), self.words(1, 3), 0, inner=self.r.choice(["{}", '<a href="/">{}</a>']))
        if self.r.random() < 0.5:
            self.block(self.r.choice(["p", "div"]), self.words(2, 7), 0)
        self.out.append(end)

    def foot(self) -> None:
        end = self.open("FOOTER", "footer")
        for _ in range(self.r.randint(1, 3)):
            text = self.r.choice(["© 20%02d " % self.r.randint(0, 26), "© ", "", ""]) + self.words(2, 9)
            self.block(self.r.choice(["p", "div"]), text, 0, inner=self.r.choice(["{}", '<a href="/y">{}</a>']))
        self.out.append(end)

    def talk(self) -> None:
        """Reader comments: a heading, then name, date and a few words each."""
        end = self.open("COMMENTS", "section")
        self.block(self.r.choice(["h2", "h3", "h4"]), f"{self.r.randint(1, 30)} {self.words(1, 1)}", 0)
        for _ in range(self.r.randint(2, 5)):
            self.out.append(f"<div{self.name('COMMENTS')}>")
            self.block(self.r.choice(["div", "p"]), self.words(1, 2) + self.r.choice(["", f", {self.r.randint(1, 28)}.{self.r.randint(1, 12)}.20{self.r.randint(10, 26)}", " 12:%02d" % self.r.randint(0, 59)]), 0)
            self.block("p", self.sentences(1, 2), 0)
            self.out.append("</div>")
        self.out.append(end)

    def article(self) -> None:
        end = self.open("ARTICLE", self.r.choice(["article", "main"]))
        inner = self.open("ARTICLE") if self.r.random() < 0.4 else ""
        if self.r.random() < 0.85:
            self.block(self.r.choice(["h1", "h1", "h2", "div"]), self.words(2, 10), 1)
        if self.r.random() < 0.3:
            self.block(self.r.choice(["p", "div"]), self.words(2, 6), 1)  # a line on author and date
        para = self.r.choice(["p", "p", "p", "div"])
        for _ in range(self.r.randint(2, 10)):
            x = self.r.random()
            if x < 0.72:
                self.block(para, " ".join([self.words(6, 18) + ".", self.sentences(1, 5)]), 1, inner=self.r.choice(["{}", "{}", "{}", "<b>{}</b>", "<span>{}</span>"]))
            elif x < 0.8:
                self.block(self.r.choice(["h2", "h3"]), self.words(1, 6), 1)
            elif x < 0.84:
                self.block("blockquote", self.sentences(1, 3), 1)
            elif x < 0.9:
                tag = self.r.choice(["ul", "ol"])
                self.out.append(f"<{tag}>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("li", self.words(3, 12), 1)
                self.out.append(f"</{tag}>")
            elif x < 0.94:
                self.out.append(f"<table{self.name('ARTICLE')}>")
                for _ in range(self.r.randint(2, 4)):
                    self.out.append("<tr>")
                    self.block("th", self.words(1, 2), 1)
                    self.block("td", self.words(1, 4), 1)
                    self.out.append("</tr>")
                self.out.append("</table>")
            elif x < 0.96:
                self.block("figcaption" if self.semantic else "div", self.words(3, 10), 1)
            else:
                self.short("ADVERT", "aside")
        self.out.append(inner and ("</td></tr></table>" if self.box == "table" else inner))
        self.out.append(end)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        self.out.append("<html><head><title>x</title></head><body>")
        outer = self.open("ARTICLE") if self.r.random() < 0.5 else ""
        if self.r.random() < 0.85:
            self.head()
        if self.r.random() < 0.8:
            self.menu()
        if self.r.random() < 0.3:
            self.short("NOTICE")
        if self.r.random() < 0.25:
            self.menu("SIDEBAR", "aside")
        self.article()
        for kind, chance in (("SHARE", 0.25), ("ADVERT", 0.25)):
            if self.r.random() < chance:
                self.short(kind, "aside")
        if self.r.random() < 0.35:
            self.talk()
        if self.r.random() < 0.4:
            self.menu("SIDEBAR", "aside")
        if self.r.random() < 0.2:
            end = self.open("FORM", "form")
            self.out.append("<form>")
            self.block("label", self.words(1, 6), 0)
            self.out.append("<input></form>")
            self.out.append(end)
        if self.r.random() < 0.85:
            self.foot()
        self.out.append(outer)
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def bare_pages(n: int, seed: int = 11, foreign: bool = True) -> list[tuple[str, list[tuple[str, int]]]]:
    return [_Bare(seed * 1_000_003 + i, foreign).page() for i in range(n)]


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block's text, 1 if it belongs to the article)]) of n pages."""
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
