"""The labelled table for main text: pages built by rule, each block with its label.

A page is put together from forms that sites use: menus, headers, notices,
articles with bylines, lists, quotes and references, notes and adverts among
paragraphs, comments, teasers, sidebars and footers, with or without names that
tell what they are. The form says whether its text is main text.
"""

from __future__ import annotations

import random

#: Names of forms, as sites give them.
NAMES = {
    "menu": ["class=menu", "id=nav", "class='main-nav'", "role=navigation", "class='nav-links'", "class='breadcrumbs'", "id=topbar", ""],
    "notice": ["id=cookie-banner", "id=cookie-consent", "id=gdpr", "class='notice'", "class='alert'", "role=dialog", "class=popup"],
    "advert": ["class=ad", "class='advert'", "id=ad-box", "class='sponsored'", "class=promo", "class='advertisement'"],
    "comments": ["class=comments", "id=comments", "class='comment-list'", "id=disqus_thread", "id=responses", "class=discussion", "class='comment-body'"],
    "sidebar": ["class=sidebar", "id=sidebar", "class='sidebar-primary'", "class='widget-area'", "class=widget"],
    "footer": ["id=footer", "class='footer-widgets'", "class=site-info", "class='footer'", "class=copyright"],
    "related": ["class=related", "class='related-posts'", "class=teaser", "id=related-links"],
    "share": ["class=share", "class='social-links'", "class=newsletter", "class=subscribe"],
    "text": ["", "", "class=content", "class='post-body'", "id=main", "class='entry'", "class='story-text'"],
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.word, self.kept = 0, set()

    def words(self, n: int) -> list[str]:
        self.word += n
        return [f"w{i}" for i in range(self.word - n, self.word)]

    def text(self, low: int, high: int, links: float = 0.0, keep: bool = False, stop: bool = True) -> str:
        """Inline markup of ``low`` to ``high`` words; all words differ on a page, so a block's text tells its form."""
        words = self.words(self.r.randint(low, high))
        if stop:
            words[-1] += "."
        if keep:
            self.kept.add(" ".join(words))
        n = round(links * len(words))
        at = self.r.randint(0, len(words) - n)
        linked = [f"<a href=x>{' '.join(words[at : at + n])}</a>"] if n else []
        return " ".join([*words[:at], *linked, *words[at + n :]])

    def link(self, low: int = 1, high: int = 5) -> str:
        return f"<a href=x>{' '.join(self.words(self.r.randint(low, high)))}</a>"

    def box(self, kind: str, inner: str, tags: tuple[str, ...] = ("div",)) -> str:
        tag = self.r.choice(tags)
        return f"<{tag} {self.r.choice(NAMES[kind])}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [self.link() for _ in range(self.r.randint(low, high))]
        return self.r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " ".join(items), lambda: "".join(f"<div>{i}</div>" for i in items)])()

    def top(self) -> str:
        r, out = self.r, []
        if r.random() < 0.7:
            out.append(r.choice([lambda: f"<nav>{self.links(2, 8)}</nav>", lambda: f"<nav><h2>{self.link()}</h2>{self.links(2, 6)}</nav>", lambda: self.box("menu", self.links(2, 8), ("div", "ul")), lambda: f"<header><h1>{self.link(1, 3)}</h1>{self.links(2, 5)}</header>", lambda: f"<header><p>{self.text(2, 9, stop=False)}</p></header>"])())
        if r.random() < 0.3:
            out.append(self.box("notice", f"<p>{self.text(6, 40)}</p>" + r.choice(["", f"<div>{self.link()}</div>"])))
        if r.random() < 0.15:
            out.append(f"<form class=search><label>{self.text(1, 3, stop=False)}</label></form>")
        return "".join(out)

    def main(self) -> str:
        r, out = self.r, []
        title = r.choice([lambda: self.text(1, 12, keep=True, stop=False), lambda: self.text(2, 9, links=1, keep=True, stop=False)])() if r.random() < 0.3 else self.text(1, 12, keep=True, stop=False)
        head = f"<h1>{title}</h1>" + (r.choice(["<p class=byline>{}</p>", "<p>{}</p>", "<div class=meta>{}</div>"]).format(self.text(2, 7, links=r.choice([0, 0, 0.4]), keep=True, stop=False)) if r.random() < 0.4 else "")
        article = r.random() < 0.5
        out.append(r.choice([head, head, f"<div class=post-header>{head}</div>", f"<div class='entry-header'>{head}</div>", f"<header>{head}</header>" if article else head]))
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.62:
                out.append(f"<p{r.choice(['', '', '', ' class=lead', ' class=widget', ' class=note'])}>{self.text(*r.choice([(1, 8), (8, 30), (20, 60), (40, 160)]), links=r.choice([0, 0, 0, 0.1, 0.3]), keep=True)}</p>")
            elif x < 0.70:
                out.append(f"<h{r.choice('234')}>{self.text(1, 8, keep=True, stop=False)}</h2><p>{self.text(15, 70, keep=True)}</p>")
            elif x < 0.77:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.text(2, 25, links=r.choice([0, 0, 0.3]), keep=True, stop=r.random() < 0.5)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.82:
                out.append(f"<blockquote>{self.text(5, 50, keep=True)}</blockquote>")
            elif x < 0.86:
                out.append(f"<figure><img src=x><figcaption>{self.text(3, 15, keep=True, stop=r.random() < 0.5)}</figcaption></figure>")
            elif x < 0.90:
                out.append("<table>" + "".join(f"<tr><td>{self.text(1, 4, keep=True, stop=False)}</td><td>{self.text(1, 6, keep=True, stop=False)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif x < 0.95 and article:
                out.append(f"<p>{self.text(20, 50, keep=True)}</p><p>{self.text(5, 25, links=1, keep=True)}</p><p>{self.text(10, 50, keep=True)}</p>")
            else:
                out.append(f"<p>{self.text(30, 90, keep=True)}</p>")
        if r.random() < 0.2 and article:  # references: text with a linked part
            out.append(f"<h2>{self.text(1, 2, keep=True, stop=False)}</h2><ol>" + "".join(f"<li>{self.text(6, 20, links=r.choice([0.3, 0.5]), keep=True)}</li>" for _ in range(r.randint(2, 6))) + "</ol>")
        for _ in range(r.choice([0, 0, 1, 2])):  # what stands in the text and is none of it
            noise = r.choice([lambda: f"<aside>{r.choice(['', f'<h3>{self.link()}</h3>'])}<p>{self.text(5, 60)}</p></aside>", lambda: self.box("advert", f"<p>{self.text(4, 60)}</p>"), lambda: self.box("share", self.links(2, 4)), lambda: f"<form class=newsletter><p>{self.text(5, 25)}</p></form>", lambda: self.box("related", self.links(2, 5)), lambda: f"<ul>{''.join(f'<li>{self.link(2, 8)}</li>' for _ in range(r.randint(3, 5)))}</ul>"])()
            out.insert(r.randint(1, len(out)), noise)
        inner = "".join(out)
        if article:
            return r.choice([f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article class=post>{inner}</article></main>", f"<div role=main>{inner}</div>"])
        return self.box("text", inner, ("div", "section"))

    def bottom(self) -> str:
        r, out = self.r, []
        if r.random() < 0.35:
            out.append(r.choice([
                lambda: self.box("comments", "".join(f"<div><p>{self.text(3, 60)}</p></div>" for _ in range(r.randint(1, 5))), ("div", "section")),
                lambda: self.box("comments", f"<h3>{self.text(1, 3, stop=False)}</h3>" + "".join(f"<p>{self.text(3, 40)}</p>" for _ in range(r.randint(1, 4))), ("div", "section")),
                lambda: "".join(f"<article class='comment-body'><p>{self.text(3, 60)}</p></article>" for _ in range(r.randint(1, 4))),
            ])())
        if r.random() < 0.35:
            teasers = lambda: "".join(f"<h3>{self.link(2, 8)}</h3>" + r.choice(["", f"<p>{self.text(6, 25)}</p>"]) for _ in range(r.randint(1, 4)))
            out.append(r.choice([lambda: f"<aside>{teasers()}</aside>", lambda: self.box("related", teasers(), ("div", "section")), lambda: self.box("sidebar", teasers() + f"<p>{self.text(5, 50)}</p>"), lambda: self.box("sidebar", self.links(2, 6)), lambda: f"<div>{self.links(3, 8)}</div>"])())
        if r.random() < 0.75:
            out.append(r.choice([lambda: f"<footer><p>{self.text(3, 40)}</p>{self.links(1, 6)}</footer>", lambda: f"<footer><h4>{self.link()}</h4>{self.links(1, 4)}</footer>", lambda: self.box("footer", f"<p>{self.text(3, 30)}</p>"), lambda: self.box("footer", self.links(2, 9)), lambda: f"<div>{self.links(3, 12)}</div>"])())
        return "".join(out)


def page(seed: int) -> tuple[str, set[str]]:
    """Source of the page of this seed, and the texts of its blocks that are main text."""
    p = _Page(seed)
    parts = [p.top(), p.main(), p.bottom()]
    return f"<html><head><title>{p.text(1, 5)}</title></head><body>{''.join(parts)}</body></html>", p.kept
