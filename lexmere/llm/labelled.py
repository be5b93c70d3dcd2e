"""Labelled pages for training the block classifier: layouts with their article marked.

Words are made of syllables, since the features look at shapes and places, not at
vocabulary. Layouts vary in semantic tags or plain divisions, telling, generic or missing
class names, which parts a page has and in which order, forms and divisions around everything,
articles in sections, with a header, with other parts inside, or of lines without paragraphs,
and unclosed markup.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "an be ca de er fi go ha in ja ke lo mi na or pe qui ra sti tu un vi wo ze äu é ción ñe sch".split()
MARK = "\x02"  # stands before article text while a page is built; removed from the page


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng
        self.semantic = rng.random() < 0.6
        self.telling = rng.random() < 0.85
        self.open_tags = rng.random() < 0.15
        self.bare = rng.random() < 0.08  # nothing but the article, maybe without an element for it
        self.plain = rng.random() < 0.1  # divisions stand for paragraphs

    # ---- text ----

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        text = self.words(low, high).capitalize()
        if self.r.random() < 0.5:
            text = text.replace(" ", ", ", 1)
        return text + self.r.choice("....?!")

    def text(self, low: int, high: int) -> str:
        said = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.1:
            said = " ".join(w + self.r.choice(("###", "***", "&&&", "%%%", " |", " |")) for w in said.split())
        return html.escape(said, quote=False)

    # ---- markup ----

    def named(self, tag: str, names: str) -> str:
        if not self.telling or self.r.random() < 0.15:
            return self.r.choice((f"<{tag}>", f'<{tag} class="c{self.r.randint(1, 99)}">', f'<{tag} class="row wrap">'))
        name = self.r.choice(names.split())
        name = self.r.choice((name, f"site-{name}", f"{name}-box", f"{name}_{self.r.randint(1, 9)}", f"js {name}"))
        return self.r.choice((f'<{tag} class="{name}">', f'<{tag} id="{name}">', f'<{tag} class="x {name}">'))

    def box(self, tag: str, names: str, inner: str) -> str:
        if self.semantic and tag != "div":
            head = f"<{tag}>" if self.r.random() < 0.5 else self.named(tag, names)
            return f"{head}{inner}</{tag}>"
        if tag in ("form",):
            return f"{self.named(tag, names)}{inner}</{tag}>"
        return f"{self.named('div', names)}{inner}</div>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(items)

    # ---- parts that are not the article ----

    def menu(self) -> str:
        return self.box("nav", "nav menu navbar navigation topbar breadcrumb pagination", self.links(2, 9))

    def header(self) -> str:
        inner = f"<h1>{self.words(1, 4)}</h1>" if self.r.random() < 0.3 else f"<div>{self.words(1, 5)}</div>"
        if self.r.random() < 0.4:
            inner += f"<p>{self.sentence(2, 8)}</p>"
        return self.box("header", "header masthead logo branding", inner + (self.menu() if self.r.random() < 0.3 else ""))

    def footer(self) -> str:
        inner = f"&copy; {self.word()}.example &middot; {self.sentence(2, 12)}"
        if self.r.random() < 0.4:
            inner = f"<p>{inner}</p>" + self.links(2, 6)
        return self.box("footer", "footer copyright bottom legal", inner)

    def advert(self) -> str:
        inner = self.r.choice((self.text(1, 3), f"<p>{self.text(1, 3)}</p>", f'<a href="/x">{self.sentence(3, 12)}</a>'))
        return self.box("div", "ad ads advert advertisement sponsored promo banner", inner)

    def notice(self) -> str:
        inner = f"<p>{self.text(1, 3)}</p><button>{self.words(1, 2)}</button>" if self.r.random() < 0.6 else self.text(1, 2)
        return self.box("div", "cookie-notice cookies consent notice alert modal popup privacy", inner)

    def form(self) -> str:
        inner = f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.words(1, 2)}</button>"
        if self.r.random() < 0.4:
            inner = f"<p>{self.text(1, 2)}</p>" + inner
        return self.box("form", "search newsletter subscribe login signup contact form", inner)

    def sidebar(self) -> str:
        parts = [f"<h3>{self.words(1, 4)}</h3>", self.links(2, 8), f"<p>{self.text(1, 3)}</p>"]
        self.r.shuffle(parts)
        return self.box("aside", "sidebar widget side related popular trending archive", "".join(parts[: self.r.randint(1, 3)]))

    def comments(self) -> str:
        heading = f"<h{(k := self.r.randint(2, 4))}>{self.words(1, 3)}</h{k}>" if self.r.random() < 0.6 else ""
        items = []
        for _ in range(self.r.randint(1, 6)):
            by = f"<b>{self.word()}</b> " if self.r.random() < 0.5 else f"<cite>{self.word()}</cite><br>"
            items.append(self.r.choice(("<li>{}</li>", "<p>{}</p>", '<div class="comment">{}</div>')).format(by + self.text(1, 4)))
        inner = heading + "".join(items)
        if self.r.random() < 0.3:
            inner += self.form()
        return self.box("section", "comments comment-list discussion replies respond disqus reader-comments", inner)

    def share(self) -> str:
        return self.box("div", "share social sharing follow", self.links(2, 5))

    # ---- the article ----

    def paragraph(self) -> str:
        text = MARK + self.text(1, self.r.choice((1, 2, 5, 12)))
        if self.r.random() < 0.2:
            cut = text.rfind(" ")
            text = f'{text[:cut]} <a href="/{self.word()}">{text[cut + 1 :]}</a>' if cut > 0 else text
        if self.r.random() < 0.2:
            text = f"<b>{text}</b>" if self.r.random() < 0.6 else f"<b>{text}<br>"
        if self.plain:
            return f"<div>{text}</div>"
        return f"<p>{text}" if self.open_tags and self.r.random() < 0.5 else f"<p>{text}</p>"

    def lines(self) -> str:
        """An article, or a part of one, whose lines are only broken."""
        return MARK + self.r.choice(("<br>", "<br><br>", "<br/>\n<br/>")).join(
            self.text(1, 4) if self.r.random() < 0.8 else self.words(1, 5) for _ in range(self.r.randint(1, 6))
        )

    def head(self) -> str:
        title = f"<h1>{MARK}{self.words(2, 12).capitalize()}</h1>"
        if self.r.random() < 0.25:
            by = f"<p>{MARK}{self.sentence(2, 8)}</p>" if self.r.random() < 0.6 else ""
            start = "<header>" if self.r.random() < 0.5 else f'<header class="{self.r.choice(("entry", "post", "article", "page"))}-header">'
            return f"{start}{title}{by}</header>"
        return title

    def aside(self) -> str:
        """A part of another kind inside the article, which goes on after it."""
        part = self.r.choice((self.sidebar, self.sidebar, self.advert, self.advert, self.notice, self.form, self.share, self.menu))
        return part() + "".join(self.paragraph() for _ in range(self.r.choice((0, 1, 1, 2, 3))))

    def article(self) -> str:
        parts = []
        if self.r.random() < 0.12:
            if self.r.random() < 0.5:
                parts.append(self.head())
            parts.append(self.lines())
            if self.r.random() < 0.2:
                parts.append(self.aside())
            return self.framed("".join(parts))
        if self.r.random() < 0.85:
            parts.append(self.head())
        for _ in range(self.r.choice((1, 2, 4, 8, 14))):
            kind = self.r.random()
            if kind < 0.66:
                parts.append(self.paragraph())
            elif kind < 0.74:
                parts.append(f"<h{(k := self.r.randint(2, 4))}>{MARK}{self.words(2, 8)}</h{k}>")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{MARK}{self.words(1, 15)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif kind < 0.84:
                parts.append(f"<blockquote>{MARK}{self.text(1, 3)}</blockquote>")
            elif kind < 0.87:
                cells = "".join(f"<td>{MARK}{self.words(1, 3)}</td>" for _ in range(3))
                parts.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.9:
                parts.append(f"<figure><img src='x'><figcaption>{MARK}{self.sentence()}</figcaption></figure>")
            elif kind < 0.92:
                parts.append(f"<pre>{MARK}{self.words(3, 20)}</pre>")
            elif kind < 0.98:
                parts.append(self.aside())
            else:
                parts.append(f"<div>{MARK}{self.text(1, 3)}</div>")
        if self.r.random() < 0.2 and len(parts) > 2:
            cut = self.r.randint(1, len(parts) - 1)
            tag = self.r.choice(("section", "section", "div"))
            parts = [f"<{tag}>{''.join(p)}</{tag}>" for p in (parts[:cut], parts[cut:])]
        if self.r.random() < 0.15:
            parts.append(self.share())
        if self.r.random() < 0.08:
            parts.append(self.box("footer", "entry-footer tags post-footer", self.links(1, 4)))
        if self.r.random() < 0.12:
            parts.append(self.comments())
        return self.framed("".join(parts))

    def framed(self, inner: str) -> str:
        if self.bare and self.r.random() < 0.5:
            return inner
        if self.semantic:
            return self.r.choice(("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="post">{}</article>')).format(inner)
        return f"{self.named('div', 'content article post entry entry-content story main-text body-text page-content')}{inner}</div>"

    def around(self, body: str) -> str:
        """Everything inside one element, whose names may tell of any part."""
        if self.r.random() < 0.4:
            return f'<form method="post" action="/{self.word()}" id="{self.r.choice(("form1", "aspnetForm", "mainform", "f"))}">{body}</form>'
        name = self.r.choice("wrap page site layout container sidebar-right two-columns has-sidebar with-ads ad-free header-fixed search-page comments-open popup-root footer-dark".split())
        return f'<div class="{name}">{body}</div>'

    def build(self) -> str:
        chance = lambda p: self.r.random() < p
        before = [p() for p, c in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.8), (self.form, 0.2), (self.advert, 0.4), (self.sidebar, 0.25)) if chance(c)]
        after = [p() for p, c in ((self.share, 0.15), (self.comments, 0.35), (self.advert, 0.2), (self.sidebar, 0.35), (self.form, 0.15), (self.menu, 0.15)) if chance(c)]
        if chance(0.3):
            self.r.shuffle(before)
        if chance(0.3):
            self.r.shuffle(after)
        if self.bare:
            before, after = [], []
        middle = [] if chance(0.02) and not self.bare else [self.article()]
        tail = [self.footer()] if chance(0.85) and not self.bare else []
        if chance(0.15) and not self.bare:
            tail.append(self.notice())
        body = "".join([*before, *middle, *after, *tail])
        if chance(0.3):
            body = self.around(body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """n pages; MARK stands at the start of every article block."""
    rng = random.Random(seed)
    return [_Page(rng).build() for _ in range(n)]
