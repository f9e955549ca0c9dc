"""Training pages for the block labeller, and the fit of its weights.

    python -m causalloom.llm.html_training            fits and writes html_weights.npz
    python -m causalloom.llm.html_training --errors   errors on families that a fit has not seen
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from .html_blocks import blocks
from .html_model import WEIGHTS, BlockLabeller, vectors

PAGES, EPOCHS, SEED = 6000, 10, 7

# Names that pages give to their parts, and words of what is no article.
GOOD_NAMES = "content article post entry story main body text page article-body post-content entry-content main-content story-body".split()
BAD_NAMES = {
    "menu": "menu nav navigation navbar topnav breadcrumb breadcrumbs toc pagination pager tabs mainmenu site-nav nav-links".split(),
    "header": "header masthead topbar site-header page-header logo branding brand toolbar".split(),
    "footer": "footer site-footer copyright legal bottom colophon credits page-footer footer-links".split(),
    "sidebar": "sidebar side aside widget widgets related recommended popular trending right-column left-column tags more-stories see-also rail".split(),
    "notice": "notice cookie cookies cookie-banner banner consent gdpr alert popup modal overlay announcement disclaimer privacy message".split(),
    "advert": "ad ads advert advertisement advertising sponsored sponsor promo promotion adsense ad-slot ad-banner commercial".split(),
    "form": "form search search-form newsletter subscribe subscription login signup sign-in contact-form share social sharing".split(),
    "comments": "comments comment comment-list comment-body reply replies responses discussion disqus respond thread user-comments reader-comments".split(),
}
BAD_WORDS = {
    "menu": "home about contact products services blog news archive next previous login help".split(),
    "header": "welcome site official search menu login language home".split(),
    "footer": "copyright all rights reserved terms privacy policy contact imprint powered".split(),
    "sidebar": "related popular recent latest posts tags archives categories read more".split(),
    "notice": "we use cookies accept this site by continuing you agree to our policy".split(),
    "advert": "buy now sponsored advertisement offer sale discount click here free shipping".split(),
    "form": "email subscribe name password submit send search newsletter sign up your address".split(),
    "comments": "reply comment said wrote posted by ago great thanks i agree guest user like".split(),
}
# Frequent words of four languages, which say nothing about a block's role.
FUNCTION_WORDS = [
    "the of and to in a is that it for on was as with be by at this from or are an but not which".split(),
    "le la les de des du et un une en que qui dans pour sur par est au ne pas avec plus ce son".split(),
    "der die das und in zu den von mit ist des im für auf dem nicht ein eine als auch es an bei".split(),
    "el la los de que y en un una ser se no por con su para como es al lo del las más o".split(),
]
TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "notice": "div", "advert": "div", "form": "form", "comments": "section"}


# What pages without telling names write in their parts.
MENU = ["Home", "About", "About us", "Contact", "Products", "Services", "Blog", "News", "Archive", "Login", "Sitemap", "Help", "FAQ", "Next", "Previous", "Forum", "Accueil", "Kontakt", "Impressum", "Inicio"]
FOOT = ["Copyright {y} {n}", "\xa9 {y} {n}. All rights reserved.", "&copy; {n} {y}", "All rights reserved.", "Terms of use | Privacy policy", "Powered by {n}", "Last updated {y}", "Designed by {n}", "Imprint | Contact"]
NOTICE = ["We use cookies to improve this site. By continuing you agree to our policy.", "This site uses cookies.", "Please enable JavaScript.", "Accept all cookies", "Your privacy matters to us", "You are reading an old version of this page."]
ADVERT = ["Advertisement", "Sponsored", "Buy now and save {y}!", "Click here for a special offer from {n}", "Free shipping on all orders", "Sponsored by {n}"]
FORM = ["Search", "Subscribe to our newsletter", "Your email address", "Sign up", "Log in", "Password", "Send", "Share this page", "Tweet", "Print", "Email this"]
SIDE = ["Related posts", "Recent posts", "Popular", "Categories", "Tags", "See also", "Read more", "Most read", "Follow us", "Archives"]
TALK = ["{n} wrote:", "Posted by {n} on {y}", "Reply", "{n} says:", "{y} comments", "Leave a comment", "{n}, {y} days ago"]


class PageMaker:
    """Invented pages with known labels, for training: words of random syllables, layouts of several families.

    semantic: parts have telling tags or names. tables: parts are cells. coded: every name is
    meaningless. bare: no wrappers at all. portal: an outer grid of boxes with ids. A model
    fitted without a family tells how well others carry over to it (errors()).
    """

    FAMILIES = ("semantic", "tables", "coded", "bare", "portal")

    def __init__(self, seed: int, families: tuple[str, ...] = FAMILIES):
        self.families = families
        self.r = random.Random(seed)
        self.n = 0
        self.common: list[str] = []

    def word(self) -> str:
        r = self.r
        return "".join(r.choice("bcdfghklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "é", "ü", "ó", "ea", "er"]) + r.choice(["", "", "n", "r", "s", "t"]) for _ in range(r.randint(1, 4)))

    def prose(self, low: int, high: int, words: list[str] | None = None, marks: bool = True) -> str:
        """Words, now and then in an odd style: signs after words, bars between them, capitals, numbers."""
        r, out = self.r, []
        style = r.choice(["signs", "bars", "loud", "title", "numbers"]) if r.random() < 0.15 else ""
        for i in range(r.randint(low, high)):
            w = r.choice(words) if words and r.random() < 0.5 else r.choice(self.common) if self.common and r.random() < 0.4 else self.word()
            w = w.capitalize() if i == 0 or r.random() < 0.05 or style == "title" else w
            w += r.choice([".", ",", ""]) if marks and r.random() < 0.15 else ""
            if style == "signs":
                w += r.choice(["***", "###", "$$$", "%%%", "&amp;&amp;"])
            elif style == "bars":
                w += " |"
            elif style == "loud":
                w = w.upper() + r.choice(["", "!!"])
            elif style == "numbers" and r.random() < 0.3:
                w = r.choice([f"{r.randint(0, 9)}.{r.randint(0, 9)}", str(r.randint(0, 2030)), w.upper(), f"{w}@{w}.org"])
            out.append(w)
        return " ".join(out) + ("." if marks and r.random() < 0.8 else "")

    def mark(self, good: bool, text: str) -> str:
        """Text that carries its label, to be found again after parsing."""
        self.n += 1
        return f"\x02{'G' if good else 'B'}\x03{text}"

    def name(self, names: list[str]) -> str:
        r = self.r
        x = r.choice(names)
        if r.random() < 0.2:
            x += " " + self.word()
        return r.choice(['class="{}"', 'class="{}"', 'id="{}"', 'class="{}" data-x="1"']).format(x)

    def junk(self, kind: str) -> str:
        r, words = self.r, BAD_WORDS[kind]
        named = r.random() < 0.6
        tag = TAGS[kind] if r.random() < 0.7 and not (TAGS[kind] == "section" and not named) else "div"
        if tag in ("div", "section"):
            named = True
        attrs = " " + self.name(BAD_NAMES[kind]) if named else ""
        foreign = words if r.random() < 0.6 else None
        kinds = {"menu": 0, "header": r.choice([0, 1]), "footer": r.choice([0, 1, 1]), "sidebar": r.choice([0, 1, 2]), "form": 3, "comments": 2, "notice": 1, "advert": r.choice([1, 1, 2])}
        shape = kinds[kind]
        if shape == 0:
            item = r.choice(['<li><a href="/x">{}</a></li>'] * 3 + ["<li>{}</li>", '<a href="/x">{}</a> | '])
            items = "".join(item.format(self.mark(False, self.prose(1, 3, foreign, False))) for _ in range(r.randint(2, 8)))
            inner = f"<ul>{items}</ul>" if item.startswith("<li") else items
        elif shape == 1:
            inner = self.mark(False, r.choice(["", "&copy; "]) + self.prose(2, 25, foreign))
            inner = r.choice(["{}", "<p>{}</p>", "<span>{}</span>", '<a href="/x">{}</a>']).format(inner)
        elif shape == 2:
            k = r.randint(2, 4)
            head = f"<h{k}>{self.mark(False, self.prose(1, 4, foreign, False))}</h{k}>" if r.random() < 0.6 else ""
            inner = head + "".join(r.choice(["<p>{}</p>", "<div>{}</div>"]).format(self.mark(False, self.prose(4, 60, foreign))) for _ in range(r.randint(1, 5)))
        else:
            inner = f"<label>{self.mark(False, self.prose(1, 4, foreign, False))}</label><input name=q><button>{self.mark(False, self.prose(1, 2, foreign, False))}</button>"
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def article(self) -> str:
        r, parts = self.r, []
        bare = r.random() < 0.2
        if r.random() < 0.85:
            title = f"<h1>{self.mark(True, self.prose(2, 14, None, r.random() < 0.5))}</h1>"
            parts.append(f"<header>{title}</header>" if r.random() < 0.1 else title)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20, 40])):
            text = self.mark(True, self.prose(1, r.choice([3, 10, 40, 120, 250])))
            kind = r.random()
            if kind < 0.66 and not bare:
                parts.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p>{text}")
            elif kind < 0.66:
                parts.append(f"<div>{text}</div>")
            elif kind < 0.72:
                parts.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                k = r.randint(2, 4)
                parts.append(f"<h{k}>{text}</h{k}>")
            elif kind < 0.82:
                parts.append(f"<blockquote><p>{text}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text}</blockquote>")
            elif kind < 0.87:
                t = r.choice(["ul", "ol"])
                parts.append(f"<{t}>" + "".join(f"<li>{self.mark(True, self.prose(1, 20))}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>")
            elif kind < 0.89:
                parts.append(f"<pre>{text}</pre>")
            elif kind < 0.92:
                parts.append(f"<figure><img src=x><figcaption>{self.mark(True, self.prose(2, 12))}</figcaption></figure>")
            elif kind < 0.94:
                parts.append(f"<dl><dt>{self.mark(True, self.prose(1, 3))}</dt><dd>{text}</dd></dl>")
            elif kind < 0.96:
                parts.append(f"<section><h2>{self.mark(True, self.prose(1, 6))}</h2><p>{text}</p></section>")
            else:
                head = "<tr>" + "".join(f"<th>{self.mark(True, self.prose(1, 3, None, False))}</th>" for _ in range(2)) + "</tr>" if r.random() < 0.5 else ""
                body = "".join(f"<tr><td>{self.mark(True, self.prose(1, 4))}</td><td>{self.mark(True, self.prose(1, 8))}</td></tr>" for _ in range(r.randint(1, 4)))
                parts.append(f"<table>{head}{body}</table>")
        if r.random() < 0.25:
            parts.insert(r.randint(0, len(parts)), self.junk(r.choice(["advert", "sidebar", "form", "notice"])))
        tag = r.choice(["article", "article", "article", "main", "div", "section"])
        attrs = " " + self.name(GOOD_NAMES) if tag in ("div", "section") or r.random() < 0.3 else ""
        if r.random() < 0.15:
            return "".join(parts)
        if tag in ("div", "section") and r.random() < 0.15:
            attrs = ""
        out = f"<{tag}{attrs}>{''.join(parts)}</{tag}>"
        return f"<div {self.name(GOOD_NAMES + ['wrapper', 'container', 'row', 'col'])}>{out}</div>" if r.random() < 0.25 else out

    def fill(self, text: str) -> str:
        r = self.r
        name = " ".join(self.word().capitalize() for _ in range(r.randint(1, 2)))
        return text.format(y=r.randint(1996, 2026) if r.random() < 0.8 else r.randint(1, 30), n=name)

    def lines(self, kind: str) -> list[str]:
        """Leaves of a part that is no article, as their words alone tell."""
        r = self.r

        def link(x: str) -> str:
            return f'<a href="/{self.word()}">{x}</a>'

        if kind == "menu":
            items = [x if r.random() < 0.8 else self.prose(1, 2, None, False) for x in r.sample(MENU, r.randint(3, 7))]
            if r.random() < 0.5:
                return [self.mark(False, r.choice([" | ", " | ", " &middot; ", " &raquo; ", " - "]).join(link(x) if r.random() < 0.7 else x for x in items))]
            return [self.mark(False, link(x) if r.random() < 0.8 else x) for x in items]
        if kind == "header":
            return [self.mark(False, self.fill(r.choice(["{n}", "Welcome to {n}", "The official site of {n}", "{n} online"])))]
        if kind == "sidebar":
            return [self.mark(False, r.choice(SIDE))] + [self.mark(False, link(self.prose(2, 7, None, False))) for _ in range(r.randint(1, 5))]
        if kind == "comments":
            out = [self.mark(False, self.fill(r.choice(["Comments", "{y} comments", "Reader comments", "Discussion", "Responses"])))]
            for _ in range(r.randint(1, 4)):
                out += [self.mark(False, self.fill(r.choice(TALK))), self.mark(False, self.prose(3, 40))]
            return out
        if kind == "footer":
            return [self.mark(False, self.fill(x)) for x in r.sample(FOOT, r.randint(1, 3))]
        return [self.mark(False, self.fill(x)) for x in r.sample({"notice": NOTICE, "advert": ADVERT, "form": FORM}[kind], r.randint(1, 2))]

    def body(self) -> list[str]:
        """An article's leaves in bare tags."""
        r = self.r
        out = [r.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<font size=5>{}</font><br><br>", "<p><b>{}</b></p>"]).format(self.mark(True, self.prose(2, 12, None, r.random() < 0.3)))] if r.random() < 0.85 else []
        wrap = r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>", "<div>{}</div>", '<p class="x">{}</p>', "<p><font face=x>{}</font></p>", "<center>{}</center>"])
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            kind = r.random()
            text = self.prose(2, r.choice([8, 30, 80, 160]))
            if kind < 0.75:
                out.append(wrap.format(self.mark(True, text)))
            elif kind < 0.81:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.mark(True, self.prose(1, 8, None, False))}</h{k}>")
            elif kind < 0.95:
                out.append("<ul>" + "".join(f"<li>{self.mark(True, self.prose(1, 18))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            else:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(True, self.prose(1, 4))}</td><td>{self.mark(True, self.prose(1, 6))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
        return out

    def parts(self, before: str, after: str, share: float = 0.5) -> tuple[list[str], list[str]]:
        r = self.r
        first, last = ([k for k in x.split() if r.random() < share] for x in (before, after))
        return first or ["menu"], last or ["footer"]

    def tables(self) -> str:
        r = self.r
        first, last = self.parts("header menu advert notice", "advert form comments footer")

        def cell(kind: str) -> str:
            return r.choice(["<br>\n", "<p>", "<div></div>", "</td></tr><tr><td>"]).join(self.lines(kind))

        side = r.choice(["menu", "sidebar", "form", None])
        inner = "".join(self.body())
        row = ([f"<td valign=top>{cell(side)}</td>"] if side else []) + [f"<td width={r.randint(300, 900)}>{inner}</td>"]
        if r.random() < 0.3:
            row.reverse()
        if r.random() < 0.25:
            row.append(f"<td>{cell('sidebar')}</td>")
        span = f" colspan={len(row)}"
        top = "".join(f"<tr><td{span}>{cell(k)}</td></tr>" for k in first)
        end = "".join(f"<tr><td{span} align=center>{cell(k)}</td></tr>" for k in last)
        return f"<table border=0 width=100%>{top}<tr>{''.join(row)}</tr>{end}</table>"

    def coded(self) -> str:
        r = self.r
        first, last = self.parts("notice header menu advert sidebar", "form comments sidebar advert footer")

        def name() -> str:
            return r.choice(["c{}", "css-{}x", "sc-{}", "r{}", "u-{}", "{}"]).format(r.choice([str(r.randint(1, 99)), self.word()]))

        def box(lines: list[str]) -> str:
            tag = r.choice(["<div>{}</div>", '<div class="{c}">{}</div>', "<p>{}</p>", "<span>{}</span><br>"]) if len(lines) > 1 else "{}"
            return f'<div class="{name()}">' + "".join(tag.format(x, c=name()) for x in lines) + "</div>"

        out = "".join(box(self.lines(k)) for k in first) + f'<div class="{name()}">{"".join(self.body())}</div>' + "".join(box(self.lines(k)) for k in last)
        for _ in range(r.randint(0, 2)):
            out = f'<div class="{name()}">{out}</div>'
        return out

    def bare(self) -> str:
        r = self.r
        first, last = self.parts("menu header", "advert comments menu footer")

        def run(kind: str) -> str:
            return r.choice(["<hr>", ""]) + "".join(r.choice(["<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "{}<br><hr>"]).format(x) for x in self.lines(kind))

        return "".join(map(run, first)) + "".join(self.body()) + "".join(map(run, last))

    def portal(self) -> str:
        r = self.r
        first, last = self.parts("header menu notice form", "sidebar comments advert footer")

        def box(lines: list[str], good: bool) -> str:
            at = r.choice(['id="col{}"', 'id="box{}"', 'class="block block-{}"', 'class="grid-{} cell"', 'id="main{}"']).format(r.randint(1, 20))
            items = "".join(lines) if good else r.choice(["<ul>{}</ul>", "{}"]).format("".join(f"<li>{x}</li>" for x in lines))
            return f"<div {at}><div class=inner>{items}</div></div>"

        boxes = [box(self.lines(k), False) for k in first] + [box(self.body(), True)] + [box(self.lines(k), False) for k in last]
        return f'<div id="page"><div class="row">{"</div><div class=row>".join(boxes)}</div></div>'

    def semantic(self) -> str:
        r = self.r
        before = [self.junk(k) for k in ("notice", "header", "menu", "advert", "sidebar") if r.random() < 0.45]
        after = [self.junk(k) for k in ("form", "comments", "sidebar", "advert", "footer", "notice") if r.random() < 0.45]
        r.shuffle(before)
        return "".join(before) + (self.article() if r.random() < 0.97 else "") + "".join(after)

    def page(self) -> str:
        r = self.r
        self.common = r.choice(FUNCTION_WORDS) if r.random() < 0.7 else []
        body = getattr(self, r.choice(self.families))()
        head = f"<head><title>{self.prose(2, 8)}</title><style>p{{}}</style><script>var t=1;</script></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


MARK = re.compile("\x02([GB])\x03")


def labelled(count: int, seed: int, families: tuple[str, ...] = PageMaker.FAMILIES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels (1: article) of invented pages."""
    # Of all families, the first has half of the pages.
    share = (families[0],) * max(1, len(families) - 1) + families[1:] if families[0] == "semantic" else families
    maker, out = PageMaker(seed, share), []
    while len(out) < count:
        found = blocks(maker.page())
        labels = []
        for b in found:
            labels.append(float("B" not in MARK.findall(b.text)))
            b.text = MARK.sub("", b.text)
            b.linked = min(b.linked, len(b.text))
        found, labels = [b for b in found if b.text], [v for b, v in zip(found, labels, strict=True) if b.text]
        if found:
            out.append((vectors(found), np.array(labels, np.float32)))
    return out


def wrong(model: BlockLabeller, pages: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Share of blocks with the wrong label."""
    got = model.label([v for v, _ in pages])
    return sum(int((a != (y > 0)).sum()) for a, (_, y) in zip(got, pages, strict=True)) / sum(len(y) for _, y in pages)


def fitted(pages: int = PAGES, epochs: int = EPOCHS, families: tuple[str, ...] = PageMaker.FAMILIES) -> BlockLabeller:
    model = BlockLabeller(SEED)
    model.fit(labelled(pages, SEED, families), epochs=epochs, batch=48, seed=SEED)
    return model


def main() -> None:
    if "--errors" in sys.argv:
        for family in PageMaker.FAMILIES:
            others = tuple(f for f in PageMaker.FAMILIES if f != family)
            model = fitted(1000, 6, others)
            print(f"{family}: {wrong(model, labelled(150, 99, (family,))):.4f} unseen, others {wrong(model, labelled(150, 98, others)):.4f}", flush=True)
        return
    model = fitted()
    np.savez_compressed(WEIGHTS, **model.p)
    for family in PageMaker.FAMILIES:
        print(f"{family}: {wrong(model, labelled(200, 97, (family,))):.4f}", flush=True)


if __name__ == "__main__":
    main()
