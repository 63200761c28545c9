"""Made-up pages with known labels, from which the block labeller learns layouts that a corpus may lack.

A page is a list of regions in an order that pages have; each region is an element with or
without telling names around blocks of words. The words come from the corpus itself, so that
places and names decide and not what boilerplate happens to say, with now and then a phrase
that such regions have.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from html import escape

#: Names that authors give to regions, and elements they use for them.
REGIONS = {
    "menu": ("nav navbar menu main-menu topnav site-nav breadcrumb breadcrumbs pagination navigation toc links tabs subnav pager", "nav nav div ul section"),
    "header": ("header site-header masthead topbar banner logo branding top page-header", "header header div section"),
    "footer": ("footer site-footer copyright colophon bottom legal page-footer foot", "footer footer div section"),
    "sidebar": ("sidebar side-bar aside rail widget related related-posts recommended popular tags more-stories see-also left-column right-column author-box", "aside aside div section"),
    "notice": ("notice cookie cookie-banner cookies consent gdpr alert popup modal newsletter subscribe paywall warning announcement message toast overlay", "div div section aside"),
    "advert": ("ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion ad-slot ad-box banner-ad commercial partner", "div div aside section"),
    "form": ("search search-form login signup contact-form newsletter-form filter register survey poll", "form form div"),
    "comments": ("comments comment-list comment comments-area discussion responses replies respond reply disqus reader-comments user-comments feedback", "section div ol ul"),
    "share": ("share social social-share sharing follow share-buttons tools print actions", "div ul"),
}
MAIN = ("article content post entry entry-content post-body article-body story main main-content text body-text page-content article-content story-body prose rich-text body copy", "article article article main div div section td")
PHRASES = {
    "menu": ["Home", "About us", "Contact", "News", "Sports", "Next page"],
    "header": ["Welcome", "Subscribe", "Log in"],
    "footer": ["© 2020", "All rights reserved.", "Terms of use", "Privacy policy", "Impressum"],
    "sidebar": ["Related", "Most read", "Popular", "You may also like", "Tags"],
    "notice": ["We use cookies.", "Accept all", "Sign up for our newsletter", "Please enable JavaScript."],
    "advert": ["Advertisement", "Sponsored", "Buy now", "Sale"],
    "form": ["Search", "Your e-mail", "Send", "Password", "Required field"],
    "comments": ["Reply", "says:", "3 comments", "Leave a comment", "Posted by"],
    "share": ["Share", "Tweet", "Print", "E-mail this"],
}


class Layouts:
    def __init__(self, words: Sequence[str], seed: int) -> None:
        self.rng = rng = random.Random(seed)
        syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
        invented = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(500)]
        self.words = [*words, *invented * max(1, len(words) // 1000)]

    def _say(self, low: int, high: int) -> str:
        rng, n = self.rng, self.rng.randint(low, high)
        said = [rng.choice(self.words) for _ in range(n)]
        if n > 6 and rng.random() < 0.8:
            for k in range(rng.randint(3, 9), n, rng.randint(5, 12)):
                said[k] = said[k].rstrip(".,") + "."
        said[0] = said[0].capitalize()
        return " ".join(said)

    def _inline(self, text: str) -> str:
        """Text with markup inside a line, white space and a break here and there."""
        rng = self.rng
        words = escape(text, quote=rng.random() < 0.3).split(" ")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            a = rng.randrange(len(words))
            tag = rng.choice(["b", "i", "em", "strong", "a href='/x'", "span class='hl'", "code"])
            words[a] = f"<{tag}>{words[a]}</{tag.split()[0]}>" if rng.random() < 0.9 else f"<{tag}>{words[a]}"
        return rng.choice([" ", " ", "\n", "  "]).join(words) + rng.choice(["", "", "", "<br>"])

    def _named(self, names: str, tags: str, telling: float) -> tuple[str, str]:
        rng = self.rng
        tag = rng.choice(tags.split())
        generic = tag in ("div", "section", "ul", "ol", "td", "aside")
        if rng.random() < (telling if generic else 0.4):
            word = rng.choice(names.split())
            word = word.replace("-", rng.choice(["-", "_"])) + rng.choice(["", "", "", f" c{rng.randrange(9)}", "-1"])
            return tag, f'<{tag} {rng.choice(["class", "class", "id"])}="{word}">'
        return tag, f"<{tag}>"

    def _region(self, kind: str) -> list[tuple[str, str | None]]:
        """(markup before the text, text or None for markup alone) of a region."""
        rng = self.rng
        tag, start = self._named(*REGIONS[kind], telling=0.95)
        phrase = lambda low, high: rng.choice(PHRASES[kind]) if rng.random() < 0.35 else self._say(low, high)
        out: list[tuple[str, str | None]] = [(start, None)]
        if kind in ("menu", "share") or (kind in ("footer", "sidebar", "header") and rng.random() < 0.5):
            item = rng.random() < 0.8
            if tag not in ("ul", "ol") and item:
                out.append(("<ul>", None))
            for _ in range(rng.randint(1, 8)):
                out.append(("<li><a href='/a'>" if item else "<div><a href='/a'>", phrase(1, 4)))
                out.append(("</a></li>" if item else "</a></div>", None))
            if tag not in ("ul", "ol") and item:
                out.append(("</ul>", None))
        elif kind == "comments":
            for _ in range(rng.randint(1, 5)):
                box = rng.choice(["div class='comment'", "li", "p", "article class='comment'", "div"])
                out += [(f"<{box}>", None), ("<h4>", phrase(1, 3)), ("</h4><p>", self._say(3, 60)), (f"</p></{box.split()[0]}>", None)]
        elif kind == "form":
            for _ in range(rng.randint(1, 4)):
                out += [(rng.choice(["<label>", "<p>", "<div>"]), phrase(1, 5)), ("</label><div>", None), ("<input type='text' name='q'></div><button>", None), ("Go</button>", None)]
        else:
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                inner = rng.choice(["", "p", "div", "h3", "span"])
                out.append((f"<{inner}>" if inner else "", phrase(1, 40)))
                out.append((f"</{inner}>" if inner else "<div></div>", None))
        out.append((f"</{tag}>", None))
        return out

    def _article(self) -> list[tuple[str, str | None]]:
        rng = self.rng
        tag, start = self._named(*MAIN, telling=0.85)
        out: list[tuple[str, str | None]] = [(start, None)]
        if rng.random() < 0.75:
            wrap = rng.random() < 0.2
            out += [("<header>" if wrap else "", None), (f"<h{rng.choice('1112')}>", self._say(2, 12)), ("</h1>" if rng.random() < 0.9 else "", None), ("</header>" if wrap else "", None)]
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 12, 20, 45])):
            shape = rng.choices(["p", "h2", "ul", "blockquote", "pre", "table", "div", "inset"], [30, 3, 3, 2, 1, 1, 3, 1])[0]
            if shape == "p":
                out.append(("<p>", self._say(1, rng.choice([5, 20, 80, 150]))))
                out.append((rng.choice(["</p>", "</p>", "</p>", "", "<br>"]), None))
            elif shape in ("ul", "table"):
                out.append((f"<{shape}>", None))
                for _ in range(rng.randint(1, 5)):
                    out += [("<li>" if shape == "ul" else "<tr><td>", self._say(1, 15)), ("</li>" if shape == "ul" else "</td></tr>", None)]
                out.append((f"</{shape}>", None))
            elif shape == "inset":
                out += [(m, "\0" + t if t is not None else None) for m, t in self._region(rng.choice(["advert", "share", "sidebar", "notice"]))]
            else:
                out += [(f"<{shape}>", self._say(1, 30)), (f"</{shape}>", None)]
        return [*out, (f"</{tag}>", None)]

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """A page and its blocks in order: text with single spaces, and whether it is of the article."""
        rng = self.rng
        before = rng.sample(["header", "menu", "notice", "advert", "form", "sidebar", "menu"], rng.randint(0, 4))
        after = rng.sample(["comments", "sidebar", "footer", "advert", "share", "notice", "footer", "form"], rng.randint(0, 5))
        parts = [(False, self._region(k)) for k in before] + [(True, self._article())] + [(False, self._region(k)) for k in after]
        if rng.random() < 0.04:  # a page without an article
            parts = [p for p in parts if not p[0]]
        html, blocks = ["<!DOCTYPE html><html><head><title>", escape(self._say(2, 8)), "</title><script>var t='</p>';</script></head><body>"], []
        wraps = rng.randint(0, 2)
        html += [f"<div class='{rng.choice(['wrapper', 'page', 'container', 'row', 'layout'])}'>"] * wraps
        for main, pieces in parts:
            for markup, text in pieces:
                html.append(markup)
                if text is not None:
                    own = main and not text.startswith("\0")
                    text = text.lstrip("\0")
                    html.append(self._inline(text) if main else escape(text))
                    blocks.append((" ".join(text.split()), own))
            html.append(rng.choice(["", "\n", "<!-- end -->"]))
        html += ["</div>"] * wraps + [rng.choice(["</body></html>", ""])]
        return "".join(html), blocks
