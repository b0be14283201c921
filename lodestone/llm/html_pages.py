"""Seeded labelled pages that the HTML model is trained on.

A page is written from a small grammar of page parts as they are named on the public web. Every element that starts
content or boilerplate carries `data-y="1"` or `data-y="0"`; elements without the mark have their parent's label.
The extractor never reads the mark when it extracts.
"""

from __future__ import annotations

import random

#: Names of page parts (fixed values).
CONTENT_NAMES = "content main-content post-content entry-content article-body article-content post-body story story-body page-content text body-text entry post main prose".split()
MENU_NAMES = "menu nav navbar navigation main-nav breadcrumb breadcrumbs topnav toc pagination pager tabs".split()
SIDE_NAMES = "sidebar side-bar widget related related-posts recommended trending popular tags tag-cloud archive promo-box".split()
AD_NAMES = "ad ads advert advertisement ad-slot adsbox banner-ad sponsored sponsor promo".split()
NOTICE_NAMES = "cookie cookie-notice cookie-banner consent gdpr notice alert popup modal overlay banner newsletter subscribe signup paywall".split()
COMMENT_NAMES = "comments comment comment-list comment-body discussion responses replies disqus reader-comments".split()
FOOT_NAMES = "footer site-footer page-footer copyright legal bottom colophon".split()
HEAD_NAMES = "header site-header masthead top-bar page-header logo branding".split()
SHARE_NAMES = "share social social-share share-buttons follow author-links byline-links toolbar".split()


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("aeiourstlnmdk") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def name(self, names: list[str]) -> str:
        r = self.rng
        how = r.random()
        if how < 0.55:
            return f' class="{r.choice(names)}"'
        if how < 0.8:
            return f' id="{r.choice(names)}"'
        return f' id="{r.choice(names)}" class="{r.choice(names)} {r.choice(["box", "wrap", "inner", "col", "row", "block"])}"'

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.rng.randint(low, high))) + "</ul>"

    def paragraph(self) -> str:
        r, text = self.rng, self.words(2, 90)
        if r.random() < 0.3:
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 20)}'
        if r.random() < 0.3:
            text = f"<{(t := r.choice(['b', 'em', 'strong', 'span', 'i', 'code']))}>{self.words(1, 6)}</{t}> {text}"
        return f"<p>{text}</p>" if r.random() < 0.9 else f"<p><b>{text}<br>"

    def body(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(1, 9)}</h1>")
        for _ in range(r.randint(1, 9)):
            how = r.random()
            if how < 0.68:
                out.append(self.paragraph())
            elif how < 0.73:
                out.append(f"<{(t := r.choice(['section', 'section', 'div']))}>{self.heading(0.8)}{''.join(self.paragraph() for _ in range(r.randint(1, 4)))}</{t}>")
            elif how < 0.76:
                out.append("<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.words(3, 20)}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
            elif how < 0.82:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.words(1, 7)}</h{n}>")
            elif how < 0.87:
                out.append(f"<blockquote><p>{self.words(4, 30)}</p></blockquote>")
            elif how < 0.92:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif how < 0.95:
                out.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif how < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif how < 0.985:
                out.append(f"<pre>{self.words(3, 30)}</pre>")
            else:
                out.append(f"<div>{self.words(5, 40)}</div>")
            if r.random() < 0.05:
                out.append(self.boiler(AD_NAMES, "div", self.words(2, 20)))
        return "".join(out)

    def boiler(self, names: list[str], tag: str, inside: str, bare: float = 0.0) -> str:
        return f'<{tag}{"" if self.rng.random() < bare else self.name(names)} data-y="0">{inside}</{tag}>'

    def comments(self) -> str:
        r = self.rng
        quote = lambda: f"<blockquote>{self.words(2, 12)}</blockquote>" if r.random() < 0.2 else ""
        one = lambda: f'<{(t := r.choice(["div", "li", "article"]))} class="comment">{self.heading(0.2)}{quote()}<p>{self.words(3, 60)}</p></{t}>'
        return self.boiler(COMMENT_NAMES, r.choice(["div", "section", "aside"]), self.heading(0.5) + "".join(one() for _ in range(r.randint(1, 4))))

    def heading(self, share: float) -> str:
        return f"<h{(n := self.rng.randint(2, 4))}>{self.words(1, 5)}</h{n}>" if self.rng.random() < share else ""

    def form(self) -> str:
        return f'<form data-y="0"><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button><p>{self.words(2, 10)}</p></form>'

    def parts(self) -> tuple[list[str], list[str]]:
        """Boilerplate before and after the content."""
        r, before, after = self.rng, [], []
        if r.random() < 0.9:
            before.append(self.boiler(MENU_NAMES, r.choice(["nav", "nav", "div"]), self.links(2, 9), 0.0) if r.random() < 0.6 else f'<nav data-y="0">{self.links(2, 9)}</nav>')
        if r.random() < 0.4:
            before.insert(0, f'<header data-y="0">{self.words(1, 6) if r.random() < 0.5 else "<h1>" + self.words(1, 5) + "</h1>"}</header>' if r.random() < 0.5 else self.boiler(HEAD_NAMES, r.choice(["header", "div"]), f"<p>{self.words(1, 12)}</p>"))
        for names, p in ((AD_NAMES, 0.5), (NOTICE_NAMES, 0.35), (SIDE_NAMES, 0.4)):
            if r.random() < p:
                tag = r.choice(["aside", "div", "div", "section"] if names is SIDE_NAMES else ["div", "div", "section", "p"])
                inside = self.words(2, 35) if r.random() < 0.5 else f"<p>{self.words(2, 40)}</p>" if tag != "p" and r.random() < 0.7 else self.links(2, 5) if tag != "p" else self.words(2, 30)
                if tag != "p":
                    inside = self.heading(0.4) + inside
                if tag != "p" and r.random() < 0.1:
                    inside += f"<table><tr><td>{self.words(1, 4)}</td></tr></table>"
                r.choice([before, after]).append(self.boiler(names, tag, inside))
        if r.random() < 0.2:
            r.choice([before, after]).append(f'<aside data-y="0">{self.heading(0.4)}<p>{self.words(3, 40)}</p></aside>')
        if r.random() < 0.35:
            after.append(self.comments())
        if r.random() < 0.25:
            r.choice([before, after]).append(self.form())
        if r.random() < 0.2:
            after.append(self.boiler(SHARE_NAMES, "div", self.links(2, 4)))
        if r.random() < 0.9:
            inside = f"&copy; {self.words(2, 14)}"
            after.append(f'<footer data-y="0">{inside}</footer>' if r.random() < 0.6 else self.boiler(FOOT_NAMES, r.choice(["footer", "div"]), f"<p>{inside}</p>"))
        return before, after

    def page(self) -> str:
        r = self.rng
        before, after = self.parts()
        how = r.random()
        if how < 0.4:
            main = f'<article data-y="1">{self.body()}</article>'
        elif how < 0.55:
            main = f'<main data-y="1">{self.body()}</main>'
        elif how < 0.65:
            main = f'<main data-y="1"><article>{self.body()}</article></main>'
        elif how < 0.9:
            main = f'<{(t := r.choice(["div", "div", "section", "article"]))}{self.name(CONTENT_NAMES)} data-y="1">{self.body()}</{t}>'
        else:
            main = f'<div data-y="1">{self.body()}</div>'
        if r.random() < 0.12:  # a page or fragment without any frame around its content
            inside = self.body()
            if r.random() < 0.6:
                inside = self.words(2, 40) + inside
            boiler = "".join(r.sample(before + after, min(len(before + after), r.randint(0, 2))))
            return f'<html data-y="1"><body>{inside}{boiler}</body></html>' if r.random() < 0.5 else f'<html data-y="1">{inside}{boiler}'
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            main = f'<div class="{r.choice(["wrap", "container", "page", "row"])}">{main}</div>' if r.random() < 0.5 else f"<div>{main}</div>"
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>f("</p>");</script></head><body data-y="0">{"".join(before)}{main}{"".join(after)}</body></html>'


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """n labelled pages; the same for the same seed."""
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(n)]
