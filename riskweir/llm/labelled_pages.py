"""Labelled pages to learn from: layouts in which every part is marked as main text or not.

An element with ``data-main="1"`` is main text with all that it holds, one with ``data-main="0"`` isn't; the innermost mark counts. The words of
running text are drawn at random, so nothing about a language is learnt; names of classes and the phrases of page furniture are not.
"""

from __future__ import annotations

import random

#: What pages call their parts: names of classes and ids, and what is written there.
FURNITURE = {
    "menu": (
        "nav navbar navigation menu main-menu site-nav topnav nav-bar breadcrumb breadcrumbs toc sub-menu pager pagination page-numbers toolbar skip-link tabs language-switcher menue navegacion menu-principal",
        "Home|About us|Contact|News|Login|Sign in|Startseite|Kontakt|Accueil|Inicio|Next page|Previous|Skip to content|Menu|Archive|Topics",
    ),
    "header": (
        "header site-header page-header masthead topbar top-bar head branding logo site-title tagline hero-bar kopf kopfzeile cabecera entete",
        "Welcome|The daily paper|Search|Log in|Register|Subscribe now|Your account|Willkommen|Bienvenue|Bienvenido",
    ),
    "footer": (
        "footer site-footer page-footer foot bottom colophon copyright legal imprint credits footer-links fuss fusszeile pied-de-page pie",
        "© 2024 Example. All rights reserved.|Copyright © Example|Privacy policy|Terms of use|Imprint · Contact|Impressum|Mentions légales|Aviso legal|Powered by Example|Back to top",
    ),
    "sidebar": (
        "sidebar side-bar aside side rail right-column left-column widget widget-area secondary related related-posts related-articles recommended more-stories popular most-read trending "
        "read-next see-also tag-cloud recent-posts teaser-list seitenleiste barra-lateral",
        "Related articles|Most read|Popular posts|Recent posts|More from this section|You may also like|Read more|Trending now|Categories|Tags|Follow us|Mehr zum Thema|À lire aussi|Más leídas",
    ),
    "notice": (
        "notice cookie cookie-banner cookie-consent consent gdpr-banner privacy-notice alert alert-box warning-bar disclaimer message banner info-bar popup modal overlay paywall age-gate announcement "
        "breaking-bar print-notice",
        "This site uses cookies.|We use cookies to improve your experience.|Accept all|Please enable JavaScript|Your browser is out of date|Wir verwenden Cookies|Nous utilisons des cookies|"
        "Usamos cookies|Subscribers only|Important notice|You have 3 free articles left",
    ),
    "ad": (
        "ad ads advert advertisement advertising adsbygoogle ad-slot ad-container ad-banner sponsor sponsored sponsored-content promo promotion promoted promo-box affiliate commercial partner-offer banner-ad leaderboard werbung anzeige publicite publicidad",
        "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Shop now|Special offer|Learn more|Limited offer!|Save 50% today",
    ),
    "form": (
        "form search-form searchbox login-form contact-form newsletter newsletter-signup subscribe subscription signup sign-up subscribe-box poll survey donate comment-form feedback",
        "Subscribe to our newsletter|Your e-mail address|Sign up|Enter your email|Search this site|Password|Send|Submit|Newsletter abonnieren|S'abonner|Suscribirse",
    ),
    "comments": (
        "comments comment comment-list commentlist comments-area reader-comments user-comments discussion responses respond replies reply thread disqus disqus-thread fb-comments reviews guestbook kommentare commentaires comentarios",
        "Comments|3 comments|Leave a reply|Leave a comment|Reader comments|Join the discussion|Kommentare|Commentaires|Comentarios|Reply|Report|Says:|Responses|2 thoughts on|What readers say",
    ),
    "share": (
        "share sharing social social-share share-buttons social-links follow follow-us addthis sharedaddy print-tools article-tools",
        "Share|Tweet|Share on Facebook|Email this|Print|Teilen|Partager|Compartir|Follow us on Twitter",
    ),
}
SAID = sorted({w.strip(".,!").lower() for _, said in FURNITURE.values() for w in said.replace("|", " ").split() if w.strip(".,!").isalpha()})
TAGS = {
    "menu": "nav nav nav div ul div", "header": "header header div div", "footer": "footer footer footer div section", "sidebar": "aside aside div section div", "notice": "div div p section aside dialog",
    "ad": "div div div aside section p ins", "form": "form form form div section", "comments": "section div div ol aside", "share": "div ul div p",
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search"}
#: What pages call the part that holds the main text, and the parts of it.
HOLDERS = (
    "article post entry content main main-content article-body post-body entry-content post-content article-content article__body story story-body page-content text body-text body prose hentry blog-post "
    "news-article single-post content-area td-post-content rich-text markdown-body inhalt beitrag artikel contenu contenido texto"
).split()
WRAPPERS = "wrapper page container content-wrapper site layout row col main-column primary inner grid site-content page-wrapper columns content".split()
INNER = "intro lead summary dropcap first caption quote paragraph section subtitle standfirst byline author date meta headline title entry-title post-title figure image note-text".split()
_LETTERS = "etaoinsrhldcumfpgwybvkäöüéèñçßó"


class Author:
    """Writes one page; everything is drawn from one seed."""

    def __init__(self, seed: int) -> None:
        self.draw = random.Random(seed)
        self.upper = self.draw.random() < 0.05
        self.lexicon = ["".join(self.draw.choices(_LETTERS, k=self.draw.randint(2, 10))) for _ in range(70)]
        self.lexicon += self.draw.sample(SAID, 12)  # running text has the words of page furniture, too
        self.unclosed = self.draw.random() < 0.3
        #: Share of parts that have a class or id of their own.
        self.named = self.draw.choice([0.0, 0.3, 0.9, 0.9, 1.0])
        self.semantic = self.draw.random() < 0.55
        #: The main text has no element of its own.
        self.flat = self.draw.random() < 0.12

    def words(self, low: int, high: int) -> str:
        out = self.draw.choices(self.lexicon, k=self.draw.randint(low, high))
        for k in range(len(out)):
            if self.draw.random() < 0.1:
                out[k] += self.draw.choice([",", ".", ".", ";", "!", " |", " &amp;", " &quot;", "%%%", " ***"])
        return " ".join(out).capitalize() + self.draw.choice([".", ".", ".", "", "!", "?"])

    def prose(self, low: int = 1, high: int = 90) -> str:
        text = self.words(low, self.draw.choice([low + 2, 12, 30, high, 3 * high]))
        for kind in self.draw.choices(["", "", "", "a", "b", "i", "span", "br", "code"], k=2):
            at = text.find(" ", self.draw.randint(0, len(text)))
            if kind == "br":
                text = text[:at + 1] + "<br>" + text[at + 1:] if at > 0 else text
            elif kind and at > 0:
                href = ' href="/x"' if kind == "a" else ""
                text = f"{text[:at]} <{kind}{href}>{self.words(1, 4)}</{kind}>{text[at:]}"
        return text

    def names(self, kind: str) -> str:
        if self.draw.random() >= self.named:
            return ""
        names = FURNITURE[kind][0].split() if kind in FURNITURE else {"holder": HOLDERS, "wrapper": WRAPPERS, "inner": INNER}[kind]
        name = self.draw.choice(names)
        if self.draw.random() < 0.3:
            name += self.draw.choice(["-1", "-box", "-inner", "-wrapper", "-container", "-content", "-section", "-list", "-body", "-main"])
        if self.draw.random() < 0.15:
            name = "".join(x.capitalize() for x in name.split("-"))
        name = f' {self.draw.choice(["class", "class", "class", "id"])}="{name}"'
        if kind in ROLES and self.draw.random() < 0.2:
            name += f' role="{ROLES[kind]}"'
        return name

    def links(self) -> str:
        n = self.draw.randint(1, 9)
        shape = self.draw.random()
        link = lambda: f'<a href="/{self.draw.randint(0, 99)}">{self.words(1, 4).rstrip(".")}</a>'
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        return self.draw.choice([" ", " | ", " &middot; ", "<br>"]).join(link() for _ in range(n))

    def furniture(self, kind: str) -> str:
        """A part that is no main text, as pages have it: named, or told by its element, its place, its links or what it says."""
        names = self.names(kind)
        # Without a name, the element or what is written there has to tell.
        tag = self.draw.choice(TAGS[kind].split()) if names else TAGS[kind].split()[0]
        said = self.draw.choice(FURNITURE[kind][1].split("|"))
        level = self.draw.choice(["h2", "h3", "h3", "h4", "h5"])
        title = said if not names or self.draw.random() < 0.6 else self.words(1, 4)
        head = self.draw.choice(["", "", f"<{level}>{title}</{level}>", f"<{level}>{title}</{level}>", f"<p>{title}</p>", f"<div>{title}</div>", f"<span>{title}</span> "])
        if not names and TAGS[kind].split()[0] in ("div", "section"):
            head = f"<{level}>{said}</{level}>"
        short, text = self.words(1, 14), self.prose(3, 40)
        body = {
            "menu": self.links, "header": lambda: self.draw.choice([f"<h1>{said}</h1>", f'<a href="/">{short}</a>', f"<p>{short}</p>", self.links()]),
            "footer": lambda: self.draw.choice([f"&copy; {short} &middot; {text}", f"<p>{said}</p>", self.links(), f"{said} {self.links()}"]),
            "sidebar": lambda: self.draw.choice([self.links(), f"<p>{text}</p>", f"<ul><li>{short}</li><li>{self.words(1, 9)}</li></ul>"]),
            "notice": lambda: self.draw.choice([said, f"<p>{said} {short}</p>", f"{said} <button>OK</button>", text if names else said]),
            "ad": lambda: self.draw.choice([short, f"<p>{text}</p>", f'<a href="//x">{short}</a>', f'<img src="a.png"><p>{short}</p>', text]),
            "form": lambda: f'<label>{short}</label><input name="q">' + self.draw.choice(["<button>Go</button>", f"<p>{said}</p>", "<select><option>1</option></select>", ""]),
            "comments": lambda: "".join(self.draw.choice([f"<div{self.names('comments')}><p>{self.prose(2, 50)}</p></div>", f"<li><b>{self.words(1, 2)}</b> {self.prose(2, 40)}</li>", f"<p>{self.prose(2, 50)}</p>", f"<article{self.names('comments')}><p>{self.prose(2, 50)}</p></article>"]) for _ in range(self.draw.randint(1, 5))),
            "share": lambda: self.draw.choice([self.links(), f'<a href="#">{said}</a> <a href="#">{short}</a>', said]),
        }[kind]()
        if tag in ("p", "ul", "ol"):
            body = body if tag != "p" else short if "<" in body else body
            head = "" if tag != "p" else head if head.startswith("<span") else ""
        return f'<{tag}{names} data-main="0">{head}{body}</{tag}>'

    def block(self) -> str:
        """A piece of main text; an article may have short, linked or odd ones too."""
        close = "" if self.unclosed and self.draw.random() < 0.6 else None
        shape, inner = self.draw.random(), self.names("inner") if self.draw.random() < 0.15 else ""
        if shape < 0.68:
            return f"<p{inner}>{self.prose()}" + ("</p>" if close is None else close)
        if shape < 0.74:
            tag = self.draw.choice(["h2", "h3", "h4"])
            return f"<{tag}{inner}>{self.words(1, 8)}</{tag}>"
        if shape < 0.80:
            tag = self.draw.choice(["ul", "ol"])
            return f"<{tag}{inner}>" + "".join(f"<li>{self.prose(1, 15)}" + ("</li>" if close is None else "") for _ in range(self.draw.randint(1, 6))) + f"</{tag}>"
        if shape < 0.84:
            return f"<blockquote{inner}><p>{self.prose()}</p></blockquote>"
        if shape < 0.87:
            return f"<pre{inner}>{self.words(2, 30)}</pre>"
        if shape < 0.90:
            return f'<figure{inner}><img src="x.jpg"><figcaption>{self.words(2, 15)}</figcaption></figure>'
        if shape < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        if shape < 0.95:
            return f"<p><a href=\"/a\">{self.words(1, 9)}</a></p>"
        if shape < 0.98:
            return f"<div{inner}>{self.prose()}</div>"
        return f"<section{inner}><h2>{self.words(1, 6)}</h2><p>{self.prose()}</p><p>{self.prose()}</p></section>"

    def article(self) -> str:
        """The main text in its holder, with other parts put in between."""
        parts = [self.block() for _ in range(self.draw.choice([0, 1, 2, 3, 5, 8, 13, 20]))]
        if self.draw.random() < 0.06:  # one line again and again
            parts += [self.block(), *[f"<p>{self.words(1, 3)}</p>"] * self.draw.randint(20, 150), self.block()]
        if self.draw.random() < 0.8 or not parts:
            title = f"<h1{self.names('inner')}>{self.words(2, 12)}</h1>"
            title = f"<header>{title}{'<p>' + self.words(2, 8) + '</p>' if self.draw.random() < 0.5 else ''}</header>" if self.draw.random() < 0.12 else title
            broken = f"<p><b>{self.prose()}<br>" if self.draw.random() < 0.2 else ""
            parts = [title + broken, *parts]
        for _ in range(self.draw.choice([0, 0, 0, 1, 2, 3])):
            kind = self.draw.choice(["ad", "sidebar", "notice", "form", "share", "comments", "menu", "ad"])
            at = len(parts) if kind == "comments" else self.draw.randint(1, len(parts))
            parts.insert(at, self.furniture(kind))
        return "".join(parts)

    def holder(self) -> str:
        body = self.article()
        if self.flat:
            return body
        if self.semantic:
            tag = self.draw.choice(["article", "article", "article", "main", "main><article"])
            if tag == "main><article":
                return f'<main><article{self.names("holder")} data-main="1">{body}</article></main>'
            return f'<{tag}{self.names("holder")} data-main="1">{body}</{tag}>'
        names = self.names("holder")
        if not names and self.draw.random() < 0.3:
            return f'<div data-main="1">{body}</div>'
        tag = self.draw.choice(["div", "div", "section", "td"]) if names else "div"
        inside = f'<{tag}{names} data-main="1">{body}</{tag}>'
        return f"<table><tr><td><p data-main=\"0\">{self.links()}</p></td>{inside}</tr></table>" if tag == "td" else inside

    def page(self) -> str:
        before = [k for k in ("notice", "header", "menu", "menu", "ad", "form", "sidebar") if self.draw.random() < 0.4]
        after = [k for k in ("share", "sidebar", "sidebar", "comments", "ad", "form", "menu", "notice") if self.draw.random() < 0.3]
        main = self.holder()
        lone = self.draw.random() < 0.06  # nothing but text
        inside = "".join([*map(self.furniture, before), main, *map(self.furniture, after)]) if not lone else f'<div data-main="1">{self.prose()}</div>'
        for _ in range(self.draw.choice([0, 0, 1, 2])):
            inside = f"<div{self.names('wrapper')}>{inside}</div>"
        top = "" if self.draw.random() < 0.5 else self.furniture("menu")
        foot = self.furniture("footer") if self.draw.random() < 0.8 and not lone else ""
        noise = "<script>var t=\"</p>\";</script><style>p{margin:0}</style><!-- a comment -->" if self.draw.random() < 0.5 else ""
        out = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body{' data-main="1"' if self.flat else ''}>{top if not lone else ''}{noise}{inside}{foot}"
        out += "</body></html>" if self.draw.random() < 0.9 else ""
        return out


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    return [Author(seed * 1_000_003 + k).page() for k in range(n)]
