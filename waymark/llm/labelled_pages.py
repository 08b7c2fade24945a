"""Labelled pages to train the block labels of main_text.py on: a bounded, reproducible set.

A page is put together from parts that web pages are known to have, each written in
several of its usual forms and labelled here by hand through data-main: 1 for the
article, 0 for what is not part of it. The words are made up, so that a block is known
by its place and shape and never by its vocabulary.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yi zo an er in on ur th st".split()
MAIN = ['<article data-main="1">', '<main data-main="1">', '<div class="content" data-main="1">', '<div class="post-body entry-content" data-main="1">', '<div id="article-body" data-main="1">',
        '<section class="story text" data-main="1">', '<div class="main"><article class="post" data-main="1">', '<main id="main"><article data-main="1">', '<div class="page"><div class="article" data-main="1">', '<td class="body" data-main="1">']
# What stands beside an article, as (opening tag, kind of content).
BESIDE = {
    "before": [("nav", "menu"), ('nav class="navbar"', "menu"), ('div class="menu"', "menu"), ("header", "head"), ('div id="header"', "head"), ('div class="masthead top"', "head"), ('div class="breadcrumbs"', "menu"),
               ('div class="ad"', "long"), ('div class="advert banner"', "long"), ('div class="ads sponsored"', "long"), ('div class="promo"', "long"), ('div class="cookie-notice"', "notice"), ('div id="consent" role="dialog"', "notice"),
               ('div class="notice alert"', "notice"), ('div class="popup modal"', "notice"), ("form", "form"), ('form class="search"', "form"), ("aside", "side"), ('div class="sidebar"', "side")],
    "after": [("footer", "foot"), ('div id="footer"', "foot"), ('div class="footer copyright"', "foot"), ("aside", "side"), ('aside class="related"', "side"), ('div class="sidebar widget"', "side"), ('div class="related recommended"', "menu"),
              ('section class="comments"', "talk"), ('div id="comments"', "talk"), ('ol class="comment-list"', "talk"), ('div class="comment reply"', "talk"), ('div class="discussion responses"', "talk"), ('div class="newsletter subscribe"', "form"), ("form", "form"),
              ('div class="share social"', "menu"), ('div class="ad"', "long"), ('div class="advertisement"', "long"), ('div class="tags meta"', "menu"), ('div class="legal"', "long"), ("footer", "long"), ('nav class="pagination"', "menu")],
    "inside": [('div class="ad"', "long"), ("aside", "long"), ('aside class="pullquote related"', "menu"), ('div class="share"', "menu"), ("form", "form"), ('div class="newsletter"', "form"), ('section class="comments"', "talk"), ("footer", "menu"), ("nav", "menu")],
}
# What stands inside a line of an article without being a part of it.
IN_LINE = ['span class="ad"', 'span class="advert"', 'span class="sponsored"', 'a class="promo"', 'small class="notice"', 'span class="share"', 'em class="advertisement"', 'b class="newsletter"', "button", "select"]


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 14) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        words[0] = words[0].capitalize()
        return " ".join(words) + self.rng.choice("...!?")

    def prose(self, low: int = 1, high: int = 7) -> str:
        text = " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))
        if self.rng.random() < 0.5:
            return text
        # Articles also hold lists, code, figures, shouting and text without full stops.
        odd = self.rng.randrange(6)
        words = text.rstrip(".!?").split()
        return (text.upper() if odd == 0 else " ".join(w.strip(".!?") for w in words) if odd == 1 else " ".join(w + self.rng.choice(["***", "$$$", "###", "&amp;", "!!", ""]) for w in words) if odd == 2
                else " | ".join(words[:20]) if odd == 3 else f'{self.word()} = "{self.rng.getrandbits(64):x}" {self.rng.getrandbits(40)} {words[0]}' if odd == 4 else " ".join([words[0]] * self.rng.randint(1, 60)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{" ".join(self.word() for _ in range(self.rng.randint(low, high)))}</a>'

    def fill(self, kind: str) -> str:
        pick = self.rng.random()
        if kind == "menu":
            links = [self.link() for _ in range(self.rng.randint(3, 8))]
            return f"<ul>{''.join(f'<li>{x}</li>' for x in links)}</ul>" if pick < 0.6 else " | ".join(links) if pick < 0.8 else "".join(f"<div>{x}</div>" for x in links)
        if kind == "head":
            return f"<h1>{self.word().title()}</h1><p>{self.sentence(2, 6)}</p>" if pick < 0.5 else f"<div>{self.word()}</div>{self.fill('menu')}"
        if kind == "foot":
            return f"&copy; {self.word()} &middot; {self.sentence() if pick < 0.6 else self.word()}" + (self.fill("menu") if pick < 0.3 else "")
        if kind == "side":
            return f"<h3>{self.word().title()}</h3>" + (self.fill("menu") if pick < 0.5 else f"<p>{self.prose(1, 3)}</p>")
        if kind == "talk":
            return "".join(f'<div class="{self.rng.choice(["comment", "reply", "item"])}"><b>{self.word()}</b><p>{self.prose(1, 4)}</p></div>' for _ in range(self.rng.randint(1, 4)))
        if kind == "form":
            return f'<label>{self.word()} {self.word()}</label><input name="q"><p>{self.sentence()}</p><button>{self.word()}</button>'
        if kind == "notice":
            return f"<p>{self.prose(1, 3)}</p><a href='#'>{self.word()}</a>" if pick < 0.6 else self.prose(1, 2)
        return self.prose(1, 3) if pick < 0.6 else f"<p>{self.prose(1, 4)}</p>"

    def beside(self, where: str) -> str:
        opening, kind = self.rng.choice(BESIDE[where])
        return f'<{opening} data-main="0">{self.fill(kind)}</{opening.split()[0]}>'

    def article(self) -> str:
        level = self.rng.choice("112")
        parts = [f"<h{level}>{self.sentence(3, 9)}</h{level}>"] if self.rng.random() < 0.8 else []
        for _ in range(self.rng.randint(1, 12)):
            pick = self.rng.random()
            text = self.prose() if pick < 0.8 else self.sentence(1, 3)
            if self.rng.random() < 0.2:
                text = text.replace(" ", f" {self.link()} ", 1)
            if self.rng.random() < 0.1:
                opening = self.rng.choice(IN_LINE)
                words = text.split(" ")
                words.insert(self.rng.randint(0, len(words)), f'<{opening} data-main="0">{self.prose(1, 2) if self.rng.random() < 0.5 else self.sentence(1, 4)}</{opening.split()[0]}>')
                text = " ".join(words)
            parts.append(f"<p><b>{text}<br>" if pick < 0.1 else f"<p>{text}</p>" if pick < 0.85 else f"<h2>{self.sentence(2, 6)}</h2>" if pick < 0.9
                         else f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>" if pick < 0.95 else f"<blockquote>{text}</blockquote>")
            if self.rng.random() < 0.12:
                parts.append(self.beside("inside"))
        opening = self.rng.choice(MAIN)
        closing = "".join(f"</{x.split()[0].rstrip('>')}>" for x in reversed(opening.split("<")[1:]))
        return opening + "".join(parts) + closing

    def page(self) -> str:
        before = "".join(self.beside("before") for _ in range(self.rng.randint(0, 4)))
        after = "".join(self.beside("after") for _ in range(self.rng.randint(0, 4)))
        head = f"<head><title>{self.sentence(3, 8)}</title><style>p{{margin:0}}</style></head>"
        body = f"{before}{self.article()}{after}"
        body = f"<table><tr>{body}</tr></table>" if "<td" in body else body
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>" if self.rng.random() < 0.8 else f"{head}<body>{body}"


def labelled_pages(count: int = 240, seed: int = 1) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(count)]
