"""An allow-list sanitiser for dictionary and page markup."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWED = frozenset("b i em strong sup sub span p br ul ol li dl dt dd div small cite q a".split())
ATTRIBUTES = {"a": ("href",), "span": ("class", "lang"), "div": ("class",)}
DROPPED = frozenset("script style iframe object embed template noscript head title svg math".split())


class _Sanitiser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skip = 0

    def parse_marked_section(self, i, report=1):
        """What begins with "<![" is no markup of HTML: it goes, up to its end."""
        return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += tag != "embed"
        elif not self.skip and tag in ALLOWED:
            keep = [(k, v or "") for k, v in attrs if k in ATTRIBUTES.get(tag, ())]
            keep = [(k, v) for k, v in keep if k != "href" or v.strip().lower().startswith(("http://", "https://", "#", "/"))]
            self.out.append("<" + tag + "".join(f' {k}="{html.escape(v)}"' for k, v in keep) + ">")
            if tag != "br":
                self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        if tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            if tag != "br":
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            while self.open:
                t = self.open.pop()
                self.out.append(f"</{t}>")
                if t == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.out.append(html.escape(data, quote=False))


def sanitise(s: str) -> str:
    """Allowed tags with allowed attributes, balanced; everything else is text or gone."""
    p = _Sanitiser()
    p.feed(s)
    p.close()
    return "".join([*p.out, *(f"</{t}>" for t in reversed(p.open))])


def sanitise_html(c: Column) -> Column:
    def g(s: pd.Series) -> pd.Series:
        return s.map(sanitise, na_action="ignore")

    return F.pandas_udf(g, "string")(c)


def unsafe(c: Column) -> Column:
    """Whether markup that the sanitiser never leaves is there."""
    return F.coalesce(c.rlike(r"(?i)<(script|style|iframe|object|embed)\b|\son\w+\s*=\s*[\"']|javascript:"), F.lit(False))


def decode_entities(c: Column) -> Column:
    def g(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.pandas_udf(g, "string")(c)
