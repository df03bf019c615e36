"""Extraction from HTML: expressions for simple tags, and parsers for listing and detail pages in pandas UDFs."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import ws_normalize

EMPTY_MARK = "Không tìm thấy"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def title(html: Column) -> Column:
    return ws_normalize(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return ws_normalize(F.regexp_replace(bare, r"<[^>]+>", " "))


def is_empty_page(html: Column) -> Column:
    return html.contains(EMPTY_MARK)


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def has(self, *classes: str) -> bool:
        return set(classes) <= set(self.attrs.get("class", "").split())

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def texts(self) -> list[str]:
        out: list[str] = []
        for c in self.children:
            out += c.texts() if isinstance(c, Node) else [c.strip()]
        return [t for t in out if t]

    def find(self, test) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def sibling(self, test) -> Node | None:
        """The next element after this one that passes."""
        own = self.parent.children if self.parent else []
        after = own[next((i for i, c in enumerate(own) if c is self), len(own)) + 1:]
        return next((c for c in after if isinstance(c, Node) and test(c)), None)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


def _clean(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").split())


def parse_listing(html: str, base: str = "") -> list[dict]:
    """Companies of a listing page. Items without a tax code of 9 digits at least are left out."""
    out = []
    for item in (n for n in tree(html).walk() if n.tag == "div" and n.has("company-item")):
        head = item.find(lambda n: n.tag == "h3" and n.has("company-name"))
        link = head and head.find(lambda n: n.tag == "a")
        if not link:
            continue
        text = " ".join(item.texts())
        code = re.search(r"Mã số thuế:\s*(\d+)", text)
        if not code or len(code[1]) < 9:
            continue
        address = re.search(r"Địa chỉ:\s*(.*?)(?:$|Mã số thuế|Đại diện)", text)
        where = address[1] if address else text.split("Địa chỉ:")[-1] if "Địa chỉ:" in text else ""
        href = link.attrs.get("href", "")
        url = href if href.startswith("http") else base + href if href.startswith("/") else f"{base}/{href}"
        out.append({"company_name": _clean("".join(link.texts())), "tax_code": code[1], "address": _clean(where), "url": url})
    return out


#: Fields of a detail page: where microdata names them, and the labels of table cells before them.
MICRODATA = {"representative": ("founder", "name"), "phone": ("telephone",)}
LABELS = {"Tình trạng hoạt động": "status", "Ngày cấp": "founded_date"}
CELL, HEAD, CODE_TITLE = "responsive-table-cell", "responsive-table-cell-head", "Mã"


def _said(node: Node | None) -> str | None:
    return _clean("".join(node.texts())) if node else None


def parse_detail(html: str) -> dict:
    """Representative, phone, status, founding date and industries of a detail page."""
    root = tree(html)
    out: dict = dict.fromkeys([*MICRODATA, *LABELS.values()])
    for field, props in MICRODATA.items():
        node: Node | None = root
        for prop in props:
            node = node and node.find(lambda n, prop=prop: n.attrs.get("itemprop") == prop)
        out[field] = _said(node)
    heads = [(n, n.sibling(lambda x: x.has(CELL))) for n in root.walk() if n.has(HEAD)]
    for head, value in heads:
        field = next((f for label, f in LABELS.items() if label in "".join(head.texts())), None)
        if field and value:
            out[field] = _said(value)
    table = root.find(lambda n: n.has("nnkd-table"))
    rows = [(_said(n), n.sibling(lambda x: x.tag == "div" and x.has(CELL))) for n in table.walk() if n.has(CELL, HEAD)] if table else []
    return out | {"industries_detail": [{"code": c, "name": _said(x)} for c, x in rows if c and c != CODE_TITLE and x]}


#: Reviews of a company that are read.
REVIEWS = 10


def parse_reviews(html: str, most: int = REVIEWS) -> dict:
    """The address (URL-decoded) of a review page, and title and content of its first reviews."""
    root = tree(html)
    place = root.find(lambda n: n.has("location") and "data-location" in n.attrs)
    items = [n for n in root.walk() if n.has("content-of-review")][:most]
    head = lambda n: n.find(lambda x: x.tag == "h3")
    return {"company_address": unquote_plus(place.attrs["data-location"]) if place else "",
            "reviews": [{"title": "".join(h.texts()) if (h := head(n)) else "", "content": "".join(n.texts())} for n in items]}


COMPANY_ITEMS = "array<struct<company_name:string,tax_code:string,address:string,url:string>>"
DETAIL = "struct<representative:string,phone:string,status:string,founded_date:string,industries_detail:array<struct<code:string,name:string>>>"


REVIEW_PAGE = "struct<company_address:string,reviews:array<struct<title:string,content:string>>>"


def _listing(pages: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([parse_listing(h, b or "") for h, b in zip(pages, bases)], dtype=object)


def _detail(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_detail(h) for h in pages], columns=["representative", "phone", "status", "founded_date", "industries_detail"])


def _reviews(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_reviews(h) for h in pages], columns=["company_address", "reviews"])


def listing(html: Column, base: Column) -> Column:
    """The companies of listing pages."""
    return F.pandas_udf(_listing, COMPANY_ITEMS)(html, base)


def detail(html: Column) -> Column:
    """The fields of detail pages."""
    return F.pandas_udf(_detail, DETAIL)(html)


def review_page(html: Column) -> Column:
    """Address and first reviews of review pages."""
    return F.pandas_udf(_reviews, REVIEW_PAGE)(html)
