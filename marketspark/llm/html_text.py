"""Main text of web pages: page structure first, then runs repeated across pages of a host."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import let
from marketspark.sources.snapshot import materialize

RUN = 8  # words a run must have to count as repeated
SHARE = 30  # percent of a host's distinct pages a run must stand on, and two at least
# Elements and names that mark what is not main text, and elements inside a block.
CHROME = {"nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "head", "button", "select", "textarea", "svg", "dialog"}
HINT = r"(?:ads?|advert\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu|header|footer|sidebar|comments?|cookies?|notice|banner|consent|related|share|social|breadcrumbs?|newsletter|subscribe|popup|modal)"
HINTS = re.compile(rf"{HINT}(?:[_-]+{HINT})*", re.I)  # whole names; a compound one counts if all its parts do
FREE, FORM, HINTED = 0, 1, 2  # grades of a block by what holds it
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(?!["'])([^\s>]*+)))?+""")
TAG_END = re.compile(r"[\s/]*+>")
COMMENT_END = re.compile(r"--!?>")
SPACES = re.compile(r"[\x20\t\n\v\f\r ]+")


class _Blocks:
    """Collects ``(inside article, grade, text)`` blocks that no chrome element holds.

    A form or a hinted element marks what it holds, with grade FORM or HINTED. An article, main or
    role=main element lifts the mark and keeps the grade; within it such elements are chrome.

    A page is read once from left to right. Where markup never ends (an open comment, tag or
    attribute value), the rest of the page belongs to it, as in a browser; declarations and other
    marked sections end at the next >. So a page of any form takes time in proportion to its length.
    """

    def __init__(self):
        self.open: list[tuple[str, bool, int, bool]] = []
        self.named: Counter[str] = Counter()
        self.blocks: list[tuple[bool, int, str]] = []
        self.parts: dict[tuple[bool, int], list[str]] = {}

    def feed(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            sign = html.find("<", at)
            if sign < 0:
                sign = end
            if sign > at:
                self.handle_data(unescape(html[at:sign]))
            if sign == end:
                return
            closes = html.startswith("</", sign)
            name = NAME.match(html, sign + 1 + closes)
            if name:
                at = self.tag(html, name, closes)
            elif html.startswith("<!--", sign):
                # Comments may also end in the two characters they begin with.
                short = next((n for n in (5, 6) if html[sign + 4 : sign + n] in (">", "->")), 0)
                found = None if short else COMMENT_END.search(html, sign + 4)
                at = sign + short if short else found.end() if found else end
            elif closes or html.startswith(("<!", "<?"), sign):
                at = html.find(">", sign) + 1 or end
            else:
                self.handle_data("<")
                at = sign + 1

    def tag(self, html: str, name: re.Match, closes: bool) -> int:
        """Read a tag from its name on; where the page goes on after it."""
        at, values = name.end(), {}
        while not (over := TAG_END.match(html, at)):
            found = ATTRIBUTE.match(html, at)
            if not found:
                return len(html)  # the page ends inside the tag
            key, double, single, plain = found.groups()
            values.setdefault(key.lower(), unescape(double or single or plain or ""))
            at = found.end()
        tag, at = name.group().lower(), over.end()
        if closes:
            self.handle_endtag(tag)
            return at
        self.handle_starttag(tag, values)
        if over.group().endswith("/>"):
            self.handle_endtag(tag)
        elif tag in RAW:
            last = RAW[tag].search(html, at)
            raw = html[at : last.start() if last else len(html)]
            self.handle_data(unescape(raw) if tag in ("textarea", "title") else raw)
            return last.start() if last else len(html)
        return at

    def flush(self):
        for (article, grade), parts in self.parts.items():
            text = SPACES.sub(" ", "".join(parts)).strip(" ")
            if text:
                self.blocks.append((article, grade, text))
        self.parts = {}

    def handle_starttag(self, tag, values):
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        chrome, grade, held = self.open[-1][1:] if self.open else (False, FREE, False)
        article = held or tag in ("article", "main") or values.get("role") == "main"
        names = f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}".split()
        hinted = article == held and tag not in ("html", "body") and any(HINTS.fullmatch(x) and not (article and x.lower() == "header") for x in names)
        inner_header = tag == "header" and article  # an article's own heading
        chrome = chrome or (tag in CHROME - {"form"} and not inner_header) or "hidden" in values
        if held:
            chrome = chrome or tag == "form" or hinted
        elif hinted:
            grade = HINTED
        elif tag == "form":
            grade = max(grade, FORM)
        self.open.append((tag, chrome, grade, article))
        self.named[tag] += 1

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        while self.named[tag]:
            name = self.open.pop()[0]
            self.named[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        _, chrome, grade, article = self.open[-1] if self.open else ("", False, FREE, False)
        if not chrome:
            self.parts.setdefault((article, grade), []).append(data)


def blocks_of(html: str | None) -> list[tuple[bool, str]]:
    """``(inside article, text)`` of the page's blocks that are not furniture.

    Articles that nothing holds come first, then those in forms, then those in hinted elements, so
    comments or teasers marked as articles do not join a page's own. On a page without articles, what
    forms hold is text if it has more words than the rest: then the form is the page's wrapper.
    """
    parser = _Blocks()
    parser.feed(html or "")
    parser.flush()
    for grade in (FREE, FORM, HINTED):
        sure = [(True, t) for article, g, t in parser.blocks if article and g == grade]
        if sure:
            return sure
    count = lambda grade: sum(len(t.split(" ")) for _, g, t in parser.blocks if g == grade)
    grades = (FREE, FORM) if count(FORM) > count(FREE) else (FREE,)
    return [(False, t) for _, g, t in parser.blocks if g in grades]


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for i, u, h in zip(batch["page_id"], batch["url"], batch["html"]):
                found = blocks_of(h)
                sure = any(inside for inside, _ in found)
                try:
                    host = urlsplit(u or "").netloc.lower()
                except ValueError:
                    host = ""
                rows.append((i, u, host, sure, [t for inside, t in found if inside == sure]))
            out = pd.DataFrame(rows, columns=["page_id", "url", "host", "sure", "blocks"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, host string, sure boolean, blocks array<string>")


def _beginnings() -> Column:
    """The suffixes of a page that begin with a block, by their first RUN words."""
    ahead = lambda text: F.call_function("substring_index", text, F.lit(" "), F.lit(RUN))
    short = lambda texts: F.transform(texts, lambda t, b: ahead(F.array_join(F.slice(texts, b + 1, RUN), " ")))
    whole = F.filter(let(F.transform("blocks", ahead), short), lambda t: F.size(F.split(t, " ")) == RUN)
    return F.array_distinct(F.transform(whole, lambda t: F.xxhash64(t)))


def _furniture(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(host, sure, suffix)`` of ``runs``, a row per page and suffix, that stand on enough of the host's pages."""
    often = runs.groupBy("host", "sure", "suffix").agg(F.count("*").alias("times")).where("times > 1").join(sizes, ["host", "sure"])
    most = (F.col("times") > 2) & (2 * F.col("times") > F.col("pages"))
    return often.where(F.when(F.col("sure"), most).otherwise(100 * F.col("times") >= SHARE * F.col("pages"))).select("host", "sure", "suffix")


def _led(found: DataFrame) -> DataFrame:
    """``found`` without the suffixes of articles that do not follow, one by one, on one that begins with a block."""
    page = Window.partitionBy("page_key")
    chain = found.where("sure").withColumn("chain", F.col("i") - F.row_number().over(page.orderBy("i")))
    led = F.max("begins").over(Window.partitionBy("page_key", "chain").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return chain.withColumn("led", led).where("led").drop("chain", "led").unionByName(found.where("not sure"))


def _without(tokens: DataFrame, cut: DataFrame) -> DataFrame:
    """``(page_key, sure, loose_text, gone)``: the words of ``tokens`` that no run starting at ``cut`` covers, a line
    per block, and how many words that leaves out. An article loses whole blocks only."""
    starts = cut.groupBy("page_key").agg(F.collect_set("i").alias("starts"))
    covered = F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<int>")), lambda s: F.sequence(s, s + RUN - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ws") - 1), covered)
    starts_of = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.get("ws", i)["begins"])
    stay = lambda places: F.array_distinct(F.transform(places, lambda i: F.get("ws", i)["block"]))
    places_of = lambda b, first: F.sequence(F.get(first, b), F.coalesce(F.get(first, b + 1), F.size("ws")) - 1)
    whole = let(starts_of, lambda first: F.flatten(F.transform(stay(kept), lambda b: places_of(b, first))))
    left = F.transform(F.when(F.col("sure"), whole).otherwise(kept), lambda i: F.get("ws", i))
    ahead = lambda x, before: F.when(before.isNull(), "").when(before["block"] < x["block"], "\n").otherwise(" ")
    text = lambda ws: F.array_join(F.transform(ws, lambda x, i: F.concat(ahead(x, F.get(ws, i - 1)), x["w"])), "")
    out = let(left, lambda ws: F.struct(text(ws).alias("loose_text"), (F.size("ws") - F.size(ws)).alias("gone")))
    return tokens.join(starts, "page_key", "left").select("page_key", "sure", F.size("ws").alias("n"), out.alias("out")).select("page_key", "sure", "n", "out.*")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` per row of ``pages``; null and empty pages have an empty text.

    The blocks of a page are those inside its article or, without one, its loose blocks; the two
    kinds of pages of a host are compared each among themselves. The suffixes of a page's words, all
    its blocks in a row, are keyed by their first RUN words, as in a suffix array cut to that depth:
    the union of such windows is the union of all longer repeated substrings, also of those that
    cross blocks. Equal contents of a host are one page. A run is furniture, and the words it covers
    go, if it stands on SHARE percent of the host's pages, two at least, counted by the different
    texts that are left of them without such runs: copies of an article leave nothing or the same.

    In articles a run also begins with a block, stands on more than half of the host's article
    pages, three at least, and only blocks that runs cover whole go. A page of which runs would take
    half of the words or more is a copy: it stays whole and does not count. So quoted passages and
    copies of one article stay. Suffixes that begin with a block are counted first, and only pages
    that have one on enough pages send the rest of theirs.

    Pages without a host are not cut. Suffixes are counted before they are shuffled, so a host or a
    run of any size never meets in one task. Other runs of a block stay, in page order.
    """
    key = F.md5(F.concat_ws("\n", "host", F.col("sure").cast("string"), "blocks"))
    parsed = materialize(_parsed(pages).withColumn("page_key", key), "html-parsed")
    known = parsed.where((F.size("blocks") > 0) & (F.col("host") != ""))
    begun = materialize(known.where("sure").select("page_key", "host", "sure", _beginnings().alias("begun")).dropDuplicates(["page_key"]), "html-begun")
    loose = known.where("not sure").select("page_key", "host", "sure", "blocks").dropDuplicates(["page_key"])
    count = lambda streams: streams.groupBy("host", "sure").agg(F.count("*").alias("pages"))
    sizes = materialize(count(begun), "html-sites")
    begins = begun.select("page_key", "host", "sure", F.explode("begun").alias("suffix"))
    common = materialize(_furniture(begins, sizes), "html-common")
    articles = materialize(begins.join(common, ["host", "sure", "suffix"]).select("page_key").distinct(), "html-articles")
    articles = known.where("sure").select("page_key", "host", "sure", "blocks").join(articles, "page_key").dropDuplicates(["page_key"])

    split = F.transform("blocks", lambda t, b: F.transform(F.split(t, " "), lambda w, i: F.struct(w.alias("w"), b.alias("block"), (i == 0).alias("begins"))))
    tokens = materialize(loose.union(articles).select("page_key", "host", "sure", F.flatten(split).alias("ws")), "html-tokens")
    sizes = materialize(sizes.union(count(tokens.where("not sure"))), "html-hosts")
    at = lambda w, i: F.struct(F.get(w["begins"], i).alias("begins"), F.xxhash64(F.slice(w["w"], i + 1, RUN)).alias("suffix"))
    keys = let(F.col("ws"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: at(w, i)))
    suffixes = tokens.where(F.size("ws") >= RUN).select("page_key", "host", "sure", F.posexplode(keys).alias("i", "at")).select("page_key", "host", "sure", "i", "at.*")
    each = tokens.where(F.size("ws") >= RUN).select("host", "sure", F.explode(F.array_distinct(keys["suffix"])).alias("suffix"))
    wide = materialize(_furniture(each, sizes), "html-wide")
    found = _led(materialize(suffixes.join(wide, ["host", "sure", "suffix"]), "html-found"))
    rest = materialize(_without(tokens, found).where("loose_text <> '' and gone > 0 and (not sure or 2 * gone < n)").select("page_key", F.md5("loose_text").alias("rest")), "html-rest")
    counted = found.join(rest, "page_key")
    cut = _furniture(counted.select("host", "sure", "suffix", "rest").distinct(), sizes)
    cut = materialize(cut, "html-furniture")
    own = found.where("not sure").unionByName(counted.where("sure").drop("rest"))
    cut = _led(own.join(cut, ["host", "sure", "suffix"])).select("page_key", "i")
    texts = materialize(_without(tokens, cut).where("gone > 0").select("page_key", "loose_text"), "html-texts")
    return parsed.join(texts, "page_key", "left").select("page_id", "url", F.coalesce("loose_text", F.array_join("blocks", "\n")).alias("text"))


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
