"""Main text of web pages by consensus host paths.

Each page is parsed once; the prose right below each of its containers gives the container's score, and the page votes
for the generalised tag-class path of every container that has prose in blocks.  Votes are counted by host in Spark.
Then every page is extracted again: the winning path that it has most prose under says where the article is, or else the
page's own best container.  An article or main element around that is taken whole.  Where there is none, the article is
all containers with winning paths (on a host with one page, all that have prose in blocks).

What is left out: elements that are never text; navigation, footers, asides, forms and the like by their tags; hidden
elements; containers whose class, id or role is made of words for boilerplate ("cookie-notice", "sidebar left").  A name
that only contains such a word ("search-results", "notice-of-award") leaves its container out if that is mostly links, and
one that says what a container goes with ("no-sidebar", "has-share-buttons") says nothing.  If names would leave nothing of
a page, they don't count on it, but for text that stands in no block.

A path that one page of a host votes for could only serve that page, which has its own best container; all paths with
two votes or more are kept.  Only the lists that differ from the most usual one are sent to the second pass: broadcast if
they are small (their bytes are summed), else joined by host, where Spark may split a host with very many pages.

Defined results.  A null or empty page has the empty text.  Malformed, unclosed and very long markup is read to its
end.  A null or odd url makes a host of its own ("").  Repeated pages vote each.  An empty table gives an empty table.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.shared import cut, small_batches

#: Lists of winning paths are broadcast up to so many bytes.
MOST_BROADCAST = 16 << 20

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_OWNERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot table ul ol dl figure figcaption caption address hgroup details summary center".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset datalist audio video canvas head".split())
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs byline comment comments commentlist consent
    cookie cookies copyright disclaimer disqus dropdown footer foot gdpr hidden login masthead menu menubar modal nav navbar navigation
    newsletter notice notification overlay pager pagination popup print promo promotion related respond share sharing sidebar signup social
    sponsor sponsored subscribe subscription tags toolbar topbar widget widgets contentinfo complementary search replies reply discussion""".split()
)
# Words that go with those for boilerplate, words for an article's own parts, and words that say what a
# container has beside it.
PLACE_WORDS = frozenset(
    """area bar bars block body bottom box button buttons col column container content count desktop fixed form global group holder icon icons inner item items left link links
    list main mobile module outer page panel post posts primary region right row secondary section shell site slot sticky text top unit wrap wrapper""".split()
)
ARTICLE_WORDS = frozenset("article body content entry main page post prose story text".split())
BESIDE_WORDS = frozenset("has have is no not with without".split())
PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td figcaption".split())
_TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@functools.lru_cache(100_000)
def named(value: str) -> tuple[int, str]:
    """How a class, id or role marks its element (0 not, 1 perhaps, 2 as boilerplate), and its words without numbers."""
    tokens = re.sub(r"\d+", "#", re.sub(r"([a-z])([A-Z])", r"\1-\2", value)).lower().split()
    mark, own = 0, False
    for token in tokens:
        parts = [x for x in re.split(r"[-_#:]+", token) if x]
        bad = [x in BOILER_WORDS for x in parts]
        if "".join(parts) in BOILER_WORDS or any(bad) and all(b or x in PLACE_WORDS for x, b in zip(parts, bad, strict=True)):
            mark = 2
        elif any(bad) and not BESIDE_WORDS & set(parts):
            mark = max(mark, 1)
        own |= len(parts) == 1 and parts[0] in ARTICLE_WORDS
    return min(mark, 1) if own else mark, ".".join(sorted(set(tokens)))


class Page:
    """The containers of a page with their paths, and its blocks of text with the container each is in."""

    def __init__(self, markup: str):
        # For each container: parent, path, tag, whether its tag or style leaves it out, how its names mark it.
        self.parent, self.path, self.tag, self.out, self.mark = [-1], [""], [""], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(markup)
        self.boiler = self._boiler(True)
        if not any(not self.boiler[k] for k, _, _ in self.blocks):
            self.boiler = self._boiler(False)

    def _boiler(self, by_name: bool) -> list[bool]:
        """For each container whether it is left out, by itself or with one around it."""
        size, linked, prose = ([0] * len(self.tag) for _ in range(3))
        for node, words, links in self.blocks:
            size[node] += len(words)
            linked[node] += links
            prose[node] += self.tag[node] in PROSE_TAGS
        for k in range(len(self.tag) - 1, 0, -1):  # children come after their parents
            for total in (size, linked, prose):
                total[self.parent[k]] += total[k]
        boiler = []
        for k, up in enumerate(self.parent):
            named = self.mark[k] == 2 and (by_name or not prose[k]) or self.mark[k] and 2 * linked[k] > size[k]
            boiler.append(bool(self.out[k] or named or up >= 0 and boiler[up]))
        return boiler

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        top = stack[-1]
        label, out, mark = tag, tag in BOILER_TAGS, 0
        out |= tag == "header" and not any(self.tag[k] in ("article", "main") for k in stack)
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                out = True
            elif name in ("class", "id", "role"):
                how, words = named(value)
                mark = max(mark, how)
                if name == "class" and words:
                    label += "." + words
        self.parent.append(top)
        self.path.append(f"{self.path[top]}>{label}")
        self.out.append(out)
        self.mark.append(0 if tag in ("body", "html", "article", "main") else mark)
        self.tag.append(tag)
        stack.append(len(self.tag) - 1)

    def _read(self, markup: str) -> None:
        stack, at, text, linked, links = [0], 0, [], 0, 0
        size = len(markup)

        def add(part: str) -> None:
            nonlocal linked
            if part:
                part = html.unescape(part) if "&" in part else part
                text.append(part)
                if links:
                    linked += len(part.strip())

        def flush() -> None:
            nonlocal linked
            if text:
                words = " ".join("".join(text).split())
                if words:
                    self.blocks.append((stack[-1], words, linked))
                text.clear()
            linked = 0

        while at < size:
            found = _TAG.search(markup, at)
            if not found:
                add(markup[at:])
                break
            add(markup[at : found.start()])
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, closing = tag.lower(), bool(found[1] or found[4])
            if tag in RAW and not closing:
                if tag not in INLINE:
                    text.append(" ")
                if not (found[3] or found[6] or "").endswith("/"):
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(markup, at)
                    at = (markup.find(">", end.start()) + 1 or size) if end else size
            elif tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                text.append("\n")
            elif tag in INLINE or tag in RAW:
                continue
            elif tag in VOID:
                if tag == "hr":
                    flush()
            elif closing:
                flush()
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        del stack[k:]
                        break
            else:
                flush()
                ends = {"p"} if tag in ENDS_P else SAME_ENDS.get(tag, ())
                for k in range(len(stack) - 1, 0, -1):
                    here = self.tag[stack[k]]
                    if here in ends:
                        del stack[k:]
                        break
                    if here not in BLOCK_OWNERS or here in ("ul", "ol", "dl", "table"):
                        break
                self._open(stack, tag, found[3] or found[6] or "")
        flush()

    def owner(self, node: int) -> int:
        """The nearest container that isn't a paragraph, heading, list, table or a part of one."""
        while node and self.tag[node] in BLOCK_OWNERS:
            node = self.parent[node]
        return node

    def scores(self) -> dict[int, float]:
        """Prose by container: characters outside links right below it count whole, and half as much one container up."""
        out: dict[int, float] = defaultdict(float)
        for node, words, linked in self.blocks:
            if not self.boiler[node]:
                own = self.owner(node)
                worth = max(0, len(words) - 2 * linked)
                out[own] += worth
                if own:
                    out[self.owner(self.parent[own])] += worth / 2
        return out

    def best(self) -> int:
        scores = self.scores()
        return max(scores, key=lambda k: (scores[k], self.tag[k] in ("article", "main"), -k), default=-1)

    def content(self) -> set[int]:
        """The containers that own blocks of prose which aren't mostly links."""
        return {self.owner(node) for node, words, linked in self.blocks if not self.boiler[node] and self.tag[node] in PROSE_TAGS and 2 * linked < len(words)}

    def whole(self, node: int) -> int:
        """The nearest article or main around a container, or -1."""
        while node >= 0 and self.tag[node] not in ("article", "main"):
            node = self.parent[node]
        return node

    def regions(self, winners: dict[str, int]) -> set[int]:
        """The containers that hold the article; ``winners`` are the host's paths with their ranks."""
        scores: dict[str, float] = defaultdict(float)
        for k, x in self.scores().items():
            if self.path[k] in winners:
                scores[self.path[k]] += x / (2 + winners[self.path[k]])
        if max(scores.values(), default=0) > 0:
            path = max(scores, key=lambda p: (scores[p], -winners[p]))
            found = {k for k in range(len(self.tag)) if self.path[k] == path}
        else:
            found = {k} if (k := self.best()) >= 0 else set()
        wholes = {w for k in found if (w := self.whole(k)) >= 0}
        return wholes or found | {k for k in self.content() if not winners or self.path[k] in winners}

    def text(self, winners: dict[str, int]) -> str:
        """The blocks of the article in page order, without what is left out."""
        tops, inside = self.regions(winners), [False] * len(self.tag)
        for k, up in enumerate(self.parent):
            inside[k] = k in tops or up >= 0 and inside[up]
        return "\n".join(words for k, words, _ in self.blocks if inside[k] and not self.boiler[k])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, best): each page's containers with prose in blocks and its best one, a path once a page."""

    def of(batches):
        for part in batches:
            rows = []
            for host, markup in zip(part["host"], part["html"], strict=True):
                page = Page(markup or "")
                best = page.best()
                paths = {page.path[k] for k in page.content() | ({best} if best >= 0 else set())}
                rows += [(host, p, int(best >= 0 and p == page.path[best])) for p in paths]
            yield pd.DataFrame(rows, columns=["host", "path", "best"])

    return pages.select("host", "html").mapInPandas(of, "host string, path string, best long")


def winners(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths that two pages or more of the host vote for, those that are most often best first."""
    counted = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("best").alias("best")).filter("n > 1")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("best"), (-F.col("n")).alias("n"), F.col("path"))))
    return cut(counted.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("paths")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string"))
    won = winners(rows)
    usual = won.groupBy("paths").count().orderBy(F.desc("count"), "paths").limit(1).collect()
    default = list(usual[0].paths) if usual else []
    # A host without winners is told from one with the usual ones by an empty list.
    hosts = rows.select("host").distinct().join(won, "host", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    odd = cut(hosts.filter(F.col("paths") != F.array(*map(F.lit, default)).cast("array<string>")))
    size = odd.agg(F.sum(F.length("host") + F.length(F.array_join("paths", "")) + 64)).first()[0] or 0
    odd = F.broadcast(odd) if size <= MOST_BROADCAST else odd

    def of(batches):
        ranks = functools.lru_cache(4096)(lambda paths: {p: k for k, p in enumerate(paths)})
        for part in batches:
            texts = [Page(markup or "").text(ranks(tuple(default if paths is None else paths))) for markup, paths in zip(part["html"], part["paths"], strict=True)]
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = rows.join(odd, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInPandas(of, "page_id long, url string, text string, n_chars long")
