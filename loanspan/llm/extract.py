"""Main text of web pages by equivalence-class template deduction.

Markup tokens are told apart by their path of enclosing elements. On the pages of one host, tokens
that occur equally often on every page have equal occurrence vectors and form an equivalence
class; classes of two or more tokens on at least half of the pages, with each element's start and
end in order inside one class, are the host's template, nested by path. The article lies in the
slot of one template element; what remains of that slot without boilerplate elements is the text.
A block inside is a token by path and wording too. One in the class of the article's element, once
on each of its pages like itself, is the site's and not the article's; paragraphs, lists and headings
that are in no such block stay.

Elements are boilerplate by name or by words of class, id or role. A page's frame, articles and
headings never are by words, an element with as much of the host's text as a container never is by
words or as a form, and a label with other words besides counts only on the host's template.

Occurrence vectors never exist: two sums of a hash of (page, count) stand for them, so a host with
a third of all pages is summed on the map side like any other and nothing is gathered by host.
"""

from __future__ import annotations

import html as markup
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import text_of, written

#: Least share of a host's text that lies in an element taken for the article's container.
CONTAINER_PERCENT = 60
#: Pages on which a block must be to count as the site's, and the share of a page's text that is left
#: at least; with less left the pages are copies of each other, and nothing is taken away.
SITE_TEXT_PAGES = 5
LEFT_PERCENT = 50
#: Tokens held at once while counting.
HELD_TOKENS = 200_000
#: Hosts, one id each, whose templates are broadcast at most; more are joined by shuffle.
BROADCAST_HOSTS = 200_000

#: Fixed values of HTML: raw-text elements, void elements, elements that end a line of text.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that are never part of an article, by name and by a word of class, id or role; a form
#: is one unless it holds the text.
ASIDE = {"nav", "footer", "aside", "button", "select", "menu", "dialog", "head", "object", "canvas"} | RAW
FORM = "form"
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored",
    "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "respond",
    "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe",
    "subscription", "signup", "login", "search", "widget", "complementary", "contentinfo", "pagination",
}
#: Elements and words of a site's header, which are part of an article inside its container.
HEADER, HEADER_WORDS = {"header"}, {"header", "masthead"}
#: Elements that can be a container besides article and main.
CONTAINERS = {"div", "section", "main", "article", "td", "table", "center", "body", "html"}
#: Elements that words do not make boilerplate.
KEPT = {"html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
ARTICLE, ARTICLE_ROLES = {"article", "main"}, {"main", "article"}

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_LABEL = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: An open <p> ends where one of these begins.
_ENDS_P = BLOCKS - {"br", "option", "body", "html", "head"}


class Element:
    __slots__ = ("aside", "by_name", "first", "header", "is_article", "mass", "name", "soft", "token", "wording")

    def __init__(self, name: str, attributes: str, parent: Element | None, exceptions=frozenset()):
        found = [(k.lower(), (b or c or d).lower()) for k, b, c, d in _LABEL.findall(attributes)] if attributes else []
        labels = " ".join(v for _, v in found)
        words = set(_WORD.findall(labels))
        self.name = name
        path = parent.token if parent else 0
        stable = re.sub(r"\d+", "0", labels)
        self.token = xxhash.xxh3_64_intdigest(f"{path} {name} {stable}".encode("utf-8", "replace")) >> 1
        self.by_name = name in ASIDE or name in HEADER
        aside, header = bool(words & ASIDE_WORDS), bool(words & HEADER_WORDS)
        # A label of listed words only; the id of a section is a mark in the text.
        sure = (aside or header) and any(
            part <= ASIDE_WORDS | HEADER_WORDS
            for k, v in found if k != "id" or name != "section"
            for part in map(set, map(_WORD.findall, v.split())) if part
        )
        #: None, or whether the host's exceptions turn it from boilerplate (True) or to it (False).
        self.soft = None
        if name == FORM:
            self.soft, aside, header = True, True, False
        elif (aside or header) and name not in KEPT and not self.by_name:
            self.soft = sure
        on = self.soft is not None and self.soft != (self.token in exceptions)
        self.aside = name in ASIDE or (on and aside)
        self.header = name in HEADER or (on and header and not aside)
        self.is_article = not self.aside and not (sure and aside) and (
            name in ARTICLE or bool(ARTICLE_ROLES & set(labels.split()) and "role" in attributes.lower())
        )
        self.mass = 0
        self.wording = 0

    @property
    def end(self) -> int:
        """Token of the element's end tag."""
        return self.token ^ 1


def events(page: str, exceptions=frozenset()):
    """(text, None, stack), ("", element, stack) at starts and (None, element, stack) at ends, in
    page order. Unclosed elements end with an ancestor; end tags without start are ignored."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        match = _PART.search(page, at)
        if match is None:
            yield page[at:], None, stack
            break
        if match.start() > at:
            yield page[at : match.start()], None, stack
        at = match.end()
        if match.group(2) is None:
            continue
        name = match.group(2).lower()
        if match.group(1):
            if any(e.name == name for e in stack):
                while True:
                    element = stack.pop()
                    yield None, element, stack
                    if element.name == name:
                        break
            continue
        if name in _ENDS_P and stack and any(e.name == "p" for e in stack):
            # Inline elements left open inside the paragraph end with it.
            inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p")
            if not any(e.name in BLOCKS for e in stack[inner + 1 :]):
                while len(stack) > inner:
                    yield None, stack.pop(), stack
        if name == "li" and stack and stack[-1].name == "li":
            yield None, stack.pop(), stack
        attributes = match.group(3) or ""
        element = Element(name, attributes, stack[-1] if stack else None, exceptions)
        yield "", element, stack
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            continue
        stack.append(element)


def _outside(stack: list[Element]) -> bool:
    return any(e.aside or e.header for e in stack)


def doubtful(page: str) -> dict[int, list]:
    """Text inside each element that words or a form make boilerplate, and whether they do without
    the template. Token 0 is the page."""
    found: dict[int, list] = {0: [0, False]}
    for text, element, stack in events(page):
        if element is None:
            if not any(e.by_name for e in stack):
                size = len(text.strip())
                found[0][0] += size
                for token in {e.token for e in stack if e.soft is not None}:
                    found[token][0] += size
        elif text == "" and element.soft is not None:
            found.setdefault(element.token, [0, element.soft])
    return found


def fold(text: str, stack: list[Element]) -> None:
    """Takes a text into the wording of the element that it is in."""
    words = " ".join(text.split())
    if words and stack and not any(e.aside for e in stack):
        stack[-1].wording = _mixed(stack[-1].wording, words)


def _mixed(*values) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(map(str, values)).encode("utf-8", "replace")) >> 1


def folded(element: Element, stack: list[Element]) -> int | None:
    """Token of a block that ends and can be the site's. Its wording goes into that of its parent."""
    if not element.wording:
        return None
    if stack:
        stack[-1].wording = _mixed(stack[-1].wording, element.wording)
    return _mixed(element.token, "#text", element.wording) if element.name in CONTAINERS else None


def statistics(page: str, exceptions=frozenset()) -> dict[int, list]:
    """Of each token: occurrences, text inside, whether it is a start tag, an article, its depth, and
    whether it is a text. Token 0 is the page."""
    found: dict[int, list] = {0: [1, 0, False, False, 0, False]}
    for text, element, stack in events(page, exceptions):
        if element is None:
            fold(text, stack)
            if not _outside(stack):
                size = len(text.strip())
                found[0][1] += size
                for e in stack:
                    e.mass += size
        elif text == "":
            row = found.setdefault(element.token, [0, 0, True, element.is_article and not _outside(stack), len(stack), False])
            row[0] += 1
        else:
            row = found.setdefault(element.end, [0, 0, False, False, len(stack), False])
            row[0] += 1
            found[element.token][1] += element.mass if element.name in CONTAINERS else 0
            token = folded(element, stack)
            if token is not None:
                found.setdefault(token, [0, 0, False, False, len(stack), True])[0] += 1
    return found


def main_text(page: str | None, container: int | None, exceptions=frozenset(), site=frozenset()) -> str:
    """Text of a page's article: of the elements with the token `container`, else of its article or
    main elements, else of the whole page; without boilerplate elements. Blocks with tokens in `site`
    are left out of the container."""
    page = page or ""
    for by_template, choose in (
        (True, lambda e: container is not None and e.token == container),
        (False, lambda e: e.is_article),
        (False, None),
    ):
        parts: list[str] = []
        kept: list[str] = []
        inside: list[Element] = []
        hidden: list[Element] = []
        any_container = False
        for text, element, stack in events(page, exceptions):
            if element is None:
                if by_template and site:
                    fold(text, stack)
                if (inside or choose is None) and not hidden:
                    parts.append(markup.unescape(text))
                    kept.append(parts[-1])
                continue
            if element.name in BLOCKS:
                parts.append(" ")
                kept.append(" ")
            if text == "":
                element.first = len(kept)
            if text is None:
                if by_template and site and folded(element, stack) in site and inside:
                    del kept[element.first :]
                if inside and inside[-1] is element:
                    inside.pop()
                if hidden and hidden[-1] is element:
                    hidden.pop()
                continue
            if element.name in VOID or element.name in RAW:
                continue
            if element.aside or (element.header and not inside):
                hidden.append(element)
            elif choose is not None and not hidden and choose(element):
                inside.append(element)
                any_container = True
        if any_container or choose is None:
            whole, varying = (" ".join("".join(p).split()) for p in (parts, kept))
            return varying if 100 * len(varying) >= LEFT_PERCENT * len(whole) else whole
    return ""


def _doubtful_batches(batches):
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for token, (mass, sure) in doubtful(page).items():
                row = sums.setdefault((host, token), [0, 0, sure])
                row[0] += 1
                row[1] += mass
        columns = [[h for h, _ in sums], [t for _, t in sums], *zip(*sums.values(), strict=True)]
        if sums:
            kinds = [pa.string(), *[pa.int64()] * 3, pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_DOUBTFUL
            )


_DOUBTFUL = ["host", "token", "pages", "mass", "sure"]


def _statistic_batches(batches):
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, identity, page, exceptions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for token, (count, mass, *kind) in statistics(page, frozenset(exceptions or ())).items():
                mark = xxhash.xxh3_64_intdigest(f"{identity} {count}".encode())
                row = sums.setdefault((host, token), [0, 0, 0, 0, 0, *kind])
                row[0] += 1
                row[1] += count
                row[2] += mark & 0x7FFFFFFF
                row[3] += mark >> 33
                row[4] += mass
            if len(sums) >= HELD_TOKENS:
                yield _statistic_batch(sums)
                sums = {}
    if sums:
        yield _statistic_batch(sums)


def _statistic_batch(sums: dict[tuple[str, int], list]) -> pa.RecordBatch:
    columns = [[h for h, _ in sums], [t for _, t in sums], *zip(*sums.values(), strict=True)]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_STATISTICS
    )


_STATISTICS = ["host", "token", "pages", "total", "mark1", "mark2", "mass", "start", "article", "depth", "text"]


def host_of(url):
    """Lower-case host of a URL; empty if it has none."""
    return F.lower(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    )


def exceptions(pages: DataFrame) -> DataFrame:
    """(host, exceptions): tokens of elements that are not boilerplate though a form or labelled so,
    since they hold as much of the host's text as a container; and of elements that are, since they
    have a listed word among others and are on two pages or more and half of the host's.

    Hosts without such elements have no row.
    """
    found = pages.select("host", text_of(F.col("html")).alias("html")).mapInArrow(
        _doubtful_batches, "host string, token bigint, pages bigint, mass bigint, sure boolean"
    )
    tokens = written(
        found.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("mass").alias("mass"), F.max("sure").alias("sure"))
    )
    hosts = tokens.filter("token = 0").select(
        "host", F.col("pages").alias("host_pages"), F.col("mass").alias("host_mass")
    )
    holds = F.expr(f"100 * mass >= {CONTAINER_PERCENT} * host_mass AND mass > 0")
    common = F.expr("pages > 1 AND 2 * pages >= host_pages")
    return (
        tokens.filter("token <> 0")
        .join(hosts, "host")
        .filter(F.when(F.col("sure"), holds).otherwise(common & ~holds))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("token")).alias("exceptions"))
    )


def _with_host_rows(pages: DataFrame, found: DataFrame) -> DataFrame:
    """`pages` with the columns of their host's row in `found`, or nulls."""
    return pages.join(F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found, "host", "left")


def templates(pages: DataFrame) -> DataFrame:
    """(host, container, site): the template element of each host that holds the article, and the
    blocks of its class by wording. `pages` have host and exceptions.

    Hosts of one page, and hosts whose template has no such element, have no row.
    """
    counted = pages.select(
        "host",
        F.xxhash64("page_id", "url", "html").alias("identity"),
        text_of(F.col("html")).alias("html"),
        "exceptions",
    ).mapInArrow(
        _statistic_batches,
        "host string, token bigint, pages bigint, total bigint, mark1 bigint, mark2 bigint,"
        " mass bigint, start boolean, article boolean, depth int, text boolean",
    )
    vector = ["host", "pages", "mark1", "mark2"]
    tokens = written(
        counted.groupBy("host", "token").agg(
            *[F.sum(c).alias(c) for c in ("pages", "total", "mark1", "mark2", "mass")],
            F.max("start").alias("start"),
            F.max("article").alias("article"),
            F.max("depth").alias("depth"),
            F.max("text").alias("text"),
        ).filter(f"NOT text OR pages >= {SITE_TEXT_PAGES}")
    )
    hosts = tokens.filter("token = 0").select(
        "host", F.col("pages").alias("host_pages"), F.col("mass").alias("host_mass")
    )
    frequent = tokens.filter("token <> 0").join(hosts, "host").filter(
        "host_pages > 1 AND 2 * pages >= host_pages"
    )
    classes = frequent.groupBy(*vector).agg(F.count("*").alias("size")).filter("size > 1")
    valid = frequent.join(classes, vector)
    ends = valid.filter("NOT start AND NOT text").select(*vector, F.col("token").bitwiseXOR(F.lit(1)).alias("token"))
    holds = F.col("article") | (100 * F.col("mass") >= CONTAINER_PERCENT * F.col("host_mass"))
    # An article or main element, the outermost; else the innermost one that holds the text.
    order = F.when(F.col("article"), 1_000_000 - F.col("depth")).otherwise(F.col("depth"))
    containers = (
        valid.filter("start AND total = pages")
        .join(ends, [*vector, "token"], "left_semi")
        .filter(holds)
        .groupBy("host")
        .agg(F.max(F.struct(order.alias("order"), "token", "pages", "mark1", "mark2")).alias("best"))
        .select("host", "best.*")
        .withColumnRenamed("token", "container")
    )
    texts = valid.filter("text AND total = pages").select(*vector, "token")
    site = containers.join(texts, vector).groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("site"))
    return containers.select("host", "container").join(site, "host", "left")


def _text_batches(batches):
    for batch in batches:
        rows = batch.column(0)
        texts = [
            main_text(page, container, frozenset(exceptions or ()), frozenset(site or ()))
            for page, container, exceptions, site in zip(
                rows.field("html").to_pylist(), *(c.to_pylist() for c in batch.columns[1:]), strict=True
            )
        ]
        yield pa.RecordBatch.from_arrays(
            [rows.field("page_id"), rows.field("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages`.

    Blocks keep page order, white space becomes one space. Null and empty pages, and pages of
    boilerplate only, have an empty text. A null or odd URL counts as one host without name. Null
    ids and repeated rows pass through; other columns are not looked at.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    pages = pages.withColumn("host", host_of(F.col("url")))
    pages = _with_host_rows(pages, written(exceptions(pages)))
    chosen = _with_host_rows(pages, written(templates(pages)))
    row = chosen.select(F.struct("page_id", "url", "html").alias("row"), "container", "exceptions", "site")
    texts = row.mapInArrow(_text_batches, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
