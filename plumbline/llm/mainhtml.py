"""Main text of web pages by removal of what a site repeats.

Every element's subtree is hashed from its tag, its class and its text. A first pass gives each distinct page
of a host the hashes of its subtrees; Spark counts on how many pages of the host each stands. A second pass parses
the pages again, takes the article's blocks and leaves out those in subtrees that the host repeats on many
pages. Elements whose tag, role or class says that they are not the article (menus, footers, comments, adverts,
forms, scripts) go in any case; a class or id says so as a whole (``sidebar``, not ``has-sidebar``), and not of an
element that holds the page's article. A form around the page's article or most of its text is no form. End tags may be left out: the first element
of the body ends the head, and an article or main element ends navigation, asides, headers and footers that the page does not close. What stands inside an article or main element is no template however often a site prints it, so mirrored articles
stay whole with their lists and tables; only blocks of links go from there, when most of the host's pages have them.
Outside prose goes when half of the host's pages have it.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import columns, settled

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
#: Elements that begin a new block.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of the article.
DROPPED = set("script style noscript iframe xmp textarea title head template nav footer aside form menu button select option svg canvas object audio video dialog".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of a class or id that mark what is not the article.
DROPPED_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
                    "footer cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay comment comments commentlist respond reply replies "
                    "disqus share sharing social related recommended recommendations widget login signin signup masthead toolbar pagination pager alert".split())
COMMENT_NAMES = set("comment comments reply replies respond".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: A start tag ends open elements of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an implied end does not reach beyond.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
CONTAINERS = {"html", "body", "article", "main"}
#: Any other start tag ends an open head.
HEAD = set("html head title base link meta style script noscript template".split())
#: An article or main element ends these where the page leaves out an end tag of theirs.
ENDED = set("nav menu aside header footer".split())
#: Regions of a page, the best last.
PAGE, MAIN, ARTICLE = range(3)
#: Kinds of subtrees: what an article or main element holds is no template but for links; prose outside, and what is not prose, can be one.
KEPT, PROSE_OUTSIDE, REPEATS, LINKS_INSIDE = range(4)
#: Sets the hash of links inside apart from that of the same block outside.
INSIDE = 0x9E3779B97F4A7C15


class Element:
    """An open block element, or any element within a dropped one."""

    __slots__ = ("tag", "names", "dropped", "region", "index", "named", "begins", "parts", "prose", "links", "text", "holds")

    def __init__(self, tag: str, names: str, dropped: bool, region: int, index: int, named: tuple[int, ...] | None = (), begins: int = PAGE):
        self.tag, self.names, self.dropped, self.region, self.index = tag, names, dropped, region, index
        #: Where the elements begin that drop this one by name; none if a tag, a role or a comment drops it.
        self.named = named
        #: The region that begins here.
        self.begins = begins
        self.parts: list[bytes] = []
        self.prose = tag in PROSE
        #: Whether an article or main element stands within.
        self.holds = False
        self.links = self.text = 0


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def _says(names: str, listed: set[str]) -> bool:
    """Whether a class or id consists of listed words only: ``share`` and ``social-share`` do, ``content-with-share`` does not."""
    return any((words := set(re.findall("[a-z]+", token))) and words <= listed for token in names.split())


def parse(source: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[int, list[int], str]], list[tuple[int, int]]]:
    """Blocks (region, indices of the enclosing subtrees, text) in page order, and subtrees (hash, kind).

    Indices point into the subtrees; prose is text in paragraphs, headings or quotes that is not mostly links.
    Elements that begin at ``spared`` are not dropped by their names or as forms: a form around the page is no form.
    """
    hidden: list[tuple[int, tuple[int, ...], int]] = []
    forms: list[tuple[int, tuple[int, ...]]] = []
    unclosed: dict[str, bool] = {}

    def lacks_end(tag: str) -> bool:
        if tag not in unclosed:
            begins, ends = (len(re.findall(rf"<{x}{tag}\b", source, re.I)) for x in ("", "/"))
            unclosed[tag] = begins > ends
        return unclosed[tag]

    shown = False
    blocks: list[tuple[int, list[int], str]] = []
    subtrees: list[tuple[int, int]] = []
    stack = [Element("", "", False, 0, -1)]
    held: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, shown
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            top = stack[-1]
            top.parts.append(text.encode("utf-8", "replace"))
            top.text += len(text)
            top.links += min(linked, len(text))
            if not top.dropped:
                blocks.append((top.region, [e.index for e in stack if e.index >= 0], text))
                shown = shown or top.region > PAGE
        linked = 0

    def close() -> None:
        flush()
        done, parent = stack.pop(), stack[-1]
        own = xxhash.xxh3_64_intdigest(b"\0".join([done.tag.encode(), done.names.encode("utf-8", "replace"), *done.parts]))
        parent.parts.append(own.to_bytes(8, "little"))
        parent.text += done.text
        parent.links += done.links
        parent.prose = parent.prose or done.prose
        parent.holds = parent.holds or done.holds or (done.region != PAGE and not done.dropped)
        if done.begins and done.named and done.text:
            hidden.append((done.begins, done.named, done.text - done.links))
        if done.tag == "form" and done.named and done.prose:
            forms.append((done.text - done.links, done.named))
        if done.index >= 0 and done.text and not done.dropped:
            if done.region != PAGE:
                kind = LINKS_INSIDE if done.links * 2 >= done.text else KEPT
            elif done.holds:
                kind = KEPT
            else:
                kind = REPEATS if done.links * 2 >= done.text or not done.prose else PROSE_OUTSIDE
            own ^= INSIDE * (kind == LINKS_INSIDE)
            subtrees[done.index] = (own - (own >> 63 << 64), kind)

    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt != at:
            held.append(source[at:lt] if lt >= 0 else source[at:])
            linked += len(held[-1]) * in_link
            if lt < 0:
                break
        found = TOKEN.match(source, lt)
        if not found:
            held.append("<")
            at = lt + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if tag == "a":
            in_link = not found[1]
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                while len(stack) > depth:
                    close()
            elif tag in BLOCKS:
                flush()
            continue
        if tag not in HEAD and any(e.tag == "head" for e in stack[1:4]):
            while any(e.tag == "head" for e in stack):
                close()
        if tag in RAW:
            closing = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = closing.end() if closing else end
            continue
        if tag in BLOCKS:
            flush()
            ends = CLOSES.get(tag, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    while len(stack) > i:
                        close()
                    break
                if stack[i].tag in FENCE.get(tag, CONTAINERS):
                    break
        if tag in VOID:
            continue
        attributes = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(found[3])} if found[3] else {}
        if tag in ("article", "main") or attributes.get("role") == "main":
            first = next((i for i, e in enumerate(stack) if e.tag in ENDED and e.dropped and lacks_end(e.tag)), len(stack))
            while len(stack) > first:
                close()
        parent = stack[-1]
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        role = attributes.get("role")
        region = ARTICLE if tag == "article" else max(parent.region, MAIN if tag == "main" or role == "main" else PAGE)
        if tag in CONTAINERS:
            dropped, by_name = tag == "article" and _says(names, COMMENT_NAMES), False
        else:
            dropped = (tag in DROPPED and tag != "form") or role in DROPPED_ROLES or (parent.region == PAGE and tag == "header")
            by_name = lt not in spared and (tag == "form" or _says(names, DROPPED_NAMES) or (parent.region == PAGE and _says(names, {"header"})))
        named = None if dropped or parent.named is None else parent.named + (lt,) * by_name
        dropped = dropped or by_name or parent.dropped
        begins = ARTICLE if tag == "article" else MAIN if tag == "main" or role == "main" else PAGE
        if tag in BLOCKS or dropped:
            flush()
            index = -1
            if tag in BLOCKS and tag not in CONTAINERS:
                index = len(subtrees)
                subtrees.append((0, KEPT))
            stack.append(Element(tag, names, dropped, region, index, named, begins))
    while len(stack) > 1:
        close()
    flush()
    if hidden and not shown:
        # the page's article is what few names hide, a main element or the larger part of the text; teasers in a list are neither
        few = min(len(named) for _, named, _ in hidden)
        nearest = [x for x in hidden if len(x[1]) == few]
        if any(begins == MAIN for begins, _, _ in nearest) or sum(n for _, _, n in nearest) >= sum(len(text) for _, _, text in blocks):
            return parse(source, spared.union(*(named for _, named, _ in nearest)))
    if forms and not shown:
        # without an article, a form that holds prose and most of the text is the page itself
        most, named = max(forms)
        if most >= sum(len(text) for _, _, text in blocks):
            return parse(source, spared.union(named))
    return blocks, subtrees


#: A subtree is a template if at least so many pages of its host have it, and this share of them.
MIN_PAGES = 3
SHARE = {PROSE_OUTSIDE: 0.5, REPEATS: 0.1, LINKS_INSIDE: 0.75}


def article(blocks: list[tuple[int, list[int], str]], templates: set[int]) -> str:
    """The text of the best region that has any: articles, else main elements, else the page."""
    kept = [(region, text) for region, inside, text in blocks if templates.isdisjoint(inside)]
    best = max((region for region, _ in kept), default=PAGE)
    return "\n".join(text for region, text in kept if region == best)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, text (blocks in page order, one a line) and n_chars.

    Null and empty pages have an empty text; pages without a url share one nameless host; repeated rows get a row
    each and count once as pages of their host; an empty table gives no rows. Other columns of ``pages`` are not looked at.
    """
    inner = columns(pages, page_id=id_col, url=url_col, html=html_col)
    kind = inner.schema["page_id"].dataType.simpleString()

    def key_of(url, source) -> tuple[str, bytes]:
        return host_of(url), xxhash.xxh3_128_digest((source or "").encode("utf-8", "replace"))

    def subtrees_of(batches):
        for batch in batches:
            rows = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {(own, k) for own, k in parse(source or "")[1] if k != KEPT}
                rows.append({**dict(zip(("host", "page"), key_of(url, source))), "trees": [{"own": o, "kind": k} for o, k in sorted(found)]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("host", pa.string()), ("page", pa.binary()), ("trees", pa.list_(pa.struct([("own", pa.int64()), ("kind", pa.int64())])))]))

    # equal pages of a host are one page here: the same rows met twice tell nothing about templates
    seen = inner.select("url", "html").mapInArrow(subtrees_of, "host string, page binary, trees array<struct<own: bigint, kind: bigint>>")
    seen = settled(seen.groupBy("host", "page").agg(F.first("trees").alias("trees")))
    trees = seen.select("host", "page", F.explode("trees").alias("t")).select("host", "page", "t.own", "t.kind")
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    share = F.when(F.col("kind") == PROSE_OUTSIDE, SHARE[PROSE_OUTSIDE]).when(F.col("kind") == LINKS_INSIDE, SHARE[LINKS_INSIDE]).otherwise(SHARE[REPEATS])
    repeated = (trees.groupBy("host", "own").agg(F.count("*").alias("n"), F.min("kind").alias("kind")).where(F.col("n") >= MIN_PAGES).join(sizes, "host")
                .where(F.col("n") >= share * F.col("pages")).select("host", "own"))
    templates = trees.join(repeated, ["host", "own"]).groupBy("host", "page").agg(F.collect_set("own").alias("templates"))

    def blocks_of(batches):
        for batch in batches:
            hosts, digests, payload = [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                host, digest = key_of(url, source)
                blocks, subtrees = parse(source or "")
                hosts.append(host)
                digests.append(digest)
                own = [[r, sorted({subtrees[i][0] for i in inside if subtrees[i][1] != KEPT}), text] for r, inside, text in blocks]
                payload.append(zlib.compress(json.dumps(own, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(payload, pa.binary())],
                                             ["page_id", "url", "host", "page", "payload"])

    def assemble(batches):
        for batch in batches:
            out = []
            for payload, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(article(json.loads(zlib.decompress(payload).decode("utf-8", "surrogatepass")), set(gone or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    blocks = inner.mapInArrow(blocks_of, f"page_id {kind}, url string, host string, page binary, payload binary")
    joined = blocks.join(templates, ["host", "page"], "left").select("page_id", "url", "payload", "templates")
    out = joined.mapInArrow(assemble, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
