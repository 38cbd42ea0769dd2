"""Main text of web pages by removal of site templates.

First pass: every element's subtree is hashed (tags, class and id, text). Spark counts in how
many pages of different content of its host each subtree stands.
Second pass: subtrees that recur across pages of their host are deleted, inside a marked article
(article, main) only those that stand on a fifth of the host's pages and on no other host, as prose may that
several articles hold; as are elements that markup itself names as no part of the article
(menus, footers, adverts, forms, scripts, reader comments). A name alone deletes nothing that holds
the article, its heading or most of the text, and none where it would leave nothing. Copies of an
article are no templates: a subtree's pages count as one where the text that stands on them alone is
alike (at least 30 words, by sketches of their runs of three), and where three quarters of a page's prose (paragraphs,
headings) recur, what stands in at most twice as many pages as that prose stays. The h1 of a marked
article always stays. What is left is the text.

Null html and pages without text give an empty text. Repeated rows give equal texts and count as one page,
pages of one content as well; a subtree exactly at ``min_pages`` is a template; a host of fewer pages has none. Order of
blocks is that of the page. Tags that never close are read as text from the last ">" on, elements that never close (but
scripts and styles) as empty: any page is read in one pass, in time that grows as its length.

Counts are partial before their shuffle, so a host with a third of all pages is no hot key.
Templates go to pages as rows of (page, subtree): a host may have any number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_PAGES = 5  # a template stands in so many pages of its host, whatever the host's size
SHARE = 0.2  # and one inside an article in such a part of them
SKETCH = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 % 2**64 | 1 for k in range(16)], dtype=np.uint64)  # odd factors of hash functions
ALIKE, WORDS = 8, 30  # so many equal values over so many words tell copies of one article

# Names of HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg object select".split())
FOREIGN = frozenset(("svg", "math"))  # a slash ends these; an unquoted value may end in one
CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$|(?:^|\s)[^\s"'=/]+/\s*$""")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form button dialog menu head search input fieldset audio video canvas map annotation annotation-xml".split()) | RAW
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES_P = BLOCK - frozenset("body html head caption tbody td tfoot th thead tr option optgroup legend dd dt li".split()) | {"dl", "ol", "ul", "table"}
SWALLOW = frozenset(("script", "style"))  # without an end tag these take the rest of the page
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
HOLDERS = frozenset("ul ol dl table select menu".split())  # an end tag or sibling rule does not reach beyond these
# Parts of class, id and role names that mark what is no article.
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|nav|navbar|navigation|menu|menubar|"
    r"site-?header|page-?header|masthead|topbar|header|footer|site-?footer|copyright|sidebar|side-?bar|rail|complementary|contentinfo|breadcrumbs?|cookies?|"
    r"consent|gdpr|notice|notification|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|sign-?in|login|share|sharing|social|"
    r"related|recommended|recommendations|comments?|commentlist|disqus|respond|replies|search|searchbox|widget|pagination|pager|toolbar|skip-?link|toc)(?:$|[\s_-])", re.I)
# Of these, the words that mark what an article may hold and is no part of it. Others name parts of texts too.
ADVERT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|newsletter|comments?|commentlist|disqus|widget|related|recommended|recommendations)(?:$|[\s_-])", re.I)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>?|[^<]++|<""", re.S)


MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)[_-]\S*", re.I)  # says what stands beside or is missing
COMMENTS = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])|\0hidden", re.I)


class Node:
    __slots__ = ("hint", "kids", "links", "mark", "spare", "tag")

    def __init__(self, tag: str, hint: str = ""):
        self.tag, self.hint, self.kids, self.mark, self.spare, self.links = tag, hint, [], 0, False, False


def _hint(attrs: str) -> str:
    """class, id and role of an element, and "hidden" if it is not shown."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return ""
    out = []
    for name, value in NAMED.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            out.append(value)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out.append("\0hidden")
    return " ".join(out)


def parse(html: str | None) -> Node:
    """A tree of elements and texts. Any input gives one: stray tags are passed over, open ones end with the page."""
    html = html or ""
    root = Node("html")
    stack = [root]
    open_ended: set[str] = set()
    at, last = 0, html.rfind(">")
    while at < len(html):
        if at > last and html[at] == "<" and not html.startswith("<!--", at):
            stack[-1].kids.append(unescape(html[at:]))
            break
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?", "</")):
                stack[-1].kids.append(unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in HOLDERS and tag not in BLOCK:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in HOLDERS:
                    break
            # The inner ends of a row may be open too.
        node = Node(tag, _hint(m[3]))
        if tag in ("html", "body"):
            continue
        stack[-1].kids.append(node)
        if tag in open_ended or (tag in FOREIGN and CLOSED.search(m[3])):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            if end or tag in SWALLOW:
                at = end.end() if end else len(html)
            else:
                open_ended.add(tag)  # never closed from here on: empty
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCK | {"a", "b", "i", "span", "em", "strong"}:
            stack.append(node)  # a slash does not end these
    return root


def hashes(root: Node) -> set[int]:
    """Marks every element with its subtree's hash; returns those of block elements with text."""
    found: set[int] = set()
    todo: list[tuple[Node, bool]] = [(root, False)]
    empty = set()
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo.extend((k, False) for k in node.kids if isinstance(k, Node))
            continue
        h, text = xxhash.xxh64(f"<{node.tag} {node.hint}>"), False
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.mark.to_bytes(8, "little", signed=True))
                text = text or id(k) not in empty
            elif k.strip():
                h.update(" ".join(k.split()))
                text = True
        node.mark = h.intdigest() - (1 << 63)
        if not text:
            empty.add(id(node))
        elif node.tag in BLOCK:
            found.add(node.mark)
    return found


def _spare(root: Node) -> None:
    """Marks elements that a name alone must not delete: those that hold main, an h1 or the longest article, and
    on a page that has none of these outside them those that hold most of its text. Also marks elements
    of which at least half the text is links or none is."""
    sizes: dict[int, tuple[int, int, int]] = {}  # by id: characters, articles, mains and h1s, characters in links
    holders, longest, path = [], (-1, ()), []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, done = todo.pop()
        if done:
            path.pop()
            inner = [sizes[id(k)] if isinstance(k, Node) else (len(k.strip()), 0, 0) for k in node.kids]
            chars, heads, linked = (sum(x) for x in zip(*inner, strict=True)) if inner else (0, 0, 0)
            if node.tag == "a":
                linked = chars
            node.links = 2 * linked >= chars
            if node.tag in ("article", "main", "h1") and not COMMENTS.search(node.hint):
                heads += 1
                if node.tag == "article":
                    longest = max(longest, (chars, tuple(path)), key=lambda x: x[0])
                else:
                    holders.append(tuple(path))
            sizes[id(node)] = chars, heads, linked
        elif node.tag in NEVER or "\0" in node.hint:
            sizes[id(node)] = 0, 0, 0  # not shown whatever it holds
        else:
            todo.append((node, True))
            path.append(node)
            todo.extend((k, False) for k in reversed(node.kids) if isinstance(k, Node))
    for nodes in (*holders, longest[1]):
        for node in nodes:
            node.spare = True
    chars, heads, _ = sizes[id(root)]
    node = root
    while node is not None:  # at most one child holds most of the text
        node = next((k for k in node.kids if isinstance(k, Node) and 2 * sizes[id(k)][0] > chars and sizes[id(k)][1] == heads), None)
        if node is not None:
            node.spare = True


def _foreign(node: Node, in_article: bool, by_name: bool = True) -> bool:
    """What is no main text whatever its counts. Inside an article a paragraph or heading is never told by its name,
    and other elements only by a word of adverts and the like, or by any of HINT if they hold links above all."""
    if node.tag in NEVER:
        return True
    if node.tag == "header":
        return not (in_article and any(isinstance(k, Node) and k.tag in ("h1", "h2") for k in node.kids))
    if node.tag in ("article", "main", "h1"):
        return bool(node.hint) and bool(COMMENTS.search(node.hint))
    if not node.hint:
        return False
    if "\0" in node.hint:
        return True
    if not by_name or node.spare or (in_article and node.tag in PROSE):
        return False
    name = MODIFIER.sub("", node.hint)
    return bool(HINT.search(name)) and (not in_article or node.links or bool(ADVERT.search(name)))


def _sketch(text: str) -> list[int]:
    """The number of words, and of each of SKETCH hash functions the least value over the runs of three words."""
    n = len(text.split())
    words = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()], dtype=np.uint64)
    if len(words) > 2:
        words = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:]
    elif len(words) == 2:
        words = words[:1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    words ^= words >> np.uint64(29)
    return [n, *((words[:, None] * SKETCH) >> np.uint64(33)).min(0).tolist()]


def shown(root: Node) -> dict[int, list[int]]:
    """The hashes of block elements with text that may stand in the main text, each with the sketch of
    the text that stands in it and no inner block (none: empty)."""
    blocks = hashes(root)
    _spare(root)
    own: dict[int, list[str]] = {}
    todo: list[tuple[Node | str, bool, int]] = [(root, False, 0)]
    while todo:
        node, inside, block = todo.pop()
        if isinstance(node, str):
            own.setdefault(block, []).append(node)
        elif not _foreign(node, inside):
            inside = inside or node.tag in ("article", "main")
            if node.tag in BLOCK:
                block = node.mark
                if block in own:
                    block = 0  # the same subtree again
                elif block in blocks:
                    own[block] = []
            todo.extend((k, inside, block) for k in reversed(node.kids))
    return {b: _sketch(t) if (t := " ".join(texts)).strip() else [] for b, texts in own.items() if b in blocks}


def _copied(root: Node, templates: Mapping[int, int], by_name: bool) -> int:
    """In so many pages at least three quarters of this page's prose stand, by characters. A page whose prose
    recurs is a copy; what recurs about as often belongs to it and is no template."""
    sizes: dict[int, int] = {}
    todo: list[tuple[Node | str, bool, int | None]] = [(root, False, None)]  # what, inside an article, pages of its prose
    while todo:
        node, inside, pages = todo.pop()
        if isinstance(node, str):
            if pages is not None and (n := len("".join(node.split()))):
                sizes[pages] = sizes.get(pages, 0) + n
        elif not _foreign(node, inside, by_name):
            inside = inside or node.tag in ("article", "main")
            pages = templates.get(node.mark, 0) if node.tag in PROSE else pages
            todo.extend((k, inside, pages) for k in node.kids)
    most, above = 0.75 * sum(sizes.values()), 0
    for pages in sorted(sizes, reverse=True):
        above += sizes[pages]
        if above >= most:
            return pages
    return 0


def _blocks(root: Node, templates: Mapping[int, int], by_name: bool = True, within: frozenset[int] | None = None) -> list[str]:
    out, run = [], []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    kept = 2 * _copied(root, templates, by_name) if templates else 0
    # (what, inside an article); None ends a block.
    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            run.append(node)
        elif node.tag == "br":
            run.append(" ")
        elif not _foreign(node, inside, by_name) and (node is root or node.tag not in BLOCK or (inside and (node.tag == "h1" or (within is not None and node.mark not in within))) or templates.get(node.mark, 0) <= kept):
            inside = inside or node.tag in ("article", "main")
            if node.tag in BLOCK:
                end()
                todo.append((None, inside))
            todo.extend((k, inside) for k in reversed(node.kids))
    end()
    return out


def main_text(html: str | None, templates: Mapping[int, int] | frozenset[int] = frozenset(), within: frozenset[int] | None = None) -> str:
    """``templates``: the subtrees that recur on the page's host, and in how many of its pages (a set: all alike). ``within``:
    those that go inside an article too (by default all)."""
    root = parse(html)
    templates = templates if isinstance(templates, Mapping) else dict.fromkeys(templates, MIN_PAGES)
    if templates:
        hashes(root)
    _spare(root)
    for marks, by_name in ((templates, True), ({}, True), ({}, False)):  # a page that is all template, or all named as none, keeps its text
        if blocks := _blocks(root, marks, by_name, within):
            return " ".join(blocks)
    return ""


def host(url_col: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _keys(pages: DataFrame, url_col: str, html_col: str) -> tuple:
    """The host's hash, and the page's: its host and its own content."""
    return F.xxhash64(host(url_col)), F.xxhash64(host(url_col), common.text_of(html_col))


def site_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page, marks (array of tree, n and within): a page's subtrees (hashes, mixed with its host's) that stand in at least
    ``min_pages`` pages of different content of the host, and in how many; within: they go inside an article too, as they stand
    on SHARE of the host's pages and on no other host. Copies of one article, told by the
    text that does not recur, count as one page. Pages without any have no row."""
    common.small_batches(pages.sparkSession)

    def subtrees(batches):
        for b in batches:
            found = [(page, site, t, sketch) for site, page, html in zip(b["site"].tolist(), b["page"].tolist(), b["html"], strict=True) for t, sketch in shown(parse(html)).items()]
            yield pd.DataFrame(found, columns=["page", "site", "raw", "sketch"])

    site, page = _keys(pages, url_col, html_col)
    found = pages.select(site.alias("site"), page.alias("page"), common.text_of(html_col).alias("html")).mapInPandas(subtrees, "page bigint, site bigint, raw bigint, sketch array<int>")
    found = found.withColumn("tree", F.col("raw").bitwiseXOR(F.col("site")))
    found = common.materialise(found.dropDuplicates(["page", "tree"]), "html-subtrees")
    # In how many pages of its host each subtree stands, and on how many hosts.
    spread = common.materialise(found.groupBy("site", "raw", "tree").agg(F.count("*").alias("n")), "html-counts")
    recurring = spread.filter(F.col("n") >= min_pages)
    elsewhere = spread.join(recurring.select("raw").distinct(), "raw", "left_semi").groupBy("raw").agg(F.count("*").alias("hosts"))
    sizes = found.groupBy("site", "page").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("*").alias("pages"))
    within = (F.col("hosts") == 1) & (F.col("n") >= SHARE * F.col("pages"))
    counts = common.materialise(recurring.join(elsewhere, "raw").join(sizes, "site").select("tree", "n", within.alias("within")), "html-recurring")
    common.forget(spread)
    n_counts = counts.count()
    flagged = found.drop("site", "raw").join(common.broadcast_if(counts, n_counts, 20), "tree", "left")
    # The sketch of what stands on a page alone: one value where all recurs, null where a few words tell nothing.
    alone = lambda k: F.when(F.col("n").isNull() & (F.size("sketch") > 0), F.get("sketch", F.lit(k)))
    n_words = F.coalesce(F.sum(alone(0)), F.lit(0))
    least = [F.when(n_words == 0, F.lit(-1)).when(n_words >= WORDS, F.min(alone(k + 1))) for k in range(len(SKETCH))]
    rest = flagged.groupBy("page").agg(F.array(*least).alias("rest"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("tree", "n", "within"))).alias("marks"))
    rest = common.materialise(rest.filter(F.size("marks") > 0), "html-rests")
    pairs = rest.select("rest", F.explode("marks").alias("m")).select("m.tree", "m.n", "rest")
    groups = pairs.select("tree", "n", F.posexplode("rest").alias("k", "value")).groupBy("tree", "n", "k", "value").agg(F.count("*").alias("like"))
    # Values that a quarter of a subtree's pages share name copies of one article.
    copies = groups.filter(F.col("value").isNotNull() & (F.col("like") > 1) & (4 * F.col("like") >= F.col("n"))).groupBy("tree", "k").agg(F.max_by("value", F.struct("like", "value")).alias("value"))
    copies = common.materialise(copies.groupBy("tree").agg(F.collect_list(F.struct("k", "value")).alias("shared")), "html-copies")
    alike = F.size(F.filter("shared", lambda x: F.get("rest", x.k) == x.value)) >= ALIKE
    one = pairs.join(common.broadcast_if(copies, copies.count(), 160), "tree").groupBy("tree", "n").agg(F.count_if(~alike).alias("others")).filter(F.col("others") + 1 < min_pages).select("tree")
    one = common.materialise(one, "html-articles")
    marks = rest.select("page", F.explode("marks").alias("m")).select("page", "m.tree", "m.n", "m.within").join(common.broadcast_if(one, one.count(), 8), "tree", "left_anti")
    return common.materialise(marks.groupBy("page").agg(F.collect_list(F.struct("tree", "n", "within")).alias("marks")), "html-marks")


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", name: str = "main_text", **limits) -> DataFrame:
    """``pages`` with their main text. Null html and pages without text give an empty string."""
    common.small_batches(pages.sparkSession)
    name, at, own = common.fresh(pages, name, "page_key", "page_marks")
    marks = site_templates(pages, url_col=url_col, html_col=html_col, **limits).toDF(at, own)
    marks = common.broadcast_if(marks, marks.agg(F.coalesce(F.sum(F.size(own) + 4), F.lit(0))).first()[0], 16)

    @F.pandas_udf("string")
    def text(html: pd.Series, site: pd.Series, trees: pd.Series, counts: pd.Series, within: pd.Series) -> pd.Series:
        out = []
        for h, s, t, n, w in zip(html, site.tolist(), trees, counts, within, strict=True):
            marks = {} if t is None else dict(zip((t ^ s).tolist(), n.tolist(), strict=True))
            out.append(main_text(h, marks, frozenset(k for k, yes in zip(marks, w if t is not None else (), strict=True) if yes)))
        return pd.Series(out, dtype=object)

    site, page = _keys(pages, url_col, html_col)
    rows = pages.withColumn(at, page).join(marks, at, "left")
    return rows.withColumn(name, text(F.col(html_col), site, F.col(own).tree, F.col(own).n, F.col(own).within)).select(*pages.columns, name)


def op4(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, name="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
