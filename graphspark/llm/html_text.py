"""Main text of web pages: site templates go by counting, what the markup names as no text of the page by its name.

Every element subtree outside the article, and every container inside it, is hashed bottom-up: tag, classes, texts and
the hashes of its children in order. Spark counts the hashes per host, and a subtree that recurs beside many different
main texts of its host is a template and goes, however large the host. Elements that say what they are (nav, footer,
form, ``class="ad"``, comments ...) go even where they don't recur: on small hosts and with a text of their own.
Paragraphs and headings inside an article are never taken for templates: copies of an article on one host keep theirs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.storage import materialise

# Names of HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp plaintext".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html nav aside main form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg canvas object audio video select textarea input dialog menu search title".split())
DROPPED_ROLES = frozenset(":navigation :banner :contentinfo :complementary :search :form :alert :alertdialog :dialog :menu :menubar :toolbar".split())
#: Names of classes and ids. A name counts as a whole: each of its words (``cookieNotice``, ``cookie-notice``) is one of
#: these or says only where and how (``BESIDE``), so ``related-work`` or ``share-enabled`` name nothing.
HEADER_NAMES = frozenset("header masthead topbar".split())
DROPPED_NAMES = frozenset(
    "ad ads adsense adslot advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disclaimer disqus"
    " footer form login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion"
    " related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
BESIDE = frozenset("area bar block body bottom box button buttons col column container content floating global group header heading icon icons inner item items left link links list main mobile outer page panel post posts primary right row secondary section site sticky text title top unit wrap wrapper".split())
#: Names that an article or main element must have to be none of the page's own text.
OTHER_ARTICLES = frozenset("comment comments reply replies related teaser sponsored advert advertisement promo".split())
#: Names that an id of a section inside the article must have; other ids of sections repeat their headings.
SECTION_IDS = frozenset("comment comments commentlist disqus respond replies".split())
#: Elements whose recurring subtrees are templates even inside an article, and by a count alone on pages without one.
CONTAINERS = frozenset("div section ul ol dl table figure header hgroup details center fieldset".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


@dataclass
class Page:
    """A page as its elements (in order of their start tags) and its blocks, lists of (text, element)."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    blocks: list[list[tuple[str, int]]] = field(default_factory=list)
    names: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    #: Texts and elements right inside each element, in order.
    inside: list[list[str | int]] = field(default_factory=lambda: [[]])


def parse(source: str) -> Page:
    """A tolerant reading of HTML: implied end tags, stray end tags, raw text, comments and cut-off pages."""
    page, stack, block, at = Page(), [0], [], 0
    open_count: dict[str, int] = {}

    def flush() -> None:
        nonlocal block
        if block:
            page.blocks.append(block)
            block = []

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            tag = page.tags[stack.pop()]
            open_count[tag] -= 1
            if tag in BLOCK:
                flush()

    def text(a: int, b: int) -> None:
        if a < b:
            piece = source[a:b]
            piece = html.unescape(piece) if "&" in piece else piece
            block.append((piece, stack[-1]))
            page.inside[stack[-1]].append(piece)

    end = len(source)
    # Behind the last ">" only comments and declarations, which may be cut off, are markup.
    last = source.rfind(">")
    markup = lambda at: _MARKUP.match(source, at) if at < last or source.startswith(("<!", "<?"), at) else None
    while at < end:
        lt = source.find("<", at)
        m = markup(lt) if lt >= 0 else None
        while lt >= 0 and m is None:  # a lone "<" is text
            lt = source.find("<", lt + 1)
            m = markup(lt) if lt >= 0 else None
        if lt < 0:
            text(at, end)
            break
        text(at, lt)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if open_count.get(tag):
                depth = len(stack) - 1
                while page.tags[stack[depth]] != tag:
                    depth -= 1
                pop_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            block.append((" ", stack[-1]))
            page.inside[stack[-1]].append(" ")
            continue
        if tag in CLOSES_P and open_count.get("p"):
            depth = len(stack) - 1
            while page.tags[stack[depth]] not in SCOPE and page.tags[stack[depth]] != "p":
                depth -= 1
            if page.tags[stack[depth]] == "p":
                pop_to(depth)
        if tag in SIBLINGS:
            depth = len(stack) - 1
            while depth > 0 and page.tags[stack[depth]] not in SIBLINGS[tag] and page.tags[stack[depth]] not in SCOPE:
                depth -= 1
            if page.tags[stack[depth]] in SIBLINGS[tag]:
                while page.tags[stack[depth - 1]] in SIBLINGS[tag]:
                    depth -= 1
                pop_to(depth)
        if tag in BLOCK:
            flush()
        page.inside[stack[-1]].append(len(page.tags))
        page.inside.append([])
        page.tags.append(tag)
        page.parents.append(stack[-1])
        attributes = m[3] or m[6] or ""
        page.attributes.append(attributes)
        page.names.append(_names(attributes) if attributes else frozenset())
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCK and tag not in RAW):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = close.end() if close else end
            continue
        stack.append(len(page.tags) - 1)
        open_count[tag] = open_count.get(tag, 0) + 1
    pop_to(1)
    flush()
    return page


def _names(attributes: str) -> frozenset[str]:
    """Classes and ids in lower case, as words joined by hyphens; ids begin with ``#``, roles and ``hidden`` with ``:``."""
    out = set()
    for m in _ATTRIBUTE.finditer(attributes):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden":
            out.add(":hidden")
        elif kind == "role":
            out.update(f":{x}" for x in value.lower().split())
        else:
            out.update(("#" if kind == "id" else "") + "-".join(_NAME.findall(x)).lower() for x in value.split())
    return frozenset(out)


def _named(names: frozenset[str], listed: frozenset[str], ids: bool = True) -> bool:
    """Whether one of the names is made of listed words, and of such that say only where and how."""
    for name in names:
        if name.startswith(":") or (name.startswith("#") and not ids):
            continue
        words = name.lstrip("#").split("-")
        if any(w in listed for w in words) and all(w in listed or w in BESIDE for w in words):
            return True
    return False


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


@dataclass
class Reading:
    """What the markup says about the elements of a page: gone, inside an article, able to be a template."""

    gone: list[bool]
    heading_only: list[bool]
    inside: list[bool]
    template: list[bool]


def read_markup(page: Page) -> Reading:
    n = len(page.tags)
    holds = [False] * n  # an article or main element inside
    mains = [t in ("article", "main") or ":main" in names for t, names in zip(page.tags, page.names, strict=True)]
    for e in range(n - 1, 0, -1):
        if mains[e] or holds[e]:
            holds[page.parents[e]] = True
    gone, inside, heading_only = [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        parent, tag, names = page.parents[e], page.tags[e], page.names[e]
        inside[e] = inside[parent] or mains[e]
        heading_only[e] = heading_only[parent]
        if gone[parent] or tag in DROPPED or ":hidden" in names or names & DROPPED_ROLES:
            gone[e] = True
        elif tag in ("html", "body") or (holds[e] and not inside[parent]):
            pass
        elif mains[e]:
            gone[e] = _named(names, OTHER_ARTICLES)
        elif tag == "header" or _named(names, HEADER_NAMES):
            # The head of an article holds its heading; any other header is the site's.
            gone[e], heading_only[e] = not inside[parent], True
        elif not inside[parent]:
            gone[e] = _named(names, DROPPED_NAMES) or tag == "button"
        elif tag in CONTAINERS:
            # Inside the article names decide on containers only; paragraphs, items and phrases are its text.
            gone[e] = _named(names, DROPPED_NAMES, ids=tag != "section") or (tag == "section" and _named(names, SECTION_IDS))
    main = any(m and not g for m, g in zip(mains, gone, strict=True))
    # What an article is in is no template as a whole.
    template = [e > 0 and not mains[e] and not (main and holds[e]) and page.tags[e] not in ("html", "body") and page.tags[e] in (CONTAINERS if inside[e] else BLOCK) for e in range(n)]
    return Reading(gone, heading_only, inside, template)


def subtree_hashes(page: Page, seed: int) -> list[int]:
    """The hash of every element with all it holds: tag, classes, texts with white space as one space, children in order."""
    import xxhash

    out = [0] * len(page.tags)
    for e in range(len(page.tags) - 1, -1, -1):
        parts = [page.tags[e], " ".join(sorted(x for x in page.names[e] if x[:1] not in "#:"))]
        for x in page.inside[e]:
            parts.append(f"<{out[x]:x}" if isinstance(x, int) else " ".join(x.split()))
        out[e] = xxhash.xxh3_64_intdigest("\n".join(p for p in parts if p), seed=seed)
    return out


def _within(page: Page, e: int, tags: frozenset[str]) -> bool:
    while e > 0:
        if page.tags[e] in tags:
            return True
        e = page.parents[e]
    return False


def blocks_and_keys(url: str | None, source: str | None) -> list[tuple[str, list[int]]]:
    """The blocks that the markup leaves, each with the keys of the subtrees that hold it and may be templates."""
    return [(text, keys) for text, keys in read_page(url, source)[0] if text is not None]


def _key(hash64: int, small: bool = False) -> int:
    """A hash as a signed number; the lowest bit tells the keys of small pieces (items, cells, paragraphs) from others."""
    return (((hash64 & ~1) | small) ^ (1 << 63)) - (1 << 63)


def read_page(url: str | None, source: str | None) -> tuple[list[tuple[str | None, list[int]]], int]:
    """All blocks with the keys of subtrees that hold them and may be templates, and a hash of the main text.

    The text is None where the markup says that the block is no text of the page. The main text is that inside articles,
    of a page without one all that the markup leaves.
    """
    import xxhash

    page = parse(source or "")
    says = read_markup(page)
    seed = xxhash.xxh3_64_intdigest(host_of(url))
    hashes = subtree_hashes(page, seed)
    found = []
    for block in page.blocks:
        own = [(t, e) for t, e in block if not says.gone[e] and (not says.heading_only[e] or _within(page, e, HEADINGS))]
        text = " ".join("".join(t for t, _ in own).split()) or None
        of = [e for t, e in (own if text else block) if not t.isspace()]
        if of:
            common, e = [], of[0]
            while e > 0:
                if says.template[e]:
                    common.append(e)
                e = page.parents[e]
            for other in of[1:]:
                above = set()
                while other > 0:
                    above.add(other)
                    other = page.parents[other]
                common = [x for x in common if x in above]
            found.append((text, common, says.inside[of[0]], " ".join("".join(t for t, _ in block).split())))
    main = any(inside for text, _, inside, _ in found if text)
    out = []
    for text, common, inside, whole in found:
        keys = [_key(hashes[e], not main and page.tags[e] not in CONTAINERS) for e in common]
        if not keys and not inside:  # loose text is a subtree by itself
            keys = [_key(xxhash.xxh3_64_intdigest(f"#text\n{whole}", seed=seed), not main)]
        out.append((text, keys))
    own_text = "\n".join(text for text, _, inside, _ in found if text and (inside or not main))
    return out, _key(xxhash.xxh3_64_intdigest(own_text))


def _parsed(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """Every page with its blocks, their keys, hashes of host, page and main text; ``open`` if a key holds text that stays.

    Parsing is the dearest step, so its result is stored.
    """
    three = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"))
    key_type = three.schema["key"].dataType
    shape = f"key {key_type.simpleString()}, url string, host long, page long, main long, blocks array<struct<text:string,keys:array<long>>>, open boolean"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark.sql.pandas.types import to_arrow_type

        block = pa.list_(pa.struct([("text", pa.string()), ("keys", pa.list_(pa.int64()))]))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                urls, sources = part.column(1).to_pylist(), part.column(2).to_pylist()
                found = [read_page(u, s) for u, s in zip(urls, sources, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(to_arrow_type(key_type)), part.column(1).cast(pa.string()),
                        pa.array([_key(xxhash.xxh3_64_intdigest(host_of(u))) for u in urls], pa.int64()),
                        pa.array([_key(xxhash.xxh3_64_intdigest(f"{u}\n{s}")) for u, s in zip(urls, sources, strict=True)], pa.int64()),
                        pa.array([main for _, main in found], pa.int64()),
                        pa.array([[{"text": t, "keys": k} for t, k in blocks] for blocks, _ in found], block),
                        pa.array([any(k and t is not None for t, k in blocks) for blocks, _ in found]),
                    ],
                    ["key", "url", "host", "page", "main", "blocks", "open"],
                )

    return materialise(three.mapInArrow(read, shape), "html-blocks")


def _templates(parsed: DataFrame, min_pages: int, share: float) -> DataFrame:
    """``(host, subtree, texts, pages)``: recurring subtrees, the different main texts and the pages that they are on."""
    subtrees = parsed.select("host", "main", F.explode(F.array_distinct(F.flatten(F.col("blocks.keys")))).alias("subtree"))
    beside = subtrees.groupBy("host", "subtree", "main").agg(F.count(F.lit(1)).alias("n"))
    counted = beside.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("pages")).where(F.col("texts") >= min_pages)
    small = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    of_host = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    return counted.join(of_host, "host").where(~small | (F.col("pages") >= share * F.col("all_pages"))).drop("all_pages")


def templates(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """The templates by which ``extract`` works, by hashes of host and subtree: ``(host, subtree, texts, pages)``."""
    return _templates(_parsed(pages, key, url, source), min_pages, share)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = 5, share: float = 0.1) -> DataFrame:
    """The key, the url, ``text`` and ``n_chars`` of every row.

    Null or empty pages give an empty text; a null url counts as the host without a name. Repeated rows stay, each with its
    text. A subtree is a template if it is on pages of its host with ``min_pages`` different main texts, so copies of a page
    keep theirs. Items, cells, paragraphs and loose text of pages without an article, where a short one may recur by
    chance, must also be on at least ``share`` of the host's pages. Less than ``min_pages`` pages of a host tell nothing;
    there, and beside that, blocks go that the markup names. An empty table gives an empty table.

    Pages are parsed once. All their subtrees are counted, those that the markup names too; only blocks of pages on which
    a template may hold text that the markup leaves are shuffled, to meet their templates.
    """
    parsed = _parsed(pages, key, url, source)
    text = lambda blocks: F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), "\n")
    result = lambda df: df.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
    opened = parsed.where("open")
    subtrees = opened.select("key", "page", F.explode(F.array_distinct(F.flatten(F.col("blocks.keys")))).alias("subtree"))
    recurring = subtrees.join(_templates(parsed, min_pages, share).select("subtree"), "subtree", "left_semi")
    gone = recurring.groupBy(F.col("key").alias("own_key"), F.col("page").alias("own_page")).agg(F.collect_set("subtree").alias("gone"))
    joined = opened.select("key", "url", "page", "blocks").join(gone, F.col("key").eqNullSafe(F.col("own_key")) & (F.col("page") == F.col("own_page")), "left")
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["keys"], F.coalesce(F.col("gone"), F.array().cast("array<long>"))))
    plain = parsed.where("NOT open").withColumn("text", text(F.col("blocks")))
    return result(plain).unionByName(result(joined.withColumn("text", text(left))))
