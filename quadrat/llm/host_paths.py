"""Main text of web pages by consensus on container paths per host.

Method. A page is read once, tag by tag, into containers (article, section,
div, ...) named by their generalised path: the tags and classes from the body
down, digits replaced. A container scores the text of its own blocks that is
not in links, and a share of what its children score; articles and bodies of
text by name count more, and nothing inside menus, headers, footers, sidebars,
notices, adverts, forms and comments counts. A form, or a container that only its name makes
furniture, is taken back where nearly all text of the page stands in it (wrappers of whole pages);
names after has, no, with or without say nothing. Each page votes for the path of
its best container; votes are summed per host in Spark, and every page is
extracted anew from the containers at its host's winning path. A page that
lacks it uses its own best container.

Rows. A null, empty or unreadable page has the empty text. A null url is a
host of its own kind. Repeated rows vote and are extracted each. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of
from quadrat.storage import settle

# Element names by their role.
CONTAINERS = frozenset("html body main article section div aside nav header footer form ul ol dl table tbody tr td th "
                       "figure fieldset details dialog menu center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote hr figcaption caption thead tfoot "
                                "address summary legend option title head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select button title object canvas math "
                "audio video".split())
LEFT_OUT = frozenset("nav header footer aside menu dialog fieldset".split())
# Elements whose text runs to the end of the page where they are not closed.
ENDLESS = frozenset("script style textarea iframe title".split())
# Cells and rows of tables, and what a new one closes.
CLOSED_BY = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("tbody", "tr", "td", "th")}
# Parts of class and id names of what is not the article, and of what is.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
                      "comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal "
                      "nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
                      "promotion recommended related replies reply respond responses share sharing sidebar signup skip "
                      "social sponsor sponsored subscribe subscription toolbar widget widgets alert".split())
ARTICLE = frozenset("article body content entry main post story text".split())
# Names that are never taken back, and words that turn the next one around.
READERS = frozenset("comment comments commentlist disqus replies reply respond responses".split())
TURNED = frozenset("has no not with without".split())
#: A container is taken back if it holds that many characters, and that many times those left outside.
TAKEN_BACK, TIMES = 200, 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.I)
_PARTS = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass
class Container:
    path: str
    tag: str
    parent: int
    out: bool
    weight: float
    soft: bool = False  # left out by its name only
    own: int = 0
    blocks: list[tuple[int, str]] = field(default_factory=list)


def furniture(names: dict[str, str]) -> tuple[bool, bool, set[str]]:
    """Whether class and id name furniture, and readers' comments; and all parts of the names."""
    parts, said = set(), set()
    for value in names.values():
        for name in value.split():
            own = [x for x in _PARTS.split(name) if x]
            parts.update(own)
            said.update(x for before, x in zip(["", *own], own) if before not in TURNED)
    return bool(said & FURNITURE), bool(said & READERS), parts


def settled(found: list[Container], readers: set[int]) -> list[Container]:
    """Decide which containers left out by name are taken back; ``out`` then holds for all below what stays out.

    From the page down: one that holds nearly all of the text counted so far and its own is taken back, and
    those in it are looked at in turn.
    """
    inside = [0] * len(found)  # text at and below, without readers' comments and what tags leave out
    for i in range(len(found) - 1, -1, -1):
        c = found[i]
        inside[i] += 0 if c.out else c.own
        if c.parent >= 0 and i not in readers:
            inside[c.parent] += inside[i]
    soft = [False] * len(found)
    for i, c in enumerate(found):
        soft[i] = c.soft or (c.parent >= 0 and soft[c.parent])
    kept = sum(c.own for i, c in enumerate(found) if not c.out and not soft[i])
    for i, c in enumerate(found):
        above = c.parent >= 0 and found[c.parent].out
        if c.soft and not c.out and not above and i not in readers and inside[i] >= max(TAKEN_BACK, TIMES * kept):
            c.soft = False
            # what is in it and under no other name counts now
            clear = {i}
            for j in range(i + 1, len(found)):
                if found[j].parent in clear and not found[j].soft:
                    clear.add(j)
            kept += sum(found[j].own for j in clear if not found[j].out)
        c.out = c.out or above or c.soft
    for c in found:
        if c.out:
            c.blocks, c.own = [], 0
    return found


def read_page(page: str) -> list[Container]:
    """Containers in page order; blocks are (position in the page, text) of what is not left out."""
    found = [Container("", "", -1, False, 1.0)]
    stack, links, linked, words, block = [0], 0, 0, [], 0
    readers: set[int] = set()

    def flush():
        nonlocal linked, words, block
        text = " ".join("".join(words).split())
        own = found[stack[-1]]
        if text and not own.out:
            own.blocks.append((block, text))
            own.own += max(0, len(text) - linked)
        block += 1
        words, linked = [], 0

    def add(text: str):
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        words.append(text)
        if links:
            linked += len(text)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag == "br":
            words.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                end = _END[tag].search(page, at)
                if end or tag in ENDLESS:
                    at = end.start() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
        if tag not in CONTAINERS:
            continue
        if closing:
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if found[stack[i]].tag == tag), 0)
            if open_at:
                del stack[open_at:]
        elif not rest.endswith("/") or tag not in VOID:
            if tag in CLOSED_BY:
                table = next((i for i in range(len(stack) - 1, 0, -1) if found[stack[i]].tag == "table"), 0)
                ends = next((i for i in range(table + 1, len(stack)) if found[stack[i]].tag in CLOSED_BY[tag]), None)
                if ends is not None:
                    del stack[ends:]
            names = {k.lower(): html.unescape(v.strip("\"'")).lower() for k, v in _NAMES.findall(rest)}
            classes = _DIGITS.sub("#", ".".join(sorted(names.get("class", "").split())))
            named, by_readers, parts = furniture(names)
            above = found[stack[-1]]
            whole = tag in ("html", "body")
            weight = 2.0 if tag == "article" else 1.5 if tag == "main" else 1.3 if parts & ARTICLE else 1.0
            step = f"{above.path}/{tag}{'.' if classes else ''}{classes}"
            path = above.path if whole else xxhash.xxh64_hexdigest(step)  # paths of deep pages stay short
            found.append(Container(path, tag, stack[-1], above.out or tag in LEFT_OUT, weight, not whole and (named or tag == "form")))
            if by_readers and not whole:
                readers.add(len(found) - 1)
            stack.append(len(found) - 1)
    flush()
    return settled(found, readers)


def best_path(found: list[Container]) -> tuple[str, float]:
    """Path and score of the best container."""
    total = [float(c.own) for c in found]
    for i in range(len(found) - 1, 0, -1):
        total[found[i].parent] += 0.6 * total[i]
    score, i = max((t * c.weight, -i) for i, (t, c) in enumerate(zip(total, found)))
    return found[-i].path, score


def text_at(found: list[Container], path: str) -> str | None:
    """Blocks in page order of the containers at ``path`` and all in them; None if there are none."""
    inside = [c.path == path and not c.out for c in found]
    if not any(inside):
        return None
    for i, c in enumerate(found):
        if c.parent >= 0 and inside[c.parent]:
            inside[i] = True
    return "\n\n".join(t for _, t in sorted(b for i, c in enumerate(found) if inside[i] for b in c.blocks))


def host(url: str = "url"):
    return F.lower(F.regexp_extract(url, _HOST, 1))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes, score of every page's best container, summed."""
    def make():
        def rows(batch):
            for of, page in zip(batch["host"], batch["html"]):
                path, score = best_path(read_page(page or ""))
                if score > 0:
                    yield of, path, score
        return rows
    ballots = map_rows(pages.select(host().alias("host"), "html"), T.StructType([
        T.StructField("host", T.StringType()), T.StructField("path", T.StringType()),
        T.StructField("score", T.DoubleType())]), make, 128)
    return ballots.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))


def winners(ballots: DataFrame) -> DataFrame:
    """host, path with most votes; then the higher score, then the first path."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.round("score", 3)), "path")
    return ballots.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    won = settle(winners(votes(pages)), "paths")
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(
        won, "host", "left")

    def make():
        def read(batch):
            for page_id, url, page, path in zip(*[batch[c] for c in ("page_id", "url", "html", "path")]):
                found = read_page(page or "")
                text = text_at(found, path) if path is not None else None
                if not text:
                    text = text_at(found, best_path(found)[0]) or ""
                yield page_id, url, text, len(text)
        return read
    return map_rows(rows.select("page_id", "url", "html", "path"), schema_of(
        pages, "page_id", "url", text=T.StringType(), n_chars=T.LongType()), make, 128)
