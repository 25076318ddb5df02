"""Main text of pages by consensus paths of their host.

Every page scores its containers: paragraph-like blocks give their container a score for length and commas, lowered by the
share of link text, and half of it to the container above. The best container votes for its generalised path (tags with
classes, numbers made equal). Spark counts the votes by (host, path), a combining aggregate, and the path with most votes
wins the host. A second pass extracts each page below the elements on the winning path; a page without such an element uses
its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by element, role and class; a class alone leaves out neither the article, what holds it, nor most of a page's text.

The winners are broadcast up to ``MAX_HOSTS`` hosts and ``MAX_BYTES`` of hosts and paths; beyond it, pages and winners are joined by a shuffle.

A null or empty html gives an empty text; a null url counts as the empty host; rows that share a page_id are extracted each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import xxhash

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import per_task, read
from mapweave.llm.url_filter import host_and_path
from mapweave.session import cut_lineage

MAX_HOSTS = 100_000
MAX_BYTES = 16 << 20  # of hosts and winning paths that are broadcast
# Fixed values of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong "
    "sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CONTAINERS = frozenset("article body div main section td".split())
LEFT_OUT = frozenset(
    "nav footer aside form button select option textarea head title dialog menu iframe object svg canvas audio video map noscript template".split()
)
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies "
    "respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
# A name like has-sidebar, site-with-nav, comments-open or sidebar-wrap tells of a state or of what is around.
STATE_BEFORE = frozenset("has no with without".split())
STATE_AFTER = frozenset("open closed wrap wrapper".split())
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|annotation-xml|annotation)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>"
    r"|</?[a-zA-Z][^>]*\Z",  # a tag that the page's end cuts off
    re.DOTALL | re.IGNORECASE,
)
SVG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.DOTALL | re.IGNORECASE
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
NUMBER = re.compile(r"[0-9]+")


@dataclass
class Page:
    """Elements that matter (parent, tag, step with classes, hash of the path, left out, inside an article) and text blocks.

    ``named`` holds elements that are left out by class or id alone, each with whether the words are those of comments.

    A block is (element, raw text, characters in links). Paths are kept as hashes, so deep pages stay linear.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["body"])
    step: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    out: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    named: dict[int, bool] = field(default_factory=dict)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path_of(self, element: int) -> str:
        steps = []
        while element > 0:
            steps.append(self.step[element])
            element = self.parent[element]
        return "/".join(reversed(steps))


def down(path: int, step: str) -> int:
    """Hash of a path from that of the path above and its last step."""
    return xxhash.xxh64_intdigest(step.encode(), seed=path)


def boilerplate_words(value: str) -> set[str]:
    """The words of a class or id that mean boilerplate."""
    found = set()
    for name in value.split():
        words = [word.lower() for word in WORD.findall(name)]
        for at, word in enumerate(words):
            if word in LEFT_OUT_WORDS and not STATE_BEFORE.intersection(words[:at]) and not STATE_AFTER.intersection(words[at + 1 :]):
                found.add(word)
    return found


def boilerplate(attributes: str) -> tuple[bool, set[str], str]:
    """Whether role or hidden say that an element is no article text; the words of class and id that do; the generalised classes."""
    out, words, classes = False, set(), ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden":
            out = True
        elif name == "role":
            out = out or value.strip().lower() in LEFT_OUT_ROLES
        else:
            words |= boilerplate_words(value)
            if name == "class":
                classes = ".".join(sorted(NUMBER.sub("#", value.lower()).replace("/", "_").split()))
    return out, words, classes


def without_named(page: Page):
    """Leave out what is named as boilerplate, unless it holds the article or most of the page's text.

    The article is in the article and main elements with text that have the fewest named elements around them. A page with
    none keeps named elements that hold most of the text outside links; of comments, only those that hold nearly all.
    """
    if not page.named:
        return
    weight, around = [0] * len(page.tag), [0] * len(page.tag)
    for element, text, linked in page.blocks:
        weight[element] += max(0, len(text.strip()) - linked)
    for element in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[element]] += weight[element]
    for element in range(1, len(page.tag)):
        around[element] = around[page.parent[element]] + (element in page.named)
    articles = [e for e in range(1, len(page.tag)) if weight[e] and page.tag[e] in ("article", "main")]
    holders, fewest = set(), min((around[e] for e in articles), default=0)
    for element in articles:
        above = page.parent[element]
        while around[element] == fewest and above > 0 and above not in holders:
            holders.add(above)
            above = page.parent[above]
    if not articles:
        holders = {e for e, comments in page.named.items() if 10 * weight[e] > (9 if comments else 5) * weight[0]}
    for element in range(1, len(page.tag)):
        page.out[element] = page.out[element] or element in page.named and element not in holders or page.out[page.parent[element]]
    page.blocks = [block for block in page.blocks if not page.out[block[0]]]


def drawings(source: str) -> dict[int, int]:
    """Where the drawing that begins at a place ends. One that is closed in its own tag or nowhere is that tag alone."""
    ends, begun = {}, []
    for found in SVG.finditer(source):
        if found.group(2) is None:
            continue
        if found.group(2):
            if begun:
                ends[begun.pop()] = found.end()
        else:
            ends[found.start()] = found.end()
            if not found.group().endswith("/>"):
                begun.append(found.start())
    return ends


def parse(source: str) -> Page:
    """Elements and blocks of a page; unclosed and stray tags are tolerated as browsers do."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    buffer: list[str] = []
    open_tags: Counter = Counter()
    linked, at, drawn = 0, 0, None

    def close(depth: int):
        open_tags.subtract(name for name, _ in stack[depth:])
        del stack[depth:]

    def flush():
        nonlocal linked
        text = "".join(buffer)
        if text and not text.isspace():
            page.blocks.append((stack[-1][1], text, linked))
        buffer.clear()
        linked = 0

    while found := TAG.search(source, at):
        if found.start() > at and not page.out[stack[-1][1]]:
            buffer.append(source[at : found.start()])
            if open_tags["a"]:
                linked += found.start() - at
        at = found.end()
        tag = found.group(3)
        if tag is None:
            continue  # comments, scripts and the like
        tag, closing = tag.lower(), found.group(2)
        if tag == "svg":
            drawn = drawings(source) if drawn is None else drawn
            at = max(at, 0 if closing else drawn.get(found.start(), 0))
            continue
        if tag == "br":
            buffer.append(" ")
        if tag == "hr":
            flush()
        if tag in VOID:
            continue
        attributes = "" if closing else found.group(4)
        inline = tag in INLINE
        if not inline:
            flush()
        if closing:
            depth = len(stack) - 1
            while open_tags[tag] and stack[depth][0] != tag and not (inline and stack[depth][0] not in INLINE):
                depth -= 1
            if open_tags[tag] and stack[depth][0] == tag:
                close(depth)
            continue
        if not inline:
            # A paragraph ends where a block begins; items end where the next one begins.
            depth = len(stack) - 1
            while stack[depth][0] in INLINE:
                depth -= 1
            if stack[depth][0] == "p":
                close(depth)
            if tag in CLOSES_ITSELF:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag or (tag in ("dt", "dd") and stack[depth][0] in ("dt", "dd")):
                        close(depth)
                        break
                    if stack[depth][0] in CLOSES_ITSELF[tag]:
                        break
        above = stack[-1][1]
        out, words, classes = boilerplate(attributes) if attributes.strip() else (False, (), "")
        out = out or inline and bool(words)
        if inline and not out:
            stack.append((tag, above))
        else:
            inside = page.main[above]
            out = (out and tag not in ("html", "body")) or tag in LEFT_OUT or tag == "header" and not inside or page.out[above]
            step = f"{tag}.{classes}" if classes else tag
            page.parent.append(above)
            page.tag.append(tag)
            page.step.append(step)
            page.path.append(down(page.path[above], step))
            page.out.append(out)
            page.main.append(inside or tag in ("article", "main"))
            if words and not page.out[-1] and tag not in ("html", "body", "article", "main"):
                page.named[len(page.tag) - 1] = COMMENT_WORDS.issuperset(words)
            stack.append((tag, len(page.tag) - 1))
        open_tags[tag] += 1
    if at < len(source) and not page.out[stack[-1][1]]:
        buffer.append(source[at:])
    flush()
    without_named(page)
    return page


def best_container(page: Page) -> int:
    """The container with the highest score; of equal ones the first, that is the outer."""
    scores: dict[int, float] = {}
    for element, text, linked in page.blocks:
        while element and page.tag[element] not in CONTAINERS:
            element = page.parent[element]
        score = (1 + text.count(",") + len(text) / 100) * (1 - linked / len(text))
        scores[element] = scores.get(element, 0) + score
        above = page.parent[element]
        while above > 0 and page.tag[above] not in CONTAINERS:
            above = page.parent[above]
        if above >= 0:
            scores[above] = scores.get(above, 0) + score / 2
    bonus = {element: score * (2 if page.tag[element] in ("article", "main") else 1) for element, score in sorted(scores.items())}
    return max(bonus, key=bonus.get, default=0)


def text_below(page: Page, chosen: set[int]) -> str:
    """Blocks below any of the chosen elements: references decoded, white space made one space, joined in page order."""
    inside = [False] * len(page.tag)
    for element, parent in enumerate(page.parent):
        inside[element] = element in chosen or (parent >= 0 and inside[parent])
    blocks = (" ".join(html.unescape(text).split()) for element, text, _ in page.blocks if inside[element])
    return "\n\n".join(block for block in blocks if block)


def vote(source: str) -> str:
    page = parse(source)
    return page.path_of(best_container(page))


def extract(source: str, winner: str | None) -> str:
    page = parse(source)
    wanted = reduce(down, winner.split("/"), 0) if winner else None
    chosen = {element for element, path in enumerate(page.path) if path == wanted and not page.out[element]}
    return text_below(page, chosen or {best_container(page)})


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with most votes of each host; of equal ones the first by name."""

    def start():
        return lambda hosts, sources: [hosts, [vote(source or "") for source in sources]]

    votes = per_task(pages.select("host", "html"), "host string, path string", start).groupBy("host", "path").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(
    pages: DataFrame, max_hosts: int = MAX_HOSTS, max_bytes: int = MAX_BYTES, page_id: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's consensus) of every row."""
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    plain = plain.withColumn("host", host_and_path(F.col("url"))[0])
    winners = cut_lineage(host_paths(plain))
    hosts, held = winners.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 64), F.lit(0))).first()
    if hosts <= max_hosts and held <= max_bytes:
        winners = F.broadcast(winners)
    joined = plain.join(winners, "host", "left").select("page_id", "url", "html", "path")

    def start():
        def work(ids, urls, sources, paths):
            texts = [extract(source or "", path) for source, path in zip(sources, paths, strict=True)]
            return [ids, urls, texts, list(map(len, texts)), paths]

        return work

    return per_task(joined, "page_id long, url string, text string, n_chars long, path string", start)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
