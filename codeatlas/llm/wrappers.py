"""Main text of pages by inferred wrappers (operator 8).

A wrapper is a union-free regular expression over a host's pages: a sequence of
block tokens (the element path of a text block), in which groups may be optional
or repeated and each token holds a text slot. Inference folds the tandem repeats
of a page, then aligns the wrapper so far with the next page of the host: equal
tokens join (their slot becomes variable where texts differ), a repeated and a
single group join to a repeated one, and what only one side has becomes
optional. The order of a host's slots is learned from SAMPLE distinct pages.

Every page is then aligned with its host's wrapper: equal groups first (a folded
repeat of the page meets a repeated group), and between them the single tokens
of what is left, so that each block gets a slot, or its path where the wrapper
has none. On a page with an article element the slots inside it are the main
text. On a page without one they are the slots outside boilerplate elements that
are not mostly links, less the texts that are template: a text is template where
it stands in the same slot of at least MIN_CONSTANT distinct pages without an
article, and of half of those that have the slot. This is counted over all
distinct pages of the host, by (host, slot, text hash, page hash).

Pages are parsed once; blocks of pages without an article are written and judged
by DataFrame functions. A host's template texts are at most twice the blocks of
its mean page, as each takes half of the pages. Wrappers and template texts are
broadcast while their checked size is at most BROADCAST_BYTES; beyond that pages
meet them in a shuffled join whose hot hosts AQE splits. Of equal pages one
counts, so copies sway neither the wrapper nor the template.

Defined cases: null or empty html gives an empty text; a null url is a host of
its own; null and equal page ids are pages like others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.common import bounded_batches
from codeatlas.session import cut_table

SAMPLE = 12
BROADCAST_BYTES = 32 << 20
MAX_PERIOD = 6       # longest group that is folded to a repeat
MIN_CONSTANT = 3     # pages that must agree before a text counts as template
DEPTH = 6            # elements that a path names; a checksum stands for those above

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
SKIPPED = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "head", "template", "svg", "math", "object",
           "select", "button", "canvas", "audio", "video", "datalist"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"} | SKIPPED
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
                     "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "cookie", "cookies", "consent", "notice",
                     "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended",
                     "comment", "comments", "disqus", "replies", "reply", "discussion", "widget", "pagination", "pager", "toolbar", "search", "legal",
                     "disclaimer", "contentinfo", "complementary"}
NEGATIONS = {"no", "has", "with", "without"}  # "with-sidebar" names a layout around the article
ARTICLES = {"article", "main"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in RAW}
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Block:
    key: str       # path of elements, "article/p"
    text: str
    linked: float  # share of the text that is inside links
    drop: bool     # inside a boilerplate element
    main: bool     # inside an article or main element


def _element(name: str, attrs: str, in_article: bool) -> tuple[str, bool, bool]:
    """Path name of a block element, whether it is boilerplate, whether an article."""
    marks: list[str] = []
    hidden, article = False, name in ARTICLES
    for key, *values in _ATTR.findall(attrs) if attrs.strip() else ():
        value = next((v for v in values if v), "")
        if key.lower() in ("class", "id", "role"):
            marks += value.lower().split()
        article = article or key.lower() == "role" and value.lower().strip() == "main"
        hidden = hidden or key.lower() == "hidden" or key.lower() == "aria-hidden" and value.lower() == "true"
    parts = [re.split(r"[-_]+", m) for m in marks]
    named = [p for p in parts if p[0] in BOILERPLATE_WORDS or p[-1] in BOILERPLATE_WORDS and p[0] not in NEGATIONS]
    bad = name in BOILERPLATE or hidden or name == "header" and not in_article or "header" in marks and not in_article
    if named and name not in ("html", "body", "article", "main"):
        bad = True
    return name + "".join("." + re.sub(r"\d+", "0", m) for m in marks) + ".hidden" * hidden, bad, article


def parse(page: str) -> list[Block]:
    """Text blocks of a page in order; tolerates unclosed and stray tags."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # name, path name, drop, main, checksum of the path
    text: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            drop, main = (stack[-1][2], stack[-1][3]) if stack else (False, False)
            path = [s for s in stack if s[0] not in ("html", "body")]
            above = f"{path[-1 - DEPTH][4]:08x}/" if len(path) > DEPTH else ""
            blocks.append(Block(above + "/".join(s[1] for s in path[-DEPTH:]), joined, min(1.0, linked / len(joined)), drop, main))
        text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            part = entities.unescape(part)
            text.append(part)
            linked += len(part) if links else 0

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            add(page[at:])
            break
        add(page[at:tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        if page[tag.end() - 1] != ">":  # a tag that the page's end cuts off
            break
        name, closing = tag[2].lower(), bool(tag[1])
        if name in INLINE:
            links = max(0, links + (-1 if closing else 1)) if name == "a" else links
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
                links = 0
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):  # a new item ends the open one of its list or row
            alike = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
                if stack[i][0] in alike:
                    del stack[i:]
                    if name != "tr":
                        break
        drop, main = (stack[-1][2], stack[-1][3]) if stack else (False, False)
        path, bad, article = _element(name, tag[3], main)
        stack.append((name, path, drop or bad, main or article, zlib.crc32(path.encode("utf-8", "surrogatepass"), stack[-1][4] if stack else 0)))
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            stack.pop()
            at = end.start() if end else len(page)
    flush()
    return blocks


@dataclass
class Node:
    """A token (``key``) with its slot, or a group (``parts``)."""
    key: str = ""
    parts: list["Node"] = field(default_factory=list)
    repeated: bool = False
    optional: bool = False
    text: str | None = None  # of all samples, None once they differ
    seen: int = 0
    linked: float = 0.0
    drop: bool = False
    main: bool = False
    at: list[int] = field(default_factory=list)  # its blocks of the page

    def shape(self) -> str:
        return self.key if not self.parts else "(" + " ".join(p.shape() for p in self.parts) + ")"

    def leaves(self) -> Iterator["Node"]:
        if not self.parts:
            yield self
        for p in self.parts:
            yield from p.leaves()


def fold_repeats(nodes: list[Node]) -> list[Node]:
    """Tandem repeats as repeated groups, shortest period first."""
    for period in range(1, MAX_PERIOD + 1):
        shapes = [n.shape() for n in nodes]
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            j = i + period
            while shapes[j:j + period] == shapes[i:i + period] and j + period <= len(nodes):
                j += period
            if j == i + period:
                out.append(nodes[i])
                i += 1
                continue
            first = nodes[i] if period == 1 else Node(parts=nodes[i:j][:period])
            for k in range(i + period, j, period):
                again = nodes[k] if period == 1 else Node(parts=nodes[k:k + period])
                absorb(first, again, same_page=True)
            first.repeated = True
            out.append(first)
            i = j
        nodes = out
    return nodes


def absorb(into: Node, other: Node, same_page: bool = False) -> None:
    """Join two nodes of the same shape: slots that differ become variable."""
    into.repeated |= other.repeated
    into.optional |= other.optional
    if into.parts:
        for a, b in zip(into.parts, other.parts):
            absorb(a, b, same_page)
        return
    if into.text != other.text:
        into.text = None
    into.linked = (into.linked * max(1, into.seen) + other.linked * max(1, other.seen)) / (max(1, into.seen) + max(1, other.seen))
    into.seen = max(into.seen, other.seen) if same_page else into.seen + other.seen
    into.drop |= other.drop
    into.main |= other.main
    if same_page:
        into.at += other.at


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two shape lists, as index pairs. A row of
    the table is one integer with a bit for each shape of ``b``, so that pages
    of many blocks fit in memory."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    places: dict[str, int] = {}
    for j, shape in enumerate(y):
        places[shape] = places.get(shape, 0) | 1 << j
    # bit j of a row is 0 where the common length grows from y[:j] to y[:j + 1]
    full = row = (1 << len(y)) - 1
    rows = []
    for shape in x:
        hit = row & places.get(shape, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    inner = []
    i, j = len(x), len(y)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            inner.append((lo + i, lo + j))
    return [(k, k) for k in range(lo)] + inner[::-1] + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def tokens(blocks: list[Block]) -> list[Node]:
    return [Node(b.key, text=b.text, seen=1, linked=b.linked, drop=b.drop, main=b.main, at=[i]) for i, b in enumerate(blocks)]


def infer(pages: list[list[Block]]) -> list[Node]:
    """The wrapper of a host from its sample pages."""
    wrapper: list[Node] = []
    for n, blocks in enumerate(pages):
        page = fold_repeats(tokens(blocks))
        if n == 0:
            wrapper = page
            continue
        merged: list[Node] = []
        i = j = 0
        for x, y in [*align([w.shape() for w in wrapper], [p.shape() for p in page]), (len(wrapper), len(page))]:
            for lone in wrapper[i:x] + page[j:y]:
                lone.optional = True
                merged.append(lone)
            if x < len(wrapper) and y < len(page):
                absorb(wrapper[x], page[y])
                merged.append(wrapper[x])
            i, j = x + 1, y + 1
        wrapper = fold_repeats(merged)
    return wrapper


def expression(wrapper: list[Node]) -> str:
    """The wrapper written as a regular expression without unions."""
    def one(n: Node) -> str:
        body = "(" + " ".join(map(one, n.parts)) + ")" if n.parts else f"<{n.key}>" + ("#" if n.text is None else "=")
        return body + "+" * n.repeated + "?" * n.optional
    return " ".join(map(one, wrapper))


def compiled(pages: list[str]) -> str:
    """A host's wrapper as JSON: shapes of its nodes in order, the slots of each
    node, and of each slot its path and whether it is main text on a page with an
    article (``main``) and on one without (``plain``)."""
    wrapper = infer([p for p in map(parse, pages) if p])
    leaves = [leaf for node in wrapper for leaf in node.leaves()]
    slots, n = [], 0
    for node in wrapper:
        size = sum(1 for _ in node.leaves())
        slots.append(list(range(n, n + size)))
        n += size
    return json.dumps({"shapes": [node.shape() for node in wrapper], "expression": expression(wrapper), "slots": slots,
                       "paths": [leaf.key for leaf in leaves], "main": [leaf.main and not leaf.drop for leaf in leaves],
                       "plain": [not leaf.drop and leaf.linked < 0.5 for leaf in leaves]}, sort_keys=True)


def placed(blocks: list[Block], wrapper: dict | None) -> list[int | None]:
    """Slot of each block: of equal groups first, then of the single tokens that
    lie between them; None where the wrapper has no place for it."""
    found: list[int | None] = [None] * len(blocks)
    if not wrapper:
        return found

    def give(slots: list[int], leaves: list[Node]) -> None:
        for slot, leaf in zip(slots, leaves):
            for i in leaf.at:
                found[i] = slot

    page = fold_repeats(tokens(blocks))
    x0 = y0 = 0
    for x, y in [*align(wrapper["shapes"], [n.shape() for n in page]), (len(wrapper["shapes"]), len(page))]:
        lone = [slot for slots in wrapper["slots"][x0:x] for slot in slots]
        left = [leaf for n in page[y0:y] for leaf in n.leaves()]
        pairs = align([wrapper["paths"][slot] for slot in lone], [leaf.key for leaf in left]) if lone and left else []
        give([lone[a] for a, _ in pairs], [left[b] for _, b in pairs])
        if y < len(page):
            give(wrapper["slots"][x], list(page[y].leaves()))
        x0, y0 = x + 1, y + 1
    return found


def judged(page: str | None, wrapper: dict | None) -> tuple[bool, list[tuple[str, str]]]:
    """Whether the page has an article, and (slot, text) of its blocks that are
    main text by their slots, in page order."""
    blocks = parse(page or "")
    article = any(b.main and not b.drop for b in blocks)
    out = []
    for b, slot in zip(blocks, placed(blocks, wrapper)):
        if slot is not None:
            good = wrapper["main" if article else "plain"][slot] and not b.drop
        else:
            good = not b.drop and (b.main if article else b.linked < 0.5)
        if good:
            out.append((f"~{b.key}" if slot is None else str(slot), b.text))
    return article, out


def extract(page: str | None, wrapper: dict | None, template: frozenset[tuple[str, str]] = frozenset()) -> str:
    """Main text of a page; ``template``: its host's template texts as (slot, text)."""
    article, found = judged(page, wrapper)
    return " ".join(text for slot, text in found if article or (slot, text) not in template)


def host(url: str) -> Column:
    """Host of a url in lower case ('' for null and for urls without one)."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _number(*parts: str) -> int:
    """64 bits of a hash over the parts, as a signed long."""
    made = hashlib.blake2b(digest_size=8)
    for part in parts:
        data = part.encode("utf-8", "surrogatepass")
        made.update(len(data).to_bytes(8, "little") + data)
    return int.from_bytes(made.digest(), "little", signed=True)


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, broadcast if its columns hold at most BROADCAST_BYTES."""
    size = df.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in df.columns), F.lit(16)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def infer_wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(w_host, wrapper) for every host, from ``sample`` distinct pages: those
    with the smallest hashes, which are chosen before any page is moved; equal
    pages become one in the tasks that read them."""
    keyed = pages.select(host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).withColumn("page", F.md5("html"))
    order = Window.partitionBy("host").orderBy("page")
    few = cut_table(keyed.select("host", "page").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample), "wrapper_pages")
    chosen = keyed.join(_bounded(few), ["host", "page"]).groupBy("host", "rank").agg(F.first("html").alias("html"))
    lists = chosen.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "html"))).alias("pages"))  # at most ``sample``

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hosts = batch.column(0).to_pylist()
            made = [compiled([x["html"] for x in batch.column(1)[i].as_py()]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(made, pa.string())], ["w_host", "wrapper"])

    return lists.mapInArrow(learn, "w_host string, wrapper string")


def template_texts(blocks: DataFrame) -> DataFrame:
    """(t_host, template) from rows (host, page, blocks): the hashes of each
    host's template texts, at most two for each block of a mean page."""
    one = blocks.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.slot", "b.hash")
    texts = one.distinct().groupBy("host", "slot", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONSTANT)
    slots = one.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("pages"))
    return (texts.join(slots, ["host", "slot"]).where(2 * F.col("n") >= F.col("pages"))
            .groupBy(F.col("host").alias("t_host")).agg(F.collect_set("hash").alias("template")))


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages)
    wrappers = cut_table(infer_wrappers(pages, sample), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host("url").alias("host"), F.md5(F.coalesce("html", F.lit(""))).alias("page"))
    met = rows.join(_bounded(wrappers), F.col("host") == F.col("w_host"), "left")
    block = pa.list_(pa.struct([("slot", pa.int64()), ("hash", pa.int64()), ("text", pa.string())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, dict] = {}
        for batch in it:
            texts: list[str | None] = []
            blocks: list[list[dict] | None] = []
            for page, spec in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                if spec is not None and spec not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[spec] = json.loads(spec)
                article, found = judged(page, made.get(spec))
                texts.append(" ".join(text for _, text in found) if article else None)
                blocks.append(None if article else [{"slot": _number(slot), "hash": _number(slot, text), "text": text} for slot, text in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(texts, pa.string()), pa.array(blocks, block)],
                                             ["page_id", "url", "host", "page", "text", "blocks"])

    kind = "page_id long, url string, host string, page string, text string, blocks array<struct<slot: long, hash: long, text: string>>"
    parsed = cut_table(met.select("page_id", "url", "host", "page", "html", "wrapper").mapInArrow(run, kind), "page_blocks")
    template = cut_table(template_texts(parsed.where("blocks is not null")), "page_template")
    kept = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("template", b["hash"]), F.lit(False)))
    text = F.coalesce("text", F.array_join(F.transform(kept, lambda b: b["text"]), " "))
    return (parsed.join(_bounded(template), F.col("host") == F.col("t_host"), "left").select("page_id", "url", text.alias("text"))
            .withColumn("n_chars", F.char_length("text").cast("long")))
