"""Main text of web pages by templates deduced from the pages of a host.

Pages of a host share a template.  Its tokens - elements with their place in the page,
and text nodes - are found by their occurrence vectors: how often a token occurs on
each page of the host.  Tokens with equal vectors form an equivalence class; classes on
at least SUPPORT of the host's pages make the template.  They nest by the paths of their
elements, the wider class around the narrower, and what lies between them are slots.
The slot taken is the deepest container of a class of ones and zeros that holds nearly
all running text of the pages it is on.  Text nodes of the template's classes (notices)
are part of the template, not of a slot, and go class by class, the widest first, as
long as the page keeps other text.

Before any vector, elements that are navigation, adverts, forms, comments and the like
by tag, role or name are cut out (``_skipped``).  A name counts if all its parts are known
words (ad-box, not share-price), and names are not believed on a page that they would
leave without any text.  The order of a class's tokens on the
page is not checked; their paths stand for it.

Vectors are never built: a vector's fingerprint is the sum over pages of a hash of
(page, count), added up by (host, token) with map-side combining, so a host with a
third of all pages is no single task, and every page with running text counts.

Defined results: null or empty html gives an empty text; a null or odd url is a host
of its own (empty); a page without its host's slot falls back on its own article, main
or body; copies, which keep no text of their own, stay whole; repeated rows are extracted one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import _pieces, stored

#: Elements that start and end blocks, and those that hold no running text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
SKIPPED = frozenset("head nav footer aside form button select textarea iframe svg noscript template dialog object canvas audio video map menu title fieldset label input".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIPPED_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
CLOSES = {"p": BLOCKS - {"html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
VOID = frozenset("hr input img br meta link area base col embed source track wbr".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|xmp)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][-\w:]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|([^<]+|<)""", re.S | re.I)
ATTRIBUTE = re.compile(r"""([-\w:]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+")
#: Words that say nothing in a name beside one of the above.
NEUTRAL_NAMES = frozenset(
    "area article articles bar block bottom box button buttons container entry global group holder inner item items left link links list main outer page panel post posts primary right row secondary section site strip top unit wrap wrapper".split()
)
#: A slot holds at least this share of a page's text.
SLOT_SHARE = 0.9
#: A class is template from this share of the host's pages on; shares of text are in parts of WHOLE.
SUPPORT, WHOLE = 0.8, 1_000_000
HOST_PARTS = 64
#: Templates are broadcast up to so many bytes; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _skipped(tag: str, attributes: dict[str, str], in_article: bool) -> int:
    """0, or 1 if its tag, role or style says that an element is no running text, or 2 if only its name does."""
    if tag in SKIPPED or (tag == "header" and not in_article):
        return 1
    if not attributes:
        return 0
    if attributes.get("role", "").lower() in SKIPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 1
    if "none" in attributes.get("style", "") and re.search(r"display\s*:\s*none", attributes["style"]):
        return 1
    if tag in ("body", "html", "article", "main"):
        return 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = set(NAME.findall(name))
        if not SKIPPED_NAMES.isdisjoint(parts) and parts <= SKIPPED_NAMES | NEUTRAL_NAMES:
            return 2
    return 0


def _inline(tag: str) -> bool:
    return tag not in BLOCKS and tag not in SKIPPED


def parse(page: str) -> list[tuple[tuple[tuple[int, str], ...], str]]:
    """Elements and running text of a page; if nothing is left, names are not believed."""
    return _parse(page, 2) or _parse(page, 1)


def _parse(page: str, most: int) -> list[tuple[tuple[tuple[int, str], ...], str]]:
    """Elements and running text of a page, without elements skipped for reasons up to ``most``.

    Returns (open elements, text) for each block's text outside skipped elements; open
    elements are (number, path) pairs, outermost first.  A skipped element inside a line
    (a span, a link) ends with its own end tag or with the block around it, and does not
    break the line.
    """
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, number, skipped
    out: list[tuple[tuple, str]] = []
    run: list[str] = []
    number = 0

    def skips(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
        return 0 < _skipped(tag, attributes, in_article) <= most

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append((tuple((s[2], s[1]) for s in stack if not s[3]), text))

    for m in TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            if not (stack and stack[-1][3]):
                run.append(html_module.unescape(text) if "&" in text else text)
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if m.group(2):  # an end tag
            if _inline(tag):
                if not (stack and stack[-1][3] and any(s[0] == tag for s in stack)):
                    continue
            else:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        attributes = _attributes(m.group(4))
        if _inline(tag):
            # inside a skipped element its own kind is counted, so that the right end tag ends it
            if tag in VOID or not ((attributes and skips(tag, attributes, True)) or (stack and stack[-1][3] and any(s[0] == tag for s in stack))):
                continue
        else:
            flush()
            while stack:
                k = len(stack) - 1
                while k and _inline(stack[k][0]):
                    k -= 1
                if tag not in CLOSES.get(stack[k][0], ()):
                    break
                del stack[k:]
        if tag in VOID or m.group(4).endswith("/"):
            continue
        number += 1
        skipped = (bool(stack) and stack[-1][3]) or skips(tag, attributes, any(s[0] in ("article", "main") for s in stack))
        named = ".".join([tag, *sorted(NAME.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))])
        stack.append((tag, f"{stack[-1][1]}>{named}" if stack else named, number, skipped))
    flush()
    return out


def _hash(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"))


TOKENS = "host string, kind string, token string, a long, b long, pages long, times long, share long"


def _tokens():
    """Occurrences on each page, added up within a batch: (host, kind, token, vector sums, pages, times, shares of the pages' text)."""

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, "html", 4 << 20):
                sums: dict[tuple[str, str, str], list[int]] = {}

                def add(key, page, count, chars, total, sums=sums):
                    h = _hash(page, count)
                    s = sums.setdefault(key, [0, 0, 0, 0, 0])
                    s[0] += h >> 33
                    s[1] += h & 0x7FFFFFFF
                    s[2] += 1
                    s[3] += count
                    s[4] += chars * WHOLE // total

                for k, (url, page) in enumerate(zip(piece.column("url").to_pylist(), piece.column("html").to_pylist(), strict=True)):
                    host, this = host_of(url), _hash(url, piece.column("page_id")[k].as_py())
                    elements: dict[str, tuple[set, list]] = {}
                    texts: dict[str, int] = {}
                    runs = parse(page or "")
                    total = sum(len(text) for _, text in runs)
                    if not total:  # nothing that a template could hold
                        continue
                    for open_, text in runs:
                        texts[text] = texts.get(text, 0) + 1
                        for number, path in open_:
                            if path.rpartition(">")[2].partition(".")[0] in CONTAINERS:
                                seen, chars = elements.setdefault(path, (set(), [0]))
                                seen.add(number)
                                chars[0] += len(text)
                    add((host, "page", ""), this, 1, total, total)
                    for path, (seen, chars) in elements.items():
                        add((host, "element", path), this, len(seen), chars[0], total)
                    for text, count in texts.items():
                        add((host, "text", f"{_hash(text):016x}"), this, count, len(text) * count, total)
                rows = [(*k, *v) for k, v in sums.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "kind", "token", "a", "b", "pages", "times", "share"])

    return run


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, constant): the container of the running text, and hashes of the template's text nodes by class, the widest first."""
    found = stored(pages.mapInArrow(_tokens(), TOKENS).groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in ("a", "b", "pages", "times", "share")]))
    hosts = found.where("kind = 'page'").select("host", F.col("pages").alias("n"))
    # by parts of a host, so that a host with a third of all tokens is no single task
    parts = hosts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    tokens = found.where("kind <> 'page'").withColumn("part", F.pmod(F.xxhash64("token"), F.lit(HOST_PARTS)).cast("int")).join(parts, ["host", "part"]).where(F.col("pages") >= SUPPORT * F.col("n"))
    # a class holds the tokens of one vector; what is on a share of the pages is no more than a page's tokens over that share
    classes = tokens.groupBy("host", "a", "b", "pages").agg(
        F.max(F.when((F.col("kind") == "element") & (F.col("times") == F.col("pages")) & (F.col("share") >= SLOT_SHARE * WHOLE * F.col("pages")), F.struct(F.size(F.split("token", ">")).alias("depth"), "token"))).alias("top"),
        F.collect_set(F.when((F.col("kind") == "text") & (F.col("pages") > 1), F.col("token"))).alias("texts"),
    )
    slots = classes.where("top is not null").groupBy("host").agg(F.max("top").alias("top")).select("host", F.col("top.token").alias("slot"))
    constant = classes.where(F.size("texts") > 0).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pages", "a", "b", "texts")), asc=False).alias("nested")).select("host", F.col("nested.texts").alias("constant"))
    return hosts.select("host").join(slots, "host", "left").join(constant, "host", "left")


def text_of(page: str | None, slot: str | None, constant) -> str:
    """The running text of a page inside its slot, without the classes of ``constant`` that leave other text."""
    runs = parse(page or "")

    def inside(open_) -> bool:
        return any(path == slot for _, path in open_)

    chosen = [r for r in runs if inside(r[0])] if slot else []
    if not chosen:  # no template: the page's own article, main or body
        for tag in ("article", "main", "body"):
            chosen = [r for r in runs if any(path.rpartition(">")[2].partition(".")[0] == tag for _, path in r[0])]
            if chosen:
                break
        else:
            chosen = runs
    else:
        # the title of a page may stand in an article around the slot
        articles = {number for open_, _ in chosen for number, path in open_ if path.rpartition(">")[2].partition(".")[0] in ("article", "main")}
        if articles:
            chosen = [r for r in runs if inside(r[0]) or any(number in articles for number, _ in r[0])]
    kept = [t for _, t in chosen]
    if constant:
        hashes = {t: f"{_hash(t):016x}" for t in kept}
        for texts in constant:
            left = [t for t in kept if hashes[t] not in texts]
            if not left:  # all that is left belongs to this class: a copy of other pages
                break
            kept = left
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    found = stored(templates(pages))
    hashes = F.coalesce(F.aggregate("constant", F.lit(0), lambda s, x: s + F.size(x)), F.lit(0))
    size = F.octet_length("host") + F.coalesce(F.octet_length("slot"), F.lit(0)) + 24 * hashes + 64
    if (found.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        found = F.broadcast(found)

    def run(batches):
        for batch in batches:
            for piece in _pieces(batch, "html", 4 << 20):
                cols = [piece.column(c).to_pylist() for c in ("html", "slot", "constant")]
                texts = [text_of(page, slot, constant) for page, slot, constant in zip(*cols, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = with_host(pages).join(found, "host", "left").select("page_id", "url", "html", "slot", "constant")
    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def with_host(pages: DataFrame) -> DataFrame:
    """Pages with ``host`` (Arrow, as urls need the parser that the templates used)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("html"), pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())], names=["page_id", "url", "html", "host"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"page_id {kind}, url string, html string, host string")
