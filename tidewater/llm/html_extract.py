"""HTML extraction: a site style tree per host finds branches of low importance, and pages lose them."""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import checked, raw, slices, stash
from tidewater.llm.url_filter import split_url

#: A branch is noise if its importance is below LEAST and MIN_PAGES pages of its host have it.
LEAST, MIN_PAGES = 0.3, 4
#: How fast presentation gives way to content: presentation counts 1 - GAMMA ** (distinct presentations).
GAMMA = 0.9
#: Shares of a host in the shuffle that is taken where the rules are too many for a broadcast.
SALTS = 16

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that count beside an article.
LEADS = HEADINGS | {"p", "blockquote"}
TEXT_BLOCKS = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption table thead tbody tfoot tr td th section div".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: For each start tag, the open elements that it can close.
CLOSES: dict[str, set[str]] = {}
for _open, _tags in CLOSED_BY.items():
    for _t in _tags:
        CLOSES.setdefault(_t, set()).add(_open)
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl blockquote".split())
#: Elements, roles and words of class or id that mark what isn't the article. A class or id counts if
#: each of its words is one of these, or one that only says where or in what box it stands.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg math object canvas button input select textarea dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that mark what readers or advertisers add, whatever stands beside them, and words that only say that
#: there is such a thing; words of teasers, which count only where there is no other article; and words of leads.
ADDED_WORDS = frozenset("comment comments disqus replies advert adverts advertisement advertising sponsored".split())
STATE_WORDS = frozenset("allow allowed closed count disabled enabled free has no off on open supports with without".split())
TEASER_WORDS = frozenset("card cards teaser teasers preview previews tile tiles".split())
LEAD_WORDS = frozenset("abstract deck dek intro introduction lead lede standfirst subtitle summary".split())
PLACE_WORDS = frozenset("area bar block body bottom box button buttons container content form global group holder inner item items left link links list main mobile outer page panel primary right row section secondary site slot text thread top unit wrap wrapper".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW_TEXT}


class Element:
    __slots__ = ("tag", "label", "path", "prior", "article", "texts", "children")

    def __init__(self, tag: str, label: str, parent: Element | None, prior: bool):
        self.tag, self.label, self.prior = tag, label, prior
        self.path = path_id(b"" if parent is None else parent.path.to_bytes(8, "little", signed=True), label)
        self.article = tag in ("article", "main") or (parent is not None and parent.article)
        self.texts: list = []  # strings, elements and None for a boundary of blocks
        self.children: list[Element] = []


def path_id(above: bytes, label: str) -> int:
    """The id of a kind of branch: of the labels from the root down, each hashed into the id of what stands above."""
    return xxhash.xxh64_intdigest(above + label.encode("utf-8", "surrogatepass")) - (1 << 63)


def _says_noise(names: str) -> bool:
    for name in names.split():
        words = _WORDS.findall(name)
        if not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in PLACE_WORDS for w in words):
            return True
        if not ADDED_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words):
            return True
    return False


def _is_noise(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """The label of an element (tag and class), and whether it is known to be no content."""
    label, noise = tag, tag in NOISE_TAGS or (tag == "header" and not in_article)
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                if name == "class" and value.strip():
                    label = f"{tag}.{'.'.join(sorted(set(value.split())))}"
                if tag not in ("html", "body", "article", "main") and _says_noise(value):
                    noise = True
                elif tag == "article" and not {"comment", "comments", "reply", "replies", "ad", "advert", "sponsored"}.isdisjoint(_WORDS.findall(value)):
                    noise = True
            elif name == "role" and value in NOISE_ROLES:
                noise = True
    return label, noise


def parse(page: str) -> Element:
    """The element tree of a page. Broken markup is repaired as browsers do in the usual cases: open paragraphs, list
    items and cells end where the next begins, unknown end tags are passed over, what is open ends with the page."""
    root = Element("#", "#", None, False)
    stack = [root]
    open_tags: Counter[str] = Counter()

    def close(i: int) -> None:
        for e in stack[i:]:
            open_tags[e.tag] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].texts.append(page[at:end])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag in INLINE and stack[i].tag not in INLINE:
                        break
            if tag not in INLINE:
                stack[-1].texts.append(None)
            continue
        if tag == "br":
            stack[-1].texts.append(" ")
            continue
        if tag not in INLINE:
            if any(open_tags[t] for t in CLOSES.get(tag, ())):
                for i in range(len(stack) - 1, 0, -1):
                    if tag in CLOSED_BY.get(stack[i].tag, ()):
                        close(i)
                        break
                    if stack[i].tag in SCOPES:
                        break
            stack[-1].texts.append(None)
        parent = stack[-1]
        label, noise = _is_noise(tag, attributes, parent.article)
        if tag in VOID:
            continue
        if tag in RAW_TEXT:
            over = _RAW_END[tag].search(page, at)
            at = over.end() if over else n
            continue
        if attributes.endswith("/"):
            continue
        element = Element(tag, label, parent, noise)
        if tag not in INLINE or noise:
            parent.children.append(element)
        parent.texts.append(element)
        stack.append(element)
        open_tags[tag] += 1
    return root


def _pieces(root: Element, skip) -> list[str | None]:
    """Texts below an element in page order, None between blocks, without the branches for which skip() holds."""
    out: list[str | None] = []
    todo: list = [root]
    while todo:
        part = todo.pop()
        if isinstance(part, Element):
            if skip(part):
                continue
            if part.tag not in INLINE:
                out.append(None)
                todo.append(None)
            todo.extend(reversed(part.texts))
        else:
            out.append(part)
    return out


def _blocks(pieces: list[str | None]) -> list[str]:
    blocks, open_ = [], []
    for piece in [*pieces, None]:
        if piece is not None:
            open_.append(piece)
        elif open_:
            block = " ".join(html.unescape("".join(open_)).split())
            if block:
                blocks.append(block)
            open_ = []
    return blocks


def style_nodes(root: Element) -> list[tuple[int, int, int]]:
    """Of each kind of branch (path of tags and classes): its presentation (the children's labels) and its content.
    A branch's content is hashed from its own words and its branches' hashes, so each text is hashed once."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(part for part in reversed(e.texts) if isinstance(part, Element))
    content: dict[int, bytes] = {}
    for e in reversed(order):
        parts = (content[id(p)] if isinstance(p, Element) else b"\x00" if p is None else b" " + " ".join(p.split()).encode("utf-8", "surrogatepass") for p in e.texts)
        content[id(e)] = xxhash.xxh64_digest(b"".join(parts))
    seen: dict[int, tuple[xxhash.xxh64, xxhash.xxh64]] = {}
    branches = {id(c) for e in order for c in e.children}
    for e in order:
        if id(e) in branches:
            shape, text = seen.setdefault(e.path, (xxhash.xxh64(), xxhash.xxh64()))
            shape.update("|".join(c.label for c in e.children) + ";")
            text.update(content[id(e)])
    return [(p, s.intdigest() - (1 << 63), c.intdigest() - (1 << 63)) for p, (s, c) in seen.items()]


def _words_of(e: Element) -> list[str]:
    """The words of an element's classes."""
    return _WORDS.findall(e.label[len(e.tag) :])


def _protected(e: Element) -> bool:
    """What markup itself declares to be the article: it, and its plain text blocks. No statistic removes these."""
    return e.tag in ("#", "html", "body", "article", "main") or (e.article and e.label == e.tag and e.tag in TEXT_BLOCKS)


def main_text(root: Element, low: frozenset[int]) -> str:
    """The blocks of the article elements, or where there are none of the body, without noise and low branches.

    With an article, paragraphs, headings and what is named a lead beside it, or beside what holds it, count as well.
    Articles that are named teasers count only where there is no other."""
    skip = lambda e: e.prior or (not _protected(e) and e.tag not in INLINE and e.path in low)
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        if not e.prior:
            order.append(e)
            if e.tag not in ("article", "main"):
                todo.extend(reversed(e.children))
    found = [e for e in order if e.tag in ("article", "main")]
    teasers = {id(e) for e in found if not TEASER_WORDS.isdisjoint(_words_of(e))}
    holds = {id(e) for e in found if id(e) not in teasers} or teasers
    if holds:
        for e in reversed(order):
            if any(id(c) in holds for c in e.children):
                holds.add(id(e))
        whole, out = [root], []
        while whole:
            e = whole.pop()
            if e.prior or id(e) in teasers and teasers is not holds:
                continue
            if e.tag in ("article", "main"):
                out += _blocks(_pieces(e, skip))
            elif id(e) in holds:
                whole.extend(reversed(e.children))
            elif (e.tag in LEADS or not LEAD_WORDS.isdisjoint(_words_of(e))) and not skip(e):
                out += _blocks(_pieces(e, skip))
        return "\n\n".join(out)
    kept = _blocks(_pieces(root, skip)) or _blocks(_pieces(root, lambda e: e.prior))
    return "\n\n".join(kept)


def _features(batches):
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("shape", pa.int64()), ("content", pa.int64())])
    for batch in slices(batches):
        hosts, paths, shapes, contents = [], [], [], []
        for url, page in zip(raw(batch.column(1)), batch.column(2).to_pylist()):
            nodes = style_nodes(parse(page)) if page else []
            hosts += [split_url(url)[0].decode("utf-8", "replace")] * len(nodes)
            paths += [p for p, _, _ in nodes]
            shapes += [s for _, s, _ in nodes]
            contents += [c for _, _, c in nodes]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (paths, shapes, contents))], schema=schema)


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for batch in slices(batches):
        texts = [main_text(parse(page), frozenset(low or ())) if page else "" for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, presentation, content, importance: each host's merged tree, one row per kind of branch.

    presentation and content are entropies over the host's pages, 0 if all pages agree and 1 if all differ. With one
    page nothing is known, and importance is 1. The more presentations a branch has, the less its content counts.
    Counts are made per value before they are joined by branch, so a host with a third of all pages stays spread.
    """
    rows = pages.select(F.lit(None).cast("long").alias("page_id"), "url", "html").mapInArrow(_features, "host string, path long, shape long, content long")
    values = rows.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shape").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("v"))
    counts = values.groupBy("host", "path", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("c"))
    of = lambda kind, what: F.sum(F.when(F.col("kind") == kind, what).otherwise(F.lit(0)))
    sums = counts.groupBy("host", "path").agg(of(0, F.col("c")).alias("n_pages"), of(0, F.lit(1)).alias("shapes"), of(0, F.col("c") * F.log("c")).alias("s"), of(1, F.col("c") * F.log("c")).alias("t"))
    entropy = lambda x: F.when(F.col("n_pages") > 1, 1 - F.col(x) / (F.col("n_pages") * F.log("n_pages"))).otherwise(F.lit(1.0))
    weight = 1 - F.pow(F.lit(GAMMA), F.col("shapes"))
    return sums.select("host", "path", "n_pages", entropy("s").alias("presentation"), entropy("t").alias("content"), weight.alias("w")).withColumn("importance", F.when(F.col("n_pages") > 1, F.col("w") * F.col("presentation") + (1 - F.col("w")) * F.col("content")).otherwise(1.0)).drop("w")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars, for every input row.

    A site style tree per host gives the branches whose presentation and content hardly vary. Pages lose those, and
    what markup marks as no content: elements, roles, and words of class and id. Where the page has article or main
    elements, only they count, and their plain text blocks stay even if they are the same on every page; elsewhere
    the body counts, and if all of it would go as repeated, only the marked noise goes.

    Blocks are joined by an empty line; white space within one becomes one blank. Null or empty html: an empty text.
    Null urls, and urls without a host, share the host ''. Null ids and repeated rows stay. Very long
    pages are parsed whole. Ties of importance need no rule, as branches are judged by a threshold. Extra columns play no
    part, whatever their names. An empty table: no rows.
    Rules reach the pages by broadcast if they are few enough, else by a join on host in which each host is dealt
    over SALTS shares.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    low = style_tree(source).filter((F.col("n_pages") >= MIN_PAGES) & (F.col("importance") < LEAST))
    rules = stash(low.groupBy("host").agg(F.collect_set("path").alias("low")), "style-rules")
    host = F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = source.withColumn("host", host)
    if rules.agg(F.sum(F.size("low"))).first()[0] is None:
        judged = keyed.withColumn("low", F.lit(None).cast("array<long>"))
    elif (few := checked(rules, "low", 100_000)) is not rules:
        judged = keyed.join(few, "host", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = keyed.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return judged.select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
