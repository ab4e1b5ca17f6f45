"""Main text of web pages: markup rules, and a suffix array over each host's pages.

Pages meet by host. A stretch of ``RUN`` tokens is boilerplate if enough distinct pages of its host,
however many those are, have it. A host's pages are dealt by a hash of the page id into groups of
about ``GROUP_BYTES`` or ``GROUP_PAGES``, so a host with a third of all pages takes many tasks. In a
group, the token streams of all pages are concatenated, with a token of its own between pages, and
sorted by prefix doubling until neighbours are ordered by ``RUN`` tokens. A stretch that has the
host's share of pages has at least this share in one of its groups; those are candidates, and their
pages are counted over all groups of the host. So the grouping has no influence on the result.

A page is read as blocks. Blocks in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, known by their tag, role or class names, go. A name counts if all its parts are words
for such things ("share-buttons", not "social-security-form"), and within an article only on elements
that hold others: a paragraph, a heading or an inline element there is text whatever its class, and a
header there holds the title. If the page marks an article (``article`` or ``main``), the rest of that is
the text, repeated or not: an article that two pages share is still an article. An article inside an
element that goes (a comment, say) goes with it, unless that element was never closed. On other pages
tokens covered by boilerplate go and the unique runs stay.

Scripts, styles, drawings and the like go up to their end tag; one that closes itself ends at once, and
one without an end tag at the next block.

Null or empty html gives the empty text. Markup may be cut off or badly nested; nothing is capped.
Pages without a host form groups of their own. Columns besides id, url and html are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm import store
from tonewise.llm.words import chunks, grams, inside, mix

GROUP_BYTES = 1 << 20
GROUP_PAGES = 256
#: Text that a task holds until it sends each group its pages, compressed together.
SEND_BYTES = 8 << 20
#: Tokens of a repeated stretch, and the pages and share of the host that must have it.
RUN = 8
LEAST_PAGES = 3
LEAST_SHARE = 0.05

_RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|object|math"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?P<inside>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|<(?P<raw2>{_RAW})\b(?P<inside2>[^>]*+)(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in _RAW.split("|")}
#: Raw elements that may hold blocks of their own; in the others a block says that the end tag is missing.
_HOLDS_BLOCKS = frozenset(["noscript", "template", "iframe", "object", "script", "style", "textarea"])
_NAME = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK, key=len, reverse=True))})\b", re.I)
_SKIPPED = frozenset("nav header footer aside form menu button dialog head".split())
#: Elements that a name can drop from within an article.
_CONTAINERS = frozenset("div section ul ol dl table details fieldset figure center".split())
_CONTENT = frozenset(["article", "main"])
_UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion cookie cookies consent gdpr notice alert "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay "
    "widget toolbar pagination pager skip contentinfo complementary search form toc".split()
)
#: Words that say where such a thing stands or what it is made of; alone they name nothing.
_NEUTRAL = frozenset(
    "area bar block blocks body bottom box button buttons container content count first form global group icon icons inline inner item items label "
    "last left line link links list main mobile module outer page panel post posts primary right row secondary section site slot small text title "
    "top us wrap wrapper by on the".split()
)
_HEADERS = frozenset(["header", "masthead", "banner"])
_NUMBER = re.compile(r"\d+(?:x\d+)?")
_PARTS = re.compile(r"[^a-z0-9]+")


def unwanted(tag: str, attributes: str, within: bool = False) -> bool:
    """Whether an element is by its tag or name no part of the main text; ``within`` an article less is."""
    if within and (tag == "header" or tag not in _SKIPPED and tag not in _CONTAINERS and tag not in _CONTENT):
        return False
    if tag in _SKIPPED:
        return True
    if tag in ("body", "html") or tag in _CONTENT and not re.search("comment", attributes, re.I):
        return False
    for found in _NAME.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").lower().split():
            words = [w for w in _PARTS.split(name) if w and not _NUMBER.fullmatch(w)]
            bad = [w for w in words if w in _UNWANTED and not (within and w in _HEADERS)]
            if bad and all(w in _UNWANTED or w in _NEUTRAL for w in words):
                return True
    return False


def tokens_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it closes, attributes) of all markup; raw elements are one token without a tag."""
    at, no_end = 0, set()
    while (token := _TOKEN.search(page, at)) is not None:
        at, raw = token.end(), (token["raw"] or token["raw2"] or "").lower()
        if raw:
            if not (token["inside"] or token["inside2"] or "").endswith("/"):
                end = None if raw in no_end else _RAW_END[raw].search(page, at)
                if end is None:
                    no_end.add(raw)
                block = _BLOCK_TAG.search(page, at) if end is None or raw not in _HOLDS_BLOCKS else None
                if block is not None and (end is None or block.start() < end.start()):
                    at = block.start()
                else:
                    at = end.end() if end is not None else len(page)
            yield token.start(), at, "raw", False, ""
            continue
        closes = bool(token["close"] or token["close2"])
        yield token.start(), at, (token["tag"] or token["tag2"] or "").lower(), closes, token["rest"] or token["rest2"] or ""


def _closed(tokens: list[tuple[int, int, str, bool, str]]) -> set[int]:
    """Which opening tags have an end tag of their own name."""
    open_, closed = {}, set()
    for i, (_, _, tag, closes, _) in enumerate(tokens):
        if not closes:
            open_.setdefault(tag, []).append(i)
        elif open_.get(tag):
            closed.add(open_[tag].pop())
    return closed


def blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, dropped by its markup, inside an article) of all blocks in page order."""
    found: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    skipped: list[str] = []  # the open element that is skipped, then open elements of the same name in it
    ends = False  # whether that element has an end tag
    content = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, bool(skipped), content > 0))

    page = page or ""
    tokens = list(tokens_of(page))
    closed = _closed(tokens)
    at = 0
    for i, (start, end, tag, closes, rest) in enumerate(tokens):
        parts.append(page[at:start])
        at = end
        if tag == "raw":
            parts.append(" ")
            continue
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if closes:
            if tag in _CONTENT and not skipped:
                flush()
                content = max(0, content - 1)
            elif skipped and tag == skipped[-1]:
                flush()
                skipped.pop()
            elif tag in _CONTENT and not ends:
                flush()
                content = max(0, content - 1)
                skipped.clear()
            elif tag in ("body", "html"):
                flush()
                skipped.clear()
        elif rest.endswith("/"):
            continue
        elif skipped:
            if tag in _CONTENT and not ends and not unwanted(tag, rest) and skipped[0] not in _CONTENT:
                flush()  # an article starts in what was never closed
                skipped.clear()
                content += 1
            elif tag == "body" and skipped[0] == "head":
                skipped.clear()
            elif tag == skipped[0]:
                skipped.append(tag)
        elif unwanted(tag, rest, content > 0):
            flush()
            skipped.append(tag)
            ends = i in closed
        elif tag in _CONTENT:
            flush()
            content += 1
    parts.append(page[at:])
    flush()
    return found


def _stretches(text: np.ndarray, page_of: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens with a unique one after each page: the rank of the stretch that starts at each, on how many pages each rank is, and the starts inside a page."""
    page = np.repeat(np.arange(len(page_of)), page_of)
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1]
    order, depth = np.argsort(rank, kind="stable"), 1
    while depth < run:  # suffixes sorted by twice as many tokens, at last by exactly ``run``
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate([[False], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        depth += step
    held = np.unique(rank * len(page_of) + page) // max(1, len(page_of))  # one entry per stretch and page
    pages = np.bincount(held, minlength=int(rank.max()) + 1 if n else 0)
    ends = np.repeat(np.cumsum(page_of) - 1, page_of)  # of each token's page
    return rank, pages, np.flatnonzero(np.arange(n) + run <= ends)


def _cover(n: int, starts: np.ndarray, run: int) -> np.ndarray:
    edge = np.zeros(n + 1 + run, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:n] > 0


def least_of(pages: int, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> int:
    """On how many of a host's pages boilerplate must be."""
    return max(least_pages, int(np.ceil(least_share * pages)))


def repeated(streams: list[list[str]], run: int = RUN, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> list[np.ndarray]:
    """For each page's tokens, which lie in a stretch of ``run`` tokens found on enough distinct pages."""
    numbers: dict[str, int] = {}
    flat, page_of = [], []
    for page, tokens in enumerate(streams):
        flat += [numbers.setdefault(t, len(numbers)) for t in tokens]
        flat.append(-1 - page)
        page_of.append(len(tokens) + 1)
    rank, pages, starts = _stretches(np.array(flat, np.int64), np.array(page_of, np.int64), run)
    often = pages[rank[starts]] >= least_of(len(streams), least_pages, least_share)
    covered = _cover(len(flat), starts[often], run)
    return [c[:-1] for c in np.split(covered, np.cumsum(page_of)[:-1])] if streams else []


def candidates(texts: pa.Array, total: int, least: int, run: int = RUN) -> np.ndarray:
    """Hashes of the stretches whose share of these pages, a group of a host's ``total``, is the share that ``least`` is of all."""
    read = list(chunks(texts))
    hashes = np.concatenate([c.hashes for c in read])
    page_of = np.concatenate([c.counts for c in read])
    text = np.insert(np.unique(hashes, return_inverse=True)[1], np.cumsum(page_of), -1 - np.arange(len(page_of)))
    rank, pages, starts = _stretches(text, page_of + 1, run)
    starts = starts[pages[rank[starts]] * total >= least * len(page_of)]
    starts = starts[np.unique(rank[starts], return_index=True)[1]]
    page = np.repeat(np.arange(len(page_of)), page_of + 1)
    return grams(hashes, run)[starts - page[starts]]


def main_text(page: list[tuple[str, bool, bool]], cover: np.ndarray | None) -> str:
    """The text that is left of a page's blocks; ``cover`` marks the boilerplate among the tokens of a page that marks no article."""
    marked = is_marked(page)
    kept, at = [], 0
    for text, dropped, within in page:
        if marked:
            if within and not dropped:
                kept.append(text)
            continue
        words = text.split(" ")
        boiler = cover[at : at + len(words)]
        at += len(words)
        if not dropped and not boiler.all():
            kept.append(text if not boiler.any() else " ".join(w for w, b in zip(words, boiler) if not b))
    return "\n\n".join(kept)


def is_marked(page: list[tuple[str, bool, bool]]) -> bool:
    return any(within and not dropped for _, dropped, within in page)


def main_texts(pages: list[str | None], run: int = RUN, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> list[str]:
    """The main text of each page of one host."""
    read = [blocks(p) for p in pages]
    covers = repeated([[w for text, _, _ in page for w in text.split(" ")] for page in read], run, least_pages, least_share)
    return [main_text(page, cover) for page, cover in zip(read, covers)]


LEAST = {"least": "i8"}
COUNT = {"n": "i8", "least": "i8"}


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", group_bytes: int = GROUP_BYTES, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark, folder, bits = pages.sparkSession, store.new_folder(pages.sparkSession, "hosts"), store.shard_bits(pages)
    host = F.coalesce(F.regexp_extract(F.col(url).cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    size = F.coalesce(F.octet_length(html), F.lit(0)) + 1
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.xxhash64(F.lower(host)).alias("host"), size.cast("long").alias("size"), F.col(html).alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [blocks(p) for p in batch.column("html").to_pylist()]
            parts = [pa.array([[b[i] for b in page] for page in read], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *parts], [*batch.schema.names[:4], "texts", "dropped", "within"])

    ids = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page", "url"))
    kinds = f"{ids}, host long, size long, texts array<string>, dropped array<boolean>, within array<boolean>"
    rows.mapInArrow(parse, kinds).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    read = spark.read.schema(kinds).parquet(f"{folder}/blocks")

    sizes = read.groupBy("host").agg(F.ceil(F.greatest(F.sum("size") / group_bytes, F.count("*") / GROUP_PAGES)).alias("groups"), F.count("*").alias("total"))
    sizes.where("groups > 1").write.parquet(f"{folder}/sizes")  # hosts of a single group need no entry
    sizes = spark.read.schema("host long, groups long, total long").parquet(f"{folder}/sizes")
    text = F.array_join("texts", " ").alias("text")
    part = F.pmod(F.xxhash64("page", "url"), F.coalesce("groups", F.lit(1))).alias("part")
    dealt = read.join(sizes, "host", "left").select("host", part, F.coalesce("total", F.lit(0)).alias("total"), text)
    names = ["host", "part", "total", "size", "texts"]

    def sent_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[str]] = {}
        waiting = 0

        def flush() -> pa.RecordBatch:
            texts = ["\n".join(t).encode() for t in held.values()]  # no block has a line break
            of = [pa.array(c, pa.int64()) for c in zip(*held)]
            sent = pa.array([pa.Codec("zstd").compress(t, asbytes=True) for t in texts], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays([*of, pa.array([len(t) for t in texts], pa.int64()), sent], names)

        for batch in batches:
            for host, part, total, page in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((host, part, total), []).append(page)
                waiting += len(page) + 1
                if waiting > SEND_BYTES:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    dealt = dealt.mapInArrow(sent_together, "host long, part long, total long, size long, texts binary")

    def find(table: pa.Table) -> pa.Table:
        sent = zip(table.column("texts").to_pylist(), table.column("size").to_pylist())
        texts = [t for z, n in sent for t in pa.Codec("zstd").decompress(z, n, asbytes=True).decode().split("\n")]
        total = table.column("total")[0].as_py()  # 0 if this group is the whole host
        least = least_of(total or len(texts), least_pages)
        found = candidates(pa.array(texts, pa.large_string()), total or len(texts), least)
        key = mix(found + table.column("host").to_numpy()[:1].view("u8"))
        return pa.table({"key": key.view("i8"), "least": np.full(len(key), least), "whole": np.full(len(key), not total)})

    dealt.groupBy("host", "part").applyInArrow(find, "key long, least long, whole boolean").write.parquet(f"{folder}/found")
    found = spark.read.schema("key long, least long, whole boolean").parquet(f"{folder}/found")

    def packed(fields: dict[str, str], how: dict[str, str], arrays):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = store.Writer(fields, how, bits)
            for batch in batches:
                for keys, values in arrays(batch):
                    if (out := sent.add(keys, values)) is not None:
                        yield out
            if (out := sent.flush()) is not None:
                yield out

        return send

    def listed(batch: pa.RecordBatch) -> Iterator[tuple]:
        least = batch.column("least").to_numpy()
        yield batch.column("key").to_numpy().view("u8"), {"least": least}

    def decided(batch: pa.RecordBatch) -> Iterator[tuple]:
        for keys, values in listed(batch):
            yield keys, {"n": values["least"], **values}

    def starts_of(texts: pa.Array, hosts: np.ndarray) -> Iterator[tuple]:
        """(chunk, start, row, key) of the stretches of all rows."""
        for chunk in chunks(texts):
            at = inside(chunk.bounds, RUN)
            row = np.searchsorted(chunk.bounds, at, side="right") - 1
            runs = grams(chunk.hashes, RUN)[at] if len(at) else np.zeros(0, np.uint64)
            yield chunk, at, row, mix(runs + hosts[chunk.first + row].view("u8"))

    def counts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for _, _, row, keys in starts_of(batch.column("text"), batch.column("host").to_numpy()):
            of = store.lookup(folder, "candidate", bits, keys, LEAST, {"least": 0})
            row, keys, least = row[of["found"]], keys[of["found"]], of["least"][of["found"]]
            order = np.lexsort((keys, row))
            once = order[np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (keys[order][1:] != keys[order][:-1])])] if len(order) else order
            yield keys[once], {"n": np.ones(len(once), np.int64), "least": least[once]}

    how = {"n": "add", "least": "max"}
    boiler = found.where("whole").select("key", "least").mapInArrow(packed(COUNT, how, decided), store.schema(COUNT))
    if not sizes.isEmpty():
        rest = found.where("not whole").select("key", "least").mapInArrow(packed(LEAST, {"least": "min"}, listed), store.schema(LEAST))
        store.build(rest, folder, "candidate", bits, LEAST, {"least": "min"})
        several = read.join(sizes, "host", "left_semi").select("host", text)
        boiler = boiler.unionByName(several.mapInArrow(packed(COUNT, how, counts), store.schema(COUNT)))
    store.build(boiler, folder, "boiler", bits, COUNT, how, keep=lambda keys, values: {"key": keys[values["n"] >= values["least"]]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [list(zip(*page)) for page in zip(*(batch.column(c).to_pylist() for c in ("texts", "dropped", "within")))]
            texts = [None if is_marked(page) else " ".join(b[0] for b in page) for page in read]
            got: list[str] = []
            for chunk, at, _, keys in starts_of(pa.array(texts, pa.large_string()), batch.column("host").to_numpy()):
                covered = _cover(len(chunk.hashes), at[store.lookup(folder, "boiler", bits, keys, {}, {})["found"]], RUN)
                got += [main_text(read[chunk.first + i], covered[chunk.bounds[i] : chunk.bounds[i + 1]]) for i in range(chunk.rows)]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(got, pa.string())], ["page", "url", "text"])

    out = read.select("page", "url", "host", "texts", "dropped", "within").mapInArrow(cut, f"{ids}, text string")
    return out.select(F.col("page").alias(page_id), F.col("url").alias(url), "text")
