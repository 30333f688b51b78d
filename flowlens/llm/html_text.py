"""Main text of pages: markup says what is an article and what is furniture, a host suffix array says what repeats.

A page is cut into blocks. Each block has a role from its ancestors: furniture (menus, headers, footers, sidebars,
notices, adverts, forms, comments, and all in head), article (all other text inside article or main), or plain (the
rest). Scripts, styles and comments make no block.

A page with article text is that text: it stays whole even where pages repeat it, since articles that are copied or
quoted are still the article; furniture goes even where it is unique. What markup leaves open, the plain blocks of pages
without article text, is decided by the host suffix array: the token streams of a host's pages are concatenated and their
suffixes ranked by doubling, to the depth of `least` tokens, which is all that substrings of at least that length ask
for. A run of tokens that some other page of the host has as well, outside its article, is covered and goes; unique runs
stay.

Over tables suffixes are named by the same doubling: a suffix's name at twice the depth is a hash of its name and of the name of the
suffix that begins where it ends, up to `least` tokens, so equal names are equal ranks and no host need be sorted in one place. A
name is shared if the least and the largest page that have it on the host differ. Pages are told apart by
page_id, those without one by url and html. Only hosts with an open page are searched, and only open pages wait for the
answer. They lie in chunks of about `chunk_bytes` of html; a chunk names each of its windows once, so a passage on all
pages of a large host makes no task large, and no host is cut. Chunks and partitions don't change the result.

Null or empty html gives an empty text; pages without a host (a null url too) are one host. A repeated row is the same page
and comes back repeated; an empty table gives no rows. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import save
from .url_filter import host_of
from .words import Memo, hash_word, mix, slices

FURNITURE, ARTICLE, PLAIN = range(3)

_FURNITURE_TAGS = frozenset("head title nav footer aside form button select option datalist noscript template iframe svg canvas object dialog menu audio video map".split())
_RAW = ("script", "style", "textarea", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption summary".split())
_BLOCK = _PROSE | frozenset(
    "html body head title div section article main header footer nav aside form ul ol dl table thead tbody tfoot tr figure address details fieldset hr menu dialog option legend center".split()
)
_CONTENT = frozenset(("article", "main"))
#: Parts of class, id and role names that mark furniture.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments respond disqus footer masthead share sharing social related recommended newsletter subscribe subscription signup login widget toolbar pagination pager "
    "disclaimer alert contentinfo complementary search dialog".split()
)
_HEADER_MARKS = frozenset(("header", "topbar", "branding"))

_SCAN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(_RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-z/!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _marks(attrs: str) -> set[str]:
    if "=" not in attrs:
        return set()
    return {p.lower() for m in _NAMES.finditer(attrs) for p in _PARTS.findall(m[1] or m[2] or m[3] or "")}


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of each block with text, in page order. Unclosed and stray tags are forgiven, a cut page is read as far
    as it goes."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, in article: of it or an ancestor
    text: list[str] = []

    def role() -> int:
        if not stack:
            return PLAIN
        _, bad, inside = stack[-1]
        return FURNITURE if bad else ARTICLE if inside else PLAIN

    def close() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                out.append((role(), said))

    at, page = 0, page or ""
    for m in _SCAN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCK or tag in _FURNITURE_TAGS:
            close()
        if tag in _VOID:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _BLOCK or tag in _FURNITURE_TAGS:
            if tag in _PROSE:  # a paragraph ends the open one
                while stack and stack[-1][0] in _PROSE and (stack[-1][0] == tag or stack[-1][0] == "p"):
                    stack.pop()
            bad, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            if not bad:
                marks = _marks(m["attrs"])
                bad = tag in _FURNITURE_TAGS or (tag == "header" and not inside)
                if tag not in ("html", "body", "main"):
                    bad = bad or bool(marks & _MARKS) or (not inside and bool(marks & _HEADER_MARKS))
            if not m["attrs"].rstrip().endswith("/"):
                stack.append((tag, bad, inside or tag in _CONTENT))
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The rank of each suffix by its first `depth` tokens or a few more, by doubling: equal ranks, equal beginnings."""
    _, rank = np.unique(tokens, return_inverse=True)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + after, return_inverse=True)
        length += step
    return rank


def covered(tokens: np.ndarray, page: np.ndarray, least: int) -> np.ndarray:
    """Which tokens lie in a run of at least `least` tokens that another page has too."""
    out = np.zeros(len(tokens), bool)
    if len(tokens) < least:
        return out
    rank = suffix_ranks(tokens, least)
    order = np.argsort(rank, kind="stable")
    new = np.flatnonzero(np.diff(rank[order], prepend=-1))
    low, high = np.minimum.reduceat(page[order], new), np.maximum.reduceat(page[order], new)
    starts = np.flatnonzero((low != high)[rank])
    step = np.zeros(len(tokens) + least + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + least, -1)
    return np.cumsum(step)[: len(tokens)] > 0


def main_texts(pages: list[list[tuple[int, str]]], least: int = 8) -> list[str]:
    """The main text of each page of one host."""
    names: dict[str, int] = {}
    tokens, owner, spots = [], [], []  # spots: page, block, first token, tokens
    for i, blocks in enumerate(pages):
        first = len(tokens)
        for j, (role, said) in enumerate(blocks):
            if role != ARTICLE:
                words = said.split(" ")
                spots.append((i, j, len(tokens), len(words)))
                tokens += [names.setdefault(w, len(names) + 1) for w in words]
                tokens.append(0)  # blocks of a page are parted by the same mark, so menus repeat as a whole
        tokens.append(-1 - i)
        owner += [i] * (len(tokens) - first)
    hit = covered(np.array(tokens, np.int64), np.array(owner, np.int64), least)
    shared: list[dict[int, np.ndarray]] = [{} for _ in pages]
    for i, j, at, n in spots:
        shared[i][j] = hit[at : at + n]
    return [_text(blocks, hits) for blocks, hits in zip(pages, shared, strict=True)]


def is_open(blocks: list[tuple[int, str]]) -> bool:
    """Markup doesn't say what the main text is."""
    roles = {role for role, _ in blocks}
    return ARTICLE not in roles and PLAIN in roles


def _text(blocks: list[tuple[int, str]], shared: dict[int, np.ndarray] | None = None) -> str:
    """The main text of a page. shared: by block, which of its words lie in runs that other pages have; not needed if the
    page isn't open."""
    if not is_open(blocks):
        return "\n\n".join(text for role, text in blocks if role == ARTICLE)
    said = []
    for j, (role, text) in enumerate(blocks):
        if role == PLAIN:
            runs = " ".join(w for w, c in zip(text.split(" "), shared[j].tolist(), strict=True) if not c)
            if runs:
                said.append(runs)
    return "\n\n".join(said)


def doubled_names(tokens: np.ndarray, depth: int) -> np.ndarray:
    """For each place with `depth` tokens left a 64-bit name of its suffix cut at that depth, by prefix doubling."""
    names, length = mix(tokens), 1
    while length < depth and len(names):
        step = min(length, depth - length)
        names, length = mix(mix(names[: max(0, len(names) - step)]) + names[step:]), length + step
    return names


def _windows(blocks: list[tuple[int, str]], host: str | None, least: int, memo: Memo) -> tuple[np.ndarray, dict[int, slice]]:
    """The name, with the host, of each suffix of a page's loose tokens at `least` tokens, and where each block's words lie among the tokens."""
    memo.trim()
    tokens: list[int] = []
    spots = {}
    for j, (role, said) in enumerate(blocks):
        if role != ARTICLE:
            words = said.split(" ")
            spots[j] = slice(len(tokens), len(tokens) + len(words))
            tokens += [memo[w] for w in words]
            tokens.append(0)  # blocks of a page are parted by the same mark, so menus repeat as a whole
    own = np.uint64(hash_word((host or "").encode("utf-8", "surrogatepass")))
    return mix(doubled_names(np.array(tokens, np.uint64), least) + own).view(np.int64), spots


def _words_memo() -> Memo:
    return Memo(lambda w: hash_word(w.encode("utf-8", "surrogatepass")))


_BLOCKS = pa.list_(pa.struct([("role", pa.int32()), ("text", pa.string())]))


def extract_text(pages: DataFrame, least: int = 8, chunk_bytes: int = 2_000_000, broadcast_hosts: int = 500_000) -> DataFrame:
    """page_id, url, text, n_chars, a row for each row of pages (page_id, url, html)."""
    page = F.when(F.col("page_id").isNull(), F.xxhash64("url", "html")).otherwise(F.xxhash64("page_id"))
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), page.alias("page"))
    kind = pages.schema["page_id"].dataType.simpleString()
    made = f"page_id {kind}, url string, text string, n_chars long"

    def settled(batches):
        """The texts of pages that aren't open."""
        for batch in (part for whole in batches for part in slices(whole)):
            found = [blocks_of(x) for x in batch.column("html").to_pylist()]
            keep = pa.array([not is_open(x) for x in found], pa.bool_())
            texts = [_text(x) for x in found if not is_open(x)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(keep) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    def wait(batches):
        """The blocks of open pages, in chunks."""
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in (part for whole in batches for part in slices(whole)):
            found, chunks, keep = [], [], []
            for x in batch.column("html").to_pylist():
                blocks = blocks_of(x)
                keep.append(is_open(blocks))
                if keep[-1]:
                    found.append([{"role": r, "text": t} for r, t in blocks])
                    chunks.append(chunk)
                    size += len(x)
                    if size > chunk_bytes:
                        chunk, size = chunk + 1, 0
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).filter(mask) for c in ("page_id", "url", "host", "page")), pa.array(chunks, pa.int64()), pa.array(found, _BLOCKS)],
                names=["page_id", "url", "host", "page", "chunk", "blocks"],
            )

    def windows(parsed: bool):
        """The distinct windows of each chunk with the least and the largest page that has them; those of pages that wait
        for no answer are in chunk -1."""

        def run(batches):
            memo = _words_memo()
            for batch in (part for whole in batches for part in slices(whole)):
                held: dict[int, list] = {}
                chunks = batch.column("chunk").to_pylist() if parsed else [-1] * batch.num_rows
                for chunk, host, page, said in zip(chunks, *(batch.column(c).to_pylist() for c in ("host", "page", "blocks" if parsed else "html")), strict=True):
                    blocks = [(b["role"], b["text"]) for b in said] if parsed else blocks_of(said)
                    if not parsed and is_open(blocks):
                        continue
                    found = np.unique(_windows(blocks, host, least, memo)[0])
                    held.setdefault(chunk, []).append((found, np.full(len(found), page, np.int64)))
                for chunk, parts in held.items():
                    keys, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.argsort(keys, kind="stable")
                    new = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else order
                    low, high = (f.reduceat(owner[order], new) if len(keys) else owner for f in (np.minimum, np.maximum))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(new), chunk), keys[order][new], low, high)], names=["chunk", "key", "low", "high"])

        return run

    def of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.sort(np.array([k for x in right.column("keys").to_pylist() for k in x], np.int64))
        memo, texts = _words_memo(), []
        for part in left.to_batches(max_chunksize=256):
            for host, found in zip(part.column("host").to_pylist(), part.column("blocks").to_pylist(), strict=True):
                blocks = [(b["role"], b["text"]) for b in found]
                at, spots = _windows(blocks, host, least, memo)
                step = np.zeros(max((s.stop for s in spots.values()), default=0) + least + 2, np.int64)
                starts = np.flatnonzero(np.isin(at, keys))
                np.add.at(step, starts, 1)
                np.add.at(step, starts + least, -1)
                hit = np.cumsum(step) > 0
                texts.append(_text(blocks, {j: hit[s] for j, s in spots.items()}))
        return pa.table({"page_id": left.column("page_id"), "url": left.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    waiting = save(named.mapInArrow(wait, f"page_id {kind}, url string, host string, page long, chunk long, blocks array<struct<role:int,text:string>>"), "open-pages")
    asked, found = "chunk long, key long, low long, high long", ["host", "page"]
    hosts = waiting.select("host").distinct()
    hosts = F.broadcast(hosts) if hosts.count() <= broadcast_hosts else hosts  # a checked size
    others = named.join(hosts, "host", "left_semi").select(*found, "html").mapInArrow(windows(False), asked)
    own = waiting.select("chunk", *found, "blocks").mapInArrow(windows(True), asked)
    parts = own.unionByName(others.groupBy("key").agg(F.lit(-1).cast("long").alias("chunk"), F.min("low").alias("low"), F.max("high").alias("high")))
    same = Window.partitionBy("key")
    shared = parts.withColumns({"low": F.min("low").over(same), "high": F.max("high").over(same)}).where("low <> high and chunk >= 0")
    shared = shared.groupBy("chunk").agg(F.collect_set("key").alias("keys"))
    decided = waiting.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(of_chunk, made)
    return named.select("page_id", "url", "html").mapInArrow(settled, made).unionByName(decided)
