"""HTML extraction: the article of a page, boilerplate found by suffix arrays over the pages of a host.

A page is cut into text blocks.  Elements that are never text (scripts, menus, forms, adverts, ...) are
left out first.  Blocks inside its article (or main part) are its text, whatever else repeats them,
because copies of an article are articles too.  All else is in doubt: blocks outside, blocks of pages
without article, and blocks inside whose class or id only resembles the name of a widget.  The words in
doubt go, as one stream per page, into suffix arrays of the host: word sequences of LONG or more that
stand on distinct pages of a host are boilerplate.  A page keeps the words in doubt that no such sequence
covers; beside an article, blocks of fewer words that stand on distinct pages go as well.

Copies of a page are one page, told by a digest of all its words before anything is dealt.  A host is
dealt to shards of bounded size.  Every shard finds the repeats among its own pages; a table with one
row per place of a sequence that one page alone holds finds those that repeat only across shards, so
the outcome does not depend on the size of a shard.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.llm.benchmark_suffixes import spread, suffix_ranks
from claimsift.session import materialise

LONG = 12  # words of a repeated sequence that is boilerplate
SHARD_WORDS = 1 << 18  # words of one suffix array

# What HTML elements do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title xmp".split())
NEVER = RAW | set("head nav footer aside form button select object svg canvas dialog menu audio video map datalist".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split())
CELLS = set("td th br img input select".split())
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in class, id and role that name what is not text.
HINTS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion "
    "related reply replies search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
COMMENT_HINTS = {"comment", "comments", "reply", "replies", "disqus"}
# Words that stand beside these in the names of widgets.
FRAMES = set("area bar block blocks box boxes btn button buttons container form inner item items label links list section slot text unit wrap wrapper".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+")


def names(rest: str) -> list[tuple[str, set[str]]]:
    """(attribute, words) of every name in class, id and role; ("", {"hidden"}) if the element is hidden."""
    if not rest or rest.isspace():
        return []
    found = []
    for m in _ATTRIBUTE.finditer(rest):
        if m[1].lower() in ("class", "id", "role"):
            found += [(m[1].lower(), set(_SPLIT.split(name)) - {""}) for name in (m[2] or m[3] or m[4] or "").lower().split()]
    bare = _ATTRIBUTE.sub(" ", rest).lower().split()
    return found + [("", {"hidden"})] if "hidden" in bare else found


def is_widget(named: list[tuple[str, set[str]]]) -> bool:
    """Whether a class or role says nothing but widget, or an id nothing but reader comments."""
    return any(words & known and words <= known | FRAMES for kind, words in named for known in [COMMENT_HINTS if kind == "id" else HINTS])


def marked(page: str) -> tuple[bool, list[tuple[str, bool]]]:
    """Whether the page has an article or main part, and its blocks in page order with whether they are in doubt."""
    stack: list[tuple[str, bool, str, bool]] = []  # name, left out, part: "", "main" or "article", in doubt
    found: list[tuple[str, bool, str]] = []
    pieces: list[str] = []
    parts: set[str] = set()

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            found.append((*(stack[-1][2:] if stack else ("", False)), text))
        pieces.clear()

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        stop = m.start() if m else size
        left_out = bool(stack) and stack[-1][1]
        if stop > at and not left_out:
            pieces.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        block = name in BLOCKS
        if m["end"]:
            if not any(s[0] == name for s in stack):
                continue
            if block:
                flush()
            while stack.pop()[0] != name:
                pass
            if name in CELLS:
                pieces.append(" ")
            continue
        if block:
            flush()
            while stack and stack[-1][0] == "p":
                stack.pop()
        elif name in CELLS and not left_out:
            pieces.append(" ")
        if name in ENDS_ITSELF:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ENDS_ITSELF[name]:
                    break
                if stack[k][0] == name or {name, stack[k][0]} == {"dt", "dd"} or {name, stack[k][0]} == {"td", "th"}:
                    del stack[k:]
                    break
        if name in VOID or m["rest"].endswith("/"):
            continue
        out, part, doubt = stack[-1][1:] if stack else (False, "", False)
        tokens = names(m["rest"])
        named = set().union(*(words for _, words in tokens))
        if name == "article" and not named & COMMENT_HINTS or name == "main" or named & {"articlebody"}:
            part = "article" if name == "article" or part == "article" or named & {"articlebody"} else "main"
            out = out or "hidden" in named
            parts |= set() if out else {part}
        elif name not in ("html", "body"):
            out = out or name in NEVER or (name == "header" and part != "article") or "hidden" in named
            out = out or (is_widget(tokens) if part else bool(named & HINTS))
            doubt = doubt or bool(part and named & HINTS)
        stack.append((name, out, part, doubt))
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
            stack.pop()
            at = close.end() if close else size
    flush()
    best = "article" if "article" in parts else "main" if parts else None
    return best is not None, [(text, doubt or not best or part not in (best, "article")) for part, doubt, text in found]


def blocks(page: str) -> tuple[bool, list[str], list[str]]:
    """Whether the page has an article or main part, the blocks that are its text, and the blocks in doubt."""
    has, found = marked(page)
    return has, [text for text, doubt in found if not doubt], [text for text, doubt in found if doubt]


def repeated(streams: list[list[str]], pages: np.ndarray, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the streams to ``long`` words: (stream, place, group, repeats) of every sequence of ``long`` words.

    Sequences of equal words have one group; ``repeats`` marks groups that stand in streams of more than one page.
    """
    number: dict[str, int] = {}
    sizes = np.array([len(s) for s in streams])
    flat = np.concatenate([np.array([*(number.setdefault(w, len(number) + 1) for w in s), 0], np.int64) for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes + 1)
    place = spread(np.zeros(len(sizes), np.int64), sizes + 1)
    whole = np.flatnonzero(sizes[owner] - place >= long)
    if not len(whole):
        return owner[:0], place[:0], place[:0], place[:0].astype(bool)
    _, group = np.unique(suffix_ranks(flat, long)[whole], return_inverse=True)
    held = np.unique(np.stack([group, pages[owner[whole]]]), axis=1)[0]
    return owner[whole], place[whole], group, (np.bincount(held) > 1)[group]


def shard_rows(group: pd.DataFrame, long: int) -> pd.DataFrame:
    """Of one shard: the places that repeats cover (hash null) and, if the host has several shards, what others need.

    That is every place of a sequence that one page alone holds, and a row of no page (-1) per repeat.
    """
    streams = [words.split(" ") for words in group["words"]]
    keys, pages = group["key"].to_numpy(), group["number"].to_numpy()
    owner, place, number, repeats = repeated(streams, pages, long)
    covered = pd.DataFrame({"key": keys[owner[repeats]], "number": pages[owner[repeats]], "start": place[repeats], "hash": pd.array([None] * int(repeats.sum()), "Int64")})
    if group["several"].iloc[0]:
        _, first, which = np.unique(number, return_index=True, return_inverse=True)
        hashes = np.array([xxhash.xxh64_intdigest(" ".join(streams[owner[k]][place[k]:place[k] + long])) for k in first], np.uint64).view(np.int64)
        alone, shared = np.flatnonzero(~repeats), repeats[first]
        covered = pd.concat([
            covered, pd.DataFrame({"key": keys[owner[alone]], "number": pages[owner[alone]], "start": place[alone], "hash": pd.array(hashes[which[alone]], "Int64")}),
            pd.DataFrame({"key": -1, "number": -1, "start": 0, "hash": pd.array(hashes[shared], "Int64")})])
    return covered.assign(host=group["host"].iloc[0])[["host", "key", "number", "start", "hash"]]


def extract(pages: DataFrame, long: int = LONG, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``.

    A null html is empty; a page without text gives an empty text; null urls are one host; pages of
    a host with equal words, however cut into blocks, count as one page, so repeated rows keep their text;
    an empty table gives no rows; further columns are ignored.
    """
    kinds = {c: pages.schema[c].dataType for c in ("page_id", "url")}
    rows = pages.select(F.struct("page_id", "url").alias("page"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    page = rows.schema["page"].dataType.simpleString()

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [marked(x.as_py())[1] for x in batch.column("html")]
            texts = [None if any(doubt for _, doubt in found) else "\n".join(text for text, _ in found) for found in parsed]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string())], names=["page", "text"])

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [marked(x.as_py()) for x in batch.column("html")]
            pick = [k for k, (_, found) in enumerate(parsed) if any(doubt for _, doubt in found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page").take(pa.array(pick, pa.int64())), pa.array([parsed[k][0] for k in pick], pa.bool_()),
                 pa.array([[text for text, _ in parsed[k][1]] for k in pick], pa.list_(pa.string())),
                 pa.array([[doubt for _, doubt in parsed[k][1]] for k in pick], pa.list_(pa.bool_()))],
                names=["page", "has_article", "blocks", "doubts"])

    host = F.lower(F.coalesce(F.regexp_extract("page.url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    words = F.array_join(F.filter("blocks", lambda b, k: F.get("doubts", k)), " ")
    open_pages = materialise(rows.mapInArrow(doubtful, f"page {page}, has_article boolean, blocks array<string>, doubts array<boolean>").select(
        F.monotonically_increasing_id().alias("key"), "page", "has_article", "blocks", "doubts", host.alias("host"),
        F.md5(F.array_join("blocks", " ")).alias("content"), F.md5(words).alias("part"), F.size(F.split(words, " ")).alias("n")), "pages-in-doubt")
    distinct = materialise(open_pages.groupBy("host", "content", "part").agg(F.min("key").alias("stream"), F.max("n").alias("n")), "distinct-pages")
    shards = distinct.groupBy("host").agg(F.greatest(F.ceil(F.sum("n") / shard_words), F.lit(1)).alias("shards"))
    dealt = open_pages.join(distinct.select(F.col("stream").alias("key")), "key", "left_semi").join(shards, "host").select(
        "host", "key", words.alias("words"), (F.col("shards") > 1).alias("several"), F.pmod(F.xxhash64("content"), "shards").alias("shard"),
        F.shiftrightunsigned(F.xxhash64("content"), 1).alias("number"))
    found = dealt.groupBy("host", "shard").applyInPandas(lambda group: shard_rows(group, long), "host string, key long, number long, start long, hash long")
    found = materialise(found, "repeats")
    hashed = found.where("hash is not null")
    across = hashed.groupBy("host", "hash").agg(F.min("number").alias("low"), F.max("number").alias("high")).where("low < high")
    covered = found.where("hash is null").select("key", "start").unionAll(
        hashed.where("key >= 0").join(across, ["host", "hash"]).select("key", "start"))
    starts = covered.groupBy(F.col("key").alias("stream")).agg(F.collect_list("start").alias("starts"))  # words of one page
    # Blocks too short for a sequence, on pages that have an article elsewhere.
    short = open_pages.where("has_article").select("key", "host", "content", F.explode(F.filter(
        "blocks", lambda b, k: F.get("doubts", k) & (F.size(F.split(b, " ")) < long))).alias("block"))
    stock = short.groupBy("host", "block").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low < high")
    stock = short.join(stock.select("host", "block"), ["host", "block"]).groupBy("key").agg(F.collect_set("block").alias("stock"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            columns = (batch.column(c).to_pylist() for c in ("blocks", "doubts", "starts", "stock"))
            for parts, doubts, begins, known in zip(*columns, strict=True):
                known = set(known or [])
                lists = [p.split(" ") for p in parts]
                cover = np.zeros(sum(len(p) for p, doubt in zip(lists, doubts, strict=True) if doubt) + 1, np.int64)
                np.add.at(cover, np.array(begins or [], np.int64), 1)
                np.add.at(cover, np.array(begins or [], np.int64) + long, -1)
                hit, at, kept = np.cumsum(cover) > 0, 0, []
                for text, part, doubt in zip(parts, lists, doubts, strict=True):
                    size = len(part) if doubt else 0
                    left = [w for w, gone in zip(part, hit[at:at + size], strict=True) if not gone] if doubt else part
                    at += size
                    kept += [" ".join(left)] if left and not (doubt and text in known) else []
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(texts, pa.string())], names=["page", "text"])

    decided = open_pages.join(distinct.select("host", "content", "part", "stream"), ["host", "content", "part"]).join(starts, "stream", "left").join(
        stock, "key", "left").select("page", "blocks", "doubts", "starts", "stock")
    every = rows.mapInArrow(certain, f"page {page}, text string").where("text is not null").unionAll(decided.mapInArrow(keep, f"page {page}, text string"))
    return every.select(
        F.col("page.page_id").cast(kinds["page_id"]).alias("page_id"), F.col("page.url").cast(kinds["url"]).alias("url"), "text",
        F.length("text").cast("bigint").alias("n_chars"))
