"""Operator 3, HTML extraction: a suffix array for each host finds what its pages repeat, markup the rest.

A page is cut into blocks of text, menus, headers, footers, sidebars, notices and adverts too; only what
can't be text (scripts, styles, head, controls) is left out at once. The tokens of all pages of a host
are set end to end, and the array of their suffixes, each ending with its page, is made by prefix
doubling on the groups that still hold more than one. Where neighbours in the array agree for RUN
tokens or more, a long substring is repeated; with the number of distinct pages it stands on known,
all tokens that one on enough pages covers are removed, within blocks too, and unique runs stay.

Then markup says which of the blocks are the article: what it names as menu, footer, advert and so on
goes even where the host has too few pages for the array to tell, and where a page has an article (or
main) element, everything outside it goes. Inside an article more than four fifths of the host's distinct
pages, and twenty at least, must share a run before its tokens there go, for articles quote each other;
outside one a fiftieth, and three.

Pages with the same blocks count once, and so do near copies: pages that share four fifths of their
tokens when blocks on more than half of the distinct pages are left out, as a host's boilerplate is on
all kinds of pages and a copied article only on its copies. A near copy is looked for among the first
pages that have one of a page's two longest blocks. Only a page whose every token is repeated is left
whole. Pages of a host that are all copies of one another but for short passages are not told from
pages with much boilerplate, and lose what they share.

A host of more than CHUNK_BYTES is dealt into chunks, equal pages to the same one, each with an array of
its own, and the counts are those of the whole host all the same: a run on more than a share of all
distinct pages is on more than that share of some chunk's, so runs that are in any chunk are counted
in every chunk, and the sums decide. Near copies that fall into several chunks count once in each,
which is below the share as a chunk has thousands of pages. What is asked of a chunk is at most 50
times the tokens of a page for each chunk of its host.

Edge cases: null or empty html gives an empty text; null urls share the empty host; broken markup
is read as browsers do (unclosed elements end with their parent, a lone ``<`` is text, an open
comment runs to the end); a very long page is read in one pass, whatever is left open in it; pages
that tie are taken in the order of their blocks; repeated rows each return a row; ids of any type are
passed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .common import bounded, durable, table
from .urls import host_path

RUN = 8
#: Bytes of html to one array, and to one stretch of the input.
CHUNK_BYTES, BATCH_BYTES = 6 << 20, 8 << 20
#: Runs that may be asked of chunks by broadcast.
ASKED_BROADCAST = 2_000_000
#: Of a host's distinct pages, so many and more than this share must have a run.
LEAST_INSIDE, SHARE_INSIDE = 20, 0.8
LEAST_OUTSIDE, SHARE_OUTSIDE = 3, 0.02
#: Share of tokens in common that makes pages near copies, and of pages beyond which a block is not counted for it.
NEAR, WIDESPREAD = 0.8, 0.5
#: What markup says of a block: nothing, that it is in an article, that it is none.
OPEN, INSIDE, MARKED = range(3)

_MARKUP = re.compile(r"""<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: What can't be text, and elements that aren't the article's.
NEVER = frozenset("head script style noscript template iframe noembed noframes object svg math button select textarea input canvas audio video".split())
DROPPED = frozenset("nav header footer aside form menu dialog".split())
#: Words of a class or id, and roles, that name what isn't the article.
DROPPED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comments comment commentlist disqus respond replies share sharing social related recommended newsletter subscribe subscription login signup widget pagination".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: An element of the key ends an open one of the value.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
_CLOSING = {t: frozenset(v) for t, v in CLOSES.items()} | {t: frozenset(("p",)) for t in BLOCK - {"br", "html", "body", "head", "li", "dt", "dd", "tr", "td", "th", "option", "p", "caption", "tbody", "thead", "tfoot", "legend", "summary", "figcaption", "title"}}
#: Where the search for an element to end by implication stops.
_WALL = BLOCK - {"p", "li", "dt", "dd", "tr", "td", "th", "option", "br", "hr"}


def _unwanted(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and DROPPED_WORDS.intersection(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


class _Open:
    """The open elements, with what is asked of them kept at hand: no tag looks through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, kind, never, block
        self.at: dict[str, list[int]] = defaultdict(list)
        self.walls: list[int] = []

    def push(self, tag: str, kind: int, never: bool) -> None:
        self.at[tag].append(len(self.stack))
        if tag in _WALL:
            self.walls.append(len(self.stack))
        self.stack.append((tag, kind, never))

    def cut(self, to: int) -> bool:
        """Close all from place ``to`` on; whether a block was among them."""
        block = False
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in _WALL:
                self.walls.pop()
            block |= tag in BLOCK
        return block

    def implied(self, tag: str) -> int:
        """The place of the lowest element, above the last wall, that ``tag`` ends."""
        wall = self.walls[-1] if self.walls else -1
        places = [self.at[t] for t in _CLOSING.get(tag, ())]
        return min((p[i] for p in places if (i := bisect_right(p, wall)) < len(p)), default=len(self.stack))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, OPEN, INSIDE or MARKED) of the blocks of a page, in order."""
    out: list[tuple[str, int]] = []
    open_, held = _Open(), []
    at, size, last = 0, len(page), page.rfind(">") + 1

    def flush() -> None:
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append((text, open_.stack[-1][1] if open_.stack else OPEN))
            held.clear()

    def text(start: int, end: int) -> None:
        if end > start and not (open_.stack and open_.stack[-1][2]):
            held.append(page[start:end])

    while at < size:
        m = _MARKUP.search(page, at, last) if at < last else None
        if not m:  # no tag ends any more, but a comment or declaration may begin
            text(at, min((i for i in (page.find("<!", at), page.find("<?", at)) if i >= 0), default=size))
            break
        text(at, m.start())
        at = m.end()
        if page.startswith("<!--", m.start()) and at == last and not re.search(r"--!?>$|^<!--?>$", m[0]):
            break  # an open comment
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in BLOCK:
            flush()
        if m[1] or m[4]:
            if places := open_.at.get(tag):
                if any(t in BLOCK for t, _, _ in open_.stack[places[-1] :]):
                    flush()
                open_.cut(places[-1])
            continue
        if (to := open_.implied(tag)) < len(open_.stack):
            flush()
            open_.cut(to)
        if tag in VOID:
            continue
        if tag in RAW:  # no markup inside but its own end
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        _, kind, never = open_.stack[-1] if open_.stack else ("", OPEN, False)
        if kind != MARKED and _unwanted(tag, attributes):
            if tag in BLOCK:
                kind = MARKED
            else:  # inside a block, which goes on after it
                never = True
        elif kind == OPEN and (tag in ("article", "main") or 'role="main"' in attributes):
            kind = INSIDE
        open_.push(tag, kind, never or tag in NEVER)
    flush()
    return out


def suffix_array(tokens: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and for each how many tokens it shares with the one before it in that order.

    ``left``: how many tokens a suffix has, to the end of its page. Doubling sorts only groups that still
    hold more than one suffix; a suffix that has ended is not split from its equals.
    """
    n = len(tokens)
    inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int32)
    levels, width = [rank], 1
    active = np.flatnonzero((counts[inverse] > 1) & (left > 1))
    while len(active):
        ahead = rank[active + width]
        order = np.lexsort((ahead, rank[active]))
        active, ahead = active[order], ahead[order]
        first = np.append(True, rank[active][1:] != rank[active][:-1])
        new = first | np.append(True, ahead[1:] != ahead[:-1])
        place = np.arange(len(active))
        step = np.maximum.accumulate(np.where(new, place, 0))
        # suffixes of the group that have ended come first, and so many places are theirs
        group = np.bincount(rank[active], minlength=n)
        ended = np.bincount(rank, minlength=n) - group
        rank = rank.copy()
        rank[active] += (step - np.maximum.accumulate(np.where(first, place, 0)) + ended[rank[active]]).astype(np.int32)
        levels.append(rank)
        width *= 2
        several = np.bincount(rank, minlength=n)[rank[active]] > 1
        active = active[several & (left[active] > width)]
    order = np.lexsort((np.arange(n), rank))
    a, b = order[:-1], order[1:]
    shared = np.zeros(max(n - 1, 0), dtype=np.int64)
    most = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        again = np.flatnonzero(shared + (1 << k) <= most)
        same = levels[k][a[again] + shared[again]] == levels[k][b[again] + shared[again]]
        shared[again[same]] += 1 << k
    return order, np.append(np.zeros(min(n, 1), dtype=np.int64), shared)


def families(texts: list[list[str]]) -> np.ndarray:
    """For each page the first page it is a copy or near copy of, or itself."""
    alike: dict[tuple, int] = {}
    same = [alike.setdefault(tuple(p), i) for i, p in enumerate(texts)]
    number: dict[str, int] = {}
    sets = {i: {number.setdefault(t, len(number)) for t in texts[i]} for i in alike.values()}
    pages_with = np.bincount([b for x in sets.values() for b in x], minlength=len(number))
    tokens = [t.count(" ") + 1 for t in number]
    rare = (pages_with <= max(WIDESPREAD * len(alike), 1)).tolist()
    own = {i: {b for b in x if rare[b]} for i, x in sets.items()}
    size = {i: sum(tokens[b] for b in x) for i, x in own.items()}
    head: dict[int, int] = {}  # of a block, the first page that has it among its longest and is no copy
    first: dict[int, int] = {}
    for i, x in own.items():
        longest = sorted(x, key=lambda b: (-tokens[b], b))[:2]
        asked = sorted({head[b] for b in longest if b in head})
        first[i] = next((j for j in asked if sum(tokens[b] for b in x & own[j]) >= NEAR * max(size[i], size[j])), i)
        if first[i] == i:
            for b in longest:
                head.setdefault(b, i)
    return np.array([first[i] for i in same], dtype=np.int64)


class Stream:
    """The pages of a host, or of a chunk of one, end to end as tokens."""

    def __init__(self, pages: list[list[tuple[str, int]]], family: np.ndarray | None = None):
        self.pages = pages
        flat = [b for p in pages for b in p]
        counts, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for chunk in kernels.chunks(pa.array([t for t, _ in flat], pa.large_string())):
            start, end, before = chunk.words()
            hashes.append(kernels.Hasher(chunk.data).of(start, end))
            counts.append(np.diff(before))
        self.tokens, per_block = np.concatenate(hashes), np.concatenate(counts)
        self.block = np.repeat(np.arange(len(flat)), per_block)
        page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        self.page = page_of_block[self.block]
        self.inside = np.array([k for _, k in flat], dtype=np.int64)[self.block] == INSIDE
        ends = np.cumsum(np.bincount(self.page, minlength=len(pages)))
        self.left = ends[self.page] - np.arange(len(self.tokens))
        self.family = families([[t for t, _ in p] for p in pages]) if family is None else family
        self.distinct = len(np.unique(self.family))
        self.whole = np.flatnonzero(self.left >= RUN)

    def grams(self) -> np.ndarray:
        """A hash of the RUN tokens from each place in ``whole`` on, the same in every chunk."""
        out = np.zeros(len(self.whole), dtype=np.uint64)
        for j in range(RUN):
            out = kernels.mix(out * np.uint64(0x9FB21C651E98DF25) + self.tokens[self.whole + j])
        return out.view(np.int64)

    def _pages_of(self, group: np.ndarray, groups: int, at: np.ndarray) -> np.ndarray:
        """Distinct pages of each group, which the places ``at`` are of."""
        seen = np.unique(group * len(self.pages) + self.family[self.page[at]])
        return np.bincount(seen // max(len(self.pages), 1), minlength=groups)

    def repeated(self) -> np.ndarray:
        """For each place in ``whole``, on how many distinct pages the long substring from there on stands."""
        order, shared = suffix_array(self.tokens, self.left)
        group = np.cumsum(shared < RUN) - 1  # neighbours that agree for RUN tokens are of one group
        of = np.empty(len(order), dtype=np.int64)
        of[order] = group
        of = of[self.whole]
        return self._pages_of(of, int(group[-1]) + 1 if len(group) else 0, self.whole)[of]

    def counted(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``grams`` (sorted) that are here, and on how many distinct pages."""
        mine = self.grams()
        at = np.minimum(np.searchsorted(grams, mine), max(len(grams) - 1, 0))
        hit = grams[at] == mine if len(grams) else np.zeros(len(mine), dtype=bool)
        pages = self._pages_of(at[hit], len(grams), self.whole[hit])
        here = np.flatnonzero(pages)
        return grams[here], pages[here]

    def kept(self, pages: np.ndarray, distinct: int) -> tuple[list[str], list[int]]:
        """The text of each page, and how many of its tokens repeated runs cover. ``pages``: for each
        place in ``whole``, on how many of the host's ``distinct`` pages its run is."""

        def covers(share: float, least: int) -> np.ndarray:
            hit = self.whole[pages > max(share * distinct, least - 1)]
            steps = np.zeros(len(self.tokens) + 1, dtype=np.int64)
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + RUN, -1)
            return np.cumsum(steps[:-1]) > 0

        covered = np.where(self.inside, covers(SHARE_INSIDE, LEAST_INSIDE), covers(SHARE_OUTSIDE, LEAST_OUTSIDE))
        n_covered = np.bincount(self.page, weights=covered, minlength=len(self.pages)).astype(np.int64)
        blocks = sum(len(p) for p in self.pages)
        ends = np.cumsum(np.bincount(self.block, minlength=blocks))
        gone = np.bincount(self.block, weights=covered, minlength=blocks)
        out, b = [], 0
        for p in self.pages:
            want = INSIDE if any(k == INSIDE for _, k in p) else OPEN
            parts, whole = [], []
            for t, k in p:
                if k == want:
                    whole.append(t)
                    if gone[b]:
                        words, cover = t.split(" "), covered[ends[b] - t.count(" ") - 1 : ends[b]]
                        t = " ".join(w for w, c in zip(words, cover) if not c)
                    if t:
                        parts.append(t)
                b += 1
            out.append(" ".join(parts or whole))
        return out, n_covered.tolist()


def _packed(pages: list[list[tuple[str, int]]]) -> bytes:
    raw = "\x00".join("\n".join(f"{k}{t}" for t, k in p) for p in pages).encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpacked(pack: bytes) -> list[list[tuple[str, int]]]:
    raw = pa.Codec("zstd").decompress(pack[8:], int.from_bytes(pack[:8], "little"), asbytes=True).decode()
    return [[(line[1:], int(line[0])) for line in p.split("\n")] if p else [] for p in raw.split("\x00")]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the pages of a host and chunk that are near each other in the input; they compress together."""
    for b in batches:
        sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b["html"]), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BATCH_BYTES, "right")))
            part = b.slice(first, last - first)
            first = last
            found = [blocks(page or "") for page in part["html"].to_pylist()]
            groups: dict[tuple, list[int]] = defaultdict(list)
            for i, (p, host, n) in enumerate(zip(found, part["host"].to_pylist(), part["chunks"].to_pylist())):
                chunk = int.from_bytes(hashlib.blake2b(repr(p).encode(), digest_size=7).digest(), "big") % n
                groups[host, chunk].append(i)
            rows, ends = pa.array([i for g in groups.values() for i in g]), np.cumsum([0, *map(len, groups.values())])
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), part[c].take(rows)) for c in ("page_id", "url")]
            packs = pa.array([_packed([found[i] for i in g]) for g in groups.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in groups], pa.string()), pa.array([c for _, c in groups], pa.int64()), *lists, packs], names=["host", "chunk", "ids", "urls", "pack"])


def _group(rows: pa.Table) -> tuple[pa.Array, pa.Array, list]:
    """ids, urls and pages of a host or chunk, in the order of the pages' blocks."""
    pages = [p for x in rows["pack"].to_pylist() for p in _unpacked(x)]
    order = pa.array(sorted(range(len(pages)), key=pages.__getitem__), pa.int64())
    ids, urls = (pa.chunked_array([x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()) for x in rows[c].chunks]).take(order) for c in ("ids", "urls"))
    return ids, urls, [pages[i] for i in order.to_pylist()]


def _alone(rows: pa.Table) -> pa.Table:
    """A host that one array holds."""
    ids, urls, pages = _group(rows)
    stream = Stream(pages)
    texts, covered = stream.kept(stream.repeated(), stream.distinct)
    return pa.table({"page_id": ids, "url": urls, "text": pa.array(texts, pa.string()), "n_repeated": pa.array(covered, pa.int64())})


def _opened(rows: pa.Table) -> pa.Table:
    """A chunk of a host as one row, with the number of its distinct pages and the runs on more than the least share of them."""
    ids, urls, pages = _group(rows)
    stream = Stream(pages)
    often = stream.repeated() > min(SHARE_OUTSIDE, SHARE_INSIDE) * stream.distinct
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)
    return pa.table({
        "host": rows["host"].slice(0, 1), "ids": one(ids), "urls": one(urls), "pack": pa.array([_packed(pages)], pa.binary()), "family": pa.array([stream.family.astype("<i4").tobytes()], pa.binary()),
        "distinct": pa.array([stream.distinct], pa.int64()), "asked": pa.array([np.unique(stream.grams()[often]).tolist()], pa.list_(pa.int64())),
    })


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Stream]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Stream(_unpacked(b["pack"][i].as_py()), np.frombuffer(b["family"][i].as_py(), "<i4").astype(np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, i, stream in _chunks(batches):
        grams, pages = stream.counted(np.sort(b["grams"][i].values.to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([b["host"][i].as_py()] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(pages, pa.int64())], names=["host", "gram", "pages"])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, i, stream in _chunks(batches):
        runs = b["runs"][i].values
        mine = stream.grams()
        pages = np.zeros(len(mine), dtype=np.int64)
        if runs is not None and len(runs):
            grams, counts = runs.field("gram").to_numpy(), runs.field("pages").to_numpy()
            order = np.argsort(grams)
            at = order[np.minimum(np.searchsorted(grams, mine, sorter=order), len(grams) - 1)]
            pages = np.where(grams[at] == mine, counts[at], 0)
        texts, covered = stream.kept(pages, b["all"][i].as_py())
        yield pa.RecordBatch.from_arrays([b["ids"][i].values, b["urls"][i].values, pa.array(texts, pa.string()), pa.array(covered, pa.int64())], names=["page_id", "url", "text", "n_repeated"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (tokens that repeated runs cover) of every row of ``pages``."""
    id_type = pages.schema["page_id"].dataType.simpleString()
    hosted = pages.select("page_id", "url", "html", F.coalesce(host_path(F.col("url"))[0], F.lit("")).alias("host"))
    sizes = hosted.groupBy("host").agg(F.ceil(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64) / CHUNK_BYTES).alias("chunks"))
    large = durable(sizes.filter("chunks > 1"))
    parse = lambda df: df.select("page_id", "url", "html", "host", "chunks").mapInArrow(_parsed, f"host string, chunk long, ids array<{id_type}>, urls array<string>, pack binary")
    kind = f"page_id {id_type}, url string, text string, n_repeated long"
    small = hosted.join(bounded(large.select(F.col("host").alias("_host"))), F.col("host") == F.col("_host"), "left_anti")
    out = parse(small.withColumn("chunks", F.lit(1).cast("long"))).groupBy("host").applyInArrow(_alone, kind)
    if large.limit(1).count():
        chunk = f"host string, ids array<{id_type}>, urls array<string>, pack binary, family binary, distinct long, asked array<long>"
        held = durable(parse(hosted.join(bounded(large), "host")).groupBy("host", "chunk").applyInArrow(_opened, chunk))
        totals = held.groupBy("host").agg(F.sum("distinct").alias("all"))
        asked = durable(held.select("host", F.explode("asked").alias("gram")).distinct())
        # a gram is 8 bytes: counted, they go to the chunks; beyond the bound chunks and grams are dealt by host
        hint = F.broadcast if asked.count() <= ASKED_BROADCAST else (lambda df: df)
        grams = asked.groupBy("host").agg(F.collect_list("gram").alias("grams"))
        counted = held.select("host", "pack", "family").join(hint(grams), "host").mapInArrow(_counted, "host string, gram long, pages long")
        least = F.greatest(F.col("all") * min(SHARE_OUTSIDE, SHARE_INSIDE), F.lit(min(LEAST_OUTSIDE, LEAST_INSIDE) - 1))
        runs = counted.groupBy("host", "gram").agg(F.sum("pages").alias("pages")).join(totals, "host").filter(F.col("pages") > least)
        runs = totals.join(runs.groupBy("host").agg(F.collect_list(F.struct("gram", "pages")).alias("runs")), "host", "left")
        out = out.union(held.join(hint(durable(runs)), "host").select("host", "ids", "urls", "pack", "family", "all", "runs").mapInArrow(_finished, kind))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
