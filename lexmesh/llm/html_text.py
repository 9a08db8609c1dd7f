"""Main text of web pages: page structure, and a suffix array of each host's token streams.

The tokens of a page outside of its marked article are one stream. In each task the streams of a host are concatenated and their
suffixes sorted to the depth of the shortest run that counts (prefix doubling); suffixes that agree that far are
neighbours and are summarised as one run with the bodies of the pages that hold it. What all parts of a host hold is merged by
an aggregate, so a host of any size is never in one place, and a run is boilerplate if enough different bodies of the
host's pages hold it; copies of a page have one body. On pages that mark no article, blocks that such runs cover are dropped; what is a
page's own stays. A marked article is the page's own, whatever other pages repeat of it.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.storage import written
from lexmesh.llm.words import Polynomial, mix, signed

# Elements without content, whose content is no markup, whose content is markup that is not shown as text, that end a
# block, and that are never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
HIDDEN = frozenset("audio canvas noscript select svg template video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CHROME = frozenset("aside button dialog footer form menu nav".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo related respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split())
# Words behind a chrome word that only say which part of the page's layout an element is.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box btn button buttons column container desktop form frame group header holder icon icons inner item items left link links list "
    "mobile module outer panel right row section slot title top unit wrap wrapper zone".split())
# Elements that hold a text of their own, which are chrome only if one of their names is a chrome word and nothing else.
PROSE = frozenset("blockquote caption dd dt em figcaption figure h1 h2 h3 h4 h5 h6 i li p pre span strong table td th tr b a code q cite".split())
ARTICLE = frozenset(["article", "main"])
FOREIGN = frozenset(["svg", "math"])
_P_CLOSERS = BLOCK - {"body", "html", "head"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}

_UNQUOTED = re.compile(r"=\s*[^\s\"'][^\s]*\Z")

MIN_RUN = 8
MIN_BODIES = 3
LEAST_SHARE = 0.2
_PART_TOKENS = 1 << 20
_RUN_A, _RUN_B, _TOKEN = Polynomial(41), Polynomial(42), Polynomial(43)


def _chrome_name(value: str, prose: bool) -> bool:
    """Whether a class name or id names page chrome.

    The last word of a compound says what the thing is: ``main-menu`` is a menu and ``menu-history`` a history. Words that only say where
    something is laid out, and numbers, do not count as the last one: ``ad-box-2`` is an ad. Of ``prose`` only whole names count.
    """
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()) if w]
    if prose:
        return len(words) == 1 and words[0] in CHROME_WORDS
    while len(words) > 1 and words[-1] in LAYOUT_WORDS:
        words.pop()
    return bool(words) and words[-1] in CHROME_WORDS


def _role(name: str, attributes: str, inside: bool) -> str:
    """'article', 'chrome' or '' of an element; ``inside`` says that an article is already open."""
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if name in CHROME or "hidden" in found or (name == "header" and not inside):
        return "chrome"
    role = found.get("role", "").lower()
    if role in CHROME_ROLES:
        return "chrome"
    if name not in ("html", "body", "main") and not (name == "article" and not inside):
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        if any(_chrome_name(n, name in PROSE) for n in names):
            return "chrome"
    return "article" if name in ARTICLE or role in ARTICLE or found.get("itemprop", "").lower() == "articlebody" else ""


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in chrome) of each block in page order; unclosed and stray tags are tolerated.

    An element of ``HIDDEN`` that is not closed ends with its parent, and where a block begins that it cannot hold; one of ``RAW`` ends
    with its own end tag or the page, as in browsers.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    article = chrome = hidden = 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip(" ")
            pieces.clear()
            if text:
                out.append((text, article > 0, chrome > 0))

    def close(depth: int) -> None:
        nonlocal article, chrome, hidden
        while len(stack) > depth:
            _, role = stack.pop()
            article -= role == "article"
            chrome -= role == "chrome"
            hidden -= role == "hidden"

    at = 0
    while match := _TAG.search(page, at):
        if match.start() > at and not hidden:
            pieces.append(html.unescape(page[at:match.start()]))
        at = match.end()
        if not (name := match[2]):
            continue
        name = name.lower()
        if match[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            # what ends inside of a hidden element ends no block
            inside = hidden and (depth is None or any(r == "hidden" for _, r in stack[:depth]))
            if name in BLOCK and not inside:
                flush()
            if depth is not None:
                if not inside and any(r not in ("", "hidden") for _, r in stack[depth:]):
                    flush()
                close(depth)
            continue
        if match[3].endswith("/") and not _UNQUOTED.search(match[3]) and (name in FOREIGN or any(n in FOREIGN for n, _ in stack)):
            continue  # an empty element
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if hidden:
            top = max(i for i, (_, r) in enumerate(stack) if r == "hidden")
            within = {n for n, _ in stack[top + 1:]}
            if name in BLOCK and (stack[top][0] == "select" and name not in ("hr", "optgroup", "option") or stack[top][0] == "svg" and "foreignobject" not in within):
                close(top)
        if hidden:
            if name not in VOID:
                stack.append((name, "hidden" if name in HIDDEN else ""))
                hidden += name in HIDDEN
            continue
        if name == "br":
            pieces.append(" ")
        if name in BLOCK:
            flush()
            if name in _P_CLOSERS:  # an open paragraph ends where a block begins; an open item where the next one does
                for last in ("p", *(["li"] if name == "li" else [])):
                    depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == last or stack[i][0] in ("ul", "ol", "td", "article", "main", "section", "div") and last == "li"), None)
                    if depth is not None and stack[depth][0] == last:
                        close(depth)
        if name in VOID:
            continue
        role = "hidden" if name in HIDDEN else _role(name, match[3], article > 0)
        if role not in ("", "hidden"):
            flush()
        stack.append((name, role))
        article += role == "article"
        chrome += role == "chrome"
        hidden += role == "hidden"
    if at < len(page) and not hidden:
        pieces.append(html.unescape(page[at:]))
    flush()
    return out


def _outside(found: list[tuple[str, bool, bool]]) -> list[str]:
    """Tokens of all blocks outside of articles, those in chrome included: one stream a page."""
    return [t for text, article, _ in found if not article for t in text.split(" ")]


def _open(found: list[tuple[str, bool, bool]]) -> bool:
    """No article is marked."""
    return not any(article for _, article, _ in found)


def _digest(blocks_of: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(blocks_of).encode(), digest_size=8).digest(), "little", signed=True)


def _main(found: list[tuple[str, bool, bool]]) -> list[str]:
    """The blocks that can be main text: those of the article, or all if none is marked, without chrome."""
    marked = not _open(found)
    return [text for text, article, chrome in found if not chrome and (article or not marked)]


def _token_ids(tokens: list[str]) -> np.ndarray:
    data = "".join(tokens).encode()
    ends = np.cumsum([len(t.encode()) for t in tokens])
    values = mix(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1))
    return _TOKEN.between(_TOKEN.prefix(values), np.concatenate(([0], ends[:-1])), ends)


def suffix_order(tokens: np.ndarray, owner: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of concatenated streams to ``depth`` tokens; suffixes of equal rank agree that far.

    Streams are kept apart by separators of their own, so a shorter suffix agrees with no other. Prefix doubling:
    the ranks of single tokens give those of pairs, then of four and so on.
    """
    count = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    last = np.searchsorted(owner, owner, side="right")  # where each stream ends
    at, known = np.arange(count), 1
    while known < depth:
        step = min(known, depth - known)
        further = at + step
        inside = further < last
        # beyond its stream's end a suffix is ranked by the stream, which differs from all ranks inside
        second = np.where(inside, rank[np.minimum(further, count - 1)], count + owner)
        _, rank = np.unique(rank.astype(np.int64) * np.int64(2 * count + 1) + second, return_inverse=True)
        known += step
    return np.argsort(rank, kind="stable"), rank


_RUNS = pa.schema([("host", pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("body", pa.int64()), ("page", pa.int64()), ("start", pa.int32())])


def _rows(host: str, **columns) -> pa.RecordBatch:
    count = len(next(iter(columns.values())))
    columns["host"] = [host] * count
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _RUNS], schema=_RUNS)


def _streams(min_run: int):
    """Rows of three kinds: a body of the host; a run and a body that holds it; a run and the page, without a marked article, that has it at ``start``."""
    def summarise(host: str, held: list[tuple[int, int, np.ndarray, bool]]) -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([ids for _, _, ids, _ in held])
        sizes = np.array([len(ids) for _, _, ids, _ in held])
        owner = np.repeat(np.arange(len(held)), sizes)
        order, rank = suffix_order(tokens, owner, min_run)
        ends = np.cumsum(sizes)
        order = order[order + min_run <= ends[owner[order]]]  # suffixes long enough to hold a run
        if not len(order):
            return
        bodies = np.array([b for _, b, _, _ in held], np.int64)[owner[order]]
        a = signed(_RUN_A.between(_RUN_A.prefix(tokens), order, order + min_run))
        b = signed(_RUN_B.between(_RUN_B.prefix(tokens), order, order + min_run))
        by_body = np.lexsort((bodies, rank[order]))
        runs, holders = rank[order][by_body], bodies[by_body]
        first = by_body[np.concatenate(([True], (runs[1:] != runs[:-1]) | (holders[1:] != holders[:-1])))]
        yield _rows(host, d1=a[first], d2=b[first], body=bodies[first])
        asked = np.flatnonzero(np.array([o for _, _, _, o in held])[owner[order]])
        if len(asked):
            pages = np.array([p for p, _, _, _ in held], np.int64)[owner[order]]
            yield _rows(host, d1=a[asked], d2=b[asked], page=pages[asked], start=(order - (ends - sizes)[owner[order]])[asked].astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = {}
        count = 0
        for batch in batches:
            known: dict[str, set[int]] = {}
            for host, page, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = blocks(value.as_py() or "")
                if main := _main(found):
                    body = _digest(main)
                    known.setdefault(host, set()).add(body)
                    if tokens := _outside(found):
                        parts.setdefault(host, []).append((page, body, _token_ids(tokens), _open(found)))
                        count += len(tokens)
                if count >= _PART_TOKENS:
                    for name, held in parts.items():
                        yield from summarise(name, held)
                    parts, count = {}, 0
            for name, bodies in known.items():
                yield _rows(name, body=sorted(bodies))
        for name, held in parts.items():
            yield from summarise(name, held)

    return run


def main_text(page: str, covered: list[int] | None, min_run: int) -> str:
    """Article blocks without chrome; on a page without a marked article all blocks but chrome and those that boilerplate covers.

    ``covered`` has the tokens at which runs of boilerplate start. A page that would lose all of its blocks has nothing else and loses none.
    """
    found = blocks(page)
    main = _main(found)
    if not _open(found):
        return "\n".join(main)
    hidden = {i for start in covered or () for i in range(start, start + min_run)}
    out, at = [], 0
    for text, _, chrome in found:
        size = text.count(" ") + 1
        if not chrome and not all(i in hidden for i in range(at, at + size)):
            out.append(text)
        at += size
    return "\n".join(out or main)


def _extracted(min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py() or "", starts.as_py(), min_run) for value, starts in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    The text is the page's article (``article`` or ``main`` elements, or marked so) without menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments; a header inside an article is part of it. Pages that mark no
    article keep all other blocks, but for those all of whose tokens lie in runs of ``min_run`` tokens that are boilerplate of the host: held by
    ``MIN_BODIES`` different bodies and ``LEAST_SHARE`` of the host's at least, where a body is what a page keeps by its tags alone. Equal
    bodies count once, so copies of a page are no boilerplate. Blocks go whole or not at all.
    Character references are decoded, ``[\\x20\\x09-\\x0D]`` inside a block becomes one space, blocks are joined by
    one line end. Null html is empty. Rows with null address share one host. Extra columns are not read.
    """
    # user information and ports are no part of a host
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("page", F.xxhash64("page_id", "url", "html"))
    runs = rows.select(host.alias("host"), "page", "html").mapInArrow(_streams(min_run), "host string, d1 long, d2 long, body long, page long, start int")
    runs = written(runs, "host-runs")
    bodies = written(runs.filter("d1 is null").select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("bodies")), "host-bodies")
    held = runs.filter("page is null and d1 is not null").select("host", "d1", "d2", "body").distinct().groupBy("host", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    repeated = held.filter(F.col("n") >= MIN_BODIES).join(bodies, "host").filter(F.col("n") >= LEAST_SHARE * F.col("bodies"))
    repeated = written(repeated.select("host", "d1", "d2"), "repeated-runs")
    asked = runs.filter("page is not null").select("host", "d1", "d2", "page", "start").join(repeated, ["host", "d1", "d2"])
    # as a table the size of what is covered is known, and Spark moves the pages only if it is large
    covered = written(asked.groupBy(F.col("page").alias("_page")).agg(F.collect_set("start").alias("covered")), "covered-runs")
    placed = rows.join(covered, F.col("page") == F.col("_page"), "left").select("page_id", "url", "html", "covered")
    return placed.mapInArrow(_extracted(min_run), "page_id long, url string, text string, n_chars long")
