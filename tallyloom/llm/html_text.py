"""Main text of web pages by equivalence-class template deduction.

1. A page is read as tokens: block tags, told apart by the path of block elements around them, and
   runs of text. For every host, each token's occurrence vector over the host's pages is reduced
   to the number of pages, the number of occurrences, and the exclusive or of a hash of (page,
   occurrences); tokens with the same three share their vector and form an equivalence class. These
   are sums, so a host with a third of all pages is a few rows per task.
2. Classes of enough tokens and pages are checked on every page: their tokens must come in the
   same order everywhere, classes may not cross, and a class must always stand in the same gap of
   the class around it. The valid classes, nested in each other's gaps, are the host's template.
3. What lies in the gaps are slots. A page's main text is the text of its slots inside the main
   region: article or main elements, or else the container that holds most of the host's words,
   without elements whose tag, role or class says that they are no part of the article.

Text that belongs to the template itself is dropped, unless a host's pages consist of it (copies).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import slices, stored

#: A class needs this share of the host's pages, this many pages and this many tokens.
SUPPORT, MIN_PAGES, MIN_TOKENS = 0.5, 3, 3
#: A container is the main region of its pages if it holds this share of their words.
CONTAINER_SHARE = 0.6
#: Least share of a host's pages that have a layout of their own; all text of rarer ones stays.
LAYOUT_SHARE = 0.05
#: Tokens a task counts before it hands its counts on.
LOCAL_TOKENS = 200_000
CLOSE = 0x5BD1E995

# Fixed values of HTML: elements inside a line, without content, with raw content, and those that
# end an open paragraph.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
ENDS_P = frozenset(
    "address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul dt dd li tr td th".split()
)
#: Open elements that an element of the same kind ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body div section article main".split())
# Elements, roles and words of class names and ids that mark what is not part of an article.
NOISE_TAGS = frozenset(
    "head nav header footer aside form button select option dialog menu svg canvas object audio video fieldset".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login register nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations "
    "comment comments disqus respond replies reply footer header sidebar masthead toolbar widget widgets skip copyright "
    "teaser teasers toc".split()
)
MAIN_TAGS, HEADINGS = frozenset(("article", "main")), frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section td body center article main".split())

MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=[\"']))", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    noise: bool
    main: bool
    inside: list = field(default_factory=list)
    vague: int = -1


@dataclass(slots=True)
class Token:
    """A block tag (text is None) or a run of text between block tags."""

    path: int
    text: str | None = None
    noise: bool = False
    main: bool = False
    vague: tuple = ()
    containers: tuple = ()
    linked: int = 0


_PATHS: dict[tuple[int, str, str], int] = {}


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _path(parent: int, tag: str, name: str) -> int:
    key = (parent, tag, name)
    found = _PATHS.get(key)
    if found is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        found = _PATHS[key] = _signed(xxhash.xxh64_intdigest(f"{parent} {tag} {name}"))
    return found


def _attributes(tag: str, source: str) -> tuple[str, bool, bool]:
    """Class names, whether the element is surely no content, and whether its names suggest it."""
    if not source or "=" not in source and "hidden" not in source.lower():
        return "", False, False
    names, sure, vague = "", False, False
    for key, value in ATTRIBUTE.findall(source):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            sure |= value.lower() in NOISE_ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            sure = True
        elif key == "style":
            sure |= "display:none" in value.replace(" ", "").lower()
        elif key in ("class", "id"):
            if key == "class":
                names = value
            vague |= any(p.lower() in NOISE_WORDS for p in NAME_PART.findall(value))
    return names, sure, vague and tag not in ("html", "body", "article", "main") or (
        vague and tag == "article" and any(p.lower().startswith(("comment", "repl")) for p in NAME_PART.findall(names))
    )


def read(page: str | None) -> tuple[list[Token], set[int], bool]:
    """Tokens of a page, numbers of elements wrongly suspected, and whether it has a main element."""
    page = page or ""
    stack = [Element("", 0, False, False)]
    tokens: list[Token] = []
    cleared: set[int] = set()
    pieces: list[str] = []
    has_main, links, linked, number, at = False, 0, 0, 0, 0

    def end_run():
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                top = stack[-1]
                tokens.append(Token(
                    top.path, text, top.noise, top.main, tuple(e.vague for e in stack if e.vague >= 0),
                    tuple(e.path for e in stack if e.tag in CONTAINERS), linked,
                ))
            linked = 0

    def pop(count: int):
        for _ in range(count):
            tokens.append(Token(stack.pop().path ^ CLOSE))

    size = len(page)
    while at < size:
        found = MARKUP.search(page, at)
        if not found:
            break
        start, at = found.start(), found.end()
        before = page[found.pos : start] if found.pos < start else ""
        if before:
            pieces.append(before)
            if links:
                linked += before.count(" ") + 1
        tag = found.group(2)
        if tag is None:
            continue
        tag, closing, source = tag.lower(), bool(found.group(1)), found.group(3)
        if at < size and page[at] in "\"'":
            at = page.find(">", at) + 1 or size
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        end_run()
        if closing:
            for depth, element in enumerate(reversed(stack[1:]), 1):
                if element.tag == tag:
                    pop(depth)
                    break
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            pop(1)
        ends = SIBLINGS.get(tag)
        if ends:
            for depth, element in enumerate(reversed(stack[1:]), 1):
                if element.tag in ends:
                    pop(depth)
                    break
                if element.tag in SCOPES:
                    break
        top = stack[-1]
        name, sure, vague = _attributes(tag, source)
        # Classes of html and body often number the page; with them no two pages would share a path.
        path = _path(top.path, tag, "" if tag in ("html", "body") else name)
        tokens.append(Token(path))
        if tag in RAW:
            ending = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = ending.end() if ending else size
            tokens.append(Token(path ^ CLOSE))
            continue
        if tag in VOID or source.endswith("/") and tag not in ENDS_P:
            continue
        noise = top.noise or sure or tag in NOISE_TAGS and not (tag == "header" and top.main)
        element = Element(tag, path, noise, top.main or tag in MAIN_TAGS and not noise and not vague)
        if vague:
            element.vague = number = number + 1
        if tag in MAIN_TAGS and not noise and not vague:
            has_main = True
            cleared.update(e.vague for e in stack if e.vague >= 0)
        stack.append(element)
    if at < size:
        pieces.append(page[at:])
    end_run()
    pop(len(stack) - 1)
    return tokens, cleared, has_main


def _is_noise(token: Token, cleared: set[int]) -> bool:
    return token.noise or any(v not in cleared for v in token.vague)


def _text_token(token: Token) -> int:
    return _signed(xxhash.xxh64_intdigest(token.text, seed=token.path & 0xFFFFFFFF))


def _key(token: Token) -> int:
    return token.path if token.text is None else _text_token(token)


def _count(pages: DataFrame) -> DataFrame:
    """Occurrences of tokens, and words of containers, by host, summed up within tasks.

    The pages of a container are those most of whose words it holds, its total the words of all its pages.
    """
    names = ["host", "token", "is_text", "pages", "total", "vector", "words", "depth"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        counts: dict[tuple[str, int, int], list[int]] = {}

        def flush():
            columns = [[*k, *v] for k, v in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*columns), types)] if columns else [pa.array([], t) for t in types],
                names=names,
            )

        for batch in slices(batches):
            for page_id, host, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens, cleared, _ = read(page)
                own: dict[tuple[str, int, int], int] = {}
                for token in tokens:
                    key = (host, _key(token), int(token.text is not None))
                    own[key] = own.get(key, 0) + 1
                own[(host, 0, 2)] = 1
                mark = f"{page_id} {xxhash.xxh64_intdigest(page or '')}"
                for key, times in own.items():
                    entry = counts.setdefault(key, [0, 0, 0, 0, 0])
                    entry[0] += 1
                    entry[1] += times
                    entry[2] ^= _signed(xxhash.xxh64_intdigest(mark, seed=times))
                page_words, inside = 0, {}
                for token in tokens:
                    if token.text is not None and not _is_noise(token, cleared):
                        words = max(token.text.count(" ") + 1 - token.linked, 0)
                        page_words += words
                        for depth, path in enumerate(token.containers):
                            inside[path] = inside.get(path, (0,))[0] + words, depth
                for path, (words, depth) in inside.items():
                    entry = counts.setdefault((host, path, 3), [0, 0, 0, 0, 0])
                    entry[0] += 0 < words >= CONTAINER_SHARE * page_words
                    entry[1] += page_words
                    entry[3] += words
                    entry[4] = depth
            if len(counts) > LOCAL_TOKENS:
                yield flush()
        yield flush()

    parts = pages.mapInArrow(run, "host string, token long, is_text int, pages long, total long, vector long, words long, depth int")
    return parts.groupBy("host", "token", "is_text").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"),
        F.sum("words").alias("words"), F.max("depth").alias("depth"),
    )


def _classes(counts: DataFrame) -> DataFrame:
    """host, own (tokens with their class) and containers, one row per host.

    A container holds most words of its pages, both together and page by page, so that neither one
    long page nor many short ones decide alone. First comes the deepest that does so on half of the
    host's pages, then, for pages without it, those that do so on half as many pages as are left.
    """
    sizes = counts.filter("is_text = 2").select(F.col("host").alias("of"), F.col("pages").alias("host_pages"))
    tokens = counts.filter("is_text < 2")
    classes = (
        tokens.groupBy("host", "pages", "total", "vector")
        .agg(F.count("*").alias("size"), F.count_if(F.col("is_text") == 0).alias("tags"))
        .filter((F.col("size") >= MIN_TOKENS) & (F.col("tags") >= 2) & (F.col("pages") >= MIN_PAGES))
        .join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("pages") >= SUPPORT * F.col("host_pages"))
        .select("host", "pages", "total", "vector", F.xxhash64("pages", "total", "vector").alias("class"))
    )
    chosen = tokens.join(
        classes.withColumnsRenamed({"host": "h", "pages": "n", "total": "m", "vector": "x"}),
        F.col("host").eqNullSafe(F.col("h")) & (F.col("pages") == F.col("n"))
        & (F.col("total") == F.col("m")) & (F.col("vector") == F.col("x")),
    )
    # A group holds the tokens that stand on at least half of a host's pages.
    own = chosen.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("own"))
    words = counts.filter("is_text = 3")
    held = words.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("words") >= CONTAINER_SHARE * F.col("total"))
    inner = held.filter(F.col("pages") >= SUPPORT * F.col("host_pages")).groupBy(F.col("host").alias("c")).agg(
        F.max_by(F.struct("token", "pages"), F.struct("depth", "words", "token")).alias("container")
    )
    without = F.col("host_pages") - F.coalesce("container.pages", F.lit(0))
    least = F.greatest(F.lit(MIN_PAGES), SUPPORT * without, LAYOUT_SHARE * F.col("host_pages"))
    # At most 1 / LAYOUT_SHARE containers of a depth.
    layouts = (
        held.join(inner, F.col("host").eqNullSafe(F.col("c")), "left")
        .filter(F.col("pages").between(least, without))
        .groupBy(F.col("host").alias("l"))
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "words", "token"))))["token"].alias("layouts"))
    )
    none = F.array().cast("array<bigint>")
    containers = F.concat(
        F.when(F.col("container").isNull(), none).otherwise(F.array("container.token")), F.coalesce("layouts", none)
    )
    return stored(
        sizes.join(own, F.col("of").eqNullSafe(F.col("host")), "left").drop("host")
        .join(inner, F.col("of").eqNullSafe(F.col("c")), "left")
        .join(layouts, F.col("of").eqNullSafe(F.col("l")), "left")
        .select(
            "of", F.coalesce("own", F.array().cast("array<struct<token:bigint,class:bigint>>")).alias("own"),
            containers.alias("containers"),
        )
    )


def _instances(keys: list[int], classes: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Places of each class's tokens on a page, as (place, token)."""
    found: dict[int, list[tuple[int, int]]] = {}
    for place, key in enumerate(keys):
        own = classes.get(key)
        if own is not None:
            found.setdefault(own, []).append((place, key))
    return found


def check_page(tokens: list[Token], classes: dict[int, int]) -> list[tuple[int, int, int]]:
    """For each class of the page: class, hash of its order, hash of the gap that it stands in.

    The order is zero where the class's tokens don't repeat in one order.
    """
    found = _instances([_key(t) for t in tokens], classes)
    spans = {c: (p[0][0], p[-1][0]) for c, p in found.items()}
    out = []
    for own, places in found.items():
        width = len({k for _, k in places})
        order = [k for _, k in places[:width]]
        regular = len(set(order)) == width and [k for _, k in places] == order * (len(places) // width)
        first, last = spans[own]
        around, crossed = None, False
        for other, (a, b) in spans.items():
            if other == own or b < first or last < a:
                continue
            if a < first and last < b:
                if around is None or a > spans[around][0]:
                    around = other
            elif not (first < a and b < last):
                crossed = True
        gap = 0
        if around is not None:
            size = len({k for _, k in found[around]})
            gap = sum(p < first for p, _ in found[around]) % size + 1
        text = ",".join(map(str, order))
        out.append((own, _signed(xxhash.xxh64_intdigest(text)) if regular and not crossed else 0,
                    _signed(xxhash.xxh64_intdigest(f"{around} {gap}"))))
    return out


def templates(pages: DataFrame) -> DataFrame:
    """of (the host), own (tokens of valid classes), containers, and use_text, one row per host."""
    raw = _classes(stored(_count(pages)))
    joined = pages.join(raw, F.col("host").eqNullSafe(F.col("of")), "left").select("host", "html", "own")
    names = ["host", "class", "low", "high", "inside_low", "inside_high", "fixed", "free"]
    types = [pa.string(), *[pa.int64()] * 7]

    def run(batches):
        seen: dict[tuple[str, int], list[int]] = {}
        for batch in slices(batches):
            for host, page, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                classes = {x["token"]: x["class"] for x in own or ()}
                tokens, cleared, has_main = read(page)
                for name, order, inside in check_page(tokens, classes):
                    e = seen.setdefault((host, name), [order, order, inside, inside, 0, 0])
                    e[0], e[1] = min(e[0], order), max(e[1], order)
                    e[2], e[3] = min(e[2], inside), max(e[3], inside)
                e = seen.setdefault((host, 0), [0] * 6)
                for t in tokens:
                    if t.text is not None and not _is_noise(t, cleared) and (t.main or not has_main):
                        e[4 if _text_token(t) in classes else 5] += t.text.count(" ") + 1
        rows = [[*k, *v] for k, v in seen.items()]
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    checked = (
        joined.mapInArrow(run, "host string, class long, low long, high long, inside_low long, inside_high long, fixed long, free long")
        .groupBy("host", "class")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("inside_low").alias("inside_low"),
             F.max("inside_high").alias("inside_high"), F.sum("fixed").alias("fixed"), F.sum("free").alias("free"))
    )
    valid = (F.col("class") != 0) & (F.col("low") == F.col("high")) & (F.col("low") != 0) & (
        F.col("inside_low") == F.col("inside_high")
    )
    per_host = checked.groupBy(F.col("host").alias("v")).agg(
        F.collect_list(F.when(valid, F.col("class"))).alias("valid"),
        F.max(F.when(F.col("class") == 0, F.col("free") >= F.col("fixed"))).alias("use_text"),
    )
    return stored(
        raw.join(per_host, F.col("of").eqNullSafe(F.col("v")), "left").select(
            "of", F.filter("own", lambda x: F.array_contains("valid", x["class"]))["token"].alias("own"),
            "containers", "use_text",
        )
    )


def main_text(
    page: str | None, template: set[int], containers: list[int] | None, use_text: bool
) -> list[tuple[int, str]]:
    """Slots of the main region in page order: the template token before the slot, and a text.

    A page without a main element is narrowed to the first of the containers that leaves it a text.
    """
    tokens, cleared, has_main = read(page)
    slot, found = 0, []
    for token in tokens:
        if token.text is None:
            if token.path in template:
                slot = token.path
        elif not _is_noise(token, cleared) and (token.main or not has_main):
            if not (use_text and template and _text_token(token) in template):
                found.append((slot, token))
    for container in () if has_main else containers or ():
        inside = [(s, t) for s, t in found if container in t.containers]
        if inside:
            found = inside
            break
    return [(s, t.text) for s, t in found]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and slots of every page.

    text: blocks in page order joined by one blank, character references decoded, white space
    turned into one blank. slots: the same texts with the template token that their slot follows.
    A null html is an empty page with an empty text; a null or odd url belongs to a host of its
    own name, null or what stands before the path. Hosts of fewer than three pages have no
    template, so that tags and names alone decide. Repeated rows are read alike; other columns
    are ignored; an empty table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    source = pages.select("page_id", "url", "html", host.alias("host"))
    known = templates(source.select("page_id", "host", "html"))
    joined = source.join(known, F.col("host").eqNullSafe(F.col("of")), "left").select(
        "page_id", "url", "html", "own", "containers", "use_text"
    )
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.select("page_id", "url").schema)
    slots_type = pa.list_(pa.struct([("slot", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for batch in slices(batches):
            texts, slots = [], []
            for page, own, containers, use_text in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                found = main_text(page, set(own or ()), containers, bool(use_text))
                texts.append(" ".join(t for _, t in found))
                slots.append([{"slot": s, "text": t} for s, t in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(slots, slots_type)],
                names=["page_id", "url", "text", "n_chars", "slots"],
            )

    return joined.mapInArrow(run, f"{fields}text string, n_chars long, slots array<struct<slot:long,text:string>>")
