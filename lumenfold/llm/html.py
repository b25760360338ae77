"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of tags (with the words of their class, id and role) and runs of text, nested as its elements
are. Streams of one host are aligned, the first with the next, the result with the next and so on: what follows itself
is a repeated group, what only one side has is an optional one, and differing texts become one text slot. A slot keeps
how often and on how many pages it was seen, its length, and how much of it was link text. The result, a union-free
expression over the host's pages, is the host's wrapper. On how many pages a place shows each text and links to each
target is counted beside it, for all of them, by (host, place, digest).

What the wrapper shows decides, before the page's own words do:

* a text outside article and main that at least three of the host's pages and half of them have in one slot belongs to the
  template, not to the page (in a slot that holds mostly the pages' own text: nine of ten pages), and goes, whatever its
  element is called. Pages of one text count as one page, so copies make no template; where it would take over ``COPIES``
  of a host's runs it says nothing, and no page loses all of its text to it;
* a slot of short runs that are mostly link text, in a repeated element, is a menu if its links lead to the same places
  from several pages;
* an element that holds most of the host's text and its headline or article isn't noise because of its name.

Elsewhere a slot's role follows from the elements around it: article, other body text, or noise (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments). A page's text is that of its slots with the
role article, or, on a page without such, of those with other body text.

Pages are combined in a tree: all pages of a host in a task, then by (host, salt), then by host, so a host with a
third of all pages is no single task's work. Only what differs from the roles by name is told to the readers of pages:
broadcast up to ``BROADCAST_BYTES``, joined by shuffle beyond.

Defined cases: a null or empty page gives an empty text; pages with a null url (or one without a host) are one host;
repeated rows give repeated rows; broken markup (unclosed or stray tags, an unfinished comment or script) is read as
far as it goes; elements nested deeper than ``DEPTH`` count as the ``DEPTH``-th; an empty table gives an empty result;
other input columns are not read.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import materialize, ship

BROADCAST_BYTES = 16_000_000
SALTS = 32
#: Pages that are copies of others are told by broadcast up to so many.
BROADCAST_COPIES = 200_000
#: Longest group that folding looks for, in items; nesting told apart.
PERIOD, DEPTH = 12, 80
#: Share of a host's runs of text above which repeated texts mean copied pages.
COPIES = 0.6
#: Items above which two lists of children are aligned by name alone.
LONG = 600

# The elements of HTML by their part in a page.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = set("nav footer aside form script style noscript template iframe svg canvas object button select option textarea input label dialog menu head title datalist audio video map".split())
#: A class, id or role that is one of these, or ends in one behind a dash ("site-footer"), marks noise.
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer"
    " header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations comment comments"
    " disqus replies respond pagination pager login signin signup register search toolbar skip copyright legal complementary contentinfo dialog".split()
)
#: These mark noise also in front of a dash ("ad-slot").
NOISE_STARTS = set("ad ads advert adsense sponsored promo nav navbar menu breadcrumb breadcrumbs sidebar widget footer cookie newsletter social share related comment comments disqus popup modal pagination".split())
#: In front of a dash these turn the meaning ("has-sidebar").
NOT_THESE = set("has no with without is not hide show".split())
MAIN_TAGS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Noise by tag that an element holding most of a host's text may turn out not to be.
WRAPPING_TAGS = {"form", "label", "dialog", "object"}
_RAW = "script|style|textarea|title|noscript|template|iframe|svg|xmp"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + _RAW + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*|[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TARGET = re.compile(r"(?:^|\s)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RESPONSIVE = re.compile(r"[a-z0-9]+:(?:block|flex|grid|inline\S*|table)$")
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_BLOCKS = set("div article section main body td li blockquote aside nav footer header form".split())
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def element(tag: str, attrs: str) -> str:
    """The tag's name with the sorted words of its class and role, of its id those that mark noise (an id is one page's own
    more often than not), and ``hidden`` if it is. Digits are one digit, so that numbered elements are alike."""
    words: set[str] = set()
    for m in _ATTR.finditer(attrs) if attrs.strip() else ():
        name = m[1].lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            tokens = value.split()
            if "hidden" in tokens and any(map(_RESPONSIVE.match, tokens)):
                tokens.remove("hidden")  # hidden at some widths only
            tokens = [re.sub(r"\d+", "0", re.sub(r"[./#<>?+]", ":", t)) for t in tokens]
            words.update(t for t in tokens if name != "id" or t == "hidden" or _marks([t]))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            words.add("hidden")
    return ".".join([tag, *sorted(words)])


def _marks(words: list[str]) -> set[str]:
    """The noise words among an element's words."""
    found = set()
    for w in words:
        if w in NOISE_WORDS:
            found.add(w)
            continue
        parts = [p for p in re.split(r"[^a-z]+", w) if p]
        if len(parts) > 1 and parts[0] not in NOT_THESE:
            if parts[-1] in NOISE_WORDS:
                found.add(parts[-1])
            elif parts[0] in NOISE_STARTS:
                found.add(parts[0])
    return found


def noise(e: str, in_article: bool) -> bool:
    tag, *words = e.split(".")
    if tag in NOISE_TAGS or "hidden" in words or tag == "header" and not in_article:
        return True
    bad = _marks(words) if words else set()
    return bool(bad) and tag not in ("html", "body") and not (in_article and bad <= {"header"})


def role(place: tuple[str, ...], plain: frozenset[str] = frozenset()) -> str:
    """article, body or noise, by the elements around a slot, outermost first; those at ``plain`` places aren't noise."""
    inside = False
    heading = any(e.partition(".")[0] in HEADINGS for e in place)
    for i, e in enumerate(place):
        tag = e.partition(".")[0]
        if "/".join(place[: i + 1]) not in plain if plain else True:
            if noise(e, inside) or inside and tag == "header" and not heading:
                return "noise"
        inside = inside or tag in MAIN_TAGS
    return "article" if inside else "body"


def stream(page: str):
    """(kind, value): 'open' and 'close' of block elements, with ends that markup leaves out; 'text' and 'link' text;
    'target' of a link; 'space' at br. Text in inline elements that are noise isn't in it."""
    stack: list[str] = []
    links, muted = 0, []
    at = 0

    def name(e: str) -> str:
        return e.partition(".")[0]

    def text(raw: str):
        if not muted:
            yield ("link" if links else "text"), raw

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield from text(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in INLINE:
            if tag == "br":
                yield "space", ""
            elif m["close"]:
                links -= tag == "a" and links > 0
                if muted and muted[-1] == tag:
                    muted.pop()
            else:
                links += tag == "a"
                if tag == "a" and (to := _TARGET.search(m["attrs"] or "")):
                    yield "target", to[1] or to[2] or to[3] or ""
                if tag not in VOID and (muted or m["attrs"] and noise(element(tag, m["attrs"]), True)):
                    muted.append(tag)
            continue
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if name(stack[i]) == tag:
                    links, muted = 0, []
                    for e in reversed(stack[i:]):
                        yield "close", e
                    del stack[i:]
                    break
            continue
        ends = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        scope = _SCOPES.get(tag, _BLOCKS)
        for i in range(len(stack) - 1, -1, -1):
            if name(stack[i]) in ends:
                links, muted = 0, []
                for e in reversed(stack[i:]):
                    yield "close", e
                del stack[i:]
                break
            if name(stack[i]) in scope:
                break
        e = element(tag, m["attrs"] or "")
        yield "open", e
        if tag in VOID:
            yield "close", e
        else:
            stack.append(e)
    if at < len(page):
        yield from text(page[at:])
    for e in reversed(stack):
        yield "close", e


def runs(page: str):
    """(place, elements open since the last run, text, characters of link text, first link's target) of each run of text,
    its white space made single; place is a tuple of elements, of which the first so many are still those of the last run."""
    stack: list[str] = []
    part: list[str] = []
    linked = open_ = 0
    target = ""
    for kind, value in stream(page):
        if kind == "target":
            target = target or value
            continue
        if kind in ("text", "link"):
            part.append(value)
            if kind == "link":
                linked += len(value)
            continue
        if kind == "space":
            part.append(" ")
            continue
        if part:
            if text := " ".join(entities.unescape("".join(part)).split()):
                yield tuple(stack[:DEPTH]), min(open_, DEPTH), text, min(linked, len(text)), target
                open_ = len(stack)
            part, linked = [], 0
        target = ""
        if kind == "open":
            stack.append(value)
        else:
            stack.pop()
            open_ = min(open_, len(stack))
    if part and (text := " ".join(entities.unescape("".join(part)).split())):
        yield (), 0, text, min(linked, len(text)), target


def digest(text: str) -> str:
    import xxhash

    return xxhash.xxh64_hexdigest(text)


# Items of a wrapper: a slot ["#", runs, characters, of them link text, pages], where a page that is one of k copies counts
# a k-th, an element
# ["<", name, pages, repeated, items], a group ["(", "", pages, repeated, items]. An item on fewer pages than what is
# around it is optional.


def tokens(page: str, weight: float = 1) -> list:
    """The page's own wrapper: its elements that hold text, what follows itself folded. A copy of other pages weighs less."""
    top: list = []
    open_: list[list] = []
    for place, same, text, linked, _ in runs(page):
        del open_[same:]
        for e in place[same:]:
            items: list = []
            (open_[-1] if open_ else top).append(["<", e, weight, False, items])
            open_.append(items)
        (open_[-1] if open_ else top).append(["#", weight, weight * len(text), weight * linked, weight])

    def folded(items: list) -> list:
        for x in items:
            if x[0] != "#":
                x[4] = folded(x[4])
        return fold(items)

    return folded(top)


def shape(item: list) -> str:
    return "#" if item[0] == "#" else f"{item[1]}({' '.join(map(shape, item[4]))})"


def fold(items: list) -> list:
    """Runs of neighbours of one shape become repeated items or groups; shortest first."""
    for period in range(1, PERIOD + 1):
        if len(items) < 2 * period:
            break
        shapes = list(map(shape, items))
        out, i = [], 0
        while i < len(items):
            body, j = items[i : i + period], i + period
            while shapes[j : j + period] == shapes[i : i + period]:
                body = [merge(x, y, False) for x, y in zip(body, items[j : j + period], strict=True)]
                j += period
            if j == i + period or period == 1 and body[0][0] == "#":
                out.append(items[i])
                i += 1
                continue
            if period == 1:
                body[0][3] = True
            out += body if period == 1 else [["(", "", max(x[4] if x[0] == "#" else x[2] for x in body), True, body]]
            i = j
        items = out
    return items


def merge(a: list, b: list, pages: bool) -> list:
    """The item over both, which are of different pages or of one."""
    if a[0] == "#":
        return ["#", a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4] if pages else max(a[4], b[4])]
    return [a[0], a[1], a[2] + b[2] if pages else max(a[2], b[2]), a[3] or b[3], align(a[4], b[4], pages)]


def _same(a: list, b: list) -> bool:
    if a[0] != "(" or b[0] != "(":
        return a[0] == b[0] and (a[0] == "#" or a[1] == b[1])
    return _same(a[4][0], b[4][0])


def _by_name(a: list, b: list, pages: bool) -> list:
    """Long lists: one repeated item for each name."""
    out: dict[str, list] = {}
    for side in (a, b):
        own: dict[str, list] = {}
        for x in side:
            key = "#" if x[0] == "#" else shape(x) if x[0] == "(" else x[1]
            own[key] = x if key not in own else merge(own[key], x, False)
        for key, x in own.items():
            out[key] = x if key not in out else merge(out[key], x, pages)
            if x[0] != "#":
                out[key][3] = True
    return list(out.values())


def align(a: list, b: list, pages: bool = True) -> list:
    """The union-free expression over both lists: aligned items, and optional ones that only one side has."""
    if len(a) == len(b) and all(map(_same, a, b)):
        return [merge(x, y, pages) for x, y in zip(a, b, strict=True)]
    if max(len(a), len(b)) > LONG:
        return _by_name(a, b, pages)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if _same(a[i], b[j]) else max(below[j], row[j + 1])
    out: list = []

    def put(x: list) -> None:
        """Once more of a repeated item is no item of its own."""
        if out and x[0] == "<" and _same(out[-1], x) and (out[-1][3] or x[3]):
            x = merge(out.pop(), x, False)
            x[3] = True
        out.append(x)

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and _same(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            put(merge(a[i], b[j], pages))
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            put(a[i])
            i += 1
        else:
            put(b[j])
            j += 1
    return out


def expression(items: list, pages: int) -> str:
    """The wrapper as text: ( )+ repeated, ( )? optional, # a text slot."""
    out = []
    for x in items:
        seen = x[4] if x[0] == "#" else x[2]
        text = "#" if x[0] == "#" else expression(x[4], seen)
        text = f"<{x[1]}> {text} </{x[1]}>" if x[0] == "<" else text
        if x[0] != "#" and x[3]:
            text = f"({text})+"
        out.append(f"({text})?" if seen < pages else text)
    return " ".join(out)


def rules(items: list, pages: float, links: dict[int, float], texts: dict[int, dict[str, float]]) -> dict:
    """What the wrapper of ``pages`` pages tells beyond names: {"roles": {place: role}, "fixed": {place: digests}}. By the
    place's mark, ``links`` are the pages with link targets that come back, summed over targets, ``texts`` the pages of each
    text that enough pages have (``seen``)."""
    slots: dict[tuple[str, ...], list] = {}
    mass: dict[tuple[str, ...], int] = {}
    headed: set[tuple[str, ...]] = set()

    def walk(found: list, place: tuple[str, ...], repeated: bool) -> int:
        total = 0
        for x in found:
            if x[0] == "#":
                s = slots.setdefault(place, [0, 0, 0, False])
                s[0], s[1], s[2], s[3] = s[0] + x[1], s[1] + x[2], s[2] + x[3], s[3] or repeated
                total += x[2] - x[3]
            elif x[0] == "(":
                total += walk(x[4], place, True)
            else:
                here = (*place, x[1])
                if x[1].partition(".")[0] in MAIN_TAGS | {"h1"}:
                    headed.update(here[:k] for k in range(1, len(here) + 1))
                inner = walk(x[4], here, x[3] or repeated)
                mass[here] = mass.get(here, 0) + inner
                total += inner
        return total

    whole = walk(items, (), False)
    plain = set()
    for place in headed:
        e = place[-1]
        tag, *words = e.split(".")
        by_name = tag in WRAPPING_TAGS or tag not in NOISE_TAGS and "hidden" not in words and tag != "header"
        if by_name and noise(e, False) and 2 * mass.get(place, 0) > whole:
            plain.add("/".join(place))
    roles, fixed, runs_, repeats = {}, {}, 0, 0
    for place, (n, chars, linked, repeated) in slots.items():
        key, was = "/".join(place), role(place)
        now = role(place, frozenset(plain)) if plain else was
        tag = place[-1].partition(".")[0] if place else ""
        if now == "body" and repeated and n >= 3 and tag not in ("p", *HEADINGS) and 10 * linked >= 7 * chars and chars < 60 * n:
            # a menu's links lead to the same places from page to page, those of a list that is the page's own don't
            if 2 * links.get(place_mark(place), 0) >= n - 1e-6:
                now = "noise"
        if now != was:
            roles[key] = now
        runs_ += n if now != "noise" else 0
        if now != "body":
            continue  # in the article itself a text that comes back is still its own
        same = texts.get(place_mark(place), {})
        if 2 * sum(same.values()) < n:  # mostly the pages' own text: there only what nearly all of them have isn't
            same = {k: c for k, c in same.items() if c >= max(3, pages * 9 / 10) - 1e-6}
        if same:
            fixed[key] = sorted(same)
            repeats += sum(same.values())
    return {"roles": roles, "fixed": fixed if repeats <= COPIES * runs_ else {}}


_ROLES: dict[tuple[str, ...], str] = {}
_MARKS: dict[tuple[str, ...], int] = {}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def place_mark(place: tuple[str, ...]) -> int:
    import xxhash

    if place not in _MARKS:
        if len(_MARKS) > 50_000:
            _MARKS.clear()
        _MARKS[place] = _signed(xxhash.xxh64_intdigest("/".join(place)))
    return _MARKS[place]


def marks(found: list[tuple]) -> set[tuple[bool, int, int]]:
    """(whether a link's target, place, digest) of the runs of a page, each once."""
    import xxhash

    out = set()
    for place, _, text, _, target in found:
        at = place_mark(place)
        out.add((False, at, _signed(xxhash.xxh64_intdigest(text))))
        if target:
            out.add((True, at, _signed(xxhash.xxh64_intdigest(target))))
    return out


def extract(page: str | None, told: dict) -> str:
    """The page's text, by its host's rules (``rules``; {} without any)."""
    return text_of(runs(page or ""), told)


def text_of(page, told: dict) -> str:
    """As ``extract``, from the page's runs."""
    roles, fixed = told.get("roles") or {}, told.get("fixed") or {}
    found: dict[str, list[str]] = {"article": [], "body": []}
    by_name: list[str] = []
    for place, _, text, _, _ in page:
        if len(_ROLES) > 50_000:
            _ROLES.clear()
        if place not in _ROLES:
            _ROLES[place] = role(place)
        kind = _ROLES[place]
        if kind != "noise":
            by_name.append(text)
        if roles or fixed:
            key = "/".join(place)
            kind = roles.get(key, kind)
            if key in fixed and digest(text) in fixed[key]:
                continue
        if kind in found:
            found[kind].append(text)
    return "\n".join(found["article"] or found["body"] or by_name)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """(host, wrapper, pages) of finished hosts."""
    hosts, items, pages = zip(*rows, strict=True)
    text = [json.dumps(x, separators=(",", ":"), sort_keys=True) for x in items]
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(text, pa.string()), pa.array(pages, pa.float64())], names=["host", "wrapper", "pages"])


def _joined(batches):
    """Rows of (key, host, wrapper, pages), sorted by key: one wrapper a key."""
    done: list[tuple] = []
    at = None
    for b in batches:
        for key, host, text, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            items = json.loads(text)
            if key == at:
                done[-1] = (host, align(done[-1][1], items), done[-1][2] + n)
                continue
            if len(done) >= 256:
                yield _rows(done)
                done = []
            at = key
            done.append((host, items, n))
    if done:
        yield _rows(done)


def page_texts(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(host, text, mark, marks) of each page, where text is a digest of its text by name and ``marks`` are what its places show;
    and (m_host, m_mark, copies) of the pages that are several of one text."""
    ship(pages.sparkSession)

    def texts(batches):
        for b in batches:
            found = [list(runs(p.as_py() or "")) for p in b.column(1)]
            text = [text_of(f, {}) for f in found]
            shown = [marks(f) for f in found]
            link, place, own = zip(*[m for s in shown for m in s], strict=True) if any(shown) else ((), (), ())
            parts = pa.StructArray.from_arrays([pa.array(link, pa.bool_()), pa.array(place, pa.int64()), pa.array(own, pa.int64())], names=["link", "place", "digest"])
            ends = pa.array([0, *itertools.accumulate(map(len, shown))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(t) if t else None for t in text], pa.string()), b.column(2), pa.ListArray.from_arrays(ends, parts)], names=["host", "text", "mark", "marks"])

    mark = F.xxhash64(html_col).alias("mark")
    kind = "host string, text string, mark long, marks array<struct<link: boolean, place: long, digest: long>>"
    shown = materialize(pages.select(host_of(url_col).alias("host"), html_col, mark).mapInArrow(texts, kind), "page-texts")
    own_text = shown.select("host", "text", "mark").where("text is not null")
    copies = own_text.groupBy(F.col("host").alias("c_host"), F.col("text").alias("c_text")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = own_text.join(copies.hint("merge"), (F.col("host") == F.col("c_host")) & (F.col("text") == F.col("c_text"))).select(F.col("host").alias("m_host"), F.col("mark").alias("m_mark"), "copies").distinct()
    return shown, materialize(copies, "copied-pages")


def _with_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (host, mark, ...) with copies, null where a page is alone."""
    small = copies.count() <= BROADCAST_COPIES
    return rows.join(F.broadcast(copies) if small else copies.hint("merge"), (F.col("host") == F.col("m_host")) & (F.col("mark") == F.col("m_mark")), "left")


def seen(shown: DataFrame, copies: DataFrame, found: DataFrame) -> DataFrame:
    """(s_host, seen) for the hosts of ``found`` (host, wrapper, pages): of each place the pages with link targets that come back,
    summed, and each text that at least three of its pages and half of them have. All texts of all pages are counted; what is
    given of a host is bounded by its places and by twice the texts of a page."""
    rows = _with_copies(shown.select("host", "mark", "marks"), copies)
    one = rows.select("host", F.explode("marks").alias("m"), F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))
    count = one.groupBy("host", "m.link", "m.place", "m.digest").agg(F.round(F.sum("weight"), 6).alias("n")).where("n > 1.5")
    links = count.where("link").groupBy("host", "link", "place").agg(F.lit(0).cast("long").alias("digest"), F.sum("n").alias("n"))
    texts = count.where("not link and n >= 3").join(found.select(F.col("host").alias("p_host"), "pages").hint("merge"), F.col("host") == F.col("p_host"))
    texts = texts.where(F.col("n") >= F.col("pages") / 2 - 1e-6).select("host", "link", "place", "digest", "n")
    return links.unionByName(texts).groupBy(F.col("host").alias("s_host")).agg(F.collect_list(F.struct("link", "place", "digest", "n")).alias("seen"))


def wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", copies: DataFrame | None = None) -> DataFrame:
    """(host, wrapper, pages): wrapper as JSON, from every page of the host; pages of one text by name weigh one together."""
    ship(pages.sparkSession)
    if copies is None:
        copies = page_texts(pages, url_col=url_col, html_col=html_col)[1]

    def own(batches):
        found: dict[str, tuple[list, int]] = {}
        for b in batches:
            for host, page, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                weight = 1 / copies if copies else 1
                items = tokens(page.as_py() or "", weight)
                had = found.get(host)
                found[host] = (items, weight) if had is None else (align(had[0], items), had[1] + weight)
            if len(found) > 5000:
                yield _rows([(h, *v) for h, v in found.items()])
                found = {}
        if found:
            yield _rows([(h, *v) for h, v in found.items()])

    kind = "host string, wrapper string, pages double"
    rows = _with_copies(pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("mark")), copies)
    out = rows.select("host", "html", "copies").mapInArrow(own, kind)
    for salted in (True, False):
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("string") if salted else F.lit("")
        keyed = out.select(F.concat_ws(" ", "host", salt).alias("key"), "host", "wrapper", "pages")
        out = keyed.repartition("key").sortWithinPartitions("key", "wrapper").mapInArrow(_joined, kind)
    return out


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``."""
    spark = pages.sparkSession

    def tell(batches):
        for b in batches:
            told = []
            for wrapper, n, own in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                links, texts = {}, {}
                for m in own or ():
                    if m["link"]:
                        links[m["place"]] = m["n"]
                    else:
                        texts.setdefault(m["place"], {})[f"{m['digest'] % (1 << 64):016x}"] = m["n"]
                told.append(rules(json.loads(wrapper), n, links, texts))
            rows = [(h, json.dumps(t)) for h, t in zip(b.column(0).to_pylist(), told, strict=True) if t["roles"] or t["fixed"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["w_host", "told"])

    shown, copies = page_texts(pages, url_col=url_col, html_col=html_col)
    found = materialize(wrappers(pages, url_col=url_col, html_col=html_col, copies=copies), "wrappers")
    found = found.join(seen(shown, copies, found).hint("merge"), F.col("host") == F.col("s_host"), "left").select("host", "wrapper", "pages", "seen")
    found = materialize(found.mapInArrow(tell, "w_host string, told string"), "rules")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    size = found.agg(F.sum(F.length("told") + F.length("w_host"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    known = spark.sparkContext.broadcast({r["w_host"]: json.loads(r["told"]) for r in found.toLocalIterator()} if small else {})
    if not small:
        rows = rows.join(found.hint("merge"), F.col("host") == F.col("w_host"), "left").select("id", "url", "html", "host", "told")

    def scan(batches):
        for b in batches:
            own = b.column(4).to_pylist() if not small else [None] * b.num_rows
            texts = [extract(p.as_py(), known.value.get(h, {}) if w is None else json.loads(w)) for p, h, w in zip(b.column(2), b.column(3).to_pylist(), own, strict=True)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(scan, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
