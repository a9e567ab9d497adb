"""Main text of web pages by union-free regular expressions (wrappers) for each host.

A page is a stream of tags and texts. Repeated groups of tokens are folded into one plus-group, again and again until
none is left; texts that all pages of the host have are apart from others, so that they do not vanish in a group. Streams of one host are aligned one after the other: equal tags stay, differing texts become slots, what
only some pages have becomes optional. The wrapper so inferred tells template text (the same on all its pages) from
content. It is inferred from all distinct pages of a host: in blocks of some BLOCK_PAGES, whose wrappers are
merged by FAN at a time.

Each page is matched against its host's wrapper. What matches a constant, not optional text of the wrapper in its place is
template text, and a repeated group whose texts are all links is a menu. On a page without an article or main element,
the only one or one that holds most of the text there is to read, all template text and menus are left out. Within such an element template text
is left out as far as it is a small part (TEMPLATE_SHARE) of the element's text: pages that are copies of each other are
all constant, but no template.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are also left out by element and by
the words of class, id and role, which are read as whole names: ``no-comments`` or ``with-sidebar`` say what an element is
not. Such words never count on an element around the article or, comments apart, on one with most of the page's text.
A name with a word of that kind among others (``ad-hoc-note``) decides nothing alone: the element is left out if most of its text
is template text or in repeated groups of the wrapper. A form with the article or most of the text in it is no form to leave out.
White space in a block becomes one space; blocks are joined by an empty line.

Alignment runs along items that are unique on both sides, so its time grows with the length of the streams and not with
its square.

Defined results: a null or empty page has the empty text; a null url or one without a host has no wrapper; an
element that is never closed ends with the page, a left-out one at the next article or main; rows with equal pages on a host
get equal texts; other columns, whatever their names, pass through.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudspark.llm.common import lookup, materialize

#: Distinct pages of a host, or wrappers of its blocks, that are aligned in one task; the least pages that make a template.
BLOCK_PAGES, FAN, LEAST_PAGES = 256, 64, 3
#: Longest group of tokens that folding looks for.
GROUP = 12
#: Largest part of a main element's text that can be a template's.
TEMPLATE_SHARE = 0.2
#: Largest part of a page's text that can be a template's, where names are in doubt.
COPY_SHARE = 0.8
#: Product of the lengths of two stretches without unique items up to which they are compared as a whole.
SMALL = 40_000

_parts = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|select|title)\b(?>[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<attrs>(?>[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_named = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav footer aside form header menu head button dialog object audio video canvas".split())
#: Words of class, id or role that mark what is no content.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "pager popup promo promotion related respond share sharing sidebar signup social sponsor sponsored subscribe teaser teasers toolbar widget".split()
)
#: Words that make a name say what an element has, has not or is like, not what it is.
STATES = frozenset("no non not without with has have hide hidden disable disabled enable enabled closed open allow is show".split())
COMMENTS = frozenset("comment comments disqus respond".split())
#: Words that leave the meaning of a mark beside them as it is.
PLAIN = frozenset(
    "area article articles bar block body bottom box btn button buttons card col column container content entry form frame global group "
    "header holder icon icons image images img inline inner item items label large left line link links list main media mini module network "
    "outer page panel parent post posts primary rail right row secondary section site slot small space stories story sub sticky tag tags "
    "text thread title top unit wrap wrapper zone".split()
)


def parts(html: str | None) -> list[tuple[str, str, str]]:
    """Tokens: kind (open, close, text), tag or text, names in class, id and role."""
    out, at = [], 0
    html = html or ""
    for m in _parts.finditer(html):
        if m.start() > at:
            out.append(("text", html[at : m.start()], ""))
        at = m.end()
        if name := m["name"]:
            name = name.lower()
            if m["close"]:
                out.append(("close", name, ""))
            else:
                attrs = m["attrs"]
                marks = " ".join(x.strip("\"'") for x in _named.findall(attrs)) if "=" in attrs else ""
                out.append(("open", name, marks))
    if at < len(html):
        out.append(("text", html[at:], ""))
    return out


def _placed(tokens: list[tuple[str, str, str]]) -> tuple[list[str], list[int]]:
    """The stream, and for each of its items the number of its token."""
    out, at = [], []
    for i, (kind, value, marks) in enumerate(tokens):
        if kind == "open":
            out.append(f"{value}.{marks}" if marks else value)
        elif kind == "close":
            out.append("/" + value)
        elif text := " ".join(unescape(value).split()):
            out.append("#" + xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass")))
        else:
            continue
        at.append(i)
    return out, at


def stream(tokens: list[tuple[str, str, str]]) -> list[str]:
    """One string for each token; a text is ``#`` and its hash."""
    return _placed(tokens)[0]


def _keys(items: list[str], constants: frozenset[str] = frozenset()) -> list[str]:
    """What items are compared by: texts are all alike but for the constant ones."""
    return ["#" if x[:1] == "#" and x not in constants else x for x in items]


def fold(items: list[str], constants: frozenset[str] = frozenset()) -> list[str]:
    """Groups that repeat side by side become ``+(...)``, from the inside out; a constant text repeats only itself."""
    return _folded(items, [0] * len(items), constants)[0]


def _folded(items: list[str], at: list[int], constants: frozenset[str] = frozenset()) -> tuple[list[str], list[int]]:
    """The folded items, and of each the place (``at``) of its first one."""
    for _ in range(4):
        keys = _keys(items, constants)
        out: list[str] = []
        places: list[int] = []
        i = 0
        while i < len(items):
            for size in range(1, min(GROUP, (len(items) - i) // 2) + 1):
                if keys[i] == keys[i + size] and keys[i : i + size] == keys[i + size : i + 2 * size] and (size > 1 or keys[i][:1] == "+"):
                    end = i + 2 * size
                    while keys[end : end + size] == keys[i : i + size]:
                        end += size
                    out.append(keys[i] if size == 1 else f"+({' '.join(keys[i : i + size])})")
                    places.append(at[i])
                    i = end
                    break
            else:
                out.append(items[i])
                places.append(at[i])
                i += 1
        if len(out) == len(items):
            return out, places
        items, at = out, places
    return items, at


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of the first, that also rises in the second."""
    tops: list[int] = []  # second of the last pair of the best part of each length
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect.bisect_left(tops, y)
        before[i] = last[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            last.append(i)
        else:
            tops[at], last[at] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of items of a and b that are matched, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= SMALL:
            for x in difflib.SequenceMatcher(None, a[i:j], b[k:m], autojunk=False).get_matching_blocks():
                out += [(i + x.a + n, k + x.b + n) for n in range(x.size)]
            continue
        ours, theirs = Counter(a[i:j]), Counter(b[k:m])
        place = {x: at for at, x in enumerate(b[k:m], k) if theirs[x] == 1}
        anchors = _rising([(at, place[x]) for at, x in enumerate(a[i:j], i) if ours[x] == 1 and x in place])
        if not anchors:  # the first of an item with the first, the second with the second
            count: Counter = Counter()
            nth = {(x, count.update((x,)) or count[x]): at for at, x in enumerate(b[k:m], k)}
            count.clear()
            both = [(at, nth.get((x, count.update((x,)) or count[x]))) for at, x in enumerate(a[i:j], i)]
            out += _rising([(x, y) for x, y in both if y is not None])
            continue
        out += anchors
        for (p, q), (r, t) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            todo.append((p + 1, r, q + 1, t))
    return sorted(out)


def _opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Stretches (kind, from and to in a, from and to in b): equal ones and what stands between them."""
    out: list[tuple[str, int, int, int, int]] = []
    i = k = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if x > i or y > k:
            out.append(("other", i, x, k, y))
        if x < len(a) or y < len(b):
            if out and out[-1][0] == "equal":
                out[-1] = ("equal", out[-1][1], x + 1, out[-1][3], y + 1)
            else:
                out.append(("equal", x, x + 1, y, y + 1))
        i, k = x + 1, y + 1
    return out


def merge(one: list[tuple[str, bool]], other: list[tuple[str, bool]], constants: frozenset[str] = frozenset()) -> list[tuple[str, bool]]:
    """The wrapper (item, optional) that fits what either of two fits. A slot is ``#`` alone."""
    a, b = _keys([x for x, _ in one], constants), _keys([x for x, _ in other], constants)
    out: list[tuple[str, bool]] = []
    for op, i, j, k, m in _opcodes(a, b):
        if op == "equal":
            out += [(x if x == y else "#", p or q) for (x, p), (y, q) in zip(one[i:j], other[k:m], strict=True)]
        else:
            out += [(x, True) for x, _ in one[i:j]]
            # what the other repeats of what stands before it is one more turn of a group, not a part of its own
            if not (m - k <= len(out) and _keys([x for x, _ in out[len(out) - (m - k) :]], constants) == b[k:m]):
                out += [(x, True) for x, _ in other[k:m]]
    return out


def infer(found: list[list[tuple[str, bool]]], constants: frozenset[str] = frozenset()) -> list[tuple[str, bool]]:
    """The wrapper of some wrappers; a folded stream is one without optional items."""
    return functools.reduce(lambda one, other: merge(one, other, constants), found)


def template(wrapper: list[tuple[str, bool]], tokens: list[tuple[str, str, str]]) -> tuple[set[int], set[int]]:
    """Numbers of the page's tokens that are texts in the place of the same, not optional text of the wrapper; numbers of
    those that stand in its repeated groups."""
    placed, at = _placed(tokens)
    ends = {n: i for i, n in enumerate(at)}
    constants = frozenset(x for x, optional in wrapper if x[:1] == "#" and len(x) > 1 and not optional)
    items, firsts = _folded(placed, at, constants)
    stops = [*firsts[1:], len(tokens)]
    fixed, repeated = set(), set()
    for op, i, j, k, m in _opcodes(_keys([x for x, _ in wrapper], constants), _keys(items, constants)):
        if op != "equal":
            continue
        for n in range(m - k):
            (kind, optional), own = wrapper[i + n], items[k + n]
            if own[:1] == "+":
                repeated.update(x for x in at[ends[firsts[k + n]] : ends.get(stops[k + n], len(at))] if tokens[x][0] == "text")
            elif not optional and own[:1] == "#" and len(own) > 1 and kind == own:
                fixed.add(firsts[k + n])
    return fixed, repeated


def _shown(wrapper: list[tuple[str, bool]]) -> list[str]:
    return [x + "?" if optional else x for x, optional in wrapper]


def _read(shown: list[str]) -> list[tuple[str, bool]]:
    return [(x[:-1], True) if x[-1:] == "?" else (x, False) for x in shown]


@functools.lru_cache(maxsize=4096)
def words_of(names: str) -> frozenset[str]:
    """Words by which class, id and role say what an element is."""
    out: set[str] = set()
    for name in names.split():
        own = [w.lower() for w in _words(name)]
        if STATES.isdisjoint(own):
            out.update(own)
    return frozenset(out)


@functools.lru_cache(maxsize=4096)
def sure_words(names: str) -> frozenset[str]:
    """Marks in names that hold nothing but marks and plain words: ``ad-box`` is an advert, ``ad-hoc-note`` may be none."""
    out: set[str] = set()
    for name in names.split():
        own = [w.lower() for w in _words(name)]
        if STATES.isdisjoint(own) and all(w in MARKS or w in PLAIN for w in own):
            out.update(own)
    return frozenset(out)


def _is_main(name: str, names: str) -> bool:
    own = words_of(names) if names else frozenset()
    return (name in ("article", "main") or name not in ("html", "body") and "articlebody" in names.lower().replace("-", "").replace("_", "")) and MARKS.isdisjoint(own)


def _spans(tokens: list[tuple[str, str, str]], weight: list[int]) -> tuple[dict[int, int], set[int]]:
    """Weight of the text in each element, by the number of its tag; the elements around a main one."""
    inside: dict[int, int] = {}
    around: set[int] = set()
    stack: list[tuple[str, int, int]] = []
    total = 0
    for i, (kind, name, names) in enumerate(tokens):
        if kind == "text":
            total += weight[i]
        elif kind == "open":
            if _is_main(name, names):
                around.update(n for _, n, _ in stack)
            if name not in VOID:
                stack.append((name, i, total))
        elif any(name == x for x, _, _ in stack[-50:]):
            while stack:
                x, n, before = stack.pop()
                inside[n] = total - before
                if x == name:
                    break
    inside.update((n, total - before) for _, n, before in stack)
    return inside, around


def extract(html: str | None, wrapper: list[tuple[str, bool]] = ()) -> str:
    """Main text; wrapper: the host's."""
    tokens = parts(html)
    weight = [len(" ".join(value.split())) if kind == "text" else 0 for kind, value, _ in tokens]
    inside, around = _spans(tokens, weight)
    half = sum(weight) / 2
    fixed, repeated = template(wrapper, tokens) if wrapper else (set(), set())
    of_host = [w if i in fixed or i in repeated else 0 for i, w in enumerate(weight)]
    # pages that are copies of each other say nothing about what is a template
    of_host = _spans(tokens, of_host)[0] if sum(of_host) <= COPY_SHARE * sum(weight) else {}

    def is_left_out(i: int, name: str, names: str, in_main: bool) -> bool:
        if name in LEFT_OUT:
            return not (name == "header" and in_main or name == "form" and not in_main and (i in around or inside.get(i, 0) > half))
        if not names or name in ("html", "body", "main"):
            return False
        own = words_of(names)
        if i in around and COMMENTS.isdisjoint(own):
            return False
        if in_main:
            own = own - {"header", "masthead"}
        # a doubtful name counts where the wrapper has most of the element's text as template text or in its repeated groups
        if MARKS.isdisjoint(own & sure_words(names)) and 2 * of_host.get(i, 0) <= inside.get(i, 0):
            return False
        return not MARKS.isdisjoint(own) and (inside.get(i, 0) <= half or not COMMENTS.isdisjoint(own))

    keep: list[tuple[int, bool, bool]] = []  # texts and ends of blocks: token, whether in a main element, in a link
    main: list[str] = []  # open elements from the main one on
    mains: list[str] = []  # main elements that are in no other
    out_of, depth, in_comments, links = "", 0, False, 0  # the element left out, open elements of its name, whether it holds comments
    for i, (kind, name, names) in enumerate(tokens):
        if kind == "text":
            if not out_of:
                keep.append((i, bool(main), links > 0))
            continue
        if name == "br" or name in BLOCKS:
            keep.append((i, bool(main), False))
        if name == "br":
            continue
        if out_of:
            if name == out_of:
                depth += 1 if kind == "open" else -1
                out_of = out_of if depth > 0 else ""
                continue
            if not (kind == "open" and _is_main(name, names) and not in_comments and not main):
                continue
            out_of = ""
        if name == "a":
            links = 1 if kind == "open" else 0
        if kind == "open":
            if name in VOID:
                continue
            if is_left_out(i, name, names, bool(main)):
                out_of, depth, in_comments = name, 1, not COMMENTS.isdisjoint(words_of(names))
            elif main or _is_main(name, names):
                if not main:
                    mains.append(name)
                main.append(name)
        elif name in main:  # closes what was left open inside
            while main.pop() != name:
                pass
    texts = [(i, m, a) for i, m, a in keep if tokens[i][0] == "text"]
    own = sum(weight[i] for i, m, _ in texts if m)
    beside = sum(weight[i] for i, m, a in texts if not m and not a and i not in fixed)
    has_main = own > 0 and (own >= beside or mains in (["article"], ["main"]))
    if has_main and sum(weight[i] for i, m, _ in texts if m and i in fixed) > TEMPLATE_SHARE * own:
        fixed = set()
    menus = set() if has_main else {i for i, _, a in texts if a and i in repeated}
    blocks: list[str] = []
    line: list[str] = []
    for i, m, _ in [*keep, (-1, False, False)]:
        if i >= 0 and tokens[i][0] == "text":
            if (m or not has_main) and i not in fixed and i not in menus:
                line.append(tokens[i][1])
        elif i >= 0 and tokens[i][1] == "br":
            line.append(" ")
        else:
            if text := " ".join(unescape("".join(line)).split()):
                blocks.append(text)
            line.clear()
    return "\n\n".join(blocks)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", block_pages: int = BLOCK_PAGES) -> DataFrame:
    """host, weight (rows of the host), pages (distinct ones with tokens), wrapper (items; optional ones end in ``?``)."""

    def streams(batches):
        for batch in batches:
            rows = [stream(parts(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.string()))], names=["host", "h", "shown"])

    def merged(first: bool):
        def run(table: pa.Table) -> pa.Table:
            constants = frozenset(table.column("constants")[0].as_py())
            rows = sorted(zip(table.column("h").to_pylist(), table.column("shown").to_pylist(), strict=True))
            found = [[(x, False) for x in fold(items, constants)] if first else _read(items) for _, items in rows]
            shown = pa.array([_shown(infer(found, constants))], pa.list_(pa.string()))
            one = table.select(["host", "block", "weight", "constants"]).slice(0, 1).columns
            return pa.table([one[0], one[1], *one[2:], pa.array([sum(table.column("pages").to_pylist())]), shown], ["host", "h", "weight", "constants", "pages", "shown"])

        return run

    hosts = pages.select(host_of(url_col).alias("host"), pages[html_col].alias("html")).filter("host <> ''").select("host", "html", F.xxhash64("html").alias("h"))
    rows = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("weight"))
    distinct = hosts.mapInArrow(streams, "host string, h long, shown array<string>").filter("size(shown) > 0").dropDuplicates(["host", "h"])
    distinct = materialize(distinct, "streams")
    # texts that all distinct pages of a host have; no more than one page has texts
    texts = distinct.select("host", F.explode(F.array_distinct(F.filter("shown", lambda x: F.startswith(x, F.lit("#"))))).alias("text")).groupBy("host", "text").count()
    known = rows.join(distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host")
    constant = texts.join(known, "host").filter("count = n").groupBy("host").agg(F.collect_list("text").alias("constants"))
    known = known.join(constant, "host", "left").select("host", "weight", F.coalesce("constants", F.array().cast("array<string>")).alias("constants"))
    known = materialize(known, "hosts")
    block = F.expr(f"pmod(h, CAST(ceil(weight / {block_pages}) AS BIGINT))").alias("block")
    kind = "host string, h long, weight long, constants array<string>, pages long, shown array<string>"
    parted = lookup(distinct, known, "host", "weight").select("host", "h", block, "weight", "constants", F.lit(1).cast("long").alias("pages"), "shown")
    found = parted.groupBy("host", "block").applyInArrow(merged(True), kind)
    left = -(-(known.agg(F.max("weight")).first()[0] or 0) // block_pages)  # blocks of the largest host
    while left > 1:  # a block's number stands in h
        found = found.withColumn("block", F.floor(F.col("h") / FAN)).groupBy("host", "block").applyInArrow(merged(False), kind)
        left = -(-left // FAN)
    return materialize(found.select("host", "pages", F.col("shown").alias("wrapper"), "weight"), "wrappers")


def extract_all(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep_html: bool = True) -> DataFrame:
    """(page, text, chars): the row as a struct, its main text and the number of its code points."""
    found = wrappers(pages, url_col, html_col)
    found = materialize(found.filter(f"pages >= {LEAST_PAGES}").select("host", "wrapper", "weight"), "known")
    names = [x for x in pages.columns if keep_html or x != html_col]
    rows = pages.select(F.struct(*[pages[c] for c in names]).alias("page"), pages[html_col].alias("html"), host_of(url_col).alias("host"))
    page = T.StructType([pages.schema[c] for c in names])
    schema = T.StructType([T.StructField("page", page), T.StructField("text", T.StringType()), T.StructField("chars", T.LongType())])

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py(), _read(y.as_py() or ())) for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page", "text", "chars"])

    return lookup(rows, found, "host", "weight").select("page", "html", "wrapper").mapInArrow(run, schema)


def digest(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = extract_all(pages.select("page_id", "url", "html"), keep_html=False)
    return rows.select("page.page_id", "page.url", "text", F.col("chars").alias("n_chars"))
