"""HTML extraction (10): wrappers by union-free regular-expression inference.

Pages become balanced token streams. Within a page, repeated neighbours are
folded into repeated groups; the pages of one host are then aligned with the
host's wrapper one after the other. Where the streams differ, what only one of
them has becomes optional, what repeats becomes a repeated group, and texts that
differ become text slots. A wrapper so is a union-free expression over tags,
fixed texts and slots, and every page of the host has part in it. Pages of one
form merge in any order, the forms of a host in the order of their digests, so
the wrapper does not depend on how pages are dealt, and no task holds a host.

From the wrapper follow the host's rules: where the main text lies, and which
texts are the template's: those that ``LEAST_PAGES`` pages and more than half of
the host's have at one place. The main text lies at the wrapper's article elements
(else its main elements, else its deepest container outside which no page of the
host has text but the template's and links; on hosts of few pages the whole page)
without the template's texts and the parts that tags, roles, classes or ids name as
menus, headers, footers, sidebars, notices, adverts, forms or reader comments,
which often are slots as well. An id names one only as a whole: all of its words
must be such words, or outside an article words of place; a heading's id names
nothing, and its classes count as a whole too. A heading in an article's own
header stays.

Defined cases: null or empty html gives empty text. A null url is a host of its
own name, the empty one. Unclosed and stray tags are borne; a tag that the page
breaks off ends it. A page is parsed in time that goes with its length. Nesting has no limit
where texts are taken out; in wrappers the texts beyond ``DEEPEST`` levels stand at
that level. Pages are read whole. Repeated rows
give repeated results. Other columns are not read. An empty table gives no rows.
"""

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import col, materialize

DEEPEST = 200
#: Most bytes of rules that are broadcast; more are joined by host.
RULES_BYTES = 16 << 20
#: Pages that a fixed text must be common to before it counts as the template's.
LEAST_PAGES = 3

# Fixed values of the HTML standard: element classes.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# What tags, roles and words of classes and ids stand for other than main text.
_OTHER_TAGS = frozenset("nav header footer aside form head button select dialog menu object canvas audio video".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toolbar header masthead footer sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending comment comments commentlist disqus replies respond "
    "search form pagination pager copyright legal disclaimer skip".split()
)

# Words that only place a region which other words of its id name.
_PLACE_WORDS = frozenset("site page main primary secondary global top bottom left right container wrapper wrap area block box bar list".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_PLAIN, _BLANK = re.compile(r"[^>=]*"), re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its tag, its key in a wrapper, whether it is other than main text."""

    __slots__ = ("name", "key", "other", "kids", "within")

    def __init__(self, name: str, key: str, other: bool):
        self.name, self.key, self.other, self.kids = name, key, other, []
        self.within = False  # whether it is an article or in one


def _names_other(token: str, place: frozenset = frozenset()) -> bool:
    """Whether all words of a class or id say that a region is other than main text."""
    words = {w.lower() for w in _WORD.findall(token)}
    return not _OTHER_WORDS.isdisjoint(words) and words <= _OTHER_WORDS | place


def _element(name: str, attributes: str, within: bool = False) -> Node:
    if not attributes.strip():
        return Node(name, name, name in _OTHER_TAGS)
    found = {a.lower(): html.unescape(b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    if name in _HEADINGS:
        named = any(map(_names_other, found.get("class", "").split()))
    else:
        named = not _OTHER_WORDS.isdisjoint([w.lower() for w in _WORD.findall(found.get("class", ""))])
        named = named or _names_other(found.get("id", ""), frozenset() if within else _PLACE_WORDS)
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(_HIDDEN.search(found.get("style", "")))
    other = name in _OTHER_TAGS or role in _OTHER_ROLES or hidden or name not in ("html", "body") and named
    kind = "main" if role == "main" else name
    return Node(kind, ".".join([kind, *sorted({w.lower() for w in _WORD.findall(found.get("class", ""))})]), other)


class _Tags:
    """The tags of a page in order, each found in time that goes with its length."""

    def __init__(self, page: str):
        self.page, self.unquoted = page, {"'": len(page) + 1, '"': len(page) + 1}

    def _end(self, at: int) -> int:
        """Where the tag ends whose attributes start at ``at``; -1 if it never does. A value is quoted only after its sign."""
        page, n = self.page, len(self.page)
        end = page.find(">", at)
        if end < 0 or page.find("=", at, end) < 0:
            return end
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= n:
                return -1
            if page[at] == ">":
                return at
            at = _BLANK.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in self.unquoted and at < self.unquoted[quote]:
                closing = page.find(quote, at + 1) if quote else -1
                if closing < 0:  # no such mark ends from here on
                    self.unquoted[quote] = at
                else:
                    at = closing + 1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes); comments and declarations have no name."""
        page, at = self.page, 0
        while found := _OPENING.search(page, at):
            if found[1] or found[2]:
                mark = "-->" if found[1] else ">"
                end = page.find(mark, found.end())
                at = len(page) if end < 0 else end + len(mark)
                yield found.start(), at, "", False, ""
                continue
            end = self._end(found.end())
            at = len(page) if end < 0 else end + 1
            name = found[4].lower() if end >= 0 else ""  # a tag that the page breaks off is none
            yield found.start(), at, name, bool(found[3]), page[found.end() : end] if end >= 0 else ""
            if name in _RAW and not found[3] and not (name in ("svg", "math") and page[end - 1] == "/"):
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                over = page.find(">", closing.end()) if closing else -1
                at = len(page) if over < 0 else over + 1
                yield found.end(), at, "", False, ""


def tree(page: str) -> Node:
    """The balanced token stream of a page; texts are decoded strings among the nodes."""
    root = Node("", "", False)
    stack: list[tuple[str, Node]] = [("", root)]
    opened: defaultdict[str, int] = defaultdict(int)
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1][1].kids.append(html.unescape(piece))

    def cut(i: int) -> None:
        while len(stack) > i:
            opened[stack.pop()[0]] -= 1

    def close(names: set[str], walls: set[str] = frozenset()) -> None:
        for name in names:
            if opened[name]:
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                cut(i)
                return
            if stack[i][0] in walls:
                return

    for start, end, name, closing, attributes in _Tags(page):
        text(page[at:start] if start > at else "")
        at = end
        if not name or name in _RAW:
            continue
        if closing:
            close({name})
            continue
        if name in _VOID:
            stack[-1][1].kids.append(Node(name, name, False) if name == "hr" else " " if name == "br" else "")
            continue
        if name in _BLOCK:
            close({"p"}, _BLOCK - {"p"})
        if name in _ENDS:
            close(*_ENDS[name])
        within = stack[-1][1].within
        node = _element(name, attributes, within)
        node.within = within or node.name == "article"
        stack[-1][1].kids.append(node)
        stack.append((name, node))
        opened[name] += 1
    text(page[at:])
    return root


# A wrapper is [key, quantifier, other, text, kids]; the quantifier is "1", "?",
# "+" or "*". For a text the key is "#" and text is [hash, characters, link, pages]:
# the hash is null once texts differ, and pages is how many have a text there. A
# group of siblings has the key "(".

def _texts(node: Node, link: bool) -> Iterator[tuple[str, bool]]:
    """All texts under a node that are not part of something else, and whether they are links."""
    todo = [(kid, link) for kid in reversed(node.kids)]
    while todo:
        kid, link = todo.pop()
        if isinstance(kid, str):
            yield kid, link
        elif not kid.other:
            todo.extend((k, link or kid.name == "a") for k in reversed(kid.kids))


def _shape(node: Node, link: bool = False, level: int = 0) -> list:
    kids = []
    for kid, linked in ((k, link) for k in node.kids) if level < DEEPEST else _texts(node, link):
        if isinstance(kid, str):
            words = " ".join(kid.split())
            if words:
                kids.append(["#", "1", False, [xxhash.xxh3_64_hexdigest(words), len(words), linked, 1], []])
        else:
            kids.append(_shape(kid, link or kid.name == "a", level + 1))
    return [node.key, "1", node.other, None, _folded(kids)]


def _either(a: str, b: str) -> str:
    many, none = a in "+*" or b in "+*", a in "?*" or b in "?*"
    return ("*" if none else "+") if many else "?" if none else "1"


def _repeated(q: str) -> str:
    return "*" if q in "?*" else "+"


def _optional(q: str) -> str:
    return "*" if q in "+*" else "?"


def _folded(kids: list) -> list:
    """Repeated neighbours as one repeated member, repeated runs as a repeated group."""
    out: list = []
    for kid in kids:
        if out and kid[0] == out[-1][0]:
            out[-1] = merge(out[-1], kid, True)
            out[-1][1] = _repeated(out[-1][1])
        else:
            out.append(kid)
    for size in (2, 3, 4):
        keys, i, folded = [k[0] for k in out], 0, []
        while i < len(out):
            n = 1
            while keys[i : i + size] == keys[i + n * size : i + (n + 1) * size] and len(keys[i : i + size]) == size:
                n += 1
            if n == 1:
                folded.append(out[i])
                i += 1
                continue
            body = out[i : i + size]
            for j in range(1, n):
                body = [merge(a, b, True) for a, b in zip(body, out[i + j * size : i + (j + 1) * size])]
            folded.append(["(" + " ".join(k[0] for k in body), "+", False, None, body])
            i += n * size
        out = folded
    return out


def merge(a: list, b: list, within: bool = False) -> list:
    """The least wrapper of both; their keys are equal. ``within``: both are of the same page."""
    text = None
    if a[3] is not None:
        text = [a[3][0] if a[3][0] == b[3][0] else None, a[3][1] + b[3][1], a[3][2] and b[3][2], 1 if within else a[3][3] + b[3][3]]
    return [a[0], _either(a[1], b[1]), a[2] and b[2], text, _aligned(a[4], b[4], within)]


def _grouped(kids: list, other: list) -> list:
    """``kids`` with runs that are a group of ``other`` put together as one, met once."""
    for group in other:
        keys = [k[0] for k in group[4]]
        if group[0][:1] == "(" and group[0] not in [k[0] for k in kids]:
            for i in range(len(kids) - len(keys) + 1):
                if [k[0] for k in kids[i : i + len(keys)]] == keys:
                    kids = [*kids[:i], [group[0], "1", False, None, kids[i : i + len(keys)]], *kids[i + len(keys) :]]
                    break
    return kids


def _aligned(a: list, b: list, within: bool = False) -> list:
    a, b = _grouped(a, b), _grouped(b, a)
    x, y = [k[0] for k in a], [k[0] for k in b]
    if x == y:
        return [merge(p, q, within) for p, q in zip(a, b)]
    out = []
    for kind, i, j, k, l in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merge(p, q, within) for p, q in zip(a[i:j], b[k:l])]
        else:  # what one stream lacks is optional
            out += [[n[0], _optional(n[1]), *n[2:]] for n in a[i:j] + b[k:l]]
    return out


def expression(wrapper: list) -> str:
    """The wrapper as a union-free regular expression, for reading."""
    key, q, _, text, kids = wrapper
    inner = " ".join(map(expression, kids))
    if text is not None:
        body = "#TEXT" if text[0] is None else "#fixed"
    elif key[:1] == "(":
        body = f"({inner})"
    else:
        body = f"<{key}> {inner} </{key}>" if inner else f"<{key}/>"
    return body if q == "1" else f"({body}){'?' if q == '?' else q}"


def _template(text: list, pages: int) -> bool:
    """Whether the text at a place is the template's: one text, of enough pages."""
    return text[0] is not None and text[3] >= LEAST_PAGES and 2 * text[3] > pages


def rules(wrapper: list, pages: int) -> dict:
    """Where the main text lies on pages of this wrapper, and the template's fixed texts in and outside of it.

    ``regions`` are paths of keys from the top: those of the article elements,
    else of the main elements. One whose texts are links for the greater part is
    a teaser where another one is not. Without either, it is the path to the
    deepest container outside which no page has text but the template's and links.
    """
    found: dict[str, list[tuple[list[str], int, int]]] = {"article": [], "main": []}
    fixed: dict[bool, set[str]] = {True: set(), False: set()}

    def weights(node: list) -> tuple[int, int]:
        """Characters of the page's own text that are not links, and of links."""
        if node[2]:
            return 0, 0
        if node[3] is not None:
            return (0, node[3][1]) if node[3][2] else (0 if _template(node[3], pages) else node[3][1], 0)
        both = [weights(k) for k in node[4]]
        return sum(x for x, _ in both), sum(y for _, y in both)

    def walk(node: list, path: list[str], inside: str) -> None:
        if node[2]:
            return
        if node[3] is not None:
            if _template(node[3], pages):
                fixed[inside == "article"].add(node[3][0])
            return
        name = node[0].partition(".")[0]
        here = path if node[0][:1] in ("(", "") else [*path, node[0]]
        if name in found and inside != "article" and name != inside:
            found[name].append((here, *weights(node)))
            inside = name
        for kid in node[4]:
            walk(kid, here, inside)

    walk(wrapper, [], "")
    regions = next((r for r in found.values() if r), [])
    own = [path for path, text, links in regions if text >= links]
    paths = own or [path for path, _, _ in regions]
    if not paths and pages >= LEAST_PAGES:
        path, node = [], wrapper
        while True:
            total = weights(node)[0]
            best = max(node[4], key=lambda k: weights(k)[0], default=None)
            if best is None or best[0] == "#" or weights(best)[0] < total or not total or best[1] in "+*":
                break
            if best[0][:1] != "(":
                path.append(best[0])
            node = best
        while path and path[-1].partition(".")[0] in ("p", "ul", "ol", "li", "table", "tr", "td", "span", "b", "i", "em", "strong", "a"):
            path.pop()
        paths = [path] if path else []
    return {"regions": paths, "inside": sorted(fixed[True]), "outside": sorted(fixed[False])}


def extract(page: str | None, rule: dict | None = None) -> str:
    """The main text of a page: its blocks, one a line.

    The host's rule says where it lies. A page that has no such place, or has no
    rule, is read by its own article or main element, else whole. Template texts
    are left out; inside an article only while they are its lesser part, as a page
    that has most of its text from others is a copy of them.
    """
    if not page:
        return ""
    root = tree(page)
    region = _at(root, (rule or {}).get("regions", [])) or _regions(root, "article") or _regions(root, "main") or [root]
    whole = region[0].name == "article"
    fixed = set((rule or {}).get("inside" if whole else "outside", ()))
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        words = " ".join("".join(piece).split())
        piece.clear()
        if words:
            blocks.append(words)

    for top in region:
        todo: list[tuple[object, bool]] = [(top, False)]
        while todo:
            node, heading_only = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                if not heading_only:
                    piece.append(node)
            elif node.other and node is not top and not (whole and node.name == "header" and node.key == "header"):
                if node.name in _BLOCK:
                    flush()
            else:
                only = heading_only or node.name == "header" and node is not top
                if only and node.name in _HEADINGS:
                    only = False
                if node.name in _BLOCK or node.name == "main":
                    flush()
                    todo.append((None, False))
                todo.extend((kid, only) for kid in reversed(node.kids))
        flush()
    if fixed:
        own = [b for b in blocks if xxhash.xxh3_64_hexdigest(b) not in fixed]
        if not whole or 2 * sum(map(len, own)) > sum(map(len, blocks)):
            blocks = own
    return "\n".join(blocks)


def _regions(root: Node, name: str) -> list[Node]:
    """The outermost such elements that are not part of something else."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.other:
            continue
        if node.name == name:
            out.append(node)
            continue
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str))
    return out


def _at(root: Node, paths: list[list[str]]) -> list[Node]:
    """The outermost elements at the paths, in page order, that are not part of something else."""
    ways: dict = {}
    for path in paths:
        at = ways
        for key in path:
            at = at.setdefault(key, {})
        at[None] = True
    out, todo = [], [(root, ways)]
    while todo:
        node, way = todo.pop()
        if None in way and node is not root:
            out.append(node)
            continue
        todo.extend((k, way[k.key]) for k in reversed(node.kids) if not isinstance(k, str) and not k.other and k.key in way)
    return out


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


_WRAPPERS = "host string, form string, pages long, wrapper string"
#: Forms of one host that a task merges.
FORMS = 500


def _form(wrapper: list) -> str:
    """What tells a wrapper's form: its keys and quantifiers, without texts. Wrappers of one form merge in any order alike."""
    digest = hashlib.blake2b(digest_size=16)

    def walk(node: list) -> None:
        digest.update(f"{node[0]}\0{node[1]}{int(node[2])}\0".encode())
        for kid in node[4]:
            walk(kid)
        digest.update(b"\1")

    walk(wrapper)
    return digest.hexdigest()


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, form, pages, wrapper): each host's wrapper as JSON, over all of its pages.

    Pages of one form are merged wherever they meet; then the forms of a host in
    the order of their digests, ``FORMS`` or so at a time, until one is left. The
    result so does not depend on how the pages are dealt.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[int, list]] = {}
        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shape = _shape(tree(page))
                key = name, _form(shape)
                n, wrapper = held.get(key, (0, None))
                held[key] = (n + 1, shape if wrapper is None else merge(wrapper, shape))
            if len(held) > 5_000:
                yield _packed(held)
                held = {}
        yield _packed(held)

    def alike(key, table):
        return pa.table(_packed({(key[0].as_py(), key[1].as_py()): _merged(table)}))

    def join(key, table):
        n, wrapper = _merged(table.sort_by("form"))
        return pa.table(_packed({(key[0].as_py(), _form(wrapper)): (n, wrapper)}))

    rows = pages.select(host(col(url_col).cast("string")).alias("host"), col(html_col).cast("string").alias("html")).where("html IS NOT NULL AND html <> ''")
    forms = rows.mapInArrow(gather, _WRAPPERS)
    # Wrappers of one form are alike in any order, so hot ones go in two steps.
    salted = forms.groupBy("host", "form", F.pmod(F.xxhash64("wrapper", "pages"), F.lit(32)).alias("salt")).applyInArrow(alike, _WRAPPERS)
    left = materialize(salted.groupBy("host", "form").applyInArrow(alike, _WRAPPERS), "forms")
    while (left.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        slots = left.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / FORMS).alias("slots")).withColumnRenamed("host", "of")
        dealt = left.join(slots, left["host"] == slots["of"]).drop("of").withColumn("slot", F.pmod(F.xxhash64("form"), F.col("slots")))
        left = materialize(dealt.drop("slots").groupBy("host", "slot").applyInArrow(join, _WRAPPERS), "forms", instead=left)
    return left


def _merged(table: pa.Table) -> tuple[int, list]:
    n, wrapper = 0, None
    for k, w in zip(table["pages"].to_pylist(), table["wrapper"]):
        n, wrapper = n + k, json.loads(w.as_py()) if wrapper is None else merge(wrapper, json.loads(w.as_py()))
    return n, wrapper


def _packed(held: dict[tuple[str, str], tuple[int, list]]):
    columns = [[h for h, _ in held], [f for _, f in held], [n for n, _ in held.values()], [json.dumps(w, separators=(",", ":")) for _, w in held.values()]]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "form", "pages", "wrapper"])


def _ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [json.dumps(rules(json.loads(w), n)) for n, w in zip(batch.column("pages").to_pylist(), batch.column("wrapper").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "rule"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: (page_id, url, text)."""
    ruled = materialize(infer(pages, url_col, html_col).mapInArrow(_ruled, "host string, rule string"), "rules")
    size = ruled.agg(F.sum(F.octet_length("rule") + F.octet_length("host"))).first()[0] or 0
    ruled = ruled.withColumnRenamed("host", "of")
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    joined = rows.join(F.broadcast(ruled) if size <= RULES_BYTES else ruled, host(F.col("url")) == F.col("of"), "left")

    def texts(pages_: pa.Array, rules_: pa.Array) -> pa.Array:
        known: dict[str, dict] = {}
        out = []
        for page, rule in zip(pages_.to_pylist(), rules_.to_pylist()):
            if rule is not None and rule not in known:
                known[rule] = json.loads(rule)
            out.append(extract(page, known.get(rule)))
        return pa.array(out, pa.string())

    return joined.select("page_id", "url", F.arrow_udf(texts, "string")("html", "rule").alias("text"))
