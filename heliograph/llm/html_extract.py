"""HTML extraction: wrappers, as union-free regular expressions, inferred from each host's pages, find the article.

A page is read into its tree of block elements (tag and class names, longer numbers aside) and text slots. A *wrapper* is a union-free
regular expression over such trees: a sequence of elements and slots, each plain or optional, with repeated groups. It is inferred
by alignment. Within a page, where an element recurs among its siblings, the stretches from one to the next are aligned with each other
into one repeated group; what only some of them have becomes optional. Trees of one host are aligned in the same way, element by
element: matched ones recursively, unmatched ones as optional parts, and recurring ones are folded into groups again, until no mismatch
is left. A slot whose text differs between pages is a data slot; one that stays equal is template text.

Wrappers decide what a page's article is. Each element of a wrapper knows how much unlinked text its data slots hold on all pages of the
host. From the body, the article is found by going down to the part that holds ``DOWN`` of that text, as long as there is one and
the element has no headings or paragraphs of its own; an ``article`` or ``main`` with a quarter of the text goes first and is not gone into. So
menus, adverts, sidebars and footers are left out as they hold little of the host's data. Inside the article are dropped: what HTML
itself marks as something else (nav, aside, footer, form, scripts, styles; roles; hidden parts), containers that name themselves boilerplate
(every part of a class or id name among ``MARKS``) and hold less than half of the text both on the page and on its host, and template text: equal on
all of at least ``least_pages`` pages that differ elsewhere, and directly in a ``div`` or ``section``. Headings, paragraphs, lists and tables
are never dropped for a name, nor for being equal on several pages, as pages that are near copies share them. A page that has nothing where its
host has the article is judged by its own wrapper alone.

Reader comments go whatever their share is, also where each of them is an ``article`` of its own, unless a page has nothing else. A heading right before an article in
its ``main`` is the article's.

Merging is a tree: per task, then per host over 1024 salts, then 32, then one, so a hot host is spread and each group gets a bounded number
of wrappers. A wrapper's size is bounded by its element names: siblings of one name are folded, what is over 100 deep is one slot of its
text, and of more than ``MOST_KIDS`` siblings the rarest optional ones of one element name stand as one part without their classes (``ANY``), which keeps
all their text's mass and shape. It matches the elements of that name which the wrapper doesn't name there. Pages themselves are read to any depth.

Character references are decoded, white space inside a block becomes one space, ``br`` counts as white
space, blocks are joined in page order by one newline.

Nulls: a null or empty page gives an empty text; pages without url form a host of their own; broken markup is read
as far as it goes (an unclosed comment, script or tag lasts to the end). Repeated rows are each returned. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import ensure_checkpoint_dir, ship_package

#: HTML's elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
LEAVES = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6 hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select button".split())
SPACED = frozenset(["br", "wbr", "img", "hr"])
DROPPED = frozenset("nav footer aside form dialog menu head fieldset datalist audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names of boilerplate containers, and parts that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal overlay"
    " newsletter subscribe signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended"
    " footer masthead comment comments commentlist reply replies respond disqus pagination pager toolbar widget widgets adsbygoogle adslot gdpr ccpa".split()
)
BESIDE = frozenset("site page post posts list item box block area section container wrapper wrap inner outer left right top bottom main buttons links bar thread form slot unit info success warning danger google dismissible message body header title content meta".split())
#: Of those, what reader comments are called.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
CONTAINERS = frozenset("div section ul ol dl table header span".split())
ARTICLE = ("article", "main")
PLAIN = frozenset(["div", "section"])
HEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
TAG = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<(?=/?[a-zA-Z][^>]*+$)")
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SPACE = re.compile(r"\s+")
DEEPEST = 100  #: levels of a wrapper
MOST_KIDS = 200  #: siblings of a wrapper that are told apart by their classes
ANY = ". *"  #: in place of an element's classes, any but those named beside it; no key of a page holds a space
DOWN = 0.6  #: of an element's data text that one part of it must hold to be gone down to


class Node:
    """An element: key (name and classes), kids (nodes and (text, mass) slots); drop by HTML's own meaning, mark by its names: 1 boilerplate, 2 reader comments."""

    __slots__ = ("drop", "key", "kids", "mark", "mass", "name", "sure")

    def __init__(self, name: str, key: str, drop: bool = False, mark: int = 0):
        self.name, self.key, self.drop, self.mark, self.kids, self.mass, self.sure = name, key, drop, mark, [], 0, False


def marked(names: str) -> int:
    """Whether one of the names is made of boilerplate parts alone: 1, or 2 if it names reader comments."""
    out = 0
    for name in names.split():
        parts = re.split(r"[-_]+", name.strip("-_"))
        if not MARKS.isdisjoint(parts) and all(x in MARKS or x in BESIDE or x.isdigit() for x in parts):
            out = max(out, 1 if COMMENTS.isdisjoint(parts) else 2)
    return out


def _traits(name: str, attrs: str, inside: bool) -> tuple[str, bool, int]:
    """(key, drop, mark) of an element; inside: in an article or main."""
    drop, mark, key = name in DROPPED or name == "header" and not inside, 0, name
    if "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs):
            what, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if what == "role" and value in ROLES or what == "hidden" and value != "until-found" or what == "aria-hidden" and value == "true":
                drop = True
            elif what in ("class", "id"):
                mark = max(mark, marked(value) if name in CONTAINERS else 0)
                if what == "class" and value:
                    key = name + "." + re.sub(r"[0-9]{3,}", "0", ".".join(sorted(value.split())[:3]))[:60]
    return key, drop, mark


def text_hash(text: str) -> int:
    """A 63-bit number of a text, never 0."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1 | 1


def read_page(text: str) -> Node:
    """The tree of a page's block elements and text slots."""
    root = Node("", "")
    stack, parts = [root], []
    linked, link, pos, n, inside = 0, False, 0, len(text), 0
    open_names: Counter = Counter()

    def enter(node):
        nonlocal inside
        stack[-1].kids.append(node)
        stack.append(node)
        open_names[node.name] += 1
        inside += node.name in ARTICLE

    def leave(at):
        nonlocal inside
        for x in stack[at:]:
            open_names[x.name] -= 1
            inside -= x.name in ARTICLE
        del stack[at:]

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            whole = SPACE.sub(" ", html_lib.unescape(raw)).strip()
            parts.clear()
            if whole:
                stack[-1].kids.append((whole, max(0, len(whole) - len(whole) * linked // max(1, len(raw)))))
        linked = 0

    def say(piece):
        nonlocal linked
        parts.append(piece)
        linked += len(piece) if link else 0

    while pos < n:
        m = TAG.search(text, pos)
        if m is None:
            say(text[pos:])
            break
        if m.start() > pos:
            say(text[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0] == "<!--":
                end = text.find("-->", pos)
                pos = n if end < 0 else end + 3
            else:
                end = text.find(">", pos)
                pos = n if end < 0 else end + 1
            continue
        name, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in RAW and not closing:
            if not attrs.endswith("/"):
                end = re.compile(f"</{name}(?![a-zA-Z0-9:-])[^>]*>?", re.I).search(text, pos)
                pos = n if end is None else end.end()
            if name in ("textarea", "noscript", "iframe", "object", "select", "button"):
                say(" ")
            continue
        if name not in BLOCKS:
            if name in SPACED:
                say(" ")
            elif name == "a":
                link = not closing
            elif closing:
                if stack[-1].name == name and len(stack) > 1:  # only inline elements that stand apart are on the stack
                    flush()
                    leave(len(stack) - 1)
            elif name not in VOID and not attrs.endswith("/") and attrs:
                key, drop, mark = _traits(name, attrs, inside > 0)
                if drop or mark:  # an inline element that isn't the text's
                    flush()
                    enter(Node(name, key, drop, mark))
            continue
        flush()
        if closing:
            link = False
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None) if open_names[name] else None
            if at is not None and (name not in LEAVES or all(x.name in LEAVES or x.name not in BLOCKS for x in stack[at:])):
                leave(at)
        else:
            while len(stack) > 1 and (stack[-1].name == "p" or stack[-1].name not in BLOCKS or name in LEAVES and stack[-1].name == name):
                leave(len(stack) - 1)  # a new block ends an open paragraph
            if name in VOID or attrs.endswith("/"):
                continue
            enter(Node(name, *_traits(name, attrs, inside > 0)))
    flush()
    return root


def weigh(root: Node) -> int:
    """The page's unlinked text: sets the mass of each element. What holds an article or main isn't boilerplate for its name; comments with articles are, if there is an article elsewhere."""
    order, todo, outside = [], [(root, False)], False
    while todo:  # parents before their children
        node, among = todo.pop()
        if node.drop:
            continue
        order.append(node)
        among = among or node.mark == 2
        outside = outside or node.name in ARTICLE and not among
        todo += [(k, among) for k in node.kids if isinstance(k, Node)]
    holds: set = set()
    for node in reversed(order):
        kids = [k for k in node.kids if isinstance(k, Node)]
        node.mass = sum(k.mass for k in kids) + sum(k[1] for k in node.kids if not isinstance(k, Node))
        if node.name in ARTICLE or any(id(k) in holds for k in kids):
            holds.add(id(node))
            if node.mark == 1 or not outside:
                node.mark = 0
            elif node.mark == 2:
                holds.discard(id(node))
    return root.mass


# A wrapper part is a list: key, pages, optional, repeated, data mass, constant text's hash or 0, marked, kids.
KEY, PAGES, OPTIONAL, REPEATED, MASS, CONST, MARK, KIDS = range(8)


def page_wrapper(node: Node, deep: int = 0) -> list:
    """The wrapper of one page's tree."""
    kids = []
    for kid in node.kids:
        if not isinstance(kid, Node):
            kids.append(["#", 1, 0, 0, kid[1], text_hash(kid[0]), 0, []])
        elif kid.drop:
            continue
        elif deep >= DEEPEST:
            kids.append(["#", 1, 0, 0, 0 if kid.mark else kid.mass, 0, 0, []])
        else:
            kids.append(page_wrapper(kid, deep + 1))
    return [node.key, 1, 0, 0, node.mass, 0, int(node.mark), fold(kids)]


def merged(a: list, b: list, within: bool) -> list:
    """Two parts of one key aligned; within: they are of the same page."""
    pages = max(a[PAGES], b[PAGES]) if within else a[PAGES] + b[PAGES]
    return [a[KEY], pages, a[OPTIONAL] | b[OPTIONAL], a[REPEATED] | b[REPEATED] | int(within), a[MASS] + b[MASS], a[CONST] if a[CONST] == b[CONST] else 0, min(a[MARK], b[MARK]), align(a[KIDS], b[KIDS], within)]


def align(a: list[list], b: list[list], within: bool = False) -> list[list]:
    """Two sequences of parts as one: equal keys are merged, the others become optional; what then recurs is put into groups."""
    ka, kb = [x[KEY] for x in a], [x[KEY] for x in b]
    ops = [("equal", 0, len(a), 0, len(b))] if ka == kb else SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes()
    out = []
    for op, i, j, k, m in ops:
        if op == "equal":
            out += [merged(x, y, within) for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += [[*x[:OPTIONAL], 1, *x[OPTIONAL + 1 :]] for x in a[i:j] + b[k:m]]
    out = fold(out) if within else flat(out)
    if len(out) > MOST_KIDS:
        least = sorted((x[PAGES] for x in out if x[OPTIONAL]), reverse=True)[MOST_KIDS // 2 :]
        out = flat([z for x in out for z in ([unnamed(y) for y in _members(x)] if x[OPTIONAL] and least and x[PAGES] <= least[0] else [x])])
    return out


def any_of(key: str, mark: int) -> str:
    """The key that stands for all elements of a name, kept apart by mark. Names that aren't HTML's blocks count as one."""
    name = key.split(".")[0]
    return f"{name if name in BLOCKS else ''}{ANY}{mark}"


def unnamed(part: list) -> list:
    """A part that stands for its element's name alone, so it is optional; slots have no name."""
    return [part[KEY] if part[KEY] == "#" else any_of(part[KEY], part[MARK]), part[PAGES], 1, *part[OPTIONAL + 1 :]]


def fold(parts: list[list]) -> list[list]:
    """Parts of distinct keys: a run of one key becomes a repeated part; then, from the first key that recurs on, the stretches
    that start with it are aligned into one group."""
    runs: list[list] = []
    for x in parts:
        if runs and runs[-1][KEY] == x[KEY]:
            runs[-1] = merged(runs[-1], x, True)
        else:
            runs.append(x)
    parts, first = runs, {}
    for i, x in enumerate(parts):
        first.setdefault(x[KEY], []).append(i)
    at = min((v[0] for v in first.values() if len(v) > 1), default=None)
    if at is None:
        return parts
    cuts = [*first[parts[at][KEY]], len(parts)]
    unit = None
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = [parts[i], *fold(parts[i + 1 : j])]
        unit = own if unit is None else align(unit, own, True)
    return [*parts[:at], ["(" + parts[at][KEY], max(x[PAGES] for x in unit), int(all(x[OPTIONAL] for x in unit)), 1, sum(x[MASS] for x in unit), 0, 0, unit]]


def _members(part: list) -> list[list]:
    return [y for x in part[KIDS] for y in _members(x)] if part[KEY].startswith("(") else [part]


def _once(parts) -> list[list]:
    """The parts with those of one key merged."""
    by: dict = {}
    for y in parts:
        by[y[KEY]] = merged(by[y[KEY]], y, False) if y[KEY] in by else y
    return list(by.values())


def flat(parts: list[list]) -> list[list]:
    """Parts of distinct keys: if pages differ in order, so that a key recurs, all from the first such part to the last
    become one group in which each key stands once."""
    where: dict = {}
    for i, x in enumerate(parts):
        for y in _members(x):
            where.setdefault(y[KEY], set()).add(i)
    again = [i for v in where.values() if len(v) > 1 for i in v]
    if not again:
        return parts
    lo, hi = min(again), max(again) + 1
    unit = [[*x[:OPTIONAL], 1, *x[OPTIONAL + 1 :]] for x in _once(y for x in parts[lo:hi] for y in _members(x))]
    if len(unit) > MOST_KIDS:
        least = sorted((x[PAGES] for x in unit), reverse=True)[MOST_KIDS // 2]
        unit = _once(x if x[PAGES] > least else unnamed(x) for x in unit)
    return [*parts[:lo], ["(" + unit[0][KEY], max(x[PAGES] for x in unit), 1, 1, sum(x[MASS] for x in unit), 0, 0, unit], *parts[hi:]]


def expression(part: list) -> str:
    """A wrapper part as a union-free regular expression; "#" is a data slot, "=" template text."""
    inner = " ".join(expression(x) for x in part[KIDS])
    if part[KEY] == "#":
        out = "=" if part[CONST] else "#"
    elif part[KEY].startswith("("):
        out = f"( {inner} )"
    else:
        out = f"{part[KEY]}[{inner}]" if inner else part[KEY]
    return out + ("+" if part[REPEATED] else "") + ("?" if part[OPTIONAL] and not part[KEY].startswith("(") else "")


def _inner(part: list):
    """The elements and slots right under a part, groups aside."""
    for x in part[KIDS]:
        if x[KEY].startswith("("):
            yield from _inner(x)
        else:
            yield x


def data_mass(part: list, least_pages: int) -> int:
    """Unlinked text outside template slots and marked containers."""
    if part[KEY] == "#":
        return 0 if part[CONST] and part[PAGES] >= least_pages else part[MASS]
    return sum(data_mass(x, least_pages) for x in _inner(part) if not x[MARK])


def decide(wrapper: list, least_pages: int) -> dict:
    """Where the article is: {"path": keys from the root, "named": for each of them, the keys that it doesn't stand for, "template": hashes of template text, "kept": marked containers' keys that hold most text, "told": where such a key stands for any classes, those that it doesn't stand for}."""
    varies = any(not x[CONST] for x in _slots(wrapper))
    template = sorted({x[CONST] for p, x in _placed(wrapper) if x[CONST] and x[PAGES] >= least_pages and not x[OPTIONAL] and p in PLAIN}) if wrapper[PAGES] >= least_pages and varies else []
    total = data_mass(wrapper, least_pages)
    big = sorted({x[KEY] for x in _elements(wrapper) if x[MARK] == 1 and 2 * x[MASS] >= max(1, wrapper[MASS])})
    told = sorted({x[KEY] for x in _elements(wrapper) if x[MARK] == 1 and ANY not in x[KEY]}) if any(ANY in k for k in big) else []
    found = lambda path: {"path": path, "named": _named(wrapper, path), "template": template, "kept": big, "told": told}
    for name in ARTICLE:
        mass: dict = {}
        for path, x in _paths(wrapper, ()):
            if x[KEY].split(".")[0] == name:
                mass[path] = mass.get(path, 0) + data_mass(x, least_pages)
        best = max(mass, key=lambda p: (mass[p], -len(p), p), default=None)
        if best is not None and 4 * mass[best] >= max(1, total):
            return found(best)
    at, path = [wrapper], ()
    while True:
        kids: dict = {}
        for x in at:
            for y in _inner(x):
                kids.setdefault(y[KEY], []).append(y)
        mass = {k: sum(data_mass(x, least_pages) for x in v if not x[MARK]) for k, v in kids.items() if k != "#" and k.split(".")[0] not in LEAVES}
        own = any(k == "#" or k.split(".")[0] in HEADS for k in kids)
        best = max(mass, key=lambda k: (mass[k], k), default=None)
        page = path in ((), ("html",)) and best in ("html", "body")
        if best is None or not mass[best] or not page and (own or mass[best] < DOWN * sum(data_mass(x, least_pages) for x in at)):
            return found(path)
        at, path = kids[best], (*path, best)


def _named(wrapper: list, path: tuple) -> list[list[str]]:
    """For each key of a path that stands for any classes, the keys of its name beside it."""
    at, out = [wrapper], []
    for key in path:
        kids = [y for x in at for y in _inner(x)]
        out.append(sorted({y[KEY] for y in kids if y[KEY] not in ("#", key) and any_of(y[KEY], y[MARK]) == key}) if ANY in key else [])
        at = [y for y in kids if y[KEY] == key]
    return out


def _elements(part: list):
    for x in part[KIDS]:
        yield x
        yield from _elements(x)


def _slots(part: list):
    return (x for x in _elements(part) if x[KEY] == "#")


def _placed(part: list):
    """(name of the element, slot) of each slot outside repeated groups."""
    for x in part[KIDS]:
        if x[KEY] == "#" and not x[REPEATED]:
            yield part[KEY].split(".")[0], x
        elif not x[REPEATED]:
            yield from _placed(x)


def _paths(part: list, path: tuple):
    for x in _inner(part):
        if x[KEY] != "#" and not x[MARK]:
            yield (*path, x[KEY]), x
            yield from _paths(x, (*path, x[KEY]))


def _at(node: Node, path, named) -> list[Node]:
    """The elements at a path of keys."""
    found = [node]
    for key, others in zip(path, named, strict=True):
        found = [k for x in found for k in x.kids if isinstance(k, Node) and not k.drop and (k.key == key or ANY in key and any_of(k.key, k.mark) == key and k.key not in others)]
    return found


def _keeps(decision: dict) -> Callable[[Node], bool]:
    """Whether a marked container holds most of its host's text; what the wrapper doesn't name counts by its element."""
    kept, told = frozenset(decision["kept"]), frozenset(decision["told"])
    return lambda kid: kid.key in kept or kid.key not in told and any_of(kid.key, kid.mark) in kept


def _blocks(node: Node, template: frozenset, kept: Callable[[Node], bool], half: float, comments: bool) -> list[str]:
    """The texts of an element's blocks in page order, without boilerplate; comments: reader comments count as text."""
    out, todo = [], [iter(node.kids)]
    names = [node.name]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
            names.pop()
        elif not isinstance(kid, Node):
            if not (template and names[-1] in PLAIN and text_hash(kid[0]) in template):
                out.append(kid[0])
        elif not kid.drop and (not kid.mark or (comments if kid.mark == 2 else kid.mass >= half or kept(kid))):
            todo.append(iter(kid.kids))
            names.append(kid.name)
    return out


def _headed(page: Node, found: list[Node]) -> dict[int, list[str]]:
    """Texts of the headings that stand right before each article in its main."""
    want, out, todo = {id(x) for x in found}, {}, [page]
    while todo:
        node = todo.pop()
        heads: list[str] = []
        for kid in node.kids:
            if not isinstance(kid, Node) or kid.drop:
                continue
            if node.name == "main" and kid.name in ("h1", "h2"):
                heads += _blocks(kid, frozenset(), lambda _: False, 0, False)
            elif id(kid) in want:
                out[id(kid)], heads = heads, []
            todo.append(kid)
    return out


def main_text(text: str, decision: dict | None = None, least_pages: int = 5) -> str:
    """The article of a page, by its host's decision or by its own wrapper."""
    page = read_page(text)
    weigh(page)
    found = _at(page, decision["path"], decision["named"]) if decision else []
    if not any(x.mass for x in found):
        decision = decide(page_wrapper(page), 1 << 30)
        found = _at(page, decision["path"], decision["named"])
    template, kept, half = frozenset(decision["template"]), _keeps(decision), page.mass / 2
    heads = _headed(page, found) if found and found[0].name == "article" else {}
    for comments in (False, True):  # what has nothing but comments is a page of comments
        out = [t for x in found for t in [*heads.get(id(x), []), *_blocks(x, template, kept, half, comments)]]
        if out:
            break
    return "\n".join(out)


def host_of(url) -> F.Column:
    """The host of a url column, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_W = "host string, part long, wrapper string"
FLUSH = 1000  #: hosts that a task holds at a time


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON) of each host of pages(url, html)."""
    ship_package(pages.sparkSession)

    def rows(found: dict) -> pa.RecordBatch:
        w = [json.dumps(x) for x in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.string()), pa.array([text_hash(x) for x in w], type=pa.int64()), pa.array(w, type=pa.string())], names=["host", "part", "wrapper"])

    def streams(batches):
        found: dict = {}
        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = read_page(text or "")
                weigh(page)
                w = page_wrapper(page)
                found[host] = merged(found[host], w, False) if host in found else w
                if len(found) > FLUSH:
                    yield rows(found)
                    found = {}
        yield rows(found)

    def together(key, table):
        out = None
        for x in sorted(table.column("wrapper").to_pylist()):
            w = json.loads(x)
            out = w if out is None else merged(out, w, False)
        text = json.dumps(out)
        return pa.table({"host": [key[0].as_py()], "part": [text_hash(text)], "wrapper": [text]})

    out = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(streams, _W)
    for salts in (1024, 32, 1):
        out = out.groupBy("host", F.pmod(F.xxhash64("part"), F.lit(salts))).applyInArrow(together, _W)
    return out.select("host", "wrapper")


def extract_text(pages: DataFrame, least_pages: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, url, text of each row of pages(page_id, url, html)."""
    spark = pages.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)

    def decisions(batches):
        for batch in batches:
            d = [json.dumps(decide(json.loads(w), least_pages)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(d, type=pa.string())], names=["of", "decision"])

    hosts = infer_wrappers(pages).mapInArrow(decisions, "of string, decision string").checkpoint()
    size = hosts.agg(F.sum(F.length("of") + F.length("decision") + 100)).first()[0] or 0
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(hosts) if size <= broadcast_bytes else hosts, F.col("host") == F.col("of"), "left")

    def run(batches):
        for batch in batches:
            read: dict = {}
            out = []
            for text, d in zip(batch.column("html").to_pylist(), batch.column("decision").to_pylist(), strict=True):
                if d not in read:
                    read[d] = json.loads(d) if d else None
                out.append(main_text(text or "", read[d], least_pages))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, type=pa.string())], names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "decision").mapInArrow(run, "page_id long, url string, text string")
