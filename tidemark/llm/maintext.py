"""Main text of pages by tag-path ratios: text and punctuation are summed up per root-to-leaf path
of tags, smoothed over neighbouring paths, fused and thresholded."""

from __future__ import annotations

import html
import re
import statistics

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotated, text_udf

# Elements by what they do to the text around them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Never part of an article.
NEVER = set(
    "script style textarea title xmp iframe noembed noframes noscript template head svg canvas"
    " audio video object applet map select option button datalist dialog nav aside footer menu"
    " form fieldset".split()
)
#: Elements that end an open one of the same family up to the nearest boundary.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
#: Blocks of text; paths below them say nothing about where an article lies.
LEAVES = set(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th address summary"
    " legend".split()
)
LISTS = set("ul ol dl".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
    " toolbar".split()
)
#: Words of class and id names.
NOISE = set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo"
    " promotion banner banners cookie cookies consent gdpr notice notices notification alert nav"
    " navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets"
    " footer foot masthead comment comments commentlist disqus reply replies respond discussion"
    " share sharing social related recommend recommended recommendations newsletter subscribe"
    " subscription signup login signin search searchbox form popup modal overlay lightbox pagination"
    " pager copyright toolbar topbar skip paywall trending popular outbrain taboola header".split()
)
CONTENT = set(
    "content main article post entry story body text page wrapper container layout".split()
)
STORY = set("content article post entry story".split())
TUNED = ("has", "no", "with", "without", "is", "not")

_TAG = re.compile(
    r"<(?:(?P<close>/)?(?P<name>[a-zA-Z][^\s/>\x00]*)(?P<rest>(?:[^>\"'=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>"
    r"|!--(?P<comment>(?:>|->|.*?(?:--!?>|\Z)))"
    r"|[!?/](?P<odd>[^>]*(?:>|\Z)))",
    re.S,
)
_PLAIN_END = re.compile(r"[^>]*(?:>|\Z)")
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(
    r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、！？；：।؟،]")

#: Deepest nesting that is followed; deeper elements count as text of the deepest one.
DEEPEST = 400


def attributes(rest: str) -> dict[str, str]:
    """Names in lower case with values; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


def named_noise(names: str) -> bool:
    """Class and id names of which one is of noise and none purely of content."""
    noisy = False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in TUNED and len(words) > 1:
            continue
        if NOISE.intersection(words):
            noisy = True
        elif CONTENT.intersection(words):
            return False
    return noisy


class Node:
    """An element: its tag, the path of tags that leads to it, and whether it is noise."""

    __slots__ = ("tag", "parent", "path", "noise", "hard", "kept", "block", "depth", "story")

    def __init__(self, tag, parent, path, noise, hard, block):
        self.tag, self.parent, self.path = tag, parent, path
        self.noise, self.hard, self.block = noise, hard, block
        self.kept = 0.0
        self.story = parent is not None and parent.story or tag in ("article", "main")
        self.depth = 0 if parent is None else parent.depth + 1


class Page:
    """A page as runs of text, each with the node it stands in.

    `paths` numbers the tag paths as (parent path, tag).  A run of text is (node, text, link).
    """

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[Node, str, bool]] = []
        self.breaks: list[int] = []  # runs before which a block begins or ends
        root = Node("#page", None, self._path(-1, "#page"), False, False, True)
        self.root, self.stack = root, [root]
        self._read(source)

    def _path(self, parent: int, tag: str) -> int:
        return self.paths.setdefault((parent, tag), len(self.paths))

    def _text(self, text: str) -> None:
        if text:
            node = self.stack[-1]
            link = any(n.tag == "a" for n in self.stack[-1:-6:-1])
            self.runs.append((node, text, link))

    def _break(self) -> None:
        if not self.breaks or self.breaks[-1] != len(self.runs):
            self.breaks.append(len(self.runs))

    def _pop_to(self, index: int) -> None:
        if any(n.block for n in self.stack[index:]):
            self._break()
        del self.stack[index:]

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._pop_to(i)
                return
            if tag in INLINE and self.stack[i].block:
                return  # an inline end tag closes nothing outside its block

    def _end_implied(self, tag: str) -> None:
        stack = self.stack
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    self._pop_to(i)
                    break
                if stack[i].block:
                    break
        if tag in ENDED_BY:
            ends, bounds = ENDED_BY[tag]
            last = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    last = i
                elif stack[i].tag == "div" or stack[i].tag == "section":
                    break
            if last is not None:
                self._pop_to(last)

    def _open(self, tag: str, rest: str) -> None:
        self._end_implied(tag)
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._break()
            return
        if len(self.stack) > DEEPEST:
            return
        parent = self.stack[-1]
        block = tag not in INLINE
        given = attributes(rest) if rest.strip(" /\n\t\r") else {}
        inside = parent.story
        hard = parent.hard or tag in NEVER and tag not in ("form", "fieldset")
        hidden = "hidden" in given or bool(_HIDDEN.search(given.get("style", "")))
        role = given.get("role", "").lower()
        noise = parent.noise or hard or tag in NEVER or tag == "header" and not inside
        if not noise and (hidden or role in ROLES):
            noise = True
        if not noise and block and tag not in ("html", "body", "main"):
            named = f"{given.get('class', '')} {given.get('id', '')}"
            if named != " ":
                noise = named_noise(named)
                if noise and inside and "header" in named.lower():
                    noise = named_noise(re.sub("header", "", named, flags=re.I))
        if tag in ("article", "main") and not named_noise(
            f"{given.get('class', '')} {given.get('id', '')}"
        ):
            # an article inside a page-wide form belongs to the page
            above = [n for n in self.stack if n.noise]
            if above and above[0].tag in ("form", "fieldset") and not parent.hard:
                if all(n.tag in ("form", "fieldset", "div", "section", "table", "tbody", "tr",
                                 "td", "center") for n in above):
                    noise = False
        node = Node(tag, parent, self._path(parent.path, tag), noise, hard, block)
        if block and given and STORY.intersection(_WORD.findall(given.get("class", "").lower())):
            node.story = True
        self.stack.append(node)
        if block:
            self._break()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self._text(source[at:])
                break
            m = _TAG.match(source, start)
            if m is None:
                if _OPENS.match(source, start):  # quotes that never end
                    self._text(source[at:start])
                    at = _PLAIN_END.match(source, start).end()
                    continue
                self._text(source[at : start + 1])
                at = start + 1
                continue
            self._text(source[at:start])
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            tag = name.lower()
            if m["close"]:
                if tag == "br":
                    self._text(" ")
                elif tag not in VOID:
                    self._close(tag)
                continue
            self._open(tag, m["rest"])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else size
        self._break()

    def blocks(self) -> list[tuple[list[tuple[Node, str, bool]], str]]:
        """Runs between block borders with their text: references decoded, white space single."""
        out, begin = [], 0
        for end in self.breaks:
            runs = self.runs[begin:end]
            begin = end
            if runs:
                text = " ".join(html.unescape("".join(t for _, t, _ in runs)).split())
                if text:
                    out.append((runs, text))
        return out


class Paths:
    """Per tag path: texts, their length and their punctuation."""

    def __init__(self, n: int):
        self.texts, self.length, self.marks = [0] * n, [0] * n, [0] * n

    def add(self, path: int, text: str) -> None:
        self.texts[path] += 1
        self.length[path] += len(text)
        self.marks[path] += len(_MARKS.findall(text))

    def ratios(self) -> tuple[list[float], list[float]]:
        """Length and punctuation a text on each path."""
        return (
            [a / b if b else 0.0 for a, b in zip(self.length, self.texts, strict=True)],
            [a / b if b else 0.0 for a, b in zip(self.marks, self.texts, strict=True)],
        )


def smoothed(values: list[float], parent_of: list[int], used: list[bool]) -> list[float]:
    """Each used path's value with half the mean of its siblings and a quarter of its parent's:
    paths of one article lie beside each other in the tree."""
    total: dict[int, float] = {}
    count: dict[int, int] = {}
    for p, v in enumerate(values):
        if used[p]:
            total[parent_of[p]] = total.get(parent_of[p], 0.0) + v
            count[parent_of[p]] = count.get(parent_of[p], 0) + 1
    out = []
    for p, v in enumerate(values):
        if not used[p]:
            out.append(0.0)
            continue
        up = parent_of[p]
        above = values[up] if up >= 0 else 0.0
        out.append((v + 0.5 * total[up] / count[up] + 0.25 * above) / 1.75)
    return out


def chosen_paths(page: Page, blocks, noise) -> set[int]:
    """Paths whose fused ratio - smoothed length times smoothed punctuation - is at least one
    standard deviation of all paths'."""
    n = len(page.paths)
    sums = Paths(n)
    for runs, text in blocks:
        if not noise(runs):
            linked = sum(len(t) for _, t, link in runs if link)
            if 2 * linked <= sum(len(t) for _, t, _ in runs):
                sums.add(_path_of(runs), text)
    parent_of = [-1] * n
    for (up, _), p in page.paths.items():
        parent_of[p] = up
    used = [c > 0 for c in sums.texts]
    length, marks = sums.ratios()
    length, marks = smoothed(length, parent_of, used), smoothed(marks, parent_of, used)
    fused = [a * (1.0 + b) for a, b in zip(length, marks, strict=True)]
    some = [f for f, u in zip(fused, used, strict=True) if u]
    if not some:
        return set()
    bar = min(statistics.pstdev(some), max(some))
    return {p for p, u in enumerate(used) if u and fused[p] >= bar}


def _block_node(runs) -> Node:
    node = runs[0][0]
    while not node.block:
        node = node.parent
    return node


def _path_of(runs) -> int:
    return _block_node(runs).path


def _select(page: Page, blocks, noise) -> list[str]:
    chosen = chosen_paths(page, blocks, noise)
    content, total = [], 0.0
    for runs, text in blocks:
        node = _block_node(runs)
        if not noise(runs) and node.path in chosen:
            content.append(node)
            weight = float(len(text))
            total += weight
            while node is not None:
                node.kept += weight
                node = node.parent
    if not content:
        return []
    # down to the element that alone holds the chosen texts, at most to the border of a block
    root = page.root
    children: dict[int, list[Node]] = {}
    seen = set()
    for node in content:
        while node.parent is not None and id(node) not in seen:
            seen.add(id(node))
            children.setdefault(id(node.parent), []).append(node)
            node = node.parent
    while True:
        best = max(children.get(id(root), []), key=lambda c: c.kept, default=None)
        if best is None or best.tag in LEAVES or best.tag in LISTS or best.tag == "table":
            break
        sure = best.tag in ("article", "main")
        if best.kept < (0.7 if sure else 0.95) * root.kept:
            break
        root = best
    lists = _link_lists(blocks, noise)
    title = not any(
        not noise(r) and _block_node(r).tag == "h1" and _within(_block_node(r), root)
        for r, _ in blocks
    )
    out = []
    for runs, text in blocks:
        node = _block_node(runs)
        if noise(runs):
            continue
        if _within(node, root) and not any(id(a) in lists for a in _up(node, root)):
            out.append(text)
        elif title and node.tag == "h1":
            out.append(text)
            title = False
    return out


def _up(node: Node, root: Node):
    while node is not None:
        yield node
        if node is root:
            return
        node = node.parent


def _within(node: Node, root: Node) -> bool:
    while node.depth > root.depth:
        node = node.parent
    return node is root


def _link_lists(blocks, noise) -> set[int]:
    """Lists of three blocks and more that hold nothing but links: menus, tables of contents."""
    linked: dict[int, list[int]] = {}
    for runs, _ in blocks:
        node = _block_node(runs)
        if noise(runs):
            continue
        while node is not None and node.tag not in LISTS:
            node = node.parent
        if node is not None:
            seen = linked.setdefault(id(node), [0, 0])
            seen[0] += 1
            seen[1] += all(link or not t.strip() for _, t, link in runs)
    return {i for i, (n, links) in linked.items() if n >= 3 and n == links}


def main_text(source: str | None) -> str:
    """The main text of a page: blocks in page order, joined by one space.

    Paths of noise (menus, forms, comments and so on, by element, role, class and id) take no part.
    The rest is weighed by path; the chosen paths name the element that holds the article, of which
    every block counts - but for noise and for lists of links - and a page's title heading.
    If noise is all a page has, only elements that can never hold an article count as noise.
    A null, empty or markup-only page gives an empty text.
    """
    page = Page(source or "")
    blocks = page.blocks()
    for noise in (lambda runs: runs[0][0].noise, lambda runs: runs[0][0].hard):
        parts = _select(page, blocks, noise)
        if parts:
            return " ".join(parts)
    return ""


def extract(pages: DataFrame, body: str = "html") -> DataFrame:
    """(row, out): each page with its main text.  Null, empty and broken markup never fail;
    repeated rows are pages of their own; other columns are carried along in `row`."""

    def work():
        return lambda sources: pa.array(map(main_text, sources.to_pylist()), pa.string())

    return annotated(pages, text_udf(work, "string")(F.col(body)))


def op13(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select(
        "row.page_id",
        "row.url",
        F.col("out").alias("text"),
        F.char_length("out").cast("bigint").alias("n_chars"),
    )
