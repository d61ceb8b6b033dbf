"""Main text of web pages by wrapper induction.

Pages of a host share a template. Every page becomes a tree of its block elements in which
repeated paragraphs, list items and cells fold into one node, as do long rows of like containers;
what the markup marks as noise folds apart from the rest. Per host the most frequent tree is the pivot; the
host's other trees are aligned to it by simple tree matching, and each text of a page votes for the
pivot node it is aligned with. A text that stands in the same pivot node on half of the host's pages, three
at least, is template there, inside articles too; all else varies and fills slots. The content node is found
from the root down: as long as one container below holds nine tenths of the varying text, it goes on there.
Articles within it, else the main element around or within it, take its place if varying text stands in them, so
an article that is the same everywhere is no content. A page is aligned to the wrapper and gives the
blocks below the content nodes, without template texts, menus, headers, footers, sidebars, notices,
adverts, forms and reader comments. Where template texts make up more than half of that, the pages are
copies of each other and it stays whole.

Hosts of fewer than three pages, hosts where nothing varies and pages that have no node aligned with a content node
go by their elements instead: article, else main, else everything. ``rule`` tells which gave the text.

A host with any share of the pages is no bottleneck: its statistics are sums, and pages meet the wrapper
in parts of a host, as many as its pages ask for. Null or empty html gives an empty text; a null url
is a host of its own; repeated rows count as often as they stand there; an empty table gives an empty
result. Broken markup: open elements are closed as browsers do; a tag without its end goes up to the next "<"
outside quotes, one with an open quote up to the next ">", and one with neither to the end of the page.
Nesting may be of any depth; parsing takes time linear in the page.
"""

from __future__ import annotations

import html as entities
import json
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, map_columns

PART_PAGES = 1000
AGREE = 3
SHARE = 0.5
REPEATS = 8
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+(?:['\"][^>]*+)?)(?:>|(?=<)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                       re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset(
    "html body main article section div header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary dialog menu "
    "head center hgroup search".split())
FOLDED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure".split())
EMPTY = frozenset("br hr img meta link input area base col embed source track wbr".split())
CLOSES_PARAGRAPH = BLOCKS - {"html", "body", "head", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"}
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
              "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
          "th": ("table", "tr"), "option": ("select",)}
NOISE_TAGS = frozenset("head nav aside footer form button select menu dialog search object audio video canvas".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead notice notices cookie cookies consent gdpr newsletter subscribe signup share "
    "sharing social related recommended comment comments disqus popup modal overlay pagination pager search login "
    "toolbar skip".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert menu menubar".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Noise by class or id names only, and noise by the element, its role or because it is not shown.
NAMED, SURE = 1, 2


class Tree:
    """Nodes by number, parents before their children: label, noise, parent and children of each."""
    __slots__ = ("labels", "noise", "parents", "children")

    def __init__(self):
        self.labels, self.noise, self.parents, self.children = ["#"], [0], [-1], [[]]

    def add(self, label: str, noise: int, parent: int) -> int:
        number = len(self.labels)
        self.labels.append(label)
        self.noise.append(noise)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].append(number)
        return number


def _described(tag: str, attrs: str, in_article: bool) -> tuple[str, int]:
    """Label of an element and whether its markup calls it something other than content (0, NAMED or SURE)."""
    noise = SURE if tag in NOISE_TAGS or (tag == "header" and not in_article) else 0
    label = tag
    if attrs and "=" in attrs or "hidden" in attrs:
        names = []
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id"):
                words = [w.lower() for w in NAME.findall(value)]
                if key == "class":
                    names += words
                noise = noise or (NAMED if any(w in NOISE_NAMES for w in words) else 0)
            elif key == "role":
                names.append(value.lower())
                noise = SURE if value.lower() in NOISE_ROLES else noise
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                noise = SURE
            elif key == "style" and "display:none" in value.replace(" ", "").lower():
                noise = SURE
        if names:
            label = f"{tag}.{'.'.join(sorted(set(names)))}"
    return label, 0 if tag in ("html", "body") or tag in CONTENT_TAGS else noise


def _uncover(tree: Tree, blocks: list[tuple[int, str]]) -> None:
    """Take NAMED noise off the wrappers of the content elements.

    A wrapper of a main element is never noise by its names, and of an article not where no other
    article stands free of such noise. Wrappers go from the outside in, so that related articles
    and comments beside an article stay noise, as do articles named so below a main element with
    text of its own.
    """
    size = len(tree.labels)
    tags = [label.split(".", 1)[0] for label in tree.labels]
    own = [0] * size
    for n, text in blocks:
        own[n] += len(text)
    hidden = [False] * size
    for n in range(size):
        up = tree.parents[n]
        hidden[n] = tree.noise[n] == SURE or up >= 0 and (hidden[up] or tags[up] == "article")
    cleared = [False] * size
    for n in range(size):
        while n >= 0 and tags[n] == "main" and not hidden[n] or n >= 0 and cleared[n]:
            up = tree.parents[n]
            if up < 0 or cleared[up]:
                break
            cleared[up] = True
            tree.noise[up] = 0 if tree.noise[up] == NAMED else tree.noise[up]
            n = up
    while True:
        chars = list(own)
        for n in range(size - 1, 0, -1):
            if not tree.noise[n]:
                chars[tree.parents[n]] += chars[n]
        cover: list[int] = [-1] * size
        articles, free_main, free_article = [], 0, False
        for n in range(size):
            up = tree.parents[n]
            cover[n] = cover[up] if up >= 0 and cover[up] >= 0 else n if tree.noise[n] else -1
            if hidden[n]:
                continue
            if tags[n] == "main":
                free_main = max(free_main, chars[n])
            elif tags[n] == "article":
                if cover[n] < 0:
                    free_article = True
                else:
                    articles.append((cover[n], any(w in NOISE_NAMES for w in tree.labels[n].split(".")[1:]), chars[n]))
        if free_article or not articles:
            return
        plain = [a for a in articles if not a[1]] or ([] if free_main else articles)
        if not plain or sum(a[2] for a in plain) < free_main:
            return
        for node, _, _ in plain:
            tree.noise[node] = 0


def parse(page: str) -> tuple[Tree, list[tuple[int, str]]]:
    """Folded tree of block elements and the page's blocks in order, each with its node number."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("#", 0)]  # open elements: tag and node, -1 for inline ones
    opened: dict[str, list[int]] = {}  # depths of the open elements of a tag
    block_depths = [0]
    folds: dict[tuple[int, str, int], int] = {}
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    articles = 0
    marked, content = False, False

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                blocks.append((stack[block_depths[-1]][1], text))
            run.clear()

    def push(tag: str, node: int) -> None:
        opened.setdefault(tag, []).append(len(stack))
        if node >= 0:
            block_depths.append(len(stack))
        stack.append((tag, node))

    def pop_to(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            tag, node = stack.pop()
            opened[tag].pop()
            if node >= 0:
                block_depths.pop()
            articles -= tag in CONTENT_TAGS

    def last_open(tags: tuple[str, ...], bounds: tuple[str, ...] = ()) -> int:
        """Depth of the last open element of these tags, 0 if there is none or a bound is open within it."""
        depth = max((opened[t][-1] for t in tags if opened.get(t)), default=0)
        return depth if all(not opened.get(t) or opened[t][-1] <= depth for t in bounds) else 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            run.append(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag = tag.lower()
        if m.group("end"):
            depth = last_open((tag,))
            if depth:
                if stack[depth][1] >= 0:
                    flush()
                    pop_to(depth)
                elif block_depths[-1] < depth:
                    pop_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in EMPTY:
            if tag == "hr":
                flush()
            continue
        for closed, bounds in (((("p",), ("td", "th", "li", "button")),) if tag in CLOSES_PARAGRAPH else ()) + (
                ((CLOSES_OWN[tag], BOUNDS[tag]),) if tag in CLOSES_OWN else ()):
            depth = last_open(closed, bounds)
            if depth:
                flush()
                pop_to(depth)
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            push(tag, -1)
            continue
        flush()
        label, noise = _described(tag, m.group("attrs"), articles > 0)
        current = stack[block_depths[-1]][1]
        if tag in FOLDED:
            node = folds.get((current, label, noise), -1)
        else:
            # Containers in a row keep their places up to REPEATS of them; what follows folds into the last.
            last = tree.children[current][-REPEATS:]
            alike = len(last) == REPEATS and all(tree.labels[c] == label and tree.noise[c] == noise for c in last)
            node = last[-1] if alike else -1
        if node < 0:
            node = tree.add(label, noise, current)
            if tag in FOLDED:
                folds[current, label, noise] = node
        marked, content = marked or noise == NAMED, content or tag in CONTENT_TAGS
        push(tag, node)
        articles += tag in CONTENT_TAGS
    if at < len(page):
        run.append(page[at:])
    flush()
    if marked and content:
        _uncover(tree, blocks)
    return tree, blocks


def encode_tree(tree: Tree) -> list:
    """The tree as three lists by node number, for storing: labels, noise (0 or 1), parents."""
    return [tree.labels, [int(n > 0) for n in tree.noise], tree.parents]


def _children(tree: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree[0]]
    for n, parent in enumerate(tree[2]):
        if parent >= 0:
            out[parent].append(n)
    return out


def _shapes(tree: list, children: list[list[int]], known: dict) -> tuple[list[int], list[int]]:
    """Per node a number that equal subtrees share, and the nodes of its subtree."""
    shapes, sizes = [0] * len(children), [1] * len(children)
    for n in range(len(children) - 1, -1, -1):
        shape = (tree[0][n], tree[1][n], tuple(shapes[c] for c in children[n]))
        shapes[n] = known.setdefault(shape, len(known))
        sizes[n] += sum(sizes[c] for c in children[n])
    return shapes, sizes


def _heaviest_chain(links: list[tuple[int, int, int]], width: int) -> tuple[int, list[int]]:
    """Of links (i, j, weight), sorted by i and falling j, the heaviest set that rises in both: weight and positions.

    A tree of prefix maxima over j gives the best chain a link can follow.
    """
    tops = [(0, -1)] * (width + 1)
    before = []
    best = (0, -1)
    for k, (_, j, weight) in enumerate(links):
        top, at = (0, -1), j
        while at > 0:
            top = max(top, tops[at])
            at &= at - 1
        before.append(top[1])
        here = (top[0] + weight, k)
        best = max(best, here)
        at = j + 1
        while at <= width:
            tops[at] = max(tops[at], here)
            at += at & -at
    chain, k = [], best[1]
    while k >= 0:
        chain.append(k)
        k = before[k]
    return best[0], chain


def match(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: size of the largest order-keeping match of two trees, and the matched node numbers.

    Pairs of nodes that can match are listed from the roots down and sized from the leaves up, so depth costs no
    recursion; equal subtrees match whole.
    """
    if a[0][0] != b[0][0]:
        return 0, []
    below_a, below_b, known = _children(a), _children(b), {}
    shape_a, size_a = _shapes(a, below_a, known)
    shape_b, _ = _shapes(b, below_b, known)
    pairs: list[tuple[int, int]] = [(0, 0)]
    links: list[list[tuple[int, int, int]]] = []  # per pair: i, j and position of the pair of children
    for x, y in pairs:
        mine: list[tuple[int, int, int]] = []
        links.append(mine)
        if shape_a[x] == shape_b[y]:
            continue
        places: dict[tuple[str, int], list[int]] = {}
        for j, d in enumerate(below_b[y]):
            places.setdefault((b[0][d], b[1][d]), []).append(j)
        for i, c in enumerate(below_a[x]):
            for j in reversed(places.get((a[0][c], a[1][c]), ())):
                mine.append((i, j, len(pairs)))
                pairs.append((c, below_b[y][j]))
    sizes = [0] * len(pairs)
    for k in range(len(pairs) - 1, -1, -1):
        x, y = pairs[k]
        if shape_a[x] == shape_b[y]:
            sizes[k] = size_a[x]
        else:
            weight, chain = _heaviest_chain([(i, j, sizes[to]) for i, j, to in links[k]], len(below_b[y]))
            sizes[k], links[k] = weight + 1, [links[k][c] for c in chain]
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        x, y = pairs[k]
        if shape_a[x] != shape_b[y]:
            out.append((x, y))
            todo += [to for _, _, to in links[k]]
            continue
        same = [(x, y)]
        while same:
            c, d = same.pop()
            out.append((c, d))
            same += zip(below_a[c], below_b[d])
    return sizes[0], out


def _covered(tree: list) -> list[bool]:
    """Per node whether it or one above it is noise."""
    out: list[bool] = []
    for noise, parent in zip(tree[1], tree[2]):
        out.append(bool(noise) or parent >= 0 and out[parent])
    return out


def _named(tree: list, covered: list[bool], tag: str) -> set[int]:
    return {n for n, label in enumerate(tree[0]) if label.split(".", 1)[0] == tag and not covered[n]}


def wrapper_of(tree: list, varying: dict[int, int]) -> list[int]:
    """Content nodes of a pivot tree; none where nothing varies.

    ``varying`` has the characters of varying text by node number.
    """
    covered, children = _covered(tree), _children(tree)
    below = [0 if covered[n] else varying.get(n, 0) for n in range(len(covered))]
    for n in range(len(below) - 1, 0, -1):
        below[tree[2][n]] += below[n]
    if not below[0]:
        return []
    articles, mains = ({n for n in _named(tree, covered, tag) if below[n]} for tag in ("article", "main"))
    at = 0
    while at not in articles and at not in mains:
        down = max((n for n in children[at] if tree[0][n].split(".", 1)[0] not in FOLDED), key=lambda n: below[n], default=None)
        if down is None or below[down] < 0.9 * below[at]:
            break
        at = down
    inside = [False] * len(below)
    for n in range(at, len(below)):
        inside[n] = n == at or n > at and inside[tree[2][n]]
    return sorted(n for n in articles if inside[n]) or sorted(n for n in mains if inside[n]) or [at]


def extract(page: str | None, pivot: list | None, content: list[int],
            template: frozenset[tuple[int, int]] = frozenset()) -> tuple[str, str]:
    """Text of a page under its host's wrapper, and the rule that gave it: votes or elements.

    ``template`` has pivot node and hash of the host's template texts.
    """
    if not page:
        return "", "elements"
    parsed, blocks = parse(page)
    tree = encode_tree(parsed)
    pairs = dict(match(tree, pivot)[1]) if pivot and content else {}
    wanted = set(content)
    covered = _covered(tree)
    articles = _named(tree, covered, "article")
    roots = {n for n, to in pairs.items() if to in wanted and not covered[n]}
    rule = "votes" if roots else "elements"
    if roots & articles:
        # An article that the host's pivot does not have is content of this page all the same.
        roots |= {n for n in articles if n not in pairs}
    roots = roots or articles or _named(tree, covered, "main") or {0}
    kept: list[bool] = []
    for n, parent in enumerate(tree[2]):
        kept.append(not covered[n] and (n in roots or parent >= 0 and kept[parent]))
    inside = [(text, n in pairs and (pairs[n], text_hash(text)) in template) for n, text in blocks if kept[n]]
    shared = sum(len(text) for text, same in inside if same)
    whole = 2 * shared > sum(len(text) for text, _ in inside)
    return "\n".join(text for text, same in inside if whole or not same), rule


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host_", F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1), F.lit(""))))


def _observed(pages: DataFrame) -> DataFrame:
    """Per batch, host and tree: pages, and per node and text hash the pages that have it there and its characters."""
    def start():
        def work(c):
            seen: dict[tuple[str, str], list] = {}
            for host, page in zip(c["host_"], c["html"]):
                if not page:
                    continue
                parsed, blocks = parse(page)
                tree = encode_tree(parsed)
                entry = seen.setdefault((host, json.dumps(tree, ensure_ascii=False)), [0, {}])
                entry[0] += 1
                covered = _covered(tree)
                here: dict[tuple[int, int], int] = {}
                for n, text in blocks:
                    if not covered[n]:
                        key = n, text_hash(text)
                        here[key] = here.get(key, 0) + len(text)
                for key, chars in here.items():
                    vote = entry[1].setdefault(key, [0, 0])
                    vote[0] += 1
                    vote[1] += chars
            return {
                "host_": [h for h, _ in seen], "tree": [t for _, t in seen], "pages": [e[0] for e in seen.values()],
                "votes": [[{"node": n, "hash": h, "n": v[0], "chars": v[1]} for (n, h), v in e[1].items()]
                          for e in seen.values()]}
        return work

    return map_columns(pages.select("host_", "html"), start, "host_ string, tree string, pages bigint, "
                       "votes array<struct<node:int,hash:bigint,n:bigint,chars:bigint>>")


def _in_parts(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Add ``part_``: which of its host's parts a row is in, 0 for hosts of one part."""
    parted = rows.join(hot, "host_", "left")
    return parted.withColumn("part_", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))).drop("parts")


def _spread(hosts: DataFrame) -> DataFrame:
    """A copy of a host's row for each of its parts."""
    return hosts.withColumn("part_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")


def induce(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The wrapper of every host, and the hosts of more than one part.

    A wrapper: host_, pivot (a tree as text), parts, content node numbers, template (pivot node and text hash). A
    template is as long as two pages at most, since each of its texts stands on half of the pages.
    """
    observed = scratch.store(_observed(_with_host(pages)), "observed")
    trees = observed.groupBy("host_", F.xxhash64("tree").alias("id")).agg(
        F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("rows"), F.min("tree").alias("tree"))
    hosts = scratch.store(trees.groupBy("host_").agg(
        F.max_by("tree", F.struct("pages", "id")).alias("pivot"), F.sum("pages").alias("all_pages"),
        F.ceil(F.sum("pages") / PART_PAGES).alias("parts")), "hosts")
    hot = scratch.store(hosts.filter("parts > 1").select("host_", "parts"), "hot")

    def start():
        pivots: dict[str, list] = {}

        def work(c):
            out = {k: [] for k in ("host_", "all_pages", "node", "hash", "n", "chars")}
            for host, tree, pivot, pages_, votes in zip(*(c[k] for k in ("host_", "tree", "pivot", "all_pages", "votes"))):
                pairs = dict(match(json.loads(tree), decoded(pivot, pivots))[1])
                for v in votes:
                    if v["node"] in pairs:
                        for k, value in zip(out, (host, pages_, pairs[v["node"]], v["hash"], v["n"], v["chars"])):
                            out[k].append(value)
            return out
        return work

    met = _in_parts(observed, hot).join(_spread(hosts.filter(F.col("all_pages") >= AGREE)), ["host_", "part_"])
    aligned = map_columns(met.select("host_", "tree", "pivot", "all_pages", "votes"), start,
                          "host_ string, all_pages bigint, node int, hash bigint, n bigint, chars bigint")
    texts = aligned.groupBy("host_", "node", "hash").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max("all_pages").alias("all_pages"))
    constant = (F.col("n") >= AGREE) & (F.col("n") >= SHARE * F.col("all_pages"))
    nodes = texts.groupBy("host_", "node").agg(
        F.sum(F.when(constant, 0).otherwise(F.col("chars"))).alias("varying"),
        F.collect_list(F.when(constant, F.col("hash"))).alias("template"))
    votes = nodes.groupBy("host_").agg(F.collect_list(F.struct("node", "varying", "template")).alias("votes"))

    def decide():
        def work(c):
            content, template = [], []
            for pivot, found in zip(c["pivot"], c["votes"]):
                content.append(wrapper_of(json.loads(pivot), {v["node"]: v["varying"] for v in found or ()}) if found else [])
                template.append([{"node": v["node"], "hash": h} for v in found or () for h in v["template"]])
            return {k: c[k] for k in ("host_", "pivot", "parts")} | {"content": content, "template": template}
        return work

    wrappers = map_columns(hosts.join(votes, "host_", "left").select("host_", "pivot", "parts", "votes"), decide,
                           "host_ string, pivot string, parts bigint, content array<int>, "
                           "template array<struct<node:int,hash:bigint>>")
    return scratch.store(wrappers, "wrappers"), hot


def decoded(pivot: str, known: dict[str, list]) -> list:
    """A pivot tree from its text; the last thousand are remembered."""
    if pivot not in known:
        if len(known) >= 1000:
            known.clear()
        known[pivot] = json.loads(pivot)
    return known[pivot]


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars, rule. Intermediate tables go with ``clear_scratch``."""
    wrappers, hot = induce(pages, Scratch(pages.sparkSession, "pages"))
    hosted = _in_parts(_with_host(pages).select("page_id", "url", "html", "host_"), hot)
    joined = hosted.join(_spread(wrappers), ["host_", "part_"], "left").select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html", "pivot", "content", "template")

    def start():
        pivots: dict[str, list] = {}

        def work(c):
            found = []
            for page, pivot, content, template in zip(*(c[k] for k in ("html", "pivot", "content", "template"))):
                tree = decoded(pivot, pivots) if pivot is not None else None
                found.append(extract(page, tree, content or [], frozenset((t["node"], t["hash"]) for t in template or ())))
            texts, rules = [t for t, _ in found], [r for _, r in found]
            return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts], "rule": rules}
        return work

    return map_columns(joined, start, "page_id bigint, url string, text string, n_chars bigint, rule string")
