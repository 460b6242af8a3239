"""Main text of a page by a minimum cut.

The page is cut into blocks of text. A classifier gives each block a score (log odds of being content): its capacity from the source (content) or to the sink. Blocks
that follow each other, or that are neighbouring children of one element, are tied by a capacity that is larger the nearer they are in the tree. The minimum cut
labels all blocks of the page at once: a block that scores a little below zero amid the article stays, one that scores a little above amid a menu goes. Blocks whose own
capacity exceeds all their ties are settled first; then blocks with two ties at most are taken out one by one, each leaving its least cost between its neighbours, which is exact and, as the ties of a
page nest, takes out all of them; max-flow (shortest augmenting paths) is for what would be left of other graphs.

The classifier is one logistic regression over what a block looks like (length, links, punctuation, heading, list, position) and over the evidence of the elements around
it: article or main, navigation, aside, header or footer, form, readers' remarks, words of class and id for and against. The nearest element with evidence counts in full, each further
one half as much as the one before. Evidence against is void for an element around the article: for anything (but remarks) that holds a main element, and for a form or a word of class and id
that holds an article or more than four fifths of the page's text. The weights start from PRIOR and are fitted on the blocks of a bounded sample of
pages whose nearest evidence is one-sided; each of them is seen twice, once without its evidence, so that looks alone must do where a page has none.

Null or empty html, or a page without content: empty text. Unclosed, crossed and cut-off markup is read roughly as browsers do; time and memory are linear in the page. Rows that repeat a
page_id, or have none, are rows of their own, in the fit as in the result; equal pages give equal texts. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_sample, map_batches, table

#: Pages that the classifier is fitted on, at most; blocks of each that the driver gets, at most.
SAMPLE, SAMPLE_BLOCKS = 400, 60
#: Capacity between neighbours of one parent; so much of it for each step between their parents in the tree.
TIE, STEP = 1.0, 0.7

# fixed values: elements by what they do to text
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title textarea select option iframe object canvas audio video datalist dialog".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# fixed values: roles and words of class and id
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot bottom sidebar side aside rail widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendation recommendations more comment comments commentlist reply replies respond disqus discussion copyright legal disclaimer pagination pager tags toolbar search".split()
)
GOOD_WORDS = frozenset("article content post entry story main text body prose".split())
REMARKS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SENTENCE = re.compile(r"[.!?;:。！？]")


#: What an element says of the blocks in it.
NONE, ARTICLE, NAV, ASIDE, EDGE, FORM, REMARK, AGAINST, FOR = range(9)
TAGS = {"article": ARTICLE, "main": ARTICLE, "nav": NAV, "menu": NAV, "aside": ASIDE, "header": EDGE, "footer": EDGE, "form": FORM, "fieldset": FORM}
ROLES = {"main": ARTICLE, "article": ARTICLE, "navigation": NAV, "complementary": ASIDE, "banner": EDGE, "contentinfo": EDGE, "search": FORM, "form": FORM}


@dataclass
class Block:
    text: str
    tag: str
    element: int
    linked: int = 0


class Page:
    """Elements of a page in order of their start tags (0: the page) with what they say, and its blocks of text."""

    def __init__(self):
        self.parent, self.depth, self.kind, self.tag = [0], [0], [NONE], [""]
        self.blocks: list[Block] = []

    def add(self, tag: str, kind: int, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.tag.append(tag)
        return len(self.parent) - 1

    def evidence(self) -> list[tuple[float, ...]]:
        """For each element how much each kind of evidence weighs in it."""
        n = len(self.parent)
        size, article, main = [0] * n, [False] * n, [False] * n
        for b in self.blocks:
            size[b.element] += len(b.text)
        for i in range(n - 1, 0, -1):
            up, kind = self.parent[i], self.kind[i]
            size[up] += size[i]
            main[up] = main[up] or main[i] or (kind == ARTICLE and self.tag[i] != "article")
            # an article in an aside or among remarks is a teaser or a remark
            article[up] = article[up] or kind == ARTICLE or (article[i] and kind in (NONE, FORM, AGAINST, FOR))
        none = (0.0,) * 9
        out = [none] * n
        for i in range(1, n):
            kind, before = self.kind[i], out[self.parent[i]]
            if kind == NONE:
                void = True
            elif kind in (ARTICLE, FOR):
                void = before[REMARK] + before[ASIDE] + before[NAV] > 0
            elif kind in (FORM, AGAINST):
                void = main[i] or article[i] or 5 * size[i] > 4 * size[0]
            else:
                void = kind != REMARK and (main[i] or (self.tag[i] == "header" and before[ARTICLE] > 0))
            out[i] = before if void else tuple(0.5 * x + (k == kind) for k, x in enumerate(before))
        return out


def words_say(value: str) -> int:
    """REMARK, AGAINST or FOR by the last known word of each name in a class or an id; NONE if names disagree."""
    said = set()
    for name in value.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if REMARKS.intersection(words):
            return REMARK
        said.add(next((AGAINST if w in BAD_WORDS else FOR for w in reversed(words) if w in BAD_WORDS or w in GOOD_WORDS), NONE))
    said.discard(NONE)
    return said.pop() if len(said) == 1 else NONE


def element_says(tag: str, attributes: str) -> tuple[int, bool]:
    """(kind of evidence, hidden)"""
    kind, gone = TAGS.get(tag, NONE), False
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                said = words_say(value)
                if said == REMARK or kind == NONE or (kind == FOR and said == AGAINST):
                    kind = said
            elif name == "role":
                role = value.strip().lower()
                if role in ROLES or role in BAD_ROLES:
                    kind = REMARK if kind == REMARK else ROLES.get(role, AGAINST)
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", value)):
                gone = True
    return kind, gone


@dataclass
class _Open:
    tag: str
    key: int
    silent: bool


def read_page(page: str) -> Page:
    """Blocks of text in page order, entities decoded, white space made single. Unclosed and crossed elements are closed as browsers would roughly do."""
    out = Page()
    stack = [_Open("", 0, False)]
    opened: Counter[str] = Counter()
    parts, linked = [], 0
    owner: tuple[str, int] | None = None

    def end() -> None:
        nonlocal parts, linked, owner
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.blocks.append(Block(text, *owner, min(linked, len(text))))
        parts, linked, owner = [], 0, None

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def text(raw: str) -> None:
        nonlocal linked, owner
        top = stack[-1]
        if top.silent or not raw:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        if owner is None and not raw.isspace():
            x = next((x for x in reversed(stack) if x.tag in BLOCKS), stack[0])
            owner = (x.tag, x.key)
        parts.append(raw)
        if opened["a"] or opened["button"]:
            linked += len(raw.strip())

    at, n = 0, len(page)
    last_end = page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if lt > last_end and re.match(r"<[a-zA-Z/!?]", page[lt : lt + 2]):  # a tag that the end of the page cuts off
            break
        m = _TOKEN.match(page, lt) if lt < last_end else None
        if m is None:  # a sign, no tag
            text("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in BLOCKS:
            end()
        if closing:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        attributes = m[3] or m[6] or ""
        if tag in VOID:
            continue
        if tag == "p" or tag in HEADINGS or tag in ("li", "dd", "dt", "tr", "td", "th", "option"):  # closes its like, if still open in the same container
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag == "p" and stack[i].tag in HEADINGS) or (tag in HEADINGS and stack[i].tag == "p"):
                    close(i)
                    break
                if stack[i].tag in BLOCKS:
                    break
        kind, gone = element_says(tag, attributes)
        stack.append(_Open(tag, out.add(tag, kind, stack[-1].key), stack[-1].silent or gone or tag in SILENT))
        opened[tag] += 1
        if attributes.rstrip().endswith("/") and tag in ("svg", "path", "script"):
            close(len(stack) - 1)
        elif tag in RAW:
            end_tag = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end_tag.end() if end_tag else n
            close(len(stack) - 1)
    end()
    return out


LOOKS = ["bias", "log_words", "link_share", "marks", "heading", "item", "short", "position"]
EVIDENCE = ["article", "nav", "aside", "edge", "form", "remark", "against", "for"]
FEATURES = [*LOOKS, *EVIDENCE]
#: What the weights are before any page was seen: long, unlinked, punctuated text is content, and so is what stands in an article.
PRIOR = np.array([-2.0, 1.0, -4.0, 1.0, 1.0, -1.0, -0.5, 0.0, 3.0, -4.0, -4.0, -4.0, -3.0, -6.0, -3.0, 1.5])


def features(page: Page) -> np.ndarray:
    """(blocks, FEATURES)"""
    blocks, says = page.blocks, page.evidence()
    out = np.empty((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        out[i] = (1.0, np.log1p(words), b.linked / len(b.text), min(1.0, 10 * len(_SENTENCE.findall(b.text)) / len(b.text)), b.tag in HEADINGS, b.tag in ("li", "td", "th", "dd", "dt"), words < 5, (i + 0.5) / len(blocks), *says[b.element][1:])
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method with a normal prior around PRIOR; both labels count alike. PRIOR itself without both."""
    if not len(y) or y.min() == y.max():
        return PRIOR
    bare = x.copy()
    bare[:, len(LOOKS) :] = 0.0
    x, y = np.concatenate((x, bare)), np.concatenate((y, y))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - ridge * (w - PRIOR)
        h = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 2.0 / np.abs(step).max(initial=1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def ties(page: Page) -> dict[tuple[int, int], float]:
    """Capacities between blocks: next in the page, and next child of the same parent; STEP as much for each step between their parents in the tree (nothing
    once that is below the precision of a capacity)."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    parent, depth = page.parent, page.depth
    ups = [parent[b.element] for b in page.blocks]
    for j, up in enumerate(ups):
        for i in {j - 1, last.get(up, -1)} - {-1}:
            a, b, c = ups[i], up, TIE
            while a != b and c > 1e-15:
                if depth[a] >= depth[b]:
                    a = parent[a]
                else:
                    b = parent[b]
                c *= STEP
            if a == b:
                out[i, j] = c
        last[up] = j
    return out


def min_cut(score: list[float], tie: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source: the labelling with the least sum of cut capacities (ties on equal sums go to the sink)."""
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in tie.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    own = list(score)
    queue = deque(range(n))
    while queue:  # a node that outweighs its ties is settled whatever the others are, and becomes part of its neighbours' own capacity
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, c in near[i].items():
                own[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    # A node with two ties at most is taken out: the least cost it has, given its neighbours' labels, is a tie between them and something on their own capacities. It is set once they are.
    # Ties of a page nest, so this takes out all nodes of a page, each in constant time.
    taken: list[tuple[int, float, list[tuple[int, float]]]] = []
    gone = [x is not None for x in label]
    queue = deque(i for i in range(n) if not gone[i] and len(near[i]) <= 2)
    while queue:
        i = queue.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        ends = list(near[i].items())
        taken.append((i, own[i], ends))
        for j, _ in ends:
            del near[j][i]
        least = lambda *x: min(sum(c for (_, c), k in zip(ends, x, strict=True) if k != v) - own[i] * v for v in (0, 1))  # noqa: B023, E731
        if len(ends) == 1:
            own[ends[0][0]] -= least(1) - least(0)
        elif ends:
            (j, _), (k, _) = ends
            none, first, second, both = least(0, 0), least(1, 0), least(0, 1), least(1, 1)
            c = max(0.0, (first + second - none - both) / 2)
            own[j] -= first - none - c
            own[k] -= second - none - c
            if c > 0:
                near[j][k] = near[k][j] = near[j].get(k, 0.0) + c
        queue.extend(j for j, _ in ends if len(near[j]) <= 2)
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        label = _by_flow(rest, own, near, label)
    for i, capacity, ends in reversed(taken):
        label[i] = capacity + sum(c if label[j] else -c for j, c in ends) > EVEN
    return [bool(x) for x in label]


#: What rounding may make of nothing.
EVEN = 1e-12


def _by_flow(rest: list[int], own: list[float], near: list[dict[int, float]], label: list[bool | None]) -> list[bool | None]:
    """Labels of nodes that all have three ties or more, by maximum flow along shortest augmenting paths."""
    s, t = len(own), len(own) + 1
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {s: {}, t: {}}
    for i in rest:
        a, b = (s, i) if own[i] > 0 else (i, t)
        cap[a][b] = abs(own[i])
        cap[b].setdefault(a, 0.0)
    while True:
        before: dict[int, int] = {s: s}
        queue = deque([s])
        while queue and t not in before:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > EVEN and j not in before:
                    before[j] = i
                    queue.append(j)
        if t not in before:
            break
        path, j = [], t
        while j != s:
            path.append((before[j], j))
            j = before[j]
        flow = min(cap[i][j] for i, j in path)
        for i, j in path:
            cap[i][j] -= flow
            cap[j][i] = cap[j].get(i, 0.0) + flow
    for i in rest:
        label[i] = i in before
    return label


def labelled(page: str | None, weight: np.ndarray) -> list[tuple[str, float, bool]]:
    """(text, score, whether the cut leaves it with the content) for each block."""
    read = read_page(page) if page else Page()
    if not read.blocks:
        return []
    score = (features(read) @ weight).tolist()
    return [(b.text, v, k) for b, v, k in zip(read.blocks, score, min_cut(score, ties(read)), strict=True)]


def main_text(page: str | None, weight: np.ndarray) -> str:
    return "\n".join(text for text, _, kept in labelled(page, weight) if kept)


def seeds(x: np.ndarray) -> np.ndarray:
    """Labels of the blocks that the fit may see: 1 where the nearest evidence is an article, 0 where it is any against, -1 elsewhere."""
    said = x[:, len(LOOKS) :]
    near = said.argmax(axis=1)
    return np.where(said.max(axis=1, initial=0) < 1, -1, np.where(near == 0, 1, np.where(near == EVIDENCE.index("for"), -1, 0)))


def sampled_blocks(sure: list[int], page_id: int) -> list[int]:
    """SAMPLE_BLOCKS of them at most, from all over the page: the first by a hash of their number, which differs by page."""
    return sure if len(sure) <= SAMPLE_BLOCKS else sorted(sorted(sure, key=lambda i: (zlib.crc32(b"%d %d" % (page_id, i)), i))[:SAMPLE_BLOCKS])


def fitted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` pages (the first by a hash of the id), from blocks whose nearest evidence is one-sided, SAMPLE_BLOCKS of a page. A repeated id
    stands for one of its pages (that of the least hash), so rows are bounded as ids are."""
    some = bounded_sample(pages.select(F.col(id_col).cast("long").alias("sample_id")).dropna().distinct(), sample, "sample_id")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).where("html is not null").join(some, F.col("page_id") == F.col("sample_id"))
    own = own.groupBy("page_id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, xs, ys = [], [], []
        for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            read = read_page(page)
            if not read.blocks:
                continue
            x = features(read)
            y = seeds(x)
            for i in sampled_blocks(np.flatnonzero(y >= 0).tolist(), page_id):
                ids.append(page_id)
                xs.append(x[i].tolist())
                ys.append(int(y[i]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["page_id", "x", "y"])

    got = map_batches(own, f, "page_id long, x array<double>, y int").toPandas()
    if not len(got):
        return PRIOR
    got["key"] = got["x"].map(tuple)
    got = got.sort_values(["page_id", "key", "y"], kind="stable")
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy())


def extracted(pages: DataFrame, weight: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for each row of pages. Null or empty html, or a page without content: empty text. Other columns are ignored."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x, weight) for x in batch.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), f, "page_id long, url string, text string")


def op9_min_cut_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fitted(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
