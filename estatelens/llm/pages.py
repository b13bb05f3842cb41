"""Main text of web pages: blocks of text are labelled by a minimum cut.

Method: a page's text is cut into blocks at its block-level elements. A classifier gives each
block the log-odds of being content; its two costs are the capacities of the block's links to
the two terminals. Smoothness edges join a block with the one before it (adjacency) and with
the one before it under the same element or under that element's parent (DOM proximity), the
closer in the tree the stronger. The cut of least capacity, found by maximum flow, separates
content from boilerplate; where two are equally good, undecided blocks are content.

The log-odds have two parts. Text and tag (words, share of links, end of sentence, kind of
element) are weighed by a logistic regression, trained on about SAMPLE_PAGES pages whose own
elements say what is content; its prior is a stated one, which holds where the sample labels
nothing. What elements say by their tags, roles and names (HINTS below) is added to that.

Cases: null and empty pages, pages without text and pages of boilerplate only give an empty
text. Broken pages are read like whole ones: elements that are left open end with the page, a
tag, comment or script that is cut off is no text. Null ids and urls are kept; repeated rows
are pages like others; very long pages are read whole, one row at a time; an empty table gives
no rows. Other columns are kept, whatever they are called, except that `text` and `n_chars`
are replaced. One pass over the pages; nothing is shuffled but the sample.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES = 2000  # the classifier learns from about so many pages; its only bound
LABEL_WEIGHT = 200.0  # what all blocks of a label count against the prior
TEXT_BOUND = 3.0  # of the log-odds that text and tag give
NEAR, SIBLING, COUSIN = 1.0, 0.5, 0.25  # smoothness edges; NEAR is divided by the tree's distance
SCALE = 1000  # capacities are whole numbers

# Names of HTML's elements and what they and common class names say.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist head map math meter noscript object option progress select svg template video".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu search dialog".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
BOILERPLATE_NAMES = frozenset(
    """ad ads adv advert advertisement advertising adverts alert anzeige anzeigen aside banner bottombar breadcrumb breadcrumbs comment comments commentaires comentarios consent
    cookie cookies copyright dialog disclaimer discussion disqus dropdown feedback foot footer form gdpr header kommentar kommentare legal login masthead menu menubar modal nav navbar navigation newsletter
    notice notices notification notifications overlay pager pagination popup promo promoted promotion promotions publicidad publicite related recommended recommendations replies reply respond responses
    search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription toast toolbar topbar topnav werbung widget widgets""".split()
)
CONTENT_NAMES = frozenset("article articlebody articlecontent body content entry main maincontent maintext post prose story text".split())
NOT_THAT = frozenset("has no with without".split())
COMMENT_HEADINGS = frozenset("comments comment discussion responses replies kommentare commentaires comentarios".split())
BOILERPLATE_HINT, HEADER_HINT, CONTENT_HINT, OUTSIDE_HINT = -7.0, -6.0, 4.0, -4.0

WORDS_TO, LINKS_TO = (2, 5, 10, 20, 40), (0.0, 0.34, 0.67)
# The prior of the weights: words (one for each range, and more), share of links, end of a sentence (no, yes),
# kind (paragraph, h1, other heading, list item, cell, other).
PRIOR = np.array([-1.4, -0.9, -0.2, 0.4, 1.0, 1.6] + [0.5, 0.0, -1.0, -2.2] + [-0.3, 0.5] + [0.4, 1.2, 0.3, -0.4, -0.2, -0.3])
OFFSETS = (0, 6, 10, 12)

MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    __slots__ = ("text", "element", "links", "tag")

    def __init__(self, text, element, links, tag):
        self.text, self.element, self.links, self.tag = text, element, links, tag


# --- from a page to its blocks ---------------------------------------------------------------------


def named(attributes: str) -> tuple[bool, bool, bool, bool]:
    """What an element's class, id and role say: boilerplate, header, content; and whether it is hidden."""
    bad = header = good = hidden = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role":
            role = value.strip().lower()
            bad |= role in BOILERPLATE_ROLES
            good |= role in ("main", "article")
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value, re.I))
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        else:
            for name in value.split():
                words = [w.lower() for w in NAME.findall(name)]
                said = [w for i, w in enumerate(words) if not (i and words[i - 1] in NOT_THAT)]
                of_content = any(w in CONTENT_NAMES for w in said)
                of_rest = {w for w in said if w in BOILERPLATE_NAMES}
                header |= of_rest == {"header"} and not of_content
                bad |= bool(of_rest - {"header"})
                good |= of_content and not of_rest
    return bad, header, good and not bad, hidden


class Page:
    """The elements of a page (parent, depth, what they say) and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.says = [-1], [0], ["#"], [(False, False, False, False)]
        self.blocks: list[Block] = []
        self.open = [0]  # elements
        self.texts: list[str] = []
        self.in_link = self.silent = 0
        self.links = 0
        at, end = 0, len(source)
        while at < end:
            m = MARKUP.search(source, at)
            begin = m.start() if m else end
            if begin > at and not self.silent:
                self.add(source[at:begin])
            if not m:
                break
            at = m.end()
            if m[2] is None:
                m = LOOSE.fullmatch(source, begin, at)
                if not m:
                    continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
                continue
            self.start(name, m[3])
            if name in RAW:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = stop.start() if stop else end
                if not stop:
                    self.pop_to(len(self.open) - 1)
        self.flush()

    def add(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.texts.append(text)
        if self.in_link:
            self.links += len("".join(text.split()))

    def flush(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            if text:
                at = self.open[-1]
                while self.tag[at] not in BLOCKS and at:
                    at = self.parent[at]
                self.blocks.append(Block(text, at, self.links, self.tag[at]))
            self.texts = []
        self.links = 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br" or name == "wbr":
            if name == "br" and not self.silent:
                self.texts.append(" ")
            return
        if name in BLOCKS:
            self.flush()
            if name in ENDS_P:
                self.close_open(frozenset(("p",)), frozenset("table td th caption button".split()))
            if name in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
                self.pop_to(len(self.open) - 1)
        if name in CLOSES:
            self.flush()
            self.close_open(*CLOSES[name])
        if name in VOID:
            return
        if name in ("html", "body") and name in (self.tag[e] for e in self.open):
            return
        self.parent.append(self.open[-1])
        self.depth.append(self.depth[self.open[-1]] + 1)
        self.tag.append(name)
        self.says.append(named(attributes) if attributes and name not in ("html", "body") else (False, False, False, False))
        self.open.append(len(self.tag) - 1)
        self.in_link += name == "a"
        self.silent += name in SILENT or name in RAW

    def close_open(self, names: frozenset, scope: frozenset) -> None:
        """Closes what is open of names, as far as an element of scope."""
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag in scope:
                break
            if tag in names:
                found = i
        if found:
            self.pop_to(found)

    def close(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "br" or name == "p":
            self.texts.append(" ")
        block = name in BLOCKS
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[i]]
            if tag == name:
                if block:
                    self.flush()
                self.pop_to(i)
                return
            if (not block and tag in BLOCKS) or (tag in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th")):
                return

    def pop_to(self, i: int) -> None:
        for e in self.open[i:]:
            if self.tag[e] in BLOCKS:
                self.flush()
            self.in_link -= self.tag[e] == "a"
            self.silent -= self.tag[e] in SILENT or self.tag[e] in RAW
        del self.open[i:]

    def hints(self) -> list[float]:
        """For each block, the log-odds that the elements around it give; boilerplate around it outweighs content."""
        n = len(self.tag)
        bad, good, main, article = [0.0] * n, [False] * n, [False] * n, [False] * n
        lead = [False] * n  # elements that a heading calls comments
        for b in self.blocks:
            if b.tag in HEADINGS and not set(re.findall(r"\w+", b.text.lower())) - COMMENT_HEADINGS - {"reader", "readers", "leave", "a", "user"} - set(re.findall(r"\d+", b.text)):
                up = self.parent[b.element]
                lead[up] = self.tag[up] in ("section", "div")
        wide = self.page_wide_forms()
        for e in range(1, n):
            up, tag = self.parent[e], self.tag[e]
            says_bad, says_header, says_good, hidden = self.says[e]
            worst = bad[up]
            inside = article[up] or main[up] or good[up]
            if tag in BOILERPLATE_TAGS or says_bad or hidden or lead[e] or (tag == "form" and e not in wide) or (tag == "article" and article[up]):
                worst = BOILERPLATE_HINT
            elif (tag == "header" or says_header) and not inside:
                worst = min(worst, HEADER_HINT)
            bad[e], good[e] = worst, good[up] or says_good
            main[e], article[e] = main[up] or tag == "main", article[up] or tag == "article"
        marks = []
        for holds in (article, main, good):
            marks.append(any(holds[b.element] and not bad[b.element] for b in self.blocks))
        out = []
        for b in self.blocks:
            e = b.element
            if bad[e]:
                out.append(bad[e])
            elif article[e] or (main[e] and not marks[0]) or (good[e] and not marks[0] and not marks[1]):
                out.append(CONTENT_HINT)
            elif main[e] or good[e] or not any(marks):
                out.append(0.0)
            else:
                out.append(OUTSIDE_HINT)
        return out

    def page_wide_forms(self) -> set[int]:
        """Forms that hold an article, the main part or the first heading: some sites wrap whole pages in one."""
        out = set()
        for e, tag in enumerate(self.tag):
            if tag in ("article", "main", "h1"):
                while e > 0:
                    if self.tag[e] == "form":
                        out.add(e)
                    e = self.parent[e]
        return out

    def edges(self) -> list[tuple[int, int, int]]:
        """Smoothness edges between blocks: adjacency, and the last block under the same element's parent and grandparent."""
        out, seen, above = [], {}, {}
        for i, b in enumerate(self.blocks):
            up = self.parent[b.element]
            top = self.parent[up] if up > 0 else up
            if i:
                out.append((i - 1, i, int(SCALE * NEAR / max(1, self.distance(self.blocks[i - 1].element, b.element)))))
            j = seen.get(up)
            if j is not None and j != i - 1:
                out.append((j, i, int(SCALE * SIBLING)))
            k = above.get(top)
            if k is not None and k != i - 1 and k != j:
                out.append((k, i, int(SCALE * COUSIN)))
            seen[up] = above[top] = i
        return out

    def distance(self, a: int, b: int) -> int:
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


# --- the classifier --------------------------------------------------------------------------------


def features(b: Block) -> tuple[int, int, int, int]:
    words, share = b.text.count(" ") + 1, b.links / max(1, len(b.text) - b.text.count(" "))
    kind = 1 if b.tag == "h1" else 2 if b.tag in HEADINGS else 3 if b.tag in ("li", "dt", "dd") else 4 if b.tag in ("td", "th", "caption") else 0 if b.tag in ("p", "blockquote", "pre") else 5
    return sum(words > n for n in WORDS_TO), sum(share > s for s in LINKS_TO), int(b.text.rstrip("\"'»”’)]")[-1:] in ".!?…:;"), kind


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[float]:
    """The weights, trained on the blocks of about sample_pages pages, drawn by a hash of page_id and url; repeated rows among them count once."""
    n = pages.count()
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    drawn = rows.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(n, 1))) < sample_pages).dropDuplicates(["page_id", "url"])
    counted = drawn.select("html").mapInArrow(labelled_blocks, "words int, links int, sentence int, kind int, content boolean").groupBy("words", "links", "sentence", "kind", "content").count()
    return fit(counted.collect())  # at most 576 rows, whatever the sample


def labelled_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of blocks that the elements around them call content or boilerplate."""
    for batch in batches:
        rows = []
        for source in batch.column("html").to_pylist():
            page = Page(source or "")
            rows += [(*features(b), hint > 0) for b, hint in zip(page.blocks, page.hints(), strict=True) if hint > 0 or hint <= HEADER_HINT]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.bool_())], names=["words", "links", "sentence", "kind", "content"])


def fit(counts) -> list[float]:
    """Newton's method, with its steps halved until they lead down, for a logistic regression with PRIOR as the mean of the weights; each label counts LABEL_WEIGHT in all."""
    w = PRIOR.copy()
    if len({r[4] for r in counts}) < 2:
        return w.tolist()
    x = np.zeros((len(counts), len(PRIOR)))
    for i, r in enumerate(counts):
        x[i, [o + r[j] for j, o in enumerate(OFFSETS)]] = 1
    y = np.array([r[4] for r in counts], float)
    n = np.array([r[5] for r in counts], float)
    for label in (0, 1):
        n[y == label] *= LABEL_WEIGHT / n[y == label].sum()
    loss = lambda w: (n * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))).sum() + ((w - PRIOR) ** 2).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (n * (y - p)) - (w - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if abs(step).max() < 1e-9:
            break
    return np.round(w, 6).tolist()


def log_odds(page: Page, weights: list[float]) -> list[float]:
    out = []
    for b, hint in zip(page.blocks, page.hints(), strict=True):
        text = sum(weights[o + f] for o, f in zip(OFFSETS, features(b), strict=True))
        out.append(hint + max(-TEXT_BOUND, min(TEXT_BOUND, text)))
    return out


# --- the cut ---------------------------------------------------------------------------------------


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labels (content or not) of least cost: gain is what content spares a node (below 0: costs), an edge's weight is paid where its ends differ; of several best labellings, the one with most content.

    Nodes whose gain outweighs all their edges are labelled first, which no best labelling
    contradicts, and their edges are added to their neighbours' gains; maximum flow decides on
    the rest.
    """
    n = len(gain)
    gain, near = list(gain), [[] for _ in range(n)]
    total = [0] * n
    for a, b, w in edges:
        near[a].append((b, w)), near[b].append((a, w))
        total[a] += w
        total[b] += w
    label: list[bool | None] = [None] * n
    queue = [i for i in range(n) if gain[i] >= total[i] or -gain[i] > total[i]]
    while queue:
        i = queue.pop()
        if label[i] is not None:
            continue
        label[i] = gain[i] >= total[i]
        for j, w in near[i]:
            if label[j] is None:
                gain[j] += w if label[i] else -w
                total[j] -= w
                if gain[j] >= total[j] or -gain[j] > total[j]:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        flow = Flow([gain[i] for i in rest], [(place[a], place[b], w) for a, b, w in edges if a in place and b in place])
        for i, content in zip(rest, flow.content(), strict=True):
            label[i] = content
    return label


class Flow:
    """Maximum flow by levels: each round sends blocking flow along shortest ways only."""

    def __init__(self, gain: list[int], edges):
        self.n = len(gain)
        self.source, self.sink = self.n, self.n + 1
        self.out = [[] for _ in range(self.n + 2)]
        self.to, self.left = [], []
        for i, g in enumerate(gain):
            if g > 0:
                self.link(self.source, i, g, 0)
            elif g < 0:
                self.link(i, self.sink, -g, 0)
        for a, b, w in edges:
            self.link(a, b, w, w)
        while self.levels():
            self.block()

    def link(self, a: int, b: int, forth: int, back: int) -> None:
        self.out[a].append(len(self.to)), self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [forth, back]

    def levels(self) -> bool:
        self.level = [-1] * (self.n + 2)
        self.level[self.source] = 0
        queue = [self.source]
        for v in queue:
            for e in self.out[v]:
                if self.left[e] and self.level[self.to[e]] < 0:
                    self.level[self.to[e]] = self.level[v] + 1
                    queue.append(self.to[e])
        return self.level[self.sink] >= 0

    def block(self) -> None:
        next_edge, way, v = [0] * (self.n + 2), [], self.source
        while True:
            if v == self.sink:
                sent = min(self.left[e] for e in way)
                for e in way:
                    self.left[e] -= sent
                    self.left[e ^ 1] += sent
                full = next(i for i, e in enumerate(way) if not self.left[e])
                v = self.to[way[full] ^ 1]
                del way[full:]
                continue
            while next_edge[v] < len(self.out[v]):
                e = self.out[v][next_edge[v]]
                if self.left[e] and self.level[self.to[e]] == self.level[v] + 1:
                    break
                next_edge[v] += 1
            else:
                if v == self.source:
                    return
                self.level[v] = -1
                v = self.to[way.pop() ^ 1]
                continue
            way.append(e)
            v = self.to[e]

    def content(self) -> list[bool]:
        """The side of the cut that can't reach the sink: of all least cuts the one with most content."""
        reach = [False] * (self.n + 2)
        reach[self.sink] = True
        queue = [self.sink]
        for v in queue:
            for e in self.out[v]:
                if self.left[e ^ 1] and not reach[self.to[e]]:
                    reach[self.to[e]] = True
                    queue.append(self.to[e])
        return [not r for r in reach[: self.n]]


def main_text(source: str | None, weights: list[float]) -> str:
    page = Page(source or "")
    if not page.blocks:
        return ""
    keep = minimum_cut([round(SCALE * x) for x in log_odds(page, weights)], page.edges())
    return "\n\n".join(b.text for b, content in zip(page.blocks, keep, strict=True) if content)


def extract_text(pages: DataFrame, weights: list[float]) -> DataFrame:
    """pages with `text` and `n_chars` of their main text, without html."""
    names = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    own = [f"__aside_{i}" for i in range(len(names))]
    rows = pages.select(F.col("html").cast("string").alias("__html"), *(F.col("`" + c.replace("`", "``") + "`").alias(o) for c, o in zip(names, own, strict=True)))
    schema = T.StructType([*(rows.schema[o] for o in own), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s, weights) for s in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    return rows.mapInArrow(extract, schema).toDF(*names, "text", "n_chars")


def page_texts(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, url, text, n_chars."""
    return extract_text(pages.select("page_id", "url", "html"), learn(pages))
