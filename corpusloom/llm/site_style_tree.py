"""HTML extraction by a site style tree.

Every page is read as a tree of elements. Pages of one host are merged: elements with the same path of tags, classes and
ids are one node of the host's tree, and pages that say the same count once. For a node that m pages have,

* its presentation importance is the entropy, to the base m, of the sequences of children that it has on them,
* its content importance is one less the mean entropy, to the base m, of what its blocks say: a text that n of the pages
  have at the node has the entropy log n / log m, so what all pages repeat is worth nothing and what one page says is
  worth one.

A block's importance is that of its node's content, or that blended with the presentation of the node above, which counts
the more the more variants it has (GAMMA), whichever is larger: the entropy of a few variants falls with the number of
pages, and an article of which every page has its own must not go with it. Blocks below LEAST go from every page; of the
rest, the article is the text. What HTML itself says
of an element (navigation, footer, form, script and the like), and classes, ids and roles that name nothing but such
parts, are taken at their word, since adverts and readers' comments differ from page to page as articles do. Only counts
are merged, so a host with very many pages is nothing special.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, lean, slices, stored, tidy
from corpusloom.llm.url_markov import host_of

#: What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NO_TEXT = frozenset("script style noscript template iframe object svg math head title canvas audio video".split())
NOISE_TAGS = frozenset("nav footer aside form button select textarea input label menu dialog fieldset".split())
#: Words by which sites name what is not the article, and words that say nothing beside them.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies login signin signup search form "
    "copyright legal disclaimer pagination pager toolbar skip complementary contentinfo".split()
)
PLAIN_NAMES = frozenset("site page top bottom left right main global primary secondary mobile js list box block bar wrap wrapper container inner outer area section item items slot link links panel post posts".split())
#: Of these, the words that say nothing inside an article, where a header, a section or a legal notice belongs to the text.
OUTSIDE_NAMES = frozenset("header masthead banner menu menubar legal disclaimer copyright form search notice notices alert side toolbar nav navigation".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of the same group, as far as the nearest of the others named.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SECTIONS = frozenset("article section div main body td li blockquote nav footer aside header form".split())
NAME = re.compile(r"[a-z]+").findall
#: Importance below which a block goes, how fast presentation gains on content with its variants, pages from which a host's
#: own counts tell, and low nodes that are broadcast.
LEAST, GAMMA, ENOUGH, FEW = 0.3, 0.9, 8, 200_000

#: How a comment, a tag or another declaration begins.
OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
#: What a tag holds after its name, up to its end outside quotes.
INSIDE = re.compile(r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose inside is not markup, up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe".split())


def key_of(text: str, above: int = 0) -> int:
    """A signed 64-bit digest of a text under the node ``above``."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, key=above.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def names_noise(names: str, article: bool = False) -> bool:
    """Whether one of the names says that this is not the article: all of its words do or are plain, and one does.

    Inside an article only names of what is put into articles count, such as adverts, links to share and readers' comments.
    """
    said = NOISE_NAMES - OUTSIDE_NAMES if article else NOISE_NAMES
    for name in names.split():
        words = NAME(name)
        if not said.isdisjoint(words) and all(w in said or w in PLAIN_NAMES for w in words):
            return True
    return False


class Reader:
    """Blocks of a page: (node, noise, in article, text), in page order, and the children of its nodes. What isn't markup is
    text. Work grows with the length of the page, however deep or broken it is."""

    def __init__(self):
        self.open: list[tuple[str, int, bool, bool, bool]] = []  # tag, node, noise, in article, without text
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.open_blocks: list[int] = []
        self.open_sections: list[int] = []
        self.blocks: list[tuple[int, bool, bool, str]] = []
        self.children: dict[int, list[str]] = {}  # one instance after the other
        self.above: dict[int, int] = {}
        self.part: list[str] = []
        self.keys: dict[tuple[int, str], int] = {}

    def flush(self) -> None:
        if self.part:
            text = " ".join("".join(self.part).split())
            self.part = []
            if text:
                at = self.open[self.open_blocks[-1]] if self.open_blocks else None
                self.blocks.append((at[1], self.open[-1][2], at[3], text) if at else (0, bool(self.open and self.open[-1][2]), False, text))

    def pop_to(self, i: int) -> None:
        if self.open_blocks and self.open_blocks[-1] >= i:
            self.flush()
        while len(self.open) > i:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            for held in (self.open_blocks, self.open_sections):
                if held and held[-1] == len(self.open):
                    held.pop()

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def feed(self, html: str) -> None:
        at, end, last, quotes = 0, len(html), html.rfind(">"), True
        while at < end:
            token = OPENING.search(html, at)
            if token is None or token.start() > last and token[0] != "<!--":
                self.data(html[at:])
                return
            if token.start() > at:
                self.data(html[at : token.start()])
            if token[0] == "<!--":
                close = html.find("-->", token.end())
                at = close + 3 if close >= 0 else end
                continue
            if token[2] is None:
                at = html.find(">", token.end()) + 1
                continue
            inside = INSIDE.match(html, token.end()) if quotes else None
            if inside is None:  # a quote that nothing ends: from here on tags end at the next bracket
                quotes = False
                close = html.find(">", token.end())
                attributes, at = html[token.end() : close], close + 1
            else:
                attributes, at = inside[1], inside.end()
            tag = token[2].lower()
            if token[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, attributes)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                bracket = html.find(">", close.end()) if close else -1
                at = bracket + 1 if bracket >= 0 else end
                self.end_tag(tag)
            elif attributes.endswith("/") and tag in ("svg", "math"):
                self.end_tag(tag)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self.part.append(" ")
            elif tag == "hr":
                self.flush()
            return
        block = tag in BLOCK
        if block:
            self.flush()
            # a block ends an open paragraph, with what is open inside it
            if (p := self.nearest(("p",))) > (self.open_sections[-1] if self.open_sections else -1):
                self.pop_to(p)
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            if (i := self.nearest(same)) > self.nearest(stop):
                self.pop_to(i)
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        above = self.open[-1] if self.open else ("", 0, False, False, False)
        article = above[3] or tag in ("article", "main") or found.get("role") == "main"
        noise = above[2] or tag in NOISE_TAGS or (tag == "header" and not above[3]) or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        if not noise and tag not in ("html", "body", "main") and not (article and tag in HEADINGS):
            noise = names_noise(names, above[3])
        node = above[1]
        if block:
            label = ".".join([tag, *sorted(names.split())])
            self.children.setdefault(node, []).append(label)
            if (node := self.keys.get((above[1], label), 0)) == 0:
                node = self.keys[above[1], label] = key_of(label, above[1])
                self.above[node] = above[1]
            self.children.setdefault(node, []).append("<")  # another instance begins
            self.open_blocks.append(len(self.open))
        if tag in SECTIONS:
            self.open_sections.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, node, noise, article, above[4] or tag in NO_TEXT))

    def end_tag(self, tag: str) -> None:
        if tag in VOID or not self.at.get(tag):
            return
        i = self.at[tag][-1]
        if tag in BLOCK or not self.open_blocks or self.open_blocks[-1] < i:
            self.pop_to(i)  # an inline end doesn't end a block

    def data(self, text: str) -> None:
        if not (self.open and self.open[-1][4]):
            self.part.append(unescape(text) if "&" in text else text)


def read(html: str | None) -> Reader:
    """A page that has been read; it has no blocks if it is null or empty."""
    reader = Reader()
    if html:
        reader.feed(html)
        reader.flush()
    return reader


def main_text(blocks: list[tuple[int, bool, bool, str]], low: set[int]) -> str:
    """The article's blocks, or without an article all, but for noise and nodes of low importance; joined by a blank line.

    An article, or a page without one, of which only nodes of low importance are there stays whole.
    """
    clean = [b for b in blocks if not b[1]]
    keep = [b for b in clean if b[0] not in low]
    article = [b[3] for b in keep if b[2]] or [b[3] for b in clean if b[2]]
    return "\n\n".join(article or [b[3] for b in keep] or [b[3] for b in clean])


def low_nodes(pages: DataFrame) -> DataFrame:
    """(host, low): for each host the nodes of low importance. ``pages`` has (host, html).

    Pages with the same contents at the same nodes count once a host, and once for all hosts together. From ENOUGH pages
    with a node on a host's own counts tell; else those of all hosts together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, nodes, aboves, kinds, values, whole = [], [], [], [], [], []
            for i, html in enumerate(batch.column("text").to_pylist()):
                reader = read(html)
                said: dict[int, set[int]] = {}
                for node, noise, _, text in reader.blocks:
                    if not noise:
                        said.setdefault(node, set()).add(key_of(text))
                if not said:
                    continue
                page = key_of(repr(sorted((node, sorted(texts)) for node, texts in said.items())))
                upper = {reader.above.get(node, 0) for node in said}
                found = [(node, reader.above.get(node, 0), 0, text) for node, texts in said.items() for text in texts]
                found += [(node, 0, 1, key_of("/".join(reader.children.get(node, [])))) for node in upper]
                rows += [i] * len(found)
                whole += [page] * len(found)
                for held, got in zip((nodes, aboves, kinds, values), zip(*found, strict=True), strict=True):
                    held += got
            if rows:
                numbers = [pa.array(x, pa.int64()) for x in (nodes, aboves, kinds, values, whole)]
                yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(rows)), *numbers], names=["host", "node", "above", "kind", "value", "page"])

    found = pages.select("host", F.col("html").alias("text")).mapInArrow(tidy(run), "host string, node bigint, above bigint, kind bigint, value bigint, page bigint")
    said = stored(found.distinct(), "nodes")

    def importance(by: list[str], rows: DataFrame) -> DataFrame:
        """(by, node, pages, importance) of the nodes with blocks; ``rows`` has a row for each page, node and value."""
        # a page says several things at one node, and has one sequence of its children
        pages_of = rows.select(*by, "node", "kind", "page").distinct().groupBy(*by, "node", "kind").agg(F.count("*").alias("pages"))
        values = rows.groupBy(*by, "node", "kind", "value").agg(F.count("*").alias("n"), F.min("above").alias("above"))
        sums = values.groupBy(*by, "node", "kind").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("variants"), F.min("above").alias("above"))
        of = sums.join(pages_of, [*by, "node", "kind"]).withColumn("base", F.log(F.greatest("pages", F.lit(2))))
        # content: the mean of log n / log m over all that is said; presentation: the entropy of the variants
        content = of.where("kind = 0").select(*by, "node", "above", "pages", (1 - F.col("s") / F.col("all") / F.col("base")).alias("content"))
        style = of.where("kind = 1").select(*by, F.col("node").alias("above"), "variants", ((F.log("all") - F.col("s") / F.col("all")) / F.col("base")).alias("style"))
        weight = F.pow(F.lit(GAMMA), F.col("variants"))
        both = content.join(style, [*by, "above"], "left")
        return both.select(*by, "node", "pages", F.greatest("content", (1 - weight) * F.col("style") + weight * F.col("content")).alias("importance"))

    own = importance(["host"], said)
    everywhere = importance([], said.select("node", "above", "kind", "value", "page").distinct())
    anywhere = everywhere.where(f"pages >= {ENOUGH} and importance < {LEAST}").select("node", F.lit(True).alias("anywhere"))
    low = own.join(anywhere, "node", "left").where(F.when(F.col("pages") >= ENOUGH, F.col("importance") < LEAST).otherwise(F.coalesce("anywhere", F.lit(False))))
    out = stored(low.groupBy("host").agg(F.collect_set("node").alias("low")), "low")
    discard(said)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    text is the article's blocks in page order, white space inside a block turned into one space, joined by a blank line;
    empty if there are none, as for a null or empty page. n_chars counts its code points. Broken markup is read as
    browsers do. A null URL counts as the empty host. Repeated rows give a row each; other columns are left out. The
    pages themselves are shuffled only if hosts have more than FEW low nodes together.
    """
    host = host_of(F.col(url_col))
    base = lean(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = low_nodes(base)
    few = (low.agg(F.sum(F.size("low") + 1)).first()[0] or 0) <= FEW
    joined = base.join(F.broadcast(low) if few else low.hint("merge"), "host", "left").select("page_id", "url", F.col("html").alias("text"), "low")
    kind = base.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [main_text(read(h).blocks, set(low or ())) for h, low in zip(batch.column("text").to_pylist(), batch.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(tidy(run), f"page_id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"page_id": id_col, "url": url_col})
