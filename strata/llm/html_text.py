"""HTML main text: page containers are scored, hosts vote on generalised paths, winning paths extract the text."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import slices, stored, table
from strata.llm.url_filter import url_parts

#: Runs are possessive: what one has taken is not given back, so a tag that never ends costs its length, not the square.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_CLASS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose text is not read, and those that hold page furniture (fixed values).
RAW = frozenset("script style noscript template textarea title iframe svg select datalist xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside form menu dialog button head".split())
#: Words of class, id and role names that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent notice gdpr popup modal overlay comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget contentinfo complementary".split())
#: What may stand beside a mark in the name of furniture inside an article (fixed values).
PLAIN = frozenset("area bar block box btn button buttons container footer header icon icons inner item items link links list outer post posts row section wrap wrapper".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("body main article section div td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, back to the nearest one of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ENDS_P = BLOCKS - {"br", "body", "html", "td", "tr", "tbody", "thead", "tfoot", "caption"}


class Page:
    """The blocks of a page in order, each with its container; containers by parent and generalised path."""

    def __init__(self, source: str, marks: frozenset[str] = MARKS):
        self.parent, self.path, self.tag = [-1], ["body"], ["body"]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._read(source, marks)

    def _read(self, source: str, marks: frozenset[str]) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container, furniture
        opened: Counter[str] = Counter()  # tags on the stack, so that none is looked for in vain
        text: list[str] = []
        linked, here, hidden, anchors = 0, 0, False, 0

        def flush() -> None:
            nonlocal linked
            if text:
                if words := " ".join("".join(text).split()):
                    self.blocks.append((here, words, linked))
                text.clear()
            linked = 0

        def put(raw: str) -> None:
            nonlocal linked
            if not hidden:
                plain = entities.unescape(raw) if "&" in raw else raw
                text.append(plain)
                linked += len(plain) if anchors else 0

        def close(upto: int) -> None:
            nonlocal here, hidden, anchors
            if any(t in BLOCKS for t, _, _ in stack[upto:]):
                flush()
            opened.subtract(t for t, _, _ in stack[upto:])
            del stack[upto:]
            here, hidden = (stack[-1][1], stack[-1][2]) if stack else (0, False)
            anchors = opened["a"]

        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                put(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if m[5] and not m[0].endswith(">"):
                break  # cut off inside a tag
            if tag in RAW and not closing:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if closing:
                found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if opened[tag] > 0 else None
                if found is not None:
                    close(found)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in _ENDS_P:
                found = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None) if opened["p"] > 0 else None
                if found is not None:
                    close(found)
            if tag in _ENDS:
                ended, roof = _ENDS[tag]
                for k in range(len(stack) - 1, -1, -1) if any(opened[t] > 0 for t in ended) else ():
                    if stack[k][0] in roof:
                        break
                    if stack[k][0] in ended:
                        close(k)
                        break
            if tag in BLOCKS:
                flush()
            if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
                continue
            names, marked = [], False
            if tag in CONTAINERS or tag in BLOCKS:
                names = [_WORD.findall(w) for _, a, b, c in _CLASS.findall(rest) for w in (a or b or c).lower().split()]
            inside = opened["article"] > 0 or opened["main"] > 0
            # Inside an article a name must be a mark's alone: `related-posts` is, `related-work` and `share-price` are not.
            marked = any(not marks.isdisjoint(w) and (not inside or all(x in marks or x in PLAIN for x in w)) for w in names)
            drop = hidden or tag in FURNITURE or (tag == "header" and not inside) or (tag not in ("html", "body", "main", "article") and marked) or (tag == "article" and any(not {"comment", "comments"}.isdisjoint(w) for w in names))
            if tag in CONTAINERS and tag != "body":
                first = next((w for w in _CLASS.findall(rest) if w[0].lower() == "class"), None)
                kind = ".".join(sorted(set(_WORD.findall((first[1] or first[2] or first[3]).lower())))) if first else ""
                self.parent.append(here)
                above = self.path[here]
                if len(above) > 1000:  # so deep that its digest stands for it: paths stay short, and equal where they were
                    above = hashlib.md5(above.encode()).hexdigest()
                self.path.append(f"{above}>{tag}{'.' + kind if kind else ''}")
                self.tag.append(tag)
                here = len(self.parent) - 1
            hidden = drop
            stack.append((tag, here, hidden))
            opened[tag] += 1
            anchors = opened["a"]
        else:
            put(source[at:])
        flush()

    def best(self) -> tuple[str, int] | None:
        """The path of the container that holds the main text, and how much of it: of those with most of the page's
        unlinked text the deepest, then up to an article or main around it, or past parents that add little."""
        mass = [0] * len(self.parent)
        for node, text, linked in self.blocks:
            mass[node] += max(0, len(text) - linked)
        for node in range(len(mass) - 1, 0, -1):  # parents come before their children
            mass[self.parent[node]] += mass[node]
        if not mass[0]:
            return None
        depth = [0] * len(mass)
        for k in range(1, len(mass)):
            depth[k] = depth[self.parent[k]] + 1
        node = max((k for k in range(len(mass)) if mass[k] >= 0.6 * mass[0]), key=lambda k: (depth[k], mass[k]))
        above, k = node, node
        while k >= 0:
            if self.tag[k] in ("article", "main"):
                above = k
                break
            k = self.parent[k]
        if above == node and self.tag[node] not in ("article", "main"):
            while self.parent[above] > 0 and mass[self.parent[above]] <= 1.1 * mass[above]:
                above = self.parent[above]
            largest = max((k for k in range(len(mass)) if self.tag[k] in ("article", "main")), key=lambda k: mass[k], default=None)
            if largest is not None and mass[largest] >= 0.2 * mass[0]:
                above = largest
        return self.path[above], mass[above]

    def text(self, path: str) -> str:
        """All blocks in containers of this path, in page order, joined by one blank."""
        inside = [False] * len(self.parent)
        for k in range(len(inside)):
            inside[k] = self.path[k] == path or (self.parent[k] >= 0 and inside[self.parent[k]])
        return " ".join(t for node, t, _ in self.blocks if inside[node])


def read_page(source: str | None) -> Page:
    """The page; if its furniture leaves nothing, marks in names are not minded."""
    page = Page(source or "")
    return page if page.blocks or not source else Page(source, frozenset())


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", broadcast_hosts: int = 100_000, salt_pages: int = 100_000) -> DataFrame:
    """Main text of every page: key, url, text, n_chars (code points).

    Each page nominates the generalised path (tags and class names without digits) of its best container; in Spark the
    paths of a host are counted, and the one with most pages wins (ties: most text, then the path's order). A page is
    extracted by its host's path, or by its own best if it has no text there. One row per input row; null and empty
    html give the empty text; pages without host share one vote; repeated rows count each. Other columns are not read.

    Votes are summed before they are shuffled, so a host with a third of all pages is no burden. Winning paths are
    broadcast up to `broadcast_hosts` hosts; beyond, pages are joined with them by a shuffle in which hosts of more than
    `salt_pages` pages (at most pages / salt_pages, which all tasks know) are split."""
    host = url_parts(F.col(url).cast("string"))[0]
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(html).cast("string").alias("html"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(h, *b) for h, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (b := read_page(x).best())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["host", "path", "mass"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, mass long")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("mass").alias("mass"))
    won = stored(counted.groupBy("host").agg(F.sum("n").alias("pages"), F.min_by("path", F.struct(-F.col("n"), -F.col("mass"), "path")).alias("path")), "host-paths")
    few = won.limit(broadcast_hosts + 1).count() <= broadcast_hosts

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            out = []
            for x, path in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                page = read_page(x)
                text = page.text(path) if path else ""
                if not text and (own := page.best()):
                    text = page.text(own[0])
                out.append(text)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["key", "url", "text", "n_chars"])

    if few:
        joined = rows.join(F.broadcast(won), "host", "left").select("key", "url", "html", "path")
    else:  # salted by host and number, so that neither a host nor its pages meet in one task
        pages_of = F.least(F.ceil(F.col("pages") / salt_pages), F.lit(1 << 16)).cast("int")
        salted = won.select("host", "path", F.explode(F.sequence(F.lit(0), pages_of - 1)).alias("salt"), pages_of.alias("salts"))
        hot = F.broadcast(salted.where("salt = 0 and salts > 1").select("host", "salts"))  # as many as a part of all pages / salt_pages
        spread = rows.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("url", "key"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        joined = spread.join(salted.drop("salts"), ["host", "salt"], "left").select("key", "url", "html", "path")
    return joined.mapInArrow(read, "key long, url string, text string, n_chars long").withColumnRenamed("key", key).withColumnRenamed("url", url)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
