"""Main text of web pages, with templates found per site.

Every page is read into a tree; the subtrees of its block elements are hashed,
and Spark counts on how many pages of a host each hash occurs, pages of the same
main text as one. What recurs on many pages of its host is template and is deleted, as is what the markup itself
declares to be no article: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. Inside an article plain paragraphs,
headings and list items, and the containers that hold them, are never deleted for
recurring: articles do quote each other. Neither is a subtree that holds most of the page's text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, texts_of
from quire.session import cut_lineage

#: A subtree is template if it is on at least so many pages of its host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.1

# Element names by their role in the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template tfoot th thead title tr ul".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th tr figcaption caption".split())
CUT = frozenset("head title script style noscript template nav footer aside form iframe object svg canvas select button textarea dialog menu xmp".split())
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead title tr noscript template".split())
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
SCOPE = frozenset("table td th caption button object template html body article aside nav section div".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar "
    "masthead footer cookie cookies consent gdpr notice notices newsletter subscribe popup modal overlay share sharing social related recommended widget pagination "
    "pager toolbar login signup".split()
)
OUTER_WORDS = frozenset("header head top alert search copyright legal".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies reply disqus discussion".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[a-z0-9]+")


class Page:
    """The tree of a page: parallel lists by element, and the text pieces in order."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.words, self.role, self.hidden = ["#root"], [-1], [frozenset()], [""], [False]
        #: (element, text); element -1 is a break between blocks.
        self.pieces: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, open_, at = [0], Counter(), 0
        while True:
            m = _TAG.search(source, at)
            self._text(stack[-1], source[at : m.start() if m else len(source)])
            if m is None:
                return
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if open_[name] and (name in BLOCK or self._inline_open(stack, name)):
                    self._close(stack, open_, name)
                continue
            if name in ENDS_P and open_["p"]:
                self._close_within(stack, open_, ("p",), SCOPE)
            elif name in SIBLINGS and any(open_[s] for s in SIBLINGS[name][0]):
                self._close_within(stack, open_, *SIBLINGS[name])
            self._open(stack, open_, name, m[3] or "")
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                self._text(stack[-1], source[at : end.start() if end else len(source)])
                at = end.start() if end else len(source)
            elif name in VOID:
                stack.pop()
                open_[name] -= 1

    def _text(self, node: int, text: str) -> None:
        if text:
            self.pieces.append((node, entities.unescape(text)))

    def _open(self, stack: list[int], open_: Counter, name: str, attributes: str) -> None:
        words, role, hidden = frozenset(), "", False
        if "=" in attributes or "hidden" in attributes:
            for key, a, b, c, bare in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id"):
                    words |= frozenset(_WORD.findall(value))
                elif key == "role":
                    role = value.strip()
                elif bare or key == "style" and re.search(r"display\s*:\s*none", value) or key == "aria-hidden" and value == "true":
                    hidden = True
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.words.append(words)
        self.role.append(role)
        self.hidden.append(hidden)
        if name in BLOCK or name == "br":
            self.pieces.append((-1, ""))
        stack.append(len(self.tag) - 1)
        open_[name] += 1

    def _pop(self, stack: list[int], open_: Counter) -> str:
        name = self.tag[stack.pop()]
        open_[name] -= 1
        if name in BLOCK:
            self.pieces.append((-1, ""))
        return name

    def _close(self, stack: list[int], open_: Counter, name: str) -> None:
        while self._pop(stack, open_) != name:
            pass

    def _close_within(self, stack: list[int], open_: Counter, names: tuple[str, ...], limits) -> None:
        for k in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[k]]
            if name in names:
                while len(stack) > k:
                    self._pop(stack, open_)
                return
            if name in limits:
                return

    def _inline_open(self, stack: list[int], name: str) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == name:
                return True
            if self.tag[stack[k]] in BLOCK:
                return False
        return False

    def lengths(self) -> list[int]:
        """Characters of text, white space aside, below every element."""
        total = [0] * len(self.tag)
        for node, text in self.pieces:
            if node >= 0:
                total[node] += len(text) - text.count(" ") - text.count("\n")
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return total

    def hashes(self) -> list[int]:
        """A hash of every element's subtree: names, class words and texts in order."""
        parts: list[list[str]] = [[t, *sorted(w)] for t, w in zip(self.tag, self.words)]
        order: list[tuple[int, str]] = [(n, " ".join(t.split())) for n, t in self.pieces if n >= 0]
        for node, text in order:
            parts[node].append(text)
        out = [0] * len(self.tag)
        for i in range(len(out) - 1, -1, -1):
            out[i] = xxhash.xxh3_64_intdigest("\0".join(parts[i])) >> 1
            if i:
                parts[self.parent[i]].append(str(out[i]))
        return out

    def regions(self) -> tuple[list[bool], list[bool]]:
        """Per element: whether it is in the main part, and whether the markup says that it isn't article text."""
        n = len(self.tag)
        main = [i for i in range(n) if self.tag[i] == "article" and not self.words[i] & COMMENT_WORDS]
        main = main or [i for i in range(n) if self.tag[i] == "main" or self.role[i] == "main"]
        holds = set()
        for i in main:
            while i > 0 and i not in holds:
                holds.add(i)
                i = self.parent[i]
        roots, inside, cut = set(main), [not main], [False]
        for i in range(1, n):
            p = self.parent[i]
            inside.append(inside[p] or i in roots)
            tag, words = self.tag[i], self.words[i]
            cut.append(
                cut[p] or tag in CUT or self.hidden[i] or bool(words & COMMENT_WORDS and tag not in ("body", "html")) and i not in holds
                or i not in holds and tag not in ("body", "html") and (
                    tag == "header" and (not inside[i] or not main) or self.role[i] in CUT_ROLES or bool(words & CUT_WORDS)
                    or bool(words & OUTER_WORDS) and (not inside[i] or not main)
                )
            )
        return inside, cut

    def template_candidates(self) -> dict[int, int]:
        """Element -> hash of those that recurring could delete."""
        inside, cut = self.regions()
        length, hashed = self.lengths(), self.hashes()
        marked = any(t == "article" or t == "main" for t in self.tag)
        most = max(length[0], 1)
        flow = [marked and inside[i] and not cut[i] and self.tag[i] in FLOW and length[i] > 0 for i in range(len(self.tag))]
        for i in range(len(flow) - 1, 0, -1):
            flow[self.parent[i]] = flow[self.parent[i]] or flow[i]
        return {
            i: hashed[i]
            for i in range(1, len(self.tag))
            if self.tag[i] in BLOCK and self.tag[i] not in ("html", "body", "head", "article", "main") and length[i]
            and 2 * length[i] <= most and not (marked and inside[i] and (flow[i] or self.tag[i] in FLOW))
        }

    def text(self, recurring: frozenset[int] = frozenset()) -> str:
        """The main text: blocks in page order, joined by one space."""
        inside, cut = self.regions()
        template = [i for i, h in self.template_candidates().items() if h in recurring] if recurring else []
        found = self._join(inside, cut, template)
        return found if found or not template else self._join(inside, cut, [])

    def _join(self, inside: list[bool], cut: list[bool], template: list[int]) -> str:
        gone = list(cut)
        for i in template:
            gone[i] = True
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parent[i]]
        blocks, own = [], []
        for node, text in (*self.pieces, (-1, "")):
            if node < 0:
                if block := " ".join("".join(own).split()):
                    blocks.append(block)
                own = []
            elif inside[node] and not gone[node]:
                own.append(text)
        return " ".join(blocks)


def host_of(url: str) -> Column:
    """The host in lower case; a null or odd address has the empty host."""
    return F.coalesce(F.lower(F.try_parse_url(F.col(url).cast("string"), F.lit("HOST"))), F.lit(""))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, html: str = "html", url: str = "url") -> DataFrame:
    """host and the hashes of its template subtrees.

    Pages of a host with the same main text (repeated rows, mirrors, variants of an
    address) are copies and count as one page, so an article isn't taken for a
    template because it has copies. A page gives each of its hashes once; they are
    made distinct and counted per host with partial sums, so neither a large host nor a subtree on all its pages gathers in a
    task. Since a template is on a share of its host's pages, a host has at most
    as many as a page has subtrees on average, divided by that share.
    """

    def hashes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        host, content, found = [], [], []
        for h, source in zip(batch.column("_host").to_pylist(), texts_of(batch.column("_html"))):
            page = Page(source)
            own = {-1, *page.template_candidates().values()}
            host += [h] * len(own)
            content += [xxhash.xxh3_64_intdigest(page.text().encode("utf-8", "surrogatepass")) >> 1] * len(own)
            found += own
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(content, pa.int64()), pa.array(found, pa.int64())], names=["host", "content", "hash"])

    counted = cut_lineage(
        map_batches(pages.select(host_of(url).alias("_host"), F.col(html).cast("string").alias("_html")), hashes, "host string, content bigint, hash bigint")
        .distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(f"n >= {least_pages}")
    )
    totals = counted.where("hash = -1").select("host", F.col("n").alias("pages"))
    return (
        counted.where("hash >= 0").join(totals, "host").where(F.col("n") >= F.lit(least_share) * F.col("pages"))
        .groupBy("host").agg(F.collect_list("hash").alias("recurring"))
    )


def extract_text(
    pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """``keep`` columns and ``text``, the main text of the whole page (empty if there is none or html is null).

    Every row gives a row; for the templates of a host, pages of the same main text
    count as one, repeated rows too. Pages without a host count as one host. Broken markup is read as
    browsers do: ends that are missing are implied, ends without a start are
    ignored. Other columns are ignored; an empty table gives an empty one.
    """
    templates = cut_lineage(site_templates(pages, least_pages, least_share, html, url)).withColumnRenamed("host", "_host")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    rows = pages.select(*keep, host_of(url).alias("_host"), F.col(html).cast("string").alias("_html")).join(templates, "_host", "left")

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset[int]] = {}
        out = []
        for host, source, i in zip(batch.column("_host").to_pylist(), texts_of(batch.column("_html")), range(batch.num_rows)):
            if host not in known:
                known[host] = frozenset(batch.column("recurring")[i].as_py() or ())
            out.append(Page(source).text(known[host]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "text"])

    return map_batches(rows.select(*keep, "_host", "_html", "recurring"), extract, f"{kinds}, text string")
