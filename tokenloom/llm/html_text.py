"""Main text of web pages by tree scoring.

A page's tags are read into a light tree. Menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and hidden parts are taken out by tag, role, or the words of class and id. A part
that only its class or id marks stays if it holds a main element or all of the page's articles outside
such parts; one named as a header also if it holds the page's only h1. On pages without any of these, a part
stays that holds most of the page's paragraphs by their points. Every
block that holds text gives points for its length and its commas, less the share of its text that is
links; they go to its parent in full and to further ancestors in falling parts. The container with
the most points, discounted by its own link density, is the best; if it lies in an article or main
element, that is taken. Its siblings are kept if they score well or read like prose or headings.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.llm.common import map_runs, texts_of

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+|\d+")
_SMALL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
# Elements that an opening tag of the same group ends.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
KEEPS_OPEN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}}
AROUND_TABLE = frozenset({"table"})
# Lists and tables pass points on to what holds them.
ROWS = frozenset("ul ol dl table thead tbody tfoot tr".split())
DROP = frozenset(
    "nav header footer aside form script style noscript iframe svg button select textarea template dialog title head "
    "menu object canvas audio video fieldset input map".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of a class or an id that mark parts that are no article.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination paywall popup promo promotion recommended related replies respond share sharing sidebar sitemap "
    "skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
# Of those, words of parts that may hold the article's own title, and words of reader comments.
TITLE_WORDS = frozenset({"header", "masthead", "banner"})
COMMENT_WORDS = frozenset({"comment", "comments", "disqus", "replies", "respond"})
# Words that make what follows a statement about the layout: no-sidebar, has-menu.
LAYOUT = frozenset("no not has have with without elementor".split())
NEVER = frozenset({"html", "body", "article", "main"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b", re.IGNORECASE)


class Page:
    """Nodes in page order, each with its parent and last descendant, and the texts between tags."""

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.dropped, self.marked = ["#"], [-1], [0], [False], [0]
        self.texts: list[tuple[int, int, bool, str]] = []  # node, block, in a link, text
        self.stack, self.blocks, self.links = [0], [0], 0
        self.read(source)
        while self.stack:
            self.close()
        self.drop_marked()

    def read(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.end(name)
                continue
            self.start(name, m[3] or "")
            if name in RAW:
                # Whatever is inside is no tag, up to the element's own end.
                found = _raw_end(name).search(source, at)
                at = found.start() if found else len(source)
        if at < len(source):
            self.text(source[at:])

    def text(self, raw: str) -> None:
        node = self.stack[-1]
        if not self.dropped[node]:
            self.texts.append((node, self.blocks[-1], self.links > 0, html.unescape(raw)))

    def close(self) -> None:
        node = self.stack.pop()
        self.last[node] = len(self.tag) - 1
        if self.tag[node] == "a":
            self.links -= 1
        if self.blocks[-1] == node:
            self.blocks.pop()

    def close_to(self, names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        """End the innermost open element of ``names`` and all inside it, unless a barrier is nearer."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag in names:
                while len(self.stack) > depth:
                    self.close()
                return
            if tag in barrier:
                return

    def end(self, name: str) -> None:
        if name == "br":
            self.texts.append((self.stack[-1], self.blocks[-1], False, " "))
            return
        self.close_to({name}, NEVER - {name} if name in INLINE or name == "p" else frozenset())

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.close_to({"p"}, frozenset({"table", "button", "td", "th", "li"}) | NEVER)
        if name in ENDS:
            self.close_to(ENDS[name], KEEPS_OPEN.get(name, AROUND_TABLE))
            if name in ("tr", "tbody"):  # the cell is closed, now the row around it
                self.close_to({"tr"}, AROUND_TABLE)
        parent = self.stack[-1]
        if name in VOID:
            if name in ("br", "hr") and not self.dropped[parent]:
                self.texts.append((parent, self.blocks[-1], False, " "))
            return
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(parent)
        self.last.append(node)
        self.marked.append(0)
        self.dropped.append(self.dropped[parent] or self.unwanted(name, attributes))
        if not self.dropped[node] and (name not in NEVER or name == "article"):
            mark = self.named_so(attributes)
            # An article is one, whatever it is called, but for reader comments.
            self.marked[node] = mark if name != "article" or mark == 3 else 0
        self.stack.append(node)
        if name == "a":
            self.links += 1
        if name not in INLINE:
            self.blocks.append(node)

    def unwanted(self, name: str, attributes: str) -> bool:
        if name in DROP:
            # An article's own header is gone through for its headings.
            return not (name == "header" and any(self.tag[n] == "article" for n in self.stack))
        if self.tag[self.stack[-1]] == "header" and name not in HEADINGS and name not in ("div", "hgroup"):
            return True
        if name in NEVER or not attributes.strip():
            return False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                return True
            if key == "role" and value.lower() in DROP_ROLES:
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return True
        return False

    def named_so(self, attributes: str) -> int:
        """Whether a word of the class or id marks the element as no article: 1 if it may hold a title,
        3 if it holds comments, 2 if it is anything else of that kind."""
        mark = 0
        for m in _ATTRIBUTE.finditer(attributes):
            if m[1].lower() in ("class", "id"):
                for name in (m[2] or "").strip("\"'").split():
                    words = _WORD.findall(_SMALL.sub(" ", name).lower())
                    for i, w in enumerate(words):
                        if w in DROP_WORDS and LAYOUT.isdisjoint(words[:i]):
                            mark = max(mark, 1 if w in TITLE_WORDS else 3 if w in COMMENT_WORDS else 2)
        return mark

    def drop_marked(self) -> None:
        """Drop the marked parts with all inside, but those that hold the article."""
        if not any(self.marked):
            return
        n = len(self.tag)
        points, tops, titles, articles = [0.0] * n, [0] * n, [0] * n, [0] * n
        hidden = [False] * n  # in a part marked as more than a title's
        for node in range(1, n):
            hidden[node] = hidden[self.parent[node]] or self.marked[node] > 1
            if not self.dropped[node]:
                tops[node] = int(self.tag[node] == "main")
                titles[node] = int(self.tag[node] == "h1")
                articles[node] = int(self.tag[node] == "article" and not hidden[node])
        chars: dict[int, list] = {}
        for _, block, linked, text in self.texts:
            own = chars.setdefault(block, [0, 0, 0])
            size = len(" ".join(text.split()))
            own[0] += size
            own[1] += size if linked else 0
            own[2] += text.count(",")
        for block, (size, linked, commas) in chars.items():
            if size:
                points[block] = (1 + commas + min(size / 100, 3)) * (1 - linked / size)
        for node in range(n - 1, 0, -1):
            for counts in (points, tops, titles, articles):
                counts[self.parent[node]] += counts[node]
        for node in range(1, n):
            if self.dropped[self.parent[node]]:
                self.dropped[node] = True
            elif self.marked[node] and not tops[node]:
                most = points[node] > points[0] * (0.9 if self.marked[node] == 3 else 0.5)
                if self.marked[node] == 1 and titles[node] and (titles[node] == titles[0] or most):
                    continue
                if articles[0]:
                    self.dropped[node] = articles[node] < articles[0]
                else:
                    self.dropped[node] = tops[0] > 0 or not most or (titles[0] > titles[node])
        self.texts = [t for t in self.texts if not self.dropped[t[0]]]

    def within(self, node: int, top: int) -> bool:
        return top <= node <= self.last[top]

    def measure(self) -> tuple[list[float], list[float], dict[int, list]]:
        """Scores and link densities of the nodes, and the texts of each block."""
        n = len(self.tag)
        blocks: dict[int, list] = {}
        for _, block, linked, text in self.texts:
            size = len(" ".join(text.split()))
            own = blocks.setdefault(block, [0, 0, 0, ""])
            own[0] += size
            own[1] += size if linked else 0
            own[2] += text.count(",")
            own[3] = text.rstrip() or own[3]
        score, size, linked = [0.0] * n, [0] * n, [0] * n
        for block, (chars, link_chars, commas, _) in blocks.items():
            size[block] += chars
            linked[block] += link_chars
            if not chars:
                continue
            points = (1 + commas + min(chars / 100, 3)) * (1 - link_chars / chars)
            if self.tag[block] not in ("p", "li", "td", "th", "dd", "dt", "pre") and self.tag[block] not in HEADINGS:
                score[block] += points
            node, level = self.parent[block], 0
            while node > 0 and level < 4:
                if self.tag[node] not in ROWS:
                    score[node] += points / (1, 2, 6, 9)[level]
                    level += 1
                node = self.parent[node]
        for node in range(n - 1, 0, -1):  # children come after their parents
            size[self.parent[node]] += size[node]
            linked[self.parent[node]] += linked[node]
        density = [b / a if a else 0.0 for a, b in zip(size, linked, strict=True)]
        return [s * (1 - d) for s, d in zip(score, density, strict=True)], density, blocks

    def main(self) -> list[int]:
        """The nodes whose texts are the article."""
        score, density, blocks = self.measure()
        if not blocks:
            return []
        best = max(range(len(score)), key=lambda i: (score[i], -i))
        if best == 0 or score[best] <= 0:
            return [0]
        node = best
        while node > 0 and self.tag[node] not in ("article", "main"):
            node = self.parent[node]
        if node > 0 and self.tag[node] == "main":
            return [node]
        if node > 0:  # an article may be split over several
            beside = [i for i in range(1, len(self.tag)) if self.parent[i] == self.parent[node] and self.tag[i] == "article"]
            top = lambda i: max(score[i : self.last[i] + 1])
            return [i for i in beside if not self.dropped[i] and (i == node or top(i) >= max(10, 0.2 * score[best]))]
        keep = []
        for i in range(1, len(self.tag)):
            if self.parent[i] != self.parent[best] or self.dropped[i]:
                continue
            chars, _, _, tail = blocks.get(i, (0, 0, 0, ""))
            prose = self.tag[i] == "p" and (
                (chars > 80 and density[i] < 0.25) or (0 < chars <= 80 and density[i] == 0 and tail.endswith((".", "!", "?")))
            )
            heading = self.tag[i] in ("h1", "h2") and density[i] == 0
            if i == best or score[i] >= max(10, 0.2 * score[best]) or prose or heading:
                keep.append(i)
        return keep

    def article(self) -> str:
        tops = self.main()
        lines, block, parts = [], None, []
        for node, own, _, text in self.texts:
            if not any(self.within(node, top) for top in tops):
                continue
            if own != block:
                lines.append("".join(parts))
                block, parts = own, []
            parts.append(text)
        lines.append("".join(parts))
        return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def main_text(source: str) -> str:
    return Page(source).article() if source else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block is one space, blocks are trimmed
    and joined by line ends in page order. Null, empty and text-free pages give the empty text; text
    without any tag is one block. Ids and urls may be null; repeated rows are read each. Other
    columns are not read.
    """

    def work(run: pa.RecordBatch) -> dict:
        texts = [main_text(t) for t in texts_of(run, "html")]
        return {
            "page_id": run.column("page_id"),
            "url": run.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return map_runs(pages, ["page_id", "url", "html"], schema, work, text="html")
