"""Main text of web pages by consensus host paths.

Each page scores its containers: the text of a block counts for the container that holds it
and half for the one above, links count against it. From the best one the page climbs to the
container of the whole article: the outermost article element around it, else the outermost main,
else the highest container with text of its own beside it (headline, lead, closing), and votes
for that. Quotations, tables and sections are no containers, so they never stand for the whole.
Containers are named by generalised tag-class paths (numbers in classes become #). Spark sums the
votes per host and path and keeps each host's winner; pages are then extracted again: all wanted
blocks below the containers on the winning path. A page that has no such container, or no text
there, falls back on its own.

Votes are pre-aggregated per task, so a host with a third of all pages is no hot group; the
winners (one row per host) are joined by broadcast only while they are few, else by a
shuffle join whose pages are dealt out by salt.

Defined results: null or empty html gives an empty text; a page without any text outside
boilerplate gives an empty text; null urls share the empty host; repeated rows repeat their
result; an empty table gives no rows; extra columns are ignored. Character references are
decoded, white space within a block becomes one space, blocks are joined by a line feed.
Blocks are unwanted by their element, role or whole class or id: each of its words must be an
unwanted or a layout word, so that ads-free or social-history say nothing; classes of inline
elements say nothing either. Broken markup is read leniently: unclosed elements end with their
parents, a tag that is cut off at the end of the page is dropped, quotes hide the end of a tag
where they close. Time and memory are linear in the page at any depth: containers are kept once
with their parent, open elements are counted by name, and a search for the end of a tag stops
where an earlier one in vain has been.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean

REST = r"<(?=[a-zA-Z/])[^<>]*(?:\Z|>|(?=<))|[^<]+|<"
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
OTHER = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|{REST}", re.S)
STEP = "\x1f"  # between the labels of a path
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# Element names by their role in a page.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form button select menu dialog head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main".split())
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
UNWANTED = frozenset(
    "nav navbar navigation menu menus sidebar sidebars footer masthead breadcrumb breadcrumbs cookie cookies consent notice notices banner banners ad ads advert adverts advertisement advertisements adsense sponsor sponsors sponsored promo promos promotion share sharing social comment comments commentlist disqus replies respond related recommended newsletter subscribe signup login popup modal overlay toolbar widget widgets pagination pager skip search".split()
)
LAYOUT = frozenset("left right top bottom main site page global primary secondary header head list box boxes item items wrap wrapper container block section area bar slot unit inner outer content links link buttons button post posts entry form panel row col column div group holder module text title body message label icon icons image count meta author".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\dA-Za-z_]+")
DIGITS = re.compile(r"\d+")


def is_unwanted(names: str) -> bool:
    """Whether one of the names (a class or id attribute) says, as a whole, that its element is no part of an article."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if any(w in UNWANTED for w in words) and all(w in UNWANTED or w in LAYOUT for w in words):
            return True
    return False


class Page:
    """The text blocks of a page, each with the container it lies in; boilerplate is left out."""

    def __init__(self, html: str):
        #: (text, link characters, innermost container)
        self.blocks: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, bool, int]] = []  # name, unwanted, innermost container
        self.levels: list[int] = []  # places of open blocks in the stack
        self.open_blocks: Counter[str] = Counter()
        self.open_inline: list[Counter[str]] = [Counter()]  # since each open block
        self.containers: dict[tuple[int, str], int] = {}  # number by parent and label; 0 is outside of all
        self.parents, self.labels = [0], [""]
        self.text: list[str] = []
        self.linked = self.links = self.unwanted = self.articles = 0
        self.html, self.dead, self.last = html, set(), {c: html.rfind(c) for c in ">\"'"}
        raw, at = None, 0
        while at < len(html):
            if raw:  # up to the end tag, whatever stands between
                end = re.compile(rf"</{re.escape(raw)}[\s/>]", re.I).search(html, at)
                if not end:
                    break
                at, raw = end.start(), None
            m = NAME.match(html, at) if html[at] == "<" and at < self.last[">"] else None
            if m:
                name, end = m[2].lower(), self.tag_end(m.end())
                if m[1]:
                    self.close(name)
                else:
                    raw = name if self.open(name, html[m.end() : end - 1]) and name in RAW else None
                at = end
            else:
                m = OTHER.match(html, at)
                if m[0][0] != "<" or m[0] == "<":
                    self.add(m[0])
                at = m.end()
        self.flush()

    def tag_end(self, at: int) -> int:
        """Where a tag ends whose name ends at `at`: after the next > outside of quotes, or the next at all if there is none."""
        start, passed = at, []
        while m := STOP.search(self.html, at):
            at = m.end()
            if m[0] == ">":
                return at
            if m.start() < self.last[m[0]]:  # else it never closes, and is no quote
                at = self.html.index(m[0], at) + 1
                if at in self.dead:
                    break
                passed.append(at)
        self.dead.update(passed)
        return self.html.index(">", start) + 1

    def add(self, text: str) -> None:
        if not self.unwanted:
            text = entities.unescape(text) if "&" in text else text
            self.text.append(text)
            if self.links:
                self.linked += len(text)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.linked, self.stack[-1][2] if self.stack else 0))
        self.text, self.linked = [], 0

    def open(self, name: str, attributes: str) -> bool:
        block = name in BLOCKS
        if block:
            self.flush()
            for i in range(len(self.levels) - 1, -1, -1):
                ended_by = CLOSED_BY.get(self.stack[self.levels[i]][0])
                if ended_by is None:
                    break
                if name in ended_by:
                    self.leave(self.levels[i])
                    break
        if name in VOID:
            if name == "br":
                self.add(" ")
            return False
        if attributes.endswith("/") and not block and name not in RAW:
            return False
        found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        classes = found.get("class", "")
        unwanted = name in RAW or name in BOILERPLATE or (name == "header" and not self.articles) or "hidden" in found or found.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog")
        if block and not unwanted and name not in ("html", "body", "article", "main"):
            unwanted = is_unwanted(classes) or is_unwanted(found.get("id", ""))
        inside = self.stack[-1][2] if self.stack else 0
        if name in CONTAINERS:
            inside = self.container(inside, ".".join([name, *sorted(DIGITS.sub("#", c) for c in classes.replace(STEP, " ").split())]))
        if block:
            self.levels.append(len(self.stack))
            self.open_blocks[name] += 1
            self.open_inline.append(Counter())
        else:
            self.open_inline[-1][name] += 1
        self.stack.append((name, unwanted, inside))
        self.unwanted += unwanted
        self.links += name == "a"
        self.articles += name in ("article", "main")
        return True

    def container(self, parent: int, label: str) -> int:
        at = self.containers.setdefault((parent, label), len(self.labels))
        if at == len(self.labels):
            self.parents.append(parent)
            self.labels.append(label)
        return at

    def close(self, name: str) -> None:
        if name in BLOCKS:
            if self.open_blocks[name]:
                self.flush()
                self.leave(next(i for i in reversed(self.levels) if self.stack[i][0] == name))
        elif self.open_inline[-1][name]:  # an inline end tag doesn't close blocks
            self.leave(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))

    def leave(self, i: int) -> None:
        for name, unwanted, _ in self.stack[i:]:
            self.unwanted -= unwanted
            self.links -= name == "a"
            self.articles -= name in ("article", "main")
            if name in BLOCKS:
                self.open_blocks[name] -= 1
            elif not self.levels or self.levels[-1] < i:
                self.open_inline[-1][name] -= 1
        while self.levels and self.levels[-1] >= i:
            self.levels.pop()
            self.open_inline.pop()
        del self.stack[i:]

    def path(self, at: int) -> str:
        """The labels from the outermost container to this one."""
        out = []
        while at:
            out.append(self.labels[at])
            at = self.parents[at]
        return STEP.join(out[::-1])

    def best(self) -> tuple[int, float] | None:
        """The container of the whole article, and the score of the best one in it."""
        scores: dict[int, float] = defaultdict(float)
        own: dict[int, int] = defaultdict(int)
        for text, linked, at in self.blocks:
            worth = len(text) - 2 * linked
            own[at] += worth
            scores[at] += worth
            if at:
                scores[self.parents[at]] += worth / 2
        if not scores:
            return None
        most = max(scores.values())
        at = top = min(x for x in scores if scores[x] == most)
        above = [at]
        while at:
            at = self.parents[at]
            above.append(at)
        for kind in ("article", "main"):
            if around := [x for x in above if self.labels[x].split(".", 1)[0] == kind]:
                return around[-1], most
        for x in above:
            if own[x] > 0:
                top = x
        return top, most

    def main_text(self, path: str | None) -> str:
        """The text below the containers on a path (null: the page's own choice)."""
        at: int | None = None
        if path is not None:
            at = 0
            for label in path.split(STEP) if path else ():
                at = self.containers.get((at, label)) if at is not None else None
        text = self.below(at) if at is not None else ""
        if not text:
            found = self.best()
            text = self.below(found[0] if found else 0)
        return text

    def below(self, at: int) -> str:
        inside = [False] * len(self.labels)
        for i in range(len(inside)):  # parents come first
            inside[i] = i == at or inside[self.parents[i]]
        return "\n".join(text for text, _, own in self.blocks if inside[own])


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def vote(pages: DataFrame) -> DataFrame:
    """host, path: the container path that most of the host's pages score highest, by summed score among equals."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0, 0.0])
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(html.as_py() or "")
                if found := page.best():
                    path = page.path(found[0])
                    votes[host, path][0] += 1
                    votes[host, path][1] += found[1]
            keys = list(votes)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k][0] for k in keys], pa.int64()), pa.array([round(votes[k][1]) for k in keys], pa.int64())], ["host", "path", "votes", "score"])

    ballots = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(lean(score), "host string, path string, votes long, score long")
    summed = ballots.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract_main_text(pages: DataFrame, few_hosts: int = 100_000, salts: int = 32) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    winners = Scratch(pages.sparkSession, "hosts").cut(vote(pages), "winners")
    if winners.limit(few_hosts + 1).count() <= few_hosts:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).join(spread, ["host", "salt"], "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py() or "").main_text(p) for h, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "path").mapInArrow(lean(extract), "page_id long, url string, text string, n_chars long")
