"""Main text of web pages by equivalence-class template deduction (after Arasu and Garcia-Molina, 2003).

Pages of a host are dealt into groups of about ``GROUP`` pages.  In a group, tags are tokens told apart by
their role (name, class, id and the containers they stand in; what a class or an id says is never read, only
whether it is the same).  Roles with the same occurrence vector over the group's distinct pages form an
equivalence class; a class is valid if it is frequent enough and its roles stand in the same order on every page.
The class that occurs once a page is the template's spine; in each of its slots classes are formed again, so the
others nest there, told apart by their occurrence where a role occurs equally often on all pages that have it.
A block of text belongs to the slot behind the last tag before it.

The template decides which slots are text, by how their content varies over the pages:

* a slot that holds the same block wherever it occurs, on ``MIN_ALIKE`` pages or more, is template;
* on pages without an article or main element, also a slot most of whose blocks stand in it on another page too
  (a pool of adverts or notices), and one whose text stands in links on all its pages (a menu).

Besides, the parts that HTML and ARIA themselves define as no text are left out: nav, footer, aside, form, menu,
dialog, hidden parts, landmark roles of such parts, a header outside an article, and reader comments (an article
inside an article, or the comment role).  Of the other slots those in an article or main element are the text,
and on a page without text in such a part, all of them.

A class is read off the tags alone: words that many pages share may be an article's own, so they never make
a template.  Text of a slot is cut into blocks at block-level tags; in a block references are decoded and
white space becomes one space; blocks are joined by a line feed.

Defined results: null or empty html gives an empty text.  A null url is the host without a name.  Equal pages
count once in the deduction and each get their text.  A page whose text would be all template keeps it (its
group then shows copies, not a template); one whose article holds nothing but articles keeps those, and one whose
article is empty has no text.  Groups of
fewer than ``MIN_ALIKE`` distinct pages show no template, so there HTML's own parts decide alone.  A comment section that
no element or role marks, and that varies like a text, can't be told from one and stays.  Unclosed tags, comments
and quotes are read as browsers do, in time linear in the page, however long it is.  An empty table gives an
empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.store import written

GROUP, MIN_SUPPORT, MIN_ALIKE = 64, 0.5, 3
#: Hosts whose page counts are broadcast at most (some 20 MB); beyond, a join salted so many times.
MAX_BROADCAST, SALTS = 200_000, 32

#: Element names of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math select object xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
_CONTAINER = _BLOCK - frozenset("p h1 h2 h3 h4 h5 h6 hr li dd dt tr tbody tfoot thead caption pre".split())
_LEFT_OUT = frozenset("nav footer aside form head menu dialog button label".split())
_MAIN = frozenset("article main".split())
#: ARIA roles of parts that are no text.
_LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar tablist dialog alertdialog alert status log timer comment".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest) of a page: kind is open, close or text; raw elements and comments are left out."""
    out, at, n = [], 0, len(page)
    lower = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            out.append(("text", "", page[at:]))
            break
        if lt > at:
            out.append(("text", "", page[at:lt]))
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            closing = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(closing, lt + (4 if closing == "-->" else 2))
            at = n if end < 0 else end + len(closing)
            continue
        if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[lt + 2 : lt + 3].isalpha()):
            if nxt == "/":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                out.append(("text", "", "<"))
                at = lt + 1
            continue
        m = _TAG.match(page, lt)
        if m:
            slash, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
        else:  # a quote that never ends: the tag ends at the next bracket
            end = page.find(">", lt)
            piece = page[lt + 1 : n if end < 0 else end]
            slash = "/" if piece.startswith("/") else ""
            name, rest = (re.match(r"/?([^\s/>]*)", piece)[1] or "x").lower(), ""
            at = n if end < 0 else end + 1
        if slash:
            out.append(("close", name, ""))
            continue
        if name in _RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == n else page.find(f"</{name}", at)
            if end < 0:
                at = n
            else:
                gt = page.find(">", end)
                at = n if gt < 0 else gt + 1
            continue
        out.append(("open", name, rest))
    return out


def _role(name: str, rest: str) -> str:
    if not rest.strip(" /"):
        return name
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return f"{name}!out"
    if found.get("role", "").strip().lower() in _LEFT_OUT_ROLES or found.get("itemprop", "").strip().lower() == "comment":
        name += "!out"
    marks = " ".join(re.sub(r"\d+", "0", found[k].strip()) for k in ("class", "id", "role", "itemprop") if found.get(k))
    return f"{name}.{marks}" if marks else name


class Page:
    """One page's tag roles in order, and its text pieces with the containers and the spine place they stand at."""

    def __init__(self, page: str):
        self.roles: list[tuple[str, tuple[str, ...]]] = []
        self.has_main = False
        self.pieces: list[tuple[int, tuple[str, ...], str, bool]] = []  # (tags before, path, text or "\n" or " ", in a link)
        path: list[str] = []
        names: list[str] = []
        link = 0
        for kind, name, rest in tokens(page):
            if kind == "text":
                self.pieces.append((len(self.roles), tuple(path), html.unescape(rest), link > 0))
                continue
            if name in _BLOCK:
                self.pieces.append((len(self.roles), tuple(path), "\n", False))
            elif name in ("br", "td", "th"):
                self.pieces.append((len(self.roles), tuple(path), " ", False))
            if name == "a":
                link = max(0, link + (1 if kind == "open" else -1))
            if kind == "open":
                role = _role(name, rest)
                self.has_main = self.has_main or name in _MAIN
                self.roles.append((role, tuple(path)))
                if (name in _CONTAINER or "." in role or "!" in role) and name not in _VOID:
                    path.append(role)
                    names.append(name)
            else:
                if name in names:
                    k = len(names) - 1 - names[::-1].index(name)
                    # inline or unknown elements never close a container around them
                    if name in _CONTAINER or not any(x in _CONTAINER for x in names[k + 1 :]):
                        del path[k:], names[k:]
                        if name in _BLOCK:
                            self.pieces.append((len(self.roles), tuple(path), "\n", False))
                self.roles.append(("/" + name, tuple(path)))


def equivalence_classes(pages: list[list]) -> dict[tuple[int, ...], list]:
    """Valid classes of the pages' roles by occurrence vector: roles in page order, with enough support."""
    counts = [Counter(p) for p in pages]
    vectors: dict = defaultdict(list)
    for role in dict.fromkeys(r for p in pages for r in p):
        vectors[tuple(c[role] for c in counts)].append(role)
    valid = {}
    for vector, roles in vectors.items():
        if sum(1 for v in vector if v) < MIN_SUPPORT * len(pages):
            continue
        if set(vector) <= {0, 1}:
            order = None
            for p, v in zip(pages, vector, strict=True):
                if v:
                    mine = set(roles)
                    seen = [r for r in p if r in mine]
                    order = seen if order is None else order
                    if seen != order:  # keep those that stand alike on all pages
                        place = {r: i for i, r in enumerate(seen)}
                        last, kept = -1, []
                        for r in order:
                            if place[r] > last:
                                kept.append(r)
                                last = place[r]
                        order, roles = kept, kept
            roles = order or roles
        valid[vector] = roles
    return valid


def template(pages: list[Page]) -> list[tuple[str, tuple[str, ...]]]:
    """The spine: roles of the class that occurs once on every page, in order."""
    return equivalence_classes([p.roles for p in pages]).get((1,) * len(pages), [])


def _kind(path: tuple[str, ...]) -> str:
    """out, main, reply or open, by the parts that a slot stands in."""
    inside, articles = False, 0
    for role in path:
        name, _, out = role.partition(".")[0].partition("!")
        if out or name in _LEFT_OUT or (name == "header" and not inside):
            return "out"
        articles += name == "article"
        inside = inside or name in _MAIN
    return "reply" if articles > 1 else "main" if inside else "open"


def _blocks(page: Page, kind) -> list[tuple[int, str, str, bool]]:
    """(tags before, kind, text, whether all of it stands in links) of a page's blocks that HTML lets be text."""
    blocks, now, start, of, linked = [], [], 0, "", True
    for at, path, piece, link in [*page.pieces, (0, (), "\n", False)]:
        mine = "" if piece == "\n" else kind(path)
        if mine != of or not mine or mine == "out":
            text = " ".join("".join(now).split())
            if text and of != "out":
                blocks.append((start, of, text, linked))
            now, of, linked = [], mine, True
        if mine and mine != "out":
            start = at if not "".join(now).strip() else start
            now.append(piece)
            linked = linked and (link or not piece.strip())
    return blocks


def slots(pages: list[Page]) -> list[list]:
    """The template slot behind each tag of each page, None where the tag is of no valid class."""
    on_spine = set(template(pages))
    nested = []  # roles told apart by the slot of the spine they stand in
    for p in pages:
        place, own = 0, []
        for role in p.roles:
            place += role in on_spine
            own.append((place, role))
        nested.append(own)
    fixed, valid = set(), set()
    for vector, roles in equivalence_classes(nested).items():
        valid.update(roles)
        if len({v for v in vector if v}) == 1:
            fixed.update(roles)
    out = []
    for own in nested:
        seen: Counter = Counter()
        mine = []
        for role in own:
            seen[role] += 1
            mine.append((role, seen[role] if role in fixed else 0) if role in valid else None)
        out.append(mine)
    return out


def template_slots(found: list[list[tuple[int, str, str, bool]]], behind: list[list]) -> tuple[set, set]:
    """(slots that hold one and the same block wherever they occur; slots outside of articles whose blocks come
    back on other pages or stand in links), each on enough pages."""
    occur = Counter(s for mine in behind for s in mine if s is not None)
    held: Counter = Counter()
    pages_of: dict = defaultdict(lambda: defaultdict(set))  # slot -> text -> pages
    opened: dict = defaultdict(lambda: ([], []))  # slot -> texts, whether each is all links
    for i, blocks in enumerate(found):
        for at, of, text, linked in blocks:
            if at and (s := behind[i][at - 1]) is not None:
                held[s] += 1
                pages_of[s][text].add(i)
                if of == "open":
                    opened[s][0].append(text)
                    opened[s][1].append(linked)
    wide = {s for s, texts in pages_of.items() if len(set().union(*texts.values())) >= MIN_ALIKE}
    constant = {s for s in wide if len(pages_of[s]) == 1 and held[s] == occur[s]}
    pool = {s for s, (texts, linked) in opened.items() if s in wide and (2 * sum(len(pages_of[s][t]) > 1 for t in texts) > len(texts) or all(linked))}
    return constant, pool


def extract(htmls: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    known = {h: Page(h) for h in dict.fromkeys(htmls)}
    pages = list(known.values())
    kinds: dict[tuple[str, ...], str] = {}

    def kind(path: tuple[str, ...]) -> str:
        if path not in kinds:
            kinds[path] = _kind(path)
        return kinds[path]

    found = [_blocks(p, kind) for p in pages]
    behind = slots(pages)
    constant, pool = template_slots(found, behind)
    texts = {}
    for (h, page), blocks, mine in zip(known.items(), found, behind, strict=True):
        slot = [mine[at - 1] if at else None for at, *_ in blocks]
        has = {of for _, of, *_ in blocks}
        part = "main" if "main" in has else "reply" if "reply" in has else "main" if page.has_main else "open"
        every = [(text, s) for (_, of, text, _), s in zip(blocks, slot, strict=True) if of == part]
        varying = [t for t, s in every if s not in constant and not (part == "open" and s in pool)]
        texts[h] = "\n".join(varying or [t for t, _ in every])
    return [texts[h] for h in htmls]


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{page}`").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(""))))
    rows = rows.withColumn("mark", F.xxhash64("page_id", "url", "html"))
    hosts = written(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("groups")).withColumnRenamed("host", "_host"), "html-hosts")
    if hosts.count() <= MAX_BROADCAST:
        counted = rows.join(F.broadcast(hosts), F.col("host") == F.col("_host"))
    else:  # too many hosts to send: a join that a large host can't fill one task of
        every = rows.withColumn("_salt", F.pmod(F.shiftright("mark", 32), F.lit(SALTS)))
        wide = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = every.join(wide, (F.col("host") == F.col("_host")) & (every["_salt"] == wide["_salt"]))
    dealt = counted.select("page_id", "url", "html", "host", F.pmod(F.col("mark"), F.col("groups")).alias("part"))

    def run(group: pa.Table) -> pa.Table:
        texts = extract(group["html"].to_pylist())
        return pa.table({"page_id": group["page_id"], "url": group["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return dealt.groupBy("host", "part").applyInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Each page's main text."""
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
