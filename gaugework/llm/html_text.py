"""Main text of web pages by templates deduced from the pages of a host.

A page's tokens are its boxes (elements that hold others), told apart by their path, and its text
blocks. Tokens with the same occurrence vector over the pages of a host form an equivalence class; the
vector is kept as sums of keyed page hashes times counts, which add up in any order. Classes on enough
of the pages are checked: they are valid if their tokens stand in one order on all pages and nest in
one gap of the host's largest class. Boxes of classes nest by their paths into the template and cut a
page into slots; blocks of valid classes are the template's own text. The slot with the article is the
one with most of the text, by what the names of its elements say; of the slots within it those that
are named after something else, such as adverts or comments, go, and so does the template's own text.
Names never take anything away that isn't a slot of the template.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, ready_python, stage, table, unstage

#: Share of a host's different pages on which a class must stand for its boxes to cut slots, and for its
#: blocks to be the template's text within the article; and pages that the latter takes at least.
BOX_SHARE, TEXT_SHARE, TEXT_PAGES = 0.2, 0.9, 3
#: Paths and templates that a Python worker remembers; beyond it the memory starts anew.
KEPT_PATHS, KEPT_HOSTS = 200_000, 64

# Element names of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset("script style head title noscript template iframe object svg canvas audio video map form button select textarea input nav footer aside menu dialog".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rb rt rp nobr math mi mo mn mrow mfrac msup msub msqrt semantics annotation".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre figure figcaption address hgroup summary".split())
MAIN = ("article", "main")
# Words in class, id or role that name something other than the article, and words that go along with them.
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer copyright comment comments disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar skip contentinfo complementary".split()
)
SHAPE_WORDS = frozenset("a the to for of by site page main top bottom left right side inner outer box slot block area section container content wrapper wrap bar list item items link links button buttons form icon icons post posts article articles story stories unit row column header head title form text js".split())
TOP_WORDS = frozenset("header masthead topbar head".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\s(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)", re.I) for t in RAW}
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_STOPS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}


def _digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_paths: dict[tuple[int, str], int] = {}


def path_of(parent: int, label: str) -> int:
    """The path of an element with this label within the parent path, as a hash."""
    found = _paths.get((parent, label))
    if found is None:
        if len(_paths) >= KEPT_PATHS:
            _paths.clear()
        found = _paths[parent, label] = _digest(parent, label)
    return found


def named_otherwise(words: list[str], top: bool) -> bool:
    """Whether a name says that an element isn't the article: no word of it speaks of anything else."""
    odd = [w for w in words if w in OTHER_WORDS or top and w in TOP_WORDS]
    return bool(odd) and all(w in OTHER_WORDS or w in SHAPE_WORDS or top and w in TOP_WORDS for w in words)


class Box:
    """An element that isn't inline: its path, the box above, whether its text is left out and whether it is named otherwise."""

    __slots__ = ("path", "above", "name", "dropped", "other", "inside", "chars")

    def __init__(self, path, above, name, dropped, other, inside):
        self.path, self.above, self.name, self.dropped, self.other, self.inside, self.chars = path, above, name, dropped, other, inside, 0


class Page:
    """Boxes and text blocks of a page in order. A block is (text, box); its elements of content belong to the box around them.

    Time and memory are linear in the page, however deep it nests.
    """

    __slots__ = ("boxes", "blocks", "order")

    def __init__(self, source: str | None):
        self.boxes = [Box(0, None, "", False, False, False)]
        self.blocks: list[tuple[str, Box]] = []
        self.order: list[int] = []  # boxes as their numbers, blocks as -1 - theirs
        # A level: element, its box, whether its text is left out, path with the elements of content.
        stack = [("", self.boxes[0], False)]
        open_: dict[str, int] = {}
        text: list[str] = []

        def flush():
            if text:
                block = " ".join(entities.unescape("".join(text)).split())
                text.clear()
                if block and not stack[-1][2]:
                    self.order.append(-1 - len(self.blocks))
                    self.blocks.append((block, stack[-1][1]))

        def cut(k):
            for level in stack[k:]:
                open_[level[0]] -= 1
            del stack[k:]

        def push(name, box, dropped):
            open_[name] = open_.get(name, 0) + 1
            stack.append((name, box, dropped))

        source, at = source or "", 0
        while True:
            found = _TOKEN.search(source, at)
            if found is None:
                text.append(source[at:])
                break
            if found.start() > at:
                text.append(source[at : found.start()])
            at = found.end()
            tag = found[0]
            if tag[1] in "!?":
                continue
            name = _NAME.match(tag)[1].lower()
            if tag[1] == "/":
                if name in INLINE and stack[-1][0] not in INLINE:
                    continue
                if name not in INLINE:
                    flush()
                if not open_.get(name):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if stack[-1][2] != stack[k - 1][2]:
                            flush()
                        cut(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
                continue
            plain = len(tag) == len(name) + 2
            if name in INLINE:
                if not plain and not tag.endswith("/>"):
                    drop = stack[-1][2] or bool(_HIDDEN.search(tag))
                    if drop != stack[-1][2]:
                        flush()
                    push(name, stack[-1][1], drop)
                continue
            flush()
            if name in VOID:
                continue
            if name in _END:
                end = _END[name].search(source, at)
                at = end.end() if end else len(source)
                continue
            ends = (*_ENDS.get(name, ()), "p")
            if any(open_.get(e) for e in ends):
                self._close_implied(stack, name, ends, cut)
            _, above, dropped = stack[-1]
            hidden, other, label = (False, False, name) if plain else self._named(name, tag, above.inside)
            dropped = dropped or hidden or name in DROPPED or (name == "header" and not above.inside)
            box = above
            if name not in CONTENT:
                box = Box(path_of(above.path, label), above, name, dropped, other, above.inside or name in MAIN and not other)
                if not dropped:
                    self.order.append(len(self.boxes))
                    self.boxes.append(box)
            push(name, box, dropped)
            if tag.endswith("/>"):
                cut(len(stack) - 1)
        flush()
        for block, box in self.blocks:
            box.chars += len(block)
        for box in reversed(self.boxes):
            if box.above is not None:
                box.above.chars += box.chars

    @staticmethod
    def _close_implied(stack, name, ends, cut):
        """Starting a block ends an open paragraph, and an item or a cell ends the one before."""
        stop = _STOPS.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ends:
                cut(k)
                if stack[-1][0] in ends:
                    continue
                return
            if stack[k][0] in stop or stack[k][0] not in INLINE and ends == ("p",):
                return

    @staticmethod
    def _named(name: str, tag: str, inside: bool) -> tuple[bool, bool, str]:
        """(hidden, whether the attributes name something other than the article, label in paths)."""
        label, other = name, False
        for key, *values in _ATTRIBUTE.findall(tag):
            value = next((v for v in values if v), "")
            label += {"class": ".", "id": "#"}.get(key.lower(), "@") + re.sub(r"\d+", "", value)
            if name not in ("html", "body") and name not in CONTENT:
                for part in value.split():
                    words = [w.lower() for w in re.findall(r"[^\W\d_]+", _CAMEL.sub(" ", part))]
                    other |= named_otherwise(words, not inside)
        return bool(_HIDDEN.search(tag)), other, label

    def digests(self) -> list[int]:
        """A token for each block: its text and the path of its box."""
        return [_digest(box.path, block) for block, box in self.blocks]


def host_of(url):
    """The host of a URL in small letters; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_TOKENS = "host string, mark long, token long, above long, name string, other boolean, n long, chars long"


def _page_tokens(batches):
    """A row for each different token of a page: boxes with their names, blocks with the box they stand in."""
    for batch in batches:
        out: tuple[list, ...] = tuple([] for _ in range(7))
        for k, source in enumerate(batch.column("html").to_pylist()):
            page = Page(source)
            found: dict[int, list] = {0: [None, "", False, 1, page.boxes[0].chars]} if page.blocks or len(page.boxes) > 1 else {}
            for box in page.boxes[1:]:
                row = found.setdefault(box.path, [box.above.path, box.name, box.other, 0, 0])
                row[3] += 1
                row[4] += box.chars
            for token, (block, box) in zip(page.digests(), page.blocks):
                row = found.setdefault(token, [box.path, None, False, 0, 0])
                row[3] += 1
                row[4] += len(block)
            for token, row in found.items():
                for column, value in zip(out, (k, token, *row)):
                    column.append(value)
        at = pa.array(out[0], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("host").take(at), batch.column("mark").take(at), *(pa.array(c, t) for c, t in zip(out[1:], kinds))], ["host", "mark", "token", "above", "name", "other", "n", "chars"])


def classes_of(pages: DataFrame) -> DataFrame:
    """host, pages, token, above, name (null for blocks), other, class, support and chars of tokens on enough of the host's different pages."""
    rows = pages.select("host", "mark", "html").mapInArrow(_page_tokens, _TOKENS)
    # Copies of a page are one page.
    rows = rows.groupBy("host", "token", "mark", "n").agg(F.max("above").alias("above"), F.max("name").alias("name"), F.max("other").alias("other"), F.max("chars").alias("chars"))
    key = F.xxhash64("mark", "n")
    part = lambda shift: F.sum(F.shiftright(key, shift).bitwiseAND(F.lit(0x7FFFFFFF)))
    vectors = stage(
        rows.groupBy("host", "token").agg(part(0).alias("v1"), part(32).alias("v2"), F.count(F.lit(1)).alias("support"), F.max("above").alias("above"), F.max("name").alias("name"), F.max("other").alias("other"), F.sum("chars").alias("chars")),
        "vectors",
    )
    root = vectors.where("token = 0").select("host", F.col("support").alias("pages"))
    least = F.when(F.col("name").isNotNull(), F.greatest(F.least(F.lit(2), F.col("pages")), F.ceil(F.col("pages") * BOX_SHARE))).otherwise(F.greatest(F.lit(TEXT_PAGES), F.ceil(F.col("pages") * TEXT_SHARE)))
    enough = vectors.join(root, "host").where(F.col("support") >= least)
    return stage(enough.select("host", "pages", "token", "above", "name", "other", F.xxhash64("v1", "v2", "support").alias("class"), "support", "chars"), "tokens")


def _orders(batches):
    """host, class, order and gap: how the blocks' classes stand on each page, and in which gap of the host's largest class."""
    known: dict[str, tuple] = {}
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for host, source, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("tokens").to_pylist()):
            if host not in known:
                if len(known) >= KEPT_HOSTS:
                    known.clear()
                of, size = {}, {}
                for token, class_, _ in json.loads(text):
                    of[int(token)] = int(class_)
                    size[int(class_)] = size.get(int(class_), 0) + 1
                known[host] = of, max(size, key=lambda c: (size[c], c)) if size else None
            of, root = known[host]
            page = Page(source)
            names, gap, seen = page.digests(), 0, {}
            for at in page.order:
                token = page.boxes[at].path if at >= 0 else names[-1 - at]
                class_ = of.get(token)
                if class_ is not None:
                    gap += class_ == root
                    tokens, gaps = seen.setdefault(class_, ([], set()))
                    tokens.append(token)
                    gaps.add(gap)
            for class_, (tokens, gaps) in seen.items():
                size = len(set(tokens))
                first = tokens[:size]
                ordered = tokens == first * (len(tokens) // size)
                for column, value in zip(out, (host, class_, _digest(*first) if ordered else None, 0 if class_ == root else min(gaps) if len(gaps) == 1 else None)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(c, pa.int64()) for c in out[1:])], ["host", "class", "order", "gap"])


def templates(pages: DataFrame) -> DataFrame:
    """host, pages and template: JSON of (token, path above, name or null, other, chars) of boxes and of the blocks of valid classes; staged.

    A template has no more tokens than 1 / BOX_SHARE pages of the host.
    """
    tokens = classes_of(pages)
    packed = tokens.groupBy("host").agg(F.to_json(F.collect_list(F.array(F.col("token").cast("string"), F.col("class").cast("string"), F.col("name")))).alias("tokens"))
    # Only hosts with a block that could be the template's need the check.
    blocks = tokens.where("name is null").select("host").distinct()
    packed = stage(packed.join(blocks, "host", "left_semi"), "classes")
    stand = pages.select("host", "html").join(packed, "host").mapInArrow(_orders, "host string, class long, order long, gap long").groupBy("host", "class")
    fits = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    valid = stand.agg((fits("order") & fits("gap")).alias("valid")).where("valid").select("host", "class")
    # A box alone is ordered, and nests by its path; blocks need a valid class.
    kept = tokens.where("name is not null").unionByName(tokens.where("name is null").join(valid, ["host", "class"], "left_semi"))
    row = F.struct(F.col("token").cast("string").alias("t"), F.col("above").cast("string").alias("a"), F.col("name").alias("n"), F.col("other").alias("o"), F.col("chars").alias("c"))
    out = stage(kept.groupBy("host").agg(F.max("pages").alias("pages"), F.to_json(F.sort_array(F.collect_list(row))).alias("template")), "templates")
    unstage(tokens)
    unstage(packed)
    return out


class Template:
    """The boxes that cut slots, the slot of the article, and the template's own text within it."""

    def __init__(self, rows: list[tuple[int, int | None, str | None, bool, int]]):
        boxes = {t: (a, n, o, c) for t, a, n, o, c in rows if n is not None}
        self.cuts = set(boxes)
        self.slot, self.text = 0, set()

        state: dict[int, tuple[bool, int]] = {}  # path: (named otherwise or within such a box, depth)

        def look(path):
            chain = []
            while path is not None and path not in state:
                chain.append(path)
                path = boxes[path][0] if path in boxes else None
            for p in reversed(chain):
                above = state.get(boxes[p][0] if p in boxes else None, (False, -1))
                state[p] = above[0] or p in boxes and boxes[p][2], above[1] + 1
            return state[chain[0]] if chain else state[path]

        open_ = {t: b for t, b in boxes.items() if not look(t)[0]}
        for name in MAIN:
            named = [t for t, b in open_.items() if b[1] == name and b[3] > 0]
            if named:
                self.slot = max(named, key=lambda t: (open_[t][3], -state[t][1], t))
                break
        else:
            whole = max((b[3] for b in open_.values()), default=0)
            large = [t for t, b in open_.items() if 2 * b[3] > whole]
            if large:
                self.slot = max(large, key=lambda t: (state[t][1], open_[t][3], t))
        below = {self.slot}
        inside: dict[int, bool] = {}

        def within(path):
            chain = []
            while path is not None and path not in below and path not in inside:
                chain.append(path)
                path = boxes[path][0] if path in boxes else None
            found = path in below or inside.get(path, False)
            inside.update((p, found) for p in chain)
            return found

        own = [(t, c) for t, a, n, _, c in rows if n is None and within(a)]
        # If most of the article stands on all pages, they are versions of one text and not a template.
        if self.slot in boxes and 2 * sum(c for _, c in own) < boxes[self.slot][3]:
            self.text = {t for t, _ in own}

    @staticmethod
    def of(text: str) -> Template:
        return Template([(int(r["t"]), int(r["a"]) if r.get("a") is not None else None, r.get("n"), bool(r.get("o")), r["c"]) for r in json.loads(text)])


def main_text(source: str | None, template: Template) -> str:
    page = Page(source)
    # (within the slot, within a slot of something else)
    state = {id(page.boxes[0]): (template.slot == 0, False)}

    def look(box):
        chain = []
        while id(box) not in state:
            chain.append(box)
            box = box.above
        found = state[id(box)]
        for b in reversed(chain):
            found = state[id(b)] = (found[0] or b.path == template.slot, found[1] or b.other and b.path in template.cuts)
        return found

    kept = [(token, block, box, *look(box)) for token, (block, box) in zip(page.digests(), page.blocks)]
    mine = [k for k in kept if k[3] and not k[4]]
    if not mine:  # a page unlike its host's others
        mine = [k for k in kept if k[2].inside and not k[4]] or [k for k in kept if not k[4]]
    return " ".join(block for token, block, *_ in mine if token not in template.text)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row.

    Null or empty html gives an empty text. Rows with a null url share a host without a name. Repeated
    rows stay, and copies count as one page of their host. Long pages are taken whole, in time linear
    in their length; extra columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ready_python(spark)
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("mark"))
    # A table of its own, so that a small one is broadcast by its known size and a large one joined
    # by a shuffle in which Spark can split the pages of a frequent host.
    both = rows.join(templates(rows), "host", "left").select("page_id", "url", "html", "template")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def run(batches):
        known: dict[str | None, Template] = {}
        for batch in batches:
            texts = []
            for source, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
                if template not in known:
                    if len(known) >= KEPT_HOSTS:
                        known.clear()
                    known[template] = Template.of(template or "[]")
                texts.append(main_text(source, known[template]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(run, f"{kinds}, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length in code points."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
