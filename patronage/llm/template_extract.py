"""Main text of web pages by equivalence-class template deduction.

A token of a page is a tag with its path of enclosing elements, or the text of a
block with its path, in the article too. Tokens of the pages of one host that
occur equally often on every page (equal occurrence vectors) form an
equivalence class. Classes found on most pages of a host are kept, their tokens in
the order of their places. A class of two tokens or more has gaps if it is
ordered (its tokens follow each other in that order, round after round, on every page) and
nested (no other such class begins inside it and ends outside). The gap that an occurrence of a
token stands in tells its roles apart: a round gives every token the innermost class around it
and the gap of that class, the vectors are those of the roles, and new classes come
out, host by host until a round changes no class. So the classes that span the page
are the root, the others (items of a menu) lie in its gaps, and an occurrence is
the template's if its role is in a class; of a token none of whose
roles is in one (a notice that moves about) all occurrences are. Pages with the same own text count as one page of
evidence (the one with the smallest fingerprint of its tokens), so copies prove nothing.

Texts of classes belong to the template, given at least ``EVIDENCE`` pages
that hold them; under ``article`` or ``main`` only texts that every page of the
host holds outside paragraphs, headings, lists, tables and quotations do, as
an article may say the same as others. What is left are the slots with a page's own text. The article is
what stands under ``article`` or ``main``, if the template confirms these elements and unless the slots elsewhere hold more
than ``TEASER`` times as much (then those elements are teasers); without it, the
slots under the deepest container that leaves behind no heading and less than a
tenth of the text.

The template confirms what names say: two pages of the host or more must have an
``article`` or ``main`` (one of two pages will do), and class and id words that name a part beside the article
put it there if two pages or more have such an element with that word; never for
html, body, main and article. On a host of one page, or for a page of no host,
names count by themselves; for a host that ``templates`` does not know, none does. Hidden parts are those with the attribute ``hidden``,
``aria-hidden="true"`` or a style of ``display: none`` or ``visibility: hidden``.

Vectors are compared by fingerprints: (host, token) rows are combined before
their shuffle, so a host with a third of all pages is many partial sums and no
large group. Pages are read once for their tokens, which the rounds scan, and once for
their texts. A host's template is bounded by twice the tokens of a page and the
marks (one for an element name and word).

A block ends where a block element begins or ends; a line break is white
space. Scripts, styles, comments and markup go, character references are
decoded once, white space in a block (no-break space too) becomes one space.
Quotes delimit a value only after an equals sign; ``svg`` and ``math`` may close
themselves, and an element of theirs that nothing closes hides no text.

Defined cases: null html is empty and gives empty text; a page without url is
of host ""; a host of one page has no template; rows and repeated rows are kept
one for one; unclosed and stray tags are allowed.
"""
from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section select summary table tbody tfoot thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg math iframe object".split())
#: Elements whose content is text to the end of the page where nothing closes them.
TO_THE_END = frozenset("script style textarea iframe".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("head title nav footer aside form button select menu dialog label fieldset".split()) | RAW
MAIN = frozenset(["article", "main"])
#: Words of class and id names that mark parts beside the article.
BESIDE = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice
notices notification pager pagination popup promo promoted promotion recommended related reply replies respond share
sharing sidebar signup skip social sponsor sponsored subscribe tagcloud toolbar widget widgets""".split())

#: Elements whose class and id names say nothing.
KEPT = MAIN | {"html", "body"}
#: Elements that may hold a whole article.
CONTAINERS = KEPT | frozenset("center div section table tbody td tr".split())
HEADINGS = frozenset(["h1", "h2", "h3"])
#: Blocks whose text in an article is the article's, however often the host says it.
PROSE = frozenset("blockquote center dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup li p pre summary td th".split())
#: Pages with texts of their own that must hold a text before it is the template's.
EVIDENCE = 3
#: So much more text than under article or main makes these teasers.
TEASER = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(?=[a-zA-Z/])[^<]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_HOST = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str = "url") -> Column:
    """Lower-case host of an address, "" without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def _beside(name: str, in_main: bool) -> bool:
    return name in OUTSIDE or name == "header" and not in_main


def _signs(name: str, attributes: str) -> tuple[bool, list[str]]:
    """Whether the attributes hide an element, and those class, id and role words that mark a part beside the article."""
    if not attributes.strip():
        return False, []
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}
    unseen = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" \
        or bool(_UNSEEN.search(found.get("style", "")))
    if name in KEPT:
        return unseen, []
    words = re.split(r"[^a-z0-9]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower())
    return unseen, sorted({w for w in words if w in BESIDE})


class Place(NamedTuple):
    """An open element: whether it lies beside the article, under article or main, and in a part that unconfirmed words mark."""

    name: str = ""
    beside: bool = False
    main: bool = False
    marked: bool = False
    node: int = 0


def events(page: str, confirmed: set[int] | None, tree: list[tuple[int, str]]) -> Iterator[tuple[str, str, Place, bool]]:
    """(kind, value, place, new block) of a page in order; kind: tag, mark or text.

    The value of a tag is its path of elements, that of a mark an element name with a
    word that marks a part beside the article, that of a text the text itself.
    With ``confirmed``, only marks whose tokens it holds put a part beside. ``tree``
    receives (parent, name) of every element; the page is element 0.
    """
    stack = [Place()]
    tree.append((0, ""))
    path, at, block = "", 0, True
    n = len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if not name:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield "text", text, stack[-1], block
                block = block and (stack[-1].beside or not text.strip())
            continue
        name = name.lower()
        if name in BLOCKS:
            block = True
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in ("article", "body", "table") and name not in ("body", "html"):
                    break  # a stray end tag closes nothing beyond
            path = ">".join(x.name for x in stack)
            yield "tag", f"{path}</{name}", stack[-1], block
            continue
        closed = m[3].rstrip().endswith("/")
        if name in RAW:
            end = None if closed and name in ("svg", "math") else re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            if end:
                close = page.find(">", end.end())
                at = close + 1 if close >= 0 else n
            elif name in TO_THE_END:
                at = n
            yield "tag", f"{path}>{name}", stack[-1], block
            continue
        if name in BLOCKS:  # a block ends an open paragraph and what stands open in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p" or name == stack[i].name and name in ("li", "dt", "dd", "tr", "option"):
                    del stack[i:]
                    break
                if stack[i].name in BLOCKS:
                    break
        within = stack[-1]
        path = ">".join(x.name for x in stack)
        yield "tag", f"{path}>{name}", within, block
        if name == "br":
            yield "text", " ", within, block
        if name not in VOID and not closed:
            unseen, words = _signs(name, m[3])
            marks = [f"{name} {w} {within.main}" for w in words]
            for mark in marks:
                yield "mark", mark, within, block
            apart = bool(marks) and (confirmed is None or any(token("mark", x) in confirmed for x in marks))
            main = within.main or name in MAIN
            tree.append((within.node, name))
            stack.append(Place(name, within.beside or unseen or apart or _beside(name, main), main,
                               within.marked or bool(marks), len(tree) - 1))


def _text(value: str) -> str:
    return " ".join(entities.unescape(value).split())


#: The mark of a page that has an ``article`` or ``main``.
MAIN_MARK = "main"


def token(kind: str, value: str, path: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{path}\0{value}") - (1 << 63)


class Block(NamedTuple):
    path: str
    place: Place
    text: str
    prose: bool


def read(page: str, confirmed: set[int] | None) -> tuple[list[str | Block], list[str], list[Block], list[tuple[int, str]]]:
    """The tags and blocks in their order, marks, blocks of text not beside the article, and elements of a page."""
    order, marks, open_blocks, tree = [], [], [], []
    path = ""
    for kind, value, place, new in events(page, confirmed, tree):
        if kind == "tag":
            path = value
            order.append(value)
        elif kind == "mark":
            marks.append(value)
        elif not place.beside:
            if new or not open_blocks or open_blocks[-1][1].main != place.main:
                order.append(len(open_blocks))
                open_blocks.append((path, place, []))
            open_blocks[-1][2].append(value)
    blocks = {}
    for i, (at, place, texts) in enumerate(open_blocks):
        if text := _text("".join(texts)):
            node = place.node
            while node and tree[node][1] not in BLOCKS:
                node = tree[node][0]
            blocks[i] = Block(at, place, text, tree[node][1] in PROSE)
    order = [x if isinstance(x, str) else blocks[x] for x in order if isinstance(x, str) or x in blocks]
    return order, marks, list(blocks.values()), tree


@functools.lru_cache(1 << 16)
def _tag(path: str) -> int:
    return token("tag", path)


def in_order(order: list[str | Block]) -> list[int]:
    """The tokens of tags and blocks."""
    return [_tag(x) if isinstance(x, str) else token("text", x.text, x.path) for x in order]


def page_order(page: str) -> tuple[int, Counter, list[int]]:
    """Fingerprint of a page's own text, how often its marks occur, and its other tokens in their order."""
    order, marks, blocks, tree = read(page, set())
    if any(name in MAIN for _, name in tree):
        marks.append(MAIN_MARK)
    main = [b.text for b in blocks if b.place.main]
    own = token("own", "\0".join(main or [b.text for b in blocks if not b.place.marked] or [b.text for b in blocks]))
    return own, Counter(token("mark", x) for x in marks), in_order(order)


def page_tokens(page: str) -> tuple[int, Counter, Counter]:
    """Fingerprint of a page's own text, and how often its marks and its other tokens occur."""
    own, marks, tokens = page_order(page)
    return own, marks, Counter(tokens)


@functools.lru_cache(1 << 16)
def _role(role: int, around: int, gap: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d %d" % (role, around, gap)) - (1 << 63)


def places(classes: list) -> dict[int, tuple[int, int, int]]:
    """The class (its first role), index and size of the class of every role in ordered classes."""
    return {int(r): (int(c[0]), i, len(c)) for c in classes for i, r in enumerate(c)}


def told_apart(roles: list[int], at: dict[int, tuple[int, int, int]]) -> tuple[list[int], set[int]]:
    """Roles by the innermost class around each and the gap of it, and the classes that are not ordered and nested here."""
    open_classes, out, wrong, due = [], [], set(), {}
    for r in roles:
        place = at.get(r)
        if place:
            c, i, size = place
            if due.get(c, 0) != i:
                wrong.add(c)
            due[c] = (i + 1) % size
            for k in range(len(open_classes) - 1, -1, -1):
                if open_classes[k][0] == c:
                    wrong.update(x for x, _ in open_classes[k + 1:])  # they end outside
                    del open_classes[k:]
                    break
        out.append(_role(r, *open_classes[-1]) if open_classes else r)
        if place and i < size - 1:
            open_classes.append((c, i))
    wrong.update(c for c, i in due.items() if i)
    return out, wrong


def container(blocks: list[Block], tree: list[tuple[int, str]]) -> set[int]:
    """The elements in the deepest container that leaves behind no heading and less than a tenth of the blocks' text."""
    mass, heads, children = [0] * len(tree), [0] * len(tree), {}
    for b in blocks:
        mass[b.place.node] += len(b.text)
        heads[b.place.node] += b.place.name in HEADINGS
    for i in range(len(tree) - 1, 0, -1):  # an element comes after its parent
        parent = tree[i][0]
        mass[parent] += mass[i]
        heads[parent] += heads[i]
    for i in range(1, len(tree)):
        children.setdefault(tree[i][0], []).append(i)
    at = 0
    while True:
        down = [i for i in children.get(at, ()) if tree[i][1] in CONTAINERS
                and heads[i] == heads[at] and 10 * mass[i] > 9 * mass[at]]
        if not down:
            break
        at = down[0]
    inside = {at}
    for i in range(at + 1, len(tree)):
        if tree[i][0] in inside:
            inside.add(i)
    return inside


def main_text(page: str, template: list[dict], pages: int, known: bool = True, rounds=(), roles=()) -> str:
    """The article of a page, given the classes (mark, n_pages, total, tokens) of its host and its number of pages,
    and the ordered and nested classes of each round with the (role, token, n_pages) that they tell apart.

    Words of class and id names, ``article`` and ``main`` count only as the host's pages confirm
    them, but where there is none to ask: a host of one page, or (not ``known``) no host.
    """
    confirmed = {t for c in template if c["mark"] for t in c["tokens"]} if known and pages != 1 else None
    signed = confirmed is None or token("mark", MAIN_MARK) in confirmed or 0 < pages < EVIDENCE
    shared = [c for c in template if not c["mark"] and c["n_pages"] >= EVIDENCE]
    fixed = {t for c in shared for t in c["tokens"]}
    everywhere = {t for c in shared if c["n_pages"] == pages for t in c["tokens"]}
    told = {t for _, t, n in roles if n >= EVIDENCE}
    in_class = {r: n for r, _, n in roles if n >= EVIDENCE}
    order, _, blocks, tree = read(page, confirmed)
    tokens = in_order(order)
    found = tokens
    for at in rounds:
        found = told_apart(found, at)[0]

    def of_template(b: Block, t: int, role: int) -> bool:
        everywhere_only = signed and b.place.main
        if t in told:
            return in_class.get(role, 0) >= (pages if everywhere_only else 1)
        return t in (everywhere if everywhere_only else fixed)

    own = [b for b, t, role in zip(order, tokens, found, strict=True) if isinstance(b, Block)
           and (signed and b.place.main and b.prose or not of_template(b, t, role))]
    main = [b for b in own if signed and b.place.main]
    rest = [b for b in own if not (signed and b.place.main)]
    plain = [b for b in rest if not (pages and b.place.marked)]
    if main and sum(len(b.text) for b in plain) <= TEASER * sum(len(b.text) for b in main):
        return "\n\n".join(b.text for b in main)
    rest = plain or rest
    inside = container(rest, tree)
    return "\n\n".join(b.text for b in rest if b.place.node in inside)


def _orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens and marks of every page, how often each occurs, the sum of its places, and the places' tokens by index."""
    for b in batches:
        rows = []
        for u, h in zip(b["host"], b["html"], strict=True):
            own, marks, order = page_order(h or "")
            counts, index, at = Counter(order), {}, {}
            seq = [index.setdefault(t, len(index)) for t in order]
            for i, t in enumerate(order):
                at[t] = at.get(t, 0) + i
            keys = [*index, *marks]
            rows.append((u, own, xxhash.xxh3_64_intdigest(repr((keys, seq, sorted(marks.items())))) - (1 << 63), keys,
                         [*(counts[t] for t in index), *marks.values()], [*(at[t] for t in index), *[0] * len(marks)],
                         [False] * len(index) + [True] * len(marks), seq))
        yield pd.DataFrame(rows, columns=["host", "page", "mix", "token", "n", "at", "mark", "seq"])


def orders(pages: DataFrame) -> DataFrame:
    """The pages of different own text of every host with their tokens in order."""
    x = pages.select(host().alias("host"), "html").mapInPandas(
        _orders, "host string, page long, mix long, token array<long>, n array<int>, at array<long>, mark array<boolean>, seq array<int>")
    one = F.min_by(F.struct("token", "n", "at", "mark", "seq"), "mix").alias("x")  # copies are one page
    return written(x.groupBy("host", "page").agg(one).select("host", "page", "x.*"))


def _classes(x: DataFrame, *keys: str) -> DataFrame:
    """Tokens with equal vectors by host, in the order of their places."""
    member = F.sort_array(F.collect_list(F.struct("at", "token")))
    return x.groupBy("host", *keys, "n_pages", "total", "vector").agg(F.transform(member, lambda m: m["token"]).alias("tokens"))


def _templates(distinct: DataFrame) -> DataFrame:
    x = distinct.select("host", "page", F.explode(F.arrays_zip("token", "n", "at", "mark")).alias("t")).select("host", "page", "t.*")
    vectors = written(x.groupBy("host", "token", "mark").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("total"), F.sum("at").alias("at"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector")).where("n_pages > 1"))
    size = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    # most pages of a host: at most twice the tokens of a page are left
    common = vectors.join(size, "host").where("mark or 2 * n_pages > pages")
    valid = _classes(common, "mark").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("mark", "n_pages", "total", "tokens"))).alias("template"))
    return size.join(valid, "host", "left")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, template): pages of different text and the classes of every host; one page has none."""
    return _templates(orders(pages))


def _steps(batch: pd.DataFrame) -> Iterator[tuple[str, int, list[int], list[dict], set[int]]]:
    """(host, page, roles after all rounds but the last, places of the last round, the host's class tokens) of the pages of a batch."""
    known = {}
    for u, page, tokens, seq, rounds, common in zip(*(batch[c] for c in ("host", "page", "token", "seq", "rounds", "common")), strict=True):
        if u not in known:
            known[u] = [places(classes) for classes in rounds], set(map(int, common))
        tables, members = known[u]
        names = [int(t) for t in tokens]
        base = [names[i] for i in seq]
        roles = base
        for at in tables[:-1]:
            roles = told_apart(roles, at)[0]
        yield u, page, base, roles, tables[-1], members


def _wrong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, class): classes of the last round that a page shows not to be ordered and nested."""
    for b in batches:
        found = {(u, c) for u, _, _, roles, at, _ in _steps(b) for c in told_apart(roles, at)[1]}
        yield pd.DataFrame(sorted(found), columns=["host", "class"])


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of the roles that the last round tells apart, over the pages of a batch."""
    for b in batches:
        sums = {}
        for u, page, base, roles, at, members in _steps(b):
            here = {}
            for i, (t, r) in enumerate(zip(base, told_apart(roles, at)[0], strict=True)):
                if t in members:
                    x = here.setdefault((t, r), [0, 0])
                    x[0] += 1
                    x[1] += i
            for (t, r), (n, places_sum) in here.items():
                x = sums.setdefault((u, t, r), [0, 0, 0, 0])
                x[0] += 1
                x[1] += n
                x[2] += places_sum
                x[3] ^= _role(page, n, 0)
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "base", "token", "n_pages", "total", "at", "vector"])


def nested(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(host, rounds, roles): the ordered and nested classes of each round, and (role, token, n_pages) of the
    roles on most pages that they tell apart; hosts without such classes are left out."""
    own = "filter(template, c -> NOT c.mark)"
    measures = {"classes": "size(x)", "members": "size(flatten(transform(x, c -> c.tokens)))",
                "occurrences": "aggregate(x, 0L, (s, c) -> s + c.total)"}
    state = written(found.where("template IS NOT NULL").withColumn("x", F.expr(own)).select(
        "host", "pages", F.expr("flatten(transform(x, c -> c.tokens))").alias("common"),
        F.expr("array(transform(filter(x, c -> size(c.tokens) > 1), c -> c.tokens))").alias("rounds"),
        *[F.expr(e).cast("long").alias(c) for c, e in measures.items()]))
    ready, order = [], distinct.select("host", "page", "token", "seq")
    while not state.isEmpty():
        x = order.join(state.select("host", "common", "rounds"), "host")
        bad = x.mapInPandas(_wrong, "host string, class long").groupBy("host").agg(F.collect_set("class").alias("bad"))
        kept = F.expr("filter(element_at(rounds, -1), c -> bad IS NULL OR NOT array_contains(bad, c[0]))")
        before = F.expr("slice(rounds, 1, size(rounds) - 1)")
        state = written(state.join(bad, "host", "left").withColumn("rounds", F.concat(before, F.array(kept))).drop("bad"))
        x = order.join(state.select("host", "common", "rounds"), "host")
        roles = x.mapInPandas(_vectors, "host string, base long, token long, n_pages long, total long, at long, vector long") \
            .groupBy("host", "token", "base").agg(*[F.sum(c).alias(c) for c in ("n_pages", "total", "at")], F.bit_xor("vector").alias("vector"))
        roles = written(roles.join(state.select("host", "pages"), "host").where("2 * n_pages > pages"))
        told = roles.groupBy("host").agg(F.collect_list(F.struct(F.col("token").alias("role"), F.col("base").alias("token"), "n_pages")).alias("roles"))
        now = _classes(roles).groupBy("host").agg(
            F.sort_array(F.collect_list(F.when(F.size("tokens") > 1, F.col("tokens")))).alias("last"), F.count(F.lit(1)).alias("now_classes"),
            F.sum(F.size("tokens")).alias("now_members"), F.sum("total").alias("now_occurrences"))
        same = " AND ".join(f"{c} <=> now_{c}" for c in measures)
        state = written(state.join(told, "host", "left").join(now, "host", "left").withColumn("same", F.expr(same)))
        ready.append(state.where("same OR roles IS NULL").select("host", "rounds", "roles"))  # no role more
        state = state.where("NOT same AND roles IS NOT NULL").select(
            "host", "pages", "common", F.concat("rounds", F.array("last")).alias("rounds"), *[F.col(f"now_{c}").alias(c) for c in measures])
    out = found.sparkSession.createDataFrame(
        [], "host string, rounds array<array<array<long>>>, roles array<struct<role: long, token: long, n_pages: long>>")
    for x in ready:
        out = out.unionByName(x)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    distinct = orders(pages)
    found = written(_templates(distinct))  # apart, so that the join may be broadcast or split by its size
    found = written(found.join(nested(distinct, found), "host", "left"))
    x = pages.withColumn("host", host()).join(found, "host", "left")

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            known, out = {}, []
            for u, h, n, c, rounds, roles in zip(*batch, strict=True):
                if u not in known:
                    known[u] = (list(c) if c is not None else [], [places(x) for x in rounds] if rounds is not None else [],
                                [(r["role"], r["token"], r["n_pages"]) for r in roles] if roles is not None else [])
                template, tables, told = known[u]
                out.append(main_text(h or "", template, int(n) if n == n and n else 0, u != "", tables, told))
            yield pd.Series(out, dtype=object)

    out = x.select("page_id", "url", text("host", "html", "pages", "template", "rounds", "roles").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
