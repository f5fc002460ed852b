"""Main text of web pages by union-free wrappers, one for each host.

A page becomes a stream of block tags and text slots (inline tags, scripts,
styles and comments are left out).  A wrapper is a union-free regular
expression over such tokens: a list of nodes, each a tag, a text slot or a
repeated group, and each required or optional.  The wrapper of a host starts
as one page; every further page is aligned with it, and a mismatch is resolved
in the way of a union-free grammar: text against other text becomes a slot,
a block that occurs again next to itself becomes a repeated group, and what
only one side has becomes optional.  Aligning two wrappers is the same
operation, so wrappers are folded inside every task and merged in two salted
steps after that: all pages count, and no task gets the pages of one host.

What is the same on a host's pages is its template, what differs is its content.
A block of text under one path is a constant of the wrapper if at least half of
the host's unlike pages have it, and ``TEMPLATE_PAGES`` of them at least (pages
with the same blocks count as one, so copies make no template).  Constants are
counted page by page over all pages, so they don't depend on the order in which
wrappers are merged.  Constants are left out of the text, but for headings; what
remains are slots.  A wrapper says how much text its slots hold and under which
elements they stand.  The main region of a host is its article or main element,
if most of its pages have one, and else the group of slots with most text; pages
without such an element have a wrapper and a group of their own.  Besides, a slot
is left out if it stands in navigation, header, footer, aside, form or the like,
or under a class, id or role that says advert, notice, sidebar, menu, comment and
so on: reader comments and adverts differ from page to page as an article does,
so no wrapper can tell them from it.

A null or empty page has an empty text; a page without tags is one block of
text.  Pages with a null or odd url share the host ''.  Pages of any length and
depth are read whole.  Rows that share an id are read each by itself.  Ties of
weight go to the path that is first by name; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .line_dedup import patience

#: Names of HTML elements and the words that mark page furniture.
INLINE = frozenset("a abbr acronym annotation b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mfrac mi mn mo mroot mrow msqrt mstyle msub msubsup msup mtext q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template svg iframe object head textarea select canvas".split())
RAW = frozenset("script style noscript template iframe textarea".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base col embed hr input link meta param source track".split())
NAMED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disclaimer|footer|masthead|menu|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|related|replies|respond|reviews|share|sharing|sidebar|social|sponsor|sponsored|subscribe|widget)(?:$|[\s_-])", re.I)
HEADED = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?:$|[\s_-])", re.I)
#: An end tag of these also ends what is open inside them.
SECTIONS = frozenset("article aside body div dl fieldset figure footer form header html main nav ol section table ul".split())

#: Prose: a class name says nothing about these, only about what groups them.
PROSE = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th tr".split())

TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Attributes up to the end of a tag; a quote counts only right behind an equals sign, and only if it is closed.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
REGION = re.compile(r"<(?:article|main)(?![\w:-])", re.I)
HEADING = re.compile(r"(?:^|>)h[1-6][!^]?$")
#: Unlike pages of a host that must have a block before it can be of its template, and their share of all.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.5
SPACE = re.compile(r"\s+")
MAX_DEPTH = 64


def mark(tag: str, attributes: str) -> str:
    """The tag, with ``!`` if its class, id or role is that of page furniture, ``^`` if that of a header."""
    names = " ".join(a or b or c for _, a, b, c in NAMES.findall(attributes)) if attributes and tag not in PROSE else ""
    if tag in FURNITURE or names and NAMED.search(names):
        return tag + "!"
    return tag + "^" if tag == "header" or names and HEADED.search(names) else tag


def tags(page: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, is an end tag, name, attributes) of the tags of a page; comments and the like have no name, and what is
    skipped belongs to its start tag.  A tag that never ends takes the rest of the page with it.  Each character is looked at
    a bounded number of times: where quotes hide every end, they don't count from there on."""
    at, quotes, endless = 0, True, set()
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if m := TAG.match(page, at):
            if quotes and (rest := REST.match(page, m.end())):
                attributes, at = rest[1], rest.end()
            else:
                quotes = False
                end = page.find(">", m.end())
                attributes, at = page[m.end() : end if end >= 0 else len(page)], end + 1 if end >= 0 else len(page)
            name = m[2].lower()
            if name in SKIPPED and not m[1] and not attributes.endswith("/") and name not in endless:
                if end := re.compile(rf"</{name}\s*>", re.I).search(page, at):
                    at = end.end()
                elif name in RAW:
                    at = len(page)
                else:
                    endless.add(name)
            yield start, at, bool(m[1]), name, attributes
        elif page.startswith(("<!", "<?"), start):
            close = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(close, start + 2)
            at = end + len(close) if end >= 0 else len(page)
            yield start, at, False, None, ""


def parse(page: str | None) -> list[tuple[str, str]]:
    """(path, text) of the blocks of a page, in order; a path is the open block tags, outermost first.  Below
    ``MAX_DEPTH`` it goes on with the tags alone that say what to keep (furniture, header, article, main)."""
    if not page:
        return []
    blocks: list[tuple[str, str]] = []
    stack: list[str] = []
    paths: list[str] = [""]
    opened: Counter = Counter()
    pieces: list[str] = []
    path = ""

    def close() -> None:
        if pieces:
            text = SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                blocks.append((path, text))

    def cut(n: int) -> None:
        opened.subtract(s.rstrip("!^") for s in stack[n:])
        del stack[n:], paths[n + 1 :]

    at = 0
    for start, end, ends, tag, attributes in tags(page):
        if start > at:
            pieces.append(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in SKIPPED:
            close() if tag not in ("svg", "canvas") else None
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            continue
        close()
        if ends:
            for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                name = stack[i].rstrip("!^")
                if name == tag:
                    cut(i)
                if name == tag or tag not in SECTIONS and name in SECTIONS:
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            while stack and stack[-1].rstrip("!^") not in SECTIONS:  # p, li, h1 ... end where a block begins
                if tag in ("ul", "ol", "table", "p", "div") and stack[-1].rstrip("!^") in ("li", "td", "th", "dd", "tr", "tbody", "blockquote"):
                    break
                cut(len(stack) - 1)
            one, above = mark(tag, attributes), paths[-1]
            told = len(stack) < MAX_DEPTH or (one[-1] in "!^" or one in MAIN) and one not in above.split(">")
            stack.append(one)
            paths.append((f"{above}>{one}" if above else one) if told else above)
            opened[tag] += 1
        path = paths[-1]
    if at < len(page):
        pieces.append(page[at:])
    close()
    return blocks


def block_key(path: str, text: str) -> int:
    """A 64-bit hash of a block of text under its path."""
    import xxhash

    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") - (1 << 63)


# A node: [path, is slot, optional, repeated, pages, characters, hash of the text]
def expression(blocks: list[tuple[str, str]]) -> list[list]:
    """The wrapper of one page: neighbours with one path are a repeated group."""
    nodes: list[list] = []
    for path, text in blocks:
        if nodes and nodes[-1][0] == path:
            last = nodes[-1]
            last[1], last[3], last[5], last[6] = True, True, last[5] + len(text), 0
        else:
            nodes.append([path, False, False, False, 1, len(text), block_key(path, text)])
    return fold(nodes)


def fold(nodes: list[list]) -> list[list]:
    """Squares of two to four nodes that stand next to themselves become one repeated group each."""
    for width in (2, 3, 4):
        out: list[list] = []
        for node in nodes:
            out.append(node)
            if len(out) >= 2 * width and all(out[-width + i][0] == out[-2 * width + i][0] for i in range(width)):
                for i in range(width):
                    meet(out[-2 * width + i], out[-width + i], same_page=True)
                    out[-2 * width + i][3] = True
                del out[-width:]
        nodes = out
    return nodes


def meet(a: list, b: list, same_page: bool = False) -> None:
    """Takes node b into the node a with the same path: different texts make a slot."""
    a[1] = a[1] or b[1] or a[6] != b[6]
    a[2] = a[2] or b[2]
    a[3] = a[3] or b[3]
    a[4] = max(a[4], b[4]) if same_page else a[4] + b[4]
    a[5] += b[5]
    a[6] = 0 if a[1] else a[6]


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions of equal paths, ascending on both sides: by unique paths first, and between them each
    path with the next one like it, so that no table of all pairs is made."""
    out, a0, b0 = [], 0, 0
    for i, j in [*patience(a, b), (len(a), len(b))]:
        after: dict[str, list[int]] = {}
        for k in range(a0, i):
            after.setdefault(a[k], []).append(k)
        at = a0
        for k in range(b0, j):
            there = after.get(b[k], [])
            if (n := bisect_left(there, at)) < len(there):
                out.append((there[n], k))
                at = there[n] + 1
        if i < len(a):
            out.append((i, j))
        a0, b0 = i + 1, j + 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what either wrapper matches: what only one side has becomes optional."""
    out: list[list] = []
    i = j = 0
    for x, y in [*matches([n[0] for n in a], [n[0] for n in b]), (len(a), len(b))]:
        for node in a[i:x] + b[j:y]:
            node[2] = True
            out.append(node)
        if x < len(a):
            meet(a[x], b[y])
            out.append(a[x])
        i, j = x + 1, y + 1
    return fold(out)


def furniture(path: str, inside_main: bool) -> bool:
    return "!" in path or "^" in path and not inside_main


def region(path: str) -> str | None:
    """The path down to the outermost article or main element, if any."""
    parts = path.split(">")
    for i, p in enumerate(parts):
        if p in MAIN:
            return ">".join(parts[: i + 1])
    return None


def main_under(wrapper: list[list]) -> dict:
    """The parent of the paths with most text."""
    weight: dict[str, int] = {}
    for path, _, _, _, _, size, _ in wrapper:
        if not furniture(path, False):
            parent = path.rpartition(">")[0]
            weight[parent] = weight.get(parent, 0) + size
    return {"under": max(sorted(weight), key=lambda p: weight[p])} if weight else {}


def roles(with_region: list, without: list) -> dict:
    """What to keep on a host, by the wrappers, numbers and regions of its pages with and without an article or
    main element: its main regions, if most pages have one, and for the others the paths with most text."""
    held = with_region[2]
    if held and max(held.values()) * 2 >= with_region[1] + without[1]:
        return {"regions": sorted(held)} | main_under(without[0])
    return main_under(with_region[0] + without[0])


def extract(blocks: list[tuple[str, str]], role: dict, bare: bool = True) -> str:
    """The main text of a page by the roles of its host; by its own if it has no match.  ``bare``: the page has
    neither article nor main, and so may be of another template than most pages of its host."""
    if template := role.get("template"):
        blocks = [(p, t) for p, t in blocks if HEADING.search(p) or block_key(p, t) not in template]
    kept = [t for p, t in blocks if "!" not in p and any(p == r or p.startswith(r + ">") for r in role.get("regions", ()))]
    if not kept and "under" in role and (bare or "regions" not in role):
        kept = [t for p, t in blocks if not furniture(p, False) and (p.rpartition(">")[0] == role["under"] or p.startswith(role["under"] + ">") or not role["under"])]
    if not kept:
        own = [t for p, t in blocks if "!" not in p and region(p)]
        kept = own or ([t for p, t in blocks if not furniture(p, False)] if bare or "regions" not in role else [])
    return "\n".join(kept)


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def constants(pages: DataFrame) -> DataFrame:
    """(host, template): the blocks that at least half of the unlike pages of a host have, as hashes.  There are at
    most as many as two average pages have blocks."""

    def apply(batches):
        import xxhash

        for batch in batches:
            for part in common.slices(batch, "html"):
                keys = [sorted({block_key(p, t) for p, t in parse(page) if "!" not in p and not HEADING.search(p)}) for page in part.column(1).to_pylist()]
                page = [xxhash.xxh3_64_intdigest(np.array(k, np.int64).tobytes()) - (1 << 63) for k in keys]
                yield pa.record_batch([part.column(0), pa.array(page, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["host", "page", "blocks"])

    unlike = pages.mapInArrow(apply, "host string, page long, blocks array<long>").groupBy("host", "page").agg(F.first("blocks").alias("blocks"))
    unlike = common.materialise(unlike, "unlike")
    totals = unlike.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= TEMPLATE_PAGES)
    met = unlike.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count("*").alias("met")).where(F.col("met") >= TEMPLATE_PAGES)
    found = met.join(totals, "host").where(F.col("met") >= TEMPLATE_SHARE * F.col("pages"))
    return found.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("block"))).alias("template"))


def wrappers(pages: DataFrame, salts: int = 16, flush: int = 2000) -> DataFrame:
    """(host, wrapper) of ``pages`` (host, html): folded in every task, merged by salt, then by host.  A host has two,
    one of its pages with an article or main element and one of the others, each with its number of pages and the
    pages of each region."""

    def folded(batches):
        found: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = parse(page)
                one = [expression(blocks), 1, dict.fromkeys((r for p, _ in blocks if "!" not in p and (r := region(p))), 1)]
                both = found.setdefault(host, [[[], 0, {}], [[], 0, {}]])
                k = not (page and REGION.search(page))
                both[k] = joined(both[k], one)
                if len(found) > flush:
                    yield packed(found)
                    found = {}
        yield packed(found)

    def joined(a: list, b: list) -> list:
        return [align(a[0], b[0]), a[1] + b[1], {r: a[2].get(r, 0) + b[2].get(r, 0) for r in a[2] | b[2]}] if a[1] and b[1] else a if a[1] else b

    def packed(found: dict[str, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array([json.dumps(v) for v in found.values()], pa.string())], names=["host", "wrapper"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total: list = [[[], 0, {}], [[], 0, {}]]
        for text in sorted(pdf["wrapper"]):
            total = [joined(a, b) for a, b in zip(total, json.loads(text), strict=True)]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [json.dumps(total)]})

    shape = "host string, wrapper string"
    first = pages.mapInArrow(folded, shape).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    return first.groupBy("host", "salt").applyInPandas(merged, shape).groupBy("host").applyInPandas(merged, shape)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"), host_of(url_col).alias("host"))

    def judged(pdf_batches):
        for batch in pdf_batches:
            out = [json.dumps(roles(*json.loads(w))) for w in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["host", "role"])

    found = wrappers(rows.select("host", "html")).mapInArrow(judged, "host string, role string").join(constants(rows.select("host", "html")), "host", "left")
    learned = common.materialise(found.select("host", "role", F.coalesce("template", F.lit("[]")).alias("template")), "wrappers")
    size = learned.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("role") + F.octet_length("template") + 100), F.lit(0))).first()[0]
    shape = "id long, url string, text string, n_chars long"

    def of_host(role: str, template: str) -> dict:
        return json.loads(role) | {"template": set(json.loads(template))}

    def texts(batch: pa.RecordBatch, role_of) -> pa.RecordBatch:
        out = [extract(parse(p), role_of(i), not REGION.search(p)) for i, p in enumerate(common.as_text(batch.column(2)).to_pylist())]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    if size <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r["host"]: of_host(r["role"], r["template"]) for r in learned.collect()})

        def apply(batches):
            for batch in batches:
                for part in common.slices(batch, "html"):
                    hosts = part.column(3).to_pylist()
                    yield texts(part, lambda i, hosts=hosts: shared.value.get(hosts[i], {}))

        out = rows.mapInArrow(apply, shape)
    else:  # hosts beyond the bound: join them, hot hosts dealt out by salt
        salts = 64
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(salts)).cast("int"))
        spread = learned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def apply(batches):
            for batch in batches:
                for part in common.slices(batch, "html"):
                    found, template = part.column(4).to_pylist(), part.column(5).to_pylist()
                    yield texts(part, lambda i, found=found, template=template: of_host(found[i] or "{}", template[i] or "[]"))

        out = salted.join(spread.hint("merge"), ["host", "salt"], "left").select("id", "url", "html", "host", "role", "template").mapInArrow(apply, shape)
    return out.withColumnRenamed("id", id_col)
