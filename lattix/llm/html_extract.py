"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags and text runs, each told apart by its path of
enclosing tags.  Over the pages of one host, a token's occurrence vector says how often
each page has it; tokens of one vector form an equivalence class.  Classes that
occur on nearly all of a host's distinct pages and are large enough are its template: the
skeleton that pages share, nested as its elements are.  What lies between template tokens are slots; constant text is the
template's own and is left out.  The host's pages then tell which slots are the article's: from the root, the walk goes
down into the element that holds most of the unlinked text and every varying top heading, until the text is
spread over several elements or a page's own markup declares the article; elements beside it with a small part of the text are
not the article's.  Elements without class and id are told apart by their place among their siblings.

A page whose markup declares its article (an article or main element, a class that says so; all such
elements count) is read by that; else the host's slots decide; words of classes leave out menus, adverts, comments and the
like wherever they stand.

Vectors are never gathered: a token's vector is an exclusive-or of hashes of (page, count), so
classes are two keyed aggregations with map-side combine, and a host with a third of
all pages is no larger than any other to a task.  Exact copies of a page count once.  Template
tables are broadcast only if counted small, else joined by host.

Defined results: null html is an empty page (empty text); null or unparsable urls are one host; a host of
fewer than `support` distinct pages has no template and its pages are read by roles alone; repeated rows
give repeated rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattix.llm.common import row_count
from lattix.session import cut

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">]+)*+)>""")
CUT_OFF = re.compile(r"""</?[^\s<>]*(?:\s*[^\s<>]*|\s[^<>]*=[^<>]*)""")  # a tag whose end is missing, by its attributes or for want of more
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp", "noembed", "noframes", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("html body div section center main article table tbody tr td form".split())
PLACED = set("div section center table tr td".split())
PART = 0.1
DROP = set("head nav footer aside form button select menu dialog search label fieldset audio video".split())
CLOSES_P = BLOCK - {"body", "html"}
STRONG = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments commentlist respond reply replies discussion disqus related recommended recommendations share sharing social newsletter subscribe signup cookie cookies consent gdpr popup modal overlay breadcrumb breadcrumbs pagination pager promo promotion nav navbar navigation menu".split())
WEAK = set("sidebar footer header masthead banner notice notices alert toolbar widget widgets login search topbar bottombar skip hidden tags meta byline toc".split())
GOOD = set("article content entry post story main body text page".split())
MAIN_CLASS = {("article",), ("main",), ("content",), ("main", "content"), ("article", "body"), ("entry", "content"), ("post", "content"), ("post", "body"), ("story", "body"), ("article", "content"), ("post",), ("story",), ("entry",)}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OUT, PLAIN, MAIN = 0, 1, 2


def _attributes(s: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(s)} if "=" in s or s.strip(" /") else {}


def role(tag: str, attrs: dict[str, str], inside: int) -> int:
    """OUT, PLAIN or MAIN for an element by its tag and attributes; inside is its parent's."""
    if inside == OUT or tag in DROP:
        return OUT
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return OUT
    kind = attrs.get("role", "").lower()
    if kind in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"):
        return OUT
    named = [tuple(w.lower() for w in NAME.findall(c)) for c in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    words = {w for c in named for w in c}
    if tag in ("body", "html"):
        return inside
    if words & STRONG and not (tag in ("article", "main") and not words & {"comment", "comments", "reply", "related", "sponsored", "advert", "ad"}):
        return OUT
    if tag in ("article", "main") or kind in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody":
        return MAIN
    if tag == "header" and inside != MAIN:
        return OUT
    if words & WEAK and not words & GOOD and inside != MAIN:
        return OUT
    if inside == MAIN:
        if words & (WEAK - {"header", "hidden", "meta", "tags", "text"}) and not words & GOOD:
            return OUT
        return MAIN
    return MAIN if any(c in MAIN_CLASS for c in named) else PLAIN


TEXT, ELEMENT, OPEN, HEADING, DECLARED = range(5)


class Tokens:
    """A page's tokens: how often each occurs, its parent, its kind, and the unlinked text in it."""

    def __init__(self) -> None:
        self.times: Counter = Counter()
        self.parent: dict[int, int] = {}
        self.kind: dict[int, int] = {}
        self.plain: Counter = Counter()

    def add(self, path: int, what: str, kind: int) -> int:
        h = xxhash.xxh64_intdigest(f"{path}|{what}".encode("utf-8", "surrogatepass"))
        h = h - (1 << 64) if h >> 63 else h
        self.times[h] += 1
        if h not in self.kind:
            self.parent[h], self.kind[h] = path, kind
        return h

    def total(self) -> None:
        """Makes `plain` of elements include what lies in them; parents were added before their children."""
        for h in reversed(self.kind):
            if self.kind[h] != TEXT and self.plain[h] and self.parent[h]:
                self.plain[self.parent[h]] += self.plain[h]


def parse(page: str | None, keep: int | None = None, drop: frozenset | set = frozenset()) -> tuple[list[tuple], Tokens]:
    """Text runs as (block, role, link, in region, token, text), and the page's tokens.

    The region is the element of token keep without the elements of tokens in drop.
    """
    t, n, at = page or "", len(page or ""), 0
    stack: list[tuple] = [("", PLAIN, 0, False, False, Counter())]  # tag, role, path hash, in link, in region, children by tag
    runs, tokens, block = [], Tokens(), 0

    while at < n:
        lt = t.find("<", at)
        stop = n if lt < 0 else lt
        if stop > at:
            _, r, path, link, within, _ = stack[-1]
            text = t[at:stop]
            if r != OUT and not text.isspace():
                own = text.strip()
                runs.append((block, r, link, within, h := tokens.add(path, own, TEXT), text))
                if not link:
                    tokens.plain[h] += len(own)
                    tokens.plain[path] += len(own)
            elif r != OUT:
                runs.append((block, r, link, within, None, text))
            at = stop
            continue
        if t.startswith("<!--", at):
            end = t.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if t.startswith(("<!", "<?"), at):
            end = t.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(t, at) or LOOSE.match(t, at)
        if not m:
            if at + 1 < n and (t[at + 1].isalpha() or t[at + 1] == "/") and CUT_OFF.fullmatch(t, at):
                break
            _, r, path, link, within, _ = stack[-1]
            if r != OUT:
                runs.append((block, r, link, within, None, "<"))
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            if tag in BLOCK:
                block += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(t, at)
            if not m[3].rstrip().endswith("/"):
                at = end.end() if end else (at if tag in ("svg", "math", "object", "canvas") else n)
            continue
        if tag == "br":
            runs.append((block, stack[-1][1], stack[-1][3], stack[-1][4], None, " "))
            continue
        if tag in BLOCK:
            block += 1
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            if tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "menu", "select", "tr") and stack[i][0] != tag:
                        break
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        attrs = _attributes(m[3])
        _, inside, path, link, within, children = stack[-1]
        r = role(tag, attrs, inside)
        name = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        if name == " " and tag in PLACED:
            children[tag] += 1
            name = str(children[tag])
        declared = r == MAIN and inside != MAIN
        kind = DECLARED if declared else HEADING if tag == "h1" else OPEN if tag in CONTAINER and r != OUT else ELEMENT
        here = tokens.add(path, f"<{tag} {name}", kind)
        stack.append((tag, r, here, link or tag == "a", (within or here == keep) and here not in drop, Counter()))
    tokens.total()
    return runs, tokens


def region(template: list[tuple[int, int, int, int]]) -> tuple[frozenset, int | None, frozenset]:
    """(constant text tokens, token of the element that holds the article, tokens of elements in it that are not the article's).

    template: (token, parent, kind, plain) of a host's template tokens; plain is the unlinked text over all pages.
    """
    constant = frozenset(h for h, _, kind, _ in template if kind == TEXT)
    parent = {h: up for h, up, kind, _ in template if kind != TEXT}
    plain = {h: much for h, _, kind, much in template if kind != TEXT}
    kinds = {h: kind for h, _, kind, _ in template}
    for h, up, kind, much in template:
        while kind == TEXT and up in parent:
            plain[up] -= much
            up = parent[up]
    below: dict[int | None, list[int]] = {}
    for h in sorted(parent):
        below.setdefault(parent[h] if parent[h] in parent else None, []).append(h)

    def headed(h: int) -> bool:
        return (kinds[h] == HEADING and plain[h] > 0) or any(map(headed, below.get(h, ())))

    at: int | None = None
    while at is None or kinds[at] != DECLARED:
        inner = [h for h in below.get(at, ()) if kinds[h] in (OPEN, DECLARED) and plain[h] > 0]
        if not inner:
            break
        best = max(inner, key=lambda h: plain[h])
        whole = plain[at] if at is not None else sum(plain[h] for h in inner)
        if plain[best] * 2 < whole or any(headed(h) for h in below[at] if h != best):
            break
        at = best
    if at is None or kinds[at] == DECLARED:
        return constant, at, frozenset()
    small = [h for h in below.get(at, ()) if kinds[h] == OPEN and plain[h] < PART * plain[at] and not headed(h)]
    return constant, at, frozenset(small)


def main_text(page: str | None, constant: frozenset | set = frozenset(), keep: int | None = None, drop: frozenset | set = frozenset()) -> str:
    """The article's slots as text, by region() of the host; a page that declares its article is read by that."""
    runs, _ = parse(page, keep, drop)
    declared = any(r == MAIN and tok is not None and tok not in constant for _, r, _, _, tok, _ in runs)
    inside = not declared and any(within and r != OUT and tok is not None and tok not in constant for _, r, _, within, tok, _ in runs)
    out, block, parts, links = [], None, [], [0, 0]

    def flush():
        text = " ".join(_html.unescape("".join(parts)).split())
        if text and (declared or links[1] * 2 <= links[0]):
            out.append(text)

    for b, r, link, within, tok, text in runs:
        if r == OUT or (declared and r != MAIN) or (inside and not within) or (tok is not None and tok in constant):
            continue
        if b != block:
            flush()
            block, parts, links = b, [], [0, 0]
        parts.append(text)
        links[0] += len(text.strip())
        links[1] += len(text.strip()) * link
    flush()
    return "\n".join(out)


def templates(pages: DataFrame, support: int, share: float, least: int) -> DataFrame:
    """(host, tokens): the tokens of large, frequent equivalence classes, each with parent, kind and unlinked text.  pages: (host, html)."""

    facts = ["times", "parent", "kind", "plain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(h.as_py())[1] for h in b.column(1)]
            lists = [[[x.times[h] for h in x.kind] for x in found], [list(x.parent.values()) for x in found], [list(x.kind.values()) for x in found], [[x.plain[h] for h in x.kind] for x in found]]
            longs = [pa.array(v, pa.list_(pa.int64())) for v in ([list(x.kind) for x in found], *lists)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *longs], names=["host", "page", "token", *facts])

    distinct = pages.withColumn("page", F.xxhash64("html"))
    parsed = distinct.select("host", "html", "page").mapInArrow(run, "host string, page bigint, token array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in facts))
    rows = parsed.select("host", "page", F.explode_outer(F.arrays_zip("token", *facts)).alias("x")).select("host", "page", "x.*").where("token is not null").distinct()
    vectors = rows.groupBy("host", "token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.min("parent").alias("parent"), F.max("kind").alias("kind"), F.sum("plain").alias("plain"))
    total = pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= support)
    # a host counts from `support` pages on, so rarer tokens are in no template: they go before the join, not a host's whole vocabulary by host
    frequent = vectors.where(F.col("n") >= share * support).join(total, "host").where(F.col("n") >= share * F.col("pages"))
    return frequent.groupBy("host", "n", "vector").agg(F.collect_list(F.struct("token", "parent", "kind", "plain")).alias("class")).where(F.size("class") >= least).groupBy("host").agg(F.flatten(F.collect_list("class")).alias("tokens"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: int = 10, share: float = 0.9, least: int = 3, broadcast_rows: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    known = cut(templates(rows.where("html is not null").select("host", "html"), support, share, least))
    side = F.broadcast(known) if row_count(known) <= broadcast_rows else known
    kind = pages.schema[page_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple] = {}
        for b in batches:
            out = []
            for h, page, toks in zip(b.column(2).to_pylist(), b.column(3), b.column(4)):
                if h not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[h] = region([tuple(x.values()) for x in toks.as_py() or ()])
                out.append(main_text(page.as_py(), *seen[h]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["id", "url", "text", "n_chars"])

    schema = StructType([StructField("id", kind), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.join(side, "host", "left").select("id", "url", "host", "html", "tokens").mapInArrow(run, schema).withColumnRenamed("id", page_id)


def query(spark, sf_dir: str) -> DataFrame:
    from lattix.session import read_table

    return extract(read_table(spark, sf_dir, "pages"))
