"""Main text of web pages: nearest-URL page differencing, and what pages say of their own structure.

1. A page is cut into lines: blocks of visible text, in page order.
2. Pages are sorted by host and URL path, and each is paired with the neighbour of its host whose path takes fewer edits
   (of equal ones, with the page before). The lines of both are aligned by a longest common subsequence. Shared lines
   are template and are deleted, unless the pages are near copies of each other; then the other neighbour is taken.
   Lines of a marked article (an article or main element) aren't deleted: copies of articles have neighbouring URLs.
3. Of the lines that are left, those of elements that say that they are no content (menus, footers, forms and the like,
   or so named by a whole word of class, id or role) go; where a page marks its article, so do those outside of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import per_row, read, small_batches, written

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|button|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\s|/(?!>))(?:\"[^\"]*\"|'[^']*'|[^'\">])*)?/?>|<[!?][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that don't hold content; a header only outside of the article.
LEFT_OUT = {"nav", "footer", "aside", "form", "header", "menu", "dialog"}
#: Classes, ids and roles that say the same.
NOT_CONTENT = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation"
    " newsletter notice overlay pager pagination popup promo recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Parts of a name of several parts that make it a state, or the frame of what stands beside such an element.
STATES = set("has with without no not is open closed enabled disabled layout page wrap content main body".split())
PARTS = re.compile(r"[-_:]+|(?<=[a-z0-9])(?=[A-Z])")
MAIN = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br td th".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may lack: they end where one of their kind, or for a paragraph any block, begins, or with their parent.
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th"}
NEAR_COPY, NEAR_WORDS = 0.8, 0.2
#: Deletions of at most so many bytes are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def lines_of(page: str | None) -> list[tuple[str, bool, bool]]:
    """Lines of a page: text, whether structure keeps it, whether it stands in a marked article."""
    page = page or ""
    lines: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []
    part: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, its number, whether it says that it's no content
    out: tuple[int, ...] = ()  # those of the stack that say so
    main: tuple[int, ...] = ()
    ended: set[int] = set()  # elements that say so, and end: without an end they can't be left out
    mains: dict[int, tuple[int, ...]] = {}  # elements that mark an article, and what says that they are no content
    n = at = 0

    def end() -> None:
        if part:
            line = " ".join(html.unescape("".join(part)).split())
            part.clear()
            if line:
                lines.append((line, out, main))

    def pop(to: int, explicit: bool) -> None:
        nonlocal out, main
        for i in range(len(stack) - 1, to - 1, -1):
            tag, number, odd = stack.pop()
            if odd:
                out = out[:-1]
                if i == to and explicit or tag in ENDS_ITSELF:
                    ended.add(number)
            if tag in MAIN:
                main = main[:-1]

    for m in MARKUP.finditer(page):
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in INLINE:
            if tag in ("br", "td", "th"):
                part.append(" ")
            if tag != "span":
                continue
        else:
            end()
        if tag in VOID:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][2]:
                        end()
                    pop(i, True)
                    break
            continue
        if stack and stack[-1][0] in ENDS_ITSELF and (stack[-1][0] == tag or stack[-1][0] == "p" and tag != "span"):
            pop(len(stack) - 1, False)
        odd = tag in LEFT_OUT and not (tag == "header" and main) or bool(m[4]) and tag not in ("body", "html") and named_so(m[4], bool(main))
        n += 1
        if odd:
            end()
            out += (n,)
        stack.append((tag, n, odd))
        if tag in MAIN:
            mains[n] = out
            main += (n,)
    part.append(page[at:])
    end()
    # an article within what is no content is one only if there is no other
    free = {k for k, inside in mains.items() if not ended.intersection(inside)}
    held = set() if free else {x for inside in mains.values() for x in inside}
    free = free or set(mains)
    found = []
    for line, inside, marks in lines:
        in_main = not free.isdisjoint(marks)
        found.append((line, not any(x in ended and x not in held for x in inside) and (in_main or not free), in_main))
    return found


def named_so(attributes: str, in_main: bool = False) -> bool:
    """Whether a class, id or role says that an element is no content: by its whole name, or by a part of it ("related-posts", "adSlot").

    A name whose first or last part tells a state or a frame says nothing ("has-sidebar", "comments-open"); in an article
    neither does a part "header", as its title stands there.
    """
    for m in NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            if name.lower() in NOT_CONTENT:
                return True
            parts = [x.lower() for x in PARTS.split(name) if x]
            if len(parts) > 1 and not STATES.intersection((parts[0], parts[-1])) and any(x in NOT_CONTENT and not (in_main and x == "header") for x in parts):
                return True
    return False


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit vectors with one bit for each line of b."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append(i)
    return out[::-1]


OUTLINED = "page_id long, url string, lines array<string>, ids array<long>, words array<int>, kept array<boolean>, open array<boolean>"


def outlined(batch: pd.DataFrame) -> pd.DataFrame:
    """lines and, for each: a hash, its words, whether structure keeps it, whether differencing may delete it."""
    found = [lines_of(x) for x in batch["html"]]
    out = batch[["page_id", "url"]].copy()
    out["lines"] = [[x for x, _, _ in own] for own in found]
    out["ids"] = [[xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x, _, _ in own] for own in found]
    out["words"] = [[x.count(" ") + 1 for x, _, _ in own] for own in found]
    out["kept"] = [[k for _, k, _ in own] for own in found]
    out["open"] = [[not m for _, _, m in own] for own in found]
    return out


def paired(outlines: DataFrame) -> DataFrame:
    """row, ids, words, kept, open, and of the nearest page of the same host, and of the other neighbour: ids_1, words_1, ids_2, words_2 (null: there is none)."""
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_replace("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    ordered = outlines.where("url is not null").select("row", "ids", "words", "kept", "open", host.alias("host"), path.alias("path")).orderBy("host", "path", "row")
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id()), "pages")
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    start = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ordered = ordered.withColumn("part", part).join(F.broadcast(start), "part").withColumn("at", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "start", "place")

    def neighbour(step: int, name: str) -> DataFrame:
        return ordered.select((F.col("at") + step).alias("at"), *[F.col(c).alias(f"{c}_{name}") for c in ("host", "path", "ids", "words")])

    both = ordered.join(neighbour(1, "b"), "at", "left").join(neighbour(-1, "a"), "at", "left")
    b, a = (F.when(F.col("host") == F.col(f"host_{x}"), F.levenshtein("path", F.col(f"path_{x}"))) for x in "ba")
    first = b.isNotNull() & (a.isNull() | (b <= a))
    pick = lambda c, x, y: F.when(first, F.when(x.isNotNull(), F.col(f"{c}_b" if x is b else f"{c}_a"))).otherwise(F.when(y.isNotNull(), F.col(f"{c}_a" if y is a else f"{c}_b")))
    return both.select("row", "ids", "words", "kept", "open", *[pick(c, b, a).alias(f"{c}_1") for c in ("ids", "words")], *[pick(c, a, b).alias(f"{c}_2") for c in ("ids", "words")])


def gaps(shared: list[int], n: int) -> list[tuple[int, int]]:
    ends = [*shared, n]
    return [(i + 1, j) for i, j in zip([-1, *shared], ends, strict=True)]


def template_of(ids: list[int], words: list[int], other: list[int], other_words: list[int]) -> list[int] | None:
    """Positions of the lines that two pages share; null for near copies: most lines are shared, and the others replace each other one by one."""
    shared = common_lines(ids, other)
    if len(shared) >= NEAR_COPY * len(ids):
        there, at = [], 0
        for i in shared:  # the same subsequence, as it stands in the other page
            at = other.index(ids[i], at) + 1
            there.append(at - 1)
        pairs = list(zip(gaps(shared, len(ids)), gaps(there, len(other)), strict=True))
        off = sum(abs(sum(words[a:b]) - sum(other_words[c:d])) for (a, b), (c, d) in pairs)
        if all(b - a == d - c for (a, b), (c, d) in pairs) and off <= NEAR_WORDS * sum(sum(words[a:b]) for (a, b), _ in pairs):
            return None
    return shared


def template_lines(batch: pd.DataFrame) -> pd.DataFrame:
    """row, keep: of the pages from which differencing deletes lines that structure keeps, which lines stay."""
    out = []
    for row in batch.itertuples():
        shared, ids, words = None, row.ids.tolist(), row.words.tolist()
        for other, other_words in ((row.ids_1, row.words_1), (row.ids_2, row.words_2)):
            if shared is None and other is not None:
                shared = template_of(ids, words, other.tolist(), other_words.tolist())
        gone = [i for i in shared or [] if row.open[i]]
        if any(row.kept[i] for i in gone):
            keep = row.kept.copy()
            keep[gone] = False
            out.append((row.row, keep))
    return pd.DataFrame(out, columns=["row", "keep"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id long, url string, text string, n_chars long, for every row of pages (page_id, url, html).

    Null html counts as empty and gives an empty text, as does a page without content. A page without url or alone on
    its host has no pair: structure alone decides. Rows that repeat a page have one result, whatever their pair: they
    are near copies. Elements that lack their end tag aren't left out. Character references are decoded, white space
    within a line becomes one space, lines are joined by an empty line. No rows give no rows. Other columns are ignored;
    texts and URLs are whole, of any length.
    """
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    outlines = written(pages.mapInPandas(per_row(outlined), OUTLINED).withColumn("row", F.monotonically_increasing_id()), "outlines")
    deleted = written(paired(outlines).mapInPandas(per_row(template_lines), "row long, keep array<boolean>"), "template")
    size = deleted.agg(F.coalesce(F.sum(F.size("keep") + 48), F.lit(0))).first()[0]
    found = outlines.join(F.broadcast(deleted) if size <= BROADCAST_BYTES else deleted, "row", "left")
    keep = F.arrays_zip("lines", F.coalesce("keep", "kept").alias("keep"))
    text = F.array_join(F.transform(F.filter(keep, lambda x: x["keep"]), lambda x: x["lines"]), "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
