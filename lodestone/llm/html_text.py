"""Main text of web pages: the maximum-scoring run of words and tags, weighted from labelled pages."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements whose content is no text of the page.
_SKIPPED = frozenset("script style noscript template textarea svg iframe title select object canvas math audio video button label".split())
#: Those of them whose content is no markup, so that it goes on to the end tag or, without one, the end of the page.
_RAW = frozenset("script style textarea title iframe".split())
#: Those that stand in a line of text, which they part.
_CONTROLS = frozenset(("button", "label", "select", "textarea"))
#: What hides an element: the attribute, which is looked for outside of quoted values, or a style.
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"\shidden(?=[\s=/]|$)", re.I)
_INVISIBLE = re.compile(r"style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_BOUNDARY = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = _HEADINGS | frozenset("p blockquote pre li dd dt td th figcaption caption summary".split())
_CONTAINERS = _BOUNDARY - _HEADINGS - frozenset("p hr html head".split())
_ARTICLES = frozenset(("article", "main"))
_BOILERPLATE = frozenset("nav footer aside dialog menu".split())
#: Elements that, like class words, mark boilerplate unless they wrap the page's text.
_WRAPPERS = frozenset(("form", "fieldset"))
#: Words of class, id and role names that mark menus, adverts, notices, comments and the like, where labelled pages do not tell otherwise.
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments commentlist respond disqus cookie cookies consent gdpr notice banner popup modal overlay newsletter subscribe signup "
    "share sharing social related recommended widget pagination pager toolbar login search copyright complementary contentinfo dialog alert".split()
)
#: Words that say where or how a part stands and nothing of what it is.
_NEUTRAL = frozenset("left right top bottom inner outer wrapper wrap container content box block list item items section area bar panel main primary secondary col column row group holder header heading title text body".split())
_TOPS = frozenset(("header", "masthead"))
#: A context whose words are inside, or outside, by so much more often than not is judged by that alone.
SURE = 0.8
#: Pages that the weights are learned from, at most about.
LABELLED_PAGES = 2000


@dataclass
class Run:
    """A run of text between tags, or a tag: context is what its weight is looked up by."""

    context: str
    text: str = ""
    n_words: int = 0
    block: int = 0
    inside: bool = False
    boilerplate: bool = False
    marks: tuple[int, ...] = ()
    names: frozenset[str] = frozenset()
    structural: bool = False


@dataclass
class Page:
    runs: list[Run] = field(default_factory=list)
    labelled: bool = False


def _hides(rest: str) -> bool:
    low = rest.lower()
    return ("hidden" in low or "none" in low) and bool(_HIDDEN.search(_QUOTED.sub('""', rest)) or _INVISIBLE.search(rest))


def _end_of(page: str, name: str, at: int) -> int | None:
    """Where the element that was opened before at ends; None if it is not closed."""
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return tag.end()
    return None


def _closes(page: str, name: str, at: int, parent: str) -> int | None:
    """Where an element ends that was opened before at; None if nothing closes it before its parent ends."""
    end = _end_of(page, name, at)
    if end is None or not parent:
        return end
    above = _end_of(page, parent, at)
    return end if above is None or end <= above else None


def _is_listed(value: str, listed: frozenset[str]) -> bool:
    """Whether one of the names in a class, id or role is made of listed words, and neutral ones beside."""
    for name in value.strip("\"'").split():
        parts = _words_of(name)
        if any(w in listed for w in parts) and all(w in listed or w in _NEUTRAL for w in parts):
            return True
    return False


def _words_of(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]


def parse(page: str, listed: frozenset[str] = _MARKED) -> Page:
    """Runs of text and tags in page order. Unclosed elements, cut tags and stray ends are tolerated.

    Hidden elements are left out, and so is the content of media and controls; where nothing closes one before its parent ends,
    only its tag goes. A container with a name of listed words, or a form, is boilerplate unless it wraps the page's text: on a
    page without an article or main part outside such containers, those that hold one, or more than half
    of the words, are not.
    """
    out = Page()
    runs, stack = out.runs, []  # stack: (name, label, boilerplate, top, article, marks, marks of tops, words of names)
    none = ("", "", False, False, False, (), (), frozenset())
    n_marks, holders, clear = 0, set(), False
    at, block, leaf, link = 0, 0, "", False
    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text and not text.isspace():
            if "&" in text:
                text = entities.unescape(text)
            name, label, boilerplate, top, article, marked, tops, names = stack[-1] if stack else none
            context = f"{label}|{leaf}{'>a' if link else ''}"
            runs.append(Run(context, text, len(text.split()), block, article, boilerplate or top and leaf not in _HEADINGS, marked if leaf in _HEADINGS else marked + tops, names, boilerplate))
        elif text:
            runs.append(Run("", text, 0, block))
        if not found:
            _apply_marks(runs, holders, clear)
            return out
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        ends = bool(found["end"] or found["end2"])
        if name in _SKIPPED:
            closed = name in ("svg", "math") and (found["rest"] or found["rest2"] or "").endswith("/")
            if name in _RAW and not ends:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else at if name in _CONTROLS else len(page)
            elif not ends and not closed:
                at = _closes(page, name, at, stack[-1][0] if stack else "") or at
            if name in _CONTROLS:
                runs.append(Run("", " ", 0, block))
            continue
        rest = found["rest"] or found["rest2"] or ""
        if not ends and rest and name not in ("html", "body") and _hides(rest):
            close = _end_of(page, name, at)
            if close is not None:
                block, at = block + (name in _BOUNDARY), close
                continue
        up = stack[-1] if stack else none
        tag = Run(f"<{name}", block=block, inside=up[4], boilerplate=up[2], marks=up[5])
        runs.append(tag)
        if name == "br":
            runs.append(Run("", " ", 0, block))
        elif name == "a":
            link = not ends
        if name not in _BOUNDARY:
            continue
        block, link = block + 1, False
        leaf = name if name in _LEAVES and not ends else ""
        if name not in _CONTAINERS:
            continue
        if ends:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                del stack[depth:]
        else:
            if name in ("li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == name:
                stack.pop()
            values = _NAMES.findall(rest)
            marks = [w for value in values for w in _words_of(value)]
            up = stack[-1] if stack else none
            article = up[4] or name in _ARTICLES
            out.labelled |= name in _ARTICLES
            outer = name in ("body", "article", "main")
            boilerplate = up[2] or name in _BOILERPLATE
            top = up[3] or name == "header"
            marked, tops = up[5], up[6]
            if name in _WRAPPERS or not outer and any(_is_listed(value, listed) for value in values):
                n_marks, marked = n_marks + 1, (*marked, n_marks)
            elif not outer and name != "header" and not _TOPS.isdisjoint(marks):
                n_marks, tops = n_marks + 1, (*tops, n_marks)
            if article and not up[4] and not boilerplate:
                holders.update(marked)
                tops, clear = (), clear or not marked
            stack.append((name, ".".join([name, *marks[:2]]), boilerplate or top and not article, top, article, marked, tops, up[7].union(marks) if marks else up[7]))
            tag.marks = stack[-1][5] if len(stack[-1][5]) > len(tag.marks) else tag.marks
            tag.inside, tag.boilerplate = tag.inside or article, tag.boilerplate or stack[-1][2]


def _apply_marks(runs: list[Run], holders: set[int], clear: bool) -> None:
    """Make the runs of marked containers boilerplate, except of those that wrap the page's text."""
    void = set()
    if not clear:
        words, own = 0, Counter()
        for run in runs:
            if run.n_words and not run.boilerplate:
                words += run.n_words
                for mark in run.marks:
                    own[mark] += run.n_words
        void = holders or {mark for mark, n in own.items() if 2 * n > words}
    for run in runs:
        if run.marks and not run.boilerplate:
            run.boilerplate = not void.issuperset(run.marks)


@dataclass(frozen=True)
class Weights:
    """Score of a word by its context, of a tag by its name, with what holds for those never seen.

    Boilerplate inside the article or main part is cut out anyway and scores 0, so that it never splits the part.
    """

    words: dict[str, float]
    leaves: dict[str, float]
    tags: dict[str, float]
    listed: frozenset[str] = _MARKED
    word: float = 0.5
    tag: float = -0.5

    def leaves_out(self, run: Run) -> bool:
        """Whether a run is boilerplate: a menu, footer or aside always; else by its context where labelled pages are clear about it, and by its marks where not."""
        weight = self.words.get(run.context)
        if run.structural or weight is None or abs(weight) < SURE or not run.n_words:
            return run.boilerplate
        return weight < 0

    def of(self, run: Run) -> float:
        if self.leaves_out(run):
            return 0.0 if run.inside else -float(run.n_words) if run.n_words else self.tags.get(run.context, self.tag) if run.context else 0.0
        if not run.n_words:
            return self.tags.get(run.context, self.tag) if run.context else 0.0
        weight = self.words.get(run.context)
        return run.n_words * (self.leaves.get(run.context.partition("|")[2], self.word) if weight is None else weight)


def learn(counts: list[tuple[str, int, int]]) -> Weights:
    """Weights from (context, inside, outside): 2p - 1 for words with p the part inside, at most -0.01 for tags.

    Class words, led by a full stop, are listed as boilerplate if at least 200 words were seen under them and less than a
    20th of these inside; a listed one that holds more than half of its words inside is listed no more.
    """
    named = {c[1:]: (i, i + o) for c, i, o in counts if c.startswith(".") and i + o >= 200}
    listed = _MARKED.union(w for w, (i, n) in named.items() if 20 * i < n).difference(w for w, (i, n) in named.items() if 2 * i > n)
    counts = [x for x in counts if not x[0].startswith(".")]
    leaves: dict[str, list[int]] = {}
    for context, inside, outside in counts:
        if not context.startswith("<"):
            own = leaves.setdefault(context.partition("|")[2], [0, 0])
            own[0] += inside
            own[1] += outside
    share = {k: (i + 3) / (i + o + 4) for k, (i, o) in leaves.items()}
    words = {c: 2 * (i + 4 * share[c.partition("|")[2]]) / (i + o + 4) - 1 for c, i, o in counts if not c.startswith("<")}
    tags = {c: -0.01 - (o + 0.01) / (i + o + 1) for c, i, o in counts if c.startswith("<")}
    return Weights(words, {k: 2 * p - 1 for k, p in share.items()}, tags, listed)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of largest sum (the first of ties, empty if no sum is positive), by one scan."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region without its boilerplate, joined by an empty line."""
    runs = parse(page, weights.listed).runs
    start, end = best_region([weights.of(r) for r in runs])
    blocks: dict[int, list[str]] = {}
    for run in runs[start:end]:
        if run.text and not weights.leaves_out(run):
            blocks.setdefault(run.block, []).append(run.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for page in batch.column(0).to_pylist():
            parsed = parse(page)
            depth = 0
            if parsed.labelled:
                for run in parsed.runs:
                    if run.n_words:
                        side = inside if run.inside and not run.boilerplate else outside
                        side[run.context] += run.n_words
                        for name in run.names:
                            side[f".{name}"] += run.n_words
                        depth = run.inside and not run.boilerplate
                    elif run.context:
                        (inside if depth else outside)[run.context] += 1
    names = [*{**inside, **outside}]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["context", "inside", "outside"])


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", labelled_pages: int = LABELLED_PAGES) -> Weights:
    """Weights from at most about labelled_pages pages, drawn by hash, that mark their article or main part.

    The hash is of page_id and html, so that copies of a page are drawn each by itself. The sample, and
    with it the contexts in it, is bounded whatever the size of the table. Without labelled pages, words
    weigh 0.5 and tags -0.5.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).where("html IS NOT NULL")
    n = rows.count()
    part = min(1.0, labelled_pages / n) if n else 1.0
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "page_id", "html"), F.lit(1 << 30)) < part * (1 << 30)).select("html").repartition(4)
    counted = drawn.mapInArrow(_count, "context string, inside long, outside long").groupBy("context").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    return learn([(r["context"], r["i"], r["o"]) for r in counted.orderBy("context").collect()])


def extract(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """Replace html by text (main text, empty for null or where nothing scores above 0) and n_chars (code points).

    Other columns stay; columns that are named text or n_chars already are replaced. Whole pages
    are read, page by page, in bounded memory; equal pages have equal texts.
    """
    source = pages.drop("text", "n_chars")
    kept = [c for c in source.columns if c != html]
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x, shared.value) if x else "" for x in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*kept, "text", "n_chars"]
                )

    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.select(*kept, html).mapInArrow(run, schema)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, fit(pages))
