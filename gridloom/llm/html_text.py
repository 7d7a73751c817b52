"""HTML main text by line-block distribution.

Markup is stripped into lines: each block element starts a line, text inside it is joined. A line weighs as many
characters as it has outside links; lines inside containers that never hold an article (navigation, headers of the page,
footers, asides, forms, scripts, styles, notices, adverts, reader comments) weigh nothing, and such a container takes at
least as many lines as the window, as its markup does on a real page. Weights are summed over a sliding window of lines.
A surge point is where the window's sum leaves zero, a dive point where it comes back to zero; the text between them is
kept if at least half of it stands outside links. A container without article text that stands between lines of one
container doesn't part them. Article and main elements outside such containers raise the weight of their lines: what is
inside counts RAISED times. Text outside of them is judged like any other, whatever its size.

Containers without article text are told by element, role, and the words of class and id. A word that says what a container
has or allows rather than what it is (has-sidebar, no-nav, comments-open) tells nothing, nor does one whose last part names
article text (legal-news). Attributes of other names (data-class) aren't looked at. Work is linear in the page, however
deep elements are open.

Defined results: a null or empty html gives an empty text and 0; pages without article text give an empty text; rows
that repeat a page_id each get a row; an empty table gives an empty table. Cut-off markup at the end of a page is
dropped, an unclosed element ends with the page. Columns besides the three named ones are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune

WINDOW = 3
#: Text inside article or main counts so many times.
RAISED = 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*+)(?:>|\Z)|[^<]+|<""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements whose content is raw text up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg annotation annotation-xml".split())
#: Of these, what <name ... /> closes at once, as in markup of other namespaces.
FOREIGN = frozenset("svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that hold a line rather than lines. Those named LINE keep a line that is only a link.
LINE = frozenset("p h1 h2 h3 h4 h5 h6".split())
INNER = LINE | frozenset("blockquote pre li dt dd".split())
NEVER = frozenset("nav footer aside form menu button select dialog object canvas audio video head".split())
#: Words in class, id or role that name a container which holds no article text.
BOILER_WORDS = (
    r"(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-?bar|widget|"
    r"foot|footer|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|reply|respond|disqus|"
    r"pagination|pager|copyright|legal|disclaimer|search|contentinfo|complementary|hidden|skip-?link)"
)
BOILER = re.compile(rf"(?:^|[_-]){BOILER_WORDS}(?:$|[_-])", re.I)
#: On paragraphs and headings, whose ids and classes often name their subject, only a whole class or role counts.
BOILER_CLASS = re.compile(BOILER_WORDS, re.I)
#: Words that say what a container has or allows.
STATE = re.compile(r"(?:no|not|has|have|with|without|is|hide|show|hides|shows)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled|on|off|allowed|active|inactive|visible|collapsed|expanded|left|right)", re.I)
#: Of these, states of what stands elsewhere: a side by itself names a container (sidebar-left).
SIDE = re.compile(r"[^_-]+[_-](?:left|right)", re.I)
#: Subjects of articles that are also names of containers, before a word for article text.
SUBJECT = re.compile(r"(?:legal|social|search|alert|copyright|sharing|advert\w*|promo\w*)[_-](?:news|story|stories|article|report|feature|affairs|coverage|blog|guide|column|essay)", re.I)
#: Elements that an opening block closes, as in the HTML standard.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _boiler(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for word in value.split():
                if BOILER_CLASS.fullmatch(word) and name != "id" if tag in LINE else _names_boiler(word):
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
    return False


def _names_boiler(word: str) -> bool:
    """Whether a class, id or role names a container without article text."""
    if not BOILER.search(word) or SUBJECT.fullmatch(word):
        return False
    return SIDE.fullmatch(word) is not None or STATE.fullmatch(word) is None


def strip_lines(page: str) -> list[tuple[str, int, bool, int | None]]:
    """Lines (text, weight, whether inside an article or main element, number of the container) of a page.

    Empty lines stand for a container without article text and have its parent's number, or none at the ends of an article.
    """
    lines: list[tuple[str, int, bool, int | None]] = []
    text: list[str] = []
    weight = links = boiler = article = opened = 0
    open_tags: list[tuple[str, bool, int]] = []  # (name, starts a container without article text, number)
    names: Counter[str] = Counter()  # how many of each name are open
    blocks, containers = [""], [0]  # names of open blocks; numbers of those that hold lines
    pos, raw_until = 0, None

    def container() -> int:
        return containers[-1]

    def gap(number: int | None) -> None:
        lines.extend([("", 0, False, number)] * WINDOW)

    def flush() -> None:
        nonlocal weight
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                lines.append((line, 0 if boiler else max(weight, 1) if article or blocks[-1] in LINE else weight, article > 0, container()))
            text.clear()
        weight = 0

    def close(i: int) -> None:
        nonlocal links, boiler, article
        while len(open_tags) > i:
            name, bad, _ = open_tags.pop()
            names[name] -= 1
            if name in BLOCK:
                blocks.pop()
                if name not in INNER:
                    containers.pop()
            if name == "a":
                links -= 1
            elif name in ("article", "main") and not boiler:
                article -= 1
                if not article:
                    gap(None)
            if bad:
                boiler -= 1
                if not boiler:
                    gap(container())

    while pos < len(page):
        if raw_until:
            end = re.compile(rf"</{raw_until}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos, raw_until = (end.start() if end else len(page)), None
            continue
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                if not boiler:
                    text.append(s)
                    if not links:
                        weight += len(s.strip())
            continue
        if m[0][-1] != ">":
            break  # cut off inside a tag
        tag = tag.lower()
        if m[1]:
            if names[tag]:
                i = len(open_tags) - 1
                while open_tags[i][0] != tag:  # what is passed is closed, so all end tags together pass each element once
                    i -= 1
                if tag in BLOCK or open_tags[i][1]:
                    flush()
                close(i)
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            raw_until = None if tag in FOREIGN and m[3].endswith("/") else tag
            continue
        bad = _boiler(tag, m[3], article > 0)
        if tag in BLOCK or bad:
            flush()
            while open_tags and open_tags[-1][0] in ("p", "b", "i", "em", "strong", "span", "font", "u", "small", "a") and names["p"]:
                close(len(open_tags) - 1)  # a block ends an open paragraph
            if tag in CLOSES:
                while open_tags and open_tags[-1][0] in CLOSES[tag]:
                    close(len(open_tags) - 1)
        if bad:
            if not boiler:
                gap(container())
            boiler += 1
        if m[3].endswith("/"):
            if bad:
                boiler -= 1
            continue
        if tag == "a":
            links += 1
        elif tag in ("article", "main"):
            if not boiler:  # what a container without article text names is no article
                if not article:
                    gap(None)
                article += 1
        opened += 1
        open_tags.append((tag, bad, opened))
        names[tag] += 1
        if tag in BLOCK:
            blocks.append(tag)
            if tag not in INNER:
                containers.append(opened)
    flush()
    return lines


def _joined(lines: list[tuple[str, int, bool, int | None]]) -> list[tuple[str, int, bool, int | None]]:
    """The lines without the empty ones of containers that stand between lines of their own parent."""
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and not lines[j][0]:
            j += 1
        if j == i:
            out.append(lines[i])
            i += 1
            continue
        around = {lines[j][3] if j < len(lines) else None, out[-1][3] if out else None}
        if None in around or len(around | {x[3] for x in lines[i:j]}) > 1:
            out += lines[i:j]
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The page's main text, blocks joined by an empty line."""
    if not page:
        return ""
    lines = _joined(strip_lines(page))
    weights = [w for _, w, _, _ in lines]
    if not any(weights):
        return ""
    n = len(weights)
    sums, run = [], sum(weights[: window - 1])
    for i in range(n):  # over lines i .. i + window - 1
        if i + window - 1 < n:
            run += weights[i + window - 1]
        sums.append(run)
        run -= weights[i]
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        surge = i
        while i < n and sums[i]:
            i += 1
        span = lines[next(k for k in range(surge, n) if weights[k]) : i]
        plain = sum(w for _, w, _, _ in span) * (RAISED if any(x[2] for x in span) else 1)
        if 2 * plain >= sum(len(t) for t, _, _, _ in span):
            out += [t for t, _, _, _ in span if t]
    return "\n\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
