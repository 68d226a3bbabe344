"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of tags and text runs. Each word scores by its surroundings: the
elements around it with their classes, ids and roles, links, headings, paragraphs, and whether the page
has an article beside it. The weights come from a logistic regression on labelled pages, where a name
may stand for content on one page and for boilerplate on another; names never seen there weigh nothing.
Each tag scores by its clipped log odds, never above a small negative number. One linear scan finds the
contiguous region of the highest sum. Within the region, runs whose words score below zero (an
advert amid paragraphs) are left out, and the rest is the text.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one space in page order. Nothing else is dropped or capped. A page takes time
linear in its length, whatever its quotes.

Defined cases: a null or empty page, and a page without content, gives ''; unclosed comments
and scripts run to the end of the page; unclosed elements end with their parent, and a tag whose quotes
never close ends at the first `>`; repeated rows are extracted each; an empty table gives an empty
table; only id, url and html are read.
"""

from __future__ import annotations

import html as _html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataforge.llm._common import arrow_rows, ship, table

_MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'<>]+)""")
#: Elements whose content is never text of the page. Fixed values.
RAW = frozenset("script style noscript template iframe object textarea title svg select option head".split())
_RAW_TEXT = frozenset("script style noscript template iframe object textarea title svg select".split())
_END_OF = {n: re.compile(f"</{n}", re.I | re.A) for n in _RAW_TEXT}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not break a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre br li dd td".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z]+")


def names_of(name: str, attrs: str, inside: bool) -> tuple[str, ...]:
    """What an element says of the words in it: its name (in an article or not), labels of its class and role with their parts, its id."""
    out = [f"<{name}{'/in' if inside else ''}"]
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = (m[1] or m[5]).lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or (key == "style" and _HIDDEN.search(value)):
                out.append("hidden")
            elif key in ("class", "role"):
                for label in value.split():
                    out.append("." + label.rstrip("0123456789"))
                    out += ["*" + x for x in _SPLIT.split(label) if x]
            elif key == "id":
                out.append("#" + value.strip().rstrip("0123456789"))
    return tuple(dict.fromkeys(out))


class Page:
    """Finds the ends of tags; every position is passed over a bounded number of times, quotes closed or not."""

    def __init__(self, text: str):
        self.text, self.dead = text, set()  # positions outside quotes from which no tag ends

    def tag_end(self, at: int) -> int:
        """Position of the `>` that ends the tag whose attributes start at `at`, outside quotes where they close; the page's end without any."""
        text, x, path = self.text, at, []
        while x not in self.dead:
            path.append(x)
            m = _STOP.search(text, x)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            close = text.find(m[0], m.end()) if m.end() not in self.dead else -1
            if close < 0:
                self.dead.add(m.end())
                break
            x = close + 1
        self.dead.update(path)
        end = text.find(">", at)
        return len(text) if end < 0 else end


def page_items(page: str) -> list[list]:
    """The page as items: [tag name, opens] for a tag and [None, text, names, in container, link, heading, paragraph, never text] for a text run."""
    items: list[list] = []
    stack: list[tuple] = []  # name, names, is container, never text
    held: dict[str, int] = {}
    names: tuple[str, ...] = ()
    container = link = heading = raw = at = 0
    paragraph = False
    tags = Page(page)

    def text(s: str) -> None:
        if s:
            items.append([None, s, names, container > 0, link > 0, heading > 0, paragraph, raw > 0])

    def push(name: str, own: tuple[str, ...], is_container: bool, never: bool) -> None:
        nonlocal container, link, heading, raw, names
        stack.append((name, own, is_container, never))
        container += is_container
        link += name == "a"
        heading += name in HEADINGS
        raw += never
        for x in own:
            held[x] = held.get(x, 0) + 1
        names = tuple(held)

    def pop_to(i: int) -> None:
        nonlocal container, link, heading, raw, names
        while len(stack) > i:
            n, own, c, never = stack.pop()
            container -= c
            link -= n == "a"
            heading -= n in HEADINGS
            raw -= never
            for x in own:
                held[x] -= 1
                if not held[x]:
                    del held[x]
        names = tuple(held)

    m = _MARKUP.search(page)
    while m:
        text(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name:
            end = tags.tag_end(m.end())
            attrs, at, closing = page[m.end() : end], min(len(page), end + 1), bool(m[1])
            items.append([name, not closing])
            if name not in INLINE:
                paragraph = name in PARAGRAPHS and (not closing or name == "br")
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop_to(i)
                        break
                    if stack[i][0] in CONTAINER and name in ("p", "li", "a", "b", "span"):
                        break
            elif name in _RAW_TEXT and not attrs.rstrip().endswith("/"):
                found = _END_OF[name].search(page, at)
                at = found.start() if found else len(page)
            else:
                if stack and name not in INLINE and name not in VOID and stack[-1][0] in ("p", "a") and (stack[-1][0] == "p" or name in ("p", "div", "ul", "nav", "article", "footer")):
                    pop_to(len(stack) - 1)
                if name == "a" and link:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "a":
                            pop_to(i)
                            break
                if name not in VOID and name not in ("html", "body") and not (attrs.endswith("/") and name in INLINE) and (name not in INLINE or name in ("a", "span") or attrs):
                    push(name, names_of(name, attrs, container > 0), name in CONTAINER or 'role="main"' in attrs or 'itemprop="articleBody"' in attrs, name in RAW)
        m = _MARKUP.search(page, at)
    text(page[at:])
    return items


def word_features(items: list[list]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(item number, words, what is said of them) for each text run that has words and may be text."""
    texts = [(i, len(x[1].split())) for i, x in enumerate(items) if x[0] is None and not x[7]]
    texts = [(i, n) for i, n in texts if n]
    has_container = any(items[i][3] for i, _ in texts)
    out = []
    for k, (i, n) in enumerate(texts):
        _, _, names, inside, link, heading, paragraph, _ = items[i]
        near = texts[max(0, k - 4) : k + 5]
        more = ["bias"]
        if inside or has_container:
            more.append("inside" if inside else "outside")
        dense = 2 * sum(w for j, w in near if items[j][4]) > sum(w for _, w in near)
        if link:
            more.append("link" if dense else "inline link")
        if heading:
            more.append("heading")
        if paragraph:
            more.append("paragraph")
        if n < 4 and not inside:
            more.append("short")
        if dense:
            more.append("dense links")
        out.append((i, n, (*names, *more)))
    return out


class Extractor:
    def __init__(self, word_weights: dict[str, float], tag_weights: dict[str, float], other_tag: float):
        self.word_weights, self.tag_weights, self.other_tag = word_weights, tag_weights, other_tag

    def weight(self, names: tuple[str, ...]) -> float:
        """Score of one word, in [-3, 3]."""
        return max(-3.0, min(3.0, sum(self.word_weights.get(x, 0.0) for x in names)))

    def region(self, items: list[list]) -> tuple[int, int, dict[int, float]]:
        """First and last item (exclusive) of the best contiguous region, and the word score of each run."""
        known: dict[tuple, float] = {}
        words = {}
        for i, n, names in word_features(items):
            w = known.get(names)
            if w is None:
                w = known[names] = self.weight(names)
            words[i] = (n, w)
        best, best_at = 0.0, (0, 0)
        total, start = 0.0, 0
        for i, x in enumerate(items):
            if x[0] is None:
                n, w = words.get(i, (0, 0.0))
                total += n * w if w > 0 else w  # a run that is left out anyway counts once, as a tag does
            else:
                total += self.tag_weights.get(x[0], self.other_tag)
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, best_at = total, (start, i + 1)
        return *best_at, {i: w for i, (_, w) in words.items()}

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        items = page_items(page)
        first, last, score = self.region(items)
        out: list[str] = []
        for i in range(first, last):
            x = items[i]
            if x[0] is None:
                if not x[7] and (score.get(i, 1.0) > 0 or not x[1].strip()):
                    out.append(x[1])
            elif x[0] not in INLINE:
                out.append("\n")
        return " ".join(_html.unescape("".join(out)).split())


#: Labels that the labelled pages give to boilerplate, and to content. Names may be in both.
_BOX = "ad ads advert advertisement banner-ad ad-slot sponsored sponsor promo promotion cookie-notice cookies consent gdpr-banner notice alert popup modal newsletter newsletter-signup subscribe sidebar side-bar social social-share share sharing related related-posts recommended more-stories widget toolbar pagination breadcrumb breadcrumbs comments comment comment-list replies disqus login login-form search search-form signup copyright legal disclaimer tags skip-link site-header topbar masthead site-footer footer foot bottom navbar nav menu main-nav".split()
_CONTENT = "content post post-body story story-body article article-body article-text entry entry-content text body main page-content main-content story-related post-comment-policy c1 x wrap wrapper container column row inner section block".split()


def labelled_pages(seed: int = 11, size: int = 900) -> list[str]:
    """Labelled pages: in invented layouts, content runs are wrapped in \\x01 ... \\x02."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioutrnsldhmbc") for _ in range(rnd.randint(2, 9)))
    prose = lambda a, b: " ".join(word() for _ in range(rnd.randint(a, b))).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    gold = lambda s: f"\x01{s}\x02"
    label = lambda k: rnd.choice(['class="{}"', 'class="{} x"', 'class="{}"', 'id="{}"']).format(k)
    pages = []

    def box() -> str:
        k, inner = rnd.choice(_BOX), rnd.choice([prose(5, 40), f"<p>{prose(4, 50)}</p>", f"<ul>{links(4)}</ul>", f"<p>{prose(3, 20)}</p><p>{prose(3, 30)}</p>", word()])
        tag = rnd.choice(["div", "div", "section", "ul", "p"]) if "<" not in inner else "div"
        return f"<{tag} {label(k)}>{inner}</{tag}>"

    def element() -> str:
        return rnd.choice([
            f"<nav>{prose(2, 9)}<ul>{links(rnd.randint(2, 9))}</ul></nav>", f"<aside><h3>{word()}</h3><p>{prose(5, 50)}</p></aside>", f"<aside><ul>{links(5)}</ul></aside>",
            f"<form>{prose(1, 8)} <input> <button>{word()}</button><label>{word()}</label></form>", f"<footer>&copy; {prose(2, 20)}</footer>", f"<footer><p>{prose(4, 30)}</p></footer>",
            f"<div role='{rnd.choice(['navigation', 'banner', 'complementary', 'contentinfo', 'search', 'dialog', 'alert'])}'><p>{prose(3, 30)}</p></div>",
            f"<{rnd.choice(['div', 'p'])} {rnd.choice(['hidden', 'style=' + chr(34) + 'display:none' + chr(34)])}>{prose(3, 30)}</div>", f"<menu>{links(4)}</menu>", f"<dialog>{prose(3, 20)}</dialog>", f"<fieldset>{prose(2, 9)}</fieldset>",
        ])

    for k in range(size):
        body = [f"<h1>{gold(prose(3, 8))}</h1>"]
        for _ in range(rnd.randint(2, 9)):
            p = gold(prose(6, 60))
            if rnd.random() < 0.3:
                p += f' <a href="/x">{gold(word())}</a> ' + gold(prose(2, 9))
            if rnd.random() < 0.2:
                p = f"<b>{p}</b><br>"
            if rnd.random() < 0.2:
                body.append(f"<h{k % 4 + 2}>{gold(prose(1, 5))}</h{k % 4 + 2}>")
            if rnd.random() < 0.15:
                body.append(f"<ul><li>{gold(prose(2, 9))}</li><li>{gold(prose(2, 9))}</li></ul>")
            if rnd.random() < 0.1:
                body.append(f"<table><tr><td>{gold(prose(1, 4))}</td><td>{gold(prose(1, 4))}</td></tr></table>")
            if rnd.random() < 0.1:
                body.append(f"<blockquote>{gold(prose(4, 30))}</blockquote>")
            if rnd.random() < 0.3:
                tag = rnd.choice(["div", "section", "span"])
                p = f"<{tag} {label(rnd.choice(_CONTENT))}>{p}</{tag}>" if rnd.random() < 0.5 else p
            attr = f" {label(rnd.choice(_CONTENT))}" if rnd.random() < 0.2 else ""
            body.append(f"<p{attr}>{p}" + "</p>" * (rnd.random() < 0.8))
            if rnd.random() < 0.3:
                body.append(rnd.choice([box, box, element])())
        inner = "".join(body)
        if k % 3:
            tag = rnd.choice(["article", "main"])
            if rnd.random() < 0.3:
                inner = inner.replace("<h1>", "<header><h1>", 1).replace("</h1>", "</h1></header>", 1)
            inner = f"<{tag}{' ' + label(rnd.choice(_CONTENT)) if rnd.random() < 0.4 else ''}>{inner}</{tag}>"
            if rnd.random() < 0.4:
                inner = f"<div {label(rnd.choice(_CONTENT))}>{inner}</div>"
        else:
            inner = f"<div {label(rnd.choice(_CONTENT))}>{inner}</div>"
        plain = f"<div {label(rnd.choice(_CONTENT))}><ul>{links(rnd.randint(4, 12))}</ul></div>"
        before = [f"<header><h2>{word()}</h2>{prose(1, 6)}</header>", f"<header><a href='/'>{word()}</a></header>", plain, element(), element(), box(), box()]
        after = [f"<div>{links(rnd.randint(4, 12))}</div>", plain, element(), element(), box(), box(), f'<div class="comments"><p>{prose(5, 60)}</p><div class="comment"><p>{prose(5, 60)}</p></div></div>']
        pages.append(f"<html><head><title>{prose(3, 6)}</title></head><body>{''.join(rnd.sample(before, rnd.randint(1, 4)))}{inner}{''.join(rnd.sample(after, rnd.randint(1, 5)))}</body></html>")
    return pages


def train(pages: list[str], epochs: int = 500, rate: float = 0.3, l2: float = 2e-5) -> Extractor:
    """Logistic regression of words' surroundings, and log odds of tags, on labelled pages."""
    seen_runs: dict[tuple, float] = {}  # equal surroundings with equal labels are one row
    inside: dict[str, list[float]] = {}
    for page in pages:
        items = page_items(page)
        labelled = [x[0] is None and "\x01" in x[1] for x in items]
        for x in items:
            if x[0] is None:
                x[1] = x[1].replace("\x01", "").replace("\x02", "")
        span = [i for i, y in enumerate(labelled) if y]
        for i, n, names in word_features(items):
            key = (names, labelled[i])
            seen_runs[key] = seen_runs.get(key, 0) + min(n, 20)
        for i, x in enumerate(items):
            if x[0] is not None:
                c = inside.setdefault(x[0], [1.0, 1.0])
                c[0 if span and span[0] <= i <= span[-1] else 1] += 1
    rows = sorted(seen_runs)
    column = {x: i for i, x in enumerate(sorted({x for names, _ in rows for x in names}))}
    x = np.zeros((len(rows), len(column)))
    for i, (names, _) in enumerate(rows):
        x[i, [column[c] for c in names]] = 1.0
    y, n = np.array([y for _, y in rows], dtype=float), np.array([seen_runs[r] for r in rows], dtype=float)
    w, seen = np.zeros(len(column)), np.full(len(column), 1e-6)
    for _ in range(epochs):  # AdaGrad: rare names learn as fast as common ones
        g = x.T @ ((1 / (1 + np.exp(-(x @ w))) - y) * n) / n.sum() + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    tags = {t: float(np.clip(np.log(a / b), -0.5, -0.05)) for t, (a, b) in inside.items()}
    return Extractor({c: float(w[i]) for c, i in column.items()}, tags, -0.2)


@lru_cache(maxsize=1)
def default_extractor() -> Extractor:
    return train(labelled_pages())


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", extractor: Extractor | None = None) -> DataFrame:
    """id, url, text, n_chars of every row: an Arrow map without shuffle."""
    ex = extractor or default_extractor()
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [ex.extract(h.as_py()) for h in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return df.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(arrow_rows(run), schema)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
