"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of elements; script, style, head, markup and comments
never hold text. Each element has features: text and link density of its
subtree, tags and punctuation per character, depth, place among its siblings
and their text, its place in the page, its kind of tag, and counts of attribute
tokens that speak for or against content, its own and its ancestors'. Trees
learn from a bounded sample of pages whose markup says what is content
(`article`, `main`) and what isn't; each is learnt as it is and in versions
where such tags are replaced, so that the other features must carry the
decision.

Decoding chooses for each element whether its whole subtree is content, is
none, or is mixed, which only its ancestors' "mixed" allows: no element is
content under one that is none, and the choice of the largest total
probability wins.

A block is the text between two block-level tags. Character references are
decoded, white space in a block becomes one space, blocks are joined in page
order by a line feed. Null and empty pages have empty text; repeated rows are
each answered; broken markup (unclosed tags or quotes) is read as far as it
goes. Without pages to learn from, all text outside of navigation counts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted import BoostedTrees

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S | re.I)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head template noscript svg canvas iframe object audio video math title select textarea button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt li tbody td tfoot th thead tr html body".split())
# fixed values: attribute tokens that speak against and for content
AGAINST = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer discussion disqus foot footer form header legal links login masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup privacy promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe tags teaser toolbar topbar widget widgets".split())
FOR = frozenset("article body content entry main page paragraph post story text".split())
NEGATIVE_TAGS = frozenset("nav footer aside header form menu dialog".split())
POSITIVE_TAGS = frozenset("article main".split())


class Page:
    """Elements in page order (0 is the page itself) and texts (element, text, number of the block)."""

    __slots__ = ("tags", "parents", "depths", "places", "tokens", "texts")

    def __init__(self):
        self.tags, self.parents, self.depths, self.places, self.tokens = ["#page"], [-1], [0], [0], [()]
        self.texts: list[tuple[int, str, int]] = []


def _pieces(source: str) -> Iterator[tuple[str, str | None, str, str]]:
    """(text before, tag name or None, "/" of a closing tag, attributes), then the rest; tags that never close as well."""
    at = 0
    for m in _TAG.finditer(source):
        raw = source[at : m.start()]
        at = m.end()
        if "<" in raw:
            yield from _loose(raw)
            raw = ""
        name = m[3]
        yield raw, name and name.lower(), m[2] or "", m[4] or ""
    yield from _loose(source[at:])


def _loose(raw: str) -> Iterator[tuple[str, str | None, str, str]]:
    at = 0
    for m in _LOOSE.finditer(raw):
        yield raw[at : m.start()], m[2].lower(), m[1], m[3]
        at = m.end()
    yield raw[at:], None, "", ""


def parse(source: str) -> Page:
    page = Page()
    tags, parents, depths, places, all_tokens, texts = page.tags, page.parents, page.depths, page.places, page.tokens, page.texts
    n_children = [0]
    stack, silent, block = [0], 0, 0
    opened: Counter[str] = Counter()  # open elements by tag
    block_at: list[int] = []  # places of open blocks in the stack

    def close(to: int) -> None:
        nonlocal silent, block
        while len(stack) > to:
            tag = tags[stack.pop()]
            opened[tag] -= 1
            silent -= tag in SILENT
            if tag in BLOCK:
                block += 1
                block_at.pop()

    for raw, tag, slash, attributes in _pieces(source):
        if raw and not silent and not raw.isspace():
            texts.append((stack[-1], html.unescape(raw) if "&" in raw else raw, block))
        elif raw and not silent and texts:
            texts.append((stack[-1], " ", block))
        if tag is None:
            continue
        is_block = tag in BLOCK
        if slash:
            if not opened[tag]:
                block += is_block
                continue
            to = len(stack) - 1
            while tags[stack[to]] != tag:  # all these are closed, so each is passed once
                to -= 1
            close(to)
            continue
        if is_block:
            block += 1
            shuts = ("p",) if tag in CLOSES_P else _SHUTS.get(tag, ())
            if block_at and tags[stack[block_at[-1]]] in shuts:  # what is shut is the innermost open block
                close(block_at[-1])
        if tag in VOID:
            if tag == "br" and not silent:
                texts.append((stack[-1], " ", block))
            continue
        if not is_block and attributes.endswith("/"):
            continue
        tokens = ()
        if "=" in attributes:
            tokens = tuple(t for a in _ATTRIBUTE.findall(attributes) for t in _TOKEN.findall(a.lower()))
        up = stack[-1]
        tags.append(tag)
        parents.append(up)
        depths.append(len(stack))
        places.append(n_children[up])
        all_tokens.append(tokens)
        n_children[up] += 1
        n_children.append(0)
        opened[tag] += 1
        if is_block:
            block_at.append(len(stack))
        stack.append(len(tags) - 1)
        silent += tag in SILENT
    return page


_SHUTS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


class Forest:
    """Arrays over the elements of many pages, one page after the other."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tags) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.first[-1])
        offset = np.repeat(self.first[:-1], sizes)
        joined = lambda name: np.array([v for p in pages for v in getattr(p, name)], np.int64)
        self.parent = joined("parents")
        self.root = self.parent < 0
        self.parent = np.where(self.root, np.arange(n), self.parent + offset)
        self.depth, self.place = joined("depths"), joined("places")
        by_depth = np.argsort(self.depth, kind="stable")
        edges = np.searchsorted(self.depth[by_depth], np.arange(int(self.depth.max(initial=0)) + 2))
        self.levels = [by_depth[a:b] for a, b in zip(edges[1:-1], edges[2:], strict=True)]  # without the roots
        count = np.ones(n, np.int64)
        for level in reversed(self.levels):
            np.add.at(count, self.parent[level], count[level])
        self.end = np.arange(n) + count  # elements below i are i + 1 to end[i]

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sum over each element and all below it."""
        run = np.concatenate([[0], np.cumsum(own)])
        return run[self.end] - run[:-1]

    def above(self, own: np.ndarray) -> np.ndarray:
        """Sum over each element and all above it."""
        out = own.copy()
        for level in self.levels:
            out[level] += out[self.parent[level]]
        return out


def node_features(pages: list[Page], forest: Forest) -> np.ndarray:
    """A row of features for each element, without article and main tags themselves."""
    n = int(forest.first[-1])
    parent = forest.parent
    tags = [t for p in pages for t in p.tags]
    kinds = np.array([_KIND.get(t, _INLINE if t not in BLOCK else 0) for t in tags], np.int64)
    negative = np.array([t in NEGATIVE_TAGS for t in tags], np.int64)
    against, pro = negative.copy(), np.zeros(n, np.int64)
    for k, tokens in enumerate(t for p in pages for t in p.tokens):
        if tokens:
            against[k] += sum(t in AGAINST for t in tokens)
            pro[k] = sum(t in FOR for t in tokens)
    rows = [(forest.first[k] + at, len(t), t.count(","), t.count(".") + t.count("?") + t.count("!"), block) for k, p in enumerate(pages) for at, t, block in p.texts]
    at, size, commas, stops, block = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    own = lambda w: np.bincount(at, w, minlength=n)
    new_block = np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])]) if len(at) else np.zeros(0, bool)
    begins = np.cumsum(size) - size
    text_page = np.searchsorted(forest.first, at, "right") - 1
    page_chars = np.bincount(text_page, size, minlength=len(pages))
    begins = begins - (np.cumsum(page_chars) - page_chars)[text_page]
    first_text = np.full(n + 1, np.iinfo(np.int64).max // 2)
    np.minimum.at(first_text, at, begins)
    spans = np.stack([np.arange(n), forest.end], 1).ravel()
    begin = np.minimum.reduceat(first_text, spans)[::2] if n else first_text[:0]
    total = np.maximum(np.repeat(page_chars, np.diff(forest.first)), 1)
    in_link = forest.above((kinds == _KIND["a"]).astype(np.int64)) > 0
    chars, n_tags = forest.below(own(size)), forest.below(np.ones(n))
    link_chars = forest.below(np.where(in_link, own(size), 0))
    links, paragraphs = forest.below(kinds == _KIND["a"]), forest.below(kinds == _KIND["p"])
    some = np.maximum(chars, 1)
    order = np.lexsort((forest.place, parent, forest.root))
    order = order[: n - len(pages)]  # siblings next to each other, roots left out
    same = parent[order[1:]] == parent[order[:-1]]
    before, after, brothers = np.zeros(n), np.zeros(n), np.bincount(parent[~forest.root], minlength=n)[parent]
    before[order[1:][same]] = chars[order[:-1][same]]
    after[order[:-1][same]] = chars[order[1:][same]]
    columns = [
        np.log1p(chars), link_chars / some, n_tags / some, links / n_tags, paragraphs / n_tags,
        forest.below(own(commas)) / some, forest.below(own(stops)) / some, chars / np.maximum(forest.below(own(new_block)), 1), chars / total, np.minimum(begin, total) / total,
        forest.depth, forest.place, brothers, np.log1p(before), np.log1p(after), chars / some[parent],
        against, forest.above(against), pro, forest.above(pro),
        kinds == _KIND["p"], kinds == _KIND["h1"], kinds == _KIND["ul"], kinds == _KIND["a"], kinds == _INLINE, link_chars[parent] / some[parent],
    ]
    return np.stack(columns, 1).astype(np.float32)


_INLINE = 9
_KIND = {"p": 1, "a": 4} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), 2) | dict.fromkeys(("ul", "ol", "li", "dl"), 3)


def node_labels(page: Page) -> np.ndarray:
    """1: content by its markup, 0: not, -1: holds both or can't be told."""
    n = len(page.tags)
    label, inside = np.full(n, -1), np.zeros((n, 2), bool)
    for i, (tag, up, tokens) in enumerate(zip(page.tags, page.parents, page.tokens, strict=True)):
        above = label[up] if up >= 0 else -1
        bad = tag in NEGATIVE_TAGS or tag in SILENT or any(t in AGAINST for t in tokens)
        label[i] = 0 if bad or above == 0 else 1 if tag in POSITIVE_TAGS or above == 1 else -1
    for i in range(n - 1, -1, -1):
        if label[i] >= 0:
            inside[i, label[i]] = True
        if i:
            inside[page.parents[i]] |= inside[i]
    label[inside.all(1)] = -1
    if inside[0, 1]:
        label[(label == -1) & ~inside.any(1)] = 0
    return label


def variants(page: str, other: str, seed: int) -> Iterator[str]:
    """The page, and versions of it with other markup and with what other pages may hold besides."""
    yield page
    rng = np.random.default_rng(seed)
    names = ("entry", "story", "x1", "wrap", "post-body", "")
    noise = ("comments", "sidebar", "cookie-notice", "related", "share", "newsletter", "promo", "replies")
    some = re.findall(r"<p[^>]*>([^<]{40,300})", other)[:6] or ["Read more about this here"]
    extra = "".join(f"<div><b>user{rng.integers(99)}</b><p>{t}</p></div>" for t in some)
    box = f'<div class="{noise[rng.integers(len(noise))]}">{extra}</div>'
    side = f'<aside><ul>{"".join(f"<li><a href=/{k}>{t[:40]}</a></li>" for k, t in enumerate(some))}</ul></aside>'
    form = "<form><label>Mail</label> Send us your address to get news <input name=q></form>"
    name = names[rng.integers(len(names))]
    yield re.sub(r"</article\s*>", lambda m: box + m[0] if rng.random() < 0.5 else m[0] + box, page, count=1)
    moved = re.sub(r"<nav\b", '<div class="menu"', page).replace("</nav>", "</div>")
    moved = re.sub(r"<footer\b", f'<div class="{("footer", "legal", "bottom")[rng.integers(3)]}"', moved).replace("</footer>", "</div>")
    yield re.sub(r"<article[^>]*>", lambda m: side + m[0], moved, count=1).replace("</article>", "</article>" + form)
    # the tag of the article becomes a plain one; `data-main` keeps the label
    yield re.sub(r"<article[^>]*>", f'{side if rng.random() < 0.5 else ""}<div data-main class="{name}">', moved, count=1).replace("</article>", "</div>" + box)


def _training_rows(page: str, other: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text in variants(page, other, seed):
        # labels are read with the article's tag in place, features with a plain one
        plain = text.replace("<div data-main", "<article")
        if plain != text:
            start = text.index("<div data-main")
            inner, depth = text[start:], 0
            for m in re.finditer(r"<(/?)div\b", inner):
                depth += -1 if m[1] else 1
                if depth == 0:
                    plain = text[:start] + "<article" + inner[len("<div data-main") : m.start()] + "</article" + inner[m.end() :]
                    break
        parsed, labelled = parse(text), parse(plain)
        if len(labelled.tags) != len(parsed.tags):
            continue
        label = node_labels(labelled)
        x = node_features([parsed], Forest([parsed]))
        keep = (label >= 0) & (x[:, 0] > 0)
        xs.append(x[keep])
        ys.append(label[keep])
    return np.concatenate(xs), np.concatenate(ys)


def decode(forest: Forest, margin: np.ndarray, has_text: np.ndarray, mixed: float = -0.7) -> np.ndarray:
    """Which elements' own text is content; the choice of the largest sum of log probabilities for each page."""
    parent = forest.parent
    all_yes = forest.below(np.where(has_text, -np.logaddexp(0, -margin), 0.0))
    all_no = forest.below(np.where(has_text, -np.logaddexp(0, margin), 0.0))
    best = np.where(has_text, mixed, 0.0)
    for level in reversed(forest.levels):
        best[level] = np.maximum(best[level], np.maximum(all_yes[level], all_no[level]))
        np.add.at(best, parent[level], best[level])
    best[forest.root] = np.maximum(best, np.maximum(all_yes, all_no))[forest.root]
    whole = best <= np.maximum(all_yes, all_no) + 1e-9
    own = np.where(whole, np.where(all_yes >= all_no, 1, -1), 0)
    state = np.where(forest.root, own, 0)  # 1: all content, -1: none, 0: mixed
    for level in forest.levels:
        above = state[parent[level]]
        state[level] = np.where(above != 0, above, own[level])
    # own text of a mixed element goes by its own probability
    return (state == 1) | ((state == 0) & (margin >= 0))


def join_blocks(page: Page, content: np.ndarray) -> str:
    blocks: list[list[str]] = []
    last = None
    for at, t, block in page.texts:
        if content[at]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(t)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract_all(sources: list[str | None], model: BoostedTrees | None) -> list[str]:
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    forest = Forest(pages)
    if model:
        x = node_features(pages, forest)
        content = decode(forest, model.margin(x), x[:, 0] > 0)
    else:
        content = np.concatenate([node_labels(p) != 0 for p in pages])
    return [join_blocks(p, content[a:b].tolist()) for p, a, b in zip(pages, forest.first[:-1], forest.first[1:], strict=True)]


def train(pages: DataFrame, most: int = 300, most_chars: int = 200_000) -> BoostedTrees | None:
    """Trees learnt from at most `most` pages, those of the smallest hash that hold an article or main element.

    Pages beyond most_chars characters aren't learnt from, which bounds what the driver
    holds. Hashes alone are ordered; the chosen pages are fetched afterwards, one for each hash.
    """
    able = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= most_chars)).select("html", F.xxhash64("html").alias("h"))
    chosen = able.select("h").distinct().orderBy("h").limit(most)
    found = able.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html")).collect()
    sample = [r.html for r in sorted(found, key=lambda r: r.h)]
    rows = [_training_rows(page, sample[k - 1], k) for k, page in enumerate(sample)]
    if not rows:
        return None
    x, y = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return BoostedTrees().fit(x, y.astype(float)) if 0 < y.sum() < len(y) else None


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                some = batch.slice(start, 200)
                text = extract_all(some.column("html").to_pylist(), model.value)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, most: int = 300) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(train(pages, most))
    return pages.mapInArrow(_extract(model), "page_id bigint, url string, text string, n_chars bigint")
