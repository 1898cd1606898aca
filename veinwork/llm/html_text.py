"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.common import bounded_batches, id_type

# Frequent function words of the languages that pages are expected in.
STOP_WORDS = frozenset(
    "the of and to in a is it that for on with as was this be by are or from at an not have has he she they we you his her its but which "
    "le la les de des du et un une que qui en est dans pour par sur au aux ne pas se ce il elle avec plus son sa ses on ou leur "
    "der die das und ist von zu den dem mit für auf ein eine einer nicht im des sich auch es an als bei nach wie aus "
    "el los las y es una por con para del al se lo como más su sus pero no o este esta son entre".split()
)
# Elements that end a block, elements that never hold main text (in lines of text too), and words of class or id that mark such ones.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED_TAGS = frozenset("head nav footer aside header menu dialog template noscript".split())
INLINE_DROPPED_TAGS = frozenset("button select svg iframe object canvas audio video".split())
RAW_TAGS = frozenset("script style title textarea xmp noframes".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice popup modal overlay newsletter subscribe "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies share sharing social "
    "related recommended widget pagination pager login signup".split()
)
MAIN_TAGS = frozenset(("article", "main"))
# Elements that hold the whole page or its main part; classes there speak of the page, not of furniture.
WHOLE_TAGS = frozenset(("html", "body", "main", "article"))
# Words of a class or id that name reader comments, and words that may follow them there.
COMMENT_WORDS = frozenset("comment comments commentary reply replies disqus".split())
COMMENT_PARTS = frozenset("area list thread section body content text item entry container wrapper box block form feed tree children depth meta author".split())
NO_COMMENTS = frozenset("no has with show hide open closed off disable enable allow".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+'|["'])*+)>?""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]++)))?""")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Thresholds: lengths in characters, densities as shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.12
    stop_high: float = 0.22
    links: float = 0.4
    whole: float = 0.5
    beside: float = 0.25


@dataclass
class Block:
    text: str
    linked: int
    dropped: bool
    main: int  # the main element it stands in, 0 if none
    heading: bool
    mark: int = 0  # the innermost element around it that may be furniture, 0 if none
    comment: bool = False
    label: str = field(default="")
    sparse: bool = False  # bad by its words alone


def blocks_of(html: str) -> tuple[list[Block], list[int]]:
    """The page's blocks in order: text with references decoded and white space collapsed, and where it stands;
    and for each marked element the marked one around it. Linear in the page's length.

    Only block elements end a block. Of a block with marked inline elements in its lines the rest is its text; a block of nothing else
    stands under their mark.
    """
    out: list[Block] = []
    parts: list[tuple[str, bool, int]] = []  # text, in a link, mark of the inline element
    stack: list[tuple[str, bool, int, int, bool]] = []  # element, dropped, main, mark, comment
    inline: list[tuple[str, int]] = []  # open marked inline elements
    within, parents, unclosed = Counter(), [0], set()
    heading, anchors, mains, at = False, 0, 0, 0

    def add(text: str) -> None:
        parts.append((text, anchors > 0, inline[-1][1] if inline else 0))

    def close() -> None:
        plain = [p for p in parts if not p[2]]
        own = plain if any(p[0].strip() for p in plain) else parts
        text = " ".join(unescape("".join(p[0] for p in own)).split())
        if text:
            linked = len(" ".join(unescape("".join(p[0] for p in own if p[1])).split()))
            _, dropped, main, mark, comment = stack[-1] if stack else ("", False, 0, 0, False)
            out.append(Block(text, linked, dropped, main, heading, mark if own is plain else max(p[2] for p in own), comment))
        parts.clear()

    def leave(tag: str) -> None:
        """Closes the innermost open element of this name, and those in it."""
        while within[tag]:
            name = stack.pop()[0]
            within[name] -= 1
            if name == tag:
                break

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            add(html[at:start])
        if start == len(html):
            break
        m = _TAG.match(html, start)
        if not m:  # a lone <
            add("<")
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag in RAW_TAGS and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in INLINE_DROPPED_TAGS:
            if not closing and tag not in unclosed:
                end = _end_of(tag, html, at)
                if end == -1:
                    unclosed.add(tag)
                at = max(at, end)
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else 1
            continue
        if tag == "br":
            add(" ")
            continue
        block = tag in BLOCK_TAGS or tag in DROPPED_TAGS
        if not block:
            if closing:
                if inline and any(t == tag for t, _ in inline):
                    while inline.pop()[0] != tag:
                        pass
            elif tag not in VOID_TAGS and m[3] and _hinted(m[3]):
                parents.append(inline[-1][1] if inline else stack[-1][3] if stack else 0)
                inline.append((tag, len(parents) - 1))
            elif inline and inline[-1][0] == tag:  # an unmarked one of the same name within it
                inline.append((tag, inline[-1][1]))
            continue
        comment = not closing and _is_comment(m[3])
        hinted = comment or not closing and tag not in WHOLE_TAGS and _hinted(m[3])
        close()
        anchors = 0
        inline.clear()
        heading = not closing and tag[0] == "h" and tag[1:].isdigit()
        if stack and stack[-1][0] == "p":  # a paragraph ends where a block begins or ends
            leave("p")
        if tag in VOID_TAGS or (tag == "p" and not hinted):
            continue
        if closing:
            leave(tag)
            continue
        if tag == "body":
            leave("head")
        _, dropped, main, mark, within_comment = stack[-1] if stack else ("", False, 0, 0, False)
        if tag in DROPPED_TAGS and not (tag == "header" and main):
            dropped = True
        elif tag == "form" or hinted:
            parents.append(mark)
            mark = len(parents) - 1
        elif tag in MAIN_TAGS and not main:
            mains += 1
            main = mains
        stack.append((tag, dropped, main, mark, within_comment or comment))
        within[tag] += 1
    close()
    return out, parents


def _end_of(tag: str, html: str, at: int) -> int:
    """Where the element that begins before `at` ends, -1 if nothing closes it, -2 if another begins first; only drawings and objects hold their like."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>?", re.IGNORECASE).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
        if depth > 1 and tag not in ("svg", "object"):
            return -2
    return -1


def _hinted(attributes: str) -> bool:
    """Whether a class, id or role has one of the words that mark page furniture."""
    if not attributes:
        return False
    marks = (m for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in ("class", "id", "role"))
    return any(w in DROPPED_WORDS for m in marks for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()))


def _is_comment(attributes: str) -> bool:
    """Whether a class, id, role or itemprop names reader comments: a comment word with nothing but parts of one behind it, as in comment-list,
    post-comments or comment-12, and not comments-open or no-comments."""
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            for name in re.split(r"\s+", m[2] or m[3] or m[4] or ""):
                parts = [x for x in re.split(r"[-_]+", name.lower()) if x]
                at = next((i for i, x in enumerate(parts) if x in COMMENT_WORDS), None)
                if at is not None and not NO_COMMENTS.intersection(parts) and all(x in COMMENT_PARTS or x in COMMENT_WORDS or x.isdigit() for x in parts[at + 1 :]):
                    return True
    return False


def _first_label(b: Block, rules: Rules) -> str:
    """good, bad, or short and near for those that their neighbours decide."""
    words = [w.lower() for w in _WORD.findall(b.text)]
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.dropped or b.linked > rules.links * len(b.text):
        return "bad"
    if len(b.text) < rules.short:
        return "short"
    if stops >= rules.stop_high or (stops >= rules.stop_low and len(b.text) >= rules.long):
        return "good"
    b.sparse = stops < rules.stop_low / 2 and len(b.text) >= rules.long and not b.main
    return "bad" if b.sparse else "near"


def _containers(blocks: list[Block], parents: list[int], rules: Rules) -> list[bool]:
    """For each marked element whether it and those around it hold the page's text in spite of a furniture word or of
    being a form: at least the share whole of its good text, and next to them little stands outside of all marked
    elements. On a page with good text in articles or a main element only that text counts."""
    good = [b for b in blocks if b.label == "good"]
    good = [b for b in good if b.main] or good
    held = [0] * len(parents)
    for b in good:
        held[b.mark] += len(b.text)
    free, total = held[0], sum(held)
    for k in range(len(parents) - 1, 0, -1):
        if parents[k]:
            held[parents[k]] += held[k]
    stays = [True] * len(parents)
    for k in range(1, len(parents)):
        stays[k] = stays[parents[k]] and held[k] > 0 and held[k] >= rules.whole * total and free < rules.beside * held[k]
    return stays


def classify(blocks: list[Block], parents: list[int], rules: Rules = Rules()) -> list[Block]:
    """Labels each block good or bad; changes the blocks in place and returns them."""
    for b in blocks:
        b.dropped |= b.comment
        b.label = _first_label(b, rules)
    stays = _containers(blocks, parents, rules)
    for b in blocks:
        if not b.dropped and not stays[b.mark]:
            b.dropped, b.label = True, "bad"
    if not any(b.label == "good" for b in blocks):  # a language or a table without the known function words: length and links decide
        for b in blocks:
            b.label = "good" if b.sparse and not b.dropped else b.label
    good = [b for b in blocks if b.label == "good"]
    inside = sum(len(b.text) for b in good if b.main)
    if inside and inside >= rules.whole * sum(len(b.text) for b in good):
        for b in blocks:
            if not b.main:
                b.label, b.dropped = "bad", True
    undecided = not any(b.label in ("good", "bad") and not b.dropped for b in blocks)
    before = _nearest(blocks)
    after = _nearest(blocks[::-1])[::-1]
    for b, (d, x), (e, y) in zip(blocks, before, after, strict=True):
        if b.label in ("short", "near"):
            if x and y and x != y:
                good = (y if e <= d else x) == "good" or b.heading and y == "good" or b.label == "near"
            else:
                good = (x or y or ("good" if b.main or undecided else "bad")) == "good"
            b.label = "good" if good else "bad"
    return blocks


def _nearest(blocks: list[Block]) -> list[tuple[int, str]]:
    """For each block the distance and label of the last block before it, in the same main element, that its own words and
    links decided: furniture says nothing about what stands next to it."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        k, label = last.get(b.main, (-len(blocks), ""))
        out.append((i - k, label))
        if b.label in ("good", "bad") and not b.dropped:
            last[b.main] = (i, b.label)
    return out


def main_text(html: str, rules: Rules = Rules()) -> str:
    return "\n".join(b.text for b in classify(*blocks_of(html), rules) if b.label == "good")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), rules: Rules = Rules()) -> DataFrame:
    """One row per page: id, the kept columns, text, n_chars.

    An element that a word of its class, id or role marks as furniture, and a form, is left out unless it holds most
    of the page's good text (_containers). Reader comments (_is_comment) are left out however long they are, in articles of their own too.
    First pass: blocks in page furniture or made of links are bad, so are long ones almost without function words, long ones with many of them good,
    the others short or near-good. An article or main element with the share whole of the good text or more leaves out what stands outside.
    Second pass: those undecided take the label of the nearest block that was decided by its own words and links, in the same
    main element (both neighbours alike, or the nearer one); with none decided, the text of a
    main element stands, and that of a page on which nothing but page furniture is decided. A page without a good block keeps its long ones.
    A null or empty page gives an empty text; pages are read whole and each by itself, so repeated rows and
    empty tables need nothing special; kept columns pass unchanged, nulls too, and the others are ignored.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    kept = [f"kept_{i}" for i in range(len(keep))]
    schema = pa.schema([("id", id_type(rows)), *((c, id_type(rows, c)) for c in kept), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, rules) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("id", *kept))
    return rows.mapInArrow(extract, f"{ddl}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, **dict(zip(kept, keep, strict=True))})
