"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tokens: words and tags. Words of ordinary context score positive, tags and
words inside navigation, adverts, forms and the like negative; one linear scan finds the
contiguous run of highest score, and that run, less what boilerplate elements inside it hold, is the
main text. Weights start from priors of that shape and are trained by an averaged perceptron on
labelled pages: a bounded sample whose own markup (``article``, ``main``) delimits the content. The
label is not an input of the scan: pages without such markup are read by the same weights.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import pick

#: bounds of the training sample: pages, and characters of one training page
SAMPLE, SAMPLE_CHARS = 300, 200_000
MARGIN, SHIFT = 0.7, 0.3

# fixed values: element classes of HTML
HIDDEN = "script style noscript template textarea iframe object svg title select option button canvas audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr "
             "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder".split())
BOILER = set("nav footer aside form menu dialog".split())
#: elements, and words of names, that stay boilerplate however much of a page they hold
STRONG = set("nav footer menu dialog".split())
#: words of class, id and role attributes that name boilerplate
BOILER_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments commentlist discussion reply replies respond disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager widget footer masthead search complementary contentinfo".split()
)
STRONG_NAMES = set("ad ads adbox adslot advert adverts advertisement advertising cookie cookies consent gdpr comment comments commentlist discussion reply replies respond disqus".split())
#: words that may stand beside them in a name: parts of a page, places, numbers of things
NEUTRAL_NAMES = set(
    "area aside bar block body bottom box btn button buttons card cards center column container content contents div element elements footer fixed form global group header "
    "holder icon icons inline inner item items label large left link links list main medium message module outer page panel post posts articles stories news primary reader readers right row section "
    "secondary section sections site slot small sticky story tab tabs tag tags the title top unit user users wrap wrapper".split()
)
CONTENT = ("article", "main")

#: elements whose start ends an open one of ``closed`` unless one of ``bounds`` was opened in between
_SECTIONS = "article aside blockquote center details dialog dir dl fieldset figcaption figure footer form header hgroup main menu nav ol section summary ul".split()
_CELLS = "table caption td th".split()
_P = (("p",), tuple(_CELLS))
IMPLIED = {
    "li": (("li",), (*_SECTIONS, *_CELLS)),
    **{x: (("dt", "dd"), (*_SECTIONS, *_CELLS)) for x in ("dt", "dd")},
    **{x: (("td", "th"), ("table", "tr")) for x in ("td", "th")},
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    **{x: (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)) for x in ("thead", "tbody", "tfoot")},
}
#: elements that can't stand in a paragraph
P_ENDS = {*_SECTIONS, *"address div h1 h2 h3 h4 h5 h6 hr p pre search table li dt dd".split()}
HEAD_ONLY = set("head html title meta link base script style noscript template bgsound basefont".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(HIDDEN) + r")(?=[\s/>])(?P<rawattrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_SAME = {x: re.compile(rf"<(/?){x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in HIDDEN}
_OPTION = re.compile(r"[^<]*(?:</option\s*>)?", re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boiler_kind(name: str, attrs: str, inside_content: bool) -> int:
    """0: ordinary; 1: boilerplate unless the page's text lies in it; 2: boilerplate unless its article does.

    A name counts if it consists of boilerplate words and neutral ones only: ``related-posts`` does,
    ``related-work``, ``has-sidebar`` and ``menu-open`` don't."""
    if name in BOILER or (name == "header" and not inside_content):
        return 2 if name in STRONG else 1
    if name in CONTENT or name in ("body", "html") or "=" not in attrs:
        return 0
    named = [v.strip("\"'") for _, v in _ATTR.findall(attrs)]
    if not any(named):
        return int("hidden" in attrs.lower().split())
    kind = 0
    for token in " ".join(named).split():
        words = {w.lower() for w in _CAMEL.findall(token)}
        telling = words & BOILER_NAMES if inside_content else words & (BOILER_NAMES | {"header", "head", "topbar"})
        if telling and words <= telling | NEUTRAL_NAMES:
            kind = max(kind, 2 if words & STRONG_NAMES else 1)
    return kind


def _hidden_end(page: str, name: str, attrs: str, at: int, missing: set[str]) -> int:
    """Where the hidden element whose start tag ends at ``at`` ends: at once if it is self-closing or
    has no end tag (names without one are noted in ``missing``, so that a page is searched once a
    name). Code without an end tag runs to the end of the page, as in HTML."""
    if attrs.endswith("/") and attrs[-2:-1] in ("", " ", "\t", "\n", "\r", "\f", '"', "'"):
        return at
    if name == "option":
        return _OPTION.match(page, at).end()
    if name in missing:
        return at
    for m in _SAME[name].finditer(page, at):
        if m[1]:
            return m.end()
        if name in ("select", "button"):  # these don't nest: the first was never closed
            return at
    if name in ("script", "style"):
        return len(page)
    missing.add(name)
    return at


Token = tuple[str, int, str, bool]  # feature, count, text or "" for tags, whether a block ends here


def tokenise(page: str) -> list[Token]:
    """Tokens of a whole page. Text features: plain, link (inside ``a``) or boiler words; the head's
    content and hidden elements yield nothing.

    Elements that look like boilerplate are noted with the words they hold; which of them are is
    decided when the whole page is read (`_boilerplate`)."""
    out: list[Token] = []
    stack: list[tuple[str, int]] = []  # open elements, and the number of their note or -1
    places: dict[str, list[int]] = {}  # their places in the stack by name
    notes: list[list[int]] = []  # kind (0: content), first token, end, words, words that are no links
    links = content = said = plain = 0
    head = False
    missing: set[str] = set()

    def close(place: int) -> None:
        """Unclosed inner elements end with their parent."""
        nonlocal links, content
        while len(stack) > place:
            x, note = stack.pop()
            places[x].pop()
            if note >= 0:
                notes[note][2:] = [len(out), said - notes[note][3], plain - notes[note][4]]
            links -= x == "a"
            content -= x in CONTENT

    def last(names) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def end_implied(closed, bounds) -> None:
        if any(places.get(x) for x in closed):
            bound = last(bounds)
            inner = [i for x in closed for i in places.get(x, ())[-1:] if i > bound]
            while inner:
                close(min(inner))
                inner = [i for x in closed for i in places.get(x, ())[-1:] if i > bound]

    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if not head:
                text = htmllib.unescape(m["text"]) if "&" in m["text"] else m["text"]
                n = len(text.split())
                said, plain = said + n, plain + (0 if links else n)
                out.append(("link" if links else "plain", n, text, False))
        elif m["name"] is not None:
            name, closing = m["name"].lower(), bool(m["close"])
            if name == "head":
                head = not closing
                continue
            if not closing and name not in HEAD_ONLY:
                head = False
            block = name not in INLINE
            out.append((("/" if closing else "<") + name, 1, "", block))
            if not closing:
                if name in P_ENDS:
                    end_implied(*_P)
                if name in IMPLIED:
                    end_implied(*IMPLIED[name])
            if name in VOID or m["attrs"].endswith("/"):
                continue
            if not closing:
                kind = _boiler_kind(name, m["attrs"], content > 0)
                places.setdefault(name, []).append(len(stack))
                stack.append((name, len(notes) if kind or name in CONTENT else -1))
                if kind or name in CONTENT:
                    notes.append([kind, len(out), 0, said, plain])
                links += name == "a"
                content += name in CONTENT
            elif places.get(name):
                bounds = _P[1] if name == "p" else IMPLIED[name][1] if name in IMPLIED else ()
                if places[name][-1] > last(bounds):
                    close(places[name][-1])
        elif m["raw"] is not None:
            name = m["raw"].lower()
            head = head and name in HEAD_ONLY
            out.append(("hidden", 1, "", False))
            at = _hidden_end(page, name, m["rawattrs"], at, missing)
    close(0)
    for a, b in _boilerplate(notes, plain):
        for i in range(a, b):
            if out[i][2]:
                out[i] = ("boiler", *out[i][1:])
    return out


def _boilerplate(notes: list[list[int]], plain: int) -> list[tuple[int, int]]:
    """Token ranges of the elements that are boilerplate, outermost ones only. An element around the
    page's longest article isn't, nor, on a page without one, an element of kind 1 around most of its
    words (links apart)."""
    articles = [n for n in notes if not n[0]]
    longest = max(articles, key=lambda n: (n[3], -n[1]), default=None)
    out: list[tuple[int, int]] = []
    for kind, a, b, _, words in notes:
        if not kind or (out and b <= out[-1][1]):
            continue
        around = longest is not None and longest[3] > 0 and a <= longest[1] and longest[2] <= b
        if not around and not (longest is None and kind == 1 and 2 * words > plain):
            out.append((a, b))
    return out


def prior(feature: str) -> float:
    fixed = {"plain": 1.0, "link": 0.3, "boiler": -0.25, "hidden": -0.5}
    if feature in fixed:
        return fixed[feature]
    name = feature[1:]
    return -0.05 if name in INLINE or name in ("p", "article", "main") or re.fullmatch(r"h[1-6]", name) else -0.8 if name in BOILER else -2.0 if name == "body" else -0.5


class Weights(dict):
    def __missing__(self, feature: str) -> float:
        return prior(feature)


def best_region(tokens: list[Token], weights: dict[str, float], gold: tuple[int, int] | None = None) -> tuple[int, int]:
    """The contiguous token range of highest score (the first, on ties); empty if none is positive.

    With ``gold`` (training) every word outside it gains ``MARGIN`` and every one inside loses it, so
    weights must tell the two apart by that much."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, (feature, n, text, _) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, i
        total += weights[feature] * n
        if gold and text:
            total += n * (-MARGIN if gold[0] <= i < gold[1] else MARGIN)
        if total > best + 1e-9:
            best, where = total, (start, i + 1)
    return where


def labelled_region(tokens: list[Token]) -> tuple[int, int] | None:
    """The range inside the page's only content element, if there is just one."""
    at = [i for i, t in enumerate(tokens) if t[0] in ("<article", "</article", "<main", "/article", "/main")]
    opens = [i for i in at if tokens[i][0][0] == "<"]
    closes = [i for i in at if tokens[i][0][0] == "/"]
    return (opens[0], closes[0] + 1) if len(opens) == len(closes) == 1 and opens[0] < closes[0] else None


def _trim(tokens: list[Token], region: tuple[int, int]) -> tuple[int, int]:
    """Region without leading and trailing tokens other than ordinary words."""
    a, b = region
    good = [i for i in range(a, b) if tokens[i][0] in ("plain", "link") and tokens[i][1]]
    return (good[0], good[-1] + 1) if good else (0, 0)


def fit(pages: list[str], epochs: int = 3) -> Weights:
    """Weights from pages that delimit their content; the priors without any.

    Start: the log odds of a feature inside and outside the content, over five, at most ``SHIFT`` from
    its prior (so that one site's habits can't outweigh HTML's) and for tags not above zero. Then an
    averaged structured perceptron with margin corrects what still goes wrong."""
    total: Counter = Counter()
    weights, steps = Weights(), 0
    examples = [(t, _trim(t, r)) for t in map(tokenise, pages) if (r := labelled_region(t))]
    count: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for tokens, gold in examples:
        for i, (feature, n, _, _) in enumerate(tokens):
            count[gold[0] <= i < gold[1]][feature] += n
    for feature in sorted(count[True] | count[False]):
        odds = math.log((count[True][feature] + 5) / (count[False][feature] + 5)) / 5
        w = min(max(odds, prior(feature) - SHIFT), prior(feature) + SHIFT)
        weights[feature] = w if feature[0] not in "</" else min(w, 0.0)
    for _ in range(epochs):
        for tokens, gold in examples:
            guess = _trim(tokens, best_region(tokens, weights, gold))
            if guess != gold:
                change: Counter = Counter()
                for sign, (a, b) in ((1, gold), (-1, guess)):
                    for feature, n, _, _ in tokens[a:b]:
                        change[feature] += sign * n
                size = sum(abs(n) for n in change.values()) or 1
                for feature, n in change.items():
                    weights[feature] = weights[feature] + 2.0 * n / size
            steps += 1
            for feature, w in weights.items():
                total[feature] += w - prior(feature)
    return Weights({f: prior(f) + w / steps for f, w in total.items()}) if steps else Weights()


def extract(page: str | None, weights: Weights) -> str:
    """Main text: blocks in page order joined by a line feed, white space in a block collapsed."""
    tokens = tokenise(page or "")
    a, b = best_region(tokens, weights)
    blocks: list[list[str]] = [[]]
    for feature, _, text, block_end in tokens[a:b]:
        if block_end:
            blocks.append([])
        elif feature in ("plain", "link"):
            blocks[-1].append(text)
        elif feature[1:] == "br":
            blocks[-1].append(" ")
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in blocks) if t)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Fit on at most ``sample`` pages with content markup (lowest id hash), each under
    ``SAMPLE_CHARS`` characters; of pages that share an id the least."""
    marked = pick(pages, id=id_col, html=html_col).filter(F.col("html").rlike(r"(?i)<(article|main)\b") & (F.length("html") < SAMPLE_CHARS))
    # ranked by id alone, so that no task sends pages it may not keep
    ids = marked.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    rows = marked.filter(F.col("id").isin([r["id"] for r in ids])).groupBy("id").agg(F.min("html").alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: (str(r["id"]), r["html"]))])


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) per input row, from the whole page. Null or empty html, and pages without a
    positive run, give an empty text. Rows are independent; ``id_col`` may be a struct that carries
    more columns."""
    kind = pages.schema[id_col].dataType.simpleString()
    learned = dict(weights)

    def scan(batches):
        w = Weights(learned)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([extract(h, w) for h in part["html"].to_pylist()], pa.string())], ["id", "text"])

    return pick(pages, id=id_col, html=html_col).mapInArrow(scan, f"id {kind}, text string").withColumnRenamed("id", id_col)
