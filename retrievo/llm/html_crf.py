"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A block's features are the elements it stands in with the words of their class, id and role, and properties of its text.
The chain's labels are main text or not; weights of features and of label changes are trained on labelled pages and the
best labels of a page found by Viterbi. Training pages are a bounded sample of the pages whose markup itself says what
is main text, each also in other layouts: the same blocks in other containers, with the parts that pages have around
and inside an article. Pages are independent, so extraction shuffles nothing.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from retrievo.llm.html_blocks import Block, blocks

TRAIN_PAGES = 300   # labelled pages that are learned from, in each of their layouts
LAYOUTS = 5
EPOCHS, RATE, DECAY = 5, 0.3, 1e-4
MAIN = frozenset({"article", "main"})
NOT_MAIN = frozenset({"nav", "aside", "footer", "form", "menu", "dialog", "button", "select"})

# Containers as (element, name parts): where pages keep their text, and what stands around and inside it.
_CONTENT = [[("article", ())], [("main", ())], [("main", ()), ("article", ())], [("div", ("content",))], [("div", ("main",))],
            [("div", ("post", "body"))], [("div", ("entry", "content"))], [("section", ("story",))], [("div", ("article", "body"))],
            [("div", ("text",))], [("td", ("content",))], [], [("div", ("page",)), ("div", ("content",))], [("section", ())], [("div", ())]]
_AROUND = [[("nav", ())], [("header", ())], [("footer", ())], [("aside", ())], [("form", ())], [("menu", ())], [("dialog", ())],
           *[[(e, (w,))] for e in ("div", "section", "ul", "aside") for w in (
               "nav", "navigation", "menu", "header", "banner", "footer", "sidebar", "side", "widget", "ad", "ads", "advert",
               "advertisement", "sponsor", "sponsored", "promo", "cookie", "consent", "notice", "popup", "modal", "overlay",
               "alert", "newsletter", "subscribe", "signup", "login", "search", "form", "comment", "comments", "reply",
               "replies", "discussion", "related", "recommended", "more", "links", "share", "social", "breadcrumb",
               "breadcrumbs", "toolbar", "copyright", "legal", "tags", "pagination", "pager", "toc", "author", "meta")],
           [("div", ("site", "header"))], [("div", ("site", "footer"))], [("div", ("cookie", "banner"))], [("header", ()), ("nav", ())],
           [("div", ("comments",)), ("div", ("comment", "body"))], [("section", ("comments",)), ("article", ("comment",))],
           [("div", ("comment", "list")), ("div", ("comment", "text"))], [("aside", ("sidebar",)), ("div", ("widget",))]]
_LEAF_IN = [("p", ()), ("p", ()), ("p", ()), ("h2", ()), ("li", ()), ("blockquote", ()), ("div", ()), ("h3", ()), ("pre", ()), ("td", ())]
_LEAF_OUT = [("p", ()), ("li", ()), ("div", ()), ("h3", ()), ("label", ()), ("td", ()), ("h1", ())]


def features(page: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        own = ["bias"]
        for element, parts in b.chain:
            own.append("in:" + element)
            own += ["name:" + p for p in parts]
        own.append("leaf:" + (b.chain[-1][0] if b.chain else ""))
        n = len(b.text)
        own.append(f"size:{min(5, int(math.log2(n + 1) / 1.5))}")
        own.append(f"linked:{int(b.linked * 3)}")
        own.append("stop" if b.text[-1] in ".!?\"'»”" else "no stop")
        if "©" in b.text:
            own.append("copyright")
        own.append("first" if i == 0 else "last" if i == len(page) - 1 else "between")
        out.append(list(dict.fromkeys(own)))
    return out


def marked_labels(page: list[Block]) -> list[int] | None:
    """Labels from the markup: inside an article or main element and in nothing that is never main text."""
    if not any(e in MAIN for b in page for e, _ in b.chain):
        return None
    return [int(any(e in MAIN for e, _ in b.chain) and not any(e in NOT_MAIN for e, _ in b.chain)) for b in page]


def other_layout(page: list[Block], labels: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The page's blocks in another container, with other parts before, inside and after."""
    root = [("html", ()), ("body", ())] + ([("div", (rng.choice(["wrapper", "container", "page"]),))] if rng.random() < 0.4 else [])
    content = root + rng.choice(_CONTENT)
    texts = [b.text for b in page]
    out, marks = [], []

    def around(base: list) -> None:
        box = rng.choice(_AROUND)
        linked = rng.random() if rng.random() < 0.5 else 0.0
        for _ in range(rng.randint(1, 5)):
            text = rng.choice(texts)
            if rng.random() < 0.6:
                words = text.split()
                at = rng.randrange(len(words))
                text = " ".join(words[at:at + rng.randint(1, 12)])
            leaf = [rng.choice(_LEAF_OUT)] if rng.random() < 0.7 else []
            out.append(Block(text, tuple(base + box + leaf), linked, 0))
            marks.append(0)

    for _ in range(rng.randint(0, 4)):
        around(root)
    for b, y in zip(page, labels):
        if y:
            title = not any(marks) and rng.random() < 0.7
            inner = [("h1", ())] if title else [rng.choice(_LEAF_IN)]
            if rng.random() < 0.1:
                inner = [(rng.choice(["div", "section", "figure", "blockquote", "ul", "table"]), ())] + inner
            out.append(Block(b.text, tuple(content + inner), b.linked, b.breaks))
            marks.append(1)
            if rng.random() < 0.2:
                around(content)
    for _ in range(rng.randint(0, 4)):
        around(content if rng.random() < 0.4 else root)
    return out, marks


class Field:
    """Weights of the chain: a block's score for main text, and scores of label changes; the start counts as not main."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.change = np.zeros((2, 2))

    def scores(self, page: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in own]) for own in page]

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        (c00, c01), (c10, c11) = self.change.tolist()
        zero, one, back = 0.0, -math.inf, []
        for s in scores:
            to0, to1 = one + c10 > zero + c00, one + c11 > zero + c01
            back.append((to0, to1))
            zero, one = (one + c10 if to0 else zero + c00), (one + c11 if to1 else zero + c01) + s
        y, out = int(one > zero), []
        for step in reversed(back):
            out.append(y)
            y = int(step[y])
        return out[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], np.ndarray]:
        """Probability of main text for each block, and expected label changes, forward and backward."""
        n, change = len(scores), self.change
        forward = np.zeros((n, 2))
        before = np.array([0.0, -1e9])
        for i, s in enumerate(scores):
            forward[i] = np.logaddexp(before[0] + change[0], before[1] + change[1]) + (0, s)
            before = forward[i]
        total = np.logaddexp(*forward[-1])
        after, expected, p = np.zeros(2), np.zeros((2, 2)), [0.0] * n
        for i in range(n - 1, -1, -1):
            p[i] = float(np.exp(forward[i, 1] + after[1] - total))
            left = forward[i - 1] if i else np.array([0.0, -1e9])
            step = left[:, None] + change + (np.array([0, scores[i]]) + after)[None, :]
            expected += np.exp(step - total)
            after = np.logaddexp(change[:, 0] + after[0], change[:, 1] + scores[i] + after[1])
        return p, expected


def train(pages: list[tuple[list[list[str]], list[int]]], seed: int = 3) -> Field:
    """Likelihood ascent with steps that shrink by each weight's own past slopes."""
    field, past, past_change = Field(), {}, np.full((2, 2), 1e-6)
    rng = random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(pages)
        for page, labels in pages:
            p, expected = field.marginals(field.scores(page))
            slope: dict[str, float] = {}
            for own, y, q in zip(page, labels, p):
                if abs(y - q) > 1e-4:
                    for f in own:
                        slope[f] = slope.get(f, 0.0) + y - q
            for f, g in slope.items():
                w = field.weight.get(f, 0.0)
                g -= DECAY * w
                past[f] = past.get(f, 1e-6) + g * g
                field.weight[f] = w + RATE * g / math.sqrt(past[f])
            seen = np.zeros((2, 2))
            np.add.at(seen, ([0, *labels[:-1]], labels), 1)
            g = seen - expected
            past_change += g * g
            field.change += RATE * g / np.sqrt(past_change)
    return field


def fit(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> Field:
    """The field trained on a bounded sample of self-labelled pages: those with the smallest hashes of their HTML."""
    marked = pages.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    sample = marked.orderBy(F.xxhash64("html"), "html").limit(limit).collect()
    rng, data = random.Random(11), []
    for row in sample:
        page = blocks(row.html)
        labels = marked_labels(page)
        if labels and any(labels):
            data.append((features(page), labels))
            for _ in range(LAYOUTS):
                made, marks = other_layout(page, labels, rng)
                data.append((features(made), marks))
    return train(data)


def extract_text(html: str | None, field: Field) -> str:
    page = blocks(html or "")
    return " ".join(b.text for b, y in zip(page, field.decode(field.scores(features(page)))) if y)


def extract_main(pages: DataFrame, field: Field, html: str = "html") -> DataFrame:
    """Every row with ``text``, the main text (empty if there is none), and ``n_chars``, its code points.

    White space inside a block is one space, blocks are joined by one in page order. A null, empty or textless page has
    no text; markup may be cut off or unbalanced anywhere. Columns named like a result are replaced, all others kept;
    rows may repeat and ids be null.
    """
    results = [StructField("text", StringType()), StructField("n_chars", LongType())]
    pages = pages.drop(*[r.name for r in results])
    sent = pages.sparkSession.sparkContext.broadcast((field.weight, field.change))

    def run(batches):
        own = Field()
        own.weight, own.change = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract_text(h, own) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*part.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, *results]))
