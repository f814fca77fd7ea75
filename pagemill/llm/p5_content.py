"""Problem 5: the article of a page without the site's furniture.

Site style tree: each page's html is cut into branches (a wrapper element with the blocks it holds itself) and the pages of
a host are merged by the path of the branch. A branch's presentation is the sequence of its blocks, its content their words.
The entropy of both over the pages of the host says how much the branch matters: furniture repeats its words, its shape, or
both; the article repeats neither. A tree over all hosts, with class names masked, speaks for hosts of few pages. Branches
of low importance are removed.

Pages kept as markdown only, and lines that match no block, first meet the verdicts that the tree has given the same line
(its kind, its words) on the host's pages with html, all of them. What no such page holds, or what they disagree about, is
judged by a linear model of lines, fitted on a bounded sample of lines that the tree has labelled (``SAMPLE_PAGES``): words,
marks, place in the page.

Defined results: blank lines and lines of null markdown are never given. Lines without letters meet no verdicts. Where no
page at all has html there is no verdict and no sample, and nothing is removed. Repeated rows give one row per line.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import host_of, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|([^<]+)|<", re.S)
_SKIP = re.compile(r"(?is)<(script|style|template|svg)\b.*?(?:</\1\s*>|\Z)|<head\b.*?(?:</head\s*>|(?=<body\b))|<!doctype[^>]*>")
_ATTRS = re.compile(r"""(?i)\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LETTERS = re.compile(r"[^\W\d_]+")
_TARGET = re.compile(r"\]\([^)]*\)")
_CODE = re.compile(r"(?=[0-9a-f]*\d)[0-9a-f]{4,}|\d{2,}")

WRAPPERS = frozenset("div section aside nav header footer main article form noscript dialog figure".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dt dd caption figcaption address summary tr span label button".split())
LISTS = frozenset("ul ol dl table tbody thead tfoot".split())
#: Weight of the tree over all hosts, in pages; importance from which on a branch is kept.
PRIOR, KEEP = 8.0, 0.7
#: Most pages of the sample that the model of lines is fitted on, and characters from which on it takes no further page, whatever
#: the size of a page; dimensions of that model.
SAMPLE_PAGES, SAMPLE_CHARS, BITS = 1500, 30_000_000, 17
#: Parts that the rows of a host are spread over where they meet its verdicts.
SALT = 16
#: Share of a line's places in a host that must agree before their verdict is the line's.
AGREE = 0.8


def key_of(text: str) -> str:
    """Runs of letters in lower case; link targets do not count."""
    return " ".join(_LETTERS.findall(_TARGET.sub("] ", text).lower()))


class _Branch:
    __slots__ = ("path", "shape", "keys", "words")

    def __init__(self, path: str):
        self.path, self.shape, self.keys, self.words = path, [], [], 0


def branches(page: str) -> list[_Branch]:
    """Branches of a page in order of their start; unclosed paragraphs, items, rows and cells end where the next block begins."""
    page = _SKIP.sub(" ", page)
    root = _Branch("")
    out, stack = [root], [("", root)]  # open wrappers: tag, branch
    block, text, cell = None, [], None  # the block that is being read; an open table cell with its attributes

    def flush() -> None:
        nonlocal block, text
        if text:
            raw = "".join(text)
            for part in raw.split("\n") if block == "pre" else [raw]:
                if (key := key_of(entities.unescape(part))) or part.strip():
                    branch = stack[-1][1]
                    branch.shape.append(block or "text")
                    branch.keys.append(key)
                    branch.words += key.count(" ") + 1
        block, text = None, []

    def push(tag: str, attrs: str) -> None:
        names = sorted(f"{a.lower()}={(b or c or d).strip()}" for a, b, c, d in _ATTRS.findall(attrs))
        mark = " ".join(re.sub(r"\d+", "#", x) if x.startswith("id=") else x for x in names)
        branch = _Branch(f"{stack[-1][1].path}/{tag} {mark}".rstrip())
        stack[-1][1].shape.append(tag)
        stack.append((tag, branch))
        out.append(branch)

    for m in _TOKEN.finditer(page):
        if m[4] is not None:
            if block or m[4].strip():
                text.append(m[4] if block == "pre" else m[4].replace("\n", " "))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in WRAPPERS or tag == "td" or tag == "th":
                if tag in ("td", "th"):
                    if block == "tr":
                        text.append(" ")
                        cell = None
                        continue
                    cell = None
                if any(t == tag for t, _ in stack):
                    flush()
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
            elif tag == block or tag in LISTS or tag in ("body", "html"):
                flush()
            continue
        if tag in WRAPPERS:
            if cell is not None and block == "tr":
                flush()
                push("td", cell)
            else:
                flush()
            cell = None
            push(tag, m[3])
        elif tag in ("td", "th"):
            if block != "tr":
                flush()
                block = "tr"
            text.append(" ")
            cell = m[3]
        elif tag in BLOCKS:
            if tag in ("span", "label", "button") and block:
                continue
            if cell is not None and block == "tr" and tag != "tr" and tag != "span":  # a cell that holds blocks is a wrapper
                flush()
                push("td", cell)
                cell = None
            if tag == "p" and block in ("li", "blockquote", "dd") and not "".join(text).strip():
                continue
            flush()
            block = tag
            if tag == "tr":
                cell = None
        elif tag in LISTS:
            if cell is not None and block == "tr":
                flush()
                push("td", cell)
                cell = None
            flush()
        elif tag == "br":
            text.append("\n" if block == "pre" else " ")
    flush()
    return [b for b in out if b.keys]


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode()) - (1 << 63)


def mask_path(path: str) -> str:
    """Path with the site's own part of class names masked, to compare sites of one template."""
    return _CODE.sub("#", path)


def aligned(markdown: str, page: str) -> tuple[list[tuple[int, int, int, int, list[int]]], list[int]]:
    """Branches as (path, masked path, shape, content, lines of markdown that are theirs), and the lines that match no block."""
    found = branches(page)
    owner: dict[str, list[int]] = {}
    for i, b in enumerate(found):
        for key in b.keys:
            owner.setdefault(key, []).append(i)
    lines: list[list[int]] = [[] for _ in found]
    rest, last, fenced, opened = [], None, False, []  # opened: lines that go with the next one
    for no, line in enumerate(markdown.split("\n")):
        if not line.strip():
            continue
        key = key_of(line)
        own = owner.get(key) if key else None
        if line.lstrip().startswith("```"):
            fenced = not fenced
            if fenced:
                opened.append(no)
                continue
        if own:
            last = own.pop(0) if len(own) > 1 else own[0]
            lines[last] += [*opened, no]
            opened = []
        elif not key and last is not None:
            lines[last].append(no)  # rules of tables and fences go with the line before
        else:
            rest.append(no)
    rest = sorted(rest + opened)
    out = []
    for b, own in zip(found, lines):
        masked = mask_path(b.path) + (" h1" if "h1" in b.shape else "")
        out.append((_hash(b.path), _hash(masked), _hash(" ".join(b.shape)), _hash("\n".join(b.keys)), own))
    return out, rest


def parse(pages: DataFrame) -> DataFrame:
    """(id, host, branches, rest, markdown) of pages (id, host, markdown, html) that have both; markdown only where lines are left over."""
    schema = f"id {pages.schema['id'].dataType.simpleString()}, host string, branches array<struct<path:long,mask:long,shape:long,content:long,lines:array<int>,keys:array<long>>>, rest array<int>, markdown string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, host, markdown, page in zip(batch["id"], batch["host"], batch["markdown"], batch["html"]):
                found, rest = aligned(markdown, page)
                keys = line_keys(markdown)
                found = [dict(zip(("path", "mask", "shape", "content", "lines"), b), keys=[keys[no] for no in b[4]]) for b in found]
                out.append((key, host, found, rest, markdown if rest else None))
            yield pd.DataFrame(out, columns=["id", "host", "branches", "rest", "markdown"])

    return pages.select("id", "host", "markdown", "html").mapInPandas(run, schema)


def _entropy(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Normalised entropy of the groups (keys..., n) under each value of keys: 0 all alike, 1 all different."""
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    value = F.when(total > 1, (F.log(total) - weighted / total) / F.log(total)).otherwise(1.0)
    return counts.groupBy(*keys).agg(value.alias(name), total.alias(f"n_{name}"))


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, path, mask, importance): entropy of presentation and content over the host's pages, with the tree over all hosts as prior."""
    found = parsed.select("host", F.inline("branches")).drop("lines", "keys")
    shapes = found.groupBy("host", "path", "mask", "shape").agg(F.count("*").alias("n"))
    contents = found.groupBy("host", "path", "mask", "content").agg(F.count("*").alias("n"))

    def least(keys: list[str], of: str) -> DataFrame:
        own, words = (_entropy(x.groupBy(*keys, k).agg(F.sum("n").alias("n")), keys, k) for x, k in ((shapes, "shape"), (contents, "content")))
        return own.join(words, keys).select(*keys, F.least("shape", "content").alias(of), F.col("n_shape").alias(f"n_{of}"))

    own, general = least(["host", "path"], "own"), least(["mask"], "general")
    places = shapes.select("host", "path", "mask").distinct()
    weight = F.col("n_own") - 1
    importance = (weight * F.col("own") + PRIOR * F.col("general")) / (weight + PRIOR)
    return places.join(own, ["host", "path"]).join(general, "mask").select("host", "path", "mask", importance.alias("importance"))


def labelled(parsed: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, host, lines, keys, kept) per branch. A host's rows are spread over SALT parts, its verdicts repeated in each."""
    found = parsed.select("id", "host", F.inline("branches")).where(F.size("lines") > 0)
    found = found.select("id", "host", "path", "mask", "lines", "keys", F.pmod(F.xxhash64("id"), F.lit(SALT)).alias("part"))
    verdicts = tree.select("host", "path", "mask", (F.col("importance") >= KEEP).alias("kept"), _parts())
    return found.join(verdicts, ["host", "path", "mask", "part"]).select("id", "host", "lines", "keys", "kept")


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("part")


def settled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, line_no, away) of lines (id, host, line_no, key, away): away as the host's labelled lines of that key have it where they agree.

    Counts come together before the shuffle and only keys that are asked for are kept; then rows and verdicts meet as in labelled().
    """
    asked = judged.where("key is not null").select("host", "key", F.lit(1).alias("asked"), F.lit(0).alias("own"), F.lit(0).alias("other"))
    told = labels.select("host", F.explode("keys").alias("key"), "kept").where("key is not null")
    told = told.select("host", "key", F.lit(0).alias("asked"), F.col("kept").cast("int").alias("own"), (~F.col("kept")).cast("int").alias("other"))
    counts = asked.union(told).groupBy("host", "key").agg(F.max("asked").alias("asked"), F.sum("own").alias("own"), F.sum("other").alias("other"))
    agreed = counts.where((F.col("asked") == 1) & (F.greatest("own", "other") >= AGREE * (F.col("own") + F.col("other"))) & (F.col("own") + F.col("other") > 0))
    verdicts = agreed.select("host", "key", (F.col("other") > F.col("own")).alias("verdict"), _parts())
    rows = judged.withColumn("part", F.pmod(F.xxhash64("id", "line_no"), F.lit(SALT)))
    return rows.join(verdicts, ["host", "key", "part"], "left").select("id", "line_no", F.coalesce("verdict", "away").alias("away"))


def line_kinds(lines: list[str], full: list[int]) -> dict[int, str]:
    """Kind of each line of full: heading, item, row of a table, link and so on."""
    kinds, fenced = {}, False
    for no in full:
        x = lines[no].strip()
        kind = "text"
        if x.startswith("```"):
            fenced, kind = not fenced, "fence"
        elif fenced:
            kind = "code"
        elif x.startswith("#"):
            kind = "h" + str(len(x) - len(x.lstrip("#")))
        elif x.startswith("|"):
            kind = "row"
        elif x.startswith("- "):
            kind = "item"
        elif x.startswith(">"):
            kind = "quote"
        elif x.startswith("**") and x.endswith("**"):
            kind = "bold"
        elif x.startswith("*") and x.endswith("*"):
            kind = "slant"
        if m := re.search(r"^(?:- )?\[[^\]]*\]\((\S*)\)\W*$", x):
            kind += "-out" if "://" in m[1] else "-in"
        kinds[no] = kind
    return kinds


def line_keys(markdown: str) -> dict[int, int | None]:
    """line_no -> hash of kind and words of every line that is not blank; None for a line without letters."""
    lines = markdown.split("\n")
    full = [no for no, x in enumerate(lines) if x.strip()]
    kinds = line_kinds(lines, full)
    return {no: _hash(f"{kinds[no]} {key}") if (key := key_of(lines[no])) else None for no in full}


def line_features(markdown: str) -> list[tuple[int, np.ndarray]]:
    """(line_no, hashed features) of every line that is not blank: its words, its marks, its place."""
    lines = markdown.split("\n")
    full = [no for no, x in enumerate(lines) if x.strip()]
    title = next((no for no in full if lines[no].startswith("# ")), None)
    kinds, sizes = line_kinds(lines, full), {}
    for no in full:
        words = len(_LETTERS.findall(_TARGET.sub("] ", lines[no].strip())))
        sizes[no] = 0 if words == 0 else 1 if words < 4 else 2 if words < 8 else 3 if words < 16 else 4 if words < 30 else 5
    long = [no for no in full if sizes[no] >= 4 and kinds[no] == "text"]
    first, last = (long[0], long[-1]) if long else (None, None)
    heading, out = "none", []
    for i, no in enumerate(full):
        x, kind = lines[no], kinds[no]
        if kind[0] == "h" and kind[1:].isdigit():
            heading = kind
        before = kinds[full[i - 1]] if i else "start"
        after = kinds[full[i + 1]] if i + 1 < len(full) else "end"
        place = ("title" if no == title else "before" if title is not None and no < title else "after") + ("-late" if last is not None and no > last else "-early" if first is not None and no < first else "")
        letters = [c for c in x if c.isalpha()]
        marks = [kind, place, f"{kind}/{place}", f"{kind}/{sizes[no]}", f"{kind}/{before}", f"{kind}/{after}", f"{kind}/{before}/{after}/{place}", f"{heading}/{kind}/{place}", f"end{min(len(full) - i, 4)}"]
        marks += [c for c in "|·›©»–…:,." if c in x]
        if letters and all(c.isupper() for c in letters):
            marks.append("caps")
        marks.append("stop" if x.rstrip(" *").endswith((".", "!", "?")) else "open")
        words = _LETTERS.findall(_TARGET.sub("] ", x).lower())
        if len(words) <= 40:
            marks += [f"w {w}" for w in words] + [f"b {a} {b}" for a, b in zip(words, words[1:])]
        marks += [f"first {' '.join(words[:k])}" for k in (1, 2)] + [f"last {' '.join(words[-2:])}", f"n {min(len(words), 40) // 3}", f"n {kind} {min(len(words), 40) // 5}"]
        out.append((no, np.unique(np.array([_hash(m) & ((1 << BITS) - 1) for m in marks], np.int64))))
    return out


def fit_lines(sample: list[tuple[str, list[int], list[int]]]) -> np.ndarray | None:
    """Weights of a linear model (positive: furniture) from (markdown, furniture lines, article lines)."""
    rows, signs = [], []
    for markdown, away, kept in sample:
        away, kept = set(away), set(kept)
        for no, f in line_features(markdown):
            if no in away or no in kept:
                rows.append(f)
                signs.append(1.0 if no in away else -1.0)
    if not rows or len(set(signs)) < 2:
        return None
    w, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    order = np.random.default_rng(5)
    unit = [1 / np.sqrt(len(r)) for r in rows]
    for _ in range(4):  # support vector machine by dual coordinate descent
        for i in order.permutation(len(rows)):
            r, s, u = rows[i], signs[i], unit[i]
            new = min(max(alpha[i] - (s * u * w[r].sum() - 1), 0.0), 1.0)
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * s * u
                alpha[i] = new
    return w


def furniture(records: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(id, line_no) of the lines that are not of the article, of records (id, url, markdown, html)."""
    pages = records.select("id", host_of(F.col("url")).alias("host"), "markdown", "html").where("markdown is not null")
    pages = pages.withColumn("host", F.coalesce("host", F.lit("")))
    parsed = written(parse(pages.where("html is not null")))
    labels = written(labelled(parsed, style_tree(parsed)))
    removed = labels.where("not kept").select("id", F.explode("lines").alias("line_no"))

    chosen = pages.where((F.length("markdown") > 0) & F.col("html").isNotNull()).select("id", F.xxhash64("id").alias("h"), F.length("markdown").alias("size"))
    before = F.sum("size").over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))  # over at most sample_pages rows
    chosen = chosen.orderBy("h", "id").limit(sample_pages).withColumn("before", before).where(F.coalesce("before", F.lit(0)) < SAMPLE_CHARS)
    sides = labels.join(F.broadcast(chosen.select("id")), "id", "left_semi")  # at most sample_pages ids
    sides = sides.groupBy("id").agg(F.flatten(F.collect_list(F.when(~F.col("kept"), F.col("lines")))).alias("away"), F.flatten(F.collect_list(F.when(F.col("kept"), F.col("lines")))).alias("own"))
    texts = pages.select("id", "markdown").join(F.broadcast(sides), "id")  # at most sample_pages rows
    weights = fit_lines([(r["markdown"], r["away"], r["own"]) for r in texts.orderBy("id").dropDuplicates(["id"]).collect()])
    shared = None if weights is None else records.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 2^BITS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = None if shared is None else shared.value
        for batch in batches:
            out = []
            for key, host, markdown, rest in zip(batch["id"], batch["host"], batch["markdown"], batch["rest"]):
                only, keys = None if rest is None else set(rest), line_keys(markdown)
                lines = [(no, False) for no in keys] if w is None else [(no, bool(w[f].sum() > 0)) for no, f in line_features(markdown) if only is None or no in only]
                out += [(key, host, no, keys[no], away) for no, away in lines if only is None or no in only]
            frame = pd.DataFrame(out, columns=["id", "host", "line_no", "key", "away"])
            yield frame.assign(key=pd.array([x[3] for x in out], "Int64"))

    alone = pages.where("html is null").select("id", "host", "markdown", F.lit(None).cast("array<int>").alias("rest"))
    left = alone.union(parsed.where("markdown is not null").select("id", "host", "markdown", "rest"))
    judged = left.mapInPandas(run, f"id {records.schema['id'].dataType.simpleString()}, host string, line_no int, key long, away boolean")
    return removed.union(settled(written(judged), labels).where("away").select("id", "line_no")).distinct()


def article(records: DataFrame, away: DataFrame) -> DataFrame:
    """(id, article): markdown without the lines given; runs of blank lines that this leaves are one."""
    drop = away.groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    lines = F.filter(F.split("markdown", "\n"), lambda x, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i))
    text = F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n(?:[ \t\r]*\n){2,}", "\n\n"))
    return records.select("id", "markdown").join(drop, "id", "left").select("id", text.alias("article"))


def found(records: DataFrame) -> DataFrame:
    """(scrape_id, line_no) of records (scrape_id, url, markdown, html)."""
    rows = records.select(F.col("scrape_id").alias("id"), "url", "markdown", "html").where("id is not null")
    return furniture(rows).withColumnRenamed("id", "scrape_id")
