"""What is done to one page: cleaning, choice of the main content, conversion, extraction. Pure functions over trees."""

from __future__ import annotations

import json
import re
from collections import Counter
from math import log, sqrt
from urllib.parse import urljoin
from xml.sax.saxutils import escape as escape_xml

from pagemill.dom.select import css, xpath, xpath_text
from pagemill.dom.tree import Node, body_of, parse, serialize

# Fixed values.
STRIPPED_TAGS = ("script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "aside")
STRIPPED_ROLES = ("navigation", "banner", "contentinfo")
ENOUGH = 200
PRUNED_TAGS = ("nav", "footer", "aside", "header", "form", "noscript", "figcaption")
PRUNED_WORDS = (
    "sidebar", "footer", "header", "nav", "menu", "breadcrumb", "widget", "banner", "advert", "cookie", "social", "share", "comment", "related", "popup", "modal", "overlay",
    "newsletter", "signup", "pagination", "pager", "copyright", "disclaimer", "masthead", "topbar", "toolbar",
)
RELEVANCE_TAGS = ("p", "div", "section", "article", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre")
HIDDEN_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden", "opacity:0", "opacity: 0", "left:-9999", "top:-9999", "position:absolute")
VIDEO_HOSTS = ("youtube", "vimeo", "dailymotion", "wistia")

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PRUNED = re.compile("|".join(PRUNED_WORDS), re.IGNORECASE)
_TAGS = re.compile(r"<[^>]+>")


def visible_length(html: str) -> int:
    return len(_TAGS.sub("", html).strip())


def metadata(root: Node) -> tuple[str, str, str]:
    """(title, description, language), empty where missing."""
    title = root.find("title")
    described = next((m for m in root.find_all("meta") if m.attrs.get("name") == "description"), None)
    html = root if root.tag == "html" else root.find("html")
    return (
        title.text_content().strip() if title is not None else "",
        described.attrs.get("content", "") if described is not None else "",
        html.attrs.get("lang", "") if html is not None else "",
    )


def preprocess(html: str, excluded_tags: list[str] | None = None, excluded_selector: str | None = None, css_selector: str | None = None) -> str:
    """Without the excluded parts, scoped to a selector; a selector that matches nothing leaves the page whole."""
    if not (excluded_tags or excluded_selector or css_selector):
        return html
    root = parse(html)
    if excluded_tags:
        for n in root.find_all(*(t.lower() for t in excluded_tags)):
            n.remove(keep_tail=True)
    if excluded_selector:
        for n in css(root, excluded_selector):
            n.remove(keep_tail=True)
    if css_selector and (found := css(root, css_selector)):
        return "<html><body>" + "".join(serialize(n) for n in found) + "</body></html>"
    return serialize(root)


def strip_boilerplate(root: Node) -> None:
    """Take out furniture by tag and role, together with the text that follows the element."""
    for n in [n for n in root.iter() if n.tag in STRIPPED_TAGS or n.attrs.get("role") in STRIPPED_ROLES]:
        n.remove(keep_tail=False)


def _density_choice(root: Node) -> Node | None:
    """The element whose own paragraphs weigh most: length and commas count, text inside links counts against."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for p in root.find_all("p", "pre", "td", "blockquote"):
        text = p.joined(" ")
        if len(text) < 25:
            continue
        value = 1 + text.count(",") + min(len(text) // 100, 3)
        up, share = p.parent, 1.0
        while up is not None and share >= 0.25 and up.tag not in ("html", None):
            scores[id(up)] = scores.get(id(up), 0.0) + value * share
            nodes[id(up)] = up
            up, share = up.parent, share / 2
    best, most = None, 0.0
    for key, score in scores.items():
        n = nodes[key]
        text = len(n.joined())
        linked = sum(len(a.joined()) for a in n.find_all("a"))
        name = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
        score *= (1 - linked / text) if text else 0
        score *= 0.5 if _PRUNED.search(name) else 1.0
        if score > most:
            best, most = n, score
    return best


def main_content(html: str) -> tuple[str, str, str, str]:
    """(title, description, language, content html) of a preprocessed page."""
    if not html or not html.strip():
        return "", "", "", ""
    root = parse(html)
    title, description, language = metadata(root)
    strip_boilerplate(root)
    articles, mains = root.find_all("article"), root.find_all("main")
    roles = [n for n in root.iter() if n.attrs.get("role") == "main"]
    for found in (articles if len(articles) == 1 else [], mains, roles):
        if found and visible_length(content := serialize(found[0])) >= ENOUGH:
            return title, description, language, content
    best = _density_choice(root)
    content = serialize(best) if best is not None else ""
    if visible_length(content) < ENOUGH:
        content = serialize(body_of(root))
    return title, description, language, content


def drop_short_blocks(html: str, threshold: int) -> str:
    """Without leaf blocks of fewer words than threshold; empty ones stay."""
    root = parse(html)
    for n in root.find_all("p", "li", "td", "th", "span", "div"):
        text = n.joined()
        if text and len(text.split()) < threshold and n.find("p", "li", "div", "section", "article") is None:
            n.remove(keep_tail=True)
    return serialize(body_of(root))


def prune(html: str, text_density: float = 0.1, link_density: float = 0.6) -> str:
    """Without furniture by tag, by class or id, and by density of text and links."""
    if not html or not html.strip():
        return html
    root = parse(html)
    for n in root.find_all(*PRUNED_TAGS):
        n.remove(keep_tail=True)
    for n in [n for n in root.iter() if n.tag not in (None, "html", "body")]:
        if _PRUNED.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"):
            n.remove(keep_tail=True)
    for n in root.find_all("div", "section", "article", "table"):
        if n.parent is None or not _attached(n, root):
            continue
        text = len(n.joined())
        whole = len(serialize(n))
        linked = sum(len(a.joined()) for a in n.find_all("a"))
        if not text or text / whole < text_density or linked / text > link_density:
            n.remove(keep_tail=True)
    return serialize(body_of(root))


def _attached(node: Node, root: Node) -> bool:
    while node.parent is not None:
        node = node.parent
    return node is root


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def relevant_blocks(html: str, query: str, top_k: int = 10, threshold: float = 0.05) -> str:
    """Blocks like the query by the cosine of weights of the query's terms, in document order; the page itself if none is."""
    terms = tokens(query or "")
    if not terms or not html or not html.strip():
        return html
    blocks = [n for n in parse(html).find_all(*RELEVANCE_TAGS) if len(n.joined()) > 20]
    if not blocks:
        return html
    bags = [Counter(tokens(b.text_content())) for b in blocks]
    n = len(blocks)
    distinct = list(dict.fromkeys(terms))
    df = {t: sum(t in bag for bag in bags) for t in distinct}
    weight = {t: (log((n + 1) / (df[t] + 1)) if df[t] else log(n + 1)) + 1 for t in distinct}
    norm = sqrt(sum(w * w for w in weight.values())) or 1.0
    scored = []
    for i, bag in enumerate(bags):
        vector = {t: bag[t] * weight[t] for t in distinct}
        length = sqrt(sum(v * v for v in vector.values())) or 1.0
        # A term given twice counts twice in the product but once in the lengths.
        likeness = sum(weight[t] * vector[t] for t in terms) / (norm * length)
        if likeness >= threshold:
            scored.append((-likeness, i))
    kept = sorted(i for _, i in sorted(scored)[:top_k])
    return "<div>" + "".join(serialize(blocks[i]) for i in kept) + "</div>" if kept else html


class _Markdown:
    """Markdown by rules on tags: leaves take their flattened text, other elements their own text, children and tails."""

    DROPPED = ("script", "style", "noscript", "svg", "template")
    WRAPPED = {"strong": "**{}**", "b": "**{}**", "em": "*{}*", "i": "*{}*", "code": "`{}`"}
    # Fixed values (and tr, which has a rule of its own).
    BLOCKS = ("p", "div", "section", "article", "main", "blockquote", "ul", "ol", "table", "thead", "tbody", "tfoot", "dl", "figure", "figcaption", "details", "summary")

    def __init__(self) -> None:
        self.out: list[str] = []

    def line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def leaf(self, n: Node) -> bool:
        """Write n if it is a leaf; whether it was one."""
        tag, put = n.tag, self.out.append
        if tag in HEADINGS or tag == "li":
            if text := n.text_content().strip():
                self.line()
                put(f"{'#' * int(tag[1])} {text}\n" if tag != "li" else f"- {text}\n")
            elif tag == "li":
                self.line()
        elif tag == "a":
            text, href = n.text_content().strip(), n.attrs.get("href", "")
            if text:
                put(f"[{text}]({href})" if href else text)
        elif tag == "img":
            if src := n.attrs.get("src", ""):
                put(f"![{n.attrs.get('alt', '')}]({src})")
        elif tag in self.WRAPPED:
            if text := n.text_content().strip():
                put(self.WRAPPED[tag].format(text))
        elif tag == "pre":
            if text := n.text_content().strip():
                self.line()
                put(f"```\n{text}\n```\n")
        elif tag == "br":
            put("\n")
        elif tag == "hr":
            self.line()
            put("---\n")
        elif tag in ("td", "th"):
            put(n.text_content().strip() + " | ")
        else:
            return tag in self.DROPPED
        return True

    def write(self, root: Node) -> None:
        # An explicit stack of things to do: deep pages must not exhaust the interpreter's.
        todo: list = [root]
        while todo:
            x = todo.pop()
            if not isinstance(x, Node):
                x()
                continue
            tail = x.tail.strip()
            if tail and x is not root:
                todo.append(lambda t=tail: self.out.append(f" {t} "))
            if self.leaf(x):
                continue
            if x.tag == "tr":
                self.out.append("| ")
                todo.append(lambda: self.out.append("\n"))
            else:
                text = "" if x.tag is None else x.text.strip()
                if x.tag == "blockquote":
                    self.line()
                if text:
                    self.out.append(f"> {text} " if x.tag == "blockquote" else f"{text} ")
                if x.tag in self.BLOCKS:
                    todo.append(self.line)
            todo.extend(reversed(x.children))


def to_markdown(html: str) -> str:
    root = parse(html)
    for n in root.find_all(*_Markdown.DROPPED):
        n.remove(keep_tail=False)
    writer = _Markdown()
    writer.write(body_of(root))
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(writer.out).splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def to_text(html: str) -> str:
    """All text, that of scripts and styles included; blank lines run together."""
    lines = (x.strip() for x in parse(html).text_content().splitlines())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def flow(html: str) -> list[tuple[str, str]]:
    """(tag, text) of headings, paragraphs and list items in document order."""
    return [(n.tag, text) for n in parse(html).find_all(*HEADINGS, "p", "li") if (text := n.text_content().strip())]


def to_sections(html: str) -> list[dict]:
    sections: list[dict] = []
    for tag, text in flow(html):
        if tag in HEADINGS:
            sections.append({"heading": text, "level": int(tag[1]), "content": []})
            continue
        if not sections:
            sections.append({"heading": "", "level": 0, "content": []})
        sections[-1]["content"].append(text)
    return sections


def to_json(html: str) -> str:
    return json.dumps(to_sections(html), ensure_ascii=False, separators=(",", ":"))


def _csv_row(cells: list[str]) -> str:
    quoted = ['"' + c.replace('"', '""') + '"' if re.search(r'[,"\r\n]', c) else c for c in cells]
    return (",".join(quoted) if len(cells) != 1 or cells[0] else '""') + "\r\n"


def to_csv(html: str) -> str:
    """Rows of all tables with a blank row after each; without tables, the flow under a heading row."""
    root = parse(html)
    tables = root.find_all("table")
    if not tables:
        return "".join([_csv_row(["section", "content"]), *(_csv_row([a, b]) for a, b in flow(html))]).strip()
    out = []
    for table in tables:
        out += [_csv_row([c.text_content().strip() for c in cells]) if (cells := row.find_all("th", "td")) else "\r\n" for row in table.find_all("tr")]
        out.append("\r\n")
    return "".join(out).strip()


def to_xml(html: str) -> str:
    parts = [f"<{tag}>{escape_xml(text)}</{tag}>" for tag, text in flow(html)]
    body = f"<document>{''.join(parts)}</document>" if parts else "<document />"
    return f"<?xml version='1.0' encoding='utf-8'?>\n{body}"


def tables(html: str, table_index: int | None = None) -> list[dict]:
    """Tables with caption, headers and rows; see the operator for the rules."""
    found = list(enumerate(parse(html).find_all("table")))
    if table_index is not None:
        found = [x for x in found if x[0] == table_index]
    out = []
    for index, table in found:
        caption, head, first = table.find("caption"), table.find("thead"), table.find("tr")
        row = head.find("tr") if head is not None else None
        headers = [c.joined() for c in row.find_all("th", "td")] if row is not None else []
        if not headers and first is not None:
            headers = [c.joined() for c in first.find_all("th")]
        raw = [[c.joined() for c in cells] for r in (table.find("tbody") or table).find_all("tr") if (cells := r.find_all("td", "th"))]
        raw = [r for r in raw if r != headers]
        out.append(
            {
                "index": index,
                "caption": caption.joined() if caption is not None else None,
                "headers": headers,
                "rows": [dict(zip(headers, r)) for r in raw] if headers else [],
                "raw_rows": raw,
                "row_count": len(raw),
                "column_count": len(headers),
            }
        )
    return out


def tables_csv(found: list[dict]) -> str:
    out = []
    for i, t in enumerate(found):
        if i:
            out.append("\r\n")
        if t["caption"]:
            out.append(_csv_row([f"# {t['caption']}"]))
        if t["headers"]:
            out.append(_csv_row(t["headers"]))
        out += [_csv_row(r) for r in t["raw_rows"]]
    return "".join(out)


def media(html: str, base_url: str | None) -> dict[str, list[dict]]:
    """Images, videos, audio and links with absolute addresses."""
    root = parse(html)

    def full(src: str) -> str:
        try:
            return urljoin(base_url, src) if base_url else src
        except ValueError:
            return src

    def sources(n: Node) -> list[dict]:
        nested = [{"src": full(s.attrs["src"]), "type": s.attrs.get("type", "")} for s in n.find_all("source") if s.attrs.get("src")]
        return nested + ([{"src": full(n.attrs["src"]), "type": ""}] if n.attrs.get("src") else [])

    images, videos, audio, links = [], [], [], []
    for n in root.iter():
        a = n.attrs
        if n.tag == "img" and (src := a.get("src") or a.get("data-src") or a.get("data-lazy-src")):
            images.append({"src": full(src), "alt": a.get("alt", ""), "title": a.get("title", ""), **{k: a[k] for k in ("width", "height", "srcset") if a.get(k)}})
        elif n.tag == "video" and (s := sources(n)):
            videos.append({"sources": s, "poster": full(a["poster"]) if a.get("poster") else None, "width": a.get("width"), "height": a.get("height")})
        elif n.tag == "audio" and (s := sources(n)):
            audio.append({"sources": s})
        elif n.tag == "a" and (href := a.get("href")) and not href.startswith(("#", "javascript:", "mailto:")):
            link = {"href": full(href), "text": n.joined(), "title": a.get("title", "")}
            if rel := " ".join(a.get("rel", "").split()):
                link["rel"] = rel
            if a.get("target"):
                link["target"] = a["target"]
            links.append(link)
    for n in root.iter():
        for u in re.findall(r"url\([\"']?([^\"')\s]+)[\"']?\)", n.attrs.get("style", "")):
            images.append({"src": full(u), "alt": "", "title": "", "source": "css-background"})
        if n.tag == "iframe" and any(h in n.attrs.get("src", "") for h in VIDEO_HOSTS):
            videos.append({"sources": [{"src": n.attrs["src"], "type": "embed"}], "poster": None, "width": n.attrs.get("width"), "height": n.attrs.get("height"), "embed": True})
    return {"images": images, "videos": videos, "audio": audio, "links": links}


def hidden(a: Node) -> bool:
    """A link that a reader cannot see."""
    style = a.attrs.get("style", "").lower()
    above = a.parent.attrs.get("style", "").lower() if a.parent is not None else ""
    return any(s in style for s in HIDDEN_STYLES) or "display:none" in above or "display: none" in above or a.attrs.get("aria-hidden") == "true"


def crawl_links(html: str, base_url: str) -> list[tuple[str, bool]]:
    """(absolute address, hidden) of every link in order."""
    out = []
    for a in parse(html).find_all("a"):
        if "href" in a.attrs:
            try:
                out.append((urljoin(base_url or "", a.attrs["href"]), hidden(a)))
            except ValueError:
                continue
    return out


def followed_links(html: str, base_url: str) -> list[str]:
    """Absolute addresses of the visible links of a page that may be indexed, one parse for both."""
    return [] if noindex(html) else [u for u, unseen in crawl_links(html, base_url) if not unseen]


def noindex(html: str) -> bool:
    """A robots or googlebot meta tag within the first 10,000 characters forbids indexing."""
    return any(m.attrs.get("name", "").lower() in ("robots", "googlebot") and "noindex" in m.attrs.get("content", "").lower() for m in parse(html[:10_000]).find_all("meta"))


def _css_value(n: Node, attribute: str | None) -> str | None:
    return n.attrs.get(attribute) if attribute else n.joined()


def css_fields(scope: Node, fields: dict) -> dict:
    out: dict = {}
    for name, spec in fields.items():
        spec = spec if isinstance(spec, dict) else {"selector": spec}
        found = css(scope, spec["selector"]) if spec.get("selector") else []
        values = [_css_value(n, spec.get("attribute")) for n in found]
        out[name] = values if spec.get("all") else values[0] if values else None
    return out


def css_records(html: str, selectors: dict) -> list[dict]:
    root = parse(html)
    if "container" in selectors and "fields" in selectors:
        rows = (css_fields(n, selectors["fields"]) for n in css(root, selectors["container"]))
        return [r for r in rows if any(v is not None for v in r.values())]
    return [css_fields(root, selectors)]


def xpath_record(html: str, queries: dict[str, str]) -> dict:
    root, out = parse(html), {}
    for name, expression in queries.items():
        try:
            found = [xpath_text(m) for m in xpath(root, expression)]
        except ValueError:
            found = []
        out[name] = None if not found else found[0] if len(found) == 1 else found
    return out


def regex_text(html: str) -> str:
    """Text the regular expressions run over: a line per piece."""
    return parse(html).joined("\n")


#: Seconds that one pattern may take on one page.
REGEX_SECONDS = 5


def _finder(pattern: str):
    """finditer of a pattern with a time limit; TimeoutError beyond it."""
    import regex

    compiled = regex.compile(pattern, regex.MULTILINE | regex.DOTALL)
    return lambda text: compiled.finditer(text, timeout=REGEX_SECONDS)


def _groups(m) -> str | tuple:
    return m[0] if not m.groups() else m.groups("")[0] if len(m.groups()) == 1 else m.groups("")


def regex_record(html: str, patterns: dict[str, str]) -> dict:
    """What each pattern finds; nothing where it takes too long."""
    text, out = regex_text(html), {}
    for name, pattern in patterns.items():
        try:
            found = [_groups(m) for m in _finder(pattern)(text)]
        except TimeoutError:
            found = []
        out[name] = None if not found else found[0] if len(found) == 1 else found
    return out


def regex_records(html: str, pattern: str) -> list[dict]:
    """A record per match: named groups, else all groups, else the match. A pattern that takes too long gives what it found until then."""
    rows = []
    try:
        for m in _finder(pattern)(regex_text(html)):
            rows.append(m.groupdict() or {"match": list(m.groups()) if m.groups() else m[0]})
    except TimeoutError:
        pass
    return rows or [{}]
