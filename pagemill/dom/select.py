"""Selectors over a tree: a subset of CSS and of XPath.

CSS: type, *, #id, .class, [attr], [attr=v] with ~ | ^ $ * before =, :first-child, :last-child, :nth-child(n | odd | even | an+b),
:not(simple), the combinators descendant > + ~, and lists. XPath: steps of / and // with names, *, ., .., @name and text(),
and predicates [n], [last()], [@a], [@a='v'], [name], [.='v'], [contains(x, 'v')], [starts-with(x, 'v')] joined by and.
Anything else raises ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pagemill.dom.tree import Node

_SIMPLE = re.compile(
    r"(?P<type>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<v1>[^\"]*)\"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*)?\]"
    r"|:(?P<pseudo>first-child|last-child|nth-child|not)(?:\((?P<arg>[^()]*)\))?"
)


def _split_list(selector: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(selector):
        depth += c in "[("
        depth -= c in "])"
        if c == "," and not depth:
            parts.append(selector[at:i])
            at = i + 1
    return [*parts, selector[at:]]


@lru_cache(maxsize=512)
def _compile(selector: str) -> tuple:
    """Alternatives, each a tuple of (combinator, tests) from left to right."""
    out = []
    for part in _split_list(selector):
        part, i, steps, combinator = part.strip(), 0, [], " "
        if not part:
            raise ValueError(f"empty selector in {selector!r}")
        while i < len(part):
            if m := re.compile(r"\s*([>+~])\s*|\s+").match(part, i):
                combinator, i = m[1] or " ", m.end()
                continue
            tests = []
            while m := _SIMPLE.match(part, i):
                tests.append({k: v for k, v in m.groupdict().items() if v is not None})
                i = m.end()
            if not tests:
                raise ValueError(f"selector not understood: {selector!r}")
            steps.append((combinator, tuple(tuple(sorted(t.items())) for t in tests)))
            combinator = " "
        out.append(tuple(steps))
    return tuple(out)


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if c.tag is not None]


def _nth(argument: str, k: int) -> bool:
    argument = argument.replace(" ", "").lower()
    argument = {"odd": "2n+1", "even": "2n"}.get(argument, argument)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", argument):
        a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
        b = int(m[2] or 0)
        return k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0
    return argument.isdigit() and k == int(argument)


def _test(node: Node, tests: tuple) -> bool:
    for items in tests:
        t = dict(items)
        if "type" in t:
            if t["type"] != "*" and node.tag != t["type"].lower():
                return False
        elif "id" in t:
            if node.attrs.get("id") != t["id"]:
                return False
        elif "cls" in t:
            if t["cls"] not in node.attrs.get("class", "").split():
                return False
        elif "attr" in t:
            value = node.attrs.get(t["attr"].lower())
            if value is None:
                return False
            want = t.get("v1", t.get("v2", t.get("v3", "")))
            op = t.get("op")
            ok = {
                None: lambda: True,
                "=": lambda: value == want,
                "~=": lambda: want in value.split(),
                "|=": lambda: value == want or value.startswith(want + "-"),
                "^=": lambda: bool(want) and value.startswith(want),
                "$=": lambda: bool(want) and value.endswith(want),
                "*=": lambda: bool(want) and want in value,
            }[op]()
            if not ok:
                return False
        elif t["pseudo"] == "not":
            if any(_test(node, alternative[-1][1]) for alternative in _compile(t.get("arg", ""))):
                return False
        else:
            siblings = _elements(node.parent) if node.parent else [node]
            k = next(i for i, s in enumerate(siblings) if s is node) + 1
            if t["pseudo"] == "first-child" and k != 1 or t["pseudo"] == "last-child" and k != len(siblings):
                return False
            if t["pseudo"] == "nth-child" and not _nth(t.get("arg", ""), k):
                return False
    return True


def _matches(node: Node, steps: tuple, scope: Node) -> bool:
    combinator, tests = steps[-1]
    if not _test(node, tests):
        return False
    if len(steps) == 1:
        return True
    rest = steps[:-1]
    if combinator == ">":
        return node.parent is not None and node.parent.tag is not None and _matches(node.parent, rest, scope)
    if combinator in "+~":
        before = []
        for s in _elements(node.parent) if node.parent else []:
            if s is node:
                break
            before.append(s)
        return any(_matches(s, rest, scope) for s in (before[-1:] if combinator == "+" else before))
    up = node.parent
    while up is not None:
        if _matches(up, rest, scope):
            return True
        up = up.parent
    return False


def css(scope: Node, selector: str) -> list[Node]:
    """Descendants of scope that match, in document order."""
    alternatives = _compile(selector)
    return [n for n in scope.iter() if n is not scope and n.tag is not None and any(_matches(n, a, scope) for a in alternatives)]


_STEP = re.compile(r"(//?|^)(\.\.|\.|@[\w:-]+|text\(\)|\*|[A-Za-z][\w-]*)((?:\[[^\[\]]*\])*)")
_PREDICATE = re.compile(
    r"^(?:(?P<n>\d+)|(?P<last>last\(\))|(?:(?P<f>contains|starts-with)\(\s*(?P<fx>@[\w:-]+|text\(\)|\.)\s*,\s*(?P<fq>'[^']*'|\"[^\"]*\")\s*\))"
    r"|(?P<x>@[\w:-]+|text\(\)|\.|[A-Za-z][\w-]*)\s*(?:=\s*(?P<q>'[^']*'|\"[^\"]*\"))?)$"
)


def _value(node: Node, what: str) -> str | None:
    if what.startswith("@"):
        return node.attrs.get(what[1:].lower())
    if what == "text()":
        return node.text or None
    if what == ".":
        return node.text_content()
    child = next((c for c in node.children if c.tag == what.lower()), None)
    return child.text_content() if child is not None else None


def _holds(node: Node, predicate: str, position: int, size: int) -> bool:
    for part in re.split(r"\s+and\s+", predicate.strip()):
        m = _PREDICATE.match(part.strip())
        if not m:
            raise ValueError(f"predicate not understood: [{predicate}]")
        if m["n"]:
            ok = position == int(m["n"])
        elif m["last"]:
            ok = position == size
        elif m["f"]:
            value, want = _value(node, m["fx"]) or "", m["fq"][1:-1]
            ok = want in value if m["f"] == "contains" else value.startswith(want)
        else:
            value = _value(node, m["x"])
            ok = value is not None if m["q"] is None else value == m["q"][1:-1]
        if not ok:
            return False
    return True


def xpath(root: Node, expression: str) -> list[Node | str]:
    """Nodes or strings that the expression gives, in document order."""
    expression = expression.strip()
    found: list[Node | str] = [root]
    at = 0
    above = Node("#document")
    above.children = [root]
    if expression.startswith("/"):
        found = [above]
    elif expression.startswith("./"):
        at = 1
    while at < len(expression):
        m = _STEP.match(expression, at)
        if not m or m.end() == at:
            raise ValueError(f"xpath not understood: {expression!r}")
        axis, test, predicates = m[1], m[2], re.findall(r"\[([^\[\]]*)\]", m[3])
        at = m.end()
        out: list[Node | str] = []
        seen: set[int] = set()
        for node in found:
            if isinstance(node, str):
                continue
            scopes = [n for n in node.iter() if n.tag is not None] if axis == "//" else [node]
            for scope in scopes:
                if test.startswith("@"):
                    step: list[Node | str] = [v] if (v := scope.attrs.get(test[1:].lower())) is not None else []
                elif test == "text()":
                    step = [t for t in (scope.text, *(c.tail for c in scope.children)) if t]
                elif test == ".":
                    step = [scope]
                elif test == "..":
                    step = [scope.parent] if scope.parent is not None else []
                else:
                    step = [c for c in scope.children if c.tag is not None and (test == "*" or c.tag == test.lower())]
                for predicate in predicates:
                    step = [n for i, n in enumerate(step) if isinstance(n, Node) and _holds(n, predicate, i + 1, len(step))]
                for n in step:
                    if isinstance(n, Node):
                        if id(n) in seen:
                            continue
                        seen.add(id(n))
                    out.append(n)
        if axis == "//" and out and isinstance(out[0], Node):
            out.sort(key=lambda n: n.id)
        found = out
    return [n for n in found if n is not above]


def xpath_text(match: Node | str) -> str:
    """Text of a match: of an element with what follows it, stripped; a string as it is."""
    return match if isinstance(match, str) else (match.text_content() + match.tail).strip()
