"""LaTeX papers to a tree of titles, sections, sentences, lists, figures and equations.

Structure is found before commands are cleaned away, so that sections, lists and figures survive.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import deque
from collections.abc import Iterator

from ..functions.text import cleaned_text
from .bibtex import one_line

#: Names of main files in their order (fixed values).
MAIN = ("main.tex", "paper.tex", "ms.tex", "manuscript.tex", "article.tex", "root.tex")
#: Levels of sections, and the prefixes of their elements' ids (fixed values).
LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
PREFIX = {1: "sec", 2: "subsec", 3: "subsubsec", 4: "para", 5: "para"}
#: Environments (fixed values).
MATH = ("equation", "align", "gather", "multline", "flalign", "alignat", "eqnarray", "displaymath")
LISTS = ("itemize", "enumerate", "description")
FLOATS = ("figure", "table")
#: Abbreviations that end no sentence (fixed values).
SHORT = ["e.g.", "i.e.", "etc.", "vs.", "fig.", "figs.", "sec.", "secs.", "eq.", "eqs.", "dr.", "mr.", "ms.", "prof."]


def strip_comments(tex: str) -> str:
    return re.sub(r"(?<!\\)%.*", "", tex)


def main_file(files: dict[str, str]) -> str | None:
    """A file at the top with a usual name, else the first (by path) that includes others, else that has a class."""
    for name in MAIN:
        if name in files:
            return name
    for pattern, reach in ((r"\\(?:input|include|subfile|import)\b", 2000), (r"\\documentclass", None)):
        for path in sorted(files):
            if re.search(pattern, files[path][:reach]):
                return path
    return None


def safe_parts(name: str) -> list[str]:
    """The folders and the file of a path that a paper names, without steps up or to nowhere."""
    return [p for p in name.strip().strip('{}"').replace("\\", "/").split("/") if p not in ("", ".", "..")]


def include_name(name: str) -> str:
    return "/".join(safe_parts(name)).removesuffix(".tex")


def inline_includes(path: str, files: dict[str, str], seen: set[str] | None = None, only: set[str] | None = None) -> str:
    r"""The file with its includes put in, each file once. \includeonly restricts \include, by path or by the file's name
    alone; paths count from the file's own folder, else from the top; what is missing is empty."""
    seen = set() if seen is None else seen
    if path in seen or path not in files:
        return ""
    seen.add(path)
    tex = strip_comments(files[path])
    if only is None and (m := re.search(r"(?i)\\includeonly\{([^}]*)\}", tex)):
        only = {n for x in m[1].split(",") if (n := include_name(x))} or None
    tex = re.sub(r"(?i)\\includeonly\{[^}]*\}", "", tex)

    def put(m: re.Match) -> str:
        name = posixpath.join(m[2].strip(), m[3].strip()) if m[2] else m[3].strip().strip('"')
        if m[1] == "include" and only is not None and not {include_name(name), posixpath.basename(include_name(name))} & only:
            return ""
        for base in (posixpath.dirname(path), ""):
            for end in ("", ".tex"):
                target = posixpath.normpath(posixpath.join(base, name + end))
                if target in files:
                    return inline_includes(target, files, seen, only)
        return ""

    return re.sub(r"\\(input|include|subfile|import)\b(?:\{([^}]*)\}(?=\{))?\{([^}]*)\}", put, tex)


def strip_references(tex: str) -> str:
    tex = re.sub(r"(?is)\\begin\{thebibliography\}.*?\\end\{thebibliography\}", "", tex)
    tex = re.sub(r"(?i)\\bibliography(?:style)?\{[^}]*\}|\\printbibliography(?:\[[^\]]*\])?", "", tex)
    return re.split(r"\\end\{document\}", tex)[0]


def protect_math(text: str, cleaner) -> str:
    """cleaner applied to all but mathematics."""
    held: list[str] = []
    envs = "|".join(MATH)
    pattern = rf"(?s)\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|(?<!\\)\$[^$]+\$|\\begin\{{({envs})\*?\}}.+?\\end\{{\1\*?\}}"
    masked = re.sub(pattern, lambda m: held.append(m[0]) or f"\0{len(held) - 1}\0", text)
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], cleaner(masked))


def cleaned(text: str) -> str:
    """Text of an element: layout and environments go, commands give way to their arguments, mathematics stays."""

    def run(t: str) -> str:
        t = re.sub(r"\\\[[^\]]*\]|\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", " ", t)
        for _ in range(5):
            t = re.sub(r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])*\{([^{}]*)\}", r"\1", t)
        t = re.sub(r"\\\\|\\[A-Za-z@]+\*?|\\[^A-Za-z@]", " ", t)
        return re.sub(r"[\\{}]", " ", t)

    return re.sub(r"\s+", " ", protect_math(cleaned_text(text), run)).strip()


def sentences(text: str) -> list[str]:
    """Split after . ! ? before a capital; an initial before a capital and usual abbreviations end none."""
    hide = lambda m: m[0].replace(".", "\1")
    text = re.sub(r"\b[A-Z]\.(?=\s+[A-Z])", hide, text)
    text = re.sub("|".join(map(re.escape, sorted(SHORT, key=len, reverse=True))), hide, text)
    return [s.replace("\1", ".").strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]


class Tree:
    """Elements by content-addressed id, and children in order; one numbering for all versions of a paper."""

    def __init__(self, paper: str):
        self.paper, self.counts, self.known = paper, {}, {}
        self.elements: dict[str, str] = {f"{paper}::root": ""}
        self.children: dict[str, list[str]] = {}

    def add(self, prefix: str, text: str, parent: str, key: str | None = None) -> str:
        """The id of the element, told apart by `key`, or by its text."""
        norm = " ".join((text if key is None else key).lower().split())
        if (prefix, norm) not in self.known:
            n = self.counts[prefix] = self.counts.get(prefix, 0) + 1
            self.known[prefix, norm] = f"{self.paper}::{prefix}_{n:03d}::{hashlib.sha1(norm.encode()).hexdigest()[:6]}"
            self.elements[self.known[prefix, norm]] = text
        own = self.known[prefix, norm]
        if own not in self.children.setdefault(parent, []) and own != parent:
            self.children[parent].append(own)
        return own

    def parents(self) -> dict[str, str]:
        """child to parent, the last parent of a repeated child, in breadth-first order; unreached ones last."""
        up = {c: p for p, cs in self.children.items() for c in cs}
        down: dict[str, list[str]] = {}
        for c, p in up.items():
            down.setdefault(p, []).append(c)
        order, todo = {}, deque([f"{self.paper}::root"])
        while todo:
            for c in sorted(down.get(todo.popleft(), [])):
                if c not in order:
                    order[c] = up[c]
                    todo.append(c)
        return order | {c: p for p, c in sorted((p, c) for c, p in up.items() if c not in order)}


def add_sentences(tree: Tree, text: str, parent: str) -> None:
    for s in sentences(cleaned(text)):
        tree.add("sent", s, parent)


def nested(text: str, names: tuple[str, ...]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, body) of the outermost environments of these names, nested ones of the same name within their bodies."""
    mark = re.compile(rf"\\(begin|end)\{{({'|'.join(names)})(\*?)\}}(?:\[[^\]]*\])?")
    depth, first = 0, None
    for m in mark.finditer(text):
        if first is None:
            if m[1] == "begin":
                first, depth = m, 1
        elif (m[2], m[3]) == (first[2], first[3]):
            depth += 1 if m[1] == "begin" else -1
            if not depth:
                yield first.start(), m.end(), first[2], text[first.end() : m.start()]
                first = None


def top_items(body: str) -> list[str]:
    """What stands between the \\item commands of a list itself, not of lists within it."""
    inner = [(a, b) for a, b, _, _ in nested(body, LISTS)]
    cuts = [m.span() for m in re.finditer(r"\\item\b(?:\s*\[[^\]]*\])?", body) if not any(a <= m.start() < b for a, b in inner)]
    edges = [0, *(x for cut in cuts for x in cut), len(body)]
    return [body[a:b].strip() for a, b in zip(edges[::2], edges[1::2], strict=True)]


def float_text(body: str) -> str:
    """A figure's or table's caption, or without one its text."""
    caption = re.search(r"(?s)\\caption(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", body)
    body = caption[1] if caption else re.sub(r"(?s)\\includegraphics(?:\[.*?\])?\{.*?\}", "", body)
    return cleaned(re.sub(r"\\label\{[^}]*\}", "", body))


def add_body(tree: Tree, text: str, parent: str) -> None:
    """Lists, figures, tables, equations and sentences, in the text's order; an item is parsed like a body of its own."""
    at = 0
    for start, end, name, body in nested(text, LISTS + FLOATS + MATH):
        add_sentences(tree, text[at:start], parent)
        at = end
        if name in LISTS:
            own = tree.add("list", name, parent, f"{name}:{cleaned(body)}")
            for item in top_items(body):
                if item:
                    add_body(tree, item, tree.add("item", cleaned(item), own))
        elif name in FLOATS:
            tree.add("fig", float_text(body), parent)
        else:
            inner = one_line(re.sub(r"\\label\{[^}]*\}|\\nonumber\b", "", body))
            tree.add("eq", rf"\begin{{equation}}{inner}\end{{equation}}", parent)
    add_sentences(tree, text[at:], parent)


def parse_document(tree: Tree, tex: str) -> None:
    root = f"{tree.paper}::root"
    tex = re.sub(r"(?s)\\\[(.+?)\\\]|\$\$(.+?)\$\$", lambda m: rf"\begin{{equation}}{m[1] or m[2]}\end{{equation}}", tex)
    if m := re.search(r"(?s)\\title(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}", tex):
        tree.add("sent", cleaned(m[1]), root)
    if m := re.search(r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}", tex):
        add_body(tree, m[1], tree.add("sec", "Abstract", root))
        tex = tex.replace(m[0], "")
    tex = tex.split(r"\begin{document}")[-1]
    tex = re.sub(r"\\maketitle|\\tableofcontents|\\(?:title|author|date|thanks)(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}", "", tex)
    heads = list(re.finditer(rf"\\({'|'.join(LEVELS)})\*?(?:\[[^\]]*\])?\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}", tex))
    add_body(tree, tex[: heads[0].start()] if heads else tex, root)
    stack = [(0, root)]
    for m, after in zip(heads, [*heads[1:], None], strict=False):
        title, level = cleaned(m[2]), LEVELS[m[1]]
        if re.search(r"(?i)\breferences?\b|bibliography", title):
            continue
        while stack[-1][0] >= level:
            stack.pop()
        own = tree.add(PREFIX[level], title, stack[-1][1])
        stack.append((level, own))
        add_body(tree, tex[m.end() : after.start() if after else len(tex)], own)
