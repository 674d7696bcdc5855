"""HTML, Markdown, wiki and LaTeX markup in texts: what it expresses, and the text without it.

A text is read into a tree of candidate nodes: elements, spans between marks,
commands, lines with a leading mark. Gradient-boosted trees over features of a
node (its name and attributes, what stands around and inside it, depth,
density of its subtree, siblings) say how likely it is markup and not text that
looks alike. The tree is then decoded from the leaves up and from the root
down, so that choices agree: within code and formulas nothing is read as other
markup. The trees are trained here, on nodes of a bounded sample of the table.
Their labels come from what the features don't hold: whether the end of an
element was found and names like it are ended elsewhere, whether a formula,
target or entity can be read, and which languages the rest of the text shows.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvidex.llm.features import hash_sample
from corvidex.llm.tokens import text_slices
from corvidex.llm.trees import Boosted, train_boosted
from corvidex.session import ship

#: Texts the trees are fitted on, about; a smaller table gives all texts.
TRAIN_TEXTS = 4000
KINDS = ("heading", "list", "code", "formula")

# Element names of HTML, MathML and wiki pages.
_ELEMENTS = frozenset(
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details div dl dt em embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark math menu meta nav noscript ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr mi mo mn mrow mfrac msup msub msubsup msqrt mtext mtable mtr mtd mover munder ref nowiki gallery syntaxhighlight noinclude poem".split()
)
_VOID = frozenset("br hr img input link meta col embed wbr param".split())
# Elements whose end may be left out.
_OPEN_ENDED = frozenset("li p dt dd td th tr thead tbody tfoot option".split())
_KIND_OF = {**{f"h{i}": "heading" for i in range(1, 7)}, "ul": "list", "ol": "list", "li": "list", "dl": "list", "dt": "list", "dd": "list", "pre": "code", "code": "code", "source": "code", "syntaxhighlight": "code", "tt": "code", "kbd": "code", "samp": "code", "math": "formula"}
_BLOCKS = frozenset("p div br hr tr table blockquote section article header footer nav main aside figure ul ol dl pre h1 h2 h3 h4 h5 h6".split())
# Commands and environments of LaTeX.
_COMMANDS = {**dict.fromkeys("chapter section subsection subsubsection paragraph subparagraph title part".split(), "heading"), "item": "list", "texttt": "code", "verb": "code", "lstinline": "code"} | dict.fromkeys(
    "textbf textit textsc textrm textsf emph underline cite citep citet ref eqref label href url footnote caption includegraphics usepackage documentclass maketitle noindent newline linebreak bf it em tt centering begin end".split(), "inline"
)
_ENVIRONMENTS = {**dict.fromkeys("itemize enumerate description".split(), "list"), **dict.fromkeys("verbatim lstlisting minted alltt".split(), "code"), **dict.fromkeys("equation align eqnarray displaymath math gather multline equation* align*".split(), "formula")}
# Wiki templates that show their last argument; others show nothing of their own in running text.
_SHOWN_TEMPLATES = frozenset("lang nowrap nobr small big smaller larger center sub sup abbr transl ill quote".split())

TAG, ESCAPED, COMMENT, ENTITY, TICKS, STRONG, EM, LINK, WIKI_LINK, WIKI_QUOTE, TEMPLATE, COMMAND, GROUP, DOLLARS, BRACKETS, BREAK, FENCE, BRACES, RULE, HASHES, EQUALS, BULLET, INDENT, ENVIRONMENT, QUOTE, CELL, DEFINITION = range(27)

_INLINE = re.compile(
    r"(?P<comment><!--.*?-->|&lt;!--.*?--&gt;)"
    r"|<(?P<tclose>/?)(?P<tname>[A-Za-z][A-Za-z0-9]*)(?P<tattr>(?>[^<>\"']+|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>"
    r"|&lt;(?P<eclose>/?)(?P<ename>[A-Za-z][A-Za-z0-9]*)(?P<eattr>(?>[^<>&]|&(?!lt;|gt;))*+)&gt;"
    r"|&(?:amp;)?(?P<entity>#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    r"|(?P<ticks>`+)(?P<tickin>[^`\n]+?)(?P=ticks)(?!`)"
    r"|(?P<image>!?)\[(?!\[)(?P<linktext>[^\[\]\n]*)\]\((?P<linkto>(?:[^()\s]|\([^()\s]*\))*)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'))?\)"
    r"|\[\[(?P<wiki>[^\[\]\n]+)\]\]"
    r"|\[(?P<ext>(?:https?|ftp)://[^\s\]]+)(?P<extname> [^\]\n]*)?\]"
    r"|\[(?!\[)(?P<reftext>[^\[\]\n]+)\] ?\[(?P<refto>[^\[\]\n]*)\]"
    r"|(?P<strong>\*\*|__|~~)(?=\S)(?P<strongin>[^\n]+?)(?<=\S)(?P=strong)"
    r"|(?P<em>[*_])(?=[^\s*_])(?P<emin>[^*_\n]+?)(?<=\S)(?P=em)"
    r"|(?P<quotes>'{2,5})(?P<quotein>[^'\n](?:[^'\n]|'(?!'))*?)(?P=quotes)"
    r"|\{\\(?P<group>[a-z]+) (?P<groupin>[^{}\n]*)\}"
    r"|\\(?P<command>[A-Za-z]+)(?P<star>\*?)(?P<args>(?:\[[^\[\]\n]*\])?(?:\{(?:[^{}\n]|\\.|\{[^{}\n]*\})*\})*)"
    r"|\\\((?P<paren>.+?)\\\)|\\\[(?P<bracket>.+?)\\\]"
    r"|(?P<linebreak>\\\\)(?=\s*$)"
    r"|\$\$(?P<display>[^$]+?)\$\$|\$(?P<dollar>[^$\n]+?)\$",
    re.S | re.M,
)
_ANY = re.compile(r"[<&`*_~\[{\\$]|''|(?m:^\s*(?:[+#=-]|\d+[.)]\s|>\s| {4}))").search
_LINE = re.compile(r"[ \t]*(?:(?P<fence>```+|~~~+)(?P<lang>\w*)[ \t]*$|(?P<braces>\{\{\{|\}\}\})[ \t]*$|(?P<rule>-{3,}|={3,})[ \t]*$|(?P<hashes>#{1,6}) ?(?=\S)|(?P<equals>={1,6})(?=[^=]).*[^=](?P=equals)[ \t]*$|(?P<bullet>[*+-]|\*{2,4}|\d{1,3}[.)])[ \t]+(?=\S)|(?P<star>\*)(?=[\w¿])(?![^*\n]*\*)|(?P<quote>>) |(?P<cell>\|-|\{\||\|\}|\|\+?|!)|(?P<definition>\[[^\[\]\n]+\]:[ \t]*\S+.*$))")
_BRACES2 = re.compile(r"\{\{\{+|\}\}\}+|\{\{|\}\}")
_CELLS = re.compile(r"\|\||!!")
_DEFINITION = re.compile(r"(?m)^[ \t]*\[([^\[\]\n]+)\]:[ \t]*\S")
_ENV = re.compile(r"\\begin\{(\w+\*?)\}(?:\[[^\]\n]*\])?(.*?)\\end\{\1\}", re.S)
_ATTRIBUTES = re.compile(r"(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|&#39;.*?&#39;|&quot;.*?&quot;|[^\s\"'=<>`]+))?)*\s*/?$")
_VISIBLE = re.compile(r"[^\W_]")


@dataclass
class Node:
    family: int
    start: int
    end: int
    name: str = ""
    kind: str = "inline"
    inner: tuple[int, int] = (0, 0)
    paired: bool = True
    attributes: str = ""
    run: int = 1  # neighbouring lines with the same mark
    edits: tuple = ()  # (from, to, instead)
    children: list = field(default_factory=list)
    depth: int = 0


def _line_nodes(text: str) -> list[Node]:
    """Nodes that leading marks of lines make."""
    nodes: list[Node] = []
    at, open_fence, open_braces = 0, None, None
    lines = text.split("\n")
    before = ""
    previous: Node | None = None
    indent: Node | None = None
    in_table = False
    for line in lines:
        end = at + len(line)
        found = _LINE.match(line) if line[:1] in " \t*+-#=`~{}>|!\\[0123456789" else None
        node = None
        if open_fence is not None:
            if found and found["fence"] and found["fence"][0] == open_fence.name[0] and not found["lang"]:
                open_fence.end, open_fence.paired = end, True
                open_fence.edits += ((at, end, "```"),)
                open_fence.inner = (open_fence.inner[0], at)
                open_fence = None
        elif found:
            k = found.lastgroup
            mark = next((found[g] for g in ("fence", "braces", "rule", "hashes", "equals", "bullet", "star", "quote", "cell", "definition") if found[g]), "")
            if found["fence"]:
                node = open_fence = Node(FENCE, at, end, mark, "code", (end, len(text)), False, edits=((at, end, "```" + (found["lang"] or "")),))
            elif found["braces"]:
                if mark == "{{{":
                    node = open_braces = Node(BRACES, at, end, mark, "code", (end, end), False, edits=((at, end, "```"),))
                elif open_braces:
                    open_braces.end, open_braces.paired, open_braces.inner = end, True, (open_braces.inner[0], at)
                    open_braces.edits += ((at, end, "```"),)
                    open_braces = None
            elif found["rule"]:
                heading = bool(before.strip()) and len(before) < 120 and not re.match(r"\s*[-=*#]", before)
                node = Node(RULE, at, end, mark[0], "heading" if heading else "inline", (at - len(before) - 1, at - 1) if heading else (at, end), heading)
                level = "# " if mark[0] == "=" else "## "
                node.edits = ((at - len(before) - 1, at - len(before) - 1, level), (at - 1, end, "")) if heading else ((at, end, ""),)
            elif found["hashes"]:
                tail = re.search(r"[ \t]#+[ \t]*$", line)
                node = Node(HASHES, at, end, mark, "heading", (at + found.end(), end), bool(tail) or line[found.end("hashes") : found.end("hashes") + 1] == " ")
                node.edits = ((at + found.start("hashes"), at + found.end(), mark + " "),) + (((at + tail.start(), end, ""),) if tail else ())
            elif found["equals"]:
                inside = line.strip()
                n = len(mark)
                node = Node(EQUALS, at, end, mark, "heading", (at + line.index(inside) + n, at + line.index(inside) + len(inside) - n))
                node.edits = ((at, node.inner[0], "#" * n + " "), (node.inner[1], end, ""))
            elif found["bullet"] or found["star"]:
                node = Node(BULLET, at, end, mark if not mark[0].isdigit() else "1", "list", (at + found.end(), end), edits=((at, at + found.end(), ("  " * (len(mark) - 1) if mark[0] == "*" else "") + (f"{mark[:-1]}. " if mark[0].isdigit() else "- ")),))
            elif found["quote"]:
                node = Node(QUOTE, at, end, mark, "inline", (at + found.end(), end), edits=((at, at + found.end(), ""),))
            elif found["cell"]:
                if mark == "{|":
                    in_table = True
                if mark in ("|-", "{|", "|}"):
                    node = Node(CELL, at, end, mark, "inline", (at, end), edits=((at, min(end + 1, len(text)), ""),))
                    in_table = in_table and mark != "|}"
                elif in_table:
                    node = _cells(text, at, end, at + found.end(), mark)
            elif found["definition"]:
                node = Node(DEFINITION, at, end, "[", "inline", (at, end), edits=((at, end, ""),))
        if node is None and open_fence is None and line.startswith("    ") and line.strip():
            if indent is not None:
                indent.end, indent.inner = end, (indent.start, end)
                indent.run += 1
            elif not before.strip() and open_braces is None:
                node = indent = Node(INDENT, at, end, "    ", "code", (at, end))
        elif line.strip():
            indent = None
        if node is not None:
            if previous is not None and node.family == previous.family == BULLET and previous.end + 1 == at or previous is not None and node.family == previous.family == HASHES and previous.end + 1 == at:
                node.run = previous.run + 1
                previous.run += 1
            nodes.append(node)
        previous, before, at = node if node is not None else (previous if not line.strip() else None), line, end + 1
    if open_fence is not None:
        open_fence.end, open_fence.inner = len(text), (open_fence.inner[0], len(text))
    number, at = 0, -1
    for n in nodes:  # lines of # one after another number a list, they aren't headings
        if n.family == HASHES and n.run > 1 and n.name == "#":
            number = number + 1 if n.start == at + 1 else 1
            n.kind, n.edits, at = "list", ((n.edits[0][0], n.edits[0][1], f"{number}. "), *n.edits[1:]), n.end
    return nodes


def _cells(text: str, start: int, end: int, at: int, mark: str) -> Node:
    """A row of cells of a wiki table: marks out, a tab between cells, attributes of cells out."""
    edits, first = [], start
    while True:
        found = _CELLS.search(text, at, end)
        stop = found.start() if found else end
        bar = text.find("|", at, stop)
        skip = bar + 1 if bar >= 0 and "=" in text[at:bar] and "[[" not in text[at:bar] else at
        while text[skip : skip + 1] == " " and skip < stop:
            skip += 1
        edits.append((first, skip, "" if first == start else "\t"))
        if not found:
            break
        first = len(text[:stop].rstrip(" ")) if stop > skip else stop
        at = found.end()
    return Node(CELL, start, end, mark, "inline", (start, end), edits=tuple(edits))


def _template_nodes(text: str) -> list[Node]:
    """Templates of any depth and over any lines, by a stack of braces; triple braces are parameters or code."""
    nodes: list[Node] = []
    stack: list[int] = []
    for m in _BRACES2.finditer(text):
        n = m.end() - m.start()
        if m[0][0] == "{":
            if n != 3:
                stack += [m.start() + 2 * i for i in range(n // 2)]
        else:
            at = m.start()
            for _ in range(n // 2):
                if not stack:
                    break
                start, end = stack.pop(), at + 2
                inner = text[start + 2 : at]
                name = re.match(r"\s*([^|{}\n]*)", inner)[1].strip()
                if name.lower().split("-")[0] in _SHOWN_TEMPLATES and "|" in inner:
                    cut = _last_bar(inner)
                    nodes.append(Node(TEMPLATE, start, end, name, "inline", (start + 2 + cut, at), edits=((start, start + 2 + cut, ""), (at, end, ""))))
                else:
                    nodes.append(Node(TEMPLATE, start, end, name, "inline", (start + 2, at), edits=((start, end, ""),)))
                at = end
    return nodes


def _last_bar(inner: str) -> int:
    """Where the last argument of a template begins, bars of inner templates and links aside."""
    depth, cut = 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", inner):
        if m[0] == "|":
            cut = m.end() if not depth else cut
        else:
            depth += 1 if m[0][0] in "{[" else -1
    return cut


def nodes_of(text: str) -> list[Node]:
    """All candidate nodes of a text, sorted by place, the wider first."""
    if not _ANY(text):
        return []
    nodes = _line_nodes(text)
    environments: set[int] = set()
    if "\\begin{" in text:
        for m in _ENV.finditer(text):
            kind = _ENVIRONMENTS.get(m[1], "inline")
            mark = "```" if kind == "code" else "$$" if kind == "formula" else ""
            nodes.append(Node(ENVIRONMENT, m.start(), m.end(), m[1], kind, m.span(2), edits=((m.start(), m.start(2), mark), (m.end(2), m.end(), mark))))
            environments |= {m.start(), m.end() - len(m[1]) - 6}
    if "{{" in text:
        nodes += _template_nodes(text)
    targets = {x.lower() for x in _DEFINITION.findall(text)} if "]:" in text else set()
    targets = {x for x in targets if text.lower().count(f"[{x}]") > 1}  # a definition nobody refers to is none
    if any(n.family == DEFINITION for n in nodes):
        nodes = [n for n in nodes if n.family != DEFINITION or text[n.start : n.end].partition("]")[0].strip(" \t[").lower() in targets]
    open_tags: list[Node] = []
    at = 0
    while (m := _INLINE.search(text, at)) is not None:
        at = m.end()
        s, e = m.span()
        k = m.lastgroup
        if m["tname"] or m["ename"]:
            escaped = bool(m["ename"])
            name, closing, attr = (m["ename"].lower(), m["eclose"], m["eattr"]) if escaped else (m["tname"].lower(), m["tclose"], m["tattr"])
            family = ESCAPED if escaped else TAG
            if "\n" in attr and not _ATTRIBUTES.match(attr):  # a tag over several lines must be one
                at = m.end("ename") if escaped else m.end("tname")
                continue
            if closing:
                for i in range(len(open_tags) - 1, -1, -1):
                    o = open_tags[i]
                    if o.name == name and o.family == family:
                        o.end, o.paired, o.inner = e, True, (o.inner[0], s)
                        o.edits += ((s, e, _tag_text(name, True)),)
                        del open_tags[i:]
                        break
                else:
                    nodes.append(Node(family, s, e, name, _KIND_OF.get(name, "inline"), (e, e), False, attr, edits=((s, e, _tag_text(name, True)),)))
                continue
            node = Node(family, s, e, name, _KIND_OF.get(name, "inline"), (e, e), name in _VOID or attr.endswith("/"), attr, edits=((s, e, _tag_text(name, False)),))
            nodes.append(node)
            if not node.paired:
                open_tags.append(node)
        elif m["comment"]:
            nodes.append(Node(COMMENT, s, e, "!--", edits=((s, e, ""),)))
        elif m["entity"]:
            if m["entity"][0] != "#" and m["entity"] + ";" not in html.entities.html5:
                continue
            nodes.append(Node(ENTITY, s, e, m["entity"], edits=((s, e, html.unescape("&" + m["entity"] + ";")),)))
        elif m["ticks"]:
            nodes.append(Node(TICKS, s, e, m["ticks"], "code", m.span("tickin")))
        elif m["linkto"] is not None:
            nodes.append(Node(LINK, s, e, m["image"], "inline", m.span("linktext"), edits=((s, m.start("linktext"), ""), (m.end("linktext"), e, ""))))
        elif m["reftext"]:
            if (m["refto"] or m["reftext"]).lower() not in targets:
                at = m.end("reftext")
                continue
            nodes.append(Node(LINK, s, e, "[]", "inline", m.span("reftext"), edits=((s, m.start("reftext"), ""), (m.end("reftext"), e, ""))))
        elif m["wiki"]:
            keep = m.start("wiki") + m["wiki"].rfind("|") + 1
            nodes.append(Node(WIKI_LINK, s, e, "[[", "inline", (keep, m.end("wiki")), edits=((s, keep, ""), (m.end("wiki"), e, ""))))
        elif m["ext"]:
            keep = m.start("extname") + 1 if m["extname"] else m.start("ext")
            nodes.append(Node(WIKI_LINK, s, e, "[", "inline", (keep, e - 1), edits=((s, keep, ""), (e - 1, e, ""))))
        elif m["strong"]:
            nodes.append(Node(STRONG, s, e, m["strong"], "inline", m.span("strongin"), edits=((s, s + 2, ""), (e - 2, e, ""))))
        elif m["em"]:
            nodes.append(Node(EM, s, e, m["em"], "inline", m.span("emin"), edits=((s, s + 1, ""), (e - 1, e, ""))))
        elif m["quotes"]:
            n = len(m["quotes"])
            nodes.append(Node(WIKI_QUOTE, s, e, m["quotes"], "inline", m.span("quotein"), edits=((s, s + n, ""), (e - n, e, ""))))
        elif m["group"]:
            nodes.append(Node(GROUP, s, e, m["group"], "code" if m["group"] == "tt" else "inline", m.span("groupin"), edits=((s, m.start("groupin"), ""), (e - 1, e, ""))))
        elif m["command"]:
            name, args = m["command"], m["args"]
            if name in ("begin", "end") and (s in environments or args.strip("{}") in _ENVIRONMENTS):
                if s not in environments:
                    nodes.append(Node(COMMAND, s, e, name, _ENVIRONMENTS[args.strip("{}")], (e, e), False, edits=((s, e, ""),)))
                continue
            kind = _COMMANDS.get(name, "inline")
            first = args.rfind("{") if args.endswith("}") else -1
            inner = (m.start("args") + first + 1, e - 1) if first >= 0 else (e, e)
            mark = "## " if kind == "heading" else "- " if kind == "list" else "`" if kind == "code" else ""
            after = e + (kind == "list" and text[e : e + 1] == " ")  # the mark brings its own blank
            gone = name in ("cite", "citep", "citet", "ref", "eqref", "label", "includegraphics", "usepackage", "documentclass")
            tied = gone and text[s - 1 : s] == "~"  # the blank that ties a reference to its word
            edits = ((s - tied, e, ""),) if gone else ((s, inner[0], mark), (inner[1], e, "`" if kind == "code" else "")) if first >= 0 else ((s, after, mark),)
            nodes.append(Node(COMMAND, s, e, name, kind, inner, bool(args), m["star"], edits=edits))
        elif m["paren"] or m["bracket"]:
            inner = m.span("paren") if m["paren"] else m.span("bracket")
            mark = "$" if m["paren"] else "$$"
            nodes.append(Node(BRACKETS, s, e, mark, "formula", inner, edits=((s, inner[0], mark), (inner[1], e, mark))))
        elif m["display"] or m["dollar"]:
            nodes.append(Node(DOLLARS, s, e, "$$" if m["display"] else "$", "formula", m.span("display") if m["display"] else m.span("dollar")))
        elif m["linebreak"]:
            nodes.append(Node(BREAK, s, e, "\\\\", edits=((s, e, ""),)))
    for n in nodes:
        if n.name in ("script", "style", "ref") and n.family in (TAG, ESCAPED) and n.paired:
            n.edits = ((n.start, n.end, ""),)
    nodes.sort(key=lambda n: (n.start, -n.end))
    return nodes


def _tag_text(name: str, closing: bool) -> str:
    """What stands for a tag in clean text."""
    kind = _KIND_OF.get(name)
    if kind == "heading":
        return "\n" if closing else "\n" + "#" * int(name[1]) + " "
    if name == "li":
        return "" if closing else "\n- "
    if name in ("td", "th"):
        return "" if closing else "\t"
    if name == "tr":
        return "\n"
    if kind == "code":
        return ("\n```" if closing else "```\n") if name in ("pre", "source", "syntaxhighlight") else "`"
    if kind == "formula":
        return "$"
    return "\n" if name in _BLOCKS and (closing or name in _VOID) else ""


def link(nodes: list[Node]) -> list[Node]:
    """The roots, after every node has got its children and depth."""
    roots: list[Node] = []
    path: list[Node] = []
    for n in nodes:
        n.children = []
        while path and path[-1].end < n.end:
            path.pop()
        n.depth = len(path)
        (path[-1].children if path else roots).append(n)
        if n.end - n.start > 2:
            path.append(n)
    return roots


def _char(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 3 if c in "_\\" else 2


def attribute_tokens(n: Node) -> int:
    """0 none, 1 to 6 a bucket of the well-formed attributes' first name, 7 malformed."""
    if not n.attributes.strip(" /"):
        return 0
    if n.family not in (TAG, ESCAPED):
        return 1
    if not _ATTRIBUTES.match(n.attributes):
        return 7
    return 1 + zlib.crc32(re.match(r"\s*([\w:-]*)", n.attributes)[1].lower().encode()) % 6


FEATURES = 19


def known_name(n: Node) -> bool:
    if n.family in (TAG, ESCAPED):
        return n.name in _ELEMENTS
    if n.family in (COMMAND, GROUP):
        return n.name in _COMMANDS
    return n.family != ENVIRONMENT or n.name.rstrip("*") in _ENVIRONMENTS or len(n.name) > 3


def features(text: str, roots: list[Node], nodes: list[Node]) -> list[tuple]:
    """A row of features for each of ``nodes``, after ``link``: what stands in, at and around a node, and its place in the tree.

    Nothing in a row tells what ``evidence_label`` looks at: whether the node's
    end was found, whether what is inside can be read, and what else the text holds.
    """
    hidden: dict[int, int] = {}  # characters of marks in the subtree
    below: dict[int, int] = {}
    order: list[Node] = []
    siblings: dict[int, tuple[int, float, int]] = {}
    stack = [roots]
    while stack:
        group = stack.pop()
        families: dict[int, int] = {}
        for x in group:
            families[x.family] = families.get(x.family, 0) + 1
        for i, x in enumerate(group):
            siblings[id(x)] = (min(len(group), 50), families[x.family] / len(group), min(i, 20))
            order.append(x)
            if x.children:
                stack.append(x.children)
    for x in reversed(order):
        hidden[id(x)] = sum(t - f for f, t, _ in x.edits) + sum(hidden[id(c)] for c in x.children)
        below[id(x)] = len(x.children) + sum(below[id(c)] for c in x.children)
    out = []
    size = len(text)
    for n in nodes:
        a, b = n.inner
        marks = sum(text.count(c, a, b) for c in "\\^_={}+") if n.family in (DOLLARS, BRACKETS, EM, STRONG, TICKS) else 0
        many, alike, place = siblings[id(n)]
        out.append((
            n.family,
            known_name(n),
            attribute_tokens(n),
            _char(text[n.start - 1 : n.start]),
            _char(text[n.end : n.end + 1]) if n.end < size else 0,
            _char(text[a : a + 1]) if b > a else 0,
            _char(text[b - 1 : b]) if b > a else 0,
            (b - a) ** 0.5,
            n.depth,
            many,
            alike,
            place,
            min(n.run, 10),
            1 - min(1.0, hidden[id(n)] / max(1, n.end - n.start)),
            min(below[id(n)], 50),
            marks / (b - a + 1),
            text[a : a + (b > a)].isdigit(),
            n.start == 0 or text[n.start - 1] == "\n",
            bool(_VISIBLE.search(text, a, b)),
        ))
    return out


# Languages, and the families whose nodes, where they can be read whole, show that a text is written in one.
HTML, MARKDOWN, WIKI, TEX = "html", "markdown", "wiki", "tex"
_LANGUAGE = {TAG: HTML, ESCAPED: HTML, COMMENT: HTML, ENTITY: HTML, LINK: MARKDOWN, FENCE: MARKDOWN, TICKS: MARKDOWN, STRONG: MARKDOWN, EM: MARKDOWN, RULE: MARKDOWN, HASHES: MARKDOWN, BULLET: MARKDOWN, QUOTE: MARKDOWN, INDENT: MARKDOWN, DEFINITION: MARKDOWN} | {
    WIKI_LINK: WIKI, WIKI_QUOTE: WIKI, TEMPLATE: WIKI, BRACES: WIKI, EQUALS: WIKI, CELL: WIKI, COMMAND: TEX, GROUP: TEX, DOLLARS: TEX, BRACKETS: TEX, BREAK: TEX, ENVIRONMENT: TEX
}
_WORD_PAIR = re.compile(r"(?<![\\\w])[^\W\d_]{3,} +[^\W\d_]{2,}|(?<![\\\w])[^\W\d_]{2,} +[^\W\d_]{3,}")
_SIGNS = re.compile(r"[=^_+*/<>-]|\\[A-Za-z]+")


def reads_as_formula(inner: str) -> bool | None:
    """Whether the text between formula marks can be read as one; None where it may be."""
    bare = re.sub(r"\\(?:text|mathrm|operatorname|mbox)\{[^{}]*\}", "x", inner)
    if _WORD_PAIR.search(bare) or bare != bare.strip(" ") and not _SIGNS.search(bare):
        return False
    return True if _SIGNS.search(bare) else None


def certain_languages(text: str, nodes: list[Node]) -> dict[str, set[int]]:
    """The families of each language of which a node in the text was read whole: begun, ended, and with a target or arguments."""
    out: dict[str, set[int]] = {HTML: set(), MARKDOWN: set(), WIKI: set(), TEX: set()}
    for n in nodes:
        f = n.family
        whole = n.paired and (
            f in (COMMENT, FENCE, WIKI_LINK, ENVIRONMENT, BRACES, DEFINITION)
            or (f in (TAG, ESCAPED) and n.name not in _VOID and n.end - n.inner[1] > 2)
            or (f == LINK and bool(re.search(r"[/.#]", text[n.inner[1] : n.end])))
            or (f == COMMAND and n.end > n.inner[1])
            or (f == TEMPLATE and n.name[:1].isalpha())
            or (f in (BRACKETS, DOLLARS) and bool(reads_as_formula(text[slice(*n.inner)])))
            or (f == HASHES and n.run == 1)
            or f == EQUALS
        )
        if whole:
            out[_LANGUAGE[f]].add(f)
    return out


def evidence_label(text: str, n: Node, certain: dict[str, set[int]], paired_share: dict[str, float]) -> int | None:
    """1 markup, 0 plain text, None where there is no evidence beyond the node itself.

    Evidence: the end of an element was found in the text, or its name is one
    that is ended elsewhere (``paired_share``); a formula, target, entity or
    environment can be read; other families of the node's language were read
    whole in the same text.
    """
    f = n.family
    mine = certain[_LANGUAGE[f]]
    if f in (TAG, ESCAPED):
        if n.paired:
            return 1 if n.name in _VOID or not n.attributes or _ATTRIBUTES.match(n.attributes) else None
        if n.name in _OPEN_ENDED and mine:
            return 1
        return None if paired_share.get(n.name, 0.0) >= 0.5 else 0
    if f in (DOLLARS, BRACKETS):
        found = reads_as_formula(text[slice(*n.inner)])
        return None if found is None else int(found)
    if f in (COMMENT, ENTITY, WIKI_LINK, ENVIRONMENT, DEFINITION):
        return 1
    if f in (FENCE, BRACES):
        return 1 if n.paired else None
    if f == LINK:
        return 1 if f in mine else None
    if f == TEMPLATE:
        return 1 if n.name[:1].isalpha() else 0
    if f in (COMMAND, GROUP):
        if n.end > n.inner[1] and n.inner[1] > n.inner[0]:
            return 1
        return None if mine - {f} or f in mine else 0
    if f in (EM, STRONG) and re.match(r"\w", text[n.end : n.end + 1] or " ") and re.match(r"\w", text[n.start - 1 : n.start] or " "):
        return 0  # cuts a word in two
    return 1 if mine - {f} else None


@dataclass
class MarkupModel:
    trees: Boosted
    report: dict


#: Families that mean nothing within code and formulas.
_NOT_IN_CODE = frozenset((TICKS, STRONG, EM, LINK, WIKI_LINK, WIKI_QUOTE, TEMPLATE, COMMAND, GROUP, DOLLARS, BRACKETS, BREAK, RULE, HASHES, EQUALS, BULLET, INDENT, QUOTE, CELL, FENCE, BRACES))


def _log_odds_parts(o: float) -> tuple[float, float]:
    """Log probabilities of yes and no."""
    return min(0.0, o) - math.log1p(math.exp(-abs(o))), min(0.0, -o) - math.log1p(math.exp(-abs(o)))


def decode(roots: list[Node], odds: dict[int, float]) -> list[Node]:
    """The most likely choice of markup nodes that has no contradiction between a node and its descendants.

    ``odds``: log odds by id of the node, given that no code or formula is around
    it. A node chosen as code or formula settles that the marks of other
    languages below it are text; of all choices the most probable is taken.
    """
    best: dict[int, tuple[float, float]] = {}  # id -> log probability of the best choice below and at a node, free and within code

    order: list[Node] = []
    stack = list(roots)
    while stack:
        n = stack.pop()
        order.append(n)
        stack += n.children
    for n in reversed(order):
        yes, no = _log_odds_parts(odds[id(n)])
        free = sum(best[id(c)][0] for c in n.children)
        closed = sum(best[id(c)][1] for c in n.children)
        below = closed if n.kind in ("code", "formula") else free
        best[id(n)] = (max(yes + below, no + free), closed if n.family in _NOT_IN_CODE else max(yes, no) + closed)
    chosen: list[Node] = []
    todo = [(n, False) for n in roots]
    while todo:
        n, in_code = todo.pop()
        o = odds[id(n)]
        if in_code:
            take, deeper = n.family not in _NOT_IN_CODE and o > 0, True
        else:
            free = sum(best[id(c)][0] for c in n.children)
            closed = sum(best[id(c)][1] for c in n.children)
            hides = n.kind in ("code", "formula")
            yes, no = _log_odds_parts(o)
            take = yes + (closed if hides else free) > no + free
            deeper = take and hides
        if take:
            chosen.append(n)
        todo += [(c, deeper) for c in n.children]
    return chosen


def read(texts: list[str | None], model: MarkupModel) -> list[list[Node]]:
    """The markup nodes of each text; none for null, empty and plain texts."""
    trees, rows = [], []
    for t in texts:
        nodes = nodes_of(t) if t else []
        roots = link(nodes)
        trees.append((roots, nodes))
        if nodes:
            rows += features(t, roots, nodes)
    odds = model.trees.log_odds(np.array(rows, float).reshape(-1, FEATURES))
    out, at = [], 0
    for roots, nodes in trees:
        if not nodes:
            out.append([])
            continue
        mine = odds[at : at + len(nodes)]
        at += len(nodes)
        out.append(decode(roots, {id(n): float(o) for n, o in zip(nodes, mine)}))
    return out


def _within_code(roots: list[Node]) -> set[int]:
    """Ids of the nodes below a code or formula node that was read whole."""
    out: set[int] = set()
    todo = [(n, False) for n in roots]
    while todo:
        n, inside = todo.pop()
        if inside and n.family in _NOT_IN_CODE:
            out.add(id(n))
        todo += [(c, inside or (n.paired and n.kind in ("code", "formula"))) for c in n.children]
    return out


def kinds(chosen: list[Node]) -> list[str]:
    """What the markup expresses: of KINDS, or ``inline`` if none; empty without markup."""
    found = {n.kind for n in chosen}
    return [k for k in KINDS if k in found] or (["inline"] if chosen else [])


def _edits(n: Node) -> tuple:
    """The edits of a chosen node, those of its children included where their meaning hangs on it."""
    if n.family not in (TAG, ESCAPED) or len(n.edits) < 2:
        return n.edits
    (a, b, first), (c, d, last) = n.edits[:2]
    parts = [x for x in n.children if x.family == n.family and len(x.edits) == 2]
    if n.name == "ol":
        for i, x in enumerate((x for x in n.children if x.name == "li" and x.family == n.family), 1):
            x.edits = ((*x.edits[0][:2], f"\n{i}. "), *x.edits[1:])
    if n.name == "pre":  # a block of code within a block is one block
        for x in parts:
            if x.name == "code":
                x.edits = tuple((f, t, "") for f, t, _ in x.edits)
    elif n.name in ("mfrac", "msup", "msub") and len(parts) == 2:
        opens = ("{", "{") if n.name == "mfrac" else ("", "^{" if n.name == "msup" else "_{")
        for x, mark in zip(parts, opens):
            x.edits = ((*x.edits[0][:2], mark), (*x.edits[1][:2], "}" if mark else ""))
        return ((a, b, first + ("\\frac" if n.name == "mfrac" else "")), (c, d, last))
    elif n.name == "msqrt":
        return ((a, b, first + "\\sqrt{"), (c, d, "}" + last))
    return n.edits


def clean(text: str | None, chosen: list[Node]) -> str | None:
    """The text with its markup taken out and its structure written alike whatever the language was.

    Headings begin with #, list items with -, code stands in back ticks, formulas
    between dollar signs. Marks that were not read as markup stay.
    """
    if not text or not chosen:
        return text
    for n in sorted(chosen, key=lambda n: (n.start, -n.end)):  # parents first: they settle what their children become
        _edits(n)
    edits = sorted((e for n in chosen for e in _edits(n)), key=lambda e: (e[0], e[1] - e[0] == 0, -e[1]))
    out, at, end = [], 0, "\n"
    for start, stop, instead in edits:
        if start < at:
            continue
        piece = text[at:start]
        end = piece[-1:] or end
        if end == "\n" and instead[:1] in ("\n", "\t"):
            instead = instead[1:]
        out += (piece, instead)
        end = instead[-1:] or end
        at = stop
    out.append(text[at:])
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip("\n")


def fit(texts: list[str | None]) -> MarkupModel:
    """Trees for the nodes of ``texts`` for which there is evidence; every eighth text is kept for the report."""
    read_texts = [(t, nodes) for t in texts if t and (nodes := nodes_of(t))]
    pairs: dict[str, list[int]] = {}
    for _, nodes in read_texts:
        for n in nodes:
            if n.family in (TAG, ESCAPED):
                seen = pairs.setdefault(n.name, [0, 0])
                seen[0] += n.paired
                seen[1] += 1
    share = {k: a / b for k, (a, b) in pairs.items()}
    x, y, held = [], [], []
    for i, (t, nodes) in enumerate(read_texts):
        roots = link(nodes)
        certain = certain_languages(t, nodes)
        within = _within_code(roots)
        for n, row in zip(nodes, features(t, roots, nodes)):
            label = evidence_label(t, n, certain, share)
            if label is not None and id(n) not in within:  # odds are those of nodes with no code around them
                x.append(row)
                y.append(label)
                held.append(i % 8 == 0)
    if not y or min(y) == max(y):  # nothing to tell apart: what there is decides
        base = 6.0 if y and y[0] else -6.0
        return MarkupModel(Boosted([np.zeros(0)] * FEATURES, np.zeros((0, 15), np.int64), np.zeros((0, 15), np.int64), np.zeros((0, 16)), base), {"nodes": len(y)})
    x, y, held = np.array(x, float), np.array(y, float), np.array(held)
    use = ~held if 0 < y[~held].mean() < 1 else np.ones(len(y), bool)
    mean = y[use].mean()
    trees = train_boosted(x[use], y[use], np.where(y[use] > 0, 0.5 / mean, 0.5 / (1 - mean)))
    report = {"nodes": int(use.sum()), "markup_share": float(mean)}
    if held.any():
        got, want = trees.log_odds(x[held]) > 0, y[held] > 0
        report |= {"held_nodes": int(held.sum()), "held_accuracy": float((got == want).mean())}
        report |= {f"held_recall_{k}": float((got[want == v] == v).mean()) for k, v in (("plain", False), ("markup", True)) if (want == v).any()}
    return MarkupModel(trees, report)


def training_texts(frames: list[tuple[DataFrame, str, str]]) -> list[str]:
    """About TRAIN_TEXTS texts of all (table, identifier, text column), chosen by a hash of the text; never more than twice as many."""
    texts = reduce(DataFrame.unionAll, (df.select(df[f"`{column}`"].alias("text")) for df, _, column in frames))
    return [r["text"] for r in hash_sample(texts, "text", TRAIN_TEXTS)[0]]


def _mapped(df: DataFrame, id_col: str, text_col: str, model: MarkupModel | None, schema: str, emit) -> DataFrame:
    model = model or fit(training_texts([(df, id_col, text_col)]))
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[f"`{id_col}`"].alias("id_"), df[f"`{text_col}`"].alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text_"):
                texts = batch.column("text_").to_pylist()
                yield emit(batch.column("id_"), texts, read(texts, shared.value))

    return rows.mapInArrow(run, f"id_ {dict(rows.dtypes)['id_']}, {schema}").withColumnRenamed("id_", id_col)


def structures(df: DataFrame, id_col: str, text_col: str, model: MarkupModel | None = None) -> DataFrame:
    """(``id_col``, kind): a row for each kind of structure that a row's markup expresses, ``inline`` if none of KINDS.

    Rows delivered again give the same rows again, which count once. Null, empty
    and plain texts have none; null ids stay. Whole texts are read; other columns
    are not. An empty table gives none.
    """

    def emit(ids: pa.Array, texts: list, chosen: list) -> pa.RecordBatch:
        found = [kinds(c) for c in chosen]
        owner = [i for i, k in enumerate(found) for _ in k]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array([x for k in found for x in k], pa.string())], names=["id_", "kind"])

    return _mapped(df, id_col, text_col, model, "kind string", emit).distinct()


def cleaned(df: DataFrame, id_col: str, text_col: str, model: MarkupModel | None = None) -> DataFrame:
    """(``id_col``, text): one row per row, its text without markup; null stays null, empty stays empty."""

    def emit(ids: pa.Array, texts: list, chosen: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([clean(t, c) for t, c in zip(texts, chosen)], pa.string())], names=["id_", "text"])

    return _mapped(df, id_col, text_col, model, "text string", emit)
