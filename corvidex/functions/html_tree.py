"""Texts of the elements of a page, by the parser of the standard library."""

from __future__ import annotations

from html.parser import HTMLParser

# Elements without an end, elements that words don't run across, and elements whose content is no text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var".split())
_NO_TEXT = frozenset("script style template".split())


class Page(HTMLParser):
    """The title, the text, and the texts of the elements of given classes, in the order they begin."""

    def __init__(self, classes: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self._classes = frozenset(classes)
        self._open: list[tuple[str, list]] = []  # element, texts it adds to
        self._all: list[str] = []
        self._title: list[str] | None = None
        self._found: dict[str, list[list[str]]] = {c: [] for c in classes}
        self._silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        mine: list[list[str]] = []
        names = next((v for k, v in attrs if k == "class" and v), "")
        for c in self._classes.intersection(names.split()):
            mine.append([])
            self._found[c].append(mine[-1])
        if tag == "title" and self._title is None:
            self._title = []
            mine.append(self._title)
        if tag not in _INLINE:
            self._add(" ")
        if tag in _VOID:
            return
        self._open.append((tag, mine))
        self._silent += tag in _NO_TEXT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self._open) - 1, -1, -1) if self._open[i][0] == tag), None)
        if at is None:
            return
        if tag not in _INLINE:
            self._add(" ")
        self._silent -= sum(t in _NO_TEXT for t, _ in self._open[at:])
        del self._open[at:]

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._add(data)

    def _add(self, data: str) -> None:
        self._all.append(data)
        for _, texts in self._open:
            for t in texts:
                t.append(data)

    def title(self) -> str:
        return _squeezed(self._title or [])

    def text(self) -> str:
        return _squeezed(self._all)

    def of_class(self, name: str, n: int) -> str:
        """The text of the n-th element of a class, from 0; empty where there is none."""
        found = self._found[name]
        return _squeezed(found[n]) if n < len(found) else ""


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def parse(html: str | None, classes: tuple[str, ...] = ()) -> Page:
    page = Page(classes)
    page.feed(html or "")
    page.close()
    return page
