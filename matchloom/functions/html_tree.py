"""Text nodes of a page as a tolerant parser sees them: one pass over its tags, a stack of open elements, no tree."""

from __future__ import annotations

import re

from matchloom import fixed_values as V

# Inside of a tag: a quoted value may hold ">"; a quote that is no value's, or is never closed, is a character.
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
_TAG = re.compile(rf"<(?:(/?)([a-zA-Z][^\s/>]*)({INSIDE})|[!?/]{INSIDE})>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in V.RAW_TAGS}
_REACH = sorted(V.END_REACH.items())
_DROPPED, _VOID, _HEAD = set(V.DROPPED_TAGS), set(V.VOID_TAGS), set(V.HEAD_TAGS)
_IMPLIED = {t: set(ended) for t, ended in V.IMPLIED_ENDS.items()}


class _Open:
    """The open elements, where each name stands among them, and which nodes the first element of each root name holds."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.hidden = 0
        self.regions: dict[str, list[int]] = {}

    def start(self, name: str, nodes: int) -> None:
        if name in V.ROOT_TAGS and not self.hidden and name not in self.regions:
            self.regions[name] = [len(self.names), nodes, -1]
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.hidden += name in _DROPPED or name == "title"

    def close(self, size: int, nodes: int) -> None:
        """Ends elements, the innermost first, until `size` are open."""
        while len(self.names) > size:
            name = self.names.pop()
            self.places[name].pop()
            self.hidden -= name in _DROPPED or name == "title"
        for region in self.regions.values():
            if region[2] < 0 and region[0] >= size:
                region[2] = nodes

    def end(self, name: str, nodes: int) -> None:
        """An end tag closes its element and all inside it; without one, or across an element that it does not reach over, it is none."""
        at = self.places.get(name)
        if at:
            own = V.END_REACH.get(name, 100)
            if not any(reach > own and (above := self.places.get(t)) and above[-1] > at[-1] for t, reach in _REACH):
                self.close(at[-1], nodes)


def text_nodes(page: str) -> str:
    """The text nodes of the first main, else the first article, else the body, one a line, without those in dropped elements.

    An element that is never closed ends with its parent. Comments part text. An unfinished tag at the end of the page
    is text. Titles count only behind the beginning of the body.
    """
    nodes: list[str] = []
    open_ = _Open()
    in_body = False
    begin, at, no_comment_end = 0, 0, False  # where the text that is being read begins, and from where the next tag is looked for

    def text(lo: int, hi: int) -> None:
        nonlocal in_body
        if lo < hi and not open_.hidden:
            piece = page[lo:hi]
            if not piece.isspace():
                in_body = True
                nodes.append(piece)

    while (lo := page.find("<", at)) >= 0:
        if page.startswith("<!--", lo) and not no_comment_end:
            end = page.find("-->", lo + 4)
            if end >= 0:
                text(begin, lo)
                begin = at = end + 3
                continue
            no_comment_end = True
        tag = _TAG.match(page, lo)
        if tag is None:
            # Where a name or a mark follows, no tag ends from here on; else the sign is a character.
            if re.match(r"[a-zA-Z!?/]", page[lo + 1 : lo + 2]):
                break
            at = lo + 1
            continue
        text(begin, lo)
        begin = at = tag.end()
        name = (tag[2] or "").lower()
        if tag[1]:
            if name in ("body", "html"):
                open_.close(0, len(nodes))
            elif name == "head":
                in_body = True
            open_.end(name, len(nodes))
            continue
        if not name or name in ("html", "head"):
            continue
        if not in_body and name not in _HEAD:
            in_body = True
            if open_.places.get("title"):
                open_.close(open_.places["title"][0], len(nodes))
        if name == "body":
            continue
        ended = _IMPLIED.get(name, ())
        while open_.names and open_.names[-1] in ended:
            open_.close(len(open_.names) - 1, len(nodes))
        if tag[3].endswith("/") or name in _VOID or (name == "title" and in_body):
            continue
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            if end is None:
                return _chosen(nodes, open_)
            close = page.find(">", end.end())
            begin = at = close + 1 if close >= 0 else len(page)
            continue
        open_.start(name, len(nodes))
    text(begin, len(page))
    return _chosen(nodes, open_)


def _chosen(nodes: list[str], open_: _Open) -> str:
    for name in V.ROOT_TAGS:
        if name in open_.regions:
            _, lo, hi = open_.regions[name]
            return "\n".join(nodes[lo : hi if hi >= 0 else len(nodes)])
    return "\n".join(nodes)
