"""Web pages for the standard library's parser: whole constructs only, found in one pass.

That parser looks for the end of an unclosed tag again from each "<" and gives up on some declarations, so a page that is
broken in the right way costs quadratic time or an error. ``tidy`` leaves tags as they are, and what is no whole construct
becomes text or goes, so that what the parser then sees has neither.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_STOP = re.compile(r"""["'>]""")
_VALUE = re.compile(r"=\s*\Z")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
#: Elements whose content is no markup, and what ends each.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


class _Ahead:
    """Where a string comes next; that it comes no more is remembered, so it is looked for once."""

    def __init__(self, text: str):
        self.text = text
        self.over: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.over:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.over.add(what)
        return found


def _tag(html: str, at: int, ahead: _Ahead) -> tuple[str, int]:
    """The tag that begins at ``at`` and its end, -1 if there is none. A quote that begins a value and is never closed is
    left out."""
    pos, parts, since = at + 1, [], at
    while stop := _STOP.search(html, pos):
        pos = stop.end()
        if stop[0] == ">":
            return "".join([*parts, html[since:pos]]), pos
        if _VALUE.search(html, max(at, stop.start() - 8), stop.start()):
            closed = ahead.find(stop[0], pos)
            if closed >= 0:
                pos = closed + 1
            else:
                parts.append(html[since : stop.start()])
                since = pos
    return "", -1


def tidy(html: str) -> str:
    """html without comments, declarations and what comes after an unclosed script; a "<" that begins no whole tag is text.

    Linear in the length of the page.
    """
    out: list[str] = []
    ahead = _Ahead(html)
    last = html.rfind(">")  # behind it no tag can end
    at = 0
    while True:
        begin = html.find("<", at)
        if begin < 0:
            out.append(html[at:])
            break
        out.append(html[at:begin])
        after = html[begin + 1 : begin + 2]
        if html.startswith("<!--", begin):
            if html.startswith((">", "->"), begin + 4):
                at = html.index(">", begin) + 1
                continue
            end = ahead.find("-->", begin + 4)
            if end < 0:
                break
            at = end + 3
        elif begin > last:
            out.append("&lt;")
            at = begin + 1
        elif after in ("!", "?") or (after == "/" and not html[begin + 2 : begin + 3].isalpha()):
            at = ahead.find(">", begin) + 1
        elif name := _NAME.match(html, begin):
            tag, at = _tag(html, begin, ahead)
            if at < 0:
                out.append("&lt;")
                at = begin + 1
                continue
            out.append(tag)
            raw = RAW.get(name[1].lower()) if after != "/" else None
            if raw and not html.endswith("/>", begin, at):
                end = raw.search(html, at)
                if not end:
                    break
                out.append(html[at : end.start()])
                at = end.start()
        else:
            out.append("&lt;")
            at = begin + 1
    return "".join(out)


class Markup(HTMLParser):
    """The standard library's parser over tidied pages."""

    CDATA_CONTENT_ELEMENTS = tuple(RAW)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def read(self, html: str | None) -> None:
        self.feed(tidy(html or ""))
        self.close()

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that is left, in a script that the parser reads as markup, is a comment up to the next ">"."""
        return self.rawdata.find(">", i + 2) + 1 or -1
