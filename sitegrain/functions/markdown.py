"""HTML pages as Markdown, one Arrow batch at a time.

A page is read once, tag by tag. Open elements hold what is inside them until they end; then the element's rule makes Markdown of it for the
element around it. Elements that HTML lets end by themselves (p, li, cells, rows) end where the next one begins or their parent ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import mapped
from .markup import BLOCKS, VOID

#: Elements left out, head fields shown first, marks, and the longest content.
REMOVED = frozenset(("script", "style", "img", "svg", "video", "audio", "canvas", "iframe", "noscript"))
HEAD_FIELDS = frozenset(("description", "og:description", "og:title", "twitter:description", "twitter:title"))
HEAD_MARK, CUT_MARK, HEAD_LINES, LONGEST = "--- 页面头部信号 ---", "\n\n...（内容过长已截断）...\n\n", 6, 80_000
#: What a start tag ends: the open elements of these names, as far as one of the others does not enclose them.
ENDS = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",))}
ENDS |= {name: (("p",), ("td", "th", "li", "blockquote", "div", "section", "article")) for name in BLOCKS if name not in ENDS}
INLINE = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
VERBATIM = ("pre", "code", "kbd", "samp")
BULLETS = "*+-"


def _indented(text: str, first: str) -> str:
    """A list item: its lines below the first as far in as the first one's text."""
    lines = text.split("\n")
    return "\n".join([first + lines[0], *[" " * len(first) + line if line else "" for line in lines[1:]]])


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict, list[str]]] = [("", {}, [])]
        self.removed, self.title, self.head = 0, None, []
        self.named: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in REMOVED:
            self.removed += tag != "img"
            return
        if self.removed:
            return
        given = {k: v or "" for k, v in attrs}
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "meta":
            content = " ".join(given.get("content", "").split())
            if (given.get("property") or given.get("name", "")).strip().lower() in HEAD_FIELDS and content and content not in self.head:
                self.head.append(content)
        elif tag == "br":
            self._put("  \n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag not in VOID:
            self._push(tag, given)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in REMOVED:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in REMOVED:
            self.removed = max(0, self.removed - (tag != "img"))
        elif not self.removed and self._inside(tag):
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.removed:
            return
        if not any(self._inside(x) for x in VERBATIM):
            data = re.sub(r"([*_])", r"\\\1", re.sub(r"\s+", " ", data))
        self._put(data)

    def _inside(self, tag: str) -> int:
        return self.named.get(tag, 0)

    def _push(self, tag: str, given: dict) -> None:
        self.open.append((tag, given, []))
        self.named[tag] = self.named.get(tag, 0) + 1

    def _put(self, text: str) -> None:
        parts = self.open[-1][2]
        if text[:1] == " " and (parts[-1][-1:].isspace() if parts else not self._running()):
            text = text.lstrip(" ")
        if text:
            parts.append(text)

    def _running(self) -> bool:
        """Whether the innermost element is part of a line."""
        return self.open[-1][0] in INLINE or self.open[-1][0] in ("a", "span", "label", "small", "u", "font", "abbr", "cite", "q", "sub", "sup")

    def _end(self, names: tuple, within: tuple) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in within:
                return
            if self.open[at][0] in names:
                while len(self.open) > at:
                    self._close()

    def _close(self) -> str:
        tag, given, parts = self.open.pop()
        self.named[tag] -= 1
        text = "".join(parts)
        if tag == "title" and self.title is None:
            self.title = " ".join(text.replace("\\_", "_").replace("\\*", "*").split())
        shown = self._shown(tag, given, text)
        if tag in ("td", "th", "tr"):
            self.open[-1][2].append(shown)
        else:
            self._put(shown)
        return tag

    def _shown(self, tag: str, given: dict, text: str) -> str:
        bare = text.strip()
        if tag in INLINE or tag == "a":
            if not bare or self._inside("pre"):
                return text
            left, right = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
            if tag == "a":
                href, title = given.get("href", "").strip(), given.get("title", "")
                mark = bare if not href else f"<{href}>" if bare.replace("\\_", "_") == href and not title else f"[{bare}]({href}" + (' "{}"'.format(title.replace('"', r"\"")) if title else "") + ")"
            else:
                mark = INLINE[tag] + bare + INLINE[tag]
            return left + mark + right
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            line = " ".join(bare.split())
            if not line:
                return ""
            return f"\n\n{line}\n{'=-'[int(tag[1]) - 1] * len(line)}\n\n" if tag < "h3" else f"\n\n{'#' * int(tag[1])} {line}\n\n"
        if tag == "li":
            kind, given_, items = next(((t, g, p) for t, g, p in reversed(self.open) if t in ("ul", "ol")), ("ul", {}, []))
            depth = self._inside("ul") + self._inside("ol") - 1
            start = int(given_["start"]) if given_.get("start", "").isdigit() else 1
            first = f"{start + sum(p.startswith(chr(0)) for p in items)}. " if kind == "ol" else BULLETS[max(depth, 0) % 3] + " "
            return "\0" + _indented(bare, first) + "\n"
        if tag in ("ul", "ol"):
            listed = text.replace("\0", "").rstrip()
            return f"\n{listed}\n" if self._inside("ul") + self._inside("ol") else f"\n\n{listed}\n\n"
        if tag == "pre":
            return f"\n\n```\n{text.strip(chr(10))}\n```\n\n" if bare else ""
        if tag == "blockquote":
            return "\n\n" + "\n".join("> " + line if line else ">" for line in re.sub(r"\n{3,}", "\n\n", bare).split("\n")) + "\n\n" if bare else ""
        if tag in ("td", "th"):
            return " " + " ".join(bare.split()).replace("|", r"\|") + " |"
        if tag == "tr":
            cells = text.count(" |") - text.count(r"\ |")
            body = next((p for t, _, p in reversed(self.open) if t in ("table", "")), [])
            seen = "".join(p for t, _, parts in self.open for p in parts if t in ("table", "thead", "tbody", "tfoot"))
            rule = "" if seen.strip() else "|" + " --- |" * max(cells, 1) + "\n"
            return f"|{text}\n{rule}" if bare or body else ""
        if tag == "table":
            return f"\n\n{text.strip()}\n\n"
        if tag in BLOCKS or tag in ("dt", "dd", "figure", "figcaption", "details", "summary"):
            return f"\n\n{bare}\n\n" if bare else ""
        return text

    def result(self) -> str:
        while len(self.open) > 1:
            self._close()
        content = re.sub(r"\n{3,}", "\n\n", "".join(self.open[0][2]).replace("\0", "")).strip()
        head = [line for line in (self.title, *[x for x in self.head if x != self.title]) if line][:HEAD_LINES]
        return "\n".join([HEAD_MARK, *head, "", content]).strip() if head else content


def convert(page: str | None) -> str:
    """Markdown of one page, its title and telling head fields first; null and blank pages are empty, long ones keep their beginning and end."""
    if not page or not page.strip():
        return ""
    reader = _Page()
    reader.feed(page)
    reader.close()
    text, half = reader.result(), LONGEST // 2
    return text if len(text) <= LONGEST else text[:half] + CUT_MARK + text[-half:]


@F.arrow_udf(T.StringType())
def _converted(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return mapped(convert, pa.string(), values)


def markdown(page: Column | str) -> Column:
    return _converted(page)
