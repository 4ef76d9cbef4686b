"""Text of simple PDF files: a scanner makes values of bytes, objects of values, and lines of the strings that a page shows.

Only what such text needs is read: objects of generation 0 in the clear, streams plain or
deflated. Fonts, encryption, object streams and places on the page are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from siltstone.errors import IngestionError

_OCTAL = re.compile(rb"[0-7]{1,3}")
#: A run of bytes that is neither white space nor a delimiter.
_REGULAR = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]+")
#: A run of a literal string that stands for itself.
_PLAIN = re.compile(rb"[^\\()]+")
_BLANK = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
#: What an escaped letter of a literal string stands for.
NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


class Name(str):
    """/Name"""


class Word(str):
    """An operator or keyword, and every delimiter that opens or closes something."""


class Literal(str):
    """(string), unescaped"""


class Hexadecimal(str):
    """<string>, decoded"""


class Reference(int):
    """n 0 R"""


class Scanner:
    """Values from bytes, from a place on; ``at`` is the place after the last one."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __iter__(self) -> Iterator:
        while (value := self.next()) is not None:
            yield value

    def next(self):
        """The next value: a number, name, string, word, list, dict or reference; None at the end."""
        self.at = _BLANK.match(self.data, self.at).end()
        if self.at >= len(self.data):
            return None
        first = self.data[self.at : self.at + 1]
        if run := _REGULAR.match(self.data, self.at):
            self.at = run.end()
            word = run[0].decode("latin-1")
            return int(word) if word.isdecimal() and word.isascii() else Word(word)
        double = self.data[self.at : self.at + 2]
        if double in (b"<<", b">>"):
            self.at += 2
            return self._dictionary() if double == b"<<" else Word(">>")
        self.at += 1
        if first == b"/":
            run = _REGULAR.match(self.data, self.at)
            self.at = run.end() if run else self.at
            return Name(run[0].decode("latin-1") if run else "")
        return {b"(": self._literal, b"<": self._hexadecimal, b"[": self._list}.get(first, lambda: Word(first.decode("latin-1")))()

    def _until(self, close: str) -> list:
        values: list = []
        while (value := self.next()) is not None and not (isinstance(value, Word) and value == close):
            if isinstance(value, Word) and value == "R" and len(values) > 1 and type(values[-2]) is int and values[-1] == 0:
                values[-2:] = [Reference(values[-2])]
            else:
                values.append(value)
        return values

    def _list(self) -> list:
        return self._until("]")

    def _dictionary(self) -> dict:
        values, out, i = self._until(">>"), {}, 0
        while i < len(values) - 1:
            if isinstance(values[i], Name):
                out.setdefault(str(values[i]), values[i + 1])
                i += 2
            else:
                i += 1
        return out

    def _literal(self) -> Literal:
        out, depth = [], 1
        text = self.data
        while self.at < len(text):
            if run := _PLAIN.match(text, self.at):
                out.append(run[0].decode("latin-1"))
                self.at = run.end()
                continue
            c = chr(text[self.at])
            self.at += 1
            if c == "\\":
                octal = _OCTAL.match(text, self.at)
                escaped = text[self.at : self.at + 1].decode("latin-1")
                out.append(chr(int(octal[0], 8)) if octal else NAMED.get(escaped, escaped))
                self.at = octal.end() if octal else self.at + 1
                continue
            depth += (c == "(") - (c == ")")
            if not depth:
                break
            out.append(c)
        return Literal("".join(out))

    def _hexadecimal(self) -> Hexadecimal:
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
        self.at = end + 1
        return Hexadecimal(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))


def objects_of(data: bytes) -> dict[int, tuple[object, bytes | None]]:
    """number: (value, stream) of the objects of generation 0, in the file's order; of an object defined twice the later counts."""
    found: dict[int, tuple[object, bytes | None]] = {}
    scanner, before = Scanner(data), []
    for value in scanner:
        if not (isinstance(value, Word) and value == "obj" and len(before) > 1 and type(before[-2]) is int and before[-1] == 0):
            before = [*before[-1:], value]
            continue
        number, body, stream = before[-2], scanner.next(), None
        after = body if isinstance(body, Word) and body in ("stream", "endobj") else scanner.next()
        if isinstance(after, Word) and after == "stream":
            begin = scanner.at
            end = data.find(b"endstream", begin)
            if end < 0:
                break
            stream, scanner.at = _without_line_ends(data[begin:end]), end + len(b"endstream")
            after = scanner.next()
        while after is not None and after != "endobj":  # further values of an odd object
            after = scanner.next()
        if after is not None:
            found[number] = (body, stream)
        before = []
    return found


def _without_line_ends(body: bytes) -> bytes:
    """Without one line end before, and one after."""
    for end in (b"\r\n", b"\n", b"\r"):
        if body.startswith(end):
            body = body[len(end) :]
            break
    for end in (b"\r\n", b"\n", b"\r"):
        if body.endswith(end):
            return body[: -len(end)]
    return body


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise IngestionError("content doesn't begin as a PDF file does")
        self.objects = objects_of(data)

    def _part(self, number: int, name: str):
        body = self.objects[number][0] if number in self.objects else None
        return body.get(name) if isinstance(body, dict) else None

    def page_numbers(self) -> list[int]:
        """Pages of the first page tree that has any; without one, all page objects as they come in the file."""
        for n in self.objects:
            if self._part(n, "Type") == "Pages" and isinstance(self._part(n, "Kids"), list):
                pages, waiting, met = [], [n], set()
                while waiting:
                    one = waiting.pop()
                    if one in met or one not in self.objects:
                        continue
                    met.add(one)
                    kids = self._part(one, "Kids")
                    if isinstance(kids, list):
                        waiting += [int(k) for k in reversed(kids) if isinstance(k, Reference)]
                    elif self._part(one, "Type") == "Page":
                        pages.append(one)
                if pages:
                    return pages
        return [n for n in self.objects if self._part(n, "Type") == "Page"]

    def stream(self, number: int) -> bytes:
        body, stream = self.objects.get(number, (None, None))
        kind = body.get("Filter") if isinstance(body, dict) else None
        if stream is None or kind != "FlateDecode" and kind != ["FlateDecode"]:
            return stream or b""
        try:
            return zlib.decompress(stream)
        except zlib.error as error:
            raise IngestionError(f"a deflated PDF stream can't be read: {error}") from error

    def page_text(self, number: int) -> str:
        contents = self._part(number, "Contents")
        parts = contents if isinstance(contents, list) else [contents]
        return "\n".join(shown_text(self.stream(int(p))) for p in parts if isinstance(p, Reference))


def shown_text(content: bytes) -> str:
    """A line for each string that is shown: literal ones first, then hexadecimal ones, then those of arrays, whatever their place."""
    lines: dict[str, list[str]] = {"literal": [], "hexadecimal": [], "array": []}
    last = None
    for value in Scanner(content):
        if isinstance(value, Word) and value == "Tj" and isinstance(last, (Literal, Hexadecimal)):
            lines["literal" if isinstance(last, Literal) else "hexadecimal"].append(last)
        elif isinstance(value, Word) and value == "TJ" and isinstance(last, list):
            lines["array"] += [x for x in last if isinstance(x, (Literal, Hexadecimal))]
        last = value
    return "\n".join(x for part in lines.values() for x in part if x)


def pdf_pages(data: bytes) -> list[str]:
    """The raw text of each page, in page order."""
    pdf = Pdf(data)
    return [pdf.page_text(n) for n in pdf.page_numbers()]
