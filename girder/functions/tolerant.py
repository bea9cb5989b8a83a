"""Reading of damaged JSON: a scanner of tokens and a reader that mends what it doesn't expect.

The reader keeps a stack of open objects and lists. Each token either fits the top of the stack or is
mended there, and every mend is counted under the name of its event. Nothing is guessed: a member that
the end of the text cuts off is dropped, and a text that can't be read with the mends below is refused.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

# The names of the events.
BLOCK_COMMENT = "json_syntax_block_comment_removed"
LINE_COMMENT = "json_syntax_line_comment_removed"
PYTHON_TRUE = "json_syntax_python_true_converted"
PYTHON_FALSE = "json_syntax_python_false_converted"
PYTHON_NONE = "json_syntax_python_none_converted"
NOT_A_NUMBER = "json_syntax_nan_converted"
INFINITE = "json_syntax_infinity_converted"
TRAILING_COMMA = "json_syntax_trailing_comma_removed"
MISSING_OUTER = "json_syntax_missing_outer_bracket"
ROGUE_BRACKET = "json_syntax_rogue_internal_bracket"
PARENTHESES = "json_syntax_parentheses_boxes"
EXTRA_BRACKET = "json_syntax_extra_string_bracket"
WRONG_CLOSING = "json_syntax_mismatched_end_closures"
MISSING_COMMA = "json_syntax_missing_comma_inserted"
SMART_QUOTES = "json_syntax_smart_quotes_normalized"
OPEN_BOX_TEXT = "box_string_missing_closing_quote_repaired"
OPEN_LIST_TEXT = "json_syntax_missing_closing_quote_in_list"
TRUNCATED = "json_truncation_repaired"

WORDS: dict[str, tuple[Any, str | None]] = {
    "true": (True, None),
    "false": (False, None),
    "null": (None, None),
    "True": (True, PYTHON_TRUE),
    "False": (False, PYTHON_FALSE),
    "None": (None, PYTHON_NONE),
    "NaN": (None, NOT_A_NUMBER),
    "Infinity": (None, INFINITE),
    "-Infinity": (None, INFINITE),
}
OPENING = {"{": "}", "[": "]", "(": "]"}
CLOSING = {"}": "}", "]": "]", ")": "]"}
CURLY_QUOTES = "“”"
MARK = re.compile('["{}]')


def end_of_literal(text: str, start: int, quote: str = '"') -> int:
    """Where the literal whose content begins at `start` has its closing quote; the length of the text if it has none."""
    at = start
    while (at := text.find(quote, at)) >= 0:
        escapes = at
        while escapes > start and text[escapes - 1] == "\\":
            escapes -= 1
        if (at - escapes) % 2 == 0:
            return at
        at += 1
    return len(text)


class Unreadable(ValueError):
    """The text holds something that none of the mends covers."""


class Scanner:
    """Tokens (kind, value): 'open' and 'close' with the closing bracket, ':' , ',', 'text', 'scalar', and 'cut'."""

    def __init__(self, text: str, seen: Counter) -> None:
        self.text, self.at, self.seen = text, 0, seen

    def tokens(self) -> Iterator[tuple[str, Any]]:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c.isspace():
                self.at += 1
            elif c in OPENING:
                self.at += 1
                self.seen[PARENTHESES] += c == "("
                yield "open", OPENING[c]
            elif c in CLOSING:
                self.at += 1
                self.seen[PARENTHESES] += c == ")"
                yield "close", CLOSING[c]
            elif c in ":,":
                self.at += 1
                yield c, c
            elif c == '"' or c in CURLY_QUOTES:
                yield self._literal(c)
            elif c == "/":
                self._comment()
            else:
                yield self._bare()

    def _comment(self) -> None:
        """A comment up to the end of its line or its closing mark; one that isn't closed is no comment."""
        mark = self.text[self.at : self.at + 2]
        if mark == "//":
            end = self.text.find("\n", self.at)
            self.at = len(self.text) if end < 0 else end
            self.seen[LINE_COMMENT] += 1
        elif mark == "/*" and (end := self.text.find("*/", self.at + 2)) >= 0:
            self.at = end + 2
            self.seen[BLOCK_COMMENT] += 1
        else:
            raise Unreadable("/")

    def _bare(self) -> tuple[str, Any]:
        """A number or a word; a word that the end of the text cuts is 'cut'."""
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "+-._"):
            self.at += 1
        word = self.text[start : self.at]
        if word in WORDS:
            value, event = WORDS[word]
            if event:
                self.seen[event] += 1
            return "scalar", value
        try:
            value = json.loads(word)
        except ValueError:
            if word and self.at == len(self.text):
                return "cut", None
            raise Unreadable(word or self.text[start]) from None
        return "scalar", value

    def _literal(self, quote: str) -> tuple[str, Any]:
        if quote == '"' and (found := self._open_numbers()) is not None:
            return "text", found
        ends = '"' if quote == '"' else CURLY_QUOTES + '"'
        i = min(end_of_literal(self.text, self.at + 1, q) for q in ends)
        if i == len(self.text):
            self.at = len(self.text)
            return "cut", None
        body = self.text[self.at + 1 : i]
        if quote != '"' or self.text[i] != '"':
            self.seen[SMART_QUOTES] += 1
        self.at = i + 1
        try:
            return "text", json.loads(f'"{body}"')
        except ValueError:
            raise Unreadable(body) from None

    def _open_numbers(self) -> str | None:
        """Numbers in a literal without closing quote: they run into a bracket, or into the next literal on a new line."""
        text, i = self.text, self.at + 1
        while i < len(text) and (text[i].isdigit() or text[i].isspace() or text[i] in ".,-"):
            i += 1
        run = text[self.at + 1 : i]
        if i == len(text) or not run.strip() or not (run[0].isdigit() or run[0] == "-"):
            return None
        kept = run.rstrip()
        if text[i] in "]}" and kept[-1].isdigit():
            self.seen[OPEN_BOX_TEXT] += 1
            self.at += 1 + len(kept)
            return "".join(kept.split())
        if text[i] == '"' and kept.endswith(",") and "\n" in run[len(kept) :]:
            self.seen[OPEN_LIST_TEXT] += 1
            self.at += len(kept)  # the comma stays to be read
            return kept[:-1]
        return None


class _Open:
    """An object or list that isn't closed yet."""

    def __init__(self, closing: str) -> None:
        self.closing = closing
        self.value: Any = {} if closing == "}" else []
        self.key: str | None = None  # of an object: the name whose value is read, or was read last
        self.state = "start"  # start, item (one was read), comma; of an object also key and colon

    @property
    def is_list(self) -> bool:
        return self.closing == "]"

    def put(self, value: Any, seen: Counter) -> None:
        if self.is_list:
            seen[MISSING_COMMA] += self.state == "item"
            self.value.append(value)
            self.state = "item"
        elif self.state == "colon":
            self.value[self.key] = value
            self.state = "item"
        elif self.state in ("start", "comma", "item") and isinstance(value, str):
            seen[MISSING_COMMA] += self.state == "item"
            self.key, self.state = value, "key"
        else:
            raise Unreadable(str(value))


def _numbers(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value)


class _Reader:
    def __init__(self, seen: Counter, rogue: bool) -> None:
        self.seen, self.rogue = seen, rogue
        self.stack: list[_Open] = []
        self.root: Any = None
        self.done = False

    def read(self, tokens: Iterator[tuple[str, Any]]) -> Any:
        for kind, value in tokens:
            if kind == "cut":
                break
            if kind == "open":
                self._open(value)
            elif not self.stack:
                raise Unreadable("no bracket")
            elif kind == "close":
                self._close(value)
            elif kind in ("text", "scalar"):
                self.stack[-1].put(value, self.seen)
            else:
                self._separate(kind)
            if self.done:
                return self.root
        if not self.stack:
            raise Unreadable("nothing to read")
        self.seen[TRUNCATED] += 1
        while self.stack:
            self._pop(cut=True)
        return self.root

    def _separate(self, mark: str) -> None:
        top = self.stack[-1]
        fits = top.state == "item" if mark == "," else (not top.is_list and top.state == "key")
        if not fits:
            raise Unreadable(mark)
        top.state = "comma" if mark == "," else "colon"

    def _open(self, closing: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top is not None and closing == "]":
            if self.rogue and top.is_list and top.state == "comma" and _numbers(top.value):
                self.seen[ROGUE_BRACKET] += 1  # the numbers of one box go on
                return
            if not top.is_list and top.state == "comma" and _numbers(top.value.get(top.key)):
                self.seen[MISSING_OUTER] += 1  # the box read last was the first of a list
                outer = _Open("]")
                outer.put(top.value.pop(top.key), self.seen)
                outer.state = "comma"
                top.state = "colon"
                self.stack.append(outer)
        self.stack.append(_Open(closing))

    def _close(self, closing: str) -> None:
        if all(o.closing != closing for o in self.stack):
            self.seen[WRONG_CLOSING] += 1
            return
        while self.stack[-1].closing != closing:
            top = self.stack[-1]
            if top.is_list and len(top.value) == 1 and isinstance(top.value[0], list) and len(top.value[0]) == 1 and isinstance(top.value[0][0], str):
                self.seen[EXTRA_BRACKET] += 1
                top.value = top.value[0]
            else:
                self.seen[WRONG_CLOSING] += 1
            self._pop()
        self._pop()

    def _pop(self, cut: bool = False) -> None:
        """Close the top. Where the text is cut, a name without a value is dropped."""
        top = self.stack.pop()
        if top.state in ("key", "colon") and not cut:
            raise Unreadable(f"{top.key} has no value")
        self.seen[TRAILING_COMMA] += top.state == "comma" and not cut
        if not self.stack:
            self.root, self.done = top.value, True
        else:
            self.stack[-1].put(top.value, self.seen)


def _read(text: str, rogue: bool) -> tuple[Any, dict[str, int]]:
    seen: Counter = Counter()
    value = _Reader(seen, rogue).read(Scanner(text, seen).tokens())
    return value, {event: n for event, n in seen.items() if n}


def read_damaged(text: str) -> tuple[Any, dict[str, int]]:
    """The first object or list of the text and the mends made, by event; raises Unreadable.

    What stands before the first bracket and after its closing is not looked at. A list among the numbers
    of a list is taken as such if the brackets then match; else its bracket may be a stray one.
    """
    starts = [i for c in "{[" if (i := text.find(c)) >= 0]
    if not starts:
        raise Unreadable("no bracket")
    text = text[min(starts) :]
    try:
        value, mends = _read(text, rogue=False)
    except Unreadable:
        return _read(text, rogue=True)
    if mends.keys() & {TRUNCATED, WRONG_CLOSING}:
        try:
            other, fewer = _read(text, rogue=True)
        except Unreadable:
            return value, mends
        if ROGUE_BRACKET in fewer and not fewer.keys() & {TRUNCATED, WRONG_CLOSING}:
            return other, fewer
    return value, mends


def balanced_object(text: str) -> str | None:
    """The first {…} with as many closing as opening braces, those in double-quoted literals not counted."""
    start = text.find("{")
    depth, at = 0, start
    while at >= 0:
        found = MARK.search(text, at)
        if found is None or start < 0:
            return None
        at = found.end()
        if found[0] == '"':
            at = end_of_literal(text, at) + 1
        else:
            depth += 1 if found[0] == "{" else -1
            if not depth:
                return text[start:at]
    return None
