"""Row-wise reading of model answers: what they hold, how they end, and ordered defect rules.

Pure Python on one text at a time; p2 and p6 run it once per row inside mapInArrow.
"""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from .refusals import is_refusal

# Keys of an assessment.
RULE_KEYS = tuple(f"rule_{i}_violation" for i in range(1, 5))
CLASS_KEYS = ("excavator", "rebar", "worker_with_white_hard_hat")

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and is are in on with to from by at as no while has have its that this who behind near under over other others out into without nobody",
    "de": "der die das den dem des ein eine einen einem einer und ist sind im in auf mit zu von bei als nicht während hat haben sich ohne neben vor hinter dahinter zwei drei mehrere zur zum nach am keine sonst",
    "es": "el la los las un una unos unas y es son en con de del al por para que no se mientras hay sin junto sobre detrás varios varias más lo su está están desde",
    "fr": "le la les un une des et est sont dans sur avec de du au aux par pour que ne se pas il elle sans près derrière plusieurs qui ce cette sont l d n au-dessus reste pendant",
    "it": "il lo la gli le un una di e è sono in su con del della per che non si senza vicino dietro mentre degli nel nella dei",
    "pt": "o os as um uma de e é são em no na com do da dos das por para que não se sem junto atrás enquanto pelo pela",
    "nl": "de het een van en is zijn in op met te voor bij als niet terwijl heeft zich zonder naast achter naar aan er",
    "pl": "w i na z do nie się jest są że za od po przy bez przez oraz który pod nad",
}
# More words of English answers, some of which other languages have too.
ENGLISH_ANSWERS = "i you it do not but or for be was were there they which can"
_LANGUAGES = {lang: frozenset((words + " " + ENGLISH_ANSWERS if lang == "en" else words).split()) for lang, words in FUNCTION_WORDS.items()}
# The scripts of languages not written in Latin letters, as the first word of their characters' names.
SCRIPTS = {
    "ru": ("CYRILLIC",), "uk": ("CYRILLIC",), "be": ("CYRILLIC",), "bg": ("CYRILLIC",), "mk": ("CYRILLIC",), "sr": ("CYRILLIC", "LATIN"), "kk": ("CYRILLIC",),
    "el": ("GREEK",), "he": ("HEBREW",), "yi": ("HEBREW",), "ar": ("ARABIC",), "fa": ("ARABIC",), "ur": ("ARABIC",),
    "zh": ("CJK",), "ja": ("HIRAGANA", "KATAKANA", "CJK"), "ko": ("HANGUL", "CJK"), "th": ("THAI",), "hi": ("DEVANAGARI",), "mr": ("DEVANAGARI",), "ne": ("DEVANAGARI",),
    "bn": ("BENGALI",), "ta": ("TAMIL",), "te": ("TELUGU",), "ka": ("GEORGIAN",), "hy": ("ARMENIAN",), "am": ("ETHIOPIC",), "km": ("KHMER",), "my": ("MYANMAR",),
}

_WRAP = re.compile(r"```[a-zA-Z]*|</?[a-zA-Z][\w-]*\s*/?>")
# White space and invisible characters.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff\xad"
#: A character that no empty or null JSON value has.
_CONTENT = re.compile(rf"[^\[\]{{}}\",nul{re.escape(BLANKS)}]")
_STRING_OR_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|[{}\[\]"\']', re.S)
_TRAILING_COMMA = re.compile(r",(\s*[}\]])")
_CAPTION = re.compile(r'["\']caption["\']\s*:\s*("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')', re.S)
_OPEN_CAPTION = re.compile(r'["\']caption["\']\s*:\s*["\']((?:[^"\\]|\\.)*)$', re.S)
#: Marks that say "cut here" or only stand after a cut: ellipses and bracketed notes.
_CUT_MARK = re.compile(r"(?:\s*(?:\.{2,}|…|\[[^\[\]{}\"]{0,20}\]|<[^<>{}\"]{0,20}>|\((?:cut|truncated|\.\.\.|…)\)))+$", re.I)
_FENCE_END = re.compile(r"(?:\s*(?:```|</[a-zA-Z]+>))+\s*$")
#: A literal that isn't a key, its end included or cut off.
_SPOKEN = re.compile(r'"((?:[^"\\]|\\.)*)(?:$|"(?!\s*:))', re.S)
_STOP = re.compile(r"[.!?。！？]['\"”’»)\]]*$")
_WORD = re.compile(r"\w+")
_QUOTED = re.compile(r"[“„«][^”“»]{0,80}[”“»]")
_DECODER = json.JSONDecoder()


def squeezed(text: str) -> str:
    """Without white space and invisible characters at the ends."""
    return text.strip(BLANKS)


def is_empty_value(value: Any) -> bool:
    """Null, a blank text, an object without keys, or a list of nothing but such values."""
    if isinstance(value, list):
        return all(map(is_empty_value, value))
    if isinstance(value, str):
        return not squeezed(value)
    return value is None or value == {}


def holds_nothing(bare: str) -> bool:
    """Whether a text without fences and tags is empty or an empty or null JSON value."""
    if not bare or bare in ("None", "''"):
        return True
    if _CONTENT.search(bare):
        return False
    try:
        return is_empty_value(json.loads(bare))
    except (ValueError, RecursionError):
        return False


@dataclass
class Reading:
    """What an answer holds. `state`: 'empty', 'closed' (a whole object), 'open' (a cut one) or 'prose'."""

    state: str
    value: Any = None
    caption: str | None = None
    lead: str = ""
    tail: str = ""
    text: str = ""
    body: str = field(default="", repr=False)


def closing(text: str, start: int) -> int | None:
    """Where the bracket opened at `start` is closed (one past it), strings skipped; None if it isn't."""
    depth = 0
    for m in _STRING_OR_BRACKET.finditer(text, start):
        c = m[0]
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return m.end()
        elif c in "\"'" and (c == '"' or text[m.start() - 1] in "{[,: "):
            return None  # a string without an end
    return None


def loaded(text: str, start: int) -> tuple[Any, int] | None:
    """The object at `start` and its end, leniently: trailing commas and Python literals are read too."""
    try:
        value, end = _DECODER.raw_decode(text, start)
        return value, end
    except (ValueError, RecursionError):
        pass
    end = closing(text, start)
    if end is None:
        return None
    body = _TRAILING_COMMA.sub(r"\1", text[start:end])
    try:
        return json.loads(body, strict=False), end
    except (ValueError, RecursionError):
        pass
    try:
        return ast.literal_eval(body), end
    except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
        return body, end


def read(text: str | None) -> Reading:
    if text is None:
        return Reading("empty")
    plain = squeezed(text)
    if holds_nothing(squeezed(_WRAP.sub(" ", plain))):
        return Reading("empty", text=plain)
    start = plain.find("{")
    if start < 0:
        return Reading("prose", text=plain)
    lead, found = plain[:start], loaded(plain, start)
    if found is None:
        m = _OPEN_CAPTION.search(plain, start) or _CAPTION.search(plain, start)
        return Reading("open", caption=m[1] if m else None, lead=lead, text=plain, body=plain[start:])
    value, end = found
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    caption = value.get("caption") if isinstance(value, dict) else None
    if isinstance(value, str) and (m := _CAPTION.search(plain, start)):
        caption = m[1][1:-1]
    return Reading("closed", value, caption if isinstance(caption, str) else None, lead, plain[end:], plain, plain[start:end])


def is_assessing(value: Any) -> bool:
    """An object that reports at least one violated rule or box."""
    if not isinstance(value, dict):
        return False
    return any(value.get(k) not in (None, {}, [], "", False) for k in (*RULE_KEYS, *CLASS_KEYS))


def has_rule_keys(value: Any) -> bool:
    return isinstance(value, dict) and any(k in value for k in RULE_KEYS)


def said(reading: Reading) -> str:
    """The sentences of an answer: its prose, or the caption, reasons and other texts of its object."""
    if reading.state == "prose":
        return reading.text
    value = reading.value
    if not isinstance(value, dict):
        return " ".join(m[1] for m in _SPOKEN.finditer(reading.body))
    parts = []
    for key, x in value.items():
        if isinstance(x, dict):
            x = x.get("reason")
        if isinstance(x, list):
            x = " ".join(e for e in x if isinstance(e, str))
        if isinstance(x, str):
            parts.append(x)
    return " ".join(parts)


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


@lru_cache(maxsize=65_536)
def script_of(letter: str) -> str:
    """The script of a letter: the first word of its character's name."""
    return unicodedata.name(letter, "").partition(" ")[0]


def language_of(text: str, expected: str) -> str | None:
    """The language of the text if it clearly isn't the expected one, else None.

    Most letters must be in a script of the expected language, else the answer is the script's name. The
    Latin languages with known function words are told apart by these; an expected language without any
    is only judged by its script.
    """
    text = _QUOTED.sub(" ", text)
    expected = re.split(r"[-_]", expected.strip().casefold())[0]
    scripts = SCRIPTS.get(expected, ("LATIN",))
    if not text.isascii() or scripts != ("LATIN",):
        letters = {c: n for c, n in Counter(text).items() if c.isalpha()}
        foreign = {c: n for c, n in letters.items() if script_of(c) not in scripts}
        if sum(letters.values()) >= 8 and sum(foreign.values()) > 0.5 * sum(letters.values()):
            return script_of(next(iter(foreign))).casefold()
    own = _LANGUAGES.get(expected)
    if not own:
        return None
    tokens = words(text.replace("'", " ").replace("’", " "))
    if sum(t in own for t in tokens) * 4 >= len(tokens):
        return None  # a quarter of the words: no other language can have 1.6 times as many of its own
    scores = {lang: sum(t in known for t in tokens) for lang, known in _LANGUAGES.items()}
    best = max(scores, key=lambda k: (scores[k], k == expected))
    if best == expected or scores[best] < 2 or scores[expected] * 1.6 >= scores[best]:
        return None
    return best


@lru_cache(maxsize=4096)
def prompt_pairs(prompt: str) -> frozenset[tuple[str, str]]:
    tokens = words(prompt)
    return frozenset(zip(tokens, tokens[1:], strict=False)) | {(tokens[-1], tokens[0])} if tokens else frozenset()


@lru_cache(maxsize=4096)
def prompt_words(prompt: str) -> frozenset[str]:
    return frozenset(words(prompt))


#: Words an answer may put before a copied prompt.
COPY_LEADS = frozenset("question prompt user task instruction frage aufgabe anweisung pregunta tarea instrucción usuario text json".split())


def is_copy(text: str, prompt: str) -> bool:
    """Nearly all neighbouring words of the text also stand side by side in the prompt."""
    tokens = words(text)
    while tokens and tokens[0] in COPY_LEADS and tokens[0] not in prompt_words(prompt):
        tokens = tokens[1:]
    if len(tokens) < 4:
        return False
    pairs = prompt_pairs(prompt)
    known = prompt_words(prompt)
    near = sum(p in pairs for p in zip(tokens, tokens[1:], strict=False)) / (len(tokens) - 1)
    return near >= 0.55 and sum(t in known for t in tokens) >= 0.75 * len(tokens)


def is_template(value: Any, reading: Reading) -> bool:
    """The prompt's own form instead of content: named corners or the word for the text."""
    body = reading.body.casefold()
    return "xmin" in body and "ymax" in body or (isinstance(value, dict) and reading.caption == "text")


def is_copied(reading: Reading, prompt: str, sentences: str) -> bool:
    """Whether an answer says nothing but the prompt's own wording or template."""
    if reading.state != "closed":
        return is_copy(reading.text, prompt)
    if is_template(reading.value, reading) and (is_copy(reading.text, prompt) or is_copy(reading.body, prompt)):
        return True
    return not is_assessing(reading.value) and is_copy(sentences, prompt)


def declines(reading: Reading, sentences: str) -> bool:
    """Whether an answer refuses. An object of nulls without sentences is an assessment, whatever stands before it."""
    if reading.state == "open":
        return False
    if reading.state == "closed" and (is_assessing(reading.value) or (has_rule_keys(reading.value) and not sentences)):
        return False
    return is_refusal(sentences if reading.state == "closed" and sentences else reading.text)


def defects(reading: Reading, prompt: str | None, lang: str | None) -> list[str]:
    """Every rule that applies, in order: empty, copied_prompt, refusal, other_language.

    An answer that is empty has nothing that another rule could read. 'truncated' is decided with the
    statistics of the corpus, see truncation.
    """
    if reading.state == "empty":
        return ["empty"]
    sentences = said(reading)
    rules = (
        ("copied_prompt", bool(prompt) and is_copied(reading, prompt or "", sentences)),
        ("refusal", declines(reading, sentences)),
        ("other_language", bool(lang) and language_of(sentences, lang or "") is not None),
    )
    return [name for name, applies in rules if applies]


@dataclass
class Ending:
    """How a text ends. kind: 'object' (inside one), 'caption', 'tail' or 'prose'; words: its last two words.

    `whole` is True if the ending can't be a cut, False if it must be one, None if it has to be weighed.
    `stopped` says whether a sentence mark closes it.
    """

    kind: str
    words: str
    whole: bool | None
    stopped: bool


def last_words(text: str) -> str:
    """The last two words; only the end of the text is looked at, however long its words are."""
    return " ".join(_WORD.findall(" ".join(text.rsplit(None, 4)[-4:]).casefold())[-2:])


def ending(reading: Reading) -> Ending:
    """Marks that stand after a cut (ellipsis, bracketed note, fence) are taken off first."""
    if reading.state == "empty":
        return Ending("prose", "", True, False)
    if reading.state == "open":
        return Ending("object", last_words(reading.body), False, False)
    if reading.state == "prose":
        return _of_text("prose", reading.text)
    if reading.caption is not None:
        own = _of_text("caption", reading.caption)
        if not own.whole:
            return own
    tail = squeezed(_WRAP.sub(" ", reading.tail))
    if tail:
        return _of_text("tail", tail)
    return Ending("object", "", True, True)


def _of_text(kind: str, text: str) -> Ending:
    text = _FENCE_END.sub("", text).rstrip()
    uncut = _CUT_MARK.sub("", text).rstrip()
    marked = uncut != text
    stopped = bool(_STOP.search(uncut)) and not marked
    if not _WORD.search(uncut):
        return Ending(kind, "", True, stopped)
    return Ending(kind, last_words(uncut), True if stopped else None, stopped)
