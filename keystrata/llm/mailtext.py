"""Readable text of raw mails: MIME parts, transfer decoding, HTML to lines, words."""

from __future__ import annotations

import binascii
import html
import re
import unicodedata
from typing import NamedTuple

_FIELD = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*(.*(?:\n[ \t]+.*)*)", re.I | re.M)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]+)"|([^\s;"]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([\w.:-]+)', re.I)
_NAMED = re.compile(r"\bname\*?\d*\*?\s*=", re.I)
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/=]+")

_HIDDEN = re.compile(r"<!--.*?-->|<(style|script|title)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>", re.I)
_QUOTE_ON, _QUOTE_OFF = re.compile(r"<blockquote\b[^>]*>", re.I), re.compile(r"</blockquote\s*>", re.I)
_INLINE = re.compile(r"</?(?:b|i|u|s|a|em|strong|span|font|small|big|code|tt|sub|sup|mark|label|abbr|q|cite|wbr)\b[^<>]*>", re.I)
_CELL = re.compile(r"</?(?:td|th)\b[^<>]*>", re.I)
_BLOCK = re.compile(r"<[a-zA-Z/!][^<>]*>")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W_]+")


class Part(NamedTuple):
    text: str
    is_html: bool
    is_attachment: bool


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        clean = _NOT_B64.sub("", body).rstrip("=")
        if len(clean) % 4 == 1:
            clean = clean[:-1]
        raw = binascii.a2b_base64(clean + "=" * (-len(clean) % 4))
    elif encoding == "quoted-printable":
        if "=" not in body:
            return body
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _opened(text: str, out: list[Part]) -> list[str]:
    """The parts that a part holds, in order; one that holds none is added to ``out`` if it is text."""
    if text.startswith("\n"):
        head, body = "", text[1:]
    else:
        head, _, body = text.partition("\n\n")
    kind, encoding, disposition = "text/plain", "", ""
    for name, value in _FIELD.findall(head):
        name = name.lower()
        if name == "content-type":
            kind = value
        elif name == "content-transfer-encoding":
            encoding = value.strip().lower()
        else:
            disposition = value.strip().lower()
    media = kind.partition(";")[0].strip().lower()
    if media.startswith("multipart/") and (m := _BOUNDARY.search(kind)):
        held = []
        for piece in ("\n" + body).split("\n--" + (m[1] or m[2]).rstrip())[1:]:
            if piece.startswith("--"):
                break
            held.append(piece.partition("\n")[2])
        return held
    if media == "message/rfc822":
        return [body]
    if media.startswith("text/") or media.startswith("multipart/") or "/" not in media:
        charset = m[1] if (m := _CHARSET.search(kind)) else ""
        attached = disposition.startswith("attachment") or bool(_NAMED.search(kind))
        out.append(Part(_decoded(body, encoding, charset), media == "text/html", attached))
    return []


def parts(raw: str | None) -> list[Part]:
    """The text parts of a mail in order, transfer-decoded. NULL or empty texts have none.

    Line ends of any kind count as one; a missing end boundary ends with the text; a multipart without boundary is read
    as plain text; binary parts are left out. Parts are opened however deep they lie; each is shorter than what holds it.
    """
    if not raw:
        return []
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    out: list[Part] = []
    waiting = [raw]
    while waiting:
        waiting += reversed(_opened(waiting.pop(), out))
    return out


def visible(markup: str) -> str:
    """HTML as a reader sees it: no markup, entities resolved; block elements and cells end a line."""
    s = _HIDDEN.sub(" ", markup)
    s = _BLOCK.sub("\n", _INLINE.sub("", s))
    return html.unescape(s) if "&" in s else s


def normal(s: str) -> str:
    """Composed characters, no invisible ones, case folded."""
    if not s.isascii():
        s = unicodedata.normalize("NFC", _INVISIBLE.sub("", s))
        return s.casefold()
    return s.lower()


def words(s: str) -> list[str]:
    """Runs of letters and digits, case folded."""
    return WORD.findall(normal(s))


def part_words(part: Part) -> list[str]:
    return words(visible(part.text) if part.is_html else part.text)


_QUOTED = re.compile(r"^[ \t]*[>|]")
#: A line that introduces a quotation: it says who wrote, or holds a time, and ends in a colon.
_INTRO = re.compile(r"(?:\b(?:wrote|schrieb|escribió|a écrit)\b.{0,80}|\d{1,2}[:.]\d{2}.{0,80}|\?.{0,80}):\s*$")
INTRO_CHARS = 160


def _own_html(markup: str) -> list[str]:
    s = _HIDDEN.sub(" ", markup)
    s = _LINK.sub(lambda m: " " + (m[1] or m[2] or m[3] or "") + " ", s)
    s = _QUOTE_OFF.sub("\x02", _QUOTE_ON.sub("\x01", _SPACE.sub(" ", s)))
    if "\x01" in s:
        kept, depth = [], 0
        for piece in re.split("([\x01\x02])", s):
            if piece == "\x01":
                depth += 1
            elif piece == "\x02":
                depth = max(0, depth - 1)
            elif depth == 0:
                kept.append(piece)
        s = "\n".join(kept)
    s = _BLOCK.sub("\n", _CELL.sub(" ", _INLINE.sub("", s)))
    lines = (html.unescape(s) if "&" in s else s).split("\n")
    return [x for x in lines if not (len(x) < INTRO_CHARS and _INTRO.search(x))]


def _own_plain(text: str) -> list[str]:
    """Lines outside quotations; an indented block after a line that introduces a quotation is one."""
    out, quoting = [], False
    for line in text.split("\n"):
        if _QUOTED.match(line):
            continue
        if quoting:
            if not line.strip():
                continue
            if line[:1] in " \t":
                continue
            quoting = False
        if len(line) < INTRO_CHARS and _INTRO.search(line):
            quoting = True
            continue
        out.append(line)
    return out


def own_lines(raw: str | None) -> list[list[str]]:
    """Per text part that is no attachment, its lines without quotations; HTML keeps hidden text and link addresses."""
    return [_own_html(p.text) if p.is_html else _own_plain(p.text) for p in parts(raw) if not p.is_attachment]
