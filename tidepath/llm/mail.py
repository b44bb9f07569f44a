"""What the reader of a raw message sees: subject and decoded text parts, attachments left out."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:[ \t]?")
_WORD = re.compile(r"=\?([\w.-]+)\?([bBqQ])\?([^?]*)\?=")
_BOUNDARY = re.compile(r'boundary="?([^";\s]+)"?', re.I)
_BLOCK = re.compile(r"<\s*/?\s*(?:br|p|div|tr|td|th|li|ul|ol|table|h[1-6]|blockquote|html|body|head)\b[^>]*>", re.I)
_TAG = re.compile(r"<(?:!--.*?--|/?[A-Za-z][^<>]*)>", re.S)
_HIDDEN = re.compile(r"<(style|script)\b.*?</\1\s*>", re.S | re.I)


def _bytes_to_text(b: bytes, charset: str = "utf-8") -> str:
    try:
        return b.decode(charset, "replace")
    except LookupError:
        return b.decode("utf-8", "replace")


def encoded_words(s: str) -> str:
    """Header text with its encoded words decoded; broken ones stay."""

    def one(m: re.Match) -> str:
        try:
            b = base64.b64decode(m[3] + "=" * (-len(m[3]) % 4)) if m[2] in "bB" else quopri.decodestring(m[3].replace("_", " "))
            return _bytes_to_text(b, m[1])
        except (binascii.Error, ValueError):
            return m[0]

    return _WORD.sub(one, re.sub(r"(\?=)\s+(=\?)", r"\1\2", s))


def _split_headers(text: str) -> tuple[dict[str, str], str]:
    """Headers by lower-case name and the body; a text that starts without a header is all body."""
    if not _HEADER.match(text):
        return {}, text
    head, _, body = text.partition("\n\n")
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
        elif line.strip():  # a body right behind the headers
            body = line + "\n" + body
    return out, body


def strip_html(s: str) -> str:
    s = _BLOCK.sub("\n", _HIDDEN.sub(" ", s))
    return html.unescape(_TAG.sub("", s))


def _decoded(body: str, headers: dict[str, str]) -> str:
    """A text part's body as it is read: its transfer coding undone, and HTML taken off."""
    how = headers.get("content-transfer-encoding", "").lower()
    if how == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/]", "", body)
        body = _bytes_to_text(base64.b64decode(raw[: len(raw) // 4 * 4]))
    elif how == "quoted-printable":
        body = _bytes_to_text(quopri.decodestring(body.encode("utf-8")))
    if "html" in headers.get("content-type", "").lower() or re.match(r"\s*<html", body, re.I):
        body = strip_html(body)
    return body


def visible(text: str | None) -> str:
    """Subject and text parts of a message, however deep multiparts are nested. NULL gives an empty string; cut or
    broken parts are read as far as they go; the whole text is read, however long."""
    if not text:
        return ""
    waiting, out = [text.replace("\r\n", "\n").replace("\r", "\n").lstrip("\n")], []
    while waiting:
        headers, body = _split_headers(waiting.pop())
        if not out:
            out.append(encoded_words(headers.get("subject", "")))
        kind = headers.get("content-type", "text/plain")
        if kind.lower().startswith("multipart/") and (m := _BOUNDARY.search(kind)):
            parts = body.split("--" + m[1])[1:]
            waiting += [p.removeprefix("\n") for p in reversed(parts) if not p.startswith("--")]
        elif kind.lower().startswith("text/") and not headers.get("content-disposition", "").lower().startswith("attachment"):
            out.append(_decoded(body, headers))
    return "\n".join(out)
