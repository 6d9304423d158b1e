"""Bytes to text: byte-order mark, header, a prescan for meta tags, then UTF-8; what is malformed is replaced."""

from __future__ import annotations

import codecs
import re

#: Fixed value: bytes that are looked at for a declaration.
PRESCAN = 1024
#: Labels that browsers read as another character set than Python.
LABELS = {
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "l1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso_8859-1": "cp1252", "windows-1252": "cp1252",
    "x-cp1252": "cp1252", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "x-sjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "ms_kanji": "cp932", "gb2312": "gb18030", "gbk": "gb18030",
    "x-gbk": "gb18030", "gb_2312-80": "gb18030", "big5": "big5hkscs", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "iso-8859-9": "cp1254", "latin5": "cp1254", "tis-620": "cp874", "iso-8859-11": "cp874",
    "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "x-user-defined": None,
}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))


def codec_of(label: str | None) -> str | None:
    """The codec of a label; null if it isn't known."""
    if not label:
        return None
    label = label.strip().lower()
    if label in LABELS:
        return LABELS[label]
    try:
        return codecs.lookup(label).name if re.fullmatch(r"(utf-8|iso-8859-\d+|windows-\d+|koi8-[ru]|macintosh|ibm866|euc-jp|iso-2022-jp|gb18030|cp\d+)", label) else None
    except LookupError:
        return None


def prescanned(body: bytes) -> str | None:
    """The first known label that an open meta tag at the start declares."""
    head = body[:PRESCAN].decode("latin-1").lower()
    for m in re.finditer(r"charset", head):
        tag = head.rfind("<", 0, m.start())
        if tag < 0 or not re.match(r"<meta[\s/]", head[tag:]) or ">" in head[tag : m.start()]:
            continue
        label = re.match(r"\s*=\s*[\"']?\s*([^\s\"'/>;]+)", head[m.end() :])
        if label and codec_of(label[1]):
            # a page that says so in single bytes isn't in double ones
            return "utf-8" if codec_of(label[1]).startswith("utf-16") else codec_of(label[1])
    return None


def decoded(body: bytes, charset: str | None, html: bool = True) -> str:
    for mark, codec in MARKS:
        if body.startswith(mark):
            return body[len(mark) :].decode(codec, "replace")
    codec = codec_of(charset) or (prescanned(body) if html else None) or "utf-8"
    return body.decode(codec, "replace")
