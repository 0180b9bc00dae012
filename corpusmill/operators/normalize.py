"""Text normalization as a chain of column expressions, in one fixed order whatever the order of the options."""

from __future__ import annotations

import string
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F

OPTIONS = {"unicode": {"NFC", "NFD", "NFKC", "NFKD"}, "conversion": None, "whitespace": {"collapse", "strip", "remove"}, "numbers": {"full", "half"}, "letters": {"full", "half"}, "punctuation": {"full", "half"}, "quotes": {"straight", "smart", "corner", "guillemets"}}
WIDE = 0xFEE0  # from an ASCII mark to its full-width form
STYLES = {"straight": "\"\"''", "smart": "“”‘’", "corner": "「」『』", "guillemets": "«»‹›"}
OPENING, CLOSING, EITHER = "「『“‘‹«｢", "」』”’›»｣", "\"'＂＇"
DOUBLE = set("\"＂“”「」«»")
WHITE = "(?U)[\\s\\x1c-\\x1f]"


def _wide(text: Column, half: str, to_full: bool) -> Column:
    full = "".join(chr(ord(c) + WIDE) for c in half)
    return F.translate(text, half, full) if to_full else F.translate(text, full, half)


def unicode_form(text: Column, form: str) -> Column:
    """Spark has no such function: an Arrow UDF."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize(form, t) for t in x.to_pylist()], pa.string())

    return run(text)


def whitespace(text: Column, mode: str) -> Column:
    if mode == "remove":
        return F.regexp_replace(text, WHITE, "")
    if mode == "collapse":
        text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n+", "\n")
    ends = f"(?m)^(?:(?!\\n){WHITE})+|(?:(?!\\n){WHITE})+$"
    text = F.regexp_replace(text, ends.replace("(?m)", "(?md)"), "")
    return F.regexp_replace(text, f"\\A{WHITE}+|{WHITE}+\\z", "") if mode == "collapse" else text


def requoted(text: str, style: str) -> str:
    """The first kind of quote is the outer one; marks without a direction open and close in turn, each kind by itself."""
    marks = STYLES[style]
    outer, depth, out = None, {True: 0, False: 0}, []
    for c in text:
        if c not in OPENING and c not in CLOSING and c not in EITHER:
            out.append(c)
            continue
        double = c in DOUBLE
        if outer is None:
            outer = double
        opens = c in OPENING or c in EITHER and depth[double] % 2 == 0
        depth[double] = depth[double] + 1 if opens else max(0, depth[double] - 1)
        out.append(marks[2 * (double != outer) + (not opens)])
    return "".join(out)


def quotes(text: Column, style: str) -> Column:
    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if t is None else requoted(t, style) for t in x.to_pylist()], pa.string())

    return run(text)


def normalize(text: Column, options: dict, converters: dict | None = None) -> Column:
    """unicode, conversion, whitespace, numbers, letters, punctuation, quotes, in this order; null stays null, no options change nothing.

    conversion names a column function in converters: script converters aren't part of this package.
    """
    for key, value in options.items():
        if key not in OPTIONS:
            raise ValueError(f"unknown option {key!r}")
        if OPTIONS[key] is not None and value not in OPTIONS[key]:
            raise ValueError(f"{key} must be one of {sorted(OPTIONS[key])}")
    if "unicode" in options:
        text = unicode_form(text, options["unicode"])
    if "conversion" in options:
        if options["conversion"] not in (converters or {}):
            raise ValueError(f"no converter {options['conversion']!r}")
        text = converters[options["conversion"]](text)
    if "whitespace" in options:
        text = whitespace(text, options["whitespace"])
    for key, chars in (("numbers", string.digits), ("letters", string.ascii_letters), ("punctuation", string.punctuation)):
        if key in options:
            text = _wide(text, chars, options[key] == "full")
            if key == "punctuation" and options[key] == "half":
                text = F.translate(text, "　", " ")
    return quotes(text, options["quotes"]) if "quotes" in options else text
