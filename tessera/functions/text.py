r"""Text functions: mathematics in HTML and LaTeX, tags, entities, white space.

Mathematics becomes ``[MATH]...[/MATH]``.  Everything is built from JVM functions; a text without an
ampersand or a span skips their part.  The names of entities are the HTML5 table of Python's ``html``.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class of a mathematics span, the token that replaces it, and the patterns of a span, a tag,
# a formula in double dollars and one in single dollars.
SPAN_CLASS = "math-container"
OPEN, CLOSE = "[MATH]", "[/MATH]"
SPAN = r'<span\s+class="math-container"[^>]*>(.*?)</span>'
TAG = r"<[^>]+>"
DOUBLE_DOLLARS = r"\$\$([^$]+)\$\$"
SINGLE_DOLLARS = r"(?<!\$)\$([^$\n]+)\$(?!\$)"

#: What Python's str.strip() and \s take for white space.
SPACE = r"[\s\x1c-\x1f]"
_JAVA_SPACE = r"(?U)" + SPACE


def wrap_math(col: Column) -> Column:
    return F.concat(F.lit(OPEN), col, F.lit(CLOSE))


def strip(col: Column) -> Column:
    """Python's ``str.strip``: Unicode white space at both ends."""
    return F.regexp_replace(col, f"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse(col: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(col, _JAVA_SPACE + "+", " "))


def strip_tags(col: Column) -> Column:
    """Tags become spaces."""
    return F.regexp_replace(col, TAG, " ")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(F.struct(value.alias("value"))), lambda s: body(s["value"]))[0]


def _token(inner: Column) -> Column:
    """The text of a span without its dollars, as a token."""

    def without(text: Column) -> Column:
        between = lambda n: strip(F.substring(text, F.lit(n + 1), F.greatest(F.length(text) - 2 * n, F.lit(0))))
        marked = lambda m: F.startswith(text, F.lit(m)) & F.endswith(text, F.lit(m))
        return F.when(marked("$$"), between(2)).when(marked("$"), between(1)).otherwise(text)

    return wrap_math(_let(strip(inner), without))


def math_spans(col: Column) -> Column:
    """``<span class="math-container">$x$</span>`` becomes a token; a span of dollars alone is empty.

    A span ends at the first ``</span>``; one that never ends stays as it is.
    """
    pattern = f"(?sU){SPAN}"
    between = F.split(col, pattern, -1)
    tokens = F.transform(F.regexp_extract_all(col, F.lit(pattern), 1), _token)
    whole = F.array_join(F.flatten(F.zip_with(between, tokens, lambda b, t: F.array(b, t))), "")
    return F.when(F.contains(col, F.lit(SPAN_CLASS)), whole).otherwise(col)


def latex_dollars(col: Column) -> Column:
    """``$$x$$``, then single ``$x$`` on one line without neighbouring dollars, become tokens."""
    col = F.coalesce(col, F.lit(""))
    for pattern in (DOUBLE_DOLLARS, SINGLE_DOLLARS):
        col = F.regexp_replace(col, pattern, f"{OPEN}$1{CLOSE}")
    return col


def formula_list(col: Column) -> Column:
    """An array of formulas as one text, empty ones left out."""
    return F.array_join(F.transform(F.filter(col, lambda f: f != ""), wrap_math), " ")


def join_parts(*cols: Column) -> Column:
    """Non-empty parts joined by a space."""
    return strip(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols]))


# Character references, as HTML5 reads them.

_REFERENCE = r"^(#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)"
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)  # longer ones are tried first


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered(code: Column) -> Column:
    """The character of a code: codes that can't stand for themselves are replaced, others aren't shown.  From 0x80 to
    0x9F codes mean what they mean in Windows-1252."""
    windows = [bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)]
    hidden = code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "�")
        .when(code.between(0x80, 0x9F), F.substring(F.lit("".join(windows)), (code - 0x7F).cast("int"), F.lit(1)))
        .when(hidden, "")
        .otherwise(_character(code))
    )


def _reference(after: Column) -> Column:
    """What follows an ampersand, with the reference at its start decoded."""
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in html5.items())), F.lit("\x01"), F.lit("\x02"))  # folded into one map

    def decoded(name: Column) -> Column:
        rest = F.substring(after, F.length(name) + 1, F.length(after))
        hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
        digits = F.ltrim(F.regexp_replace(name, "[#xX;]", ""), F.lit("0"))
        code = F.when(F.length(digits) > 7, 0x110000).otherwise(F.coalesce(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"), F.lit(0)))
        bare = F.regexp_extract(name, "^(" + "|".join(_BARE) + ")", 1)
        named = F.coalesce(F.element_at(names, name), F.when(bare != "", F.concat(F.element_at(names, bare), F.substring(name, F.length(bare) + 1, F.length(name)))), F.concat(F.lit("&"), name))
        return F.when(name == "", F.concat(F.lit("&"), after)).otherwise(F.concat(F.when(F.startswith(name, F.lit("#")), _let(code, _numbered)).otherwise(named), rest))

    return _let(F.regexp_extract(after, _REFERENCE, 1), decoded)


def unescape(col: Column) -> Column:
    """Character references decoded once, as ``html.unescape`` does; null stays null."""
    parts = F.split(col, "&", -1)
    whole = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _reference), ""))
    return F.when(F.contains(col, F.lit("&")), whole).otherwise(col)


def html_to_text(col: Column | str) -> Column:
    """HTML to text: mathematics spans, tags, entities, white space.  Null gives the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return collapse(unescape(strip_tags(math_spans(F.coalesce(col, F.lit(""))))))


def strip_html(col: Column) -> Column:
    """Tags to spaces, entities decoded, ends stripped; inner white space stays."""
    return strip(unescape(strip_tags(F.coalesce(col, F.lit("")))))
