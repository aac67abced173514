"""Text expressions: redaction (X4), normalisation (X5), model-output
parsing (X6) and display formatting (X9).  All native Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow import schemas as K

# The three redaction patterns of the service, in the order it
# applies them (email, phone, identifier).  Its regex engine treats \b as an
# ASCII word boundary; Java's \b is Unicode-aware, so each boundary is spelled
# out with ASCII lookarounds.  Because every match starts and ends with a
# known kind of character, each boundary reduces to one lookaround (same
# positions as the ASCII \b, and much cheaper than the general form).
WORD = "[A-Za-z0-9_]"
B = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"          # general ASCII \b
B_BEFORE_EMAIL = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?=[.%+-]))"
B_AFTER_WORD = f"(?!{WORD})"                                     # after a letter or digit
B_BEFORE_DIGIT = f"(?<!{WORD})"                                  # before a digit
EMAIL_RE = f"(?i){B_BEFORE_EMAIL}[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}{B_AFTER_WORD}"
PHONE_RE = f"(?:\\+?593|0)[ -]?[0-9]{{2}}[ -]?[0-9]{{3}}[ -]?[0-9]{{4}}{B_AFTER_WORD}"
ID_RE = f"{B_BEFORE_DIGIT}[0-9]{{10,13}}{B_AFTER_WORD}"
# strict mode: long identifier runs (11-13 digits) are tagged before phones
LONG_ID_RE = f"{B_BEFORE_DIGIT}[0-9]{{11,13}}{B_AFTER_WORD}"


def _email_pass(col: Column) -> Column:
    # an e-mail needs an '@': texts without one skip the regex entirely
    return F.when(F.instr(col, "@") > 0, F.regexp_replace(col, EMAIL_RE, K.TAG_EMAIL)).otherwise(col)


def redact(col: Column, max_len: int | None = K.REDACT_MAX_LEN, strict: bool = False) -> Column:
    """Email, then phone, then 10-13 digit ids replaced by tags; then cut to
    ``max_len`` characters (None keeps the whole text)."""
    out = _email_pass(col)
    if strict:
        out = F.regexp_replace(out, LONG_ID_RE, K.TAG_ID)
    out = F.regexp_replace(out, PHONE_RE, K.TAG_PHONE)
    out = F.regexp_replace(out, ID_RE, K.TAG_ID)
    return out if max_len is None else F.substring(out, 1, max_len)


def _occurrences(col: Column, tag: str) -> Column:
    return ((F.length(col) - F.length(F.replace(col, F.lit(tag), F.lit("")))) / len(tag)).cast("bigint")


def redaction_counts(col: Column, redacted: Column | None = None) -> tuple[Column, Column, Column]:
    """Match counts per pattern as ``redact`` applies them.  Tags are never
    matched by a later pattern (no digits, no '@'), so each count is the
    number of its tags in the redacted text minus those already in the input;
    one redaction pass serves all three counts."""
    red = _redact_full(col) if redacted is None else redacted
    return tuple(_occurrences(red, tag) - _occurrences(col, tag) for tag in (K.TAG_EMAIL, K.TAG_PHONE, K.TAG_ID))


# Whitespace of the service's runtime (\s and trim): ASCII plus Unicode spaces.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
JS_SPACES = "\t\n\x0B\f\r \u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"


def _redact_full(col: Column) -> Column:
    return redact(col, max_len=None)


def js_trim(col: Column) -> Column:
    """String.prototype.trim: strips Unicode spaces too (Spark trim strips
    only U+0020 unless told).  No regular expression: one tries every place of
    a long text."""
    return F.trim(col, F.lit(JS_SPACES))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def normalize_phone(col: Column) -> Column:
    return F.regexp_replace(col, f"[{JS_SPACE}()-]", "")


def composite_id(*cols: Column) -> Column:
    return F.concat_ws("__", *cols)


def strip_json_fence(col: Column) -> Column:
    """Remove a leading ```json fence and a trailing ``` fence."""
    head = F.regexp_replace(col, f"(?i)^```json[{JS_SPACE}]*", "")
    return F.regexp_replace(head, f"[{JS_SPACE}]*```$", "")


def percent(confidence: Column) -> Column:
    """Math.round(confidence * 100) + '%' (half rounds up)."""
    return F.concat(F.floor(confidence * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def whole_dollars(amount: Column) -> Column:
    """USD without cents, '.' as thousands separator (es-EC style)."""
    return F.concat(F.lit("$"), F.translate(F.format_number(F.round(amount, 0), 0), ",", "."))


def initials(name: Column) -> Column:
    parts = F.slice(F.split(name, f"[{JS_SPACE}]+"), 1, 2)
    return F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), ""))


def humanize(code: Column) -> Column:
    return F.regexp_replace(code, "_", " ")


def label(code: Column, labels: dict[str, str]) -> Column:
    from caseflow.functions.literals import lookup
    return lookup(code, labels)
