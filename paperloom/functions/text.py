"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space when texts are stripped.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Extensions of files that are taken in, lower case.
EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".doc")
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
#: Messages and marks that results carry.
CUT_MARK = "\n...(이하 생략)"
NO_EVIDENCE = "제공된 문서 근거로는 확인할 수 없습니다."
NO_VALUE = "(없음)"
NO_DOCUMENTS = "(문서 없음)"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return stripped(c) == ""


def suffix(name: Column) -> Column:
    """The extension with its dot in lower case; none for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def accepted(name: Column) -> Column:
    return suffix(name).isin(*EXTENSIONS)


def reject_reason(name: Column, size: Column) -> Column:
    """Why an upload is rejected, by the first rule that it breaks, or null."""
    return F.when(F.coalesce(name, F.lit("")) == "", "filename").when(~accepted(name), "extension").when(size > MAX_UPLOAD_BYTES, "too large").when(size == 0, "empty")


def decoded(content: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed."""
    return F.make_valid_utf8(content.cast("string"))


def collection_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, r"[^a-zA-Z0-9_\-]", "_"), F.lit("_")), F.lit("")), F.lit("default"))


def tags(c: Column) -> Column:
    """Split at commas and stripped, empty items kept; null for null or empty."""
    return F.when(F.nullif(c, F.lit("")).isNotNull(), F.transform(F.split(c, ","), stripped))


def cut(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def without_fence(c: Column) -> Column:
    """The inside of a ``` block, if the text starts with one."""
    return F.when(F.startswith(c, F.lit("```")), F.regexp_replace(F.regexp_replace(c, r"^```[a-z]*\n?", ""), r"\n?```$", "")).otherwise(c)


def or_message(answer: Column) -> Column:
    return F.coalesce(F.nullif(stripped(answer), F.lit("")), F.lit(NO_EVIDENCE))


def or_label(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(NO_VALUE))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def base_url(c: Column) -> Column:
    """Trailing characters of "/v1", whichever they are, are taken off."""
    return F.rtrim(c, F.lit("/v1"))


def cost(prompt: Column, completion: Column, per_million_in: float, per_million_out: float) -> Column:
    """0 unless both counts are there and above 0."""
    return F.when((prompt > 0) & (completion > 0), prompt / 1e6 * per_million_in + completion / 1e6 * per_million_out).otherwise(F.lit(0.0))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two times in seconds."""
    return F.floor((end - start) * 1000)
