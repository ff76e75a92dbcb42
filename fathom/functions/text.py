"""Text expressions: tokens, sentences, chunk headers, previews. All are Columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: A word, or any other single character that is no white space (non-breaking and wide blanks are white space).
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z])"
ANY_SENTENCE_GAP = r"(?<=[.!?])\s+"

#: What marks a code block as configuration.
CONFIG_PATTERNS = (
    r'"Effect"\s*:\s*"(Allow|Deny)"',
    r'"AWSTemplateFormatVersion"',
    r'"Resources"\s*:\s*\{',
    r'resource\s+"aws_',
    r'provider\s+"aws"',
    r"Type:\s+AWS::",
)

#: The common English stop words that are never indexed.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
)


def words(text: Column) -> Column:
    """Longest runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(tokens(text)))


def head_tokens(text: Column, n: int) -> Column:
    """The text up to the end of its n-th token; the whole text if it has no more."""
    token = r"(?:[\p{L}\p{N}]++|[^\p{L}\p{N}\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}])"
    return F.when(token_count(text) <= n, text).otherwise(F.regexp_extract(text, r"(?s)^(?:.*?" + token + "){" + str(n) + "}", 0))


def tail_tokens(text: Column, n: int) -> Column:
    """The text from the start of its n-th last token; the whole text if it has no more."""
    return F.reverse(head_tokens(F.reverse(text), n))


def sentences(text: Column) -> Column:
    """Split where a sentence end, white space and a capital meet."""
    return F.split(text, SENTENCE_GAP)


def last_sentence(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), ANY_SENTENCE_GAP), -1)


def is_config(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(CONFIG_PATTERNS))


def context_line(paragraph: Column, limit: int = 100) -> Column:
    """What a code block is told about the paragraph before it: all of it, or its last sentence, or that sentence's first tokens."""
    whole, last = F.trim(paragraph), last_sentence(paragraph)
    return F.when(token_count(whole) <= limit, whole).otherwise(head_tokens(last, limit))


def split_header(text: Column) -> tuple[Column, Column]:
    """The leading ``[path] `` of a chunk, empty if there is none, and the rest."""
    close = F.locate("] ", text)
    there = text.startswith("[") & (close > 0)
    return F.when(there, F.substring(text, F.lit(1), close + 1)).otherwise(""), F.when(there, F.substring(text, close + 2, F.length(text))).otherwise(text)


def preview(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` code points, with dots where something is left out."""
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def path_parts(section_path: Column) -> Column:
    return F.split(section_path, r"\s*>\s*")
