"""Scalar column functions: chunk ids, hashes, code-aware tokens, vector normalisation."""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode White_Space, for trimming.
SPACE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Tokens of at least so many bytes are dropped after stemming.
LONG_TOKEN = 40


def chunk_id(path: Column, n: Column) -> Column:
    return F.concat(path, F.lit("#chunk"), n.cast("string"))


def parse_chunk_id(value: Column) -> Column:
    """struct(path, n), or null where the text isn't a chunk id; it is cut at the last mark."""
    pattern = r"(?s)^(.*)#chunk\+?([0-9]+)\z"
    n = F.regexp_extract(value, pattern, 2).try_cast("bigint")
    return F.when(n.isNotNull(), F.struct(F.regexp_extract(value, pattern, 1).alias("path"), n.alias("n")))


def formatted(chunk: Column, content: Column) -> Column:
    """What is indexed, hashed and encoded: the chunk id as a comment line, then the content."""
    return F.concat(F.lit("// "), chunk, F.lit("\n"), content)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def code_tokens(text: Column) -> Column:
    """Lower-case tokens: runs of letters and digits, cut where a lower-case letter meets an upper-case one."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Where a word is cut, and words, in any text and in ASCII.
_CUT, _WORD = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})"), regex.compile(r"[\p{L}\p{N}]+")
_ASCII_CUT, _ASCII_WORD = re.compile(r"([A-Z])(?<=[a-z].)"), re.compile("[a-z0-9]+")


def code_words(text: str) -> list[str]:
    """What code_tokens gives, for one text in Python."""
    if text.isascii():
        return _ASCII_WORD.findall(_ASCII_CUT.sub(r" \1", text).lower())
    return _WORD.findall(_CUT.sub(" ", text).lower())


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))
