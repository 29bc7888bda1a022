"""Text normalisation, hashing and deterministic splits, as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a class of Java patterns; ``\\s`` alone is ASCII there.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_NORMALIZER, _CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"


#: The characters of ``WS`` themselves, and its class without one of them.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WS_NOT_LINE, _WS_NOT_SPACE = WS.replace(r"\t-\r", r"\t\x0b-\r"), WS.replace(r"\x1c-\x20", r"\x1c-\x1f")


def _ascii(x: Column) -> Column:
    return F.octet_length(x) == F.length(x)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def nfc(x: Column) -> Column:
    """Unicode normalisation form C by the ICU library that Spark ships; ASCII texts skip it."""
    return _let(x, lambda v: F.when(_ascii(v), v).otherwise(F.java_method(F.lit(_NORMALIZER), F.lit("compose"), v, F.lit(False))))


def casefold(x: Column) -> Column:
    return _let(x, lambda v: F.when(_ascii(v), F.lower(v)).otherwise(F.java_method(F.lit(_CHARACTERS), F.lit("foldCase"), v, F.lit(True))))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(_BLANKS))


def is_blank(x: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return F.coalesce(~x.rlike(f"[^{WS[1:]}"), F.lit(True))


def normalize_prose(x: Column) -> Column:
    """NFC, white space collapsed and stripped, case folded."""
    return casefold(F.trim(F.regexp_replace(nfc(x), f"{WS}{{2,}}|{_WS_NOT_SPACE}", " ")))


def normalize_code(x: Column) -> Column:
    """NFC, unix line ends, no trailing blanks, at most one blank line in a row, stripped. Case is kept."""
    lines = F.regexp_replace(nfc(F.replace(x, F.lit("\r\n"), F.lit("\n"))), rf"{_WS_NOT_LINE}+(?=\n|\z)", "")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def sha256_mod(x: Column, modulus: int) -> Column:
    """The 256-bit digest of ``x`` as an integer, modulo a small number: a fold over eight 32-bit parts."""
    step = (1 << 32) % modulus

    def fold(digest: Column) -> Column:
        acc = F.lit(0).cast("long")
        for i in range(8):
            acc = (acc * step + F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")) % modulus
        return acc

    return _let(F.sha2(x, 256), fold)


def assign_split(fingerprint: Column, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test by a hash of the fingerprint: the same one never meets itself in another split."""
    bucket = sha256_mod(F.concat(F.lit("split:"), fingerprint), 100)
    return _let(bucket, lambda b: F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test"))


def assign_fold(key: Column, salt: str = "fold-v1", validation: int = 5, test: int = 5) -> Column:
    """validation, test or train by the first 32 bits of a salted hash; to keep the folds of older data, give their salt."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < validation, "validation").when(bucket < validation + test, "test").otherwise("train")


def usage_tokens(x: Column) -> Column:
    """A rough count of tokens: a quarter of the characters, one at least, none for an empty text."""
    n = F.coalesce(F.length(x), F.lit(0))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def cap_output(x: Column, limit: int = 65536) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit)), F.lit("\n... [output truncated]"))).otherwise(x)


def count_hints(lowered: Column, hints: tuple[str, ...]) -> Column:
    """How many of the hints the text contains."""
    total = F.lit(0)
    for h in hints:
        total = total + lowered.contains(h).cast("int")
    return total
