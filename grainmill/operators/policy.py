"""Command and payload policies."""

from __future__ import annotations

import re
import shlex
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import strip


def _has_any(token: Column, chars: str) -> Column:
    return F.length(F.translate(token, chars, "")) < F.length(token)


def command_error(language: Column, command: Column) -> Column:
    """The first rule that an argument list breaks, null if it may run."""
    allowed = reduce(lambda a, kv: a.when(language == kv[0], F.array(*map(F.lit, kv[1]))), R.COMMANDS.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    named = reduce(lambda a, kv: a.when(language == kv[0], "[" + ", ".join(f"'{c}'" for c in kv[1]) + "]"), R.COMMANDS.items(), F.when(F.lit(False), ""))
    quoted = lambda t: F.concat(F.lit("'"), t, F.lit("'"))

    def token_error(t: Column) -> Column:
        plain = F.when(t.startswith("-"), t.rlike(r"^[A-Za-z0-9_.@=:-]*$")).otherwise(t.rlike(r"^[A-Za-z0-9_.@-]*$"))
        return (F.when(t.startswith("/"), F.concat(F.lit("Command argument must not be an absolute path (got "), quoted(t), F.lit(")")))
                .when(t.contains(".."), F.concat(F.lit("Command argument must not contain path traversal (got "), quoted(t), F.lit(")")))
                .when(_has_any(t, R.FORBIDDEN_CHARS), F.concat(F.lit("Command argument contains forbidden characters: "), quoted(t)))
                .when(~plain, F.concat(F.lit("Command argument is not a plain safe token for language '"), language, F.lit("': "), quoted(t))))

    errors = F.filter(F.transform(F.slice(command, F.lit(2), F.greatest(F.size(command), F.lit(1))), token_error), lambda e: e.isNotNull())
    first = command[0]
    return (F.when(F.coalesce(F.size(command), F.lit(0)) <= 0, "Command must be a non-empty list of arguments")
            .when(F.exists(command, lambda t: t.isNull() | (F.length(strip(t)) == 0)), "Command arguments must be non-empty strings")
            .when(allowed.isNull(), F.concat(F.lit("Unsupported language: "), language))
            .when(~F.array_contains(allowed, first), F.concat(F.lit("Command "), quoted(first), F.lit(" is not allowed for language "), quoted(language), F.lit(". Allowed: "), named))
            .when(F.size(errors) > 0, errors[0]))


def payload_error(language: Column, files: Column, command: Column) -> Column:
    """What is wrong with the payload of an execution request, null if nothing is."""
    names = F.map_keys(files)
    illegal = F.filter(names, lambda n: n.startswith("/") | F.array_contains(F.split(n, "/"), ".."))
    return (F.when(~F.coalesce(language.isin(*R.LANGUAGES), F.lit(False)), F.concat(F.lit("Unsupported language: "), F.coalesce(language, F.lit("None"))))
            .when(F.coalesce(F.size(files), F.lit(0)) <= 0, "Payload requires a non-empty 'files' object")
            .when(F.exists(names, lambda n: F.length(strip(n)) == 0), "File names must be non-empty strings")
            .when(F.size(illegal) > 0, F.concat(F.lit("Illegal file name: "), illegal[0]))
            .when(F.coalesce(F.size(command), F.lit(0)) <= 0, "Payload requires a non-empty 'command' list"))


def time_limit(requested: Column, default: int = 20, most: int = 120) -> Column:
    """Seconds a run may take; null if what was asked for isn't a positive number."""
    asked = F.coalesce(requested, F.lit(default))
    return F.when(asked >= 1, F.least(asked, F.lit(most)))


def host_limit(seconds: Column, most: int = 120) -> Column:
    """Seconds after which the host ends a run itself."""
    return F.least(seconds + 5, F.lit(most))


_SPECIAL, _WORD = re.compile(r"""["'\\]"""), re.compile(r"[^ \t\r\n]+")


def command_words(command: Column | str) -> Column:
    """The words of a shell line, quotes and escapes resolved; null if a quote or escape is left open."""

    def split(line: str | None) -> list[str] | None:
        try:
            line = line or ""
            return shlex.split(line) if _SPECIAL.search(line) else _WORD.findall(line)
        except ValueError:
            return None

    return F.pandas_udf(lambda lines: lines.map(split), "array<string>")(command)


def first_word(line: str) -> dict:
    """The first word of a shell line, null if there is none, and whether all its quotes and escapes are closed. Other words are
    read and dropped one by one."""
    words = shlex.shlex(line, posix=True)
    words.whitespace_split, words.commenters = True, ""
    try:
        first = next(words, None)
        for _ in words:
            pass
    except ValueError:
        return {"valid": False, "word": None}
    return {"valid": True, "word": first}


def command_name(command: Column) -> tuple[Column, Column]:
    """Whether the quotes and escapes of a shell line are closed, and its first word, null if there is none. Lines without quotes and
    escapes never leave the JVM."""

    def read(lines: pa.Array) -> pa.Array:
        kind = pa.struct([("valid", pa.bool_()), ("word", pa.string())])
        return pa.array((first_word(x.as_py()) if x.is_valid else None for x in lines), kind)

    special = command.rlike(_SPECIAL.pattern)
    read_out = F.arrow_udf(read, "valid boolean, word string")(F.when(special, command))
    plain = F.nullif(F.regexp_extract(command, _WORD.pattern, 0), F.lit(""))
    return ~special | read_out["valid"], F.when(special, read_out["word"]).otherwise(plain)


def inspect_command(command: Column) -> Column:
    """Whether a shell line may run, as a struct (allowed, reason). Its first word decides, as a shell would read it."""

    def decide(valid: Column, word: Column) -> Column:
        first = F.element_at(F.split(word, "/"), -1)
        low = F.lower(command)
        reason = F.when(F.length(strip(command)) == 0, "Empty command").when(~valid, "Invalid shell syntax").when(word.isNull(), "Empty command").when(first.isin(*R.BLOCKED_COMMANDS), F.concat(F.lit("Blocked command: "), first))
        for p in R.BLOCKED_PATTERNS:
            reason = reason.when(low.contains(p), f"Blocked sensitive path/pattern: {p}")
        return reason.otherwise(None)

    reason = decide(*command_name(F.coalesce(command, F.lit(""))))
    return F.struct(reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("Allowed")).alias("reason"))


def confirmation(command: Column) -> Column:
    """Struct (allowed, requires_confirmation, reason): every command that may run at all is to be confirmed."""
    seen = inspect_command(command)
    return F.struct(seen["allowed"].alias("allowed"), seen["allowed"].alias("requires_confirmation"), F.when(seen["allowed"], "Command requires confirmation.").otherwise(seen["reason"]).alias("reason"))


def tool_command(language: Column, command: Column) -> Column:
    """The command of a test run: the one given, else the language's own; an unknown language without one fails the query."""
    own = F.raise_error(F.concat(F.lit("Unsupported language: "), F.coalesce(language, F.lit("None")))).cast("array<string>")
    for name, words in R.TOOL_COMMANDS.items():
        own = F.when(language == name, F.array(*map(F.lit, words))).otherwise(own)
    return F.coalesce(command, own)
