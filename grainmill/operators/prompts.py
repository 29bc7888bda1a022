"""Prompt assembly. The notes are the user's own; the order and headings of the parts are fixed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conversation import detect_category, detect_domain, is_code_task


@dataclass(frozen=True)
class Notes:
    """Texts by domain and by category, reference shapes by domain, and the closing parts of prompts for code and reviews.

    ``domains`` needs a text for ``general``, which unknown domains get.
    """

    domains: Mapping[str, str]
    categories: Mapping[str, str] = field(default_factory=dict)
    shapes: Mapping[str, str] = field(default_factory=dict)
    steps: str = "Think about requirements, edge cases and tests first. Then write the complete code."
    review: str = "List the problems of this code and correct them."


def _looked_up(key: Column, table: Mapping[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for name, text in table.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def prompt_notes(text: Column, notes: Notes, domain: Column | None = None) -> Column:
    """The notes of a request's domain, and those of its category unless it is plain conversation."""
    found = F.coalesce(domain, detect_domain(text)) if domain is not None else detect_domain(text)
    category = detect_category(text)
    own = F.when(category != "general_chat", F.concat(F.lit("CATEGORY NOTES:\n"), _looked_up(category, notes.categories, notes.categories.get("general_chat", ""))))
    return F.concat_ws("\n\n", F.concat(F.lit("DOMAIN NOTES:\n"), _looked_up(found, notes.domains, notes.domains["general"])), own)


def code_notes(text: Column, notes: Notes, domain: Column | None = None) -> Column:
    """``prompt_notes`` with the reference shape of the domain, if there is one."""
    found = F.coalesce(domain, detect_domain(text)) if domain is not None else detect_domain(text)
    shape = F.concat(F.lit("REFERENCE SHAPE (adapt the structure, never the wording):\n"), F.nullif(_looked_up(found, notes.shapes), F.lit("")))
    return F.concat_ws("\n\n", prompt_notes(text, notes, domain), shape)


def code_prompt(task: Column, notes: Notes, language: Column | None = None, context: Column | None = None, domain: Column | None = None) -> Column:
    """A request for code: task, language, context, notes and steps, a blank line between them."""
    part = lambda name, c: F.concat(F.lit(name), F.nullif(c, F.lit("")))
    parts = [F.concat(F.lit("TASK: "), task)]
    parts += [part("LANGUAGE: ", language)] if language is not None else []
    parts += [part("CONTEXT:\n", context)] if context is not None else []
    return F.concat_ws("\n\n", *parts, code_notes(task, notes, domain), F.lit(notes.steps))


def review_prompt(task: Column, code: Column, notes: Notes, language: Column | None = None) -> Column:
    """A request to review a draft."""
    named = F.concat(F.lit("\nLANGUAGE: "), F.nullif(language, F.lit("")), F.lit("\n")) if language is not None else F.lit("")
    return F.concat(F.lit("ORIGINAL REQUEST:\n"), task, F.lit("\n"), F.coalesce(named, F.lit("")), F.lit("\nCODE UNDER REVIEW:\n"), code, F.lit("\n\n" + notes.review))


def wrap_request(query: Column, notes: Notes, least: int = 40) -> Column:
    """Requests for code of ``least`` characters or more become prompts for code; others stay as they are."""
    return F.when(is_code_task(query) & (F.length(query) >= least), code_prompt(query, notes)).otherwise(query)
