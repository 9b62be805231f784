"""Model calls as plug-ins, each with a deterministic default that needs no weights.

A text generator gets a batch of prompts and gives as many replies; `generate` applies it in Arrow batches, so a real
one can hold a connection per task. Templates render strictly: a missing or an unknown field is an error.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackroom.session import ship


class TextGenerator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: Column) -> Column: ...


class Reranker(Protocol):
    def __call__(self, hits: DataFrame, query: str) -> DataFrame: ...


def leading_sentences(prompts: list[str], most: int = 2) -> list[str]:
    """Stand-in for a summarizer: the first sentences of a prompt, and its longest words as themes."""
    out = []
    for p in prompts:
        words = sorted(set(re.findall(r"[^\W\d_]{5,}", p)), key=lambda w: (-len(w), w))[:5]
        out.append(f"SUMMARY: {' '.join(re.split(r'(?<=[.?!])\s+', p.strip())[:most])}\nTHEMES: {', '.join(words)}")
    return out


@dataclass(frozen=True)
class Template:
    name: str
    system: str
    user: str
    parser: str = "plain"
    params: dict = field(default_factory=dict)

    def render(self, **values: str) -> tuple[str, str]:
        wanted = {n for text in (self.system, self.user) for _, n, _, _ in string.Formatter().parse(text) if n}
        if wanted != set(values):
            raise KeyError(f"{self.name}: fields {sorted(wanted ^ set(values))} are missing or unknown")
        return self.system.format(**values), self.user.format(**values)


class Templates:
    """A template of a type first, then the plain one, else an error."""

    def __init__(self, *templates: Template):
        self.known = {t.name: t for t in templates}

    def get(self, name: str, kind: str | None = None) -> Template:
        for key in (f"{name}.{kind}", name):
            if key in self.known:
                return self.known[key]
        raise KeyError(f"no template {name}")


    def column(self, name: str, kind: Column, **values: Column) -> Column:
        """The user part of a template for each row: that of the row's kind if there is one, else the plain one."""
        known = [self.known[n] for n in sorted(self.known) if n == name or n.startswith(f"{name}.")]
        if not known:
            raise KeyError(f"no template {name}")
        out = rendered(self.known[name], values) if name in self.known else F.raise_error(F.concat(F.lit(f"no template {name} for "), kind))
        for t in known:
            if t.name != name:
                out = F.when(kind == t.name[len(name) + 1 :], rendered(t, values)).otherwise(out)
        return out


def rendered(template: Template, values: dict[str, Column]) -> Column:
    """The user part with columns in its fields; a missing or an unknown field is an error before anything runs."""
    parts = list(string.Formatter().parse(template.user))
    wanted = {n for text in (template.system, template.user) for _, n, _, _ in string.Formatter().parse(text) if n}
    if wanted != set(values):
        raise KeyError(f"{template.name}: fields {sorted(wanted ^ set(values))} are missing or unknown")
    return F.concat(*(c for text, name, _, _ in parts for c in ([F.lit(text)] if text else []) + ([F.coalesce(values[name].cast("string"), F.lit(""))] if name else [])))


TEMPLATES = Templates(
    Template("section_summary", "You summarize a section of a book for library readers.", "Book: {title}\n\n{text}", "labels"),
    Template("section_summary.policy", "You summarize a section of a regulation.", "Regulation: {title}\n\n{text}"),
    Template("answer", "Answer from the passages only and name their pages.", "{context}\n\nQuestion: {question}"),
)


def generate(rows: DataFrame, prompt: str, out: str, call: TextGenerator = leading_sentences, batch: int = 16) -> DataFrame:
    """rows with a reply for each prompt; null prompts have none. A failing batch raises, so its task runs again."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            some = [p for p in s if p is not None]
            replies = iter([r for i in range(0, len(some), batch) for r in call(some[i : i + batch])])
            yield pd.Series([None if p is None else next(replies) for p in s])

    return rows.withColumn(out, run(F.col(prompt)))


def resume(rows: DataFrame, key: str, prompt: str, out: str, call: TextGenerator = leading_sentences) -> DataFrame:
    """Only rows whose out column is empty are sent; the others stay as they are."""
    todo = F.when(F.coalesce(F.col(out), F.lit("")) == "", F.col(prompt))
    sent = generate(rows.withColumn("_prompt", todo), "_prompt", "_reply", call)
    return sent.withColumn(out, F.coalesce(F.nullif(out, F.lit("")), "_reply")).drop("_prompt", "_reply")
