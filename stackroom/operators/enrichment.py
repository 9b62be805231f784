"""What a paper's extraction still needs from a model, what of it is kept, and how much it covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters under which a text is too short for patterns, counts of references to trust, tables and figures kept. Fixed values.
SHORT_TEXT, FEWEST_REFERENCES, MOST_REFERENCES, MOST_TABLES, MOST_FIGURES, SEED = 200, 3, 50, 10, 8, 800
#: Types that a plot is written for. Fixed values.
PLOT_TYPES = ("book", "literature", "policy")


def _n(c: str | Column) -> Column:
    return F.greatest(F.size(F.col(c) if isinstance(c, str) else c), F.lit(0))


def planned(found: DataFrame) -> DataFrame:
    """found (text, abstract, keywords, contents, references, tables, figures) with what patterns gave, bounded, and
    ask_keywords, ask_references and seed: a text that is too short trusts no pattern and asks for keywords only."""
    short = F.length(F.coalesce("text", F.lit(""))) < SHORT_TEXT
    emptied = {c: F.when(~short, F.col(c)) for c in ("abstract", "keywords")}
    emptied |= {c: F.when(short, F.array().cast(found.schema[c].dataType)).otherwise(F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType))) for c in ("contents", "references")}
    kept = {"tables": F.slice("tables", 1, MOST_TABLES), "figures": F.slice("figures", 1, MOST_FIGURES)}
    rows = found.withColumns(emptied | kept)
    references = _n("references")
    return rows.withColumns({
        "ask_keywords": _n("keywords") == 0,
        "ask_references": ~short & ((references < FEWEST_REFERENCES) | (references > MOST_REFERENCES)),
        "seed": F.coalesce(F.nullif("abstract", F.lit("")), F.substring("text", 1, SEED)),
    })


def completed(plan: DataFrame, asked_keywords: Column, asked_references: Column) -> DataFrame:
    """A plan with a model's keywords and references where they were asked for; without an answer, keywords are empty
    and references stay what the patterns gave."""
    none = F.array().cast("array<string>")
    return plan.withColumns({"keywords": F.when(F.col("ask_keywords"), F.coalesce(asked_keywords, none)).otherwise(F.col("keywords")), "references": F.when(F.col("ask_references"), F.coalesce(asked_references, F.col("references"))).otherwise(F.col("references"))})


def coverage(found: DataFrame, key: str) -> DataFrame:
    """key and what an extraction holds: has_abstract and the sizes of its lists."""
    lists = {"n_keywords": "keywords", "n_references": "references", "n_tables": "tables", "n_figures": "figures", "n_toc": "contents"}
    return found.select(key, (F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"), *(_n(c).alias(n) for n, c in lists.items()))


def backfill_targets(books: DataFrame, field: str = "plot", kinds: tuple[str, ...] = PLOT_TYPES, force: bool = False) -> DataFrame:
    """Embedded books of some types whose extra map lacks a field; with force, those that have it too."""
    rows = books.filter(F.col("embedded") & F.col("doc_type").isin(*kinds))
    return rows if force else rows.filter(F.get(F.map_values(F.map_filter(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda k, v: (k == field) & v.isNotNull())), F.lit(0)).isNull())


def backfilled(targets: DataFrame, summaries: Column, reply: Column, error: Column, field: str = "plot") -> DataFrame:
    """targets with an outcome and the new extra map: skipped without a summary or with an empty reply, failed with an
    error, else done."""
    usable = _n(F.filter(summaries, lambda s: F.coalesce(s, F.lit("")) != ""))
    outcome = F.when(usable == 0, "skipped").when(error.isNotNull(), "failed").when(F.coalesce(reply, F.lit("")) == "", "skipped").otherwise("done")
    extra = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
    added = F.map_concat(F.map_filter(extra, lambda k, v: k != field), F.create_map(F.lit(field), reply))
    return targets.withColumn("outcome", outcome).withColumn("extra", F.when(F.col("outcome") == "done", added).otherwise(extra))


def outcomes(rows: DataFrame) -> DataFrame:
    """One row: done, skipped, failed."""
    return rows.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("done", "skipped", "failed")))
