"""Joining facts and passages per question into one four-part answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import trim_blank
from sheafline.operators.search import citation

# The layout of an answer and the sentences for missing evidence.
TITLE = "⚡ **Hybrid Synthesis:**"
HEADINGS = ("### 📊 DATA FINDINGS", "### 📄 DOCUMENT EVIDENCE", "### ⚡ AI INTERPRETATION", "### 🔗 CITATIONS")
NO_DATA = "No active structured dataset is available (No active structured dataset found.)."
NO_DATA_WARNING = "No active structured dataset available."
NO_PASSAGE = "No matching document evidence found."
NO_PASSAGE_WARNING = "No matching document passages found."
NO_CITATION = "No document citations available."
BOTH = (
    "Based on the structured dataset, {facts}. According to {source}, the policy/guidelines outline specific "
    "operational requirements. No causal link is asserted between the quantitative metrics and document policies "
    "without explicit supporting evidence."
)
DATA_ONLY = (
    "Structured data findings ({facts}) were successfully calculated from the dataset, but no matching document "
    "evidence was found to provide policy or procedural context."
)
DOCUMENTS_ONLY = (
    "Document evidence was retrieved from {source}, but no active structured dataset was available to "
    "cross-reference quantitative findings."
)
NEITHER = "Neither structured dataset metrics nor document evidence were available to perform hybrid synthesis."
FACTS_IN_SUMMARY = 3


def _fill(pattern: str, **values: Column) -> Column:
    parts: list[Column] = []
    rest = pattern
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}")
        parts += [F.lit(before), value]
    return F.concat(*parts, F.lit(rest))


def _bullets(items: Column, mark: str) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit(mark), item)), "\n")


def synthesize(questions: DataFrame, facts: DataFrame, hits: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row per question with its facts, passages, citations, warnings and answer text.

    ``questions`` has ``question_id``; ``facts`` is ``(question_id, ord, fact)``; ``hits`` is
    ``(question_id, rank, filename, page, text)``; ``findings`` optionally gives the data section
    as ``(question_id, text)``, otherwise the facts are listed. Questions without evidence stay.
    The evidence of one question is bounded by the limits of the operators that found it.
    """
    in_order = F.array_sort(F.collect_list(F.struct("ord", "fact")))
    per_question = facts.groupBy("question_id").agg(F.transform(in_order, lambda f: f["fact"]).alias("data_facts"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "filename", "page", "text")))
    passages = hits.groupBy("question_id").agg(ranked.alias("document_evidence"))
    joined = questions.join(per_question, "question_id", "left").join(passages, "question_id", "left")
    if findings is not None:
        joined = joined.join(findings.select("question_id", F.col("text").alias("_findings")), "question_id", "left")
    else:
        joined = joined.withColumn("_findings", F.lit(None).cast("string"))

    no_facts = F.array().cast("array<string>")
    evidence_type = hits.select(F.array(F.struct("rank", "filename", "page", "text"))).schema.fields[0].dataType
    joined = joined.withColumns({
        "data_facts": F.coalesce("data_facts", no_facts),
        "document_evidence": F.coalesce("document_evidence", F.array().cast(evidence_type.simpleString())),
    })
    evidence = F.col("document_evidence")
    joined = joined.withColumn(
        "citations", F.array_distinct(F.transform(evidence, lambda h: citation(h["filename"], h["page"])))
    )
    has_data, has_passages = F.size("data_facts") > 0, F.size(evidence) > 0
    bare = trim_blank(F.regexp_replace(trim_blank(F.col("_findings")), r"(?i)^📊\s*\**DATA FINDINGS\**\s*", ""))
    has_text = F.coalesce(F.length(bare) > 0, F.lit(False))
    listed = _bullets(F.col("data_facts"), "• ")
    data_section = F.when(has_text, bare).when(has_data, listed).otherwise(NO_DATA)
    passage = F.transform(
        evidence,
        lambda h: F.concat(F.lit("• ["), citation(h["filename"], h["page"]), F.lit("]:\n  "), trim_blank(h["text"])),
    )
    document_section = F.when(has_passages, F.array_join(passage, "\n\n")).otherwise(NO_PASSAGE)
    summary = F.array_join(F.slice("data_facts", 1, FACTS_IN_SUMMARY), "; ")
    source = F.coalesce(F.get("citations", F.lit(0)), F.lit(""))
    interpretation = (
        F.when(has_data & has_passages, _fill(BOTH, facts=summary, source=source))
        .when(has_data, _fill(DATA_ONLY, facts=summary))
        .when(has_passages, _fill(DOCUMENTS_ONLY, source=source))
        .otherwise(NEITHER)
    )
    citation_section = F.when(
        has_passages, F.concat(F.lit("**Sources:**\n"), _bullets(F.col("citations"), "- "))
    ).otherwise(NO_CITATION)
    sections = [data_section, document_section, interpretation, citation_section]
    blocks = [F.concat(F.lit(heading + "\n"), body) for heading, body in zip(HEADINGS, sections)]
    warnings = F.array_compact(F.array(
        F.when(~(has_data | has_text), NO_DATA_WARNING), F.when(~has_passages, NO_PASSAGE_WARNING)
    ))
    return joined.select(
        *questions.columns, "data_facts", "document_evidence", "citations",
        interpretation.alias("interpretation"), warnings.alias("warnings"),
        F.concat_ws("\n\n", F.lit(TITLE), *blocks).alias("answer"),
    )
