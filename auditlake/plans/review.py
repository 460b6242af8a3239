"""The review of a corpus as one plan: route, label, rules, bias, model findings, fusion, verdict (the shuffles are by document)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import budget
from auditlake.operators import bias, chunk, fuse, label, routing, rules, scores
from auditlake.session import written
from auditlake.sources.packs import rendered


@dataclass
class Review:
    routes: DataFrame
    spans: DataFrame
    findings: DataFrame
    bias: DataFrame
    model: DataFrame
    reports: DataFrame
    items: DataFrame
    verdicts: DataFrame


def review(docs: DataFrame, sections: DataFrame, pack: DataFrame, bias_rx: DataFrame, fingerprints: DataFrame | None = None, answers: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None, formats: dict[str, str] | None = None, fields: dict[str, list[str]] | None = None, reviewer: list | None = None) -> Review:
    """docs(doc_id, text[, method]); sections(doc_id, section_type, content, ord).

    Documents with a green light get no model findings. answers(doc_id, chunk_no, response) are a model's raw answers; without them the deterministic reviewer stands for it. With
    fingerprints, labels are by fingerprint (mode "fingerprint": FIXED text is trusted), else by signs. Sections are written once to the shared folder, since labels, rules, bias patterns and the
    reviewer each read them.
    """
    sections = written(sections, "sections")
    method = F.col("method") if "method" in docs.columns else F.lit("")
    routes = routing.routed(docs.select("doc_id", budget("text").alias("budget"), method.alias("method")))
    by_print = fingerprints is not None
    spans = label.marked_by_fingerprint(sections, fingerprints) if by_print else label.marked(sections)
    findings = rules.run(docs, sections, pack, spans, by_print, synonyms, formats)
    biased = bias.findings(sections, bias_rx, fields)
    deep = routes.where("NOT skip_llm").select("doc_id")
    if answers is not None:
        model = fuse.best_of_similar(fuse.parsed(answers.join(deep, "doc_id", "left_semi"))[0])
    else:
        checked = label.texts(spans) if by_print else None
        model = fuse.reviewed(sections.join(deep, "doc_id", "left_semi"), reviewer, checked)
    items = fuse.risk_items(findings, biased, model)
    only = docs.select("doc_id")
    found = fuse.gathered(findings, biased, model)
    return Review(routes, spans, findings, biased, model, fuse.reports_of(only, found).join(scores.rule_scores(only, findings).withColumnRenamed("total_score", "rule_total"), "doc_id"), items, fuse.verdicts_of(only, found))


def prompts(sections: DataFrame, findings: DataFrame, limit: int = 6000, rate: float = 0.3) -> DataFrame:
    """The prompts for a model: violated sections and a sample of the others, packed up to the limit, with the overlap of the chunk before."""
    chosen = chunk.selected(sections, chunk.violated_sections(findings, sections), rate)
    return chunk.with_overlap(chunk.packed(chosen, limit), limit)


def clause_prompts(findings: DataFrame, template: str) -> DataFrame:
    """CLS-1 up to the model: for each finding the template with {rule_id}, {description}, {text} and {suggestion} filled in."""
    own = findings.select("doc_id", "rule_seq", "rule_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("description", "text", "suggestion")))
    return own.withColumn("prompt", rendered(F.lit(template), {c: F.col(c) for c in ("rule_id", "description", "text", "suggestion")}))
