"""The operators in SQL (2.14): functions and table functions of a session.

    register(spark, rules)
    spark.sql("SELECT d.doc_id, m.* FROM documents d, LATERAL inline(audit_matches(d.text)) m")
    spark.sql("SELECT d.doc_id, l.* FROM documents d, LATERAL audit_lines(d.text) l")
    spark.sql("SELECT * FROM audit_match_rows(TABLE(SELECT doc_id, text FROM documents))")

Scalar functions and audit_lines are SQL themselves, so Spark optimises through them. Matches of a pack come from the automaton over Arrow batches, once as a scalar function, which LATERAL can use, and once as
an Arrow table function over a whole table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.scan import Scanner
from auditlake.session import ship
from auditlake.sources.packs import quoted

#: name, arguments, result, expression: the functions of functions.text of the same meaning
SCALARS = [
    ("audit_normalized", "t STRING", "STRING", r"translate(regexp_replace(t, '(?U)\\s+', ''), '（）【】：，。；！？—–', '()[]:,.;!?--')"),
    ("audit_text_hash", "t STRING", "STRING", "substring(sha2(audit_normalized(t), 256), 1, 16)"),
    ("audit_line_of", "t STRING, start INT", "INT", r"regexp_count(left(t, start), '\n') + 1"),
    ("audit_risk_level", "score DOUBLE", "STRING", "CASE WHEN score >= 85 THEN 'pass' WHEN score >= 60 THEN 'medium' WHEN score >= 40 THEN 'high' ELSE 'critical' END"),
    ("audit_tokens", "t STRING", "BIGINT", "CAST(ceil(length(t) * 2.0D) AS BIGINT)"),
    ("audit_rule_id", "prefix STRING, t STRING", "STRING", "concat(prefix, upper(left(md5(t), 8)))"),
]
TABLES = [("audit_lines", "t STRING", "line_no INT, line STRING", r"SELECT pos, col FROM posexplode(split(t, '\n'))")]
MATCH = "rule_seq int, rule_id string, start int, matched string"


class PackMatches:
    """Matches of a pack's forbidden patterns in a text: one pass of the automaton, then the patterns of which a literal stands in it, whatever their case. A null text has none."""

    def __init__(self, patterns: list[tuple[int, str, str]]):
        self.scanner = Scanner([], [(k, rx) for k, _, rx in patterns])
        self.of = {k: (name, re.compile(f"(?i){rx}")) for k, name, rx in patterns}

    def __call__(self, text: str | None) -> list[tuple[int, str, int, str]]:
        return [(k, self.of[k][0], m.start(), m.group()) for k in self.scanner(text, None)["maybe"] for m in self.of[k][1].finditer(text or "")]


def _scalar(matches: PackMatches):
    kind = pa.list_(pa.struct([("rule_seq", pa.int32()), ("rule_id", pa.string()), ("start", pa.int32()), ("matched", pa.string())]))

    @F.arrow_udf(f"array<struct<{MATCH}>>")
    def audit_matches(text: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("rule_seq", "rule_id", "start", "matched"), m, strict=True)) for m in matches(t)] for t in text.to_pylist()], kind)

    return audit_matches


def _table(matches: PackMatches):
    @F.arrow_udtf(returnType=f"id bigint, {MATCH}")
    class AuditMatchRows:
        """TABLE(id, text) -> a row for each match."""

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(t)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.table({n: pa.array(c, k) for n, c, k in zip(("id", "rule_seq", "rule_id", "start", "matched"), cols, kinds, strict=True)})

    return AuditMatchRows


def register(spark: SparkSession, rules: DataFrame | None = None) -> list[str]:
    """Registers the functions for this session; with a pack also those of its forbidden rules. Their names. A pattern that Python's dialect does not have is an error."""
    for name, args, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    for name, args, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({result}) RETURN {body}")
    names = [x[0] for x in SCALARS + TABLES]
    if rules is not None:
        ship(spark)
        own = rules.where("type = 'forbidden'").select("rule_seq", "rule_id", F.coalesce("pattern", quoted("target")).alias("rx")).collect()  # a pack
        matches = PackMatches([(r.rule_seq, r.rule_id, r.rx) for r in own])
        spark.udf.register("audit_matches", _scalar(matches))
        spark.udtf.register("audit_match_rows", _table(matches))
        names += ["audit_matches", "audit_match_rows"]
    return names
