"""Registered queries of the corpus audit, made of those of its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, corpus_audit, ledger
from ..shared import written
from ..sources import fixtures as fx
from . import authoring, knowledge, projections, verification  # noqa: F401  (their SQL is used)
from .registry import DURATION, SQL, query, state

#: Bindings by account: a balance below zero cannot be read, by thousands it has so many of three ids.
STATE = "CASE WHEN c_acctbal < 0 THEN 'unreadable' WHEN CAST(floor(c_acctbal / 1000) AS BIGINT) % 4 IN (1, 2) THEN 'incomplete' WHEN CAST(floor(c_acctbal / 1000) AS BIGINT) % 4 = 3 THEN 'bound' WHEN c_mktsegment = 'BUILDING' THEN 'draft' ELSE 'legacy' END"


def parts(spark, d):
    """Graded checkpoints and their issues, written once, as three counts read them."""
    graded, visual = verification.evidence(spark, d)
    graded, visual = written(graded, "graded"), written(visual, "visual")
    wrong = written(audit.issues(graded, visual), "issues")
    return graded, wrong, audit.audit(graded, wrong, DURATION), ledger.readiness(state(spark, d), DURATION)


WS = "SELECT DISTINCT user_id % 20 AS ws FROM events"
AUDIT = f"""SELECT 'workspaces' AS metric, '' AS key, count(*)::BIGINT AS n FROM ({WS}) a
UNION ALL SELECT 'terminal', '', coalesce(sum(terminal_count), 0)::BIGINT FROM ({SQL['verification_audit']}) a UNION ALL SELECT 'supported', '', coalesce(sum(supported_count), 0)::BIGINT FROM ({SQL['verification_audit']}) a
UNION ALL SELECT 'issue', code, count(*) FROM ({SQL['verification_issues']}) a GROUP BY code
UNION ALL SELECT 'readiness', coalesce(readiness, 'cover_gaps'), count(*) FROM ({WS}) w LEFT JOIN ({SQL['readiness']}) a USING (ws) GROUP BY 2
UNION ALL SELECT 'declared', declared, count(*) FROM ({SQL['evidence_levels']}) a GROUP BY 2 UNION ALL SELECT 'grounded', grounded, count(*) FROM ({SQL['evidence_levels']}) a GROUP BY 2
UNION ALL SELECT 'binding', {STATE}, count(*) FROM customer GROUP BY 2
UNION ALL SELECT 'relation_candidates', '', count(*) FROM ({SQL['relation_candidates']}) a
UNION ALL SELECT 'image_workspaces', '', count(*) FROM ({SQL['published_index']}) a WHERE catalog > 0 OR indexed > 0 UNION ALL SELECT 'image_mismatches', '', count(*) FROM ({SQL['published_index']}) a WHERE (catalog > 0 OR indexed > 0) AND stale
UNION ALL SELECT 'image_catalog', '', coalesce(sum(catalog), 0)::BIGINT FROM ({SQL['published_index']}) a UNION ALL SELECT 'image_indexed', '', coalesce(sum(indexed), 0)::BIGINT FROM ({SQL['published_index']}) a"""


@query("corpus_audit", AUDIT)
def corpus_audit_(spark, d):
    """Totals, with the customers' accounts as bindings and the suppliers' parts as images."""
    graded, wrong, audits, ready = parts(spark, d)
    every = fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws")).distinct()
    c = fx.table(spark, d, "customer")
    n = F.floor(F.col("c_acctbal") / 1000)
    bound = c.select((F.col("c_acctbal") >= 0).alias("readable"), (n % 4).alias("ids"), F.lit(3).alias("wanted"), (F.col("c_mktsegment") == "BUILDING").alias("draft"))
    return corpus_audit.corpus_audit(every, audits, wrong, graded, ready, audit.binding(bound), knowledge.relation_candidates(spark, d), projections.published_index(spark, d))


@query("audit_rows", f"""WITH c AS (SELECT ws, string_agg(code || '=' || n, ',' ORDER BY code) AS issue_counts FROM (SELECT ws, code, count(*) AS n FROM ({SQL['verification_issues']}) a GROUP BY ws, code) b GROUP BY ws)
SELECT w.ws, coalesce(readiness, 'cover_gaps') AS readiness, coalesce(terminal_count, 0) AS terminal_count, coalesce(supported_count, 0) AS supported_count, coalesce(supported_ratio, 0) AS supported_ratio, coalesce(issue_counts, '') AS issue_counts
FROM ({WS}) w LEFT JOIN ({SQL['readiness']}) r USING (ws) LEFT JOIN ({SQL['verification_audit']}) v USING (ws) LEFT JOIN c USING (ws)""")
def audit_rows(spark, d):
    """A row for each workspace."""
    _, wrong, audits, ready = parts(spark, d)
    return corpus_audit.workspace_rows(fx.table(spark, d, "events").select((F.col("user_id") % 20).alias("ws")), audits, wrong, ready)


@query("shown_relations", f"WITH r AS ({SQL['relation_candidates']}) SELECT ws, id, labels, (SELECT count(*) FROM r) AS total, row_number() OVER (ORDER BY ws, id) AS place FROM r QUALIFY place <= 20")
def shown_relations(spark, d):
    """The first twenty candidates of the corpus, and how many there are."""
    return corpus_audit.shown(knowledge.relation_candidates(spark, d), ["ws", "id"])
