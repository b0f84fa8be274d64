"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import cooccur, mixing, names, neighbours, packing, pii, sentences, threads
from threadmill.session import cut_lineage
from threadmill.sources.tables import reader


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    t = reader(spark, root)
    return names.variant_pairs(t("contacts"), t("extracted_entities"), t("known_nicknames"))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row an account or spelling with the class of its meaning."""
    t = reader(spark, root)
    return names.variant_classes(t("contacts"), t("extracted_entities"), t("known_nicknames"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.mutual_pairs(reader(spark, root)("messages"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return threads.conversations(reader(spark, root)("messages"))


def _mentions(spark: SparkSession, root: str) -> DataFrame:
    return reader(spark, root)("extracted_entities").where(F.coalesce(F.col("entity_type") != "url", F.lit(True)))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return cooccur.associations(_mentions(spark, root), "message_id", "entity_value").select("value_a", "value_b")


def p6_scores(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of p6_found with counts, lift and conviction."""
    found = cooccur.associations(_mentions(spark, root), "message_id", "entity_value")
    return found.withColumn("lift", F.round("lift", 6)).withColumn("conviction", F.round("conviction", 6))


def _pii(spark: SparkSession, root: str) -> DataFrame:
    t = reader(spark, root)
    return pii.find_pii(t("messages"), t("contacts"), t("extracted_entities"), t("known_nicknames"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    counted = (F.col("field_name") == "text_content") | F.col("pii_kind").isin("email", "phone")
    return _pii(spark, root).where(counted).select("id", "chat_jid", "field_name", "pii_kind", "pii_text").distinct()


def p7_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every row of messages with typed placeholders in its text and push name."""
    return pii.redact(reader(spark, root)("messages"), _pii(spark, root))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(reader(spark, root)("documents"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(reader(spark, root)("documents")))


def p8_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the packing, whatever the documents."""
    documents = reader(spark, root)("documents")
    return packing.packing_faults(cut_lineage(packing.pack_documents(documents)), documents)


def p9_uses(spark: SparkSession, root: str) -> DataFrame:
    t = reader(spark, root)
    return mixing.mixture(t("documents"), t("mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    t = reader(spark, root)
    return mixing.mixture_report(mixing.mixture(t("documents"), t("mix_targets")), t("mix_targets"))


def p9_checks(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of the mixture, whatever the documents."""
    t = reader(spark, root)
    return mixing.mixture_faults(cut_lineage(mixing.mixture(t("documents"), t("mix_targets"))), t("mix_targets"), t("documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(reader(spark, root)("documents"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p6_scores": p6_scores, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_uses": p9_uses, "p9_shares": p9_shares, "p9_checks": p9_checks, "p10_found": p10_found}

_OWNER = threads.OWNER

_PAIRS = """e AS (SELECT DISTINCT message_id AS m, entity_value AS v FROM extracted_entities
  WHERE coalesce(entity_type <> 'url', true) AND message_id IS NOT NULL AND entity_value IS NOT NULL),
n AS (SELECT count(DISTINCT m) AS n FROM e),
c AS (SELECT v, count(*) AS n_v FROM e GROUP BY v),
p AS (SELECT a.v AS value_a, b.v AS value_b, count(*) AS n_ab FROM e a JOIN e b ON a.m = b.m AND a.v < b.v GROUP BY a.v, b.v),
q AS (SELECT value_a, value_b, n_ab, a.n_v AS n_a, b.n_v AS n_b, n.n FROM p JOIN c a ON a.v = value_a JOIN c b ON b.v = value_b CROSS JOIN n
  WHERE n_ab >= 3 AND n_ab * n.n >= 5 * a.n_v * b.n_v)"""

ORACLES = {
    "p5_found": f"""WITH r AS (
  SELECT id, chat_jid, epoch_us(timestamp) AS us, any_value(is_from_me) AS me, any_value(coalesce(is_group, chat_jid LIKE '%@g.us')) AS grp,
         any_value(regexp_replace(sender_jid, ':[0-9]+@', '@')) AS sender,
         any_value(CASE WHEN trim(coalesce(text_content, '')) <> '' THEN 1 ELSE 0 END) AS said
  FROM messages WHERE timestamp IS NOT NULL GROUP BY id, chat_jid, timestamp),
m AS (SELECT id, chat_jid, us, any_value(me) AS me, any_value(grp) AS grp, any_value(sender) AS sender, any_value(said) AS said FROM r GROUP BY id, chat_jid, us),
b AS (SELECT *, trim(coalesce(sender, '')) = '' OR coalesce(me <> (sender = '{_OWNER}'), true)
    OR (NOT grp AND sender <> '{_OWNER}' AND sender <> regexp_replace(chat_jid, ':[0-9]+@', '@')) AS broken FROM m),
f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY chat_jid ORDER BY us, id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM b),
s AS (SELECT *, sum(opens) OVER (PARTITION BY chat_jid ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS session FROM f),
g AS (SELECT chat_jid, session, min(us) AS start_us FROM s GROUP BY chat_jid, session
  HAVING NOT bool_or(broken) AND count(DISTINCT CASE WHEN said = 1 THEN sender END) >= 2)
SELECT s.chat_jid, g.start_us, row_number() OVER (PARTITION BY s.chat_jid, s.session ORDER BY s.us, s.id) AS pos, s.id,
       CASE WHEN s.me THEN 'owner' ELSE 'other' END AS turn_role
FROM s JOIN g ON s.chat_jid = g.chat_jid AND s.session = g.session WHERE s.said = 1""",
    "p6_found": f"WITH {_PAIRS} SELECT value_a, value_b FROM q",
    "p6_scores": f"""WITH {_PAIRS}
SELECT value_a, value_b, n_ab, n_a, n_b, n, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift,
       CASE WHEN n_ab < n_a THEN round((1 - n_b::DOUBLE / n) / (1 - n_ab::DOUBLE / n_a), 6) END AS conviction
FROM q""",
    "p8_checks": "SELECT count(*) FILTER (WHERE length(text) > 0) AS placed, 0::BIGINT AS split_needlessly, 0::BIGINT AS torn, 0::BIGINT AS over_full, true AS tight, 0::BIGINT AS lost FROM documents",
    "p9_checks": "SELECT 0::BIGINT AS twice, 0::BIGINT AS over_cap, 0::BIGINT AS below_none, 0::BIGINT AS lost, true AS shares_met",
}
