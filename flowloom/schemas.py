"""Schemas and fixed label values shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "STRUCT<sentence_idx: INT, token_idx: INT, tokens: ARRAY<STRING>, entity_type: STRING>"
SENTENCES = "doc_id STRING, sentence_idx INT, sample_id BIGINT, tokens ARRAY<STRING>, ner_tags ARRAY<STRING>"
TOKENS = "doc_id STRING, sentence_idx INT, token_idx INT, token STRING, ner_tag STRING"
RELATIONS = f"doc_id STRING, rel_type STRING, flow_ord INT, source {ENTITY}, target {ENTITY}"
ACTIVITY_RELATIONS = f"doc_id STRING, a1 {ENTITY}, a2 {ENTITY}, relation_type STRING, comment STRING"
LEXICON = "lex_set STRING, gateway_type STRING, phrase STRING, source STRING, keep STRING"

# Entity types, relation types and class numbers of the annotation scheme.
ACTIVITY, XOR, AND, CONDITION, DOC_START = "Activity", "XOR Gateway", "AND Gateway", "Condition Specification", "Document Start"
GATEWAYS = (XOR, AND)
FLOW, SAME_GATEWAY = "flow", "same gateway"
DIRECTLY, EVENTUALLY, EXCLUSIVE, CONCURRENT = "directly_following", "eventually_following", "exclusive", "concurrent"
RELATION_LABELS = (DIRECTLY, EVENTUALLY, EXCLUSIVE, CONCURRENT)
# classes of tokens: 0 is padding, 1 everything else
TOKEN_CLASSES = {"XOR Gateway": 2, "AND Gateway": 3, "Activity": 4, "Activity Data": 5, "Actor": 6, "Further Specification": 7, "Condition Specification": 8}


def entity(sentence_idx, token_idx, tokens, entity_type) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(sentence_idx).cast("int").alias("sentence_idx"),
        lit(token_idx).cast("int").alias("token_idx"),
        lit(tokens).alias("tokens"),
        lit(entity_type).alias("entity_type"),
    )


def position(e) -> Column:
    """What orders entities in a text: never compare rows, compare this."""
    e = F.col(e) if isinstance(e, str) else e
    return F.struct(e["sentence_idx"].alias("s"), e["token_idx"].alias("t"))


def at(e) -> Column:
    """``sentence:token`` of an entity, null for none."""
    e = F.col(e) if isinstance(e, str) else e
    return F.when(e.isNotNull(), F.concat(e["sentence_idx"].cast("string"), F.lit(":"), e["token_idx"].cast("string")))
