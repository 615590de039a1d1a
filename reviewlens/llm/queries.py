"""The registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from reviewlens.llm import (
    filter_audit,
    hnsw,
    language,
    line_dedup,
    minhash,
    nbest,
    packing,
    periodic_runs,
    secrets,
    sharding,
    toxicity,
    url_trust,
    winnowing,
)
from reviewlens.llm.common import table


def _over_documents(op):
    def query(spark, sf_dir):
        return op(spark, table(spark, sf_dir, "documents"))
    query.__doc__ = op.__doc__
    return query


def op1_hnsw_near_dedup(spark, sf_dir):
    """Links and components of all ``embeddings``."""
    return hnsw.op1(spark, table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    """Toxicity scores of all ``documents``, learnt from ``labels``."""
    return toxicity.op9(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_url_trust(spark, sf_dir):
    """Host, path, rule and verdict of all ``pages``."""
    return url_trust.op13(spark, table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_hnsw_near_dedup": op1_hnsw_near_dedup,
    "op2_winnowing": _over_documents(winnowing.op2),
    "op3_secret_scan": _over_documents(secrets.op3),
    "op4_probminhash": _over_documents(minhash.op4),
    "op5_packing": _over_documents(packing.op5),
    "op6_nbest_pieces": _over_documents(nbest.op6),
    "op7_ring_sharding": _over_documents(sharding.op7),
    "op8_line_dedup": _over_documents(line_dedup.op8),
    "op9_toxicity": op9_toxicity,
    "op10_language": _over_documents(language.op10),
    "op11_filter_audit": filter_audit.op11,
    "op12_periodic_runs": _over_documents(periodic_runs.op12),
    "op13_url_trust": op13_url_trust,
}

ORACLE_SQL = {
    "op3_secret_scan": secrets.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
}
