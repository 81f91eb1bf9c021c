"""Named corpus queries, with SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, centroids, decontam, divergence, licenses, lm, mixing, quality, sharding, simhash, tokenstore, urlrep, warc
from .common import table

QUERIES = {
    "op1_quality": lambda spark, d: quality.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_lm": lambda spark, d: lm.digest(table(spark, d, "documents")),
    "op3_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
    "op4_url_filter": lambda spark, d: urlrep.judge(table(spark, d, "pages"), table(spark, d, "labels")),
    "op5_ann": lambda spark, d: ann.digest(table(spark, d, "embeddings")),
    "op6_simhash": lambda spark, d: simhash.digest(table(spark, d, "documents")),
    "op7_token_store": lambda spark, d: tokenstore.digest(table(spark, d, "documents")),
    "op8_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
    "op9_warc": lambda spark, d: warc.digest(table(spark, d, "pages")),
    "op10_decontamination": lambda spark, d: decontam.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_divergence": lambda spark, d: divergence.digest(table(spark, d, "documents")),
    "op12_centroids": lambda spark, d: centroids.digest(table(spark, d, "embeddings")),
    "op13_licenses": lambda spark, d: licenses.digest(table(spark, d, "documents")),
}
ORACLES = {
    "op4_url_filter": urlrep.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_decontamination": decontam.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_licenses": licenses.ORACLE,
}
