"""The registered queries of this subpackage."""

from candela.llm import centroids, decontaminate, filter_audit, lm, ngram_join, quality, segment, sharding, simhash, suffix, topk, url_filter, warc

MODULES = [topk, suffix, lm, warc, url_filter, decontaminate, sharding, quality, simhash, segment, ngram_join, filter_audit, centroids]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
