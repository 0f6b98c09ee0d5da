"""Text operators for training-data pipelines; their queries are QUERIES, their SQL counterparts ORACLES."""

from barloom.llm import decontaminate, filter_audit, langid, licenses, line_chunks, link_graph, merkle, mixing, packing, simhash_tiles, source_divergence, token_counts, warc_archive

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (decontaminate, filter_audit, langid, licenses, line_chunks, link_graph, merkle, mixing, packing, simhash_tiles, source_divergence, token_counts, warc_archive):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

__all__ = ["ORACLES", "QUERIES"]
