"""Relational operators of retrieval: live rows, top-k search, full text, fusion and reranking."""
