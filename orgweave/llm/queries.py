"""Queries and SQL of the operators tagged llm."""

from __future__ import annotations

from orgweave.llm import p1_groups, p2_linkage, p3_encoding, p5_pages, p6_names, p8_p9_tokens, p10_spam

QUERIES = {
    "p1_found": p1_groups.p1_found,
    **p2_linkage.QUERIES,
    **p3_encoding.QUERIES,
    "p5_found": p5_pages.p5_found,
    "p5_bodies": p5_pages.p5_bodies,
    **p6_names.QUERIES,
    "p8_ids": p8_p9_tokens.p8_ids,
    "p9_packed": p8_p9_tokens.p9_packed,
    "p9_fill": p8_p9_tokens.p9_fill,
    **p10_spam.QUERIES,
}
ORACLE = {"p1_found": p1_groups.P1_SQL}
