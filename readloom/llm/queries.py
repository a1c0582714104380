"""The registered queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from readloom.llm import bytebpe, counts, knn, langid, licenses, lines, media, packing, simhash, substrings

QUERIES = {
    "op1_token_counts": counts.op1_token_counts,
    "op2_media": media.op2_media,
    "op3_simhash": simhash.op3_simhash,
    "op4_voronoi_knn": knn.op4_voronoi_knn,
    "op5_packing": packing.op5_packing,
    "op6_langid": langid.op6_langid,
    "op7_byte_bpe": bytebpe.op7_byte_bpe,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_substring_dedup": substrings.op10_substring_dedup,
}

ORACLES = {"op4_voronoi_knn": knn.OP4_SQL, "op8_line_dedup": lines.OP8_SQL, "op9_license_scan": licenses.OP9_SQL}
