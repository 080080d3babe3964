"""The pN_ queries and their SQL, gathered from the modules of this package."""

from quernstone.llm import p1_splitting, p2_fusion, p3_minhash, p4_neighbours, p5_quality, p6_scans, p7_packing, p8_leakage, p9_encoding

MODULES = (p1_splitting, p2_fusion, p3_minhash, p4_neighbours, p5_quality, p6_scans, p7_packing, p8_leakage, p9_encoding)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLES
    return out
