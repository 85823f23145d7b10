"""Queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

from . import extendible, fingerprints, fixity, infill, mixing, packing, setsketch, spelling, suffixes, toxicity, urls, vectors, windows


def queries() -> dict:
    return {
        "op1_warc_fixity": fixity.op1_warc_fixity,
        "op2_metric_range_join": vectors.op2_metric_range_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_url_filter": urls.op4_url_filter,
        "op5_suffix_levels": suffixes.op5_suffix_levels,
        "op6_packing": packing.op6_packing,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_setsketch": setsketch.op8_setsketch,
        "op9_sharding": extendible.op9_sharding,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_window_repeats": windows.op11_window_repeats,
        "op12_spelling_forms": spelling.op12_spelling_forms,
        "op13_fill_in_middle": infill.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": fixity.OP1_SQL, "op2_metric_range_join": vectors.OP2_SQL, "op9_sharding": extendible.OP9_SQL, "op11_window_repeats": windows.OP11_SQL, "op13_fill_in_middle": infill.OP13_SQL}
