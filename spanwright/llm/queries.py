"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, fingerprint, host_rules, html_main, ivf_pq, jaccard_join, licence_scan, packing, pfair_mix, site_quality, token_align, turn_reassembly, warc

QUERIES = {
    "op1_pfair_mix": pfair_mix.op1_pfair_mix,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_site_quality": site_quality.op3_site_quality,
    "op4_ivf_pq": ivf_pq.op4_ivf_pq,
    "op5_host_rules": host_rules.op5_host_rules,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_nnls_packing": packing.op7_nnls_packing,
    "op8_site_template": html_main.op8_site_template,
    "op9_licence_scan": licence_scan.op9_licence_scan,
    "op10_prefix_join": jaccard_join.op10_prefix_join,
    "op11_token_align": token_align.op11_token_align,
    "op12_turn_reassembly": turn_reassembly.op12_turn_reassembly,
    "op13_improbable_digest": fingerprint.op13_improbable_digest,
}

ORACLE_SQL = {
    "op5_host_rules": host_rules.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
}
