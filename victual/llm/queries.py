"""The operators' registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, classifier, licences, lines, minhash, mixing, packing, periodic, rules, simhash, tries, urls, warc

QUERIES = {
    f.__name__: f
    for f in (
        classifier.op1_quality_classifier,
        warc.op2_warc_revisits,
        lines.op3_line_dedup,
        ann.op4_one_bit_neighbours,
        rules.op5_quality_rules,
        urls.op6_url_filters,
        licences.op7_license_scan,
        simhash.op8_simhash_near_duplicates,
        packing.op9_best_fit_packing,
        mixing.op10_mix_sources,
        periodic.op11_periodic_runs,
        tries.op12_conversation_trie,
        minhash.op13_minhash_near_duplicates,
    )
}
ORACLE_SQL = {
    "op2_warc_revisits": warc.OP2_SQL,
    "op5_quality_rules": rules.OP5_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op7_license_scan": licences.OP7_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_conversation_trie": tries.OP12_SQL,
}
