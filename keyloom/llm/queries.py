"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from keyloom.llm import decontaminate, langid, licenses, lines, packing, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_benchmark_decontamination": decontaminate.query,
    "op3_warc_zstd": warc.query,
    "op4_pii_surrogates": pii.query,
    "op5_license_scan": licenses.query,
    "op6_toxicity": toxicity.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_language_id": langid.query,
    "op9_quality_rules": quality.query,
    "op10_fuzzy_line_dedup": lines.query,
}

#: Archives are a round trip, so SQL can say what must come out of them.
ORACLE_SQL: dict[str, str] = {
    "op3_warc_zstd": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        s as (select page_id, strlen(h)::bigint as n, sha1(h) as d from p),
        f as (select *, min(page_id) over (partition by d) as first from s),
        g as (select *, list_transform(range(8), lambda i: ('0x' || substr(d, (5 * i + 1)::int, 5))::bigint) as v from f)
        select page_id, n as payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[(k // 4 + 1)::int] >> (15 - 5 * (k % 4))::bigint) & 31)::int + 1, 1)), '') as payload_digest,
            case when page_id > first then 'revisit' else 'response' end as record_type,
            case when page_id > first then first end as refers_to
        from g
    """,
}
