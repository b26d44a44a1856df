"""The registered queries themselves: their SQL in DuckDB, and what their contracts say of every row."""

import json
import os
from collections import Counter

import duckdb
import pytest

from kbspark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
COLUMNS = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op3_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op5_jaccard_join": {"doc_id", "class_id", "n_links"},
    "op6_pack_sequences": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_quality": {"doc_id", "held_out", "score", "predicted"},
    "op8_pii_surrogates": {"doc_id", "text"},
    "op9_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op10_pitman_yor": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12_minmax_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op13_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else json.dumps(v, default=str)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows, con = df.collect(), duckdb.connect()
    assert COLUMNS[name] <= set(df.columns)
    for t in ("documents", "labels", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ids = Counter(r[0] for r in con.execute("select doc_id from documents").fetchall())
    if name == "op6_pack_sequences":
        assert Counter(r.doc_id for r in rows if r.piece == 0) == ids
    elif name == "op13_conversation_repair":
        assert Counter(r.conv_id for r in rows) == Counter(r[0] for r in con.execute("select distinct conv_id from conversations").fetchall())
    elif name != "op11_hard_negatives":
        assert Counter(r.doc_id for r in rows) == ids
    if sql := queries.oracle_sql().get(name):
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert Counter(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
    if name == "op7_quality":
        good = dict(con.execute("select doc_id, quality from labels where quality is not null").fetchall())
        held = [r for r in rows if r.held_out and r.doc_id in good]
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows) and sum((r.score >= 0.5) == good[r.doc_id] for r in held) >= 0.8 * len(held)
