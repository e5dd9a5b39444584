"""What SQL can say of operators that it can't express: DuckDB over the queries' results and the tables."""

import duckdb
import pytest
from oracles import connect, oracle_rows, rows_of

from conftest import DATA
from telemill.llm import queries

FOLDER = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{FOLDER}/documents.parquet')")
    base = tmp_path_factory.mktemp("results")
    for name in ("op1_ogg_media", "op5_license_notices", "op6_feistel_sharding", "op8_quality_trees", "op10_min_bin_slack"):
        queries.QUERIES[name](spark, FOLDER).write.parquet(str(base / name))
        c.execute(f"create view {name.split('_')[0]} as select * from read_parquet('{base / name}/*.parquet')")
    return c


def none(c, sql):
    assert c.execute(sql).fetchall() == []


def test_media(results):
    rows = "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n, greatest(1, ceil(coalesce(strlen(text), 0) / 576.0)::BIGINT) * 576 AS padded, encode(coalesce(text, '')) AS raw FROM documents"
    wanted = f"SELECT doc_id, n, padded, sha256(unhex(hex(raw) || repeat('FF', (padded - n)::INT))) AS digest FROM ({rows})"
    got = "SELECT doc_id, n_bytes, payload_bytes, payload_sha256 FROM op1"
    none(results, f"({wanted}) EXCEPT ALL ({got})")
    none(results, f"({got}) EXCEPT ALL ({wanted})")


def test_words_and_base_places(results):
    words = r"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents"
    places = "list_filter(range(1, len(w) + 1), lambda i: (w[i] = 'mit' AND w[i + 1] = 'license') OR (w[i] = 'apache' AND w[i + 1] = 'license') OR (w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'))"
    wanted = f"SELECT doc_id, len(w)::BIGINT AS n, len(p)::BIGINT AS b, list_min(p) - 1 AS a, list_max(p) - 1 AS z FROM (SELECT doc_id, w, {places} AS p FROM ({words}))"
    got = "SELECT doc_id, n_words, n_base, first_word, last_word FROM op5"
    none(results, f"({wanted}) EXCEPT ALL ({got})")
    none(results, f"({got}) EXCEPT ALL ({wanted})")


def test_rows_law(results):
    none(results, "SELECT 1 FROM (SELECT shard, count(*) AS n, min(slot) AS a, max(slot) AS b, count(DISTINCT slot) AS d FROM op6 GROUP BY 1) WHERE a <> 0 OR b <> n - 1 OR d <> n OR shard NOT BETWEEN 0 AND 15")
    none(results, "SELECT 1 FROM (SELECT max(n) - min(n) AS apart, count(*) AS k FROM (SELECT count(*) AS n FROM op6 GROUP BY shard)) WHERE apart > 1 OR k <> 16")
    none(results, "(SELECT doc_id, coalesce(strlen(text), 0) + 1 FROM documents) EXCEPT ALL (SELECT doc_id, size FROM op6)")


def test_sharding_equals_its_oracle(spark):
    name = "op6_feistel_sharding"
    assert rows_of(queries.QUERIES[name](spark, FOLDER)) == oracle_rows(connect(FOLDER), queries.ORACLES[name])


def test_gapless_sequences(results):
    none(results, 'SELECT 1 FROM (SELECT "offset" AS o, coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length) OVER (PARTITION BY sequence_id) AS filled FROM op10) WHERE o <> before OR filled > 2048')
    none(results, "SELECT 1 FROM (SELECT start AS s, coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS k, piece, length FROM op10) WHERE s <> before OR k <> piece OR (piece > 0 AND length <> 2048)")
    (used, least), = results.execute("SELECT count(DISTINCT sequence_id), ceil(sum(length) / 2048.0) FROM op10").fetchall()
    assert used <= least * 1.01 + 1


def test_held_out_rows_and_scores(results):
    none(results, "SELECT 1 FROM op8 WHERE score NOT BETWEEN 0 AND 1 OR predicted <> (score >= 0.7)::INT")
    assert results.execute("SELECT count(*) FROM op8").fetchone() == results.execute("SELECT count(*) FROM documents").fetchone()
