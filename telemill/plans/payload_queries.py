"""Payload cells: formats, items and batches, on documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemill.functions import distributions, payload
from telemill.functions.nulls import PAYLOAD_TOKENS, is_blank
from telemill.operators import merge
from telemill.sources import blobs

from .catalog import query, table


@query(
    "B5 B7 E19 U5",
    "WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS a FROM conversations GROUP BY 1) SELECT conv_id::VARCHAR AS parent_id, conv_id::VARCHAR || '_' || (i - 1)::VARCHAR AS sub_id, (i - 1)::BIGINT AS batch_index, len(a)::BIGINT AS batch_size, len(a) > 1 AS is_batch_job, a[i]::VARCHAR AS item FROM c, unnest(range(1, len(a) + 1)) AS r(i)",
)
def batch_expand(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string"))).alias("circuit"))
    out = payload.expand_batches(c, "conv_id", {"circuit": payload.items(F.col("circuit"))})
    return out.select("parent_id", "sub_id", F.col("batch_index").cast("long").alias("batch_index"), F.col("batch_size").cast("long").alias("batch_size"), "is_batch_job", F.col("circuit").alias("item"))


@query(
    "B7 F9 B6 B8",
    "WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1) SELECT conv_id, (n > 1 AND u > 1 AND n <> u) AS mismatch, greatest(n, u, 1)::BIGINT AS batch_size FROM c",
)
def batch_mismatch_flag(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.to_json(F.collect_list(F.lit("x"))).alias("circuit"),
        F.to_json(F.collect_list(F.when(F.col("role") == "user", F.create_map(F.lit("00"), F.lit(1))))).alias("result"),
    )
    out = payload.expand_batches(c, "conv_id", {"circuit": payload.items(F.col("circuit")), "result": payload.count_items(F.col("result"))})
    return out.where("batch_index = 0").select("conv_id", F.col("batch_mismatch").alias("mismatch"), F.col("batch_size").cast("long").alias("batch_size"))


#: A cell of each format, and its name.
_CELLS = (
    ("   ", "empty"), ('["a", "b"]', "json_list"), ("['a', 'b']", "py_list"), ("[a; b]", "bracketed_unknown"), ('{"qasm": "x"}', "json_dict"), ("{'qasm': 'x'}", "py_dict"), ("{qasm}", "braced_unknown"),
    ("gASVBAAAAAAAAA", "b64_pickle_like"), ("OPENQASM 3.0; qubit q;", "qasm3_direct"), ("OPENQASM 2.0; qreg q[1];", "qasm2_direct"), ("qubit[2] q;", "qasm3_like"), ("qreg q[2];", "qasm2_like"), ("plain words", "other_string"),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "Q1 Q2 B10 F19",
    "SELECT c.format, count(*) AS n FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{name}')" for k, (_, name) in enumerate(_CELLS)) + ") AS c(k, format) ON doc_id % 13 = k GROUP BY 1 UNION ALL SELECT 'json_dict of events', count(*) FROM events",
)
def format_detect(spark, sf_dir):
    """A cell of each of the 13 formats for each document, and the events' own."""
    text = F.get(F.array(*[F.lit(t) for t, _ in _CELLS]), (F.col("doc_id") % 13).cast("int"))
    docs = table(spark, sf_dir, "documents").select(payload.detect_format(text).alias("format"))
    events = table(spark, sf_dir, "events").select(F.concat(payload.detect_format(F.col("props")), F.lit(" of events")).alias("format"))
    return docs.unionByName(events).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


#: A message of each category; then one that isn't known and one that is empty.
_MESSAGES = (
    ("empty circuit text", "empty_text"), ("list payload found", "unexpected_list_payload"), ("batch mismatch in row", "row_batch_mismatch"), ("parse error: qasm2: bad token", "qasm2_parse_error"), ("parse error: qasm3: bad token", "qasm3_parse_error"),
    ("cannot parse", "parse_error"), ("dag could not be built", "dag_build_error"), ("something else", "other_error"), ("", None),
)


@query(
    "Q26",
    "SELECT doc_id, m.category, CASE WHEN length(m.message || repeat('.', (n_chars % 400)::INT)) > 240 THEN substr(m.message || repeat('.', (n_chars % 400)::INT), 1, 237) || '...' ELSE m.message || repeat('.', (n_chars % 400)::INT) END AS message FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, {_quoted(t)}, {_quoted(c) if c else 'NULL'})" for k, (t, c) in enumerate(_MESSAGES))
    + ") AS m(k, message, category) ON doc_id % 9 = k",
)
def error_categories(spark, sf_dir):
    """Messages of every category, some of them too long to be kept whole."""
    message = F.get(F.array(*[F.lit(t) for t, _ in _MESSAGES]), (F.col("doc_id") % 9).cast("int"))
    long = F.concat(message, F.repeat(F.lit("."), (F.col("n_chars") % 400).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", payload.error_category(message).alias("category"), payload.shorten(long).alias("message"))


_KEYS = ", ".join(_quoted(k) for k in payload.PROGRAM_KEYS)


@query(
    "B3 B4 H8",
    f"SELECT doc_id, source AS program, '{{\"00\":' || (doc_id % 7 + 1) || '}}' AS counts, ([{_KEYS}])[(doc_id % 14 + 1)::INT] AS key FROM documents",
)
def wrapped_payloads(spark, sf_dir):
    """Programs under each of the 14 keys, a worse key beside them, some encoded twice; counts as the only item of a list."""
    keys = F.array(*[F.lit(k) for k in payload.PROGRAM_KEYS])
    at = (F.col("doc_id") % 14).cast("int")
    later = F.coalesce(F.get(keys, at + 1), F.lit("none"))
    wrapped = F.to_json(F.map_from_arrays(F.array(later, F.get(keys, at)), F.array(F.lit("worse"), F.col("source"))))
    twice = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), F.replace(wrapped, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(wrapped)
    counts = F.format_string('[{"0 0": %d, "00": "1.0"}]', F.col("doc_id") % 7)
    return table(spark, sf_dir, "documents").select("doc_id", payload.wrapped_program(twice).alias("program"), distributions.counts_json(distributions.counts(counts)).alias("counts"), F.get(keys, at).alias("key"))


@query(
    "Q5",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'OPENQASM 2.0;' || chr(10) || 'qreg q[' || (doc_id % 5 + 1) || '];' ELSE 'OPENQASM 3.0;' || chr(10) || 'qubit[' || (doc_id % 5 + 1) || '] q;' END AS program FROM documents",
)
def includes_for_retry(spark, sf_dir):
    """One header line and no includes, whatever stood there."""
    n = (F.col("doc_id") % 5 + 1).cast("string")
    two = F.concat(F.when(F.col("doc_id") % 4 == 0, "OPENQASM 2.0;\n").otherwise(""), F.lit('include "qelib1.inc";\n  include "stdgates.inc";\n'), F.lit("qreg q["), n, F.lit("];"))
    three = F.concat(F.lit('OPENQASM 3;\ninclude "stdgates.inc";\nqubit['), n, F.lit("] q;"))
    return table(spark, sf_dir, "documents").select("doc_id", payload.clean_includes(F.when(F.col("doc_id") % 2 == 0, two).otherwise(three)).alias("program"))


@query(
    "B11 H2 Q27 Q29",
    "SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AS aligned, CASE WHEN doc_id % 2 = 0 THEN 'best' WHEN doc_id % 7 <> 0 THEN 'norm' END AS source_col, coalesce(doc_id % 2 <> 0 AND doc_id % 7 <> 0, false) AS used_fallback, (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END)::BIGINT AS attempts, CASE WHEN doc_id % 2 <> 0 AND doc_id % 7 = 0 THEN 'empty_text' END AS error_category FROM documents",
)
def row_alignment(spark, sf_dir):
    """Whether a row's payloads belong together; which candidate text is used, after how many attempts, and what fails."""
    k = F.col("doc_id")
    kinds = [F.when(k % 4 == 0, "list").otherwise("single"), F.lit("single")]
    results = [F.lit(None).cast("map<string,bigint>"), distributions.counts(F.when(k % 5 == 0, " NaN ").otherwise('{"0": 1}'))]
    texts = [("best", F.when(k % 2 == 0, "x").otherwise(" nan ")), ("norm", F.when(k % 7 != 0, "y").otherwise("  "))]
    usable = [(n, F.when(~is_blank(c, PAYLOAD_TOKENS), c)) for n, c in texts]
    value, source, fallback = merge.first_success(usable)
    error = payload.error_category(F.when(value.isNull(), "empty text"))
    return table(spark, sf_dir, "documents").select("doc_id", payload.aligned_row(k % 3 == 0, kinds, results).alias("aligned"), source.alias("source_col"), fallback.alias("used_fallback"), merge.attempts(usable).alias("attempts"), error.alias("error_category"))


@query(
    "Q23 U8 S22 E14 Q24",
    "WITH d AS (SELECT sha256(text) AS h, min(doc_id) AS first_doc, count(*) AS copies, max(strlen(text))::BIGINT AS nbytes FROM documents WHERE trim(text) <> '' GROUP BY 1) SELECT 'document:' || h AS ref, first_doc, copies, nbytes FROM d",
)
def content_hash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("trim(text) != ''")
    keyed = docs.select(blobs.reference("document", F.col("text")).alias("ref"), "doc_id", F.octet_length("text").cast("long").alias("nbytes"))
    return keyed.groupBy("ref").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"), F.max("nbytes").alias("nbytes"))
