"""Opaque text payloads: what they are, what they hold, and batches in one cell expanded to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distributions import let, unwrap
from .nulls import PAYLOAD_TOKENS, is_blank

#: Keys under which wrapping objects hold a program, in the order in which they are tried.
PROGRAM_KEYS = ("qasm", "openqasm", "circuit", "executed_circuit", "data", "payload", "program", "text", "source", "body", "circuits", "items", "list", "programs")


def wrapped_program(text: Column) -> Column:
    """The program inside a JSON object: under the first known key; else the text itself."""
    found = lambda t: F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in PROGRAM_KEYS], t)
    return let(unwrap(text, 10), lambda t: F.when(t.startswith("{"), found(t)).otherwise(t))


def source_syntax(text: Column) -> Column:
    """qasm3, qasm2 or unknown, by header or by typical declarations; 3 is tried first."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(r"(?im)^\s*OPENQASM\s+3") | t.rlike(r"(?m)^\s*(qubit|bit)\s*(\[\s*\d+\s*\])?\s+\w+\s*;"), "qasm3")
        .when(t.rlike(r"(?im)^\s*OPENQASM\s+2") | t.rlike(r"(?m)^\s*(qreg|creg)\s+\w+\s*\[") | t.contains("qelib1.inc"), "qasm2")
        .otherwise("unknown")
    )


def detect_format(text: Column) -> Column:
    """A name for what a cell holds."""
    def name(t: Column) -> Column:
        json_list = F.from_json(F.when(t.startswith("["), t), "array<string>").isNotNull()
        json_map = F.from_json(F.when(t.startswith("{"), t), "map<string,string>").isNotNull()
        return (
            F.when(t == "", "empty")
            .when(t.startswith("[") & t.endswith("]"), F.when(json_list, F.when(t.contains("'"), "py_list").otherwise("json_list")).otherwise("bracketed_unknown"))
            .when(t.startswith("{") & t.endswith("}"), F.when(json_map, F.when(t.contains("'"), "py_dict").otherwise("json_dict")).otherwise("braced_unknown"))
            .when(t.startswith("gAS"), "b64_pickle_like")
            .when(t.rlike(r"(?i)^OPENQASM\s+3"), "qasm3_direct")
            .when(t.rlike(r"(?i)^OPENQASM\s+2"), "qasm2_direct")
            .otherwise(let(source_syntax(t), lambda s: F.when(s == "unknown", "other_string").otherwise(F.concat(s, F.lit("_like")))))
        )

    return let(F.trim(F.coalesce(text, F.lit(""))), name)


def clean_includes(text: Column) -> Column:
    """A program without include lines, with one header line."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?im)^[ \t]*include\s+\"[^\"]*\"\s*;[ \t]*\r?\n?", ""), r"(?im)^[ \t]*OPENQASM\s+[\d.]+\s*;[ \t]*\r?\n?", "")
    return F.concat(F.when(source_syntax(text) == "qasm3", "OPENQASM 3.0;\n").otherwise("OPENQASM 2.0;\n"), body)


def is_list(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("["), F.lit(False))


def items(text: Column) -> Column:
    """(kind, items, error) of a cell: a list's items, or the cell as the only one.

    Null has no items.  A list with an empty or nested item is an error and stays one item, the raw text.
    """
    def split(t: Column) -> Column:
        bad = lambda a: F.exists(a, lambda x: is_blank(x) | F.ltrim(x).startswith("["))
        read = lambda a: _cell(text, F.when(a.isNull(), "unparsable list").when(bad(a), "nested or empty item"), a, text)
        return F.when(t.startswith("["), let(F.from_json(t, "array<string>"), read)).otherwise(_cell(text, F.lit(""), F.lit(None).cast("array<string>"), text))

    return let(wrapped_program(text), split)


def _cell(text: Column, error: Column, listed: Column, single: Column) -> Column:
    """(kind, items, error); an empty error text stands for a cell that is no list."""
    plain = error == ""
    return F.struct(
        F.when(text.isNull(), "empty").when(error.isNull(), "list").otherwise("single").alias("kind"),
        F.when(text.isNull(), F.array().cast("array<string>")).when(error.isNull(), listed).otherwise(F.array(single)).alias("items"),
        F.when(~plain, error).alias("error"),
    )


def count_items(text: Column) -> Column:
    """``items`` of a cell of results: a list of objects gives each object's JSON; an object one."""
    def split(t: Column) -> Column:
        texts = lambda a: F.transform(a, lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))))
        bad = lambda a: a.isNull() | F.exists(a, lambda m: m.isNull())
        blank = F.when(is_blank(text, PAYLOAD_TOKENS), None).otherwise(t)
        listed = lambda a: _cell(blank, F.when(bad(a), "unparsable list"), texts(a), t)
        return F.when(t.startswith("["), let(F.from_json(t, "array<map<string,string>>"), listed)).otherwise(_cell(blank, F.lit(""), F.lit(None).cast("array<string>"), t))

    return let(F.coalesce(unwrap(text, 10), F.lit("")), split)


def expand_batches(df: DataFrame, job_id: str, payloads: dict[str, Column]) -> DataFrame:
    """One row for each part of a job.

    ``payloads`` maps each payload column to its (kind, items, error).  Lists with more than one item must be of one
    length; lists of one, and single cells, are repeated; an absent payload keeps its raw value.  If lengths differ
    there is one row with the raw payloads and mismatch true.  Adds parent_id, sub_id, batch_index, batch_size,
    is_batch_job, batch_mismatch and for each payload its kind, number and error.
    """
    parsed = df
    for name, c in payloads.items():
        parsed = parsed.withColumn(f"__{name}", c)
    n = {name: F.size(F.col(f"__{name}.items")) for name in payloads}
    many = F.array_distinct(F.filter(F.array(*n.values()), lambda x: x > 1))
    largest = F.greatest(*n.values(), F.lit(1))
    parent = F.coalesce(F.col(job_id).cast("string"), F.lit("unknown_id"))
    parsed = parsed.withColumns({
        "parent_id": parent,
        "batch_mismatch": F.size(many) > 1,
        "batch_size": largest,
        "is_batch_job": F.when(F.size(many) > 1, F.exists(F.array(*[F.col(f"__{p}.kind") for p in payloads]), lambda k: k == "list")).otherwise(largest > 1),
    })
    last = F.when(F.col("batch_mismatch"), 0).otherwise(F.col("batch_size") - 1)
    rows = parsed.withColumn("batch_index", F.explode(F.sequence(F.lit(0), last)))
    out = {}
    for name in payloads:
        have = F.col(f"__{name}.items")
        size = F.size(have)
        part = F.when(size == 1, have[0]).when(size > 1, F.get(have, F.col("batch_index")))
        out[name] = F.when(F.col("batch_mismatch") | (size == 0), F.col(name).cast("string")).otherwise(part)
        out |= {f"{name}_kind": F.col(f"__{name}.kind"), f"{name}_n": size, f"{name}_error": F.col(f"__{name}.error")}
    rows = rows.withColumns({"sub_id": F.concat_ws("_", "parent_id", F.col("batch_index").cast("string"))} | out)
    return rows.drop(*[f"__{name}" for name in payloads])


def aligned_row(mismatch: Column, kinds: list[Column], results: list[Column]) -> Column:
    """A part's payloads belong together: no mismatch, all single, and one result at least can be read."""
    single = F.lit(True)
    for k in kinds:
        single = single & (k != "list")
    readable = F.lit(False)
    for r in results:
        readable = readable | r.isNotNull()
    return ~F.coalesce(mismatch, F.lit(False)) & single & readable


def error_category(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m == "", None).when(m.contains("empty"), "empty_text").when(m.contains("list"), "unexpected_list_payload").when(m.contains("mismatch"), "row_batch_mismatch")
        .when(m.contains("qasm2"), "qasm2_parse_error").when(m.contains("qasm3"), "qasm3_parse_error").when(m.contains("parse"), "parse_error").when(m.contains("dag"), "dag_build_error").otherwise("other_error")
    )


def shorten(message: Column, most: int = 240) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most - 3), F.lit("..."))).otherwise(message)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
