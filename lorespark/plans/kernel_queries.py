"""Queries of chunking and extraction: Python kernels over whole documents, and the C and C++ extractor in expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.operators import chunking, extract
from lorespark.plans import standins as S
from lorespark.plans.code_samples import SAMPLES
from lorespark.plans.registry import query

#: Characters that some languages take for the end of a line
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def _text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def source_files(spark, sf, suffix: str):
    """A file of this suffix for every document: the sample of its number, with its number and its whole text in it."""
    n = F.col("node_id").cast("string")
    path = F.concat(F.lit("/src/f"), n, F.lit(suffix))
    said = F.replace(F.translate(F.coalesce("text", F.lit("")), _BREAKS, " " * len(_BREAKS)), F.lit("*/"), F.lit("* /"))
    sample = F.element_at(F.array(*[F.lit(t) for t, _, _ in SAMPLES[suffix]]), (F.col("node_id") % len(SAMPLES[suffix]) + 1).cast("int"))
    made = F.replace(F.replace(sample, F.lit("{0}"), n), F.lit("{t}"), said)
    return S.docs(spark, sf).select("node_id", path.alias("file_path"), made.alias("text"))


def _files_sql(suffix: str) -> str:
    """The same files: f(node_id, file_path, sample, text)."""
    k = len(SAMPLES[suffix])
    breaks = " || ".join(f"chr({ord(c)})" for c in _BREAKS)
    said = f"replace(translate(coalesce(text, ''), {breaks}, '{' ' * len(_BREAKS)}'), '*/', '* /')"
    sample = f"CASE node_id % {k} " + " ".join(f"WHEN {i} THEN {_text_sql(t)}" for i, (t, _, _) in enumerate(SAMPLES[suffix])) + " END"
    return f"f AS (SELECT node_id, '/src/f' || node_id || '{suffix}' AS file_path, node_id % {k} AS sample, replace(replace({sample}, '{{0}}', node_id::VARCHAR), '{{t}}', {said}) AS text FROM docs)"


def _found_sql(suffix: str) -> str:
    rows = [(i, *x) for i, (_, found, _) in enumerate(SAMPLES[suffix]) for x in found]
    fill = lambda c: f"replace(replace({c}, '{{p}}', file_path), '{{0}}', node_id::VARCHAR)"
    body = f"SELECT file_path, what, kind, {fill('x.source')} AS source, {fill('target')} AS target, CAST(line AS INT) AS line, {fill('owner')} AS owner FROM f JOIN found x USING (sample)"
    return S.sql("docs", body, _files_sql(suffix), S.values("found", "sample, what, kind, source, target, line, owner", rows))


def _chunks_sql(suffix: str) -> str:
    rows = [(i, p, *x) for i, (_, _, chunks) in enumerate(SAMPLES[suffix]) for p, x in enumerate(chunks)]
    whole = [i for i, (_, _, chunks) in enumerate(SAMPLES[suffix]) if not chunks]
    lines = "string_split(left(text, length(text) - 1), chr(10))"  # all samples end with a line feed
    last = "CASE WHEN type = 'class' THEN start_line + 9 ELSE end_line END" if suffix == ".py" else "end_line"  # a Python class gives its first ten lines
    body = (
        f"SELECT node_id, CAST(pos AS INT) AS pos, array_to_string(list_slice({lines}, start_line, {last}), chr(10)) || chr(10) AS content, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, type, replace(x.name, '{{0}}', node_id::VARCHAR) AS name FROM f JOIN part x USING (sample) "
        f"UNION ALL SELECT node_id, 0, text, 1, CAST(len({lines}) AS INT), 'module', 'f' || node_id FROM f WHERE sample IN ({', '.join(map(str, whole)) or '-1'})"
    )
    return S.sql("docs", body, _files_sql(suffix), S.values("part", "sample, pos, start_line, end_line, type, name", rows))


def _extract(suffix: str):
    return lambda spark, sf: extract.extracted(source_files(spark, sf, suffix))


def _chunk(suffix: str):
    return lambda spark, sf: chunking.chunked(source_files(spark, sf, suffix))


query("j13_extract_python", _found_sql(".py"))(_extract(".py"))
query("j14_extract_script", _found_sql(".ts"))(_extract(".ts"))
query("j15_extract_rust", _found_sql(".rs"))(_extract(".rs"))
query("j16_extract_go", _found_sql(".go"))(_extract(".go"))
query("j17_extract_cpp", _found_sql(".c"))(_extract(".c"))
query("j18_extract_astro", _found_sql(".astro"))(_extract(".astro"))
query("k13_chunk_python", _chunks_sql(".py"))(_chunk(".py"))
query("k14_chunk_syntax", _chunks_sql(".ts"))(_chunk(".ts"))
query("k14_chunk_rust", _chunks_sql(".rs"))(_chunk(".rs"))
query("k14_chunk_go", _chunks_sql(".go"))(_chunk(".go"))


def _packed_sql(limit: int, body: str) -> str:
    """p(node_id, no, n, part, size): every line's chunk, by recursion over the lines of a document."""
    lines = (
        "lines AS (SELECT node_id, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS no, len(string_split(text, chr(10))) AS k FROM docs), "
        "sized AS (SELECT node_id, no, length(said) + CASE WHEN no < k THEN 1 ELSE 0 END AS n, k FROM lines WHERE no < k OR said <> '')"
    )
    step = (
        "RECURSIVE p AS (SELECT node_id, no, n, 1 AS part, n AS size FROM sized WHERE no = 1 "
        f"UNION ALL SELECT s.node_id, s.no, s.n, CASE WHEN p.size + s.n > {limit} THEN p.part + 1 ELSE p.part END, CASE WHEN p.size + s.n > {limit} THEN s.n ELSE p.size + s.n END FROM p JOIN sized s ON s.node_id = p.node_id AND s.no = p.no + 1)"
    )
    return S.sql("docs", body, lines, step)


_TEXT = (
    "SELECT d.node_id, CAST(coalesce(c.part, 1) - 1 AS INT) AS pos, CAST(coalesce(c.first, 1) AS INT) AS start_line, "
    "CAST(CASE WHEN length(coalesce(text, '')) <= {0} THEN (SELECT count(*) FROM sized s WHERE s.node_id = d.node_id) ELSE c.last END AS INT) AS end_line, 'text' AS type, "
    "CASE WHEN length(coalesce(text, '')) <= {0} THEN file_name ELSE file_name || '_part' || c.part END AS name, CAST(CASE WHEN length(coalesce(text, '')) <= {0} THEN length(coalesce(text, '')) ELSE c.chars END AS INT) AS chars "
    "FROM docs d LEFT JOIN (SELECT node_id, part, min(no) AS first, max(no) AS last, sum(n) AS chars FROM p GROUP BY node_id, part) c ON c.node_id = d.node_id AND length(coalesce(text, '')) > {0}"
)


def _as_text(spark, sf):
    return S.docs(spark, sf).withColumn("file_path", F.concat("file_path", F.lit(".md")))


@query("k15_chunk_text", _packed_sql(6000, _TEXT.format(6000)))
def k15(spark, sf):
    return chunking.chunked(_as_text(spark, sf)).select("node_id", "pos", "start_line", "end_line", "type", "name", F.length("content").alias("chars"))


@query("e06_line_packing", _packed_sql(1000, f"SELECT node_id, count(*) AS chunks, max(chars) AS longest, CAST(sum(chars) AS BIGINT) AS chars FROM ({_TEXT.format(1000)}) GROUP BY node_id"))
def e06(spark, sf):
    return chunking.chunked(_as_text(spark, sf), max_tokens=250).groupBy("node_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content")).alias("chars"))
