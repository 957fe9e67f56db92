"""Cleaning, sectioning and chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdoc.functions import text as T
from sparrowdoc.operators import chunking as C
from sparrowdoc.plans import sql
from sparrowdoc.plans.registry import register
from sparrowdoc.sources.office import word_layout
from sparrowdoc.sources.tables import load

docs = lambda s, d: load(s, d, "documents")


def md5(c):
    return F.md5(c.cast("binary"))


register("scan_documents", lambda s, d: docs(s, d).select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), "lang", "source", F.char_length("text").cast("long").alias("n")), "SELECT 'doc_' || doc_id AS id, lang, source, length(text) AS n FROM documents")
register("clean_text", lambda s, d: docs(s, d).select("doc_id", md5(T.clean(F.col("text"))).alias("cleaned")), f"SELECT doc_id, md5({sql.clean('text')}) AS cleaned FROM documents")
_KEPT = f"""regexp_replace(regexp_replace(regexp_replace({sql.clean('text')}, '[^\\p{{L}}\\p{{N}}_\\s.,;:!?\\-()\\[\\]{{}}"''/$%&*+=<>]', ' ', 'g'), '\\bl\\b', 'I', 'g'), '\\b0\\b', 'O', 'g')"""
# Splits at what may go, and puts it back where it stays.
_COMMAS = "list_reduce(string_split(k, ','), lambda a, p: a || CASE WHEN regexp_matches(a, '[0-9]$') AND regexp_matches(p, '^[0-9]{3}([^0-9]|$)') THEN '' ELSE ',' END || p)"
_HYPHENS = f"list_reduce(string_split({_COMMAS}, '- '), lambda a, p: a || CASE WHEN regexp_matches(a, '[\\p{{L}}\\p{{N}}_]$') AND regexp_matches(p, '^[\\p{{L}}\\p{{N}}_]') THEN '' ELSE '- ' END || p)"
register(
    "ocr_clean",
    lambda s, d: docs(s, d).select("doc_id", md5(T.ocr_clean(F.col("text"))).alias("cleaned")),
    f"SELECT doc_id, md5({sql.clean(_HYPHENS)}) AS cleaned FROM (SELECT doc_id, {_KEPT} AS k FROM documents)",
)
_CODE = " OR ".join(f"contains(lower(o), '{m}')" for m in T.CODE_MARKS)
register(
    "answer_clean",
    lambda s, d: load(s, d, "pages").select("page_id", md5(T.answer_text(F.regexp_replace("html", "[={};]|//", " "))).alias("answer")),
    f"""SELECT page_id, md5(CASE WHEN {_CODE} THEN '' ELSE o END) AS answer FROM (SELECT page_id, {sql.clean("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '[={};]|//', ' ', 'g'), '```[\\s\\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), '(?m)^\\s*[#-]\\s*', '', 'g')")} AS o FROM pages)""",
)
register(
    "text_quality_gate",
    lambda s, d: docs(s, d).select("doc_id", T.passes_quality(F.col("text"), F.lit(0.9)).alias("passes"), F.round(T.alnum_ratio(F.col("text")), 6).alias("ratio")),
    "SELECT doc_id, length(trim(text)) >= 10 AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / greatest(length(text), 1) >= 0.5 AS passes, round(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / greatest(length(text), 1), 6) AS ratio FROM documents",
)
_EXT = "lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1))"
register(
    "classify_extension",
    lambda s, d: load(s, d, "pages").select("page_id", T.extension_kind(F.col("url")).alias("kind")),
    f"SELECT page_id, CASE WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} IN ('docx', 'doc') THEN 'docx' WHEN {_EXT} IN ('txt', 'md') THEN 'text' WHEN {_EXT} IN ('png', 'jpg', 'jpeg', 'tiff', 'tif', 'bmp', 'gif') THEN 'image' ELSE 'unknown' END AS kind FROM pages",
)
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
_KIND = "CASE WHEN regexp_matches(trim(line), '^[A-Z\\s]+$') AND length(trim(line)) < 100 THEN 'header' WHEN regexp_matches(trim(line), '^\\s*[•\\-*\\d+.]\\s+') THEN 'list' WHEN contains(trim(line), chr(9)) OR regexp_matches(trim(line), '\\s{3,}') THEN 'table' ELSE 'paragraph' END"
register(
    "line_types",
    lambda s, d: docs(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", T.line_type(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n")),
    f"SELECT doc_id, {_KIND} AS kind, count(*) AS n FROM {_LINES} GROUP BY ALL",
)
register(
    "sections_heuristic",
    lambda s, d: C.sections(docs(s, d)).withColumn("text", md5(F.col("text"))),
    f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, trim(line) = '' AS blank, {_KIND} AS kind FROM l),
t AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w <> kind OR lag(blank) OVER w OR blank, TRUE) THEN 1 ELSE 0 END AS turn FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM t),
g AS (SELECT doc_id, run, kind, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY i)) AS text FROM r WHERE NOT blank GROUP BY doc_id, run, kind)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS section, kind, n_lines, text FROM g""",
)


def importance_sql(c: str, kind: str) -> str:
    found = " + ".join(f"CASE WHEN contains(lower({c}), '{k}') THEN 1 ELSE 0 END" for k in T.IMPORTANT.get(kind, T.IMPORTANT["general"]))
    base = f"least(1.0, 0.5 + CASE WHEN length({c}) > 100 THEN 0.2 ELSE 0.0 END + least(0.3, ({found}) * 0.1))"
    if kind in T.BOOSTS:
        pattern, boost = T.BOOSTS[kind]
        base = f"least(1.0, {base} + CASE WHEN regexp_matches(lower({c}), '{pattern}') THEN {boost} ELSE 0.0 END)"
    return f"round({base}, 2)"


_TYPES = ["general", "invoice", "resume", "legal_contract", "medical_record", "purchase_order"]
register(
    "section_importance",
    lambda s, d: docs(s, d).select("doc_id", *[F.round(T.importance(F.col("text"), t), 2).alias(t) for t in _TYPES]),
    f"SELECT doc_id, {', '.join(importance_sql('text', t) + ' AS ' + t for t in _TYPES)} FROM documents",
)
_SENT = "list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_FOLD = f"""list_reduce({_SENT}, lambda acc, s: CASE WHEN acc['open'] <> '' AND length(acc['open']) + length(s) > 200 THEN {{'done': list_append(acc['done'], acc['open']), 'open': s}}
 WHEN acc['open'] = '' THEN {{'done': acc['done'], 'open': s}} ELSE {{'done': acc['done'], 'open': acc['open'] || ' ' || s}} END, {{'done': []::VARCHAR[], 'open': ''}})"""
_GREEDY = f"(SELECT doc_id, CASE WHEN f['open'] = '' THEN f['done'] ELSE list_append(f['done'], f['open']) END AS c FROM (SELECT doc_id, {_FOLD} AS f FROM documents))"


def digest(s, d, chunks):
    """One row a document: its number of chunks and their digest."""
    return docs(s, d).select("doc_id", chunks(F.col("text")).alias("c")).select("doc_id", F.size("c").cast("long").alias("n_chunks"), md5(F.array_join("c", "|")).alias("chunks_md5"))


register("chunk_greedy", lambda s, d: digest(s, d, C.greedy), f"SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM {_GREEDY}")


def overlap_sql(c: str) -> str:
    """The chunks of :func:`with_overlap` as a fold."""
    found = _SENT.replace("(text,", f"({c},")
    fold = f"""list_reduce({found}, lambda acc, s: CASE WHEN acc['n'] > 0 AND acc['size'] + length(s) > 512 THEN {{'done': list_append(acc['done'], acc['open']), 'open': acc['last'] || ' ' || s, 'last': s, 'size': length(acc['last']) + length(s), 'n': 2}}
 WHEN acc['n'] = 0 THEN {{'done': acc['done'], 'open': s, 'last': s, 'size': length(s), 'n': 1}} ELSE {{'done': acc['done'], 'open': acc['open'] || ' ' || s, 'last': s, 'size': acc['size'] + length(s), 'n': acc['n'] + 1}} END,
 {{'done': []::VARCHAR[], 'open': '', 'last': '', 'size': 0::BIGINT, 'n': 0}})"""
    return f"(SELECT CASE WHEN f['n'] = 0 THEN f['done'] ELSE list_append(f['done'], f['open']) END FROM (SELECT {fold} AS f))"


register("chunk_sentence_overlap", lambda s, d: digest(s, d, C.with_overlap), f"SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM (SELECT doc_id, {overlap_sql('text')} AS c FROM documents)")
_WORDS = f"list_filter(string_split({sql.clean('text')}, ' '), lambda w: w <> '')"
register(
    "chunk_sliding_window",
    lambda s, d: digest(s, d, C.sliding),
    f"""SELECT doc_id, len(c) AS n_chunks, md5(array_to_string(c, '|')) AS chunks_md5 FROM (
 SELECT doc_id, list_transform(range(1, len(w) + 1, greatest(width - back, 1)), lambda i: array_to_string(list_slice(w, i, i + greatest(width, 1) - 1), ' ')) AS c FROM (
 SELECT doc_id, w, floor(512 / m)::INT AS width, floor(50 / m)::INT AS back FROM (SELECT doc_id, w, length(array_to_string(w, '')) / len(w) AS m FROM (SELECT doc_id, {_WORDS} AS w FROM documents))))""",
)
register(
    "chunk_finalize",
    lambda s, d: C.finalised(C.explode_chunks(docs(s, d), C.greedy(F.col("text")))).select("doc_id", "chunk_id", "total", "importance", F.char_length("content").cast("long").alias("length")),
    f"""SELECT doc_id, chunk_id, total, importance, length FROM (SELECT doc_id, unnest(range(len(c))) AS chunk_id, len(c) AS total, unnest(c) AS content FROM {_GREEDY}) AS x,
 LATERAL (SELECT {importance_sql("content", "general")} AS importance, length(content) AS length) AS y WHERE length >= 100 OR importance >= 0.8""",
)
register(
    "layout_paragraphs",
    lambda s, d: C.paragraphs(docs(s, d).withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n\n")))).withColumn("text", md5(F.col("text"))),
    "SELECT doc_id, idx, md5(trim(text)) AS text FROM (SELECT doc_id, unnest(range(len(p))) AS idx, unnest(p) AS text FROM (SELECT doc_id, string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM documents)) WHERE trim(text) <> ''",
)


def elements(s, d):
    """Order lines laid out as page elements: pages by order, rows by line, columns by part."""
    li = load(s, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("element_id"),
        (F.col("l_linenumber") % 2 + 1).alias("page"),
        (F.col("l_partkey") % 7).cast("double").alias("y1"),
        (F.col("l_suppkey") % 5).cast("double").alias("x1"),
        F.lit("text").alias("kind"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_linestatus")).alias("text"),
    )


register(
    "reading_order",
    lambda s, d: C.reading_order(elements(s, d)).select("doc_id", "element_id", "page", "position"),
    """SELECT doc_id, element_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, x1, element_id) AS position FROM (SELECT l_orderkey AS doc_id, l_linenumber || '-' || l_partkey AS element_id,
 l_linenumber % 2 + 1 AS page, l_partkey % 7 AS y1, l_suppkey % 5 AS x1, l_returnflag FROM lineitem WHERE l_returnflag <> 'R')""",
)
_T = "trim(text)"
register(
    "layout_classify",
    lambda s, d: docs(s, d).select("doc_id", C.layout_kind(F.col("text"), 8 + F.col("n_chars") % 8).alias("kind")),
    f"SELECT doc_id, CASE WHEN 8 + n_chars % 8 > 14 OR (regexp_matches({_T}, '^[A-Z\\s]+$') AND length({_T}) < 100) THEN 'header' WHEN regexp_matches({_T}, '^\\s*[•\\-*\\d+.]\\s+') THEN 'list' WHEN contains({_T}, chr(9)) OR regexp_matches({_T}, '\\d+\\s+\\d+') THEN 'table' WHEN 8 + n_chars % 8 < 10 THEN 'footer' ELSE 'paragraph' END AS kind FROM documents",
)
register(
    "table_regions",
    lambda s, d: (lambda li: C.table_regions(li.select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("y")), li.select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 50).cast("double").alias("x"))).select("page", "x1", "y1", "x2", "y2"))(load(s, d, "lineitem")),
    """WITH h AS (SELECT * FROM (SELECT l_orderkey AS page, l_quantity AS y1, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS y2 FROM lineitem) WHERE y2 > y1),
v AS (SELECT * FROM (SELECT l_orderkey AS page, (l_partkey % 50)::DOUBLE AS x1, lead((l_partkey % 50)::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 50) AS x2 FROM lineitem) WHERE x2 > x1)
SELECT page, x1, y1, x2, y2 FROM h JOIN v USING (page)""",
)
register(
    "text_helpers",
    lambda s, d: docs(s, d).select("doc_id", md5(T.truncate(F.col("text"), 100)).alias("cut"), T.safe_filename(F.concat(F.col("source"), F.lit("/a:b?"))).alias("file"), F.sha2("text", 256).alias("sha"), T.format_bytes(F.col("n_chars")).alias("size")),
    "SELECT doc_id, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END) AS cut, regexp_replace(source || '/a:b?', '[<>:\"/\\\\|?*]', '_', 'g') AS file, sha256(text) AS sha, CASE WHEN n_chars < 1024 THEN round(n_chars::DOUBLE, 1)::VARCHAR || ' B' ELSE round(n_chars / 1024.0, 1)::VARCHAR || ' KB' END AS size FROM documents",
)


def word_files(s, d):
    """Each document as a Word file: its lines as paragraphs, and a table of its language and source."""

    def work(frames):
        import io
        import re
        import zipfile
        from html import escape

        import pandas as pd

        for pdf in frames:
            made = []
            for row in pdf.itertuples():
                plain = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(re.sub(CONTROL, "", t or ""))}</w:t></w:r></w:p>'
                lines = "".join(map(plain, (row.text or "").split("\n")))
                table = f"<w:tbl><w:tr><w:tc>{plain(row.lang)}</w:tc><w:tc>{plain(row.source)}</w:tc></w:tr></w:tbl>"
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{table}{lines}</w:body></w:document>')
                made.append((str(row.doc_id), out.getvalue()))
            yield pd.DataFrame(made, columns=["path", "content"])

    return docs(s, d).select("doc_id", "text", "lang", "source").mapInPandas(work, "path string, content binary")


#: What XML can't hold, or changes.
CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\uFFFE\\uFFFF]"


def word(s, d):
    e = word_layout(word_files(s, d))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"])
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("header", "list", "paragraph", "table")]
    return e.groupBy(F.col("path").cast("long").alias("doc_id")).agg(*counts, md5(F.array_join(texts, "\n")).alias("text_md5"))


_LINES = f"list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\s\\p{{Z}}\\x{{85}}]'))"
_KINDS = "list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^[\\s\\p{Z}]*[-*•]') THEN 'l' WHEN length(trim(x)) < 100 AND upper(x) = x AND lower(x) <> x THEN 'h' ELSE 'p' END)"
register(
    "docx_layout",
    word,
    f"""SELECT doc_id, len(list_filter(ks, lambda k: k = 'h')) AS n_headers, len(list_filter(ks, lambda k: k = 'l')) AS n_lists, len(list_filter(ks, lambda k: k = 'p')) AS n_paragraphs, 1 AS n_tables,
 md5(array_to_string(list_append(ls, trim(coalesce(lang, '')) || chr(9) || trim(coalesce(source, ''))), chr(10))) AS text_md5 FROM (SELECT *, {_KINDS} AS ks FROM (SELECT doc_id, lang, source, {_LINES} AS ls FROM documents))""",
)
