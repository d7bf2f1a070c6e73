"""All registered queries of the document engine, each over its whole input, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, latex, text
from ..functions.text import WHITE
from ..operators import grid, markdown, plaintext, render
from ..shipping import ship
from ..sources import delimited
from . import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- pieces of the other engine's SQL -------------------------------------------------------------------------------------------------


def q(s: str) -> str:
    """A string literal; control and rare characters by number."""
    parts: list[str] = []
    plain = ""
    for c in s:
        if ord(c) < 32 or ord(c) > 126:
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
            parts.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += c
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


GAP = "[\\t\\n\\f\\r ]"


def trim_(s: str) -> str:
    return f"trim({s}, {q(WHITE)})"


def sub(s: str, pattern: str, by: str) -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(by)}, 'g')"


def clean(s: str) -> str:
    return sub(trim_(s), GAP + "+", " ")


def strip_(s: str) -> str:
    return sub(s, "<[^>]*>", "")


def swap_(s: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def each(s: str, pattern: str, make: str) -> str:
    """Matches replaced by ``make``, SQL over w (whole), g1, g2; needs ``s`` to be a column."""
    p = q(pattern)
    rows = f"list_zip(regexp_extract_all({s}, {p}, 0), regexp_extract_all({s}, {p}, 1), regexp_extract_all({s}, {p}, {2 if 'g2' in make else 1}))"
    made = f"list_transform({rows}, lambda r: {make.replace('g1', 'r[2]').replace('g2', 'r[3]').replace('@w', 'r[1]')})"
    return f"array_to_string(list_transform(list_zip(string_split_regex({s}, {p}), list_append({made}, '')), lambda z: z[1] || z[2]), '')"


def chain(source: str, keep: str, *steps: str) -> str:
    """CTEs that apply steps, SQL over x, to column x of source; the last one's x is the result."""
    ctes = [f"s0 AS (SELECT * FROM {source})"]
    for i, step in enumerate(steps):
        ctes.append(f"s{i + 1} AS (SELECT {keep}, {step} AS x FROM s{i})")
    return "WITH " + ", ".join(ctes)


def el(tag: str, inner: str = "(.+?)") -> str:
    return f"(?is)<{tag}(?:{GAP}[^>]*)?>{inner}</{tag}{GAP}*>"


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def over(name: str, source: str, columns: dict[str, Callable[[], Column]], sql_columns: str, ctes: str = "") -> None:
    """A query of columns over a synthetic input, and its SQL columns over the same input ``t``."""
    add(name, lambda spark, d: synth.frame(spark, d, source).select("id", *(c().alias(n) for n, c in columns.items())), f"{ctes} SELECT id, {sql_columns} FROM {synth.duck(source)} t")


c = F.col

# --- names and formats ----------------------------------------------------------------------------------------------------------------

EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
FORMAT = "CASE " + " ".join(f"WHEN {EXT} = '{e}' THEN '{f}'" for e, f in text.FORMATS.items()) + " ELSE 'markdown' END"
STEM = f"translate(regexp_replace({BASE}, '\\.[^.]*$', ''), '-_', '  ')"
TITLED = f"array_to_string(list_transform(list_filter(string_split({STEM}, ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
over("detect_format", synth.PATHS, {"format": lambda: text.detect_format(c("path"))}, f"{FORMAT} AS format")
over("batch_filter", synth.PATHS, {"taken": lambda: text.in_batch(c("path"))}, f"{EXT} IN {text.BATCH_EXTENSIONS} AND lower({BASE}) NOT IN {text.BATCH_SKIPS} AS taken")
over("output_path", synth.PATHS, {"pdf": lambda: text.output_path(c("path"))}, "regexp_replace(path, '\\.[^./]*$', '') || '.pdf' AS pdf")
over("title_from_filename", synth.PATHS, {"title": lambda: text.title_from_filename(c("path"))}, f"{TITLED} AS title")
add(
    "batch_summary",
    lambda spark, d: synth.frame(spark, d, synth.PATHS).where(text.in_batch(c("path")) | (text.detect_format(c("path")) == "xls")).withColumn("format", text.detect_format(c("path"))).groupBy("format").agg(F.count("*").alias("total"), F.count_if(c("format") != "xls").alias("success")),
    f"SELECT format, count(*) AS total, count(*) FILTER (format <> 'xls') AS success FROM (SELECT {FORMAT} AS format FROM {synth.duck(synth.PATHS)} t WHERE ({EXT} IN {text.BATCH_EXTENSIONS} AND lower({BASE}) NOT IN {text.BATCH_SKIPS}) OR {EXT} = '.xls') GROUP BY format",
)
FIRST = "split_part(content, chr(10), 1)"
marks = lambda m: f"(length({FIRST}) - length(replace({FIRST}, {q(m)}, '')))"
DELIMITER = f"CASE WHEN {marks(chr(9))} > {marks(',')} AND {marks(chr(9))} > {marks(';')} THEN chr(9) WHEN {marks(';')} > {marks(',')} THEN ';' ELSE ',' END"
over("csv_delimiter", synth.CSV_TEXT, {"delimiter": lambda: text.csv_delimiter(c("content"))}, f"{DELIMITER} AS delimiter")


def csv_records(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    rows = synth.frame(spark, d, synth.CSV_TEXT).withColumn("rows", delimited.csv_rows(c("content")))
    return rows.select("id", F.posexplode("rows").alias("row_no", "cells")).select("id", "row_no", F.array_join("cells", "\x1f").alias("cells"))


add(
    "csv_records",
    csv_records,
    f"""WITH t AS (SELECT id, content, {DELIMITER} AS m FROM {synth.duck(synth.CSV_TEXT)} t), l AS (SELECT id, m, unnest(list_filter(string_split(content, chr(10)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(string_split(content, chr(10)), lambda x: x <> ''), 1) - 1 AS row_no FROM t)
SELECT id, CAST(row_no AS INTEGER) AS row_no, array_to_string(string_split(line, m), chr(31)) AS cells FROM l""",
)

# --- grids ----------------------------------------------------------------------------------------------------------------------------


def cells() -> Column:
    return F.transform(F.split("grid", "\n"), lambda r: F.split(r, r"\|"))


ROWS = "list_transform(string_split(grid, chr(10)), lambda r: string_split(r, '|'))"
WIDTH = "list_max(list_transform(rows, lambda r: len(r)))"
PAD = "list_resize(r, w, '')"
FILLED = lambda r: f"len(list_filter({r}, lambda v: {trim_('v')} <> ''))"
PROSE = lambda r: f"({FILLED(r)} = 1 AND strlen({trim_(r + '[1]')}) >= 80)"


def pipe_sql(rows: str, trim: bool) -> str:
    cell = trim_("v") if trim else "v"
    line = f"'|' || array_to_string(list_transform({PAD}, lambda v: ' ' || {cell} || ' |'), '') || chr(10)"
    return f"list_transform({rows}[1:1], lambda r: {line})[1] || '|' || repeat(' --- |', w) || chr(10) || array_to_string(list_transform({rows}[2:], lambda r: {line}), '') || chr(10) || '*' || CAST(len({rows}) - 1 AS STRING) || ' rows, ' || CAST(w AS STRING) || ' columns*' || chr(10)"


GRIDS = f"g AS (SELECT *, {WIDTH} AS w FROM (SELECT *, {ROWS} AS rows FROM {synth.duck(synth.GRID)}))"
add("pad_row", lambda spark, d: synth.frame(spark, d, synth.GRID).select("id", F.posexplode(F.transform(cells(), lambda r: F.array_join(html.pad_row(r, F.lit(3)), "\x1f"))).alias("row_no", "row")), f"WITH g AS (SELECT id, unnest({ROWS}) AS r, generate_subscripts({ROWS}, 1) - 1 AS row_no FROM {synth.duck(synth.GRID)}) SELECT id, CAST(row_no AS INTEGER) AS row_no, array_to_string(list_resize(r, 3, ''), chr(31)) AS row FROM g")
add("csv_to_markdown", lambda spark, d: synth.frame(spark, d, synth.GRID).select("id", grid.csv_markdown(cells(), c("path")).alias("md")), f"WITH {GRIDS} SELECT id, '---' || chr(10) || 'title: ' || {TITLED} || chr(10) || 'style: report' || chr(10) || '---' || chr(10) || chr(10) || '## Data' || chr(10) || chr(10) || {pipe_sql('rows', True)} AS md FROM g")
SHEETS = f"g AS (SELECT *, {WIDTH} AS w FROM (SELECT *, {ROWS} AS rows FROM {synth.duck(synth.SHEET)}))"
KIND = f"CASE WHEN w <= 2 AND len(list_filter(rows, lambda r: {PROSE('r')})) > len(rows) // 2 THEN 'text' WHEN len(list_filter(rows, lambda r: {PROSE('r')})) > 0 AND len(list_filter(rows, lambda r: {FILLED('r')} > 1)) > 0 THEN 'mixed' ELSE 'table' END"
add("sheet_kind", lambda spark, d: synth.frame(spark, d, synth.SHEET).select("id", grid.sheet_kind(cells()).alias("kind")), f"WITH {SHEETS} SELECT id, {KIND} AS kind FROM g")
CAPS = lambda s: f"(strlen({s}) BETWEEN 3 AND 80 AND regexp_matches({s}, '[A-Z]') AND NOT regexp_matches({s}, '[a-z]'))"
add(
    "text_sheets",
    lambda spark, d: synth.frame(spark, d, synth.SHEET).where(grid.sheet_kind(cells()) == "text").select("id", grid.sheet_markdown(cells()).alias("md")),
    f"WITH {SHEETS}, k AS (SELECT *, list_filter(list_transform(rows, lambda r: {trim_('r[1]')}), lambda s: s <> '') AS ts, {KIND} AS kind FROM g) SELECT id, array_to_string(list_transform(ts, lambda s: CASE WHEN (strlen(s) < 60 AND NOT contains(s, ' ')) OR {CAPS('s')} THEN '### ' ELSE '' END || s || chr(10) || chr(10)), '') AS md FROM k WHERE kind = 'text'",
)
add("table_sheets", lambda spark, d: synth.frame(spark, d, synth.SHEET).where(grid.sheet_kind(cells()) == "table").select("id", grid.sheet_markdown(cells()).alias("md")), f"WITH {SHEETS}, k AS (SELECT *, {KIND} AS kind FROM g) SELECT id, {pipe_sql('rows', False)} || chr(10) AS md FROM k WHERE kind = 'table'")
add(
    "mixed_sheets",
    lambda spark, d: synth.frame(spark, d, synth.SHEET).where(grid.sheet_kind(cells()) == "mixed").select("id", grid.sheet_markdown(cells()).alias("md")),
    f"""WITH {SHEETS}, k AS (SELECT *, {KIND} AS kind FROM g), u AS (SELECT id, w, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM k WHERE kind = 'mixed'),
p AS (SELECT *, {FILLED('r')} <= 1 AND strlen({trim_('r[1]')}) >= 80 AS prose, {FILLED('r')} > 0 AS filled FROM u),
n AS (SELECT *, sum(CASE WHEN prose THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS part FROM p),
f AS (SELECT *, min(CASE WHEN filled AND NOT prose THEN i END) OVER (PARTITION BY id, part) AS b FROM n),
tb AS (SELECT id, part, any_value(w) AS w, list(r ORDER BY i) AS rows FROM f WHERE NOT prose AND i >= b GROUP BY id, part),
pieces AS (SELECT id, part, 0 AS o, {trim_('r[1]')} || chr(10) || chr(10) AS s FROM f WHERE prose UNION ALL SELECT id, part, 1, {pipe_sql('rows', False)} || chr(10) FROM tb)
SELECT id, string_agg(s, '' ORDER BY part, o) AS md FROM pieces GROUP BY id""",
)


def chart_input(spark: SparkSession, d: str) -> DataFrame:
    src = synth.frame(spark, d, "SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM {orders}")
    none = F.expr("cast(array() as array<string>)")
    k = c("id").cast("string")
    one = F.struct(F.when(c("id") % 3 == 0, "").otherwise(c("s")).alias("name"), F.when(c("id") % 2 == 0, none).otherwise(F.array(F.lit("Q1"), c("p"))).alias("categories"), F.array(k, F.lit("7"), F.lit("8")).alias("values"))
    two = F.struct(F.lit("B").alias("name"), F.when(c("id") % 5 == 0, none).otherwise(F.array(F.lit("x"))).alias("categories"), F.array(F.lit("5")).alias("values"))
    return src.select("id", F.array(one, two).alias("series"))


add(
    "chart_pivot",
    lambda spark, d: chart_input(spark, d).select("id", grid.chart_table(c("series")).alias("md")),
    """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Series' ELSE o_orderstatus END AS n1, CASE WHEN o_orderkey % 2 <> 0 THEN ['Q1', o_orderpriority] WHEN o_orderkey % 5 <> 0 THEN ['x'] ELSE [] END AS cats, [CAST(o_orderkey AS STRING), '7', '8'] AS v FROM orders)
SELECT id, '| Category | ' || n1 || ' | B |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(range(1, 4), lambda i: '| ' || coalesce(cats[i], CAST(i AS STRING)) || ' | ' || v[i] || ' | ' || CASE WHEN i = 1 THEN '5' ELSE '' END || ' |' || chr(10)), '') || chr(10) AS md FROM s""",
)
CHART_XML = "SELECT o_orderkey AS id, '<c:chart>' || CASE WHEN o_orderkey % 3 = 0 THEN '<c:title><c:tx><a:t>T ' || o_orderpriority || '</a:t></c:tx></c:title>' WHEN o_orderkey % 3 = 1 THEN '<c:title><c:v>V</c:v></c:title>' ELSE '<c:title><a:t></a:t></c:title>' END || CASE WHEN o_orderkey % 4 = 0 THEN '<c:pieChart>' WHEN o_orderkey % 4 = 1 THEN '<c:lineChart><c:barChart>' WHEN o_orderkey % 4 = 2 THEN '<c:bubbleChart>' ELSE '<c:bar3DChart>' END AS xml FROM {orders}"
over("chart_type", CHART_XML, {"kind": lambda: grid.chart_type(c("xml"))}, "CASE " + " ".join(f"WHEN contains(xml, '{t}') THEN '{n}'" for t, n in grid.CHARTS) + " ELSE '' END AS kind")
over("chart_title", CHART_XML, {"title": lambda: grid.chart_title(c("xml"))}, "coalesce(nullif(regexp_extract(regexp_extract(xml, '(?s)<c:title>(.*?)</c:title>', 1), '(?s)<a:t>(.*?)</a:t>', 1), ''), regexp_extract(regexp_extract(xml, '(?s)<c:title>(.*?)</c:title>', 1), '(?s)<c:v>(.*?)</c:v>', 1)) AS title")
REFS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'A' WHEN o_orderkey % 5 = 1 THEN 'AZ' WHEN o_orderkey % 5 = 2 THEN 'BCD' WHEN o_orderkey % 5 = 3 THEN 'b' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS ref FROM {orders}"
LETTERS = "regexp_extract(ref, '^([A-Z]*)', 1)"
over("cell_ref", REFS, {"col": lambda: text.cell_ref(c("ref"))["col"], "row": lambda: text.cell_ref(c("ref"))["row"]}, f"CAST(list_reduce(list_prepend(0, list_transform(list_filter(string_split({LETTERS}, ''), lambda x: x <> ''), lambda x: ascii(x) - 64)), lambda a, x: a * 26 + x) AS BIGINT) AS col, coalesce(TRY_CAST(substr(ref, length({LETTERS}) + 1) AS BIGINT), 0) AS row")
CELLS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 's' WHEN o_orderkey % 5 = 1 THEN 'inlineStr' WHEN o_orderkey % 5 = 2 THEN 'b' WHEN o_orderkey % 5 = 3 THEN '' ELSE 's' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN '1' WHEN o_orderkey % 3 = 1 THEN '99' ELSE 'x' END AS v, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS inl, o_orderstatus AS st FROM {orders}"
over("cell_value", CELLS, {"shown": lambda: text.cell_value(c("kind"), c("v"), F.array(c("st"), F.lit("second")), c("inl"), F.array(F.lit("r1"), c("st")))}, "CASE WHEN kind = 's' THEN CASE WHEN v = '1' THEN 'second' ELSE v END WHEN kind = 'inlineStr' THEN CASE WHEN inl <> '' THEN inl ELSE 'r1' || st END WHEN kind = 'b' THEN CASE WHEN v = '1' THEN 'Yes' ELSE 'No' END ELSE v END AS shown")

# --- pages ----------------------------------------------------------------------------------------------------------------------------

PAGES_AND_SYNTH = f"(SELECT page_id AS id, url AS path, html FROM pages UNION ALL SELECT id, path, html FROM {synth.duck(synth.HTML)})"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages and all synthetic ones."""
    real = spark.read.parquet(f"{d}/pages.parquet").select(c("page_id").alias("id"), c("url").alias("path"), "html")
    return real.unionByName(synth.frame(spark, d, synth.HTML))


HTML_STEMMED = "array_to_string(list_transform(list_filter(string_split(translate(regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '\\.[^.]*$', ''), '-_', '  '), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
TITLE_SQL = clean(f"coalesce(nullif(regexp_extract(html, {q(el('title'))}, 1), ''), nullif(regexp_extract(html, {q(el('h1'))}, 1), ''), {HTML_STEMMED})")
BODY_STEPS = [f"CASE WHEN regexp_extract(html, {q(el('body'))}, 1) <> '' THEN regexp_extract(html, {q(el('body'))}, 1) ELSE html END", *(sub("x", el(t, ".*?"), "") for t in html.DROPPED)]
HEAD_STEPS = [each("x", el(f"h{n}"), f"chr(10) || chr(10) || '{'#' * n} ' || {clean(strip_('g1'))} || chr(10) || chr(10)") for n in range(6, 0, -1)]
COMMON = lambda s: swap_(s, *html.COMMON)
CODE_STEP = each("x", f"(?is)<pre(?:{GAP}[^>]*)?>(?:<code(?:{GAP}[^>]*)?>)?(.+?)(?:</code{GAP}*>)?</pre{GAP}*>", f"chr(10) || chr(10) || '```' || regexp_extract(@w, {q('(?i)class=' + chr(34) + '[^' + chr(34) + ']*(?:language-|lang-)([0-9A-Za-z_]+)')}, 1) || chr(10) || {trim_(COMMON(strip_('g1')))} || chr(10) || '```' || chr(10) || chr(10)")
QUOTE_STEP = each("x", el("blockquote"), f"chr(10) || chr(10) || '> ' || {clean(strip_('g1'))} || chr(10) || chr(10)")
LI = lambda g: f"list_transform(regexp_extract_all({g}, {q(el('li'))}, 1), lambda li: {clean(strip_('li'))})"
LIST_STEPS = [each("x", el("ul"), f"chr(10) || array_to_string(list_transform({LI('g1')}, lambda it: '- ' || it), chr(10)) || chr(10)"), each("x", el("ol"), f"chr(10) || array_to_string(list_transform({LI('g1')}, lambda it, n: CAST(n AS STRING) || '. ' || it), chr(10)) || chr(10)")]
PARA_STEP = each("x", el("p"), f"chr(10) || chr(10) || {trim_('g1')} || chr(10) || chr(10)")
HR_STEP = sub("x", f"(?i)<hr{GAP}*/?{GAP}*>", "\n\n---\n\n")
mark = lambda tags, m: sub("x", el(f"(?:{tags})"), f"{m}\\1{m}")
INLINE_STEPS = [mark("strong|b", "**"), mark("em|i", "*"), mark("code", "`"), mark("del|s|strike", "~~"), sub("x", f"(?i)<br{GAP}*/?{GAP}*>", "\n")]
LINK_STEP = each("x", f'(?is)<a{GAP}[^>]*href="([^"]*)"[^>]*>(.+?)</a{GAP}*>', f"CASE WHEN g1 IN ('', '#') THEN {clean(strip_('g2'))} ELSE '[' || {clean(strip_('g2'))} || '](' || g1 || ')' END")
IMAGE_STEP = each("x", f'(?is)<img{GAP}[^>]*src="([^"]*)"[^>]*/?{GAP}*>', f"'![' || regexp_extract(@w, {q('(?i)alt=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1) || '](' || g1 || ')'")
ROW_CELLS = f"list_transform(regexp_extract_all(tr, {q(el('t[hd]'))}, 1), lambda td: {clean(strip_('td'))})"
TRS = f"regexp_extract_all(g1, {q(el('tr'))}, 1)"
GRID_OF = f"list_filter(list_transform({TRS}, lambda tr: {ROW_CELLS}), lambda cs: len(cs) > 0)"
W_OF = f"list_max(list_transform({GRID_OF}, lambda cs: len(cs)))"
LINE_OF = f"'|' || array_to_string(list_transform(list_resize(cs, {W_OF}, ''), lambda v: ' ' || v || ' |'), '') || chr(10)"
TABLE_STEP = each(
    "x",
    el("table"),
    f"CASE WHEN len({TRS}) = 0 THEN @w WHEN len({GRID_OF}) = 0 THEN '' ELSE chr(10) || chr(10) || list_transform({GRID_OF}[1:1], lambda cs: {LINE_OF})[1] || '|' || repeat(' --- |', {W_OF}) || chr(10) || array_to_string(list_transform({GRID_OF}[CASE WHEN len(list_filter({TRS}, lambda tr: contains(tr, '<th'))) > 0 THEN 2 ELSE 1 END:], lambda cs: {LINE_OF}), '') || chr(10) END",
)
END_STEPS = [sub("x", "\\n{3,}", "\n\n"), sub("x", "[ \\t]+\\n", "\n"), f"{trim_(sub('x', '[ \\t]+$', ''))} || chr(10)"]


def page_query(name: str, function: Callable[[Column], Column], *steps: str) -> None:
    add(name, lambda spark, d: pages(spark, d).select("id", F.md5(function(c("html"))).alias("md5"), F.length(function(c("html"))).alias("n")), chain(PAGES_AND_SYNTH, "id, path, html", "html", *steps) + f" SELECT id, md5(x) AS md5, CAST(length(x) AS INTEGER) AS n FROM s{len(steps) + 1}")


add("html_title", lambda spark, d: pages(spark, d).select("id", html.html_title(c("html"), c("path")).alias("title")), f"SELECT id, {TITLE_SQL} AS title FROM {PAGES_AND_SYNTH}")
page_query("html_strip_tags", text.strip_tags, strip_("x"))
page_query("html_clean_text", lambda s: text.clean_text(text.strip_tags(s)), strip_("x"), clean("x"))
page_query("html_body", html.html_body, *BODY_STEPS)
page_query("html_headings", html.headings, *HEAD_STEPS)
page_query("html_code_blocks", html.code_blocks, CODE_STEP)
page_query("html_blockquotes", html.block_quotes, QUOTE_STEP)
page_query("html_tables", html.tables, TABLE_STEP)
page_query("html_lists", html.lists, *LIST_STEPS)
page_query("html_paragraphs", html.paragraphs, PARA_STEP)
page_query("html_rules", html.rules, HR_STEP)
page_query("html_inline", html.inline, *INLINE_STEPS)
page_query("html_links", html.links, LINK_STEP)
page_query("html_images", html.images, IMAGE_STEP)
page_query("html_whitespace", text.collapse_blank_lines, *END_STEPS)
ALL_STEPS = [*BODY_STEPS, *HEAD_STEPS, CODE_STEP, QUOTE_STEP, TABLE_STEP, *LIST_STEPS, PARA_STEP, HR_STEP, *INLINE_STEPS, LINK_STEP, IMAGE_STEP, strip_("x"), COMMON("x"), *END_STEPS]
add("html_to_markdown", lambda spark, d: pages(spark, d).select("id", html.html_to_markdown(c("html"), c("path")).alias("md")), chain(PAGES_AND_SYNTH, "id, path, html", *ALL_STEPS) + f" SELECT id, '---' || chr(10) || 'title: ' || {TITLE_SQL} || chr(10) || '---' || chr(10) || chr(10) || x AS md FROM s{len(ALL_STEPS)}")

# --- plain text -----------------------------------------------------------------------------------------------------------------------

TEXTS = f"(SELECT doc_id AS id, 'd.txt' AS path, text AS content FROM documents UNION ALL SELECT id, path, content FROM {synth.duck(synth.TEXT)})"


def texts(spark: SparkSession, d: str) -> DataFrame:
    real = spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("id"), F.lit("d.txt").alias("path"), c("text").alias("content"))
    return real.unionByName(synth.frame(spark, d, synth.TEXT))


TXT_SQL = f"""WITH t AS (SELECT row_number() OVER () AS u, * FROM {TEXTS}), l AS (SELECT u, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM t),
m AS (SELECT *, {trim_('line')} AS s, starts_with(line, '    ') OR starts_with(line, chr(9)) AS ind FROM l),
f AS (SELECT u, min(i) AS first, min_by(s, i) AS title FROM m WHERE s <> '' GROUP BY u),
b AS (SELECT m.*, last_value(CASE WHEN s <> '' THEN ind END IGNORE NULLS) OVER (PARTITION BY u ORDER BY i) AS code0 FROM m JOIN f USING (u) WHERE i > first),
k AS (SELECT *, coalesce(code0, false) AS code, coalesce(lag(code0) OVER (PARTITION BY u ORDER BY i), false) AS was FROM b),
e AS (SELECT *, last_value(CASE WHEN NOT code THEN s = '' END IGNORE NULLS) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
o AS (SELECT u, i, CASE WHEN was AND NOT code THEN '```' || chr(10) || chr(10) WHEN code AND NOT was THEN '```' || chr(10) ELSE '' END ||
  CASE WHEN code THEN CASE WHEN starts_with(line, '    ') THEN line[5:] WHEN starts_with(line, chr(9)) THEN line[2:] ELSE line END || chr(10)
       WHEN s = '' THEN CASE WHEN coalesce(prev, false) THEN '' ELSE chr(10) END
       WHEN {CAPS('s')} THEN '## ' || s || chr(10) || chr(10) WHEN regexp_full_match(s, '={{3,}}|-{{3,}}') THEN '' ELSE s || chr(10) END AS piece, code FROM e),
j AS (SELECT u, string_agg(piece, '' ORDER BY i) || CASE WHEN max_by(code, i) THEN '```' || chr(10) ELSE '' END AS body FROM o GROUP BY u)
SELECT id, '---' || chr(10) || 'title: ' || title || chr(10) || 'style: minimal' || chr(10) || '---' || chr(10) || chr(10) || coalesce(body, '') AS md FROM t JOIN f USING (u) LEFT JOIN j USING (u)"""
add("txt_to_markdown", lambda spark, d: texts(spark, d).where(~text.is_blank(c("content"))).select("id", plaintext.txt_to_markdown(c("content"), c("path")).alias("md")), TXT_SQL)
DOC_LINES = "(SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))


add("txt_line_kinds", lambda spark, d: doc_lines(spark, d).select("id", "n", plaintext.is_caps_heading(c("line")).alias("caps"), plaintext.is_underline(c("line")).alias("underline"), plaintext.is_list_item(c("line")).alias("item"), plaintext.is_indented(c("line")).alias("indented")), f"SELECT id, CAST(n AS INTEGER) AS n, {CAPS('line')} AS caps, regexp_full_match(line, '={{3,}}|-{{3,}}') AS underline, regexp_matches(line, '^(?:[-*+] |[0-9]{{1,3}}[.)] )') AS item, starts_with(line, '    ') OR starts_with(line, chr(9)) AS indented FROM {DOC_LINES}")

# --- canonical Markdown ---------------------------------------------------------------------------------------------------------------

MD = synth.duck(synth.MARKDOWN)
MD_LINES = f"""l AS (SELECT id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM {MD}),
m AS (SELECT *, {trim_('line')} AS s FROM l), fe AS (SELECT id, min(i) AS e FROM m WHERE i > 1 AND s = '---' AND id IN (SELECT id FROM m WHERE i = 1 AND s = '---') GROUP BY id),
fl AS (SELECT m.* FROM m JOIN fe USING (id) WHERE i > 1 AND i < e), b0 AS (SELECT m.*, starts_with(s, '[^') AND contains(s, ']:') AS note FROM m LEFT JOIN fe USING (id) WHERE i > coalesce(e, 0)),
fv AS (SELECT id, i, lower({trim_("split_part(line, ':', 1)")}) AS k, regexp_replace({trim_("substr(line, strpos(line, ':') + 1)")}, '^(?:"(.*)"|''(.*)'')$', '\\1\\2') AS v FROM fl WHERE contains(line, ':')),
kv AS (SELECT * FROM fv WHERE v <> '')"""


def value_sql(*keys: str) -> str:
    return f"max_by(v, i) FILTER (k IN ({', '.join(repr(x) for x in keys)}))"


def md_docs(spark: SparkSession, d: str) -> DataFrame:
    return markdown.documents(synth.frame(spark, d, synth.MARKDOWN))


FLAG = lambda v: f"(lower({v}) = 'true' OR {v} = 'yes')"
META = f"meta AS (SELECT id, {value_sql('title')} AS title, {value_sql('status')} AS status, {value_sql('author')} AS author, {value_sql('language', 'lang')} AS lang, {value_sql('toc')} AS toc, {value_sql('font-size', 'fontsize')} AS font, {value_sql('summary')} AS summary, {value_sql('date')} AS date, {value_sql('signatures')} AS sig FROM kv GROUP BY id)"
BODY = f"""bl AS (SELECT *, starts_with(s, '```') AS fence FROM b0 WHERE NOT note), bf AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) % 2 = 1 OR fence AS inside FROM bl),
tt AS (SELECT bf.id, min(i) AS pos FROM bf LEFT JOIN meta ON meta.id = bf.id WHERE NOT inside AND starts_with(line, '# ') AND coalesce(title, '') = '' GROUP BY bf.id),
tl AS (SELECT bf.*, CASE WHEN inside THEN 0 ELSE length(regexp_extract(line, '^(#{{1,4}}) ', 1)) END AS level, pos FROM bf LEFT JOIN tt USING (id)),
ttl AS (SELECT id, substr(line, 3) AS h1 FROM tl WHERE i = pos), sl AS (SELECT id, i, line, level, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS sec FROM tl WHERE pos IS NULL OR i <> pos),
secs AS (SELECT id, sec, max(level) AS level, ltrim(max_by(line, level), '# ') AS title, coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (level = 0), '') AS content FROM sl WHERE sec > 0 GROUP BY id, sec),
ids AS (SELECT id FROM {MD}), pre AS (SELECT id, string_agg(line, chr(10) ORDER BY i) AS preamble FROM sl WHERE sec = 0 GROUP BY id),
titles AS (SELECT ids.id, coalesce(nullif(coalesce(meta.title, h1), ''), 'Document') AS title FROM ids LEFT JOIN meta USING (id) LEFT JOIN ttl USING (id))"""
MD_WITH = f"WITH {MD_LINES}, {META}, {BODY}"
add(
    "md_frontmatter",
    lambda spark, d: synth.frame(spark, d, synth.MARKDOWN).withColumn("doc", markdown.metadata(c("md"))).select("id", *(c(f"doc.{x}").alias(x) for x in ("status", "author", "language", "summary", "date", "version", "classification", "font_size", "toc"))),
    f"{MD_WITH} SELECT ids.id, upper(coalesce(status, 'DRAFT')) AS status, coalesce(author, '') AS author, coalesce(lang, '') AS language, coalesce(summary, '') AS summary, coalesce(date, '') AS date, '1.0' AS version, 'CONFIDENTIAL' AS classification, CASE font WHEN '10' THEN 10 WHEN '12' THEN 12 ELSE 11 END AS font_size, {FLAG('toc')} AS toc FROM ids LEFT JOIN meta USING (id)",
)
add("md_title", lambda spark, d: md_docs(spark, d).select("id", c("doc.title").alias("title")), f"{MD_WITH} SELECT id, title FROM titles")
add("md_preamble", lambda spark, d: md_docs(spark, d).select("id", c("doc.raw_preamble").alias("preamble")), f"{MD_WITH} SELECT ids.id, coalesce(preamble, '') AS preamble FROM ids LEFT JOIN pre USING (id)")
add("md_sections", lambda spark, d: markdown.section_rows(synth.frame(spark, d, synth.MARKDOWN).withColumn("doc", markdown.outline(c("md"))), "id"), f"{MD_WITH} SELECT id, CAST(sec AS INTEGER) AS section_no, CAST(level AS INTEGER) AS level, title, content FROM secs")
add(
    "md_footnotes",
    lambda spark, d: md_docs(spark, d).select("id", F.explode_outer("doc.footnotes").alias("note", "text")).where("note is not null"),
    f"WITH {MD_LINES}, n AS (SELECT id, i, substr(s, 3, strpos(s, ']:') - 3) AS note, {trim_('substr(s, strpos(s, %s) + 2)' % q(']:'))} AS t FROM b0 WHERE note) SELECT id, note, max_by(t, i) AS text FROM n WHERE note <> '' GROUP BY id, note",
)
add("md_fences", lambda spark, d: md_docs(spark, d).select("id", F.size(F.filter(F.flatten(F.transform("doc.sections", lambda s: F.split(s["content"], "\n"))), lambda x: text.trimmed(x).startswith("```"))).alias("fences")), f"{MD_WITH} SELECT ids.id, CAST(count(*) FILTER (starts_with({trim_('line')}, '```')) AS INTEGER) AS fences FROM ids LEFT JOIN (SELECT * FROM sl WHERE sec > 0) USING (id) GROUP BY ids.id")
TYPE_SQL = lambda s: "CASE " + " ".join(f"WHEN regexp_matches(lower({s}), '{'|'.join(words)}') THEN '{k}'" for k, words in text.TYPE_WORDS) + " ELSE 'document' END"
STYLE_SQL = lambda s: "CASE " + " ".join(f"WHEN {s} = '{k}' THEN '{v}'" for k, v in text.TYPE_STYLES.items()) + " ELSE 'report' END"
SIGN_SQL = "regexp_matches(lower(title), '" + "|".join(text.SIGNATURE_WORDS) + "')"
DOC_TITLES = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS title FROM documents"


def doc_titles(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"))


add("doc_type", lambda spark, d: doc_titles(spark, d).select("id", text.doc_type(c("title")).alias("doc_type")), f"SELECT id, {TYPE_SQL('title')} AS doc_type FROM ({DOC_TITLES})")
add("doc_style", lambda spark, d: md_docs(spark, d).select("id", c("doc.doc_type").alias("doc_type"), c("doc.style").alias("style")), f"{MD_WITH}, ty AS (SELECT id, {TYPE_SQL('title')} AS doc_type FROM titles) SELECT id, doc_type, {STYLE_SQL('doc_type')} AS style FROM ty")
add("signatures", lambda spark, d: md_docs(spark, d).select("id", c("doc.has_signatures").alias("has_signatures")), f"{MD_WITH}, ty AS (SELECT id, title, {TYPE_SQL('title')} AS doc_type FROM titles) SELECT id, {STYLE_SQL('doc_type')} = 'legal' AND {SIGN_SQL} OR coalesce({FLAG('sig')}, false) AS has_signatures FROM ty LEFT JOIN (SELECT id, sig FROM meta) USING (id)")
add("toc_and_passes", lambda spark, d: md_docs(spark, d).select("id", markdown.show_toc(c("doc")).alias("toc"), markdown.passes(c("doc")).alias("passes")), f"{MD_WITH}, n AS (SELECT ids.id, coalesce({FLAG('toc')}, (SELECT count(*) FROM secs WHERE secs.id = ids.id) >= 3) AS toc FROM ids LEFT JOIN meta USING (id)) SELECT id, toc, CASE WHEN toc THEN 2 ELSE 1 END AS passes FROM n")
OPTIONS = render.Options(title="Given", status="active", language="lv", toc=False, no_signatures=True, font_size=12)
add(
    "overrides",
    lambda spark, d: md_docs(spark, d).select("id", render.with_options(c("doc"), OPTIONS).alias("doc")).select("id", *(c(f"doc.{x}").alias(x) for x in ("title", "status", "language", "toc", "has_signatures", "font_size", "author", "doc_type"))),
    f"{MD_WITH} SELECT titles.id, 'Given' AS title, 'ACTIVE' AS status, 'lv' AS language, false AS toc, false AS has_signatures, 12 AS font_size, coalesce(author, '') AS author, {TYPE_SQL('titles.title')} AS doc_type FROM titles LEFT JOIN (SELECT id, author FROM meta) USING (id)",
)

# --- LaTeX ----------------------------------------------------------------------------------------------------------------------------

PARKED = (("\\", "\x00B\x00"), ("~", "\x00T\x00"), ("^", "\x00C\x00"))
BACK = (("\x00B\x00", latex.BACKSLASH), ("\x00T\x00", latex.TILDE), ("\x00C\x00", latex.CARET))


def emoji_sql(s: str) -> str:
    """Latin-1 symbols are parked while the other engine's symbol class runs."""
    latin = [(chr(n), f"\x01{n}\x01") for n in (0xA6, 0xA9, 0xAE, 0xB0)]
    gone = sub(swap_(s, *latin), r"[\x{1F001}-\x{10FFFF}\x{2600}-\x{27BF}\x{2B50}-\x{2B55}\x{FE00}-\x{FE0F}\x{200D}\p{So}]", "")
    return swap_(gone, *((b, a) for a, b in latin))


def escape_sql(s: str) -> str:
    parked = [(a, b.replace("\x00", "\x02")) for a, b in PARKED]
    back = [(a.replace("\x00", "\x02"), b) for a, b in BACK]
    return swap_(emoji_sql(s), *parked, *((x, "\\" + x) for x in latex.SPECIAL), *back)


INLINES = synth.duck(synth.INLINE)
MATH_SQL = lambda s: swap_(s, (r"\_", "_"), (r"\{", "{"), (r"\}", "}"), (latex.CARET, "^"), (r"\#", "#"), (r"\&", "&"))
DISPLAY = each("x", r"\\\$\\\$(.+?)\\\$\\\$", f"{q(chr(92) + '[')} || {MATH_SQL('g1')} || {q(chr(92) + ']')}")
INMATH = each("x", r"\\\$([^$]+?)\\\$", f"'$' || {MATH_SQL('g1')} || '$'")
BOLD = [sub("x", r"\*\*(.+?)\*\*", r"\\textbf{\1}"), sub("x", r"\*(.+?)\*", r"\\textit{\1}")]
RAW = ((latex.BACKSLASH, "\\"), *(("\\" + x, x) for x in "&%$#_{}"), (latex.TILDE, "~"), (latex.CARET, "^"))
AGAIN = (("\\", latex.BACKSLASH), ("~", latex.TILDE), ("^", latex.CARET), *((x, "\\" + x) for x in "_#$%&{}"))
CODE = each("x", "`([^`]+)`", f"{q(chr(92) + 'texttt{')} || {swap_('g1', *RAW, *AGAIN)} || '}}'".replace("}}'", "}'"))
URL = swap_("g2", (r"\_", "_"), (r"\#", "#"), (r"\%", "%"), (r"\&", "&"), (latex.TILDE, "~"))
HREF = f"{q(chr(92) + 'href{')} || {swap_(URL, ('#', chr(92) + '#'), ('%', chr(92) + '%'))} || '}}{{' || g1 || '}}'".replace("{{", "{").replace("}}", "}")
LINK = each("x", r"\[([^\]]+)\]\(([^)]+)\)", f"CASE WHEN starts_with({URL}, '#') THEN g1 WHEN ends_with({URL}, '.md') OR contains({URL}, '.md#') THEN {q(chr(92) + 'textbf{')} || g1 || '}}' WHEN contains({URL}, '#') THEN {HREF} ELSE {HREF} || {q(chr(92) + 'footnote{' + chr(92) + 'url{')} || {URL} || '}}}}' END")
NOTES = {"1": "a & b", "n": "n_1 ~"}
NOTE = each("x", r"\[\\textasciicircum\{\}([0-9A-Za-z_]+)\]", "CASE g1 " + " ".join(f"WHEN '{k}' THEN {q(chr(92) + 'footnote{')} || {escape_sql(q(v))} || '}}'" for k, v in NOTES.items()) + " ELSE @w END")
CITE = sub("x", r"\[@([^\]]+)\]", r"\\textsuperscript{[\1]}")


def notes() -> Column:
    return F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))


def inline_query(name: str, function: Callable[[Column], Column], *steps: str) -> None:
    add(name, lambda spark, d: synth.frame(spark, d, synth.INLINE).select("id", function(latex.escape_latex(c("line"))).alias("x")), chain(INLINES, "id", escape_sql("line"), *steps).replace("SELECT id, " + escape_sql("line"), "SELECT id, " + escape_sql("line"), 1) + f" SELECT id, x FROM s{len(steps) + 1}")


add("strip_emoji", lambda spark, d: synth.frame(spark, d, synth.INLINE).select("id", latex.strip_emoji(c("line")).alias("x")), f"SELECT id, {emoji_sql('line')} AS x FROM {INLINES}")
add("escape_latex", lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select(c("doc_id").alias("id"), latex.escape_latex(c("text")).alias("x")), f"SELECT doc_id AS id, {escape_sql('text')} AS x FROM documents")
inline_query("inline_math", lambda s: text.steps(s, latex.display_math, latex.inline_math), DISPLAY, INMATH)
inline_query("inline_bold_italic", latex.bold_italic, *BOLD)
inline_query("inline_code", latex.inline_code, CODE)
inline_query("inline_links", latex.links, LINK)
inline_query("footnote_refs", lambda s: latex.footnote_refs(s, notes()), NOTE)
inline_query("citations", latex.citations, CITE)
inline_query("inline_format", lambda s: latex.inline_format(s, notes()), DISPLAY, INMATH, *BOLD, CODE, LINK, NOTE, CITE)
T = trim_("line")
over("line_kinds", synth.LINES, {"separator": lambda: latex.is_separator(text.trimmed(c("line"))), "row": lambda: latex.is_table_row(text.trimmed(c("line"))), "rule": lambda: latex.is_rule(text.trimmed(c("line"))), "item": lambda: F.coalesce(latex.list_kind(text.trimmed(c("line"))), F.lit("")), "depth": lambda: latex.list_depth(c("line")), "mark": lambda: latex.task_mark(text.trimmed(c("line"))), "body": lambda: latex.item_text(text.trimmed(c("line")))}, f"""regexp_full_match({T}, {q(chr(92) + '|[-' + GAP[1:-1] + '|:]+' + chr(92) + '|')}) AS separator, starts_with({T}, '|') AND ends_with({T}, '|') AS row, {T} IN ('---', '***', '___') AS rule,
CASE WHEN regexp_matches({T}, '^[-*+] ') THEN 'itemize' WHEN regexp_matches({T}, {q('^[0-9]+' + chr(92) + '.' + GAP)}) THEN 'enumerate' ELSE '' END AS item, CAST((length(regexp_extract(line, {q('^([ ' + chr(92) + 't]*)')}, 1)) + 3 * (length(regexp_extract(line, {q('^([ ' + chr(92) + 't]*)')}, 1)) - length(replace(regexp_extract(line, {q('^([ ' + chr(92) + 't]*)')}, 1), chr(9), '')))) // 2 AS INTEGER) AS depth,
CASE WHEN regexp_matches({T}, {q('^- ' + chr(92) + '[[xX]' + chr(92) + '] ')}) THEN {q('$' + chr(92) + 'boxtimes$ ')} WHEN starts_with({T}, '- [ ] ') THEN {q('$' + chr(92) + 'square$ ')} ELSE '' END AS mark, regexp_replace({T}, {q('^(?:- ' + chr(92) + '[[ xX]' + chr(92) + '] |[-*+] |[0-9]+' + chr(92) + '.' + GAP + ')')}, '') AS body""")
CELLS_SQL = f"list_transform(string_split(trim({T}, '|'), '|'), lambda v: {trim_('v')})"
over("table_cells", synth.LINES, {"cells": lambda: F.array_join(latex.table_cells(text.trimmed(c("line"))), "\x1f"), "merged": lambda: F.array_join(latex.merge_excess(latex.table_cells(text.trimmed(c("line"))), F.lit(2)), "\x1f")}, f"array_to_string({CELLS_SQL}, chr(31)) AS cells, array_to_string(CASE WHEN len({CELLS_SQL}) > 2 THEN [{CELLS_SQL}[1], array_to_string({CELLS_SQL}[2:], ' | ')] ELSE {CELLS_SQL} END, chr(31)) AS merged")
over("image_figure", synth.LINES, {"figure": lambda: latex.figure(text.trimmed(c("line")), F.lit("/base/dir"))}, f"CASE WHEN {T} = '![alt_1](img/../p.png)' THEN {q(chr(92) + 'begin{figure}[htbp]' + chr(10) + chr(92) + 'centering' + chr(10) + chr(92) + 'includegraphics[max width=' + chr(92) + 'textwidth, max height=0.4' + chr(92) + 'textheight]{/base/dir/p.png}' + chr(10) + chr(92) + 'caption{alt' + chr(92) + '_1}' + chr(10) + chr(92) + 'end{figure}')} WHEN {T} = '![](/abs.png)' THEN {q(chr(92) + 'begin{figure}[htbp]' + chr(10) + chr(92) + 'centering' + chr(10) + chr(92) + 'includegraphics[max width=' + chr(92) + 'textwidth, max height=0.4' + chr(92) + 'textheight]{/abs.png}' + chr(10) + chr(92) + 'end{figure}')} END AS figure")
TAGS = "SELECT o_orderkey AS id, " + synth.choose("o_orderkey", ("go", "Python", "c++", "RUST", "yaml", "text", "", "cobol", "makefile", "JSON", "R", "html")) + " AS tag, o_orderkey % 6 AS level, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) ELSE " + synth.choose("o_orderkey", ("FINAL", "ACTIVE", "DRAFT", "TEMPLATE", "draft", "CONFIDENTIAL", "INTERNAL", "PUBLIC", "public")) + " END AS word FROM {orders}"
over("code_language", TAGS, {"opening": lambda: latex.listing_begin(c("tag"))}, f"{q(chr(92) + 'begin{lstlisting}[')} || " + "CASE lower(tag) " + " ".join(f"WHEN '{t}' THEN '{'language=' + n + ',' if n else ''}'" for t, n in latex.LANGUAGES.items()) + " ELSE '' END || 'style=codestyle]' AS opening")
over("section_command", TAGS, {"command": lambda: text.section_command(c("level"))}, "CASE level WHEN 1 THEN 'section' WHEN 2 THEN 'subsection' WHEN 3 THEN 'subsubsection' ELSE 'paragraph' END AS command")
over("status_color", TAGS, {"color": lambda: text.status_color(c("word"))}, "CASE WHEN word IN ('FINAL', 'ACTIVE') THEN 'statusgreen' WHEN word = 'DRAFT' THEN 'statusamber' WHEN word = 'TEMPLATE' THEN 'statusblue' ELSE 'medgray' END AS color")
over("class_label", TAGS, {"label": lambda: text.class_label(c("word"))}, "CASE word WHEN 'CONFIDENTIAL' THEN 'CONFIDENTIAL' WHEN 'INTERNAL' THEN 'INTERNAL USE ONLY' WHEN 'PUBLIC' THEN 'PUBLIC' ELSE '' END AS label")
ERRORS = "list_filter(string_split(log, chr(10)), lambda x: starts_with(x, '!') OR contains(x, 'Error') OR contains(x, 'Undefined control sequence') OR contains(x, 'Missing'))"
over("latex_error_summary", synth.LOG, {"summary": lambda: text.error_summary(c("log"))}, f"array_to_string(CASE WHEN len({ERRORS}) > 0 THEN {ERRORS}[1:5] ELSE string_split(log, chr(10))[greatest(1, len(string_split(log, chr(10))) - 9):] END, chr(10)) AS summary")
QUOTED = "SELECT o_orderkey AS id, '> one_' || CAST(o_orderkey AS STRING) || chr(10) || '>two' || chr(10) || '> ' || o_orderpriority AS block FROM {orders}"
over("quote_box", QUOTED, {"x": lambda: latex.quote_box(F.split("block", "\n"), notes())}, f"{q(chr(92) + 'begin{quotebox}' + chr(10))} || {escape_sql('array_to_string(list_transform(string_split(block, chr(10)), lambda v: regexp_replace(regexp_replace(%s, %s, %s), %s, %s)), chr(10) || chr(10))' % (trim_('v'), q('^> '), q(''), q('^>'), q('')))} || {q(chr(10) + chr(92) + 'end{quotebox}')} AS x")

ROW_BOLD = sub(sub(escape_sql("v"), r"\*\*(.+?)\*\*", r"\\textbf{\1}"), r"\*(.+?)\*", r"\\textit{\1}")
add(
    "table_rows_to_latex",
    lambda spark, d: synth.frame(spark, d, synth.LINES).where(latex.is_table_row(text.trimmed(c("line"))) & ~latex.is_separator(text.trimmed(c("line")))).select("id", *(latex.table_row(latex.table_cells(text.trimmed(c("line"))), h, notes()).alias(n) for n, h in (("head", True), ("body", False)))),
    f"SELECT id, array_to_string(list_transform({CELLS_SQL}, lambda v: {q(chr(92) + 'textbf{')} || {ROW_BOLD} || '}}'), ' & ') AS head, array_to_string(list_transform({CELLS_SQL}, lambda v: {ROW_BOLD}), ' & ') AS body FROM {synth.duck(synth.LINES)} t WHERE starts_with({T}, '|') AND ends_with({T}, '|') AND NOT regexp_full_match({T}, {q(chr(92) + '|[-' + GAP[1:-1] + '|:]+' + chr(92) + '|')})",
)


def xlsx_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A workbook a region, its nations in a sheet, read back from the file's bytes."""
    from ..sources.workbook import workbook, workbook_markdown

    ship(spark)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda n: F.concat(n["n_nationkey"].cast("string"), F.lit("|"), n["n_name"])), "\n")
    books = spark.read.parquet(f"{d}/nation.parquet").groupBy(c("n_regionkey").alias("id")).agg(synth.workbook_bytes()(rows).alias("content"))
    path = F.concat(F.lit("/x/region_"), c("id").cast("string"), F.lit(".xlsx"))
    return books.select("id", workbook(c("content")).alias("book")).select("id", workbook_markdown(c("book"), path, F.lit("/x")).alias("md"))


add(
    "xlsx_to_markdown",
    xlsx_to_markdown,
    """SELECT n_regionkey AS id, '---' || chr(10) || 'title: Region ' || CAST(n_regionkey AS STRING) || chr(10) || 'style: report' || chr(10) || '---' || chr(10) || chr(10) || '## Nations' || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
|| string_agg('| ' || CAST(n_nationkey AS STRING) || ' | ' || n_name || ' |' || chr(10), '' ORDER BY n_nationkey) || chr(10) || '*' || CAST(count(*) AS STRING) || ' rows, 2 columns*' || chr(10) || chr(10) AS md FROM nation GROUP BY n_regionkey""",
)


def render_latex(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered(md_docs(spark, d), generated_date="2024-01-01").select("id", c("doc.style").alias("style"), "latex")


add("render_latex", render_latex)


def list_render(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.blocks import latex_bodies

    ship(spark)
    lines = synth.frame(spark, d, synth.LINES).select(F.floor(c("id") / 8).alias("id"), F.struct("id", "line").alias("l"))
    docs = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("md"))
    return docs.select("id", latex_bodies(F.array("md"), F.expr("cast(map() as map<string,string>)"), F.lit(""))[0].alias("latex"))


add("list_render", list_render)

# --- analytics over documents ---------------------------------------------------------------------------------------------------------

add("sections_by_style", lambda spark, d: md_docs(spark, d).groupBy(c("doc.style").alias("style")).agg(F.count("*").alias("documents"), F.sum(F.size("doc.sections")).alias("sections"), F.max(F.array_max(F.transform("doc.sections", lambda s: s["level"]))).alias("deepest")), f"{MD_WITH}, ty AS (SELECT id, {STYLE_SQL(TYPE_SQL('title'))} AS style FROM titles), per AS (SELECT id, count(*) AS n, max(level) AS deep FROM secs GROUP BY id) SELECT style, count(*) AS documents, CAST(sum(coalesce(n, 0)) AS BIGINT) AS sections, CAST(max(deep) AS INTEGER) AS deepest FROM ty LEFT JOIN per USING (id) GROUP BY style")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the style of their title."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(html.html_title(c("html"), c("url")).alias("title"), F.length(text.clean_text(text.strip_tags(html.html_body(c("html"))))).alias("chars"))
    return rows.groupBy(text.style_for(text.doc_type(c("title"))).alias("style")).agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))


P_TITLE = TITLE_SQL.replace("path", "url")
add("pages_by_style", flagship, chain("(SELECT page_id AS id, url AS path, html FROM pages)", "id, path, html", *BODY_STEPS, clean(strip_("x"))) + f", ty AS (SELECT {TYPE_SQL(TITLE_SQL)} AS k, length(x) AS n FROM s{len(BODY_STEPS) + 1}) SELECT {STYLE_SQL('k')} AS style, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM ty GROUP BY 1")
