"""Inputs that the raw tables lack (headings, tables, fences, lists, grids), written once in SQL that both engines read.

``{orders}`` and the like stand for tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
K = "CAST(o_orderkey AS STRING)"

#: A word for each document type, two of them by accident of spelling.
WORDS = ("Service Agreement", "Agenda", "Privacy Policy", "Decision", "Rapid Capital", "Annual Report", "Cover Letter", "Budget", "Invoice", "Memo", "Research Paper", "Overview")


def choose(of: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {of} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


TITLE = choose("o_orderkey", WORDS)

PATHS = f"""SELECT o_orderkey AS id, '/data/part.' || CAST(o_orderkey % 5 AS STRING) || '/' ||
  CASE WHEN o_orderkey % 13 = 0 THEN 'README' WHEN o_orderkey % 17 = 0 THEN 'a.b_c-d' ELSE 'q3_sales-' || lower(o_orderpriority) || '__x-' || {K} END ||
  {choose('o_orderkey', ('.md', '.CSV', '.xlsx', '.xls', '.TXT', '.html', '.htm', '.markdown', '', '.pdf'))} AS path FROM {{orders}}"""

CSV_TEXT = f"""SELECT o_orderkey AS id, {choose('o_orderkey', ('a,b,c', 'a;b;c', 'a' + '\t' + 'b' + '\t' + 'c', 'a;b,c', 'abc', 'a;b;c,d' + '\t' + 'e', ''))} || {NL} || 'x;;;;' || {K} AS content FROM {{orders}}"""

#: Rows are parted by line breaks, cells by pipes; rows differ in length.
GRID = f"""SELECT o_orderkey AS id, '/x/grid_' || {K} || '.csv' AS path, 'key|prio rity| status ' || {NL} || {K} || '|' || o_orderpriority ||
  CASE WHEN o_orderkey % 3 = 0 THEN '|' || o_orderstatus || '|extra' ELSE '' END || {NL} || '  |only' ||
  CASE WHEN o_orderkey % 4 = 0 THEN {NL} || 'Prose: ' || repeat(o_orderpriority || ' and ', 12) WHEN o_orderkey % 4 = 1 THEN {NL} || 'last|row' ELSE '' END AS grid FROM {{orders}}"""

SHEET = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN repeat('Long prose ' || o_orderpriority || ' ', 10) || {NL} || 'SHORT TITLE' || {NL} || 'word' || {NL} || 'two words' || {NL} || repeat('More text here ', 9) || {NL} || repeat('And more text ', 9) || {NL} || repeat('Still more text ', 9)
  WHEN o_orderkey % 5 = 1 THEN 'a|b' || {NL} || 'c|d' || {NL} || repeat('Paragraph between ', 6) || '|' || {NL} || '|' || {NL} || 'e|f' || {NL} || ' | ' || {NL} || repeat('Paragraph at the end ', 6) || '|'
  WHEN o_orderkey % 5 = 2 THEN 'h1|h2|h3' || {NL} || {K} || '|' || o_orderstatus || '| x '
  WHEN o_orderkey % 5 = 3 THEN repeat('Opening paragraph ', 6) || '|' || {NL} || 'k|v' || {NL} || 'one|' || {K}
  ELSE 'only' END AS grid FROM {{orders}}"""

MARKDOWN = f"""SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN '---' || {NL} || 'title: ' || {TITLE} || ' ' || {K} || {NL} || 'STATUS: final' || {NL} || 'no colon here' || {NL} || 'toc: ' || {choose('o_orderkey', ('true', 'no', 'yes', 'YES', 'TRUE'))} || {NL} || 'author: "Ann ' || o_orderpriority || '"' || {NL} || 'lang: en' || {NL} || 'font-size: ' || {choose('o_orderkey', ('10', '11', '12', '13'))} || {NL} || 'summary:  ' || {NL} || 'date: ''2024-01-02''' || {NL} || 'signatures: false' || {NL} || 'author: Bob' || {NL} || ' --- ' || {NL}
       WHEN o_orderkey % 3 = 1 THEN '# ' || {TITLE} || ' ' || {K} || {NL}
       ELSE '---' || {NL} || 'title: never closed' || {NL} END
  || 'Intro ' || o_orderpriority || {NL} || '```' || {NL} || '# not a heading' || {NL} || '```' || {NL}
  || CASE WHEN o_orderkey % 2 = 0 THEN '# Second ' || {K} || {NL} || 'text' || {NL} ELSE '' END
  || '## Items #' || {K} || {NL} || '| key | status |' || {NL} || '| --- | :-: |' || {NL} || '| ' || {K} || ' | ' || o_orderstatus || ' | more |' || {NL}
  || CASE WHEN o_orderkey % 4 = 0 THEN '[^1]: first note' || {NL} || '[^]: dropped' || {NL} || ' [^n]: note ' || o_orderpriority || {NL} || '[^1]: last ' || {K} || {NL} ELSE '' END
  || '### ## Deep' || {NL} || {NL} || '> quoted' || {NL} || '>more' || {NL} || '#### Four' || {NL} || '##### five stays' || {NL}
  || CASE WHEN o_orderkey % 5 = 0 THEN '  ```python' || {NL} || '## in code' || {NL} || '```' || {NL} || '## After' || {NL} ELSE '##nothing' END AS md FROM {{orders}}"""

INLINE = f"""SELECT o_orderkey AS id, 'Order ' || {K} || ' ' ||
  {choose('o_orderkey', ('costs $5 and $6_a^2 now', 'is **bold _x_** and *it* & 100%', 'has `code_{x}\\y ~^ *z*` # end', 'see [the docs](http://a.b/c_d?x=1&y=%20) ok', 'see [part](#top) and [page](a/b.md#x) [y](c#d_e)', 'note[^1] and [^9] [@key_1] \\cmd', '$$E=mc^2_{x}$$ ~~gone~~ __no__', 'plain ' + chr(0x2705) + chr(0x1F600) + chr(0xA9) + chr(0x2211) + ' x', '**a** **b*c*d** `one` `two`', '[^1][^n] {a} a_b a~b'))}
  || ' ' || o_orderpriority AS line FROM {{orders}}"""

LINES = f"""SELECT o_orderkey AS id,
  {choose('o_orderkey', ('- item', '  * nested', '    + deeper', '1. first', '12. twelfth  x', '- [ ] todo_1', '- [x] done', '- [X] Done', chr(9) + '- tabbed', '1) no', '-no', '| a | **b** | c_d |', '| - | :-: |', '|| x ||', '![alt_1](img/../p.png)', '![](/abs.png)', '---', '___', '> quoted', '>', 'plain & text', '   ', '```go'))}
  || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ' ' END AS line FROM {{orders}}"""

LOG = f"""SELECT o_orderkey AS id, 'This is a log' || {NL} || {choose('o_orderkey', ('! Undefined', 'LaTeX Error: x', 'ok', 'a' + "' || chr(10) || '" + 'b', 'Missing $'))} || {NL} || repeat('line ' || o_orderpriority || {NL}, 12) || CASE WHEN o_orderkey % 2 = 0 THEN repeat('! again' || {NL}, 7) ELSE '' END AS log FROM {{orders}}"""

HTML = f"""SELECT o_orderkey AS id, '/w/page-' || {K} || '.html' AS path, '<html><head>' || CASE WHEN o_orderkey % 3 = 0 THEN '<title> T &amp; ' || {K} || ' </title>' ELSE '' END || '<style>p</style></head><BODY class="x">' ||
  CASE WHEN o_orderkey % 2 = 0 THEN '<h1 id="a">Head <b>one</b>' || {NL} || ' x</h1>' ELSE '<h2>Two</h2><h6>Six</h6>' END ||
  '<nav><ul><li>gone</li></ul></nav><p>Some <strong>bold</strong> <i>it</i> <code>c</code> <del>d</del><br/>next ' || o_orderpriority || '</p><script>x()</script>' ||
  '<ul class="u"><li>one</li><li> two <b>b</b></li></ul><ol><li>first</li><li>second</li></ol><hr/><blockquote>quo' || {NL} || ' ted</blockquote>' ||
  CASE WHEN o_orderkey % 4 = 0 THEN '<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr><tr><td>2</td><td></td><td>3</td></tr></table>' WHEN o_orderkey % 4 = 1 THEN '<table><tr><td>p</td><td>q</td></tr></table>' WHEN o_orderkey % 4 = 2 THEN '<table>none</table>' ELSE '<table><tr><p>x</p></tr></table>' END ||
  '<pre><code class="language-go">a &lt; b' || {NL} || ' <i>c</i></code></pre><a class="k" href="http://x/?a=1">link <b>t</b></a> <a href="#">top</a> <img src="i.png" alt="pic"> <IMG src="j.png">' ||
  '   tail &copy; &quot;q&quot;' || {NL} || {NL} || {NL} || {NL} || 'end  ' || {NL} || '</BODY><footer>f</footer></html>' AS html FROM {{orders}}"""

TEXT = f"""SELECT o_orderkey AS id, '/t/plain_' || {K} || '.txt' AS path, CASE WHEN o_orderkey % 6 = 0 THEN {NL} || '  ' || {NL} ELSE '' END || ' Title ' || {K} || {NL} || '=====' || {NL} || {NL} || {NL} || 'SECTION ' || o_orderstatus || {NL} || '- bullet' || {NL} || '2) two' || {NL} ||
  '    code line' || {NL} || {NL} || '      more' || {NL} || 'after ' || o_orderpriority || {NL} || {NL} || ' ' || {NL} || chr(9) || 'tab code' || {NL} ||
  CASE WHEN o_orderkey % 4 = 0 THEN 'ABC' || {NL} || {NL} || {NL} || 'x' WHEN o_orderkey % 4 = 1 THEN '    last' WHEN o_orderkey % 4 = 2 THEN '---' || {NL} || 'AB' ELSE '' END AS content FROM {{orders}}"""


def workbook_bytes():
    """A column function: lines of cells parted by pipes to the bytes of a workbook with a sheet of a header and these rows."""
    import pandas as pd
    from pyspark.sql import functions as F

    def build(s: pd.Series) -> pd.Series:
        import io
        import zipfile
        from xml.sax.saxutils import escape

        def book(text: str) -> bytes:
            grid = [["key", "name"], *(x.split("|") for x in text.split("\n"))]
            cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(grid, 1))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="Nations" sheetId="1"/></sheets></workbook>')
                z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
            return out.getvalue()

        return s.map(book)

    build.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(build, "binary")


TABLE = re.compile(r"\{(orders)\}")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The synthetic input as a DataFrame."""
    names = sorted(set(TABLE.findall(sql)))
    parts = TABLE.split(sql)  # texts and names in turn; braces of the texts are doubled, as they are no places of tables
    query = "".join("{" + x + "}" if i % 2 else x.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}") for i, x in enumerate(parts))
    return spark.sql(query, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """The same input as a subquery of the other engine."""
    return "(" + TABLE.sub(r"\1", sql) + ")"
