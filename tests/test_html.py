from vellumspark.functions import html


def test_title_falls_back(values):
    rows = [("<TITLE lang='x'> A\n b </TITLE><h1>H</h1>", "p"), ("<h1>H <b>x</b></h1>", "p"), ("<p>", "a/my-page.html")]
    assert values(html.html_title, rows, "s", "p") == ["A b", "H <b>x</b>", "My Page"]


def test_body_drops_blocks(values):
    assert values(html.html_body, ["<body><script>1</script>a<nav>\n</nav><style></style>b</body>c", "no body"]) == ["ab", "no body"]


def test_headings(values):
    assert values(html.headings, ["<h1 id='x'>A <i>b</i></h1>t<H6>s</H6>"]) == ["\n\n# A b\n\nt\n\n###### s\n\n"]


def test_code_and_quotes(values):
    assert values(html.code_blocks, ['<pre><code class="language-go">a &lt; b\n</code></pre>']) == ["\n\n```go\na < b\n```\n\n"]
    assert values(html.block_quotes, ["<blockquote>a\n <b>b</b></blockquote>"]) == ["\n\n> a b\n\n"]


def test_table_pads_and_repeats_a_header_without_th(values):
    rows = ["<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>", "<table><tr><td>p</td><td>q</td></tr></table>", "<table>x</table>", "<table><tr>x</tr></table>"]
    assert values(html.tables, rows) == ["\n\n| A | B |\n| --- | --- |\n| 1 |  |\n\n", "\n\n| p | q |\n| --- | --- |\n| p | q |\n\n", "<table>x</table>", ""]


def test_empty_cell_swallows_the_next(values):
    assert values(html.tables, ["<table><tr><td></td><td>x</td></tr></table>"]) == ["\n\n| x |\n| --- |\n| x |\n\n"]


def test_lists(values):
    assert values(html.lists, ["<ul><li>a</li><li> b</li></ul><ol><li>c</li><li>d</li></ol>"]) == ["\n- a\n- b\n\n1. c\n2. d\n"]


def test_inline_links_images(values):
    assert values(html.inline, ["<b>x</b><em>y</em><code>z</code><s>w</s><BR/>"]) == ["**x***y*`z`~~w~~\n"]
    assert values(html.links, ['<a href="">t</a><a class="k" href="u"> t <b>x</b></a><a href="#">q</a>']) == ["t[t x](u)q"]
    assert values(html.images, ['<img src="a" alt="b"><IMG alt="c" src="d" />']) == ["![b](a)![c](d)"]


def test_page(values):
    page = "<html><head><title>T</title></head><body><h2>S</h2><p>a &amp; b</p><script>x</script></body></html>"
    assert values(html.html_to_markdown, [(page, "p"), ("  ", "p"), (None, "p")], "s", "p") == ["---\ntitle: T\n---\n\n## S\n\na & b\n", None, None]


def test_rare_entities_go_to_python(spark, values):
    from vellumspark.shipping import ship

    ship(spark)
    assert values(html.decode_entities, ["a &lt; b", "&eacute;&#x41;&amp;lt;", "R&D", None]) == ["a < b", "éA&lt;", "R&D", None]
