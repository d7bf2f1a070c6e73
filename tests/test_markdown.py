import random

from vellumspark.operators import markdown


def parsed(values, *texts):
    return values(markdown.parse, list(texts))


def test_defaults_and_empty(values):
    for d in parsed(values, "", None):
        assert (d["title"], d["version"], d["status"], d["classification"], d["style"], d["font_size"], d["toc"]) == ("Document", "1.0", "DRAFT", "CONFIDENTIAL", "report", 11, None)
        assert d["sections"] == [] and d["footnotes"] == {} and d["raw_preamble"] == ""


def test_frontmatter(values):
    md = '---\nTitle: "An \\"x\\" Agreement"\nstatus: final\nnocolon\nlang: lv\nfont-size: 12\ntoc: yes\nsignatures: false\nauthor: \'A\'\nauthor: B: c\nempty:\n---\nbody'
    (d,) = parsed(values, md)
    assert (d["title"], d["status"], d["language"], d["font_size"], d["toc"], d["author"], d["style"]) == ('An "x" Agreement', "FINAL", "lv", 12, True, "B: c", "legal")
    assert d["has_signatures"] and d["raw_preamble"] == "body"


def test_yes_is_lower_case_only(values):
    a, b = parsed(values, "---\ntoc: YES\n---", "---\ntoc: TRUE\n---")
    assert a["toc"] is False and b["toc"] is True


def test_unclosed_frontmatter_is_text(values):
    (d,) = parsed(values, "---\ntitle: x")
    assert d["title"] == "Document" and d["raw_preamble"] == "---\ntitle: x"


def test_footnotes_last_wins_even_in_code(values):
    (d,) = parsed(values, "[^1]: a\n```\n [^b]: in code\n```\n[^1]: z\n[^]: gone")
    assert d["footnotes"] == {"1": "z", "b": "in code"} and d["raw_preamble"] == "```\n```"


def test_sections(values):
    (d,) = parsed(values, "# T\npre\n## A ##\nx\n```\n# no\n```\n### # b\n#### c\ny\n##### five\n#no")
    assert d["title"] == "T" and d["raw_preamble"] == "pre"
    assert [(s["level"], s["title"], s["content"]) for s in d["sections"]] == [(2, "A ##", "x\n```\n# no\n```\n"), (3, "b", ""), (4, "c", "y\n##### five\n#no\n")]
    assert values(lambda s: markdown.passes(markdown.parse(s)), ["## a\n## b", "## a\n## b\n## c"]) == [1, 2]


def test_second_h1_is_a_section_and_an_empty_one_is_tried_again(values):
    a, b = parsed(values, "# A\n# B", "# \n# B\n")
    assert a["title"] == "A" and a["sections"][0]["title"] == "B" and b["title"] == "B" and b["sections"] == []


def model(lines):
    """The line machine as a plain loop."""
    title, fence, sections, pre = "", False, [], []
    for line in lines:
        mark = line.strip().startswith("```")
        level = next((n for n in (4, 3, 2, 1) if line.startswith("#" * n + " ")), 0)
        if mark or fence:
            fence ^= mark
            level = 0
        elif line.startswith("# ") and not title:
            title = line[2:]
            continue
        if level:
            sections.append([level, line.lstrip("# "), ""])
        elif sections:
            sections[-1][2] += line + "\n"
        else:
            pre.append(line)
    return title or "Document", "\n".join(pre), sections


def test_against_a_plain_loop(values):
    rng = random.Random(3)
    pieces = ["", "# a", "# ", "## b", "### ", "#### d", "##### e", "```", " ```x", "text", "#", "x # y"]
    docs = ["\n".join(["x", *(rng.choice(pieces) for _ in range(rng.randint(0, 14)))]) for _ in range(300)]
    for md, d in zip(docs, parsed(values, *docs), strict=True):
        assert (d["title"], d["raw_preamble"], [list(s) for s in d["sections"]]) == model(md.split("\n")), md
