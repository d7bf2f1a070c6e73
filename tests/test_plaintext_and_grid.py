import random

from pyspark.sql import functions as F

from vellumspark.operators import grid, plaintext


def test_line_kinds(values):
    assert values(plaintext.is_caps_heading, ["ABC", "AB", "A1 -", "Abc", "123", "Ā" * 41, "X" * 80, "X" * 81]) == [True, False, True, False, False, False, True, False]
    assert values(plaintext.is_underline, ["===", "--", "-----", "=-="]) == [True, False, True, False]
    assert values(plaintext.is_list_item, ["- a", "1. a", "123) a", "1234. a", "-a", "1.a"]) == [True, True, True, False, False, False]


def model(text):
    lines = text.split("\n")
    first = next(i for i, x in enumerate(lines) if x.strip())
    out, code, empty = "", False, False
    for line in lines[first + 1 :]:
        t, ind = line.strip(), line.startswith(("    ", "\t"))
        if t and ind and not code:
            out, code = out + "```\n", True
        if t and not ind and code:
            out, code = out + "```\n\n", False
        if code:
            out += (line[4:] if line.startswith("    ") else line.removeprefix("\t")) + "\n"
        elif not t:
            out, empty = out + ("" if empty else "\n"), True
        else:
            empty = False
            if 3 <= len(t) <= 80 and t.upper() == t and any("A" <= c <= "Z" for c in t):
                out += f"## {t}\n\n"
            elif not (len(t) > 2 and set(t) in ({"="}, {"-"})):
                out += t + "\n"
    return f"---\ntitle: {lines[first].strip()}\nstyle: minimal\n---\n\n" + out + ("```\n" if code else "")


def test_text_against_a_plain_loop(values):
    rng = random.Random(5)
    pieces = ["", "  ", "    code", "\ttab", "     ", "text", "CAPS HERE", "====", "---", "- item", "  two spaces"]
    docs = ["\n".join(["", "Title", *(rng.choice(pieces) for _ in range(rng.randint(0, 14)))]) for _ in range(300)]
    got = values(plaintext.txt_to_markdown, [(x, "p.txt") for x in docs], "s", "p")
    assert got == [model(x) for x in docs]
    assert values(plaintext.txt_to_markdown, [(" \n", "p"), (None, "p")], "s", "p") == [None, None]


def rows_of(s):
    return F.transform(F.split(s, "\n"), lambda r: F.split(r, r"\|"))


def test_csv_markdown(values):
    got = values(lambda s: grid.csv_markdown(rows_of(s), F.lit("/x/my_file.csv")), ["a| b \n1\n2|3|4"])
    assert got == ["---\ntitle: My File\nstyle: report\n---\n\n## Data\n\n| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | 3 | 4 |\n\n*2 rows, 3 columns*\n"]


def test_sheets(values):
    prose = "p" * 80
    texts = [f"{prose}\n{prose}\nHEAD", f"{prose}|\na|b\n |\n{prose}|\nc|d", "a|b|c\n1|2|3", f"{prose}\nx"]
    assert values(lambda s: grid.sheet_kind(rows_of(s)), texts) == ["text", "mixed", "table", "table"]
    text, mixed = values(lambda s: grid.sheet_markdown(rows_of(s)), texts[:2])
    assert text == f"{prose}\n\n{prose}\n\n### HEAD\n\n".replace(f"{prose}\n\n", f"{prose}\n\n")
    assert mixed == f"{prose}\n\n| a | b |\n| --- | --- |\n|   |  |\n\n*1 rows, 2 columns*\n\n{prose}\n\n| c | d |\n| --- | --- |\n\n*0 rows, 2 columns*\n\n"
