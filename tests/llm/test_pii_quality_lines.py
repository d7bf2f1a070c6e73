import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from vellumspark.llm import line_dedup, pii, quality

PATTERNS = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == 1:
        return all(int(x) <= 255 for x in s.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if valid(k, m.group())]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    bits = ["a.b", "@", "x-y.com", "1", "22", ".", " ", "-", "+", "(555)", "4111111111111111", "4111 1111 1111 1111", "256", "10.0.0.1", "+1 (743) 555-3824", "é", "\n", "%", "0", "user@mail5.example.com"]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "1 " * 150_000, "a@b." * 75_000):
        assert pii.candidates(t, pii.base_spans(t)) is not None


def test_contexts_discover_unseen_identifiers(spark):
    texts = [f"please write to user{i}@mail{i}.example.com today" for i in range(8)]
    texts += ["please write to jane2024@localhost today", "the code 2024-77 is other", None, "", "please write to someone today"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [tuple(s) for s in rows[i]["base"]] == brute_spans(t or "")
        assert set(map(tuple, rows[i]["base"])) <= set(map(tuple, rows[i]["spans"]))
    (found,) = rows[8]["spans"]
    assert texts[8][found["start"] : found["end"]] == "jane2024@localhost" and found["kind"] == 0
    assert rows[9]["spans"] == []
    clean = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert clean[8]["text"] == "please write to [email] today" and clean[0]["text"] == "please write to [email] today"
    assert clean[9]["text"] == texts[9] and clean[10]["text"] is None and clean[11]["text"] == "" and clean[0]["spans"] == "x"


def test_contexts_discover_runs_words_and_long_tokens(spark):
    texts = [f"please write to user{i}@mail{i}.example.com today" for i in range(12)] + [f"please call +1 (743) 555-38{i} now" for i in range(10, 22)]
    texts += [f"the card 4111 1111 1111 {x} paid" for x in ("1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194", "1202", "1210", "1228")]
    hidden = {"call": ("phone", ["(020) 7946 0958", "555 123 4567", "555.123.4568"]), "card": ("card", ["4111 1111 1111 1112"]), "to": ("email", ["jane at example dot com", "j" * 90 + "2024@localhost"])}
    n, want = len(texts), []
    for word, (kind, values) in hidden.items():
        for v in values:
            texts.append({"call": f"please call {v} now", "card": f"the card {v} paid", "to": f"please write to {v} today"}[word])
            want.append((kind, v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert [{(pii.KINDS[s["kind"]], texts[n + i][s["start"] : s["end"]]) for s in rows[n + i]} for i in range(len(want))] == [{w} for w in want]


def test_discovered_values_make_more_patterns_trusted(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 1)
    seen = lambda before, values: [(v, k, before, "", "") for v, k in values]
    hop = [[(f"id{h}{i}", -1) for i in range(8)] for h in range(5)]
    occ = seen("w0", [*((f"seed{i}", 0) for i in range(40)), *hop[0]])
    for h in range(1, 5):
        occ += seen(f"w{h}", [*hop[h - 1], hop[h][0]]) + [(v, -1, f"w{h + 1}", "", "") for v, _ in hop[h][:1]]
        hop[h] = [hop[h][0], *hop[h - 1][1:]]
    found = {r["value"]: r["kind"] for r in pii.bootstrap(spark.createDataFrame(occ, "value string, kind int, before string, before2 string, after string")).collect()}
    assert {"id00", "id03", "id10", "id20", "id30", "id40"} <= set(found) and set(found.values()) == {0}


def brute_bootstrap(occ):
    """The same turns over sets in plain Python; ``occ``: (value, kind, words by name)."""
    known, least, edges, scores = {}, {}, defaultdict(set), {}
    for v, k, _ in occ:
        known[v], least[v] = max(known.get(v, k), k), min(least.get(v, k), k)
    for v, _, words in occ:
        for name, parts in pii.PATTERNS.items():
            if all(words.get(w) for w in parts):
                edges[" ".join([name, *(words[w] for w in parts)])].add(v)
    turn, reached = 0, (-1, -1)
    while True:
        errs = defaultdict(lambda: [0.0] * 4)
        trusted = 0
        for values in edges.values():
            share = []
            for k in range(4):
                seeds = sum(known[v] == k for v in values)
                gained = [scores[v][1] for v in values if v in scores and scores[v][0] == k]
                enough = seeds + sum(x >= pii.MIN_SCORE for x in gained) >= pii.MIN_SEEDS
                share.append(min(1.0, (seeds + sum(gained)) / len(values)) if enough else 0.0)
            trusted += max(share) >= pii.MIN_CONFIDENCE
            for v in values:
                for k in range(4):
                    if known[v] < 0 and max(share) >= pii.MIN_CONFIDENCE:
                        errs[v][k] += math.log(max(1 - share[k], 0.05)) if share[k] >= pii.MIN_CONFIDENCE else 0.0
        scores = {v: (e.index(min(e)), 1 - math.exp(min(e))) for v, e in errs.items()}
        turn += 1
        now = (sum(s >= pii.MIN_SCORE for _, s in scores.values()), trusted)
        if turn >= pii.ROUNDS and now[0] <= reached[0] and now[1] <= reached[1]:
            break
        reached = now
    return {v: s for v, s in scores.items() if s[1] >= pii.MIN_SCORE} | {v: (k, 1.0) for v, k in known.items() if k >= 0 and least[v] < 0}


def test_bootstrap_equals_plain_python(spark):
    rng = random.Random(31)
    found = 0
    for _ in range(2):
        occ = []
        for _ in range(1500):
            topic = rng.randint(0, 30)
            kind = topic % 4 if rng.random() < 0.9 - topic / 60 else rng.choice([-1, -1, -2, (topic + 1) % 4])
            occ.append((f"v{topic}x{rng.randint(0, 30)}" if rng.random() < 0.7 else f"w{rng.randint(0, 400)}", kind, {w: rng.choice(["", None, f"{w[0]}{topic}", f"{w[0]}{topic}", f"{w[0]}{topic % 7}"]) for w in pii.WORDS}))
        df = spark.createDataFrame([(v, k, *w.values()) for v, k, w in occ], "value string, kind int, " + ", ".join(f"{w} string" for w in pii.WORDS))
        got = {r["value"]: (r["kind"], r["score"]) for r in pii.bootstrap(df).collect()}
        want = brute_bootstrap(occ)
        assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
        assert all(abs(got[v][1] - want[v][1]) < 1e-9 for v in want)
        found += len(want)
    assert found > 20


def test_spans_over_two_hops(spark):
    texts = [f"please write to user{i}@mail{i}.example.com today" for i in range(24)]
    texts += [f"please write to nick{i}@home today" for i in range(6)] + [f"find nick{i}@home in the yard" for i in range(6)] + ["find someone4444@there in the yard", "lost code 4444 of a thing"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    cut = lambda i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in rows[i]]
    nicks = [[(0, f"nick{i}@home")] for i in range(6)]
    assert [cut(i) for i in range(24, 38)] == [*nicks, *nicks, [(0, "someone4444@there")], []]


def test_numbers_side_by_side_are_cut(spark):
    run = "+1 (269) 555-3296 4111111111111111"
    assert brute_spans(run) == [] and pii.parts(run, 0, len(run)) == [(0, 17), (18, 34)]
    assert pii.parts("12 4111 1111 1111 1111 7", 0, 24) == [(3, 22)] and pii.parts("1.2.3.4444", 0, 10) == []
    texts = [f"a word {i} +1 (743) 555-38{i} and more" for i in range(10, 22)] + [f"a word {i} {run} and more" for i in range(3)] + ["paid by 4111111111111111 now"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {(s["kind"], texts[12][s["start"] : s["end"]]) for s in rows[12]} >= {(2, "4111111111111111")}


def test_overlapping_spans_are_redacted_once(spark):
    t = "a +4111 1111 1111 1111 b 10.0.0.1 é u@v.wx"
    df = spark.createDataFrame([(None, t), (None, t)], "doc_id long, text string")
    got = [r["text"] for r in pii.redact(df).collect()]
    assert len(got) == 2 and got[0] == got[1] and not re.search("[0-9@]", got[0]) and got[0].startswith("a +[card] b [ip] é [email]")


def test_pii_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).collect() == [] and pii.redact(df).collect() == []


# --- quality


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def quality_texts():
    rng = random.Random(6)
    good = [prose(rng, rng.randint(60, 200)) for _ in range(60)]
    marked = [" ".join(w + "###" for w in prose(rng, 80).split()) for _ in range(8)]
    looped = ["buy this now " * 40 for _ in range(4)]
    odd = [None, "", "\u00a0", "a b", "a a a a a", "x\ny\nx\n \n", "é|<>" * 3, "w " * 30_000, "a b c d a b c"]
    return good, marked, looped, odd


def test_quality_counts_and_verdicts(spark):
    good, marked, looped, odd = quality_texts()
    texts = [*good, *marked, *looped, *odd]
    df = spark.createDataFrame([(i, t, True, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean, n_words double")
    rows = {r["id"]: r for r in quality.judge_quality(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        if t and len(t) > 50_000:
            assert r["n_repeat_words"] == r["n_words"] == 30_000
            continue
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    n = len(good)
    assert all(rows[i]["kept"] for i in range(n)) and not any(rows[i]["kept"] for i in range(n, len(texts)))
    kept = quality.keep_quality(df).select("doc_id", "kept").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(n)) and all(r["kept"] is True for r in kept)


def brute_em(counts, rounds=25, tolerance=1e-4):
    """The same estimation over single documents in plain Python."""
    prior, p = 0.7, [[list(c) for c in quality.START] for _ in range(quality.RULES)]
    for _ in range(rounds):
        good = {}
        for v in counts:
            a, b = prior, 1 - prior
            for j, x in enumerate(v):
                a, b = a * p[j][0][x + 1], b * p[j][1][x + 1]
            good[v] = a / (a + b)
        total = sum(counts.values())
        g = sum(n * good[v] for v, n in counts.items())
        w = 0.01 * total + 1
        new = [[[(sum(n * (good[v], 1 - good[v])[c] for v, n in counts.items() if v[j] == x) + w * quality.START[c][x + 1]) / ((g, total - g)[c] + w) for x in (-1, 0, 1)] for c in (0, 1)] for j in range(quality.RULES)]
        moved = max(abs(a - b) for s, t in zip(new, p, strict=True) for u, v in zip(s, t, strict=True) for a, b in zip(u, v, strict=True))
        prior, p = min(0.95, max(0.05, (g + 1) / (total + 2))), new
        if moved < tolerance:
            break
    return prior, p


def test_estimation_equals_plain_python(spark):
    rng = random.Random(9)
    counts = {}
    for _ in range(200):
        v = tuple(rng.choice([-1, 0, 1, 1]) for _ in range(quality.RULES))
        counts[v] = counts.get(v, 0) + rng.randint(1, 5)
    model = quality.fit_rules(spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long"))
    prior, p = brute_em(counts)
    assert abs(model["prior"] - prior) < 1e-9
    assert all(abs(a - b) < 1e-9 for s, t in zip(model["p"], p, strict=True) for u, v in zip(s, t, strict=True) for a, b in zip(u, v, strict=True))


def test_quality_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge_quality(df).collect() == [] and quality.keep_quality(df).collect() == []


# --- lines


def brute_lines(rows, min_sites=3, short_words=5, short_sites=8):
    sites, holders = {}, {}
    for doc, text, site in rows:
        for line in (text or "").split("\n"):
            k = line.strip(" \t\r\x0b\x0c")
            if k:
                sites.setdefault(k, set()).update([] if site is None else [site])
                holders.setdefault(k, []).append(doc)
    need = lambda k: short_sites if len(re.split(r"[ \t]+", k)) < short_words else min_sites
    keeper = {k: min((d for d in holders[k] if d is not None), default=None) for k in sites if len(sites[k]) >= need(k)}
    out = []
    for doc, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if (k := x.strip(" \t\r\x0b\x0c")) not in keeper or keeper[k] == doc]
        full = sum(bool(x.strip(" \t\r\x0b\x0c")) for x in lines)
        out.append((doc, None if text is None else "\n".join(left), full, full - sum(bool(x.strip(" \t\r\x0b\x0c")) for x in left)))
    return out


def test_lines_against_plain_python(spark):
    rng = random.Random(8)
    pool = [f"a line of several words number {i}" for i in range(12)] + ["Share", "All rights reserved.", "", "  ", "\t padded line of many more words \r"]
    rows = [(i, "\n".join([*(rng.choice(pool) for _ in range(rng.randint(0, 5))), f"own line {i} with enough words"]), f"s{rng.randint(0, 9)}") for i in range(120)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, pool[0], None), (203, "x " * 40_000, "s2"), (None, pool[1], "s3"), (5, pool[2], "s4")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, n_lines int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    key = lambda r: tuple(map(repr, r))
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_lines_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_large_spread_is_estimated_and_near_ones_are_exact(spark):
    many = "this line is on very many sites"
    near = "this line is on twenty sites only"
    rows = [(i, many + ("\n" + near if i < 20 else ""), f"site{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = line_dedup.dedup_lines(df, min_sites=20).agg(F.sum("n_removed")).first()[0]
    assert out == 399 + 19
    assert line_dedup.dedup_lines(df, min_sites=21).agg(F.sum("n_removed")).first()[0] == 399


def test_long_passages_on_two_sites(spark):
    import corpus_pipeline

    rng = random.Random(12)
    passage, short = prose(rng, 60), prose(rng, 20)
    rows = [(i, "\n".join([prose(rng, 60), passage, short]), "en", f"s{i % 2}", 0) for i in range(6)] + [(6, prose(rng, 60) + "\n" + passage[:-1], "en", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert [i for i in sorted(got) if passage in got[i]] == [0] and all(short in got[i] for i in range(6)) and passage[:-1] in got[6]
    assert line_dedup.dedup_lines(df).agg(F.sum("n_removed")).first()[0] == 0
    one = df.withColumn("source", F.lit("s0"))
    assert line_dedup.dedup_lines(one, long_sites=2).agg(F.sum("n_removed")).first()[0] == 0
